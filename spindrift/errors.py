"""Errors that callers may want to tell apart."""


class EngineError(Exception):
    """Any failure of the engine."""


class ConfigError(EngineError):
    """A setting is missing, malformed or unsafe."""


class StoreError(EngineError):
    """The snapshot store can't be read or written."""


class LockTimeout(StoreError):
    """Another writer has held the store for too long."""


class ProviderError(EngineError):
    """An embedding provider failed or isn't available."""


SUGGESTIONS = (
    (LockTimeout, "Another process is indexing. Try again in a moment."),
    (ConfigError, "Check the configuration file and the environment."),
    (ProviderError, "Check the embedding provider's settings and key."),
    (StoreError, "Run a forced reindex to rebuild the store."),
)


def as_response(error: Exception) -> dict[str, str]:
    """The error and what to do about it, for callers that must not see exceptions."""
    told = next((text for kind, text in SUGGESTIONS if isinstance(error, kind)), "Run reindex and try again.")
    if not isinstance(error, EngineError):
        return {"error": f"Unexpected error: {error}", "suggestion": "Please report this. Run reindex and try again."}
    return {"error": str(error), "suggestion": told}
