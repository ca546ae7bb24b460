"""Settings: defaults, then a YAML file, then the environment."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

from .errors import ConfigError

# Beginnings of service keys that must not stand in a file.
KEY_BEGINNINGS = ("sk-", "sk-ant-", "voy-", "key-", "gsk_", "co-")
LITERAL_KEY = re.compile("|".join(map(re.escape, KEY_BEGINNINGS)))

#: Setting by its place in nested YAML.
NESTED = {
    ("embedding", "mode"): "embedding_mode",
    ("embedding", "provider"): "embedding_provider",
    ("search", "default_top_k"): "top_k",
    ("search", "score_threshold"): "score_threshold",
    ("indexing", "batch_size"): "batch_size",
    ("indexing", "extra_ignore"): "extra_ignore",
    ("chunking", "max_chunk_lines"): "max_chunk_lines",
}
FROM_ENVIRONMENT = ("embedding_mode", "embedding_provider", "top_k", "score_threshold", "batch_size", "max_chunk_lines")


@dataclass(frozen=True)
class Config:
    embedding_mode: str = "lite"
    embedding_provider: str = "local"
    top_k: int = 5
    score_threshold: float = 0.5
    batch_size: int = 200
    max_chunk_lines: int = 150
    extra_ignore: tuple[str, ...] = ()

    @classmethod
    def load(cls, path: str | Path | None = None, environ: dict[str, str] | None = None, prefix: str = "CTS_") -> Config:
        """Settings out of a file (absent: none) and variables named prefix + the setting in capitals."""
        found: dict[str, Any] = {}
        if path and Path(path).exists():
            import yaml

            data = yaml.safe_load(Path(path).read_text())
            data = data if isinstance(data, dict) else {}
            refuse_keys(data)
            flat = {f.name for f in fields(cls)} - {"extra_ignore"}
            found |= {k: v for k, v in data.items() if k in flat}
            found |= {name: data[a][b] for (a, b), name in NESTED.items() if isinstance(data.get(a), dict) and b in data[a]}
        environ = os.environ if environ is None else environ
        found |= {name: environ[prefix + name.upper()] for name in FROM_ENVIRONMENT if prefix + name.upper() in environ}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if isinstance(found.get("extra_ignore"), str):
            raise ConfigError("extra_ignore must be a list of patterns")
        try:
            return cls(**{k: kinds[k](v) for k, v in found.items()})
        except (TypeError, ValueError) as e:
            raise ConfigError(f"a setting is malformed: {e}") from e


def refuse_keys(data: dict, at: str = "") -> None:
    """ConfigError if a value anywhere looks like a service key."""
    for name, value in data.items():
        if isinstance(value, dict):
            refuse_keys(value, f"{at}{name}.")
        elif isinstance(value, str) and LITERAL_KEY.match(value):
            raise ConfigError(f"{at}{name} holds what looks like a key; name an environment variable instead, such as {str(name).upper()}")
