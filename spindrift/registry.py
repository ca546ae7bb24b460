"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def registered() -> dict:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
