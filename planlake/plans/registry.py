"""Registry of queries: a function of (spark, sf_dir) and, where SQL can express it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from planlake.sources import proxies

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function by its name. ``{vT}`` and the like in sql stand for the proxy views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = proxies.expand(sql)
        return f

    return add
