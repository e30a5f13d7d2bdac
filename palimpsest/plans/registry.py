"""Where queries register, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from .views import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(views: str = "", sql: str | None = None, name: str | None = None):
    """Registers f(spark, sf_dir). sql may begin with ``+`` to add further WITH tables."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = with_views(views, sql) if views else sql
        return f

    return put
