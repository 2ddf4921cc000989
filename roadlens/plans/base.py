"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

from ..sources.adapters import with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers f(spark, sf_dir) as a query; sql is what DuckDB runs over the same tables."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_views(views, sql) if views else sql
        return f

    return register
