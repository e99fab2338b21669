"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from tidemark.plans.views import with_views

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, views: str = "", sql: str | None = None, recursive: bool = False):
    """Register ``fn(spark, sf) -> DataFrame`` under ``name``.

    ``sql`` may start with further common table expressions, separated from the final SELECT by
    the usual comma syntax; ``views`` names the canonical views it reads.
    """
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = with_views(views, sql, recursive)
        return fn
    return register
