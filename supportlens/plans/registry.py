"""Where the queries and their check SQL are listed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from supportlens.plans.oracle_views import VIEWS
from supportlens.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: str = "", name: str | None = None):
    """List the function under its name; ``views`` are the derived tables its SQL uses."""

    def add(function: Query) -> Query:
        key = name or function.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is listed twice")
        QUERIES[key] = lambda spark, sf_dir: function(apply_settings(spark), sf_dir)
        if sql is not None:
            ORACLES[key] = with_views(sql, views)
        return function

    return add


def with_views(sql: str, views: str) -> str:
    if not views:
        return sql.strip()
    parts = ", ".join(f"{v} AS ({VIEWS[v].strip()})" for v in views.split())
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {parts}, {body[5:]}"
    return f"WITH {parts} {body}"
