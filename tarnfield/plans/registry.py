"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnfield.plans.sql_views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, uses: str = "", sql: str | None = None):
    """Register ``fn(spark, folder)``; ``uses`` names the shared views the SQL builds on.

    ``sql`` may open with further common table expressions (``, extra AS (...)``).
    """

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            shared = ", ".join(f"{view} AS ({VIEWS[view]})" for view in uses.split())
            body = sql.strip()
            if shared:
                ORACLES[name] = f"WITH RECURSIVE {shared} {body}"
            else:
                ORACLES[name] = body
        return fn

    return keep
