"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridion.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a function of (spark, sf_dir); ``sql`` reads the given tables and the named layers."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return f

    return put
