"""Registry of named queries and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame``.  Outputs are flat and
comparable across engines: arrays become sorted comma-joined strings unless
their order is the point, doubles are rounded to 6 decimals, counts and ranks
are ``bigint``, timestamps are ISO strings.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
HEADLINE: list[str] = []


def _utc(fn: QueryFn) -> QueryFn:
    """Results are defined in UTC (day windows, ISO text).

    The zone is part of each expression from the moment a query is built, so the session's own setting is
    put back once the query is planned."""
    import functools

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        zone = spark.conf.get("spark.sql.session.timeZone")
        if zone in ("UTC", "Etc/UTC", "Z"):
            return fn(spark, sf_dir)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        try:
            return fn(spark, sf_dir)
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
    return run


def query(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = _utc(fn)
        if sql is not None:
            ORACLE[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def joined(col: Column | str, sort: bool = True) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.array_sort(c) if sort else c, ",")


def r6(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), 6)


def iso(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def load_all() -> None:
    """Import every module that registers queries."""
    from tenderlake.plans import (q_listing, q_market, q_match, q_notices, q_profiles,  # noqa: F401
                                  q_text)
