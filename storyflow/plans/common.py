"""What the named queries share: table access, the reference instant, registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every time predicate is relative to an explicit instant, never to the wall clock.
AS_OF = "2025-11-10 00:00:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"

QUERY = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Named queries with the SQL they are compared with."""

    def __init__(self) -> None:
        self.queries: dict[str, QUERY] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[QUERY], QUERY]:
        def register(f: QUERY) -> QUERY:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ts(text: str) -> Column:
    """An instant without zone."""
    return F.lit(text).cast("timestamp_ntz")


def ago(text: str, interval: str) -> Column:
    return ts(text) - F.expr(f"INTERVAL '{interval}'")


def mean6(value: Column) -> Column:
    """Mean of numbers taken to six decimals, rounded half up in whole numbers: the same whatever the order of the rows."""
    n, total = F.count(value), F.sum(F.round(value * 1_000_000).try_cast("long"))
    top, bottom = total * 2 + n, n * 2
    return F.when(n > 0, F.try_divide(F.try_divide(top - F.pmod(top, bottom), bottom), F.lit(1e6)))


def mean6_sql(v: str) -> str:
    """The same in SQL."""
    n, top = f"COUNT({v})", f"(2 * SUM(TRY_CAST(ROUND({v} * 1000000) AS BIGINT)) + COUNT({v}))"
    return f"(CASE WHEN {n} > 0 THEN CAST(({top} - (({top} % (2 * {n}) + 2 * {n}) % (2 * {n}))) // (2 * {n}) AS DOUBLE) / 1e6 END)"
