"""Keyed tables without DML: every change makes a new version, and one pointer names the current one.

Unique keys hold because each version is reduced to one row per key; foreign keys by semi and anti joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import read_text, write_text


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Union of both, one row per key: the first by ``order`` (null keys form their own group)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return old.unionByName(new).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def full_sync(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of both tables with ``action``: insert, update, delete or keep. Values come from the new table where it has the key."""
    o = old.select(*keys, F.struct(*values).alias("_o"), F.lit(True).alias("_in_o"))
    n = new.select(*keys, F.struct(*values).alias("_n"), F.lit(True).alias("_in_n"))
    j = o.join(n, keys, "full")
    action = F.when(F.col("_in_o").isNull(), "insert").when(F.col("_in_n").isNull(), "delete").when(~F.col("_n").eqNullSafe(F.col("_o")), "update").otherwise("keep")
    return j.select(*keys, *[F.when(F.col("_in_n"), F.col(f"_n.{v}")).otherwise(F.col(f"_o.{v}")).alias(v) for v in values], action.alias("action"))


class SnapshotTable:
    """Versions of one table below a folder. A single writer commits; readers follow the pointer file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """Number of the current version, 0 for none."""
        return int(read_text(self.spark, f"{self.path}/_current") or 0)

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.path}/v{v}") if v else None

    def commit(self, df: DataFrame) -> int:
        """Write a new version, then move the pointer to it."""
        v = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{v}")
        write_text(self.spark, f"{self.path}/_current", str(v))
        return v

    def merge(self, new: DataFrame, keys: list[str], order: list[Column | str]) -> int:
        """Upsert ``new``; running it twice with the same rows changes nothing."""
        old = self.read()
        return self.commit(upsert(old if old is not None else new.limit(0), new, keys, order))
