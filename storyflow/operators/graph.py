"""Transitive groups over a link table, by passing least labels between neighbours until nothing changes.

Each round every vertex is linked to the least vertex of its neighbourhood, first from the side of larger, then of
smaller neighbours, so chains halve their length and the number of rounds stays logarithmic. Rounds are joins and
aggregations written to the shared folder; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, superseded


def least_labels(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(vertex, group_id) for all vertices of links with two different, present ends; group_id is the least vertex."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    edges = materialize(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi.alias("u"), lo.alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        raised = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = raised.groupBy("u").agg(F.min("v").alias("m"))
        pairs = raised.join(low, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        old, edges = edges, materialize(pairs.filter("u != v").distinct(), "edges")
        superseded(old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("group_id")).unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("group_id")).distinct())
        before = state
    raise RuntimeError(f"labels did not settle within {max_rounds} rounds")


def groups_by_shared_keys(rows: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """(vertex, group_id): rows that share the value of any key, directly or through others.

    A value held by many rows links each of them to the least one only, never all pairs. Null and empty values link nothing.
    """
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("value")) for k in keys]))
    long = rows.select(F.col(id_col).alias("id"), each).filter("value is not null and value <> ''")
    least = long.groupBy("k", "value").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return least_labels(long.join(least, ["k", "value"]).select("id", "first"), "id", "first")
