"""Connected groups of pairwise matches.

The component of the vertex with most links is peeled by a frontier breadth-first search of joins and
removed by anti-join. What is left consists of smaller components; their labels shrink by minimum propagation,
in the alternating form (each vertex passes the minimum of its neighbourhood to its larger and then its
smaller neighbours) whose rounds grow with the logarithm of a chain's length. Should the search not end
within ``max_levels`` (a long chain), what it reached is contracted into one vertex and the rest goes to
the propagation as well, so no link is lost.

All rounds are joins and aggregations that combine before the shuffle; each writes its result to the
shared folder. Only counts reach the driver.

Defined results: links with a null side or equal sides are ignored; repeated and swapped links count
once; vertices without a link do not come out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import least_labels
from ..session import materialize


def _max_degree_vertex(edges: DataFrame):
    top = edges.groupBy("u").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "u").limit(1).collect()
    return top[0]["u"] if top else None


def _peel(edges: DataFrame, start, max_levels: int) -> tuple[DataFrame, bool]:
    """Vertices reached from ``start`` and whether the search ended by itself."""
    spark = edges.sparkSession
    kind = edges.schema["u"].dataType
    seen = frontier = materialize(spark.createDataFrame([(start,)], f"v {kind.simpleString()}"), "bfs")
    parts = [seen]
    for _ in range(max_levels):
        reached = edges.join(frontier.withColumnRenamed("v", "u"), "u", "left_semi").select("v").distinct()
        frontier = materialize(reached.join(seen, "v", "left_anti"), "bfs")
        if frontier.isEmpty():
            return seen, True
        parts.append(frontier)
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
    return seen, False


def connected_groups(links: DataFrame, left: str, right: str, max_levels: int = 12) -> DataFrame:
    """(group_id, member) for every record with a link; ``group_id`` is the least member of the group."""
    a, b = F.col(left), F.col(right)
    once = links.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    once = materialize(once, "links")
    both = once.unionByName(once.select(F.col("v").alias("u"), F.col("u").alias("v")))
    start = _max_degree_vertex(both)
    if start is None:
        return once.select(F.col("v").alias("group_id"), F.col("u").alias("member"))
    giant, ended = _peel(both, start, max_levels)
    giant = materialize(giant, "giant")
    root = giant.agg(F.min("v")).first()[0]
    flag = giant.withColumnRenamed("v", "_g")
    if ended:
        rest = once.join(flag, F.col("u") == F.col("_g"), "left_anti")
    else:  # contract what was reached into its least vertex
        m1 = once.join(flag.withColumn("_in_u", F.lit(True)), F.col("u") == F.col("_g"), "left").drop("_g")
        m2 = m1.join(flag.withColumn("_in_v", F.lit(True)), F.col("v") == F.col("_g"), "left").drop("_g")
        cu, cv = F.when(F.col("_in_u"), F.lit(root)).otherwise(F.col("u")), F.when(F.col("_in_v"), F.lit(root)).otherwise(F.col("v"))
        rest = m2.select(F.greatest(cu, cv).alias("u"), F.least(cu, cv).alias("v")).filter("u != v").distinct()
    labels = least_labels(rest, "u", "v").select(F.col("vertex").alias("v"), F.col("group_id").alias("label"))
    if not ended:
        top = labels.filter(F.col("v") == F.lit(root)).select("label").collect()
        root_label = top[0][0] if top else root
        labels = labels.filter(F.col("v") != F.lit(root))
        root = root_label
    return giant.select(F.lit(root).alias("group_id"), F.col("v").alias("member")).unionByName(labels.select(F.col("label").alias("group_id"), F.col("v").alias("member"))).distinct()
