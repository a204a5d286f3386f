"""Queries over conditional rollups, strong tokens, destinations and merge plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import UNITS
from ..functions.text import strong_tokens as tokens_of
from ..functions.vectors import unit, usable
from ..operators.block_search import block_search
from ..operators.clustering import greedy_matching
from ..session import materialize
from ..sources.schema import rejects
from .common import AS_OF, Catalogue, ago, mean6, mean6_sql, read, ts

C = Catalogue()


@C.add(f"""
SELECT COALESCE(pair_type, '-') AS pair_type, COUNT(*) AS n, COUNT(*) FILTER (decision = 'same_story') AS same_story, COUNT(DISTINCT CASE WHEN decision = 'same_story' THEN left_cluster_id END) AS stories, COUNT(*) FILTER (decision = 'same_story' AND NOT merged AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 MINUTE) AS stale_open,
 MIN(created_at) FILTER (decision = 'same_story') AS first_same, MAX(created_at) FILTER (decision <> 'same_story') AS last_other, {mean6_sql("max_article_similarity")} AS avg_similarity FROM cross_category_cluster_adjudications GROUP BY 1 HAVING COUNT(*) FILTER (decision = 'same_story') > 0""")
def verdict_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Conditional counts, distinct counts, minima and maxima per pair kind, kept if a filtered count is positive."""
    same = F.col("decision") == "same_story"
    g = read(spark, d, "cross_category_cluster_adjudications").groupBy(F.coalesce("pair_type", F.lit("-")).alias("pair_type")).agg(
        F.count("*").alias("n"), F.count_if(same).alias("same_story"), F.count_distinct(F.when(same, F.col("left_cluster_id"))).alias("stories"), F.count_if(same & ~F.col("merged") & (F.col("created_at") < ago(AS_OF, "30 MINUTE"))).alias("stale_open"),
        F.min(F.when(same, F.col("created_at"))).alias("first_same"), F.max(F.when(~same, F.col("created_at"))).alias("last_other"), mean6(F.col("max_article_similarity")).alias("avg_similarity"))
    return g.filter("same_story > 0")


@C.add("""
SELECT COALESCE(c.category_slug, '-') AS category_slug, COUNT(*) AS n, COUNT(*) FILTER (EXISTS (SELECT 1 FROM cluster_articles m JOIN article_embeddings e USING (article_id) WHERE m.cluster_id = c.cluster_id)) AS with_vector,
 COUNT(*) FILTER (NOT EXISTS (SELECT 1 FROM cross_category_cluster_adjudications x WHERE x.left_cluster_id = c.cluster_id OR x.right_cluster_id = c.cluster_id)) AS never_judged FROM story_clusters c GROUP BY 1""")
def category_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Existence tests inside an aggregate, as flags joined before it."""
    m = read(spark, d, "cluster_articles").select("cluster_id", "article_id").join(read(spark, d, "article_embeddings").select("article_id"), "article_id", "left_semi").select("cluster_id").distinct().withColumn("v", F.lit(True))
    x = read(spark, d, "cross_category_cluster_adjudications")
    judged = x.select(F.explode(F.array("left_cluster_id", "right_cluster_id")).alias("cluster_id")).distinct().withColumn("j", F.lit(True))
    c = read(spark, d, "story_clusters").select("cluster_id", "category_slug").join(m, "cluster_id", "left").join(judged, "cluster_id", "left")
    return c.groupBy(F.coalesce("category_slug", F.lit("-")).alias("category_slug")).agg(F.count("*").alias("n"), F.count_if(F.col("v")).alias("with_vector"), F.count_if(F.col("j").isNull()).alias("never_judged"))


#: Units of the amounts in these texts, by alias, beside the general ones.
_LOCAL_UNITS = {"units": "units", "sites": "sites", "stück": "units", "sedes": "sites", "pièces": "units"}
_UNITS = UNITS | _LOCAL_UNITS
_ALIASES = "|".join(re.escape(a) for a in sorted(_UNITS, key=lambda a: (-len(a), a)))
_UNIT_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _UNITS.items()) + "}"


@C.add(rf"""
SELECT article_id, token FROM (SELECT article_id, unnest(list_distinct(list_concat(regexp_extract_all(title, '(?:^|[^\p{{L}}\p{{N}}])([A-Z][A-Z0-9]{{2,}})(?:$|[^\p{{L}}\p{{N}}])', 1),
 list_transform(regexp_extract_all(lower(summary), '([0-9][0-9.,]*[0-9]|[0-9])\s*({_ALIASES})'), lambda x: replace(regexp_extract(x, '^([0-9.,]+)', 1), ',', '') || ' ' || {_UNIT_MAP}[regexp_extract(x, '^[0-9.,]+\s*(.*)$', 1)])))) AS token
 FROM articles WHERE title IS NOT NULL AND summary IS NOT NULL) t""")
def strong_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that identify a story: acronyms of the title, amounts of the summary with their unit under one name."""
    a = read(spark, d, "articles").filter("title is not null and summary is not null")
    return a.select("article_id", F.explode(tokens_of(F.col("title"), F.col("summary"), _UNITS)).alias("token"))


@C.add("SELECT DISTINCT category_slug, channel, sha256(category_slug || '|' || channel) AS destination FROM (SELECT category_slug, CASE WHEN category_slug LIKE '%-power' THEN 'energy' ELSE split_part(category_slug, '-', 1) END AS channel FROM story_clusters WHERE category_slug IS NOT NULL) t")
def destinations(spark: SparkSession, d: str) -> DataFrame:
    """Distinct destinations of the categories with their hash."""
    c = read(spark, d, "story_clusters").filter("category_slug is not null").select("category_slug").distinct()
    c = c.withColumn("channel", F.when(F.col("category_slug").like("%-power"), "energy").otherwise(F.split_part("category_slug", F.lit("-"), F.lit(1))))
    return c.withColumn("destination", F.sha2(F.concat_ws("|", "category_slug", "channel"), 256))


@C.add(f"SELECT embedding_model, COUNT(*) AS n, COUNT(*) FILTER (embedding_vector IS NULL) AS n_null, COUNT(*) FILTER (len(embedding_vector) <> embedding_dimensions) AS n_short, COUNT(*) FILTER (created_at > TIMESTAMP '{AS_OF}') AS future FROM article_embeddings GROUP BY 1")
def embedding_stats(spark: SparkSession, d: str) -> DataFrame:
    """Vectors per model and those that are missing, of another length or dated in the future."""
    return read(spark, d, "article_embeddings").groupBy("embedding_model").agg(F.count("*").alias("n"), F.count_if(F.col("embedding_vector").isNull()).alias("n_null"), F.count_if(F.size("embedding_vector") != F.col("embedding_dimensions")).alias("n_short"), F.count_if(F.col("created_at") > ts(AS_OF)).alias("future"))


@C.add("SELECT article_id, cluster_id, CASE WHEN NOT COALESCE(role IN ('representative', 'member'), false) AND NOT COALESCE(similarity BETWEEN -1 AND 1, false) THEN 'role,similarity' WHEN NOT COALESCE(similarity BETWEEN -1 AND 1, false) THEN 'similarity' ELSE 'role' END AS broken FROM cluster_articles WHERE NOT COALESCE(role IN ('representative', 'member'), false) OR NOT COALESCE(similarity BETWEEN -1 AND 1, false) UNION ALL SELECT adjudication_id, NULL, 'confidence' FROM cross_category_cluster_adjudications WHERE NOT COALESCE(confidence BETWEEN 0 AND 1, false)")
def rejected_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break a declared rule of their table."""
    m = rejects(read(spark, d, "cluster_articles"), "cluster_articles").select("article_id", "cluster_id", F.array_join("broken_rules", ",").alias("broken"))
    x = rejects(read(spark, d, "cross_category_cluster_adjudications"), "cross_category_cluster_adjudications").filter(F.array_contains("broken_rules", "confidence"))
    return m.unionByName(x.select(F.col("adjudication_id").alias("article_id"), F.lit(None).cast("bigint").alias("cluster_id"), F.lit("confidence").alias("broken")))


#: Pairs the greedy step looks at in one block, and merges of a pass.
MERGE_CANDIDATES, MERGES = 2_000, 50
#: Similarity from which two stories may merge.
MERGE_SIMILARITY = 0.5


def planned_merges(pairs: DataFrame, stories: DataFrame, block: int = MERGE_CANDIDATES, most: int = MERGES) -> list[tuple[int, int, float]]:
    """(target, source, similarity) of the greedy step over all ``pairs`` (a, b, similarity); ``stories`` has cluster_id, n, latest.

    The ranked pairs are read in blocks. Spark drops those that the merges so far rule out; every pair of
    an earlier block is among them, and the first pair of a block never is, so there are at most ``most`` blocks.
    """
    side = lambda c: stories.select(F.col("cluster_id").alias(c), F.struct("n", "latest", (-F.col("cluster_id")).alias("i")).alias(f"rank_{c}"))
    ranked = pairs.join(side("a"), "a").join(side("b"), "b")
    first = F.col("rank_a") >= F.col("rank_b")
    ranked = materialize(ranked.withColumns({"target": F.when(first, F.col("a")).otherwise(F.col("b")), "source": F.when(first, F.col("b")).otherwise(F.col("a"))}), "merge-pairs")
    plan: list[tuple[int, int, float]] = []
    while len(plan) < most:
        targets, sources = [t for t, _, _ in plan], [s for _, s, _ in plan]
        rows = ranked.filter(~F.col("source").isin(sources + targets) & ~F.col("target").isin(sources)).orderBy(F.desc("similarity"), "a", "b").limit(block).collect()
        rank = {r[c]: tuple(r[f"rank_{c}"]) for r in rows for c in "ab"}
        plan = greedy_matching([(r["a"], r["b"], r["similarity"]) for r in rows], rank, most, plan)
        if len(rows) < block:
            break
    return plan


_MERGE_SQL = f"""WITH RECURSIVE s AS (SELECT cluster_id, category_slug, COALESCE(article_count, 0) AS n, latest_published_at AS at, list_transform(centroid_embedding_vector, lambda x: x::DOUBLE / sqrt(list_inner_product(centroid_embedding_vector::DOUBLE[], centroid_embedding_vector::DOUBLE[]))) AS u
 FROM story_clusters WHERE len(centroid_embedding_vector) = 64 AND len(list_filter(centroid_embedding_vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(centroid_embedding_vector, lambda x: x <> 0)) > 0),
p AS (SELECT a.cluster_id AS a, b.cluster_id AS b, ROUND(list_inner_product(a.u, b.u), 6) AS similarity, a.n > b.n OR (a.n = b.n AND (COALESCE(a.at > b.at, a.at IS NOT NULL) OR a.at IS NOT DISTINCT FROM b.at)) AS first
 FROM s a JOIN s b ON a.category_slug = b.category_slug AND a.cluster_id < b.cluster_id WHERE ROUND(list_inner_product(a.u, b.u), 6) >= {MERGE_SIMILARITY}),
r AS MATERIALIZED (SELECT CASE WHEN first THEN a ELSE b END AS t, CASE WHEN first THEN b ELSE a END AS s, similarity, ROW_NUMBER() OVER (ORDER BY similarity DESC, a, b) AS k FROM p),
g AS (SELECT 0 AS step, []::BIGINT[] AS sources, []::BIGINT[] AS targets, 0::BIGINT AS k UNION ALL
 SELECT step + 1, list_append(sources, r.s), list_append(targets, r.t), r.k FROM g JOIN r ON r.k = (SELECT MIN(x.k) FROM r x WHERE x.k > g.k AND NOT list_contains(g.sources, x.s) AND NOT list_contains(g.targets, x.s) AND NOT list_contains(g.sources, x.t)) WHERE step < {MERGES})
SELECT r.t AS target_id, r.s AS source_id, similarity FROM g JOIN r USING (k) WHERE step > 0"""


@C.add(_MERGE_SQL)
def merge_plan(spark: SparkSession, d: str) -> DataFrame:
    """One merge pass over all stories: similar ones of one category, best first, a source used once and never a target.

    Every story is compared with every other of its category, in blocks. The candidates are ranked by Spark; the greedy step gets them in blocks of MERGE_CANDIDATES and stops after MERGES merges.
    """
    c = read(spark, d, "story_clusters").filter(usable(F.col("centroid_embedding_vector"), 64))
    s = c.select(F.col("cluster_id").alias("id"), unit(F.col("centroid_embedding_vector")).alias("vec"), F.col("category_slug").alias("grp"))
    found = block_search(s, s, None, MERGE_SIMILARITY, "same").filter("query_id < id").select(F.col("query_id").alias("a"), F.col("id").alias("b"), "similarity")
    size = c.select("cluster_id", F.coalesce("article_count", F.lit(0)).alias("n"), F.coalesce(F.col("latest_published_at").cast("string"), F.lit("")).alias("latest"))
    return spark.createDataFrame(planned_merges(found, size), "target_id bigint, source_id bigint, similarity double")


QUERIES, ORACLE = C.queries, C.oracle
