"""Queries over embeddings: centroids, similarity, neighbours, topic scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_double, cosine, dot, unit, usable
from ..operators.block_search import block_search
from ..session import materialize
from .common import Catalogue, read

C = Catalogue()

_DIMS = 64
_OK = "len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0"


def _unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x::DOUBLE / sqrt(list_inner_product({v}::DOUBLE[], {v}::DOUBLE[])))"


_S = f"WITH s AS (SELECT cluster_id, category_slug, {_unit_sql('centroid_embedding_vector')} AS u FROM story_clusters WHERE {_OK.format(v='centroid_embedding_vector')}), e AS (SELECT article_id, {_unit_sql('embedding_vector')} AS u FROM article_embeddings WHERE {_OK.format(v='embedding_vector')}) "


def _stories(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "story_clusters").filter(usable(F.col("centroid_embedding_vector"), _DIMS)).select("cluster_id", "category_slug", unit(F.col("centroid_embedding_vector")).alias("u"))


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "article_embeddings").filter(usable(F.col("embedding_vector"), _DIMS)).select("article_id", unit(F.col("embedding_vector")).alias("u"))


@C.add(_S + """, m AS (SELECT DISTINCT cluster_id, article_id FROM cluster_articles), p AS (SELECT cluster_id, i, AVG(u[i]) AS x FROM m JOIN e USING (article_id), range(1, 65) t(i) GROUP BY 1, 2),
c AS (SELECT cluster_id, list(x ORDER BY i) AS v FROM p GROUP BY 1)
SELECT cluster_id, list_transform(v, lambda x: ROUND(x / CASE WHEN list_inner_product(v, v) > 0 THEN sqrt(list_inner_product(v, v)) ELSE 1 END, 5)) AS centroid FROM c""")
def story_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Centroid of every story's member vectors: mean per position, then unit length."""
    m = read(spark, d, "cluster_articles").select("cluster_id", "article_id").distinct().join(_articles(spark, d), "article_id")
    c = m.groupBy("cluster_id").agg(F.array(*[F.avg(F.col("u")[i]) for i in range(_DIMS)]).alias("v"))
    return c.withColumn("u", unit(F.col("v"))).select("cluster_id", F.transform("u", lambda x: F.round(x, 5)).alias("centroid"))


@C.add(_S + "SELECT DISTINCT m.cluster_id, m.article_id, ROUND(list_inner_product(s.u, e.u), 6) AS similarity FROM cluster_articles m JOIN s USING (cluster_id) JOIN e USING (article_id)")
def member_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of every embedded member to its story's centroid."""
    m = read(spark, d, "cluster_articles").select("cluster_id", "article_id").distinct()
    j = m.join(_articles(spark, d), "article_id").join(_stories(spark, d).select("cluster_id", F.col("u").alias("c")), "cluster_id")
    return j.select("cluster_id", "article_id", F.round(dot(F.col("u"), F.col("c")), 6).alias("similarity"))


def _search(spark: SparkSession, d: str, k: int | None, threshold: float | None, rule: str) -> DataFrame:
    s = _stories(spark, d).select(F.col("cluster_id").alias("id"), F.col("u").alias("vec"), F.col("category_slug").alias("grp"))
    return block_search(s.filter("id % 100 = 0"), s, k, threshold, rule)


def _knn_sql(k: int, op: str) -> str:
    return _S + f"SELECT query_id, id, similarity FROM (SELECT a.cluster_id AS query_id, b.cluster_id AS id, ROUND(list_inner_product(a.u, b.u), 6) AS similarity, ROW_NUMBER() OVER (PARTITION BY a.cluster_id ORDER BY ROUND(list_inner_product(a.u, b.u), 6) DESC, b.cluster_id) AS r FROM s a JOIN s b ON a.category_slug {op} b.category_slug AND a.cluster_id <> b.cluster_id WHERE a.cluster_id % 100 = 0) t WHERE r <= {k}"


@C.add(_knn_sql(40, "="))
def knn_same_category(spark: SparkSession, d: str) -> DataFrame:
    """The 40 nearest stories of the same category for the stated queries (ids divisible by 100), exactly."""
    return _search(spark, d, 40, None, "same")


@C.add(_knn_sql(30, "<>"))
def knn_cross_category(spark: SparkSession, d: str) -> DataFrame:
    """The 30 nearest stories of other categories for the stated queries, exactly."""
    return _search(spark, d, 30, None, "different")


@C.add(_S + "SELECT a.cluster_id AS query_id, b.cluster_id AS id, ROUND(list_inner_product(a.u, b.u), 6) AS similarity FROM s a JOIN s b ON a.cluster_id <> b.cluster_id WHERE a.cluster_id % 100 = 0 AND ROUND(list_inner_product(a.u, b.u), 6) >= 0.35")
def similarity_threshold_join(spark: SparkSession, d: str) -> DataFrame:
    """All stories at least 0.35 similar to the stated queries."""
    return _search(spark, d, None, 0.35, "any")


@C.add(_S + """, p AS (SELECT DISTINCT least(left_cluster_id, right_cluster_id) AS a, greatest(left_cluster_id, right_cluster_id) AS b FROM cross_category_cluster_adjudications WHERE left_cluster_id <> right_cluster_id),
m AS (SELECT DISTINCT cluster_id, article_id, u FROM cluster_articles JOIN e USING (article_id))
SELECT p.a, p.b, MAX(ROUND(list_inner_product(x.u, y.u), 6)) AS max_article_similarity FROM p JOIN m x ON x.cluster_id = p.a JOIN m y ON y.cluster_id = p.b GROUP BY 1, 2""")
def max_article_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The most similar pair of articles across the two stories of every adjudicated pair."""
    x = read(spark, d, "cross_category_cluster_adjudications").filter("left_cluster_id <> right_cluster_id")
    return best_article_pairs(spark, d, x.select(F.least("left_cluster_id", "right_cluster_id").alias("a"), F.greatest("left_cluster_id", "right_cluster_id").alias("b")).distinct())


#: Members of a story that are compared as one matrix; a larger story is several.
MEMBER_BLOCK = 2_048


def best_article_pairs(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    """(a, b, max_article_similarity) of pairs of stories with embedded members: one matrix product per pair of blocks."""
    m = read(spark, d, "cluster_articles").select("cluster_id", "article_id").distinct().join(_articles(spark, d), "article_id")
    m = m.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("cluster_id").orderBy("article_id")) - 1) / MEMBER_BLOCK))
    packed = m.groupBy("cluster_id", "block").agg(F.flatten(F.collect_list("u")).alias("u"))
    packed = materialize(packed, "members")
    side = lambda c, v: packed.select(F.col("cluster_id").alias(c), F.col("u").alias(v))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            top = [float(np.round((np.asarray(x).reshape(-1, _DIMS) @ np.asarray(y).reshape(-1, _DIMS).T).max(), 6)) for x, y in zip(pdf.x, pdf.y)]
            yield pd.DataFrame({"a": pdf.a, "b": pdf.b, "s": top})

    j = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    return j.mapInPandas(best, "a long, b long, s double").groupBy("a", "b").agg(F.max("s").alias("max_article_similarity"))


_TOPICS = _S + """, pos AS (SELECT category_slug, i, AVG(u[i]) AS x FROM s, range(1, 65) t(i) WHERE category_slug IS NOT NULL GROUP BY 1, 2), topic AS (SELECT category_slug, list(x ORDER BY i) AS v FROM pos GROUP BY 1),
sc AS (SELECT article_id, category_slug, ROUND(list_inner_product(e.u, topic.v) / sqrt(list_inner_product(topic.v, topic.v)), 6) AS confidence FROM e, topic),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY article_id ORDER BY confidence DESC, category_slug) AS rank, LEAD(confidence) OVER (PARTITION BY article_id ORDER BY confidence DESC, category_slug) AS second FROM sc) """


#: Topic vectors that are broadcast together: 1,024 of 64 doubles are half a megabyte.
TOPIC_BLOCK = 1_024


def _ranked_topics(spark: SparkSession, d: str, most: int = 4) -> DataFrame:
    """Confidence of every article for its best topics (a topic is the mean of its story vectors), ranked.

    Topics are packed into rows of at most about TOPIC_BLOCK vectors. With one such row ranking needs no shuffle; with
    more, each block's best are merged per article.
    """
    mean = F.array(*[F.avg(F.col("u")[i]) for i in range(_DIMS)])
    topics = materialize(_stories(spark, d).filter("category_slug is not null").groupBy("category_slug").agg(mean.alias("v")), "topics")
    n_blocks = max(1, -(-topics.count() // TOPIC_BLOCK))
    score = lambda t: F.struct((-F.round(cosine(F.col("u"), t["v"]), 6)).alias("c"), t["category_slug"].alias("slug"))
    out = None
    for b in range(n_blocks):
        packed = topics.filter(F.pmod(F.xxhash64("category_slug"), F.lit(n_blocks)) == b).agg(F.collect_list(F.struct("category_slug", "v")).alias("topics"))
        part = _articles(spark, d).crossJoin(F.broadcast(packed)).select("article_id", F.slice(F.array_sort(F.transform("topics", score)), 1, most).alias("s"))
        out = part if out is None else out.unionByName(part)
    if n_blocks > 1:
        out = out.groupBy("article_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("s"))), 1, most).alias("s"))
    return out


@C.add(_TOPICS + "SELECT article_id, category_slug, rank, confidence FROM r WHERE rank <= 3")
def topic_scores(spark: SparkSession, d: str) -> DataFrame:
    """The three best topics of every embedded article. All scores of an article are one array, so ranking needs no shuffle."""
    s = _ranked_topics(spark, d).select("article_id", F.posexplode(F.slice("s", 1, 3)).alias("p", "t"))
    return s.select("article_id", F.col("t.slug").alias("category_slug"), (F.col("p") + 1).cast("long").alias("rank"), (-F.col("t.c")).alias("confidence"))


@C.add(_TOPICS + "SELECT article_id, CASE WHEN confidence < 0.3 THEN 'below_min_confidence' WHEN second IS NOT NULL AND confidence - second < 0.02 THEN 'below_min_margin' ELSE 'accepted' END AS decision, category_slug, confidence, ROUND(confidence - second, 6) AS margin FROM r WHERE rank = 1")
def topic_decision(spark: SparkSession, d: str) -> DataFrame:
    """Accept or reject the best topic by confidence and by its margin to the second."""
    t = _ranked_topics(spark, d).select("article_id", F.try_element_at("s", F.lit(1)).alias("a"), F.try_element_at("s", F.lit(2)).alias("b"))
    conf, second = -F.col("a.c"), -F.col("b.c")
    decision = F.when(conf < 0.3, "below_min_confidence").when(second.isNotNull() & (conf - second < 0.02), "below_min_margin").otherwise("accepted")
    return t.filter("a is not null").select("article_id", decision.alias("decision"), F.col("a.slug").alias("category_slug"), conf.alias("confidence"), F.round(conf - second, 6).alias("margin"))


@C.add("SELECT label, COUNT(*) AS n, ROUND(AVG(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS mean_square, ROUND(MIN(embedding[1]::DOUBLE), 5) AS least_first FROM embeddings GROUP BY 1")
def vector_profile(spark: SparkSession, d: str) -> DataFrame:
    """Vectors per label with their mean squared length."""
    e = read(spark, d, "embeddings").select("label", as_double(F.col("embedding")).alias("v"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(dot(F.col("v"), F.col("v"))), 5).alias("mean_square"), F.round(F.min(F.element_at("v", 1)), 5).alias("least_first"))



QUERIES, ORACLE = C.queries, C.oracle
