"""Queries of the training-data problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import address_key, guid_key
from ..session import materialize
from .components import connected_groups
from .encoding import garbled_fields
from .history_dedup import key_prints, settle_batches, text_prints
from .knn import nearest_neighbours, usable_vectors
from .leakage import LeakIndex
from .mixing import Mixture
from .oracle import ORACLE  # noqa: F401
from .reading_level import reading_levels
from .set_join import SimilarSets


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles that repeat an earlier one by address or identifier, with the earliest of them."""
    rows = _read(spark, d, "articles")
    keys = F.array(F.concat(F.lit("u "), address_key(F.col("canonical_url"))), F.concat(F.lit("g "), guid_key(F.col("source_host"), F.col("guid"))))
    found = settle_batches(key_prints(rows.select(F.col("batch_no").alias("batch"), F.col("article_id").alias("id"), F.explode(keys).alias("key"))))
    return found.groupBy(F.col("id").alias("article_id")).agg(F.min("first_id").alias("first_article_id")).select("first_article_id", "article_id")


def p3_near(spark: SparkSession, d: str) -> DataFrame:
    """Articles at least 80 % of whose winnowed five-word shingles stand in an earlier one of like length, with the earliest of these."""
    text = F.concat_ws(" ", "title", "summary", "content")
    rows = _read(spark, d, "articles").select(F.col("batch_no").alias("batch"), F.col("article_id").alias("id"), text.alias("text"))
    return settle_batches(text_prints(rows), 0.8).select(F.col("first_id").alias("first_article_id"), F.col("id").alias("article_id")).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of articles at least 70 % of whose distinct words of title and summary are in both."""
    similar = SimilarSets(_read(spark, d, "articles").select("article_id", "title", "summary"), "article_id", ["title", "summary"], "0.7")
    return similar.expanded(similar.pairs()).select(F.col("a").alias("article_id_a"), F.col("b").alias("article_id_b")).distinct()


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per article alike enough to another: least article of its group, its class of equal word sets, and its links.

    ``n_links`` is the number of articles it is alike to: those of its class and of all similar classes. Copies are counted, not listed.
    """
    similar = SimilarSets(_read(spark, d, "articles").select("article_id", "title", "summary"), "article_id", ["title", "summary"], "0.7")
    pairs = materialize(similar.pairs(), "class-pairs")
    groups = connected_groups(pairs, "a", "b").withColumnRenamed("member", "class_id")
    sizes = similar.classes.select("class_id", "n")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = both.join(sizes.withColumnRenamed("class_id", "b"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("across"))
    classes = sizes.join(groups, "class_id", "left").join(across, "class_id", "left").filter("group_id is not null or n > 1")
    classes = classes.select("class_id", F.coalesce("group_id", "class_id").alias("group_id"), (F.col("n") - 1 + F.coalesce("across", F.lit(0))).alias("n_links"))
    return similar.members.join(classes, "class_id").select("group_id", "class_id", F.col("member").alias("article_id"), "n_links").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every story linked by same-story verdicts, with the least story of its group."""
    links = _read(spark, d, "cross_category_cluster_adjudications").filter("decision = 'same_story'")
    return connected_groups(links.select("left_cluster_id", "right_cluster_id"), "left_cluster_id", "right_cluster_id").select("group_id", F.col("member").alias("cluster_id"))


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    return garbled_fields(_read(spark, d, "articles").select("article_id", "title", "summary", "content"), "article_id", ["title", "summary", "content"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Fields of articles with at least one character lost or altered by a wrong encoding."""
    return _garbled(spark, d).select(F.col("key").alias("article_id"), "field").distinct()


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    """Affected fields with the restored text and the number of characters that are lost."""
    return _garbled(spark, d).select(F.col("key").alias("article_id"), "field", "restored", "n_spans", "n_lost")


#: Scope of problem 7 -> (table, id, vector, k).
VECTOR_TABLES = {"article": ("article_embeddings", "article_id", "embedding_vector", 5), "cluster": ("story_clusters", "cluster_id", "centroid_embedding_vector", 3)}


def _neighbours(spark: SparkSession, d: str, scope: str) -> DataFrame:
    table, key, vector, k = VECTOR_TABLES[scope]
    return nearest_neighbours(usable_vectors(_read(spark, d, table), key, vector, 64), k)[0].withColumn("scope", F.lit(scope))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors of which either is among the k most similar of the other."""
    both = _neighbours(spark, d, "article").unionByName(_neighbours(spark, d, "cluster"))
    return both.select("scope", F.least("q", "id").alias("id_a"), F.greatest("q", "id").alias("id_b")).distinct()


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The k most similar other vectors of every article vector, with their cosine."""
    return _neighbours(spark, d, "article").select(F.col("q").alias("article_id"), F.col("id").alias("neighbour_id"), F.col("sim").alias("similarity"))


def _leaks(spark: SparkSession, d: str, near: bool = True) -> DataFrame:
    docs, items = _read(spark, d, "documents").select("doc_id", "text"), _read(spark, d, "eval_items").select("item_id", "text")
    return LeakIndex.build(docs).matches(items, near=near)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain at least 12 consecutive words of a test item, with the item."""
    return _leaks(spark, d, near=False).filter("kind = 'exact'").select("doc_id", "item_id")


def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    """Exact and proximity matches with the longest run and the number of agreeing words."""
    return _leaks(spark, d)


def _mixture(spark: SparkSession, d: str) -> Mixture:
    return Mixture(_read(spark, d, "documents").select("doc_id", "source", "text"), _read(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Copies of every document of the listed sources in the mixture."""
    return _mixture(spark, d).copies()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Token shares wanted and reached by source."""
    return _mixture(spark, d).shares()


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(_read(spark, d, "documents").select("doc_id", "text"), _read(spark, d, "reading_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Every prose document with its band of reading level."""
    return _levels(spark, d).select("doc_id", "band").distinct()


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """Every prose document with its level on the scale of grades."""
    return _levels(spark, d)


QUERIES = {"p3_found": p3_found, "p3_near": p3_near, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p6_found": p6_found, "p6_restored": p6_restored, "p7_found": p7_found, "p7_neighbours": p7_neighbours, "p8_found": p8_found, "p8_matches": p8_matches, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_levels": p10_levels}
