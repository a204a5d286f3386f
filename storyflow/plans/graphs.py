"""Queries over duplicate groups and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import GUID_FILLERS, guid_key
from ..functions.vectors import unit, usable
from ..operators.clustering import online_clusters as cluster
from ..operators.graph import groups_by_shared_keys
from ..session import materialize
from .common import Catalogue, read

C = Catalogue()


_GUID = "trim(regexp_replace(lower(guid), '^[{\\s]*(urn:uuid:)?[{\\s]*|[}\\s]+$', '', 'g'))"


@C.add(rf"""
WITH RECURSIVE k AS (SELECT article_id, 'u ' || canonical_url AS key FROM articles WHERE canonical_url <> '' UNION SELECT article_id, 'g ' || lower(source_host) || ' ' || {_GUID} FROM articles WHERE source_host IS NOT NULL AND {_GUID} <> '' AND {_GUID} NOT IN ({", ".join(f"'{x}'" for x in GUID_FILLERS)})),
s AS (SELECT article_id, MIN(article_id) OVER (PARTITION BY key) AS first FROM k), e AS (SELECT article_id AS a, first AS b FROM s WHERE article_id <> first UNION SELECT first, article_id FROM s WHERE article_id <> first),
reach AS (SELECT a AS start, a AS v FROM e UNION SELECT r.start, e.b FROM reach r JOIN e ON e.a = r.v), g AS (SELECT MIN(v) AS group_id, start AS article_id FROM reach GROUP BY start),
r AS (SELECT g.*, (SELECT COUNT(*) FROM articles x WHERE x.content_hash = a.content_hash) AS n_entries, (SELECT COUNT(DISTINCT cluster_id) FROM cluster_articles m WHERE m.article_id = g.article_id) AS n_stories, EXISTS (SELECT 1 FROM article_embeddings v WHERE v.article_id = g.article_id) AS has_vector FROM g JOIN articles a USING (article_id))
SELECT group_id, article_id, ROW_NUMBER() OVER (PARTITION BY group_id ORDER BY n_entries DESC, n_stories > 0 DESC, n_stories DESC, has_vector DESC, article_id) = 1 AS kept FROM r""")
def duplicate_components(spark: SparkSession, d: str) -> DataFrame:
    """Articles that share an address, or an identifier within their host, directly or through others, and the one kept of each group.

    Kept is the article with most deliveries of its content, then in a story, in most stories, with a vector, and the first to arrive.
    """
    a = read(spark, d, "articles").select("article_id", "canonical_url", "guid", "source_host", "content_hash")
    groups = groups_by_shared_keys(a.select("article_id", "canonical_url", guid_key(F.col("source_host"), F.col("guid")).alias("guid")), "article_id", ["canonical_url", "guid"]).withColumnRenamed("vertex", "article_id")
    entries = a.groupBy("content_hash").agg(F.count("*").alias("n_entries"))
    member = read(spark, d, "cluster_articles").groupBy("article_id").agg(F.countDistinct("cluster_id").alias("n_stories"))
    vector = read(spark, d, "article_embeddings").select("article_id").distinct().withColumn("has_vector", F.lit(1))
    g = groups.join(a.select("article_id", "content_hash"), "article_id").join(entries, "content_hash", "left").join(member, "article_id", "left").join(vector, "article_id", "left").fillna(0, ["n_entries", "n_stories", "has_vector"])
    w = Window.partitionBy("group_id").orderBy(F.desc("n_entries"), F.desc("n_stories"), F.desc("has_vector"), "article_id")
    return g.select("group_id", "article_id", (F.row_number().over(w) == 1).alias("kept"))


@C.add()
def online_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Embedded articles attached to stories of their language one by one in order of arrival."""
    e = read(spark, d, "article_embeddings").filter(usable(F.col("embedding_vector"), 64)).select("article_id", unit(F.col("embedding_vector")).alias("vec"), F.col("created_at").alias("at"))
    j = e.join(read(spark, d, "articles").select("article_id", F.col("lang").alias("grp")), "article_id").withColumnRenamed("article_id", "id")
    return cluster(materialize(j.dropDuplicates(["id"]), "articles"), threshold=0.5)


QUERIES, ORACLE = C.queries, C.oracle
