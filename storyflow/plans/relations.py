"""Queries over joins, duplicates, set operations, ledgers and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.snapshots import full_sync, upsert
from .common import Catalogue, read

C = Catalogue()


@C.add("""
SELECT DISTINCT n.article_id, h.first_id FROM articles n JOIN (
 SELECT 'g' AS k, guid AS v, MIN(article_id) AS first_id FROM articles WHERE batch_no = 0 AND guid <> '' GROUP BY 2 UNION ALL SELECT 'u', canonical_url, MIN(article_id) FROM articles WHERE batch_no = 0 AND canonical_url <> '' GROUP BY 2
 UNION ALL SELECT 'h', content_hash, MIN(article_id) FROM articles WHERE batch_no = 0 GROUP BY 2) h
ON (h.k = 'g' AND h.v = n.guid) OR (h.k = 'u' AND h.v = n.canonical_url) OR (h.k = 'h' AND h.v = n.content_hash) WHERE n.batch_no > 0""")
def disjunctive_match(spark: SparkSession, d: str) -> DataFrame:
    """New articles matched with the history by identifier or address or content: one equi join over tagged keys instead of an OR."""
    a = read(spark, d, "articles")
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in (("g", "guid"), ("u", "canonical_url"), ("h", "content_hash"))])
    long = a.select("article_id", "batch_no", F.inline(keys)).filter("v is not null and (v <> '' or k = 'h')")
    old = long.filter("batch_no = 0").groupBy("k", "v").agg(F.min("article_id").alias("first_id"))
    return long.filter("batch_no > 0").join(old, ["k", "v"]).select("article_id", "first_id").distinct()


@C.add("SELECT content_hash, MIN(article_id) AS keeper_id, COUNT(*) AS n, COUNT(DISTINCT source_host) AS n_hosts FROM articles GROUP BY 1 HAVING COUNT(*) > 1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Groups of articles with one content, their keeper and size."""
    return read(spark, d, "articles").groupBy("content_hash").agg(F.min("article_id").alias("keeper_id"), F.count("*").alias("n"), F.countDistinct("source_host").alias("n_hosts")).filter("n > 1")


@C.add("""
SELECT check_name, COUNT(*) AS n_groups, CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS extra_rows FROM (
 SELECT 'guid' AS check_name, COUNT(*) AS n FROM articles WHERE guid <> '' GROUP BY guid HAVING COUNT(*) > 1 UNION ALL SELECT 'address', COUNT(*) FROM articles WHERE canonical_url <> '' GROUP BY canonical_url HAVING COUNT(*) > 1
 UNION ALL SELECT 'content', COUNT(*) FROM articles GROUP BY content_hash HAVING COUNT(*) > 1 UNION ALL SELECT 'membership', COUNT(*) FROM cluster_articles GROUP BY cluster_id, article_id HAVING COUNT(*) > 1) g GROUP BY 1""")
def duplicate_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per uniqueness rule the number of violating groups and of rows too many."""
    a, m = read(spark, d, "articles"), read(spark, d, "cluster_articles")
    checks = [("guid", a.filter("guid <> ''"), ["guid"]), ("address", a.filter("canonical_url <> ''"), ["canonical_url"]), ("content", a, ["content_hash"]), ("membership", m, ["cluster_id", "article_id"])]
    out = None
    for name, df, key in checks:
        one = df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(name).alias("check_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("check_name").agg(F.count("*").alias("n_groups"), F.sum(F.col("n") - 1).alias("extra_rows"))


@C.add("""
SELECT least(left_cluster_id, right_cluster_id) AS a, greatest(left_cluster_id, right_cluster_id) AS b, pair_type, MAX(centroid_similarity) AS best_similarity, COUNT(*) AS n FROM cross_category_cluster_adjudications
WHERE left_cluster_id <> right_cluster_id GROUP BY 1, 2, 3""")
def unordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    """One row per unordered pair and kind with the best similarity."""
    x = read(spark, d, "cross_category_cluster_adjudications").filter("left_cluster_id <> right_cluster_id")
    return x.groupBy(F.least("left_cluster_id", "right_cluster_id").alias("a"), F.greatest("left_cluster_id", "right_cluster_id").alias("b"), "pair_type").agg(F.max("centroid_similarity").alias("best_similarity"), F.count("*").alias("n"))


@C.add("""
SELECT c.cluster_id, COUNT(*) AS n_open, MIN(CASE WHEN x.left_cluster_id = c.cluster_id THEN x.right_cluster_id ELSE x.left_cluster_id END) AS least_other FROM story_clusters c JOIN cross_category_cluster_adjudications x ON x.left_cluster_id = c.cluster_id OR x.right_cluster_id = c.cluster_id
WHERE x.decision = 'same_story' AND NOT x.merged AND x.left_cluster_id <> x.right_cluster_id GROUP BY 1""")
def open_pair_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Stories at either end of an open same-story pair: the pair's ends are exploded, so the join has an equal key."""
    x = read(spark, d, "cross_category_cluster_adjudications").filter("decision = 'same_story' and not merged and left_cluster_id <> right_cluster_id")
    ends = x.select(F.inline(F.array(F.struct(F.col("left_cluster_id").alias("cluster_id"), F.col("right_cluster_id").alias("other")), F.struct(F.col("right_cluster_id").alias("cluster_id"), F.col("left_cluster_id").alias("other")))))
    return ends.join(read(spark, d, "story_clusters").select("cluster_id"), "cluster_id", "left_semi").groupBy("cluster_id").agg(F.count("*").alias("n_open"), F.min("other").alias("least_other"))


@C.add("""
SELECT x.adjudication_id, l.title AS left_title, r.title AS right_title, l.article_count AS left_articles, r.article_count AS right_articles,
 CASE WHEN l.article_count > r.article_count OR (l.article_count = r.article_count AND (l.latest_published_at > r.latest_published_at OR (l.latest_published_at IS NOT DISTINCT FROM r.latest_published_at AND l.cluster_id < r.cluster_id))) THEN l.cluster_id ELSE r.cluster_id END AS target_id
FROM cross_category_cluster_adjudications x JOIN story_clusters l ON l.cluster_id = x.left_cluster_id JOIN story_clusters r ON r.cluster_id = x.right_cluster_id WHERE x.decision = 'same_story' AND l.cluster_id <> r.cluster_id""")
def pair_details(spark: SparkSession, d: str) -> DataFrame:
    """Both stories of every same-story pair and the one that would absorb the other: more articles, later, smaller id."""
    c = read(spark, d, "story_clusters").select("cluster_id", "title", "article_count", "latest_published_at")
    side = lambda s: c.select(*[F.col(x).alias(f"{s}_{x}") for x in c.columns])
    x = read(spark, d, "cross_category_cluster_adjudications").filter("decision = 'same_story'").select("adjudication_id", "left_cluster_id", "right_cluster_id")
    j = x.join(side("left"), "left_cluster_id").join(side("right"), "right_cluster_id").filter("left_cluster_id <> right_cluster_id")
    left = (F.col("left_article_count") > F.col("right_article_count")) | ((F.col("left_article_count") == F.col("right_article_count")) & ((F.col("left_latest_published_at") > F.col("right_latest_published_at")) | (F.col("left_latest_published_at").eqNullSafe(F.col("right_latest_published_at")) & (F.col("left_cluster_id") < F.col("right_cluster_id")))))
    return j.select("adjudication_id", "left_title", "right_title", F.col("left_article_count").alias("left_articles"), F.col("right_article_count").alias("right_articles"), F.when(left, F.col("left_cluster_id")).otherwise(F.col("right_cluster_id")).alias("target_id"))


@C.add("SELECT a.article_id, a.batch_no FROM articles a WHERE NOT EXISTS (SELECT 1 FROM cluster_articles m WHERE m.article_id = a.article_id) AND NOT EXISTS (SELECT 1 FROM article_embeddings e WHERE e.article_id = a.article_id AND e.embedding_model = 'vec-a')")
def pending_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles neither embedded nor in a story: two anti joins."""
    e = read(spark, d, "article_embeddings").filter("embedding_model = 'vec-a'").select("article_id")
    return read(spark, d, "articles").select("article_id", "batch_no").join(read(spark, d, "cluster_articles").select("article_id"), "article_id", "left_anti").join(e, "article_id", "left_anti")


@C.add("SELECT e.article_id, e.embedding_model FROM article_embeddings e WHERE NOT EXISTS (SELECT 1 FROM cluster_articles m WHERE m.article_id = e.article_id AND m.added_at >= e.created_at - INTERVAL 1 MILLISECOND)")
def stale_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings whose article joined no story since: an anti join with a range as residual."""
    e, m = read(spark, d, "article_embeddings").select("article_id", "embedding_model", "created_at"), read(spark, d, "cluster_articles").select(F.col("article_id").alias("m_id"), "added_at")
    return e.join(m, (F.col("article_id") == F.col("m_id")) & (F.col("added_at") >= F.col("created_at") - F.expr("INTERVAL '0.001' SECOND")), "left_anti").select("article_id", "embedding_model")


@C.add("SELECT article_id, 'embedded' AS kind FROM article_embeddings WHERE embedding_vector IS NOT NULL UNION SELECT article_id, CASE WHEN role = 'representative' THEN 'lead' ELSE 'member' END FROM cluster_articles")
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    """Distinct union of embedded articles and story members."""
    e = read(spark, d, "article_embeddings").filter("embedding_vector is not null").select("article_id", F.lit("embedded").alias("kind"))
    m = read(spark, d, "cluster_articles").select("article_id", F.when(F.col("role") == "representative", "lead").otherwise("member").alias("kind"))
    return e.unionByName(m).distinct()


@C.add("SELECT article_id FROM articles EXCEPT SELECT article_id FROM cluster_articles")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    """Articles in no story."""
    return read(spark, d, "articles").select("article_id").subtract(read(spark, d, "cluster_articles").select("article_id"))


@C.add("SELECT category_slug, (ROW_NUMBER() OVER (ORDER BY category_slug) - 1) % 3 AS shard FROM (SELECT DISTINCT category_slug FROM story_clusters WHERE category_slug IS NOT NULL) t")
def category_shards(spark: SparkSession, d: str, total: int = 3) -> DataFrame:
    """Categories dealt to shards by their position; the list of categories is a small dimension."""
    k = read(spark, d, "story_clusters").filter("category_slug is not null").select("category_slug").distinct()
    return k.select("category_slug", F.pmod(F.row_number().over(Window.orderBy("category_slug")) - 1, F.lit(total)).cast("long").alias("shard"))


@C.add("SELECT article_id, cluster_id, role, added_at FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY article_id ORDER BY added_at DESC NULLS LAST, cluster_id, role) AS r FROM cluster_articles) t WHERE r = 1")
def upserted_membership(spark: SparkSession, d: str) -> DataFrame:
    """Membership as a keyed table: the last write per article wins."""
    m = read(spark, d, "cluster_articles").select("article_id", "cluster_id", "role", "added_at")
    return upsert(m.limit(0), m, ["article_id"], [F.desc_nulls_last("added_at"), "cluster_id", "role"])


@C.add("""
WITH o AS (SELECT feed_id, MIN(url) AS url FROM removed_failed_feeds WHERE country <> 'Estwick' OR country IS NULL GROUP BY 1), n AS (SELECT feed_id, MIN(CASE WHEN country = 'Costaluz' THEN url || '?v=2' ELSE url END) AS url FROM removed_failed_feeds WHERE validation_status LIKE 'OK%' GROUP BY 1)
SELECT COALESCE(n.feed_id, o.feed_id) AS feed_id, COALESCE(n.url, o.url) AS url, CASE WHEN o.feed_id IS NULL THEN 'insert' WHEN n.feed_id IS NULL THEN 'delete' WHEN n.url IS DISTINCT FROM o.url THEN 'update' ELSE 'keep' END AS action FROM o FULL JOIN n ON n.feed_id = o.feed_id""")
def feed_sync(spark: SparkSession, d: str) -> DataFrame:
    """Full synchronisation of a feed list: what a new list inserts, updates and deletes."""
    f = read(spark, d, "removed_failed_feeds")
    old = f.filter("country <> 'Estwick' or country is null").groupBy("feed_id").agg(F.min("url").alias("url"))
    new = f.filter("validation_status like 'OK%'").groupBy("feed_id").agg(F.min(F.when(F.col("country") == "Costaluz", F.concat("url", F.lit("?v=2"))).otherwise(F.col("url"))).alias("url"))
    return full_sync(old, new, ["feed_id"], ["url"])


@C.add("SELECT m.cluster_id, m.article_id, CASE WHEN c.cluster_id IS NULL THEN 'no_story' WHEN a.article_id IS NULL THEN 'no_article' ELSE 'bad_lead' END AS problem FROM (SELECT DISTINCT cluster_id, article_id FROM cluster_articles) m LEFT JOIN story_clusters c USING (cluster_id) LEFT JOIN articles a USING (article_id) WHERE c.cluster_id IS NULL OR a.article_id IS NULL OR (c.representative_article_id = m.article_id AND c.category_slug IS NULL)")
def broken_references(spark: SparkSession, d: str) -> DataFrame:
    """Members that a cascade would delete, and leads of stories without category."""
    m = read(spark, d, "cluster_articles").select("cluster_id", "article_id").distinct()
    c = read(spark, d, "story_clusters").select("cluster_id", "representative_article_id", "category_slug", F.lit(True).alias("has_c"))
    a = read(spark, d, "articles").select("article_id", F.lit(True).alias("has_a"))
    j = m.join(c, "cluster_id", "left").join(a, "article_id", "left")
    lead = (F.col("representative_article_id") == F.col("article_id")) & F.col("category_slug").isNull()
    return j.filter(F.col("has_c").isNull() | F.col("has_a").isNull() | lead).select("cluster_id", "article_id", F.when(F.col("has_c").isNull(), "no_story").when(F.col("has_a").isNull(), "no_article").otherwise("bad_lead").alias("problem"))


@C.add("SELECT adjudication_id, decision, CASE WHEN r > 1 THEN 'repeat' ELSE 'first' END AS standing FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY least(left_cluster_id, right_cluster_id), greatest(left_cluster_id, right_cluster_id) ORDER BY CASE decision WHEN 'same_story' THEN 0 WHEN 'related_but_distinct' THEN 1 ELSE 2 END, confidence DESC NULLS LAST, adjudication_id) AS r FROM cross_category_cluster_adjudications WHERE left_cluster_id IS NOT NULL AND right_cluster_id IS NOT NULL) t")
def ledger_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Ledger rows per unordered pair: the strongest verdict stands, the others are repeats."""
    x = read(spark, d, "cross_category_cluster_adjudications").filter("left_cluster_id is not null and right_cluster_id is not null")
    strength = F.when(F.col("decision") == "same_story", 0).when(F.col("decision") == "related_but_distinct", 1).otherwise(2)
    w = Window.partitionBy(F.least("left_cluster_id", "right_cluster_id"), F.greatest("left_cluster_id", "right_cluster_id")).orderBy(strength, F.desc_nulls_last("confidence"), "adjudication_id")
    return x.select("adjudication_id", "decision", F.when(F.row_number().over(w) > 1, "repeat").otherwise("first").alias("standing"))


@C.add("""
SELECT o_orderkey AS id, c_name AS customer, n_name AS nation, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS n_lines FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY 1, 2, 3 ORDER BY revenue DESC, id LIMIT 50""")
def star_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Star join with aggregate and top-k: lines are summed before they meet the dimensions."""
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"), F.count("*").alias("n_lines"))
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey").join(read(spark, d, "nation").select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("c_nationkey"))
    return o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("customer"), F.col("n_name").alias("nation"), F.round("r", 2).alias("revenue"), "n_lines").orderBy(F.desc("revenue"), "id").limit(50)


QUERIES, ORACLE = C.queries, C.oracle
