"""Read models: story cards, distributions, scorecards, timelines, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import AS_OF, AS_OF_EVENTS, Catalogue, ago, mean6, mean6_sql, read, ts

C = Catalogue()


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Story members once each, with their article's host and title."""
    bridge = read(spark, d, "cluster_articles").select("cluster_id", "article_id", "similarity", "role").distinct()
    return bridge.join(read(spark, d, "articles").select("article_id", "source_host", "title"), "article_id")


@C.add(f"""
WITH m AS (SELECT DISTINCT cluster_id, article_id, similarity, role FROM cluster_articles), g AS (
 SELECT m.cluster_id, COUNT(*) AS n_articles, {mean6_sql("similarity")} AS avg_similarity, ROUND(MIN(similarity), 6) AS min_similarity,
  COUNT(DISTINCT source_host) AS n_sources, STRING_AGG(CAST(a.article_id AS VARCHAR), ',' ORDER BY (role = 'representative') DESC, similarity DESC NULLS LAST, a.article_id) AS article_ids
 FROM m JOIN articles a USING (article_id) GROUP BY m.cluster_id)
SELECT c.cluster_id, c.title, COALESCE(c.category_slug, 'uncategorised') AS category_slug, COALESCE(n_articles, 0) AS n_articles, avg_similarity, min_similarity, COALESCE(n_sources, 0) AS n_sources, COALESCE(article_ids, '') AS article_ids
FROM story_clusters c LEFT JOIN g USING (cluster_id)""")
def cluster_cards(spark: SparkSession, d: str) -> DataFrame:
    """Every story with its member quality and its articles, representative first, then by similarity."""
    g = _members(spark, d).groupBy("cluster_id").agg(
        F.count("*").alias("n_articles"), mean6(F.col("similarity")).alias("avg_similarity"), F.round(F.min("similarity"), 6).alias("min_similarity"), F.countDistinct("source_host").alias("n_sources"),
        F.array_sort(F.collect_list(F.struct(F.when(F.col("role") == "representative", 0).otherwise(1).alias("r"), F.coalesce(-F.col("similarity"), F.lit(9.0)).alias("s"), "article_id"))).alias("o"),
    )
    g = g.withColumn("article_ids", F.array_join(F.transform("o", lambda x: x["article_id"].cast("string")), ",")).drop("o")
    c = read(spark, d, "story_clusters").select("cluster_id", "title", F.coalesce("category_slug", F.lit("uncategorised")).alias("category_slug"))
    return c.join(g, "cluster_id", "left").fillna(0, ["n_articles", "n_sources"]).fillna("", ["article_ids"])


@C.add("""
WITH m AS (SELECT DISTINCT cluster_id, article_id, similarity, role FROM cluster_articles)
SELECT m.cluster_id, ROW_NUMBER() OVER (PARTITION BY m.cluster_id ORDER BY (role = 'representative') DESC, similarity DESC NULLS LAST, article_id) AS position, article_id, a.title, a.source_host, m.role, ROUND(similarity, 6) AS similarity
FROM m JOIN story_clusters c USING (cluster_id) JOIN articles a USING (article_id)""")
def cluster_detail(spark: SparkSession, d: str) -> DataFrame:
    """The ordered members of every story."""
    order = Window.partitionBy("cluster_id").orderBy((F.col("role") == "representative").desc(), F.desc_nulls_last("similarity"), "article_id")
    known = read(spark, d, "story_clusters").select("cluster_id")
    return _members(spark, d).join(known, "cluster_id", "left_semi").select("cluster_id", F.row_number().over(order).cast("long").alias("position"), "article_id", "title", "source_host", "role", F.round("similarity", 6).alias("similarity"))


@C.add(f"""
WITH m AS (SELECT cluster_id, COUNT(DISTINCT article_id) AS n, {mean6_sql("similarity")} AS q FROM cluster_articles GROUP BY cluster_id),
s AS (SELECT c.cluster_id, COALESCE(c.category_slug, 'uncategorised') AS category_slug, COALESCE(n, 0) AS n, q FROM story_clusters c LEFT JOIN m USING (cluster_id))
SELECT category_slug, COUNT(*) AS n_clusters, COUNT(*) FILTER (n = 1) AS single, COUNT(*) FILTER (n BETWEEN 2 AND 4) AS small, COUNT(*) FILTER (n BETWEEN 5 AND 14) AS medium, COUNT(*) FILTER (n >= 15) AS large, {mean6_sql("q")} AS mean_quality, CAST(SUM(n) AS BIGINT) AS n_articles
FROM s GROUP BY category_slug""")
def cluster_size_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Two-level aggregate: quality and size per story, then size buckets and mean quality per category."""
    m = read(spark, d, "cluster_articles").groupBy("cluster_id").agg(F.countDistinct("article_id").alias("n"), mean6(F.col("similarity")).alias("q"))
    s = read(spark, d, "story_clusters").select("cluster_id", F.coalesce("category_slug", F.lit("uncategorised")).alias("category_slug")).join(m, "cluster_id", "left").fillna(0, ["n"])
    return s.groupBy("category_slug").agg(
        F.count("*").alias("n_clusters"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n").between(2, 4)).alias("small"),
        F.count_if(F.col("n").between(5, 14)).alias("medium"), F.count_if(F.col("n") >= 15).alias("large"), mean6(F.col("q")).alias("mean_quality"), F.sum("n").alias("n_articles"),
    )


CATEGORIES = ("grid-power", "sea-cables", "chip-plants", "payment-rails", "field-robotics", "no-such-topic")


@C.add(f"""
WITH spine AS (SELECT UNNEST([{", ".join(f"'{c}'" for c in CATEGORIES)}]) AS category_slug)
SELECT s.category_slug, COUNT(c.cluster_id) AS n_clusters, ROUND(AVG(c.article_count), 6) AS avg_articles, COUNT(*) FILTER (c.latest_published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND c.latest_published_at <= TIMESTAMP '{AS_OF}') AS last_week
FROM spine s LEFT JOIN story_clusters c ON c.category_slug = s.category_slug GROUP BY s.category_slug""")
def category_spine(spark: SparkSession, d: str) -> DataFrame:
    """A configured list of categories as spine; categories without a story keep a row of zeros."""
    spine = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category_slug"))
    c = read(spark, d, "story_clusters").select("category_slug", "cluster_id", "article_count", "latest_published_at")
    recent = F.col("latest_published_at").between(ago(AS_OF, "7 DAY"), ts(AS_OF))
    g = c.groupBy("category_slug").agg(F.count("cluster_id").alias("n_clusters"), F.round(F.avg("article_count"), 6).alias("avg_articles"), F.count_if(recent).alias("last_week"))
    return spine.join(g, "category_slug", "left").fillna(0, ["n_clusters", "last_week"])


_FEEDS_SQL = "WITH f AS (SELECT feed_id, MIN(country) AS country, MIN(validation_status) AS validation_status FROM removed_failed_feeds GROUP BY feed_id), a AS (SELECT source_host AS feed_id, COUNT(*) AS n_articles, COUNT(DISTINCT content_hash) AS n_contents, COUNT(*) FILTER (batch_no > 0) AS n_new, MAX(article_id) AS last_article FROM articles GROUP BY 1) "


def _feeds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = read(spark, d, "removed_failed_feeds").groupBy("feed_id").agg(F.min("country").alias("country"), F.min("validation_status").alias("validation_status"))
    a = read(spark, d, "articles").groupBy(F.col("source_host").alias("feed_id")).agg(F.count("*").alias("n_articles"), F.countDistinct("content_hash").alias("n_contents"), F.count_if(F.col("batch_no") > 0).alias("n_new"), F.max("article_id").alias("last_article"))
    return f, a


@C.add(_FEEDS_SQL + "SELECT feed_id, country, validation_status, COALESCE(n_articles, 0) AS n_articles, COALESCE(n_contents, 0) AS n_contents, COALESCE(n_new, 0) AS n_new, ROUND(n_new * 1.0 / NULLIF(n_articles, 0), 6) AS share_new FROM f LEFT JOIN a USING (feed_id)")
def feed_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """Every feed with its deliveries; feeds without one keep zeros and a null share."""
    f, a = _feeds(spark, d)
    return f.join(a.drop("last_article"), "feed_id", "left").fillna(0, ["n_articles", "n_contents", "n_new"]).withColumn("share_new", F.round(F.try_divide(F.col("n_new").cast("double"), "n_articles"), 6))


@C.add(_FEEDS_SQL + "SELECT COALESCE(country, '-') AS country, COUNT(*) AS n_feeds, COUNT(*) FILTER (n_articles > 0) AS active_feeds, CAST(COALESCE(SUM(n_articles), 0) AS BIGINT) AS n_articles, CAST(COALESCE(SUM(n_new), 0) AS BIGINT) AS n_new FROM f LEFT JOIN a USING (feed_id) GROUP BY 1")
def country_activity(spark: SparkSession, d: str) -> DataFrame:
    """Feeds and deliveries per country."""
    f, a = _feeds(spark, d)
    return f.join(a, "feed_id", "left").groupBy(F.coalesce("country", F.lit("-")).alias("country")).agg(
        F.count("*").alias("n_feeds"), F.count_if(F.col("n_articles") > 0).alias("active_feeds"), F.coalesce(F.sum("n_articles"), F.lit(0)).alias("n_articles"), F.coalesce(F.sum("n_new"), F.lit(0)).alias("n_new"))


@C.add(_FEEDS_SQL + "SELECT feed_id, country, n_articles, last_article FROM a JOIN f USING (feed_id) ORDER BY n_articles DESC, feed_id LIMIT 12")
def top_feeds(spark: SparkSession, d: str) -> DataFrame:
    """The twelve feeds with most articles."""
    f, a = _feeds(spark, d)
    return a.join(f, "feed_id").select("feed_id", "country", "n_articles", "last_article").orderBy(F.desc("n_articles"), "feed_id").limit(12)


@C.add("""
WITH a AS (SELECT source_host AS feed_id, COUNT(*) AS n, COUNT(*) FILTER (COALESCE(TRIM(summary), '') = '' OR COALESCE(TRIM(content), '') = '') AS poor, COUNT(DISTINCT CASE WHEN COALESCE(TRIM(author), '') <> '' THEN author END) AS authors FROM articles GROUP BY 1),
f AS (SELECT DISTINCT feed_id FROM removed_failed_feeds WHERE validation_status NOT LIKE 'OK%')
SELECT a.feed_id, n, poor, authors, ROUND(poor * 1.0 / NULLIF(n, 0), 6) AS poor_share, f.feed_id IS NOT NULL AS technical_failure FROM a LEFT JOIN f USING (feed_id) WHERE n >= 20 AND poor * 1.0 / n >= 0.1""")
def feed_quality(spark: SparkSession, d: str) -> DataFrame:
    """Feeds a notable share of whose articles lack text: filtered ratio with a guard against division by zero."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    a = read(spark, d, "articles").groupBy(F.col("source_host").alias("feed_id")).agg(F.count("*").alias("n"), F.count_if(blank("summary") | blank("content")).alias("poor"), F.count_distinct(F.when(~blank("author"), F.col("author"))).alias("authors"))
    f = read(spark, d, "removed_failed_feeds").filter(~F.col("validation_status").like("OK%")).select("feed_id").distinct().withColumn("technical_failure", F.lit(True))
    share = F.try_divide(F.col("poor").cast("double"), "n")
    return a.filter((F.col("n") >= 20) & (share >= 0.1)).withColumn("poor_share", F.round(share, 6)).join(f, "feed_id", "left").fillna(False, ["technical_failure"])


@C.add("SELECT DATE_TRUNC('hour', ts) AS hour, COUNT(*) AS n_events, COUNT(DISTINCT user_id) AS n_users, CAST(SUM(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) AS total_value FROM events GROUP BY 1")
def hourly_series(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour."""
    return read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total_value"))


@C.add(f"""
SELECT event_type AS operation, UPPER(SPLIT_PART(CONCAT('prov', CAST(user_id % 7 AS VARCHAR), '/x'), '/', 1)) AS provider, COALESCE(json_extract_string(props, '$.k'), '-') AS level, COUNT(*) AS n, COUNT(*) FILTER (event_type = 'error') AS failed, {mean6_sql("value")} AS avg_latency, COALESCE(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)), 0)::BIGINT AS tokens
FROM events WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' GROUP BY 1, 2, 3""")
def usage_by_operation(spark: SparkSession, d: str) -> DataFrame:
    """Usage per operation, provider and JSON level over an open window."""
    e = read(spark, d, "events").filter(F.col("ts") >= ts("2024-01-29 00:00:00")).withColumn("k", F.get_json_object("props", "$.k"))
    provider = F.upper(F.split_part(F.concat_ws("", F.lit("prov"), F.pmod("user_id", F.lit(7)).cast("string"), F.lit("/x")), F.lit("/"), F.lit(1)))
    return e.groupBy(F.col("event_type").alias("operation"), provider.alias("provider"), F.coalesce("k", F.lit("-")).alias("level")).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), mean6(F.col("value")).alias("avg_latency"), F.coalesce(F.sum(F.col("k").try_cast("long")), F.lit(0)).alias("tokens"))


@C.add(f"""
SELECT user_id % 7 AS provider, COUNT(*) AS requests, CAST(COALESCE(SUM(CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END), 0) AS BIGINT) AS tokens, COUNT(*) >= 0.95 * 40 AS over_requests
FROM events WHERE ts > TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{AS_OF_EVENTS}' GROUP BY 1""")
def rolling_quota(spark: SparkSession, d: str) -> DataFrame:
    """Requests and tokens of the last 24 hours against a quota."""
    e = read(spark, d, "events").filter((F.col("ts") > ago(AS_OF_EVENTS, "24 HOUR")) & (F.col("ts") <= ts(AS_OF_EVENTS)))
    return e.groupBy(F.pmod("user_id", F.lit(7)).alias("provider")).agg(F.count("*").alias("requests"), F.coalesce(F.sum(F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").try_cast("long"))), F.lit(0)).alias("tokens"), (F.count("*") >= 0.95 * 40).alias("over_requests"))


@C.add("SELECT user_id, TIME_BUCKET(INTERVAL 60 MINUTE, ts) AS window_start, COUNT(*) AS n, COUNT(*) > 2 AS limited FROM events GROUP BY 1, 2")
def fixed_window_limit(spark: SparkSession, d: str) -> DataFrame:
    """Requests per client and fixed window, and whether they pass the limit."""
    e = read(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.window("t", "60 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", (F.col("n") > 2).alias("limited"))


@C.add("""
WITH s AS (SELECT cluster_id, COALESCE(category_slug, '-') AS category_slug, latest_published_at, ROW_NUMBER() OVER (PARTITION BY COALESCE(category_slug, '-') ORDER BY latest_published_at DESC NULLS LAST, cluster_id) AS fair_rank FROM story_clusters)
SELECT cluster_id, category_slug, fair_rank, ROW_NUMBER() OVER (ORDER BY fair_rank, latest_published_at DESC NULLS LAST, cluster_id) AS turn FROM s ORDER BY turn LIMIT 200""")
def fair_interleave(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 turns of fair scheduling: rank within the category first, then recency."""
    own = Window.partitionBy("category_slug").orderBy(F.desc_nulls_last("latest_published_at"), "cluster_id")
    s = read(spark, d, "story_clusters").select("cluster_id", F.coalesce("category_slug", F.lit("-")).alias("category_slug"), "latest_published_at").withColumn("fair_rank", F.row_number().over(own).cast("long")).filter("fair_rank <= 200")  # no later rank can be among the first 200 turns
    first = s.orderBy("fair_rank", F.desc_nulls_last("latest_published_at"), "cluster_id").limit(200)
    turn = Window.orderBy("fair_rank", F.desc_nulls_last("latest_published_at"), "cluster_id")  # over the 200 rows left
    return first.select("cluster_id", "category_slug", "fair_rank", F.row_number().over(turn).cast("long").alias("turn"))


@C.add("SELECT DISTINCT ON (category_slug) category_slug, cluster_id, title, updated_at FROM story_clusters WHERE category_slug IS NOT NULL ORDER BY category_slug, updated_at DESC NULLS LAST, cluster_id")
def latest_per_category(spark: SparkSession, d: str) -> DataFrame:
    """The story of each category that was updated last."""
    c = read(spark, d, "story_clusters").filter("category_slug is not null")
    best = F.max_by(F.struct("cluster_id", "title", "updated_at"), F.struct(F.coalesce("updated_at", ts("0001-01-01 00:00:00")), -F.col("cluster_id"))).alias("b")
    return c.groupBy("category_slug").agg(best).select("category_slug", "b.*")


@C.add("SELECT left_category_slug, right_category_slug, decision, adjudication_id, created_at FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY left_category_slug, right_category_slug, decision ORDER BY created_at DESC NULLS LAST, adjudication_id DESC) AS r FROM cross_category_cluster_adjudications) WHERE r = 1")
def latest_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The last verdict per pair of categories and decision."""
    w = Window.partitionBy("left_category_slug", "right_category_slug", "decision").orderBy(F.desc_nulls_last("created_at"), F.desc("adjudication_id"))
    return read(spark, d, "cross_category_cluster_adjudications").withColumn("r", F.row_number().over(w)).filter("r = 1").select("left_category_slug", "right_category_slug", "decision", "adjudication_id", "created_at")


@C.add("""
SELECT kind, label, id, happened_at FROM (
 SELECT 'story' AS kind, COALESCE(category_slug, '-') AS label, cluster_id AS id, created_at AS happened_at FROM story_clusters
 UNION ALL SELECT 'member', role, article_id, added_at FROM cluster_articles
 UNION ALL SELECT 'verdict', decision, adjudication_id, created_at FROM cross_category_cluster_adjudications
 UNION ALL SELECT 'embedding', embedding_model, article_id, created_at FROM article_embeddings) t
WHERE happened_at IS NOT NULL ORDER BY happened_at DESC, kind, id, label LIMIT 50""")
def activity_timeline(spark: SparkSession, d: str) -> DataFrame:
    """The last 50 events of four feeds."""
    def part(table, kind, label, id_, at):
        return read(spark, d, table).select(F.lit(kind).alias("kind"), label.alias("label"), F.col(id_).alias("id"), F.col(at).alias("happened_at"))

    parts = [part("story_clusters", "story", F.coalesce("category_slug", F.lit("-")), "cluster_id", "created_at"), part("cluster_articles", "member", F.col("role"), "article_id", "added_at"),
             part("cross_category_cluster_adjudications", "verdict", F.col("decision"), "adjudication_id", "created_at"), part("article_embeddings", "embedding", F.col("embedding_model"), "article_id", "created_at")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("happened_at is not null").orderBy(F.desc("happened_at"), "kind", "id", "label").limit(50)


@C.add("""
SELECT (SELECT COUNT(*) FROM articles) AS articles, (SELECT COUNT(DISTINCT source_host) FROM articles) AS hosts, (SELECT COUNT(*) FROM story_clusters) AS stories, (SELECT COUNT(DISTINCT article_id) FROM cluster_articles) AS clustered,
 (SELECT COUNT(*) FROM articles a WHERE NOT EXISTS (SELECT 1 FROM cluster_articles m WHERE m.article_id = a.article_id)) AS unclustered, (SELECT COUNT(*) FROM cross_category_cluster_adjudications WHERE decision = 'same_story') AS same_story""")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    """One row of totals, each from its own one-row aggregate."""
    a, m = read(spark, d, "articles"), read(spark, d, "cluster_articles")
    parts = [a.agg(F.count("*").alias("articles"), F.countDistinct("source_host").alias("hosts")), read(spark, d, "story_clusters").agg(F.count("*").alias("stories")), m.agg(F.countDistinct("article_id").alias("clustered")),
             a.join(m, "article_id", "left_anti").agg(F.count("*").alias("unclustered")), read(spark, d, "cross_category_cluster_adjudications").agg(F.count_if(F.col("decision") == "same_story").alias("same_story"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


@C.add("SELECT cluster_id, title, category_slug, page, n_pages FROM (SELECT cluster_id, title, category_slug, ROW_NUMBER() OVER (ORDER BY latest_published_at DESC NULLS LAST, cluster_id) AS rn, CAST(CEIL(COUNT(*) OVER () / 20.0) AS BIGINT) AS n_pages FROM story_clusters) t, (SELECT 2 AS page) p WHERE rn BETWEEN 21 AND 40")
def story_page(spark: SparkSession, d: str, page: int = 2, size: int = 20) -> DataFrame:
    """One page of the story list with the number of pages; a page beyond the last is clamped to it."""
    c = read(spark, d, "story_clusters").select("cluster_id", "title", "category_slug", "latest_published_at")
    n_pages = max(1, -(-c.count() // size))
    page = min(max(1, page), n_pages)
    rows = c.orderBy(F.desc_nulls_last("latest_published_at"), "cluster_id").limit(page * size).offset((page - 1) * size)
    return rows.select("cluster_id", "title", "category_slug", F.lit(page).alias("page"), F.lit(n_pages).cast("long").alias("n_pages"))


@C.add("""
SELECT event_id, user_id, ts, (SELECT MAX(e2.ts) FROM events e2 WHERE e2.user_id = e.user_id AND e2.event_type = 'click' AND e2.ts < e.ts) AS last_click FROM events e WHERE event_type = 'purchase'""")
def latest_before(spark: SparkSession, d: str) -> DataFrame:
    """As-of: the user's last click strictly before each purchase, by one window over the user's events."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    e = read(spark, d, "events").filter(F.col("event_type").isin("click", "purchase")).withColumn("us", us).withColumn("last_click", F.max(F.when(F.col("event_type") == "click", F.col("ts"))).over(w))
    return e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "last_click")


QUERIES, ORACLE = C.queries, C.oracle
