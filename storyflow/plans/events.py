"""Queries of problems 1 and 2: late events and mixed timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.late_events import HOUR_MS, LambdaViews, arrivals
from ..operators.timestamps import CANONICAL, ntz_ms, resolve_instants
from ..session import materialize

FIELDS = ["published_at", "first_seen_at"]


def _instants(spark: SparkSession, d: str) -> DataFrame:
    articles = spark.read.parquet(f"{d}/articles.parquet").select("article_id", "source_host", *FIELDS)
    return resolve_instants(articles, spark.read.parquet(f"{d}/removed_failed_feeds.parquet"), FIELDS, ["article_id"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every value in another than the canonical form that fixes one instant, as UTC milliseconds."""
    return _instants(spark, d).filter("status = 'resolved' and utc_ms is not null").select("article_id", "field", "utc_ms").distinct()


def p2_status(spark: SparkSession, d: str) -> DataFrame:
    """Values per source, field and status, unresolved ambiguity included."""
    return _instants(spark, d).groupBy("source", "field", "status").agg(F.count("*").alias("n"))


#: ISO 8601 with a numeric offset or Z, in any precision: the forms SQL can read as well.
CLEAR = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})$"


def p2_clear(spark: SparkSession, d: str) -> DataFrame:
    """The values of ``p2_found`` whose text is ISO 8601 with its own offset."""
    a = spark.read.parquet(f"{d}/articles.parquet").select("article_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])))
    return p2_found(spark, d).join(a.filter(F.col("text").rlike(CLEAR)).select("article_id", "field"), ["article_id", "field"]).select("article_id", "field", "utc_ms")


_CLEAR_SQL = r"""
WITH v AS (SELECT article_id, 'published_at' AS field, published_at AS t FROM articles UNION ALL SELECT article_id, 'first_seen_at', first_seen_at FROM articles),
x AS (SELECT article_id, field, t, regexp_extract(t, '^(\d{4}-\d{2}-\d{2})[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(?:Z|([+-])(\d{2}):?(\d{2}))$', ['d', 'h', 'm', 's', 'f', 'sign', 'oh', 'om']) AS p FROM v
 WHERE regexp_full_match(t, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})') AND NOT regexp_full_match(t, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z')),
n AS (SELECT article_id, field, TRY_CAST(p.d AS DATE) AS day, p.h::INT AS h, p.m::INT AS m, COALESCE(TRY_CAST(p.s AS INT), 0) AS s, TRY_CAST(substr(rpad(p.f, 3, '0'), 1, 3) AS INT) AS ms, CASE WHEN p.sign = '-' THEN -1 ELSE 1 END * (COALESCE(TRY_CAST(p.oh AS INT), 0) * 60 + COALESCE(TRY_CAST(p.om AS INT), 0)) AS off FROM x)
SELECT DISTINCT article_id, field, CAST(((day - DATE '1970-01-01') * 86400 + h * 3600 + m * 60 + s - off * 60) AS BIGINT) * 1000 + COALESCE(ms, 0) AS utc_ms FROM n WHERE day IS NOT NULL AND h < 24 AND m < 60 AND s < 60"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    known = _instants(spark, d).filter("utc_ms is not null")
    r = known.groupBy("article_id", F.col("source").alias("source_host")).agg(*[F.max(F.when(F.col("field") == f, F.col("utc_ms"))).alias(m) for f, m in zip(FIELDS, ("event_ms", "seen_ms"))])
    return materialize(arrivals(r, "event_ms", "seen_ms"), "arrivals")


def _hour(period: str) -> F.Column:
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(period) / 24).cast("int"))
    return F.concat(day.cast("string"), F.lit("T"), F.lpad(F.pmod(F.col(period), F.lit(24)).cast("string"), 2, "0"))


#: Runs of the scheduled batch in the queries: the log is delivered in as many parts by time of arrival.
RUNS = 3


def _views(log: DataFrame) -> LambdaViews:
    """The log delivered in parts, with a batch after each: the last one leaves only what no batch has seen to the fast layer."""
    views = LambdaViews(log.sparkSession)
    first, last = log.agg(F.min("seen_ms"), F.max("seen_ms")).first()
    if first is None:
        return views
    ends = [first + (last - first) * (i + 1) // RUNS for i in range(RUNS - 1)] + [last + HOUR_MS]
    begin = None
    for end in ends:
        views.ingest(log.filter((F.col("seen_ms") <= end) & (F.col("seen_ms") > begin if begin is not None else F.lit(True))))
        views.recompute(log, end)
        begin = end
    return views


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Source hours that late articles corrected, and stories whose latest publication is wrong or missing."""
    log = _log(spark, d)
    by_source = _views(log.filter("source_host is not null").withColumn("key", F.col("source_host"))).corrected()
    sources = by_source.select(F.lit("source").alias("scope"), F.col("key").alias("scope_key"), _hour("period").alias("period_hour"))
    members = spark.read.parquet(f"{d}/cluster_articles.parquet").select("cluster_id", "article_id").distinct()
    member_log = log.join(members, "article_id").withColumn("key", F.col("cluster_id").cast("string"))
    latest = _views(member_log).serve().filter("n is not null").groupBy("key").agg(F.max("latest_ms").alias("latest_ms"))
    stories = spark.read.parquet(f"{d}/story_clusters.parquet").select(F.col("cluster_id").cast("string").alias("key"), ntz_ms(F.col("latest_published_at").cast("timestamp_ntz")).alias("stated_ms"))
    wrong = stories.join(latest, "key").filter("stated_ms is null or stated_ms != latest_ms")
    wrong = wrong.withColumn("period", F.floor(F.col("latest_ms") / HOUR_MS))
    wrong = wrong.select(F.lit("cluster").alias("scope"), F.col("key").alias("scope_key"), _hour("period").alias("period_hour"))
    return sources.unionByName(wrong).distinct()


def p1_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Corrected hourly counts per source: provisional, final, and whether the hour is frozen."""
    log = _log(spark, d).filter("source_host is not null").withColumn("key", F.col("source_host"))
    return _views(log).serve().select(F.col("key").alias("source_host"), _hour("period").alias("period_hour"), "provisional_n", "n", "frozen")


def p1_clear(spark: SparkSession, d: str) -> DataFrame:
    """Corrected hourly counts per source over the articles both of whose times are canonical already: what SQL can tell as well."""
    ms = lambda f: F.unix_millis(F.try_to_timestamp(F.col(f)))
    a = spark.read.parquet(f"{d}/articles.parquet").filter(F.col("source_host").isNotNull() & F.col("published_at").rlike(CANONICAL) & F.col("first_seen_at").rlike(CANONICAL))
    log = materialize(arrivals(a.select(F.col("source_host").alias("key"), ms("published_at").alias("event_ms"), ms("first_seen_at").alias("seen_ms")), "event_ms", "seen_ms"), "arrivals")
    return _views(log).serve().select(F.col("key").alias("source_host"), _hour("period").alias("period_hour"), "provisional_n", "n", "latest_ms")


_CLEAR_HOURS_SQL = r"""
WITH a AS (SELECT source_host, epoch_ms(try_strptime(published_at, '%Y-%m-%dT%H:%M:%S.%gZ')) AS e, epoch_ms(try_strptime(first_seen_at, '%Y-%m-%dT%H:%M:%S.%gZ')) AS s FROM articles
 WHERE source_host IS NOT NULL AND regexp_full_match(published_at, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z') AND regexp_full_match(first_seen_at, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z')),
l AS (SELECT source_host, e, e // 3600000 AS period, s - (e // 3600000 + 1) * 3600000 AS lag FROM a WHERE e IS NOT NULL AND s IS NOT NULL)
SELECT source_host, strftime(make_timestamp(period * 3600000000), '%Y-%m-%dT%H') AS period_hour, COUNT(*) FILTER (lag <= 2 * 3600000) AS provisional_n, COUNT(*) AS n, MAX(e) AS latest_ms FROM l WHERE lag <= 72 * 3600000 GROUP BY source_host, period"""

QUERIES = {"p1_clear": p1_clear, "p1_found": p1_found, "p1_hourly": p1_hourly, "p2_found": p2_found, "p2_clear": p2_clear, "p2_status": p2_status}
ORACLE = {"p1_clear": _CLEAR_HOURS_SQL, "p2_clear": _CLEAR_SQL}
