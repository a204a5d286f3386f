"""Queries over sources and sinks: feeds, seeds, images, model answers, messages, stateful streams.

Bodies, answers and statuses come from functions of the rows themselves, so every result can be told by SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..functions.urls import url_safety
from ..operators.model_calls import ask, ask_structured, cached_results, input_hash  # noqa: F401
from ..operators.snapshots import SnapshotTable, full_sync
from ..session import materialize, scratch_path, write_text
from ..sources.feeds import deliver, feed_source, feeds_due, parse_feeds, read_feed_seed, read_taxonomy
from ..sources.images import best_image, image_sizes
from ..streaming.ingest import admit, file_stream, normalise_items, run_into
from .common import AS_OF, Catalogue, ago, read, ts

C = Catalogue()


@C.add(f"""SELECT CAST(cluster_id AS VARCHAR) AS guid, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, 'https://stories.example/' || CAST(cluster_id AS VARCHAR) AS canonical_url, DATE_TRUNC('second', latest_published_at) AS published_at
FROM story_clusters WHERE trim(title) <> '' AND DATE_TRUNC('second', latest_published_at) BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND TIMESTAMP '{AS_OF}'""")
def feed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Stories written as RSS, RDF and Atom bodies of a hundred items, parsed, normalised and admitted by title and time."""
    c = read(spark, d, "story_clusters").filter("latest_published_at is not null").select("cluster_id", T.escape_xml(F.col("title")).alias("t"), F.col("latest_published_at").alias("at"), F.pmod("cluster_id", F.lit(3)).alias("kind"), F.floor(F.col("cluster_id") / 100).alias("part"))
    url = F.concat(F.lit("https://stories.example/"), F.col("cluster_id").cast("string"))
    rfc = F.concat(F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    iso = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    guid = F.col("cluster_id").cast("string")
    rss = F.concat(F.lit("<item><guid>"), guid, F.lit("</guid><title>"), "t", F.lit("</title><link>"), url, F.lit("</link><pubDate>"), rfc, F.lit("</pubDate></item>"))
    rdf = F.concat(F.lit("<item><guid>"), guid, F.lit("</guid><title>"), "t", F.lit("</title><link>"), url, F.lit("</link><dc:date>"), iso, F.lit("</dc:date></item>"))
    atom = F.concat(F.lit("<entry><id>"), guid, F.lit("</id><title>"), "t", F.lit('</title><link href="'), url, F.lit('"/><updated>'), iso, F.lit("</updated></entry>"))
    item = F.when(F.col("kind") == 0, rss).when(F.col("kind") == 1, rdf).otherwise(atom)
    bodies = c.select("kind", "part", item.alias("i")).groupBy("kind", "part").agg(F.concat_ws("", F.collect_list("i")).alias("items"))
    wrap = lambda a, b: F.concat(F.lit(a), F.col("items"), F.lit(b))
    body = F.when(F.col("kind") == 0, wrap("﻿<rss version=\"2.0\"><channel>", "</channel></rss>")).when(F.col("kind") == 1, wrap('<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><channel/>', "</rdf:RDF>")).otherwise(wrap('<feed xmlns="http://www.w3.org/2005/Atom">', "</feed>"))
    items = normalise_items(parse_feeds(materialize(bodies.select(body.alias("body")), "bodies")))
    good = admit(items.withColumn("published_at", F.col("published_at").cast("timestamp_ntz")), ago(AS_OF, "30 DAY"), ts(AS_OF))
    return good.select("guid", "title", "canonical_url", "published_at")


def _fetch(url: str, most: int, timeout: int) -> bytes:
    """A stand-in for the network: plain addresses fail, the others have an item per four characters."""
    if not url.startswith("https://"):
        raise ConnectionError("refused")
    items = "".join(f"<item><guid>{i}</guid><title>item {i}</title></item>" for i in range(1 + len(url) // 4))
    return f'﻿<rss version="2.0"><channel>{items}</channel></rss>'.encode()[:most]


@C.add("SELECT feed_id, CASE WHEN MIN(url) LIKE 'https://%' THEN 1 + length(MIN(url)) // 4 ELSE 0 END AS n_items, MIN(url) NOT LIKE 'https://%' AS failed FROM removed_failed_feeds WHERE url IS NOT NULL GROUP BY 1")
def fetched_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Every feed of the list fetched by a data source, eight at a time; a failed fetch is a row with its error."""
    feeds = read(spark, d, "removed_failed_feeds").filter("url is not null").groupBy("feed_id").agg(F.min("url").alias("url")).collect()  # the feed list
    spark.dataSource.register(feed_source([(r["feed_id"], r["url"]) for r in feeds], _fetch))
    got = materialize(spark.read.format("feeds").load(), "fetched")
    n = parse_feeds(got.filter("body is not null").select("feed_id", "body")).groupBy("feed_id").agg(F.count("*").alias("n_items"))
    return got.select("feed_id", F.col("error").isNotNull().alias("failed")).join(n, "feed_id", "left").fillna(0, ["n_items"])


@C.add("""WITH f AS (SELECT feed_id, MIN(validation_status) LIKE 'OK%' AS enabled FROM removed_failed_feeds GROUP BY 1), l AS (SELECT source_host, MAX(article_id) AS last FROM articles GROUP BY 1)
SELECT feed_id, last AS last_fetched_at FROM f LEFT JOIN l ON source_host = feed_id WHERE enabled ORDER BY last NULLS FIRST, feed_id LIMIT 50""")
def due_feeds(spark: SparkSession, d: str) -> DataFrame:
    """The next 50 enabled feeds, those never or longest not delivered first."""
    f = read(spark, d, "removed_failed_feeds").groupBy("feed_id").agg(F.min("validation_status").alias("s"))
    last = read(spark, d, "articles").groupBy(F.col("source_host").alias("feed_id")).agg(F.max("article_id").alias("last_fetched_at"))
    return feeds_due(f.select("feed_id", F.coalesce(F.col("s").like("OK%"), F.lit(False)).alias("enabled")).join(last, "feed_id", "left"), 50).select("feed_id", "last_fetched_at")


@C.add("SELECT DISTINCT feed_id, 'A \"' || COALESCE(name, '') || '\", ' || chr(10) || 'x' AS name, NULLIF(url, '') AS url FROM removed_failed_feeds")
def feed_seed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Feeds written as CSV with quotes, commas and line breaks in fields, and read back as a seed."""
    path = scratch_path(spark, "seed")
    name = F.concat(F.lit('A "'), F.coalesce("name", F.lit("")), F.lit('", \nx'))
    read(spark, d, "removed_failed_feeds").select("feed_id", name.alias("name"), "url").distinct().write.option("header", True).option("escape", '"').csv(path)
    return read_feed_seed(spark, path).select("feed_id", "name", "url")


@C.add("""WITH n AS (SELECT category_slug AS slug, ROW_NUMBER() OVER (ORDER BY category_slug) - 1 AS sort_order FROM (SELECT DISTINCT category_slug FROM story_clusters WHERE category_slug IS NOT NULL)),
o AS (SELECT slug, sort_order + 1 AS sort_order, sort_order % 2 = 0 AS active FROM n WHERE sort_order % 3 <> 0 UNION ALL SELECT 'retired-topic', 99, true)
SELECT COALESCE(n.slug, o.slug) AS slug, n.sort_order, CASE WHEN o.slug IS NULL THEN 'insert' WHEN n.slug IS NULL THEN 'delete' WHEN NOT o.active THEN 'reactivate' WHEN n.sort_order <> o.sort_order THEN 'update' ELSE 'keep' END AS action FROM n FULL JOIN o ON o.slug = n.slug""")
def taxonomy_sync(spark: SparkSession, d: str) -> DataFrame:
    """A JSON taxonomy (its order is the sort order) synchronised with a table: inserted, updated, active again, deleted."""
    slugs = sorted(r[0] for r in read(spark, d, "story_clusters").filter("category_slug is not null").select("category_slug").distinct().collect())  # a taxonomy
    path = scratch_path(spark, "taxonomy")
    write_text(spark, f"{path}.json", "[" + ",\n".join(f'{{"slug": "{s}", "name": "{s}"}}' for s in slugs) + "]")
    new = read_taxonomy(spark, f"{path}.json").select("slug", F.col("sort_order").cast("long").alias("sort_order"), "active")
    old = new.filter("sort_order % 3 <> 0").select("slug", (F.col("sort_order") + 1).alias("sort_order"), (F.col("sort_order") % 2 == 0).alias("active"))
    old = old.unionByName(spark.createDataFrame([("retired-topic", 99, True)], "slug string, sort_order long, active boolean"))
    state = old.select("slug", F.col("active").alias("was"))
    both = full_sync(old, new, ["slug"], ["sort_order", "active"]).join(state, "slug", "left")
    action = F.when((F.col("action") == "update") & (F.col("was") == F.lit(False)), "reactivate").otherwise(F.col("action"))
    return both.select("slug", F.when(F.col("action") != "delete", F.col("sort_order")).alias("sort_order"), action.alias("action"))


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@C.add("SELECT cluster_id, CASE WHEN cluster_id % 2 = 0 THEN [-1.0, 0.0] ELSE [CAST(length(title) AS DOUBLE), CAST(length(title) - length(replace(title, 'e', '')) AS DOUBLE)] END AS result FROM story_clusters WHERE title IS NOT NULL AND NOT EXISTS (SELECT 1 FROM story_clusters o WHERE o.title = story_clusters.title AND o.cluster_id % 2 <> story_clusters.cluster_id % 2)")
def cached_model_calls(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of story titles: from a cache by the hash of model and input where it has one, else asked in batches, in order."""
    c = read(spark, d, "story_clusters").filter("title is not null").select("cluster_id", "title")
    sides = c.groupBy("title").agg(F.countDistinct(F.pmod("cluster_id", F.lit(2))).alias("sides")).filter("sides = 1")
    c = c.join(sides.drop("sides"), "title")
    cache = c.filter("cluster_id % 2 = 0").select(input_hash("m", F.col("title")).alias("input_hash"), F.array(F.lit(-1.0), F.lit(0.0)).alias("result")).distinct()
    return cached_results(c, "title", cache, "m", _lengths).select("cluster_id", "result")


def _judge(texts: list[str]) -> list[str | None]:
    """A stand-in for a model: in a batch it breaks every text of a length divisible by 3, alone only those divisible by 9."""
    bad = 9 if len(texts) == 1 else 3
    return ["sorry, no" if len(t) % bad == 0 else f'Here: {{"words": {len(t.split(" "))}, "long": {str(len(t) > 60).lower()}}} done' for t in texts]


@C.add("""WITH t AS (SELECT cluster_id, title || ' (' || CAST(cluster_id AS VARCHAR) || ')' AS t FROM story_clusters WHERE title IS NOT NULL)
SELECT cluster_id, CASE WHEN length(t) % 9 <> 0 THEN '{"long": ' || CASE WHEN length(t) > 60 THEN 'true' ELSE 'false' END || ', "words": ' || CAST(len(string_split(t, ' ')) AS VARCHAR) || '}' END AS answer, length(t) % 9 = 0 AS failed FROM t""")
def structured_answers(spark: SparkSession, d: str) -> DataFrame:
    """Model answers checked against a schema: what a batch breaks is asked again alone, what stays broken is reported."""
    c = read(spark, d, "story_clusters").filter("title is not null").select("cluster_id", F.concat("title", F.lit(" ("), F.col("cluster_id").cast("string"), F.lit(")")).alias("t"))
    return ask_structured(c, "cluster_id", "t", _judge, {"words": int, "long": bool}).select("cluster_id", "answer", F.col("error").isNotNull().alias("failed"))


def _send(text: str) -> int:
    """A stand-in for a receiver, by the last digit of the message."""
    last = text[-1]
    if last == "7":
        raise TimeoutError("slow")
    return 503 if last == "3" else 400 if last == "5" else 200


@C.add("SELECT cluster_id, CASE cluster_id % 10 WHEN 3 THEN 503 WHEN 5 THEN 400 WHEN 7 THEN NULL ELSE 200 END AS status, CASE WHEN cluster_id % 10 IN (3, 7) THEN 3 ELSE 1 END AS attempts, CASE WHEN cluster_id % 10 = 7 THEN 'TimeoutError: slow' END AS error FROM story_clusters")
def delivered_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages sent to a receiver with what came of each: status, attempts, error."""
    return deliver(read(spark, d, "story_clusters").select("cluster_id", F.concat(F.lit("story "), F.col("cluster_id").cast("string")).alias("body")), "cluster_id", "body", _send)


@C.add("SELECT CAST(article_id AS VARCHAR) AS path, CASE WHEN article_id % 2 = 0 THEN 'png' ELSE 'gif' END AS format, 1 + article_id % 4000 AS width, 1 + article_id % 3000 AS height FROM articles WHERE article_id % 5 <> 4")
def image_headers(spark: SparkSession, d: str) -> DataFrame:
    """Dimensions from the first bytes of images; one in five is no image."""
    a = read(spark, d, "articles").select(F.col("article_id").cast("string").alias("path"), "article_id", (1 + F.col("article_id") % 4000).alias("w"), (1 + F.col("article_id") % 3000).alias("h"))
    big = lambda c: F.lpad(F.hex(c), 8, "0")
    little = lambda c: F.concat(F.substring(F.lpad(F.hex(c), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(c), 4, "0"), 1, 2))
    png = F.concat(F.lit("89504E470D0A1A0A" + "00" * 8), big("w"), big("h"))
    gif = F.concat(F.lit("474946383961"), little("w"), little("h"))
    raw = F.when(F.col("article_id") % 5 == 4, "6E6F").when(F.col("article_id") % 2 == 0, png).otherwise(gif)
    return image_sizes(a.select("path", F.unhex(raw).alias("content")))


@C.add("SELECT cluster_id, CASE WHEN cluster_id % 4 = 0 THEN NULL WHEN cluster_id % 3 = 0 THEN 'https://img.example/a' || CAST(cluster_id AS VARCHAR) || '.png' ELSE 'https://img.example/b.png' END AS image FROM story_clusters")
def best_images(spark: SparkSession, d: str) -> DataFrame:
    """The largest image of a piece of markup; data addresses don't count."""
    key = F.col("cluster_id").cast("string")
    markup = F.concat(F.lit("<p>x</p><img width='20' height=20 src=\"https://img.example/a"), key, F.lit('.png"><IMG src="https://img.example/b.png" width='), F.when(F.col("cluster_id") % 3 == 0, "10").otherwise("90"), F.lit(" height=10>"))
    markup = F.when(F.col("cluster_id") % 4 == 0, '<img src="data:image/png;base64,AA">').otherwise(markup)
    return read(spark, d, "story_clusters").select("cluster_id", best_image(markup).alias("image"))


@C.add("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events WHERE props IS NOT NULL")
def lenient_answers(spark: SparkSession, d: str) -> DataFrame:
    """A number out of JSON that is plain, wrapped in prose, or broken."""
    e = read(spark, d, "events").filter("props is not null")
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure, here it is: "), F.col("props"), F.lit(" - anything else?"))).otherwise(F.concat(F.lit("broken "), F.substring(F.col("props"), 2, 100)))
    return e.select("event_id", F.try_variant_get(T.lenient_json(text), "$.k", "bigint").alias("k"))


@C.add("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 60 WHEN 1 THEN (event_id % 3) * 3600.0 + 120 + event_id % 60 WHEN 2 THEN (event_id % 900 + 1) / 1000.0 END::DOUBLE AS wait_s FROM events")
def retry_waits(spark: SparkSession, d: str) -> DataFrame:
    """Seconds to wait, as answers of servers put them."""
    n = lambda m: F.pmod("event_id", F.lit(m)).cast("string")
    k = F.pmod("event_id", F.lit(4))
    text = F.when(k == 0, F.concat(F.lit("Retry-After: "), n(60))).when(k == 1, F.concat(F.lit("please try again in "), n(3), F.lit("h2m"), n(60), F.lit("s"))).when(k == 2, F.concat(F.lit("wait "), (F.pmod("event_id", F.lit(900)) + 1).cast("string"), F.lit("ms"))).otherwise("busy")
    return read(spark, d, "events").select("event_id", T.retry_seconds(text).alias("wait_s"))


@C.add("""WITH a AS (SELECT article_id, article_id * 7919 % 256 AS p, article_id * 104729 % 256 AS q FROM articles)
SELECT article_id, CASE WHEN article_id % 5 = 0 THEN 'credentials' WHEN article_id % 5 = 1 THEN 'scheme' WHEN p IN (0, 10, 127) OR p >= 224 OR (p = 100 AND q BETWEEN 64 AND 127) OR (p = 169 AND q = 254) OR (p = 172 AND q BETWEEN 16 AND 31) OR (p = 192 AND q IN (0, 168)) OR (p = 198 AND q IN (18, 19)) THEN 'host' ELSE 'ok' END AS safety FROM a""")
def address_safety(spark: SparkSession, d: str) -> DataFrame:
    """Whether numbered addresses may be fetched: scheme, credentials, ranges that are not public."""
    a = read(spark, d, "articles").select("article_id", (F.col("article_id") * 7919 % 256).alias("p"), (F.col("article_id") * 104729 % 256).alias("q"))
    host = F.concat(F.col("p").cast("string"), F.lit("."), F.col("q").cast("string"), F.lit(".0.9"))
    url = F.when(F.col("article_id") % 5 == 0, F.concat(F.lit("https://u:p@"), host)).when(F.col("article_id") % 5 == 1, F.concat(F.lit("http://"), host)).otherwise(F.concat(F.lit("https://"), host, F.lit(":8443/x")))
    return a.select("article_id", url_safety(url).alias("safety"))


@C.add("""SELECT feed_id, CAST(length(feed_id) AS DOUBLE) AS amount, length(feed_id) % 2 = 0 AS flag, [feed_id, 'b'] AS names, CASE WHEN length(feed_id) % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS limit_a FROM (SELECT DISTINCT feed_id FROM removed_failed_feeds)""")
def settings_as_text(spark: SparkSession, d: str) -> DataFrame:
    """Settings given as text: numbers, flags, lists and limits by name."""
    f = read(spark, d, "removed_failed_feeds").select("feed_id").distinct().withColumn("n", F.length("feed_id"))
    even = F.col("n") % 2 == 0
    limits = T.as_limits(F.concat(F.lit("a:1, b:x,"), F.when(even, "a:2").otherwise("c:3")))
    return f.select("feed_id", T.as_number(F.concat(F.lit(" "), F.col("n").cast("string")), 5).alias("amount"), T.as_flag(F.when(even, " Yes ").otherwise("off"), True).alias("flag"), T.as_list(F.concat(F.col("feed_id"), F.lit(" , ,b"))).alias("names"), F.try_element_at(limits, F.lit("a")).alias("limit_a"))


@C.add("WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, ROUND(((COALESCE(k, 0) - COALESCE(k, 0) // 2) * 3.0 + (COALESCE(k, 0) // 2) * 0.3 + event_id % 50 * 15.0) / 1000000, 9) AS cost FROM e")
def call_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cost of every call from its input, cached and output tokens, each at its own rate."""
    e = read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    half = F.floor(F.coalesce("k", F.lit(0)) / 2)
    return e.select("event_id", F.round(T.call_cost(F.col("k"), half, F.pmod("event_id", F.lit(50)), 3.0, 0.3, 15.0), 9).alias("cost"))


@C.add(r"""SELECT cluster_id, '{"a":"' || CAST(cluster_id AS VARCHAR) || '","b":["x\\u0000","y"]}' AS payload FROM story_clusters""")
def nul_free_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON without NUL characters at any depth; an escaped backslash before the same letters stays."""
    raw = F.concat(F.lit('{"a":"\\u0000'), F.col("cluster_id").cast("string"), F.lit('","b":["x\\\\u0000","\\u0000y"]}'))
    return read(spark, d, "story_clusters").select("cluster_id", T.strip_nul_json(raw).alias("payload"))


@C.add("SELECT job, status FROM (VALUES ('counts', 'ok'), ('broken', 'failed')) t(job, status)")
def run_log(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two jobs as a keyed table: running, then ok with its rows or failed with its error."""
    log = SnapshotTable(spark, scratch_path(spark, "runs"))
    jobs = {"counts": lambda: read(spark, d, "story_clusters").count(), "broken": lambda: 1 // 0}
    for name, job in jobs.items():
        row = lambda status, n, error: spark.createDataFrame([(name, status, n, error)], "job string, status string, n long, error string")  # noqa: B023, E731
        log.merge(row("running", None, None), ["job"], [(F.col("status") == "running").asc()])
        try:
            state = row("ok", job(), None)
        except Exception as e:
            state = row("failed", None, f"{type(e).__name__}: {e}")
        log.merge(state, ["job"], [(F.col("status") == "running").asc()])
    return log.read().select("job", "status")


# --- streams ---


@C.add("SELECT DISTINCT user_id, event_type, DATE_TRUNC('hour', ts) AS hour FROM events")
def streamed_distinct(spark: SparkSession, d: str) -> DataFrame:
    """A stream without the repeats of a key within the watermark."""
    s = file_stream(spark, d, "events.parquet").select("user_id", "event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"))
    s = s.withWatermark("hour", "40 days").dropDuplicatesWithinWatermark(["user_id", "event_type", "hour"])
    table = SnapshotTable(spark, scratch_path(spark, "distinct"))
    run_into(s, table, ["user_id", "event_type", "hour"], ["hour"], scratch_path(spark, "stream")).awaitTermination()
    return table.read().withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Failures since the last success, and runs and failures in all, of one feed; the records of a batch in order of time."""
    since, runs, failed, last = state.get if state.exists else (0, 0, 0, -1)
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["us", "event_id"])
    for us, bad in zip(rows.us, rows.bad):
        since, runs, failed, last = (since + 1 if bad else 0), runs + 1, failed + int(bad), max(last, us)
    state.update((since, runs, failed, last))
    yield pd.DataFrame({"user_id": [key[0]], "fail_count": [since], "runs": [runs], "failed": [failed]})


@C.add("""WITH e AS (SELECT user_id, event_type = 'error' AS bad, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), g AS (SELECT user_id, COUNT(*) AS runs, COUNT(*) FILTER (bad) AS failed, COALESCE(MAX(r) FILTER (NOT bad), 0) AS good FROM e GROUP BY 1)
SELECT user_id, runs - good AS fail_count, runs, failed FROM g""")
def streamed_fail_counts(spark: SparkSession, d: str) -> DataFrame:
    """Fetch accounting as a stateful stream: a success resets the count of failures, a failure adds to it."""
    s = file_stream(spark, d, "events.parquet").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_type") == "error").alias("bad"))
    out = "user_id long, fail_count long, runs long, failed long"
    folded = s.groupBy("user_id").applyInPandasWithState(_fold, out, "since long, runs long, failed long, last long", "update", GroupStateTimeout.NoTimeout)
    table = SnapshotTable(spark, scratch_path(spark, "fail-counts"))
    run_into(folded, table, ["user_id"], [F.desc("runs")], scratch_path(spark, "stream"), mode="update").awaitTermination()
    return table.read()


QUERIES, ORACLE = C.queries, C.oracle
