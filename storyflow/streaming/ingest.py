"""Structured Streaming: item ingestion, windowed counts and a keyed ledger.

All sinks are ``foreachBatch`` writers into versioned tables, so a replayed micro-batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import clean_text
from ..operators.snapshots import SnapshotTable
from ..session import materialize


def file_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """A Parquet table of a folder as a stream of its files, with the table's own schema."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{name}*")


#: Time zones RFC 822 names, as offsets.
RFC_ZONES = {"GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
_RFC = r"^\s*(?:[A-Za-z]{3,9}\.?,?\s+)?(\d{1,2})[\s-]+([A-Za-z]{3})[a-z]*[\s-]+(\d{2}|\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([A-Za-z]{1,3}|[+-]\d{2}:?\d{2})?\s*$"


def feed_time(c: Column) -> Column:
    """The instant a feed states, in ISO 8601 or as RFC 822 writes it: weekday, seconds and century may lack, no zone is UTC."""
    part = lambda i: F.regexp_extract(c, _RFC, i)
    zones = F.create_map(*[F.lit(x) for kv in RFC_ZONES.items() for x in kv])
    year = F.when(F.length(part(3)) == 4, part(3)).otherwise(F.concat(F.when(part(3) < "50", "20").otherwise("19"), part(3)))
    zone = F.when(part(7) == "", "+0000").when(part(7).rlike("^[+-]"), F.replace(part(7), F.lit(":"), F.lit(""))).otherwise(F.try_element_at(zones, F.upper(part(7))))
    seconds = F.when(part(6) == "", "00").otherwise(part(6))
    text = F.concat(year, F.lit(" "), F.initcap(F.lower(part(2))), F.lit(" "), F.lpad(part(1), 2, "0"), F.lit(" "), F.lpad(part(4), 2, "0"), F.lit(":"), part(5), F.lit(":"), seconds, F.lit(" "), zone)
    return F.when(c.rlike(_RFC), F.try_to_timestamp(F.coalesce(text, F.lit("x")), F.lit("yyyy MMM dd HH:mm:ss xx"))).otherwise(F.try_to_timestamp(F.coalesce(c, F.lit("x"))))


def normalise_items(items: DataFrame) -> DataFrame:
    """Feed items (guid, link, title, summary, content, author, published, updated: strings) as articles; '' becomes null."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    at = F.coalesce(*[feed_time(blank(c)) for c in ("published", "updated")])
    out = items.select(F.coalesce(blank("guid"), blank("link")).alias("guid"), blank("link").alias("canonical_url"), F.nullif(clean_text(F.col("title")), F.lit("")).alias("title"), blank("summary").alias("summary"), blank("content").alias("content"), blank("author").alias("author"), at.alias("published_at"))
    return out.withColumn("content_hash", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("guid", "canonical_url", "title", "published_at")]), 256))


def admit(articles: DataFrame, since, until) -> DataFrame:
    """Articles with title and time within [since, until]; future items are turned away."""
    return articles.filter(F.col("title").isNotNull() & F.col("published_at").between(F.lit(since), F.lit(until)))


def deduplicated(articles: DataFrame, delay: str = "7 days") -> DataFrame:
    """One article per content hash within the watermark."""
    return articles.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["content_hash"])


def run_into(stream: DataFrame, table: SnapshotTable, keys: list[str], order: list, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Upsert every micro-batch into a keyed table; ``availableNow`` drains what is there and stops."""

    def write(batch: DataFrame, _: int) -> None:
        batch = materialize(batch, "micro-batch")  # a stateful plan must run once per batch
        if not batch.isEmpty():
            table.merge(batch, keys, order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, window: str, by: list[str], delay: str = "2 hours") -> DataFrame:
    """Counts per window and ``by``, late events within ``delay`` included."""
    t = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay)
    g = t.groupBy(F.window("_t", window).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), *by, "n")
