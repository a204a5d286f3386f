"""Queries that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snapshots import SnapshotTable
from ..session import scratch_path
from ..streaming.ingest import file_stream, run_into, windowed_counts
from .common import Catalogue

C = Catalogue()


@C.add("SELECT TIME_BUCKET(INTERVAL 1 HOUR, ts) AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def streamed_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of a file stream, upserted per micro-batch into a versioned table: equal to the batch answer."""
    counts = windowed_counts(file_stream(spark, d, "events.parquet"), "ts", "1 hour", ["event_type"])
    table = SnapshotTable(spark, scratch_path(spark, "hourly"))
    q = run_into(counts, table, ["window_start", "event_type"], [F.desc("n")], scratch_path(spark, "stream"), mode="update")
    q.awaitTermination()
    return table.read().withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@C.add("""WITH m AS (SELECT MAX(ts) - INTERVAL 2 DAY AS bound FROM events WHERE user_id % 10 <> 0)
SELECT TIME_BUCKET(INTERVAL 1 HOUR, ts) AS window_start, event_type, COUNT(*) AS n FROM events, m WHERE user_id % 10 <> 0 OR TIME_BUCKET(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR > bound GROUP BY 1, 2""")
def streamed_late(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of a stream whose second delivery is late: within two days of the newest event it counts, beyond it is dropped."""
    folder, checkpoint = scratch_path(spark, "late"), scratch_path(spark, "stream")
    events = spark.read.parquet(f"{d}/events.parquet").select("ts", "event_type", "user_id")
    table = SnapshotTable(spark, scratch_path(spark, "late-hourly"))
    for part in ("user_id % 10 <> 0", "user_id % 10 = 0"):  # two deliveries; the stream goes on from its checkpoint
        events.filter(part).write.mode("append").parquet(folder)
        counts = windowed_counts(spark.readStream.schema(events.schema).parquet(folder), "ts", "1 hour", ["event_type"], "2 days")
        run_into(counts, table, ["window_start", "event_type"], [F.desc("n")], checkpoint, mode="update").awaitTermination()
    return table.read().withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


QUERIES, ORACLE = C.queries, C.oracle
