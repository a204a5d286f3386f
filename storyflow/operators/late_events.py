"""Per-period aggregates by event time, corrected as late records arrive (lambda views).

The fast layer adds increments to provisional periods as records arrive. A scheduled batch
recomputes every open period from the full log, replaces the provisional value and freezes
periods past the lateness cut-off. All layers are small Parquet tables in the shared folder.

The two layers never count a record twice: arrival time is cut into slots, increments are kept per slot, and a batch
covers whole slots up to its bound. It absorbs the increments before the bound, whose tables
are then dropped, and a reader adds those after it. Frozen periods are written once and never again; a
batch reads only the part of the log whose periods were still open at the batch before.

Defined results: records without both instants are ignored; records seen before their stated time
count as prompt; records beyond the cut-off never change a period; an empty log gives empty views.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_text, remove_path, scratch_path, write_text

HOUR_MS = 3_600_000
_INCREMENT = "key string, period long, slot long, n long, latest_ms long"
_BATCH = "key string, period long, n long, prompt_n long, latest_ms long"


def arrivals(log: DataFrame, event_ms: str, seen_ms: str, prompt_h: int = 2, cutoff_h: int = 72, period_ms: int = HOUR_MS) -> DataFrame:
    """The log with ``period`` (number since 1970), ``lag_ms`` after its end, ``prompt`` and ``accepted``."""
    period = F.floor(F.col(event_ms) / F.lit(period_ms)).cast("long")
    lag = F.col(seen_ms) - (period + 1) * period_ms
    return log.filter(F.col(event_ms).isNotNull() & F.col(seen_ms).isNotNull()).withColumns({"period": period, "lag_ms": lag, "prompt": lag <= prompt_h * HOUR_MS, "accepted": lag <= cutoff_h * HOUR_MS})


class LambdaViews:
    """Counts and latest event per (key, period), in a fast, an open and a frozen layer.

    ``ingest`` appends increments (associative, so their order doesn't matter). ``recompute`` reads the log of the
    periods that are not frozen up to the last whole slot before ``as_of_ms``. Keys with a third of all rows are
    safe: both aggregates combine before the shuffle. A later run that names the same path goes on from its manifest.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, cutoff_h: int = 72, period_ms: int = HOUR_MS, slot_ms: int = HOUR_MS):
        self.spark, self.cutoff_ms, self.period_ms, self.slot_ms = spark, cutoff_h * HOUR_MS, period_ms, slot_ms
        self.path = path or scratch_path(spark, "lambda")
        kept = json.loads(read_text(spark, f"{self.path}/_manifest") or "{}")
        #: tables of increments with the last slot of each; tables of frozen periods; table of open ones; first slot no batch covers
        self.increments: dict[str, int] = kept.get("increments", {})
        self.frozen: list[str] = kept.get("frozen", [])
        self.open: str | None = kept.get("open")
        self.bound: int | None = kept.get("bound")

    def _save(self) -> None:
        state = {"increments": self.increments, "frozen": self.frozen, "open": self.open, "bound": self.bound}
        write_text(self.spark, f"{self.path}/_manifest", json.dumps(state))

    def ingest(self, arrived: DataFrame) -> None:
        """Fast layer: add the prompt records of one delivery (columns key, period, event_ms, seen_ms, prompt)."""
        part = scratch_path(self.spark, "lambda-fast")
        slot = F.floor(F.col("seen_ms") / self.slot_ms).cast("long").alias("slot")
        arrived.filter("prompt").groupBy("key", "period", slot).agg(F.count("*").alias("n"), F.max("event_ms").alias("latest_ms")).write.parquet(part)
        last = self.spark.read.schema(_INCREMENT).parquet(part).agg(F.max("slot")).first()[0]
        if last is not None:
            self.increments[part] = last
            self._save()

    def _first_open(self, bound: int) -> int:
        """The first period that a batch up to the slot ``bound`` leaves open: its end plus the cut-off is not before the bound."""
        return -((self.cutoff_ms - bound * self.slot_ms) // self.period_ms) - 1

    def recompute(self, log: DataFrame, as_of_ms: int) -> None:
        """Batch layer: replace every open period by its value from the full log, freeze those past the cut-off."""
        bound = as_of_ms // self.slot_ms
        if self.bound is not None and bound < self.bound:
            raise ValueError("a batch can't end before the one before it")
        seen = log.filter(F.col("accepted") & (F.col("seen_ms") < F.lit(bound * self.slot_ms)))
        if self.bound is not None:
            seen = seen.filter(F.col("period") >= self._first_open(self.bound))
        values = seen.groupBy("key", "period").agg(F.count("*").alias("n"), F.count_if("prompt").alias("prompt_n"), F.max("event_ms").alias("latest_ms"))
        path = f"{self.path}/batch/run=r{uuid.uuid4().hex[:12]}"
        done = (F.col("period") < self._first_open(bound)).alias("done")
        values.select("*", done).write.partitionBy("done").parquet(path)
        # one file tree, two layers: frozen periods stay for good, open ones until the next batch
        before, self.open, self.bound = self.open, path, bound
        self.frozen.append(path)
        absorbed = [p for p, last in self.increments.items() if last < bound]
        self.increments = {p: last for p, last in self.increments.items() if last >= bound}
        self._save()
        for p in absorbed + ([f"{before}/done=false"] if before else []):
            remove_path(self.spark, p)

    def _layer(self, paths: list[str], done: bool) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], _BATCH)
        rows = self.spark.read.schema(_BATCH + ", run string, done boolean").option("basePath", f"{self.path}/batch").parquet(*paths)
        return rows.filter(F.col("done") == F.lit(done)).drop("run", "done")

    def serve(self) -> DataFrame:
        """Current value per (key, period): frozen ones, and open ones with the increments the last batch has not absorbed.

        ``provisional_n`` is what prompt records alone give.
        """
        increments = self.spark.createDataFrame([], _INCREMENT) if not self.increments else self.spark.read.schema(_INCREMENT).parquet(*self.increments)
        fast = increments
        if self.bound is not None:
            # a record of a frozen period that is seen now is beyond its cut-off
            fast = fast.filter((F.col("slot") >= self.bound) & (F.col("period") >= self._first_open(self.bound)))
        fast = fast.select("key", "period", "n", F.col("n").alias("prompt_n"), "latest_ms")
        current = self._layer([self.open] if self.open else [], False).unionByName(fast)
        current = current.groupBy("key", "period").agg(F.sum("n").alias("n"), F.sum("prompt_n").alias("prompt_n"), F.max("latest_ms").alias("latest_ms"))
        both = current.withColumn("frozen", F.lit(False)).unionByName(self._layer(self.frozen, True).withColumn("frozen", F.lit(True)))
        return both.select("key", "period", "n", "latest_ms", F.col("prompt_n").alias("provisional_n"), "frozen")

    def corrected(self) -> DataFrame:
        """Periods whose value differs from what prompt records alone give."""
        return self.serve().filter("n != provisional_n")
