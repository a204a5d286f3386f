"""New batches checked against all accepted history by winnowed content fingerprints.

A record's content is winnowed: of the hashes of all its grams (substrings of a key, five-word shingles of a text) the least
of every window is kept, so equal contents have equal fingerprints and every long enough shared stretch shares at
least one. Partitioned Bloom filters over the fingerprints of the history prescreen a batch; only contents enough of whose
fingerprints may be known are looked up in the persistent store, where the shared coverage is verified. Then the
new contents are added to the store and to the filters.

Full coverage (``coverage=1``): the whole set of fingerprints must agree (least fingerprint, number and checksum), and
128 bits of digest confirm the content itself. Below it: candidates share one of the rarest fingerprints, rarest
as measured in the store, of which so many are asked that no content with enough coverage is missed; then all fingerprints of
both sides are compared. Contents of one delivery are compared with one another in the same way, the earlier ones first.

The store is partitioned by fingerprint, its records by digest. A batch reads and rewrites only the partitions its
positives fall into, whatever the length of the history; earlier texts are never read again. Equal contents are one row before any
shuffle by content. Partitions of the filters are cut into blocks where many fingerprints ask the same one.

Defined results: null contents and such without a gram are not matched; an id is never matched with itself;
an empty batch changes nothing; the first of several earlier records is the one with the least (batch, id).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import once, words
from ..session import materialize, read_text, remove_path, scratch_path, write_text

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    return x ^ (x >> np.uint64(32))


def winnow(texts: pd.Series, gram: int = 12, window: int = 24) -> list[np.ndarray]:
    """Winnowed fingerprints of each text, as sorted distinct signed 64-bit numbers.

    All texts are hashed in one pass over the concatenated bytes; a text shorter than ``gram`` is one gram.
    """
    raw = [t.encode("utf-8") for t in texts]
    if not raw:
        return []
    pad = gram + window
    joined = np.frombuffer(b"".join(r + b"\x00" * pad for r in raw), dtype=np.uint8).astype(np.uint64)
    h = np.zeros(len(joined) - gram + 1, dtype=np.uint64)
    for i in range(gram):
        h = h * np.uint64(1099511628211) + joined[i : len(joined) - gram + 1 + i]
    h = _mix(h)
    out, at = [], 0
    for r in raw:
        n = max(1, len(r) - gram + 1)
        own = h[at : at + n]
        if n <= window:
            out.append(np.array([own.min()], dtype=np.uint64).view(np.int64))
        else:
            views = np.lib.stride_tricks.sliding_window_view(own, window)
            out.append(np.unique(views.min(axis=1)).view(np.int64))
        at += len(r) + pad
    return out


def key_prints(rows: DataFrame) -> DataFrame:
    """(batch, id, h1, h2, fps) of (batch, id, key): winnowed substrings of the key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="key").assign(fps=winnow(pdf.key))

    rows = rows.filter("key is not null").select("batch", "id", *_digests(F.col("key")), "key")
    return rows.mapInPandas(run, "batch int, id long, h1 long, h2 long, fps array<long>")


def text_prints(rows: DataFrame, gram: int = 5, window: int = 4) -> DataFrame:
    """(batch, id, h1, h2, fps) of (batch, id, text): winnowed shingles of ``gram`` words, hashed by the first 60 bits of their MD5.

    A text of fewer words is one shingle; one without words gives no row.
    """
    w = words(F.col("text"))
    n = F.greatest(F.size("w") - (gram - 1), F.lit(1))
    code = lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: code(F.array_join(F.slice("w", i, gram), " ")))
    rows = once(rows.filter("text is not null"), "w", w).filter("size(w) > 0").select("batch", "id", *_digests(F.array_join("w", " ")), hashes.alias("hashes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = [np.unique(np.lib.stride_tricks.sliding_window_view(h, min(window, len(h))).min(axis=1)) for h in pdf.hashes]
            yield pdf.drop(columns="hashes").assign(fps=fps)

    return rows.mapInPandas(run, "batch int, id long, h1 long, h2 long, fps array<long>")


def _digests(c: Column) -> list[Column]:
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(17), c).alias("h2")]


class BloomParts:
    """Bloom filters by partition of the fingerprints: rows (part, bits). Sixteen bits and five probes a planned fingerprint."""

    PROBES = 5

    def __init__(self, n_parts: int, bits_per_part: int):
        if bits_per_part % 8:
            raise ValueError("bits_per_part must be whole bytes")
        self.n_parts, self.bits = n_parts, bits_per_part

    def part(self, fp: Column) -> Column:
        return F.pmod(F.shiftrightunsigned(fp, 3), F.lit(self.n_parts)).cast("int")

    def _slots(self, fps: np.ndarray) -> np.ndarray:
        h = _mix(fps.astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B))
        step = (_mix(h) | np.uint64(1))[:, None] * np.arange(self.PROBES, dtype=np.uint64)[None, :]
        return ((h[:, None] + step) % np.uint64(self.bits)).astype(np.int64)

    def add(self, fps: np.ndarray, bits: bytes | None) -> bytes:
        got = np.frombuffer(bits, dtype=np.uint8).copy() if bits is not None else np.zeros(self.bits // 8, dtype=np.uint8)
        slots = self._slots(fps).ravel()
        np.bitwise_or.at(got, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
        return got.tobytes()

    def known(self, fps: np.ndarray, bits: bytes) -> np.ndarray:
        got = np.frombuffer(bits, dtype=np.uint8)
        slots = self._slots(fps)
        return ((got[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).all(axis=1)


_POSTING = "fp long, n int, cover long, h1 long, h2 long, batch int, id long"
_RECORD = "h1 long, h2 long, fps array<long>"
_HIT = "h1 long, h2 long, batch int, id long, same boolean"


class HistoryStore:
    """Accepted contents: postings and records by partition, and Bloom partitions, below ``path``; ``process`` settles a delivery.

    A manifest names the tables of the last settled delivery, so a later run with the same ``path`` goes on from there.
    Every ``COMPACT`` deliveries the tables become one. ``expected_prints`` sizes the partitions: each holds about
    ``prints_per_part`` fingerprints. More than expected raise the rate of false positives, which cost lookups and never a match.
    """

    COMPACT = 32
    #: Fingerprints that ask one partition of the filters in one task.
    ASKED_AT_ONCE = 500_000

    def __init__(self, spark: SparkSession, expected_prints: int, path: str | None = None, coverage: float = 1.0, prints_per_part: int = 500_000):
        self.spark, self.coverage = spark, coverage
        self.path = path or scratch_path(spark, "history")
        n = max(1, -(-expected_prints // prints_per_part))
        kept = json.loads(read_text(spark, f"{self.path}/_manifest") or "{}")
        self.bloom = BloomParts(*kept.get("bloom", (n, max(1024, 16 * -(-expected_prints // n) // 8 * 8))))
        #: versions of each kind of table that hold data
        self.versions: dict[str, list[int]] = kept.get("versions", {"postings": [], "records": [], "filters": []})
        self.version: int = kept.get("version", 0)

    # --- tables by partition ---

    def _write(self, df: DataFrame, kind: str) -> None:
        """A new version of a table, one directory a partition; rows (part, ...)."""
        df.repartition("part").sortWithinPartitions(*[c for c in df.columns if c in ("part", "fp", "h1")]).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{kind}/v={self.version}")
        self.versions[kind].append(self.version)

    def _read(self, kind: str, schema: str, parts: list[int]) -> DataFrame:
        """The rows of some partitions: no file of another one is opened."""
        paths = [f"{self.path}/{kind}/v={v}" for v in self.versions[kind]]
        if not paths or not parts:
            return self.spark.createDataFrame([], schema + ", v int, part int")
        rows = self.spark.read.schema(schema + ", v int, part int").option("basePath", f"{self.path}/{kind}").parquet(*paths)
        return rows if len(parts) == self.bloom.n_parts else rows.filter(F.col("part").isin(parts))

    def _compact(self) -> None:
        every = list(range(self.bloom.n_parts))
        for kind, schema in (("postings", _POSTING), ("records", _RECORD), ("filters", "bits binary")):
            old = self.versions[kind]
            if len(old) > self.COMPACT:
                rows = self._filters(every) if kind == "filters" else self._read(kind, schema, every).drop("v")
                self.versions = self.versions | {kind: []}
                self.version += 1
                self._write(rows, kind)
                for v in old:
                    remove_path(self.spark, f"{self.path}/{kind}/v={v}")

    def _save(self) -> None:
        state = {"bloom": [self.bloom.n_parts, self.bloom.bits], "versions": self.versions, "version": self.version}
        write_text(self.spark, f"{self.path}/_manifest", json.dumps(state))

    def _filters(self, parts: list[int]) -> DataFrame:
        return self._read("filters", "bits binary", parts).groupBy("part").agg(F.max_by("bits", "v").alias("bits"))

    # --- one delivery ---

    def process(self, delivery: DataFrame) -> DataFrame:
        """Settle one delivery of (batch, id, h1, h2, fps): (first_id, id) of its records that repeat an earlier one."""
        self.version += 1
        classes = delivery.groupBy("h1", "h2").agg(F.min(F.struct("batch", "id")).alias("first"), F.first("fps").alias("fps"))
        classes = materialize(classes.select("h1", "h2", "first.batch", "first.id", "fps"), "delivered")
        hits = self._in_history(classes)
        if self.coverage < 1:
            hits = hits.unionByName(self._within(classes))
        hits = materialize(hits.groupBy("h1", "h2").agg(F.min(F.struct("batch", "id")).alias("first"), F.max("same").alias("same")), "hits")
        self._add(classes.join(hits.filter("same"), ["h1", "h2"], "left_anti"))
        self._compact()
        self._save()
        own = classes.select("h1", "h2", F.struct("batch", "id").alias("own")).join(hits.drop("same"), ["h1", "h2"], "left")
        records = delivery.select("h1", "h2", "batch", "id").join(own, ["h1", "h2"])
        return records.select(F.coalesce("first.id", "own.id").alias("first_id"), "id").filter("first_id != id")

    def _in_history(self, classes: DataFrame) -> DataFrame:
        positives = self._prescreen(classes)
        if positives is None:
            return self.spark.createDataFrame([], _HIT)
        if self.coverage >= 1:
            asked = positives.select("h1", "h2", F.array_min("fps").alias("fp"), F.size("fps").alias("n"), F.xxhash64("fps").alias("cover"))
            held = self._read("postings", _POSTING, self._parts_of(asked)).select("fp", "n", "cover", F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "batch", "id")
            # the sets of fingerprints agree; the digests confirm it
            return asked.join(held, ["fp", "n", "cover"]).filter("h1 = _h1 and h2 = _h2").select("h1", "h2", "batch", "id", F.lit(True).alias("same"))
        held = self._read("postings", _POSTING, self._parts_of(positives.select(F.explode("fps").alias("fp"))))
        pairs = materialize(self._candidates(positives, held, F.lit(True)), "candidates")
        wanted = pairs.select(F.col("_h1").alias("h1"), F.col("_h2").alias("h2")).distinct()
        parts = [r[0] for r in wanted.select(self.bloom.part(F.col("h1"))).distinct().collect()]  # n_parts rows at most
        records = self._read("records", _RECORD, parts).select("h1", "h2", "fps").join(wanted, ["h1", "h2"], "left_semi")
        return self._verified(pairs, positives, records)

    def _within(self, classes: DataFrame) -> DataFrame:
        """Contents of the delivery that are enough like an earlier one of it."""
        held = classes.select(F.explode("fps").alias("fp"), F.size("fps").alias("n"), "h1", "h2", "batch", "id")
        pairs = materialize(self._candidates(classes, held, F.struct("_batch", "_id") < F.struct("batch", "id")), "candidates")
        return self._verified(pairs, classes, classes.select("h1", "h2", "fps"))

    def _candidates(self, asked: DataFrame, held: DataFrame, allowed: Column) -> DataFrame:
        """(h1, h2, _h1, _h2, _batch, _id): sides of like size that share one of the rarest fingerprints of the asked one.

        Of n fingerprints n - ceil(coverage * n) + 1 are asked: were none of them shared, the coverage would be missed.
        """
        single = asked.select("h1", "h2", "batch", "id", F.size("fps").alias("n"), F.explode("fps").alias("fp"))
        df = held.join(asked.select(F.explode("fps").alias("fp")).distinct(), "fp", "left_semi").groupBy("fp").agg(F.count("*").alias("df"))
        w = Window.partitionBy("h1", "h2").orderBy("df", "fp")
        ranked = single.join(df, "fp", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("r", F.row_number().over(w))
        probes = ranked.filter((F.col("r") <= F.col("n") - F.ceil(F.col("n") * self.coverage - 1e-9) + 1) & (F.col("df") > 0))
        others = held.select("fp", F.col("n").alias("_n"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("batch").alias("_batch"), F.col("id").alias("_id"))
        like = (F.col("_n") >= F.col("n") * self.coverage - 1e-9) & (F.col("n") >= F.col("_n") * self.coverage - 1e-9)
        return probes.join(others, "fp").filter(like & allowed).select("h1", "h2", "_h1", "_h2", "_batch", "_id").distinct()

    def _verified(self, pairs: DataFrame, asked: DataFrame, held: DataFrame) -> DataFrame:
        """Pairs whose shared fingerprints cover enough of the larger side."""
        j = pairs.join(asked.select("h1", "h2", "fps"), ["h1", "h2"]).join(held.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("fps").alias("_fps")), ["_h1", "_h2"])
        enough = F.size(F.array_intersect("fps", "_fps")) >= F.greatest(F.size("fps"), F.size("_fps")) * self.coverage - 1e-9
        return j.filter(enough).select("h1", "h2", F.col("_batch").alias("batch"), F.col("_id").alias("id"), F.expr("h1 = _h1 and h2 = _h2").alias("same"))

    def _parts_of(self, prints: DataFrame) -> list[int]:
        """The partitions that fingerprints fall into: n_parts numbers at most."""
        return [r[0] for r in prints.select(self.bloom.part(F.col("fp"))).distinct().collect()]

    def _prescreen(self, classes: DataFrame) -> DataFrame | None:
        """Contents enough of whose fingerprints may be in the history, by the Bloom partitions."""
        bloom = self.bloom
        if not self.versions["filters"]:
            return None
        single = classes.select("h1", "h2", F.explode("fps").alias("fp")).withColumn("part", bloom.part(F.col("fp")))
        asked = {r["part"]: r["count"] for r in single.groupBy("part").count().collect()}  # n_parts rows at most
        if not asked:
            return None
        # one fingerprint may be in a third of all contents: its partition is asked in blocks
        blocks = self.spark.createDataFrame([(p, -(-n // self.ASKED_AT_ONCE)) for p, n in asked.items()], "part int, blocks int")
        single = single.join(F.broadcast(blocks), "part").withColumn("block", F.pmod("h1", F.col("blocks")).cast("int")).drop("blocks")
        every = blocks.select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        filters = self._filters(list(asked)).join(F.broadcast(every), "part")

        def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if right.empty or left.empty:
                return pd.DataFrame({"h1": np.zeros(0, np.int64), "h2": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
            hit = left[bloom.known(left.fp.to_numpy(), right.bits.iloc[0])]
            return hit.groupby(["h1", "h2"], as_index=False).agg(n=("fp", "size"))

        seen = single.groupBy("part", "block").cogroup(filters.groupBy("part", "block")).applyInPandas(probe, "h1 long, h2 long, n long")
        seen = seen.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        enough = classes.join(seen, ["h1", "h2"]).filter(F.col("n") >= F.ceil(F.size("fps") * self.coverage - 1e-9)).drop("n")
        return materialize(enough, "positives")

    def _add(self, new: DataFrame) -> None:
        """Post the new contents and set the bits of their fingerprints; only touched partitions get a new version."""
        bloom = self.bloom
        new = materialize(new, "accepted")
        # at full coverage the least fingerprint finds a content, below it any of them must
        fp = F.array_min("fps") if self.coverage >= 1 else F.explode("fps")
        posted = new.select(fp.alias("fp"), F.size("fps").alias("n"), F.xxhash64("fps").alias("cover"), "h1", "h2", "batch", "id")
        self._write(posted.withColumn("part", bloom.part(F.col("fp"))), "postings")
        if self.coverage < 1:
            self._write(new.select("h1", "h2", "fps", bloom.part(F.col("h1")).alias("part")), "records")
        single = new.select(F.explode("fps").alias("fp")).distinct().withColumn("part", bloom.part(F.col("fp")))
        old = self._filters(self._parts_of(single))

        def extend(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty:
                return pd.DataFrame({"part": np.zeros(0, np.int32), "bits": []})
            return pd.DataFrame({"part": left.part.iloc[:1], "bits": [bloom.add(left.fp.to_numpy(dtype="int64"), bytes(right.bits.iloc[0]) if len(right) else None)]})

        self._write(single.groupBy("part").cogroup(old.groupBy("part")).applyInPandas(extend, "part int, bits binary"), "filters")


def settle_batches(prints: DataFrame, coverage: float = 1.0, together: int = 4) -> DataFrame:
    """(first_id, id) of every record that repeats an earlier one, against a growing store.

    ``prints`` as ``key_prints`` and ``text_prints`` give them. The first batch is the history; of those
    after it ``together`` at a time are one delivery, as the order within a delivery is kept.
    """
    spark = prints.sparkSession
    path = scratch_path(spark, "prints")
    prints.write.partitionBy("batch").parquet(path)
    rows = spark.read.schema(prints.schema).parquet(path)  # an empty table leaves no file to take it from
    found = rows.groupBy("batch").agg(F.sum(F.size("fps")).alias("n")).orderBy(F.asc_nulls_first("batch")).collect()  # one row a batch
    if not found:
        return spark.createDataFrame([], "first_id long, id long")
    store = HistoryStore(spark, sum(r["n"] for r in found), coverage=coverage)
    batches = [r["batch"] for r in found]
    deliveries = [batches[:1]] + [batches[i : i + together] for i in range(1, len(batches), together)]
    out = None
    for d in deliveries:
        mine = F.col("batch").isin([b for b in d if b is not None])
        part = store.process(rows.filter(mine | F.col("batch").isNull() if None in d else mine))
        out = part if out is None else out.unionByName(part)
    return out
