"""Near-duplicate records: all pairs of word sets whose Jaccard similarity reaches a threshold, exactly.

Universe-partition pigeonhole. Sets are put into bands by size; in a band the universe of words is hashed into
``m`` segments. Two sets that differ by at most H words agree in a segment up to t_i words for any
allocation of t_i in {-1, 0, 1} with sum(t_i + 1) > H, so the longer set of a pair looks for partners only by the
segments it allocated: by the segment's words (t = 0) or by these and their one-deletion neighbourhoods
(t = 1). The allocation is chosen per set by the expected length of the lists it would read, from the
frequencies of words in all records. Every set is indexed by all segments and deletions of its own band; it
probes its own band and the one below, where partners of down to ``threshold`` times its size lie.

Keys travel as packed blobs, one per task and target bucket, which spares a row header per key. Each
carries a 64-bit parity sketch of its set: its distance to another sketch never exceeds the true one, so
candidates are discarded without loss before anything else is shuffled. What is left is verified on the
sets themselves. Equal sets are one class throughout.

Long lists are measured, not guessed, as a template shared by many sets makes one whatever the odds of its words. A
counting pass over all keys keeps those that may have ``HOT_LIST`` entries or more; the allocation counts a hot
key at its measured length, so a set avoids it where it has cheaper segments, and where it can't, the
list is cut into slices: each index entry lies in one slice, each probe goes to all of them.

Defined results: null or empty text in any field excludes a record; repeated rows of one id count once;
similarity equal to the threshold is a match; words are compared by 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_empty, once, words
from ..session import materialize

#: Frequencies of this many of the commonest words steer the allocation; the table sent to all tasks is bounded by it.
COMMON_WORDS = 16_384
#: Entries of a list from which a key counts as hot, and entries of a slice of it; hot keys that are sent to all tasks at most.
HOT_LIST, SLICE, HOT_KEYS = 100_000, 50_000, 1_000_000
#: Fractions of a natural logarithm in which frequencies are summed.
_ODDS_UNIT = 2**20


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def max_difference(total: np.ndarray | int, threshold: Fraction) -> np.ndarray | int:
    """Words by which two sets of ``total`` words together may differ."""
    p, q = threshold.numerator, threshold.denominator
    return ((q - p) * total) // (q + p)


def band_of(size: np.ndarray) -> np.ndarray:
    """Bands 1-2, 3-5, 6-11, 12-23, 24-47, ... numbered from 0."""
    return np.searchsorted(_BAND_TOPS, size, side="left")


_BAND_TOPS = np.array([2] + [3 * 2**k - 1 for k in range(1, 40)])


def segments_of(band: int, threshold: Fraction) -> int:
    """Segments of a band: enough that about a third of the possible allocations can be left out."""
    top = int(_BAND_TOPS[band])
    own = int(max_difference(2 * top, threshold)) + 1
    above = int(max_difference(int(top / threshold) + top, threshold)) + 1  # for probes of the band above
    return max(1, math.ceil(0.72 * own), math.ceil(above / 2))


class _Batch:
    """Flattened sets of one batch: tokens grouped by record, with what every key needs."""

    def __init__(self, ids: np.ndarray, toks: list[np.ndarray], common: np.ndarray, log_odds: np.ndarray, rare: float, n_sets: int, mean_size: float, hot: tuple[np.ndarray, np.ndarray] | None = None):
        self.ids, self.sizes = ids, np.array([len(t) for t in toks], dtype=np.int64)
        self.flat = np.concatenate(toks).astype(np.int64).view(np.uint64)
        self.rec = np.repeat(np.arange(len(ids)), self.sizes)
        at = np.searchsorted(common, self.flat.view(np.int64)).clip(0, len(common) - 1) if len(common) else np.zeros(len(self.flat), dtype=np.int64)
        odds = np.where(common[at] == self.flat.view(np.int64), log_odds[at], rare) if len(common) else np.full(len(self.flat), rare)
        # whole numbers: their sums are the same in any order, so an estimate depends on a key's words alone
        self.odds = np.rint(odds * _ODDS_UNIT).astype(np.int64)
        self.mixed = _mix(self.flat)
        bits = np.uint64(1) << (self.mixed % np.uint64(64))
        self.sketch = np.bitwise_xor.reduceat(bits, np.concatenate([[0], np.cumsum(self.sizes)[:-1]])) if len(ids) else np.array([], dtype=np.uint64)
        self.log_n, self.mean_size = math.log(max(n_sets, 2)), mean_size
        #: sorted hot keys and their measured lengths
        self.hot_keys, self.hot_lengths = hot if hot is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def measured(self, key: np.ndarray) -> np.ndarray:
        """The measured list lengths of hot keys, 0 for all others."""
        if not len(self.hot_keys):
            return np.zeros(len(key), dtype=np.int64)
        at = np.searchsorted(self.hot_keys, key).clip(0, len(self.hot_keys) - 1)
        return np.where(self.hot_keys[at] == key, self.hot_lengths[at], 0)

    def keys(self, recs: np.ndarray, band: int, m: int, need: np.ndarray, index: bool) -> pd.DataFrame:
        """Keys of the records ``recs`` in the segmentation of ``band``; without ``index`` only those they probe."""
        pos = np.full(len(self.ids), -1)
        pos[recs] = np.arange(len(recs))
        pick = pos[self.rec] >= 0
        doc, mixed, odds = pos[self.rec[pick]], self.mixed[pick], self.odds[pick]
        seg = ((mixed >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
        cell = doc * m + seg
        order = np.argsort(cell, kind="stable")
        cell, mixed, odds = cell[order], _mix(mixed[order] + np.uint64(0xABCD)), odds[order]
        n_cells = len(recs) * m
        content, log_e = np.zeros(n_cells, dtype=np.uint64), np.zeros(n_cells, dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.array([], dtype=np.int64)
        if len(cell):
            content[cell[starts]] = np.add.reduceat(mixed, starts)
            log_e[cell[starts]] = np.add.reduceat(odds, starts)
        salt = np.uint64((band * 1_000_003 + m) & 0xFFFFFFFF)
        seg_no = np.tile(np.arange(m, dtype=np.uint64), len(recs))
        ekey = _mix(content + seg_no * np.uint64(0x9E3779B97F4A7C15) + salt)
        dkey = _mix(content[cell] - mixed + seg_no[cell] * np.uint64(0x9E3779B97F4A7C15) + salt)
        # list lengths: of the segment's words, and of these with one word less; expected ones, and measured ones where they
        # are hot (figures of all sets, never of the batch: both sides of a pair must see the same)
        base = self.log_n - self.mean_size / m
        e_hot, d_hot = self.measured(ekey), self.measured(dkey)
        e_list = np.maximum(np.exp(np.minimum(log_e / _ODDS_UNIT + base, 60)), e_hot)
        d_each = np.maximum(np.exp(np.minimum((log_e[cell] - odds) / _ODDS_UNIT + base, 60)), d_hot)
        d_list = np.bincount(cell, weights=d_each, minlength=n_cells)
        c0 = e_list.reshape(-1, m) + 1e-9
        c1 = (e_list * (1 + self.mean_size / m) + d_list).reshape(-1, m)
        step = np.concatenate([c0, np.maximum(c1 - c0, c0 * 1.0000001)], axis=1)
        rank = np.argsort(np.argsort(step, axis=1, kind="stable"), axis=1, kind="stable")
        chosen = rank < need[:, None]
        level = (chosen[:, :m].astype(np.int8) + chosen[:, m:].astype(np.int8)).ravel()
        e_rec, d_rec = recs[np.repeat(np.arange(len(recs)), m)], recs[cell // m]
        d_level = np.where(level[cell] == 2, 2, 0).astype(np.int8)
        key = np.concatenate([ekey, dkey])
        rec = np.concatenate([e_rec, d_rec])
        lev = np.concatenate([level, d_level])
        kind = np.concatenate([np.zeros(len(ekey), dtype=np.int8), np.ones(len(dkey), dtype=np.int8)])
        hot = np.concatenate([e_hot, d_hot])
        if not index:
            keep = lev > 0
            key, rec, lev, kind, hot = key[keep], rec[keep], lev[keep], kind[keep], hot[keep]
        flags = kind + lev * 2 + (8 if index else 0)
        return pd.DataFrame({"key": key, "rec": rec.astype(np.int32), "how": flags.astype(np.uint8), "hot": np.minimum(hot, 2**31 - 1).astype(np.int32)})


def _planes(a: np.ndarray) -> bytes:
    """Bytes of an array by place value: equal high bytes come together and compress away."""
    return a.view(np.uint8).reshape(len(a), -1).T.tobytes()


def _unplanes(b: bytes, kind) -> np.ndarray:
    w = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(w, -1).T).view(kind).ravel()


_BLOB = "bucket int, ids binary, keys binary, sketches binary, sizes binary, flags binary"


def _pack(bucket: np.ndarray, b: _Batch, k: pd.DataFrame) -> pd.DataFrame:
    """One row of packed columns per bucket, sorted by key."""
    key, rec = k.key.to_numpy(), k.rec.to_numpy()
    order = np.lexsort((key, bucket))
    bucket, key, rec, flags = bucket[order], key[order], rec[order], k.how.to_numpy()[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() + [len(bucket)] if len(bucket) else [0]
    rows = []
    for a, z in zip(cuts, cuts[1:]):
        r = rec[a:z]
        rows.append((int(bucket[a]), _planes(b.ids[r]), _planes(key[a:z] >> np.uint64(24)), _planes(b.sketch[r]), _planes(b.sizes[r].astype(np.int32)), flags[a:z].tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "ids", "keys", "sketches", "sizes", "flags"])


def _sliced(bucket: np.ndarray, b: _Batch, k: pd.DataFrame, n_buckets: int) -> tuple[np.ndarray, _Batch, pd.DataFrame]:
    """Entries of hot keys spread over the slices of their list: an index entry to one by its id, a probe to all."""
    length = k.hot.to_numpy()
    if not length.any():
        return bucket, b, k
    slices = -(-length // SLICE)
    own = (_mix(b.ids[k.rec.to_numpy()].view(np.uint64)) % np.maximum(slices, 1).astype(np.uint64)).astype(np.int64)
    how, hot = k.how.to_numpy(), length > 0
    copies, places = [k[~hot]], [bucket[~hot]]
    for s in range(int(slices.max())):
        here = hot & (slices > s)
        f = np.where(own == s, how, how & 7).astype(np.uint8)  # without the index flag elsewhere
        keep = here & ((f & 14) > 0)
        copies.append(k[keep].assign(how=f[keep]))
        places.append((bucket[keep] + s * 7919) % n_buckets)
    return np.concatenate(places), b, pd.concat(copies, ignore_index=True)


def _candidates(blobs: pd.DataFrame, threshold: Fraction, block: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Pairs of one bucket that share a key in an allowed way and whose sizes and sketches are near enough."""
    cat = lambda c, kind: np.concatenate([_unplanes(x, kind) for x in blobs[c]])
    ids, key, sk, size, fl = cat("ids", np.int64), cat("keys", np.uint64), cat("sketches", np.uint64), cat("sizes", np.int32), cat("flags", np.uint8)
    order = np.argsort(key, kind="stable")
    ids, key, sk, size, fl = ids[order], key[order], sk[order], size[order].astype(np.int64), fl[order]
    idx = np.flatnonzero(fl & 8)
    ikey = key[idx]
    pr = np.flatnonzero((fl >> 1) & 3)
    lo, hi = np.searchsorted(ikey, key[pr], side="left"), np.searchsorted(ikey, key[pr], side="right")
    n = hi - lo
    some = n > ((fl[pr] & 8) > 0)  # an indexed probe always meets itself
    pr, lo, n = pr[some], lo[some], n[some]
    ends = np.cumsum(n)
    a = 0
    while a < len(pr):
        start = ends[a - 1] if a else 0
        z = max(a + 1, int(np.searchsorted(ends, start + block, side="right")))
        p = np.repeat(pr[a:z], n[a:z])
        x = idx[np.arange(len(p)) - np.repeat(np.cumsum(n[a:z]) - n[a:z], n[a:z]) + np.repeat(lo[a:z], n[a:z])]
        a = z
        kind_p, kind_x, lev = fl[p] & 1, fl[x] & 1, (fl[p] >> 1) & 3
        sp, sx = size[p], size[x]
        ok = (ids[p] != ids[x]) & (sx <= sp) & (sx * threshold.denominator >= sp * threshold.numerator) & ((kind_p & kind_x) == 0) & ((kind_x == 0) | (lev == 2))
        ok[ok] &= np.bitwise_count(sk[p[ok]] ^ sk[x[ok]]) <= max_difference(sp[ok] + sx[ok], threshold)
        p, x = p[ok], x[ok]
        if len(p):
            yield pd.DataFrame({"a": np.minimum(ids[p], ids[x]), "b": np.maximum(ids[p], ids[x])}).drop_duplicates()


def _gathered(batches: Iterator[pd.DataFrame], words_at_once: int = 900_000) -> Iterator[pd.DataFrame]:
    """Arrow batches joined to a bounded size, so that blobs hold many keys however many buckets there are."""
    held, n = [], 0
    for pdf in batches:
        if pdf.empty:
            continue
        held.append(pdf)
        n += int(pdf.toks.map(len).sum())
        if n >= words_at_once:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def word_sets(rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, toks, set_hash): sorted distinct hashed words of the joined fields; records with an empty field are left out."""
    good: Column = F.lit(True)
    for f in fields:
        good &= non_empty(F.col(f))
    text = F.concat_ws(" ", *[F.col(f"_{i}") for i in range(len(fields))])
    toks = F.array_sort(F.transform(F.array_distinct(words(text)), lambda w: F.xxhash64(w)))
    sets = once(rows.filter(good).select(F.col(id_col).alias("id"), *[F.col(f).alias(f"_{i}") for i, f in enumerate(fields)]), "toks", toks)
    return sets.select("id", "toks").filter("size(toks) > 0").withColumn("set_hash", F.xxhash64("toks"))


class SimilarSets:
    """Classes of equal sets, and the pairs of classes whose similarity reaches the threshold."""

    def __init__(self, rows: DataFrame, id_col: str, fields: list[str], threshold: str = "0.7"):
        self.spark, self.threshold = rows.sparkSession, Fraction(threshold)
        sets = word_sets(rows, id_col, fields)
        own = materialize(sets.select("id", "set_hash").distinct(), "set-hashes")
        #: (set_hash, class_id, n): class_id is the least id of a class
        self.classes = materialize(own.groupBy("set_hash").agg(F.min("id").alias("class_id"), F.count("*").alias("n")), "classes")
        self.members = own.join(self.classes.select("set_hash", "class_id"), "set_hash").select("class_id", F.col("id").alias("member"))
        #: (id, toks): one set per class; sets travel once, the ids of copies without them
        self.sets = materialize(sets.groupBy("set_hash").agg(F.min("id").alias("id"), F.first("toks").alias("toks")).select("id", "toks"), "sets")

    def _word_odds(self, n_sets: int) -> tuple[np.ndarray, np.ndarray, float]:
        df = materialize(self.sets.select(F.explode("toks").alias("w")).groupBy("w").agg(F.count("*").alias("n")), "word-counts")
        # the frequency from which there are at most COMMON_WORDS words, found on a histogram of a few hundred
        # classes: an ordered limit would send that many rows of every task to the driver
        frequency = F.floor(F.log2("n") * 16).cast("int")
        classes = sorted(df.groupBy(frequency.alias("c")).agg(F.count("*").alias("k")).collect(), reverse=True)
        room, least = COMMON_WORDS, None
        for r in classes:
            if r["k"] > room:
                break
            room, least = room - r["k"], r["c"]
        top = df.filter(frequency >= least if least is not None else F.lit(False)).toPandas().sort_values("w")
        p = (top.n.to_numpy() / max(n_sets, 1)).clip(1e-12, 0.95)
        odds = np.log(p / (1 - p))
        return top.w.to_numpy(dtype=np.int64), odds, float(odds.min()) if len(odds) else -math.log(max(n_sets, 2))

    def _hot_keys(self, n_sets: int, n_words: int, keyed) -> tuple[np.ndarray, np.ndarray] | None:
        """Hot keys and lengths, from a pass over the keys of all sets.

        A set has a key at most once, so fewer sets than HOT_LIST have no hot key. A key of that many entries has its
        share of the entries in at least one batch; batches tell the keys with at least half that share, and the lengths they
        told sum up to at least half of the true one.
        """
        n_keys = 2.2 * n_words
        least = max(HOT_LIST, n_keys / HOT_KEYS)
        if n_sets < least:
            return None
        share = least / (2 * n_keys)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _, k in keyed(batches, None):
                key, n = np.unique(k.key.to_numpy()[(k.how.to_numpy() & 8) > 0], return_counts=True)
                much = n >= max(2, share * n.sum())
                yield pd.DataFrame({"key": key[much].view(np.int64), "n": n[much]})

        told = self.sets.mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least / 2).toPandas()
        key = told.key.to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(key)
        return key[order], told.n.to_numpy(dtype=np.int64)[order]

    def pairs(self, buckets: int | None = None) -> DataFrame:
        """(a, b): class ids, a < b, of all similar pairs of different sets."""
        threshold = self.threshold
        sets = self.sets
        n_sets, n_words = sets.agg(F.count("*"), F.sum(F.size("toks"))).first()
        if not n_sets:
            return self.spark.createDataFrame([], "a long, b long")
        common, odds, rare = self._word_odds(n_sets)
        mean_size = n_words / n_sets
        # about a million keys a bucket
        n_buckets = buckets or max(self.spark.sparkContext.defaultParallelism * 2, math.ceil(2.2 * n_words / 1_000_000))

        def keyed(batches: Iterator[pd.DataFrame], hot) -> Iterator[tuple[_Batch, pd.DataFrame]]:
            for pdf in _gathered(batches):
                b = _Batch(pdf.id.to_numpy(dtype=np.int64), list(pdf.toks), common, odds, rare, n_sets, mean_size, hot)
                bands = band_of(b.sizes)
                parts = []
                for band in np.unique(bands):
                    recs = np.flatnonzero(bands == band)
                    parts.append(b.keys(recs, int(band), segments_of(int(band), threshold), max_difference(2 * b.sizes[recs], threshold) + 1, True))
                    top = int(_BAND_TOPS[band - 1]) if band else 0
                    low = recs[b.sizes[recs] * threshold.numerator <= top * threshold.denominator] if band else recs[:0]
                    if len(low):
                        parts.append(b.keys(low, int(band) - 1, segments_of(int(band) - 1, threshold), max_difference(b.sizes[low] + top, threshold) + 1, False))
                yield b, pd.concat(parts, ignore_index=True)

        hot = self._hot_keys(n_sets, n_words, keyed)

        def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b, k in keyed(batches, hot):
                bucket = (k.key.to_numpy() % np.uint64(n_buckets)).astype(np.int64)
                yield _pack(*_sliced(bucket, b, k, n_buckets))

        def find(blobs: pd.DataFrame) -> pd.DataFrame:
            found = list(_candidates(blobs, threshold))
            return pd.concat(found).drop_duplicates() if found else pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})

        # one partition per bucket, by number: hashing the numbers again would put several into one task
        packed = sets.mapInPandas(emit, _BLOB).repartitionById(n_buckets, F.col("bucket"))
        candidates = packed.groupBy("bucket").applyInPandas(find, "a long, b long").distinct()
        candidates = materialize(candidates, "candidates")
        asked = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        needed = materialize(sets.join(asked, "id", "left_semi"), "candidate-sets")
        left, right = needed.select(F.col("id").alias("a"), F.col("toks").alias("ta")), needed.select(F.col("id").alias("b"), F.col("toks").alias("tb"))
        both = F.size(F.array_intersect("ta", "tb"))
        union = F.size("ta") + F.size("tb") - both
        return candidates.join(left, "a").join(right, "b").filter(both * threshold.denominator >= union * threshold.numerator).select("a", "b")

    def expanded(self, class_pairs: DataFrame) -> DataFrame:
        """All pairs of records: members of similar classes, and members of one class. Distinct, smaller id first."""
        m = self.members
        repeated = self.classes.filter("n > 1").select("class_id")
        same = m.join(repeated, "class_id", "left_semi")
        within = same.join(same.withColumnRenamed("member", "other"), "class_id").filter("member < other").select(F.col("member").alias("a"), F.col("other").alias("b"))
        left, right = m.select(F.col("class_id").alias("a"), F.col("member").alias("ma")), m.select(F.col("class_id").alias("b"), F.col("member").alias("mb"))
        across = class_pairs.join(left, "a").join(right, "b").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"))
        return within.unionByName(across)
