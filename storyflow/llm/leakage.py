"""Evaluation passages inside training text: a stored positional inverted index, asked from the rarest terms.

The index of a training corpus is built once below a folder and reopened for any set of test items: forward lists (the
hashed words of the documents, some thousand documents a row), postings (term, document, position; packed by rows
of documents, partitioned by term) and the frequency of every term. Asking it reads no document text.

Of every window of an item the rarest terms are anchors; every posting of an anchor proposes an alignment of
document and item. The aligned lists are intersected there: a run of ``n`` words is an exact phrase match; ``n`` words in
the same order within windows of ``n / min_share`` positions on both sides, with words changed, left out or put in, are a
proximity match. For exact matches the rarest term of every ``n`` words is enough. For the other kind a window of L positions may
miss L - n words, so its L - n + 1 rarest terms are asked: at least one of them stands in the document. Nothing is lost either way.

Postings of one partition are read only if one of its terms is asked. A term in every document is a list cut by rows of
documents, never one group; alignments go to the row of documents they lie in.

Defined results: null and empty text on either side matches nothing; items shorter than ``n`` words match
nothing; copies of a document or item each match by their own id; repeated rows count once; words are compared by 64-bit hash.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import once, words
from ..session import materialize, read_text, scratch_path, write_text

#: Words of a row of documents; postings of a partition of terms.
PACKED, PARTITION = 200_000, 4_000_000

_FORWARD = "row long, ids array<long>, starts binary, tokens binary"
_POSTINGS = "row long, terms binary, docs binary, pos binary, bucket int"


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


class LeakIndex:
    """The positional index of a corpus; ``build`` writes one, ``LeakIndex(spark, path)`` opens it again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.n_buckets: int = json.loads(read_text(spark, f"{path}/_manifest"))["buckets"]

    @classmethod
    def build(cls, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> LeakIndex:
        """Write the index of (doc_id, text). One pass over the texts."""
        spark = docs.sparkSession
        path = path or scratch_path(spark, "leak-index")

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for _, g in pdf.groupby(pdf.w.map(len).cumsum() // PACKED):
                    starts = np.r_[0, np.cumsum(g.w.map(len))].astype(np.int32)
                    yield pd.DataFrame({"row": [int(g.key.iloc[0])], "ids": [g.id.to_numpy()], "starts": [starts.tobytes()], "tokens": [np.concatenate(list(g.w)).astype(np.int64).tobytes()]})

        texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
        texts = once(texts, "w", _hashes(F.col("text"))).drop("text").filter("size(w) > 0").withColumn("key", F.monotonically_increasing_id())
        texts.mapInPandas(pack, _FORWARD).write.parquet(f"{path}/forward")
        forward = spark.read.schema(_FORWARD).parquet(f"{path}/forward")
        n_words = forward.agg(F.sum(F.length("tokens") / 8)).first()[0] or 0
        n_buckets = max(8, math.ceil(n_words / PARTITION))

        def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    terms, starts = np.frombuffer(r.tokens, np.int64), np.frombuffer(r.starts, np.int32)
                    doc = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
                    pos = (np.arange(len(terms)) - starts[doc]).astype(np.int32)
                    bucket = (terms % n_buckets).astype(np.int32)
                    order = np.lexsort((terms, bucket))
                    terms, doc, pos, bucket = terms[order], doc[order], pos[order], bucket[order]
                    cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
                    rows = [(r.row, terms[a:z].tobytes(), doc[a:z].tobytes(), pos[a:z].tobytes(), b) for b, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
                    yield pd.DataFrame(rows, columns=["row", "terms", "docs", "pos", "bucket"])

        forward.mapInPandas(invert, _POSTINGS).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/postings")

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for b, g in pdf.groupby("bucket"):
                    term, n = np.unique(np.frombuffer(b"".join(g.terms), np.int64), return_counts=True)
                    yield pd.DataFrame({"bucket": np.full(len(term), b, np.int32), "term": term, "n": n})

        counts = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").select("bucket", "terms").mapInPandas(count, "bucket int, term long, n long")
        counts.groupBy("bucket", "term").agg(F.sum("n").alias("df")).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/terms")
        write_text(spark, f"{path}/_manifest", json.dumps({"buckets": n_buckets}))
        return cls(spark, path)

    def _bucket(self, term: Column) -> Column:
        return F.pmod(term, F.lit(self.n_buckets)).cast("int")

    def anchors(self, tokens: DataFrame, n: int, length: int) -> DataFrame:
        """(bucket, term, item_id, j): of every window of ``length`` positions the ``length - n + 1`` rarest terms the corpus holds.

        ``tokens`` is (item_id, j, term). An item shorter than a window is one window.
        """
        asked = tokens.select("term").distinct().withColumn("bucket", self._bucket(F.col("term")))
        held = self.spark.read.schema("term long, df long, bucket int").parquet(f"{self.path}/terms").join(asked, ["bucket", "term"])
        rare = tokens.join(held, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        ahead = Window.partitionBy("item_id").orderBy("j").rowsBetween(0, length - 1)
        window = F.array_sort(F.collect_list(F.struct("df", "j", "term")).over(ahead))
        whole = (F.size("w") == length) | ((F.col("j") == 0) & (F.size("w") >= n))
        chosen = rare.select("item_id", "j", window.alias("w")).filter(whole).select("item_id", F.explode(F.slice("w", F.lit(1), F.size("w") - (n - 1))).alias("a"))
        chosen = chosen.filter("a.df > 0").select("item_id", F.col("a.j").alias("j"), F.col("a.term").alias("term")).distinct()
        return chosen.withColumn("bucket", self._bucket(F.col("term")))

    def proposals(self, anchors: DataFrame) -> DataFrame:
        """(row, item_id, docs, shifts): per row of documents and item the places anchors propose, packed."""
        asked = anchors.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("term", "item_id", "j"))).alias("asked"))
        asked = materialize(asked, "asked")
        buckets = [r[0] for r in asked.select("bucket").collect()]  # one number a partition at most
        held = self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings").filter(F.col("bucket").isin(buckets))

        def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    terms, docs, pos = np.frombuffer(r.terms, np.int64), np.frombuffer(r.docs, np.int32), np.frombuffer(r.pos, np.int32)
                    term = np.array([a["term"] for a in r.asked], np.int64)
                    item, j = np.array([a["item_id"] for a in r.asked], np.int64), np.array([a["j"] for a in r.asked], np.int64)
                    lo, hi = np.searchsorted(terms, term, "left"), np.searchsorted(terms, term, "right")
                    n = hi - lo
                    own = np.repeat(np.arange(len(term)), n)
                    at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + lo[own]
                    if not len(own):
                        continue
                    hit = pd.DataFrame({"item_id": item[own], "doc": docs[at], "shift": pos[at].astype(np.int64) - j[own]}).drop_duplicates()
                    parts = [(r.row, i, g.doc.to_numpy(np.int32).tobytes(), g["shift"].to_numpy(np.int32).tobytes()) for i, g in hit.groupby("item_id")]
                    yield pd.DataFrame(parts, columns=["row", "item_id", "docs", "shifts"])

        return held.join(asked, "bucket").select("row", "terms", "docs", "pos", "asked").mapInPandas(look_up, "row long, item_id long, docs binary, shifts binary")

    def matches(self, items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = 12, min_share: float = 0.75, near: bool = True) -> DataFrame:
        """(doc_id, item_id, longest, agreeing, kind): the longest run, the words that agree in order, ``exact`` or ``near``; exact ones are whole without ``near``, too."""
        length = math.ceil(n / Fraction(str(min_share))) if near else n
        lists = items.select(F.col(item_id).cast("long").alias("item_id"), _hashes(F.col(text)).alias("iw")).filter(F.col("item_id").isNotNull() & (F.size("iw") >= n)).distinct()
        lists = materialize(lists, "items")
        tokens = lists.select("item_id", F.posexplode("iw").alias("j", "term")).distinct()
        found = self.proposals(self.anchors(tokens, n, length)).join(lists, "item_id")
        forward = self.spark.read.schema(_FORWARD).parquet(f"{self.path}/forward")

        def intersect(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(left) and len(right):
                r = right.iloc[0]
                rows = _Row(np.asarray(r.ids), np.frombuffer(r.starts, np.int32), np.frombuffer(r.tokens, np.int64))
                for item, g in left.groupby("item_id"):
                    at = np.unique(np.column_stack([np.frombuffer(b"".join(g.docs), np.int32), np.frombuffer(b"".join(g.shifts), np.int32)]), axis=0)
                    out += [(d, item, *m) for d, m in rows.compare(np.asarray(g.iw.iloc[0], np.int64), at[:, 0], at[:, 1], n, length, near)]
            return pd.DataFrame(out, columns=["doc_id", "item_id", "longest", "agreeing", "kind"]).astype({"doc_id": "int64", "item_id": "int64", "longest": "int32", "agreeing": "int32"})

        best = found.groupBy("row").cogroup(forward.groupBy("row")).applyInPandas(intersect, "doc_id long, item_id long, longest int, agreeing int, kind string")
        # a repeated document stands in several rows
        best = best.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.max("agreeing").alias("agreeing"), F.min("kind").alias("kind"))
        return best


class _Row:
    """A row of documents: their ids and the list of their words."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, tokens: np.ndarray):
        self.ids, self.starts, self.tokens = ids, starts.astype(np.int64), tokens

    def compare(self, item: np.ndarray, doc: np.ndarray, shift: np.ndarray, n: int, length: int, near: bool) -> Iterator[tuple[int, tuple[int, int, str]]]:
        """Matches of one item with the documents it may lie in."""
        longest, agreeing = {}, {}
        for a in range(0, len(doc), 20_000):
            d, s = doc[a : a + 20_000], shift[a : a + 20_000].astype(np.int64)
            place = s[:, None] + np.arange(len(item))
            inside = (place >= 0) & (place < (self.starts[d + 1] - self.starts[d])[:, None])
            same = inside & (self.tokens[np.where(inside, place + self.starts[d][:, None], 0)] == item)
            # run lengths: positions since the last disagreement
            j = np.arange(1, len(item) + 1)
            run = j - np.maximum.accumulate(np.where(same, 0, j), axis=1)
            top = run.max(axis=1)
            for i in np.flatnonzero(top >= (n if not near else 1)):
                longest[d[i]] = max(longest.get(d[i], 0), int(top[i]))
            if near:  # a document with an exact match needs no other
                open_ = np.array([longest.get(x, 0) < n for x in d], dtype=bool)
                self._chains(item, d[open_], s[open_], same[open_], n, length, agreeing)
        for d, k in longest.items():
            if k >= n:
                yield int(self.ids[d]), (k, max(k, agreeing.get(d, 0)), "exact")
            elif agreeing.get(d, 0) >= n:
                yield int(self.ids[d]), (k, agreeing[d], "near")

    def _chains(self, item: np.ndarray, doc: np.ndarray, shift: np.ndarray, same: np.ndarray, n: int, length: int, agreeing: dict[int, int]) -> None:
        """Most words in the same order within ``length`` positions of both sides, at the proposed places."""
        for d in np.unique(doc):
            tokens = self.tokens[self.starts[d] : self.starts[d + 1]]
            mine = np.flatnonzero(doc == d)
            i, j = np.nonzero(same[mine])
            centre = np.unique(shift[mine][i] + j)  # places where a word agrees at a proposed alignment
            # a window holds a chain only if n of its words are the item's at all, and only if a proposal falls into it
            known = np.r_[0, np.cumsum(np.isin(tokens, item))]
            first = np.arange(len(tokens))
            last = np.minimum(first + length, len(tokens))
            first = first[known[last] - known[first] >= n]
            at = np.searchsorted(centre, first)
            first = first[(at < len(centre)) & (centre[np.minimum(at, len(centre) - 1)] < first + length)] if len(centre) else first[:0]
            if not len(first):
                continue
            for part in np.split(first, np.flatnonzero(np.diff(first) > length) + 1):
                best = longest_chain(tokens[part[0] : part[-1] + length], item, length)
                agreeing[d] = max(agreeing.get(d, 0), best)


def longest_chain(a: np.ndarray, b: np.ndarray, length: int) -> int:
    """Most pairs of equal words in the same order on both sides whose first and last are less than ``length`` positions apart on each."""
    x, y = np.nonzero(a[:, None] == b[None, :])
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    best, most = 0, min(length, len(a), len(b))
    for s in range(len(x)):
        if best == most:
            break
        near = slice(s, int(np.searchsorted(x, x[s] + length)))
        ys = y[near]
        ys = ys[((ys > y[s]) & (ys < y[s] + length) & (x[near] > x[s])) | (np.arange(len(ys)) == 0)]
        if len(ys) <= best:
            continue
        # longest increasing subsequence of y in order of x; of one x only one point can be taken, so larger y come first
        xs = x[near][((y[near] > y[s]) & (y[near] < y[s] + length) & (x[near] > x[s])) | (np.arange(near.stop - near.start) == 0)]
        tails: list[int] = []
        for v in ys[np.lexsort((-ys, xs))].tolist():
            at = int(np.searchsorted(tails, v))
            tails[at : at + 1] = [v]
        best = max(best, len(tails))
    return best
