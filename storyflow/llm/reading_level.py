"""Reading level of prose documents by label propagation on graphs.

Two graphs, one after the other. In the document-word graph every document is linked to its words by frequency; graded
documents are clamped and difficulty spreads by harmonic iterations (a word is the mean of its documents, an ungraded
document the mean of its words) until nothing changes by more than a tolerance. It yields how demanding each document's vocabulary is.
In the similarity graph documents are linked to hubs near them in the plane of vocabulary difficulty and sentence length,
at several resolutions and by distance; graded documents are clamped again, and iterations of the same kind
give every hub, and with it every document, its level on the scale of the grades. A level needs both respects, so
the second graph is over their combination; it is continuous, as a document lies between its hubs.

Words of a document are counted once and stored packed, some hundred documents a row with a dictionary of their own. A round
sends the sums of each dictionary to the partition of its words, merges them there and sends the means back: a
word in every document is one entry a row, never a hot key. A round of the second graph is one pass over all documents, which adds them up
next to the data; only the ``HUBS`` means (some 6,000 numbers, whatever the number of documents) pass through the driver.

Ungraded documents weigh ``TRUST`` of a graded one in a mean, so the grades decide where there are some.

Defined results: null, empty and non-prose texts (lists, tables, code: no complete sentence in any paragraph) have no
level; lines that break within a sentence are joined; grades are the median over distinct (rater, grade) rows of a document; without any grade nothing
comes out; a document whose words no grade reaches counts as of mean vocabulary; copies get equal levels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ..session import materialize, superseded

#: Weight of an ungraded document against a graded one; largest change at which the iterations end, and rounds at most.
TRUST, TOLERANCE, ROUNDS = 0.05, 0.02, 60
#: Tokens of a packed row; entries of the dictionaries that one partition of words merges.
PACKED, MERGED = 400_000, 2_000_000
#: Resolutions of the similarity graph, finer ones counting more; places of the plane lie within these bounds.
SCALES, LOW, HIGH = (4, 8, 16, 32), -0.5, 1.5
#: Bands of the grade scale: up to 5 elementary, from 12 advanced. Levels between grades go to the nearer grade.
ELEMENTARY_TO, ADVANCED_FROM = 5.5, 11.5

_SENTENCE_END = r"[.!?…][\"”»“’)]*(?:\s|$)"


#: Shapes of lines that are no part of running text: bullets, headings, table rows, assignments and calls.
_ITEM = r"^\s*(?:[*•·#+|-]|\d{1,3}\))\s|\t|\|\s*$|^\s*[\w.]+\s*=|\w\([^)]*\)\s*[;{]\s*$|[{}]\s*;?\s*$"
#: All of a paragraph up to its last end mark; a capital with at most one letter after it is an abbreviation.
_LAST_END = r"^(.*(?:\p{L}{3}|(?<!\p{L})\p{Ll}{1,2}|\p{N})[\"”»“’)]*[.!?…][\"”»“’)]*)\s"


def _ends(x: Column) -> Column:
    """A line that ends as a sentence, read from its end."""
    return F.reverse(x).rlike(r"^\s*[\"”»“’)]*[.!?…]")


def _lines(text: Column) -> Column:
    """Lines with what is asked of each more than once."""
    return F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.struct(x.alias("t"), _ends(x).alias("ends"), x.rlike(_ITEM).alias("item"), (F.trim(x) == "").alias("blank")))


def _paragraphs(lines: Column) -> Column:
    """The text of ``_lines``, lines that continue a sentence joined to the one before.

    A line continues the one before if that has no end mark, neither is blank or has the shape of an item, and the one
    before is no headline: the first line of its paragraph, without any mark, before a capital, and so short
    that the next word would have fitted into it.
    """
    none = F.struct(F.lit("").alias("t"), F.lit(False).alias("ends"), F.lit(False).alias("item"), F.lit(True).alias("blank"))
    shifted = lambda by: F.slice(F.concat(F.array(*[none] * by), lines), F.lit(1), F.size(lines))
    before = F.zip_with(shifted(1), shifted(2), lambda p, q: F.struct(p.alias("p"), (q["blank"] | q["ends"]).alias("first")))

    def marked(b: Column, x: Column) -> Column:
        p, t, u = b["p"], b["p"]["t"], x["t"]
        word = F.regexp_extract(u, r"^\s*(\S+)", 1)
        headline = b["first"] & (F.length(t) < F.length(u)) & u.rlike(r"^\s*[\"“«„‘(]*\p{Lu}") & ~t.rlike(_SENTENCE_END) & ~t.rlike(r"[,;:]\s*$") & (F.length(t) + 1 + F.length(word) <= F.length(u))
        runs_on = ~p["blank"] & ~x["blank"] & ~p["ends"] & ~p["item"] & ~x["item"] & ~headline
        return F.concat(F.when(runs_on, F.lit(" ")).otherwise(F.lit("\n")), u)

    return F.split(F.array_join(F.zip_with(before, lines, marked), ""), "\n")


def prose(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, tokens, sentence_length) of documents made of prose.

    A paragraph counts as far as its last complete sentence: whole if it ends as one, else up to the last end mark
    within it, so that an unfinished tail takes no complete sentence with it.
    """
    words = r"\p{L}+[^\S\t]+\p{L}+[^\S\t]+\p{L}+"
    done = F.transform(_paragraphs(F.col("lines")), lambda x: F.when(_ends(x), x).when(~x.rlike(_ITEM), F.regexp_extract(x, _LAST_END, 1)).otherwise(""))
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    lines = F.filter(done, lambda x: x.rlike(words))
    rows = once(rows, "lines", _lines(F.col("text"))).drop("text")
    rows = once(rows, "body", F.array_join(lines, "\n")).drop("lines").filter("body <> ''")
    rows = once(rows, "tokens", F.regexp_extract_all(F.lower("body"), F.lit(r"([\p{L}]+)"), F.lit(1))).filter("size(tokens) > 0")
    n = F.size(F.regexp_extract_all("body", F.lit(f"({_SENTENCE_END})"), F.lit(1)))
    return rows.select("doc_id", "tokens", (F.size("tokens") / F.greatest(n, F.lit(1))).alias("sentence_length"))


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): median grade of the distinct ratings of a document."""
    distinct = labels.filter("doc_id is not null and grade is not null").select("doc_id", "grade", "rater").distinct()
    return distinct.groupBy("doc_id").agg(F.percentile(F.col("grade"), 0.5).alias("grade"))


# --- the document-word graph ---

_PACKED = "row long, ids array<{id}>, grades binary, words binary, cuts binary, starts binary, word binary, n binary"
_SUMS = "part int, row long, words binary, total binary, weight binary, state binary, delta double"


def _pack(docs: DataFrame, n_parts: int) -> DataFrame:
    """Documents (doc_id, hashes, grade) with their words counted, many to a row; words lie in order of partition and hash."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.hashes.map(len).to_numpy()
        flat = np.concatenate(list(pdf.hashes)).astype(np.int64)
        words, at = np.unique(flat, return_inverse=True)
        part = np.abs(words % n_parts)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        pair = np.repeat(np.arange(len(pdf)), sizes) * len(words) + place[at]
        pair, n = np.unique(pair, return_counts=True)
        starts = np.searchsorted(pair // len(words), np.arange(len(pdf) + 1))
        blob = lambda x, kind: x.astype(kind).tobytes()
        cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
        return pd.DataFrame({
            "row": [int(pdf.key.iloc[0])], "ids": [list(pdf.doc_id)], "grades": [blob(pdf.grade.to_numpy(dtype=float), np.float64)], "words": [blob(words[order], np.int64)], "cuts": [blob(cuts, np.int32)],
            "starts": [blob(starts, np.int32)], "word": [blob(pair % len(words), np.int32)], "n": [blob(n, np.float32)],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                group = pdf.hashes.map(len).cumsum() // PACKED
                for _, g in pdf.groupby(group):
                    yield one(g)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.monotonically_increasing_id().alias("key"), "hashes", "grade").mapInPandas(run, _PACKED.format(id=kind))


class _Row:
    """A packed row as arrays."""

    def __init__(self, r):
        self.grades, self.words = np.frombuffer(r.grades, np.float64), np.frombuffer(r.words, np.int64)
        self.cuts, self.starts = np.frombuffer(r.cuts, np.int32), np.frombuffer(r.starts, np.int32)
        self.word, self.n = np.frombuffer(r.word, np.int32), np.frombuffer(r.n, np.float32).astype(np.float64)
        self.doc = np.repeat(np.arange(len(self.grades)), np.diff(self.starts))

    def means(self, f: np.ndarray) -> np.ndarray:
        """The mean of each document's words; nan where no word has a value."""
        n = np.where(np.isnan(f[self.word]), 0, self.n)
        total = np.bincount(self.doc, n * np.nan_to_num(f[self.word]), len(self.grades))
        weight = np.bincount(self.doc, n, len(self.grades))
        return np.divide(total, weight, out=np.full(len(total), np.nan), where=weight > 0)

    def sums(self, row: int, mean: np.ndarray, delta: float) -> pd.DataFrame:
        """Weighted sums of the documents' values by word, one output row a partition, and one with the state."""
        graded = ~np.isnan(self.grades)
        value = np.where(graded, self.grades, mean)
        trust = np.where(graded, 1.0, TRUST) * ~np.isnan(value)
        w = self.n * trust[self.doc]
        total, weight = np.bincount(self.word, w * np.nan_to_num(value)[self.doc], len(self.words)), np.bincount(self.word, w, len(self.words))
        rows = [(p, row, self.words[a:z].tobytes(), total[a:z].tobytes(), weight[a:z].tobytes(), None, None) for p, (a, z) in enumerate(zip(self.cuts, self.cuts[1:])) if z > a]
        rows.append((-1, row, None, None, None, mean.tobytes(), delta))
        return pd.DataFrame(rows, columns=["part", "row", "words", "total", "weight", "state", "delta"])


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The means of one partition's words, given back to every row in the order of its own words."""
    words = [np.frombuffer(x, np.int64) for x in pdf.words]
    _, at = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at, np.concatenate([np.frombuffer(x, np.float64) for x in pdf.total]))
    weight = np.bincount(at, np.concatenate([np.frombuffer(x, np.float64) for x in pdf.weight]))
    f = np.divide(total, weight, out=np.full(len(total), np.nan), where=weight > 0)[at]
    ends = np.cumsum([len(x) for x in words])
    return pd.DataFrame({"row": pdf.row, "part": pdf.part, "f": [f[e - len(x) : e].tobytes() for e, x in zip(ends, words)]})


def _answered(left: pd.DataFrame, right: pd.DataFrame) -> tuple[_Row, np.ndarray]:
    return _Row(left.iloc[0]), np.frombuffer(b"".join(right.sort_values("part").f), np.float64)


def vocabulary_difficulty(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, mean): the mean difficulty of each document's words once the iterations have settled, and their number."""
    spark = docs.sparkSession
    n_tokens = docs.agg(F.sum(F.size("hashes"))).first()[0] or 0
    n_parts = max(spark.sparkContext.defaultParallelism, math.ceil(n_tokens / 4 / MERGED))
    packed = materialize(_pack(docs, n_parts), "packed")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                own = _Row(r)
                yield own.sums(r.row, np.full(len(own.grades), np.nan), math.inf)

    def step(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own, f = _answered(left, right)
        mean, before = own.means(f), np.frombuffer(left.state.iloc[0], np.float64)
        moved = np.where(np.isnan(own.grades), np.abs(mean - before), 0.0)
        reached = np.isnan(before) & ~np.isnan(mean)
        return own.sums(int(left.row.iloc[0]), mean, math.inf if reached.any() else float(np.nanmax(np.r_[moved, 0.0])))

    def last(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own, f = _answered(left, right)
        return pd.DataFrame({"doc_id": left.ids.iloc[0], "mean": own.means(f)})

    sums, rounds = materialize(packed.mapInPandas(first, _SUMS), "sums"), 0
    while True:
        words = sums.filter("part >= 0").groupBy("part").applyInPandas(_merge, "row long, part int, f binary")
        if rounds and (sums.agg(F.max("delta")).first()[0] or 0.0) <= TOLERANCE:
            break
        if rounds == ROUNDS:
            raise RuntimeError(f"difficulties did not settle within {ROUNDS} rounds")
        held = packed.join(sums.filter("part < 0").select("row", "state"), "row")
        new = materialize(held.groupBy("row").cogroup(words.groupBy("row")).applyInPandas(step, _SUMS), "sums")
        superseded(sums)
        sums, rounds = new, rounds + 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    means = packed.groupBy("row").cogroup(words.groupBy("row")).applyInPandas(last, f"doc_id {kind}, mean double")
    return means.withColumn("mean", F.when(F.isnan("mean"), None).otherwise(F.col("mean"))), rounds


# --- the similarity graph ---

_SIDE = [round((HIGH - LOW) * s) + 2 for s in SCALES]
#: Hubs of all resolutions.
HUBS = sum(n * n for n in _SIDE)


def _hubs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hubs beside places and their weights, a row each: the four corners around a place at every resolution."""
    hubs, weights, first = [], [], 0
    for s, n in zip(SCALES, _SIDE):
        u, v = (x - LOW) * s, (y - LOW) * s
        a, b = np.floor(u), np.floor(v)
        for i in (0, 1):
            for j in (0, 1):
                hubs.append((first + (a + i) * n + b + j).astype(np.int64))
                weights.append((u - a if i else a + 1 - u) * (v - b if j else b + 1 - v) * s)
        first += n * n
    return np.array(hubs).T, np.array(weights).T


def _value(hubs: np.ndarray, weights: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The weighted mean of the hubs that have a value, nan where none has."""
    f = values[hubs]
    w = np.where(np.isnan(f), 0, weights)
    total = w.sum(axis=1)
    return np.divide((w * np.nan_to_num(f)).sum(axis=1), total, out=np.full(len(total), np.nan), where=total > 0)


def harmonic_levels(placed: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, level) of ``placed`` (doc_id, grade, x, y) once the iterations have settled, and their number.

    A round adds up all documents next to the data, one row of HUBS sums a task; the HUBS means go back with the next round.
    """
    values, rounds = np.full(HUBS, np.nan), 0
    kind = placed.schema["doc_id"].dataType.simpleString()

    def sums(values: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, weight = np.zeros(HUBS), np.zeros(HUBS)
            for pdf in batches:
                hubs, w = _hubs(pdf.x.to_numpy(), pdf.y.to_numpy())
                graded = pdf.grade.notna().to_numpy()
                f = np.where(graded, pdf.grade.to_numpy(dtype=float), _value(hubs, w, values))
                w = w * (np.where(graded, 1.0, TRUST) * ~np.isnan(f))[:, None]
                total += np.bincount(hubs.ravel(), (w * np.nan_to_num(f)[:, None]).ravel(), HUBS)
                weight += np.bincount(hubs.ravel(), w.ravel(), HUBS)
            used = np.flatnonzero(weight)
            yield pd.DataFrame({"hub": used, "total": total[used], "weight": weight[used]})

        return run

    def level(values: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"doc_id": pdf.doc_id, "level": _value(*_hubs(pdf.x.to_numpy(), pdf.y.to_numpy()), values)})

        return run

    while True:
        got = placed.select("x", "y", F.col("grade").cast("double").alias("grade")).mapInPandas(sums(values), "hub long, total double, weight double")
        got = got.groupBy("hub").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight")).toPandas()  # HUBS rows at most
        new, rounds = np.full(HUBS, np.nan), rounds + 1
        new[got.hub.to_numpy()] = (got.total / got.weight).to_numpy()
        # a hub that got its first value counts as a change
        settled = np.array_equal(np.isnan(new), np.isnan(values)) and np.nanmax(np.abs(new - values), initial=0.0) <= TOLERANCE
        values = new
        if settled:
            break
        if rounds == ROUNDS:
            raise RuntimeError(f"levels did not settle within {ROUNDS} rounds")
    return placed.mapInPandas(level(values), f"doc_id {kind}, level double"), rounds


def reading_levels(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, level, band) of every prose document."""
    spark = documents.sparkSession
    docs = prose(documents, doc_id, text).withColumn("hashes", F.transform("tokens", lambda w: F.xxhash64(w))).drop("tokens")
    docs = materialize(docs.join(grades_of(labels), "doc_id", "left"), "prose")
    empty = spark.createDataFrame([], f"doc_id {documents.schema[doc_id].dataType.simpleString()}, level double, band string")
    if docs.filter("grade is not null").isEmpty():
        return empty
    # graded documents too get the mean of their words, so that they lie where ungraded ones like them do
    means, _ = vocabulary_difficulty(docs.select("doc_id", "hashes", "grade"))
    placed = materialize(docs.select("doc_id", "grade", F.log("sentence_length").alias("len")).join(means, "doc_id"), "placed")
    box = placed.filter("grade is not null").agg(F.min("mean").alias("m0"), F.max("mean").alias("m1"), F.avg("mean").alias("m"), F.min("len").alias("l0"), F.max("len").alias("l1")).first()

    def place(c: Column, lo: float, hi: float) -> Column:
        return F.least(F.greatest((c - lo) / max(hi - lo, 1e-9), F.lit(LOW)), F.lit(HIGH))

    placed = placed.select("doc_id", "grade", place(F.coalesce("mean", F.lit(box["m"])), box["m0"], box["m1"]).alias("x"), place(F.col("len"), box["l0"], box["l1"]).alias("y"))
    levels, _ = harmonic_levels(placed)
    level = F.col("level")
    band = F.when(level < ELEMENTARY_TO, "elementary").when(level >= ADVANCED_FROM, "advanced").otherwise("intermediate")
    return levels.select("doc_id", F.round("level", 3).alias("level"), band.alias("band"))
