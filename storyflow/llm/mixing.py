"""Mixing sources to target token shares by entropy balancing.

Every document of a listed source gets a rate r = min(cap, exp(lambda_s * t)), the exponential tilt of the uniform
design by its size t (tokens over the source's mean), with the rates closest to 1 in relative entropy that meet
the source's token target. The dual is convex with one unknown per source; Newton steps use sums over
the size histogram of each source (documents of one source and size have one rate); the state of all sources is a table,
so a round is one join and aggregation, and only counts reach the driver. Rates are rounded to whole copies by
systematic sampling within salted cells of about ``cell_docs`` documents of a source, which keeps every cell's copies within one of their
expected number.

A source whose capped supply falls short of its target gives every document ``max_repeats`` times; its missing share is
reported, not handed to others.

Defined results: documents of unlisted sources and with null source are left out; documents without tokens get no
copy; a listed source without documents is reported with zero tokens; a target listed twice is added up with the
smaller cap; no target at all gives an empty mixture.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, superseded

#: Where the vocabularies of public tokenizers lie; a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how text is cut before byte pairs are merged (the pattern published with byte-level BPE).
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str, vocabulary: bytes):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("counted", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, keep: list[str], tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, ``keep`` and ``n_tokens`` of the whole text (0 for null and empty).

    ``tokenizer`` is the path of a vocabulary file on the driver; without it ``spark.storyflow.tokenizer`` names one. The file,
    about a megabyte, is broadcast, so executors need no copy.
    """
    spark = docs.sparkSession
    path = tokenizer or spark.conf.get("spark.storyflow.tokenizer", TOKENIZER)
    with open(path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path, vocabulary.value)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf[text]]
            yield pdf.drop(columns=[text]).assign(n_tokens=pd.Series(n, dtype="int64", index=pdf.index))

    kept = docs.select(doc_id, *keep, text)
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.drop(text).dtypes) + ", n_tokens long"
    return kept.mapInPandas(count, schema)


#: What stands for an endless lambda: every document at its cap, or none at all.
_ALL = 1e6


def _solve(histogram: DataFrame, goals: DataFrame, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """``goals`` (source, goal, mean, cap, lam; null where it is to be found) with ``lam``, by safeguarded Newton steps on the dual.

    A round is one aggregation of the histogram joined with the state of all sources; only the number of open sources reaches the driver.
    """
    state = goals.select("*", F.col("lam").isNull().alias("open"), F.lit(-700.0).alias("low"), F.lit(700.0).alias("high")).withColumn("lam", F.coalesce("lam", F.lit(0.0)))
    state = materialize(state, "dual")
    for _ in range(rounds):
        if state.filter("open").isEmpty():
            break
        t = F.col("n_tokens") / F.col("mean")
        tilt = F.col("lam") * t
        rate = F.when(tilt >= F.log("cap"), F.col("cap")).otherwise(F.exp(tilt))
        free = F.when(tilt < F.log("cap"), F.exp(tilt) * t).otherwise(0.0)
        sums = histogram.join(state.filter("open").select("source", "lam", "mean", "cap"), "source").groupBy("source").agg(F.sum(rate * F.col("n_tokens") * F.col("n")).alias("got"), F.sum(free * F.col("n_tokens") * F.col("n")).alias("slope"))
        both = state.join(sums, "source", "left").withColumn("miss", F.col("got") - F.col("goal"))
        met = F.abs("miss") <= tolerance * F.greatest("goal", F.lit(1.0))
        both = both.withColumns({"high": F.when(F.col("open") & ~met & (F.col("miss") > 0), F.col("lam")).otherwise(F.col("high")), "low": F.when(F.col("open") & ~met & (F.col("miss") <= 0), F.col("lam")).otherwise(F.col("low"))})
        step = F.col("lam") - F.try_divide("miss", "slope")
        moved = F.when((step > F.col("low")) & (step < F.col("high")), step).otherwise((F.col("low") + F.col("high")) / 2)
        closed = met | (F.col("high") - F.col("low") < 1e-13)
        new = both.select("source", "goal", "mean", "cap", F.when(F.col("open") & ~met, moved).otherwise(F.col("lam")).alias("lam"), (F.col("open") & ~closed).alias("open"), "low", "high")
        new = materialize(new, "dual")
        superseded(state)
        state = new
    return state.select("source", "goal", "mean", "cap", "lam")


class Mixture:
    """Token counts of the listed sources, the balanced rates and the copies drawn from them."""

    def __init__(self, docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str | None = None, cell_docs: int = 50_000):
        self.spark, self.doc_id = docs.sparkSession, doc_id
        listed = targets.filter("source is not null and target_share is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
        total = listed.agg(F.sum("target_share")).first()[0] or 1.0
        #: (source, target_share, max_repeats), shares that sum up to one
        self.targets = materialize(listed.withColumn("target_share", F.col("target_share") / total), "targets")
        own = docs.select(doc_id, F.col(source).alias("source"), text).join(self.targets.select("source"), "source", "left_semi")
        self.sized = materialize(token_counts(own, doc_id, text, ["source"], tokenizer), "tokens")
        histogram = materialize(self.sized.filter("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "sizes")
        supply = histogram.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"))
        self.wanted = supply.agg(F.sum("tokens")).first()[0] or 0
        cap = F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).cast("double")
        goals = self.targets.join(supply, "source").select("source", (F.col("target_share") * self.wanted).alias("goal"), (F.col("tokens") / F.col("docs")).alias("mean"), cap.alias("cap"), "tokens", F.ceil(F.col("docs") / cell_docs).alias("cells"))
        lam = F.when((F.col("goal") >= F.col("cap") * F.col("tokens")) | (F.col("cap") == 0), F.lit(_ALL)).when(F.col("goal") <= 0, F.lit(-_ALL))
        goals = materialize(goals.withColumn("lam", lam), "goals")
        #: (source, lam, mean, cap, cells) of every listed source with documents
        self.rates = materialize(_solve(histogram, goals.select("source", "goal", "mean", "cap", "lam")).join(goals.select("source", "cells"), "source").select("source", "lam", "mean", "cap", "cells"), "rates")

    def copies(self) -> DataFrame:
        """(doc_id, source, n_tokens, rate, copies) of every document of a listed source, also those without a copy."""
        rows = self.sized.join(self.rates, "source", "left")
        tilt = F.col("lam") * F.col("n_tokens") / F.col("mean")
        rate = F.when((F.col("n_tokens") > 0) & (F.col("cap") > 0), F.when(tilt >= F.log("cap"), F.col("cap")).otherwise(F.exp(tilt))).otherwise(0.0)
        rows = rows.select(self.doc_id, "source", "n_tokens", rate.alias("rate"), F.pmod(F.xxhash64(self.doc_id), F.coalesce("cells", F.lit(1))).alias("cell"))
        # systematic rounding of token mass within a cell: sizes in order, so that neighbours replace one another
        order = Window.partitionBy("source", "cell").orderBy("n_tokens", F.xxhash64(self.doc_id, F.lit(5)), self.doc_id)
        start = F.pmod(F.xxhash64("source", "cell"), F.lit(1_000_003)) / F.lit(1_000_003.0)
        upto = F.sum("rate").over(order.rowsBetween(Window.unboundedPreceding, 0)) + start
        rows = rows.withColumn("_to", F.floor(F.round(upto, 9)))
        before = F.coalesce(F.lag("_to").over(order), F.floor(F.round(start, 9)))
        return rows.withColumn("copies", (F.col("_to") - before).cast("int")).select(self.doc_id, "source", "n_tokens", F.round("rate", 6).alias("rate"), "copies")

    def shares(self) -> DataFrame:
        """One row per target: wanted and reached tokens and shares, documents used, most copies of one document."""
        got = self.copies().groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.sum(F.when(F.col("copies") > 0, 1).otherwise(0)).alias("docs_used"), F.max("copies").alias("most_copies"))
        want = self.targets.select("source", "target_share", F.round(F.col("target_share") * self.wanted).cast("long").alias("target_tokens"), "max_repeats")
        rows = materialize(want.join(got, "source", "left").fillna(0, ["tokens", "docs_used", "most_copies"]), "reached")
        reached = rows.agg(F.sum("tokens").alias("all_tokens"))  # one row
        return rows.crossJoin(F.broadcast(reached)).select("source", "target_share", "target_tokens", "max_repeats", "tokens", F.round(F.try_divide("tokens", F.lit(self.wanted)), 6).alias("share_of_wanted"), F.round(F.try_divide("tokens", "all_tokens"), 6).alias("actual_share"), "docs_used", "most_copies")
