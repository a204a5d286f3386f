"""Calls of an external model around a cache keyed by the hash of model and input.

The model is an injected function over a list of texts; it runs next to the data in Arrow batches and only for inputs
that are not cached. Results keep the order of their inputs by position.

Defined results: null input counts as empty text; equal inputs are asked once; a function that returns another number of results than
it was given texts is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def input_hash(model: str, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(model), F.coalesce(text, F.lit(""))), 256)


def embedding_text(title: Column, summary: Column, content: Column, summary_chars: int = 1000, content_chars: int = 500, most: int = 3000) -> Column:
    """What is embedded of an article: title, start of summary and of content on lines of their own, cut to ``most`` characters."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.substring(F.concat_ws("\n", blank(title), F.substring(blank(summary), 1, summary_chars), F.substring(blank(content), 1, content_chars)), 1, most)


def split_by_cache(rows: DataFrame, hash_col: str, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their cached ``result``, and the distinct hashes with inputs that are still to be asked."""
    known = cache.select(F.col(hash_col), "result")
    return rows.join(known, hash_col), rows.join(known, hash_col, "left_anti")


def ask(inputs: DataFrame, hash_col: str, text_col: str, model: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(hash, result array<double>) of each distinct input, in calls of at most ``batch`` texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a in range(0, len(pdf), batch):
                texts = pdf[text_col].iloc[a : a + batch].fillna("").tolist()
                got = model(texts)
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} results for {len(texts)} texts")
                out += got
            yield pd.DataFrame({hash_col: pdf[hash_col], "result": out})

    return inputs.select(hash_col, text_col).dropDuplicates([hash_col]).mapInPandas(run, f"{hash_col} string, result array<double>")


def cached_results(rows: DataFrame, text_col: str, cache: DataFrame, name: str, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """``rows`` with ``input_hash`` and ``result``, asked of the model only where the cache has none."""
    hashed = rows.withColumn("input_hash", input_hash(name, F.col(text_col)))
    hit, miss = split_by_cache(hashed, "input_hash", cache)
    return hit.unionByName(miss.join(ask(miss, "input_hash", text_col, model), "input_hash").select(*hit.columns))


def valid_answer(text: str | None, schema: dict[str, type | tuple[type, ...]]) -> tuple[dict | None, str | None]:
    """(answer, None) of a text that is or holds one JSON object with the demanded fields, else (None, what is wrong)."""
    if text is None:
        return None, "missing"
    value = None
    for part in (text, text[text.find("{") : text.rfind("}") + 1] if "{" in text else ""):
        try:
            value = json.loads(part)
            break
        except ValueError:
            continue
    if not isinstance(value, dict):
        return None, "no JSON object"
    for name, kind in schema.items():
        if name not in value:
            return None, f"{name} missing"
        if not isinstance(value[name], kind) or (isinstance(value[name], bool) and kind is not bool):
            return None, f"{name} of another type"
    return {k: value[k] for k in schema}, None


def ask_structured(inputs: DataFrame, key: str, text_col: str, model: Callable[[list[str]], list[str | None]], schema: dict[str, type | tuple[type, ...]], batch: int = 16, attempts: int = 3, fallback: Callable[[list[str]], list[str | None]] | None = None) -> DataFrame:
    """(key, answer, attempts, error): answers as JSON objects with the demanded fields.

    Inputs are asked ``batch`` at a time; those left out or broken are asked again one by one, up to ``attempts`` calls in all, then
    once of ``fallback``. What is still broken has a null answer and the last error. A failing call counts as broken answers.
    """

    def called(f, texts):
        try:
            got = list(f(texts))
        except Exception as e:  # an unreachable model is an answer too
            return [(None, f"{type(e).__name__}: {e}"[:200])] * len(texts)
        return [valid_answer(x, schema) for x in (got + [None] * len(texts))[: len(texts)]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                texts = part[text_col].fillna("").tolist()
                for k, text, (answer, error) in zip(part[key], texts, called(model, texts)):
                    n = 1
                    while answer is None and n < attempts:
                        (answer, error), n = called(model, [text])[0], n + 1
                    if answer is None and fallback is not None:
                        (answer, error), n = called(fallback, [text])[0], n + 1
                    rows.append((k, json.dumps(answer, sort_keys=True, ensure_ascii=False) if answer is not None else None, n, error))
            yield pd.DataFrame(rows, columns=[key, "answer", "attempts", "error"])

    return inputs.select(key, text_col).dropDuplicates([key]).mapInPandas(run, f"{key} {inputs.schema[key].dataType.simpleString()}, answer string, attempts long, error string")
