"""Small fixtures for every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyflow.llm.components import connected_groups
from storyflow.llm.encoding import garbled_fields, misread, restore, sequences
from storyflow.llm.history_dedup import HistoryStore, key_prints, settle_batches, text_prints, winnow
from storyflow.llm.knn import nearest_neighbours, usable_vectors
from storyflow.llm.leakage import LeakIndex
from storyflow.llm.mixing import Mixture, token_counts
from storyflow.llm.reading_level import reading_levels
from storyflow.llm.set_join import SimilarSets, max_difference, segments_of


# --- encoding -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252", "mac_roman", "cp437", "cp1251", "cp850"])
def test_round_trip(encoding):
    text = "L’été à Zürich: ça coûte «cher» – “oui” für Ñandú, ÇÃO"
    assert restore(misread(text, encoding))[0] == text
    assert restore(text) == (text, 0, 0)


def test_twice_and_mixed():
    assert restore(misread(misread("café", "cp1252"), "cp1252"))[0] == "café"
    assert restore("naïve " + misread("über", "latin-1"))[0] == "naïve über"
    assert restore("AÇÃO «é» ß“ &eacute;")[1] == 0
    assert restore("caf�")[1:] == (1, 1) and restore(None) == (None, 0, 0) and restore("") == ("", 0, 0)
    assert all(len(k) > 1 or k == "�" for k in sequences())


@pytest.mark.parametrize("text", ["Привет, как дела?", "Καλημέρα κόσμε", "日本語のテキスト", "Łódź", "Příliš žluťoučký kůň", "Tiếng Việt"])
def test_other_alphabets(text):
    for encoding in ("cp1252", "latin-1"):
        assert restore(misread(text, encoding)) == (text, restore(misread(text, encoding))[1], 0)


@pytest.mark.parametrize(("true", "read_as", "text"), [
    ("cp1252", "mac_roman", "La crème brûlée de l'été à Genève"), ("mac_roman", "cp1252", "La crème brûlée de l'été à Genève"), ("cp1252", "cp1251", "La crème brûlée de l'été"),
    ("cp1252", "cp437", "größer Müller schön"), ("cp1252", "cp850", "größer Müller schön"), ("cp1251", "latin-1", "Привет, добрый день"), ("koi8-r", "cp1251", "Привет, добрый день"),
])
def test_single_byte_pairs(true, read_as, text):
    got, spans, lost = restore(misread(text, read_as, true))
    assert got == text and spans and not lost


@pytest.mark.parametrize("text", ["ГЁ", "«В©»", "Вµ", "┬░", "Рёбра и ГЁ", "été»…", "┌─┬░┐", "œuvre Œdipe l’ÉTÉ", "McÉvoy", "naïve Ñandú – «año»", "Съешь ещё этих мягких булок", "Ελληνικά κείμενα", "Île-d’Yeu Paris–Nice col·lecció Lego®"])
def test_correct_text_stays(text):
    assert restore(text) == (text, 0, 0)


def test_lost_bytes_are_counted():
    assert restore("M\x81ller")[1:] == (1, 1)


def test_garbled_fields(spark):
    long = "x" * 200_000 + misread("é", "latin-1")
    df = spark.createDataFrame([(1, "CafÃ©", None, "k"), (2, "", "plain é", "k"), (3, long, "�", "k"), (1, "CafÃ©", None, "k")], "id long, title string, summary string, key string")
    got = sorted((r.key, r.field, r.n_lost) for r in garbled_fields(df, "id", ["title", "summary"]).collect())
    assert got == [(1, "title", 0), (1, "title", 0), (3, "summary", 1), (3, "title", 0)]
    assert garbled_fields(df.limit(0), "id", ["title"]).count() == 0


# --- components -----------------------------------------------------------------------------------------------------


def groups(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {(find(x), x) for x in parent}


@pytest.mark.parametrize("max_levels", [1, 30])
def test_components(spark, max_levels):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1020)] + [(0, i) for i in range(2000, 2030)] + [(4, 4), (None, 1), (2, None)]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in edges], "l long, r long, u int, v int")
    assert {(r.group_id, r.member) for r in connected_groups(df, "l", "r", max_levels).collect()} == groups(edges)
    assert connected_groups(df.limit(0), "l", "r").count() == 0


# --- history --------------------------------------------------------------------------------------------------------


def test_winnow_guarantee():
    import pandas as pd

    rng = random.Random(1)
    shared = "".join(rng.choices("abcdef", k=40))
    a, b = winnow(pd.Series(["prefix-one-" + shared + "-x", "another start " + shared + " and end"]), 12, 24)
    assert set(a) & set(b)
    assert winnow(pd.Series([""]), 12, 24)[0].size == 1 and winnow(pd.Series([], dtype=str)) == []


def prints(spark, rows):
    return key_prints(spark.createDataFrame(rows, "id long, batch int, key string"))


def test_batches(spark):
    rows = [(1, 0, "u a"), (2, 0, "u b"), (2, 0, "g 1"), (3, 1, "u a"), (4, 1, "u c"), (4, 1, "g 1"), (5, 1, "u c"), (6, 2, None), (7, 2, "u c"), (7, 2, "g 9"), (7, 2, "u c"), (8, 2, "u d" + "x" * 50_000), (9, 2, "u d" + "x" * 50_000)]
    for together in (1, 3):
        got = {(r.first_id, r.id) for r in settle_batches(prints(spark, rows), together=together).collect()}
        assert got == {(1, 3), (2, 4), (4, 5), (4, 7), (8, 9)}
    # earlier means by batch, then by id
    assert {(r.first_id, r.id) for r in settle_batches(prints(spark, [(10, 0, "k"), (5, 1, "k"), (11, 2, "k"), (11, 3, "k")])).collect()} == {(10, 5), (10, 11)}
    assert settle_batches(prints(spark, rows).limit(0)).count() == 0


def test_store_survives_small_filters_and_goes_on(spark):
    """Filters far too small raise lookups, never matches; opened again, the store knows all; compaction loses nothing."""
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdefghij ", k=400)) for _ in range(30)]
    store = HistoryStore(spark, 2, prints_per_part=1)
    assert store.process(prints(spark, [(i, 0, t) for i, t in enumerate(texts)])).count() == 0
    assert store.process(prints(spark, [(100, 1, texts[4][:380] + "zzz")])).count() == 0
    again = HistoryStore(spark, 2, store.path)
    again.COMPACT = 1
    for n, (key, first) in enumerate([(texts[3], [3]), (texts[4][:380] + "zzz", [100]), ("new " * 30, []), ("new " * 30, [702])]):
        assert [r.first_id for r in again.process(prints(spark, [(700 + n, 2 + n, key)])).collect()] == first


def test_near_texts_equal_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for i in range(120):
        if texts and rng.random() < 0.7:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(50))
        else:
            w = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 8, 40, 90]))]
        texts.append(" ".join(w))
    texts += ["shared boilerplate line of a feed that stands in every text of it " * 3 + f"own{i} words{i} here{i}" for i in range(30)]
    rows = [(i, i * 5 // len(texts), t) for i, t in enumerate(texts)] + [(900, 4, None), (901, 4, "..."), (902, 4, "")]
    df = text_prints(spark.createDataFrame(rows, "id long, batch int, text string"))
    fps = {r.id: (r.batch, set(r.fps)) for r in df.collect()}
    want = set()
    for i, (b, f) in fps.items():
        earlier = [(bb, j) for j, (bb, g) in fps.items() if (bb, j) < (b, i) and len(f & g) >= 0.8 * max(len(f), len(g)) - 1e-9]
        if earlier:
            want.add((min(earlier)[1], i))
    got = {(r.first_id, r.id) for r in settle_batches(df, 0.8, together=2).collect()}
    assert got == want and len(want) > 30


def test_rows_read_do_not_grow_with_the_history(spark):
    """A batch opens the partitions its positives fall into, whatever lies in the others."""
    read = []
    for n in (400, 4000):
        store = HistoryStore(spark, n, prints_per_part=100)
        plain = store._read
        store.process(prints(spark, [(i, 0, f"key number {i} of the history") for i in range(n)]))
        seen = []
        store._read = lambda kind, schema, parts: (lambda df: (seen.append(df.count()) if kind == "postings" else None, df)[1])(plain(kind, schema, parts))
        assert [r.first_id for r in store.process(prints(spark, [(n, 1, "key number 7 of the history")])).collect()] == [7]
        read.append(sum(seen))
    assert 0 < read[1] <= 3 * read[0] and read[1] < 400


# --- sets -----------------------------------------------------------------------------------------------------------


def jaccard_pairs(rows, t=(7, 10)):
    word = re.compile(r"[^\W_]+")
    sets = {i: set(word.findall(f"{a} {b}".lower())) for i, a, b in rows if (a or "").strip() and (b or "").strip()}
    ids = sorted(i for i in sets if sets[i])
    return {(i, j) for n, i in enumerate(ids) for j in ids[n + 1 :] if len(sets[i] & sets[j]) * t[1] >= len(sets[i] | sets[j]) * t[0]}


def test_similar_sets_equal_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(400)]
    rows = []
    for i in range(160):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[2].split()
            for _ in range(rng.randrange(0, max(1, len(words) // 4) + 1)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            words = words[: rng.randrange(max(1, int(len(words) * 0.7)), len(words) + 1)]
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 9, 14, 23, 24, 30, 47, 48, 70]))
        rows.append((i, "t", " ".join(words)))
    rows += [(900, None, "x"), (901, "x", " "), (902, "...", "!!"), (903, "long", "a b " * 30_000), (904, "Long", "A; b"), (5, *rows[5][1:])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "aid long, title string, summary string, id string, n int")
    similar = SimilarSets(df, "aid", ["title", "summary"], "0.7")
    got = {(r.a, r.b) for r in similar.expanded(similar.pairs(buckets=3)).collect()}
    assert got == jaccard_pairs({r[0]: r for r in rows}.values())
    empty = SimilarSets(df.limit(0), "aid", ["title", "summary"])
    assert empty.expanded(empty.pairs()).count() == 0


def test_hot_lists_are_sliced_without_loss(spark, monkeypatch):
    from storyflow.llm import set_join

    monkeypatch.setattr(set_join, "HOT_LIST", 0.0)
    monkeypatch.setattr(set_join, "SLICE", 10)
    rng = random.Random(8)
    rows = [(i, "a b c", " ".join(rng.choices("defghijklm", k=12))) for i in range(60)]
    similar = SimilarSets(spark.createDataFrame(rows, "id long, t string, s string"), "id", ["t", "s"], "0.8")
    assert {(r.a, r.b) for r in similar.expanded(similar.pairs(buckets=5)).collect()} == jaccard_pairs(rows, (8, 10))


def test_a_key_of_a_third_of_all_sets_is_measured_avoided_and_sliced(monkeypatch):
    """Sets with one template of rare words: no frequency tells it, the count does; slices share the list evenly."""
    from storyflow.llm import set_join

    rng = np.random.default_rng(5)
    template = np.arange(1000, 1016, dtype=np.int64)
    plain = [np.sort(rng.choice(100_000, 30, replace=False)).astype(np.int64) + 5000 for _ in range(400)]
    sets = plain + [np.concatenate([template, np.sort(t[:14])]) for t in plain[:200]]
    ids, none = np.arange(len(sets)), np.zeros(0, np.int64)
    batch = lambda hot: set_join._Batch(ids, sets, none, np.zeros(0), -6.0, len(sets), 30.0, hot)
    m, need = segments_of(4, __import__("fractions").Fraction(7, 10)), np.full(len(sets), max_difference(60, __import__("fractions").Fraction(7, 10)) + 1)
    before = batch(None)
    k = before.keys(ids, 4, m, need, True)
    key, n = np.unique(k.key, return_counts=True)
    told = n >= 150
    assert told.any()
    b = batch((key[told], n[told]))
    k = b.keys(ids, 4, m, need, True)
    on_hot = lambda k, keys: int((np.isin(k.key, keys) & (((k.how.to_numpy() >> 1) & 3) > 0)).sum())
    full = key[told]
    assert (k.hot.to_numpy() > 0).sum() == n[told].sum()
    assert on_hot(k, full) <= on_hot(before.keys(ids, 4, m, need, True), full)
    monkeypatch.setattr(set_join, "SLICE", 20)
    bucket = (k.key.to_numpy() % np.uint64(1009)).astype(np.int64)
    place, _, out = set_join._sliced(bucket, b, k, 1009)
    index = (out.how.to_numpy() & 8) > 0
    assert index.sum() == ((k.how.to_numpy() & 8) > 0).sum()  # every index entry in exactly one slice
    one = out.key.to_numpy() == full[np.argmax(n[told])]
    most = np.bincount(place[one & index]).max()
    assert most <= 3 * set_join.SLICE  # of a list of hundreds


def test_allocation_can_always_cover():
    from fractions import Fraction

    from storyflow.llm.set_join import _BAND_TOPS

    for t in (Fraction(7, 10), Fraction(8, 10), Fraction(1, 2)):
        for band in range(12):
            m, top = segments_of(band, t), int(_BAND_TOPS[band])
            assert 2 * m >= max_difference(2 * top, t) + 1
            assert 2 * m >= max_difference(int(top / t) + top, t) + 1


# --- vectors --------------------------------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).round(3)
    x[50:80] = x[10]
    x[90] = 3 * x[10]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(400, None, 1), (401, [0.0] * 8, 1), (402, [1.0], 1), (403, [float("nan")] * 8, 1), (404, [float("inf")] + [1.0] * 7, 1), (405, [None] * 8, 1), (7, x[7].tolist(), 1)]
    df = spark.createDataFrame(rows, "vid long, v array<double>, id int")
    found, info = nearest_neighbours(usable_vectors(df, "vid", "v", 8), 5, leaf_rows=20, recall=1.0)
    got = {}
    for r in found.collect():
        got.setdefault(r.q, set()).add(r.id)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = total = 0
    for q in range(300):
        sim = np.round(u @ u[q], 6)
        want = {j for _, j in sorted((-sim[j], j) for j in range(300) if j != q)[:5]}
        hits += len(want & got[q])
        total += 5
        assert len(got[q]) == 5
    assert set(got) == set(range(300)) and hits / total >= 0.97 and info["leaves"] > 5
    assert got[60] == {10, 50, 51, 52, 53} and got[10] == {50, 51, 52, 53, 54}  # ties to the smaller id
    assert nearest_neighbours(usable_vectors(df.limit(0), "vid", "v", 8), 5)[0].count() == 0
    assert nearest_neighbours(usable_vectors(df.filter("vid < 3"), "vid", "v", 8), 5)[0].count() == 6


def test_deep_trees_crowded_buckets_and_a_bounded_driver(spark, monkeypatch):
    """Trees below the upper one, buckets cut into blocks; what reaches the driver doesn't grow with the vectors."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from storyflow.llm import knn

    for name, value in (("SAMPLE", 120), ("CALIBRATE", 16), ("BRANCHES", 4), ("BUCKET", 32), ("BLOCK", 40), ("ONE_IN", 2), ("BELOW", 2)):
        monkeypatch.setattr(knn, name, value)
    taken = []
    for how in ("toPandas", "collect"):
        plain = getattr(Classic, how)
        monkeypatch.setattr(Classic, how, lambda self, plain=plain: (lambda r: (taken.append(len(r)), r)[1])(plain(self)))
    rng = np.random.default_rng(6)
    most = []
    for n in (300, 2400):
        x = rng.normal(size=(n, 6)).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
        taken.clear()
        found, info = nearest_neighbours(usable_vectors(df, "id", "v", 6), 3, leaf_rows=16, recall=0.99)
        most.append((sum(taken), max(taken)))
        got = {}
        for r in found.toPandas().itertuples():
            got.setdefault(r.q, set()).add(r.id)
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
        hits = 0
        for q in range(n):
            sim = np.round(u @ u[q], 6)
            sim[q] = -9
            hits += len(set(np.lexsort((np.arange(n), -sim))[:3]) & got[q])
        assert info["below"] > 0 and hits / (3 * n) >= 0.9
    assert most[0] == most[1]


# --- leakage --------------------------------------------------------------------------------------------------------


def test_leaks(spark):
    w = [f"t{i}" for i in range(40)]
    docs = [(1, "The start. " + "; ".join(w[5:17]).upper() + " end"), (2, " ".join(w[5:16])), (3, None), (4, ""), (5, "the " * 50_000 + " ".join(w[20:40])), (6, " ".join(w[0:10]) + " broken " + " ".join(w[11:21])), (7, "; ".join(w[5:17])), (7, "; ".join(w[5:17]))]
    items = [(10, " ".join(w)), (11, "a short item"), (12, None), (13, " ".join(w[5:17])), (14, "the " * 14)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, term int")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, pos int")
    found = {(r.doc_id, r.item_id): r.kind for r in LeakIndex.build(d).matches(i).collect()}
    assert {k for k, v in found.items() if v == "exact"} == {(1, 10), (1, 13), (5, 10), (5, 14), (7, 10), (7, 13)}
    assert found[(6, 10)] == "near" and (2, 10) not in {k for k, v in found.items() if v == "exact"}
    assert LeakIndex.build(d.limit(0)).matches(i).count() == 0 and LeakIndex.build(d).matches(i.limit(0)).count() == 0


def test_near_leaks_survive_chance_agreement_and_edited_rare_words(spark):
    w = [f"t{i}" for i in range(60)]
    passage = w[0:5] + ["x"] + w[6:10] + ["y"] + w[11:14]  # 12 of 14 words
    chance = passage + [f"z{i}" for i in range(14, 50)] + [w[50]]  # one more agreeing word far behind
    common = " ".join(w[:5] + w[6:10] + w[11:60])
    # t5 and t10 are the rarest words of the windows over them, elsewhere in the corpus only
    docs = [(1, " ".join(passage)), (2, " ".join(chance)), (3, " ".join(w[0:5] + ["x"] + w[6:9] + ["v", "y"] + w[11:14])), (4, "t5 and t10")]
    docs += [(10 + i, " ".join(reversed(common.split()))) for i in range(5)]
    found = LeakIndex.build(spark.createDataFrame(docs, "doc_id long, text string")).matches(spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.kind) for r in found} == {(1, "near"), (2, "near")}


def test_gaps_and_a_second_set_of_items(spark, tmp_path):
    """Insertions and deletions are proximity matches; the stored index answers anew without the documents."""
    import shutil

    w = [f"t{i}" for i in range(60)]
    docs = [(1, " ".join(w[0:6] + ["new", "words"] + w[6:12])), (2, " ".join(w[20:26] + w[28:34])), (3, " ".join(w[0:6] + ["x"] * 6 + w[6:12])), (4, " ".join(w[40:60]))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    index = LeakIndex.build(spark.read.parquet(f"{tmp_path}/docs"))
    item = spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")
    assert {(r.doc_id, r.kind, r.agreeing) for r in index.matches(item).collect()} == {(1, "near", 12), (2, "near", 12), (4, "exact", 20)}
    shutil.rmtree(f"{tmp_path}/docs")
    again = LeakIndex(spark, index.path)
    second = spark.createDataFrame([(8, " ".join(w[41:53])), (9, "nothing " * 20)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.kind) for r in again.matches(second).collect()] == [(4, 8, "exact")]


def test_near_leaks_equal_brute_force(spark):
    from storyflow.llm.leakage import longest_chain

    rng = random.Random(12)
    items = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([12, 14, 20, 40]))] for _ in range(12)]
    docs = []
    for _ in range(60):
        body = list(rng.choice(items))
        for _ in range(rng.randrange(0, 7)):
            at = rng.randrange(len(body))
            body[at : at + rng.randrange(0, 2)] = [f"z{rng.randrange(9)}"] * rng.randrange(0, 3)
        docs.append([f"w{rng.randrange(60)}" for _ in range(rng.randrange(20))] + body + ["end"])
    code = {}
    num = lambda ws: np.array([code.setdefault(x, len(code)) for x in ws])
    want = {(d, i) for d, dw in enumerate(docs) for i, iw in enumerate(items) if longest_chain(num(dw), num(iw), 16) >= 12}
    df = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(docs)], "doc_id long, text string")
    got = LeakIndex.build(df).matches(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 20


# --- mixing ---------------------------------------------------------------------------------------------------------


def test_mixture(spark):
    rng = random.Random(9)
    docs = [(i, "abc"[i % 3] if i % 10 else None, "word " * rng.randrange(1, 80)) for i in range(600)] + [(9000, "a", None), (9001, "a", ""), (9002, "zz", "unlisted text")]
    targets = spark.createDataFrame([("a", 0.5, 4), ("b", 0.2, 1), ("c", 0.2, 2), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    m = Mixture(spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, source string, text string, rate double"), targets)
    rows = {r.doc_id: r for r in m.copies().collect()}
    assert 9002 not in rows and rows[9000].copies == rows[9001].copies == 0
    assert max(r.copies for r in rows.values() if r.source == "b") <= 1 and max(r.copies for r in rows.values()) <= 4
    s = {r.source: r for r in m.shares().collect()}
    for k in "abc":
        assert abs(s[k].tokens - s[k].target_tokens) <= 0.01 * s[k].target_tokens
    assert s["gone"].tokens == 0
    short = Mixture(spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], "source string, target_share double, max_repeats int"))
    assert all(r.copies == 1 for r in short.copies().filter("source = 'a' and n_tokens > 0").collect())
    assert Mixture(spark.createDataFrame(docs, "doc_id long, source string, text string").limit(0), targets).copies().count() == 0
    assert token_counts(spark.createDataFrame(docs, "doc_id long, source string, text string"), "doc_id", "text", []).filter("n_tokens > 0").count() == 601


# --- reading level --------------------------------------------------------------------------------------------------


def test_levels(spark):
    rng = random.Random(4)
    easy, hard = [f"cat{chr(97 + i)}" for i in range(20)], [f"institutional{chr(97 + i)}isation" for i in range(20)]

    def text(words, length, n=6):
        return " ".join(" ".join(rng.choices(words, k=length)).capitalize() + "." for _ in range(n))

    kinds = {"elementary": (easy, 7, 3), "advanced": (hard, 30, 14), "long": (easy, 30, 9), "hard": (hard, 7, 8)}
    docs, labels, want = [], [], {}
    for i in range(160):
        name = list(kinds)[i % 4]
        words, length, grade = kinds[name]
        docs.append((i, text(words, length)))
        want[i] = name if name in ("elementary", "advanced") else "intermediate"
        if i < 60:
            labels += [(i, grade, "r"), (i, grade, "r"), (i, grade + 1, "s")]
    docs += [(900, None), (901, ""), (902, "* a list (3)\n* of items (4)"), (903, "a\t1\nb\t2"), (904, "x_0 = f(1);")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, level int")
    lab = spark.createDataFrame(labels, "doc_id long, grade int, rater string")
    got = {r.doc_id: r.band for r in reading_levels(d, lab).collect()}
    assert got == want
    assert reading_levels(d.limit(0), lab).count() == 0 and reading_levels(d, lab.limit(0)).count() == 0


def test_vocabulary_equals_plain_iterations(spark, monkeypatch):
    """Packed rows, partitions of words and states give what a plain loop over documents and words gives."""
    from storyflow.llm import reading_level as R

    monkeypatch.setattr(R, "PACKED", 60)
    rng = random.Random(11)
    docs = {i: [rng.choice([1, 2, 3, 10 + i // 6, 10 + (i + 3) // 6]) for _ in range(rng.randrange(1, 20))] for i in range(60)}
    docs[90] = [777, 777]  # no grade reaches it
    docs[91] = docs[5]
    grade = {i: float(i % 7 + 1) for i in docs if i % 5 == 0 and i != 90}
    rows = [(i, w, grade.get(i)) for i, w in docs.items()]
    means, rounds = R.vocabulary_difficulty(spark.createDataFrame(rows, "doc_id long, hashes array<long>, grade double").repartition(3))
    f, want = dict(grade), {}
    for _ in range(rounds + 1):
        s, n = {}, {}
        for i, w in docs.items():
            if i in f:
                for x in w:
                    t = 1 if i in grade else R.TRUST
                    s[x], n[x] = s.get(x, 0) + t * f[i], n.get(x, 0) + t
        difficulty = {x: s[x] / n[x] for x in s}
        for i, w in docs.items():
            known = [difficulty[x] for x in w if x in difficulty]
            if known:
                want[i] = sum(known) / len(known)
                if i not in grade:
                    f[i] = want[i]
    got = {r.doc_id: r["mean"] for r in means.collect()}
    assert got.pop(90) is None and got == pytest.approx(want) and rounds > 1


def test_wrapped_prose_counts_whole(spark):
    from storyflow.llm.reading_level import prose

    long = "One two three four five six. Seven eight nine ten eleven twelve. Later, the lamp stands\nnear the house\nat night."
    docs = [
        (1, long), (2, long.replace("\n", " ")), (3, "A headline about a lamp\n\n" + long), (4, "Lamp News Today\nThe lamp stands near the old house at night."),
        (5, "Der alte Mann sieht die\nKatze und den Hund am\nHaus."), (6, "* Red lamp house (3)\n* Old lamp house (4)"), (7, "a b c\t1\nd e f\t2"), (8, "x_0 = f(1);\ny_1 = f(2);"),
        (9, "The lamp stands near the house. Then it was"), (10, "The lamp stands near the house. The man saw it. Then it was"),
        (11, "* Red lamp house (3)\nThe lamp stands near the house."), (12, "She said it on\r\nMonday and was fine."),
    ]
    got = {r.doc_id: (len(r.tokens), r.sentence_length) for r in prose(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got[1] == got[2] == got[3] == (21, 7.0) and got[4] == (9, 9.0) and got[5] == (11, 11.0)
    assert not {6, 7, 8} & set(got)
    assert got[9] == (6, 6.0) and got[10] == (10, 5.0) and got[11] == (6, 6.0) and got[12] == (8, 8.0)
