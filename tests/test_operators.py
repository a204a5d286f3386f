import random

import numpy as np
from pyspark.sql import functions as F

from storyflow.operators.block_search import block_search
from storyflow.operators.clustering import attach, greedy_matching, online_clusters
from storyflow.operators.graph import groups_by_shared_keys, least_labels
from storyflow.operators.snapshots import SnapshotTable, full_sync, upsert
from storyflow.session import scratch_path


def union_find(edges):
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
    return {x: find(x) for x in parent}


def test_least_labels(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3), (7, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.vertex: r.group_id for r in least_labels(df, "a", "b").collect()} == union_find(edges)
    assert least_labels(df.limit(0), "a", "b").count() == 0


def test_groups_by_shared_keys(spark):
    rows = [(1, "u1", "g1"), (2, "u1", None), (3, "u2", "g1"), (4, "", ""), (5, "u2", "g9"), (6, None, "g8"), (6, None, "g8")]
    df = spark.createDataFrame(rows, "id long, u string, g string")
    assert {r.vertex: r.group_id for r in groups_by_shared_keys(df, "id", ["u", "g"]).collect()} == {1: 1, 2: 1, 3: 1, 5: 1}


def test_snapshots(spark):
    t = SnapshotTable(spark, scratch_path(spark, "snap"))
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, at int")
    assert t.read() is None
    for _ in range(2):  # a second run changes nothing
        t.merge(df, ["k"], [F.desc("at")])
        assert sorted((r.k, r.v) for r in t.read().collect()) == [(1, "b"), (2, "c")]
    assert t.version() == 2
    got = {r.k: (r.v, r.action) for r in full_sync(df.filter("at = 1"), spark.createDataFrame([(1, "z"), (3, "n")], "k int, v string"), ["k"], ["v"]).collect()}
    assert got == {1: ("z", "update"), 2: ("c", "delete"), 3: ("n", "insert")}
    assert upsert(df.limit(0), df.limit(0), ["k"], ["at"]).count() == 0


def test_greedy_matching():
    size = {1: 3, 2: 2, 3: 1, 4: 5}
    pairs = [(1, 2, 0.9), (2, 3, 0.95), (1, 3, 0.85), (3, 4, 0.8), (1, 4, 0.83)]
    # 2 absorbs 3; 2 is then a target and no source; 3 is used up; 4 absorbs 1
    assert greedy_matching(pairs, size) == [(2, 3, 0.95), (4, 1, 0.83)]
    assert greedy_matching(pairs, size, most=1) == [(2, 3, 0.95)]


def test_merges_are_found_beyond_the_first_block(spark):
    from storyflow.plans.rollups import planned_merges

    # a group of equal stories fills the first blocks with pairs that mostly exclude one another
    pairs = [(a, b, 0.9) for a in range(1, 9) for b in range(a + 1, 9)] + [(20 + 2 * i, 21 + 2 * i, 0.8 - i / 100) for i in range(6)]
    size = {i: (1, "", -i) for i in range(1, 40)}
    stories = spark.createDataFrame([(i, 1, "") for i in size], "cluster_id long, n int, latest string")
    for most in (5, 10, 50):
        assert planned_merges(spark.createDataFrame(pairs, "a long, b long, similarity double"), stories, 5, most) == greedy_matching(pairs, size, most)


def test_attach_properties():
    rng = np.random.default_rng(1)
    vs = [v / np.linalg.norm(v) for v in rng.normal(size=(60, 4))]
    stories = {}
    out = attach([(i, "g" if i % 2 else "h", v) for i, v in enumerate(vs)], stories, {}, 0.7)
    assert len({i for i, *_ in out}) == 60
    assert all(created or sim >= 0.7 for _, _, sim, created in out)
    assert all((i % 2) == (s % 2) for i, s, _, _ in out)  # never across groups
    assert attach([(9, None, vs[0]), (8, None, vs[0])], {}, {}, 0.5) == [(9, 9, 1.0, True), (8, 8, 1.0, True)]


def test_online_clusters_in_one_batch_equals_a_plain_walk(spark):
    rng = np.random.default_rng(2)
    vs = [v / np.linalg.norm(v) for v in rng.normal(size=(40, 5))]
    df = spark.createDataFrame([(i, "a", v.tolist(), i) for i, v in enumerate(vs)], "id long, grp string, vec array<double>, at long")
    want = attach([(i, "a", v) for i, v in enumerate(vs)], {}, {}, 0.6)
    got = online_clusters(df, 0.6, batch_rows=1000).orderBy("article_id").collect()
    assert [(r.article_id, r.story_id, r.created) for r in got] == [(i, s, c) for i, s, _, c in want]
    assert online_clusters(df.limit(0)).count() == 0
    many = online_clusters(df, 0.6, batch_rows=10)
    assert many.count() == 40 and many.filter("not created and similarity < 0.6").count() == 0


def test_online_clusters_in_small_batches_equals_a_plain_walk(spark):
    """Few candidates and small batches: where the nearest may not be among them the batch ends, so nothing is lost."""
    rng = np.random.default_rng(7)
    vs = [v / np.linalg.norm(v) for v in rng.normal(size=(90, 3))]
    vs[40:60] = [vs[3]] * 20
    df = spark.createDataFrame([(i, "ab"[i % 2], v.tolist(), i // 3) for i, v in enumerate(vs)], "id long, grp string, vec array<double>, at long")
    want = attach([(i, "ab"[i % 2], v) for i, v in enumerate(vs)], {}, {}, 0.8)
    for partitions in (1, 5):
        got = online_clusters(df.repartition(partitions), 0.8, k=2, batch_rows=30).orderBy("article_id").collect()
        assert [(r.article_id, r.story_id, r.created) for r in got] == [(i, s, c) for i, s, _, c in want]


def test_block_search(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 4))
    x[7] = x[3]
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = [None if i == 9 else "pq"[i % 2] for i in range(50)]
    df = spark.createDataFrame([(i, x[i].tolist(), g[i]) for i in range(50)], "id long, vec array<double>, grp string")
    for rule in ("any", "same", "different"):
        got = {}
        for r in block_search(df.filter("id % 10 = 3 or id = 9"), df, 4, None, rule).collect():
            got.setdefault(r.query_id, []).append((-r.similarity, r.id))
        for q in (3, 13, 23, 33, 43, 9):
            sim = np.round(x @ x[q], 6)
            ok = [j for j in range(50) if j != q and (rule == "any" or (g[q] is not None and g[j] is not None and (g[q] == g[j]) == (rule == "same")))]
            assert sorted(got.get(q, [])) == sorted((-sim[j], j) for j in ok)[:4] if ok else q not in got
