"""The most similar vectors of every vector: a hierarchical k-means tree read best bin first.

The upper tree is fitted on a bounded sample (``SAMPLE`` vectors, chosen by hash) by splitting each node into
``BRANCH`` clusters, down to leaves of about ``leaf_rows`` of all rows. Where that takes more than ``BRANCHES`` leaves, the upper
tree stops at branches of about ``BELOW`` leaves (``BRANCHES`` of them at most), and each gets a tree of its own, fitted
on the executors on a fixed share of its rows, so the number of leaves grows with the data, and the driver never holds
more than the upper tree. Every row is
indexed, that is sent to its leaf.

A query keeps a priority queue of unopened nodes ordered by similarity to their centre, opens the best first and
collects leaves in that order. How many leaves are visited, in the upper tree and in each tree below, is calibrated:
for a sample of queries the exact neighbours are found by comparing them with all rows, merged in Spark, and the visits are
widened until the wanted recall is reached. Leaves side by side form a bucket; a query travels once to
a bucket, with the leaves it visits there, and each leaf is one dense product.

Equal vectors form one class. No more than the k + 1 least ids of a class can ever be among anyone's k most
similar, so only these are indexed and each class asks once; every member gets its own answer. A bucket with
more rows than planned is cut into blocks, so copies or a crowded region never fill one task.

Defined results: vectors that are null, of another length, with a component that is null or no number, or all
zero are left out; similarity is the cosine in double precision rounded to 6 decimals; ties go to the smaller
id; fewer than k other vectors give fewer neighbours; of repeated ids the vector with the least bytes counts.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Vectors the upper tree is fitted on at most; queries used to calibrate; children of a node; leaves of the upper tree at most.
SAMPLE, CALIBRATE, BRANCH, BRANCHES = 20_000, 256, 8, 1_024
#: Rows of a bucket of leaves, and from how many on it is cut into blocks; rows a tree below is fitted on, one in so many.
BUCKET, BLOCK, ONE_IN = 4_096, 16_384, 16
#: Leaves of a tree below, as long as the upper tree isn't full.
BELOW = 64
#: Number of a leaf: its place in the upper tree times this, plus its place in the tree below.
_BELOW = 1 << 24


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(id, f4 or f8): packed bytes of finite vectors of ``dims`` components that are not all zero."""
    narrow = rows.schema[vector_col].dataType.simpleString() == "array<float>"
    name, kind = ("f4", np.float32) if narrow else ("f8", np.float64)
    vec = F.col(vector_col) if narrow else F.col(vector_col).cast("array<double>")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            whole = np.asarray(lists.value_lengths().fill_null(0)) == dims
            kept = lists.filter(pa.array(whole))
            x = kept.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)
            fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = np.ascontiguousarray(x[fine] + kind(0))  # one zero only, so that equal vectors have equal bytes
            ends = (np.arange(len(x) + 1) * (dims * x.itemsize)).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(whole)).filter(pa.array(fine)), raw], ["id", name])

    one = rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vec.alias("v"))
    return one.mapInArrow(pack, f"id long, {name} binary").groupBy("id").agg(F.min(name).alias(name))


def _unit(raw: pd.Series, kind: str) -> np.ndarray:
    """Packed vectors as rows of unit length, scaled by the largest component first: squares neither overflow nor vanish."""
    if not len(raw):
        return np.zeros((0, 1))
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Tree:
    """Centres of a hierarchical k-means tree: per node its centre, children and leaf number."""

    def __init__(self, sample: np.ndarray, n_leaves: int, seed: int = 7):
        self.centre: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.rng = np.random.default_rng(seed)
        self.n_leaves = 0
        self._grow(sample, max(1, n_leaves))
        self.centres = np.array(self.centre)
        self.leaf_no = np.array(self.leaf)

    def _node(self, centre: np.ndarray) -> int:
        self.centre.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.centre) - 1

    def _grow(self, sample: np.ndarray, n_leaves: int) -> None:
        root = self._node(sample.mean(axis=0))
        queue = [(-len(sample), root, sample)]
        leaves = 1
        while queue and leaves < n_leaves:
            size, node, own = heapq.heappop(queue)
            k = min(BRANCH, n_leaves - leaves + 1, len(own))
            parts = self._split(own, k) if k > 1 else []
            if len(parts) < 2:
                self._close(node)
                continue
            leaves += len(parts) - 1
            for p in parts:
                child = self._node(p.mean(axis=0))
                self.children[node].append(child)
                heapq.heappush(queue, (-len(p), child, p))
        for _, node, _ in queue:
            self._close(node)

    def _close(self, node: int) -> None:
        self.leaf[node] = self.n_leaves
        self.n_leaves += 1

    def _split(self, own: np.ndarray, k: int, rounds: int = 12) -> list[np.ndarray]:
        centres = own[self.rng.choice(len(own), k, replace=False)]
        for _ in range(rounds):
            label = np.argmax(own @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
            centres = np.array([own[label == j].mean(axis=0) if (label == j).any() else centres[j] for j in range(k)])
        parts = [own[label == j] for j in range(k)]
        return [p for p in parts if len(p)]

    def assign(self, vecs: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by descending to the nearest child."""
        node = np.zeros(len(vecs), dtype=np.int64)
        todo = np.arange(len(vecs))
        while len(todo):
            nxt = []
            for n in np.unique(node[todo]):
                own = todo[node[todo] == n]
                kids = self.children[n]
                if not kids:
                    continue
                c = self.centres[kids]
                node[own] = np.array(kids)[np.argmax(vecs[own] @ c.T - 0.5 * (c**2).sum(axis=1), axis=1)]
                nxt.append(own)
            todo = np.concatenate(nxt) if nxt else np.array([], dtype=np.int64)
        return self.leaf_no[node]

    def best_bins(self, vec: np.ndarray, visits: int, scores: np.ndarray) -> list[int]:
        """The first ``visits`` leaves of a best-bin-first traversal; ``scores`` are the similarities to all centres."""
        queue, out = [(-scores[0], 0)], []
        while queue and len(out) < visits:
            _, n = heapq.heappop(queue)
            if self.leaf[n] >= 0:
                out.append(self.leaf[n])
            for c in self.children[n]:
                heapq.heappush(queue, (-scores[c], c))
        return out

    def visit(self, vecs: np.ndarray, visits: int, ordered: bool = False) -> list[np.ndarray]:
        """The leaves each vector visits, in the order of the queue where that matters."""
        if visits >= self.n_leaves and not ordered:
            return [np.arange(self.n_leaves)] * len(vecs)
        scores = vecs @ self.centres.T - 0.5 * (self.centres**2).sum(axis=1)
        return [np.array(self.best_bins(v, visits, s)) for v, s in zip(vecs, scores)]


def _top(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k best (rounded similarity, smaller id) of each query among x, itself excluded; ``at`` is the row of x."""
    order = np.argsort(x_ids, kind="stable")
    x_ids, x = x_ids[order], x[order]
    out = []
    for a in range(0, len(q) if len(x) else 0, 1024):
        own = q_ids[a : a + 1024]
        # whole numbers that order by similarity, then by id: no two are equal, so the k least are unique
        s = np.rint(q[a : a + 1024] @ x.T * 1e6).astype(np.int64)
        rank = (1_000_001 - s) * len(x) + np.arange(len(x))
        rank[own[:, None] == x_ids[None, :]] = np.iinfo(np.int64).max
        best = np.argpartition(rank, k - 1, axis=1)[:, :k] if len(x) > k else np.broadcast_to(np.arange(len(x)), rank.shape)
        rows, best = np.repeat(np.arange(len(own)), best.shape[1]), best.ravel()
        good = rank[rows, best] < np.iinfo(np.int64).max
        rows, best = rows[good], best[good]
        out.append(pd.DataFrame({"q": own[rows], "id": x_ids[best], "sim": s[rows, best] / 1e6, "at": order[best]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"q": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "sim": np.zeros(0), "at": np.zeros(0, np.int64)})


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of each query."""
    order = np.lexsort((found.id, -found.sim, found.q))
    found = found.iloc[order]
    return found[found.groupby("q").cumcount() < k]


def _classes(vectors: DataFrame, raw: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, raw, rep, n) of all vectors, rep the least id with equal bytes, and the rows that are indexed."""
    hashed = materialize(vectors.withColumn("h", F.md5(raw)), "vectors")
    counts = hashed.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    classed = materialize(hashed.join(counts, "h").drop("h"), "classes")
    # copies are thinned in two steps, so that a class with a third of all rows is never one task's
    many = classed.filter(F.col("n") > k + 1).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for part in (["rep", "salt"], ["rep"]):
        many = many.withColumn("r", F.row_number().over(Window.partitionBy(*part).orderBy("id"))).filter(F.col("r") <= k + 1).drop("r")
    points = classed.filter(F.col("n") <= k + 1).unionByName(many.drop("salt")).select("id", raw, "rep")
    return classed, materialize(points, "points")


def _share(seed: int) -> Column:
    """A number in [0, 1) by hash of the id."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000_007)) / 1_000_000_007.0


class KMeansTree:
    """The index over all points, and the answers to queries; see the module."""

    def __init__(self, points: DataFrame, raw: str, k: int, leaf_rows: int, recall: float):
        self.points, self.raw, self.k, self.spark = points, raw, k, points.sparkSession
        n = points.count()
        some = points.filter(_share(11) <= min(1.0, 1.2 * SAMPLE / max(n, 1))).orderBy(_share(11)).limit(SAMPLE).select(raw).toPandas()
        n_leaves = -(-n // leaf_rows)
        self.deep = n_leaves > BRANCHES
        # a query travels once to a branch: few and large ones, until the upper tree is full
        self.tree = Tree(_unit(some[raw], raw), min(-(-n_leaves // BELOW), BRANCHES) if self.deep else n_leaves)
        self.leaf_rows = leaf_rows
        self._index()
        self._calibrate(n, recall)

    def _index(self) -> None:
        tree, raw, spark = self.tree, self.raw, self.spark

        def to_branch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({"branch": tree.assign(_unit(pdf[raw], raw)).astype(np.int32), "id": pdf.id, raw: pdf[raw]})

        branched = materialize(self.points.select("id", raw).mapInPandas(to_branch, f"branch int, id long, {raw} binary"), "branches")
        sizes = {r["branch"]: r["count"] for r in branched.groupBy("branch").count().collect()}  # at most BRANCHES rows
        if not self.deep:
            # leaves side by side are packed into buckets
            filled = np.cumsum([sizes.get(i, 0) for i in range(tree.n_leaves)])
            self.bucket_of = np.maximum(filled - 1, 0) // BUCKET
            table = spark.createDataFrame([(i, int(x)) for i, x in enumerate(self.bucket_of)], "branch int, bucket long")
            leaves = branched.join(F.broadcast(table), "branch").withColumn("leaf", F.col("branch").cast("long") * _BELOW)
        else:
            leaf_rows = self.leaf_rows

            def fit(pdf: pd.DataFrame) -> pd.DataFrame:
                own = Tree(_unit(pdf[raw], raw), -(-len(pdf) * ONE_IN // leaf_rows))
                return pd.DataFrame({"branch": pdf.branch.iloc[:1].astype(np.int32), "below": [pickle.dumps(own)]})

            # every branch has a row at least, its smallest id, however small it is
            fitted = branched.filter(_share(31) < 1.0 / ONE_IN).unionByName(branched.join(branched.groupBy("branch").agg(F.min("id").alias("id")), ["branch", "id"], "left_semi")).dropDuplicates(["id"])
            self.below = materialize(fitted.groupBy("branch").applyInPandas(fit, "branch int, below binary"), "trees")
            slices = spark.createDataFrame([(b, -(-n // (4 * BLOCK))) for b, n in sizes.items()], "branch int, slices int")
            cut = branched.join(F.broadcast(slices), "branch").select("branch", "id", raw, F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"))
            every = slices.select("branch", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
            trees = self.below.join(F.broadcast(every), "branch").select("branch", "slice", "below")

            def assign(points: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
                leaf = points.branch.to_numpy(np.int64) * _BELOW
                if len(points):
                    leaf = leaf + pickle.loads(trees.below.iloc[0]).assign(_unit(points[raw], raw))
                return pd.DataFrame({"leaf": leaf, "id": points.id, raw: points[raw]})

            leaves = cut.groupBy("branch", "slice").cogroup(trees.groupBy("branch", "slice")).applyInPandas(assign, f"leaf long, id long, {raw} binary")
            leaves = leaves.withColumn("bucket", F.floor(F.col("leaf") / max(1, BUCKET // leaf_rows)).cast("long"))
        self.leaves = materialize(leaves.select("bucket", "leaf", "id", raw), "leaves")
        crowded = self.leaves.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
        self.crowded = materialize(crowded, "crowded")

    def _calibrate(self, n: int, recall: float) -> None:
        """Exact neighbours of some queries over all rows; the visits that reach ``recall`` of them with least work."""
        tree, raw, k, spark = self.tree, self.raw, self.k, self.spark
        lot = _share(23)  # a share first, else every task would send its own
        probe = self.points.filter(lot <= min(1.0, 4 * CALIBRATE / max(n, 1))).orderBy(lot, "id").limit(CALIBRATE).select("id", raw).toPandas()
        p_ids, p = probe.id.to_numpy(), _unit(probe[raw], raw)

        def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept = None
            for pdf in batches:
                if len(pdf):
                    found = _top(p_ids, p, pdf.id.to_numpy(), _unit(pdf[raw], raw), k)
                    found["leaf"] = pdf.leaf.to_numpy()[found.pop("at")]
                    kept = _best(found if kept is None else pd.concat([kept, found]), k)
            if kept is not None:
                yield kept

        near = self.leaves.select("id", "leaf", raw).mapInPandas(exact, "q long, id long, sim double, leaf long")
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id")))
        truth = near.filter(F.col("r") <= k).select("q", "leaf").toPandas()  # CALIBRATE x k rows at most
        truth["branch"] = truth.leaf // _BELOW
        self.upper = self.lower = 1
        reached = 1.0
        if len(truth):
            order = {i: {int(x): at for at, x in enumerate(leaves)} for i, leaves in zip(p_ids, tree.visit(p, tree.n_leaves - 1) if tree.n_leaves > 1 else [np.array([0])] * len(p))}
            upper = np.array([order[q].get(b, tree.n_leaves - 1) for q, b in zip(truth.q, truth.branch)])
            lower = np.zeros(len(truth), dtype=np.int64)
            if self.deep:
                asked = truth.assign(row=np.arange(len(truth))).merge(probe.rename(columns={"id": "q"}), on="q").astype({"branch": "int32"})
                asked = spark.createDataFrame(asked[["branch", "row", "leaf", raw]], f"branch int, row long, leaf long, {raw} binary")

                def depth(asked: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
                    if not len(asked):
                        return pd.DataFrame({"row": np.zeros(0, np.int64), "at": np.zeros(0, np.int64)})
                    own = pickle.loads(trees.below.iloc[0])
                    seen = own.visit(_unit(asked[raw], raw), own.n_leaves, ordered=True)
                    return pd.DataFrame({"row": asked.row, "at": [int(np.flatnonzero(s == leaf % _BELOW)[0]) for s, leaf in zip(seen, asked.leaf)]})

                at = asked.groupBy("branch").cogroup(self.below.groupBy("branch")).applyInPandas(depth, "row long, at long").toPandas()
                lower[at.row.to_numpy()] = at["at"].to_numpy()
            # of all pairs of visits that reach the recall the one with the fewest leaves
            least = int(np.ceil(recall * len(truth) - 1e-9))
            choices = []
            for low in np.unique(lower) + 1:
                within = np.sort(upper[lower < low])
                if len(within) >= max(least, 1):
                    choices.append(((int(within[max(least, 1) - 1]) + 1) * int(low), int(within[max(least, 1) - 1]) + 1, int(low)))
            _, self.upper, self.lower = min(choices)
            reached = float(((upper < self.upper) & (lower < self.lower)).mean())
        self.info = {"leaves": tree.n_leaves, "visits": self.upper, "below": self.lower if self.deep else 0, "recall": reached}

    def _routed(self, queries: DataFrame) -> DataFrame:
        """(bucket, id, raw, leaves): every query once per bucket with leaves it visits."""
        tree, raw, upper, lower, deep = self.tree, self.raw, self.upper, self.lower, self.deep
        bucket_of = None if deep else self.bucket_of
        per_bucket = max(1, BUCKET // self.leaf_rows)

        def to_branches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                seen = tree.visit(_unit(pdf[raw], raw), upper)
                row = np.repeat(np.arange(len(pdf)), [len(s) for s in seen])
                branch = np.concatenate(seen)
                if deep:
                    yield pd.DataFrame({"branch": branch.astype(np.int32), "id": pdf.id.to_numpy()[row], raw: pdf[raw].to_numpy()[row]})
                else:
                    yield _by_bucket(bucket_of[branch], branch.astype(np.int64) * _BELOW, row, pdf.id.to_numpy(), pdf[raw].to_numpy(), raw)

        def to_leaves(asked: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(trees):
                return _by_bucket(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), asked.id.to_numpy(), asked[raw].to_numpy(), raw)
            own = pickle.loads(trees.below.iloc[0])
            seen = own.visit(_unit(asked[raw], raw), lower)
            row = np.repeat(np.arange(len(asked)), [len(s) for s in seen])
            leaf = np.concatenate(seen).astype(np.int64) + int(asked.branch.iloc[0]) * _BELOW
            return _by_bucket(leaf // per_bucket, leaf, row, asked.id.to_numpy(), asked[raw].to_numpy(), raw)

        out = f"bucket long, id long, {raw} binary, leaves array<long>"
        if not deep:
            return queries.mapInPandas(to_branches, out)
        salted = queries.mapInPandas(to_branches, f"branch int, id long, {raw} binary").withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int"))
        trees = self.below.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(15))))
        return salted.groupBy("branch", "slice").cogroup(trees.groupBy("branch", "slice")).applyInPandas(to_leaves, out)

    def nearest(self, queries: DataFrame, most: int) -> DataFrame:
        """(q, near): the ``most`` best other points of every query (id, raw) as an array of (-similarity, id)."""
        raw = self.raw
        n = F.coalesce("blocks", F.lit(1))
        points = self.leaves.join(self.crowded, "bucket", "left").withColumn("block", F.pmod(F.xxhash64("id"), n).cast("int")).drop("blocks")
        asked = self._routed(queries).join(self.crowded, "bucket", "left").withColumn("block", F.explode(F.sequence(F.lit(0), n - 1))).drop("blocks")

        def compare(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            found = [_top(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros((0, 1)), 1)]
            if len(points) and len(asked):
                x, q, x_ids, q_ids = _unit(points[raw], raw), _unit(asked[raw], raw), points.id.to_numpy(), asked.id.to_numpy()
                held, wants = points.leaf.to_numpy(), np.concatenate(list(asked.leaves))
                row = np.repeat(np.arange(len(asked)), asked.leaves.map(len))
                for leaf in np.unique(held):
                    mine, own = row[wants == leaf], held == leaf
                    if len(mine):
                        found.append(_top(q_ids[mine], q[mine], x_ids[own], x[own], most))
            return _best(pd.concat(found), most)[["q", "id", "sim"]]

        part = points.groupBy("bucket", "block").cogroup(asked.groupBy("bucket", "block")).applyInPandas(compare, "q long, id long, sim double")
        return part.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), "id"))), 1, most).alias("near"))


def _by_bucket(bucket: np.ndarray, leaf: np.ndarray, row: np.ndarray, ids: np.ndarray, raw: np.ndarray, name: str) -> pd.DataFrame:
    """One row per query and bucket with the leaves visited there."""
    order = np.lexsort((leaf, row, bucket))
    bucket, leaf, row = bucket[order], leaf[order], row[order]
    cut = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])]) if len(bucket) else np.zeros(0, np.int64)
    return pd.DataFrame({"bucket": bucket[cut].astype(np.int64), "id": ids[row[cut]], name: raw[row[cut]], "leaves": np.split(leaf, cut[1:]) if len(cut) else []})


def nearest_neighbours(vectors: DataFrame, k: int, leaf_rows: int = 256, recall: float = 0.99) -> tuple[DataFrame, dict]:
    """(q, id, sim): the k most similar other vectors of each of ``vectors`` (as ``usable_vectors`` gives them), and what was calibrated."""
    spark, raw = vectors.sparkSession, vectors.columns[1]
    classed, points = _classes(vectors, raw, k)
    if points.isEmpty():
        return spark.createDataFrame([], "q long, id long, sim double"), {"leaves": 0, "visits": 0, "below": 0, "recall": 1.0}
    index = KMeansTree(points, raw, k, leaf_rows, recall)
    # answers of the representative: its k + 1 best others; with itself they serve every member of its class
    best = index.nearest(points.filter("id = rep").select("id", raw), k + 1)
    full = best.select(F.col("q").alias("rep"), F.array_sort(F.concat("near", F.array(F.struct(F.lit(-1.0).alias("d"), F.col("q").alias("id"))))).alias("near"))
    mine = classed.select("id", "rep").join(full, "rep")
    mine = mine.select(F.col("id").alias("q"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return mine.select("q", F.explode("near").alias("e")).select("q", F.col("e.id").alias("id"), (-F.col("e.d")).alias("sim")), index.info
