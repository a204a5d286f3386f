"""Order-dependent clustering: online attachment of articles to stories, and greedy merging of stories.

Articles are taken in bounded batches in order of time. The ``k`` nearest stories of a batch's articles are found by a
distributed block search over the stories as they were before it; only the batch itself, at most ``batch_rows`` articles, is
then walked through one by one. Stories that the batch made or moved are candidates of every later article of it. Should
all ``k`` of an article have moved, and none be as near as the farthest of them was, an unmoved story further
back could be the nearest: the batch ends there and the article opens the next one, so the walk equals one over all stories.
Batches are cut by exact rank, so results don't depend on how rows are partitioned.

Defined results: articles without usable vector are left out; equal similarity goes to the smaller story id; a new story
takes the id of its first article.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, superseded
from .block_search import block_search


def attach(batch: Iterable[tuple[int, object, np.ndarray]], stories: dict[int, tuple[object, np.ndarray, int]], near: dict[int, list[int]], threshold: float, least: dict[int, float] | None = None) -> list[tuple[int, int, float, bool]]:
    """Walk through a batch of (id, group, unit vector); ``stories`` is updated. Returns (id, story, similarity, created).

    ``least`` has the similarity of the last of a full list of nearest stories; the walk ends before an article whose nearest
    story may not be among the candidates.
    """
    batch, out = list(batch), []
    moved: dict[int, int] = {}  # story -> its row
    matrix = np.zeros((len(batch), len(batch[0][2]) if batch else 0))
    groups = np.empty(len(batch), dtype=object)
    for i, group, v in batch:
        best, best_sim = None, -2.0
        options = [(s, round(float(stories[s][1] @ v), 6)) for s in near.get(i, ()) if s not in moved and stories[s][0] == group]
        if moved and group is not None:
            ids = list(moved)
            sims = np.round(matrix[: len(ids)] @ v, 6)
            options += [(ids[x], float(sims[x])) for x in np.flatnonzero(groups[: len(ids)] == group)]
        for s, sim in options if group is not None else ():
            if sim > best_sim or (sim == best_sim and s < best):
                best, best_sim = s, sim
        if least is not None and i in least and best_sim < least[i] and all(s in moved for s in near[i]):
            break
        if best is not None and best_sim >= threshold:
            g, c, n = stories[best]
            merged = (c * n + v) / (n + 1)
            length = np.linalg.norm(merged)
            stories[best] = (g, merged / length if length > 0 else merged, n + 1)
            out.append((i, best, best_sim, False))
        else:
            best = i
            stories[i] = (group, v, 1)
            out.append((i, i, 1.0, True))
        row = moved.setdefault(best, len(moved))
        matrix[row], groups[row] = stories[best][1], stories[best][0]
    return out


_STATE = "story_id long, grp string, vec array<double>, n long"
_OUT = "article_id long, story_id long, similarity double, created boolean"


def online_clusters(articles: DataFrame, threshold: float = 0.65, k: int = 20, batch_rows: int = 2_000) -> DataFrame:
    """(article_id, story_id, similarity, created) from articles (id, grp, vec of unit length, at), oldest first."""
    spark = articles.sparkSession
    articles = materialize(articles.select("id", "grp", "vec", "at"), "to-cluster")
    n = articles.count()
    if not n:
        return spark.createDataFrame([], _OUT)
    # exact ranks: sorted ranges, their counts, and a row's place in its own range
    ranges = max(1, -(-n // (4 * batch_rows)))
    placed = articles.repartitionByRange(ranges, F.asc_nulls_first("at"), "id").withColumn("part", F.spark_partition_id())
    placed = materialize(placed, "ranges")
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # one row a range
    before, starts = 0, []
    for p in sorted(counts):
        starts.append((p, before))
        before += counts[p]
    own = Window.partitionBy("part").orderBy(F.asc_nulls_first("at"), "id")
    ranked = placed.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part").withColumn("rank", F.col("start") + F.row_number().over(own) - 1)
    ranked = materialize(ranked.select("id", "grp", "vec", "rank"), "ranked")
    state, done, at = None, [], 0
    while at < n:
        part = ranked.filter(F.col("rank").between(at, at + batch_rows - 1))
        batch = part.orderBy("rank").toPandas()  # batch_rows rows at most
        near: dict[int, list[int]] = {}
        least: dict[int, float] = {}
        stories: dict[int, tuple] = {}
        if state is not None:
            found = block_search(part.select("id", "vec", "grp"), state.select(F.col("story_id").alias("id"), "vec", "grp"), k, None, "same").toPandas()
            found = found.sort_values(["query_id", "similarity", "id"], ascending=[True, False, True])
            near = found.groupby("query_id").id.apply(list).to_dict()
            last = found.groupby("query_id").similarity.agg(["size", "min"])
            least = last["min"][last["size"] == k].to_dict()
            wanted = spark.createDataFrame(pd.DataFrame({"story_id": found.id.unique()}), "story_id long")
            touched = state.join(F.broadcast(wanted), "story_id", "left_semi").toPandas()  # batch_rows x k rows at most
            stories = {r.story_id: (r.grp, np.asarray(r.vec), r.n) for r in touched.itertuples()}
        rows = attach([(r.id, r.grp, np.asarray(r.vec)) for r in batch.itertuples()], stories, near, threshold, least)
        at += len(rows)
        done.append(materialize(spark.createDataFrame(rows, _OUT), "attached"))
        changed = {s for _, s, _, _ in rows}
        new = spark.createDataFrame([(s, stories[s][0], [float(x) for x in stories[s][1]], int(stories[s][2])) for s in changed], _STATE)
        kept = new if state is None else state.join(F.broadcast(new.select("story_id")), "story_id", "left_anti").unionByName(new)
        old, state = state, materialize(kept, "stories")
        if old is not None:
            superseded(old)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def greedy_matching(pairs: list[tuple[int, int, float]], size: dict[int, tuple], most: int = 50, taken: list[tuple[int, int, float]] = ()) -> list[tuple[int, int, float]]:
    """(target, source, similarity) taken best first: a source is used once and is never a target; targets may be reused.

    ``size`` maps a story to its precedence (more articles, later, smaller id compare as larger). ``taken`` are the merges of
    better pairs seen before; they count towards ``most`` and come first in the result.
    """
    out = list(taken)
    sources, targets = {s for _, s, _ in out}, {t for t, _, _ in out}
    for a, b, sim in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if len(out) >= most:
            break
        target, source = (a, b) if size[a] >= size[b] else (b, a)
        if source in sources or source in targets or target in sources:
            continue
        sources.add(source)
        targets.add(target)
        out.append((target, source, sim))
    return out
