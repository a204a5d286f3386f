"""Exact search of a stated set of query vectors against all rows, in blocks.

Queries are taken in blocks of bounded size; each is broadcast and compared with all rows by dense products of bounded size
next to the scan. Only the k best (or those above a threshold) of each task travel, and a final ranking per query merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Queries per broadcast block: 8,192 vectors of 64 doubles are 4 MB.
QUERY_BLOCK = 8_192
#: Queries and rows of one dense product: no matrix in a worker has more than this many rows and columns.
MATRIX = 1_024


def block_search(queries: DataFrame, rows: DataFrame, k: int | None, threshold: float | None = None, group_rule: str = "any") -> DataFrame:
    """(query_id, id, similarity) with queries and rows as (id, vec, grp).

    ``group_rule``: any, same or different ``grp``. Similarity is the dot product rounded to 6 decimals; a row is
    not its own neighbour; ties go to the smaller id; a null ``grp`` equals no other.
    """
    spark = rows.sparkSession
    queries = materialize(queries, "queries")
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    rows = materialize(rows, "rows")
    schema = "query_id long, id long, similarity double"
    out = None
    for b in range(n_blocks):
        q = queries.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).toPandas()
        if not len(q):
            continue
        shared = spark.sparkContext.broadcast((q.id.to_numpy(), np.vstack(list(q.vec)).astype(np.float64), q.grp.to_numpy(dtype=object)))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, vecs, grps = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                pdf = pdf.sort_values("id")
                x_ids, x, n = pdf.id.to_numpy(), np.vstack(list(pdf.vec)).astype(np.float64), len(pdf)
                codes = pd.factorize(np.concatenate([grps, pdf.grp.to_numpy(dtype=object)]))[0]  # -1 for null
                for a in range(0, len(ids), MATRIX):
                    own, q_codes, best = ids[a : a + MATRIX], codes[a : a + MATRIX][: len(ids[a : a + MATRIX])], []
                    for c in range(0, n, MATRIX):
                        # whole numbers that order by similarity, then by id: the k least are unique
                        s = np.rint(vecs[a : a + MATRIX] @ x[c : c + MATRIX].T * 1e6).astype(np.int64)
                        ok = own[:, None] != x_ids[None, c : c + MATRIX]
                        if group_rule != "any":
                            x_codes = codes[len(ids) + c : len(ids) + c + MATRIX]
                            same, known = q_codes[:, None] == x_codes[None, :], (q_codes[:, None] >= 0) & (x_codes[None, :] >= 0)
                            ok &= known & (same if group_rule == "same" else ~same)
                        if threshold is not None:
                            ok &= s / 1e6 >= threshold
                        if k is not None and s.shape[1] > k:
                            rank = np.where(ok, (1_000_001 - s) * s.shape[1] + np.arange(s.shape[1]), np.iinfo(np.int64).max)
                            kth = np.partition(rank, k - 1, axis=1)[:, k - 1 : k]
                            ok &= rank <= kth
                        r, col = np.nonzero(ok)
                        best.append(pd.DataFrame({"query_id": own[r], "id": x_ids[c + col], "similarity": s[r, col] / 1e6}))
                    found = pd.concat(best, ignore_index=True)
                    if k is not None and len(best) > 1:
                        found = found.iloc[np.lexsort((found.id, -found.similarity, found.query_id))]
                        found = found[found.groupby("query_id").cumcount() < k]
                    yield found

        part = rows.mapInPandas(search, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    if k is None:
        return out
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")
