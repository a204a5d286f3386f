"""Every core query with SQL against DuckDB on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from storyflow.plans import catalogue


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    r = duck.execute(catalogue.ORACLE[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = Counter(repr(tuple(plain(row[names.index(c)]) for c in cols)) for row in r.fetchall())
    assert got == want
