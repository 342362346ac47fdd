"""Every registered query gives the rows of its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from citeresolve.plans import registry


def normal(v):
    if v is None or str(v) in ("<NA>", "nan"):
        return "NULL"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, small, name):
    got = registry.QUERIES[name](spark, small)
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    want = con.execute(registry.ORACLE[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert Counter(tuple(map(normal, r)) for r in want.fetchall()) == Counter(tuple(map(normal, r)) for r in got.select(*cols).collect())
