"""Registered queries against their SQL at the smallest scale, and the entry points."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
from resonarium import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name not in queries.SQL:
        assert len(got.columns)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    got, want = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    for c in cols:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna()) | (abs(got[c] - want[c]) < 2e-6 if got[c].dtype.kind == "f" else False)).all(), c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_reference_queries_take_whole_blocks_and_all_starts(spark):
    first = queries._blocks(spark, DATA).first()
    assert [len(first[k]) for k in "abcd"] == [16] * 4
    assert queries.QUERIES["coupled_nmf"](spark, DATA).count() == 5
