"""Every query with SQL against DuckDB on the smallest driver tables, where those exist."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from pefloom.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v.tolist() if hasattr(v, "tolist") else v


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = Q.QUERIES[name](spark, SF).toPandas(), con.execute(Q.ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda d: sorted(([plain(v) for v in r] for r in d[sorted(d.columns)].astype(object).itertuples(index=False)), key=str)
    got, want = rows(a), rows(b)
    assert len(got) == len(want) and all(x == pytest.approx(y, abs=2e-5) if isinstance(x, float) else x == y for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_locate_params_keeps_large_part_keys(spark, tmp_path):
    keys = [0, 63, 64, 99, 100, 999_999, 1_000_000, 6_000_000]
    spark.createDataFrame([(i, 1, k) for i, k in enumerate(keys)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {x.l_orderkey: (x.variable, x.local_index) for x in Q.QUERIES["locate_params"](spark, str(tmp_path)).collect()}
    assert got == {i: ("kernel", k) if k < 64 else ("bias", k - 64) if k < 100 else ("head", k - 100) for i, k in enumerate(keys)}
