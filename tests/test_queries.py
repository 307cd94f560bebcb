"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    return str(v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", OWN)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(plain(v) for v in r) for r in df.collect()]
    assert rows
    if name not in entry.oracle_sql():
        return
    cur = db.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = [tuple(plain(r[cols.index(c)]) for c in df.columns) for r in cur.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["doc_id", "page_number"]
