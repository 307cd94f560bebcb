"""Rolling medians against sorting every window, and the query against its SQL."""

from __future__ import annotations

import datetime as dt
import os
import random

import duckdb
import numpy as np
import pytest

from quire.llm import rolling_median as R

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, n string, us int"
ZERO = dt.datetime(2024, 3, 10, 1, 50)


def twice_middle(x: list[int]) -> int:
    x = sorted(x)
    return x[(len(x) - 1) // 2] + x[len(x) // 2]


def brute(rows: list[tuple]) -> dict:
    """rows (click_id, kind, us, cents), one for each click_id."""
    out = {}
    for i, kind, us, c in rows:
        x = [v for _, k, t, v in rows if k == kind and us - R.WINDOW < t <= us and v is not None]
        if not x:
            out[i] = (kind, 0, None, None, None)
            continue
        m = twice_middle(x)
        d = twice_middle([abs(2 * v - m) for v in x])
        out[i] = (kind, len(x), m, d, None if c is None else 2 * abs(2 * c - m) > 2 * d)
    return out


def clicks(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ts = None if rng.random() < 0.02 else ZERO + dt.timedelta(microseconds=rng.choice([rng.randrange(4 * 3600 * 10**6), rng.randrange(3) * 900 * 10**6, rng.randrange(60) * 10**6]))
        value = rng.choice([None, float("nan"), float("inf"), -1e300, 0.0, -3.125, 0.29, rng.randrange(300) / 100, rng.lognormvariate(3, 2), 4_869_882.66])
        out.append((i, ts, None, 1, rng.choice(["view", "view", "click", None, ""]), value, "{}", "x", 1))
    return out + [r for r in out if r[0] % 17 == 0]


def plain(rows: list[tuple]) -> list[tuple]:
    seen = {}
    for i, ts, _, _, kind, v, *_ in rows:
        if ts is not None:
            c = None if v is None or not np.isfinite(v) or abs(v) > R.MOST / 200 else int(np.floor(100 * v + 0.5))
            seen[i] = (i, kind, (ts - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1), c)
    return list(seen.values())


@pytest.mark.parametrize("how", [{}, {"portion": 5}, {"dense": 40, "portion": 64}, {"dense": 7, "parts": 4, "chunk": 1800 * R.SECOND}])
def test_against_brute_force(spark, how):
    rows = clicks(600, 3)
    got = {r.click_id: (r.kind, r.n, r.median2, r.mad4, r.far) for r in R.with_medians(R.clicks_once(spark.createDataFrame(rows, SCHEMA)), **how).collect()}
    assert got == brute(plain(rows))


def test_no_zone(spark):
    """Clock times that a zone of the session skips or repeats stay apart."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [(i, dt.datetime(2024, 3, 10, 1, 50) + dt.timedelta(minutes=5 * i), None, 1, "v", float(i), "", "", 1) for i in range(30)]
        got = {r.click_id: r.n for r in R.with_medians(R.clicks_once(spark.createDataFrame(rows, SCHEMA))).collect()}
        assert got == {i: min(i + 1, 3) for i in range(30)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_one_moment_and_null_ids(spark):
    """A third of all rows at one time: its points are counted before they are dealt."""
    rows = [(i, ZERO, None, 1, "v", float(i % 7), "", "", 1) for i in range(4000)] + [(None, ZERO, None, 1, "v", 5.0, "", "", 1)] * 3
    got = R.with_medians(R.clicks_once(spark.createDataFrame(rows, SCHEMA)), portion=10).collect()
    assert len(got) == 4001 and {r.n for r in got} == {4001}
    x = [100 * (i % 7) for i in range(4000)] + [500]
    m = twice_middle(x)
    assert {(r.median2, r.mad4) for r in got} == {(m, twice_middle([abs(2 * v - m) for v in x]))}


def test_ids_with_different_rows(spark):
    rows = [(1, ZERO, None, 1, "b", 1.0, "", "", 1), (1, ZERO, None, 1, "a", 2.0, "", "", 1), (1, None, None, 1, "a", 0.0, "", "", 1), (1, ZERO, None, 1, None, 0.0, "", "", 1)]
    assert [(r.kind, r.n, r.median2) for r in R.with_medians(R.clicks_once(spark.createDataFrame(rows, SCHEMA))).collect()] == [("a", 1, 400)]


def test_empty(spark):
    assert R.with_medians(R.clicks_once(spark.createDataFrame([], SCHEMA))).collect() == []


def test_trie_on_wide_values():
    rng = np.random.default_rng(1)
    v, c = rng.integers(-(R.MOST - 1), R.MOST, 300), rng.integers(1, 4, 300)
    t = R.WindowTrie(v, c)
    lo = rng.integers(0, 299, 200)
    hi = lo + 1 + rng.integers(0, 300 - lo)
    m, d = t.medians(lo, hi)
    for i, (a, b) in enumerate(zip(lo, hi, strict=True)):
        x = np.repeat(v[a:b], c[a:b]).tolist()
        want = twice_middle(x)
        assert (m[i], d[i]) == (want, twice_middle([abs(2 * y - want) for y in x]))


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/clicks.parquet"), reason="no tables")
def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    df = R.op12_rolling_median(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW clicks AS SELECT * FROM '{sf}/clicks.parquet'")
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, con.execute(R.OP12_SQL).fetchall()))
