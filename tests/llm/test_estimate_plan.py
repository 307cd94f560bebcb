"""An estimate of a concentration step is drawn towards both levels above in one pass."""

from __future__ import annotations

from quire.llm import quality_rules as R


def test_levels_above_are_joined_once(spark, monkeypatch):
    plans = []

    def watched(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return staged(df, name)

    staged = R.staged
    monkeypatch.setattr(R, "staged", watched)
    one = lambda n: {"n": float(n)} | {c: 1.0 for c in R.SUMS if c[0] == "s" and "_" not in c} | {c: float(n) for c in R.SUMS if "_" in c or c[0] == "t"}
    rows = [{"key": k, "start": 0} | one(n) for k, n in (("all", 30), ("l", 20), ("o", 10), ("lost", 5))]
    sums = spark.createDataFrame(rows).select("key", "start", *R.SUMS)
    tree = spark.createDataFrame([("all", "", 0), ("l", "all", 1), ("o", "l", 2), ("lost", "gone", 2)], "key string, parent string, depth int")
    got = {r.key: r.m0 for r in R._estimate(sums, tree, 1.0).collect()}
    lang = (20 * (1 / 20) + 10 * (1 / 30)) / 30
    assert got == {"all": 1 / 30, "l": lang, "o": (10 * (1 / 10) + 10 * lang) / 20}
    plan = dict(plans)["mcd_step"]
    assert plan.count("Join ") == 4 and "Union" not in plan
