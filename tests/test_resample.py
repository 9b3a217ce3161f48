import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import series
from stressloom.operators import resample as rs


def test_draws_agree_and_look_uniform(spark):
    n = 4000
    got = [r["v"] for r in spark.range(n).select((rs.draw(7, F.col("id") % 40, F.floor(F.col("id") / 40)) % 100).alias("v")).collect()]
    exp = rs.draw_np(7, np.arange(n) % 40, np.arange(n) // 40) % 100
    assert got == exp.tolist()
    assert abs(np.mean(got) - 49.5) < 1.5 and min(np.bincount(got, minlength=100)) > 15
    u = rs.draw_np(7, np.arange(n) % 40, np.arange(n) // 40) / rs.M
    assert abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.05


def test_plan_covers_every_replicate(spark):
    p = rs.block_plan(series(spark, np.arange(103.0)), 5, 10, 1)
    for r in p.groupBy("rep").agg(F.sum("len").alias("n"), F.max(F.col("start") + F.col("len")).alias("m")).collect():
        assert r["n"] == 103 and r["m"] <= 103


def test_prefix_route_equals_row_route(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(50, 5, 103)
    s = series(spark, x)
    plan = rs.block_plan(s, 6, 10, 3)
    got = {r["rep"]: (r["mean"], r["std"]) for r in rs.mean_and_deviation(s, "idx", plan).collect()}
    for rep in range(6):
        b = sorted((r["b"], r["start"], r["len"]) for r in plan.filter(F.col("rep") == rep).collect())
        v = np.concatenate([x[st:st + ln] for _, st, ln in b])
        assert got[rep] == pytest.approx((v.mean(), v.std(ddof=1)))


def test_stationary_plan_walks(spark):
    """Runs fill every walk exactly, wrap around the end, and have the expected length."""
    n, reps = 400, 60
    rows = rs.stationary_plan(series(spark, np.arange(float(n))), reps, 10.0, 5).collect()
    assert {r["rep"] for r in rows} == set(range(reps))
    for k in range(reps):
        assert sum(r["len"] for r in rows if r["rep"] == k) == n
    assert all(r["len"] > 0 and 0 <= r["start"] and r["start"] + r["len"] <= n for r in rows)
    assert n * reps / len(rows) == pytest.approx(10, rel=0.15) and len(rows) < n * reps / 5


def test_stationary_mean_is_that_of_the_walks(spark):
    x = np.random.default_rng(4).normal(size=90)
    s = series(spark, x)
    plan = rs.stationary_plan(s, 8, 5.0, 3).collect()
    want = [np.concatenate([x[r["start"] : r["start"] + r["len"]] for r in plan if r["rep"] == k]).mean() for k in range(8)]
    assert rs.stationary_mean(s, "idx", 8, 5.0, 3).first()["boot_mean"] == pytest.approx(np.mean(want))


@pytest.mark.parametrize("block", [None, 1, 7, 16, 200])
def test_index_distribution_is_that_of_the_resampled_series(spark, block):
    x = np.random.default_rng(5).normal(size=103)
    s = series(spark, x)
    walks = {}
    for r in sorted(rs.block_plan(s, 25, block, 9).collect(), key=lambda r: (r["rep"], r["b"])):
        walks.setdefault(r["rep"], []).append(x[r["start"] : r["start"] + r["len"]])
    walks = [np.concatenate(w) for w in walks.values()]
    f = {"last": lambda w: w[-1], "mean": np.mean, "std": lambda w: w.std(ddof=1), "max": np.max}
    rows = rs.index_distribution(s, reps=25, block=block, seed=9).collect()
    assert len(rows) == 12
    for r in rows:
        v = [f[r["statistic"]](w) for w in walks]
        assert r["point"] == pytest.approx(f[r["statistic"]](x))
        assert (r["se"], r["bias"]) == pytest.approx((np.std(v, ddof=1), np.mean(v) - r["point"]), abs=1e-9)
        assert (r["lo"], r["hi"]) == pytest.approx(tuple(np.quantile(v, [(1 - r["level"]) / 2, (1 + r["level"]) / 2])), abs=1e-9)


def _auroc(y, s):
    wins = (s[y == 1][:, None] > s[y == 0]).sum() + (s[y == 1][:, None] == s[y == 0]).sum() / 2
    return wins / ((y == 1).sum() * (y == 0).sum())


def test_leave_one_out_auroc_equals_a_plain_jackknife(spark):
    rng = np.random.default_rng(6)
    y = (rng.random(70) < 0.3).astype(int)
    s = series(spark, np.arange(70.0))
    scores = {"a": np.round(rng.normal(size=70) + y, 1), "b": rng.integers(0, 4, 70).astype(float)}  # many ties
    rows = spark.createDataFrame([(float(i), int(y[i]), float(scores["a"][i]), float(scores["b"][i])) for i in range(70)], "idx double, label int, a double, b double")
    got = {r["model"]: (r["estimate"], r["a"]) for r in rs.auroc_jackknife(s.join(rows, "idx"), ["a", "b"], "label").collect()}
    for m, v in scores.items():
        loo = np.array([_auroc(np.delete(y, i), np.delete(v, i)) for i in range(70)])
        d = loo.mean() - loo
        assert got[m] == pytest.approx((_auroc(y, v), (d**3).sum() / (6 * (d**2).sum() ** 1.5)))
    out = {r["model"]: r for r in rs.bca_auroc(s.join(rows, "idx"), ["a", "b"], "label", reps=200, block=5).collect()}
    assert all(out[m]["lo"] < out[m]["estimate"] < out[m]["hi"] for m in scores)
    one = s.join(rows, "idx").withColumn("label", (F.col("idx") == 3).cast("int"))
    assert rs.auroc_jackknife(one, ["a"], "label").count() == 0  # a class of one row has no jackknife


def test_interval_contains_the_mean(spark):
    rng = np.random.default_rng(2)
    r = rs.block_bootstrap_mean(series(spark, rng.normal(10, 1, 300)), "idx", reps=100).first()
    assert r["lo"] < r["estimate"] < r["hi"]
    b = rs.bca(series(spark, rng.normal(10, 1, 300)), "idx", reps=100).first()
    assert b["lo"] < b["estimate"] < b["hi"]


def test_results_do_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(3)
    s = series(spark, rng.normal(size=200)).unionByName(series(spark, rng.normal(size=150), sid="B"))
    f = lambda d: sorted((r["series_id"], round(r["lo"], 12), round(r["hi"], 12)) for r in rs.block_bootstrap_mean(d, "idx", reps=30).collect())
    both = f(s.repartition(7))
    assert both == f(s.coalesce(1))
    assert [r for r in both if r[0] == "B"] == f(s.filter("series_id = 'B'"))


def test_any_statistic_is_that_of_the_resampled_rows_and_no_plan_is_broadcast(spark):
    """Whole replicates against numpy; rows with a null value or day take part, a null series does not."""
    rng = np.random.default_rng(5)
    values = {"A": [None, *rng.normal(size=69)], "B": [*rng.normal(size=7)], None: [1.0, 2.0]}
    rows = [(s, None if i == 3 else dt.date(2020, 1, 1) + dt.timedelta(days=i), None if v is None else float(v)) for s, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "series_id string, ds date, idx double").repartition(3).groupBy("series_id", "ds").agg(F.max("idx").alias("idx"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        out = rs.bootstrap_statistic(df, "idx", F.max, reps=120, block=20)
        got = {r["series_id"]: r for r in out.collect()}
        r = rs.mean_and_deviation(df.where("idx IS NOT NULL"), "idx", rs.block_plan(df, 120, 5, 42))
        r.collect()
        plans = out._jdf.queryExecution().executedPlan().toString() + r._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert set(got) == {"A", "B"}
    for s, r in got.items():
        v = [x for _, x in sorted(((d or dt.date.min, x) for k, d, x in rows if k == s), key=lambda t: t[0])]
        n, b = len(v), min(20, len(v))
        tops = []
        for rep in range(120):
            at = [int(rs.draw_np(42, rep, j)) % (n - b + 1) + k for j in range(-(-n // b)) for k in range(min(b, n - j * b))]
            tops.append(max(v[i] for i in at if v[i] is not None))
        assert r["reps"] == 120 and r["boot_mean"] == pytest.approx(np.mean(tops)) and r["hi"] == pytest.approx(np.quantile(tops, 0.975))
    assert not re.search(r"BroadcastHashJoin \[series_id#\d+, pos", plans)
