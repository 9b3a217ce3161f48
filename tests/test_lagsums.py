"""Regressions on lagged sums against plain least squares on the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import days, panel, series
from stressloom import schema as S
from stressloom.operators import linear
from stressloom.operators.lagsums import Lagged, lag_sums


def left(y, x):
    return y - x @ np.linalg.lstsq(x, y, rcond=None)[0]


def past(v, p):
    return np.column_stack([v[p - i: len(v) - i] for i in range(1, p + 1)])


def walk(n, seed, k=4):
    rng = np.random.default_rng(seed)
    v = rng.normal(50, 5, (n, k))
    for t in range(1, n):
        v[t] += 0.5 * (v[t - 1] - 50) + 0.2 * np.roll(v[t - 1] - 50, 1)
    return v


@pytest.mark.parametrize("n", [3, 9, 40])
def test_moments_of_every_lag_and_start(spark, n):
    """Ends overlap where the series is shorter than twice the furthest lag."""
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=n), rng.normal(size=n)
    df = series(spark, a, name="a").join(series(spark, b, name="b"), ["series_id", "ds"])
    s = Lagged(*lag_sums(df, ["series_id"], [F.col("a"), F.col("b")], 6).select("n", "ends", "sums").first())
    v = np.column_stack([np.ones(n), a - a.mean(), b - b.mean()])
    for start in range(min(6, n - 1) + 1):
        names = [(0, 0)] + [(c, i) for c in (1, 2) for i in range(start + 1)]
        x = np.column_stack([v[start - i: n - i, c] for c, i in names])
        assert np.allclose(s.moments(names, start), x.T @ x, atol=1e-10)


def test_granger_equals_rows(spark):
    v = walk(120, 1)
    p = panel(spark, {"A": v, "B": v[:5]})
    got = {(r["cause"], r["effect"], r["lag"]): r for r in linear.granger(linear.granger_pairs(p)).collect() if r["series_id"] == "A"}
    assert len(got) == 12 * 5
    for (c, e, k), r in got.items():
        x, y = v[:, S.CHANNELS.index(c)], v[:, S.CHANNELS.index(e)]
        own = np.column_stack([np.ones(120 - k), past(y, k)])
        a, b = ((left(y[k:], z) ** 2).sum() for z in (own, np.column_stack([own, past(x, k)])))
        assert r["f_stat"] == pytest.approx((a - b) / k / (b / (120 - 3 * k - 1)), rel=1e-7) and r["df2"] == 120 - 3 * k - 1
    shared = {(r["cause"], r["effect"], r["lag"]): r["f_stat"] for r in linear.granger_panel(p).where("series_id = 'A'").collect()}
    assert shared == pytest.approx({k: r["f_stat"] for k, r in got.items()})
    short = linear.granger(linear.granger_pairs(p)).where("series_id = 'B'").collect()
    assert {r["lag"] for r in short} == {1}  # five rows allow one lag alone


def test_lag_order_equals_rows(spark):
    v = walk(150, 2)
    got = {r["criterion"]: r for r in linear.var_lag(panel(spark, {"A": v}), 8).collect()}
    for name, pen in (("aic", lambda t: 2.0), ("bic", np.log), ("hqic", lambda t: 2 * np.log(np.log(t)))):
        ic = {}
        for p in range(1, 9):
            t = 150 - p
            e = left(v[p:], np.column_stack([np.ones(t)] + [v[p - i: 150 - i] for i in range(1, p + 1)]))
            ic[p] = np.log((e * e).sum() / t) + pen(t) * 4 * (1 + 4 * p) / t
        best = min(ic, key=ic.get)
        assert got[name]["lag"] == best and got[name]["value"] == pytest.approx(ic[best], rel=1e-9)


def root(v):
    dv, n = np.diff(v), len(v)
    top = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)

    def fit(p, skip):
        y = dv[skip:]
        x = np.column_stack([v[skip:-1], *[dv[skip - i: len(dv) - i] for i in range(1, p + 1)], np.ones(len(y))])
        e = left(y, x)
        m, k = x.shape
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        return b[0] / np.sqrt((e @ e) / (m - k) * np.linalg.inv(x.T @ x)[0, 0]), m * np.log((e @ e) / m) + 2 * k

    best = min(range(top + 1), key=lambda p: fit(p, top)[1])
    return fit(best, best)[0], best


@pytest.mark.parametrize("n", [20, 130])
def test_unit_root_equals_rows(spark, n):
    for seed in range(3):
        v = np.random.default_rng(seed).normal(size=n).cumsum() + 1e3 * seed
        r = linear.adf(series(spark, v, name="value").withColumn("channel", F.lit("x"))).first()
        t, best = root(v)
        assert r["lags"] == best and r["adf"] == pytest.approx(t, rel=1e-6)


def test_cointegration_equals_rows(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=200).cumsum()
    x = 2 * y + rng.normal(size=200)
    df = spark.createDataFrame([("A", d, float(a), float(b)) for d, a, b in zip(days(200), x, y)], "series_id string, ds date, x double, y double")
    assert linear.engle_granger(df).first()["statistic"] == pytest.approx(root(left(x, np.column_stack([np.ones(200), y])))[0], rel=1e-6)
    v = walk(200, 6).cumsum(axis=0)
    got = [r["eigenvalue"] for r in linear.johansen(panel(spark, {"A": v})).orderBy("r").collect()]
    dv = np.diff(v, axis=0)
    z = np.column_stack([np.ones(198), dv[:-1]])
    r0, rk = left(dv[1:], z), left(v[1:-1], z)
    m = np.linalg.solve(rk.T @ rk, rk.T @ r0) @ np.linalg.solve(r0.T @ r0, r0.T @ rk)
    assert np.allclose(got, np.sort(np.linalg.eigvals(m).real)[::-1], rtol=1e-6)


def test_odd_series(spark):
    """Constant, too short, with gaps and empty: null statistics or no rows, never an error."""
    flat = series(spark, [3.0] * 40, name="value").withColumn("channel", F.lit("x"))
    r = linear.stationarity(flat).first()
    assert r["adf"] is None and r["kpss"] is None and r["verdict"] == "inconclusive"
    short = series(spark, [1.0, 2.0, 4.0], name="value").withColumn("channel", F.lit("x"))
    assert linear.adf(short).count() == 0 and linear.adf(short.limit(0)).count() == 0
    gaps = series(spark, [float(i % 7) + 0.01 * i * i for i in range(60)], name="value").withColumn("channel", F.lit("x"))
    holes = gaps.withColumn("value", F.when(F.dayofmonth("ds") != 5, F.col("value")))
    assert linear.adf(holes).first()["adf"] == pytest.approx(linear.adf(gaps.where(F.dayofmonth("ds") != 5)).first()["adf"])
    p = panel(spark, {"A": np.full((60, 4), 5.0), "B": np.ones((2, 4))})
    assert {r["f_stat"] for r in linear.granger(linear.granger_pairs(p)).collect()} == {0.0}
    assert linear.var_lag(p).count() == 0 and linear.johansen(p.where("series_id = 'B'")).count() == 0
    pairs = p.select("series_id", "ds", F.col(S.CHANNELS[0]).alias("x"), F.col(S.CHANNELS[1]).alias("y"))
    assert [r["statistic"] for r in linear.engle_granger(pairs).collect()] == [None]
