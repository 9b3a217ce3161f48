import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import days, panel, series
from stressloom.functions import arrays as A
from stressloom.functions import special as sp
from stressloom.operators import aggregates as ag
from stressloom.operators import breaks, classify, compose, paths, rolling
from stressloom.operators import event_study as es


@pytest.mark.parametrize("t,df,p", [(2.0452, 29, 0.05), (1.9600, 1e7, 0.05), (2.7045, 40, 0.01), (12.706, 1, 0.05)])
def test_student(t, df, p):
    assert float(sp.t_two_sided(t, df)) == pytest.approx(p, rel=2e-4)


@pytest.mark.parametrize("x,df,p", [(3.841, 1, 0.05), (18.307, 10, 0.05), (0.5, 1, 0.4795), (124.342, 100, 0.05)])
def test_chi_square(x, df, p):
    assert float(sp.chi2_sf(x, df)) == pytest.approx(p, rel=1e-3)


@pytest.mark.parametrize("f,a,b,p", [(4.08, 1, 40, 0.05), (2.25, 7, 40, 0.05), (3.0, 5, 1000, 0.0108)])
def test_fisher(f, a, b, p):
    assert float(sp.f_sf(f, a, b)) == pytest.approx(p, rel=2e-2)


def test_student_quantile_expansion(spark):
    got = [r["q"] for r in spark.createDataFrame([(29,), (40,), (60,), (98,)], "v int").select(paths.student_quantile(paths.Z_975, F.col("v")).alias("q")).collect()]
    for q, df in zip(got, (29, 40, 60, 98)):
        assert float(sp.t_two_sided(q, df)) == pytest.approx(0.05, rel=1e-6)


def tau_b(x, y):
    c = tx = ty = 0
    n = len(x)
    for i, j in itertools.combinations(range(n), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        c += a * b
        tx += a == 0
        ty += b == 0
    p = n * (n - 1) / 2
    return c / math.sqrt((p - tx) * (p - ty))


@pytest.mark.parametrize("levels", [4, 1000])
def test_kendall_equals_pairs(spark, levels):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, levels, 120), rng.integers(0, levels, 120)
    y = y + x // 2
    df = spark.createDataFrame([("A", float(a), float(b)) for a, b in zip(x, y)], "series_id string, x double, y double")
    assert ag.kendall(df, ["series_id"]).first()["tau"] == pytest.approx(tau_b(x, y), abs=1e-12)


def test_ewma_equals_recursion(spark):
    rng = np.random.default_rng(2)
    v = 50 + rng.normal(0, 5, (700, 4)).cumsum(axis=0) * 0.2
    got = compose.ewma_products(panel(spark, {"A": v})).orderBy("ds").select(*[f"c{i}{j}" for i, j in compose.PAIRS]).collect()
    cov = np.zeros((4, 4))
    for t, d in enumerate(np.diff(v, axis=0)):
        o = np.outer(d, d)
        cov = t / (t + 1) * cov + o / (t + 1) if t < 30 else 0.94 * cov + 0.06 * o
        assert np.allclose([cov[i, j] for i, j in compose.PAIRS], list(got[t + 1]), atol=1e-10)


def test_hac_equals_direct_sum(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(1, 2, 41).cumsum()
    df = spark.createDataFrame([(y.tolist(),)], "y array<double>")
    for lags in (3, 20):
        e = y - y.mean()
        s = e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
        r = df.select(es.hac_columns(F.col("y"), lags).alias("h")).first()["h"]
        assert r["se_mean"] == pytest.approx(math.sqrt(s) / 41, rel=1e-9)
        assert r["t_hac"] == pytest.approx(y.mean() / (math.sqrt(s) / 41), rel=1e-9)


def test_forward_drawdown(spark):
    rng = np.random.default_rng(4)
    r = rng.normal(0, 0.05, 60)
    got = [x["drawdown"] for x in paths.forward_drawdown(series(spark, r, name="ret"), "ret", 10).orderBy("ds").collect()]
    for i in range(60):
        if i < 50:
            c = np.cumprod(1 + r[i:i + 10])
            pk = np.maximum.accumulate(c)
            assert got[i] == pytest.approx(((c - pk) / pk).min(), abs=1e-12)
        else:
            assert got[i] is None


def test_expanding_quantile(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, 80).astype(float)
    got = [r["q_idx"] for r in rolling.expanding_quantiles(series(spark, x), ["idx"], 0.9).orderBy("ds").collect()]
    assert np.allclose(got, [np.quantile(x[:i + 1], 0.9) for i in range(80)])


def test_event_study_finds_a_planted_spike(spark):
    rng = np.random.default_rng(42)
    x = 50 + rng.normal(0, 1, 200)
    x[130:160] = 70
    e = spark.createDataFrame([("E", days(200)[150], "high", ["a"])], "event string, event_date date, expected_level string, key_channels array<string>")
    r = es.study(series(spark, x), e).first()
    assert r["cas"] > 300 and r["t_stat"] > 10 and r["lead_days"] >= 20


def test_profiles_differ_in_look_back(spark):
    x = np.concatenate([np.full(160, 40.0) + np.arange(160) % 2 * 0.1, np.full(67, 48.0)])
    e = spark.createDataFrame([("E", days(227)[200])], "event string, event_date date")
    s = series(spark, x)
    assert es.study(s, e, "paper_v2").first()["lead_days"] == 30
    assert es.study(s, e, "legacy_v1").first()["lead_days"] == 40


def test_sustained_lead(spark):
    x = np.full(120, 40.0)
    x[70:80], x[90:] = 60, 60
    e = spark.createDataFrame([("E", days(120)[105])], "event string, event_date date")
    assert es.lead_times(series(spark, x), e, 60).first()["sustained"] == 15


def test_auc_and_its_complement(spark):
    rng = np.random.default_rng(6)
    s, y = rng.integers(0, 30, 400), rng.integers(0, 2, 400)
    df = spark.createDataFrame([("A", float(a), int(b)) for a, b in zip(s, y)], "k string, score double, label int")
    pos, neg = s[y == 1], s[y == 0]
    exp = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    a = classify.areas(classify.curve(df, ["k"]), ["k"]).first()["auroc"]
    b = classify.areas(classify.curve(df.withColumn("label", 1 - F.col("label")), ["k"]), ["k"]).first()["auroc"]
    assert a == pytest.approx(exp) and a + b == pytest.approx(1)


def test_bucketed_curve_is_the_same(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([("A", float(rng.normal(0, 30)), int(rng.integers(0, 2))) for _ in range(500)], "k string, score double, label int")
    key = lambda c: sorted(tuple(r) for r in c.select("score", "pos", "neg", "tp", "fp", "n_pos", "n_neg").collect())
    assert key(classify.curve(df, ["k"])) == key(classify.curve(df, ["k"], width=7.0))


def test_spaced_breaks(spark):
    hits = [5, 10, 36, 60, 67, 100]
    x = np.zeros(120)
    x[hits] = 2.0
    got = [r["break_date"] for r in paths.spaced_breaks(series(spark, x, name="cusum")).orderBy("break_date").collect()]
    assert got == [days(120)[i - 0] for i in (5, 36, 67, 100)]


def test_circular_shift_equals_loop(spark):
    rng = np.random.default_rng(8)
    x, o = rng.normal(size=90), np.zeros(90)
    o[[10, 40, 77]] = 1
    df = series(spark, x, name="x").join(series(spark, o, name="o"), ["series_id", "ds"])
    r = breaks.circular_shift(df, "o", "x").first()
    pos = np.flatnonzero(o)
    stat = np.array([x[(pos + s - 1) % 90].mean() for s in range(90)])
    assert r["observed"] == pytest.approx(stat[0]) and r["p"] == pytest.approx((1 + (stat >= stat[0] - 1e-9).sum()) / 91)


def test_let_evaluates_to_body(spark):
    df = spark.createDataFrame([([1.0, 2.0, 6.0],)], "a array<double>")
    assert df.select(A.astd(F.col("a")).alias("s")).first()["s"] == pytest.approx(np.std([1, 2, 6], ddof=1))


def test_debye(spark):
    for th in (0.5, 2.0, 8.0):
        t = (np.arange(200000) + 0.5) * th / 200000
        exact = np.mean(t / (np.exp(t) - 1))
        got = spark.range(1).select(compose.debye(F.lit(th)).alias("d")).first()["d"]
        assert got == pytest.approx(exact, rel=1e-8)
