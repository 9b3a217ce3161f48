import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import days, panel, series
from stressloom import schema as S
from stressloom.operators import align, gram, linear, regimes, weights


def long(spark, values):
    return series(spark, values, name="value").withColumn("channel", F.lit("x"))


def test_white_noise_and_random_walk(spark):
    rng = np.random.default_rng(42)
    e = rng.normal(size=500)
    assert linear.stationarity(long(spark, e)).first()["verdict"] == "stationary"
    w = linear.stationarity(long(spark, e.cumsum())).first()
    assert w["verdict"] == "non-stationary" and w["transformation"] == "first_difference"


def test_planted_cause_is_found(spark):
    """Thirty independent pairs: the planted direction always shows, the other one at about its nominal rate."""
    rows = []
    for k in range(30):
        rng = np.random.default_rng(k)
        x = rng.normal(size=300)
        y = np.r_[0, 0.8 * x[:-1]] + rng.normal(0, 0.3, 300)
        rows += [(f"S{k}", d, "x", "y", float(a), float(b)) for d, a, b in zip(days(300), x, y)]
        rows += [(f"S{k}", d, "y", "x", float(b), float(a)) for d, a, b in zip(days(300), x, y)]
    df = spark.createDataFrame(rows, "series_id string, ds date, cause string, effect string, x double, y double")
    r = linear.granger(df, (1,)).cache()
    assert r.filter("cause = 'x' AND p < 0.001").count() == 30
    assert r.filter("cause = 'y' AND p < 0.05").count() <= 5


def test_cointegration(spark):
    rng = np.random.default_rng(2)
    w = rng.normal(size=500).cumsum()
    df = spark.createDataFrame([("A", d, float(2 * a + e), float(a)) for d, a, e in zip(days(500), w, rng.normal(size=500))], "series_id string, ds date, x double, y double")
    assert linear.engle_granger(df).first()["cointegrated"]
    v = np.column_stack([w, w + rng.normal(size=500), rng.normal(size=500).cumsum(), rng.normal(size=500).cumsum()])
    assert linear.johansen(panel(spark, {"A": v})).first()["rank"] == 1


def test_one_factor(spark):
    rng = np.random.default_rng(3)
    f = rng.normal(size=200)
    v = f[:, None] + rng.normal(0, 0.3, (200, 4))
    p = panel(spark, {"A": v})
    c1 = gram.pca(p).filter("component = 1").collect()
    assert c1[0]["share"] > 0.8 and sum(r["weight"] for r in c1) == pytest.approx(1)
    t = gram.pca_tests(p).first()
    assert t["kmo"] > 0.7 and t["chi2"] > 500
    corr = np.corrcoef(v.T)
    vif = {r["channel"]: r["vif"] for r in gram.collinearity(p).collect()}
    assert np.allclose([vif[c] for c in S.CHANNELS], np.diag(np.linalg.inv(corr)))


def direct_net(x, y, alpha, l1):
    n, p = x.shape
    b, c = np.zeros(p), y.mean()
    for _ in range(1000):
        old = b.copy()
        for j in range(p):
            r = y - c - x @ b + x[:, j] * b[j]
            rho = x[:, j] @ r / n
            b[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / ((x[:, j] ** 2).sum() / n + alpha * (1 - l1))
        c = (y - x @ b).mean()
        if np.abs(b - old).max() < 1e-4:
            break
    return b


def test_elastic_net_on_moments_equals_rows(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(50, 10, (300, 4))
    y = 0.5 * v[:, 0] - 0.2 * v[:, 2] + rng.normal(0, 1, 300)
    df = panel(spark, {"A": v}).join(series(spark, y, name="target"), ["series_id", "ds"])
    got = {r["channel"]: r for r in gram.elastic_net(df, "target").collect()}
    any_row = got["contagion_risk"]
    z = (v - v.mean(axis=0)) / v.std(axis=0)
    exp = direct_net(z, y, any_row["alpha"], any_row["l1_ratio"])
    assert np.allclose([got[c]["coef"] for c in S.CHANNELS], exp, atol=1e-6)
    assert sum(r["weight"] for r in got.values()) == pytest.approx(1)


def test_rolling_connectedness_equals_direct_fit(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(50, 5, (80, 4))
    v[1:] += 0.4 * v[:-1, [1, 2, 3, 0]]
    got = gram.rolling_connectedness(panel(spark, {"A": v}), 60).orderBy("ds").collect()
    assert len(got) == 21
    for k in (0, 20):
        w = v[k:k + 60]
        x = np.column_stack([np.ones(59), w[:-1]])
        b = np.linalg.lstsq(x, w[1:], rcond=None)[0]
        e = w[1:] - x @ b
        assert got[k]["connectedness"] == pytest.approx(gram.connectedness_total(e.T @ e / 59, b[1:].T), rel=1e-6)


def test_rolling_tail_equals_pairs(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(0, 12, (60, 4)).astype(float)
    got = linear.rolling_tail(panel(spark, {"A": v}), width=30, least=10).orderBy("at").collect()
    d = days(60)
    for r in (got[0], got[-1]):
        t = d.index(r["at"])
        w = v[max(0, t - 30): t]
        sg = np.sign(w[:, None, :] - w[None, :, :])
        s = np.einsum("abi,abj->ij", sg, sg)
        iu = np.triu_indices(4, 1)
        assert r["tau"] == pytest.approx(np.mean(s[iu] / np.sqrt(np.diag(s)[iu[0]] * np.diag(s)[iu[1]])))


def test_logit_equals_direct_steps(spark):
    """Two keys and two nested designs at once, one of the keys separated."""
    from stressloom.operators.newton import logit_fits

    rng = np.random.default_rng(7)
    x = rng.normal(size=6000)
    y = (rng.random(6000) < 1 / (1 + np.exp(-(-0.5 + 1.2 * x)))).astype(float)
    rows = [("A", float(a), float(b)) for a, b in zip(x, y)] + [("S", float(a), float(a > 0)) for a in x[:200]]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    fits, _ = logit_fits(df, ["k"], "y", {"own": [F.lit(1.0), F.lit(0.0)], "full": [F.lit(1.0), F.col("x")]})
    got = {(r["k"], r["model"]): r for r in fits.collect()}
    b, z = np.zeros(2), np.column_stack([np.ones(6000), x])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (y - p))
    r = got["A", "full"]
    assert r["moved"] < 1e-8 and np.allclose(r["b"], b, atol=1e-7) and np.allclose(b, [-0.5, 1.2], atol=0.1)
    assert r["ll"] == pytest.approx((y * (z @ b) - np.log1p(np.exp(z @ b))).sum())
    m = y.mean()
    assert np.allclose(got["A", "own"]["b"], [np.log(m / (1 - m)), 0], atol=1e-7)
    assert got["S", "full"]["moved"] > 0.1 and got["S", "full"]["ll"] == pytest.approx(0, abs=1e-6)


def test_state_and_onset_of_odd_series(spark):
    """No onset, no change of state, one row and no rows give nothing; the others are not touched by them."""
    rng = np.random.default_rng(13)
    cols = "series_id string, channel string, ds date, y double, x double, onset double, at_risk boolean"
    x = rng.normal(size=120)
    y = [float(i % 20 < 6) for i in range(120)]
    good = [("A", "c", d, a, float(b), float(i % 20 == 0), i % 20 == 0 or i % 20 > 5) for i, (d, a, b) in enumerate(zip(days(120), y, x))]
    still = [("B", "c", d, 0.0, float(b), 0.0, True) for d, b in zip(days(40), x)]
    df = spark.createDataFrame(good + still + [("C", "c", days(1)[0], 1.0, 1.0, 1.0, True)], cols)
    state, hazard = linear.state_logit(df).collect(), linear.onset_hazard(df).collect()
    assert [r["series_id"] for r in state] == ["A"] == [r["series_id"] for r in hazard]
    assert state[0]["n"] == 119 and state[0]["n_clusters"] == 12 and hazard[0]["n_events"] == 5
    assert linear.state_logit(df.limit(0)).count() == 0 and linear.onset_hazard(df.limit(0)).count() == 0


def test_quantile_line():
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 1, 4000)
    b = linear.quantile_regression(x, 1 + 2 * x + rng.normal(0, 0.1, 4000), 0.05)
    assert np.allclose(b, [1 - 0.1645, 2], atol=0.03)


def switching(n, seed):
    rng = np.random.default_rng(seed)
    z = (np.arange(n) // 50) % 2
    return np.where(z[:, None] == 1, 70, 30) + rng.normal(0, 4, (n, 4)), z


def test_regimes_recover_a_planted_switch(spark):
    arrays, truth = {}, {}
    for i in range(3):
        arrays[f"S{i}"], truth[f"S{i}"] = switching(300, i)
    p = panel(spark, arrays)
    m = regimes.fit(p, (2,), iterations=8)[2]
    assert np.allclose(m.means.mean(axis=1), [30, 70], atol=1.5)
    got = regimes.decode(p, m).orderBy("series_id", "ds").collect()
    hit = np.mean([r["regime"] == truth[r["series_id"]][i % 300] for i, r in enumerate(got)])
    assert hit > 0.99
    f = regimes.filtered(p, m).first()["probs"]
    assert sum(f) == pytest.approx(1)
    assert regimes.ergodic(m.trans).sum() == pytest.approx(1)
    alone = regimes.decode(p.filter("series_id = 'S1'"), m).orderBy("ds").collect()
    assert [r["regime"] for r in alone] == [r["regime"] for r in got if r["series_id"] == "S1"]


def test_save_and_load(spark, tmp_path):
    from stressloom.plans.composition import fixed_model

    m = fixed_model()
    regimes.save(spark, m, str(tmp_path / "m"))
    back = regimes.load(spark, str(tmp_path / "m"))
    assert np.allclose(back.covs, m.covs) and np.allclose(back.trans, m.trans)


def test_weights_sum_to_one(spark):
    rng = np.random.default_rng(9)
    p = panel(spark, {"A": rng.normal(50, 8, (120, 4)), "B": rng.normal(40, 3, (120, 4))})
    for w in (weights.critic(p), weights.entropy(p), weights.theoretical(p)):
        for r in w.groupBy("series_id").agg(F.sum("weight").alias("s")).collect():
            assert r["s"] == pytest.approx(1)


def test_positional_alignment_truncates(spark):
    a = series(spark, [1, 2, 3, 4]).unionByName(series(spark, [5, 6], sid="B"))
    got = align.positional(a, "B", "idx", from_end=True).orderBy("pos").collect()
    assert [(r["x"], r["y"]) for r in got] == [(4.0, 6.0), (3.0, 5.0)]


def test_fit_reports_convergence_and_ignores_partitioning(spark):
    arrays = {f"S{i}": switching(200, i)[0] for i in range(3)}
    p = panel(spark, arrays)
    m = regimes.fit(p, (2,), restarts=2)[2]
    assert m.converged and 1 < m.iterations <= regimes.ITERATIONS
    other = regimes.fit(p.repartition(7), (2,), restarts=2)[2]
    assert np.allclose(m.means, other.means) and m.iterations == other.iterations
    short = regimes.fit(p, (2,), restarts=1, iterations=2)[2]
    assert not short.converged and short.iterations == 2


def test_series_taken_together_have_the_sums_of_each_alone(spark, monkeypatch):
    """Series of several lengths (one of a single day), two models, passes over few and over many series."""
    rng = np.random.default_rng(4)
    arrays = {f"S{i}": switching(n, i)[0] for i, n in enumerate((150, 1, 60, 150, 2, 90))}
    p = panel(spark, arrays)
    models = {3000 + r: regimes._start(3, r, np.array([[25.0] * 4, [50.0] * 4, [75.0] * 4]) + rng.normal(size=(3, 4)), 50 * np.eye(4)) for r in range(2)}
    packs = regimes.pack(p)
    assert packs.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    for at_once in (1, 2000, regimes.AT_ONCE):
        monkeypatch.setattr(regimes, "AT_ONCE", at_once)
        got = {}
        for r in regimes._summed(regimes._estep(packs.coalesce(1), models)).collect():
            got.setdefault((r["model"], r["f"]), {})[r["i"]] = r["v"]
        for key, m in models.items():
            alone = [(x, *regimes.smooth(regimes.log_density(x, m), m)) for x in map(np.asarray, arrays.values())]
            want = {
                "loglik": [sum(ll for *_, ll in alone)], "n": [sum(map(len, arrays.values()))], "pi": sum(g[0] for _, g, _, _ in alone), "xi": sum(xi for _, _, xi, _ in alone).ravel(),
                "gamma": sum(g.sum(axis=0) for _, g, _, _ in alone), "gx": sum(g.T @ x for x, g, _, _ in alone).ravel(), "gxx": sum(np.einsum("tk,ti,tj->kij", g, x, x) for x, g, _, _ in alone).ravel(),
            }
            for f, w in want.items():
                assert np.allclose([got[key, f][i] for i in range(len(w))], w, rtol=1e-9, atol=1e-9), f
    gamma, _, _ = regimes.smooth_all(np.zeros((5, 3, 6)), np.full((2, 3), 1 / 3), np.full((2, 3, 3), 1 / 3), np.array([5, 2, 1]))
    assert (gamma.sum(axis=(0, 2)).round(12) == [10, 4, 2]).all()  # two models


def test_granger_weights_at_the_best_lag_equal_brute_force(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"  # where a lag above 1 is the best of some series
    from math import lgamma

    from stressloom.sources import tables

    def upper(f, d1, d2):
        """The upper tail of F, by the trapezoid rule on its beta integral."""
        top = np.arcsin(np.sqrt(d2 / (d2 + d1 * f)))
        t = np.linspace(0, top, 20001)[1:]
        v = 2 * np.exp((d2 - 1) * np.log(np.sin(t)) + lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2)) * np.cos(t) ** (d1 - 1)
        return float((v.sum() - v[-1] / 2) * top / 20000)

    p = tables.panel(spark, sf).select("series_id", "ds", "idx", *S.CHANNELS).orderBy("series_id", "ds").toPandas()
    want, later = {}, 0
    for sid, d in p.groupby("series_id"):
        score = {}
        for c in S.CHANNELS:
            both = d[["idx", c]].dropna().to_numpy(float)
            y, x, best = both[:, 0], both[:, 1], None
            for k in (1, 3, 7, 14, 30):
                n = len(y) - k
                if n <= 2 * k + 1:
                    continue
                own = np.column_stack([np.ones(n)] + [y[k - i : len(y) - i] for i in range(1, k + 1)])
                full = np.column_stack([own] + [x[k - i : len(x) - i] for i in range(1, k + 1)])
                a, b = (((y[k:] - m @ np.linalg.lstsq(m, y[k:], rcond=None)[0]) ** 2).sum() for m in (own, full))
                f = max(0.0, (a - b) / k / (b / (n - 2 * k - 1)))
                prob = upper(f, k, n - 2 * k - 1)
                best = min(best or (2, 0, 0), (prob, k, f))
            if best:
                score[c] = best[2] if best[0] < 0.10 else 0.0
                later += best[0] < 0.10 and best[1] > 1
        for c, v in score.items():
            want[sid, c] = (v, v / sum(score.values()) if sum(score.values()) else 1 / len(score))
    got = {(r["series_id"], r["channel"]): (r["score"], r["weight"]) for r in entry.queries()["wt_granger"](spark, sf).collect()}
    assert later and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-4, rel=1e-5) for k in want)


def test_best_lead_is_found_by_plain_search(spark):
    import numpy as np
    import pandas as pd

    from stressloom.operators import sensitivity as sn

    rng = np.random.default_rng(11)
    x = rng.normal(size=160)
    y = np.concatenate([rng.normal(size=6), x[:-6]]) + 0.3 * rng.normal(size=160)  # x leads by 6 rows
    z = rng.normal(size=160)
    rows = [("A", m, d, float(a), float(b)) for m, a_ in (("lead", x), ("noise", z)) for d, a, b in zip(days(160), a_, y)]
    df = spark.createDataFrame(rows, "series_id string, model string, ds date, score double, target double")
    got = {r["model"]: r for r in sn.best_lead(df, ["series_id", "model"], "score", "target", 10).collect()}
    for m, a in (("lead", x), ("noise", z)):
        rho = [abs(pd.Series(a[: 160 - k]).rank().corr(pd.Series(y[k:]).rank())) for k in range(11)]
        assert got[m]["lead"] == int(np.argmax(rho)) and abs(got[m]["lead_spearman"] - max(rho)) < 1e-9 and abs(got[m]["abs_spearman"] - rho[0]) < 1e-9
    assert got["lead"]["lead"] == 6


def test_validator_learns_from_training_days_alone(spark):
    """The regime model of the training part does not move with the days behind the split."""
    import numpy as np
    from helpers import panel

    from stressloom.operators import regimes

    rng = np.random.default_rng(12)
    first = np.concatenate([rng.normal(30, 4, (60, 4)), rng.normal(70, 4, (60, 4))])
    fits = []
    for shift in (0, 25):
        p = panel(spark, {"A": np.concatenate([first, rng.normal(50 + shift, 5, (40, 4))])})
        train = p.where(F.col("ds") < F.lit(days(121)[-1]))
        fits.append(regimes.fit(train, (2,), restarts=2)[2])
    assert np.allclose(fits[0].means, fits[1].means) and np.allclose(fits[0].trans, fits[1].trans)
