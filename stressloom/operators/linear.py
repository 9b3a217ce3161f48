"""Per-series regressions and tests: lagged F tests, unit roots, cointegration, discrete-outcome models.

Regressions on a series' own past read lagged second moments that Spark sums (lagsums); only matrices of the size of the regression
are solved, one row per key. Models without such sums are fitted per series, bounded by the calendar. p-values are added on
result rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stressloom import schema as S
from stressloom.functions.special import norm_sf, p_chi2, p_fisher
from stressloom.operators.breaks import kpss
from stressloom.operators.lagsums import Lagged, lag_sums, partial, solve_by
from stressloom.operators.newton import chance, dot, logit_fits
from stressloom.operators.windows import by_day
from stressloom.session import spread

LAGS = [1, 3, 7, 14, 30]


def _by(df: DataFrame, keys: list[str], schema: str, body) -> DataFrame:
    """body(sorted frame) -> list of tuples after the keys."""
    names = [p.strip().split(" ")[0] for p in schema.split(",")]
    types = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = [pdf[k].iloc[0] for k in keys]
        return pd.DataFrame([tuple(head) + tuple(t) for t in body(pdf.sort_values("ds"))], columns=keys + names)

    return spread(df, *keys).groupBy(*keys).applyInPandas(run, types + ", " + schema)


def lags_of(v: np.ndarray, p: int) -> np.ndarray:
    return np.column_stack([v[p - i: len(v) - i] for i in range(1, p + 1)])


def granger_pairs(panel: DataFrame, target: str | None = None) -> DataFrame:
    """Rows (series_id, cause, effect, ds, x, y) for ordered channel pairs, or all channels against one target column."""
    if target:
        cells = [F.struct(F.lit(c).alias("cause"), F.lit(target).alias("effect"), F.col(c).alias("x"), F.col(target).alias("y")) for c in S.CHANNELS]
    else:
        cells = [F.struct(F.lit(a).alias("cause"), F.lit(b).alias("effect"), F.col(a).alias("x"), F.col(b).alias("y")) for a in S.CHANNELS for b in S.CHANNELS if a != b]
    return panel.select("series_id", "ds", F.inline(F.array(*cells)))


def lagged_f(s: Lagged, x: int, y: int, lags) -> list[tuple]:
    """(lag, F, df1, df2) of the test that p lags of column x add to p lags of column y; lags that leave too few rows give none."""
    out = []
    for p in lags:
        n = s.n - p
        if n <= 2 * p + 1:
            continue
        m = s.moments([(0, 0), *[(y, i) for i in range(1, p + 1)], *[(x, i) for i in range(1, p + 1)], (y, 0)], p)
        own = np.r_[: p + 1, 2 * p + 1]
        a, b = (max(0.0, partial(z, len(z) - 1)[1][0, 0]) for z in (m[np.ix_(own, own)], m))
        df2 = n - (2 * p + 1)
        out.append((p, max(0.0, ((a - b) / p) / (b / df2)) if b > 0 else 0.0, p, df2))
    return out


GRANGER = "lag int, f_stat double, df1 int, df2 int"


def granger(pairs: DataFrame, lags=tuple(LAGS)) -> DataFrame:
    """F test of x on y for rows (series_id, cause, effect, ds, x, y); rows without one of both are left out."""
    keys = ["series_id", "cause", "effect"]
    sums = lag_sums(pairs.na.drop(subset=["x", "y"]), keys, [F.col("y"), F.col("x")], max(lags))
    return solve_by(sums, keys, GRANGER, lambda s: lagged_f(s, 2, 1, lags)).withColumn("p", p_fisher("f_stat", "df1", "df2"))


def granger_panel(panel: DataFrame, target: str | None = None, lags=tuple(LAGS)) -> DataFrame:
    """The same for ordered channel pairs, or all channels against one target column, from one set of sums over the panel; rows with
    a null in any of these columns are left out."""
    cols = S.CHANNELS + ([target] if target else [])
    pairs = [(a, b) for a in S.CHANNELS for b in ([target] if target else S.CHANNELS) if a != b]
    body = lambda s: [(a, b, *t) for a, b in pairs for t in lagged_f(s, cols.index(a) + 1, cols.index(b) + 1, lags)]
    sums = lag_sums(panel.select("series_id", "ds", *cols).na.drop(), ["series_id"], [F.col(c) for c in cols], max(lags))
    return solve_by(sums, ["series_id"], "cause string, effect string, " + GRANGER, body).withColumn("p", p_fisher("f_stat", "df1", "df2"))


def var_lag(panel: DataFrame, max_lag: int = 30) -> DataFrame:
    """Lag order by AIC, BIC and HQIC on the log of the summed squared residuals over all equations."""
    k = len(S.CHANNELS)

    def body(s: Lagged):
        best = {}
        for p in range(1, min(max_lag + 1, s.n // (k + 2))):
            t = s.n - p
            if t < k * p + 10:
                continue
            cols = range(1, k + 1)
            m = s.moments([(0, 0), *[(c, i) for i in range(1, p + 1) for c in cols], *[(c, 0) for c in cols]], p)
            left = np.trace(partial(m, 1 + k * p)[1])
            if left <= 0:
                continue
            base, size = np.log(left / t), k * (1 + k * p)
            for name, pen in (("aic", 2.0), ("bic", np.log(t)), ("hqic", 2 * np.log(np.log(t)))):
                ic = base + pen * size / t
                if name not in best or ic < best[name][1]:
                    best[name] = (p, float(ic))
        return [(name, p, ic) for name, (p, ic) in best.items()]

    sums = lag_sums(panel.select("series_id", "ds", *S.CHANNELS).na.drop(), ["series_id"], [F.col(c) for c in S.CHANNELS], max_lag)
    return solve_by(sums, ["series_id"], "criterion string, lag int, value double", body)


# Response-surface coefficients of the unit-root p-value (constant, one series) and critical values.
ADF_SMALL = [2.1659, 1.4412, 0.038269]
ADF_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_CRITICAL = {"1%": -3.43, "5%": -2.86, "10%": -2.57}
KPSS_CRITICAL = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]
JOHANSEN_TRACE_5 = [47.8545, 29.7961, 15.4943, 3.8415]
JOHANSEN_EIGEN_5 = [27.5858, 21.1314, 14.2639, 3.8415]


def adf_lags(n: int) -> int:
    """Most lags tried; negative where the series is too short."""
    return min(int(np.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)


def adf_sums(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Lagged moments of the level (column 1) and its difference (column 2)."""
    d = long.select(*keys, "ds", F.col(value).alias("v")).na.drop(subset=["v"])
    d = spread(d, *keys).withColumn("dv", F.col("v") - F.lag("v").over(by_day(tuple(keys))))
    top = F.ceil(12.0 * F.pow(F.col("n") / 100.0, F.lit(0.25)))
    return lag_sums(d, keys, [F.col("v"), F.col("dv")], F.greatest(F.least(top, F.floor(F.col("n") / 2) - 2), F.lit(0)) + 1)


def adf_stat(s: Lagged) -> tuple[float, int]:
    """t of the lagged level with the lag count chosen by AIC on a common sample, then refitted; nan for a series without variation."""
    top = adf_lags(s.n)

    def fit(p, skip):
        m = s.moments([(1, 1), *[(2, i) for i in range(1, p + 1)], (0, 0), (2, 0)], skip + 1)
        n, k = s.n - 1 - skip, p + 2
        b, left, inv = partial(m, k)
        if n <= k or left[0, 0] <= 1e-14 * m[-1, -1]:
            return np.nan, np.inf
        s2 = float(left[0, 0])
        return b[0, 0] / np.sqrt(s2 / (n - k) * inv[0, 0]), n * (np.log(2 * np.pi) + np.log(s2 / n) + 1) + 2 * k

    best = min(range(top + 1), key=lambda p: fit(p, top)[1])
    return float(fit(best, best)[0]), best


def adf_p(t: float) -> float:
    if t > ADF_MAX:
        return 1.0
    if t < ADF_MIN:
        return 0.0
    z = np.polyval((ADF_SMALL if t <= ADF_STAR else ADF_LARGE)[::-1], t)
    return float(1.0 - norm_sf(z))


def kpss_p(c) -> Column:
    """Linear between the critical values, constant beyond them."""
    x, out = F.col(c), F.lit(KPSS_CRITICAL[-1][1])
    for (a, p), (b, q) in reversed(list(zip(KPSS_CRITICAL, KPSS_CRITICAL[1:]))):
        out = F.when(x < b, F.lit(p) + (x - a) * ((q - p) / (b - a))).otherwise(out)
    return F.when(x < KPSS_CRITICAL[0][0], F.lit(KPSS_CRITICAL[0][1])).when(x.isNotNull(), out)


def adf(long: DataFrame, least: int = 20) -> DataFrame:
    """Unit-root statistic per series and channel; series shorter than `least` give no row, constant ones a null."""

    def body(s: Lagged):
        if s.n < least or adf_lags(s.n) < 0:
            return []
        t, p = adf_stat(s)
        return [(s.n, t, adf_p(t), p)]

    keys = ["series_id", "channel"]
    return solve_by(adf_sums(long, keys), keys, "n bigint, adf double, p double, lags int", body)


def stationarity(long: DataFrame, alpha: float = 0.05, least: int = 20) -> DataFrame:
    """Unit-root and level tests together, with the recommended transformation."""
    keys = ["series_id", "channel"]
    level = kpss(long.na.drop(subset=["value"]), "value", keys=keys).select(*keys, "kpss")
    both = adf(long, least).select(*keys, "n", "adf", F.col("p").alias("adf_p")).join(level, keys).withColumn("kpss_p", kpss_p("kpss"))
    root, drift = F.coalesce(F.col("adf_p") < alpha, F.lit(False)), F.coalesce(F.col("kpss_p") < alpha, F.lit(False))
    verdict = F.when(root & ~drift, "stationary").when(~root & drift, "non-stationary").when(root, "trend-stationary").otherwise("inconclusive")
    change = F.when(root & ~drift, F.lit(None)).when(root, "detrend").otherwise("first_difference")
    return both.withColumns({"verdict": verdict, "transformation": change})


def engle_granger(pairs: DataFrame) -> DataFrame:
    """Unit-root statistic of the residual of x on y against the fixed critical values; fewer than ten rows give none."""

    def body(s: Lagged):
        if s.n < 10:
            return []
        t, _ = adf_stat(s)
        inside = [p for level, p in S.EG_P_BELOW.items() if t < S.EG_CRITICAL[level]]
        above = S.EG_P_ABOVE["start"] + S.EG_P_ABOVE["slope"] * (t - S.EG_CRITICAL["10%"])
        p = min(inside) if inside else min(S.EG_P_ABOVE["most"], max(S.EG_P_ABOVE["least"], above))
        return [(s.n, t, p, p < 0.05)]

    e = Window.partitionBy("series_id")
    d = spread(pairs.na.drop(subset=["x", "y"]), "series_id")
    d = d.select("series_id", "ds", "x", "y", F.coalesce(F.regr_slope("x", "y").over(e), F.lit(0.0)).alias("b"), F.avg("x").over(e).alias("mx"), F.avg("y").over(e).alias("my"))
    d = d.withColumn("e", F.col("x") - F.col("mx") - F.col("b") * (F.col("y") - F.col("my")))
    return solve_by(adf_sums(d, ["series_id"], "e"), ["series_id"], "n bigint, statistic double, p double, cointegrated boolean", body)


def johansen(panel: DataFrame, diffs: int = 1) -> DataFrame:
    """Trace and maximum-eigenvalue statistics with a constant, rank at 5 percent; series too short for it give no row."""
    k = len(S.CHANNELS)
    level, change = range(1, k + 1), range(k + 1, 2 * k + 1)

    def body(s: Lagged):
        t = s.n - 1 - diffs
        if t <= k * (diffs + 2) + 1:
            return []
        m = s.moments([(0, 0), *[(c, i) for i in range(1, diffs + 1) for c in change], *[(c, 0) for c in change], *[(c, diffs) for c in level]], diffs + 1)
        left = partial(m, 1 + k * diffs)[1] / t
        s00, s0k, skk = left[:k, :k], left[:k, k:], left[k:, k:]
        val = np.sort(np.linalg.eigvals(np.linalg.pinv(skk) @ s0k.T @ np.linalg.pinv(s00) @ s0k).real)[::-1]
        lg = -t * np.log(1 - val)
        trace = [float(lg[i:].sum()) for i in range(len(lg))]
        rank = sum(a > c for a, c in zip(trace, JOHANSEN_TRACE_5))
        return [(i, float(val[i]), trace[i], float(lg[i]), JOHANSEN_TRACE_5[i], JOHANSEN_EIGEN_5[i], rank) for i in range(len(lg))]

    d = spread(panel.select("series_id", "ds", *S.CHANNELS).na.drop(), "series_id")
    d = d.withColumns({f"d{i}": F.col(c) - F.lag(c).over(by_day()) for i, c in enumerate(S.CHANNELS)})
    sums = lag_sums(d, ["series_id"], [F.col(c) for c in S.CHANNELS] + [F.col(f"d{i}") for i in range(k)], diffs + 1)
    return solve_by(sums, ["series_id"], "r int, eigenvalue double, trace double, max_eigen double, trace_5 double, eigen_5 double, rank int", body)


def lagged_columns(df: DataFrame, keys: list[str], cols: list[str], lag: int) -> DataFrame:
    """c_1..c_lag beside every column; the first `lag` rows of a key leave."""
    w = Window.partitionBy(*keys).orderBy("ds")
    d = spread(df, *keys).withColumns({f"{c}_{i}": F.lag(F.col(c).cast("double"), i).over(w) for c in cols for i in range(1, lag + 1)})
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > lag).drop("_r")


def state_logit(df: DataFrame, lag: int = 1) -> DataFrame:
    """Lagged-state logit with and without lagged x: likelihood ratio, and a Wald test with errors clustered by run. A series whose
    state never changes gives no row."""
    keys = ["series_id", "channel"]
    d = lagged_columns(df.select(*keys, "ds", F.col("y").cast("double"), F.col("x").cast("double")), keys, ["y", "x"], lag)
    w = by_day(tuple(keys))
    change = F.coalesce((F.col("y") != F.lag("y").over(w)).cast("int"), F.lit(0))
    e = Window.partitionBy(*keys)
    d = d.withColumns({"run": F.sum(change).over(w), "lo": F.min("y").over(e), "hi": F.max("y").over(e)}).where("lo < hi")
    own = [F.lit(1.0), *[F.col(f"y_{i}") for i in range(1, lag + 1)]]
    more = [F.col(f"x_{i}") for i in range(1, lag + 1)]
    none = [F.lit(0.0)] * lag
    fits, rows = logit_fits(d, keys, "y", {"own": own + none, "full": own + more}, ["run"])
    k = 1 + 2 * lag
    full = fits.where("model = 'full'")
    # scores add up within a run before their outer products do
    at = rows.where("model = 'full'").join(full.select(*keys, "b"), keys).withColumn("e", F.col("y") - chance(dot("x", "b", k)))
    runs = at.groupBy(*keys, "run").agg(F.array(*[F.sum(F.col("x")[i] * F.col("e")) for i in range(k)]).alias("g"))
    meat = runs.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n_clusters"), F.array(*[F.sum(F.col("g")[i] * F.col("g")[j]) for i in range(k) for j in range(k)]).alias("meat"))
    both = full.join(fits.where("model = 'own'").select(*keys, F.col("ll").alias("ll_own")), keys).join(meat, keys)

    def wald(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                inv, m = np.linalg.pinv(np.reshape(r.h, (k, k))), r.n_clusters
                cov = inv @ np.reshape(r.meat, (k, k)) @ inv * (m / (m - 1) if m > 1 else 1.0)
                b, v = np.array(r.b)[k - lag:], cov[k - lag:, k - lag:]
                out.append((r.series_id, r.channel, r.n, max(0.0, 2 * (r.ll - r.ll_own)), lag, float(b @ np.linalg.pinv(v) @ b), m, bool(r.moved < 1e-6)))
            yield pd.DataFrame(out, columns=["series_id", "channel", "n", "lr", "df", "wald", "n_clusters", "converged"])

    types = "series_id string, channel string, n bigint, lr double, df int, wald double, n_clusters int, converged boolean"
    return both.mapInPandas(wald, types).withColumn("p_lr", p_chi2("lr", "df")).withColumn("p_wald", p_chi2("wald", "df"))


def onset_hazard(df: DataFrame, lag: int = 1) -> DataFrame:
    """Onset on lagged x over the days at risk: likelihood ratio, coefficient, separation flag. A series without an onset gives no row."""
    keys = ["series_id", "channel"]
    w, e = by_day(tuple(keys)), Window.partitionBy(*keys)
    d = spread(df, *keys).select(*keys, "ds", F.col("onset").cast("double").alias("y"), "at_risk", F.lag(F.col("x").cast("double"), lag).over(w).alias("v"), F.row_number().over(w).alias("_r"))
    d = d.where((F.col("_r") > lag) & F.col("at_risk")).withColumn("n_events", F.sum("y").over(e)).where("n_events > 0")
    fits, _ = logit_fits(d, keys, "y", {"own": [F.lit(1.0), F.lit(0.0)], "full": [F.lit(1.0), F.col("v")]})
    own = fits.where("model = 'own'").select(*keys, F.col("ll").alias("ll_own"))
    f = fits.where("model = 'full'").join(own, keys)
    h = lambda i: F.col("h")[i]
    det = h(0) * h(3) - h(1) * h(2)
    var = F.greatest(F.try_divide(h(0), det), F.try_divide(h(3), det))
    apart = (F.abs(F.col("b")[0]) > 25) | (F.abs(F.col("b")[1]) > 25) | F.coalesce(var > 25.0 * 25.0, F.lit(True))
    out = f.select(*keys, F.col("n").alias("n_riskset"), F.col("events").alias("n_events"), F.greatest(F.lit(0.0), 2 * (F.col("ll") - F.col("ll_own"))).alias("lr"),
                   F.col("b")[1].alias("coef"), (F.col("moved") < 1e-6).alias("converged"), apart.alias("separation"))
    return out.withColumn("p", p_chi2("lr", F.lit(1.0)))


def quantile_regression(x: np.ndarray, y: np.ndarray, q: float, steps: int = 1000) -> np.ndarray:
    """Iteratively reweighted least squares for the pinball loss."""
    z = np.column_stack([np.ones(len(x)), x])
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    for _ in range(steps):
        e = y - z @ b
        w = np.where(e >= 0, q, 1 - q) / np.maximum(np.abs(e), 1e-6)
        new = np.linalg.solve(z.T @ (z * w[:, None]), z.T @ (w * y))
        if np.abs(new - b).max() < 1e-10:
            break
        b = new
    return b


def covar_quantreg(paired: DataFrame, alpha: float = 0.05, least: int = 50) -> DataFrame:
    """Quantile line of the system on the asset, read at the asset's own quantile and at its median."""

    def body(d):
        a, s = d["asset"].to_numpy(float), d["system"].to_numpy(float)
        if len(a) < least:
            return []
        b = quantile_regression(a, s, alpha)
        low, mid = b[0] + b[1] * np.quantile(a, alpha), b[0] + b[1] * np.median(a)
        return [(len(a), float(np.quantile(s, alpha)), float(low), float(mid), float(low - mid))]

    return _by(paired, ["series_id"], "n bigint, var_system double, covar_distress double, covar_median double, delta_covar double", body)


def rolling_tail(panel: DataFrame, width: int = 252, least: int = 100) -> DataFrame:
    """Mean tau over the previous rows (at most `width`, at least `least`) with the lower-tail coefficient it implies; null where a channel
    is constant in them.

    Two rows less than `width` apart enter the window after the later one and leave it once the earlier one drops out, so a window's
    concordance is a running sum of what enters and leaves, added up per row before it is chained."""
    k = len(S.CHANNELS)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    w = by_day()
    d = spread(panel.select("series_id", "ds", *S.CHANNELS).na.drop(), "series_id")
    d = d.select("series_id", "ds", (F.row_number().over(w) - 1).alias("r"), F.array(*[F.col(c).cast("double") for c in S.CHANNELS]).alias("v"))
    before = F.collect_list(F.struct(F.col("r").alias("q"), F.col("v").alias("u"))).over(w.rowsBetween(1 - width, -1))
    both = d.withColumn("before", before).select("series_id", "r", "v", F.inline("before"))
    signs = both.select("series_id", "r", "q", *[F.signum(F.col("v")[i] - F.col("u")[i]).cast("long").alias(f"s{i}") for i in range(k)])
    turns = F.inline(F.array(F.struct((F.col("r") + 1).alias("t"), F.lit(1).alias("way")), F.struct((F.col("q") + width + 1).alias("t"), F.lit(-1).alias("way"))))
    moves = signs.select("series_id", *[f"s{i}" for i in range(k)], turns).groupBy("series_id", "t").agg(*[F.sum(F.col("way") * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"g{i}{j}") for i, j in pairs])
    rows = d.select("series_id", F.col("r").alias("t"), F.col("ds").alias("at")).join(moves, ["series_id", "t"], "left")
    past = by_day(order="t").rowsBetween(Window.unboundedPreceding, 0)
    g = rows.select("series_id", "at", F.least("t", F.lit(width)).alias("n"), *[F.coalesce(F.sum(f"g{i}{j}").over(past), F.lit(0)).cast("double").alias(f"g{i}{j}") for i, j in pairs]).where(F.col("n") >= least)
    parts = [F.try_divide(F.col(f"g{i}{j}"), F.sqrt(F.col(f"g{i}{i}") * F.col(f"g{j}{j}"))) for i, j in pairs if i < j]
    g = g.withColumn("tau", sum(parts, F.lit(0.0)) / len(parts))
    c = F.when(F.col("tau") < 0, 0.01).when(F.col("tau").isNotNull(), F.least("tau", F.lit(0.99)))
    g = g.withColumn("theta", F.when(F.col("tau").isNotNull(), F.greatest(F.lit(0.01), 2 * c / (1 - c))))
    return g.select("series_id", "at", "n", "tau", "theta", F.pow(F.lit(2.0), -1 / F.col("theta")).alias("lambda_l"))
