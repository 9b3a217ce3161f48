"""Gaussian regime models over a panel: fit by expectation-maximisation, decode, filter, weight and select.

The parameters are k means, k covariances and a k x k transition matrix: a few hundred numbers whatever the data size.
Series are packed once into one row of arrays each (a series is bounded by the calendar) and written through the shared
checkpoint folder, so an iteration is one job without a shuffle of the panel: a task runs the forward-backward passes of all
restarts of a state count over many of its series together, as two more array axes, adds up the sufficient statistics, and only the
sums per model reach the driver. No iteration builds on the plan of the previous one, so there is no growing lineage.
A fit has converged when the log-likelihood per observation changes by less than the tolerance, which has the same meaning
for any number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stressloom import schema as S
from stressloom.operators import grids
from stressloom.operators import eventjoin as ev
from stressloom.session import cut_lineage, spread

D = len(S.CHANNELS)

# Channel weights per regime, from low to high risk.
REGIME_WEIGHTS = [
    [0.20, 0.25, 0.30, 0.25],
    [0.30, 0.25, 0.25, 0.20],
    [0.40, 0.30, 0.20, 0.10],
]


@dataclass
class Model:
    """Regimes ordered by mean risk."""

    pi: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    loglik: float = float("nan")
    n_obs: int = 0
    converged: bool = False
    iterations: int = 0

    @property
    def k(self) -> int:
        return len(self.pi)

    def n_params(self) -> int:
        k = self.k
        return (k - 1) + k * (k - 1) + k * D + k * D * (D + 1) // 2

    def criteria(self) -> tuple[float, float]:
        p = self.n_params()
        return -2 * self.loglik + 2 * p, -2 * self.loglik + p * float(np.log(self.n_obs))

    def ordered(self) -> "Model":
        o = np.argsort(self.means.mean(axis=1))
        return Model(self.pi[o], self.trans[o][:, o], self.means[o], self.covs[o], self.loglik, self.n_obs, self.converged, self.iterations)


def log_density(x: np.ndarray, m: Model) -> np.ndarray:
    out = np.empty((len(x), m.k))
    for j in range(m.k):
        chol = np.linalg.cholesky(m.covs[j])
        z = np.linalg.solve(chol, (x - m.means[j]).T)
        out[:, j] = -0.5 * (D * np.log(2 * np.pi) + (z * z).sum(axis=0)) - np.log(np.diag(chol)).sum()
    return out


def _scaled(logb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = logb.max(axis=1)
    return np.exp(logb - top[:, None]), top


def forward(logb: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """Filtered probabilities, scale factors and log-likelihood."""
    b, top = _scaled(logb)
    a = np.empty_like(b)
    c = np.empty(len(b))
    p = m.pi
    for t in range(len(b)):
        v = (p if t == 0 else a[t - 1] @ m.trans) * b[t]
        c[t] = v.sum()
        a[t] = v / c[t]
    return a, c, float(np.log(c).sum() + top.sum())


def smooth(logb: np.ndarray, m: Model):
    """Smoothed probabilities, expected transitions and log-likelihood."""
    a, c, ll = forward(logb, m)
    b, _ = _scaled(logb)
    beta = np.ones(m.k)
    gamma = np.empty_like(a)
    gamma[-1] = a[-1]
    xi = np.zeros((m.k, m.k))
    for t in range(len(b) - 2, -1, -1):
        v = b[t + 1] * beta / c[t + 1]
        xi += a[t][:, None] * m.trans * v[None, :]
        beta = m.trans @ v
        g = a[t] * beta
        gamma[t] = g / g.sum()
    return gamma, xi, ll


def viterbi(logb: np.ndarray, m: Model) -> np.ndarray:
    lt = np.log(m.trans + 1e-300)
    score = np.log(m.pi + 1e-300) + logb[0]
    back = np.zeros((len(logb), m.k), dtype=int)
    for t in range(1, len(logb)):
        cand = score[:, None] + lt
        back[t] = cand.argmax(axis=0)
        score = cand.max(axis=0) + logb[t]
    path = np.empty(len(logb), dtype=int)
    path[-1] = score.argmax()
    for t in range(len(logb) - 2, -1, -1):
        path[t] = back[t + 1][path[t + 1]]
    return path


def _start(k: int, seed: int, q: np.ndarray, cov: np.ndarray) -> Model:
    """Means at spread percentiles plus seeded noise, common covariance, sticky transitions."""
    rng = np.random.default_rng(seed)
    trans = np.full((k, k), 0.1 / max(k - 1, 1))
    np.fill_diagonal(trans, 0.9 if k > 1 else 1.0)
    return Model(np.ones(k) / k, trans, q + rng.normal(0, 0.1 + seed % 7, (k, D)), np.array([cov.copy() for _ in range(k)]))


def _overall(panel: DataFrame, ks: list[int]):
    """Percentiles of each channel and the common covariance: one aggregate row."""
    probs = sorted({(i + 1) / (k + 1) for k in ks for i in range(k)})
    aggs = [F.percentile_approx(c, probs, 10000).alias(f"q{i}") for i, c in enumerate(S.CHANNELS)]
    aggs += [F.covar_samp(S.CHANNELS[i], S.CHANNELS[j]).alias(f"c{i}{j}") for i in range(D) for j in range(D)]
    row = panel.groupBy().agg(*aggs).first()
    cov = np.array([[row[f"c{i}{j}"] for j in range(D)] for i in range(D)])
    at = {p: [row[f"q{i}"][n] for i in range(D)] for n, p in enumerate(probs)}
    return {k: np.array([at[(i + 1) / (k + 1)] for i in range(k)]) for k in ks}, cov


STATS = "model int, loglik double, n bigint, pi array<double>, xi array<double>, gamma array<double>, gx array<double>, gxx array<double>"
FIELDS = ["pi", "xi", "gamma", "gx", "gxx"]


def pack(panel: DataFrame) -> DataFrame:
    """(series_id, one array per channel in the order of dates), one row per series, in as many parts as the cluster has cores: the steps of
    a pass over time cost the same for one series and for dozens, so a task takes all of its series together."""
    day = F.struct("ds", *S.CHANNELS)
    d = panel.na.drop(subset=S.CHANNELS).select("series_id", "ds", *S.CHANNELS)
    d = d.repartition(max(1, d.sparkSession.sparkContext.defaultParallelism), "series_id")
    return cut_lineage(d.groupBy("series_id").agg(F.array_sort(F.collect_list(day)).alias("a")).select("series_id", *[F.col(f"a.{c}").alias(c) for c in S.CHANNELS]))


def densities(x: np.ndarray, models: list[Model]) -> np.ndarray:
    """Log-densities (row, model * regime): products of the rows' squares and cross products with the coefficients of all models. Rows and
    means are centred first, which keeps the squares small."""
    mid = x.mean(axis=0)
    coefs = []
    for m in models:
        for mean, cov in zip(m.means - mid, m.covs):
            low = np.linalg.inv(np.linalg.cholesky(cov))
            prec = low.T @ low
            coefs.append(np.concatenate([[np.log(np.diag(low)).sum() - 0.5 * (D * np.log(2 * np.pi) + mean @ prec @ mean)], prec @ mean, -0.5 * prec.ravel()]))
    return squares(x - mid) @ np.array(coefs).T


def squares(x: np.ndarray) -> np.ndarray:
    """(row, 1 + D + D * D): one, the channels and their products."""
    return np.concatenate([np.ones((len(x), 1)), x, (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)], axis=1)


def blocks(parts: np.ndarray) -> np.ndarray:
    """Matrices (model, k, k) along the diagonal of one."""
    n, k, _ = parts.shape
    out = np.zeros((n, k, n, k))
    out[np.arange(n), :, np.arange(n)] = parts
    return out.reshape(n * k, n * k)


def smooth_all(logb: np.ndarray, pi: np.ndarray, trans: np.ndarray, sizes: np.ndarray):
    """Forward-backward passes of several models over several series at once. logb: (day, series, model * regime), overwritten; series s has
    sizes[s] days, and what lies behind them does not matter. A step over time is a product with all models' transitions along the
    diagonal of one matrix. Returns smoothed probabilities (0 behind the end), and per model expected transitions and the
    log-likelihood, summed over the series."""
    n, k = pi.shape
    gone = np.arange(len(logb))[:, None] >= sizes  # (day, series)
    each = logb.reshape(*logb.shape[:2], n, k)
    top = each[..., 0].copy()
    for j in range(1, k):
        np.maximum(top, each[..., j], out=top)
    each -= top[..., None]
    b = np.exp(logb, out=logb)
    b[gone] = 1.0  # a day that tells nothing: its sum is 1 and beta stays 1
    ahead, back, total = blocks(trans), blocks(trans.transpose(0, 2, 1)), blocks(np.ones((n, k, k)))
    a, c, v = np.empty_like(b), np.empty_like(b), pi.ravel() * b[0]
    for t in range(len(b)):
        if t:
            np.matmul(a[t - 1], ahead, out=v)
            v *= b[t]
        np.matmul(v, total, out=c[t])
        np.divide(v, c[t], out=a[t])
    loglik = np.where(gone[..., None], 0.0, np.log(c[..., ::k]) + top).sum(axis=(0, 1))
    b /= c
    beta = c
    beta[-1] = 1.0
    for t in range(len(b) - 2, -1, -1):
        np.multiply(b[t + 1], beta[t + 1], out=v)
        np.matmul(v, back, out=beta[t])
    b *= beta
    b[gone] = 0.0
    flat = lambda x: x.reshape(-1, n * k)
    xi = (flat(a[:-1]).T @ flat(b[1:])).reshape(n, k, n, k)[np.arange(n), :, np.arange(n)] * trans
    a *= beta
    a /= (flat(a) @ total).reshape(a.shape)
    a[gone] = 0.0
    return a, xi, loglik


#: Numbers in an array of one pass, which bounds the series that are taken together.
AT_ONCE = 1 << 21


def _estep(packs: DataFrame, models: dict[int, Model]) -> DataFrame:
    by_k: dict[int, list[int]] = {}
    for key, m in models.items():
        by_k.setdefault(m.k, []).append(key)

    def part(series: list[np.ndarray], keys: list[int]):
        """The statistics of the models, all with one number of regimes, over the series."""
        ms, sizes = [models[key] for key in keys], np.array([len(x) for x in series])
        x = np.zeros((sizes.max(), len(series), D))
        for i, one in enumerate(series):
            x[: len(one), i] = one
        rows, k = x.reshape(-1, D), ms[0].k
        logb = densities(rows, ms).reshape(*x.shape[:2], -1)
        gamma, xi, ll = smooth_all(logb, np.stack([m.pi for m in ms]), np.stack([m.trans for m in ms]), sizes)
        sums = (gamma.reshape(len(rows), -1).T @ squares(rows)).reshape(len(ms), k, -1)
        first = gamma[0].sum(axis=0).reshape(len(ms), k)
        for r, key in enumerate(keys):
            yield key, [ll[r], sizes.sum(), first[r], xi[r].ravel(), sums[r, :, 0], sums[r, :, 1 : 1 + D].ravel(), sums[r, :, 1 + D :].ravel()]

    def run(batches):
        total: dict[int, list] = {}
        for pdf in batches:
            series = [np.stack([np.asarray(c, float) for c in row], axis=1) for row in pdf[S.CHANNELS].itertuples(index=False)]
            series.sort(key=len, reverse=True)  # series of similar length together
            for k, keys in by_k.items():
                i = 0
                while i < len(series):
                    j = i + max(1, AT_ONCE // (len(series[i]) * k * len(keys)))
                    for key, found in part(series[i:j], keys):
                        total[key] = [u + v for u, v in zip(total[key], found)] if key in total else found
                    i = j
        rows = [[key, t[0], t[1], *[list(v) for v in t[2:]]] for key, t in total.items()]
        yield pd.DataFrame(rows, columns=["model", "loglik", "n", *FIELDS])

    return packs.mapInPandas(run, STATS)


def _summed(stats: DataFrame) -> DataFrame:
    """Element-wise sums of the arrays per model: exploded to (model, field, position), so the sum is map-side."""
    def tagged(c):
        return F.transform(c, lambda v, i: F.struct(F.lit(c).alias("f"), i.alias("i"), v.alias("v")))

    long = stats.select("model", F.inline(F.flatten(F.array(
        F.array(F.struct(F.lit("loglik").alias("f"), F.lit(0).alias("i"), F.col("loglik").alias("v")), F.struct(F.lit("n").alias("f"), F.lit(0).alias("i"), F.col("n").cast("double").alias("v"))),
        *[tagged(c) for c in FIELDS]))))
    return long.groupBy("model", "f", "i").agg(F.sum("v").alias("v"))


def _mstep(m: Model, s: dict) -> Model:
    k = m.k
    gamma = np.maximum(np.array(s["gamma"]), 1e-12)
    xi = np.array(s["xi"]).reshape(k, k) + 1e-12
    means = np.array(s["gx"]).reshape(k, D) / gamma[:, None]
    covs = np.array(s["gxx"]).reshape(k, D, D) / gamma[:, None, None] - np.einsum("ki,kj->kij", means, means) + 1e-6 * np.eye(D)
    pi = np.array(s["pi"])
    return Model(pi / pi.sum(), xi / xi.sum(axis=1, keepdims=True), means, covs, s["loglik"][0], int(s["n"][0]))


# Iterations and restarts of a fit.
ITERATIONS, RESTARTS = 100, 10
#: Change of the log-likelihood per observation below which a fit has converged.
TOLERANCE = 1e-6


def fit(panel: DataFrame, ks=(3,), restarts: int = RESTARTS, seed: int = 42, iterations: int = ITERATIONS, tol: float = TOLERANCE) -> dict[int, Model]:
    """Best model per state count by log-likelihood over all restarts, with whether it converged and after how many
    iterations. Models that have converged drop out of the job."""
    ks = list(ks)
    q, cov = _overall(panel.na.drop(subset=S.CHANNELS), ks)
    packs = pack(panel)
    live = {k * 1000 + r: _start(k, seed + r, q[k], cov) for k in ks for r in range(restarts)}
    done: dict[int, Model] = {}
    for step in range(1, iterations + 1):
        got: dict[int, dict] = {}
        for r in _summed(_estep(packs, live)).collect():  # a few hundred numbers per model
            got.setdefault(r["model"], {}).setdefault(r["f"], {})[r["i"]] = r["v"]
        nxt = {}
        for key, m in live.items():
            s = {f: [v[i] for i in sorted(v)] for f, v in got[key].items()}
            ll, n = s["loglik"][0], int(s["n"][0])
            near = bool(np.isfinite(m.loglik) and abs(ll - m.loglik) < tol * n)
            if near or step == iterations:
                done[key] = Model(m.pi, m.trans, m.means, m.covs, ll, n, near, step)
            else:
                nxt[key] = _mstep(m, s)
        live = nxt
        if not live:
            break
    best: dict[int, Model] = {}
    for key, m in done.items():
        k = key // 1000
        if k not in best or m.loglik > best[k].loglik:
            best[k] = m
    return {k: m.ordered() for k, m in best.items()}


def _per_series(panel: DataFrame, cols: str, body) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        return body(pdf[["series_id", "ds"]].reset_index(drop=True), pdf[S.CHANNELS].to_numpy(float))

    d = panel.na.drop(subset=S.CHANNELS).select("series_id", "ds", *S.CHANNELS)
    return spread(d, "series_id").groupBy("series_id").applyInPandas(run, "series_id string, ds date, " + cols)


def decode(panel: DataFrame, m: Model) -> DataFrame:
    return _per_series(panel, "regime int", lambda k, x: k.assign(regime=viterbi(log_density(x, m), m)))


def filtered(panel: DataFrame, m: Model) -> DataFrame:
    """Forward-only probabilities: no look ahead."""
    return _per_series(panel, "probs array<double>", lambda k, x: k.assign(probs=[r.tolist() for r in forward(log_density(x, m), m)[0]]))


def smoothed(panel: DataFrame, m: Model) -> DataFrame:
    return _per_series(panel, "probs array<double>", lambda k, x: k.assign(probs=[r.tolist() for r in smooth(log_density(x, m), m)[0]]))


def static_probabilities(panel: DataFrame, m: Model) -> DataFrame:
    """Emission-only normalised probabilities: Gaussian densities as column expressions with literal precisions."""
    terms = []
    for j in range(m.k):
        prec, (_, logdet) = np.linalg.inv(m.covs[j]), np.linalg.slogdet(m.covs[j])
        diff = [F.col(c) - F.lit(float(m.means[j][i])) for i, c in enumerate(S.CHANNELS)]
        quad = sum((F.lit(float(prec[a, b])) * diff[a] * diff[b] for a in range(D) for b in range(D)), F.lit(0.0))
        terms.append(F.exp(-0.5 * (quad + F.lit(float(logdet)))))
    p = panel.withColumn("_d", F.array(*terms))
    total = F.aggregate("_d", F.lit(0.0), lambda s, v: s + v)
    return p.withColumn("_t", total).withColumn("probs", F.transform("_d", lambda v: v / F.col("_t"))).drop("_d", "_t")


def effective_weights(probs: str = "probs", weights=None) -> list[Column]:
    """sum_k P(k) * w_k per channel."""
    w = weights or REGIME_WEIGHTS
    return [sum((F.col(probs)[k] * F.lit(float(w[k][i])) for k in range(len(w))), F.lit(0.0)) for i in range(D)]


def regime_index(df: DataFrame, weights=None, probs: str = "probs") -> DataFrame:
    eff = effective_weights(probs, weights)
    value = sum((e * F.col(c) for e, c in zip(eff, S.CHANNELS)), F.lit(0.0))
    return df.withColumn("value", value).withColumns({f"w_{c}": e for e, c in zip(eff, S.CHANNELS)})


def decoded_index(df: DataFrame, weights=None) -> DataFrame:
    w = weights or REGIME_WEIGHTS
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in w])
    value = sum((table[F.col("regime")][i] * F.col(c) for i, c in enumerate(S.CHANNELS)), F.lit(0.0))
    return df.withColumn("value", value)


def transitions_around(df: DataFrame, events: DataFrame, before: int = 30, after: int = 30) -> DataFrame:
    """Mean crisis probability before [-before,-7), around [-7,7] and after (7,after]; rise and first day above 0.5."""
    w = df.join(ev.unfold(events.select("event", "event_date"), before, after), "ds")
    r, p = F.col("rel"), F.col("crisis_prob")
    g = w.groupBy("series_id", "event").agg(
        F.coalesce(F.avg(F.when(r < -7, p)), F.lit(0.0)).alias("pre"), F.coalesce(F.avg(F.when((r >= -7) & (r <= 7), p)), F.lit(0.0)).alias("during"),
        F.avg(F.when(r > 7, p)).alias("post"), F.coalesce(-F.min(F.when((r <= 0) & (p > 0.5), r)), F.lit(0)).alias("lead_days"))
    return g.withColumn("rise", F.col("during") - F.col("pre"))


def candidates(trials: int, seed: int = 42) -> list[list[list[float]]]:
    """Random weights per regime and channel, each between 0.05 and 0.60 before they are scaled to a sum of 1."""
    cands = np.clip(np.random.default_rng(seed).dirichlet(np.ones(D), size=(trials, len(REGIME_WEIGHTS))), 0.05, 0.60)
    return (cands / cands.sum(axis=2, keepdims=True)).tolist()


def calibrate(df: DataFrame, events: DataFrame, objective: str = "detection_rate", trials: int = 100, seed: int = 42, days: int = 30, threshold: float = 70.0) -> DataFrame:
    """Random search over Dirichlet weight matrices. Only event-window rows meet the candidates, except for the F1
    objective, which also counts alerts elsewhere."""
    grid = [dict(trial=i, w=w) for i, w in enumerate(candidates(trials, seed))]
    value = sum((F.col("probs")[k] * F.col("w")[k][i] * F.col(c) for k in range(len(REGIME_WEIGHTS)) for i, c in enumerate(S.CHANNELS)), F.lit(0.0))
    look = 60 if objective == "lead_time" else days
    near = df.join(ev.unfold(events.select("event", "event_date"), look, -1), "ds")
    det = grids.explode_grid(near, grid).withColumn("value", value)
    hit = F.col("value") > threshold
    per = det.groupBy("series_id", "trial", "event").agg(F.max(hit).alias("hit"), F.max(F.when(hit, -F.col("rel"))).alias("lead"))
    g = per.groupBy("series_id", "trial").agg(F.avg(F.col("hit").cast("double")).alias("detection_rate"), F.coalesce(F.avg("lead"), F.lit(0.0)).alias("lead_time"), F.count_if("hit").alias("_tp"))
    if objective == "f1":
        alerts = grids.explode_grid(df, grid).withColumn("value", value).groupBy("series_id", "trial").agg(F.count_if(hit).alias("_alerts"))
        g = g.join(alerts, ["series_id", "trial"])
        p = F.coalesce(F.col("_tp") / F.nullif(F.col("_alerts"), F.lit(0)), F.lit(0.0))
        r = F.col("detection_rate")
        g = g.withColumn("f1", F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)))
    best = g.groupBy("series_id").agg(F.max_by("trial", F.struct(objective, -F.col("trial"))).alias("trial"), F.max(objective).alias("score"))
    return best.withColumn("weights", grids.literal(grid)[F.col("trial")]["w"])


def selection(panel: DataFrame, ks=(2, 3, 4), restarts: int = RESTARTS, iterations: int = ITERATIONS) -> list[dict]:
    return criteria_table(fit(panel, ks, restarts, iterations=iterations))


def criteria_table(models: dict[int, Model]) -> list[dict]:
    out = []
    for k, m in sorted(models.items()):
        aic, bic = m.criteria()
        out.append(dict(k=k, loglik=m.loglik, aic=aic, bic=bic, n_params=m.n_params(), n_obs=m.n_obs, converged=m.converged, iterations=m.iterations))
    return out


def ergodic(trans: np.ndarray) -> np.ndarray:
    k = len(trans)
    a = np.vstack([trans.T - np.eye(k), np.ones(k)])
    return np.linalg.lstsq(a, np.append(np.zeros(k), 1.0), rcond=None)[0]


PARAMS = "name string, i int, j int, l int, v double"


def to_rows(m: Model) -> list[tuple]:
    rows = [("pi", i, 0, 0, float(v)) for i, v in enumerate(m.pi)]
    rows += [("trans", i, j, 0, float(v)) for i, r in enumerate(m.trans) for j, v in enumerate(r)]
    rows += [("mean", i, j, 0, float(v)) for i, r in enumerate(m.means) for j, v in enumerate(r)]
    rows += [("cov", i, a, b, float(v)) for i, c in enumerate(m.covs) for a, r in enumerate(c) for b, v in enumerate(r)]
    return rows + [("loglik", 0, 0, 0, float(m.loglik)), ("n_obs", 0, 0, 0, float(m.n_obs)), ("converged", 0, 0, 0, float(m.converged)), ("iterations", 0, 0, 0, float(m.iterations))]


def params_frame(spark: SparkSession, m: Model) -> DataFrame:
    return spark.createDataFrame(to_rows(m), PARAMS)


def save(spark: SparkSession, m: Model, path: str) -> None:
    params_frame(spark, m).coalesce(1).write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(path).collect()  # one model: bounded by k
    k = 1 + max(r["i"] for r in rows if r["name"] == "pi")
    m = Model(np.zeros(k), np.zeros((k, k)), np.zeros((k, D)), np.zeros((k, D, D)))
    for r in rows:
        i, j, l, v = r["i"], r["j"], r["l"], r["v"]
        if r["name"] == "pi":
            m.pi[i] = v
        elif r["name"] == "trans":
            m.trans[i, j] = v
        elif r["name"] == "mean":
            m.means[i, j] = v
        elif r["name"] == "cov":
            m.covs[i, j, l] = v
        elif r["name"] == "loglik":
            m.loglik = v
        elif r["name"] == "n_obs":
            m.n_obs = int(v)
        elif r["name"] == "converged":
            m.converged = bool(v)
        else:
            m.iterations = int(v)
    return m
