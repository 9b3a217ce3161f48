"""Second-moment routes: covariances are Spark aggregates (map-side partial sums, any number of rows), and one row per
group with k x k numbers goes through a small numpy solve."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stressloom import schema as S
from stressloom.operators.windows import by_day
from stressloom.session import spread

K = len(S.CHANNELS)
PAIRS = [(i, j) for i in range(K) for j in range(i, K)]


def moments(df: DataFrame, keys: list[str], cols: list[str] | None = None) -> DataFrame:
    """n, means and the covariance matrix (row-major array) per key."""
    cols = cols or S.CHANNELS
    k = len(cols)
    cov = {(i, j): F.covar_samp(cols[i], cols[j]) for i in range(k) for j in range(i, k)}
    return df.na.drop(subset=cols).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in cols]).alias("mean"),
        F.array(*[cov[(min(i, j), max(i, j))] for i in range(k) for j in range(k)]).alias("cov"))


def _solve(df: DataFrame, schema: str, body) -> DataFrame:
    """body(row) -> list of output tuples, applied to the few columns of each result row."""
    names = [p.strip().split(" ")[0] for p in schema.split(",")]

    def run(batches):
        for pdf in batches:
            rows = [t for r in pdf.itertuples(index=False) for t in body(r)]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)


def _corr(cov: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(cov))
    return cov / np.outer(d, d)


def pca(df: DataFrame, standardise: bool = True, keys=("series_id",)) -> DataFrame:
    """Per component and channel: loading, explained share, and the weight from the absolute first loadings."""

    def body(r):
        cov = np.array(r.cov, float).reshape(K, K)
        cov = _corr(cov) if standardise else cov
        val, vec = np.linalg.eigh(cov)
        val, vec = val[::-1], vec[:, ::-1]
        load = vec * np.sqrt(np.maximum(val, 0))
        w = np.abs(load[:, 0]) / np.abs(load[:, 0]).sum()
        sign = np.sign(load.sum(axis=0))
        return [(r.series_id, c + 1, S.CHANNELS[i], float(load[i, c] * (sign[c] or 1)), float(vec[i, c] * (sign[c] or 1)), float(val[c] / val.sum()), float(w[i]))
                for c in range(K) for i in range(K)]

    m = moments(df, list(keys)).filter(F.col("n") >= K + 10)
    return _solve(m, "series_id string, component int, channel string, loading double, vector double, share double, weight double", body)


def pca_tests(df: DataFrame) -> DataFrame:
    """Sampling adequacy from partial correlations, sphericity chi-square from the log determinant."""

    def body(r):
        corr = _corr(np.array(r.cov, float).reshape(K, K))
        inv = np.linalg.inv(corr)
        d = np.sqrt(np.diag(inv))
        part = -inv / np.outer(d, d)
        off = ~np.eye(K, dtype=bool)
        r2, p2 = (corr[off] ** 2).sum(), (part[off] ** 2).sum()
        chi2 = -((r.n - 1) - (2 * K + 5) / 6) * np.linalg.slogdet(corr)[1]
        return [(r.series_id, int(r.n), float(r2 / (r2 + p2)), float(chi2), K * (K - 1) // 2)]

    return _solve(moments(df, ["series_id"]), "series_id string, n bigint, kmo double, chi2 double, df int", body)


def standardised(df: DataFrame, pop: bool = False) -> DataFrame:
    w = Window.partitionBy("series_id")
    sd = F.stddev_pop if pop else F.stddev_samp
    return df.withColumns({c: (F.col(c) - F.avg(c).over(w)) / F.nullif(sd(c).over(w), F.lit(0.0)) for c in S.CHANNELS})


def pca_scores(df: DataFrame, by: str = "loading") -> DataFrame:
    """First-component scores from the loadings (default) or the unit vectors of each series."""
    v = pca(df).filter("component = 1").groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", by))).alias("_v"))
    z = standardised(df).join(v, "series_id")
    return z.select("series_id", "ds", sum((F.col(c) * F.col("_v")[c] for c in S.CHANNELS), F.lit(0.0)).alias("score"))


def collinearity(df: DataFrame) -> DataFrame:
    """Variance inflation per channel (diagonal of the inverse correlation), condition number, first share."""

    def body(r):
        corr = _corr(np.array(r.cov, float).reshape(K, K))
        val = np.linalg.eigvalsh(corr)
        vif = np.diag(np.linalg.inv(corr))
        return [(r.series_id, c, float(vif[i]), float(val[-1] / val[0]), float(val[-1] / K)) for i, c in enumerate(S.CHANNELS)]

    return _solve(moments(df, ["series_id"]), "series_id string, channel string, vif double, condition double, first_share double", body)


def connectedness_total(cov: np.ndarray, phi: np.ndarray, horizon: int = 10) -> np.ndarray:
    """Total connectedness of VAR(1) models from their generalised error-variance shares; models are stacked in front."""
    k = cov.shape[-1]
    num, den, a = np.zeros_like(cov), np.zeros(cov.shape[:-1]), np.broadcast_to(np.eye(k), cov.shape)
    for _ in range(horizon + 1):
        ac = a @ cov
        num += ac**2
        den += (ac * a).sum(axis=-1)
        a = a @ phi
    theta = num / np.diagonal(cov, axis1=-2, axis2=-1)[..., None, :] / den[..., :, None]
    theta = theta / theta.sum(axis=-1, keepdims=True)
    return (theta.sum(axis=(-2, -1)) - np.trace(theta, axis1=-2, axis2=-1)) / k * 100.0


def _var1(n, s):
    """Coefficients and residual covariances of y = c + phi x from stacked centred sums; rows without a solution are nan."""
    q = K * K
    sy, sx = s[:, :K], s[:, K: 2 * K]
    sxx, sxy, syy = (s[:, 2 * K + i * q: 2 * K + (i + 1) * q].reshape(-1, K, K) for i in range(3))
    outer = lambda u, v: u[:, :, None] * v[:, None, :] / n[:, None, None]
    xx, xy, yy = sxx - outer(sx, sx), sxy - outer(sx, sy), syy - outer(sy, sy)
    solvable = np.linalg.matrix_rank(xx) == K
    b = np.full_like(xy, np.nan)
    b[solvable] = np.linalg.solve(xx[solvable], xy[solvable])
    return b.transpose(0, 2, 1), (yy - xy.transpose(0, 2, 1) @ b) / n[:, None, None]


def _lag_products(df: DataFrame) -> DataFrame:
    """Centred channels, their lag, and packed product columns."""
    e = Window.partitionBy("series_id")
    c = df.select("series_id", "ds", *[(F.col(x) - F.avg(x).over(e)).alias(f"y{i}") for i, x in enumerate(S.CHANNELS)])
    return c.select("*", *[F.lag(f"y{i}").over(by_day()).alias(f"x{i}") for i in range(K)]).filter(F.col("x0").isNotNull())


def _sum_cols():
    y, x = [F.col(f"y{i}") for i in range(K)], [F.col(f"x{i}") for i in range(K)]
    return (y + x + [x[i] * x[j] for i in range(K) for j in range(K)] + [x[i] * y[j] for i in range(K) for j in range(K)]
            + [y[i] * y[j] for i in range(K) for j in range(K)])


def _totals(df: DataFrame, keys: str, horizon: int) -> DataFrame:
    """Connectedness of every row of sums (n, s), a batch of rows in one solve."""
    names = [p.strip().split(" ")[0] for p in keys.split(",")]

    def run(batches):
        for pdf in batches:
            if len(pdf):
                n = pdf["n"].to_numpy(float)
                phi, cov = _var1(n, np.stack(pdf["s"].to_list()).astype(float))
                total = connectedness_total(cov, phi, horizon)
                yield pdf[names].assign(connectedness=[None if np.isnan(t) else float(t) for t in total])

    return df.mapInPandas(run, keys + ", connectedness double")


def connectedness(df: DataFrame, horizon: int = 10) -> DataFrame:
    g = _lag_products(df).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in _sum_cols()]).alias("s"))
    return _totals(g, "series_id string, n bigint", horizon)


def rolling_connectedness(df: DataFrame, width: int = 60, horizon: int = 10) -> DataFrame:
    """The same over the last `width` rows (width - 1 transitions) at each date: window sums, then one solve per batch of rows."""
    w = by_day().rowsBetween(-(width - 2), 0)
    d = _lag_products(spread(df, "series_id"))
    d = d.select("series_id", "ds", F.count(F.lit(1)).over(w).alias("n"), F.array(*[F.sum(c).over(w) for c in _sum_cols()]).alias("s"))
    return _totals(d.filter(F.col("n") == width - 1), "series_id string, ds date", horizon)


# Fixed values of the penalised regression search.
L1_RATIOS = [0.1, 0.5, 0.9, 0.99]
ALPHAS = 10.0 ** np.linspace(-4, 1, 50)


def _descend(n, g, xy, sx, sy, alpha, l1, max_iter=1000, tol=1e-4):
    """Coordinate descent on the Gram matrix for a whole (alpha, l1) grid at once; columns are grid points."""
    m = len(alpha)
    b, c = np.zeros((K, m)), np.full(m, sy / n)
    live = np.ones(m, bool)
    for _ in range(max_iter):
        old = b.copy()
        for j in range(K):
            rho = (xy[j] - c * sx[j] - g[j] @ b + g[j, j] * b[j]) / n
            new = np.sign(rho) * np.maximum(np.abs(rho) - alpha * l1, 0) / (g[j, j] / n + alpha * (1 - l1))
            b[j] = np.where(live, new, b[j])
        c = np.where(live, (sy - sx @ b) / n, c)
        live &= np.abs(b - old).max(axis=0) >= tol
        if not live.any():
            break
    return b, c


def _sse(n, g, xy, sx, sy, yy, b, c):
    return yy - 2 * xy @ b - 2 * c * sy + np.einsum("im,ij,jm->m", b, g, b) + 2 * c * (sx @ b) + n * c * c


def elastic_net(df: DataFrame, target: str, folds: int = 5, keys=("series_id",)) -> DataFrame:
    """Weights from a cross-validated penalised regression of the target on the standardised channels.

    Rows are cut by position into folds + 1 equal segments; Spark sums the Gram matrix per segment. Expanding training
    sets are prefix sums of segments, so no row is read twice and the whole search runs on 4 x 4 matrices.
    """
    e = Window.partitionBy(*keys)
    z = standardised(df.na.drop(subset=[*S.CHANNELS, target]), pop=True).fillna(0.0, subset=S.CHANNELS)
    z = z.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy("ds")) - 1).withColumn("_n", F.count(F.lit(1)).over(e))
    size = F.floor(F.col("_n") / (folds + 1))
    z = z.withColumn("_seg", F.least(F.floor(F.col("_p") / size), F.lit(folds + 1)).cast("int")).withColumn("_y", F.col(target))
    x = [F.col(c) for c in S.CHANNELS]
    sums = [x[i] * x[j] for i in range(K) for j in range(K)] + [a * F.col("_y") for a in x] + x + [F.col("_y"), F.col("_y") * F.col("_y")]
    g = z.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in sums]).alias("s"))

    grid = [(a, l) for l in L1_RATIOS for a in ALPHAS]
    al, l1 = np.array([a for a, _ in grid]), np.array([l for _, l in grid])
    key_schema = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes)

    def split(n, s):
        q = K * K
        return n, s[:q].reshape(K, K), s[q: q + K], s[q + K: q + 2 * K], s[q + 2 * K], s[q + 2 * K + 1]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seg")
        ns, ss = pdf["n"].to_numpy(float), np.stack(pdf["s"].to_list())
        seg = pdf["_seg"].to_numpy()
        score = np.zeros(len(grid))
        for f in range(folds):
            tr, te = seg <= f, seg == f + 1
            n, gm, xy, sx, sy, _ = split(ns[tr].sum(), ss[tr].sum(axis=0))
            b, c = _descend(n, gm, xy, sx, sy, al, l1)
            n2, g2, xy2, sx2, sy2, yy2 = split(ns[te].sum(), ss[te].sum(axis=0))
            tot = yy2 - sy2 * sy2 / n2
            score += (1 - _sse(n2, g2, xy2, sx2, sy2, yy2, b, c) / tot if tot > 0 else 0) / folds
        best = int(np.argmax(score))
        n, gm, xy, sx, sy, yy = split(ns.sum(), ss.sum(axis=0))
        b, c = _descend(n, gm, xy, sx, sy, al[best:best + 1], l1[best:best + 1])
        r2 = 1 - float(_sse(n, gm, xy, sx, sy, yy, b, c)[0]) / (yy - sy * sy / n)
        coef = b[:, 0]
        w = np.abs(coef) / np.abs(coef).sum() if np.abs(coef).sum() > 0 else np.full(K, 1.0 / K)
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**head, "channel": ch, "weight": float(w[i]), "coef": float(coef[i]), "selected": bool(abs(coef[i]) > 1e-6),
                              "alpha": float(al[best]), "l1_ratio": float(l1[best]), "r2_cv": float(score[best]), "r2_train": r2} for i, ch in enumerate(S.CHANNELS)])

    return g.groupBy(*keys).applyInPandas(run, key_schema + ", channel string, weight double, coef double, selected boolean, alpha double, l1_ratio double, r2_cv double, r2_train double")
