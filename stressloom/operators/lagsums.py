"""Lagged second moments: what regressions on a series' own past need, as Spark sums.

One row per key holds, for every lag, the sums of products of all columns with the lagged ones, and the few rows near either end. From
these the cross-products of any set of lagged columns over rows start..n-1 follow exactly: the sum over the whole series less the
products at its ends. So every lag order is read from the same sums, and only matrices of the size of the regression are solved.

A row meets its last `furthest` rows in a window frame; the products are summed in the task that holds the window, by (key, lag), in one
exchange. Columns are centred by key, which changes no result of a regression with a constant.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stressloom.session import spread

#: Width of the frame where `furthest` depends on the length of the series.
WIDEST = 128


def lag_sums(df: DataFrame, keys: list[str], cols: list[Column], furthest: int | Column, order: str = "ds") -> DataFrame:
    """(keys, n, ends array<struct<r, v>>, sums array<struct<lag, s>>); v starts with a one, the constant. A null in a column counts as
    its mean: drop rows with nulls before. `furthest` may use the column `n`."""
    w, e = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    k = len(cols) + 1
    d = spread(df, *keys).select(*keys, order, *[c.cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    mean = [F.coalesce(F.col(f"c{i}") - F.avg(f"c{i}").over(e), F.lit(0.0)) for i in range(len(cols))]
    d = d.select(*keys, order, F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(e).alias("n"), F.array(F.lit(1.0), *mean).alias("v"))
    d = d.withColumn("far", (F.lit(furthest) if isinstance(furthest, int) else furthest).cast("int")).withColumn("r", F.col("r") - 1)
    back = WIDEST if isinstance(furthest, Column) else furthest
    d = d.withColumn("past", F.slice(F.reverse(F.collect_list("v").over(w.rowsBetween(-back, 0))), F.lit(1), F.col("far") + 1))
    d = d.select(*keys, "r", "n", "v", "far", F.posexplode("past").alias("lag", "u"))
    near = (F.col("lag") == 0) & ((F.col("r") < F.col("far")) | (F.col("r") >= F.col("n") - F.col("far")))
    g = d.groupBy(*keys, "lag").agg(F.max("n").alias("n"), F.collect_list(F.when(near, F.struct("r", "v"))).alias("ends"),
                                    F.array(*[F.sum(F.col("v")[i] * F.col("u")[j]) for i in range(k) for j in range(k)]).alias("s"))
    return g.groupBy(*keys).agg(F.max("n").alias("n"), F.flatten(F.collect_list("ends")).alias("ends"), F.collect_list(F.struct("lag", "s")).alias("sums"))


class Lagged:
    """The sums of one key. Columns are named (column, lag); column 0 is the constant, whose lag is 0."""

    def __init__(self, n, ends, sums):
        self.n = int(n)
        k = len(ends[0]["v"]) if len(ends) else round(len(sums[0]["s"]) ** 0.5)
        self.top = top = max(int(x["lag"]) for x in sums)
        total = np.zeros((top + 1, k, k))
        for x in sums:
            total[int(x["lag"])] = np.reshape(x["s"], (k, k))
        first, last = np.zeros((top, k)), np.zeros((top, k))
        for x in ends:
            r = int(x["r"])
            if r < top:
                first[r] = x["v"]
            if self.n - 1 - r < top:
                last[self.n - 1 - r] = x["v"]
        head, tail = np.zeros((top + 1, top + 1, k, k)), np.zeros((top + 1, top + 1, k, k))
        for d in range(top):
            head[d, d + 1:] = np.cumsum(first[d:, :, None] * first[: top - d, None, :], axis=0)
            tail[d, 1: top - d + 1] = np.cumsum(last[: top - d, :, None] * last[d:, None, :], axis=0)
        self.total, self.head, self.tail = total, head, tail

    def moments(self, names: list[tuple[int, int]], start: int) -> np.ndarray:
        """Cross-products over rows start..n-1; no lag exceeds start, and start does not exceed the furthest lag."""
        col, lag = (np.array(x) for x in zip(*names))
        swap = lag[:, None] > lag[None, :]
        low, d = np.minimum(lag[:, None], lag[None, :]), np.abs(lag[:, None] - lag[None, :])
        a, b = np.where(swap, col[None, :], col[:, None]), np.where(swap, col[:, None], col[None, :])
        return self.total[d, a, b] - self.head[d, start - low, a, b] - self.tail[d, low, a, b]


def partial(m: np.ndarray, x: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least squares of the columns from x on, on the first x: coefficients, residual cross-products, inverse of the first block."""
    scale = np.sqrt(np.maximum(np.diag(m)[:x], 1e-300))
    inv = np.linalg.pinv(m[:x, :x] / np.outer(scale, scale), rcond=1e-13, hermitian=True) / np.outer(scale, scale)
    b = inv @ m[:x, x:]
    return b, m[x:, x:] - m[x:, :x] @ b, inv


def solve_by(sums: DataFrame, keys: list[str], schema: str, body) -> DataFrame:
    """body(Lagged) -> list of tuples after the keys, applied to the one row of every key."""
    names = [p.strip().split(" ")[0] for p in schema.split(",")]
    types = ", ".join(f"{k} {t}" for k, t in sums.select(*keys).dtypes)

    def run(batches):
        for pdf in batches:
            rows = [tuple(getattr(r, k) for k in keys) + tuple(t) for r in pdf.itertuples(index=False) for t in body(Lagged(r.n, r.ends, r.sums))]
            yield pd.DataFrame(rows, columns=keys + names)

    return sums.mapInPandas(run, types + ", " + schema)
