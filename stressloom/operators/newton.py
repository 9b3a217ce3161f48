"""Logistic regressions of many keys at once by Newton's method: a step is one grouped sum over the rows.

The rows stay where they were written; a step joins them with the coefficients of their key, sums likelihood, gradient and curvature,
and solves one small system a key. Keys that have settled, or whose likelihood no longer grows (separated data), leave the rounds. Each step is written, so a lost executor repeats one step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stressloom.session import stored

STEPS, SETTLED, GAIN = 100, 1e-8, 1e-13


def dot(a: str, b: str, k: int) -> Column:
    return sum((F.col(a)[i] * F.col(b)[i] for i in range(k)), F.lit(0.0))


def chance(eta: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-bounded(eta)))


def bounded(eta: Column) -> Column:
    return F.greatest(F.least(eta, F.lit(35.0)), F.lit(-35.0))


def sums(rows: DataFrame, state: DataFrame, by: list[str], k: int) -> DataFrame:
    """Log-likelihood, gradient g and curvature h of every key at its coefficients."""
    d = rows.join(state.select(*by, "b", "moved", F.col("ll").alias("before")), by).withColumn("eta", bounded(dot("x", "b", k)))
    d = d.withColumn("p", 1.0 / (1.0 + F.exp(-F.col("eta")))).withColumn("w", F.col("p") * (1.0 - F.col("p")))
    x = [F.col("x")[i] for i in range(k)]
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("events"), F.first("b").alias("b"), F.first("moved").alias("moved"), F.first("before").alias("before"),
        F.sum(F.col("y") * F.col("eta") - F.log1p(F.exp("eta"))).alias("ll"),
        F.array(*[F.sum(a * (F.col("y") - F.col("p"))) for a in x]).alias("g"), F.array(*[F.sum(a * c * F.col("w")) for a in x for c in x]).alias("h"))


def logit_fits(df: DataFrame, keys: list[str], y: str, models: dict[str, list[Column]], keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Fits of several designs of the same width per key, and the rows (keys, model, y, x, kept columns) they were fitted on.

    A fit holds n, events, b, ll, h (curvature, row by row) and moved, the last step's largest change. A column of zeros keeps the
    coefficient 0, so nested models stand side by side. Separated data end after STEPS steps with a large `moved` or large b.
    """
    by, k = [*keys, "model"], len(next(iter(models.values())))
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.array(*[c.cast("double") for c in x]).alias("x")) for m, x in models.items()])
    rows = stored(df.select(*keys, F.col(y).cast("double").alias("y"), *keep, F.inline(cells)), "logit-rows")
    state = stored(rows.select(*by).distinct().select(*by, F.array(*[F.lit(0.0)] * k).alias("b"), F.lit(1e300).alias("moved"), F.lit(-1e300).alias("ll"), F.lit(False).alias("done")), "logit")

    def move(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                step = np.linalg.pinv(np.reshape(r.h, (k, k))) @ np.array(r.g)
                moved = float(np.abs(step).max())
                done = moved < SETTLED or r.ll - r.before <= GAIN * (1 + abs(r.ll))
                out.append((*[getattr(r, c) for c in by], (np.array(r.b) + step).tolist(), moved, r.ll, done))
            yield pd.DataFrame(out, columns=[*by, "b", "moved", "ll", "done"])

    types = ", ".join(f"{c} {t}" for c, t in rows.select(*by).dtypes) + ", b array<double>, moved double, ll double, done boolean"
    for _ in range(STEPS):
        live = state.where(~F.col("done"))
        if live.isEmpty():
            break
        moved = sums(rows, live, by, k).select(*by, "b", "g", "h", "ll", "before").mapInPandas(move, types)
        state = stored(moved.unionByName(state.where("done")), "logit")
    return sums(rows, state, by, k).drop("before"), rows
