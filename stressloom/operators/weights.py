"""Objective channel weights and their comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stressloom.functions.stats import corr
from stressloom import schema as S
from stressloom.operators import aggregates as ag
from stressloom.operators import gram, grids, sensitivity


def _long(df: DataFrame, cols: dict) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), e.alias("score")) for c, e in cols.items()])
    return df.select("series_id", F.inline(cells))


def _normalised(d: DataFrame) -> DataFrame:
    total = F.sum("score").over(Window.partitionBy("series_id"))
    w = F.coalesce(F.col("score") / F.nullif(total, F.lit(0.0)), F.lit(1.0 / len(S.CHANNELS)))
    return d.withColumn("weight", w)


def critic(df: DataFrame, least: int = 10) -> DataFrame:
    """Deviation of the min-max scaled channel times its dissimilarity to the others. Scaling does not change the
    correlation, so one aggregation gives everything."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(S.CHANNELS):
        span = F.max(c) - F.min(c)
        aggs.append((F.stddev_samp(c) / F.when(span == 0, 1.0).otherwise(span)).alias(f"s{i}"))
        aggs += [corr(c, b).alias(f"r{i}{j}") for j, b in enumerate(S.CHANNELS) if j > i]
    g = df.na.drop(subset=S.CHANNELS).groupBy("series_id").agg(*aggs).filter(F.col("n") >= least)
    k = range(len(S.CHANNELS))
    info = lambda i: reduce(lambda a, b: a + b, [1.0 - F.abs(F.col(f"r{min(i, j)}{max(i, j)}")) for j in k if j != i])
    return _normalised(_long(g, {c: F.col(f"s{i}") * info(i) for i, c in enumerate(S.CHANNELS)}))


def entropy(df: DataFrame, least: int = 10, eps: float = 1e-10) -> DataFrame:
    """One minus the normalised entropy of the channel shares; non-positive channels are shifted first."""
    long = ag.unpivot(df.na.drop(subset=S.CHANNELS), ["series_id"], S.CHANNELS)
    lo = long.groupBy("series_id", "channel").agg(F.min("value").alias("_lo"), F.sum("value").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    lo = lo.filter(F.col("_n") >= least)
    shift = F.when(F.col("_lo") <= 0, eps - F.col("_lo")).otherwise(0.0)
    lo = lo.withColumn("_shift", shift).withColumn("_total", F.col("_sum") + F.col("_n") * F.col("_shift"))
    d = long.join(lo.select("series_id", "channel", "_shift", "_total"), ["series_id", "channel"])
    p = F.least(F.greatest((F.col("value") + F.col("_shift")) / F.col("_total"), F.lit(eps)), F.lit(1.0))
    g = d.groupBy("series_id", "channel").agg((1.0 + F.sum(p * F.log(p)) / F.log(F.count(F.lit(1)).cast("double"))).alias("score"))
    return _normalised(g)


def theoretical(df: DataFrame) -> DataFrame:
    ids = df.select("series_id").distinct()
    return _normalised(_long(ids, {c: F.lit(w) for c, w in S.CHANNEL_WEIGHTS.items()}))


def granger_weights(results: DataFrame) -> DataFrame:
    """F at the best lag where p < 0.10, else nothing; equal weights when nothing is left."""
    w = Window.partitionBy("series_id", "cause").orderBy("p", "lag")
    best = results.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return _normalised(best.select("series_id", F.col("cause").alias("channel"), F.when(F.col("p") < 0.10, F.col("f_stat")).otherwise(0.0).alias("score")))


def compare(df: DataFrame, target: str, granger: DataFrame) -> DataFrame:
    """All methods side by side in long form."""
    parts = {
        "theoretical": theoretical(df), "pca": gram.pca(df).filter("component = 1"), "elastic_net": gram.elastic_net(df, target),
        "critic": critic(df), "entropy": entropy(df), "granger": granger_weights(granger),
    }
    tagged = [p.select("series_id", F.lit(m).alias("method"), "channel", "weight") for m, p in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def method_correlations(long: DataFrame) -> DataFrame:
    """Pairwise correlation of weight vectors; each (series, channel) holds one value per method."""
    wide = long.groupBy("series_id", "channel").pivot("method", ["theoretical", "pca", "elastic_net", "critic", "entropy", "granger"]).agg(F.first("weight"))
    names = ["theoretical", "pca", "elastic_net", "critic", "entropy", "granger"]
    pairs = ag.channel_pairs(wide, ["series_id"], names)
    return pairs.groupBy("series_id", F.col("ch_a").alias("m_a"), F.col("ch_b").alias("m_b")).agg(corr("x", "y").alias("r"))


def sensitivity_grid(df: DataFrame, target: str, span: float = 0.2, steps: int = 5) -> DataFrame:
    """R2, -MSE, |Spearman| and correlation of the index with the target per shifted weight vector."""
    deltas = sensitivity.linspace(-span, span, steps)
    grid = [dict(channel=c, step=i, w=grids.shifted_weights(S.CHANNEL_WEIGHTS, c, x)) for c in S.CHANNELS for i, x in enumerate(deltas)]
    d = grids.explode_grid(df.select("series_id", *S.CHANNELS, F.col(target).alias("target")), grid).withColumn("pred", F.round(grids.grid_index(), 9))
    keys = ["series_id", "channel", "step"]
    fit = sensitivity.fit_scores(d, keys).drop("n_distinct", "n")
    rho = sensitivity.rank_correlation(d, keys)
    cor = d.groupBy(*keys).agg(corr("pred", "target").alias("corr"))
    return fit.join(rho, keys).join(cor, keys).select(*keys, "r2", (-F.col("mse")).alias("neg_mse"), F.abs("spearman").alias("abs_spearman"), "corr")
