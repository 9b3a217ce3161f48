"""Resampling plans: moving blocks, stationary, row-wise, permutations; intervals and paired differences.

A draw is a function of (seed, replicate, number) alone, so results do not depend on partitioning or retries. Only the
plan is expanded; its rows are made from one row per series, which the size estimates of Spark do not see, so its joins ask for a merge
lest the expanded plan is broadcast. Additive statistics take each block from prefix sums, which needs one row per block instead of one
per resampled day; ranking metrics run on one array per series and a chunk of replicates.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stressloom import schema as S
from stressloom.functions.special import norm_sf
from stressloom.operators import grids
from stressloom.operators import eventjoin as ev
from stressloom.operators.windows import by_day

M = 2147483647


def draw(seed: int, rep: Column, num: Column) -> Column:
    """Pseudo-random integer in [0, 2^31 - 1): two multiplicative rounds with shifts between them."""
    h = (F.lit(seed) + rep.cast("bigint") * 1000003 + num.cast("bigint") * 7919 + 12345) % M
    h = (h * 48271) % M
    h = h.bitwiseXOR(F.shiftright(h, 15))
    h = (h * 69621) % M
    h = h.bitwiseXOR(F.shiftright(h, 13))
    return (h * 16807) % M


def draw_np(seed: int, rep, num) -> np.ndarray:
    h = (seed + np.asarray(rep, np.int64) * 1000003 + np.asarray(num, np.int64) * 7919 + 12345) % M
    h = (h * 48271) % M
    h ^= h >> 15
    h = (h * 69621) % M
    h ^= h >> 13
    return (h * 16807) % M


def sizes(df: DataFrame, block: int | None) -> DataFrame:
    """n, block length (n^(1/3) by default) and number of blocks per series."""
    return block_sizes(df.groupBy("series_id").agg(F.count(F.lit(1)).cast("int").alias("n")), block)


def block_sizes(n: DataFrame, block: int | None) -> DataFrame:
    b = F.lit(block) if block else F.greatest(F.lit(1), F.floor(F.pow(F.col("n").cast("double"), F.lit(1 / 3)) + 1e-9).cast("int"))
    n = n.withColumn("block", F.least(b, F.col("n")))
    return n.withColumn("blocks", F.ceil(F.col("n") / F.col("block")).cast("int"))


def block_start(seed: int, b: Column) -> Column:
    return (draw(seed, F.col("rep"), b) % (F.col("n") - F.col("block") + 1)).cast("int")


def block_length(b: Column) -> Column:
    return F.least(F.col("block"), F.col("n") - b * F.col("block"))


def block_plan(df: DataFrame, reps: int, block: int | None, seed: int) -> DataFrame:
    """(series_id, rep, b, start, len): overlapping blocks, the last one cut so that lengths add up to n."""
    s = sizes(df, block).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    s = s.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return s.select("series_id", "rep", "b", block_start(seed, F.col("b")).alias("start"), block_length(F.col("b")).alias("len"), "n")


def prefix(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """(series_id, pos, prefix sums up to and including pos), with a zero row at pos = -1."""
    w = by_day().rowsBetween(Window.unboundedPreceding, 0)
    p = df.select("series_id", (F.row_number().over(by_day()) - 1).alias("pos"), *[F.sum(e).over(w).alias(c) for c, e in cols.items()])
    zero = df.select("series_id").distinct().select("series_id", F.lit(-1).alias("pos"), *[F.lit(0.0).alias(c) for c in cols])
    return p.unionByName(zero)


def block_sums(df: DataFrame, plan: DataFrame, cols: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Sums of the columns over each replicate (and `by`, further columns of the plan), from prefix differences at the block ends."""
    p = prefix(df, cols)
    keys = ["series_id", *by, "rep"]
    ends = plan.select(*keys, "n", F.inline(F.array(
        F.struct((F.col("start") + F.col("len") - 1).alias("pos"), F.lit(1.0).alias("sg")), F.struct((F.col("start") - 1).alias("pos"), F.lit(-1.0).alias("sg")))))
    j = ends.hint("merge").join(p, ["series_id", "pos"])
    return j.groupBy(*keys).agg(F.max("n").alias("n"), *[F.sum(F.col("sg") * F.col(c)).alias(c) for c in cols])


def mean_and_deviation(df: DataFrame, x: str, plan: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and sample deviation per replicate. Values are centred first, which keeps the squares small."""
    e = Window.partitionBy("series_id")
    d = df.select("series_id", "ds", F.avg(x).over(e).alias("_m"), (F.col(x) - F.avg(x).over(e)).alias("_c"))
    s = block_sums(d, plan, {"s1": F.col("_c"), "s2": F.col("_c") * F.col("_c")}, by)
    mu = df.groupBy("series_id").agg(F.avg(x).alias("_m"))
    n = F.col("n")
    var = (F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1)
    return s.join(mu, "series_id").select("series_id", *by, "rep", (F.col("_m") + F.col("s1") / n).alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def block_max(df: DataFrame, x: str, plan: DataFrame) -> DataFrame:
    """Maximum of each replicate from a table of range maxima: the maxima of all stretches of 1, 2, 4, ... rows. A block is covered by the
    two stretches of the greatest power of two in it, so a replicate reads two rows per block, not one per day."""
    longest = plan.agg(F.max("len")).first()[0] or 1
    levels = range(max(1, int(longest).bit_length()))
    pos = (F.row_number().over(by_day()) - 1).alias("pos")
    stretch = [F.max(x).over(by_day().rowsBetween(0, 2**k - 1)).alias(f"_{k}") for k in levels]
    table = df.select("series_id", pos, *stretch).select("series_id", "pos", F.posexplode(F.array(*[F.col(f"_{k}") for k in levels])).alias("k", "top"))
    k = F.floor(F.log2(F.col("len") + F.lit(0.5))).cast("int")
    at = plan.withColumn("k", k).select("series_id", "rep", "k", F.explode(F.array("start", F.col("start") + F.col("len") - F.expr("shiftleft(1, k)"))).alias("pos"))
    return at.hint("merge").join(table, ["series_id", "pos", "k"]).groupBy("series_id", "rep").agg(F.max("top").alias("max"))


def interval(reps: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    q = F.percentile(value, F.array(F.lit(a), F.lit(1 - a)))
    return reps.groupBy(*keys).agg(F.count(F.lit(1)).alias("reps"), F.avg(value).alias("boot_mean"), F.stddev_samp(value).alias("se"), q.alias("_q")).select(
        *keys, "reps", "boot_mean", "se", F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))


def block_bootstrap_mean(df: DataFrame, x: str, reps: int = 500, blocks: tuple[int | None, ...] = (None,), seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile and basic intervals of the mean, for each block length asked for (None: the cube root of the number of days)."""
    plans = [block_plan(df, reps, b, seed).withColumn("block", F.lit(b or 0)) for b in blocks]
    r = mean_and_deviation(df, x, reduce(DataFrame.unionByName, plans), ("block",))
    i = interval(r, ["series_id", "block"], "mean", level)
    hat = df.groupBy("series_id").agg(F.avg(x).alias("estimate"))
    return i.join(hat, "series_id").withColumn("basic_lo", 2 * F.col("estimate") - F.col("hi")).withColumn("basic_hi", 2 * F.col("estimate") - F.col("lo"))


def stationary_plan(df: DataFrame, reps: int, expected: float, seed: int) -> DataFrame:
    """(series_id, rep, n, start, len): circular walks that restart with probability 1/expected, as runs. Their lengths are geometric, by
    the inverse of the distribution, and added up until n days are full; a run over the end of the series is two blocks. The number of
    runs a walk needs has mean n/expected; so many are drawn that more are needed once in 10^9 walks, and then the last one goes on."""
    p = 1.0 / expected
    s = sizes(df, None).select("series_id", "n").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    s = s.withColumn("runs", (F.ceil(F.col("n") * p + 6 * F.sqrt(F.col("n") * p * (1 - p))) + 10).cast("int"))
    s = s.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)))
    u = (draw(seed + 1, F.col("rep"), F.col("j")) + F.lit(0.5)) / float(M)
    geometric = F.lit(1) + F.floor(F.ln(u) / F.lit(math.log(1 - p)))
    s = s.withColumn("len", F.when(F.col("j") == F.col("runs") - 1, F.col("n")).otherwise(F.least(geometric, F.col("n"))).cast("int"))
    before = F.coalesce(F.sum("len").over(Window.partitionBy("series_id", "rep").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("_b", before).where(F.col("_b") < F.col("n")).withColumn("len", F.least(F.col("len"), F.col("n") - F.col("_b")).cast("int"))
    s = s.withColumn("start", (draw(seed, F.col("rep"), F.col("j")) % F.col("n")).cast("int"))
    head = F.least(F.col("len"), F.col("n") - F.col("start"))
    blocks = F.array(F.struct(F.col("start"), head.alias("len")), F.struct(F.lit(0).alias("start"), (F.col("len") - head).alias("len")))
    return s.select("series_id", "rep", "n", F.inline(blocks)).where("len > 0")


def stationary_mean(df: DataFrame, x: str, reps: int = 200, expected: float = 20.0, seed: int = 42) -> DataFrame:
    return interval(mean_and_deviation(df, x, stationary_plan(df, reps, expected, seed)), ["series_id"], "mean")


def bca(df: DataFrame, x: str, reps: int = 500, block: int | None = None, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Bias-corrected accelerated interval of the mean. Leave-one-out means have a closed form, so the acceleration is
    an aggregate of third moments; the two adjusted ranks are read from the sorted replicates."""
    r = mean_and_deviation(df, x, block_plan(df, reps, block, seed))
    e = Window.partitionBy("series_id")
    d = df.select("series_id", (F.col(x) - F.avg(x).over(e)).alias("_d"), F.avg(x).over(e).alias("_m"))
    acc = d.groupBy("series_id").agg(F.first("_m").alias("estimate"), (F.sum(F.pow("_d", F.lit(3.0))) / (6.0 * F.pow(F.sum(F.pow("_d", F.lit(2.0))), F.lit(1.5)))).alias("a"))
    return _adjusted(r.select("series_id", F.col("mean").alias("value")).join(acc, "series_id"), ["series_id"], level)


def _adjusted(reps: DataFrame, keys: list[str], level: float) -> DataFrame:
    """BCa intervals of replicates (keys, value, estimate, a)."""
    g = reps.groupBy(*keys, "estimate", "a").agg(
        F.avg((F.col("value") < F.col("estimate")).cast("double")).alias("below"), F.array_sort(F.collect_list("value")).alias("sorted"))
    al = (1 - level) / 2

    def run(batches):
        ppf = _norm_ppf
        for pdf in batches:
            out = []
            for t in pdf.itertuples(index=False):
                z0 = ppf(min(max(t.below, 1e-6), 1 - 1e-6))
                pct = []
                for z in (ppf(al), ppf(1 - al)):
                    k = z0 + z
                    pct.append(float(1 - norm_sf(z0 + k / (1 - t.a * k))))
                v = np.asarray(t.sorted, float)
                out.append((*t[: len(keys)], t.estimate, float(z0), float(t.a), float(np.quantile(v, pct[0])), float(np.quantile(v, pct[1]))))
            yield pd.DataFrame(out, columns=[*keys, "estimate", "bias", "acceleration", "lo", "hi"])

    texts = ", ".join(f"{k} string" for k in keys)
    return g.select(*keys, "estimate", "a", "below", "sorted").mapInPandas(
        run, f"{texts}, estimate double, bias double, acceleration double, lo double, hi double")


def auroc_jackknife(df: DataFrame, models: list[str], label: str) -> DataFrame:
    """(series_id, model, estimate, a): AUROC, and the acceleration of its leave-one-out values, from placement values. Leaving a positive
    out takes its share of lower negatives from the mean over positives, leaving a negative out its share of higher positives; so all
    leave-one-out values follow from counts per distinct score. Null where a class has fewer than two rows or nothing varies."""
    long = df.select("series_id", F.col(label).cast("double").alias("y"), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("score")) for m in models])).alias("_m"))
    c = long.groupBy("series_id", "_m.model", "_m.score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    w = Window.partitionBy("series_id", "model")
    up, down = w.orderBy("score").rowsBetween(Window.unboundedPreceding, -1), w.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    low, high = F.coalesce(F.sum("q").over(up), F.lit(0.0)) + F.col("q") / 2, F.coalesce(F.sum("p").over(down), F.lit(0.0)) + F.col("p") / 2
    c = c.select("*", low.alias("low"), high.alias("high"), F.sum("p").over(w).alias("ones"), F.sum("q").over(w).alias("zeros"))
    c = c.withColumn("wins", F.sum(F.col("p") * F.col("low")).over(w)).where("ones > 1 AND zeros > 1")
    less_p = (F.col("wins") - F.col("low")) / ((F.col("ones") - 1) * F.col("zeros"))
    less_q = (F.col("wins") - F.col("high")) / (F.col("ones") * (F.col("zeros") - 1))
    c = c.withColumns({"_tp": less_p, "_tq": less_q})
    c = c.withColumn("_c", F.sum(F.col("p") * F.col("_tp") + F.col("q") * F.col("_tq")).over(w) / (F.col("ones") + F.col("zeros")))
    power = lambda k: F.sum(F.col("p") * F.pow(F.col("_c") - F.col("_tp"), F.lit(k)) + F.col("q") * F.pow(F.col("_c") - F.col("_tq"), F.lit(k)))
    a = power(3.0) / F.nullif(6.0 * F.pow(power(2.0), F.lit(1.5)), F.lit(0.0))
    return c.groupBy("series_id", "model").agg((F.max("wins") / (F.max("ones") * F.max("zeros"))).alias("estimate"), a.alias("a"))


def bca_auroc(df: DataFrame, models: list[str], label: str, reps: int = 500, block: int | None = 25, seed: int = 42, level: float = 0.95) -> DataFrame:
    """BCa interval of the AUROC of every model under the same block draws."""
    r = replicate_metrics(df, models, label, reps, block, seed).select("series_id", "model", "value")
    return _adjusted(r.join(auroc_jackknife(df, models, label).where("a IS NOT NULL"), ["series_id", "model"]), ["series_id", "model"], level)


def _norm_ppf(p: float) -> float:
    """Normal quantile by bisection of the exact tail."""
    lo, hi = -10.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def last_row_index(df: DataFrame, reps: int, block: int | None, seed: int) -> DataFrame:
    """Position of the last resampled row per replicate: only the last block decides it."""
    s = sizes(df, block).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    start = draw(seed, F.col("rep"), F.col("blocks") - 1) % (F.col("n") - F.col("block") + 1)
    return s.select("series_id", "rep", (start + F.col("n") - 1 - (F.col("blocks") - 1) * F.col("block")).cast("int").alias("pos"))


def index_distribution(df: DataFrame, x: str = "idx", reps: int = 500, block: int | None = None, seed: int = 42, levels=(0.90, 0.95, 0.99)) -> DataFrame:
    """Distribution of the last resampled row and of the mean, deviation and maximum of the resampled series: per statistic its value on the
    data (point), standard error, bias, and intervals at several levels."""
    v = df.select("series_id", (F.row_number().over(by_day()) - 1).alias("pos"), F.col(x).alias("last"))
    names = ["last", "mean", "std", "max"]
    point = df.groupBy("series_id").agg(F.max_by(x, "ds").alias("last"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.max(x).alias("max"))
    plan = block_plan(df, reps, block, seed)
    r = mean_and_deviation(df, x, plan).join(block_max(df, x, plan), ["series_id", "rep"])
    r = r.join(last_row_index(df, reps, block, seed).join(v, ["series_id", "pos"]).drop("pos"), ["series_id", "rep"])
    r, point = r.unpivot(["series_id", "rep"], names, "statistic", "_v"), point.unpivot(["series_id"], names, "statistic", "point")
    qs = [q for lv in levels for q in ((1 - lv) / 2, (1 + lv) / 2)]
    g = r.groupBy("series_id", "statistic").agg(F.avg("_v").alias("_m"), F.stddev_samp("_v").alias("se"), F.percentile("_v", F.array(*[F.lit(q) for q in qs])).alias("_q"))
    cells = [F.struct(F.lit(lv).alias("level"), F.col("_q")[2 * i].alias("lo"), F.col("_q")[2 * i + 1].alias("hi")) for i, lv in enumerate(levels)]
    return g.join(point, ["series_id", "statistic"]).select("series_id", "statistic", "point", "se", (F.col("_m") - F.col("point")).alias("bias"), F.inline(F.array(*cells)))


def rolling_bands(df: DataFrame, x: str = "idx", width: int = 90, reps: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Interval of the last resampled row over each window of `width` rows. The drawn offsets are the same for every
    window, so they are one literal list, and each row looks them up in its own window array."""
    block = max(1, int(width ** (1 / 3) + 1e-9))
    blocks = -(-width // block)
    starts = draw_np(seed, np.arange(reps), np.full(reps, blocks - 1)) % (width - block + 1)
    offs = sorted(int(s) + width - 1 - (blocks - 1) * block for s in starts)
    d = df.select("series_id", "ds", x, F.collect_list(x).over(by_day().rowsBetween(-(width - 1), 0)).alias("_w")).filter(F.size("_w") == width)

    @F.pandas_udf("struct<lo: double, hi: double, se: double>")
    def band(w: pd.Series) -> pd.DataFrame:
        m = np.stack(w.to_list())[:, offs]
        a = (1 - level) / 2
        lo, hi = np.quantile(m, [a, 1 - a], axis=1)
        return pd.DataFrame({"lo": lo, "hi": hi, "se": m.std(axis=1, ddof=1)})

    return d.select("series_id", "ds", F.col(x).alias("point"), band("_w").alias("_b")).select("series_id", "ds", "point", "_b.*")


METRICS = {}


def metric(name: str):
    def wrap(f):
        METRICS[name] = f
        return f

    return wrap


def _cum(w_pos: np.ndarray, w_neg: np.ndarray, ends: np.ndarray):
    """Counts at or above each distinct score, scores descending; rows are replicates."""
    return np.cumsum(w_pos, axis=1)[:, ends], np.cumsum(w_neg, axis=1)[:, ends]


@metric("auroc")
def _auroc(tp, fp):
    p, n = tp[:, -1:], fp[:, -1:]
    dp, dn = np.diff(tp, axis=1, prepend=0), np.diff(fp, axis=1, prepend=0)
    area = (dn * (tp - dp / 2.0)).sum(axis=1)
    den = (p * n)[:, 0]
    return np.where(den > 0, area / np.where(den > 0, den, 1), 0.5)


@metric("average_precision")
def _ap(tp, fp):
    p = np.maximum(tp[:, -1:], 1e-300)
    prec = tp / np.maximum(tp + fp, 1e-300)
    return (np.diff(tp, axis=1, prepend=0) / p * prec).sum(axis=1)


def replicate_metrics(df: DataFrame, models: list[str], label: str, reps: int = 200, block: int | None = 25, seed: int = 42, iid: bool = False,
                      metrics=("auroc",), chunk: int = 50) -> DataFrame:
    """Metric of every model under the same resampling plan: (series_id, rep, model, metric, value).

    One row per series carries its label and score arrays (calendar-bounded); it is copied once per chunk of replicates,
    so a single long series still spreads over reps/chunk tasks.
    """
    packed = df.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("ds", F.col(label).cast("double").alias("y"), *[F.col(m).cast("double").alias(m) for m in models]))).alias("_a"))
    packed = packed.select("series_id", F.col("_a.y").alias("y"), *[F.col(f"_a.{m}").alias(f"m_{m}") for m in models])
    starts = list(range(0, reps, chunk))
    work = packed.withColumn("_from", F.explode(F.array(*[F.lit(s) for s in starts])))
    work = work.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "series_id", "_from")
    names = list(metrics)

    def run(batches):
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                y = np.asarray(t.y, float)
                n = len(y)
                rep = np.arange(t[-1], min(t[-1] + chunk, reps))
                if iid:
                    idx = draw_np(seed, rep[:, None], np.arange(n)[None, :]) % n
                    w = np.stack([np.bincount(r, minlength=n) for r in idx]).astype(float)
                else:
                    b = min(block or max(1, int(n ** (1 / 3) + 1e-9)), n)
                    nb = -(-n // b)
                    st = draw_np(seed, rep[:, None], np.arange(nb)[None, :]) % (n - b + 1)
                    ln = np.minimum(b, n - np.arange(nb) * b)
                    d = np.zeros((len(rep), n + 1))
                    np.add.at(d, (np.arange(len(rep))[:, None], st), 1.0)
                    np.add.at(d, (np.arange(len(rep))[:, None], st + ln[None, :]), -1.0)
                    w = np.cumsum(d[:, :n], axis=1)
                for i, m in enumerate(models):
                    s = np.asarray(t[2 + i], float)
                    o = np.argsort(-s, kind="stable")
                    ends = np.flatnonzero(np.append(np.diff(s[o]) != 0, True))
                    tp, fp = _cum(w[:, o] * y[o], w[:, o] * (1 - y[o]), ends)
                    for name in names:
                        rows += [(t.series_id, int(r), m, name, float(v)) for r, v in zip(rep, METRICS[name](tp, fp))]
            yield pd.DataFrame(rows, columns=["series_id", "rep", "model", "metric", "value"])

    return work.mapInPandas(run, "series_id string, rep int, model string, metric string, value double")


def paired_difference(reps: DataFrame, base: str, level: float = 0.95) -> DataFrame:
    """Difference of each model to the base under equal draws: interval and two-sided p = 2*min(tail)."""
    b = reps.filter(F.col("model") == base).select("series_id", "rep", "metric", F.col("value").alias("_b"))
    d = reps.filter(F.col("model") != base).join(b, ["series_id", "rep", "metric"]).withColumn("diff", F.col("_b") - F.col("value"))
    keys = ["series_id", "model", "metric"]
    p = d.groupBy(*keys).agg((2.0 * F.least(F.avg((F.col("diff") <= 0).cast("double")), F.avg((F.col("diff") >= 0).cast("double")))).alias("_p"))
    return interval(d, keys, "diff", level).join(p.select(*keys, F.least("_p", F.lit(1.0)).alias("p")), keys)


def row_bands(df: DataFrame, value: str, reps: int = 100, block: int = 20, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Per date: mean and percentiles over the resampled series read at that position. Position t of replicate r takes
    row start(b) + t - b*block of its block b, so each (date, replicate) is one lookup."""
    p = block_plan(df, reps, block, seed)
    p = p.select("series_id", "rep", "b", "start", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("k"))
    v = df.select("series_id", "ds", (F.row_number().over(by_day()) - 1).alias("pos"), F.col(value).alias("_v"))
    src = p.select("series_id", "rep", (F.col("b") * block + F.col("k")).alias("at"), (F.col("start") + F.col("k")).alias("pos")).hint("merge").join(v.drop("ds"), ["series_id", "pos"])
    a = (1 - level) / 2
    g = src.groupBy("series_id", "at").agg(F.avg("_v").alias("mean"), F.percentile("_v", F.array(F.lit(a), F.lit(1 - a))).alias("_q"))
    return g.join(v.select("series_id", "ds", F.col("pos").alias("at")), ["series_id", "at"]).select("series_id", "ds", "mean", F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))


def detection(df: DataFrame, events: DataFrame, reps: int = 200, block: int = 10, seed: int = 42, threshold: float = 50.0, before: int = 30, est: int = 60) -> DataFrame:
    """Resample the estimation window of each event; a replicate detects when the pre-event maximum reaches
    min(threshold, mean + 2 sd). Rate with Wilson interval; mean, median and 95 percent
    interval of the lead over the replicates that detect."""
    w = df.join(ev.unfold(events.select("event", "event_date"), before + est, -1), "ds")
    e = w.filter(F.col("rel") < -before).select(F.concat_ws("|", "series_id", "event").alias("series_id"), "ds", "idx")
    r = mean_and_deviation(e, "idx", block_plan(e, reps, block, seed))
    cut = r.select("series_id", "rep", F.least(F.lit(threshold), F.col("mean") + 2 * F.col("std")).alias("cut"))
    pre = w.filter(F.col("rel") >= -before).groupBy("series_id", "event").agg(F.array_sort(F.collect_list(F.struct("rel", "idx"))).alias("_p"))
    pre = pre.withColumn("_k", F.concat_ws("|", "series_id", "event"))
    j = pre.join(cut.withColumnRenamed("series_id", "_k"), "_k")
    first = F.try_element_at(F.filter("_p", lambda p: p["idx"] >= F.col("cut")), F.lit(1))["rel"]
    j = j.select("series_id", "event", "rep", (-first).alias("lead"))
    g = j.groupBy("series_id", "event").agg(F.count(F.lit(1)).alias("n"), F.count("lead").alias("k"), F.avg("lead").alias("mean_lead"), F.percentile("lead", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("_l"))
    z, n, p = 1.959963984540054, F.col("n"), F.col("k") / F.col("n")
    mid, half, den = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return g.select("series_id", "event", p.alias("rate"), ((mid - half) / den).alias("lo"), ((mid + half) / den).alias("hi"), "mean_lead", *[F.col("_l")[i].alias(c) for i, c in enumerate(("lead_lo", "lead_median", "lead_hi"))])


def placebo_shuffle(df: DataFrame, events: DataFrame, reps: int = 200, seed: int = 42, threshold: float = 70.0, days: int = 30) -> DataFrame:
    """F1 of the alerts against randomly placed event dates; z and p of the true dates. True dates are replicate -1."""
    n_ev = events.count()  # size of the event table, a parameter
    v = df.select("series_id", "ds", (F.row_number().over(by_day()) - 1).cast("int").alias("pos"), "idx")
    n = sizes(df, None).select("series_id", "n").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_ev - 1))))
    fake = n.select("series_id", "rep", "j", (draw(seed, F.col("rep"), F.col("j")) % F.col("n")).cast("int").alias("pos")).join(v.select("series_id", "pos", "ds"), ["series_id", "pos"])
    fake = fake.select("series_id", "rep", F.col("j").cast("string").alias("event"), F.col("ds").alias("event_date"))
    alerts = df.filter(F.col("idx") > threshold).select("series_id", "ds")
    total = alerts.groupBy("series_id").agg(F.count(F.lit(1)).alias("_alerts"))
    score = [F.countDistinct("ds").alias("_tp"), F.countDistinct("event").alias("_found")]
    hit = ev.unfold(fake, days, -1).hint("merge").join(alerts, ["series_id", "ds"]).groupBy("series_id", "rep").agg(*score)
    true = ev.unfold(events.select("event", "event_date"), days, -1).join(alerts, "ds").groupBy("series_id").agg(*score)
    reps_of = total.withColumn("rep", F.explode(F.sequence(F.lit(-1), F.lit(reps - 1))))
    every = reps_of.join(hit.unionByName(true.withColumn("rep", F.lit(-1))), ["series_id", "rep"], "left")
    p, r = F.coalesce("_tp", F.lit(0)) / F.col("_alerts"), F.coalesce("_found", F.lit(0)) / F.lit(n_ev)
    f1 = every.select("series_id", "rep", F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"))
    act = f1.filter("rep = -1").select("series_id", F.col("f1").alias("actual"))
    g = f1.filter("rep >= 0").join(act, "series_id").groupBy("series_id", "actual").agg(F.avg("f1").alias("placebo_mean"), F.stddev_pop("f1").alias("_sd"), F.avg((F.col("f1") >= F.col("actual")).cast("double")).alias("p"))
    return g.withColumn("z", (F.col("actual") - F.col("placebo_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))).drop("_sd")


def placebo_features(df: DataFrame, target: str) -> DataFrame:
    """|rank correlation| with the target under all orderings of the weights, the true one being number 0. Four channels
    have 24 orderings, so the permutation distribution is complete rather than sampled."""
    from itertools import permutations

    from stressloom.operators.sensitivity import rank_correlation

    grid = [dict(perm=i, w=[float(x) for x in p]) for i, p in enumerate(permutations(S.CHANNEL_WEIGHTS.values()))]
    d = grids.explode_grid(df.select("series_id", *S.CHANNELS, F.col(target).alias("target")), grid).withColumn("pred", F.round(grids.grid_index(), 9))
    c = rank_correlation(d, ["series_id", "perm"]).withColumn("v", F.round(F.abs("spearman"), 12))
    act = c.filter("perm = 0").select("series_id", F.col("v").alias("actual"))
    return c.join(act, "series_id").groupBy("series_id", "actual").agg(
        F.avg("v").alias("placebo_mean"), F.stddev_pop("v").alias("placebo_sd"), F.avg((F.col("v") >= F.col("actual")).cast("double")).alias("p"))


def bootstrap_statistic(df: DataFrame, x: str, statistic, reps: int = 100, block: int | None = 20, seed: int = 42, chunk: int = 50) -> DataFrame:
    """Any Spark aggregate (a function of a column, grouped pandas UDFs included) over each replicate. One row per series carries its values
    (calendar-bounded) and is copied once per chunk of replicates; the resampled rows are cut from it where they are grouped, so they
    are neither joined nor shuffled."""
    days = F.array_sort(F.collect_list(F.struct("ds", F.col(x).alias("_v"))))
    packed = block_sizes(df.where("series_id IS NOT NULL").groupBy("series_id").agg(days.alias("_a")).select("series_id", F.col("_a._v").alias("_a"), F.size("_a").alias("n")), block)
    work = packed.withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(chunk))))
    work = work.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "series_id", "_from")
    work = work.withColumn("rep", F.explode(F.sequence("_from", F.least(F.col("_from") + chunk, F.lit(reps)) - 1)))
    cut = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.slice("_a", block_start(seed, b) + 1, block_length(b)))
    r = work.select("series_id", "_from", "rep", F.explode(F.flatten(cut)).alias("_v")).groupBy("series_id", "_from", "rep").agg(statistic(F.col("_v")).alias("value"))
    return interval(r, ["series_id"], "value")
