"""Daily bars from intraday points and peg history columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stressloom.session import stored

#: Distinct values of a group that one task may order; groups with more are narrowed first. Ranges of a narrowing step.
GROUP_ROWS, RANGES = 100_000, 1024


def _exponent(x: Column) -> Column:
    """Sign and power of two of a number: a coarse range that rises with it."""
    size = F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-1080)) + 1100
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("bigint") * size)


def _even(x: Column) -> Column:
    """One of RANGES equal parts of [_low, _high], the bounds of what is left of the group."""
    return F.least(F.floor((x - F.col("_low")) / (F.col("_high") - F.col("_low")) * RANGES), F.lit(RANGES - 1))


def _met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on the keys, nulls alike."""
    b = b.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    return a.join(b, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]), how).drop(*[f"_of_{k}" for k in keys])


def _narrowed(rows: DataFrame, keys: list[str], value: str, part: Column) -> DataFrame:
    """Per group: the part that holds its middle, as (_part, rows, below, low, high). Where the two middle values lie in two parts they
    are the end of one and the beginning of the other; then _part is null and low and high are these values."""
    parts = rows.groupBy(*keys, "_total", "_below", part.alias("_part")).agg(
        F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_rows"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_below")
    parts = parts.withColumn("_before", before)
    holds = lambda rank: (F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_n"))
    first, second = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    pick = lambda cond, c: F.max(F.when(cond, F.col(c)))
    a, b = holds(first), holds(second)
    g = parts.groupBy(*keys, "_total").agg(
        pick(a, "_part").alias("_a"), pick(b, "_part").alias("_b"), pick(a, "_rows").alias("_rows"), pick(a, "_before").alias("_below"),
        pick(a, "_lo").alias("_alo"), pick(a, "_hi").alias("_ahi"), pick(b, "_lo").alias("_blo"))
    same = F.col("_a") == F.col("_b")
    return g.select(*keys, "_total", "_rows", "_below", F.when(same, F.col("_a")).alias("_part"),
                    F.when(same, F.col("_alo")).otherwise(F.col("_ahi")).alias("_low"), F.when(same, F.col("_ahi")).otherwise(F.col("_blo")).alias("_high"))


def weighted_median(rows: DataFrame, keys: list[str], value: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Exact median per group of distinct values with counts (keys, value, n); null values do not count, and a group without others has none.

    A group of at most group_rows values is ordered by one task. Of a larger one only counts per value range travel: the range that holds
    the middle is found by its counts, and the next pass reads that range alone, by powers of two first, then by 1024 equal parts. A
    number has as many bits as six passes tell apart, and most need two; no task holds a whole group."""
    middle_of = F.percentile(value, 0.5, F.col("n")).alias(value)
    rows = stored(rows, "median-values")
    size = rows.groupBy(*keys).agg(F.count(value).alias("_rows"), F.sum(F.when(F.col(value).isNotNull(), F.col("n"))).alias("_total"))
    crowded = stored(size.where(F.col("_rows") > group_rows), "median-crowded")
    if crowded.isEmpty():
        return rows.groupBy(*keys).agg(middle_of)
    found = [_met(rows, crowded, keys, "left_anti").groupBy(*keys).agg(middle_of)]
    left = _met(rows.where(F.col(value).isNotNull()), crowded, keys).drop("_rows").withColumn("_below", F.lit(0).cast("bigint"))
    part, first = _exponent(F.col(value)), True
    while True:
        left = stored(left, "median-left")
        if left.isEmpty():
            break
        middle = stored(_narrowed(left, keys, value, part if first else _even(F.col(value))), "median-range")
        settled = F.col("_part").isNull() | (F.col("_low") == F.col("_high"))
        found.append(middle.where(settled).select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias(value)))
        inside = middle.where(~settled)
        narrow = inside.select(*keys, F.col("_below").alias("_b2"), F.col("_low").alias("_l2"), F.col("_high").alias("_h2"), "_rows")
        kept = _met(left.drop("_low", "_high"), narrow, keys).where(F.col(value).between(F.col("_l2"), F.col("_h2")))
        kept = kept.withColumn("_below", F.col("_b2")).withColumnsRenamed({"_l2": "_low", "_h2": "_high"}).drop("_b2")
        done = stored(kept, "median-kept")
        found.append(_ordered(done.where(F.col("_rows") <= group_rows), keys, value))
        left, first = done.where(F.col("_rows") > group_rows).drop("_rows"), False
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _ordered(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The median from the few values around it and the count of those below."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(value)) + F.col("_below")
    r = rows.withColumn("_upto", upto)
    first, second = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    g = r.groupBy(*keys).agg(F.min(F.when(F.col("_upto") >= first, F.col(value))).alias("_a"), F.min(F.when(F.col("_upto") >= second, F.col(value))).alias("_b"))
    return g.select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias(value))


def daily_median(points: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Median price per symbol and UTC date. Points are first counted per price, so a symbol with very many equal prices travels as few
    rows; a day with very many prices is narrowed by counts."""
    day = points.groupBy("symbol", F.to_date("ts").alias("ds"), "price").agg(F.count(F.lit(1)).alias("n"))
    return weighted_median(day, ["symbol", "ds"], "price", group_rows)


def peg_history(daily: DataFrame) -> DataFrame:
    """Peg deviation and rolling 7- and 30-row deviations with minimum counts 3 and 7."""
    w = Window.partitionBy("symbol").orderBy("ds")

    def roll(n, least):
        f = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count("price").over(f) >= least, F.stddev_samp("price").over(f))

    return daily.select(
        "symbol", "ds", "price", F.abs(1.0 - F.col("price")).alias("peg_deviation"),
        roll(7, 3).alias("peg_volatility_7d"), roll(30, 7).alias("peg_volatility_30d"))
