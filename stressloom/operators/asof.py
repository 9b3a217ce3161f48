"""As-of joins without a range join.

Both sides are stacked and ordered inside (key, time bucket), so a key that holds a large share of all rows is
spread over its buckets; a bucket with more than BUCKET_ROWS rows is cut into equal parts of its time, as many as its
count asks for. What a bucket needs from its neighbours is one row per bucket (last and first observation), carried over
a window whose length is the number of buckets, not of rows. The result does not depend on the buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that one part of a bucket holds on average at most.
BUCKET_ROWS = 200_000
PARTS = 1 << 20


def _bucketed(u: DataFrame, keys: list[str], seconds: int, rows: int) -> DataFrame:
    """`_b`: number of the bucket and of the part within it. Counts are summed map-side; only crowded buckets travel on."""
    width = seconds * 1_000_000
    u = u.withColumn("_w", F.floor(F.unix_micros("_ts") / F.lit(width)))
    crowded = u.groupBy(*keys, "_w").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).alias("_m")).filter("_m > 1")
    u = u.join(crowded, [*keys, "_w"], "left")
    part = F.floor(F.pmod(F.unix_micros("_ts"), F.lit(width)) * F.least(F.coalesce("_m", F.lit(1)), F.lit(PARTS)) / F.lit(width))
    return u.withColumn("_b", F.col("_w") * PARTS + part).drop("_w", "_m")


def _carry(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("_b")
    return df.select(
        *keys, "_b",
        F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_cp"),
        F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_cn"),
    )


def neighbours(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, value: str, bucket_seconds: int = 86400, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Left rows with prev = (ts, value) at or before and next = (ts, value) strictly after. Null values on the right
    are skipped, so a lookup sees through missing observations."""
    cols = [c for c in left.columns if c not in keys]
    obs = right.filter(F.col(value).isNotNull()).select(
        *keys, F.col(right_ts).cast("timestamp").alias("_ts"), F.lit(None).alias("_l"),
        F.struct(F.col(right_ts).cast("timestamp").alias("ts"), F.col(value).alias("v")).alias("_o"))
    ask = left.select(
        *keys, F.col(left_ts).cast("timestamp").alias("_ts"), F.struct(*cols).alias("_l"), F.lit(None).alias("_o"))
    u = _bucketed(ask.unionByName(obs), keys, bucket_seconds, bucket_rows)
    side = F.when(F.col("_o").isNotNull(), 0).otherwise(1)
    w = Window.partitionBy(*keys, "_b").orderBy("_ts", side)
    near = u.select(
        *keys, "_b", "_l",
        F.last("_o", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_p"),
        F.first("_o", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_n"),
    ).filter(F.col("_l").isNotNull())
    ends = u.groupBy(*keys, "_b").agg(F.max("_o").alias("_last"), F.min("_o").alias("_first"))
    out = near.join(_carry(ends, keys), [*keys, "_b"])
    return out.select(
        *keys, *[F.col(f"_l.{c}").alias(c) for c in cols],
        F.coalesce("_p", "_cp").alias("prev"), F.coalesce("_n", "_cn").alias("next"),
    )


def backward(left, right, keys, left_ts, right_ts, value, out: str, default: Column | None = None, bucket_seconds: int = 86400, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    n = neighbours(left, right, keys, left_ts, right_ts, value, bucket_seconds, bucket_rows)
    v = F.col("prev.v")
    return n.withColumn(out, v if default is None else F.coalesce(v, default)).drop("prev", "next")


def nearest(left, right, keys, left_ts, right_ts, value, out: str, tolerance_seconds: int | None = None, bucket_seconds: int = 86400, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Nearest in absolute time; the earlier observation wins a tie."""
    n = neighbours(left, right, keys, left_ts, right_ts, value, bucket_seconds, bucket_rows)
    at = F.unix_micros(F.col(left_ts).cast("timestamp"))
    gp, gn = at - F.unix_micros(F.col("prev.ts")), F.unix_micros(F.col("next.ts")) - at
    use_prev = F.col("next").isNull() | (gp <= gn)
    pick, gap = F.when(use_prev, F.col("prev")).otherwise(F.col("next")), F.when(use_prev, gp).otherwise(gn)
    n = n.withColumn("_pick", pick).withColumn("gap_seconds", gap / F.lit(1e6))
    v = F.col("_pick.v")
    if tolerance_seconds is not None:
        v = F.when(F.col("gap_seconds") <= tolerance_seconds, v)
    return n.withColumn(out, v).drop("prev", "next", "_pick")


def lagged(left, right, keys, left_ts, right_ts, value, out: str, lag_hours: Column, bucket_seconds: int = 86400) -> DataFrame:
    """Only observations already published: their time plus the publication lag is at or before the target."""
    seen = F.timestamp_seconds(F.unix_micros(F.col(right_ts).cast("timestamp")) / F.lit(1e6) + lag_hours * 3600)
    shifted = right.withColumn("_seen", seen)
    return backward(left, shifted, keys, left_ts, "_seen", value, out, bucket_seconds=bucket_seconds)
