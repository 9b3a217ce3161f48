"""Structured Streaming jobs. Each has a batch twin with the same result on complete input.

Sources are file streams of landed points (source, key, ts, value); event time is a UTC timestamp.
"""

from __future__ import annotations

from contextlib import contextmanager, nullcontext
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stressloom.sources import sinks
from stressloom.streaming.state import keyed_store

POINTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("key", T.LongType()),
    T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType()),
])


def read_points(spark: SparkSession, path: str, files_per_trigger: int = 4, schema: T.StructType = POINTS) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", partition: str | None = None, keyed: bool = False) -> list:
    """Process everything that has landed and stop; restartable from the checkpoint. keyed: the plan holds keyed state with timers.
    Returns the progress of its batches."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet")
    with keyed_store(df.sparkSession) if keyed else nullcontext():
        q = (w.partitionBy(partition) if partition else w).start(path)
        q.awaitTermination()
    return q.recentProgress


def daily_bars(points: DataFrame, delay: str = "2 days") -> DataFrame:
    """Tumbling daily bar per source; late rows inside the watermark are counted."""
    w = points.withWatermark("ts", delay).groupBy("source", F.window("ts", "1 day"))
    return w.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.percentile_approx("value", 0.5, 10000).alias("median")).select(
        "source", F.to_date("window.start").alias("ds"), "n", "mean", "median")


def sliding_average(points: DataFrame, days: int = 30, delay: str = "2 days") -> DataFrame:
    """Mean of the last `days` days per source, a row for each day it moves on. Two stateful steps: daily panes with sum and count, then
    sliding windows over the panes, so a raw row is added once and only panes are handed to `days` windows each."""
    panes = points.withWatermark("ts", delay).groupBy("source", F.window("ts", "1 day").alias("pane")).agg(F.count("value").alias("n"), F.sum("value").alias("total"))
    w = panes.groupBy("source", F.window(F.window_time("pane"), f"{days} days", "1 day").alias("span")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return w.select("source", F.to_date("span.end").alias("ds"), "n", (F.col("total") / F.nullif("n", F.lit(0))).alias("mean"))


def deduplicated(points: DataFrame, keys: list[str], delay: str = "2 days") -> DataFrame:
    """At most one row per key while its watermark lasts."""
    return points.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def visible_values(targets: DataFrame, points: DataFrame, lag_hours: dict[str, int], look_back_hours: int = 24, counted: bool = False) -> DataFrame:
    """Targets with the points of their source that were published in the `look_back_hours` up to the target time, each source with its
    own publication lag (rows of other sources are left out): an outer interval join of two streams per source, under its own watermark,
    and their union. A source with a short lag keeps its rows for lag + look_back_hours, however long the lags of others are. Under the
    policy `max` (see `newest_decides`) a source that falls silent does not hold the others back.

    The pairs of a crowded source grow with the square of its rows. Who wants their number only asks for `counted`: the rows are then those
    of `visible_panes`, and `visible_counts` reads the number for each target from them."""
    if counted:
        return visible_panes(targets, points, lag_hours, look_back_hours)

    def of(source: str, hours: int) -> DataFrame:
        mine = F.col("source") == source
        delay = f"{max(1, hours)} hours"
        p = points.where(mine).select(F.col("ts").alias("p_ts"), "value", F.lit(1).alias("p_one")).withWatermark("p_ts", delay)
        t = targets.where(mine).select("source", "key", "ts", F.lit(1).alias("one")).withWatermark("ts", delay)
        first, last = F.expr(f"interval {hours + look_back_hours} hours"), F.expr(f"interval {hours} hours")
        on = (F.col("one") == F.col("p_one")) & (F.col("p_ts") <= F.col("ts") - last) & (F.col("p_ts") > F.col("ts") - first)
        return t.join(p, on, "leftOuter").select("source", "key", "ts", "p_ts", "value")

    return reduce(DataFrame.unionByName, [of(s, h) for s, h in lag_hours.items()])


def visible_panes(targets: DataFrame, points: DataFrame, lag_hours: dict[str, int], look_back_hours: int = 24, pane: str = "1 minute") -> DataFrame:
    """(source, pane, net, seen): a point comes at its time plus the lag of its source and goes `look_back_hours` later; a target sees those
    that came at its time or before and went after it. One row per source and pane of time once its watermark has passed the pane: how
    many more came than went in it, and its targets (key, ts, net up to their time within the pane). A point is two entries of the state
    and a target one, however many points each target sees; panes bound what is ordered at once."""

    def of(source: str, hours: int) -> DataFrame:
        mine = F.col("source") == source
        at = lambda h: F.col("ts") + F.expr(f"interval {h} hours")
        none = F.lit(None).cast("bigint").alias("key")
        ways = [F.struct(at(h).alias("at"), F.lit(False).alias("target"), F.lit(way).alias("change"), none) for h, way in ((hours, 1), (hours + look_back_hours, -1))]
        p = points.where(mine).select("source", F.inline(F.array(*ways)))
        t = targets.where(mine).select("source", F.col("ts").alias("at"), F.lit(True).alias("target"), F.lit(0).alias("change"), "key")
        # entries lie up to lag + look-back behind the row they are of; from there on the delay is that of the pairs
        return p.unionByName(t).withWatermark("at", f"{hours + look_back_hours + max(1, hours)} hours")

    every = reduce(DataFrame.unionByName, [of(s, h) for s, h in lag_hours.items()])
    g = every.groupBy("source", F.window("at", pane).alias("pane")).agg(F.sum("change").alias("net"), F.collect_list(F.struct("at", "target", "change", "key")).alias("all"))

    def places(keep):
        """The targets in order, each with its place among them and the entries kept. At one time points precede targets."""
        ordered = F.sort_array(F.filter("all", lambda x: keep(x["change"])))
        return F.filter(F.transform(ordered, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: y["x"]["target"])

    came, went = places(lambda c: c >= 0), places(lambda c: c <= 0)
    seen = F.zip_with(came, went, lambda a, b: F.struct(a["x"]["key"].alias("key"), a["x"]["at"].alias("ts"), (a["i"] - b["i"]).alias("net")))
    return g.select("source", F.col("pane.start").alias("pane"), "net", seen.alias("seen"))


def visible_counts(panes: DataFrame) -> DataFrame:
    """(source, key, ts, visible) per target from what `visible_panes` has written: the net within its pane on top of that of all panes
    before, of which a source has as many as its calendar."""
    before = Window.partitionBy("source").orderBy("pane").rowsBetween(Window.unboundedPreceding, -1)
    carry = panes.select("source", "pane", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("carry"))
    rows = panes.where(F.size("seen") > 0).select("source", "pane", F.inline("seen"))
    return rows.join(carry, ["source", "pane"]).select("source", "key", "ts", (F.col("carry") + F.col("net")).alias("visible"))


WATERMARKS = "spark.sql.streaming.multipleWatermarkPolicy"


@contextmanager
def newest_decides(spark: SparkSession):
    """Queries started inside move on with the newest of their watermarks; the caller's setting comes back."""
    before = spark.conf.get(WATERMARKS, "min")
    spark.conf.set(WATERMARKS, "max")
    try:
        yield
    finally:
        spark.conf.set(WATERMARKS, before)


def refresh(spark: SparkSession, landing: str, table: str, audit: str, checkpoint: str, schema: T.StructType, files_per_trigger: int = 4) -> None:
    """Append exactly the missing rows of the serving table from what has landed, with an audit line per batch. A batch
    that is replayed finds its keys present and appends nothing; of rows with one key the least one counts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in ("series_id", "ds")]
        rows = batch.groupBy("series_id", "ds").agg(F.min(F.struct(*rest)).alias("_r")).select("series_id", "ds", "_r.*").select(*batch.columns)
        n = sinks.insert_or_ignore(batch.sparkSession, table, rows)
        line = batch.sparkSession.createDataFrame([(batch_id, n)], "batch long, appended long")
        line.withColumn("loaded_at", F.current_timestamp()).write.mode("append").parquet(audit)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(landing)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
