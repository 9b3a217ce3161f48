"""Queries over streaming jobs: the tables are landed as day files, streamed with availableNow, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from stressloom import schema as S
from stressloom.plans.composition import fixed_model
from stressloom.plans.joins import LAG_SOURCE
from stressloom.plans.registry import query
from stressloom.plans.sqltext import PANEL, W
from stressloom.plans.windowing import EWMA, PROD
from stressloom.session import scratch_path
from stressloom.sources import sinks
from stressloom.sources import tables as tb
from stressloom.streaming import jobs, state


def landed_points(spark, d, duplicates: bool = False, horizon_row: bool = True, marked: tuple[str, ...] = ("flush",)):
    """Points landed by day in two writes, the later days last, and the number of files of the first: a stream that takes so
    many at a time runs in several batches. Every tenth row arrives again when duplicates are asked for. A marker row (key -1)
    far ahead, one for each source in `marked`, closes the last windows."""
    path = scratch_path(spark, "points")
    p = tb.points(spark, d).select("event_id", "source", "key", "ts", "value")
    day = F.to_date("ts")
    if duplicates:
        p = p.unionByName(p.filter(F.col("event_id") % 10 == 0))
    early = p.groupBy().agg(F.expr("timestamp_micros(bigint(avg(unix_micros(ts))))").alias("ts")).first()["ts"]
    spread = [F.col("day"), F.pmod(F.xxhash64("event_id"), F.lit(4))]  # a crowded day is several tasks and files
    p = p.withColumn("day", day)
    p.filter(F.col("day") <= F.lit(early).cast("date")).repartition(*spread).sortWithinPartitions("ts").write.partitionBy("day").parquet(path)
    n = max(1, len(spark.read.parquet(path).inputFiles()))
    p.filter(F.col("day") > F.lit(early).cast("date")).repartition(*spread).sortWithinPartitions("ts").write.mode("append").partitionBy("day").parquet(path)
    p = p.drop("day")
    if horizon_row:
        last = p.groupBy().agg(F.max("ts").alias("ts")).select(
            F.lit(-1).cast("bigint").alias("event_id"), F.explode(F.array(*map(F.lit, marked))).alias("source"), F.lit(-1).cast("bigint").alias("key"),
            (F.col("ts") + F.expr("interval 60 days")).alias("ts"), F.lit(None).cast("double").alias("value"), F.lit("2999-01-01").alias("day"))
        last.coalesce(1).write.mode("append").partitionBy("day").parquet(path)
    return path, n


def stream_points(spark, d, **kw):
    return jobs.read_points(spark, *landed_points(spark, d, **kw))


def collected(spark, df, mode="append"):
    out, ck = scratch_path(spark, "stream"), scratch_path(spark, "ck")
    jobs.run_available(df, out, ck, mode)
    return spark.read.schema(df.schema).parquet(out)


@query("str_daily_window", "mean", """
  SELECT event_type AS source, CAST(ts AS DATE) AS ds, count(value) AS n, avg(value) AS mean FROM events GROUP BY 1, 2""")
def str_daily_window(spark, d):
    return collected(spark, jobs.daily_bars(stream_points(spark, d))).filter("source <> 'flush'").drop("median")


@query("str_sliding_avg", "mean", """
  SELECT event_type AS source, CAST(CAST(ts AS DATE) + CAST(k AS INT) AS DATE) AS ds, count(value) AS n, avg(value) AS mean FROM events CROSS JOIN range(1, 31) r(k) GROUP BY 1, 2""")
def str_sliding_avg(spark, d):
    return collected(spark, jobs.sliding_average(stream_points(spark, d))).filter("source <> 'flush'")


@query("str_dedup", "", "SELECT event_type AS source, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def str_dedup(spark, d):
    s = jobs.deduplicated(stream_points(spark, d, duplicates=True, horizon_row=False), ["event_id"])
    return collected(spark, s).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


LAGS = {k: S.PUBLICATION_LAG_HOURS[s] for k, s in LAG_SOURCE.items()}


@query("str_late_data", "", f"""
  WITH lags(source, h) AS (VALUES {", ".join(f"('{k}', {h})" for k, h in LAGS.items())})
  SELECT source, count(*) AS rows, count(v) AS visible FROM (SELECT t.event_type AS source, t.event_id, p.ts AS v FROM events t JOIN lags ON t.event_type = source
    LEFT JOIN events p ON t.event_type = p.event_type AND p.ts <= t.ts - h * INTERVAL 1 HOUR AND p.ts > t.ts - (h + 24) * INTERVAL 1 HOUR) GROUP BY 1""")
def str_late_data(spark, d):
    path, n = landed_points(spark, d, marked=tuple(LAGS))
    t, p = jobs.read_points(spark, path, n), jobs.read_points(spark, path, n)
    with jobs.newest_decides(spark):
        v = jobs.visible_counts(collected(spark, jobs.visible_values(t, p, LAGS, counted=True))).filter("key <> -1")
    rows = F.greatest("visible", F.lit(1).cast("bigint"))  # a target that sees nothing is a row too
    return v.groupBy("source").agg(F.sum(rows).alias("rows"), F.sum("visible").alias("visible"))


def over_panel(spark, d, job):
    """The daily panel landed in three parts, a run of the job after each: it goes on from its checkpoint. Every fifth row is up to 20 days
    late, so the days around a border arrive out of order; a marker row far ahead releases the last ones."""
    land, out, ck = (scratch_path(spark, x) for x in ("panel", "stream", "ck"))
    p = tb.stored_panel(spark, d)
    slot = F.xxhash64("series_id", "ds")
    seen = F.date_add("ds", F.when(F.pmod(slot, F.lit(5)) == 0, F.pmod(slot, F.lit(21))).otherwise(0).cast("int"))
    marker = p.groupBy().agg(F.date_add(F.max("ds"), 400).alias("ds")).select(F.lit("flush").alias("series_id"), "ds", *[F.lit(None).cast("double").alias(c) for c in [*S.CHANNELS, "idx"]])
    bounds = ["0001-01-01", "1994-06-01", "1997-01-01", "9999-12-31"]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        part = p.where((seen >= F.lit(a).cast("date")) & (seen < F.lit(b).cast("date")))
        (part.unionByName(marker) if k == 2 else part).write.mode("append").parquet(land)
        df = job(spark.readStream.schema(p.schema).parquet(land))
        jobs.run_available(df, out, ck, keyed=True)
    return spark.read.schema(df.schema).parquet(out).filter("series_id <> 'flush'")


@query("str_alert_changes", "idx", W(PANEL, q="""
  SELECT series_id, ds, idx, p AS previous, b AS band, false AS late FROM (SELECT *, lag(b) OVER (PARTITION BY series_id ORDER BY ds) AS p FROM (
   SELECT series_id, ds, idx, CASE WHEN idx >= 70 THEN 'high' WHEN idx >= 50 THEN 'elevated' WHEN idx >= 30 THEN 'moderate' ELSE 'low' END AS b FROM panel)) WHERE p IS NULL OR p <> b"""))
def str_alert_changes(spark, d):
    return over_panel(spark, d, state.alert_changes)


@query("str_ewma_state", " ".join(f"c{i}{j}" for i, j in PROD), W(PANEL, EWMA, q="SELECT series_id, ds, " + ", ".join(f"c{i}{j}" for i, j in PROD) + ", false AS late FROM ewma"))
def str_ewma_state(spark, d):
    return over_panel(spark, d, state.ewma_state)


def _filter_check():
    from stressloom.plans.models import _filter_sql
    return f"SELECT *, false AS late FROM ({_filter_sql()})"


@query("str_filter_state", "p0 p1 p2", _filter_check())
def str_filter_state(spark, d):
    f = over_panel(spark, d, lambda panel: state.filter_state(panel, fixed_model()))
    return f.select("series_id", "ds", *[F.col("probs")[i].alias(f"p{i}") for i in range(3)], "late")


@query("str_refresh", "idx", W(PANEL, q="SELECT series_id, count(*) AS n, count(DISTINCT ds) AS days, sum(CASE WHEN ds < DATE '2000-01-01' THEN idx ELSE idx + 1 END) AS idx FROM panel GROUP BY 1"), digits=4)
def str_refresh(spark, d):
    """Stored rows up to 2000, all rows landed with another value: only the missing days may be added."""
    p = tb.panel(spark, d).select("series_id", "ds", "idx")
    table, landing = scratch_path(spark, "table"), scratch_path(spark, "landing")
    sinks.with_month(p.filter(F.col("ds") < F.lit("2000-01-01").cast("date"))).write.partitionBy("month").parquet(table)
    p.withColumn("idx", F.col("idx") + 1).repartition(4, "ds").write.parquet(landing)
    ck, audit = scratch_path(spark, "ck"), scratch_path(spark, "audit")
    jobs.refresh(spark, landing, table, audit, ck, p.schema, files_per_trigger=2)
    return spark.read.parquet(table).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ds").alias("days"), F.sum("idx").alias("idx"))
