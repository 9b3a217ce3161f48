"""Point-in-time rows: every source looked up as of each target date of each series, in one pass, with a quality note each.

Targets and the observations of all sources are stacked with a tag and ordered inside (series, month), where one window carries the last
and the next observation of every tag. What a month needs from its neighbours is one row per month and tag, carried over a window as
long as the number of months. So rows are ordered once, however many sources there are. Sources that have no series are looked up for the
distinct target dates, and joined by date.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stressloom.operators.windows import day_range


@dataclass(frozen=True)
class Source:
    """One source of a snapshot: rows (series_id, ds, value), and how it is looked up.

    mode: `nearest` (the earlier of two equally far ones), `backward` (last one published), `exact` (of the target date alone).
    lag_days: an observation is published so many days after its date. longest: an older one (or, for nearest, a farther one) does not
    count. default: the value where none is found. common: the rows (ds, value) hold for every series."""

    rows: DataFrame
    mode: str = "backward"
    lag_days: int = 0
    longest: int | None = None
    default: float | None = None
    common: bool = False


def snapshot(targets: DataFrame, sources: dict[str, Source]) -> DataFrame:
    """targets (series_id, ds) with, for every source, its value, the days to the observation (`<name>_age`, negative for a later one) and
    `<name>_quality`: exact, nearest or carried, default, or missing. Null values of a source are passed over; of rows of one day the
    greatest value counts."""
    common = {name: replace(s, rows=s.rows.withColumn("series_id", F.lit("")), common=False) for name, s in sources.items() if s.common}
    if common:
        own = {name: s for name, s in sources.items() if not s.common}
        dates = targets.select(F.lit("").alias("series_id"), "ds").distinct()
        return (snapshot(targets, own) if own else targets.select("series_id", "ds")).join(snapshot(dates, common).drop("series_id"), "ds")
    names = list(sources)
    for name, s in sources.items():
        if s.mode not in ("nearest", "backward", "exact"):
            raise ValueError(f"mode of {name} must be nearest, backward or exact, not {s.mode}")
    rows = targets.select("series_id", "ds", F.lit(-1).alias("tag"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("date").alias("of"))
    for i, name in enumerate(names):
        s = sources[name]
        seen = s.rows.select("series_id", F.date_add("ds", s.lag_days).alias("at"), F.col("value").cast("double").alias("value"), F.col("ds").alias("of"))
        seen = seen.where(F.col("value").isNotNull() & F.col("of").isNotNull())
        seen = seen.groupBy("series_id", "at", "of").agg(F.max("value").alias("value"))  # one row a day
        rows = rows.unionByName(seen.select("series_id", F.col("at").alias("ds"), F.lit(i).alias("tag"), "value", "of"))
    rows = rows.withColumn("month", F.trunc("ds", "month"))
    # observations of a day stand before the targets of the day
    w = Window.partitionBy("series_id", "month").orderBy("ds", (F.col("tag") < 0).cast("int"))
    seen = lambda i: F.when(F.col("tag") == i, F.struct("ds", "value", "of"))
    here = rows.select(
        "series_id", "month", "ds", "tag",
        *[F.last(seen(i), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"p{i}") for i in range(len(names))],
        *[F.first(seen(i), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias(f"n{i}") for i in range(len(names))],
    ).where("tag < 0")
    last = lambda i: F.max_by(seen(i), F.when(F.col("tag") == i, F.col("ds"))).alias(f"l{i}")
    first = lambda i: F.min_by(seen(i), F.when(F.col("tag") == i, F.col("ds"))).alias(f"f{i}")
    months = rows.groupBy("series_id", "month").agg(*[x for i in range(len(names)) for x in (last(i), first(i))])
    m = Window.partitionBy("series_id").orderBy("month")
    carried = months.select(
        "series_id", "month",
        *[F.last(f"l{i}", ignorenulls=True).over(m.rowsBetween(Window.unboundedPreceding, -1)).alias(f"cl{i}") for i in range(len(names))],
        *[F.first(f"f{i}", ignorenulls=True).over(m.rowsBetween(1, Window.unboundedFollowing)).alias(f"cf{i}") for i in range(len(names))])
    out = here.join(carried, ["series_id", "month"])
    columns = []
    for i, name in enumerate(names):
        s = sources[name]
        before, after = F.coalesce(f"p{i}", f"cl{i}"), F.coalesce(f"n{i}", f"cf{i}")
        pick = before
        if s.mode == "nearest":
            pick = F.when(after.isNull() | (F.datediff("ds", before["ds"]) <= F.datediff(after["ds"], "ds")), before).otherwise(after)
        age = F.datediff("ds", pick["of"])
        far = F.lit(False) if s.longest is None else F.abs(age) > s.longest
        if s.mode == "exact":
            far = far | (age != 0)
        hit = F.when(~far, pick)
        hit = F.when(hit["value"].isNotNull(), hit)
        exact = F.datediff("ds", hit["of"]) == s.lag_days
        note = F.when(hit.isNull(), F.lit("missing" if s.default is None else "default")).when(exact, "exact").otherwise("nearest" if s.mode == "nearest" else "carried")
        columns += [F.coalesce(hit["value"], F.lit(s.default).cast("double")).alias(name), F.datediff("ds", hit["of"]).alias(f"{name}_age"), note.alias(f"{name}_quality")]
    return out.select("series_id", "ds", *columns)


def value_state(daily: DataFrame) -> DataFrame:
    """Per series and date: value, trailing 365-day peak and 30-day variation of the value history."""
    y, m = day_range(-365, 0), day_range(-29, 0)
    cv = F.stddev_pop("value").over(m) / F.avg("value").over(m)
    return daily.select("series_id", "ds", "value", F.max("value").over(y).alias("peak"), F.when(F.count("value").over(m) > 1, cv).alias("cv"))


def stepped(daily: DataFrame, step: int = 7) -> DataFrame:
    """Target dates of every series, `step` days apart over its span."""
    span = daily.groupBy("series_id").agg(F.min("ds").alias("_a"), F.max("ds").alias("_b"))
    return span.select("series_id", F.explode(F.sequence("_a", "_b", F.expr(f"interval {step} day"))).alias("ds"))


def with_notes(snapshots: DataFrame, names: list[str]) -> DataFrame:
    """The quality notes of all sources as one map."""
    return snapshots.withColumn("data_quality", F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"{n}_quality") for n in names])))
