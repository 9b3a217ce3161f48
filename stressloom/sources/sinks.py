"""Writers. Each separates the rows to write (a plain DataFrame, testable on its own) from the act of writing.

The serving table is partitioned by month: a refresh rewrites only the months it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stressloom.functions import scoring as fn
from stressloom.operators.windows import by_day, last_rows


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("ds", "yyyy-MM"))


def write_new(df: DataFrame, path: str, frozen: tuple[str, ...] = (), fmt: str = "parquet") -> str:
    """Write to a path that must not exist; a frozen path is redirected to a generated name next to it."""
    target = path.rstrip("/") + "_regenerated" if path in frozen else path
    df.write.mode("errorifexists").format(fmt).save(target)
    return target


def newer_rows(existing: DataFrame, new: DataFrame, keys=("series_id",)) -> DataFrame:
    """Rows after the stored maximum date of their key."""
    top = existing.groupBy(*keys).agg(F.max("ds").alias("_max"))
    return new.join(top, list(keys), "left").filter(F.col("_max").isNull() | (F.col("ds") > F.col("_max"))).drop("_max")


def missing_rows(existing: DataFrame, new: DataFrame, keys=("series_id", "ds")) -> DataFrame:
    return new.join(existing.select(*keys), list(keys), "left_anti")


def append_csv(spark: SparkSession, existing: DataFrame, new: DataFrame, path: str) -> None:
    newer_rows(existing, new).withColumn("loaded_at", F.current_timestamp()).write.mode("append").csv(path, header=True)


def insert_or_ignore(spark: SparkSession, table: str, new: DataFrame) -> int:
    """Append rows whose key is absent; returns how many, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    new = with_month(new)
    touched = spark.read.parquet(table).join(new.select("month").distinct(), "month", "left_semi")  # prunes partitions
    rows = missing_rows(touched, new).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.mode("append").partitionBy("month").parquet(table)
    return seen.get["n"]


def upserted(existing: DataFrame, new: DataFrame, keys=("series_id", "ds")) -> DataFrame:
    """New rows win over stored ones with the same key."""
    kept = existing.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new)


def daily_record(series: DataFrame) -> DataFrame:
    """Serving columns: 30-row average, trend against the previous value, alert band."""
    s = series.withColumn("avg_30", F.avg("idx").over(last_rows(30)))
    return s.withColumn("trend", fn.trend_vs_previous("idx", F.lag("idx").over(by_day()))).withColumn("alert_level", fn.alert_four("idx"))


def upsert(spark: SparkSession, table: str, new: DataFrame) -> None:
    """Rewrite only the months that receive rows. The read side is limited to those months by a semi join, which
    prunes partitions; the result is staged before the overwrite because source and target are the same table."""
    new = with_month(new)
    touched = spark.read.parquet(table).join(new.select("month").distinct(), "month", "left_semi")
    _rewrite(spark, table, upserted(touched, new))


def replaced_range(existing: DataFrame, new: DataFrame, start: str, end: str, clear: bool) -> DataFrame:
    """Stored rows, optionally without [start, end], plus the new rows of the range that are absent."""
    inside = F.col("ds").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    kept = existing.filter(~inside) if clear else existing
    return kept.unionByName(missing_rows(kept, new.filter(inside)))


def replace_range(spark: SparkSession, table: str, new: DataFrame, start: str, end: str, clear: bool) -> None:
    """Rewrite the months of [start, end] by `replaced_range`. A month that ends up empty is removed."""
    months = F.col("month").between(start[:7], end[:7])
    stored = spark.read.parquet(table).filter(months)
    before = {r["month"] for r in stored.select("month").distinct().collect()}  # the months of the range
    after = {r["month"] for r in _rewrite(spark, table, replaced_range(stored, with_month(new).filter(months), start, end, clear)).select("month").distinct().collect()}
    for month in before - after:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/month={month}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _rewrite(spark: SparkSession, table: str, rows: DataFrame) -> DataFrame:
    """Overwrite the months of the rows, staged first because they are read from the same table; returns the staged rows."""
    from stressloom.session import scratch_path

    stage = scratch_path(spark, "stage")
    rows.write.parquet(stage)
    staged = spark.read.schema(rows.schema).parquet(stage)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(table)
    return staged


def reconciled(stored: DataFrame) -> DataFrame:
    """Recompute index, 30-row average, alert and trend from the stored channels; rows that differ."""
    r = stored.withColumn("new_idx", F.round(F.round(fn.composite(), 6), 1))
    r = r.withColumn("new_avg", F.round(F.round(F.avg("new_idx").over(last_rows(30)), 6), 1))
    r = r.withColumn("new_alert", fn.alert_four("new_idx")).withColumn("new_trend", fn.trend_vs_avg("new_idx", "new_avg"))
    same = F.col("idx").eqNullSafe(F.col("new_idx")) & F.col("avg_30").eqNullSafe(F.col("new_avg")) & \
        F.col("alert_level").eqNullSafe(F.col("new_alert")) & F.col("trend").eqNullSafe(F.col("new_trend"))
    return r.filter(~same)


def export_range(df: DataFrame, start: str, end: str, fmt: str, path: str) -> None:
    if fmt not in ("json", "csv", "parquet"):
        raise ValueError(f"format must be json, csv or parquet, not {fmt}")
    w = df.filter(F.col("ds").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).write.mode("errorifexists")
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)
