"""Readers and parsers of landed data: series files, JSON payloads, headlines, pinned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stressloom import schema as S
from stressloom.functions import scoring as fn


def series_from(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Normalise the date column; order is a property of queries, never of files."""
    return df.withColumn("ds", F.to_date(date_col)).drop(date_col) if date_col != "ds" else df


def read_series_parquet(spark: SparkSession, path: str, date_col: str = "date") -> DataFrame:
    return series_from(spark.read.parquet(path), date_col)


def read_series_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def parse_csv_lines(df: DataFrame, line: str, ddl: str) -> DataFrame:
    return df.select(F.from_csv(line, ddl).alias("_r")).select("_r.*")


def parse_observations(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """'.', '' and null mean missing."""
    o = df.select(*keep, F.explode(F.from_json(payload, S.OBSERVATIONS_JSON).getField("observations")).alias("_o"))
    return o.select(*keep, F.to_date("_o.date").alias("ds"), F.col("_o.value").try_cast("double").alias("value"))


def parse_tvl(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    o = df.select(*keep, F.explode(F.from_json(payload, S.TVL_JSON)).alias("_o"))
    return o.select(*keep, F.timestamp_seconds(F.col("_o.date")).alias("ts"), F.col("_o.tvl").alias("tvl"))


def latest_tvl(points: DataFrame, keep: list[str]) -> DataFrame:
    return points.groupBy(*keep).agg(F.coalesce(F.max_by("tvl", "ts"), F.lit(0.0)).alias("tvl"))


def parse_pegged(df: DataFrame, payload: str) -> DataFrame:
    """Nested coin rows: supply defaults to 0, an unreadable price to 1; the mechanism hint wins over the peg type."""
    a = df.select(F.inline(F.from_json(payload, S.PEGGED_JSON).getField("peggedAssets")))
    price = F.coalesce(F.col("price").try_cast("double"), F.lit(1.0))
    return a.select(
        "name", "symbol", F.coalesce(F.col("circulating.peggedUSD"), F.lit(0.0)).alias("circulating"), price.alias("price"),
        F.abs(1.0 - price).alias("peg_deviation"), F.coalesce("pegMechanism", "pegType").alias("peg_type"))


def parse_protocols(df: DataFrame, payload: str) -> DataFrame:
    return df.select(F.inline(F.from_json(payload, S.PROTOCOLS_JSON)))


def parse_chart_prices(df: DataFrame, payload: str) -> DataFrame:
    """Price chunks per coin; the first point of a timestamp, in chunk order, is kept."""
    m = df.select("chunk", F.explode(F.from_json(payload, S.PRICES_JSON).getField("coins")).alias("coin", "body"))
    p = m.select("coin", "chunk", F.inline("body.prices"))
    return p.groupBy("coin", "timestamp").agg(F.min_by("price", "chunk").alias("price")).select(
        "coin", F.timestamp_seconds("timestamp").alias("ts"), "price")


def first_titles(df: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """First row of each exact non-empty title by `order`, which is unique. Titles may be whole texts, so they are grouped by a
    digest: the minimum of each is taken map-side, and a title that is repeated very often is one narrow row per task before the
    shuffle. The rows are then fetched by `order`."""
    first = df.filter(F.length("title") > 0).groupBy(F.sha2("title", 256).alias("_digest")).agg(F.min(order).alias(order))
    first = first if limit is None else first.orderBy(order).limit(limit)
    return df.join(first.select(order), order, "left_semi")


def published_at(text: str, fallback: Column) -> Column:
    return F.coalesce(fn.parse_when(text), fallback)


def pinned_snapshot(df: DataFrame, as_of: str | None) -> DataFrame:
    """Rows of the pinned as_of, or of the last one when it is absent. On a table partitioned by as_of the scalar
    subquery prunes partitions."""
    last = df.groupBy().agg(
        F.coalesce(F.max(F.when(F.col("as_of") == F.lit(as_of), F.col("as_of"))), F.max("as_of")).alias("as_of"))
    return df.where(F.col("as_of") == last.scalar())


def frozen_else(frozen: DataFrame, other: DataFrame, keys: list[str], value: str, source: str) -> DataFrame:
    """Frozen value where present, otherwise the other source; which one is recorded."""
    f, o = frozen.select(*keys, F.col(value).alias("_f")), other.select(*keys, F.col(value).alias("_o"))
    j = o.join(f, keys, "left")
    used = F.when(F.col("_f").isNotNull(), F.lit("frozen")).otherwise(F.lit("live"))
    return j.select(*keys, F.coalesce("_f", "_o").alias(value), F.map_from_arrays(F.array(F.lit(source)), F.array(used)).alias("data_quality"))
