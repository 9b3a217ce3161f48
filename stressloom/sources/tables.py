"""Derived tables: daily panel, snapshots, raw points, peg history, headlines.

Raw rows are reduced to one row per (series_id, ds) by a partial aggregation before anything is ordered, so
a series never holds more rows than there are calendar days, however hot its key is in the raw data. All
per-series windows in this package rely on that bound. Sums are kept as integers, which makes every daily
value independent of partitioning.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stressloom.functions import scoring as fn
from stressloom.session import scratch_path, stored


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(c: str, scale: int = 1) -> Column:
    """Nearest integer of a non-negative column as bigint. Plain arithmetic: the built-in round goes through decimals."""
    return F.floor(F.col(c) * F.lit(float(scale)) + F.lit(0.5))


Ranges = list[tuple[dt.date, dt.date]]


def within(stamp: str, ranges: Ranges) -> Column:
    """Whether a raw timestamp lies on a day of the ranges (ends included), as comparisons that reach the scan."""
    bounds = [(F.col(stamp) >= F.lit(a).cast("timestamp_ntz")) & (F.col(stamp) < F.lit(b + dt.timedelta(days=1)).cast("timestamp_ntz")) for a, b in ranges]
    return reduce(lambda x, y: x | y, bounds, F.lit(False))


def day_ranges(days: DataFrame, most: int = 64) -> Ranges:
    """The months of the days (ds) as ranges of whole months, neighbours merged; the span of all where there are more than `most`. Only
    distinct months leave the table: as many as its calendar has."""
    months = sorted(r["m"] for r in days.where(F.col("ds").isNotNull()).select(F.trunc("ds", "month").alias("m")).distinct().collect())
    out: Ranges = []
    for m in months:
        last = (m + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)
        if out and out[-1][1] + dt.timedelta(days=1) == m:
            out[-1] = (out[-1][0], last)
        else:
            out.append((m, last))
    return out if len(out) <= most else [(out[0][0], out[-1][1])]


def daily_sums(spark: SparkSession, sf_dir: str, ranges: Ranges | None = None) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    li = (li if ranges is None else li.where(within("l_shipdate", ranges))).select(
        "l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", F.col("l_shipdate").cast("date").alias("ds")
    )
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("series_id"), "ds")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(whole("l_quantity")).alias("q"),
            F.sum(whole("l_discount", 100)).alias("d"),
            F.sum(whole("l_tax", 100)).alias("t"),
            F.count_if(F.col("l_returnflag") == "R").alias("r"),
        )
    )


def channels_from_sums(sums: DataFrame) -> DataFrame:
    n = F.col("n").cast("double")
    out = sums.select(
        "series_id",
        "ds",
        (F.col("q") / n * 2.0).alias("stablecoin_risk"),
        (F.col("d") / n * 10.0).alias("defi_liquidity_risk"),
        (F.col("t") / n * 12.5).alias("contagion_risk"),
        (F.col("r") / n * 100.0).alias("arbitrage_opacity"),
    )
    return out.withColumn("idx", fn.composite())


def panel(spark: SparkSession, sf_dir: str, ranges: Ranges | None = None) -> DataFrame:
    """Daily channels and composite per market segment, of all days or of those of the ranges."""
    return channels_from_sums(daily_sums(spark, sf_dir, ranges))


def stored_panel(spark: SparkSession, sf_dir: str, ranges: Ranges | None = None) -> DataFrame:
    """The panel written once: the raw tables are then scanned and joined once, however many branches read it."""
    return stored(panel(spark, sf_dir, ranges), "panel")


def snapshot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as a table of monthly snapshots, partitioned by as_of (yyyy-MM)."""
    p = panel(spark, sf_dir).select("series_id", "ds", "idx", F.date_format("ds", "yyyy-MM").alias("as_of"))
    path = scratch_path(spark, "snapshots")
    p.repartition("as_of").write.partitionBy("as_of").parquet(path)
    return spark.read.schema(p.schema).parquet(path)


def panel_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The all-segments series, re-aggregated from the segment sums."""
    total = (
        daily_sums(spark, sf_dir)
        .groupBy("ds")
        .agg(*[F.sum(c).alias(c) for c in "nqdtr"])
        .withColumn("series_id", F.lit("ALL"))
    )
    return channels_from_sums(total)


EVENTS = [  # name, date, expected band, key channels
    ("E1", dt.date(1996, 5, 12), "critical", ["stablecoin_risk", "defi_liquidity_risk"]),
    ("E2", dt.date(1997, 6, 17), "high", ["contagion_risk", "defi_liquidity_risk"]),
    ("E3", dt.date(1998, 11, 11), "critical", ["contagion_risk", "arbitrage_opacity"]),
    ("E4", dt.date(2000, 3, 11), "elevated", ["stablecoin_risk", "contagion_risk"]),
]
OVERLAP_EVENT = ("E5", dt.date(1998, 12, 1), "high", ["contagion_risk"])


def events_dim(spark: SparkSession, overlap: bool = False) -> DataFrame:
    """The event table is an input: a literal here, any DataFrame of this shape elsewhere."""
    rows = EVENTS + ([OVERLAP_EVENT] if overlap else [])
    schema = T.StructType(
        [
            T.StructField("event", T.StringType()),
            T.StructField("event_date", T.DateType()),
            T.StructField("expected_level", T.StringType()),
            T.StructField("key_channels", T.ArrayType(T.StringType())),
        ]
    )
    return spark.createDataFrame(rows, schema)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw intraday points: (source, key, ts, value). NTZ timestamps become UTC instants."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id"),
        F.col("event_type").alias("source"),
        F.col("user_id").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value"),
        "props",
    )


def coins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    cents = whole("p_retailprice", 100)
    return (
        p.groupBy(F.col("p_brand").alias("symbol"))
        .agg(
            F.sum(cents * F.col("p_size")).alias("cents"),
            F.sum("p_size").alias("sz"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            "symbol",
            (F.col("cents").cast("double") / 100.0).alias("circulating"),
            (F.lit(1.0) + (F.col("sz") / F.col("n").cast("double") - 25.0) / 1000.0).alias("price"),
        )
        .withColumn("peg_deviation", F.abs(F.lit(1.0) - F.col("price")))
    )


CATEGORIES = ["Lending", "RWA", "Dexes", "Bridge"]


def protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    cat = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("s_nationkey") % 4 + 1).cast("int"))
    k = F.col("s_suppkey") % 5
    return s.select(
        F.col("s_suppkey").alias("protocol_id"),
        cat.alias("category"),
        F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("tvl"),
        F.when(k == 0, F.lit("2")).when(k == 1, F.lit("0")).when(k == 2, F.lit("yes")).when(k == 3, F.lit("")).alias("audits"),
        F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal") / 1000.0).alias("change_1d"),
    )


def supplier_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue in whole cents per supplier and month: many rows reduced map-side to one per pair."""
    li = read(spark, sf_dir, "lineitem")
    return (
        li.groupBy(F.col("l_suppkey").alias("supplier"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"))
        .agg(F.sum(whole("l_extendedprice", 100)).alias("cents"))
    )


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per day, in whole currency units; the macro-like observation series."""
    o = read(spark, sf_dir, "orders")
    return (
        o.groupBy(F.col("o_orderdate").cast("date").alias("ds"))
        .agg(F.sum(whole("o_totalprice", 100)).alias("cents"), F.count(F.lit(1)).alias("n"))
        .select("ds", (F.col("cents") / 100.0).alias("tvl"), "n")
    )


def segment_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per market segment and day: (series_id, ds, value)."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("ds"), whole("o_totalprice", 100).alias("cents"))
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("series_id"))
    sums = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("series_id", "ds").agg(F.sum("cents").alias("cents"))
    return sums.select("series_id", "ds", (F.col("cents") / 100.0).alias("value"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro observations as text, '.' marking a missing value on every seventh day."""
    d = daily_orders(spark, sf_dir)
    day = F.datediff(F.col("ds"), F.lit("1970-01-01").cast("date"))
    rate = F.round(F.lit(2.0) + F.col("n") % 40 / 10.0, 1)
    return d.select(
        F.lit("treasury_10y").alias("indicator"),
        "ds",
        F.when(day % 7 == 0, F.lit(".")).otherwise(rate.cast("string")).alias("value"),
    )


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An external daily gauge of 0 to 100, high when calm: the share of orders that are not urgent."""
    o = read(spark, sf_dir, "orders")
    urgent = F.count_if(F.col("o_orderpriority") == "1-URGENT")
    return o.groupBy(F.col("o_orderdate").cast("date").alias("ds")).agg((100.0 * (1.0 - urgent / F.count(F.lit(1)))).alias("sentiment"))


def peg_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday price points per symbol, scaled around 1."""
    e = points(spark, sf_dir).filter(F.col("value").isNotNull())
    return e.select(
        F.concat(F.lit("K"), (F.col("key") % 10).cast("string")).alias("symbol"),
        "ts",
        (F.lit(1.0) + (F.round(F.col("value") * 100) % 100 - 50) / 1000.0).alias("price"),
    )


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline rows from documents, whole texts; sentiment is fixed arithmetic on the id."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.col("text").alias("title"),
        "source",
        "lang",
        ((F.col("doc_id") * 37 % 201 - 100) / 100.0).alias("sentiment"),
    )
