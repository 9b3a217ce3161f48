"""Queries over sources, sinks, filters, sorts and set operations."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from stressloom.functions.stats import corr
from stressloom import schema as S
from stressloom.functions import scoring as fn
from stressloom.operators import align, channels as ch, eventjoin as ev, quality
from stressloom.operators import windows as win
from stressloom.plans.registry import query
from stressloom.plans.scalars import BAND4, PLAIN_TERMS, _hits
from stressloom.plans.sqltext import DAILY_ORDERS, EVENTS_DIM, HEADLINES, OBSERVATIONS, PANEL, PEG_POINTS, PROTOCOLS, COINS, W
from stressloom.session import scratch_path
from stressloom.sources import payloads as pl
from stressloom.sources import sinks
from stressloom.sources import tables as tb

CHS4 = "stablecoin_risk, defi_liquidity_risk, contagion_risk, arbitrage_opacity"
DBL = "idx " + " ".join(S.CHANNELS)


# ------------------------------------------------------------------ sources
@query("src_series_parquet", "tvl", W(DAILY_ORDERS, q="SELECT ds, tvl FROM daily_orders"), digits=2)
def src_series_parquet(spark, d):
    path = scratch_path(spark, "series")
    tb.daily_orders(spark, d).select(F.date_format("ds", "yyyy-MM-dd").alias("date"), "tvl").write.parquet(path)
    return pl.series_from(spark.read.schema("date string, tvl double").parquet(path))


@query("src_series_csv", "price", W(PEG_POINTS, q="SELECT CAST(ts AS DATE) AS ds, symbol, median(price) AS price FROM peg_points GROUP BY 1, 2"))
def src_series_csv(spark, d):
    from stressloom.operators.bars import daily_median
    path = scratch_path(spark, "series-csv")
    daily_median(tb.peg_points(spark, d)).select("ds", "symbol", "price").write.option("header", True).csv(path)
    return pl.read_series_csv(spark, path, "ds date, symbol string, price double")


@query("src_observations_json", "value", W(OBSERVATIONS, q="SELECT indicator, ds, TRY_CAST(value AS DOUBLE) AS value FROM observations"))
def src_observations_json(spark, d):
    o = tb.observations(spark, d).withColumn("month", F.trunc("ds", "month"))
    payload = o.groupBy("indicator", "month").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("ds").cast("string").alias("date"), "value")).alias("observations"))).alias("payload"))
    return pl.parse_observations(payload, "payload", ["indicator"])


@query("src_tvl_history", "tvl", W(DAILY_ORDERS, q="SELECT CAST(date_trunc('year', ds) AS DATE) AS year, arg_max(tvl, ds) AS tvl FROM daily_orders GROUP BY 1"), digits=2)
def src_tvl_history(spark, d):
    t = tb.daily_orders(spark, d).withColumn("year", F.trunc("ds", "year"))
    payload = t.groupBy("year").agg(F.to_json(F.collect_list(F.struct(F.unix_timestamp(F.col("ds").cast("timestamp")).alias("date"), "tvl"))).alias("payload"))
    return pl.latest_tvl(pl.parse_tvl(payload, "payload", ["year"]), ["year"])


@query("src_universe_json", "tvl change_1d", W(PROTOCOLS, q="SELECT protocol_id AS name, tvl, category, audits, change_1d FROM protocols"))
def src_universe_json(spark, d):
    p = tb.protocols(spark, d)
    part = F.floor(F.col("protocol_id") / 500)
    payload = p.groupBy(part.alias("chunk")).agg(F.to_json(F.collect_list(F.struct(
        F.col("protocol_id").cast("string").alias("name"), "tvl", "category", "audits", "change_1d"))).alias("payload"))
    return pl.parse_protocols(payload, "payload").withColumn("name", F.col("name").cast("bigint"))


@query("src_pegged_assets_json", "circulating price peg_deviation", W(COINS, q="""
  SELECT symbol, circulating, CASE WHEN symbol LIKE '%5' THEN 1.0 ELSE price END AS price, CASE WHEN symbol LIKE '%5' THEN 0.0 ELSE peg_deviation END AS peg_deviation,
   CASE WHEN symbol LIKE '%1%' THEN 'algorithmic' ELSE 'peggedUSD' END AS peg_type FROM coins"""))
def src_pegged_assets_json(spark, d):
    c = tb.coins(spark, d)
    row = F.struct(
        F.col("symbol").alias("name"), "symbol", F.lit("peggedUSD").alias("pegType"), F.when(F.col("symbol").contains("1"), "algorithmic").alias("pegMechanism"),
        F.struct(F.col("circulating").alias("peggedUSD")).alias("circulating"), F.when(F.col("symbol").endswith("5"), "n/a").otherwise(F.col("price").cast("string")).alias("price"))
    payload = c.select(F.to_json(F.struct(F.array(row).alias("peggedAssets"))).alias("payload"))
    return pl.parse_pegged(payload, "payload").drop("name")


@query("src_chart_prices_json", "price", """
  SELECT coin, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS at, arg_min(value, event_id) AS price FROM (
   SELECT 'K' || CAST(user_id % 10 AS VARCHAR) AS coin, ts, value, event_id FROM events WHERE value IS NOT NULL) GROUP BY 1, 2""")
def src_chart_prices_json(spark, d):
    p = tb.points(spark, d).filter(F.col("value").isNotNull())
    coin = F.concat(F.lit("K"), (F.col("key") % 10).cast("string"))
    body = F.struct(F.array(F.struct(F.unix_timestamp("ts").alias("timestamp"), F.col("value").alias("price"))).alias("prices"))
    payload = p.select(F.col("event_id").alias("chunk"), F.to_json(F.struct(F.create_map(coin, body).alias("coins"))).alias("payload"))
    return pl.parse_chart_prices(payload, "payload").select("coin", F.unix_timestamp("ts").alias("at"), "price")


NEWS = HEADLINES + """,
firsts AS (SELECT title, min(doc_id) AS doc_id FROM headlines WHERE length(title) > 0 GROUP BY 1)"""


@query("src_news_items", "sentiment", W(NEWS, q="""
  SELECT doc_id, title, source, sentiment, CASE WHEN doc_id % 3 = 2 THEN DATE '2024-06-01' ELSE CAST(DATE '2024-01-01' + CAST(doc_id % 100 AS INT) AS DATE) END AS published
  FROM headlines JOIN firsts USING (doc_id, title) ORDER BY doc_id LIMIT 50"""))
def src_news_items(spark, d):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 100).cast("int")).cast("timestamp")
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.date_format(day, "'Mon, 'dd MMM yyyy HH:mm:ss 'GMT'")).when(k == 1, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    h = tb.headlines(spark, d).select("doc_id", "title", "source", "sentiment", text.alias("when"))
    t = pl.first_titles(h, "doc_id", limit=50)
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return t.select("doc_id", "title", "source", "sentiment", pl.published_at("when", now).cast("date").alias("published"))


@query("src_snapshot_as_of", "idx", W(PANEL, q="""
  SELECT series_id, ds, idx, strftime(ds, '%Y-%m') AS as_of, 'pinned' AS mode FROM panel WHERE strftime(ds, '%Y-%m') = '1999-03'
  UNION ALL SELECT series_id, ds, idx, strftime(ds, '%Y-%m'), 'last' FROM panel WHERE strftime(ds, '%Y-%m') = (SELECT max(strftime(ds, '%Y-%m')) FROM panel)"""))
def src_snapshot_as_of(spark, d):
    p = tb.snapshot_table(spark, d)
    return pl.pinned_snapshot(p, "1999-03").withColumn("mode", F.lit("pinned")).unionByName(
        pl.pinned_snapshot(p, "2050-01").withColumn("mode", F.lit("last")))


@query("src_frozen_else_default", "idx", W(PANEL, q="""
  SELECT series_id, ds, CASE WHEN ds < DATE '1998-01-01' THEN idx + 1 ELSE idx END AS idx, CASE WHEN ds < DATE '1998-01-01' THEN 'frozen' ELSE 'live' END AS used FROM panel"""))
def src_frozen_else_default(spark, d):
    p = tb.panel(spark, d).select("series_id", "ds", "idx")
    frozen = p.filter(F.col("ds") < F.lit("1998-01-01").cast("date")).withColumn("idx", F.col("idx") + 1)
    j = pl.frozen_else(frozen, p, ["series_id", "ds"], "idx", "index")
    return j.select("series_id", "ds", "idx", F.col("data_quality")["index"].alias("used"))


def serving(spark, d):
    return sinks.with_month(sinks.daily_record(tb.panel(spark, d)))


@query("src_serving_table", "idx avg_30", W(PANEL, q=f"""
  SELECT series_id, strftime(ds, '%Y-%m') AS month, count(*) AS n, count(DISTINCT ds) AS days, avg(idx) AS idx, avg(a) AS avg_30 FROM (
   SELECT *, avg(idx) OVER (PARTITION BY series_id ORDER BY ds ROWS 29 PRECEDING) AS a FROM panel) GROUP BY 1, 2"""))
def src_serving_table(spark, d):
    path = scratch_path(spark, "serving")
    serving(spark, d).write.partitionBy("month").parquet(path)
    t = spark.read.parquet(path)
    return t.groupBy("series_id", "month").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ds").alias("days"), F.avg("idx").alias("idx"), F.avg("avg_30").alias("avg_30"))


@query("src_raw_landing", "", """SELECT event_type AS source, CAST(ts AS DATE) AS fetch_date, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1, 2""")
def src_raw_landing(spark, d):
    raw = tb.points(spark, d).select("source", F.to_date("ts").alias("fetch_date"), F.col("props").alias("payload"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    path = scratch_path(spark, "landing")
    raw.repartition("source", "fetch_date", F.pmod(F.xxhash64("payload"), F.lit(8))).write.partitionBy("source", "fetch_date").parquet(path)
    k = F.from_json("payload", "k bigint").getField("k")
    return spark.read.parquet(path).groupBy("source", "fetch_date").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"))


# -------------------------------------------------------------------- sinks
def _table(spark, rows):
    path = scratch_path(spark, "table")
    sinks.with_month(rows).write.partitionBy("month").parquet(path)
    return path


def _halves(spark, d):
    p = tb.stored_panel(spark, d)
    cut = F.lit("2001-01-01").cast("date")
    return p, p.filter(F.col("ds") < cut), cut


@query("sink_parquet_guarded", "idx", W(PANEL, q="SELECT series_id, count(*) AS n, sum(idx) AS idx FROM panel GROUP BY 1"), digits=4)
def sink_parquet_guarded(spark, d):
    path = scratch_path(spark, "frozen")
    target = sinks.write_new(tb.panel(spark, d), path, frozen=(path,))
    return spark.read.parquet(target).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx"))


@query("sink_append_csv", "idx", W(PANEL, q="SELECT series_id, count(*) AS n, sum(idx) AS idx FROM panel WHERE ds > DATE '2000-12-31' GROUP BY 1"), digits=4)
def sink_append_csv(spark, d):
    p, old, cut = _halves(spark, d)
    path = scratch_path(spark, "audit")
    sinks.append_csv(spark, old, p.select("series_id", "ds", "idx"), path)
    t = pl.read_series_csv(spark, path, "series_id string, ds date, idx double, loaded_at timestamp")
    return t.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx"))


@query("sink_insert_or_ignore", "idx", W(PANEL, q="SELECT series_id, ds, CASE WHEN ds < DATE '2001-01-01' THEN idx ELSE idx + 1 END AS idx FROM panel"))
def sink_insert_or_ignore(spark, d):
    p, old, _ = _halves(spark, d)
    table = _table(spark, old)
    sinks.insert_or_ignore(spark, table, p.withColumn("idx", F.col("idx") + 1))
    return spark.read.parquet(table).select("series_id", "ds", "idx")


@query("sink_upsert_daily", "idx", W(PANEL, q="""
  SELECT series_id, ds, CASE WHEN ds >= DATE '2000-07-01' THEN idx + 1 ELSE idx END AS idx FROM panel"""))
def sink_upsert_daily(spark, d):
    p, old, _ = _halves(spark, d)
    new = p.filter(F.col("ds") >= F.lit("2000-07-01").cast("date")).withColumn("idx", F.col("idx") + 1)
    table = _table(spark, old)
    sinks.upsert(spark, table, new)
    return spark.read.parquet(table).select("series_id", "ds", "idx")


@query("sink_replace_range", "idx", W(PANEL, q="""
  SELECT series_id, ds, CASE WHEN ds BETWEEN DATE '1999-01-01' AND DATE '1999-06-30' THEN idx + 1 ELSE idx END AS idx FROM panel WHERE ds < DATE '2001-01-01'"""))
def sink_replace_range(spark, d):
    p, old, _ = _halves(spark, d)
    table = _table(spark, old)
    sinks.replace_range(spark, table, p.withColumn("idx", F.col("idx") + 1), "1999-01-01", "1999-06-30", clear=True)
    return spark.read.parquet(table).select("series_id", "ds", "idx")


@query("sink_reconcile", "new_idx new_avg", W(PANEL, q=f"""
  SELECT series_id, ds, new_idx, new_avg, {BAND4.format(x='new_idx')} AS new_alert, CASE WHEN new_idx - new_avg > 2 THEN 'rising' WHEN new_idx - new_avg < -2 THEN 'falling' ELSE 'stable' END AS new_trend FROM (
   SELECT *, round(round(avg(new_idx) OVER (PARTITION BY series_id ORDER BY ds ROWS 29 PRECEDING), 6), 1) AS new_avg FROM (
    SELECT series_id, ds, round(round(idx, 6), 1) AS new_idx, dayofyear(ds) % 10 = 0 AS broken FROM panel)) WHERE broken"""))
def sink_reconcile(spark, d):
    p = tb.panel(spark, d)
    good = p.withColumn("idx", F.round(F.round("idx", 6), 1))
    good = good.withColumn("avg_30", F.round(F.round(F.avg("idx").over(win.last_rows(30)), 6), 1))
    good = good.withColumn("alert_level", fn.alert_four("idx")).withColumn("trend", fn.trend_vs_avg("idx", "avg_30"))
    broken = F.dayofyear("ds") % 10 == 0
    stored = good.withColumn("idx", F.when(broken, F.col("idx") + 3).otherwise(F.col("idx")))
    return sinks.reconciled(stored).select("series_id", "ds", "new_idx", "new_avg", "new_alert", "new_trend")


@query("sink_export", "idx", W(PANEL, q="""
  SELECT series_id, fmt, count(*) AS n, sum(idx) AS idx FROM panel CROSS JOIN (VALUES ('json'),('csv'),('parquet')) f(fmt) WHERE ds BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY 1, 2"""), digits=4)
def sink_export(spark, d):
    p = tb.stored_panel(spark, d, [(dt.date(1998, 1, 1), dt.date(1998, 12, 31))]).select("series_id", "ds", "idx")
    ddl, parts = "series_id string, ds date, idx double", []
    for fmt in ("json", "csv", "parquet"):
        path = scratch_path(spark, fmt)
        sinks.export_range(p, "1998-01-01", "1998-12-31", fmt, path)
        parts.append(spark.read.format(fmt).schema(ddl).option("header", True).load(path).withColumn("fmt", F.lit(fmt)))
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("series_id", "fmt").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx"))


# ------------------------------------------------- projections and filters
@query("proj_canonical_columns", DBL, W(PANEL, q=f"SELECT series_id, ds, idx, {CHS4} FROM panel"))
def proj_canonical_columns(spark, d):
    p = tb.panel(spark, d).toDF("series_id", "ds", "Stablecoin", "DEFI_LIQUIDITY", "contagion", "Opacity", "idx")
    return quality.canonical(p, ["series_id", "ds", "idx"])


@query("filter_date_range", "tvl", W(DAILY_ORDERS, q="SELECT ds, tvl, count(*) OVER () AS n FROM daily_orders WHERE ds BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"), digits=2)
def filter_date_range(spark, d):
    o = tb.read(spark, d, "orders").filter(F.col("o_orderdate").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz")))
    g = o.groupBy(F.col("o_orderdate").cast("date").alias("ds")).agg((F.sum(tb.whole("o_totalprice", 100)) / 100.0).alias("tvl"))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit("orders")))  # one daily series: bounded by the calendar
    return g.withColumn("n", n).select("ds", "tvl", "n").orderBy("ds")


@query("filter_range_preset", "idx", W(PANEL, q="""
  SELECT preset, p.series_id, ds, idx FROM panel p JOIN (SELECT series_id, max(ds) AS m FROM panel GROUP BY 1) l USING (series_id)
   CROSS JOIN (VALUES ('30D', 30), ('90D', 90), ('1Y', 365), ('All', 100000)) v(preset, days) WHERE m - ds <= days"""))
def filter_range_preset(spark, d):
    return quality.range_presets(tb.panel(spark, d).select("series_id", "ds", "idx"))


@query("filter_event_window", "idx", W(PANEL, EVENTS_DIM, q="""
  SELECT event, series_id, ds, idx FROM panel JOIN events_dim ON ds BETWEEN event_date - CASE event WHEN 'E1' THEN 45 ELSE 30 END AND event_date + CASE event WHEN 'E1' THEN 20 ELSE 15 END"""))
def filter_event_window(spark, d):
    e = tb.events_dim(spark).select("event", "event_date", F.when(F.col("event") == "E1", 45).otherwise(30).alias("before"), F.when(F.col("event") == "E1", 20).otherwise(15).alias("after"))
    days = ev.unfold(e, "before", "after")
    return tb.panel(spark, d, tb.day_ranges(days)).join(days, "ds").select("event", "series_id", "ds", "idx")


@query("filter_positive_tvl", "tvl", W(PROTOCOLS, q="SELECT protocol_id, tvl FROM protocols WHERE coalesce(tvl,0) > 0"))
def filter_positive_tvl(spark, d):
    return ch.positive_tvl(tb.protocols(spark, d)).select("protocol_id", "tvl")


@query("filter_complete_rows", "idx", W(PANEL, q="SELECT series_id, ds, idx FROM panel WHERE arbitrage_opacity <> 0 AND contagion_risk <= 90"))
def filter_complete_rows(spark, d):
    p = tb.panel(spark, d)
    holes = p.withColumn("arbitrage_opacity", F.when(F.col("arbitrage_opacity") != 0, F.col("arbitrage_opacity"))).withColumn(
        "contagion_risk", F.when(F.col("contagion_risk") > 90, F.lit(float("nan"))).otherwise(F.col("contagion_risk")))
    return quality.complete_rows(holes).select("series_id", "ds", "idx")


@query("filter_finite_returns", "r", W(PANEL, q="""
  SELECT series_id, CASE WHEN count(*) < 2 THEN 0 ELSE corr(x, y) END AS r, count(*) AS n FROM (
   SELECT series_id, CASE WHEN po > 0 THEN arbitrage_opacity/po - 1 END AS x, CASE WHEN pc > 0 THEN contagion_risk/pc - 1 END AS y FROM (
    SELECT *, lag(arbitrage_opacity) OVER (PARTITION BY series_id ORDER BY ds) po, lag(contagion_risk) OVER (PARTITION BY series_id ORDER BY ds) pc FROM panel))
  WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1"""))
def filter_finite_returns(spark, d):
    w = win.by_day()
    ratio = lambda c: F.try_divide(F.col(c), F.lag(c).over(w)) - 1
    r = tb.panel(spark, d).select("series_id", ratio("arbitrage_opacity").alias("x"), ratio("contagion_risk").alias("y"))
    r = align.finite_pairs(r, "x", "y")
    return r.groupBy("series_id").agg(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(corr("x", "y")).alias("r"), F.count(F.lit(1)).alias("n"))


@query("guard_min_obs", "", W(PANEL, EVENTS_DIM, q="""
  SELECT series_id, event, count(*) FILTER (WHERE rel BETWEEN -90 AND -31) AS n_est, count(*) FILTER (WHERE rel >= -30) AS n_evt,
   CASE WHEN count(*) FILTER (WHERE rel BETWEEN -90 AND -31) < 58 THEN 'short estimation' WHEN count(*) FILTER (WHERE rel >= -30) < 5 THEN 'short event' ELSE 'ok' END AS status
  FROM (SELECT series_id, event, ds - event_date AS rel FROM panel JOIN events_dim ON ds BETWEEN event_date - 90 AND event_date + 10) GROUP BY 1, 2"""))
def guard_min_obs(spark, d):
    return quality.window_status(tb.panel(spark, d), tb.events_dim(spark), least_est=58)


@query("check_consistency", "", W(PANEL, q=f"""
  SELECT series_id, count(*) AS n, count(*) FILTER (WHERE day(ds) = 7) AS value_mismatches, count(*) FILTER (WHERE {BAND4.format(x='s')} <> {BAND4.format(x='round(round(idx,6),1)')}) AS band_mismatches FROM (
   SELECT *, CASE WHEN day(ds) = 7 THEN round(round(idx,6),1) + 3 ELSE round(round(idx,6),1) END AS s FROM panel) GROUP BY 1"""))
def check_consistency(spark, d):
    p = tb.panel(spark, d)
    right = F.round(F.round("idx", 6), 1)
    stored = p.withColumn("alert_level", fn.alert_four(right)).withColumn("idx", F.when(F.dayofmonth("ds") == 7, right + 3).otherwise(right))
    return quality.consistency(stored)


# ------------------------------------------------------------ sorts, top-k
@query("topk_latest", "idx avg_30", W(PANEL, q=f"""
  SELECT series_id, ds, idx, a AS avg_30, {BAND4.format(x='idx')} AS alert_level, CASE WHEN idx-a > 2 THEN 'rising' WHEN idx-a < -2 THEN 'falling' ELSE 'stable' END AS trend FROM (
   SELECT *, avg(idx) OVER (PARTITION BY series_id ORDER BY ds ROWS 29 PRECEDING) a, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) rn FROM panel) WHERE rn = 1"""))
def topk_latest(spark, d):
    b = win.board(tb.panel(spark, d))
    row = F.max_by(F.struct("ds", "idx", "avg_30", "alert_level", "trend"), "ds")
    return b.groupBy("series_id").agg(row.alias("r")).select("series_id", "r.*")


@query("topk_subindex", "value weight", W(PANEL, q="""
  SELECT series_id, arg_max(contagion_risk, ds) AS value, 0.25 AS weight, 'contagion_risk' AS channel FROM panel GROUP BY 1"""))
def topk_subindex(spark, d):
    return quality.latest_channel(tb.panel(spark, d), "contagion_risk")


@query("topk_headlines", "sentiment", W(HEADLINES, q=f"""
  SELECT doc_id, title, sentiment, source FROM headlines WHERE {_hits(PLAIN_TERMS)} > 0 ORDER BY abs(sentiment) DESC, doc_id LIMIT 5"""))
def topk_headlines(spark, d):
    h = tb.headlines(spark, d).filter(fn.has_term("title", PLAIN_TERMS))
    return h.orderBy(F.desc(F.abs("sentiment")), "doc_id").limit(5).select("doc_id", "title", "sentiment", "source")


@query("sort_channels", "weighted", W(PANEL, q="""
  SELECT series_id, channel, weighted, row_number() OVER (PARTITION BY series_id ORDER BY weighted DESC, channel) AS place FROM (
   SELECT series_id, channel, avg(v) AS weighted FROM (SELECT series_id, unnest(['stablecoin_risk','defi_liquidity_risk','contagion_risk','arbitrage_opacity']) AS channel,
     unnest([0.3*stablecoin_risk, 0.25*defi_liquidity_risk, 0.25*contagion_risk, 0.2*arbitrage_opacity]) AS v FROM panel) GROUP BY 1, 2)"""))
def sort_channels(spark, d):
    g = tb.panel(spark, d).groupBy("series_id").agg(*[F.avg(F.col(c) * w).alias(c) for c, w in S.CHANNEL_WEIGHTS.items()])
    long = g.unpivot("series_id", S.CHANNELS, "channel", "weighted")
    return long.withColumn("place", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("weighted"), "channel"))).orderBy("series_id", "place")


# -------------------------------------------------------------------- sets
@query("set_union_all", "idx", W(PANEL, q="SELECT series_id, ds, idx FROM panel UNION ALL SELECT series_id, ds, idx + 1 FROM panel WHERE ds >= DATE '2001-01-01'"))
def set_union_all(spark, d):
    p = tb.panel(spark, d).select("series_id", "ds", "idx")
    more = p.filter(F.col("ds") >= F.lit("2001-01-01").cast("date")).withColumn("idx", F.col("idx") + 1)
    return p.unionByName(more).orderBy("series_id", "ds", "idx")


@query("set_distinct_first", "sentiment", W(NEWS, q="SELECT doc_id, title, source, lang, sentiment FROM headlines JOIN firsts USING (doc_id, title)"))
def set_distinct_first(spark, d):
    return pl.first_titles(tb.headlines(spark, d), "doc_id")


@query("set_intersect_dates", "", W(PANEL, q="SELECT ds FROM panel WHERE series_id = 'MACHINERY' INTERSECT SELECT ds FROM panel WHERE series_id = 'BUILDING'"))
def set_intersect_dates(spark, d):
    p = tb.panel(spark, d)
    one = lambda s: p.filter(F.col("series_id") == s).select("ds")
    return one("MACHINERY").intersect(one("BUILDING"))


@query("set_key_intersection", "", W(PANEL, q="""
  SELECT ds FROM panel GROUP BY 1 HAVING count(DISTINCT series_id) = (SELECT count(DISTINCT series_id) FROM panel)"""))
def set_key_intersection(spark, d):
    return quality.common_keys(tb.panel(spark, d), "series_id", "ds")
