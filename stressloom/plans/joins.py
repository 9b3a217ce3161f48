"""Queries over joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stressloom.functions.stats import corr
from stressloom import schema as S
from stressloom.functions import scoring as fn
from stressloom.operators import aggregates as ag
from stressloom.operators import align, asof, calendar, eventjoin as ev, grids, snapshot
from stressloom.plans.aggregations import CHS, LABELLED, LONG
from stressloom.plans.registry import query
from stressloom.plans.scalars import PLAIN_TERMS
from stressloom.plans.sqltext import EVENTS_DIM, HEADLINES, OBSERVATIONS, PANEL, W
from stressloom.session import stored
from stressloom.sources import tables as tb


@query("join_inner_date", "x y", W(PANEL, q="""
  SELECT a.series_id, a.ds, a.idx AS x, b.idx AS y FROM panel a JOIN panel b ON a.ds = b.ds AND b.series_id = 'MACHINERY' AND a.series_id <> 'MACHINERY'"""))
def join_inner_date(spark, d):
    return align.against(tb.panel(spark, d), "MACHINERY", "idx")


ASK = "ask AS (SELECT event_id, user_id AS key, ts FROM events WHERE event_type = 'purchase')"
OBS = "obs AS (SELECT user_id AS key, ts, value FROM events WHERE event_type = 'view' AND value IS NOT NULL)"
NEAR = """near AS (SELECT a.event_id, a.key, CASE WHEN n.ts IS NULL OR (p.ts IS NOT NULL AND epoch_us(a.ts)-epoch_us(p.ts) <= epoch_us(n.ts)-epoch_us(a.ts)) THEN p.value ELSE n.value END AS value,
    CASE WHEN n.ts IS NULL OR (p.ts IS NOT NULL AND epoch_us(a.ts)-epoch_us(p.ts) <= epoch_us(n.ts)-epoch_us(a.ts)) THEN epoch_us(a.ts)-epoch_us(p.ts) ELSE epoch_us(n.ts)-epoch_us(a.ts) END/1e6 AS gap
  FROM ask a ASOF LEFT JOIN obs p ON a.key = p.key AND a.ts >= p.ts ASOF LEFT JOIN obs n ON a.key = n.key AND a.ts < n.ts)"""


def _sides(spark, d):
    p = tb.points(spark, d)
    ask = p.filter(F.col("source") == "purchase").select("event_id", "key", "ts")
    return ask, p.filter(F.col("source") == "view").select("key", "ts", "value")


@query("join_asof_nearest", "value gap_seconds", W(ASK, OBS, NEAR, q="SELECT event_id, key, value, gap AS gap_seconds FROM near"))
def join_asof_nearest(spark, d):
    ask, obs = _sides(spark, d)
    return asof.nearest(ask, obs, ["key"], "ts", "ts", "value", "value").select("event_id", "key", "value", "gap_seconds")


@query("join_asof_nearest_tolerance", "value", W(ASK, OBS, NEAR, q="SELECT event_id, key, CASE WHEN gap <= 43200 THEN value END AS value FROM near"))
def join_asof_nearest_tolerance(spark, d):
    ask, obs = _sides(spark, d)
    return asof.nearest(ask, obs, ["key"], "ts", "ts", "value", "value", tolerance_seconds=43200).select("event_id", "key", "value")


@query("join_asof_backward", "value", W(ASK, OBS, q="""
  SELECT event_id, a.key, coalesce(p.value, 20.0) AS value FROM ask a ASOF LEFT JOIN obs p ON a.key = p.key AND a.ts >= p.ts"""))
def join_asof_backward(spark, d):
    ask, obs = _sides(spark, d)
    return asof.backward(ask, obs, ["key"], "ts", "ts", "value", "value", default=F.lit(S.MACRO_DEFAULTS["vix"][0])).select("event_id", "key", "value")


# source of the points -> source of the lag table
LAG_SOURCE = {"click": "coin_price", "view": "news", "purchase": "tvl", "signup": "stablecoins", "error": "treasury"}


@query("join_asof_lagged", "value", W("""
  lagd AS (SELECT event_type AS source, ts + CASE event_type WHEN 'click' THEN INTERVAL 1 HOUR WHEN 'view' THEN INTERVAL 2 HOUR WHEN 'purchase' THEN INTERVAL 6 HOUR
     WHEN 'signup' THEN INTERVAL 12 HOUR ELSE INTERVAL 48 HOUR END AS seen, value FROM events WHERE value IS NOT NULL),
  tgt AS (SELECT DISTINCT event_type AS source, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS target FROM events)""", q="""
  SELECT t.source, CAST(target AS DATE) AS ds, value FROM tgt t ASOF LEFT JOIN lagd l ON t.source = l.source AND t.target >= l.seen"""))
def join_asof_lagged(spark, d):
    p = tb.points(spark, d)
    targets = p.select("source", F.to_date("ts").alias("ds")).distinct()
    hours = F.create_map(*[F.lit(x) for k, s in LAG_SOURCE.items() for x in (k, S.PUBLICATION_LAG_HOURS[s])])
    return asof.lagged(targets, p.select("source", "ts", "value"), ["source"], "ds", "ts", "value", "value", hours[F.col("source")]).select("source", "ds", "value")


@query("join_calendar_ffill", "idx", W(PANEL, q="""
  SELECT c.series_id, c.ds, last_value(idx IGNORE NULLS) OVER (PARTITION BY c.series_id ORDER BY c.ds ROWS UNBOUNDED PRECEDING) AS idx FROM (
   SELECT series_id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM panel GROUP BY 1) c LEFT JOIN panel p ON c.series_id=p.series_id AND c.ds=p.ds"""))
def join_calendar_ffill(spark, d):
    return calendar.fill_calendar(tb.panel(spark, d), ["series_id"], ["idx"])


SNAPSHOT = ["tvl", "tvl_peak", "tvl_cv", "treasury", "index", "coin_price"]


def _snapshot_note(x: str, found: str, exact: str, kind: str, none: str) -> str:
    return f"CASE WHEN {found} IS NULL THEN '{none}' WHEN {exact} THEN 'exact' ELSE '{kind}' END AS {x}_quality"


@query("join_snapshot", "tvl tvl_peak tvl_cv treasury index coin_price", W(OBSERVATIONS, PANEL, f"""
  seg AS (SELECT c_mktsegment AS series_id, CAST(o_orderdate AS DATE) AS ds, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/100.0 AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
  targets AS (SELECT series_id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 7 DAY)) AS DATE) AS ds FROM seg GROUP BY 1),
  state AS (SELECT series_id, ds, max(v) OVER (PARTITION BY series_id ORDER BY ds RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW) pk, CASE WHEN count(*) OVER m > 1 THEN stddev_pop(v) OVER m/avg(v) OVER m END AS cv FROM seg
     WINDOW m AS (PARTITION BY series_id ORDER BY ds RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)),
  okobs AS (SELECT ds, ds + 2 AS seen, TRY_CAST(value AS DOUBLE) AS v FROM observations WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL),
  ix AS (SELECT series_id, ds, ds + 1 AS seen, idx AS v FROM panel),
  cp AS (SELECT CAST(ts AS DATE) AS ds, CAST(ts AS DATE) + 1 AS seen, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1 HAVING avg(value) IS NOT NULL),
  met AS (SELECT t.series_id, t.ds, CASE WHEN n.ds IS NULL OR t.ds - p.ds <= n.ds - t.ds THEN p.ds ELSE n.ds END AS tds, CASE WHEN n.ds IS NULL OR t.ds - p.ds <= n.ds - t.ds THEN p.v ELSE n.v END AS tv,
      s.pk, s.cv, o.ds AS ods, o.v AS ov, CASE WHEN t.ds - x.ds <= 7 THEN x.ds END AS xds, CASE WHEN t.ds - x.ds <= 7 THEN x.v END AS xv, c.ds AS cds, c.v AS cv1
    FROM targets t LEFT JOIN state s ON t.series_id = s.series_id AND t.ds = s.ds ASOF LEFT JOIN seg p ON t.series_id = p.series_id AND t.ds >= p.ds ASOF LEFT JOIN seg n ON t.series_id = n.series_id AND t.ds < n.ds
      ASOF LEFT JOIN okobs o ON t.ds >= o.seen ASOF LEFT JOIN ix x ON t.series_id = x.series_id AND t.ds >= x.seen ASOF LEFT JOIN cp c ON t.ds >= c.seen)""", q=f"""
  SELECT series_id, ds, tv AS tvl, pk AS tvl_peak, cv AS tvl_cv, coalesce(ov, 3.5) AS treasury, xv AS "index", coalesce(cv1, 1.0) AS coin_price,
    {_snapshot_note('tvl', 'tv', 'tds = ds', 'nearest', 'missing')}, {_snapshot_note('tvl_peak', 'pk', 'true', '', 'missing')}, {_snapshot_note('tvl_cv', 'cv', 'true', '', 'missing')},
    {_snapshot_note('treasury', 'ov', 'ds - ods = 2', 'carried', 'default')}, {_snapshot_note('index', 'xv', 'ds - xds = 1', 'carried', 'missing')}, {_snapshot_note('coin_price', 'cv1', 'ds - cds = 1', 'carried', 'default')} FROM met"""), digits=4)
def join_snapshot(spark, d):
    daily = stored(tb.segment_orders(spark, d), "orders")
    state = snapshot.value_state(daily)
    rate = tb.observations(spark, d).select("ds", F.col("value").try_cast("double").alias("value"))
    price = tb.points(spark, d).where("source = 'click'").groupBy(F.to_date("ts").alias("ds")).agg(F.avg("value").alias("value"))
    default = S.MACRO_DEFAULTS["treasury_10y"][0]
    days = {s: -(-h // 24) for s, h in S.PUBLICATION_LAG_HOURS.items()}
    s = snapshot.snapshot(snapshot.stepped(daily), {
        "tvl": snapshot.Source(daily, "nearest"),
        "tvl_peak": snapshot.Source(state.withColumn("value", F.col("peak")), "exact"),
        "tvl_cv": snapshot.Source(state.withColumn("value", F.col("cv")), "exact"),
        "treasury": snapshot.Source(rate, "backward", days["treasury"], default=default, common=True),
        "index": snapshot.Source(tb.panel(spark, d).withColumn("value", F.col("idx")), "backward", 1, longest=7),
        "coin_price": snapshot.Source(price, "backward", days["coin_price"], default=1.0, common=True),
    })
    return s.select("series_id", "ds", *SNAPSHOT, *[f"{x}_quality" for x in SNAPSHOT])


@query("join_lookup_default", "risk", W(OBSERVATIONS, PANEL, q="""
  SELECT series_id, p.ds, coalesce(least(greatest((TRY_CAST(value AS DOUBLE)-2)/4*100, 0.0), 100.0), 50) AS risk FROM panel p LEFT JOIN observations o ON p.ds = o.ds"""))
def join_lookup_default(spark, d):
    o = tb.observations(spark, d).select("ds", F.col("value").try_cast("double").alias("rate"))
    return tb.panel(spark, d).join(o, "ds", "left").select("series_id", "ds", F.coalesce(fn.treasury_stress("rate"), F.lit(50.0)).alias("risk"))


@query("join_range_label", "", W(PANEL, EVENTS_DIM, LABELLED, q="SELECT series_id, ds, label FROM labelled"))
def join_range_label(spark, d):
    return ev.lead_label(tb.panel(spark, d), tb.events_dim(spark)).select("series_id", "ds", "label")


@query("join_range_alerts_events", "precision recall", W(PANEL, EVENTS_DIM, q="""
  SELECT s.series_id, coalesce(tp*1.0/nullif(alerts,0), 0) AS precision, coalesce(det, 0)/4.0 AS recall FROM (SELECT DISTINCT series_id FROM panel) s
   LEFT JOIN (SELECT series_id, count(*) alerts FROM panel WHERE idx > 70 GROUP BY 1) a USING (series_id)
   LEFT JOIN (SELECT series_id, count(DISTINCT ds) tp, count(DISTINCT event) det FROM panel JOIN events_dim ON event_date > ds AND event_date - ds <= 30 WHERE idx > 70 GROUP BY 1) t USING (series_id)"""))
def join_range_alerts_events(spark, d):
    e = tb.events_dim(spark)
    h = ev.alert_event_hits(tb.panel(spark, d), e, 70.0)
    zero = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    return h.select("series_id", zero("tp", F.col("alerts")).alias("precision"), zero("detected", F.lit(e.count())).alias("recall"))


@query("join_anti_exclusion", "", W(PANEL, EVENTS_DIM, q="""
  SELECT series_id, ds FROM panel p JOIN (SELECT series_id, min(ds) lo, max(ds) hi FROM panel GROUP BY 1) USING (series_id)
  WHERE ds >= lo + 90 AND ds <= hi - 90 AND NOT EXISTS (SELECT 1 FROM events_dim WHERE abs(event_date - ds) < 90)"""))
def join_anti_exclusion(spark, d):
    return ev.eligible_dates(tb.panel(spark, d).select("series_id", "ds"), tb.events_dim(spark))


@query("join_anti_existing", "idx", W(PANEL, q="SELECT series_id, ds, idx FROM panel WHERE ds >= DATE '2001-01-01' OR (series_id = 'MACHINERY' AND ds >= DATE '2000-06-01')"))
def join_anti_existing(spark, d):
    p = tb.panel(spark, d).select("series_id", "ds", "idx")
    cut = F.when(F.col("series_id") == "MACHINERY", F.lit("2000-06-01")).otherwise(F.lit("2001-01-01")).cast("date")
    have = p.filter(F.col("ds") < cut).select("series_id", "ds")
    return p.join(have, ["series_id", "ds"], "left_anti")


@query("join_semi_exists", "", W(HEADLINES, q="""
  SELECT doc_id FROM headlines h WHERE EXISTS (SELECT 1 FROM (VALUES ('the'),('and'),('der'),('que'),('with')) v(t) WHERE contains(lower(h.title), t))"""))
def join_semi_exists(spark, d):
    return tb.headlines(spark, d).filter(fn.has_term("title", PLAIN_TERMS)).select("doc_id")


@query("join_cross_grid", "delta value", W(PANEL, q="""
  SELECT series_id, channel, delta, avg((w1*stablecoin_risk + w2*defi_liquidity_risk + w3*contagion_risk + w4*arbitrage_opacity)/(1+delta)) AS value FROM (
   SELECT *, 0.3 + CASE WHEN channel='stablecoin_risk' THEN delta ELSE 0 END AS w1, 0.25 + CASE WHEN channel='defi_liquidity_risk' THEN delta ELSE 0 END AS w2,
     0.25 + CASE WHEN channel='contagion_risk' THEN delta ELSE 0 END AS w3, 0.2 + CASE WHEN channel='arbitrage_opacity' THEN delta ELSE 0 END AS w4
   FROM panel CROSS JOIN """ + CHS + """ CROSS JOIN (VALUES (-0.1),(-0.05),(0.0),(0.05),(0.1)) g(delta)) GROUP BY 1, 2, 3"""))
def join_cross_grid(spark, d):
    grid = [dict(channel=c, delta=x, w=grids.shifted_weights(S.CHANNEL_WEIGHTS, c, x)) for c in S.CHANNELS for x in (-0.1, -0.05, 0.0, 0.05, 0.1)]
    g = grids.explode_grid(tb.panel(spark, d), grid)
    return g.groupBy("series_id", "channel", "delta").agg(F.avg(grids.grid_index()).alias("value"))


@query("join_positional", "x y", W(PANEL, q="""
  SELECT a.series_id, a.ds, a.pos, a.idx AS x, b.idx AS y FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) pos FROM panel WHERE series_id <> 'MACHINERY') a
   JOIN (SELECT *, row_number() OVER (ORDER BY ds) pos FROM panel WHERE series_id = 'MACHINERY') b USING (pos)"""))
def join_positional(spark, d):
    return align.positional(tb.panel(spark, d), "MACHINERY", "idx")


@query("join_self_lag", "idx idx_1 idx_2 idx_3 contagion_risk contagion_risk_1 contagion_risk_2 contagion_risk_3", W(PANEL, q="""
  SELECT * FROM (SELECT series_id, ds, idx, contagion_risk, """ + ", ".join(f"lag({c},{i}) OVER (PARTITION BY series_id ORDER BY ds) AS {c}_{i}" for c in ("idx", "contagion_risk") for i in (1, 2, 3))
       + " FROM panel) WHERE idx_3 IS NOT NULL"))
def join_self_lag(spark, d):
    return align.lag_design(tb.panel(spark, d), ["idx", "contagion_risk"], 3)


@query("join_pairwise_series", "r", W(PANEL, LONG, q="""
  SELECT a.series_id, a.channel AS ch_a, b.channel AS ch_b, corr(a.value, b.value) AS r, count(*) AS n FROM long a JOIN long b ON a.series_id=b.series_id AND a.ds=b.ds
   AND (a.channel, b.channel) IN (('stablecoin_risk','defi_liquidity_risk'),('stablecoin_risk','contagion_risk'),
  ('stablecoin_risk','arbitrage_opacity'),('defi_liquidity_risk','contagion_risk'),('defi_liquidity_risk','arbitrage_opacity'),('contagion_risk','arbitrage_opacity')) GROUP BY 1, 2, 3"""))
def join_pairwise_series(spark, d):
    pairs = ag.channel_pairs(tb.panel(spark, d), ["series_id"])
    return pairs.groupBy("series_id", "ch_a", "ch_b").agg(corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
