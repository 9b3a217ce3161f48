"""Queries over window functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stressloom.operators import aggregates as ag
from stressloom.operators import align, bars, compose, paths, rolling
from stressloom.operators import event_study as es
from stressloom.operators import windows as win
from stressloom.plans.aggregations import AVGRANK, RETS, SYS, pair_returns
from stressloom.plans.registry import query
from stressloom.plans.sqltext import DAILY_ORDERS, EVENTS_DIM, PANEL, PEG_POINTS, W
from stressloom.sources import tables as tb

BY = "PARTITION BY series_id ORDER BY ds"


@query("win_avg_30_rows", "avg_30", W(PANEL, q=f"SELECT series_id, ds, avg(idx) OVER ({BY} ROWS 29 PRECEDING) AS avg_30 FROM panel"))
def win_avg_30_rows(spark, d):
    return tb.panel(spark, d).select("series_id", "ds", F.avg("idx").over(win.last_rows(30)).alias("avg_30"))


@query("win_avg_30_days", "avg_prior avg_with", W(PANEL, q=f"""
  SELECT series_id, ds, avg(idx) OVER ({BY} RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS avg_prior,
    avg(idx) OVER ({BY} RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS avg_with FROM panel"""))
def win_avg_30_days(spark, d):
    return tb.panel(spark, d).select("series_id", "ds", F.avg("idx").over(win.day_range(-30, -1)).alias("avg_prior"),
                                     F.avg("idx").over(win.day_range(-30, 0)).alias("avg_with"))


@query("win_rolling_stats", "mean std skew kurt lo hi", W(PANEL, q=f"""
  SELECT series_id, ds, CASE WHEN n=30 THEN mean END AS mean, CASE WHEN n=30 THEN std END AS std, CASE WHEN n=30 THEN mn END AS lo, CASE WHEN n=30 THEN mx END AS hi,
    CASE WHEN n=30 THEN (s3/n - 3*(s1/n)*(s2/n) + 2*(s1/n)^3)/((s2/n-(s1/n)^2)^1.5)*sqrt(n*(n-1.0))/(n-2) END AS skew,
    CASE WHEN n=30 THEN ((n+1)*((s4/n - 4*(s1/n)*(s3/n) + 6*(s1/n)^2*(s2/n) - 3*(s1/n)^4)/((s2/n-(s1/n)^2)^2) - 3) + 6)*(n-1.0)/((n-2.0)*(n-3)) END AS kurt
  FROM (SELECT series_id, ds, count(*) OVER w AS n, avg(idx) OVER w AS mean, stddev_samp(idx) OVER w AS std, min(idx) OVER w AS mn, max(idx) OVER w AS mx,
     sum(idx-47) OVER w AS s1, sum((idx-47)^2) OVER w AS s2, sum((idx-47)^3) OVER w AS s3, sum((idx-47)^4) OVER w AS s4 FROM panel
     WINDOW w AS ({BY} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""))
def win_rolling_stats(spark, d):
    w = win.last_rows(30)
    full = F.count("idx").over(w) >= 30
    g = lambda c: F.when(full, c)
    return tb.panel(spark, d).select(
        "series_id", "ds", g(F.avg("idx").over(w)).alias("mean"), g(F.stddev_samp("idx").over(w)).alias("std"),
        g(paths.sample_skew("idx", w)).alias("skew"), g(paths.sample_kurtosis("idx", w)).alias("kurt"),
        g(F.min("idx").over(w)).alias("lo"), g(F.max("idx").over(w)).alias("hi"))


@query("win_peg_volatility", "price peg_deviation peg_volatility_7d peg_volatility_30d", W(PEG_POINTS, """
  bars AS (SELECT symbol, CAST(ts AS DATE) AS ds, median(price) AS price FROM peg_points GROUP BY 1, 2)""", q="""
  SELECT symbol, ds, price, abs(1-price) AS peg_deviation, CASE WHEN count(*) OVER a >= 3 THEN stddev_samp(price) OVER a END AS peg_volatility_7d,
   CASE WHEN count(*) OVER b >= 7 THEN stddev_samp(price) OVER b END AS peg_volatility_30d FROM bars
  WINDOW a AS (PARTITION BY symbol ORDER BY ds ROWS 6 PRECEDING), b AS (PARTITION BY symbol ORDER BY ds ROWS 29 PRECEDING)"""))
def win_peg_volatility(spark, d):
    return bars.peg_history(bars.daily_median(tb.peg_points(spark, d)))


@query("win_max_365d", "peak peak_ever", W(DAILY_ORDERS, q="""
  SELECT ds, max(tvl) OVER (ORDER BY ds RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW) AS peak, max(tvl) OVER (ORDER BY ds) AS peak_ever FROM daily_orders"""))
def win_max_365d(spark, d):
    t = tb.daily_orders(spark, d).withColumn("series_id", F.lit("orders"))
    return t.select("ds", F.max("tvl").over(win.day_range(-365, 0)).alias("peak"), F.max("tvl").over(win.expanding()).alias("peak_ever"))


@query("win_range_list", "total", W(DAILY_ORDERS, q="""
  SELECT ds, array_to_string(list(n) OVER w, ',') AS counts, sum(tvl) OVER w AS total FROM daily_orders
  WINDOW w AS (ORDER BY ds RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)"""), digits=3)
def win_range_list(spark, d):
    w = win.day_range(-29, 0)
    t = tb.daily_orders(spark, d).withColumn("series_id", F.lit("orders"))
    return t.select("ds", F.array_join(F.collect_list("n").over(w), ",").alias("counts"), F.sum("tvl").over(w).alias("total"))


@query("win_pct_change", "change_30 change_30d mean_change", W(PANEL, q=f"""
  SELECT *, (change_30 + change_30d)/2 AS mean_change FROM (
   SELECT p.series_id, p.ds, p.idx/lag(p.idx, 30) OVER (PARTITION BY p.series_id ORDER BY p.ds) - 1 AS change_30, p.idx/b.idx - 1 AS change_30d
   FROM panel p LEFT JOIN panel b ON p.series_id = b.series_id AND b.ds = p.ds - 30)"""))
def win_pct_change(spark, d):
    w = win.day_range(-30, -30)
    a = F.col("idx") / F.lag("idx", 30).over(win.by_day()) - 1
    b = F.col("idx") / F.first("idx").over(w) - 1
    return tb.panel(spark, d).select("series_id", "ds", a.alias("change_30"), b.alias("change_30d"), ((a + b) / 2).alias("mean_change"))


@query("win_forward_target", "ahead fall", W(PANEL, q=f"""
  SELECT series_id, ds, lead(idx,30) OVER ({BY}) AS ahead, -(lead(idx,30) OVER ({BY})/idx - 1) AS fall FROM panel"""))
def win_forward_target(spark, d):
    ahead = F.lead("idx", 30).over(win.by_day())
    return tb.panel(spark, d).select("series_id", "ds", ahead.alias("ahead"), (-(ahead / F.col("idx") - 1)).alias("fall"))


# drawdown relative to the running peak, written with prefix products: path value over the maximum of earlier ones
FWD = """growth AS (SELECT series_id, ds, ret, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS pos, idx AS level FROM rets),
 fwd AS (SELECT a.series_id, a.ds, min(c.level/pk - 1) AS drawdown FROM growth a
   JOIN (SELECT c.series_id, c.pos, c.level, s.pos AS start, max(c.level) OVER (PARTITION BY c.series_id, s.pos ORDER BY c.pos) AS pk
     FROM growth s JOIN growth c ON s.series_id = c.series_id AND c.pos BETWEEN s.pos AND s.pos + 29) c ON a.series_id = c.series_id AND a.pos = c.start
   JOIN (SELECT series_id, max(pos) mp FROM growth GROUP BY 1) m ON a.series_id = m.series_id AND a.pos + 30 <= m.mp GROUP BY 1, 2)"""


def _fwd(spark, d, f, *args):
    return f(ag.returns(tb.panel(spark, d)).select("series_id", "ds", "ret"), "ret", 30, *args)


@query("win_forward_drawdown", "drawdown", W(PANEL, RETS, FWD, q="SELECT r.series_id, r.ds, drawdown FROM rets r LEFT JOIN fwd USING (series_id, ds)"))
def win_forward_drawdown(spark, d):
    return _fwd(spark, d, paths.forward_drawdown).select("series_id", "ds", "drawdown")


@query("win_forward_labels", "", W(PANEL, RETS, FWD, q="SELECT r.series_id, r.ds, CAST(coalesce(drawdown < -0.6, false) AS INT) AS label FROM rets r LEFT JOIN fwd USING (series_id, ds)"))
def win_forward_labels(spark, d):
    return _fwd(spark, d, paths.forward_labels, -0.6).select("series_id", "ds", "label")


@query("win_forward_volatility", "vol", W(PANEL, RETS, q=f"""
  SELECT series_id, ds, CASE WHEN count(ret) OVER w = 30 THEN stddev_samp(ret) OVER w END AS vol FROM rets WINDOW w AS ({BY} ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)"""))
def win_forward_volatility(spark, d):
    w = win.by_day().rowsBetween(1, 30)
    return ag.returns(tb.panel(spark, d)).select("series_id", "ds", win.full_window(F.stddev_samp("ret"), 30, "ret", w).alias("vol"))


@query("win_expanding_minmax", "scaled fixed", W(PANEL, q=f"""
  SELECT series_id, ds, CASE WHEN mx > mn THEN 100*(idx-mn)/(mx-mn) END AS scaled, CASE WHEN fx > fm THEN 100*(idx-fm)/(fx-fm) ELSE 50 END AS fixed FROM (
   SELECT *, min(idx) OVER ({BY}) mn, max(idx) OVER ({BY}) mx, min(idx) OVER (PARTITION BY series_id) fm, max(idx) OVER (PARTITION BY series_id) fx FROM panel)"""))
def win_expanding_minmax(spark, d):
    return tb.panel(spark, d).select("series_id", "ds", compose.expanding_scale("idx").alias("scaled"), compose.fixed_scale("idx").alias("fixed"))


TAIL = f"""tails AS (SELECT *, n >= 30 AND (stablecoin_risk > q1 OR defi_liquidity_risk > q2 OR contagion_risk > q3 OR arbitrage_opacity > q4) AS tail FROM (
  SELECT *, count(*) OVER w AS n, quantile_cont(stablecoin_risk,0.9) OVER w AS q1, quantile_cont(defi_liquidity_risk,0.9) OVER w AS q2,
   quantile_cont(contagion_risk,0.9) OVER w AS q3, quantile_cont(arbitrage_opacity,0.9) OVER w AS q4 FROM panel WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING)))"""


@query("win_expanding_quantile", "", W(PANEL, TAIL, q="SELECT series_id, ds, tail FROM tails"))
def win_expanding_quantile(spark, d):
    return compose.tail_days(tb.panel(spark, d)).select("series_id", "ds", "tail")


@query("win_uniform_rank", "u", W(PANEL, q=f"""
  SELECT series_id, ds, ({AVGRANK.format(k='series_id', x='idx')} - 0.5)/count(*) OVER (PARTITION BY series_id) AS u FROM panel"""))
def win_uniform_rank(spark, d):
    n = F.count("idx").over(Window.partitionBy("series_id"))
    return tb.panel(spark, d).select("series_id", "ds", ((ag.average_rank("idx", ["series_id"]) - 0.5) / n).alias("u"))


@query("win_pct_rank_normalise", "pct", W(PANEL, q=f"""
  SELECT series_id, ds, 100*({AVGRANK.format(k='series_id', x='idx')})/count(*) OVER (PARTITION BY series_id) AS pct FROM panel"""))
def win_pct_rank_normalise(spark, d):
    n = F.count("idx").over(Window.partitionBy("series_id"))
    return tb.panel(spark, d).select("series_id", "ds", (100.0 * ag.average_rank("idx", ["series_id"]) / n).alias("pct"))


CUSUM = f"""cus AS (SELECT series_id, ds, sum(r) OVER ({BY})/s AS cusum FROM (
  SELECT series_id, ds, idx - avg(idx) OVER (PARTITION BY series_id) AS r, stddev_pop(idx) OVER (PARTITION BY series_id)*sqrt(count(*) OVER (PARTITION BY series_id)) AS s FROM panel))"""


@query("win_cumsum_cusum", "cusum", W(PANEL, CUSUM, q="SELECT * FROM cus"))
def win_cumsum_cusum(spark, d):
    return paths.cusum(tb.panel(spark, d), "idx").select("series_id", "ds", "cusum")


@query("win_confidence_bounded", "mean lo hi", W(PANEL, q=f"""
  SELECT series_id, ds, mean, greatest(mean-h, 0.0) AS lo, least(mean+h, 100.0) AS hi FROM (
   SELECT series_id, ds, avg(idx) OVER ({BY}) AS mean, sqrt(2*2500.0*ln(2*sqrt(row_number() OVER ({BY}) + 1)/0.05)/row_number() OVER ({BY})) AS h FROM panel)"""))
def win_confidence_bounded(spark, d):
    m, lo, hi = paths.variance_bounded("idx")
    return tb.panel(spark, d).select("series_id", "ds", m.alias("mean"), lo.alias("lo"), hi.alias("hi"))


Z = "CAST(1.959963984540054 AS DOUBLE)"
@query("win_confidence_asymptotic", "mean lo hi", W(PANEL, q=f"""
  SELECT series_id, ds, mean, CASE WHEN t < 30 THEN 0 ELSE greatest(mean - c*s/sqrt(t), 0.0) END AS lo, CASE WHEN t < 30 THEN 100 ELSE least(mean + c*s/sqrt(t), 100.0) END AS hi FROM (
   SELECT *, CASE WHEN t < 100 THEN z + (z^3+z)/(4*v) + (5*z^5+16*z^3+3*z)/(96*v^2) + (3*z^7+19*z^5+17*z^3-15*z)/(384*v^3) + (79*z^9+776*z^7+1482*z^5-1920*z^3-945*z)/(92160*v^4) ELSE z END AS c FROM (
    SELECT series_id, ds, avg(idx) OVER ({BY}) AS mean, sqrt(greatest(var_pop(idx) OVER ({BY}), 1e-6)) AS s, row_number() OVER ({BY}) AS t, {Z} AS z, CAST(row_number() OVER ({BY}) AS DOUBLE) - 1 AS v FROM panel))"""))
def win_confidence_asymptotic(spark, d):
    m, lo, hi = paths.asymptotic_band("idx")
    return tb.panel(spark, d).select("series_id", "ds", m.alias("mean"), lo.alias("lo"), hi.alias("hi"))


PROD = [(i, j) for i in range(4) for j in range(i, 4)]
CH = ["stablecoin_risk", "defi_liquidity_risk", "contagion_risk", "arbitrage_opacity"]
# direct weighted sums over the last 700 changes: 0.94^700 is below 1e-18
EWMA = ("diffs AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS t FROM (SELECT series_id, ds, "
        + ", ".join(f"{c} - lag({c}) OVER (PARTITION BY series_id ORDER BY ds) AS d{i}" for i, c in enumerate(CH))
        + " FROM panel) WHERE d0 IS NOT NULL),\nseedc AS (SELECT series_id, " + ", ".join(f"avg(d{i}*d{j}) AS m{i}{j}" for i, j in PROD)
        + " FROM diffs WHERE t < 30 GROUP BY 1),\nearly AS (SELECT series_id, ds, t, " + ", ".join(f"avg(d{i}*d{j}) OVER (PARTITION BY series_id ORDER BY ds) AS c{i}{j}" for i, j in PROD)
        + " FROM diffs),\nlate AS (SELECT a.series_id, a.ds, " + ", ".join(f"sum(0.06*pow(CAST(0.94 AS DOUBLE), a.t-b.t)*b.d{i}*b.d{j}) AS c{i}{j}" for i, j in PROD)
        + " FROM diffs a JOIN diffs b ON a.series_id=b.series_id AND b.t BETWEEN a.t-700 AND a.t AND b.t >= 30 WHERE a.t >= 30 GROUP BY 1,2),\n"
        + "ewma AS (SELECT series_id, ds, " + ", ".join(f"c{i}{j}" for i, j in PROD) + " FROM early WHERE t < 30 UNION ALL SELECT l.series_id, l.ds, "
        + ", ".join(f"c{i}{j} + pow(CAST(0.94 AS DOUBLE), t-29)*m{i}{j}" for i, j in PROD) + " FROM late l JOIN diffs USING (series_id, ds) JOIN seedc USING (series_id))")


@query("win_ewma_cov", " ".join(f"c{i}{j}" for i, j in PROD), W(PANEL, EWMA, q="SELECT p.series_id, p.ds, " + ", ".join(f"c{i}{j}" for i, j in PROD) + " FROM panel p LEFT JOIN ewma USING (series_id, ds)"))
def win_ewma_cov(spark, d):
    return compose.ewma_products(tb.panel(spark, d)).select("series_id", "ds", *[f"c{i}{j}" for i, j in PROD])


@query("win_islands", "", W(PANEL, q=f"""
  SELECT series_id, ds, CAST(sum(c) OVER ({BY}) AS BIGINT) AS run FROM (
   SELECT *, CASE WHEN y = lag(y) OVER ({BY}) THEN 0 ELSE 1 END AS c FROM (SELECT series_id, ds, idx >= 50 AS y FROM panel))"""))
def win_islands(spark, d):
    return paths.runs(tb.panel(spark, d).select("series_id", "ds", (F.col("idx") >= 50).alias("y")), "y").select("series_id", "ds", "run")


BREAKS = "WITH RECURSIVE " + PANEL + ",\n" + CUSUM + """,
 b AS (SELECT series_id, ds, pos FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS pos FROM cus) WHERE abs(cusum) > 1.36),
 rec(series_id, pos) AS (SELECT series_id, min(pos) FROM b GROUP BY 1 UNION ALL SELECT r.series_id, (SELECT min(pos) FROM b WHERE b.series_id = r.series_id AND b.pos > r.pos + 30) FROM rec r WHERE r.pos IS NOT NULL)
SELECT series_id, ds AS break_date FROM rec JOIN b USING (series_id, pos)"""


@query("win_spaced_breaks", "", BREAKS)
def win_spaced_breaks(spark, d):
    return paths.spaced_breaks(paths.cusum(tb.panel(spark, d), "idx"))


WIN = """evw AS (SELECT p.series_id, e.event, p.ds - e.event_date AS rel, p.idx AS x FROM panel p JOIN events_dim e ON p.ds BETWEEN e.event_date - 90 AND e.event_date + 10),
 base AS (SELECT series_id, event, avg(x) FILTER (WHERE rel <= -31) AS mu, stddev_samp(x) FILTER (WHERE rel <= -31) AS sd, avg(x) FILTER (WHERE rel >= -30) AS ma,
   count(*) FILTER (WHERE rel >= -30) AS n, max(x) FILTER (WHERE rel >= -30) AS peak FROM evw GROUP BY 1, 2
   HAVING count(*) FILTER (WHERE rel <= -31) >= 20 AND count(*) FILTER (WHERE rel >= -30) >= 5)"""
BREACH = """breach AS (SELECT series_id, event, coalesce(-min(rel) FILTER (WHERE rel BETWEEN -{k} AND 0 AND x > mu+1.5*sd), 0) AS s, coalesce(-min(rel) FILTER (WHERE rel BETWEEN -{k} AND 0 AND x >= 50), 0) AS l
  FROM evw JOIN base USING (series_id, event) GROUP BY 1, 2)"""
SUST = """sust AS (SELECT b.series_id, b.event, coalesce(-min(rel) FILTER (WHERE rel > low), 0) AS u FROM (SELECT series_id, event, rel, max(rel) FILTER (WHERE x < 50) OVER (PARTITION BY series_id, event) AS low FROM evw WHERE rel BETWEEN -{k} AND 0) b GROUP BY 1, 2)"""


@query("win_first_breach", "", W(PANEL, EVENTS_DIM, WIN, BREACH.format(k=30), q="SELECT series_id, event, CAST(s AS BIGINT) AS first_sigma, CAST(l AS BIGINT) AS first_level FROM breach"))
def win_first_breach(spark, d):
    return es.lead_times(tb.panel(spark, d), tb.events_dim(spark), 30).drop("sustained")


@query("win_sustained_cross", "", W(PANEL, EVENTS_DIM, WIN, SUST.format(k=60), q="SELECT series_id, event, CAST(u AS BIGINT) AS sustained FROM sust"))
def win_sustained_cross(spark, d):
    return es.lead_times(tb.panel(spark, d), tb.events_dim(spark), 60).select("series_id", "event", "sustained")


@query("win_rolling_delta_covar", "delta_covar", W(PANEL, RETS, SYS, """
  num AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS pos FROM paired),
  w AS (SELECT a.series_id, a.ds, b.asset, b.system FROM num a JOIN num b ON a.series_id = b.series_id AND b.pos BETWEEN a.pos - 90 AND a.pos - 1 WHERE a.pos > 90),
  th AS (SELECT series_id, ds, quantile_cont(asset,0.05) q0, quantile_cont(asset,0.1) q1, quantile_cont(asset,0.4) q4, quantile_cont(asset,0.6) q6 FROM w GROUP BY 1,2)""", q="""
  SELECT series_id, ds, CASE WHEN count(*) FILTER (WHERE asset<=q0) < 10 THEN quantile_cont(system,0.05) FILTER (WHERE asset<=q1) ELSE quantile_cont(system,0.05) FILTER (WHERE asset<=q0) END
    - quantile_cont(system,0.05) FILTER (WHERE asset>=q4 AND asset<=q6) AS delta_covar FROM w JOIN th USING (series_id, ds) GROUP BY 1, 2"""))
def win_rolling_delta_covar(spark, d):
    return rolling.delta_covar(pair_returns(spark, d))


@query("win_lead_scan", "strength", W(PANEL, f"""
  both_ AS (SELECT a.series_id, a.ds, a.idx AS x, b.idx AS y, row_number() OVER (PARTITION BY a.series_id ORDER BY a.ds) AS pos FROM panel a JOIN panel b ON a.ds=b.ds AND b.series_id='MACHINERY' AND a.series_id<>'MACHINERY'),
  lagged AS (SELECT a.series_id, CAST(b.pos - a.pos AS INT) AS lag, a.x, b.y FROM both_ a JOIN both_ b ON a.series_id=b.series_id AND b.pos BETWEEN a.pos AND a.pos + 30),
  cors AS (SELECT series_id, lag, abs(corr(rx, ry)) AS strength FROM (SELECT series_id, lag, {AVGRANK.format(k='series_id, lag', x='x')} AS rx, {AVGRANK.format(k='series_id, lag', x='y')} AS ry FROM lagged) GROUP BY 1, 2)""", q="""
  SELECT series_id, lag, strength FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(strength,12) DESC, lag) rn FROM cors) WHERE rn = 1"""))
def win_lead_scan(spark, d):
    return rolling.lead_scan(align.against(tb.panel(spark, d), "MACHINERY", "idx"))


@query("win_detrend", "linear quadratic first log_first", W(PANEL, f"""
  num AS (SELECT series_id, ds, contagion_risk + 1 AS y, CAST(row_number() OVER ({BY}) AS DOUBLE) AS t FROM panel),
  cen AS (SELECT *, t - avg(t) OVER (PARTITION BY series_id) AS u FROM num),
  fit AS (SELECT series_id, regr_slope(y, t) b, regr_intercept(y, t) a, regr_slope(y, u) b1, regr_slope(y, u*u) b2, avg(y) mu, avg(u*u) mq FROM cen GROUP BY 1)""", q=f"""
  SELECT series_id, ds, y-(a+b*t) AS linear, y-(mu+b1*u+b2*(u*u-mq)) AS quadratic, y-lag(y) OVER ({BY}) AS first, ln(y)-ln(lag(y) OVER ({BY})) AS log_first FROM cen JOIN fit USING (series_id)"""))
def win_detrend(spark, d):
    p = tb.panel(spark, d).select("series_id", "ds", (F.col("contagion_risk") + 1).alias("y"))
    for how, name in (("linear", "linear"), ("quadratic", "quadratic"), ("difference", "first"), ("log_difference", "log_first")):
        p = paths.detrend(p, "y", how).withColumnRenamed("out", name)
    return p.drop("y")
