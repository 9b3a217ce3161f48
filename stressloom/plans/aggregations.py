"""Queries over aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stressloom.functions.stats import corr
from stressloom import schema as S
from stressloom.functions import scoring as fn
from stressloom.operators import aggregates as ag
from stressloom.operators import channels as ch
from stressloom.operators import eventjoin as ev
from stressloom.operators import grids
from stressloom.operators import windows as win
from stressloom.plans.registry import query
from stressloom.plans.scalars import AUDIT, BAND4, BAND5, PLAIN_TERMS, SHARE_RISK, _hits, n100
from stressloom.plans.sqltext import COINS, DAILY_ORDERS, EVENTS_DIM, HEADLINES, PANEL, PEG_POINTS, PROTOCOLS, REVENUE, W
from stressloom.sources import tables as tb

CHS = "(VALUES ('stablecoin_risk'),('defi_liquidity_risk'),('contagion_risk'),('arbitrage_opacity')) c(channel)"
LONG = f"""long AS (SELECT series_id, ds, channel, CASE channel WHEN 'stablecoin_risk' THEN stablecoin_risk WHEN 'defi_liquidity_risk' THEN defi_liquidity_risk
  WHEN 'contagion_risk' THEN contagion_risk ELSE arbitrage_opacity END AS value FROM panel CROSS JOIN {CHS})"""
PAIRS = """pairs AS (SELECT a.series_id, a.ds, a.channel AS ch_a, b.channel AS ch_b, a.value AS x, b.value AS y FROM long a JOIN long b
  ON a.series_id=b.series_id AND a.ds=b.ds AND (a.channel, b.channel) IN (('stablecoin_risk','defi_liquidity_risk'),('stablecoin_risk','contagion_risk'),
  ('stablecoin_risk','arbitrage_opacity'),('defi_liquidity_risk','contagion_risk'),('defi_liquidity_risk','arbitrage_opacity'),('contagion_risk','arbitrage_opacity')))"""
RETS = """rets AS (SELECT * FROM (SELECT series_id, ds, idx, idx/lag(idx) OVER (PARTITION BY series_id ORDER BY ds) - 1 AS ret FROM panel) WHERE ret IS NOT NULL)"""
SYS = """paired AS (SELECT a.series_id, a.ds, a.ret AS asset, s.ret AS system FROM rets a JOIN rets s ON a.ds = s.ds AND s.series_id = 'MACHINERY' AND a.series_id <> 'MACHINERY')"""


def pair_returns(spark, d):
    return ag.pair_with(ag.returns(tb.stored_panel(spark, d)), "MACHINERY")


@query("agg_hhi", "hhi", W(REVENUE, q="SELECT month, 10000*sum(cents*cents)/(sum(cents)*sum(cents)) AS hhi FROM revenue GROUP BY month"))
def agg_hhi(spark, d):
    return ch.concentration(tb.supplier_revenue(spark, d), ["month"], "cents")


@query("agg_top10_hhi", "hhi", W(REVENUE, q="""
  SELECT month, 10000*sum(cents*cents)/(sum(cents)*sum(cents)) AS hhi FROM (
    SELECT *, row_number() OVER (PARTITION BY month ORDER BY cents DESC, supplier) rn FROM revenue) WHERE rn <= 10 GROUP BY month"""))
def agg_top10_hhi(spark, d):
    top = ch.top_k(tb.supplier_revenue(spark, d), ["month"], "cents", 10, "supplier")
    return ch.concentration(top, ["month"], "cents")


@query("agg_top2_share", "share risk", W(REVENUE, q=f"""
  SELECT month, s AS share, {n100('s', 50, 100)} AS risk FROM (
   SELECT month, sum(cents) FILTER (WHERE rn <= 2)/sum(cents)*100 AS s FROM (
    SELECT *, row_number() OVER (PARTITION BY month ORDER BY cents DESC, supplier) rn FROM revenue) GROUP BY month)"""))
def agg_top2_share(spark, d):
    r = tb.supplier_revenue(spark, d)
    top = ch.top_k(r, ["month"], "cents", 2, "supplier").groupBy("month").agg(F.sum("cents").alias("top"))
    share = r.groupBy("month").agg(F.sum("cents").alias("total")).join(top, "month")
    share = share.select("month", (F.col("top") / F.col("total") * 100.0).alias("share"))
    return share.withColumn("risk", fn.scale_100("share", 50, 100))


@query("agg_weighted_peg_deviation", "deviation risk", W(COINS, q=f"""
  SELECT dev AS deviation, {n100('dev*100', 0, 5)} AS risk FROM (SELECT sum(peg_deviation*circulating)/sum(circulating) AS dev FROM coins WHERE circulating > 0)"""))
def agg_weighted_peg_deviation(spark, d):
    c = tb.coins(spark, d)
    dev = F.sum(F.col("peg_deviation") * F.col("circulating")) / F.sum("circulating")
    return c.filter(F.col("circulating") > 0).groupBy().agg(dev.alias("deviation"), ch.weighted_peg().alias("risk"))


@query("agg_audit_ratio", "risk", W(PROTOCOLS, q=f"SELECT category, (1-avg({AUDIT}))*100 AS risk FROM protocols WHERE tvl > 0 GROUP BY category"))
def agg_audit_ratio(spark, d):
    return ch.positive_tvl(tb.protocols(spark, d)).groupBy("category").agg(((1.0 - ch.audit_ratio()) * 100.0).alias("risk"))


@query("agg_avg_abs_change", "change risk", W(PROTOCOLS, q=f"""
  SELECT category, avg(abs(coalesce(change_1d,0))) AS change, {n100('avg(abs(coalesce(change_1d,0)))', 0, 20)} AS risk FROM protocols WHERE tvl > 0 GROUP BY category"""))
def agg_avg_abs_change(spark, d):
    return ch.positive_tvl(tb.protocols(spark, d)).groupBy("category").agg(
        ch.mean_abs_change().alias("change"), fn.scale_100(ch.mean_abs_change(), 0, 20).alias("risk"))


@query("agg_category_share", "lending rwa lending_risk rwa_risk", W(PROTOCOLS, q=f"""
  SELECT l AS lending, r AS rwa, {n100('l',0,30)} AS lending_risk, {n100('r',0,10)} AS rwa_risk FROM (
   SELECT sum(tvl) FILTER (WHERE category='Lending')/sum(tvl)*100 AS l, sum(tvl) FILTER (WHERE category='RWA')/sum(tvl)*100 AS r FROM protocols WHERE tvl > 0)"""))
def agg_category_share(spark, d):
    g = ch.positive_tvl(tb.protocols(spark, d)).groupBy().agg(
        ch.category_share("Lending", 10.0).alias("lending"), ch.category_share("RWA", 0.0).alias("rwa"))
    return g.select("lending", "rwa", fn.scale_100("lending", 0, 30).alias("lending_risk"), fn.scale_100("rwa", 0, 10).alias("rwa_risk"))


@query("agg_count_significant", "risk", W(REVENUE, q="""
  SELECT month, n, CASE WHEN n < 3 THEN 70.0 WHEN n < 10 THEN 30.0 ELSE 50.0+(n-10)*2 END AS risk FROM (
   SELECT month, count(*) FILTER (WHERE cents > 3.5e7) AS n FROM revenue GROUP BY month)"""))
def agg_count_significant(spark, d):
    g = tb.supplier_revenue(spark, d).groupBy("month").agg(F.count_if(F.col("cents") > 3.5e7).alias("n"))
    return g.withColumn("risk", ch.issuer_risk(F.col("n")))


@query("agg_coeff_variation", "risk", W(DAILY_ORDERS, q=f"""
  SELECT ds, CASE WHEN n > 1 THEN {n100('cv*100',0,20)} ELSE 30.0 END AS risk FROM (
   SELECT ds, count(*) OVER w AS n, stddev_pop(tvl) OVER w/avg(tvl) OVER w AS cv FROM daily_orders
   WINDOW w AS (ORDER BY ds RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW))"""))
def agg_coeff_variation(spark, d):
    w = win.day_range(-29, 0)
    t = tb.daily_orders(spark, d).withColumn("series_id", F.lit("orders"))
    t = t.select("ds", F.count("tvl").over(w).alias("n"), (F.stddev_pop("tvl").over(w) / F.avg("tvl").over(w)).alias("cv"))
    return t.select("ds", F.when(F.col("n") > 1, fn.scale_100(F.col("cv") * 100, 0, 20)).otherwise(30.0).alias("risk"))


MARKET = """coinrows AS (SELECT p_type AS market, (['UST','FRAX','LUSD','RAI','USDT','USDC','GHO','DAI'])[p_partkey % 8 + 1] AS symbol,
  CAST(sum(CAST(round(p_retailprice*100) AS BIGINT)*p_size) AS DOUBLE)/100.0 AS circulating FROM part GROUP BY 1, 2),
 tokens AS (SELECT * FROM (SELECT CASE symbol WHEN 'UST' THEN 'LUNA' WHEN 'FRAX' THEN 'FXS' WHEN 'LUSD' THEN 'ETH' WHEN 'RAI' THEN 'ETH' WHEN 'GHO' THEN 'AAVE' END AS token, circulating FROM coinrows)
   WHERE token IS NOT NULL AND token <> 'AAVE'),
 backing AS (SELECT token, (count(*) % 7)/5.0 AS v, (count(*) % 5)/8.0 AS g FROM tokens GROUP BY token)"""
VOL = "CASE WHEN v IS NULL THEN 50 WHEN v*100 < 30 THEN v*100 WHEN v*100 < 60 THEN v*100 WHEN v*100 < 100 THEN 60+(v*100-60)*0.625 ELSE least(100.0, 85+(v*100-100)*0.15) END"
DIL = "CASE WHEN g IS NULL THEN 30 WHEN g*100 < 5 THEN g*400 WHEN g*100 < 20 THEN 20+(g*100-5)*2 WHEN g*100 < 50 THEN 50+(g*100-20) ELSE least(100.0, 80+(g*100-50)*0.4) END"


def market_coins(spark, d):
    sym = F.element_at(F.array(*[F.lit(s) for s in ["UST", "FRAX", "LUSD", "RAI", "USDT", "USDC", "GHO", "DAI"]]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return tb.read(spark, d, "part").groupBy(F.col("p_type").alias("market"), sym.alias("symbol")).agg(
        (F.sum(F.round(F.col("p_retailprice") * 100).cast("bigint") * F.col("p_size")) / 100.0).alias("circulating"))


@query("agg_algo_risk", "volatility_risk dilution_risk concentration_risk algo_risk algo_weight", W(MARKET, q=f"""
  SELECT market, vr AS volatility_risk, dr AS dilution_risk, {SHARE_RISK.format(s='s')} AS concentration_risk,
    least(100.0, greatest(0.0, 0.35*br + 0.3*vr + 0.2*dr + 0.15*({SHARE_RISK.format(s='s')}))) AS algo_risk, s/100 AS algo_weight FROM (
   SELECT market, coalesce(sum({VOL}*circulating) FILTER (WHERE algo)/sum(circulating) FILTER (WHERE algo), 0) AS vr,
     coalesce(sum({DIL}*circulating) FILTER (WHERE algo)/sum(circulating) FILTER (WHERE algo), 0) AS dr,
     CASE WHEN count(*) FILTER (WHERE algo) > 0 THEN 50.0 ELSE 0 END AS br,
     coalesce(sum(circulating) FILTER (WHERE algo),0)/sum(circulating)*100 AS s FROM (
    SELECT c.*, symbol NOT IN ('USDT','USDC') AS algo, v, g FROM coinrows c LEFT JOIN backing b ON b.token =
      CASE symbol WHEN 'UST' THEN 'LUNA' WHEN 'FRAX' THEN 'FXS' WHEN 'LUSD' THEN 'ETH' WHEN 'RAI' THEN 'ETH' WHEN 'GHO' THEN 'AAVE' END) GROUP BY market)"""))
def agg_algo_risk(spark, d):
    c = market_coins(spark, d)
    back = (c.select(fn.backing_token("symbol").alias("token")).filter(F.col("token").isNotNull() & (F.col("token") != "AAVE"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
            .select("token", (F.col("n") % 7 / 5.0).alias("volatility_30d"), (F.col("n") % 5 / 8.0).alias("supply_growth_30d")))
    return ch.coin_risk(c, ["market"], back).drop("backing_risk")


M3 = "(sum(value*value*value)/count(*) - 3*avg(value)*sum(value*value)/count(*) + 2*avg(value)^3)"
M2 = "(var_pop(value))"
@query("agg_descriptive", "mean std min q25 median q75 max skew kurt jb jb_p", W(PANEL, LONG, q="""
  SELECT series_id, channel, n, mean, std, mn AS min, q25, med AS median, q75, mx AS max, m3/m2^1.5 AS skew, m4/m2^2-3 AS kurt,
   n/6.0*((m3/m2^1.5)^2 + (m4/m2^2-3)^2/4) AS jb, exp(-n/6.0*((m3/m2^1.5)^2 + (m4/m2^2-3)^2/4)/2) AS jb_p FROM (
   SELECT series_id, channel, count(*) n, avg(value) AS mean, stddev_samp(value) AS std, min(value) mn, quantile_cont(value,0.25) q25, median(value) med,
     quantile_cont(value,0.75) q75, max(value) mx, avg((value-mu)^2) m2, avg((value-mu)^3) m3, avg((value-mu)^4) m4 FROM (
     SELECT *, avg(value) OVER (PARTITION BY series_id, channel) mu FROM long) GROUP BY 1,2) WHERE n >= 3"""), digits=5)
def agg_descriptive(spark, d):
    long = ag.unpivot(tb.panel(spark, d), ["series_id", "ds"], S.CHANNELS)
    return ag.describe(long, ["series_id", "channel"], "value")


TAU = """taus AS (SELECT series_id, ch_a, ch_b, n, (conc)/sqrt((n*(n-1)/2.0-tx)*(n*(n-1)/2.0-ty)) AS tau FROM (
  SELECT a.series_id, a.ch_a, a.ch_b, any_value(a.n) AS n, sum(sign(a.x-b.x)*sign(a.y-b.y)) AS conc, sum(CAST(a.x=b.x AS INT)) AS tx, sum(CAST(a.y=b.y AS INT)) AS ty
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id, ch_a, ch_b) n FROM pairs) a JOIN pairs b ON a.series_id=b.series_id AND a.ch_a=b.ch_a AND a.ch_b=b.ch_b AND a.ds < b.ds GROUP BY 1,2,3))"""


@query("agg_kendall_tau", "tau", W(PANEL, LONG, PAIRS, TAU, q="SELECT series_id, ch_a, ch_b, n, tau FROM taus"))
def agg_kendall_tau(spark, d):
    return ag.kendall(ag.channel_pairs(tb.panel(spark, d), ["series_id", "ds"]), ["series_id", "ch_a", "ch_b"])


AVGRANK = "rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1)/2.0"
@query("agg_correlation_p", "r t", W(PANEL, LONG, PAIRS, TAU, f"""ranked AS (SELECT series_id, ch_a, ch_b,
    {AVGRANK.format(k='series_id, ch_a, ch_b', x='x')} AS x, {AVGRANK.format(k='series_id, ch_a, ch_b', x='y')} AS y FROM pairs)""", q="""
  SELECT *, r*sqrt((n-2)/(1-r*r)) AS t FROM (
   SELECT series_id, ch_a, ch_b, 'pearson' AS method, count(*) AS n, corr(x,y) AS r FROM pairs GROUP BY 1,2,3
   UNION ALL SELECT series_id, ch_a, ch_b, 'spearman', count(*), corr(x,y) FROM ranked GROUP BY 1,2,3)
  UNION ALL SELECT series_id, ch_a, ch_b, 'kendall', n, tau, tau/sqrt(2*(2*n+5)/(9.0*n*(n-1))) FROM taus"""))
def agg_correlation_p(spark, d):
    return _corr_all(spark, d)


def _corr_all(spark, d):
    pairs = ag.channel_pairs(tb.stored_panel(spark, d), ["series_id", "ds"])
    keys = ["series_id", "ch_a", "ch_b"]
    parts = [ag.correlations(pairs, keys, m).withColumn("method", F.lit(m)) for m in ("pearson", "spearman", "kendall")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("agg_returns_correlation", "r", W(PANEL, q="""
  SELECT series_id, CASE WHEN count(*) < 2 THEN 0 ELSE corr(r1, r2) END AS r FROM (
   SELECT a.series_id, a.idx/lag(a.idx) OVER (PARTITION BY a.series_id ORDER BY a.ds)-1 AS r1, b.idx/lag(b.idx) OVER (PARTITION BY a.series_id ORDER BY a.ds)-1 AS r2
   FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) p FROM panel WHERE series_id <> 'MACHINERY') a
   JOIN (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) p FROM panel WHERE series_id = 'MACHINERY') b USING (p))
  WHERE r1 IS NOT NULL AND r2 IS NOT NULL GROUP BY 1"""))
def agg_returns_correlation(spark, d):
    from stressloom.operators.align import tail_aligned_correlation
    p = tb.panel(spark, d)
    return tail_aligned_correlation(p, "MACHINERY", "idx")


@query("agg_quantile", "q90 var_historical var_parametric", W(PANEL, RETS, q="""
  SELECT series_id, quantile_cont(idx, 0.9) AS q90, quantile_cont(ret, 0.05) AS var_historical, avg(ret) + stddev_samp(ret)*(-1.6448536269514729) AS var_parametric
  FROM rets GROUP BY 1"""))
def agg_quantile(spark, d):
    return ag.returns(tb.panel(spark, d)).groupBy("series_id").agg(
        F.percentile("idx", 0.9).alias("q90"), F.percentile("ret", 0.05).alias("var_historical"),
        (F.avg("ret") + F.stddev_samp("ret") * F.lit(-1.6448536269514729)).alias("var_parametric"))


COVAR = """th AS (SELECT series_id, count(*) n, quantile_cont(system,0.05) vs, quantile_cont(asset,0.05) q0, quantile_cont(asset,0.1) q1, quantile_cont(asset,0.4) q4, quantile_cont(asset,0.6) q6 FROM paired GROUP BY 1),
 cov AS (SELECT series_id, any_value(n) n, any_value(vs) vs, CASE WHEN count(*) FILTER (WHERE asset<=q0) < 10 THEN quantile_cont(system,0.05) FILTER (WHERE asset<=q1) ELSE quantile_cont(system,0.05) FILTER (WHERE asset<=q0) END cd,
   quantile_cont(system,0.05) FILTER (WHERE asset>=q4 AND asset<=q6) cm FROM paired JOIN th USING (series_id) WHERE n >= 50 GROUP BY 1)"""


@query("agg_covar_historical", "var_system covar_distress covar_median delta_covar", W(PANEL, RETS, SYS, COVAR, q="""
  SELECT series_id, n, vs AS var_system, cd AS covar_distress, cm AS covar_median, cd-cm AS delta_covar FROM cov"""))
def agg_covar_historical(spark, d):
    return ag.covar_historical(pair_returns(spark, d))


TD = f"""td AS (SELECT series_id, count(*) FILTER (WHERE u>0.9 AND v>0.9)/count(*) FILTER (WHERE u>0.9) AS up, count(*) FILTER (WHERE u<0.1 AND v<0.1)/count(*) FILTER (WHERE u<0.1) AS lo FROM (
  SELECT series_id, ({AVGRANK.format(k='series_id', x='asset')})/(count(*) OVER (PARTITION BY series_id)+1) u, ({AVGRANK.format(k='series_id', x='system')})/(count(*) OVER (PARTITION BY series_id)+1) v FROM paired) GROUP BY 1)"""


@query("agg_tail_dependence", "upper_tail lower_tail asymmetry", W(PANEL, RETS, SYS, TD, q="SELECT series_id, up AS upper_tail, lo AS lower_tail, abs(up-lo) AS asymmetry FROM td"))
def agg_tail_dependence(spark, d):
    return ag.tail_dependence(pair_returns(spark, d), ["series_id"], "asset", "system")


@query("agg_tail_risk_score", "score", W(PANEL, RETS, SYS, COVAR, TD, q="""
  SELECT series_id, least(1.0, (0.6*abs((cd-cm)/vs) + 0.4*(up+lo)/2)/0.4)*100 AS score FROM td JOIN cov USING (series_id)"""))
def agg_tail_risk_score(spark, d):
    return ag.tail_risk_score(pair_returns(spark, d))


@query("agg_kpi", "volatility spread percentile", W(PANEL, q="""
  SELECT p.series_id, any_value(v) AS volatility, max(idx)-min(idx) AS spread, count(*) FILTER (WHERE idx>=50) AS elevated_days,
    count(*) FILTER (WHERE idx>=70) AS critical_days, count(*) FILTER (WHERE idx <= cur)*100.0/count(*) AS percentile
  FROM panel p JOIN (SELECT series_id, stddev_samp(dx) FILTER (WHERE rn <= 30) AS v, any_value(idx) FILTER (WHERE rn=1) AS cur FROM (
     SELECT series_id, idx, idx-lag(idx) OVER (PARTITION BY series_id ORDER BY ds) dx, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) rn FROM panel) GROUP BY 1) k
  ON p.series_id=k.series_id GROUP BY 1"""))
def agg_kpi(spark, d):
    asc, desc = win.by_day(), Window.partitionBy("series_id").orderBy(F.desc("ds"))
    p = tb.panel(spark, d).select("series_id", "idx", (F.col("idx") - F.lag("idx").over(asc)).alias("dx"),
                                  F.row_number().over(desc).alias("rn"), F.first("idx").over(desc).alias("cur"))
    return p.groupBy("series_id").agg(
        F.stddev_samp(F.when(F.col("rn") <= 30, F.col("dx"))).alias("volatility"), (F.max("idx") - F.min("idx")).alias("spread"),
        F.count_if(F.col("idx") >= 50).alias("elevated_days"), F.count_if(F.col("idx") >= 70).alias("critical_days"),
        (F.count_if(F.col("idx") <= F.col("cur")) * 100.0 / F.count(F.lit(1))).alias("percentile"))


@query("agg_contribution", "weighted share", W(PANEL, LONG, q="""
  SELECT series_id, channel, weighted, weighted/sum(weighted) OVER (PARTITION BY series_id)*100 AS share, row_number() OVER (PARTITION BY series_id ORDER BY weighted DESC, channel) AS place FROM (
   SELECT series_id, channel, value*CASE channel WHEN 'stablecoin_risk' THEN 0.3 WHEN 'arbitrage_opacity' THEN 0.2 ELSE 0.25 END AS weighted FROM long
   JOIN (SELECT series_id, max(ds) ds FROM panel GROUP BY 1) USING (series_id, ds))"""))
def agg_contribution(spark, d):
    latest = tb.panel(spark, d).groupBy("series_id").agg(*[F.max_by(c, "ds").alias(c) for c in S.CHANNELS])
    long = ag.unpivot(latest, ["series_id"], S.CHANNELS)
    w = F.create_map(*[F.lit(x) for kv in S.CHANNEL_WEIGHTS.items() for x in kv])
    long = long.select("series_id", "channel", (F.col("value") * w[F.col("channel")]).alias("weighted"))
    by = Window.partitionBy("series_id")
    return long.withColumn("share", F.col("weighted") / F.sum("weighted").over(by) * 100.0).withColumn(
        "place", F.row_number().over(by.orderBy(F.desc("weighted"), "channel")))


@query("agg_tier_distribution", "", W(PANEL, q=f"SELECT series_id, {BAND4.format(x='idx')} AS tier, count(*) AS days FROM panel GROUP BY 1, 2"))
def agg_tier_distribution(spark, d):
    return tb.panel(spark, d).groupBy("series_id", fn.alert_four("idx").alias("tier")).agg(F.count(F.lit(1)).alias("days"))


@query("agg_news_score", "avg_sentiment reg_score market_mood score", W(HEADLINES, q=f"""
  SELECT source, article_count, regulatory_count, avg_sentiment, reg_score, (1-avg_sentiment)/2*100 AS market_mood, reg_score*0.7+(1-avg_sentiment)/2*100*0.3 AS score FROM (
   SELECT source, count(*) AS article_count, count(*) FILTER (WHERE h>0) AS regulatory_count, avg(sentiment) AS avg_sentiment,
    coalesce(avg(CASE WHEN neg > 0 THEN least(100.0,(1-sentiment)/2*130) ELSE (1-sentiment)/2*100 END*least(h/5.0,1.0)) FILTER (WHERE h>0), 50) AS reg_score FROM (
     SELECT *, {_hits(PLAIN_TERMS)} AS h, {_hits(S.NEGATIVE_TERMS)} AS neg FROM headlines) GROUP BY source)"""))
def agg_news_score(spark, d):
    return ag.news_score(tb.headlines(spark, d), ["source"], PLAIN_TERMS, S.NEGATIVE_TERMS)


@query("agg_daily_median", "price", W(PEG_POINTS, q="SELECT symbol, CAST(ts AS DATE) AS ds, median(price) AS price FROM peg_points GROUP BY 1, 2"))
def agg_daily_median(spark, d):
    from stressloom.operators.bars import daily_median
    return daily_median(tb.peg_points(spark, d))


LABELLED = """labelled AS (SELECT p.*, CAST(EXISTS (SELECT 1 FROM events_dim e WHERE e.event_date >= p.ds AND e.event_date - p.ds <= 30) AS INT) AS label FROM panel p)"""
RATIOS = """CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END AS precision, CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END AS recall, CASE WHEN tn+fp>0 THEN tn/(tn+fp) ELSE 0 END AS specificity,
   CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END AS f1"""
CONF = """conf AS (SELECT series_id, threshold, count(*) FILTER (WHERE label=1 AND idx>=threshold) tp, count(*) FILTER (WHERE label=0 AND idx>=threshold) fp,
   count(*) FILTER (WHERE label=0 AND idx<threshold) tn, count(*) FILTER (WHERE label=1 AND idx<threshold) fn
  FROM labelled CROSS JOIN (VALUES (40.0),(50.0),(60.0),(70.0)) v(threshold) GROUP BY 1,2)"""


@query("agg_confusion", "threshold precision recall specificity f1 youden balanced mcc", W(PANEL, EVENTS_DIM, LABELLED, CONF, q=f"""
  SELECT *, recall+specificity-1 AS youden, (recall+specificity)/2 AS balanced,
   CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) > 0 THEN (tp*tn-fp*fn)/sqrt(CAST(tp+fp AS DOUBLE)*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0 END AS mcc FROM (
   SELECT series_id, threshold, tp, fp, tn, fn, {RATIOS} FROM conf)"""))
def agg_confusion(spark, d):
    lab = ev.lead_label(tb.panel(spark, d), tb.events_dim(spark))
    g = grids.explode_grid(lab, [dict(threshold=t) for t in (40.0, 50.0, 60.0, 70.0)])
    return ag.confusion(g, ["series_id", "threshold"], "label", F.col("idx") >= F.col("threshold"))


REGIME = "CASE WHEN idx >= 55 THEN 2 WHEN idx >= 40 THEN 1 ELSE 0 END"
@query("agg_regime_profile", "frequency level mean_idx persistence", W(PANEL, q=f"""
  SELECT series_id, regime, n*1.0/sum(n) OVER (PARTITION BY series_id) AS frequency, level, mean_idx, stay*1.0/moves AS persistence FROM (
   SELECT series_id, regime, count(*) n, avg((stablecoin_risk+defi_liquidity_risk+contagion_risk+arbitrage_opacity)/4) AS level, avg(idx) mean_idx,
     count(*) FILTER (WHERE nxt = regime) stay, count(nxt) moves FROM (
     SELECT *, lead(regime) OVER (PARTITION BY series_id ORDER BY ds) nxt FROM (SELECT *, {REGIME} AS regime FROM panel)) GROUP BY 1,2)"""))
def agg_regime_profile(spark, d):
    from stressloom.operators.regime_stats import regime_profile
    return regime_profile(tb.panel(spark, d).withColumn("regime", _regime()))


def _regime():
    return F.when(F.col("idx") >= 55, 2).when(F.col("idx") >= 40, 1).otherwise(0)


METH = """meth AS (SELECT series_id, ds, method, CASE method WHEN 'linear' THEN idx WHEN 'max' THEN greatest(stablecoin_risk,defi_liquidity_risk,contagion_risk,arbitrage_opacity)
   ELSE exp(0.3*ln(greatest(stablecoin_risk,1e-6))+0.25*ln(greatest(defi_liquidity_risk,1e-6))+0.25*ln(greatest(contagion_risk,1e-6))+0.2*ln(greatest(arbitrage_opacity,1e-6))) END AS value
  FROM panel CROSS JOIN (VALUES ('linear'),('max'),('geometric')) m(method))"""
CRISIS = """crisis AS (SELECT series_id, event, method, CAST(nb > 0 AS INT) AS detected, CASE WHEN nb > 0 THEN lead ELSE 0 END AS lead_time, peak, cas, CASE WHEN sd > 0 THEN cas/(sd*sqrt(np)) ELSE cas END AS t_stat FROM (
  SELECT series_id, event, method, count(*) FILTER (WHERE rel >= -30 AND value > 70) nb, -min(rel) FILTER (WHERE rel >= -30 AND value > 70) AS lead, max(value) FILTER (WHERE rel >= -30) AS peak,
    sum(value) FILTER (WHERE rel >= -30) - count(*) FILTER (WHERE rel >= -30)*avg(value) FILTER (WHERE rel < -30) AS cas, stddev_samp(value) FILTER (WHERE rel < -30) AS sd,
    count(*) FILTER (WHERE rel >= -30) np, count(*) FILTER (WHERE rel < -30) nbase
  FROM (SELECT m.*, event, ds - event_date AS rel FROM meth m JOIN events_dim e ON ds BETWEEN event_date - 90 AND event_date - 1) GROUP BY 1,2,3) WHERE nbase >= 10 AND np >= 5)"""


def method_frame(spark, d):
    from stressloom.operators import compose
    return compose.load_methods(tb.stored_panel(spark, d), ["linear", "max", "geometric"])


@query("agg_method_summary", "detected lead t peak", W(PANEL, EVENTS_DIM, METH, CRISIS, q="""
  SELECT method, avg(detected) AS detected, avg(lead_time) AS lead, avg(t_stat) AS t, avg(peak) AS peak,
    rank() OVER (ORDER BY round(avg(detected),9) DESC) AS detection_rank FROM crisis GROUP BY method"""))
def agg_method_summary(spark, d):
    from stressloom.operators import compose
    return compose.method_summary(compose.crisis_metrics(method_frame(spark, d), tb.events_dim(spark)))


@query("agg_correlation_by_regime", "r", W(PANEL, METH, q=f"""
  SELECT a.series_id, regime, a.method AS m_a, b.method AS m_b, corr(a.value, b.value) AS r, count(*) AS n FROM meth a JOIN meth b
   ON a.series_id=b.series_id AND a.ds=b.ds AND (a.method, b.method) IN (('linear','max'),('linear','geometric'),('max','geometric'))
   JOIN (SELECT series_id, ds, {REGIME} AS regime FROM panel) g ON a.series_id=g.series_id AND a.ds=g.ds GROUP BY 1,2,3,4 HAVING count(*) > 10"""))
def agg_correlation_by_regime(spark, d):
    from stressloom.operators import compose
    wide = compose.methods_wide(tb.panel(spark, d).withColumn("regime", _regime()), ["linear", "max", "geometric"], keep=["regime"])
    pairs = ag.channel_pairs(wide, ["series_id", "regime"], ["linear", "max", "geometric"])
    return (pairs.groupBy("series_id", "regime", F.col("ch_a").alias("m_a"), F.col("ch_b").alias("m_b"))
            .agg(corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 10))


@query("agg_backtest_summary", "first peak last channel_at_peak", W(PANEL, EVENTS_DIM, q=f"""
  SELECT series_id, event, first, peak, last, peak_alert, lvl >= want - 1 AND peak > 1.1*first AS passed, s AS channel_at_peak FROM (
   SELECT series_id, event, arg_min(idx, ds) AS first, max(idx) AS peak, arg_max(idx, ds) AS last,
     {BAND5.format(x='max(idx)')} AS peak_alert, CASE WHEN max(idx)>=95 THEN 4 WHEN max(idx)>=85 THEN 3 WHEN max(idx)>=70 THEN 2 WHEN max(idx)>=50 THEN 1 ELSE 0 END AS lvl,
     CASE any_value(expected_level) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 2 END AS want, arg_max(stablecoin_risk, (idx, -CAST(ds - event_date AS INT))) AS s
   FROM panel JOIN events_dim ON ds BETWEEN event_date - 5 AND event_date + 9 GROUP BY 1,2)"""))
def agg_backtest_summary(spark, d):
    from stressloom.operators import event_study as es
    out = es.backtest(tb.panel(spark, d), tb.events_dim(spark), 5, 9)
    return out.select("series_id", "event", "first", "peak", "last", "peak_alert", "passed", F.col("at_peak.stablecoin_risk").alias("channel_at_peak"))
