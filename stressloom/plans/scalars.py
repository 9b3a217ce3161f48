"""Queries over column expressions: scaling, bands, coin rules, headlines, channel formulas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stressloom.functions.stats import corr
from stressloom import schema as S
from stressloom.functions import scoring as fn
from stressloom.operators import channels as ch
from stressloom.operators import windows as win
from stressloom.plans.registry import query
from stressloom.plans.sqltext import (
    COINS, DAILY_ORDERS, HEADLINES, PANEL, PROTOCOLS, REVENUE, W,
)
from stressloom.sources import tables as tb

BAND4 = "CASE WHEN {x} >= 70 THEN 'high' WHEN {x} >= 50 THEN 'elevated' WHEN {x} >= 30 THEN 'moderate' ELSE 'low' END"
BAND5 = ("CASE WHEN {x} >= 95 THEN 'critical' WHEN {x} >= 85 THEN 'high' WHEN {x} >= 70 THEN 'elevated' "
         "WHEN {x} >= 50 THEN 'moderate' ELSE 'low' END")


def n100(x, lo, hi):
    return f"least(greatest(({x} - {lo})/CAST({hi}-{lo} AS DOUBLE)*100.0, 0.0), 100.0)"


HHI_RISK = ("CASE WHEN {h} < 1500 THEN {h}*(30.0/1500) WHEN {h} < 2500 THEN 30 + ({h}-1500)*0.03 "
            "WHEN {h} < 5000 THEN 60 + ({h}-2500)*0.012 ELSE 90 + ({h}-5000)*0.002 END")
SHARE_RISK = ("CASE WHEN {s} < 5 THEN {s}*4 WHEN {s} < 15 THEN 20+({s}-5)*3 WHEN {s} < 30 THEN 50+({s}-15)*2 "
              "ELSE least(100.0, 80+({s}-30)*0.67) END")


@query("idx_daily_board", "idx avg_30", W(PANEL, q=f"""
  SELECT series_id, ds, idx, a AS avg_30, {BAND4.format(x='idx')} AS alert_level,
    CASE WHEN idx - a > 2 THEN 'rising' WHEN idx - a < -2 THEN 'falling' ELSE 'stable' END AS trend
  FROM (SELECT *, avg(idx) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) a FROM panel)"""))
def idx_daily_board(spark, d):
    return win.board(tb.panel(spark, d))


@query("fn_normalize_100", "scaled flat", W(PANEL, q=f"""
  SELECT series_id, ds, {n100('contagion_risk', 20, 80)} AS scaled, 50.0 AS flat FROM panel"""))
def fn_normalize_100(spark, d):
    return tb.panel(spark, d).select(
        "series_id", "ds", fn.scale_100("contagion_risk", 20, 80).alias("scaled"), fn.scale_100("idx", 5, 5).alias("flat"))


@query("fn_hhi_to_risk", "risk", W(REVENUE, q=f"""
  SELECT month, {HHI_RISK.format(h='h')} AS risk FROM (
    SELECT month, 10000*sum(cents*cents)/(sum(cents)*sum(cents)) AS h FROM revenue GROUP BY month)"""))
def fn_hhi_to_risk(spark, d):
    r = tb.supplier_revenue(spark, d)
    return ch.concentration(r, ["month"], "cents").select("month", fn.hhi_risk("hhi").alias("risk"))


@query("fn_tvl_risk", "risk", W(DAILY_ORDERS, q=f"""
  SELECT ds, {n100("1 - CASE WHEN m > 0 THEN tvl/m ELSE 0.5 END", 0, 0.5)} AS risk FROM (
    SELECT ds, tvl, max(tvl) OVER (ORDER BY ds RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW) m FROM daily_orders)"""))
def fn_tvl_risk(spark, d):
    t = win.trailing_days(tb.daily_orders(spark, d).withColumn("series_id", F.lit("orders")), 365, m=F.max("tvl"))
    return t.select("ds", fn.tvl_risk("tvl", "m").alias("risk"))


@query("fn_bank_exposure", "risk", W(PANEL, q=f"""
  SELECT series_id, ds, {n100('y',2,6)}*0.6 + {n100('v',12,40)}*0.4 AS risk FROM (
    SELECT series_id, ds, 1.5 + stablecoin_risk/20 AS y, contagion_risk/2 AS v FROM panel)"""))
def fn_bank_exposure(spark, d):
    return tb.panel(spark, d).select("series_id", "ds", fn.bank_exposure(
        F.lit(1.5) + F.col("stablecoin_risk") / 20, F.col("contagion_risk") / 2).alias("risk"))


@query("fn_yield_curve_linkage", "risk", W(PANEL, q=f"""
  SELECT series_id, ds, CASE WHEN s < 0 THEN {n100('abs(s)',0,2)} + 50 ELSE greatest(0.0, 50 - {n100('s',0,2)}) END AS risk
  FROM (SELECT series_id, ds, (contagion_risk - 50)/20 AS s FROM panel)"""))
def fn_yield_curve_linkage(spark, d):
    return tb.panel(spark, d).select("series_id", "ds", fn.curve_linkage((F.col("contagion_risk") - 50) / 20).alias("risk"))


@query("fn_correlation_risk", "risk", W(PANEL, q=f"""
  SELECT series_id, {n100('abs(c)',0,1)} AS risk FROM (
    SELECT series_id, corr(stablecoin_risk, contagion_risk) AS c FROM panel GROUP BY 1)"""))
def fn_correlation_risk(spark, d):
    c = tb.panel(spark, d).groupBy("series_id").agg(corr("stablecoin_risk", "contagion_risk").alias("c"))
    return c.select("series_id", fn.correlation_risk("c").alias("risk"))


@query("fn_bridge_risk", "risk", W(PROTOCOLS, q=f"""
  SELECT category, {n100('count(*)',0,150)} AS risk FROM protocols GROUP BY category"""))
def fn_bridge_risk(spark, d):
    return tb.protocols(spark, d).groupBy("category").agg(fn.bridge_risk(F.count(F.lit(1))).alias("risk"))


STABLE_SQL = f"""SELECT {n100('1-0.8', 0, 0.5)} AS tvl_ratio, {n100('3.5', 2, 6)} AS treasury_stress,
    {HHI_RISK.format(h='h')} AS concentration_hhi, {n100('dev*100', 0, 5)} AS peg_volatility, algo_risk, algo_weight
  FROM (SELECT 10000*sum(circulating*circulating) FILTER (WHERE circulating>0)/(sum(circulating) FILTER (WHERE circulating>0))^2 AS h,
          sum(peg_deviation*circulating)/sum(circulating) AS dev FROM coins), algo"""
# every brand symbol is unknown to the coin map, so all supply is non-fiat and every component takes its default
ALGO = f"""algo AS (SELECT least(100.0, greatest(0.0, 0.35*50 + 0.30*50 + 0.20*30 + 0.15*{SHARE_RISK.format(s='100.0')})) AS algo_risk,
  1.0 AS algo_weight)"""


@query("fn_transform_stablecoin", "tvl_ratio treasury_stress concentration_hhi peg_volatility algo_risk algo_weight",
       W(COINS, ALGO, q=STABLE_SQL))
def fn_transform_stablecoin(spark, d):
    return ch.stablecoin_inputs(tb.coins(spark, d), F.lit(0.8), F.lit(1.0), F.lit(3.5))


AUDIT = "(CASE WHEN audits IS NULL THEN 0 WHEN TRY_CAST(audits AS BIGINT) IS NOT NULL THEN CAST(TRY_CAST(audits AS BIGINT) > 0 AS INT) ELSE CAST(length(audits) > 0 AS INT) END)"
LIQ_CTES = f"""live AS (SELECT * FROM protocols WHERE coalesce(tvl,0) > 0),
 top10 AS (SELECT tvl FROM live ORDER BY tvl DESC LIMIT 10),
 hist AS (SELECT stddev_pop(tvl)/avg(tvl) AS cv FROM (SELECT tvl FROM daily_orders ORDER BY ds DESC LIMIT 30))"""


@query("fn_transform_liquidity", "top10_concentration tvl_volatility smart_contract_risk flash_loan_proxy leverage_change",
       W(PROTOCOLS, DAILY_ORDERS, LIQ_CTES, q=f"""
  SELECT (SELECT {HHI_RISK.format(h='h')} FROM (SELECT 10000*sum(tvl*tvl)/(sum(tvl)*sum(tvl)) AS h FROM top10)) AS top10_concentration,
   (SELECT {n100('cv*100',0,20)} FROM hist) AS tvl_volatility,
   (1 - avg({AUDIT}))*100 AS smart_contract_risk, {n100('avg(abs(coalesce(change_1d,0)))',0,20)} AS flash_loan_proxy,
   {n100("sum(tvl) FILTER (WHERE category='Lending')/sum(tvl)*100",0,30)} AS leverage_change FROM live"""))
def fn_transform_liquidity(spark, d):
    hist = tb.daily_orders(spark, d).select(F.lit("orders").alias("series_id"), "ds", "tvl")
    return ch.liquidity_inputs(tb.protocols(spark, d), hist)


@query("fn_transform_contagion", "rwa_growth_rate bank_exposure tradfi_linkage crypto_equity_correlation bridge_exploit_frequency",
       W(PROTOCOLS, q=f"""
  SELECT {n100("coalesce(sum(tvl) FILTER (WHERE category='RWA'),0)/sum(tvl)*100",0,10)} AS rwa_growth_rate,
    {n100('4.2',2,6)}*0.6 + {n100('18',12,40)}*0.4 AS bank_exposure, {n100('0.3',0,2)} + 50 AS tradfi_linkage,
    {n100('0.45',0,1)} AS crypto_equity_correlation, {n100("count(*) FILTER (WHERE category='Bridge')",0,150)} AS bridge_exploit_frequency
  FROM protocols"""))
def fn_transform_contagion(spark, d):
    return ch.contagion_inputs(tb.protocols(spark, d), F.lit(4.2), F.lit(18.0), F.lit(-0.3), F.lit(0.45))


TOP2 = """top2 AS (SELECT sum(circulating) AS t FROM (SELECT circulating FROM coins ORDER BY circulating DESC LIMIT 2))"""
ISSUERS = "CASE WHEN n < 3 THEN 70.0 WHEN n < 10 THEN 30.0 ELSE 50.0 + (n-10)*2 END"


@query("fn_transform_opacity", "unregulated_exposure multi_issuer_risk custody_concentration regulatory_sentiment transparency_score",
       W(COINS, PROTOCOLS, TOP2, q=f"""
  SELECT 35.0 AS unregulated_exposure, {ISSUERS} AS multi_issuer_risk, {n100('share*100',50,100)} AS custody_concentration,
    50.0 AS regulatory_sentiment, (SELECT avg({AUDIT})*100 FROM protocols WHERE tvl > 0) AS transparency_score
  FROM (SELECT count(*) FILTER (WHERE circulating > 1e9) AS n, (SELECT t FROM top2)/sum(circulating) AS share FROM coins)"""))
def fn_transform_opacity(spark, d):
    return ch.opacity_inputs(tb.coins(spark, d), tb.protocols(spark, d), 50.0)


@query("fn_snapshot_inputs", "liquidity contagion opacity", W(PANEL, q="""
  SELECT series_id, ds, variant,
    0.35*coalesce(top10, stablecoin_risk) + 0.25*defi_liquidity_risk + 0.2*coalesce(sc, contagion_risk) + 0.1*30 + 0.1*40 AS liquidity,
    0.3*25 + 0.25*stablecoin_risk + 0.2*defi_liquidity_risk + 0.15*contagion_risk + 0.1*arbitrage_opacity AS contagion,
    0.25*35 + 0.25*stablecoin_risk + 0.2*defi_liquidity_risk + 0.15*40 + 0.15*coalesce(tr, contagion_risk) AS opacity
  FROM panel CROSS JOIN (VALUES ('service', NULL, NULL, NULL), ('standalone', 45.0, 35.0, 70.0)) v(variant, top10, sc, tr)"""))
def fn_snapshot_inputs(spark, d):
    c = F.col
    p = tb.panel(spark, d).withColumns(dict(top10_concentration=c("stablecoin_risk"), smart_contract_risk=c("contagion_risk"),
                                            transparency_score=c("contagion_risk")))
    p = ch.with_snapshot_constants(p)
    pick = lambda weights, **given: fn.weighted_sum({k: given.get(k, c(k) if k in ch.SNAPSHOT_FIELDS else None) for k in weights}, weights)
    liq = pick(S.LIQUIDITY_INPUT_WEIGHTS, tvl_volatility=c("defi_liquidity_risk"))
    con = pick(S.CONTAGION_INPUT_WEIGHTS, bank_exposure=c("stablecoin_risk"), tradfi_linkage=c("defi_liquidity_risk"),
               crypto_equity_correlation=c("contagion_risk"), bridge_exploit_frequency=c("arbitrage_opacity"))
    opa = pick(S.OPACITY_INPUT_WEIGHTS, multi_issuer_risk=c("stablecoin_risk"), custody_concentration=c("defi_liquidity_risk"))
    return p.select("series_id", "ds", "variant", liq.alias("liquidity"), con.alias("contagion"), opa.alias("opacity"))


@query("fn_weighted_channel", "plain inverted", W(PANEL, q="""
  SELECT series_id, ds, 0.25*35 + 0.25*stablecoin_risk + 0.2*defi_liquidity_risk + 0.15*50 + 0.15*contagion_risk AS plain,
     0.25*35 + 0.25*stablecoin_risk + 0.2*defi_liquidity_risk + 0.15*50 + 0.15*(100-contagion_risk) AS inverted FROM panel"""))
def fn_weighted_channel(spark, d):
    def score(invert):
        x = F.col("contagion_risk")
        return fn.weighted_sum(dict(unregulated_exposure=F.lit(35.0), multi_issuer_risk=F.col("stablecoin_risk"), custody_concentration=F.col("defi_liquidity_risk"),
                                    transparency_score=100.0 - x if invert else x), S.OPACITY_INPUT_WEIGHTS)
    return tb.panel(spark, d).select("series_id", "ds", score(False).alias("plain"), score(True).alias("inverted"))


@query("fn_channel_formulas", "stable liquidity contagion opacity", W(PANEL, q="""
  SELECT series_id, ds,
    least(100.0, greatest(0.0, 100*(0.4*(a/100) + 0.3*CASE WHEN d > 0 THEN b/d ELSE 0 END + 0.2*c/100 + 0.1*b/100))) AS stable,
    least(100.0, greatest(0.0, 100*(0.35*a + 0.25*b + 0.2*c + 0.1*d + 0.1*a)/100)) AS liquidity,
    least(100.0, greatest(0.0, 100*(0.3*a + 0.25*b + 0.2*c + 0.15*d + 0.1*a)/100)) AS contagion,
    least(100.0, greatest(0.0, 100*(0.25*a/100 + 0.25*b/100 + 0.2*c/100 + 0.15*d/100 + 0.15*(1-a/100)))) AS opacity
  FROM (SELECT series_id, ds, stablecoin_risk a, defi_liquidity_risk b, contagion_risk c, arbitrage_opacity d FROM panel)"""))
def fn_channel_formulas(spark, d):
    a, b, c, o = [F.col(x) / 100.0 for x in S.CHANNELS]
    def inp(weights):
        return dict(zip(weights, [a, b, c, o, a]))
    return tb.panel(spark, d).select(
        "series_id", "ds",
        fn.stablecoin_channel(a, F.lit(1.0), b, o, c, b).alias("stable"),
        fn.fraction_channel(inp(S.LIQUIDITY_INPUT_WEIGHTS), S.LIQUIDITY_INPUT_WEIGHTS).alias("liquidity"),
        fn.fraction_channel(inp(S.CONTAGION_INPUT_WEIGHTS), S.CONTAGION_INPUT_WEIGHTS).alias("contagion"),
        fn.fraction_channel(inp(S.OPACITY_INPUT_WEIGHTS), S.OPACITY_INPUT_WEIGHTS, invert=("transparency_score",)).alias("opacity"))


@query("fn_composite", "idx idx_1", W(PANEL, q="SELECT series_id, ds, idx, round(round(idx, 6), 1) AS idx_1 FROM panel"))
def fn_composite(spark, d):
    return tb.panel(spark, d).select("series_id", "ds", "idx", F.round(F.round("idx", 6), 1).alias("idx_1"))


@query("fn_minmax_history", "idx_scaled", W(PANEL, q="SELECT series_id, ds, 100*(idx-10)/70 AS idx_scaled FROM panel"))
def fn_minmax_history(spark, d):
    return tb.panel(spark, d).select("series_id", "ds", fn.scale_between("idx", F.lit(10.0), F.lit(80.0)).alias("idx_scaled"))


@query("fn_compute_result", "idx idx_scaled", W(PANEL, q=f"""
  SELECT series_id, ds, idx, s AS idx_scaled, {BAND5.format(x='s')} AS alert_level FROM (
    SELECT *, 100*(idx-10)/70 AS s FROM panel)"""))
def fn_compute_result(spark, d):
    p = tb.panel(spark, d).withColumn("idx_scaled", fn.scale_between("idx", F.lit(10.0), F.lit(80.0)))
    return p.select("series_id", "ds", "idx", "idx_scaled", fn.alert_five("idx_scaled").alias("alert_level"))


@query("fn_alert_5", "", W(PANEL, q=f"SELECT series_id, ds, {BAND5.format(x='idx')} AS alert_level FROM panel"))
def fn_alert_5(spark, d):
    return tb.panel(spark, d).select("series_id", "ds", fn.alert_five("idx").alias("alert_level"))


@query("fn_alert_4", "", W(PANEL, q=f"""
  SELECT series_id, ds, {BAND4.format(x='idx')} AS alert_level, replace({BAND4.format(x='idx')}, 'high', 'critical') AS worker_level FROM panel"""))
def fn_alert_4(spark, d):
    return tb.panel(spark, d).select(
        "series_id", "ds", fn.alert_four("idx").alias("alert_level"), fn.alert_four("idx", top="critical").alias("worker_level"))


@query("fn_trend_vs_avg", "", W(PANEL, q="""
  SELECT series_id, ds, CASE WHEN idx - a > 2 THEN 'rising' WHEN idx - a < -2 THEN 'falling' ELSE 'stable' END AS trend FROM (
    SELECT *, avg(idx) OVER (PARTITION BY series_id ORDER BY ds ROWS 29 PRECEDING) a FROM panel)"""))
def fn_trend_vs_avg(spark, d):
    return win.board(tb.panel(spark, d)).select("series_id", "ds", "trend")


@query("fn_trend_vs_last", "", W(PANEL, q="""
  SELECT series_id, ds, CASE WHEN idx > p THEN 'increasing' WHEN idx < p THEN 'decreasing' ELSE 'stable' END AS trend FROM (
    SELECT *, lag(idx) OVER (PARTITION BY series_id ORDER BY ds) p FROM panel)"""))
def fn_trend_vs_last(spark, d):
    return tb.panel(spark, d).select("series_id", "ds", fn.trend_vs_previous("idx", F.lag("idx").over(win.by_day())).alias("trend"))


@query("fn_trend_week", "", W(PANEL, q="""
  SELECT series_id, ds, CASE WHEN p IS NULL THEN 'stable' WHEN idx > p*1.05 THEN 'increasing' WHEN idx < p*0.95 THEN 'decreasing' ELSE 'stable' END AS trend
  FROM (SELECT *, lag(idx, 6) OVER (PARTITION BY series_id ORDER BY ds) p FROM panel)"""))
def fn_trend_week(spark, d):
    return tb.panel(spark, d).select("series_id", "ds", fn.trend_relative("idx", F.lag("idx", 6).over(win.by_day())).alias("trend"))


@query("fn_served_value", "idx", W(PANEL, q="""
  SELECT series_id, ds, CASE WHEN ds < DATE '2001-01-01' THEN round(round(idx,6),1) + 0.5 ELSE round(round(idx,6),1) END AS idx FROM panel"""))
def fn_served_value(spark, d):
    p = tb.panel(spark, d).withColumn("frozen", F.col("ds") < F.lit("2001-01-01").cast("date"))
    stored = F.round(F.round("idx", 6), 1) + 0.5
    return p.select("series_id", "ds", F.when(F.col("frozen"), stored).otherwise(F.round(F.round(fn.composite(), 6), 1)).alias("idx"))


_SYM = ["usdt", "ust", "FRAX", "dai", "lusd", "crvUSD", "fei", "rai", "gho", "zzz"]
_HINT = [None, "peggedUSD", "algorithmic", "crypto-backed", "hybrid", "fiat-backed", "other"]


@query("fn_classify_coin", "", """SELECT p_partkey, CASE
    WHEN upper(sym) IN ('USDT','USDC','BUSD','TUSD','USDP','GUSD','PYUSD') THEN 'fiat-collateral'
    WHEN upper(sym) IN ('UST','USTC','FEI','BEAN','FLOAT') THEN 'algorithmic' WHEN upper(sym) = 'FRAX' THEN 'hybrid'
    WHEN upper(sym) IN ('RAI','LUSD','GHO') THEN 'crypto-collateral'
    WHEN hint LIKE '%fiat%' OR hint LIKE '%usd%' THEN 'fiat-collateral' WHEN hint LIKE '%algo%' THEN 'algorithmic'
    WHEN hint LIKE '%crypto%' THEN 'crypto-collateral' WHEN hint LIKE '%hybrid%' THEN 'hybrid' ELSE 'unknown' END AS mechanism
  FROM (SELECT p_partkey, (['usdt','ust','FRAX','dai','lusd','crvUSD','fei','rai','gho','zzz'])[p_partkey % 10 + 1] AS sym,
     lower(([NULL,'peggedUSD','algorithmic','crypto-backed','hybrid','fiat-backed','other'])[p_partkey % 7 + 1]) AS hint FROM part)""")
def fn_classify_coin(spark, d):
    return _coin_rows(spark, d).select("p_partkey", fn.coin_mechanism("symbol", "hint").alias("mechanism"))


def _coin_rows(spark, d):
    pick = lambda vals, k: F.element_at(F.array(*[F.lit(v) for v in vals]), (F.col("p_partkey") % k + 1).cast("int"))
    return tb.read(spark, d, "part").select("p_partkey", pick(_SYM, 10).alias("symbol"), pick(_HINT, 7).alias("hint"))


@query("fn_backing_token", "", """SELECT p_partkey, CASE upper(sym) WHEN 'UST' THEN 'LUNA' WHEN 'FRAX' THEN 'FXS' WHEN 'FEI' THEN 'TRIBE'
    WHEN 'RAI' THEN 'ETH' WHEN 'LUSD' THEN 'ETH' WHEN 'GHO' THEN 'AAVE' END AS token
  FROM (SELECT p_partkey, (['usdt','ust','FRAX','dai','lusd','crvUSD','fei','rai','gho','zzz'])[p_partkey % 10 + 1] AS sym FROM part)""")
def fn_backing_token(spark, d):
    return _coin_rows(spark, d).select("p_partkey", fn.backing_token("symbol").alias("token"))


@query("fn_backing_ratio_risk", "risk", W(PANEL, q="""
  SELECT series_id, ds, CASE WHEN r IS NULL THEN 50 WHEN r >= 1.5 THEN greatest(0.0, 20-(r-1.5)*20) WHEN r >= 1 THEN 20+(1.5-r)*60
    WHEN r >= 0.8 THEN 50+(1-r)*150 ELSE least(100.0, 80+(0.8-r)*100) END AS risk
  FROM (SELECT series_id, ds, CASE WHEN arbitrage_opacity > 0 THEN stablecoin_risk/40 END AS r FROM panel)"""))
def fn_backing_ratio_risk(spark, d):
    r = F.when(F.col("arbitrage_opacity") > 0, F.col("stablecoin_risk") / 40)
    return tb.panel(spark, d).select("series_id", "ds", fn.backing_ratio_risk(r).alias("risk"))


@query("fn_collateral_vol_risk", "risk", W(PANEL, q="""
  SELECT series_id, ds, CASE WHEN v IS NULL THEN 50 WHEN v < 30 THEN v WHEN v < 60 THEN 30+(v-30) WHEN v < 100 THEN 60+(v-60)*0.625
    ELSE least(100.0, 85+(v-100)*0.15) END AS risk
  FROM (SELECT series_id, ds, CASE WHEN arbitrage_opacity > 0 THEN stablecoin_risk/60*100 END AS v FROM panel)"""))
def fn_collateral_vol_risk(spark, d):
    v = F.when(F.col("arbitrage_opacity") > 0, F.col("stablecoin_risk") / 60)
    return tb.panel(spark, d).select("series_id", "ds", fn.collateral_vol_risk(v).alias("risk"))


@query("fn_dilution_risk", "risk", W(PANEL, q="""
  SELECT series_id, ds, CASE WHEN v IS NULL THEN 30 WHEN v < 5 THEN v*4 WHEN v < 20 THEN 20+(v-5)*2 WHEN v < 50 THEN 50+(v-20)
    ELSE least(100.0, 80+(v-50)*0.4) END AS risk
  FROM (SELECT series_id, ds, CASE WHEN arbitrage_opacity > 0 THEN contagion_risk/80*100 END AS v FROM panel)"""))
def fn_dilution_risk(spark, d):
    g = F.when(F.col("arbitrage_opacity") > 0, F.col("contagion_risk") / 80)
    return tb.panel(spark, d).select("series_id", "ds", fn.dilution_risk(g).alias("risk"))


@query("fn_concentration_risk", "risk", W(REVENUE, q=f"""
  SELECT supplier, month, {SHARE_RISK.format(s='s')} AS risk FROM (
    SELECT supplier, month, cents/(sum(cents) OVER (PARTITION BY month))*100 AS s FROM revenue)"""))
def fn_concentration_risk(spark, d):
    r = tb.supplier_revenue(spark, d)
    total = r.groupBy("month").agg(F.sum("cents").alias("total"))
    return r.join(total, "month").select("supplier", "month", fn.share_risk("cents", F.col("total").cast("double")).alias("risk"))


@query("fn_adjust_channel", "risk", W(PANEL, q="""
  SELECT series_id, ds, CASE WHEN w < 0.01 THEN b ELSE least(100.0, greatest(0.0, (1-w)*b + w*(0.6*b + 0.4*r))) END AS risk
  FROM (SELECT series_id, ds, stablecoin_risk b, contagion_risk r, arbitrage_opacity/100 w FROM panel)"""))
def fn_adjust_channel(spark, d):
    return tb.panel(spark, d).select("series_id", "ds", fn.adjust_for_coins(
        "stablecoin_risk", "contagion_risk", F.col("arbitrage_opacity") / 100).alias("risk"))


@query("fn_duration_risk", "risk", W(PANEL, q="""
  SELECT series_id, ds, least(100.0, least(greatest((1 + stablecoin_risk/15 - 2)/4, 0.0), 1.0)*(1+0.2*0.5)*100) AS risk FROM panel"""))
def fn_duration_risk(spark, d):
    return tb.panel(spark, d).select("series_id", "ds", fn.duration_risk(F.lit(1.0) + F.col("stablecoin_risk") / 15, 0.5).alias("risk"))


def _hits(terms):
    return " + ".join(f"CAST(contains(lower(title), '{t}') AS INT)" for t in terms)


PLAIN_TERMS = ["the", "and", "der", "que", "with"]


@query("fn_is_regulatory", "weight weight_plain", W(HEADLINES, q=f"""
  SELECT doc_id, h > 0 AS is_regulatory, least(h/5.0, 1.0) AS weight, least(p/5.0, 1.0) AS weight_plain FROM (
    SELECT doc_id, {_hits(S.REGULATORY_TERMS)} AS h, {_hits(PLAIN_TERMS)} AS p FROM headlines)"""))
def fn_is_regulatory(spark, d):
    return tb.headlines(spark, d).select(
        "doc_id", fn.has_term("title", S.REGULATORY_TERMS).alias("is_regulatory"),
        fn.term_weight("title", S.REGULATORY_TERMS).alias("weight"), fn.term_weight("title", PLAIN_TERMS).alias("weight_plain"))


@query("fn_sentiment_risk", "risk", W(HEADLINES, q=f"""
  SELECT doc_id, CASE WHEN {_hits(S.NEGATIVE_TERMS)} > 0 THEN least(100.0, (1-sentiment)/2*100*1.3) ELSE (1-sentiment)/2*100 END AS risk FROM headlines"""))
def fn_sentiment_risk(spark, d):
    h = tb.headlines(spark, d).withColumn("neg", fn.has_term("title", S.NEGATIVE_TERMS))
    return h.select("doc_id", fn.sentiment_risk("sentiment", "neg").alias("risk"))


@query("fn_renormalise_weights", "weight idx", W(PANEL, q=f"""
  SELECT series_id, dropped, avg(w_total) AS weight, avg(idx_d) AS idx FROM (
    SELECT series_id, dropped, CASE dropped WHEN 'stablecoin_risk' THEN 0.25/0.7 ELSE 0.3/(1 - CASE dropped WHEN 'arbitrage_opacity' THEN 0.2 ELSE 0.25 END) END AS w_total,
      (CASE WHEN dropped='stablecoin_risk' THEN 0 ELSE 0.3*stablecoin_risk END + CASE WHEN dropped='defi_liquidity_risk' THEN 0 ELSE 0.25*defi_liquidity_risk END
       + CASE WHEN dropped='contagion_risk' THEN 0 ELSE 0.25*contagion_risk END + CASE WHEN dropped='arbitrage_opacity' THEN 0 ELSE 0.2*arbitrage_opacity END)
      / (1 - CASE dropped WHEN 'stablecoin_risk' THEN 0.3 WHEN 'arbitrage_opacity' THEN 0.2 ELSE 0.25 END) AS idx_d
    FROM panel CROSS JOIN (VALUES ('stablecoin_risk'),('defi_liquidity_risk'),('contagion_risk'),('arbitrage_opacity')) v(dropped)) GROUP BY 1, 2"""))
def fn_renormalise_weights(spark, d):
    from stressloom.operators.grids import ablated_weights, explode_grid, grid_index
    grid = [dict(dropped=k, w=ablated_weights(S.CHANNEL_WEIGHTS, k)) for k in S.CHANNELS]
    p = explode_grid(tb.panel(spark, d), grid)
    return (p.withColumn("idx_d", grid_index()).withColumn("wt", F.greatest(F.col("w")[0], F.when(F.col("w")[0] == 0, F.col("w")[1]).otherwise(F.lit(0.0))))
            .groupBy("series_id", "dropped").agg(F.avg("wt").alias("weight"), F.avg("idx_d").alias("idx")))


@query("fn_stars", "", W(PANEL, q="""
  SELECT series_id, ds, CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END AS mark
  FROM (SELECT series_id, ds, arbitrage_opacity/500 AS p FROM panel)"""))
def fn_stars(spark, d):
    return tb.panel(spark, d).select("series_id", "ds", fn.stars(F.col("arbitrage_opacity") / 500).alias("mark"))


@query("fn_bonferroni", "", W(PANEL, q="""
  SELECT series_id, month, p < 0.05 AS sig, p < 0.05/count(*) OVER (PARTITION BY series_id) AS sig_bonferroni FROM (
    SELECT series_id, date_trunc('month', ds)::DATE AS month, min(arbitrage_opacity + contagion_risk)/500 AS p FROM panel GROUP BY 1, 2)"""))
def fn_bonferroni(spark, d):
    m = tb.panel(spark, d).groupBy("series_id", F.trunc("ds", "month").alias("month")).agg(
        (F.min(F.col("arbitrage_opacity") + F.col("contagion_risk")) / 500).alias("p"))
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    return m.select("series_id", "month", (F.col("p") < 0.05).alias("sig"), (F.col("p") < F.lit(0.05) / n).alias("sig_bonferroni"))


@query("fn_hover_point", "delta", W(PANEL, q=f"""
  SELECT series_id, ds, round(idx - a, 2) AS delta, {BAND4.format(x='idx')} AS alert_level FROM (
    SELECT *, avg(idx) OVER (PARTITION BY series_id ORDER BY ds ROWS 29 PRECEDING) a FROM panel)"""))
def fn_hover_point(spark, d):
    return win.board(tb.panel(spark, d)).select("series_id", "ds", F.round(F.col("idx") - F.col("avg_30"), 2).alias("delta"), "alert_level")


_SCEN = [("depeg", 25.0, 10.0, 5.0, 0.0), ("liquidity", 5.0, 30.0, 10.0, 5.0), ("contagion", 10.0, 10.0, 30.0, 10.0)]


@query("fn_scenario", "idx", W(PANEL, q=f"""
  SELECT series_id, ds, scenario, i AS idx, {BAND4.format(x='i')} AS alert_level FROM (
   SELECT series_id, ds, scenario, 0.3*least(100.0,greatest(0.0,stablecoin_risk+a)) + 0.25*least(100.0,greatest(0.0,defi_liquidity_risk+b))
     + 0.25*least(100.0,greatest(0.0,contagion_risk+c)) + 0.2*least(100.0,greatest(0.0,arbitrage_opacity+e)) AS i
   FROM panel CROSS JOIN (VALUES ('depeg',25,10,5,0),('liquidity',5,30,10,5),('contagion',10,10,30,10)) v(scenario,a,b,c,e))"""))
def fn_scenario(spark, d):
    from stressloom.operators.grids import explode_grid
    p = explode_grid(tb.panel(spark, d), [dict(scenario=s, delta=list(v)) for s, *v in _SCEN])
    shocked = p.select("series_id", "ds", "scenario", *[fn.clamp(F.col(c) + F.col("delta")[i]).alias(c) for i, c in enumerate(S.CHANNELS)])
    return shocked.select("series_id", "ds", "scenario", fn.composite().alias("idx"), fn.alert_four(fn.composite()).alias("alert_level"))


@query("fn_date_parse", "", """
  SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def fn_date_parse(spark, d):
    o, t = tb.read(spark, d, "orders"), F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    text = (F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(k == 2, F.date_format(t, "'Mon, 'dd MMM yyyy HH:mm:ss 'GMT'")).when(k == 3, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))
            .otherwise(F.lit("not a date")))
    return o.select("o_orderkey", fn.parse_when(text).cast("date").alias("parsed"))


@query("fn_normal_approx", "z p", W(PANEL, q="""
  SELECT series_id, ds, CASE WHEN u < 0.5 THEN -z ELSE z END AS z, 0.5*(1+tanh((idx-50)/10*0.7978845608)) AS p FROM (
   SELECT *, t-(2.515517+0.802853*t+0.010328*t*t)/(1+1.432788*t+0.189269*t*t+0.001308*t*t*t) AS z FROM (
    SELECT *, sqrt(-2*ln(CASE WHEN u < 0.5 THEN u ELSE 1-u END)) AS t FROM (SELECT *, (idx+1)/120 AS u FROM panel)))"""))
def fn_normal_approx(spark, d):
    return tb.panel(spark, d).select("series_id", "ds", fn.normal_ppf_approx((F.col("idx") + 1) / 120).alias("z"),
                                     fn.normal_cdf_approx((F.col("idx") - 50) / 10).alias("p"))
