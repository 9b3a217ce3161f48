"""Queries over index composition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from stressloom import schema as S
from stressloom.operators import aggregates as ag
from stressloom.operators import compose, regimes
from stressloom.plans.aggregations import AVGRANK, CRISIS, LONG, METH, PAIRS, TAU, method_frame
from stressloom.plans.registry import query
from stressloom.plans.sqltext import EVENTS_DIM, PANEL, W
from stressloom.plans.windowing import BY, EWMA, TAIL
from stressloom.sources import tables as tb

C4 = "stablecoin_risk, defi_liquidity_risk, contagion_risk, arbitrage_opacity"
WC = [(0.3, "stablecoin_risk"), (0.25, "defi_liquidity_risk"), (0.25, "contagion_risk"), (0.2, "arbitrage_opacity")]


def ces_sql(r):
    body = " + ".join(f"{a}*pow(greatest({c}, 1e-6), {r})" for a, c in WC)
    return f"pow({body}, 1.0/({r}))"


GEO = "exp(" + " + ".join(f"{a}*ln(greatest({c}, 1e-6))" for a, c in WC) + ")"


@query("idx_linear", "value normalised", W(PANEL, q="SELECT series_id, ds, idx AS value, (0.4*stablecoin_risk + 0.4*defi_liquidity_risk + 0.2*contagion_risk + 0.2*arbitrage_opacity)/1.2 AS normalised FROM panel"))
def idx_linear(spark, d):
    return tb.panel(spark, d).select("series_id", "ds", compose.linear().alias("value"), compose.linear([0.4, 0.4, 0.2, 0.2], normalise=True).alias("normalised"))


@query("idx_ces", "half minus_half minus_one zero", W(PANEL, q=f"""
  SELECT series_id, ds, {ces_sql('0.5')} AS half, {ces_sql('-0.5')} AS minus_half, {ces_sql('-1.0')} AS minus_one, {GEO} AS zero FROM panel"""))
def idx_ces(spark, d):
    return tb.panel(spark, d).select("series_id", "ds", compose.ces(0.5).alias("half"), compose.ces(-0.5).alias("minus_half"), compose.ces(-1.0).alias("minus_one"), compose.ces(0.0).alias("zero"))


@query("idx_geometric", "value", W(PANEL, q=f"SELECT series_id, ds, {GEO} AS value FROM panel"))
def idx_geometric(spark, d):
    return tb.panel(spark, d).select("series_id", "ds", compose.geometric().alias("value"))


@query("idx_minmax", "hi lo spread", W(PANEL, q=f"SELECT series_id, ds, greatest({C4}) AS hi, least({C4}) AS lo, greatest({C4}) - least({C4}) AS spread FROM panel"))
def idx_minmax(spark, d):
    return tb.panel(spark, d).select("series_id", "ds", compose.extreme("max").alias("hi"), compose.extreme("min").alias("lo"), compose.extreme("range").alias("spread"))


@query("idx_fit_ces_rho", "rho avg_lead score", W(PANEL, EVENTS_DIM, f"""
  g AS (SELECT series_id, k, -2 + 3.0*k/49 AS rho, event, max(v) >= 50 AS hit, coalesce(max(event_date-ds) FILTER (WHERE v >= 50), 0) AS lead FROM (
    SELECT series_id, k, event, event_date, ds, CASE WHEN abs(-2+3.0*k/49) < 1e-6 THEN {GEO} ELSE {ces_sql('(-2+3.0*k/49)')} END AS v
    FROM panel JOIN events_dim ON ds BETWEEN event_date-30 AND event_date-1 CROSS JOIN range(50) r(k)) GROUP BY 1,2,3,4),
  s AS (SELECT series_id, k, any_value(rho) rho, count(*) FILTER (WHERE hit) AS n_detected, coalesce(avg(lead) FILTER (WHERE hit), 0) AS avg_lead FROM g GROUP BY 1,2)""", q="""
  SELECT series_id, rho, n_detected, avg_lead, score FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, k) rn FROM (SELECT *, CASE WHEN n_detected = 0 THEN -1000 ELSE n_detected*100+avg_lead END AS score FROM s)) WHERE rn = 1"""))
def idx_fit_ces_rho(spark, d):
    return compose.fit_ces_rho(tb.panel(spark, d), tb.events_dim(spark))


SEVEN = f"""seven AS (SELECT series_id, ds, unnest(['linear','ces_0.5','ces_0','ces_-0.5','ces_-1','geometric','max']) AS method,
  unnest([idx, {ces_sql('0.5')}, {GEO}, {ces_sql('-0.5')}, {ces_sql('-1.0')}, {GEO}, greatest({C4})]) AS value FROM panel)"""


@query("idx_compare_methods", "mean std max_value min_value skew avg_lead", W(PANEL, EVENTS_DIM, SEVEN, """
  st AS (SELECT series_id, method, avg(value) AS mean, stddev_samp(value) AS std, max(value) AS max_value, min(value) AS min_value, avg((value-mu)^3)/avg((value-mu)^2)^1.5 AS skew FROM (SELECT *, avg(value) OVER (PARTITION BY series_id, method) mu FROM seven) GROUP BY 1,2),
  dt AS (SELECT series_id, method, count(*) FILTER (WHERE hit) AS n_detected, coalesce(avg(lead) FILTER (WHERE hit), 0) AS avg_lead FROM (
    SELECT series_id, method, event, max(value) >= 50 AS hit, coalesce(max(event_date-ds) FILTER (WHERE value >= 50), 0) AS lead FROM seven JOIN events_dim ON ds BETWEEN event_date-30 AND event_date-1 GROUP BY 1,2,3) GROUP BY 1,2)""", q="SELECT * FROM st JOIN dt USING (series_id, method)"), digits=5)
def idx_compare_methods(spark, d):
    return compose.compare_methods(tb.panel(spark, d), tb.events_dim(spark))


OFF = [(i, j) for i in range(4) for j in range(i + 1, 4)]
CORR = "ecor AS (SELECT series_id, ds, " + ", ".join(f"0.99*least(greatest(CASE WHEN c{i}{i}*c{j}{j} > 0 THEN c{i}{j}/sqrt(c{i}{i}*c{j}{j}) ELSE 0 END, -1.0), 1.0) AS r{i}{j}" for i, j in OFF) + " FROM ewma)"
PORT = ("port AS (SELECT p.series_id, p.ds, idx AS linear, sqrt(greatest(0.0, " + " + ".join(f"({a}*{c})^2" for a, c in WC) + " + 2*("
        + " + ".join(f"{WC[i][0]}*{WC[i][1]}*{WC[j][0]}*{WC[j][1]}*r{i}{j}" for i, j in OFF) + "))) AS value, (" + "+".join(f"r{i}{j}" for i, j in OFF)
        + ")/6 AS mean_correlation, r01, r23 FROM panel p JOIN ecor USING (series_id, ds))")


@query("idx_portfolio_corr", "value mean_correlation", W(PANEL, EWMA, CORR, PORT, q="SELECT series_id, ds, value, mean_correlation FROM port"))
def idx_portfolio_corr(spark, d):
    return compose.portfolio(tb.panel(spark, d)).filter(F.col("value").isNotNull()).select("series_id", "ds", "value", "mean_correlation")


@query("idx_portfolio_compare", "gap mean_correlation last_r01 last_r23", W(PANEL, EWMA, CORR, PORT, f"""
  sc AS (SELECT series_id, ds, mean_correlation, r01, r23, CASE WHEN max(value) OVER w > min(value) OVER w THEN 100*(value-min(value) OVER w)/(max(value) OVER w - min(value) OVER w) END AS a FROM port WINDOW w AS ({BY})),
  ln AS (SELECT series_id, ds, CASE WHEN max(idx) OVER w > min(idx) OVER w THEN 100*(idx-min(idx) OVER w)/(max(idx) OVER w - min(idx) OVER w) END AS b FROM panel WINDOW w AS ({BY}))""", q="""
  SELECT series_id, avg(a-b) AS gap, avg(mean_correlation) AS mean_correlation, arg_max(r01, ds) AS last_r01, arg_max(r23, ds) AS last_r23 FROM sc JOIN ln USING (series_id, ds) GROUP BY 1"""))
def idx_portfolio_compare(spark, d):
    p = compose.portfolio(tb.panel(spark, d))
    s = p.select("series_id", "ds", "mean_correlation", "r01", "r23", "value", compose.expanding_scale("linear").alias("b"))
    s = s.withColumn("a", compose.expanding_scale("value"))
    return s.groupBy("series_id").agg(F.avg(F.col("a") - F.col("b")).alias("gap"), F.avg("mean_correlation").alias("mean_correlation"), F.max_by("r01", "ds").alias("last_r01"), F.max_by("r23", "ds").alias("last_r23"))


FIT = """mt AS (SELECT series_id, avg(tau) AS tau, max(n) AS n FROM taus GROUP BY 1 HAVING max(n) >= 50),
 fam AS (SELECT series_id, n, tau, 'clayton' AS family, greatest(0.01, 2*t/(1-t)) AS theta, pow(2.0, -1/greatest(0.01, 2*t/(1-t))) AS lambda_l, 0.0 AS lambda_u, greatest(0.01, 2*t/(1-t))/(greatest(0.01, 2*t/(1-t))+2) AS implied_tau
    FROM (SELECT *, CASE WHEN tau >= 1 THEN 0.99 WHEN tau < 0 THEN 0.01 ELSE tau END AS t FROM mt)
  UNION ALL SELECT series_id, n, tau, 'gumbel', th, 0, 2-pow(2.0, 1/th), 1-1/th FROM (SELECT *, greatest(1.0, 1/(1-least(tau,0.99))) AS th FROM mt)
  UNION ALL SELECT f.series_id, n, tau, 'frank', th, 0, 0, CASE WHEN abs(th) > 0.01 THEN 1-4/th*(1-db) ELSE 0 END FROM (SELECT *, CASE WHEN tau < 1 THEN 3*tau/(1-tau) ELSE 10 END AS th FROM mt) f
    JOIN (SELECT series_id, sum(((i+0.5)*abs(th)/2000)/(exp((i+0.5)*abs(th)/2000)-1))/2000 AS db FROM (SELECT series_id, CASE WHEN tau < 1 THEN 3*tau/(1-tau) ELSE 10 END AS th FROM mt) CROSS JOIN range(2000) r(i) GROUP BY 1) q USING (series_id))"""
CO = (PANEL, LONG, PAIRS, TAU, FIT)


@query("fn_tail_closed_form", "lambda_l lambda_u implied_tau", W(PANEL, """
  th AS (SELECT series_id, ds, 0.5 + idx/20 AS theta FROM panel)""", q="""
  SELECT series_id, ds, pow(2.0, -1/theta) AS lambda_l, 2-pow(2.0, 1/greatest(1.0, theta)) AS lambda_u, theta/(theta+2) AS implied_tau FROM th"""))
def fn_tail_closed_form(spark, d):
    th = 0.5 + F.col("idx") / 20
    c, g = compose.family_fit(th / (th + 2.0), "clayton"), compose.family_fit(1.0 - 1.0 / F.greatest(th, F.lit(1.0)), "gumbel")
    return tb.panel(spark, d).select("series_id", "ds", c["lambda_l"].alias("lambda_l"), g["lambda_u"].alias("lambda_u"), c["tau"].alias("implied_tau"))


@query("idx_copula_fit", "tau theta lambda_l implied_tau", W(*CO, q="SELECT series_id, n, tau, theta, lambda_l, implied_tau FROM fam WHERE family = 'clayton'"))
def idx_copula_fit(spark, d):
    return compose.fit_families(tb.panel(spark, d), ("clayton",)).select("series_id", "n", "tau", "theta", "lambda_l", "implied_tau")


@query("idx_copula_families", "tau theta lambda_l lambda_u implied_tau", W(*CO, q="SELECT series_id, n, tau, family, theta, lambda_l, lambda_u, implied_tau FROM fam"))
def idx_copula_families(spark, d):
    return compose.fit_families(tb.panel(spark, d))


BOOST = "(" + " + ".join(f"{a}*(1+1.5*lam*{c}/100)*{c}" for a, c in WC) + ")/(" + " + ".join(f"{a}*(1+1.5*lam*{c}/100)" for a, c in WC) + ")"


@query("fn_tail_boost", "w1 w4", W(PANEL, q="""
  SELECT series_id, ds, 0.3*(1+0.9*stablecoin_risk/100)/s AS w1, 0.2*(1+0.9*arbitrage_opacity/100)/s AS w4 FROM (SELECT *, """ + " + ".join(f"{a}*(1+0.9*{c}/100)" for a, c in WC) + " AS s FROM panel)"))
def fn_tail_boost(spark, d):
    raw = [F.lit(a) * (1.0 + 1.5 * 0.6 * F.col(c) / 100.0) for c, a in S.CHANNEL_WEIGHTS.items()]
    total = raw[0] + raw[1] + raw[2] + raw[3]
    return tb.panel(spark, d).select("series_id", "ds", (raw[0] / total).alias("w1"), (raw[3] / total).alias("w4"))


@query("idx_tail_boost", "value", W(*CO, TAIL, q=f"""
  SELECT series_id, ds, tail, CASE WHEN tail THEN {BOOST} ELSE idx END AS value FROM tails JOIN (SELECT series_id, lambda_l AS lam FROM fam WHERE family='clayton') USING (series_id)"""))
def idx_tail_boost(spark, d):
    p = tb.panel(spark, d)
    lam = compose.fit_families(p, ("clayton",)).select("series_id", F.col("lambda_l").alias("lam"))
    return compose.tail_boost(p.join(lam, "series_id"), "lam").select("series_id", "ds", "tail", "value")


def fixed_model() -> regimes.Model:
    """Three literal regimes: low, middle and high channel levels with one diagonal covariance."""
    means = np.array([[42.0, 42.0, 42.0, 20.0], [51.0, 50.0, 50.0, 33.0], [60.0, 58.0, 58.0, 50.0]])
    cov = np.diag([150.0, 150.0, 180.0, 400.0])
    trans = np.array([[0.90, 0.08, 0.02], [0.05, 0.90, 0.05], [0.02, 0.08, 0.90]])
    return regimes.Model(np.ones(3) / 3, trans, means, np.array([cov] * 3))


def _dens(m):
    return "exp(-0.5*(" + " + ".join(f"({c}-{x})^2/{v}" for c, x, v in zip(S.CHANNELS, m, (150.0, 150.0, 180.0, 400.0))) + "))"


POST = ("post AS (SELECT *, d0/(d0+d1+d2) AS p0, d1/(d0+d1+d2) AS p1, d2/(d0+d1+d2) AS p2 FROM (SELECT *, "
        + ", ".join(f"{_dens(m)} AS d{k}" for k, m in enumerate([[42.0, 42.0, 42.0, 20.0], [51.0, 50.0, 50.0, 33.0], [60.0, 58.0, 58.0, 50.0]])) + " FROM panel))")


@query("rg_posterior_static", "p0 p1 p2", W(PANEL, POST, q="SELECT series_id, ds, p0, p1, p2 FROM post"))
def rg_posterior_static(spark, d):
    p = regimes.static_probabilities(tb.panel(spark, d), fixed_model())
    return p.select("series_id", "ds", *[F.col("probs")[k].alias(f"p{k}") for k in range(3)])


RW = regimes.REGIME_WEIGHTS
RV = " + ".join(f"p{k}*(" + " + ".join(f"{RW[k][i]}*{c}" for i, c in enumerate(S.CHANNELS)) + ")" for k in range(3))


@query("idx_regime_weighted", "value hard w_stablecoin_risk", W(PANEL, POST, q=f"""
  SELECT series_id, ds, {RV} AS value, 0.2*p0+0.3*p1+0.4*p2 AS w_stablecoin_risk, CASE WHEN p0 >= p1 AND p0 >= p2 THEN {' + '.join(f"{RW[0][i]}*{c}" for i, c in enumerate(S.CHANNELS))}
    WHEN p1 >= p2 THEN {' + '.join(f"{RW[1][i]}*{c}" for i, c in enumerate(S.CHANNELS))} ELSE {' + '.join(f"{RW[2][i]}*{c}" for i, c in enumerate(S.CHANNELS))} END AS hard FROM post"""))
def idx_regime_weighted(spark, d):
    p = regimes.static_probabilities(tb.panel(spark, d), fixed_model())
    soft = regimes.regime_index(p).withColumn("regime", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))
    hard = regimes.decoded_index(soft.withColumnRenamed("value", "soft"))
    return hard.select("series_id", "ds", F.col("soft").alias("value"), F.col("value").alias("hard"), "w_stablecoin_risk")


@query("idx_transitions", "pre during post rise", W(PANEL, POST, EVENTS_DIM, q="""
  SELECT series_id, event, avg(p2) FILTER (WHERE rel < -7) AS pre, avg(p2) FILTER (WHERE rel BETWEEN -7 AND 7) AS during, avg(p2) FILTER (WHERE rel > 7) AS post, avg(p2) FILTER (WHERE rel BETWEEN -7 AND 7) - avg(p2) FILTER (WHERE rel < -7) AS rise,
   CAST(coalesce(-min(rel) FILTER (WHERE rel <= 0 AND p2 > 0.5), 0) AS BIGINT) AS lead_days FROM (SELECT series_id, event, ds-event_date AS rel, p2 FROM post JOIN events_dim ON ds BETWEEN event_date-30 AND event_date+30) GROUP BY 1,2"""))
def idx_transitions(spark, d):
    p = regimes.static_probabilities(tb.panel(spark, d), fixed_model()).withColumn("crisis_prob", F.col("probs")[2])
    return regimes.transitions_around(p, tb.events_dim(spark))


@query("idx_normalise_scales", "scaled", W(PANEL, METH, f"""
  ns AS (SELECT *, avg(value) OVER p mu, stddev_samp(value) OVER p sd, min(value) OVER p lo, max(value) OVER p hi, count(*) OVER p n FROM meth WINDOW p AS (PARTITION BY series_id, method)),
  rf AS (SELECT series_id, avg(value) m, stddev_samp(value) s FROM meth WHERE method='linear' GROUP BY 1)""", q=f"""
  SELECT series_id, ds, method, 'minmax' AS how, 100*(value-lo)/(hi-lo) AS scaled FROM ns UNION ALL SELECT series_id, ds, method, 'zscore', (value-mu)/sd FROM ns
  UNION ALL SELECT series_id, ds, method, 'quantile', 100*({AVGRANK.format(k='series_id, method', x='r9')})/n FROM (SELECT *, round(value, 9) AS r9 FROM ns) UNION ALL SELECT series_id, ds, method, 'reference', (value-mu)/sd*s+m FROM ns JOIN rf USING (series_id)"""), digits=5)
def idx_normalise_scales(spark, d):
    m = method_frame(spark, d)
    out = None
    for how in ("minmax", "zscore", "quantile", "reference"):
        x = compose.normalise_scales(m, how, "linear").select("series_id", "ds", "method", F.lit(how).alias("how"), "scaled")
        out = x if out is None else out.unionByName(x)
    return out


@query("idx_crisis_metrics", "peak cas t_stat", W(PANEL, EVENTS_DIM, METH, CRISIS, q="SELECT series_id, event, method, detected, CAST(lead_time AS BIGINT) AS lead_time, peak, cas, t_stat FROM crisis"))
def idx_crisis_metrics(spark, d):
    return compose.crisis_metrics(method_frame(spark, d), tb.events_dim(spark))


@query("idx_load_methods", "value", W(PANEL, SEVEN, q="SELECT series_id, ds, method, value FROM seven"))
def idx_load_methods(spark, d):
    return compose.load_methods(tb.panel(spark, d), list(compose.row_methods()))


@query("idx_oos_methods", "peak train_mean train_std test_mean test_std", W(PANEL, SEVEN, q="""
  SELECT series_id, method, coalesce(bool_or(pre AND value > 50), false) AS detected, CAST(max(DATE '2000-03-11' - ds) FILTER (WHERE pre AND value > 50) AS BIGINT) AS lead, max(value) FILTER (WHERE pre) AS peak, avg(value) FILTER (WHERE NOT test) AS train_mean,
   stddev_samp(value) FILTER (WHERE NOT test) AS train_std, avg(value) FILTER (WHERE test) AS test_mean, stddev_samp(value) FILTER (WHERE test) AS test_std FROM (
   SELECT *, ds > DATE '1999-06-30' AS test, ds BETWEEN DATE '2000-02-10' AND DATE '2000-03-10' AS pre FROM seven) GROUP BY 1,2"""))
def idx_oos_methods(spark, d):
    return compose.out_of_sample(compose.load_methods(tb.panel(spark, d), list(compose.row_methods())), "1999-06-30", "2000-03-11")


@query("topk_rank_models", "auc margin", W(PANEL, EVENTS_DIM, """
  labelled AS (SELECT p.*, CAST(EXISTS (SELECT 1 FROM events_dim e WHERE e.event_date >= p.ds AND e.event_date - p.ds <= 30) AS INT) AS label FROM panel p),
  mods AS (SELECT series_id, label, unnest(['composite','stablecoin_risk','defi_liquidity_risk','contagion_risk','arbitrage_opacity']) AS model, round(unnest([idx, stablecoin_risk, defi_liquidity_risk, contagion_risk, arbitrage_opacity]), 6) AS score FROM labelled),
  aucs AS (SELECT series_id, model, (sum(r) FILTER (WHERE label=1) - count(*) FILTER (WHERE label=1)*(count(*) FILTER (WHERE label=1)+1)/2.0)/(CAST(count(*) FILTER (WHERE label=1) AS DOUBLE)*count(*) FILTER (WHERE label=0)) AS auc
    FROM (SELECT *, """ + AVGRANK.format(k="series_id, model", x="score") + """ AS r FROM mods) GROUP BY 1,2)""", q="""
  SELECT series_id, model, auc, rank() OVER (PARTITION BY series_id ORDER BY round(auc,12) DESC) AS place, auc - max(auc) FILTER (WHERE model <> 'composite') OVER (PARTITION BY series_id) AS margin FROM aucs"""))
def topk_rank_models(spark, d):
    from stressloom.operators import classify, eventjoin as ev
    lab = ev.lead_label(tb.panel(spark, d), tb.events_dim(spark)).withColumnRenamed("idx", "composite")
    long = ag.unpivot(lab, ["series_id", "label"], ["composite", *S.CHANNELS], "model", "score").withColumn("score", F.round("score", 6))
    keys = ["series_id", "model"]
    a = classify.areas(classify.curve(long, keys), keys).select(*keys, F.col("auroc").alias("auc"))
    w = Window.partitionBy("series_id")
    best = F.max(F.when(F.col("model") != "composite", F.col("auc"))).over(w)
    return a.withColumn("place", F.rank().over(w.orderBy(F.desc(F.round("auc", 12))))).withColumn("margin", F.col("auc") - best)
