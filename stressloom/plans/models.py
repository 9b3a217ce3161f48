"""Queries over weights, regressions, resampling and regime models."""

from __future__ import annotations

import json
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from stressloom.functions.stats import corr
from stressloom import schema as S
from stressloom.functions import special as sp
from stressloom.operators import aggregates as ag
from stressloom.operators import align, breaks, classify, compose, eventjoin as ev, gram, linear, paths, regimes, resample as rs, sensitivity as sn, snapshot, weights as wt
from stressloom.operators import event_study as es
from stressloom.operators import windows as win
from stressloom.plans.aggregations import AVGRANK, CHS, LABELLED, LONG, PAIRS, TAU, _corr_all, pair_returns
from stressloom.plans.composition import POST, RV, fixed_model
from stressloom.plans.evaluation import CASB, WIN, WSENS, forward_frame, pe
from stressloom.plans.registry import CATALOGUE, query
from stressloom.plans.sqltext import cofactor_sql, CORRELATIONS, draw_sql, EVENTS_DIM, LOADINGS, normal_tail_sql, PANEL, SPECTRUM, student_tail_sql, W
from stressloom.session import scratch_path, stored
from stressloom.sources import tables as tb


def forward_panel(spark, d):
    """Channels with the index 30 rows ahead as the target."""
    p = tb.stored_panel(spark, d).withColumn("target", F.lead("idx", 30).over(win.by_day()))
    return p.filter(F.col("target").isNotNull())


# ----------------------------------------------------------------- weights
@query("wt_critic", "score weight", W(PANEL, LONG, """
  sd AS (SELECT series_id, channel, stddev_samp(value)/(max(value)-min(value)) AS s FROM long GROUP BY 1,2),
  cr AS (SELECT a.series_id, a.channel, sum(1-abs(r)) AS info FROM (SELECT a.series_id, a.channel, b.channel AS other, corr(a.value,b.value) AS r FROM long a JOIN long b ON a.series_id=b.series_id AND a.ds=b.ds AND a.channel<>b.channel GROUP BY 1,2,3) a GROUP BY 1,2)""", q="""
  SELECT series_id, channel, s*info AS score, s*info/sum(s*info) OVER (PARTITION BY series_id) AS weight FROM sd JOIN cr USING (series_id, channel)"""))
def wt_critic(spark, d):
    return wt.critic(tb.panel(spark, d))


@query("wt_entropy", "score weight", W(PANEL, LONG, """
  lo AS (SELECT series_id, channel, CASE WHEN min(value) <= 0 THEN 1e-10 - min(value) ELSE 0 END AS sh, sum(value) AS s, count(*) n FROM long GROUP BY 1,2),
  en AS (SELECT series_id, channel, 1 + sum(p*ln(p))/ln(count(*)) AS score FROM (SELECT series_id, channel, least(greatest((value+sh)/(s+n*sh), 1e-10), 1.0) AS p FROM long JOIN lo USING (series_id, channel)) GROUP BY 1,2)""", q="""
  SELECT series_id, channel, score, score/sum(score) OVER (PARTITION BY series_id) AS weight FROM en"""))
def wt_entropy(spark, d):
    return wt.entropy(tb.panel(spark, d))


@query("wt_sensitivity", "r2 neg_mse abs_spearman corr", W(PANEL, f"""
  tp AS (SELECT * FROM (SELECT *, lead(idx,30) OVER (PARTITION BY series_id ORDER BY ds) AS target FROM panel) WHERE target IS NOT NULL),
  g AS (SELECT series_id, channel, step, target, round((w1*stablecoin_risk+w2*defi_liquidity_risk+w3*contagion_risk+w4*arbitrage_opacity)/(w1+w2+w3+w4), 9) AS pred FROM (
    SELECT *, greatest(0.3+CASE WHEN channel='stablecoin_risk' THEN dl ELSE 0 END,0) w1, greatest(0.25+CASE WHEN channel='defi_liquidity_risk' THEN dl ELSE 0 END,0) w2, greatest(0.25+CASE WHEN channel='contagion_risk' THEN dl ELSE 0 END,0) w3,
      greatest(0.2+CASE WHEN channel='arbitrage_opacity' THEN dl ELSE 0 END,0) w4 FROM tp CROSS JOIN {CHS} CROSS JOIN (VALUES (0,-0.2),(1,-0.1),(2,0.0),(3,0.1),(4,0.2)) v(step,dl)))""", q=f"""
  SELECT series_id, channel, step, 1-sum((target-pred)^2)/(var_pop(target)*count(*)) AS r2, -avg((target-pred)^2) AS neg_mse, abs(corr(rx,ry)) AS abs_spearman, corr(pred,target) AS corr
  FROM (SELECT *, {AVGRANK.format(k='series_id, channel, step', x='pred')} AS rx, {AVGRANK.format(k='series_id, channel, step', x='target')} AS ry FROM g) GROUP BY 1,2,3"""), digits=5)
def wt_sensitivity(spark, d):
    return wt.sensitivity_grid(forward_panel(spark, d), "target")


# Ordered, centred values of every channel and the index as lists, in place of the lagged rows.
GRANGER_LONG = """ser AS (SELECT series_id, ch, list(x - mu ORDER BY ds) AS v, count(*) AS n FROM (SELECT *, avg(x) OVER (PARTITION BY series_id, ch) AS mu
  FROM (UNPIVOT (SELECT series_id, ds, stablecoin_risk, defi_liquidity_risk, contagion_risk, arbitrage_opacity, idx FROM panel) ON stablecoin_risk, defi_liquidity_risk, contagion_risk, arbitrage_opacity, idx INTO NAME ch VALUE x)) GROUP BY 1, 2)"""


def eliminated(cols: str, out: str, most: str) -> str:
    """Gaussian elimination of the cross-products of the columns in `cols`, one a step: what is left are the residual cross-products."""
    return f"""{out}_c AS (SELECT a.series_id, a.cause, a.effect, a.p, a.j, b.j AS i, list_inner_product(a.vec, b.vec) AS s FROM {cols} a JOIN {cols} b ON a.series_id = b.series_id AND a.cause = b.cause AND a.effect = b.effect AND a.p = b.p AND a.j <= b.j),
  {out}_m AS (SELECT series_id, cause, effect, p, list(s ORDER BY j, i) AS m, max(i) + 1 AS k FROM (SELECT * FROM {out}_c UNION ALL SELECT series_id, cause, effect, p, i, j, s FROM {out}_c WHERE i <> j) GROUP BY 1, 2, 3, 4),
  {out} AS (WITH RECURSIVE w AS (SELECT series_id, cause, effect, p, 0 AS step, k, m FROM {out}_m
    UNION ALL SELECT series_id, cause, effect, p, step + 1, k - 1, list_transform(range(CAST((k-1)*(k-1) AS BIGINT)), lambda z: m[(z//(k-1)+1)*k + z%(k-1) + 2] - m[(z//(k-1)+1)*k + 1] * m[z%(k-1) + 2] / m[1]) FROM w WHERE step < {most}) SELECT * FROM w)"""


# The unit-root statistic of every list in `ser`: orders by AIC on a common sample, then the chosen one on its own.
ADF_SQL = """dif AS (SELECT series_id, ch, n, v, list_transform(range(CAST(n-1 AS BIGINT)), lambda i: v[i+2] - v[i+1]) AS dv, CAST(least(ceil(12*(n/100.0)^0.25), n//2 - 2) AS BIGINT) AS top FROM ser),
  common AS (SELECT series_id, ch AS cause, '' AS effect, top AS p, 0 AS j, list_transform(range(n-1-top), lambda i: 1.0::DOUBLE) AS vec FROM dif
    UNION ALL SELECT series_id, ch, '', top, 1, v[top+1 : n-1] FROM dif
    UNION ALL SELECT series_id, ch, '', top, 1 + i, dv[top+1-i : n-1-i] FROM dif, range(1, 129) h(i) WHERE i <= top
    UNION ALL SELECT series_id, ch, '', top, 2 + top, dv[top+1 : n-1] FROM dif),
  """ + eliminated("common", "eo", "p + 2") + """,
  od AS (SELECT e.series_id, ch, step - 2 AS p, (n-1-top)*(ln(2*pi()) + ln(m[k*k]/(n-1-top)) + 1) + 2*step AS aic FROM eo e JOIN dif d ON e.series_id = d.series_id AND e.cause = d.ch WHERE step >= 2),
  ch AS (SELECT series_id, ch, arg_min(p, aic) AS p FROM od GROUP BY 1, 2),
  own AS (SELECT series_id, ch AS cause, '' AS effect, p, 0 AS j, list_transform(range(n-1-p), lambda i: 1.0::DOUBLE) AS vec FROM dif JOIN ch USING (series_id, ch)
    UNION ALL SELECT series_id, ch, '', p, i, dv[p+1-i : n-1-i] FROM dif JOIN ch USING (series_id, ch), range(1, 129) h(i) WHERE i <= p
    UNION ALL SELECT series_id, ch, '', p, 1 + p, v[p+1 : n-1] FROM dif JOIN ch USING (series_id, ch)
    UNION ALL SELECT series_id, ch, '', p, 2 + p, dv[p+1 : n-1] FROM dif JOIN ch USING (series_id, ch)),
  """ + eliminated("own", "ew", "p + 1") + """,
  ad AS (SELECT e.series_id, e.cause AS ch, n, CAST(e.p AS INTEGER) AS lags, (m[2]/m[1]) / sqrt((m[4] - m[2]*m[2]/m[1]) / (n-1-e.p-e.p-2) / m[1]) AS adf FROM ew e JOIN dif d ON e.series_id = d.series_id AND e.cause = d.ch WHERE step = e.p + 1),
  az AS (SELECT *, CASE WHEN adf <= -1.61 THEN 2.1659 + 1.4412*adf + 0.038269*adf*adf ELSE 1.7339 + 0.93202*adf - 0.12745*adf*adf - 0.010368*adf*adf*adf END AS z FROM ad),
  ap AS (SELECT series_id, ch, any_value(n) AS n, any_value(lags) AS lags, any_value(adf) AS adf,
      CASE WHEN any_value(adf) > 2.74 THEN 1.0 WHEN any_value(adf) < -18.83 THEN 0.0 ELSE 0.5 + any_value(z)/6000/sqrt(2*pi()) * sum(CASE WHEN g IN (0, 2000) THEN 1 WHEN g % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5*(z*g/2000)^2)) END AS p
    FROM az, range(0, 2001) r(g) GROUP BY 1, 2)"""
# F at the five lags; its tail is the beta integral in t = asin(sqrt(.)), by Simpson's rule.
GRANGER_SQL = """cols AS (SELECT series_id, cause, effect, p, 0 AS j, list_transform(range(CAST(n-p AS BIGINT)), lambda i: 1.0::DOUBLE) AS vec FROM pr, (VALUES (1), (3), (7), (14), (30)) g(p) WHERE n-p > 2*p+1
    UNION ALL SELECT series_id, cause, effect, p, i, ys[p-i+1 : n-i] FROM pr, (VALUES (1), (3), (7), (14), (30)) g(p), range(1, 31) h(i) WHERE i <= p AND n-p > 2*p+1
    UNION ALL SELECT series_id, cause, effect, p, p+i, xs[p-i+1 : n-i] FROM pr, (VALUES (1), (3), (7), (14), (30)) g(p), range(1, 31) h(i) WHERE i <= p AND n-p > 2*p+1
    UNION ALL SELECT series_id, cause, effect, p, 2*p+1, ys[p+1 : n] FROM pr, (VALUES (1), (3), (7), (14), (30)) g(p) WHERE n-p > 2*p+1),
  """ + eliminated("cols", "el", "2*p + 1") + """,
  ss AS (SELECT series_id, cause, effect, p, max(m[k*k]) FILTER (WHERE step = p+1) AS a, max(m[k*k]) FILTER (WHERE step = 2*p+1) AS b FROM el GROUP BY 1, 2, 3, 4),
  fs AS (SELECT series_id, cause, effect, CAST(p AS INTEGER) AS lag, greatest(0.0, (a-b)/p/(b/(n-3*p-1))) AS f_stat, CAST(p AS INTEGER) AS df1, CAST(n-3*p-1 AS INTEGER) AS df2 FROM ss JOIN pr USING (series_id, cause, effect)),
  tail AS (SELECT series_id, cause, effect, lag, any_value(f_stat) AS f_stat, any_value(df1) AS df1, any_value(df2) AS df2,
      sum(CASE WHEN z IN (0, 4000) THEN 1 WHEN z % 2 = 1 THEN 4 ELSE 2 END * CASE WHEN z = 0 THEN 0.0 ELSE 2*exp((df2-1)*ln(sin(top*z/4000)) + lgamma((df1+df2)/2.0) - lgamma(df1/2.0) - lgamma(df2/2.0)) * cos(top*z/4000)^(df1-1) END) * any_value(top)/12000 AS p
    FROM (SELECT *, asin(sqrt(df2/(df2 + df1*f_stat))) AS top FROM fs), range(0, 4001) g(z) GROUP BY 1, 2, 3, 4),
  gr AS (SELECT * FROM tail)"""


@query("wt_granger_lag1", "score weight", W(PANEL, LONG, """
  lg AS (SELECT * FROM (SELECT l.series_id, channel, p.idx AS y, lag(p.idx) OVER w AS y1, lag(value) OVER w AS x1 FROM long l JOIN panel p USING (series_id, ds) WINDOW w AS (PARTITION BY l.series_id, channel ORDER BY l.ds)) WHERE y1 IS NOT NULL),
  m AS (SELECT series_id, channel, count(*) n, regr_syy(y,y1) syy, regr_sxx(y,y1) s11, regr_sxx(y,x1) s22, regr_sxy(y,y1) sy1, regr_sxy(y,x1) sy2, regr_sxy(y1,x1) s12 FROM lg GROUP BY 1,2),
  f AS (SELECT *, syy - sy1*sy1/s11 AS a, syy - (sy1*sy1*s22 - 2*sy1*sy2*s12 + sy2*sy2*s11)/(s11*s22-s12*s12) AS b FROM m),
  sc AS (SELECT series_id, channel, CASE WHEN (a-b)/(b/(n-3)) > 2.7077 THEN (a-b)/(b/(n-3)) ELSE 0 END AS score FROM f)""", q="""
  SELECT series_id, channel, score, CASE WHEN sum(score) OVER (PARTITION BY series_id) = 0 THEN 0.25 ELSE score/sum(score) OVER (PARTITION BY series_id) END AS weight FROM sc"""))
def wt_granger_lag1(spark, d):
    """The weights at lag 1 alone."""
    return wt.granger_weights(linear.granger_panel(tb.panel(spark, d), "idx", (1,)))


BEST_LAG = W(PANEL, GRANGER_LONG, """
  pr AS (SELECT a.series_id, a.ch AS cause, 'idx' AS effect, a.v AS xs, b.v AS ys, a.n FROM ser a JOIN ser b ON a.series_id = b.series_id AND a.ch <> 'idx' AND b.ch = 'idx')""", GRANGER_SQL, """
  bl AS (SELECT series_id, cause AS channel, CASE WHEN p < 0.10 THEN f_stat ELSE 0 END AS score FROM gr QUALIFY row_number() OVER (PARTITION BY series_id, cause ORDER BY p, lag) = 1)""",
  q="SELECT series_id, channel, score, CASE WHEN sum(score) OVER (PARTITION BY series_id) = 0 THEN 0.25 ELSE score/sum(score) OVER (PARTITION BY series_id) END AS weight FROM bl")


@query("wt_granger", "score weight", BEST_LAG)
def wt_granger(spark, d):
    return wt.granger_weights(linear.granger_panel(tb.panel(spark, d), "idx"))


@query("wt_granger_best_lag", "score weight", BEST_LAG)
def wt_granger_best_lag(spark, d):
    """The same as wt_granger, under its former name."""
    return wt_granger(spark, d)


@query("wt_pca", "loading share weight", W(PANEL, LOADINGS, q="""
  SELECT series_id, CAST(component AS INTEGER) AS component, channel, loading, share, weight FROM lo JOIN (SELECT series_id, channel, abs(loading)/sum(abs(loading)) OVER (PARTITION BY series_id) AS weight FROM lo WHERE component = 1) USING (series_id, channel) WHERE n >= 14"""))
def wt_pca(spark, d):
    return gram.pca(tb.panel(spark, d)).drop("vector")


# Squared partial correlations from the cofactors; the tail of chi-square with six degrees has a closed form.
PARTIAL = " + ".join(f"2*pow({cofactor_sql(i, j, '1')}, 2)/(({cofactor_sql(i, i, '1')})*({cofactor_sql(j, j, '1')}))" for i in range(1, 5) for j in range(i + 1, 5))


@query("wt_pca_tests", "kmo chi2 p", W(PANEL, CORRELATIONS, q=f"""
  SELECT series_id, n, 2*sq/(2*sq + pp) AS kmo, chi2, CAST(6 AS INTEGER) AS df, exp(-greatest(chi2, 0.0)/2)*(1 + greatest(chi2, 0.0)/2 + pow(greatest(chi2, 0.0), 2)/8) AS p
  FROM (SELECT *, {PARTIAL} AS pp, -((n-1) - 13/6.0)*ln(det) AS chi2 FROM cd)"""))
def wt_pca_tests(spark, d):
    return gram.pca_tests(tb.panel(spark, d)).withColumn("p", sp.p_chi2("chi2", "df"))


@query("wt_pca_transform", "score", W(PANEL, LONG, LOADINGS, """
  zs AS (SELECT series_id, ds, channel, (value - avg(value) OVER (PARTITION BY series_id, channel))/stddev_samp(value) OVER (PARTITION BY series_id, channel) AS z FROM long)""", q="""
  SELECT series_id, ds, sum(z*loading) AS score FROM zs JOIN lo USING (series_id, channel) WHERE component = 1 GROUP BY 1, 2"""))
def wt_pca_transform(spark, d):
    return gram.pca_scores(tb.panel(spark, d))


@query("wt_elastic_net", "weight coef alpha r2_cv r2_train")
def wt_elastic_net(spark, d):
    return gram.elastic_net(forward_panel(spark, d), "target")


@query("wt_compare", "r")
def wt_compare(spark, d):
    p = forward_panel(spark, d)
    return wt.method_correlations(wt.compare(p, "target", linear.granger_panel(p, "idx")))


# ------------------------------------------------------- tests, regressions
@query("agg_correlation_p_values", "r p", W(PANEL, LONG, PAIRS, TAU, f"""ranked AS (SELECT series_id, ch_a, ch_b,
    {AVGRANK.format(k='series_id, ch_a, ch_b', x='x')} AS x, {AVGRANK.format(k='series_id, ch_a, ch_b', x='y')} AS y FROM pairs),
  cs AS (SELECT series_id, ch_a, ch_b, 'pearson' AS method, count(*) AS n, corr(x,y) AS r FROM pairs GROUP BY 1,2,3 UNION ALL SELECT series_id, ch_a, ch_b, 'spearman', count(*), corr(x,y) FROM ranked GROUP BY 1,2,3)""", q=f"""
  SELECT * EXCLUDE (t), {student_tail_sql('t', '(n-2)')} AS p FROM (SELECT *, r*sqrt((n-2)/(1-r*r)) AS t FROM cs)
  UNION ALL SELECT series_id, ch_a, ch_b, 'kendall', n, tau, {normal_tail_sql('t')} FROM (SELECT *, tau/sqrt(2*(2*n+5)/(9.0*n*(n-1))) AS t FROM taus)"""))
def agg_correlation_p_values(spark, d):
    c = _corr_all(spark, d)
    p = F.when(F.col("method") == "kendall", sp.p_normal("t")).otherwise(sp.p_student("t", F.col("n") - 2))
    return c.withColumn("p", p).drop("t")


@query("agg_covar_quantreg", "var_system covar_distress covar_median delta_covar", digits=4)
def agg_covar_quantreg(spark, d):
    return linear.covar_quantreg(pair_returns(spark, d))


@query("ts_granger", "f_stat p", W(PANEL, GRANGER_LONG, """
  pr AS (SELECT a.series_id, a.ch AS cause, b.ch AS effect, a.v AS xs, b.v AS ys, a.n FROM ser a JOIN ser b ON a.series_id = b.series_id AND a.ch <> b.ch AND a.ch <> 'idx' AND b.ch <> 'idx')""",
  GRANGER_SQL, q="SELECT series_id, cause, effect, lag, f_stat, df1, df2, p FROM gr"))
def ts_granger(spark, d):
    return linear.granger_panel(tb.panel(spark, d))


@query("ts_var_lag", "value", W(PANEL, GRANGER_LONG, """
  chs AS (SELECT series_id, ch, row_number() OVER (PARTITION BY series_id ORDER BY ch) AS c, v, n FROM ser WHERE ch <> 'idx'),
  cols AS (SELECT series_id, '' AS cause, '' AS effect, p, 0 AS j, list_transform(range(CAST(n-p AS BIGINT)), lambda i: 1.0::DOUBLE) AS vec FROM (SELECT DISTINCT series_id, n FROM chs), range(1, 31) g(p) WHERE p < n // 6 AND n-p >= 4*p+10
    UNION ALL SELECT series_id, '', '', p, CASE WHEN i = 0 THEN 4*p + c ELSE 4*(i-1) + c END, v[p-i+1 : n-i] FROM chs, range(1, 31) g(p), range(0, 31) h(i) WHERE i <= p AND p < n // 6 AND n-p >= 4*p+10)""",
  eliminated("cols", "el", "4*p + 1"), """
  ic AS (SELECT e.series_id, e.p, ln((m[1]+m[6]+m[11]+m[16]) / (n-e.p)) AS base, n-e.p AS t, 4.0*(1+4*e.p) AS size FROM el e JOIN (SELECT DISTINCT series_id, n FROM chs) s USING (series_id) WHERE e.step = 4*e.p + 1),
  crit AS (SELECT series_id, unnest(['aic', 'bic', 'hqic']) AS criterion, p, unnest([base + 2*size/t, base + ln(t)*size/t, base + 2*ln(ln(t))*size/t]) AS value FROM ic)""",
  q="SELECT series_id, criterion, CAST(arg_min(p, value) AS INTEGER) AS lag, min(value) AS value FROM crit GROUP BY 1, 2"))
def ts_var_lag(spark, d):
    return linear.var_lag(tb.panel(spark, d))


def _long(spark, d):
    return ag.unpivot(tb.panel(spark, d), ["series_id", "ds"], ["idx", *S.CHANNELS])


@query("ts_adf", "adf p", W(PANEL, GRANGER_LONG, ADF_SQL, q="SELECT series_id, ch AS channel, n, adf, p, lags FROM ap WHERE n >= 20"))
def ts_adf(spark, d):
    return linear.adf(_long(spark, d))


@query("ts_stationarity", "adf adf_p kpss kpss_p", W(PANEL, GRANGER_LONG, ADF_SQL, """
  cu AS (SELECT series_id, ch, sum(c*c) AS q FROM (SELECT series_id, ch, sum(x) OVER (PARTITION BY series_id, ch ORDER BY i) AS c FROM (SELECT series_id, ch, unnest(v) AS x, unnest(range(n)) AS i FROM ser)) GROUP BY 1, 2),
  ac AS (SELECT series_id, ch, any_value(n) AS n, sum(CASE WHEN j = 0 THEN 1 ELSE 2*(1 - j/(floor(4*(n/100.0)^0.25) + 1)) END * list_inner_product(v[j+1 : n], v[1 : n-j])) AS s FROM ser, range(0, 64) h(j) WHERE j <= floor(4*(n/100.0)^0.25) GROUP BY 1, 2),
  ks AS (SELECT series_id, ch, q/(n*s) AS kpss FROM cu JOIN ac USING (series_id, ch)),
  kp AS (SELECT *, CASE WHEN kpss < 0.347 THEN 0.10 WHEN kpss < 0.463 THEN 0.10 - 0.05*(kpss-0.347)/0.116 WHEN kpss < 0.574 THEN 0.05 - 0.025*(kpss-0.463)/0.111 WHEN kpss < 0.739 THEN 0.025 - 0.015*(kpss-0.574)/0.165 ELSE 0.01 END AS kpss_p FROM ks)""", q="""
  SELECT series_id, ch AS channel, n, adf, p AS adf_p, kpss, kpss_p, CASE WHEN p < 0.05 AND kpss_p < 0.05 THEN 'trend-stationary' WHEN p < 0.05 THEN 'stationary' WHEN kpss_p < 0.05 THEN 'non-stationary' ELSE 'inconclusive' END AS verdict,
    CASE WHEN p < 0.05 AND kpss_p < 0.05 THEN 'detrend' WHEN p < 0.05 THEN NULL ELSE 'first_difference' END AS transformation FROM ap JOIN kp USING (series_id, ch) WHERE n >= 20"""))
def ts_stationarity(spark, d):
    return linear.stationarity(_long(spark, d))


@query("ts_engle_granger", "statistic p", W(PANEL, """
  xy AS (SELECT a.series_id, a.ds, a.idx AS x, b.idx AS y FROM panel a JOIN panel b ON a.ds = b.ds AND b.series_id = 'MACHINERY' AND a.series_id <> 'MACHINERY'),
  li AS (SELECT series_id, regr_slope(x, y) AS b, avg(x) AS mx, avg(y) AS my FROM xy GROUP BY 1),
  ser AS (SELECT series_id, 'e' AS ch, list(x - mx - b*(y - my) ORDER BY ds) AS v, count(*) AS n FROM xy JOIN li USING (series_id) GROUP BY 1)""", ADF_SQL, f"""
  eg AS (SELECT series_id, n, adf AS statistic, CASE {" ".join(f"WHEN adf < {S.EG_CRITICAL[k]} THEN {v}" for k, v in sorted(S.EG_P_BELOW.items(), key=lambda kv: kv[1]))}
    ELSE least({S.EG_P_ABOVE["most"]}, greatest({S.EG_P_ABOVE["least"]}, {S.EG_P_ABOVE["start"]} + {S.EG_P_ABOVE["slope"]}*(adf - ({S.EG_CRITICAL["10%"]})))) END AS p FROM ap)""",
  q="SELECT *, p < 0.05 AS cointegrated FROM eg"))
def ts_engle_granger(spark, d):
    return linear.engle_granger(align.against(tb.panel(spark, d), "MACHINERY", "idx"))


@query("ts_johansen", "eigenvalue trace max_eigen trace_5 eigen_5")
def ts_johansen(spark, d):
    return linear.johansen(tb.panel(spark, d))


@query("ts_connectedness", "connectedness")
def ts_connectedness(spark, d):
    return gram.connectedness(tb.panel(spark, d))


@query("win_rolling_connectedness", "connectedness")
def win_rolling_connectedness(spark, d):
    return gram.rolling_connectedness(tb.panel(spark, d))


_PAIRS4 = [(i, j) for i in range(4) for j in range(i, 4)]


@query("win_rolling_tail_dep", "tau theta lambda_l", W(PANEL, f"""
  rw AS (SELECT series_id, ds, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS r, {", ".join(f"{c} AS v{i}" for i, c in enumerate(S.CHANNELS))} FROM panel),
  pw AS (SELECT a.series_id, a.r AS ar, b.r AS br, {", ".join(f"CAST(sign(b.v{i}-a.v{i})*sign(b.v{j}-a.v{j}) AS INT) AS g{i}{j}" for i, j in _PAIRS4)} FROM rw a JOIN rw b ON a.series_id = b.series_id AND b.r > a.r AND b.r < a.r + 252),
  ch AS (SELECT series_id, br + 1 AS t, {", ".join(f"sum(g{i}{j}) AS g{i}{j}" for i, j in _PAIRS4)} FROM pw GROUP BY 1, 2 UNION ALL SELECT series_id, ar + 253, {", ".join(f"-sum(g{i}{j})" for i, j in _PAIRS4)} FROM pw GROUP BY 1, 2),
  al AS (SELECT series_id, r AS t, ds, {", ".join(f"0 AS g{i}{j}" for i, j in _PAIRS4)} FROM rw UNION ALL SELECT series_id, t, NULL, {", ".join(f"g{i}{j}" for i, j in _PAIRS4)} FROM ch),
  run AS (SELECT series_id, t, ds, {", ".join(f"sum(g{i}{j}) OVER w AS g{i}{j}" for i, j in _PAIRS4)} FROM al WINDOW w AS (PARTITION BY series_id ORDER BY t)),
  ta AS (SELECT series_id, ds AS "at", CAST(least(t, 252) AS INTEGER) AS n, ({" + ".join(f"g{i}{j}/sqrt(CAST(g{i}{i} AS DOUBLE)*g{j}{j})" for i, j in _PAIRS4 if i < j)})/6 AS tau FROM run WHERE ds IS NOT NULL AND t >= 100),
  th AS (SELECT *, CASE WHEN tau < 0 THEN 0.01 ELSE least(tau, 0.99) END AS c FROM ta)""", q="""
  SELECT series_id, "at", n, tau, greatest(0.01, 2*c/(1-c)) AS theta, 2.0^(-1/greatest(0.01, 2*c/(1-c))) AS lambda_l FROM th"""))
def win_rolling_tail_dep(spark, d):
    return linear.rolling_tail(tb.panel(spark, d))


@query("ts_collinearity", "vif condition first_share", W(PANEL, SPECTRUM, q=" UNION ALL ".join(f"""
  SELECT series_id, '{c}' AS channel, ({cofactor_sql(i, i, "1")})/det AS vif, (1+a)/(1+b) AS condition, (1+a)/4 AS first_share FROM cd JOIN nw USING (series_id)""" for i, c in enumerate(S.CHANNELS, 1))))
def ts_collinearity(spark, d):
    return gram.collinearity(tb.panel(spark, d))


def _state(spark, d):
    """State = inside [event - 5, event + 30]; onset = first day on or after the event; at risk = not inside after it."""
    p, e = pe(spark, d)
    inside = ev.unfold(e.select("event", "event_date"), 5, 30).select("ds").distinct().withColumn("_in", F.lit(1.0))
    on = ev.event_window(p.select("series_id", "ds"), e, 0, 30).groupBy("series_id", "event").agg(F.min("ds").alias("ds")).select("series_id", "ds").withColumn("_on", F.lit(1.0))
    after = ev.unfold(e.select("event", "event_date"), -1, 30).select("ds").distinct().withColumn("_after", F.lit(1.0))
    j = p.join(inside, "ds", "left").join(on, ["series_id", "ds"], "left").join(after, "ds", "left")
    j = j.withColumns({"y": F.coalesce("_in", F.lit(0.0)), "onset": F.coalesce("_on", F.lit(0.0)), "at_risk": F.col("_after").isNull() | F.col("_on").isNotNull()})
    return j.unpivot(["series_id", "ds", "y", "onset", "at_risk"], S.CHANNELS, "channel", "value").withColumn("x", (F.col("value") - 50.0) / 20.0)


@query("ts_state_logit", "lr wald p_lr p_wald")
def ts_state_logit(spark, d):
    return linear.state_logit(_state(spark, d))


@query("ts_onset_hazard", "lr coef p")
def ts_onset_hazard(spark, d):
    return linear.onset_hazard(_state(spark, d))


@query("ts_proxy", "pearson spearman r2 rmse", W(PANEL, f"""
  ab AS (SELECT a.series_id, a.ds, b.idx AS y, a.idx AS x FROM panel a JOIN panel b ON a.ds = b.ds AND b.series_id = 'MACHINERY' AND a.series_id <> 'MACHINERY'),
  rk AS (SELECT *, {AVGRANK.format(k='series_id', x='x')} AS rx, {AVGRANK.format(k='series_id', x='y')} AS ry FROM ab),
  ft AS (SELECT series_id, corr(x, y) AS pearson, corr(rx, ry) AS spearman, regr_r2(y, x) AS r2, sqrt((regr_syy(y, x) - regr_sxy(y, x)^2/regr_sxx(y, x))/count(*)) AS rmse FROM rk GROUP BY 1),
  ls AS (SELECT series_id, list(x - mx ORDER BY ds) AS xs, list(y - my ORDER BY ds) AS ys, count(*) AS n FROM (SELECT *, avg(x) OVER (PARTITION BY series_id) AS mx, avg(y) OVER (PARTITION BY series_id) AS my FROM ab) GROUP BY 1),
  pr AS (SELECT series_id, 'x' AS cause, 'y' AS effect, xs, ys, n FROM ls UNION ALL SELECT series_id, 'y', 'x', ys, xs, n FROM ls)""",
  GRANGER_SQL.replace("(1), (3), (7), (14), (30)", "(4)"), """
  wy AS (SELECT series_id, bool_or(cause = 'x' AND p < 0.05) AS a, bool_or(cause = 'y' AND p < 0.05) AS b FROM gr GROUP BY 1)""", q="""
  SELECT ft.*, CASE WHEN a AND b THEN 'both' WHEN a THEN 'proxy leads' WHEN b THEN 'target leads' ELSE 'none' END AS direction FROM ft JOIN wy USING (series_id)"""))
def ts_proxy(spark, d):
    p = align.against(tb.stored_panel(spark, d), "MACHINERY", "idx")
    fit = p.groupBy("series_id").agg(corr("x", "y").alias("pearson"), F.regr_r2("y", "x").alias("r2"),
                                     F.sqrt((F.regr_syy("y", "x") - F.pow(F.regr_sxy("y", "x"), F.lit(2.0)) / F.regr_sxx("y", "x")) / F.count("x")).alias("rmse"))
    rho = sn.rank_correlation(p, ["series_id"], "x", "y")
    both = p.select("series_id", "ds", F.inline(F.array(F.struct(F.lit("x").alias("cause"), F.lit("y").alias("effect"), "x", "y"),
                                                         F.struct(F.lit("y").alias("cause"), F.lit("x").alias("effect"), F.col("y").alias("x"), F.col("x").alias("y")))))
    g = linear.granger(both, (4,)).groupBy("series_id").agg(F.max((F.col("cause") == "x") & (F.col("p") < 0.05)).alias("a"), F.max((F.col("cause") == "y") & (F.col("p") < 0.05)).alias("b"))
    way = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "proxy leads").when(F.col("b"), "target leads").otherwise("none")
    return fit.join(rho, "series_id").join(g.select("series_id", way.alias("direction")), "series_id")


# -------------------------------------------------------------- resampling
# Draws of the tests, of bands and detection, of paired metrics, and candidates of the weight search.
REPLICATES, BANDS, PAIRED, TRIALS = 1000, 500, 2000, 100


def plan_sql(reps, block, seed=42, name="plan", src="panel"):
    blk = str(block) if block else "CAST(floor(pow(count(*), 1.0/3) + 1e-9) AS INT)"
    return f"""nn AS (SELECT series_id, CAST(count(*) AS INT) AS n, {blk} AS block FROM {src} GROUP BY 1),
 {name} AS (SELECT series_id, rep, b, n, block, {draw_sql(seed, 'rep', 'b')} % (n-block+1) AS start, least(block, n-b*block) AS len FROM nn CROSS JOIN range({reps}) r(rep) CROSS JOIN range(4000) q(b) WHERE b < ceil(n*1.0/block)),
 posn AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS pos FROM {src})"""


#: Block lengths of the sensitivity to the block; 0 stands for the cube root of the number of days.
BLOCKS = (20, 25, 30)


def plans_sql(reps, blocks, seed=42, src="panel"):
    """The plans of several block lengths as one table, with `block`."""
    cube = "CAST(floor(pow(count(*), 1.0/3) + 1e-9) AS INT)"
    each = " UNION ALL ".join(f"SELECT series_id, CAST(count(*) AS INT) AS n, {b or cube} AS width, {b} AS block FROM {src} GROUP BY 1" for b in blocks)
    return f"""nn AS ({each}),
 plan AS (SELECT series_id, block, rep, b, n, {draw_sql(seed, 'rep', 'b')} % (n-width+1) AS start, least(width, n-b*width) AS len FROM nn CROSS JOIN range({reps}) r(rep) CROSS JOIN range(4000) q(b) WHERE b < ceil(n*1.0/width)),
 posn AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS pos FROM {src})"""


@query("ts_bootstrap_mbb", "boot_mean se lo hi estimate basic_lo basic_hi", W(PANEL, plans_sql(REPLICATES, (0, *BLOCKS)), """
  run AS (SELECT *, sum(idx) OVER (PARTITION BY series_id ORDER BY pos) AS upto FROM posn),
  rm AS (SELECT p.series_id, p.block, rep, sum(z.upto - a.upto + a.idx)/any_value(n) AS m FROM plan p JOIN run a ON p.series_id=a.series_id AND a.pos = start JOIN run z ON p.series_id=z.series_id AND z.pos = start+len-1 GROUP BY 1,2,3),
  bs AS (SELECT series_id, block, count(*) AS reps, avg(m) AS boot_mean, stddev_samp(m) AS se, quantile_cont(m,0.025) AS lo, quantile_cont(m,0.975) AS hi FROM rm GROUP BY 1,2)""", q="""
  SELECT b.*, e AS estimate, 2*e-hi AS basic_lo, 2*e-lo AS basic_hi FROM bs b JOIN (SELECT series_id, avg(idx) AS e FROM panel GROUP BY 1) USING (series_id)"""))
def ts_bootstrap_mbb(spark, d):
    return rs.block_bootstrap_mean(tb.stored_panel(spark, d), "idx", REPLICATES, (None, *BLOCKS))


@query("ts_bootstrap_stationary", "boot_mean se lo hi", W(PANEL, f"""
  nn AS (SELECT series_id, CAST(count(*) AS INT) AS n, CAST(ceil(count(*)*0.05 + 6*sqrt(count(*)*0.05*0.95)) AS INT) + 10 AS runs FROM panel GROUP BY 1),
  dr AS (SELECT series_id, rep, j, n, CASE WHEN j = runs-1 THEN n ELSE least(1 + CAST(floor(ln(({draw_sql(43, 'rep', 'j')}+0.5)/2147483647.0)/ln(0.95::DOUBLE)) AS INT), n) END AS len, {draw_sql(42, 'rep', 'j')} % n AS start FROM nn CROSS JOIN range({REPLICATES}) r(rep) CROSS JOIN range(4000) q(j) WHERE j < runs),
  cu AS (SELECT *, sum(len) OVER (PARTITION BY series_id, rep ORDER BY j) - len AS done FROM dr),
  ru AS (SELECT series_id, rep, n, start, least(len, n-done) AS len FROM cu WHERE done < n),
  bl AS (SELECT series_id, rep, n, start, least(len, n-start) AS len FROM ru UNION ALL SELECT series_id, rep, n, 0, start+len-n FROM ru WHERE start+len > n),
  run AS (SELECT series_id, idx, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS pos, sum(idx) OVER (PARTITION BY series_id ORDER BY ds) AS upto FROM panel),
  rm AS (SELECT p.series_id, rep, sum(z.upto - a.upto + a.idx)/any_value(n) AS m FROM bl p JOIN run a ON p.series_id=a.series_id AND a.pos = start JOIN run z ON p.series_id=z.series_id AND z.pos = start+len-1 GROUP BY 1,2)""", q="""
  SELECT series_id, count(*) AS reps, avg(m) AS boot_mean, stddev_samp(m) AS se, quantile_cont(m,0.025) AS lo, quantile_cont(m,0.975) AS hi FROM rm GROUP BY 1"""))
def ts_bootstrap_stationary(spark, d):
    return rs.stationary_mean(tb.stored_panel(spark, d), "idx", reps=REPLICATES)


# the quantile of the normal distribution is left to the solver; held against a plain jackknife in the tests
@query("ts_bootstrap_bca", "estimate bias acceleration lo hi")
def ts_bootstrap_bca(spark, d):
    """Of the mean, and of the AUROC of the composite and each channel."""
    p = stored(labelled(spark, d), "labelled")
    mean = rs.bca(p, "idx", reps=REPLICATES).withColumn("model", F.lit("idx")).withColumn("statistic", F.lit("mean"))
    return mean.unionByName(rs.bca_auroc(p, ["idx", *S.CHANNELS], "label", reps=REPLICATES).withColumn("statistic", F.lit("auroc")))


def labelled(spark, d):
    return ev.lead_label(tb.stored_panel(spark, d), tb.events_dim(spark)).withColumn("idx", F.round("idx", 6))


AUCW = """rw AS (SELECT p.series_id, rep, v.pos, count(*) AS w FROM {plan} p JOIN posn v ON p.series_id=v.series_id AND {on} GROUP BY 1,2,3),
 md AS (SELECT series_id, pos, label, unnest(['idx','contagion_risk']) AS model, round(unnest([idx, contagion_risk]), 6) AS score FROM posn),
 cn AS (SELECT r.series_id, rep, model, score, sum(w*label) AS pos_, sum(w*(1-label)) AS neg FROM rw r JOIN md m ON r.series_id=m.series_id AND r.pos=m.pos GROUP BY 1,2,3,4),
 ar AS (SELECT series_id, rep, model, CASE WHEN sum(pos_) > 0 AND sum(neg) > 0 THEN sum(neg*(tp - pos_/2.0))/(CAST(sum(pos_) AS DOUBLE)*sum(neg)) ELSE 0.5 END AS auc FROM (SELECT *, sum(pos_) OVER (PARTITION BY series_id, rep, model ORDER BY score DESC) AS tp FROM cn) GROUP BY 1,2,3)"""
IIDP = f"nn AS (SELECT series_id, CAST(count(*) AS INT) AS n FROM labelled GROUP BY 1), iidp AS (SELECT series_id, rep, t, {draw_sql(42, 'rep', 't')} % n AS start FROM nn CROSS JOIN range({REPLICATES}) r(rep) CROSS JOIN range(4000) q(t) WHERE t < n), posn AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS pos FROM labelled)"


DIFF = """df AS (SELECT a.series_id, {more}a.rep, b.model, a.auc-b.auc AS diff FROM ar a JOIN ar b ON a.series_id=b.series_id AND a.rep=b.rep {on}AND a.model='idx' AND b.model<>'idx')"""
TWO_SIDED = "least(1.0, 2*least(avg(CAST(diff<=0 AS INT)), avg(CAST(diff>=0 AS INT))))"


@query("ts_bootstrap_iid", "boot_mean se lo hi diff diff_lo diff_hi p", W(PANEL, EVENTS_DIM, LABELLED, IIDP, AUCW.format(plan="iidp", on="v.pos = start"), DIFF.format(more="", on=""), q=f"""
  SELECT * FROM (SELECT series_id, model, count(*) AS reps, avg(auc) AS boot_mean, stddev_samp(auc) AS se, quantile_cont(auc,0.025) AS lo, quantile_cont(auc,0.975) AS hi FROM ar GROUP BY 1,2)
   LEFT JOIN (SELECT series_id, model, avg(diff) AS diff, quantile_cont(diff,0.025) AS diff_lo, quantile_cont(diff,0.975) AS diff_hi, {TWO_SIDED} AS p FROM df GROUP BY 1,2) USING (series_id, model)"""))
def ts_bootstrap_iid(spark, d):
    p = labelled(spark, d).withColumn("contagion_risk", F.round("contagion_risk", 6))
    r = stored(rs.replicate_metrics(p, ["idx", "contagion_risk"], "label", reps=REPLICATES, iid=True), "replicates")
    diff = rs.paired_difference(r, "idx").select("series_id", "model", F.col("boot_mean").alias("diff"), F.col("lo").alias("diff_lo"), F.col("hi").alias("diff_hi"), "p")
    return rs.interval(r, ["series_id", "model"], "value").join(diff, ["series_id", "model"], "left")


AUCB = AUCW.replace("p.series_id, rep, v.pos, count(*) AS w FROM {plan} p", "p.series_id, p.block, rep, v.pos, count(*) AS w FROM {plan} p").replace("GROUP BY 1,2,3),\n md", "GROUP BY 1,2,3,4),\n md", 1)
AUCB = AUCB.replace("cn AS (SELECT r.series_id, rep,", "cn AS (SELECT r.series_id, r.block, rep,").replace("GROUP BY 1,2,3,4),\n ar", "GROUP BY 1,2,3,4,5),\n ar").replace("ar AS (SELECT series_id, rep,", "ar AS (SELECT series_id, block, rep,")
AUCB = AUCB.replace("PARTITION BY series_id, rep, model", "PARTITION BY series_id, block, rep, model").replace("FROM cn) GROUP BY 1,2,3)", "FROM cn) GROUP BY 1,2,3,4)")


@query("ts_bootstrap_paired", "boot_mean se lo hi p", W(PANEL, EVENTS_DIM, LABELLED, plans_sql(PAIRED, BLOCKS, src="labelled"), AUCB.format(plan="plan", on="v.pos BETWEEN start AND start+len-1"), DIFF.format(more="a.block, ", on="AND a.block=b.block "), q=f"""
  SELECT series_id, block, model, 'auroc' AS metric, count(*) AS reps, avg(diff) AS boot_mean, stddev_samp(diff) AS se, quantile_cont(diff,0.025) AS lo, quantile_cont(diff,0.975) AS hi,
   {TWO_SIDED} AS p FROM df GROUP BY 1,2,3"""))
def ts_bootstrap_paired(spark, d):
    p = stored(labelled(spark, d).withColumn("contagion_risk", F.round("contagion_risk", 6)), "labelled")
    each = [rs.paired_difference(stored(rs.replicate_metrics(p, ["idx", "contagion_risk"], "label", reps=PAIRED, block=b), "replicates"), "idx").withColumn("block", F.lit(b)) for b in BLOCKS]
    return reduce(lambda a, b: a.unionByName(b), each)


def _spread_sql(level, lo, hi):
    return f"SELECT series_id, statistic, any_value(point) AS point, stddev_samp(v) AS se, avg(v)-any_value(point) AS bias, {level} AS level, quantile_cont(v, {lo}) AS lo, quantile_cont(v, {hi}) AS hi FROM vs JOIN pt USING (series_id, statistic) GROUP BY 1, 2"


@query("ts_index_distribution", "point se bias level lo hi", W(PANEL, plan_sql(REPLICATES, None), """
  rp AS (SELECT p.series_id, rep, avg(idx) AS mean, stddev_samp(idx) AS std, max(idx) AS max, arg_max(idx, b*100000 + pos) AS last FROM plan p JOIN posn q ON p.series_id=q.series_id AND q.pos BETWEEN start AND start+len-1 GROUP BY 1,2),
  vs AS (SELECT series_id, unnest(['last','mean','std','max']) AS statistic, unnest([last, mean, std, max]) AS v FROM rp),
  pt AS (SELECT series_id, unnest(['last','mean','std','max']) AS statistic, unnest([arg_max(idx, ds), avg(idx), stddev_samp(idx), max(idx)]) AS point FROM panel GROUP BY 1)""",
    q=" UNION ALL ".join(_spread_sql(*x) for x in ((0.90, 0.05, 0.95), (0.95, 0.025, 0.975), (0.99, 0.005, 0.995)))))
def ts_index_distribution(spark, d):
    return rs.index_distribution(tb.stored_panel(spark, d), reps=REPLICATES)


@query("win_rolling_bands", "point lo hi se", W(PANEL, f"""
  offs AS (SELECT rep, {draw_sql(42, 'rep', '22')} % 87 + 89 - 22*4 AS o FROM range({BANDS}) r(rep)),
  posn AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS pos FROM panel),
  rb AS (SELECT a.series_id, a.ds, any_value(a.idx) AS point, quantile_cont(b.idx, 0.025) AS lo, quantile_cont(b.idx, 0.975) AS hi, stddev_samp(b.idx) AS se FROM posn a JOIN offs ON true JOIN posn b ON a.series_id=b.series_id AND b.pos = a.pos - 89 + o WHERE a.pos >= 89 GROUP BY 1,2)""", q="SELECT * FROM rb"))
def win_rolling_bands(spark, d):
    return rs.rolling_bands(tb.panel(spark, d), reps=BANDS)


@query("idx_bootstrap_bands", "mean lo hi", W(PANEL, plan_sql(BANDS, 20), """
  sq AS (SELECT p.series_id, rep, b*20 + (v.pos - start) AS at, v.idx FROM plan p JOIN posn v ON p.series_id=v.series_id AND v.pos BETWEEN start AND start+len-1)""", q="""
  SELECT s.series_id, any_value(q.ds) AS ds, avg(s.idx) AS mean, quantile_cont(s.idx, 0.025) AS lo, quantile_cont(s.idx, 0.975) AS hi FROM sq s JOIN posn q ON s.series_id=q.series_id AND s.at=q.pos GROUP BY s.series_id, s.at"""))
def idx_bootstrap_bands(spark, d):
    return rs.row_bands(tb.stored_panel(spark, d), "idx", reps=BANDS)


@query("idx_bootstrap_detection", "rate lo hi mean_lead lead_lo lead_median lead_hi", W(PANEL, EVENTS_DIM, """
  ew AS (SELECT series_id || '|' || event AS series_id, series_id AS s0, event, ds, idx, ds - event_date AS rel FROM panel JOIN events_dim ON ds BETWEEN event_date - 90 AND event_date - 1),
  es AS (SELECT series_id, ds, idx FROM ew WHERE rel < -30)""", plan_sql(BANDS, 10, src="es"), """
  cu AS (SELECT p.series_id, rep, least(50.0, avg(idx)+2*stddev_samp(idx)) AS cut FROM plan p JOIN posn v ON p.series_id=v.series_id AND v.pos BETWEEN start AND start+len-1 GROUP BY 1,2),
  ld AS (SELECT e.s0 AS series_id, e.event, rep, -min(rel) FILTER (WHERE idx >= cut) AS lead FROM ew e JOIN cu c ON e.series_id=c.series_id WHERE rel >= -30 GROUP BY 1,2,3),
  sm AS (SELECT series_id, event, count(*) n, count(lead)*1.0/count(*) AS p, avg(lead) AS mean_lead, quantile_cont(lead, 0.025) AS lead_lo, quantile_cont(lead, 0.5) AS lead_median, quantile_cont(lead, 0.975) AS lead_hi, CAST(1.959963984540054 AS DOUBLE) AS z FROM ld GROUP BY 1,2)""", q="""
  SELECT series_id, event, p AS rate, (p+z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4.0*n*n)))/(1+z*z/n) AS lo, (p+z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4.0*n*n)))/(1+z*z/n) AS hi, mean_lead, lead_lo, lead_median, lead_hi FROM sm"""))
def idx_bootstrap_detection(spark, d):
    return rs.detection(tb.stored_panel(spark, d), tb.events_dim(spark), reps=BANDS)


@query("ts_placebo_shuffle", "actual placebo_mean p z", W(PANEL, EVENTS_DIM, f"""
  posn AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM panel),
  nn AS (SELECT series_id, count(*) AS n FROM panel GROUP BY 1),
  fk AS (SELECT f.series_id, rep, CAST(j AS VARCHAR) AS event, ds AS event_date FROM (SELECT series_id, rep, j, {draw_sql(42, 'rep', 'j')} % n AS pos FROM nn CROSS JOIN range({REPLICATES}) r(rep) CROSS JOIN range(4) q(j)) f JOIN posn v ON f.series_id=v.series_id AND f.pos=v.pos
     UNION ALL SELECT series_id, -1, event, event_date FROM nn CROSS JOIN events_dim),
  al AS (SELECT series_id, ds FROM panel WHERE idx > 70), ta AS (SELECT series_id, count(*) AS alerts FROM al GROUP BY 1),
  ht AS (SELECT f.series_id, rep, count(DISTINCT ds) tp, count(DISTINCT event) fd FROM fk f JOIN al a ON f.series_id=a.series_id AND ds BETWEEN event_date-30 AND event_date-1 GROUP BY 1,2),
  ff AS (SELECT d.series_id, d.rep, coalesce(2*(tp*1.0/alerts)*(fd/4.0)/nullif(tp*1.0/alerts+fd/4.0, 0), 0) AS f1 FROM (SELECT DISTINCT series_id, rep FROM fk) d JOIN ta USING (series_id) LEFT JOIN ht h ON d.series_id=h.series_id AND d.rep=h.rep)""", q="""
  SELECT f.series_id, a.f1 AS actual, avg(f.f1) AS placebo_mean, avg(CAST(f.f1 >= a.f1 AS INT)) AS p, (a.f1-avg(f.f1))/nullif(stddev_pop(f.f1),0) AS z FROM ff f JOIN ff a ON f.series_id=a.series_id AND a.rep=-1 WHERE f.rep >= 0 GROUP BY f.series_id, a.f1"""))
def ts_placebo_shuffle(spark, d):
    return rs.placebo_shuffle(tb.stored_panel(spark, d), tb.events_dim(spark), reps=REPLICATES)


@query("ts_placebo_features", "actual placebo_mean placebo_sd p", W(PANEL, f"""
  tp AS (SELECT * FROM (SELECT *, lead(idx,30) OVER (PARTITION BY series_id ORDER BY ds) AS target FROM panel) WHERE target IS NOT NULL),
  wv AS (SELECT * FROM (VALUES (0,0.3),(1,0.25),(2,0.25),(3,0.2)) v(i,w)),
  pm AS (SELECT a.w w1, b.w w2, c.w w3, e.w w4, a.i*1000+b.i*100+c.i*10+e.i AS perm FROM wv a, wv b, wv c, wv e WHERE a.i<>b.i AND a.i<>c.i AND a.i<>e.i AND b.i<>c.i AND b.i<>e.i AND c.i<>e.i),
  g AS (SELECT series_id, perm, target, round(w1*stablecoin_risk+w2*defi_liquidity_risk+w3*contagion_risk+w4*arbitrage_opacity, 9) AS pred FROM tp CROSS JOIN pm),
  c AS (SELECT series_id, perm, round(abs(corr(rx,ry)), 12) AS v FROM (SELECT *, {AVGRANK.format(k='series_id, perm', x='pred')} AS rx, {AVGRANK.format(k='series_id, perm', x='target')} AS ry FROM g) GROUP BY 1,2)""", q="""
  SELECT c.series_id, a.v AS actual, avg(c.v) AS placebo_mean, stddev_pop(c.v) AS placebo_sd, avg(CAST(c.v >= a.v AS INT)) AS p FROM c JOIN c a ON c.series_id=a.series_id AND a.perm=123 GROUP BY c.series_id, a.v"""))
def ts_placebo_features(spark, d):
    return rs.placebo_features(forward_panel(spark, d), "target")


@query("udf_statistic", "boot_mean se lo hi", W(PANEL, plan_sql(REPLICATES, 20), """
  sq AS (SELECT p.series_id, rep, idx FROM plan p JOIN posn v ON p.series_id=v.series_id AND v.pos BETWEEN start AND start+len-1),
  qt AS (SELECT series_id, rep, quantile_cont(idx, 0.1) AS a, quantile_cont(idx, 0.9) AS b FROM sq GROUP BY 1,2),
  tm AS (SELECT series_id, rep, avg(idx) AS m FROM sq JOIN qt USING (series_id, rep) WHERE idx BETWEEN a - 1e-9 AND b + 1e-9 GROUP BY 1,2)""", q="""
  SELECT series_id, count(*) AS reps, avg(m) AS boot_mean, stddev_samp(m) AS se, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM tm GROUP BY 1"""))
def udf_statistic(spark, d):
    @F.pandas_udf("double")
    def trimmed(v: pd.Series) -> float:
        lo, hi = v.quantile(0.1), v.quantile(0.9)
        return float(v[(v >= lo - 1e-9) & (v <= hi + 1e-9)].mean())  # a value that is the quantile stays, however that is rounded

    return rs.bootstrap_statistic(tb.panel(spark, d), "idx", trimmed, reps=REPLICATES)


@query("udf_metrics", "boot_mean se lo hi", W(PANEL, EVENTS_DIM, LABELLED, plan_sql(PAIRED, 25, src="labelled"), AUCW.replace("contagion_risk", "stablecoin_risk").format(plan="plan", on="v.pos BETWEEN start AND start+len-1"), """
  cu AS (SELECT *, sum(pos_) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos_) OVER (PARTITION BY series_id, rep, model) AS np FROM cn WINDOW w AS (PARTITION BY series_id, rep, model ORDER BY score DESC)),
  mv AS (SELECT series_id, rep, model, 'auroc' AS metric, auc AS v FROM ar UNION ALL SELECT series_id, rep, model, 'average_precision', coalesce(sum(CAST(pos_ AS DOUBLE)/nullif(np, 0)*tp/(tp+fp)), 0) FROM cu GROUP BY 1,2,3)""", q="""
  SELECT series_id, model, metric, count(*) AS reps, avg(v) AS boot_mean, stddev_samp(v) AS se, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM mv GROUP BY 1,2,3"""))
def udf_metrics(spark, d):
    r = rs.replicate_metrics(labelled(spark, d), ["idx", "stablecoin_risk"], "label", reps=PAIRED, metrics=("auroc", "average_precision"))
    return rs.interval(r, ["series_id", "model", "metric"], "value")


def calibrate_sql(objective: str) -> str:
    """Best score and candidate of a series: the candidates of the search as rows, each met with the days before the events."""
    cands = ", ".join(f"({i}, [{', '.join(f'{x!r}::DOUBLE' for row in w for x in row)}], '{json.dumps(w, separators=(',', ':'))}')" for i, w in enumerate(regimes.candidates(TRIALS)))
    value = " + ".join(f"p{k}*(" + " + ".join(f"w[{4 * k + i + 1}]*{c}" for i, c in enumerate(S.CHANNELS)) + ")" for k in range(3))
    look = 60 if objective == "lead_time" else 30
    score = {"detection_rate": "rate", "lead_time": "lead", "f1": "coalesce(2*p*rate/nullif(p+rate, 0), 0)"}[objective]
    return W(PANEL, POST, EVENTS_DIM, f"""
  cand AS (SELECT * FROM (VALUES {cands}) v(trial, w, weights)),
  pe AS (SELECT series_id, trial, event, bool_or(value > 70) AS hit, max(CASE WHEN value > 70 THEN event_date - ds END) AS ahead FROM (SELECT *, {value} AS value FROM post JOIN events_dim ON ds BETWEEN event_date - {look} AND event_date - 1 CROSS JOIN cand) GROUP BY 1, 2, 3),
  al AS (SELECT series_id, trial, count(*) FILTER (WHERE value > 70) AS alerts FROM (SELECT *, {value} AS value FROM post CROSS JOIN cand) GROUP BY 1, 2),
  gs AS (SELECT series_id, trial, avg(CAST(hit AS INT)) AS rate, coalesce(avg(ahead), 0) AS lead, coalesce(count(*) FILTER (WHERE hit)*1.0/nullif(any_value(alerts), 0), 0) AS p FROM pe JOIN al USING (series_id, trial) GROUP BY 1, 2),
  sc AS (SELECT series_id, trial, {score} AS score FROM gs)""", q=f"""
  SELECT series_id, '{objective}' AS objective, CAST(trial AS INTEGER) AS trial, score, weights FROM sc JOIN cand USING (trial) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY score DESC, trial) = 1""")


@query("udf_objective", "score", " UNION ALL ".join(f"SELECT series_id, objective, trial, score FROM ({calibrate_sql(o)})" for o in ("detection_rate", "lead_time", "f1")))
def udf_objective(spark, d):
    p = regimes.static_probabilities(tb.stored_panel(spark, d), fixed_model())
    parts = [regimes.calibrate(p, tb.events_dim(spark), o, trials=TRIALS).select("series_id", F.lit(o).alias("objective"), "trial", "score") for o in ("detection_rate", "lead_time", "f1")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("udf_special", "p_normal p_student p_fisher p_chi2", W(PANEL, EVENTS_DIM, WIN, CASB, f"""
  tl AS (SELECT series_id, event, {normal_tail_sql('t_stat')} AS pn, {student_tail_sql('t_stat', '(n-1)')} AS ps FROM cas)""", q="""
  SELECT series_id, event, pn AS p_normal, ps AS p_student, ps AS p_fisher, pn AS p_chi2 FROM tl"""))
def udf_special(spark, d):
    r = es.study(*pe(spark, d))
    t = F.col("t_stat")
    return r.select("series_id", "event", sp.p_normal(t).alias("p_normal"), sp.p_student(t, F.col("n") - 1).alias("p_student"),
                    sp.p_fisher(t * t, F.lit(1.0), F.col("n") - 1).alias("p_fisher"), sp.p_chi2(t * t, F.lit(1.0)).alias("p_chi2"))


@query("udtf_windows", "mean", W(PANEL, q="""
  SELECT series_id, ds, mean FROM (SELECT series_id, ds, avg(idx) OVER w AS mean, count(*) OVER w AS n FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ds ROWS 19 PRECEDING)) WHERE n = 20"""))
def udtf_windows(spark, d):
    p = align.positions(tb.panel(spark, d).select("series_id", "ds", "idx"))
    g = p.select("series_id", "idx", F.explode(F.sequence(F.col("pos"), F.col("pos") + 19)).alias("w"))
    g = g.groupBy("series_id", "w").agg(F.avg("idx").alias("mean"), F.count(F.lit(1)).alias("n")).filter("n = 20")
    return g.join(p.select("series_id", F.col("pos").alias("w"), "ds"), ["series_id", "w"]).select("series_id", "ds", "mean")


# ----------------------------------------------------------------- regimes
@lru_cache(maxsize=4)
def _panel(app, spark, d):
    return tb.stored_panel(spark, d)


@lru_cache(maxsize=4)
def _fits(app, spark, d):
    return regimes.fit(_panel(app, spark, d), (2, 3, 4))


def fitted_panel(spark, d):
    """The panel of the fits, written once."""
    return _panel(spark.sparkContext.applicationId, spark, d)


def fitted(spark, d, k=3):
    """The full fit of all state counts, shared by the queries of one session on the same tables."""
    return _fits(spark.sparkContext.applicationId, spark, d)[k]


@query("rg_hmm_fit", "v", digits=4)
def rg_hmm_fit(spark, d):
    m = fitted(spark, d)
    panel = fitted_panel(spark, d)
    return regimes.params_frame(spark, m).join(panel.groupBy().agg(F.count(F.lit(1)).alias("rows")).withColumn("name", F.lit("n_obs")), "name", "left")


@query("rg_viterbi")
def rg_viterbi(spark, d):
    return regimes.decode(fitted_panel(spark, d), fitted(spark, d))


def probs(df, k=3):
    return df.select("series_id", "ds", *[F.col("probs")[i].alias(f"p{i}") for i in range(k)])


# fixed transition model: the filter recursion written as a recursive query
TRANS = [[0.90, 0.08, 0.02], [0.05, 0.90, 0.05], [0.02, 0.08, 0.90]]
FILT = """den AS (SELECT series_id, ds, d0, d1, d2, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS t FROM post)"""
REC = """WITH RECURSIVE {base}, rec(series_id, t, ds, p0, p1, p2) AS (
  SELECT series_id, t, ds, d0/(d0+d1+d2), d1/(d0+d1+d2), d2/(d0+d1+d2) FROM den WHERE t = 1
  UNION ALL SELECT n.series_id, n.t, n.ds, a0/(a0+a1+a2), a1/(a0+a1+a2), a2/(a0+a1+a2) FROM (
    SELECT d.series_id, d.t, d.ds, (r.p0*0.90+r.p1*0.05+r.p2*0.02)*d0 AS a0, (r.p0*0.08+r.p1*0.90+r.p2*0.08)*d1 AS a1, (r.p0*0.02+r.p1*0.05+r.p2*0.90)*d2 AS a2
    FROM rec r JOIN den d ON d.series_id=r.series_id AND d.t=r.t+1) n)
SELECT series_id, ds, p0, p1, p2 FROM rec"""


def _filter_sql():
    from stressloom.plans.composition import POST
    return REC.format(base=",\n".join([PANEL, POST, FILT]))


@query("rg_filter", "p0 p1 p2", _filter_sql())
def rg_filter(spark, d):
    return probs(regimes.filtered(tb.panel(spark, d), fixed_model()))


def _smooth_sql():
    """The filter forwards, then the recursion backwards from the last day; both normalised at each step."""
    from stressloom.plans.composition import POST
    step = " + ".join
    back = [step(f"{a}*d.d{j}*r.b{j}" for j, a in enumerate(row)) for row in TRANS]
    forward = REC.format(base=",\n".join([PANEL, POST, FILT])).replace("\nSELECT series_id, ds, p0, p1, p2 FROM rec", "")
    return forward + f""", bk(series_id, t, b0, b1, b2) AS (
  SELECT series_id, max(t), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE) FROM den GROUP BY 1
  UNION ALL SELECT series_id, t, u0/(u0+u1+u2), u1/(u0+u1+u2), u2/(u0+u1+u2) FROM (
    SELECT r.series_id, r.t - 1 AS t, {back[0]} AS u0, {back[1]} AS u1, {back[2]} AS u2 FROM bk r JOIN den d ON d.series_id=r.series_id AND d.t=r.t WHERE r.t > 1))
SELECT series_id, ds, p0*b0/z AS p0, p1*b1/z AS p1, p2*b2/z AS p2 FROM (SELECT *, p0*b0+p1*b1+p2*b2 AS z FROM rec JOIN bk USING (series_id, t))"""


@query("rg_smooth", "p0 p1 p2", _smooth_sql())
def rg_smooth(spark, d):
    return probs(regimes.smoothed(tb.panel(spark, d), fixed_model()))


def _decode_sql():
    """Best scores forwards with where each came from, then the path backwards from the best last regime."""
    from stressloom.plans.composition import POST
    into = [[f"r.s{i} + ln({TRANS[i][j]})" for i in range(3)] for j in range(3)]
    best = [f"greatest({', '.join(c)})" for c in into]
    at = [f"CASE WHEN {c[0]} >= {b} THEN 0 WHEN {c[1]} >= {b} THEN 1 ELSE 2 END" for c, b in zip(into, best)]
    return "WITH RECURSIVE " + ",\n".join([PANEL, POST, FILT]) + f""",
 sc(series_id, t, ds, s0, s1, s2, k0, k1, k2) AS (
  SELECT series_id, t, ds, ln(d0), ln(d1), ln(d2), 0, 0, 0 FROM den WHERE t = 1
  UNION ALL SELECT d.series_id, d.t, d.ds, {best[0]} + ln(d0), {best[1]} + ln(d1), {best[2]} + ln(d2), {at[0]}, {at[1]}, {at[2]} FROM sc r JOIN den d ON d.series_id=r.series_id AND d.t=r.t+1),
 pt(series_id, t, regime) AS (
  SELECT series_id, t, CASE WHEN s0 >= greatest(s1, s2) THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END FROM sc WHERE (series_id, t) IN (SELECT series_id, max(t) FROM den GROUP BY 1)
  UNION ALL SELECT p.series_id, p.t - 1, CASE p.regime WHEN 0 THEN k0 WHEN 1 THEN k1 ELSE k2 END FROM pt p JOIN sc s ON s.series_id=p.series_id AND s.t=p.t WHERE p.t > 1)
SELECT series_id, ds, regime FROM pt JOIN den USING (series_id, t)"""


@query("rg_decode_fixed", "", _decode_sql())
def rg_decode_fixed(spark, d):
    return regimes.decode(tb.panel(spark, d), fixed_model())


@query("rg_selection", "loglik aic bic", digits=2)
def rg_selection(spark, d):
    rows = regimes.criteria_table({k: fitted(spark, d, k) for k in (2, 3, 4)})
    n = fitted_panel(spark, d).groupBy().agg(F.count(F.lit(1)).alias("rows"))
    return spark.createDataFrame(pd.DataFrame(rows)).withColumn("_k", F.lit(1)).join(n.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("rg_ergodic", "probability", digits=4)
def rg_ergodic(spark, d):
    m = fitted(spark, d)
    e = regimes.ergodic(m.trans)
    freq = regimes.decode(fitted_panel(spark, d), m).groupBy("regime").agg(F.count(F.lit(1)).alias("days"))
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(e)], "regime int, probability double")
    return table.join(freq, "regime", "left")


@query("rg_regime_weights", "weight coef")
def rg_regime_weights(spark, d):
    p = forward_panel(spark, d)
    r = regimes.decode(p, fixed_model())
    j = p.join(r, ["series_id", "ds"])
    big = j.groupBy("series_id", "regime").agg(F.count(F.lit(1)).alias("_n"))
    j = j.join(big, ["series_id", "regime"])
    fit = gram.elastic_net(j.filter(F.col("_n") >= 50).drop("_n"), "target", keys=("series_id", "regime")).select("series_id", "regime", "channel", "weight", "coef")
    equal = big.filter(F.col("_n") < 50).select("series_id", "regime", F.explode(F.array(*[F.lit(c) for c in S.CHANNELS])).alias("channel"), F.lit(0.25).alias("weight"), F.lit(None).cast("double").alias("coef"))
    return fit.unionByName(equal)


@query("rg_save_load", "v", digits=4)
def rg_save_load(spark, d):
    m = fitted(spark, d, 2)
    path = scratch_path(spark, "model")
    regimes.save(spark, m, path)
    return regimes.params_frame(spark, regimes.load(spark, path))


@query("idx_calibrate_regime", "score", f"SELECT series_id, trial, score, weights FROM ({calibrate_sql('detection_rate')})")
def idx_calibrate_regime(spark, d):
    p = regimes.static_probabilities(tb.stored_panel(spark, d), fixed_model())
    c = regimes.calibrate(p, tb.events_dim(spark), trials=TRIALS)
    return c.select("series_id", "trial", "score", F.to_json("weights").alias("weights"))


def _regime_full_sql():
    """The decoded path beside the filtered probabilities, described per regime."""
    recursion = REC.split("{base}, ")[1].rsplit("\nSELECT", 1)[0]
    return _decode_sql().rsplit("\nSELECT", 1)[0] + ",\n " + recursion + f""",
 vl AS (SELECT p.*, regime, {RV} AS value FROM rec JOIN pt USING (series_id, t) JOIN panel p ON p.series_id=rec.series_id AND p.ds=rec.ds),
 nx AS (SELECT *, lead(regime) OVER (PARTITION BY series_id ORDER BY ds) AS nxt FROM vl)
SELECT series_id, CAST(regime AS INTEGER) AS regime, count(*)*1.0/any_value(days) AS frequency, avg(({' + '.join(S.CHANNELS)})/4) AS level, avg(value) AS mean_idx, count(*) FILTER (WHERE nxt = regime)*1.0/nullif(count(nxt), 0) AS persistence, any_value(gap) AS distance
FROM nx JOIN (SELECT series_id, count(*) AS days, avg(abs(value - idx)) AS gap FROM vl GROUP BY 1) USING (series_id) GROUP BY 1, 2"""


@query("idx_regime_full", "frequency level mean_idx persistence distance", _regime_full_sql())
def idx_regime_full(spark, d):
    from stressloom.operators.regime_stats import regime_profile
    p, m = tb.stored_panel(spark, d), fixed_model()
    f = regimes.regime_index(regimes.filtered(p, m).join(p, ["series_id", "ds"]))
    j = f.join(regimes.decode(p, m), ["series_id", "ds"]).select("series_id", "ds", "regime", *S.CHANNELS, F.col("idx").alias("_base"), F.col("value").alias("idx"))
    gap = j.groupBy("series_id").agg(F.avg(F.abs(F.col("idx") - F.col("_base"))).alias("distance"))
    return regime_profile(j).join(gap, "series_id")


@query("idx_method_validators", "peak train_mean train_std test_mean test_std")
def idx_method_validators(spark, d):
    p = tb.stored_panel(spark, d)
    split = "1999-06-30"
    train = p.filter(F.col("ds") <= F.lit(split).cast("date"))
    lam = compose.fit_families(train, ("clayton",)).select("series_id", F.col("lambda_l").alias("lam"))
    port = compose.portfolio(p)
    parts = {
        "linear": p.select("series_id", "ds", F.col("idx").alias("value")),
        "portfolio": port.select("series_id", "ds", compose.expanding_scale("value").alias("value")),
        "tail_boost": compose.tail_boost(p.join(lam, "series_id"), "lam").select("series_id", "ds", "value"),
        "regime": regimes.regime_index(regimes.filtered(p, regimes.fit(train, (3,))[3]).join(p, ["series_id", "ds"])).select("series_id", "ds", "value"),
    }
    long = reduce(lambda a, b: a.unionByName(b), [v.withColumn("method", F.lit(k)) for k, v in parts.items()])
    return compose.out_of_sample(long, split, "2000-03-11")


# -------------------------------------------------------------- composites
def external_models(spark, d):
    """(ds, sentiment, rate, variation, macro): models that know nothing of the index. Sentiment is an external daily gauge, turned round;
    rate the last published one and variation that of 30 days of order value; macro the mean of the two after scaling."""
    daily = tb.daily_orders(spark, d).select(F.lit("").alias("series_id"), "ds", F.col("tvl").alias("value"))
    rate = tb.observations(spark, d).select("ds", F.col("value").try_cast("double").alias("value"))
    known = snapshot.snapshot(daily.select("series_id", "ds"), {"rate": snapshot.Source(rate, "backward", 2, common=True)}).select("ds", "rate")
    both = known.join(snapshot.value_state(daily).select("ds", F.col("cv").alias("variation")), "ds").na.drop()
    scale = both.agg(*[f(c).alias(f"{c}_{n}") for c in ("rate", "variation") for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    z = lambda c: (F.col(c) - F.lit(scale[f"{c}_m"])) / F.nullif(F.lit(scale[f"{c}_s"]), F.lit(0.0))
    macro = both.select("ds", "rate", "variation", ((z("rate") + z("variation")) / 2).alias("macro"))
    return macro.join(tb.sentiment(spark, d).select("ds", (-F.col("sentiment")).alias("sentiment")), "ds")


def model_frame(spark, d, external: bool = False):
    """Long (series_id, ds, label, model, score) on the dates common to all models."""
    p = tb.stored_panel(spark, d)
    lab = ev.lead_label(p, tb.events_dim(spark)).select("series_id", "ds", "label")
    wide = p.select("series_id", "ds", F.col("idx").alias("composite"), *S.CHANNELS, (-(F.col("idx") / F.lag("idx", 30).over(win.by_day()) - 1)).alias("fall_30"))
    wide = wide.join(gram.pca_scores(p, "vector").withColumnRenamed("score", "first_component"), ["series_id", "ds"])
    wide = wide.join(gram.rolling_connectedness(p), ["series_id", "ds"])
    det = paths.detrend(p.select("series_id", "ds", "contagion_risk"), "contagion_risk", "linear").select("series_id", "ds", F.col("out").alias("detrended"))
    wide = wide.join(det, ["series_id", "ds"])
    names = ["composite", *S.CHANNELS, "fall_30", "first_component", "connectedness", "detrended"]
    if external:
        wide = wide.join(external_models(spark, d), "ds")
        names += ["sentiment", "rate", "variation", "macro"]
    wide = wide.na.drop()
    return wide.join(lab, ["series_id", "ds"]).unpivot(["series_id", "ds", "label"], names, "model", "score")


@query("ts_fair_baselines", "auroc auroc_oriented average_precision")
def ts_fair_baselines(spark, d):
    keys = ["series_id", "model"]
    a = classify.areas(classify.curve(model_frame(spark, d, external=True).withColumn("score", F.round("score", 6)), keys), keys)
    return classify.oriented(a).select(*keys, "n_pos", "n_neg", "auroc", "sign", "auroc_oriented", "average_precision")


@query("ts_labelled_sample", "composite connectedness")
def ts_labelled_sample(spark, d):
    p = tb.stored_panel(spark, d)
    s = p.select("series_id", "ds", F.col("idx").alias("composite")).join(gram.rolling_connectedness(p), ["series_id", "ds"])
    s = s.filter(F.col("ds").between(F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date")))
    return ev.lead_label(s, tb.events_dim(spark)).select("series_id", "ds", "label", "composite", "connectedness")


@query("ts_benchmark", "auroc auprc abs_spearman lead_spearman diff diff_lo diff_hi p")
def ts_benchmark(spark, d):
    """Index and naive benchmarks against the forward fall label: areas, rank correlation, the lead of up to 30 days at which it is highest,
    causality at a week, rank, and the difference of the area to that of the index with its interval and p under equal draws."""
    p = tb.stored_panel(spark, d)
    w = win.by_day()
    e = Window.partitionBy("series_id")
    r = p.withColumn("target", -(F.lead("idx", 30).over(w) / F.col("idx") - 1)).withColumn("label", (F.col("target") > 0.2).cast("int")).filter(F.col("target").isNotNull())
    r = r.withColumn("drawdown", 100.0 * (1.0 - F.col("stablecoin_risk") / F.max("stablecoin_risk").over(e)))
    models = ["idx", "drawdown", "contagion_risk"]
    r = stored(r.select("series_id", "ds", "target", "label", *[F.round(m, 6).alias(m) for m in models]), "benchmarks")
    long = r.unpivot(["series_id", "ds", "target", "label"], models, "model", "score")
    keys = ["series_id", "model"]
    a = classify.areas(classify.curve(long, keys), keys).select(*keys, "auroc", "auprc")
    lead = sn.best_lead(long, keys, "score", "target", 30)
    g = linear.granger(long.select("series_id", "ds", F.col("model").alias("cause"), F.lit("target").alias("effect"), F.col("score").alias("x"), F.col("target").alias("y")), (7,))
    g = g.select("series_id", F.col("cause").alias("model"), (F.col("p") < 0.05).alias("causal"))
    reps = stored(rs.replicate_metrics(r, models, "label", reps=REPLICATES, iid=True), "replicates")
    diff = rs.paired_difference(reps, "idx").select(*keys, F.col("boot_mean").alias("diff"), F.col("lo").alias("diff_lo"), F.col("hi").alias("diff_hi"), "p")
    return a.join(lead, keys).join(g, keys).join(diff, keys, "left").withColumn("place", F.rank().over(e.orderBy(F.desc(F.round("auroc", 12)))))


@query("ts_walk_forward_opt", "test_r2 test_mse stability")
def ts_walk_forward_opt(spark, d):
    """Weights refitted on each training fold, scored on its test fold; mean correlation of the fold weights."""
    p = forward_panel(spark, d)
    rows = sn.fold_rows(p, sn.purged_folds(p))
    fit = gram.elastic_net(rows.filter("split = 'train'"), "target", keys=("series_id", "fold"))
    wv = fit.groupBy("series_id", "fold").pivot("channel", S.CHANNELS).agg(F.first("weight"))
    wide = wv.select("series_id", "fold", *[F.col(c).alias(f"w_{c}") for c in S.CHANNELS])
    t = rows.filter("split = 'test'").join(wide, ["series_id", "fold"])
    t = t.withColumn("pred", sum((F.col(f"w_{c}") * F.col(c) for c in S.CHANNELS), F.lit(0.0)))
    s = sn.fit_scores(t, ["series_id", "fold"]).select("series_id", "fold", F.col("n").alias("test_n"), F.col("r2").alias("test_r2"), F.col("mse").alias("test_mse"))
    piv = fit.groupBy("series_id", "channel").pivot("fold", list(range(5))).agg(F.first("weight"))
    cor = ag.channel_pairs(piv, ["series_id"], [str(i) for i in range(5)]).groupBy("series_id", "ch_a", "ch_b").agg(corr("x", "y").alias("r"))
    return s.join(cor.groupBy("series_id").agg(F.avg("r").alias("stability")), "series_id", "left")


@query("ts_validation_run", "value", W(PANEL, EVENTS_DIM, WIN, CASB, WSENS, """
  hold AS (SELECT series_id, ds > DATE '1999-12-31' AS test, idx AS pred, lead(idx, 30) OVER (PARTITION BY series_id ORDER BY ds) AS target FROM panel),
  rb AS (SELECT series_id, channel, max(rate) - min(rate) < 0.15 AS robust FROM wdet GROUP BY 1, 2)""", f"""
  tidy AS (SELECT series_id, 'significant_events' AS study, CAST(count(*) FILTER (WHERE abs(t_stat) > 2.0211) AS DOUBLE) AS value FROM cas GROUP BY 1
    UNION ALL SELECT series_id, 'holdout_r2', 1-sum((target-pred)^2)/(var_pop(target)*count(*)) FROM hold WHERE target IS NOT NULL AND test GROUP BY 1
    UNION ALL SELECT series_id, 'robust_channels', count(*) FILTER (WHERE robust) FROM rb GROUP BY 1
    UNION ALL SELECT series_id, 'kpss', level FROM ({CATALOGUE["ts_kpss"].sql})
    UNION ALL SELECT series_id, 'chow', chow FROM ({CATALOGUE["ts_chow"].sql})
    UNION ALL SELECT series_id, 'cusum', max_cusum FROM ({CATALOGUE["ts_cusum"].sql}))""", q="""
  SELECT * FROM tidy UNION ALL SELECT series_id, 'passed', CAST(max(value) FILTER (WHERE study = 'significant_events') >= 3 AND max(value) FILTER (WHERE study = 'holdout_r2') > 0 AND max(value) FILTER (WHERE study = 'robust_channels') >= 2 AS INT) FROM tidy GROUP BY 1"""), digits=5)
def ts_validation_run(spark, d):
    """The suite as one tidy table, with a pass flag per series: at least three significant events, positive
    out-of-sample R2 of the refitted index, at least two robust channels."""
    p = tb.stored_panel(spark, d)
    e = tb.events_dim(spark)
    tidy = lambda df, study, value: df.select("series_id", F.lit(study).alias("study"), value.cast("double").alias("value"))
    events = es.study(p, e).groupBy("series_id").agg(F.count_if(F.abs("t_stat") > 2.0211).alias("v"))
    hold = sn.holdout(forward_frame(spark, d), "1999-12-31")
    robust = sn.weight_summary(sn.weight_table(p, e)).groupBy("series_id").agg(F.count_if("robust").alias("v"))
    parts = [
        tidy(events, "significant_events", F.col("v")), tidy(hold, "holdout_r2", F.col("test_r2")), tidy(robust, "robust_channels", F.col("v")),
        tidy(breaks.kpss(p), "kpss", F.col("kpss")), tidy(breaks.chow(p), "chow", F.col("chow")), tidy(breaks.cusum_test(p), "cusum", F.col("max_cusum")),
    ]
    t = reduce(lambda a, b: a.unionByName(b), parts)
    pick = lambda s: F.max(F.when(F.col("study") == s, F.col("value")))
    ok = t.groupBy("series_id").agg(((pick("significant_events") >= 3) & (pick("holdout_r2") > 0) & (pick("robust_channels") >= 2)).cast("double").alias("value"))
    return t.unionByName(ok.select("series_id", F.lit("passed").alias("study"), "value"))
