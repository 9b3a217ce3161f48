"""Queries over event studies, classification, sensitivity and stability tests."""

from __future__ import annotations

import zlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from stressloom import schema as S
from stressloom.operators import aggregates as ag
from stressloom.operators import breaks, classify, eventjoin as ev, paths, sensitivity as sn
from stressloom.operators import event_study as es
from stressloom.operators import windows as win
from stressloom.plans.aggregations import AVGRANK, CHS, LABELLED, LONG, RATIOS, RETS
from stressloom.plans.registry import query
from stressloom.plans.sqltext import DAILY_ORDERS, EVENTS_DIM, OBSERVATIONS, PANEL, W, draw_sql
from stressloom.plans.windowing import BREACH, CUSUM, FWD, SUST, WIN
from stressloom.sources import tables as tb


def pe(spark, d):
    return tb.panel(spark, d), tb.events_dim(spark)


def stored_pe(spark, d):
    """For plans that use the panel in several branches."""
    return tb.stored_panel(spark, d), tb.events_dim(spark)


CASB = """cas AS (SELECT *, n*(ma-mu) AS cas, n*(ma-mu)/(sd*sqrt(n)) AS t_stat FROM base)"""
STUDY = "n expected expected_sd cas t_stat peak"


@query("ts_event_study", "expected expected_sd cas t_stat peak", W(PANEL, EVENTS_DIM, WIN, CASB, BREACH.format(k=30), q="""
  SELECT series_id, event, 'paper_v2' AS profile, n, mu AS expected, sd AS expected_sd, cas, t_stat, peak, CAST(s AS BIGINT) AS lead_days FROM cas JOIN breach USING (series_id, event)"""))
def ts_event_study(spark, d):
    return es.study(*pe(spark, d))


@query("ts_lead_time", "", W(PANEL, EVENTS_DIM, WIN, BREACH.format(k=60), SUST.format(k=60), q="""
  SELECT series_id, event, CAST(s AS BIGINT) AS first_sigma, CAST(l AS BIGINT) AS first_level, CAST(u AS BIGINT) AS sustained FROM breach JOIN sust USING (series_id, event)"""))
def ts_lead_time(spark, d):
    return es.lead_times(*pe(spark, d), 60)


@query("ts_profile_compare", "mean_lead mean_t mean_cas", W(PANEL, EVENTS_DIM, WIN, CASB, BREACH.format(k=30), BREACH.format(k=60).replace("breach AS", "breach60 AS"), SUST.format(k=60), """
  base60 AS (SELECT series_id, event, avg(x) FILTER (WHERE rel BETWEEN -60 AND -31) AS mu, stddev_samp(x) FILTER (WHERE rel BETWEEN -60 AND -31) AS sd, avg(x) FILTER (WHERE rel >= -30) AS ma, count(*) FILTER (WHERE rel >= -30) AS n FROM evw GROUP BY 1,2),
  prof AS (SELECT 'paper_v2' AS profile, c.series_id, cas, t_stat, s AS lead FROM cas c JOIN breach b USING (series_id, event)
    UNION ALL SELECT 'legacy_v1', c.series_id, cas, t_stat, s FROM cas c JOIN breach60 b USING (series_id, event)
    UNION ALL SELECT 'counterfactual_60d', c.series_id, n*(ma-mu), n*(ma-mu)/(sd*sqrt(n)), u FROM base60 c JOIN sust USING (series_id, event))""", q="""
  SELECT series_id, profile, count(*) AS n_events, count(*) FILTER (WHERE abs(t_stat) > 2.0211) AS n_significant, avg(lead) AS mean_lead, avg(t_stat) AS mean_t, avg(cas) AS mean_cas FROM prof GROUP BY 1, 2"""))
def ts_profile_compare(spark, d):
    p, e = stored_pe(spark, d)
    out = None
    for name in S.EVENT_PROFILES:
        s = es.study(p, e, name)
        out = s if out is None else out.unionByName(s)
    return out.groupBy("series_id", "profile").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.abs("t_stat") > 2.0211).alias("n_significant"),
        F.avg("lead_days").alias("mean_lead"), F.avg("t_stat").alias("mean_t"), F.avg("cas").alias("mean_cas"))


HACS = """abn AS (SELECT series_id, event, x - mu AS a, x - ma AS e, n, mu, sd, ma, row_number() OVER (PARTITION BY series_id, event ORDER BY rel) AS k FROM evw JOIN base USING (series_id, event) WHERE rel >= -30),
 gam AS (SELECT a.series_id, a.event, a.k - b.k AS h, sum(a.e*b.e) AS g, any_value(a.n) AS n, any_value(a.ma - a.mu) AS m FROM abn a JOIN abn b ON a.series_id=b.series_id AND a.event=b.event AND a.k - b.k BETWEEN 0 AND 30 GROUP BY 1,2,3),
 hac AS (SELECT series_id, event, lag, any_value(n) AS n, any_value(m) AS m, sqrt(sum(CASE WHEN h = 0 THEN g WHEN h <= lag THEN 2*(1-h/(lag+1.0))*g ELSE 0 END))/any_value(n) AS se
   FROM gam CROSS JOIN (VALUES (3),(10),(20),(30)) v(lag) GROUP BY 1,2,3)"""


@query("ts_hac", "cas t_stat se_mean t_hac", W(PANEL, EVENTS_DIM, WIN, CASB, HACS, q="""
  SELECT series_id, event, c.n, cas, t_stat, lag, CASE WHEN c.n > lag THEN se END AS se_mean, CASE WHEN c.n > lag THEN m/se END AS t_hac, CASE WHEN c.n > lag THEN abs(m/se) > 3.52 END AS beyond_fixed_b FROM cas c JOIN hac USING (series_id, event)"""))
def ts_hac(spark, d):
    return es.hac(*pe(spark, d))


@query("ts_ar1_ljung_box", "ar1_est ar1_evt q5 q10 q20", W(PANEL, EVENTS_DIM, WIN, HACS, """
  este AS (SELECT series_id, event, x - mu AS e, row_number() OVER (PARTITION BY series_id, event ORDER BY rel) AS k FROM evw JOIN base USING (series_id, event) WHERE rel <= -31),
  estar AS (SELECT a.series_id, a.event, sum(a.e*b.e)/(SELECT sum(c.e*c.e) FROM este c WHERE c.series_id=a.series_id AND c.event=a.event) AS r FROM este a JOIN este b ON a.series_id=b.series_id AND a.event=b.event AND a.k=b.k+1 GROUP BY 1,2),
  rho AS (SELECT g.series_id, g.event, g.h, g.n, g.g/z.g AS r FROM gam g JOIN gam z ON g.series_id=z.series_id AND g.event=z.event AND z.h=0)""", q="""
  SELECT r.series_id, r.event, any_value(e.r) AS ar1_est, max(r.r) FILTER (WHERE h=1) AS ar1_evt, any_value(n*(n+2))*sum(r.r^2/(n-h)) FILTER (WHERE h BETWEEN 1 AND 5) AS q5,
   any_value(n*(n+2))*sum(r.r^2/(n-h)) FILTER (WHERE h BETWEEN 1 AND 10) AS q10, any_value(n*(n+2))*sum(r.r^2/(n-h)) FILTER (WHERE h BETWEEN 1 AND 20) AS q20
  FROM rho r JOIN estar e ON r.series_id=e.series_id AND r.event=e.event GROUP BY 1, 2"""))
def ts_ar1_ljung_box(spark, d):
    return es.serial_correlation(*pe(spark, d))


PLAC = """elig AS (SELECT series_id, ds AS event_date FROM panel p JOIN (SELECT series_id, min(ds) lo, max(ds) hi FROM panel GROUP BY 1) USING (series_id)
   WHERE ds >= lo + 90 AND ds <= hi - 90 AND NOT EXISTS (SELECT 1 FROM events_dim WHERE abs(event_date - ds) < 90)),
 pw AS (SELECT e.series_id, e.event_date, p.ds - e.event_date AS rel, p.idx AS x FROM elig e JOIN panel p ON p.series_id=e.series_id AND p.ds BETWEEN e.event_date - 90 AND e.event_date + 10),
 pb AS (SELECT series_id, event_date, avg(x) FILTER (WHERE rel<=-31) mu, stddev_samp(x) FILTER (WHERE rel<=-31) sd, avg(x) FILTER (WHERE rel>=-30) ma, count(*) FILTER (WHERE rel>=-30) n, count(*) FILTER (WHERE rel<=-31) ne FROM pw GROUP BY 1,2),
 pa AS (SELECT w.series_id, w.event_date, x - ma AS e, row_number() OVER (PARTITION BY w.series_id, w.event_date ORDER BY rel) k FROM pw w JOIN pb USING (series_id, event_date) WHERE rel >= -30),
 pg AS (SELECT a.series_id, a.event_date, sum(CASE WHEN a.k=b.k THEN 1 ELSE 2*(1-(a.k-b.k)/21.0) END*a.e*b.e) AS s FROM pa a JOIN pa b ON a.series_id=b.series_id AND a.event_date=b.event_date AND a.k-b.k BETWEEN 0 AND 20 GROUP BY 1,2),
 plac AS (SELECT series_id, event_date, n, n*(ma-mu) AS cas, n*(ma-mu)/(sd*sqrt(n)) AS t_naive, (ma-mu)/(sqrt(s)/n) AS t_hac FROM pb JOIN pg USING (series_id, event_date) WHERE n > 21 AND ne >= 20)"""


@query("ts_placebo_all", "mean_abs_t max_abs_t median_abs_t q95_abs_t share_beyond", W(PANEL, EVENTS_DIM, PLAC, q="""
  SELECT series_id, count(*) AS n_dates, avg(abs(t_hac)) AS mean_abs_t, max(abs(t_hac)) AS max_abs_t, median(abs(t_hac)) AS median_abs_t, quantile_cont(abs(t_hac),0.95) AS q95_abs_t,
   count(*) FILTER (WHERE abs(t_hac) > 3.52) AS n_beyond, avg(CAST(abs(t_hac) > 3.52 AS INT)) AS share_beyond FROM plac GROUP BY 1"""))
def ts_placebo_all(spark, d):
    return es.placebo_summary(es.placebo_table(*stored_pe(spark, d)))


@query("ts_placebo_p", "p_one_sided p_two_sided", W(PANEL, EVENTS_DIM, WIN, CASB, HACS, PLAC, q="""
  SELECT p.series_id, o.event, avg(CAST(t_hac >= o.m/o.se AS INT)) AS p_one_sided, avg(CAST(abs(t_hac) >= abs(o.m/o.se) AS INT)) AS p_two_sided
  FROM plac p JOIN hac o ON p.series_id=o.series_id AND o.lag=20 GROUP BY 1, 2"""))
def ts_placebo_p(spark, d):
    p, e = stored_pe(spark, d)
    seen = es.hac(p, e, (S.HAC_PRIMARY_LAG,)).select("series_id", "event", "t_hac")
    return es.placebo_p(es.placebo_table(p, e), seen)


@query("ts_circular_shift", "observed null_mean p", W(PANEL, """
  t AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS n, contagion_risk AS x, idx >= 65 AND coalesce(lag(idx) OVER (PARTITION BY series_id ORDER BY ds), 0) < 65 AS o FROM panel),
  s AS (SELECT a.series_id, b.s, avg(v.x) AS stat FROM t a JOIN (SELECT series_id, k AS s FROM t) b ON a.series_id=b.series_id JOIN t v ON v.series_id=a.series_id AND v.k = (a.k + b.s - 1 + a.n) % a.n WHERE a.o GROUP BY 1, 2)""", q="""
  SELECT s.series_id, any_value(z.stat) AS observed, avg(s.stat) AS null_mean, (1.0 + count(*) FILTER (WHERE s.stat >= z.stat - 1e-9))/(1+count(*)) AS p, any_value(c) AS n_onsets
  FROM s JOIN s z ON s.series_id=z.series_id AND z.s=0 JOIN (SELECT series_id, count(*) FILTER (WHERE o) c FROM t GROUP BY 1) q ON q.series_id=s.series_id GROUP BY 1"""))
def ts_circular_shift(spark, d):
    p = tb.panel(spark, d)
    onset = (F.col("idx") >= 65) & (F.coalesce(F.lag("idx").over(win.by_day()), F.lit(0.0)) < 65)
    return breaks.circular_shift(p.withColumn("onset", onset), "onset", "contagion_risk")


@query("ts_chow", "chow", W(PANEL, """
  a AS (SELECT series_id, idx AS y, lag(idx) OVER (PARTITION BY series_id ORDER BY ds) AS x, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM panel),
  s AS (SELECT series_id, any_value(n) n, regr_syy(y,x)-regr_sxy(y,x)^2/regr_sxx(y,x) AS f, regr_syy(y,x) FILTER (WHERE i < n//2) - (regr_sxy(y,x) FILTER (WHERE i < n//2))^2/(regr_sxx(y,x) FILTER (WHERE i < n//2)) AS s1,
    regr_syy(y,x) FILTER (WHERE i >= n//2) - (regr_sxy(y,x) FILTER (WHERE i >= n//2))^2/(regr_sxx(y,x) FILTER (WHERE i >= n//2)) AS s2 FROM a WHERE x IS NOT NULL GROUP BY 1)""", q="""
  SELECT series_id, n, ((f-s1-s2)/2)/((s1+s2)/(n-4)) AS chow FROM s"""))
def ts_chow(spark, d):
    return breaks.chow(tb.panel(spark, d))


@query("ts_cusum", "max_cusum stability", W(PANEL, CUSUM, q="""
  SELECT series_id, max(abs(cusum)) AS max_cusum, max(abs(cusum)) < 1.36 AS stable, 1-least(max(abs(cusum))/2.72, 1.0) AS stability FROM cus GROUP BY 1"""))
def ts_cusum(spark, d):
    return breaks.cusum_test(tb.panel(spark, d)).drop("n_breaks")


@query("ts_kpss", "level trend", W(PANEL, """
  b AS (SELECT series_id, ds, idx AS x, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ds) AS DOUBLE) AS t FROM panel),
  f AS (SELECT series_id, avg(x) mu, regr_slope(x,t) sl, regr_intercept(x,t) ic, count(*) n, CAST(floor(4*(count(*)/100.0)^0.25) AS INT) AS lg FROM b GROUP BY 1),
  r AS (SELECT series_id, t, x-mu AS e1, x-(ic+sl*t) AS e2, n, lg FROM b JOIN f USING (series_id)),
  c AS (SELECT series_id, sum(s1*s1) q1, sum(s2*s2) q2 FROM (SELECT series_id, sum(e1) OVER (PARTITION BY series_id ORDER BY t) s1, sum(e2) OVER (PARTITION BY series_id ORDER BY t) s2 FROM r) GROUP BY 1),
  g AS (SELECT a.series_id, any_value(a.n) n, any_value(a.lg) lags, sum(CASE WHEN a.t=b.t THEN 1 ELSE 2*(1-(a.t-b.t)/(a.lg+1.0)) END*a.e1*b.e1) v1, sum(CASE WHEN a.t=b.t THEN 1 ELSE 2*(1-(a.t-b.t)/(a.lg+1.0)) END*a.e2*b.e2) v2
     FROM r a JOIN r b ON a.series_id=b.series_id AND a.t-b.t BETWEEN 0 AND a.lg GROUP BY 1)""", q="SELECT series_id, n, lags, q1/(n*v1) AS level, q2/(n*v2) AS trend FROM g JOIN c USING (series_id)"))
def ts_kpss(spark, d):
    p = tb.panel(spark, d)
    a, b = breaks.kpss(p), breaks.kpss(p, trend=True)
    return a.withColumnRenamed("kpss", "level").join(b.select("series_id", F.col("kpss").alias("trend")), "series_id")


# ----------------------------------------------------------- classification
CURVE = """sc AS (SELECT series_id, round(round(idx, 6), 1) AS score, label FROM labelled),
 cnt AS (SELECT series_id, score, CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg FROM sc GROUP BY 1, 2),
 curve AS (SELECT *, CAST(sum(pos) OVER (PARTITION BY series_id ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (PARTITION BY series_id ORDER BY score DESC) AS BIGINT) AS fp,
   CAST(sum(pos) OVER (PARTITION BY series_id) AS BIGINT) AS n_pos, CAST(sum(neg) OVER (PARTITION BY series_id) AS BIGINT) AS n_neg FROM cnt)"""
SC = (PANEL, EVENTS_DIM, LABELLED, CURVE)


def scored_curve(spark, d):
    lab = ev.lead_label(tb.panel(spark, d), tb.events_dim(spark))
    s = lab.select("series_id", F.round(F.round("idx", 6), 1).alias("score"), "label")
    return classify.curve(s, ["series_id"])


@query("ts_roc", "fpr tpr score", W(*SC, q="""
  SELECT series_id, fp*1.0/n_neg AS fpr, tp*1.0/n_pos AS tpr, score FROM curve UNION ALL SELECT DISTINCT series_id, 0, 0, CAST(NULL AS DOUBLE) FROM curve UNION ALL SELECT DISTINCT series_id, 1, 1, CAST(NULL AS DOUBLE) FROM curve"""))
def ts_roc(spark, d):
    return classify.roc_points(scored_curve(spark, d), ["series_id"])


@query("ts_pr", "score precision recall", W(*SC, q="SELECT series_id, score, tp*1.0/(tp+fp) AS precision, tp*1.0/n_pos AS recall FROM curve"))
def ts_pr(spark, d):
    return classify.pr_points(scored_curve(spark, d), ["series_id"])


AUC_RANK = f"""auc AS (SELECT series_id, (sum(r) FILTER (WHERE label=1) - count(*) FILTER (WHERE label=1)*(count(*) FILTER (WHERE label=1)+1)/2.0)/(CAST(count(*) FILTER (WHERE label=1) AS DOUBLE)*count(*) FILTER (WHERE label=0)) AS auroc
  FROM (SELECT series_id, label, {AVGRANK.format(k='series_id', x='score')} AS r FROM sc) GROUP BY 1)"""


@query("ts_auroc", "auroc", W(*SC, AUC_RANK, q="SELECT series_id, auroc FROM auc"))
def ts_auroc(spark, d):
    return classify.areas(scored_curve(spark, d), ["series_id"]).select("series_id", "auroc")


@query("ts_auroc_documents", "auroc average_precision", """
  SELECT 'quality' AS target, (sum(r) FILTER (WHERE quality=1) - count(*) FILTER (WHERE quality=1)*(count(*) FILTER (WHERE quality=1)+1)/2.0)/(CAST(count(*) FILTER (WHERE quality=1) AS DOUBLE)*count(*) FILTER (WHERE quality=0)) AS auroc,
    (SELECT sum(pos*1.0/np*tp/(tp+fp)) FROM (SELECT pos, sum(pos) OVER (ORDER BY n_chars DESC) tp, sum(neg) OVER (ORDER BY n_chars DESC) fp, sum(pos) OVER () np FROM (SELECT n_chars, sum(quality) pos, count(*)-sum(quality) neg FROM labels JOIN documents USING (doc_id) GROUP BY 1))) AS average_precision
  FROM (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars)-1)/2.0 AS r FROM labels JOIN documents USING (doc_id))""")
def ts_auroc_documents(spark, d):
    docs = tb.read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score"))
    j = tb.read(spark, d, "labels").join(docs, "doc_id").select(F.lit("quality").alias("target"), "score", F.col("quality").alias("label"))
    return classify.areas(classify.curve(j, ["target"], width=256.0), ["target"]).select("target", "auroc", "average_precision")


@query("ts_auprc", "auprc average_precision", W(*SC, q="""
  SELECT series_id, sum(CASE WHEN pp IS NOT NULL THEN (r-pr)*(p+pp)/2 ELSE 0 END) AS auprc, sum((r-coalesce(pr,0))*p) AS average_precision FROM (
   SELECT *, lag(p) OVER w AS pp, lag(r) OVER w AS pr FROM (SELECT series_id, score, tp*1.0/(tp+fp) AS p, tp*1.0/n_pos AS r FROM curve) WINDOW w AS (PARTITION BY series_id ORDER BY score DESC)) GROUP BY 1"""))
def ts_auprc(spark, d):
    return classify.areas(scored_curve(spark, d), ["series_id"]).select("series_id", "auprc", "average_precision")


@query("ts_auc_oriented", "auroc auroc_oriented", W(*SC, AUC_RANK, q="SELECT series_id, auroc, CASE WHEN auroc >= 0.5 THEN 1 ELSE -1 END AS sign, greatest(auroc, 1-auroc) AS auroc_oriented FROM auc"))
def ts_auc_oriented(spark, d):
    a = classify.areas(scored_curve(spark, d), ["series_id"]).select("series_id", "auroc")
    return classify.oriented(a)


OPT = f"""met AS (SELECT *, recall+specificity-1 AS youden, (recall+specificity)/2 AS balanced FROM (SELECT series_id, score, tp, fp, tn, fn, {RATIOS} FROM (SELECT *, n_neg-fp AS tn, n_pos-tp AS fn FROM curve)))"""


@query("ts_optimal_threshold", "threshold value", W(*SC, OPT, q="""
  SELECT series_id, criterion, score AS threshold, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY series_id, criterion ORDER BY round(v,12) DESC, score) rn FROM (
   SELECT series_id, score, 'f1' AS criterion, f1 AS v FROM met UNION ALL SELECT series_id, score, 'youden', youden FROM met UNION ALL SELECT series_id, score, 'balanced', balanced FROM met)) WHERE rn = 1"""))
def ts_optimal_threshold(spark, d):
    return classify.optimal_all(scored_curve(spark, d), ["series_id"])


@query("topk_argbest", "threshold f1", W(*SC, OPT, q="""
  SELECT series_id, score AS threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(f1,12) DESC, score) rn FROM met) WHERE rn = 1"""))
def topk_argbest(spark, d):
    return sn.best_by(classify.at_thresholds(scored_curve(spark, d)), ["series_id"], "f1", "score").select("series_id", F.col("score").alias("threshold"), "f1")


@query("ts_roc_metrics", "auroc auprc threshold precision recall specificity f1 balanced mcc", W(*SC, AUC_RANK, OPT, """
  prx AS (SELECT series_id, sum(CASE WHEN pp IS NOT NULL THEN (r-pr)*(p+pp)/2 ELSE 0 END) AS auprc FROM (SELECT *, lag(p) OVER w AS pp, lag(r) OVER w AS pr FROM (SELECT series_id, score, tp*1.0/(tp+fp) AS p, tp*1.0/n_pos AS r FROM curve) WINDOW w AS (PARTITION BY series_id ORDER BY score DESC)) GROUP BY 1),
  bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(f1,12) DESC, score) rn FROM met) WHERE rn = 1)""", q="""
  SELECT series_id, auroc, auprc, score AS threshold, tp, fp, tn, fn, precision, recall, specificity, f1, balanced,
    CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) > 0 THEN (tp*tn-fp*fn)/sqrt(CAST(tp+fp AS DOUBLE)*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0 END AS mcc FROM bst JOIN auc USING (series_id) JOIN prx USING (series_id)"""))
def ts_roc_metrics(spark, d):
    return classify.metrics(scored_curve(spark, d), ["series_id"]).drop("average_precision", "youden")


DET = """det AS (SELECT series_id, event, max(idx) AS peak30, coalesce(max(event_date - ds) FILTER (WHERE idx >= 50), 0) AS lead FROM panel JOIN events_dim ON ds BETWEEN event_date - 30 AND event_date - 1 GROUP BY 1, 2),
 wf AS (SELECT series_id, event, quantile_cont(idx, 0.9) AS threshold, count(*) AS n_train FROM panel JOIN events_dim ON ds < event_date - 90 GROUP BY 1, 2 HAVING count(*) >= 60)"""


@query("ts_detection_matrix", "peak t_stat wf_threshold", W(PANEL, EVENTS_DIM, WIN, CASB, DET, q="""
  SELECT series_id, event, peak, peak30 >= 40 AS at_40, peak30 >= 50 AS at_50, peak30 >= 60 AS at_60, peak30 >= 70 AS at_70, t_stat, abs(t_stat) > 2.7045 AS significant, threshold AS wf_threshold, peak30 >= threshold AS wf_detected
  FROM cas JOIN det USING (series_id, event) JOIN wf USING (series_id, event)"""))
def ts_detection_matrix(spark, d):
    p, e = stored_pe(spark, d)
    s = es.study(p, e).select("series_id", "event", "peak", "t_stat", (F.abs("t_stat") > 2.7045).alias("significant"))
    w = es.walk_forward(p, e).select("series_id", "event", F.col("threshold").alias("wf_threshold"), F.col("detected").alias("wf_detected"), *[(F.col("peak") >= t).alias(f"at_{t}") for t in (40, 50, 60, 70)])
    return s.join(w, ["series_id", "event"])


@query("ts_walk_forward_threshold", "threshold peak", W(PANEL, EVENTS_DIM, DET, q="""
  SELECT series_id, event, threshold, n_train, max(idx) AS peak, max(idx) >= threshold AS detected, coalesce(max(event_date - ds) FILTER (WHERE idx >= threshold), 0) AS lead
  FROM panel JOIN events_dim ON ds BETWEEN event_date - 30 AND event_date - 1 JOIN wf USING (series_id, event) GROUP BY 1, 2, 3, 4"""))
def ts_walk_forward_threshold(spark, d):
    return es.walk_forward(*stored_pe(spark, d))


THR = """thr AS (SELECT series_id, threshold, alerts, CASE WHEN alerts > 0 THEN ta*1.0/alerts ELSE 0 END AS precision, coalesce(hit, 0)/4.0 AS recall, CASE WHEN quiet > 0 THEN tq*1.0/quiet ELSE 0 END AS specificity FROM (
  SELECT series_id, threshold, count(*) FILTER (WHERE idx > threshold) alerts, count(*) FILTER (WHERE idx > threshold AND pre) ta, count(*) FILTER (WHERE idx <= threshold) quiet, count(*) FILTER (WHERE idx <= threshold AND NOT pre) tq
  FROM (SELECT *, EXISTS (SELECT 1 FROM events_dim e WHERE e.event_date > p.ds AND e.event_date - p.ds <= 30) AS pre FROM panel p) CROSS JOIN (VALUES (40.0),(50.0),(60.0),(70.0),(80.0)) v(threshold) GROUP BY 1, 2)
  LEFT JOIN (SELECT series_id, threshold, count(DISTINCT event) hit FROM panel JOIN events_dim ON event_date > ds AND event_date - ds <= 30 JOIN (VALUES (40.0),(50.0),(60.0),(70.0),(80.0)) v(threshold) ON idx > threshold GROUP BY 1, 2) USING (series_id, threshold))"""
THRS = [40.0, 50.0, 60.0, 70.0, 80.0]


@query("ts_threshold_sens", "threshold precision recall f1 specificity", W(PANEL, EVENTS_DIM, THR, q="""
  SELECT series_id, threshold, alerts, precision, recall, CASE WHEN precision+recall > 0 THEN 2*precision*recall/(precision+recall) ELSE 0 END AS f1, specificity FROM thr"""))
def ts_threshold_sens(spark, d):
    return sn.threshold_table(*pe(spark, d), THRS)


def _fwd_sql(k):
    return (f"fw{k} AS (SELECT a.series_id, a.ds, min(c.level/pk - 1) AS dd FROM growth a JOIN (SELECT c.series_id, c.pos, c.level, s.pos AS start, max(c.level) OVER (PARTITION BY c.series_id, s.pos ORDER BY c.pos) AS pk "
            f"FROM growth s JOIN growth c ON s.series_id = c.series_id AND c.pos BETWEEN s.pos AND s.pos + {k - 1}) c ON a.series_id = c.series_id AND a.pos = c.start "
            f"JOIN (SELECT series_id, max(pos) mp FROM growth GROUP BY 1) m ON a.series_id = m.series_id AND a.pos + {k} <= m.mp GROUP BY 1, 2), "
            f"lb{k} AS (SELECT g.series_id, g.ds, {k} AS width, level AS score, CAST(coalesce(dd < -0.6, false) AS INT) AS label FROM growth g LEFT JOIN fw{k} USING (series_id, ds))")


WIDTHS = [14, 30, 60, 90]
LBS = FWD.split(",\n")[0] + ",\n" + ",\n".join(_fwd_sql(k) for k in WIDTHS) + ",\nlbs AS (" + " UNION ALL ".join(f"SELECT * FROM lb{k}" for k in WIDTHS) + f"""),
 wauc AS (SELECT series_id, width, CASE WHEN min(label)=max(label) THEN 0.5 ELSE (sum(r) FILTER (WHERE label=1) - count(*) FILTER (WHERE label=1)*(count(*) FILTER (WHERE label=1)+1)/2.0)/(CAST(count(*) FILTER (WHERE label=1) AS DOUBLE)*count(*) FILTER (WHERE label=0)) END AS auc,
   coalesce(2.0*count(*) FILTER (WHERE label=1 AND score>=70)/nullif(2*count(*) FILTER (WHERE label=1 AND score>=70)+count(*) FILTER (WHERE label=0 AND score>=70)+count(*) FILTER (WHERE label=1 AND score<70),0), 0) AS f1
  FROM (SELECT *, {AVGRANK.format(k='series_id, width', x='score')} AS r FROM lbs) GROUP BY 1, 2),
 wlead AS (SELECT s.series_id, s.width, avg(coalesce(l, 0)) AS lead FROM (SELECT * FROM (SELECT *, label=1 AND coalesce(lag(label) OVER (PARTITION BY series_id, width ORDER BY ds),0)=0 AS st FROM lbs) WHERE st) s
   LEFT JOIN (SELECT s.series_id, s.width, s.ds, max(s.ds - a.ds) AS l FROM lbs s JOIN lbs a ON s.series_id=a.series_id AND s.width=a.width AND a.ds BETWEEN s.ds - s.width AND s.ds - 1 AND a.score >= 70 GROUP BY 1,2,3) q
   ON q.series_id=s.series_id AND q.width=s.width AND q.ds=s.ds GROUP BY 1,2)"""


@query("ts_window_sens", "auc f1 lead", W(PANEL, RETS, LBS, q="SELECT a.series_id, a.width, auc, f1, coalesce(lead, 0) AS lead FROM wauc a LEFT JOIN wlead l USING (series_id, width)"))
def ts_window_sens(spark, d):
    r = ag.returns(tb.stored_panel(spark, d)).select("series_id", "ds", "idx", "ret")
    return sn.window_table(r, "ret", "idx", WIDTHS, drawdown=-0.6)


WSENS = f"""grid AS (SELECT channel, step, -0.15 + 0.3*step/6 AS delta FROM {CHS} CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6)) g(step)),
 wts AS (SELECT *, w1/(w1+w2+w3+w4) AS a, w2/(w1+w2+w3+w4) AS b, w3/(w1+w2+w3+w4) AS c, w4/(w1+w2+w3+w4) AS e FROM (SELECT *,
   CASE WHEN channel='stablecoin_risk' THEN least(greatest(0.3+delta,0.01),0.99) ELSE 0.3 END w1, CASE WHEN channel='defi_liquidity_risk' THEN least(greatest(0.25+delta,0.01),0.99) ELSE 0.25 END w2,
   CASE WHEN channel='contagion_risk' THEN least(greatest(0.25+delta,0.01),0.99) ELSE 0.25 END w3, CASE WHEN channel='arbitrage_opacity' THEN least(greatest(0.2+delta,0.01),0.99) ELSE 0.2 END w4 FROM grid)),
 wide AS (SELECT series_id, ds, channel, step, delta, a*stablecoin_risk+b*defi_liquidity_risk+c*contagion_risk+e*arbitrage_opacity AS v FROM panel CROSS JOIN wts),
 wmom AS (SELECT series_id, channel, step, any_value(delta) AS delta, avg(v) AS mean, stddev_samp(v) AS std, max(v) AS max FROM wide GROUP BY 1,2,3),
 wdet AS (SELECT series_id, channel, step, avg(CAST(hit AS INT)) AS rate FROM (SELECT series_id, channel, step, event, max(round(v, 9)) >= 70 AS hit FROM wide JOIN events_dim ON ds BETWEEN event_date-30 AND event_date-1 GROUP BY 1,2,3,4) GROUP BY 1,2,3)"""


@query("ts_weight_sens", "delta mean std max detection_rate", W(PANEL, EVENTS_DIM, WSENS, q="""
  SELECT series_id, channel, step, delta, mean, std, max, rate AS detection_rate FROM wmom JOIN wdet USING (series_id, channel, step)"""))
def ts_weight_sens(spark, d):
    return sn.weight_table(*pe(spark, d))


@query("ts_full_sens", "value", W(PANEL, EVENTS_DIM, WSENS, THR, RETS, LBS, q="""
  SELECT series_id, 'weight:' || channel AS study, max(rate)-min(rate) AS value FROM wdet GROUP BY series_id, channel
  UNION ALL SELECT series_id, 'threshold', threshold FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(CASE WHEN precision+recall>0 THEN 2*precision*recall/(precision+recall) ELSE 0 END,12) DESC, threshold) rn FROM thr) WHERE rn=1
  UNION ALL SELECT series_id, 'window', width FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(auc,12) DESC, width) rn FROM wauc) WHERE rn=1"""))
def ts_full_sens(spark, d):
    p, e = stored_pe(spark, d)
    r = ag.returns(p).select("series_id", "ds", "idx", "ret")
    w = sn.weight_summary(sn.weight_table(p, e)).select("series_id", F.concat(F.lit("weight:"), "channel").alias("study"), F.col("range").alias("value"))
    t = sn.best_by(sn.threshold_table(p, e, THRS), ["series_id"], "f1", "threshold").select("series_id", F.lit("threshold").alias("study"), F.col("threshold").alias("value"))
    k = sn.best_by(sn.window_table(r, "ret", "idx", WIDTHS, drawdown=-0.6), ["series_id"], "auc", "width").select("series_id", F.lit("window").alias("study"), F.col("width").cast("double").alias("value"))
    return w.unionByName(t).unionByName(k)


ABL = """awt AS (SELECT * FROM (VALUES ('none',0.3,0.25,0.25,0.2),('stablecoin_risk',0.0,0.25,0.25,0.2),('defi_liquidity_risk',0.3,0.0,0.25,0.2),('contagion_risk',0.3,0.25,0.0,0.2),('arbitrage_opacity',0.3,0.25,0.25,0.0)) v(dropped,a,b,c,e)),
 adet AS (SELECT series_id, dropped, event, max(v) >= 50 AS hit, coalesce(max(event_date-ds) FILTER (WHERE v >= 50), 0) AS lead FROM (
   SELECT *, (a*stablecoin_risk+b*defi_liquidity_risk+c*contagion_risk+e*arbitrage_opacity)/(a+b+c+e) AS v FROM panel CROSS JOIN awt) JOIN events_dim ON ds BETWEEN event_date-30 AND event_date-1 GROUP BY 1,2,3),
 asum AS (SELECT series_id, dropped, count(*) FILTER (WHERE hit) AS n_detected, coalesce(avg(lead) FILTER (WHERE hit), 0) AS avg_lead, count(*) AS n FROM adet GROUP BY 1,2)"""


@query("ts_ablation", "avg_lead lead_delta importance", W(PANEL, EVENTS_DIM, ABL, q="""
  SELECT s.series_id, s.dropped, s.n_detected, s.avg_lead, s.avg_lead-b.avg_lead AS lead_delta, (b.n_detected-s.n_detected)*1.0/s.n AS importance,
   CASE WHEN s.dropped='none' THEN 'baseline' WHEN b.n_detected > s.n_detected THEN 'critical' ELSE 'redundant' END AS role FROM asum s JOIN asum b ON s.series_id=b.series_id AND b.dropped='none'"""))
def ts_ablation(spark, d):
    return sn.ablation(*pe(spark, d))


@query("ts_duration_sens", "channel_mean channel_std channel_max idx_mean idx_std idx_max", W(OBSERVATIONS, PANEL, EVENTS_DIM, """
  yld AS (SELECT p.*, TRY_CAST(value AS DOUBLE) AS y, event FROM panel p LEFT JOIN observations o ON p.ds=o.ds LEFT JOIN events_dim e ON p.ds BETWEEN e.event_date-30 AND e.event_date-1),
  dur AS (SELECT *, stablecoin_risk + 0.3*(coalesce(least(100.0, least(greatest((y-2)/4,0.0),1.0)*(1+0.2*duration)*100),50) - coalesce(least(100.0, least(greatest((y-2)/4,0.0),1.0)*1.05*100),50)) AS ch
    FROM yld CROSS JOIN (VALUES ('short',0.25),('mixed',0.5),('moderate',1.0),('extended',2.0),('long',5.0)) v(scenario,duration)),
  dv AS (SELECT *, 0.3*ch+0.25*defi_liquidity_risk+0.25*contagion_risk+0.2*arbitrage_opacity AS v FROM dur)""", q="""
  SELECT series_id, scenario, avg(ch) AS channel_mean, stddev_samp(ch) AS channel_std, max(ch) AS channel_max, avg(v) AS idx_mean, stddev_samp(v) AS idx_std, max(v) AS idx_max, count(DISTINCT event) FILTER (WHERE v >= 50) AS detections FROM dv GROUP BY 1,2"""))
def ts_duration_sens(spark, d):
    y = tb.observations(spark, d).select("ds", F.col("value").try_cast("double").alias("yield"))
    return sn.duration_table(tb.panel(spark, d), y, tb.events_dim(spark))


@query("ts_lag_impact", "peak late_peak loss_percent", W(PANEL, EVENTS_DIM, """
  lat AS (SELECT p.series_id, p.ds, p.idx AS now_, 0.3*a.stablecoin_risk+0.25*a.defi_liquidity_risk+0.25*c.contagion_risk+0.2*a.arbitrage_opacity AS late FROM panel p
    ASOF LEFT JOIN (SELECT series_id, ds + 1 AS seen, stablecoin_risk, defi_liquidity_risk, arbitrage_opacity FROM panel) a ON p.series_id=a.series_id AND p.ds >= a.seen
    ASOF LEFT JOIN (SELECT series_id, ds + 2 AS seen, contagion_risk FROM panel) c ON p.series_id=c.series_id AND p.ds >= c.seen),
  lg AS (SELECT series_id, event, max(now_) AS peak, max(late) AS late_peak, coalesce(max(event_date-ds) FILTER (WHERE now_ >= 50),0) AS la, coalesce(max(event_date-ds) FILTER (WHERE late >= 50),0) AS lb FROM lat JOIN events_dim ON ds BETWEEN event_date-5 AND event_date+9 GROUP BY 1,2)""", q="""
  SELECT series_id, event, peak, late_peak, (peak-late_peak)/peak*100 AS loss_percent, lb-la AS lead_change, CASE WHEN peak >= 50 THEN late_peak >= 50 ELSE true END AS kept FROM lg"""))
def ts_lag_impact(spark, d):
    return sn.lag_impact(*pe(spark, d))


@query("ts_quality_bands", "lo hi", W(PANEL, q="""
  SELECT series_id, ds, greatest(idx-5*(2-(0.3*0.9+0.25*0.85+0.25*0.7+0.2*0.5)), 0.0) AS lo, least(idx+5*(2-(0.3*0.9+0.25*0.85+0.25*0.7+0.2*0.5)), 100.0) AS hi FROM panel"""))
def ts_quality_bands(spark, d):
    conf = {"stablecoin_risk": 0.90, "defi_liquidity_risk": 0.85, "contagion_risk": 0.70, "arbitrage_opacity": 0.50}  # fixed values
    q = sum((F.lit(S.CHANNEL_WEIGHTS[c]) * F.lit(v) for c, v in conf.items()), F.lit(0.0))
    lo, hi = paths.quality_band(F.col("idx"), q)
    return tb.panel(spark, d).select("series_id", "ds", lo.alias("lo"), hi.alias("hi"))


FOLDS = """folds AS (SELECT series_id, fold, n-fold*sz-sz-30 AS train_end, n-fold*sz-sz AS test_start, n-fold*sz AS test_end FROM (SELECT series_id, CAST(count(*) AS INT) n, CAST(floor((count(*)-395)/5) AS INT) sz FROM {src} GROUP BY 1)
   CROSS JOIN (VALUES (0),(1),(2),(3),(4)) v(fold) WHERE n-395 >= 5 AND n-fold*sz-sz >= 395)"""


@query("ts_purged_split", "", W(PANEL, FOLDS.format(src="panel"), q="SELECT series_id, fold, 0 AS train_start, train_end, test_start, test_end FROM folds"))
def ts_purged_split(spark, d):
    return sn.purged_folds(tb.panel(spark, d))


TARGET = """tgt AS (SELECT * FROM (SELECT series_id, ds, idx AS pred, lead(idx, 30) OVER (PARTITION BY series_id ORDER BY ds) AS target FROM panel) WHERE target IS NOT NULL),
 num AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS p FROM tgt)"""


def forward_frame(spark, d):
    p = tb.stored_panel(spark, d).select("series_id", "ds", F.col("idx").alias("pred"), F.lead("idx", 30).over(win.by_day()).alias("target"))
    return p.filter(F.col("target").isNotNull())


@query("ts_walk_forward", "test_r2 test_mse train_r2 test_rho", W(PANEL, TARGET, FOLDS.format(src="tgt"), """
  fr AS (SELECT n.series_id, fold, pred, target, CASE WHEN p < train_end THEN 'train' WHEN p >= test_start AND p < test_end THEN 'test' END AS split FROM num n JOIN folds USING (series_id)),
  sc AS (SELECT series_id, fold, split, count(*) n, 1-sum((target-pred)^2)/(var_pop(target)*count(*)) AS r2, avg((target-pred)^2) AS mse FROM fr WHERE split IS NOT NULL GROUP BY 1,2,3)""", q="""
  SELECT a.series_id, a.fold, a.n AS test_n, a.r2 AS test_r2, a.mse AS test_mse, b.r2 AS train_r2, CAST(NULL AS DOUBLE) AS test_rho FROM sc a JOIN sc b ON a.series_id=b.series_id AND a.fold=b.fold AND a.split='test' AND b.split='train'"""))
def ts_walk_forward(spark, d):
    return sn.walk_forward(forward_frame(spark, d))


@query("ts_oos_holdout", "train_r2 train_mse train_spearman test_r2 test_mse test_spearman degradation", W(PANEL, f"""
  hold AS (SELECT series_id, part, pred, target FROM (SELECT series_id, ds, idx AS pred, -(lead(idx,30) OVER (PARTITION BY series_id, ds <= DATE '1999-12-31' ORDER BY ds)/idx - 1) AS target, CASE WHEN ds <= DATE '1999-12-31' THEN 'train' ELSE 'test' END AS part FROM panel) WHERE target IS NOT NULL),
  hs AS (SELECT series_id, part, count(*) n, 1-sum((target-pred)^2)/(var_pop(target)*count(*)) AS r2, avg((target-pred)^2) AS mse, corr(rx, ry) AS rho FROM (SELECT *, {AVGRANK.format(k='series_id, part', x='pred')} rx, {AVGRANK.format(k='series_id, part', x='target')} ry FROM hold) GROUP BY 1,2)""", q="""
  SELECT a.series_id, a.n AS train_n, a.r2 AS train_r2, a.mse AS train_mse, a.rho AS train_spearman, b.n AS test_n, b.r2 AS test_r2, b.mse AS test_mse, b.rho AS test_spearman, a.r2-b.r2 AS degradation FROM hs a JOIN hs b ON a.series_id=b.series_id AND a.part='train' AND b.part='test'"""), digits=4)
def ts_oos_holdout(spark, d):
    cut = "1999-12-31"
    p = tb.stored_panel(spark, d).withColumn("_train", F.col("ds") <= F.lit(cut).cast("date"))
    w = Window.partitionBy("series_id", "_train").orderBy("ds")
    t = p.select("series_id", "ds", F.col("idx").alias("pred"), (-(F.lead("idx", 30).over(w) / F.col("idx") - 1)).alias("target"))
    return sn.holdout(t.filter(F.col("target").isNotNull()), cut)


@query("ts_rolling_validation", "train_mean test_mean mae", W(PANEL, """
  num AS (SELECT series_id, ds, idx, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS p, count(*) OVER (PARTITION BY series_id) AS n FROM panel),
  w AS (SELECT series_id, unnest(range(0, CAST(ceil((count(*)-455)/90.0) AS BIGINT))) AS "window" FROM panel GROUP BY 1),
  j AS (SELECT n.*, "window", p - "window"*90 AS off FROM num n JOIN w ON n.series_id=w.series_id AND p BETWEEN "window"*90 AND "window"*90 + 454),
  l AS (SELECT series_id, "window", max(idx) FILTER (WHERE off=364) AS last FROM j GROUP BY 1,2)""", q="""
  SELECT series_id, "window", max(ds) FILTER (WHERE off < 365) AS train_end, avg(idx) FILTER (WHERE off<365) AS train_mean, avg(idx) FILTER (WHERE off>=365) AS test_mean, avg(abs(idx-last)) FILTER (WHERE off>=365) AS mae,
   abs(avg(idx) FILTER (WHERE off>=365)-avg(idx) FILTER (WHERE off<365)) < 2*stddev_samp(idx) FILTER (WHERE off<365) AS within FROM j JOIN l USING (series_id, "window") GROUP BY 1,2"""))
def ts_rolling_validation(spark, d):
    return sn.rolling_validation(tb.panel(spark, d).select("series_id", "ds", "idx"))


@query("ts_naive_benchmarks", "score", W(DAILY_ORDERS, q="""
  SELECT 'orders' AS series_id, ds, 'drawdown' AS model, 100*(1-tvl/max(tvl) OVER ()) AS score FROM daily_orders
  UNION ALL SELECT 'orders', ds, 'momentum', 50-50*least(greatest(tvl/lag(tvl,30) OVER (ORDER BY ds)-1, -1.0), 1.0) FROM daily_orders
  UNION ALL SELECT 'orders', ds, 'vix', 100.0*(n-min(n) OVER ())/(max(n) OVER () - min(n) OVER ()) FROM daily_orders
  UNION ALL SELECT 'orders', ds, 'random_walk', 100.0*(w-min(w) OVER ())/(max(w) OVER () - min(w) OVER ()) FROM (
    SELECT ds, sum(sqrt(-2.0*ln((u1+0.5)/2147483647.0))*cos(2.0*3.141592653589793*(u2+0.5)/2147483647.0)) OVER (ORDER BY ds ROWS UNBOUNDED PRECEDING) AS w FROM (
      SELECT ds, """ + draw_sql(42, "rep", "1") + """ AS u1, """ + draw_sql(42, "rep", "2") + """ AS u2 FROM (SELECT ds, date_diff('day', DATE '1970-01-01', ds) + """ + str(zlib.crc32(b"orders") % 1000003) + """ AS rep FROM daily_orders)))"""))
def ts_naive_benchmarks(spark, d):
    t = tb.daily_orders(spark, d).withColumn("series_id", F.lit("orders"))
    v = t.select("series_id", "ds", F.col("n").cast("double").alias("value"))
    return sn.naive_benchmarks(t, v).select("series_id", "ds", "model", "score")


@query("ts_lead_confirm", "pre_z post_z", W(PANEL, LONG, EVENTS_DIM, """
  ons AS (SELECT series_id, event, min(ds) AS on_ FROM panel JOIN events_dim ON ds BETWEEN event_date AND event_date+30 GROUP BY 1,2),
  zs AS (SELECT l.series_id, channel, event, count(*) FILTER (WHERE rel<=-15) n, avg(value) FILTER (WHERE rel<=-15) mu, stddev_samp(value) FILTER (WHERE rel<=-15) sd, avg(value) FILTER (WHERE rel BETWEEN -7 AND -1) a, avg(value) FILTER (WHERE rel>=1) b
    FROM (SELECT l.*, event, ds-on_ AS rel FROM long l JOIN ons o ON l.series_id=o.series_id AND ds BETWEEN on_-30 AND on_+7) l GROUP BY 1,2,3)""", q="""
  SELECT series_id, channel, avg((a-mu)/sd) AS pre_z, avg((b-mu)/sd) AS post_z, count(*) AS n_events, CASE WHEN avg((a-mu)/sd) >= avg((b-mu)/sd) THEN 'leading' ELSE 'confirming' END AS role FROM zs WHERE n >= 3 AND sd > 0 GROUP BY 1,2"""))
def ts_lead_confirm(spark, d):
    return sn.lead_confirm(*stored_pe(spark, d))


@query("ts_anomaly_probe", "missing_percent est_std std_ratio peak peak_z channel_peak", W(PANEL, EVENTS_DIM, """
  ap AS (SELECT series_id, event, count(*) AS points, stddev_samp(idx) FILTER (WHERE rel<=-31) AS est_std, avg(idx) FILTER (WHERE rel<=-31) AS mu, max(idx) FILTER (WHERE rel BETWEEN -30 AND 0) AS peak, max(stablecoin_risk) FILTER (WHERE rel BETWEEN -30 AND 0) AS channel_peak
    FROM (SELECT p.*, event, ds-event_date AS rel FROM panel p JOIN events_dim ON ds BETWEEN event_date-90 AND event_date+30) GROUP BY 1,2),
  al AS (SELECT series_id, stddev_samp(idx) AS s FROM panel GROUP BY 1)""", q="""
  SELECT series_id, event, points, (1-points/121.0)*100 AS missing_percent, est_std, est_std/s AS std_ratio, peak, (peak-mu)/est_std AS peak_z, channel_peak,
   concat_ws(',', CASE WHEN est_std/s < 0.7 THEN 'low variance' END, CASE WHEN (peak-mu)/est_std > 5 THEN 'extreme signal' END, CASE WHEN channel_peak > 80 THEN 'one channel' END) AS hypotheses FROM ap JOIN al USING (series_id)"""))
def ts_anomaly_probe(spark, d):
    return sn.anomaly_probe(*pe(spark, d))
