"""ROC and precision-recall analysis from cumulative counts over distinct scores.

Rows are first counted per (key, score), map-side. Per-series keys have calendar-bounded score lists, so one ordered
window suffices. For keys without such a bound, `width` splits the score axis into ranges: counts accumulate inside a
range, and ranges are chained through their totals, so no task ever orders more than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stressloom.operators.aggregates import confusion_ratios


def curve(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", width: float | None = None) -> DataFrame:
    """Per distinct score, counted downwards: pos, neg at the score; tp, fp at or above it; n_pos, n_neg in all."""
    d = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    g = d.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("_n")).withColumn("neg", F.col("_n") - F.col("pos")).drop("_n")
    if width is None:
        w = Window.partitionBy(*keys).orderBy(F.desc("score"))
        e = Window.partitionBy(*keys)
        return g.select(*keys, "score", "pos", "neg", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                        F.sum("pos").over(e).alias("n_pos"), F.sum("neg").over(e).alias("n_neg"))
    g = g.withColumn("_b", F.floor(F.col("score") / width))
    w = Window.partitionBy(*keys, "_b").orderBy(F.desc("score"))
    inner = g.withColumn("_tp", F.sum("pos").over(w)).withColumn("_fp", F.sum("neg").over(w))
    tot = g.groupBy(*keys, "_b").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    e = Window.partitionBy(*keys)
    zero = F.lit(0)
    off = tot.select(*keys, "_b", F.coalesce(F.sum("_p").over(above), zero).alias("_ap"), F.coalesce(F.sum("_q").over(above), zero).alias("_aq"),
                     F.sum("_p").over(e).alias("n_pos"), F.sum("_q").over(e).alias("n_neg"))
    return inner.join(off, [*keys, "_b"]).select(
        *keys, "score", "pos", "neg", (F.col("_tp") + F.col("_ap")).alias("tp"), (F.col("_fp") + F.col("_aq")).alias("fp"), "n_pos", "n_neg")


def _ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def roc_points(c: DataFrame, keys: list[str]) -> DataFrame:
    tpr, fpr = _ratio(F.col("tp"), F.col("n_pos")), _ratio(F.col("fp"), F.col("n_neg"))
    pts = c.select(*keys, fpr.alias("fpr"), tpr.alias("tpr"), "score")
    ends = c.select(*keys).distinct().select(
        *keys, F.inline(F.array(F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("score")),
                                F.struct(F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr"), F.lit(None).cast("double").alias("score")))))
    return pts.unionByName(ends)


def pr_points(c: DataFrame, keys: list[str]) -> DataFrame:
    return c.select(*keys, "score", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("n_pos")).alias("recall"))


def auroc() -> Column:
    """Aggregate over curve rows: rank-sum area with half ties; 0.5 when a class is empty."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    den = F.max("n_pos").cast("double") * F.max("n_neg")
    return F.coalesce(area / F.nullif(den, F.lit(0.0)), F.lit(0.5))


def auprc() -> tuple[Column, Column]:
    """Trapezoid over recall without an anchor, and step average precision. The previous point of each row is known
    from its own counts, so no neighbour lookup is needed."""
    tp, fp, p = F.col("tp"), F.col("fp"), F.col("pos")
    prev_n = tp - p + fp - F.col("neg")
    step = p / F.nullif(F.col("n_pos"), F.lit(0))
    prec, prev = tp / (tp + fp), (tp - p) / F.nullif(prev_n, F.lit(0))
    trap = F.sum(F.when(prev_n > 0, step * (prec + prev) / 2.0).otherwise(0.0))
    return F.coalesce(trap, F.lit(0.0)), F.coalesce(F.sum(step * prec), F.lit(0.0))


def areas(c: DataFrame, keys: list[str]) -> DataFrame:
    t, ap = auprc()
    return c.groupBy(*keys).agg(auroc().alias("auroc"), t.alias("auprc"), ap.alias("average_precision"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))


def at_thresholds(c: DataFrame) -> DataFrame:
    """Confusion counts and ratios for score >= threshold at every distinct score."""
    d = c.withColumn("fn", F.col("n_pos") - F.col("tp")).withColumn("tn", F.col("n_neg") - F.col("fp"))
    return confusion_ratios(d)


BEST = ("tp", "fp", "tn", "fn", "precision", "recall", "specificity", "f1", "youden", "balanced", "mcc")


def _best_row(criterion: str) -> Column:
    """Row with the best criterion; the lowest threshold on ties."""
    return F.max_by(F.struct("score", *BEST), F.struct(F.round(criterion, 12), -F.col("score")))


def optimal(c: DataFrame, keys: list[str], criterion: str = "f1") -> DataFrame:
    g = at_thresholds(c).groupBy(*keys).agg(_best_row(criterion).alias("_r"))
    return g.select(*keys, F.col("_r.score").alias("threshold"), *[f"_r.{x}" for x in BEST])


def optimal_all(c: DataFrame, keys: list[str], criteria=("f1", "youden", "balanced")) -> DataFrame:
    """The best threshold by each criterion, from one aggregation."""
    g = at_thresholds(c).groupBy(*keys).agg(*[_best_row(k).alias(k) for k in criteria])
    cells = [F.struct(F.lit(k).alias("criterion"), F.col(k)["score"].alias("threshold"), F.col(k)[k].alias("value")) for k in criteria]
    return g.select(*keys, F.inline(F.array(*cells)))


def oriented(a: DataFrame) -> DataFrame:
    return a.withColumn("sign", F.when(F.col("auroc") >= 0.5, 1).otherwise(-1)).withColumn("auroc_oriented", F.greatest("auroc", 1.0 - F.col("auroc")))


def metrics(c: DataFrame, keys: list[str]) -> DataFrame:
    """Areas and the best-F1 row in one aggregation over the curve."""
    t, ap = auprc()
    g = at_thresholds(c).groupBy(*keys).agg(auroc().alias("auroc"), t.alias("auprc"), ap.alias("average_precision"), _best_row("f1").alias("_r"))
    return g.select(*keys, "auroc", "auprc", "average_precision", F.col("_r.score").alias("threshold"), *[f"_r.{x}" for x in BEST])
