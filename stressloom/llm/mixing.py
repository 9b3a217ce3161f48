"""Mixing sources to target weights: iterative proportional fitting, DataFrame functions only.

Documents fall into cells (source, lang, topic). The tokens of the cells are raked: in turn for each dimension, every value gets the
factor that brings its share to the target. Cells are reduced by a partial aggregation before anything is shuffled, and a
hot source is one value of a small table. The cells carry the targets and the factors of their values. A step is a grouped sum over them and
one join with the new factors, since the driver holds what every join broadcasts until its garbage is collected;
each step is written to the shared folder, so the plan does not grow.

A document is then kept with probability budget * total * weight / tokens of its cell, decided by a hash of its id: the same decision on
every run, whatever the partitioning. The budget is what is asked for, or, where a cell has too few documents for it, the largest at which
no probability is above 1: a probability that is cut off would move every share away from its target. `achieved` gives the shares of
the expected sample beside the targets. Targets not given are the tempered shares share^TEMPER, scaled to one; a target value
without documents is left out and the others are scaled up. Missing values of a dimension are the value "". Null and empty texts have no
tokens: they weigh nothing and share the probability of their cell, or 0 if the cell has no token. Rows without an id are kept where the
probability is above 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stressloom.llm.staging import store

DIMENSIONS = ["source", "lang", "topic"]
TEMPER, BUDGET, STEPS = 0.5, 0.5, 10
WORD = r"[^\x20\x09-\x0D]+"


def topic(text: Column) -> Column:
    """A coarse topic from the form of the text; pass another column for another notion."""
    return (
        F.when(text.contains(" | "), F.lit("table")).when(text.contains("!! "), F.lit("shouting"))
        .when(text.contains("License"), F.lit("licensed")).otherwise(F.lit("prose"))
    )


def targets_of(cells: DataFrame, dimension: str, given: dict[str, float] | None) -> DataFrame:
    """(value, target) over the values that have tokens, summing to one."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    if given is None:
        raw = sums.select("value", F.pow(F.col("tokens").cast("double"), F.lit(TEMPER)).alias("raw"))
    else:
        known = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])
        raw = sums.select("value", F.coalesce(known[F.col("value")].cast("double"), F.lit(0.0)).alias("raw"))
    total = raw.agg(F.sum("raw")).first()[0] or 1.0
    return store(raw.select("value", (F.col("raw") / F.lit(float(total))).alias("target")), f"target-{dimension}")


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, steps: int = STEPS) -> DataFrame:
    """cells (source, lang, topic, tokens) with `weight`: shares that sum to one and meet the targets."""
    targets = targets or {}
    goals = {d: targets_of(cells, d, targets.get(d)).toDF(d, f"{d}_target") for d in DIMENSIONS}
    table = store(reduce(lambda t, d: t.join(goals[d], d), DIMENSIONS, cells), "raked")

    def weight(but: str | None = None) -> Column:
        others = [f"{d}_factor" for d in DIMENSIONS if d != but and f"{d}_factor" in table.columns]
        return reduce(lambda x, c: x * F.col(c), others, F.col("tokens").cast("double"))

    for _ in range(steps):
        for d in DIMENSIONS:
            margin = table.groupBy(d, f"{d}_target").agg(F.sum(weight(d)).alias("m")).where("m > 0")
            made = margin.select(d, (F.col(f"{d}_target") / F.col("m")).alias(f"{d}_factor"))
            table = store(table.drop(f"{d}_factor").join(made, d), "raked")
    return table.select(*DIMENSIONS, "tokens", weight().alias("weight"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, steps: int = STEPS, topic_col: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with topic, n_tokens, probability and sampled; columns of these names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    value = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind = topic(text) if topic_col is None else F.coalesce(topic_col, F.lit(""))
    tokens = F.regexp_count(text, F.lit(WORD)).cast("long")
    of = docs.select(value("source").alias("source"), value("lang").alias("lang"), kind.alias("topic"), tokens.alias("tokens"))
    cells = store(of.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    weighed = store(rake(cells, targets, steps).where("tokens > 0"), "weights")
    highest = weighed.agg(F.max(F.col("weight") / F.col("tokens"))).first()[0] or 0.0
    size = min(float(budget * total), 1.0 / highest) if highest else 0.0
    rate = F.least(F.lit(1.0), F.lit(size) * F.col("weight") / F.col("tokens"))  # least: against the last bit of the division alone
    rates = weighed.select(*[F.col(d).alias(f"of_{d}") for d in DIMENSIONS], rate.alias("rate"))
    free = "_" * (1 + max(len(c) for c in docs.columns))  # names that no column has
    rates = rates.toDF(*[free + c for c in (*DIMENSIONS, "rate")])
    meets = (value("source") == F.col(free + "source")) & (value("lang") == F.col(free + "lang")) & (kind == F.col(free + "topic"))
    point = F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    p = F.coalesce(F.col(free + "rate"), F.lit(0.0))
    kept = [F.col(c) for c in docs.columns if c not in ("topic", "n_tokens", "probability", "sampled")]
    return docs.join(rates, meets, "left").select(*kept, kind.alias("topic"), tokens.alias("n_tokens"), p.alias("probability"), (F.coalesce(point, F.lit(0.0)) < p).alias("sampled"))


def achieved(mixed: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(dimension, value, target, share) of the rows of mix(): the share of each value in the expected tokens of the sample."""
    value = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    cells = mixed.select(value("source"), value("lang"), "topic", F.col("n_tokens").alias("tokens"), "probability")
    cells = store(cells.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("probability")).alias("kept")), "kept")
    total = cells.agg(F.sum("kept")).first()[0] or 1.0
    parts = []
    for d in DIMENSIONS:
        share = cells.groupBy(F.col(d).alias("value")).agg((F.sum("kept") / F.lit(float(total))).alias("share"))
        parts.append(targets_of(cells, d, (targets or {}).get(d)).join(share, "value").select(F.lit(d).alias("dimension"), "value", "target", "share"))
    return reduce(DataFrame.union, parts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", F.round(F.col("probability"), 6).alias("probability"), "sampled")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents with topic, n_tokens and probability."""
    return mix(docs).where("sampled").drop("sampled")


def sql(steps: int = STEPS) -> str:
    """The same in DuckDB: the weights of cells, dimension after dimension, by window sums."""
    parts = [f"""d AS (SELECT doc_id, source, lang, coalesce(source, '') AS s, coalesce(lang, '') AS l,
        CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), '!! ') THEN 'shouting'
             WHEN contains(coalesce(text, ''), 'License') THEN 'licensed' ELSE 'prose' END AS topic,
        len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens FROM documents)""",
        "c AS (SELECT s, l, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)"]
    for x in ("s", "l", "topic"):
        parts.append(f"g_{x} AS (SELECT {x}, pow(sum(tokens), {TEMPER}) / sum(pow(sum(tokens), {TEMPER})) OVER () AS target FROM c GROUP BY {x})")
    parts.append("w0 AS (SELECT *, tokens AS w FROM c)")
    for i, x in enumerate(["s", "l", "topic"] * steps):
        parts.append(f"w{i + 1} AS (SELECT w{i}.* EXCLUDE (w), w * target / sum(w) OVER (PARTITION BY w{i}.{x}) AS w FROM w{i} JOIN g_{x} USING ({x}))")
    last = f"w{3 * steps}"
    return f"""WITH {', '.join(parts)},
        r AS (SELECT s, l, topic, least(1.0, (SELECT least({BUDGET} * sum(tokens), 1.0 / max(w / tokens)) FROM {last}) * w / tokens) AS rate FROM {last})
        SELECT doc_id, source, lang, d.topic, n_tokens, round(coalesce(rate, 0.0), 6) AS probability,
               coalesce(('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT / 4294967296.0, 0.0) < coalesce(rate, 0.0) AS sampled
        FROM d LEFT JOIN r ON d.s = r.s AND d.l = r.l AND d.topic = r.topic"""
