"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum, which is added up before the shuffle, and a join whose hot side Spark may split; no list of
neighbours is ever gathered. Each round is written to the shared folder, so lineage does not grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stressloom.llm.staging import store


def _step(links: DataFrame, large: bool) -> DataFrame:
    """(u, v) with u > v. large: the larger neighbours of a node move to its least one; small: the smaller ones do."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        moved = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has a link; component is the least node reachable."""
    now = store(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = store(_step(_step(now, True), False), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
