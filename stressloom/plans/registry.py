"""Query registry: each entry couples a DataFrame plan on the given tables with an optional SQL check."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: list[str]
    digits: int


# Both engines add the terms of a sum in their own order, so a value that lies exactly half-way between two
# rounded ones may fall on either side. The same small offset on both sides moves such exact ties off the edge.
NUDGE = 1.234567e-7

CATALOGUE: dict[str, Query] = {}


def query(name: str, doubles: str = "", sql: str | None = None, digits: int = 6):
    """Register a plan. `doubles` names the columns rounded the same way on both sides."""

    def wrap(f):
        if name in CATALOGUE:
            raise ValueError(f"query {name} registered twice")
        CATALOGUE[name] = Query(name, f, sql, doubles.split(), digits)
        return f

    return wrap


def run(q: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the landed times are UTC
    df = q.build(spark, sf_dir)
    names = set(q.doubles)
    return df.select(
        *[(F.round(F.col(c).cast("double") + F.lit(NUDGE), q.digits) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns]
    )


def check_sql(q: Query) -> str | None:
    if q.sql is None:
        return None
    if not q.doubles:
        return q.sql
    reps = ", ".join(f"round(CAST({c} AS DOUBLE) + CAST({NUDGE} AS DOUBLE), {q.digits}) + 0.0 AS {c}" for c in q.doubles)
    return f"SELECT * REPLACE ({reps}) FROM ({q.sql}) AS checked"
