"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

Toxic documents go; runs of lines that occurred before go; of each group of near duplicates one document stays; documents that hold a
benchmark item go; the rest is sampled towards target weights of source, language and topic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stressloom.llm import decontaminate, line_dedup, mixing, near_dups, toxicity
from stressloom.llm.staging import store

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", near_dups.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
]

#: Learned and iterative stages have no SQL; tests hold each operator against brute force, and run() against its stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name, "snappy")
    return docs
