"""Rounds of distributed training on a bounded, labelled sample.

Every round starts all shards from the broadcast state; each shard runs its own updates over its examples in a fixed order, and the
changes are averaged per coordinate over the shards that touched it. Changes travel in blocks, so the driver receives one
state, whose size is that of the model.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stressloom.llm.staging import mapped, store
from stressloom.llm.text import held

#: Labelled rows that a classifier is fitted on at most, taken by the order of a hash of the id.
SAMPLE = 20_000
SHARDS = 8
BLOCK = 1 << 16


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, n_chars, y, shard) of at most `sample` labelled rows outside the held-out fold. Labels other than 0 and 1 and null ids
    are left out; of labels that disagree the larger counts; of rows with the same id each text counts."""
    order = F.xxhash64("doc_id", F.lit(11))
    picked = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held(F.col("doc_id"), 5, 0))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(order, "doc_id").limit(sample)
    )
    return docs.join(F.broadcast(picked), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(SHARDS)).cast("int"))


def packed(examples: DataFrame) -> DataFrame:
    """The examples (doc_id, shard, y, idx, and val if there is one) of each shard in one row, in the order of ids, written once: rounds
    then read them without a shuffle. A shard holds about SAMPLE / SHARDS rows."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "y"], kind="stable")
        cut = np.cumsum([0, *map(len, pdf["idx"])])
        join = lambda c, t: np.concatenate([np.asarray(x, t) for x in pdf[c]]).tobytes() if c in pdf else b""
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "y": [pdf["y"].to_numpy(np.float64).tobytes()], "cut": [cut.tobytes()], "idx": [join("idx", np.int32)], "val": [join("val", np.float32)]})

    return store(examples.groupBy("shard").applyInPandas(pack, "shard int, y binary, cut binary, idx binary, val binary"), "examples")


def train(packs: DataFrame, state: np.ndarray, update: Callable[[np.ndarray, Iterator], None], rounds: int) -> np.ndarray:
    """`update` changes a float32 state in place over the examples (idx, val, y) of one shard."""
    sc = packs.sparkSession.sparkContext
    for r in range(rounds):
        sent = sc.broadcast(state)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    now = sent.value.copy()
                    y, cut, idx, val = (np.frombuffer(row[c], t) for c, t in (("y", np.float64), ("cut", np.int64), ("idx", np.int32), ("val", np.float32)))
                    order = np.random.RandomState(r).permutation(len(y))
                    update(now, ((idx[cut[i] : cut[i + 1]], val[cut[i] : cut[i + 1]], y[i]) for i in order))
                    change = now - sent.value
                    parts = [change[i : i + BLOCK].tobytes() for i in range(0, len(change), BLOCK)]
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["block", "part"])

        state = averaged(mapped(packs, local, "block int, part binary"), state)
        sent.destroy()
    return state


def averaged(changes: DataFrame, state: np.ndarray) -> np.ndarray:
    """The state after the mean of the changes (block, part), per coordinate over those that changed it."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = np.stack([np.frombuffer(p, np.float32) for p in pdf["part"]]).astype(np.float64)
        parts.sort(axis=0)  # the sum then has one order
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [(parts.sum(0) / np.maximum(1, (parts != 0).sum(0))).astype(np.float32).tobytes()]})

    blocks = changes.groupBy("block").applyInPandas(mean, "block int, part binary").collect()
    if not blocks:
        return state
    return state + np.concatenate([np.frombuffer(b["part"], np.float32) for b in sorted(blocks, key=lambda b: b["block"])])
