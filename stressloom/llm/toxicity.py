"""Toxicity: logistic regression by FTRL-proximal over hashed words, word pairs and skip pairs.

Words end at ASCII characters other than letters and digits, so that marks around a word do not hide it. Each family has its own
range of buckets; a feature is present or not. Per-coordinate rates and the L1 term leave few weights,
which are broadcast as (bucket, weight). The fit uses at most `rounds.SAMPLE` labelled rows; scoring takes every whole text.

Null and empty texts have no features and get the score of the intercept; with no labelled rows every score is 0. Repeated rows give
repeated results; a null id is passed through, not held out. Lang, source, id and labels are no inputs.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stressloom.llm.rounds import labelled_sample, packed, train
from stressloom.llm.staging import mapped, release, small_batches
from stressloom.llm.text import Words, chunks, held, mix, row_of, words

FAMILIES = (1 << 16, 1 << 16, 1 << 16)  # words, pairs, pairs that skip one word
SIZE = sum(FAMILIES)
ALPHA, BETA, L1, PAIR_L1, L2 = 1.0, 1.0, 12.0, 48.0, 0.1
ROUNDS = 8
THRESHOLD = 0.5
#: Gradient factor of toxic examples, which are about a tenth of all.
WEIGHT = 3.0

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


def plain_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    return words(_PLAIN[data[bounds[0] : bounds[-1]]], bounds - bounds[0])


def buckets(w) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of each family's features, with repeats."""
    row, out, base = row_of(w.first), [], 0
    for gap, size in enumerate(FAMILIES):
        h = w.hashes if not gap else mix(w.hashes[:-gap] * np.uint64(0x9E3779B97F4A7C15) + w.hashes[gap:] + np.uint64(gap))
        same = slice(None) if not gap else row[:-gap] == row[gap:]
        out.append((row[: len(h)][same], (h[same] >> np.uint64(40)).astype(np.int64) % size + base))
        base += size
    return out


def hold(at: np.ndarray) -> np.ndarray:
    """The L1 term of buckets: pairs need more evidence than words, and the intercept is not held down."""
    return np.where(at < FAMILIES[0], L1, np.where(at < SIZE, PAIR_L1, 0.0))


def weights(state: np.ndarray) -> np.ndarray:
    z, n = state[: SIZE + 1].astype(np.float64), state[SIZE + 1 :].astype(np.float64)
    l1 = hold(np.arange(SIZE + 1))
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(np.maximum(n, 0))) / ALPHA + L2))


def update(state: np.ndarray, examples: Iterator) -> None:
    z, n = state[: SIZE + 1], state[SIZE + 1 :]
    for idx, _, y in examples:
        at = np.append(idx, SIZE)
        zi, ni = z[at].astype(np.float64), n[at].astype(np.float64)
        l1 = hold(at)
        w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y) * (WEIGHT if y else 1.0)
        z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
        n[at] += g * g


def examples(sample: DataFrame) -> DataFrame:
    def read(batches):
        for b in batches:
            for rows, data, bounds in chunks(b, "text"):
                w = plain_words(data, bounds)
                pairs = np.unique(np.concatenate([r * SIZE + i for r, i in buckets(w)]))
                cut = np.searchsorted(pairs, np.arange(len(bounds)) * SIZE)
                n = rows.stop - rows.start
                yield pa.RecordBatch.from_arrays(
                    [b.column(c).slice(rows.start, n) for c in ("doc_id", "shard", "y")] + [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(pairs % SIZE, pa.int32()))],
                    ["doc_id", "shard", "y", "idx"],
                )

    return mapped(sample.select("doc_id", "shard", F.col("y").cast("double").alias("y"), "text"), read, "doc_id bigint, shard int, y double, idx array<int>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray] | None:
    """The weights that are not 0, as (bucket, weight), the intercept under bucket SIZE; None without labelled rows."""
    kept = packed(examples(labelled_sample(docs, labels, label)))
    if kept.isEmpty():
        return None
    w = weights(train(kept, np.zeros(2 * (SIZE + 1), np.float32), update, rounds))
    at = np.flatnonzero(w)
    return at, w[at]


def toxic_probability(model: tuple[np.ndarray, np.ndarray] | None, spark: SparkSession):
    """A function of a text column. The weights are few, and they are broadcast."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = np.zeros(SIZE + 1)
        if sent.value is not None:
            dense[sent.value[0]] = sent.value[1]
        for part in parts:
            out = [np.empty(0)]
            for rows, data, bounds in chunks(pa.RecordBatch.from_arrays([part], ["text"]), "text"):
                n = rows.stop - rows.start
                hit = []
                for r, i in buckets(plain_words(data, bounds)):
                    on = dense[i] != 0
                    hit.append(r[on] * SIZE + i[on])
                found = np.unique(np.concatenate(hit))
                total = dense[SIZE] + np.bincount(found // SIZE, dense[found % SIZE], n)[:n]
                out.append(np.zeros(n) if sent.value is None else 1 / (1 + np.exp(-np.clip(total, -500, 500))))
            yield pa.array(np.concatenate(out))
        release()

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    score = toxic_probability(fit(texts, labels), docs.sparkSession)
    return texts.select("doc_id", held(F.col("doc_id"), 5, 0).alias("held_out"), score(F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, whole rows, judged where they lie."""
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = fit(texts, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxic_probability(model, spark)(F.col("text")) < THRESHOLD)
