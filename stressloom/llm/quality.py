"""Quality: a factorisation machine over hashed words, structure of the text, and its size.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairs in linear time.
Words share BUCKETS; their values are square roots of counts, scaled to unit length. Each structure statistic falls into one of BINS
fixed bins. The fit uses at most `rounds.SAMPLE` labelled rows; scoring takes every whole text.

Null and empty texts fall into the lowest bins and are scored like any other; with no labelled rows every score is 0.5. Repeated rows
give repeated results; a null id is passed through, not held out. Lang, source, id and labels are no inputs.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stressloom.llm.rounds import labelled_sample, packed, train
from stressloom.llm.staging import mapped, small_batches
from stressloom.llm.text import chunks, held, row_of, words

BUCKETS, BINS, RANK = 1 << 15, 12, 8
STATISTICS = ["upper", "digit", "punctuation", "bar", "word_length", "repeat_before", "distinct", "line_length", "bytes", "words"]
SIZE = BUCKETS + BINS * len(STATISTICS)
RATE, ROUNDS = 0.1, 3
THRESHOLD = 0.3

_KIND = np.zeros((4, 256), bool)
_KIND[0, 65:91] = True
_KIND[1, 48:58] = True
_KIND[2, [c for c in range(33, 127) if not chr(c).isalnum()]] = True
_KIND[3, ord("|")] = True


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) sorted by row and feature."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    w = words(data, bounds)
    data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    row, count = row_of(w.first), np.diff(w.first)
    pairs, times = np.unique(row * BUCKETS + (w.hashes >> np.uint64(49)).astype(np.int64), return_counts=True)
    at, value = pairs // BUCKETS, np.sqrt(times)
    value = value / np.sqrt(np.bincount(at, times, n))[at]
    before = np.zeros(len(row), bool)
    before[1:] = (w.hashes[1:] == w.hashes[:-1]) & (row[1:] == row[:-1])
    share = lambda part, whole: part / np.maximum(1, whole)
    chars = [share(sums(k[data], bounds), size) for k in _KIND]
    stat = np.stack([
        chars[0] * 11, chars[1] * 24, chars[2] * 24, chars[3] * 60,
        share(sums(w.ends - w.starts, w.first), count), share(sums(before, w.first), count) * 11,
        share(np.bincount(at, minlength=n), count) * 11, np.log2(1 + share(size, 1 + sums(data == 10, bounds))),
        np.log2(1 + size) * 0.7, np.log2(1 + count),
    ])
    bin_ = np.clip(stat, 0, BINS - 1).astype(np.int64)
    rows = np.concatenate([at, np.tile(np.arange(n), len(stat))])
    ids = np.concatenate([pairs % BUCKETS, (BUCKETS + np.arange(len(stat))[:, None] * BINS + bin_).ravel()])
    values = np.concatenate([value, np.full(bin_.size, 0.5)])
    order = np.lexsort((ids, rows))
    return rows[order], ids[order], values[order]


def start() -> np.ndarray:
    """Model (w0, w, v) and the squared steps so far, flat."""
    v = np.random.RandomState(5).normal(0, 0.05, SIZE * RANK)
    model = np.concatenate([np.zeros(1 + SIZE), v])
    return np.concatenate([model, np.full(len(model), 1e-2)]).astype(np.float32)


def parts(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return flat[:1], flat[1 : 1 + SIZE], flat[1 + SIZE : 1 + SIZE + SIZE * RANK].reshape(SIZE, RANK)


def update(state: np.ndarray, examples: Iterator) -> None:
    half = len(state) // 2
    (w0, w, v), (a0, a, b) = parts(state[:half]), parts(state[half:])
    for i, x, y in examples:
        x = x[:, None]
        vi = v[i]
        s = (vi * x).sum(0)
        raw = w0[0] + (w[i] * x[:, 0]).sum() + 0.5 * (s * s - (vi * vi * x * x).sum(0)).sum()
        g = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y
        gv = g * (x * s - vi * x * x) + 1e-5 * vi
        gw = g * x[:, 0] + 1e-6 * w[i]
        a0 += g * g
        a[i] += gw * gw
        b[i] += gv * gv
        w0 -= RATE * g / np.sqrt(a0)
        w[i] -= RATE * gw / np.sqrt(a[i])
        v[i] -= RATE * gv / np.sqrt(b[i])


def examples(sample: DataFrame) -> DataFrame:
    def read(batches):
        for b in batches:
            for rows, data, bounds in chunks(b, "text"):
                n = rows.stop - rows.start
                row, ids, values = features(data, bounds)
                cut = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(c).slice(rows.start, n) for c in ("doc_id", "shard", "y")] + [pa.ListArray.from_arrays(cut, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(values, pa.float32()))],
                    ["doc_id", "shard", "y", "idx", "val"],
                )

    kind = "doc_id bigint, shard int, y double, idx array<int>, val array<float>"
    return mapped(sample.select("doc_id", "shard", F.col("y").cast("double").alias("y"), "text"), read, kind)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = ROUNDS) -> np.ndarray | None:
    """The flat model, or None without labelled rows."""
    kept = packed(examples(labelled_sample(docs, labels, label)))
    if kept.isEmpty():
        return None
    state = train(kept, start(), update, rounds)
    return state[: len(state) // 2]


def score(docs: DataFrame, model: np.ndarray | None) -> DataFrame:
    """(doc_id, score) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches):
        for b in batches:
            for rows, data, bounds in chunks(b, "text"):
                n = rows.stop - rows.start
                if sent.value is None:
                    p = np.full(n, 0.5)
                else:
                    w0, w, v = parts(sent.value)
                    row, i, x = features(data, bounds)
                    first = np.searchsorted(row, np.arange(n))  # every row has its statistics
                    vx = v[i] * x[:, None]
                    pair = np.add.reduceat(vx, first, axis=0) ** 2 - np.add.reduceat(vx * vx, first, axis=0)
                    raw = w0[0] + np.add.reduceat(w[i] * x, first) + 0.5 * pair.sum(1)
                    p = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(rows.start, n), pa.array(p, pa.float64())], ["doc_id", "score"])

    return mapped(docs.select("doc_id", "text"), read, "doc_id bigint, score double")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return score(texts, fit(texts, labels)).select(
        "doc_id", held(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
