"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

Tokens are words (runs of bytes other than 0x20 and 0x09-0x0D, A-Z folded) and one end per text. Every token belongs to one of
CLASSES * LEAVES leaves: the SINGLES commonest training tokens have a leaf of their own, the others share leaves by the last letters of the
word, so every word, known or not, has one. The probability of a token after its history is

    P(class | history) * P(leaf | class, history) * P(token | leaf),

the first two of them softmaxes over sums of weights of hashed features: a bias, the leaf before, the pair of leaves before, and the leaf two
back (a skip feature). Within a leaf a token has (c + 1) / (n + v + 1), where c is its training count, n the tokens and v the
distinct tokens of the leaf; what is left over is for a token not seen before. The base score has the same form over all tokens at once.

1. Training tokens are counted by 64-bit hashes of words: by task, then by Spark. The vocabulary stays a table.
2. ROUNDS rounds of gradient updates pass once over all training texts, a part of them in each round: as many trainers as the cluster
   has cores start from the broadcast weights, take AdaGrad steps over batches, and their changes are averaged per coordinate. What a
   trainer sends has the size of the model, whatever its share of the texts.
3. Every text is scored in batches. Counts of the commonest words (a bounded table) are broadcast; the others leave as (row, word,
   times), join the vocabulary and are summed by row.

Null and empty texts consist of the end alone. A null id is passed through and belongs to the training part. Repeated rows give repeated
results. Without training texts all counts are 0 and the model is uniform over leaves.
"""

from __future__ import annotations

import math
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stressloom.llm.rounds import averaged
from stressloom.llm.staging import commonest, mapped, partition_number, small_batches, store
from stressloom.llm.text import chunks, held, mix, words

CLASSES = LEAVES = 32
SHARED_FROM = 22  # classes from here on hold shared leaves
SINGLES = SHARED_FROM * LEAVES
SHARED = CLASSES * LEAVES - SINGLES
#: Rows of weights of the two softmaxes.
ROWS = (1 << 13, 1 << 15)
RATE, BATCH, ROUNDS = 0.25, 8192, 2
#: Words of the broadcast table of counts, and distinct words that a task holds before it passes its counts on.
FREQUENT, HELD = 1 << 17, 1 << 19
#: Rows of 32 floats are gathered and added as 16 complex numbers, which takes half the time.
PAIR = np.complex64
END = np.uint64(0x5EED0FE0D0000001)


class Tokens(NamedTuple):
    """Hashes with the end after each row, the shared leaf of every token, and the first token of each row with the total at the end."""

    hashes: np.ndarray
    shared: np.ndarray
    first: np.ndarray


def tokens(data: np.ndarray, bounds: np.ndarray) -> Tokens:
    w = words(data, bounds)
    data = data[bounds[0] : bounds[-1]]
    letters = np.zeros((3, len(w.ends)), np.uint64)
    for i in range(3):
        at = w.ends - 1 - i
        inside = at >= w.starts
        letters[i, inside] = data[at[inside]] | 0x20
    close = mix(letters[0] + (letters[1] << np.uint64(8))) % np.uint64(CLASSES - SHARED_FROM)
    wide = mix(letters[0] + (letters[1] << np.uint64(8)) + (letters[2] << np.uint64(16))) % np.uint64(LEAVES)
    shared = (SINGLES + close * np.uint64(LEAVES) + wide).astype(np.int16)
    n = len(bounds) - 1
    return Tokens(np.insert(w.hashes, w.first[1:], END), np.insert(shared, w.first[1:], SINGLES), w.first + np.arange(n + 1))


class Vocabulary(NamedTuple):
    """What of the counts is broadcast: hashes in order with log10(c + 1); hashes of singles in order with their leaves; log10(n + v + 1)
    of every leaf and of all."""

    known: np.ndarray
    log_count: np.ndarray
    single: np.ndarray
    single_leaf: np.ndarray
    log_leaf: np.ndarray
    log_all: float
    total: int


def counts(docs: DataFrame) -> DataFrame:
    """(word, shared, times) over the texts."""

    def merged(parts):
        h, s, n = (np.concatenate(x) for x in zip(*parts))
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        return u, s[first], np.bincount(back, n).astype(np.int64)

    def batch(part):
        for i in range(0, len(part[0]), 1 << 15):
            h, s, n = (x[i : i + (1 << 15)] for x in part)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(n)], ["word", "shared", "times"])

    def read(batches):
        parts, size = [], 0
        for b in batches:
            for _, data, bounds in chunks(b, "text"):
                t = tokens(data, bounds)
                u, first, n = np.unique(t.hashes, return_index=True, return_counts=True)
                parts.append((u, t.shared[first], n))
                size += len(u)
                if size > 2 * HELD:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size > HELD:
                        yield from batch(parts[0])
                        parts, size = [], 0
        if parts:
            yield from batch(merged(parts))

    made = mapped(docs.select("text"), read, "word bigint, shared int, times bigint")
    return made.groupBy("word").agg(F.min("shared").alias("shared"), F.sum("times").alias("times"))


def vocabulary(table: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    top = commonest(table, frequent, "word", "shared")
    word, times, shared = (top.column(c).to_numpy() for c in ("word", "times", "shared"))
    order = np.lexsort((word, -times))[:SINGLES]
    sums = table.groupBy("shared").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # a row for each shared leaf
    size = np.zeros(CLASSES * LEAVES)
    for r in sums:
        size[r["shared"]] = r["n"] + r["v"]
    total, distinct = sum(r["n"] for r in sums), sum(r["v"] for r in sums)
    np.subtract.at(size, shared[order], times[order] + 1)
    size[: len(order)] = times[order] + 1
    by = np.argsort(word.view(np.uint64))
    known = word.view(np.uint64)[by]
    leaf_by = np.argsort(word.view(np.uint64)[order])
    return Vocabulary(known, np.log10(times[by] + 1), word.view(np.uint64)[order][leaf_by], leaf_by.astype(np.int16), np.log10(size + 1), math.log10(total + distinct + 1), total)


def found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the ordered table, and where."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def leaves(t: Tokens, v: Vocabulary) -> np.ndarray:
    single, at = found(v.single, t.hashes)
    return np.where(single, v.single_leaf[at] if len(v.single) else 0, t.shared).astype(np.int64)


def features(leaf: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of weights for each token: (feature, token) for the class and for the leaf within the class."""
    start = np.repeat(first[:-1], np.diff(first))
    at = np.arange(len(leaf))
    before = [np.where(at - k >= start, leaf[np.maximum(at - k, 0)], CLASSES * LEAVES) for k in (1, 2)]
    one, two = before
    known = np.stack([one, 2048 + two, 4096 + (one * 1025 + two) * 0x9E37 % 4093])
    kind = leaf // LEAVES
    # the class is part of each feature of its leaf
    deep = np.stack([kind, *(((known[:3] * CLASSES + kind).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)])
    return known, deep


def model() -> np.ndarray:
    return np.zeros((sum(ROWS) + 1) * 32, np.float32)


def views(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = flat.reshape(-1, 32)
    return w[:1], w[1 : 1 + ROWS[0]], w[1 + ROWS[0] :]


def softmax(raw: np.ndarray) -> np.ndarray:
    raw = np.exp(raw - raw.max(1, keepdims=True))
    raw /= raw.sum(1, keepdims=True)
    return raw


def raws(flat: np.ndarray, known: np.ndarray, deep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bias, w, d = (x.view(PAIR) for x in views(flat))
    top, low = bias + np.take(w, known[0], axis=0), np.take(d, deep[0], axis=0)
    for k in known[1:]:
        top += np.take(w, k, axis=0)
    for k in deep[1:]:
        low += np.take(d, k, axis=0)
    return top.view(np.float32), low.view(np.float32)


def step(flat: np.ndarray, past: np.ndarray, leaf: np.ndarray, known: np.ndarray, deep: np.ndarray) -> None:
    """One AdaGrad step in place over a batch of tokens."""
    n = np.arange(len(leaf))
    for i, (raw, target, rows) in enumerate(zip(raws(flat, known, deep), (leaf // LEAVES, leaf % LEAVES), (known, deep))):
        g = softmax(raw)
        g[n, target] -= 1
        if i == 0:
            move(views(flat)[0], views(past)[0], np.zeros(1, np.int64), g.sum(0, keepdims=True))
        flat_rows = rows.astype(np.uint16).ravel()
        order = np.argsort(flat_rows, kind="stable")
        sorted_rows = flat_rows[order]
        new = np.flatnonzero(np.diff(sorted_rows, prepend=-1).astype(bool)) if len(order) else order
        move(views(flat)[1 + i], views(past)[1 + i], sorted_rows[new].astype(np.int64), sums(g.view(PAIR), order % len(leaf), new).view(np.float32))


#: Rows of a group up to which groups are added side by side; a call of reduceat costs more than so many additions.
FEW = 4


def sums(g: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Sums of the rows g[at] in groups that begin at `new`."""
    size = np.diff(new, append=len(at))
    total = np.take(g, at[new], axis=0)
    large = size > FEW
    if large.any():
        long = size[large]
        total[large] = np.add.reduceat(np.take(g, at[np.repeat(large, size)], axis=0), np.cumsum(long) - long, axis=0)
    some = np.flatnonzero(~large & (size > 1))
    some = some[np.argsort(-size[some], kind="stable")]
    if len(some):
        start, longer = new[some], [int(np.count_nonzero(size[some] > k)) for k in range(1, FEW)]
        rest = np.take(g, at[start + 1], axis=0)
        for k, n in enumerate(longer[1:], 2):
            rest[:n] += np.take(g, at[start[:n] + k], axis=0)
        total[some] += rest
    return total


def move(w: np.ndarray, past: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
    """An AdaGrad step in place; g is overwritten."""
    p = np.take(past, rows, axis=0)
    p += g * g
    past[rows] = p
    p += np.float32(1e-3)
    np.sqrt(p, out=p)
    g *= np.float32(RATE)
    g /= p
    now = np.take(w, rows, axis=0)
    now -= g
    w[rows] = now


def train(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """docs: the training texts. Round r takes those whose hash of the text leaves r."""
    spark = docs.sparkSession
    sc, flat = spark.sparkContext, model()
    sent_v = sc.broadcast(tuple(v))
    for r in range(rounds):
        sent = sc.broadcast(flat)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, past, v = sent.value.copy(), np.zeros_like(sent.value), Vocabulary(*sent_v.value)
            held_back: list[tuple] = []
            size = 0

            def go(all_of_it: bool):
                leaf, known, deep = (np.concatenate(x, axis=-1) for x in zip(*held_back))
                end = len(leaf) if all_of_it else len(leaf) // BATCH * BATCH
                for i in range(0, end, BATCH):
                    j = min(end, i + BATCH)
                    step(now, past, leaf[i:j], known[:, i:j], deep[:, i:j])
                return [(leaf[end:], known[:, end:], deep[:, end:])] if end < len(leaf) else []

            for b in batches:
                for _, data, bounds in chunks(b, "text"):
                    t = tokens(data, bounds)
                    leaf = leaves(t, v)
                    held_back.append((leaf, *features(leaf, t.first)))
                    size += len(leaf)
                    if size >= BATCH:
                        held_back = go(False)
                        size = sum(len(x[0]) for x in held_back)
            if held_back:
                go(True)
            change = now - sent.value
            if change.any():
                for i in range(0, len(change), BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([change[i : i + BLOCK].tobytes()], pa.binary())], ["block", "part"])

        part = docs.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r).select("text")
        flat = averaged(mapped(part.coalesce(max(1, sc.defaultParallelism)), learn, "block int, part binary"), flat)
        sent.destroy()
    return flat


BLOCK = 1 << 14


def log_probability(flat: np.ndarray, v: Vocabulary, leaf: np.ndarray, known: np.ndarray, deep: np.ndarray) -> np.ndarray:
    """log10 P(class | history) P(leaf | class, history) / (n + v + 1) of each token."""
    out = np.empty(len(leaf))
    for i in range(0, len(leaf), BATCH):
        part = slice(i, i + BATCH)
        n = np.arange(len(leaf[part]))
        total = 0.0
        for raw, target in zip(raws(flat, known[:, part], deep[:, part]), (leaf[part] // LEAVES, leaf[part] % LEAVES)):
            top = raw.max(1)
            total = total + raw[n, target].astype(np.float64) - top - np.log(np.exp(raw - top[:, None]).sum(1))
        out[part] = total / math.log(10)
    return out - v.log_leaf[leaf]


ROW = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, sure_known bigint, sure_log double, model_log double, rare array<bigint>, times array<int>"


def score(docs: DataFrame, table: DataFrame, v: Vocabulary, flat: np.ndarray) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((tuple(v), flat))

    def read(batches):
        v, flat = Vocabulary(*sent.value[0]), sent.value[1]
        row = partition_number() << 33
        for b in batches:
            for rows, data, bounds in chunks(b, "text"):
                n, t = rows.stop - rows.start, tokens(data, bounds)
                size = np.diff(t.first)
                u, back = np.unique(t.hashes, return_inverse=True)
                sure, at = found(v.known, u)
                log_count = np.where(sure, v.log_count[at] if len(v.known) else 0, 0.0)
                leaf = leaves(t, v)
                add = lambda x: np.add.reduceat(x, t.first[:-1])  # noqa: E731  every row has its end
                model_log = add(log_probability(flat, v, leaf, *features(leaf, t.first)))
                rare = ~sure[back]
                pairs, times = np.unique(np.repeat(np.arange(n), size)[rare] * len(u) + back[rare], return_counts=True)
                cut = pa.array(np.searchsorted(pairs, np.arange(n + 1) * len(u)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), b.column("doc_id").slice(rows.start, n), b.column("held_out").slice(rows.start, n), pa.array(size), pa.array(add(sure[back].astype(np.int64))), pa.array(add(log_count[back])), pa.array(model_log),
                     pa.ListArray.from_arrays(cut, pa.array(u[pairs % len(u)].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(times, pa.int32()))],
                    [c.split()[0] for c in ROW.split(", ")],
                )
                row += n

    rows = store(mapped(docs.select("doc_id", "held_out", "text"), read, ROW), "scored")
    rest = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("u")).select("row", F.col("u.rare").alias("word"), F.col("u.times").alias("n"))
    more = rest.join(table.select("word", F.col("times").alias("c")), "word").groupBy("row").agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log"))
    full = rows.drop("rare", "times").join(more, "row", "left")
    log_count = F.col("sure_log") + F.coalesce("log", F.lit(0.0))
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("sure_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(v.total).cast("bigint").alias("train_tokens"),
        (log_count - F.col("n_tokens") * v.log_all).alias("base_score"), (log_count + F.col("model_log")).alias("score"),
    )


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Texts whose crc32 of the id leaves `fold`
    are not learned from."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("held_out", held(F.col("doc_id"), folds, fold))
    learned = texts.where("NOT held_out").select("text")
    table = store(counts(learned), "vocabulary")
    v = vocabulary(table)
    return score(texts, table, v, train(learned, v))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
