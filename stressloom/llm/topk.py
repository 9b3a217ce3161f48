"""Exact top-k search by inner product: a three-phase uniform threshold.

Components are integers, floor(256 x), and split into LISTS blocks of dimensions; the score of a pair is the sum of its LISTS partial
scores. A group of queries meets a chunk of candidates as two matrices; every query meets every chunk. A task reads its chunks one after
the other and keeps the k best of each of its queries over all of them.

1. Each task gathers the k best entries of every list for every query and resolves their whole scores; the k-th best of all
   resolved scores is a safe cutoff for the query, since k candidates reach it.
2. The cutoff is sent with the queries to all chunks. A candidate that reaches it has a partial score of cutoff / LISTS or more in one
   list at least; each task collects these entries.
3. What a list has not shown is less than cutoff / LISTS; candidates whose bound still reaches the cutoff get their whole score. At most
   k of them per query and task leave, ties to the smaller id, and the k best of all are the answer.

Vectors that are null, empty or hold null or non-finite components take no part, and so do rows without an id and vectors whose length
is not that of most vectors (ties: the smaller length). Repeated ids are candidates each and one query with the least vector; a query never meets its own id. Scores
are exact: partial sums are taken in float32 where all products and sums stay below 2^24, in float64 below 2^53, else in int64; components
beyond 2^27 are rejected with an error.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stressloom.llm.staging import mapped, small_buffers, store

LISTS, K, EVERY = 4, 5, 50
#: Rows of a matrix of candidates and of queries: a task holds one of each and their partial scores.
CHUNK, GROUP = 1024, 512
#: Matrices in a stored file, and about as many groups of queries as stay in a task beside the chunks that it reads.
FILE, PART = 32, 128
#: Less than any score.
NONE = -(1 << 62)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<bigint>) of the vectors that take part."""
    fit = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    some = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & fit)
    lengths = some.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = lengths["n"] if lengths else 0
    return some.where(F.size("v") == width).select("vec_id", F.transform("v", lambda x: F.floor(x * 256.0).cast("bigint")).alias("v"))


def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(ids array<bigint>, m binary, width int): rows in matrices of at most `size` rows, of integers of `width` bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = np.empty(0, np.int64), None
        for b in batches:
            v = b.column("v")
            new = v.flatten().to_numpy().reshape(len(b), -1) if len(b) else np.empty((0, 0), np.int64)
            ids = np.concatenate([ids, b.column("vec_id").to_numpy()])
            m = new if m is None else np.concatenate([m, new])
            while len(ids) >= size:
                yield matrix(ids[:size], m[:size])
                ids, m = ids[size:], m[size:]
        if len(ids):
            yield matrix(ids, m)

    return store(mapped(rows, pack, "ids array<bigint>, m binary, width int"), name, rows=FILE)


def matrix(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    most = np.abs(m).max(initial=0)
    if most >= 1 << 27:
        raise ValueError("components beyond 2^27 are not supported")
    width = 2 if most < 1 << 15 else 4
    return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([m.astype(f"i{width}").tobytes()], pa.binary()), pa.array([width], pa.int32())], ["ids", "m", "width"])


def pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every group of queries beside every chunk of candidates, once. A task reads stored chunks one by one and holds a part of the groups
    for them. Neither side is repeated in a shuffle, and none goes through the driver: Spark takes a table that is repeated over the other
    for no larger than it was, and would broadcast it."""
    parts = max(1, -(-queries.count() // PART))
    chunks = candidates.select(*(F.col(c).alias(f"c_{c}") for c in candidates.columns))
    return chunks.crossJoin(queries.repartition(parts).hint("shuffle_replicate_nl"))


def sides(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, c_ids = (b.column(n)[i].values.to_numpy() for n in ("ids", "c_ids"))
    m, c_m = (np.frombuffer(b.column(f"{n}m")[i].as_buffer(), f"i{b.column(f'{n}width')[i].as_py()}").reshape(len(x), -1) for n, x in (("", ids), ("c_", c_ids)))
    return ids, m, c_ids, c_m


def partials(m: np.ndarray, c_m: np.ndarray) -> np.ndarray:
    """(list, query, candidate) partial scores."""
    most = int(np.abs(m).max(initial=1)) * int(np.abs(c_m).max(initial=1)) * m.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    cuts = np.array_split(np.arange(m.shape[1]), min(LISTS, m.shape[1]))
    p = np.empty((len(cuts), len(m), len(c_m)), kind)
    for cut, out in zip(cuts, p):
        np.matmul(m[:, cut].astype(kind), c_m[:, cut].astype(kind).T, out=out)
    return p


def own(ids: np.ndarray, c_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the queries and candidates that are the same vector; the ids of queries are distinct."""
    order = np.argsort(ids)
    at = order[np.searchsorted(ids, c_ids, sorter=order).clip(max=len(ids) - 1)]
    c = np.flatnonzero(ids[at] == c_ids)
    return at[c], c


def true(flags: np.ndarray) -> np.ndarray:
    """Flat positions of what is true. That is little, so eight flags are looked at in one."""
    flags = flags.ravel()
    whole = len(flags) // 8 * 8
    some = np.flatnonzero(flags[:whole].view(np.uint64))
    at, by = np.nonzero(flags[:whole].reshape(-1, 8)[some])
    return np.concatenate([some[at] * 8 + by, whole + np.flatnonzero(flags[whole:])])


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries of every query, ties to the smaller id."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return order[rank < k]


class Best:
    """The k best entries so far of every query of a group, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.query, self.vec, self.score = (np.empty(0, np.int64) for _ in range(3))
        self.least, self.last = np.full(len(ids), NONE), np.full(len(ids), np.iinfo(np.int64).max)  # score and id of the k-th

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        score = score.astype(np.int64)
        new = (score > self.least[query]) | ((score == self.least[query]) & (vec < self.last[query]))
        if new.any():
            query, vec, score = (np.concatenate([a, b[new]]) for a, b in ((self.query, query), (self.vec, vec), (self.score, score)))
            pick = best(query, vec, score, self.k)
            self.query, self.vec, self.score = query[pick], vec[pick], score[pick]
            kth = np.flatnonzero(np.arange(len(pick)) - np.searchsorted(self.query, self.query) == self.k - 1)
            self.least[self.query[kth]], self.last[self.query[kth]] = self.score[kth], self.vec[kth]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query]), pa.array(self.vec), pa.array(self.score)], ["query_id", "vec_id", "score"])


class Tops:
    """The k best partial scores so far of every list and query. They only tell which entries to resolve, so float64 will do."""

    def __init__(self, k: int):
        self.k, self.top = k, None

    def over(self, p: np.ndarray) -> np.ndarray:
        """Flat positions of the entries that are among the k best so far, of lists, queries and candidates that come with p."""
        size, take = p.shape[2], min(self.k, p.shape[2])
        if self.top is None:
            self.top = np.full((p.shape[0] * p.shape[1], self.k), -np.inf)
            at = np.argpartition(p, size - take, axis=2)[:, :, size - take :]
            flat = (np.arange(len(self.top)).reshape(p.shape[:2])[:, :, None] * size + at).ravel()
        else:
            least = self.top[:, 0].reshape(p.shape[:2])
            flat = true(p > (least.astype(p.dtype) if p.dtype.kind == "f" else least)[:, :, None])
        key, value = flat // size, p.ravel()[flat].astype(np.float64)
        pick = best(key, flat, value, self.k)
        key, value = key[pick], value[pick]
        some, row = np.unique(key, return_inverse=True)
        new = np.full((len(some), self.k), -np.inf)
        new[row, np.arange(len(key)) - np.searchsorted(key, key)] = value
        self.top[some] = np.sort(np.concatenate([self.top[some], new], axis=1), axis=1)[:, -self.k :]
        return flat


ENTRY = "query_id bigint, vec_id bigint, score bigint"


def gather(both: DataFrame, k: int) -> DataFrame:
    """Phase 1: the whole scores of the k best entries of every list."""

    def meet(tops, found, ids, m, c_ids, c_m):
        p = partials(m, c_m)
        at = own(ids, c_ids)
        p[:, *at] = -np.inf if p.dtype.kind == "f" else np.iinfo(p.dtype).min
        pair = np.unique(tops.over(p) % p[0].size)
        pair = pair[~np.isin(pair, at[0] * len(c_ids) + at[1])]
        found.add(pair // len(c_ids), c_ids[pair % len(c_ids)], p.reshape(len(p), -1)[:, pair].sum(0))

    def read(batches):
        held = {}  # by the first id of the group
        for b in batches:
            for i in range(len(b)):
                ids, *others = sides(b, i)
                if ids[0] not in held:
                    held[ids[0]] = Tops(k), Best(ids.copy(), k)
                meet(*held[ids[0]], ids, *others)
        yield from (found.rows() for _, found in held.values())

    return mapped(both, read, ENTRY)


def resolve(both: DataFrame, k: int) -> DataFrame:
    """Phases 2 and 3: entries over cutoff / lists, bounds, and whole scores of what may still reach the cutoff."""

    def meet(found, cutoff, ids, m, c_ids, c_m):
        p = partials(m, c_m)
        cutoff = np.maximum(cutoff, found.least)  # k candidates of this task reach it too
        share = -(-cutoff // len(p))  # partial scores are whole numbers
        some = true(p.max(axis=0) >= share.astype(p.dtype)[:, None])
        q, c = some // len(c_ids), some % len(c_ids)
        parts = p.reshape(len(p), -1)[:, some].astype(np.int64)
        left = (np.maximum(parts, share[q]).sum(0) >= cutoff[q]) & (ids[q] != c_ids[c])
        q, c, score = q[left], c[left], parts[:, left].sum(0)
        enough = score >= cutoff[q]
        found.add(q[enough], c_ids[c[enough]], score[enough])

    def read(batches):
        held = {}  # by the first id of the group
        for b in batches:
            for i in range(len(b)):
                ids, *others = sides(b, i)
                if ids[0] not in held:
                    held[ids[0]] = Best(ids.copy(), k)
                meet(held[ids[0]], b.column("cutoffs")[i].values.to_numpy(), ids, *others)
        yield from (found.rows() for found in held.values())

    return mapped(both, read, ENTRY)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of every query. A query has at most k entries per task here; they are cut once more by groups of ids before
    they meet, so that a query does not gather more than k entries of each of few groups."""
    by = [F.desc("score"), "vec_id"]
    some = found.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*by))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the vectors whose id is divisible by `every`; candidates all others."""
    small_buffers(vectors.sparkSession)
    some = store(whole_vectors(vectors), "vectors")
    queries = packed(some.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), GROUP, "queries")
    candidates = packed(some, CHUNK, "candidates")
    first = store(ranked(gather(pairs(queries, candidates), k), k), "first")
    # fewer than k entries: no cutoff, any score may still be among the best
    cutoff = first.groupBy("query_id").agg(F.max("rank").alias("n"), F.min("score").alias("score")).select("query_id", F.when(F.col("n") == k, F.col("score")).alias("cutoff"))
    at = queries.select(F.xxhash64("ids").alias("part"), F.posexplode("ids").alias("at", "query_id")).join(cutoff, "query_id", "left")
    lists = at.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("cutoff", F.lit(NONE)).alias("cutoff")))), lambda x: x["cutoff"]).alias("cutoffs"))
    sent = store(queries.withColumn("part", F.xxhash64("ids")).join(lists, "part").drop("part"), "queries", rows=FILE)
    return ranked(resolve(pairs(sent, candidates), k), k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def sql(k: int = K, every: int = EVERY) -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= {k}"""
