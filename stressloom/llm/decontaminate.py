"""Benchmark decontamination by greedy string tiling.

Words are compared with A-Z folded. A tile is a stretch of MATCH words or more that a document and an item share; the longest
one is marked first (ties: the earliest in the item, then in the document), and marked words take part in no other tile. The coverage
of an item is the share of its words that tiles mark, in whatever order they stand in the document. A document is contaminated if
an item reaches COVERAGE. Items of fewer than MATCH words have no tile and contaminate nothing, and so do null and empty texts.

1. Seeds are the hashes of MATCH words in a row. Those of the benchmark set bits of a map of BITS bits: its size is fixed, it is
   broadcast whatever the size of the benchmark, and it only decides what is looked at more closely.
2. Every document is scanned whole; the stretches whose seeds hit the map leave with their word hashes. No tile lies elsewhere.
3. Seeds of documents and items join by their hash; pairs whose shared seeds, at all their positions in the item, could not reach COVERAGE
   leave.
4. Each pair is tiled: running Karp-Rabin with a falling match length finds the longest matches, on word hashes.

Rows without an id are never contaminated. Rows of one id are judged together.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stressloom.llm.staging import by_slot, mapped, small_batches, store
from stressloom.llm.text import Words, chunks, grams, words

MATCH = 5
COVERAGE = 0.5
BITS = 1 << 22


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words array<bigint>) of items with MATCH words or more; of rows with one id each text is an item of its own."""

    def read(batches):
        for b in batches:
            for rows, data, bounds in chunks(b, "text"):
                w = words(data, bounds)
                lists = pa.ListArray.from_arrays(pa.array(w.first, pa.int32()), pa.array(w.hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("item_id").slice(rows.start, rows.stop - rows.start), lists], ["item_id", "words"])

    return mapped(items, read, "item_id bigint, words array<bigint>").where(F.size("words") >= MATCH)


def seeds_of(h: np.ndarray) -> np.ndarray:
    none = np.empty(0, np.int64)
    return grams(Words(h.view(np.uint64), np.array([0, len(h)]), none, none), MATCH)[0].view(np.int64)


def item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item, length, places): the distinct seeds of every item and at how many positions each stands."""

    def read(batches):
        for b in batches:
            for item, h in zip(b.column("item").to_pylist(), b.column("words")):
                h = h.values.to_numpy()
                s, places = np.unique(seeds_of(h), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), item)), pa.array(np.full(len(s), len(h))), pa.array(places)], ["seed", "item", "length", "places"])

    return mapped(items.select("item", "words"), read, "seed bigint, item bigint, length bigint, places bigint")


def seed_map(seeds: DataFrame) -> np.ndarray:
    """The bits that seeds set: every task makes one map, and maps are merged in groups."""

    def read(batches):
        bits = np.zeros(BITS // 8, np.uint8)
        for b in batches:
            at = b.column("seed").to_numpy().view(np.uint64) % np.uint64(BITS)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    maps = mapped(seeds.select("seed"), read, "bits binary").rdd.map(lambda r: np.frombuffer(r["bits"], np.uint8))
    return maps.treeReduce(np.bitwise_or) if maps.getNumPartitions() else np.zeros(BITS // 8, np.uint8)


def stretches(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(doc_id, at array<int>, words array<bigint>, seeds array<bigint>) of documents whose seeds hit the map: positions and hashes
    of the words in those seeds, and the seeds."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def read(batches):
        bits = sent.value
        for b in batches:
            ids = b.column("doc_id")
            for rows, data, bounds in chunks(b, "text"):
                w = words(data, bounds)
                g, first = grams(w, MATCH)
                at = g % np.uint64(BITS)
                hit = np.flatnonzero(bits[(at >> np.uint64(3)).astype(np.int64)] & np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
                row = np.searchsorted(first, hit, "right") - 1
                whole = np.diff(w.first)[row] >= MATCH
                hit, row = hit[whole], row[whole]
                for r in np.unique(row):
                    mine = hit[row == r]
                    pos = np.unique((mine - first[r])[:, None] + np.arange(MATCH))
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(rows.start + int(r), 1), *[pa.array([x], pa.list_(t)) for x, t in ((pos, pa.int32()), (w.hashes[w.first[r] + pos].view(np.int64), pa.int64()), (np.unique(g[mine]).view(np.int64), pa.int64()))]],
                        ["doc_id", "at", "words", "seeds"],
                    )

    return mapped(docs, read, "doc_id bigint, at array<int>, words array<bigint>, seeds array<bigint>")


def matches(doc: list[np.ndarray], item: np.ndarray, size: int) -> list[tuple[int, int, int, int]]:
    """Maximal matches of at least `size` unmarked words as (-length, item position, part, part position). Marked words are 0."""
    seen = defaultdict(list)
    for p, part in enumerate(doc):
        for i, key in windows(part, size):
            seen[key].append((p, i))
    out = []
    for j, key in windows(item, size):
        for p, i in seen.get(key, ()):
            part = doc[p]
            if i and j and part[i - 1] == item[j - 1] != 0:
                continue  # not maximal on the left
            n = 0
            while i + n < len(part) and j + n < len(item) and part[i + n] == item[j + n] != 0:
                n += 1
            if n >= size:
                out.append((-n, j, p, i))
    return sorted(out)


def windows(h: np.ndarray, size: int):
    """Rolling hashes of `size` words without a marked one."""
    if len(h) < size:
        return
    base, total = 0x9E3779B1, 0
    top = pow(base, size, 2**61 - 1)
    marked = np.flatnonzero(h == 0)
    free = np.searchsorted(marked, np.arange(len(h) - size + 1)) == np.searchsorted(marked, np.arange(size, len(h) + 1))
    values = h.tolist()
    for k, x in enumerate(values):
        total = (total * base + x) % (2**61 - 1)
        if k >= size:
            total = (total - values[k - size] * top) % (2**61 - 1)
        if k >= size - 1 and free[k - size + 1]:
            yield k - size + 1, total


def tiled(at: np.ndarray, doc: np.ndarray, item: np.ndarray, size: int = MATCH) -> int:
    """Words of the item that tiles mark."""
    breaks = np.flatnonzero(np.diff(at) > 1) + 1
    doc = [np.where(p == 0, 1, p) for p in np.split(doc, breaks)]
    item = np.where(item == 0, 1, item)
    marked = 0
    search = max(size, len(item))  # falls by halves to `size`, then any match that is left is shorter
    while True:
        found = matches(doc, item, search)
        for less, j, p, i in found:
            n = -less
            if less > found[0][0]:
                break  # shorter ones wait until what is left of the longest is looked at again
            if (item[j : j + n] != 0).all() and (doc[p][i : i + n] != 0).all():
                item[j : j + n] = 0
                doc[p][i : i + n] = 0
                marked += n
        if search == size and not found:
            return marked
        if not found:
            search = max(size, search // 2)


def coverage(docs: DataFrame, items: DataFrame, least: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, tiled, length, coverage) of all pairs that reach `least`. docs: doc_id, text; items: item_id, text."""
    spark = docs.sparkSession
    small_batches(spark)
    known = store(item_words(items).withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"]), "items")
    seeds = store(item_seeds(known), "seeds")
    found = store(stretches(docs.where("doc_id IS NOT NULL"), seed_map(seeds)).withColumn("form", F.xxhash64("words", "at")), "stretches")
    hits = found.select("doc_id", "form", F.explode("seeds").alias("seed")).join(seeds, "seed")
    pairs = hits.groupBy("doc_id", "form", "item", "length").agg(F.sum("places").alias("shared")).where(F.col("shared") * MATCH >= F.col("length") * least)
    ready = (
        pairs.select("doc_id", "form", "item")
        .join(known.select("item", "item_id", F.col("words").alias("item_words")), "item")
        .join(found.select("doc_id", "form", "at", "words"), ["doc_id", "form"])
        .select("doc_id", "item_id", "at", "words", "item_words")
    )

    def tile(batches):
        for b in batches:
            marked = [tiled(at.values.to_numpy(), d.values.to_numpy(), i.values.to_numpy()) for at, d, i in zip(b.column("at"), b.column("words"), b.column("item_words"))]
            length = [len(i) for i in b.column("item_words")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("item_id"), pa.array(marked, pa.int32()), pa.array(length, pa.int32())], ["doc_id", "item_id", "tiled", "length"])

    made = mapped(ready, tile, "doc_id bigint, item_id bigint, tiled int, length int")
    return made.withColumn("coverage", F.col("tiled") / F.col("length")).where(F.col("coverage") >= least)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = COVERAGE) -> DataFrame:
    """One row per input row: doc_id, contaminated, items (the ids that reach `least`), coverage (the highest, 0 without one)."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    hits = coverage(texts, items.select(F.col("item_id").cast("bigint").alias("item_id"), "text"), least)
    by_doc = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"))
    return texts.select("doc_id").join(by_doc, "doc_id", "left").select(
        "doc_id", F.col("coverage").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    hits = coverage(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), items).select(F.col("doc_id").alias("hit")).distinct()
    hits = store(hits, "hits")
    near = by_slot(docs, "doc_id", hits, "hit", "left_semi")
    free = "_" * (1 + max(len(c) for c in docs.columns))  # a name that no column has
    return by_slot(docs, "doc_id", hits, "hit", "left_anti").union(near.join(hits.toDF(free), F.col("doc_id").cast("bigint") == F.col(free), "left_anti"))
