"""Near duplicates: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full shingle sets.

Words are runs of bytes other than 0x20 and 0x09-0x0D with A-Z folded; a document's set holds its distinct five-word shingles. With
fewer words the whole sequence is the one shingle; without words the set is empty and links with nothing. Two documents link if
100 * intersection >= least * union.

1. Documents of one word sequence form a class; from here on only its smallest id takes part.
2. A signature has CHUNKS longs of 4 lanes with 16 bits of a minimum each, 28 lanes in all. Signatures that differ in at most
   DISTANCE = 2 * CHUNKS - 1 = 13 lanes have, by pigeonhole, a chunk with one differing lane or none. So a class has one key per chunk
   and lane, with that lane blanked, and every such pair shares a key. At a similarity of s the number of differing lanes is
   binomial (28, 1 - s): a pair of exactly 0.85 lies beyond 13 with probability 1.4e-5, one of exactly 0.80 with 3.7e-4, and
   any closer pair more rarely.
3. In each of TURNS turns every key draws one of its members by a hash as its centre. Members in another component than the centre
   meet it; pairs that pass the signature distance are confirmed on the texts, and the links found so far give new
   components. A key costs no more pairs than it has members.
4. What is left are documents of keys whose members still lie in different components, and links between those components. Two sets that
   link share a shingle among the rarest 100 - least percent of each (see rare_parts), so these documents join on them: members outside
   the largest component of a shingle meet all members of other components, pairs within the signature distance are
   confirmed. No link between different components is lost. A group of copies that the turns have joined costs no further pair, and
   copies that differ too much have rare shingles of their own and do not meet.
5. All links give the components.

Null texts are empty. A row without an id has no component and is kept. Repeated ids count as one document for each text they have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stressloom.llm.components import components
from stressloom.llm.staging import by_slot, mapped, small_batches, store
from stressloom.llm.text import chunks, grams, mix, words

#: Least similarity in percent: of the query, and of the pipeline's stage.
WORDS, LEAST, STAGE_LEAST = 5, 85, 80
CHUNKS, LANES, BITS = 7, 4, 16
DISTANCE = 2 * CHUNKS - 1
#: Turns, members that a key draws as centres in each, and the signature distance of pairs that are confirmed there: these only decide
#: what is left for the last step.
TURNS, CENTRES, CLOSE = 1, 4, 7
#: Members of one centre whose texts are compared in one group of rows.
SALT = 64

_RANDOM = np.random.RandomState(30011)
_TIMES = _RANDOM.randint(0, 2**63, CHUNKS * LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.randint(0, 2**63, CHUNKS * LANES, dtype=np.uint64)
_SEQUENCE = (0xD1B54A32D192ED03, 0xABC98388FB8FAC03)
_SIGNATURE = [f"s{i}" for i in range(CHUNKS)]


def sequence_keys(w) -> list[np.ndarray]:
    """Two hashes of each row's sequence of words."""
    size = np.diff(w.first)
    at = np.arange(len(w.hashes)) - np.repeat(w.first[:-1], size)
    top, out = int(size.max(initial=0)) + 1, []
    for base in _SEQUENCE:
        steps = np.full(top, base, np.uint64)
        steps[0] = 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hashes * np.multiply.accumulate(steps)[at])])
        out.append(mix(total[w.first[1:]] - total[w.first[:-1]] + size.astype(np.uint64)).view(np.int64))
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, form, n_shingles, k0, k1, s0..s6) of every row; the signature of an empty set is not used."""

    def read(batches):
        for b in batches:
            for rows, data, bounds in chunks(b, "text"):
                w = words(data, bounds)
                g, first = grams(w, WORDS)
                n, size = rows.stop - rows.start, np.zeros(rows.stop - rows.start, np.int64)
                for i in range(n):
                    if first[i + 1] > first[i]:
                        s = np.sort(g[first[i] : first[i + 1]])
                        size[i] = 1 + np.count_nonzero(s[1:] != s[:-1])
                some = np.flatnonzero(np.diff(first))
                sign = np.zeros((CHUNKS, n), np.uint64)
                for k in range(CHUNKS * LANES if len(some) else 0):
                    least = np.minimum.reduceat(mix_lane(g, k), first[some])
                    sign[k // LANES, some] |= (mix(least) & np.uint64(0xFFFF)) << np.uint64(BITS * (k % LANES))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(rows.start, n), b.column("form").slice(rows.start, n), pa.array(size), *map(pa.array, sequence_keys(w)), *[pa.array(s.view(np.int64)) for s in sign]],
                    ["doc_id", "form", "n_shingles", "k0", "k1", *_SIGNATURE],
                )

    kind = ", ".join(f"{c} bigint" for c in ["doc_id", "form", "n_shingles", "k0", "k1", *_SIGNATURE])
    return mapped(docs.select("doc_id", F.xxhash64("text").alias("form"), "text"), read, kind)


def mix_lane(g: np.ndarray, k: int) -> np.ndarray:
    x = g * _TIMES[k] + _PLUS[k]
    x ^= x >> np.uint64(29)
    return x


def keys(c: str = "") -> Column:
    """The keys of a signature: chunk and blanked lane in the 5 bits above the 48 that are left of the chunk."""
    out = []
    for i in range(CHUNKS):
        s = F.col(c + _SIGNATURE[i])
        for j in range(LANES):
            low = s.bitwiseAND(F.lit((1 << BITS * j) - 1))
            high = F.shiftrightunsigned(s, BITS * (j + 1)) if j < LANES - 1 else F.lit(0)
            out.append(F.shiftleft(high, BITS * j).bitwiseOR(low).bitwiseOR(F.lit((i * LANES + j) << 48)))
    return F.explode(F.array(*out))


def distance(a: str, b: str) -> Column:
    """Lanes in which two signatures differ."""
    total = F.lit(0)
    for s in _SIGNATURE:
        x = F.col(a + s).bitwiseXOR(F.col(b + s))
        for shift in (1, 2, 4, 8):  # the lowest bit of each lane becomes its "or"
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
    return total


def signed(sign: DataFrame, p: str) -> DataFrame:
    return sign.select(F.col("doc_id").alias(p), F.col("n_shingles").alias(f"{p}_n"), *[F.col(s).alias(f"{p}_{s}") for s in _SIGNATURE])


def near(a: str, b: str, least: int, most: int = DISTANCE) -> Column:
    """Within a signature distance, and of set sizes that allow the least similarity."""
    sizes = F.least(f"{a}_n", f"{b}_n") * 100 >= F.greatest(f"{a}_n", f"{b}_n") * least
    return sizes & (distance(f"{a}_", f"{b}_") <= most)


def confirmed(pairs: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the least similarity. Texts of b travel once per pair, those of a once per SALT pairs."""
    texts = by_slot(docs, "doc_id", pairs.select(F.col("a").alias("id")).union(pairs.select("b")), "id", "left_semi")
    salted = pairs.join(pairs.groupBy("a").count(), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / SALT)))
    salted = store(salted.select("a", "b", "salt"), "salted")
    one = salted.select("a", "salt").distinct().join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
    other = salted.select("a", "b", "salt").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")

    def sets(b, column):
        for rows, data, bounds in chunks(b, column):
            g, first = grams(words(data, bounds), WORDS)
            for i in range(rows.stop - rows.start):
                yield g[first[i] : first[i + 1]]

    def read(batches):
        held, of = None, None
        for b in batches:
            out, ids = np.zeros(len(b), bool), b.column("a").to_numpy()
            for i, (x, y) in enumerate(zip(sets(b, "a_text"), sets(b, "b_text"))):
                if of != ids[i]:
                    of, held = ids[i], np.unique(x)
                y = np.unique(y)
                common = len(np.intersect1d(held, y, assume_unique=True))
                out[i] = 0 < 100 * common >= least * (len(held) + len(y) - common)
            yield b.select(["a", "b"]).filter(pa.array(out))

    joined = one.join(other, ["a", "salt"]).select("a", "b", "a_text", "b_text")
    return mapped(joined, read, "a bigint, b bigint")


def rare_parts(texts: DataFrame, least: int) -> DataFrame:
    """(shingle, doc_id, size, rank): of each set the n - ceil(n * least / 100) + 1 shingles that the fewest of these documents hold. Two sets that
    link share one of them, since both lists follow one order and the rest is smaller than the common part. Shingles of one
    document take up their places and meet nothing."""

    def read(batches):
        for b in batches:
            for rows, data, bounds in chunks(b, "text"):
                g, first = grams(words(data, bounds), WORDS)
                for i in range(rows.stop - rows.start):
                    s = np.unique(g[first[i] : first[i + 1]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), b.column("doc_id")[rows.start + i].as_py())), pa.array(s.view(np.int64)), pa.array(np.full(len(s), len(s)))], ["doc_id", "shingle", "n"])

    rows = store(mapped(texts, read, "doc_id bigint, shingle bigint, n bigint"), "shingles")
    held = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    mine = Window.partitionBy("doc_id")
    ranked = rows.join(held, "shingle").select("doc_id", "shingle", "n", F.row_number().over(mine.orderBy("docs", "shingle")).alias("rank"), F.count(F.lit(1)).over(mine).alias("common"))
    places = F.col("n") - F.ceil(F.col("n") * least / 100) + 1 - (F.col("n") - F.col("common"))
    return ranked.where(F.col("rank") <= places).select("shingle", "doc_id", F.col("n").alias("size"), (F.col("n") - F.col("common") + F.col("rank")).alias("rank"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, form (a hash of the text), kept."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = store(signatures(texts), "signatures")
    with_set = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = store(with_set.groupBy("k0", "k1").agg(F.min(F.struct("doc_id", "n_shingles", *_SIGNATURE)).alias("r")).select("k0", "k1", "r.*"), "classes")
    sign = classes.groupBy("doc_id").agg(F.min(F.struct("n_shingles", *_SIGNATURE)).alias("r")).select("doc_id", "r.*")

    keyed = classes.select(keys().alias("key"), "doc_id")
    # stored, so that the join is a plain one between two exchanges, whose hot keys Spark can split
    shared = store(keyed.groupBy("key").count().where("count > 1").select("key"), "shared")
    placed = store(keyed.join(shared, "key").select("key", "doc_id", F.col("doc_id").alias("c")), "members")
    ids = placed.select("doc_id").distinct()
    texts = store(by_slot(texts, "doc_id", ids, "doc_id", "left_semi").join(ids, "doc_id", "left_semi"), "texts", "snappy")
    links = None
    for turn in range(TURNS):
        member = placed.join(signed(sign, "y"), placed["doc_id"] == F.col("y")).drop("doc_id")
        draw = [F.min(F.struct(F.xxhash64("y", "key", F.lit(turn * CENTRES + i)).alias("h"), *member.drop("key").columns)) for i in range(CENTRES)]
        centre = member.groupBy("key").agg(F.array_distinct(F.array(*draw)).alias("m"))
        met = member.join(centre, "key").select("*", F.explode("m").alias("x")).where(F.col("c") != F.col("x.c"))
        met = met.withColumns({f"x_{v}": F.col(f"x.y_{v}") for v in ("n", *_SIGNATURE)}).where(near("x", "y", least, CLOSE))
        close = met.select(F.least("x.y", "y").alias("a"), F.greatest("x.y", "y").alias("b")).distinct()
        found = store(confirmed(store(close, "pairs"), texts, least), "links")
        links = found if links is None else links.union(found)
        of = components(links, "a", "b")
        placed = placed.drop("c").join(of.toDF("doc_id", "c"), "doc_id", "left").select("key", "doc_id", F.coalesce("c", "doc_id").alias("c"))
        mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("key")
        placed = store(placed.join(mixed, "key"), "members")
    left = store(placed.select("doc_id", "c").distinct(), "left")
    rare = store(rare_parts(by_slot(texts, "doc_id", left, "doc_id", "left_semi").join(left, "doc_id", "left_semi"), least).join(left, "doc_id"), "rare")
    main = rare.groupBy("shingle", "c").count().groupBy("shingle").agg(F.max(F.struct("count", "c"))["c"].alias("main"), F.count(F.lit(1)).alias("n"))
    rest = rare.join(main.where("n > 1").drop("n"), "shingle")
    apart = rest.where("c != main").select("shingle", F.col("doc_id").alias("x"), F.col("c").alias("xc"), F.col("size").alias("xs"), F.col("rank").alias("xr")).join(signed(sign, "x"), "x")
    others = rest.select(F.col("shingle").alias("of"), F.col("doc_id").alias("y"), F.col("c").alias("yc"), "main", F.col("size").alias("ys"), F.col("rank").alias("yr")).join(signed(sign, "y"), "y")
    # behind the first shingle that both hold there must be room for the common part
    room = (100 + least) * (F.least(F.col("xs") - F.col("xr"), F.col("ys") - F.col("yr")) + 1) >= least * (F.col("xs") + F.col("ys"))
    fits = (F.col("xc") != F.col("yc")) & ((F.col("yc") == F.col("main")) | (F.col("x") < F.col("y"))) & room & near("x", "y", least)
    pairs = apart.join(others, (F.col("shingle") == F.col("of")) & fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = store(confirmed(store(pairs, "pairs"), texts, least), "links")
    of = store(components(links.union(more), "a", "b"), "components")

    final = classes.select("k0", "k1", F.col("doc_id").alias("node")).join(of, "node", "left").select("k0", "k1", F.coalesce("component", "node").alias("component"))
    named = rows.where("n_shingles > 0").join(final, ["k0", "k1"], "left").select("doc_id", "n_shingles", "component", "form")
    return named.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", "doc_id", "form")).select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"), "form"
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links from STAGE_LEAST on, rows repeated with id and text once, and the rows without an id."""
    go = near_duplicates(docs, least=STAGE_LEAST).where("NOT kept").select(F.col("doc_id").alias("go"), F.col("form").alias("go_form")).distinct()
    go = store(go, "go")
    with_id = docs.where(F.col("doc_id").isNotNull())
    free = "_" * (1 + max(len(c) for c in docs.columns))  # a name that no column has
    hit = by_slot(with_id, "doc_id", repeats(with_id, go), "id", "left_semi").withColumn(free, F.xxhash64("text"))
    stay = hit.join(go.toDF(free + "i", free + "f"), (F.col("doc_id").cast("bigint") == F.col(free + "i")) & (F.col(free) == F.col(free + "f")), "left_anti")
    miss = by_slot(with_id, "doc_id", repeats(with_id, go), "id", "left_anti")
    return miss.union(stay.dropDuplicates(["doc_id", free]).select(*docs.columns)).union(docs.where(F.col("doc_id").isNull()))


def repeats(docs: DataFrame, go: DataFrame) -> DataFrame:
    """Ids that are looked at one by one: those of documents that go, and those of several rows."""
    several = docs.groupBy(F.col("doc_id").cast("bigint").alias("id")).count().where("count > 1").select("id")
    return go.select(F.col("go").alias("id")).union(several)
