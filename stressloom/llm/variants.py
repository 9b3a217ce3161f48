"""Spelling variants: the words of a corpus, those one edit apart, and for each rare word the frequent one it stands for.

1. Runs of letters are counted by task and summed by Spark; words of LENGTH code points or more that occur TIMES times or more remain.
2. Letters are hashed to a few symbols. The alphabet grows with the sixth root of the vocabulary, so that the number of words that share
   a reduced form does not: it is the least power of two whose sixth power is 8 times the vocabulary.
3. The full one-edit neighbourhood of every distinct reduced word (deletions, replacements, insertions of symbols) is generated as 64-bit
   hashes, each by one step from prefix sums, and joined to the reduced vocabulary. Of the two directions of a pair the one to the greater
   hash is kept, and hashes that a map of the vocabulary (of bounded size, broadcast) rules out do not leave the task. Words one edit apart
   have reduced forms at most one edit apart, so no pair is lost.
4. Words of joined reduced forms are verified on their original strings.
5. The form of a word is its near word of largest n (the first in code-point order of equal ones), if that n is FACTOR times its own or
   more. Forms are followed to the last by doubling; n grows by the factor each time, so chains are as long as a logarithm.

Null texts have no words; rows without an id are counted, but none of their runs is altered; rows of one id are altered alike. An empty
table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stressloom.llm.staging import mapped, small_batches, store
from stressloom.llm.text import CRC_SQL, LOWER, UPPER, crc_sql, mix, powers

LETTERS = "A-Za-zÀ-ÿ"
LENGTH, TIMES, FACTOR = 6, 5, 5
#: One of so many (document, run) pairs loses a code point in the query.
NOISE = 199
#: Distinct words that a task holds before it passes its counts on, hashes made at once, and positions of a word at once.
HELD, AT_ONCE, POSITIONS = 1 << 17, 1 << 20, 1 << 12
#: Bits of the map of reduced words: at most 16 MB.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27

_FOLD = {c: c + 32 for c in range(65, 91)}
_CODES = np.random.RandomState(20047).randint(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def folded(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_FOLD)


def altered(doc_id: int | None, word: str, noise: int | None) -> str:
    """The word as it stands in the document; where noise divides the checksum of both, without one code point."""
    if noise and doc_id is not None and (h := zlib.crc32(f"{doc_id}:{word}".encode())) % noise == 0:
        return word[: h % len(word)] + word[h % len(word) + 1 :]
    return word


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, times: int = TIMES, noise: int | None = None) -> DataFrame:
    """(word, n) of words of so many code points and occurrences at least."""
    runs = re.compile(f"[{LETTERS}]{{{length},}}")  # whole runs: a shorter one has no part of this length

    def table(seen):
        words = list(seen)
        whole = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], ["word", "n"])
        for i in range(0, len(whole), 1 << 14):
            yield whole.slice(i, 1 << 14)
        seen.clear()

    def count(batches):
        seen = Counter()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                here = Counter()
                for run, n in Counter(runs.findall(text.as_py() or "")).items():
                    here[folded(run)] += n
                for word, n in here.items():
                    seen[altered(doc_id, word, noise)] += n
                if len(seen) > HELD:
                    yield from table(seen)
        yield from table(seen)

    small_batches(docs.sparkSession)
    found = mapped(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), count, "word string, n bigint")
    return found.where(F.char_length("word") >= length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def symbols_for(words: int) -> int:
    """Size of the reduced alphabet."""
    size = 8
    while size < 64 and size**6 < 8 * words:
        size *= 2
    return size


def symbols(words: list[str], alphabet: int) -> np.ndarray:
    """Symbols of words of one length, a row for each."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return (points % alphabet).reshape(len(words), -1)


def sums(reduced: np.ndarray) -> np.ndarray:
    """Hashes (not mixed) of all prefixes of each row."""
    up, _ = powers(reduced.shape[1] + 2)
    out = np.zeros((len(reduced), reduced.shape[1] + 1), np.uint64)
    np.cumsum(_CODES[reduced] * up[: reduced.shape[1]], axis=1, out=out[:, 1:])
    return out


def neighbourhood(reduced: np.ndarray, prefix: np.ndarray, alphabet: int, begin: int, end: int) -> np.ndarray:
    """Hashes of each row with one symbol deleted, replaced or inserted at the positions begin to end (exclusive; an insertion behind the
    last symbol counts to the last position)."""
    n = reduced.shape[1]
    up, down = powers(n + 2)
    base, code = up[1], _CODES[:alphabet]
    whole, cut = prefix[:, -1:], prefix[:, begin:end]
    deleted = cut + (whole - prefix[:, begin + 1 : end + 1]) * down[1]
    own = _CODES[reduced[:, begin:end]]
    replaced = whole[:, :, None] + (code[None, None, :] - own[:, :, None]) * up[begin:end][None, :, None]
    last = end + (end == n)
    inserted = (prefix[:, begin:last] + (whole - prefix[:, begin:last]) * base)[:, :, None] + code[None, None, :] * up[begin:last][None, :, None]
    m = len(reduced)
    return mix(np.concatenate([deleted, replaced.reshape(m, -1), inserted.reshape(m, -1)], axis=1))


def by_length(words: list[str]) -> Iterator[list[int]]:
    """Indices of words of one length, at most AT_ONCE code points together."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, found in groups.items():
        step = max(1, AT_ONCE // n)
        for i in range(0, len(found), step):
            yield found[i : i + step]


def keyed(words: DataFrame, alphabet: int) -> DataFrame:
    """(word, n, reduced, key): reduced is the text of symbols, key its hash."""

    def run(batches):
        for b in batches:
            texts = b.column("word").to_pylist()
            keys, reduced = np.zeros(len(texts), np.int64), [""] * len(texts)
            for group in by_length(texts):
                rows = symbols([texts[i] for i in group], alphabet)
                keys[group] = mix(sums(rows)[:, -1]).view(np.int64)
                data, n = (rows + 48).astype(np.uint8).tobytes().decode("ascii"), rows.shape[1]
                for j, i in enumerate(group):
                    reduced[i] = data[j * n : (j + 1) * n]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(reduced), pa.array(keys)], ["word", "n", "reduced", "key"])

    return mapped(words.select("word", "n"), run, "word string, n bigint, reduced string, key bigint")


def key_map(forms: DataFrame) -> np.ndarray:
    """A map with the bit of every key set; its size follows the number of keys up to MOST_BITS."""
    bits, keys = LEAST_BITS, forms.count()
    while bits < MOST_BITS and bits < 32 * keys:
        bits *= 2
    slot = F.pmod("key", F.lit(bits))
    rows = forms.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {bits}L) & 63 as int))")).alias("set")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("set").to_numpy().view(np.uint64)
    return out


def near_forms(forms: DataFrame, alphabet: int) -> DataFrame:
    """(a, b): keys of reduced words that are equal or one edit apart, each pair once; few others, by chance."""
    held = forms.sparkSession.sparkContext.broadcast(key_map(forms))

    def run(batches):
        known = held.value
        bits = np.uint64(len(known) * 64 - 1)
        for b in batches:
            texts, keys = b.column("reduced").to_pylist(), b.column("key").to_numpy().view(np.uint64)
            for group in by_length(texts):
                n = len(texts[group[0]])
                width = min(n, POSITIONS)
                step = max(1, AT_ONCE // (width * (2 * alphabet + 1)))
                for i in range(0, len(group), step):
                    part = np.array(group[i : i + step])
                    rows = np.frombuffer("".join(texts[j] for j in part).encode(), np.uint8).reshape(len(part), n) - 48
                    prefix, own = sums(rows), keys[part]
                    for begin in range(0, n, width):
                        found = neighbourhood(rows, prefix, alphabet, begin, min(n, begin + width))
                        slot = found & bits
                        hit = (known[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
                        hit &= found.view(np.int64) > own.view(np.int64)[:, None]
                        at = np.nonzero(hit)
                        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)[at[0]]), pa.array(found.view(np.int64)[at])], ["a", "b"])

    made = mapped(forms.select("reduced", "key"), run, "a bigint, b bigint").distinct()
    keys = forms.select(F.col("key").alias("b")).distinct()
    return made.join(keys, "b", "left_semi").select("a", "b").union(keys.select(F.col("b").alias("a"), "b"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n), both ways, of words exactly one edit apart. words is a stored table (word, n)."""
    alphabet = symbols_for(words.count())
    table = store(keyed(words, alphabet), "reduced")
    pairs = store(near_forms(store(table.select("reduced", "key").distinct(), "forms"), alphabet), "near-forms")
    one = table.select(F.col("key").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a"))
    two = table.select(F.col("key").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b"))
    met = pairs.join(one, "a").join(two, "b").where((F.col("a") != F.col("b")) | (F.col("word_a") < F.col("word_b")))
    found = store(met.where(F.levenshtein("word_a", "word_b", 1) == 1).select("word_a", "n_a", "word_b", "n_b"), "near")
    there = found.select(F.col("word_a").alias("word"), F.col("word_b").alias("other"), F.col("n_b").alias("other_n"))
    return there.union(found.select("word_b", "word_a", "n_a"))


def roots(forms: DataFrame, most: int, factor: int) -> DataFrame:
    """(word, root) of words (word, form): forms followed to the last."""
    now = store(forms.select("word", F.col("form").alias("root")), "forms-followed")
    steps = math.log(max(most, 1), factor)  # a chain has no more links
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("last"))
        now = store(now.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root")), "forms-followed")
    return now


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (word, n)."""
    words = store(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), "other"))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.n") >= factor * F.col("n")
    table = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")
    )
    table = store(table, "formed")
    most = words.agg(F.max("n")).first()[0] or 0
    followed = roots(table.where("form is not null"), most, factor)
    return table.join(followed, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet"), noise=NOISE))


def sql() -> str:
    """The same in DuckDB: near words share a word with one code point deleted, at the same place for replacements."""
    code = "flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))"
    return f"""WITH RECURSIVE {CRC_SQL},
        runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), '{UPPER}', '{LOWER}') AS run FROM documents WHERE text IS NOT NULL) WHERE length(run) >= {LENGTH} GROUP BY 1, 2),
        sums AS (SELECT run, n, CASE WHEN doc_id IS NULL THEN 1 ELSE {crc_sql(code)} END AS h FROM runs CROSS JOIN crc_table),
        met AS (SELECT CASE WHEN h % {NOISE} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM sums),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM met GROUP BY 1 HAVING length(word) >= {LENGTH} AND sum(n) >= {TIMES}),
        less AS (SELECT word, k, substr(word, 1, k) || substr(word, k + 2) AS part FROM (SELECT word, unnest(range(length(word)))::BIGINT AS k FROM words)),
        one AS (SELECT DISTINCT w.word AS a, l.word AS b FROM less l JOIN words w ON w.word = l.part),
        near AS (SELECT a AS word, b AS other FROM one UNION SELECT b, a FROM one UNION SELECT x.word, y.word FROM less x JOIN less y ON x.part = y.part AND x.k = y.k AND x.word <> y.word),
        ranked AS (SELECT near.word, other, w.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS i FROM near JOIN words w ON other = w.word),
        formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {FACTOR} * w.n THEN other END AS form, CASE WHEN other_n >= {FACTOR} * w.n THEN other_n END AS form_n FROM words w LEFT JOIN ranked r ON w.word = r.word AND i = 1),
        chain AS (SELECT word, form AS goal FROM formed WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.goal = f.word WHERE f.form IS NOT NULL),
        ends AS (SELECT word, arg_max(goal, n) AS root FROM chain JOIN (SELECT word AS w2, n FROM words) ON goal = w2 GROUP BY word)
        SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM formed f LEFT JOIN ends e ON f.word = e.word"""
