"""Token counts of whole texts under a byte-level tokenizer file, without ids.

The library's pre-tokenizer never joins what stands on both sides of a change from a non-space to white space, but for one blank
before a word. So a text falls into units (a word with its blank, or white space alone), which are encoded alone to the same
pieces as in the text. Strings of added tokens are cut out first and count one each, as the library does by default.

1. units of all texts are counted by task and summed by Spark; every distinct unit is encoded once: (unit, pieces).
2. per document, unit frequencies are taken again; those of the FREQUENT commonest units (a bounded table, broadcast) are
   summed in place; the rest leave as (row, unit, times), join the table of pieces by the unit, and are summed by row.

Null texts are empty and have no tokens; repeated rows give repeated results; a null id is passed through.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from functools import cached_property
from typing import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stressloom.llm.staging import commonest, mapped, partition_number, small_batches, store

#: Entries of the broadcast table: about 5 MB, whatever the corpus.
FREQUENT = 1 << 17
#: Distinct units that a task holds before it passes its counts on.
HELD = 1 << 17

_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Splitter:
    """Units of texts for one tokenizer file; made once in each task."""

    def __init__(self, path: str):
        self.path = path
        with open(path) as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or made.get("normalizer"):
            raise ValueError("units need a byte-level tokenizer without a prefix blank and without a normalizer")
        added = made.get("added_tokens") or []
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
            raise ValueError("added tokens that look at their neighbours are not supported")
        strings = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, strings))) if strings else None

    def units(self, text: str) -> tuple[int, list[str]]:
        """Added tokens, and the units of what stands between them."""
        if self.added is None or not self.added.search(text):
            return 0, UNIT.findall(text)
        parts = self.added.split(text)
        return len(parts) - 1, [u for p in parts for u in UNIT.findall(p)]

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        return made

    def pieces(self, units: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]


def slices(names: list[str], *columns: pa.Array) -> Iterator[pa.RecordBatch]:
    """In batches that the JVM side holds at ease."""
    whole = pa.RecordBatch.from_arrays(list(columns), names)
    for i in range(0, len(whole), 1 << 14):
        yield whole.slice(i, 1 << 14)


def distinct_units(texts: DataFrame, path: str) -> DataFrame:
    """(unit, times) over all texts."""

    def count(batches):
        cut, seen = Splitter(path), Counter()
        for b in batches:
            for t in b.column("text"):
                seen.update(cut.units(t.as_py())[1])
                if len(seen) > HELD:
                    yield from slices(["unit", "times"], pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()))
                    seen.clear()
        yield from slices(["unit", "times"], pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()))

    return mapped(texts.select("text"), count, "unit string, times bigint").groupBy("unit").agg(F.sum("times").alias("times"))


def piece_table(units: DataFrame, path: str) -> DataFrame:
    """(unit, times, pieces): every distinct unit encoded once."""

    def encode(batches):
        cut = Splitter(path)
        for b in batches:
            pieces = [n for i in range(0, len(b), 1024) for n in cut.pieces(b.column("unit").slice(i, 1024).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("unit"), b.column("times"), pa.array(pieces, pa.int32())], ["unit", "times", "pieces"])

    return mapped(units, encode, "unit string, times bigint, pieces int")


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = store(piece_table(distinct_units(texts, path), path), "pieces")
    top = commonest(table, frequent, "unit", "pieces")
    common = dict(zip(top.column("unit").to_pylist(), top.column("pieces").to_pylist()))
    known = spark.sparkContext.broadcast(common)

    def take(batches):
        cut, at, common = Splitter(path), partition_number() << 33, known.value
        for b in batches:
            sure, rare, times = [], [], []
            for t in b.column("text"):
                total, units = cut.units(t.as_py())
                left = []
                for u, n in Counter(units).items():
                    p = common.get(u)
                    if p is None:
                        left.append((u, n))
                    else:
                        total += p * n
                sure.append(total)
                rare.append([u for u, _ in left])
                times.append([n for _, n in left])
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(at, at + len(b)), pa.int64()), b.column("doc_id"), pc.binary_length(b.column("text")).cast(pa.int64()), pa.array(sure, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))],
                ["row", "doc_id", "n_bytes", "sure", "rare", "times"],
            )
            at += len(b)

    rows = store(mapped(texts, take, "row bigint, doc_id bigint, n_bytes bigint, sure bigint, rare array<string>, times array<int>"), "units", "snappy")
    rest = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("u")).select("row", F.col("u.rare").alias("unit"), F.col("u.times").alias("n"))
    sums = rest.join(table.select("unit", "pieces"), "unit").groupBy("row").agg(F.sum(F.col("n").cast("long") * F.col("pieces")).alias("more"))
    return rows.select("row", "doc_id", "n_bytes", "sure").join(sums, "row", "left").select(
        "doc_id", "n_bytes", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("n_tokens")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)
