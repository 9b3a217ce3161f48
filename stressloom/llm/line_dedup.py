"""Repeated lines: winnowing over line hashes.

A line ends at a line break or after a sentence (".", "!" or "?" and a blank), since passages are also pasted into the middle of longer
lines. Its hash is taken over its words (A-Z folded, white space ignored); what holds no word belongs to the line before.

A run is the shortest stretch of lines from a given one that holds RUN words; a gram the shortest that holds GRAM words.
A line is deleted if it lies in a stretch of whole lines with RUN words or more that occurred before, in the order of (doc_id, line).
Of each such stretch the first occurrence stays whole and the later ones go, up to the last line that matches on either side.

1. Of the grams inside each run the one of the least hash is selected. Equal runs select equal grams, so the selected grams
   (fingerprints) of every repeated run occur twice at least: the guarantee of winnowing.
2. Fingerprints are counted by their hash; those that occur once leave.
3. A shared fingerprint is extended both ways: backwards to all runs around it that selected it, forwards by the lines behind a run that
   hold fewer words than its first line. (With more, the run from the next line reaches as far, so no match is lost.) These stretches join
   on their own hash with the first position at which they occur, by a grouped minimum. All others are deleted.

With `extend` the unit is the word in place of the line: a word is deleted if it lies in RUN consecutive words that occurred before, in
the order of (doc_id, word). The union of these windows is the maximal match to both sides, with the half lines at the ends of a
pasted passage and whatever the length of its lines (see repeated_words). The pipeline's stage works so.

A fingerprint with many positions meets its count and its first position only, never the other positions. Null and empty texts and
rows without an id are left as they are; rows of the same id and text are treated alike, as one document.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stressloom.llm.staging import by_slot, mapped, small_batches, store
from stressloom.llm.text import Words, chunks, mix, powers, words

RUN, GRAM = 30, 15

_ENDS = np.zeros(256, bool)
_ENDS[[ord("."), ord("!"), ord("?")]] = True


class Lines(NamedTuple):
    """start: byte position; first: index of each row's first line, with the total at the end; count: words; hashes."""

    start: np.ndarray
    first: np.ndarray
    count: np.ndarray
    hashes: np.ndarray


def _stretch(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash over h[begin:end]."""
    up, down = powers(len(h))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def lines(data: np.ndarray, bounds: np.ndarray) -> Lines:
    w = words(data, bounds)
    data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    if not len(w.hashes):
        none = np.empty(0, np.int64)
        return Lines(none, np.zeros(len(bounds), np.int64), none, np.empty(0, np.uint64))
    begin = np.zeros(len(data) + 1, bool)
    begin[1:] = data == 10
    begin[2:] |= (data[1:] == 32) & _ENDS[data[:-1]]
    begin[bounds] = True
    at = np.flatnonzero(begin)
    raw = np.searchsorted(at, w.starts, "right")
    new = np.flatnonzero(np.diff(raw, prepend=-1))
    first = np.searchsorted(new, w.first)
    start = at[raw[new] - 1]
    some = np.flatnonzero(np.diff(first))
    start[first[some]] = bounds[some]
    end = np.append(new[1:], len(raw))
    return Lines(start, first, end - new, _stretch(w.hashes, new, end))


def selected(x: Lines, run: int = RUN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For every line that starts a run: (line, end of its run, hash of the run, the gram it selects, hash of that gram)."""
    total = np.concatenate([[0], np.cumsum(x.count)])
    n = len(x.count)
    last = np.repeat(x.first[1:], np.diff(x.first))
    run_end, gram_end = (np.searchsorted(total, total[:-1] + size) for size in (run, gram))
    i = np.flatnonzero(run_end <= last)
    g = _stretch(x.hashes, np.arange(n), np.minimum(gram_end, n))
    last_gram = np.searchsorted(gram_end, run_end[i], "right") - 1
    best, least = i.copy(), g[i]
    for step in range(1, int((last_gram - i).max(initial=0)) + 1):
        at = np.minimum(i + step, n - 1)
        less = (i + step <= last_gram) & (g[at] < least)
        best[less], least[less] = at[less], g[at][less]
    return i, run_end[i], _stretch(x.hashes, i, run_end[i]), best, least


def extended(x: Lines, i: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """(run, end of the stretch, its hash): every run, and with it each longer stretch whose further lines hold fewer words than the run's
    first line, by run."""
    total = np.concatenate([[0], np.cumsum(x.count)])
    last = x.first[np.searchsorted(x.first, i, "right")]
    most = np.minimum(last, np.searchsorted(total, total[end] + x.count[i], "left") - 1)
    more = most - end
    k = np.repeat(np.arange(len(i)), more + 1)
    step = np.arange(len(k)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    out, to = h[k], end[k] + step
    out[step > 0] = _stretch(x.hashes, i[k[step > 0]], to[step > 0])
    return k, to, out


def fingerprints(docs: DataFrame, run: int, gram: int) -> DataFrame:
    """(doc_id, form, gram, starts, ends, runs): the stretches around a selected gram, lines counted within the text."""

    def read(batches):
        for b in batches:
            for rows, data, bounds in chunks(b, "text"):
                x = lines(data, bounds)
                i, end, h, best, least = selected(x, run, gram)
                if not len(i):
                    continue
                k, to, h = extended(x, i, end, h)
                new = np.flatnonzero((np.diff(best, prepend=-1) != 0) | (np.diff(i, prepend=-2) != 1))
                row = np.searchsorted(x.first, i[new], "right") - 1
                base = np.repeat(x.first[row], np.diff(np.append(new, len(i))))[k]
                cut, take = pa.array(np.append(np.searchsorted(k, new), len(k)), pa.int32()), pa.array(rows.start + row)
                lists = [pa.ListArray.from_arrays(cut, v) for v in (pa.array(i[k] - base, pa.int32()), pa.array(to - base, pa.int32()), pa.array(h.view(np.int64)))]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(take), b.column("form").take(take), pa.array(least[new].view(np.int64)), *lists],
                    ["doc_id", "form", "gram", "starts", "ends", "runs"],
                )

    return mapped(docs, read, "doc_id bigint, form bigint, gram bigint, starts array<int>, ends array<int>, runs array<bigint>")


def repeated_runs(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """(doc_id, form, cuts array<struct<line, end>>) of documents that hold later occurrences; form is a hash of the text."""
    marks = store(fingerprints(docs, run, gram), "fingerprints")
    # stored, so that the joins are plain ones between two exchanges, whose hot keys Spark can split
    shared = store(marks.groupBy("gram").count().where("count > 1").select("gram"), "shared")
    around = marks.join(shared, "gram").select("doc_id", "form", F.inline(F.arrays_zip(F.col("starts").alias("line"), F.col("ends").alias("end"), F.col("runs").alias("run"))))
    around = store(around.select("run", F.struct("doc_id", "form", "line").alias("place"), "end"), "runs")
    first = store(around.groupBy("run").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first")
    later = around.join(first, "run").where("place != first")
    return later.groupBy("place.doc_id", "place.form").agg(F.collect_list(F.struct("place.line", "end")).alias("cuts"))


def by_word(w: Words) -> Lines:
    """Every word as a line of its own."""
    return Lines(w.starts, w.first, np.ones(len(w.hashes), np.int64), w.hashes)


def blocks(docs: DataFrame, run: int, gram: int) -> DataFrame:
    """(doc_id, form, gram, block, at, n): the n windows of `run` words from word `at` on selected this gram; block is a hash over them."""

    def read(batches):
        for b in batches:
            for rows, data, bounds in chunks(b, "text"):
                x = by_word(words(data, bounds))
                i, end, _, best, least = selected(x, run, gram)
                if not len(i):
                    continue
                new = np.flatnonzero((np.diff(best, prepend=-1) != 0) | (np.diff(i, prepend=-2) != 1))
                last = np.append(new[1:], len(i)) - 1
                row = np.searchsorted(x.first, i[new], "right") - 1
                block = mix(_stretch(x.hashes, i[new], end[last]) + (best[new] - i[new]).astype(np.uint64))
                take = pa.array(rows.start + row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(take), b.column("form").take(take), pa.array(least[new].view(np.int64)), pa.array(block.view(np.int64)), pa.array(i[new] - x.first[row], pa.int32()), pa.array(last - new + 1, pa.int32())],
                    ["doc_id", "form", "gram", "block", "at", "n"],
                )

    return mapped(docs, read, "doc_id bigint, form bigint, gram bigint, block bigint, at int, n int")


def windows(docs: DataFrame, run: int) -> DataFrame:
    """(run, doc_id, form, at) of the windows that `spans` array<struct<at, n>> names in each text."""

    def read(batches):
        for b in batches:
            for rows, data, bounds in chunks(b, "text"):
                w = words(data, bounds)
                for k in range(rows.stop - rows.start):
                    span = b.column("spans")[rows.start + k].values
                    at, n = (span.field(c).to_numpy().astype(np.int64) for c in ("at", "n"))
                    at = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    h = _stretch(w.hashes[w.first[k] : w.first[k + 1]], at, at + run)
                    same = [pa.array(np.full(len(at), b.column(c)[rows.start + k].as_py())) for c in ("doc_id", "form")]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *same, pa.array(at, pa.int32())], ["run", "doc_id", "form", "at"])

    return mapped(docs, read, "run bigint, doc_id bigint, form bigint, at int")


def repeated_words(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """As repeated_runs, with positions of words.

    The windows that one fingerprint selects are a block. Of equal blocks all but the first are later occurrences as a whole, so only the
    first of each takes part further: if its gram has other blocks, its windows meet the first position at which they occur. Copies of
    a passage, however many, so cost one row a fingerprint and not one a word."""
    marks = store(blocks(docs, run, gram), "fingerprints")
    # stored, so that the joins are plain ones between two exchanges, whose hot keys Spark can split
    shared = store(marks.groupBy("gram").count().where("count > 1").select("gram"), "shared")
    held = store(marks.join(shared, "gram").select("gram", "block", F.struct("doc_id", "form", "at").alias("place"), "n"), "held")
    kinds = store(held.groupBy("gram", "block").agg(F.min("place").alias("first"), F.first("n").alias("n"), F.count(F.lit(1)).alias("times")), "blocks")
    copies = held.join(kinds.where("times > 1").select("gram", "block", "first"), ["gram", "block"]).where("place != first")
    several = store(kinds.groupBy("gram").count().where("count > 1").select("gram"), "several")
    spans = kinds.join(several, "gram").groupBy("first.doc_id", "first.form").agg(F.collect_list(F.struct("first.at", "n")).alias("spans"))
    spans = store(spans.toDF("i", "f", "spans"), "spans")
    texts = by_slot(docs, "doc_id", spans, "i", "left_semi").join(spans, (F.col("doc_id") == F.col("i")) & (F.col("form") == F.col("f")))
    around = store(windows(texts.select("doc_id", "form", "text", "spans"), run), "windows").select("run", F.struct("doc_id", "form", "at").alias("place"))
    first = store(around.groupBy("run").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times"), "first")
    later = around.join(first, "run").where("place != first")
    cuts = [x.select("place.doc_id", "place.form", F.struct(F.col("place.at").alias("line"), end.alias("end")).alias("cut")) for x, end in ((copies, F.col("place.at") + F.col("n") - 1 + run), (later, F.col("place.at") + run))]
    return cuts[0].union(cuts[1]).groupBy("doc_id", "form").agg(F.collect_set("cut").alias("cuts"))


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.IntegerType())]))
def _without_words(text: pa.Array, cuts: pa.Array) -> pa.Array:
    out, removed = [], []
    for (data, bounds), cut in zip(chunks_of_one(text), cuts):
        if not cut.is_valid:
            out.append(None)
            removed.append(0)
            continue
        w, line = words(data, bounds), lines(data, bounds).start
        step = np.zeros(len(w.starts) + 1, np.int64)
        np.add.at(step, cut.values.field("line").to_numpy(), 1)
        np.add.at(step, cut.values.field("end").to_numpy(), -1)
        gone = np.cumsum(step[:-1]) > 0
        start = w.starts.copy()  # blanks belong to the word before, those at the beginning to the first
        start[:1] = 0
        end = np.append(start[1:], bounds[1] - bounds[0])
        body = data[bounds[0] : bounds[1]]
        out.append(b"".join(body[a:b].tobytes() for a, b in zip(start[~gone], end[~gone])).decode())
        removed.append(len(np.unique(np.searchsorted(line, start[gone], "right"))))
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(removed, pa.int32())], ["text", "removed"])


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.IntegerType())]))
def _without(text: pa.Array, cuts: pa.Array) -> pa.Array:
    out, removed = [], []
    for row, cut in zip(chunks_of_one(text), cuts):
        if not cut.is_valid:
            out.append(None)
            removed.append(0)
            continue
        data, bounds = row
        x = lines(data, bounds)
        gone = np.zeros(len(x.start), bool)
        for c in cut.as_py():
            gone[c["line"] : c["end"]] = True
        end = np.append(x.start[1:], bounds[1] - bounds[0])
        body = data[bounds[0] : bounds[1]]
        out.append(b"".join(body[a:b].tobytes() for a, b in zip(x.start[~gone], end[~gone])).decode())
        removed.append(int(gone.sum()))
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(removed, pa.int32())], ["text", "removed"])


def chunks_of_one(text: pa.Array):
    for i in range(len(text)):
        (_, data, bounds), = chunks(pa.RecordBatch.from_arrays([text.slice(i, 1)], ["text"]), "text")
        yield data, bounds


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, gram: int = GRAM, extend: bool = False) -> DataFrame:
    """The rows with repeated lines deleted from the text, and `lines_removed`: with `extend`, lines that lost words. All columns stay; a column of that name is replaced."""
    small_batches(docs.sparkSession)
    form = F.xxhash64(F.col(text_col))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), form.alias("form"), F.col(text_col).alias("text"))
    find, without = (repeated_words, _without_words) if extend else (repeated_runs, _without)
    cuts = find(texts.where("doc_id IS NOT NULL AND text IS NOT NULL"), run, gram)
    # names of the joined side that no column of the documents has
    free = "_" * (1 + max(len(c) for c in docs.columns))
    cuts = store(cuts.select(F.col("doc_id").alias(free + "i"), F.col("form").alias(free + "f"), F.col("cuts").alias(free + "c")), "cuts")
    joined = by_slot(docs, id_col, cuts, free + "i", "left_semi").join(cuts, (F.col(id_col).cast("bigint") == F.col(free + "i")) & (form == F.col(free + "f")), "left")
    touched = F.col(free + "c").isNotNull()
    joined = joined.withColumn(free + "r", without(F.when(touched, F.col(text_col)), F.col(free + "c")))
    clean = by_slot(docs, id_col, cuts, free + "i", "left_anti")
    clean = clean.select(*[c for c in docs.columns if c != "lines_removed"], F.lit(0).alias("lines_removed"))
    return clean.union(joined.select(
        *[F.when(touched, F.col(free + "r")["text"]).otherwise(F.col(text_col)).alias(text_col) if c == text_col else F.col(c) for c in docs.columns if c != "lines_removed"],
        F.coalesce(F.col(free + "r")["removed"], F.lit(0)).alias("lines_removed"),
    ))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "text", "lines_removed")


def query_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query with matches extended to both sides."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), extend=True).select("doc_id", "text", "lines_removed")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages, by maximal matches; n_chars follows the text; a document that consisted of repeated lines alone is dropped."""
    found = dedup_lines(docs, extend=True)
    emptied = (F.col("lines_removed") > 0) & (F.col("text") == "")
    n_chars = F.when(F.col("lines_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.where(~emptied).withColumn("n_chars", n_chars).select(*docs.columns)
