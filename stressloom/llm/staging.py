"""Tables written once to the shared folder and read back."""

from __future__ import annotations

import contextlib
import ctypes
from typing import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stressloom.session import scratch_path


def store(df: DataFrame, name: str, compression: str = "none", rows: int = 0) -> DataFrame:
    """Written to the shared folder: read by several branches, and not made anew when an executor is lost. Tables of hashes and ids do
    not shrink, and codecs keep buffers outside the heap until it is collected; texts are worth it. Where rows are large, a file holds `rows`
    of them at most, since readers take whole files at a time."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Whole texts go to Python in batches of so many rows, which bounds what a worker holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def small_buffers(spark: SparkSession, size: int = 4 << 20) -> None:
    """Rows that are large and of any number go to Python in batches of about so many bytes: each running task has Arrow buffers of a few
    times that size outside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: Hash slots of ids. A set of slots is broadcast whatever the number of ids: it has so many entries at most.
SLOTS = 1 << 20


def by_slot(docs: DataFrame, column: str, ids: DataFrame, id_column: str, how: str) -> DataFrame:
    """Rows of docs whose hash slot is one of those of the ids (left_semi), or none of them (left_anti), without a shuffle of docs. A
    first pass before an exact join: the more ids, the less it spares."""
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(SLOTS))
    free = "_" * (1 + max(len(c) for c in docs.columns))  # a name that no column has
    found = ids.select(slot(id_column).alias(free)).distinct()
    return docs.join(F.broadcast(found), slot(column) == F.col(free), how)


def release() -> None:
    """Hand freed memory back to the system. Python workers outlive their tasks and would keep it beside the next ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, with memory released at the end of each task."""

    def run(batches):
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


def partition_number() -> int:
    """Of the running task. A retried task reads the same rows under the same number, so numbers made from it are stable."""
    return TaskContext.get().partitionId()


def commonest(table: DataFrame, most: int, *columns: str) -> pa.Table:
    """The given columns and `times` of all rows with times >= t, for the least t of a fixed scale that leaves `most` rows or fewer."""
    step = F.floor(F.log2("times") * 8)
    least, total = None, 0
    for r in table.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 512 rows
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    found = table.where(step >= least) if least is not None else table.limit(0)
    return found.select(*columns, "times").toArrow()
