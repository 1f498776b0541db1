"""What the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups that hold over one in so many rows are joined by broadcast; there can't be more than that many.
HOT = 1000


#: Rows and bytes of an Arrow batch; texts are long, and a worker holds several copies of a batch.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches, where they are Spark's own."""
    for key, (default, ours) in BATCH.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)


def give_back() -> None:
    """Returns freed memory to the system, where its C library can; else a worker keeps the most that any of its tasks took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of batches, that gives memory back when it ends: workers live on, and later stages share an executor with what they hold."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Joins each row to its group (unique by ``keys``, not null).

    Groups of more than ``total / HOT`` rows are fewer than ``HOT``, whatever
    the data; they are broadcast, so that none of their rows is shuffled. The
    others are joined by shuffling, where no key is hot any more.
    """
    least = max(total // HOT, 1)
    hot, rest = groups.where(F.col(size) > least), groups.where(F.col(size) <= least)
    marked = rows.join(F.broadcast(hot.select(*keys, F.struct(*[c for c in groups.columns if c not in keys]).alias("_hot"))), keys, "left")
    extra = [c for c in groups.columns if c not in keys]
    cold = marked.where("_hot is null").drop("_hot").join(rest, keys, how)
    return marked.where("_hot is not null").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in extra]).unionByName(cold.select(*rows.columns, *extra))


#: A bitmap of ids has at most so many words of 64 bits.
MOST_WORDS = 1 << 20


def marked(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``rows`` with _in: whether ``column`` may be among ``ids`` (one column); false is certain.

    The ids become a bitmap of one hash each, 64 bits an id, but never over
    ``MOST_WORDS`` words, which is what is broadcast. Where there are more ids
    it fills up and tells less.
    """
    n = ids.count()
    words = 64
    while words < n and words < MOST_WORDS:
        words *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(words * 64))
    bits = ids.select(place(F.col(ids.columns[0])).alias("p")).groupBy(F.expr("p div 64").alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("_bits"))
    joined = rows.withColumn("_p", place(F.col(column))).withColumn("_w", F.expr("_p div 64")).join(F.broadcast(bits), "_w", "left")
    return joined.withColumn("_in", F.coalesce(F.expr("shiftright(_bits, cast(_p % 64 as int)) & 1L") == 1, F.lit(False))).drop("_p", "_w", "_bits")


def without(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``rows`` but those whose ``column`` is among ``ids``; only those that may be are shuffled. Null stays."""
    told = marked(rows, column, ids)
    maybe = told.where("_in").drop("_in")
    named = ids.select(F.col(ids.columns[0]).alias("_id")).hint("shuffle_merge")
    return told.where("not _in").drop("_in").unionByName(maybe.join(named, F.col(column) == F.col("_id"), "left_anti"))


def fingerprint(df: DataFrame) -> tuple[Column, Column]:
    """Two hashes of all columns of a row; rows of equal columns have equal ones."""
    plain = [F.col(f.name) if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString() else F.col(f.name).cast("string") for f in df.schema]
    nulls = [F.col(c).isNull() for c in df.columns]  # a hash skips nulls
    return F.xxhash64(*plain, *nulls), F.xxhash64(F.lit(1), *plain, *nulls)


class Smallest:
    """Of a task's rows, those of a smaller order than any row of their id before: few, wherever an id repeats."""

    def __init__(self):
        self.least: dict[int, int] = {}

    def of(self, batch: pa.RecordBatch, key: str, order: str) -> pa.RecordBatch:
        keep = []
        for k, (i, o) in enumerate(zip(batch.column(key).to_pylist(), batch.column(order).to_pylist())):
            if i not in self.least or o < self.least[i]:
                self.least[i] = o
                keep.append(k)
        return batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))


def one_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each ``key`` that has the smallest ``order``."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def held_out(doc_id: str, parts: int, part: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part
