"""Helpers shared by the corpus operators: scratch tables, word hashing, shingles."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters; bytes.split() cuts at the same ones.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SHINGLE_WORDS = 5
TEXTS = 1000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session may do without one: it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="trolley-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/trolley/{name}-{uuid.uuid4().hex}"


#: Stored tables of the scopes that are open, innermost last.
_open: list[list[DataFrame]] = []


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """Tables that are stored meanwhile are deleted at the end, but for those stored with keep=True."""
    _open.append([])
    try:
        yield
    finally:
        released(*_open.pop())


def noted(df: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """df, with the path that it is stored at."""
    df.stored_at = path
    if _open and not keep:
        _open[-1].append(df)
    return df


def stored(df: DataFrame, name: str, *order: str, keep: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder, each file in an order, and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    (df.sortWithinPartitions(*order) if order else df).write.option("compression", "zstd").parquet(path)
    return noted(df.sparkSession.read.schema(df.schema).parquet(path), path, keep)


def released(*tables: DataFrame | None) -> None:
    """Deletes stored tables that nothing will read again."""
    for df in tables:
        if df is not None and getattr(df, "stored_at", None):
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Most bits of a filter on keys, so that its broadcast (1/8 of that in bytes) is bounded.
FILTER_BITS = 1 << 27


def filter_bits(rows: int) -> int:
    """16 bits a row as a power of two, FILTER_BITS at most."""
    bits = 1 << 15
    while bits < FILTER_BITS and bits < 16 * rows:
        bits *= 2
    return bits


def filter_blocks(keys: DataFrame, bits: int, *columns: str) -> DataFrame:
    """Bitmap blocks (block, bits) of the hashes of some columns."""
    pos = F.pmod(F.xxhash64(*columns), F.lit(bits)) + 1
    return keys.select(pos.alias("pos")).groupBy(F.bitmap_bucket_number("pos").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("bits"))


def key_filter(keys: DataFrame, *columns: str) -> tuple[DataFrame, int]:
    """(bitmap blocks, bits) of some columns of a table; where FILTER_BITS are too few more rows pass."""
    bits = filter_bits(keys.count())
    return filter_blocks(keys, bits, *columns), bits


def in_filter(df: DataFrame, keys: tuple[DataFrame, int], *columns: str) -> DataFrame:
    """(row, may_be) for each row of df: whether its columns may be among the filter's keys."""
    blocks, bits = keys
    packed = df.select(F.struct(*df.columns).alias("row"), (F.pmod(F.xxhash64(*columns), F.lit(bits)) + 1).alias("pos"))
    at = F.bitmap_bit_position("pos")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = packed.withColumn("block", F.bitmap_bucket_number("pos")).join(F.broadcast(blocks), "block", "left")
    return found.select("row", F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False)).alias("may_be"))


def passing(df: DataFrame, keys: tuple[DataFrame, int], *columns: str) -> DataFrame:
    """The rows whose columns may be in the filter; the join that follows settles it."""
    return in_filter(df, keys, *columns).where("may_be").select("row.*")


def thinned(docs: DataFrame, keys: dict[str, Column], odd: DataFrame) -> DataFrame:
    """docs without the rows whose keys are in odd (the keys, stays); of those with stays=true one row is left, with the least hash
    of all columns. Rows that a filter on odd rules out are not shuffled. All columns stay; null keys are equal.
    """
    blocks = key_filter(odd, *keys)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *[c.alias(k) for k, c in keys.items()])
    marked = in_filter(rows, blocks, *keys)
    maybe = marked.where("may_be").select("row.*")
    of = odd.select(*[F.col(k).alias(f"of_{k}") for k in keys], "stays")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
    one = maybe.join(of.where("stays"), same, "left_semi").groupBy(*keys).agg(
        F.min_by("doc", F.xxhash64(*[F.col("doc")[c] for c in docs.columns])).alias("doc"))
    clean = marked.where("NOT may_be").select("row.doc.*")
    return clean.unionByName(maybe.join(of, same, "left_anti").select("doc.*")).unionByName(one.select("doc.*"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


class Remembered(dict):
    """What has been worked out for words (bytes); forgets everything when it takes more than about `limit` bytes."""

    limit = 32 << 20
    held = 0

    def value(self, word: bytes) -> int:
        raise NotImplementedError

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + 140
        if self.held > self.limit:
            self.forget()
        found = self[word] = self.value(word)
        return found

    def forget(self) -> None:
        self.clear()
        self.held = 0


class WordHash(Remembered):
    """Word to a 64-bit hash."""

    def value(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


_words = WordHash()
_mix = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE_WORDS)], dtype=np.uint64)


def task_memory_released() -> None:
    """To be called at the end of a task: its worker may serve other operators next, and they share an executor's memory."""
    _words.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can give back what is free
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow for whole texts: in batches of TEXTS rows, unless the session says how many; the default of 10,000 rows is for short ones."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_ROWS) == "10000":
        conf.set(_BATCH_ROWS, str(TEXTS))
    return df.mapInArrow(task, schema)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of all runs of five words, in order; fewer words give one run of them all, none gives none."""
    w = word_hashes(words)
    k = min(SHINGLE_WORDS, len(w))
    if not k:
        return w
    n = len(w) - k + 1
    h = np.full(n, np.uint64(k * 0xD6E8FEB86659FD93 & (1 << 64) - 1), dtype=np.uint64)
    for j in range(k):
        h += w[j : j + n] * _mix[j]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def lower_words(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.lower() leaves every other letter alone."""
    return text.lower().split() if text else []


def binary_column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def ranked(df: DataFrame, group: str, order: list[str], largest: int, slice_rows: int = 50_000) -> DataFrame:
    """df with `rank` (long, from 0) of each row in its group.

    A group is ranked in slices by a hash of the ordering columns, so no group is sorted by one task however many
    rows it has; `largest` is the row count of the largest one. Rows alike in all these columns are interchangeable.
    """
    slices = 1 << (largest // slice_rows).bit_length()
    df = df.withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), *order), F.lit(slices)).cast("int"))
    before = df.groupBy(group, "slice").agg(F.count(F.lit(1)).alias("n"))
    before = before.select(
        F.col(group).alias("of"), F.col("slice").alias("of_slice"),
        (F.sum("n").over(Window.partitionBy(group).orderBy("slice")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy(group, "slice").orderBy(*order))
    joined = df.withColumn("inside", inside).join(before, (F.col(group) == F.col("of")) & (F.col("slice") == F.col("of_slice")))
    return joined.withColumn("rank", F.col("before") + F.col("inside") - 1).drop("of", "of_slice", "slice", "before", "inside")
