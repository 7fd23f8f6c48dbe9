"""Shared plumbing of the training-data operators: tables, shared storage, fold tests."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a private one where that is unset and all runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tagloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Paths of tables written since settled() began, innermost last.
_WRITTEN: list[list[str]] = []


def settled(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What make() returns, written; the tables that were written on the way are deleted, so their disk is free again."""
    _WRITTEN.append([])
    try:
        df = make()
        spark = df.sparkSession
        path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.option("compression", "snappy").parquet(path)
        schema = df.schema
    finally:
        gone = _WRITTEN.pop()
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    for p in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return spark.read.schema(schema).parquet(path)


def materialise(df: DataFrame, tag: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder, with these options of the writer, and read it again.

    Cuts the lineage: later stages survive the loss of any executor, and work that feeds several branches is done once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    df.write.options(**{"compression": "snappy"} | (options or {})).parquet(path)  # zstd's native buffers add up over many small files
    return spark.read.schema(schema).parquet(path)


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, Callable[[], None]]:
    """The same, and a function that deletes the table once nothing reads it any more. The shuffles behind it go at once."""
    spark = df.sparkSession
    path, schema = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", df.schema
    with spent_shuffles(spark):
        df.write.option("compression", "snappy").parquet(path)

    def drop() -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return spark.read.schema(schema).parquet(path), drop


@contextlib.contextmanager
def spent_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile are removed with the end of each write, not when the driver next collects garbage."""
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These settings of the session meanwhile."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the decimal id, modulo `parts`."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % parts


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, those of smallest hash of the key: the same ones however the table is partitioned.

    A bound on the hash, from the number of rows, keeps all but about twice as many from being sorted at all.
    """
    n, space = df.count(), 1 << 30
    h = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(space))
    near = df.where(h < int(space * 2 * rows / n)) if n > 4 * rows else df
    return near.orderBy(h, F.col(key)).limit(rows)


def give_back() -> None:
    """Return freed memory to the system: workers live on, and the next step's tasks start beside a full heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over batches, giving memory back at the end of each task."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return through


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, or those of a binary one, end to end, and the rows' n + 1 offsets in them; nulls are empty."""
    binary = pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)
    col = col.cast(pa.large_binary() if binary else pa.large_string())
    col = col.fill_null(b"" if binary else "") if col.null_count else col
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text_column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many rows and, but for single longer rows, so many bytes of text."""
    _, offs = text_buffers(batch.column(text_column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offs, offs[at] + size, "right")) - 1
        end = min(max(end, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def bits_for(keys: DataFrame) -> int:
    """Size of a bit map of these rows: 16 bits or more a row, within 128 KB and 32 MB. Beyond that it sorts out less, but loses nothing."""
    return 1 << min(max((16 * keys.count()).bit_length(), 20), 28)


def bit_of(key: Column, bits: int) -> Column:
    """The place of a key in a bit map of fixed size."""
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bit_rows(keys: DataFrame, key: str, bits: int, placed: bool = False) -> DataFrame:
    """at, bits: a map in which the bit of each key is set, in parts of 4 KB; bits / 32768 rows at most. placed: keys are places in the map."""
    b = (F.col(key).cast("long") if placed else bit_of(F.col(key), bits)) + 1
    return keys.select(b.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))


def bit_array(keys: DataFrame, key: str, bits: int, placed: bool = False) -> np.ndarray:
    """The same map as an array of bytes: `bits` bits, whatever the number of keys."""
    held = np.zeros(bits // 8 + 4096, np.uint8)
    for p in bit_rows(keys, key, bits, placed).collect():  # bits / 8 bytes
        x = np.frombuffer(bytes(p.bits), np.uint8)
        held[(p["at"] - 1) * 4096 :][: len(x)] = x
    return held


def has_bit(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, name: str, bits: int) -> DataFrame:
    """df with a column `maybe`: false only where the key is none of `keys`. Sends a map of fixed size to the executors."""
    at = bit_of(key, bits)
    rows = F.broadcast(bit_rows(keys, name, bits).withColumnsRenamed({"at": "__at", "bits": "__bits"}))
    byte = F.conv(F.hex(F.substring("__bits", (F.pmod(at, F.lit(32768)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
    met = df.join(rows, (F.floor(at / 32768) + 1) == F.col("__at"), "left")
    return met.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("__at", "__bits")
