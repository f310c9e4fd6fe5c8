"""Shared pieces of the training-data operators: shared-folder staging and text expressions."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, and its complement.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch of whole texts, which stands in the executor and in its Python worker.
TEXT_BATCH = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    On one machine, as in tests, a temporary one is set if the session names none; on a
    cluster that would be another folder on every machine, so it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        # The session keeps the value, so one session uses one folder.
        at = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: short lineage, computed once.
    Batches that go to Python meanwhile are of about ``batch_bytes`` at most, if given."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    before = spark.conf.get(_BATCH) if batch_bytes else None
    if batch_bytes:
        spark.conf.set(_BATCH, batch_bytes)
    try:
        df.write.parquet(path)
    finally:
        if batch_bytes:
            spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def staged_path(spark: SparkSession, name: str) -> str:
    """A new place for a table in the shared folder, under one folder for each application."""
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove_staged(spark: SparkSession) -> None:
    """Removes all tables that this application has staged. Results read from them, as most
    operators' are, must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns what this process has freed to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow. Python's workers stay for later tasks, and without this so does
    the memory of their largest one, beside the executor's heap."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def prefix_sums(lengths: Column) -> Column:
    """Sums of all earlier elements, for an array of long: [a, b, c] -> [0, a, a + b].

    Two levels (blocks of about the square root of the length), so a text with very many
    matches costs n^1.5 instead of n^2.
    """
    n = F.size(lengths)
    block = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    totals = F.transform(blocks, lambda b: F.aggregate(F.slice(lengths, b * block + 1, block), zero, add))
    before = F.transform(blocks, lambda b: F.aggregate(F.slice(totals, 1, b), zero, add))
    return F.transform(
        lengths,
        lambda _, i: F.get(before, F.floor(i / block).cast("int"))
        + F.aggregate(F.slice(lengths, (F.floor(i / block) * block).cast("int") + 1, (i - F.floor(i / block) * block).cast("int")), zero, add),
    )


def sealed(df: DataFrame) -> DataFrame:
    """The same rows behind a one-element generator, through which no later filter is pushed:
    array expressions below are then computed once a row, not once in every lambda."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("_sealed")).select("_sealed.*")


#: Blocks of a Bloom filter, of 32,768 bits each: 4 MB in all, however many keys it holds.
FILTER_BLOCKS, FILTER_BITS = 1024, 32768


def _bits_of(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(FILTER_BITS)) for k in range(3)]


def _block_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(FILTER_BLOCKS)).cast("int")


def sifted(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` and ``_may``: false only if ``key`` is not in the one column of ``keys``.

    A blocked Bloom filter, at most FILTER_BLOCKS rows of 4 KB in a broadcast, so rows that a
    join would drop needn't be shuffled for it. With more keys than it is made for, some
    millions, it lets more rows through and nothing else changes.
    """
    (name,) = keys.columns
    bits = keys.select(_block_of(F.col(name)).alias("_block"), F.explode(F.array(*_bits_of(F.col(name)))).alias("_bit"))
    blocks = staged(bits.repartition("_block").groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "filter")
    joined = rows.withColumn("_block", _block_of(F.col(key))).join(F.broadcast(blocks), "_block", "left")
    may = F.col("_bits").isNotNull()
    for bit in _bits_of(F.col(key)):
        byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
        may = may & (byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0)
    return joined.withColumn("_may", F.coalesce(may, F.lit(False))).drop("_block", "_bits")
