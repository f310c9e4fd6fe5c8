"""Continuous ingest: new files become chunks once, whatever restarts in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import chunks, is_hidden, kind_of
from ..functions import text as tx
from ..sources.files import append_new

FILES = "path string, sha256 string, text string"


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of file tables (path, sha256, text) that land in a folder as Parquet."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def to_chunks(files: DataFrame, size: int, overlap: int) -> DataFrame:
    """The stateless part of ingest: rows in, rows out, for a stream as for a table."""
    kept = files.where(~is_hidden(F.col("path")) & (kind_of(F.col("path")) == "document"))
    rows = kept.select(F.col("path").alias("source"), F.col("sha256").alias("source_sha256"), tx.redact(F.col("text")).alias("text"))
    return chunks(rows, size, overlap).withColumn("compartment", tx.compartment_of(F.col("source")))


def ingest_stream(files: DataFrame, out: str, checkpoint: str, size: int = 2400, overlap: int = 240) -> StreamingQuery:
    """Appends chunks of contents that ``out`` doesn't have. Within a batch the first path of
    equal contents is kept; across batches the table itself says what is there, so a batch
    that runs again after a failure adds nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        first = batch.groupBy("sha256").agg(F.min(F.struct("path", "text")).alias("f")).select("f.path", "sha256", "f.text")
        append_new(to_chunks(first, size, overlap), out, "source_sha256")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
