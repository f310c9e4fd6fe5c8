"""From files or text tables to chunks: scan, classify, deduplicate, redact, cut, label."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as tx

# File types.
DOCUMENT_TYPES = ("txt", "md", "rst", "csv", "log", "html", "htm", "pdf", "docx", "pptx", "xlsx")
IMAGE_TYPES = ("png", "jpg", "jpeg", "webp", "gif", "bmp", "tiff")
SIZE, OVERLAP = 2400, 240


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def kind_of(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*DOCUMENT_TYPES), "document").when(ext.isin(*IMAGE_TYPES), "image").otherwise("other")


def is_hidden(path: Column) -> Column:
    """Whether a part of the relative path starts with a dot."""
    return path.rlike(r"(^|/)\.")


def manifest(files: DataFrame, vision: bool = False, scope: str = "corpus") -> DataFrame:
    """(path, kind, status, reason, sha256 and the rest) of files with (path, sha256): the
    first path of equal contents is kept, others are duplicates. Scope ``compartment`` looks
    for duplicates within a compartment only. An ``error`` column, if any, marks failures."""
    files = files.where(~is_hidden(F.col("path")))
    keys = ["sha256"] + (["_scope"] if scope == "compartment" else [])
    df = files.withColumn("kind", kind_of(F.col("path"))).withColumn("_scope", tx.compartment_of(F.col("path")))
    readable = (F.col("kind") == "document") | ((F.col("kind") == "image") & F.lit(vision))
    # Counting first paths is a partial aggregate; a window would sort whole groups of copies.
    first = df.where(readable).groupBy(*keys).agg(F.min("path").alias("_first"))
    df = df.join(first, keys, "left")
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    status = (
        F.when(F.col("kind") == "other", "skipped")
        .when((F.col("kind") == "image") & F.lit(not vision), "skipped")
        .when(F.col("path") != F.col("_first"), "duplicate")
        .when(error.isNotNull(), "error")
        .otherwise("ok")
    )
    reason = F.when(F.col("kind") == "other", "unsupported file type").when((F.col("kind") == "image") & F.lit(not vision), "no vision function").when(F.col("path") != F.col("_first"), F.concat(F.lit("same content as "), F.col("_first"))).otherwise(error)
    return df.withColumns({"status": status, "reason": reason}).drop("_first", "_scope")


def summary(manifest_rows: DataFrame) -> DataFrame:
    return manifest_rows.groupBy("status", "kind").agg(F.count("*").alias("n"))


def normalised(text: Column) -> Column:
    """Spaces and tabs as one space, at most one empty line, trimmed: what cuts refer to."""
    flat = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(flat, r"(?U)^[\s\x1c-\x1f]++|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++$", "")


def cut_text(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """Windows of ``size``, each ending after a paragraph or sentence where one ends in its
    second half, and beginning ``overlap`` before the end of the one before."""
    out, begin, n = [], 0, len(text)
    while begin < n:
        stop = min(begin + size, n)
        if stop < n:
            found = max(text.rfind("\n\n", begin, stop), text.rfind(". ", begin, stop)) - begin
            if found > size // 2:
                stop = begin + found + 1
        if piece := text[begin:stop].strip():
            out.append((begin, piece))
        if stop == n:
            break
        begin = stop - overlap
    return out


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """A row for each chunk: the other columns, id, start_char (in the normalised text), text.

    Each cut depends on the one before, so this runs as an Arrow function over rows; nothing
    is shuffled. An overlap of more than half the size could step backwards and is refused.
    """
    if not 0 <= overlap <= size // 2:
        raise ValueError("the overlap must be at most half of the chunk size")
    pieces_type = T.ArrayType(T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("text", T.StringType())]))

    @F.pandas_udf(pieces_type)
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: [{"start_char": a, "text": p} for a, p in cut_text(t, size, overlap)] if t else [])

    rest = [c for c in docs.columns if c not in (text, "id", "start_char")]
    cut = docs.select(*rest, F.explode(pieces(normalised(F.col(text)))).alias("_p"))
    return cut.select(*rest, tx.content_id(F.col("_p.text")).alias("id"), F.col("_p.start_char").alias("start_char"), F.col("_p.text").alias(text))


def ingest(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP, redact: bool = True, vision: bool = False, scope: str = "corpus") -> tuple[DataFrame, DataFrame]:
    """(chunks, manifest) of files with (path, sha256, text); chunks carry their source,
    compartment and kind."""
    rows = manifest(files, vision, scope)
    kept = rows.where(F.col("status") == "ok").select(F.col("path").alias("source"), F.col("sha256").alias("source_sha256"), "kind", (tx.redact(F.col("text")) if redact else F.col("text")).alias("text"))
    out = chunks(kept, size, overlap).withColumn("compartment", tx.compartment_of(F.col("source")))
    return out, rows.drop("text")


def new_only(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What a resumed run still has to do; repeated keys once."""
    return rows.dropDuplicates([key]).join(done.select(key).distinct(), key, "left_anti")


def stride_sample(rows: DataFrame, most: int, order: str) -> DataFrame:
    """Every n-th row in order, at most ``most`` of them. Ranks come from range partitions
    (each knows how many rows lie before it), so no task sorts the whole table."""
    total = rows.count()
    step = max(1, -(-total // most))
    ranked = with_ranks(rows, order)
    return ranked.where((F.col("_rank") % step) == 0).drop("_rank")


def with_ranks(rows: DataFrame, *order: str) -> DataFrame:
    """``_rank`` from 0 by the order, globally, without a window over all rows."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ids of a partition count up from a multiple of 2^33.
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_mono", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_mono", 33)).persist()
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, offsets = 0, {}
    for part in sorted(sizes):
        offsets[part], before = before, before + sizes[part]
    if not offsets:
        return rows.withColumn("_rank", F.lit(0).cast("long"))
    first = F.create_map(*[F.lit(x).cast("long") for kv in offsets.items() for x in kv])
    return placed.withColumn("_rank", first[F.col("_part")] + F.col("_mono") - F.shiftleft("_part", 33)).drop("_part", "_mono")


def hash_sample(rows: DataFrame, group: str, key: str, samples: int, seed: int = 0) -> DataFrame:
    """``samples`` rows of each group, by a hash of seed and key; ``_n`` from 1."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    order = Window.partitionBy(group).orderBy("_h", key)
    return rows.withColumn("_h", h).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= samples).drop("_h")


def require_labels(rows: DataFrame, default: str | None = None, column: str = "compartment") -> DataFrame:
    """Rows without a label are an error unless a default is named; never silently public."""
    if default is not None:
        return rows.withColumn(column, F.coalesce(column, F.lit(default)))
    return rows.withColumn(column, F.coalesce(column, F.raise_error(F.lit(f"a row has no {column}; name a default to accept that"))))


def flat_name(path: Column) -> Column:
    """a/b/c as a__b__c."""
    return F.array_join(F.split(path, "/"), "__")


def left_out(files: DataFrame, most: int = 8) -> DataFrame:
    """Extensions of unsupported files, the most frequent first: a report of ``most`` rows."""
    rows = files.where(kind_of(F.col("path")) == "other").groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "ext").limit(most)
