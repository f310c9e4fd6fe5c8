"""The retrieval index: term weights, hashed vectors, and links through shared rare terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

VERSION = 1
DIM = 512
LINKS = 12
#: Lengths of rows that go to all tasks, at most: about 24 MB, for rows named by numbers.
NORMS = 1_000_000


def term_counts(docs: DataFrame, row: str = "row", text: str = "text", terms: Callable[[Column], Column] = tx.tokens) -> DataFrame:
    """(row, term, tf). Whole texts are dealt out by row; their terms, many times as large, are
    then counted where they are."""
    whole = docs.select(row, text).repartition(F.col(row))
    return whole.select(row, F.explode(terms(F.col(text))).alias("term")).groupBy(row, "term").agg(F.count("*").alias("tf"))


def smooth_idf(counts: DataFrame, n: int, min_df: int = 1) -> DataFrame:
    """(term, df, idf) with idf = ln((n + 1) / (df + 1)) + 1."""
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return df.withColumn("idf", F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1)


def plain_idf(counts: DataFrame, n: int, min_df: int = 2) -> DataFrame:
    """(term, df, idf) with idf = ln(n / df), for min_df <= df < n only."""
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") < n))
    return df.withColumn("idf", F.log(F.lit(float(n)) / F.col("df")))


def raw_weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(row, term, tf, raw): sublinear counts times idf."""
    return counts.join(idf.select("term", "idf"), "term").withColumn("raw", (1 + F.log("tf")) * F.col("idf"))


def lengths(raw: DataFrame, row: str = "row") -> DataFrame:
    """(row, norm), 1 for a row without length."""
    norms = raw.groupBy(row).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return norms.withColumn("norm", F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm")))


def by_row(rows: DataFrame, row: str, n: int | None) -> DataFrame:
    """A table of one number or label for each of n rows, sent to all tasks if there are few:
    joined to weights, it then leaves them where they are."""
    few = n is not None and n <= NORMS and rows.schema[row].dataType.typeName() in ("long", "integer")
    return F.broadcast(rows) if few else rows


def weights(counts: DataFrame, idf: DataFrame, row: str = "row", n: int | None = None) -> DataFrame:
    """(row, term, tf, weight): sublinear counts times idf, each row of unit length; n is the
    number of rows, if it is known."""
    raw = raw_weights(counts, idf)
    return raw.join(by_row(lengths(raw, row), row, n), row).select(row, "term", "tf", (F.col("raw") / F.col("norm")).alias("weight"))


def link_limit(n: int) -> int:
    """The most documents that a term may be in to make a link."""
    return max(4, min(64, int(n * 0.05)))


def links(counts: DataFrame, idf: DataFrame, n: int, top: int = LINKS) -> DataFrame:
    """(src, dst, weight, rank): rows that share terms of 2 to ``link_limit`` documents, by
    the sum of those terms' idf (6 places), the ``top`` best of each.

    A term is in at most 64 rows here, so its pairs are bounded whatever the corpus; pairs
    are made once (a < b), summed, and mirrored after.
    """
    rare = idf.where((F.col("df") >= 2) & (F.col("df") <= link_limit(n))).select("term", "idf")
    kept = counts.join(rare, "term").select("term", "row", "idf")
    grouped = kept.groupBy("term").agg(F.first("idf").alias("idf"), F.sort_array(F.collect_list("row")).alias("rows"))
    half = grouped.select("idf", F.posexplode("rows").alias("i", "a"), "rows").select("idf", "a", F.explode(F.slice("rows", F.col("i") + 2, F.size("rows"))).alias("b"))
    summed = half.groupBy("a", "b").agg(F.round(F.sum("idf"), 6).alias("weight"))
    both = summed.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "weight").select("e.*", "weight")
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def links_of(rows: DataFrame, counts: DataFrame, idf: DataFrame, n: int, top: int = LINKS) -> DataFrame:
    """``links`` of the distinct rows (row) alone: pairs are made only for them."""
    rare = idf.where((F.col("df") >= 2) & (F.col("df") <= link_limit(n))).select("term", "idf")
    kept = counts.join(rare, "term").select("term", "row", "idf")
    src = kept.join(rows, "row", "left_semi").select("term", F.col("row").alias("src"))
    both = src.join(kept.withColumnRenamed("row", "dst"), "term").where("src <> dst")
    summed = both.groupBy("src", "dst").agg(F.round(F.sum("idf"), 6).alias("weight"))
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def hash_vectors(docs: DataFrame, row: str = "row", text: str = "text", dim: int = DIM) -> DataFrame:
    """(row, idx, v): tokens count 1 and neighbours 1/2 at a place and with a sign that a
    hash gives, each row of unit length; sparse, as most places of a text are empty."""
    # Whole texts are dealt out, not places: see term_counts.
    words = docs.select(row, text).repartition(F.col(row)).select(row, tx.tokens(F.col(text)).alias("w"))
    one = lambda items, value: F.transform(items, lambda t: F.struct(t.alias("t"), F.lit(value).alias("v")))
    parts = words.select(row, F.explode(F.concat(one(F.col("w"), 1.0), one(tx.pairs(F.col("w")), 0.5))).alias("x")).select(row, "x.*")
    h = F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 8), 16, 10).cast("long")
    sign = F.when(F.conv(F.substring(F.md5(F.col("t").cast("binary")), 9, 1), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    summed = parts.select(row, (h % dim).cast("int").alias("idx"), (sign * F.col("v")).alias("v")).groupBy(row, "idx").agg(F.sum("v").alias("v")).where("v <> 0")
    norms = summed.groupBy(row).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return summed.join(norms, row).select(row, "idx", (F.col("v") / F.col("norm")).alias("v"))


def blake_vector(text: str, dim: int = DIM) -> list[float]:
    """The same idea by another hash, as a plain function: a drop-in embedder."""
    import hashlib
    import re

    words = re.findall(r"[^\W_]+(?:[-_.][^\W_]+)*", text.lower())
    v = np.zeros(dim, np.float32)
    for value, items in ((1.0, words), (0.5, [f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)])):
        for item in items:
            h = hashlib.blake2b(item.encode(), digest_size=8).digest()
            v[int.from_bytes(h[:4], "little") % dim] += value if h[4] & 1 else -value
    norm = float(np.linalg.norm(v))
    return (v / norm if norm else v).tolist()


def embed(docs: DataFrame, function: Callable[[list[str]], list[list[float]]], text: str = "text", column: str = "vector") -> DataFrame:
    """``docs`` with a vector by a caller's embedder, called with batches of texts."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(function(s.fillna("").tolist()))

    return docs.withColumn(column, run(F.col(text)))


def fingerprint(rows: DataFrame) -> dict[str, int]:
    """Count and order-free hash of a table: what an index remembers of its corpus."""
    h = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 40))
    r = rows.agg(F.count("*").alias("n"), F.sum(h).alias("h")).first()
    return {"n": r["n"], "hash": int(r["h"] or 0)}


@dataclass
class Index:
    """Tables of an index: chunks (row, id, text, source, compartment, kind), terms (term,
    df, idf), postings (row, term, tf, weight), vectors (row, idx, v), links."""

    chunks: DataFrame
    terms: DataFrame
    postings: DataFrame
    vectors: DataFrame
    links: DataFrame
    meta: dict
    #: Links of some rows, if they can be made without all others.
    some_links: Callable[[DataFrame], DataFrame] | None = None

    TABLES = ("chunks", "terms", "postings", "vectors", "links")

    def links_of(self, rows: DataFrame) -> DataFrame:
        """The links of the rows (row) given."""
        rows = rows.select("row").distinct()
        if self.some_links is not None:
            return self.some_links(rows)
        return self.links.join(rows.withColumnRenamed("row", "src"), "src", "left_semi")

    def save(self, path: str) -> None:
        """Four of the tables sorted by what they are joined by; chunks by compartment, so a
        permission prunes directories."""
        spark = self.chunks.sparkSession
        self.chunks.write.mode("overwrite").partitionBy("compartment").parquet(f"{path}/chunks")
        for name, key in (("terms", "term"), ("postings", "term"), ("vectors", "idx"), ("links", "src")):
            getattr(self, name).repartition(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([(k, str(v)) for k, v in self.meta.items()], "k string, v string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, corpus: DataFrame | None = None) -> Index:
        """Refuses another version, and a corpus other than the one that was indexed."""
        meta = {r["k"]: r["v"] for r in spark.read.parquet(f"{path}/meta").collect()}
        if int(meta["version"]) != VERSION:
            raise ValueError(f"index version {meta['version']} is not {VERSION}; build it again")
        if corpus is not None and str(fingerprint(corpus.select("id", "text"))["hash"]) != meta["hash"]:
            raise ValueError("the corpus has changed since the index was built; build it again")
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in cls.TABLES), meta)


def build_index(chunks: DataFrame, top: int = LINKS, dim: int = DIM) -> Index:
    """``chunks`` needs (row, id, text, compartment); source and kind are filled in."""
    for column, default in (("source", ""), ("kind", "document")):
        chunks = chunks.withColumn(column, F.coalesce(column, F.lit(default)) if column in chunks.columns else F.lit(default))
    n = chunks.count()
    counts = term_counts(chunks).persist()
    terms = smooth_idf(counts, n).persist()
    mark = fingerprint(chunks.select("id", "text"))
    meta = {"version": VERSION, "n": n, "dim": dim, "hash": mark["hash"]}
    some = lambda rows: links_of(rows, counts, terms, n, top)
    return Index(chunks, terms, weights(counts, terms, n=n), hash_vectors(chunks, dim=dim), links(counts, terms, n, top), meta, some)
