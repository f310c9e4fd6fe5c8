"""The training-data pipeline over documents: five stages, each written as Parquet and reread.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all
but the last return the columns of documents, and any others that the input has, whatever
their names. Nulls may stand in every column; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import best_fit_packing, language_filters, mixing, pii_feistel, simhash_pigeonhole
from marlstone.llm.common import documents, sifted, staged

#: A document goes if its language contains less than this share of its n-grams.
LEAST_KNOWN = 0.3


def _apart(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns in one, ``_row``, so that no name can clash with those of a stage."""
    return docs.select(F.struct(F.lit(0).alias("_"), *docs.columns).alias("_row"), *more)


def _whole(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some with new values."""
    return rows.select(*(changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what has no language: null texts, texts without letters, and those whose best
    language contains too few of their n-grams. A missing label is filled in. If no row has a
    label there is nothing to learn from and all documents go."""
    filters = language_filters.fit(docs.where(~language_filters.held_out()))
    # Texts go to Python and back once: the row beside them has none.
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("_row"), F.col("text"))
    found = language_filters.identify(rows, filters)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("known_share") >= LEAST_KNOWN))
    return _whole(kept, docs, text=F.col("text"), lang=F.coalesce(F.col("_row")["lang"], F.col("lang_pred")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that are equal, or linked by near copies:
    a Jaccard similarity of 0.8 on five-word shingles decides, for all pairs. Of a
    group stays the text with the smallest id, once for that id. Rows are judged by their
    text: different texts under one id, or without one, are different documents; one without
    an id goes if a similar one has an id. Repeated rows stay once."""
    found = staged(simhash_pigeonhole.similar_texts(docs), "components")
    node = simhash_pigeonhole.node_of()
    rows = docs.groupBy(node.alias("node")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    texts = staged(rows.join(found, "node", "left").where("n > 1 or component is not null"), "copied")
    # A text without an id comes last.
    order = F.struct(F.col("first").isNull(), "first", "node")
    least = texts.where("component is not null").groupBy("component").agg(F.min(order).alias("least"))
    stays = F.coalesce(F.col("node") == F.col("least.node"), F.lit(True))
    marked = staged(texts.join(least, "component", "left").select(F.col("node").alias("_node"), F.col("first").alias("_first"), "n", stays.alias("_stays")), "marked")
    # Only rows whose text may be marked are shuffled.
    rows = sifted(_apart(docs, F.col("doc_id").alias("_id"), node.alias("_node")), "_node", marked.select("_node"))
    alone = rows.where("not _may").select("_row")
    sorted_out = rows.where("_may").join(marked, "_node", "left").where("_stays is null or (_stays and _id <=> _first)")
    # A text of one row is what it is; of several rows with the smallest id the first stays.
    one = sorted_out.where("n is null or n = 1").select("_row")
    several = sorted_out.where("n > 1").groupBy("_node").agg(F.min_by("_row", F.xxhash64(F.col("_row").cast("string"))).alias("_row")).select("_row")
    return _whole(alone.unionByName(one).unionByName(several), docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites texts, and ``n_chars`` by as much as the text's length has changed."""
    out = pii_feistel.pseudonymise(_apart(docs, F.col("text")))
    grown = F.coalesce(F.length("text") - F.length(F.col("_row")["text"]), F.lit(0))
    changed = {"text": F.col("text"), "n_chars": F.col("_row")["n_chars"] + grown}
    return _whole(out, docs, **changed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that several epochs take has a row for each."""
    return mixing.mix(docs, mixing.levels_of_documents()).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(docs, best_fit_packing.default_tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("pii", pseudonymise),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has neither the n-gram filters nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
