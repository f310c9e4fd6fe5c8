"""Features by blocks of texts equal those by rows, on odd texts and odd names too."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_profiles import plan_of

from marlstone.functions import text as tx
from marlstone.operators import bags, index, profiles

ODD = ["", None, "a", "a b", "ab cd", "abc_de f", "naïve Straße ÉCOLE x-y_z 1.5", "𝔘𝔫 𝔦 😀 x", "the the the the", "???", "x" * 30, "abcd abcd_abcd abcd", "中文 字符 测试文本"]


def odd_docs(spark):
    r = random.Random(3)
    texts = ODD + [" ".join(r.choices([f"w{i}" for i in range(30)] + ["é", "中", "a_b"], k=r.randint(1, 40))) for _ in range(60)]
    rows = [(i, t, r.choice(["x", "y", "z", None])) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "row long, text string, skill string")


def test_counts(spark, monkeypatch):
    docs = odd_docs(spark).unionByName(odd_docs(spark).where("row % 5 = 0"))
    got = sorted(map(tuple, bags.counts(docs, "row").collect()))
    assert got == sorted(map(tuple, index.term_counts(docs, "row", "text", tx.features).collect())) and len(got) > 1000
    flats = pa.array([r[0] for r in docs.select(bags.flat(F.col("text"))).collect()])
    whole = bags.Bag(flats, np.arange(len(flats)))
    monkeypatch.setattr(bags, "PIECE", 50)
    parts = bags.Bag(flats, np.arange(len(flats)))
    assert (whole.keys == parts.keys).all() and (whole.tf == parts.tf).all() and whole.strings(np.arange(len(whole.keys))) == parts.strings(np.arange(len(whole.keys)))


def test_packing():
    r = np.random.default_rng(1)
    for keys in (r.integers(0, 1 << 63, 5), r.integers(0, 1 << 40, 500), np.array([7])):
        keys = np.unique(keys.astype(np.uint64) * np.uint64(2) + np.uint64(1))
        assert (bags._numbers(bags._planes(keys % np.uint64(1 << 31))) == keys % np.uint64(1 << 31)).all()
    values = np.array([0, 3, 255, 254, 1 << 40])
    assert (bags._large(bags._small(values), 5) == values).all()
    near = np.array([5, 4, 5, 1 << 60, (1 << 60) - 1, 5], np.uint64)
    assert (near[bags._order(near)] == np.sort(near)).all()


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("cells", [1 << 23, 0])
def test_centroids_by_blocks_equal_those_by_rows(spark, monkeypatch, odd, cells):
    monkeypatch.setattr(bags, "BLOCK", 300)  # several blocks a label
    monkeypatch.setattr(bags, "BUCKET", 500)
    monkeypatch.setattr(bags, "CELLS", cells)
    docs = odd_docs(spark)
    if odd:  # rows of one name, in several labels, and without a name
        docs = docs.unionByName(docs.where("row % 6 = 0").withColumn("skill", F.lit("y"))).unionByName(docs.where("row % 7 = 0").withColumn("row", F.lit(None).cast("long")))
    n = docs.count()
    counts = index.term_counts(docs, "row", "text", tx.features)
    idf = index.plain_idf(counts, n)
    sizes = docs.groupBy("skill").agg(F.count("*").alias("n"))
    means = index.weights(counts, idf).join(docs.select("row", "skill"), "row").groupBy("skill", "term").agg(F.sum("weight").alias("s")).join(sizes, "skill").withColumn("m", F.col("s") / F.col("n"))
    norms = means.groupBy("skill").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    want = means.join(norms, "skill").select("skill", "term", (F.col("m") / F.col("norm")).alias("weight"))
    rows = lambda df: {(r[0], r[1]): round(r[2], 9) for r in df.collect()}
    cents, got = profiles.centroids(docs, "skill")
    assert rows(cents) == rows(want) and len(rows(want)) > 500
    assert rows(got.select("term", "df", "idf")) == rows(idf.select("term", "df", "idf"))
    sims = rows(profiles.similarities(cents, "skill"))
    assert sims == rows(profiles.similarities(cents, "skill", together=True))
    monkeypatch.setattr(profiles, "DENSE", 0)
    assert sims == rows(profiles.similarities(cents, "skill")) and len(sims) == 3
    spark.catalog.clearCache()


def test_no_row_is_made_for_a_feature_of_a_text(spark):
    docs = odd_docs(spark)
    cents, idf = profiles.centroids(docs, "skill")
    scores = profiles.route_scores(docs.select(F.col("row").alias("rid"), "text"), cents, idf)
    for df in (cents, scores):
        assert "Arrow" in plan_of(df) and "Generate explode(transform" not in plan_of(df) and "Generate explode(get(transform" not in plan_of(df)
    # Both looks at the terms read one shuffle of them.
    spark.catalog.clearCache()
    summed = bags.sums(docs, "skill", 2, docs.count())
    summed.collect()
    assert "ReusedExchange" in plan_of(summed)
