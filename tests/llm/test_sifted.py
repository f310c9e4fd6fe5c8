"""The Bloom filter that keeps rows out of a shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.llm import common


def test_every_key_may_be_there_and_few_others(spark):
    rows = spark.range(40_000).withColumn("extra", F.lit("x"))
    keys = rows.where("id % 4 = 0").select(F.col("id").alias("k"))
    out = common.sifted(rows, "id", keys)
    assert out.columns == ["id", "extra", "_may"]
    assert out.count() == 40_000
    assert out.where("id % 4 = 0 and _may").count() == 10_000
    assert out.where("id % 4 <> 0 and _may").count() < 300


def test_no_keys_let_nothing_through_and_a_full_filter_everything(spark, monkeypatch):
    rows = spark.range(2_000)
    assert common.sifted(rows, "id", rows.where("false")).where("_may").isEmpty()
    assert common.sifted(rows.where("false"), "id", rows).isEmpty()
    monkeypatch.setattr(common, "FILTER_BLOCKS", 1)
    full = spark.range(10_000, 400_000)
    assert common.sifted(rows, "id", full).where("_may").count() == 2_000


def test_null_keys_and_repeated_keys(spark):
    rows = spark.createDataFrame([(None,), (1,), (1,), (2,)], "k long")
    out = common.sifted(rows, "k", spark.createDataFrame([(1,), (1,)], "k long"))
    assert [r._may for r in out.where("k = 1").collect()] == [True, True]
    assert out.count() == 4
