"""Planning figures and merges of weight tables, as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import model_size

# Bits per parameter of quantised files.
QUANTS = {"Q8_0": 8.5, "Q6_K": 6.6, "Q5_K_M": 5.7, "Q4_K_M": 4.8, "Q3_K_M": 3.9, "Q2_K": 3.35}
# Name, billions of parameters, billions active for a token, licence.
CATALOGUE = (
    ("Qwen3-0.6B", 0.6, 0.6, "Apache-2.0"),
    ("Qwen3-1.7B", 1.7, 1.7, "Apache-2.0"),
    ("Qwen3-4B", 4.0, 4.0, "Apache-2.0"),
    ("Qwen3-8B", 8.0, 8.0, "Apache-2.0"),
    ("Qwen3-14B", 14.0, 14.0, "Apache-2.0"),
    ("Qwen3-32B", 32.0, 32.0, "Apache-2.0"),
    ("Qwen3-30B-A3B", 30.5, 3.3, "Apache-2.0"),
    ("Qwen3-Next-80B-A3B", 80.0, 3.0, "Apache-2.0"),
    ("Qwen3-235B-A22B", 235.0, 22.0, "Apache-2.0"),
    ("gpt-oss-20b", 21.0, 3.6, "Apache-2.0"),
    ("gpt-oss-120b", 117.0, 5.1, "Apache-2.0"),
    ("Mixtral-8x7B", 46.7, 12.9, "Apache-2.0"),
    ("Mixtral-8x22B", 141.0, 39.0, "Apache-2.0"),
    ("Llama-3.1-8B", 8.0, 8.0, "Llama 3.1 (gated)"),
    ("Llama-3.3-70B", 70.0, 70.0, "Llama 3.3 (gated)"),
    ("DeepSeek-V3", 671.0, 37.0, "DeepSeek (open)"),
)


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOGUE), "name string, total_b double, active_b double, license string")


def vram_gb(params_b: Column, four_bit: Column, batch: Column, length: Column, teacher_b: Column | None = None, teacher_four_bit: Column | None = None) -> Column:
    """Rough memory of a training run: weights, overhead, activations, a frozen teacher."""
    per = lambda flag: F.when(flag, 0.7).otherwise(2.2)
    total = params_b * per(four_bit) + F.greatest(F.lit(0.6), params_b * 0.3) + 0.0004 * batch * length * F.sqrt(params_b)
    if teacher_b is not None:
        total = total + F.coalesce(teacher_b, F.lit(0.0)) * per(F.lit(False) if teacher_four_bit is None else teacher_four_bit)
    return total


def verdict(need: Column, have: Column) -> Column:
    return F.when(need.isNull() | (need <= have * 0.85), "fits").when(need <= have * 1.3, "tight").otherwise("too big")


def training_plan(runs: DataFrame, vram: float) -> DataFrame:
    """Runs (model, four_bit, batch_size, max_len) with their size, need and verdict."""
    size = model_size(F.col("model"))
    need = F.round(vram_gb(size, F.col("four_bit"), F.col("batch_size"), F.col("max_len")), 6)
    return runs.withColumns({"params_b": size, "need_gb": need, "verdict": verdict(need, F.lit(vram))})


def worst(plans: DataFrame) -> DataFrame:
    order = F.array_position(F.lit(["fits", "tight", "too big"]), F.col("verdict"))
    return plans.agg(F.max_by("verdict", order).alias("verdict"))


def decode_speed(models: DataFrame, quant: str, vram: float, ram: float, ram_gbs: float, free_disk: float, least: float = 3.0) -> DataFrame:
    """Models with file size, where the weights would live, tokens a second and whether that
    is usable; the largest usable first."""
    bits = QUANTS[quant]
    size, active = F.col("total_b") * bits / 8, F.col("active_b") * bits / 8
    cached = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(ram * 0.7)) / size)
    in_vram, in_ram = (size < vram * 0.85) & F.lit(vram > 0), size < ram * 0.75
    width = F.when(in_vram, ram_gbs * 4.0).when(in_ram, ram_gbs).otherwise(cached * ram_gbs + (1 - cached) * 2.5)
    where = F.when(in_vram, "VRAM").when(in_ram, "RAM").otherwise(F.concat(F.round(cached * 100).cast("int").cast("string"), F.lit("% cached")))
    out = models.withColumns({"disk_gb": F.round(size, 6), "active_gb": F.round(active, 6), "where": where, "tok_s": F.round(width / active, 6), "sparsity": F.round(F.col("total_b") / F.col("active_b"), 6)})
    usable = (size < free_disk * 0.9) & (F.col("tok_s") >= least)
    return out.withColumn("usable", usable).withColumn("place", F.row_number().over(Window.orderBy(F.desc("usable"), F.desc("total_b"), "name")))


def quantise_teacher(size_b: Column, vram: Column) -> Column:
    return F.coalesce((vram > 0) & (size_b > 0) & (size_b * 2.2 > vram * 0.85), F.lit(False))


def default_rate(model: Column) -> Column:
    size = model_size(model)
    return F.when(size.isNull(), 1e-2).when(size < 2, 5e-3).when(size < 8, 1e-2).otherwise(2e-2)


def dense(factors_a: DataFrame, factors_b: DataFrame, scaling: Column | float = 1.0) -> DataFrame:
    """(part, name, i, j, v) = scaling * B A, from A (part, name, r, j, v) and B
    (part, name, i, r, v)."""
    a = factors_a.withColumnRenamed("v", "va")
    return factors_b.join(a, ["part", "name", "r"]).groupBy("part", "name", "i", "j").agg((F.sum(F.col("v") * F.col("va")) * scaling).alias("v"))


def merge_linear(deltas: DataFrame, weights: DataFrame) -> DataFrame:
    """(name, i, j, v): weighted sums of (part, name, i, j, v)."""
    return deltas.join(weights, "part").groupBy("name", "i", "j").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def trimmed(deltas: DataFrame, density: float) -> DataFrame:
    """Entries at least as large as the k-th largest of their weight, k being a share of its
    entries; ties with the k-th stay. The k-th is found by counting entries by size."""
    if density >= 1:
        return deltas
    key = ["part", "name"]
    sizes = deltas.withColumn("m", F.abs("v")).groupBy(*key, "m").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*key).orderBy(F.desc("m")))
    total = F.sum("c").over(Window.partitionBy(*key))
    least = sizes.withColumns({"upto": upto, "k": F.greatest(F.lit(1), F.floor(total * density))}).where(F.col("upto") - F.col("c") < F.col("k")).groupBy(*key).agg(F.min("m").alias("least"))
    return deltas.join(least, key).where(F.abs("v") >= F.col("least")).drop("least")


def merge_ties(deltas: DataFrame, weights: DataFrame, density: float = 0.2) -> DataFrame:
    """(name, i, j, v): trimmed and weighted entries; the sign of their sum decides, and
    those that agree with it are averaged."""
    w = trimmed(deltas, density).join(weights, "part").select("name", "i", "j", (F.col("v") * F.col("w")).alias("x"))
    # Entries of one cell are one for each part: few, whatever the model's size.
    cells = w.groupBy("name", "i", "j").agg(F.sum("x").alias("s"), F.collect_list("x").alias("xs"))
    kept = F.filter("xs", lambda x: (F.signum(x) == F.signum(F.col("s"))) & (x != 0))
    return cells.select("name", "i", "j", (F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(kept), F.lit(1))).alias("v"))


def merge_dare(deltas: DataFrame, weights: DataFrame, drop: float = 0.9, seed: int = 0) -> DataFrame:
    """(name, i, j, v): entries dropped by a seeded hash, the rest scaled up, weighted sums."""
    if not 0 <= drop < 1:
        raise ValueError("drop must be at least 0 and under 1")
    cell = F.md5(F.concat_ws(":", F.lit(str(seed)), "part", "name", F.col("i").cast("string"), F.col("j").cast("string")).cast("binary"))
    u = F.conv(F.substring(cell, 1, 8), 16, 10).cast("double") / float(1 << 32)
    kept = deltas.withColumn("v", F.when(u >= drop, F.col("v") / (1 - drop)).otherwise(0.0))
    return merge_linear(kept, weights)


def shift_ratio(deltas: DataFrame, base: DataFrame) -> DataFrame:
    """(name, ratio, warn): norm of a change over the norm of the weight it changes."""
    norm = lambda df, c: df.groupBy("name").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias(c))
    return norm(deltas, "d").join(norm(base, "b"), "name").select("name", (F.col("d") / F.col("b")).alias("ratio"), (F.col("d") > 0.25 * F.col("b")).alias("warn"))


def bundle_manifest(files: DataFrame) -> DataFrame:
    """(path, sha256) of files with (path, content)."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def bundle_verify(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem) of what is missing, changed or extra."""
    both = manifest.withColumnRenamed("sha256", "_was").join(found.withColumnRenamed("sha256", "_is"), "path", "full")
    problem = F.when(F.col("_is").isNull(), "missing").when(F.col("_was").isNull(), "extra").when(F.col("_is") != F.col("_was"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")
