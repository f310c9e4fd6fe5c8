"""Readers and writers: folders of files, JSON lines, lists, plans, and bundles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.access import Policy


def folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, modified, size) of all files below a folder, paths relative to it and
    hidden ones left out. Columns that aren't asked for aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = root.rstrip("/").rsplit("/", 1)[-1]
    relative = F.regexp_extract("path", r"/" + _quoted(top) + r"/(.*)$", 1)
    out = files.select(F.try_url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))).alias("path"), "content", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return out.where(~F.col("path").rlike(r"(^|/)\."))


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() else f"\\{c}" for c in s)


def from_documents(docs: DataFrame) -> DataFrame:
    """A documents table as files: (path, sha256, text)."""
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("sha256"), "text")


def chunk_table(docs: DataFrame) -> DataFrame:
    """A documents table as chunks (row, id, text, source, compartment, kind)."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(F.col("doc_id").alias("row"), tx.content_id(F.col("text")).alias("id"), "text", path.alias("source"), tx.compartment_of(path).alias("compartment"), F.lit("document").alias("kind"))


def json_lines(spark: SparkSession, path: str, required: tuple[str, ...], schema: str | None = None) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped. A line that isn't an object or lacks a
    required key is an error that names the first such lines and their numbers."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    keys = F.json_object_keys("value")
    bad = lines.where(keys.isNull() | (F.size(F.array_except(F.lit(list(required)), F.coalesce(keys, F.array().cast("array<string>")))) > 0))
    if first := bad.limit(3).collect():
        raise ValueError("\n".join(_fault(spark, path, r["value"], required) for r in first))
    if lines.isEmpty():
        raise ValueError(f"{path} has no usable row")
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def _fault(spark: SparkSession, path: str, value: str, required: tuple[str, ...]) -> str:
    """Only for an error that is raised anyway: one pass to number one line."""
    at = spark.read.text(path).rdd.zipWithIndex().filter(lambda r: r[0]["value"] == value).map(lambda r: r[1] + 1).first()
    try:
        row = json.loads(value)
    except ValueError as e:
        return f"{path} line {at}: invalid JSON ({e})"
    missing = [k for k in required if not isinstance(row, dict) or k not in row]
    return f"{path} line {at}: missing {missing}"


def lines(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """(value) of a list file without blank lines and, if so, without # comments."""
    rows = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    return rows.where(~F.col("value").startswith("#")) if comments else rows


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Rebuilt each time, so that edits and deletions come through; one folder for each
    compartment, which a permission then prunes by."""
    chunks.write.mode("overwrite").partitionBy("compartment").parquet(path)


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key the table doesn't have; how many there were."""
    spark = rows.sparkSession
    try:
        rows = rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows = rows.persist()
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n


def parse_plan(spec: dict) -> tuple[dict, dict[str, str]]:
    """(policy, family of each compartment) of one plan; all its problems in one error."""
    problems, rows, family = [], [], {}
    compartments = spec.get("compartments") or {}
    listed = lambda x: [x] if isinstance(x, str) else list(x or [])
    if not compartments:
        problems.append("the plan has no compartments")
    for name, body in compartments.items():
        body = body or {}
        if not name.replace("-", "").replace("_", "").isalnum() or not name.isascii() or name[0] in "-_":
            problems.append(f"{name!r} is not a usable name")
        if extra := set(body) - {"tier", "family", "description", "folders", "urls", "url_files", "volatile"}:
            problems.append(f"{name}: unknown field(s) {sorted(extra)}")
        tier = body.get("tier", "restricted")
        if tier not in ("company", "department", "restricted"):
            problems.append(f"{name}: unknown tier {tier!r}")
        if not any(listed(body.get(k)) for k in ("folders", "urls", "url_files")):
            problems.append(f"{name}: names no folder, URL or URL file")
        rows.append({"name": name, "tier": tier, "volatile": bool(body.get("volatile", False)), "description": body.get("description", "")})
        family[name] = body.get("family", name)
    people = []
    for name, body in (spec.get("principals") or {}).items():
        reads = listed((body or {}).get("reads"))
        if unknown := [c for c in reads if c not in compartments]:
            problems.append(f"{name}: reads unknown {unknown}")
        people.append({"name": name, "compartments": reads})
    if not people:
        problems.append("the plan has no principals")
    if problems:
        raise ValueError("the plan can't be used:\n" + "\n".join(problems))
    return {"compartments": rows, "principals": people}, family


def load_plan(spark: SparkSession, path: str) -> tuple[Policy, DataFrame]:
    """(policy, families (compartment, family)) of a JSON or, with its package, YAML plan."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        import yaml  # optional

        spec = yaml.safe_load(text)
    else:
        spec = json.loads(text)
    policy, family = parse_plan(spec)
    return Policy.from_dict(spark, policy), spark.createDataFrame(list(family.items()), "compartment string, family string")


#: Keys of a recipe.
RECIPE_KEYS = frozenset("base_model strata merge eval output defaults".split())


def parse_recipe(spec: dict, known: frozenset[str] = RECIPE_KEYS) -> dict:
    """A recipe with known keys only, a base model and at least one named part."""
    problems = [f"unknown key {k!r}" for k in sorted(set(spec) - known)]
    if not spec.get("base_model"):
        problems.append("base_model is missing")
    if not spec.get("strata"):
        problems.append("strata is missing or empty")
    problems += [f"part {i} has no name or no data" for i, s in enumerate(spec.get("strata") or [], 1) if not s.get("name") or not s.get("data")]
    if problems:
        raise ValueError("the recipe can't be used:\n" + "\n".join(problems))
    return spec
