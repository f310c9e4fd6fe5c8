"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. A ledger row says that
one blob was scanned under one version of the rules and what was found; only pairs of blob
and rule version that the ledger lacks are scanned, once each however many paths hold the
blob, and findings are joined back to all paths. All of it is built-in expressions.

A null text is the empty blob. Repeated rows give one result row each, an empty table none.
A changed rule table changes the version, so that blobs are scanned again; ledgers of old
versions stay valid. Spans are in code points, end exclusive. Texts are scanned whole,
whatever their length. Of the input only path and text are read, so no name can clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, prefix_sums, staged, text_or_empty


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` finds; a match counts if its ``group`` has ``least`` or more characters."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = False


RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # A maximal run of 24 or more is what a run of any length gives when short ones are dropped.
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    SecretRule("private_key", r"-----BEGIN (?:(?!PRIVATE KEY-)[A-Z0-9]++ )*+PRIVATE KEY-----", 0, 1),
    SecretRule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    SecretRule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
)


def rules_version(rules: tuple[SecretRule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def find_spans(df: DataFrame, rules: tuple[SecretRule, ...] = RULES, text: str = "text") -> DataFrame:
    """Replace the text by ``spans``: array of (start, rank of the kind, end, kind), in order."""
    others = [c for c in df.columns if c != text]
    t = F.col(text)
    none = F.array().cast("array<string>")
    n = range(len(rules))
    found = {}
    for i, r in enumerate(rules):
        hit = t.rlike(r.pattern)
        found[f"_m{i}"] = F.when(hit, F.regexp_extract_all(t, F.lit(r.pattern), F.lit(0))).otherwise(none)
        found[f"_v{i}"] = F.when(hit, F.regexp_extract_all(t, F.lit(r.pattern), F.lit(r.group))).otherwise(none) if r.group else F.lit(None).cast("array<string>")
    df = df.select(*others, text, *(c.alias(k) for k, c in found.items()))
    # What stands before each match: one piece more than there are matches.
    df = df.select(*others, *found, *(F.when(F.size(f"_m{i}") > 0, F.split(t, r.pattern, -1)).otherwise(none).alias(f"_g{i}") for i, r in enumerate(rules)))
    gap = lambda i, k: F.length(F.get(F.col(f"_g{i}"), k)).cast("long")
    lengths = lambda i: F.transform(f"_m{i}", lambda m, k: gap(i, k) + F.length(m))
    df = df.select("*", *(lengths(i).alias(f"_l{i}") for i in n))
    df = df.select("*", *(prefix_sums(F.col(f"_l{i}")).alias(f"_b{i}") for i in n))

    def spans(i: int, r: SecretRule) -> Column:
        start = lambda k: F.get(F.col(f"_b{i}"), k) + gap(i, k)
        value = lambda m, k: F.get(F.col(f"_v{i}"), k) if r.group else m
        each = F.transform(f"_m{i}", lambda m, k: F.struct(start(k).alias("start"), F.lit(i).alias("rank"), (start(k) + F.length(m)).alias("end"), F.lit(r.kind).alias("kind"), (F.length(value(m, k)) >= r.least).alias("ok")))
        return F.transform(F.filter(each, lambda s: s["ok"]), lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))

    return df.select(*others, F.sort_array(F.concat(*(spans(i, r) for i, r in enumerate(rules)))).alias("spans"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): findings has (path, spans) for every row of ``versions``; the
    ledger (blob, rule_version, spans) has the given rows and those of this scan.

    Versions of one path are rows of the same path, which may be null.
    """
    version = rules_version(rules)
    rows = versions.select(F.col(path).alias("_path"), text_or_empty(text).alias("_text")).withColumn("_blob", blob_of(F.col("_text")))
    blobs = rows.groupBy("_blob").agg(F.min("_path").alias("_path"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == version).select(F.col("blob").alias("_blob"))
        blobs = blobs.join(seen, "_blob", "left_anti")
    # Joined on path and blob, so that the copies of a frequent blob spread over all tasks. A
    # blob that stands under null paths only is scanned under those.
    once = blobs.select(F.col("_blob").alias("_b"), F.col("_path").alias("_p")).hint("shuffle_hash")
    unseen = rows.join(once, (F.col("_blob") == F.col("_b")) & F.col("_path").eqNullSafe(F.col("_p")), "left_semi")
    scanned = find_spans(unseen.select("_blob", "_text"), rules, "_text")
    fresh = staged(scanned.select(F.col("_blob").alias("blob"), F.lit(version).alias("rule_version"), "spans").groupBy("blob", "rule_version").agg(F.first("spans").alias("spans")), "ledger")
    full = fresh if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(fresh)
    hits = full.where((F.col("rule_version") == version) & (F.size("spans") > 0)).select(F.col("blob").alias("_blob"), "spans")
    none = F.array().cast(fresh.schema["spans"].dataType)
    findings = rows.select("_path", "_blob").join(hits, "_blob", "left").select(F.col("_path").alias(path), F.coalesce("spans", none).alias("spans"))
    return findings, full


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans over one ledger: an earlier one of the versions with even ids, then one of
    the whole table, which scans only blobs that the first has not seen."""
    versions = documents(spark, sf_dir)
    _, ledger = scan_versions(versions.where("doc_id % 2 = 0"))
    findings, _ = scan_versions(versions, ledger)
    ranks = [i for i, r in enumerate(RULES) if r.base]
    count = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["rank"].isin(ranks))
    return findings.select("doc_id", *(count(i).alias(f"n_{RULES[i].kind}") for i in ranks), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """Start of match i: all pieces up to it and all earlier matches. RE2 has no group-wise flag, so letters are spelt
    out, and no possessive loop, which it doesn't need."""
    spelt = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("(?i:password|passwd|secret|token|api_?key)", spelt).replace(r"(?:(?!PRIVATE KEY-)[A-Z0-9]++ )*+", "(?:[A-Z0-9]+ )*").replace("'", "''")
        parts.append(f"""
SELECT rid, {i} AS rank, '{r.kind}' AS kind, k,
  coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS start,
  length(m[k]) AS n, length(v[k]) AS least
FROM (SELECT rid, m, v, g, unnest(range(1, len(m) + 1)) AS k FROM (
  SELECT rid, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {r.group}) AS v, regexp_split_to_array(t, '{p}') AS g FROM d))
WHERE length(v[k]) >= {r.least}""")
    last = max(i for i, r in enumerate(RULES) if r.base)
    counts = ", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in RULES if r.base)
    sums = ", ".join(f"count(*) FILTER (rank = {i}) AS n_{r.kind}" for i, r in enumerate(RULES) if r.base)
    span = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
a AS (SELECT rid, {sums}, string_agg({span}, ',' ORDER BY start, rank) FILTER (rank <= {last}) AS base, string_agg({span}, ',' ORDER BY start, rank) AS spans FROM s GROUP BY rid)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)
"""


ORACLE = _oracle()
