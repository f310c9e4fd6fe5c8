"""Mixing sources to target weights by hierarchical budgeting.

Documents hang from a tree of levels (domain, language, source). Each node's capacity is
what its leaves can give in ``max_epochs`` passes. A budget of tokens goes down from the
root: the children of a node share its budget by weight, one that would get more than its
capacity gets that, and what it leaves goes to its siblings. Since a node never gets more
than all its leaves can give, a shortage reaches the level above only when no sibling has
anything left. Every level is one aggregation and one window over nodes.

A leaf gives whole epochs and, of the next one, the longest prefix of documents in seeded
order whose tokens fit in the rest. The prefix is found by totals of hash ranges, of which
one is looked at row by row; a hot leaf is never in one task.

Tokens are words between white space. Null levels are the node ``?``, null texts have no
tokens, a leaf without tokens gives nothing. Repeated rows stand or fall together. All
columns of the input are carried along, but for ``_epoch`` and ``_tokens``, which are new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, documents, staged, text_or_empty

SEED = "mix-1"
#: Tokens of the mixture as a share of those there are.
SHARE = 0.75
MAX_EPOCHS = 3
#: Weights by path; siblings that are not named weigh 1.
WEIGHTS = {("reference",): 2.0, ("web",): 3.0, ("reference", "en"): 2.0, ("web", "en"): 3.0, ("web", "en", "src0"): 4.0}
#: Bits of the hash by which a leaf's order is first cut into ranges.
RANGE_BITS = 14
#: Leaves up to which their table is broadcast (under 20 MB); beyond, rows are joined by key.
BROADCAST_LEAVES = 100_000


def domain_of(source: Column) -> Column:
    """A stand-in for a registry of sources: two domains by the name's hash."""
    return F.when(F.substring(F.md5(source.cast("binary")), 1, 1) < "8", "web").otherwise("reference")


def _words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, SPACES), "")).cast("long")


def _weight(levels: list[str], depth: int, weights: dict[tuple[str, ...], float]) -> Column:
    out = F.lit(1.0)
    for path, w in weights.items():
        if len(path) == depth:
            match = F.lit(True)
            for name, value in zip(levels, path, strict=False):
                match = match & (F.col(name) == value)
            out = F.when(match, F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, levels: list[str], weights: dict[tuple[str, ...], float], share: float, max_epochs: int) -> DataFrame:
    """(levels, tokens, budget) of each leaf; leaves has (levels, tokens)."""
    leaves = leaves.where("tokens > 0")
    total = float(leaves.agg(F.sum("tokens")).first()[0] or 0) * share
    nodes = None
    for depth in range(1, len(levels) + 1):
        path, parent = levels[:depth], levels[: depth - 1]
        here = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).cast("double").alias("cap")).withColumn("w", _weight(levels, depth, weights))
        here = here.withColumn("ratio", F.col("cap") / F.col("w"))
        here = here.join(nodes, parent) if parent else here.withColumn("budget", F.lit(total))
        whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        upto = whole.orderBy("ratio", *path).rowsBetween(Window.unboundedPreceding, -1)
        spent = F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
        left = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))
        # A child is full if giving every child up to its ratio, and itself, is affordable.
        here = here.withColumn("full", spent + F.col("ratio") * left <= F.col("budget"))
        rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole)
        open_ = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(whole)
        nodes = here.withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", rest * F.col("w") / open_))).select(*path, F.col("given").alias("budget"))
    return leaves.join(nodes, levels).select(*levels, "tokens", F.floor(F.round("budget", 3)).cast("long").alias("budget"))


def _order(seed: str, epoch: Column, key: Column) -> Column:
    """60 bits by which an epoch is ordered."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), key.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[tuple[str, ...], float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """A row of ``docs`` for each epoch that takes it, with ``_epoch`` from 0 and ``_tokens``."""
    names = [f"_level{i}" for i in range(len(levels))]
    nodes = {n: F.coalesce(c.cast("string"), F.lit("?")) for n, c in zip(names, levels.values(), strict=True)}
    slim = staged(docs.select(F.col(key).alias("_key"), *(c.alias(n) for n, c in nodes.items()), _words(text_or_empty(text)).alias("tokens")), "tokens")
    leaves = staged(slim.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "leaves")
    plan = budgets(leaves, names, weights, share, max_epochs).select(*names, F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("_full"), (F.col("budget") % F.col("tokens")).alias("_rest"))
    plan = staged(plan, "budgets")
    few = leaves.count() <= BROADCAST_LEAVES
    small = F.broadcast if few else (lambda df: df)
    at = F.shiftright("_h", 60 - RANGE_BITS)
    keyed = slim.join(small(plan), names).withColumn("_h", _order(seed, F.col("_full"), F.col("_key"))).withColumn("_range", at)
    ranges = keyed.groupBy(*names, "_range").agg(F.sum("tokens").alias("n"), F.first("_rest").alias("_rest"))
    upto = Window.partitionBy(*names).orderBy("_range")
    ranges = ranges.withColumn("_upto", F.sum("n").over(upto))
    cut = staged(ranges.where((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("n") <= F.col("_rest"))).select(*names, F.col("_range").alias("_cut"), (F.col("_rest") - F.col("_upto") + F.col("n")).alias("_left")), "ranges")
    # Rows of that one range: equal keys are peers of the window, so they come together.
    rows = keyed.join(small(cut), names).where(F.col("_range") == F.col("_cut"))
    inside = rows.withColumn("_sum", F.sum("tokens").over(Window.partitionBy(*names).orderBy("_h", "_key"))).where("_sum <= _left")
    last = inside.groupBy(*names).agg(F.max(F.struct("_h", "_key")).alias("_last"))
    table = staged(plan.join(cut, names, "left").join(last, names, "left").select(*names, "_full", "_cut", "_last"), "cuts")
    h = _order(seed, F.col("_full"), F.col("_key"))
    place = F.shiftright(h, 60 - RANGE_BITS)
    # No cut: the rest is less than any prefix, or nothing (a leaf's rest is under its tokens).
    more = F.coalesce((place < F.col("_cut")) | ((place == F.col("_cut")) & (F.struct(h.alias("_h"), F.col("_key")) <= F.col("_last"))), F.lit(False))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"), *(c.alias(n) for n, c in nodes.items()), _words(text_or_empty(text)).alias("_tokens"))
    out = rows.join(small(table), names).withColumn("_copies", F.col("_full") + more.cast("int")).where("_copies > 0")
    out = out.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    return out.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in ("_epoch", "_tokens")), "_epoch", "_tokens")


def levels_of_documents() -> dict[str, Column]:
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir), levels_of_documents())
    return out.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"))


def _oracle() -> str:
    names = ["l1", "l2", "l3"]

    def weight(depth: int) -> str:
        whens = [f"WHEN {' AND '.join(f'{n} = {v!r}' for n, v in zip(names, path, strict=False))} THEN {float(w)}" for path, w in WEIGHTS.items() if len(path) == depth]
        return f"CASE {' '.join(whens)} ELSE 1.0 END" if whens else "1.0"

    steps = [f"n0 AS (SELECT sum(tokens) * {SHARE} AS budget FROM leaves)"]
    for d in (1, 2, 3):
        path, parent = ", ".join(names[:d]), ", ".join(names[: d - 1])
        part = f"PARTITION BY {parent}" if parent else ""
        joined = f"JOIN n{d - 1} USING ({parent})" if parent else "CROSS JOIN n0"
        steps.append(f"""
c{d} AS (SELECT *, cap / w AS ratio FROM (SELECT {path}, CAST(sum(tokens) * {MAX_EPOCHS} AS DOUBLE) AS cap, CAST({weight(d)} AS DOUBLE) AS w FROM leaves GROUP BY ALL) {joined}),
f{d} AS (SELECT *, coalesce(sum(cap) OVER o, 0.0) + ratio * (sum(w) OVER ({part}) - coalesce(sum(w) OVER o, 0.0)) <= budget AS full_ FROM c{d}
  WINDOW o AS ({part} ORDER BY ratio, {path} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n{d} AS (SELECT {path}, CASE WHEN full_ THEN cap ELSE least(cap, (budget - sum(CASE WHEN full_ THEN cap ELSE 0.0 END) OVER ({part})) * w / sum(CASE WHEN full_ THEN 0.0 ELSE w END) OVER ({part})) END AS budget FROM f{d})""")
    order = f"CAST('0x' || substr(md5('{SEED}:' || CAST(whole AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)"
    return f"""
WITH d AS (
  SELECT doc_id, lang, source, CASE WHEN substr(md5(source), 1, 1) < '8' THEN 'web' ELSE 'reference' END AS domain,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens
  FROM documents),
e AS (SELECT *, coalesce(domain, '?') AS l1, coalesce(lang, '?') AS l2, coalesce(source, '?') AS l3 FROM d),
leaves AS (SELECT l1, l2, l3, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM e GROUP BY ALL HAVING sum(n_tokens) > 0),
{",".join(steps)},
p AS (SELECT l1, l2, l3, CAST(floor(round(budget, 3)) AS BIGINT) // tokens AS whole, CAST(floor(round(budget, 3)) AS BIGINT) % tokens AS rest FROM leaves JOIN n3 USING (l1, l2, l3)),
k AS (SELECT *, {order} AS h FROM e JOIN p USING (l1, l2, l3)),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY l1, l2, l3 ORDER BY h, doc_id) AS upto FROM k),
t AS (SELECT *, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS copies FROM s)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS INTEGER) AS epoch FROM (SELECT *, unnest(range(copies)) AS epoch FROM t)
"""


ORACLE = _oracle()
