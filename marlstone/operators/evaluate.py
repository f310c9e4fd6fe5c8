"""Scoring of answers: per skill and overall, refusals, the support gate, and lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions.text import norm


def score(rows: DataFrame, scorer: str = "overlap", gate: bool = False, passages: str = "passages") -> DataFrame:
    """Rows (prompt, expected, output) with ``score``. With the gate an answer that its
    passages don't carry is replaced by the refusal first; why stands in ``gate_reason``."""
    if gate:
        check = sc.support_check(F.col("output"), F.col(passages), F.col("prompt"))
        rows = rows.withColumns({"gate_reason": check["reason"], "output": F.when(check["supported"], F.col("output")).otherwise(sc.REFUSAL)})
    return rows.withColumn("score", F.round(sc.SCORERS[scorer](F.col("output"), F.col("expected")), 6))


def report(scored: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """(skill, n, score) for each skill and ``(all)``; with a baseline also the difference."""
    skill = F.coalesce("skill", F.lit("(unlabeled)"))
    out = scored.select(skill.alias("skill"), "score").rollup("skill").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"), F.grouping("skill").alias("_g"))
    out = out.select(F.when(F.col("_g") == 1, "(all)").otherwise(F.col("skill")).alias("skill"), "n", "score")
    if baseline is None:
        return out
    before = report(baseline).select("skill", F.col("score").alias("_before"))
    return out.join(before, "skill", "left").withColumn("change", F.round(F.col("score") - F.col("_before"), 6)).drop("_before")


def gate_reasons(scored: DataFrame) -> DataFrame:
    return scored.groupBy("gate_reason").agg(F.count("*").alias("n"))


def refusals(rows: DataFrame) -> DataFrame:
    """One row: declined, invented, answered, over_refused, should_decline, should_answer."""
    should, did = sc.is_refusal(F.col("expected")), sc.is_refusal(F.col("output"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return rows.agg(n(should & did).alias("declined"), n(should & ~did).alias("invented"), n(~should & ~did).alias("answered"), n(~should & did).alias("over_refused"), n(should).alias("should_decline"), n(~should).alias("should_answer"))


def with_source(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows with the text of their source chunk as ``passages`` (the oracle arm)."""
    return rows.join(chunks.select(F.col("id").alias("source_chunk"), F.col("text").alias("passages")).dropDuplicates(["source_chunk"]), "source_chunk", "left")


def length_stats(rows: DataFrame, response: str = "response") -> DataFrame:
    """(pairs, shortest, median, longest, warn_short, warn_few) of responses in words; the
    upper median, found by counting lengths instead of sorting rows."""
    words = F.size(F.array_remove(F.split(norm(F.col(response)), " "), ""))
    counts = rows.select(words.alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    # A length is one of few values: the table of lengths is small whatever the rows.
    pairs = F.array_sort(F.collect_list(F.struct("n", "c")))
    one = counts.agg(pairs.alias("h"), F.sum("c").alias("pairs"))
    upto = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("m")), lambda a, x: F.struct((a["seen"] + x["c"]).alias("seen"), F.coalesce(a["m"], F.when(a["seen"] + x["c"] > F.floor(F.col("pairs") / 2), x["n"])).alias("m")))
    out = one.where("pairs > 0").select("pairs", F.get("h", F.lit(0))["n"].alias("shortest"), upto["m"].alias("median"), F.element_at("h", -1)["n"].alias("longest"))
    return out.withColumns({"warn_short": F.col("median") <= 8, "warn_few": F.col("pairs") < 50})


def render_chat(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", eos: str = "", prompt: bool = False) -> DataFrame:
    """(conversation, chat): turns in order as ``Role: text`` lines; an assistant's end with
    the end mark; ``Assistant:`` at the end if an answer is wanted."""
    role = F.initcap("role")
    line = F.concat(role, F.lit(": "), F.coalesce("text", F.lit("")), F.when(F.col("role") == "assistant", eos).otherwise(""), F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("l"))))
    return turns.where(F.col("role").isin("system", "user", "assistant")).groupBy(conversation).agg(F.concat(F.array_join(F.transform(lines, lambda x: x["l"]), ""), F.lit("Assistant:" if prompt else "")).alias("chat"))


def epoch_verdicts(losses: DataFrame) -> DataFrame:
    """(run, epoch, loss, improved, diverging): better than all before; not, and worse than
    the first."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("run").orderBy("epoch")
    best = F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("loss").over(w)
    improved: Column = best.isNull() | (F.col("loss") < best)
    return losses.withColumns({"improved": improved, "diverging": ~improved & (F.col("loss") > first)})
