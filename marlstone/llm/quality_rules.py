"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is an expression over built-in functions, and every rule is a comparison of
two integer measures, so a verdict needs no division and no user function. A null text
counts as an empty one; an empty text has no words and fails the base rule. Extra columns
of the input are not carried unless named in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACES, documents, sealed, text_or_empty

#: Frequent function words of four languages.
STOP_WORDS = (
    "the of and to a in is that for was on are with as be by this at from it or an have not which but were has had they you one all their there been if more when will would who so no "
    "le la les de des du et un une en au aux que qui dans pour par sur est avec ce se il elle ne pas plus son sa ses ou "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine auch er sie dass wie bei oder aus "
    "el los las y del por con para su al lo es como o pero sus me si sin sobre"
).split()
PUNCTUATION = ".,;:!?\"()"


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low * of <= value <= high * of`` (in thousandths; None: open)."""

    name: str
    value: str
    of: str
    low: int | None = None
    high: int | None = None

    def passes(self) -> Column:
        v, of = F.col(self.value) * 1000, F.col(self.of)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (v >= of * self.low)
        if self.high is not None:
            ok = ok & (v <= of * self.high)
        return ok

    def sql(self) -> str:
        parts = [f"{self.value} * 1000 >= {self.of} * {self.low}"] * (self.low is not None)
        parts += [f"{self.value} * 1000 <= {self.of} * {self.high}"] * (self.high is not None)
        return "(" + " AND ".join(parts) + ")"


#: Thousandths of the named base measure.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=3000, high=10000),
    Rule("symbols_per_word", "n_symbols", "n_words", high=100),
    Rule("exclamations_per_word", "n_exclaims", "n_words", high=200),
    Rule("stop_word_share", "n_stop_words", "n_words", low=60),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", high=500),
    Rule("ellipsis_line_share", "n_ellipsis_lines", "n_lines", high=300),
    Rule("capitals_per_character", "n_capitals", "word_chars", high=300),
)


def _removed(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the kept columns and all measures as long."""
    spaced = F.lower(F.translate(F.col("_text"), PUNCTUATION, ""))
    out = docs.select(*keep, text_or_empty().alias("_text")).select(
        *keep,
        "_text",
        F.array_remove(F.split("_text", SPACES), "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.array_remove(F.split(spaced, SPACES), "").alias("_plain"),
    )
    n = F.size("_words")
    following = lambda i, k: F.get(F.col("_words"), i + k)
    windows = F.transform(F.slice("_words", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.struct(F.concat(w, F.lit(" "), following(i, 1), F.lit(" "), following(i, 2)).alias("w"), i.alias("i")))
    out = out.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        _removed(F.col("_text"), "#*$%&|<>").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("..."))).cast("long").alias("n_ellipsis_lines"),
        _removed(F.col("_text"), "!").alias("n_exclaims"),
        _removed(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        F.size(F.filter("_plain", lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        windows.alias("_windows"),
    )
    # Equal windows stand side by side once sorted, the positions of each in order.
    out = out.withColumn("_windows", F.sort_array("_windows"))
    word = lambda i: F.get(F.col("_windows"), i)["w"]
    same = lambda s, i: F.coalesce(s["w"] == word(i + 1), F.lit(False)) | F.coalesce((i > 0) & (s["w"] == word(F.greatest(i - 1, F.lit(0)))), F.lit(False))
    out = out.withColumn("_at", F.sort_array(F.transform(F.filter("_windows", same), lambda s: s["i"])))
    new = F.transform("_at", lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(F.col("_at"), F.greatest(i - 1, F.lit(0))))))
    return sealed(out.withColumn("n_repeat_words", F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_windows", "_at"))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measures, ``base_failed``, one ``ok_<rule>`` flag per rule, and ``kept``."""
    out = measures(docs, keep)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumns({"base_failed": failed} | {f"ok_{r.name}": r.passes() for r in rules})
    verdict = ~F.col("base_failed")
    for r in rules:
        verdict = verdict & F.col(f"ok_{r.name}")
    return out.withColumn("kept", verdict)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select(*COLUMNS)


_LIST = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))
ORACLE = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT doc_id, rid, t,
    list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    list_filter(regexp_split_to_array(lower(regexp_replace(t, '[.,;:!?"()]', '', 'g')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS plain
  FROM d),
w AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM s)),
r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM w) WHERE c > 1),
c AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, range(3) AS o(k) GROUP BY rid),
m AS (
  SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...')) AS BIGINT) AS n_ellipsis_lines,
    CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclaims,
    CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(len(list_filter(plain, lambda x: x IN ({_LIST}))) AS BIGINT) AS n_stop_words,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM s LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {" AND ".join(r.sql() for r in RULES)} AS kept
FROM m
"""
