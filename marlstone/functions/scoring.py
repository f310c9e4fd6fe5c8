"""Scorers of answers and the check of an answer against its passages, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, norm

# Filler words of the overlap score.
OVERLAP_FILLERS = "a an and are as at be by for from has have in is it its of on or that the this to was were will with".split()
# Filler words of the support check.
SUPPORT_FILLERS = """
a an the and or but if then than that this these those of in on at to for with by from as is are was were be been being it its he
she they them their we our you your i not no do does did have has had can could will would should may might must there here what
which who when where why how also such some any all more most other into about over under between because so very much many one
two three both
""".split()
# The refusal sentence, what marks a refusal, and the template of a grounded prompt.
REFUSAL = "The reference material provided does not contain the answer to that question."
REFUSAL_MARKS = ("does not contain the answer", "not contain the answer", "material provided does not")
GROUNDED_HEAD = "Use the reference material below to answer. If it does not contain the answer, say so plainly."
MIN_OVERLAP = 0.35
MIN_WORDS = 6


def is_refusal(text: Column) -> Column:
    plain = norm(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for mark in REFUSAL_MARKS:
        out = out | F.contains(plain, F.lit(mark))
    return out


def as_number(value: Column) -> Column:
    """'1,499', '$88' and '88.0' as numbers; null for anything else."""
    return F.regexp_replace(F.replace(F.trim(value), F.lit(","), F.lit("")), r"^\$+", "").try_cast("double")


def values_match(a: Column, b: Column) -> Column:
    return F.coalesce(as_number(a) == as_number(b), norm(a) == norm(b))


def content_words(text: Column) -> Column:
    """Plain words without fillers, with repeats."""
    return F.filter(F.regexp_extract_all(norm(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(OVERLAP_FILLERS))


def score_contains(output: Column, expected: Column) -> Column:
    return F.contains(norm(output), norm(expected)).cast("double")


def score_exact(output: Column, expected: Column) -> Column:
    return (norm(output) == norm(expected)).cast("double")


def score_refusal(output: Column, expected: Column) -> Column:
    return (is_refusal(output) == is_refusal(expected)).cast("double")


def score_overlap(output: Column, expected: Column) -> Column:
    """F1 of the two multisets of content words.

    Both are sorted; the k-th copy of a word is a word of its own (w, k), so that a set
    intersection counts copies as often as both sides have them.
    """
    numbered = lambda words: bound(F.array_sort(words), lambda all_: F.transform(all_, lambda w, i: F.struct(w.alias("w"), (i - F.array_position(all_, w)).alias("k"))))
    both = F.struct(numbered(content_words(output)).alias("p"), numbered(content_words(expected)).alias("g"))
    return bound(both, lambda x: F.coalesce(2.0 * F.size(F.array_intersect(x["p"], x["g"])) / F.nullif(F.size(x["p"]) + F.size(x["g"]), F.lit(0)), F.lit(0.0)))


def _object(text: Column) -> Column:
    """The text from the first { to the last } as a map, null if it isn't an object."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), "map<string,string>")


def score_json_field(output: Column, expected: Column) -> Column:
    """Share of the expected object's non-null fields that the output has with equal value."""
    pred, gold = _object(output), _object(expected)
    keys = F.filter(F.map_keys(gold), lambda k: F.try_element_at(gold, k).isNotNull())
    right = F.filter(keys, lambda k: F.coalesce(values_match(F.try_element_at(pred, k), F.try_element_at(gold, k)), F.lit(False)))
    return F.when(F.coalesce(F.size(keys), F.lit(0)) > 0, F.size(right) / F.size(keys)).otherwise(0.0)


#: By name, as a caller registers scorers of its own.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {"contains": score_contains, "exact": score_exact, "json_field": score_json_field, "overlap": score_overlap, "refusal": score_refusal}


def numbers(text: Column) -> Column:
    """Distinct numbers, without thousands commas and trailing zeros."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\p{L}\p{N}_.])(\d[\d,]*(?:\.\d+)?)(?![\p{L}\p{N}_])"), F.lit(1))
    plain = F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))
    short = F.transform(plain, lambda x: F.when(F.contains(x, F.lit(".")), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x))
    return F.array_distinct(F.transform(short, lambda x: F.when(x == "", "0").otherwise(x)))


def identifiers(text: Column) -> Column:
    """Distinct tags such as P-4471, in capitals without separators."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b[A-Za-z]+[-_]?\d+[A-Za-z0-9]*\b"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.translate(F.upper(x), "-_", "")))


def support_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(SUPPORT_FILLERS)))


def passages_from_prompt(prompt: Column) -> Column:
    """What stands between a grounded prompt's head and its last question."""
    body = F.when(F.contains(prompt, F.lit(GROUNDED_HEAD)), F.substr(prompt, F.instr(prompt, GROUNDED_HEAD) + len(GROUNDED_HEAD))).otherwise(prompt)
    return F.regexp_replace(body, r"(?s)\nQuestion:(?!.*\nQuestion:).*$", "")


def support_check(answer: Column, passages: Column, question: Column | None = None, min_overlap: float = MIN_OVERLAP) -> dict[str, Column]:
    """supported, reason, bad_numbers, bad_identifiers, overlap. Numbers come before
    identifiers, those before overlap, which only longer answers are judged by."""
    question = F.lit("") if question is None else F.coalesce(question, F.lit(""))
    given = F.concat(F.coalesce(passages, F.lit("")), F.lit("\n"), question)
    bad_numbers = F.array_sort(F.array_except(numbers(answer), numbers(given)))
    bad_ids = F.array_sort(F.array_except(identifiers(answer), identifiers(given)))
    words = support_words(answer)
    share = F.when(F.size(words) > 0, F.size(F.array_intersect(words, support_words(given))) / F.size(words)).otherwise(0.0)
    refusal = is_refusal(answer)
    none = F.array().cast("array<string>")
    reason = (
        F.when(refusal, "refusal")
        .when(F.size(bad_numbers) > 0, "number not in the material")
        .when(F.size(bad_ids) > 0, "identifier not in the material")
        .when((F.size(words) >= MIN_WORDS) & (share < min_overlap), "almost nothing in common with the material")
        .otherwise("")
    )
    return {
        "supported": reason.isin("", "refusal"),
        "reason": reason,
        "bad_numbers": F.when(refusal, none).otherwise(bad_numbers),
        "bad_identifiers": F.when(refusal, none).otherwise(bad_ids),
        "overlap": F.when(refusal, 1.0).otherwise(F.round(share, 3)),
    }


def explain(supported: Column, bad_numbers: Column, bad_identifiers: Column, overlap: Column) -> Column:
    """One line on why an answer was held back."""
    return (
        F.when(supported, "supported by the material")
        .when(F.size(bad_numbers) > 0, F.concat(F.lit("held back, "), F.array_join(bad_numbers, ", "), F.when(F.size(bad_numbers) == 1, " appears").otherwise(" appear"), F.lit(" nowhere in the material")))
        .when(F.size(bad_identifiers) > 0, F.concat(F.lit("held back, "), F.array_join(bad_identifiers, ", "), F.lit(" appears nowhere in the material")))
        .otherwise(F.concat(F.lit("held back, only "), F.round(overlap * 100).cast("int").cast("string"), F.lit("% of the answer's content appears in the material")))
    )


def answer_is_present(answer: Column, passage: Column, need: float = 0.6) -> Column:
    """Whether enough of an answer's longer terms stand in a passage; yes if it has none."""
    terms = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(answer), F.lit(r"\d[\d,]*\.\d+|\d[\d,]*|\p{L}+"), F.lit(0)), lambda t: F.length(t) > 3))
    there = bound(F.lower(passage), lambda p: F.filter(terms, lambda t: F.contains(p, t)))
    return F.when(F.size(terms) == 0, True).otherwise(F.size(there) >= need * F.size(terms))


def contains_secret(answer: Column, secret: Column) -> Column:
    """Whether a value stands in an answer on a digit boundary."""
    pattern = F.concat(F.lit(r"(?<![\d.])"), F.regexp_replace(secret, r"([^A-Za-z0-9])", r"\\$1"), F.lit(r"(?![\d])"))
    return F.regexp_like(answer, pattern)
