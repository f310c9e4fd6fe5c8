"""Text functions as Column expressions. Nothing here runs Python per row.

Word characters are letters and numbers of any script; ``_`` is not one. Classes are spelt
out, because a regex engine's own idea of a word differs from engine to engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]++"
#: Words, and codes whose parts are joined by one of - _ . (kept whole). The loops are
#: possessive, so that the engine need not remember, on its stack, each part of a long one.
TOKEN = WORD + r"(?:[-_.]" + WORD + ")*+"

# Patterns that the results depend on.
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
PHONE = r"(?U)(?<![\d-])(?:\+?\d[\d\s().-]{8,}\d)(?![\d-])"
#: The same matches as EMAIL, but tried only where a run of its characters, or the search, begins.
_EMAIL = r"(?:(?<![\p{L}\p{N}_.+-])|\G)[\p{L}\p{N}_.+-]++@[\p{L}\p{N}_-]++\.[\p{L}\p{N}_.-]++"
CARD = r"(?U)\b(?:\d[ -]?){13,16}\b"
#: In this order, each on what the one before left.
REDACTIONS = (("email", _EMAIL), ("phone", PHONE), ("card", CARD))
#: Phones with their neighbours, and cards, as engines without lookaround see them: classes of
#: ASCII, and a neighbour belongs to one match only.
_PHONE_BETWEEN = r"(\A|[^0-9-])\+?[0-9][0-9\t\n\f\r ().-]{8,}[0-9](\z|[^0-9-])"
_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_CARD_ASCII = _EDGE + r"(?:[0-9][ -]?){13,16}" + _EDGE

# Words that ask about a picture.
VISUAL_WORDS = """
diagram diagrams drawing drawings schematic schematics figure figures chart charts graph graphs plot plots photo photograph
photographs image images picture pictures nameplate label labels labelled labeled legend axis axes sketch layout arrangement
shown depicts depicted illustration illustrated screenshot scan scanned plate plan drawing-number
""".split()


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often a lambda looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def features(text: Column) -> Column:
    """Words, word pairs ``a_b``, and every second 4-gram of the joined words (the last start
    is before length - 4), as one array with repeats."""
    def of(words: Column) -> Column:
        flat = F.array_join(words, " ")
        n = F.ceil(F.greatest(F.length(flat) - 4, F.lit(0)) / 2).cast("int")
        twos = F.regexp_extract_all(flat, F.lit("(?s).."), F.lit(0))
        grams = bound(twos, lambda t: F.transform(F.slice(t, F.lit(1), n), lambda x, i: F.concat(x, F.get(t, i + 1))))
        return F.concat(words, pairs(words), grams)

    return bound(tokens(text), of)


def pairs(words: Column) -> Column:
    """``a_b`` for neighbours; give it a column or a bound value."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit("_"), F.get(words, i + 1)))


def email_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_EMAIL)).cast("long")


def redact(text: Column) -> Column:
    for name, pattern in REDACTIONS:
        text = F.regexp_replace(text, pattern, f"[{name} removed]")
    return text


def redact_between(text: Column) -> Column:
    """``redact`` as SQL without lookaround can say it: neighbours of a phone are matched and put
    back, twice, as two phones can share one. A ``+`` stays if what stands before it went with
    the phone before. Digits of a phone after another one can stay too, so texts to be given
    away go through ``redact``."""
    text = F.regexp_replace(text, _EMAIL, "[email removed]")
    for _ in range(2):
        text = F.regexp_replace(text, _PHONE_BETWEEN, "$1[phone removed]$2")
    return F.regexp_replace(text, _CARD_ASCII, "[card removed]")


def redaction_counts(text: Column) -> dict[str, Column]:
    """Count of each kind, on the text that the kinds before have left."""
    out = {}
    for name, pattern in REDACTIONS:
        out[name] = F.regexp_count(text, F.lit(pattern)).cast("long")
        text = F.regexp_replace(text, pattern, f"[{name} removed]")
    return out


def norm(text: Column) -> Column:
    """Small letters, trimmed, white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_think(text: Column) -> Column:
    """Without closed think blocks, cut from an open one on, trimmed."""
    closed = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.regexp_replace(F.regexp_replace(closed, r"(?s)<think>.*$", ""), r"(?U)^\s++|(?<!\s)\s++$", "")


def looks_visual(question: Column) -> Column:
    return F.arrays_overlap(tokens(question), F.lit(VISUAL_WORDS))


def file_name(url: Column, content_type: Column) -> Column:
    """A safe file name from the last part of a URL's path, with an ending if it has none."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), r"^//[^/?#]*", "")
    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), "/+$", ""), "/"), -1)
    name = F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))
    name = F.coalesce(F.nullif(F.coalesce(name, last), F.lit("")), F.lit("download"))
    name = F.substring(F.regexp_replace(name, r"[^\p{L}\p{N}_.() -]", "_"), 1, 120)
    # Endings by content type.
    ending = F.when(content_type == "text/html", ".html").when(content_type == "application/pdf", ".pdf").when(content_type == "text/markdown", ".md").otherwise(".txt")
    return F.when(F.contains(name, F.lit(".")), name).otherwise(F.concat(name, ending))


def compartment_of(path: Column, default: str = "public") -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(default)


def is_test(key: Column, fraction: float, seed: int = 42) -> Column:
    """Stable split: the first 32 bits of a hash of seed and key, as a share of their range."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967295.0) < F.lit(fraction)


def content_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def model_size(name: Column) -> Column:
    """Billions of parameters from a model's name, null if it states none."""
    last = F.element_at(F.split(F.regexp_replace(name, r"[/\\]+$", ""), r"[/\\]"), -1)
    return F.nullif(F.regexp_extract(last, r"(\d+(?:\.\d+)?)\s*[bB](?![a-zA-Z0-9])", 1), F.lit("")).cast("double")


def relevant_sentences(question: Column, text: Column, keep: int = 4) -> Column:
    """The sentences that share most words with the question, in their order; the text's
    beginning if no sentence has a word."""
    each = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s, i: F.struct(F.array_distinct(tokens(s)).alias("t"), i.alias("i"), s.alias("s")))
    share = lambda asked, x: F.round(F.size(F.array_intersect(asked, x["t"])) / F.sqrt(F.size(x["t"])), 9)
    scored = bound(F.array_distinct(tokens(question)), lambda asked: F.transform(F.filter(each, lambda x: F.size(x["t"]) > 0), lambda x: F.struct((-share(asked, x)).alias("k"), x["i"].alias("i"), x["s"].alias("s"))))
    chosen = F.sort_array(F.transform(F.slice(F.sort_array(scored), 1, keep), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    return F.coalesce(F.nullif(F.array_join(F.transform(chosen, lambda x: x["s"]), " "), F.lit("")), F.substring(text, 1, 400))
