"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each slot holds one bit per language, so
that the AND of an n-gram's slots is the set of all languages whose filter contains it. Per
language, the share of a text's n-grams that are contained is corrected for the filter's
false positives, and the largest corrected share decides (ties: the first language in
order). A filter holds the most frequent n-grams of its language among those that are not
much more frequent in another one.

Fitting reads at most ``per_language`` labelled documents of each language (those with the
smallest hash of their id), whole texts; everything else runs over all rows. A null text
and one without letters give ``und`` and 0, and so does everything if there is nothing to
learn from; an empty table gives no rows. Texts of any length are read whole. Repeated rows
are predicted alike; other columns are carried along, but for those of the results' names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, lean, staged

SIZES = (2, 3, 4)
#: Documents read for fitting, and n-grams kept, of each language.
PER_LANGUAGE = 2000
GRAMS = 20_000
#: Ids of fitting documents up to which they are broadcast (8 MB).
BROADCAST_IDS = 1_000_000
SLOT_BITS = 20
HASHES = 3
#: An n-gram stays if its rate is this share or more of its highest rate in any language.
RATE_SHARE = 0.5
#: Characters handled at once; longer texts go through in pieces, which the sums join.
CHUNK = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point of the small form of each letter, 0 for all else."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(letters, row) in chunks: 0 stands for any run of other characters, one on either
    side of a text; row is -1 where no n-gram starts."""
    codes, rows, size = [], [], 0
    table, tail = _letters(), max(SIZES) - 1
    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), CHUNK):
            part = text[at : at + CHUNK + tail]
            c = table[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
            own = np.full(len(c) + 2, row, np.int32)
            own[1 + min(CHUNK, len(part)) :] = -1
            c = np.concatenate(([0], c, [0])).astype(np.uint32)
            keep = np.ones(len(c), bool)
            keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
            codes.append(c[keep])
            rows.append(own[keep])
            size += len(part)
            if size >= CHUNK:
                yield np.concatenate(codes), np.concatenate(rows)
                codes, rows, size = [], [], 0
    if codes:
        yield np.concatenate(codes), np.concatenate(rows)


def _grams(codes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, row) of each n-gram: letters, with a separator only at either end."""
    wide = codes.astype(np.uint64)
    for n in SIZES:
        m = len(wide) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        ok = rows[:m] >= 0
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + m]
            if 0 < k < n - 1:
                ok &= wide[k : k + m] != 0
        yield _mixed(h[ok]), rows[:m][ok]


@dataclass(frozen=True)
class Filters:
    """slots[word, slot] holds the bits of languages 64 * word and on."""

    languages: tuple[str, ...]
    slots: np.ndarray
    false_rate: np.ndarray

    def contained(self, h: np.ndarray, word: int) -> np.ndarray:
        found = None
        for i in range(HASHES):
            x = self.slots[word][_slot(h, i)]
            found = x if found is None else found & x
        return found


def _slot(h: np.ndarray, i: int) -> np.ndarray:
    """20 bits of the hash for each of three functions."""
    return ((h >> np.uint64(i * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def build_filters(grams: dict[str, np.ndarray]) -> Filters:
    languages = tuple(sorted(grams))
    slots = np.zeros((max(1, -(-len(languages) // 64)), 1 << SLOT_BITS), np.uint64)
    rate = []
    for n, lang in enumerate(languages):
        bit = np.uint64(1 << (n % 64))
        for i in range(HASHES):
            slots[n // 64][np.unique(_slot(grams[lang], i))] |= bit
        rate.append((np.count_nonzero(slots[n // 64] & bit) / (1 << SLOT_BITS)) ** HASHES)
    return Filters(languages, slots, np.array(rate))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, grams: int = GRAMS) -> Filters:
    """Filters from rows with a language; at most ``per_language`` of each are read."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    ids = rows.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.xxhash64(F.lit("fit"), F.col(key).cast("string")).alias("_h"))
    # Rows that can be among the first: twice as many as wanted, by the share of the hash
    # range that a language of its size needs. Only those meet in a language's window.
    share = ids.groupBy("_lang").agg((F.least(F.lit(1.0), F.lit(2.0 * per_language + 100) / F.count("*")) * 2.0**40).alias("_limit"))
    ids = ids.join(staged(share, "shares"), "_lang").where(F.pmod("_h", F.lit(1 << 40)) < F.col("_limit"))
    order = Window.partitionBy("_lang").orderBy(F.pmod("_h", F.lit(1 << 40)), "_key")
    chosen = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language).select("_key").distinct()
    # At most per_language ids of each language: broadcast unless there are very many.
    chosen = staged(chosen, "chosen")
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    sample = rows.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text")).join(few, "_key", "left_semi").select("_lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name in dict.fromkeys(langs):
                for codes, own in _pieces([t for t, x in zip(texts, langs, strict=True) if x == name]):
                    for h, _ in _grams(codes, own):
                        values, n = np.unique(h.view(np.int64), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = sample.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    rated = counts.withColumn("rate", share).withColumn("top", F.max("rate").over(Window.partitionBy("gram")))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = rated.where((F.col("rate") >= RATE_SHARE * F.col("top")) & (F.col("n") > 1)).withColumn("k", F.row_number().over(best)).where(F.col("k") <= grams)
    found: dict[str, list[int]] = {}
    for r in kept.select("lang", "gram").toLocalIterator():
        found.setdefault(r["lang"], []).append(r["gram"])
    return build_filters({k: np.array(v, np.int64).view(np.uint64) for k, v in found.items()})


def predict(texts: list[str | None], filters: Filters) -> tuple[list[str], list[float], list[float]]:
    """Languages, their shares among the languages (the scores), and the share of a text's
    n-grams that its language contains."""
    n_langs = len(filters.languages)
    hits, total, letters = np.zeros((len(texts), n_langs)), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for codes, rows in _pieces(texts):
        letters[rows[(codes != 0) & (rows >= 0)]] = True
        for h, own in _grams(codes, rows):
            total += np.bincount(own, minlength=len(texts))
            for word in range(len(filters.slots)):
                sets = filters.contained(h, word)
                for i in range(64 * word, min(n_langs, 64 * word + 64)):
                    has = (sets & np.uint64(1 << (i % 64))) != 0
                    hits[:, i] += np.bincount(own[has], minlength=len(texts))
    if not n_langs:
        return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    share = np.maximum(0, (hits / np.maximum(total, 1)[:, None] - filters.false_rate) / (1 - filters.false_rate))
    best, whole = share.argmax(axis=1), share.sum(axis=1)
    score = np.where(whole > 0, share.max(axis=1) / np.maximum(whole, 1e-300), 1 / n_langs)
    return [filters.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0).tolist(), np.where(letters, share.max(axis=1), 0.0).tolist()


def identify(docs: DataFrame, filters: Filters, text: str = "text", pred: str = "lang_pred", score: str = "score", known: str = "known_share") -> DataFrame:
    """``docs`` with three more columns, the last one the share of a text's n-grams that the
    predicted language contains; columns of these names are replaced."""
    rest = [f for f in docs.schema.fields if f.name not in (pred, score, known)]
    names = [f.name for f in rest]
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 8 MB for every 64 languages
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + f", `{pred}` string, `{score}` double, `{known}` double"
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, *numbers = predict(b.column(at).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), *(pa.array(n, pa.float64()) for n in numbers)], [*names, pred, score, known])

    return docs.select(*names).mapInArrow(lean(run), schema)


def held_out(key: str = "doc_id") -> Column:
    """A row without an id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op4_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    filters = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), filters).drop("text")
