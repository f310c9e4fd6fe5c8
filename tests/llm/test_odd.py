"""Odd inputs of the training-data operators: very long texts, empty tables, repeated rows,
clashing names; and a brute-force twin of the pseudonyms."""

import calendar
import datetime
import hashlib
import re
import time

import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from marlstone.llm import best_fit_packing as bp
from marlstone.llm import common, mixing, topk_histogram
from marlstone.llm import language_filters as lf
from marlstone.llm import license_scan as ls
from marlstone.llm import pii_feistel as pii
from marlstone.llm import quality_rules as qr
from marlstone.llm import repeat_index as ri
from marlstone.llm import secret_ledger as sl
from marlstone.llm import simhash_pigeonhole as sp

MB = 1 << 20
LONG = {
    "joined": "a" + ".a" * (MB // 2),
    "mail": "x@b" + ".a" * (MB // 2),
    "key": "-----BEGIN " + "A " * (MB // 2) + "PRIVATE KEY-----",
    "spaces": "a" + " " * MB + "b",
    "letters": "a" * MB,
    "digits": "1" * MB,
    "groups": "1234 " * (MB // 5),
    "choices": "SPDX-License-Identifier: MIT" + " OR MIT" * (MB // 7),
    "brackets": "SPDX-License-Identifier: " + "(" * (MB // 2) + "MIT" + ")" * (MB // 2),
}


def table(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


@pytest.fixture(scope="module")
def long(spark):
    return table(spark, list(enumerate(LONG.values()))).repartition(4)


def test_long_texts_native(spark, long):
    names = list(LONG)
    found, _ = sl.scan_versions(long)
    kinds = {names[r["doc_id"]]: [s["kind"] for s in r["spans"]] for r in found.collect()}
    assert kinds["key"] == ["private_key"] and kinds["spaces"] == []
    out = {names[r["doc_id"]]: r["pii"] for r in pii.pseudonymise(long).collect()}
    assert out["mail"] == ["email"] and out["letters"] == out["joined"] == []
    words = {names[r["doc_id"]]: r["n_words"] for r in qr.quality_rules(long).collect()}
    assert words["spaces"] == 2 and words["letters"] == 1 and words["groups"] == MB // 5


def test_long_texts_free_style(spark):
    encode = bp.encoder(bp.default_tokenizer())
    assert len(encode(" " * MB)) == MB and encode("a" + " " * 5000 + "b")[-1] == encode(" b")[0]
    begin = time.time()
    many = ls.scan_text(LONG["choices"])
    assert many["labels"] == "mit" and many["permitted"] and len(many["expressions"].split()) == 2 * (MB // 7) + 1
    assert ls.scan_text(LONG["brackets"])["expressions"] == "mit"
    assert ls.identifiers(ls.parse_expression("a WITH b AND (c WITH (d OR e))")) == ["a", "c"]
    assert time.time() - begin < 60
    for t in LONG.values():
        sp.fingerprint(t)
        lf.predict([t], lf.build_filters({"en": np.array([1], np.uint64)}))


def test_empty_tables(spark):
    none = table(spark, [], ", lang string, source string")
    assert pii.pseudonymise(none).count() == sl.scan_versions(none)[0].count() == ls.license_scan(none).count() == 0
    assert bp.pack(none, bp.default_tokenizer()).count() == lf.identify(none, lf.fit(none)).count() == 0


def test_clashing_names(spark):
    df = table(spark, [(1, "cc by " * 20), (2, "cc by " * 20)])
    df = df.select("doc_id", "text", *(F.lit(9).alias(c) for c in ("doc", "tag", "sha", "whole", "fp", "component", "labels", "score", "_path", "_blob", "spans", "piece", "bin", "lang_pred", "known_share")))
    assert {r["n_removed"] for r in ri.remove_repeats(df).collect()} == {0, 120}
    assert {r["component"] for r in sp.near_duplicates(df).collect()} == {1}
    assert {r["labels"] for r in ls.license_scan(df).collect()} == {"cc-by"}
    assert sl.scan_versions(df)[0].count() == bp.pack(df, bp.default_tokenizer()).count() == 2
    filters = lf.fit(df.withColumn("lang", F.lit("en")))
    assert {(r["lang_pred"], r["tag"]) for r in lf.identify(df.union(df), filters).collect()} == {("en", 9)}


def test_repeated_rows(spark):
    df = table(spark, [(7, "call 212-555-0123")] * 3 + [(7, "SPDX-License-Identifier: MIT")] * 2)
    assert len({r["text"] for r in pii.pseudonymise(df).collect()}) == 2
    pieces = bp.pack(df, bp.default_tokenizer()).collect()
    assert len(pieces) == 5 and len({(r["sequence_id"], r["offset"]) for r in pieces}) == 5


def test_ties_of_the_seeded_order(spark):
    """Documents with one hash, which equal ids have, come or go together."""
    df = spark.createDataFrame([(i, "a b", "l", "s") for i in (1, 1, 2, 2)], "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, {"lang": F.col("lang"), "source": F.col("source")}, weights={}, share=0.5, max_epochs=1)
    assert [r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()] == [2]


# Repeats: rows of one id.


def test_two_texts_under_one_id(spark):
    own = "".join(chr(97 + i % 26) + str(i) for i in range(40))
    rows = [(1, "A" * 80), (2, "A" * 80), (2, own), (3, own), (3, "B" * 70 + own), (3, "B" * 70)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in ri.remove_repeats(table(spark, rows)).collect())
    n = len(own)
    assert got == sorted([(1, 80, 0), (2, 80, 80), (2, n, 0), (3, n, n), (3, 70 + n, n), (3, 70, 0)])


def test_repeats_of_the_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    first = {}
    for d, t in sorted(docs):
        b = t.encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for r in ri.op3_repeat_index(spark, sf).collect():
        b = dict(docs)[r["doc_id"]].encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < r["doc_id"]:
                gone[i] += 1
                gone[i + 50] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())


# The ledger.


def test_null_paths_are_scanned(spark):
    found, ledger = sl.scan_versions(table(spark, [(None, "password=hunter22x"), (None, "password=hunter22x"), (1, "x")]))
    assert sorted(len(r["spans"]) for r in found.collect()) == [0, 1, 1] and ledger.count() == 2


def test_second_scan_sees_new_blobs_only(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    _, first = sl.scan_versions(docs.where("doc_id % 2 = 0"))
    _, both = sl.scan_versions(docs, first)
    blobs = docs.select(F.sha2("text", 256)).distinct().count()
    assert both.count() == blobs > first.count() == docs.where("doc_id % 2 = 0").select(F.sha2("text", 256)).distinct().count()
    assert both.select("blob", "rule_version").distinct().count() == blobs


# Search.


def test_top_k_of_mixed_lengths_and_sizes(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(i % 290, [float(x) for x in r.choice([-1, 0, 0.5, 1], r.choice([2, 3, 3, 4]))]) for i in range(300)]
    rows += [(300, [1e8] * 4), (301, [1e8, -1e8, 3.0, 1.0]), (350, [2e6, 3e6, 1.0]), (351, [2e6, 3e6, 1.25]), (352, [2e6, 3e6, 1.0]), (353, [2e6, -3e6])]
    rows += [(400, [1.5e9, 1.5e9]), (401, [1.5e9, 7.0]), (1000, None), (1001, []), (1050, [float("nan"), 1.0]), (1100, [float("inf"), 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    same(topk_histogram.op9_topk_histogram(spark, str(tmp_path)), str(tmp_path), topk_histogram.ORACLE)


def test_one_longer_vector_changes_nothing(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 1.0, 9.0])], "vec_id long, embedding array<float>")
    v = topk_histogram.scaled(df, "vec_id", "embedding")
    got = sorted((r["query_id"], r["vec_id"], r["score"]) for r in topk_histogram.top_k(v, v).collect())
    assert got == [(0, 1, 4 * 65536), (1, 0, 4 * 65536)]


def test_waves(spark, monkeypatch):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, r.integers(-3, 4, 5 + i % 2).astype(float).tolist()) for i in range(120)], "vec_id long, embedding array<double>")
    v = topk_histogram.scaled(df, "vec_id", "embedding")
    want = sorted(map(tuple, topk_histogram.top_k(v.where("id < 30"), v).collect()))
    monkeypatch.setattr(topk_histogram, "WAVE_ROWS", 12)
    monkeypatch.setattr(topk_histogram, "BLOCK_ROWS", 5)
    assert sorted(map(tuple, topk_histogram.top_k(v.where("id < 30"), v).collect())) == want


# Pseudonyms by brute force.


class Brute:
    """The same permutations and checks in plain Python, one text at a time."""

    def __init__(self, key):
        self.key = key

    def digest(self, *parts):
        return int(hashlib.sha256("|".join([self.key, *map(str, parts)]).encode()).hexdigest()[:15], 16)

    def feistel(self, left, right, a, b, tweak):
        for i in range(pii.ROUNDS):
            if i % 2 == 0:
                left = (left + self.digest(tweak, i, right)) % a
            else:
                right = (right + self.digest(tweak, i, left)) % b
        return left, right

    def digits(self, d, kind):
        n, half = len(d), len(d) // 2
        x, y = self.feistel(int(d[:half] or 0), int(d[half:] or 0), 10**half, 10 ** (n - half), f"{kind}:{n}")
        return (str(x).zfill(half) if half else "") + (str(y).zfill(n - half) if n > half else "")

    @staticmethod
    def filled(token, digits):
        it = iter(digits)
        return re.sub("[0-9]", lambda _: next(it), token)

    def email(self, t):
        return f"user-{self.digest('email', t.lower()):015x}@pseudonym.invalid"

    def card(self, t):
        d = re.sub(r"\D", "", t, flags=re.A)
        if luhn(d):
            return None
        body = self.digits(d[:-1], "card")
        return self.filled(t, body + next(str(c) for c in range(10) if luhn(body + str(c)) == 0))

    def ip(self, t):
        p = [int(x) for x in t.split(".")]
        if max(p) > 255:
            return None
        return ".".join(str(b) for x in self.feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ip") for b in divmod(x, 256))

    def ssn(self, t):
        area, group, serial = map(int, t.split("-"))
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return None
        areas = [a for a in range(1, 900) if a != 666]
        x, y = self.feistel(areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
        return f"{areas[x // 99]:03}-{x % 99 + 1:02}-{y + 1:04}"

    def date(self, t):
        sep, p = re.search("[-/.]", t)[0], re.split("[-/.]", t)
        orders = [(0, 1, 2)] if len(p[0]) == 4 else [(2, 1, 0), (2, 0, 1)]
        for order in orders:
            y, m, d = (int(p[i]) for i in order)
            if 1900 <= y <= 2099 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]:
                n = (datetime.date(y, m, d) - datetime.date(1900, 1, 1)).days
                x, z = self.feistel(n // 4297, n % 4297, 17, 4297, "date")
                new = datetime.date(1900, 1, 1) + datetime.timedelta(x * 4297 + z)
                out = [""] * 3
                for i, v in zip(order, (new.year, new.month, new.day), strict=True):
                    out[i] = str(v).zfill(len(p[i]) if len(p[i]) != 1 else 1)
                return sep.join(out)
        return None

    def iban(self, t):
        s = t.replace(" ", "")
        if len(s) < 15 or mod97(s[4:] + s[:4]) != 1:
            return None
        d = re.sub("[^0-9]", "", s[4:])
        x = self.digits(d[:18], "iban") + self.digits(d[18:], "iban2") if d else ""
        body = self.filled(s[4:], x)
        return self.filled(t, f"{98 - mod97(body + s[:2] + '00'):02}" + x)

    def phone(self, t):
        plus = "+" * t.startswith("+")
        d = re.sub("[^0-9]", "", t)
        code = re.match(pii._CALLING_CODE, plus + d)
        kept = code[0][1:] if code else ""
        d = d[len(kept) :]
        if re.match(pii._NORTH_AMERICAN, d):
            x, y = self.feistel(int(d[:3]) - 200, (int(d[3:6]) - 200) * 10000 + int(d[6:]), 800, 8_000_000, "phone-north")
            return self.filled(t, f"{kept}{x + 200}{y // 10000 + 200}{y % 10000:04}")
        return self.filled(t, kept + self.digits(d, "phone")) if t[0] in "+(" else None

    def replaced(self, m):
        for kind in pii.KINDS:
            if re.fullmatch(pii.PATTERNS[kind], m[0], re.A):
                new = getattr(self, kind)(m[0])
                return m[0] if new is None else new
        raise AssertionError(m[0])

    def is_number(self, s):
        plain = s.replace(" ", "")
        if re.fullmatch(pii._CARD_GROUPS, s, re.A):
            return luhn(re.sub("[^0-9]", "", s)) == 0
        return bool(re.fullmatch(pii.PATTERNS["iban"], s, re.A)) and len(plain) >= 15 and mod97(plain[4:] + plain[:4]) == 1

    def pieces(self, text):
        """Valid numbers with other groups beside them stand alone."""
        out, open_, at = [], "", 0
        for m in re.finditer(pii._CHAIN, text, re.A):
            open_, at = open_ + text[at : m.start()], m.end()
            groups, i = re.findall("[ -]?[A-Z0-9]+", m[0]), 0
            while i < len(groups):
                lead = groups[i][0] if groups[i][0] in " -" else ""
                for j in range(min(i + pii._MOST_GROUPS, len(groups)), i, -1):
                    span = "".join(groups[i:j])[len(lead) :]
                    if self.is_number(span):
                        out += [open_ + lead, span]
                        open_, i = "", j
                        break
                else:
                    open_, i = open_ + groups[i], i + 1
        return [*out, open_ + text[at:]]

    def text(self, t):
        if t is None:
            return None
        parts = self.pieces(t) if re.search(pii._LONG, t) else [t]
        return "".join(re.sub(pii.CANDIDATE, self.replaced, p, flags=re.A) for p in parts)


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


ODD = [
    None, "", "no digits", "4111 1111 1111 1111 12/25", "BE68 5390 0754 7034 ASAP", "BE68 5390 0754 7034 USD 5", "BE68539007547034 EUR 5", "ES91 2100 0418 4502 0005 1332",
    "100-200-3000 parts", "212-555-1234 or +1 (212) 555-1234 or (017) 555-1234", "+49 30 1234567 and +4930123456789", "10.0.0.1, 300.1.1.1, 1.2.3.4.5", "1999-02-29 2000-02-29 31/12/1999 12/31/1999 1.2.2003",
    "078-05-1120 666-12-3456 000-12-3456", "A.b@x.org a.B@X.ORG c@d", "3782 822463 10005", "4111111111111112", "5500-0000-0000-0004 7",
]


def test_pseudonyms_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(table(spark, list(enumerate(ODD, 10**9))))
    brute = Brute(pii.KEY)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs).collect()}
    assert len(after) == len(before)
    for d, t in before.items():
        assert after[d] == brute.text(t), t
    kept = [after[10**9 + i] for i, t in enumerate(ODD) if t in ("100-200-3000 parts", "4111111111111112", "no digits")]
    assert kept == ["no digits", "100-200-3000 parts", "4111111111111112"]
    assert after[10**9 + 10].startswith("+49 ") and "+49" in after[10**9 + 10].split("and")[1]


# Staging and the pipeline.


def test_staged_tables_are_removed(spark):
    df = common.staged(spark.range(3).toDF("x"), "some")
    assert df.count() == 3
    common.remove_staged(spark)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_no_temporary_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_pipeline_stages_keep_clashing_columns(spark):
    import corpus_pipeline as cp

    words = "the cat and the dog and the bird sit on the mat by the door of the old house in the sun"
    text = lambda i: f"{words} {i} {words} mail a{i}@example.org"
    clash = ("_lang", "_score", "_before", "_node", "_row", "lang_pred", "known_share", "pii", "node", "first", "_epoch", "_tokens")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, text(i), "en" if i else None, "s", len(text(i))) for i in range(40)] + [(99, "xqj zvkq wpfx " * 30, None, "s", 420)], schema)
    docs = docs.select("*", *(F.lit(777).alias(c) for c in clash))
    out = docs
    for name, stage in cp.STAGES[:3]:
        out = stage(spark, out, None)
        assert out.columns == docs.columns
        assert {r[c] for r in out.collect() for c in clash} == {777}, name
        if name == "language_id":
            assert out.count() == 40 and out.where("lang is null").count() == 0
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_pipeline_of_no_rows_and_of_repeats(spark):
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], schema)
    for _, stage in cp.STAGES:
        assert stage(spark, none, None).count() == 0
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = spark.createDataFrame([(1, a, "en", "s", 5)] * 3 + [(2, a, "en", "s", 5), (2, b, "en", "s", 5), (None, a, None, None, None)], schema)
    assert sorted((r["doc_id"], r["text"]) for r in cp.drop_near_duplicates(spark, rows, None).collect()) == [(1, a), (2, b)]
