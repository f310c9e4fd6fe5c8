"""Quality rules, secret ledger and pseudonyms: twins, round trips and odd inputs."""

import hashlib
import re

import pytest
from compare import same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import pii_feistel as pii
from marlstone.llm import quality_rules as qr
from marlstone.llm import secret_ledger as sl

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (5, "é" * 10), (6, "word " * 3000)]


def table(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


@pytest.mark.parametrize("name", ["op2_quality_rules", "op7_mixing", "op8_secret_ledger", "op9_topk_histogram"])
def test_twins(spark, sf, name):
    from marlstone.llm.registry import ORACLES, QUERIES

    same(QUERIES[name](spark, sf), sf, ORACLES[name])


def test_quality_odd_inputs(spark):
    df = table(spark, ODD).withColumn("_words", F.lit(1)).withColumn("_text", F.lit("clash"))
    out = {r["doc_id"]: r for r in qr.quality_rules(df).collect()}
    assert [out[i]["n_words"] for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1]
    assert not any(out[i]["kept"] for i in out)
    assert out[6]["n_repeat_words"] == 3000 and out[6]["base_failed"]
    assert qr.quality_rules(table(spark, [])).count() == 0


def brute_repeats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = list(zip(w, w[1:], w[2:], strict=False))
    return len({i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(3)})


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=40), min_size=1, max_size=8))
def test_repeated_words(spark, texts):
    got = {r["doc_id"]: r["n_repeat_words"] for r in qr.measures(table(spark, list(enumerate(texts)))).collect()}
    assert got == {i: brute_repeats(t) for i, t in enumerate(texts)}


def test_clean_documents_stay(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    both = qr.op2_quality_rules(spark, sf).join(labels, "doc_id")
    assert both.where("quality = 1 and not base_failed and not kept").count() == 0
    assert both.where("quality = 0 and kept").count() <= 0.05 * both.where("quality = 0").count()


def test_ledger_scans_only_what_is_new(spark):
    v1 = table(spark, [(1, 'x token = "abcdef0123456789"'), (2, "clean"), (3, 'x token = "abcdef0123456789"'), (4, None)])
    found, ledger = sl.scan_versions(v1)
    assert ledger.count() == 3  # copies once, the null text as the empty blob
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in found.collect()}
    assert spans[1] == spans[3] == [("assign", 2, 27)] and spans[2] == spans[4] == []
    v2 = v1.unionByName(table(spark, [(5, "AKIA" + "A" * 16), (2, "clean")]))
    found2, ledger2 = sl.scan_versions(v2, ledger)
    assert ledger2.count() == 4 and found2.count() == 6
    other = (*sl.RULES, sl.SecretRule("word", "clean", 0, 1))
    found3, ledger3 = sl.scan_versions(v2, ledger2, rules=other)
    assert ledger3.count() == 8  # a new rule version scans all blobs again
    assert [s["kind"] for r in found3.where("doc_id = 2").collect() for s in r["spans"]] == ["word", "word"]


def brute_spans(text):
    text = text or ""
    out = []
    for kind, pattern, group, least in (("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least for k in [("assign", "access", "hex").index(kind)]]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["token=", "secret: ", "API_key = '", "abcdef", "0123456789abcdef01234567", "AKIA", "ABCDEFGH12345678", " ", "é", "password=token=", "x"]), max_size=9), min_size=1, max_size=8))
def test_spans_against_brute_force(spark, pieces):
    texts = ["".join(p) for p in pieces]
    df = table(spark, list(enumerate(texts)))
    found, _ = sl.scan_versions(df, rules=tuple(r for r in sl.RULES if r.base))
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", sl.joined(F.col("spans")).alias("s")).collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_prefix_sums(spark):
    from marlstone.llm.common import prefix_sums

    for n in (0, 1, 2, 5, 16, 17, 100):
        row = spark.range(1).select(F.array(*[F.lit(i * i).cast("long") for i in range(n)]).cast("array<long>").alias("a")).select(prefix_sums(F.col("a")).alias("p")).first()
        assert row["p"] == [sum(i * i for i in range(k)) for k in range(n)]


def rewritten(spark, *texts, key=pii.KEY):
    df = pii.pseudonymise(table(spark, list(enumerate(texts))), key)
    return [r["text"] for r in df.orderBy("doc_id").collect()]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_pseudonyms_keep_formats_and_links(spark):
    a, b = rewritten(spark, "card 4111 1111 1111 1111 and 1990-02-28, 10.0.0.255; +1 (017) 555-7713", "4111111111111111 / 10.0.0.255 or DE89 3704 0044 0532 0130 00")
    assert re.fullmatch(r"card \d{4} \d{4} \d{4} \d{4} and \d{4}-\d\d-\d\d, \d+\.\d+\.\d+\.\d+; \+1 \(\d{3}\) \d{3}-\d{4}", a)
    card = a[5:24]
    assert card != "4111 1111 1111 1111" and luhn(card) % 10 == 0
    assert b.startswith(card.replace(" ", ""))  # the same value in another format
    assert re.search(r"; ", a) and a.split(", ")[1].split(";")[0] in b
    assert "DE89" not in b and re.search(r"[A-Z]{2}\d\d \d{4} \d{4} \d{4} \d{4} \d\d", b)
    assert rewritten(spark, "4111111111111111", key="other") != rewritten(spark, "4111111111111111")


def test_invalid_values_stay(spark):
    same_ = ["4111111111111112", "300.1.1.1", "1999-13-01", "666-12-1234", "Version 2.0", "v1.2.3.4.5", "", "no digits", "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"]
    assert rewritten(spark, *same_) == same_
    assert rewritten(spark, "a", None)[1] is None


def test_numbers_beside_other_groups(spark):
    card, iban = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    texts = [f"{card} 12/25", "4111111111111111 123", f"{iban} EUR", f"12 {card}", "4111-1111-1111-1111-123", f"{card} 12 5500 0000 0000 0004 7", f"{iban} DE89 3704 0044 0532 0130 00", f"{card} 10.0.0.1", "3782 822463 10005 1234 at +1 (017) 555-7713", card, iban]
    out = rewritten(spark, *texts)
    new_card, new_iban = out[-2:]
    assert luhn(new_card) % 10 == 0 and card not in new_card and iban != new_iban
    assert out[0] == f"{new_card} 12/25" and out[1] == new_card.replace(" ", "") + " 123" and out[2] == f"{new_iban} EUR"
    assert out[3] == f"12 {new_card}" and out[4] == new_card.replace(" ", "-") + "-123"
    assert out[5].startswith(f"{new_card} 12 ") and out[5].endswith(" 7") and "5500 0000" not in out[5]
    assert out[6].startswith(f"{new_iban} DE") and "3704" not in out[6]
    assert out[7].startswith(f"{new_card} ") and "10.0.0.1" not in out[7]
    assert re.fullmatch(r"\d{4} \d{6} \d{5} 1234 at \+1 \(\d{3}\) \d{3}-\d{4}", out[8]) and "822463" not in out[8] and "7713" not in out[8]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_digits_are_permuted(spark, n):
    df = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
    got = [r["p"] for r in df.select(pii.permuted_digits(F.col("d"), pii.KEY, "t").alias("p")).collect()]
    assert sorted(got) == [str(i).zfill(n) for i in range(10**n)]


def test_dates_are_permuted(spark):
    days = spark.sql("select cast(date_add(date'1900-01-01', cast(id as int)) as string) as d, id from range(0, 73049)")
    out = days.repartition(4).select(pii._date(F.col("d"), pii.KEY).alias("p"))
    r = out.agg(F.countDistinct("p").alias("n"), F.min("p").alias("a"), F.max("p").alias("b")).first()
    assert (r["n"], r["a"], r["b"]) == (73049, "1900-01-01", "2099-12-31")


def test_other_columns_and_names_survive(spark):
    df = spark.createDataFrame([(1, "a.b@x.org", "keep", 5, 6)], "doc_id long, text string, _found string, _new int, pii int")
    r = pii.pseudonymise(df).first()
    assert (r["_found"], r["_new"], r["pii"]) == ("keep", 5, ["email"]) and "@x.org" not in r["text"]


def test_planted_values_go(spark, sf):
    out = pii.op1_pii_feistel(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("before")), "doc_id").collect()
    hits = 0
    for r in out:
        for pattern in (r"[\w.+-]+@mail\d\.example\.com", r"\+1 \(\d{3}\) 555-\d{4}", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)"):
            for v in re.findall(pattern, r["before"]):
                hits += 1
                assert v not in r["text"]
        if r["n_replaced"] == 0:
            assert r["text"] == r["before"]
    assert hits > 5


def test_base_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
