"""Text functions and scorers on literal values."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import scoring as sc
from marlstone.functions import text as tx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "tokens"), [
    ("Oven KX-77 draws 9A, see v1.4_b", ["oven", "kx-77", "draws", "9a", "see", "v1.4_b"]),
    ("Ångström œuvre", ["ångström", "œuvre"]),
    ("γάτα τρώει ψάρι", ["γάτα", "τρώει", "ψάρι"]),
    ("חתול ישן", ["חתול", "ישן"]),
    ("_ -- .", []),
])
def test_tokens_keep_codes_and_scripts(spark, text, tokens):
    assert one(spark, tx.tokens(F.col("t")), t=text) == tokens


def test_long_texts(spark):
    """A long joined token, a long run without an @, and long white space, of 1 MB each."""
    n = 1 << 20
    joined = spark.createDataFrame([("a" + ".a" * (n // 2),), ("a@b" + ".a" * (n // 2),), ("a" * n,), ("x" + "\u2003" * n + "y",)], "t string")
    got = joined.select(F.size(tx.tokens(F.col("t"))).alias("n"), F.length(tx.redact(F.col("t"))).alias("r"), F.length(tx.strip_think(F.col("t"))).alias("s")).collect()
    assert [r["n"] for r in got] == [1, 2, 1, 2]
    assert [r["r"] for r in got] == [n + 1, len("[email removed]"), n, n + 2] and got[3]["s"] == n + 2


@pytest.mark.parametrize("text", ["a@b.c+d@e.f", "a@b.c.d@e.f x@y", "+a@b.co,c@d.eu", "a@b", "é_1.x@ö-b.ü", "@a.b a@@b.c"])
def test_addresses_are_those_of_the_pattern(spark, text):
    want = re.sub(r"[^\W]*[\w.+-]+@[\w-]+\.[\w.-]+", "[email removed]", text)
    assert one(spark, F.regexp_replace(F.col("t"), tx._EMAIL, "[email removed]"), t=text) == want == one(spark, F.regexp_replace(F.col("t"), tx.EMAIL, "[email removed]"), t=text)


FEATURES = {
    "": [],
    "q": ["q"],
    "wxyz": ["wxyz"],
    "wxyzw": ["wxyzw", "wxyz"],
    "Tea for-2 cups": ["tea", "for-2", "cups", "tea_for-2", "for-2_cups", "tea ", "a fo", "for-", "r-2 ", "2 cu"],
    "no no no": ["no"] * 3 + ["no_no"] * 2 + ["no n", " no "],
}


@pytest.mark.parametrize("text", FEATURES)
def test_features(spark, text):
    assert Counter(one(spark, tx.features(F.col("t")), t=text)) == Counter(FEATURES[text])


def test_redaction(spark):
    text = "Ask lea.m@shop.example, ring (0)30 901 820 55"
    assert one(spark, tx.redact(F.col("t")), t=text) == "Ask [email removed], ring ([phone removed]"
    counts = tx.redaction_counts(F.col("t"))
    assert [one(spark, counts[k], t=text) for k in ("email", "phone", "card")] == [1, 1, 0]


def test_redacted_text_is_that_of_its_sql(spark, tmp_path):
    from compare import same

    from marlstone.plans.registry import ORACLES, QUERIES

    texts = ["a 4387393285946913 +1 (438) 555-5819 b", "94.182.225.142 +1 (705) 555-1902", "1234567890+1234567890", "1234567890x12 3456789012", "1234567890 1x", "+1 705 555 1902\n", "1234567890x1234567890y1234567890"]
    texts += ["é4111111111111111", "4111-1111-1111-1111-", "4111 1111 1111 1111 x", "1\x0b234567890123", "1\u00a0705\u00a0555\u00a01902", "\u0661" * 12, "a@b.c +1 705 555 1902", "-1234567890", "1234567890-", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same(QUERIES["redacted_text"](spark, str(tmp_path)), str(tmp_path), ORACLES["redacted_text"])


def test_compartments(spark):
    c = tx.compartment_of(F.col("p"))
    assert [one(spark, c, p=p) for p in ("top.md", "garden/roses.pdf", "kitchen/a/b/menu.csv")] == ["public", "garden", "kitchen"]


def test_think_blocks(spark):
    c = tx.strip_think(F.col("t"))
    assert one(spark, c, t="<think>never closed") == ""
    assert one(spark, c, t=" one <think>p</think>two<think>q</think> ") == "one two"


def test_file_names(spark):
    c = tx.file_name(F.col("u"), F.lit("text/html"))
    assert one(spark, c, u="https://x.org/a/b%20c.pdf?q=1") == "b c.pdf"
    assert one(spark, c, u="https://x.org/") == "download.html"
    assert one(spark, c, u="https://x.org/a/page/") == "page.html"
    assert one(spark, c, u="https://x.org/a+b*c") == "a_b_c.html"


def test_model_size(spark):
    c = tx.model_size(F.col("m"))
    assert one(spark, c, m="some/model-12b-chat") == 12
    assert one(spark, c, m="./folder/") is None


def test_scorers(spark):
    o, e = F.col("o"), F.col("e")
    assert one(spark, sc.score_contains(o, e), o="nine of 31 were red", e="31") == 1
    assert one(spark, sc.score_json_field(o, e), o='here: {"age":7} ok', e='{"age":7,"name":"Bo"}') == 0.5
    assert one(spark, sc.score_json_field(o, e), o='{"cost":"$2,350"}', e='{"cost":2350}') == 1
    assert one(spark, sc.score_json_field(o, e), o="no json", e='{"cost":2350}') == 0
    assert one(spark, sc.score_overlap(o, e), o="red red blue", e="red green") == pytest.approx(0.4)
    assert one(spark, sc.score_overlap(o, e), o="", e="red") == 0
    assert one(spark, sc.score_refusal(o, e), o=sc.REFUSAL, e="four") == 0
    assert one(spark, sc.values_match(o, e), o="$31", e="31.0") is True


def test_support(spark):
    passages = "Oven KX-77 bakes for 0.75 h at 1250 W; tray T-3 holds 18 loaves."
    check = sc.support_check(F.col("a"), F.lit(passages))

    def of(answer):
        return {k: one(spark, c, a=answer) for k, c in check.items()}

    assert of("It takes 6.5 to 9.0 here")["bad_numbers"] == ["6.5", "9"]
    assert of("See KX-78")["bad_identifiers"] == ["KX78"]
    assert of("KX77 bakes 0.750 at 1,250")["supported"] is True
    assert of(sc.REFUSAL)["reason"] == "refusal"
    assert of("Penguins gather slowly beside frozen southern coastlines")["reason"].startswith("almost nothing")
    assert of(None)["supported"] is True


def test_prompt_round_trip(spark):
    prompt = f"{sc.GROUNDED_HEAD}\n\n[a]\nx\nQuestion: inner?\n\nQuestion: real?"
    assert one(spark, sc.passages_from_prompt(F.col("p")), p=prompt) == "\n\n[a]\nx\nQuestion: inner?\n"


def test_secret_on_digit_boundary(spark):
    c = sc.contains_secret(F.col("a"), F.col("s"))
    assert one(spark, c, a="about 318.07 g", s="18.07") is False
    assert one(spark, c, a="about 18.07 g", s="18.07") is True


def test_answer_presence(spark):
    c = sc.answer_is_present(F.col("a"), F.col("p"))
    assert one(spark, c, a="31 g", p="empty") is True  # no longer term to look for
    assert one(spark, c, a="weight 18.075", p="its weight is 18.075 g") is True
    assert one(spark, c, a="weight 18.075", p="its colour") is False


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="ab1_-. ,é", max_size=60))
def test_tokens_property(spark, text):
    assert one(spark, tx.tokens(F.col("t")), t=text) == re.findall(r"[^\W_]+(?:[-_.][^\W_]+)*", text.lower())
