"""Profiles, pairs, evaluation and planning on literal tables."""

import json
import re

import pytest
from pyspark.sql import functions as F

from marlstone.operators import calc, evaluate, index, pairs, profiles


def test_clusters(spark):
    sims = {("accounting", "treasury"): 0.9, ("engineering", "maintenance"): 0.8, ("hr", "training"): 0.85}
    names = ["accounting", "engineering", "hr", "maintenance", "training", "treasury"]
    rows = [(a, b, sims.get((a, b), 0.05)) for i, a in enumerate(names) for b in names[i + 1 :]]
    df = spark.createDataFrame(rows, "a string, b string, similarity double")
    found, merges = profiles.cluster(df, names)
    assert sorted(map(tuple, found.values())) == [("accounting", "treasury"), ("engineering", "maintenance"), ("hr", "training")]
    assert len(merges) == 3
    two, _ = profiles.cluster(df, names, n_families=1, most=4)
    assert sorted(len(v) for v in two.values()) == [2, 4]
    fam = spark.createDataFrame([(m, label) for label, ms in found.items() for m in ms], "compartment string, family string")
    assert all(r["margin"] > 0.7 for r in profiles.cohesion(df, fam).collect())
    assert all(r["agrees"] for r in profiles.compare(df, fam).collect())


def test_routing(spark):
    rows = [(i, f"invoice total amount due number {i}", "extract") for i in range(8)] + [(10 + i, f"is this message angry happy or sad {i}", "classify") for i in range(8)]
    train = spark.createDataFrame(rows, "row long, text string, skill string")
    cents, idf = profiles.centroids(train, "skill")
    ask = spark.createDataFrame([(1, "total due on the invoice"), (2, "angry or sad message"), (3, "zzz")], "rid long, text string")
    got = {r["rid"]: r for r in profiles.route(profiles.route_scores(ask, cents, idf)).collect()}
    assert (got[1]["skill"], got[2]["skill"], got[3]["score"], got[3]["margin"]) == ("extract", "classify", 0.0, 0.0)
    assert got[1]["margin"] > 0.1


def test_messy_teachers():
    raw = 'Sure! {"prompt": "a", "response": "b"}\n[{"prompt": "c", "response": "d"}, {"prompt": ""}] and {broken'
    assert pairs.pairs_in(raw) == [{"prompt": "a", "response": "b"}, {"prompt": "c", "response": "d"}]
    assert pairs.pairs_in("none") == []


def test_generation_resumes_and_reports(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}", "s", "x") for i in range(30)], "id string, text string, source string, compartment string")

    def teacher(prompt):
        return "nothing" if "text 7" in prompt else json.dumps([{"prompt": f"p{k}", "response": "r"} for k in range(5)])

    out = pairs.generate(chunks, {"*": teacher}, per_chunk=3, test_fraction=0.34).persist()
    assert out.where("prompt is not null").count() == 29 * 3
    assert out.where("error is not null").select("source_chunk").collect()[0][0] == "c7"
    sides = out.groupBy("source_chunk").agg(F.countDistinct("test").alias("n")).where("n > 1")
    assert sides.isEmpty() and 0 < out.where("test").count() < out.count()
    again = pairs.generate(chunks, {"*": teacher}, done=out.select("source_chunk").distinct())
    assert again.count() == 0
    with pytest.raises(ValueError, match="per_chunk"):
        pairs.generate(chunks, {"*": teacher}, per_chunk=0)
    with pytest.raises(ValueError, match="no chunk"):
        pairs.generate(chunks, {"*": teacher}, compartment="y")


def test_seeds(spark):
    seeds = spark.createDataFrame([("a",), ("b",), ("",), ("a",)], "prompt string")
    out = pairs.generate_from_seeds(seeds, lambda p: "<think>x</think> done", "Do it.")
    assert sorted((r["prompt"], r["response"]) for r in out.collect()) == [("a", "done"), ("b", "done")]


def test_answer_window():
    text = "filler words here. " * 40 + "The clearance is 0.418 mm cold. " + "more filler text. " * 40
    cut = pairs.answer_window(text, "clearance 0.418", 600)
    assert "0.418" in cut and len(cut) <= 600
    assert pairs.answer_window("short", "x", 600) == "short"
    assert pairs.answer_window("a" * 700, "zzzz", 600) == "a" * 600


@pytest.mark.parametrize("hard", [True, False])
def test_grounding(spark, hard):
    rows = [(f"e{i}", f"Pump P-{4000 + i} has a clearance of 0.{400 + i} mm and runs all day", f"e/{i}.txt", "eng") for i in range(6)] + [(f"f{i}", f"Contract {i} is worth {i} million", f"f/{i}.txt", "fin") for i in range(3)]
    chunks = spark.createDataFrame(rows, "id string, text string, source string, compartment string")
    made = spark.createDataFrame([("What clearance?", "0.401 mm clearance", "e1"), ("What runs?", "0.402 mm clearance", "e2"), ("?", "lost", "gone")], "prompt string, response string, source_chunk string").withColumn("source", F.lit("s"))
    made = made.drop("source").join(chunks.select(F.col("id").alias("source_chunk"), "source"), "source_chunk", "left")
    run = lambda **kw: sorted(map(tuple, pairs.ground(made, chunks, hard=hard, **kw).collect()))
    first = run(abstain_share=0.0)
    assert first == run(abstain_share=0.0) and len(first) == 2
    for r in first:
        assert "Contract" not in r[3] and r[4] != "" and not r[5]
    assert all(r[5] and "does not contain the answer" in r[4] for r in run(abstain_share=1.0))
    lost = pairs.ground(made, chunks, abstain_share=0.0, most=10, hard=hard).collect()
    assert all(r["unanswerable_after_trim"] == r["abstain"] for r in lost)
    assert pairs.unmatched(made, chunks).count() == 1


def test_reports(spark):
    rows = spark.createDataFrame([("q", "red", "red", "a"), ("q", "red", "blue", "a"), ("q", "x", "x", None)], "prompt string, expected string, output string, skill string")
    scored = evaluate.score(rows, "exact")
    assert {r["skill"]: (r["n"], r["score"]) for r in evaluate.report(scored).collect()} == {"a": (2, 0.5), "(unlabeled)": (1, 1.0), "(all)": (3, 0.666667)}
    assert {r["change"] for r in evaluate.report(scored, scored).collect()} == {0.0}
    assert evaluate.length_stats(rows.limit(0), "output").count() == 0


def test_merges(spark):
    d = spark.createDataFrame([("a", "w", 0, 0, 1.0), ("a", "w", 0, 1, -0.1), ("b", "w", 0, 0, -3.0), ("b", "w", 0, 1, 0.2)], "part string, name string, i int, j int, v double")
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "part string, w double")
    cells = lambda df: {(r["i"], r["j"]): round(r["v"], 6) for r in df.collect()}
    assert cells(calc.merge_linear(d, w)) == {(0, 0): -2.0, (0, 1): 0.1}
    assert cells(calc.merge_ties(d, w, density=0.5)) == {(0, 0): -3.0}
    assert cells(calc.merge_ties(d, w, density=1.0)) == {(0, 0): -3.0, (0, 1): 0.2}
    assert cells(calc.merge_dare(d, w, drop=0.0)) == cells(calc.merge_linear(d, w))
    a = spark.createDataFrame([("s", "w", 0, 0, 2.0), ("s", "w", 0, 1, 3.0)], "part string, name string, r int, j int, v double")
    b = spark.createDataFrame([("s", "w", 0, 0, 5.0)], "part string, name string, i int, r int, v double")
    assert cells(calc.dense(a, b, 2.0)) == {(0, 0): 20.0, (0, 1): 30.0}
    assert calc.shift_ratio(d, d).first()["ratio"] == 1.0


def test_bundles(spark):
    was = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    now = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, sha256 string")
    assert {tuple(r) for r in calc.bundle_verify(was, now).collect()} == {("b", "changed"), ("c", "missing"), ("d", "extra")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_and_places_stay_where_their_text_is(spark):
    docs = spark.createDataFrame([(1, "a b a", "x"), (1, "a c", "x"), (2, "b c d", "y"), (3, None, "y")], "row long, text string, skill string")
    counts = index.term_counts(docs)
    assert sorted(map(tuple, counts.collect())) == [(1, "a", 3), (1, "b", 1), (1, "c", 1), (2, "b", 1), (2, "c", 1), (2, "d", 1)]
    for df in (counts, index.hash_vectors(docs)):
        dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(df))
        assert dealt and all(re.match(r"row#\d+L?, \d+$", x) for x in dealt)


def test_links_of_some_rows(spark, sf):
    chunks = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("row"), "text")
    n, counts = chunks.count(), index.term_counts(chunks).persist()
    idf = index.smooth_idf(counts, n)
    rows = chunks.where("row % 7 = 0").select("row")
    some = sorted(map(tuple, index.links_of(rows, counts, idf, n).select("src", "dst", "weight", "rank").collect()))
    every = index.links(counts, idf, n).where("src % 7 = 0").select("src", "dst", "weight", "rank")
    assert some == sorted(map(tuple, every.collect())) and some


def test_weights_of_labels_are_summed_where_their_terms_are(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b {i % 3} c{i % 4}", "xy"[i % 2]) for i in range(20)] + [(20, "a b", None)], "row long, text string, skill string")
    rows = lambda df: sorted((r["skill"], r["term"], round(r["weight"], 9)) for r in df.collect())
    cents, idf = profiles.centroids(docs, "skill")
    assert "hashpartitioning(skill" not in "".join(x for x in plan_of(cents).splitlines() if "term#" in x)
    monkeypatch.setattr(index, "NORMS", 0)  # as for more rows than are sent to all tasks
    monkeypatch.setattr(profiles, "LABELS", 0)
    assert rows(cents) == rows(profiles.centroids(docs, "skill")[0]) and rows(cents)
