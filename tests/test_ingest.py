"""Files to chunks, sources and sinks, and the stream."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.operators import ingest
from marlstone.sources import extract, files
from marlstone.streaming import ingest as streaming


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    for path, content in {
        "notes.txt": b"Plain notes about pumps. They run.",
        "finance/copy of notes.txt": b"Plain notes about pumps. They run.",
        "finance/page.html": b"<html><script>var x='</p>';</script><p>Caf&eacute;</p><div>two</div></html>",
        "hr/data.xyz": b"?",
        "hr/broken.pdf": b"not a pdf",
        "hr/gauge.png": b"png",
        "hr/.hidden/x.txt": b"hidden",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    return str(root)


def test_folder_to_chunks(spark, corpus):
    found = extract.extract(files.folder(spark, corpus))
    chunks, manifest = ingest.ingest(found)
    status = {r["path"]: r["status"] for r in manifest.collect()}
    assert status == {"notes.txt": "duplicate", "finance/copy of notes.txt": "ok", "finance/page.html": "ok", "hr/data.xyz": "skipped", "hr/broken.pdf": "error", "hr/gauge.png": "skipped"}
    texts = {r["source"]: (r["compartment"], r["text"]) for r in chunks.collect()}
    assert texts["finance/page.html"] == ("finance", "Café\ntwo")
    assert len(texts) == 2


def test_images_go_through_a_function(spark, corpus):
    found = extract.extract(files.folder(spark, corpus), vision=lambda content: "a gauge")
    chunks, _ = ingest.ingest(found, vision=True)
    assert ("hr", "image", "a gauge") in {(r["compartment"], r["kind"], r["text"]) for r in chunks.collect()}


def test_duplicates_within_compartments(spark):
    rows = spark.createDataFrame([("a/1.txt", "h"), ("b/1.txt", "h"), ("b/2.txt", "h")], "path string, sha256 string")
    status = {r["path"]: r["status"] for r in ingest.manifest(rows, scope="compartment").collect()}
    assert status == {"a/1.txt": "ok", "b/1.txt": "ok", "b/2.txt": "duplicate"}


def test_cuts():
    pieces = ingest.cut_text(("word " * 2000).strip(), 1000, 100)
    assert len(pieces) > 5 and all(len(p) <= 1000 for _, p in pieces)
    assert sum(p.count("word") for _, p in pieces) >= 2000
    assert all(b < a + len(p) for (a, p), (b, _) in zip(pieces, pieces[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400), st.integers(4, 60))
def test_cuts_cover_and_end(text, size):
    pieces = ingest.cut_text(text, size, size // 2)
    kept = "".join(text.split())
    assert all(len(p) <= size for _, p in pieces)
    assert bool(pieces) == bool(kept)


def test_overlap_that_could_step_back_is_refused(spark):
    with pytest.raises(ValueError):
        ingest.chunks(spark.createDataFrame([("x",)], "text string"), 100, 51)


def test_null_and_empty_texts_give_no_chunks(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", " \n "), ("d", "x")], "source string, text string")
    assert [r["source"] for r in ingest.chunks(df).collect()] == ["d"]


def test_ranks_and_strides(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    assert [r["_rank"] for r in ingest.with_ranks(df, "k").orderBy("k").collect()] == list(range(1000))
    assert sorted(r["k"] for r in ingest.stride_sample(df, 7, "k").collect()) == list(range(0, 1000, 143))
    assert ingest.with_ranks(df.where("k < 0"), "k").count() == 0


def test_unlabelled_rows_are_refused(spark):
    df = spark.createDataFrame([("a",), (None,)], "compartment string")
    with pytest.raises(Exception, match="no compartment"):
        ingest.require_labels(df).collect()
    assert {r[0] for r in ingest.require_labels(df, "public").collect()} == {"a", "public"}


def test_left_out(spark):
    df = spark.createDataFrame([("a.xyz",), ("b.xyz",), ("c.q",), ("d.txt",)], "path string")
    assert [(r["ext"], r["n"]) for r in ingest.left_out(df).collect()] == [("xyz", 2), ("q", 1)]


def test_json_lines(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"a": 1, "b": 2}\n\n{"a": 3, "b": 4, "c": 5}\n')
    assert files.json_lines(spark, str(good), ("a", "b")).count() == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n{"b": 2}\n')
    with pytest.raises(ValueError, match="line 2: missing"):
        files.json_lines(spark, str(bad), ("a",))
    broken = tmp_path / "broken.jsonl"
    broken.write_text('{"a": 1}\nnope\n')
    with pytest.raises(ValueError, match="line 2: invalid JSON"):
        files.json_lines(spark, str(broken), ("a",))
    empty = tmp_path / "empty.jsonl"
    empty.write_text("\n")
    with pytest.raises(ValueError, match="no usable row"):
        files.json_lines(spark, str(empty), ("a",))


def test_list_files(spark, tmp_path):
    p = tmp_path / "urls.txt"
    p.write_text("# all\nhttps://x\n\n https://y \n")
    assert sorted(r[0] for r in files.lines(spark, str(p), comments=True).collect()) == ["https://x", "https://y"]


def test_append_is_idempotent(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert [files.append_new(rows, out, "k"), files.append_new(rows, out, "k")] == [2, 0]
    assert spark.read.parquet(out).count() == 2


def test_plans(spark, tmp_path):
    plan = {"compartments": {"a": {"tier": "company", "folders": "x", "family": "f"}, "b": {"folders": ["y"]}}, "principals": {"p": {"reads": ["a", "b"]}, "q": {"reads": "a"}}}
    path = tmp_path / "plan.json"
    path.write_text(json.dumps(plan))
    policy, families = files.load_plan(spark, str(path))
    policy.require()
    assert {tuple(r) for r in families.collect()} == {("a", "f"), ("b", "b")}
    with pytest.raises(ValueError) as e:
        files.parse_plan({"compartments": {"a b": {"tier": "x", "odd": 1}}, "principals": {"p": {"reads": ["z"]}}})
    assert all(s in str(e.value) for s in ("usable name", "unknown tier", "unknown field", "reads unknown", "no folder"))


def test_recipes():
    assert files.parse_recipe({"base_model": "m", "strata": [{"name": "a", "data": "x"}]})
    with pytest.raises(ValueError, match="unknown key"):
        files.parse_recipe({"base_model": "m", "strata": [{"name": "a", "data": "x"}], "odd": 1})


def test_stream_adds_nothing_twice(spark, tmp_path):
    src, out, mark = (str(tmp_path / d) for d in ("src", "out", "mark"))
    rows = spark.createDataFrame([("a/1.txt", "h1", "one two"), ("b/2.txt", "h1", "one two"), ("b/3.txt", "h2", "three")], streaming.FILES)
    rows.write.parquet(src)
    for _ in range(2):
        q = streaming.ingest_stream(streaming.file_stream(spark, src), out, mark)
        q.awaitTermination()
        rows.where("sha256 = 'h2'").write.mode("append").parquet(src)
    q = streaming.ingest_stream(streaming.file_stream(spark, src), out, mark)
    q.awaitTermination()
    assert {(r["source"], r["compartment"]) for r in spark.read.parquet(out).collect()} == {("a/1.txt", "a"), ("b/3.txt", "b")}
    assert spark.read.parquet(out).count() == 2
