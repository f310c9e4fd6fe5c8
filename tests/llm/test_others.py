"""The operators in a free style, against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import best_fit_packing as bp
from marlstone.llm import components as cc
from marlstone.llm import language_filters as lf
from marlstone.llm import license_scan as ls
from marlstone.llm import mixing, topk_histogram
from marlstone.llm import repeat_index as ri
from marlstone.llm import simhash_pigeonhole as sp


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# Repeats.


def brute_repeats(docs):
    seen, out = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            seen[b[i : i + 50]] = min(d, seen.get(b[i : i + 50], d))
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if seen[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def removed(spark, docs, **more):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in ri.remove_repeats(table(spark, docs), **more).collect()}


def repeat_corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(40)]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(8, 30))) for _ in range(6)]
    docs = []
    for d in range(60):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(r.choice(words) for _ in range(r.randint(0, 25))) for _ in range(r.randint(0, 6))]
        docs.append((d * 3, " ".join(parts)))
    docs += [(500, docs[7][1]), (501, docs[7][1]), (502, None), (503, ""), (504, "x" * 49), (505, "x" * 49), (506, "x" * 500), (507, "x" * 50), (508, "ab" * 40), (509, "ba" * 40)]
    return docs


@pytest.mark.parametrize(("seed", "hot"), [(0, None), (1, 2), (2, 5)])
def test_repeats(spark, seed, hot):
    docs = repeat_corpus(seed)
    assert removed(spark, docs, hot=hot) == brute_repeats(docs)


@pytest.mark.parametrize("seed", [4, 5])
def test_repeats_of_copies_in_any_order(spark, seed):
    docs = repeat_corpus(seed)
    docs += [(1000 + d, t) for d, t in docs[:30]]
    # Larger ids first, so a copy that goes stands before the one that stays, in one batch.
    for rows in (docs[::-1], random.Random(seed).sample(docs, len(docs))):
        got = ri.remove_repeats(table(spark, rows).coalesce(1)).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(docs)


def test_repeats_in_pieces(spark, monkeypatch):
    docs = repeat_corpus(3)
    want = brute_repeats(docs)
    texts = [(t or "").encode() for _, t in docs]
    whole = {(r, s) for a in ri.anchors(texts) for r, s, n in zip(a.row, a.start, a.n, strict=True) for s in range(s, s + n)}
    monkeypatch.setattr(ri, "CHUNK", 120)
    parts = [a for a in ri.anchors(texts)]
    assert {(r, s) for a in parts for r, s, n in zip(a.row, a.start, a.n, strict=True) for s in range(s, s + n)} == whole
    assert whole == {(i, s) for i, t in enumerate(texts) for s in range(len(t) - 49)} and len(want) == len(docs)


def test_offering_anchors_holds_little_at_once(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    class Rows:  # keeps the first function that it is given
        run = None

        def mapInArrow(self, run, schema):
            self.run = self.run or run
            return self

        select = repartition = sortWithinPartitions = lambda self, *_: self

    rows = Rows()
    monkeypatch.setattr(ri, "staged", lambda df, name: df)
    ri.shared_anchors(rows, 12, 5000)
    text = pa.array([np.random.default_rng(i).integers(97, 123, 2000, np.uint8).tobytes().decode() for i in range(6000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000)), pa.array(np.zeros(6000, np.int64)), text], ["doc", "tag", "text"])
    tracemalloc.start()
    assert sum(1 for _ in rows.run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak


def test_repeats_of_repeated_rows_and_no_rows(spark):
    t = "the same long sentence of more than fifty bytes stands here twice over"
    assert all(r["n_removed"] == 0 for r in ri.remove_repeats(table(spark, [(1, t), (1, t)])).collect())
    assert ri.remove_repeats(table(spark, [])).count() == 0


def test_run_index_statistics():
    r = random.Random(5)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(50, 80))) for _ in range(30)]
    texts += [texts[0][:60] + b"zz", b"q" * 55, texts[1]]
    around, size = np.zeros((len(texts), 80), np.uint8), np.array([len(t) for t in texts])
    for i, t in enumerate(texts):
        around[i, : len(t)] = np.frombuffer(t, np.uint8)
    index = ri.RunIndex(around[:20], size[:20], np.arange(20))
    for k, live, length, _ in index.stream(around, size):
        for q, n in zip(live.tolist(), length.tolist(), strict=True):
            want = max(next((m for m in range(len(texts[q]) - k, 0, -1) if any(texts[q][k : k + m] in t for t in texts[:20])), 0), 0)
            assert n == want


# Languages.


def test_languages_held_out(spark, sf):
    out = lf.op4_language_filters(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["a"] > 0.95 and 0 <= r["lo"] <= r["hi"] <= 1


def test_languages_odd_inputs(spark, monkeypatch):
    rows = [(i, "der hund und die katze laufen schnell", "de") for i in range(5)] + [(10 + i, "the dog and the cat run quickly", "en") for i in range(5)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = lf.fit(train)
    assert filters.languages == ("de", "en")
    ask = spark.createDataFrame([(1, "die katze und der hund", "x"), (2, None, "x"), (3, "12 34 !!", "x"), (4, "the cat and the dog", "x"), (5, "", "x"), (6, "中文", "x")], "doc_id long, text string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lf.identify(ask, filters).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5)] == ["de", "und", "und", "en", "und"] and got[6][0] in ("de", "en")
    assert got[2][1] == 0.0
    none = lf.fit(train.where("false"))
    assert {r["lang_pred"] for r in lf.identify(ask, none).collect()} == {"und"}
    long = ["die katze und der hund " * 50, "the dog and the cat " * 70]
    want = lf.predict(long, filters)
    monkeypatch.setattr(lf, "CHUNK", 40)
    cut = lf.predict(long, filters)
    assert cut[0] == want[0] == ["de", "en"] and min(want[2]) > 0.9


# Near duplicates.


def brute_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="aAbé \t\n ", max_size=60)))
def test_fingerprints(text):
    assert sp.fingerprint(text) == brute_fingerprint(text)


def brute_components(fps, distance=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def clustered(seed, n):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(6)]
    out = []
    for _ in range(n):
        x = r.choice(centres)
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return out + [r.getrandbits(64) for _ in range(n // 4)]


PLANS = [
    None,
    sp.Plan(tuple(tuple(range(i, 64, 2)) for i in range(2)), (2, 1)),
    sp.Plan(tuple(tuple(range(i, 64, 3)) for i in range(3)), (1, 0, 1)),
    sp.Plan(tuple(tuple(range(i, 64, 4)) for i in range(4)), (2, 0, -1, 0)),
]


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("hot", [4096, 7])
def test_links_give_the_components(spark, plan, hot):
    fps = sorted(set(clustered(1, 120)))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = cc.components(sp.links(df, plan or sp.make_plan(np.array(fps, np.uint64), len(fps)), 4, hot))
    name = {r["node"]: r["component"] for r in found.collect()}
    got = [name.get(x, x) for x in signed]
    want = brute_components(fps)
    assert len({(a, b) for a, b in zip(got, want, strict=True)}) == len(set(want)) == len(set(got))


@pytest.mark.parametrize("distance", [4, 11])
def test_large_groups(distance):
    fps = sorted(set(clustered(7, 300)))
    forest = sp.Forest()
    sp._large_group(np.array(fps, np.uint64), distance, forest)
    forest.shrink()
    a, b = forest.a[0].tolist(), forest.b[0].tolist()
    assert all(bin(x ^ y).count("1") <= distance for x, y in zip(a, b, strict=True))
    want = brute_components(fps, distance)
    assert len(a) == len(fps) - len(set(want))
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a, b, strict=True):
        parent[find(x)] = find(y)
    assert len({(find(x), w) for x, w in zip(fps, want, strict=True)}) == len(set(want))


def test_plans_follow_the_principle():
    sample = np.array(clustered(2, 400), np.uint64)
    for n in (10, 10**5, 10**8, 10**10):
        p = sp.make_plan(sample, n)
        assert sorted(b for g in p.groups for b in g) == list(range(64))
        assert sum(t + 1 for t in p.thresholds) == sp.DISTANCE + 1
    assert len(sp.make_plan(sample, 10**10).groups) < len(sp.make_plan(sample, 10**4).groups)


def test_near_duplicates_odd_inputs(spark):
    rows = [(5, None), (3, ""), (9, " "), (4, "one two three four five six"), (2, "one two three four five six"), (2, "one two three four five six"), (7, "else")]
    got = sorted((r["doc_id"], r["component"]) for r in sp.near_duplicates(table(spark, rows)).collect())
    assert got == [(2, 2), (2, 2), (3, 3), (4, 2), (5, 3), (7, 7), (9, 3)]
    assert sp.near_duplicates(table(spark, [])).count() == 0


def test_near_duplicates_whole_table(spark, sf):
    rows = sp.op5_simhash_pigeonhole(spark, sf).collect()
    fps = [int(r["fingerprint"], 16) for r in rows]
    comp = brute_components(fps)
    least = {}
    for r, c in zip(rows, comp, strict=True):
        least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    assert [r["component_id"] for r in rows] == [least[c] for c in comp]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Packing.


TRICKY = ["", "a", "hello  world\n\n x", "I'll don't", "naïve é 中文 ñ", "x" * 3000, "<|endoftext|> in text", "tabs\t\tand   spaces ", "1234567890 12", "😀 emoji", " nbsp "]


def test_ids_are_the_tokenizers(sf):
    from tokenizers import Tokenizer

    encode, slow = bp.encoder(bp.default_tokenizer()), Tokenizer.from_file(bp.default_tokenizer())
    for t in TRICKY:
        assert encode(t) == slow.encode(t, add_special_tokens=False).ids


def test_packing_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(table(spark, [(-1, None), (-2, ""), (-3, "word " * 9000)]))
    pieces = bp.pack(docs.repartition(5), bp.default_tokenizer()).collect()
    encode, texts = bp.encoder(bp.default_tokenizer()), {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(by_doc) == set(texts)
    for d, ps in by_doc.items():
        ids, at = np.array([*encode(texts[d]), 0], "<u4"), 0
        for i, p in enumerate(sorted(ps, key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (i, at)
            assert zlib.crc32(ids[at : at + p["length"]].tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids) and (len(ps) == 1 or all(p["length"] == 2048 for p in ps if p["piece"]))
    total = 0
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert len(by_seq) <= 1.03 * total / 2048 + 1


def brute_best_fit(lengths, size, most):
    """Each piece goes to the open bin that it leaves least free, the newest of equals; if none
    fits, a bin is opened, for which the fullest (the newest of equals) closes at the limit."""
    bins, out, n = [], [], 0  # (free, last touched, number)
    for t, x in enumerate(lengths):
        fits = [b for b in bins if b[0] >= x]
        if fits:
            best = min(fits, key=lambda b: (b[0], -b[1]))
        else:
            if len(bins) >= most:
                bins.remove(min(bins, key=lambda b: (b[0], -b[1])))
            best = (size, t, n)
            n += 1
        if best in bins:
            bins.remove(best)
        out.append((best[2], size - best[0]))
        if best[0] > x:
            bins.append((best[0] - x, t, best[2]))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 6))
def test_bins_are_best_fit(lengths, most):
    bins = bp.Bins(20, most, 0)
    assert [bins.place(n) for n in lengths] == brute_best_fit(lengths, 20, most)
    assert bins.n <= most


# Mixing.


def shares(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _tokens int, _level0 string")
    return mixing.mix(df, {"lang": F.col("lang"), "source": F.col("source")}, **more)


def test_shortages_go_to_siblings_first(spark):
    text = "w " * 10
    rows = [(i, text, "a", "a1", 0, "x") for i in range(10)] + [(100 + i, text, "a", "a2", 0, "x") for i in range(90)] + [(200 + i, text, "b", "b1", 0, "x") for i in range(100)]
    out = shares(spark, rows, weights={("a", "a1"): 3.0}, share=0.6, max_epochs=1)
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum("_tokens").alias("n")).collect()}
    # a and b get 600 each; a1 is worth 450 of it but has 100, the rest goes to a2.
    assert got == {"a1": 100, "a2": 500, "b1": 600}
    assert shares(spark, rows, weights={}, share=0.0, max_epochs=1).count() == 0
    twice = shares(spark, rows, weights={}, share=2.0, max_epochs=2)
    assert twice.count() == 400 and {r["_epoch"] for r in twice.collect()} == {0, 1}


def test_mixing_odd_inputs(spark):
    rows = [(1, None, None, None, 0, "x"), (2, "", "a", "s", 0, "x"), (3, "one two", None, "s", 0, "x"), (3, "one two", None, "s", 0, "x")]
    out = shares(spark, rows, weights={}, share=1.0, max_epochs=1)
    assert [r["doc_id"] for r in out.collect()] == [3, 3] and "_level0" in out.columns
    assert shares(spark, [], weights={}, share=1.0, max_epochs=1).count() == 0


# Search.


def test_top_k_ties_and_odd_vectors(spark):
    r = random.Random(3)
    rows = [(i, [float(r.choice([-1, 0, 0.5, 1])) for _ in range(4)]) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, float("nan"), 0.0, 0.0]), (1002, [1.0, None, 0.0, 0.0]), (1003, []), (1004, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    v = topk_histogram.scaled(df, "vec_id", "embedding")
    got = sorted(tuple(x) for x in topk_histogram.top_k(v.where("id % 50 = 0"), v).collect())
    vectors = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows[:300]}
    want = []
    for q in range(0, 300, 50):
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], vectors[c], strict=True)), c) for c in vectors if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored)]
    assert got == sorted(want)
    few = v.where("id in (0, 50, 7)")
    assert topk_histogram.top_k(few.where("id % 50 = 0"), few).count() == 4
    assert topk_histogram.top_k(v.where("false"), v.where("false")).count() == 0


# Licences.


@pytest.mark.parametrize(("text", "postfix", "ok"), [
    ("MIT", ["mit"], True),
    ("MIT OR GPL-2.0-only", ["mit", "gpl-2.0-only", "or"], True),
    ("MIT AND (GPL-2.0+ OR Apache-2.0) */", ["mit", "gpl-2.0+", "apache-2.0", "or", "and"], True),
    ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", ["gpl-2.0-only", "classpath-exception-2.0", "with", "mit", "or"], True),
    ("MIT OR Apache-2.0 AND GPL-3.0", ["mit", "apache-2.0", "gpl-3.0", "and", "or"], True),
    ("(MIT", None, None),
    ("OR MIT", None, None),
    ("", None, None),
])
def test_expressions(text, postfix, ok):
    got = ls.parse_expression(text)
    assert got == postfix
    if got:
        assert ls.permitted(got) is ok


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in ls.BASE_PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.none(), st.lists(st.sampled_from(["CC", "by", "cc", "general", "Public", "license", "all", "rights", "reserved", " ", "-", "\n", "é", "x1", "İ", "ſ"]), max_size=25).map(" ".join), st.text(max_size=30)))
def test_licence_base(text):
    r = ls.scan_text(text)
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(text)


def test_licences_whole_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = ls.op10_license_scan(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(docs[r["doc_id"]])
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    tag = ls.scan_text("// SPDX-License-Identifier: (MIT OR GPL-2.0) \nall rights reserved")
    assert tag["labels"] == "gpl-2.0,mit,reserved" and tag["permitted"] is True


# The pipeline.


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit(1))
    docs = docs.unionByName(spark.createDataFrame([(-1, None, None, None, None, 1), (-2, "12 34", "en", "src0", 5, 1)], docs.schema))
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = docs.sparkSession.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema) if name == "mixing" else stage(spark, docs, sf)
        kept[name] = docs.count()
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language_id":
            assert docs.where("doc_id < 0").count() == 0
    assert kept["near_duplicates"] < kept["language_id"] and kept["pii"] == kept["near_duplicates"]
    assert cp.STAGES[-1][1](spark, docs, sf).count() > 0
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None


def brute_kept(docs):
    """Ids that stay: the smallest of each component of similarity 0.8 on five words."""
    def five(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, parent = [five(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=lambda k: docs[k][0])
                parent[b] = a
    return sorted(docs[k][0] for k in {find(i) for i in range(len(docs))})


def near_corpus(seed):
    """Texts and changed copies of them, on both sides of the limit."""
    r = random.Random(seed)
    out = []
    for _ in range(25):
        base = [f"w{r.randrange(500)}" for _ in range(r.randint(60, 200))]
        for _ in range(r.randint(1, 8)):
            words = list(base)
            for _ in range(r.randint(0, len(words) // 25)):
                words[r.randrange(len(words))] = f"w{r.randrange(500)}"
            out.append(" ".join(words))
    out += [out[3], out[9].upper(), "two words", "two words"]
    r.shuffle(out)
    return list(enumerate(out, 1))


@pytest.mark.parametrize("seed", [0])
def test_pipeline_drops_near_copies(spark, seed):
    import corpus_pipeline as cp

    docs = near_corpus(seed)
    got = {r["doc_id"] for r in cp.drop_near_duplicates(spark, table(spark, docs), None).collect()}
    want = set(brute_kept(docs))
    # What goes is near a document that stays; fingerprints miss few of those that should go.
    assert want <= got and len(got - want) <= 0.1 * (len(docs) - len(want))


@pytest.mark.parametrize("fingerprints_, crowd", [(True, 128), (True, 2), (False, 2)])
def test_no_near_copy_is_left_out(spark, monkeypatch, fingerprints_, crowd):
    import corpus_pipeline as cp

    monkeypatch.setattr(sp, "CROWD", crowd)
    if not fingerprints_:  # as if they had proposed nothing
        monkeypatch.setattr(sp, "links", lambda rows, *_: rows.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false"))
    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(900)}" for _ in range(n)]
    texts = [t for _, t in near_corpus(1)]
    for _ in range(40):  # pairs just at the limit, and a passage that all of them hold
        base = words(r.randint(6, 60))
        end = max(1, round(len(base) * r.choice([0.1, 0.15, 0.2, 0.25])))
        texts += [" ".join(base), " ".join(base[:-end]), " ".join(base[end:])]
    line = words(12)
    texts += [" ".join(words(r.randint(0, 6)) + line) for _ in range(20)]
    docs = list(enumerate(texts, 1))
    got = sorted(r["doc_id"] for r in cp.drop_near_duplicates(spark, table(spark, docs), None).collect())
    assert got == brute_kept(docs)


def test_crowds_pair_only_what_may_be_alike(spark):
    # A group of near copies, others with so many shingles of their own in front that nothing
    # behind can be enough, and three that may still be near.
    rows = [(7, i, 144, i % 5, 0) for i in range(200)] + [(7, i, 144, 20, i) for i in range(200, 350)] + [(7, i, 144, 10, i) for i in range(350, 353)]
    rows += [(8, i, 144, 6, 0) for i in range(200)] + [(8, 400, 110, 6, 400), (9, 500, 5, 0, 500), (9, 501, 5, 1, 501), (9, 502, 6, 0, 502)]
    crowd = spark.createDataFrame(rows, "token long, a long, n int, at int, a_in long")
    got = {(r["a"], r["b"]) for r in sp._crowd_pairs(crowd, 0.8).collect()}

    def may(n, i, m, j):
        return min(n, m) >= 0.8 * max(n, m) and min(n - i, m - j) >= (n + m) * 4 / 9

    want = {(a, b) for t, a, n, i, x in rows for u, b, m, j, y in rows if t == u and a < b and x != y and may(n, i, m, j)}
    assert got == want and len(got) == 3 * 200 + 3 + 1


@pytest.mark.parametrize("n", [1, 700])
def test_sketches_rule_out_no_similar_sets(n):
    r = np.random.default_rng(n)
    for k in range(0, n + 1, max(1, n // 20)):
        x = r.integers(0, 1 << 63, n, np.uint64)
        y = np.r_[x[k:], r.integers(0, 1 << 63, k, np.uint64)]
        bits = int(np.bitwise_count(sp._sketch(np.r_[x, x]) ^ sp._sketch(y)).sum())
        assert bits <= len(set(x.tolist()) ^ set(y.tolist()))
    assert not sp._sketch(x[:0]).any()


@pytest.mark.parametrize("fingerprints_", [True, False])
def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch, fingerprints_):
    # Copies on both sides of the limit: each is similar to a part of the others.
    if not fingerprints_:
        monkeypatch.setattr(sp, "links", lambda rows, *_: rows.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false"))
    made, staged = {}, sp.staged

    def counted(df, name, *more):
        out = staged(df, name, *more)
        made[name] = made.get(name, 0) + (out.count() if name in ("pairs", "closest", "unlinked") else 0)
        return out

    monkeypatch.setattr(sp, "staged", counted)
    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(400):
        words = list(base)
        for _ in range(r.randint(1, 5)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    found = {r["node"]: r["component"] for r in sp.similar_texts(table(spark, docs)).collect()}
    assert len(docs) - len(found) + len(set(found.values())) == len(brute_kept(docs))
    assert sum(made.values()) <= 12 * len(docs), made


def test_texts_without_words_are_near_copies(spark):
    found = sp.similar_texts(table(spark, [(1, ""), (2, None), (3, " "), (4, "\n"), (5, "a b"), (6, "A  b")]))
    assert sorted(len(list(g)) for _, g in __import__("itertools").groupby(sorted(r["component"] for r in found.collect()))) == [2, 3]


def test_pipeline_keeps_texts_with_null_or_reused_ids(spark):
    import corpus_pipeline as cp

    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    docs = [(None, a), (None, b), (None, b), (1, c), (1, d), (1, d), (2, d), (None, c + " more")]
    got = cp.drop_near_duplicates(spark, table(spark, docs), None)
    assert sorted((r["text"], r["doc_id"]) for r in got.collect()) == [(a, None), (b, None), (c, 1), (d, 1)]
