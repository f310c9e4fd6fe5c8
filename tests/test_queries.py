"""Every registered query with a SQL twin gives the same rows; the others run."""

import pytest
from compare import same

from marlstone.plans.registry import FLAGSHIP, ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        same(df, sf, ORACLES[name])
    else:
        assert df.columns and df.count() > 0
    spark.catalog.clearCache()


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and FLAGSHIP in ORACLES


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_every_chunk_is_grounded(spark, sf):
    from marlstone.plans import queries as q

    chunks = {r["id"] for r in q._chunks(spark, sf).select("id").collect()}
    rows = q.grounded_pairs(spark, sf).collect()
    assert {r["source_chunk"] for r in rows} == chunks and len({r["compartment"] for r in rows}) > 1


def test_distractors_by_parts_equal_all_pairs(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    from marlstone.functions import text as tx
    from marlstone.operators import pairs

    monkeypatch.setattr(pairs, "HELD_CHARS", 900)  # several parts a compartment
    monkeypatch.setattr(pairs, "FULL_TERMS", 20)  # terms in the matrix, and others
    r = random.Random(4)
    words = [f"w{i}" for i in range(80)]
    texts = {f"t{i}": " ".join(r.choices(words[: r.choice([10, 80])], k=r.randint(1, 30))) for i in range(60)}
    texts |= {"a": "w1 w2 w3 w4", "b": "w2 w3 w4 w1", "c": "", "d": "alone"}
    homes = {(k, f"c{r.randrange(2)}") for k in texts} | {(k, "c0") for k in list(texts)[:20]} | {("a", None)}
    chunks = spark.createDataFrame([(k, c, texts[k]) for k, c in sorted(homes, key=str)], "id string, compartment string, text string")
    needed = spark.createDataFrame([(k,) for k in list(texts)[::3] + ["a", "c"]], "id string")
    rows = chunks.select("id", tx.features(chunks["text"]).alias("f")).dropDuplicates(["id"]).collect()
    counts = {x["id"]: Counter(x["f"]) for x in rows}
    df = Counter(t for c in counts.values() for t in c)
    vecs = {k: {t: (1 + math.log(n)) * math.log(len(counts) / df[t]) for t, n in c.items() if 2 <= df[t] < len(counts)} for k, c in counts.items()}
    norm = {k: math.sqrt(sum(x * x for x in v.values())) or 1 for k, v in vecs.items()}
    in_one = {(a, b) for a, c in homes for b, d in homes if a != b and c is not None and c == d}
    want = set()
    for k in {x["id"] for x in needed.collect()}:
        sims = [(-round(sum(x * vecs[o].get(t, 0) for t, x in vecs[k].items()) / norm[k] / norm[o], 6), o) for o in texts if (k, o) in in_one and vecs[k].keys() & vecs[o].keys()]
        want |= {(k, o, -s, i) for i, (s, o) in enumerate(sorted(sims)[:4], 1)}
    got = [tuple(x) for x in pairs.distractors(chunks, needed, 4).select("id", "other", "similarity", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_distractors_join_no_pairs(spark, sf):
    from marlstone.plans import queries as q

    plan = q.hard_distractors(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "mapinarrow" in plan.lower()
    # Rows meet their homes and a term its frequency; no join is by term and compartment.
    assert not [x for x in plan.splitlines() if "Join" in x and "term" in x and "compartment" in x]
