"""What Python's workers hold, in batches and when a task has ended."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa

import marlstone
from marlstone.llm import best_fit_packing
from marlstone.llm.common import staged


def test_a_worker_gives_back_what_a_task_has_freed():
    code = """
import os
import numpy as np
from marlstone.llm import common

def held():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGESIZE") >> 20

def run(batches):
    # Too small to be mapped each by itself; what comes last keeps the heap's end in place.
    some = [np.ones(12_000) for _ in range(2000)]
    kept.append(some.pop())
    yield from batches
    del some

kept, before = [], held()
assert list(common.lean(run)([1, 2])) == [1, 2]
print(held() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(marlstone.__file__).parent.parent)
    assert int(out.stdout) < 60


def test_batches_of_whole_texts_are_small(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], ["n"])

    texts = spark.range(0, 400, 1, 1).selectExpr("repeat(cast(id % 10 as string), 1000) as text")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    found = [r["n"] for r in staged(texts.mapInArrow(sizes, "n long"), "sizes", 100_000).collect()]
    assert sum(found) == 400 and max(found) <= 101
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_the_large_tokenizer_is_loaded_only_for_texts_that_need_it(monkeypatch):
    import tokenizers

    loaded = []
    real = tokenizers.Tokenizer

    class Counted:
        @staticmethod
        def from_file(path):
            loaded.append(path)
            return real.from_file(path)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    path = best_fit_packing.default_tokenizer()
    encode = best_fit_packing.encoder.__wrapped__(path)
    want = real.from_file(path)
    assert encode("some words") == want.encode("some words", add_special_tokens=False).ids and not loaded
    for text in ("a" + " " * 600 + "b", "c" + "\n" * 600):
        assert encode(text) == want.encode(text, add_special_tokens=False).ids
    assert len(loaded) == 1
