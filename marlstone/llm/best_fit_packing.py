"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best fit: each task keeps at most ``open_bins`` bins, found by a bitset
keyed by free space; a piece goes to the open bin that it fills best, and when there is no
room the fullest open bin closes first. What is in bins that a task leaves open at its end
goes through the same packer once more, the longest pieces first, in tasks that get as many
such bins as they may hold open, so that the number of tasks costs little space.

Only documents longer than a sequence are cut, so that all pieces but the first are full.
A null text is the empty text, whose ids are the separator alone; texts of any length are
read whole; an empty table gives no pieces. Repeated rows are packed one by one. Of the
input only the id and the text are read, so no name can clash. Tokenising is done by the
byte-pair ranks that the tokenizer file itself holds; texts with one of its special tokens,
or with very long white space, go through the tokenizer proper, so that ids are the same in
every case.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXT_BATCH, documents, lean, staged

LENGTH = 2048
OPEN_BINS = 2048
SEPARATOR = 0
_LONG_SPACE = re.compile(r"\s{512}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids, as ``tokenizers`` gives them without special tokens added."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [x["content"] for x in spec.get("added_tokens", ())]
    # Byte-level vocabularies write bytes that don't print as characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))  # few texts need it, and it is large

    def encode(text: str) -> list[int]:
        # The fast library's patterns recurse over white space, too deep in a long run of it.
        if any(s in text for s in special) or _LONG_SPACE.search(text):
            return slow().encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


class Bins:
    """Open bins by free space; ids count up from ``first``."""

    def __init__(self, size: int, most: int, first: int) -> None:
        self.size, self.most, self.next = size, most, first
        self.free: dict[int, list[int]] = {}
        self.mask = self.n = 0

    def _take(self, space: int) -> int:
        stack = self.free[space]
        found = stack.pop()
        if not stack:
            self.mask ^= 1 << space
        self.n -= 1
        return found

    def _put(self, number: int, space: int) -> None:
        if space:
            self.free.setdefault(space, []).append(number)
            self.mask |= 1 << space
            self.n += 1

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.mask >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.n >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
            number, space = self.next, self.size
            self.next += 1
        self._put(number, space - length)
        return number, self.size - space

    def open(self) -> Iterator[tuple[int, int]]:
        """(bin, used) of what is still open."""
        return ((number, self.size - space) for space, stack in self.free.items() for number in stack)


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, open_bins: int = OPEN_BINS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, bin long, offset long, open boolean"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = encoder(tokenizer), Bins(length, open_bins, _partition() << 40)
        numbers = ("piece", "start", "length", "ids_crc32", "bin", "offset")
        types = (pa.int32(), *[pa.int64()] * 5)
        key_type = None

        def batch(at: list[int], keys: pa.Array, rows: list[tuple], is_open: bool) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * 6
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())) if at else pa.nulls(len(rows), keys.type), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True)), pa.array([is_open] * len(rows), pa.bool_())], [key, *numbers, "open"])

        for b in batches:
            at, rows = [], []
            key_type = b.column(0)
            for i, t in enumerate(b.column(1)):
                ids = np.array([*encode(t.as_py() or ""), SEPARATOR], "<u4")
                start, size = 0, len(ids) % length or length
                for piece in range(-(-len(ids) // length)):
                    rows.append((piece, start, size, zlib.crc32(ids[start : start + size].tobytes()), *bins.place(size)))
                    at.append(i)
                    start, size = start + size, length
            yield batch(at, b.column(0), rows, False)
        if key_type is not None:
            yield batch([], key_type, [(0, 0, used, 0, number, 0) for number, used in bins.open()], True)

    packed = staged(docs.select(key, text).mapInArrow(lean(first), schema), "packing", TEXT_BATCH)

    names = [key, "piece", "start", "length", "ids_crc32"]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs the pieces of bins that stayed open anew, the longest first."""
        bins = Bins(length, open_bins, (1 << 62) | (_partition() << 40))
        for b in batches:
            places = [bins.place(n) for n in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())], [*names, "sequence_id", "offset"])

    left = packed.where("open").select("bin")
    parts = -(-left.count() // open_bins) or 1
    pieces = packed.where("not open")
    closed = pieces.join(left, "bin", "left_anti").select(*names, F.col("bin").alias("sequence_id"), "offset")
    rest = pieces.join(left, "bin", "left_semi").repartition(parts, "bin").select(*names).sortWithinPartitions(F.desc("length"), key, "start")
    return closed.unionByName(rest.mapInArrow(lean(again), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_tokenizer())
