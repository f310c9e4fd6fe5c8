"""Words, pairs and 4-grams of whole blocks of texts, by arrays: nothing is a row for each of a
text's features. Within a block terms go by hashes of 64 bits; between blocks they are written out."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .index import NORMS

#: Characters of text that a worker holds as features at once, about 30 times as many bytes.
BLOCK = 6 << 20
#: Characters of text whose terms meet in one bucket.
BUCKET = 4 << 20
#: Sums by term and label that are a matrix, at most; more are sorted.
CELLS = 1 << 23
#: Weights that are added to it at once.
HELD = 1 << 20
#: Characters that are hashed at once, and terms that leave at once.
PIECE, OUT = 1 << 20, 1 << 17

#: What a block sends to a bucket; the last three once only.
FIELDS = ["_bucket", "_block", "_rows", "_sizes", "_data", "_many", "_step", "_tf", "_df", "_of", "_times", "_names"]

_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_UNDERSCORE = _BYTES[ord("_")] - _BYTES[ord(" ")]
_powers: list[np.ndarray] = []


def flat(text: Column) -> Column:
    """The words of a text, joined by spaces: what features are made of."""
    return F.coalesce(F.array_join(tx.tokens(text), " "), F.lit(""))


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        _powers[:] = []
        for base in (_BASE, _BACK):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def _features(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, start, end, row, is a pair) of all features of joined words, with repeats; b is
    their UTF-8 and offsets are where rows begin in it, and its end."""
    forth, back = _power(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * forth[: len(b)], out=sums[1:])
    full = offsets[1:] > offsets[:-1]
    spaces = np.flatnonzero(b == 32)
    start = np.sort(np.concatenate([offsets[:-1][full], spaces + 1]))
    end = np.sort(np.concatenate([spaces, offsets[1:][full]]))
    row = np.searchsorted(offsets, start, "right") - 1
    both = np.flatnonzero(row[1:] == row[:-1])
    point = np.flatnonzero((b & 0xC0) != 0x80)
    place = np.searchsorted(point, offsets)
    many = np.maximum(np.diff(place) - 3, 0) // 2
    before = np.cumsum(many) - many
    at = np.repeat(place[:-1] - 2 * before, many) + 2 * np.arange(int(many.sum()))
    starts = np.concatenate([start, start[both], point[at]])
    ends = np.concatenate([end, end[both + 1], point[at + 4]])
    key = sums[ends] - sums[starts]
    key[len(start) : len(start) + len(both)] += _UNDERSCORE * forth[end[both]]
    key *= back[starts]
    key ^= key >> _U(32)
    key *= _U(0xD6E8FEB86659FD93)
    key ^= key >> _U(29)
    pair = np.zeros(len(starts), bool)
    pair[len(start) : len(start) + len(both)] = True
    return key, starts, ends, np.concatenate([row, row[both], np.repeat(np.arange(len(many)), many)]), pair


def _order(key: np.ndarray) -> np.ndarray:
    """As argsort, by a sort of values: the first bits of each with its place."""
    bits = _U(max(1, len(key).bit_length()))
    code = (key >> bits) << bits
    code |= np.arange(len(key), dtype=np.uint64)
    code.sort()
    order = (code & ((_U(1) << bits) - _U(1))).astype(np.int64)
    ordered = key[order]
    # Two hashes may begin alike, seldom.
    return order if (ordered[1:] >= ordered[:-1]).all() else np.argsort(key, kind="stable")


class Bag:
    """Features of a block of texts. keys: hashes of its distinct terms, sorted; of each
    distinct (row, term): row, term (its place in keys) and tf. rows says to which row each
    text belongs."""

    def __init__(self, flats: pa.StringArray, rows: np.ndarray) -> None:
        offsets = np.frombuffer(flats.buffers()[1], np.int32, len(flats) + 1, flats.offset * 4).astype(np.int64)
        data = flats.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        parts, at = [], 0
        while at < len(flats):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
            key, start, end, row, pair = _features(self.bytes[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            parts.append((key, (start + offsets[at]).astype(np.int32), (end - start).astype(np.int32), rows[row + at].astype(np.int32), pair))
            at = to
        key, self._start, self._size, row, self._pair = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, d) for d in (np.uint64, np.int32, np.int32, np.int32, bool))
        del parts
        order = _order(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.keys, self._first = key[new], order[new]
        del key
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(new) - 1
        del order, new
        code += row.astype(np.int64) * max(1, len(self.keys))
        del row
        code.sort()
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        at = np.flatnonzero(new)
        self.tf = np.diff(at, append=len(code))
        self.row, self.term = np.divmod(code[at], max(1, len(self.keys)))

    def strings(self, terms: np.ndarray) -> pa.StringArray:
        """The terms at these places of keys."""
        first = self._first[terms]
        start, size, pair = self._start[first].astype(np.int64), self._size[first], self._pair[first]
        offsets = np.zeros(len(terms) + 1, np.int32)
        np.cumsum(size, out=offsets[1:])
        data = self.bytes[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]
        # Tokens have no spaces, so a pair's only one stands between its words.
        data[(data == 32) & np.repeat(pair, size)] = ord("_")
        return pa.StringArray.from_buffers(len(terms), pa.py_buffer(offsets), pa.py_buffer(data))


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _give_back() -> None:
    """Workers stay for later tasks; what this one has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _small(values: np.ndarray) -> bytes:
    """Counts: a byte each, and 8 more for those of 255 or more."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype(np.int64).tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    values = np.frombuffer(data, np.uint8, n).astype(np.int64)
    values[values == 255] = np.frombuffer(data, np.int64, offset=n)
    return values


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers of up to 32 bits, first bytes together, as those of a kind pack better."""
    data = values.astype(np.uint32).view(np.uint8).reshape(-1, 4)
    wide = 2 if not len(values) or values.max() < 1 << 16 else 4
    return zlib.compress(bytes([wide]) + np.ascontiguousarray(data[:, :wide].T).tobytes(), 1)


def _numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    wide = int(raw[0])
    out = np.zeros(((len(raw) - 1) // wide, 4), np.uint8)
    out[:, :wide] = raw[1:].reshape(wide, -1).T
    return out.reshape(-1).view(np.uint32).astype(np.int64)


def _written(terms: pa.StringArray) -> tuple[bytes, bytes]:
    offsets = np.frombuffer(terms.buffers()[1], np.int32, len(terms) + 1)
    return _planes(np.diff(offsets)), zlib.compress(terms.buffers()[2], 1)


def _read(sizes: bytes, data: bytes) -> pa.StringArray:
    offsets = np.concatenate([[0], np.cumsum(_numbers(sizes))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(zlib.decompress(data)))


def counts(docs: DataFrame, row: str, text: str = "text") -> DataFrame:
    """(row, term, tf) by words, pairs and 4-grams; texts of one row count together."""
    kind = docs.schema[row].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                ends = np.cumsum(b.column(2).to_numpy())
                at = 0
                while at < b.num_rows:
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK // 2, "right")))
                    lists = b.column(1).slice(at, to - at)
                    bag = Bag(pa.compute.list_flatten(lists), np.repeat(np.arange(to - at), pa.compute.list_value_length(lists).to_numpy()))
                    ids = b.column(0).slice(at, to - at)
                    for i in range(0, len(bag.row), OUT):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(bag.row[i : i + OUT])), bag.strings(bag.term[i : i + OUT]), pa.array(bag.tf[i : i + OUT])], [row, "term", "tf"])
                    at = to
        finally:
            _give_back()

    whole = docs.select(row, flat(F.col(text)).alias("_flat")).groupBy(row).agg(F.collect_list("_flat").alias("_flats"))
    size = F.aggregate("_flats", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return whole.select(row, "_flats", size.alias("_size")).mapInArrow(run, f"{row} {kind}, term string, tf long")


def sums(docs: DataFrame, label: str, min_df: int, n: int, row: str = "row") -> DataFrame:
    """(label, term, df, s) for terms of min_df to n - 1 rows: s is the sum of the term's weights
    in the label's rows of unit length, by words, pairs and 4-grams. A row of the table without
    a label, or without a row's name, counts only in df.

    A block of texts is looked at once and sends to each bucket the terms it has there and which
    rows have them. Buckets say what their terms add to the lengths of a block's rows and, once
    these are known, read the same again and add up. All of a term comes out in one task and
    one after another.
    """
    kind = docs.schema[label].dataType.simpleString()
    rows = docs.select(F.col(row).alias("_row"), F.col(label).alias("_label"), flat(F.col("text")).alias("_flat"))
    one = F.lit(1)
    odd = docs.groupBy(F.col(row).alias("_row")).agg(F.count("*").alias("_n")).where("_n > 1 or _row is null").select("_row").persist()
    if odd.isEmpty():
        odd.unpersist()
        rows = rows.select("_row", "_label", F.array("_flat").alias("_flats"), one.alias("_df"), one.alias("_times"))
    else:
        # The texts of one row are one; it counts once in df, and for each of its labels as often as it has it.
        single = rows.join(odd, "_row", "left_anti").where("_row is not null")
        rest = rows.join(odd.where("_row is not null"), "_row", "left_semi").unionByName(rows.where("_row is null").withColumn("_label", F.lit(None).cast(kind)))
        texts = rest.groupBy("_row").agg(F.collect_list("_flat").alias("_flats"))
        labels = rest.groupBy("_row", "_label").agg(F.count("*").cast("int").alias("_times")).groupBy("_row").agg(F.collect_list(F.struct("_label", "_times")).alias("_all"))
        several = texts.join(labels, texts["_row"].eqNullSafe(labels["_row"])).select(texts["_row"], "_flats", F.posexplode("_all").alias("_i", "_l"))
        rows = single.select("_row", "_label", F.array("_flat").alias("_flats"), one.alias("_df"), one.alias("_times")).unionByName(
            several.select("_row", "_l._label", "_flats", F.when(F.col("_i") == 0, 1).otherwise(0).alias("_df"), F.col("_l._times"))
        )
        # These come from shuffles: kept, so that rows stand in one order if they are read again.
        rows = rows.persist()
    size = docs.agg(F.sum(F.length("text").cast("long")).alias("chars"), F.count("*").alias("n")).first()
    bits = max(0, int(np.ceil(np.log2(max(1.0, (size["chars"] or 0) / BUCKET)))))
    many = max(min(1 << bits, 100_000), docs.sparkSession.sparkContext.defaultParallelism)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at_block = TaskContext.get().partitionId(), 0
        starts = np.arange(1 << bits, dtype=np.uint64) << _U(64 - bits) if bits else np.zeros(1, np.uint64)
        try:
            for b in batches:
                lists = b.column(1)
                of = pa.compute.list_value_length(lists).to_numpy()
                flats = pa.compute.list_flatten(lists)
                row = np.repeat(np.arange(b.num_rows), of)
                chars = np.cumsum(np.bincount(row, pa.compute.binary_length(flats).to_numpy(), b.num_rows))
                first, at = np.cumsum(of) - of, 0
                while at < b.num_rows:
                    to = max(at + 1, int(np.searchsorted(chars, (chars[at - 1] if at else 0) + BLOCK, "right")))
                    end = int(first[to]) if to < b.num_rows else len(flats)
                    yield from block(f"{part}/{at_block}", b.slice(at, to - at), flats.slice(int(first[at]), end - int(first[at])), row[first[at] : end] - at, starts)
                    at, at_block = to, at_block + 1
        finally:
            _give_back()

    def block(name: str, rows: pa.RecordBatch, flats: pa.StringArray, row: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = Bag(flats, row)
        cuts = np.append(np.searchsorted(x.keys, starts), len(x.keys))
        order = np.argsort(x.term, kind="stable")  # by term, then row
        term, row, tf = x.term[order], x.row[order], x.tf[order]
        del order
        in_df = rows.column(2).to_numpy()
        step = row.copy()
        same = term[1:] == term[:-1]
        step[1:][same] -= row[:-1][same]
        at = np.searchsorted(term, cuts)
        places = rows.column(0).dictionary_encode()
        of = places.indices.fill_null(len(places.dictionary)).to_numpy()
        names = pa.concat_arrays([places.dictionary, pa.nulls(1, places.dictionary.type)])
        told = False
        for i in range(len(starts)):
            lo, hi, p, q = cuts[i], cuts[i + 1], at[i], at[i + 1]
            if lo == hi and (told or i + 1 < len(starts)):
                continue
            sizes, data = _written(x.strings(np.arange(lo, hi)))
            df = np.bincount(term[p:q] - lo, in_df[row[p:q]], hi - lo) if (in_df == 0).any() else None
            columns = [pa.array([i], pa.int32()), pa.array([name]), pa.array([rows.num_rows], pa.int32()), *(pa.array([v], pa.binary()) for v in (sizes, data, zlib.compress(_small(np.bincount(term[p:q] - lo, minlength=hi - lo)), 1), _planes(step[p:q]), zlib.compress(_small(tf[p:q]), 1), None if df is None else _small(df)))]
            about = pa.array([None if told else _planes(of), None if told else _planes(rows.column(3).to_numpy())], pa.binary())
            listed = pa.ListArray.from_arrays(pa.array([0, 0 if told else len(names)], pa.int32()), names.slice(0, 0 if told else len(names)))
            told = True
            yield pa.RecordBatch.from_arrays([*columns, about.slice(0, 1), about.slice(1, 1), listed], FIELDS)

    def opened(table: pa.Table) -> tuple:
        """(terms, df, idf, and for each block its terms' places, and of each posting term, row, tf)."""
        got = {c: table[c].to_pylist() for c in ("_sizes", "_data", "_many", "_step", "_tf", "_df")}
        written = [_read(a, b) for a, b in zip(got["_sizes"], got["_data"], strict=True)]
        terms = pa.concat_arrays(written).dictionary_encode()
        places = np.split(terms.indices.to_numpy(), np.cumsum([len(w) for w in written])[:-1])
        df, blocks = np.zeros(len(terms.dictionary), np.int64), []
        for k, at in enumerate(places):
            often = _large(zlib.decompress(got["_many"][k]), len(at))
            df[at] += often if got["_df"][k] is None else _large(got["_df"][k], len(at))
            blocks.append((at, often, got["_step"][k], got["_tf"][k]))
        df[(df < min_df) | (df >= n)] = 0
        idf = np.zeros(len(df))
        idf[df > 0] = np.log(n / df[df > 0])
        return terms.dictionary, df, idf, blocks

    def postings(idf: np.ndarray, at: np.ndarray, often: np.ndarray, step: bytes, tf: bytes) -> tuple[np.ndarray, ...]:
        """(term, row, raw weight) of a block's postings."""
        row = np.cumsum(_numbers(step))
        begin = np.cumsum(often) - often
        row -= np.repeat(np.append(0, row)[begin], often)  # steps begin anew at each term
        return np.repeat(at, often), row, (1 + np.log(_large(zlib.decompress(tf), len(row)))) * np.repeat(idf[at], often)

    def lengths(table: pa.Table) -> pa.Table:
        _, _, idf, blocks = opened(table)
        squares = []
        for k, size in zip(blocks, table["_rows"].to_pylist(), strict=True):
            _, row, raw = postings(idf, *k)
            squares.append(np.bincount(row, raw * raw, size).tobytes())
        _give_back()
        return pa.table([table["_block"], pa.array(squares, pa.binary()), table["_of"], table["_times"], table["_names"]], ["_block", "_squares", "_of", "_times", "_names"])

    def whole(table: pa.Table) -> pa.Table:
        norm = np.sqrt(np.sum([np.frombuffer(x.as_py()) for x in table["_squares"]], axis=0))
        told = table.filter(pa.compute.is_valid(table["_of"]))
        each = _numbers(told["_times"][0].as_py()) / np.where(norm == 0, 1.0, norm)
        return pa.table([told["_block"], pa.array([each.tobytes()], pa.binary()), told["_of"], told["_names"]], ["_block", "_each", "_label_of", "_labels"])

    def total(table: pa.Table) -> pa.Table:
        terms, df, idf, blocks = opened(table)
        listed = _one(table["_labels"])
        names = pa.compute.list_flatten(listed).dictionary_encode(null_encoding="encode")
        places = np.split(names.indices.to_numpy(), np.cumsum(pa.compute.list_value_length(listed).to_numpy())[:-1])
        wide = len(names.dictionary)
        dense = len(df) * wide <= CELLS
        summed, found, held = np.zeros(len(df) * wide if dense else 0), [], []

        def flush() -> None:
            # The matrix is passed over once for many blocks.
            if held:
                code, raw = (np.concatenate(x) for x in zip(*held, strict=True))
                np.add(summed, np.bincount(code, raw, len(summed)), out=summed)
                held.clear()

        for k, place, each, of in zip(blocks, places, table["_each"].to_pylist(), table["_label_of"].to_pylist(), strict=True):
            term, row, raw = postings(idf, *k)
            kept = raw > 0
            term, row, raw = term[kept], row[kept], raw[kept]
            code = term.astype(np.int64) * wide + place[_numbers(of)][row]
            raw *= np.frombuffer(each)[row]
            if dense:
                held.append((code, raw))
                if sum(len(c) for c, _ in held) > HELD:
                    flush()
            else:
                code, at = np.unique(code, return_inverse=True)
                found.append((code, np.bincount(at, raw, len(code))))
        if dense:
            flush()
            code = np.flatnonzero(summed)
            summed = summed[code]
        else:
            code, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            summed = np.bincount(at, np.concatenate([v for _, v in found]), len(code))
        term, place = np.divmod(code, wide)
        out = pa.table([names.dictionary.take(pa.array(place)), terms.take(pa.array(term)), pa.array(df[term]), pa.array(summed)], ["label", "term", "df", "s"])
        _give_back()
        return out

    blobs = ", ".join(f"{c} binary" for c in FIELDS[3:11])
    sent = rows.select("_label", "_flats", "_df", "_times").mapInArrow(send, f"_bucket int, _block string, _rows int, {blobs}, _names array<{kind}>").repartition(many, "_bucket")
    norms = sent.groupBy("_bucket").applyInArrow(lengths, f"_block string, _squares binary, _of binary, _times binary, _names array<{kind}>")
    norms = norms.groupBy("_block").applyInArrow(whole, f"_block string, _each binary, _label_of binary, _labels array<{kind}>")
    # Lengths and labels of all rows go to all tasks, if there are no more than NORMS.
    norms = F.broadcast(norms) if size["n"] <= NORMS else norms
    # Both looks take all columns and rows, so that they are one shuffle.
    return sent.join(norms, "_block", "left").groupBy("_bucket").applyInArrow(total, f"label {kind}, term string, df long, s double").withColumnRenamed("label", label)


def gram(cents: DataFrame, label: str, names: list, together: bool = False) -> DataFrame:
    """(a, b, s): sums over terms of the products of two labels' weights, for a < b by place in
    names, where not 0. A task looks at some terms and adds up products of matrices. together:
    all rows of a term already follow each other in one partition."""
    places = pa.array(names)
    size = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        left = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if left is None else pa.concat_tables([left, t]).combine_chunks()
            term = _one(t.column(0))
            new = np.flatnonzero(pa.compute.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)) + 1
            # The last term may go on in the next batch.
            done = int(new[-1]) if len(new) else 0
            left = t.slice(done)
            total += products(t.slice(0, done), new[:-1])
        if left is not None and left.num_rows:
            total += products(left, np.zeros(0, np.int64))
        i, j = np.nonzero(np.triu(total, 1))
        yield pa.RecordBatch.from_arrays([places.take(pa.array(i)), places.take(pa.array(j)), pa.array(total[i, j])], ["a", "b", "s"])

    def products(t: pa.Table, new: np.ndarray) -> np.ndarray:
        if not t.num_rows:
            return np.zeros((size, size))
        begins = np.zeros(t.num_rows, np.int64)
        begins[new] = 1
        at = np.cumsum(begins)
        m = np.zeros((int(at[-1]) + 1, size))
        m[at, pa.compute.index_in(_one(t.column(1)), places).to_numpy()] = t.column(2).to_numpy()
        return m.T @ m

    kind = cents.schema[label].dataType.simpleString()
    dealt = cents.select("term", label, "weight")
    dealt = dealt if together else dealt.repartition(F.col("term")).sortWithinPartitions("term")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}, s double").groupBy("a", "b").agg(F.sum("s").alias("s"))
