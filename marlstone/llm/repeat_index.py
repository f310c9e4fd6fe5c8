"""Long repeats across documents by a run-length Burrows-Wheeler index.

Removed is each byte covered by a string of ``LENGTH`` bytes that also starts in a document
with a smaller id. Documents are taken as UTF-8 bytes, and no match crosses their ends.

1. Exact copies are addressed by content: all but the one with the smallest id go whole.
2. Every window of ``LENGTH`` bytes has one anchor, its least ``KMER``-mer by hash, which
   depends on nothing but the window. Anchors (a hash and an id) are dealt out by hash and
   tell each document which of them some other document has too.
3. For shared anchors a document hands on the bytes of the windows that the anchor stands
   for (at most 80), equal ones once per task. All windows that could be equal meet.
4. Where an anchor has different surroundings, a run-compressed BWT is built over them, with
   suffix positions sampled at run ends. Surroundings are streamed through it from their end
   as matching statistics; a match of ``LENGTH`` or more lies in a range of rows that share
   the window, whose smallest id decides whether the window is marked.
5. Marks go back to their documents, which are cut and hashed.

Anchors of more than ``hot`` documents hand on single windows, dealt out by their own hash,
so that no task gets all surroundings of a frequent passage. Anchors are dealt out in parts
whose number follows from the table's bytes, so memory of a task is bounded by PART_BYTES of
text, by ``SLAB`` bytes of index, and by its longest text. A null text is empty, an empty
table gives no rows. Rows of one id don't remove each other: repeated rows get equal results,
different texts under one id are told apart by a hash. A null id is never matched. Other
columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged, text_or_empty

LENGTH = 50
KMER = 20
#: Windows that one anchor can stand for, and bytes around it.
SPAN = LENGTH - KMER + 1
AROUND = LENGTH + SPAN - 1
#: Bytes of text handled at once, under 2^24; small enough for a processor's cache.
CHUNK = 1 << 18
#: Rows of a batch whose texts are held as bytes at once.
ROWS = 512
#: Anchors, and surroundings, gathered before they are dealt out.
GATHER, GATHER_AROUND = 1 << 18, 1 << 17
#: Bytes of one index.
SLAB = 2 << 20
#: Documents with one anchor from which its windows are dealt out one by one: at least
#: HOT_LEAST, and one in HOT_SHARE of all, so the list of such anchors stays short.
HOT_LEAST, HOT_SHARE = 5000, 2000
#: Such anchors are at most so many, whatever the length of texts.
HOT_ANCHORS = 1_000_000
#: Parts of the anchor space for each shuffle partition, at least, and bytes of text for each.
PARTS = 4
PART_BYTES = 16 << 20
#: Ids with several texts up to which they are broadcast (8 MB).
BROADCAST_IDS = 1_000_000

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _eights(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on."""
    x = b.astype(_U)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << _U(8 * step))
    return x


@dataclass
class Anchors:
    """One row for each run of windows with one anchor: its document's row, the first window
    (place in the document, and in ``bytes``), the number of windows, and the anchor's hash."""

    bytes: np.ndarray
    row: np.ndarray
    start: np.ndarray
    at: np.ndarray
    n: np.ndarray
    key: np.ndarray


def anchors(texts: list[bytes]) -> Iterator[Anchors]:
    """Anchors of documents, several at once; texts beyond CHUNK in overlapping pieces."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for row, text in enumerate(texts):
        for begin in range(0, max(1, len(text) - LENGTH + 1), CHUNK - LENGTH + 1):
            piece = text[begin : begin + CHUNK]
            if len(piece) < LENGTH:
                continue
            if size + len(piece) > CHUNK and held:
                yield _anchors(held)
                held, size = [], 0
            held.append((row, begin, piece))
            size += len(piece)
    if held:
        yield _anchors(held)


def _anchors(pieces: list[tuple[int, int, bytes]]) -> Anchors:
    b = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    x = _eights(b)
    n = len(b) - KMER + 1
    h = _mixed(_mixed(_mixed(x[:n] ^ _U(0x9E3779B97F4A7C15)) ^ x[8 : 8 + n]) ^ x[12 : 12 + n])
    # Ties go to the left: the place stands in the low bits.
    v = (h & ~_U((1 << 24) - 1)) | np.arange(n, dtype=_U)
    k = 1
    while 2 * k <= SPAN:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    if k < SPAN:
        v = np.minimum(v[: len(v) - (SPAN - k)], v[SPAN - k :])
    place = (v & _U((1 << 24) - 1)).astype(np.int64)
    sizes = np.array([len(p[2]) for p in pieces])
    firsts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(pieces)), sizes)[: len(place)]
    inside = np.arange(len(place)) + LENGTH <= (firsts + sizes)[owner]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    begin = np.nonzero(new)[0]
    count = np.diff(np.r_[begin, len(place)])
    begin, count = begin[inside[begin]], count[inside[begin]]
    who = owner[begin]
    rows, starts = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    return Anchors(b, rows[who], starts[who] + begin - firsts[who], begin, count, _mixed(h[place[begin]]))


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return (((key >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string: bytes of equal weight stand together."""
    import zstandard

    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        planes = raw.view(np.uint8).reshape(len(raw), -1).T.tobytes() if len(raw) else b""
        parts.append(f"{raw.dtype.str}:{len(raw)}:{len(planes)};".encode() + planes)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    while at < len(raw):
        head = raw.index(b";", at)
        kind, n, size = raw[at:head].decode().split(":")
        planes = np.frombuffer(raw, np.uint8, int(size), head + 1)
        dtype = np.dtype(kind)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, int(n)).T).view(dtype).reshape(int(n)) if int(n) else np.zeros(0, dtype))
        at = head + 1 + int(size)
    return out


def _slices(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, rows of it)."""
    order = np.argsort(part, kind="stable")
    edges = np.nonzero(np.r_[True, part[order][1:] != part[order][:-1]])[0] if len(part) else []
    for a, b in zip(edges, np.r_[edges[1:], len(part)].astype(int) if len(part) else [], strict=True):
        yield int(part[order[a]]), order[a:b]


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blobs of one part after the other, as they come sorted by part."""
    part, blobs = None, []
    for b in batches:
        for p, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if p != part and blobs:
                yield blobs
                blobs = []
            part = p
            blobs.append(blob.as_py())
    if blobs:
        yield blobs


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in column]


def _in_slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of ROWS rows after the other."""
    for at in range(0, len(column), ROWS):
        yield at, _encoded(column.slice(at, ROWS))


def _group_edges(*columns: np.ndarray) -> np.ndarray:
    """First rows of groups, of sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.nonzero(new)[0]


def shared_anchors(docs: DataFrame, parts: int, hot: int) -> DataFrame:
    """(doc, tag, key, hot): anchors that another document has too; where ``hot``, an anchor of
    more than that many documents, with no document."""

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, held, n = 0, [], 0
        for b in batches:
            ids, tags = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            # Of equal texts the smallest id offers: the others can't be the copy that stays.
            least: dict[bytes, int] = {}
            for at, texts in _in_slices(b.column(2)):
                for i, t in enumerate(texts, at):
                    name = hashlib.sha256(t).digest()
                    if ids[i] < ids[least.setdefault(name, i)]:
                        least[name] = i
            once = set(least.values())
            for at, texts in _in_slices(b.column(2)):
                for a in anchors([t if i in once else b"" for i, t in enumerate(texts, at)]):
                    held.append((ids[at + a.row], tags[at + a.row], a.key))
                    n += len(a.key)
                    if n >= GATHER:
                        yield from _offered(held, parts, turn)
                        turn, held, n = turn + 1, [], 0
        if held:
            yield from _offered(held, parts, turn)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(doc: np.ndarray, tag: np.ndarray, key: np.ndarray, is_hot: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), pa.array(key), pa.array(np.full(len(doc), is_hot))], ["doc", "tag", "key", "hot"])

        for part, blobs in _numbered(batches):
            items = []
            for blob in blobs:
                arrays = _unpacked(blob)
                if len(arrays) == 3:  # shared within one task: known already
                    yield table(*arrays, False)
                else:
                    items.append(arrays)
            if not items:
                continue
            low, doc, tag, n = (np.concatenate(c) for c in zip(*items, strict=True))
            order = np.argsort(low, kind="stable")
            low, doc, tag, n = low[order], doc[order], tag[order], n[order].astype(np.int64)
            edges = _group_edges(low)
            size = np.diff(np.r_[edges, len(low)])
            found = (np.minimum.reduceat(doc, edges) != np.maximum.reduceat(doc, edges)) | (np.maximum.reduceat(n, edges) > 1)
            total = np.add.reduceat(n, edges)
            tell = np.repeat(found, size) & (n == 1)
            yield table(doc[tell], tag[tell], low[tell].astype(np.int64) | (part << 32), False)
            many = edges[total > hot]
            yield table(np.full(len(many), -1), np.zeros(len(many), np.int64), low[many].astype(np.int64) | (part << 32), True)

    found = docs.select("doc", "tag", "text").mapInArrow(offer, "part int, blob binary")
    return staged(found.repartition("part").sortWithinPartitions("part").mapInArrow(answer, "doc long, tag long, key long, hot boolean"), "shared")


def _offered(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int, turn: int) -> Iterator[pa.RecordBatch]:
    """Anchors by part, one item for each with the number of documents here that have it;
    what two of them share is known at once and needs no answer."""
    doc, tag, key = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(key, kind="stable")
    doc, tag, key = doc[order], tag[order], key[order]
    edges = _group_edges(key)
    several = np.repeat(np.diff(np.r_[edges, len(key)]) > 1, np.diff(np.r_[edges, len(key)]))
    # One row for a document's anchor; few anchors come twice, so only those are sorted.
    twice = np.nonzero(several)[0]
    twice = twice[np.lexsort((tag[twice], doc[twice], key[twice]))]
    again = np.zeros(len(twice), bool)
    again[1:] = (key[twice][1:] == key[twice][:-1]) & (doc[twice][1:] == doc[twice][:-1]) & (tag[twice][1:] == tag[twice][:-1])
    keep = np.ones(len(key), bool)
    keep[twice[again]] = False
    doc, tag, key = doc[keep], tag[keep], key[keep]
    edges = _group_edges(key)
    count = np.diff(np.r_[edges, len(key)])
    reply = np.repeat(count > 1, count)
    known = doc[reply], tag[reply], _short(key[reply], parts)
    one, tag, key = doc[edges], tag[edges], key[edges]
    part = _part(key, parts)  # in order, as keys are
    cuts = np.searchsorted(part, np.arange(parts + 1))
    low, count = (key & _U(0xFFFFFFFF)).astype(np.uint32), count.astype(np.uint32)
    rows = []
    for p in np.nonzero(np.diff(cuts))[0].tolist():
        at = slice(cuts[p], cuts[p + 1])
        by = np.argsort(one[at], kind="stable")
        rows.append((p, _packed(low[at][by], one[at][by], tag[at][by], count[at][by])))
    for at in range(0, len(known[0]), 1 << 18):
        rows.append(((turn * 7 + at) % parts, _packed(*(x[at : at + (1 << 18)] for x in known))))
    if rows:
        yield _blobs(rows)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    part, blobs = None, []
    for b in batches:
        for p, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if p != part and blobs:
                yield part, blobs
                blobs = []
            part = p
            blobs.append(blob.as_py())
    if blobs:
        yield part, blobs


def _short(key: np.ndarray, parts: int) -> np.ndarray:
    """What an answer calls an anchor: its part and the low half of its hash."""
    return (_part(key, parts) << 32) | (key & _U(0xFFFFFFFF)).astype(np.int64)


def _distinct(around: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, row -> number) of equal surroundings: rows of 80 bytes, zeros at the end."""
    words = around.view(_U)
    h = key ^ size.astype(_U)
    for i in range(words.shape[1]):
        h = _mixed(h * _U(0x9E3779B97F4A7C15) + words[:, i])
    order = np.argsort(h, kind="stable")
    edges = _group_edges(h[order])
    count = np.diff(np.r_[edges, len(order)])
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(edges)), count)
    first = order[edges]
    # Equal hashes of different bytes, if ever, become surroundings of their own.
    odd = np.nonzero((around != around[first[number]]).any(axis=1) | (key != key[first[number]]) | (size != size[first[number]]))[0]
    number[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), number


class RunIndex:
    """Run-length BWT over texts, of which none is longer than ``AROUND``.

    ``runs`` are maximal stretches of equal characters; suffix positions are kept for the
    first and the last row of each. ``least`` has, for each range of rows whose suffixes
    share their first ``LENGTH`` characters, the smallest id of their texts.
    """

    def __init__(self, around: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        width = around.shape[1] + 1
        padded = np.zeros((len(around), width), np.uint8)
        padded[:, :-1] = around + 1  # no UTF-8 byte is 255; 0 ends a text
        padded[np.arange(width)[None, :] >= size[:, None]] = 0
        keep = np.arange(width)[None, :] <= size[:, None]
        self.text = padded[keep]
        n = len(self.text)
        owner = np.repeat(np.arange(len(around)), size + 1)
        left = np.repeat(np.cumsum(size + 1), size + 1) - np.arange(n)  # characters with the end
        # Ranks by the first 8, 16, ... characters; nothing counts beyond a text's end.
        wide = np.zeros(n + 8, np.uint8)
        wide[:n] = self.text
        x = np.zeros(n, _U)
        for k in range(8):
            x = (x << _U(8)) | np.where(left > k, wide[k : n + k], 0).astype(_U)
        rank = np.unique(x, return_inverse=True)[1].astype(np.int64) + 1
        k, at32 = 8, None
        while k < width:
            if k == 32:
                at32 = rank
            after = np.zeros(n, np.int64)
            has = np.nonzero(left > k)[0]
            after[has] = rank[has + k]
            rank = np.unique(rank * (rank.max() + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
            k *= 2
        sa = np.argsort(rank * (len(around) + 1) + owner, kind="stable")
        before = np.where(sa > 0, self.text[sa - 1], 0)
        heads = _group_edges(before)
        # Runs by character, then by first row: one search answers rank and select.
        char, last = before[heads].astype(np.int64), np.r_[heads[1:], n] - 1
        order = np.argsort(char * (n + 1) + heads, kind="stable")
        self.n, self.char, self.head, self.last = n, char[order], heads[order], last[order]
        self.place = self.char * (n + 1) + self.head
        length = self.last - self.head + 1
        total = np.cumsum(length) - length
        self.seen = total - total[np.searchsorted(self.char, self.char)]
        self.first_sample, self.last_sample = sa[self.head], sa[self.last]
        self.top = int(sa[0])
        self.begins = np.searchsorted(np.sort(self.text), np.arange(257))
        # Rows that share their first LENGTH characters.
        if at32 is None:
            at32 = rank
        whole = left[sa] > LENGTH
        tail = np.minimum(sa + LENGTH - 32, n - 1)
        new = np.ones(n, bool)
        new[1:] = ~(whole[1:] & whole[:-1] & (at32[sa[1:]] == at32[sa[:-1]]) & (at32[tail[1:]] == at32[tail[:-1]]))
        self.group = np.nonzero(new)[0]
        self.least = np.minimum.reduceat(ids[owner[sa]], self.group)

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common beginning of two suffixes, up to ``most``."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for k in range(AROUND):
            live = live[most[live] > k]
            x, y = a[live] + k, b[live] + k
            ok = (x < self.n) & (y < self.n)
            ok[ok] = (self.text[x[ok]] == self.text[y[ok]]) & (self.text[x[ok]] != 0)
            live = live[ok]
            if not len(live):
                break
            out[live] += 1
        return out

    def stream(self, around: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of many texts in step, from the end: (place, texts at it,
        length of the longest match there, a row of the index with it)."""
        row, length = np.zeros(len(around), np.int64), np.zeros(len(around), np.int64)
        pos = np.full(len(around), self.top)
        for k in range(int(size.max(initial=0)) - 1, -1, -1):
            live = np.nonzero(size > k)[0]
            c = around[live, k].astype(np.int64) + 1
            q = row[live]
            run = np.searchsorted(self.place, c * (self.n + 1) + q, side="right") - 1
            here = (run >= 0) & (self.char[run] == c)
            hit = here & (self.last[run] >= q)
            # Elsewhere the next row with this character, up or down, whichever fits longer.
            miss = np.nonzero(~hit)[0]
            up_ok = here[miss]
            down = np.minimum(run[miss] + 1, len(self.char) - 1)
            down_ok = (self.char[down] == c[miss]) & (run[miss] + 1 < len(self.char))
            now = pos[live[miss]]
            most = length[live[miss]]
            up_pos, down_pos = self.last_sample[run[miss]], self.first_sample[down]
            up_len = np.where(up_ok, self._common(now, up_pos, most), -1)
            down_len = np.where(down_ok, self._common(now, down_pos, most), -1)
            take_down = down_len > up_len
            run[miss] = np.where(take_down, down, run[miss])
            q[miss] = np.where(take_down, self.head[down], self.last[run[miss]])
            none = np.maximum(up_len, down_len) < 0
            pos[live[miss]] = np.where(take_down, down_pos, up_pos)
            length[live[miss]] = np.maximum(np.maximum(up_len, down_len), 0)
            row[live] = self.begins[c] + self.seen[run] + q - self.head[run]
            pos[live] -= 1
            length[live] += 1
            lost = live[miss[none]]  # a character that the index doesn't have
            row[lost], pos[lost], length[lost] = 0, self.top, 0
            yield k, live, length[live], row[live]

    def marks(self, around: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Bit j: the window from j on stands in a text with a smaller id."""
        out = np.zeros(len(around), np.int64)
        for k, live, length, row in self.stream(around, size):
            long = length >= LENGTH
            if k < SPAN and long.any():
                least = self.least[np.searchsorted(self.group, row[long], side="right") - 1]
                out[live[long]] |= (least < ids[live[long]]).astype(np.int64) << k
        return out


def repeat_marks(docs: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """(doc, tag, start, mask): bit j marks the window from start + j on. ``docs`` has (doc, tag,
    text, keys), keys being the short names of the document's shared anchors."""
    shared_hot = docs.sparkSession.sparkContext.broadcast(np.sort(hot))

    def hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for b in batches:
            ids, tags = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            wanted, offsets = b.column(3).flatten().to_numpy(zero_copy_only=False), b.column(3).offsets.to_numpy()
            offsets = offsets - offsets[0]
            want = np.sort(_pair(np.repeat(np.arange(len(ids)), np.diff(offsets)), wanted))
            for first, a in ((first, a) for first, texts in _in_slices(b.column(2)) for a in anchors(texts)):
                a.row += first
                name = _short(a.key, parts)
                pair = _pair(a.row, name)
                keep = want[np.minimum(np.searchsorted(want, pair), len(want) - 1)] == pair if len(want) else np.zeros(len(pair), bool)
                row, start, at, n, key, name = a.row[keep], a.start[keep], a.at[keep], a.n[keep], a.key[keep], name[keep]
                is_hot = np.isin(name, shared_hot.value)
                if is_hot.any():
                    one = np.repeat(np.nonzero(is_hot)[0], n[is_hot])
                    step = np.arange(len(one)) - np.repeat(np.cumsum(n[is_hot]) - n[is_hot], n[is_hot])
                    window = np.lib.stride_tricks.sliding_window_view(a.bytes, LENGTH)[at[one] + step]
                    h = np.zeros(len(one), _U)
                    for k in (0, 8, 16, 24, 32, 40, 42):
                        h = _mixed(h ^ np.ascontiguousarray(window[:, k : k + 8]).view(_U)[:, 0])
                    row, start, at, key = (np.r_[x[~is_hot], y] for x, y in ((row, row[one]), (start, start[one] + step), (at, at[one] + step), (key, h)))
                    n = np.r_[n[~is_hot], np.ones(len(one), np.int64)]
                for at_ in range(0, len(row), GATHER_AROUND):
                    r = slice(at_, at_ + GATHER_AROUND)
                    size = n[r] + LENGTH - 1
                    place = np.minimum(at[r].astype(np.int32)[:, None] + np.arange(AROUND, dtype=np.int32)[None, :], np.int32(len(a.bytes) - 1))
                    around = a.bytes[place]
                    around[np.arange(AROUND)[None, :] >= size[:, None]] = 0
                    held.append((around, size, key[r], ids[row[r]], tags[row[r]], start[r]))
                    total += len(size)
                    if total >= GATHER_AROUND:
                        yield _blobs(list(_parts_of(*(np.concatenate(x) for x in zip(*held, strict=True)), parts)))
                        held, total = [], 0
        if held:
            yield _blobs(list(_parts_of(*(np.concatenate(x) for x in zip(*held, strict=True)), parts)))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _by_part(batches):
            yield from _decided(blobs)

    blobs = docs.select("doc", "tag", "text", "keys").mapInArrow(hand_on, "part int, blob binary")
    return staged(blobs.repartition("part").sortWithinPartitions("part").mapInArrow(decide, "doc long, tag long, start int, mask int"), "marks")


def _pair(row: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Row and anchor in one number; a chance equality only hands on bytes in vain."""
    return _mixed(_mixed(row.astype(np.int64).view(_U) + _U(1)) ^ name.view(_U))


def _parts_of(around: np.ndarray, size: np.ndarray, key: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    first, number = _distinct(around, size, key)
    for part, rows in _slices(_part(key, parts)):
        used, local = np.unique(number[rows], return_inverse=True)
        f = first[used]
        yield part, _packed(key[f], size[f].astype(np.uint8), around[f].reshape(-1), local.astype(np.uint32), doc[rows], tag[rows], start[rows].astype(np.uint32))


def _decided(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Marks of all documents that have an anchor of this part."""
    keys, sizes, arounds, locals_, docs, tags, starts, n = [], [], [], [], [], [], [], 0
    for blob in blobs:
        key, size, around, local, doc, tag, start = _unpacked(blob)
        keys.append(key)
        sizes.append(size.astype(np.int64))
        arounds.append(around.reshape(-1, AROUND))
        locals_.append(local.astype(np.int64) + n)
        docs.append(doc)
        tags.append(tag)
        starts.append(start.astype(np.int64))
        n += len(key)
    key, size, around, local, doc, tag, start = (np.concatenate(x) for x in (keys, sizes, arounds, locals_, docs, tags, starts))
    first, number = _distinct(np.ascontiguousarray(around), size, key)
    key, size, around, which = key[first], size[first], around[first], number[local]
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    partial = np.zeros(len(first), np.int64)
    order = np.argsort(key, kind="stable")
    edges = _group_edges(key[order])
    count = np.diff(np.r_[edges, len(order)])
    several = np.repeat(count > 1, count)
    rows, group = order[several], np.repeat(np.arange(len(edges)), count)[several]
    # Whole groups to an index, about SLAB bytes each.
    slab = np.cumsum(size[rows] + 1) // SLAB
    ends = np.r_[_group_edges(group), len(rows)]
    at = 0
    while at < len(ends) - 1:
        to = at + 1
        while to < len(ends) - 1 and slab[ends[to + 1] - 1] == slab[ends[at]]:
            to += 1
        part = rows[ends[at] : ends[to]]
        part = part[np.argsort(least[part], kind="stable")]
        index = RunIndex(around[part], size[part], least[part])
        # The smallest id of its anchor has nobody before it.
        lowest: dict[int, int] = {}
        for k, m in zip(key[part].tolist(), least[part].tolist(), strict=True):
            lowest.setdefault(k, m)
        ask = part[np.array([lowest[k] < m for k, m in zip(key[part].tolist(), least[part].tolist(), strict=True)], bool)]
        partial[ask] = index.marks(around[ask], size[ask], least[ask])
        at = to
    full = (np.int64(1) << (size - LENGTH + 1)) - 1
    mask = np.where(doc > least[which], full[which], partial[which])
    ok = mask != 0
    yield pa.RecordBatch.from_arrays([pa.array(doc[ok]), pa.array(tag[ok]), pa.array(start[ok].astype(np.int32)), pa.array(mask[ok].astype(np.int32))], ["doc", "tag", "start", "mask"])


def cut(text: bytes, starts: np.ndarray, masks: np.ndarray, whole: bool) -> tuple[int, int, bytes]:
    """(bytes removed, runs of them, what is kept)."""
    if len(text) < LENGTH or not (whole or len(starts)):
        return 0, 0, text
    if whole:
        return len(text), 1, b""
    edge = np.zeros(len(text) + 1, np.int64)
    some = max(1 << 14, len(text) // 64)  # marks at once: about as much memory as the edges
    for k in range(0, len(starts), some):
        row, step = np.nonzero((masks[k : k + some, None] >> np.arange(SPAN)) & 1)
        at = starts[k : k + some][row] + step
        at = at[at + LENGTH <= len(text)]
        edge += np.bincount(at, minlength=len(edge))
        edge -= np.bincount(at + LENGTH, minlength=len(edge))
    gone = np.cumsum(edge[:-1]) > 0
    return int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), np.frombuffer(text, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int | None = None) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    sha = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    slim = rows.where("doc is not null").select("doc", sha.alias("sha"), F.octet_length("text").cast("long").alias("size"))
    # An id with several texts, which is rare: those get a tag, all others zero.
    by_id = slim.groupBy("doc").agg(F.min("sha").alias("a"), F.max("sha").alias("b"), F.count("*").alias("n"), F.sum("size").alias("size"))
    by_id = staged(by_id.select("doc", (F.col("a") < F.col("b")).alias("several"), "n", "size"), "ids")
    several = by_id.where("several").select("doc", F.lit(True).alias("several"))
    total = by_id.agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.count_if("several").alias("several")).first()
    several = F.broadcast(several) if total["several"] <= BROADCAST_IDS else several
    tag = F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    rows = rows.join(several, "doc", "left").select("doc", tag.alias("tag"), "text")
    parts = max(PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["size"] or 0) // PART_BYTES))
    if hot is None:
        # An anchor stands for 16 windows on average; half of that is reckoned with.
        hot = max(HOT_LEAST, (total["n"] or 0) // HOT_SHARE, (total["size"] or 0) // (8 * HOT_ANCHORS))
    address = rows.where("doc is not null").select("doc", "tag", sha.alias("sha"))
    least = address.groupBy("sha").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    # Written, so that the join deals it out anew and may split a frequent text's rows.
    some = staged(least.where("least < most").select("sha", "least"), "copied")
    copies = staged(address.join(some, "sha").where("doc > least").select("doc", "tag").distinct(), "copies")
    shared = shared_anchors(rows.where("doc is not null"), parts, hot)
    frequent = shared.where("hot").select("key").distinct().toPandas()["key"].to_numpy(np.int64)
    named = shared.where("not hot").join(copies, ["doc", "tag"], "left_anti").groupBy("doc", "tag").agg(F.collect_list("key").alias("keys"))
    marks = repeat_marks(rows.join(named, ["doc", "tag"]), parts, frequent)
    per_doc = marks.groupBy("doc", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks"))
    both = per_doc.join(copies.withColumn("whole", F.lit(True)), ["doc", "tag"], "full").withColumn("whole", F.coalesce("whole", F.lit(False)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for b in batches:
            out = []
            for t, s, m, whole in zip(_encoded(b.column(1)), b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
                at = (s.values.to_numpy().astype(np.int64), m.values.to_numpy().astype(np.int64)) if s.is_valid else (none, none)
                n, runs, kept = cut(t, *at, bool(whole))
                out.append((len(t), n, runs, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.binary())], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(both, ["doc", "tag"], "left").select("doc", "text", "starts", "masks", "whole")
    out = joined.mapInArrow(finish, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("doc", key)


def op3_repeat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")
