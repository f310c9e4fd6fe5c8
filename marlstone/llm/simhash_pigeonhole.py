"""SimHash near-duplicates by the generalised pigeonhole principle.

Two 64-bit fingerprints that differ in at most ``distance`` bits differ, in at least one of
m groups of bits, in no more than that group's threshold, if the thresholds t_i satisfy
sum(t_i + 1) = distance + 1 (a group with threshold -1 is never probed). Correlated bits are
put into one group, which keeps the groups themselves nearly independent; a dynamic program
chooses the thresholds, and over all m the cheapest plan, from candidate counts estimated on
a bounded sample. Fewer and wider groups are chosen as the table grows, so candidates stay
in proportion. Every fingerprint is probed and every candidate verified: links are exact.

Equal fingerprints are one node from the start, so copies are never paired. A bucket gives a
spanning forest of its links instead of all pairs; one beyond ``hot`` members is dealt out
anew in pairs of blocks. A null or blank text has the fingerprint zero and links like any
other; texts of any length count whole; an empty table gives no rows. Repeated rows share a
component; columns other than the id and the text are ignored, so no name can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXT_BATCH, documents, lean, sifted, staged, text_or_empty
from .components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: For near copies by the similarity of their sets of shingles.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: Independent fingerprints of a text, the distance to which the plan finds every pair of
#: them, and the distance up to which what it finds is compared by shingles.
FINGERPRINTS, SURE_DISTANCE, WIDE_DISTANCE = 8, 3, 11
_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, FINGERPRINTS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.arange(30, 30 + FINGERPRINTS, dtype=np.uint64)
#: Fingerprints that candidate counts are estimated on, at most.
SAMPLE = 4096
#: Texts, about, and shingles, at most, that tell which shingles are common. That sets the order
#: of a text's shingles, on which the work depends and no result.
ORDER_TEXTS, ORDER_SHINGLES = 1 << 14, 200_000
#: Texts of one shingle from which its pairs are made by a join, of what is not linked yet.
CROWD = 128
#: Longs of 64 bits of a text's sketch.
SKETCH = 16
#: What one candidate costs in units of one row of the index.
PAIR_COST = 0.02
#: Members of a bucket from which it is dealt out in blocks, and members of a block.
HOT = 4096
#: Members from which a bucket is handled by cliques instead of pair by pair.
DENSE = 32


def shingles(text: str | None, shingle: int = SHINGLE) -> list[bytes]:
    """Repeats included; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [joined] if words else []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    return [joined[a:b] for a, b in zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return _fingerprints(_values(shingles(text, shingle)), 1)[0]


def _values(parts: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(s, SEED) for s in parts], "<u8")


def _fingerprints(values: np.ndarray, n: int) -> list[int]:
    """n fingerprints: of the hashes, and of other hashes made from them."""
    if not len(values):
        return [0] * n
    ones = np.zeros(64 * n, np.int64)
    for at in range(0, len(values), 1 << 13):
        some = np.repeat(values[at : at + (1 << 13), None], n, axis=1)
        if n > 1:
            x = (some[:, 1:] ^ (some[:, 1:] >> _SHIFTS[: n - 1])) * _FACTORS[: n - 1]
            some[:, 1:] = (x ^ (x >> np.uint64(32))) * _FACTORS[: n - 1]
        bits = np.unpackbits(some.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # a byte holds the sum of 255 rows
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits((2 * ones > len(values)).astype(np.uint8), bitorder="little").view("<u8").tolist()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): the 64 bits as a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [key, "fp"])

    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` {kind}, fp long")


@dataclass(frozen=True)
class Plan:
    """Bits of each group, and each group's threshold (-1 to 2)."""

    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _grouped(bits: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """m groups of about equal width: each starts from the first free bit and takes the bits
    most correlated with what it has."""
    with np.errstate(all="ignore"):
        c = np.nan_to_num(np.abs(np.corrcoef(bits.T.astype(float)))) if len(bits) > 1 else np.zeros((64, 64))
    free, out = list(range(64)), []
    for i in range(m):
        group = [free.pop(0)]
        while len(group) < (64 * (i + 1)) // m - (64 * i) // m:
            best = max(free, key=lambda b: (c[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        out.append(tuple(sorted(group)))
    return out


def _close_share(bits: np.ndarray, group: tuple[int, ...]) -> list[float]:
    """Share of pairs within 0, 1, 2 bits in a group: the larger of what pairs of the sample
    show and what independent bits would give."""
    p = bits[:, group].mean(axis=0) if len(bits) else np.full(len(group), 0.5)
    model = np.array([1.0, 0.0, 0.0])
    for d in 2 * p * (1 - p):
        model = np.array([model[0] * (1 - d), model[1] * (1 - d) + model[0] * d, model[2] * (1 - d) + model[1] * d])
    weight = (1 << np.arange(len(group), dtype=np.uint64)).astype(np.uint64)
    values = (bits[:, group].astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64)
    seen = np.zeros(3)
    for at in range(0, len(values), 256):
        d = np.bitwise_count(values[at : at + 256, None] ^ values[None, :])
        seen += [(d == k).sum() for k in range(3)]
    seen[0] -= len(values)
    return np.maximum(np.cumsum(model), np.cumsum(seen) / max(1, len(values) * (len(values) - 1))).tolist()


def make_plan(sample: np.ndarray, n: int, distance: int = DISTANCE, meet: float = 1.0) -> Plan:
    """The cheapest groups and thresholds for n fingerprints, from a sample of them; ``meet``
    is the share of pairs that may be compared at all."""
    bits, best = _bits(sample), (float("inf"), None)
    for m in range(max(1, -(-(distance + 1) // 3)), distance + 2):
        groups = _grouped(bits, m)
        state: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for g in groups:
            rows, share = (1, 1 + len(g) / 2, 1 + len(g)), _close_share(bits, g)
            cost = {-1: 0.0} | {t: n * rows[t] + PAIR_COST * n * n / 2 * meet * share[t] * (1, 1, 2)[t] for t in range(3)}
            new: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (c, ts) in state.items():
                for t, x in cost.items():
                    if (k := used + t + 1) <= distance + 1 and (k not in new or c + x < new[k][0]):
                        new[k] = (c + x, (*ts, t))
            state = new
        if distance + 1 in state and state[distance + 1][0] < best[0]:
            best = (state[distance + 1][0], Plan(tuple(groups), state[distance + 1][1]))
    return best[1]


def signatures(fp: np.ndarray, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, row of fp). Under threshold 1 the value and its values with one zero set: of two
    that differ in one bit, one gets to the other. Under 2 all values at distance 1 or less."""
    bits, rows = _bits(fp), np.arange(len(fp))
    for i, (g, t) in enumerate(zip(plan.groups, plan.thresholds, strict=True)):
        if t < 0:
            continue
        own = bits[:, g].astype(np.uint64)
        value = (own << np.arange(len(g), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        mark = np.uint64(i << 58)
        yield value | mark, rows
        for k in range(len(g) if t else 0):
            on = slice(None) if t == 2 else own[:, k] == 0
            yield (value[on] ^ np.uint64(1 << k)) | mark, rows[on]


class Forest:
    """Links in, a spanning forest of the closest of them out: what it holds after shrinking is
    at most one link per node."""

    def __init__(self) -> None:
        self.a, self.b, self.n = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.n += len(a)
            if self.n > 1 << 20:
                self.shrink()

    def shrink(self) -> None:
        """In every round each tree takes its closest link to another one."""
        if not self.n:
            return
        a, b = np.concatenate(self.a), np.concatenate(self.b)
        order = np.argsort(np.bitwise_count(a ^ b), kind="stable")
        a, b = a[order], b[order]
        nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = index[: len(a)], index[len(a) :]
        root, keep = np.arange(len(nodes)), np.zeros(len(a), bool)
        while len(live := np.nonzero(root[x] != root[y])[0]):
            first = np.full(len(nodes), len(a))
            np.minimum.at(first, root[x[live]], live)
            np.minimum.at(first, root[y[live]], live)
            taken = np.unique(first[first < len(a)])
            keep[taken] = True
            while True:
                before = root.copy()
                low = np.minimum(root[x[taken]], root[y[taken]])
                np.minimum.at(root, before[x[taken]], low)
                np.minimum.at(root, before[y[taken]], low)
                while (root[root] != root).any():
                    root = root[root]
                if (root == before).all():
                    break
        self.a, self.b, self.n = [a[keep]], [b[keep]], int(keep.sum())


def _near(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= distance


def _pairs_in_groups(key: np.ndarray, fp: np.ndarray, distance: int, out: Forest) -> None:
    """Links of rows with equal key; rows are sorted by key. Small groups pair by pair, by lag."""
    if not len(key):
        return
    starts = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
    sizes = np.diff(np.r_[starts, len(key)])
    for a, n in zip(starts[sizes > DENSE].tolist(), sizes[sizes > DENSE].tolist(), strict=True):
        _large_group(fp[a : a + n], distance, out)
    small = np.repeat(sizes <= DENSE, sizes)
    key, fp = key[small], fp[small]
    at, lag = np.arange(len(key)), 0
    while True:
        lag += 1
        at = at[at < len(key) - lag]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            return
        hit = at[_near(fp[at], fp[at + lag], distance)]
        out.add(fp[hit], fp[hit + lag])


def _large_group(fp: np.ndarray, distance: int, out: Forest) -> None:
    """Links that connect whatever is connected in one group, fewer than it has members.

    Members within half the distance of a leader are within the distance of each other, so
    they are one clique; cliques are compared only while they are not connected."""
    left, cliques, radius = np.arange(len(fp)), [], []
    while len(left):
        d = np.bitwise_count(fp[left] ^ fp[left[0]])
        near = d <= distance // 2
        cliques.append(left[near])
        radius.append(int(d[near].max()))
        out.add(np.full(int(near.sum()) - 1, fp[left[0]]), fp[left[near][1:]])
        left = left[~near]
    lead, wide, root = fp[[c[0] for c in cliques]], np.array(radius), np.arange(len(cliques))
    for i in range(len(lead) - 1):
        d = np.bitwise_count(lead[i + 1 :] ^ lead[i])
        hit = np.nonzero((d <= distance) & (root[i + 1 :] != root[i]))[0]
        if len(hit):
            hit = hit[np.argsort(d[hit], kind="stable")] + i + 1
            hit = hit[np.unique(root[hit], return_index=True)[1]]
            out.add(np.full(len(hit), lead[i]), lead[hit])
            root[np.isin(root, root[hit])] = root[i]
    # Members of cliques whose leaders are too far apart may still be close.
    for i in np.nonzero(wide >= 0)[0].tolist() if wide.any() else []:
        if (root == root[0]).all():
            return
        d = np.bitwise_count(lead ^ lead[i]).astype(np.int64)
        for j in np.nonzero((d > distance) & (d <= distance + wide + wide[i]) & (root != root[i]))[0].tolist():
            if j > i and root[j] != root[i]:
                d2 = np.bitwise_count(fp[cliques[i], None] ^ fp[cliques[j]][None, :])
                x, y = np.unravel_index(d2.argmin(), d2.shape)
                if d2[x, y] <= distance:
                    out.add(fp[cliques[i][x : x + 1]], fp[cliques[j][y : y + 1]])
                    root[root == root[j]] = root[i]


def _table(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), hot))], ["a", "b", "hot"])


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def links(distinct: DataFrame, plan: Plan, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """(a, b): for every pair of distinct ``fp`` that the plan brings together, within the
    distance, a path of such links. Rows may have ``rooms``, an array of long, beside ``fp``:
    then only those that share a room come together."""
    roomy = "rooms" in distinct.columns

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = _unsigned(b.column(0))
            room = np.zeros(len(fp), np.uint64)
            if roomy:
                fp = fp[pa.compute.list_parent_indices(b.column(1)).to_numpy()]
                room = _unsigned(pa.compute.list_flatten(b.column(1))) * _FACTORS[0]
            for at in range(0, len(fp), 1 << 14):
                part = fp[at : at + (1 << 14)]
                for key, rows in signatures(part, plan):
                    key = key ^ room[at : at + (1 << 14)][rows]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part[rows].view(np.int64))], ["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Forest()
        key = fp = np.zeros(0, np.uint64)
        over = None  # the key of a hot group under way
        for b in batches:
            key, fp = np.concatenate([key, _unsigned(b.column(0))]), np.concatenate([fp, _unsigned(b.column(1))])
            starts = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
            sizes = np.diff(np.r_[starts, len(key)])
            is_hot = sizes > hot
            if over is not None and key[0] == over:
                is_hot[0] = True
            rows = np.repeat(is_hot, sizes)
            yield _table(fp[rows], key[rows], True)
            over = key[-1] if is_hot[-1] else None
            # The last group may go on in the next batch.
            last = starts[-1] if over is None else len(key)
            ready = ~rows[:last]
            _pairs_in_groups(key[:last][ready], fp[:last][ready], distance, out)
            key, fp = key[last:], fp[last:]
        _pairs_in_groups(key, fp, distance, out)
        out.shrink()
        for a, b in zip(out.a, out.b, strict=True):
            yield _table(a, b, False)

    rows = distinct.select("fp", *(["rooms"] if roomy else [])).mapInArrow(lean(probe), "key long, fp long")
    found = staged(rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lean(verify), "a long, b long, hot boolean"), "links")
    plain, rest = found.where("not hot").select("a", "b"), found.where("hot").select(F.col("a").alias("fp"), F.col("b").alias("key")).distinct()
    if rest.isEmpty():
        return plain
    return plain.unionByName(_hot_links(rest, distance, hot))


def _hot_links(rows: DataFrame, distance: int, size: int) -> DataFrame:
    """Large buckets, in pairs of blocks of about ``size`` members."""
    n = rows.groupBy("key").agg(F.ceil(F.count("*") / size).cast("int").alias("n"))
    block = rows.join(n, "key").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    dealt = block.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "fp")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Forest()
        held: tuple | None = None
        left: list[int] = []
        right: list[int] = []

        def flush() -> None:
            _large_group(np.array(left + right, np.int64).view(np.uint64), distance, out)

        for b in batches:
            for key, lo, hi, i, fp in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held != (key, lo, hi):
                    if held:
                        flush()
                    held, left, right = (key, lo, hi), [], []
                (left if i == lo else right).append(fp)
        if held:
            flush()
        out.shrink()
        for a, b in zip(out.a, out.b, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(lean(verify), "a long, b long")


def _linked(distinct: DataFrame, distance: int, hot: int) -> DataFrame:
    """Links (a, b) of a staged table of distinct ``fp``, by the plan that suits its size."""
    n = distinct.count()
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    return links(distinct, make_plan(sample, n, distance), distance, hot)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """(key, fp, component): a component is named by the smallest key in it."""
    all_rows = staged(fingerprints(docs, key, text, shingle), "fingerprints")
    distinct = staged(all_rows.groupBy("fp").agg(F.min(key).alias("first")), "distinct")
    members = components(_linked(distinct, distance, hot)).withColumnRenamed("node", "fp")
    linked = distinct.join(members, "fp", "left")
    named = linked.where("component is not null").groupBy("component").agg(F.min("first").alias("_name"))
    roots = linked.join(named, "component", "left").select("fp", F.coalesce("_name", "first").alias("component"))
    return all_rows.join(roots, "fp").select(key, "fp", "component")


def node_of(text: str = "text") -> Column:
    """What a text is called: null and the empty text are one."""
    return F.xxhash64(text_or_empty(text))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles are similar enough."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, set()
        for batch in batches:
            hit = []
            for a, s, t in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, x = a, set(shingles(s.as_py(), shingle))
                y = set(shingles(t.as_py(), shingle))
                common = len(x & y)
                hit.append(common >= least * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return staged(both.select("a", "b", "s", "t").mapInArrow(lean(run), "a long, b long"), "similar", TEXT_BATCH)


def _decided(pairs: DataFrame, rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of the staged pairs (a, b) that are similar, by the texts of ``rows``."""
    used = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "used")
    texts = staged(sifted(rows, "node", used).where("_may").drop("_may").join(used, "node", "left_semi").dropDuplicates(["node"]), "texts")
    return _verified(pairs, texts, shingle, least)


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    """The set of a text's shingles, hashed and sorted."""
    return np.unique(_values(shingles(text, shingle)))


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """A bit for each place, set if an odd number of different hashes falls there. What two sets
    have in common cancels out, so two sketches differ in no more bits than the sets in members."""
    odd = np.bincount((np.unique(hashes) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _room(least: float) -> float:
    """Sets of n and m members with the similarity differ in no more than this times n + m."""
    return (1 - least) / (1 + least)


def _not_apart(x: str, y: str, sizes: Column, least: float) -> Column:
    """Whether the sketches in two columns leave the similarity possible."""
    bits = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SKETCH)), F.lit(0))
    return bits <= _room(least) * sizes + 1e-6


def _sketched(pairs: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that the sketches of ``signed`` don't rule out."""
    of = lambda x: signed.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    return both.where(_not_apart("a_sketch", "b_sketch", F.col("a_n") + F.col("b_n"), least)).select("a", "b")


def _common(rows: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, in how many) of shingles in several of about ORDER_TEXTS of n texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_hashes(t.as_py(), shingle) for t in b.column(1)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["token"])

    some = rows.where(F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(1 << 30)) < int(min(1.0, ORDER_TEXTS / max(1, n)) * (1 << 30)))
    counted = some.mapInArrow(lean(run), "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    found = counted.orderBy(F.desc("n"), "token").limit(ORDER_SHINGLES).toPandas()
    token, often = found["token"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(token)
    return token[order], often[order]


def _mixed(crowd: DataFrame, least: float) -> DataFrame:
    """Members (token, a, n, at, a_in) of large buckets that may have a pair there, and ``reach``,
    the largest size of a text with which the shingle may be the first in common."""
    reach = (F.col("n") - F.col("at") + 1e-6) * ((1 + least) / least) - F.col("n")
    # A shingle whose members are in one component by now, or reach none of the others, has no pairs.
    small = crowd.groupBy("token").agg(F.min("n").alias("small"))
    fit = crowd.withColumn("reach", reach).join(small, "token").where("reach >= small").drop("small")
    mixed = fit.groupBy("token").agg((F.min("a_in") < F.max("a_in")).alias("mixed")).where("mixed").select("token")
    return fit.join(mixed, "token", "left_semi")


def _with_sketch(members: DataFrame, signed: DataFrame) -> DataFrame:
    return members.join(signed.select(F.col("node").alias("a"), "sketch"), "a")


def _crowd_pairs(crowd: DataFrame, least: float, signed: DataFrame | None = None) -> DataFrame:
    """(a, b, n, m) of members (token, a, n, at, a_in) of large buckets: pairs of different
    components of which one shingle may be the first in common, unless their sketches rule
    them out, if ``signed`` has them."""
    x = _mixed(crowd, least)
    if signed is not None:
        x = _with_sketch(x, signed)
    y = x.select("token", F.col("a").alias("b"), F.col("n").alias("m"), F.col("a_in").alias("b_in"), F.col("reach").alias("b_reach"), *([F.col("sketch").alias("b_sketch")] if signed is not None else []))
    fits = (F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9) & (F.col("reach") >= F.col("m")) & (F.col("b_reach") >= F.col("n"))
    if signed is not None:
        fits = fits & _not_apart("sketch", "b_sketch", F.col("n") + F.col("m"), least)
    return x.join(y, "token").where((F.col("a") < F.col("b")) & (F.col("a_in") != F.col("b_in")) & fits).select("a", "b", "n", "m").distinct()


def _closest(crowd: DataFrame, signed: DataFrame, least: float, hot: int) -> DataFrame:
    """(a, b), staged: for each member of a large bucket outside its largest component at most
    two of other components that it may be similar to: by sketch the closest of the largest
    component, and of the rest. As many rows as members, however many pairs there are."""
    members = _mixed(crowd, least)
    n = members.groupBy("token").agg(F.ceil(F.count("*") / hot).cast("int").alias("blocks"))
    block = members.join(n, "token").withColumn("i", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    dealt = block.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")})
    rows = _with_sketch(dealt, signed).select("token", "lo", "hi", "a", "n", "reach", "a_in", "sketch")

    def one(node: np.ndarray, size: np.ndarray, reach: np.ndarray, home: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[int, int]]:
        homes, counts = np.unique(home, return_counts=True)
        main = home == homes[counts.argmax()]
        for x in np.nonzero(~main)[0].tolist():
            at = np.nonzero((home != home[x]) & (reach >= size[x]) & (size <= reach[x]) & (np.minimum(size, size[x]) >= least * np.maximum(size, size[x]) - 1e-9))[0]
            d = np.bitwise_count(sketch[at] ^ sketch[x]).sum(axis=1, dtype=np.int64)
            near = d <= _room(least) * (size[at] + size[x]) + 1e-6
            for of in (main[at] & near, ~main[at] & near):
                if of.any():
                    y = at[of][d[of].argmin()]
                    yield int(min(node[x], node[y])), int(max(node[x], node[y]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list[np.ndarray]) -> pa.RecordBatch:
            key, rest = np.stack(parts[:3], axis=1), parts[3:]
            cuts = np.r_[0, np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1, len(key)]
            out = sorted({p for a, b in zip(cuts[:-1], cuts[1:], strict=True) for p in one(*(x[a:b] for x in rest))})
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        held: list[np.ndarray] | None = None
        for b in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in b.columns[:-1]] + [_unsigned(pa.compute.list_flatten(b.column(b.num_columns - 1))).reshape(-1, SKETCH)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            # The last bucket may go on in the next batch.
            other = np.nonzero(np.any([k != k[-1:] for k in held[:3]], axis=0))[0]
            if len(other):
                yield found([x[: other[-1] + 1] for x in held])
                held = [x[other[-1] + 1 :] for x in held]
        if held is not None and len(held[0]):
            yield found(held)

    pairs = rows.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi").mapInArrow(lean(run), "a long, b long")
    return staged(pairs.distinct(), "closest")


def _met(rows: DataFrame, n: int, shingle: int, least: float) -> DataFrame:
    """(a, b, n, m, first, crowd), staged: pairs of n texts (node, text) that may have the
    similarity; of large buckets the members, as (a, token, n, place).

    Two sets of n and m shingles with a similarity of t have t * max(n, m) in common or more.
    So, in any one order of all shingles, the first n - ceil(t * n) + 1 of one and as many of
    the other have one in common (prefix filter), and those in common there and what stands
    behind them are at least t / (1 + t) * (n + m). Rare shingles come first, which keeps
    buckets small. Of larger ones only what is not linked meets, and only where both have
    enough behind their first common shingle: before it stand i and j of their own, so
    n - i and m - j are t / (1 + t) * (n + m) or more. A copy with too many shingles of its own
    in front thus leaves the bucket before anything is paired. Texts without a shingle are alike.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_common(rows, n, shingle))
    prefix = lambda k: k - math.ceil(least * k - 1e-9) + 1

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value

        def flush() -> pa.RecordBatch:
            node, size = (np.repeat(np.array(x, kind), [len(p) for p in parts]) for x, kind in ((nodes, np.int64), (counts, np.int32)))
            at = np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts])
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(node), pa.array(size), pa.array(at)], ["token", "node", "n", "at"])
            for x in (parts, nodes, counts):
                x.clear()
            return out

        parts, nodes, counts, held = [], [], [], 0
        for b in batches:
            for node, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = _hashes(t.as_py(), shingle)
                size = len(own)
                if not size:
                    own = np.zeros(1, np.uint64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    own = own[np.argsort(np.where(known[at] == own, often[at], 0), kind="stable")]
                parts.append(own[: prefix(size)].copy())
                nodes.append(node)
                counts.append(size)
                held += len(parts[-1])
                if held > 1 << 16:
                    yield flush()
                    held = 0
        if parts:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of small buckets; of others the members themselves, as (node, token, n, place)."""

        def pairs(token: np.ndarray, node: np.ndarray, size: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
            new = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
            token, node, size, rest = token[new], node[new], size[new], (size - place)[new]
            at, lag, out = np.arange(len(token)), 0, []
            while len(at):
                lag += 1
                at = at[at < len(token) - lag]
                # Sizes rise within a bucket: what is too large at one lag is so at all later ones.
                at = at[(token[at] == token[at + lag]) & (size[at] >= least * size[at + lag] - 1e-9)]
                a, b = node[at], node[at + lag]
                first = np.minimum(rest[at], rest[at + lag]) >= least / (1 + least) * (size[at] + size[at + lag]) - 1e-6
                out.append((np.minimum(a, b), np.maximum(a, b), size[at], size[at + lag], first))
            return batch(*(np.concatenate(x) for x in zip(*out, strict=True)), False)

        def batch(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, first: np.ndarray, crowd: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n), pa.array(m), pa.array(first), pa.array(np.full(len(a), crowd))], ["a", "b", "n", "m", "first", "crowd"])

        token = node = np.zeros(0, np.int64)
        size = place = np.zeros(0, np.int32)
        over = None  # the shingle of a crowd under way
        for b in batches:
            token, node, size, place = (np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip((token, node, size, place), b.columns, strict=True))
            if not len(token):
                continue
            starts = np.nonzero(np.r_[True, token[1:] != token[:-1]])[0]
            sizes = np.diff(np.r_[starts, len(token)])
            crowd = sizes > CROWD
            if over is not None and token[0] == over:
                crowd[0] = True
            many = np.repeat(crowd, sizes)
            yield batch(node[many], token[many], size[many], place[many], many[many], True)
            over = token[-1] if crowd[-1] else None
            # The last bucket may go on in the next batch.
            last = starts[-1] if over is None else len(token)
            few = ~many[:last]
            if few.any():
                yield pairs(token[:last][few], node[:last][few], size[:last][few], place[:last][few])
            token, node, size, place = token[last:], node[last:], size[last:], place[last:]
        if len(token):
            yield pairs(token, node, size, place)

    begun = rows.select("node", "text").mapInArrow(lean(begin), "token long, node long, n int, at int")
    return staged(begun.repartition("token").sortWithinPartitions("token", "n", "node").mapInArrow(lean(meet), "a long, b long, n int, m int, first boolean, crowd boolean"), "met", TEXT_BATCH)


def _crowd(met: DataFrame) -> DataFrame:
    """(token, a, n, at), staged: the members of large buckets."""
    return staged(met.where("crowd").select(F.col("b").alias("token"), "a", "n", F.col("m").alias("at")).distinct(), "crowd")


def _at_home(crowd: DataFrame, linked: DataFrame) -> DataFrame:
    """The members with their components, ``a_in``."""
    return crowd.join(linked.select(F.col("node").alias("a"), F.col("component").alias("a_in")), "a", "left").withColumn("a_in", F.coalesce("a_in", "a"))


def _unlinked(met: DataFrame, crowd: DataFrame, signed: DataFrame, linked: DataFrame, least: float) -> DataFrame:
    """(a, b), staged: all pairs of different components of ``linked`` that may be similar."""
    home = lambda x: linked.select(F.col("node").alias(x), F.col("component").alias(f"{x}_in"))
    apart = F.coalesce(F.col("a_in"), F.col("a")) != F.coalesce(F.col("b_in"), F.col("b"))
    plain = met.where("not crowd").groupBy("a", "b").agg(F.count("*").alias("c"), F.max("first").alias("first"), F.max(F.struct("n", "m")).alias("s")).select("a", "b", "c", "first", "s.n", "s.m")
    plain = plain.join(home("a"), "a", "left").join(home("b"), "b", "left").where(apart).select("a", "b", "n", "m", "c", "first")
    dense = _crowd_pairs(_at_home(crowd, linked), least, signed).withColumns({"c": F.lit(0).cast("long"), "first": F.lit(True)})
    # Of large buckets two texts share no more than the one that is in fewer of them.
    crowds = crowd.groupBy("a").agg(F.count("*").alias("k"))
    of = lambda x: crowds.select(F.col("a").alias(x), F.col("k").alias(f"{x}_k"))
    both = plain.unionByName(dense).select("a", "b", F.least("n", "m").alias("n"), F.greatest("n", "m").alias("m"), "c", "first").groupBy("a", "b", "n", "m").agg(F.sum("c").alias("c"), F.max("first").alias("first")).where("first")
    both = both.join(of("a"), "a", "left").join(of("b"), "b", "left")
    common = F.col("c") + F.least(F.coalesce("a_k", F.lit(0)), F.coalesce("b_k", F.lit(0)))
    # Behind the shorter or the longer beginning, whichever ends first in the order.
    behind = F.greatest(*(F.ceil(F.lit(least) * F.col(k) - 1e-9) - 1 for k in ("n", "m")))
    enough = common + behind >= least / (1 + least) * (F.col("n") + F.col("m")) - 1e-6
    return staged(_sketched(both.where(enough), signed, least), "unlinked")


def similar_texts(docs: DataFrame, text: str = "text", distance: int = WIDE_DISTANCE, shingle: int = WIDE_SHINGLE, least: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """(node, component) of every text that has a near copy: two texts are linked if their sets
    of shingles have a Jaccard similarity of ``least``, and no link is left out.

    First, fingerprints propose every pair with one of FINGERPRINTS within SURE_DISTANCE bits,
    and of those up to ``distance`` whatever agrees in a group of the plan. Only sets whose
    sizes allow the similarity come together: sizes fall into classes by powers of 1 / least,
    and a text meets those of its own and of the next class. This is a spanning forest of the
    closest links, so groups of any size give at most one pair per text and task. Then what
    stands alone in a bucket of very many meets its closest there, and ``_unlinked`` gives all
    other pairs that may be similar and are not in one component yet. All are decided by the
    shingles themselves, once their sketches leave them possible.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes = np.zeros((len(b), FINGERPRINTS), np.uint64), np.zeros(len(b), np.int32)
            sketch = np.zeros((len(b), SKETCH), np.uint64)
            for i, t in enumerate(b.column(1)):
                # One text at a time: the shingles of a batch would be many times its texts.
                parts = shingles(t.as_py(), shingle)
                values = _values(parts)
                fps[i], sizes[i], sketch[i] = _fingerprints(values, FINGERPRINTS), len(set(parts)), _sketch(values)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1).view(np.int64))) for x in (fps, sketch)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), *lists], ["node", "n", "fps", "sketch"])

    rows = docs.select(node_of(text).alias("node"), F.col(text).alias("text"))
    signed = staged(rows.mapInArrow(lean(sign), "node long, n int, fps array<long>, sketch array<long>").dropDuplicates(["node"]), "signed", TEXT_BATCH)
    one = signed.select("node", "n", F.posexplode("fps").alias("i", "fp"))
    heads = staged(one.groupBy("i", "fp").agg(F.min(F.struct("n", "node")).alias("h")).select("i", "fp", "h.n", "h.node"), "heads")
    # A text whose fingerprint is another's too is compared with the first.
    same = one.select("i", "fp", F.col("node").alias("b"), F.col("n").alias("m")).join(heads, ["i", "fp"]).where("node <> b").select(F.col("node").alias("a"), "b", "n", "m")
    size = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / -math.log(least) + 1e-9).cast("long")
    room = size * FINGERPRINTS + F.col("i")
    inside = heads.select("fp", F.array(room, room + FINGERPRINTS).alias("rooms"))
    first = heads.where("i = 0")
    sample = first.select("fp", size.alias("size")).orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()
    plan = make_plan(sample["fp"].to_numpy(np.int64).view(np.uint64), first.count(), SURE_DISTANCE, _meeting(sample["size"].to_numpy(np.int64)))
    side = lambda fp, node, n: heads.select(F.col("fp").alias(fp), F.col("node").alias(node), F.col("n").alias(n))
    far = links(inside, plan, distance, hot).select(F.col("a").alias("fa"), F.col("b").alias("fb")).distinct()
    far = far.join(side("fa", "a", "n"), "fa").join(side("fb", "b", "m"), "fb").select("a", "b", "n", "m")
    found = same.unionByName(far).where(F.least("n", "m") >= least * F.greatest("n", "m")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = staged(_sketched(found.where("a <> b").distinct(), signed, least), "pairs")
    near = _decided(pairs, rows, shingle, least)
    linked = components(near)
    met = _met(rows, signed.count(), shingle, least)
    crowd = _crowd(met)
    # Every round halves, at least, the components that have a link to their closest.
    while not (close := _closest(_at_home(crowd, linked), signed, least, hot)).isEmpty():
        if (more := _decided(close, rows, shingle, least)).isEmpty():
            break
        near = near.unionByName(more)
        linked = staged(components(near), "linked")
    rest = _decided(_unlinked(met, crowd, signed, linked, least), rows, shingle, least)
    return linked if rest.isEmpty() else components(near.unionByName(rest))


def _meeting(sizes: np.ndarray) -> float:
    """Share of pairs in one class, twice as they meet in two rooms, or in neighbouring ones."""
    share = np.bincount(sizes) / max(1, len(sizes)) if len(sizes) else np.zeros(1)
    return float(2 * (share**2).sum() + 2 * (share[1:] * share[:-1]).sum())


def op5_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
