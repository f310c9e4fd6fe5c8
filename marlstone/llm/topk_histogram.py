"""Exact top-k by distributed histogram selection.

Every score is computed, in blocks of queries against partitions of candidates. A round
counts scores in bins of the interval that holds each query's k-th value; a task reports
only the bins at or above its own k-th score, below which the global k-th value can't lie.
The interval shrinks to one value, then rows beyond it are kept and ties go to the smallest
ids, of which each task needs to give k at most. No task or driver ever holds a query's
score list, and a query with very many equal scores costs no more than any other.

Blocks go through in waves: one pass over the candidates serves all blocks of a wave, whose
bytes and rows are bounded, and every wave appends to one table, so the plan of the result
does not grow with the number of queries.

Vectors are scaled to integers. A score is the integer inner product of two vectors of one
length; vectors of other lengths are no candidates of a query. Scores are exact: sums that
could pass 2^53 are made of Python's integers. What a long can't hold is given as the
nearest long and ordered by its nearest double. Vectors that are null or empty, or hold a
null or a component that is not finite, also after scaling, take no part, nor do rows with a
null id. Rows with the query's own id are the query. Repeated rows are queries, and
candidates, of their own, each with its rank. An empty table gives an empty result. Other
columns are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, staged_path, table

K = 5
SCALE = 256
#: Bytes and queries of a wave: what a broadcast carries at most.
WAVE_BYTES, WAVE_ROWS = 32 << 20, 1 << 16
#: Queries of a block, at most: with the bins this bounds a task's memory.
BLOCK_ROWS = 2048
BINS = 256
#: Scores held at once.
SCORES = 1 << 22
#: Integers up to which doubles are exact.
EXACT = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)

Block = tuple[int, np.ndarray, np.ndarray]


def scaled(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) as double, of the usable rows."""
    x = F.transform(F.col(vector), lambda e: e.cast("double") * scale)
    # Spark's floor gives a long; doubles from 2^53 on are integers as they are.
    whole = F.transform(x, lambda e: F.when(F.abs(e) < EXACT, F.floor(e).cast("double")).otherwise(e))
    fine = x.isNotNull() & F.col(key).isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(fine).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def _ordered(s: np.ndarray) -> np.ndarray:
    """Integer-valued doubles to longs, in the same order: themselves up to 2^53, beyond it the
    place among doubles, so that neighbouring longs are neighbouring scores everywhere."""
    out = np.where(np.abs(s) <= EXACT, s, 0).astype(np.int64)
    big = np.abs(s) > EXACT
    if big.any():
        base = np.array(EXACT).view(np.int64)
        far = np.abs(s[big]).view(np.int64) - base + np.int64(EXACT)
        out[big] = np.where(s[big] > 0, far, -far)
    return out


def _large(rows: np.ndarray) -> np.ndarray:
    """Vectors whose products may pass 2^53 (|x . y| <= |x| |y|)."""
    with np.errstate(over="ignore"):
        return (rows * rows).sum(axis=1) >= EXACT


def _exactly(a: np.ndarray, b: np.ndarray) -> list[list[int]]:
    """Inner products as Python's integers."""
    x, y = ([[int(e) for e in r] for r in m] for m in (a, b))
    return [[sum(map(int.__mul__, p, q)) for q in y] for p in x]


def _products(block: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Scores as doubles, and as longs where a double may be inexact (else None)."""
    wide, own = _large(rows), _large(block)
    if not wide.any() and not own.any():
        return block @ rows.T, None
    with np.errstate(all="ignore"):
        s = block @ rows.T
    longs = np.where(np.abs(s) <= EXACT, s, 0).astype(np.int64)
    for q, c in ((np.arange(len(block)), np.nonzero(wide)[0]), (np.nonzero(own)[0], np.nonzero(~wide)[0])):
        if len(q) and len(c):
            exact = _exactly(block[q], rows[c])
            most = np.finfo(float).max
            s[np.ix_(q, c)] = [[float(max(-int(most), min(int(most), e))) for e in line] for line in exact]
            longs[np.ix_(q, c)] = np.array([[max(_LONG[0], min(_LONG[1], e)) for e in line] for line in exact], np.int64)
    return s, longs


def _by_length(batch: pa.RecordBatch, lengths: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, matrix) of the candidates of each length that a query has."""
    column = batch.column(1)
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)
    for dim in np.unique(sizes).tolist():
        if dim in lengths:
            ok = sizes == dim
            yield dim, ids[ok], flat[np.repeat(ok, sizes)].reshape(-1, dim)


def _scores(batches: Iterator[pa.RecordBatch], wave: list[Block]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(first query, ids, own, scores, longs) of blocks against candidates; own marks the
    query's own rows."""
    lengths = {m.shape[1] for _, _, m in wave}
    for b in batches:
        for dim, ids, rows in _by_length(b, lengths):
            for first, names, matrix in wave:
                if matrix.shape[1] != dim:
                    continue
                step = max(1, SCORES // len(names))
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    yield first, part, names[:, None] == part[None, :], *_products(matrix, rows[at : at + step])


def _wave_top_k(candidates: DataFrame, wave: list[Block], k: int, path: str) -> None:
    """Appends (query_id, rank, vec_id, score) of a wave's queries."""
    context = candidates.sparkSession.sparkContext
    n = sum(len(ids) for _, ids, _ in wave)
    names = np.concatenate([ids for _, ids, _ in wave])
    shared = context.broadcast(wave)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(n, _LONG[1]), np.full(n, _LONG[0])
        count = np.zeros(n, np.int64)
        for first, _, own, s, _ in _scores(batches, shared.value):
            at, key = slice(first, first + len(own)), _ordered(s)
            count[at] += (~own).sum(axis=1)
            high[at] = np.maximum(high[at], np.where(own, _LONG[0], key).max(axis=1))
            low[at] = np.minimum(low[at], np.where(own, _LONG[1], key).min(axis=1))
        has = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(count[has]), pa.array(low[has]), pa.array(high[has])], ["q", "n", "low", "high"])

    # Longs: the interval is [lo, lo + 2^64 - 1] at most, so widths are unsigned.
    lo, width, rest = np.zeros(n, np.int64), np.ones(n, np.uint64), np.zeros(n, np.int64)
    all_of = np.full(n, True)
    span = candidates.mapInArrow(bounds, "q long, n long, low long, high long").groupBy("q").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    q = span["q"].to_numpy(np.int64)
    all_of[q] = span["n"].to_numpy() <= k
    lo[q], rest[q] = span["low"].to_numpy(np.int64), k
    width[q] = span["high"].to_numpy(np.int64).view(np.uint64) - lo[q].view(np.uint64) + np.uint64(1)

    def histogram(lo: np.ndarray, width: np.ndarray, size: np.ndarray, rest: np.ndarray, open_: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((n, BINS), np.int32)
            for first, _, own, s, _ in _scores(batches, shared.value):
                rows = np.nonzero(open_[first : first + len(own)])[0]
                if len(rows):
                    at = slice(first, first + len(own))
                    off = _ordered(s[rows]).view(np.uint64) - lo[at][rows, None].view(np.uint64)
                    place = (off // size[at][rows, None]).clip(0, BINS - 1).astype(np.int64) + np.arange(len(rows))[:, None] * BINS
                    inside = (off < width[at][rows, None]) & ~own[rows]
                    counts[first + rows] += np.bincount(place[inside], minlength=len(rows) * BINS).reshape(-1, BINS).astype(np.int32)
            above = np.cumsum(counts[:, ::-1], axis=1, dtype=np.int64)[:, ::-1]
            # What lies under this task's own k-th score can't be in the global bin.
            q, at = np.nonzero((counts > 0) & (above - counts < rest[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(at), pa.array(counts[q, at].astype(np.int64)), pa.array(rest[q])], ["q", "bin", "n", "rest"])

        counts = candidates.mapInArrow(run, "q long, bin long, n long, rest long").groupBy("q", "bin").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
        reached = counts.withColumn("above", F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin"))))
        # The bin in which the k-th value is, and how many of it are wanted.
        return reached.where((F.col("above") >= F.col("rest")) & (F.col("above") - F.col("n") < F.col("rest"))).select("q", "bin", (F.col("rest") - F.col("above") + F.col("n")).alias("rest")).toPandas()

    open_ = ~all_of
    while open_.any():
        size = width // np.uint64(BINS) + np.uint64(1)
        found = histogram(lo, width, size, rest, open_)
        q = found["q"].to_numpy(np.int64)
        below = found["bin"].to_numpy(np.int64).view(np.uint64) * size[q]
        lo[q] = (lo[q].view(np.uint64) + below).view(np.int64)
        width[q] = np.minimum(size[q], width[q] - below)
        rest[q] = found["rest"].to_numpy(np.int64)
        open_ &= width > 1

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows beyond the k-th value, and the k best of those at it: by the exact score,
        then by the id."""
        ties: dict[int, list[tuple[int, int]]] = {}

        def rows(q: np.ndarray, ids: np.ndarray, double: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(q), pa.array(ids), pa.array(double), pa.array(score)], ["query_id", "q", "vec_id", "near", "score"])

        for first, ids, own, s, longs in _scores(batches, shared.value):
            at, key = slice(first, first + len(own)), _ordered(s)
            score = key if longs is None else longs
            every = all_of[at][:, None] & ~own
            q, c = np.nonzero(((key > lo[at][:, None]) & ~all_of[at][:, None] & ~own) | every)
            yield rows(q + first, ids[c], key[q, c], score[q, c])
            equal = (key == lo[at][:, None]) & ~all_of[at][:, None] & ~own
            for q in np.nonzero(equal.any(axis=1))[0].tolist():
                # The k smallest ids of each exact score are enough.
                e, i = score[q][equal[q]], ids[equal[q]]
                best = np.lexsort((i, -e.astype(float) if longs is None else ~e))[:k]
                both = [*ties.get(first + q, ()), *((-x, y) for x, y in zip(e[best].tolist(), i[best].tolist(), strict=True))]
                ties[first + q] = sorted(both)[:k]
        q = np.array([q for q, t in ties.items() for _ in t], np.int64)
        flat = [x for t in ties.values() for x in t]
        yield rows(q, np.array([x[1] for x in flat], np.int64), lo[q], np.array([-x[0] for x in flat], np.int64))

    order = Window.partitionBy("q").orderBy(F.desc("near"), F.desc("score"), "vec_id")
    found = candidates.mapInArrow(select, "query_id long, q long, vec_id long, near long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    shared.unpersist()


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for (id, v) tables of integer-valued vectors."""
    spark = queries.sparkSession
    path = staged_path(spark, "topk")
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    # One wave at a time comes to the driver, of bounded size, whatever the number of queries.
    ordered = staged(queries.orderBy(F.size("v"), "id"), "queries")
    wave: list[Block] = []
    ids: list[int] = []
    vectors: list[list[float]] = []
    n = size = 0

    def close_block() -> None:
        nonlocal n, ids, vectors
        if ids:
            wave.append((n, np.array(ids, np.int64), np.array(vectors)))
            n, ids, vectors = n + len(ids), [], []

    def close_wave() -> None:
        nonlocal n, size
        close_block()
        if wave:
            _wave_top_k(candidates, wave, k, path)
            wave.clear()
            n = size = 0

    for r in ordered.toLocalIterator():
        v = r["v"]
        if size + 8 * len(v) > WAVE_BYTES or n + len(ids) >= WAVE_ROWS:
            close_wave()
        if ids and (len(vectors[0]) != len(v) or len(ids) >= BLOCK_ROWS):
            close_block()
        ids.append(r["id"])
        vectors.append(v)
        size += 8 * len(v)
    close_wave()
    return spark.read.schema(schema).parquet(path)


def op9_topk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = staged(scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return top_k(vectors.where(F.col("id") % 50 == 0), vectors)


ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id,
    list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, x: a + x) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(greatest(least(score, 9223372036854775807), -9223372036854775808) AS BIGINT) AS score
FROM r WHERE rank <= 5
"""
