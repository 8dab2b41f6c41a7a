"""Exact top-k by inner product in three phases with one cutoff per query.

Queries are taken in blocks of at most ``BLOCK`` vectors, each block against all
rows.  Every partition of the rows is a node with its own score lists:

1. each node gives its ``k`` best scores per query, without ids; the k-th best
   of all of them is a score that the answer can't fall below;
2. that cutoff is broadcast, and each node gives the entries that reach it,
   at most ``k`` per query;
3. the scores of those entries are resolved exactly, and the best ``k`` remain.

The first two phases multiply matrices of 32-bit floats.  If their sums may be
inexact, the cutoff is lowered by the largest possible error, and the third phase
computes the products again in integers, for the entries in question only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
#: Scores held at once by a task.
SCORES = 1 << 22
SCALE = 256
SALTS = 64

ENTRY = "query_id bigint, vec_id bigint, score bigint"


def quantised(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and whole vectors floor(256 x), by number of components; unusable rows are left out."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    usable = ids.is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[usable & (sizes > 0)]):
        rows = pa.array(np.flatnonzero(usable & (sizes == size)))
        values = vectors.take(rows).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        values = values.reshape(-1, size)
        sound = np.isfinite(values).all(axis=1)
        yield ids.take(rows).to_numpy()[sound], np.floor(SCALE * values[sound]).astype(np.int64)


class Queries:
    """A block of queries with equally many components."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.floats = np.ascontiguousarray(vectors, dtype=np.float32)
        self.largest = np.abs(vectors).max(axis=1)

    def scores(self, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all queries with some rows, minus infinity for a query with itself; the error of each query."""
        found = self.floats @ vectors.astype(np.float32).T
        bound = self.largest.astype(np.float64) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
        error = np.where(bound < 2**24, 0.0, bound * (vectors.shape[1] + 2) * 2.0**-23)
        order = np.argsort(ids, kind="stable")
        low = np.searchsorted(ids[order], self.ids, "left")
        high = np.searchsorted(ids[order], self.ids, "right")
        for q in np.flatnonzero(high > low):
            found[q, order[low[q] : high[q]]] = -np.inf
        return found, error

    def chunks(self, ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, SCORES // len(self.ids))
        for a in range(0, len(ids), step):
            yield ids[a : a + step], vectors[a : a + step]


def _batches(batches: Iterator[pa.RecordBatch], queries: dict[int, Queries]):
    for batch in batches:
        for ids, vectors in quantised(batch.column(0), batch.column(1)):
            mine = queries.get(vectors.shape[1])
            if mine is not None and len(ids):
                for part in mine.chunks(ids, vectors):
                    yield mine, *part


def _phase_1(rows: DataFrame, shared, k: int) -> DataFrame:
    """The best scores of each node, as floats lowered by their error."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, np.ndarray] = {}
        for mine, ids, vectors in _batches(batches, shared.value):
            size = vectors.shape[1]
            found, error = mine.scores(ids, vectors)
            safe = found - error[:, None]
            if safe.shape[1] > k:
                safe = -np.partition(-safe, k - 1, axis=1)[:, :k]
            merged = np.hstack([lists[size], safe]) if size in lists else safe
            lists[size] = -np.sort(-merged, axis=1)[:, :k]
        for size, scores in lists.items():
            mine = shared.value[size]
            real = [[float(x) for x in row if np.isfinite(x)] for row in scores]
            yield pa.RecordBatch.from_arrays(
                [pa.array(mine.ids), pa.array(real, type=pa.list_(pa.float64()))], names=["query_id", "scores"]
            )

    gathered = rows.mapInArrow(best, "query_id bigint, scores array<double>")
    best_of = F.slice(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), 1, k).alias("scores")
    salted = gathered.groupBy("query_id", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_salt")).agg(best_of)
    return salted.groupBy("query_id").agg(best_of)


def _phase_2(rows: DataFrame, shared, cutoffs, k: int) -> DataFrame:
    """Entries that may belong to the answer, with exact scores; at most ``k`` per query and chunk of a node."""

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mine, ids, vectors in _batches(batches, shared.value):
            found, error = mine.scores(ids, vectors)
            least = np.array([cutoffs.value.get(int(q), -np.inf) for q in mine.ids])
            q, v = np.nonzero((found >= (least - error)[:, None]) & np.isfinite(found))
            scores = found[q, v].astype(np.int64)
            for a in range(0, len(q), 1 << 16):
                part = slice(a, a + (1 << 16))
                inexact = error[q[part]] > 0
                scores[part][inexact] = np.einsum(
                    "ij,ij->i", mine.vectors[q[part][inexact]], vectors[v[part][inexact]]
                )
            order = np.lexsort((ids[v], -scores, q))
            q, v, scores = q[order], v[order], scores[order]
            place = np.arange(len(q)) - np.searchsorted(q, q, "left")
            q, v, scores = q[place < k], v[place < k], scores[place < k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(mine.ids[q]), pa.array(ids[v]), pa.array(scores)], names=["query_id", "vec_id", "score"]
            )

    return rows.mapInArrow(reaching, ENTRY)


def _query_blocks(rows: DataFrame, block: int) -> Iterator[dict[int, Queries]]:
    """The queries in blocks by hash of their id; the driver holds one block at a time."""
    n = -(-rows.count() // block)
    for b in range(n):
        table = rows.filter(F.pmod(F.xxhash64("_id"), F.lit(n)) == b).distinct().toArrow().combine_chunks()
        found: dict[int, Queries] = {}
        for chunk in table.to_batches():
            for ids, vectors in quantised(chunk.column(0), chunk.column(1)):
                if len(ids):
                    found[vectors.shape[1]] = Queries(ids, vectors)
        yield found


def top_k(
    rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """The ``k`` best rows for every query, by inner product of the whole vectors floor(256 x).

    Ties go to the smaller id.  Rows with a NULL id, a NULL or empty vector, or a
    NULL or non-finite component take no part; vectors of different length don't
    meet.  A row with the query's own id is the query itself, also if repeated;
    a repeated query answers once, other repeated rows each take a place.  A
    query without partners gives no rows.
    """
    vectors = rows.select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("_vector"))
    queries = rows.filter(is_query).select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("_vector"))
    context = rows.sparkSession.sparkContext
    found = []
    for held in _query_blocks(queries.filter(F.col("_id").isNotNull()), block):
        shared = context.broadcast(held)
        lists = _phase_1(vectors, shared, k)
        cutoff = lists.filter(F.size("scores") >= k).select("query_id", F.element_at("scores", k).alias("cutoff"))
        cutoffs = context.broadcast({r[0]: r[1] for r in cutoff.collect()})  # a block of numbers
        found.append(_phase_2(vectors, shared, cutoffs, k))
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    entries = reduce(DataFrame.unionAll, found)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = entries.withColumn("rank", place).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def search_report(embeddings: DataFrame) -> DataFrame:
    """The five nearest rows of every row whose id is divisible by 50."""
    return top_k(embeddings, F.col("vec_id") % 50 == 0)
