"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

Vectors are cut into 1, 4 and 16 equal segments; of each the mean and the deviation (root of the summed squared differences from
it) are known. In a segment of n components two vectors' inner product is at most n * mean * mean + deviation * deviation, so with the
norms every resolution bounds the distance from below (and the inner product from above), tighter as it gets finer. Tiles of rows of
like deviation are bounded as a whole first; then each resolution is worked out for what the coarser one left, and
survivors of the finest are computed exactly.

Rows and queries are dealt to a grid: row groups by query blocks, both of bounded size, one cell a task; the grid grows with the
tables, the plan doesn't. Scores against a bounded sample of rows give every query a floor beforehand: no row under it can be among its
best. A cell keeps k rows per query, so what is shuffled after it doesn't grow with the candidates a query has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenground.runtime import materialize

#: Queries in a block and rows in a group, on average: what a cell of the grid holds.
BLOCK_QUERIES, GROUP_ROWS = 16_384, 65_536
#: Rows that the floors are drawn from (they pass the driver) and that are bounded at once.
SAMPLE_ROWS, TILE_ROWS = 2000, 256
SEGMENTS = (1, 4, 16)
_FOUND = "query_id long, vec_id long, score long"


def whole_vectors(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``vec_id``, ``v``: floor(scale * x) of every component as whole numbers, from vectors of finite components only."""
    x = F.col(vector_column)
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return embeddings.where(sound & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v")
    )


def _statistics(m: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per resolution: components of a segment, segment means, segment deviations; a short last segment is padded by zeros."""
    told = []
    for parts in SEGMENTS:
        size = -(-m.shape[1] // parts)
        cut = np.zeros((len(m), parts * size))
        cut[:, : m.shape[1]] = m
        cut = cut.reshape(len(m), parts, size)
        mean = cut.mean(axis=2)
        told.append((size, mean, np.sqrt(((cut - mean[:, :, None]) ** 2).sum(axis=2))))
    return told


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as int64; in floating point where that is exact."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


class _Best:
    """The k highest scores of every query of one dimension, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, floors: np.ndarray, k: int) -> None:
        self.ids, self.m, self.k, self.floors = ids, m, k, floors.astype(float).copy()
        self.statistics = _statistics(m)
        self.score = np.full((len(m), k), np.iinfo(np.int64).min)
        self.vec = np.full((len(m), k), np.iinfo(np.int64).max)

    def offer(self, ids: np.ndarray, m: np.ndarray) -> None:
        told = _statistics(m)
        least = self.floors - 1e-6 * (1 + np.abs(self.floors))
        (size, mean, dev), (_, mean2, dev2) = self.statistics[0], told[0]
        whole = size * np.maximum(mean[:, 0] * mean2.max(), mean[:, 0] * mean2.min()) + dev[:, 0] * dev2.max()
        rows, columns = np.flatnonzero(whole * (1 + 1e-9 * np.sign(whole)) >= least), np.arange(len(ids))
        alive = ids[None, :] != self.ids[rows, None]
        for (size, mean, dev), (_, mean2, dev2) in zip(self.statistics, told, strict=True):
            bound = size * (mean[rows] @ mean2[columns].T) + dev[rows] @ dev2[columns].T
            alive &= bound * (1 + 1e-9 * np.sign(bound)) >= least[rows, None]
            left, right = alive.any(axis=1), alive.any(axis=0)
            rows, columns, alive = rows[left], columns[right], alive[np.ix_(left, right)]
            if not len(rows):
                return
        scores = np.where(alive, _exact(self.m[rows], m[columns]), np.iinfo(np.int64).min)
        score = np.concatenate([self.score[rows], scores], axis=1)
        none = scores == np.iinfo(np.int64).min
        vec = np.concatenate([self.vec[rows], np.where(none, np.iinfo(np.int64).max, ids[columns][None, :])], axis=1)
        first = np.lexsort((vec, -score.astype(float), ~score), axis=1)[:, : self.k]
        self.score[rows], self.vec[rows] = np.take_along_axis(score, first, 1), np.take_along_axis(vec, first, 1)
        low = self.score[:, -1]
        self.floors = np.maximum(self.floors, np.where(low > np.iinfo(np.int64).min, low, -np.inf))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        real = self.vec != np.iinfo(np.int64).max
        return np.repeat(self.ids, real.sum(axis=1)), self.vec[real], self.score[real]


def _by_size(ids: np.ndarray, lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, ids, vectors) of the rows of each dimension."""
    flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    sizes = np.diff(ends)
    for n in np.unique(sizes):
        of = np.flatnonzero(sizes == n)
        yield of, ids[of], flat[ends[of][:, None] + np.arange(n)]


def _arrays(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, pa.ListArray]:
    table = pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table
    table = table.combine_chunks()
    return table.column("vec_id").to_numpy(), table.column("v").chunk(0) if table.num_rows else pa.array([], pa.list_(pa.int64()))


def _best_of(rows: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, m: np.ndarray, floors: np.ndarray, k: int) -> _Best:
    """The best of ``rows`` ((ids, vectors) of the queries' dimension) for every query; rows of large deviation come first."""
    best = _Best(ids, m, floors, k)
    for row_ids, vectors in rows:
        if vectors.shape[1] == m.shape[1]:
            order = np.argsort(-((vectors - vectors.mean(axis=1, keepdims=True)) ** 2).sum(axis=1), kind="stable")
            for low in range(0, len(order), TILE_ROWS):
                part = order[low : low + TILE_ROWS]
                best.offer(row_ids[part], vectors[part])
    return best


def _floors(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``queries`` with ``floor``: the k-th best score among a bounded sample of ``rows``, else NULL."""
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rows.count() // SAMPLE_ROWS))) == 0).limit(SAMPLE_ROWS).collect()
    by_size: dict[int, list] = {}
    for r in drawn:
        by_size.setdefault(len(r["v"]), []).append(r)
    sample = [(np.array([r["vec_id"] for r in x], np.int64), np.array([r["v"] for r in x], np.int64)) for x in by_size.values()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = _arrays(batch)
            floors = np.full(len(ids), -np.inf)
            for of, own, m in _by_size(ids, lists):
                best = _best_of(sample, own, m, floors[of], k)
                floors[of] = best.floors
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors)], ["vec_id", "v", "floor"])

    return queries.select("vec_id", "v").mapInArrow(score, "vec_id long, v array<long>, floor double")


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, block_queries: int = BLOCK_QUERIES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's k highest inner products among ``rows`` but its own id.

    Both tables hold ``vec_id`` and ``v`` (whole numbers, see whole_vectors). Ties go to the smaller vec_id; fewer rows than k are
    all returned; rows of another dimension than the query's take no part, nor do repeated ids count twice (the first by vector
    counts); an empty table gives an empty table. Scores must fit 64 bits.
    """
    rows, queries = (materialize(x.groupBy("vec_id").agg(F.min("v").alias("v"))) for x in (rows, queries))
    context = rows.sparkSession.sparkContext
    n_rows, blocks = rows.count(), max(1, -(-queries.count() // block_queries))
    # at small sizes a group a core; small groups would only repeat the queries
    groups = max(-(-n_rows // group_rows), min(context.defaultParallelism, -(-n_rows // 1000)), 1)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, lists = _arrays(left)
        own = [x[1:] for x in _by_size(ids, lists)] if len(ids) else []
        asked, vectors = _arrays(right)
        floors = right.column("floor").to_numpy()
        found = [_best_of(own, q, m, floors[of], k).found() for of, q, m in _by_size(asked, vectors)] if len(asked) else []
        return pa.table({c: np.concatenate([np.zeros(0, np.int64), *x]) for c, x in zip(("query_id", "vec_id", "score"), zip(*found, strict=True) if found else [()] * 3, strict=True)})

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    placed = lambda df, name, n: df.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    left = placed(rows, "group", groups).withColumn("block", each(blocks)).groupBy("group", "block")
    right = placed(_floors(queries, rows, k), "block", blocks).withColumn("group", each(groups)).groupBy("group", "block")
    found = left.cogroup(right).applyInArrow(cell, _FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
