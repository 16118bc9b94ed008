"""Nearest neighbours by a block matrix join of int8 tiles with error bounds, made exact in double precision.

Every vector is scaled to int8; what the rounding leaves over is known exactly, so for a tile of
queries and candidates the integer product gives each inner product with a bound on its error:

    x.y = s t (p.q) + dx.y + (x - dx).dy,   |error| <= |dx| |y| + |x - dx| |dy|

A query's k-th largest lower bound in a tile is a threshold; candidates whose upper bound is below
it are gone, the others are recomputed in double precision from the original vectors and kept in a
heap of k. Heaps of the tiles are merged: nothing is approximate in the result.

Queries and candidates are cut into blocks by a hash of the id, and a tile joins one query block and one
candidate block. Equal vectors are first combined: only the smallest k + 1 ids of each can be among
anyone's nearest, so a vector held by a third of all rows costs no more than any other.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Distinct vectors of a query block and of a candidate block.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 16384
STEP = 256
#: Rows of one vector that are combined in one row, about, before the pieces' smallest ids are.
PIECE_ROWS = 10_000


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales, norms of the rounded vectors and norms of what rounding leaves over."""
    scale = np.abs(vectors).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(vectors / scale[:, None]).astype(np.int8)
    rounded = q * scale[:, None]
    return q, scale, np.linalg.norm(rounded, axis=1), np.linalg.norm(vectors - rounded, axis=1)


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from the first component to the last."""
    return np.add.accumulate(x * y, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _search_tile(k: int):
    def run(rows: pa.Table) -> pa.Table:
        out_q: list[int] = []
        out_v: list[int] = []
        out_s: list[float] = []
        side = rows.column("side").to_numpy()
        vectors = rows.column("vector").combine_chunks()
        lengths = np.diff(vectors.offsets.to_numpy())
        flat, begins = vectors.flatten().to_numpy(), np.cumsum(lengths) - lengths
        ids = rows.column("ids").combine_chunks()
        id_bounds, id_flat = ids.offsets.to_numpy(), ids.flatten().to_numpy()
        id_bounds = id_bounds - id_bounds[0]
        for width in np.unique(lengths[side == 0]).tolist():  # vectors of other lengths have no product
            qs, cs = (np.flatnonzero((side == s) & (lengths == width)) for s in (0, 1))
            if not len(cs):
                continue
            x, y = (np.stack([flat[b : b + width] for b in begins[at].tolist()]).astype(np.float64) for at in (qs, cs))
            qx, sx, nx, dx = quantise(x)
            qy, sy, ny, dy = quantise(y)
            qy_f = qy.T.astype(np.float32)  # products of int8 up to 1000 components are exact in float32
            parts = range(0, width, 1000)
            norm_y = np.linalg.norm(y, axis=1)
            for a in range(0, len(qs), STEP):
                some = slice(a, min(a + STEP, len(qs)))
                product = sum((qx[some, p : p + 1000].astype(np.float32) @ qy_f[p : p + 1000]).astype(np.float64) for p in parts)
                product *= sx[some, None]
                product *= sy[None]
                error = dx[some, None] * norm_y[None] + nx[some, None] * dy[None]
                error += 1e-9 * (1.0 + np.abs(product))
                low = product - error
                n = min(k + 1, len(cs))  # one more, as a query may be among the candidates
                edge = np.partition(low, len(cs) - n, axis=1)[:, len(cs) - n]
                upper = np.add(product, error, out=product)
                for r in range(upper.shape[0]):
                    alive = np.flatnonzero(upper[r] >= edge[r])
                    scores = exact_products(np.broadcast_to(x[a + r], (len(alive), width)), y[alive])
                    members = ((-score, v) for c, score in zip(alive.tolist(), scores.tolist()) for v in id_flat[id_bounds[cs[c]] : id_bounds[cs[c] + 1]].tolist())
                    best = heapq.nsmallest(k + 1, members)
                    for q in id_flat[id_bounds[qs[a + r]] : id_bounds[qs[a + r] + 1]].tolist():
                        own = [m for m in best if m[1] != q][:k]
                        out_q += [q] * len(own)
                        out_v += [v for _, v in own]
                        out_s += [-s for s, _ in own]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return run


def _merge(k: int):
    """Rows sorted by query: the best k of each over all tiles, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []

        def ranked():
            best = sorted(heap, reverse=True)
            return [(now, r + 1, -v, s) for r, (s, v) in enumerate(best)]

        for batch in batches:
            out = []
            for q, v, s in zip(*(c.to_pylist() for c in batch.columns)):
                if q != now:
                    out += ranked()
                    now, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                else:
                    heapq.heappushpop(heap, (s, -v))
            yield _rows(out)
        yield _rows(ranked())

    return run


def _rows(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["query_id", "rank", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product with each row for which `is_query` (SQL) holds.

    A query's own id is no candidate; with fewer candidates than k, all are returned. Ties go to the
    smaller id. Rows without an id, and vectors that are null, empty, zero or hold a null or
    non-finite component, take no part; vectors of other lengths than the query's are no candidates.
    Rows that repeat an id and vector count once; an id with several vectors is a candidate by each
    (the better counts). Other columns are ignored; no queries give no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    v = F.col(vector_col)
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)), F.lit(False)) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vector"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"))
    # the smallest ids of each vector, in two steps: pieces of a hot vector first, and no piece keeps more than it can need
    smallest = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    piece = F.expr(f"cast(pmod(xxhash64(id), {max(1, math.ceil(rows.count() / PIECE_ROWS))}) as int)")
    once = rows.withColumn("piece", piece).groupBy("vector", "piece").agg(smallest(F.collect_list("id")).alias("ids"), F.array_distinct(F.collect_list(F.when(F.col("asks"), F.col("id")))).alias("askers"))
    once = scratch.table(once, "pieces")
    held = once.groupBy("vector").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"))
    candidates = scratch.table(held.select("vector", "ids", F.xxhash64("vector").alias("h")), "candidates")
    # queries of one vector are dealt in pieces of their own, so each stays a bounded row
    queries = scratch.table(once.filter("size(askers) > 0").select("vector", F.col("askers").alias("ids"), F.xxhash64("vector", "piece").alias("h")), "queries")
    n_queries, n_candidates = queries.count(), candidates.count()
    q_blocks, c_blocks = max(1, math.ceil(n_queries / QUERY_BLOCK)), max(1, math.ceil(n_candidates / CANDIDATE_BLOCK))
    deal = lambda df, mine, other, others, side: df.select(
        F.expr(f"cast(pmod(h, {mine[1]}) as int)").alias(mine[0]), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other), F.lit(side).alias("side"), "vector", "ids"
    )
    tiles = deal(queries, ("i", q_blocks), "j", c_blocks, 0).unionByName(deal(candidates, ("j", c_blocks), "i", q_blocks, 1))
    found = tiles.groupBy("i", "j").applyInArrow(_search_tile(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


ORACLE = """
WITH sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
