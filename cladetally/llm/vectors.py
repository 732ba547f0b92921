"""Nearest neighbours of stated query vectors by a block matrix join.

Candidates and queries are cut into blocks. A tile is one query block against a run of candidate blocks, made
by an equality join on the tile's number, so every stated query meets every candidate once. In a tile the
vectors are rounded to int8 with a scale of their own, and the products of the int8 matrices estimate all inner
products. With x = s_x q_x + e_x the estimate s_x s_y <q_x, q_y> is off by at most
|s_x q_x| |e_y| + |e_x| |y|. Pairs whose upper bound reaches the k-th best lower bound are computed anew in double
precision from the original vectors and kept in one heap per query; the heap's worst entry prunes later
blocks of the run. The tiles' results, k per query at most, are merged by rank.

Nothing is approximate in the result: a pair is only dropped when its bound shows that k others are better.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows without an id; vectors meet only vectors of their own length; of rows with an equal id the smallest
vector counts; ties go to the smaller id; a query with fewer than k candidates gets them all; an empty table
gives no rows; other columns are ignored.
"""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladetally.session import materialize

INFINITY = float("inf")


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows that take part, as `vec_id long, v array<double>`, one per id."""
    v = F.col("v")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INFINITY)
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0))
            .groupBy("vec_id").agg(F.min("v").alias("v")))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 components, scale, norm of the rounded vector, norm of the rounding error."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale = np.where(scale > 0, scale, 1.0)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    rounded = q * scale[:, None]
    return q, scale, np.linalg.norm(rounded, axis=1), np.linalg.norm(x - rounded, axis=1)


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 matrices: runs of 1,024 components stay below 2^24, where float32 is exact."""
    total = None
    for at in range(0, a.shape[1], 1024):
        part = a[:, at:at + 1024].astype(np.float32) @ b[:, at:at + 1024].astype(np.float32).T
        total = part if total is None else total.astype(np.float64) + part
    return total


def search_tile(query_ids, queries, ids, vectors, k: int, block_rows: int = 2048, strip_rows: int = 256) -> list[tuple]:
    """Best k of `vectors` for each query as (query_id, vec_id, score), exact in double precision."""
    found = []
    q8, q_scale, q_norm, q_error = quantise(queries)
    q_length = np.linalg.norm(queries, axis=1)
    blocks = [(ids[at:at + block_rows], vectors[at:at + block_rows], *quantise(vectors[at:at + block_rows]))
              for at in range(0, len(ids), block_rows)]
    for top in range(0, len(query_ids), strip_rows):
        strip = slice(top, top + strip_rows)
        heaps = [[] for _ in query_ids[strip]]
        worst = np.full(len(heaps), -INFINITY)
        for block_ids, block, c8, c_scale, c_norm, c_error in blocks:
            with np.errstate(over="ignore", invalid="ignore"):
                estimate = int8_product(q8[strip], c8) * q_scale[strip, None] * c_scale[None, :]
                c_length = c_norm + c_error
                slack = (q_norm[strip, None] * c_error[None, :] + q_error[strip, None] * c_length[None, :])
                # Room for rounding in the bounds themselves.
                slack += 1e-6 * (q_length[strip, None] * c_length[None, :])
                unsure = ~np.isfinite(estimate) | ~np.isfinite(slack)
                upper = np.where(unsure, INFINITY, estimate + slack)
                lower = np.where(unsure, -INFINITY, estimate - slack)
            own = query_ids[strip, None] == block_ids[None, :]
            lower[own] = upper[own] = -INFINITY
            level = worst
            if len(block_ids) > k:
                level = np.maximum(worst, np.partition(lower, len(block_ids) - k, axis=1)[:, len(block_ids) - k])
            rows, cols = np.nonzero((upper >= level[:, None]) & ~own)
            for at in range(0, len(rows), 65_536):
                r, c = rows[at:at + 65_536], cols[at:at + 65_536]
                scores = (queries[strip][r] * block[c]).sum(axis=1)
                for row, name, score in zip(r.tolist(), block_ids[c].tolist(), scores.tolist()):
                    heap, entry = heaps[row], (score, -name)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
            worst = np.array([h[0][0] if len(h) == k else -INFINITY for h in heaps])
        for query_id, heap in zip(query_ids[strip].tolist(), heaps):
            found += [(query_id, -name, score) for score, name in heap]
    return found


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, candidate_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """The k candidates with the largest inner product for every query: query_id, rank from 1, vec_id, score.

    Both frames come from `usable`. `candidate_rows` and `query_rows` bound the rows of a tile's two sides, and
    so a task's memory; the number of tiles is the product of the two block counts. A query's own row, by id,
    is no candidate."""
    vectors, queries = materialize(vectors), materialize(queries)
    runs = max(1, math.ceil(vectors.count() / candidate_rows))
    strips = max(1, math.ceil(queries.count() / query_rows))

    def tiled(frame, mine: int, other: int, mine_first: bool):
        own = F.pmod(F.xxhash64("vec_id"), F.lit(mine))
        number = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long")))
        named = frame.withColumn("dim", F.size("v")).withColumn("own", own)
        packed = named.withColumn("other", number)
        pair = ["own", "other"] if mine_first else ["other", "own"]
        return packed.select("vec_id", "v", "dim", F.col(pair[0]).alias("run"), F.col(pair[1]).alias("strip"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        sides = []
        for side in (left, right):
            names = side.column("vec_id").to_numpy()
            flat = side.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            sides += [names, flat.reshape(len(names), -1)]
        found = search_tile(sides[2], sides[3], sides[0], sides[1], k)
        ids, names, scores = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(names, pa.int64()), "score": pa.array(scores, pa.float64())})

    keys = ["dim", "run", "strip"]
    parts = (tiled(vectors, runs, strips, True).groupBy(*keys)
             .cogroup(tiled(queries, strips, runs, False).groupBy(*keys))
             .applyInArrow(solve, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
