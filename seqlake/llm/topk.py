"""Exact top-k inner products in three phases with a uniform threshold.

The candidates are dealt to shards by a hash of their id and the queries to blocks; a task holds
one shard and one block (``SHARD_ROWS`` by ``BLOCK_ROWS``), so every query meets every candidate
in blocks and memory is bounded whatever the table holds.

1. Each shard gathers, for each query, a list of the k highest scores among its longest vectors
   (one in ``LISTED``), numbers only.
2. The k-th highest of all listed scores is a safe cutoff: at least k entries reach it, so nothing
   below can be in the result. It goes back to the shards. A shard takes the inner product over all
   components but the last one in ``TAIL``; with the product of the lengths of the rest it bounds
   the score, and entries whose bound reaches the cutoff are collected.
3. What remains of the collected entries is resolved exactly; each shard sends at most its
   own k best that reach the cutoff (ties to smaller ids, as in the result), which are ranked.

Bounds are used where floating point is exact for the vectors at hand; otherwise all entries are
resolved. A score beyond 64 bits raises OverflowError.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an
id. Only vectors of equal length are compared. Rows that repeat a query's vec_id count as its own;
of a query id's rows the least vector asks. Fewer than k candidates: all are returned. An empty
table gives no rows. Scores are 64-bit integers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K, EVERY, SCALE, SHARD_ROWS, BLOCK_ROWS, LISTED, TAIL = 20, 20, 64, 4096, 1024, 8, 8
NO_CUTOFF = -(2**63)


def whole_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, v): each component x becomes floor(scale * x), x as double."""
    x = table["embedding"].cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        table.select(table["vec_id"].cast("long").alias("vec_id"), x.alias("x"), odd.alias("odd"))
        .where("vec_id is not null and x is not null and not odd")
        .select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))
    )


def _matrix(table, dim: int) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, dim)


def _most(q: np.ndarray, c: np.ndarray) -> int:
    """No inner product is above this."""
    return max(map(abs, (int(q.max(initial=0)), int(q.min(initial=0))))) * max(map(abs, (int(c.max(initial=0)), int(c.min(initial=0))))) * q.shape[1]


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, by floating point where that is exact."""
    most = _most(q, c)
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return q @ c.T
    return (q.astype(object) @ c.astype(object).T).astype(np.int64)


def reaching(q: np.ndarray, c: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores of the entries that may reach the query's cutoff, and which these are."""
    if _most(q, c) >= 2**53:
        return scores(q, c), np.ones((len(q), len(c)), bool)
    head = q.shape[1] - -(-q.shape[1] // TAIL)
    rest_q, rest_c = q[:, head:].astype(np.float64), c[:, head:].astype(np.float64)
    out = scores(q[:, :head], c[:, :head])
    longest = np.outer(np.sqrt((rest_q**2).sum(1)), np.sqrt((rest_c**2).sum(1)))
    collected = out + longest * (1 + 1e-9) + 1 >= least[:, None]
    if np.count_nonzero(collected) * 16 > collected.size:
        return out + (rest_q @ rest_c.T).astype(np.int64), collected
    rows, places = np.nonzero(collected)
    for at in range(0, len(rows), 65536):
        i, j = rows[at : at + 65536], places[at : at + 65536]
        out[i, j] += (rest_q[i] * rest_c[j]).sum(1).astype(np.int64)
    return out, collected


def best(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of a row: higher score, then smaller id."""
    at = np.arange(len(s))
    if len(s) > k:
        at = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
    return at[np.lexsort((ids[at], -s[at]))[:k]]


def _cells(queries: DataFrame, candidates: DataFrame, blocks: int, shards: int) -> tuple:
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(*(F.col(c).alias(c) for c in queries.columns)).withColumn("block", deal(blocks, 1)).withColumn("shard", every(shards))
    right = candidates.select(*(F.col(c).alias(c) for c in candidates.columns)).withColumn("shard", deal(shards, 2)).withColumn("block", every(blocks))
    keys = ("dim", "block", "shard")
    return left.groupBy(*keys), right.groupBy(*keys)


def top_k(table: DataFrame, is_query: Column | None = None, k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every query, exactly."""
    vectors = whole_vectors(table, scale)
    asks = vectors.where(F.col("vec_id") % EVERY == 0 if is_query is None else is_query)
    queries = asks.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.dim", "q.v")
    blocks, shards = (max(1, math.ceil(x.count() / n)) for x, n in ((asks, block_rows), (vectors, shard_rows)))

    def local_scores(left, right):
        import pyarrow as pa

        found, dim = [], left.column("dim")[0].as_py() if left.num_rows and right.num_rows else 0
        ids = left.column("vec_id").to_numpy()
        if left.num_rows and right.num_rows:
            own, c = right.column("vec_id").to_numpy(), _matrix(right, dim)
            at = np.argsort(-(c.astype(np.float64) ** 2).sum(1), kind="stable")[: max(4 * k, len(c) // LISTED)]
            own = own[at]
            for q, s in zip(ids, scores(_matrix(left, dim), c[at]), strict=True):
                s = s[own != q]
                found.append(np.partition(s, len(s) - k)[len(s) - k :] if len(s) > k else s)
        at = ids if found else ids[:0]
        return pa.table({"query_id": pa.array(at, pa.int64()), "top": pa.array([x.tolist() for x in found], pa.list_(pa.int64()))})

    left, right = _cells(queries, vectors, blocks, shards)
    listed = left.cogroup(right).applyInArrow(local_scores, "query_id long, top array<long>")
    down = Window.partitionBy("query_id").orderBy(F.desc("score"))
    cutoffs = (
        listed.select("query_id", F.explode("top").alias("score"))
        .withColumn("place", F.row_number().over(down))
        .where(F.col("place") <= k)
        .groupBy("query_id")
        .agg(F.when(F.count("score") == k, F.min("score")).otherwise(F.lit(NO_CUTOFF)).alias("cutoff"))
    )

    def entries(left, right):
        import pyarrow as pa

        out = [np.empty(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            dim, own, rows = left.column("dim")[0].as_py(), right.column("vec_id").to_numpy(), []
            least = left.column("cutoff").to_numpy()
            for q, lowest, s, some in zip(left.column("vec_id").to_numpy(), least, *reaching(_matrix(left, dim), _matrix(right, dim), least), strict=True):
                at = np.flatnonzero(some & (s >= lowest) & (own != q))
                at = at[best(s[at], own[at], k)]
                rows.append((np.full(len(at), q), own[at], s[at]))
            out = [np.concatenate(x) for x in zip(*rows, strict=True)]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    known = queries.join(materialize(cutoffs.withColumnRenamed("query_id", "vec_id")), "vec_id", "left").select("vec_id", "dim", "v", F.coalesce("cutoff", F.lit(NO_CUTOFF)).alias("cutoff"))
    left, right = _cells(known, vectors, blocks, shards)
    sent = left.cogroup(right).applyInArrow(entries, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return sent.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
