"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Equal vectors are one node, which carries the ids that can be asked of it (``k`` + 1 at most, and
how often each stands in the table); nodes are dealt to shards by a hash. In a shard

1. points enter the graph in batches; a greedy search from the entry proposes neighbours: the nodes
   that it expands;
2. relaxed distance pruning keeps a proposal only if no kept neighbour is ``ALPHA`` times nearer to it
   than the point is, so that edges go in different directions, at most ``DEGREE`` a node;
3. neighbours get an edge back, and are pruned again where that makes too many;
4. a second pass over all points does the same with the whole graph. What no edge reaches then
   becomes a further entry.

``build`` writes shards as an index; ``search`` runs a beam of ``BEAM`` over every shard for blocks of
queries and ranks what the beams hold by exact distances. A shard has some ``SHARD_ROWS`` nodes and a
block some ``BLOCK_ROWS`` queries whatever the table's size, and so a task's memory is bounded; the
index is read once for every block.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

K, EVERY, DEGREE, BEAM, ALPHA = 10, 100, 32, 64, 1.2
SHARD_ROWS, BLOCK_ROWS, BATCH = 4096, 4096, 512


def whole(table: DataFrame) -> DataFrame:
    """(vec_id, dim, x) of the rows that take part: with an id, and a vector of finite numbers, not all zero."""
    x = table["embedding"].cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | ~F.exists(x, lambda c: c != 0)
    rows = table.select(table["vec_id"].cast("long").alias("vec_id"), x.alias("x"), odd.alias("odd")).where("vec_id is not null and x is not null and not odd")
    return rows.select("vec_id", F.size("x").alias("dim"), "x")


def nodes(vectors: DataFrame, k: int = K) -> DataFrame:
    """(dim, x, ids, copies): distinct vectors, their ``k`` + 1 least ids, and how many rows (``k`` at most) each id has.

    More of a vector's ids can be in no result: ties go to smaller ids, and one of them may be the query's own.
    """
    rows = vectors.groupBy("dim", "x", "vec_id").agg(F.count("*").alias("n"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("dim", "x").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    got = first.groupBy("dim", "x").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.least("n", F.lit(k)).alias("n")))).alias("m"))
    return got.select("dim", "x", F.col("m.vec_id").alias("ids"), F.col("m.n").alias("copies"))


class Graph:
    """A directed graph over the rows of ``x``; -1 fills up rows of ``links``."""

    def __init__(self, x: np.ndarray, links: np.ndarray | None = None, entries: np.ndarray | None = None) -> None:
        self.x, self.links, self.entries = x, links, entries
        scale = np.abs(x).max(initial=0) or 1.0
        self.scale, self.f = scale, (x / scale).astype(np.float32)  # walks need no more than single precision
        self.norm = np.einsum("nd,nd->n", self.f, self.f)

    def beam(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and squared distances that the beams of queries ``q`` end with, and of all that they expanded."""
        n, start = len(q), self.entries
        q = (q / self.scale).astype(np.float32)
        own = np.einsum("nd,nd->n", q, q)
        near = lambda at, rows: self.norm[at] - 2 * np.einsum("ard,ad->ar", self.f[at], q[rows]) + own[rows, None]
        rows = np.arange(n)
        ids = np.full((n, width), -1, np.int64)
        far = np.full((n, width), np.inf, np.float32)
        todo = np.full((n, width), np.inf, np.float32)  # distance of what is not yet expanded
        seen = np.zeros((n, len(self.f)), bool)
        seen[:, start] = True
        first = np.broadcast_to(start, (n, len(start)))
        d = near(first, rows)
        if len(start) > width:
            pick = np.argpartition(d, width - 1, axis=1)[:, :width]
            first, d = np.take_along_axis(first, pick, 1), np.take_along_axis(d, pick, 1)
        ids[:, : first.shape[1]], far[:, : first.shape[1]], todo[:, : first.shape[1]] = first, d, d
        path_ids, path_far = [], []
        while len(rows):
            at = np.argmin(todo[rows], axis=1)
            go = np.isfinite(todo[rows, at])
            rows, at = rows[go], at[go]
            if not len(rows):
                break
            step, size = np.full(n, -1, np.int64), np.full(n, np.inf, np.float32)
            step[rows], size[rows] = ids[rows, at], far[rows, at]
            path_ids.append(step)
            path_far.append(size)
            todo[rows, at] = np.inf
            more = self.links[step[rows]].astype(np.int64)
            new = (more >= 0) & ~seen[rows[:, None], more]
            if not new.any():
                continue
            seen[rows[:, None].repeat(more.shape[1], 1)[new], more[new]] = True
            d = np.where(new, near(np.where(new, more, 0), rows), np.inf).astype(np.float32)
            every = np.concatenate([far[rows], d], axis=1)
            keep = np.argpartition(every, width - 1, axis=1)[:, :width]
            take = lambda a, b: np.take_along_axis(np.concatenate([a[rows], b], axis=1), keep, 1)
            ids[rows], todo[rows] = take(ids, np.where(new, more, -1)), take(todo, d)
            far[rows] = np.take_along_axis(every, keep, 1)
        ids[~np.isfinite(far)] = -1
        empty = np.empty((n, 0))
        return ids, far, np.stack(path_ids, 1) if path_ids else empty.astype(np.int64), np.stack(path_far, 1) if path_far else empty

    def pruned(self, of: np.ndarray, ids: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The edges of points ``of`` among proposals ``ids`` (-1: none) at squared distances ``far``, nearest first."""
        most = min(ids.shape[1], 3 * DEGREE)
        far = np.where((ids < 0) | (ids == of[:, None]), np.inf, far)
        order = np.argsort(far, axis=1, kind="stable")[:, :most]
        ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
        x = self.f[np.maximum(ids, 0)]
        norm = self.norm[np.maximum(ids, 0)]
        between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        alive = np.isfinite(far)
        out = np.full((len(of), DEGREE), -1, np.int32)
        every = np.arange(len(of))
        for k in range(DEGREE):
            at = np.argmax(alive, axis=1)  # nearest of what is left
            some = alive[every, at]
            if not some.any():
                break
            out[some, k] = ids[every, at][some]
            alive &= ~((ALPHA**2 * between[every, at] <= far) & some[:, None])
            alive[every, at] = False
        return out

    def insert(self, points: np.ndarray, width: int) -> None:
        _, _, ids, far = self.beam(self.x[points], width)
        old = self.links[points].astype(np.int64)
        if (old >= 0).any():  # the second pass keeps what it has among the proposals
            d = self.norm[np.maximum(old, 0)] - 2 * np.einsum("ard,ad->ar", self.f[np.maximum(old, 0)], self.f[points]) + self.norm[points, None]
            fresh = (ids[:, :, None] != old[:, None, :]).all(2)
            ids, far = np.concatenate([np.where(fresh, ids, -1), old], 1), np.concatenate([far, d], 1)
        self.links[points] = self.pruned(points, ids, far)
        self.back(points)

    def back(self, points: np.ndarray) -> None:
        """Edges back from the neighbours of ``points``."""
        tail = np.repeat(points, DEGREE)
        head = self.links[points].ravel().astype(np.int64)
        tail, head = tail[head >= 0], head[head >= 0]
        have = (self.links[head] == tail[:, None]).any(1)
        tail, head = tail[~have], head[~have]
        order = np.argsort(head, kind="stable")
        tail, head = tail[order], head[order]
        to, begin, count = np.unique(head, return_index=True, return_counts=True)
        free = (self.links[to] < 0).sum(1)
        fits = count <= free
        for group in (np.flatnonzero(fits), np.flatnonzero(~fits)):
            for cut in range(0, len(group), BATCH):
                some = group[cut : cut + BATCH]
                most = int(count[some].max())
                place = np.arange(most)[None, :]
                new = np.where(place < count[some, None], tail[np.minimum(begin[some, None] + place, len(tail) - 1)], -1)
                both = np.concatenate([self.links[to[some]].astype(np.int64), new], 1)
                if fits[some[0]]:
                    order = np.argsort(both < 0, axis=1, kind="stable")[:, :DEGREE]
                    self.links[to[some]] = np.take_along_axis(both, order, 1)
                else:
                    for part in range(0, len(some), 128):  # a much proposed node has many new neighbours
                        at = some[part : part + 128]
                        own = both[part : part + 128]
                        x = self.f[np.maximum(own, 0)]
                        d = self.norm[np.maximum(own, 0)] - 2 * np.einsum("ard,ad->ar", x, self.f[to[at]]) + self.norm[to[at], None]
                        self.links[to[at]] = self.pruned(to[at], own, d)

    def reached(self, start: np.ndarray) -> np.ndarray:
        found, edge = np.zeros(len(self.x), bool), start
        found[start] = True
        while len(edge):
            edge = np.unique(self.links[edge])
            edge = edge[edge >= 0]
            edge = edge[~found[edge]]
            found[edge] = True
        return found


def graph(x: np.ndarray) -> Graph:
    """The graph of the rows of ``x``, distinct vectors."""
    n = len(x)
    g = Graph(x, np.full((n, DEGREE), -1, np.int32))
    middle = g.f.mean(0)
    g.entries = np.array([int(np.argmin(g.norm - 2 * g.f @ middle))])
    order = np.random.default_rng(1).permutation(n)
    order = np.concatenate([g.entries, order[order != g.entries[0]]])
    width = min(BEAM, n)
    done = 1
    while done < n:
        size = min(n - done, done, BATCH)
        g.insert(order[done : done + size], width)
        done += size
    for at in range(0, n, BATCH):
        g.insert(order[at : at + BATCH], width)
    found = g.reached(g.entries)
    while not found.all():
        g.entries = np.append(g.entries, np.flatnonzero(~found)[0])
        found |= g.reached(g.entries[-1:])
    return g


SHARD = "shard int, dim int, n int, x binary, links binary, entries binary, ids array<array<long>>, copies array<array<long>>"


def _matrix(column, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def build(table: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index of all vectors of a table: one row a shard, written to the shared folder."""
    found = materialize(nodes(whole(table), k))
    shards = max(1, math.ceil(found.count() / shard_rows))

    def make(rows):
        import pyarrow as pa

        rows = rows.sort_by([("first", "ascending")])
        dim = rows.column("dim")[0].as_py()
        x = _matrix(rows.column("x"), dim)
        g = graph(x)
        out = [rows.column("shard")[0].as_py(), dim, len(x), x.tobytes(), g.links.tobytes(), g.entries.astype(np.int64).tobytes(), rows.column("ids").to_pylist(), rows.column("copies").to_pylist()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), *[pa.list_(pa.list_(pa.int64()))] * 2]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(out, kinds, strict=True)], [c.split()[0] for c in SHARD.split(", ")])

    dealt = found.withColumns({"shard": F.pmod(F.xxhash64("x"), F.lit(shards)).cast("int"), "first": F.get("ids", F.lit(0))})
    index = materialize(dealt.groupBy("dim", "shard").applyInArrow(make, SHARD))
    discard(found)
    return index


def search(index: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, beam: int = BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest that the beams find for each of ``queries`` (vec_id, dim, x).

    A query's own rows are left out; equal distances go to smaller ids. An index must hold at least
    ``k`` + 1 ids a vector, as ``build`` with this ``k`` gives.
    """
    blocks = max(1, math.ceil(queries.count() / block_rows))
    shards = (index.agg(F.max("shard").alias("s")).first()["s"] or 0) + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("dim", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int").alias("block"), "vec_id", "x").withColumn("shard", every(shards))
    right = index.withColumn("block", every(blocks))

    def walk(left, right):
        import pyarrow as pa

        out: list = []
        if left.num_rows and right.num_rows:
            dim = right.column("dim")[0].as_py()
            own = lambda name, kind: np.frombuffer(right.column(name)[0].as_py(), kind)
            g = Graph(own("x", np.float64).reshape(-1, dim), own("links", np.int32).reshape(-1, DEGREE), own("entries", np.int64))
            ids, copies = right.column("ids")[0].as_py(), right.column("copies")[0].as_py()
            names, q = left.column("vec_id").to_pylist(), _matrix(left.column("x"), dim)
            for cut in range(0, len(q), BATCH):
                at = g.beam(q[cut : cut + BATCH], min(beam, len(g.x)))[0]
                for name, v, mine in zip(names[cut : cut + BATCH], q[cut : cut + BATCH], at, strict=True):
                    mine = mine[mine >= 0]
                    exact = np.sqrt(np.square(g.x[mine] - v).sum(1)).tolist()
                    rest = k
                    for d, i, n in sorted((d, i, n) for d, m in zip(exact, mine.tolist(), strict=True) for i, n in zip(ids[m], copies[m], strict=True) if i != name):
                        out += [(name, i, d)] * min(n, rest)
                        rest -= min(n, rest)
                        if not rest:
                            break
        return pa.table({c: pa.array([r[j] for r in out], t) for j, (c, t) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

    keys = ("dim", "block", "shard")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(walk, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, is_query: Column | None = None, k: int = K, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): ``k`` near neighbours of each query among all rows but its own.

    Rows without an id, and vectors that are null, all zero, or hold null or non-finite components take
    no part. Only vectors of equal length are compared. Rows that repeat a query's vec_id count as its
    own; of a query id's rows the least vector asks. Other repeated rows are candidates of their own.
    Fewer than ``k`` candidates: all are found. An empty table gives no rows. Other columns are left out.
    """
    vectors = whole(table)
    asks = vectors.where(F.col("vec_id") % EVERY == 0 if is_query is None else is_query)
    queries = asks.groupBy("vec_id").agg(F.min(F.struct("dim", "x")).alias("q")).select("vec_id", "q.dim", "q.x")
    return search(build(table, k, shard_rows), queries, k, block_rows, beam)
