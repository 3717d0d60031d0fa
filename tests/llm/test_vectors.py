"""Near neighbours and vector codes against brute force."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.llm import codes, neighbours

RND = random.Random(5)
DIM = 8
DATA = [(k, [RND.gauss(0, 1) for _ in range(DIM)], k % 3) for k in range(300)]
DATA += [(k, [0.5] * DIM, None) for k in range(300, 420)]  # a hot vector, its own queries among them
DATA += [DATA[7], (7, [0.25] * DIM, 1), (100, DATA[100][1], 9)]  # a repeated row, a repeated id with another vector, a repeated vector
ODD = [(800, None, 0), (900, [None] + [0.0] * 7, 0), (1000, [float("nan")] * DIM, 1), (1100, [float("-inf")] * DIM, None)]
SHORT = [(1200, [0.25, 0.5], 1), (1201, [1.0, -1.0], 1), (1300, [3.0, 3.0], 2), (None, [0.75] * DIM, 1)]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(DATA + ODD + SHORT + [(1400, [0.0] * DIM, 4)], "vec_id long, embedding array<float>, label int")
    return df.withColumns({"score": F.lit("clash"), "rank": F.lit(1), "shard": F.lit(0), "x": F.lit("x"), "code": F.lit("c"), "n": F.lit(2)}).repartition(3)


def rows32(zero):
    """(id, vector, label) of rows with whole vectors."""
    good = [r for r in DATA + SHORT + ([(1400, [0.0] * DIM, 4)] if zero else [])]
    return [(k, [float(np.float32(x)) for x in v], label) for k, v, label in good]


@pytest.mark.parametrize("options", [{}, {"shard_rows": 60, "block_rows": 2}, {"k": 3, "shard_rows": 5}])
def test_nearest(table, options):
    k = options.get("k", 10)
    got = collections.defaultdict(list)
    for r in neighbours.nearest(table, **options).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    rows = [r for r in rows32(False) if r[0] is not None]
    asks = {}
    for i, v, _ in rows:
        if i % 100 == 0:
            asks[i] = min(asks.get(i, v), v)
    want = {q: sorted((float(np.sqrt(np.square(np.array(v) - np.array(w)).sum())), i) for i, w, _ in rows if i != q and len(w) == len(v))[:k] for q, v in asks.items()}
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    assert got[300] == [(0.0, i) for i in range(301, 301 + k)] and got[1200] == want[1200]  # copies, and fewer than k
    exact = {q: dict((i, d) for d, i in sorted((float(np.sqrt(np.square(np.array(v) - np.array(w)).sum())), i) for i, w, _ in rows if len(w) == len(v))) for q, v in asks.items()}
    assert all(abs(d - exact[q][i]) < 1e-12 or i in (7, 100) for q in got for d, i in got[q])
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * sum(len({i for _, i in want[q]}) for q in want)


def test_nearest_of_none(table):
    assert neighbours.nearest(table.limit(0)).count() == 0
    assert neighbours.nearest(table.where("vec_id = 800 or vec_id = 1400")).count() == 0
    assert neighbours.nearest(table.where("vec_id = 200")).count() == 0  # no candidate but itself


def test_recall_of_shards(spark):
    """In high dimensions and over many shards."""
    x = np.random.default_rng(3).standard_normal((3000, 48))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in neighbours.nearest(table, shard_rows=700).collect():
        got[r.query_id].add(r.vec_id)
    hit = sum(len(got[q] & set(np.argsort(np.square(x - x[q]).sum(1))[1:11].tolist())) for q in range(0, 3000, 100))
    assert len(got) == 30 and hit >= 0.9 * 300


def test_graph():
    """Bounded degree, everything reached, equal results whatever the order of rows asked."""
    x = np.random.default_rng(4).standard_normal((900, 6))
    x[300:] *= 0.01  # a dense heap beside scattered points
    g = neighbours.graph(x)
    assert g.links.shape == (900, neighbours.DEGREE) and g.reached(g.entries).all()
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() and i not in r for i, r in enumerate(g.links.tolist()) for r in [np.array(r)])
    one, _, _, _ = g.beam(x[:50], 40)
    two, _, _, _ = g.beam(x[:50][::-1], 40)
    assert all(set(a) == set(b) for a, b in zip(one.tolist(), two[::-1].tolist(), strict=True))
    # an edge is dropped exactly where a kept one is ALPHA times nearer to its end
    p, ids = 5, np.argsort(np.square(x - x[5]).sum(1))[1:60]
    d = np.square(x[ids] - x[p]).sum(1)
    kept: list = []
    for i, far in zip(ids, d, strict=True):
        if all(neighbours.ALPHA**2 * np.square(x[i] - x[j]).sum() > far for j in kept) and len(kept) < neighbours.DEGREE:
            kept.append(i)
    scale = g.scale**2
    assert [i for i in g.pruned(np.array([p]), ids[None], (d / scale)[None].astype(np.float32))[0] if i >= 0] == kept


def brute_codes(rows, entries, rounds):
    """{dim: (per row (code, error), digest)} by plain loops over all rows."""
    out = {}
    for dim in {len(v) for _, v, _ in rows}:
        own = [(k, [math.floor(1024 * x) for x in v] + [0] * (-dim % 4), label) for k, v, label in rows if len(v) == dim]
        size = len(own[0][1]) // 4
        least = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
        books = [[r[1][p * size : (p + 1) * size] for r in least] for p in range(4)]

        def near(part, book):
            return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

        for _ in range(rounds):
            for p in range(4):
                mine = collections.defaultdict(list)
                for _, v, _ in own:
                    part = v[p * size : (p + 1) * size]
                    mine[near(part, books[p])[1]].append(part)
                books[p] = [[sum(c) // len(mine[e]) for c in zip(*mine[e])] if e in mine else old for e, old in enumerate(books[p])]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for k, v, label in own:
            got = [near(v[p * size : (p + 1) * size], books[p]) for p in range(4)]
            out.setdefault("rows", []).append((k, label, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got), sha))
    return out["rows"]


@pytest.mark.parametrize("options", [{}, {"entries": 20, "rounds": 2}])
def test_codes(table, options):
    want = brute_codes(rows32(True), options.get("entries", 256), options.get("rounds", 4))
    by = collections.Counter()
    for _, label, _, error, _ in want:
        by[label] += error
    expected = sorted(repr((k, code, error, by[label], sha)) for k, label, code, error, sha in want)
    got = codes.compress(table, **options)
    assert sorted(repr(tuple(r)[:5]) for r in got.collect()) == expected


def test_codes_at_the_edges(spark, table):
    assert codes.compress(table.limit(0)).count() == 0
    assert codes.compress(table.where("vec_id = 900")).count() == 0
    large = spark.createDataFrame([(1, [1e9, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="components must be below"):
        codes.compress(large).collect()
    a, b = np.array([[2**25, -(2**25)], [3, 4]]), np.array([[2**25, 2**25], [3, 5], [3, 5]])
    assert [x.tolist() for x in codes.assign(a, b)] == [[1, 1], [(2**25 - 3) ** 2 + (2**25 + 5) ** 2, 1]]
