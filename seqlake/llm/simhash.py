"""SimHash fingerprints and near-duplicate groups by a vantage-point tree.

``fingerprints``   doc_id, fp (the 64 bits as a signed long)
``links``          links between different fingerprints at most ``max_bits`` apart: a spanning
                   forest of each shard, so a group of m texts gives at most m - 1 links a shard
``near_duplicates``  doc_id, fingerprint, component_id
``deduplicate``    one document of each group of near copies: five-word shingles, similarity 0.8

The tree's inner nodes hold a vantage point v and a radius m. A fingerprint x goes inside if
d(x, v) <= m and outside otherwise. By the triangle inequality two fingerprints within r bits of
each other have distances to v that differ by at most r, so those outside with d(x, v) <= m + r
are copied inside too; then every close pair meets in at least one leaf, and no other branch needs
a visit. The tree is made from a bounded sample of fingerprints (``sample``); all fingerprints are
dealt to its leaves, and each leaf is compared exactly. A leaf that the sample says is large (no
radius divides it well) is cut into chunks that meet pair by pair in tasks of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Places
from .buckets import CHUNK, bucket_links
from .common import batches, fresh, hub_join, key_filter, materialize, passes, pin_splits, texts, tidy, words
from .graph import components

SHINGLE, MAX_BITS, SEED = 3, 3, 42
LEAF_ROWS, SAMPLE, CHUNK_ROWS = 32_768, 16_384, 65_536


def shingle_hashes(ws: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of k words, repeats included; a shorter text is one run; no words: none."""
    if not ws:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= k:
        return np.array([digest(joined, SEED)], np.uint64)
    starts = np.zeros(len(ws) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1, out=starts[1:])
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:-k].tolist(), (starts[k:] - 1).tolist())), np.uint64, len(ws) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; a null or blank text has fingerprint 0."""

    def scan(frames):
        import pyarrow as pa

        for frame in frames:
            found = np.zeros(frame.num_rows, np.uint64)
            for start, part in batches(frame.column("text")):
                for k, text in enumerate(part):
                    found[start + k] = fingerprint(shingle_hashes(words(text), shingle))
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(tidy(scan), "doc_id long, fp long")


def build_tree(sample: np.ndarray, rows: int, max_bits: int, leaf_rows: int = LEAF_ROWS) -> tuple[list[tuple[int, int, int, int]], list[float]]:
    """Nodes (vantage point, radius, inside, outside), children < 0 being leaf ``-child - 1``; rows expected in each leaf.

    Each radius is the one that leaves the fewest pairs to compare. A node becomes a leaf when its
    share of ``rows`` fits, or when no radius saves a twentieth of its pairs.
    """
    nodes: list = []
    leaves: list[float] = []
    scale = rows / max(1, len(sample))
    rng = np.random.default_rng(SEED)

    def leaf(part: np.ndarray) -> int:
        leaves.append(len(part) * scale)
        return -len(leaves)

    def grow(part: np.ndarray, depth: int) -> int:
        if len(part) * scale <= leaf_rows or len(part) < 32 or depth > 40:
            return leaf(part)
        best = None
        for v in rng.choice(part, 4):
            inside = np.cumsum(np.bincount(np.bitwise_count(part ^ v), minlength=65)) / len(part)
            wide = np.append(inside[max_bits:], np.ones(max_bits))
            cost = wide**2 + (1 - inside) ** 2
            m = int(cost[:64].argmin())
            if best is None or cost[m] < best[0]:
                best = (cost[m], v, m)
        cost, v, m = best
        if cost > 0.95:
            return leaf(part)
        at = len(nodes)
        nodes.append(None)
        d = np.bitwise_count(part ^ v)
        nodes[at] = (int(v), m, grow(part[d <= m + max_bits], depth + 1), grow(part[d > m], depth + 1))
        return at

    grow(np.unique(sample), 0)
    return nodes, leaves


def deal(tree: list, x: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, row) pairs: every leaf that a fingerprint belongs to."""
    leaves, rows = [], []

    def walk(node: int, at: np.ndarray) -> None:
        if not len(at):
            return
        if node < 0:
            leaves.append(np.full(len(at), -node - 1))
            rows.append(at)
            return
        v, m, inside, outside = tree[node]
        d = np.bitwise_count(x[at] ^ np.uint64(v))
        walk(inside, at[d <= m + max_bits])
        walk(outside, at[d > m])

    walk(0 if tree else -1, np.arange(len(x)))
    return (np.concatenate(leaves), np.concatenate(rows)) if rows else (np.empty(0, int), np.empty(0, int))


def forest(x: np.ndarray, side: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) that join the fingerprints of one shard as all its close pairs do.

    Rows of equal side are compared only if all rows have one side.
    """
    root = np.arange(len(x))
    cross = side.any() and not side.all()
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (root.copy(), root.copy())
    other = x[right]
    step = max(1, 4_000_000 // max(1, len(right)))
    for start in range(0, len(left), step):
        at = left[start : start + step]
        near = np.bitwise_count(x[at][:, None] ^ other[None, :]) <= max_bits
        for k in np.flatnonzero(near.sum(1) > (not cross)):
            met = np.unique(np.append(root[right[near[k]]], root[at[k]]))
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    moved = np.flatnonzero(root != np.arange(len(x)))
    return moved, root[moved]


def links(fps: DataFrame, max_bits: int = MAX_BITS, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(u, v): links between different values of ``fp`` with the same components as all close pairs."""
    rows = fps.count()
    picked = fps.orderBy(F.xxhash64("fp", F.lit(SEED)), "fp").limit(sample).toPandas()["fp"].to_numpy(np.int64)
    tree, expected = build_tree(picked.view(np.uint64), rows, max_bits, leaf_rows)
    chunks = np.maximum(1, np.ceil(np.array(expected) / chunk_rows)).astype(np.int64)

    def scan(frames):
        for frame in frames:
            x = frame["fp"].to_numpy(np.int64)
            leaf, at = deal(tree, x.view(np.uint64), max_bits)
            n = chunks[leaf]
            own = (x[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
            cells = np.repeat(np.arange(len(at)), n)
            other = np.arange(len(cells)) - np.repeat(np.cumsum(n) - n, n)
            leaf, own, fp = leaf[cells], own[cells], x[at][cells]
            yield pd.DataFrame({"leaf": leaf, "a": np.minimum(own, other), "b": np.maximum(own, other), "side": (own > other).astype(np.int64), "fp": fp})

    cells = fps.mapInPandas(tidy(scan), "leaf long, a long, b long, side long, fp long")

    def compare(shard: pd.DataFrame) -> pd.DataFrame:
        x = shard["fp"].to_numpy(np.int64)
        u, v = forest(x.view(np.uint64), shard["side"].to_numpy(), max_bits)
        return pd.DataFrame({"u": x[u], "v": x[v]})

    return cells.groupBy("leaf", "a", "b").applyInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    Null and blank texts have fingerprint zero and are linked like any other. Repeated rows each
    give a row. A null doc_id gives a row too; it is nobody's component_id unless its group has no
    other. An empty table gives no rows.
    """
    found = materialize(fingerprints(docs, shingle))
    each = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    groups = components(links(each.select("fp"), max_bits))
    named = materialize(each.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component")))
    firsts = materialize(named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    each = materialize(hub_join(named.drop("n"), firsts, "component", total).select("fp", "component_id").join(each.select("fp", "n"), "fp"))
    return hub_join(found, each, "fp", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


COPY_SHINGLE, COPY_SIMILARITY, BANDS, BAND_ROWS = 5, 0.8, 20, 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_factors = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_sets(some: list[bytes], k: int = COPY_SHINGLE) -> list[np.ndarray]:
    """The sorted set of k-word shingles of each text as 64-bit hashes; a shorter text is one shingle."""
    known = Places()
    place = known.__getitem__
    rows = [np.fromiter(map(place, words(text)), np.int64) for text in some]
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
    out = []
    for row in rows:
        w = each[row]
        m = max(1, len(w) - k + 1) if len(w) else 0
        h = np.full(m, len(w) if len(w) < k else k, np.uint64)
        for j in range(min(k, len(w))):
            h = _mix(h * _ODD + w[j : j + m])
        out.append(np.unique(h))
    return out


def set_key(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), len(shingles))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) hashes of minima: sets with similarity s agree in a band with probability s ** BAND_ROWS."""
    joined, starts = np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets])[:-1]
    least = np.stack([np.minimum.reduceat(joined * f, starts) for f in _factors]).reshape(BANDS, BAND_ROWS, len(sets))
    out = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], len(sets), 1)
    for j in range(BAND_ROWS):
        out = _mix(out * _ODD + least[:, j])
    return out.T


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(rid, doc_id, key, fp, bands) of every row; texts with the same shingles have the same key."""

    def scan(frames):
        import pyarrow as pa

        for frame in frames:
            for start, part in batches(frame.column("text")):
                sets = shingle_sets(part, shingle)
                full = [k for k, x in enumerate(sets) if len(x)]
                bands: list = [[]] * len(sets)
                if full:
                    for k, own in zip(full, band_keys([sets[k] for k in full]).view(np.int64).tolist(), strict=True):
                        bands[k] = own
                ids = [frame.column(c).slice(start, len(part)) for c in ("rid", "doc_id")]
                keys, fps = (pa.array(np.fromiter(map(f, sets), np.uint64, len(sets)).view(np.int64)) for f in (set_key, fingerprint))
                yield pa.RecordBatch.from_arrays([*ids, keys, fps, pa.array(bands, pa.list_(pa.int64()))], ["rid", "doc_id", "key", "fp", "bands"])

    return docs.mapInArrow(tidy(scan), "rid long, doc_id long, key long, fp long, bands array<long>")


def _fetch(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(key, shingles) of the wanted keys, each once."""
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(wanted))

    def scan(frames):
        import pyarrow as pa

        for frame in frames:
            for _, part in batches(frame.column("text")):
                held = {k: x for x in shingle_sets(part, shingle) if passes(sent.value, k := set_key(x))}
                yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(held, np.uint64, len(held)).view(np.int64)), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["key", "shingles"])

    return docs.select("text").mapInArrow(tidy(scan), "key long, shingles binary").join(wanted, "key", "left_semi").dropDuplicates(["key"])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def similar_links(docs: DataFrame, found: DataFrame, shingle: int, least: float, max_bits: int, chunk: int) -> DataFrame:
    """(u, v): links between keys of different shingle sets, with the components of all candidates at least ``least`` alike.

    Candidates share a band of minima or have fingerprints within ``max_bits`` (by the tree). They
    are compared by the shingle sets themselves.
    """
    reps = materialize(found.dropDuplicates(["key"]).select("key", "fp", "bands"))
    band = reps.select(F.explode("bands").alias("bucket"), "key").distinct()
    near = links(materialize(reps.select("fp").distinct()), max_bits)
    tree = components(near).withColumnRenamed("node", "fp")
    fps = reps.join(tree, "fp", "left").select(F.xxhash64(F.coalesce("component", "fp"), F.lit(SEED)).alias("bucket"), "key")
    members = materialize(band.unionByName(fps).distinct())
    shared = members.join(materialize(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")).select("bucket"), "bucket", "left_semi")
    sets = materialize(_fetch(docs, shared.select("key").distinct(), shingle).withColumnRenamed("shingles", "value"))

    def prepare(value: bytes) -> np.ndarray:
        return np.frombuffer(value, np.uint64)

    def alike(a: np.ndarray, b: np.ndarray) -> bool:
        return min(len(a), len(b)) >= least * max(len(a), len(b)) and similarity(a, b) >= least

    return bucket_links(members, sets, prepare, alike, chunk)


def deduplicate(docs: DataFrame, shingle: int = COPY_SHINGLE, least: float = COPY_SIMILARITY, max_bits: int = MAX_BITS, chunk: int = CHUNK, written: bool = False) -> DataFrame:
    """The rows of ``docs``, with all their columns, less near copies: of each group the first stays.

    Texts are linked if their sets of word shingles (A-Z lower-cased) have a Jaccard similarity of
    ``least`` or more; a group is what links reach; its first is the least doc_id (null first), of
    equal ids the first in the input. Null and blank texts have no shingles and are one group.
    ``written``: docs is a scan of files, which is the same whenever it is read.
    """
    pin_splits(docs.sparkSession)
    if not written:
        docs = materialize(docs)
    rid = fresh(docs, "rid")
    numbered = docs.withColumn(rid, F.monotonically_increasing_id())
    own = numbered.select(F.col(rid).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = materialize(_sets(own, shingle))
    groups = components(similar_links(own, found.where(F.size("bands") > 0), shingle, least, max_bits, chunk)).select(F.col("node").alias("key"), "component")
    named = found.select("rid", "doc_id", "key").join(groups, "key", "left").select("rid", "doc_id", F.coalesce("component", "key").alias("class"))
    first = named.groupBy("class").agg(F.min(F.struct("doc_id", "rid")).alias("first"))
    kept = first.select(F.col("first.rid").alias(rid))
    return numbered.join(kept, rid, "left_semi").select(*docs.columns)
