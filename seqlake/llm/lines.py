"""Line dedup by a segment-partition edit join.

Two lines are alike if they are equal, or both have at least ``MIN_CHARS`` characters and their
edit distance is at most ``EDITS``. A line of n characters is cut into EDITS + 1 segments; a line
within the distance holds at least one of them unchanged, near its old place, so every line probes
the segments of all lengths from n - EDITS to n at the few places that can matter. Segments and
probes are 64-bit hashes over code points from one running sum a batch. They are packed by shard;
in a shard, a segment that different lines share gives a bucket of candidates (never their pairs),
and the texts of candidates alone are fetched and compared by a banded bit-parallel edit distance
until a bucket's links are known (``buckets``). Classes are the components of all links. A class keeps its first
line (by doc_id, then place) and loses the others. Lines are named by a 64-bit hash of their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import CHUNK, bucket_links
from .common import fresh, hub_join, key_filter, materialize, passes, pin_splits, tidy
from .graph import components

EDITS, MIN_CHARS = 2, 24
BATCH_CHARS, FLUSH, SHARD_DOCS, LEAST_SHARDS = 500_000, 1_000_000, 2000, 64
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _common(a: str, b: str, back: bool) -> int:
    """The length of the common beginning (or end) of two strings, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        same = a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] if back else a[low:mid] == b[low:mid]
        low, high = (mid, high) if same else (low, mid - 1)
    return low


def edit_distance(a: str, b: str, most: int = EDITS) -> int:
    """The edit distance of two strings, or most + 1 if it is greater.

    What is left between their common ends goes through the automaton of Wu and Manber (1992), on
    the band of diagonals that ``most`` edits can reach (Ukkonen 1985): for each number of edits a
    bit vector of 2 * most + 1 diagonals, bit d being set if the text so far, of j characters, can be
    made of the first j + d - most characters of the other string.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    k = _common(a, b, False)
    a, b = a[k:], b[k:]
    k = _common(a, b, True)
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not b:
        return len(a)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i + most
    band = (1 << 2 * most + 1) - 1
    rows = [((2 << e) - 1) << most & band for e in range(most + 1)]
    for j, y in enumerate(b):
        same, less = places.get(y, 0) >> j & band, 0
        for e, old in enumerate(rows):
            # equal; replaced or added (from one edit less); left out (after one edit less)
            rows[e] = old & same | (before | before >> 1 | less << 1) & band if e else old & same
            before, less = old, rows[e]
        if not less:
            return most + 1
    goal = 1 << len(a) - len(b) + most
    return next((e for e, row in enumerate(rows) if row & goal), most + 1)


_powers_made: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    if len(_powers_made[0]) <= n:
        base = 0x2545F4914F6CDD1D
        for k, x in enumerate((base, pow(base, -1, 1 << 64))):
            factors = np.full(max(n, 1 << 20) + 1, x, np.uint64)
            factors[0] = 1
            _powers_made[k] = np.cumprod(factors)
    return _powers_made


def segments(n: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i (from 0) of lines of n characters; the last ones are longer by one."""
    base, extra = n // (edits + 1), n % (edits + 1)
    return i * base + np.maximum(0, i - (edits + 1 - extra)), base + (i >= edits + 1 - extra)


def signatures(points: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray, edits: int = EDITS, least: int = MIN_CHARS) -> tuple:
    """(segments, their lines, probes, their lines): hashes of substrings of the lines in ``points``."""
    up, down = _powers(len(points))
    run = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=run[1:])

    def digest(at, size, length, i):
        x = (run[at + size] - run[at]) * down[at]
        x = (x ^ length.astype(np.uint64) * _ODD + np.uint64(i)) * _MIX
        return x ^ x >> np.uint64(31)

    own, probes = [], []
    for less in range(edits + 1):
        length = n - less
        for i in range(edits + 1):
            p, size = segments(length, i, edits)
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                q = p + shift
                ok = (length >= least) & (q >= 0) & (q + size <= n)
                found = digest(start[ok] + q[ok], size[ok], length[ok], i), key[ok]
                (own if less == shift == 0 else probes).append(found)
    return tuple(np.concatenate(x) for part in (own, probes) for x in zip(*part, strict=True))


def _name(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode())


def _rows(frames) -> Iterator[tuple[int, int | None, list[str]]]:
    for frame in frames:
        for rid, doc_id, text in zip(*(frame.column(c).to_pylist() for c in ("rid", "doc_id", "text")), strict=True):
            yield rid, doc_id, (text or "").split("\n")


def _zip(x: np.ndarray) -> bytes:
    return x.astype("<u8").tobytes()


def signature_rows(docs: DataFrame, shards: int, edits: int, least: int) -> DataFrame:
    """(shard, segments, owners, probes, askers), packed, of all lines long enough for edits."""

    def scan(frames):
        import pyarrow as pa

        parts: list[tuple] = []
        held: dict[int, str] = {}
        size = 0

        def digest():
            text = "\n".join(held.values())
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            n = np.fromiter(map(len, held.values()), np.int64, len(held))
            parts.append(signatures(points, np.cumsum(n + 1) - n - 1, n, np.fromiter(held, np.uint64, len(held)), edits, least))
            held.clear()

        def out():
            both = [np.concatenate(x) for x in zip(*parts, strict=True)]
            parts.clear()
            dealt = []
            for k in (0, 2):
                shard = (both[k] % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                edge = np.searchsorted(shard[order], np.arange(shards + 1))
                dealt.append([(both[k][order], both[k + 1][order]), edge])
            rows = [(s, *(_zip(x[e[s] : e[s + 1]]) for pair, e in dealt for x in pair)) for s in range(shards) if dealt[0][1][s] < dealt[0][1][s + 1] or dealt[1][1][s] < dealt[1][1][s + 1]]
            for at in range(0, len(rows), 64):
                kinds = (pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64], strict=True), kinds, strict=True)], ["shard", "segments", "owners", "probes", "askers"])

        for _, _, some in _rows(frames):
            for line in some:
                if len(line) >= least:
                    held[_name(line)] = line
                    size += len(line)
            if size >= BATCH_CHARS:
                digest()
                size = 0
                if sum(len(x[0]) + len(x[2]) for x in parts) >= FLUSH:
                    yield from out()
        if held:
            digest()
        if parts:
            yield from out()

    return docs.mapInArrow(tidy(scan), "shard int, segments binary, owners binary, probes binary, askers binary")


def groups(segment: np.ndarray, owner: np.ndarray, probe: np.ndarray, asker: np.ndarray) -> list[np.ndarray]:
    """The different sets of lines that share a segment of one of them."""
    known = np.unique(segment)
    if not len(known):
        return []
    met = known[np.minimum(np.searchsorted(known, probe), len(known) - 1)] == probe
    shared, line = np.concatenate([segment, probe[met]]), np.concatenate([owner, asker[met]])
    order = np.lexsort((line, shared))
    shared, line = shared[order], line[order]
    new = np.append(True, (shared[1:] != shared[:-1]) | (line[1:] != line[:-1]))
    shared, line = shared[new], line[new]
    edges = np.append(np.flatnonzero(np.append(True, shared[1:] != shared[:-1])), len(shared))
    found = {line[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b - a > 1}
    return [np.frombuffer(x, np.uint64) for x in found]


def candidates(signed: DataFrame, slice_rows: int = 4096) -> DataFrame:
    """(bucket, key): the lines that share a segment; a bucket for each different set of them."""

    def meet(shard):
        import pyarrow as pa

        arrays = [np.frombuffer(b"".join(shard.column(c).to_pylist()), "<u8") for c in ("segments", "owners", "probes", "askers")]
        names, out = [], []
        for own in groups(*arrays):
            name = xxhash.xxh3_64_intdigest(own.tobytes())
            for at in range(0, len(own), slice_rows):
                names.append(name)
                out.append(own[at : at + slice_rows].view(np.int64))
        return pa.table({"bucket": pa.array(np.array(names, np.uint64).view(np.int64)), "members": pa.array(out, pa.list_(pa.int64()))})

    found = signed.groupBy("shard").applyInArrow(meet, "bucket long, members array<long>").distinct()
    return found.select("bucket", F.explode("members").alias("key"))


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, line): the text of each wanted line once.

    A filter of fixed size goes to the scan, so that little more than the wanted lines is shuffled;
    the join after it is exact.
    """
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(wanted))

    def scan(frames):
        import pyarrow as pa

        held: dict[int, str] = {}

        def out():
            some = pa.RecordBatch.from_arrays([pa.array(np.fromiter(held, np.uint64, len(held)).view(np.int64)), pa.array(list(held.values()), pa.string())], ["key", "line"])
            held.clear()
            return some

        for _, _, some in _rows(frames):
            for line in some:
                key = _name(line)
                if passes(sent.value, key):
                    held[key] = line
            if len(held) >= 5000:
                yield out()
        if held:
            yield out()

    found = docs.mapInArrow(tidy(scan), "key long, line string")
    return found.join(wanted, "key", "left_semi").dropDuplicates(["key"])


def odd_letters(line: str) -> int:
    """64 bits: which code points, modulo 64, stand in a line an odd number of times."""
    odd = np.bincount(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") & 63, minlength=64) & 1
    return int(np.packbits(odd.astype(bool), bitorder="little").view("<u8")[0])


def links(docs: DataFrame, shards: int, edits: int = EDITS, least: int = MIN_CHARS, chunk: int = CHUNK) -> DataFrame:
    """(u, v): links between different lines, with the components of all pairs within ``edits``."""
    members = materialize(candidates(signature_rows(docs, shards, edits, least)))
    texts = materialize(line_texts(docs, members.select("key").distinct()).withColumnRenamed("line", "value"))

    def prepare(line: str) -> tuple:
        return line, odd_letters(line)

    def alike(a: tuple, b: tuple) -> bool:
        # an edit changes the parity of at most two letters
        return (a[1] ^ b[1]).bit_count() <= 2 * edits and edit_distance(a[0], b[0], edits) <= edits

    return bucket_links(members, texts, prepare, alike, chunk)


def line_table(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, place, key) of every line that isn't blank."""

    def scan(frames):
        import pyarrow as pa

        rows: list = []
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.uint64())

        def out():
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays([*columns[:3], columns[3].view(pa.int64())], ["rid", "doc_id", "place", "key"])

        for rid, doc_id, some in _rows(frames):
            rows += [(rid, doc_id, k, _name(line)) for k, line in enumerate(some) if line and not line.isspace()]
            if len(rows) >= 10_000:
                yield out()
        if rows:
            yield out()

    return docs.mapInArrow(tidy(scan), "rid long, doc_id long, place int, key long")


def dedup(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS, written: bool = False) -> DataFrame:
    """The columns of ``docs`` with the lines that others repeat taken out of text, and n_lines, n_dropped.

    The first line of a class, by doc_id (null first), then by its place, stays. Blank lines always
    stay. Equal rows are told apart by their place in the input. A null text counts as one empty
    line. A document whose lines are all repeats keeps its row, with an empty text. Extra columns
    pass through; one named as a result is replaced.
    ``written``: docs is a scan of files, which is the same whenever it is read.
    """
    pin_splits(docs.sparkSession)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*columns)
    if not written:
        docs = materialize(docs)
    rid, gone = (fresh(docs, n) for n in ("rid", "gone"))
    numbered = docs.withColumn(rid, F.monotonically_increasing_id())
    own = numbered.select(F.col(rid).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shards = max(LEAST_SHARDS, -(-docs.count() // SHARD_DOCS))
    alike = components(links(own, shards, edits, least)).select(F.col("node").alias("key"), "component")
    lines = materialize(line_table(own))
    keys = materialize(lines.groupBy("key").agg(F.min(F.struct("doc_id", "rid", "place")).alias("own"), F.count("*").alias("n")))
    classes = keys.join(alike, "key", "left").select("key", "own", "n", F.coalesce("component", "key").alias("class"))
    first = classes.groupBy("class").agg(F.min("own").alias("first"), F.sum("n").alias("lines")).where("lines > 1")
    repeated = materialize(classes.join(first, "class").select("key", "n", "first"))
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    dropped = (
        hub_join(lines, repeated, "key", total)
        .where("not (rid = first.rid and place = first.place)")
        .groupBy("rid")
        .agg(F.collect_list("place").alias(gone))
        .withColumnRenamed("rid", rid)
    )
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.when(F.col(gone).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.filter(split, lambda x, k: ~F.array_contains(gone, k)), "\n"))
    out = numbered.join(dropped, rid, "left").withColumns({"n_lines": F.size(split), "n_dropped": F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)), "text": kept})
    return out.select(*columns, "n_lines", "n_dropped")
