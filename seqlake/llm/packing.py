"""Packing of tokenized documents into sequences: linear grouping, configurations, best fit.

Lengths are whole numbers up to ``SIZE``, so their histogram is a bounded summary of any corpus and
the driver plans on it alone:

1. large pieces (over ``SMALL``) in descending order are cut into ``GROUPS`` groups of equal
   cardinality and rounded up to the longest of their group;
2. the configurations of these few sizes are optimised: a linear program by column generation,
   rounded down, and best fit for what is left over;
3. actual documents take the places of their group;
4. small pieces go by best fit into the room that the actual lengths leave, planned on the
   histogram of that room.

Spark numbers the pieces of each length and the sequences of each room (counts by bucket and a
running sum, so no length is numbered in one task) and looks every number up in the plan.
"""

from __future__ import annotations

from functools import cache, partial
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, texts, tidy

VOCABULARY, END, SIZE = "byte_bpe_50k.json", 2, 1024
SMALL, GROUPS, BUCKET_ROWS, GAIN = 400, 512, 4096, 1e-4
#: How byte-level BPE splits a text before merging; a fixed value of the format.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoder(path: str, ordinary: bool = False):
    """A function from a text to its ids: those of the tokenizers library for the file, made several
    times faster by tiktoken with the same vocabulary (ids are in order of merging).

    ``ordinary``: special tokens in a text are text like any other, and the ids come as an array.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(char[c] for c in piece): k for piece, k in spec["model"]["vocab"].items() if piece not in special}
    found = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    if ordinary:
        return partial(found.encode_to_numpy, disallowed_special=())

    def ids(text: str) -> list[int]:
        if any(x in text for x in special):
            return found.encode(text, allowed_special="all")
        return found.encode_ordinary(text)

    return ids


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, the first piece being what is over."""
    first = n if n <= size else n % size or size
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row; a null text counts as empty."""
    path = path or vocabulary_path()

    def scan(frames):
        encode = encoder(path)
        for frame in frames:
            ids, values = frame.column("doc_id"), frame.column("text")
            for at in range(0, len(ids), 64):
                rows = []
                for doc_id, text in zip(ids.slice(at, 64).to_pylist(), values.slice(at, 64).to_pylist(), strict=True):
                    own = np.array(encode(text) + [END], "<u4")
                    rows += [(doc_id, k, start, n, crc32(own[start : start + n])) for k, (start, n) in enumerate(cut(len(own), size))]
                yield _batch(rows)

    return texts(docs).mapInArrow(tidy(scan), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _batch(rows: list):
    import pyarrow as pa

    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def numbered(df: DataFrame, key: str, order: list, rows: int, name: str) -> DataFrame:
    """``df`` with ``name``: each row's number (from 0) among the rows of equal ``key``."""
    buckets = -(-rows // BUCKET_ROWS) or 1
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order))
    return dealt.withColumn("_row", place - 1).join(offsets, [key, "_bucket"]).withColumn(name, F.col("_before") + F.col("_row")).drop("_bucket", "_row", "_before")


def _knapsack(sizes: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """The pattern of greatest value: how many of each size."""
    layers, chosen = [np.zeros(size + 1)], []
    for _ in range(size // int(sizes.min())):
        last = layers[-1]
        reach = np.full((len(sizes), size + 1), -1.0)
        for i, s in enumerate(sizes):
            reach[i, s:] = last[: size + 1 - s] + value[i]
        pick = reach.argmax(0)
        gain = reach[pick, np.arange(size + 1)]
        layers.append(np.maximum(last, gain))
        chosen.append(np.where(gain > last + 1e-12, pick, -1))
    pattern, room = np.zeros(len(sizes), int), size
    for pick in reversed(chosen):
        i = pick[room]
        if i >= 0:
            pattern[i] += 1
            room -= sizes[i]
    return pattern


def configurations(sizes: list[int], demand: list[int], size: int = SIZE, gain: float = GAIN) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, times): how often each combination of sizes is used; covers the demand.

    Column generation: the basis starts with one size a pattern, each step prices a pattern by a
    knapsack over the dual values, until the best is worth less than 1 + ``gain`` sequences: by the
    duals then no solution has fewer than 1 / (1 + ``gain``) of these sequences.
    """
    if not sizes:
        return []
    s, b = np.array(sizes), np.array(demand, float)
    basis = np.diag(size // s).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ b
    while True:
        dual = inverse.sum(0)
        pattern = _knapsack(s, np.maximum(dual, 0), size)
        if pattern @ dual <= 1 + gain:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * step
        x[out] = ratio[out]
        basis[:, out] = pattern
        inverse[out] /= step[out]
        others = np.arange(len(s)) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        x = np.maximum(x, 0)
    used: dict[tuple, int] = {}
    left = np.array(demand)
    for k in np.argsort(-x):
        pattern = np.round(basis[:, k]).astype(int)
        times = int(min(x[k] + 1e-6, (left[pattern > 0] // pattern[pattern > 0]).min(initial=0) if not pattern.any() else (left[pattern > 0] // pattern[pattern > 0]).min()))
        if times:
            used[tuple(pattern.tolist())] = used.get(tuple(pattern.tolist()), 0) + times
            left = left - pattern * times
    room: list[int] = []  # best fit of what rounding has left
    filled: list[np.ndarray] = []
    for i in np.argsort(-s):
        for _ in range(left[i]):
            fits = [k for k, r in enumerate(room) if r >= s[i]]
            k = min(fits, key=room.__getitem__) if fits else len(room)
            if not fits:
                room.append(size)
                filled.append(np.zeros(len(s), int))
            room[k] -= int(s[i])
            filled[k][i] += 1
    for pattern in filled:
        used[tuple(pattern.tolist())] = used.get(tuple(pattern.tolist()), 0) + 1
    return list(used.items())


def plan_large(histogram: dict[int, int], size: int = SIZE, small: int = SMALL, groups: int = GROUPS) -> tuple[dict, int]:
    """(the number of each length's first piece, of each group's first piece, and each group's places; sequences)."""
    lengths = sorted((n for n in histogram if n > small), reverse=True)
    total = sum(histogram[n] for n in lengths)
    each = max(1, -(-total // groups))
    start, at = {}, 0  # number of a length's first piece, in descending order
    for n in lengths:
        start[n], at = at, at + histogram[n]
    rounded: list[tuple[int, int, int]] = []  # (first number, count, rounded length)
    for first in range(0, total, each):
        longest = next(n for n in reversed(lengths) if start[n] <= first)
        count = min(each, total - first)
        if rounded and rounded[-1][2] == longest:
            rounded[-1] = (rounded[-1][0], rounded[-1][1] + count, longest)
        else:
            rounded.append((first, count, longest))
    base, places = 0, [[] for _ in rounded]  # (first place, first sequence, sequences) by size
    filled = [0] * len(rounded)
    for pattern, times in configurations([r[2] for r in rounded], [r[1] for r in rounded], size):
        for i, m in enumerate(pattern):
            if m:
                places[i].append((filled[i], base, times))
                filled[i] += m * times
        base += times
    return {"start": start, "first": np.array([r[0] for r in rounded]), "places": [np.array(p, np.int64).reshape(-1, 3) for p in places]}, base


def sequence_of(plan: dict, length: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The sequence of each large piece, from its length and its number among those of its length."""
    at = np.array([plan["start"][n] for n in length.tolist()], np.int64) + number
    group = np.searchsorted(plan["first"], at, "right") - 1
    out = np.empty(len(at), np.int64)
    for g in np.unique(group):
        own, table = group == g, plan["places"][g]
        place = at[own] - plan["first"][g]
        row = np.searchsorted(table[:, 0], place, "right") - 1
        out[own] = table[row, 1] + (place - table[row, 0]) % table[row, 2]
    return out


def plan_small(histogram: dict[int, int], rooms: dict[int, int], size: int = SIZE) -> tuple[dict[int, np.ndarray], int]:
    """({length: rows of (first number, room, first sequence number in the room)}, new sequences).

    Best fit in descending order: a length takes the least room that holds it, many at a time.
    Room ``size + 1`` stands for new sequences, numbered from 0.
    """
    held: dict[int, list] = {r: [(r, 0, n)] for r, n in rooms.items() if r and n}
    new, plan = 0, {}
    for n in sorted(histogram, reverse=True):
        rows, done, total = [], 0, histogram[n]
        while done < total:
            room = min((r for r in held if r >= n), default=None)
            if room is None:
                more = -(-(total - done) // (size // n))
                held[size] = [(size + 1, new, new + more)]
                new += more
                continue
            origin, low, high = held[room].pop()
            take = min(high - low, total - done)
            rows.append((done, origin, low))
            if low + take < high:
                held[room].append((origin, low + take, high))
            if not held[room]:
                del held[room]
            if room > n:
                held.setdefault(room - n, []).append((origin, low, low + take))
            done += take
        plan[n] = np.array(rows, np.int64)
    return plan, new


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, small: int = SMALL, groups: int = GROUPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A row with an empty or null text is one piece of one id. Repeated rows are packed each. No rows
    for an empty table.
    """
    cutting = materialize(pieces(docs, path, size))
    histogram = {r["length"]: r["count"] for r in cutting.groupBy("length").count().collect()}
    rows, key = sum(histogram.values()), ["doc_id", "piece", "ids_crc32"]
    plan, used = plan_large(histogram, size, small, groups)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long"

    def place_large(frames):
        for frame in frames:
            frame["sequence_id"] = sequence_of(plan, frame["length"].to_numpy(), frame["number"].to_numpy())
            yield frame.drop(columns="number")

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    large = numbered(cutting.where(F.col("length") > small), "length", key, rows, "number").select(*columns, "number")
    large = materialize(large.mapInPandas(tidy(place_large), schema))
    room = large.groupBy("sequence_id").agg((F.lit(size) - F.sum("length")).alias("room")).where("room > 0")
    rooms = {r["room"]: r["count"] for r in room.groupBy("room").count().collect()}
    tiny, _ = plan_small({n: c for n, c in histogram.items() if n <= small}, rooms, size)

    def place_small(frames):
        for frame in frames:
            spot = np.zeros((len(frame), 2), np.int64)
            for n, own in frame.groupby("length").indices.items():
                number = frame["number"].to_numpy()[own]
                row = tiny[n][np.searchsorted(tiny[n][:, 0], number, "right") - 1]
                spot[own] = np.stack([row[:, 1], row[:, 2] + number - row[:, 0]], 1)
            yield frame.drop(columns="number").assign(room=spot[:, 0], spot=spot[:, 1])

    few = numbered(cutting.where(F.col("length") <= small), "length", key, rows, "number").select(*columns, "number")
    few = few.mapInPandas(tidy(place_small), schema.replace("sequence_id long", "room long, spot long"))
    spots = numbered(room, "room", ["sequence_id"], used, "spot")
    fresh = few.where(F.col("room") == size + 1).select(*columns, (F.col("spot") + used).alias("sequence_id"))
    fitted = few.join(spots, ["room", "spot"]).select(*columns, "sequence_id")
    packed = large.unionByName(fresh).unionByName(fitted)
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *key)
    return packed.withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
