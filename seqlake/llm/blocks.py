"""Documents as places in word lists, block by block.

A block is about ``BLOCK_BYTES`` of consecutive documents of a partition. ``block_words`` gives
each distinct word of a block once, with its place in the block's list, dealt to shards by a hash
of the word, so that all that concerns one word is in one shard; ``block_docs`` gives the block's
documents as arrays of those places. What is known of a word is found once in its shard and sent
back to the blocks that use it, and documents pick it up by position. A block's size is bounded,
and a shard is streamed: a task holds its distinct words only. Words must hold no line feed.

Both are computed from the same scan in the same order, so they agree as long as the input is a
file scan or a written table; give them nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from .common import tidy

BLOCK_BYTES, ROW_WORDS, SHARD_DOCS, LEAST_SHARDS, MOST_SHARDS = 24_000_000, 400_000, 2000, 64, 4096


def shard_count(docs: DataFrame) -> int:
    return int(min(MOST_SHARDS, max(LEAST_SHARDS, -(-docs.count() // SHARD_DOCS))))


def pack(numbers: np.ndarray) -> bytes:
    """Compressed bytes of an array of numbers below 2 ** 32, plane by plane."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_words(words: list[str]) -> bytes:
    return zstandard.compress("\n".join(words).encode(), 3)


def unpack_words(data: bytes) -> list[str]:
    return zstandard.decompress(data).decode().split("\n")


class Places(dict):
    """A word's place in order of first use."""

    def __missing__(self, word):
        self[word] = place = len(self)
        return place


def _scan(frames, split: Callable):
    """(block, places of its words, frame, the frame's documents as places, whether the block is done)."""
    from pyspark import TaskContext

    block, known, size, begun = TaskContext.get().partitionId() << 32, Places(), 0, False
    place = known.__getitem__
    for frame in frames:
        for at in range(0, frame.num_rows, 64):
            part = frame.slice(at, 64)
            found = []
            for text in part.column("text").to_pylist():
                found.append(np.fromiter(map(place, split(text)), np.uint32))
                size += len(text)
            begun = True
            yield block, known, part, found, False
            if size >= BLOCK_BYTES:
                yield block, known, None, None, True
                block, size, begun = block + 1, 0, False
                known.clear()
    if begun:
        yield block, known, None, None, True


def block_words(docs: DataFrame, split: Callable, shards: int, counted: str | None = None) -> DataFrame:
    """(shard, block, places, words, counts), packed: the distinct words of each block.

    counts: how often a word stands in documents whose boolean column ``counted`` is true.
    """

    def scan(frames):
        import pyarrow as pa

        counts = np.zeros(0, np.int64)
        for block, known, part, found, done in _scan(frames, split):
            if not done:
                used = [x for x, y in zip(found, part.column(counted).to_pylist(), strict=True) if y] if counted else []
                if used:
                    now = np.bincount(np.concatenate(used), minlength=len(known))
                    now[: len(counts)] += counts
                    counts = now
                continue
            words, n = list(known), np.zeros(len(known), np.int64)
            n[: len(counts)] = counts
            counts = np.zeros(0, np.int64)
            shard = np.fromiter((crc32(w.encode()) % shards for w in words), np.int64, len(words))
            order = np.argsort(shard, kind="stable")
            rows = [[], [], [], []]
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(own):
                    for column, value in zip(rows, (int(shard[own[0]]), pack(own), pack_words([words[k] for k in own.tolist()]), pack(n[own])), strict=True):
                        column.append(value)
            if rows[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int32()), pa.array([block] * len(rows[0]), pa.int64()), *(pa.array(x, pa.binary()) for x in rows[1:])],
                    ["shard", "block", "places", "words", "counts"],
                )

    return docs.mapInArrow(tidy(scan), "shard int, block long, places binary, words binary, counts binary")


def block_docs(docs: DataFrame, split: Callable, extra: str | None = None) -> DataFrame:
    """(block, doc_ids, extras, lengths, places): the documents of a block, some to a row.

    ``extra`` names a boolean column that goes along.
    """

    def scan(frames):
        import pyarrow as pa

        rows: list = []

        def out(block):
            ids = pa.array([[i for r in rows for i in r[0]]], pa.list_(pa.int64()))
            extras = pa.array([[i for r in rows for i in r[1]]], pa.list_(pa.bool_()))
            arrays = [x for r in rows for x in r[2]]
            lengths = pa.array([[len(x) for x in arrays]], pa.list_(pa.int32()))
            data = pa.array([pack(np.concatenate(arrays))], pa.binary())
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), ids, extras, lengths, data], ["block", "doc_ids", "extras", "lengths", "places"])

        held = 0
        for block, _, part, found, done in _scan(frames, split):
            if not done:
                rows.append((part.column("doc_id").to_pylist(), part.column(extra).to_pylist() if extra else [], found))
                held += sum(map(len, found))
            if rows and (done or held >= ROW_WORDS):
                yield out(block)
                held = 0

    return docs.mapInArrow(tidy(scan), "block long, doc_ids array<long>, extras array<boolean>, lengths array<int>, places binary")


def documents(table):
    """(doc_id, extra, places) of each document in an Arrow table of ``block_docs``."""
    for k in range(table.num_rows):
        ids, extras, lengths = (table.column(n)[k].as_py() for n in ("doc_ids", "extras", "lengths"))
        places = unpack(table.column("places")[k].as_py())
        ends = np.cumsum(lengths)
        for i, doc_id in enumerate(ids):
            yield doc_id, extras[i] if extras else None, places[ends[i] - lengths[i] : ends[i]]
