"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of those of its hash and of the hashes of its beginnings. Filters of
several widths pass over the words, each keeps its maximum over the text, and a logistic unit
scores the maxima. The model is trained in numpy on every labelled row that is not held out. A hash
of their ids deals the rows into parts of some ``PART_CHARS`` characters; in each of ``EPOCHS``
rounds a task passes once over each of its parts, by Adam from the same weights, and what they have
changed is averaged: an embedding over its changes, the other weights over the rows. Every fifth row of a
part is kept from training to calibrate a threshold for each language, which is guessed from the
words of the text alone; scores are moved so that the threshold becomes 0.5. Every row is scored over
its whole text, in tasks that hold the model (2 ** BITS embeddings) and some documents at a time.
What comes to the driver is bounded: the model, and counts of logits in steps of 1 / ``STEPS``.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .common import FILTER_BITS, crc32_of_id, fresh, key_filter, materialize, texts, tidy

FOLDS, HELD_OUT = 5, 0
PART_CHARS, READ_CHARS, SLICE, SLOT_BITS, STEPS = 45_000_000, 500_000, 1 << 16, 12, 1024
BITS, DIM, WIDTHS, FILTERS = 16, 16, (1, 2, 3), 16
EPOCHS, BATCH, RATE, BLANKED, SEED = 8, 32, 0.01, 0.4, 7
PAD = max(WIDTHS) - 1

#: Frequent words by which a language is guessed; fixed values.
COMMON = {
    "en": "the of and to in is that for was with as on are by this from it be at have",
    "de": "der die und das den von zu mit ist des im auf für nicht eine ein dem sich auch es",
    "fr": "le la les et des du est une dans que pour qui pas sur au par avec ce un en",
    "es": "el la los de y que las del por con una para se su al es lo como más un",
}
LANGUAGES = ("", *COMMON)
_spoken = {w: [k for k, (_, ws) in enumerate(COMMON.items(), 1) if w in ws.split()] for v in COMMON.values() for w in v.split()}
_find = re.compile(r"[^\W_]+").findall


def features(word: str) -> tuple[int, int, int]:
    """Rows of the embedding table: the word's, and those of its first five and first four letters."""
    mask = (1 << BITS) - 1
    return crc32(word.encode()) & mask, crc32(b"5" + word[:5].encode()) & mask, crc32(b"4" + word[:4].encode()) & mask


class _Places(dict):
    def __missing__(self, word):
        self[word] = place = len(self)
        return place


@dataclass
class Words:
    """Some texts as one row of places: ``PAD`` blanks (place 0) before each text, and after the last."""

    places: np.ndarray
    starts: np.ndarray
    table: np.ndarray  # (words, 3) rows of the embedding table; word 0 is the blank
    language: np.ndarray


def read(some: list[str]) -> Words:
    known = _Places({"": 0})
    place = known.__getitem__
    rows = [np.fromiter(map(place, _find((text or "").lower())), np.int32) for text in some]
    blank = np.zeros(PAD, np.int32)
    places = np.concatenate([y for x in rows for y in (blank, x)] + [blank])
    starts = np.cumsum([0] + [PAD + len(x) for x in rows])[:-1]
    table = np.array([features(w) for w in known], np.int32)
    votes = np.zeros((len(known), len(LANGUAGES)), np.int32)
    for w in known.keys() & _spoken.keys():
        votes[known[w], _spoken[w]] = 1
    heard = np.add.reduceat(votes[places], starts, axis=0)
    heard[:, 0] = 0
    return Words(places, starts, table, np.where(heard.max(1) > 0, heard.argmax(1), 0))


def new_model(prior: float = 0.5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    model = {"E": rng.normal(0, 0.01, (1 << BITS, DIM)), "w": rng.normal(0, 0.1, len(WIDTHS) * FILTERS), "b": np.array([np.log(prior / (1 - prior))])}
    model |= {f"K{w}": rng.normal(0, 0.25 / np.sqrt(w), (w, DIM, FILTERS)) for w in WIDTHS} | {f"c{w}": np.zeros(FILTERS) for w in WIDTHS}
    return {k: v.astype(np.float32) for k, v in model.items()}


def _tops(model: dict, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's maxima of the filters (text, filter), where they are, and the embeddings of the table's words."""
    each = model["E"][words.table].sum(1)
    each[0] = 0
    made = [[each @ kernel for kernel in model[f"K{w}"]] for w in WIDTHS]
    top, at = np.full((len(words.starts), len(WIDTHS), FILTERS), -np.inf, each.dtype), np.zeros((len(words.starts), len(WIDTHS), FILTERS), np.int64)
    ends, filters = np.append(words.starts[1:], len(words.places) - PAD).tolist(), np.arange(FILTERS)
    for i, (start, end) in enumerate(zip(words.starts.tolist(), ends)):
        for a in range(start, end, SLICE):  # a text of any length, some places at a time
            b = min(a + SLICE, end)
            for k, parts in enumerate(made):
                y = parts[0].take(words.places[a:b], axis=0)
                for j, part in enumerate(parts[1:], 1):
                    y += part.take(words.places[a + j : b + j], axis=0)
                pos = y.argmax(0)
                found = y[pos, filters]
                more = found > top[i, k]
                top[i, k, more], at[i, k, more] = found[more], pos[more] + a
    return top + np.stack([model[f"c{w}"] for w in WIDTHS]), at, each


def logits(model: dict, words: Words) -> np.ndarray:
    top = _tops(model, words)[0]
    return np.maximum(top.reshape(len(top), -1), 0) @ model["w"] + model["b"][0]


def _step(model: dict, words: Words, label: np.ndarray) -> tuple[dict, np.ndarray]:
    """The gradient of the logistic loss, and the rows of the embedding table that it has; only the places of the maxima have any."""
    top, at, each = _tops(model, words)
    feats = np.maximum(top.reshape(len(top), -1), 0)
    p = 1 / (1 + np.exp(-(feats @ model["w"] + model["b"][0])))
    d = ((p - label) / len(label)).astype(np.float32)
    grad = {"w": feats.T @ d, "b": np.array([d.sum()])}
    back = d[:, None] * model["w"] * (feats > 0)
    rows, values = [], []
    for k, w in enumerate(WIDTHS):
        own = back[:, k * FILTERS : (k + 1) * FILTERS]
        grad[f"c{w}"] = own.sum(0)
        kernel = np.zeros_like(model[f"K{w}"])
        for j in range(w):
            there = words.places[at[:, k] + j]
            kernel[j] = np.einsum("bf,bfd->df", own, each[there])
            rows.append(there.ravel())
            values.append((own[:, :, None] * model[f"K{w}"][j].T[None]).reshape(-1, DIM))
        grad[f"K{w}"] = kernel
    rows, values = np.concatenate(rows), np.concatenate(values)
    real = (rows > 0) & values.any(1)
    found, to = np.unique(words.table[rows[real]], return_inverse=True)
    grad["E"] = np.zeros((len(found), DIM), np.float32)
    for own in to.reshape(-1, words.table.shape[1]).T:
        np.add.at(grad["E"], own, values[real])
    return grad, found


def _key(table: np.ndarray) -> np.ndarray:
    return table.astype(np.int64) @ (np.int64(1) << np.int64(BITS) * np.arange(table.shape[1], dtype=np.int64))


def joined(some: list[Words]) -> Words:
    """The texts of all of ``some``; words of the same embeddings become one."""
    keys = [_key(x.table) for x in some]
    for x in keys:
        x[0] = -1
    own, to = np.unique(np.concatenate([[-1], *keys]), return_inverse=True)
    to = np.split(to[1:].astype(np.int32), np.cumsum([len(x) for x in keys])[:-1])
    places = [t[x.places[: len(x.places) - PAD]] for t, x in zip(to, some, strict=True)]
    starts = [x.starts + n for x, n in zip(some, np.cumsum([0] + [len(x) for x in places]))]
    table = (own[:, None] >> BITS * np.arange(some[0].table.shape[1]) & (1 << BITS) - 1).astype(np.int32)
    return Words(np.concatenate([*places, np.zeros(PAD, np.int32)]), np.concatenate(starts), table, np.concatenate([x.language for x in some]))


def some_of(words: Words, which: np.ndarray) -> Words:
    """The texts ``which``, in this order."""
    ends = np.append(words.starts[1:], len(words.places) - PAD)
    parts = [words.places[a:b] for a, b in zip(words.starts[which], ends[which])]
    own, places = np.unique(np.concatenate([np.zeros(PAD, np.int32), *parts]), return_inverse=True)
    starts = np.cumsum([0] + [len(x) for x in parts])[:-1]
    return Words(np.append(places[PAD:], np.zeros(PAD, places.dtype)), starts, words.table[own], words.language[which])


def passed(model: dict, words: Words, label: np.ndarray, rows: np.ndarray, r: int) -> tuple[dict, np.ndarray]:
    """``model`` after round ``r``, one pass over the texts ``rows``, and how often each embedding was changed.

    Words are blanked at random, so that no few of them carry a label alone.
    """
    model = {k: v.copy() for k, v in model.items()}
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    changed, rng = np.zeros(len(model["E"]), np.int64), np.random.default_rng((SEED, r))
    for t, part in enumerate(np.array_split(rng.permutation(rows), max(1, len(rows) // BATCH)), 1):
        rate = RATE * (1 if r < EPOCHS - 1 else 0.3) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        own = some_of(words, part)
        own.places[rng.random(len(own.places)) < BLANKED] = 0
        grad, found = _step(model, own, label[part])
        changed[found] += 1
        for k, g in grad.items():
            at = found if k == "E" else slice(None)
            first[k][at] += 0.1 * (g - first[k][at])
            second[k][at] += 0.001 * (g * g - second[k][at])
            model[k][at] -= (rate * first[k][at] / (np.sqrt(second[k][at]) + 1e-7)).astype(np.float32)
    return model, changed


def kept_from_training(n: int) -> np.ndarray:
    """Which of the ``n`` rows of a part are kept for the thresholds."""
    return np.arange(n) % 5 == 4


def _parted(label: np.ndarray, calibrated: bool) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a part to learn from, and those that set thresholds."""
    kept = kept_from_training(len(label))
    every = np.arange(len(label))
    return (every[~kept], every[kept]) if calibrated else (every, every)


def _heard(model: dict, words: Words, rows: np.ndarray) -> np.ndarray:
    """The logits of the texts ``rows``, in whole steps."""
    z = [logits(model, some_of(words, x)) for x in np.array_split(rows, max(1, len(rows) // 64)) if len(x)]
    return np.round(np.clip(np.concatenate([np.zeros(0), *z]), -64, 64) * STEPS).astype(np.int64)


def threshold(z: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the range of logits with the least weighted error."""
    z, to = np.unique(z, return_inverse=True)
    ones, zeros = (np.bincount(to, weight * (label == y), len(z)) for y in (1, 0))
    errors = np.concatenate([[0], np.cumsum(ones)]) + zeros.sum() - np.concatenate([[0], np.cumsum(zeros)])
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    k = np.flatnonzero(errors <= errors.min() + 1e-9)
    return float((edges[k[0]] + edges[k[-1] + 1]) / 2)


def thresholds(language: np.ndarray, label: np.ndarray, z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The threshold of each language, from how many (``n``) rows of a label have a logit of ``z`` steps; few rows have that of all."""
    cuts = np.full(len(LANGUAGES), threshold(z / STEPS, label, n))
    for k in range(len(LANGUAGES)):
        own = language == k
        if min(n[own & (label == y)].sum() for y in (0, 1)) >= 20:
            cuts[k] = threshold(z[own] / STEPS, label[own], n[own])
    return cuts


def constant(label: int) -> tuple[dict, np.ndarray]:
    """What stands for a model where there is one label, or none (0)."""
    model = {k: np.zeros_like(v) for k, v in new_model().items()}
    model["b"] = np.array([3.0 if label else -3.0], np.float32)
    return model, np.zeros(len(LANGUAGES))


def first_model(ones: int, rows: int) -> dict:
    return new_model(float(np.clip(ones / max(1, rows), 0.01, 0.99)))


def fit(some: list[str], label: np.ndarray) -> tuple[dict, np.ndarray]:
    """(model, threshold by language) of one part. Without both labels the model is a constant."""
    label = np.asarray(label, np.float32)
    if len(set(label.tolist())) < 2:
        return constant(int(label.sum() > 0))
    return _fit(joined([read(some[k : k + 64]) for k in range(0, len(some), 64)]), label)


def _fit(words: Words, label: np.ndarray) -> tuple[dict, np.ndarray]:
    kept = kept_from_training(len(label))
    calibrated = all((label[k] == y).any() for k in (kept, ~kept) for y in (0, 1))  # a part without one of the labels can't set a threshold, or teach
    rows, at = _parted(label, calibrated)
    model = first_model(int(label[rows].sum()), len(rows))
    for r in range(EPOCHS):
        model, _ = passed(model, words, label, rows, r)
    return model, thresholds(words.language[at], label[at], _heard(model, words, at), np.ones(len(at)))


def _known(labels: DataFrame, trained: Column) -> DataFrame:
    """(doc_id, toxic) of the documents that teach; one with several labels has the highest."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & trained)
    return usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))


def _hash() -> Column:
    return F.xxhash64("doc_id", F.lit(SEED))


def sample(docs: DataFrame, labels: DataFrame, trained: Column) -> tuple[list[str], np.ndarray]:
    """(texts, labels) of all rows that teach, in order of a part, for ``fit`` on one machine."""
    got = docs.join(_known(labels, trained), "doc_id").orderBy(_hash(), "doc_id", "text").select("toxic", "text").collect()
    return [r["text"] for r in got], np.array([r["toxic"] for r in got])


PART = "part int, places binary, sizes binary, keys binary, language binary, toxic binary, learned array<long>, kept array<long>"


def encode_parts(docs: DataFrame, known: DataFrame, trained: Column, parts: int) -> DataFrame:
    """A row for each part: its texts as places of words, and its numbers of rows of each label, to learn from and kept.

    A filter leaves most documents without a label where they are. The others meet their labels by
    part and order: a document's label comes before its texts.
    """
    part = F.pmod(_hash(), F.lit(parts)).cast("int").alias("part")
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(known.select(_hash().alias("h")), "h"))

    def wanted(frames):
        import pyarrow as pa

        for frame in frames:
            at = frame.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            yield frame.filter(pa.array(sent.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1))

    def encode(frames):
        import pyarrow as pa

        current, own, label, done, waiting, toxic, size = None, None, None, [], [], [], 0

        def take():
            nonlocal size
            if waiting:
                done.append(read(waiting))
                waiting.clear()
                size = 0

        def out():
            take()
            if not done:
                return
            words, y = joined(done), np.array(toxic)
            kept = kept_from_training(len(y))
            row = (current, pack(words.places), pack(np.diff(np.append(words.starts, len(words.places) - PAD))), pack(_key(words.table).view("<u4")), pack(words.language), pack(y), *(np.bincount(y[k], minlength=2).tolist() for k in (~kept, kept)))
            done.clear()
            toxic.clear()
            kinds = (pa.int32(), *[pa.binary()] * 5, *[pa.list_(pa.int64())] * 2)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [c.split()[0] for c in PART.split(", ")])

        for frame in frames:
            for at in range(0, frame.num_rows, 64):
                some = frame.slice(at, 64)
                for p, doc_id, y, text in zip(*(some.column(c).to_pylist() for c in ("part", "doc_id", "toxic", "text")), strict=True):
                    if p != current:
                        yield from out()
                        current, own = p, None
                    if text is None:
                        own, label = doc_id, y
                    elif doc_id == own:
                        waiting.append(text)
                        toxic.append(int(label > 0))
                        size += len(text)
                        if size >= READ_CHARS:
                            take()
        yield from out()

    taught = docs.where(trained).select(_hash().alias("h"), "doc_id", "text").mapInArrow(wanted, "h long, doc_id long, text string")
    rows = taught.withColumn("toxic", F.lit(None).cast("int")).unionByName(known.select(_hash().alias("h"), "doc_id", F.lit(None).cast("string").alias("text"), "toxic"))
    dealt = rows.withColumn("part", part).repartition("part").sortWithinPartitions("part", "h", "doc_id", F.col("text").asc_nulls_first())
    return dealt.select("part", "doc_id", "toxic", "text").mapInArrow(tidy(encode), PART)


def _each_part(frames):
    """(part, words, label) of rows of ``encode_parts``."""
    for frame in frames:
        for k in range(frame.num_rows):
            part, *packed = (frame.column(c)[k].as_py() for c in ("part", "places", "sizes", "keys", "language", "toxic"))
            places, sizes, keys, language, toxic = map(unpack, packed)
            keys = keys.view("<i8")
            table = (keys[:, None] >> BITS * np.arange(3) & (1 << BITS) - 1).astype(np.int32)
            yield part, Words(places.astype(np.int32), np.cumsum(sizes.astype(np.int64)) - sizes, table, language.astype(np.int64)), toxic.astype(np.float32)


CHANGE = "slot int, part int, at binary, n binary, change binary"


def _round(parts: DataFrame, model: dict, calibrated: bool, r: int) -> dict:
    """``model`` after a round: every part's pass begins with it, and their changes are averaged."""
    sent, rest = parts.sparkSession.sparkContext.broadcast(model), sorted(model.keys() - {"E"})
    names = [c.split()[0] for c in CHANGE.split(", ")]

    def change(frames):
        import pyarrow as pa

        start, kinds = sent.value, (pa.int32(), pa.int32(), *[pa.binary()] * 3)
        for part, words, label in _each_part(frames):
            rows, _ = _parted(label, calibrated)
            if not len(rows):
                continue
            end, n = passed(start, words, label, rows, r)
            at = np.flatnonzero(n)
            found = [(int(x[0] >> SLOT_BITS), part, pack(x & (1 << SLOT_BITS) - 1), pack(n[x]), (end["E"][x] - start["E"][x]).tobytes()) for x in np.split(at, np.flatnonzero(np.diff(at >> SLOT_BITS)) + 1) if len(x)]
            found.append((-1, part, pack(np.zeros(1)), pack(np.array([len(rows)])), np.concatenate([(end[k] - start[k]).ravel() for k in rest]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    def mean(frames):
        import pyarrow as pa

        current = total = count = None

        def out():
            at = np.flatnonzero(count)
            row = (current, 0, pack(at), pack(at), (total[at] / count[at, None]).astype(np.float32).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], names)

        for frame in frames:
            for k in range(frame.num_rows):
                slot, at, n, changes = (frame.column(c)[k].as_py() for c in ("slot", "at", "n", "change"))
                at, n = unpack(at), unpack(n).astype(np.float64)
                changes = np.frombuffer(changes, np.float32).reshape(len(at), -1)
                if slot != current:
                    if current is not None:
                        yield out()
                    size = 1 if slot < 0 else 1 << SLOT_BITS
                    current, total, count = slot, np.zeros((size, changes.shape[1])), np.zeros(size)
                total[at] += n[:, None] * changes
                count[at] += n
        if current is not None:
            yield out()

    changed = parts.mapInArrow(tidy(change), CHANGE).repartition("slot").sortWithinPartitions("slot", "part")
    model = {k: v.copy() for k, v in model.items()}
    for x in changed.mapInArrow(mean, CHANGE).collect():
        got = np.frombuffer(x["change"], np.float32)
        if x["slot"] >= 0:
            model["E"][unpack(x["at"]) + (x["slot"] << SLOT_BITS)] += got.reshape(-1, DIM)
        else:
            for k, own in zip(rest, np.split(got, np.cumsum([model[k].size for k in rest])[:-1]), strict=True):
                model[k] += own.reshape(model[k].shape)
    return model


def learn(docs: DataFrame, labels: DataFrame, trained: Column) -> tuple[dict, np.ndarray]:
    """(model, threshold by language) of every labelled row; only the model and bounded counts come to the driver.

    One part gives in its task what ``fit`` makes of ``sample``.
    """
    known = _known(labels, trained)
    rows, size = known.count(), docs.where(trained).agg(F.avg(F.length("text")).alias("n")).first()["n"] or 0
    encoded = encode_parts(docs, known, trained, parts := max(1, -int(-rows * size // PART_CHARS)))
    if parts == 1:

        def whole(frames):
            import pyarrow as pa

            for _, words, label in _each_part(frames):
                found = _fit(words, label) if len(set(label.tolist())) > 1 else constant(int(label.sum() > 0))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["model"])

        got = encoded.mapInArrow(tidy(whole), "model binary").collect()
        return pickle.loads(got[0]["model"]) if got else constant(0)
    encoded = materialize(encoded)
    n = encoded.agg(*(F.coalesce(F.sum(F.col(c)[y]), F.lit(0)).alias(f"{c}{y}") for c in ("learned", "kept") for y in (0, 1))).first()
    calibrated = min(n) > 0
    zeros, ones = (n[f"learned{y}"] + (0 if calibrated else n[f"kept{y}"]) for y in (0, 1))
    if not (zeros and ones):
        return constant(int(ones > 0))
    model = first_model(ones, zeros + ones)
    packed = encoded.drop("learned", "kept")
    for r in range(EPOCHS):
        model = _round(packed, model, calibrated, r)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def hear(frames):
        import pyarrow as pa

        for _, words, label in _each_part(frames):
            _, at = _parted(label, calibrated)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (words.language[at], label[at], _heard(sent.value, words, at))], ["language", "toxic", "z"])

    heard = packed.mapInArrow(tidy(hear), "language long, toxic long, z long").groupBy("language", "toxic", "z").count().orderBy("language", "toxic", "z").toPandas()
    return model, thresholds(*(heard[c].to_numpy() for c in ("language", "toxic", "z", "count")))


def score(docs: DataFrame, model: dict, cuts: np.ndarray, *columns: str, name: str = "score") -> DataFrame:
    """``columns`` and the score (0 to 1, as column ``name``) of every row's text; null counts as empty."""
    own = docs.sparkSession.sparkContext.broadcast((model, cuts))

    def scan(frames):
        import pyarrow as pa
        import pyarrow.compute as pc

        net, cut = own.value
        for frame in frames:
            found = np.zeros(frame.num_rows)
            at, size = 0, 0
            sizes = pc.fill_null(pc.binary_length(frame.column("text")), 0).to_pylist()
            for k, n in enumerate(sizes):
                size += n
                if size >= READ_CHARS or k == len(sizes) - 1:
                    words = read(frame.column("text").slice(at, k + 1 - at).to_pylist())
                    z = logits(net, words).astype(np.float64) - cut[words.language]
                    found[at : k + 1] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    at, size = k + 1, 0
            yield pa.RecordBatch.from_arrays([*(frame.column(c) for c in columns), pa.array(found)], [*columns, name])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.mapInArrow(tidy(scan), f"{kinds}, `{name}` double")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier doesn't call toxic."""
    trained = crc32_of_id() % FOLDS != HELD_OUT
    model, cuts = learn(texts(docs), labels, trained)
    name = fresh(docs, "toxicity")
    return score(docs, model, cuts, *docs.columns, name=name).where(F.col(name) < 0.5).select(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out: their labels are never read. Null and
    empty texts are scored like any other. A null doc_id counts as not held out. Without usable
    labels every score is the same.
    """
    own = texts(docs)
    model, cuts = learn(own, labels, crc32_of_id() % FOLDS != HELD_OUT)
    held = F.coalesce(crc32_of_id() % FOLDS == HELD_OUT, F.lit(False))
    return score(own, model, cuts, "doc_id").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
