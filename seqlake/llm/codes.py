"""Vector code compression: product codes by weighted Lloyd rounds over distinct rows.

A vector's components become integers and are cut into ``PARTS`` consecutive parts. Equal parts of a position are one
row with a weight, so a round works on distinct rows, however often a vector is repeated: tasks
assign their rows to the nearest entries and send sums by entry, and only codebooks
(``PARTS`` x ``ENTRIES`` entries) come to the driver. At the end codes and errors of the distinct
rows are joined back to the vectors; rows of frequent parts stay where they are for that
(``common.hub_join``).

All is whole numbers, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, hub_join, materialize, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are below this, so that sums of squares of vectors of up to 512 components fit 64 bits.
LARGEST = 1 << 26
ROWS = 4096


def whole_parts(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, dim, parts): floor(scale * x) of each component, cut into ``PARTS`` arrays; of whole vectors only."""
    x = table["embedding"].cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    label = table["label"].cast("string") if "label" in table.columns else F.lit(None).cast("string")
    rows = table.select(table["vec_id"].cast("long").alias("vec_id"), label.alias("label"), x.alias("x"), odd.alias("odd")).where("x is not null and not odd")
    large = F.raise_error(F.lit(f"components must be below {LARGEST} / {scale}")).cast("long")
    v = F.transform("x", lambda c: F.when(F.abs(c) * scale >= LARGEST, large).otherwise(F.floor(c * F.lit(float(scale)))))
    rows = rows.select("vec_id", "label", F.size("x").alias("dim"), v.alias("v"))
    size = F.ceil(F.col("dim") / PARTS).cast("int")
    full = F.concat("v", F.array_repeat(F.lit(0).cast("long"), (size * PARTS - F.col("dim")).cast("int")))
    return rows.select("vec_id", "label", "dim", F.array(*(F.slice(full, size * k + 1, size) for k in range(PARTS))).alias("parts"))


def _matrix(column, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def assign(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, of equal ones the first, and its squared distance, exactly."""
    most = int(np.abs(rows).max(initial=0)) + int(np.abs(book).max(initial=0))
    kind = np.float64 if most * most * max(1, rows.shape[1]) < 2**52 else np.int64  # whole numbers are exact in either
    a, b = rows.astype(kind), book.astype(kind)
    d = (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    at = d.argmin(1)
    return at, (d[np.arange(len(a)), at] + (a * a).sum(1)).astype(np.int64)


def first_books(vectors: DataFrame, entries: int = ENTRIES) -> dict:
    """{dim: one array of entries a position}: parts of the vectors of the least ids (of equal ids the lesser vector; null ids last)."""
    order = Window.partitionBy("dim").orderBy(F.asc_nulls_last("vec_id"), "parts")
    least = vectors.withColumn("place", F.row_number().over(order)).where(F.col("place") <= entries).select("dim", "place", "parts").collect()
    books: dict = {}
    for r in sorted(least, key=lambda r: (r["dim"], r["place"])):
        books.setdefault(r["dim"], []).append(r["parts"])
    return {dim: [np.array([v[k] for v in rows], np.int64).reshape(len(rows), -1) for k in range(PARTS)] for dim, rows in books.items()}


def _groups(frame):
    """(dim, position, places of the rows, their matrix) within a batch of distinct rows."""
    import pyarrow as pa

    table = pa.Table.from_batches([frame])
    dims, positions = (table.column(c).to_numpy() for c in ("dim", "position"))
    for dim in np.unique(dims):
        for position in np.unique(positions[dims == dim]):
            at = np.flatnonzero((dims == dim) & (positions == position))
            for cut in range(0, len(at), ROWS):
                some = at[cut : cut + ROWS]
                yield int(dim), int(position), some, _matrix(table.column("part").take(pa.array(some)), len(some))


def lloyd_round(distinct: DataFrame, books: dict) -> dict:
    """The books after every distinct row has gone to its nearest entry, with its weight; unused entries stay."""

    def sums(frames):
        import pyarrow as pa

        total: dict = {}
        for frame in frames:
            weight = frame.column("n").to_numpy()
            for dim, position, at, rows in _groups(frame):
                book = books[dim][position]
                s, n = total.setdefault((dim, position), (np.zeros_like(book), np.zeros(len(book), np.int64)))
                entry, _ = assign(rows, book)
                np.add.at(s, entry, rows * weight[at, None])
                np.add.at(n, entry, weight[at])
        out = [(d, p, e, int(n[e]), s[e].tolist()) for (d, p), (s, n) in total.items() for e in np.flatnonzero(n).tolist()]
        kinds = (("dim", pa.int32()), ("position", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(kinds)], [c for c, _ in kinds])

    part = distinct.mapInArrow(tidy(sums), "dim int, position int, entry int, n long, s array<long>")
    key = ("dim", "position", "entry")
    cells = part.select(*key, "n", F.posexplode("s").alias("i", "x")).groupBy(*key, "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    mean = cells.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "n", "x"))).alias("m"))
    books = {dim: [b.copy() for b in own] for dim, own in books.items()}
    for r in mean.collect():
        books[r["dim"]][r["position"]][r["entry"]] = [c["x"] // c["n"] for c in r["m"]]
    return books


def digest(books: list) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def compress(table: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, scale: int = SCALE) -> DataFrame:
    """The table's whole vectors with code, error, label_error and codebooks_sha256, and other columns left out.

    Rows whose vector is null or holds null or non-finite components are dropped; a null id or label
    is kept. Repeated rows each count and each come back. Vectors of each length have codebooks of
    their own, which must fit the driver; a length that four doesn't divide is filled up with
    zeros. Components of 2 ** 26 / ``scale`` and more raise, since sums might pass 64 bits. Fewer than
    ``entries`` vectors make as many entries. An empty table gives no rows.
    """
    vectors = materialize(whole_parts(table, scale).withColumn("row", F.monotonically_increasing_id()))
    cut = vectors.select("row", "dim", F.posexplode("parts").alias("position", "part"))
    key = F.struct("dim", "position", "part")
    distinct = materialize(cut.groupBy("dim", "position", "part").agg(F.count("*").alias("n")))
    books = first_books(vectors, entries)
    for _ in range(rounds):
        books = lloyd_round(distinct, books)

    def final(frames):
        import pyarrow as pa

        for frame in frames:
            entry, far = np.zeros(frame.num_rows, np.int32), np.zeros(frame.num_rows, np.int64)
            for dim, position, at, rows in _groups(frame):
                entry[at], far[at] = assign(rows, books[dim][position])
            yield pa.RecordBatch.from_arrays([*(frame.column(c) for c in ("dim", "position", "part", "n")), pa.array(entry), pa.array(far)], ["dim", "position", "part", "n", "entry", "far"])

    coded = distinct.mapInArrow(tidy(final), "dim int, position int, part array<long>, n long, entry int, far long")
    coded = materialize(coded.select(key.alias("key"), "n", "entry", "far"))
    total = cut.count()
    met = hub_join(cut.select("row", "position", key.alias("key")), coded, "key", total)
    digit = F.lower(F.lpad(F.hex("entry"), 2, "0"))
    code = F.concat(*(F.max(F.when(F.col("position") == k, digit)) for k in range(PARTS)))
    each = met.groupBy("row").agg(code.alias("code"), F.sum("far").alias("error"))
    sha = F.create_map(*[F.lit(x) for dim, own in books.items() for x in (dim, digest(own))])[F.col("dim")] if books else F.lit(None).cast("string")
    named = F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("named")
    out = materialize(vectors.select("row", "vec_id", named, sha.alias("codebooks_sha256")).join(each, "row").drop("row"))
    by = materialize(out.groupBy("named").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    result = hub_join(out, by, "named", total)
    for used in (distinct, coded, vectors):
        discard(used)
    return result.select("vec_id", "code", "error", "label_error", "codebooks_sha256", F.when(F.col("named") != "", F.substring("named", 2, 2**31 - 1)).alias("label"))
