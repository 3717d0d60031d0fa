"""Indexes as Parquet with the identity of their source, a store for lookups, and ordered text output."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.fasta import files, info, located
from ..sources.sink import distinct_from, write_committed
from . import extract, records, spans


def identity(path: str) -> dict:
    """Size and modification time of a source, a file or a folder of them."""
    _, sizes, times = zip(*files(path), strict=True)
    return {"source": _real(path), "size": sum(sizes), "mtime_ns": max(times)}


def _real(path: str) -> str:
    return os.path.realpath(located(path)[1]) if located(path)[0].type_name == "local" else path


def write_index(index: DataFrame, source: str, path: str, sides: DataFrame | None = None) -> None:
    """The index as Parquet, with its side tables, beside a row of its source's identity; a source that changes meanwhile raises."""
    distinct_from(source, path)
    before = identity(source)
    index.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/rows")  # lookups skip the ranges that hold none of their ids
    if sides is not None:
        sides.write.parquet(f"{path}/sides")
    if identity(source) != before:
        raise ValueError("input.changed")
    index.sparkSession.createDataFrame([before]).coalesce(1).write.parquet(f"{path}/identity")


def open_index(spark: SparkSession, source: str, path: str | None = None, check: bool = True) -> DataFrame:
    """The index of a source: at ``path``, or beside it as ``.zidx``, or else from its ``.fai``.

    A Parquet index that doesn't match the source raises and is never passed over; a ``.fai`` older
    than its source raises too. So does the first row, in order of the source, that ``integrity`` finds wrong,
    by its side table too, unless ``check`` is false.
    """
    chosen = path or (f"{source}.zidx" if info(f"{source}.zidx").type.name != "NotFound" else f"{source}.fai")
    kind = info(chosen).type.name
    if kind == "NotFound":
        raise ValueError(f"index.not_found: {chosen}")
    if kind == "Directory":
        stored, now = spark.read.parquet(f"{chosen}/identity").first().asDict(), identity(source)
        for key, code in (("size", "index.source_size_mismatch"), ("mtime_ns", "index.source_mtime_mismatch")):
            if stored[key] != now[key]:
                raise ValueError(f"{code}: {stored[key]}, now {now[key]}")
        return _checked(spark.read.parquet(f"{chosen}/rows"), source, open_sides(spark, chosen), check)
    if info(chosen).mtime_ns < info(source).mtime_ns:
        raise ValueError(f"index.older_than_source: {chosen}")
    rows = records.read_fai(spark, chosen)
    bad = rows.where("error is not null").first()
    if bad:
        raise ValueError(f"{bad['error']}: {bad['id']}")
    return _checked(rows.drop("error").withColumns({"file": F.lit(source), "record": F.col("ordinal") + 1}), source, None, check)


def _checked(index: DataFrame, source: str, sides: DataFrame | None, check: bool) -> DataFrame:
    bad = integrity(index, source, sides).orderBy("file", "record").first() if check else None
    if bad:
        raise ValueError(f"{bad['error']}: {bad['id']}" + (f", line {bad['entry']} of its side table" if bad["entry"] else "") + f": {bad['value']}, {bad['limit']}")
    return index


def open_sides(spark: SparkSession, path: str) -> DataFrame | None:
    """The side tables of a stored index, if it has them."""
    return spark.read.parquet(f"{path}/sides") if info(f"{path}/sides").type.name == "Directory" else None


def sized(index: DataFrame, source: str | int) -> DataFrame:
    """``index`` with ``size``, that of each row's file: of a source's files by name, or one size for all."""
    if isinstance(source, int):
        return index.withColumn("size", F.lit(source).cast("long"))
    rows = [(name, size) for name, size, _ in files(source)]
    return index.join(index.sparkSession.createDataFrame(rows, "file string, size long"), "file", "left")


def integrity(index: DataFrame, source: str | int, sides: DataFrame | None = None) -> DataFrame:
    """(file, record, id, error, entry, value, limit) of index rows that can't be, each with its first error.

    Uniform rows must have symbols that begin and end within their file, in lines of at least as many
    bytes as symbols. Those of any other row's side table, taken by base_start, must follow one another
    without a gap, lie in order within the file, begin where the row says and have as many symbols as it;
    ``entry`` is the place of the line that doesn't, from 1, ``value`` what it has and ``limit`` what it should.
    Without ``sides`` rows that need them have none. Neighbours meet in windows over ``SPAN`` symbols, with
    a carry from span to span, so a record of any length is checked in parts.
    """
    return errors(sized(index, source), sides)


def errors(rows: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """``integrity`` of index rows that have their file's ``size``."""
    start = [(F.col("seq_len") < 1, "index.zero_sequence_length", "seq_len", F.lit(1)), (F.coalesce(F.col("seq_offset") >= F.col("size"), F.lit(True)), "index.sequence_offset_out_of_bounds", "seq_offset", "size")]
    end = F.col("seq_offset") + F.floor((F.col("seq_len") - 1) / F.col("line_bases")) * F.col("line_bytes") + (F.col("seq_len") - 1) % F.col("line_bases") + 1
    even = [*start, (_odd("line_bases", "line_bytes"), "index.invalid_line_geometry", "line_bytes", "line_bases"), (end > F.col("size"), "index.sequence_span_out_of_bounds", end, "size")]
    keep = ["file", "record", "id", "e.*"]
    found = rows.where("uniform").withColumn("e", _first_error(even, F.lit(None))).where("e is not null").select(*keep)
    others = rows.where("not uniform").select("file", "record", "id", "seq_len", "seq_offset", "size", _first_error(start, F.lit(None)).alias("own"))
    if sides is None:
        sides = rows.sparkSession.createDataFrame([], "file string, record long, base_start long, byte_offset long, line_bytes long, line_bases long")
    joined = others.join(side_errors(sides, others), ["file", "record"], "left")
    last = [(F.col("n").isNull(), "index.side_table_empty", F.lit(0), F.lit(1)), (F.col("bases") != F.col("seq_len"), "index.side_sequence_length_mismatch", "bases", "seq_len")]
    return found.unionByName(joined.withColumn("e", F.coalesce("own", "first", _first_error(last, F.lit(None)))).where("e is not null").select(*keep))


#: Symbols of a record whose side table lines one window holds.
SPAN = 1 << 22


def _odd(bases: str, size: str):
    return (F.col(bases) < 1) | (F.col(size) < 1) | (F.col(size) < F.col(bases))


def _first_error(rules: list, entry):
    """The first of (condition, code, value, limit) that holds, as a struct; null if none does."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    each = [F.when(c, F.struct(F.lit(code).alias("error"), entry.cast("long").alias("entry"), col(value).cast("long").alias("value"), col(limit).cast("long").alias("limit"))) for c, code, value, limit in rules]
    return F.coalesce(*each)


def side_errors(sides: DataFrame, rows: DataFrame) -> DataFrame:
    """(file, record, n, bases, first): lines and symbols of side tables, and the first line's error that is wrong, of records in ``rows``."""
    key, line = ["file", "record"], ["base_start", "byte_offset"]
    each = sides.join(rows.select(*key, "seq_offset", "size"), key).withColumns({"_part": F.floor(F.col("base_start") / SPAN), "_end": F.col("byte_offset") + F.col("line_bytes")})
    own = Window.partitionBy(*key, "_part").orderBy(*line)
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = each.groupBy(*key, "_part").agg(F.count("*").alias("n"), F.sum("line_bases").alias("s"), F.max_by("_end", F.struct(*line)).alias("z"))
    carry = parts.select(*key, "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_s"), F.last("z").over(before).alias("_z"))
    local = each.withColumns({"_k": F.row_number().over(own), "_sum": F.sum("line_bases").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("line_bases"), "_last": F.lag("_end").over(own)})
    at = local.join(carry, [*key, "_part"]).withColumns({"entry": F.col("_n") + F.col("_k"), "expected": F.col("_s") + F.col("_sum"), "least": F.coalesce("_last", "_z")})
    first = F.col("entry") == 1
    error = _first_error([
        (F.col("base_start") != F.col("expected"), "index.side_base_start_mismatch", "base_start", "expected"),
        (_odd("line_bases", "line_bytes"), "index.side_line_geometry_invalid", "line_bytes", "line_bases"),
        (F.col("_end") > F.col("size"), "index.sequence_span_out_of_bounds", "_end", "size"),
        (first & (F.col("byte_offset") != F.col("seq_offset")), "index.side_first_offset_mismatch", "byte_offset", "seq_offset"),
        (~first & (F.col("byte_offset") < F.col("least")), "index.side_line_order_invalid", "byte_offset", "least"),
    ], F.col("entry"))
    return at.withColumn("e", error).groupBy(*key).agg(F.count("*").alias("n"), F.sum("line_bases").alias("bases"), F.min_by("e", F.when(F.col("e").isNotNull(), F.col("entry"))).alias("first"))


def write_text(rows: DataFrame, path: str, *order: str, source: str | None = None, overwrite: bool = False) -> None:
    """Column ``value`` as text in order of ``order``, by ``sources.sink``: as a whole or not at all.

    Never over or into its own source, nor if that changes meanwhile.
    """
    write_committed(rows, path, *order, source=source, overwrite=overwrite)


#: Names that a lookup hands to the scan as a filter; more are joined.
MOST_NAMES = 1024


def named(index: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """The index rows of the ids in ``names``.

    Of up to ``MOST_NAMES`` different ones the least and the greatest, and where they are few each, reach the
    scan as filters, and a stored index, which is in order of ids, is read only where it may have
    them. Others are joined.
    """
    ids = names.select(F.col(name).alias("id")).distinct()
    some = [r["id"] for r in ids.limit(MOST_NAMES + 1).collect()]
    if len(some) > MOST_NAMES:
        return index.join(ids, "id", "left_semi")
    return index.where(F.col("id").isin(*some)) if some else index.limit(0)


class SequenceStore:
    """Lookups over an index (id, ordinal, seq_len) and sequences (ordinal, seq), cut into chunks."""

    def __init__(self, index: DataFrame, sequences: DataFrame, chunk: int = extract.CHUNK) -> None:
        self.index, self.pieces, self.chunk = index, extract.chunks(sequences, chunk), chunk

    def record_count(self) -> int:
        return self.index.count()

    def record(self, ordinal: int):
        """The index row of an ordinal; one that isn't there raises."""
        row = self.index.where(F.col("ordinal") == ordinal).first()
        if row is None:
            raise ValueError("request.ordinal_out_of_range")
        return row

    def lookup(self, name: str) -> int | None:
        """The ordinal of the first record of a name."""
        return self.index.where(F.col("id") == name).agg(F.min("ordinal").alias("o")).first()["o"]

    def fetch(self, ordinal: int, start: int, end: int) -> str:
        """Symbols [start, end), 0-based, never clipped."""
        row = self.record(ordinal)
        if end < start:
            raise ValueError("request.end_before_start")
        if end > row["seq_len"]:
            raise ValueError("request.end_after_sequence")
        if start == end:
            return ""
        parts = self.pieces.where((F.col("ordinal") == ordinal) & F.col("chunk").between(start // self.chunk, (end - 1) // self.chunk)).orderBy("chunk").collect()
        return "".join(r["bases"] for r in parts)[start - start // self.chunk * self.chunk :][: end - start]


def get(index: DataFrame, sequences: DataFrame | None, requests: DataFrame, *, rc: bool = False, complement_only: bool = False, reverse_only: bool = False, annotate: bool = False, width: int = 60, sides: DataFrame | None = None) -> DataFrame:
    """(request, value): FASTA text of requests (request, name, start, end, is_full, optional reverse for strand).

    ``sequences``: (ordinal, seq), or chunks of any sequence (ordinal, chunk, bases). Only index rows
    of requested names and chunks that requests reach are joined. With None for ``sequences`` the
    chunks are read by seeking in the source that the index (and ``sides``, its side tables) names.

    At most one transform; a strand turns on top of it; annotating needs a transform or a strand.
    """
    if rc + complement_only + reverse_only > 1:
        raise ValueError("usage.conflicting_options")
    strand = "reverse" in requests.columns
    if annotate and not (rc or complement_only or reverse_only or strand):
        raise ValueError("usage.option_requires")
    minus = F.col("reverse") if strand else F.lit(False)
    asks = requests.withColumns({"reverse": minus != F.lit(rc or reverse_only), "complement": minus != F.lit(rc or complement_only)})
    known = named(index, asks)
    resolved = extract.resolve(extract.lookup(asks, known))
    extract.first_error(resolved)
    if sequences is None:
        pieces = spans.read_chunks(spans.chunks_asked(resolved), sides)
    else:
        pieces = sequences if "bases" in sequences.columns else extract.chunks(sequences)
        wanted = resolved.select("ordinal", F.explode(F.expr(f"sequence(from_base div {extract.CHUNK}, (to_base - 1) div {extract.CHUNK})")).alias("chunk"))
        pieces = pieces.join(wanted, ["ordinal", "chunk"], "left_semi")
    found = extract.oriented(extract.extract(resolved, pieces))
    if rc or complement_only or strand:
        extract.first_error(found)
    return extract.fasta_text(found, width, annotate)
