"""Positional reads: byte spans of intervals by an index, and their symbols by seeking in the source.

An interval of a uniform record is found by division. One of any other record is found in its side
table: lines and intervals meet by record and chunk, so neither a long record nor many requests
for it are compared with one another as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fasta import open_at
from .extract import CHUNK

#: Bytes of a file that one group of reads covers: reads of a group are in order of their offsets.
RANGE = 64 << 20
FIELDS = ["file", "record", "seq_offset", "seq_len", "line_bases", "line_bytes", "uniform"]


def _line_of(rows: DataFrame, sides: DataFrame, base: str, name: str) -> DataFrame:
    """``rows`` (key, file, record and a 0-based symbol ``base``) with the line of a side table that holds it, as ``name``."""
    last = F.col("base_start") + F.col("line_bases") - 1
    lines = sides.select("file", "record", F.explode(F.sequence(F.floor(F.col("base_start") / CHUNK), F.floor(last / CHUNK))).alias("_part"), F.struct("base_start", "byte_offset", "line_bytes", "line_bases").alias(name))
    found = rows.withColumn("_part", F.floor(F.col(base) / CHUNK)).join(lines, ["file", "record", "_part"])
    return found.where((F.col(f"{name}.base_start") <= F.col(base)) & (F.col(base) < F.col(f"{name}.base_start") + F.col(f"{name}.line_bases"))).drop("_part")


def disk_spans(rows: DataFrame, sides: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """``rows`` with byte_start, byte_end, leading and trailing: where symbols [from_base, to_base) stand.

    ``rows`` have from_base, to_base and the index's ``FIELDS``; ``sides`` are the side tables of the
    records that aren't uniform. Spans of these begin and end with whole lines, so ``leading`` and
    ``trailing`` symbols of them are not asked for. A span past ``size``, the file's, raises, and so
    does a record that has no side table.
    """
    place = lambda i: F.col("seq_offset") + F.floor(i / F.col("line_bases")) * F.col("line_bytes") + i % F.col("line_bases")
    zero = F.lit(0).cast("long")
    if sides is None:
        missing = F.raise_error(F.lit("index.side_table_empty"))
        out = rows.withColumn("byte_start", F.when(F.col("uniform"), place(F.col("from_base"))).otherwise(missing.cast("long"))).withColumns({"byte_end": place(F.col("to_base") - 1) + 1, "leading": zero, "trailing": zero})
    else:
        even = rows.where("uniform").withColumns({"byte_start": place(F.col("from_base")), "byte_end": place(F.col("to_base") - 1) + 1, "leading": zero, "trailing": zero})
        asked = rows.where("not uniform").withColumn("_last", F.col("to_base") - 1)
        mine = sides.join(asked.select("file", "record"), ["file", "record"], "left_semi")
        both = _line_of(_line_of(asked, mine, "from_base", "_a"), mine, "_last", "_z")
        out = even.unionByName(both.withColumns({
            "byte_start": F.col("_a.byte_offset"), "byte_end": F.col("_z.byte_offset") + F.col("_z.line_bytes"),
            "leading": F.col("from_base") - F.col("_a.base_start"), "trailing": F.col("_z.base_start") + F.col("_z.line_bases") - 1 - F.col("_last"),
        }).drop("_a", "_z", "_last"))
    if size is not None:
        past = F.concat(F.lit("index.sequence_span_out_of_bounds: "), F.col("byte_end").cast("string"))
        out = out.withColumn("byte_end", F.when(F.col("byte_end") > size, F.raise_error(past).cast("long")).otherwise(F.col("byte_end")))
    return out


def chunks_asked(resolved: DataFrame, size: int = CHUNK) -> DataFrame:
    """ordinal, chunk, from_base, to_base and the index's fields of each chunk that resolved requests reach, once."""
    each = resolved.where("error is null").withColumn("chunk", F.explode(F.expr(f"sequence(from_base div {size}, (to_base - 1) div {size})")))
    asked = each.select("ordinal", "chunk", *FIELDS).distinct()
    return asked.withColumns({"from_base": F.col("chunk") * size, "to_base": F.least((F.col("chunk") + 1) * size, "seq_len")})


def read_chunks(asked: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """(ordinal, chunk, bases) of ``chunks_asked``, read from the source's files.

    Reads are dealt by file and range of offsets, and made in order of offset. A span that doesn't
    hold the symbols it should raises: the source isn't the one of the index.
    """
    keep = ["ordinal", "chunk", "file", "byte_start", "byte_end", "leading", F.expr("to_base - from_base").alias("n"), "trailing"]
    spans = disk_spans(asked, sides).select(*keep)
    dealt = spans.repartition("file", F.floor(F.col("byte_start") / RANGE)).sortWithinPartitions("file", "byte_start")

    def read(frames):
        import pandas as pd

        white = bytes(range(33))
        name = data = None
        try:
            for frame in frames:
                bases = []
                for row in frame.itertuples():
                    if row.file != name:
                        if data:
                            data.close()
                        name, data = row.file, open_at(row.file)
                    data.seek(row.byte_start)
                    got = data.read(row.byte_end - row.byte_start).translate(None, white)
                    if len(got) != row.leading + row.n + row.trailing:
                        raise ValueError(f"pair.region_length_mismatch: {row.file} at byte {row.byte_start}")
                    bases.append(got[row.leading : row.leading + row.n].decode("iso-8859-1"))
                yield pd.DataFrame({"ordinal": frame["ordinal"], "chunk": frame["chunk"], "bases": bases})
        finally:
            if data:
                data.close()

    return dealt.mapInPandas(read, "ordinal long, chunk long, bases string")
