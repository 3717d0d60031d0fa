"""From physical lines to records and their layout.

Lines carry file, split, line_offset, raw (bytes) and term. A window never spans more than a
split; what a split needs from those before it is a small running summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bytes_text, description, identifier, symbols


BOM = "\u00ef\u00bb\u00bf"


def line_facts(lines: DataFrame) -> DataFrame:
    """file, split, line_offset, term, bom, content, is_header, content_len, actual_bytes, bases (0 for headers).

    A byte order mark at the start of a file is flagged as ``bom`` and left out of the content.
    """
    bom = (F.col("line_offset") == 0) & F.col("all").startswith(BOM)
    header = F.col("content").startswith(">")
    facts = lines.select("file", "split", "line_offset", "term", bytes_text(F.col("raw")).alias("all")).withColumn("bom", bom)
    facts = facts.select("file", "split", "line_offset", "term", "bom", F.when(F.col("bom"), F.substring("all", 4, 2**31 - 1)).otherwise(F.col("all")).alias("content")).withColumn("is_header", header)
    return facts.withColumns({
        "content_len": F.length("content").cast("long"),
        "actual_bytes": (F.length("content") + F.col("term") + F.when(F.col("bom"), 3).otherwise(0)).cast("long"),
        "bases": F.when(header, 0).otherwise(F.length(symbols(F.col("content")))).cast("long"),
    })


def outline(facts: DataFrame) -> DataFrame:
    """``facts`` with the content of headers alone: what an index and its side tables are made from, without the symbols."""
    return facts.withColumn("content", F.when(F.col("is_header"), F.col("content")))


def assign_records(facts: DataFrame) -> DataFrame:
    """``facts`` with line_no and record (from 1 in a file) and header_offset; before the first header: record 0, null.

    Each line belongs to the last header at or before it.
    """
    own = Window.partitionBy("file", "split").orderBy("line_offset")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    parts = facts.groupBy("file", "split").agg(F.count("*").alias("n_lines"), F.count_if("is_header").alias("n_headers"), F.max(F.when(F.col("is_header"), F.col("line_offset"))).alias("last_header"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        "file", "split",
        F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("lines_before"),
        F.coalesce(F.sum("n_headers").over(before), F.lit(0)).alias("records_before"),
        F.max("last_header").over(before).alias("header_before"),
    )
    local = facts.withColumns({
        "_line": F.row_number().over(own),
        "_record": F.sum(F.col("is_header").cast("long")).over(upto),
        "_header": F.max(F.when(F.col("is_header"), F.col("line_offset"))).over(upto),
    })
    return local.join(carry, ["file", "split"]).select(
        *facts.columns,
        (F.col("lines_before") + F.col("_line")).alias("line_no"),
        (F.col("records_before") + F.col("_record")).alias("record"),
        F.coalesce("_header", "header_before").alias("header_offset"),
    )


def headers(lines: DataFrame) -> DataFrame:
    """file, record, header_offset, id, description of every header."""
    head = F.substring("content", 2, 2**31 - 1)
    return lines.where("is_header").select("file", "record", F.col("line_offset").alias("header_offset"), identifier(head).alias("id"), description(head).alias("description"), F.length(head).cast("long").alias("header_bytes"))


def positions(lines: DataFrame) -> DataFrame:
    """``lines`` with base_start: how many symbols of its record stand before a line.

    Symbols are summed in each split and carried on by split; a record begins at the last header's
    sum, which never falls along a file. So no window spans more than a split.
    """
    upto = Window.partitionBy("file", "split").orderBy("line_offset").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    parts = lines.groupBy("file", "split").agg(F.sum("bases").alias("n"))
    carry = parts.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_ahead"))
    local = lines.withColumn("_sum", F.sum("bases").over(upto) - F.col("bases")).join(carry, ["file", "split"]).withColumn("_sum", F.col("_sum") + F.col("_ahead"))
    heads = local.where("is_header").groupBy("file", "split").agg(F.max("_sum").alias("_own"))
    heads = parts.select("file", "split").join(heads, ["file", "split"], "left").select("file", "split", F.coalesce(F.max("_own").over(before), F.lit(0)).alias("_first"))
    first = F.greatest(F.max(F.when(F.col("is_header"), F.col("_sum"))).over(upto), "_first")
    return local.join(heads, ["file", "split"]).select(*lines.columns, (F.col("_sum") - first).alias("base_start"))


def chunks(lines: DataFrame, size: int = 65536) -> DataFrame:
    """(file, record, chunk, bases): the symbols of each record in pieces of ``size``, straight from lines.

    A line is cut where chunks meet, and the parts of a chunk are put together: no group holds more
    than ``size`` symbols, whatever a record's length.
    """
    base = positions(lines).where("not is_header and record > 0 and bases > 0").select("file", "record", "base_start", symbols(F.col("content")).alias("s"))
    each = base.withColumn("chunk", F.explode(F.expr(f"sequence(base_start div {size}, (base_start + length(s) - 1) div {size})")))
    at = F.greatest(F.col("chunk") * size, "base_start")
    part = F.substring("s", (at - F.col("base_start") + 1).cast("int"), (F.least((F.col("chunk") + 1) * size, F.col("base_start") + F.length("s")) - at).cast("int"))
    grouped = each.select("file", "record", "chunk", F.struct(at.alias("at"), part.alias("s")).alias("p")).groupBy("file", "record", "chunk").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return grouped.select("file", "record", "chunk", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("bases"))


def read_records(lines: DataFrame) -> DataFrame:
    """file, record, id, description, sequence of the records that have symbols.

    A record's sequence is one value here, as its reader has it: at most 2 GB. ``chunks`` gives
    sequences of any length.
    """
    parts = chunks(lines).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("chunk", F.col("bases").alias("s")))).alias("parts"))
    seq = F.array_join(F.transform("parts", lambda p: p["s"]), "")
    return headers(lines).join(parts, ["file", "record"]).select("file", "record", "id", "description", seq.alias("sequence"))


def layout(lines: DataFrame) -> DataFrame:
    """file, record, seq_offset, seq_len, line_bases, line_bytes, uniform, reason of every record with symbols.

    A record is uniform if every base line but the last looks like the first, the last is no
    longer, there is no white space among symbols and no blank line between base lines. All steps
    are grouped aggregates, so a record of any length is combined map-side.
    """
    body = lines.where("not is_header and record > 0")
    base = body.where("bases > 0")
    key = ["file", "record"]
    ends = base.groupBy(*key).agg(
        F.sum("bases").alias("seq_len"),
        F.min_by(F.struct("line_offset", "bases", "actual_bytes", "content_len", "term"), "line_offset").alias("first"),
        F.max("line_offset").alias("last_offset"),
    )
    joined = body.join(ends, key)
    is_base, last = F.col("bases") > 0, F.col("line_offset") == F.col("last_offset")
    space = is_base & (F.col("bases") != F.col("content_len"))
    odd = is_base & ~last & ((F.col("bases") != F.col("first.bases")) | (F.col("actual_bytes") != F.col("first.actual_bytes")))
    wide = is_base & last & ((F.col("bases") > F.col("first.bases")) | (F.col("content_len") > F.col("first.content_len")))
    blank = ~is_base & (F.col("line_offset") > F.col("first.line_offset")) & ~(F.col("line_offset") > F.col("last_offset"))
    offset = lambda c: F.min(F.when(c, F.col("line_offset")))
    kind = (
        F.when(F.col("bases") < F.col("first.bases"), "interior_short_line")
        .when(F.col("bases") > F.col("first.bases"), "wider_line")
        .otherwise("mixed_line_endings")
    )
    seen = joined.groupBy(*key).agg(
        F.first("seq_len").alias("seq_len"), F.first("first").alias("first"),
        offset(space).alias("space_at"), offset(odd).alias("odd_at"), F.min_by(F.when(odd, kind), F.when(odd, F.col("line_offset"))).alias("odd_kind"),
        offset(blank).alias("blank_at"), offset(wide).alias("wide_at"),
    )
    after = base.join(seen.where("odd_at is not null").select(*key, "odd_at"), key).where("line_offset > odd_at").groupBy(*key).agg(F.min("line_offset").alias("odd_seen"))
    seen = seen.join(after, key, "left")
    first = F.col("first")
    dense = (first["bases"] == first["content_len"])
    reason = (
        F.when(~dense, "sequence_whitespace")
        .when(F.col("blank_at").isNotNull(), "interior_blank_line")
        .when(F.col("space_at").isNotNull() & (F.col("odd_seen").isNull() | (F.col("space_at") <= F.col("odd_seen"))), "sequence_whitespace")
        .when(F.col("odd_at").isNotNull(), F.col("odd_kind"))
        .when(F.col("wide_at").isNotNull(), "wider_line")
    )
    return seen.select(
        *key, first["line_offset"].alias("seq_offset"), "seq_len", first["bases"].alias("line_bases"),
        (first["actual_bytes"] + F.when(first["term"] == 0, 1).otherwise(0)).alias("line_bytes"), reason.isNull().alias("uniform"), reason.alias("reason"),
    )


def side_table(lines: DataFrame) -> DataFrame:
    """file, record, base_start, byte_offset, line_bytes, line_bases of every base line, for records that aren't uniform."""
    base = positions(lines).where("not is_header and record > 0 and bases > 0").join(layout(lines).where("not uniform").select("file", "record"), ["file", "record"], "left_semi")
    return base.select("file", "record", "base_start", F.col("line_offset").alias("byte_offset"), F.col("actual_bytes").alias("line_bytes"), F.col("bases").alias("line_bases"))


def index(lines: DataFrame) -> DataFrame:
    """The index: file, ordinal (from 0, of records with symbols), id and layout. A file that doesn't begin with a header raises."""
    bad = lines.where("line_no = 1 and (bom or not is_header)").select("file").first()
    if bad:
        raise ValueError(f"index.initial_header_required: {bad['file']}")
    rows = headers(lines).join(layout(lines), ["file", "record"])
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("file").orderBy("record")) - 1)


def across_files(idx: DataFrame) -> DataFrame:
    """An index of several files with ordinals that run on from file to file, by name."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    carry = idx.groupBy("file").agg(F.count("*").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_ahead"))
    return idx.join(carry, "file").withColumn("ordinal", F.col("ordinal") + F.col("_ahead")).drop("_ahead")


def fai_rows(idx: DataFrame) -> DataFrame:
    """One line of a .fai for each record, with its order; a record that isn't uniform raises."""
    bad = idx.where("not uniform").orderBy("file", "record").select("id", "reason").first()
    if bad:
        raise ValueError(f"index.nonuniform_fai: {bad['id']}: {bad['reason']}")
    return idx.select("file", "record", F.concat_ws("\t", "id", "seq_len", "seq_offset", "line_bases", "line_bytes").alias("value"))


def read_fai(spark, path: str) -> DataFrame:
    """ordinal (from 0), id, seq_len, seq_offset, line_bases, line_bytes, uniform, error of a .fai's lines.

    Blank lines and extra columns are left out. Rows are told apart by their byte offsets, and
    numbered by split with a carry.
    """
    from ..sources.fasta import read_lines

    rows = read_lines(spark, path).withColumn("value", F.decode(F.col("raw"), "UTF-8")).where("value <> ''").withColumn("f", F.split("value", "\t"))
    names = ["seq_len", "seq_offset", "line_bases", "line_bytes"]
    fields = [F.get("f", F.lit(k + 1)) for k in range(4)]
    number = [F.when(x.rlike("^[0-9]+$"), x.cast("decimal(38,0)")) for x in fields]
    missing, odd, wide = (F.lit(False), F.lit(False), F.lit(False))
    for x, n in zip(fields, number, strict=True):
        missing, odd, wide = missing | x.isNull(), odd | ~x.rlike("^[0-9]+$"), wide | (n > 2**63 - 1) | (F.length(x) > 38)
    own = Window.partitionBy("split").orderBy("line_offset")
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("split").agg(F.count("*").alias("n")).select("split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    out = rows.withColumn("own", F.row_number().over(own)).join(F.broadcast(carry), "split")
    fits = [F.when(n <= 2**63 - 1, n).cast("long").alias(c) for n, c in zip(number, names, strict=True)]
    error = F.when(missing, "index.fai.field_missing").when(odd, "index.fai.invalid_integer").when(wide, "index.fai.integer_out_of_range")
    out = out.select((F.col("ahead") + F.col("own") - 1).alias("ordinal"), F.get("f", F.lit(0)).alias("id"), *fits, F.lit(True).alias("uniform"), error.alias("error"))
    zero = F.when(F.col("seq_len") == 0, "index.zero_sequence_length").when((F.col("line_bases") == 0) | (F.col("line_bytes") < F.col("line_bases")), "index.invalid_line_geometry")
    return out.withColumn("error", F.coalesce("error", zero))
