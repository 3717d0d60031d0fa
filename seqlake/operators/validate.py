"""Validation rules as findings, comparison with an index, and repair.

Each rule is a filter over line facts with records (``records.assign_records``); its findings have
the same columns and are summed by code. Ids and texts are one character a byte.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ALPHABETS, IUPAC, count_of, identifier, is_nucleotide, symbols, wrap
from . import records

#: The order of a report, with severity; fixed values.
RULES = {
    "fasta.no_records": "error", "fasta.content_before_header": "error", "fasta.header_control_byte": "error", "fasta.sequence_control_byte": "error",
    "fasta.empty_record": "warning", "fasta.empty_identifier": "error", "fasta.duplicate_identifier": "error", "fasta.identifier_too_long": "error",
    "fasta.long_header": "warning", "header.convention_mismatch": "warning", "sequence.invalid_symbol": "error", "format.sequence_whitespace": "warning",
    "format.blank_sequence_line": "warning", "format.inconsistent_wrapping": "warning", "format.leading_bom": "warning",
    "format.missing_terminal_newline": "warning", "format.mixed_line_endings": "warning",
}
#: Prefixes of accession numbers; fixed values.
REFSEQ = ("NC_", "NM_", "NR_", "NP_", "NW_", "NG_", "NT_", "NZ_", "XM_", "XR_", "XP_")
_CONTROL = r"[\x00-\x08\x0a-\x1f]"
SAMPLE_SYMBOLS, LONGEST_ID, LONG_HEADER, REPAIR_CHUNK, PREVIEW = 100_000, 65535, 1024, 65536, 256


def convention(schema: str):
    """Whether column ``id`` follows a naming convention, uniprot or refseq."""
    if schema == "refseq":
        return F.substring("id", 1, 3).isin(*REFSEQ)
    rest = F.substring("id", 4, 2**31 - 1)
    bar = F.instr(rest, "|")
    return F.substring("id", 1, 3).isin("sp|", "tr|", "db|") & (bar >= 2) & (bar < F.length(rest))


def sampled(lines: DataFrame) -> tuple[str, int]:
    """'nucleotide' or 'protein', and how many symbols say so, from the first ``SAMPLE_SYMBOLS`` symbols of a data set, file by file."""
    body = lines.where("not is_header and record > 0 and bases > 0")
    sizes = body.groupBy("file", "split").agg(F.sum("bases").alias("n"))
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")).where(F.col("ahead") < SAMPLE_SYMBOLS)
    own = Window.partitionBy("file", "split").orderBy("line_offset").rowsBetween(Window.unboundedPreceding, 0)
    rows = body.join(F.broadcast(start), ["file", "split"]).withColumn("left", SAMPLE_SYMBOLS - (F.col("ahead") + F.sum("bases").over(own) - F.col("bases"))).where("left > 0")
    head = F.substring(symbols(F.col("content")), F.lit(1), F.least(F.col("left"), F.col("bases")).cast("int"))
    got = rows.agg(F.sum(count_of(head, IUPAC)).alias("i"), F.sum(F.length(head)).alias("n")).select(is_nucleotide(F.coalesce("i", F.lit(0)), F.coalesce("n", F.lit(0))).alias("x"), F.coalesce("n", F.lit(0)).alias("n")).first()
    return "nucleotide" if got["x"] else "protein", got["n"]


def sampled_files(lines: DataFrame) -> DataFrame:
    """(file, alphabet, symbols): 'nucleotide' or 'protein' by the first ``SAMPLE_SYMBOLS`` symbols of each file, and how many say so.

    Splits that begin after the sample are left out before their lines are read; files without symbols are
    'nucleotide'.
    """
    body = lines.where("not is_header and record > 0 and bases > 0")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = body.groupBy("file", "split").agg(F.sum("bases").alias("n"))
    start = sizes.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")).where(F.col("ahead") < SAMPLE_SYMBOLS)
    own = Window.partitionBy("file", "split").orderBy("line_offset").rowsBetween(Window.unboundedPreceding, 0)
    rows = body.join(start, ["file", "split"]).withColumn("left", SAMPLE_SYMBOLS - (F.col("ahead") + F.sum("bases").over(own) - F.col("bases"))).where("left > 0")
    head = F.substring(symbols(F.col("content")), F.lit(1), F.least(F.col("left"), F.col("bases")).cast("int"))
    got = rows.groupBy("file").agg(F.sum(count_of(head, IUPAC)).alias("i"), F.sum(F.length(head)).alias("n"))
    got = lines.select("file").distinct().join(got, "file", "left").select("file", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("n", F.lit(0)).alias("n"))
    return got.select("file", F.when(is_nucleotide(F.col("i"), F.col("n")), "nucleotide").otherwise("protein").alias("alphabet"), F.col("n").alias("symbols"))


def chosen(lines: DataFrame, alphabet: str) -> tuple[str, str]:
    """An alphabet's name, 'auto' decided by the lines, and its letters."""
    name = sampled(lines)[0] if alphabet == "auto" else alphabet
    return name, ALPHABETS.get(name, name)


def invalid_symbols(lines: DataFrame, alphabet: str = "auto") -> DataFrame:
    """byte, n: how often each symbol outside the alphabet stands in sequence lines; none for 'any'. 'auto' is chosen file by file."""
    from .stats import byte_histogram

    if alphabet == "auto":
        kinds = sampled_files(lines)
        parts = [invalid_symbols(lines.join(kinds.where(F.col("alphabet") == k), "file", "left_semi"), k) for k in ("nucleotide", "protein")]
        return parts[0].unionByName(parts[1]).groupBy("byte").agg(F.sum("n").alias("n"))
    name, allowed = chosen(lines, alphabet)
    body = lines.where("not is_header and record > 0 and bases > 0").select(F.encode("content", "ISO-8859-1").alias("raw"))
    seen = byte_histogram(body).where("byte > 32")
    return seen.where(F.lit(name != "any")).where(~F.col("byte").isin(*(ord(x) for x in allowed)))


def examined(lines: DataFrame) -> DataFrame:
    """One row of bytes, lines, records, records_completed and symbols (of records)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return lines.agg(
        total("actual_bytes").alias("bytes"), F.count("*").alias("lines"), F.count_if("is_header").alias("records"), F.count_if("is_header").alias("records_completed"),
        total(F.when(F.col("record") > 0, F.col("bases"))).alias("symbols"),
    )


def records_by_severity(found: DataFrame) -> DataFrame:
    """One row: records_with_errors, records_with_warnings."""
    severity = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])[F.col("code")]
    each = found.where("record > 0").groupBy("file", "record").agg(F.max(severity == "error").alias("e"), F.max(severity == "warning").alias("w"))
    return each.agg(F.count_if("e").alias("records_with_errors"), F.count_if("w").alias("records_with_warnings"))


#: Columns of a finding's place: where a report's ``first`` points to.
PLACE = ["offset", "line", "column", "related", "data"]
_RELATED, _DATA = "struct<offset: bigint, line: bigint, column: bigint, record: bigint>", "map<string, bigint>"


def _place(line, index, related=None, data: dict | None = None):
    """The place of byte ``index`` of a line's content, ``line`` being a struct of line_offset, line_no and bom.

    A byte order mark counts in offsets and columns, as it stands in the file.
    """
    skip = F.when(line["bom"], 3).otherwise(0) + index
    values = [x for k, v in (data or {}).items() for x in (F.lit(k), v.cast("long"))]
    return F.struct(
        (line["line_offset"] + skip).cast("long").alias("offset"), line["line_no"].cast("long").alias("line"), (skip + 1).cast("long").alias("column"),
        (F.lit(None) if related is None else related).cast(_RELATED).alias("related"), (F.create_map(*values) if values else F.create_map()).cast(_DATA).alias("data"),
    )


def findings(lines: DataFrame, alphabet: str = "auto", schema: str | None = None, long_header: int = LONG_HEADER, name_budget: int | None = None) -> DataFrame:
    """(code, file, record, offset, line, column, related, data, n): every finding; n counts the rule's unit at that place.

    A finding about bytes points to the first of them in its line, and about an identifier to its
    first byte; lines and columns count from 1. ``related`` is a duplicate's first definition,
    ``data`` the numbers that a report gives. Findings about a whole file have record 0. With a
    ``name_budget`` duplicates are looked for up to the record that ``names_stopped`` gives. The alphabet 'auto' is
    chosen file by file: both are counted in the one pass, and a file keeps the findings of its own.
    """
    candidates = ["nucleotide", "protein"] if alphabet == "auto" else [] if alphabet == "any" else [alphabet]
    text, header, body = F.col("content"), F.col("is_header"), ~F.col("is_header") & (F.col("record") > 0)
    lines = lines.withColumn("id", F.when(header, identifier(F.substring(text, 2, 2**31 - 1))))
    control, clean, own = F.regexp_count(text, F.lit(_CONTROL)), symbols(text), F.struct("line_offset", "line_no", "bom")
    where = lambda pattern: F.regexp_instr(text, F.lit(pattern)) - 1
    byte = lambda pattern: F.ascii(F.regexp_substr(text, F.lit(pattern)))
    size = F.length(text)
    rules = {  # how often, the index of the first byte, numbers of a report
        "fasta.content_before_header": ((F.col("record") == 0) & text.rlike("[^ \\t\\r]"), where("[^ \\t\\r]"), {"content_bytes": size}),
        "fasta.header_control_byte": (F.when(header, control), where(_CONTROL), {"byte": byte(_CONTROL)}),
        "fasta.sequence_control_byte": (F.when(body, control), where(_CONTROL), {"byte": byte(_CONTROL)}),
        "fasta.empty_identifier": (F.col("id") == "", F.lit(1), {}),
        "fasta.identifier_too_long": (F.length("id") > LONGEST_ID, F.lit(1), {"observed_bytes": F.length("id"), "limit_bytes": F.lit(LONGEST_ID)}),
        "fasta.long_header": (header & (size - 1 > long_header), F.lit(0), {"observed_bytes": size - 1, "limit_bytes": F.lit(long_header)}),
        "format.sequence_whitespace": (body & text.rlike("[ \\t]"), where("[ \\t]"), {"whitespace_bytes": F.regexp_count(text, F.lit("[ \\t]"))}),
        "format.blank_sequence_line": (body & (text == ""), F.lit(0), {}),
    }
    if schema:
        rules["header.convention_mismatch"] = (header & ~convention(schema), F.lit(0), {})
    rules = [(k, None, rule) for k, rule in rules.items()]
    for k in candidates:
        allowed = ALPHABETS.get(k, k)
        outside = "[^\\x00-\\x20" + "".join(f"\\x{ord(x):02x}" for x in allowed) + "]"
        rules.append(("sequence.invalid_symbol", k, (F.when(body, F.length(clean) - count_of(clean, allowed)), where(outside), {"byte": byte(outside)})))
    each = F.array(*(F.when(n.cast("long") > 0, F.struct(F.lit(code).alias("code"), F.lit(k).cast("string").alias("of"), n.cast("long").alias("n"), _place(own, at, None, data).alias("p"))) for code, k, (n, at, data) in rules))
    by_line = lines.select("file", "record", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select("f.code", "f.of", "file", "record", "f.p.*", "f.n")
    if alphabet == "auto":
        by_line = by_line.join(sampled_files(lines).select("file", "alphabet"), "file").where("of is null or of = alphabet").drop("alphabet")
    by_line = by_line.drop("of")
    return by_line.unionByName(repeats(lines, name_budget)).unionByName(record_findings(lines)).unionByName(file_findings(lines))


def _definitions(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers that take part in the search for duplicates, and the first of each id of a file with how many there are."""
    own = F.struct("line_offset", "line_no", "bom")
    named = lines.where(F.col("is_header")).withColumn("id", identifier(F.substring("content", 2, 2**31 - 1))).where(F.length("id").between(1, LONGEST_ID))
    named = named.select("file", "split", "record", "id", _place(own, F.lit(1)).alias("p"))
    at = F.struct("p.offset", "p.line", "p.column", "record")
    return named, named.groupBy("file", "id").agg(F.min(F.struct(at.alias("at"), "split")).alias("f"), F.count("*").alias("k")).select("file", "id", F.col("f.at").alias("first"), "f.split", "k")


def names_stopped(lines: DataFrame, budget: int) -> DataFrame:
    """(file, stopped_at_record) of files whose different ids have more than ``budget`` bytes: the record whose id is too much.

    Bytes of ids are summed at their first definitions, in each split and from split to split.
    """
    _, firsts = _definitions(lines)
    rows = firsts.select("file", "split", F.col("first.record").alias("record"), F.length("id").cast("long").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("file", "split").agg(F.sum("n").alias("n")).select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("file", "split").orderBy("record").rowsBetween(Window.unboundedPreceding, 0)
    total = rows.withColumn("own", F.sum("n").over(own)).join(carry, ["file", "split"])
    return total.where(F.col("ahead") + F.col("own") > budget).groupBy("file").agg(F.min("record").alias("stopped_at_record"))


def repeats(lines: DataFrame, name_budget: int | None = None) -> DataFrame:
    """fasta.duplicate_identifier: every header whose id a header before it in its file has, which is ``related``."""
    named, firsts = _definitions(lines)
    rows = named.join(firsts.where("k > 1").select("file", "id", "first"), ["file", "id"]).where("record > first.record")
    if name_budget is not None:
        rows = rows.join(names_stopped(lines, name_budget), "file", "left").where("stopped_at_record is null or record < stopped_at_record")
    return rows.select(F.lit("fasta.duplicate_identifier").alias("code"), "file", "record", "p.offset", "p.line", "p.column", F.col("first").cast(_RELATED).alias("related"), "p.data", F.lit(1).cast("long").alias("n"))


def record_findings(lines: DataFrame) -> DataFrame:
    """fasta.empty_record, and format.inconsistent_wrapping once a record, at its first offending base line.

    Lines are combined by width first. The first line of the second width to occur is the first that
    differs; it offends unless it is the last base line and narrower.
    """
    line = F.struct("line_offset", "line_no", "bom")
    widths = lines.where("record > 0").groupBy("file", "record", "bases").agg(F.min(line).alias("a"), F.max("line_offset").alias("z"))
    own, base = Window.partitionBy("file", "record"), F.col("bases") > 0
    placed = widths.withColumns({"k": F.row_number().over(own.orderBy(~base, "a.line_offset")), "last": F.max(F.when(base, F.col("z"))).over(own)})
    seen = placed.groupBy("file", "record").agg(
        F.max("bases").alias("most"), F.min("a").alias("head"), F.max(F.when(F.col("k") == 1, F.col("bases"))).alias("width"),
        F.max(F.when((F.col("k") == 2) & base, F.struct("a", "bases", "last"))).alias("odd"),
    )
    offends = (F.col("odd.a.line_offset") < F.col("odd.last")) | (F.col("odd.bases") > F.col("width"))
    wrapping = _place(F.col("odd.a"), F.lit(0), None, {"expected_width": F.col("width"), "actual_width": F.col("odd.bases")})
    found = F.array(
        F.when(F.col("most") == 0, F.struct(F.lit("fasta.empty_record").alias("code"), _place(F.col("head"), F.lit(0)).alias("p"))),
        F.when(offends, F.struct(F.lit("format.inconsistent_wrapping").alias("code"), wrapping.alias("p"))),
    )
    return seen.select("file", "record", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("f.code", "file", "record", "f.p.*", F.lit(1).cast("long").alias("n"))


def file_findings(lines: DataFrame) -> DataFrame:
    """Findings about a whole file: no records, byte order mark, last line end, mixed line ends.

    Line ends are mixed from the first line that ends in the other way on; the place is that line's end,
    as that of a missing one is the file's.
    """
    line = F.struct("line_offset", "line_no", "bom", "content_len", "term")
    first = lambda term: F.min(F.when(F.col("term") == term, line))
    seen = lines.groupBy("file").agg(F.count_if("is_header").alias("headers"), F.max(line).alias("last"), F.max("bom").alias("bom"), first(1).alias("lf"), first(2).alias("crlf"))
    top = F.struct(F.lit(0).alias("line_offset"), F.lit(1).alias("line_no"), F.lit(False).alias("bom"))
    nowhere = F.struct(F.lit(None).cast("long").alias("line_offset"), F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("boolean").alias("bom"))
    other = F.greatest("lf", "crlf")
    rules = {
        "fasta.no_records": (F.col("headers") == 0, _place(nowhere, F.lit(None).cast("int"))),
        "format.leading_bom": (F.col("bom"), _place(top, F.lit(0))),
        "format.missing_terminal_newline": (F.col("last.term") == 0, _place(F.col("last"), F.col("last.content_len"))),
        "format.mixed_line_endings": (F.col("lf").isNotNull() & F.col("crlf").isNotNull(), _place(other, other["content_len"])),
    }
    each = F.array(*(F.when(x, F.struct(F.lit(k).alias("code"), p.alias("p"))) for k, (x, p) in rules.items()))
    return seen.select("file", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select("f.code", "file", F.lit(0).cast("long").alias("record"), "f.p.*", F.lit(1).cast("long").alias("n"))


def by_code(found: DataFrame) -> DataFrame:
    """code, severity, occurrences, records, first_offset."""
    severity = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])
    return found.groupBy("code").agg(F.sum("n").alias("occurrences"), F.count_distinct(F.when(F.col("record") > 0, F.struct("file", "record"))).alias("records"), F.min("offset").alias("first_offset")).select("code", F.coalesce(severity[F.col("code")], F.lit("error")).alias("severity"), "occurrences", "records", "first_offset")


def places(found: DataFrame, lines: DataFrame, preview: int = PREVIEW) -> DataFrame:
    """One row a file and code: occurrences, records, and its first finding: offset, line, column, record, identifier, related, data.

    ``identifier`` has the first ``preview`` bytes of the record's id and ``identifier_bytes`` its length;
    record and both are null for findings about a whole file. Findings are combined map-side, in one pass; headers meet
    them with no more of their ids than is shown, since a choice among them would take the findings once more.
    """
    at = F.struct("offset", "record", "line", "column", "related")
    first = F.min(F.struct(F.coalesce("offset", F.lit(0)).alias("_"), at.alias("at")))
    rows = found.groupBy("file", "code").agg(
        F.sum("n").alias("occurrences"), F.count_distinct(F.when(F.col("record") > 0, F.col("record"))).alias("records"), first.alias("f"),
        F.min_by("data", F.coalesce("offset", F.lit(0))).alias("data"),
    ).select("file", "code", "occurrences", "records", "f.at.*", "data")
    heads = lines.where("is_header").select("file", "record", identifier(F.substring("content", 2, 2**31 - 1)).alias("id"))
    named = heads.select("file", "record", F.substring("id", 1, preview).alias("identifier"), F.length("id").cast("long").alias("identifier_bytes"))
    return rows.join(named, ["file", "record"], "left").withColumn("record", F.when(F.col("record") > 0, F.col("record")))


def outcome(summary: DataFrame, strict: bool = False) -> DataFrame:
    """errors, warnings, status: 1 after errors (or warnings if strict), 2 after warnings, else 0."""
    s = summary.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return s.withColumn("status", F.when(F.col("errors") > 0, 1).when(F.col("warnings") > 0, 1 if strict else 2).otherwise(0))


#: Ordinals are cut into parts of this many, so that a name of many records is numbered by many tasks.
PART = 8192


def occurrences(index: DataFrame, carry: DataFrame) -> DataFrame:
    """``index`` with part, occurrence (from 1, of its id, by ordinal) and what else ``carry`` (by ``parts_of``) has of its id and part."""
    nth = Window.partitionBy("id", "part").orderBy("ordinal")
    rows = index.withColumn("part", F.expr(f"ordinal div {PART}")).withColumn("occurrence", F.row_number().over(nth))
    return rows.join(carry, ["id", "part"], "left").withColumn("occurrence", F.col("occurrence") + F.coalesce("ahead", F.lit(0)))


def parts_of(index: DataFrame) -> DataFrame:
    """(id, part, ahead): how many records of an id lie before each part of the ordinals; counted map-side."""
    before = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return index.groupBy("id", F.expr(f"ordinal div {PART}").alias("part")).agg(F.count("*").alias("n")).select("id", "part", F.sum("n").over(before).alias("ahead"))


def paired(index: DataFrame, other: DataFrame) -> DataFrame:
    """(id, occurrence, a, b, omitted): the k-th record of an id in a file's index beside the k-th entry of another.

    Both have id, ordinal, file, record, seq_len, seq_offset, line_bases, line_bytes and uniform. A record without
    an entry is ``omitted`` if the other index has its id: it leaves out later duplicates. Both are read twice, so
    give tables where they are costly to derive. An id of any number of records is dealt over tasks by ``PART``.
    """
    fields = ["seq_len", "seq_offset", "line_bases", "line_bytes", "uniform"]
    more = lambda x: [c if c in x.columns else F.lit(None).alias(c) for c in ("file", "record")]
    ahead = parts_of(other)
    known = ahead.groupBy("id").agg(F.lit(True).alias("known"))
    a = occurrences(index, parts_of(index).join(known, "id", "left")).select("id", "occurrence", F.struct(*fields, *more(index)).alias("a"), "known")
    b = occurrences(other, ahead).select("id", "occurrence", F.struct(*fields, *more(other)).alias("b"))
    omitted = F.col("b").isNull() & F.coalesce("known", F.lit(False))
    return a.join(b, ["id", "occurrence"], "full").select("id", "occurrence", "a", "b", omitted.alias("omitted"))


def compare_index(index: DataFrame, other: DataFrame, sides: DataFrame | None = None, other_sides: DataFrame | None = None) -> DataFrame:
    """(code, id, occurrence, line): where a file's index and another differ, by ``paired``.

    With side tables of both, those of records whose layout agrees are compared as well; ``line`` is the first that
    differs, from 1. Records that the other index leaves out as later duplicates are no difference.
    """
    both = paired(index, other)
    geometry = (F.col("a.uniform") != F.col("b.uniform")) | (F.col("a.uniform") & ((F.col("a.line_bases") != F.col("b.line_bases")) | (F.col("a.line_bytes") != F.col("b.line_bytes"))))
    codes = F.array(
        F.when(F.col("b").isNull() & ~F.col("omitted"), "pair.record_missing_from_index"), F.when(F.col("a").isNull(), "pair.record_missing_from_fasta"),
        F.when(F.col("a.seq_len") != F.col("b.seq_len"), "pair.sequence_length_mismatch"), F.when(F.col("a.seq_offset") != F.col("b.seq_offset"), "pair.sequence_offset_mismatch"),
        F.when(geometry, "pair.line_geometry_mismatch"),
    )
    found = both.select("id", "occurrence", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"), F.lit(None).cast("long").alias("line"))
    if sides is None or other_sides is None:
        return found
    same = both.where("not a.uniform and not b.uniform").select("id", "occurrence", "a.file", "a.record", F.col("b.file").alias("_file"), F.col("b.record").alias("_record"))
    moved = other_sides.join(same.select(F.col("_file").alias("file"), F.col("_record").alias("record"), F.struct("file", "record").alias("to")), ["file", "record"])
    moved = moved.select("to.file", "to.record", "base_start", "byte_offset", "line_bytes", "line_bases")
    differ = compare_sides(sides.join(same, ["file", "record"], "left_semi"), moved)
    return found.unionByName(same.join(differ, ["file", "record"]).select("id", "occurrence", F.lit("pair.side_table_mismatch").alias("code"), "line"))


def compared(index: DataFrame, other: DataFrame) -> DataFrame:
    """One row of entries (of the other index), matched, and omitted_duplicates (records that it leaves out)."""
    some = lambda c: F.count_if(c)
    return paired(index, other).agg(some(F.col("b").isNotNull()).alias("entries"), some(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), some("omitted").alias("omitted_duplicates"))


def compare_sides(one: DataFrame, two: DataFrame) -> DataFrame:
    """(file, record, line, base_start): the first line, from 1, at which two side tables of a record differ or one ends.

    Lines meet by base_start. Up to the first difference both have the same ones, so its number is
    one more than the lines before it; they are counted map-side.
    """
    cols, key = ["byte_offset", "line_bytes", "line_bases"], ["file", "record"]
    a, b = (x.select(*key, "base_start", F.struct(*cols).alias(n)) for x, n in ((one, "a"), (two, "b")))
    met = a.join(b, [*key, "base_start"], "full")
    first = met.where("not (a <=> b)").groupBy(*key).agg(F.min("base_start").alias("base_start"))
    before = a.join(first.withColumnRenamed("base_start", "_first"), key).where("base_start < _first").groupBy(*key).agg(F.count("*").alias("n"))
    return first.join(before, key, "left").select(*key, (F.coalesce("n", F.lit(0)) + 1).alias("line"), "base_start")


def repaired(lines: DataFrame, width: int = 60) -> DataFrame:
    """(file, record, chunk, value): header bytes as they are (chunk -1) and symbols in lines of ``width``.

    Written in order of file, record and chunk the values are the repaired file's lines; no value
    holds more than some 65,536 symbols.

    Files without records, with content before the first header or with control bytes raise.
    """
    text, control = F.col("content"), F.col("content").rlike(_CONTROL)
    code = (
        F.when((F.col("record") == 0) & text.rlike("[^ \\t\\r]"), "fasta.content_before_header").when(F.col("is_header") & control, "fasta.header_control_byte")
        .when((F.col("record") > 0) & control, "fasta.sequence_control_byte")
    )
    index = F.regexp_instr(text, F.when(F.col("record") == 0, F.lit("[^ \\t\\r]")).otherwise(F.lit(_CONTROL))) - 1 + F.when(F.col("bom"), 3).otherwise(0)
    found = lines.withColumn("code", code).where("code is not null").select("file", "code", (F.col("line_offset") + index).alias("offset"))
    none = lines.groupBy("file").agg(F.count_if("is_header").alias("n")).where("n = 0").select("file", F.lit("fasta.no_records").alias("code"), F.lit(None).cast("long").alias("offset"))
    bad = found.unionByName(none).orderBy(F.coalesce("offset", F.lit(0)), "file", F.col("offset").isNotNull()).first()
    if bad:
        raise ValueError(f"repair.blocked: {bad['code']} at {bad['offset']}")
    size = width * (REPAIR_CHUNK // width or 1)  # whole lines
    rows = records.chunks(lines, size).select("file", "record", "chunk", wrap(F.col("bases"), width).alias("value"))
    return lines.where("is_header").select("file", "record", F.lit(-1).cast("long").alias("chunk"), F.col("content").alias("value")).unionByName(rows)


def custom_alphabet(letters: str) -> str:
    """A custom alphabet: its letters, which must be visible ASCII."""
    if not re.fullmatch(r"[!-~]+", letters):
        raise ValueError("usage.invalid_option_value")
    return letters
