import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from seqlake import streaming
from seqlake.operators import extract, records, reports, requests, spans, stats, store, validate
from seqlake.sources.fasta import read_lines

DATA = b">seq1 x\nACGTACGTACGT\nACGTACGTACGT\n>seq2\nGGGGCCCCAAAA\n>seq1\nTT\n"


@pytest.fixture
def source(tmp_path):
    path = tmp_path / "x.fa"
    path.write_bytes(DATA)
    return str(path)


@pytest.fixture
def lines(spark, source):
    return records.assign_records(records.line_facts(read_lines(spark, source)))


@pytest.fixture
def sequences(lines):
    return records.read_records(lines).select((F.col("record") - 1).alias("ordinal"), F.col("sequence").alias("seq"))


def test_index_round_trip(spark, source, lines):
    idx = records.index(lines)
    store.write_index(idx, source, source + ".zidx")
    back = store.open_index(spark, source)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, idx.collect()))
    assert store.integrity(back, len(DATA)).count() == 0
    assert {r.error for r in store.integrity(back, 30).collect()} == {"index.sequence_span_out_of_bounds", "index.sequence_offset_out_of_bounds"}
    os.utime(source, ns=(1, 1))
    with pytest.raises(ValueError, match="index.source_mtime_mismatch"):
        store.open_index(spark, source)
    with pytest.raises(ValueError, match="index.not_found"):
        store.open_index(spark, source, source + ".none")


def test_store(lines, sequences):
    idx = records.index(lines)
    s = store.SequenceStore(idx, sequences, 5)
    assert (s.record_count(), s.lookup("seq1"), s.lookup("none"), s.record(1).id) == (3, 0, None, "seq2")
    whole = "ACGTACGTACGT" * 2
    assert all(s.fetch(0, a, b) == whole[a:b] for a, b in ((0, 24), (3, 11), (5, 5), (23, 24)))
    for args, code in (((9, 0, 1), "ordinal"), ((0, 2, 1), "end_before"), ((0, 0, 25), "end_after")):
        with pytest.raises(ValueError, match=code):
            s.fetch(*args)


def test_get_and_text(spark, tmp_path, source, lines, sequences):
    idx = records.index(lines)
    asks = requests.parse_regions(spark.createDataFrame([(0, "seq1:1-5"), (1, "seq2"), (2, "seq1:1-5")], "request long, token string"))
    got = [r.value for r in store.get(idx, sequences, asks, rc=True, annotate=True, width=4).orderBy("request").collect()]
    assert got == [">seq1:1-5 (reverse complement)\nTACG\nT", ">seq2 (reverse complement)\nTTTT\nGGGG\nCCCC", ">seq1:1-5 (reverse complement)\nTACG\nT"]
    with pytest.raises(ValueError, match="conflicting"):
        store.get(idx, sequences, asks, rc=True, reverse_only=True)
    with pytest.raises(ValueError, match="option_requires"):
        store.get(idx, sequences, asks, annotate=True)
    out = str(tmp_path / "out")
    store.write_text(store.get(idx, sequences, asks), out, "request")
    parts = sorted(p for p in os.listdir(out) if p.startswith("part-"))
    assert "".join(open(f"{out}/{p}").read() for p in parts) == ">seq1:1-5\nACGTA\n>seq2\nGGGGCCCCAAAA\n>seq1:1-5\nACGTA\n"
    with pytest.raises(ValueError, match="output_is_input"):
        store.write_text(asks.withColumn("value", F.col("token")), source, "request", source=source)


def test_reports(lines, sequences):
    text = reports.stats_text(stats.length_summary(records.index(lines)).first(), stats.composition(sequences).first())
    assert "  n50: 24\n" in text and "  type: nucleotide_t\n" in text and "  a: 10 26.32%\n" in text and "  iupac_ambiguous: 0 0.00%\n" in text
    report = reports.validation(lines)
    assert report["outcome"] == "invalid" and [c["code"] for c in report["codes"]] == ["fasta.duplicate_identifier"] and reports.exit_status(report) == 1
    assert report["checks"] == {"structure": "passed", "identifiers": "failed", "alphabet": "passed", "format": "passed"}
    assert report["examined"] == {"bytes": len(DATA), "lines": 7, "records": 3, "records_completed": 3, "symbols": 38}
    assert (report["records_with_errors"], report["records_with_warnings"], report["invalid_symbols"]) == (1, 0, [])
    back = json.loads(reports.validation_json(report))
    assert back["findings"] == {"errors": "1", "warnings": "0", "error_codes": "1", "warning_codes": "0"} and back["policy"]["strict"] is False
    assert reports.validation_text(report, "x.fa") == (
        "INVALID x.fa: 1 error in 1 code, 0 warnings in 0 codes; 1 of 3 records with errors, 0 with warnings\n"
        'error [fasta.duplicate_identifier] 1 record; first at line 6 column 2, record 3 "seq1": Identifier duplicates an earlier record. First defined at line 1 column 2.\n'
        f"complete: examined {len(DATA)} bytes, 7 lines, 3 records, 38 symbols; nucleotide alphabet chosen from 38 symbols\n"
    )
    assert back["codes"][0]["first"] == {
        "offset": str(DATA.rindex(b">") + 1), "line": "6", "column": "2", "record": "3", "identifier": {"encoding": "utf8", "value": "seq1", "truncated": False, "original_bytes": "4"},
        "related": {"offset": "1", "line": "1", "column": "2", "record": "1"}, "data": {},
    }
    assert [reports.category(c) for c in ("request.sequence_not_found", "index.side_table_empty", "input.changed", "index.nonuniform_fai", "pair.side_table_mismatch", "header.convention_mismatch")] == ["requests", "index_integrity", "source_stability", "index_compatibility", "index_match", "identifiers"]
    assert reports.opaque(b"a\xff" * 200) == {"encoding": "base64", "value": base64.b64encode(b"a\xff" * 128).decode(), "truncated": True, "original_bytes": "400"}
    assert json.loads(reports.failure_json("request.sequence_not_found", "unknown", name=b"x"))["details"]["name"]["value"] == "x"
    with pytest.raises(ValueError, match="pair.total_length_mismatch"):
        stats.check_total(3, 4)


def test_protein_report(spark):
    seqs = spark.createDataFrame([(0, "a", "MKVLE*")], "ordinal long, id string, seq string")
    lengths = stats.length_summary(seqs.withColumn("seq_len", F.length("seq").cast("long"))).first()
    text = reports.stats_text(lengths, stats.composition(seqs).first(), {r.residue: r.n for r in stats.protein_counts(seqs).collect()}, "x.fa", ".fai", 9)
    assert text.startswith("File:\n  path: x.fa\n  index: x.fa.fai\n  size_bytes: 9\n") and "  m_methionine: 1 16.67%\n" in text and "  stop: 1 16.67%\n" in text


def test_fai_index(spark, tmp_path, source, lines):
    (tmp_path / "x.fa.fai").write_text("seq1\t24\t8\t12\t13\textra\n\nseq2\t12\t40\t12\t13\nseq1\t2\t59\t2\t3\n")
    idx = store.open_index(spark, source)
    assert [(r.ordinal, r.id, r.seq_len) for r in idx.orderBy("ordinal").collect()] == [(0, "seq1", 24), (1, "seq2", 12), (2, "seq1", 2)]
    assert validate.compare_index(records.index(lines), idx).count() == 0
    for row, code in (("a\t1\t2", "field_missing"), ("a\t1\tx\t3\t4", "invalid_integer"), ("a\t1\t99999999999999999999\t3\t4", "integer_out_of_range"), ("a\t0\t5\t1\t2", "zero_sequence"), ("a\t1\t5\t3\t2", "invalid_line_geometry")):
        (tmp_path / "y.fai").write_text(row + "\n")
        assert code in records.read_fai(spark, str(tmp_path / "y.fai")).first().error


def test_streamed_requests(spark, tmp_path, lines):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bed").write_text("seq1\t0\t5\nnone\t1\t2\n# note\nseq2\t2\t99\n")
    stream = spark.readStream.text(str(tmp_path / "in"))
    idx = records.index(lines).select("id", "ordinal", "seq_len")
    query = streaming.resolve_bed(stream, idx).writeStream.format("memory").queryName("resolved").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    got = sorted((r.name, r.from_base, r.to_base, r.error) for r in spark.table("resolved").collect())
    assert got == [("none", None, None, "request.sequence_not_found"), ("seq1", 0, 5, None), ("seq2", 2, 12, None)]


def test_positional_reads(spark, tmp_path):
    """Seeks give what the whole sequences give, in uniform records and in others, and raise where the file isn't the index's."""
    long = "ACGTN" * 30_000
    even = "\n".join(long[k : k + 70] for k in range(0, len(long), 70))
    odd = "\r\n\n".join(long[k : k + 61 + k % 3] for k in range(0, len(long), 64))
    (tmp_path / "fa").mkdir()
    (tmp_path / "fa" / "a.fa").write_text(f">even\n{even}\n>odd\n{odd}")
    (tmp_path / "fa" / "b.fa").write_text(">last\nAC GT\n\nA\n")
    (tmp_path / "fa" / "_SUCCESS").write_text("no header\n")
    source = str(tmp_path / "fa")
    lines = records.assign_records(records.line_facts(read_lines(spark, source, split_bytes=50_000)))
    store.write_index(records.across_files(records.index(lines)), source, source + ".zidx", records.side_table(lines))
    idx, sides = store.open_index(spark, source), store.open_sides(spark, source + ".zidx")
    assert [(r.id, r.ordinal, r.uniform) for r in idx.orderBy("ordinal").collect()] == [("even", 0, True), ("odd", 1, False), ("last", 2, False)]
    tokens = ["even", "even:65530-65545", "odd:1-1", "odd:65536-140000", "last", "last:2-4", "even:149999-", "odd"]
    asks = requests.named_regions(spark, tokens)
    sequences = records.read_records(lines).join(idx.select("file", "record", "ordinal"), ["file", "record"]).select("ordinal", F.col("sequence").alias("seq"))
    want = sorted(store.get(idx, sequences, asks).collect())
    assert sorted(store.get(idx, None, asks, sides=sides).collect()) == want and len(want) == len(tokens)
    with pytest.raises(Exception, match="index.side_table_empty"):
        store.get(idx, None, asks).collect()
    found = extract.resolve(extract.lookup(asks, idx))
    with pytest.raises(Exception, match="sequence_span_out_of_bounds"):
        spans.disk_spans(found, sides, 1000).collect()
    (tmp_path / "fa" / "a.fa").write_text(f">even but longer\n{even}\n")
    with pytest.raises(Exception, match="pair.region_length_mismatch"):
        store.get(idx, None, requests.named_regions(spark, ["even:1-60"]), sides=sides).collect()


def test_limits_of_named_regions(spark):
    with pytest.raises(ValueError, match="usage.missing_argument"):
        requests.named_regions(spark, [])
    with pytest.raises(ValueError, match="resource.capacity_limit_exceeded"):
        requests.named_regions(spark, ["a"] * 1025)


def test_damaged_side_tables(spark, tmp_path, monkeypatch):
    """Opening an index raises at the first line of a side table that can't be, whatever spans its lines are dealt to."""
    source = str(tmp_path / "x.fa")
    with open(source, "w") as f:
        f.write(">a\n" + "".join("ACGT" * (k % 3 + 1) + "\n" for k in range(30)) + ">b\nAC\n")
    lines = records.assign_records(records.line_facts(read_lines(spark, source, split_bytes=50))).cache()
    idx, sides = records.index(lines).cache(), records.side_table(lines).cache()
    assert store.integrity(idx, source, sides).count() == 0 and sides.count() == 30
    assert [r.error for r in store.integrity(idx, source).collect()] == ["index.side_table_empty"]
    cases = [  # the line at a base_start, what is wrong with it, and what is found
        (28, "base_start", "base_start + 1", "side_base_start_mismatch", 5, 29, 28), (24, "line_bytes", "3", "side_line_geometry_invalid", 4, 3, 4),
        (24, "byte_offset", "9999", "sequence_span_out_of_bounds", 4, 10004, os.path.getsize(source)), (0, "byte_offset", "4", "side_first_offset_mismatch", 1, 4, 3),
        (24, "byte_offset", "byte_offset - 1", "side_line_order_invalid", 4, 29, 30), (228, "line_bases", "9", "side_sequence_length_mismatch", None, 237, 240),
    ]
    monkeypatch.setattr(store, "SPAN", 16)
    for at, column, then, *want in cases:
        bad = sides.withColumn(column, F.expr(f"case when base_start = {at} then {then} else {column} end").cast("long"))
        assert [(r.error, r.entry, r.value, r.limit) for r in store.integrity(idx, source, bad).collect()] == [("index." + want[0], *want[1:])], column
    store.write_index(idx, source, source + ".zidx", sides.where("base_start > 0"))
    with pytest.raises(ValueError, match="index.side_base_start_mismatch: a, line 1 of its side table: 4, 0"):
        store.open_index(spark, source)
    assert store.open_index(spark, source, check=False).count() == 2


def test_comparison_with_side_tables(spark, tmp_path):
    def read(name, text):
        (tmp_path / name).write_text(text)
        lines = records.assign_records(records.line_facts(read_lines(spark, str(tmp_path / name)))).cache()
        return records.index(lines).cache(), records.side_table(lines).cache()

    one = read("x.fa", ">a\nAC\nACG\nA\n>b\nAC\n>a\nACGT\n>c\nA\nAC\n")
    two = read("y.fa", ">a\nAC\nAC\nAC\n>b\nAC\n>c\nA\nAC\n>d\nA\n")
    three = read("z.fa", ">a\nAC\nACG\nA\n>b\nAC\n>c\nA\nAC\nA\n")
    found = lambda a, b: sorted((r.id, r.occurrence, r.code, r.line) for r in validate.compare_index(a[0], b[0], a[1], b[1]).collect())
    assert found(one, one) == []
    assert found(one, two) == [("a", 1, "pair.line_geometry_mismatch", None), ("c", 1, "pair.sequence_offset_mismatch", None), ("c", 1, "pair.side_table_mismatch", 1), ("d", 1, "pair.record_missing_from_fasta", None)]
    assert ("c", 1, "pair.side_table_mismatch", 1) in found(one, three) and ("c", 1, "pair.sequence_length_mismatch", None) in found(one, three)
    moved = one[1].withColumn("byte_offset", F.expr("case when base_start = 2 then byte_offset + 1 else byte_offset end"))
    assert found(one, (one[0], moved)) == [("a", 1, "pair.side_table_mismatch", 2)]
    assert found(one, (one[0], one[1].where("base_start < 5"))) == [("a", 1, "pair.side_table_mismatch", 3)]
    assert validate.compared(one[0], two[0]).first().asDict() == {"entries": 4, "matched": 3, "omitted_duplicates": 1}


REPORTS = [
    (b">empty_rec\n", {}, ["WARNINGS in: 0 errors in 0 codes, 1 warning in 1 code; 0 of 1 record with errors, 1 with warnings", 'warning [fasta.empty_record] 1 record; first at line 1 column 1, record 1 "empty_rec": FASTA record contains no sequence symbols.', "complete: examined 11 bytes, 1 line, 1 record, 0 symbols; nucleotide alphabet chosen from 0 symbols"]),
    (b"not FASTA\n", {}, ["INVALID in: 2 errors in 2 codes, 0 warnings in 0 codes; 0 of 0 records with errors, 0 with warnings", "error [fasta.no_records]: No FASTA records were found.", "error [fasta.content_before_header] 1 line; first at line 1 column 1: Content appears before the first FASTA header. content_bytes=9", "complete: examined 10 bytes, 1 line, 0 records, 0 symbols; nucleotide alphabet chosen from 0 symbols"]),
    (b">a\x01\nA\x00?\nACG", {"alphabet": "dna"}, ["INVALID in: 3 errors in 3 codes, 2 warnings in 2 codes; 1 of 1 record with errors, 1 with warnings", 'error [fasta.header_control_byte] 1 byte in 1 record; first at line 1 column 3, record 1 "a\\x01": Header contains a prohibited control byte. byte=0x01 grammar=controls_except_tab', 'error [fasta.sequence_control_byte] 1 byte in 1 record; first at line 2 column 2, record 1 "a\\x01": Sequence contains a prohibited control byte. byte=0x00 grammar=controls_except_tab', 'error [sequence.invalid_symbol] 1 byte in 1 record; first at line 2 column 3, record 1 "a\\x01": Sequence byte is outside the selected alphabet. byte=0x3f', 'warning [format.inconsistent_wrapping] 1 record; first at line 3 column 1, record 1 "a\\x01": Sequence line width differs from the record\'s wrap width. expected_width=2 actual_width=3', "warning [format.missing_terminal_newline] at line 3 column 4: Nonempty file has no terminal newline.", "complete: examined 11 bytes, 3 lines, 1 record, 5 symbols; dna alphabet"]),
    (b">ab\nAC\n>" + b"x" * 40 + b"\nAC\n>ab\nAC\n", {"name_budget": 41, "long_header": 30}, ["INCOMPLETE in: 0 errors in 0 codes, 1 warning in 1 code; 0 of 3 records with errors, 1 with warnings", 'warning [fasta.long_header] 1 record; first at line 3 column 1, record 2 "' + "x" * 32 + '" (40 bytes): Header exceeds the selected length limit. observed_bytes=40 limit_bytes=30', "incomplete: examined 59 bytes, 6 lines, 3 records, 6 symbols; nucleotide alphabet chosen from 6 symbols; duplicate check stopped at record 2 at its 41-byte name budget"]),
]


@pytest.mark.parametrize("data, options, want", REPORTS)
def test_report_text(spark, tmp_path, data, options, want):
    (tmp_path / "x.fa").write_bytes(data)
    lines = records.assign_records(records.line_facts(read_lines(spark, str(tmp_path / "x.fa")))).cache()
    report = reports.validation(lines, **options)
    assert reports.validation_text(report, "in").splitlines() == want
    assert json.loads(reports.validation_json(report))["outcome"] == want[0].split(" ")[0].lower().replace("ok", "clean")


def test_committed_text(spark, tmp_path, source):
    """A folder of ordered parts appears as a whole; nothing is left of a write that fails or whose source changes."""
    rows = spark.range(2000, numPartitions=5).withColumn("value", F.concat(F.lit("v"), F.col("id")))
    out = tmp_path / "out"
    text = lambda: "".join((out / p).read_text() for p in sorted(os.listdir(out)) if p.startswith("part-"))
    store.write_text(rows.repartition(7), str(out), "id", source=source)
    assert text() == "".join(f"v{k}\n" for k in range(2000)) and (out / "_SUCCESS").exists()
    with pytest.raises(Exception, match="io.create_failed"):
        store.write_text(rows, str(out), "id")
    store.write_text(rows.limit(3), str(out), "id", overwrite=True)
    assert text() == "v0\nv1\nv2\n"
    for bad in (source, f"{tmp_path}/./x.fa", str(tmp_path)):
        with pytest.raises(Exception, match="output_is_input"):
            store.write_text(rows, bad, "id", source=source, overwrite=True)
    failing = rows.withColumn("value", F.when(F.col("id") == 1500, F.raise_error(F.lit("broken"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        store.write_text(failing, str(out), source=source, overwrite=True)

    def touch(frames):
        for frame in frames:
            with open(source, "ab") as f:
                f.write(b"A")
            yield frame

    with pytest.raises(Exception, match="input.changed"):
        store.write_text(rows.limit(9).mapInPandas(touch, rows.schema), str(out), source=source, overwrite=True)
    assert text() == "v0\nv1\nv2\n" and sorted(p for p in os.listdir(tmp_path) if "out" in p) == ["out"]
    with pytest.raises(ValueError, match="output_is_input"):
        store.write_index(rows, source, source)


def test_named_rows_skip_ranges(spark, tmp_path, source):
    """A stored index is read only in the ranges of ids that are asked for, and many names are joined."""
    rows = spark.range(40000).select(F.format_string("id%06d", F.col("id") * 7919 % 40000).alias("id"), F.col("id").alias("ordinal"), F.lit(1).alias("seq_len"))
    store.write_index(rows, source, str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i" / "rows"))
    asks = spark.createDataFrame([("id000003",), ("id000009",), ("none",), ("id000003",)], "name string")
    got = store.named(index, asks)
    assert sorted(r.id for r in got.collect()) == ["id000003", "id000009"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id" in plan or "PushedFilters: [Or" in plan
    many = rows.where("ordinal < 3000").select(F.col("id").alias("name"))
    assert store.named(index, many).count() == 3000
    assert store.named(index, asks.limit(0)).count() == 0
