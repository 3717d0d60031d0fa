import random

import pytest
from pyspark.sql import functions as F

from seqlake.functions import complement, description, fixed, identifier, orient, wrap
from seqlake.operators import extract, records, requests, stats, validate
from seqlake.sources.fasta import owned_lines, read_lines

SIMPLE = b">seq1 test sequence\nACGTACGTACGT\nACGTACGTACGT\n>seq2 another sequence\nGGGGCCCCAAAA\n"


@pytest.fixture
def lines(spark, tmp_path):
    def make(data: bytes, split: int = 1 << 20):
        path = tmp_path / f"{random.random()}.fa"
        path.write_bytes(data)
        return records.assign_records(records.line_facts(read_lines(spark, str(path), split_bytes=split))).cache()

    return make


def test_split_ownership(tmp_path):
    rnd = random.Random(1)
    for _ in range(300):
        data = bytes(rnd.choice(b">A\n\r ") for _ in range(rnd.randint(0, 40)))
        (tmp_path / "x").write_bytes(data)
        with open(tmp_path / "x", "rb") as f:
            whole = list(owned_lines(f, 0, len(data)))
            size = rnd.randint(1, 9)
            assert [x for a in range(0, len(data), size) for x in owned_lines(f, a, min(len(data), a + size))] == whole
        assert b"".join(raw + (b"", b"\n", b"\r\n")[t] for _, raw, t in whole) == data


def test_results_do_not_depend_on_split_size(lines):
    data = b">a x\nAC GT\r\n\nAC\n>b\n>c\nACGT\nAC\nACG\n>d\r\nAAA\r\nAA"
    columns = ["line_offset", "record", "line_no", "header_offset", "bases"]
    rows = [sorted(map(tuple, lines(data, k).select(*columns).collect())) for k in (3, 11, 1000)]
    assert rows[0] == rows[1] == rows[2]


def test_gzip_is_refused(spark, tmp_path):
    (tmp_path / "x.gz").write_bytes(b"\x1f\x8b123")
    with pytest.raises(Exception, match="input.unsupported_format"):
        read_lines(spark, str(tmp_path / "x.gz")).collect()


def test_index_and_fai(lines):
    idx = records.index(lines(SIMPLE))
    assert [r.value for r in records.fai_rows(idx).orderBy("record").collect()] == ["seq1\t24\t20\t12\t13", "seq2\t12\t69\t12\t13"]
    dup = records.index(lines(b">dup\nAAAA\n>other\nCCCC\n>dup\nGGGG\n>also\nTTTT\n", 5))
    assert [r.value for r in records.fai_rows(dup).orderBy("record").collect()] == ["dup\t4\t5\t4\t5", "other\t4\t17\t4\t5", "dup\t4\t27\t4\t5", "also\t4\t38\t4\t5"]
    assert extract.first_of_each(dup.select("ordinal", "id", "seq_offset")).where("id = 'dup'").first().seq_offset == 5
    with pytest.raises(ValueError, match="initial_header_required"):
        records.index(lines(b"not fasta\n"))


@pytest.mark.parametrize(
    "body, expected",
    [
        (b">x\nAAAACCCCGGGG\nTTTTAAAACCCC\nGGGGTTTT\n", (32, 12, 13, True, None)),
        (b">x\nAAAACCCCGGGG\nTTTTAA\nAACCCCGGGGTT\nTT\n", (32, 12, 13, False, "interior_short_line")),
        (b">x\nAAAACCCC    \nGGGGTTTT\t\nCCCCAAAA\n", (24, 8, 13, False, "sequence_whitespace")),
        (b">x\nAAAACCCC\n\nGGGG\n\nTTTTAAAA\n", (20, 8, 9, False, "interior_blank_line")),
        (b">x\r\nAAAACCCC\r\nGGGGTT\nTTAAAA\r\n", (20, 8, 10, False, "interior_short_line")),
        (b">x\r\nACGT\r\n", (4, 4, 6, True, None)),
        (b">x\n\nACGT\nACGT\n\n", (8, 4, 5, True, None)),
        (b">x\nACGT\nACGTA\n", (9, 4, 5, False, "wider_line")),
        (b">x\nACGT", (4, 4, 5, True, None)),
    ],
)
def test_layout(lines, body, expected):
    row = records.layout(lines(body, 6)).select("seq_len", "line_bases", "line_bytes", "uniform", "reason").first()
    assert tuple(row) == expected


def test_side_table(lines):
    rows = records.side_table(lines(b">x\nAAAA\nCC\nGGG\n")).orderBy("base_start").drop("file", "record").collect()
    assert [tuple(r) for r in rows] == [(0, 3, 5, 4), (4, 8, 3, 2), (6, 11, 4, 3)]


def test_read_records(lines):
    rows = records.read_records(lines(b">a  two words \r\nAC GT\r\n>b\n>a\nA>C\n", 4)).orderBy("record").collect()
    assert [(r.id, r.description, r.sequence) for r in rows] == [("a", "two words", "ACGT"), ("a", "", "A>C")]


def test_fai_reader(spark, tmp_path):
    (tmp_path / "x.fai").write_text("a\t4\t6\t4\t5\textra\n\nb\t04\t6\t0\t5\nc\t+4\t6\t4\t5\n")
    rows = {r.id: r for r in records.read_fai(spark, str(tmp_path / "x.fai")).collect()}
    assert (rows["a"].seq_len, rows["a"].error) == (4, None)
    assert rows["b"].error == "index.invalid_line_geometry" and rows["c"].error == "index.fai.invalid_integer"


def test_length_buckets_keep_the_order(spark):
    of = [*range(1, 300), *(2**k + d for k in range(9, 63) for d in (-1, 0, 1)), 2**63 - 1]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in of], "x long").select(stats.bucket(F.col("x"))).collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] < 64 * 64
    lengths = [int(2 ** (k * 7 % 31 + k % 64 / 64)) for k in range(400)] + [70, 70, 2**40]
    row = stats.length_summary(spark.createDataFrame([(k, f"r{k}", v) for k, v in enumerate(lengths)], "ordinal long, id string, seq_len long")).first()
    down, total = sorted(lengths, reverse=True), sum(lengths)
    for p, n, rank in ((50, row.n50, row.l50), (90, row.n90, row.l90)):
        assert down[rank - 1] == n and sum(down[:rank]) * 100 >= total * p > sum(down[: rank - 1]) * 100
    assert (row.records, row.total, row.median, row.longest_name) == (403, total, down[201], "r402")


def test_length_summary(spark, lines):
    row = stats.length_summary(records.index(lines(SIMPLE))).first()
    assert (row.records, row.total, row.mean, row.shortest_name, row.longest_name, row.q1, row.median, row.q3, row.n50, row.l50, row.n90, row.l90, row.aun) == (2, 36, 18, "seq2", "seq1", 12, 18, 24, 24, 1, 12, 2, "20.00")
    rnd = random.Random(2)
    for n in (1, 2, 3, 8, 41):
        x = [rnd.randint(1, 9) for _ in range(n)]
        got = stats.length_summary(spark.createDataFrame([(k, f"r{k}", v) for k, v in enumerate(x)], "ordinal long, id string, seq_len long")).first()
        s, total = sorted(x), sum(x)
        mid = lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) // 2
        assert (got.median, got.q1, got.q3) == (mid(s), mid(s[: n // 2] or s), mid(s[(n + 1) // 2 :] or s))
        for p, nx, lx in ((50, got.n50, got.l50), (90, got.n90, got.l90)):
            cum, want = 0, None
            for k, v in enumerate(reversed(s), 1):
                cum += v
                if cum * 100 >= total * p:
                    want = (v, k)
                    break
            assert (nx, lx) == want
        assert got.shortest_name == f"r{x.index(min(x))}" and got.longest_name == f"r{x.index(max(x))}"
    assert stats.length_summary(spark.createDataFrame([], "ordinal long, id string, seq_len long")).first().records == 0


def test_composition(spark):
    def of(s):
        return stats.composition(spark.createDataFrame([(s,)], "seq string")).first()

    x = of("acgtuACGTURYSWKMBDHVN?")
    assert (x.type, x.ambiguous, x.invalid, x.gc, x.lowercase) == ("nucleotide_mixed_tu", 10, 1, "40.00", 5)
    assert (of("ACcuUU").type, of("ACcuUU").gc, of("ACcuUU").gc_skew) == ("nucleotide_u", "33.33", "-1.000")
    assert (of("RYSWKMBDHVNN").gc, of("RYSWKMBDHVNN").gc_skew, of("MVLSPE").type) == ("n/a", "n/a", "protein")
    counts = {r.residue: r.n for r in stats.protein_counts(spark.createDataFrame([("ARNDCEQGHILKMFPSTWYVBZJXUOar*?",)], "seq string")).collect()}
    assert counts["A"] == 2 and counts["stop"] == 1 and counts["invalid"] == 1 and all(counts[x] >= 1 for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def test_fixed(spark):
    rows = [(1, 32, 2, "0.03"), (2, 3, 2, "0.67"), (-15, 16, 3, "-0.938"), (-1, 9999, 3, "0.000"), (5, 0, 2, "n/a"), (1, 200, 2, "0.01"), (499999999, 100000000000, 2, "0.00")]
    for n, d, k, want in rows:
        assert spark.range(1).select(fixed(F.lit(n), F.lit(d), k)).first()[0] == want


def test_strings(spark):
    df = spark.createDataFrame([("seq1 test  x \r", "ACGTA")], "h string, s string")
    row = df.select(identifier(F.col("h")), description(F.col("h")), complement(F.col("s")), orient(F.col("s"), F.lit(True), F.lit(True)), orient(F.col("s"), F.lit(True), F.lit(False)), wrap(F.col("s"), 2)).first()
    assert tuple(row) == ("seq1", "test  x", "TGCAT", "TACGT", "ATGCA", "AC\nGT\nA")


def test_regions(spark):
    tokens = ["seq1:1-9999", "seq1:13-", ":1-2", "name:1-2:bad", "name:18446744073709551616-1", "a:b:3-4", "x"]
    rows = requests.parse_regions(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()
    got = [(r.name, r.start and int(r.start), r.end and int(r.end), r.is_full) for r in rows]
    assert got == [("seq1", 1, 9999, False), ("seq1", 13, None, False), ("", 1, 2, False), ("name:1-2:bad", None, None, True), ("name:18446744073709551616-1", None, None, True), ("a:b", 3, 4, False), ("x", None, None, True)]


def test_bed_and_names(spark):
    text = ["a\t0\t5\tn\t0\t-", "#x", "", "track", "track name", "browser x", "track1\t1\t2", "b\t1", "b\t+1\t2", "b\t 1\t2", "b\t5\t5", "b\t1\t99999999999999999999999", "c\t0\t2\t.\t.\t?"]
    rows = requests.parse_bed(spark.createDataFrame([(t,) for t in text], "value string"), stranded=True).collect()
    assert [(r.name, r.error) for r in rows] == [
        ("a", None), ("track1", None), ("b", "request.bed.field_missing"), ("b", "request.bed.invalid_coordinate"), ("b", "request.bed.invalid_coordinate"),
        ("b", "request.bed.invalid_interval"), ("b", "request.bed.coordinate_out_of_range"), ("c", "request.bed.invalid_strand"),
    ]
    assert (int(rows[0].start), int(rows[0].end), rows[0].reverse) == (1, 5, True)
    names = requests.parse_names(spark.createDataFrame([(t,) for t in ("a", "", "#b", " c \r", "d\r")], "value string")).collect()
    assert [r.name for r in names] == ["a", " c ", "d"]


def test_extract_in_chunks(spark):
    seq = "ACGTTGCAAC" * 7
    seqs = spark.createDataFrame([(0, "s", seq), (1, "s", "TTTT"), (2, "p", "MVLSPE")], "ordinal long, id string, seq string")
    index = seqs.select("ordinal", "id", F.length("seq").cast("long").alias("seq_len"))
    tokens = ["s:1-5", "s:4-33", "s:65-9999", "s", "s:70-", "q", "s:71-72", "s:5-4", "s:0-4"]
    asks = requests.parse_regions(spark.createDataFrame(list(enumerate(tokens)), "request long, token string"))
    found = extract.extract(extract.resolve(extract.lookup(asks, index)), extract.chunks(seqs, 8), 8)
    got = {r.request: r for r in found.collect()}
    assert [got[k].bases for k in range(5)] == [seq[:5], seq[3:33], seq[64:], seq, seq[69:]]
    assert (got[2].display_end, got[2].to_base) == (9999, 70)
    assert [got[k].error for k in range(5, 9)] == ["request.sequence_not_found", "request.start_after_sequence", "request.end_before_start", "request.start_before_one"]
    with pytest.raises(ValueError, match="request 5"):
        extract.first_error(found)
    text = extract.fasta_text(found.where("request = 1").withColumns({"reverse": F.lit(True), "complement": F.lit(True)}), 10, annotate=True).first().value
    assert text.startswith(">s:4-33 (reverse complement)\n") and text.count("\n") == 3
    guard = extract.oriented(spark.createDataFrame([("MVLSPEFL", None, False, True), ("ACGT", None, True, True)], "bases string, error string, reverse boolean, complement boolean")).collect()
    assert guard[0].error == "transform.complement_on_protein" and guard[1].bases == "ACGT"


def test_index_without_symbols(spark, tmp_path):
    """An index and its side tables need no more of the lines than their outline."""
    rows = [("a", 0, b">x one", 1), ("a", 7, b"ACGT", 1), ("a", 12, b"AC GT", 2), ("a", 19, b"", 1), ("a", 20, b"A", 1), ("a", 22, b">y", 1), ("a", 25, b"ACG", 1), ("a", 29, b"ACG", 1), ("a", 33, b"A", 0)]
    facts = records.line_facts(spark.createDataFrame([(f, 0, at, bytearray(x), n) for f, at, x, n in rows], "file string, split long, line_offset long, raw binary, term int"))
    whole, outline = records.assign_records(facts), records.assign_records(records.outline(facts))
    assert {r.content for r in outline.collect() if not r.is_header} == {None} and outline.columns == whole.columns
    for made in (records.index, records.side_table):
        assert sorted(map(repr, made(outline).collect())) == sorted(map(repr, made(whole).collect()))
    assert records.index(outline).count() == 2 and records.side_table(outline).count() == 3


def test_extract_sends_no_symbols_for_a_request(spark, capsys):
    """Many requests for the same symbols, of one chunk or several, and symbols that are missing."""
    seqs = [(0, "s", "ACGTTGCAAC" * 7), (1, "t", "TTTTACGT"), (2, "u", "")]
    table = spark.createDataFrame(seqs, "ordinal long, id string, seq string")
    index = spark.createDataFrame([(0, "s", 70), (1, "t", 8), (3, "gone", 9)], "ordinal long, id string, seq_len long")
    tokens = ["s", "s:2-", "t", "t:1-8", "t:8-8", "s:8-9", "s:9-16", "s:16-17", "gone", "gone:1-3", "no", "no:3-", "s:99-"] * 20
    asks = requests.parse_regions(spark.createDataFrame(list(enumerate(tokens)), "request long, token string"))
    found = extract.extract(extract.resolve(extract.lookup(asks, index)), extract.chunks(table, 8), 8)
    found.explain()
    assert "hashpartitioning(request" not in capsys.readouterr().out
    got = {r.request: r for r in found.collect()}
    assert len(got) == found.count() == len(tokens)
    for k, token in enumerate(tokens):
        r, seq = got[k], dict(x[1:] for x in seqs).get(token.split(":")[0])
        want = None if r.error or seq is None else seq[r.from_base : r.to_base]
        assert (r.bases, r.error is None) == (want, token.split(":")[0] != "no" and token != "s:99-"), token


def summary(found):
    return {r.code: (r.occurrences, r.records, r.first_offset) for r in validate.by_code(found).collect()}


def test_findings(lines):
    got = summary(validate.findings(lines(b"\xef\xbb\xbf>a desc\r\nAC GT\r\nACG\n\nTTTTTT\t\n>b\n>c\nAC?", 5)))
    assert got == {
        "format.sequence_whitespace": (2, 1, 14), "format.blank_sequence_line": (1, 1, 23), "format.inconsistent_wrapping": (1, 1, 19), "fasta.empty_record": (1, 1, 32), "format.leading_bom": (1, 0, 0),
        "format.missing_terminal_newline": (1, 0, 41), "format.mixed_line_endings": (1, 0, 22), "sequence.invalid_symbol": (1, 1, 40),
    }
    got = summary(validate.findings(lines(b"junk\n>a\x01\nA\x00C\n>\nAC\n>a\nAC\n"), "dna"))
    assert got["fasta.content_before_header"][0] == got["fasta.header_control_byte"][0] == got["fasta.sequence_control_byte"][0] == got["fasta.empty_identifier"][0] == 1
    assert summary(validate.findings(lines(b">a\nAC\n>b\nAC\n>a\nAC\n>a\nAC\n"), "dna")) == {"fasta.duplicate_identifier": (2, 2, 13)}
    clean = validate.by_code(validate.findings(lines(SIMPLE)))
    assert clean.count() == 0 and validate.outcome(clean).first().status == 0


def placed(lines, *args):
    """code: occurrences, records, offset, line, column and record of the first finding, its identifier."""
    rows = validate.places(validate.findings(lines, *args), lines).collect()
    return {r.code: (r.occurrences, r.records, r.offset, r.line, r.column, r.record, r.identifier) for r in rows}, {r.code: r for r in rows}


@pytest.mark.parametrize("split", [25])
def test_places(lines, split):
    got, rows = placed(lines(b"\xef\xbb\xbfjunk\n>a desc\nACGT\n>a\x01x\r\n>a\nAC\n>\n>NC_1 a long description\nACGT", split), "auto", "refseq", 20)
    assert got == {
        "fasta.content_before_header": (1, 0, 3, 1, 4, None, None), "fasta.header_control_byte": (1, 1, 23, 4, 3, 2, "a\x01x"), "fasta.empty_record": (2, 2, 21, 4, 1, 2, "a\x01x"),
        "fasta.empty_identifier": (1, 1, 34, 7, 2, 4, ""), "fasta.duplicate_identifier": (1, 1, 28, 5, 2, 3, "a"), "fasta.long_header": (1, 1, 35, 8, 1, 5, "NC_1"),
        "header.convention_mismatch": (4, 4, 8, 2, 1, 1, "a"), "format.leading_bom": (1, 0, 0, 1, 1, None, None), "format.missing_terminal_newline": (1, 0, 64, 9, 5, None, None),
        "format.mixed_line_endings": (1, 0, 25, 4, 5, None, None),
    }
    assert tuple(rows["fasta.duplicate_identifier"].related) == (9, 2, 2, 1)
    assert rows["fasta.header_control_byte"].data == {"byte": 1} and rows["fasta.long_header"].data == {"observed_bytes": 23, "limit_bytes": 20} and rows["fasta.content_before_header"].data == {"content_bytes": 4}
    got, rows = placed(lines(b">s1\nACGTACGT\nAC GT\tAC\n\nAC?G\x00T\n>s2\nACGTACGT\nACGTACGTAC\n  \nA*\x7f\n", split))
    assert got == {
        "fasta.sequence_control_byte": (1, 1, 27, 5, 5, 1, "s1"), "sequence.invalid_symbol": (3, 2, 25, 5, 3, 1, "s1"), "format.sequence_whitespace": (2, 2, 15, 3, 3, 1, "s1"),
        "format.blank_sequence_line": (1, 1, 22, 4, 1, 1, "s1"), "format.inconsistent_wrapping": (2, 2, 13, 3, 1, 1, "s1"),
    }
    assert rows["format.sequence_whitespace"].data == {"whitespace_bytes": 2} and rows["format.inconsistent_wrapping"].data == {"expected_width": 8, "actual_width": 6} and rows["sequence.invalid_symbol"].data == {"byte": 63}
    assert placed(lines(b"  \n", split))[0] == {"fasta.no_records": (1, 0, None, None, None, None, None)}


def test_alphabet_by_file(spark, tmp_path):
    """Each file's own sample chooses its alphabet, whatever the files beside it hold."""
    for name, data in (("a.fa", b">n\nACGTACGTACGTACGTACGTE\nACGT?\n"), ("b.fa", b">p\nMKVLEEFPQ*J1\n"), ("c.fa", b">none\n")):
        (tmp_path / name).write_bytes(data)
    rows = records.assign_records(records.line_facts(read_lines(spark, str(tmp_path), split_bytes=11))).cache()
    assert [(r.file[-4:], r.alphabet, r.symbols) for r in validate.sampled_files(rows).orderBy("file").collect()] == [("a.fa", "nucleotide", 26), ("b.fa", "protein", 12), ("c.fa", "nucleotide", 0)]
    found = validate.findings(rows).where("code = 'sequence.invalid_symbol'").orderBy("file", "offset").collect()
    assert [(r.file[-4:], r.offset, r.n, r.data) for r in found] == [("a.fa", 23, 1, {"byte": ord("E")}), ("a.fa", 29, 1, {"byte": ord("?")}), ("b.fa", 14, 1, {"byte": ord("1")})]
    assert {r.byte: r.n for r in validate.invalid_symbols(rows).collect()} == {ord("E"): 1, ord("?"): 1, ord("1"): 1}


def test_places_of_long_identifiers(lines):
    _, rows = placed(lines(b"\xef\xbb\xbf>" + b"x" * 300 + b"\nAC\n>" + b"x" * 300 + b"\nAC\n>" + b"y" * 70000 + b"\nAC\n"), "any")
    twice, long = rows["fasta.duplicate_identifier"], rows["fasta.identifier_too_long"]
    assert (tuple(twice.related), twice.identifier, twice.identifier_bytes) == ((4, 1, 5, 1), "x" * 256, 300)
    assert (long.record, long.identifier_bytes, long.data) == (3, 70000, {"observed_bytes": 70000, "limit_bytes": 65535})


def test_conventions(spark):
    ids = spark.createDataFrame([("sp|P1|X",), ("tr||X",), ("db|P|",), ("NC_1",), ("AB_1",)], "id string")
    assert [tuple(r) for r in ids.select(validate.convention("uniprot"), validate.convention("refseq")).collect()] == [(True, False), (False, False), (False, False), (False, True), (False, False)]


def test_repair(lines):
    data = b"\xef\xbb\xbf>a desc\r\nAC GT\r\nACG\n\nTTTTTT\t\n>b\n>c\nAC?"
    text = "\n".join(r.value for r in validate.repaired(lines(data, 7), 4).orderBy("record", "chunk").collect()) + "\n"
    assert text == ">a desc\nACGT\nACGT\nTTTT\nT\n>b\n>c\nAC?\n"
    again = lines(text.encode())
    assert "\n".join(r.value for r in validate.repaired(again, 4).orderBy("record", "chunk").collect()) + "\n" == text
    assert not [c for c in summary(validate.findings(again, "any")) if c.startswith("format.")]
    for bad in (b"junk\n>a\nAC\n", b">a\x01\nAC\n", b">a\nA\x00C\n", b"  \n"):
        with pytest.raises(ValueError, match="repair.blocked"):
            validate.repaired(lines(bad))


def test_compare_index(lines):
    a, b = records.index(lines(b">a\nACGT\n>b\nAC\n>a\nACG\n")), records.index(lines(b">a\nACGT\n>b\nACG\n>c\nAC\n"))
    got = {(r.id, r.occurrence, r.code) for r in validate.compare_index(a, b).collect()}
    assert got == {("b", 1, "pair.sequence_length_mismatch"), ("b", 1, "pair.line_geometry_mismatch"), ("c", 1, "pair.record_missing_from_fasta")}


def test_chunks_of_any_record(lines):
    """Records larger than a split, cut where chunks meet, repaired and read back."""
    rnd = random.Random(3)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(n)) for n in (1, 700, 16, 0, 333)]
    data = b"".join(b">s%d\n" % k + b"".join(s[a : a + w].encode() + b" \n" for a in range(0, len(s), w)) for (k, s), w in zip(enumerate(seqs), (5, 7, 8, 1, 50)))
    some = lines(data, 256)
    got = {}
    for r in records.chunks(some, 16).orderBy("record", "chunk").collect():
        assert len(r.bases) <= 16 and r.chunk == len(got.get(r.record, "")) // 16
        got[r.record] = got.get(r.record, "") + r.bases
    assert got == {k + 1: s for k, s in enumerate(seqs) if s}
    starts = {(r.record, r.base_start) for r in records.positions(some).where("bases > 0").collect()}
    assert starts == {(k + 1, a) for (k, s), w in zip(enumerate(seqs), (5, 7, 8, 1, 50)) for a in range(0, len(s), w)}
    text = "\n".join(r.value for r in validate.repaired(some, 4).orderBy("record", "chunk").collect())
    assert text == "\n".join(f">s{k}" + "".join("\n" + s[a : a + 4] for a in range(0, len(s), 4)) for k, s in enumerate(seqs))


def test_every_rule(lines):
    """A data set on which all rules of a report find something."""
    data = b"\xef\xbb\xbfjunk\n>sp|a|b x\x01\r\nAC GT\nAC\x02C#\n\n>\nAC\n>b\n>b\nACG\nACGT\nAC\n>" + b"i" * 70000 + b"\nAC"
    got = summary(validate.findings(lines(data, 40_000), "dna", "uniprot"))
    assert set(got) == set(validate.RULES) - {"fasta.no_records"}
    assert got["sequence.invalid_symbol"][:2] == (1, 1) and got["format.inconsistent_wrapping"][:2] == (1, 1) and got["header.convention_mismatch"][:2] == (4, 4)
    assert {r.byte: r.n for r in validate.invalid_symbols(lines(data, 40_000), "dna").collect()} == {35: 1}
    assert summary(validate.findings(lines(b"\n"), "dna"))["fasta.no_records"][0] == 1


def test_occurrences_over_parts(spark, monkeypatch):
    """A name of many records, numbered in parts of three ordinals, as a plain count of each name does it."""
    monkeypatch.setattr(validate, "PART", 3)
    rows = [(k, "hot" if k % 3 else f"r{k % 7}") for k in range(0, 80, 2)] + [(81, None)]
    index = spark.createDataFrame([(k, i, k, 0, 60, 61, True) for k, i in rows], "ordinal long, id string, seq_len long, seq_offset long, line_bases long, line_bytes long, uniform boolean")
    other = index.where("(ordinal < 40 or id <> 'r1') and ordinal % 8 > 0 and id <> 'r3'")

    def places(rows):
        seen = {}
        for k, i in sorted(rows):
            seen[i] = seen.get(i, 0) + 1
            yield (i, seen[i]), k

    a, b = dict(places(rows)), dict(places([(r.ordinal, r.id) for r in other.collect()]))
    names = {i for i, _ in b}
    want = sorted((str(i), n, a.get((i, n)), b.get((i, n)), (i, n) not in b and i in names) for i, n in a | b)
    got = validate.paired(index, other).collect()
    assert sorted((str(r.id), r.occurrence, r.a and r.a.seq_len, r.b and r.b.seq_len, r.omitted) for r in got) == want
    assert any(w[4] for w in want) and any(w[3] is None and not w[4] for w in want)
