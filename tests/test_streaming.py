import glob

import pytest
from pyspark.sql import functions as F

from seqlake import streaming
from seqlake.operators import extract, records, validate
from seqlake.sources.fasta import read_lines
from seqlake.sources.growing import complete, stream_lines

PARTS = [b"\xef\xbb\xbf>a x\nAC GT\r\nAC", b"GT\nAC\n>b\n", b">a\nA\n>b\r\nACG\n>a\nC", b"G\nTT"]


def run(writer):
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(180)


def test_complete_lines(tmp_path):
    (tmp_path / "x").write_bytes(b"ab\ncd\nef")
    path = str(tmp_path / "x")
    assert [complete(path, n, 0) for n in range(9)] == [0, 0, 0, 3, 3, 3, 6, 6, 6]
    assert complete(path, 8, 6) == 6


def test_growing_file(spark, tmp_path):
    """What a file that grows lands in parts, over restarts, is what a batch reads from it in the end."""
    (tmp_path / "in").mkdir()
    path, out, state = tmp_path / "in" / "x.fa", str(tmp_path / "out"), str(tmp_path / "c")
    seen = []
    for k, part in enumerate(PARTS):
        with open(path, "ab") as f:
            f.write(part)
        run(streaming.land(stream_lines(spark, str(tmp_path / "in"), split_bytes=9, finished=k == len(PARTS) - 1), out, state))
        seen.append(spark.read.parquet(out).count())
    assert seen == [2, 5, 10, 12]
    columns = ["line_offset", "term", "bom", "content", "is_header", "bases", "line_no", "record", "header_offset"]
    batch = records.assign_records(records.line_facts(read_lines(spark, str(tmp_path / "in"), split_bytes=11)))
    assert sorted(map(tuple, streaming.landed(spark, out).select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))
    found = [sorted(map(repr, validate.places(validate.findings(x, "dna"), x).drop("file").collect())) for x in (streaming.landed(spark, out), batch)]
    assert found[0] == found[1] and len(found[0]) >= 6
    path.write_bytes(b">a\n")
    with pytest.raises(Exception, match="input.changed"):
        run(streaming.land(stream_lines(spark, str(tmp_path / "in")), out, state))


def test_duplicates_by_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = tmp_path / "x.fa"
    for k, part in enumerate(PARTS):
        with open(path, "ab") as f:
            f.write(part)
        got = streaming.duplicates(stream_lines(spark, str(path), finished=k == len(PARTS) - 1))
        run(got.writeStream.format("parquet").option("path", str(tmp_path / "dup")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append"))
    lines = records.assign_records(records.line_facts(read_lines(spark, str(path))))
    want = validate.findings(lines, "any").where("code = 'fasta.duplicate_identifier'").select("offset", F.col("related.offset").alias("first_offset"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "dup")).select("offset", "first_offset").collect())) == sorted(map(tuple, want.collect())) != []


@pytest.fixture(scope="module")
def store(spark):
    seqs = [("s1", "ACGTACGTAC"), ("s2", "GGGGCCCC"), ("s2", "TTTT"), ("prot", "MKVLEEFPQ")]
    df = spark.createDataFrame([(k, i, s, len(s)) for k, (i, s) in enumerate(seqs)], "ordinal long, id string, seq string, seq_len long")
    return df.drop("seq").cache(), extract.chunks(df.select("ordinal", "seq"), extract.CHUNK).cache()


@pytest.mark.parametrize(
    "kind, parts, want, error",
    [
        ("bed", [b"s1\t0\t4\tx\t0\t-\n# note\ns2\t2\t9", b"9\ns1\t1\t2\nnone\t0\t1\ns1\t0\t1\n"], ">s1:1-4\nACGT\n>s2:3-99\nGGCCCC\n>s1:2-2\nC\n", "request.sequence_not_found"),
        ("names", [b"s2\n", b"\ns1\r\nprot\n"], ">s2\nGGGGCCCC\n>s1\nACGTACGTAC\n>prot\nMKVLEEFPQ\n", None),
        ("regions", [b"s1:3-5\ns1:0-2\n", b"s2\n"], ">s1:3-5\nGTA\n", "request.start_before_one"),
    ],
)
def test_answers(spark, tmp_path, store, kind, parts, want, error):
    """Answers come in order, batch by batch; those before an error are published, also after a restart, and none after it."""
    path, out = tmp_path / "asks", tmp_path / "out"
    failed = None
    for part in [*parts, b""]:
        with open(path, "ab") as f:
            f.write(part)
        lines = stream_lines(spark, str(path))
        try:
            run(streaming.answer(lines, *store, str(out), str(tmp_path / "c"), kind, stranded=True))
        except Exception as e:
            failed = str(e)
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{out}/batch-*/part-*")))
    assert text == want
    assert error in failed if error else failed is None
