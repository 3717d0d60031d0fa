"""FASTA-like views of the documents table.

``dna``: ordinal (doc_id), id, seq: a nucleotide string made from each text's letters.
``lines``: each document as a file of one record: header ``>doc<id> <lang> <source>`` and its lines.
``bed`` / ``regions`` / ``names``: requests against ``dna`` made from orders.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import records, store
from ..sources.fasta import read_lines

LETTERS, DNA = "abcdefghijklmnopqrstuvwxyz", "ACGTNRYKMSWBVDHUACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, DNA)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("doc"), F.col("doc_id")).alias("id"), "lang", "source", seq.alias("seq"))


def index(spark: SparkSession, sf_dir: str, name: str = "id") -> DataFrame:
    return dna(spark, sf_dir).select("ordinal", F.col(name).alias("id"), F.length("seq").cast("long").alias("seq_len")).where("seq_len > 0")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, split, line_offset, raw, term: what the ``fasta_lines`` source would give."""
    head = F.concat(F.lit(">doc"), F.col("doc_id"), F.lit(" "), F.col("lang"), F.lit(" "), F.col("source"))
    own = F.concat(F.array(head), F.split("text", "\n", -1))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id")).alias("file"), F.posexplode(own).alias("k", "raw")).withColumn("bytes", F.octet_length("raw").cast("long") + 1)
    start = F.sum("bytes").over(Window.partitionBy("file").orderBy("k")) - F.col("bytes")
    return rows.select("file", F.lit(0).cast("long").alias("split"), start.alias("line_offset"), F.col("raw").cast("binary").alias("raw"), F.lit(1).alias("term"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.assign_records(records.line_facts(raw_lines(spark, sf_dir)))


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share, in ``spark.checkpoint.dir``; a temporary one for a local master without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{found.rstrip('/')}/seqlake-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to a new shared folder and read back, where several results are derived from it."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, DataFrame]:
    """The documents as FASTA files, their index and its side tables, written and read through the source and the store.

    Characters beyond ASCII are x there.
    """
    path = folder(spark)
    head = F.concat(F.lit(">doc"), F.col("doc_id"), F.lit(" "), F.col("lang"), F.lit("\n"))
    table(spark, sf_dir, "documents").select(F.concat(head, F.regexp_replace("text", r"[^\x00-\x7F]", "x"))).write.text(path, lineSep="\n")
    parts = kept(records.assign_records(records.outline(records.line_facts(read_lines(spark, path)))))
    store.write_index(records.across_files(records.index(parts)), path, path + ".zidx", records.side_table(parts))
    return path, store.open_index(spark, path), store.open_sides(spark, path + ".zidx")


#: Files with one fault a kind: lines and their ends (1: LF, 2: CRLF, 0: none). Headers say NC_p.
FAULTS = [
    ([b">NC_p x", b"ACGT", b"ACGT"], [1, 1, 1]),
    ([b"", b" "], [1, 1]),
    ([b"\t", b" \tAC GT", b"A", b">NC_p", b"ACGT"], [1, 2, 2, 2, 2]),
    ([b">NC_p \x01a\x02", b"ACGT"], [1, 1]),
    ([b">NC_p", b"ACGT", b"AC\x03GT\x00", b"A\x07"], [1, 1, 1, 1]),
    ([b">NC_p", b"ACGT", b">NC_q"], [1, 1, 1]),
    ([b"> x", b"ACGT"], [1, 1]),
    ([b">NC_p", b"ACGT", b">NC_r", b"A", b">NC_p y", b"AC", b">NC_p", b"GT"], [1] * 8),
    ([b">NC_" + b"p" * 65533, b"ACGT"], [1, 1]),
    ([b">NC_p " + b"x" * 1020, b"ACGT"], [1, 1]),
    ([b">p", b"ACGT"], [1, 1]),
    ([b">NC_p", b"ACGT", b"AC1GT!", b"?"], [1, 1, 1, 1]),
    ([b">NC_p", b"AC GT", b"ACGT\t"], [1, 1, 1]),
    ([b">NC_p", b"ACGT", b"", b"ACGT"], [1] * 4),
    ([b">NC_p", b"ACGT", b"ACGT", b"AC", b"ACGT"], [1] * 5),
    ([b"\xef\xbb\xbf>NC_p", b"AC3T", b">NC_p", b"AAAA"], [1, 1, 1, 1]),
    ([b">NC_p", b"ACGT"], [1, 0]),
    ([b">NC_p", b"ACGT", b"ACGT"], [1, 2, 1]),
    ([b"\xef\xbb\xbfAC", b"> \x1fx", b"", b">", b"AC", b"ACGTA"], [2, 1, 1, 2, 1, 0]),
]


def faulty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part, of the kind that its key gives; physical lines."""
    rows = []
    for kind, (own, terms) in enumerate(FAULTS):
        at = 0
        for raw, term in zip(own, terms, strict=True):
            rows.append((kind, at, bytearray(raw), term))
            at += len(raw) + term
    faults = spark.createDataFrame(rows, "kind int, line_offset long, raw binary, term int")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("part"), F.col("p_partkey")).alias("file"), (F.col("p_partkey") % len(FAULTS)).cast("int").alias("kind"))
    lines = files.join(F.broadcast(faults), "kind").select("file", F.lit(0).cast("long").alias("split"), "line_offset", "raw", "term")
    return records.assign_records(records.line_facts(lines))


def names(spark: SparkSession, sf_dir: str):
    """A document's name for each order, all documents being asked for; some tenth of the names are unknown."""
    most = table(spark, sf_dir, "documents").agg(F.max("doc_id").alias("m")).first()["m"] or 0
    return F.concat(F.lit("doc"), F.col("o_orderkey") % (most * 11 // 10 + 1))


def bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request, value: BED rows from orders; names go past the documents, so some are unknown."""
    start = F.col("o_custkey") % 700
    value = F.concat_ws("\t", names(spark, sf_dir), start.cast("string"), (start + F.col("o_orderkey") % 50 + 1).cast("string"), F.lit("x"), F.lit("0"), F.when(F.col("o_orderstatus") == "O", "-").otherwise("+"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), value.alias("value"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request, token: the three forms of a region, by order key."""
    o = table(spark, sf_dir, "orders")
    name = names(spark, sf_dir)
    a = (F.col("o_custkey") % 500 + 1).cast("string")
    b = (F.col("o_custkey") % 500 + 60).cast("string")
    kind = F.col("o_orderkey") % 3
    token = F.when(kind == 0, name).when(kind == 1, F.concat(name, F.lit(":"), a, F.lit("-"))).otherwise(F.concat(name, F.lit(":"), a, F.lit("-"), b))
    return o.select(F.col("o_orderkey").alias("request"), token.alias("token"))
