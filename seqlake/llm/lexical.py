"""Ranked lexical search over postings bucketed by term.

``write_index`` counts the terms of each document where it is read and writes postings (term, document,
how often, the document's length) to ``BUCKETS`` folders by a hash of the term, in order of terms; a
bucket is written by segments of 2 ** ``SEGMENT`` scan tasks, so a frequent term is spread over as many tasks as
its documents come from. ``search`` joins the items' terms with the postings, so only buckets that
hold a term are opened, scores each match by whole numbers, sums by item and document and takes
the first ``k`` by a window. What is joined has been dealt by document first, so that the sums need
no shuffle of matches.
"""

from __future__ import annotations

import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, tidy

K, BUCKETS, SEGMENT, TABLE_ROWS = 50, 64, 4, 1_000_000

#: Bytes of a term as they are, A-Z lower-cased; other ASCII is a gap. Bytes beyond ASCII belong to terms.
FOLD = bytes((c | 32) if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Texts taken from Arrow at once, postings of a batch, and sums (item and document) of a task.
ROWS, POSTINGS, SUMS = 64, 200_000, 1_000_000


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of digits, letters and all beyond ASCII; only A-Z lower-cased."""
    return text.translate(FOLD).split(b" ")


def postings(docs: DataFrame, name: str = "doc_id") -> DataFrame:
    """(row, doc_id, term, counts) for each term of each document.

    ``row`` tells documents apart, whatever their ids. ``counts`` holds the document's length (from bit
    32), the term's occurrences (from bit 1) and whether this is the document's first posting: one
    number, since each column of a row that is shuffled takes eight bytes.
    """
    rows = docs.select(docs[name].cast("long").alias("doc_id"), docs["text"].alias("text"))

    def count(frames):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task, row = TaskContext.get().partitionId(), 0
        ids, lengths, sizes, words, often = [], [], [], [], []

        def batch():
            each = np.repeat(np.arange(len(ids)), sizes)
            begin = np.zeros(len(each), bool)
            begin[np.cumsum([0, *sizes[:-1]])] = True
            place = (task << 36) + row - len(ids) + each
            counts = np.repeat(np.array(lengths, np.int64), sizes) << 32 | np.array(often, np.int64) << 1 | begin
            names = pa.array(ids, pa.int64()).take(pa.array(each))
            full = pa.RecordBatch.from_arrays([pa.array(place), names, pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts)], ["row", "doc_id", "term", "counts"])
            for c in (ids, lengths, sizes, words, often):
                c.clear()
            return full

        for frame in frames:
            for at in range(0, frame.num_rows, ROWS):
                part = frame.slice(at, ROWS)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                    tf = Counter(terms(text or b""))
                    tf.pop(b"", None)
                    if tf:
                        row += 1
                        ids.append(doc_id)
                        lengths.append(tf.total())
                        sizes.append(len(tf))
                        words.extend(tf.keys())
                        often.extend(tf.values())
                        if len(words) > POSTINGS:
                            yield batch()
        if ids:
            yield batch()

    return rows.mapInArrow(tidy(count), "row long, doc_id long, term string, counts long")


def bucket() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


def write_index(docs: DataFrame, path: str) -> None:
    """The postings of a documents table, at ``path``, in folders by bucket. Null and empty texts have none."""
    dealt = postings(docs).repartition(F.shiftright("row", 36 + SEGMENT), bucket())
    fields = {"n": F.shiftright("counts", 32), "first": F.expr("counts & 1 = 1"), "tf": F.expr("(counts & 4294967295) >> 1").cast("int"), "bucket": bucket()}
    options = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#row": "false", "parquet.enable.dictionary#doc_id": "false"}
    dealt.withColumns(fields).drop("counts").sortWithinPartitions("bucket", "term", "row").write.options(**options).partitionBy("bucket").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row long, doc_id long, n long, first boolean, term string, tf int, bucket int").parquet(path)


def search(index: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` highest-scoring documents of each item.

    A repeated item_id is one item with the terms of all its rows; a null one is an item too. Items
    that share no term of weight with any document have no rows.
    """
    total = index.agg(F.count_if("first").alias("n"), F.sum("tf").alias("terms")).first()
    docs, length = total["n"], total["terms"] or 1
    asked = postings(items, "item_id").select(F.col("doc_id").alias("item_id"), "term").distinct().withColumn("bucket", bucket())
    size = asked.agg(F.count("*").alias("rows"), F.count_distinct(F.coalesce("item_id", F.lit(-1))).alias("items")).first()
    small = F.broadcast if size["rows"] <= TABLE_ROWS else lambda df: df  # beyond that a shuffle by term
    hits = index.join(small(asked.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")
    weight = F.floor(F.log((F.lit(2 * docs + 2).cast("double")) / (2 * F.col("df") + 1)) * 1000)
    weights = hits.groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")).where("w > 0")
    wanted = asked.join(weights, "term").select("term", "item_id", "w")
    deal = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs * size["items"] // SUMS))
    m = f"(100 - 50 + ((50L * n * {docs}L) div {length}L))"
    share = F.expr(f"(1000000000L * tf) div (1000L * tf + 20 * {m})")
    dealt = hits.select("row", "doc_id", "term", share.alias("share")).repartition(deal, "row")
    each = dealt.join(small(wanted), "term").select("item_id", "row", "doc_id", (F.col("w") * F.col("share")).alias("score"))
    sums = each.groupBy("item_id", "row", "doc_id").agg(F.sum("score").alias("score")).where("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return sums.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``search`` over a new index of ``docs`` in the shared folder.

    Null and empty texts, and those without terms, count nowhere. Every row is a document of its own,
    also where it repeats another or its id; a null id comes first among equal scores. Texts are
    taken whole. An empty table on either side gives no rows. Other columns are left out.
    """
    path = f"{shared_dir(docs.sparkSession)}/seqlake-{uuid.uuid4().hex}"
    write_index(docs, path)
    return search(open_index(docs.sparkSession, path), items, k)
