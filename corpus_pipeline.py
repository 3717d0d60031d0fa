"""From raw documents to packed training sequences.

STAGES run in order; each takes (spark, docs, sf_dir) and returns the next one's docs. All but the
last return the columns of documents, whatever they are called.

All stages: a null text counts as an empty one; repeated rows and repeated or null ids are rows of
their own; texts of any length are taken whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm import lines, packing, simhash, toxicity
from seqlake.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the others stay as they are.

    Without labels of both kinds no document is rejected. A null or empty text is scored like any other.
    """
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or nearly, go; n_chars follows the text.

    The first line by doc_id (null first), then by place, stays. Every document keeps its row; one
    whose lines all repeat others has an empty text. A null text becomes an empty one.
    """
    found = lines.dedup(docs, written=bool(docs.inputFiles())).select(*docs.columns)
    return found.withColumn("n_chars", F.length("text").cast("long"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the least doc_id (null first), of equal ids the first.

    Null, empty and blank texts are one group.
    """
    return simhash.deduplicate(docs, written=bool(docs.inputFiles()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences; an empty text is one piece of one id."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("simhash_near_dedup", dedup_near), ("best_fit_packing", pack)]

#: SQL can't express the stages. Tests compare line dedup, near copies and packing with brute force, and the
#: classifier's scores with a plain forward pass.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
