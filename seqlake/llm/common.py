"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors can read: ``spark.checkpoint.dir`` of the session.

    A private one is made only where the setting is missing and the master is local; on a cluster
    that would be a different folder on every machine, so it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not (spark.sparkContext.master or "").startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(shared_dir, "own", None)
        if found is None:
            found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, and what is read later is the same rows whatever executor is lost.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` has written for ``df``; nothing may read it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have: ``name`` behind as many underscores as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


HUBS = 100_000


def hub_join(rows: DataFrame, each: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``each``, a written table of one row a key, whose column ``n`` counts the key's rows.

    A key of more than a HUBS-th of the ``total`` rows would be a task of its own in a shuffle. There
    are fewer than HUBS such keys, so they are broadcast, and their rows stay where they are. Without
    such keys it is a plain join, which reads ``rows`` once and keeps the driver's plans small.
    """
    most = max(1000, total // HUBS)
    if total <= most or (each.agg(F.max("n").alias("n")).first()["n"] or 0) <= most:
        return rows.join(each, key)
    hubs, others = each.where(F.col("n") > most), each.where(F.col("n") <= most)
    cold = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(others, key)
    return rows.join(F.broadcast(hubs), key).unionByName(cold)


def tidy(scan: Callable) -> Callable:
    """A function over a task's batches that gives unused memory back at its end.

    Python workers are reused from stage to stage; without this each keeps the most it ever held.
    """

    @wraps(scan)
    def run(frames):
        try:
            yield from scan(frames)
        finally:
            release()

    return run


def release() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def pin_splits(spark: SparkSession) -> None:
    """Fix how file scans are cut, unless the session does.

    Spark takes the cores that it has at the moment as a guide, so that a scan planned again after
    executors came or went could be cut otherwise; operators that read a scan twice and go by its
    order call this first.
    """
    name = "spark.sql.files.minPartitionNum"
    if not spark.conf.get(name, None):
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of a documents table; a null text counts as empty. Other columns are left out."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def crc32_of_id(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the decimal text of an id (null: null)."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary"))


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text with A-Z lower-cased."""
    return text.lower().split()


def batches(column, size: int = 2_000_000):
    """Cut an Arrow string column into lists of UTF-8 bytes of about ``size`` bytes in all, some rows at a time."""
    import pyarrow as pa

    part, total, start = [], 0, 0
    for at in range(0, len(column), 64):
        for k, v in enumerate(column.slice(at, 64).cast(pa.large_binary()).to_pylist(), at):
            part.append(v or b"")
            total += len(part[-1])
            if total >= size:
                yield start, part
                part, total, start = [], 0, k + 1
    if part:
        yield start, part


FILTER_BITS = 25


def key_filter(wanted: DataFrame, key: str = "key"):
    """A filter of fixed size (2 ** FILTER_BITS bits, 4 MB) for 64-bit hashes, by their first bits.

    It lets all wanted keys through and, while they are few, little else. At most
    2 ** FILTER_BITS / 32768 + 1 rows of 4 KB come to the driver, however many keys there are.
    """
    import numpy as np

    bit = F.shiftrightunsigned(key, 64 - FILTER_BITS) + 1  # bucket k holds the numbers from 32768 * (k - 1) + 1
    bits = wanted.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    table = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in bits.collect():
        part = np.frombuffer(row["bits"], np.uint8)
        table[(row["part"] - 1) * 4096 : (row["part"] - 1) * 4096 + len(part)] = part
    return table


def passes(table, key: int) -> bool:
    """Whether an unsigned 64-bit key may be wanted."""
    at = key >> (64 - FILTER_BITS)
    return bool(table[at >> 3] >> (at & 7) & 1)
