"""WARC files as tables, and a Merkle audit of their fixity between replicas.

``records``   pages as WARC records with their place in a file
``write`` / ``read``   WARC files in a folder, written by Spark's text sink and read as binary files
``leaves``    (file, position, start, length, digest, name): one leaf per record, as the table has it
``scan``      the same from the bytes of a folder; ranges that can't be read are leaves of their own
``tree``      nodes over ordered ranges of ``FANOUT`` children up to one root a file
``audit``     compares two replicas' roots and goes down the branches that differ, to the records
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir

FILE_RECORDS, FANOUT, DATE = 1000, 16, "2024-01-01T00:00:00Z"
NAMED = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"


def record_text(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """A WARC/1.1 resource record without the two line breaks that end it; nulls count as empty."""
    body, target = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))
    name = F.md5(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("")), target))
    own = F.concat_ws("-", F.substring(name, 1, 8), F.substring(name, 9, 4), F.substring(name, 13, 4), F.substring(name, 17, 4), F.substring(name, 21, 12))
    return F.concat(
        F.lit(NAMED), own, F.lit(">\r\nWARC-Date: " + date + "\r\nWARC-Target-URI: "), target,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
    )


def records(pages: DataFrame, file_records: int = FILE_RECORDS, html: Column | None = None) -> DataFrame:
    """page_id, url, file, record: every row as a record; files hold ``file_records`` consecutive ids.

    ``html`` replaces the body, for a replica. A null page_id goes to file null.
    """
    page_id, url, body = (F.col(n) for n in ("page_id", "url", "html"))
    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return own.select("page_id", "url", F.floor(page_id / file_records).alias("file"), record_text(page_id, url, body if html is None else html).alias("record"))


def write(recs: DataFrame, path: str, most: int = FILE_RECORDS) -> None:
    """WARC files of at most ``most`` records for each value of ``file``, in order of page_id, url and text."""
    own = recs.select(F.coalesce(F.col("file"), F.lit(-1)).alias("file"), "page_id", "url", "record")
    ordered = own.repartition("file").sortWithinPartitions("file", "page_id", "url", F.sha2("record", 256))
    ordered.select("file", F.col("record").alias("value")).write.option("maxRecordsPerFile", most).partitionBy("file").text(path, lineSep="\r\n\r\n")


def write_replicas(pages: DataFrame, replica: Column, path: str, file_records: int = FILE_RECORDS, compression: str = "gzip") -> None:
    """Folders replica=1 (the table) and replica=2 (with bodies ``replica``) as ``write`` makes them, with one shuffle."""
    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    both = own.withColumn("same", F.col("html").eqNullSafe(replica)).withColumn("other", F.when(~F.col("same"), replica))
    dealt = both.withColumn("file", F.coalesce(F.floor(F.col("page_id") / file_records), F.lit(-1))).repartition("file")
    bodies = F.array(F.struct(F.lit(1).alias("replica"), F.col("html")), F.struct(F.lit(2).alias("replica"), F.when(F.col("same"), F.col("html")).otherwise(F.col("other")).alias("html")))
    each = dealt.select("file", "page_id", "url", F.inline(bodies)).select("replica", "file", "page_id", "url", record_text(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    ordered = each.sortWithinPartitions("replica", "file", "page_id", "url", F.sha2("record", 256))
    out = ordered.select("replica", "file", F.col("record").alias("value")).write.option("maxRecordsPerFile", file_records)
    out.partitionBy("replica", "file").text(path, lineSep="\r\n\r\n", compression=compression)


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, start, length, headers, body of every record of the WARC files below a folder.

    ``length`` is without the two line breaks that end a record. Bytes that hold no record, as in
    an empty file, give no rows; a damaged header raises.
    """

    def scan(frames):
        import pandas as pd

        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                rows, at = [], 0
                while at < len(data):
                    stop = data.find(b"\r\n\r\n", at)
                    if not data.startswith(b"WARC/", at) or stop < 0:
                        raise ValueError(f"{file}: no WARC record at byte {at}")
                    lines = data[at:stop].decode().split("\r\n")[1:]
                    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
                    end = stop + 4 + int(headers["Content-Length"])
                    rows.append((file, at, end - at, headers, data[stop + 4 : end]))
                    at = end + 4
                    if len(rows) == 256:
                        yield pd.DataFrame(rows, columns=["path", "start", "length", "headers", "body"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "start", "length", "headers", "body"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInPandas(scan, "path string, start long, length long, headers map<string,string>, body binary")


_head = re.compile(rb"WARC/[0-9.]+\r\n(?:[^\r\n]+\r\n)+\r\n")
_length = re.compile(rb"(?<=\r\n)Content-Length: *([0-9]{1,18})\r\n", re.I)
_name = re.compile(rb"(?<=\r\n)WARC-Record-ID: *<?(?:urn:uuid:)?([^>\r\n]+)", re.I)


def ranges(data: bytes) -> list[tuple[int, int, int, str | None]]:
    """(start, length, next start, record id) of the records of a file's bytes, all bytes covered.

    Where no whole record stands, as after a damaged header or length, a range without id goes to
    the next record that can be read, or to the end.
    """
    out, at = [], 0

    def record(at: int):
        head = _head.match(data, at)
        length, name = (x.search(data, at, head.end()) for x in (_length, _name)) if head else (None, None)
        if length and name:
            end = head.end() + int(length[1])
            if data.startswith(b"\r\n\r\n", end):
                return at, end - at, end + 4, name[1].decode("utf-8", "replace")
        return None

    while at < len(data):
        found = record(at)
        if found is None:
            stop = at
            while found is None and stop >= 0:
                stop = data.find(b"\r\n\r\nWARC/", stop + 1)
                found = record(stop + 4) if stop >= 0 else None
            end = len(data) if found is None else found[0]
            out.append((at, end - at - 4 * data.endswith(b"\r\n\r\n", at, end), end, None))
        if found is not None:
            out.append(found)
        at = out[-1][2]
    return out


def inflate(data: bytes) -> bytes:
    """The bytes of a gzip file, as far as they can be read."""
    out = []
    while data:
        more = zlib.decompressobj(31)
        try:
            for at in range(0, len(data), 1 << 16):
                out.append(more.decompress(data[at : at + (1 << 16)]))
                if more.eof:
                    data = more.unused_data + data[at + (1 << 16) :]
                    break
            else:
                data = b""
        except zlib.error:
            break
    return b"".join(out)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """file, position, start, length, digest, name of every record of a folder's files, from their bytes.

    A file's pieces are counted on in order; ``name`` is the record id, null for ranges that can't be read.
    """

    def run(frames):
        import pandas as pd

        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                file, piece = int(re.search(r"/file=(-?\d+)/", name)[1]), re.search(r"\.c(\d+)\.", name)
                if name.endswith(".gz"):
                    data = inflate(data)
                rows = [(file, int(piece[1]) if piece else 0, name, a, n, e - a, hashlib.sha256(data[a : a + n]).hexdigest(), i) for a, n, e, i in ranges(data)]
                yield pd.DataFrame(rows, columns=["file", "piece", "path", "at", "length", "extent", "digest", "name"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    rows = files.mapInPandas(run, "file long, piece int, path string, at long, length long, extent long, digest string, name string")
    order = Window.partitionBy("file").orderBy("piece", "path", "at")
    end = F.sum("extent").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("file", (F.row_number().over(order) - 1).cast("long").alias("position"), (end - F.col("extent")).alias("start"), "length", "digest", "name")


def leaves(recs: DataFrame) -> DataFrame:
    """page_id, url, file, position (from 0), start, length, digest, name of every record, as its file holds it.

    A record's bytes are hashed before anything is shuffled; only lengths and hashes are ordered.
    Repeated rows are records of their own.
    """
    hashed = recs.select("page_id", "url", "file", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), F.substring("record", len(NAMED) + 1, 36).alias("name"))
    order = Window.partitionBy("file").orderBy("page_id", "url", "digest")
    end = F.sum(F.col("length") + 4).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return hashed.select("page_id", "url", "file", (F.row_number().over(order) - 1).cast("long").alias("position"), (end - F.col("length") - 4).alias("start"), "length", "digest", "name")


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    child = F.struct("node", F.concat_ws(":", "start", "length", "digest").alias("text"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["text"]), "\n"), 256)
    up = nodes.groupBy("file", F.floor(F.col("node") / fanout).alias("node"))
    return up.agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("length")) - F.min("start")).alias("length"), digest.alias("digest"))


def tree(leaf: DataFrame, file_records: int = FILE_RECORDS, fanout: int = FANOUT) -> list[DataFrame]:
    """(file, node, start, length, digest) by level, from the leaves to one root a file.

    A parent's digest is over its children's offset ranges and digests in order; it groups at most
    ``fanout`` rows. A file of more than ``file_records`` records (repeated ids) gets more levels.
    """
    most = leaf.agg(F.max("position").alias("p")).first()["p"] or 0
    levels, span = [leaf.select("file", F.col("position").alias("node"), "start", "length", "digest", "name")], 1
    while span <= max(most, file_records - 1):
        levels.append(_parents(levels[-1], fanout))
        span *= fanout
    return levels


def audit(one: list[DataFrame], two: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(file, position, start, length, found): leaves that differ between two replicas.

    ``found`` is changed, missing (only in the first), added or unreadable (only in the second). Roots
    are compared first; below, only children of nodes that differ are joined. Their leaves are
    matched by record id and digest, then by record id, wherever they stand: a record that only moved is sound.
    """
    depth = max(len(one), len(two))
    while len(one) < depth:
        one = [*one, _parents(one[-1], fanout)]
    while len(two) < depth:
        two = [*two, _parents(two[-1], fanout)]
    suspects = None
    for level, (a, b) in enumerate(zip(reversed(one), reversed(two), strict=True)):
        more = ["name"] if level == depth - 1 else []
        a, b = (x.select(F.coalesce("file", F.lit(-1)).alias("file"), "node", "start", "length", "digest", *more) for x in (a, b))
        if suspects is not None:
            parent = suspects.select("file", F.col("node").alias("parent"))
            a, b = (x.withColumn("parent", F.floor(F.col("node") / fanout)).join(parent, ["file", "parent"], "left_semi").drop("parent") for x in (a, b))
        if level < depth - 1:
            a, b = (x.select("file", "node", F.struct("start", "length", "digest").alias(n)) for x, n in ((a, "a"), (b, "b")))
            suspects = a.join(b, ["file", "node"], "full").where("not (a <=> b)")
    for keys in (["file", "name", "digest"], ["file", "name"]):
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy("node"))
        a, b = (x.select(*[F.coalesce(k, F.lit("")).alias(k) if k == "name" else k for k in keys], turn.alias("turn"), F.struct(*x.columns).alias(n)) for x, n in ((a, "a"), (b, "b")))
        pairs = a.join(b, [*keys, "turn"], "full")
        if "digest" in keys:
            odd = materialize(pairs.where("a is null or b is null").select("a", "b"))
            a, b = (odd.where(F.col(n).isNotNull()).select(n + ".*") for n in ("a", "b"))
    found = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), F.when(F.col("b.name").isNull(), "unreadable").otherwise("added")).otherwise("changed")
    place = F.coalesce("a", "b")
    return pairs.select(place["file"].alias("file"), place["node"].alias("position"), place["start"].alias("start"), place["length"].alias("length"), found.alias("found"))


def fixity(pages: DataFrame, replica: Column, file_records: int = FILE_RECORDS, fanout: int = FANOUT) -> DataFrame:
    """page_id, url, file, position, start, length, digest, intact: the audit of a replica whose bodies are ``replica``.

    Both replicas are written as files, and their bytes audited. Every record of the table gives a
    row; ``intact`` is false where the descent through the trees ends at it. No rows for an empty table.
    """
    spark, path = pages.sparkSession, f"{shared_dir(pages.sparkSession)}/seqlake-{uuid.uuid4().hex}"
    if pages.isEmpty():
        return leaves(records(pages, file_records)).withColumn("intact", F.lit(True)).drop("name")
    write_replicas(pages, replica, path, file_records)
    own, other = (materialize(scan(spark, f"{path}/replica={n}")) for n in (1, 2))
    bad = audit(tree(own, file_records, fanout), tree(other, file_records, fanout), fanout).where("found <> 'added' and found <> 'unreadable'")
    bad = bad.select(F.col("file").alias("key"), "position", F.lit(False).alias("sound"))
    keyed = leaves(records(pages, file_records)).select("page_id", "url", "file", F.coalesce("file", F.lit(-1)).alias("key"), "position")
    held = own.withColumnRenamed("file", "key").drop("name")
    return keyed.join(held, ["key", "position"], "left").join(bad, ["key", "position"], "left").select(
        "page_id", "url", "file", "position", "start", "length", "digest", F.coalesce("sound", F.lit(True)).alias("intact")
    )
