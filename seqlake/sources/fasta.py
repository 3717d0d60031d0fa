"""A Spark data source of the physical lines of FASTA files, split by byte ranges.

``spark.read.format("fasta_lines").option("path", ...)`` gives file, split, line_offset, raw
(without its line end) and term (0: none, 1: LF, 2: CRLF). A split owns the lines that start in
it, so rows don't depend on the split size. Nothing is stripped: byte order marks, carriage
returns and a missing last line end are seen as they are. Gzip files are refused.

Paths may be local or of any file system that pyarrow opens (hdfs, s3, gs). Files of a folder whose
names begin with ``_`` or ``.`` are passed over, as Spark's own readers do.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, split long, line_offset long, raw binary, term int"


BUFFER = 1 << 20


def located(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else os.path.abspath(path))


def open_at(path: str):
    """A file open for reading and seeking."""
    system, name = located(path)
    return io.BufferedReader(system.open_input_file(name), BUFFER)


def info(path: str):
    """What a path is: type, size and modification time."""
    system, name = located(path)
    return system.get_file_info(name)


def files(path: str) -> list[tuple[str, int, int]]:
    """(path, size, modification time) of a file, or of the files in a folder, by name."""
    from pyarrow import fs

    system, name = located(path)
    if not (found := system.get_file_info(name)).type == fs.FileType.Directory:
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        return [(path, found.size, found.mtime_ns)]
    listed = system.get_file_info(fs.FileSelector(name, recursive=True))
    hidden = lambda x: any(part[0] in "_." for part in x.path[len(name) :].split("/") if part)
    root = path.rstrip("/")
    return sorted((root + "/" + x.path[len(name) :].lstrip("/"), x.size, x.mtime_ns) for x in listed if x.is_file and not hidden(x))


def owned_lines(data, start: int, stop: int) -> Iterator[tuple[int, bytes, int]]:
    """(offset, content, term) of the lines of an open binary file that start in [start, stop)."""
    data.seek(max(0, start - 1))
    if start and data.read(1) != b"\n":
        data.readline()
    at = data.tell()
    while at < stop and (line := data.readline()):
        term = 2 if line.endswith(b"\r\n") else 1 if line.endswith(b"\n") else 0
        yield at, line[: len(line) - term], term
        at += len(line)


class _Range(InputPartition):
    def __init__(self, file: str, split: int, start: int, stop: int) -> None:
        self.file, self.split, self.start, self.stop = file, split, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options["path"].split(",") if p]
        self.size = int(options.get("splitBytes", 64 << 20))

    def partitions(self):
        out = []
        for path in self.paths:
            for file, n, _ in files(path):
                with open_at(file) as f:
                    if f.read(2) == b"\x1f\x8b":
                        raise ValueError(f"input.unsupported_format: {file} is compressed")
                out += [_Range(file, k, a, min(n, a + self.size)) for k, a in enumerate(range(0, n, self.size))]
        return out or [_Range("", 0, 0, 0)]

    def read(self, part):
        yield from read_range(part)


def read_range(part: _Range):
    """Arrow batches of the lines that start in a range."""
    import pyarrow as pa

    if not part.file:
        return
    names = ["file", "split", "line_offset", "raw", "term"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
    rows: list = []
    with open_at(part.file) as f:
        for at, raw, term in owned_lines(f, part.start, part.stop):
            rows.append((part.file, part.split, at, raw, term))
            if len(rows) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class FastaLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_lines(spark: SparkSession, *paths: str, split_bytes: int = 64 << 20) -> DataFrame:
    """The lines of FASTA files or folders that every executor can open."""
    spark.dataSource.register(FastaLines)
    return spark.read.format("fasta_lines").option("path", ",".join(paths)).option("splitBytes", split_bytes).load()
