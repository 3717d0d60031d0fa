"""A streaming source of the physical lines of FASTA files that grow, such as what a pipe is written to.

``spark.readStream.format("fasta_growing").option("path", ...)`` gives the rows of ``fasta_lines``. An
offset is the byte up to which each file has been read, so a restarted query goes on from its
checkpoint and reads each line once. A batch ends behind the last line feed that a file has; what
follows is an unfinished line and waits, unless the option ``finished`` says that no more will come.
``split`` is the byte at which a range of a batch begins, so lines of several batches are in order
by split and offset, as ``records.assign_records`` wants them. Files that become shorter raise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from .fasta import SCHEMA, _Range, files, open_at, read_range

TAIL = 1 << 20


def complete(path: str, size: int, least: int) -> int:
    """The end of the last whole line of a file's first ``size`` bytes; ``least`` if none ends after it."""
    with open_at(path) as f:
        end = size
        while end > least:
            start = max(least, end - TAIL)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return least


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("splitBytes", 64 << 20))
        self.finished = options.get("finished", "false").lower() == "true"
        self.known: dict = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, size, _ in files(self.path):
            before = self.known.get(path, 0)
            if size < before:
                raise ValueError(f"input.changed: {path} has {size} bytes, had {before}")
            self.known[path] = size if self.finished else complete(path, size, before)
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list:
        out = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            self.known[path] = max(stop, self.known.get(path, 0))
            if begin == 0 and stop:
                with open_at(path) as f:
                    if f.read(2) == b"\x1f\x8b":
                        raise ValueError(f"input.unsupported_format: {path} is compressed")
            out += [_Range(path, at, at, min(stop, at + self.size)) for at in range(begin, stop, self.size)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, part):
        yield from read_range(part)


class GrowingFasta(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_growing"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def stream_lines(spark: SparkSession, path: str, split_bytes: int = 64 << 20, finished: bool = False) -> DataFrame:
    """A stream of the lines of a file or folder that grows; all executors must be able to open it."""
    spark.dataSource.register(GrowingFasta)
    return spark.readStream.format("fasta_growing").option("path", path).option("splitBytes", split_bytes).option("finished", str(finished).lower()).load()
