"""A sink for text that appears as a whole or not at all.

``df.write.format("text_committed").option("path", ...).mode("append" or "overwrite").save()`` writes
column ``value``, a line a row, one file a partition in a hidden folder beside the target, and renames
the folder when every task has committed. Where the option ``source`` names what the rows were made
from, the target must not be it, or lie in it, and it must have the same sizes and modification times at the
end as at the start. Otherwise, or if a task fails, what was staged is deleted and the target stays as
it was. Files of attempts that did not commit are deleted. ``append`` needs a target that isn't there;
``overwrite`` puts the old one aside for the rename and then deletes it.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .fasta import files, info, located


def canonical(path: str) -> str:
    """A path without links, for comparison; of other file systems as it is."""
    system, name = located(path)
    return os.path.realpath(name) if system.type_name == "local" else f"{system.type_name}:{name.rstrip('/')}"


def distinct_from(source: str, target: str) -> None:
    """Raise where writing ``target`` would write over ``source`` or into it."""
    one, two = canonical(source), canonical(target)
    if one == two or one.startswith(two + "/") or two.startswith(one + "/"):
        raise ValueError(f"repair.output_is_input: {target}")


def state(source: str) -> list:
    """Name, size and modification time of every file of a source."""
    return [tuple(x) for x in files(source)]


@dataclass
class _Part(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.source, self.overwrite = options["path"].rstrip("/"), options.get("source"), overwrite
        if self.source:
            distinct_from(self.source, self.path)
        self.before = state(self.source) if self.source else None
        if not overwrite and info(self.path).type.name != "NotFound":
            raise ValueError(f"io.create_failed: {self.path} exists")
        head, _, tail = self.path.rpartition("/")
        self.staged = f"{head}/.{tail}.{uuid.uuid4().hex}" if head or self.path.startswith("/") else f".{tail}.{uuid.uuid4().hex}"
        system, folder = located(self.staged)
        system.create_dir(folder, recursive=True)  # by the driver only: a task that outlives an abort can't bring it back

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = located(self.staged)
        name, rows = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.txt", 0
        with system.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                values = batch.column("value").to_pylist()
                rows += len(values)
                out.write("".join(f"{v}\n" for v in values if v is not None).encode())
        return _Part(name, rows)

    def commit(self, messages: list) -> None:
        system, folder = located(self.staged)
        target = located(self.path)[1]
        try:
            if self.source and state(self.source) != self.before:
                raise ValueError(f"input.changed: {self.source}")
            for path, _, _ in files(self.staged):
                if path.rsplit("/", 1)[-1] not in {m.name for m in messages if m}:
                    system.delete_file(located(path)[1])
            with system.open_output_stream(f"{folder}/_SUCCESS"):
                pass
            old = None
            if info(self.path).type.name != "NotFound":
                if not self.overwrite:
                    raise ValueError(f"io.create_failed: {self.path} exists")
                old = f"{folder}.old"
                system.move(target, old)
            system.move(folder, target)
        except BaseException:
            self.abort(messages)
            raise
        if old:
            system.delete_dir(old) if system.get_file_info(old).type.name == "Directory" else system.delete_file(old)

    def abort(self, messages: list) -> None:
        system, folder = located(self.staged)
        if system.get_file_info(folder).type.name == "Directory":
            system.delete_dir(folder)


class CommittedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_committed"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def write_committed(rows: DataFrame, path: str, *order: str, source: str | None = None, overwrite: bool = False) -> None:
    """Column ``value`` of ``rows`` as lines, in order of the columns ``order``, file by file and by name of the files."""
    if source:
        distinct_from(source, path)
    rows.sparkSession.dataSource.register(CommittedText)
    writer = (rows.orderBy(*order) if order else rows).select("value").write.format("text_committed").option("path", path)
    if source:
        writer = writer.option("source", source)
    writer.mode("overwrite" if overwrite else "append").save()
