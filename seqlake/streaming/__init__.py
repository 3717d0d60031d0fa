"""Streams: requests against a static index, FASTA that grows, and duplicates by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import bytes_text, identifier
from ..operators import extract, records, requests
from ..operators.validate import LONGEST_ID
from ..sources.sink import write_committed


def resolve_bed(lines: DataFrame, index: DataFrame, stranded: bool = False) -> DataFrame:
    """Resolved intervals of a stream of BED lines (column ``value``), row by row, without state.

    Each micro-batch is joined with the first record of each id; a bad row keeps its error.
    """
    rows = requests.parse_bed(lines, stranded=stranded)
    known = extract.first_of_each(index).withColumnRenamed("id", "name")
    found = extract.resolve(rows.withColumnRenamed("error", "bad").join(known, "name", "left"))
    return found.selectExpr("value", "name", "from_base", "to_base", "display_end", "reverse", "coalesce(bad, error) as error")


def land(lines: DataFrame, path: str, checkpoint: str):
    """Append a stream of lines to a table of Parquet, each once; ``landed`` reads what is there.

    Gives the query's writer: choose a trigger and start it.
    """
    return lines.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def landed(spark, path: str) -> DataFrame:
    """The lines landed so far, with their records: what a batch over the same bytes gives."""
    return records.assign_records(records.line_facts(spark.read.parquet(path)))


class _Definitions(StatefulProcessor):
    """Holds where the id of a file was first defined, and passes on every later header with that id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "offset long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        known = self.first.get()
        if known is None:  # the least offset may come last
            at = pd.concat([frame["offset"] for frame in rows]).sort_values()
            known = (int(at.iloc[0]),)
            self.first.update(known)
            later = iter([at.iloc[1:]])
        else:
            later = (frame["offset"] for frame in rows)
        for at in later:
            if len(at):
                yield pd.DataFrame({"file": key[0], "id": key[1], "offset": at.to_numpy(), "first_offset": known[0]})

    def close(self) -> None:
        pass


def duplicates(lines: DataFrame) -> DataFrame:
    """(file, id, offset, first_offset) of every header in a stream of lines whose id its file had before, as it comes.

    Offsets are those of the ids' first bytes. State is one number for each id of a file, keyed by both and
    spread over all state partitions. It needs the RocksDB state store. Lines of a file must come in
    order, batch by batch, as ``sources.growing`` gives them. Of the batch in which an id comes first the task
    holds its offsets, eight bytes each, to find the least; later batches are passed on as they come.
    """
    heads = records.line_facts(lines).where("is_header").select("file", identifier(F.substring("content", 2, 2**31 - 1)).alias("id"), (F.col("line_offset") + F.when(F.col("bom"), 4).otherwise(1)).alias("offset"))
    named = heads.where(F.length("id").between(1, LONGEST_ID))
    return named.groupBy("file", "id").transformWithStateInPandas(_Definitions(), "file string, id string, offset long, first_offset long", "Append", "none")


def asked(lines: DataFrame, kind: str, stranded: bool = False) -> DataFrame:
    """request (a line's offset), name, start, end, is_full, reverse, complement, bad of request lines: ``bed``, ``names`` or ``regions``."""
    rows = lines.select(F.col("line_offset").alias("request"), bytes_text(F.col("raw")).alias("value"))
    if kind == "bed":
        found = requests.parse_bed(rows, stranded=stranded).withColumns({"is_full": F.lit(False), "complement": F.col("reverse")})
    elif kind == "names":
        nothing = {"start": F.lit(None).cast("decimal(20,0)"), "end": F.lit(None).cast("decimal(20,0)"), "is_full": F.lit(True), "reverse": F.lit(False), "complement": F.lit(False)}
        found = requests.parse_names(rows).withColumns(nothing)
    elif kind == "regions":
        tokens = requests.parse_regions(rows.where("value <> ''"), "value")
        found = tokens.withColumns({"reverse": F.lit(False), "complement": F.lit(False), "error": F.lit(None).cast("string")})
    else:
        raise ValueError("usage.invalid_option_value")
    return found.drop("value").withColumnRenamed("error", "bad")


def answer(lines: DataFrame, index: DataFrame, pieces: DataFrame, path: str, checkpoint: str, kind: str = "bed", stranded: bool = False, width: int = 60):
    """Answers a stream of request lines of one file as FASTA text, a folder a batch below ``path``; gives the query's writer.

    ``index``: id, ordinal, seq_len; ``pieces``: ordinal, chunk, bases. A batch's answers are written in
    order and appear as a whole (``sources.sink``), and a batch that is run again after a restart takes
    its own folder's place, so no answer is doubled. The lowest request with an error stops the query:
    what stands before it is published, and nothing from it on.
    """

    def publish(batch: DataFrame, number: int) -> None:
        asks = asked(batch, kind, stranded)
        resolved = extract.resolve(extract.lookup(asks, index))
        resolved = resolved.withColumn("error", F.coalesce("bad", "error"))
        turned = extract.oriented(extract.extract(resolved, pieces)).persist()
        try:
            bad = turned.where("error is not null").orderBy("request").select("request", "error", "name").first()
            good = turned if bad is None else turned.where(F.col("request") < bad["request"])
            write_committed(extract.fasta_text(good, width), f"{path}/batch-{number:010d}", "request", overwrite=True)
        finally:
            turned.unpersist()
        if bad:
            raise ValueError(f"{bad['error']}: request at byte {bad['request']}: {bad['name']}")

    return lines.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
