"""Requests: regions, BED rows and names, as tables with one row for each request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most regions that one call may name outright; names and BED rows have no limit. A fixed value.
MOST_REGIONS = 1024
_U64 = 18446744073709551615


def _u64(text: str) -> str:
    return f"case when {text} rlike '^[0-9]+$' and length(ltrim('0', {text})) <= 20 and cast({text} as decimal(38,0)) <= {_U64} then cast({text} as decimal(20,0)) end"


def parse_regions(tokens: DataFrame, token: str = "token") -> DataFrame:
    """name, start, end (1-based, inclusive; null: open), is_full of ``NAME``, ``NAME:S-E``, ``NAME:S-``.

    The rightmost colon counts; a suffix that isn't a range of unsigned 64-bit numbers belongs to
    the name. Digits only: no signs or separators.
    """
    part = tokens.withColumns({"_n": F.regexp_extract(token, r"(?s)^(.*):([0-9]+)-([0-9]*)$", 1), "_s": F.regexp_extract(token, r"(?s)^(.*):([0-9]+)-([0-9]*)$", 2), "_e": F.regexp_extract(token, r"(?s)^(.*):([0-9]+)-([0-9]*)$", 3)})
    part = part.withColumns({"_a": F.expr(_u64("_s")), "_b": F.expr(_u64("_e"))})
    ranged = (F.col("_s") != "") & F.col("_a").isNotNull() & ((F.col("_e") == "") | F.col("_b").isNotNull())
    return part.select(*tokens.columns, F.when(ranged, F.col("_n")).otherwise(F.col(token)).alias("name"), F.when(ranged, F.col("_a")).alias("start"), F.when(ranged, F.col("_b")).alias("end"), (~ranged).alias("is_full"))


def named_regions(spark, tokens: list[str]) -> DataFrame:
    """``parse_regions`` of tokens given outright, numbered by position; more than ``MOST_REGIONS``, or none, raise."""
    if not tokens:
        raise ValueError("usage.missing_argument")
    if len(tokens) > MOST_REGIONS:
        raise ValueError(f"resource.capacity_limit_exceeded: {len(tokens)} of {MOST_REGIONS}")
    return parse_regions(spark.createDataFrame(list(enumerate(tokens)), "request long, token string"))


def request_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines that hold a request: not empty, no comment, no track or browser line."""
    v = F.col(line)
    return lines.where((v != "") & ~v.startswith("#") & ~v.isin("track", "browser") & ~v.startswith("track ") & ~v.startswith("browser "))


def parse_bed(lines: DataFrame, line: str = "value", stranded: bool = False) -> DataFrame:
    """name, start, end (1-based, inclusive), reverse, error of BED rows; columns 4 and 5 are never read."""
    rows = request_lines(lines, line).withColumn("_f", F.split(F.regexp_replace(line, "\r$", ""), "\t"))
    rows = rows.withColumns({"_s": F.get("_f", F.lit(1)), "_e": F.get("_f", F.lit(2)), "_d": F.coalesce(F.get("_f", F.lit(5)), F.lit(""))})
    rows = rows.withColumns({"_a": F.expr(_u64("_s")), "_b": F.expr(_u64("_e"))})
    error = (
        F.when(F.size("_f") < 3, "request.bed.field_missing")
        .when(~F.col("_s").rlike("^[0-9]+$") | ~F.col("_e").rlike("^[0-9]+$"), "request.bed.invalid_coordinate")
        .when(F.col("_a").isNull() | F.col("_b").isNull(), "request.bed.coordinate_out_of_range")
        .when(F.col("_b") <= F.col("_a"), "request.bed.invalid_interval")
    )
    if stranded:
        error = F.coalesce(error, F.when(~F.col("_d").isin("+", "-", ".", ""), "request.bed.invalid_strand"))
    reverse = (F.col("_d") == "-") if stranded else F.lit(False)
    return rows.select(*lines.columns, F.get("_f", F.lit(0)).alias("name"), (F.col("_a") + 1).alias("start"), F.col("_b").alias("end"), reverse.alias("reverse"), error.alias("error"))


def parse_names(lines: DataFrame, line: str = "value") -> DataFrame:
    """name of each line: blank lines and comments are left out, one CR at the end is taken off, nothing else."""
    v = F.regexp_replace(line, "\r$", "")
    rows = lines.withColumn("name", v).where((F.col("name") != "") & ~F.col("name").startswith("#"))
    return rows.withColumn("error", F.when(F.octet_length("name") > 65535, "request.identifier_too_long"))
