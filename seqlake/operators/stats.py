"""Exact length and composition statistics.

Order statistics come from the histogram of lengths: records are combined map-side, and the
running sums go over the distinct lengths of a bucket, after the sums of the buckets before it
(64 to a doubling of the length, so some 4,000 at most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import IUPAC, count_of, fixed, is_nucleotide


def bucket(length: Column) -> Column:
    """The bucket of a positive length, in the same order: its highest seven bits and how many follow."""
    e = F.length(F.bin(length)) - 1
    return F.call_function("shiftright", F.call_function("shiftleft", length.cast("long"), F.greatest(6 - e, F.lit(0))), F.greatest(e - 6, F.lit(0))) + e * 64 - 64


def length_summary(index: DataFrame) -> DataFrame:
    """One row of records, total, mean (floor), extremes with the first record's id, quartiles, Nx, Lx and auN.

    ``index`` has ordinal, id, seq_len. Quartiles are medians of the halves without the middle;
    medians of even counts are floored midpoints. An empty index gives a row of zeros and nulls.
    """
    rows = index.where("seq_len > 0").groupBy("seq_len").agg(F.count("*").alias("n"), F.min_by("id", "ordinal").alias("id"))
    rows = rows.select("seq_len", "n", "id", (F.col("seq_len") * F.col("n")).alias("own"), bucket(F.col("seq_len")).alias("bucket"))
    # Buckets and lengths both read n and id, so they are one exchange and the sequences are scanned once.
    square = F.col("own").cast("decimal(19,0)") * F.col("seq_len").cast("decimal(19,0)")
    sums = rows.groupBy("bucket").agg(F.sum("n").alias("_n"), F.sum("own").alias("_own"), F.sum(square).alias("squares"), F.min_by("id", "seq_len").alias("first_id"))
    every, before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        "bucket", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_own")),
        F.sum("_n").over(every).alias("records"), F.sum("_own").over(every).alias("total"), F.sum("squares").over(every).alias("squares"), F.first("first_id").over(every).alias("shortest_name"),
    )
    up = Window.partitionBy("bucket").orderBy("seq_len").rowsBetween(Window.unboundedPreceding, 0)
    hist = rows.select("bucket", "seq_len", "n", "own", "id", F.sum("n").over(up).alias("_upto"), F.sum("own").over(up).alias("_bases")).join(carry, "bucket", "left")
    hist = hist.withColumns({"upto": F.col("_upto") + F.col("_n"), "bases_upto": F.col("_bases") + F.col("_own")})
    half = F.expr("records div 2")
    ranks = {
        "m1": F.expr("(records + 1) div 2"), "m2": F.expr("records div 2 + 1"),
        "a1": F.greatest(F.lit(1), F.expr("(records div 2 + 1) div 2")), "a2": F.greatest(F.lit(1), F.expr("(records div 2) div 2 + 1")),
        "b1": F.when(F.col("records") == 1, 1).otherwise(F.col("records") - half + F.expr("(records div 2 + 1) div 2")), "b2": F.when(F.col("records") == 1, 1).otherwise(F.col("records") - half + F.expr("(records div 2) div 2 + 1")),
    }
    both = hist.withColumns(ranks).withColumns({"ahead": F.expr("records - upto + n"), "bases": F.expr("total - bases_upto + own")})  # of this length or more
    at = {k: F.min(F.when(F.col("upto") >= F.col(k), F.col("seq_len"))).alias(k) for k in ranks}
    nx = []
    for p in (50, 90):
        need = F.expr(f"(total * {p} + 99) div 100")
        reached = F.col("bases") >= need
        nx.append(F.max(F.when(reached, F.col("seq_len"))).alias(f"n{p}"))
        before, bases = F.col("ahead") - F.col("n"), F.col("bases") - F.col("own")
        nx.append(F.max_by(before + F.ceil((need - bases) / F.col("seq_len")), F.when(reached, F.col("seq_len"))).cast("long").alias(f"l{p}"))
    picked = both.agg(
        F.coalesce(F.max("records"), F.lit(0)).alias("records"), F.coalesce(F.max("total"), F.lit(0)).alias("total"), F.max("squares").alias("squares"),
        F.min("seq_len").alias("shortest"), F.max("shortest_name").alias("shortest_name"), F.max("seq_len").alias("longest"), F.max_by("id", "seq_len").alias("longest_name"),
        *at.values(), *nx,
    )
    mid = lambda a, b: F.expr(f"({a} + {b}) div 2")
    return picked.select(
        "records", "total", F.expr("total div nullif(records, 0)").alias("mean"), "shortest", "shortest_name", "longest", "longest_name",
        (F.col("longest") - F.col("shortest")).alias("range"), mid("a1", "a2").alias("q1"), mid("m1", "m2").alias("median"), mid("b1", "b2").alias("q3"),
        "n50", "l50", "n90", "l90", fixed(F.coalesce("squares", F.lit(0)), F.col("total")).alias("aun"),
    )


def nucleotide_counts(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """One row of symbol counts: a c g t u n ambiguous invalid lowercase iupac total."""
    s = F.col(seq)
    each = {k: count_of(s, k.upper() + k) for k in "acgtun"} | {"ambiguous": count_of(s, "RYSWKMBDHVryswkmbdhv"), "lowercase": count_of(s, "abcdefghijklmnopqrstuvwxyz"), "iupac": count_of(s, IUPAC), "total": F.length(s).cast("long")}
    sums = seqs.select(*(c.alias(k) for k, c in each.items())).agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in each))
    return sums.withColumn("invalid", F.col("total") - F.col("iupac"))


def composition(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """``nucleotide_counts`` with type, gc (percent of A+C+G+T+U) and gc_skew as text."""
    c = nucleotide_counts(seqs, seq)
    gc, acgtu = F.col("g") + F.col("c"), F.col("a") + F.col("c") + F.col("g") + F.col("t") + F.col("u")
    kind = (
        F.when(~is_nucleotide(F.col("iupac"), F.col("total")), "protein").when((F.col("t") > 0) & (F.col("u") > 0), "nucleotide_mixed_tu")
        .when(F.col("t") > 0, "nucleotide_t").when(F.col("u") > 0, "nucleotide_u").otherwise("nucleotide")
    )
    return c.withColumns({"type": kind, "gc": fixed(gc * 100, acgtu), "gc_skew": fixed(F.col("g") - F.col("c"), gc, 3)})


def protein_counts(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """residue, n: the 26 letters (either case), stop (*) and invalid."""
    s = F.upper(F.col(seq))
    letters = [chr(k) for k in range(65, 91)]
    each = [(x, count_of(s, x)) for x in letters] + [("stop", count_of(s, "*"))]
    sums = seqs.select(*(c.alias(k) for k, c in each), F.length(s).cast("long").alias("total")).agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k, _ in each), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    rows = F.array(*(F.struct(F.lit(k).alias("residue"), F.col(k).alias("n")) for k, _ in each), F.struct(F.lit("invalid").alias("residue"), (F.col("total") - sum((F.col(k) for k, _ in each[1:]), F.col("A"))).alias("n")))
    return sums.select(F.explode(rows).alias("r")).select("r.residue", "r.n")


def byte_histogram(lines: DataFrame) -> DataFrame:
    """byte, n over the symbols of sequence lines with column ``raw``; counted by numpy in each batch."""

    def scan(frames):
        import numpy as np
        import pandas as pd

        total = np.zeros(256, np.int64)
        for frame in frames:
            total += np.bincount(np.frombuffer(b"".join(frame["raw"]), np.uint8), minlength=256)
        at = np.flatnonzero(total)
        at = at[at > 32]
        yield pd.DataFrame({"byte": at, "n": total[at]})

    return lines.select(F.col("raw").cast("binary").alias("raw")).mapInPandas(scan, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def check_total(indexed: int, observed: int) -> None:
    """Symbols counted must be those that the index has."""
    if indexed != observed:
        raise ValueError(f"pair.total_length_mismatch: {indexed} indexed, {observed} observed")


def percent(n: Column, total: Column) -> Column:
    return fixed(n * 100, total)
