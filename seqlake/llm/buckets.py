"""Links between the alike members of overlapping buckets, exactly, without all pairs of a large bucket.

First every member meets its bucket's least member. That connects most of a large group of copies
in one pass over it. Then, in buckets whose members are not yet connected, those outside the bucket's
largest component meet all others. Whatever pair of a bucket is alike ends up in one component, and
the pairs tried grow with the members that are unlike their bucket's first, not with its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hub_join, materialize, tidy
from .graph import components

CHUNK = 512


def _compare(cells: DataFrame, payload: DataFrame, prepare: Callable, alike: Callable) -> DataFrame:
    """(u, v): links between the left and right members of each cell (cell, side 0 or 1, key, part).

    Right members stream by; those of one ``part`` (of a component) are known to be connected.
    """

    def scan(frames):
        import pandas as pd

        current, left, found = None, [], []
        root: dict = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for frame in frames:
            for cell, side, key, part, value in zip(frame["cell"], frame["side"], frame["key"], frame["part"], frame["value"], strict=True):
                if cell != current:
                    current, left, root = cell, [], {}
                own = prepare(value)
                if side == 0:
                    left.append((key, part, own))
                    continue
                for other, its, theirs in left:
                    a, b = find(part), find(its)
                    if a != b and other != key and alike(own, theirs):
                        root[max(a, b)] = min(a, b)
                        found.append((key, other))
            if len(found) > 10_000:
                yield pd.DataFrame(found, columns=["u", "v"])
                found = []
        yield pd.DataFrame(found, columns=["u", "v"])

    ready = cells.join(payload, "key").repartition("cell").sortWithinPartitions("cell", "side", "key")
    return ready.select("cell", "side", "key", "part", "value").mapInPandas(tidy(scan), "u long, v long")


def bucket_links(members: DataFrame, payload: DataFrame, prepare: Callable, alike: Callable, chunk: int = CHUNK) -> DataFrame:
    """(u, v): links with the same components as all alike pairs that share a bucket.

    ``members``: (bucket, key), each pair once; ``payload``: (key, value), each key once;
    ``alike(prepare(value), prepare(value))`` tells. A cell holds about ``chunk`` left members.
    """
    h = F.xxhash64("key")
    sizes = members.groupBy("bucket").agg(F.min("key").alias("rep"), F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).where("n > 1")
    # buckets of the same members are one
    sizes = materialize(sizes.groupBy("rep", "n", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket", "rep", "n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    inside = materialize(hub_join(members, sizes, "bucket", total))

    # each member and its bucket's least
    stars = materialize(inside.where("key <> rep").select("rep", "key").distinct())
    degree = materialize(stars.groupBy("rep").agg(F.count("*").alias("n")))
    salts = F.ceil(F.col("n") / chunk).cast("int")
    rays = hub_join(stars, degree, "rep", total).select(F.xxhash64("rep", F.pmod(F.xxhash64("key"), salts)).alias("cell"), F.lit(1).alias("side"), "key", F.col("key").alias("part"))
    hearts = degree.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    hearts = hearts.select(F.xxhash64("rep", F.col("salt").cast("long")).alias("cell"), F.lit(0).alias("side"), F.col("rep").alias("key"), F.col("rep").alias("part"))
    first = materialize(_compare(rays.unionByName(hearts), payload, prepare, alike))

    # members outside the largest component of a bucket, and all others
    joined = components(first).withColumnRenamed("node", "key")
    known = inside.where("n > 2").join(joined, "key", "left").select("bucket", "key", F.coalesce("component", "key").alias("part"))
    parts = known.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    split = parts.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("n")).where("most.n < n")
    split = materialize(split.select("bucket", F.col("most.part").alias("most"), F.ceil((F.col("n") - F.col("most.n")) / chunk).cast("int").alias("a"), F.ceil(F.col("n") / chunk).cast("int").alias("b"), "n"))
    open_ = materialize(hub_join(known, split, "bucket", total))
    row, column = F.pmod(F.xxhash64("key"), "a").cast("int"), F.pmod(F.xxhash64("key", F.lit(1)), "b").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = open_.where("part <> most").withColumn("i", row).withColumn("j", every("b")).withColumn("side", F.lit(0))
    right = open_.withColumn("j", column).withColumn("i", every("a")).withColumn("side", F.lit(1))
    cells = left.unionByName(right).select(F.xxhash64("bucket", "i", "j").alias("cell"), "side", "key", "part")
    return first.unionByName(_compare(cells, payload, prepare, alike))
