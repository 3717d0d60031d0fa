"""Document fingerprints as Merkle trees over paragraphs and sections, in DataFrame functions only.

A text is cut by its content: a paragraph ends with sentence marks or line ends, or after ``PIECE``
characters; a section ends with a paragraph whose hash begins with 0 or 1 (one in eight). So an
insertion changes the paragraphs and sections that it touches, and those after it stay the same.
A paragraph's hash is the SHA-256 of its text, a section's that of its paragraphs' hashes, the
root's that of the sections' hashes: equal roots mean equal texts, and an edit is found by going
down the sections that differ.

A fingerprint is the root and the ``NODES`` least of the tree's nodes (paragraphs and sections, by
the first 32 bits of their hashes), so its size is bounded. The likeness of two fingerprints is the
share of the ``NODES`` least nodes of both that both hold: the Jaccard similarity of the trees'
nodes, exactly so for trees of few nodes, and estimated from a uniform sample for others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

PIECE, NODES, MARK = 64, 128, 8
BUCKET_ROWS, MOST_BUCKETS = 2048, 1 << 20
CUT = r"[^.!?\n]{1,%d}[.!?\n]*|[.!?\n]+" % PIECE


def paragraphs(text: Column) -> Column:
    """Paragraph hashes, in order; none for an empty text."""
    return F.transform(F.regexp_extract_all(text, F.lit(CUT), F.lit(0)), lambda p: F.sha2(p, 256))


def members(hashes: Column) -> Column:
    """Paragraph hashes by section: each section's, joined."""
    marked = F.transform(hashes, lambda h: F.concat(h, F.when(h < "2", ";").otherwise("")))
    return F.filter(F.split(F.array_join(marked, ""), ";", -1), lambda s: s != "")


def sections(parts: Column) -> Column:
    """Section hashes."""
    return F.transform(parts, lambda s: F.sha2(s, 256))


def grown(docs: DataFrame, text: str, tree: str) -> DataFrame:
    """``docs`` with column ``tree``: root and nodes of the tree over column ``text``."""
    rest = list(docs.columns)
    t = docs.withColumn("_p", paragraphs(F.col(text))).withColumn("_s", sections(members(F.col("_p"))))
    short = F.transform(F.concat("_p", "_s"), lambda h: F.substring(h, 1, MARK))
    nodes = F.slice(F.array_sort(F.array_distinct(short)), 1, NODES)
    return t.select(*rest, F.struct(F.sha2(F.array_join("_s", ""), 256).alias("root"), nodes.alias("nodes")).alias(tree))


def fingerprint(tree: str) -> Column:
    """Root (64 hex digits), a colon, and the nodes (``MARK`` digits each, ascending)."""
    return F.concat(F.col(tree)["root"], F.lit(":"), F.array_join(F.col(tree)["nodes"], ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of the least nodes of two trees that both hold, 0 to 1; 1 for two trees without nodes."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, NODES)
    return F.when(F.size(least) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(least, a), b)) / F.size(least))


def tree(docs: DataFrame) -> DataFrame:
    """doc_id, root, sections (hashes), members (the paragraph hashes of each section). Null text: empty."""
    t = texts(docs).withColumn("m", members(paragraphs(F.col("text")))).withColumn("sections", sections(F.col("m")))
    cut = F.transform("m", lambda s: F.regexp_extract_all(s, F.lit(".{64}"), F.lit(0)))
    return t.select("doc_id", F.sha2(F.array_join("sections", ""), 256).alias("root"), "sections", cut.alias("members"))


def edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, paragraph (from 0): which paragraphs of a new version its old one doesn't have, by ``tree`` of each.

    Only documents whose roots differ are looked into, and only sections that the other side lacks:
    a paragraph counts as kept if a differing section of the old version holds it. A document that
    one side lacks gives no row.
    """
    a = old.select("doc_id", F.col("root").alias("r"), F.col("sections").alias("s"), F.col("members").alias("m"))
    both = a.join(new, "doc_id").where("r != root")
    gone = F.expr("flatten(filter(m, (x, i) -> not array_contains(sections, s[i])))")
    down = both.select("doc_id", "s", "sections", "members", gone.alias("gone"), F.posexplode("sections").alias("k", "section")).where("not array_contains(s, section)")
    at = F.expr("aggregate(slice(members, 1, k), 0, (n, x) -> n + size(x))")
    leaf = down.select("doc_id", "gone", at.alias("at"), F.posexplode(F.expr("members[k]")).alias("i", "hash"))
    return leaf.where("not array_contains(gone, hash)").select("doc_id", (F.col("at") + F.col("i")).alias("paragraph"))


#: Where ids are cut into ranges: evenly, and ever finer toward both ends, so that ids far off don't widen the others' ranges.
_TAILS = [2.0**-j for j in range(7, 14)]
CUTS = sorted({k / 64 for k in range(1, 64)} | set(_TAILS) | {1 - x for x in _TAILS})


def ranges(docs: DataFrame) -> Column:
    """A number for each row that never falls as doc_id grows, -1 for null: ranges of about ``BUCKET_ROWS`` rows.

    Quantiles cut the ids; between two of them the ranges have equal width.
    """
    seen = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if seen["low"] is None:
        return F.lit(-1).cast("long")
    inner = docs.stat.approxQuantile("doc_id", CUTS, 1e-4)
    bounds, base, spread = [float(seen["low"])], [0], []
    for share, edge in zip([b - a for a, b in zip([0, *CUTS], [*CUTS, 1])], [*inner, float(seen["high"]) + 1]):
        if edge > bounds[-1]:
            many = max(1, min(int(seen["n"] * share / BUCKET_ROWS), MOST_BUCKETS // 128))
            spread.append((edge - bounds[-1]) / many)
            bounds.append(edge)
            base.append(base[-1] + many)
    x = F.col("doc_id").cast("double")
    at = sum(((x >= b).cast("int") for b in bounds[1:-1]), F.lit(1))
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), at)
    own = pick(base[:-1]) + F.floor((x - pick(bounds[:-1])) / pick(spread))
    return F.when(x.isNull(), -1).otherwise(F.least(own, pick(base[1:]) - 1)).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """Each row of (doc_id, text) with ``tree``, and the text and tree of the next in ascending doc_id.

    After the last comes the first. A null doc_id sorts first; equal ids are in order of their text.
    The first document of each range of ids is copied to the range before it, so every neighbour is
    in the same window without a sort of the whole table in a task. There are fewer than
    ``MOST_BUCKETS`` ranges, which bounds the table of first ids that is broadcast.
    """
    bucket = ranges(docs)
    firsts = docs.groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("first"))
    start = Window.orderBy("bucket")
    whole = start.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.lead("bucket").over(start).isNull()
    ahead = firsts.select(
        F.col("bucket").alias("before"),
        F.when(after, F.first("first").over(whole)).otherwise(F.lead("first").over(start)).alias("first"),
    )
    dealt = (
        grown(docs, "text", "tree")
        .join(F.broadcast(ahead), docs["doc_id"].eqNullSafe(ahead["first"]), "left")
        .withColumn("own", bucket)
        .select(
            "doc_id", "text", "tree",
            F.explode(F.expr("filter(array(struct(own as bucket, false as copy), struct(before as bucket, true as copy)), x -> x.bucket is not null)")).alias("at"),
        )
        .select("doc_id", "text", "tree", "at.bucket", "at.copy")
    )
    order = Window.partitionBy("bucket").orderBy("copy", "doc_id", "text")
    return (
        dealt.select("doc_id", "text", "tree", "copy", F.lead("text").over(order).alias("next_text"), F.lead("tree").over(order).alias("next_tree"))
        .where("not copy")
        .drop("copy")
    )


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document's. A null text counts as empty. Repeated rows each give a row.
    """
    t = with_next(texts(docs))
    kept, added = F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), F.expr("substring(next_text, 1, cast(n_chars div 2 as int))")
    t = t.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(kept, added))
    t = grown(t, "edited", "edited_tree")
    return t.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("tree").alias("fingerprint"), fingerprint("edited_tree").alias("edited_fingerprint"),
        likeness(F.col("tree.nodes"), F.col("edited_tree.nodes")).alias("near_edited"), likeness(F.col("tree.nodes"), F.col("next_tree.nodes")).alias("near_next"),
    )
