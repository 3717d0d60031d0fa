"""Ranked lexical search against brute force, and the queries with SQL of this round."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from seqlake.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RND = random.Random(2)
WORDS = [f"w{k}" for k in range(60)] + ["THE", "the", "Été", "été", "中文", "x_y", "don't", "a-b", " ", "42²"]


def text(n):
    return " ".join(RND.choice(WORDS[: RND.choice([5, 20, 70])]) for _ in range(n)) + RND.choice(["", ".", "\x00\n"])


DOCS = [(k * 2, text(RND.randint(1, 40))) for k in range(120)]
DOCS += [(500, None), (501, ""), (502, " .,\t"), DOCS[3], (DOCS[4][0], "the other w1 text"), (None, "w1 w2 the"), (503, "w1 " * 30000), *((600 + k, "w3 the same") for k in range(70))]
ITEMS = [(1, "w1, W2! the w1"), (2, None), (3, ""), (4, "nothing here knows"), (5, text(30)), (5, "w9 été 中文"), (None, "w3 w4"), (6, "the"), (7, "Été x 42²")]


def brute(docs, items, k):
    each = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    each = [(i, c) for i, c in each if c]
    n_docs, total = len(each), sum(c.total() for _, c in each)
    df = collections.Counter(t for _, c in each for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, own in asked.items():
        found = []
        for i, c in each:
            m = 100 - 50 + 50 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                found.append((-s, i is not None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda r: (r[0], r[1], r[2] or 0))[:k], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("k, rows", [(50, lexical.TABLE_ROWS), (3, 0)])
def test_search(spark, monkeypatch, k, rows):
    monkeypatch.setattr(lexical, "TABLE_ROWS", rows)  # 0: a shuffle by term in place of a broadcast
    monkeypatch.setattr(lexical, "POSTINGS", 40)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"term": F.lit("w1"), "score": F.lit(1), "row": F.lit(2), "item_id": F.lit(9)}).repartition(5)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({"doc_id": F.lit(0), "w": F.lit("w")})
    got = lexical.ranked(docs, items, k)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(DOCS, ITEMS, k)


def test_terms_are_those_of_the_pattern():
    rnd = random.Random(9)
    for _ in range(400):
        t = "".join(chr(rnd.choice([rnd.randrange(0x180), rnd.randrange(0x2000, 0x2100), 0x1F600, 0x130, 0x212A])) for _ in range(rnd.randrange(30)))
        assert [x.decode() for x in lexical.terms(t.encode()) if x] == TERM.findall(t.translate(LOWER))


def test_empty_tables_and_an_index_used_twice(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.ranked(docs.limit(0), items).count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0
    path = f"file://{tmp_path}/index"
    lexical.write_index(docs, path)
    index = lexical.open_index(spark, path)
    for some in (ITEMS[:1], ITEMS[4:]):
        got = lexical.search(index, spark.createDataFrame(some, "item_id long, text string"))
        assert sorted(repr(tuple(r)) for r in got.collect()) == brute(DOCS, some, 50)


@pytest.mark.parametrize("name", ["op12_lexical_search", "op13_vector_codes"])
def test_sql(spark, name):
    import duckdb

    from seqlake.llm import queries

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet'")
    want, got = con.sql(queries.oracle_sql()[name]), queries.queries()[name](spark, path)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(dict(zip(want.columns, r))[c] for c in columns)) for r in want.fetchall())
