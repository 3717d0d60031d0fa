"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import dataclasses
import hashlib
import math
import os
import random
import re
import shutil
import zlib
from html import unescape

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqlake.llm import bpe, buckets, common, graph, html, lines, lm, merkle, packing, simhash, topk, toxicity, warc

PAGES = "/root/testdata/sf0.01/pages.parquet"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RND = random.Random(11)
SYLLABLES = "the of an er tion ing ou re ha is éa ß ñ".split()


def sentence(n):
    return " ".join("".join(RND.choice(SYLLABLES) for _ in range(RND.randint(1, 3))) + RND.choice(["", "", ",", "."]) for _ in range(n))


BASE = [sentence(60) + "\n" + sentence(40) for _ in range(12)]
TEXTS = [
    None, "", " \t\n", "one", "One  two", *BASE, BASE[0], BASE[0].upper(), BASE[1] + " tail", BASE[2].replace("the", "teh", 1),
    sentence(9000), "x" * 30000, "中文 текст Σας İ ß é 😀 <|endoftext|> it's 42²", BASE[3] + "\n" + BASE[3].split("\n")[0] + "!",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Null and repeated ids, a repeated row, and extra columns named like results and helpers."""
    rows = [(k * 3, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(TEXTS)]
    rows += [(None, "a row without an id", "en", "s", 1), rows[6], (rows[7][0], "same id, other text", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in ("score", "fingerprint", "component_id", "key", "rid", "block", "piece", "length", "n_lines", "train", "gone", "_rid", "toxicity", "_toxicity")}).repartition(3).transform(common.materialize)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def words(text):
    return WORD.findall(text.translate(LOWER))


def components_of(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    for n, m in ((1, 0), (30, 20), (60, 59), (200, 150)):
        pairs = [(k, k + 1) for k in range(m)] if n == 60 else [(RND.randrange(n), RND.randrange(n)) for _ in range(m)]
        want = components_of(n, pairs)
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
        assert got == {x: want[x] for p in pairs if p[0] != p[1] for x in p}


def test_key_filter(spark):
    keys = [RND.getrandbits(64) for _ in range(300)] + [0, (1 << 64) - 1]
    table = common.key_filter(spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys], "key long"))
    assert all(common.passes(table, k) for k in keys)
    assert sum(common.passes(table, RND.getrandbits(64)) for _ in range(1000)) < 5


# 1


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>menu</a></nav>
<div class="cookie-notice">We use</div><main><article><header><h1>Title</h1><p>By X</p></header><p>One &amp; two <b>bold<br>x <p>Short.</p>
<ul><li>a<li>b</ul><aside>rel</aside><form><p>f</p></form><script>var t="</p>";</script></article><section id="comments"><p>nice one</p></section></main><div class="ad">buy</div><footer>&copy; f"""


def test_html(spark):
    assert html.main_text(PAGE) == "Title\n\nOne & two bold x\n\nShort.\n\na\n\nb"
    long = "word " * 60
    assert html.main_text(f"<div class=menu><a href=1>x</a></div><div><h2>Head</h2><p>{long}</p><p>tail</p></div><div><a href=1>a link</a></div>") == f"Head\n\n{long.strip()}\n\ntail"
    table = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "v", "<p>" + "y" * 100000), (1, "u", PAGE), (4, "w", "<article><p>a &am b&amp c &#233;</p></article><p>out")]
    got = html.extract(spark.createDataFrame(table, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 100000), (1, 37), (1, 37), (2, 0), (3, 0), (4, 12)]
    assert {r.text for r in got if r.page_id == 4} == {"a &am b& c é"}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert np.allclose(html.smooth(np.array([5.0, 5, 5, 5])), 5)


def test_html_keeps_article_text():
    long = [f"{k} " + "word " * 60 + "end" for k in range(9)]
    body, whole = "".join(f"<p>{x}</p>" for x in long), "\n\n".join(long)
    for last in ("a last paragraph", long[0]):
        assert html.main_text(f"<body><div id=content><div>{body}</div><div><p>{last}</p></div></div>") == f"{whole}\n\n{last}"
    assert html.main_text(f"<body><div><h1>Title</h1></div><div><span>1</span> <a href=x>May</a></div><div class=share>x</div><div>{body}</div>").startswith("Title\n\n")
    linked = '<p>See <a href=1>a long name of a source</a></p>'
    assert html.main_text(f"<body><div>{body}{linked}<p>{long[0]}</p></div>") == f"{whole}\n\nSee a long name of a source\n\n{long[0]}"
    assert html.main_text(f"<body><div>{body}<ul><li><a href=1>one</a><li><a href=2>two</a></ul></div>") == whole
    for head in ("<body class='comments-open'><article>", "<body><article class='commentary'>", "<body><article class='post comments-open'>", "<body id=comments><div>", "<body><main class=comments><div>", "<body><div class=commentary>", "<body><div class='post comments-closed'>"):
        assert html.main_text(head + body) == whole
    assert html.main_text(f"<body><article>{body}</article><article class=comment><p>nice</p></article><div class=comment-list>{body}</div>") == whole


def test_html_clusters_select_in_articles():
    long = [f"{k} " + "word " * 60 + "end" for k in range(4)]
    body, whole = "".join(f"<p>{x}</p>" for x in long), "\n\n".join(long)
    links = "<li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a>"
    assert html.main_text(f"<body><article>{body}<ul>{links}</ul>{body}<div><a href=1>more</a> <a href=2>news</a></div></article>") == f"{whole}\n\n{whole}"
    assert html.main_text(f"<body><article><h1><a href=1>Title</a></h1>{body}<p>Yes.</p><p>No.</p><p>So.</p><p>it</p><p>went.</p></article>") == f"Title\n\n{whole}\n\nYes.\n\nNo.\n\nSo.\n\nit\n\nwent."
    table = "<table><tr><td><a href=1>Ann</a> <a href=2>B</a></td><td>some text about the two of them</td></tr></table>"
    assert html.main_text(f"<body><article>{body}{table}</article>") == f"{whole}\n\nAnn B\n\nsome text about the two of them"
    short = "".join(f"<article><p>{x}</p><p>b.</p><p>c.</p><p>d.</p></article>" for x in "xyz")
    assert html.main_text(f"<body><article>{body}</article>{short}") == whole + "".join(f"\n\n{x}\n\nb.\n\nc.\n\nd." for x in "xyz")
    assert html.main_text(f"<body><article><p>a.</p><p>b.</p><p>c.</p><p>d.</p></article><div><p>x</p><p>y</p><p>z</p>{body}</div>") == f"a.\n\nb.\n\nc.\n\nd.\n\nx\n\ny\n\nz\n\n{whole}"
    assert html.main_text(f"<body><article><ul>{links}</ul></article>") == "one\n\ntwo\n\nthree"


def test_html_doubt_references_titles():
    long = [f"{k} " + "word " * 60 + "end" for k in range(4)]
    body, whole = "".join(f"<p>{x}</p>" for x in long), "\n\n".join(long)
    works = "<li><a href=1>One work</a><li><a href=2>Two work</a>"
    assert html.main_text(f"<article>{body}<h2>References</h2><ul>{works}</ul></article>") == f"{whole}\n\nReferences\n\nOne work\n\nTwo work"
    assert html.main_text(f"<article>{body}<h2>References</h2><p>None.</p><ul>{works}</ul></article>") == f"{whole}\n\nReferences\n\nNone."
    for part in ("div class='related-work'", "section id='social'", "p class=promotion"):
        assert html.main_text(f"<article>{body}<{part}>Earlier work on the matter, by others.</{part.split()[0]}>{body}</article>") == f"{whole}\n\nEarlier work on the matter, by others.\n\n{whole}"
        assert html.main_text(f"<article>{body}<{part}>More</{part.split()[0]}>{body}</article>") == f"{whole}\n\n{whole}"
        assert html.main_text(f"<article>{body}<{part}><a href=1>Earlier work on the matter</a> here</{part.split()[0]}></article>") == whole
        assert html.main_text(f"<body><{part}>Earlier work on the matter, by others.</{part.split()[0]}><article>{body}</article>") == whole
    assert html.main_text(f"<article>{body}<div class='related comments'><p>{long[0]}</p></div><div class=ad>{long[0]}</div></article>") == whole
    assert html.main_text(f"<body><div class=logo><h1>Name</h1></div><article><h2>Title</h2>{body}</article>") == f"Title\n\n{whole}"
    assert html.main_text(f"<body><div><h1>Name</h1></div><article><h2>Title</h2>{body}</article>") == f"Title\n\n{whole}"
    assert html.main_text(f"<body><div><h1>Title</h1></div><p>May</p><article>{body}<h2>On</h2></article><h1>Next</h1>") == f"Title\n\n{whole}\n\nOn"


def plain_walk(page):
    """Blocks of the articles of a page of the given tables, from a tree that is built first and then walked."""
    root, stack = ("", [], []), []
    stack.append(root)
    for found in re.finditer(r"<!--.*?-->|<!\w[^>]*>|<(script|style)\b.*?</\1>|<(/?)(\w+)([^>]*)>|[^<]+", page, re.S):
        if found[3] is None:
            if not found[0].startswith("<"):
                stack[-1][2].append(unescape(found[0]))
            continue
        tag = found[3].lower()
        if found[2]:
            if any(x[0] == tag for x in stack):
                while stack.pop()[0] != tag:
                    pass
        else:
            if tag in ("p", "article", "footer") and any(x[0] == "p" for x in stack):
                while stack.pop()[0] != "p":
                    pass
            node = (tag, found[4].split(), [])
            stack[-1][2].append(node)
            if tag not in ("br", "meta"):
                stack.append(node)
    blocks = [[]]

    def walk(node, inside):
        tag, attrs, children = node
        if tag in ("nav", "footer", "title") or 'class="ad"' in attrs:
            return
        block = tag not in ("b", "br")
        if block:
            blocks.append([])
        for child in children:
            if isinstance(child, str):
                if inside:
                    blocks[-1].append(child)
            else:
                walk(child, inside or child[0] == "article")
        if block:
            blocks.append([])
        elif tag == "br" and inside:
            blocks[-1].append(" ")

    walk(root, False)
    return "\n\n".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test data")
def test_html_against_tree_walk(spark):
    got = html.extract(spark.read.parquet(PAGES)).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(PAGES).collect()}
    assert len(got) == len(pages) > 0
    for r in got:
        assert (r.text, r.n_chars) == (plain_walk(pages[r.page_id] or ""), len(r.text))


# 2


def plain_fingerprint(text):
    w = words(text)
    h = [xxhash.xxh64_intdigest(s, 42) for s in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else []))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, empty):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = components_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for (doc_id, _), r in zip(rows, root):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    want = sorted((repr(d), f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, root))
    assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_tree_finds_every_pair(spark):
    centres = [RND.getrandbits(64) for _ in range(60)]
    x = {c ^ sum(1 << RND.randrange(64) for _ in range(RND.randint(0, 4))) for c in centres for _ in range(12)} | {RND.getrandbits(64) for _ in range(800)}
    x = np.array(sorted(x), np.uint64)
    close = [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 3)]
    root = components_of(len(x), close)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    for options in ({}, {"leaf_rows": 100, "chunk_rows": 40}):
        got = {r.node: r.component for r in graph.components(simhash.links(df, 3, **options)).collect()}
        at = {int(v): k for k, v in enumerate(x.view(np.int64))}
        linked = {i for p in close for i in p}
        assert {at[n] for n in got} == linked
        assert all((got[int(x.view(np.int64)[i])] == got[int(x.view(np.int64)[j])]) == (root[i] == root[j]) for i in linked for j in linked)


def test_deduplicate(docs, rows):
    def sets(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    s = [sets(t) for _, t in rows]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    root = components_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(s[i], s[j])])
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns
    first = {}
    for (d, _), r in zip(rows, root):
        first[r] = min(first.get(r, (1 << 60)), -1 if d is None else d)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.select("doc_id").collect()) == sorted(first.values())
    assert simhash.deduplicate(docs.limit(0)).count() == 0
    assert simhash.deduplicate(docs, chunk=2).count() == got.count()


# 3


def lm_model(rng, size=lm.vocabulary_size(packing.vocabulary_path())):
    """A model of random tables and weights, each a distribution where it must be."""
    kinds, late = rng.integers(0, lm.CLASSES, size), np.append(rng.integers(0, lm.BEFORE, size), lm.BEFORE)
    follow = rng.dirichlet(np.ones(lm.CLASSES), lm.BEFORE + 1)
    within = rng.random((lm.BEFORE + 1, size)).astype(np.float32)
    for row in within:
        row /= np.bincount(kinds, row, lm.CLASSES)[kinds]
    weights = {k: (x + rng.normal(0, 0.3, x.shape)).astype(np.float32) for k, x in lm.new_weights().items()}
    embedding = rng.normal(0, 0.5, (size + 1, lm.FEATURES + 1)).astype(np.float32)
    return lm.Model(packing.vocabulary_path(), embedding, kinds, late, np.log(follow).astype(np.float32), np.log(within), weights)


def plain_class_logs(m, context):
    """log P of each class after the ids ``context`` of a window, one place at a time in float64."""
    w = {k: x.astype(float) for k, x in m.weights.items()}
    h = m.embedding[context].astype(float) @ w["in"] + w["place"][: len(context)]
    q, k, v, own = h[-1, : lm.KEY], h[:, lm.KEY : 2 * lm.KEY], h[:, 2 * lm.KEY : 2 * lm.KEY + lm.DIM], h[-1, 2 * lm.KEY + lm.DIM :]
    a = np.exp(k @ q)
    z = np.maximum(a / a.sum() @ v + own, 0) @ w["out"] + w["bias"] + m.follow[m.late[context[-1]]]
    return z - np.log(np.exp(z).sum())


def plain_scores(m, ids):
    """log P of the ids of a whole text, each in the first of the overlapping windows that holds it."""
    x, out = [len(m.kinds), *ids], []
    for t, y in enumerate(ids):
        start = 0 if t < lm.WINDOW else lm.STRIDE * -(-(t - lm.WINDOW + 1) // lm.STRIDE)
        out.append(plain_class_logs(m, np.array(x[start : t + 1]))[m.kinds[y]] + m.within[m.late[x[t]], y])
    return np.array(out)


def test_lm_gradient():
    rng = np.random.default_rng(0)
    m = lm_model(rng)
    w, embedding, follow = ({k: x.astype(float) for k, x in m.weights.items()}, m.embedding.astype(float), m.follow.astype(float))
    lengths = np.array([50, 5, 1, 200])
    ids = rng.integers(0, 3000, lengths.sum())
    at, take = lm.windows(lengths)
    assert np.bincount(at[take], minlength=len(ids)).tolist() == [1] * len(ids)
    last = lm.before(ids, lengths, len(m.kinds))
    parts = last[at], m.late[last][at], m.kinds[ids][at], take
    _, grad = lm.gradient(w, embedding, follow, *parts)
    for k in w:
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in w[k].shape)
            kept, loss = w[k][at], []
            for step in (1e-6, -1e-6):
                w[k][at] = kept + step
                loss.append(lm.gradient(w, embedding, follow, *parts)[0])
            w[k][at] = kept
            assert abs((loss[0] - loss[1]) / 2e-6 - grad[k][at]) < 1e-5
    assert all(np.allclose(x, grad[k]) for k, x in lm.gradient(w, embedding, follow, *parts, deep=False)[1].items())


def test_lm_against_a_plain_forward_pass():
    rng = np.random.default_rng(1)
    m = lm_model(rng)
    assert math.isclose(np.exp(plain_class_logs(m, rng.integers(0, 3000, 9))).sum(), 1)
    assert np.allclose(np.bincount(m.kinds, np.exp(m.within[3]), lm.CLASSES), 1, atol=1e-3)
    lengths = np.array([1, 31, 32, 33, 57, 140])
    ids = rng.integers(0, len(m.kinds), lengths.sum())
    want = [plain_scores(m, x.tolist()) for x in np.split(ids, np.cumsum(lengths)[:-1])]
    assert np.allclose(lm.id_scores(m, ids, lengths), np.concatenate(want), atol=1e-3)


def test_lm_attention_of_any_size():
    """Large products of asks and keys are taken as they are."""
    m = lm_model(np.random.default_rng(4))
    m.weights["in"][:, : 2 * lm.KEY] *= 8
    ids, lengths = np.random.default_rng(5).integers(0, len(m.kinds), 90), np.array([1, 89])
    h = m.embedding[ids] @ m.weights["in"] + m.weights["place"][3]
    assert np.abs(h[:, : lm.KEY] @ h[:, lm.KEY : 2 * lm.KEY].T).max() > 60
    want = [plain_scores(m, x.tolist()) for x in np.split(ids, np.cumsum(lengths)[:-1])]
    assert np.allclose(lm.id_scores(m, ids, lengths), np.concatenate(want), atol=2e-3)


def test_lm_looks_up_distinct_words():
    asked = []

    class Known(lm.Places):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    some, known = ("", "  a\x1cB\x85c \t\n\x0b\x0c\r\xc4 \xc4 ", " ", "x y X\xa0z x", "b\0 x"), Known()
    places, each = lm._places(some, known)
    assert each.tolist() == [len(words(t)) for t in some]
    assert [list(known)[k].decode() for k in places] == [w for t in some for w in words(t)] and len(asked) == len(set(asked)) == len(known)
    for t in ("", " "):
        assert [x.tolist() for x in lm._places((t,), lm.Places())] == [[], [0]]


def test_lm_scores(docs, rows, empty):
    got = sorted(lm.scores(docs).collect(), key=lambda r: (repr(r.doc_id), r.n_tokens, r.base_score))
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    c = collections.Counter(w for (_, t), h in zip(rows, held) if not h for w in words(t))
    ends = held.count(False)
    n, v = sum(c.values()) + ends, len(c) + 1
    want = []
    for (d, t), h in zip(rows, held):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)) + math.log10((ends + 1) / (n + v + 1))
        want.append((repr(d), len(words(t)) + 1, base, h, sum(c[w] > 0 for w in words(t)) + 1))
    want.sort(key=lambda r: r[:3])
    for r, w in zip(got, want, strict=True):
        assert (repr(r.doc_id), r.n_tokens, r.held_out, r.n_known, r.train_tokens) == (w[0], w[1], w[3], w[4], n)
        assert math.isclose(r.base_score, w[2], rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0
    assert lm.scores(empty).count() == 0
    # the same texts by a plain pass over all ids of each, word by word
    m, encode = lm_model(np.random.default_rng(3)), packing.encoder(packing.vocabulary_path(), ordinary=True)
    want = []
    for d, t in rows:
        some = [encode(" " + w) for w in words(t)] + [[packing.END]]
        logs = iter(plain_scores(m, [i for x in some for i in x]))
        spelled = [sum(next(logs) for _ in x) for x in some]
        known = [c[w] for w in words(t)] + [ends]
        want.append((repr(d), len(some), sum(math.log10(lm.SPELLED * math.exp(s) + (1 - lm.SPELLED) * k / n + 1e-320) if s > -700 or k else s / math.log(10) + math.log10(lm.SPELLED) for s, k in zip(spelled, known))))
    got = sorted((repr(r.doc_id), r.n_tokens, r.score) for r in lm.scores(docs, model=m).collect())
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:2] == w[:2] and math.isclose(g[2], w[2], rel_tol=1e-4)


def test_lm_encodes_distinct_words_once(rows, monkeypatch):
    """Words of a row are encoded once each, in order of frequency; places give every text's ids."""
    import types

    import pyarrow as pa
    import pyspark

    path, encoded, encode = packing.vocabulary_path(), [], lm.list_ids
    monkeypatch.setattr(pyspark, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(lm, "list_ids", lambda some, path: encoded.extend(some) or encode(some, path))
    monkeypatch.setattr(lm, "ENCODE_CHARS", 50)
    some = [(d, t or "", k % 3 > 0) for k, (d, t) in enumerate(rows)] * 2
    frame = pa.RecordBatch.from_pylist([{"doc_id": d, "text": t, "train": x} for d, t, x in some], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("train", pa.bool_())]))
    table = types.SimpleNamespace(select=lambda *_: types.SimpleNamespace(mapInArrow=lambda scan, _: scan))
    for most in (lm.BLOCK_IDS, 300):
        monkeypatch.setattr(lm, "BLOCK_IDS", most)
        encoded.clear()
        found = [b.to_pylist()[0] for b in lm.encode_blocks(table, path)(iter([frame]))]
        assert [r["block"] for r in found] == [(3 << 32) + k for k in range(len(found))] and (len(found) > 1) == (most == 300)
        assert len(encoded) == sum(len(r["keys"]) // 8 - 1 for r in found)
        got = []
        for r in found:
            places, counts, sizes, ids = (lm.unpack(r[c]).astype(int) for c in ("places", "counts", "sizes", "ids"))
            keys, often = np.frombuffer(r["keys"], np.uint64), np.bincount(places)
            assert np.array_equal(lm.word_keys(ids.astype(np.uint32), path), keys) and len(set(keys.tolist())) == len(keys) and np.all(np.diff(often) <= 0)
            assert np.array_equal(counts, np.bincount(places[np.repeat(r["trains"], r["words"])], minlength=len(keys)))
            each = np.split(places, np.cumsum(r["words"])[:-1])
            got += [(d, x, lm._gather(ids, sizes, p).tolist()) for d, x, p in zip(r["doc_ids"], r["trains"], each, strict=True)]
        assert got == [(d, x, lm.text_ids(t, path).tolist()) for d, t, x in some]


def test_lm_totals(docs, rows):
    path = packing.vocabulary_path()
    blocks = lm.encode_blocks(common.texts(docs).withColumn("train", F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))), path).transform(common.materialize)
    want = collections.Counter(i for d, t in rows if d is not None and d % 2 == 1 for i in lm.text_ids(t or "", path).tolist())
    got = lm.id_totals(blocks, lm.vocabulary_size(path))
    assert {k: int(n) for k, n in enumerate(got) if n} == want


def test_lm_learns(spark):
    """Two kinds of texts: the model tells them apart from context, which counts of words can't."""
    rnd = random.Random(9)
    some = [[f"{a}{b}" for a in x for b in "xyzuvw"] for x in (("ka", "lo", "mi"), ("re", "so", "tu"))]
    table = spark.createDataFrame([(k, " ".join(rnd.choices(some[k % 2], k=60))) for k in range(300)], "doc_id long, text string")
    got = [r for r in lm.scores(table).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.1 * sum(r.n_tokens for r in got)


def test_lm_ids():
    path = packing.vocabulary_path()
    encode, named = packing.encoder(path, ordinary=True), {}
    some = [t or "" for t in TEXTS] + ["a\xa0 b \xa0c \u2003 <|endoftext|> \x1c x", "\xa0"]
    for t in some:
        ids = lm.text_ids(t, path)
        assert ids.tolist() == [i for w in words(t) for i in encode(" " + w).tolist()] + [packing.END]
        keys = lm.word_keys(ids, path).tolist()
        for w, k in zip([*words(t), ""], keys, strict=True):
            assert named.setdefault(w, k) == k
    assert len(set(named.values())) == len(named)


# 4


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary_path())
    got = packing.pack(docs).collect()
    want = collections.Counter()
    for d, t in rows:
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4")
        want.update((d, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids))))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty).count() == 0
    assert packing.cut(1024) == [(0, 1024)] and packing.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)]


def test_packing_is_dense():
    rnd = random.Random(3)
    lengths = collections.Counter(rnd.randint(1, 1024) for _ in range(20000))
    plan, used = packing.plan_large(lengths)
    fill = np.zeros(used, np.int64)
    for n, c in lengths.items():
        if n > packing.SMALL:
            np.add.at(fill, packing.sequence_of(plan, np.full(c, n), np.arange(c)), n)
    assert fill.max() <= 1024
    rooms = collections.Counter((1024 - fill[fill < 1024]).tolist())
    small, new = packing.plan_small({n: c for n, c in lengths.items() if n <= packing.SMALL}, rooms)
    total = sum(n * c for n, c in lengths.items())
    assert used + new <= 1.01 * -(-total // 1024)
    for n, table in small.items():  # no place is given twice, and lengths fit their rooms
        assert (np.diff(table[:, 0]) > 0).all() and (table[:, 1] >= n).all()
    pairs = packing.configurations([700, 324, 200], [10, 10, 3])
    assert sum(t for _, t in pairs) == 11 and sum(p[0] * t for p, t in pairs) >= 10


def test_ids_of_both_libraries():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(packing.vocabulary_path()), packing.encoder(packing.vocabulary_path())
    some = [f"a{chr(c)}b 1{chr(c)}2 .{chr(c)}. {chr(c)}{chr(c)}  x" for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000] + [t or "" for t in TEXTS]
    assert all(e.ids == own(t) for t, e in zip(some, tok.encode_batch(some, add_special_tokens=False)))


# 5


def test_lm_every_step_teaches_all_weights(spark, tmp_path, monkeypatch):
    path, whole, said = packing.vocabulary_path(), lm.gradient, str(tmp_path / "steps")

    def gradient(w, *parts, **kinds):
        loss, grad = whole(w, *parts, **kinds)
        with open(said, "a") as f:
            print(int(parts[5].sum()), *sorted(grad), file=f)
        return loss, grad

    monkeypatch.setattr(lm, "gradient", gradient)
    monkeypatch.setattr(lm, "LEAST_STEPS", 1)
    monkeypatch.setattr(lm, "BATCH", 8)
    rnd = random.Random(8)
    some = [" ".join(rnd.choice(SYLLABLES) for _ in range(150)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").coalesce(1)
    blocks = common.materialize(lm.encode_blocks(docs.withColumn("train", F.col("doc_id") % 8 < 7), path))
    weights = lm.new_weights()
    fitted = lm.fit(blocks, dataclasses.replace(lm_model(np.random.default_rng(6)), weights=weights))
    steps = [x.split() for x in open(said)]
    assert len(steps) > 8 and {tuple(x[1:]) for x in steps} == {tuple(sorted(weights))}
    assert sum(int(x[0]) for x in steps) == sum(len(lm.text_ids(t, path)) for k, t in enumerate(some) if k % 8 < 7)
    assert all((fitted[k] != weights[k]).any() for k in weights)


def test_bpe(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.vocabulary_path())

    def whole(t):
        ids = tok.encode(t, add_special_tokens=False).ids
        return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)))

    want = sorted((repr(d), *whole(t)) for d, t in rows)
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs).collect()) == want
    assert bpe.encode(empty).count() == 0


def test_splitter():
    from tokenizers import Tokenizer

    tok, split = Tokenizer.from_file(bpe.vocabulary_path()), bpe.splitter(bpe.vocabulary_path())
    chars = [chr(c) for c in [*range(0x250), 0x300, 0x3A3, 0x3C2, 0x4E2D, 0x1F600, 0x2003, 0x200B, 0x212B, 0x1E9E, 0xFEFF]]
    rnd = random.Random(4)
    for k in range(3000):
        t = "".join(rnd.choice(chars if k % 2 else chars[:0x180]) if rnd.random() < 0.7 else rnd.choice(["'s", "'LL", " ", "<|endoftext|>", "ab", "É"]) for _ in range(rnd.randint(0, 10)))
        assert [i for w in split(t) for i in tok.encode(w, add_special_tokens=False).ids] == tok.encode(t, add_special_tokens=False).ids


# 6


def test_toxicity_learns(spark):
    rnd = random.Random(5)
    bad, text, label = ["moron", "trash", "loserly", "losers"], [], []
    for k in range(500):
        w = sentence(40).split()
        if k % 4 == 0:
            w[rnd.randrange(40)] = rnd.choice(bad)
        text.append(" ".join(w))
        label.append(int(k % 4 == 0))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(text)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, y in enumerate(label)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(df, labels).collect()}
    held = [k for k in got if got[k].held_out]
    assert held == [k for k in got if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k].predicted == label[k] for k in held) >= 0.95 * len(held)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.classify(df, flipped).collect()}
    assert all(again[k] == got[k].score for k in got)


def test_toxicity_is_trained_in_a_task(spark, monkeypatch):
    """The driver gets the model, not the texts; it is the one that the collected sample gives."""
    df = spark.createDataFrame([(k, f"word{k % 7} good{k % 3}" if k % 2 else f"word{k % 5} bad{k % 3} ä\U0001f600") for k in range(60)] + [(3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(50)], "doc_id long, toxic int")
    trained = common.crc32_of_id() % 5 != 0
    model, cuts = toxicity.fit(*toxicity.sample(df, labels, trained))
    want = sorted((r.doc_id, r.score) for r in toxicity.score(df, model, cuts, "doc_id").collect())
    monkeypatch.setattr(toxicity, "sample", None)
    got = sorted((r.doc_id, r.score) for r in toxicity.classify(df, labels).collect())
    assert np.allclose(got, want, atol=1e-5)
    assert toxicity.clean(df, labels).count() == sum(x < 0.5 for _, x in want)


def test_toxicity_against_a_plain_forward_pass():
    rng = np.random.default_rng(4)
    m = {k: rng.normal(0, 0.5, x.shape).astype(np.float32) for k, x in toxicity.new_model().items()}
    some = [t or "" for t in TEXTS[:9]] + [TEXTS[-1]]
    got = toxicity.logits(m, toxicity.read(some))
    for text, z in zip(some, got, strict=True):
        own = [m["E"][list(toxicity.features(w))].sum(0) for w in re.findall(r"[^\W_]+", text.lower())]
        row = [np.zeros(toxicity.DIM)] * toxicity.PAD + own + [np.zeros(toxicity.DIM)] * toxicity.PAD
        top = []
        for w in toxicity.WIDTHS:
            each = [sum(row[p + j] @ m[f"K{w}"][j] for j in range(w)) + m[f"c{w}"] for p in range(len(own) + toxicity.PAD)]
            top += list(np.max(each, 0))
        assert math.isclose(z, np.maximum(top, 0) @ m["w"] + m["b"][0], rel_tol=1e-3, abs_tol=1e-3)


def test_toxicity_learns_from_every_labelled_row(spark):
    """However many rows a label has, and whatever their length."""
    rows = [(k, f"word{k % 11} {'bad' if k % 2 else 'good'}{k % 7}") for k in range(8500)] + [(9001, "long " * 6_100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    trained = common.crc32_of_id() % 5 != 0
    ids = {k for k, _ in rows if zlib.crc32(str(k).encode()) % 5}
    assert 9001 in ids and min(sum(k % 2 == y for k in ids) for y in (0, 1)) > 3000
    got = toxicity.encode_parts(df, toxicity._known(labels, trained), trained, 1).select("learned", "kept").collect()
    assert [x + y for x, y in zip(got[0].learned, got[0].kept, strict=True)] == [sum(k % 2 == y for k in ids) for y in (0, 1)]
    texts, label = toxicity.sample(df, labels, trained)[:2]
    assert sorted(texts) == sorted(t for k, t in rows if k in ids) and label.sum() == sum(k % 2 for k in ids)


def test_toxicity_in_parts(spark, tmp_path, monkeypatch):
    """Several parts pass over every row that teaches in each round; what they make is near what one part makes."""
    rnd, whole, said = random.Random(12), toxicity.passed, str(tmp_path / "rows")

    def passed(model, words, label, rows, r):
        with open(said, "a") as f:
            print(r, len(rows), file=f)
        return whole(model, words, label, rows, r)

    rows = []
    for k in range(1200):
        w = [rnd.choice(SYLLABLES) + rnd.choice(SYLLABLES) for _ in range(30)]
        if k % 3 == 0:
            w[rnd.randrange(30)] = rnd.choice(["moron", "trash", "losers"])
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame([*rows, rows[5], (None, "no id"), (5000, "no label")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(1200)] + [(6000, 1), (7, None)], "doc_id long, toxic int")
    one = {r.doc_id: r for r in toxicity.classify(df, labels).collect()}
    monkeypatch.setattr(toxicity, "passed", passed)
    monkeypatch.setattr(toxicity, "PART_CHARS", 20_000)
    got = {r.doc_id: r for r in toxicity.classify(df, labels).collect()}
    steps = [tuple(map(int, x.split())) for x in open(said)]
    assert (n := sum(r == 0 for r, _ in steps)) > 5
    trained = common.crc32_of_id() % 5 != 0
    parts = toxicity.encode_parts(common.texts(df), toxicity._known(labels, trained), trained, n).select("learned", "kept").collect()
    assert sum(sum(x.learned) + sum(x.kept) for x in parts) == sum(zlib.crc32(str(k).encode()) % 5 > 0 for k in [*range(1200), 5])
    for r in range(toxicity.EPOCHS):
        assert sum(n for x, n in steps if x == r) == sum(sum(x.learned) for x in parts)
    held = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 5 == 0]
    for found in (one, got):
        assert sum(found[k].predicted == int(k % 3 == 0) for k in held) >= 0.95 * len(held)
    again = {r.doc_id: r.score for r in toxicity.classify(df.repartition(5), labels).collect()}
    assert all(abs(again[k] - got[k].score) < 1e-4 for k in got)


def test_toxicity_words_joined_and_cut(monkeypatch):
    some = [TEXTS[5], "", TEXTS[6], " ".join(BASE), TEXTS[8]]
    rng = np.random.default_rng(4)
    m = {k: rng.normal(0, 0.5, x.shape).astype(np.float32) for k, x in toxicity.new_model().items()}
    want = toxicity.logits(m, toxicity.read(some))
    both = toxicity.joined([toxicity.read(some[:2]), toxicity.read(some[2:])])
    assert np.allclose(toxicity.logits(m, both), want, atol=1e-4)
    assert np.allclose(toxicity.logits(m, toxicity.some_of(both, np.array([3, 1]))), want[[3, 1]], atol=1e-4)
    monkeypatch.setattr(toxicity, "SLICE", 7)
    assert np.allclose(toxicity.logits(m, both), want, atol=1e-4)


def test_toxicity_gradient():
    rng = np.random.default_rng(9)
    m = {k: rng.normal(0, 0.5, x.shape) for k, x in toxicity.new_model().items()}
    words, label = toxicity.read([t for t in TEXTS[3:12]]), np.arange(9) % 2

    def loss():
        z = toxicity.logits(m, words)
        return (np.log1p(np.exp(z)) - label * z).mean()

    grad, rows = toxicity._step(m, words, label)
    for k in m:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in grad[k].shape)
            own = (rows[at[0]], *at[1:]) if k == "E" else at
            was, both = m[k][own], []
            for step in (1e-6, -1e-6):
                m[k][own] = was + step
                both.append(loss())
            m[k][own] = was
            assert abs((both[0] - both[1]) / 2e-6 - grad[k][at]) < 1e-4


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(9, 1), (12, 0), (12, 1), (None, 1), (15, None)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.classify(empty, labels).count() == 0
    none = toxicity.classify(docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1 and not any(r.predicted for r in none)
    assert toxicity.clean(docs, labels.limit(0)).columns == docs.columns


# 7


def plain_tree(text):
    """(fingerprint, its nodes)."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    leaves, parts = [sha(x) for x in re.findall(r"[^.!?\n]{1,64}[.!?\n]*|[.!?\n]+", text)], [""]
    for x in leaves:
        parts[-1] += x
        if x[0] in "01":
            parts.append("")
    parts = [sha(x) for x in parts if x]
    nodes = sorted({x[:8] for x in leaves + parts})[:128]
    return sha("".join(parts)) + ":" + "".join(nodes), nodes


def plain_likeness(a, b):
    least = sorted({*a[1], *b[1]})[:128]
    return len([x for x in least if x in a[1] and x in b[1]]) / len(least) if least else 1.0


def test_fingerprints(docs, rows, empty):
    got = merkle.document_fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = collections.Counter()
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want[(d, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got}) == len({t for _, t in rows})
    trees = {t: plain_tree(t) for _, t in rows}
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id, r.n_chars, r.edited_sha256].append((r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)))
    for k, (d, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        edited = plain_tree(e := t[: len(t) - half] + after[:half])
        assert (trees[t][0], edited[0], round(plain_likeness(trees[t], edited), 9), round(plain_likeness(trees[t], trees[after]), 9)) in by[d, len(t), hashlib.sha256(e.encode()).hexdigest()]
    assert all(r.near_edited >= 0.2 for r in got if r.n_chars > 300 and r.n_chars < 20000)
    assert merkle.document_fingerprints(empty).count() == 0
    plan = merkle.document_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_neighbours_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 3)
    ids = sorted({RND.randrange(-(1 << 62), 1 << 62) for _ in range(40)}) + [1 << 62]
    df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in merkle.with_next(df).collect()}
    assert got == {i: f"text {(k + 1) % len(ids)}" for k, i in enumerate(ids)}
    one = spark.createDataFrame([(5, "only")], "doc_id long, text string")
    assert merkle.with_next(one).first().next_text == "only"


def test_edits_are_located(spark):
    old = [f"line number {k} of the text.\n" for k in range(60)]
    new = ["put before all.\n", *old[:17], "changed.\n", *old[18:40], *old[41:], "added."]
    a, b = (merkle.tree(spark.createDataFrame([(1, "".join(x)), (2, "same"), (3, None)], "doc_id long, text string")) for x in (old, new))
    assert sorted((r.doc_id, r.paragraph) for r in merkle.edits(a, b).collect()) == [(1, 0), (1, 18), (1, 60)]
    one, two = (x.where("doc_id = 1").first().sections for x in (a, b))
    assert len(set(one) & set(two)) >= len(one) - 4


def test_ranges_with_ids_far_off(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 10)
    df = spark.createDataFrame([(k, "t") for k in [*range(4000), 1 << 61, -(1 << 61)]], "doc_id long, text string")
    got = df.select("doc_id", merkle.ranges(df).alias("b")).collect()
    by = [r.b for r in sorted(got)]
    assert by == sorted(by) and max(collections.Counter(by).values()) <= 80


def test_sql(spark, empty):
    """The queries with SQL against it."""
    import duckdb

    from seqlake.llm import queries

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet'")
    for name in ("op7_document_fingerprints", "op9_exact_top_k"):
        want, got = con.sql(queries.oracle_sql()[name]), queries.queries()[name](spark, path)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(dict(zip(want.columns, r))[c] for c in columns)) for r in want.fetchall())


# 8


def dp(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutate(rnd, text, k):
    for _ in range(k):
        at = rnd.randint(0, len(text))
        text = text[:at] + rnd.choice(["", "a", "é"]) + text[at + rnd.randint(0, 1) :]
    return text


def test_edit_distance_and_segments():
    rnd = random.Random(6)
    for _ in range(3000):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randint(0, 90)))
        b, most = mutate(rnd, a, rnd.randint(0, 6)), rnd.randint(0, 4)
        assert lines.edit_distance(a, b, most) == min(dp(a, b), most + 1)
    for _ in range(1500):
        most = rnd.choice([1, 2, 3])
        a = "".join(rnd.choice("abcdefg ") for _ in range(rnd.randint(24, 60)))
        b = mutate(rnd, a, most)
        if a != b and min(len(a), len(b)) >= 24 and dp(a, b) <= most:
            points = np.frombuffer((a + "\n" + b).encode("utf-32-le"), "<u4")
            found = lines.signatures(points, np.array([0, len(a) + 1]), np.array([len(a), len(b)]), np.array([1, 2], np.uint64), most, 24)
            assert lines.groups(*found)


def brute_lines(rows, most=2, least=24):
    each = [(d is not None, d or 0, n, k, x) for n, (d, t) in enumerate(rows) for k, x in enumerate(t.split("\n"))]
    keys = list(dict.fromkeys(x for *_, x in each if x.strip()))
    root = components_of(len(keys), [(i, j) for i in range(len(keys)) for j in range(i) if min(len(keys[i]), len(keys[j])) >= least and abs(len(keys[i]) - len(keys[j])) <= most and lines.edit_distance(keys[i], keys[j], most) <= most])
    kind = dict(zip(keys, root))
    return each, kind


def test_line_dedup(spark, docs, rows, empty):
    base = ["some line that is long enough to be compared", "another line of quite some length, too", "short", "", "  "]
    extra = [(100, "\n".join(base)), (101, "\n".join([base[0] + "!", base[1].replace("quite", "quiet"), "short", "shorT", ""])), (102, "\n".join([base[0] + "!?", "unique line of this document only", "short"])), (103, base[0] + "!?ab")]
    table = spark.createDataFrame(extra, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.dedup(table).collect()}
    assert got == {100: ("\n".join(base), 5, 0), 101: ("shorT\n", 5, 3), 102: ("unique line of this document only", 3, 2), 103: ("", 1, 1)}
    result = lines.dedup(docs)
    each, kind = brute_lines(rows)
    left = sorted(x for r in result.collect() for x in r.text.split("\n") if x.strip())
    firsts = {}
    for *place, x in sorted(each):
        if x.strip():
            firsts.setdefault(kind[x], x)
    assert len(left) == len(firsts) and sorted(kind[x] for x in left) == sorted(firsts)
    assert result.columns == [*[c for c in docs.columns if c != "n_lines"], "n_lines", "n_dropped"]
    assert lines.dedup(empty).count() == 0


def test_line_groups_in_chunks(spark):
    rnd = random.Random(7)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(60))
    some = sorted({mutate(rnd, base, rnd.randint(1, 3)) for _ in range(80)} | {base[:30] + "".join(rnd.choice("xyz") for _ in range(30)) for _ in range(30)})
    table = spark.createDataFrame([(k, x) for k, x in enumerate(some)], "rid long, text string").withColumn("doc_id", F.col("rid"))
    root = components_of(len(some), [(i, j) for i in range(len(some)) for j in range(i) if min(len(some[i]), len(some[j])) >= 24 and dp(some[i], some[j]) <= 2])
    want = sorted(sorted(k for k, r in enumerate(root) if r == x) for x in set(root) if root.count(x) > 1)
    names = {lines._name(x): k for k, x in enumerate(some)}
    for chunk in (512, 7):
        found = collections.defaultdict(list)
        for r in graph.components(lines.links(table, 4, chunk=chunk)).collect():
            found[r.component].append(names[r.node % (1 << 64)])
        assert sorted(map(sorted, found.values())) == want


def test_bucket_links(spark):
    """Numbers are alike if they differ by one: chains, a hub, unlike members, several components in a bucket."""
    rnd = random.Random(10)
    sets = [rnd.sample(range(400), n) for n in (2, 3, 40, 60, 120, 120)] + [list(range(500, 560)), [700, *range(800, 830, 2)]]
    pairs = {(b, k) for b, own in enumerate([*sets, sets[2]]) for k in own}
    members = spark.createDataFrame(sorted(pairs), "bucket long, key long")
    payload = spark.createDataFrame([(k, str(k)) for k in sorted({k for _, k in pairs})], "key long, value string")
    root = components_of(900, [(a, b) for own in sets for a in own for b in own if b < a <= b + 1])
    for chunk in (512, 5):
        got = {r.node: r.component for r in graph.components(buckets.bucket_links(members, payload, int, lambda a, b: abs(a - b) <= 1, chunk)).collect()}
        assert {k: root[k] for k in range(900) if root.count(root[k]) > 1} == got
    assert buckets.bucket_links(members.limit(0), payload, int, int.__eq__).count() == 0


def test_hub_join_without_hubs(spark):
    """A key is a hub above a thousand rows: with none the plan is one join."""
    rows = spark.range(3000).select((F.col("id") % 30).alias("k"), F.col("id").alias("x"))
    each = common.materialize(rows.groupBy("k").agg(F.count("*").alias("n")))
    got = common.hub_join(rows, each, "k", 3000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(each, "k").collect())) and got.columns == ["k", "x", "n"]
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_hub_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HUBS", 3)
    rows = spark.range(9000).withColumn("k", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50))
    each = common.materialize(rows.groupBy("k").agg(F.max("id").alias("top"), F.count("*").alias("n")))
    got = common.hub_join(rows, each, "k", 9000)
    assert got.count() == 9000 and got.where("id > top").count() == 0
    assert sorted(r.id for r in got.collect()) == list(range(9000))
    common.discard(each)


# 9


def test_top_k(spark):
    rnd = random.Random(8)
    data = [(k, [rnd.uniform(-1, 1) for _ in range(8)]) for k in range(150)] + [(k, [0.5] * 8) for k in range(150, 260)]
    odd = [(400, None), (420, [None] + [0.0] * 7), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (None, [0.1] * 8), (480, [0.25, 0.5]), (481, [1.0, -1.0])]
    table = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>").withColumns({"score": F.lit("clash"), "rank": F.lit(1)}).repartition(3)
    vectors = {k: [math.floor(64 * float(np.float32(x))) for x in v] for k, v in data}
    for options in ({}, {"shard_rows": 40, "block_rows": 5}):
        got = collections.defaultdict(list)
        for r in topk.top_k(table, **options).orderBy("query_id", "rank").collect():
            got[r.query_id].append((-r.score, r.vec_id))
        want = {q: sorted((-sum(a * b for a, b in zip(vectors[q], v)), k) for k, v in vectors.items() if k != q)[:20] for q in vectors if q % 20 == 0}
        want[480] = [(-(16 * 64 - 32 * 64), 481)]
        assert got == want
    assert topk.top_k(table.limit(0)).count() == 0
    assert topk.scores(np.array([[2**40]]), np.array([[2**15]]))[0, 0] == 2**55
    with pytest.raises(OverflowError):
        topk.scores(np.array([[2**40]]), np.array([[2**40]]))
    assert topk.scores(np.array([[2**62, 2**62]]), np.array([[4, -4]]))[0, 0] == 0


@pytest.mark.parametrize("dim", [1, 2, 7, 16])
def test_top_k_bounds_lose_nothing(dim):
    """Entries that reach the cutoff are collected with their exact score, whether few or many do."""
    rng = np.random.default_rng(dim)
    q, c = (rng.integers(-90, 90, (n, dim)) * rng.integers(1, 9, (n, 1)) for n in (30, 400))
    exact = q @ c.T
    shares = []
    for place in (0, 5, 200, 399):
        least = -np.sort(-exact, axis=1)[:, place]
        found, collected = topk.reaching(q, c, least)
        reach = exact >= least[:, None]
        assert (collected | ~reach).all() and (found[collected] == exact[collected]).all()
        shares.append(collected.mean())
    assert shares[0] <= shares[-1]
    big = q.astype(np.int64) << 38
    assert (topk.reaching(big, c, least)[0] == big @ c.T).all() and topk.reaching(big, c, least)[1].all()
    assert topk.reaching(q, c, np.full(len(q), topk.NO_CUTOFF))[1].all()


# 10


def test_warc(spark, tmp_path):
    table = [(k, f"http://x/{k}", f"<p>page {k} é\r\n\r\nWARC/1.1</p>" * (k % 5)) for k in range(150)] + [(None, None, None), (3, "http://x/3", "other"), (3, "http://x/3", "other")]
    pages = spark.createDataFrame(table, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(4)
    recs = warc.records(pages, 40)
    warc.write(recs, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w")).collect()
    assert collections.Counter(bytes(r.body).decode() for r in back) == collections.Counter(h or "" for *_, h in table)
    leaf = warc.leaves(recs).collect()
    assert sorted((r.start, r.length) for r in back) == sorted((r.start, r.length) for r in leaf)
    for fanout in (2, 16):
        damaged = F.when(F.expr("page_id % 37 = 5 and html <> ''"), F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
        got = warc.fixity(pages, damaged, 40, fanout).collect()
        assert len(got) == len(table)
        assert sorted(r.page_id for r in got if not r.intact) == [k for k in range(150) if k % 37 == 5 and k % 5]
    one, two = warc.tree(warc.leaves(recs), 40), warc.tree(warc.leaves(recs.where("page_id is null or page_id <> 79")), 40)
    assert [(r.file, r.position, r.found) for r in warc.audit(one, two).collect()] == [(1, 39, "missing")]
    assert warc.fixity(pages.limit(0), F.col("html")).count() == 0


def test_warc_audits_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<p>page {k} é</p>" * 5) for k in range(50)] + [(None, None, f"x{k}") for k in range(25)], "page_id long, url string, html string")
    recs = warc.records(pages, 50)
    warc.write(recs, str(tmp_path / "a"), 10)
    name = lambda p: int(re.search(r"\.c(\d+)\.", p.name)[1])
    assert sorted((name(p), len(warc.ranges(p.read_bytes()))) for p in (tmp_path / "a" / "file=0").glob("part-*")) == [(k, 10) for k in range(5)]
    leaf = common.materialize(warc.scan(spark, str(tmp_path / "a")))
    key = lambda df: sorted((-1 if r.file is None else r.file, r.position, r.start, r.length, r.digest, r.name) for r in df.collect())
    assert key(leaf) == key(warc.leaves(recs))

    def damage(n, change):
        shutil.copytree(tmp_path / "a", tmp_path / n)
        (tmp_path / n / "file=0").mkdir(exist_ok=True)
        file = next(p for p in (tmp_path / n / "file=0").glob("part-*") if name(p) == 1)
        data = file.read_bytes()
        file.write_bytes(change(data, [r[0] for r in warc.ranges(data)]))
        for crc in (tmp_path / n / "file=0").glob(".*.crc"):
            crc.unlink()
        other = common.materialize(warc.scan(spark, str(tmp_path / n)))
        return sorted((r.file, r.position, r.found) for r in warc.audit(warc.tree(leaf, 50), warc.tree(other, 50)).collect())

    assert damage("missing", lambda d, at: d[: at[3]] + d[at[4] :]) == [(0, 13, "missing")]
    assert damage("byte", lambda d, at: d[: at[5] - 9] + b"#" + d[at[5] - 8 :]) == [(0, 14, "changed")]
    assert damage("header", lambda d, at: d[: at[3]] + b"XXXX" + d[at[3] + 4 :]) == [(0, 13, "missing"), (0, 13, "unreadable")]
    assert damage("length", lambda d, at: d[: at[3]] + d[at[3] : at[4]].replace(b"Content-Length: ", b"Content-Length: 9") + d[at[4] :]) == [(0, 13, "missing"), (0, 13, "unreadable")]
    assert damage("cut", lambda d, at: d[: at[9] + 30]) == [(0, 19, "missing"), (0, 19, "unreadable")]


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(k, f"{sentence(30)}\nunique words {k} {'moron trash' if k % 5 == 0 else 'fine text'}", "en", "s", 1) for k in range(60)]
    rows += [(100 + k, rows[k + 1][1], "en", "s", 1) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(60)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = [(r.doc_id, r.text) for r in now.collect()], common.materialize(stage(spark, now, str(tmp_path)))
        got = sorted((r.doc_id, r.text) for r in after.collect())
        assert after.columns == docs.columns, name
        if name == "toxicity":
            model, cuts = toxicity.fit(*toxicity.sample(common.texts(now), spark.read.parquet(str(tmp_path / "labels.parquet")), common.crc32_of_id() % 5 != 0))
            read = toxicity.read([t for _, t in before])
            want = [r for r, z in zip(before, toxicity.logits(model, read) - cuts[read.language]) if z < 0]
        elif name == "line_dedup":
            each, kind = brute_lines(before)
            first = {}
            for *place, x in sorted(each):
                first.setdefault(kind.get(x, (x, *place)), place)
            want = [(d, "\n".join(x for k, x in enumerate(t.split("\n")) if first[kind.get(x, (x, True, d, n, k))] == [True, d, n, k])) for n, (d, t) in enumerate(before)]
        else:
            shingles = [{tuple(words(t)[i : i + 5]) for i in range(max(1, len(words(t)) - 4))} if words(t) else set() for _, t in before]
            root = components_of(len(before), [(i, j) for i, a in enumerate(shingles) for j, b in enumerate(shingles[:i]) if a == b or len(a & b) >= 0.8 * len(a | b)])
            least = {}
            for (d, _), r in zip(before, root):
                least[r] = min(least.get(r, d), d)
            want = [(d, t) for (d, t) in before if d in least.values()]
        assert got == sorted(want), name
        now = after
    assert {r.n_chars - len(r.text) for r in now.collect()} == {0}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in now.collect()}
    fill = collections.Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary_path())
    assert max(fill.values()) <= 1024 and sum(fill.values()) == sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in now.collect())
    none = tmp_path / "none"
    docs.limit(0).write.parquet(str(none / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).write.parquet(str(none / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(none)).count() == 0 and corpus_pipeline.ORACLE_SQL is None
