"""The queries of this subpackage: one for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, html, lexical, lines, lm, merkle, neighbours, packing, simhash, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), written=True)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_fingerprints(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated lines, n_lines, n_dropped of every document."""
    return lines.dedup(table(spark, sf_dir, "documents"), written=True).select("doc_id", "text", "n_lines", "n_dropped")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a replica in which every 64th page has its first character overwritten."""
    damaged = F.when(F.expr("page_id % 64 = 5 and html <> ''"), F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    return warc.fixity(table(spark, sf_dir, "pages"), damaged)


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


OP10_SQL = """
with p as (
  select page_id, url, coalesce(html, '') html, md5(page_id || ' ' || coalesce(url, '')) m from pages
), r as (
  select page_id, url, cast(floor(page_id / 1000) as bigint) as file, html,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' ||
    substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) ||
    '>' || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') ||
    chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html as record
  from p
), d as (select *, cast(strlen(record) as bigint) as length, sha256(record) as digest from r)
select page_id, url, file,
  row_number() over w - 1 as position,
  cast(coalesce(sum(length + 4) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) as start,
  length, digest,
  not (page_id % 64 = 5 and html <> '' and html[1] <> '#') as intact
from d window w as (partition by file order by page_id, url, digest)
"""


_TREE = """(select *, struct_pack(root := sha256(array_to_string(s, '')), nodes := list_slice(list_sort(list_distinct(list_transform(list_concat(p, s), lambda h: h[1:8]))), 1, 128)) as tree from (
  select *, list_transform(list_filter(string_split(array_to_string(list_transform(p, lambda h: h || case when h < '2' then ';' else '' end), ''), ';'), lambda x: x <> ''), lambda x: sha256(x)) as s from (
    select *, list_transform(regexp_extract_all({0}, '[^.!?\\n]{{1,64}}[.!?\\n]*|[.!?\\n]+'), lambda x: sha256(x)) as p from {1})))"""
_LIKE = """(select case when len(u) = 0 then 1.0 else len(list_filter(u, lambda x: list_contains({0}, x) and list_contains({1}, x))) / len(u) end from (select list_slice(list_sort(list_distinct(list_concat({0}, {1}))), 1, 128) as u))"""
OP7_SQL = (
    """
with d as (select doc_id, coalesce(text, '') as text from documents),
t as (select doc_id, text, tree from """
    + _TREE.format("text", "d")
    + """),
n as (select *, coalesce(lead(text) over w, first_value(text) over w) as next_text, coalesce(lead(tree) over w, first_value(tree) over w) as next_tree from t window w as (order by doc_id nulls first, text)),
e as (select doc_id, length(text) as n, tree as own, next_tree, text[1:length(text) - length(text) // 2] || next_text[1:length(text) // 2] as edited from n)
select doc_id, cast(n as bigint) as n_chars, sha256(edited) as edited_sha256, own.root || ':' || array_to_string(own.nodes, '') as fingerprint,
  tree.root || ':' || array_to_string(tree.nodes, '') as edited_fingerprint,
  """
    + _LIKE.format("own.nodes", "tree.nodes")
    + " as near_edited, "
    + _LIKE.format("own.nodes", "next_tree.nodes")
    + " as near_next from "
    + _TREE.format("edited", "e")
)

OP9_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

OP12_SQL = """
with d as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as t from documents),
s as (select count(*) as docs, cast(sum(len(t)) as bigint) as total from d where len(t) > 0),
i as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark),
p as (select row, doc_id, n, term, count(*) as tf from (select row, doc_id, cast(len(t) as bigint) as n, unnest(t) as term from d) group by all),
w as (select term, cast(floor(1000 * ln(cast(2 * (select docs from s) + 2 as double) / (2 * count(*) + 1))) as bigint) as w from p group by term),
m as (select item_id, row, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // total))))) as bigint) as score from i join p using (term) join w using (term), s group by all),
r as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id nulls first) as integer) as rank from m where score > 0)
select item_id, rank, doc_id, score from r where rank <= 50
"""

_LEAST = "list_sum(list_transform(list_zip(p.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
_NEAR = "(select k, v, n, e, d from (select p.k, p.v, p.n, b.e, {0} as d, row_number() over (partition by p.k, p.v order by {0}, b.e) as j from p join {1} b on p.k = b.k) where j = 1)"
_MEAN = """(select k, e, list(cast(floor(s / c) as bigint) order by i) as v from (select k, e, i, sum(n * x) as s, sum(n) as c from (select k, e, n, unnest(v) as x, unnest(range(len(v))) as i from a{0}) group by all) group by all
  union all select k, e, v from b{0} anti join a{0} using (k, e))"""
OP13_SQL = (
    """
with w as (select row_number() over () as row, vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c as (select row, vec_id, label, k, v[k * len(v) // 4 + 1 : (k + 1) * len(v) // 4] as v from w, range(4) q(k)),
p as (select k, v, count(*) as n from c group by all),
b0 as (select k, row_number() over (partition by k order by vec_id, v) - 1 as e, v from c qualify row_number() over (partition by k order by vec_id, v) <= 256),"""
    + "".join(f"a{r} as materialized {_NEAR.format(_LEAST, f'b{r}')},\nb{r + 1} as materialized {_MEAN.format(r)},\n" for r in range(4))
    + f"z as materialized {_NEAR.format(_LEAST, 'b4')},"
    + """
o as (select c.row, c.vec_id, c.label, string_agg(lower(lpad(printf('%x', e), 2, '0')), '' order by c.k) as code, cast(sum(d) as bigint) as error from c join z using (k, v) group by all)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(array_to_string(v, ','), ',' order by k, e)) from b4) as codebooks_sha256 from o
"""
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op7_document_fingerprints": OP7_SQL, "op9_exact_top_k": OP9_SQL, "op10_warc_fixity": OP10_SQL, "op12_lexical_search": OP12_SQL, "op13_vector_codes": OP13_SQL}
