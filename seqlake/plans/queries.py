"""One query for each operator over the driver's tables, with an independent SQL formulation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import IUPAC, complement, count_of, fixed, is_nucleotide, orient, wrap
from ..operators import extract as X
from ..operators import records as R
from ..operators import requests as Q
from ..operators import spans as P
from ..operators import stats as S
from ..operators import store as K
from ..operators import validate as V
from . import virtual as T

QUERIES: dict = {}
SQL: dict[str, str] = {}

DNA = "dna as (select doc_id as ordinal, 'doc' || doc_id as id, lang, source, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTNRYKMSWBVDHUACGTACGTAC') as seq from documents)"
IDX = DNA + ", idx as (select ordinal, id, lang, source, seq, cast(length(seq) as bigint) as seq_len from dna where length(seq) > 0)"
LINES = """docs as (select doc_id, '>doc' || doc_id || ' ' || lang || ' ' || source as head, text from documents),
raw as (select doc_id, 0 as k, head as content from docs union all
  select doc_id, i as k, parts[i] as content from (select doc_id, parts, unnest(generate_series(1, len(parts))) as i from (select doc_id, string_split(text, chr(10)) as parts from docs))),
ln as (select doc_id, 'doc' || doc_id as file, k, content, k = 0 as is_header, cast(strlen(content) as bigint) as content_len,
  cast(case when k = 0 then 0 else strlen(regexp_replace(content, '[\\x00-\\x20]', '', 'g')) end as bigint) as bases,
  cast(coalesce(sum(strlen(content) + 1) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as line_offset from raw)"""
BED = """bed as (select o_orderkey as request, 'doc' || (o_orderkey % (select max(doc_id) * 11 // 10 + 1 from documents)) as name, o_custkey % 700 + 1 as start_, o_custkey % 700 + o_orderkey % 50 + 1 as end_, o_orderstatus = 'O' as rev from orders)"""
REG = """reg as (select o_orderkey as request, 'doc' || (o_orderkey % (select max(doc_id) * 11 // 10 + 1 from documents)) as name, case when o_orderkey % 3 > 0 then o_custkey % 500 + 1 end as start_, case when o_orderkey % 3 = 2 then o_custkey % 500 + 60 end as end_ from orders)"""
RES = IDX + ", " + REG + """, res as (select request, name, start_, end_, seq, seq_len,
  case when seq_len is null then 'request.sequence_not_found' when start_ > seq_len then 'request.start_after_sequence' when end_ < start_ then 'request.end_before_start' end as error
  from reg left join idx on name = id)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _dec(n: str, d: str, digits: int = 2) -> str:
    """SQL for n / d with decimals, half up, as text."""
    s = 10**digits
    up = f"((abs({n})::hugeint * {2 * s} + {d}) // ({d} * 2))"
    return f"case when {d} = 0 then 'n/a' else case when {n} < 0 and {up} > 0 then '-' else '' end || ({up} // {s}) || '.' || lpad(({up} % {s})::varchar, {digits}, '0') end"


@query("with " + IDX + """, r as (select *, row_number() over (order by seq_len, ordinal) as up, row_number() over (order by seq_len desc, ordinal) as down,
  sum(seq_len) over (order by seq_len desc, ordinal rows unbounded preceding) as cum, count(*) over () as n, sum(seq_len) over () as total from idx)
select cast(max(n) as bigint) as records, cast(max(total) as bigint) as total, cast(max(total) // max(n) as bigint) as mean,
  cast(min(seq_len) as bigint) as shortest, max(case when up = 1 then id end) as shortest_name, cast(max(seq_len) as bigint) as longest, max(case when down = 1 then id end) as longest_name,
  cast(max(seq_len) - min(seq_len) as bigint) as range,
  cast((max(case when up = greatest(1, (n // 2 + 1) // 2) then seq_len end) + max(case when up = greatest(1, (n // 2) // 2 + 1) then seq_len end)) // 2 as bigint) as q1,
  cast((max(case when up = (n + 1) // 2 then seq_len end) + max(case when up = n // 2 + 1 then seq_len end)) // 2 as bigint) as median,
  cast((max(case when down = greatest(1, (n // 2 + 1) // 2) then seq_len end) + max(case when down = greatest(1, (n // 2) // 2 + 1) then seq_len end)) // 2 as bigint) as q3,
  cast(max(case when cum * 100 >= total * 50 then seq_len end) as bigint) as n50, cast(min(case when cum * 100 >= total * 50 then down end) as bigint) as l50,
  cast(max(case when cum * 100 >= total * 90 then seq_len end) as bigint) as n90, cast(min(case when cum * 100 >= total * 90 then down end) as bigint) as l90,
  """ + _dec("sum(seq_len::hugeint * seq_len)", "max(total)") + " as aun from r")  # fmt: skip
def stats_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.length_summary(T.index(spark, sf_dir))


def _count_sql(letters: str) -> str:
    return f"cast(coalesce(sum(length(seq) - length(translate(seq, '{letters}', ''))), 0) as bigint)"


_COMP = ", ".join(f"{_count_sql(k.upper() + k)} as {k}" for k in "acgtun") + f", {_count_sql('RYSWKMBDHVryswkmbdhv')} as ambiguous, {_count_sql('abcdefghijklmnopqrstuvwxyz')} as lowercase, {_count_sql(IUPAC)} as iupac, cast(coalesce(sum(length(seq)), 0) as bigint) as total"


@query(f"with {DNA}, c as (select {_COMP} from dna) select *, total - iupac as invalid, case when not (total = 0 or iupac * 10 > total * 9) then 'protein' when t > 0 and u > 0 then 'nucleotide_mixed_tu' when t > 0 then 'nucleotide_t' when u > 0 then 'nucleotide_u' else 'nucleotide' end as type, {_dec('(g + c) * 100', '(a + c + g + t + u)')} as gc, {_dec('(g - c)', '(g + c)', 3)} as gc_skew from c")
def comp_nucleotide(spark, sf_dir):
    return S.composition(T.dna(spark, sf_dir))


@query("with d as (select upper(regexp_replace(text, '[^A-Za-z*0-9]', '', 'g')) as seq from documents), r as (select chr(x::integer) as residue from range(65, 91) q(x) union all select 'stop'), t as (select sum(length(seq)) as total from d), k as (select residue, cast(sum(length(seq) - length(replace(seq, case when residue = 'stop' then '*' else residue end, ''))) as bigint) as n from d, r group by residue) select residue, n from k union all select 'invalid', cast((select total from t) - (select sum(n) from k) as bigint)")
def comp_protein(spark, sf_dir):
    seq = F.regexp_replace("text", "[^A-Za-z*0-9]", "").alias("seq")
    return S.protein_counts(T.table(spark, sf_dir, "documents").select(seq))


@query(f"with {DNA} select id, length(seq) = 0 or (length(seq) - length(translate(seq, '{IUPAC}', ''))) * 10 > length(seq) * 9 as nucleotide, cast(length(seq) as bigint) as total from dna")
def comp_type(spark, sf_dir):
    d = T.dna(spark, sf_dir)
    return d.select("id", is_nucleotide(count_of(F.col("seq"), IUPAC), F.length("seq")).alias("nucleotide"), F.length("seq").cast("long").alias("total"))


_GC = "(length(seq) - length(translate(seq, 'GC', '')))"


@query(f"with {DNA}, x as (select id, {_GC} as gc, length(seq) - length(translate(seq, 'ACGTU', '')) as n from dna) select id, {_dec('gc * 100', 'n')} as gc from x")
def comp_gc(spark, sf_dir):
    d = T.dna(spark, sf_dir)
    return d.select("id", fixed(count_of(F.col("seq"), "GC") * 100, count_of(F.col("seq"), "ACGTU")).alias("gc"))


@query("select doc_id, cast(length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) as bigint) as lowercase from documents")
def comp_lowercase(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", count_of(F.col("text"), "abcdefghijklmnopqrstuvwxyz").alias("lowercase"))


@query(f"with {DNA}, c as (select unnest(string_split(seq, '')) as ch from dna where seq <> '') select cast(ascii(ch) as bigint) as byte, count(*) as n from c where ch <> '' group by ch")
def byte_histogram(spark, sf_dir):
    return S.byte_histogram(T.dna(spark, sf_dir).select(F.col("seq").cast("binary").alias("raw")))


@query("with " + REG + " select request, name, cast(start_ as bigint) as start, cast(end_ as bigint) as \"end\", start_ is null as is_full from reg")
def region_parse(spark, sf_dir):
    return Q.parse_regions(T.regions(spark, sf_dir)).select("request", "name", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "is_full")


@query("with " + BED + " select request, name, cast(start_ as bigint) as start, cast(end_ as bigint) as \"end\", rev as reverse from bed")
def bed_parse(spark, sf_dir):
    rows = Q.parse_bed(T.bed(spark, sf_dir), stranded=True).where("error is null")
    return rows.select("request", "name", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "reverse")


@query("select doc_id, case when doc_id % 7 = 0 then 'track' when doc_id % 11 = 0 then '# note' when doc_id % 13 = 0 then 'track' || doc_id else 'doc' || doc_id end as name from labels where doc_id % 11 > 0 or doc_id % 7 = 0")
def names_filter(spark, sf_dir):
    line = F.expr("case when doc_id % 7 = 0 then 'track' when doc_id % 11 = 0 then '# note' when doc_id % 13 = 0 then 'track' || doc_id else 'doc' || doc_id end")
    return Q.parse_names(T.table(spark, sf_dir, "labels").select("doc_id", line.alias("value"))).select("doc_id", "name")


@query("with " + IDX + " select source as id, ordinal, seq_len from (select *, row_number() over (partition by source order by ordinal) as k from idx) where k = 1")
def lookup_first_wins(spark, sf_dir):
    return X.first_of_each(T.index(spark, sf_dir, "source"))


@query("with " + IDX + ", " + REG + " select request, name from reg where name not in (select id from idx)")
def lookup_missing(spark, sf_dir):
    req = Q.parse_regions(T.regions(spark, sf_dir))
    return req.join(T.index(spark, sf_dir).withColumnRenamed("id", "name"), "name", "left_anti").select("request", "name")


@query("with " + IDX + ", " + REG + " select ordinal, id from idx where id in (select name from reg)")
def requested_semi(spark, sf_dir):
    req = Q.parse_regions(T.regions(spark, sf_dir)).select(F.col("name").alias("id"))
    return T.index(spark, sf_dir).join(req, "id", "left_semi").select("ordinal", "id")


def _resolved(spark, sf_dir):
    return X.resolve(X.lookup(Q.parse_regions(T.regions(spark, sf_dir)), T.index(spark, sf_dir)))


def _extracted(spark, sf_dir):
    pieces = X.chunks(T.dna(spark, sf_dir).select("ordinal", "seq"))
    return X.extract(_resolved(spark, sf_dir), pieces)


@query("with " + RES + " select request, name, error, cast(case when error is null then coalesce(start_, 1) - 1 end as bigint) as from_base, cast(case when error is null then least(coalesce(end_, seq_len), seq_len) end as bigint) as to_base, cast(case when error is null then coalesce(end_, seq_len) end as bigint) as display_end from res")
def region_resolve(spark, sf_dir):
    return _resolved(spark, sf_dir).select("request", "name", "error", "from_base", "to_base", "display_end")


_CUT = "substr(seq, coalesce(start_, 1), least(coalesce(end_, seq_len), seq_len) - coalesce(start_, 1) + 1)"


@query("with " + RES + f" select request, name, error, case when error is null then {_CUT} end as bases from res")
def region_extract(spark, sf_dir):
    return _extracted(spark, sf_dir).select("request", "name", "error", "bases")


_COMPL = "translate({}, 'ACGTURYKMBVDHacgturykmbvdh', 'TGCAAYRMKVBHDtgcaayrmkvbhd')"


@query("with " + DNA + " select id, " + _COMPL.format("reverse(seq)") + " as rc from dna")
def revcomp(spark, sf_dir):
    return T.dna(spark, sf_dir).select("id", orient(F.col("seq"), F.lit(True), F.lit(True)).alias("rc"))


@query("with " + DNA + " select id, reverse(seq) as r from dna")
def reverse_only(spark, sf_dir):
    return T.dna(spark, sf_dir).select("id", orient(F.col("seq"), F.lit(True), F.lit(False)).alias("r"))


@query("with " + DNA + " select id, " + _COMPL.format("seq") + " as c from dna")
def complement_only(spark, sf_dir):
    return T.dna(spark, sf_dir).select("id", complement(F.col("seq")).alias("c"))


@query("with " + IDX + ", " + BED + " select request, case when rev then substr(seq, start_, end_ - start_ + 1) else " + _COMPL.format("reverse(substr(seq, start_, end_ - start_ + 1))") + " end as bases from bed join idx on name = id where start_ <= seq_len")
def strand_compose(spark, sf_dir):
    """BED rows with their strand and a reverse complement of all: the two cancel on the minus strand."""
    req = Q.parse_bed(T.bed(spark, sf_dir), stranded=True).where("error is null").withColumn("is_full", F.lit(False)).drop("error")
    got = X.extract(X.resolve(X.lookup(req, T.index(spark, sf_dir))), X.chunks(T.dna(spark, sf_dir).select("ordinal", "seq"))).where("error is null")
    turn = ~F.col("reverse")
    return got.select("request", orient(F.col("bases"), turn, turn).alias("bases"))


@query("with " + RES + " select request, '>' || name || case when start_ is null then '' else ':' || start_ || '-' || coalesce(end_, seq_len) end || case when request % 4 = 1 then ' (reverse complement)' when request % 4 = 2 then ' (reverse)' when request % 4 = 3 then ' (complement)' else '' end as header from res where error is null")
def annotate_header(spark, sf_dir):
    rows = _resolved(spark, sf_dir).where("error is null").withColumns({"reverse": F.expr("request % 4 in (1, 2)"), "complement": F.expr("request % 4 in (1, 3)")})
    return rows.select("request", X.header_line(annotate=True).alias("header"))


@query("with " + DNA + r" select id, regexp_replace(regexp_replace(seq, '(.{60})', '\1' || chr(10), 'g'), chr(10) || '$', '') as wrapped from dna")
def wrap60(spark, sf_dir):
    return T.dna(spark, sf_dir).select("id", wrap(F.col("seq")).alias("wrapped"))


@query("with d as (select doc_id, substr(regexp_replace(text, '[^A-Za-z]', '', 'g'), 1, 256) as s from documents) select doc_id, case when not (length(s) = 0 or (length(s) - length(translate(s, '" + IUPAC + "', ''))) * 10 > length(s) * 9) then 'transform.complement_on_protein' end as error from d")
def complement_guard(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z]", "").alias("bases"), F.lit(False).alias("reverse"), F.lit(True).alias("complement"), F.lit(None).cast("string").alias("error"))
    return X.oriented(d).select("doc_id", "error")


@query("with " + RES + " select count(*) as regions, cast(sum(least(coalesce(end_, seq_len), seq_len) - coalesce(start_, 1) + 1) as bigint) as total_bases from res where error is null")
def get_summary(spark, sf_dir):
    return _resolved(spark, sf_dir).where("error is null").agg(F.count("*").alias("regions"), F.sum(F.col("to_base") - F.col("from_base")).alias("total_bases"))


@query("with " + LINES + " select file, line_offset, is_header, content_len, bases, cast(k + 1 as bigint) as line_no, cast(1 as bigint) as record from ln")
def line_facts(spark, sf_dir):
    return T.lines(spark, sf_dir).select("file", "line_offset", "is_header", "content_len", "bases", "line_no", "record")


_LAYOUT = LINES + """, b as (select *, row_number() over (partition by doc_id order by k) as i, count(*) over (partition by doc_id) as m,
  first_value(bases) over (partition by doc_id order by k) as b1, first_value(content_len) over (partition by doc_id order by k) as c1 from ln where k > 0 and bases > 0),
rec as (select file, min(line_offset) as seq_offset, cast(sum(bases) as bigint) as seq_len, max(b1) as line_bases, max(c1) + 1 as line_bytes,
  bool_and(bases = content_len and (i = m or content_len = c1) and content_len <= c1) as uniform from b group by file)"""


@query("with " + _LAYOUT + " select * from rec")
def record_layout(spark, sf_dir):
    return R.layout(T.lines(spark, sf_dir)).select("file", "seq_offset", "seq_len", "line_bases", "line_bytes", "uniform")


@query("with " + _LAYOUT + ", w as (select b.*, coalesce(sum(bases) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as s from b) select w.file, cast(s as bigint) as base_start, w.line_offset as byte_offset, w.content_len + 1 as line_bytes, w.bases as line_bases from w join rec using (file) where not uniform")
def side_table(spark, sf_dir):
    return R.side_table(T.lines(spark, sf_dir)).drop("record")


@query("with " + _LAYOUT + ", t as (select file, min(case when bases <> content_len then i end) as space_at, min(case when i < m and content_len <> c1 or i < m and bases <> b1 then i end) as odd_at, bool_or(i = 1 and bases <> content_len) as first_bad from b group by file) select t.file, case when first_bad then 'sequence_whitespace' when space_at is not null and (odd_at is null or space_at <= odd_at + 1) then 'sequence_whitespace' when odd_at is not null then (select case when b.bases < b.b1 then 'interior_short_line' when b.bases > b.b1 then 'wider_line' else 'mixed_line_endings' end from b where b.file = t.file and b.i = t.odd_at) when not rec.uniform then 'wider_line' end as reason from t join rec using (file)")
def nonuniform_reason(spark, sf_dir):
    return R.layout(T.lines(spark, sf_dir)).select("file", "reason")


@query("with " + _LAYOUT + " select 'doc' || substr(file, 4) || chr(9) || seq_len || chr(9) || seq_offset || chr(9) || line_bases || chr(9) || line_bytes as value from rec where uniform")
def fai_rows(spark, sf_dir):
    return R.fai_rows(R.index(T.lines(spark, sf_dir)).where("uniform")).select("value")


@query("with " + _LAYOUT + ", p as (select *, 777 % seq_len as i from rec where uniform) select file, cast(seq_offset + i // line_bases * line_bytes + i % line_bases as bigint) as byte_offset from p")
def byte_offset(spark, sf_dir):
    i = F.lit(777) % F.col("seq_len")
    rows = R.layout(T.lines(spark, sf_dir)).where("uniform")
    return rows.select("file", (F.col("seq_offset") + F.floor(i / F.col("line_bases")) * F.col("line_bytes") + i % F.col("line_bases")).alias("byte_offset"))


#: Findings from bytes alone, given files(file, body) of one character a byte and the longest header; the alphabet is protein.
_LINES_OF = """piece as (select file, p, i, i < n as lf, bom, cast(sum(length(p) + 1) over (partition by file order by i) - length(p) - 1 as bigint) as line_offset from (
  select file, unnest(parts) as p, unnest(range(1, len(parts) + 1)) as i, len(parts) as n, starts_with(body, chr(239) || chr(187) || chr(191)) as bom from (select file, body, string_split(body, chr(10)) as parts from files)) where i < n or p <> ''),
ln as (select *, content[1:1] = '>' as is_header, cast(length(content) as bigint) as len, cast(sum((content[1:1] = '>')::int) over (partition by file order by i) as bigint) as record,
  cast(length(regexp_replace(content, '[\\x00-\\x20]', '', 'g')) as bigint) as bases from (
  select file, i, line_offset, lf, case when i = 1 and bom then 3 else 0 end as skip, case when lf and p[-1:] = chr(13) then 2 when lf then 1 else 0 end as term,
    (case when lf and p[-1:] = chr(13) then p[:-2] else p end)[case when i = 1 and bom then 4 else 1 end:] as content from piece)),
ch as (select file, i, unnest(range(length(content))) as pos, unicode(unnest(string_split(content, ''))) as b from ln where content <> ''),
seen as (select file, i, min(pos) filter (b < 32 and b <> 9) as ctl, count(*) filter (b < 32 and b <> 9) as ctls, min(pos) filter (b in (9, 32)) as ws,
  min(pos) filter (b > 32 and not (b between 65 and 90 or b between 97 and 122 or b in (42, 45))) as bad, count(*) filter (b > 32 and not (b between 65 and 90 or b between 97 and 122 or b in (42, 45))) as bads,
  min(pos) filter (b not in (9, 13, 32)) as pre from ch group by all),
hd as (select file, i, line_offset, skip, record, len, regexp_extract(content[2:], '^[^ \\t\\r\\n]*') as id from ln where is_header),
base as (select *, row_number() over (partition by file, record order by i desc) as back, first_value(bases) over (partition by file, record order by i) as w from ln where record > 0 and not is_header and bases > 0),
dup as (select *, row_number() over (partition by file, id order by i) as k, first_value(record) over (partition by file, id order by i) as r, first_value(line_offset + skip + 1) over (partition by file, id order by i) as ro, first_value(i) over (partition by file, id order by i) as rl from hd where id <> '' and length(id) <= 65535),
f as (select file, code, record, line_offset + skip + pos as "offset", i as line, skip + pos + 1 as "column", n, null::bigint as ro, null::bigint as rl, null::bigint as rr from (
    select file, i, line_offset, skip, record, code, case code when 'fasta.content_before_header' then pre when 'format.sequence_whitespace' then ws when 'sequence.invalid_symbol' then bad when 'format.blank_sequence_line' then 0 else ctl end as pos,
      case code when 'fasta.content_before_header' then (record = 0 and pre is not null)::int when 'format.sequence_whitespace' then (record > 0 and not is_header and ws is not null)::int when 'sequence.invalid_symbol' then case when record > 0 and not is_header then bads end
        when 'format.blank_sequence_line' then (record > 0 and content = '')::int when 'fasta.header_control_byte' then case when is_header then ctls end else case when record > 0 and not is_header then ctls end end as n
    from ln left join seen using (file, i), (values ('fasta.content_before_header'), ('format.sequence_whitespace'), ('sequence.invalid_symbol'), ('format.blank_sequence_line'), ('fasta.header_control_byte'), ('fasta.sequence_control_byte')) c(code)) where n > 0
  union all select file, code, record, line_offset + skip + pos, i, skip + pos + 1, 1, null, null, null from (
    select *, case code when 'fasta.long_header' then 0 when 'header.convention_mismatch' then 0 else 1 end as pos from hd, (values ('fasta.long_header'), ('fasta.empty_identifier'), ('fasta.identifier_too_long'), ('header.convention_mismatch')) c(code)
    where case code when 'fasta.long_header' then len - 1 > {longest} when 'fasta.empty_identifier' then id = '' when 'fasta.identifier_too_long' then length(id) > 65535 else {schema} and id[1:3] not in ('NC_', 'NM_', 'NR_', 'NP_', 'NW_', 'NG_', 'NT_', 'NZ_', 'XM_', 'XR_', 'XP_') end)
  union all select file, 'fasta.duplicate_identifier', record, line_offset + skip + 1, i, skip + 2, 1, ro, rl, r from dup where k > 1
  union all select file, 'format.inconsistent_wrapping', record, line_offset + skip, i, skip + 1, 1, null, null, null from base where (back > 1 and bases <> w) or (back = 1 and bases > w) qualify row_number() over (partition by file, record order by i) = 1
  union all select file, 'fasta.empty_record', record, line_offset + skip, i, skip + 1, 1, null, null, null from hd anti join base using (file, record)
  union all select file, 'fasta.no_records', 0, null, null, null, 1, null, null, null from (select distinct file from ln) anti join hd using (file)
  union all select file, 'format.leading_bom', 0, 0, 1, 1, 1, null, null, null from ln where skip = 3
  union all select file, 'format.missing_terminal_newline', 0, line_offset + skip + len, i, skip + len + 1, 1, null, null, null from ln where not lf
  union all select file, 'format.mixed_line_endings', 0, line_offset + skip + len, i, skip + len + 1, 1, null, null, null from (select *, min(term) filter (term > 0) over (partition by file order by i) as lo, max(term) filter (term > 0) over (partition by file order by i) as hi from ln) where lo <> hi qualify row_number() over (partition by file order by i) = 1)"""
_PLACES = """, one as (select *, cast(sum(n) over (partition by file, code) as bigint) as occurrences, row_number() over (partition by file, code order by coalesce("offset", 0)) as j from f),
many as (select file, code, count(distinct record) filter (record > 0) as records from f group by all)
select one.file, code, occurrences, records, cast("offset" as bigint) as "offset", cast(line as bigint) as line, cast("column" as bigint) as "column", cast(nullif(one.record, 0) as bigint) as record,
  case when one.record > 0 then hd.id[1:256] end as identifier, cast(ro as bigint) as related_offset, cast(rl as bigint) as related_line, cast(rr as bigint) as related_record
from one join many using (file, code) left join hd on one.file = hd.file and one.record = hd.record where j = 1"""


def _quoted(data: bytes) -> str:
    """A file's bytes as SQL text of one character each, long runs by repeat()."""
    text = data.decode("latin-1").replace("'", "''")
    return "'" + re.sub(r"(.)\1{99,}", lambda m: f"' || repeat('{m[1]}', {len(m[0])}) || '", text) + "'"


_KINDS = ", ".join(f"({kind}, {_quoted(b''.join(raw + (b'', bytes([10]), bytes([13, 10]))[t] for raw, t in zip(*own)))})" for kind, own in enumerate(T.FAULTS))
_PART_FILES = f"kinds(kind, body) as (values {_KINDS}), files as (select 'part' || p_partkey as file, body from part join kinds on p_partkey % {len(T.FAULTS)} = kind), " + _LINES_OF.format(longest=1024, schema="true")
#: UTF-8 bytes of the documents as characters of one byte.
_DOC_FILES = "raw as (select 'doc' || doc_id as file, '>doc' || doc_id || ' ' || lang || ' ' || source || chr(10) || text || chr(10) as t from documents), " + """
files as (select file, array_to_string(list_transform(string_split(t, ''), lambda c: case when unicode(c) < 128 then c when unicode(c) < 2048 then chr(192 + unicode(c) // 64) || chr(128 + unicode(c) % 64)
  when unicode(c) < 65536 then chr(224 + unicode(c) // 4096) || chr(128 + unicode(c) // 64 % 64) || chr(128 + unicode(c) % 64) else chr(240 + unicode(c) // 262144) || chr(128 + unicode(c) // 4096 % 64) || chr(128 + unicode(c) // 64 % 64) || chr(128 + unicode(c) % 64) end), '') as body from raw), """ + _LINES_OF.format(longest=12, schema="false")


def _findings(spark, sf_dir):
    return V.findings(T.lines(spark, sf_dir), "protein", long_header=12)


def _place_rows(found, lines):
    rows = V.places(found, lines)
    return rows.select("file", "code", "occurrences", "records", "offset", "line", "column", "record", "identifier", F.col("related.offset").alias("related_offset"), F.col("related.line").alias("related_line"), F.col("related.record").alias("related_record"))


@query("with " + _DOC_FILES + _PLACES)
def findings_places(spark, sf_dir):
    """Where each rule is first broken in each document's file, in how many records and how often."""
    lines = T.kept(T.lines(spark, sf_dir))
    return _place_rows(V.findings(lines, "protein", long_header=12), lines)


@query("with " + _PART_FILES + _PLACES)
def fault_places(spark, sf_dir):
    """The same of files that break every rule, with byte order marks, mixed line ends and duplicates."""
    return _place_rows(_faulty(spark, sf_dir), T.faulty_lines(spark, sf_dir))


@query("with " + _DOC_FILES + " select code, case when code = 'sequence.invalid_symbol' then 'error' else 'warning' end as severity, cast(sum(n) as bigint) as occurrences, count(distinct file) as records, min(\"offset\") as first_offset from f where n > 0 group by code")
def findings_by_code(spark, sf_dir):
    return V.by_code(_findings(spark, sf_dir))


@query("with " + _DOC_FILES + ", s as (select distinct code from f where n > 0) select count(*) filter (code = 'sequence.invalid_symbol') as errors, count(*) filter (code <> 'sequence.invalid_symbol') as warnings, case when count(*) filter (code = 'sequence.invalid_symbol') > 0 then 1 when count(*) > 0 then 2 else 0 end as status from s")
def outcome_status(spark, sf_dir):
    return V.outcome(V.by_code(_findings(spark, sf_dir)))


@query("with " + _DOC_FILES + " select file, count(distinct code) as codes, cast(sum(n) as bigint) as found from f where n > 0 group by file")
def records_with_findings(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("file").agg(F.count_distinct("code").alias("codes"), F.sum("n").alias("found"))


def _by_source(spark, sf_dir):
    """One file whose records are named by source, so that ids repeat."""
    d = T.table(spark, sf_dir, "documents")
    return d.select(F.lit("all").alias("file"), F.floor(F.col("doc_id") / 1000).alias("split"), F.col("doc_id").alias("line_offset"), F.concat(F.lit(">"), F.col("source"), F.lit(" "), F.col("lang")).cast("binary").alias("raw"), F.lit(1).alias("term"))


@query("select source as id, doc_id as \"offset\" from (select source, doc_id, row_number() over (partition by source order by doc_id) as k from documents) where k > 1")
def duplicate_ids(spark, sf_dir):
    lines = R.assign_records(R.line_facts(_by_source(spark, sf_dir)))
    found = V.findings(lines, "any").where("code = 'fasta.duplicate_identifier'").select("record")
    return found.join(R.headers(lines).select("record", F.col("header_offset").alias("offset"), "id"), "record").select("id", "offset")


@query("select doc_id, source as id, min(doc_id) over (partition by source) as first from documents")
def first_definition(spark, sf_dir):
    heads = R.headers(R.assign_records(R.line_facts(_by_source(spark, sf_dir))))
    firsts = heads.groupBy("id").agg(F.min("header_offset").alias("first"))
    return heads.join(firsts, "id").select(F.col("header_offset").alias("doc_id"), "id", "first")


@query("select row_number() over (order by doc_id) as record, source as id, lang as description from documents")
def header_fields(spark, sf_dir):
    return R.headers(R.assign_records(R.line_facts(_by_source(spark, sf_dir)))).select("record", "id", "description")


@query("select p_partkey, case p_size % 4 when 0 then 'sp|' || p_partkey || '|X' when 1 then 'NC_' || p_partkey when 2 then 'tr||X' else 'db|' || p_partkey || '|' end as id, p_size % 4 = 0 as uniprot, p_size % 4 = 1 as refseq from part")
def schema_rule(spark, sf_dir):
    rows = T.table(spark, sf_dir, "part").select("p_partkey", F.expr("case p_size % 4 when 0 then 'sp|' || p_partkey || '|X' when 1 then 'NC_' || p_partkey when 2 then 'tr||X' else 'db|' || p_partkey || '|' end").alias("id"))
    return rows.withColumns({"uniprot": V.convention("uniprot"), "refseq": V.convention("refseq")})


@query("with d as (select doc_id, case when doc_id % 50 = 7 then 'x' || doc_id else source end as id, cast(n_chars as bigint) as n from documents), b as (select doc_id, id, row_number() over (partition by id order by doc_id) as k, n + case when doc_id % 5 = 0 then 1 else 0 end as n from d where doc_id % 9 > 0), a as (select *, row_number() over (partition by id order by doc_id) as k from d) select coalesce(a.id, b.id) as id, cast(coalesce(a.k, b.k) as bigint) as occurrence, case when b.id is null then 'pair.record_missing_from_index' when a.id is null then 'pair.record_missing_from_fasta' else 'pair.sequence_length_mismatch' end as code from a full join b on a.id = b.id and a.k = b.k where (b.id is null and a.id not in (select id from b)) or a.id is null or a.n <> b.n")
def index_compare(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    name = F.expr("case when doc_id % 50 = 7 then 'x' || doc_id else source end").alias("id")
    own = d.select(name, F.col("doc_id").alias("ordinal"), F.col("n_chars").cast("long").alias("seq_len"), F.lit(0).alias("seq_offset"), F.lit(60).alias("line_bases"), F.lit(61).alias("line_bytes"), F.lit(True).alias("uniform"))
    other = own.where("ordinal % 9 > 0").withColumn("seq_len", F.expr("seq_len + case when ordinal % 5 = 0 then 1 else 0 end"))
    return V.compare_index(own, other).select("id", F.col("occurrence").cast("long").alias("occurrence"), "code")


@query("with " + LINES + ", s as (select file, string_agg(regexp_replace(content, '[\\x00-\\x20]', '', 'g'), '' order by k) as seq from ln where k > 0 group by file) select file, cast(strlen(seq) as bigint) as symbols, cast(ceil(strlen(seq) / 60.0) as bigint) as lines from s")
def repair_lines(spark, sf_dir):
    """The size of each repaired record: symbols, and lines of 60."""
    rows = V.repaired(T.lines(spark, sf_dir)).where("chunk >= 0")
    size = F.length(F.regexp_replace("value", "\n", ""))
    sums = rows.groupBy("file").agg(F.sum(size).alias("symbols"), F.sum(F.length("value") - size + 1).alias("lines"))
    files = T.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id")).alias("file"))
    return files.join(sums, "file", "left").select("file", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("lines", F.lit(0)).alias("lines"))


@query("with " + LINES + " select file, string_agg(regexp_replace(content, '[\\x00-\\x20]', '', 'g'), '' order by k) as sequence from ln where k > 0 group by file having sum(bases) > 0")
def read_records(spark, sf_dir):
    rows = R.read_records(T.lines(spark, sf_dir))
    return rows.select("file", F.decode(F.encode("sequence", "ISO-8859-1"), "UTF-8").alias("sequence"))


_SEVERE = "case when code like 'fasta.%' and code not in ('fasta.empty_record', 'fasta.long_header') or code = 'sequence.invalid_symbol' then 'error' else 'warning' end"


def _faulty(spark, sf_dir):
    return V.findings(T.faulty_lines(spark, sf_dir), "protein", "refseq")


@query("with " + _PART_FILES + f" select code, {_SEVERE} as severity, cast(sum(n) as bigint) as occurrences, count(distinct case when record > 0 then file || ' ' || record end) as records, cast(min(\"offset\") as bigint) as first_offset from f group by code")
def findings_every_rule(spark, sf_dir):
    """Files in which each of the rules is broken."""
    return V.by_code(_faulty(spark, sf_dir))


@query("with " + _PART_FILES + f" select count(distinct case when {_SEVERE} = 'error' then file || ' ' || record end) as records_with_errors, count(distinct case when {_SEVERE} = 'warning' then file || ' ' || record end) as records_with_warnings from f where record > 0")
def records_by_severity(spark, sf_dir):
    return V.records_by_severity(_faulty(spark, sf_dir))


@query("with " + LINES + " select cast(sum(content_len + 1) as bigint) as bytes, count(*) as lines, count(*) filter (is_header) as records, count(*) filter (is_header) as records_completed, cast(sum(bases) as bigint) as symbols from ln")
def examined(spark, sf_dir):
    return V.examined(T.lines(spark, sf_dir))


@query("with " + LINES + ", h as (select unnest(regexp_extract_all(hex(encode(content)), '..')) as h from ln where not is_header and bases > 0), b as (select (position(substr(h, 1, 1) in '0123456789ABCDEF') - 1) * 16 + position(substr(h, 2, 1) in '0123456789ABCDEF') - 1 as byte from h) select cast(byte as bigint) as byte, count(*) as n from b where byte > 32 and not (byte between 65 and 90 or byte between 97 and 122 or byte in (42, 45)) group by byte")
def invalid_symbols(spark, sf_dir):
    return V.invalid_symbols(T.lines(spark, sf_dir), "protein").select(F.col("byte").cast("long").alias("byte"), "n")


_SIDES = _LAYOUT + ", w as (select b.*, cast(coalesce(sum(bases) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as s from b)"
_ASKED = _SIDES + ", " + REG + """, ask as (select request, rec.*, coalesce(start_, 1) - 1 as f, least(coalesce(end_, seq_len), seq_len) as t from reg join rec on name = rec.file where coalesce(start_, 1) <= seq_len)"""


@query("with " + _ASKED + """ select request, cast(case when uniform then seq_offset + f // line_bases * line_bytes + f % line_bases else a.line_offset end as bigint) as byte_start,
  cast(case when uniform then seq_offset + (t - 1) // line_bases * line_bytes + (t - 1) % line_bases + 1 else z.line_offset + z.content_len + 1 end as bigint) as byte_end,
  cast(case when uniform then 0 else f - a.s end as bigint) as leading, cast(case when uniform then 0 else z.s + z.bases - t end as bigint) as trailing
  from ask join w a on a.file = ask.file and a.s <= f and f < a.s + a.bases join w z on z.file = ask.file and z.s < t and t <= z.s + z.bases""")
def disk_spans(spark, sf_dir):
    """Where in the documents' files the symbols of regions stand."""
    lines = T.kept(T.lines(spark, sf_dir))
    idx = R.index(lines).withColumn("ordinal", F.substring("id", 4, 20).cast("long"))
    asked = X.resolve(X.lookup(Q.parse_regions(T.regions(spark, sf_dir)), idx)).where("error is null")
    return P.disk_spans(asked, R.side_table(lines)).select("request", "byte_start", "byte_end", "leading", "trailing")


_ASCII = "docs as (select 'doc' || doc_id as id, lang, string_split(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g'), chr(10)) as parts, regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g'), '[\\x00-\\x20]', '', 'g') as seq from documents), idx as (select *, cast(length(seq) as bigint) as seq_len from docs where seq <> '')"


_FIELDS = """own as (select doc_id, case when doc_id % 40 = 1 then 'y' || doc_id else source || doc_id % 3 end as id, row_number() over (partition by case when doc_id % 40 = 1 then 'y' || doc_id else source || doc_id % 3 end order by doc_id) as k, doc_id % 4 > 0 as uniform, n_chars from documents),
other as (select doc_id, source || case when doc_id % 13 = 0 then 3 else doc_id % 3 end as id, row_number() over (partition by source || case when doc_id % 13 = 0 then 3 else doc_id % 3 end order by doc_id) as k, doc_id % 4 > 0 and doc_id % 17 > 0 as uniform, n_chars from documents),
pair as (select coalesce(a.id, b.id) as id, coalesce(a.k, b.k) as occurrence, a.id is null as no_a, b.id is null as no_b, a.doc_id as i, b.doc_id as j, a.n_chars as n, b.n_chars + (b.doc_id % 5 = 0)::int as m, a.uniform as u, b.uniform as v from own a full join other b on a.id = b.id and a.k = b.k)"""


@query("with " + _FIELDS + """ select id, cast(occurrence as bigint) as occurrence, code from pair, (values ('pair.record_missing_from_index'), ('pair.record_missing_from_fasta'), ('pair.sequence_length_mismatch'), ('pair.sequence_offset_mismatch'), ('pair.line_geometry_mismatch')) c(code)
  where case code when 'pair.record_missing_from_index' then no_b and id not in (select id from other) when 'pair.record_missing_from_fasta' then no_a when 'pair.sequence_length_mismatch' then n <> m when 'pair.sequence_offset_mismatch' then i % 50 <> j % 50 + (j % 7 = 0)::int else u <> v or u and j % 11 = 0 end""")
def index_compare_fields(spark, sf_dir):
    """An index against one with other ids, lengths, offsets and line widths: each of the codes of a pair occurs."""
    d = T.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "ordinal")
    name = lambda k: F.concat("source", k.cast("string"))
    flag = lambda c: F.expr(c).cast("int")
    own = d.select(F.expr("case when ordinal % 40 = 1 then 'y' || ordinal else source || ordinal % 3 end").alias("id"), "ordinal", F.col("n_chars").alias("seq_len"), (F.col("ordinal") % 50).alias("seq_offset"), F.lit(60).alias("line_bases"), F.lit(61).alias("line_bytes"), F.expr("ordinal % 4 > 0").alias("uniform"))
    other = d.select(
        name(F.when(F.col("ordinal") % 13 == 0, 3).otherwise(F.col("ordinal") % 3)).alias("id"), "ordinal", (F.col("n_chars") + flag("ordinal % 5 = 0")).alias("seq_len"),
        (F.col("ordinal") % 50 + flag("ordinal % 7 = 0")).alias("seq_offset"), (60 - flag("ordinal % 11 = 0")).alias("line_bases"), F.lit(61).alias("line_bytes"), F.expr("ordinal % 4 > 0 and ordinal % 17 > 0").alias("uniform"),
    )
    return V.compare_index(own, other).select("id", F.col("occurrence").cast("long").alias("occurrence"), "code")


@query("with " + _ASCII + " select id, seq_len from idx")
def source_index(spark, sf_dir):
    """The documents as FASTA files, read through the source, and their stored index."""
    return T.stored(spark, sf_dir)[1].select("id", "seq_len")


@query("with " + _ASCII + ", " + REG + f" select request, name, {_CUT} as bases from reg join idx on name = id where coalesce(start_, 1) <= seq_len")
def positional_read(spark, sf_dir):
    """Regions of the documents' files, by seeking to the spans that the stored index gives."""
    _, idx, sides = T.stored(spark, sf_dir)
    asked = X.resolve(X.lookup(Q.parse_regions(T.regions(spark, sf_dir)), idx)).where("error is null")
    return X.extract(asked, P.read_chunks(P.chunks_asked(asked), sides)).select("request", "name", "bases")


def _moved(sides, lines):
    """Side tables of which each third physical line was moved by a byte."""
    ln = lines.select("file", F.col("line_offset").alias("byte_offset"), (F.col("line_no") - 1).alias("at"))
    return sides.join(ln, ["file", "byte_offset"]).withColumn("byte_offset", F.col("byte_offset") + F.when(F.col("at") % 3 == 2, 1).otherwise(0)).drop("at")


@query("with " + _SIDES + " select w.file, min(cast(s as bigint)) as base_start from w join rec using (file) where not uniform and k % 3 = 2 group by w.file")
def side_compare(spark, sf_dir):
    """The first line that differs from a side table of which each third line was moved."""
    lines = T.kept(T.lines(spark, sf_dir))
    own = T.kept(R.side_table(lines))
    return V.compare_sides(own, _moved(own, lines)).select("file", "base_start")


_NUMBERED = _SIDES + ", z as (select w.*, row_number() over (partition by file order by k) as entry, seq_offset, seq_len, sum(content_len + 1) over (partition by file) + min(line_offset) over (partition by file) as body from w join rec using (file))"


@query("with " + _NUMBERED + """, ia as (select *, substr(file, 4)::bigint as d from rec), ib as (select *, seq_len + (d % 5 = 0)::int as n, seq_offset + (d % 7 = 0)::int as o, uniform and d % 17 > 0 as u from ia where d % 9 > 0)
select ia.file as id, code, cast(case when code = 'pair.side_table_mismatch' then (select min(entry) from z where z.file = ia.file and k % 3 = 2) end as bigint) as line from ia left join ib using (file),
  (values ('pair.record_missing_from_index'), ('pair.sequence_length_mismatch'), ('pair.sequence_offset_mismatch'), ('pair.line_geometry_mismatch'), ('pair.side_table_mismatch')) c(code)
where case code when 'pair.record_missing_from_index' then ib.file is null when 'pair.sequence_length_mismatch' then n <> ia.seq_len when 'pair.sequence_offset_mismatch' then o <> ia.seq_offset when 'pair.line_geometry_mismatch' then u <> ia.uniform
  else not ia.uniform and not u and exists (from z where z.file = ia.file and k % 3 = 2) end""")
def index_compare_sides(spark, sf_dir):
    """The documents' index and side tables against damaged ones, with the first side table line that differs."""
    lines = T.kept(T.lines(spark, sf_dir))
    d = F.substring("id", 4, 20).cast("long")
    own, sides = T.kept(R.index(lines).withColumn("ordinal", d)), T.kept(R.side_table(lines))
    other = own.where(d % 9 > 0).withColumns({"seq_len": F.col("seq_len") + (d % 5 == 0).cast("int"), "seq_offset": F.col("seq_offset") + (d % 7 == 0).cast("int"), "uniform": F.col("uniform") & (d % 17 > 0)})
    return V.compare_index(own, other, sides, _moved(sides, lines)).select("id", "code", "line")


@query("with d as (select case when doc_id % 50 = 7 then 'x' || doc_id else source end as id, doc_id from documents), b as (select * from d where doc_id % 9 > 0), n as (select id, count(*) filter (doc_id % 9 > 0) as b, count(*) as a from d group by id) select cast(sum(b) as bigint) as entries, cast(sum(b) as bigint) as matched, cast(sum(case when b > 0 then a - b else 0 end) as bigint) as omitted_duplicates from n")
def index_counts(spark, sf_dir):
    """How many entries of an index meet records, and how many records it leaves out as later duplicates."""
    d = T.table(spark, sf_dir, "documents")
    name = F.expr("case when doc_id % 50 = 7 then 'x' || doc_id else source end").alias("id")
    own = d.select(name, F.col("doc_id").alias("ordinal"), F.lit(1).alias("seq_len"), F.lit(0).alias("seq_offset"), F.lit(60).alias("line_bases"), F.lit(61).alias("line_bytes"), F.lit(True).alias("uniform"))
    return V.compared(own, own.where("ordinal % 9 > 0"))


@query("with " + _NUMBERED + """, rows as (select file, substr(file, 4)::bigint % 24 as m, max(z.seq_offset) as seq_offset, max(z.seq_len) as seq_len, max(body) as size from z group by file),
idx as (select file, m, m % 2 = 0 as uniform, size, case m when 0 then 0 when 8 then size when 11 then seq_len + 1 when 15 then 0 else seq_len end as seq_len, case m when 2 then size + 5 when 17 then size else seq_offset end as seq_offset, case m when 4 then 0 else 60 end as line_bases, case m when 6 then 59 else 61 end as line_bytes from rows),
t as (select z.file, entry, idx.m as kind, idx.size, s + case when idx.m = 1 and entry = 3 then 1 else 0 end as bs, case when idx.m = 3 and entry = 2 then bases - 1 else content_len + 1 end as lb, bases, idx.seq_offset, idx.seq_len,
  line_offset + case when idx.m = 5 and entry = 2 then z.body when idx.m = 7 and entry = 1 then -1 when idx.m = 9 and entry = 2 then -2 else 0 end as bo from z join idx using (file) where not idx.uniform and idx.m <> 13),
q as (select *, sum(bases) over (w rows between unbounded preceding and current row) - bases as want, lag(bo + lb) over w as least from t window w as (partition by file order by bs)),
e as (select file, entry, case when bs <> want then 'index.side_base_start_mismatch' when lb < 1 or bases < 1 or lb < bases then 'index.side_line_geometry_invalid' when bo + lb > size then 'index.sequence_span_out_of_bounds' when entry = 1 and bo <> seq_offset then 'index.side_first_offset_mismatch' when entry > 1 and bo < least then 'index.side_line_order_invalid' end as error from q),
s as (select file, arg_min(error, entry) filter (error is not null) as error, min(entry) filter (error is not null) as entry, (select sum(bases) from t where t.file = e.file) as total from e group by file)
select file, coalesce(error0, error) as error, cast(case when error0 is null then entry end as bigint) as entry from (select idx.file, s.error as error1, s.entry,
  case when seq_len < 1 then 'index.zero_sequence_length' when seq_offset >= size then 'index.sequence_offset_out_of_bounds' when uniform and (line_bases < 1 or line_bytes < line_bases) then 'index.invalid_line_geometry'
    when uniform and seq_offset + (seq_len - 1) // line_bases * line_bytes + (seq_len - 1) % line_bases + 1 > size then 'index.sequence_span_out_of_bounds' end as error0,
  coalesce(s.error, case when not uniform and s.file is null then 'index.side_table_empty' when not uniform and total <> seq_len then 'index.side_sequence_length_mismatch' end) as error from idx left join s using (file)) where coalesce(error0, error) is not null""")
def index_damage(spark, sf_dir):
    """An index and side tables damaged in each way that opening it must notice."""
    lines = T.kept(T.lines(spark, sf_dir))
    base = R.positions(lines).where("not is_header and bases > 0")
    m = F.substring("file", 4, 20).cast("long") % 24
    rows = base.groupBy("file", "record").agg(F.min("line_offset").alias("seq_offset"), F.sum("bases").alias("seq_len"), F.max(F.col("line_offset") + F.col("actual_bytes")).alias("size"))
    pick = lambda other, **by: F.expr("case m " + " ".join(f"when {k[1:]} then {v}" for k, v in by.items()) + f" else {other} end")
    idx = rows.withColumns({"id": F.col("file"), "m": m}).withColumns({
        "uniform": m % 2 == 0, "line_bases": pick("60", _4="0"), "line_bytes": pick("61", _6="59"),
        "seq_len": pick("seq_len", _0="0", _8="size", _11="seq_len + 1", _15="0"), "seq_offset": pick("seq_offset", _2="size + 5", _17="size"),
    })
    entry = F.row_number().over(Window.partitionBy("file").orderBy("base_start"))
    body = F.max(F.col("line_offset") + F.col("actual_bytes")).over(Window.partitionBy("file"))
    sides = base.select("file", "record", "base_start", F.col("line_offset").alias("byte_offset"), F.col("actual_bytes").alias("line_bytes"), F.col("bases").alias("line_bases"), entry.alias("entry"), body.alias("body"), m.alias("m"))
    sides = sides.where("m % 2 = 1 and m <> 13").withColumns({
        "base_start": F.expr("base_start + case when m = 1 and entry = 3 then 1 else 0 end"), "line_bytes": F.expr("case when m = 3 and entry = 2 then line_bases - 1 else line_bytes end"),
        "byte_offset": F.expr("byte_offset + case when m = 5 and entry = 2 then body when m = 7 and entry = 1 then -1 when m = 9 and entry = 2 then -2 else 0 end"),
    }).select("file", "record", "base_start", "byte_offset", "line_bytes", "line_bases")
    return K.errors(idx.drop("m"), sides).select("file", "error", "entry")


@query("with " + DNA + ", s as (select 'doc' || doc_id as file, case when doc_id % 2 = 0 then seq when doc_id % 3 = 0 then seq || regexp_replace(text, '[^A-Za-z]', '', 'g')[1:length(seq) // 15] else regexp_replace(text, '[^A-Za-z]', '', 'g') end as s from documents join dna on ordinal = doc_id), "
  f"k as (select *, length(s[1:100000]) as n, length(s[1:100000]) - length(translate(s[1:100000], '{IUPAC}', '')) as i from s), a as (select *, case when n = 0 or i * 10 > n * 9 then 'nucleotide' else 'protein' end as alphabet from k) "
  f"select file, alphabet, cast(n as bigint) as symbols, cast(case when alphabet = 'nucleotide' then length(translate(s, '{IUPAC}', '')) else 0 end as bigint) as invalid from a")
def alphabet_by_file(spark, sf_dir):
    """The alphabet that each file's sample chooses, of files of nucleotides, of prose, and of both, and the symbols outside it."""
    prose = F.regexp_replace("text", "[^A-Za-z]", "")
    d = T.table(spark, sf_dir, "documents").join(T.dna(spark, sf_dir).select(F.col("ordinal").alias("doc_id"), "seq"), "doc_id").withColumn("prose", prose)
    seq = F.expr("case when doc_id % 2 = 0 then seq when doc_id % 3 = 0 then concat(seq, substring(prose, 1, cast(length(seq) div 15 as int))) else prose end")
    rows = d.select(F.concat(F.lit("doc"), F.col("doc_id")).alias("file"), F.posexplode(F.array(F.lit(">x"), seq)).alias("k", "raw"))
    lines = rows.select("file", F.lit(0).cast("long").alias("split"), (F.col("k") * 3).cast("long").alias("line_offset"), F.col("raw").cast("binary").alias("raw"), F.lit(1).alias("term"))
    lines = T.kept(R.assign_records(R.line_facts(lines)))
    found = V.findings(lines).where("code = 'sequence.invalid_symbol'").groupBy("file").agg(F.sum("n").alias("invalid"))
    return V.sampled_files(lines).join(found, "file", "left").select("file", "alphabet", "symbols", F.coalesce("invalid", F.lit(0)).alias("invalid"))


@query("with d as (select doc_id, source || doc_id % 37 as id from documents), f as (select id, min(doc_id) as a0 from d group by id), c as (select a0, sum(length(id)) over (order by a0) as total from f), s as (select min(a0) as stop from c where total > 1500) select d.id, d.doc_id from d join f using (id), s where doc_id > a0 and (stop is null or doc_id < stop)")
def duplicates_in_budget(spark, sf_dir):
    """Duplicates up to the record whose id is too much for a budget of 1,500 bytes of names."""
    d = T.table(spark, sf_dir, "documents")
    raw = F.concat(F.lit(">"), F.col("source"), (F.col("doc_id") % 37).cast("string")).cast("binary").alias("raw")
    rows = d.select(F.lit("all").alias("file"), F.floor(F.col("doc_id") / 100).alias("split"), F.col("doc_id").alias("line_offset"), raw, F.lit(1).alias("term"))
    lines = R.assign_records(R.line_facts(rows))
    found = V.repeats(lines, 1500).select("record")
    return found.join(R.headers(lines).select("record", "id", F.col("header_offset").alias("doc_id")), "record").select("id", "doc_id")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
