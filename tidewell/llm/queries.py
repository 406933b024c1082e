"""Queries that apply the corpus operators to whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import classifier, exact_dedup, filter_audit, fingerprints, html_blocks, mixing, pieces, quality_rules, resampling, sharding, simhash, substrings, warc
from tidewell.llm.common import table


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates64(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.repetitions(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sharding.assign(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = classifier.featured(table(spark, sf_dir, "documents"))
    return classifier.score_features(features, classifier.train_on(features, table(spark, sf_dir, "labels")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.round_trip(table(spark, sf_dir, "pages"))
    return made.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents"))


def queries() -> dict:
    made = (op1_document_fingerprints, op2_simhash_near_dedup, op3_mixing, op4_sharding, op5_substring_dedup, op6_quality_classifier, op7_quality_rules, op8_sentencepiece, op9_html_extraction,
            op10_warc, op11_filter_audit, op12_importance_resampling, op13_exact_dedup)
    return {f.__name__: f for f in made}


_WORDS = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))"

OP3_SQL = rf"""
with rows as (
  select doc_id, source, {_WORDS}::bigint as size,
    ('0x' || md5(concat_ws('|', '0', coalesce(doc_id::varchar, ''), md5(coalesce(text, ''))))[1:13])::bigint as draw
  from documents),
sums as (select source, sum(size)::bigint as source_size from rows group by source),
caps as (
  select source, source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight, 3 * source_size as cap
  from sums),
poured as (
  select *, ((sum(source_size) over () - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))::double
      / (sum(weight) over (o rows between current row and unbounded following))::double) as level
  from caps window o as (order by cap::double / weight, source nulls last)),
told as (select *, cap <= weight * level as is_full from poured),
targets as (
  select source, source_size,
    case when is_full then cap::double
      else weight * (select level from told where not is_full order by cap::double / weight, source nulls last limit 1) end as target
  from told),
rates as (select *, case when source_size > 0 then least(target / source_size, 3.0::double) else 0.0::double end as rate from targets)
select doc_id, size, source_size, target,
  (size * (floor(rate)::bigint + (draw < (rate - floor(rate)) * 4503599627370496.0::double)::bigint))::bigint as taken
from rows join rates on rows.source is not distinct from rates.source
"""

_RATIOS = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "echoes": ("n_echoes", "n_words"), "shouting": ("n_upper", "word_chars"), "long_words": ("n_long", "n_words")}
_PPM = "({a} * 1000000 // greatest({b}, 1))"

OP7_SQL = rf"""
with split as (
  select doc_id, lang, source, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: translate(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13), '') <> '') as lines,
    row_number() over () as k
  from documents),
windows as (
  select k, i, array_to_string(words[i:i + 7], ' ') as w
  from (select k, words, unnest(range(1, len(words) - 6)) as i from split where len(words) >= 8)),
twice as (select k, i from (select k, i, count(*) over (partition by k, w) as c from windows) where c > 1),
covered as (select k, count(distinct i + d) as n from twice, range(0, 8) as r(d) group by k),
base as (
  select doc_id, lang, source, len(words)::bigint as n_words,
    length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint as word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
    len(lines)::bigint as n_lines, (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::bigint as n_upper,
    len(list_filter(words, lambda w: length(w) > 18))::bigint as n_long,
    len(list_filter(list_zip(words[2:], words), lambda p: p[1] = p[2]))::bigint as n_echoes
  from split left join covered using (k)),
rated as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from base),
long as ({" union all ".join(f"select lang, source, '{r}' as ratio, {_PPM.format(a=a, b=b)} as ppm from rated where not base_failed" for r, (a, b) in _RATIOS.items())}
  union all select lang, source, 'length', n_words from rated where not base_failed),
fine as (
  select lang, source, ratio, (ppm >> greatest(length(bin(ppm)) - 6, 0)) << greatest(length(bin(ppm)) - 6, 0) as bin, count(*)::hugeint as n
  from long group by all),
wide as (select lang, ratio, bin, sum(n)::hugeint as n from fine group by all),
whole as (select lang, ratio, sum(n)::hugeint as n from fine group by all),
weighed as (
  select lang, source, ratio, bin, sum(w)::hugeint as w from (
    select f.lang, f.source, f.ratio, f.bin, f.n * t.n as w from fine f join whole t on f.lang is not distinct from t.lang and f.ratio = t.ratio
    union all
    select s.lang, s.source, s.ratio, v.bin, 30 * v.n from (select distinct lang, source, ratio from fine) s join wide v on s.lang is not distinct from v.lang and s.ratio = v.ratio)
  group by all),
ranked as (select *, sum(w) over (partition by lang, source, ratio order by bin) as upto, sum(w) over (partition by lang, source, ratio) as total from weighed),
levels as (select lang, source, ratio, min(bin) filter (where upto * 2 >= total) as mid, min(bin) filter (where upto * 4 >= total * 3) as high from ranked group by all),
bounds as (select lang, source, {", ".join(f"max(high + 8 * (high - mid)) filter (where ratio = '{r}') as {r}_bound" for r in _RATIOS)}, max(mid) filter (where ratio = 'length') as usual from levels group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {" and ".join(f"coalesce(({a}::double - 4::double * greatest(n_words::double / usual::double, 1::double)) * 1000000::double <= {r}_bound::double * {b}::double, true)" for r, (a, b) in _RATIOS.items())} as kept
from rated left join bounds on rated.lang is not distinct from bounds.lang and rated.source is not distinct from bounds.source
"""

OP10_SQL = """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as d, strlen(coalesce(html, ''))::bigint as n from pages),
g as (select d, max(page_id) as newest from p where n >= 1000 group by d)
select p.page_id, n as payload_bytes, p.d as payload_digest,
  case when newest <> p.page_id then 'revisit' else 'response' end as record_type,
  case when newest <> p.page_id then newest end as refers_to
from p left join g using (d)
"""


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_LOWER_AZ = f"translate(coalesce(text, ''), {_AZ}, 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
with recursive split as (
  select d.doc_id, coalesce(d.source, '') as part, coalesce(d.text, '') as t, coalesce(l.quality = 1, false) as good, coalesce(l.toxic = 1, false) as toxic,
    list_filter(regexp_split_to_array(coalesce(d.text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
    d.doc_id > min(d.doc_id) over (partition by coalesce(d.text, '')) as later
  from documents d left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) l using (doc_id)),
failed as (
  select doc_id, part, good, toxic,
    case when len(words) < 200 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end
    || case when 100 * (length(t) - length(translate(t, {_AZ}, ''))) > 2 * length(t) then 'C' else '' end
    || case when length(t) <> length(translate(t, '#$%&*|', '')) then 'D' else '' end || case when later then 'E' else '' end as fails
  from split),
orders as (
  select '' as o
  union all
  select o || f from orders, (values ('A'), ('B'), ('C'), ('D'), ('E')) v(f) where not contains(o, f)),
steps as (select o as filter_order, k::int as step, o[k] as f, o[1:k - 1] as before from orders, range(1, 6) r(k) where length(o) = 5),
seen as (
  select part, filter_order, step, f, good, toxic, contains(fails, f) as here, fails = f as alone,
    length(fails) <> length(translate(fails, before, '')) as gone
  from failed, steps),
made as (
  select part, filter_order, step, f, count(*) filter (not here and not gone) as kept, count(*) filter (here and not gone) as removed,
    count(*) filter (here and gone) as redundant, count(*) filter (alone) as unique_fails, count(*) filter (here and not gone and good) as good_lost,
    count(*) filter (here and not gone and toxic) as toxic_lost
  from seen group by all)
select * exclude (f), (sum(removed) over (partition by part, f))::bigint as shapley from made
"""

#: The crc32 of a feature, a byte at a time, by the table of its polynomial.
OP12_SQL = rf"""
with crc_table as (
  select list(list_reduce(range(9), lambda c, i: case when i = 0 then c when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n) order by n) as crcs
  from range(256) r(n)),
split as (
  select 0 as kind, doc_id, list_filter(regexp_extract_all({_LOWER_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words from documents
  union all
  select 1, item_id, list_filter(regexp_extract_all({_LOWER_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') from benchmark),
features as (
  select kind, doc_id, unnest(words) as feature from split
  union all
  select kind, doc_id, unnest(list_transform(list_zip(words[:-2], words[2:]), lambda p: p[1] || ' ' || p[2])) from split where len(words) > 1),
tallied as (select kind, doc_id, feature, count(*) as n from features group by all),
coded as (select feature, hex(encode(feature)) as h from (select distinct feature from tallied)),
placed as (
  select feature, xor(4294967295, list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::bigint),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 as bucket
  from coded, crc_table),
held as (select kind, doc_id, bucket, n from tallied join placed using (feature)),
counts as (select bucket, coalesce(sum(n) filter (kind = 0), 0)::bigint as s, coalesce(sum(n) filter (kind = 1), 0)::bigint as t from held group by bucket),
totals as (select sum(s)::bigint as all_s, sum(t)::bigint as all_t from counts),
gains as (select bucket, floor(1000 * ln(((t + 1)::double * (all_s + 10000)::double) / ((s + 1)::double * (all_t + 10000)::double)))::bigint as gain from counts, totals),
weights as (select doc_id, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n)::double)::bigint as weight from held join gains using (bucket) where kind = 0 group by doc_id),
scored as (
  select s.doc_id, len(words) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || sha256('7:' || s.doc_id)[1:8])::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score
  from split s left join weights using (doc_id) where kind = 0),
placed_rows as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_words >= 20) as able from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 25 * able // 100 then place::bigint end as rank from placed_rows
"""

OP13_SQL = f"""
with rows as (select doc_id, {_LOWER_AZ} as t from documents)
select doc_id, max(doc_id) over w as keep_id, (count(*) over w)::bigint as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from rows window w as (partition by t)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op7_quality_rules": OP7_SQL, "op10_warc": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_exact_dedup": OP13_SQL}
