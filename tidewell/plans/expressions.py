"""Queries that apply string, date and number expressions to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import dates, numbers, text
from tidewell.operators import rubric
from tidewell.plans.fixtures import table
from tidewell.plans.registry import query


@query("STR-02", "select c_custkey, regexp_replace(lower(trim(c_name)), '[^a-z0-9_-]', '', 'g') as key from customer")
def keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.normalize_key(F.col("c_name")).alias("key"))


@query("STR-04", """select p_partkey, list_sort(list_distinct(list_filter(list_transform(string_split(' ' || p_brand || ' , ' || lower(p_type) || ',,' || p_type, ','), lambda x: lower(trim(x))), lambda x: x <> ''))) as names from part""")
def names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.patient_names(F.concat(F.lit(" "), "p_brand", F.lit(" , "), F.lower("p_type"), F.lit(",,"), "p_type")).alias("names"))


@query("STR-08", "select doc_id, ((length(text) - length(replace(text, 'th', ''))) // 2)::bigint as n from documents")
def occurrences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(text.occurrences(F.col("text"), F.lit("th"))).alias("n"))


@query("STR-19", r"select event_id, substr(sha1('/api|' || substr(regexp_replace('failed after ' || value || ' ms for ' || user_id, '\d+', '<n>', 'g'), 1, 300)), 1, 16) as fingerprint from (select event_id, value::decimal(18,2) as value, user_id from events)")
def fingerprints(spark, sf):
    message = F.concat(F.lit("failed after "), F.col("value").cast("decimal(18,2)"), F.lit(" ms for "), "user_id")
    return table(spark, sf, "events").select("event_id", text.error_fingerprint(F.lit("/api"), message).alias("fingerprint"))


@query("STR-20", "select o_orderkey, sha256(o_custkey || '|' || o_orderstatus || '|') as signature from orders")
def signatures(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.digest_key(F.col("o_custkey"), F.col("o_orderstatus"), F.lit(None)).alias("signature"))


@query("STR-21", r"select p_partkey, lower(regexp_replace(p_name, '\s+', '', 'g')) as key from part")
def keyword_keys(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.keyword_key(F.col("p_name")).alias("key"))


@query("DAT-04", "select event_id, (ts + interval 9 hour)::date as day from events")
def seoul_days(spark, sf):
    instant = F.from_utc_timestamp(F.col("ts").cast("string"), dates.SEOUL)  # the texts are in UTC, whatever the session's zone
    return table(spark, sf, "events").select("event_id", F.to_date(instant).alias("day"))


@query("DAT-01", "select o_orderkey, o_orderdate::date as day from orders")
def mixed_dates(spark, sf):
    day = F.to_date("o_orderdate")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    written = F.when(F.col("o_orderkey") % 4 == 0, serial).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "yyyy.M.d")).when(F.col("o_orderkey") % 4 == 2, F.date_format(day, "M/d/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", dates.parse_mixed_date(written).alias("day"))


@query("DAT-08", "select o_orderkey, strftime(o_orderdate, '%Y-%m') as month, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') as week from orders")
def labels(spark, sf):
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", dates.bucket_label(day, "month").alias("month"), dates.bucket_label(dates.bucket(day, "week"), "week").alias("week"))


@query("MTH-01", "select o_orderkey, o_totalprice::decimal(18,2) as amount from orders")
def amounts(spark, sf):
    written = F.concat(F.lit("₩ "), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2))
    return table(spark, sf, "orders").select("o_orderkey", numbers.parse_amount(written).alias("amount"))


@query("JSN-01", "select event_id, (props->>'$.k')::int as k, event_type || ':' || (props->>'$.k') as label from events")
def json_paths(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", k.cast("int").alias("k"), F.concat_ws(":", "event_type", k).alias("label"))


@query("FLT-09", r"select p_partkey, p_name from part where p_name ilike '%WIDGET%' or p_brand ilike 'brand#1%'")
def searched(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").ilike("%WIDGET%") | F.col("p_brand").ilike("brand#1%")).select("p_partkey", "p_name")


@query("FLT-10", "select o_orderkey from orders where nullif(o_orderstatus, 'P') is distinct from 'F'")
def distinct_from(spark, sf):
    return table(spark, sf, "orders").where(~F.nullif("o_orderstatus", F.lit("P")).eqNullSafe(F.lit("F"))).select("o_orderkey")


@query("FLT-13", "select doc_id, source from documents d where exists (select 1 from documents where source = 'web') and source = 'web' or not exists (select 1 from documents where source = 'web')")
def preferred_source(spark, sf):
    from tidewell.operators.choices import preferring

    return preferring(table(spark, sf, "documents"), F.coalesce(F.col("source") == "web", F.lit(False))).select("doc_id", "source")


@query("FLT-05", "select o_orderkey, o_orderdate from orders where o_orderdate >= date_trunc('month', date '2000-08-20' - interval 6 month)")
def six_months(spark, sf):
    first = F.trunc(F.add_months(F.lit("2000-08-20").cast("date"), -6), "month")
    return table(spark, sf, "orders").where(F.col("o_orderdate") >= first).select("o_orderkey", "o_orderdate")


@query("QLT-01", r"""with m as (select doc_id, length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) as n, len(string_split(coalesce(text, ''), chr(10))) - 1 as k from documents)
  select doc_id, case when n >= 1500 then 'good' when n >= 700 then 'warn' else 'poor' end as length_status, n < 700 as critical, case when k >= 3 then 'good' when k >= 1 then 'warn' else 'poor' end as line_status from m""")  # fmt: skip
def post_measures(spark, sf):
    text_ = F.coalesce("text", F.lit(""))
    n, k = F.length(F.regexp_replace(text_, r"\s+", "")), F.size(F.split(text_, "\n")) - 1
    return table(spark, sf, "documents").select("doc_id", rubric.status(n, 1500, 700).alias("length_status"), (n < 700).alias("critical"), rubric.status(k, 3, 1).alias("line_status"))
