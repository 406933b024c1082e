"""The domain's tables, derived from the test tables in the DataFrame API and, for the SQL, as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their orders. A task hashes its orders, of which it needs two keys each, in place of sorting their lines, which
    are many times as many and as wide as what is made of them."""
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").hint("shuffle_hash"), _same("l_orderkey", "o_orderkey"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of receipts; whole receipts of every seventh order, and first lines of every eleventh, are reversed."""
    base = order_lines(spark, sf_dir).selectExpr(
        "concat('h', o_custkey % 5) as hospital_id",
        "case o_custkey % 3 when 0 then 'intovet' when 1 then 'woorien' else 'efriends' end as chart_type",
        "cast(l_shipdate as date) as service_date",
        "case when o_custkey % 97 = 0 then '(고객명 미상)' else concat('c', o_custkey) end as customer",
        "case when l_partkey % 50 = 0 then '(환자명 미상)' else concat('p', l_partkey % 4) end as patient",
        "concat('R', l_orderkey) as receipt",
        "l_orderkey as run_id",
        "l_linenumber as line_no",
        "cast(l_extendedprice as decimal(18,2)) as amount",
    )
    # The reversed lines beside their own, so that the join is worked out once
    back = "run_id % 7 = 0 or (run_id % 11 = 0 and line_no = 1)"
    both = base.selectExpr("*", f"explode(case when {back} then array(false, true) else array(false) end) as reversed")
    return both.withColumn("amount", F.when(F.col("reversed"), -F.col("amount")).otherwise(F.col("amount")).cast("decimal(18,2)")).drop("reversed")


LEDGER = """
base as (
  select 'h' || (o_custkey % 5) as hospital_id,
    case o_custkey % 3 when 0 then 'intovet' when 1 then 'woorien' else 'efriends' end as chart_type,
    l_shipdate::date as service_date,
    case when o_custkey % 97 = 0 then '(고객명 미상)' else 'c' || o_custkey end as customer,
    case when l_partkey % 50 = 0 then '(환자명 미상)' else 'p' || (l_partkey % 4) end as patient,
    'R' || l_orderkey as receipt, l_orderkey as run_id, l_linenumber as line_no, l_extendedprice::decimal(18,2) as amount
  from lineitem join orders on l_orderkey = o_orderkey),
ledger as (
  select * from base
  union all
  select * replace ((-amount)::decimal(18,2) as amount) from base where run_id % 7 = 0 or (run_id % 11 = 0 and line_no = 1))"""


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ad facts at three grains: blank ids tell the campaign's and the ad group's own rows from those of keywords."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_shipdate as date) as metric_date",
        "concat('h', l_suppkey % 4) as hospital_id",
        "concat('camp', l_partkey % 20) as campaign_id",
        "concat('Campaign ', l_partkey % 20, ' of ', year(l_shipdate)) as campaign_name",
        "case when l_linenumber % 3 = 0 then '' else concat('group', l_partkey % 7) end as adgroup_id",
        "case when l_linenumber % 3 = 2 then concat('word', l_partkey % 60) else '' end as keyword_id",
        "cast(l_quantity * 10 as bigint) as impressions",
        "cast(l_quantity as bigint) % 7 as clicks",
        "cast(l_extendedprice as decimal(18,2)) as cost",
    )


ADS = """
ads as (
  select l_shipdate::date as metric_date, 'h' || (l_suppkey % 4) as hospital_id, 'camp' || (l_partkey % 20) as campaign_id,
    'Campaign ' || (l_partkey % 20) || ' of ' || year(l_shipdate) as campaign_name,
    case when l_linenumber % 3 = 0 then '' else 'group' || (l_partkey % 7) end as adgroup_id,
    case when l_linenumber % 3 = 2 then 'word' || (l_partkey % 60) else '' end as keyword_id,
    (l_quantity * 10)::bigint as impressions, l_quantity::bigint % 7 as clicks, l_extendedprice::decimal(18,2) as cost
  from lineitem)"""


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of keywords in sections of a results page; null where the blog was not found."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('h', o_custkey % 3) as hospital_id",
        "concat('word', o_custkey % 40) as keyword",
        "element_at(array('blog', 'view', 'total', 'place'), cast(o_orderkey % 4 + 1 as int)) as section",
        "cast(o_orderdate as date) as metric_date",
        "case when o_orderkey % 5 = 0 then null else cast(o_orderkey % 30 + 1 as int) end as rank_value",
        "case substr(o_orderpriority, 1, 1) when '1' then 'high' when '2' then 'high' when '3' then 'medium' else 'low' end as importance",
        "cast(o_custkey % 4 as int) as slot",
    )


RANKS = """
ranks as (
  select 'h' || (o_custkey % 3) as hospital_id, 'word' || (o_custkey % 40) as keyword,
    ['blog', 'view', 'total', 'place'][(o_orderkey % 4 + 1)::int] as section, o_orderdate::date as metric_date,
    case when o_orderkey % 5 = 0 then null else (o_orderkey % 30 + 1)::int end as rank_value,
    case substr(o_orderpriority, 1, 1) when '1' then 'high' when '2' then 'high' when '3' then 'medium' else 'low' end as importance,
    (o_custkey % 4)::int as slot
  from orders)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metered calls: three to an operation; every tenth user belongs to no hospital."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "case when user_id % 10 = 0 then null else concat('h', user_id % 6) end as hospital_id",
        "concat('op', event_id div 3) as operation_id",
        "event_id div 6 as run_id",
        "case event_type when 'signup' then 'blog-write' when 'purchase' then 'health_report' when 'error' then 'alimtalk-send' when 'view' then null else 'admin_extract' end as feature",
        "case when event_id % 4 = 0 then 'a' else 'b' end as provider",
        "cast(cast(value as decimal(18,2)) * 0.0001 as decimal(12,6)) as cost_usd",
        "cast(get_json_object(props, '$.k') as int) as k",
        "cast(value as decimal(18,2)) as value",
        "event_type",
        "ts",
    )


USAGE = """
usage as (
  select event_id, case when user_id % 10 = 0 then null else 'h' || (user_id % 6) end as hospital_id, 'op' || (event_id // 3) as operation_id,
    event_id // 6 as run_id,
    case event_type when 'signup' then 'blog-write' when 'purchase' then 'health_report' when 'error' then 'alimtalk-send' when 'view' then null else 'admin_extract' end as feature,
    case when event_id % 4 = 0 then 'a' else 'b' end as provider, (value::decimal(18,2) * 0.0001)::decimal(12,6) as cost_usd,
    (props->>'$.k')::int as k, value::decimal(18,2) as value, event_type, ts
  from events)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of a hospital (slot null) and of its competitors (slots 1 to 3), some without a sentiment or a date."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as review_id",
        "concat('h', user_id % 3) as hospital_id",
        "case when user_id % 4 = 0 then null else cast(user_id % 4 as int) end as slot",
        "case when event_id % 13 = 0 then null else date_add(date'2024-01-01', cast(event_id % 400 as int)) end as visit_date",
        "element_at(array('strong_positive', 'positive', 'neutral', 'negative', 'strong_negative', null), cast(event_id % 6 + 1 as int)) as sentiment",
    )


REVIEWS = """
reviews as (
  select event_id as review_id, 'h' || (user_id % 3) as hospital_id, case when user_id % 4 = 0 then null else (user_id % 4)::int end as slot,
    case when event_id % 13 = 0 then null else date '2024-01-01' + (event_id % 400)::int end as visit_date,
    ['strong_positive', 'positive', 'neutral', 'negative', 'strong_negative', null][(event_id % 6 + 1)::int] as sentiment
  from events)"""


def _same(a: str, b: str):
    return F.col(a) == F.col(b)
