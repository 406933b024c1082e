"""Queries on ad performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import numbers
from tidewell.operators import ads as A
from tidewell.plans.fixtures import ADS, ads, table
from tidewell.plans.registry import query

SUMS = "sum(impressions)::bigint as impressions, sum(clicks)::bigint as clicks, sum(cost)::decimal(18,2) as cost"
CAMPAIGN, GROUP, WORD = "adgroup_id = '' and keyword_id = ''", "adgroup_id <> '' and keyword_id = ''", "keyword_id <> ''"
CTR = "case when impressions <> 0 then clicks::double * 100.0::double / impressions::double end as ctr"
RATIOS = CTR + ", case when clicks <> 0 then cost::double / clicks::double end as cpc"


@query("AGG-33", f"with {ADS}, s as (select metric_date, {SUMS} from ads where {CAMPAIGN} group by all) select *, {RATIOS} from s")
def total_series(spark, sf):
    return A.with_ratios(ads(spark, sf).where(A.level() == "campaign").groupBy("metric_date").agg(*A.sums()))


@query("AGG-36", f"with {ADS}, s as (select campaign_id, case when {CAMPAIGN} then 'campaign' when {GROUP} then 'adgroup' else 'keyword' end as level, {SUMS} from ads group by all) select *, {RATIOS} from s")
def ratios(spark, sf):
    return A.with_ratios(ads(spark, sf).groupBy("campaign_id", A.level().alias("level")).agg(*A.sums()))


@query("AGG-31", f"""with {ADS}, c as (select metric_date, campaign_id, {SUMS} from ads where {CAMPAIGN} group by all), g as (select metric_date, campaign_id, {SUMS} from ads where {GROUP} group by all)
  select * from c union all select g.* from g anti join c using (metric_date, campaign_id)""")  # fmt: skip
def fallback(spark, sf):
    return A.campaign_or_groups(ads(spark, sf))


@query("AGG-29", f"""with {ADS}, c as (select campaign_id, max_by(campaign_name, (metric_date, campaign_name)) as campaign_name, {SUMS} from ads where {CAMPAIGN} group by all),
  g as (select campaign_id, count(distinct adgroup_id) as n_groups, sum(clicks)::bigint as group_clicks from ads where {GROUP} group by all) select * from c left join g using (campaign_id)""")  # fmt: skip
def campaign_table(spark, sf):
    """The nested array is told by its size and its clicks."""
    made = A.campaign_table(ads(spark, sf))
    return made.withColumns({"n_groups": F.size("adgroups").cast("long"), "group_clicks": F.aggregate("adgroups", F.lit(0).cast("long"), lambda s, x: s + x["clicks"])}).drop("adgroups")


@query("AGG-30", f"""with {ADS}, top as (select campaign_id from ads where {CAMPAIGN} group by campaign_id order by sum(clicks) desc, campaign_id limit 8),
  s as (select campaign_id, date_trunc('month', metric_date)::date as period, {SUMS} from ads semi join top using (campaign_id) where {CAMPAIGN} group by all) select campaign_id, period, {CTR}, clicks from s""")  # fmt: skip
def campaign_trend(spark, sf):
    return A.campaign_trend(ads(spark, sf), "month")


@query("SRT-02", f"with {ADS} select keyword_id, {SUMS} from ads where {WORD} group by all order by clicks desc, keyword_id limit 20")
def top_keywords(spark, sf):
    return A.top_keywords(ads(spark, sf), 20)


@query("AGG-34", f"""with {ADS}, s as (select metric_date, campaign_id, {SUMS} from ads where {CAMPAIGN} group by all) select metric_date, {", ".join(f"max(case when campaign_id = 'camp{i}' and impressions <> 0 then clicks::double * 100.0::double / impressions::double end) as camp{i}" for i in range(4))} from s group by all""")
def ctr_matrix(spark, sf):
    rows = ads(spark, sf).where(A.level() == "campaign").groupBy("metric_date").pivot("campaign_id", [f"camp{i}" for i in range(4)])
    return rows.agg(numbers.ratio(F.sum("clicks"), F.sum("impressions"), 100.0))


@query("AGG-35", f"with {ADS} select campaign_id, min_by(campaign_name, (metric_date, campaign_name)) as campaign_name from ads group by all")
def first_names(spark, sf):
    return ads(spark, sf).groupBy("campaign_id").agg(F.min(F.struct("metric_date", "campaign_name"))["campaign_name"].alias("campaign_name"))


@query("AGG-38", """with catalog as (select * from (values ('purchase', 1), ('signup', 2)) t(action_type, place)),
  s as (select event_type as action_type, count(*) as total from events where event_type <> 'view' group by all)
  select action_type, total, place, row_number() over (order by place nulls last, total desc, action_type)::int as position from s left join catalog using (action_type)""")  # fmt: skip
def action_summary(spark, sf):
    catalog = spark.createDataFrame([("purchase", 1), ("signup", 2)], "action_type string, place int")
    return A.action_summary(table(spark, sf, "events").select(F.col("event_type").alias("action_type"), F.lit(1).alias("n")), ["view"], catalog)


@query("AGG-39", """select user_id, count(*) filter (where event_type = 'view') as view, count(*) filter (where event_type = 'click') as click,
  coalesce(nullif(count(*) filter (where event_type = 'purchase'), 0), nullif(count(*) filter (where event_type = 'signup'), 0)) as converted from events group by all""")  # fmt: skip
def funnel(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", F.lit(1).cast("long").alias("n"))
    return A.funnel(rows, "event_type", "n", ["view", "click"], ["purchase", "signup"], ["user_id"])


@query("SRC-13", """with a as (select o_orderkey, max_by(l_quantity, l_linenumber) as action_count, l_returnflag as action_type from lineitem join orders on l_orderkey = o_orderkey where l_linenumber <= 4 and l_orderkey in
    (select l_orderkey from lineitem group by 1 having count(*) = count(distinct l_linenumber)) group by o_orderkey, l_returnflag),
  b as (select l_orderkey as o_orderkey, max_by(l_extendedprice, l_linenumber) as action_value, l_returnflag as action_type from lineitem where l_linenumber > 2 and l_orderkey in
    (select l_orderkey from lineitem group by 1 having count(*) = count(distinct l_linenumber)) and l_orderkey in (select o_orderkey from orders) group by l_orderkey, l_returnflag)
  select o_orderkey, action_type, coalesce(action_count, 0) as action_count, action_value from a full join b using (o_orderkey, action_type)""")  # fmt: skip
def actions(spark, sf):
    lines = table(spark, sf, "lineitem")
    clean = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("m")).where("n = m").select("l_orderkey")
    lines = lines.join(clean, "l_orderkey", "left_semi").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    item = lambda v: F.struct("l_linenumber", F.col("l_returnflag").alias("action_type"), F.col(v).alias("value"))
    listed = lambda keep, v: F.array_sort(F.collect_list(F.when(keep, item(v))))
    made = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(listed(F.col("l_linenumber") <= 4, "l_quantity").alias("actions"), listed(F.col("l_linenumber") > 2, "l_extendedprice").alias("action_values"))
    return A.action_rows(made)
