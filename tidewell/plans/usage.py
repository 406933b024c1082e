"""Queries on metered usage and on the work of a hospital."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import billing as B
from tidewell.plans.fixtures import RANKS, USAGE, ranks, table, usage
from tidewell.plans.registry import query
from tidewell.streaming import alerts

USD = "decimal(18,6)"
DIM = "dim as (select unnest(['h0', 'h1', 'h2', 'h3', 'h4', 'h5', 'h9']) as hospital_id)"


def _dim(spark):
    return spark.createDataFrame([(f"h{i}",) for i in (0, 1, 2, 3, 4, 5, 9)], "hospital_id string")


@query("AGG-15", f"with {USAGE}, {DIM} select dim.hospital_id, coalesce(sum(cost_usd), 0)::decimal(18,6) as cost_usd, count(event_id) as n_calls, max(ts) as last_used from dim left join usage using (hospital_id) group by all")
def by_hospital(spark, sf):
    return B.usage_by(usage(spark, sf), _dim(spark), "hospital_id")


@query("AGG-16", f"with {USAGE} select coalesce(feature, '(기타)') as feature, provider, sum(cost_usd)::decimal(18,6) as cost_usd, count(*) as n_calls from usage group by all")
def by_feature(spark, sf):
    return usage(spark, sf).groupBy("feature", "provider").agg(F.sum("cost_usd").cast(USD).alias("cost_usd"), F.count("*").alias("n_calls")).withColumn("feature", F.coalesce("feature", F.lit("(기타)")))


@query("AGG-17", f"with {USAGE} select sum(cost_usd)::decimal(18,6) as cost_usd, count(*) as n_calls from usage where hospital_id is null")
def unattributed(spark, sf):
    return usage(spark, sf).where("hospital_id is null").agg(F.sum("cost_usd").cast(USD).alias("cost_usd"), F.count("*").alias("n_calls"))


@query("AGG-18", f"with {USAGE} select coalesce(feature, 'none') as feature, list_sort(list(distinct provider)) as providers, sum(cost_usd)::decimal(18,6) as cost_usd, count(*) as n_calls from usage group by all")
def providers(spark, sf):
    return usage(spark, sf).groupBy(F.coalesce("feature", F.lit("none")).alias("feature")).agg(F.array_sort(F.collect_set("provider")).alias("providers"), F.sum("cost_usd").cast(USD).alias("cost_usd"), F.count("*").alias("n_calls"))


@query("AGG-19", f"with {USAGE} select run_id, bool_or(coalesce(feature like 'blog%', false)) as is_blog, bool_or(coalesce(feature = 'health_report', false)) as is_report from usage group by all")
def run_products(spark, sf):
    has = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    return usage(spark, sf).groupBy("run_id").agg(has(F.col("feature").like("blog%")).alias("is_blog"), has(F.col("feature") == "health_report").alias("is_report"))


@query("AGG-20", f"""with {USAGE}, rp as (select run_id, bool_or(coalesce(feature like 'blog%', false)) as is_blog from usage group by all)
  select hospital_id, ts::date as day, coalesce(case when feature like '%alimtalk%' then 'alimtalk' when feature = 'health_report' then 'report' end, case when is_blog then 'blog' end, 'other') as product, sum(k)::bigint as n
  from usage join rp using (run_id) group by all having sum(k) <> 0""")  # fmt: skip
def daily_products(spark, sf):
    rows = usage(spark, sf)
    runs = rows.groupBy("run_id").agg(F.bool_or(F.coalesce(F.col("feature").like("blog%"), F.lit(False))).alias("is_blog"))
    own = F.when(F.col("feature").like("%alimtalk%"), "alimtalk").when(F.col("feature") == "health_report", "report")
    named = F.coalesce(own, F.when(F.col("is_blog"), "blog"), F.lit("other"))
    return rows.join(runs, "run_id").groupBy("hospital_id", F.to_date("ts").alias("day"), named.alias("product")).agg(F.sum("k").alias("n")).where("n <> 0")


@query("JN-11", f"with {USAGE} select operation_id, min(run_id) as run_id from usage group by all")
def operation_runs(spark, sf):
    return usage(spark, sf).groupBy("operation_id").agg(F.min("run_id").alias("run_id"))


@query("JN-12", f"with {USAGE}, runs as (select distinct operation_id, run_id from usage), ops as (select operation_id, sum(cost_usd)::decimal(18,6) as cost_usd from usage group by all) select run_id, sum(cost_usd)::decimal(18,6) as cost_usd from ops join runs using (operation_id) group by all")
def run_costs(spark, sf):
    rows = usage(spark, sf)
    ops = rows.groupBy("operation_id").agg(F.sum("cost_usd").cast(USD).alias("cost_usd"))
    return ops.join(rows.select("operation_id", "run_id").distinct(), "operation_id").groupBy("run_id").agg(F.sum("cost_usd").cast(USD).alias("cost_usd"))


@query("JN-13", f"""with {USAGE}, {DIM}, a as (select hospital_id, count(distinct run_id) as n_blog from usage where feature = 'blog-write' group by all), b as (select hospital_id, count(distinct run_id) as n_report, max(ts) as last_report from usage where feature = 'health_report' group by all),
  c as (select hospital_id, sum(k)::bigint as tokens, max(ts) as last_use from usage group by all)
  select dim.hospital_id, coalesce(n_blog, 0) as n_blog, coalesce(n_report, 0) as n_report, coalesce(tokens, 0) as tokens, greatest(last_report, last_use) as last_active from dim left join a using (hospital_id) left join b using (hospital_id) left join c using (hospital_id)""")  # fmt: skip
def feature_usage(spark, sf):
    """One conditional aggregate in place of a star of them: a single exchange of the usage."""
    runs = lambda f: F.countDistinct(F.when(F.col("feature") == f, F.col("run_id")))
    made = usage(spark, sf).groupBy("hospital_id").agg(runs("blog-write").alias("n_blog"), runs("health_report").alias("n_report"), F.sum("k").alias("tokens"), F.max(F.when(F.col("feature") == "health_report", F.col("ts"))).alias("r_"), F.max("ts").alias("u_"))
    return _dim(spark).join(made, "hospital_id", "left").select("hospital_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_blog", "n_report", "tokens")), F.greatest("r_", "u_").alias("last_active"))


@query("AGG-25", f"with {USAGE} select hospital_id, max(ts) filter (where event_type = 'view') as last_view, max(ts) filter (where event_type = 'click') as last_click, max(ts) filter (where event_type = 'error') as last_error from usage group by all")
def last_success(spark, sf):
    at = lambda t: F.max(F.when(F.col("event_type") == t, F.col("ts")))
    return usage(spark, sf).groupBy("hospital_id").agg(at("view").alias("last_view"), at("click").alias("last_click"), at("error").alias("last_error"))


@query("AGG-26", "select user_id, max(ts) as last_seen from events group by all having max(ts) < timestamp '2024-01-20'")
def stale(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen")).where("last_seen < timestamp_ntz'2024-01-20 00:00:00'")


@query("AGG-26-features", "select user_id, event_type, hour(ts)::int as hour, max(ts) as last_seen from events group by all having max(ts) < timestamp '2024-01-20'")
def stale_features(spark, sf):
    """What a user has not done at an hour of the day for long; at every size there are some such and some others."""
    return table(spark, sf, "events").groupBy("user_id", "event_type", F.hour("ts").alias("hour")).agg(F.max("ts").alias("last_seen")).where("last_seen < timestamp_ntz'2024-01-20 00:00:00'")


@query("AGG-27", "select p_type as name, count(*) as n from part group by all order by n desc, name limit 3")
def frequent(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(3)


@query("AGG-28", "select count(*) filter (where o_orderstatus = 'O') as pending, count(*) filter (where o_orderstatus = 'F') as done, count(*) filter (where o_orderstatus = 'P' and o_totalprice > 50000) as large from orders")
def pending(spark, sf):
    n = F.count_if
    return table(spark, sf, "orders").agg(n(F.col("o_orderstatus") == "O").alias("pending"), n(F.col("o_orderstatus") == "F").alias("done"), n((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 50000)).alias("large"))


@query("AGG-49", f"""with {USAGE}, days as (select distinct hospital_id, ts::date as day from usage where hospital_id is not null), spine as (select hospital_id, unnest(generate_series(date '2024-01-01', date '2024-02-15', interval 1 day))::date as day from (select distinct hospital_id from days))
  select hospital_id, count(d.day) as n_days, min(s.day) filter (where d.day is null) as first_missing, max(d.day) as last_collected from spine s left join days d using (hospital_id, day) group by all""".replace("d using (hospital_id, day)", "d on d.hospital_id = s.hospital_id and d.day = s.day").replace("select hospital_id, count(d.day)", "select s.hospital_id, count(d.day)"))  # fmt: skip
def coverage(spark, sf):
    days = usage(spark, sf).where("hospital_id is not null").select("hospital_id", F.to_date("ts").alias("day"), F.lit(True).alias("there")).distinct()
    spine = days.select("hospital_id").distinct().withColumn("day", F.explode(F.expr("sequence(date'2024-01-01', date'2024-02-15')")))
    got = F.col("there").isNotNull()
    return spine.join(days, ["hospital_id", "day"], "left").groupBy("hospital_id").agg(F.count_if(got).alias("n_days"), F.min(F.when(~got, F.col("day"))).alias("first_missing"), F.max(F.when(got, F.col("day"))).alias("last_collected"))


@query("AGG-54", f"""with {USAGE}, g as (select case when feature is not null then 'run ' || run_id when provider = 'a' then coalesce(feature, 'none') || '|' || strftime(ts, '%Y-%m-%d') else 'row ' || event_id end as key, * from usage)
  select key, count(*) as n_steps, sum(cost_usd)::decimal(18,6) as cost_usd, max(ts) as newest from g group by all""")  # fmt: skip
def grouped_ledger(spark, sf):
    key = F.when(F.col("feature").isNotNull(), F.concat(F.lit("run "), "run_id")).when(F.col("provider") == "a", F.concat(F.coalesce("feature", F.lit("none")), F.lit("|"), F.date_format("ts", "yyyy-MM-dd"))).otherwise(F.concat(F.lit("row "), "event_id"))
    return usage(spark, sf).groupBy(key.alias("key")).agg(F.count("*").alias("n_steps"), F.sum("cost_usd").cast(USD).alias("cost_usd"), F.max("ts").alias("newest"))


@query("AGG-56", """with s as (select l_orderkey, list_sort(list(distinct l_returnflag)) as kinds from lineitem group by all)
  select l_orderkey, kinds, case when list_contains(kinds, 'R') then 'saved' when list_contains(kinds, 'A') then 'drafted' when list_contains(kinds, 'N') then 'requested' else 'none' end as stage from s""")  # fmt: skip
def stages(spark, sf):
    sets = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("kinds"))
    has = lambda k: F.array_contains("kinds", k)
    return sets.withColumn("stage", F.when(has("R"), "saved").when(has("A"), "drafted").when(has("N"), "requested").otherwise("none"))


@query("SRT-03", f"with {USAGE}, t as (select * from usage order by ts desc, event_id limit 200), n as (select run_id, count(*) as n_calls from usage group by all) select event_id, t.run_id, n_calls from t left join n using (run_id)")
def limited_first(spark, sf):
    rows = usage(spark, sf)
    top = rows.orderBy(F.desc("ts"), "event_id").limit(200).select("event_id", "run_id")
    return top.join(rows.join(F.broadcast(top.select("run_id").distinct()), "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("n_calls")), "run_id", "left")


@query("SRT-06", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def paged(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query("SET-02", "select 'word' || (o_custkey % 40) as keyword from orders union select 'word' || (c_custkey % 70) from customer")
def united(spark, sf):
    word = lambda t, c, n: table(spark, sf, t).select(F.concat(F.lit("word"), F.col(c) % n).alias("keyword"))
    return word("orders", "o_custkey", 40).union(word("customer", "c_custkey", 70)).distinct()


@query("SET-06", "select * from ((select 'order' as kind, o_orderkey as id, o_orderdate as moment from orders order by o_orderdate desc, o_orderkey limit 40) union all (select 'event', event_id, ts from events order by ts desc, event_id limit 40)) order by moment desc, kind, id limit 60")
def history(spark, sf):
    a = table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("moment")).orderBy(F.desc("moment"), "id").limit(40)
    b = table(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("moment")).orderBy(F.desc("moment"), "id").limit(40)
    return a.union(b).orderBy(F.desc("moment"), "kind", "id").limit(60)


@query("AGG-48", """select event_type as fingerprint, count(*) as n, max(ts) as newest from events where ts > timestamp '2024-01-15 00:00:00' and ts <= timestamp '2024-01-15 06:00:00' group by all order by n desc, fingerprint limit 8""")
def error_digest(spark, sf):
    rows = table(spark, sf, "events").where("ts > timestamp_ntz'2024-01-15 00:00:00' and ts <= timestamp_ntz'2024-01-15 06:00:00'")
    return rows.groupBy(F.col("event_type").alias("fingerprint")).agg(F.count("*").alias("n"), F.max("ts").alias("newest")).orderBy(F.desc("n"), "fingerprint").limit(8)


@query("STM-03", """with w as (select event_type, unnest([time_bucket(interval 5 minutes, ts), time_bucket(interval 5 minutes, ts) - interval 5 minutes]) as start, ts from events where event_type = 'error')
  select event_type as fingerprint, start::timestamp as window_start, count(*) as n from w where ts < start + interval 6 minutes group by all""")  # fmt: skip
def alert_windows(spark, sf):
    """The operator of the stream, on a bounded table."""
    return alerts.error_windows(table(spark, sf, "events").where("event_type = 'error'").select(F.col("event_type").alias("fingerprint"), F.col("ts").cast("timestamp").alias("occurred_at"))).select("fingerprint", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("STM-01", "select user_id, max(ts)::date + 1 as start, date '2024-03-01' as stop from events group by all having max(ts)::date + 1 <= date '2024-03-01'")
def next_ranges(spark, sf):
    from tidewell.functions.dates import next_range

    newest = table(spark, sf, "events").groupBy("user_id").agg(F.to_date(F.max("ts")).alias("newest"))
    made = newest.select("user_id", next_range(F.col("newest"), F.lit("2024-03-01").cast("date"), 30).alias("r")).where("r is not null")
    return made.select("user_id", "r.start", F.col("r.end").alias("stop"))


@query("SRT-08", f"with {RANKS} select section, metric_date, keyword, rank_value, row_number() over (partition by section, metric_date order by rank_value, keyword)::int as place from (select section, metric_date, keyword, min(rank_value) as rank_value from ranks where rank_value is not null group by all)")
def ranked_parts(spark, sf):
    rows = ranks(spark, sf).where("rank_value is not null").groupBy("section", "metric_date", "keyword").agg(F.min("rank_value").alias("rank_value"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("section", "metric_date").orderBy("rank_value", "keyword")))
