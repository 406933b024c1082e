"""Queries on keyword ranks and reviews."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import ledger as L
from tidewell.operators import ranks as R
from tidewell.operators import reviews as V
from tidewell.plans.fixtures import RANKS, REVIEWS, ranks, reviews, table
from tidewell.plans.registry import query

SECTIONS = ["blog", "view", "total", "place"]
BEST = "best as (select hospital_id, keyword, metric_date, min(rank_value) as rank_value from ranks group by all)"
DAYS = "days as (select distinct hospital_id, metric_date from ranks)"
BASE = f"""offsets as (select unnest([{", ".join(map(str, R.OFFSETS))}]) as o, unnest(range({len(R.OFFSETS)})) as p),
  bases as (select d.hospital_id, d.metric_date, (select e.metric_date from days e, offsets where e.hospital_id = d.hospital_id and e.metric_date = d.metric_date - o order by p limit 1) as baseline from days d)"""


@query("AGG-02", f"with {RANKS} select hospital_id, keyword, metric_date, {', '.join(f'''min(rank_value) filter (where section = '{s}') as rank_{s}''' for s in SECTIONS)}, min(rank_value) as rank_best from ranks group by all")
def wide(spark, sf):
    return R.wide(ranks(spark, sf), ["hospital_id", "keyword", "metric_date"], SECTIONS)


@query("AGG-01", """select user_id, ts::date as metric_date, max(value) filter (where event_type = 'view') as views, max(value) filter (where event_type = 'click') as clicks from events group by all""")
def eav(spark, sf):
    at = lambda t: F.max(F.when(F.col("event_type") == t, F.col("value")))
    return table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("metric_date")).agg(at("view").alias("views"), at("click").alias("clicks"))


@query("JN-19", f"with {RANKS}, {DAYS}, {BASE} select * from bases")
def baselines(spark, sf):
    return R.baseline_dates(ranks(spark, sf).select("hospital_id", "metric_date").distinct())


@query("JN-17", f"""with {RANKS}, {BEST}, {DAYS}, {BASE}, newest as (select hospital_id, max(metric_date) as metric_date from days group by all)
  select b.hospital_id, b.keyword, b.metric_date, s.baseline, b.rank_value as current, p.rank_value as previous, coalesce(sign(p.rank_value - b.rank_value), 0)::int as trend
  from best b join newest using (hospital_id, metric_date) join bases s using (hospital_id, metric_date) left join best p on p.hospital_id = b.hospital_id and p.keyword = b.keyword and p.metric_date = s.baseline""")  # fmt: skip
def against_baseline(spark, sf):
    return R.against_baseline(ranks(spark, sf))


@query("JN-20", f"with {RANKS}, {DAYS} select d.hospital_id, d.metric_date, (select max(e.metric_date) from days e where e.hospital_id = d.hospital_id and e.metric_date <= d.metric_date - 30) as baseline from days d")
def as_of(spark, sf):
    return R.as_of(ranks(spark, sf).select("hospital_id", "metric_date").distinct(), 30)


@query("JN-18", """with v as (select event_id, user_id, ts from events where event_type = 'view'), c as (select event_id as chart_id, user_id, ts as chart_ts from events where event_type = 'click'),
  p as (select v.event_id, chart_id, row_number() over (partition by v.event_id order by abs(epoch_us(ts) - epoch_us(chart_ts)), chart_ts, chart_id) as n from v join c using (user_id) where abs(epoch_us(ts) - epoch_us(chart_ts)) <= 86400000000)
  select v.event_id, v.user_id, p.chart_id as nearest_chart_id from v left join p on p.event_id = v.event_id and n = 1""")  # fmt: skip
def nearest(spark, sf):
    events = table(spark, sf, "events")
    charts = events.where("event_type = 'click'").select(F.col("event_id").alias("chart_id"), "user_id", F.col("ts").alias("chart_ts"))
    return R.nearest(events.where("event_type = 'view'").select("event_id", "user_id", "ts"), charts, "user_id", "ts", "chart_ts", "chart_id", 86400).drop("ts")


@query("WIN-11", f"""with {RANKS}, {BEST}, l as (select *, lag(rank_value) over (partition by hospital_id, keyword order by metric_date) as previous from best)
  select *, case when previous is null then null when rank_value is null then 999 else rank_value - previous end as drop from l""")  # fmt: skip
def drops(spark, sf):
    return R.drops(ranks(spark, sf))


@query("JN-24", f"with {RANKS} select hospital_id, keyword, metric_date, {', '.join(f'min(rank_value) filter (where slot = {s}) as ' + ('own' if not s else f'c{s}') for s in range(4))} from ranks group by all")
def by_slot(spark, sf):
    return R.by_slot(ranks(spark, sf), [0, 1, 2, 3])


@query("WIN-06", f"""with {RANKS} select section, slot, keyword, metric_date, rank_value from (select *, row_number() over (partition by section, slot, keyword order by metric_date desc, rank_value nulls last) as n from ranks) where n = 1""")
def newest(spark, sf):
    rows = L.newest_rows(ranks(spark, sf), ["section", "slot", "keyword"], F.desc("metric_date"), F.col("rank_value").asc_nulls_last())
    return rows.select("section", "slot", "keyword", "metric_date", "rank_value")


@query("WIN-07", f"with {RANKS} select hospital_id, keyword, section, rank_value from ranks r where metric_date = (select max(metric_date) from ranks m where m.hospital_id = r.hospital_id)")
def latest_snapshot(spark, sf):
    rows = ranks(spark, sf)
    last = rows.groupBy("hospital_id").agg(F.max("metric_date").alias("metric_date"))
    return rows.join(last, ["hospital_id", "metric_date"], "left_semi").select("hospital_id", "keyword", "section", "rank_value")


@query("WIN-08", f"""with {RANKS} select hospital_id, keyword, section, metric_date, last_value(r ignore nulls) over (partition by hospital_id, keyword, section order by metric_date rows between unbounded preceding and current row) as latest_rank
  from (select hospital_id, keyword, section, metric_date, min(rank_value) as r from ranks group by all)""")  # fmt: skip
def last_known(spark, sf):
    rows = ranks(spark, sf).groupBy("hospital_id", "keyword", "section", "metric_date").agg(F.min("rank_value").alias("r"))
    order = Window.partitionBy("hospital_id", "keyword", "section").orderBy("metric_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("latest_rank", F.last("r", ignorenulls=True).over(order)).drop("r")


@query("SRT-01", f"""with {RANKS}, k as (select hospital_id, keyword, max(importance) as importance, min(rank_value) as rank_value from ranks where metric_date >= date '1998-01-01' group by all)
  select *, row_number() over (partition by hospital_id order by case importance when 'high' then 0 when 'low' then 2 else 1 end, rank_value nulls last, keyword)::int as place from k""")  # fmt: skip
def by_importance(spark, sf):
    rows = ranks(spark, sf).where("metric_date >= date'1998-01-01'").groupBy("hospital_id", "keyword").agg(F.max("importance").alias("importance"), F.min("rank_value").alias("rank_value"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("hospital_id").orderBy(*R.importance_order())))


@query("AGG-46", f"""with {RANKS} select keyword, max(metric_date) as metric_date, min(rank_value) filter (where metric_date = m) as rank_value from (select *, max(metric_date) over (partition by keyword) as m from ranks
  where rank_value is not null and metric_date > date '2001-01-01' - 45 and metric_date <= date '2001-01-01') group by keyword""")  # fmt: skip
def best_of_latest(spark, sf):
    as_of = F.lit(date(2001, 1, 1))
    rows = ranks(spark, sf).where(F.col("rank_value").isNotNull() & (F.col("metric_date") > F.date_sub(as_of, 45)) & (F.col("metric_date") <= as_of))
    best = rows.groupBy("keyword").agg(F.max(F.struct("metric_date", (-F.col("rank_value")).alias("r"))).alias("b"))
    return best.select("keyword", "b.metric_date", (-F.col("b.r")).alias("rank_value"))


@query("FLT-15", f"""with {RANKS}, {BEST}, l as (select *, lag(rank_value) over (partition by hospital_id, keyword order by metric_date) as previous from best)
  select hospital_id, keyword, metric_date, case when previous <= 10 and (rank_value > 10 or rank_value is null) then 'fell_off' when rank_value between 11 and 15 then 'near' when previous is null and rank_value <= 10 then 'entered' else 'other' end as preset from l""")  # fmt: skip
def presets(spark, sf):
    now, was = F.col("rank_value"), F.col("previous")
    preset = F.when((was <= 10) & ((now > 10) | now.isNull()), "fell_off").when(now.between(11, 15), "near").when(was.isNull() & (now <= 10), "entered").otherwise("other")
    return R.drops(ranks(spark, sf)).select("hospital_id", "keyword", "metric_date", preset.alias("preset"))


@query("AGG-40", f"""with {REVIEWS}, months as (select hospital_id, unnest(generate_series(date '2024-03-01', date '2025-02-01', interval 1 month))::date as month from (select distinct hospital_id from reviews)),
  n as (select hospital_id, date_trunc('month', visit_date)::date as month, count(*) as n from reviews where slot is null group by all) select hospital_id, month, coalesce(n, 0) as n_reviews from months left join n using (hospital_id, month)""")  # fmt: skip
def review_months(spark, sf):
    return V.monthly(reviews(spark, sf), date(2025, 2, 10), 12)


@query("AGG-53", f"""with {REVIEWS}, c as (select hospital_id, {', '.join(f"count(*) filter (where sentiment = '{s}') as n_{s}" for s in V.SENTIMENTS)} from reviews
  where slot is null and visit_date >= date '2024-08-01' group by all)
  select *, case when n_strong_positive + n_positive + n_negative + n_strong_negative > 0 then (n_strong_positive + n_positive)::double * 100.0::double / (n_strong_positive + n_positive + n_negative + n_strong_negative)::double end as positive_pct from c""")  # fmt: skip
def sentiments(spark, sf):
    return V.sentiment_counts(reviews(spark, sf).where("visit_date >= date'2024-08-01'"))


@query("AGG-41", f"with {REVIEWS} select hospital_id, date_trunc('month', visit_date)::date as month, {', '.join(f'count(*) filter (where coalesce(slot, 0) = {s}) as ' + ('own' if not s else f'c{s}') for s in range(4))} from reviews where visit_date is not null group by all")
def against_competitors(spark, sf):
    return V.against_competitors(reviews(spark, sf), [1, 2, 3])
