"""Queries on the sales ledger."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidewell.functions import dates, numbers, text
from tidewell.operators import ledger as L
from tidewell.operators import joins, periods
from tidewell.operators.storage import written
from tidewell.plans.fixtures import LEDGER, ledger, table
from tidewell.plans.registry import query

ZERO = """
zero as (select hospital_id, service_date, customer, lower(trim(receipt)) as receipt_key, count(*) as n_lines from ledger
  where chart_type = 'intovet' and trim(receipt) <> '' group by all having sum(amount) = 0),
net as (select l.* from ledger l where not exists (select 1 from zero z where l.chart_type = 'intovet' and z.hospital_id = l.hospital_id
  and z.service_date = l.service_date and z.customer = l.customer and z.receipt_key = lower(trim(l.receipt))))"""
KNOWN = "customer <> '(고객명 미상)' and patient <> '(환자명 미상)'"
DAILY = f"""
daily as (select hospital_id, chart_type, service_date, sum(amount)::decimal(18,2) as sales_amount, count(distinct case when {KNOWN} then
    case when chart_type = 'intovet' and trim(receipt) <> '' then customer || '|receipt|' || lower(trim(receipt))
      when chart_type = 'efriends' then customer || '|visit' else customer || '|' || patient end end) as visit_count
  from net group by all)"""
MASTER = f"master as (select hospital_id, chart_type, customer, max(nullif(receipt, '')) as latest_no, min(service_date) as first_visit_date, max(service_date) as last_seen_date from ledger where {KNOWN} group by all)"
MONTHS = "months as (select hospital_id, date_trunc('month', service_date)::date as month, sum(amount)::decimal(18,2) as value from ledger group by all)"


def _months(spark, sf):
    return ledger(spark, sf).groupBy("hospital_id", dates.bucket(F.col("service_date"), "month").alias("month")).agg(F.sum("amount").cast(L.MONEY).alias("value"))


@query("AGG-06", f"with {LEDGER}, {ZERO} select * from zero")
def net_zero(spark, sf):
    return L.net_zero_receipts(ledger(spark, sf))


@query("JN-05", f"with {LEDGER}, {ZERO} select * from net")
def without_net_zero(spark, sf):
    return L.without_net_zero(ledger(spark, sf))


@query("AGG-07", f"""with {LEDGER} select hospital_id, service_date, customer, lower(trim(receipt)) as receipt_key, min(patient) as patient, count(*) as n_lines, sum(amount)::decimal(18,2) as amount
  from ledger where chart_type = 'intovet' group by hospital_id, service_date, customer, lower(trim(receipt)) having sum(ledger.amount) <> 0""")  # fmt: skip
def net_receipts(spark, sf):
    return L.net_receipts(ledger(spark, sf))


@query("AGG-08", f"with {LEDGER}, {ZERO}, {DAILY} select * from daily")
def daily_kpis(spark, sf):
    return L.daily_kpis(ledger(spark, sf))


@query("AGG-09", f"""with {LEDGER}, {ZERO}, firsts as (select hospital_id, chart_type, customer, min(service_date) as service_date from net where {KNOWN} group by all)
  select hospital_id, chart_type, service_date, count(*) as new_customer_count from firsts group by all""")  # fmt: skip
def new_customers(spark, sf):
    return L.new_customers(ledger(spark, sf))


@query("AGG-10", f"with {LEDGER}, {MASTER} select * from master")
def customer_master(spark, sf):
    return L.customer_master(ledger(spark, sf))


@query("AGG-11", f"with {LEDGER} select hospital_id, chart_type, customer, patient, min(service_date) as first_seen_date, max(service_date) as last_seen_date from ledger where {KNOWN} group by all")
def customer_patients(spark, sf):
    return L.customer_patients(ledger(spark, sf))


@query("AGG-12", f"""with {LEDGER}, {ZERO}, {DAILY}, {MASTER}, nc as (select hospital_id, chart_type, first_visit_date as service_date, count(*) as n from master group by all)
  select daily.*, coalesce(n, 0) as new_customer_count from daily left join nc using (hospital_id, chart_type, service_date)""")  # fmt: skip
def recounted(spark, sf):
    rows = ledger(spark, sf)
    return L.recounted(L.daily_kpis(rows), L.customer_master(rows))


@query("AGG-13", f"with {LEDGER}, {ZERO}, {DAILY} select * from daily where service_date >= date '1997-03-01' and service_date < date '1997-04-01'")
def month_kpis(spark, sf):
    """Receipts net over one day, so a month's lines are enough."""
    month = F.lit("1997-03-01").cast("date")
    return L.daily_kpis(ledger(spark, sf).where((F.col("service_date") >= month) & (F.col("service_date") < F.add_months(month, 1))))


@query("AGG-14", f"""with {LEDGER} select chart_type, count(*) as n_rows, min(service_date) as first_date, max(service_date) as last_date, count(distinct service_date) as n_dates,
  count(distinct customer || '|' || patient) as n_visits, sum(amount)::decimal(18,2) as total from ledger group by all""")  # fmt: skip
def preview(spark, sf):
    return ledger(spark, sf).groupBy("chart_type").agg(
        F.count("*").alias("n_rows"), F.min("service_date").alias("first_date"), F.max("service_date").alias("last_date"), F.countDistinct("service_date").alias("n_dates"),
        F.countDistinct(F.concat_ws("|", "customer", "patient")).alias("n_visits"), F.sum("amount").cast(L.MONEY).alias("total"),
    )


@query("AGG-04", f"""with {LEDGER}, p as (select unnest(['year', 'month', 'week', 'day']) as period_type)
  select hospital_id, period_type, (case period_type when 'year' then date_trunc('year', service_date) when 'month' then date_trunc('month', service_date)
    when 'week' then date_trunc('week', service_date) else service_date end)::date as period_start, sum(amount)::decimal(18,2) as amount from ledger, p group by all""")  # fmt: skip
def rollup(spark, sf):
    return periods.rollup(ledger(spark, sf), "service_date", ["hospital_id"], ["amount"])


@query("JN-21", f"""with {LEDGER}, {MONTHS}, ends as (select hospital_id, min(service_date) as a, max(service_date) as z from ledger group by all),
  spine as (select hospital_id, unnest(generate_series(a, z, interval 1 day))::date as service_date from ends),
  sums as (select hospital_id, service_date, sum(amount)::decimal(18,2) as amount from ledger group by all)
  select * from spine left join sums using (hospital_id, service_date)""")  # fmt: skip
def gap_filled(spark, sf):
    sums = ledger(spark, sf).groupBy("hospital_id", "service_date").agg(F.sum("amount").cast(L.MONEY).alias("amount"))
    return periods.filled(sums, "service_date", ["hospital_id"], ["amount"])


DAYS = "days as (select hospital_id, service_date, sum(amount)::decimal(18,2) as amount from ledger group by all)"


def _days(spark, sf):
    return ledger(spark, sf).groupBy("hospital_id", "service_date").agg(F.sum("amount").cast(L.MONEY).alias("amount"))


@query("WIN-12", f"""with {LEDGER}, {DAYS}, last as (select hospital_id, date_trunc('month', max(service_date)) as m from days group by all),
  spine as (select hospital_id, (m - to_months(k::int))::date as month from last, range(1, 13) as r(k)),
  sums as (select hospital_id, date_trunc('month', service_date)::date as month, sum(amount)::decimal(18,2) as v from days group by all)
  select s.hospital_id, s.month, a.v as recent, b.v as previous from spine s left join sums a on a.hospital_id = s.hospital_id and a.month = s.month
  left join sums b on b.hospital_id = s.hospital_id and b.month = (s.month - interval 12 month)::date""")  # fmt: skip
def year_over_year(spark, sf):
    return periods.year_over_year(_days(spark, sf), "service_date", ["hospital_id"], "amount")


@query("WIN-13", f"""with {LEDGER}, {DAYS}, last as (select hospital_id, max(service_date) as z from days group by all), slots as (select hospital_id, z, k::int as slot from last, range(0, 7) as r(k))
  select s.hospital_id, slot, coalesce(a.amount, 0)::decimal(18,2) as current, coalesce(b.amount, 0)::decimal(18,2) as previous from slots s
  left join days a on a.hospital_id = s.hospital_id and a.service_date = z - slot left join days b on b.hospital_id = s.hospital_id and b.service_date = z - slot - 7""")  # fmt: skip
def week_over_week(spark, sf):
    return periods.week_over_week(ledger(spark, sf), "service_date", ["hospital_id"], "amount")


@query("AGG-42", f"""with {LEDGER}, {DAYS}, last as (select hospital_id, max(service_date) as z from days group by all),
  seven as (select hospital_id, z, z - k::int as recent_day, isodow(z - k::int)::int - 1 as weekday from last, range(0, 7) as r(k)),
  means as (select d.hospital_id, isodow(service_date)::int - 1 as weekday, avg(amount::double) as average from days d join last using (hospital_id)
    where service_date >= date_trunc('month', z) - interval 11 month group by all)
  select s.hospital_id, s.weekday, average, d.amount as last_value, recent_day from seven s left join means m on m.hospital_id = s.hospital_id and m.weekday = s.weekday
  left join days d on d.hospital_id = s.hospital_id and d.service_date = recent_day""")  # fmt: skip
def weekday_profile(spark, sf):
    return periods.weekday_profile(_days(spark, sf), "service_date", ["hospital_id"], "amount")


@query("AGG-51", f"""with {LEDGER}, {MONTHS}, done as (select * from months where month < date '2000-07-01'), last as (select hospital_id, max(month) as z from done group by all)
  select l.hospital_id, z as month, a.value as current, case when b.value > 0 then (a.value - b.value)::double * 100 / b.value::double end as mom_pct,
    case when c.value > 0 then (a.value - c.value)::double * 100 / c.value::double end as yoy_pct,
    (select sum(value) from done d where d.hospital_id = l.hospital_id and year(d.month) = year(z))::decimal(18,2) as year_to_date
  from last l join done a on a.hospital_id = l.hospital_id and a.month = z left join done b on b.hospital_id = l.hospital_id and b.month = (z - interval 1 month)::date
  left join done c on c.hospital_id = l.hospital_id and c.month = (z - interval 12 month)::date""")  # fmt: skip
def header(spark, sf):
    return periods.kpi_header(_months(spark, sf), "month", ["hospital_id"], "value", F.lit(date(2000, 7, 15)))


@query("AGG-52", f"""with {LEDGER}, {DAYS}, sums as (select hospital_id, date_trunc('month', service_date)::date as month, sum(amount) as v from days group by all),
  m as (select hospital_id, sum(v)::decimal(18,2) as total, avg(v::double) as month_average from sums where month between date '1998-01-01' and date '1999-12-31' group by all),
  d as (select hospital_id, avg(amount::double) as day_average from days where service_date between date '1998-01-01' and date '1999-12-31' and amount > 0 group by all)
  select hospital_id, total, month_average, day_average, month_average / 3 as vet_average from m full join d using (hospital_id)""")  # fmt: skip
def period_kpis(spark, sf):
    return periods.period_kpis(_days(spark, sf), "service_date", ["hospital_id"], "amount", F.lit(date(1998, 1, 1)), F.lit(date(1999, 12, 31)), 3)


@query("AGG-44", f"""with {LEDGER}, {DAYS}, b as (select hospital_id, max(service_date) as newest, coalesce(sum(amount) filter (where date '1998-09-01' - service_date between 1 and 28), 0)::decimal(18,2) as amount_now,
    coalesce(sum(amount) filter (where date '1998-09-01' - service_date between 29 and 56), 0)::decimal(18,2) as amount_before from days where service_date < date '1998-09-01' group by all)
  select hospital_id, amount_now, amount_before, case when amount_before > 0 then (amount_now - amount_before)::double * 100 / amount_before::double end as amount_change,
    (date '1998-09-01' - newest)::int as age_days, date '1998-09-01' - newest > 3 as is_stale from b""")  # fmt: skip
def change_board(spark, sf):
    return periods.change_board(_days(spark, sf), "service_date", ["hospital_id"], ["amount"], F.lit(date(1998, 9, 1)))


@query("AGG-43", f"with {LEDGER}, {DAYS} select hospital_id, min(service_date) as first, max(service_date) as last from days group by all")
def bounds(spark, sf):
    return _days(spark, sf).groupBy("hospital_id").agg(F.min("service_date").alias("first"), F.max("service_date").alias("last"))


@query("AGG-05", f"with {LEDGER} select hospital_id, 'year' as period_type, date_trunc('year', service_date)::date as period_start, sum(amount)::decimal(18,2) as amount from ledger group by all")
def yearly(spark, sf):
    return periods.rollup(ledger(spark, sf), "service_date", ["hospital_id"], ["amount"], ("year",))


@query("WIN-02", f"""with {LEDGER} select * from (select *, row_number() over (partition by hospital_id, customer, patient order by service_date desc, run_id desc, line_no desc, amount desc, chart_type, receipt) as n from ledger)
  where n = 1""".replace("select * from (select *,", "select * exclude (n) from (select *,"))  # fmt: skip
def keep_latest(spark, sf):
    order = [F.col(c).desc_nulls_last() for c in ("service_date", "run_id", "line_no", "amount")]
    return L.newest_rows(ledger(spark, sf), ["hospital_id", "customer", "patient"], *order, F.col("chart_type"), F.col("receipt"))


@query("SNK-01", """with old as (select o_orderkey as k, o_totalprice as v from orders where o_orderkey % 3 <> 0), new as (select o_orderkey as k, o_totalprice + 1 as v from orders where o_orderkey % 2 = 0)
  select * from new union all select * from old where k not in (select k from new)""")  # fmt: skip
def upsert(spark, sf):
    orders = table(spark, sf, "orders")
    old = orders.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey as k", "o_totalprice as v")
    new = orders.where("o_orderkey % 2 = 0").selectExpr("o_orderkey as k", "o_totalprice + 1 as v")
    return L.upserted(old, new, ["k"])


@query("SNK-02", """with old as (select o_orderkey as k, o_totalprice as v from orders where o_orderkey % 3 <> 0), new as (select o_orderkey as k, o_totalprice + 1 as v from orders where o_orderkey % 2 = 0)
  select * from old union all select * from new where k not in (select k from old)""")  # fmt: skip
def insert(spark, sf):
    orders = table(spark, sf, "orders")
    old = orders.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey as k", "o_totalprice as v")
    new = orders.where("o_orderkey % 2 = 0").selectExpr("o_orderkey as k", "o_totalprice + 1 as v")
    return L.inserted(old, new, ["k"])


@query("SNK-03", f"""with {LEDGER}, a as (select * from ledger where service_date < date '1998-01-01'), b as (select * from ledger where service_date >= date '1998-01-01')
  select hospital_id, customer, min(service_date) as first_visit_date, max(service_date) as last_seen_date, coalesce((select max(receipt) from b where b.hospital_id = l.hospital_id and b.customer = l.customer),
    (select max(receipt) from a where a.hospital_id = l.hospital_id and a.customer = l.customer)) as latest_no from ledger l group by hospital_id, customer""")  # fmt: skip
def merge_master(spark, sf):
    rows, cut = ledger(spark, sf), F.lit("1998-01-01").cast("date")
    made = lambda part: part.groupBy("hospital_id", "customer").agg(F.min("service_date").alias("first_visit_date"), F.max("service_date").alias("last_seen_date"), F.max("receipt").alias("latest_no"))
    return L.merged_master(made(rows.where(F.col("service_date") < cut)), made(rows.where(F.col("service_date") >= cut)), ["hospital_id", "customer"], ["first_visit_date"], ["last_seen_date"], ["latest_no"])


@query("WIN-01", """with sets as (select o_custkey % 200 as o, o_custkey, list_sort(list(distinct 'p' || (l_partkey % 12))) as ps from orders join lineitem on l_orderkey = o_orderkey group by all),
  owners as (select distinct 'owner' || o as owner, ps as patients from sets where o_custkey % 2 = 0), ids as (select 'owner' || o as owner, 'c' || o_custkey as customer, ps from sets where o_custkey % 2 = 0 or o_custkey % 3 = 0),
  scored as (select owner, patients, customer, len(list_intersect(patients, ps))::double / len(list_distinct(list_concat(patients, ps))) as similarity from owners join ids using (owner))
  select * exclude (n) from (select *, row_number() over (partition by owner, patients order by similarity desc, customer) as n from scored where similarity >= 0.3) where n = 1""")  # fmt: skip
def identities(spark, sf):
    both = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    sets = both.groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey") % 12))).alias("patients"))
    sets = written(sets.withColumn("owner", F.concat(F.lit("owner"), F.col("o_custkey") % 200)))  # read as owners and as customers
    ids = sets.where("o_custkey % 2 = 0 or o_custkey % 3 = 0").select("owner", F.concat(F.lit("c"), F.col("o_custkey")).alias("customer"), "patients")
    return L.resolved_owners(sets.where("o_custkey % 2 = 0").select("owner", "patients").distinct(), ids)


@query("WIN-04", """select o_orderkey, k as numbered_key from (select o_orderkey, 'c' || o_custkey || case when n > 1 then '|#' || n else '' end as k from (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders))""")
def occurrence_suffix(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("key"))
    return L.numbered_keys(rows, "key", "o_orderkey").drop("key")


@query("WIN-03", """with r as (select o_orderkey, case when o_custkey % 4 = 0 then '' else 'c' || o_custkey end as key from orders)
  select key, max(o_orderkey) as o_orderkey from r where key <> '' group by key union all select key, o_orderkey from r where key = ''""")  # fmt: skip
def collapse(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("c"), "o_custkey")).alias("key"))
    return L.collapsed(rows, "key", "o_orderkey")


@query("JN-06", "select o_orderkey, o_custkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def run_exists(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem").where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("JN-08", """select o_orderkey from orders where not (exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag <> 'R'))""")
def hidden_runs(spark, sf):
    """One aggregate of flags a run in place of two joins."""
    flags = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") == "R").alias("only"))
    return table(spark, sf, "orders").join(flags.where("only"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("JN-09", """select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1""")
def latest_share(spark, sf):
    best = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("b"))
    return best.select("o_custkey", "b.o_orderkey", "b.o_orderdate")


@query("JN-01", "select c_custkey, c_name, n_name, r_name from customer left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey")
def with_names(spark, sf):
    dims = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return table(spark, sf, "customer").join(dims, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("c_custkey", "c_name", "n_name", "r_name")


@query("ARR-01", """select a.c_custkey, case when len(list_distinct(list_concat(x, y))) = 0 then 0.0::double else len(list_intersect(x, y))::double / len(list_distinct(list_concat(x, y))) end as similarity, list_sort(list_distinct(list_concat(x, y))) as merged
  from (select c_custkey, list_filter(['m' || (c_custkey % 3), 'm' || (c_custkey % 5), ''], lambda v: v <> '') as x, list_filter(['m' || (c_custkey % 4), 'm' || (c_custkey % 7)], lambda v: v <> '') as y from customer) a""")  # fmt: skip
def likeness(spark, sf):
    m = lambda n: F.concat(F.lit("m"), F.col("c_custkey") % n)
    x, y = F.array(m(3), m(5), F.lit("")), F.array(m(4), m(7))
    return table(spark, sf, "customer").select("c_custkey", numbers.jaccard(x, y).alias("similarity"), F.array_remove(numbers.merged_set(x, y), "").alias("merged"))


@query("JN-22", "select p_partkey, c_custkey from part join customer on lower(regexp_replace(p_name, '\\s+', '', 'g')) || (p_partkey % 50) = 'coldwidget' || (c_custkey % 50)")
def keyword_lookup(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.concat(text.keyword_key(F.col("p_name")), F.col("p_partkey") % 50).alias("key"))
    return joins.dealt_join(parts, table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("coldwidget"), F.col("c_custkey") % 50).alias("key")), ["key"]).drop("key")
