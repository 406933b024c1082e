"""Queries of plain filters, joins, aggregates, orders and set operations on the domain's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


from tidewell.functions.numbers import change_percent, merged_set
from tidewell.operators import billing, choices, ledger as L, periods, ranks as K, scans, similarity
from tidewell.operators.ads import level as grain
from tidewell.operators.storage import written
from tidewell.plans.fixtures import ADS, LEDGER, RANKS, REVIEWS, USAGE, ads, ledger, ranks, reviews, table, usage
from tidewell.plans.registry import query

MONEY = "decimal(18,2)"


@query("PRJ-01", "select o_orderkey as order_id, (o_totalprice::decimal(18,2) * 2)::decimal(18,2) as doubled, lower(o_orderstatus) as status from orders")
def projected(spark, sf):
    price = F.col("o_totalprice").cast(MONEY)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), (price * 2).cast(MONEY).alias("doubled"), F.lower("o_orderstatus").alias("status"))


@query("PRJ-02", f"with {USAGE} select event_id, coalesce(k, value)::decimal(18,2) as amount from usage")
def first_numbers(spark, sf):
    rows = usage(spark, sf)
    return rows.select("event_id", choices.first_number(rows, ["absent", "k", "value"]).alias("amount"))


@query("PRJ-03", "select o_orderkey, case when o_totalprice >= 300000 then 'large' when o_totalprice >= 100000 then 'middle' else 'small' end as size from orders")
def cased(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.when(price >= 300000, "large").when(price >= 100000, "middle").otherwise("small").alias("size"))


@query("FLT-01", "select o_orderkey from orders where o_orderstatus in ('F', 'P') and o_custkey >= 100 and o_orderpriority is not null and o_orderdate <> timestamp '1995-01-01'")
def filtered(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus in ('F', 'P') and o_custkey >= 100 and o_orderpriority is not null and o_orderdate <> timestamp_ntz'1995-01-01 00:00:00'").select("o_orderkey")


@query("FLT-02", f"with {LEDGER} select hospital_id, receipt, line_no, amount from ledger where service_date between date '1997-01-01' and date '1997-01-31'")
def between(spark, sf):
    return ledger(spark, sf).where(F.col("service_date").between("1997-01-01", "1997-01-31")).select("hospital_id", "receipt", "line_no", "amount")


@query("FLT-03", f"with {LEDGER} select receipt, line_no, amount from ledger where service_date >= date '1997-02-01' and service_date < date '1997-03-01'")
def one_month(spark, sf):
    first = F.lit("1997-02-01").cast("date")
    return ledger(spark, sf).where((F.col("service_date") >= first) & (F.col("service_date") < F.add_months(first, 1))).select("receipt", "line_no", "amount")


@query("FLT-04", "select event_id from events where ts >= timestamp '2024-01-20' - interval 7 day")
def rolling(spark, sf):
    return table(spark, sf, "events").where("ts >= timestamp_ntz'2024-01-20 00:00:00' - interval 7 day").select("event_id")


@query("FLT-06", f"with {LEDGER} select receipt, line_no, 'all' as scope from ledger union all select receipt, line_no, 'late' from ledger where service_date >= date '1998-01-01'")
def bypassed(spark, sf):
    rows = ledger(spark, sf)
    return choices.scopes(rows, "service_date", {"all": None, "late": "1998-01-01"}).select("receipt", "line_no", "scope")


@query("FLT-07", "select o_orderkey from orders where o_custkey = any([1, 5, 9, 77])")
def any_of(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_custkey").isin([1, 5, 9, 77])).select("o_orderkey")


@query("FLT-08", f"with {USAGE} select event_id, feature from usage where feature like 'blog%' or feature like '%alimtalk%'")
def like(spark, sf):
    return usage(spark, sf).where(F.col("feature").like("blog%") | F.col("feature").like("%alimtalk%")).select("event_id", "feature")


@query("FLT-11", "select distinct trim(source) as source from documents where trim(source) <> ''")
def not_blank(spark, sf):
    return table(spark, sf, "documents").where("trim(source) <> ''").select(F.trim("source").alias("source")).distinct()


@query("FLT-12", f"with {LEDGER} select receipt, line_no, amount from ledger where customer <> '(고객명 미상)' and patient <> '(환자명 미상)'")
def known(spark, sf):
    return L.known(ledger(spark, sf)).select("receipt", "line_no", "amount")


@query("FLT-14", f"with {ADS} select case when adgroup_id = '' and keyword_id = '' then 'campaign' when keyword_id = '' then 'adgroup' else 'keyword' end as level, count(*) as n, sum(clicks)::bigint as clicks from ads group by all")
def levels(spark, sf):
    return ads(spark, sf).groupBy(grain().alias("level")).agg(F.count("*").alias("n"), F.sum("clicks").alias("clicks"))


@query("FLT-15-presets", f"""with {RANKS}, best as (select hospital_id, keyword, metric_date, min(rank_value) as r, min(importance) as importance from ranks group by all),
  b as (select *, lag(r) over (partition by hospital_id, keyword order by metric_date) as p from best)
  select hospital_id, keyword, metric_date, coalesce(r > p, false) as dropped, p is not null and r is null as fell_off, coalesce(r between 11 and 15, false) as near, p is null and r is not null as entered
  from b where importance = 'high' and hospital_id <> 'h2' and contains(keyword, '3')""")  # fmt: skip
def presets(spark, sf):
    rows = ranks(spark, sf)
    important = rows.groupBy("hospital_id", "keyword", "metric_date").agg(F.min("importance").alias("importance"))
    board = K.presets(K.drops(rows)).join(important, ["hospital_id", "keyword", "metric_date"])
    return board.where("importance = 'high' and hospital_id <> 'h2' and contains(keyword, '3')").select("hospital_id", "keyword", "metric_date", "dropped", "fell_off", "near", "entered")


@query("FLT-16", f"with {LEDGER} select receipt, line_no, 'one' as who from ledger where hospital_id = 'h2' union all select receipt, line_no, 'admin' from ledger")
def scoped(spark, sf):
    users = spark.createDataFrame([("u", "h2", False), ("a", "h1", True)], "user_id string, hospital_id string, is_admin boolean")
    rows = ledger(spark, sf)
    one, every = (choices.scoped(rows, users, u).select("receipt", "line_no", F.lit(who).alias("who")) for u, who in (("u", "one"), ("a", "admin")))
    return one.union(every)


OWNERS = """owners as (select distinct hospital_id, chart_type, customer from ledger), mapped as (select distinct hospital_id, chart_type, customer, 'id' || customer as identity from ledger where amount > 50000)"""


def _owners(spark, sf):
    """Owners, and the identities of those with a large amount; the ledger is read once for both."""
    key = ["hospital_id", "chart_type", "customer"]
    owners = written(ledger(spark, sf).groupBy(*key).agg(F.max("amount").alias("most")))
    return owners.select(*key), owners.where("most > 50000").select(*key).withColumn("identity", F.concat(F.lit("id"), "customer")), key


@query("JN-02", f"with {LEDGER}, {OWNERS} select * from owners join mapped using (hospital_id, chart_type, customer)")
def inner_join(spark, sf):
    owners, mapped, key = _owners(spark, sf)
    return owners.join(mapped, key)


@query("JN-03", f"with {LEDGER}, {OWNERS} select o.* from owners o left join mapped m using (hospital_id, chart_type, customer) where m.identity is null")
def missing(spark, sf):
    owners, mapped, key = _owners(spark, sf)
    return owners.join(mapped, key, "left_anti")


@query("JN-04", f"with {LEDGER}, {OWNERS} select o.*, m.identity from owners o left join mapped m on o.chart_type = 'efriends' and m.hospital_id = o.hospital_id and m.chart_type = o.chart_type and m.customer = o.customer")
def conditional_join(spark, sf):
    owners, mapped, key = _owners(spark, sf)
    return owners.join(mapped.where("chart_type = 'efriends'"), key, "left")


@query("JN-07", f"""with {USAGE}, runs as (select distinct run_id from usage) select run_id from runs r where exists (select 1 from usage u where u.run_id = r.run_id and event_type = 'purchase')
  and not exists (select 1 from usage u where u.run_id = r.run_id and event_type = 'error')""")  # fmt: skip
def waiting_runs(spark, sf):
    runs = usage(spark, sf).groupBy("run_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("paid"), F.bool_or(F.col("event_type") == "error").alias("failed"))
    return runs.where("paid and not failed").select("run_id")


@query("JN-10", f"with {USAGE} select operation_id, min(feature) as feature, count(*) as n from usage group by all")
def operation_features(spark, sf):
    return usage(spark, sf).groupBy("operation_id").agg(F.min("feature").alias("feature"), F.count("*").alias("n"))


@query("JN-14", f"with {USAGE}, dim as (select 'h' || k as hospital_id from range(0, 8) as r(k)) select hospital_id, coalesce(sum(cost_usd), 0)::decimal(18,6) as cost_usd, count(event_id) as n_calls, max(ts) as last_used from dim left join usage using (hospital_id) group by all")
def usage_by(spark, sf):
    dim = spark.range(8).select(F.concat(F.lit("h"), "id").alias("hospital_id"))
    return billing.usage_by(usage(spark, sf), dim, "hospital_id")


@query("JN-15", f"with {LEDGER}, {OWNERS} select o.hospital_id, o.chart_type, o.customer, coalesce(m.identity, o.customer) as identity from owners o left join mapped m using (hospital_id, chart_type, customer)")
def updated_from(spark, sf):
    owners, mapped, key = _owners(spark, sf)
    return L.updated_from(owners.withColumn("identity", F.col("customer")), mapped, key, ["identity"])


@query("JN-16", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def without_older(spark, sf):
    return L.newest_rows(table(spark, sf, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("JN-23", f"with {USAGE} select e.event_id, u.hospital_id from events e join (select run_id, min(hospital_id) as hospital_id from usage group by all) u on u.run_id = e.event_id")
def looked_up(spark, sf):
    runs = usage(spark, sf).groupBy("run_id").agg(F.min("hospital_id").alias("hospital_id"))
    return table(spark, sf, "events").select("event_id").join(runs, F.col("event_id") == F.col("run_id")).select("event_id", "hospital_id")


@query("JN-25", """with t as (select c_custkey % 50 as place, c_custkey, 'store ' || c_custkey % 90 as target from customer), s as (select p_partkey % 50 as place, p_partkey, case p_partkey % 3 when 0 then 'Best store' || p_partkey % 90 || ' 24h' when 1 then 'sto' else ' store &amp; ' || p_partkey % 90 end as seen from part)
  select c_custkey, p_partkey from t join s using (place) where (p_partkey % 3 = 0 and contains('Beststore' || p_partkey % 90 || '24h', 'store' || c_custkey % 90)) or (p_partkey % 3 = 2 and (contains('store' || p_partkey % 90, 'store' || c_custkey % 90) or contains('store' || c_custkey % 90, 'store' || p_partkey % 90)))""")  # fmt: skip
def store_matches(spark, sf):
    targets = table(spark, sf, "customer").select((F.col("c_custkey") % 50).alias("place"), "c_custkey", F.concat(F.lit("store "), F.col("c_custkey") % 90).alias("target"))
    n, k = (F.col("p_partkey") % 90).cast("string"), F.col("p_partkey") % 3
    shown = F.when(k == 0, F.concat(F.lit("Best store"), n, F.lit(" 24h"))).when(k == 1, "sto").otherwise(F.concat(F.lit(" store &amp; "), n))
    seen = table(spark, sf, "part").select((F.col("p_partkey") % 50).alias("place"), "p_partkey", shown.alias("seen"))
    return choices.same_stores(targets, "target", seen, "seen", ["place"]).select("c_custkey", "p_partkey")


@query("JN-25-anywhere", """with t as (select c_custkey, 'store ' || c_custkey as target from customer), s as (select p_partkey, case p_partkey % 3 when 0 then 'Best store' || p_partkey || ' 24h' when 1 then 'ore' || p_partkey else ' store &amp; ' || p_partkey end as seen from part),
  bare as (select c_custkey, 'store' || c_custkey as t, p_partkey, replace(replace(replace(seen, '&amp;', '&'), '&', ''), ' ', '') as s from t, s)
  select c_custkey, p_partkey from bare where contains(s, t) or (length(s) >= 4 and contains(t, s))""")  # fmt: skip
def store_matches_anywhere(spark, sf):
    """Without a place to narrow the names down."""
    targets = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("store "), "c_custkey").alias("target"))
    n, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    shown = F.when(k == 0, F.concat(F.lit("Best store"), n, F.lit(" 24h"))).when(k == 1, F.concat(F.lit("ore"), n)).otherwise(F.concat(F.lit(" store &amp; "), n))
    return choices.same_stores(targets, "target", table(spark, sf, "part").select("p_partkey", shown.alias("seen")), "seen", []).select("c_custkey", "p_partkey")


@query("JN-26", """with a as (select c_custkey, 'o' || c_custkey % 400 as owner, ['p' || c_custkey % 3, 'p' || c_custkey % 5, 'x'] as n from customer), b as (select s_suppkey, 'o' || s_suppkey % 400 as owner, ['p' || s_suppkey % 3, 'y'] as n from supplier)
  select c_custkey, s_suppkey, len(list_intersect(list_distinct(a.n), list_distinct(b.n)))::double / len(list_distinct(list_concat(a.n, b.n))) as likeness from a join b using (owner) where likeness >= 0.3""")  # fmt: skip
def alike_sets(spark, sf):
    p = lambda c, m: F.concat(F.lit("p"), F.col(c) % m)
    a = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("o"), F.col("c_custkey") % 400).alias("owner"), F.array(p("c_custkey", 3), p("c_custkey", 5), F.lit("x")).alias("m"))
    b = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("o"), F.col("s_suppkey") % 400).alias("owner"), F.array(p("s_suppkey", 3), F.lit("y")).alias("n"))
    found = similarity.similar_rows(a.withColumnRenamed("m", "members"), b.withColumnRenamed("n", "members"), "members", ["owner"], 0.3)
    return found.select("c_custkey", "s_suppkey", F.col("similarity").alias("likeness"))


@query("JN-26-one-name", """with s as (select o_custkey, list(distinct 't' || o_orderkey % 41) as m from orders group by all)
  select a.o_custkey as one, b.o_custkey as other, len(list_intersect(a.m, b.m))::double / len(list_distinct(list_concat(a.m, b.m))) as likeness from s a join s b on a.o_custkey < b.o_custkey where likeness >= 0.5""")  # fmt: skip
def alike_sets_of_one_name(spark, sf):
    """All customers under one name, so nothing but their sets tells which of them are alike."""
    sets = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.concat(F.lit("t"), F.col("o_orderkey") % 41)).alias("members")).withColumn("owner", F.lit("owner"))
    found = similarity.similar_pairs(sets, "o_custkey", "members", ["owner"], 0.5)
    return found.select("one", "other", F.col("similarity").alias("likeness"))


@query("JN-27", """with s as (select o_orderkey, o_orderdate, '010-' || lpad((o_custkey % 700)::varchar, 4, '0') as digits from orders where o_orderstatus = 'F'),
  asked as (select c_custkey, '010-' || lpad((c_custkey % 700)::varchar, 4, '0') as digits from customer)
  select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_orderdate, o_orderkey)::int as place from asked join s using (digits) qualify place <= 500""")  # fmt: skip
def phone_matches(spark, sf):
    number = lambda c, f: F.concat(F.lit(f), F.lpad((F.col(c) % 700).cast("string"), 4, "0"))
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate", number("o_custkey", "010 ").alias("phone"))
    asked = table(spark, sf, "customer").select("c_custkey", number("c_custkey", "(010)-").alias("asked"))
    return choices.by_phone(asked, "asked", done, "phone", ["o_orderdate", "o_orderkey"], 500).select("c_custkey", "o_orderkey", "place")


@query("JN-28", "select o.o_orderkey, c.c_name, n.n from orders o left join customer c on c.c_custkey = o.o_custkey left join (select l_orderkey, count(*) as n from lineitem where l_returnflag = 'R' group by all) n on n.l_orderkey = o.o_orderkey")
def embedded(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(names, "o_custkey", "left").join(returned, "o_orderkey", "left").select("o_orderkey", "c_name", "n")


@query("AGG-03", "select o_custkey, coalesce(max(case when o_orderkey % 4 = 0 then 'name of ' || o_orderkey end), max(c_name)) as name from orders left join customer on c_custkey = o_custkey group by o_custkey")
def names(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    told = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("name of "), F.col("o_orderkey").cast("string")))
    return rows.groupBy("o_custkey").agg(F.coalesce(F.max(told), F.max("c_name")).alias("name"))


@query("AGG-21", f"with {USAGE}, s as (select hospital_id, coalesce(feature, '(기타)') as feature, count(*) as n from usage group by all) select hospital_id, to_json(list({{'feature': feature, 'n': n}} order by feature))::varchar as features from s group by all")
def json_lists(spark, sf):
    sums = usage(spark, sf).groupBy("hospital_id", F.coalesce("feature", F.lit("(기타)")).alias("feature")).agg(F.count("*").alias("n"))
    return sums.groupBy("hospital_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("feature", "n")))).alias("features"))


@query("AGG-22", f"with {USAGE} select hospital_id, count(distinct run_id) as n_runs, count(distinct operation_id) as n_operations from usage join orders on o_orderkey = event_id group by all")
def distinct_runs(spark, sf):
    both = usage(spark, sf).join(table(spark, sf, "orders").select("o_orderkey"), F.col("o_orderkey") == F.col("event_id"))
    return both.groupBy("hospital_id").agg(F.countDistinct("run_id").alias("n_runs"), F.countDistinct("operation_id").alias("n_operations"))


@query("AGG-23", f"""with {USAGE} select hospital_id, -sum(case when event_type = 'purchase' then k else -k end)::bigint as net, greatest(max(ts) filter (where event_type = 'signup'), max(ts) filter (where event_type = 'purchase'),
  max(ts) filter (where event_type = 'error'), max(ts) filter (where event_type = 'none')) as last_used from usage where event_type in ('purchase', 'click', 'signup', 'error') group by all""")  # fmt: skip
def net_usage(spark, sf):
    rows = usage(spark, sf).where("event_type in ('purchase', 'click', 'signup', 'error')")
    last = [F.max(F.when(F.col("event_type") == t, F.col("ts"))) for t in ("signup", "purchase", "error", "none")]
    return rows.groupBy("hospital_id").agg((-F.sum(F.when(F.col("event_type") == "purchase", F.col("k")).otherwise(-F.col("k")))).alias("net"), F.greatest(*last).alias("last_used"))


@query("AGG-24", f"with {USAGE} select provider, count(*) as n, sum(value)::decimal(18,2) as value from usage group by rollup (provider)")
def totals(spark, sf):
    return usage(spark, sf).rollup("provider").agg(F.count("*").alias("n"), F.sum("value").cast(MONEY).alias("value"))


@query("AGG-32", f"with {RANKS} select hospital_id, keyword, sum(rank_value)::bigint as total from ranks where rank_value is null or keyword <> 'word3' group by all")
def nullable_sums(spark, sf):
    return ranks(spark, sf).where("rank_value is null or keyword <> 'word3'").groupBy("hospital_id", "keyword").agg(F.sum("rank_value").alias("total"))


@query("AGG-37", f"""with {ADS}, s as (select campaign_id, adgroup_id, sum(impressions)::bigint as impressions, sum(clicks)::bigint as clicks, sum(cost)::decimal(18,2) as spend from ads group by all)
  select *, row_number() over (order by spend desc, campaign_id, adgroup_id)::int as place, case when impressions > 0 then clicks::double * 100 / impressions::double end as ctr from s""")  # fmt: skip
def ad_table(spark, sf):
    sums = ads(spark, sf).groupBy("campaign_id", "adgroup_id").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum("cost").cast(MONEY).alias("spend"))
    ctr = F.when(F.col("impressions") > 0, F.col("clicks").cast("double") * 100 / F.col("impressions").cast("double"))
    order = sums.withColumns({"falling_": -F.col("spend"), "one_": F.lit(1)})
    placed = scans.running(order, [], ["falling_", "campaign_id", "adgroup_id"], sums={"place": "one_"}).drop("falling_", "one_")
    return placed.withColumn("place", F.col("place").cast("int")).withColumn("ctr", ctr)


@query("AGG-40-sentiments", f"with {REVIEWS} select hospital_id, sentiment, count(*) as n from reviews where slot is null and visit_date >= date '2024-06-01' and visit_date < date '2024-12-01' group by all")
def sentiments(spark, sf):
    return reviews(spark, sf).where("slot is null and visit_date >= date'2024-06-01' and visit_date < date'2024-12-01'").groupBy("hospital_id", "sentiment").agg(F.count("*").alias("n"))


@query("AGG-40-negative", f"with {REVIEWS} select hospital_id, review_id, row_number() over (partition by hospital_id order by sentiment <> 'strong_negative', visit_date desc, review_id)::int as place from reviews where sentiment in ('strong_negative', 'negative') and visit_date >= date '2024-06-01'")
def negative_reviews(spark, sf):
    rows = reviews(spark, sf).where("sentiment in ('strong_negative', 'negative') and visit_date >= date'2024-06-01'")
    order = Window.partitionBy("hospital_id").orderBy(F.col("sentiment") != "strong_negative", F.desc("visit_date"), "review_id")
    return rows.select("hospital_id", "review_id", F.row_number().over(order).alias("place"))


@query("AGG-45", "select w as keyword, max(d) as last_used from (select p_brand as w, p_size as d from part union all select p_type, p_size from part) where w is not null group by w")
def last_used(spark, sf):
    rows = table(spark, sf, "part").select(F.explode(F.array("p_brand", "p_type")).alias("keyword"), "p_size").where("keyword is not null")
    return rows.groupBy("keyword").agg(F.max("p_size").alias("last_used"))


@query("AGG-47", f"with {USAGE} select operation_id, sum(cost_usd)::decimal(18,6) as cost, ceil(sum(cost_usd) * 100)::bigint as tokens from usage group by all")
def operation_costs(spark, sf):
    made = usage(spark, sf).groupBy("operation_id").agg(F.sum("cost_usd").cast("decimal(18,6)").alias("cost"))
    return made.withColumn("tokens", F.ceil(F.col("cost") / F.lit("0.01").cast("decimal(4,2)")).cast("long"))


@query("AGG-50", f"with {RANKS} select hospital_id, keyword, coalesce(max(rank_value), 0)::int as top from ranks group by all")
def axis_tops(spark, sf):
    return ranks(spark, sf).groupBy("hospital_id", "keyword").agg(F.coalesce(F.max("rank_value"), F.lit(0)).alias("top"))


@query("AGG-55", f"with {USAGE} select run_id, sum(k)::bigint as adjusted, count(*) as n from usage where event_type = 'click' and run_id is not null group by all")
def adjusted(spark, sf):
    return usage(spark, sf).where("event_type = 'click' and run_id is not null").groupBy("run_id").agg(F.sum("k").alias("adjusted"), F.count("*").alias("n"))


@query("WIN-05", f"with {RANKS} select keyword, slot, metric_date, rank_value from ranks qualify row_number() over (partition by keyword order by metric_date desc, slot, section, hospital_id, rank_value nulls first, importance) = 1")
def newest_of_keyword(spark, sf):
    return L.newest_rows(ranks(spark, sf), ["keyword"], F.desc("metric_date"), F.col("slot"), F.col("section"), F.col("hospital_id"), F.col("rank_value").asc_nulls_first(), F.col("importance")).select("keyword", "slot", "metric_date", "rank_value")


LAGGED = """best as (select hospital_id, keyword, metric_date, min(rank_value) as r from ranks group by all), b as (select *, lag(r) over (partition by hospital_id, keyword order by metric_date) as p from best)"""


@query("WIN-09", f"with {RANKS}, {LAGGED} select hospital_id, keyword, metric_date, case when p is null or r is null or p = r then 0 when r < p then 1 else -1 end as trend from b")
def trends(spark, sf):
    rows = K.drops(ranks(spark, sf))
    return rows.select("hospital_id", "keyword", "metric_date", K.trend(F.col("rank_value"), F.col("previous")).alias("trend"))


@query("WIN-10", f"with {RANKS}, {LAGGED} select hospital_id, keyword, metric_date, r as rank_value, p as previous, case when p > 0 then (r - p)::double * 100 / p::double end as change from b")
def lagged(spark, sf):
    rows = K.drops(ranks(spark, sf))
    return rows.select("hospital_id", "keyword", "metric_date", "rank_value", "previous", change_percent(F.col("rank_value"), F.col("previous")).alias("change"))


@query("WIN-15", "select event_id, user_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by event_id) as session from events")
def sessions(spark, sf):
    order = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(order).alias("session"))


@query("SRT-04", f"with {USAGE}, s as (select hospital_id, count(*) as a, sum(k)::bigint as b from usage group by all) select *, row_number() over (order by a * 2 + coalesce(b, 0) desc, hospital_id nulls first)::int as place from s")
def sorted_by_expression(spark, sf):
    sums = usage(spark, sf).groupBy("hospital_id").agg(F.count("*").alias("a"), F.sum("k").alias("b"))
    return sums.withColumn("place", F.row_number().over(Window.orderBy((F.col("a") * 2 + F.coalesce("b", F.lit(0))).desc(), F.col("hospital_id").asc_nulls_first())))  # a row a hospital


@query("SRT-05", f"""with {LEDGER}, b as (select hospital_id, coalesce(sum(amount) filter (where service_date >= date '1998-01-01'), 0)::decimal(18,2) as an, coalesce(sum(amount) filter (where service_date < date '1998-01-01'), 0)::decimal(18,2) as ab,
    (count(*) filter (where service_date >= date '1998-01-01'))::decimal(18,2) as ln, (count(*) filter (where service_date < date '1998-01-01'))::decimal(18,2) as lb from ledger where service_date >= date '1997-01-01' group by all),
  c as (select hospital_id, case when ab > 0 then (an - ab)::double * 100 / ab::double end as x, case when lb > 0 then (ln - lb)::double * 100 / lb::double end as y from b)
  select hospital_id, row_number() over (order by coalesce(x, 0), least(coalesce(x, 0), coalesce(y, 0), 0), hospital_id)::int as place from c""")  # fmt: skip
def worst_first(spark, sf):
    rows, late = ledger(spark, sf).where("service_date >= date'1997-01-01'"), F.col("service_date") >= "1998-01-01"
    zero = lambda c: F.coalesce(c, F.lit(0)).cast(MONEY)
    sums = rows.groupBy("hospital_id").agg(zero(F.sum(F.when(late, F.col("amount")))).alias("an"), zero(F.sum(F.when(~late, F.col("amount")))).alias("ab"), F.count_if(late).cast(MONEY).alias("ln"), F.count_if(~late).cast(MONEY).alias("lb"))
    board = sums.select("hospital_id", change_percent(F.col("an"), F.col("ab")).alias("x"), change_percent(F.col("ln"), F.col("lb")).alias("y"))
    return board.select("hospital_id", F.row_number().over(Window.orderBy(*periods.worst_first(board, "x", ["x", "y"]), "hospital_id")).alias("place"))  # a row a hospital


@query("SRT-07", "select event_id from (select * from events order by ts, event_id limit 20) where event_type in ('click', 'purchase') order by ts, event_id limit 1")
def oldest_eligible(spark, sf):
    oldest = table(spark, sf, "events").orderBy("ts", "event_id").limit(20)
    return oldest.where("event_type in ('click', 'purchase')").orderBy("ts", "event_id").limit(1).select("event_id")


@query("SET-01", "select p_brand as word from part union all select c_mktsegment from customer")
def union_all(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("word")).unionByName(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("word")))


@query("SET-03", "select c_mktsegment, list_sort(list_distinct(list('n' || c_nationkey) || ['n1', 'zz'])) as v from customer group by all")
def merged_arrays(spark, sf):
    sets = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.collect_set(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("s"))
    return sets.select("c_mktsegment", merged_set(F.col("s"), F.array(F.lit("n1"), F.lit("zz"))).alias("v"))


@query("SET-04", """select p_partkey, list_filter(b, lambda x: list_contains(a, x)) as kept, list_filter(b, lambda x: not list_contains(a, x)) as added, list_filter(a, lambda x: not list_contains(b, x)) as removed
  from (select p_partkey, ['s' || p_size % 4, 's1', 's1'] as a, ['s' || p_size % 3, 's1', 's' || p_size % 3] as b from part)""")  # fmt: skip
def list_changes(spark, sf):
    s = lambda m: F.concat(F.lit("s"), (F.col("p_size") % m).cast("string"))
    kept, added, removed = choices.kept_added_removed(F.array(s(4), F.lit("s1"), F.lit("s1")), F.array(s(3), F.lit("s1"), s(3)))
    return table(spark, sf, "part").select("p_partkey", kept.alias("kept"), added.alias("added"), removed.alias("removed"))


@query("SET-05", """with a as (select p_partkey, 'brand' as field, p_brand as value from part union all select p_partkey, 'type', p_type from part), b as (select p_partkey, 'brand' as field, case when p_partkey % 3 = 0 then 'new' else p_brand end as value from part where p_partkey % 5 <> 0 union all select p_partkey, 'more', 'x' from part)
  select a.p_partkey, a.field, coalesce(a.value, '') as draft, coalesce(b.value, '') as final from a left join b using (p_partkey, field) where coalesce(a.value, '') <> coalesce(b.value, '')""")  # fmt: skip
def field_changes(spark, sf):
    part = table(spark, sf, "part")
    field = lambda n, c: part.select("p_partkey", F.lit(n).alias("field"), c.alias("value"))
    before = field("brand", F.col("p_brand")).union(field("type", F.col("p_type")))
    after = field("brand", F.when(F.col("p_partkey") % 3 == 0, "new").otherwise(F.col("p_brand"))).where("p_partkey % 5 <> 0").union(field("more", F.lit("x")))
    return choices.field_changes(before, after, ["p_partkey", "field"])


@query("STM-07", f"""with {LEDGER}, changed as (select distinct hospital_id, date_trunc('month', service_date)::date as month from ledger where run_id % 500 = 0)
  select l.hospital_id, c.month, sum(amount)::decimal(18,2) as amount from ledger l join changed c on c.hospital_id = l.hospital_id and c.month = date_trunc('month', service_date)::date group by all""")  # fmt: skip
def rebuilt_months(spark, sf):
    rows = ledger(spark, sf)
    return periods.rebuilt_months(rows, rows.where("run_id % 500 = 0"), "service_date", ["hospital_id"], "amount")


@query("STM-06", f"with {USAGE}, r as (select run_id, max(ts) as last, bool_or(event_type = 'purchase') as done from usage group by all) select run_id, case when done then 'succeeded' when last < timestamp '2024-01-20' then 'failed' else 'running' end as status from r")
def repaired_runs(spark, sf):
    runs = usage(spark, sf).groupBy("run_id").agg(F.max("ts").alias("last"), F.bool_or(F.col("event_type") == "purchase").alias("done"))
    return runs.select("run_id", billing.run_status(F.col("done"), F.col("last"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).alias("status"))
