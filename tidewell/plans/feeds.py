"""Queries of sources and sinks: payloads mapped to facts, exports written and read back, uploads repeated."""

from __future__ import annotations

from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import billing, ledger as L
from tidewell.operators.storage import folder
from tidewell.plans.fixtures import LEDGER, RANKS, USAGE, ledger, ranks, table, usage
from tidewell.plans.registry import query
from tidewell.sources import payloads, readers, scans, textlayers, workbooks
from tidewell.streaming.months import MonthSums
from tidewell.streaming.tables import KeyedTable

MONEY = "decimal(18,2)"


def _export(spark: SparkSession, sf: str) -> DataFrame:
    """A sales export with positions as columns, quotes within names, and a last row of totals."""
    rows = table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(
        F.date_format("o_orderdate", "yyyy/M/d").alias("c0"), F.col("o_orderkey").cast("string").alias("c1"), F.concat(F.lit('Kim "'), F.col("o_custkey").cast("string"), F.lit('", A')).alias("c2"),
        F.lit("p").alias("c3"), F.lit("").alias("c4"), F.lit("treatment").alias("c5"), *(F.lit("").alias(f"c{i}") for i in range(6, 11)),
        F.format_number(F.col("o_totalprice").cast(MONEY), 2).alias("c11"), F.col("o_orderkey").alias("n"))
    blank = [F.lit("").alias(f"c{i}") for i in range(11)]
    totals = spark.range(1).select(*blank, F.lit("9,999.00").alias("c11"), F.lit(2**62).alias("n"))
    return rows.union(totals)


@query("SRC-04", """select o_orderdate::date as service_date, o_orderkey::varchar as customer_no, 'Kim "' || o_custkey || '", A' as customer_name, 'treatment' as treatment, o_totalprice::decimal(18,2) as amount from orders where o_orderkey % 5 = 0""")
def exported(spark, sf):
    path = folder(spark)
    _export(spark, sf).coalesce(1).sortWithinPartitions("n").drop("n").write.csv(path, quote='"', escape='"')
    rows = readers.without_totals(readers.raw_rows(spark, path, 12), ["c1", "c2"], ["c11"])
    return readers.positional(rows, readers.POSITIONS["woorien"]).select("service_date", "customer_no", "customer_name", "treatment", "amount")


@query("SRC-01", "select o_orderdate::date as service_date, o_orderkey::varchar as customer_no, 'n' || o_custkey as customer_name, 'p' as patient_name, o_totalprice::decimal(18,2) as amount from orders where o_orderkey % 6 = 0")
def export_with_two_headers(spark, sf):
    path = folder(spark)
    head = [(["날짜", "번호", "고객", "환자", "비고", "청구금액", ""], -2), (["", "", "", "", "", "할인", "합계"], -1), (["", "", "", "", "", "", "9,999.00"], 2**62)]
    extra = spark.createDataFrame([(*c, n) for c, n in head], ", ".join(f"c{i} string" for i in range(7)) + ", n long")
    made = table(spark, sf, "orders").where("o_orderkey % 6 = 0").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("c0"), F.col("o_orderkey").cast("string").alias("c1"), F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("c2"),
        F.lit("p").alias("c3"), F.lit("").alias("c4"), F.lit("1").alias("c5"), F.format_number(F.col("o_totalprice").cast(MONEY), 2).alias("c6"), F.col("o_orderkey").alias("n"))
    made.union(extra).coalesce(1).sortWithinPartitions("n").drop("n").write.csv(path, quote='"', escape='"', emptyValue="")
    rows = readers.raw_rows(spark, path, 7)
    header = [[v or "" for v in r[:7]] for r in rows.orderBy("row_no").limit(2).collect()]  # two rows of a sheet
    at = readers.amount_column(header, [6])
    data = readers.without_totals(readers.without_headers(rows, 2), ["c1", "c2", "c3"], [f"c{at}"])
    return readers.positional(data, {"service_date": 0, "customer_no": 1, "customer_name": 2, "patient_name": 3, "amount": at}).drop("file", "row_no")


@query("SRC-03", "select (o_orderkey % 4)::int as part, count(*) as n, sum(o_totalprice::decimal(18,2))::decimal(18,2) as amount from orders group by all")
def files_with_totals(spark, sf):
    """Four files, each ended by a row of its totals; a row without names within a file stays out of it by having no amount."""
    path = folder(spark)
    rows = table(spark, sf, "orders").select((F.col("o_orderkey") % 4).cast("int").alias("part"), F.col("o_orderkey").alias("n"), F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("c0"), F.col("o_totalprice").cast(MONEY).cast("string").alias("c1"))
    totals = rows.groupBy("part").agg(F.sum(F.col("c1").cast(MONEY)).cast("string").alias("c1")).select("part", F.lit(2**62).alias("n"), F.lit(" ").alias("c0"), "c1")
    rows.union(totals).repartition("part").sortWithinPartitions("part", "n").drop("n").write.partitionBy("part").csv(path)
    read = readers.without_totals(readers.raw_rows(spark, f"{path}/part=*", 2), ["c0"], ["c1"])
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("int").alias("part")
    return read.groupBy(part).agg(F.count("*").alias("n"), F.sum(F.col("c1").cast(MONEY)).cast(MONEY).alias("amount"))


@query("SRC-05", "select o_orderdate::date as service_date, '고객' || o_custkey as customer_name, '진료' as treatment, o_orderkey::varchar as receipt, o_totalprice::decimal(18,2) as amount from orders where o_orderkey % 7 < 3")
def exports_of_two_encodings(spark, sf):
    """One file in the older encoding, one in UTF-8, one in UTF-8 that begins with a byte order mark."""
    path = folder(spark)
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("n"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("c0"), *(F.lit("x").alias(f"c{i}") for i in range(1, 5)),
        F.concat(F.lit("고객"), F.col("o_custkey").cast("string")).alias("c5"), F.lit("진료").alias("c6"), F.col("o_orderkey").cast("string").alias("c7"),
        F.lit("").alias("c8"), F.lit("").alias("c9"), F.format_number(F.col("o_totalprice").cast(MONEY), 2).alias("c10"))
    first = F.row_number().over(Window.orderBy("n")) == 1
    marked = rows.where("n % 7 = 2").withColumn("c0", F.concat(F.when(first, "\ufeff").otherwise(""), "c0"))

    @F.pandas_udf("binary")
    def encoded(values: pd.Series) -> pd.Series:
        return values.map(lambda t: t.encode("euc_kr"))

    for k, part in enumerate([rows.where("n % 7 = 0"), rows.where("n % 7 = 1"), marked]):
        quoted = [F.concat(F.lit('"'), F.col(f"c{i}"), F.lit('"')) if i == 10 else F.col(f"c{i}") for i in range(11)]
        lines = part.select("n", F.concat_ws(",", *quoted).alias("value"))
        if k == 0:
            lines = lines.withColumn("value", encoded("value").cast("string"))
        lines.coalesce(1).sortWithinPartitions("n").select("value").write.text(f"{path}/{k}")
    return readers.positional(readers.export_rows(spark, f"{path}/*", 11), readers.POSITIONS["efriends"]).select("service_date", "customer_name", "treatment", "receipt", "amount")


@query("SRC-06", """select o_orderkey, 'a,"' || o_custkey || '"' as name, case when o_orderkey % 2 = 0 then 'say "hi"' end as note from orders""")
def quoted_lines(spark, sf):
    path = folder(spark)
    note = F.when(F.col("o_orderkey") % 2 == 0, F.lit('"say ""hi"""')).otherwise(F.lit(""))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.concat(F.lit('"a,""'), F.col("o_custkey").cast("string"), F.lit('"""')), note)
    table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    rows = readers.raw_rows(spark, path, 3)
    return rows.select(F.col("c0").cast("long").alias("o_orderkey"), F.col("c1").alias("name"), F.col("c2").alias("note"))


@query("SRC-17", "select count(*) as n, count(distinct event_id) as ids, max(event_id) as last from events")
def whole_scan(spark, sf):
    """All rows of a table of any size; there are no pages and no cap."""
    return table(spark, sf, "events").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"), F.max("event_id").alias("last"))


@query("STM-02", "with f as (select user_id, min(ts)::date as day from events group by all) select day, count(*) as first_visits from f group by all")
def late_visits(spark, sf):
    """First days known from half of the rows, corrected by the other half, which comes late and out of order."""
    visits = table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    known = L.first_days(visits.where("event_id % 2 = 0"), "user_id", "day")
    return L.recounted_days(known, visits.where("event_id % 2 = 1"), "user_id", "day").groupBy("day").agg(F.count("*").alias("first_visits"))


@query("SRC-02", "select o_orderkey, o_totalprice::decimal(18,2) as amount from orders where o_orderkey % 9 = 0")
def detected_amount(spark, sf):
    header = [["번호", "진료", "", "청구금액", "", ""], ["", "합계", "날짜", "공급가", "부가세", "합계"]]
    rows = table(spark, sf, "orders").where("o_orderkey % 9 = 0").select(F.col("o_orderkey").cast("string").alias("c0"), F.lit("7").alias("c1"), *(F.lit("1").alias(f"c{i}") for i in (2, 3, 4)), F.format_number(F.col("o_totalprice").cast(MONEY), 2).alias("c5"))
    at = readers.amount_column(header, [5])
    from tidewell.functions.numbers import parse_amount

    return rows.select(F.col("c0").cast("long").alias("o_orderkey"), parse_amount(F.col(f"c{at}")).alias("amount"))


@query("SRC-07", "select o_orderdate::date as metric_date, o_orderkey as value_1, (o_custkey % 10)::bigint as value_2 from orders where o_orderkey % 3 <> 0 and o_orderkey % 4 <> 0")
def dated_lines(spark, sf):
    path = folder(spark)
    day = F.when(F.col("o_orderkey") % 3 == 0, F.lit("합계")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    first = F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(" 회")))
    table(spark, sf, "orders").select(F.concat_ws(",", day, first, (F.col("o_custkey") % 10).cast("string")).alias("value")).write.text(path)
    return readers.dated_lines(spark, path, 2)


@query("SRC-09", "select c_custkey, unnest([date '2024-01-02', date '2024-01-03']) as metric_date, unnest([c_custkey + 1000, c_custkey % 7])::bigint as value from customer")
def page_tables(spark, sf):
    first = F.format_number(F.col("c_custkey") + 1000, 0)
    body = F.concat(F.lit("조회수\n2024.01.02.(화)\t"), first, F.lit("\n2024.01.03.(수)\t"), (F.col("c_custkey") % 7).cast("string"), F.lit("\n2024.01.04.\t9"))
    return readers.table_rows(table(spark, sf, "customer").select("c_custkey", body.alias("body")), "body")


def _payload(*pairs):
    return F.to_json(F.struct(*(c.alias(n) for n, c in pairs)))


@query("SRC-10", """select '2024-01-01'::date as metric_date, 'h1' as hospital_id, 'c' || l_suppkey as campaign_id, case when l_linenumber = 1 then '' else 'g' || l_partkey end as adgroup_id, '' as keyword_id, l_quantity::bigint as impressions,
  coalesce(case when l_linenumber % 2 = 0 then l_linenumber end, 0)::bigint as clicks, l_extendedprice::decimal(18,2) as cost from lineitem""")  # fmt: skip
def search_ads(spark, sf):
    payload = _payload(("impCnt", F.format_number("l_quantity", 0)), ("clkCnt", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber"))), ("salesAmt", F.col("l_extendedprice").cast(MONEY).cast("string")))
    rows = table(spark, sf, "lineitem").select(F.lit("2024-01-01").alias("metric_date"), F.lit("h1").alias("hospital_id"), F.concat(F.lit("c"), "l_suppkey").alias("campaign_id"), F.when(F.col("l_linenumber") != 1, F.concat(F.lit("g"), "l_partkey")).alias("adgroup_id"), F.lit(None).cast("string").alias("keyword_id"), payload.alias("payload"))
    return payloads.search_ads(rows)


@query("SRC-11", "select '2024-01-01'::date as metric_date, p_partkey::varchar as campaign_id, case when p_partkey % 2 = 0 then p_name end as campaign_name, '' as ad_group_id, p_size::bigint as impressions, 0::bigint as clicks, p_size * 1000000::bigint as cost_micros, case when p_size > 20 then p_size::double end as conversions from part")
def google_ads(spark, sf):
    size = F.col("p_size")
    camp = F.struct(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("name"))
    shown = F.struct(size.cast("string").alias("impressions"), (size * 1000000).cast("string").alias("costMicros"), F.when(size > 20, size).alias("conversions"))
    rows = table(spark, sf, "part").select(_payload(("segments", F.struct(F.lit("2024-01-01").alias("date"))), ("campaign", camp), ("metrics", shown)).alias("payload"))
    return payloads.google_ads(rows)


@query("SRC-12", "select '2024-02-01'::date as metric_date, p_partkey::varchar as campaign_id, '' as ad_id, p_size::bigint as impressions, 0::bigint as clicks, 0::bigint as reach, p_retailprice::decimal(18,2) as spend, 'KRW' as currency from part")
def social_ads(spark, sf):
    rows = table(spark, sf, "part").select(_payload(("date_start", F.lit("2024-02-01")), ("campaign_id", F.col("p_partkey").cast("string")), ("impressions", F.col("p_size").cast("string")), ("spend", F.col("p_retailprice").cast(MONEY).cast("string")), ("account_currency", F.lit("KRW"))).alias("payload"))
    return payloads.social_ads(rows)


@query("SRC-14", f"""with {RANKS}, w as (select hospital_id, keyword, metric_date, min(rank_value) filter (where section = 'blog') as blog, min(rank_value) filter (where section = 'view') as view from ranks group by all)
  select hospital_id, keyword, metric_date, 'blog' as section, blog as rank_value from w union all select hospital_id, keyword, metric_date, 'view', view from w union all select hospital_id, keyword, metric_date, 'best', least(blog, view) from w where least(blog, view) is not null""")  # fmt: skip
def rank_rows(spark, sf):
    items = ranks(spark, sf).groupBy("hospital_id", "keyword", "metric_date").agg(*(F.min(F.when(F.col("section") == s, F.col("rank_value"))).alias(s) for s in ("blog", "view")))
    return readers.rank_rows(items, ["blog", "view"])


@query("SRC-15", "select o_custkey, o_orderkey as seq, (o_orderkey % 5)::int as slot from orders where o_orderkey % 5 between 1 and 3 qualify row_number() over (partition by o_custkey, o_orderkey % 5 order by o_orderkey) = 1")
def competitors(spark, sf):
    items = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 5).cast("int").alias("slot"))
    return readers.competitor_rows(items, ["o_custkey", "slot"])


@query("SRC-16", """select event_id, case when event_id % 2 = 0 then 'vr:' || event_id when event_id % 3 = 0 then 'ph:' || event_id else 'ph:' || md5('text|2024-03-09|' || user_id) end as review_id, date '2024-03-09' as review_date,
  case when event_id % 2 = 0 then date '2024-03-08' end as visit_date, case when event_id % 2 = 0 then null else 'text' end as content from events where event_id % 2 = 1 or event_id % 10 <> 0""")  # fmt: skip
def review_payloads(spark, sf):
    visitor = _payload(("id", F.when(F.col("event_id") % 10 != 0, F.col("event_id").cast("string"))), ("body", F.lit("  ")), ("created", F.lit("2024.3.9")), ("visited", F.lit("24.3.8.금")))
    photo = _payload(("text", F.lit(" text ")), ("date", F.lit("2024.3.9")), ("logId", F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string"))), ("author", F.struct(F.col("user_id").cast("string").alias("id"))))
    kind = F.when(F.col("event_id") % 2 == 0, "visitor").otherwise("photo")
    rows = table(spark, sf, "events").select("event_id", kind.alias("kind"), F.when(F.col("event_id") % 2 == 0, visitor).otherwise(photo).alias("payload"))
    return payloads.reviews(rows, F.lit("2024-03-10").cast("date")).select("event_id", "review_id", "review_date", "visit_date", "content")


@query("SRC-19", """select c_custkey, '010' || lpad((c_custkey % 10000)::varchar, 8, '0') as phone, case when c_custkey % 3 = 0 then 'canine' when c_custkey % 3 = 1 then 'feline' end as species, case when c_custkey % 2 = 0 then 'M' else 'F' end as sex,
  case when c_custkey % 4 <> 0 then date '2020-05-01' end as birth from customer""")  # fmt: skip
def intake(spark, sf):
    n = F.lpad((F.col("c_custkey") % 10000).cast("string"), 8, "0")
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("+82 10-"), F.substring(n, 1, 4), F.lit("-"), F.substring(n, 5, 4)).alias("phone"), F.element_at(F.array(F.lit("강아지"), F.lit("Cat"), F.lit("기타")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("species"),
        F.when(F.col("c_custkey") % 2 == 0, "중성화 수컷").otherwise("암컷").alias("sex"), F.when(F.col("c_custkey") % 4 == 0, "모름").otherwise("2020.5.1").alias("birth"))
    return payloads.intake(rows).select("c_custkey", "phone", "species", "sex", "birth")


@query("SRC-21", "select sha256(string_agg(p_partkey || ',' || p_name || chr(10), '' order by p_partkey)) as sha256, sum(strlen(p_partkey || ',' || p_name) + 1)::bigint as length from part group by p_brand")
def digests(spark, sf):
    """A file of parts for each brand."""
    path = folder(spark)
    lines = table(spark, sf, "part").select("p_brand", "p_partkey", F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name").alias("value"))
    lines.repartition("p_brand").sortWithinPartitions("p_brand", "p_partkey").select("p_brand", "value").write.partitionBy("p_brand").text(path)
    return readers.file_digests(spark, path + "/p_brand=*/part-*").select("sha256", "length")


@query("SNK-04", f"with {LEDGER}, m as (select date_trunc('month', service_date)::date as month, sum(amount)::decimal(18,2) as amount from ledger group by all) select month, case when month >= date '1998-01-01' then 0 else amount end::decimal(18,2) as amount from m")
def replaced_range(spark, sf):
    path = folder(spark)
    months = ledger(spark, sf).groupBy(F.trunc("service_date", "month").alias("month")).agg(F.sum("amount").cast(MONEY).alias("amount"))
    readers.replace_range(months, path, "month")
    readers.replace_range(months.where("month >= date'1998-01-01'").withColumn("amount", F.lit(0).cast(MONEY)), path, "month")
    return spark.read.parquet(path).select(F.col("month").cast("date").alias("month"), "amount")


@query("SNK-05", "select 'f' || o_orderkey % 4 as file, o_orderkey, 'old' as load from orders where o_orderkey % 4 <> 2 union all select 'f2', o_orderkey, 'new' from orders where o_orderkey % 8 = 2")
def uploaded_again(spark, sf):
    rows = table(spark, sf, "orders").select(F.concat(F.lit("f"), (F.col("o_orderkey") % 4).cast("string")).alias("file"), "o_orderkey", F.lit("old").alias("load"))
    again = rows.where("o_orderkey % 8 = 2").withColumn("load", F.lit("new"))
    return L.upserted(rows, again, ["file"])


@query("SNK-06", "select o_orderkey, o_orderkey % 3 as run_id from orders where not (o_orderkey % 3 = 1 and o_orderkey % 2 = 0)")
def compensated(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("run_id"), F.when(F.col("o_orderkey") % 2 == 1, F.lit("k")).alias("dedupe_key"))
    return L.without_failed_run(rows, 1).select("o_orderkey", "run_id")


@query("SNK-07", "select o_orderkey, case when o_orderkey % 3 = 0 then 'no_date' when o_orderkey % 5 = 0 then 'no_amount' else 'ok' end as outcome from orders")
def quarantined(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("day"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("amount"))
    good, bad = readers.split_valid(rows, {"no_date": F.col("day").isNotNull(), "no_amount": F.col("amount").isNotNull()})
    return good.select("o_orderkey", F.lit("ok").alias("outcome")).union(bad.select("o_orderkey", F.col("error_code").alias("outcome")))


@query("SNK-08", "select p_brand as keyword, '2024-02' as year_month, coalesce(max(p_size) filter (where p_partkey % 2 = 0), max(p_size)) as volume from part group by p_brand")
def volumes(spark, sf):
    of = lambda rows: rows.groupBy(F.col("p_brand").alias("keyword"), F.lit("2024-02").alias("year_month")).agg(F.max("p_size").alias("volume"))
    part = table(spark, sf, "part")
    return L.upserted(of(part), of(part.where("p_partkey % 2 = 0")), ["keyword", "year_month"])


@query("SNK-09", f"with {RANKS} select metric_date, keyword, coalesce(min(rank_value) filter (where section = 'blog') || '위', '—') as blog, coalesce(min(rank_value) filter (where section = 'place') || '위', '—') as place from ranks group by all")
def wide_ranks(spark, sf):
    return readers.wide_ranks(ranks(spark, sf), ["blog", "place"])


@query("SNK-10", "select chr(65279) || 'key,name' as value union all select p_partkey || ',\"a \"\"' || p_brand || '\"\"\"' from part")
def marked_csv(spark, sf):
    path = folder(spark)
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit('a "'), "p_brand", F.lit('"')).alias("name"))
    readers.write_marked_csv(rows, path)
    whole = spark.read.format("binaryFile").load(path + "/part-*").select(F.decode("content", "UTF-8").alias("all"))  # the text reader drops the mark
    return whole.select(F.explode(F.split("all", "\n")).alias("value")).where("value <> ''")


@query("BIL-02", f"with {USAGE} select hospital_id, operation_id, kind, tokens, sum(tokens) over (partition by hospital_id order by created_at, operation_id rows unbounded preceding)::decimal(18,2) as balance_after from (select hospital_id, 'g' || event_id as operation_id, case when k % 2 = 0 then 'grant' else 'adjust' end as kind, k::bigint as tokens, ts as created_at from usage where hospital_id is not null and k is not null)")
def grants(spark, sf):
    rows = usage(spark, sf).where("hospital_id is not null and k is not null")
    given = rows.selectExpr("hospital_id", "concat('g', event_id) as operation_id", "case when k % 2 = 0 then 'grant' else 'adjust' end as kind", "cast(k as bigint) as tokens", "ts as created_at")
    return billing.balance(given, ["hospital_id"], ["created_at", "operation_id"], "tokens").drop("created_at")


@query("BIL-03", f"""with {USAGE}, back as (select operation_id from usage where hospital_id is not null and event_type = 'click'),
  sent as (select hospital_id, operation_id, sum(value)::decimal(18,2) as krw, operation_id in (select operation_id from back) as refunded from usage where hospital_id is not null group by all)
  select hospital_id, operation_id, -ceil(krw / 13)::bigint as tokens, case when refunded then 0 else ceil(krw / 13)::bigint end as refund from sent where krw > 0""")  # fmt: skip
def message_charges(spark, sf):
    rows = usage(spark, sf).where("hospital_id is not null")
    sent = rows.groupBy("hospital_id", "operation_id").agg(F.sum("value").cast(MONEY).alias("krw"))
    return billing.message_charges(sent, rows.where("event_type = 'click'").select("operation_id"), 13)


@query("BIL-06", """with packs as (select p_partkey as package_id, p_size::bigint as base, (p_size % 5)::bigint as bonus from part where p_partkey % 3 <> 0),
  o as (select o_orderkey, o_custkey, o_custkey % 50 as package_id, o_orderstatus, row_number() over (order by o_orderdate, o_orderkey) as n, year(o_orderdate) as y from orders)
  select o_orderkey, case when package_id not in (select package_id from packs) then 'invalid_package' when o_orderstatus <> 'O' then 'not_pending' else 'ok' end as outcome, case when o_orderstatus = 'O' then base + bonus end as granted from o left join packs using (package_id)""")  # fmt: skip
def token_orders(spark, sf):
    packs = table(spark, sf, "part").where("p_partkey % 3 <> 0").selectExpr("p_partkey as package_id", "cast(p_size as bigint) as base_tokens", "cast(p_size % 5 as bigint) as bonus_tokens")
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("package_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("paid").alias("status"))
    return billing.confirmed_orders(orders, packs).select("o_orderkey", "outcome", "granted")


@query("BIL-07", f"""with {USAGE}, s as (select hospital_id, feature, sum(k)::bigint as tokens, count(*) as n from usage where hospital_id is not null and feature is not null group by all)
  select hospital_id, sum(tokens)::bigint as tokens, to_json(list({{'feature': feature, 'tokens': tokens, 'n': n}} order by feature))::varchar as by_feature from s group by all""")  # fmt: skip
def overview(spark, sf):
    rows = usage(spark, sf).where("hospital_id is not null and feature is not null").groupBy("hospital_id", "feature").agg(F.sum("k").alias("tokens"), F.count("*").alias("n"))
    return rows.groupBy("hospital_id").agg(F.sum("tokens").alias("tokens"), F.to_json(F.array_sort(F.collect_list(F.struct("feature", "tokens", "n")))).alias("by_feature"))


@query("BIL-10", f"""with {USAGE}, runs as (select run_id, case when bool_or(event_type = 'view') then 'case_blog' when bool_or(event_type = 'error') then 'health_report' end as product from usage group by all)
  select event_id, case when event_id % 5 = 0 then 'kept' when feature like 'blog%' then 'case_blog' when feature = 'health_report' then 'health_report' when feature = 'admin_extract' then r.product when feature like '%alimtalk%' then case when u.run_id is not null then 'health_report' else 'survey' end end as product_code
  from usage u left join runs r using (run_id)""")  # fmt: skip
def backfilled(spark, sf):
    rows = usage(spark, sf)
    runs = rows.groupBy("run_id").agg(F.bool_or(F.col("event_type") == "view").alias("has_blog"), F.bool_or(F.col("event_type") == "error").alias("has_report"))
    entries = rows.select("event_id", "run_id", "feature", F.when(F.col("event_id") % 5 == 0, "kept").alias("product_code"))
    return billing.backfilled_products(entries, runs).select("event_id", "product_code")


BOOK_ROWS = 1000


def _in_books(rows: DataFrame, n: str) -> DataFrame:
    """rows with file (a workbook for each BOOK_ROWS of n), and row_no from 1 within it; n is gapless, from 0."""
    return rows.withColumns({"file": F.format_string("book%06d.xlsx", (F.col(n) / BOOK_ROWS).cast("long")), "row_no": (F.col(n) % BOOK_ROWS + 1).cast("int")})


def _sheet(rows: DataFrame, name: str, row_no, cells: list, sheet: int = 0) -> DataFrame:
    return rows.select("file", F.lit(sheet).alias("sheet"), F.lit(name).alias("sheet_name"), row_no.cast("int").alias("row_no"), F.array(*cells).alias("cells"))


@query("SRC-01-workbook", "select o_orderdate::date as service_date, o_orderkey::varchar as customer_no, 'n ' || o_custkey as customer_name, 'p' || o_orderkey % 3 as patient_name, 'R-' || o_orderkey as receipt_no, o_totalprice::decimal(18,2) as amount from orders")
def intovet_workbooks(spark, sf):
    """All orders as workbooks with two header rows, of which the upper is merged, dates as dates, and a row of totals at the end;
    in every other one the amount stands a column further right."""
    rows = _in_books(table(spark, sf, "orders"), "o_orderkey")
    cell, empty = workbooks.cell, workbooks.cell(F.lit(""))
    odd = F.crc32("file") % 2 == 1
    amount = cell(F.col("o_totalprice").cast(MONEY), "number")
    of = lambda c: workbooks.cell(c)
    data = _sheet(rows, "매출", F.col("row_no") + 2, [
        cell(F.col("o_orderdate"), "date"), cell(F.col("o_orderkey"), "number"), of(F.concat(F.lit(" n  "), "o_custkey")), of(F.concat(F.lit("p"), F.col("o_orderkey") % 3)), empty, of(F.concat(F.lit("R-"), "o_orderkey")),
        cell(F.lit("1"), "number"), F.when(odd, cell(F.lit("3"), "number")).otherwise(amount), F.when(odd, amount).otherwise(empty)])
    books = rows.groupBy("file").agg(F.sum("o_totalprice").cast(MONEY).alias("total"), F.max("row_no").alias("last"))
    texts = lambda *names: [of(F.lit(n)) if isinstance(n, str) else of(n) for n in names]
    upper = _sheet(books, "매출", F.lit(1), texts("날짜", "번호", "고객", "환자", "", "영수증", "청구금액", "", ""))
    lower = _sheet(books, "매출", F.lit(2), texts("", "", "", "", "", "", "수량", F.when(odd, "할인").otherwise("합계"), F.when(odd, "합계").otherwise("")))
    totals = _sheet(books, "매출", F.col("last") + 3, [*[empty] * 7, *[cell(F.col("total"), "number")] * 2])
    other = _sheet(books, "비고", F.lit(1), texts("다른 시트"), 1)
    files = workbooks.packed(upper.union(lower).union(data).union(totals).union(other))
    return workbooks.intovet(workbooks.rows(files)).drop("file", "row_no")


@query("SRC-04-workbook", "select o_orderdate::date as service_date, o_orderkey::varchar as customer_no, 'Kim \"' || o_custkey || '\" & <A>' as customer_name, '진료' as treatment, o_totalprice::decimal(18,2) as amount from orders")
def woorien_workbooks(spark, sf):
    rows = _in_books(table(spark, sf, "orders"), "o_orderkey")
    of, empty = workbooks.cell, workbooks.cell(F.lit(""))
    cells = [of(F.date_format("o_orderdate", "yyyy/M/d")), of(F.col("o_orderkey"), "number"), of(F.concat(F.lit('Kim "'), F.col("o_custkey").cast("string"), F.lit('" & <A>'))), of(F.lit("p")), empty, of(F.lit("진료")), *[empty] * 5, of(F.format_number(F.col("o_totalprice").cast(MONEY), 2))]
    books = rows.groupBy("file").agg(F.max("row_no").alias("last"))
    head = _sheet(books, "s", F.lit(1), [of(F.lit(f"c{i}")) for i in range(12)])
    totals = _sheet(books, "s", F.col("last") + 2, [*[empty] * 11, of(F.lit("9,999.00"))])
    files = workbooks.packed(head.union(_sheet(rows, "s", F.col("row_no") + 1, cells)).union(totals))
    return workbooks.woorien(workbooks.rows(files)).select("service_date", "customer_no", "customer_name", "treatment", "amount")


@query("SRC-08", """with d as (select l_shipdate::date as day, count(*) as n, count(distinct l_partkey) as m from lineitem group by all),
  a as (select l_shipdate::date as day, 'camp' || l_partkey % 20 as campaign, case when l_linenumber % 3 = 0 then '' else 'group' || l_suppkey % 5 end as adgroup, sum(l_quantity)::bigint as shown, count(*) as clicked, sum(l_extendedprice)::decimal(18,2) as cost from lineitem group by all)
  select 'blog' as part, day, null as campaign, null as adgroup, n as one, m as two, null::double as cost from d union all select 'place', day, null, null, m, null, null from d
  union all select 'powerlink', day, campaign, adgroup, shown, clicked, cost::double from a union all select 'placead', day, campaign, adgroup, clicked, 0, 0.0 from a""")  # fmt: skip
def dashboard_workbooks(spark, sf):
    """A dashboard's four sheets from all lines, a workbook a year of days, with rows of no date, no campaign and no number."""
    lines = table(spark, sf, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    of, file = workbooks.cell, F.concat(F.lit("board"), F.year("day")).alias("file")
    place = lambda *by: F.row_number().over(Window.partitionBy("file").orderBy(*by)) + 1
    days = lines.groupBy("day").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("m")).select("*", file).withColumn("k", place("day"))
    ads = lines.groupBy("day", F.concat(F.lit("camp"), F.col("l_partkey") % 20).alias("campaign"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("group"), F.col("l_suppkey") % 5)).alias("adgroup")).agg(
        F.sum("l_quantity").cast("long").alias("shown"), F.count("*").alias("clicked"), F.sum("l_extendedprice").cast(MONEY).alias("cost")).select("*", file).withColumn("k", place("day", "campaign", "adgroup"))
    ends = ads.groupBy("file").agg(F.max("k").alias("last"))
    dots, number = of(F.concat(F.date_format("day", "yyyy.MM.dd"), F.lit("."))), lambda c: of(F.col(c), "number")
    names = [of(F.lit("")), of(F.col("campaign")), of(F.col("adgroup"))]
    sheets = [
        _sheet(days, "블로그", F.col("k"), [dots, number("n"), number("m")], 0), _sheet(days, "플레이스", F.col("k"), [of(F.col("day"), "date"), number("m")], 1),
        _sheet(ads, "파워링크광고", F.col("k"), [*names, of(F.col("day"), "date"), number("shown"), number("clicked"), of(F.lit("1.5")), of(F.lit("-")), number("cost")], 2),
        _sheet(ads, "플레이스광고", F.col("k"), [*names, dots, number("clicked"), of(F.lit("없음"))], 3),
        *(_sheet(ends, n, F.lit(1), [of(F.lit("머리글"))] * 4, i) for i, n in enumerate(["블로그", "플레이스", "파워링크광고", "플레이스광고"])),
        _sheet(ends, "파워링크광고", F.col("last") + 1, [of(F.lit("합계")), of(F.lit("x")), of(F.lit("y")), of(F.lit("합계"))], 2), _sheet(ends, "플레이스광고", F.col("last") + 5, [of(F.lit("")), of(F.lit(" ")), of(F.lit("")), of(F.lit("2024-01-01"))], 3),
    ]
    whole = sheets[0]
    for s in sheets[1:]:
        whole = whole.union(s)
    found = workbooks.dashboard(workbooks.rows(workbooks.packed(whole)), "h", "a", "c")
    null = lambda kind: F.lit(None).cast(kind)
    daily = lambda n, one, two: found[n].select(F.lit(n).alias("part"), F.col("metric_date").alias("day"), null("string").alias("campaign"), null("string").alias("adgroup"), F.col(one).alias("one"), two.alias("two"), null("double").alias("cost"))
    ad = lambda n: found[n].select(F.lit(n).alias("part"), F.col("metric_date").alias("day"), F.col("campaign_name").alias("campaign"), F.col("adgroup_name").alias("adgroup"), F.col("impressions").alias("one"), F.col("clicks").alias("two"), "cost")
    return daily("blog", "blog_views", F.col("blog_unique_visitors")).union(daily("place", "smartplace_inflow", null("long"))).union(ad("powerlink")).union(ad("placead"))


@query("SNK-09-workbook", f"with {RANKS} select metric_date, keyword, coalesce(min(rank_value) filter (where section = 'blog') || '위', '—') as blog, coalesce(min(rank_value) filter (where section = 'place') || '위', '—') as place from ranks group by all")
def wide_rank_workbooks(spark, sf):
    """The export as workbooks, one a month, read back."""
    rows = readers.wide_ranks(ranks(spark, sf), ["blog", "place"]).withColumn("file", F.date_format("metric_date", "yyyy-MM"))
    k = F.row_number().over(Window.partitionBy("file").orderBy("metric_date", "keyword"))
    of = workbooks.cell
    files = workbooks.packed(_sheet(rows, "순위", k, [of(F.col("metric_date"), "date"), of(F.col("keyword")), of(F.col("blog")), of(F.col("place"))]))
    return workbooks.rows(files).select(F.get("cells", F.lit(0)).cast("date").alias("metric_date"), *(F.get("cells", F.lit(i)).alias(n) for i, n in ((1, "keyword"), (2, "blog"), (3, "place"))))


@query("SNK-01-buckets", """with old as (select o_orderkey as k, o_totalprice as v from orders), new as (select o_orderkey as k, o_totalprice + 1 as v from orders where o_orderkey % 2 = 0)
  select k, v from new where k % 7 <> 0 union all select k, v from old where k % 2 = 1 and k % 7 <> 0""")  # fmt: skip
def upserted_table(spark, sf):
    """A stored table after four batches: all orders, new versions of half of them, old versions that come late, and deletions."""
    kept = KeyedTable(folder(spark), ("k",), "version", deleted="gone", buckets=8, generations=2)
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    batch = lambda rows, version, gone=False: kept.apply(rows.select("k", "v", F.lit(version).alias("version"), F.lit(gone).alias("gone")))
    batch(orders, 1)
    batch(orders.where("k % 2 = 0").withColumn("v", F.col("v") + 1), 2)
    batch(orders.where("k % 3 = 0").withColumn("v", F.col("v") - 1), 0)
    batch(orders.where("k % 7 = 0"), 3, True)
    return kept.read(spark).select("k", "v")


@query("STM-02-stream", "with f as (select user_id, min(ts)::date as day from events group by all) select day, count(*) as first_visits from f group by all")
def late_visits_of_a_stream(spark, sf):
    """First days of customers kept by a stream of three uploads, of which the earliest visits come last."""
    path = folder(spark)
    visits = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), F.datediff(F.lit("2100-01-01").cast("date"), F.to_date("ts")).alias("age"))
    for third in (2, 1, 0):
        visits.where(F.dayofmonth("day") % 3 == third).write.mode("append").parquet(f"{path}/in")
    kept = KeyedTable(f"{path}/table", ("user_id",), "age", buckets=8)
    kept.start(spark.readStream.schema(visits.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in"), f"{path}/checkpoint").awaitTermination()
    return kept.read(spark).groupBy("day").agg(F.count("*").alias("first_visits"))


@query("STM-07-deltas", f"""with {LEDGER}, now as (select * replace (case when run_id % 7 = 3 then amount + 1 else amount end as amount) from ledger where run_id % 5 <> 2)
  select hospital_id, date_trunc('month', service_date)::date as month, sum(amount)::decimal(18,2) as value, count(*) as n_rows, count(distinct customer || '|' || patient) as visits from now group by all""")  # fmt: skip
def months_of_changes(spark, sf):
    """Months after three batches: all lines but some that are late, deletions, and changed amounts with the late lines."""
    rows = ledger(spark, sf).select("hospital_id", "service_date", "amount", F.concat_ws("|", "customer", "patient").alias("visit"), "run_id")
    sums = MonthSums(folder(spark), ("hospital_id",), "service_date", "amount", "visit", buckets=8)
    signed = lambda df, sign: df.select("hospital_id", "service_date", "amount", "visit", F.lit(sign).alias("change"))
    late, gone, changed = (F.col("run_id") % n == k for n, k in ((11, 4), (5, 2), (7, 3)))
    sums.apply(signed(rows.where(~late), 1))
    sums.apply(signed(rows.where(gone & ~late), -1))
    changes = rows.where(~gone & ~late & changed)
    more = rows.where(~gone & late)
    new = lambda df: df.withColumn("amount", F.when(changed, F.col("amount") + 1).otherwise(F.col("amount")).cast(MONEY))
    sums.apply(signed(changes, -1).unionByName(signed(new(changes), 1)).unionByName(signed(new(more), 1)))
    return sums.read(spark)


#: Words of every document set in lines of eight, forty to a page, of which a page draws the left half of all lines first.
LAYER = r"""
w as (select doc_id, unnest(range(len(ws))) as i, unnest(ws) as word from (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents)),
items as (select doc_id, i // 320 as page, i // 8 % 40 as r, i % 8 as c, word, 100 * (i % 8) + least(5 * length(word), 100) as ends, 800 - 18 * (i // 8 % 40) as y from w),
drawn as (select *, row_number() over (partition by doc_id, page order by c // 4, r, c) as seq from items),
runs as (select *, sum(fresh) over (partition by doc_id, page order by seq) as run from (select *, case when y <> lag(y) over (partition by doc_id, page order by seq) then 1 else 0 end as fresh from drawn))"""
_GAP = "case when 100 * c - lag(ends) over (partition by doc_id, page, {g} order by c) > 3.5 then ' ' else '' end || word"


def _layer(spark, sf):
    """The items of LAYER. Texts are dealt by document before they are taken apart, so that items, which take many times the room, need
    not be dealt by page."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    dealt = table(spark, sf, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    rows = dealt.select("doc_id", F.posexplode(words).alias("i", "text"))
    line, c = F.floor(F.col("i") / 8), F.col("i") % 8
    rows = rows.withColumns({"page": F.floor(F.col("i") / 320), "c": c, "r": line % 40, "x": 100.0 * c, "width": F.least(5.0 * F.length("text"), F.lit(100.0)), "y": 800.0 - 18 * (line % 40), "size": F.lit(10.0)})
    return rows.withColumn("seq", F.floor(F.col("c") / 4) * 400 + F.col("r") * 8 + F.col("c"))


@query("SRC-20", f"""with {LAYER}, t as (select doc_id, page, run, y, c, {_GAP.format(g="run")} as piece from runs), l as (select doc_id, page, run, max(y) as y, string_agg(piece, '' order by c) as text from t group by all)
  select doc_id, page, row_number() over (partition by doc_id, page order by y desc, run)::int as line_no, text from l""")  # fmt: skip
def stream_lines(spark, sf):
    return textlayers.stream_lines(_layer(spark, sf))


@query("SRC-20-bands", f"""with {LAYER}, t as (select doc_id, page, y, c, {_GAP.format(g="y")} as piece from runs), l as (select doc_id, page, y, string_agg(piece, '' order by c) as text from t group by all)
  select doc_id, page, row_number() over (partition by doc_id, page order by y desc)::int as line_no, text from l""")  # fmt: skip
def band_lines(spark, sf):
    """Heights are off by less than a half, to either side, as they are where fonts differ."""
    return textlayers.band_lines(_layer(spark, sf).withColumn("y", F.col("y") + (F.col("i") % 3 - 1) * 0.3))


@query("SRC-18", """select c_custkey, c_name, n_orders, spend, last_order from customer left join (select o_custkey, count(*) as n_orders, sum(o_totalprice::decimal(18,2))::decimal(18,2) as spend, max(o_orderdate)::date as last_order
  from orders where o_orderdate >= date '1998-08-01' - 400 group by o_custkey) on o_custkey = c_custkey""")  # fmt: skip
def scanned(spark, sf):
    """A statement with a parameter over tables by name, as a dashboard sends it."""
    statement = """select c_custkey, c_name, n_orders, spend, last_order from {customers} left join (select o_custkey, count(*) as n_orders, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(18,2)) as spend, cast(max(o_orderdate) as date) as last_order
      from {orders} where o_orderdate >= date_sub(:today, :days) group by o_custkey) on o_custkey = c_custkey"""
    return scans.statement(spark, statement, {"customers": table(spark, sf, "customer"), "orders": table(spark, sf, "orders")}, today=date(1998, 8, 1), days=400)
