"""Queries that apply the remaining string, date, number and array expressions, with cases that must fail among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import dates, numbers, redaction, text
from tidewell.operators import labs, rubric
from tidewell.plans.fixtures import table
from tidewell.plans.registry import query


def _cases(spark, sf, cases: list[str | None]):
    """Every customer with one of some texts, in turn, in column c."""
    one = F.element_at(F.array(*(F.lit(c).cast("string") for c in cases)), (F.col("c_custkey") % len(cases) + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", one.alias("c"))


def _told(values: list, kind: str = "varchar") -> str:
    """SQL for the value told for each of the texts."""
    shown = ", ".join("null" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"select c_custkey, ([{shown}])[(c_custkey % {len(values)} + 1)::int]::{kind} as v from customer"


def _query(name: str, cases: dict, f, kind: str = "varchar") -> None:
    """Register a query of an expression f on texts, whose values are told."""

    @query(name, _told(list(cases.values()), kind))
    def run(spark, sf):
        return _cases(spark, sf, list(cases)).select("c_custkey", f(F.col("c")).alias("v"))


def today():
    return F.lit("2024-03-10").cast("date")


_query("STR-01", {" a \t b  c　": "a b c", "": "", None: None, "x": "x"}, text.normalize_text)
_query("STR-03", {"  Kim 　 LEE ": "kim lee", None: "", "A\tb": "a b"}, text.normalize_owner_name)
_query("STR-09", {"# Title\nSome **bold** ![x](y.png) text": 17, "<p>ab c</p>": 3, "": 0, "## 가 나": 2}, text.visible_chars, "bigint")
_query("STR-10", {"한국 동물 병원": True, "동물병원": True, "동 물": False, None: None}, lambda c: text.includes_loosely(c, F.lit("동물 병원")), "boolean")
_query("STR-11", {"서울시 강남구 역삼동": "강남", "경기도 가평군": "가평", "부산시 중구": "중구", "제주시": "제주", "강원도": "강원도"}, text.region_token)
_query("STR-13", {"https://blog.example.com/My_Id/22": "my_id", "  SomeId ": "someid", "https://m.blog.example.com/abc": "abc"}, text.blog_id)
_query("STR-14", {"https://x.com/place/123/home": "123", "https://m.x.com/hospital/77?a=1": "77", "https://x.com/?id=5": "5", "https://x.com/": None}, text.place_id)
_query("STR-15", {" A&amp;B  동물\t병원 ": "A B 동물 병원", None: "", "a&b": "a b"}, text.store_name)
_query("STR-16", {"ΑΒΕ": "ABE", "αβειηκμνορτυχ": "abeinkmnoptux", "АВЕКМНОРСТУХавекмнорстух": "ABEKMHOPCTYXabekmhopctyx", "Glu": "Glu"}, text.fold_lookalikes)
_query("STR-17", {"병원": "병원은", "고양이": "고양이는", "cat": "cat는", "값": "값은"}, lambda c: text.with_particle(c, "은", "는"))
_query("STR-18", {"mail a.b@c.co now": "mail [redacted:email] now", "call 010-1234-5678": "call [redacted:phone]", "id 900101-1234567": "id [redacted:rrn]", "02-123-4567": "[redacted:phone]", "plain 12": "plain 12", "x" * 501: "x" * 500 + "…(501자)"}, text.redact)
_query("STR-18-fields", {"Card-Number": "[redacted]", "user_password2": "[redacted]", "name": "[redacted]", "Patient Name": "[redacted]", "phone_number": "[redacted]", "renamed": "say [redacted:email]", "noted": "say [redacted:email]"}, lambda c: F.element_at(text.redact_fields(F.create_map(c, F.lit("say a@b.co"))), c))
_query("STR-05", {"Kim ,Lee , (a ,b)": "Kim, Lee|a ,b", "Kim(a, b(2),)": "Kim(a, b|2),", "[RETAIL SALES]": "[RETAIL SALES]|", "Kim (x": "Kim (x|", "  Kim,": "Kim|", None: "|", "a)b(": "a)b(|"}, lambda c: F.concat_ws("|", text.split_owner_patients(c)["owner"], text.split_owner_patients(c)["patients"]))
_query("FLT-09-escaping", {"all 100% sure": True, "all 1000 sure": False, "ALL 100% SURE": True, "100_": False}, lambda c: text.matches_literally(c, "L 100%"), "boolean")
_query("DAT-02", {"2024-3-9": "2024-03-09", "2024-02-30": None, "x": None, "2024-12-31 10:00": "2024-12-31"}, dates.parse_mixed_date, "date")
_query(
    "DAT-03",
    {"2024-03-09T16:00:00Z": "2024-03-10", "2024.3.9": "2024-03-09", "24.3.9.토": "2024-03-09", "3.11": "2024-03-11", "3.12.화": "2023-03-12", "오늘 방문": "2024-03-10", "어제": "2024-03-09", "그저께": "2024-03-08", "3일전": "2024-03-07", "2 주 전": "2024-02-25", "soon": None, None: None},
    lambda c: dates.parse_review_date(c, today()), "date",
)
_query("DAT-11", {"2024-02-29 x": "2024-02-29", "2023-02-29": None, "20240131": "2024-01-31", "abc": None}, dates.leading_iso_date, "date")
_query("DAT-12", {"7Y 2M": "2017-01-01", "1OY": "2014-01-01", "5M": "2023-01-01", "old": None}, lambda c: dates.birth_from_age(c, today()), "date")
_query("DAT-14", {"2024-03-09": "2024년 3월 9일", "2023-12-31": "2023년 12월 31일"}, lambda c: dates.korean_date(c.cast("date")))
_query("DAT-15", {"2024-01-31 20:00:00": "2024-02", "2024-01-31 10:00:00": "2024-01"}, lambda c: F.date_format(F.from_utc_timestamp(c, dates.SEOUL), "yyyy-MM"))
_query("DAT-16", {"2024-03-01": 9, "2024-03-10": 0, "2024-03-12": 0}, lambda c: dates.stale_days(c.cast("date"), today()), "int")
_query("DAT-16-left", {"2024-03-11 00:00:01": 2, "2024-03-10 00:00:00": 0, "2024-03-09 23:00:00": 0}, lambda c: dates.days_left(c.cast("timestamp"), F.lit("2024-03-10 00:00:00").cast("timestamp")), "int")
_query("DAT-17", {"10|0|": True, "10|1|": False, "9||": False, "10||2024-03-10 10:05:00": False, "10||2024-03-10 09:59:00": True}, lambda c: dates.is_due(F.split(c, "[|]")[0].try_cast("int"), F.split(c, "[|]")[1].try_cast("int"), F.split(c, "[|]")[2].try_cast("timestamp"), F.lit("2024-03-10 10:30:00").cast("timestamp")), "boolean")
_query("DAT-10", {"2024-03-08": "2024-03-09|2024-03-10", "2024-03-10": None, None: "2024-03-04|2024-03-10"}, lambda c: (lambda r: F.when(r.isNotNull(), F.concat_ws("|", r["start"], r["end"])))(dates.next_range(c.cast("date"), today(), 7)))
_query("MTH-02", {"< 10": "10|true", "1,234": "1234|false", "x": "|false"}, lambda c: F.concat(F.coalesce(numbers.parse_count(c)["value"].cast("string"), F.lit("")), F.lit("|"), numbers.parse_count(c)["under10"].cast("string")))
_query("MTH-09", {"0": None, "7": "2|4", "9": "2.5|4", "100": "25|4", "110": "20|6"}, lambda c: (lambda a: F.when(a["step"].isNotNull(), F.concat_ws("|", F.format_string("%s", F.regexp_replace(a["step"].cast("string"), r"\.0$", "")), a["ticks"].cast("string"))))(numbers.nice_axis(c.cast("int"))))
_query("MTH-10", {"5": 5, "-3": 1, "900": 200}, lambda c: numbers.clamp(c.cast("double"), 1.0, 200.0), "double")
_query("MTH-05", {"gpt-x-mini-2024": 0.0011, "gpt-x-2024": 0.011, "other": 0.0}, lambda c: numbers.llm_cost(numbers.price_of(c, {"gpt-x": ("1.0", "0.5", "10.0"), "gpt-x-mini": ("0.1", "0.05", "1.0")}), (F.lit(2000), F.lit(2000), F.lit(600), F.lit(400))).cast("double"), "double")
_query("MTH-06", {"sms": 0.008, "alimtalk": 0.0, "none": 0.0}, lambda c: numbers.unit_cost(c, {"sms": "0.004"}, F.lit(2)).cast("double"), "double")


@query("STR-18-nested", """with e as (select *, '010-' || lpad((event_id % 10000)::varchar, 4, '0') || '-' || lpad((user_id % 10000)::varchar, 4, '0') as phone, (props->>'$.k')::int as k from events),
  told as (select event_id, '{"a":' || props || ',"list":[' || list_aggregate(list_transform(range(k), lambda i: case when i < 20 then i::varchar when i = 20 then '"…외 ' || (k - 20) || '개"' end), 'string_agg', ',') || '],"nest":{"PhoneNo":"call [redacted:phone] or [redacted:email]","deep":{"b":{"c":"[redacted:depth]","d":null},"user_name":"[redacted]"}},"noted":' || case when event_id % 3 = 0 then 'null' else event_id::varchar end || ',"type":"' || event_type || '"}' as payload from e where k > 0
    union all select event_id, '{"a":' || props || ',"list":[],"nest":{"PhoneNo":"call [redacted:phone] or [redacted:email]","deep":{"b":{"c":"[redacted:depth]","d":null},"user_name":"[redacted]"}},"noted":' || case when event_id % 3 = 0 then 'null' else event_id::varchar end || ',"type":"' || event_type || '"}' from e where k = 0)
  select event_id, replace(payload, '{"k": ', '{"k":') as payload from told""")  # fmt: skip
def nested_payloads(spark, sf):
    """Payloads of four levels built from each event, with its own phone number, and a list as long as its k."""
    k = F.get_json_object("props", "$.k").cast("int")
    phone = F.concat(F.lit("010-"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.col("user_id") % 10000).cast("string"), 4, "0"))
    items = F.array_join(F.transform(F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>")), lambda i: i.cast("string")), ",")
    made = F.concat(
        F.lit('{"type":"'), "event_type", F.lit('","noted":'), F.when(F.col("event_id") % 3 == 0, "null").otherwise(F.col("event_id").cast("string")), F.lit(',"nest":{"PhoneNo":"call '), phone, F.lit(' or a.b@c.co","deep":{"user_name":"'), phone,
        F.lit('","b":{"c":"x","d":null}}},"a":'), "props", F.lit(',"list":['), items, F.lit("]}"))
    return table(spark, sf, "events").select("event_id", redaction.redact_json(made).alias("payload"))


shown = lambda *cs: F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cs))
_query("LAB-05-gas", {"Na+": "Na-BG", "hct": "HCT-BG", "iCa": "Ca-BG", "pH": None, "": None}, labs.blood_gas_name)
_query("LAB-07", {"<5": "|5.0", ">100": "100.0|", "1,5 - 2,5": "1.5|2.5", "x": "|"}, lambda c: shown(*labs.open_range(c)))
_query("LAB-08", {"L": "low", "result High": "high", "Negative": "normal", "Positive": "high", "12.3": "unknown"}, labs.flag_of_text)
_query("TXT-04", {"- Amoxicillin 2 tab x 7 days": "Amoxicillin|2.0|7", "rest": "rest||", "혈액검사 1개": "혈액검사|1.0|", " ": None}, lambda c: (lambda p: F.when(p.isNotNull(), shown(p["item"], p["quantity"], p["days"])))(labs.plan_line(c)))
_query(
    "TXT-05", {"ALT 120 H U/L 10 - 100": "ALT|120|U/L|10 - 100|high", "Glucose 95 mg/dL 70-110": "Glucose|95|mg/dL|70-110|", "WBC <0.5 L 10^9/L 5.0 ~ 16.0": "WBC|<0.5|10^9/L|5.0 ~ 16.0|low", "Page 1 of": None, "": None},
    lambda c: (lambda p: F.when(p.isNotNull(), shown(p["item"], p["value"], p["unit"], p["reference"], p["told"])))(labs.lab_line(c)),
)
_query("TXT-07", {"2024.3.9 DHPPL 2차": "2024-03-09|DHPPL|2", "2024-03-09 Rabies": "2024-03-09|Rabies|", "no date": None}, lambda c: (lambda p: F.when(p.isNotNull(), shown(p["given_on"], p["name"], p["dose"])))(labs.vaccination_line(c)))
_query("TXT-08", {"BW: 4.2 kg, HR 120": "4.2|120.0", "체온 38.5": "|", "AHR 9": "|"}, lambda c: shown(F.try_element_at(labs.vital_line(c), F.lit("weight")), F.try_element_at(labs.vital_line(c), F.lit("heart_rate"))))
_query("TXT-11", {"-|1|": "NEG|normal", "-|0|1-2": "|unknown", "norm|0|1-2": "정상|high", "5|0|": "5|unknown", "|0|1-2": "|high"}, lambda c: (lambda p: shown(*labs.finished(p[0], p[2], p[1] == "1", F.when((p[0] == "-") & (p[1] == "0"), "unknown").otherwise("high"))))(F.split(c, "[|]")))
_query("QLT-02", {"1|0|1": "red|red", "0|1|1": "yellow|yellow", "0|0|1": "yellow|green", "0|0|0": "green|green"}, lambda c: (lambda p: shown(rubric.medical_light(p[0], p[1], p[2]), rubric.seo_light(p[0], p[1], F.lit(0), F.lit(0))))(F.transform(F.split(c, "[|]"), lambda x: x.cast("int"))))


@query("LAB-05", "select p_partkey % 40 as panel, bool_or(p_partkey % 2 = 0 and p_size > 10) and bool_or(p_size > 25) as is_urine from part group by all")
def urine_panels(spark, sf):
    line = F.when(F.col("p_size") > 25, "nitrite neg").when(F.lit(False), "x").otherwise("ALT 10")
    both = F.concat(line, F.when((F.col("p_partkey") % 2 == 0) & (F.col("p_size") > 10), F.lit(" Leu/uL 3")).otherwise(F.lit("")))
    return labs.looks_like_urine(table(spark, sf, "part").select((F.col("p_partkey") % 40).alias("panel"), both.alias("text")), ["panel"])


@query("LAB-01", "select p_partkey, case when p_partkey % 3 = 2 then 'Other' else 'ALT' end as canonical, p_partkey % 3 <> 2 as recognized from part")
def canonical_items(spark, sf):
    name = F.element_at(F.array(F.lit("ΑLΤ"), F.lit("s.g.p.t"), F.lit("Other")), (F.col("p_partkey") % 3 + 1).cast("int"))
    aliases = spark.createDataFrame([("ALT", "ALT"), ("SGPT", "ALT")], "alias string, canonical string")
    return labs.canonical(table(spark, sf, "part").select("p_partkey", name.alias("item_name")), aliases).select("p_partkey", "canonical", "recognized")


@query("LAB-02", "select p_partkey % 3 as kind, count(*) as n from part where p_partkey % 3 <> 2 group by all")
def recognized_items(spark, sf):
    name = F.element_at(F.array(F.lit("alt"), F.lit("s.g.p.t"), F.lit("unheard of")), (F.col("p_partkey") % 3 + 1).cast("int"))
    aliases = spark.createDataFrame([("ALT", "ALT"), ("SGPT", "ALT")], "alias string, canonical string")
    named = labs.canonical(table(spark, sf, "part").select("p_partkey", name.alias("item_name")), aliases)
    return named.where("recognized").groupBy((F.col("p_partkey") % 3).alias("kind")).agg(F.count("*").alias("n"))


@query("TXT-12", "select o_orderkey % 10 as run_id, o_orderkey, case when o_orderkey % 10 = 3 then 'new' else 'old' end as load from orders where o_orderkey % 10 <> 3 or o_orderkey % 20 = 3")
def replaced_results(spark, sf):
    from tidewell.operators.ledger import upserted

    rows = table(spark, sf, "orders").select((F.col("o_orderkey") % 10).alias("run_id"), "o_orderkey", F.lit("old").alias("load"))
    return upserted(rows, rows.where("o_orderkey % 20 = 3").withColumn("load", F.lit("new")), ["run_id"])


@query("STR-06", "select c_custkey, concat_ws('|', case when c_custkey % 3 = 0 then null else c_name end, c_mktsegment) as v from customer")
def joined_texts(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.concat_ws("|", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")), "c_mktsegment").alias("v"))


@query("STR-07", "select o_orderkey, year(o_orderdate) || '-' || lpad((o_orderkey % 20000)::varchar, 4, '0') as order_no from orders")
def order_numbers(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.order_number(F.to_date("o_orderdate"), F.col("o_orderkey") % 20000).alias("order_no"))


@query("STR-12", """select p_partkey, case when p_partkey % 4 = 0 then '강아지' when p_partkey % 4 = 1 then '고양이' else '반려동물' end as word, case when p_partkey % 4 = 0 then 'canine' when p_partkey % 4 = 1 then 'feline' end as profile from part""")
def species(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, (" Canine ", "고양이(DSH)", "parrot", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", text.species_word(raw).alias("word"), text.species_profile(raw).alias("profile"))


@query("DAT-05", "select o_orderkey, (o_orderdate::date + 10)::date as later, strftime(o_orderdate - interval 2 month, '%Y-%m') as month from orders")
def shifted(spark, sf):
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.date_add(day, 10).alias("later"), F.date_format(F.add_months(day, -2), "yyyy-MM").alias("month"))


@query("DAT-06", "select o_orderkey, date_trunc('week', o_orderdate)::date as week, (date_trunc('month', o_orderdate) + interval 1 month)::date as next_month from orders")
def truncated(spark, sf):
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", dates.bucket(day, "week").alias("week"), F.add_months(dates.bucket(day, "month"), 1).alias("next_month"))


@query("DAT-07", "select isodow(o_orderdate)::int - 1 as weekday, count(*) as n from orders group by all")
def weekdays(spark, sf):
    return table(spark, sf, "orders").groupBy(F.weekday(F.to_date("o_orderdate")).alias("weekday")).agg(F.count("*").alias("n"))


@query("DAT-09", "select o_custkey, unnest(generate_series(a, z, interval 1 day))::date as day from (select o_custkey, min(o_orderdate)::date as a, (min(o_orderdate)::date + (o_custkey % 4)::int) as z from orders group by o_custkey)")
def spines(spark, sf):
    first = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("a"))
    return first.select("o_custkey", F.explode(dates.spine(F.col("a"), F.date_add("a", (F.col("o_custkey") % 4).cast("int")))).alias("day"))


@query("DAT-13", "select o_orderkey, case when o_orderdate::date <= date '1995-06-01' then ceil((date '1995-06-01' - o_orderdate::date) / 365.25::double)::int end as age from orders")
def all_ages(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.age_years(F.to_date("o_orderdate"), F.lit("1995-06-01").cast("date")).alias("age"))


@query("DAT-18", "select o_orderkey, (o_orderdate::date + interval 1 month)::date as ends from orders")
def next_period(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.add_months(F.to_date("o_orderdate"), 1).alias("ends"))


@query("DAT-19", "select o_orderkey, age from (select o_orderkey, case when o_orderkey % 3 = 0 then null else (o_orderkey % 9)::int end as old, ceil((date '2001-01-01' - o_orderdate::date) / 365.25::double)::int as age from orders where o_orderdate <= date '2001-01-01') where age is distinct from old")
def refreshed_ages(spark, sf):
    rows = table(spark, sf, "orders").withColumn("old", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 9).cast("int"))
    return dates.changed(rows.where("o_orderdate <= date'2001-01-01'"), "old", dates.age_years(F.to_date("o_orderdate"), F.lit("2001-01-01").cast("date")), "age").select("o_orderkey", "age")


@query("MTH-03", "select l_partkey, case when sum(l_quantity) <> 0 then sum(l_linenumber)::double * 100 / sum(l_quantity) end as ctr, case when sum(l_linenumber) <> 0 then sum(l_quantity) / sum(l_linenumber) end as cpc from lineitem group by l_partkey")
def ratios(spark, sf):
    made = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_linenumber").alias("clicks"), F.sum("l_quantity").alias("shown"))
    return made.select("l_partkey", numbers.ratio(F.col("clicks"), F.col("shown"), 100.0).alias("ctr"), numbers.ratio(F.col("shown"), F.col("clicks")).alias("cpc"))


@query("MTH-04", r"select doc_id, case when n > 0 then round(k * 2 * 100 / n::double, 1) else 0 end as density from (select doc_id, length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) as n, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'th', ''))) // 2 as k from documents)")
def densities(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.keyword_density(F.col("text"), F.lit("th")).alias("density"))


@query("MTH-07", "select event_id, (case when event_id % 3 = 0 then ceil(value::decimal(18,2)) * 30 when event_id % 3 = 1 then ceil(ceil(value::decimal(18,2)) * 0.8) else ceil(value::decimal(18,2)) end)::bigint as tokens from events")
def token_counts(spark, sf):
    from tidewell.operators.billing import tokens

    feature = F.element_at(F.array(F.lit("blog-write"), F.lit("health_report"), F.lit("x")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", tokens((F.col("value").cast("decimal(18,2)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,4)"), feature).alias("tokens"))


@query("ARR-02", "select p_partkey, list_sort(list_distinct([p_brand, p_type, p_brand, 'x'])) as v from part")
def merged(spark, sf):
    return table(spark, sf, "part").select("p_partkey", numbers.merged_set(F.array("p_brand", "p_type"), F.array("p_brand", F.lit("x"))).alias("v"))


@query("ARR-03", "select p_partkey, w from (select p_partkey, unnest(string_split(p_name, ' ')) as w from part) where w <> ''")
def unnested(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w")).where("w <> ''")


@query("ARR-04", "select event_type, count(*) as n from events where event_type in ('click', 'view', 'none') group by all")
def members(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("click", "view", "none")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("JSN-02", "select event_id, json_object('kind', event_type, 'user', user_id)::varchar as v from events")
def built(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"))).alias("v"))


@query("JSN-03", "select conv_id, turn, role, i::int as i from conversations, unnest([0, 1]) as t(i) where i < length(role) % 3")
def flattened(spark, sf):
    blocks = F.to_json(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.struct(i.alias("i"), (i < F.length("role") % 3).alias("shown"))))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.inline(F.from_json(blocks, "array<struct<i int, shown boolean>>")))
    return rows.where("shown").drop("shown")


@query("NUL-01", "select o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') as a, least(nullif(o_custkey % 3, 0), 2) as b, greatest(nullif(o_custkey % 3, 0), 1) as c from orders")
def nulls(spark, sf):
    n = F.nullif(F.col("o_custkey") % 3, F.lit(0))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.lit("none")).alias("a"), F.least(n, F.lit(2)).alias("b"), F.greatest(n, F.lit(1)).alias("c"))


@query("CST-01", "select event_id, event_id::varchar as t, value::double as d, try_cast(substr(event_type, 1, 1) as int) as bad from events")
def casts(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("event_id").cast("string").alias("t"), F.col("value").cast("double").alias("d"), F.substring("event_type", 1, 1).try_cast("int").alias("bad"))
