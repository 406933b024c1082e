"""Queries on ordered lines and laboratory items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import numbers
from tidewell.operators import buckets, labs, lines
from tidewell.plans.fixtures import order_lines, table
from tidewell.plans.registry import query

TURNS = "turns as (select conv_id as doc_id, turn as line_no, max(text) as text from conversations group by all)"
HEADER = "case when line_no % 3 = 1 then 'day ' || (doc_id + line_no) % 4 end"
GROUPS = "last_value(h ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row)"


def _turns(spark, sf):
    return table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no")).agg(F.max("text").alias("text"))


def _header():
    return F.when(F.col("line_no") % 3 == 1, F.concat(F.lit("day "), (F.col("doc_id") + F.col("line_no")) % 4))


@query("TXT-01", f"with {TURNS}, t as (select *, {HEADER} as h from turns) select doc_id, line_no, text, coalesce({GROUPS}, 'basic') as section from t")
def sections(spark, sf):
    return lines.sections(_turns(spark, sf), _header(), "basic", "doc_id")


@query("TXT-02", f"with {TURNS}, t as (select *, {HEADER} as h from turns), g as (select doc_id, line_no, text, h, coalesce({GROUPS}, 'unknown') as group_key from t) select * exclude (h) from g where h is null")
def date_groups(spark, sf):
    return lines.date_groups(_turns(spark, sf), _header(), "doc_id")


@query("TXT-02-visits", f"""with {TURNS}, t0 as (select *, {HEADER} as k from turns), t as (select doc_id, line_no, text, k, case when k is not null then k || case when row_number() over (partition by doc_id, k order by line_no) > 1
    then ' (' || row_number() over (partition by doc_id, k order by line_no) || ')' else '' end end as h from t0), g as (select doc_id, line_no, text, h, coalesce({GROUPS}, 'unknown') as group_key from t) select * exclude (h) from g where h is null""")  # fmt: skip
def visits(spark, sf):
    return lines.visits(_turns(spark, sf), _header(), "doc_id")


@query("WIN-16", f"with {TURNS} select *, lead(text, 1) over w as next_1, lead(text, 2) over w as next_2 from turns window w as (partition by doc_id order by line_no)")
def lookahead(spark, sf):
    return lines.with_next(_turns(spark, sf), "doc_id")


@query("TXT-03", f"""with {TURNS}, t as (select *, min(line_no) filter (where line_no >= 2 and (doc_id + line_no) % 2 = 0) over (partition by doc_id) as s from turns)
  select doc_id, coalesce(string_agg(text, chr(10) order by line_no) filter (where s is null or line_no < s), '') as body_text, coalesce(string_agg(text, chr(10) order by line_no) filter (where line_no > s), '') as plan_text, bool_or(s is not null) as plan_detected from t group by all""")  # fmt: skip
def body_and_plan(spark, sf):
    return lines.body_and_plan(_turns(spark, sf), (F.col("line_no") >= 2) & ((F.col("doc_id") + F.col("line_no")) % 2 == 0), "doc_id")


@query("TXT-09", """with k as (select l_orderkey as doc_id, l_linenumber as line_no from lineitem where l_quantity > 15 group by all), g as (select *, line_no - row_number() over (partition by doc_id order by line_no) as run from k)
  select doc_id, min(line_no) as first_line, max(line_no) as last_line, count(*) as n_lines from g group by doc_id, run""")  # fmt: skip
def islands(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_quantity > 15").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no")).distinct()
    return lines.islands(rows, F.lit(True), "doc_id")


def items(spark, sf):
    """Items made of order lines; every third name lacks a letter or has one doubled."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as run_id", "l_linenumber as row_order", "concat(case when l_partkey % 3 = 0 then 'WBC-MONNO' when l_partkey % 3 = 1 then 'WBC-MONO' else 'HCT' end, '%') as item_name",
        "concat(case when l_suppkey % 5 = 0 then '>' when l_suppkey % 7 = 0 then '<' else '' end, cast(l_quantity as int)) as value_text",
        "case l_partkey % 4 when 0 then 'g/dl' when 1 then 'K/μL' when 2 then '10x9/l' else '-' end as unit",
        "case when l_suppkey % 6 = 0 then null else concat(l_partkey % 20, ' ~ ', 20 + l_partkey % 25) end as reference_range", "l_partkey % 3 <> 0 as recognized")


ITEMS = """items as (select l_orderkey as run_id, l_linenumber as row_order, case when l_partkey % 3 = 0 then 'WBC-MONNO' when l_partkey % 3 = 1 then 'WBC-MONO' else 'HCT' end || '%' as item_name,
  case when l_suppkey % 5 = 0 then '>' when l_suppkey % 7 = 0 then '<' else '' end || l_quantity::int as value_text,
  case l_partkey % 4 when 0 then 'g/dl' when 1 then 'K/μL' when 2 then '10x9/l' else '-' end as unit,
  case when l_suppkey % 6 = 0 then null else (l_partkey % 20) || ' ~ ' || (20 + l_partkey % 25) end as reference_range, l_partkey % 3 <> 0 as recognized,
  (l_partkey % 20)::double as low, (20 + l_partkey % 25)::double as high, l_quantity as v from lineitem)"""


@query("LAB-03", f"with {ITEMS} select run_id, row_order, unit, case unit when 'g/dl' then 'g/dL' when 'K/μL' then 'K/uL' when '10x9/l' then '10^9/L' end as shown from items")
def units(spark, sf):
    return items(spark, sf).select("run_id", "row_order", "unit", labs.unit(F.col("unit")).alias("shown"))


@query("LAB-06", f"""with {ITEMS} select run_id, row_order, value_text, reference_range, case when reference_range is null then 'unknown' when value_text like '>%' and v >= high then 'high'
  when value_text like '<%' and v <= low then 'low' when value_text like '<%' and v <= high and low <= 0 then 'normal' when v > high then 'high' when v < low then 'low' else 'normal' end as flag from items""")  # fmt: skip
def flags(spark, sf):
    return items(spark, sf).select("run_id", "row_order", "value_text", "reference_range", labs.flag(F.col("value_text"), F.col("reference_range")).alias("flag"))


@query("TXT-10", f"""with {ITEMS} select run_id, row_order, item_name, value_text, unit, reference_range, recognized from items a where recognized or not exists (select 1 from items b where b.run_id = a.run_id and b.recognized
  and b.value_text = a.value_text and b.unit = a.unit and levenshtein(regexp_replace(a.item_name, '[^A-Z0-9]', '', 'g'), regexp_replace(b.item_name, '[^A-Z0-9]', '', 'g')) <= 1)""")  # fmt: skip
def twins(spark, sf):
    return labs.without_twins(items(spark, sf), ["run_id"])


@query("TXT-06", f"with {ITEMS} select item_name, value_text, min(run_id * 100 + row_order) as first_row from items group by all")
def first_items(spark, sf):
    rows = items(spark, sf).select("item_name", "value_text", (F.col("run_id") * 100 + F.col("row_order")).alias("first_row"))
    return labs.first_of_each(rows, ["item_name", "value_text"], "first_row")


@query("MTH-08", f"with {ITEMS} select run_id, row_order, v, case when high > low then least(greatest((v - low) * 100 / (high - low), -10.0::double), 110.0::double) end as position from items")
def positions(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey as run_id", "l_linenumber as row_order", "l_quantity as v", "cast(l_partkey % 20 as double) as low", "cast(20 + l_partkey % 25 as double) as high")
    return rows.select("run_id", "row_order", "v", numbers.position_percent(F.col("v"), F.col("low"), F.col("high")).alias("position"))


@query("LAB-04", """select p_partkey, case p_size % 4 when 0 then 'cbc' when 1 then 'hormone' when 2 then 'urinalysis' else 'shoe' end as category, case p_size % 4 when 0 then 0 when 1 then 4 when 2 then 11 else 99 end as place from part""")
def categories(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey", "case p_size % 4 when 0 then 'cbc' when 1 then 'hormone' when 2 then 'urinalysis' else 'shoe' end as category")
    return rows.withColumn("place", labs.category_order(F.col("category")))


CHART_LINES = """
chart as (select o_custkey as doc_id, (row_number() over (partition by o_custkey order by l_orderkey, l_linenumber, l_partkey, l_suppkey))::int as line_no, l_partkey % 24 as k from lineitem join orders on o_orderkey = l_orderkey)"""
_TITLES = ["Name : x", "Check List", "SOAP History", "Laboratory Result", "▶ vaccination DHPPL", "Vital signs", "2024-03-09 10:20 visit", "x  Radiology Result"]


@query("TXT-01-buckets", f"""with recursive {CHART_LINES},
  seen as (
    select doc_id, line_no, k, 'basicInfo' as was from chart where line_no = 1
    union all
    select c.doc_id, c.line_no, c.k, case when s.was = 'basicInfo' and s.k not in (1, 2, 3, 6, 7) then 'basicInfo' when s.k = 1 or s.k = 5 then 'vitals' when s.k = 3 then 'lab' when s.k = 4 then 'vaccination'
        when s.was = 'basicInfo' then 'chartBody' when s.k = 2 and s.was in ('vitals', 'lab') or s.k = 6 and s.was in ('vaccination', 'lab') or s.k = 7 and s.was = 'lab' then 'chartBody' else s.was end
    from seen s join chart c on c.doc_id = s.doc_id and c.line_no = s.line_no + 1)
  select doc_id, line_no, case when was = 'basicInfo' and k not in (1, 2, 3, 6, 7) then 'basicInfo' when k in (3, 5) then null when k = 1 then 'vitals' when k = 4 then 'vaccination' when was = 'basicInfo' then 'chartBody'
      when k = 2 and was in ('vitals', 'lab') or k = 6 and was in ('vaccination', 'lab') or k = 7 and was = 'lab' then 'chartBody' else was end as bucket from seen""")  # fmt: skip
def chart_buckets(spark, sf):
    """Charts of one system, a line for each order line of a customer, a third of which are titles."""
    # Dealt once, to tasks of a number that is asked for: by their bytes few would be left, as keys take far less room than the lines made of them
    rows = order_lines(spark, sf).withColumnRenamed("o_custkey", "doc_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    k = (F.col("l_partkey") % 24).cast("int")
    text = F.when(k < len(_TITLES), F.get(F.array(*map(F.lit, _TITLES)), k)).otherwise(F.concat(F.lit("BUN "), (F.col("l_suppkey") % 90).cast("string"), F.lit(" mg/dL")))
    made = rows.withColumn("line_no", place).select("doc_id", "line_no", text.alias("text"))
    return buckets.assigned(made, "efriends", "doc_id").select("doc_id", "line_no", "bucket")


TABLE_LINES = """
sheet as (select o_custkey as doc_id, (row_number() over (partition by o_custkey order by l_orderkey, l_linenumber, l_partkey, l_suppkey))::int as n, l_partkey, l_quantity::int as q from lineitem join orders on o_orderkey = l_orderkey),
kinds as (select *, case when n // 20 % 3 = 0 and n % 20 between 5 and 11 then case when n % 20 = 8 then 'note' else 'test' end when n // 20 % 3 = 1 and n % 20 = 17 then 'head' when n // 20 % 3 = 1 and n % 20 = 4 then 'range' else 'prose' end as kind from sheet)"""
_TESTS = ["ALT", "Glucose GLU", "WBC", "T-Bil CREA"]


def _sheet(spark, sf):
    rows = order_lines(spark, sf)
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    rows = rows.select(F.col("o_custkey").alias("doc_id"), n.alias("n"), "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    at, part = F.col("n") % 20, F.floor(F.col("n") / 20) % 3
    name = F.get(F.array(*map(F.lit, _TESTS)), (F.col("l_partkey") % 4).cast("int"))
    told = F.when(F.col("q") > 40, "High").when(F.col("q") < 10, "Low").otherwise("Normal")
    test = F.concat_ws(" ", name, F.lit("mg/dL"), F.lit("10"), F.lit("40,5"), F.col("q").cast("string"), told)
    text = F.when((part == 0) & at.between(5, 11), F.when(at == 8, "Performed by machine 7").otherwise(test)).when((part == 1) & (at == 17), "Name Unit Min Max Result").when((part == 1) & (at == 4), "between 5 - 7").otherwise("we walked for hours")
    return rows.select("doc_id", F.col("n").alias("row_no"), text.alias("text"), name.alias("name"), "q", ((part == 0) & at.between(5, 11) & (at != 8)).alias("is_test"))


@query("TXT-09-blocks", f"""with {TABLE_LINES}, s as (select *, case kind when 'test' then 6 when 'range' then 3 when 'head' then 1 else 0 end as score, max(case when kind = 'head' then n end) over (partition by doc_id order by n) as header from kinds),
  c as (select *, score >= 2 or coalesce(n - header <= 20, false) as inside from s), k as (select *, sum((not inside and kind <> 'note')::int) over (partition by doc_id order by n) as others from c),
  b as (select *, sum(fresh) over (partition by doc_id order by n) as block from (select *, case when others - lag(others) over (partition by doc_id order by n) > 3 then 1 else 0 end as fresh from k where inside))
  select doc_id, min(n) as first_row, max(n) as last_row, (max(n) - min(n) + 1)::bigint as n_rows, sum(score + (kind = 'head')::int)::bigint as score from b group by doc_id, block
  having max(n) - min(n) >= 1 and sum(score + (kind = 'head')::int) >= 4 and max(score) >= 4""")  # fmt: skip
def table_blocks(spark, sf):
    """Tables planted among prose: rows of tests with a note among them, headers, and lone ranges."""
    return labs.table_blocks(_sheet(spark, sf), "doc_id")


@query("TXT-09-items", f"""with {TABLE_LINES} select doc_id, n as row_no, ['ALT', 'Glucose GLU', 'WBC', 'T-Bil CREA'][l_partkey % 4 + 1] as item, 'mg/dL' as unit, 10.0::double as low, 40.5::double as high, q::double as value, case when q > 40 then 'high' when q < 10 then 'low' else 'normal' end as told from kinds where kind = 'test'""")
def table_items(spark, sf):
    rows = _sheet(spark, sf).where("is_test")
    return rows.select("doc_id", "row_no", labs.layout_item(F.col("text")).alias("i")).select("doc_id", "row_no", "i.*")


@query("LAB-01-rules", """with n as (select p_partkey, p_partkey % 10 as b, p_partkey // 10 % 7 as d from part)
  select p_partkey, case when b < 6 then ['NEU', 'LYM', 'MONO', 'EOS', 'BASO', 'IMG'][b + 1] || case when d in (2, 3) then '(%)' else '' end when b = 6 then case when d % 2 = 0 then 'ALB/GLOB' else 'BUN/CREA' end
    when b = 7 then case when d % 3 = 0 then 'iCA(7.4)' when d % 3 = 1 then 'iCA' else 'Pre-ACTH' end when b = 8 then case when d % 2 = 0 then 'ALP' else 'cPL' end else 'XQ' || p_partkey end as canonical, b < 9 as recognized from n""")  # fmt: skip
def named_items(spark, sf):
    """Names of every part: kinds of cells in seven ways of writing, names that patterns tell, aliases, and unknown ones."""
    b, d = F.col("p_partkey") % 10, (F.floor(F.col("p_partkey") / 10) % 7).cast("int")
    of = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    base = of(["Neutrophils", "LYMPH", "ΜΟΝΟ", "eosin", "Baso", "IMG"], b)
    written = F.get(F.array(base, F.concat(base, F.lit("#")), F.concat(base, F.lit(" %")), F.concat(F.lit("WBC-"), base, F.lit("%")), F.concat(F.lit("ABS-"), base), F.concat(base, F.lit(" Count")), F.concat(F.lit(" "), base, F.lit(" (K/uL)"))), d)
    name = F.when(b < 6, written).when(b == 6, F.when(d % 2 == 0, "Albumin / Globulin ratio").otherwise("BUN/Cr")).when(b == 7, of(["Ca2+ (7.4)", "iCa++", "Cortisol (Pre)"], d % 3))
    name = name.when(b == 8, F.when(d % 2 == 0, "ALKP (IDEXX)").otherwise("Spec cPL")).otherwise(F.concat(F.lit("xq-"), "p_partkey"))
    aliases = spark.createDataFrame([("ALKP", "ALP"), ("CI", "CL")], "alias string, canonical string")
    known = spark.createDataFrame([(x,) for x in ["neu", "LYM", "MONO", "EOS", "BASO", "IMG", "NEU(%)", "LYM(%)", "MONO(%)", "EOS(%)", "BASO(%)", "IMG(%)", "ALB/GLOB", "BUN/CREA", "iCA", "ICA(7.4)", "Pre-ACTH", "ALP", "cPL"]], "canonical string")
    return labs.named(table(spark, sf, "part").select("p_partkey", name.alias("item_name")), aliases, known, "dog").select("p_partkey", "canonical", "recognized")
