"""Expressions over columns of whole tables, with SQL that works the answers out; their odd cases stand in values.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import dates, numbers, text
from tidewell.operators import labs, rubric
from tidewell.plans.fixtures import table
from tidewell.plans.registry import query

#: White space in the SQL's regular expressions, which know only that of ASCII by name.
SPACES = r"[\x09-\x0D\x{85}\x{FEFF}\p{Z}]+"


def _query(name: str, of: str, key: str, v, sql: str, kind: str = "") -> None:
    """Register name-rows: an expression v on every row of a table, and the SQL expression that must give the same."""

    @query(f"{name}-rows", f"select {key}, {sql} as v from {of}".replace(" as v from", f"{kind} as v from"))
    def run(spark, sf):
        return table(spark, sf, of).select(key, v().alias("v"))


def _n(column: str, m: int):
    return (F.col(column) % m).cast("int")


def _of(values: list, i):
    return F.get(F.array(*map(F.lit, values)), i)


def _cat(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


c, k, day = (lambda: F.col("c_custkey")), (lambda: F.col("o_orderkey")), (lambda: F.col("o_orderdate").cast("date"))
spaced = lambda: F.translate(_cat(" ", F.coalesce("text", F.lit("")), "﻿ "), "eu", "\t　")
SPACED = "translate(' ' || coalesce(text, '') || chr(65279) || ' ', 'eu', chr(9) || chr(12288))"

_query("STR-01", "documents", "doc_id", lambda: text.normalize_text(spaced()), f"trim(regexp_replace({SPACED}, '{SPACES}', ' ', 'g'))")
_query("STR-03", "customer", "c_custkey", lambda: text.normalize_owner_name(_cat("  KIM　\t", c(), "  Lee ")), "'kim ' || c_custkey || ' lee'")
_query("STR-05", "customer", "c_custkey", lambda: F.concat_ws("|", *(text.split_owner_patients(_cat("Kim ,L", c(), " , (a", c(), " ,b(", c(), ")) x"))[f] for f in ("owner", "patients"))), "'Kim, L' || c_custkey || ', (a' || c_custkey || ', b|' || c_custkey || ')'")
_query("STR-09", "documents", "doc_id", lambda: text.visible_chars(_cat("# Head\n![x](y.png) <b>", F.coalesce("text", F.lit("")), "</b>")), f"length(regexp_replace(regexp_replace(regexp_replace(regexp_replace('# Head' || chr(10) || ' ' || '<b>' || coalesce(text, '') || '</b>', '<[^>]+>', '', 'g'), '(?m)^#{{1,6}}[ \\t]*', '', 'g'), '[*_`~>]', '', 'g'), '{SPACES}', '', 'g'))", "::bigint")
_query("STR-10", "documents", "doc_id", lambda: text.includes_loosely(F.coalesce("text", F.lit("")), F.concat(F.substring("source", 1, 2), F.lit("　"), F.substring("source", 3, 2))), f"coalesce(source[1:4] <> '' and contains(regexp_replace(coalesce(text, ''), '{SPACES}', '', 'g'), source[1:4]), false)")
_query("STR-11", "customer", "c_custkey", lambda: text.region_token(_cat("서울시  ", _of(["강남구", "가평군", "중구", "양평"], _n("c_custkey", 4)), " ", c(), "동")), "case c_custkey % 4 when 0 then '강남' when 1 then '가평' when 2 then '중구' else case when length(c_custkey || '동') > 2 then c_custkey || '동' else c_custkey || '동' end end")
_query("STR-13", "customer", "c_custkey", lambda: text.blog_id(F.when(c() % 2 == 0, _cat("https://m.blog.example.com/User_", c(), "/22")).otherwise(_cat(" User-", c(), " "))), "case when c_custkey % 2 = 0 then 'user_' else 'user-' end || c_custkey")
_query("STR-14", "customer", "c_custkey", lambda: text.place_id(_cat("https://x.com", _of(["/place/", "/hospital/", "/a?id=", "/other/"], _n("c_custkey", 4)), c(), "?b=1")), "case when c_custkey % 4 < 3 then c_custkey::varchar end")
_query("STR-15", "customer", "c_custkey", lambda: text.store_name(_cat(" A", c(), "&amp;B  동물\t", c(), "& ")), "'A' || c_custkey || ' B 동물 ' || c_custkey")
_query("STR-16", "customer", "c_custkey", lambda: text.fold_lookalikes(F.translate("c_name", "Coeu", "Соеυ")), "c_name")
_query("STR-17", "customer", "c_custkey", lambda: text.with_particle(_cat("가", F.decode(F.unhex(F.hex(F.lit(0xAC00) + c() * 7 % 11172)), "UTF-16BE")), "은", "는"), "'가' || chr((44032 + c_custkey * 7 % 11172)::int) || case when c_custkey * 7 % 11172 % 28 <> 0 then '은' else '는' end")
_query("STR-18", "customer", "c_custkey", lambda: text.redact(_cat("call 010-", F.lpad((c() % 10000).cast("string"), 4, "0"), "-1234 or u", c(), "@mail.co, no ", c())), "'call [redacted:phone] or [redacted:email], no ' || c_custkey")

_query("DAT-02", "orders", "o_orderkey", lambda: dates.parse_mixed_date(F.when(k() % 3 == 0, F.date_format(day(), "yyyy.M.d")).when(k() % 3 == 1, F.date_format(day(), "M/d/yyyy")).otherwise(F.datediff(day(), F.lit("1899-12-30").cast("date")).cast("string"))), "o_orderdate::date")
_query("DAT-03", "orders", "o_orderkey", lambda: dates.parse_review_date(F.when(k() % 4 == 0, F.date_format(day(), "yy.M.d")).when(k() % 4 == 1, F.date_format(day(), "M.d")).when(k() % 4 == 2, _cat(k() % 90, "일 전")).otherwise(_cat(k() % 9, " 주 전")), F.lit("2024-03-10").cast("date")),
       "case o_orderkey % 4 when 0 then ('20' || strftime(o_orderdate, '%y-%m-%d'))::date when 1 then case when try_cast('2024-' || strftime(o_orderdate, '%m-%d') as date) > date '2024-03-11' then (try_cast('2024-' || strftime(o_orderdate, '%m-%d') as date) - interval 1 year)::date else try_cast('2024-' || strftime(o_orderdate, '%m-%d') as date) end when 2 then date '2024-03-10' - (o_orderkey % 90)::int else date '2024-03-10' - (o_orderkey % 9 * 7)::int end")
_query("DAT-10", "orders", "o_orderkey", lambda: (lambda r: F.when(r.isNotNull(), F.concat_ws("|", r["start"], r["end"])))(dates.next_range(F.when(k() % 5 > 0, day()), F.lit("1996-01-01").cast("date"), 7)), "case when o_orderkey % 5 = 0 then '1995-12-26|1996-01-01' when o_orderdate::date < date '1996-01-01' then strftime(o_orderdate::date + 1, '%Y-%m-%d') || '|1996-01-01' end")
_query("DAT-11", "orders", "o_orderkey", lambda: dates.leading_iso_date(F.when(k() % 3 == 0, F.date_format(day(), "yyyyMMdd")).when(k() % 3 == 1, _cat(F.date_format(day(), "yyyy-MM-dd"), " 10:00")).otherwise(_cat("1997-02-", F.lpad((k() % 31 + 1).cast("string"), 2, "0")))), "case o_orderkey % 3 when 2 then try_cast('1997-02-' || lpad((o_orderkey % 31 + 1)::varchar, 2, '0') as date) else o_orderdate::date end")
_query("DAT-12", "customer", "c_custkey", lambda: dates.birth_from_age(_cat(c() % 20, "Y ", c() % 12, "M"), F.lit("2024-03-10").cast("date")), "make_date((2024 * 12 + 2 - (c_custkey % 20 * 12 + c_custkey % 12)) // 12, 1, 1)")
_query("DAT-14", "orders", "o_orderkey", lambda: dates.korean_date(day()), "year(o_orderdate) || '년 ' || month(o_orderdate) || '월 ' || day(o_orderdate) || '일'")
_query("DAT-15", "events", "event_id", lambda: F.date_format(F.from_utc_timestamp("ts", dates.SEOUL), "yyyy-MM"), "strftime(ts + interval 9 hour, '%Y-%m')")
_query("DAT-16", "orders", "o_orderkey", lambda: dates.stale_days(day(), F.lit("1996-01-01").cast("date")), "greatest(date '1996-01-01' - o_orderdate::date, 0)", "::int")
_query("DAT-16-left", "events", "event_id", lambda: dates.days_left(F.col("ts").cast("timestamp"), F.lit("2024-01-15 00:00:00").cast("timestamp")), "ceil((floor(epoch(ts)) - epoch(timestamp '2024-01-15 00:00:00')) / 86400)", "::int")
_query("DAT-17", "events", "event_id", lambda: dates.is_due(_n("user_id", 24), F.when(F.col("event_id") % 2 == 0, _n("event_id", 7)), F.when(F.col("event_id") % 3 > 0, F.col("ts").cast("timestamp") - F.expr("interval 40 minutes")), F.col("ts").cast("timestamp")), "user_id % 24 = hour(ts) and (event_id % 2 = 1 or event_id % 7 = dayofweek(ts)) and (event_id % 3 = 0 or date_trunc('hour', ts - interval 40 minute) < date_trunc('hour', ts))")

_query("MTH-02", "part", "p_partkey", lambda: F.concat_ws("|", *(numbers.parse_count(F.when(F.col("p_partkey") % 3 == 0, "< 10").otherwise(F.format_number(F.col("p_partkey") * 1000, 0)))[f].cast("string") for f in ("value", "under10"))), "case when p_partkey % 3 = 0 then '10|true' else (p_partkey * 1000) || '|false' end")
_query("MTH-05", "part", "p_partkey", lambda: numbers.llm_cost(numbers.price_of(_cat(_of(["gpt-x-mini-", "gpt-x-", "other-"], _n("p_partkey", 3)), F.col("p_size")), {"gpt-x": ("1.0", "0.5", "10.0"), "gpt-x-mini": ("0.1", "0.05", "1.0")}), (F.col("p_partkey") + 100, F.col("p_size"), F.col("p_size") * 3, F.lit(4))).cast("double"), "case p_partkey % 3 when 0 then ((p_partkey + 100 - p_size) * 0.1 + p_size * 0.05 + (p_size * 3 + 4) * 1.0) / 1000000 when 1 then ((p_partkey + 100 - p_size) * 1.0 + p_size * 0.5 + (p_size * 3 + 4) * 10.0) / 1000000 else 0 end", "::double")
_query("MTH-06", "part", "p_partkey", lambda: numbers.unit_cost(_of(["sms", "alimtalk", "x"], _n("p_partkey", 3)), {"sms": "0.004", "alimtalk": "0.0065"}, F.col("p_size")).cast("double"), "case p_partkey % 3 when 0 then 0.004 * p_size when 1 then 0.0065 * p_size else 0 end", "::double")
_query("MTH-09", "part", "p_partkey", lambda: numbers.nice_axis(F.col("p_partkey"))["step"] * numbers.nice_axis(F.col("p_partkey"))["ticks"], "case when p_partkey > 0 then (select min(p * m * n) from (select 10.0::double ** floor(log10(greatest(p_partkey::double, 1.0::double) / 4)) as p), (values (1.0::double), (2.0::double), (2.5::double), (5.0::double), (10.0::double)) ms(m), (values (4), (5), (6)) ns(n) where p * m * n >= p_partkey) end", "::double")
_query("MTH-10", "part", "p_partkey", lambda: numbers.clamp(F.col("p_partkey").cast("double") - 50, 1.0, 60.0), "least(greatest(p_partkey - 50, 1), 60)", "::double")

_shown = lambda *cs: F.concat_ws("|", *(F.coalesce(x.cast("string"), F.lit("")) for x in cs))
_query("TXT-04", "part", "p_partkey", lambda: (lambda p: _shown(p["item"], p["quantity"], p["days"]))(labs.plan_line(_cat("- Drug", F.col("p_partkey"), " ", F.col("p_size"), " tab x ", F.col("p_partkey") % 30 + 1, " days"))), "'Drug' || p_partkey || '|' || p_size || '.0|' || (p_partkey % 30 + 1)")
_query("TXT-05", "part", "p_partkey", lambda: (lambda p: _shown(p["item"], p["value"], p["unit"], p["reference"], p["told"]))(labs.lab_line(_cat("Test", F.col("p_partkey"), " ", F.col("p_size"), _of([" H", " L", ""], _n("p_partkey", 3)), " mg/dL ", F.col("p_partkey") % 9, " - ", F.col("p_partkey") % 9 + 20))), "'Test' || p_partkey || '|' || p_size || '|mg/dL|' || (p_partkey % 9) || ' - ' || (p_partkey % 9 + 20) || '|' || ['high', 'low', ''][p_partkey % 3 + 1]")
_query("TXT-07", "orders", "o_orderkey", lambda: (lambda p: _shown(p["given_on"], p["name"], p["dose"]))(labs.vaccination_line(_cat(F.date_format(day(), "yyyy.M.d"), " Vax", k() % 50, " ", k() % 4 + 1, "차"))), "strftime(o_orderdate, '%Y-%m-%d') || '|Vax' || (o_orderkey % 50) || '|' || (o_orderkey % 4 + 1)")
_query("TXT-08", "part", "p_partkey", lambda: _shown(*(F.try_element_at(labs.vital_line(_cat("BW: ", F.col("p_size"), ".5 kg, HR ", F.col("p_partkey"), _of([", 체온 38.", ", XBT 38."], _n("p_partkey", 2)), F.col("p_size") % 10)), F.lit(n)) for n in ("weight", "heart_rate", "temperature"))), "p_size || '.5|' || p_partkey || '.0|' || case when p_partkey % 2 = 0 then '38.' || (p_size % 10) else '' end")
_query("TXT-11", "part", "p_partkey", lambda: _shown(*labs.finished(_of(["-", "norm", "7"], _n("p_partkey", 3)), F.when(F.col("p_size") % 2 == 0, "1-2").otherwise(""), F.col("p_size") % 3 == 0, F.lit("high"))), "case p_partkey % 3 when 0 then case when p_size % 3 = 0 then 'NEG' else '' end when 1 then '정상' else '7' end || '|' || case when p_partkey % 3 = 0 and p_size % 3 = 0 then 'normal' when p_size % 2 = 1 then 'unknown' else 'high' end")
_query("LAB-07", "part", "p_partkey", lambda: _shown(*labs.open_range(F.when(F.col("p_partkey") % 3 == 0, _cat("<", F.col("p_size"))).when(F.col("p_partkey") % 3 == 1, _cat("> ", F.col("p_size"))).otherwise(_cat(F.col("p_size"), ",5 ~ ", F.col("p_size") + 9)))), "case p_partkey % 3 when 0 then '|' || p_size || '.0' when 1 then p_size || '.0|' else p_size || '.5|' || (p_size + 9) || '.0' end")
_query("LAB-08", "part", "p_partkey", lambda: labs.flag_of_text(_cat(F.col("p_size"), " ", _of(["H", "(Low)", "NonReactive", "positive", "HL"], _n("p_partkey", 5)))), "['high', 'low', 'normal', 'high', 'unknown'][p_partkey % 5 + 1]")
_query("QLT-02", "part", "p_partkey", lambda: _shown(rubric.medical_light(_n("p_partkey", 2), _n("p_size", 2), _n("p_partkey", 3)), rubric.seo_light(_n("p_partkey", 2), _n("p_size", 2), F.lit(0), F.lit(0))), "case when p_partkey % 2 > 0 then 'red' when p_size % 2 > 0 or p_partkey % 3 > 0 then 'yellow' else 'green' end || '|' || case when p_partkey % 2 > 0 then 'red' when p_size % 2 > 0 then 'yellow' else 'green' end")
