"""Automata against a loop, and the buckets of chart lines against a reader that goes line by line."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell.operators import automata, buckets
from tidewell.plans import registry


def test_states_are_those_of_a_loop(spark):
    r = random.Random(3)
    moves = [[r.randrange(5) for _ in range(5)] for _ in range(7)] + [list(range(5))]
    lines = [(k, n, r.randrange(8)) for k, size in (("long", 1000), ("edge", automata.SPAN), ("over", automata.SPAN + 1), ("one", 1), (None, 130)) for n in range(size)]
    rows = spark.createDataFrame(r.sample(lines, len(lines)), "k string, n int, e int").repartition(5)
    table = F.array(*(F.array(*map(F.lit, m)) for m in moves))
    found = {(x["k"], x["n"]): x["state"] for x in automata.states_before(rows, ["k"], ["n"], F.get(table, F.col("e")), 5, start=2).collect()}
    want, now = {}, {}
    for k, n, e in sorted(lines, key=lambda x: (str(x[0]), x[1])):
        want[k, n] = now.get(k, 2)
        now[k] = moves[e][want[k, n]]
    assert found == want
    assert automata.states_before(rows.limit(0), ["k"], ["n"], F.get(table, F.col("e")), 5).collect() == []


TEXTS = {
    "efriends": ["이름 : 콩이", "Date : 2024-03-09", "Record User : Kim", "진료 기록", "BUN 20 mg/dL", "Check List", "Weight 4", "SOAP History", "Laboratory Result", "Name Reference Result Unit x", "ALT 30", "vaccination DHPPL", "▶ Vaccination", "Subject vaccination", "오늘 바이탈", "2024-03-09 10:20", "x Radiology Result", "plain", "임상 병리", "진단 결과 추이", "검사항목 검사결과 참고치"],
    "intovet": ["Client : Kim", "[재진] [2024-03-09 10:20:11] 의사", "C.C : 기침", "Lab examination", "WBC 10", "Vaccination", "DHPPL 2차", "2024년 3월 9일 09:10", "vital sign", "BT 38", "진단 결과 추이", "plain", "Test Result Reference", "검체검사"],
    "other": ["이름", "2024.3.9 10:20", "본문", "진단검사", "ALT 3", "Vaccination x", "바이탈", "plain", "검사 결과 추이", "진단결과추이", "2024/3/9 1:02:03"],
    "woorien_pms": ["MEDICAL RECORD", "Medical  Record ", "보호자번호: 1", "S.O.A.P", "2026-03-31 오전 10:41:53 [일반]", "Subjective 기침", "LAB", "검사명 결과값 단위 참고", "|2026-03-31 Vcheck", "WBC 3", "2026-03-31 Sign : 김", "vaccination", "vital", "plain", "2024-10-26 10:07"],
    "plusvet": ["동물병원", "2026.01.30 14:54 | 재진 | 김", "2026.01.30 14:54", "Subjective", "기침", "진단 검사 결과", "2026.01.30 오후 2:54 Serum", "GLU 100", "진단 결과 추이", "CBC(전혈구 검사) | ProCyte", "CBC(전혈구) | 재진", "2026.01.30 14:54 | Serum Analysis | V200", "| 2026.01.30 14:54 | Blood Gas | x", "2026.01.30 14:54 | memo", "Vaccination", "바이탈", "- Vital sign : NRF", "검사항목 검사결과 참고범위", "plain"],
}
DATE, VISIT = r"20\d{2}[./-]\d{1,2}[./-]\d{1,2}", r"(재진|초진|예진|응급|검진|당일|복진|외래)(?![가-힣])"


def read_on(lines, kind):
    """A line-by-line reader with the state in variables: what is open, whether results or a skipped range are being read."""
    has = lambda p, t: bool(re.search(p, t, re.I))
    out, section, basic, results, skip = [], "chartBody", True, False, False
    lines = [" ".join((t or "").split()) for t in lines]
    for i, t in enumerate(lines):
        ahead = lines[i + 1 : i + 4]
        context = has(rf"\[?\s*({DATE}|\d{{4}}\s*년\s*\d{{1,2}}\s*월\s*\d{{1,2}}\s*일?)\s+[0-2]?\d:[0-5]\d", t)
        report = (has("검사 ?항목", t) and has("검사 ?결과", t) and has("참고 ?(치|범위)", t)) or (has(r"\b(test|item)\b", t) and has(r"\bresult\b", t) and has(r"\breference\b", t))
        pipe = re.match(rf"[|\s]*{DATE}\s+\d{{1,2}}:\d{{2}}\s*\|\s*(.+)$", t)
        header = bool(pipe and re.match(VISIT, pipe[1]))
        panel = bool(pipe and not header and has(r"\b(analysis|cbc|kit)\b|biochemical|blood\s+gas", t))
        title, trend, vaccine = has("진단 ?검사 ?결과", t), has("진단 ?결과 ?추이", t), has(r"^(▶ ?)?vaccination\b", t)
        subjective, alone = has(r"^subjective\b", t), t == "바이탈" or has(r"^vital ?(signs?)?$", t)
        words = has("진단 ?검사|(^| )임상 ?병리|검체 ?검사|검사 ?결과 ?추이", t)
        lab = report or kind != "plusvet" and (has("lab examination", t) or kind != "intovet" and words)
        lab = lab or kind == "woorien_pms" and has("^lab$|^검사명 +결과값 +단위", t) or kind == "efriends" and has("laboratory result|^name reference result unit\\b", t)
        if kind == "plusvet":
            before, _, after = t.partition("|")
            summary = trend or bool(after.strip() and not re.match(VISIT, after.strip()) and has(r"\b(cbc|analysis|kit)\b|biochemical|blood ?gas|electrolyte|urine|전혈구|혈청 ?분석|생화학 ?분석|요 ?검사|전해질", before))
            if skip and not (panel or header or subjective or title or report or vaccine or alone):
                out.append(None)
                continue
            if not skip and summary:
                skip, basic = True, False
                out.append(None)
                continue
            skip = False
        if kind == "woorien_pms" and has("^medical ?record$", t):
            basic, section = True, "basicInfo"
            out.append("basicInfo")
            continue
        if basic:
            ends = context or lab
            ends = ends or kind == "efriends" and has(rf"^(check list|soap history|laboratory result)\b|\bradiology result\b|^date ?: ?{DATE}\b|^진료 ?기록(?![가-힣])|^내원일 ?[:：]", t)
            ends = ends or kind == "woorien_pms" and (has(r"^s\.?o\.?a\.?p\.?$", t) or has(rf"^{DATE} (오전 |오후 )?\d{{1,2}}:\d{{2}}", t)) or kind == "plusvet" and (title or panel)
            if not ends:
                out.append("basicInfo")
                continue
            basic, section = False, "chartBody"
        signed = has(r"\bsign\b ?:", t) and has(DATE, t)
        moment = has(rf"^{DATE} \d{{1,2}}:\d{{2}}", t)
        if report:
            section, results = "lab", False
        elif kind == "plusvet" and (subjective or moment and (header or any(has(r"^subjective\b", a) for a in ahead))):
            section, results = "chartBody", False
        elif kind == "woorien_pms" and (subjective or signed):
            section = "chartBody"
        elif kind in ("intovet", "other", "efriends") and section in ("vaccination", "lab") and context:
            section = "chartBody"
        elif section == "lab" and trend or kind == "plusvet" and section == "lab" and header:
            section = "chartBody"
        elif kind == "plusvet" and title:
            section, results = "chartBody", True
        elif kind == "plusvet" and results:
            if vaccine:
                section, results = "vaccination", False
            elif alone:
                section, results = "vitals", False
                out.append(None)
                continue
            elif has(rf"^[|\s]*{DATE} (오전 |오후 )?\d{{1,2}}:\d{{2}}\b", t):
                section = "lab"
        elif kind == "plusvet" and panel:
            section = "lab"
        elif kind == "efriends" and has("^check list\\b", t):
            section = "vitals"
        elif kind == "efriends" and section == "vitals" and has("^soap history\\b", t):
            section = "chartBody"
        elif lab:
            section = "lab"
            out.append(None)
            continue
        elif vaccine:
            section = "vaccination"
        elif alone if kind == "plusvet" else has("바이탈|vital", t):
            section = "vitals"
            out.append(None)
            continue
        elif kind == "efriends" and section == "lab" and has(r"\bradiology result\b|^soap history\b", t):
            section = "chartBody"
        out.append(section)
    return out


@pytest.mark.parametrize("kind", buckets.KINDS)
def test_buckets_are_those_of_a_line_by_line_reader(spark, kind):
    r = random.Random(len(kind))
    docs = {d: [r.choice(TEXTS[kind]) for _ in range(r.choice([1, 5, 40, 200]))] for d in range(60)}
    docs[60] = [None, "", " ", *TEXTS[kind]]
    lines = [(d, n, t, "own") for d, texts in docs.items() for n, t in enumerate(texts)]
    found = buckets.assigned(spark.createDataFrame(r.sample(lines, len(lines)), "doc_id int, line_no int, text string, state string"), kind, "doc_id").collect()
    told = {(x["doc_id"], x["line_no"]): x["bucket"] for x in found}
    assert len(found) == len(lines) and {x["state"] for x in found} == {"own"}
    for d, texts in docs.items():
        assert [told[d, n] for n in range(len(texts))] == read_on(texts, kind), texts
    assert len(set(told.values())) >= 5


def test_lines_of_charts_move_once(spark):
    """Beside the join with orders, lines are dealt once, by chart; they are read once, and not gathered."""
    plan = registry.queries()["TXT-01-buckets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("Exchange") == 3
    assert "collect_list" not in plan


@pytest.mark.parametrize("size", [1, 7, 64, 100])
def test_states_go_on_from_batch_to_batch(spark, size):
    """Keys that begin, end and go on at the edges of Arrow batches and spans, and a column that is called as the answer."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        rows = spark.range(400).selectExpr("id div 150 as k", "id as n", "'own' as state", "cast(id % 3 = 0 as int) as e").repartition(3)
        moves = F.when(F.col("e") == 1, F.array(F.lit(1), F.lit(2), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
        found = automata.states_before(rows, ["k"], ["n"], moves, 3, start=1, name="met").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    turns = lambda n: len([i for i in range(n // 150 * 150, n) if i % 3 == 0])
    assert len(found) == 400 and all(x["met"] == (1 + turns(x["n"])) % 3 and x["state"] == "own" for x in found)
