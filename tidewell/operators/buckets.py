"""TXT-01: the five buckets of a chart's lines: basicInfo, chartBody, vaccination, lab and vitals.

Each chart system has rules in order: a sign that a line shows, the states in which it counts, the state that follows and the
bucket of the line. Rules are turned into what a line does in each state, and the automaton does the rest, so sections that are
re-opened, ranges that are skipped and signs that count in some sections only need no loop over lines."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.automata import states_before

BASIC, BODY, VACCINATION, LAB, VITALS = "basicInfo", "chartBody", "vaccination", "lab", "vitals"
SECTIONS = (BASIC, BODY, VACCINATION, LAB, VITALS)
#: Chart systems; any other is "other".
KINDS = ("intovet", "plusvet", "woorien_pms", "efriends", "other")
#: In one system, sections below the title of test results, and any section while a summary of trends is skipped.
RESULTS, SKIPPED = "results:", "skipped:"

# Dates, times and kinds of visits as the charts print them
_DATE, _TIME = r"20\d{2}[./-]\d{1,2}[./-]\d{1,2}", r"[0-2]?\d:[0-5]\d(?::[0-5]\d)?"
_VISIT = "(?:재진|초진|예진|응급|검진|당일|복진|외래)(?![가-힣])"
_CELL = r"^[|│┃\s]*"
_PIPED = rf"{_CELL}\[?\s*{_DATE}\s+\d{{1,2}}:\d{{2}}(?::\d{{2}})?\s*\|\s*"
# Signs that a line shows, by name, in texts with single spaces
SIGNS = {
    "visit_context": rf"\[?\s*(?:{_DATE}|\d{{4}}\s*년\s*\d{{1,2}}\s*월\s*\d{{1,2}}\s*일?)\s+{_TIME}\s*\]?|\[\s*20\d{{2}}-\d{{1,2}}-\d{{1,2}}\s+\d{{1,2}}:\d{{2}}:\d{{2}}\s*\]",
    "report_table": r"^(?=.*검사\s*항목)(?=.*검사\s*결과).*참고\s*(?:치|범위)|(?i)^(?=.*\b(?:test|item)\b)(?=.*\bresult\b).*\breference\b",
    "vaccination": r"(?i)^(?:▶\s*)?vaccination\b",
    "vitals_title": r"(?i)^바이탈$|^vital(?:\s*signs?)?$",
    "vitals": r"(?i)바이탈|vital",
    "lab_exam": r"(?i)lab examination",
    "lab_words": r"진단 ?검사|(?:^|\s)임상\s*병리|검체 ?검사|검사\s*결과\s*추이",
    "lab_alone": r"(?i)^lab$|^검사명\s+결과값\s+단위",
    "lab_result": r"(?i)laboratory result|^name\s+reference\s+result\s+unit\b",
    "sections": r"(?i)^(?:check list|soap history|laboratory result)\b|\bradiology\s+result\b",
    "dated": rf"(?i)^date\s*:\s*{_DATE}\b|^진료\s*기록(?![가-힣])|^내원일\s*[:：]",
    "check_list": r"(?i)^check list\b",
    "soap_history": r"(?i)^soap history\b",
    "radiology": r"(?i)\bradiology\s+result\b",
    "document": r"(?i)^medical\s*record$",
    "soap": r"(?i)^s\.?\s*o\.?\s*a\.?\s*p\.?$",
    "loose_visit": rf"(?i)^\[?\s*{_DATE}\s+(?:(?:오전|오후|am|pm)\s*)?{_TIME}",
    "signed": rf"(?i)^(?=.*\bSign\b\s*[:：]).*{_DATE}",
    "subjective": r"(?i)^subjective\b",
    "moment": rf"^\[?\s*{_DATE}\s+\d{{1,2}}:\d{{2}}",
    "visit_header": _PIPED + _VISIT,
    "panel": rf"(?i){_PIPED}(?!{_VISIT})(?:.*\b(?:Analysis|CBC|Kit)\b|.*Biochemical|.*Blood\s+Gas)",
    "panel_title": rf"(?i)^(?=[^|]*(?:\b(?:CBC|Analysis|Kit)\b|Biochemical|Blood\s*Gas|Electrolyte|Urine|전혈구|혈청\s*분석|생화학\s*분석|요\s*검사|전해질))[^|]*\|\s*(?!{_VISIT})\S",
    "results_title": r"진단\s*검사\s*결과",
    "trend": r"진단\s*결과\s*추이",
    "anchor": rf"(?i){_CELL}\[?\s*{_DATE}\s+(?:(?:오전|오후|am|pm)\s*)?{_TIME}\b",
    "bare_moment": rf"^{_DATE}\s+{_TIME}$",
    "visit_date": rf"(?i)^date\s*:\s*{_DATE}\b",
    "beside": r"(?i)purpose of visit\s*:|record user\s*:",
}


def _signs(kind: str, text: Column) -> dict[str, Column]:
    """Whether a line shows each sign, and what several of them tell together."""
    seen = {n: text.rlike(p) for n, p in SIGNS.items()}
    lab = {
        "plusvet": F.lit(False), "intovet": seen["lab_exam"], "woorien_pms": seen["lab_exam"] | seen["lab_alone"] | seen["lab_words"],
        "efriends": seen["lab_exam"] | seen["lab_result"] | seen["lab_words"], "other": seen["lab_exam"] | seen["lab_words"],
    }[kind]
    begins = {
        "intovet": F.lit(False), "other": seen["bare_moment"], "woorien_pms": seen["soap"] | seen["loose_visit"], "plusvet": seen["results_title"] | seen["panel"] | seen["bare_moment"],
        "efriends": seen["sections"] | seen["dated"] | seen["bare_moment"],
    }[kind]
    seen["lab"] = lab
    seen["begins"] = seen["visit_context"] | seen["report_table"] | lab | begins
    seen["visit"] = seen["moment"] & seen["visit_header"]
    seen["boundary"] = seen["subjective"] | seen["signed"]
    seen["resumes"] = seen["panel"] | seen["visit_header"] | seen["subjective"] | seen["results_title"] | seen["report_table"] | seen["vaccination"] | seen["vitals_title"]
    seen["trends"] = seen["trend"] | seen["panel_title"]
    return seen


@dataclass(frozen=True)
class Rule:
    """Where a sign (none: always; with a "not " before it: its absence) counts: the state that follows, and the line's bucket
    (None: none). With `as_if` the line is read on by the rules below as if it were met in another state."""

    sign: str | None
    states: Iterable[str] | Callable[[str], bool]
    to: Callable[[str], str] | str | None = None
    bucket: str | None = None
    as_if: Callable[[str], str] | None = None


def _section(state: str) -> str:
    return state.removeprefix(SKIPPED).removeprefix(RESULTS)


def _anywhere(state: str) -> bool:
    return True


def rules(kind: str) -> list[Rule]:
    """The rules of a chart system, in the order in which they are asked."""
    below, skipped = (lambda s: s.startswith(RESULTS)), (lambda s: s.startswith(SKIPPED))
    trends = [
        Rule("trends", lambda s: not skipped(s), lambda s: SKIPPED + (BODY if s == BASIC else s)),
        Rule("not resumes", skipped, lambda s: s),
        Rule(None, skipped, as_if=lambda s: s.removeprefix(SKIPPED)),
    ]
    found = trends if kind == "plusvet" else [Rule("document", _anywhere, BASIC, BASIC)] if kind == "woorien_pms" else []
    found = [*found, Rule("not begins", [BASIC], BASIC, BASIC), Rule(None, [BASIC], as_if=lambda s: BODY), Rule("report_table", _anywhere, LAB, LAB)]
    if kind == "plusvet":
        found += [Rule("visit", _anywhere, BODY, BODY), Rule("subjective", _anywhere, BODY, BODY)]
    elif kind == "woorien_pms":
        found += [Rule("boundary", _anywhere, BODY, BODY)]
    else:
        found += [Rule("visit_context", [VACCINATION, LAB], BODY, BODY)]
    found += [Rule("trend", lambda s: _section(s) == LAB, BODY, BODY)]
    if kind == "plusvet":
        found += [
            Rule("visit_header", lambda s: _section(s) == LAB, BODY, BODY), Rule("results_title", _anywhere, RESULTS + BODY, BODY), Rule("vaccination", below, VACCINATION, VACCINATION),
            Rule("vitals_title", below, VITALS), Rule("anchor", below, RESULTS + LAB, LAB), Rule(None, [RESULTS + LAB], RESULTS + LAB, LAB), Rule(None, [RESULTS + BODY], RESULTS + BODY, BODY), Rule("panel", _anywhere, LAB, LAB),
        ]
    if kind == "efriends":
        found += [Rule("check_list", _anywhere, VITALS, VITALS), Rule("soap_history", [VITALS], BODY, BODY)]
    found += [Rule("lab", _anywhere, LAB), Rule("vaccination", _anywhere, VACCINATION, VACCINATION), Rule("vitals_title" if kind == "plusvet" else "vitals", _anywhere, VITALS)]
    if kind == "efriends":
        found += [Rule("radiology", [LAB], BODY, BODY), Rule("soap_history", [LAB], BODY, BODY)]
    return found


def states_of(kind: str) -> list[str]:
    """The states of a chart system; the first is the one in which a document begins."""
    if kind != "plusvet":
        return list(SECTIONS)
    inner = [*SECTIONS[1:], RESULTS + BODY, RESULTS + LAB]
    return [BASIC, *inner, *(SKIPPED + s for s in inner)]


def _told(kind: str, shown: dict[str, Column]) -> tuple[Column, Column]:
    """What a line that shows these signs does: for each state the number of the next one, and the line's bucket."""
    states, asked = states_of(kind), rules(kind)
    number = {s: i for i, s in enumerate(states)}

    def resolved(at: int, state: str) -> tuple[Column, Column]:
        if at == len(asked):
            return F.lit(number[state]), F.lit(_section(state))
        rule = asked[at]
        if not (rule.states(state) if callable(rule.states) else state in rule.states):
            return resolved(at + 1, state)
        to = rule.to(state) if callable(rule.to) else rule.to
        hit = resolved(at + 1, rule.as_if(state)) if rule.as_if else (F.lit(number[to]), F.lit(rule.bucket).cast("string"))
        if rule.sign is None:
            return hit
        sign = ~shown[rule.sign[4:]] if rule.sign.startswith("not ") else shown[rule.sign]
        return tuple(F.when(sign, h).otherwise(r) for h, r in zip(hit, resolved(at + 1, state)))

    made = [resolved(0, s) for s in states]
    return F.array(*(m for m, _ in made)), F.array(*(b for _, b in made))


#: Signs that are also looked for in so many lines after a line, by chart system.
AHEAD = {"plusvet": ("subjective", 3), "efriends": ("beside", 2)}


def _names(kind: str) -> list[str]:
    """The signs that a chart system needs of each line."""
    return sorted({r.sign.removeprefix("not ") for r in rules(kind) if r.sign} | {"plusvet": {"subjective", "moment"}, "efriends": {"beside", "visit_date"}}.get(kind, set()))


def _shown(kind: str) -> dict[str, Column]:
    """The signs of a line with bits_, those that the next lines have a part in among them (ahead_: the bits of any of these)."""
    at = {n: 1 << i for i, n in enumerate(_names(kind))}
    found = {n: F.col("bits_").bitwiseAND(F.lit(bit)) != 0 for n, bit in at.items()}
    if kind in AHEAD:
        soon = F.col("ahead_").bitwiseAND(F.lit(at[AHEAD[kind][0]])) != 0
        if kind == "plusvet":
            found["visit"] |= found["moment"] & soon
        else:  # a date, with the visit's purpose or its writer beside it or in the next two lines
            found["begins"] |= found["visit_date"] & (found["beside"] | soon)
    return found


def assigned(lines: DataFrame, kind: str, *keys: str) -> DataFrame:
    """lines (keys, line_no, text) with bucket; null for titles that belong to none and for what is skipped. Null texts count as
    empty.

    What a line shows is read once, into the bits of a number, before lines are put in order, and lines know of the next ones by
    their bits; so nothing is sorted but the lines as they came, with that number."""
    read = lines.withColumn("text_", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")))  # as it is asked many times
    signs = _signs(kind, F.col("text_"))
    bits = reduce(Column.bitwiseOR, (F.when(signs[n], 1 << i).otherwise(0) for i, n in enumerate(_names(kind))))
    read = read.withColumn("bits_", bits).drop("text_")
    if kind in AHEAD:
        order = Window.partitionBy(*keys).orderBy("line_no")
        read = read.withColumn("ahead_", reduce(Column.bitwiseOR, (F.lead("bits_", i + 1, 0).over(order) for i in range(AHEAD[kind][1]))))
    moves, buckets = _told(kind, _shown(kind))
    found = states_before(read, list(keys), ["line_no"], moves, len(states_of(kind)), name="state_")
    return found.select(*lines.columns, F.get(buckets, F.col("state_")).alias("bucket"))
