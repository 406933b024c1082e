"""Lines of text layers: what is moved for them, and pages against a loop."""

import random

import pyarrow as pa
import pytest

from tidewell.plans import registry
from tidewell.sources import textlayers


@pytest.mark.parametrize("name", ["SRC-20", "SRC-20-bands"])
def test_items_are_not_moved(spark, name):
    """Texts are dealt once; neither their items nor lines are dealt or sorted after that."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort [" not in plan and "Window" not in plan


def joined(items):
    text, end = "", None
    for x, _, width, size, t in sorted(items):
        text += (" " if end is not None and x - end > max(3.0, size * 0.35) else "") + t
        end = x + width
    return text


def test_lines_of_mixed_pages(spark):
    r = random.Random(5)
    rows = [(d, p, k, float(r.randint(0, 60)), r.choice([None, 10.0, 9.7, 30.0, 30.4]), 7.0, 10.0, r.choice(["ab", " ", "c", ""])) for d in range(6) for p in range(3) for k in range(r.choice([1, 2, 40]))]
    items = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id int, page int, seq int, x double, y double, width double, size double, text string").repartition(5)
    streams, bands = {}, {}
    for key in {x[:2] for x in rows}:
        page = sorted(x[2:] for x in rows if x[:2] == key and x[4] is not None)
        runs = []
        for seq, x, y, *rest in page:
            if not runs or runs[-1][0] != y:
                runs.append((y, []))
            runs[-1][1].append((x, seq, *rest))
        shown = [joined(of).rstrip() for _, of in sorted(runs, key=lambda v: -v[0])]
        streams |= {(*key, i + 1): t for i, t in enumerate(t for t in shown if t)}
        heights = {int(y + 0.5) for _, _, y, *_ in page}
        shown = [joined([(x, seq, *rest) for seq, x, y, *rest in page if int(y + 0.5) == h]).strip() for h in sorted(heights, reverse=True)]
        bands |= {(*key, i + 1): t for i, t in enumerate(t for t in shown if t)}
    found = lambda df: {(x["doc_id"], x["page"], x["line_no"]): x["text"] for x in df.collect()}
    assert found(textlayers.stream_lines(items)) == streams and found(textlayers.band_lines(items)) == bands


@pytest.mark.parametrize("name", ["SRC-20", "SRC-20-bands"])
def test_items_are_not_asked_for_one_by_one(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("most", [1, 50])
def test_pages_are_worked_on_in_shares(most, monkeypatch):
    """The pages of a batch in shares of few items, and pages of more items than a share has."""
    monkeypatch.setattr(textlayers, "ITEMS", most)
    item = {"seq": 0, "height": 1.0, "x": 0.0, "width": 5.0, "size": 10.0, "text": "w"}
    pages = [{"doc_id": d, "page": 0, "items": [item | {"seq": i, "height": float(-i), "text": f"{d}-{i}"} for i in range(n)]} for d, n in enumerate([3, 0, 60, 1, 49, 2])]
    found = [r for b in textlayers.in_shares([pa.RecordBatch.from_pylist(pages).slice(1), pa.RecordBatch.from_pylist(pages[:1])], True, False) for r in b.to_pylist()]
    shown = [(p["doc_id"], i + 1, x["text"]) for p in pages[1:] + pages[:1] for i, x in enumerate(p["items"])]
    assert [(r["doc_id"], r["line_no"], r["text"]) for r in found] == shown


def test_odd_items(spark):
    """Items that share a place in all but their texts, texts that are null or blank, heights and places that are no numbers, and
    pages of which nothing is shown."""
    nan, rows = float("nan"), []
    rows += [(1, 0, 0, 5.0, 10.0, 1.0, 10.0, t) for t in ("b", None, "a", "\u3000")]  # one number, one place
    rows += [(2, None, 0, 0.0, 1.0, 1.0, 10.0, "no page"), (2, None, 1, 0.0, -0.0, 1.0, 10.0, "zero"), (2, None, 2, 9.0, 0.0, 1.0, 10.0, "again")]
    rows += [(3, 0, 0, nan, nan, 1.0, 10.0, "x"), (3, 0, 1, 1.0, nan, 1.0, 10.0, "first\x1c\u00a0"), (3, 0, 2, 0.0, 5.0, 1.0, 10.0, "below")]
    rows += [(4, 0, 0, 0.0, 1.0, 1.0, 10.0, "\u2003 "), (4, 0, 1, 0.0, 2.0, 1.0, 10.0, None), (5, 0, 0, 0.0, None, 1.0, 10.0, "nowhere")]
    rows += [(6, 0, None, 3.0, 1.0, None, None, "2"), (6, 0, 7, None, 1.0, 1.0, 10.0, "1")]
    items = spark.createDataFrame(rows, "doc_id int, page int, seq int, x double, y double, width double, size double, text string")
    found = lambda df: sorted((x["doc_id"], x["page"], x["line_no"], x["text"]) for x in df.collect())
    shown = [(1, 0, 1, "ab"), (2, None, 1, "no page"), (2, None, 2, "zero again"), (3, 0, 1, "first\x1c\u00a0 x"), (3, 0, 2, "below"), (6, 0, 1, "12")]
    assert found(textlayers.stream_lines(items)) == shown
    assert found(textlayers.stream_lines(items.limit(0))) == found(textlayers.band_lines(items.limit(0))) == []
