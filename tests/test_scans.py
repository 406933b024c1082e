"""Running sums, last values and refusing balances in spans, against plain windows and loops; a third of the rows are one key's."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import billing, ranks, scans


@pytest.fixture(scope="module")
def ledger(spark):
    """9000 rows of 200 keys, a third of them of one key and some of none; values may be missing."""
    r = random.Random(2)
    rows = [(r.choice(["hot"] * 100 + [None] + [f"k{i}" for i in range(199)]), n, r.choice([None, *range(-9, 12)])) for n in range(9000)]
    return spark.createDataFrame(r.sample(rows, len(rows)), "k string, n long, v long").repartition(6)


def test_spans_cut_a_hot_key_in_order(ledger):
    cut = scans.spans(ledger, ["k"], ["n"], 24)
    sizes = {(r["k"], r["span_"]): r for r in cut.groupBy("k", "span_").agg(F.count("*").alias("c"), F.min("n").alias("a"), F.max("n").alias("b")).collect()}
    hot = sorted((s, r["a"], r["b"]) for (k, s), r in sizes.items() if k == "hot")
    assert len(hot) >= 6 and max(r["c"] for r in sizes.values()) < 9000 / 24 * 2.5
    assert all(x[2] < y[1] for x, y in zip(hot, hot[1:]))


def test_running_values_are_those_of_a_plain_window(ledger):
    made = scans.running(ledger, ["k"], ["n"], sums={"total": "v"}, lows={"least": "total"}, lasts={"newest": "v"}, parts=24)
    frame = Window.partitionBy("k").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = ledger.withColumn("total", F.coalesce(F.sum("v").over(frame), F.lit(0))).withColumn("newest", F.last("v", ignorenulls=True).over(frame))
    want = want.withColumn("least", F.min("total").over(frame)).select("k", "n", "v", "total", "newest", "least")
    rows = lambda df: sorted(map(str, map(tuple, df.select("k", "n", "v", "total", "newest").collect())))
    assert rows(made) == rows(want)
    # before the first value there is no sum whose low could be told
    lows = lambda df: {r["n"]: r["least"] for r in df.collect()}
    found, plain = lows(made), lows(want)
    first = {r["k"]: r["m"] for r in ledger.where("v is not null").groupBy("k").agg(F.min("n").alias("m")).collect()}
    known = [r for r in ledger.collect() if r["k"] in first and r["n"] >= first[r["k"]]]
    assert all(min(found[r["n"]], 0) == min(plain[r["n"]], 0) for r in known) and len(known) > 8000


def test_running_over_nothing(spark):
    none = spark.createDataFrame([], "k string, n long, v long")
    assert scans.running(none, ["k"], ["n"], sums={"total": "v"}, lasts={"newest": "v"}).collect() == []


def loop(rows):
    left, out = {}, {}
    for user, seq, amount in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        ok = amount != 0 and left.get(user, 0) + amount >= 0
        left[user] = left.get(user, 0) + (amount if ok else 0)
        out[user, seq] = (ok, left[user])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_refusing_balances_are_those_of_a_loop(spark, seed):
    r = random.Random(seed)
    users = [0] * 40 + list(range(1, 60))
    deposit = [0, 60, 10, 25][seed]
    rows = [(u, n, 0 if r.random() < 0.05 else deposit if r.random() < 0.3 else -r.randint(1, 20)) for n in range(3000) for u in [r.choice(users)]]
    rows += [(100, n, 5) for n in range(40)] + [(101, 0, 1000)] + [(101, n, -10) for n in range(1, 90)]
    found = billing.deducted(spark.createDataFrame(rows, "user_id long, seq long, amount long")).collect()
    assert {(x["user_id"], x["seq"]): (x["accepted"], x["balance_after"]) for x in found} == loop(rows) and len(found) == len(rows)


def test_renewals_of_low_free_and_negative_balances(spark):
    rows = [("a", "p1", 10, date(2024, 1, 1), True, 25), ("a", "p2", 20, date(2024, 1, 2), True, 25), ("a", "p3", 15, date(2024, 1, 3), True, 25), ("a", "p4", 0, date(2024, 1, 4), True, 25), ("a", "p5", 0, date(2024, 1, 4), False, 25),
            ("b", "p1", 0, date(2024, 1, 1), True, -3), ("b", "p2", 5, date(2024, 1, 1), True, -3), ("c", "p1", 5, date(2025, 1, 1), True, 9), ("d", "p1", 7, date(2024, 1, 1), True, 0)]
    found = billing.renewals(spark.createDataFrame(rows, "hospital_id string, product_code string, price_tokens int, ends_at date, auto_renew boolean, balance int"), "2024-06-01").collect()
    assert sorted(map(tuple, found)) == [("a", "p1", "renewed", 15), ("a", "p2", "lapsed", 15), ("a", "p3", "renewed", 0), ("a", "p4", "renewed", 0), ("a", "p5", "lapsed", 0), ("b", "p1", "lapsed", -3), ("b", "p2", "lapsed", -3), ("d", "p1", "lapsed", 0)]


def test_as_of_days_of_a_hot_hospital(spark):
    r = random.Random(4)
    days = [("hot", date(2020, 1, 1) + timedelta(days=d)) for d in range(900) if r.random() < 0.4] + [("h1", date(2020, 1, 1)), ("h1", date(2020, 3, 1))]
    found = {tuple(x)[:2]: x["baseline"] for x in ranks.as_of(spark.createDataFrame(days, "hospital_id string, metric_date date"), 30).collect()}
    for h, d in days:
        assert found[h, d] == max((x for k, x in days if k == h and x <= d - timedelta(days=30)), default=None)
