"""Joins of alike sets and of names within names against all pairs, and how many pairs they look at."""

import random
import time

import pyarrow as pa
import pytest

from tidewell.operators import ledger, similarity


def likeness(a, b):
    a, b = ({x for x in s or [] if x.strip()} for s in (a, b))
    return len(a & b) / len(a | b) if a | b else 0.0


def random_sets(r, n, members):
    made = [r.sample(members, r.randint(1, 6)) for _ in range(n)]
    return made + [None, [], [" "], ["a", "a", "b", ""], *made[:5]]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_alike_sets_are_those_of_all_pairs(spark, least):
    r = random.Random(int(least * 10))
    members = [f"m{k}" for k in range(12)]
    one, two = ([(k, r.choice(["x", "y", None]), s) for k, s in enumerate(random_sets(r, 60, members))] for _ in range(2))
    left = spark.createDataFrame(one, "l long, owner string, members array<string>")
    right = spark.createDataFrame(two, "r long, owner string, members array<string>")
    found = {(x["l"], x["r"]): x["similarity"] for x in similarity.similar_rows(left, right, "members", ["owner"], least).collect()}
    assert found == {(a, b): likeness(s, t) for a, o, s in one for b, p, t in two if o is not None and o == p and likeness(s, t) >= least}


def test_candidates_of_one_common_name_are_near_the_answers(spark):
    """3000 sets under one name, in families of six that share most members; all pairs would be nine million."""
    r = random.Random(7)
    rows = []
    for f in range(500):
        family = [f"m{r.randint(0, 4000)}" for _ in range(7)]
        rows += [("kim", [*r.sample(family, 6), r.choice(["dog", "cat"])]) for _ in range(6)]
    sets = spark.createDataFrame(rows, "owner string, members array<string>")
    asked = similarity.candidate_sets(sets, sets, "members", ["owner"], 0.5).count()
    answers = similarity.similar_sets(sets, sets, "members", ["owner"], 0.5).count()
    assert answers <= asked < 1.5 * answers and answers > 10_000


def test_owners_are_those_of_all_pairs(spark):
    r = random.Random(9)
    members = [f"p{k}" for k in range(9)]
    owners = [(r.choice("ab"), r.sample(members, r.randint(1, 4))) for _ in range(50)] + [("a", ["p1", "", "p1"]), ("zz", ["p1"]), ("a", None)]
    ids = [(r.choice("ab"), f"c{k}", r.sample(members, r.randint(1, 4))) for k in range(60)]
    found = {(x["owner"], tuple(x["patients"] or ())): (x["customer"], round(x["similarity"], 9)) for x in ledger.resolved_owners(spark.createDataFrame(owners, "owner string, patients array<string>"), spark.createDataFrame(ids, "owner string, customer string, patients array<string>")).collect()}
    want = {}
    for o, p in owners:
        best = min(((-likeness(p, q), c) for n, c, q in ids if n == o and likeness(p, q) >= 0.3), default=None)
        if best:
            want[o, tuple(p or ())] = (best[1], round(-best[0], 9))
    assert found == want


def test_names_within_names_are_those_of_all_pairs(spark):
    r = random.Random(11)
    names = ["", None, "a", "ab", "동물", "동물병원", "강남동물병원", "aaaa", "aaaaa"] + ["".join(r.choices("ab동물", k=r.randint(1, 8))) for _ in range(80)]
    holders = spark.createDataFrame([(r.choice("pq"), n) for n in names], "place string, name string")
    held = spark.createDataFrame([(r.choice("pq"), n) for n in names], "place string, name string")
    found = [tuple(x) for x in similarity.containments(holders, held, ["place"]).collect()]
    want = {(p, a, b) for p, a in map(tuple, holders.collect()) for q, b in map(tuple, held.collect()) if p == q and a and b and b in a}
    assert set(found) == want and len(found) == len(want) > 100


def test_a_crowd_without_rare_members_is_compared_in_blocks(spark, monkeypatch):
    """Two owners whose sets are of thirty common members each, and one of few sets; blocks and slices are cut small."""
    for name, value in {"CROWD": 1000, "BLOCK": 64, "COLUMNS": 7, "SLICE": 16}.items():
        monkeypatch.setattr(similarity, name, value)
    r = random.Random(5)
    members = [f"t{k}" for k in range(30)]
    made = lambda n: [(k, r.choice("ab"), r.choices(members, k=r.randint(0, 14)) + r.choice([[], [" "], ["한글"]])) for k in range(n)]
    one, two = made(300) + [(300, "c", ["t1", "t2"]), (301, None, ["t1"]), (302, "a", None)], made(200) + [(200, "c", ["t1"]), (201, None, ["t1"])]
    left, right = (spark.createDataFrame(rows, f"{k} long, owner string, members array<string>") for rows, k in ((one, "l"), (two, "r")))
    assert similarity._crowds(similarity._sides(left, right, "members", ["owner"]), ["owner"], 0.4).count() == 2
    found = similarity.similar_rows(left, right, "members", ["owner"], 0.4).collect()
    want = {(a, b): likeness(s, t) for a, o, s in one for b, p, t in two if o is not None and o == p and likeness(s, t) >= 0.4}
    assert {(x["l"], x["r"]): x["similarity"] for x in found} == want and len(found) == len(want) > 300
    pairs = similarity.candidate_sets(left, right, "members", ["owner"], 0.4)
    assert pairs.columns == ["owner", "l_set", "r_set"] and pairs.count() == pairs.distinct().count() == similarity.similar_sets(left, right, "members", ["owner"], 0.4).count()


@pytest.mark.parametrize("crowd, block", [(1, 200), (1, 1 << 20), (1 << 30, 1 << 20)])
def test_pairs_of_one_table_are_told_once(spark, monkeypatch, crowd, block):
    """With crowds in many blocks, in few, and without; one set is that of forty rows, so its rows are dealt too. Keys may repeat."""
    monkeypatch.setattr(similarity, "CROWD", crowd)
    monkeypatch.setattr(similarity, "BLOCK", block)
    r = random.Random(8)
    members = [f"t{k}" for k in range(14)]
    rows = [(f"k{r.randint(0, 10**6)}", r.choice("ab"), r.choices(members, k=r.randint(0, 9)) + r.choice([[], [" "], ["한글"]])) for _ in range(250)]
    rows += [(f"c{k}", "a", ["t1", "t2", "t3", "t4", "t5"]) for k in range(40)]
    rows += [("c1", "a", ["t1", "t2", "t3", "t4"]), ("c1", "a", ["t1", "t2", "t3", "t4", "t5"]), (None, "a", ["t1", "t2", "t3"]), ("n", None, ["t1"]), ("m", None, ["t1"]), ("e", "b", None), ("f", "c", ["t1", "x"]), ("g", "c", ["t1", "x"])]
    table = spark.createDataFrame(rows, "key string, owner string, members array<string>")
    found = sorted((x["owner"], x["one"], x["other"], x["similarity"]) for x in similarity.similar_pairs(table, "key", "members", ["owner"], 0.5).collect())
    want = sorted((o, a, b, likeness(s, t)) for a, o, s in rows for b, p, t in rows if o and o == p and a and b and a < b and likeness(s, t) >= 0.5)
    assert found == want and len(found) > 1500


def test_many_sets_of_common_members_are_compared_at_little_cost():
    """400 million pairs; products of matrices took 11 ns of CPU a pair, 4.4 s."""
    r = random.Random(6)
    sets = pa.array([sorted(r.sample(range(41), r.randint(5, 13))) for _ in range(20_000)], pa.list_(pa.int64()))
    began = time.process_time()
    found = list(similarity._shared(sets, sets, 0.5))
    took = time.process_time() - began
    for a, b, x in [x for part in found for x in zip(*(p.tolist() for p in part))][::1000]:
        assert x == likeness([str(m) for m in sets[a].as_py()], [str(m) for m in sets[b].as_py()]) >= 0.5
    assert sum(len(part[0]) for part in found) > 20_000 and took < 2.5, took


def test_comparing_is_exact_for_odd_sizes_and_bounds(monkeypatch):
    r = random.Random(3)
    for least in (0.1, 0.3, 1 / 3, 0.5, 2 / 3, 0.8, 1.0):
        for columns, at_once, told, top, members in ((1, 1, 5, 40, 300), (2, 3, 100, 9, 41), (512, 16, 1 << 16, 3, 3), (7, 16, 1 << 16, 70, 90)):
            for name, value in {"COLUMNS": columns, "SLICE": at_once, "TOLD": told}.items():
                monkeypatch.setattr(similarity, name, value)
            one, two = ([set(r.sample(range(0, members * 7, 7), r.randint(1, min(top, members)))) for _ in range(n)] for n in (120, 70))
            found = [(a, b, x) for part in similarity._shared(*(pa.array([sorted(s) for s in side], pa.list_(pa.int64())) for side in (one, two)), least) for a, b, x in zip(*(p.tolist() for p in part))]
            assert sorted(found) == [(a, b, len(s & t) / len(s | t)) for a, s in enumerate(one) for b, t in enumerate(two) if len(s & t) / len(s | t) >= least]
