"""The filter audit, importance resampling and exact dedup against brute force, on awkward tables and over several rounds."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest

from tidewell.llm import common, exact_dedup, filter_audit, resampling

#: Columns with names that the operators use themselves.
DOCS = "doc_id long, text string, lang string, source string, h long, row_ long, best int, n int, mask int, part string, score int, rank int, segment int, text_ string, repeated boolean, kept_ int"
REST = (1, 2, 3, 4, 5, "p", 6, 7, 8, "t", True, 9)
LABELS = "doc_id long, quality int, toxic int, good int, source string"


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, *REST) for i, t, s in rows], DOCS)


def odd_rows():
    r = random.Random(5)
    word = lambda: r.choice("abcdefghijklm") + str(r.randint(0, 99))
    text, long = " ".join(word() for _ in range(250)), " ".join(word() for _ in range(30_000))
    rows = [(1, None, "en"), (2, "", None), (3, " \t\n", ""), (4, text, "web"), (5, text, "web"), (5, text, "web"), (6, text.upper(), None), (None, text, "web"), (None, None, None), (7, long, "code"), (8, "word", "web"),
            (9, "가나다 😀 " * 130, "code"), (10, "#tag " * 210, "web"), (5, "other text", "web"), (11, text + " $", None), (12, "Ä ä A a", "web"), (13, "ä ä a a", "web"), (0, text, "code"), (0, text, "code")]
    return rows + [(20 + k, " ".join(word() for _ in range(r.randint(15, 60))), r.choice(["web", None, "code"])) for k in range(60)]


@pytest.fixture(scope="module")
def odd(spark):
    return made(spark, odd_rows()).repartition(5)


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def failing(rows):
    """The letters that each row fails, told one row at a time."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, s in rows:
        t, w = t or "", words_of(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        out.append((i, s or "", {k for k, v in f.items() if v}))
    return out


def test_audit_is_what_applying_the_filters_one_by_one_removes(spark, odd):
    labels = [(4, 1, 0, 9, "x"), (5, 1, 1, 9, "x"), (5, 0, 0, 9, "x"), (10, None, 1, 9, "x"), (None, 1, 1, 9, "x"), (7, 1, None, 9, "x"), (999, 1, 1, 9, "x")]
    good, toxic = {4, 5, 7}, {5, 10}
    found = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit(odd, spark.createDataFrame(labels, LABELS)).collect()}
    rows = failing(odd_rows())
    parts = {p for _, p, _ in rows}
    assert len(found) == len(parts) * 120 * 5
    shapley, want = Counter(), {}
    for part in parts:
        for order in permutations("ABCDE"):
            left = [(i, f) for i, p, f in rows if p == part]
            for step, letter in enumerate(order, 1):
                out = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                fails = [f for _, p, f in rows if p == part and letter in f]
                want[part, "".join(order), step] = [len(left), len(out), len(fails) - len(out), sum(f == {letter} for f in fails), sum(i in good for i, _ in out), sum(i in toxic for i, _ in out)]
                shapley[part, letter] += len(out)
    for (part, order, step), w in want.items():
        r = found[part, order, step]
        assert [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] == [*w, shapley[part, order[step - 1]]]


def test_audit_of_empty_tables(spark, odd):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(spark.createDataFrame([], DOCS), none).collect() == []
    assert sum(r["good_lost"] + r["toxic_lost"] for r in filter_audit.audit(odd, none).collect()) == 0


def brute_scores(rows, target, seed=7):
    def feats(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    s, t = Counter(), Counter()
    for _, text, _ in rows:
        s.update(feats(text)[1])
    for text in target:
        t.update(feats(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for i, text, _ in rows:
        n, f = feats(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_scores_and_ranks_are_those_of_brute_force(spark, odd):
    rows, target = odd_rows(), ["a1 b2 c3 d4 e5", None, "", "m7 m8 A9"]
    want = brute_scores(rows, target)
    found = resampling.resampled(odd, spark.createDataFrame([(t, 1) for t in target], "text string, n int")).collect()
    assert sorted((key(r[:4] + (0,))[:4] + key((r["score"],)) for r in found)) == sorted(key((i, nf, w, sc))[:3] + key((sc,)) * 2 for i, _, nf, w, sc in want)
    able = sorted((-sc, i is not None, i or 0, nf) for i, n, nf, _, sc in want if n >= 20)
    drawn = sorted((r["rank"], r["score"], r["doc_id"]) for r in found if r["rank"] is not None)
    assert drawn == [(k + 1, -s, i if has else None) for k, (s, has, i, _) in enumerate(able[: 25 * len(able) // 100])] != []
    ids = {d for _, _, d in drawn}
    kept = resampling.draw(odd, spark.createDataFrame([(t, 1) for t in target], "text string, n int")).collect()
    assert sorted(key((r["doc_id"],)) for r in kept) == sorted(key((i,)) for i, _, _ in rows if i in ids) and all(tuple(r[4:]) == REST for r in kept)


def test_ties_of_a_score_go_to_the_smaller_id_and_nothing_is_drawn_of_nothing(spark):
    rows = spark.createDataFrame([(i, 30, 5, 1, 100 if i % 2 else 200) for i in range(40)] + [(99, 3, 5, 1, 900)], "doc_id long, n_words long, n_features long, weight long, score long")
    rank = {r["doc_id"]: r["rank"] for r in resampling.ranked(rows, 60).collect()}
    assert [i for i, _ in sorted(((i, k) for i, k in rank.items() if k), key=lambda x: x[1])] == [*range(0, 40, 2), 1, 3, 5, 7] and rank[99] is None and len(rank) == 41
    none = spark.createDataFrame([], DOCS)
    assert resampling.resampled(none, none).collect() == []


def test_words_of_the_target_are_drawn_more_often(spark):
    r = random.Random(1)
    topic, other = [f"t{k}" for k in range(50)], [f"o{k}" for k in range(50)]
    docs = [(i, " ".join(r.choices(topic if i % 4 == 0 else other, k=40)), "web") for i in range(400)]
    found = resampling.draw(made(spark, docs), spark.createDataFrame([(" ".join(r.choices(topic, k=400)),)], "text string")).collect()
    # a quarter of the documents are on the topic; a plain draw of 100 would have some 25 of them
    assert len(found) == 100 and sum(x["doc_id"] % 4 == 0 for x in found) > 50


def groups_of(rows):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    out = {}
    for i, t, _ in rows:
        out.setdefault(hashlib.sha256(lower(t).encode()).hexdigest(), []).append(i)
    return out


@pytest.mark.parametrize("most_bits", [exact_dedup.MOST_BITS, exact_dedup.SEGMENT * 24])
def test_copies_are_those_of_brute_force_in_one_round_or_several(odd, most_bits):
    want = groups_of(odd_rows())
    found = exact_dedup.copies(odd, most_bits).collect()
    by = {}
    for r in found:
        by.setdefault(r["text_sha256"], []).append(r)
    assert {d: sorted(key((r["doc_id"],)) for r in g) for d, g in by.items()} == {d: sorted(key((i,)) for i in g) for d, g in want.items()}
    for digest, g in by.items():
        best = max((i for i in want[digest] if i is not None), default=None)
        assert {(r["keep_id"], r["group_size"]) for r in g} == {(best, len(g))}
        assert [r["doc_id"] for r in g if r["kept"]] == [best]
    kept = exact_dedup.deduplicated(odd, most_bits).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter(r["doc_id"] for r in found if r["kept"])
    assert all(tuple(r[4:]) == REST for r in kept)


def test_copies_of_an_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert exact_dedup.copies(none).collect() == [] == exact_dedup.deduplicated(none).collect()


def test_the_filter_misses_no_copy_and_lets_nearly_all_others_pass(spark):
    """Of 40,000 hashes in 12 tasks 2000 stand twice, in one task or two; and 5000 rows of one hash."""
    rows = common.materialize(spark.range(0, 47_000, 1, 12).selectExpr("case when id < 5000 then 7L else xxhash64(if(id >= 45000, id - 40000, id)) end as h", "id"))
    told = exact_dedup.possibly_repeated(rows).selectExpr("id", "repeated", "count(*) over (partition by h) > 1 as truly").collect()
    assert len(told) == 47_000 and all(r["repeated"] for r in told if r["truly"])
    alone = [r for r in told if not r["truly"]]
    assert len(alone) == 38_000 and sum(r["repeated"] for r in alone) < 0.01 * len(alone)
