"""Hot buckets of near dedup, the fitted classifier, and shards and stages against brute force."""

import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewell.llm import classifier, common, html_blocks, quality_rules, sharding, simhash  # noqa: E402


def words(seed, n):
    r = random.Random(seed)
    return [r.choice("abcdefghijklm") + str(r.randint(0, 999)) for _ in range(n)]


def variants(n, length, changed, seed):
    """Texts of one template in each of which some words, at places of its own, are changed to words of its own."""
    r, base = random.Random(seed), words(seed, length)
    out = []
    for k in range(n):
        w = list(base)
        for at in r.sample(range(length), changed):
            w[at] = f"own{k}x{at}"
        out.append(w)
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_variants_of_a_template_meet_nobody_however_many_they_are(spark):
    """5000 variants, alike at 0.5 to 0.75, that would be 12 million pairs in one bucket."""
    texts = variants(5000, 150, 4, 3)
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for w in texts]
    some = random.Random(1).sample(range(5000), 40)
    alike = [jaccard(sets[a], sets[b]) for a in some for b in some if a < b]
    assert 0.5 < np.quantile(alike, 0.1) and max(alike) < 0.8 and np.mean(alike) < 0.75
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(8)
    ids = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("class"))
    rare = common.materialize(simhash.rare_keys(simhash.shingle_sets(docs, ids.select("id")), ids, 0.8))
    assert rare.count() <= 5000 * (max(map(len, sets)) // 5 + 1)
    mixed = simhash.mixed_keys(rare)
    met = rare.join(mixed.select("key", "n"), "key").join(docs.select(F.col("doc_id").alias("id"), F.lit(bytes(64)).alias("bits")), "id")
    assert simhash.in_blocks(met).count() < 5000


def test_members_of_large_buckets_are_linked_as_brute_force_says(spark):
    """Every bucket of more than four rows counts as large: families within templates, some of whose members are alike at 0.8."""
    texts = [w for k in range(4) for v in variants(40, 120, 5, 50 + k) for w in (v, [*v[:60], f"more{k}", *v[61:]])]
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for w in texts]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    prints = common.materialize(spark.createDataFrame([(i, simhash.wide_bits(" ".join(w))[1]) for i, w in enumerate(texts)], "id long, bits binary"))
    links = {(r["src"], r["dst"]) for r in simhash.wide_links(prints, docs, bucket=4).collect()}
    assert all(jaccard(sets[a], sets[b]) >= 0.8 for a, b in links)
    reach = {i: i for i in range(len(texts))}

    def top(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for a, b in links:
        reach[top(a)] = top(b)
    near = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    assert len(near) >= 160 and sum(top(a) == top(b) for a, b in near) >= 0.99 * len(near)


def test_two_sets_alike_enough_share_a_rarest_shingle():
    r, counts = random.Random(5), np.random.RandomState(2).randint(0, 50, simhash.COUNTERS)
    for _ in range(300):
        whole = np.array([r.getrandbits(64) for _ in range(r.randint(1, 80))], np.uint64)
        a, b = (np.unique(np.array([x for x in whole if r.random() < 0.95] or whole[:1], np.uint64)) for _ in range(2))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            a, b = sorted((a, b), key=len)
            (x, short), (y, _) = (simhash.rarest(s, counts, 0.8) for s in (a, b))
            assert len(np.intersect1d(x[:short], y))


@pytest.fixture(scope="module")
def labelled(spark):
    """1200 documents of two sources: good prose and bad lists of few words; a label for half, some of them twice."""
    r = random.Random(6)
    rows, labels = [], []
    for i in range(1200):
        good = r.random() < 0.7
        text = " ".join(words(i, r.randint(60, 200))) if good else " ".join(r.choices(["BUY", "now!!", "$$$", "click"], k=r.randint(40, 200)))
        rows.append((i, text, "en", r.choice(["web", "news"] if good else ["web", "spam"]), len(text), 7, "z"))
        if i % 2:
            labels += [(i, int(good), 0)] * (1 + (i % 5 == 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, judged_by_ int, page string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r[1].split()[0] not in ("BUY", "now!!", "$$$", "click") for r in rows}


def test_a_fitted_classifier_beats_the_base_rate_on_both_labels(labelled):
    docs, labels, good = labelled
    told = {r["doc_id"]: r["accepted"] for r in classifier.score(docs, classifier.train(docs, labels)).collect() if r["doc_id"] % 2 == 0}
    for kind in (True, False):
        some = [i for i in told if good[i] == kind]
        assert sum(told[i] == kind for i in some) >= 0.95 * len(some) > 100


def test_held_out_labels_of_both_kinds(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    features = classifier.featured(docs)
    model = classifier.train_on(features, labels.where("doc_id % 5 <> 0"))
    told = classifier.score_features(features, model).join(labels.where("doc_id % 5 = 0 and quality is not null"), "doc_id").collect()
    for kind, least in ((1, 0.98), (0, 0.9)):
        some = [r for r in told if r["quality"] == kind]
        assert sum(r["accepted"] == bool(kind) for r in some) >= least * len(some) > 80


def test_a_fitted_model_and_its_training_on_odd_tables(spark, labelled):
    docs, labels, _ = labelled
    odd = [(5001, None, None, None, None, 1, "a"), (5002, "", "en", None, 0, 1, "a"), (5003, "word " * 50_000, "en", "web", 250_000, 1, "a"), (None, "no id", "en", "web", 5, 1, "a"), (None, None, None, None, None, 1, "a"), (5004, "twice", "en", "web", 5, 1, "a"), (5004, "twice", "en", "web", 5, 1, "a"), (5004, "other text", "xx", "web", 10, 1, "a"), (7, "an id of another", "en", "web", 16, 1, "a")]
    both = docs.union(spark.createDataFrame(odd, docs.schema))
    more = labels.union(spark.createDataFrame([(5001, 0, 0), (5004, None, 1), (None, 1, 0), (99_999, 1, 0), (7, None, None)], labels.schema))
    features = classifier.featured(both)
    assert features.count() == 1209
    model = classifier.train_on(features, more)
    scores = classifier.score_features(features, model).collect()
    assert len(scores) == 1209 and all(0 <= r["score"] <= 1 and r["accepted"] == (r["score"] >= 0.5) for r in scores)
    assert len({r["score"] for r in scores if r["doc_id"] == 5004}) == 2
    kept = classifier.accepted(both, model)
    assert kept.columns == both.columns and kept.count() == sum(r["accepted"] for r in scores)
    assert all((r["judged_by_"], r["page"]) in ((7, "z"), (1, "a")) for r in kept.collect())
    none = both.limit(0)
    assert classifier.accepted(none, model).collect() == [] == classifier.score(none, model).collect() and classifier.train(none, more) is None
    weights = {"text": model.text, "page": model.page}
    scale = {"text": model.text_scale, "page": model.page_scale}
    told = classifier.sure(features, weights, scale).collect()
    assert told and all(r["doc_id"] is not None and {r["text_label"], r["page_label"]} <= {None, 0.0, 1.0} for r in told)


def rich_text(ratio, share, r):
    """80 words in lines of four, of which about a share of words (or lines) shows what a ratio counts."""
    w = words(r.randint(0, 10**9), 80)
    for i in range(80):
        if r.random() < share:
            w[i] = {"symbols": w[i] + "#", "shouting": w[i].upper(), "long_words": w[i] * 7, "echoes": w[i - 1]}.get(ratio, w[i])
    lines = [" ".join(w[i : i + 4]) for i in range(0, 80, 4)]
    if ratio == "dup_lines":  # between other lines, so that no eight words are repeated
        lines = [r.choice(lines[:3]) if k > 3 and k % 2 and r.random() < share * 1.6 else x for k, x in enumerate(lines)]
    return "\n".join(lines)


@pytest.mark.parametrize("ratio", list(quality_rules.RATIOS))
def test_each_ratio_has_bounds_of_its_source(spark, ratio):
    """The same kind of text fails in a source that has none of it and passes in one whose documents often show it."""
    r = random.Random(9)
    rows = [(2 * k + s, rich_text(ratio, s * r.uniform(0, 0.5), r), "en", f"s{s}") for k in range(250) for s in (0, 1)]
    rows += [(1000 + 2 * k + s, rich_text(ratio, 0.6, random.Random(k)), "en", f"s{s}") for k in range(10) for s in (0, 1)]
    kept = {x["doc_id"]: x["kept"] for x in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(kept[i] for i in range(500)) >= 475  # ordinary documents of either source stay
    probes = [(kept[1000 + 2 * k], kept[1001 + 2 * k]) for k in range(10)]
    assert sum(not quiet and loud for quiet, loud in probes) >= 8


def test_what_is_allowed_grows_with_the_length_of_a_text(spark):
    long = words(1, 20_000)
    rows = [(k, " ".join(words(k, 100)), "en", "s") for k in range(200)] + [(900, " ".join(long[:-5] + ["5%"] * 5), "en", "s"), (901, " ".join(words(3, 90) + ["%%"] * 5), "en", "s"), (902, " ".join(long[:-1000] + ["50%"] * 1000), "en", "s")]
    kept = {x["doc_id"]: x["kept"] for x in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept[900] and not kept[901] and not kept[902] and all(kept[k] for k in range(200))


def test_formulas_stand_within_their_paragraph():
    page = "<article><p>Mass is <math><semantics><mrow><mi>m</mi><mo>=</mo><mn>3</mn></mrow><annotation>m=3</annotation></semantics></math> here.</p></article>"
    assert [b[0] for b in html_blocks.blocks(page)] == ["Mass is m=3 here."]


def test_shards_are_those_of_one_sort(spark):
    """Rows in order of id and text: what stands before a shard's end by bytes is told by sums over all rows."""
    r = random.Random(12)
    rows = [(r.choice([None, *range(400)]), None if r.random() < 0.05 else "é" * r.randint(0, 60), k) for k in range(3000)]
    told = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(6)).collect()
    assert sorted((str(x["doc_id"]), x["size"], x["text_crc32"]) for x in told) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    order = sorted(told, key=lambda x: (x["shard"], x["slot"]))
    ids = [-1 if x["doc_id"] is None else x["doc_id"] for x in order]
    assert ids == sorted(ids)
    for k in range(8):
        assert [x["slot"] for x in order if x["shard"] == k] == list(range(sum(x["shard"] == k for x in order)))
    ends, total, upto = [0], sum(x["size"] for x in order), 0
    for x in order:
        upto += x["size"]
        ends.append(upto)
    for k in range(1, 8):  # a boundary is as near to its share of the bytes as rows and the tolerance let it be
        at = sum(x["shard"] < k for x in order)
        assert abs(ends[at] - total * k / 8) <= min(abs(e - total * k / 8) for e in ends) + 0.001 * total / 8 + 1
