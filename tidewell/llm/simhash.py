"""SimHash fingerprints and near-duplicate links by covering locality-sensitive hashing.

A mask family for radius r gives every bit position a nonzero vector of r + 1 bits and takes, for each nonzero vector
v, the positions whose vector has an odd product with v.  The at most r positions in which two fingerprints differ
span less than the whole space, so some v is orthogonal to all of them: that mask sees equal bits.  Hence every pair
within the radius shares a bucket in at least one of the 2^(r+1) - 1 tables.

That holds for the 64-bit fingerprints and their radius.  The wide fingerprints only propose pairs: each of their words
covers one differing bit, so a pair at a likeness of 0.8 shares a bucket with a probability (the README gives it), and the
shingle sets themselves decide what is linked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import connected_components, discard, map_arrow, materialize, mix64, shingle_hashes, slices, word_hashes

BITS = 64


def covering_masks(bits: int, radius: int) -> list[int]:
    """One mask, as an integer with `bits` bits, for each of the 2^(radius+1) - 1 tables."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# --- 64-bit fingerprints over XXH64, linked exactly within a radius of 2


def simhash64(text: str | None, width: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the text's word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints64(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, bits): a signed 64-bit fingerprint for every document; null and wordless texts have 0."""

    def rows(ids, texts):
        return {"doc_id": ids, "bits": [signed(simhash64(t, width)) for t in texts]}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "doc_id long, bits long")


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """Links (src, dst) that join all of the distinct 64-bit fingerprints (column bits) within 2 bits of each other.

    Buckets of two are compared outright.  In a larger bucket, every member names the values that differ from it in at
    most one of the bits that the mask leaves free; members that name the same value are within 2 of each other, and
    those within 2 share such a value.  So a bucket of any size costs a fixed number of rows a member, and no pairs."""
    masks = covering_masks(BITS, 2)
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("bits").bitwiseAND(F.lit(signed(m))).alias("key"), F.col("bits").alias("bits")) for i, m in enumerate(masks)))
    rows = distinct.select(F.inline(tables))
    sizes = materialize(rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("bits").alias("a"), F.max("bits").alias("b")).where("n > 1"))
    few = sizes.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select(F.col("b").alias("src"), F.col("a").alias("dst"))
    many = rows.join(sizes.where("n > 2").select("t", "key"), ["t", "key"])
    flips = F.lit(None).cast("array<long>")
    for i, m in enumerate(masks):
        free = [signed(1 << k) for k in range(BITS) if not m >> k & 1]
        flips = F.when(F.col("t") == i, F.array(*map(F.lit, [0, *free]))).otherwise(flips)
    named = materialize(many.select("t", "bits", F.explode(flips).alias("flip")).select("t", "bits", F.col("bits").bitwiseXOR(F.col("flip")).alias("value")))
    stars = named.groupBy("t", "value").agg(F.min("bits").alias("dst"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = named.join(stars, ["t", "value"]).where("bits <> dst").select(F.col("bits").alias("src"), "dst")
    return few.union(near).distinct()


def near_duplicates64(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id reachable over fingerprints that
    differ in 2 bits or fewer.  One row for each row of docs, repeated and null ids included.

    Links are found between distinct fingerprints, so copies, wordless documents among them, cost one row each."""
    made = materialize(fingerprints64(docs, width))
    distinct = materialize(made.groupBy("bits").agg(F.min("doc_id").alias("least")))
    links = link_fingerprints(distinct.select("bits"))
    classes = connected_components(links)
    found = distinct.join(classes, distinct["bits"] == classes["node"], "left").select("bits", "least", F.coalesce("component", "bits").alias("class"))
    found = materialize(found)
    least = found.groupBy("class").agg(F.min("least").alias("component_id"))
    named = found.join(least, "class").select("bits", "component_id")
    return made.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


# --- wide fingerprints of five-word shingle sets, for a likeness of 0.8 or more

WIDE = 512
#: Least Jaccard likeness of two shingle sets that are linked.
LIKENESS = 0.8
#: Differing bits up to which the sets of a proposed pair are compared.  At a likeness of 0.8 the bits that differ are 78 of
#: 512 with a deviation of 8 (sets of 4 and 5: 96 and 9), in unrelated texts 256 with one of 11.
RADIUS = 128
#: Tables of the stars, and the most members of a bucket that are compared there; members of larger ones are known by their
#: rarest shingles.
STARS, BUCKET = 32, 1024
#: Counters by which shingles are told rare: a bound of what is sent to all tasks (8 MB), not of what is counted.
COUNTERS = 1 << 20


WORDS, WORD_BITS = 64, 36


def word_positions() -> list[np.ndarray]:
    """The bit positions of each covered word: the first 14 words part the fingerprint, the rest are drawn from it."""
    state = np.random.RandomState(7)
    order = np.concatenate([state.permutation(WIDE) for _ in range(-(-WORDS * WORD_BITS // WIDE))])
    return [order[i * WORD_BITS : (i + 1) * WORD_BITS] for i in range(WORDS)]


_POSITIONS = word_positions()
_MASKS = [np.array([m >> k & 1 for k in range(WORD_BITS)], bool) for m in covering_masks(WORD_BITS, 1)]
TABLES = [p[m] for p in _POSITIONS for m in _MASKS]
_WEIGHTS = (np.uint64(1) << np.arange(max(map(len, TABLES)), dtype=np.uint64)).astype(np.uint64)
_LANES = mix64(np.arange(1, WIDE // 64 + 1, dtype=np.uint64))


def _shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted hashes of the text's distinct word shingles; none without words."""
    return np.unique(shingle_hashes(word_hashes((text or "").encode())[0], width))


def majority(h: np.ndarray) -> bytes:
    """512 majority bits over a set of hashes; zeros for an empty one."""
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(h), 1 << 13):
        lanes = mix64(h[at : at + (1 << 13), None] ^ _LANES[None, :])
        ones += np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def wide_bits(text: str | None, width: int = 5) -> tuple[int, bytes]:
    """Number of distinct word shingles of the text, and 512 majority bits over their set; none and zeros without words."""
    h = _shingles(text, width)
    return len(h), majority(h)


def table_keys(bits: np.ndarray, tables: int) -> np.ndarray:
    """Rows of signed bucket keys, a column for each of the first `tables` tables, for rows of 512 bits."""
    out = np.empty((len(bits), tables), np.uint64)
    for t, at in enumerate(TABLES[:tables]):
        out[:, t] = (bits[:, at] * _WEIGHTS[: len(at)]).sum(1, dtype=np.uint64) | np.uint64(t << 40)
    return out.view(np.int64)


def likenesses(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Jaccard likeness of a set with each of some others; sets are sorted arrays of distinct values, none empty."""
    sizes = np.array([len(x) for x in others])
    joined = np.concatenate(others)
    found = one[np.minimum(np.searchsorted(one, joined), len(one) - 1)] == joined
    common = np.add.reduceat(found, np.cumsum(sizes) - sizes, dtype=np.int64)
    return common / (len(one) + sizes - common)


def forest(bits: np.ndarray, sets: list[np.ndarray], classes: list[int], radius: int, likeness: float) -> list[tuple[int, int]]:
    """Edges between rows of different classes whose packed bits differ in at most `radius` places and whose sets are alike
    at `likeness` or more; with the classes they join whatever all such pairs join.

    Visited rows are compared with those not yet visited only, and rows of a visited class are visited without a comparison."""
    left, edges, classes = np.arange(len(bits)), [], np.asarray(classes)
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            same = classes[left] == classes[at]
            near = ~same & (np.bitwise_count(bits[left] ^ bits[at]).sum(1) <= radius)
            if near.any():
                near[near] = likenesses(sets[at], [sets[i] for i in left[near]]) >= likeness
            edges += [(int(at), int(x)) for x in left[near]]
            frontier += left[same | near].tolist()
            left = left[~(same | near)]
    return edges


def beside_others(bits: np.ndarray, classes: list[int], radius: int) -> np.ndarray:
    """Which rows differ in at most `radius` bits from a row of another class."""
    classes, out = np.asarray(classes), np.zeros(len(bits), bool)
    for at in range(len(bits) - 1):
        near = (classes[at + 1 :] != classes[at]) & (np.bitwise_count(bits[at + 1 :] ^ bits[at]).sum(1) <= radius)
        if near.any():
            out[at] = True
            out[at + 1 :] |= near
    return out


def _as_sets(values) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in values]


def _packed(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint64).reshape(-1, WIDE // 64)


def _per_group(rows: DataFrame, by: list[str], made, schema: str) -> DataFrame:
    """made(key, columns) for the rows of each group of equal `by`, columns being lists without those of `by`; one group at
    a time is held.  The groups are cut to a bounded number of rows before."""
    k = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out():
            found = made(key, *zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found.values()], names=list(found))

        for b in slices(batches):
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:k] != key:
                    if len(held) > 1:
                        yield out()
                    key, held = row[:k], []
                held.append(row[k:])
        if len(held) > 1:
            yield out()

    return rows.repartition(*by).sortWithinPartitions(*by, "id").mapInArrow(run, schema)


def bucket_keys(rows: DataFrame, tables: int) -> DataFrame:
    """(id, class, key) of rows (id, class, bits as 64 bytes) for the first `tables` tables."""

    def keys(ids, classes, bits):
        made = table_keys(np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(-1, WIDE // 8), axis=1, bitorder="little"), tables)
        return {"id": np.repeat(np.asarray(ids, np.int64), tables), "class": np.repeat(np.asarray(classes, np.int64), tables), "key": made.ravel()}

    return map_arrow(rows.select("id", "class", "bits"), keys, "id long, class long, key long")


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, bits, set): wide fingerprints and the sorted 64-bit hashes of the shingles of the texts under the distinct ids."""

    def made(ids, texts):
        sets = [_shingles(t) for t in texts]
        return {"doc": ids, "bits": [majority(s) for s in sets], "set": [s.tobytes() for s in sets]}

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(ids, "id", "left_semi")
    return materialize(map_arrow(texts, made, "doc long, bits binary, set binary").where("length(set) > 0").dropDuplicates(["doc", "set"]))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def _joined(pairs: DataFrame, rows: DataFrame, id: str, column: str) -> DataFrame:
    one, two = rows.select(F.col(id).alias("a"), F.col(column).alias("x")), rows.select(F.col(id).alias("b"), F.col(column).alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")


def near_pairs(pairs: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """The pairs (a, b) whose wide fingerprints differ in at most `radius` bits."""
    return materialize(map_arrow(_joined(pairs, prints, "id", "bits"), lambda a, b, x, y: _within(a, b, x, y, radius), "a long, b long").where("a is not null"))


def alike_pairs(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """Links (src, dst) for the pairs (a, b) whose sets are alike at `likeness` or more."""

    def compared(a, b, x, y):
        near = [likenesses(p, [q])[0] >= likeness for p, q in zip(_as_sets(x), _as_sets(y))]
        return {"src": [j if n else None for j, n in zip(b, near)], "dst": [i if n else None for i, n in zip(a, near)]}

    return map_arrow(_joined(pairs, sets, "doc", "set"), compared, "src long, dst long").where("src is not null")


def star_links(prints: DataFrame, docs: DataFrame, radius: int, likeness: float) -> DataFrame:
    """Links between members of the buckets of the first tables and the least id there, where their sets are alike.  A group
    of near copies costs a pair a member and table at most, and what is linked here need not be compared again."""
    rows = bucket_keys(prints.withColumn("class", F.col("id")), STARS).withColumnRenamed("key", "bucket")
    found = materialize(rows.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).where("n > 1"))
    stars = rows.join(found.where("n > 2").select("bucket", "a"), "bucket").where("a < id").select("a", F.col("id").alias("b"))
    pairs = found.where("n = 2").select("a", "b").union(stars).distinct()
    near = near_pairs(pairs, prints, radius)
    return materialize(alike_pairs(near, shingle_sets(docs, _ends(near)), likeness))


def in_blocks(members: DataFrame, block: int = BUCKET) -> DataFrame:
    """members (key, id, class, bits, n: rows of the key) dealt to groups (key, i, j) so that any two members of different
    classes meet in a group, of at most two blocks of about `block` rows each; a bucket of no more rows is one group.

    The rows of a large bucket's largest class go to their own block only, once for each block of the others, and never meet
    each other; so a bucket of one huge class and a few other rows costs a row a member."""
    whole = F.lit(-1).cast("long")
    few = members.where(F.col("n") <= block).select("key", whole.alias("i"), whole.alias("j"), "id", "class", "bits")
    many = members.where(F.col("n") > block)
    counts = many.groupBy("key", "class").agg(F.count("*").alias("c"))
    largest = counts.groupBy("key").agg(F.max(F.struct("c", "class")).alias("top"))
    both = many.join(largest.select("key", F.col("top.class").alias("main"), F.col("top.c").alias("mains")), "key")
    a, o = (F.ceil(F.greatest(x, F.lit(1)) / block) for x in (F.col("mains"), F.col("n") - F.col("mains")))
    own = lambda blocks: F.pmod(F.xxhash64("id"), blocks)
    upto = lambda blocks: F.sequence(F.lit(0).cast("long"), blocks - 1)
    mains = F.transform(upto(o), lambda j: F.struct(own(a).alias("i"), j.alias("j")))
    others = F.transform(upto(a), lambda i: F.struct(i.alias("i"), own(o).alias("j")))
    among = F.transform(upto(o), lambda k: F.struct((-2 - F.least(own(o), k)).alias("i"), F.greatest(own(o), k).alias("j")))
    groups = F.when(F.col("class") == F.col("main"), mains).otherwise(F.concat(others, among))
    return few.union(both.select("key", F.inline(groups), "id", "class", "bits"))


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle that falls to each of COUNTERS counters, by its first bits. Tasks send the counters that they
    use; the driver gets COUNTERS numbers at most, whatever the number of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(COUNTERS, np.int64)
        for b in slices(batches):
            for s in _as_sets(b.column(0).to_pylist()):
                sums += np.bincount(s >> np.uint64(64 - COUNTERS.bit_length() + 1), minlength=COUNTERS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["counter", "n"])

    out = np.zeros(COUNTERS, np.int64)
    for r in sets.select("set").mapInArrow(run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["counter"]] = r["n"]
    return out


def rarest(one: np.ndarray, counts: np.ndarray, likeness: float) -> tuple[np.ndarray, int]:
    """A set's shingles from the rarest on, in an order that is the same for all sets, and two lengths of this list's beginning:
    of two sets alike at `likeness` or more, the longer one's (all that is given) and the shorter one's (the number) share one."""
    n = len(one)
    keep, short = (n - int(np.ceil(share * n - 1e-9)) + 1 for share in (likeness, 2 * likeness / (1 + likeness)))
    return one[np.lexsort((one, counts[one >> np.uint64(64 - COUNTERS.bit_length() + 1)]))[:keep]], short


def rare_keys(sets: DataFrame, classes: DataFrame, likeness: float) -> DataFrame:
    """(id, class, key) of sets (doc, set): the shingles by which sets alike enough are sure to meet, as keys below zero, which no
    bucket has.

    A set is listed under its rarest shingles, under some as the shorter of two and under all of them as the longer. Where two
    meet first, what lies before that place is not shared; so each listing tells up to which size the other set could still be
    alike enough, and those that fit none of the other side's leave. Sets of one template each of which has some 11 % of its
    shingles for itself list the template's shingles as the longer ones only, and meet nobody, however many they are."""
    counts = shingle_counts(sets)
    share = likeness / (1 + likeness)

    def rows(ids, classes, some):
        out = {k: [] for k in ("id", "class", "key", "n", "reach", "shorter")}
        for i, c, s in zip(ids, classes, _as_sets(some)):
            first, short = rarest(s, counts, likeness)
            k, at = len(first), np.arange(len(first))
            made = {"id": np.full(k, i), "class": np.full(k, c), "key": (first | np.uint64(1 << 63)).view(np.int64), "n": np.full(k, len(s)), "reach": np.floor((len(s) - at) / share - len(s) + 1e-6).astype(np.int64), "shorter": at < short}
            for name, v in made.items():
                out[name].append(v)
        return {name: np.concatenate(v) for name, v in out.items()}

    both = sets.join(classes, sets["doc"] == classes["id"]).select("id", "class", "set")
    listed = materialize(map_arrow(both, rows, "id long, class long, key long, n long, reach long, shorter boolean"))
    fits = listed.groupBy("key").agg(F.min(F.when(F.col("shorter"), F.col("n"))).alias("least"), F.max("reach").alias("most")).where("least <= most")
    kept = materialize(listed.join(fits, "key").where("reach >= least or (shorter and n <= most)").select("id", "class", "key").distinct())
    discard(listed)
    return kept


def mixed_keys(rows: DataFrame) -> DataFrame:
    """(key, n, min_id, max_id) of the keys of rows (id, class, key) under which different classes stand."""
    ends = (f(c).alias(f.__name__ + "_" + c) for c in ("id", "class") for f in (F.min, F.max))
    return materialize(rows.groupBy("key").agg(F.count("*").alias("n"), *ends).where("min_class < max_class"))


def wide_links(prints: DataFrame, docs: DataFrame, radius: int = RADIUS, likeness: float = LIKENESS, bucket: int = BUCKET) -> DataFrame:
    """Links (src, dst) between the ids of prints (id, bits as 64 bytes) that share a bucket and whose texts in docs
    (doc_id, text) have shingle sets alike at `likeness` or more; the links join whatever such pairs join.

    Stars over the first tables link most near copies.  Then only buckets that hold different classes are read: those of two
    rows as pairs, each other one in order, yielding fewer links than it has members.  Members of a bucket of more than `bucket`
    rows don't meet there: each of them, once for all its large buckets, is listed under the rarest shingles of its text, by
    which all pairs that are alike enough are sure to meet.  Rows that no row of another class is near by their bits leave
    before any text is made into a set."""
    stars = star_links(prints, docs, radius, likeness)
    classes = connected_components(stars)
    named = materialize(prints.join(classes, prints["id"] == classes["node"], "left").select("id", "bits", F.coalesce("component", "id").alias("class")))
    rows = bucket_keys(named, len(TABLES))
    mixed = mixed_keys(rows)
    met = materialize(rows.join(mixed.where("n > 2").select("key", "n").hint("merge"), "key"))  # a merge join at any size
    few, held = mixed.where(F.col("n") <= bucket), met.where(F.col("n") <= bucket)
    crowd = materialize(met.where(F.col("n") > bucket).select("id", "class").distinct())
    if not crowd.isEmpty():
        sets = shingle_sets(docs, crowd.select("id"))
        rare = rare_keys(sets, crowd, likeness)
        discard(sets)
        more = mixed_keys(rare)
        few, held = few.unionByName(more), held.unionByName(rare.join(more.where("n > 2").select("key", "n"), "key"))
    pairs = near_pairs(few.where("n = 2").select(F.col("min_id").alias("a"), F.col("max_id").alias("b")).distinct(), prints, radius)
    members = materialize(held.join(prints.select("id", "bits"), "id"))
    discard(met)
    by = ["key", "i", "j"]

    def beside(key, ids, classes, bits):
        near = [(*key, i, c) for i, c, n in zip(ids, classes, beside_others(_packed(bits), classes, radius)) if n]
        return dict(zip([*by, "id", "class"], list(zip(*near)) or [[]] * 5))

    near = materialize(_per_group(in_blocks(members), by, beside, "key long, i long, j long, id long, class long"))
    sets = shingle_sets(docs, _ends(pairs).union(near.select("id")).distinct())

    def linked(_, ids, classes, bits, some):
        found = forest(_packed(bits), _as_sets(some), classes, radius, likeness)
        return {"src": [max(ids[i], ids[j]) for i, j in found], "dst": [min(ids[i], ids[j]) for i, j in found]}

    read = near.join(sets, near["id"] == sets["doc"]).select(*by, "id", "class", "bits", "set")
    more = _per_group(read, by, linked, "src long, dst long")
    return stars.union(alike_pairs(pairs, sets, likeness)).union(more).distinct()


def _within(a, b, x, y, radius):
    p, q = _packed(x), _packed(y)
    near = np.bitwise_count(p ^ q).sum(1) <= radius
    return {"a": [i if n else None for i, n in zip(a, near)], "b": [j if n else None for j, n in zip(b, near)]}


def _classes(docs: DataFrame, radius: int) -> DataFrame:
    """(doc_id, mark: a hash of the text, class_id) for each row with an id."""

    def rows(ids, texts, marks):
        found = [wide_bits(t) for t in texts]
        return {"doc_id": ids, "mark": marks, "n": [n for n, _ in found], "bits": [b for _, b in found]}

    text = F.col("text").cast("string")
    read = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("mark"))
    made = materialize(map_arrow(read, rows, "doc_id long, mark long, n int, bits binary"))
    prints = materialize(made.groupBy("n", "bits").agg(F.min("doc_id").alias("id")))
    classes = connected_components(wide_links(prints.where("n > 0"), docs, radius))
    found = prints.join(classes, prints["id"] == classes["node"], "left").select("n", "bits", F.coalesce("component", "id").alias("class_id"))
    return made.join(found, ["n", "bits"]).select("doc_id", "mark", "class_id")


def near_duplicate_classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, class_id): the classes of documents joined by pairs whose five-word shingle sets are alike at 0.8 or more,
    copies (equal fingerprints and numbers of shingles) included; class_id is the least doc_id.  No other pair is linked;
    a pair near 0.8 may be passed over where its wide fingerprints share no bucket.

    Wordless and null texts form one class.  Null ids give no row; repeated ids give a row each."""
    return _classes(docs, radius).select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the near duplicates of a document with a smaller id: one row of each class stays.  Rows that repeat id and
    text stay once; of different texts under one id each is judged for itself; rows with a null id all stay."""
    first = _classes(docs, RADIUS).where("doc_id = class_id").select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark")).distinct()
    same = (docs["doc_id"].cast("long") == first["kept_id"]) & (F.xxhash64(docs["text"].cast("string")) == first["kept_mark"])
    return docs.join(first, same, "left_semi").dropDuplicates(["doc_id", "text"]).union(docs.where("doc_id is null"))
