"""Joins of alike sets and of names that contain each other, without comparing all pairs.

Each set is known by its rarest members and each name by its rarest run of characters; only those that share one are compared,
and every comparison that follows is exact. Sets of which nearly all share their rarest members are compared in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.numbers import set_key
from tidewell.operators.storage import written

#: So many pairs make a crowd, if nothing is rare among them; what a pair of a crowd costs next to one that is met at a rare
#: member; members of a block, those of equal sets counted too; words of 64 sets that are counted side by side, and sets that
#: they are counted for at once; words with answers, and pairs of rows, that are told at once.
CROWD, COST, BLOCK, COLUMNS, SLICE, TOLD = 1 << 16, 1 / 20, 1 << 20, 512, 32, 1 << 16


def _ranked(sets: DataFrame, by: list[str]) -> DataFrame:
    """Distinct sets (by, side_, rows_, set_) with id_ and ranked_, written: the numbers of their members, those that fewer sets
    of the same `by` hold first. side_ has the letters of the sides that a set is of, rows_ is how many rows have it."""
    sets = written(sets.withColumn("id_", F.monotonically_increasing_id()))
    each = sets.select(*by, "side_", "rows_", "id_", F.explode("set_").alias("member_"))
    counts = written(each.groupBy(*by, "member_").agg(F.count("*").alias("n_")).withColumn("code_", F.monotonically_increasing_id()))
    ranked = each.join(counts, [*by, "member_"]).groupBy(*by, "side_", "rows_", "id_").agg(F.array_sort(F.collect_list(F.struct("n_", "code_", "member_"))).alias("r_"))
    return written(ranked.select(*by, "side_", "rows_", "id_", F.array_sort("r_.member_").alias("set_"), F.col("r_.code_").alias("ranked_")))


def _of(side: str) -> Column:
    return F.contains("side_", F.lit(side))


def _prefixes(ranked: DataFrame, by: list[str], least: float, side: str) -> DataFrame:
    """A row for each of a set's rarest members, so many that two sets alike at `least` or more share one of theirs."""
    n = F.size("ranked_")
    keep = n - F.ceil(n * F.lit(least) - 1e-9).cast("int") + 1
    rows = ranked.where(_of(side)).select(*by, F.col("id_").alias(f"{side}_id"), F.col("ranked_").alias(f"{side}_ranked"), F.posexplode(F.slice("ranked_", F.lit(1), F.greatest(keep, F.lit(1)))).alias(f"{side}_at", "member_"))
    return rows.withColumn(f"{side}_n", F.size(f"{side}_ranked"))


def _sides(left: DataFrame, right: DataFrame, members: str, by: list[str]) -> DataFrame:
    """_ranked of the sets of both sides."""
    side = lambda df, s: df.select(*by, F.lit(s).alias("side_"), F.lit(1).alias("rows_"), set_key(members).alias("set_")).where(F.size("set_") > 0).distinct()
    return _ranked(side(left, "l").unionByName(side(right, "r")), by)


def _crowds(ranked: DataFrame, by: list[str], least: float) -> DataFrame:
    """(by, crowd_, l_blocks_, r_blocks_) of the `by` in which it costs less to compare all pairs than those that share one of
    their rarest members, each as often as it shares one: nothing is rare there."""
    sides = [F.count(F.when(_of(s), 1)).alias(f"{s}_sets") for s in "lr"] + [F.sum(F.when(_of(s), F.col("rows_") * F.size("ranked_"))).alias(f"{s}_members") for s in "lr"]
    held = [_prefixes(ranked, by, least, s).groupBy(*by, "member_").agg(F.count("*").cast("double").alias(f"{s}_held")) for s in "lr"]
    met = held[0].join(held[1], [*by, "member_"]).groupBy(*by).agg(F.sum(F.col("l_held") * F.col("r_held")).alias("met_"))
    pairs = F.col("l_sets").cast("double") * F.col("r_sets")
    blocks = [F.greatest(F.ceil(F.col(f"{s}_members") / BLOCK), F.least(F.lit(16), F.ceil(F.col(f"{s}_sets") / 4096))).cast("int").alias(f"{s}_blocks_") for s in "lr"]
    crowded = ranked.groupBy(*by).agg(*sides).join(met, by).where((pairs >= CROWD) & (F.col("met_") > pairs * COST))
    return written(crowded.select(*by, F.monotonically_increasing_id().alias("crowd_"), *blocks))


def _rare_pairs(ranked: DataFrame, by: list[str], least: float) -> DataFrame:
    """(l_id, r_id, l_ranked, r_ranked) of sets that share a rare member and may be alike, each pair once.

    A pair is met at the first member that the two have in common, in one order of rarity for both. It is passed over there if
    the sizes, or the members that are left behind that one, can't make it alike enough."""
    l, r = (_prefixes(ranked, by, least, s) for s in "lr")  # noqa: E741
    both = l.join(r, [*by, "member_"])
    n, m = F.col("l_n"), F.col("r_n")
    both = both.where((F.least(n, m) >= F.greatest(n, m) * least - 1e-9) & (F.least(n - F.col("l_at"), m - F.col("r_at")) >= (n + m) * (least / (1 + least)) - 1e-9))
    first = F.size(F.array_intersect(F.slice("l_ranked", F.lit(1), F.col("l_at") + 1), F.slice("r_ranked", F.lit(1), F.col("r_at") + 1))) == 1
    return both.where(first).select("l_id", "r_id", "l_ranked", "r_ranked")


def _rare_alike(ranked: DataFrame, by: list[str], least: float) -> DataFrame:
    """(l_id, r_id, similarity) of the alike ones of _rare_pairs."""
    both = F.size(F.array_intersect("l_ranked", "r_ranked"))
    similarity = both / (F.size("l_ranked") + F.size("r_ranked") - both)
    return _rare_pairs(ranked, by, least).select("l_id", "r_id", similarity.alias("similarity")).where(F.col("similarity") >= least)


def _least_shared(n: np.ndarray, m: int, least: float) -> np.ndarray:
    """How many members sets of n and of m members must share; more than either has where the sizes alone forbid it."""
    tried = np.floor((n + m) * (least / (1 + least))).astype("int64")[:, None] + np.arange(-1, 3)
    tried = np.maximum(tried, 1)
    return tried[np.arange(len(n)), (tried / np.maximum((n + m)[:, None] - tried, 1) >= least).argmax(axis=1)]


def _sums(held: np.ndarray, asked: np.ndarray, free: list[np.ndarray]) -> list[np.ndarray]:
    """For each row of `asked` (places in held) and each bit of its words, how many of the places have the bit, in planes of bits.

    Bits of 64 sets are added in one go: three planes of equal weight become their sum and a carry of twice that weight."""
    planes = [[] for _ in range(asked.shape[1].bit_length())]

    def add(at: int, plane: np.ndarray) -> None:
        planes[at].append(plane)
        if len(planes[at]) < 3:
            return
        (x, y, z), t = planes[at], free.pop()
        np.bitwise_xor(x, y, out=t)
        np.bitwise_and(x, y, out=y)
        np.bitwise_and(t, z, out=x)
        np.bitwise_or(x, y, out=y)
        np.bitwise_xor(t, z, out=z)
        free.extend((x, t))
        planes[at] = [z]
        add(at + 1, y)

    for k in range(asked.shape[1]):
        own = free.pop()
        np.take(held, asked[:, k], axis=0, out=own, mode="clip")
        add(0, own)
    for at in range(len(planes)):
        if len(planes[at]) == 2:
            (x, y), t = planes[at], free.pop()
            np.bitwise_and(x, y, out=t)
            np.bitwise_xor(x, y, out=x)
            free.append(y)
            planes[at] = [x]
            add(at + 1, t)
    return [p[0] for p in planes]


def _reached(planes: list[np.ndarray], need: np.ndarray, out: np.ndarray) -> None:
    """out: the bits of which the number in planes is that of their word in need, or more. Words of one need stand together."""
    for begin, end in zip(cuts := [0, *(np.flatnonzero(np.diff(need)) + 1)], [*cuts[1:], len(need)]):
        least, part = int(need[begin]), out[:, begin:end]
        lowest = (least & -least).bit_length() - 1
        part[...] = planes[lowest][:, begin:end]
        for k in range(lowest + 1, len(planes)):
            (np.bitwise_and if least >> k & 1 else np.bitwise_or)(part, planes[k][:, begin:end], out=part)


def _shared(left: pa.Array, right: pa.Array, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in left, places in right, similarity) of the alike ones of two lists of sets (lists of numbers).

    The left sets are held as bits, for each member a word of 64 sets after another, in order of size; for each right set the
    words of its members are added up."""
    sizes, others = (pc.list_value_length(s).to_numpy(zero_copy_only=False).astype("int64") for s in (left, right))
    order, turn = np.argsort(sizes, kind="stable"), np.argsort(others, kind="stable")
    vocabulary, codes = np.unique(left.take(pa.array(order)).flatten().to_numpy(), return_inverse=True)
    # Sets of a word are of one size, so that it tells how many members they must share
    kinds, begins, counts = np.unique(sizes[order], return_index=True, return_counts=True)
    words = -(-counts // 64)
    word_size = np.repeat(kinds, words)
    slot = np.arange(len(order)) + np.repeat(np.cumsum(words * 64) - words * 64 - begins, counts)
    place = np.zeros(len(word_size) * 64, "int64")
    place[slot] = order
    slots = np.repeat(slot, sizes[order])
    asked = right.take(pa.array(turn)).flatten().to_numpy()
    at = np.minimum(np.searchsorted(vocabulary, asked), len(vocabulary) - 1)
    # What no left set has is looked for in a row of zeros
    asked = np.where(vocabulary[at] == asked, at, len(vocabulary))
    r_kinds, r_begins, r_counts = np.unique(others[turn], return_index=True, return_counts=True)
    r_starts = np.cumsum(r_kinds * r_counts) - r_kinds * r_counts
    wide = int(np.clip((1 << 24) // (64 * (len(vocabulary) + 1)), 1, COLUMNS))

    for first in range(0, len(word_size), wide):
        size = word_size[first : first + wide]
        lo, hi = np.searchsorted(slots, (first * 64, (first + len(size)) * 64))
        bits = np.zeros((len(vocabulary) + 1, len(size) * 64), "uint8")
        bits[codes[lo:hi], slots[lo:hi] - first * 64] = 1
        columns = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("uint64")
        del bits
        for m, begin, count, start in zip(r_kinds.tolist(), r_begins.tolist(), r_counts.tolist(), r_starts.tolist()):
            need = _least_shared(size, m, least)
            fit = np.flatnonzero(need <= np.minimum(size, m))
            if not len(fit):
                continue
            lo, hi, depth = int(fit[0]), int(fit[-1]) + 1, m.bit_length()
            held, need, n = np.ascontiguousarray(columns[:, lo:hi]), np.minimum(need[lo:hi], m), size[lo:hi]
            rows = asked[start : start + m * count].reshape(count, m)
            many, free, found, n_found = max(SLICE * COLUMNS // (hi - lo), 1), [], [], 0
            for k in range(0, count, many):
                part = rows[k : k + many]
                if not free or free[0].shape[0] != len(part):
                    free = [np.empty((len(part), hi - lo), "uint64") for _ in range(3 * depth + 3)]
                sums, reached = _sums(held, part, free), free.pop()
                _reached(sums, need, reached)
                hit = np.flatnonzero(reached.ravel() != 0)
                found.append((k + hit // (hi - lo), hit % (hi - lo), reached.ravel()[hit], np.stack([s.ravel()[hit] for s in sums])))
                free.extend((*sums, reached))
                n_found += len(hit)
                if n_found < TOLD and k + many < count:
                    continue
                r, word, reached, sums = (np.concatenate(f, axis=-1) for f in zip(*found))
                found, n_found = [], 0
                hits = np.flatnonzero(np.unpackbits(reached.view("uint8"), bitorder="little").view("bool"))
                for part in np.split(hits, range(TOLD, len(hits), TOLD)):
                    at, bit = part // 64, part % 64
                    both = ((sums[:, at] >> bit.astype("uint64") & np.uint64(1)).astype("int64") << np.arange(depth)[:, None]).sum(axis=0)
                    similarity = both / (n[word[at]] + m - both)
                    fits = similarity >= least
                    yield place[(first + lo + word[at]) * 64 + bit][fits], turn[begin + r[at]][fits], similarity[fits]


def _by_set(block: pa.RecordBatch) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Of a block (id, key, set): its distinct sets, its keys in order of their sets, and where each set's begin and how many."""
    _, first, at, copies = np.unique(block.column(0).to_numpy(), return_index=True, return_inverse=True, return_counts=True)
    return block.column(2).take(pa.array(first)), block.column(1).take(pa.array(np.argsort(at, kind="stable"))), np.cumsum(copies) - copies, copies


def _alike(left: pa.RecordBatch, right: pa.RecordBatch | None, least: float) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """(keys of left, keys of right, similarity) of the pairs of rows of two blocks that are alike; without a right block those
    of the left one, each pair once and no row with itself. Equal sets are compared once."""
    l_sets, l_keys, l_first, l_copies = _by_set(left)
    r_sets, r_keys, r_first, r_copies = _by_set(right) if right is not None else (l_sets, l_keys, l_first, l_copies)
    for l, r, similarity in _shared(l_sets, r_sets, least):  # noqa: E741
        if right is None:
            l, r, similarity = l[l <= r], r[l <= r], similarity[l <= r]  # noqa: E741
        ends = np.cumsum(l_copies[l] * r_copies[r])
        for begin in range(0, int(ends[-1]) if len(ends) else 0, TOLD):
            pair = np.arange(begin, min(begin + TOLD, ends[-1]))
            at = np.searchsorted(ends, pair, side="right")
            back, copies = ends[at] - 1 - pair, r_copies[r[at]]
            x, y, told = l_first[l[at]] + back // copies, r_first[r[at]] + back % copies, similarity[at]
            if right is None:
                once = (l[at] != r[at]) | (x < y)
                x, y, told = x[once], y[once], told[once]
            yield l_keys.take(pa.array(x)), r_keys.take(pa.array(y)), pa.array(told)


def _crowded_pairs(rows: DataFrame, crowds: DataFrame, by: list[str], least: float, same: bool = False) -> DataFrame:
    """(crowd_, l_key, r_key, similarity) of the alike ones of the crowds' rows (by, side_, rows_, id_ of the set, key_,
    ranked_). Each side's rows are dealt to blocks by their sets, every block of one side meets each of the other in some task,
    and a task holds two blocks at a time. If both sides are the same table, two blocks meet once, and the lesser key is l_key.
    Of a set with very many rows, these are dealt too."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rows_") * F.size("ranked_") * 4 / BLOCK))
    own = lambda n: F.pmod(F.xxhash64("id_", F.when(parts > 1, F.pmod(F.xxhash64("key_"), parts))), F.col(n)).cast("int")
    rows = rows.join(crowds, by)
    met, columns = ["crowd_", "l_at_", "r_at_"], ["id_", "key_", "ranked_"]
    kept = ["r_blocks_", *columns]
    if same:
        each = rows.select("crowd_", *kept, own("l_blocks_").alias("own_"), every("l_blocks_").alias("other_"))
        dealt = each.select("crowd_", F.least("own_", "other_").alias("l_at_"), F.greatest("own_", "other_").alias("r_at_"), (F.col("other_") < F.col("own_")).cast("int").alias("is_r_"), *kept)
    else:
        l = rows.where(_of("l")).select("crowd_", own("l_blocks_").alias("l_at_"), every("r_blocks_").alias("r_at_"), F.lit(0).alias("is_r_"), *kept)  # noqa: E741
        r = rows.where(_of("r")).select("crowd_", every("l_blocks_").alias("l_at_"), own("r_blocks_").alias("r_at_"), F.lit(1).alias("is_r_"), *kept)
        dealt = l.unionByName(r)
    n = F.col("l_blocks_").cast("long")
    meetings = crowds.agg(F.sum(n * (n + 1) / 2 if same else n * F.col("r_blocks_"))).first()[0] or 1
    # Some pairs of blocks to a task, as many to each; by their own number, as hashes would leave some tasks with many more
    tasks = int(min(meetings, 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    turn = F.xxhash64("crowd_") % tasks + (F.col("r_at_") * (F.col("r_at_") + 1) / 2 + F.col("l_at_") if same else F.col("l_at_") * F.col("r_blocks_") + F.col("r_at_"))
    dealt = dealt.repartitionById(tasks, F.pmod(turn.cast("long"), F.lit(tasks)).cast("int")).sortWithinPartitions(*met, "is_r_").select(*met, "is_r_", *columns)

    def compared(at: tuple[int, int, int], sides: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        if not sides[0] or not (sides[1] or same and at[1] == at[2]):
            return
        left, right = (pa.Table.from_batches(s).combine_chunks().to_batches()[0] if s else None for s in sides)
        for l, r, similarity in _alike(left, right, least):  # noqa: E741
            if same:
                differ = pc.not_equal(l, r)
                l, r, similarity = pc.min_element_wise(l, r).filter(differ), pc.max_element_wise(l, r).filter(differ), similarity.filter(differ)  # noqa: E741
            yield pa.RecordBatch.from_arrays([pa.repeat(at[0], len(l)), l, r, similarity], names=["crowd_", "l_key", "r_key", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = (), ([], [])
        for b in batches:
            key = np.stack([b.column(i).to_numpy() for i in range(4)])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), b.num_rows] if b.num_rows else []
            for begin, end in zip(cuts, cuts[1:]):
                if now != (at := tuple(key[:3, begin].tolist())):
                    yield from compared(now, sides)
                    now, sides = at, ([], [])
                sides[key[3, begin]].append(pa.RecordBatch.from_arrays(b.columns[4:], names=columns).slice(begin, end - begin))
        yield from compared(now, sides)

    kind = rows.schema["key_"].dataType.simpleString()
    return dealt.mapInArrow(run, f"crowd_ long, l_key {kind}, r_key {kind}, similarity double")


def _similar_ids(ranked: DataFrame, by: list[str], least: float) -> DataFrame:
    """(l_id, r_id, similarity) of the alike sets of ranked, those of crowds from blocks."""
    crowds = _crowds(ranked, by, least)
    if crowds.isEmpty():
        return _rare_alike(ranked, by, least)
    crowded = _crowded_pairs(ranked.withColumn("key_", F.col("id_")), crowds, by, least)
    return _rare_alike(ranked.join(crowds, by, "left_anti"), by, least).unionByName(crowded.select(F.col("l_key").alias("l_id"), F.col("r_key").alias("r_id"), "similarity"))


def _named(ranked: DataFrame, by: list[str], side: str) -> DataFrame:
    return ranked.where(_of(side)).select(*(by if side == "l" else []), F.col("id_").alias(f"{side}_id"), F.col("set_").alias(f"{side}_set"))


def candidate_sets(left: DataFrame, right: DataFrame, members: str, by: list[str], least: float) -> DataFrame:
    """(by, l_set, r_set) of distinct sets that may be alike at `least` or more (above 0), each pair once. Where nothing is rare
    all pairs are compared at once, and these are the alike ones."""
    ranked = _sides(left, right, members, by)
    crowds = _crowds(ranked, by, least)
    ids = _rare_pairs(ranked.join(crowds, by, "left_anti"), by, least).select("l_id", "r_id")
    ids = ids.unionByName(_crowded_pairs(ranked.withColumn("key_", F.col("id_")), crowds, by, least).select(F.col("l_key").alias("l_id"), F.col("r_key").alias("r_id")))
    return ids.join(_named(ranked, by, "l"), "l_id").join(_named(ranked, by, "r"), "r_id").select(*by, "l_set", "r_set")


def similar_sets(left: DataFrame, right: DataFrame, members: str, by: list[str], least: float) -> DataFrame:
    """(by, l_set, r_set, similarity): the distinct sets (arrays in order, without blanks and repeats) of left and right, within
    equal `by`, whose Jaccard likeness is `least` or more. Null `by` match nothing."""
    ranked = _sides(left, right, members, by)
    return _similar_ids(ranked, by, least).join(_named(ranked, by, "l"), "l_id").join(_named(ranked, by, "r"), "r_id").select(*by, "l_set", "r_set", "similarity")


def similar_rows(left: DataFrame, right: DataFrame, members: str, by: list[str], least: float) -> DataFrame:
    """JN-26: the rows of left and right with alike sets: by, the other columns of both (without `members`) and similarity. Pairs
    go by the sets' numbers, so no set is sent once for each that is like it."""
    ranked = _sides(left, right, members, by)
    rows = lambda df, s: df.withColumn("set_", set_key(members)).drop(members).join(ranked.where(_of(s)).select(*by, "set_", F.col("id_").alias(f"{s}_id")), [*by, "set_"]).drop("set_")
    l, r = rows(left, "l"), rows(right, "r").drop(*by)  # noqa: E741
    found = l.join(_similar_ids(ranked, by, least), "l_id").join(r, "r_id")
    return found.select(*by, *(c for c in l.columns if c not in (*by, "l_id")), *(c for c in r.columns if c != "r_id"), "similarity")


def similar_pairs(rows: DataFrame, key: str, members: str, by: list[str], least: float) -> DataFrame:
    """JN-26: (by, one, other, similarity) of the pairs of rows of one table with alike sets, each pair once: `one` is the lesser
    key. Rows whose keys are equal or null make no pair. Keys are numbers, dates or texts."""
    rows = written(rows.select(*by, F.col(key).alias("key_"), set_key(members).alias("set_")).where((F.size("set_") > 0) & F.col("key_").isNotNull()))
    ranked = _ranked(rows.groupBy(*by, "set_").agg(F.count("*").alias("rows_")).withColumn("side_", F.lit("lr")), by)
    rows = written(rows.join(ranked, [*by, "set_"]).select(*by, "key_", "side_", "rows_", "id_", "ranked_"))
    crowds = _crowds(ranked, by, least)
    few, sets = (df.join(crowds, by, "left_anti") for df in (rows, ranked))
    ids = _rare_alike(sets, by, least).where("l_id <= r_id")
    found = few.select(*by, F.col("id_").alias("l_id"), F.col("key_").alias("l_key")).join(ids, "l_id").join(few.select(F.col("id_").alias("r_id"), F.col("key_").alias("r_key")), "r_id")
    found = found.where("l_key < r_key or (l_id < r_id and l_key > r_key)").select(*by, F.least("l_key", "r_key").alias("one"), F.greatest("l_key", "r_key").alias("other"), "similarity")
    if crowds.isEmpty():
        return found
    crowded = _crowded_pairs(rows, crowds, by, least, same=True).join(crowds, "crowd_")
    return found.unionByName(crowded.select(*by, F.col("l_key").alias("one"), F.col("r_key").alias("other"), "similarity"))


def _runs(c: Column, k: int) -> Column:
    """The distinct runs of k characters; none in a shorter text."""
    runs = F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda i: F.substring(c, i, F.lit(k)))
    return F.when(F.length(c) >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def containments(holders: DataFrame, held: DataFrame, by: list[str], longest: int = 3) -> DataFrame:
    """(by, holder, name) of the distinct names in column `name` of the two sides, within equal `by`, of which the first
    contains the second. Blank names contain and are contained in nothing.

    A holder is listed under all of its runs of up to `longest` characters. A name looks under one of its own only, the one that
    fewest holders have, among its runs of `longest` characters (the whole name if it is shorter); where a run of it has no
    holder, neither has the name."""
    distinct = lambda df: df.where(F.col("name") != "").select(*by, "name").distinct()
    index = written(distinct(holders).select(*by, F.col("name").alias("holder"), F.explode(F.concat(*(_runs(F.col("name"), k) for k in range(1, longest + 1)))).alias("gram_")))
    counts = index.groupBy(*by, "gram_").agg(F.count("*").alias("n_"))
    own = F.when(F.length("name") < longest, F.array("name")).otherwise(_runs(F.col("name"), longest))
    asked = distinct(held).select(*by, "name", F.size(own).alias("grams_"), F.explode(own).alias("gram_"))
    rarest = asked.join(counts, [*by, "gram_"]).groupBy(*by, "name", "grams_").agg(F.min(F.struct("n_", "gram_")).alias("best_"), F.count("*").alias("found_"))
    rarest = rarest.where("found_ = grams_").select(*by, "name", F.col("best_.gram_").alias("gram_"))
    return index.join(rarest, [*by, "gram_"]).where(F.contains("holder", "name")).select(*by, "holder", "name")
