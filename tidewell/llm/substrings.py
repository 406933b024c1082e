"""Substring dedup by collinear chaining.

Seeds are hashes of K words, thinned to the least of every WINDOW neighbours, so a shared run of K + WINDOW - 1 words
shares a seed.  Each seed belongs to its first occurrence in order of doc_id; every later occurrence is joined to that one
only, so a passage that many documents share costs a row for each.  Matches of a document with an owner are merged along
diagonals and chained in both orders with gap costs, by a Fenwick tree of prefix maxima.  Chains are aligned word by word,
extended at both ends, and the passages of a document that lie in earlier ones are united.  A chain is left out only where
the words that it lies on are in passages that have been found."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, map_arrow, materialize, mix64, shingle_hashes, slices, word_hashes

K, WINDOW = 8, 16
#: Words between equal seeds of one repeating run, at most: fewer than a passage has.
NEAR = 32
#: Most words between matches on one diagonal, cost of a word of gap on either side, and the longest gap within a passage.
STRIDE, GAP_COST, GAP = 32, 0.25, 16
#: Words an end is extended by at most, cost of a word that differs there, words of a block of an owner's text.
REACH, MISMATCH, BLOCK = 48, 3, 64
#: Least words of a repeated passage, and least share of its words that agree.
LEAST, IDENTITY = 50, 0.8


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over all windows of `width` values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = f(x[:-step], x[step:])
        have += step
    return x


def minimizers(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of values that are the least of some window of neighbours (of all, where there are fewer)."""
    n = len(h)
    if n <= window:
        return np.flatnonzero(h == h.min()) if n else np.zeros(0, np.int64)
    low = _slide(h, window, np.minimum)
    pad = np.zeros(window - 1, h.dtype)
    return np.flatnonzero(_slide(np.concatenate((pad, low, pad)), window, np.maximum) == h)


def numbered(h: np.ndarray, reach: int = NEAR) -> np.ndarray:
    """Hashes that also tell how many equal ones came before in steps of at most `reach` words: in runs of a repeated word,
    word pair or line the n-th matches the n-th, not all of them the first."""
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (np.diff(order) > reach)
    place = np.arange(len(h))
    run = place - np.maximum.accumulate(np.where(new, place, 0))
    out, again = h.copy(), order[run > 0]
    out[again] = mix64(mix64(h[again]) + run[run > 0].astype(np.uint64))
    return out


def seeds(docs: DataFrame) -> DataFrame:
    """(h, doc, pos) of the seeds of every text; pos counts words."""

    def rows(ids, texts):
        hs, ds, ps = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, t in zip(ids, texts):
            words = word_hashes((t or "").encode())[0]
            if len(words) >= K:
                h = numbered(shingle_hashes(words, K))
                at = minimizers(h)
                hs.append(h[at])
                ds.append(np.full(len(at), i))
                ps.append(at)
        return {"h": np.concatenate(hs).view(np.int64), "doc": np.concatenate(ds), "pos": np.concatenate(ps)}

    return map_arrow(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "h long, doc long, pos int")


def matches(found: DataFrame) -> DataFrame:
    """(doc, pos, owner, at): every seed (h, doc, pos) that occurs in a smaller doc too, with its first occurrence there."""
    first = found.groupBy("h").agg(F.min(F.struct("doc", "pos")).alias("first"), F.max("doc").alias("last"))
    # Written, so that the join is between plain exchanges, of which Spark can split the large partitions
    first = materialize(first.where("last > first.doc").select("h", F.col("first.doc").alias("owner"), F.col("first.pos").alias("at")))
    return found.join(first, "h").where("doc > owner").select("doc", "pos", "owner", "at")


class Fenwick:
    """Prefix maxima of (value, index)."""

    def __init__(self, n: int):
        self.best = [(-math.inf, -1)] * (n + 1)

    def put(self, i: int, value: float, what: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, what)
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """The best of positions below i."""
        found = (-math.inf, -1)
        while i:
            found = max(found, self.best[i])
            i -= i & -i
        return found


def fragments(pos: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(start in the document, start in the owner, words) of runs of matches on one diagonal, given in order of pos."""
    cut = np.flatnonzero((np.diff(pos - at) != 0) | (np.diff(pos) > STRIDE)) + 1
    begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(pos)])) - 1
    return list(zip(pos[begin].tolist(), at[begin].tolist(), (pos[end] - pos[begin] + K).tolist()))


def chains(found: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Chains of fragments (in order of their starts), best first; each fragment is in one chain.

    A chain's score is its words less GAP_COST for each word of gap on either side.  A fragment can follow one whose last
    seed starts before its own first in both texts."""
    n = len(found)
    last = [(b + w - K, a + w - K) for b, a, w in found]
    rank = {a: i for i, a in enumerate(sorted({a for _, a in last}))}
    order = sorted(rank)
    tree, done = Fenwick(len(rank)), sorted(range(n), key=lambda i: last[i][0])
    score, back, k = [0.0] * n, [-1] * n, 0
    from bisect import bisect_left

    for i, (b, a, w) in enumerate(found):
        while k < n and last[done[k]][0] < b:
            j = done[k]
            tree.put(rank[last[j][1]], score[j] + GAP_COST * (last[j][0] + last[j][1] + 2 * K), j)
            k += 1
        best, j = tree.upto(bisect_left(order, a))
        gain = best - GAP_COST * max(b + a, 0) if j >= 0 else 0
        score[i], back[i] = (w + gain, j) if gain > 0 else (w, -1)
    out, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        part = []
        while i >= 0 and not used[i]:
            used[i] = True
            part.append(found[i])
            i = back[i]
        if part:
            out.append(part[::-1])
    return out


def split_chains(pos: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Chains of the matches with one owner, cut at gaps of more than GAP words."""
    out = []
    for chain in chains(fragments(pos, at)):
        part = [chain[0]]
        for x, y in zip(chain, chain[1:] + [None]):
            if y is None or max(y[0] - x[0] - x[2], y[1] - x[1] - x[2]) > GAP:
                out.append(part)
                part = []
            part.append(y)
    return out


def chained(pairs: DataFrame) -> DataFrame:
    """(doc, owner, parts): the chains of every document with its owners; parts has start, owner's start and words of each
    fragment in turn.

    A task sees the matches document by document and holds those of one, at most as many as it has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 4), np.int64)
        for b in batches:
            block = np.concatenate((rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], 1)))
            begin = np.flatnonzero(np.concatenate(([True], block[1:, 0] != block[:-1, 0]))) if len(block) else [0]
            yield made(block[: begin[-1]])
            rest = block[begin[-1] :]
        yield made(rest)

    def made(block):
        docs = np.flatnonzero(np.concatenate(([True], block[1:, 0] != block[:-1, 0], [True]))) if len(block) else [0]
        out = []
        for s, e in zip(docs[:-1], docs[1:]):
            own = block[s:e]
            cut = np.flatnonzero(np.concatenate(([True], own[1:, 1] != own[:-1, 1], [True])))
            found = [(int(own[i, 1]), c) for i, j in zip(cut[:-1], cut[1:]) for c in split_chains(own[i:j, 2], own[i:j, 3])]
            out += [(int(own[0, 0]), owner, [v for f in c for v in f]) for owner, c in found]
        columns = list(zip(*out)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32()))], names=["doc", "owner", "parts"])

    rows = pairs.select("doc", "owner", "pos", "at").repartition("doc").sortWithinPartitions("doc", "owner", "pos")
    return rows.mapInArrow(run, "doc long, owner long, parts array<int>")


def _equal_words(h: np.ndarray) -> np.ndarray:
    """Words as 32-bit hashes."""
    return (h >> np.uint64(32)).astype(np.uint32)


def owner_blocks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(owner, block, words): the blocks of owners' texts, as 32-bit word hashes, that chains lie in or next to."""
    asked = found.select("owner", F.explode(_blocks()).alias("block")).distinct().groupBy("owner").agg(F.collect_set("block").alias("blocks"))

    def rows(ids, texts, asked):
        out = {"owner": [], "block": [], "words": []}
        for i, t, some in zip(ids, texts, asked):
            h = _equal_words(word_hashes((t or "").encode())[0])
            for k in some:
                if k * BLOCK < len(h):
                    out["owner"].append(i)
                    out["block"].append(k)
                    out["words"].append(h[k * BLOCK : (k + 1) * BLOCK].tobytes())
        return out

    both = docs.select(F.col("doc_id").cast("long").alias("owner"), F.col("text").cast("string").alias("text")).join(asked.hint("merge"), "owner").select("owner", "text", "blocks")
    return map_arrow(both, rows, "owner long, block int, words binary").dropDuplicates(["owner", "block"])


def _blocks():
    start, end, words = (F.element_at("parts", i) for i in (2, -2, -1))
    return F.sequence(F.greatest(F.floor((start - REACH) / BLOCK), F.lit(0)).cast("int"), F.floor((end + words + REACH) / BLOCK).cast("int"))


def _extension(equal: np.ndarray) -> int:
    """Words to extend by along agreeing and differing words."""
    if not len(equal):
        return 0
    total = np.cumsum(np.where(equal, 1, -MISMATCH))
    best = int(total.argmax())
    return best + 1 if total[best] > 0 else 0


def _in_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which words of a are in a longest common subsequence of two short gaps."""
    out, rows = np.zeros(len(a), bool), [np.zeros(len(b) + 1, np.int64)]
    for x in a:
        row = rows[-1]
        rows.append(np.maximum.accumulate(np.concatenate(([0], np.maximum(row[1:], row[:-1] + (b == x))))))
    i, k = len(a), len(b)
    while i and k:
        if rows[i][k] == rows[i - 1][k]:
            i -= 1
        elif rows[i][k] == rows[i][k - 1]:
            k -= 1
        else:
            i, k = i - 1, k - 1
            out[i] = True
    return out


def align(words: np.ndarray, owner: np.ndarray, base: int, parts: list[tuple[int, int, int]]) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(start, owner's words, equal, skipped) of a chain aligned to the owner's words, which begin at its position `base`:
    where it starts, over how many words of the owner it goes, which of its words agree, and how many words of the owner
    that have no counterpart stand right before each.  Parts that reach beyond either text are left out."""
    have = [(b, a - base, w) for b, a, w in parts if a >= base and a - base + w <= len(owner) and b + w <= len(words)]
    if not have:
        return 0, 0, np.zeros(0, bool), np.zeros(0, np.int64)
    first, (end, stop) = have[0], (have[0][0], have[0][1])
    n = min(REACH, first[0], first[1])
    same = words[first[0] - n : first[0]] == owner[first[1] - n : first[1]]
    left = _extension(same[::-1])
    equal, skips = [same[n - left :]], []
    for b, a, w in have:
        skip = max(0, end - b, stop - a)
        if skip >= w:
            continue
        b, a, w = b + skip, a + skip, w - skip
        equal.append(_in_common(words[end:b], owner[stop:a]))
        skips.append((b, max(0, (a - stop) - (b - end))))
        equal.append(words[b : b + w] == owner[a : a + w])
        end, stop = b + w, a + w
    n = min(REACH, len(words) - end, len(owner) - stop)
    same = words[end : end + n] == owner[stop : stop + n]
    right = _extension(same)
    equal = np.concatenate([*equal, same[:right]])
    start, skipped = first[0] - left, np.zeros(len(equal), np.int64)
    for b, k in skips:
        skipped[b - start] += k
    return start, stop + right - (first[1] - left), equal, skipped


def _trimmed(equal: np.ndarray, start: int, end: int, least: int) -> tuple[int, int]:
    """start and end without what differs beyond the first and the last run of K agreeing words, as far as `least` words stay."""
    total = np.concatenate(([0], np.cumsum(equal[start:end])))
    runs = np.flatnonzero(total[K:] - total[:-K] == K) + start
    if not len(runs):
        return start, end
    a, z = int(runs[0]), int(runs[-1]) + K
    a, z = a - _extension(equal[start:a][::-1]), z + _extension(equal[z:end])
    return (a, z) if z - a >= least else (start, end)


def good_parts(equal: np.ndarray, skipped: np.ndarray, least: int, identity: float) -> list[tuple[int, int]]:
    """The parts of an alignment that are made of runs of at least `least` words of which a share of `identity` agrees; a
    word that either text lacks counts as one that differs."""
    ends = np.concatenate(([0.0], np.cumsum(equal - identity * (1 + skipped))))
    starts = ends[:-1] - identity * skipped - 1e-6
    best = np.maximum.accumulate(ends[::-1])  # the greatest value from a place on, last place first
    far = len(equal) - np.searchsorted(best, starts)
    out: list[list[int]] = []
    for s in np.flatnonzero(far - np.arange(len(equal)) >= least).tolist():
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(far[s]))
        else:
            out.append([s, int(far[s])])
    return [_trimmed(equal, s, e, least) for s, e in out]


def united(spans: list[tuple[int, int, int]], least: int = LEAST) -> list[tuple[int, int, list[int]]]:
    """(start, end, owners) of the unions of touching spans (start, end, owner) that have at least `least` words."""
    out: list[list] = []
    for s, e, o in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
            out[-1][2].add(o)
        else:
            out.append([s, e, {o}])
    return [(s, e, sorted(o)) for s, e, o in out if e - s >= least]


def _passages(text: str, chains_: list, least: int, identity: float) -> tuple[list[tuple[int, int, list[int]]], np.ndarray, np.ndarray]:
    h, starts, ends = word_hashes(text.encode())
    words, spans = _equal_words(h), []
    done = np.zeros(len(words), bool)
    for c in sorted(chains_, key=lambda c: (c["parts"][0], -(c["parts"][-3] + c["parts"][-1]), c["owner"], c["parts"][1])):
        parts = list(zip(*[iter(c["parts"])] * 3))
        if done[parts[0][0] : parts[-1][0] + parts[-1][2]].all():
            continue  # later copies add nothing to a passage that is found
        blocks = sorted((b["block"], b["words"]) for b in c["blocks"])
        lead = [w for k, (n, w) in enumerate(blocks) if n == blocks[0][0] + k]
        owner = np.frombuffer(b"".join(lead), np.uint32)
        b, far, equal, skipped = align(words, owner, blocks[0][0] * BLOCK, parts)
        n = len(equal)
        if not n:
            continue
        if equal.sum() >= identity * max(n, far):
            # a single seed is a passage only by what it is extended by
            some = [(0, n)] if len(parts) > 1 or parts[0][2] > K or n >= least else []
        else:
            some = good_parts(equal, skipped, least, identity)
        for s, e in some:
            spans.append((b + s, b + e, c["owner"]))
            done[b + s : b + e] = True
    return united(spans, least), starts, ends


def _with_chains(docs: DataFrame) -> DataFrame:
    """(doc, chains_): of each document the chains, each with the owner's blocks of words that it needs.

    The joins with whole texts are merge joins at any size, so what is exchanged grows as the input does."""
    found = materialize(seeds(docs))
    made = materialize(chained(matches(found)).withColumn("chain", F.monotonically_increasing_id()))
    discard(found)
    blocks = materialize(owner_blocks(docs, made))
    asked = made.withColumn("block", F.explode(_blocks()))
    each = asked.join(blocks, ["owner", "block"]).groupBy("doc", "chain").agg(F.first("owner").alias("owner"), F.first("parts").alias("parts"), F.collect_list(F.struct("block", "words")).alias("blocks"))
    return each.groupBy("doc").agg(F.collect_list(F.struct("owner", "parts", "blocks")).alias("chains_"))


def repeated_passages(docs: DataFrame, least: int = LEAST, identity: float = IDENTITY) -> DataFrame:
    """A row for each passage of a document of at least `least` words that lies, but for up to a fifth of its words, in
    documents of smaller doc_id: doc_id, start_word, end_word, n_words, start_char, end_char, owner_ids (those documents;
    of many that share a passage, the first ones only).

    The whole of a later copy is such a passage. Null and short texts have none; documents with a null id are passed over;
    texts under one doc_id are not compared with each other."""
    schema = "doc_id long, start_word int, end_word int, n_words int, start_char long, end_char long, owner_ids array<long>"

    def rows(ids, texts, chains_):
        out = {k: [] for k in ("doc_id", "start_word", "end_word", "n_words", "start_char", "end_char", "owner_ids")}
        for i, t, some in zip(ids, texts, chains_):
            data = t.encode()
            found, starts, ends = _passages(t, some, least, identity)
            for s, e, owners in found:
                at = len(data[: starts[s]].decode())
                for k, v in zip(out, (i, s, e, e - s, at, at + len(data[starts[s] : ends[e - 1]].decode()), owners)):
                    out[k].append(v)
        return out

    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    each = _with_chains(docs)
    both = docs.join(each.hint("merge"), docs["doc_id"] == each["doc"]).select("doc_id", "text", "chains_")
    return map_arrow(both, rows, schema)


def without_repeats(docs: DataFrame, least: int = LEAST, identity: float = IDENTITY) -> DataFrame:
    """docs with repeated passages cut from their texts, and n_chars, where there is such a column, counted anew.  Documents
    of which no word is left go; texts without repeats stay as they are, null and wordless ones too."""

    def cut(text: str, chains_: list) -> str | None:
        found, starts, ends = _passages(text, chains_, least, identity)
        if not found:
            return text
        data, at, out = text.encode(), 0, []
        for s, e, _ in found:
            out.append(data[at : starts[s]])
            at = ends[e - 1]
        out.append(data[at:])
        left = b"".join(out).decode()
        return left if left.strip(" \t\n\x0b\x0c\r") else None

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            columns = dict(zip(names, b.column(0).flatten()))
            texts = columns["text"].to_pylist()
            new = [t if c is None or t is None else cut(t, c) for t, c in zip(texts, b.column(1).to_pylist())]
            keep = pa.array([n is not None or t is None for n, t in zip(new, texts)])
            columns["text"] = pa.array(new, columns["text"].type)
            if "n_chars" in columns:
                count = pa.array([len(n) if n is not None and n != t else None for n, t in zip(new, texts)], columns["n_chars"].type)
                columns["n_chars"] = pa.compute.coalesce(count, columns["n_chars"])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names).filter(keep)

    import pyarrow.compute  # noqa: F401

    each = _with_chains(docs)
    rows = docs.where("doc_id is not null").select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").cast("long").alias("of"))
    both = rows.join(each.hint("merge"), rows["of"] == each["doc"], "left").select("row", "chains_")
    return both.mapInArrow(run, docs.schema).union(docs.where("doc_id is null"))
