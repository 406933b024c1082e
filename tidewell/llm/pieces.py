"""SentencePiece encoding and decoding by a streaming Viterbi search.

The vocabulary is that of a BPE model with byte fallback, read as data.  A piece can end at a position only if it and the
piece before it are what merging their joint text gives; a sequence is the model's encoding just if every two
neighbours satisfy this, so each position has one surviving backpointer.  Only positions within the greatest piece
length can be extended; whenever the paths of all of those run through one boundary, the ids before it are final and are
handed out, and what lies before is forgotten."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_arrow

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct segments whose ids a worker remembers in each of two generations.
MEMORY = 400_000


class Vocabulary:
    """Pieces of a model, without the library: plain dictionaries that can be sent to tasks."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], size: int):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.longest = max(map(len, pieces))
        self.joined = {c for p in pieces if len(p) > 1 for c in p}  # characters that can be within a longer piece
        self.beside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}  # neighbours within some piece
        self.bytes: list[bytes] = [b""] * size
        for p, (i, _) in pieces.items():
            self.bytes[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])
        runs = [p for p in pieces if len(p) > 1 and not p.strip(MARK)]
        words = [s for p, (_, s) in pieces.items() if len(p) > 1 and p not in runs]
        if any(MARK in p.lstrip(MARK) for p in pieces) or runs and max(pieces[p][1] for p in runs) >= min(words):
            raise ValueError("a space may only lead a piece, and runs of spaces must be the last to merge")
        n = self.longest_run = max(map(len, runs), default=1)
        self.runs = [[pieces[p][0] for p in self.merged(MARK * k)] for k in range(3 * n)]
        if any(made != self.runs[n] * (k // n) + self.runs[k % n] for k, made in enumerate(self.runs)):
            raise ValueError("runs of spaces must fall into the longest pieces from the left")
        lone = "".join(c for c in "\n\r\t" if c not in self.joined)
        self.segment = re.compile(f"{MARK}+[^{MARK}{lone}]*|[^{MARK}{lone}]+" + (f"|[{lone}]" if lone else ""))
        #: When a piece is formed, -1 for single characters, and the pieces of which its last merger makes it
        self.rank, self.left, self.right = dict.fromkeys(self.joined, -1.0), {}, {}
        for p, (_, score) in pieces.items():
            trace: list[tuple[str, str]] = []
            if len(p) > 1 and self.merged(p, trace) == [p]:
                self.left[p], self.right[p] = trace[-1]
                self.rank[p] = -score
        self.agreed: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.automaton = None
        self.mark = np.array([pieces[MARK][0]], np.int32).tobytes()

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "older": {}, "agreed": {}, "automaton": None}

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Vocabulary:
        """Read the model file, on the driver."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        plain = {m.id_to_piece(i): (i, m.get_score(i)) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        return cls(plain, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], len(ids))

    def merged(self, text: str, trace: list[tuple[str, str]] | None = None) -> list[str]:
        """The pieces that merging neighbours by the best score, leftmost first, makes of text; trace gets each merger."""
        part, nxt, prv = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap = []

        def offer(i):
            j = nxt[i]
            if j < len(part) and (p := self.pieces.get(part[i] + part[j])):
                heapq.heappush(heap, (-p[1], i, part[i], part[j]))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            part[i], part[j] = a + b, ""
            if trace is not None:
                trace.append((a, b))
            nxt[i] = nxt[j]
            if nxt[j] < len(part):
                prv[nxt[j]] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        return [p for p in part if p]

    def agree(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a and b back: undo both, the later merger first, and see that at no time the pieces
        on either side of the boundary would have merged earlier than what did happen; of equals the left one is first."""
        rank, limit = self.rank, math.inf
        when_a, when_b = rank[a], rank[b]
        while True:
            both = rank.get(a + b)
            if both is not None and both < limit:
                return False
            if when_a > when_b:
                limit, a = when_a, self.right[a]
                when_a = rank[a]
            elif when_b >= 0:
                limit, b = when_b + 0.5, self.left[b]
                when_b = rank[b]
            else:
                return True

    def stream(self, text: str) -> Iterator[list[str]]:
        """Pieces of a text without runs of spaces, of characters that longer pieces have, in groups, each handed out as
        soon as it is final."""
        window, base, at, agreed = 4 * self.longest, 0, 0, self.agreed
        last = [""]  # the piece that ends at base, base + 1, ... and, last, at `at`
        for end, p in self.matcher().iter(text):  # longer pieces first at each end
            if end != at or (k := end + 1 - base - len(p)) < 0:
                continue
            before = last[k]
            if before:
                fits = agreed.get((before, p))
                if fits is None:
                    if len(agreed) >= MEMORY:
                        agreed.clear()
                    fits = agreed[before, p] = self.agree(before, p)
                if not fits:
                    continue
            last.append(p)
            at += 1
            if at - base >= window:
                meet = max(set.intersection(*self._paths(last, len(last) - self.longest)))
                if meet:
                    yield self._back(last, meet)
                    last, base = last[meet:], base + meet
        yield self._back(last, len(last) - 1)

    def matcher(self):
        """An automaton that finds all pieces that end at each position."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for p in self.rank:
                self.automaton.add_word(p, p)
            self.automaton.make_automaton()
        return self.automaton

    @staticmethod
    def _back(last: list[str], at: int) -> list[str]:
        out = []
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    @staticmethod
    def _paths(last: list[str], first: int) -> list[set[int]]:
        """The boundaries on the path to each position from `first` on."""
        found = []
        for at in range(first, len(last)):
            path = {at}
            while at:
                at -= len(last[at])
                path.add(at)
            found.append(path)
        return found

    def _ids(self, piece: str) -> list[int]:
        known = self.pieces.get(piece)
        return [known[0]] if known else [self.byte_ids[b] for b in piece.encode()]

    def _segment(self, text: str) -> bytes:
        """ids of a run of spaces with what follows up to the next space.

        Spaces merge with each other last and leftmost first, so the run before the one that leads the word falls into the
        longest pieces from its left, as checked when the vocabulary is made."""
        body = text.lstrip(MARK)
        run = len(text) - len(body)
        out, word, start, beside = [], MARK + body if run else body, 0, self.beside
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1 : i + 1] not in beside:  # no piece reaches across
                out.append(self._look_up(word[start:i], self._part))
                start = i
        found = b"".join(out)
        if run > 1:
            alone = found[:4] == self.mark
            whole, rest = divmod(run if alone else run - 1, self.longest_run)
            found = np.array(self.runs[self.longest_run] * whole + self.runs[rest], np.int32).tobytes() + found[4 * alone :]
        return found

    def _part(self, text: str) -> bytes:
        """ids of a text without boundaries that no piece crosses."""
        if len(text) == 1:
            return np.array(self._ids(text), np.int32).tobytes()
        return np.array([x for group in self.stream(text) for p in group for x in self._ids(p)], np.int32).tobytes()

    def _look_up(self, segment: str, make) -> bytes:
        """ids of a segment as 32-bit numbers.  Of the segments seen, the last MEMORY to 2 * MEMORY are remembered."""
        key = (segment,) if make == self._part else segment
        found = self.known.get(key) or self.older.get(key)
        if found is None:
            found = make(segment)
        if len(segment) <= 64:
            if len(self.known) >= MEMORY:
                self.older, self.known = self.known, {}
            self.known[key] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """ids of a text; none for an empty or null one.  A space is put before the text, as the model wants it."""
        if not text:
            return np.zeros(0, np.int32)
        known = self.known
        return np.frombuffer(b"".join([known.get(s) or self._look_up(s, self._segment) for s in self.segment.findall(MARK + text.replace(" ", MARK))]), np.int32)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, n_chars, n_tokens, ids, exact) for each row of docs: ids of the whole text, and whether decoding them gives
    the text back, which it does unless the text has U+2581 itself.  Null counts as empty: no ids.  The vocabulary's tables
    go out with the tasks; executors need no model file."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load())

    def rows(ids, texts):
        v = sent.value
        found = [v.encode(t) for t in texts]
        ends = np.cumsum([0, *map(len, found)])
        tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
        return {"doc_id": ids, "n_chars": [len(t or "") for t in texts], "n_tokens": np.diff(ends), "ids": tokens, "exact": [v.decode(f.tolist()) == (t or "") for f, t in zip(found, texts)]}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "doc_id long, n_chars long, n_tokens int, ids array<int>, exact boolean")


def decode(tokens: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    sent = tokens.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load())
    return map_arrow(tokens.select("doc_id", "ids"), lambda d, ids: {"doc_id": d, "text": [sent.value.decode(i) if i else "" for i in ids]}, "doc_id long, text string")


