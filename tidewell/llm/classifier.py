"""Quality classifier by co-training.

Two logistic models see two views of a document: its text (byte and byte-pair shares, words, lines) and its page's metadata
(language, source, length class).  In each round both score every unlabelled document on Spark, and each takes examples
from those that the other is sure of.  Each view is then calibrated on held-out labels, and the two are combined.

Texts are read once: both views of every document are written, and rounds read these."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, materialize, slices, word_hashes

#: Bounds of the samples of labelled and, a view and label and round, of pseudo-labelled documents that the models are fitted
#: on.  Everything else sees all rows.
LABELLED, PSEUDO = 4000, 750
PAIRS, SCALARS, LANGS, SOURCES, LENGTHS = 512, 8, 16, 64, 24
#: A view's label counts if by its calibration no more than one in fifty such labels is wrong: good documents are so many that
#: a view which knows nothing is right in five of six cases.
ROUNDS, SURE = 4, 0.98


def text_view(text: str | None) -> np.ndarray:
    """Features of a whole text; null counts as empty."""
    data = (text or "").encode()
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(256 + PAIRS + SCALARS, np.float32)
    if not len(raw):
        return out
    out[:256] = np.sqrt(np.bincount(raw, minlength=256) / len(raw))
    if len(raw) > 1:
        pair = (raw[:-1].astype(np.int32) * 31 + raw[1:]) & (PAIRS - 1)
        out[256 : 256 + PAIRS] = np.sqrt(np.bincount(pair, minlength=PAIRS) / len(pair))
    words, starts, ends = word_hashes(data)
    if len(words):
        kinds = np.unique(words)
        n = len(words)
        lengths = ends - starts
        lines = data.split(b"\n")
        out[256 + PAIRS :] = (np.log1p(n) / 8, len(kinds) / n, lengths.mean() / 8, lengths.std() / 8, (words[1:] == words[:-1]).mean() if n > 1 else 0, len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 5, len(kinds) ** 2 / (n * 30 + len(kinds) ** 2))
    return out


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(LANGS + SOURCES + LENGTHS, np.float32)
    out[xxhash.xxh64_intdigest(lang or "", 1) % LANGS] = 1
    out[LANGS + xxhash.xxh64_intdigest(source or "", 2) % SOURCES] = 1
    out[LANGS + SOURCES + min(LENGTHS - 1, int(n_chars or 0).bit_length())] = 1
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights, the last of them the constant, of a logistic model on standardised features, by Nesterov's method."""
    mean, scale = x.mean(0), x.std(0) + 0.02
    z = np.concatenate(((x - mean) / scale, np.ones((len(x), 1), np.float32)), 1).astype(np.float32)
    rate = 4 / (np.linalg.norm(z.T @ z / len(z), 2) + penalty)
    w = v = np.zeros(z.shape[1], np.float32)
    for k in range(steps):
        g = z.T @ (_sigmoid(z @ v) - y) / len(z) + penalty * np.append(v[:-1], 0)
        w, before = v - rate * g, w
        v = w + k / (k + 3) * (w - before)
    w = w.astype(np.float64)
    plain = w[:-1] / scale
    return np.append(plain, w[-1] - plain @ mean)


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    """Weights of both views, their calibrations (slope, constant) and how the calibrated views combine."""

    text: np.ndarray
    page: np.ndarray
    text_scale: np.ndarray
    page_scale: np.ndarray
    both: np.ndarray

    def score(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        a = logit(text, self.text) * self.text_scale[0] + self.text_scale[1]
        b = logit(page, self.page) * self.page_scale[0] + self.page_scale[1]
        return _sigmoid(a * self.both[0] + b * self.both[1] + self.both[2])


def _fold(ids: np.ndarray) -> np.ndarray:
    """0 or 1 for every fourth of the labelled documents each, which calibrate and combine; more for those to fit on."""
    return np.array([xxhash.xxh64_intdigest(str(i), 9) % 8 for i in ids], np.int64)


VIEWS = ("text", "page")
#: Examples to fit on: of each view its features and their labels.
Examples = dict[str, tuple[np.ndarray, np.ndarray]]


def fit_views(examples: Examples) -> dict[str, np.ndarray]:
    return {v: fit(*examples[v]) for v in VIEWS}


def calibrated(weights: dict[str, np.ndarray], views: dict[str, np.ndarray], y: np.ndarray, fold: np.ndarray) -> dict[str, np.ndarray]:
    """Slope and constant of each view by fold 0 of the held-out documents; a view that tells nothing there gets no slope."""
    scale = {v: fit(logit(views[v][fold == 0], weights[v])[:, None].astype(np.float32), y[fold == 0]) for v in VIEWS}
    for s in scale.values():
        s[0] = max(s[0], 0.0)
    return scale


def combined(weights: dict[str, np.ndarray], views: dict[str, np.ndarray], y: np.ndarray, fold: np.ndarray) -> Model:
    """Calibrate each view on fold 0 of the held-out documents, and combine the calibrated views on fold 1."""
    scale = calibrated(weights, views, y, fold)
    a, b = (logit(views[v][fold == 1], weights[v]) * scale[v][0] + scale[v][1] for v in VIEWS)
    both = fit(np.stack((a, b), 1).astype(np.float32), y[fold == 1], 1e-2)
    return Model(weights["text"], weights["page"], scale["text"], scale["page"], np.append(np.maximum(both[:2], 0), both[2]))


TEXT, PAGE = 256 + PAIRS + SCALARS, LANGS + SOURCES + LENGTHS


def _both_views(texts: list, langs: list, sources: list, lengths: list) -> tuple[np.ndarray, np.ndarray]:
    """A row a document: the text view, as exact as it is written, and the page view."""
    text = np.stack([text_view(t) for t in texts]).astype(np.float16)
    return text, np.stack([metadata_view(*x) for x in zip(langs, sources, lengths)]).astype(np.uint8)


def _arrays(texts: list, pages: list) -> dict[str, np.ndarray]:
    return {"text": np.frombuffer(b"".join(texts), np.float16).reshape(-1, TEXT).astype(np.float32), "page": np.unpackbits(np.frombuffer(b"".join(pages), np.uint8).reshape(-1, PAGE // 8), axis=1).astype(np.float32)}


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, text, page) for each row of docs: its two views, written to the shared folder. Null columns count as empty; the
    only pass over texts that training takes. A text view has TEXT numbers of two bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            i, *columns = (c.to_pylist() for c in b.columns)
            text, page = _both_views(*columns)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in np.packbits(page, axis=1)], pa.binary())], names=["doc_id", "text", "page"])

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    return materialize(read.mapInArrow(rows, "doc_id long, text binary, page binary"))


def _picked(features: DataFrame, ids: DataFrame) -> list:
    """(doc_id, label, text, page) of the documents under a bounded number of ids (doc_id, label), in order."""
    picked = features.join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text", "page")
    return sorted(picked.collect(), key=lambda r: (r["doc_id"], bytes(r["text"])))


def _views_of(rows: list) -> dict[str, np.ndarray]:
    return _arrays([bytes(r["text"]) for r in rows], [bytes(r["page"]) for r in rows])


def sure(features: DataFrame, weights: dict[str, np.ndarray], scale: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, text_label, page_label) of every row of features with an id that a view is sure of, as far as it can be trusted
    on held-out labels: the label that it gives, null if it is not sure. Rows that repeat an id are told one by one."""

    def labels(p):
        return pa.array(np.where(p >= SURE, 1.0, 0.0), pa.float64(), mask=(p < SURE) & (p > 1 - SURE))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            views = _arrays(*(c.to_pylist() for c in b.columns[1:]))
            yield pa.RecordBatch.from_arrays([b.column(0), *(labels(_sigmoid(logit(views[v], weights[v]) * scale[v][0] + scale[v][1])) for v in VIEWS)], names=["doc_id", "text_label", "page_label"])

    found = features.where("doc_id is not null").mapInArrow(rows, "doc_id long, text_label double, page_label double")
    return found.where("text_label is not null or page_label is not null")


def train_on(features: DataFrame, labels: DataFrame, labelled: int = LABELLED, pseudo: int = PSEUDO, rounds: int = ROUNDS) -> Model | None:
    """Fit on at most `labelled` documents with a label (the mean of repeated ones, rounded).  In each round every document
    without a label is scored by both views; of those that one is sure of, `pseudo` a label are fitted on by the other, those
    with the least hashes of their ids.  The driver gets features of these bounded samples: rows of some 900 values.

    None unless both labels occur in each fold."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("q"))
    known = materialize(known.select("doc_id", (F.col("q") >= 0.5).cast("double").alias("label")))
    order, spark = [F.xxhash64("doc_id"), "doc_id"], features.sparkSession
    some = features.select("doc_id").dropna().distinct().join(known, "doc_id").orderBy(*order).limit(labelled).collect()
    made = _picked(features, spark.createDataFrame(some, "doc_id long, label double"))
    fold, y = _fold([r["doc_id"] for r in made]), np.array([r["label"] for r in made])
    if any(len(np.unique(y[part])) < 2 for part in (fold == 0, fold == 1, fold > 1)):
        return None
    views = _views_of(made)
    weights = fit_views({v: (views[v][fold > 1], y[fold > 1]) for v in VIEWS})
    for _ in range(rounds):
        free = materialize(sure(features, weights, calibrated(weights, views, y, fold)).join(known, "doc_id", "left_anti").distinct())
        more = {}
        for v, other in (("text", "page"), ("page", "text")):
            found = [x for k in (0.0, 1.0) for x in free.where(F.col(f"{v}_label") == k).select("doc_id", F.col(f"{v}_label").alias("label")).dropDuplicates(["doc_id"]).orderBy(*order).limit(pseudo).collect()]
            got = _picked(features, spark.createDataFrame(found, "doc_id long, label double"))
            more[other] = (np.concatenate((views[other][fold > 1], _views_of(got)[other])), np.concatenate((y[fold > 1], [r["label"] for r in got])))
        weights = fit_views(more)
    return combined(weights, views, y, fold)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pseudo: int = PSEUDO, rounds: int = ROUNDS) -> Model | None:
    """train_on the views of docs, which are deleted then."""
    features = featured(docs)
    model = train_on(features, labels, labelled, pseudo, rounds)
    discard(features)
    return model


def _told(ids: pa.Array, s: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(s, pa.float64()), pa.array([x is None or x >= 0.5 for x in s], pa.bool_())], names=["doc_id", "score", "accepted"])


def score_features(features: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, accepted) for each row of features: the calibrated probability that the document is good, and whether that
    is at least a half. Without a model nothing is rejected, and scores are null."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            views = _arrays(*(c.to_pylist() for c in b.columns[1:]))
            yield _told(b.column(0), [None] * b.num_rows if model is None else model.score(views["text"], views["page"]).tolist())

    return features.select("doc_id", "text", "page").mapInArrow(rows, "doc_id long, score double, accepted boolean")


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """score_features of docs. Null columns count as empty."""
    return score_features(featured(docs), model)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that the model accepts, with all their columns, judged where they are: no exchange. Null columns count as
    empty; equal rows are judged alike; without a model, or of an empty table, all rows stay."""
    if model is None:
        return docs
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    read = docs.select(row, F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text, page = _both_views(*(c.to_pylist() for c in b.columns[1:]))
            yield pa.RecordBatch.from_struct_array(b.column(0)).filter(pa.array(model.score(text.astype(np.float32), page.astype(np.float32)) >= 0.5))

    return read.mapInArrow(rows, docs.schema)
