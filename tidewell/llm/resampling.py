"""Importance resampling towards a target: documents are drawn with odds that grow with how much more likely the words of
their texts are in the target than in the corpus.

Words and pairs of words fall into buckets; what the corpus and the target hold of each bucket gives it a gain, an array of
fixed length. A document's weight is the mean gain of its features, and whole-number noise of a Gumbel law, told by its id, is
added. The highest scores are a sample without replacement. Scores are whole numbers of a bounded range, so an exact
histogram tells the score at which the sample ends, and ranks are counted within one score only."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import map_arrow, materialize, slices

BUCKETS = 10000
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20

#: A-Z become a-z; what stands between words becomes a space; words are of 0-9, a-z and all that is not ASCII.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: str | None) -> tuple[int, np.ndarray]:
    """Number of words of the whole text, and the bucket of each of its words and pairs of neighbouring words: the crc32 of
    their UTF-8, joined by one space, modulo BUCKETS. Null counts as empty."""
    words = (text or "").encode().translate(_PLAIN).split()
    one = [crc32(w) for w in words]
    both = [crc32(w, crc32(b" ", c)) for w, c in zip(words[1:], one)]
    return len(words), np.array(one + both, np.int64) % BUCKETS


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n): how many features of all texts (column text) fall into each bucket. A task sends a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                sums += np.bincount(features(t)[1], minlength=BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """A bucket's gain: floor(1000 ln of its share in the target over its share in docs), each with one more feature a bucket.
    The driver gets BUCKETS rows at most, whatever the tables' size."""
    own = bucket_counts(docs).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = own.unionByName(bucket_counts(target).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    s, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    share = lambda a, b: (a + 1).astype(float) * float(b.sum() + BUCKETS)
    return np.floor(1000 * np.log(share(t, s) / share(s, t))).astype(np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel number), told by seed and id alone: -3131 to 22874."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scores(docs: DataFrame, target: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) for each row of docs (doc_id, text), by the texts of target (column text).

    weight is the mean gain of the document's features, rounded down (none: 0); score adds the noise of its id. Rows that
    repeat an id share its noise; null ids count as one id of their own. Null texts have no words; an empty target gives
    every bucket the weight of an even spread."""
    gain = gains(docs, target)

    def rows(ids, texts):
        made = [features(t) for t in texts]
        weights = [int(gain[f].sum()) // len(f) if len(f) else 0 for _, f in made]
        return {"doc_id": ids, "n_words": [n for n, _ in made], "n_features": [len(f) for _, f in made], "weight": weights}

    found = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "doc_id long, n_words long, n_features long, weight long")
    return found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame, share: int) -> DataFrame:
    """rows (doc_id, n_words, score and more) with rank: 1, 2, 3 ... for the highest `share` percent (rounded down) of those with
    LEAST_WORDS words or more, by falling score and then rising doc_id; null for all others. rows is read three times.

    The histogram has a row a score. Scores are whole numbers between the least and the greatest gain, with the noise's 26,000
    steps added, so it is short at any size of the corpus, and one task sums it up from the highest score. The scores of the
    last rank and above survive; their documents are numbered within each score. One score has at most 0.04 % of the documents
    of a weight, by the noise's law, so its rows are a small share even where all texts are copies. Equal ids within a score
    stand in the order of their number of features; null ids come first."""
    able = rows.where(F.col("n_words") >= LEAST_WORDS)
    counts = able.groupBy("score").agg(F.count("*").alias("n"))
    falling = Window.orderBy(F.desc("score"))
    above = F.coalesce(F.sum("n").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    wanted = F.expr(f"sum(n) over () * {share} div 100")
    cut = materialize(counts.select("score", above.alias("above"), wanted.alias("wanted")).where("above < wanted"))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features"))
    drawn = able.join(F.broadcast(cut), "score").withColumn("rank", (F.col("above") + place).cast("long"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= F.col("wanted"), F.col("rank"))).select(*rows.columns, "rank")
    rest = rows.join(F.broadcast(cut), (rows["score"] == cut["score"]) & (rows["n_words"] >= LEAST_WORDS), "left_anti")
    return drawn.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, share: int = 25, seed: int = 7) -> DataFrame:
    """A row for each row of docs: doc_id, n_features, weight, score and rank (null: not drawn). An empty table gives no rows."""
    return ranked(materialize(scores(docs, target, seed)), share).select("doc_id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, share: int = 25, seed: int = 7) -> DataFrame:
    """The rows of docs, all columns, that are drawn; of rows that repeat an id all are, if one is."""
    ids = resampled(docs, target, share, seed).where("rank is not null").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["drawn_id"]), "left_semi")
