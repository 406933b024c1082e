"""What each of several filters removes, alone and after others, in every order of applying them.

Documents are first counted by mask: which filters they fail. The counts are all that the audit needs, so nothing that follows
grows with the documents. Each mask cell is unpivoted against the steps of all orders; a running bit-or of the filters failed
at earlier steps tells what is already removed, and a window over a filter's steps sums what it removes in all orders."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import SPACE_CLASS, materialize
from tidewell.llm.mixing import count_words

#: The letters of the five filters; the last one, of copies, looks at other documents.
FILTERS = "ABCDE"


def own_failures(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails each filter that looks at nothing else: A: under 200 words; B: less than half of its
    words are distinct; C: over 2 % of its code points are A-Z; D: it holds one of #$%&*|."""
    parts = F.split(text, SPACE_CLASS + "+")
    n = count_words(text)
    ends = F.when((parts[0] == "") | (F.element_at(parts, -1) == ""), 1).otherwise(0)
    distinct = F.size(F.array_distinct(parts)) - ends
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 200, "B": 100 * distinct.cast("long") < 50 * n, "C": 100 * capitals.cast("long") > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}


def _bits(fails: dict[str, Column]) -> Column:
    out = F.lit(0)
    for k, f in enumerate(fails.values()):
        out = out + F.when(f, 1 << k).otherwise(0)
    return out.cast("int")


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each source (null: empty) by which filters they fail, a bit a letter of
    FILTERS, with how many of them are labelled good (quality 1) and toxic.

    A document fails the last filter if a document with a smaller id has the same text; rows of one id don't make each other
    fail, and rows without an id neither fail it nor make others fail. A null text counts as empty. Labels that repeat an id
    count once: good or toxic if any of them says so.

    Copies are counted by text, id and flags, then by text and flags, before a window compares what is left of a text: a row
    for each source and label at most, however many copies there are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text_"))
    rows = read.select("id", "part", F.unhex(F.sha2(F.col("text_").cast("binary"), 256)).alias("digest"), _bits(own_failures(F.col("text_"))).alias("mask"))
    rows = materialize(rows)
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
    told = told.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    nameless = rows.where("id is null").select("*", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    rows = rows.where("id is not null").join(told, "id", "left").fillna(0, ["good", "toxic"]).unionByName(nameless)
    by = ["digest", "part", "mask", "good", "toxic"]
    once = rows.groupBy("id", *by).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least")
    few = once.groupBy(*by).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), least)
    first = F.col("least.id") == F.min("least.id").over(Window.partitionBy("digest"))
    passing = (F.col("nameless") + F.when(first, F.col("least.n")).otherwise(0)).alias("passing")
    few = few.select("part", "mask", "good", "toxic", "n", passing)
    last = F.lit(1 << (len(FILTERS) - 1))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + last).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    cells = few.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(cells: DataFrame, letters: str = FILTERS) -> DataFrame:
    """For each part, order of the filters and step, what the step's filter does; zeros included. cells has part, mask, n, good
    and toxic, a mask's bits standing for the letters in turn.

    kept: documents that no filter up to this step fails; removed: fail here first; redundant: fail here, but are removed
    already; unique_fails: fail this filter and no other; good_lost, toxic_lost: of the removed; shapley: what this filter
    removes, summed over its steps in all orders. The rows made are the cells times the steps of all orders."""
    steps = [("".join(o), k + 1, 1 << letters.index(f)) for o in permutations(letters) for k, f in enumerate(o)]
    table = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(bit).alias("bit")) for o, k, bit in steps))
    rows = cells.select("part", "mask", "n", "good", "toxic", F.inline(table))
    failed = F.col("mask").bitwiseAND(F.col("bit"))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"failed": failed, "earlier": F.coalesce(F.bit_or(failed).over(before), F.lit(0))})
    here, gone = F.col("failed") != 0, F.col("earlier") != 0
    count = lambda when, what: F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("long")
    made = rows.groupBy("part", "filter_order", "step", "bit").agg(
        count(~here & ~gone, "n").alias("kept"), count(here & ~gone, "n").alias("removed"), count(here & gone, "n").alias("redundant"),
        count(F.col("mask") == F.col("bit"), "n").alias("unique_fails"), count(here & ~gone, "good").alias("good_lost"), count(here & ~gone, "toxic").alias("toxic_lost"))
    return made.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions of the five filters on docs (doc_id, source, text), with labels (doc_id, quality, toxic). An empty table
    gives no rows; a source with documents has a row for each order and step."""
    return interactions(materialize(mask_cells(docs, labels)))
