"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import SPACE_CLASS, materialize

#: The most often that a document may appear.
MOST = 3


def count_words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    ends = F.when(parts[0] == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): targets by the weights 1, 2, 3 repeating in order of source
    (code points, null last), none above `most` times its source's size.

    The total is poured in at one level a unit of weight.  In order of capacity a weight, a source is full if even an
    equal share of what the fuller ones leave would exceed its capacity; the rest share what is left by weight.  The
    windows here run over one row a source, never over documents."""
    sums = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    caps = sums.select("source", "source_size", (((rank - 1) % 3) + 1).cast("long").alias("weight")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    poured = caps.select("source", "source_size", "weight", "cap", left.alias("left"), (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("heavy"))
    poured = poured.withColumn("level", F.col("left").cast("double") / F.col("heavy")).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("full"), F.struct(-F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy(F.lit(0)))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * level["level"])
    return poured.select("source", "source_size", target.alias("target"))


def _draw(seed: int) -> Column:
    """52 bits of a hash of seed, id and text."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _copies(draw: Column, most: int, target: str = "target", size: str = "source_size") -> Column:
    """floor(rate), and one more with the probability of the fraction."""
    rate = F.when(F.col(size) > 0, F.least(F.col(target) / F.col(size), F.lit(float(most)))).otherwise(F.lit(0.0))
    return (F.floor(rate) + (draw < (rate - F.floor(rate)) * float(1 << 52)).cast("long")).cast("long")


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows joined with their source's target.  The targets are written first, so their size is known when Spark plans
    the join: it sends them to all tasks only below its threshold, and the rows then stay where they are."""
    named = materialize(targets.withColumnRenamed("source", "of_source"))
    return rows.join(named, rows["source"].cast("string").eqNullSafe(named["of_source"])).drop("of_source")


def repetitions(docs: DataFrame, seed: int = 0, most: int = MOST) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies) for each row of docs.

    A source's rate is its target over its size.  Each document gets floor(rate) copies, and one more with probability
    equal to the fraction, told by a hash of seed, id and text: reruns agree whatever the partitions.  Null ids, texts
    and sources are values like any other; rows that repeat are decided alike.  A source without words has no copies."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"), _draw(seed).alias("draw"))
    rows = materialize(rows)
    both = _with_targets(rows, source_targets(rows.select("source", "size"), most))
    return both.select("doc_id", "size", "source", "source_size", "target", _copies(F.col("draw"), most).alias("copies"))


def mix(docs: DataFrame, seed: int = 0, most: int = MOST) -> DataFrame:
    """docs with each row repeated as often as the mix takes it, and dropped where that is never.  Any other columns, whatever
    their names, go with their rows; an empty table stays empty."""
    source = F.col("source").cast("string").alias("source")
    sizes = docs.select(source, count_words(F.col("text")).alias("size"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), source, _draw(seed).alias("draw"))
    both = _with_targets(rows, source_targets(sizes, most)).withColumn("copies", _copies(F.col("draw"), most))
    return both.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
