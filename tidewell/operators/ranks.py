"""Keyword ranks: best ranks, snapshots, baselines and trends.  A lower rank is better; null means not found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.scans import running

# Days back at which a baseline is looked for, in order of preference
OFFSETS = (14, 15, 13, 16, 12, 17, 11, 18, 10, 19, 20)


def wide(ranks: DataFrame, keys: list[str], sections: list[str]) -> DataFrame:
    """AGG-02: a column for each section, and the best of them."""
    return ranks.groupBy(*keys).agg(*(F.min(F.when(F.col("section") == s, F.col("rank_value"))).alias(f"rank_{s}") for s in sections), F.min("rank_value").alias("rank_best"))


def best_by_day(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("hospital_id", "keyword", "metric_date").agg(F.min("rank_value").alias("rank_value"))


def baseline_dates(days: DataFrame) -> DataFrame:
    """JN-19: for each hospital's day, the earlier day with data at the most preferred offset; null if there is none."""
    wanted = days.select("hospital_id", "metric_date", F.posexplode(F.array(*map(F.lit, OFFSETS))).alias("preference", "offset"))
    wanted = wanted.withColumn("baseline", F.date_sub("metric_date", F.col("offset")))
    there = wanted.join(days.select("hospital_id", F.col("metric_date").alias("baseline")), ["hospital_id", "baseline"], "left_semi")
    found = there.groupBy("hospital_id", "metric_date").agg(F.min_by("baseline", "preference").alias("baseline"))
    return days.join(found, ["hospital_id", "metric_date"], "left")


def trend(current: Column, previous: Column) -> Column:
    """WIN-09: 1 for a better rank than before, -1 for a worse one, 0 where either is missing."""
    return F.coalesce(F.signum(previous - current), F.lit(0.0)).cast("int")


def against_baseline(ranks: DataFrame) -> DataFrame:
    """JN-17: each hospital's newest day beside its baseline day, keyword by keyword."""
    best = best_by_day(ranks)
    newest = best.groupBy("hospital_id").agg(F.max("metric_date").alias("metric_date"))
    dates = baseline_dates(best.select("hospital_id", "metric_date").distinct()).join(newest, ["hospital_id", "metric_date"], "left_semi")
    now = best.join(dates, ["hospital_id", "metric_date"])
    then = best.select("hospital_id", "keyword", F.col("metric_date").alias("baseline"), F.col("rank_value").alias("previous"))
    both = now.join(then, ["hospital_id", "keyword", "baseline"], "left")
    return both.select("hospital_id", "keyword", "metric_date", "baseline", F.col("rank_value").alias("current"), "previous", trend(F.col("rank_value"), F.col("previous")).alias("trend"))


def as_of(days: DataFrame, least_back: int) -> DataFrame:
    """JN-20: for each hospital's day, the latest one with data that lies at least so many days back.

    Wanted days and days with data are merged and read in order, so there is no join of ranges; a hospital of any size is cut
    into spans of days."""
    have = days.select("hospital_id", F.col("metric_date").alias("at"), F.col("metric_date").alias("have"), F.lit(None).cast("date").alias("metric_date"), F.lit(0).alias("o"))
    want = days.select("hospital_id", F.date_sub("metric_date", least_back).alias("at"), F.lit(None).cast("date").alias("have"), "metric_date", F.lit(1).alias("o"))
    return running(have.union(want), ["hospital_id"], ["at", "o"], lasts={"baseline": "have"}).where("o = 1").select("hospital_id", "metric_date", "baseline")


def nearest(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, right_id: str, seconds: int) -> DataFrame:
    """JN-18: left with the id of the row of right with the same key that is nearest in time, within so many seconds; of
    equally near ones the earlier, then the smaller id.

    Both are merged in order of time; the last row of right before and the first one after are all that can be nearest.  A
    key is cut into spans of time no shorter than `seconds`, and right's rows are read in the spans beside their own too, so
    a task holds a few spans of a key, however many rows the key has."""
    span = max(seconds, 3600) * 1_000_000
    t = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = F.floor(F.col("t_") / span)
    l_type = left.select(F.struct("*")).schema[0].dataType
    points = right.select(F.col(key), t(right_time).alias("t_"), F.struct(t(right_time).alias("t"), F.col(right_id).alias("id")).alias("r_"))
    # of points at one instant the smallest id counts
    points = points.groupBy(key, "t_").agg(F.min("r_").alias("r_"))
    points = points.select(key, "t_", "r_", F.lit(None).cast(l_type).alias("l_"), F.explode(F.array(own - 1, own, own + 1)).alias("span_"))
    asked = left.select(F.col(key), t(left_time).alias("t_"), F.lit(None).cast(points.schema["r_"].dataType).alias("r_"), F.struct("*").alias("l_")).withColumn("span_", own)
    part = Window.partitionBy(key, "span_")
    back = part.orderBy("t_").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = part.orderBy(F.col("t_").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = points.unionByName(asked).select("*", F.max("r_").over(back).alias("a_"), F.min("r_").over(ahead).alias("b_")).where("l_ is not null")
    far = lambda c: F.abs(F.col(f"{c}.t") - F.col("t_"))
    best = F.when(F.col("b_").isNull() | (far("a_") <= far("b_")), F.col("a_")).otherwise(F.col("b_"))
    both = both.withColumn("best_", best)
    return both.select("l_.*", F.when(far("best_") <= seconds * 1_000_000, F.col("best_.id")).alias(f"nearest_{right_id}"))


def drops(ranks: DataFrame, vanished: int = 999) -> DataFrame:
    """WIN-10 and WIN-11: change of the best rank against the day before with data: positive is worse, 999 means vanished,
    null a new entry or no rank at all."""
    order = Window.partitionBy("hospital_id", "keyword").orderBy("metric_date")
    rows = best_by_day(ranks).withColumn("previous", F.lag("rank_value").over(order))
    change = F.when(F.col("previous").isNull(), None).when(F.col("rank_value").isNull(), vanished).otherwise(F.col("rank_value") - F.col("previous"))
    return rows.withColumn("drop", change)


def by_slot(ranks: DataFrame, slots: list[int]) -> DataFrame:
    """JN-24: own rank (slot 0) beside competitors', a row a keyword and day."""
    names = {s: "own" if s == 0 else f"c{s}" for s in slots}
    return ranks.groupBy("hospital_id", "keyword", "metric_date").agg(*(F.min(F.when(F.col("slot") == s, F.col("rank_value"))).alias(n) for s, n in names.items()))


def importance_order() -> list[Column]:
    """SRT-01: important keywords first (unknown counts as medium), then the best ranked."""
    place = F.when(F.col("importance") == "high", 0).when(F.col("importance") == "low", 2).otherwise(1)
    return [place, F.col("rank_value").asc_nulls_last(), F.col("keyword")]


def presets(board: DataFrame) -> DataFrame:
    """FLT-15: which of a keyword board's presets each row of drops falls under."""
    now, before = F.col("rank_value"), F.col("previous")
    return board.withColumns({
        "dropped": F.coalesce(now > before, F.lit(False)), "fell_off": before.isNotNull() & now.isNull(),
        "near": F.coalesce(now.between(11, 15), F.lit(False)), "entered": before.isNull() & now.isNotNull(),
    })
