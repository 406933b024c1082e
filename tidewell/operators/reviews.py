"""Reviews: monthly counts, sentiments and competitors."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.dates import bucket
from tidewell.functions.numbers import ratio

# The five levels of sentiment
SENTIMENTS = ("strong_positive", "positive", "neutral", "negative", "strong_negative")


def monthly(reviews: DataFrame, as_of: date, months: int) -> DataFrame:
    """AGG-40: own reviews of each of the last months, that of as_of included; 0 where there are none."""
    first = F.trunc(F.add_months(F.lit(as_of), 1 - months), "month")
    spine = reviews.select("hospital_id").distinct().withColumn("month", F.explode(F.sequence(first, F.lit(as_of.replace(day=1)), F.expr("interval 1 month"))))
    counts = reviews.where("slot is null").groupBy("hospital_id", bucket(F.col("visit_date"), "month").alias("month")).agg(F.count("*").alias("n"))
    return spine.join(counts, ["hospital_id", "month"], "left").select("hospital_id", "month", F.coalesce("n", F.lit(0).cast("long")).alias("n_reviews"))


def sentiment_counts(reviews: DataFrame) -> DataFrame:
    """AGG-40 and AGG-53: own reviews of each sentiment, and the positive among the positive and negative in percent."""
    made = reviews.where("slot is null").groupBy("hospital_id").agg(*(F.count_if(F.col("sentiment") == s).alias(f"n_{s}") for s in SENTIMENTS))
    good, bad = F.col("n_strong_positive") + F.col("n_positive"), F.col("n_negative") + F.col("n_strong_negative")
    return made.withColumn("positive_pct", ratio(good, good + bad, 100.0))


def against_competitors(reviews: DataFrame, slots: list[int]) -> DataFrame:
    """AGG-41: reviews of each month, own and of each competitor."""
    n = lambda s: F.count_if(F.coalesce("slot", F.lit(0)) == s)
    return reviews.where("visit_date is not null").groupBy("hospital_id", bucket(F.col("visit_date"), "month").alias("month")).agg(n(0).alias("own"), *(n(s).alias(f"c{s}") for s in slots))
