"""Nested payloads of ad platforms, review pages and intake forms as typed rows.  What a payload lacks is null, or zero in counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import dates, numbers, text

MONEY = "decimal(18,2)"


def _at(path: str) -> Column:
    return F.get_json_object("payload", f"$.{path}")


def _number(*paths: str) -> Column:
    return F.coalesce(*(numbers.parse_number(_at(p)) for p in paths))


def _count(*paths: str) -> Column:
    return F.coalesce(_number(*paths), F.lit(0)).cast("long")


def _id(path: str) -> Column:
    return F.coalesce(_at(path), F.lit(""))


def search_ads(rows: DataFrame) -> DataFrame:
    """SRC-10: facts at the grain of a campaign, ad group or keyword; ids that a grain lacks are blank."""
    ids = [F.coalesce(c, F.lit("")).alias(c) for c in ("campaign_id", "adgroup_id", "keyword_id")]
    return rows.select(F.col("metric_date").cast("date").alias("metric_date"), "hospital_id", *ids, _count("impCnt").alias("impressions"), _count("clkCnt").alias("clicks"), _number("salesAmt").cast(MONEY).alias("cost"))


def google_ads(rows: DataFrame) -> DataFrame:
    """SRC-11."""
    return rows.select(
        _at("segments.date").cast("date").alias("metric_date"), _id("campaign.id").alias("campaign_id"), _at("campaign.name").alias("campaign_name"), _id("adGroup.id").alias("ad_group_id"),
        _count("metrics.impressions").alias("impressions"), _count("metrics.clicks").alias("clicks"), _count("metrics.costMicros", "metrics.cost_micros").alias("cost_micros"), _number("metrics.conversions").cast("double").alias("conversions"))


def social_ads(rows: DataFrame) -> DataFrame:
    """SRC-12."""
    return rows.select(
        _at("date_start").cast("date").alias("metric_date"), _id("campaign_id").alias("campaign_id"), _id("ad_id").alias("ad_id"), _count("impressions").alias("impressions"), _count("clicks").alias("clicks"),
        _count("reach").alias("reach"), F.coalesce(_number("spend"), F.lit(0)).cast(MONEY).alias("spend"), _at("account_currency").alias("currency"))


def reviews(rows: DataFrame, as_of: Column) -> DataFrame:
    """SRC-16: reviews of two shapes (kind: visitor or photo) as one; those without a date, and visitors' without an id, go."""
    visitor = F.col("kind") == "visitor"
    kept = [c for c in rows.columns if c != "payload"]
    day = lambda c: dates.parse_review_date(c, as_of)
    ids = F.when(visitor, _at("id")).otherwise(F.coalesce(F.nullif(_at("logId"), F.lit("")), F.nullif(_at("viewId"), F.lit(""))))
    body = F.nullif(F.trim(F.when(visitor, _at("body")).otherwise(_at("text"))), F.lit(""))
    read = rows.select(*kept, visitor.alias("v_"), ids.alias("id_"), body.alias("content"), F.coalesce(_at("author.id"), F.lit("None")).alias("by_"), day(F.when(visitor, _at("created")).otherwise(_at("date"))).alias("d_"), day(_at("visited")).alias("at_"))
    told = read.select(*kept, "v_", "id_", "content", "by_", F.when(F.col("v_"), F.coalesce("d_", "at_")).otherwise(F.col("d_")).alias("review_date"), F.when(F.col("v_"), F.coalesce("at_", "d_")).alias("visit_date"))
    signed = F.md5(F.concat_ws("|", F.substring(F.coalesce("content", F.lit("")), 1, 60), F.col("review_date").cast("string"), "by_"))
    given = F.when(F.col("v_"), F.nullif("id_", F.lit(""))).otherwise(F.coalesce("id_", signed))
    made = told.select(*kept, F.concat(F.when(F.col("v_"), "vr:").otherwise("ph:"), given).alias("review_id"), "review_date", "visit_date", "content")
    return made.where("review_id is not null and review_date is not null")


def intake(rows: DataFrame) -> DataFrame:
    """SRC-19: phone as national digits, species and sex as codes, birth as a date; null where an entry tells nothing."""
    digits = F.regexp_replace("phone", r"\D", "")
    phone = F.when(digits.startswith("82"), F.concat(F.lit("0"), F.substring(digits, F.lit(3), F.length(digits)))).otherwise(digits)
    sex = F.when(F.col("sex").rlike("암|여|(?i)^f"), "F").when(F.col("sex").rlike("수|남|(?i)^m"), "M")
    return rows.withColumns({"phone": F.nullif(phone, F.lit("")), "species": text.species_profile(F.col("species")), "sex": sex, "birth": F.coalesce(dates.parse_mixed_date(F.col("birth")), dates.leading_iso_date(F.col("birth")))})
