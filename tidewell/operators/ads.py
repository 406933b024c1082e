"""Ad performance: facts of three grains, ratios of sums, tables, trends and action summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.dates import bucket
from tidewell.functions.numbers import ratio

SUMS = ("impressions", "clicks", "cost")


def level() -> Column:
    """FLT-14: the grain of a fact, told by its blank ids."""
    return F.when(F.col("keyword_id") != "", "keyword").when(F.col("adgroup_id") != "", "adgroup").otherwise("campaign")


def sums() -> list[Column]:
    return [F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum("cost").cast("decimal(18,2)").alias("cost")]


def with_ratios(rows: DataFrame) -> DataFrame:
    """AGG-36: click-through in percent and cost of a click, from sums; null without impressions or clicks."""
    return rows.withColumns({"ctr": ratio(F.col("clicks"), F.col("impressions"), 100.0), "cpc": ratio(F.col("cost"), F.col("clicks"))})


def campaign_or_groups(ads: DataFrame) -> DataFrame:
    """AGG-31: a campaign's own rows of a day, or its ad groups' sum where it has none."""
    rows = ads.withColumn("level", level()).where("level <> 'keyword'")
    at = lambda name, c: F.sum(F.when(F.col("level") == name, F.col(c)))
    has = F.count_if(F.col("level") == "campaign") > 0
    pick = [F.when(has, at("campaign", c)).otherwise(at("adgroup", c)).cast("decimal(18,2)" if c == "cost" else "long").alias(c) for c in SUMS]
    return rows.groupBy("metric_date", "campaign_id").agg(*pick)


def campaign_table(ads: DataFrame) -> DataFrame:
    """AGG-29: campaigns' totals with those of their ad groups as an array; a campaign has its last name, and of a day's
    several the greatest."""
    groups = ads.where(level() == "adgroup").groupBy("campaign_id", "adgroup_id").agg(*sums())
    nested = groups.groupBy("campaign_id").agg(F.array_sort(F.collect_list(F.struct("adgroup_id", *SUMS))).alias("adgroups"))
    name = F.max(F.when(F.col("campaign_name") != "", F.struct("metric_date", "campaign_name")))["campaign_name"]
    return ads.where(level() == "campaign").groupBy("campaign_id").agg(name.alias("campaign_name"), *sums()).join(nested, "campaign_id", "left")


def campaign_trend(ads: DataFrame, granularity: str, most: int = 8) -> DataFrame:
    """AGG-30: click-through in each period of the campaigns with most clicks; null where there are no impressions."""
    rows = ads.where(level() == "campaign")
    top = rows.groupBy("campaign_id").agg(F.sum("clicks").alias("n")).orderBy(F.desc("n"), "campaign_id").limit(most)
    each = rows.join(F.broadcast(top.select("campaign_id")), "campaign_id").groupBy("campaign_id", bucket(F.col("metric_date"), granularity).alias("period")).agg(*sums())
    return with_ratios(each).select("campaign_id", "period", "ctr", "clicks")


def top_keywords(ads: DataFrame, most: int) -> DataFrame:
    """SRT-02."""
    return ads.where(level() == "keyword").groupBy("keyword_id").agg(*sums()).orderBy(F.desc("clicks"), "keyword_id").limit(most)


def action_rows(ads: DataFrame, actions: str = "actions", values: str = "action_values") -> DataFrame:
    """SRC-13: a row for each type of action of an ad's day from two arrays of (action_type, value); of repeated types the
    last counts, and types that have a value only count 0."""
    key = [c for c in ads.columns if c not in (actions, values)]

    def exploded(column, name):
        rows = ads.select(*key, F.posexplode(column).alias("pos", "a")).select(*key, F.col("a.action_type").alias("action_type"), "pos", F.col("a.value").alias("v"))
        return rows.groupBy(*key, "action_type").agg(F.max_by("v", "pos").alias(name))

    made = exploded(actions, "action_count").join(exploded(values, "action_value"), [*key, "action_type"], "full_outer")
    return made.withColumn("action_count", F.coalesce("action_count", F.lit(0).cast(dict(made.dtypes)["action_count"])))


def action_summary(actions: DataFrame, redundant: list[str], catalog: DataFrame) -> DataFrame:
    """AGG-38: totals by type of action, without those that only repeat another or are zero, in the catalog's order
    (action_type, place); types that the catalog lacks follow, the greatest first."""
    total = actions.where(~F.col("action_type").isin(redundant)).groupBy("action_type").agg(F.sum("n").alias("total")).where("total <> 0")
    found = total.join(catalog, "action_type", "left")
    order = Window.orderBy(F.col("place").asc_nulls_last(), F.col("total").desc(), "action_type")  # one row a type
    return found.withColumn("position", F.row_number().over(order))


def funnel(rows: DataFrame, type_column: str, value: str, steps: list[str], last: list[str], keys: list[str]) -> DataFrame:
    """AGG-39: sums of the steps, and of the first type among `last` that occurs."""
    at = lambda t: F.sum(F.when(F.col(type_column) == t, F.col(value)))
    return rows.groupBy(*keys).agg(*(F.coalesce(at(s), F.lit(0)).alias(s) for s in steps), F.coalesce(*(F.nullif(at(t), F.lit(0)) for t in last)).alias("converted"))
