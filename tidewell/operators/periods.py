"""Roll-ups over periods, gap filling and comparisons between periods."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.dates import bucket
from tidewell.functions.numbers import change_percent
from tidewell.operators.scans import running


def rollup(rows: DataFrame, day: str, keys: list[str], sums: list[str], periods: tuple[str, ...] = ("year", "month", "week", "day")) -> DataFrame:
    """AGG-04 and AGG-05: sums of each period.  Rows are added up to days first, so only days count in each of their periods."""
    total = lambda s: F.sum(s).cast("decimal(18,2)" if dict(rows.dtypes)[s].startswith("decimal") else "long").alias(s)
    days = rows.groupBy(*keys, F.to_date(day).alias(day)).agg(*map(total, sums))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("period_type"), bucket(F.col(day), p).alias("period_start")) for p in periods))).alias("p")
    return days.select(*keys, *sums, each).groupBy(*keys, "p.period_type", "p.period_start").agg(*map(total, sums))


def day_spine(spark: SparkSession, first: date, last: date, step: str = "1 day", name: str = "day") -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr(f"interval {step}"))).alias(name))


def filled(rows: DataFrame, day: str, keys: list[str], values: list[str], step: str = "1 day") -> DataFrame:
    """JN-21: each key's days between its first and last, values null where a day has no row."""
    ends = rows.groupBy(*keys).agg(F.min(day).alias("a_"), F.max(day).alias("z_"))
    all_days = ends.select(*keys, F.explode(F.sequence("a_", "z_", F.expr(f"interval {step}"))).alias(day))
    return all_days.join(rows.select(*keys, day, *values), [*keys, day], "left")


def year_over_year(days: DataFrame, day: str, keys: list[str], value: str) -> DataFrame:
    """WIN-12: the twelve completed months before the month of each key's newest day, beside the same months a year earlier;
    null where a month has no rows."""
    months = days.groupBy(*keys, F.trunc(day, "month").alias("month")).agg(F.sum(value).cast("decimal(18,2)").alias("v_"))
    last = F.trunc(F.max(day), "month")
    spine = days.groupBy(*keys).agg(F.sequence(F.add_months(last, -12), F.add_months(last, -1), F.expr("interval 1 month")).alias("m_"))
    spine = spine.select(*keys, F.explode("m_").alias("month"))
    before = months.select(*keys, F.add_months("month", 12).alias("month"), F.col("v_").alias("previous"))
    return spine.join(months.withColumnRenamed("v_", "recent"), [*keys, "month"], "left").join(before, [*keys, "month"], "left")


def week_over_week(rows: DataFrame, day: str, keys: list[str], value: str) -> DataFrame:
    """WIN-13: the last seven days up to each key's newest day, and the seven before, in pairs; 0 for days without rows."""
    days = rows.groupBy(*keys, F.col(day).alias("d_")).agg(F.sum(value).alias("v_"))
    back = F.datediff(F.max("d_").over(Window.partitionBy(*keys)), "d_")
    near = days.withColumn("back_", back).where("back_ < 14")
    one, two = F.when(F.col("back_") < 7, F.col("v_")), F.when(F.col("back_") >= 7, F.col("v_"))
    spine = rows.select(*keys).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(6))))
    sums = near.withColumn("slot", (F.col("back_") % 7).cast("int")).groupBy(*keys, "slot").agg(F.sum(one).alias("current"), F.sum(two).alias("previous"))
    zero = F.lit(0).cast("decimal(18,2)")
    return spine.join(sums, [*keys, "slot"], "left").select(*keys, "slot", *(F.coalesce(F.col(c).cast("decimal(18,2)"), zero).alias(c) for c in ("current", "previous")))


def weekday_profile(days: DataFrame, day: str, keys: list[str], value: str) -> DataFrame:
    """AGG-42: for each weekday, Monday being 0, the average over the twelve calendar months up to each key's newest day, and
    day and value of the last seven days that fall on it.  days has a row a key and day."""
    newest = F.max(day).over(Window.partitionBy(*keys))
    rows = days.select(*keys, F.col(day).alias("d_"), F.col(value).alias("v_"), newest.alias("n_"))
    rows = rows.where(F.col("d_") >= F.add_months(F.trunc("n_", "month"), -11))
    means = rows.groupBy(*keys, F.weekday("d_").alias("weekday")).agg(
        (F.sum("v_").cast("double") / F.count("v_")).alias("average"), F.max(F.when(F.datediff("n_", "d_") < 7, F.col("v_"))).alias("last_value")
    )
    ends = days.groupBy(*keys).agg(F.max(day).alias("n_")).select(*keys, F.explode(F.sequence(F.date_sub("n_", 6), "n_")).alias("recent_day"))
    return ends.withColumn("weekday", F.weekday("recent_day")).join(means, [*keys, "weekday"], "left").select(*keys, "weekday", "average", "last_value", "recent_day")


def kpi_header(months: DataFrame, month: str, keys: list[str], value: str, today: Column) -> DataFrame:
    """AGG-51: each key's last month with a value before today's month, its changes against the month and the year before, and
    the sum of its year so far."""
    done = months.where(F.col(value).isNotNull() & (F.col(month) < F.trunc(today, "month")))
    rows = done.withColumn("last_", F.max(month).over(Window.partitionBy(*keys)))
    at = lambda n: F.max(F.when(F.col(month) == F.add_months("last_", -n), F.col(value)))
    made = rows.groupBy(*keys).agg(F.max("last_").alias("month"), at(0).alias("current"), at(1).alias("before"), at(12).alias("year_before"), F.sum(F.when(F.year(month) == F.year("last_"), F.col(value))).cast("decimal(18,2)").alias("year_to_date"))
    return made.select(*keys, "month", "current", change_percent(F.col("current"), F.col("before")).alias("mom_pct"), change_percent(F.col("current"), F.col("year_before")).alias("yoy_pct"), "year_to_date")


def period_kpis(days: DataFrame, day: str, keys: list[str], value: str, first: Column, last: Column, vets: int) -> DataFrame:
    """AGG-52: total and average of the months that start in a range, the average a vet, and the average of the range's days
    with a value above zero.  days has a row a key and day."""
    months = days.groupBy(*keys, F.trunc(day, "month").alias("m_")).agg(F.sum(value).alias("v_")).where(F.col("m_").between(first, last))
    months = months.groupBy(*keys).agg(F.sum("v_").cast("decimal(18,2)").alias("total"), (F.sum("v_").cast("double") / F.count("v_")).alias("month_average"))
    open_days = days.where(F.col(day).between(first, last) & (F.col(value) > 0)).groupBy(*keys).agg((F.sum(value).cast("double") / F.count(value)).alias("day_average"))
    both = months.join(open_days, keys, "full")
    return both.withColumn("vet_average", F.col("month_average") / vets if vets > 0 else F.lit(None).cast("double"))


def change_board(days: DataFrame, day: str, keys: list[str], values: list[str], today: Column, span: int = 28, stale: int = 3) -> DataFrame:
    """AGG-44: sums of the last `span` days before today and of as many before those, their change in percent (null where there
    was nothing before), and how old the newest day is."""
    back = F.datediff(today, day)
    now, before = back.between(1, span), back.between(span + 1, 2 * span)
    sums = [x for v in values for x in (F.sum(F.when(now, F.col(v))).alias(f"{v}_now"), F.sum(F.when(before, F.col(v))).alias(f"{v}_before"))]
    made = days.where(back >= 1).groupBy(*keys).agg(F.max(day).alias("newest"), *sums)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,2)")
    shown = [x for v in values for x in (zero(f"{v}_now").alias(f"{v}_now"), zero(f"{v}_before").alias(f"{v}_before"), change_percent(zero(f"{v}_now"), zero(f"{v}_before")).alias(f"{v}_change"))]
    age = F.datediff(today, "newest")
    return made.select(*keys, *shown, age.alias("age_days"), (age > stale).alias("is_stale"))


def worst_first(board: DataFrame, leading: str, changes: list[str]) -> list[Column]:
    """SRT-05: the order of a board by the leading change (none counts as 0), then by the worst of all changes, 0 at most."""
    return [F.coalesce(F.col(leading), F.lit(0.0)), F.array_min(F.array_append(F.filter(F.array(*changes), lambda x: x.isNotNull()), F.lit(0.0)))]


def balance(rows: DataFrame, keys: list[str], order: list[str], delta: str) -> DataFrame:
    """WIN-14: the running sum of a ledger's deltas; a key of any size is cut into spans."""
    made = running(rows, keys, order, sums={"balance_after": delta})
    return made.withColumn("balance_after", F.col("balance_after").cast("decimal(18,2)"))


def rebuilt_months(rows: DataFrame, changed: DataFrame, day: str, keys: list[str], value: str) -> DataFrame:
    """STM-07: the sums, anew, of the months in which changed rows lie."""
    month = F.trunc(day, "month").alias("month")
    touched = changed.select(*keys, month).distinct()
    return rows.select(*keys, month, value).join(touched, [*keys, "month"], "left_semi").groupBy(*keys, "month").agg(F.sum(value).cast("decimal(18,2)").alias(value))
