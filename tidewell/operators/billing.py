"""Metered usage and the token ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.periods import balance
from tidewell.operators.scans import running
from tidewell.operators.storage import written

TOKEN_USD = "0.01"
# Features whose price is a multiple, or a part, of their cost
THIRTYFOLD = ("blog-write", "blog-rewrite", "blog-draft", "blog-outline")
DISCOUNTED = ("health_report",)


def tokens(cost: Column, feature: Column) -> Column:
    """MTH-07 and BIL-01: tokens of an operation's cost, whole and rounded up before and after the feature's factor."""
    plain = F.ceil(cost / F.lit(TOKEN_USD).cast("decimal(4,2)"))
    return F.when(feature.isin(*THIRTYFOLD), plain * 30).when(feature.isin(*DISCOUNTED), F.ceil(plain * F.lit("0.8").cast("decimal(2,1)"))).otherwise(plain).cast("long")


def product(feature: Column) -> Column:
    """AGG-20: the product that a feature belongs to, by its name."""
    return F.when(feature.like("blog%"), "blog").when(feature.like("%alimtalk%"), "alimtalk").when(feature == "health_report", "report").otherwise("other")


def charges(usage: DataFrame, charged: DataFrame | None = None) -> DataFrame:
    """BIL-01: one charge for each operation of a hospital that costs anything and is not charged yet.  The operation's
    feature is the first by name."""
    ops = usage.where("hospital_id is not null").groupBy("hospital_id", "operation_id").agg(F.sum("cost_usd").cast("decimal(18,6)").alias("cost_usd"), F.min("feature").alias("feature"), F.max("ts").alias("created_at"))
    if charged is not None:
        ops = ops.join(charged.select("operation_id").distinct(), "operation_id", "left_anti")
    made = ops.withColumn("tokens", -tokens(F.col("cost_usd"), F.coalesce("feature", F.lit("")))).where("tokens < 0")
    return made.withColumn("product", product(F.coalesce("feature", F.lit(""))))


def ledger(charged: DataFrame, grants: DataFrame) -> DataFrame:
    """WIN-14 and BIL-02: charges and grants (hospital_id, operation_id, tokens, created_at) with the balance after each."""
    rows = charged.select("hospital_id", "operation_id", F.lit("charge").alias("kind"), "tokens", "created_at").unionByName(grants.withColumn("kind", F.lit("grant")))
    return balance(rows, ["hospital_id"], ["created_at", "operation_id"], "tokens")


def covered(requests: DataFrame, key: str, seq: str, amount: str) -> DataFrame:
    """Grants (above zero) and deductions in the order of seq, which numbers a key's requests: accepted and balance_after for
    each. Balances start at zero; a deduction that the balance does not cover is refused, and so is a request of zero.

    If nothing were refused, balances would be running sums. What is refused only adds to them, so a balance is never below the
    running sum, nor below what is left if a deduction takes only what is there; by that, a deduction can be refused only where
    the running sum sinks to a new low below zero. Sums and lows come from spans of rows, whatever a key's size. Those few rows
    are read in order, with what was refused before as the only state; all others take the refused total of the last one."""
    rows = written(running(requests.select(key, seq, amount), [key], [seq], sums={"plain_": amount}, lows={"low_": "plain_"}))
    doubtful = rows.where((F.col(amount) < 0) & (F.col("plain_") < 0) & (F.col("plain_") == F.col("low_"))).select(key, seq, amount, "plain_")

    def replay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, refused = None, 0
        for part in parts:
            out = []
            for k, a, plain in zip(part[key], part[amount], part["plain_"]):
                if k != now:
                    now, refused = k, 0
                no = plain + refused < 0
                refused -= int(a) if no else 0
                out.append((no, refused))
            yield part[[key, seq]].assign(no_=[n for n, _ in out], refused_=[r for _, r in out])

    kinds = dict(requests.dtypes)
    told = written(doubtful.repartition(key).sortWithinPartitions(key, seq).mapInPandas(replay, f"{key} {kinds[key]}, {seq} {kinds[seq]}, no_ boolean, refused_ long"))
    refusing = told.where("no_").select(key).distinct()
    plain = rows.join(refusing, key, "left_anti").select(key, seq, (F.col(amount) != 0).alias("accepted"), F.col("plain_").cast("long").alias("balance_after"))
    some = rows.join(refusing, key, "left_semi").join(told, [key, seq], "left")
    some = running(some, [key], [seq], lasts={"before_": "refused_"})
    accepted = (F.col(amount) != 0) & ~F.coalesce("no_", F.lit(False))
    after = (F.col("plain_") + F.coalesce("before_", F.lit(0))).cast("long")
    return plain.unionByName(some.select(key, seq, accepted.alias("accepted"), after.alias("balance_after")))


def deducted(requests: DataFrame) -> DataFrame:
    """BIL-08: grants and deductions of each user in order (user_id, seq, amount), with accepted and balance_after."""
    return covered(requests, "user_id", "seq", "amount")


def renewals(subscriptions: DataFrame, as_of: str) -> DataFrame:
    """BIL-05: which subscriptions that are due by as_of can be paid, in order of their ends and products; each one paid
    lowers its hospital's balance, and one that cannot be paid lapses.

    Takes hospital_id, product_code, price_tokens, ends_at, auto_renew and balance; gives hospital_id, product_code, outcome
    (renewed, lapsed) and balance_after.  A balance below zero pays nothing, not even what is free."""
    due = subscriptions.where(F.col("ends_at") <= F.lit(as_of).cast("date"))
    place = F.row_number().over(Window.partitionBy("hospital_id").orderBy("ends_at", "product_code")).cast("long")
    due = written(due.withColumn("place_", place).withColumn("asked_", F.col("auto_renew") & (F.col("balance") >= 0)))
    opening = due.groupBy("hospital_id").agg(F.greatest(F.min("balance"), F.lit(0)).cast("long").alias("amount_")).select("hospital_id", F.lit(0).cast("long").alias("place_"), "amount_")
    asked = due.select("hospital_id", "place_", F.when(F.col("asked_"), -F.col("price_tokens")).otherwise(0).cast("long").alias("amount_"))
    found = covered(opening.unionByName(asked), "hospital_id", "place_", "amount_")
    paid = F.col("asked_") & (F.col("accepted") | (F.col("price_tokens") == 0))
    left = (F.col("balance_after") + F.least("balance", F.lit(0))).cast("long").alias("balance_after")
    return due.join(found, ["hospital_id", "place_"]).select("hospital_id", "product_code", F.when(paid, "renewed").otherwise("lapsed").alias("outcome"), left)


def usage_by(usage: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """AGG-15 and JN-14: cost, calls and last use of each row of a dimension; 0 and null where it was not used."""
    made = usage.groupBy(key).agg(F.sum("cost_usd").cast("decimal(18,6)").alias("cost_usd"), F.count("*").alias("n_calls"), F.max("ts").alias("last_used"))
    return dim.join(made, key, "left").fillna(0, ["n_calls"]).withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0).cast("decimal(18,6)")))


def run_status(done: Column, last: Column, stale_before: Column) -> Column:
    """STM-06: a run that is not done and has not been heard of for long has failed."""
    return F.when(done, "succeeded").when(last < stale_before, "failed").otherwise("running")


def message_charges(sent: DataFrame, refunded: DataFrame, krw_a_token: int) -> DataFrame:
    """BIL-03: the tokens that messages (hospital_id, operation_id, krw) cost, and what is to be given back: nothing where the
    operation has been refunded before."""
    cost = F.ceil(F.col("krw") / krw_a_token).cast("long")
    known = refunded.select("operation_id", F.lit(True).alias("done_")).distinct()
    both = sent.where("krw > 0").join(known, "operation_id", "left")
    return both.select("hospital_id", "operation_id", (-cost).alias("tokens"), F.when(F.col("done_").isNull(), cost).otherwise(0).alias("refund"))


def confirmed_orders(orders: DataFrame, packages: DataFrame) -> DataFrame:
    """BIL-06: orders (package_id, status) with the outcome of confirming them, and the tokens that are granted: only pending
    orders of a known package get any."""
    both = orders.join(packages, "package_id", "left")
    outcome = F.when(F.col("base_tokens").isNull(), "invalid_package").when(F.col("status") != "pending", "not_pending").otherwise("ok")
    return both.withColumn("outcome", outcome).withColumn("granted", F.when(F.col("outcome") == "ok", F.col("base_tokens") + F.col("bonus_tokens")))


def backfilled_products(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """BIL-10: entries (run_id, feature, product_code) whose missing product is told by the feature or else by what their run
    holds (has_blog, has_report)."""
    of_run = F.when(F.col("has_blog"), "case_blog").when(F.col("has_report"), "health_report")
    feature = F.col("feature")
    told = F.when(feature.like("blog%"), "case_blog").when(feature == "health_report", "health_report").when(feature == "admin_extract", of_run)
    told = told.when(feature.like("%alimtalk%"), F.when(F.col("run_id").isNotNull(), "health_report").otherwise("survey"))
    return entries.join(runs, "run_id", "left").withColumn("product_code", F.coalesce("product_code", told))
