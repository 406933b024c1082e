"""Small choices between rows of one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.numbers import parse_number
from tidewell.functions.text import bare_store_name
from tidewell.operators.joins import dealt_join
from tidewell.operators.similarity import containments


def preferring(rows: DataFrame, preferred: Column) -> DataFrame:
    """FLT-13: only the preferred rows if there are any, else all; the test is one row, so it goes to every task."""
    has = rows.agg(F.coalesce(F.bool_or(preferred), F.lit(False)).alias("has_"))
    return rows.crossJoin(F.broadcast(has)).where(preferred | ~F.col("has_")).drop("has_")


def scoped(rows: DataFrame, users: DataFrame, user: str) -> DataFrame:
    """FLT-16: the rows of the user's hospital; all of them for an administrator.  users has user_id, hospital_id and is_admin."""
    me = users.where(F.col("user_id") == user).select(F.col("hospital_id").alias("of_"), "is_admin")
    return rows.join(F.broadcast(me), (rows["hospital_id"] == me["of_"]) | me["is_admin"], "left_semi")  # one user's rows


def first_number(rows: DataFrame, names: list[str]) -> Column:
    """PRJ-02: the first of some columns, those of them that rows has, that holds a number."""
    return F.coalesce(*(parse_number(F.col(n).cast("string")) for n in names if n in rows.columns), F.lit(None).cast("decimal(18,2)"))


def since(rows: DataFrame, day: str, first: str, everything: bool = False) -> DataFrame:
    """FLT-06: rows from a day on, or all of them."""
    return rows if everything else rows.where(F.col(day) >= F.lit(first).cast("date"))


def scopes(rows: DataFrame, day: str, firsts: dict[str, str | None]) -> DataFrame:
    """FLT-06: rows with scope, once for each scope that they are in: those from its first day on, or all of them; rows are read
    once, however many scopes there are."""
    names = [F.lit(n) if first is None else F.when(F.col(day) >= F.lit(first).cast("date"), n) for n, first in firsts.items()]
    return rows.withColumn("scope", F.explode(F.array_compact(F.array(*names))))


def kept_added_removed(before: Column, after: Column) -> tuple[Column, Column, Column]:
    """SET-04: members of both, of the later only and of the earlier only; repeats stay, as they do in a comparison of lists."""
    in_ = lambda a, b: F.filter(a, lambda x: F.array_contains(b, x))
    out = lambda a, b: F.filter(a, lambda x: ~F.array_contains(b, x))
    return in_(after, before), out(after, before), out(before, after)


def field_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """SET-05: fields (key, value) whose values differ; those that are gone afterwards count as empty, new ones are passed over."""
    now = after.select(*key, F.coalesce("value", F.lit("")).alias("final"))
    both = before.select(*key, F.coalesce("value", F.lit("")).alias("draft")).join(now, key, "left").withColumn("final", F.coalesce("final", F.lit("")))
    return both.where("draft <> final")


def by_phone(asked: DataFrame, phone: str, done: DataFrame, other: str, order: list[str], most: int) -> DataFrame:
    """JN-27: the rows of done whose phone number has the same digits, in order, the first `most` of each row asked for.  Rows
    of done are numbered within their own number before they are joined, so no more than `most` of a number meet anybody."""
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    place = F.row_number().over(Window.partitionBy("digits_").orderBy(*order))
    first = done.withColumn("digits_", digits(other)).where("digits_ <> ''").withColumn("place", place).where(F.col("place") <= most)
    return asked.withColumn("digits_", digits(phone)).join(first, "digits_").drop("digits_")


def same_stores(targets: DataFrame, target: str, seen: DataFrame, shown: str, by: list[str]) -> DataFrame:
    """JN-25: rows of targets and of seen (which share no columns but `by`) whose names are one store's, by text.is_store: either
    contains the other, white space aside; a name that is part of the store's needs four characters."""
    t, s = (df.withColumn(f"{k}_", bare_store_name(F.col(c))) for df, c, k in ((targets, target, "t"), (seen, shown, "s")))
    named = lambda df, c: df.select(*by, F.col(c).alias("name"))
    wide = containments(named(s, "s_"), named(t, "t_"), by).select(*by, F.col("name").alias("t_"), F.col("holder").alias("s_"))
    narrow = containments(named(t, "t_"), named(s, "s_").where(F.length("name") >= 4), by).select(*by, F.col("holder").alias("t_"), F.col("name").alias("s_"))
    pairs = wide.unionByName(narrow).distinct()
    return dealt_join(t.join(pairs, [*by, "t_"]).drop("t_"), s, [*by, "s_"]).drop("s_")
