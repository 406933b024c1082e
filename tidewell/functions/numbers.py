"""Expressions on numbers and arrays: tolerant parsing, ratios, prices, clamps and set likeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(c: Column) -> Column:
    """MTH-01: a number written with commas, spaces or a currency sign; null if it is none."""
    return F.regexp_replace(c, r"(?U)[,\s₩원]", "").try_cast("decimal(18,2)")


def parse_amount(c: Column) -> Column:
    """MTH-01: like parse_number, but what is no number counts as zero."""
    return F.coalesce(parse_number(c), F.lit(0).cast("decimal(18,2)"))


def parse_count(c: Column) -> Column:
    """MTH-02: a struct of a count and whether it was given only as "< 10"."""
    under = F.coalesce(F.contains(c, F.lit("<")), F.lit(False))
    return F.struct(F.when(under, 10).otherwise(F.regexp_replace(c, r"[,\s]", "").try_cast("int")).alias("value"), under.alias("under10"))


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """MTH-03 and AGG-36: a ratio of sums; null where the whole is zero or null."""
    return F.when(whole != 0, part.cast("double") * scale / whole.cast("double"))


def ratio_or_zero(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """AGG-36: like ratio, but zero where there is no whole."""
    return F.coalesce(ratio(part, whole, scale), F.lit(0.0))


def change_percent(now: Column, before: Column) -> Column:
    """Change against an earlier value in percent; null unless that is above zero."""
    return F.when(before > 0, (now - before).cast("double") * 100 / before.cast("double"))


def clamp(c: Column, low: float, high: float) -> Column:
    """MTH-10."""
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def position_percent(value: Column, low: Column, high: Column) -> Column:
    """MTH-08: where a value lies in its range, in percent, no further out than ten percent; null without a range."""
    return F.when(high > low, clamp((value - low) * 100 / (high - low), -10.0, 110.0))


def llm_cost(prices: tuple[Column, Column, Column], used: tuple[Column, Column, Column, Column]) -> Column:
    """MTH-05: cost of a call from prices of a million input, cached and output tokens and the numbers of input, cached,
    output and thinking tokens; cached tokens are among the input's."""
    zero = F.lit(0)
    price_in, price_cached, price_out = (F.coalesce(p, zero).cast("decimal(12,6)") for p in prices)
    n_in, n_cached, n_out, n_thought = (F.coalesce(n, zero).cast("decimal(12,0)") for n in used)
    return ((n_in - n_cached) * price_in + n_cached * price_cached + (n_out + n_thought) * price_out) / F.lit(1_000_000)


def set_key(members: Column | str) -> Column:
    """A set as jaccard() takes it: without blanks and repeats, in order; an empty one for null."""
    c = F.col(members) if isinstance(members, str) else members
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.trim(v) != "")))


def jaccard(a: Column, b: Column) -> Column:
    """ARR-01: shared members over all members of two arrays, blanks and repeats aside; 0 for two empty ones."""
    clean = lambda x: F.array_distinct(F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda v: F.trim(v) != ""))
    both = F.size(F.array_union(clean(a), clean(b)))
    return F.when(both > 0, F.size(F.array_intersect(clean(a), clean(b))) / both).otherwise(0.0)


def merged_set(a: Column, b: Column) -> Column:
    """ARR-02 and SET-03: the members of either array, once each, in order."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)))


def nice_axis(highest: Column) -> Column:
    """MTH-09: a struct (step, ticks) of the axis that rises least above the highest value, with four to six steps of 1, 2,
    2.5 or 5 times a power of ten; of equals the one with fewer steps."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(highest.cast("double"), F.lit(1.0)) / 4)))
    options = [F.struct((power * m * n - highest).alias("over"), F.lit(n).alias("ticks"), (power * m).alias("step")) for n in (4, 5, 6) for m in (1.0, 2.0, 2.5, 5.0, 10.0)]
    best = F.array_min(F.filter(F.array(*options), lambda o: o["over"] >= 0))
    return F.when(highest > 0, F.struct(best["step"].alias("step"), best["ticks"].alias("ticks")))


def price_of(model: Column, prices: dict[str, tuple[str, str, str]]) -> tuple[Column, Column, Column]:
    """MTH-05: prices of a million input, cached and output tokens of the longest name that a model's name begins with; null
    for unknown models."""
    found = [F.lit(None).cast("decimal(12,6)")] * 3
    for name in sorted(prices, key=len):
        found = [F.when(model.startswith(name), F.lit(p).cast("decimal(12,6)")).otherwise(f) for p, f in zip(prices[name], found)]
    return tuple(found)


def unit_cost(unit: Column, prices: dict[str, str], units: Column) -> Column:
    """MTH-06: the price of a unit times their number; 0 for an unknown unit."""
    price = F.lit("0").cast("decimal(12,6)")
    for name, p in prices.items():
        price = F.when(unit == name, F.lit(p).cast("decimal(12,6)")).otherwise(price)
    return price * F.coalesce(units, F.lit(0))
