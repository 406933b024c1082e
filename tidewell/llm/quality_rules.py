"""Quality rules with adaptive thresholds.

Ratios of each text are compared with bounds of its own language and source.  The bounds come from quantile sketches:
counts of documents by bins of a ratio that are as fine as a part per million near zero and 1/32 of the ratio elsewhere.
Counts add up, so sketches of partitions, sources and languages merge exactly, and a sketch has at most BINS rows a ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import SPACE_CLASS, materialize

WINDOW = 8
#: Each ratio by what is counted, and of what.
RATIOS = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "echoes": ("n_echoes", "n_words"), "shouting": ("n_upper", "word_chars"), "long_words": ("n_long", "n_words")}
#: A bound lies SPREAD times the distance from the median to the upper quartile above that quartile, so up to a quarter of
#: a group may be bad.  A document fails if its count exceeds what the bound allows by more than ALLOWED for each usual length
#: of its group, the median of its documents' words: a few occurrences tell nothing, and in a text of many times the usual
#: length as many times a few.  So what is allowed follows the group even where its quartiles are zero.  A group's sketch is
#: joined by that of its language with a weight of PRIOR documents.
SPREAD, ALLOWED, PRIOR = 8, 4, 30
#: Bins of a sketch: 64 of one part per million, then 32 for each doubling up to a million.
BINS = 64 + 32 * 14


def _pairs(h: Column, gap: int) -> Column:
    """Hashes of what h stands for at i and at i + gap; the last `gap` values mean nothing."""
    return F.zip_with(h, F.slice(h, F.lit(gap + 1), F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns `keep` of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and, for the rules, n_upper (A-Z),
    n_lines, n_long (words of more than 18 characters) and n_echoes (words equal to the one before) of each whole text; null counts as empty.

    Repeated windows are found by hashes of 1, 2, 4 and then 8 words; only texts that repeat one are looked at further:
    their windows are sorted by hash, and neighbours that agree give the places, whose union is counted."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split("text_", SPACE_CLASS + "+"), lambda w: w != "")
    lines = F.filter(F.split("text_", "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    one = docs.select(*keep, text.alias("text_")).withColumns({"words_": words, "lines_": lines})
    n = F.size("words_")
    one = one.select(
        *keep, n.cast("long").alias("n_words"), F.length(F.translate("text_", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text_") - F.length(F.translate("text_", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"), F.size("lines_").cast("long").alias("n_lines"),
        (F.length("text_") - F.length(F.translate("text_", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        F.size(F.filter("words_", lambda w: F.length(w) > 18)).cast("long").alias("n_long"),
        F.size(F.filter(F.zip_with("words_", F.slice("words_", F.lit(2), F.greatest(n, F.lit(1))), lambda a, b: a == b), lambda x: x)).cast("long").alias("n_echoes"),
        F.when(n >= WINDOW, F.transform("words_", lambda w: F.xxhash64(w))).alias("h_"),
    )
    for gap in (1, 2, 4):
        one = one.withColumn("h_", _pairs(F.col("h_"), gap))
    one = one.withColumn("h_", F.when(F.col("n_words") >= WINDOW, F.slice("h_", F.lit(1), F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(1)))))
    repeats = F.col("n_words") >= WINDOW
    repeats &= F.size(F.array_distinct("h_")) < F.size("h_")
    one = one.withColumn("h_", F.when(repeats, F.sort_array(F.transform("h_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = F.zip_with("h_", F.slice("h_", F.lit(2), F.size("h_")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    one = one.withColumn("at_", F.when(F.col("h_").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(near, lambda x: x.isNotNull()))))))
    covered = F.zip_with("at_", F.slice("at_", F.lit(2), F.size("at_")), lambda a, b: F.when(b.isNull(), WINDOW).otherwise(F.least(b - a, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)
    return one.withColumn("n_repeat_words", F.coalesce(F.when(F.col("at_").isNotNull(), total), F.lit(0).cast("long"))).drop("h_", "at_")


def _bin(ppm: str) -> str:
    """The lower edge of the bin that a ratio in parts per million falls into: its six leading binary digits."""
    digits = f"greatest(length(bin({ppm})) - 6, 0)"
    return f"shiftleft(shiftright({ppm}, {digits}), {digits})"


def sketches(rows: DataFrame, *group: str) -> DataFrame:
    """(group, ratio, bin, n): how many documents have a ratio in a bin; the ratio 'length' is the number of words."""
    parts = ", ".join(f"'{r}', {a} * 1000000 div greatest({b}, 1)" for r, (a, b) in RATIOS.items())
    long = rows.select(*group, F.expr(f"stack({len(RATIOS) + 1}, {parts}, 'length', n_words) as (ratio, ppm)"))
    return long.groupBy(*group, "ratio", F.expr(_bin("ppm")).alias("bin")).agg(F.count("*").alias("n"))


def pooled(fine: DataFrame) -> DataFrame:
    """The sketches (lang_, source_, ratio, bin, n), each joined by its language's as if that were PRIOR documents more: a small
    source is judged mostly by its language, a large one by itself, without a jump.  Weights are whole numbers: n times the
    language's documents, and PRIOR times the language's n."""
    wide = fine.groupBy("lang_", "ratio", "bin").agg(F.sum("n").alias("wide"))
    total = wide.groupBy("lang_", "ratio").agg(F.sum("wide").alias("all"))
    named = lambda df: df.withColumnsRenamed({"lang_": "of_lang", "ratio": "of_ratio"})
    of = lambda a, b: a["lang_"].eqNullSafe(b["of_lang"]) & (a["ratio"] == b["of_ratio"])
    total, wide = named(total), named(wide)
    sources = fine.select("lang_", "source_", "ratio").distinct()
    more = sources.join(wide, of(sources, wide)).select("lang_", "source_", "ratio", "bin", (F.col("wide").cast("decimal(38,0)") * PRIOR).cast("decimal(38,0)").alias("w"))
    own = fine.join(total, of(fine, total)).select("lang_", "source_", "ratio", "bin", (F.col("n").cast("decimal(19,0)") * F.col("all").cast("decimal(18,0)")).cast("decimal(38,0)").alias("w"))
    return own.union(more).groupBy("lang_", "source_", "ratio", "bin").agg(F.sum("w").cast("decimal(38,0)").alias("w"))


def bounds(sketch: DataFrame, *group: str) -> DataFrame:
    """(group, a bound in parts per million for each ratio, and usual: the median length in words) from sketches of weights w."""
    part = Window.partitionBy(*group, "ratio")
    ranked = sketch.withColumn("upto", F.sum("w").over(part.orderBy("bin"))).withColumn("total", F.sum("w").over(part))
    q = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bin")))
    found = ranked.groupBy(*group, "ratio").agg(q(2).alias("mid"), q(3).alias("high"))
    found = found.withColumn("bound", F.col("high") + SPREAD * (F.col("high") - F.col("mid")))
    usual = F.max(F.when(F.col("ratio") == "length", F.col("mid"))).alias("usual")
    return found.groupBy(*group).agg(*(F.max(F.when(F.col("ratio") == r, F.col("bound"))).alias(f"{r}_bound") for r in RATIOS), usual)


def judge(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each row of docs: doc_id, `keep`, the five base measures, base_failed and kept.

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated windows.  kept: not base_failed, and no
    ratio above its bound for the language and source (null is a value of its own) by more than ALLOWED occurrences for each
    usual length of the group, once at least.  Documents that fail the base rules are left out of the sketches."""
    names = list(dict.fromkeys(["doc_id", *keep]))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row_"), "text", F.col("lang").cast("string").alias("lang_"), F.col("source").cast("string").alias("source_"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = materialize(measures(held, "row_", "lang_", "source_").withColumn("base_failed", failed))
    fine = materialize(sketches(rows.where("not base_failed"), "lang_", "source_"))
    own = bounds(pooled(fine), "lang_", "source_").withColumnsRenamed({"lang_": "own_lang", "source_": "own_source"})
    own = materialize(own)  # its size is known when the join is planned
    both = rows.join(own, rows["lang_"].eqNullSafe(own["own_lang"]) & rows["source_"].eqNullSafe(own["own_source"]), "left")
    passed = ~F.col("base_failed")
    allowed = ALLOWED * F.greatest(F.col("n_words") / F.col("usual"), F.lit(1.0))
    for r, (a, b) in RATIOS.items():
        passed &= F.coalesce((F.col(a) - allowed) * 1000000.0 <= F.col(f"{r}_bound").cast("double") * F.col(b).cast("double"), F.lit(True))
    return both.select("row_.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", passed.alias("kept"))
