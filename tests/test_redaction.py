"""Texts and payloads without what must not be kept: against the patterns one after the other, and how long words are read."""

import random
import re
import time

from pyspark.sql import functions as F

from tidewell.functions import redaction, text


def redacted(t):
    for pattern, shown in [
        (r"\d{6}\s*-\s*[1-4]\d{6}", "[redacted:rrn]"), (r"01[016-9][-\s]?\d{3,4}[-\s]?\d{4}", "[redacted:phone]"), (r"0\d{1,2}[-\s]\d{3,4}[-\s]\d{4}", "[redacted:phone]"), (r"[\w.+-]+@[\w-]+\.[\w.-]+", "[redacted:email]"),
    ]:
        t = re.sub(pattern, shown, t, flags=re.ASCII)
    return t


def test_texts_are_those_of_one_pattern_after_the_other(spark):
    r = random.Random(5)
    parts = ["a", "b.c", "+", "@", "@", ".", "-", " ", "é", "x@y.z", "010-1234-5678", "900101-1234567", "@@", "a@b"]
    texts = ["a@b.c+d@e.f", "@a@b.c", "x" * 400 + "@b.co", *("".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(2000))]
    made = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n long, t string").select("n", text.redact(F.col("t")).alias("v"))
    assert {x["n"]: x["v"] for x in made.collect()} == {n: redacted(t) for n, t in enumerate(texts)}


def test_a_long_word_takes_about_as_long_as_short_ones(spark):
    def seconds(word):
        rows = spark.range(0, 20_000, 1, 8).select(text.redact(F.concat(F.repeat(F.lit(word), 480 // len(word)), F.col("id").cast("string"))).alias("v"))
        rows.write.format("noop").mode("overwrite").save()
        begun = time.time()
        rows.write.format("noop").mode("overwrite").save()
        return time.time() - begun

    assert seconds("x") < 8 * max(seconds("xxx "), 0.1)


def test_a_payload_is_parsed_once(spark):
    payloads = ['{"b":[1,{"name":"x","c":"a@b.co"}],"a":null}', "[]", "{}", '"call 010-1234-5678"', "no json a@b.co", "1.50", "null", None]
    made = spark.createDataFrame([(n, p) for n, p in enumerate(payloads)], "n int, p string").select("n", redaction.redact_json(F.col("p")).alias("v"))
    told = ['{"a":null,"b":[1,{"c":"[redacted:email]","name":"[redacted]"}]}', "[]", "{}", '"call [redacted:phone]"', '"no json [redacted:email]"', "1.5", "null", None]
    assert [r["v"] for r in made.orderBy("n").collect()] == told
    assert made._jdf.queryExecution().analyzed().toString().count("parse_json(") == 1
