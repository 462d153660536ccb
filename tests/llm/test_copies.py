"""Whole copies from rates: rows that share an id, and equal rows, meet their share of the target together."""

import math

from pyspark.sql import functions as F

from saltmarsh.llm import mixing

SCHEMA = "doc_id long, source string, __text long, rate double, other string"


def test_rows_that_share_an_id_are_rounded_apart(spark):
    """Of 400 different texts without an id, each with a rate of 0.651, about 260 are taken, not none."""
    rows = spark.createDataFrame([(None, "s", t, 0.651, "x") for t in range(400)], SCHEMA)
    got = [r.copies for r in mixing.dealt_copies(rows).collect()]
    assert len(got) == 400 and set(got) == {0, 1} and abs(sum(got) - 400 * 0.651) < 40


def test_equal_rows_share_the_copies_of_all(spark):
    n = 3 * mixing.BLOCK + 5
    rows = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit(1).cast("long").alias("__text"), F.lit(1.3).alias("rate"), F.lit("x").alias("other"))
    got = mixing.dealt_copies(rows.unionByName(rows.limit(1).withColumn("__text", F.lit(2).cast("long")))).groupBy("__text", "copies").count().collect()
    of_one = {r.copies: r["count"] for r in got if r["__text"] == 1}
    assert sum(of_one.values()) == n and set(of_one) == {1, 2}
    assert sum(k * v for k, v in of_one.items()) in (math.floor(n * 1.3), math.floor(n * 1.3) + 1)
    assert sum(r["count"] for r in got if r["__text"] == 2) == 1
    assert mixing.dealt_copies(rows.limit(0)).collect() == []


def test_rates_over_texts_of_one_id(spark):
    text = {"en": "the cat and the dog are in the house by the river ", "de": "der hund und die katze sind im haus am fluss "}
    docs = [(i % 3 or None, f"{text[lang]}{i}", lang, "s") for i in range(120) for lang in text]
    labelled = [(1000 + i, text[lang], lang, "s") for i, lang in enumerate(text)]
    df = spark.createDataFrame(docs + labelled, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1000, 1), (1001, 1)], "doc_id long, quality int")
    got = mixing.mix_rates(df, labels, targets={"en": 0.5, "de": 0.5}).collect()
    assert len(got) == len(docs) + 2
    expected, taken = sum(r.rate for r in got), sum(r.copies for r in got)
    assert abs(taken - expected) < 0.1 * expected
