"""Texts from a table of rules.

A rule is a row: the topic that it speaks for and its place there, the reading that it looks at, bounds (from low on, below high; null is
open), a text, and how a number goes into it.  So what is said, when, and in which order are data; one join and one formatter
make the texts of any number of items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import printed

RULE = "topic string, nth int, reading string, low double, high double, text string, colour string, shown string, format string, scale double"
Rule = tuple[str, int, str, float | None, float | None, str, str | None, str | None, str | None, float]


def table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    exact = [(*r[:3], *(None if x is None else float(x) for x in r[3:5]), *r[5:9], float(r[9])) for r in rules]
    return spark.createDataFrame(exact, RULE)


def readings(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, reading, value) of the number columns ``values``, nulls left out."""
    cells = F.array(*(F.struct(F.lit(v).alias("reading"), F.col(v).cast("double").alias("value")) for v in values))
    return rows.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*").where("value is not null")


def told(found: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, topic, text, colour): of every item and topic the first rule whose reading is there and within bounds.

    ``{}`` in a text stands for the reading ``shown`` times scale in the rule's format; a rule whose shown reading is missing does not hold.
    """
    met = found.join(F.broadcast(rules), "reading")  # rules are a fixed table
    met = met.where((F.col("low").isNull() | (F.col("value") >= F.col("low"))) & (F.col("high").isNull() | (F.col("value") < F.col("high"))))
    other = found.select(*keys, F.col("reading").alias("shown"), F.col("value").alias("number"))
    met = met.join(other, [*keys, "shown"], "left").where("shown is null or number is not null")
    number = F.when(F.col("shown").isNotNull(), printed(F.col("format"), F.col("number") * F.col("scale"))).otherwise("")
    line = F.struct("nth", F.replace(F.col("text"), F.lit("{}"), number).alias("text"), "colour")
    return met.groupBy(*keys, "topic").agg(F.min_by(line, F.col("nth")).alias("x")).select(*keys, "topic", "x.text", "x.colour")


def rgba(colour: Column, alpha: float = 0.15) -> Column:
    """'#rrggbb' as 'rgba(r,g,b,alpha)'; anything else gives a blue."""
    digits = F.regexp_extract(colour, "^#*([0-9a-fA-F]{6})$", 1)
    parts = [F.conv(F.substring(digits, 1 + 2 * i, 2), 16, 10) for i in range(3)]
    return F.when(digits != "", F.concat(F.lit("rgba("), F.concat_ws(",", *parts, F.lit(str(alpha))), F.lit(")"))).otherwise(f"rgba(29,78,216,{alpha})")
