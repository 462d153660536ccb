"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ladder of labels by score.
LABELS = (("Risk On", 75), ("Bullish", 60), ("Neutral", 40), ("Bearish", 25), ("Risk Off", None))


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def signal(z: Column, cap: float = 2.5) -> Column:
    """-1 to 1 from a z-score; none is 0."""
    return F.greatest(F.least(F.coalesce(z, F.lit(0.0)), F.lit(cap)), F.lit(-cap)) / cap


def goldilocks(y: Column, low: float = 1.5, high: float = 2.5, hot: float = 3.5, cold: float = 0.5) -> Column:
    over = F.least((y - high) / max(hot - high, 0.1), F.lit(1.5))
    under = F.least((low - y) / max(low - cold, 0.1), F.lit(1.5))
    return (
        F.when(y.isNull(), 0.0)
        .when(y.between(low, high), 1.0)
        .when(y > high, clip(1 - 2 * F.pow(F.greatest(over, F.lit(0.0)), F.lit(1.5)), -1, 1))
        .otherwise(clip(1 - 1.5 * F.pow(F.greatest(under, F.lit(0.0)), F.lit(1.2)), -1, 1))
    )


def label(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for name, least in LABELS:
        out = out.otherwise(name) if least is None else out.when(score >= least, name)
    return out


def momentum(delta: Column) -> Column:
    return F.when(delta >= 6, "Improving").when(delta <= -6, "Deteriorating").otherwise("Stable")


def confidence(missing: Column, total: int) -> Column:
    cover = (total - missing) / total
    return F.when(cover >= 0.85, "High").when(cover >= 0.60, "Medium").otherwise("Low")


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def printed(format: Column, x: Column) -> Column:
    """``x`` in a format with one number as C prints it: rounded from its exact binary value, halves to the even digit.

    ``format_string`` alone rounds the shortest decimal that stands for x, halves up: 0.15 (just below its half) as 0.2, 0.25 as 0.3.
    """
    places = F.coalesce(F.regexp_extract(format, r"\.(\d+)f", 1).try_cast("int"), F.lit(6))
    exact = F.call_function("format_number", x, F.concat(F.lit("0."), F.repeat(F.lit("0"), places))).try_cast("double")
    return F.call_function("format_string", format, F.coalesce(exact, x))  # an infinity has no digits


def mean_of(*terms: Column) -> Column:
    """Mean of the terms that are not null; null if none is.  Each term stands once in the expression."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"))
    some = F.filter(F.array(*terms), lambda x: x.isNotNull())
    return F.aggregate(some, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["n"] + 1).alias("n")), lambda acc: F.try_divide(acc["s"], acc["n"]))


def contribution(stored: Column, zscore: Column, weight: Column) -> Column:
    """What a component adds to the score: as stored, else z-score times weight, else 0."""
    return F.coalesce(stored, zscore * weight, F.lit(0.0))
