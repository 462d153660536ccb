"""Joins of spans of dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], days: int = 182) -> DataFrame:
    """Every left with every right row of equal ``keys`` whose span of dates shares a day with its own, both ends included.

    A span is put into each stretch of ``days`` days that it touches and the two sides meet by stretch, an equal-value join that
    Spark shuffles or broadcasts as it likes.  A pair counts in the first stretch that both touch alone.  Spans with a
    null end, or that end before they begin, meet nothing.  Apart from the keys the sides have no column in common.
    """

    def stretch(d: Column) -> Column:
        return F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / days).cast("int")

    def dealt(rows: DataFrame, span: tuple[str, str], begin: str) -> DataFrame:
        first, last = (F.col(c) for c in span)
        return rows.where(first <= last).withColumn(begin, stretch(first)).withColumn("__stretch", F.explode(F.sequence(stretch(first), stretch(last))))

    met = dealt(left, left_span, "__a").join(dealt(right, right_span, "__b"), [*keys, "__stretch"])
    shared = (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1]))
    return met.where(shared & (F.col("__stretch") == F.greatest("__a", "__b"))).drop("__stretch", "__a", "__b")


def label_runs(labels: DataFrame) -> DataFrame:
    """(label, first, last, next) of every run of equal labels (d, label); next is the first date of the run after it."""
    found = windows.runs(labels.withColumn("all", F.lit(1)), "all", "d", "label")
    return found.withColumn("next", F.lead("first").over(windows.by("all", "first"))).select("label", "first", "last", "next")


def bands(slices: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, nth, label, from, to): the runs of ``labels`` laid over slices (keys, start, end) and cut to them.

    A slice's first band begins with the slice, any other with its run; a band ends where the next run begins, the last with the slice.
    """
    met = overlaps(slices, label_runs(labels), [], ("start", "end"), ("first", "last"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("first"))
    met = met.withColumn("nth", nth)
    begin = F.when(F.col("nth") == 1, F.col("start")).otherwise(F.col("first"))
    return met.select(*keys, "nth", "label", begin.alias("from"), F.when(F.col("next") <= F.col("end"), F.col("next")).otherwise(F.col("end")).alias("to"))
