"""Joins of series on dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Every left row with the values of the last right row of its key at or before its date (null if none).

    Both sides are laid over each other and the last right row so far is carried on: one shuffle by key and
    no join.
    """
    own = Window.partitionBy(key).orderBy(order, "__side").rowsBetween(Window.unboundedPreceding, 0)
    packed = F.struct(*values)
    rest = [c for c in left.columns if c not in (key, order)]
    a = left.select(key, order, F.lit(1).alias("__side"), F.struct(*rest).alias("__row") if rest else F.lit(1).alias("__row"), F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("__hit"))
    b = right.select(key, order, F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), packed.alias("__hit"))
    met = a.unionByName(b).withColumn("__hit", F.last("__hit", ignorenulls=True).over(own)).where("__side = 1")
    return met.select(key, order, *(F.col(f"__row.{c}").alias(c) for c in rest), *(F.col(f"__hit.{c}").alias(c) for c in values))


def named(series: DataFrame, name: str, column: str) -> DataFrame:
    return series.where(F.col("series") == name).select("d", F.col("v").alias(column))


def combined(series: DataFrame, names: list[str], value: Column) -> DataFrame:
    """(d, v): an expression of the named series' values (columns x0, x1, ...) on the dates that all have."""
    out = named(series, names[0], "x0")
    for i, name in enumerate(names[1:], 1):
        out = out.join(named(series, name, f"x{i}"), "d")
    return out.select("d", value.alias("v")).where("v is not null")


def net_of(series: DataFrame, base: str, minus: list[str]) -> DataFrame:
    """base less the other series, on the dates that base and every leg with any row have; base alone where they share no date."""
    names = [base, *minus]
    rows = series.where(F.col("series").isin(*names))
    there = rows.groupBy().agg(F.collect_set("series").alias("there"))  # at most as many names as legs
    wide = rows.groupBy("d").agg(*(F.max(F.when(F.col("series") == x, F.col("v"))).alias(f"x{i}") for i, x in enumerate(names)))
    wide = wide.where("x0 is not null").join(F.broadcast(there))
    complete = F.lit(True)
    net = F.col("x0")
    for i, name in enumerate(minus, 1):
        complete = complete & (F.col(f"x{i}").isNotNull() | ~F.array_contains("there", name))
        net = net - F.coalesce(F.col(f"x{i}"), F.lit(0.0))
    wide = wide.withColumn("complete", complete)
    some = wide.groupBy().agg(F.max(F.col("complete").cast("int")).alias("some"))
    out = wide.join(F.broadcast(some)).where("complete or some = 0")
    return out.select("d", F.when(F.col("some") == 1, net).otherwise(F.col("x0")).alias("v"))
