"""Window operators over series: each adds a column to a long table of (series, d, v) without nulls.

A window partitions by series, orders by date and counts rows, not days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by(key: str = "series", order: str = "d") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def last_rows(n: int, key: str = "series", order: str = "d") -> WindowSpec:
    return by(key, order).rowsBetween(1 - n, 0)


def so_far(key: str = "series", order: str = "d") -> WindowSpec:
    return by(key, order).rowsBetween(Window.unboundedPreceding, 0)


def change(v: Column, n: int, key: str = "series", order: str = "d") -> Column:
    return v - F.lag(v, n).over(by(key, order))


def pct_change(v: Column, n: int, key: str = "series", order: str = "d") -> Column:
    return F.try_divide(v, F.lag(v, n).over(by(key, order))) - 1


def forward_return(v: Column, n: int = 4, key: str = "series", order: str = "d") -> Column:
    return F.try_divide(F.lead(v, n).over(by(key, order)), v) - 1


def rolling_mean(v: Column, n: int, least: int | None = None, key: str = "series", order: str = "d") -> Column:
    own = last_rows(n, key, order)
    return F.when(F.count(v).over(own) >= (least or n), F.avg(v).over(own))


def long_mean(v: Column, n: int, key: str = "series", order: str = "d") -> Column:
    """Mean of the last n rows (all, if fewer) from running sums: a frame of n rows costs n steps a row, this one two.

    ``v`` has no nulls.
    """
    total, rows = F.sum(v).over(so_far(key, order)), F.count(F.lit(1)).over(so_far(key, order))
    before = F.sum(v).over(by(key, order).rowsBetween(Window.unboundedPreceding, -n))
    return (total - F.coalesce(before, F.lit(0.0))) / F.least(rows, F.lit(n))


def rolling_std(v: Column, n: int, least: int | None = None, key: str = "series", order: str = "d") -> Column:
    own = last_rows(n, key, order)
    return F.when(F.count(v).over(own) >= (least or n), F.stddev_samp(v).over(own))


def zscore(v: Column, n: int = 252, guard: int | None = None, key: str = "series", order: str = "d") -> Column:
    """Of each row among the last n; null before ``guard`` values (max(30, n // 4)); 0 where they are all alike."""
    own = last_rows(n, key, order)
    sd = F.stddev_samp(v).over(own)
    enough = F.count(v).over(so_far(key, order)) >= (max(30, n // 4) if guard is None else guard)
    return F.when(enough & v.isNotNull(), F.when(sd == 0, 0.0).otherwise((v - F.avg(v).over(own)) / sd))


def rank_among(v: Column, n: int, least: int, key: str = "series", order: str = "d") -> Column:
    """Percentage of the last n rows, this one counted, strictly below this one."""
    own = last_rows(n, key, order)
    below = F.size(F.filter(F.collect_list(v).over(own), lambda x: x < v))
    return F.when(F.count(v).over(own) >= least, below * 100.0 / F.count(v).over(own))


def rank_before(v: Column, n: int = 252, least: int = 63, key: str = "series", order: str = "d") -> Column:
    """Share of the n - 1 rows before this one that are below it; null with fewer than ``least`` rows, this one counted."""
    own = by(key, order).rowsBetween(1 - n, -1)
    some = F.collect_list(v).over(own)
    return F.when(F.size(some) >= least - 1, F.size(F.filter(some, lambda x: x < v)) / F.size(some))


def drawdown(v: Column, key: str = "series", order: str = "d") -> Column:
    top = F.max(v).over(so_far(key, order))
    return F.try_divide(v - top, top) * 100


def rebased(v: Column, key: str = "series", order: str = "d") -> Column:
    return F.try_divide(v, F.first(v).over(so_far(key, order))) * 100


def trend_up(v: Column, n: int = 63, key: str = "series", order: str = "d") -> Column:
    return (v > F.lag(v, n).over(by(key, order))).cast("int")


def uniform_rank(v: Column, key: str = "series") -> Column:
    """Average rank over rows + 1, strictly between 0 and 1."""
    whole = Window.partitionBy(key)
    ties = F.count(F.lit(1)).over(Window.partitionBy(key, v))
    return (F.rank().over(whole.orderBy(v)) + (ties - 1) / 2) / (F.count(F.lit(1)).over(whole) + 1)


def newest_first(key: str = "series", order: str = "d") -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))


def runs(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """(key, label, first, last, n) of every run of equal labels."""
    same = F.lag(label).over(by(key, order)).eqNullSafe(F.col(label)).cast("int")
    numbered = rows.withColumn("__new", F.when(F.lag(F.lit(1)).over(by(key, order)).isNull(), 1).otherwise(1 - same))
    numbered = numbered.withColumn("__run", F.sum("__new").over(so_far(key, order)))
    return numbered.groupBy(key, "__run", label).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("__run")
