"""Aggregates of series: last values, summaries, weeks, distributions, rank correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import newest_first


def friday(d: Column) -> Column:
    """The Friday on or after a date."""
    return F.next_day(F.date_sub(d, 1), "FRI")


def weekly(series: DataFrame) -> DataFrame:
    """The last value of every week that has one; d is the week's Friday, which may be later."""
    return series.groupBy("series", friday(F.col("d")).alias("w")).agg(F.max_by("v", "d").alias("v")).select("series", F.col("w").alias("d"), "v")


def tail(series: DataFrame, n: int) -> DataFrame:
    """The last n rows of every series, with their number ``rn`` from the end."""
    return series.withColumn("rn", newest_first()).where(F.col("rn") <= n)


def since(series: DataFrame, days: int) -> DataFrame:
    """Rows of the last days before the newest date of all series."""
    newest = series.agg(F.max("d").alias("newest"))
    return series.join(F.broadcast(newest)).where(F.col("d") >= F.date_sub("newest", days)).drop("newest")


def tail_zscore(series: DataFrame, n: int = 252, guard: int | None = None) -> DataFrame:
    sd = F.stddev_samp("v")
    z = F.when(sd == 0, 0.0).otherwise((F.max_by("v", "d") - F.avg("v")) / sd)
    rows = tail(series, n).groupBy("series").agg(F.count("v").alias("n"), F.max_by("v", "d").alias("last"), z.alias("z"))
    return rows.withColumn("z", F.when(F.col("n") >= (max(30, n // 4) if guard is None else guard), F.col("z")))


def tail_rank(series: DataFrame, n: int = 252, least: int | None = None) -> DataFrame:
    """Percentage of the last n rows strictly below the last; null with fewer than ``least`` (n) rows."""
    rows = tail(series, n)
    last = F.max_by("v", "d").over(Window.partitionBy("series"))
    return rows.withColumn("last", last).groupBy("series").agg(F.when(F.count("v") >= (least or n), F.avg((F.col("v") < F.col("last")).cast("double")) * 100).alias("pct"))


def summary(series: DataFrame) -> DataFrame:
    first, last = F.min_by("v", "d"), F.max_by("v", "d")
    return series.groupBy("series").agg(
        first.alias("first"), last.alias("last"), (last - first).alias("change"), (F.try_divide(last, first) * 100 - 100).alias("change_pct"),
        F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n"), F.max("d").alias("newest"),
    )


def back(series: DataFrame, days: int) -> DataFrame:
    """Last value, the last one at least so many calendar days earlier, their difference and ratio."""
    newest = Window.partitionBy("series")
    rows = series.withColumn("__last", F.max("d").over(newest)).where(F.col("d").isNotNull())
    old = F.max_by(F.when(F.col("d") <= F.date_sub("__last", days), F.col("v")), F.when(F.col("d") <= F.date_sub("__last", days), F.col("d")))
    out = rows.groupBy("series").agg(F.max_by("v", "d").alias("last"), old.alias("before"))
    return out.withColumn("delta", F.col("last") - F.col("before")).withColumn("ret", F.try_divide(F.col("last"), F.col("before")) - 1)


def distribution(rows: DataFrame, keys: list[str], least: int = 8) -> DataFrame:
    """Quantiles, hit rate, payoff, quarter Kelly share and yearly ratio of returns ``fwd`` in each group of at least so many."""
    win, loss = F.col("fwd") > 0, F.col("fwd") <= 0
    quantiles = F.percentile("fwd", F.array(*(F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95))))
    got = rows.where("fwd is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), quantiles.alias("q"), F.avg("fwd").alias("mean"), F.stddev_pop("fwd").alias("sd"),
        F.avg(win.cast("double")).alias("win_rate"), F.coalesce(F.avg(F.when(win, F.col("fwd"))), F.lit(0.0)).alias("gain"),
        F.coalesce(F.abs(F.avg(F.when(loss, F.col("fwd")))), F.lit(1e-6)).alias("loss"),
    ).where(F.col("n") >= least)
    got = got.withColumn("payoff", F.try_divide("gain", "loss"))
    kelly = F.greatest(F.lit(0.0), F.col("win_rate") - F.coalesce(F.try_divide(1 - F.col("win_rate"), F.col("payoff")), F.lit(1e12)))
    names = ("p5", "p25", "p50", "p75", "p95")
    return got.select(*keys, "n", *(F.col("q")[i].alias(x) for i, x in enumerate(names)), "mean", "win_rate", "payoff", (kelly * 0.25).alias("kelly"), (F.try_divide("mean", "sd") * 52**0.5).alias("ratio"))


def markov(rows: DataFrame, key: str, order: str, label: str, labels: list[str]) -> DataFrame:
    """Counts and shares of every step from one label to the next, in all pairs of ``labels`` for every key."""
    ahead = F.lead(label).over(Window.partitionBy(key).orderBy(order))
    steps = rows.select(key, F.col(label).alias("from"), ahead.alias("to")).where("to is not null").groupBy(key, "from", "to").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*(F.lit(x) for x in labels))
    dense = rows.select(key).distinct().withColumn("from", F.explode(names)).withColumn("to", F.explode(names))
    dense = dense.join(steps, [key, "from", "to"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return dense.withColumn("share", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(key, "from"))), F.lit(0.0)))


def pairs(series: DataFrame) -> DataFrame:
    """(a, b, d, x, y): values of every two series a < b on the dates that both have."""
    left = series.select(F.col("series").alias("a"), "d", F.col("v").alias("x"))
    right = series.select(F.col("series").alias("b"), "d", F.col("v").alias("y"))
    return left.join(right, "d").where("a < b")


def pair_returns(both: DataFrame, least: int = 52) -> DataFrame:
    """(a, b, d, x, y): changes of both from one week's last common date to the next week's, for pairs of at least so many."""
    own = Window.partitionBy("a", "b").orderBy("d")
    weeks = both.groupBy("a", "b", friday(F.col("d")).alias("w")).agg(F.max_by(F.struct("x", "y"), "d").alias("last")).select("a", "b", F.col("w").alias("d"), "last.x", "last.y")
    rows = weeks.select("a", "b", "d", *((F.try_divide(c, F.lag(c).over(own)) - 1).alias(c) for c in ("x", "y"))).where("x is not null and y is not null")
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("a", "b"))).where(F.col("n") >= least).drop("n")


def kendall(both: DataFrame) -> DataFrame:
    """Kendall's tau-b for every (a, b) of ``pairs``.

    A pair of series meets each of its dates with each earlier one: use it on weekly values, of which
    there are some hundreds.
    """
    left, right = both.alias("l"), both.alias("r")
    met = left.join(right, (F.col("l.a") == F.col("r.a")) & (F.col("l.b") == F.col("r.b")) & (F.col("l.d") < F.col("r.d")))
    sx, sy = F.signum(F.col("r.x") - F.col("l.x")), F.signum(F.col("r.y") - F.col("l.y"))
    sums = met.groupBy("l.a", "l.b").agg(F.sum(sx * sy).alias("s"), F.sum(F.abs(sx)).alias("nx"), F.sum(F.abs(sy)).alias("ny"))
    return sums.select("a", "b", F.try_divide(F.col("s"), F.sqrt(F.col("nx") * F.col("ny"))).alias("tau"))


def spearman(both: DataFrame, n: int = 63) -> DataFrame:
    """Rank correlation of the last n common dates of every (a, b)."""
    own = Window.partitionBy("a", "b")
    rows = both.withColumn("rn", F.row_number().over(own.orderBy(F.desc("d")))).where(F.col("rn") <= n)
    for c in ("x", "y"):
        ties = F.count(F.lit(1)).over(Window.partitionBy("a", "b", c))
        rows = rows.withColumn(f"r{c}", F.rank().over(own.orderBy(c)) + (ties - 1) / 2)
    return rows.groupBy("a", "b").agg(F.corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def clayton(tau: Column) -> tuple[Column, Column]:
    """Parameter and lower tail dependence of a Clayton copula; both 0 for tau of 0.05 or less."""
    theta = F.greatest(F.try_divide(2 * tau, 1 - tau), F.lit(0.01))
    fits = tau > 0.05
    return F.when(fits, theta).when(tau.isNotNull(), 0.0), F.when(fits, F.pow(F.lit(2.0), -1 / theta)).when(tau.isNotNull(), 0.0)


def implied_rho(tau: Column) -> Column:
    """Rank correlation that tau lets expect."""
    return F.when(tau > 0.05, tau * (tau + 2) / 3).when(tau >= 0, 0.0).otherwise(tau)


def capped(rows: DataFrame, score: str, left: str, right: str, most: int, each: int, fewer: dict[str, int] | None = None) -> DataFrame:
    """Greedy pick by score: no name more than ``each`` times (or its own limit), at most ``most`` rows.

    The pick is sequential by nature, so it runs over one ordered array: for tables of candidate pairs
    of a fixed list of names (some hundreds), not of facts.  Ties go by the names; null scores are left out.
    """
    names = sorted(c for c in rows.columns)
    item = F.struct((-F.col(score)).alias("__by"), F.col(left).alias("__l"), F.col(right).alias("__r"), F.struct(*names).alias("row"))
    limit = F.create_map(*(F.lit(x) for p in (fewer or {"": each}).items() for x in p))
    ordered = rows.where(F.col(score).isNotNull()).agg(F.array_sort(F.collect_list(item)).alias("all"))

    def room(acc: Column, name: Column) -> Column:
        used = F.size(F.filter(acc, lambda x: (x["__l"] == name) | (x["__r"] == name)))
        return used < F.coalesce(F.try_element_at(limit, name), F.lit(each))

    def step(acc: Column, x: Column) -> Column:
        return F.when((F.size(acc) < most) & room(acc, x["__l"]) & room(acc, x["__r"]), F.concat(acc, F.array(x))).otherwise(acc)

    picked = ordered.select(F.posexplode(F.aggregate("all", F.slice("all", 1, 0), step)).alias("pos", "x"))
    return picked.select((F.col("pos") + 1).alias("place"), "x.row.*")
