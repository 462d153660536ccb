"""Rule tables over the newest statistics of series: ladders of thresholds are data, judged by one expression.

``current`` makes a row per series with one shuffle by series; rule tables have a fixed number of rows, so
what is broadcast does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, printed

Step = tuple[str, float, int, str, str | None]
RULE = "key string, label string, series string, stat string, format string, scale double, delta string, steps array<struct<op:string,at:double,direction:int,colour:string,word:string>>, last_step struct<direction:int,colour:string,word:string>"


def current(series: DataFrame) -> DataFrame:
    """Newest value ``v`` of every series with z (252 rows, from 30 on; zr: unrounded), pct (252), changes over 7, 28 and 30 days, returns of 21 and 63 rows and (c7, c10, c21, c63) days, the means of 63 and 200 rows (from half of them on), a63 (the mean of 63, from 63 on), the z-score rz of 21-row returns, and of 5 rows the return r5."""
    new = Window.partitionBy("series").orderBy(F.desc("d"))
    rows = series.withColumn("rn", F.row_number().over(new)).withColumn("last", F.first("v").over(new)).withColumn("newest", F.first("d").over(new))
    rows = rows.withColumn("pc", F.try_divide("v", F.lag("v", 21).over(Window.partitionBy("series").orderBy("d"))) - 1)
    v, rn, last, n = F.col("v"), F.col("rn"), F.max("last"), F.count("v")

    def within(k: int) -> Column:
        return F.when(rn <= k, v)

    def since(days: int) -> Column:
        old = F.col("d") <= F.date_sub("newest", days)
        return last - F.max_by(F.when(old, v), F.when(old, F.col("d")))

    def calendar(days: int) -> Column:
        old = F.col("d") <= F.date_sub("newest", days)
        return F.try_divide(last, F.max_by(F.when(old, v), F.when(old, F.col("d")))) - 1

    def ret(k: int) -> Column:
        return F.try_divide(last, F.max(F.when(rn == k + 1, v))) - 1

    def mean(k: int) -> Column:
        return F.when(n >= k // 2, F.avg(within(k)))

    sd = F.stddev_samp(within(252))
    z = F.when(n >= 30, F.when(sd == 0, 0.0).otherwise((last - F.avg(within(252))) / sd))
    pc, spread = F.when(rn <= 252, F.col("pc")), F.stddev_samp(F.when(rn <= 252, F.col("pc")))
    rz = F.when(F.count("pc") >= 30, F.when(spread == 0, 0.0).otherwise((F.max(F.when(rn == 1, F.col("pc"))) - F.avg(pc)) / spread))
    below = F.when(rn <= 252, (v < F.col("last")).cast("double"))
    return rows.groupBy("series").agg(
        n.alias("n"), last.alias("v"), F.round(z, 3).alias("z"), F.when(n >= 252, F.round(F.avg(below) * 100, 1)).alias("pct"),
        z.alias("zr"), rz.alias("rz"), calendar(7).alias("c7"), calendar(10).alias("c10"), calendar(21).alias("c21"), calendar(63).alias("c63"), ret(5).alias("r5"), F.when(n >= 63, F.avg(within(63))).alias("a63"),
        since(7).alias("d7"), since(28).alias("d28"), since(30).alias("d30"), ret(21).alias("r21"), ret(63).alias("r63"), mean(63).alias("m63"), mean(200).alias("m200"),
    )


def spreads(roles: DataFrame, pairs: tuple[tuple[str, str, str, str], ...]) -> DataFrame:
    """Series (name, a, '-' or '/', b) on the dates that both have, in one grouping by date."""
    names = sorted({x for _, a, _, b in pairs for x in (a, b)})
    wide = roles.where(F.col("series").isin(*names)).groupBy("d").agg(*(F.max(F.when(F.col("series") == x, F.col("v"))).alias(x) for x in names))
    cells = F.array(*(F.struct(F.lit(name).alias("series"), (F.col(a) - F.col(b) if op == "-" else F.try_divide(a, b)).alias("v")) for name, a, op, b in pairs))
    return wide.select("d", F.explode(cells).alias("x")).select("x.series", "d", "x.v").where("v is not null")


def signals(stats: DataFrame, rules: list[tuple]) -> DataFrame:
    """key, value, formatted, zscore, delta, colour, label, direction of every rule whose series is there.

    A rule's steps are tried in order, a missing statistic counts as 0, and its last step holds where none does.
    """
    spark: SparkSession = stats.sparkSession
    met = stats.join(F.broadcast(spark.createDataFrame(rules, RULE)), "series")
    stat = F.when(F.col("stat") == "v", F.col("v")).when(F.col("stat") == "z", F.col("z")).when(F.col("stat") == "pct", F.col("pct"))
    value = F.when(F.col("key").startswith("breadth"), F.col("z")).when(F.col("stat") == "pct", F.col("pct")).otherwise(F.col("v"))
    met = met.withColumn("value", value).withColumn("x", F.coalesce(stat, F.lit(0.0))).where("value is not null")
    hit = F.get(F.filter("steps", lambda s: F.when(s["op"] == ">", F.col("x") > s["at"]).otherwise(F.col("x") < s["at"])), F.lit(0))
    met = met.withColumn("hit", hit)

    def of(part: str) -> Column:
        return F.when(F.col("hit").isNotNull(), F.col(f"hit.{part}")).otherwise(F.col(f"last_step.{part}"))

    delta = F.when(F.col("delta") == "d7", F.col("d7")).when(F.col("delta") == "d28", F.col("d28"))
    zscore = F.when(~F.col("format").startswith("~"), F.col("z"))
    formatted = F.coalesce(of("word"), printed(F.ltrim("format", F.lit("~")), F.col("value") / F.col("scale")))
    return met.select("key", "value", formatted.alias("formatted"), zscore.alias("zscore"), delta.alias("delta"), of("colour").alias("colour"), "label", of("direction").alias("direction"))


def one_row(stats: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """One row with a column (series, statistic) each; null where the series is missing."""
    return stats.agg(*(F.max(F.when(F.col("series") == s, F.col(c))).alias(name) for name, (s, c) in columns.items()))


def linear_scores(row: DataFrame, factors: tuple[tuple, ...], bound: float = 3.0, neutral: float = 0.3) -> DataFrame:
    """(factor, score, direction): weighted sums of the row's columns, a missing one counting as 0.

    A factor is (name, direction above, direction below, {column: weight}).
    """

    def total(weights: dict[str, float]) -> Column:
        return sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))

    cells = F.array(*(F.struct(F.lit(name).alias("factor"), F.lit(up).alias("up"), F.lit(down).alias("down"), total(w).alias("raw")) for name, up, down, w in factors))
    out = row.select(F.explode(cells).alias("x")).select("x.*")
    direction = F.when(F.col("raw") > neutral, F.col("up")).when(F.col("raw") < -neutral, F.col("down")).otherwise("Neutral")
    return out.select("factor", clip(F.col("raw"), -bound, bound).alias("score"), direction.alias("direction"))


def weighted(row: DataFrame, parts: dict[str, tuple[Column, float]], empty: float = 50.0) -> DataFrame:
    """Adds ``score``, 0 to 100: the mean of the parts that are not null by their weights."""
    total = sum((F.coalesce(x, F.lit(0.0)) * w for x, w in parts.values()), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts.values()), F.lit(0.0))
    return row.withColumn("score", F.coalesce(clip(F.try_divide(total, weight) * 100, 0, 100), F.lit(empty)))


def curve_label(level: Column) -> Column:
    return F.when(level.isNull(), "Unknown").when(level >= 0.75, "Steep").when(level >= 0, "Flat / Mildly positive").when(level >= -0.25, "Shallow inversion").otherwise("Deep inversion")


def curve_move(spread: Column, long: Column, short: Column, least: float = 0.05) -> Column:
    """Which end of the curve moves it; null where a change is missing."""
    up = F.when((long > 0) & (short < long), "Bear steepener").otherwise("Bull steepener")
    down = F.when(short > 0, "Bear flattener").otherwise("Bull flattener")
    there = spread.isNotNull() & long.isNotNull() & short.isNotNull()
    return F.when(there, F.when(spread > least, up).when(spread < -least, down).otherwise("Stable"))


def volatility_label(level: Column, ratio: Column) -> Column:
    stress = (level > 30) | F.coalesce(ratio > 1, F.lit(False))
    return F.when(level.isNull(), "Unknown").when(stress, "Stress / Panic").when(level > 20, "Elevated concern").when(level > 15, "Neutral").otherwise("Complacency")


def stance_label(real: Column, growth: Column) -> Column:
    """Monetary stance from the real yield and the 13-week growth of assets in percent; unknown growth restricts nothing."""
    shrinking = F.coalesce(growth < 0, F.lit(True))
    easy = (real < 0.5) | F.coalesce(growth > 3, F.lit(False))
    return F.when(real.isNull(), "Unknown").when((real > 1.5) & shrinking, "Restrictive").when(easy, "Accommodative").when((real > 0.8) & shrinking, "Tightening").otherwise("Neutral")


def z_words(z: Column, inverted: bool = False) -> Column:
    x = -z if inverted else z
    return F.when(x > 1, "strongly supportive").when(x > 0.3, "mildly supportive").when(x < -1, "strong drag").when(x < -0.3, "mild drag").otherwise("neutral")


def confirmation(percent: Column, up_is_good: bool | None, least: float = 1.0) -> Column:
    """Whether a return in percent confirms; ``None``: it is only watched."""
    if up_is_good is None:
        return F.when(percent.isNull(), "N/A").otherwise("Watch")
    x = percent if up_is_good else -percent
    return F.when(x.isNull(), "N/A").when(x > least, "Confirming").when(x < -least, "Diverging").otherwise("Neutral")


def copula_penalty(tau: Column, tail: Column, rho: Column) -> tuple[Column, Column]:
    """Whether the recent rank correlation departs from what tau implies, and the factor that a pair's score takes."""
    delta = F.when(tau > 0.05, rho - tau * (tau + 2) / 3).otherwise(0.0)
    flag = (F.abs(delta) > 0.22) & (tau > 0.15)
    band = F.when(tail > 0.45, 0.72).when(tail > 0.35, 0.82).when(tail > 0.25, 0.91).when(tail < 0.10, 1.04).otherwise(1.0)
    base = F.when(tau < 0, 0.88).when(tau > 0.05, band).otherwise(1.0)
    extra = F.when(flag, F.least(F.abs(delta) / 0.22 * 0.10, F.lit(0.15))).otherwise(0.0)
    return flag, clip(base * (1 - extra), 0.60, 1.05)


def alignment(assets: DataFrame, row: DataFrame, safe: tuple[str, ...]) -> DataFrame:
    """Alignment of each asset (series, v, m200) with the one-row state (score, credit_z, real): 15 to 85.

    A rule without a direction is not counted; safe havens take regime, credit and real yields the other way round.
    """
    side = F.when(F.col("series").isin(*safe), -1).otherwise(1)
    s, z, real = F.col("score"), F.col("credit_z"), F.col("real")
    votes = F.array(
        F.when(s > 55, side).when(s < 45, -side),
        F.when(z > 0.5, -side).when(z < -0.5, side),
        F.when(real > 1.5, -side).when(real < 0.5, side),
        F.when(F.col("m200").isNotNull(), F.when(F.col("v") > F.col("m200"), 1).otherwise(-1)),
    )
    out = assets.withColumn("__k", F.lit(1)).join(F.broadcast(row.withColumn("__k", F.lit(1))), "__k")
    out = out.withColumn("votes", F.filter(votes, lambda x: x.isNotNull()))
    pro, con = F.size(F.filter("votes", lambda x: x > 0)), F.size(F.filter("votes", lambda x: x < 0))
    share = F.coalesce(F.try_divide(pro - con, F.size("votes")), F.lit(0.0))
    return out.select("series", clip(50 + share * 35, 15, 85).cast("int").cast("long").alias("score"), pro.cast("long").alias("n_confirm"), con.cast("long").alias("n_against"))


def alignment_label(score: Column) -> Column:
    return F.when(score >= 65, "BULLISH").when(score >= 55, "MILD TAILWIND").when(score >= 45, "NEUTRAL").when(score >= 33, "MILD HEADWIND").otherwise("BEARISH")


def alignment_colour(score: Column) -> Column:
    return F.when(score >= 65, "#16a34a").when(score >= 55, "#22c55e").when(score >= 45, "#6b7280").when(score >= 33, "#d97706").otherwise("#ef4444")


def trades(dist: DataFrame, confluence: DataFrame, degrade: Column) -> DataFrame:
    """Trades of the assets with a view: direction by ``confluence`` (-6 to 6, 0: none), size by history.

    ``dist`` is a row per series of ``points.distribution`` with ``degrade``, the chance of a worse label.
    A hit rate below 0.48 in the trade's direction leaves a tenth.
    """
    c, long = F.col("confluence"), F.col("confluence") > 0
    rate = F.when(long, F.col("win_rate")).otherwise(1 - F.col("win_rate"))
    short = F.when(F.col("payoff") > 0, F.greatest(F.lit(0.0), rate - (1 - rate) / F.col("payoff"))).otherwise(0.0) * 0.25
    kelly = F.when(long, F.col("kelly")).otherwise(short)
    out = dist.join(confluence.where("confluence <> 0"), "series").withColumn("rate", rate).withColumn("size", kelly)
    alpha = F.col("size") * F.abs(c) / 6 * F.when(F.col("rate") >= 0.48, 1.0).otherwise(0.1) * (1 - F.least(degrade * 0.5, F.lit(0.4)))
    return out.select("series", F.when(long, "long").otherwise("short").alias("direction"), "confluence", F.col("rate").alias("win_rate"), F.col("size").alias("kelly"), (F.col("rate") >= 0.48).alias("validated"), alpha.alias("alpha"))
