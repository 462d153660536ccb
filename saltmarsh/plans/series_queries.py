"""Queries of the series operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import joins, points, windows
from ..sources import tables
from .base_sql import DAY, LINE, NEWEST, SER, WEEK, r, with_

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def day() -> Column:
    return F.col("d").cast("string").alias("d")




def query(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def six(x: Column | str, name: str, digits: int = 6) -> Column:
    return rounded(F.col(x) if isinstance(x, str) else x, digits).alias(name)


@query(with_(SER) + f"select series, {DAY}, {r('v', 4)} as v from ser")
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.orders(spark, sf_dir).select("series", day(), six("v", "v", 4))


@query(with_(SER, WEEK) + f"select series, {DAY}, {r('v', 4)} as v from week")
def weekly_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.weekly(tables.orders(spark, sf_dir)).select("series", day(), six("v", "v", 4))


@query(with_(SER, NEWEST) + f"select series, count(*) as n, {r('arg_max(v, d)', 4)} as last, case when count(*) >= 63 then {r('(arg_max(v, d) - avg(v)) / stddev_samp(v)')} end as z from newest where rn <= 252 group by 1")
def tail_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.tail_zscore(tables.orders(spark, sf_dir)).select("series", "n", six("last", "last", 4), six("z", "z"))


@query(with_(SER, NEWEST) + f"select series, case when count(*) >= 30 then {r('(arg_max(v, d) - avg(v)) / stddev_samp(v)', 3)} end as z from newest where rn <= 63 group by 1")
def tail_zscore_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.tail_zscore(tables.orders(spark, sf_dir), 63, guard=30).select("series", six("z", "z", 3))


@query(with_(SER, NEWEST) + f"select a.series, case when count(*) >= 252 then {r('avg(case when a.v < b.v then 1.0 else 0.0 end) * 100')} end as pct from newest a join newest b on a.series = b.series and b.rn = 1 where a.rn <= 252 group by 1")
def percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.tail_rank(tables.orders(spark, sf_dir)).select("series", six("pct", "pct"))


@query(with_(SER) + f"select series, {r('arg_min(v, d)', 4)} as first, {r('arg_max(v, d)', 4)} as last, {r('arg_max(v, d) - arg_min(v, d)', 4)} as change, {r('arg_max(v, d) / arg_min(v, d) * 100 - 100')} as change_pct, {r('min(v)', 4)} as low, {r('max(v)', 4)} as high, count(*) as n, cast(max(d) as varchar) as newest from ser group by 1")
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points.summary(tables.orders(spark, sf_dir))
    return rows.select("series", *(six(c, c, 4) for c in ("first", "last", "change")), six("change_pct", "change_pct"), six("low", "low", 4), six("high", "high", 4), "n", F.col("newest").cast("string").alias("newest"))


OWN = "over (partition by series order by d)"


@query(with_(SER) + "select series, " + DAY + ", " + ", ".join(f"{r(f'v / lag(v, {n}) {OWN} - 1')} as pct{n}" for n in (1, 4, 12, 21, 63, 126)) + f", {r(f'v - lag(v, 63) {OWN}', 4)} as diff63 from ser")
def row_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.orders(spark, sf_dir)
    return rows.select("series", day(), *(six(windows.pct_change(F.col("v"), n), f"pct{n}") for n in (1, 4, 12, 21, 63, 126)), six(windows.change(F.col("v"), 63), "diff63", 4))


@query(with_(SER, WEEK) + f"select series, {DAY}, {r(f'lead(v, 4) {OWN} / v - 1')} as fwd from week qualify lead(v, 4) {OWN} is not null")
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points.weekly(tables.orders(spark, sf_dir)).withColumn("fwd", windows.forward_return(F.col("v")))
    return rows.where("fwd is not null").select("series", day(), six("fwd", "fwd"))


def frame(n: int, agg: str, least: int | None = None) -> str:
    w = f"over (partition by series order by d rows between {n - 1} preceding and current row)"
    return f"case when count(v) {w} >= {least or n} then {agg}(v) {w} end"


MEANS = ((4, 1), (50, 20), (63, 63), (200, 100), (252, 60))


@query(with_(SER) + f"select series, {DAY}, " + ", ".join(f"{r(f'v / ({frame(n, "avg", least)}) - 1')} as m{n}" for n, least in MEANS) + " from ser")
def rolling_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every value from its moving averages."""
    return tables.orders(spark, sf_dir).select("series", day(), *(six(F.try_divide(F.col("v"), windows.rolling_mean(F.col("v"), n, least)) - 1, f"m{n}") for n, least in MEANS))


@query(with_(SER, f"ret as (select series, d, v / lag(v) {OWN} - 1 as v from ser)") + f"select series, {DAY}, {r(frame(21, 'stddev_samp') + ' * sqrt(252.0) * 100', 4)} as vol from ret where v is not null")
def realised_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.orders(spark, sf_dir).withColumn("v", windows.pct_change(F.col("v"), 1)).where("v is not null")
    return rows.select("series", day(), six(windows.rolling_std(F.col("v"), 21) * 252**0.5 * 100, "vol", 4))


W252 = "over (partition by series order by d rows between 251 preceding and current row)"


@query(with_(SER) + f"select series, {DAY}, {r(f'case when count(v) {W252} >= 60 then (v - avg(v) {W252}) / nullif(stddev_samp(v) {W252}, 0) end')} as z from ser")
def rolling_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.orders(spark, sf_dir).select("series", day(), six(windows.zscore(F.col("v"), 252, guard=60), "z"))


@query(with_(SER, NEWEST) + f"select a.series, cast(a.d as varchar) as d, case when count(b.v) >= 62 then {r('avg(case when b.v < a.v then 1.0 when b.v is not null then 0.0 end)')} end as pct from newest a left join newest b on a.series = b.series and b.up between a.up - 251 and a.up - 1 group by 1, 2")
def rolling_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.orders(spark, sf_dir).select("series", day(), six(windows.rank_before(F.col("v")), "pct"))


@query(with_(SER) + f"select series, {DAY}, {r('(v / max(v) over (partition by series order by d) - 1) * 100')} as drawdown, {r('v / first_value(v) over (partition by series order by d) * 100')} as rebased from ser")
def drawdown_and_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.orders(spark, sf_dir).select("series", day(), six(windows.drawdown(F.col("v")), "drawdown"), six(windows.rebased(F.col("v")), "rebased"))


@query(with_(SER, "days as (select distinct d from ser)", "names as (select distinct series from ser)") + f"select names.series, cast(days.d as varchar) as d, {r('last_value(v ignore nulls) over (partition by names.series order by days.d rows between unbounded preceding and current row)', 4)} as v from days cross join names left join ser on ser.d = days.d and ser.series = names.series")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.filled(tables.orders(spark, sf_dir)).select("series", day(), six("v", "v", 4))


@query(with_(SER, WEEK) + f"select series, {DAY}, {r('(rank() over (partition by series order by v) + (count(*) over (partition by series, v) - 1) / 2.0) / (count(*) over (partition by series) + 1.0)')} as u from week")
def uniform_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.weekly(tables.orders(spark, sf_dir)).select("series", day(), six(windows.uniform_rank(F.col("v")), "u"))


@query(with_(SER, f"t as (select *, case when v > lag(v, 63) {OWN} then 1 when lag(v, 63) {OWN} is not null then 0 end as up from ser)", f"p as (select *, lag(up) {OWN} as was, row_number() over (partition by series order by d desc) as rn from t)") + "select series, cast(up as bigint) as up, case when up > was then 'up' when up < was then 'down' end as flip from p where rn = 1")
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.orders(spark, sf_dir).withColumn("up", windows.trend_up(F.col("v"))).withColumn("was", F.lag("up").over(windows.by()))
    flip = F.when(F.col("up") > F.col("was"), "up").when(F.col("up") < F.col("was"), "down")
    return rows.withColumn("rn", windows.newest_first()).where("rn = 1").select("series", F.col("up").cast("long").alias("up"), flip.alias("flip"))


@query(with_(SER, f"df as (select series, d, v - lag(v, 63) {OWN} as v from ser)", "p as (select *, row_number() over (partition by series order by d desc) as rn from df where v is not null)") + f"select series, case when count(*) >= 63 then {r('(arg_max(v, d) - avg(v)) / stddev_samp(v)')} end as roc_z from p where rn <= 252 group by 1")
def change_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.orders(spark, sf_dir).withColumn("v", windows.change(F.col("v"), 63)).where("v is not null")
    return points.tail_zscore(rows).select("series", six("z", "roc_z"))


@query(with_(SER, NEWEST, "a as (select series, d - 30 as d, v as last from newest where rn = 1)") + f"select a.series, {r('a.last', 4)} as last, {r('ser.v', 4)} as before, {r('a.last - ser.v', 4)} as delta, {r('a.last / ser.v - 1')} as ret from a asof left join ser on a.series = ser.series and a.d >= ser.d")
def calendar_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points.back(tables.orders(spark, sf_dir), 30)
    return rows.select("series", *(six(c, c, 4) for c in ("last", "before", "delta")), six("ret", "ret"))


@query(with_(SER, NEWEST, f"f as (select series, d, up, v > lag(v) {OWN} as hi from newest)", f"g as (select *, case when hi is distinct from lag(hi) {OWN} or up = 1 then 1 else 0 end as new from f)", f"h as (select *, sum(new) {OWN} as run from g)") + "select series, hi as rising, cast(min(d) as varchar) as first, cast(max(d) as varchar) as last, count(*) as n from h group by series, run, hi")
def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.orders(spark, sf_dir).withColumn("rising", F.col("v") > F.lag(F.col("v")).over(windows.by()))
    out = windows.runs(rows, "series", "d", "rising")
    return out.select("series", "rising", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "n")


@query(
    with_(SER, "q0 as (select a.series, a.d, a.v / b.v as v, count(*) over (partition by a.series) as n from ser a join ser b on a.d = b.d and b.series = '3-MEDIUM' where a.series <> '3-MEDIUM')", "m as (select series, d, " + frame(50, "avg", 20) + " as v from q0 where n >= 60)", f"q as (select series, d, v, v / ({frame(252, 'avg', 50)}) * 100 as ratio, v / lag(v, 20) {OWN} * 100 as momentum, row_number() over (partition by series order by d desc) as rn from m where v is not null)")
    + f"select series, {r('ratio', 4)} as ratio, {r('momentum', 4)} as momentum, case when ratio >= 100 and momentum >= 100 then 'Leading' when ratio >= 100 then 'Weakening' when momentum >= 100 then 'Improving' else 'Lagging' end as quadrant from q where rn = 1"
)
def rotation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength against the benchmark: the smoothed ratio over its own mean, and over itself 20 rows ago."""
    rows = tables.orders(spark, sf_dir)
    base = joins.named(rows, "3-MEDIUM", "base")
    ratio = rows.where("series <> '3-MEDIUM'").join(base, "d").select("series", "d", F.try_divide("v", "base").alias("v")).where("v is not null")
    ratio = ratio.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("series"))).where("n >= 60")
    smooth = ratio.withColumn("v", windows.rolling_mean(F.col("v"), 50, 20)).where("v is not null")
    smooth = smooth.withColumn("ratio", F.col("v") / windows.rolling_mean(F.col("v"), 252, 50) * 100).withColumn("momentum", F.try_divide("v", F.lag("v", 20).over(windows.by())) * 100)
    quadrant = F.when((F.col("ratio") >= 100) & (F.col("momentum") >= 100), "Leading").when(F.col("ratio") >= 100, "Weakening").when(F.col("momentum") >= 100, "Improving").otherwise("Lagging")
    return smooth.withColumn("rn", windows.newest_first()).where("rn = 1").select("series", six("ratio", "ratio", 4), six("momentum", "momentum", 4), quadrant.alias("quadrant"))


@query(with_(SER, LINE, "base as (select d, v from line where series = 'AF')") + f"select ser.series, cast(ser.d as varchar) as d, {r('ser.v', 4)} as v, {r('base.v')} as base from ser asof left join base on ser.d >= base.d")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = tables.orders(spark, sf_dir)
    names = left.select("series").distinct().agg(F.collect_list("series").alias("names"))
    right = tables.lines(spark, sf_dir).where("series = 'AF'").join(F.broadcast(names)).select(F.explode("names").alias("series"), "d", F.col("v").alias("base"))
    return joins.asof(left, right, "series", "d", ["base"]).select("series", day(), six("v", "v", 4), six("base", "base"))


@query(with_(LINE, "a as (select * from line where series = 'AF')", "b as (select * from line where series = 'NO')") + f"select cast(a.d as varchar) as d, {r('a.v - b.v')} as spread, {r('a.v / nullif(b.v, 0)')} as ratio, {r('(10 * a.v - 5 * b.v) / 5')} as fwd from a join b on a.d = b.d")
def spread_and_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.lines(spark, sf_dir)
    both = joins.named(rows, "AF", "a").join(joins.named(rows, "NO", "b"), "d")
    a, b = F.col("a"), F.col("b")
    return both.select(day(), six(a - b, "spread"), six(F.try_divide(a, b), "ratio"), six((10 * a - 5 * b) / 5, "fwd"))


@query(with_(SER) + "select cast(a.d as varchar) as d, " + r("a.v - b.v - c.v", 4) + " as net from ser a join ser b on a.d = b.d and b.series = '2-HIGH' join ser c on a.d = c.d and c.series = '5-LOW' where a.series = '1-URGENT'")
def net_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.net_of(tables.orders(spark, sf_dir), "1-URGENT", ["2-HIGH", "5-LOW"]).select(day(), six("v", "net", 4))


@query(with_(SER, "bo as (select a.series, a.d, a.v, b.v as base from ser a join ser b on a.d = b.d and b.series = '1-URGENT' where a.series <> '1-URGENT')", "x as (select series, d, row_number() over (partition by series order by d desc) as rn, " + ", ".join(f"v / lag(v, {n}) {OWN} - base / lag(base, {n}) {OWN} as e{n}" for n in (5, 21, 63, 126)) + " from bo)") + "select series, " + ", ".join(f"{r(f'e{n}')} as e{n}" for n in (5, 21, 63, 126)) + " from x where rn = 1")
def relative_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.orders(spark, sf_dir)
    both = rows.where("series <> '1-URGENT'").join(joins.named(rows, "1-URGENT", "base"), "d")
    for n in (5, 21, 63, 126):
        both = both.withColumn(f"e{n}", windows.pct_change(F.col("v"), n) - windows.pct_change(F.col("base"), n))
    return both.withColumn("rn", windows.newest_first()).where("rn = 1").select("series", *(six(f"e{n}", f"e{n}") for n in (5, 21, 63, 126)))


@query(with_(SER) + f"select ser.series, cast(ser.d as varchar) as d, {r('v', 4)} as v from ser where d >= (select max(d) from ser) - 110")
def calendar_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.since(tables.orders(spark, sf_dir), 110).select("series", day(), six("v", "v", 4))


@query(with_(SER, NEWEST) + f"select series, {DAY}, {r('v', 4)} as v from newest where rn <= 63")
def row_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.tail(tables.orders(spark, sf_dir), 63).select("series", day(), six("v", "v", 4))


@query(with_(SER, LINE) + f"select series, {DAY}, {r('v', 4)} as v from ser where d in (select d from line where series = 'NF' and v > 60000) and d not in (select d from ser where series = '5-LOW' and v > 400000)")
def semi_and_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.orders(spark, sf_dir)
    inside = tables.lines(spark, sf_dir).where("series = 'NF' and v > 60000").select("d")
    outside = rows.where("series = '5-LOW' and v > 400000").select("d")
    return rows.join(inside, "d", "left_semi").join(outside, "d", "left_anti").select("series", day(), six("v", "v", 4))


@query(with_(SER, "fresh as (select series, d, v * 2 as v from ser where d >= date '1999-01-01')") + f"select series, {DAY}, {r('v', 4)} as v from fresh union all select series, {DAY}, {r('v', 4)} as v from ser where not exists (select 1 from fresh where fresh.series = ser.series and fresh.d = ser.d)")
def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.orders(spark, sf_dir)
    fresh = rows.where("d >= date'1999-01-01'").withColumn("v", F.col("v") * 2)
    return tables.upsert(rows, fresh).select("series", day(), six("v", "v", 4))


@query(with_(SER) + f"select series, year(d) as year, month(d) as month, {r('avg(v) / 1000', 4)} as mean from ser group by 1, 2, 3")
def year_month_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.orders(spark, sf_dir).groupBy("series", F.year("d").cast("long").alias("year"), F.month("d").cast("long").alias("month"))
    return rows.agg(six(F.avg("v") / 1000, "mean", 4))


@query(with_(SER, f"ret as (select series, d, v / lag(v) {OWN} - 1 as v from ser)", "p as (select *, row_number() over (partition by series order by d desc) as rn from ret where v is not null)") + f"select series, {r('stddev_samp(case when rn <= 63 then v end)')} as recent, {r('stddev_samp(case when rn between 64 and 126 then v end)')} as prior from p group by 1")
def volatility_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.orders(spark, sf_dir).withColumn("v", windows.pct_change(F.col("v"), 1)).where("v is not null").withColumn("rn", windows.newest_first())
    recent, prior = F.when(F.col("rn") <= 63, F.col("v")), F.when(F.col("rn").between(64, 126), F.col("v"))
    return rows.groupBy("series").agg(six(F.stddev_samp(recent), "recent"), six(F.stddev_samp(prior), "prior"))


@query(with_(SER, NEWEST) + f"select series, {r('regr_slope(v, up)', 4)} as slope, {r('avg(v)', 4)} as mean, {r('quantile_cont(v, 0.25)')} as p25, {r('quantile_cont(v, 0.75)')} as p75 from newest where rn <= 24 group by 1")
def slope_and_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points.tail(tables.orders(spark, sf_dir), 24).withColumn("x", -F.col("rn").cast("double"))
    return rows.groupBy("series").agg(six(F.regr_slope("v", "x"), "slope", 4), six(F.avg("v"), "mean", 4), six(F.percentile("v", F.lit(0.25)), "p25"), six(F.percentile("v", F.lit(0.75)), "p75"))


@query("select event_type as series, cast(date_trunc('hour', ts) as varchar) as hour, round(avg(value), 6) + 0.0 as mean, count(*) as n from events group by 1, 2")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss")
    return tables.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), hour.alias("hour")).agg(six(F.avg("value"), "mean"), F.count(F.lit(1)).alias("n"))



