"""Named chart series, their ranges and points, and the tables of the curve, volatility, macro and rotation pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins, rules, windows
from ..sources import tables
from .base_sql import DAY, LINE, SER, r, with_
from .model_queries import role_sql, roles
from .series_queries import day, query, six
from .state_queries import ALL, BASE, ORACLE, QUERIES, current_all

# Rows of a range, and names of series that other pages use.
RANGES = {"1m": 21, "3m": 63, "6m": 126, "1y": 252, "2y": 504, "5y": 1260}
PLAIN = ("hy_oas", "ig_oas", "real10", "real5", "y10", "y2", "y5", "y30", "fed_assets", "init_claims", "cont_claims", "fed_funds", "nfci", "umich", "rrp", "tga", "cpi_yoy")
#: Charts over the roles of one date; null where a leg is missing.
CHARTS = {
    **{x: x for x in PLAIN}, "dollar": "dollar_broad", "spy": "SPY", "gld": "GLD", "curve_2s10s": "y10 - y2", "curve_3m10": "y10 - y3m", "fwd_5y5y_real": "(10 * real10 - 5 * real5) / 5", "fwd_5y5y_inflation": "(10 * (y10 - real10) - 5 * (y5 - real5)) / 5",
    "breakeven": "y10 - real10", "breakeven_10y": "y10 - real10", "breakeven_5y": "y5 - real5", "hy_ig_diff": "hy_oas - ig_oas", "copper_gold": "CPER / nullif(GLD, 0)", "rsp_spy": "RSP / nullif(SPY, 0)", "vratio": "VIX / nullif(VIX3M, 0)", "real_fed_funds": "fed_funds - cpi_yoy",
    "vix": "VIX", "vix3m": "VIX3M", "move": "MOVE", "oil": "USO", "copper": "CPER", "gold": "GLD", "tlt": "TLT", "hyg": "HYG", "btc": "BTC", "qqq_spy": "QQQ / nullif(SPY, 0)", "gold_silver": "GLD / nullif(SLV, 0)", "tlt_spy": "TLT / nullif(SPY, 0)",
    "fwd_nominal": "2 * y10 - y5", "fwd_real": "2 * real10 - real5", "fwd_implied": "2 * y10 - y5 - (2 * real10 - real5)", "oil_gold": "USO / nullif(GLD, 0)",
}
#: Charts that are known and have no data.
EMPTY = ("equity_risk_premium",)
REBASED = {"spy_normalized": "SPY", "gld_normalized": "GLD", "oil_normalized": "USO"}
_NAMES = sorted({role for role, *_ in ALL} | {"cpi_yoy"})


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, d, v) of all charts."""
    rows = roles(spark, sf_dir, ALL)
    yearly = rows.where("series = 'cpi'").select(F.lit("cpi_yoy").alias("series"), "d", (windows.pct_change(F.col("v"), 12) * 100).alias("v")).where("v is not null")
    wide = rows.unionByName(yearly).groupBy("d").agg(*(F.max(F.when(F.col("series") == x, F.col("v"))).alias(x) for x in _NAMES))
    cells = F.array(*(F.struct(F.lit(n).alias("series"), F.expr(x).alias("v")) for n, x in CHARTS.items()))
    out = wide.select("d", F.explode(cells).alias("x")).select("x.series", "d", "x.v").where("v is not null")
    out = out.unionByName(joins.net_of(rows, "fed_assets", ["rrp", "tga"]).select(F.lit("net_liquidity").alias("series"), "d", "v"))
    for name, role in REBASED.items():
        out = out.unionByName(rows.where(F.col("series") == role).select(F.lit(name).alias("series"), "d", windows.rebased(F.col("v")).alias("v")))
    return out.unionByName(rows.where("series = 'SPY'").select(F.lit("spy_drawdown").alias("series"), "d", windows.drawdown(F.col("v")).alias("v")))


CHART_SQL = (
    SER, LINE, role_sql(ALL),
    "more as (select * from role union all select 'cpi_yoy', d, v from (select d, (v / lag(v, 12) over (order by d) - 1) * 100 as v from role where series = 'cpi') where v is not null)",
    "wd as (select d, " + ", ".join(f"max(v) filter (where series = '{x}') as {x}" for x in _NAMES) + " from more group by 1)",
    "ch as (select * from (" + " union all ".join(f"select '{n}' as series, d, {x} as v from wd" for n, x in CHARTS.items()) + ") where v is not null union all select 'net_liquidity', d, fed_assets - rrp - tga from wd where fed_assets - rrp - tga is not null "
    + " ".join(f"union all select '{n}', d, v / first_value(v) over (order by d) * 100 from role where series = '{x}'" for n, x in REBASED.items())
    + " union all select 'spy_drawdown', d, (v / max(v) over (order by d) - 1) * 100 from role where series = 'SPY')",
)


def known() -> list[str]:
    """Names of all charts, in order."""
    return sorted({*CHARTS, *REBASED, *EMPTY, "net_liquidity", "spy_drawdown"})


def chart(spark: SparkSession, sf_dir: str, name: str, range_: str = "1y") -> DataFrame:
    """(series, value): the points of a chart as JSON, its last rows by ``range_`` (a year's, if that is no range); no rows for a known chart without data, KeyError for an unknown one."""
    if name not in known():
        raise KeyError(f"unknown series {name!r}; there are {', '.join(known())}")
    rows = charts(spark, sf_dir).where(F.col("series") == name).withColumn("rn", windows.newest_first()).where(F.col("rn") <= RANGES.get(range_, 252))
    return tables.points(rows)


@query(
    with_(*CHART_SQL, "t as (select *, row_number() over (partition by series order by d desc) as rn from ch)")
    + f"select series, count(*) as n, {r('round(arg_max(v, d), 5)', 5)} as last, {r('arg_max(v, d) - arg_min(v, d)', 4)} as change, {r('min(v)', 5)} as low, {r('max(v)', 5)} as high from t where rn <= 252 group by 1"
)
def chart_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year of every chart: rows, last value, change, least and greatest."""
    rows = charts(spark, sf_dir).withColumn("rn", windows.newest_first()).where("rn <= 252")
    last, first = F.max_by("v", "d"), F.min_by("v", "d")
    return rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"), six(last, "last", 5), six(last - first, "change", 4), six(F.min("v"), "low", 5), six(F.max("v"), "high", 5))


@query(
    with_(*CHART_SQL, "p as (select * from ch where series in ('spy', 'gld', 'tlt') qualify row_number() over (partition by series order by d desc) <= 126)")
    + f"select series, {r('arg_max(v, d)', 4)} as last, {r('(arg_max(v, d) / arg_min(v, d) - 1) * 100', 3)} as change_pct from p group by 1"
)
def price_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a year of prices: last and change in percent."""
    rows = charts(spark, sf_dir).where("series in ('spy', 'gld', 'tlt')").withColumn("rn", windows.newest_first()).where(F.col("rn") <= RANGES["6m"])
    return rows.groupBy("series").agg(six(F.max_by("v", "d"), "last", 4), six((F.max_by("v", "d") / F.min_by("v", "d") - 1) * 100, "change_pct", 3))


@query(
    with_(*CHART_SQL, "c as (select d, v, row_number() over (order by d desc) as rn, v - lag(v, 63) over (order by d) as roc from ch where series = 'curve_2s10s')")
    + f"select {DAY}, {r('v', 9)} as v, {r('roc', 9)} as roc, case when roc >= 0 then 'steepening' else 'flattening' end as direction from c where rn <= 189 and roc is not null"
)
def curve_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the curve over 63 rows, for what a year has of them."""
    rows = charts(spark, sf_dir).where("series = 'curve_2s10s'").withColumn("roc", windows.change(F.col("v"), 63)).withColumn("rn", windows.newest_first()).where("rn <= 189 and roc is not null")
    return rows.select(day(), six("v", "v", 9), six("roc", "roc", 9), F.when(F.col("roc") >= 0, "steepening").otherwise("flattening").alias("direction"))


@query(
    with_(*CHART_SQL, "a as (select d, v from ch where series = 'y10' order by d desc limit 252)", "b as (select d, v from ch where series = 'real10' order by d desc limit 252)", "c as (select d, v from ch where series = 'breakeven' order by d desc limit 252)")
    + f"select cast(a.d as varchar) as d, {r('a.v', 9)} as nominal, {r('b.v', 9)} as real, {r('c.v', 9)} as breakeven from a asof left join b on a.d >= b.d asof left join c on a.d >= c.d"
)
def curve_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year of the nominal yield with the real one and the breakeven as last known."""
    rows = charts(spark, sf_dir).where("series in ('y10', 'real10', 'breakeven')").withColumn("rn", windows.newest_first()).where("rn <= 252")
    out = joins.named(rows, "y10", "nominal").withColumn("series", F.lit("x"))
    for name, column in (("real10", "real"), ("breakeven", "breakeven")):
        right = rows.where(F.col("series") == name).select(F.lit("x").alias("series"), "d", F.col("v").alias(column))
        out = joins.asof(out, right, "series", "d", [column])
    return out.select(day(), *(six(c, c, 9) for c in ("nominal", "real", "breakeven")))


@query(
    with_(*CHART_SQL, "o as (select a.d, a.v as curve, b.v as credit, c.v as vix from ch a join ch b on a.d = b.d and a.series = 'curve_2s10s' and b.series = 'hy_oas' left join ch c on a.d = c.d and c.series = 'vix')", "p as (select *, count(*) over () as n from o)")
    + f"select {DAY}, {r('curve', 9)} as curve, {r('credit', 9)} as credit, {r('vix', 9)} as vix from p where n > 10"
)
def credit_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curve, credit spread and volatility on the dates that curve and credit share, where those are more than ten."""
    rows = charts(spark, sf_dir).where("series in ('curve_2s10s', 'hy_oas', 'vix')")
    wide = rows.groupBy("d").agg(*(F.max(F.when(F.col("series") == x, F.col("v"))).alias(n) for x, n in (("curve_2s10s", "curve"), ("hy_oas", "credit"), ("vix", "vix")))).where("curve is not null and credit is not null")
    n = wide.agg(F.count(F.lit(1)).alias("n"))
    return wide.join(F.broadcast(n)).where("n > 10").select(day(), six("curve", "curve", 9), six("credit", "credit", 9), six("vix", "vix", 9))


MEANS = (("init_claims", 4), ("dollar", 63), ("oil_gold", 63), ("copper_gold", 63), ("gold_silver", 63))


@query(
    with_(*CHART_SQL, "m as (select series, d, v, case series " + " ".join(f"when '{s}' then case when count(*) over w >= {k} then avg(v) over (partition by series order by d rows between {k - 1} preceding and current row) end" for s, k in MEANS) + " end as mean from ch where series in (" + ", ".join(f"'{s}'" for s, _ in MEANS) + ") window w as (partition by series order by d))")
    + f"select series, {DAY}, {r('v', 9)} as v, {r('mean', 9)} as mean, v > mean as above from m"
)
def charts_with_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with their mean of four, dollar and ratios with that of 63, and whether they are above it."""
    rows = charts(spark, sf_dir).where(F.col("series").isin(*(s for s, _ in MEANS)))
    mean = F.coalesce(*(F.when(F.col("series") == s, windows.rolling_mean(F.col("v"), k)) for s, k in MEANS))
    return rows.withColumn("mean", mean).select("series", day(), six("v", "v", 9), six("mean", "mean", 9), (F.col("v") > F.col("mean")).alias("above"))


@query(
    with_(*CHART_SQL, "s as (select d, (v / lag(v, 21) over (order by d) - 1) * 100 as ret from ch where series = 'spy')")
    + f"select cast(s.d as varchar) as d, {r('s.ret')} as ret, {r('h.v', 9)} as credit from s join ch h on s.d = h.d and h.series = 'hy_oas' where ret is not null"
)
def credit_against_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The credit spread beside the 21-row return of shares, on common dates."""
    rows = charts(spark, sf_dir)
    shares = rows.where("series = 'spy'").select("d", (windows.pct_change(F.col("v"), 21) * 100).alias("ret")).where("ret is not null")
    return shares.join(joins.named(rows, "hy_oas", "credit"), "d").select(day(), six("ret", "ret"), six("credit", "credit", 9))


CROSS = (("TLT", False), ("XLF", True), ("IWM", True), ("HYG", True), ("SPY", True))
MARKET = ("SPY", "QQQ", "IWM", "XLE", "XLF", "GLD", "HYG", "TLT")


@query(
    with_(*BASE, "x as (" + " union all ".join(f"select series, c21 * 100 as m1, c63 * 100 as m3, {1 if up else -1} as side from cur where series = '{t}'" for t, up in CROSS) + ")")
    + f"select series, {r('m1', 4)} as m1, {r('m3', 4)} as m3, case when m1 is null then 'N/A' when m1 * side > 1 then 'Confirming' when m1 * side < -1 then 'Diverging' else 'Neutral' end as status from x"
)
def curve_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of a month and a quarter of what should move with the curve."""
    stats = current_all(spark, sf_dir).where(F.col("series").isin(*(t for t, _ in CROSS)))
    m1 = F.col("c21") * 100
    status = F.coalesce(*(F.when(F.col("series") == t, rules.confirmation(m1, up)) for t, up in CROSS))
    return stats.select("series", six(m1, "m1", 4), six(F.col("c63") * 100, "m3", 4), status.alias("status"))


@query(
    with_(*BASE, "x as (select series, round(r5 * 100, 2) as r5, round(c7 * 100, 2) as week from cur where series in (" + ", ".join(f"'{t}'" for t in MARKET) + "))")
    + "select series, r5 + 0.0 as r5, week + 0.0 as week, row_number() over (order by week desc, series) as place from x"
)
def market_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of five rows and of a week in percent, the best week first; a fixed list of names."""
    stats = current_all(spark, sf_dir).where(F.col("series").isin(*MARKET)).select("series", six(F.col("r5") * 100, "r5", 2), six(F.col("c7") * 100, "week", 2))
    return stats.withColumn("place", F.row_number().over(Window.orderBy(F.desc("week"), "series")))


@query(
    with_(*BASE, "b as (select c7, c21, c63 from cur where series = 'SPY')", "x as (select series, round(cur.c7 - b.c7, 6) as w, round(cur.c21 - b.c21, 6) as m, round(cur.c63 - b.c63, 6) as q from cur cross join b where series in (" + ", ".join(f"'{t}'" for t in MARKET if t != "SPY") + "))")
    + "select series, w + 0.0 as w, m + 0.0 as m, q + 0.0 as q, case when row_number() over (order by m desc, series) <= 3 then 'leader' when row_number() over (order by m, series) <= 3 then 'laggard' else '' end as side, row_number() over (order by m desc, series) as place from x"
)
def strength_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns over those of the index by calendar days, the best month first, with three leaders and three laggards."""
    stats = current_all(spark, sf_dir).where(F.col("series").isin(*MARKET))
    base = stats.where("series = 'SPY'").select(F.col("c7").alias("b7"), F.col("c21").alias("b21"), F.col("c63").alias("b63"))
    rows = stats.where("series <> 'SPY'").join(F.broadcast(base)).select("series", *(six(F.col(f"c{k}") - F.col(f"b{k}"), n) for n, k in (("w", 7), ("m", 21), ("q", 63))))
    best, worst = (F.row_number().over(Window.orderBy(o, "series")) for o in (F.desc("m"), F.asc("m")))
    rows = rows.withColumn("place", best).withColumn("last", worst)
    return rows.select("series", "w", "m", "q", F.when(F.col("place") <= 3, "leader").when(F.col("last") <= 3, "laggard").otherwise("").alias("side"), "place")


OWN = "over (partition by series order by d)"


@query(
    with_(*CHART_SQL, f"x as (select series, d, v, lag(v) {OWN} as was from ch where series in ('curve_2s10s', 'curve_3m10', 'nfci'))")
    + f"select series, {DAY}, {r('v', 9)} as v, case when v >= 0 then 'up' else 'down' end as crossed from x where (v < 0 and was >= 0) or (v >= 0 and was < 0)"
)
def sign_crosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates on which a series passes zero."""
    rows = charts(spark, sf_dir).where("series in ('curve_2s10s', 'curve_3m10', 'nfci')").withColumn("was", F.lag("v").over(windows.by()))
    return rows.where("(v < 0 and was >= 0) or (v >= 0 and was < 0)").select("series", day(), six("v", "v", 9), F.when(F.col("v") >= 0, "up").otherwise("down").alias("crossed"))


@query(
    with_(*CHART_SQL, "x as (select *, max(d) over () as newest from ch)")
    + f"select series, cast(max(d) as varchar) as last, cast(max(newest) - max(d) as bigint) as days, {r('min(v) - greatest((max(v) - min(v)) * 0.12, 0.1)')} as low, {r('max(v) + greatest((max(v) - min(v)) * 0.12, 0.1)')} as high from x group by 1"
)
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last date of every chart, how many days it is behind the newest, and the padded range of its axis."""
    rows = charts(spark, sf_dir)
    newest = rows.agg(F.max("d").alias("newest"))
    pad = F.greatest((F.max("v") - F.min("v")) * 0.12, F.lit(0.1))
    got = rows.join(F.broadcast(newest)).groupBy("series").agg(F.max("d").alias("d"), F.datediff(F.max("newest"), F.max("d")).cast("long").alias("days"), six(F.min("v") - pad, "low"), six(F.max("v") + pad, "high"))
    return got.select("series", F.col("d").cast("string").alias("last"), "days", "low", "high")


__all__ = ["ORACLE", "QUERIES", "chart", "charts", "known"]
