"""Queries of the models: regimes, distributions, transitions, rotation, with the SQL that gives the same rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import LABELS, clip, momentum
from ..operators import points, rules, windows
from ..sources import tables
from ..sources.once import once
from . import regime
from .base_sql import DAY, FRIDAY, LINE, SER, WEEK, r, with_
from .series_queries import ORACLE, QUERIES, day, query, six

NAMES = [name for name, _ in LABELS]
#: Roles as affine images of series of the test tables: (role, table, series, factor, offset).
ROLES = (
    ("init_claims", "orders", "1-URGENT", 1.0, 0.0),
    ("RSP", "orders", "2-HIGH", 0.001, 0.0),
    ("SPY", "orders", "3-MEDIUM", 0.002, 0.0),
    ("y10", "line", "AF", 0.0001, 0.0),
    ("y2", "line", "AO", 0.0001, 0.0),
    ("y3m", "line", "NF", 0.0001, 0.0),
    ("real10", "line", "NO", 0.00004, 0.0),
    ("cpi", "line", "RF", 0.0005, 250.0),
    ("fed_assets", "line", "RO", 0.1, 0.0),
    ("hy_oas", "orders", "4-NOT SPECIFIED", 0.00002, 0.0),
    ("ig_oas", "orders", "5-LOW", 0.000008, 0.0),
    ("VIX", "line", "AF", 0.0004, 0.0),
    ("VIX3M", "line", "AO", 0.0004, 0.0),
    ("dollar_broad", "line", "NF", 0.002, 0.0),
)


def _digest(which: tuple) -> str:
    return hashlib.sha256(repr(which).encode()).hexdigest()[:12]


def roles(spark: SparkSession, sf_dir: str, which: tuple = ROLES) -> DataFrame:
    """Daily values by role, written once: a plan reads them in a dozen places, and they are days x roles, not facts."""
    return once(spark, sf_dir, f"roles-{_digest(which)}", lambda: daily_roles(spark, sf_dir, which))


def daily_roles(spark: SparkSession, sf_dir: str, which: tuple) -> DataFrame:
    both = tables.orders(spark, sf_dir).withColumn("src", F.lit("orders")).unionByName(tables.lines(spark, sf_dir).withColumn("src", F.lit("line")))
    names = spark.createDataFrame(which, "role string, src string, series string, factor double, offset double")
    return both.join(F.broadcast(names), ["src", "series"]).select(F.col("role").alias("series"), "d", (F.col("v") * F.col("factor") + F.col("offset")).alias("v"))


def role_statistics(spark: SparkSession, sf_dir: str, which: tuple = ROLES) -> DataFrame:
    """Statistics of every role and day, written once: history and snapshot read the same ones."""
    return once(spark, sf_dir, f"statistics-{_digest(which)}", lambda: regime.all_statistics(roles(spark, sf_dir, which)))


def score_history(spark: SparkSession, sf_dir: str, which: tuple = ROLES) -> DataFrame:
    """The regime of every Friday, written once."""
    return once(spark, sf_dir, f"history-{_digest(which)}", lambda: regime.history(roles(spark, sf_dir, which), role_statistics(spark, sf_dir, which)))


def weekly_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of every series with a label by the z-score of the last 52 and the return of the next 4."""
    z = F.col("z")
    rows = points.weekly(tables.orders(spark, sf_dir)).withColumn("z", windows.zscore(F.col("v"), 52, guard=30)).withColumn("fwd", windows.forward_return(F.col("v")))
    label = F.when(z >= 1, NAMES[0]).when(z >= 0.3, NAMES[1]).when(z >= -0.3, NAMES[2]).when(z >= -1, NAMES[3]).when(z.isNotNull(), NAMES[4])
    return rows.withColumn("label", label).where("label is not null")


W52 = "over (partition by series order by d rows between 51 preceding and current row)"
LABELLED = (
    f"zs as (select series, d, v, lead(v, 4) over (partition by series order by d) / v - 1 as fwd, case when count(*) over (partition by series order by d) >= 30 then case when stddev_samp(v) {W52} = 0 then 0 else (v - avg(v) {W52}) / stddev_samp(v) {W52} end end as z from week)",
    "labelled as (select *, case when z >= 1 then 'Risk On' when z >= 0.3 then 'Bullish' when z >= -0.3 then 'Neutral' when z >= -1 then 'Bearish' else 'Risk Off' end as label from zs where z is not null)",
)
STATS = "g as (select series, label, count(*) as n, avg(fwd) as mean, stddev_pop(fwd) as sd, avg(case when fwd > 0 then 1.0 else 0.0 end) as wr, coalesce(avg(case when fwd > 0 then fwd end), 0) as gain, coalesce(abs(avg(case when fwd <= 0 then fwd end)), 1e-6) as loss, " + ", ".join(f"quantile_cont(fwd, {q}) as {n}" for q, n in ((0.05, "p5"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"))) + " from labelled where fwd is not null group by 1, 2 having count(*) >= 8)"


@query(with_(SER, WEEK, *LABELLED, STATS) + "select series, label, n, " + ", ".join(f"{r(c)} as {c}" for c in ("p5", "p25", "p50", "p75", "p95", "mean")) + f", {r('wr')} as win_rate, {r('gain / nullif(loss, 0)', 4)} as payoff, {r('greatest(0, wr - coalesce((1 - wr) / nullif(gain / nullif(loss, 0), 0), 1e12)) * 0.25')} as kelly, {r('mean / nullif(sd, 0) * sqrt(52.0)')} as ratio from g")
def regime_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward returns by series and label."""
    got = points.distribution(weekly_labels(spark, sf_dir), ["series", "label"])
    return got.select("series", "label", "n", *(six(c, c) for c in ("p5", "p25", "p50", "p75", "p95", "mean", "win_rate")), six("payoff", "payoff", 4), six("kelly", "kelly"), six("ratio", "ratio"))


LADDER = "names as (select unnest(['Risk On', 'Bullish', 'Neutral', 'Bearish', 'Risk Off']) as label)"


@query(with_(SER, WEEK, *LABELLED, "nxt as (select series, label as f, lead(label) over (partition by series order by d) as t from labelled)", "c as (select series, f, t, count(*) as n from nxt where t is not null group by 1, 2, 3)", LADDER, "dense as (select s.series, a.label as f, b.label as t from (select distinct series from labelled) s cross join names a cross join names b)", "x as (select dense.series, dense.f, dense.t, coalesce(c.n, 0) as n from dense left join c on c.series = dense.series and c.f = dense.f and c.t = dense.t)") + f"select series, f as \"from\", t as \"to\", cast(n as bigint) as n, {r('coalesce(n / nullif(sum(n) over (partition by series, f), 0), 0)')} as share from x")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = points.markov(weekly_labels(spark, sf_dir), "series", "d", "label", NAMES)
    return got.select("series", "from", "to", F.col("n").cast("long").alias("n"), six("share", "share"))


@query(with_(SER, WEEK, *LABELLED, "ranked as (select *, case label when 'Risk On' then 4 when 'Bullish' then 3 when 'Neutral' then 2 when 'Bearish' then 1 else 0 end as k from labelled)", "nxt as (select series, k, lead(k) over (partition by series order by d) as t from ranked)") + f"select series, {r('avg(case when t = k then 1.0 else 0.0 end)')} as stay, {r('avg(case when t < k then 1.0 else 0.0 end)')} as degrade, {r('avg(case when t > k then 1.0 else 0.0 end)')} as improve from nxt where t is not null group by 1")
def stay_degrade_improve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.element_at(F.create_map(*(F.lit(x) for i, n in enumerate(reversed(NAMES)) for x in (n, i))), F.col("label"))
    rows = weekly_labels(spark, sf_dir).withColumn("k", rank).withColumn("t", F.lead("k").over(windows.by())).where("t is not null")
    share = lambda test: F.avg(test.cast("double"))
    k, t = F.col("k"), F.col("t")
    return rows.groupBy("series").agg(six(share(t == k), "stay"), six(share(t < k), "degrade"), six(share(t > k), "improve"))


#: Pairs on common days, and their weekly changes.
PAIRS = (
    "dp as (select x.series as a, y.series as b, x.d, x.v as x, y.v as y from ser x join ser y on x.d = y.d and x.series < y.series)",
    f"wk as (select a, b, {FRIDAY} as w, arg_max(x, d) as x, arg_max(y, d) as y from dp group by 1, 2, 3)",
    "pr as (select * from (select a, b, w as d, x / lag(x) over (partition by a, b order by w) - 1 as x, y / lag(y) over (partition by a, b order by w) - 1 as y from wk) where x is not null qualify count(*) over (partition by a, b) >= 52)",
)
TAU = "tau as (select p.a, p.b, sum(sign(q.x - p.x) * sign(q.y - p.y)) / sqrt(sum(abs(sign(q.x - p.x))) * sum(abs(sign(q.y - p.y)))) as tau from pr p join pr q on p.a = q.a and p.b = q.b and p.d < q.d group by 1, 2)"
THETA = "case when tau > 0.05 then greatest(2 * tau / (1 - tau), 0.01) else 0 end"
TAIL = f"case when tau > 0.05 then pow(2.0, -1 / ({THETA})) else 0 end"


def weekly_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.pair_returns(points.pairs(tables.orders(spark, sf_dir)))


@query(with_(SER, *PAIRS, TAU) + f"select a, b, {r('tau')} as tau, {r(THETA)} as theta, {r(TAIL)} as tail, {r('case when tau > 0.05 then tau * (tau + 2) / 3 when tau >= 0 then 0 else tau end')} as rho from tau")
def kendall_and_copula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau of weekly changes, the Clayton copula that follows, and the rank correlation to expect."""
    got = points.kendall(weekly_pairs(spark, sf_dir))
    theta, tail = points.clayton(F.col("tau"))
    return got.select("a", "b", six("tau", "tau"), six(theta, "theta"), six(tail, "tail"), six(points.implied_rho(F.col("tau")), "rho"))


SPEAR = (
    "t63 as (select * from pr qualify row_number() over (partition by a, b order by d desc) <= 63)",
    "k63 as (select a, b, rank() over (partition by a, b order by x) + (count(*) over (partition by a, b, x) - 1) / 2.0 as rx, rank() over (partition by a, b order by y) + (count(*) over (partition by a, b, y) - 1) / 2.0 as ry from t63)",
    "rho as (select a, b, corr(rx, ry) as rho, count(*) as n from k63 group by 1, 2)",
)


@query(with_(SER, *PAIRS, *SPEAR) + f"select a, b, {r('rho')} as rho, n from rho")
def spearman_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.spearman(weekly_pairs(spark, sf_dir)).select("a", "b", six("rho", "rho"), "n")


@query(
    with_(
        SER, "cm as (select a.series as a, b.series as b, a.d, a.v as x, b.v as y from ser a join ser b on a.d = b.d and a.series < b.series)",
        "dr as (select a, b, d, x / lag(x) over w - 1 as x, y / lag(y) over w - 1 as y, count(*) over (partition by a, b) as n from cm window w as (partition by a, b order by d))",
        "rn as (select *, row_number() over (partition by a, b order by d desc) as rn from dr)",
    )
    + f"select a, b, {r('case when max(n) >= 73 then corr(x, y) end')} as corr, {r('case when max(n) >= 73 then corr(x, y) filter (where rn <= 63) end')} as recent, count(x) as n from rn group by 1, 2"
)
def pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the changes from one common date to the next, of all and of the last 63, for every pair with a common date; null below 73 of them."""
    own = Window.partitionBy("a", "b")
    both = points.pairs(tables.orders(spark, sf_dir)).withColumn("dates", F.count(F.lit(1)).over(own))
    changes = both.select("a", "b", "d", "dates", *((F.try_divide(c, F.lag(c).over(own.orderBy("d"))) - 1).alias(c) for c in ("x", "y")))
    there = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)
    rows = changes.withColumn("there", there).withColumn("rn", F.count("there").over(own.orderBy(F.desc("d"))))
    enough, late = F.max("dates") >= 73, F.col("rn") <= 63
    recent = F.corr(F.when(late, F.col("x")), F.when(late, F.col("y")))
    return rows.groupBy("a", "b").agg(six(F.when(enough, F.corr("x", "y")), "corr"), six(F.when(enough, recent), "recent"), F.count("there").alias("n"))


#: The copula's factor for a pair: by tau, its tail, and the departure of the recent rank correlation.
PENALTY = (
    f"cp as (select tau.a, tau.b, tau, {TAIL} as tail, rho, case when tau > 0.05 then rho - tau * (tau + 2) / 3 else 0 end as delta from tau join rho on tau.a = rho.a and tau.b = rho.b)",
    "fl as (select *, abs(delta) > 0.22 and tau > 0.15 as flag from cp)",
    "pf as (select *, greatest(0.6, least(1.05, case when tau < 0 then 0.88 when tau > 0.05 then case when tail > 0.45 then 0.72 when tail > 0.35 then 0.82 when tail > 0.25 then 0.91 when tail < 0.1 then 1.04 else 1 end else 1 end * (1 - case when flag then least(abs(delta) / 0.22 * 0.1, 0.15) else 0 end))) as factor from fl)",
)
W252P = "over (partition by a, b order by d rows between 251 preceding and current row)"
OWNP = "over (partition by a, b order by d)"
PAIR_SCORE = (
    f"ra as (select a, b, d, v, v - lag(v, 21) {OWNP} as step, count(*) {OWNP} as n, max(d) over (partition by a, b) as newest from (select a, b, d, x / y as v from dp))",
    f"st as (select *, (v - avg(v) {W252P}) / stddev_samp(v) {W252P} as z, case when n >= 84 then (step - avg(step) {W252P}) / stddev_samp(step) {W252P} end as mz, case when v > avg(v) over (partition by a, b order by d rows between 62 preceding and current row) then 1 else -1 end as up, arg_max(v, d) filter (where d <= newest - 21) over (partition by a, b) as old from ra)",
    "raw as (select a, b, greatest(-100, least(100, (0.35 * greatest(-2.5, least(2.5, coalesce(mz, 0))) + 0.625 * up + 0.25 * greatest(-2.5, least(2.5, -z)) + 0.375 * greatest(-2.5, least(2.5, (v / old - 1) * 100 / 2.5))) / 2.5 * 100)) as raw from st where d = newest and n >= 90)",
    "sc as (select raw.a, raw.b, raw, coalesce(factor, 1) as factor, greatest(-100, least(100, raw * coalesce(factor, 1))) as score from raw left join pf on raw.a = pf.a and raw.b = pf.b)",
)
PAIR_SQL = (SER, *PAIRS, TAU, *SPEAR, *PENALTY, *PAIR_SCORE)


def penalties(weekly: DataFrame) -> DataFrame:
    """(a, b, tau, tail, rho, flag, factor) of pairs with weekly changes."""
    met = points.kendall(weekly).join(points.spearman(weekly).select("a", "b", "rho"), ["a", "b"])
    tail = points.clayton(F.col("tau"))[1]
    flag, factor = rules.copula_penalty(F.col("tau"), tail, F.col("rho"))
    return met.select("a", "b", "tau", tail.alias("tail"), "rho", flag.alias("flag"), factor.alias("factor"))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw and score, from -100 to 100, of each pair with at least 90 common days: momentum, trend, level and monthly return of the ratio, less the copula's penalty."""
    both = points.pairs(tables.orders(spark, sf_dir))
    own = Window.partitionBy("series").orderBy("d")
    rows = both.select(F.concat_ws("|", "a", "b").alias("series"), "a", "b", "d", F.try_divide("x", "y").alias("v")).where("v is not null")
    v = F.col("v")
    rows = rows.withColumn("step", windows.change(v, 21)).withColumn("n", F.count(F.lit(1)).over(own)).withColumn("newest", F.max("d").over(Window.partitionBy("series")))
    month = F.max_by(F.when(F.col("d") <= F.date_sub("newest", 21), v), F.when(F.col("d") <= F.date_sub("newest", 21), F.col("d"))).over(Window.partitionBy("series"))
    momentum_z = F.when(F.col("n") >= 21 + 63, windows.zscore(F.col("step"), 252, guard=2))
    trend = F.when(v > windows.rolling_mean(v, 63), 1.0).otherwise(-1.0)
    rows = rows.select("a", "b", "d", "newest", "n", windows.zscore(v, 252).alias("z"), momentum_z.alias("mz"), trend.alias("trend"), (F.try_divide(v, month) - 1).alias("r1m")).where("d = newest and n >= 90")

    def bounded(x: Column) -> Column:
        return clip(F.coalesce(x, F.lit(0.0)), -2.5, 2.5)

    raw = clip((0.35 * bounded(F.col("mz")) + 0.625 * F.col("trend") + 0.25 * bounded(-F.col("z")) + 0.375 * bounded(F.col("r1m") * 100 / 2.5)) / 2.5 * 100, -100, 100)
    met = rows.select("a", "b", raw.alias("raw")).join(penalties(points.pair_returns(both)).select("a", "b", "tail", "factor"), ["a", "b"], "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    return met.withColumn("score", clip(F.col("raw") * F.col("factor"), -100, 100))


@query(with_(*PAIR_SQL) + f"select a, b, {r('raw', 4)} as raw, {r('factor')} as factor, {r('score', 4)} as score, case when abs(score) >= 65 then 'Strong' when abs(score) >= 45 then 'Moderate' else 'Weak' end as conviction, case when score > 0 then a else b end as leader, row_number() over (order by round(abs(score), 4) desc, a, b) as place from sc")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs, the strongest first (``place``); the number of pairs is that of a fixed list of names."""
    s = F.abs("score")
    place = F.row_number().over(Window.orderBy(F.desc(F.round(s, 4)), "a", "b"))
    return scored_pairs(spark, sf_dir).select(
        "a", "b", six("raw", "raw", 4), six("factor", "factor"), six("score", "score", 4), F.when(s >= 65, "Strong").when(s >= 45, "Moderate").otherwise("Weak").alias("conviction"), F.when(F.col("score") > 0, F.col("a")).otherwise(F.col("b")).alias("leader"), place.alias("place")
    )


@query(with_(SER, *PAIRS, TAU, "nm as (select distinct series as s from ser)", f"tl as (select a, b, {TAIL} as tail from tau)") + f"select x.s as a, y.s as b, case when x.s = y.s then 1.0 else {r('tail')} end as tail from nm x cross join nm y left join tl on tl.a = least(x.s, y.s) and tl.b = greatest(x.s, y.s)")
def tail_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tail dependence of every two names in either order, 1 with itself."""
    rows = tables.orders(spark, sf_dir)
    tails = points.kendall(points.pair_returns(points.pairs(rows))).select("a", "b", points.clayton(F.col("tau"))[1].alias("tail"))
    names = rows.select("series").distinct().agg(F.array_sort(F.collect_set("series")).alias("names"))  # a fixed list
    grid = names.select(F.explode("names").alias("x"), "names").select("x", F.explode("names").alias("y"))
    met = grid.select("x", "y", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).join(tails, ["a", "b"], "left")
    return met.select(F.col("x").alias("a"), F.col("y").alias("b"), F.when(F.col("x") == F.col("y"), 1.0).otherwise(F.round("tail", 6) + 0.0).alias("tail"))


@query(None)
def capped_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by absolute score, no series more than twice, the first series' group once."""
    rows = scored_pairs(spark, sf_dir).withColumn("strength", F.round(F.abs("score"), 4))
    return points.capped(rows, "strength", "a", "b", 9, 2, {"5-LOW": 1}).select("place", "a", "b", "strength")


def role_sql(which: tuple) -> str:
    values = ", ".join(f"('{a}', '{b}', '{c}', cast({d!r} as double), cast({e!r} as double))" for a, b, c, d, e in which)
    return f"role as (select m.role as series, s.d, s.v * m.factor + m.off as v from (select 'orders' as src, * from ser union all select 'line', * from line) s join (values {values}) m(role, src, series, factor, off) on m.src = s.src and m.series = s.series)"


ROLE_SQL = role_sql(ROLES)


def _pair(name: str, a: str, b: str, op: str) -> str:
    return f"select '{name}' as series, a.d, a.v {op} b.v as v from role a join role b on a.d = b.d and a.series = '{a}' and b.series = '{b}'"


ALL_SQL = "every as (select series, d, v from role union all " + " union all ".join(
    [
        _pair("breadth", "RSP", "SPY", "/"), _pair("curve3m", "y10", "y3m", "-"), _pair("curve2", "y10", "y2", "-"), _pair("breakeven", "y10", "real10", "-"),
        _pair("vratio", "VIX", "VIX3M", "/"), _pair("slope", "VIX3M", "VIX", "-"),
        "select 'cpi_yoy', d, v from (select d, (v / lag(v, 12) over (order by d) - 1) * 100 as v from role where series = 'cpi') where v is not null",
        "select 'fed_roc', d, v from (select d, (v / lag(v, 63) over (order by d) - 1) * 100 as v from role where series = 'fed_assets') where v is not null",
    ]
) + ")"
P252 = "over (partition by series order by d rows between 251 preceding and current row)"
STAT_SQL = (
    "s1 as (select *, count(*) over (partition by series order by d) as n, row_number() over (partition by series order by d) as up, v - case when series = 'init_claims' then lag(v, 13) over (partition by series order by d) else lag(v, 63) over (partition by series order by d) end as step from every)",
    "vixp as (select a.series, a.d, avg(case when b.v < a.v then 1.0 else 0.0 end) * 100 as pct from s1 a join s1 b on a.series = 'VIX' and b.series = 'VIX' and b.up between a.up - 251 and a.up group by 1, 2)",
    f"s2 as (select s1.series, s1.d, v, n, case when n >= 30 then (v - avg(v) {P252}) / stddev_samp(v) {P252} end as z, case when n >= case when s1.series = 'init_claims' then 13 + greatest(30, least(n, 252) // 4) else 126 end then (step - avg(step) {P252}) / stddev_samp(step) {P252} end as roc, v - avg(v) over (partition by s1.series order by s1.d rows between 1259 preceding and current row) as gap from s1)".replace("partition by series order by d", "partition by s1.series order by s1.d"),
    "s3 as (select s2.*, pct from s2 left join vixp on vixp.series = s2.series and vixp.d = s2.d)",
    f"fri as (select w as d from (select {FRIDAY} as w, count(*) over () as c from (select distinct d from role where series in ({', '.join(map(repr, regime.MACRO))}) intersect select distinct d from role where series in ({', '.join(map(repr, regime.PRICES))}))) where c >= 60 group by 1)",
    f"asked as (select fri.d, unnest([{', '.join(map(repr, regime.NEEDED))}]) as series from fri)",
    "met as (select asked.d, asked.series, s3.v, s3.n, s3.z, s3.roc, s3.gap, s3.pct from asked asof left join s3 on asked.series = s3.series and asked.d >= s3.d)",
    "wide as (select d, " + ", ".join(f"max(case when series = '{x}' then {c} end) as {x}_{c}" for x in regime.NEEDED for c in ("v", "n", "z", "roc", "gap", "pct")) + " from met group by 1)",
)


def _sig(x: str, sign: float = 1, guard: int | None = 63, stat: str = "z") -> str:
    value = f"case when {x}_n >= {guard} then {x}_{stat} end" if guard else f"{x}_{stat}"
    return f"greatest(-2.5, least(2.5, coalesce({value}, 0))) / 2.5 * {sign}"


def _mean(*terms: tuple[str, str]) -> str:
    mean = "list_avg(list_filter([" + ", ".join(f"case when {c} then cast({t} as double) end" for c, t in terms) + "], lambda x: x is not null))"
    return f"case when {mean} is not null then greatest(-1, least(1, {mean})) end"


PILLAR_SQL = (
    "gold as (select *, case when cpi_n >= 13 then cpi_yoy_v when breakeven_n >= 30 then breakeven_v end as lvl, case when cpi_n >= 13 then 1.5 else 2.0 end as lo from wide)",
    "gl as (select *, case when lvl is null then 0 when lvl between lo and 2.5 then 1 when lvl > 2.5 then greatest(-1, least(1, 1 - 2 * pow(least((lvl - 2.5) / 1.0, 1.5), 1.5))) else greatest(-1, least(1, 1 - 1.5 * pow(least((lo - lvl) / (lo - 0.5), 1.5), 1.2))) end as g from gold)",
    "pil as (select *, " + ", ".join([
        _mean(("init_claims_n >= 60", _sig("init_claims", -1, 30)), ("init_claims_n >= 60 and init_claims_roc is not null", _sig("init_claims", -0.6, None, "roc")), ("breadth_n >= 60", _sig("breadth", 0.8)), ("breadth_n >= 60 and breadth_roc is not null", _sig("breadth", 0.5, None, "roc")), ("curve3m_n >= 30", _sig("curve3m", 0.7))) + " as growth",
        "case when cpi_n >= 13 or breakeven_n >= 30 then greatest(-1, least(1, g * 0.7 + case when breakeven_n >= 30 and breakeven_roc is not null then " + _sig("breakeven", 1, None, "roc") + " * case when coalesce(nullif(lvl, 0), 2) > 2.5 then -0.3 else 0.3 end else 0 end)) end as inflation",
        _mean(("real10_n >= 30", _sig("real10", -1)), ("real10_n >= 252", "greatest(-1, least(1, real10_gap / 1.5)) * -0.5"), ("curve2_n >= 30", _sig("curve2", 0.7)), ("curve2_n >= 30 and curve2_roc is not null", _sig("curve2", 0.4, None, "roc")), ("curve2_n >= 30 and curve2_v < -0.1", "-0.4 * least(abs(curve2_v) / 1.5, 1)"), ("fed_assets_n >= 70", _sig("fed_roc", 0.4))) + " as monetary",
        _mean(("hy_oas_n >= 30", _sig("hy_oas", -1.2)), ("ig_oas_n >= 30", _sig("ig_oas", -0.8)), ("VIX_n >= 60", _sig("VIX", -0.7)), ("VIX_n >= 60 and vratio_v is not null", "greatest(-1, least(0.5, 1 - vratio_v)) * 0.6")) + " as internals",
        _mean(("dollar_broad_n >= 30", _sig("dollar_broad", -1)), ("dollar_broad_n >= 30 and dollar_broad_roc is not null", _sig("dollar_broad", -0.5, None, "roc")), ("fed_assets_n >= 60", _sig("fed_assets", 0.5))) + " as fiscal",
        _mean(("VIX_n >= 60", "case when VIX_pct > 80 then 0.6 when VIX_pct > 65 then 0.2 when VIX_pct < 20 then -0.3 else 0 end"), ("slope_v is not null", "greatest(-0.5, least(0.5, -slope_v / 5)) * 0.5")) + " as sentiment",
    ]) + ", coalesce(hy_oas_v > 500, false) or coalesce(VIX_v > 28, false) as stress from gl)",
)
PART = {p: (f"case when stress then {b} else {a} end" if a != b else repr(a)) for p, (a, b) in regime.WEIGHTS.items()}
TOTAL = " + ".join(f"coalesce({p}, 0) * ({w})" for p, w in PART.items())
WEIGHT = " + ".join(f"case when coalesce({p}, 0) <> 0 then {w} else 0 end" if p in ("growth", "internals") else f"({w})" for p, w in PART.items())
BZ, HZ = "case when breadth_n >= 63 then breadth_z end", "case when hy_oas_n >= 63 then hy_oas_z end"
SCORE_SQL = (
    f"pen as (select *, {BZ} as bz, {HZ} as hz, greatest(0, least(100, (({TOTAL}) / ({WEIGHT}) + 1) * 50)) as base from pil)",
    "raw as (select *, greatest(0, least(100, base + 100 * case when bz > 0.3 and hz > 0.5 then least(bz, 2) * least(hz, 2) / 4 * -0.12 when bz < -0.3 and hz < -0.5 then 0.03 else 0 end)) as score_raw from pen)",
    "sc as (select *, cast(round_even(score_raw, 0) as bigint) as score from raw)",
)
#: The regime at the newest dates and 21 days earlier; d is 'now' or 'before'.
_CUT = (
    f"cut as (select k as d, m - n as macro, p - n as price from (select max(d) filter (where series in ({', '.join(map(repr, regime.MACRO))})) as m, max(d) filter (where series in ({', '.join(map(repr, regime.PRICES))})) as p from role) cross join (values ('now', 0), ('before', 21)) x(k, n))",
    f"ask0 as (select d, macro, price, unnest([{', '.join(map(repr, regime.NEEDED))}]) as series from cut)",
    f"asked as (select d, series, case when series in ({', '.join(map(repr, regime.PRICED))}) then price else macro end as day from ask0)",
    "met as (select asked.d, asked.series, s3.v, s3.n, s3.z, s3.roc, s3.gap, s3.pct from asked asof left join s3 on asked.series = s3.series and asked.day >= s3.d)",
)
HISTORY_SQL = (SER, LINE, ROLE_SQL, ALL_SQL, *STAT_SQL, *PILLAR_SQL, *SCORE_SQL)
SNAPSHOT_SQL = (ALL_SQL, *STAT_SQL[:4], *_CUT, STAT_SQL[-1], *PILLAR_SQL, *SCORE_SQL)
LABEL_SQL = "case when score >= 75 then 'Risk On' when score >= 60 then 'Bullish' when score >= 40 then 'Neutral' when score >= 25 then 'Bearish' else 'Risk Off' end"


@query(with_(*HISTORY_SQL) + f"select {DAY}, " + ", ".join(f"{r(p)} as {p}" for p in regime.WEIGHTS) + f", {r('score_raw', 4)} as score_raw, score, {LABEL_SQL} as label from sc")
def regime_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = score_history(spark, sf_dir)
    return got.select(day(), *(six(p, p) for p in regime.WEIGHTS), six("score_raw", "score_raw", 4), "score", "label")


@query(with_(*HISTORY_SQL, "h as (select x.d, x.score, y.score as was from sc x asof left join sc y on x.d - 21 >= y.d)") + f"select {DAY}, score, cast(score - was as bigint) as delta, case when score - was >= 6 then 'Improving' when score - was <= -6 then 'Deteriorating' else 'Stable' end as momentum, case when score >= 75 then null when score >= 60 then 75 when score >= 40 then 60 when score >= 25 then 40 else 25 end - score + 1 as up, score - case when score >= 75 then 75 when score >= 60 then 60 when score >= 40 then 40 when score >= 25 then 25 end + 1 as down from h")
def regime_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change over 21 days and the points to the next label either way; one row a week, so one ordered task."""
    score = F.col("score")
    rows = score_history(spark, sf_dir).select("d", "score").withColumn("one", F.lit(1)).withColumn("day", F.datediff("d", F.lit("1970-01-01")))
    was = F.last("score").over(Window.partitionBy("one").orderBy("day").rangeBetween(Window.unboundedPreceding, -21))
    above = F.when(score >= 75, None).when(score >= 60, 75).when(score >= 40, 60).when(score >= 25, 40).otherwise(25)
    below = F.when(score >= 75, 75).when(score >= 60, 60).when(score >= 40, 40).when(score >= 25, 25)
    return rows.withColumn("delta", score - was).select(day(), "score", "delta", momentum(F.col("delta")).alias("momentum"), (above - score + 1).alias("up"), (score - below + 1).alias("down"))


__all__ = ["ORACLE", "QUERIES"]
