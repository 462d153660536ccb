"""Queries of the rule tables: signals, factors, curve, volatility, stance, labour, alignment, trades, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..operators import joins, points, rules, windows
from .base_sql import DAY, LINE, SER, r, with_
from .model_queries import PAIRS, PENALTY, ROLES, SPEAR, TAU, penalties, role_sql, roles, weekly_pairs
from .series_queries import ORACLE, QUERIES, day, query, six

#: Further roles as affine images of series of the test tables.
MORE = (
    *ROLES,
    ("cont_claims", "orders", "2-HIGH", 10.0, 0.0),
    ("fed_funds", "line", "RF", 0.0001, 0.0),
    ("nfci", "line", "RO", 0.00001, -0.4),
    ("umich", "line", "RO", 0.002, 0.0),
    ("y5", "line", "AO", 0.00011, 0.0),
    ("real5", "line", "NO", 0.00003, 0.0),
    ("MOVE", "line", "RF", 0.003, 0.0),
    ("IWM", "orders", "4-NOT SPECIFIED", 0.002, 0.0),
    ("GLD", "orders", "5-LOW", 0.001, 0.0),
    ("TLT", "orders", "1-URGENT", 0.0008, 0.0),
    ("HYG", "orders", "2-HIGH", 0.0007, 0.0),
    ("UUP", "line", "NF", 0.0005, 0.0),
)
SPREADS = (
    ("curve2", "y10", "-", "y2"),
    ("curve3m", "y10", "-", "y3m"),
    ("be10", "y10", "-", "real10"),
    ("be5", "y5", "-", "real5"),
    ("vratio", "VIX", "/", "VIX3M"),
    ("small", "IWM", "/", "SPY"),
)
# Colours and thresholds of the signals.
RED, GREEN, GREY, AMBER = "#ef4444", "#22c55e", "#94a3b8", "#f59e0b"
WIDE = [(">", 0.5, -1, RED, None), ("<", -0.5, 1, GREEN, None)]
BREAKEVEN = [(">", 2.5, 0, AMBER, None), ("<", 2.0, 0, GREEN, None)]
# (key, label, series, statistic, format (~: no z-score shown), scale, change, steps, last step)
SIGNALS: list[tuple] = [
    ("hy_oas", "HY OAS", "hy_oas", "z", "%.2f%%", 1.0, "d7", WIDE, (0, GREY, None)),
    ("ig_oas", "IG OAS", "ig_oas", "z", "%.2f%%", 1.0, None, WIDE, (0, GREY, None)),
    ("real_yield_10y", "Real yield 10y", "real10", "v", "%.2f%%", 1.0, None, [(">", 1.5, -1, RED, None), ("<", 0.5, 1, GREEN, None)], (0, AMBER, None)),
    ("curve_2s10s", "Curve 2s10s", "curve2", "v", "~%+.2fpp", 1.0, "d7", [(">", 0.5, 1, GREEN, None), ("<", 0.0, -1, RED, None)], (0, AMBER, None)),
    ("curve_3m10", "Curve 3m10y", "curve3m", "v", "~%+.2fpp", 1.0, None, [(">", 0.5, 1, GREEN, None), (">", 0.0, 1, AMBER, None), ("<", 0.0, -1, RED, None)], (-1, AMBER, None)),
    ("breakeven_10y", "Breakeven 10y", "be10", "v", "~%.2f%%", 1.0, None, BREAKEVEN, (0, GREY, None)),
    ("breakeven_5y", "Breakeven 5y", "be5", "v", "~%.2f%%", 1.0, None, BREAKEVEN, (0, GREY, None)),
    ("init_claims", "Initial claims", "init_claims", "v", "%.0fk", 1e3, "d28", [(">", 270000.0, -1, RED, None), (">", 225000.0, 0, AMBER, None), ("<", 225000.0, 1, GREEN, None)], (0, GREEN, None)),
    ("cont_claims", "Continuing claims", "cont_claims", "v", "%.2fM", 1e6, None, [(">", 2000000.0, -1, RED, None), ("<", 1700000.0, 1, GREEN, None)], (0, AMBER, None)),
    ("fed_funds", "Fed funds", "fed_funds", "v", "~%.2f%%", 1.0, None, [(">", 5.0, -1, RED, None), (">", 3.0, 0, AMBER, None)], (0, GREEN, None)),
    ("dollar", "Dollar (broad)", "dollar_broad", "z", "%.1f", 1.0, None, WIDE, (0, GREY, None)),
    ("nfci", "NFCI", "nfci", "v", "~%.2f", 1.0, None, [(">", 0.0, -1, RED, None)], (1, GREEN, None)),
    ("umich", "Consumer sentiment", "umich", "z", "%.1f", 1.0, None, [(">", 0.3, 1, GREEN, None), ("<", -0.5, -1, RED, None)], (0, GREY, None)),
    ("vix", "VIX", "VIX", "v", "~%.1f", 1.0, None, [(">", 25.0, -1, RED, None), ("<", 15.0, 1, GREEN, None)], (0, GREY, None)),
    ("vratio", "V-Ratio", "vratio", "v", "~%.3f", 1.0, None, [(">", 1.0, -1, RED, None)], (1, GREEN, None)),
    ("move", "MOVE", "MOVE", "v", "~%.1f", 1.0, None, [(">", 120.0, -1, RED, None), (">", 100.0, 0, AMBER, None)], (0, GREEN, None)),
    ("breadth_rsp_spy", "RSP/SPY breadth", "breadth", "z", "%.2f", 1.0, None, [(">", 0.3, 1, GREEN, "IMPROVING"), ("<", -0.3, -1, RED, "FADING")], (0, GREY, "NEUTRAL")),
    ("hy_pct_rank", "HY pct rank", "hy_oas", "pct", "~%.0fth pct", 1.0, None, [(">", 80.0, -1, RED, None), ("<", 20.0, 1, GREEN, None)], (0, GREY, None)),
]

def every(spark: SparkSession, sf_dir: str, which: tuple = MORE) -> DataFrame:
    """Roles, their spreads, and the breadth of RSP over the last SPY so far."""
    rows = roles(spark, sf_dir, which)
    left, right = (rows.where(F.col("series") == x).select(F.lit("breadth").alias("series"), "d", F.col("v").alias(n)) for x, n in (("RSP", "a"), ("SPY", "b")))
    breadth = joins.asof(left, right, "series", "d", ["b"]).select("series", "d", F.try_divide("a", "b").alias("v")).where("v is not null")
    return rows.unionByName(rules.spreads(rows, SPREADS)).unionByName(breadth)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.current(every(spark, sf_dir))


EVERY = (
    SER, LINE, role_sql(MORE),
    "every as (select series, d, v from role union all "
    + " union all ".join(f"select '{n}', a.d, a.v {op} b.v from role a join role b on a.d = b.d and a.series = '{x}' and b.series = '{y}'" for n, x, op, y in SPREADS)
    + " union all select 'breadth', a.d, a.v / b.v from (select * from role where series = 'RSP') a asof join (select * from role where series = 'SPY') b on a.d >= b.d)",
)
STAT = (
    "num as (select *, v / lag(v, 21) over (partition by series order by d) - 1 as pc, row_number() over (partition by series order by d desc) as rn, max(d) over (partition by series) as newest, first_value(v) over (partition by series order by d desc) as last from every)",
    "cur as (select series, max(last) as v, round(case when count(*) >= 30 then (max(last) - avg(v) filter (where rn <= 252)) / stddev_samp(v) filter (where rn <= 252) end, 3) as z, round(case when count(*) >= 252 then avg(case when v < last then 1.0 else 0.0 end) filter (where rn <= 252) * 100 end, 1) as pct, "
    + ", ".join(f"max(last) - arg_max(v, d) filter (where d <= newest - {k}) as d{k}" for k in (7, 28, 30))
    + ", "
    + ", ".join(f"max(last) / max(v) filter (where rn = {k + 1}) - 1 as r{k}" for k in (21, 63))
    + ", case when count(*) >= 100 then avg(v) filter (where rn <= 200) end as m200, case when count(*) >= 30 then (max(last) - avg(v) filter (where rn <= 252)) / stddev_samp(v) filter (where rn <= 252) end as zr"
    + ", case when count(pc) >= 30 then (max(pc) filter (where rn = 1) - avg(pc) filter (where rn <= 252)) / stddev_samp(pc) filter (where rn <= 252) end as rz, max(last) / max(v) filter (where rn = 6) - 1 as r5, case when count(*) >= 63 then avg(v) filter (where rn <= 63) end as a63, "
    + ", ".join(f"max(last) / arg_max(v, d) filter (where d <= newest - {k}) - 1 as c{k}" for k in (7, 10, 21, 63))
    + " from num group by 1)",
)


def _ladder(x: str, steps: list[tuple], last: object, part: int) -> str:
    def lit(value: object) -> str:
        return "null" if value is None else repr(value)

    return "case " + " ".join(f"when {x} {s[0]} {s[1]!r} then {lit(s[part])}" for s in steps) + f" else {lit(last)} end"


def _signal(rule: tuple) -> str:
    key, label, series, stat, fmt, scale, delta, steps, last = rule
    x, value = f"coalesce({stat}, 0)", "z" if key.startswith("breadth") else "pct" if stat == "pct" else "v"
    text = f"printf('{fmt.lstrip('~')}', {value} / {scale!r})"
    word = _ladder(x, steps, last[2], 4) if last[2] else text
    return (
        f"select '{key}' as key, {r(value, 4)} as value, {word} as formatted, {'cast(null as double)' if fmt.startswith('~') else 'z'} as zscore, "
        f"{r(delta, 4) if delta else 'cast(null as double)'} as delta, {_ladder(x, steps, last[1], 3)} as colour, '{label}' as label, cast({_ladder(x, steps, last[0], 2)} as bigint) as direction from cur where series = '{series}' and {value} is not null"
    )


@query(with_(*EVERY, *STAT) + " union all ".join(map(_signal, SIGNALS)))
def signal_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rules.signals(stats(spark, sf_dir), SIGNALS)
    return got.select("key", six("value", "value", 4), "formatted", six("zscore", "zscore", 3), six("delta", "delta", 4), "colour", "label", F.col("direction").cast("long").alias("direction"))


def _of(series: str, stat: str) -> str:
    return f"max({stat}) filter (where series = '{series}')"


@query(
    with_(*EVERY, "c as (select a.d, a.v as v, b.v as y10, e.v as y2 from every a join every b on a.d = b.d and a.series = 'curve2' and b.series = 'y10' join every e on a.d = e.d and e.series = 'y2')", "m as (select *, v - lag(v, 21) over (order by d) as dv, y10 - lag(y10, 21) over (order by d) as d10, y2 - lag(y2, 21) over (order by d) as d2 from c)")
    + f"select {DAY}, {r('v', 9)} as v, case when v >= 0.75 then 'Steep' when v >= 0 then 'Flat / Mildly positive' when v >= -0.25 then 'Shallow inversion' else 'Deep inversion' end as state, case when dv > 0.05 then case when d10 > 0 and d2 < d10 then 'Bear steepener' else 'Bull steepener' end when dv < -0.05 then case when d2 > 0 then 'Bear flattener' else 'Bull flattener' end when dv is not null then 'Stable' end as move from m"
)
def curve_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the curve and its move over 21 rows, for every date; one row a day, so one ordered task."""
    rows = roles(spark, sf_dir, MORE)
    both = joins.named(rows, "y10", "y10").join(joins.named(rows, "y2", "y2"), "d").withColumn("series", F.lit("curve2")).withColumn("v", F.col("y10") - F.col("y2"))
    move = rules.curve_move(*(windows.change(F.col(c), 21) for c in ("v", "y10", "y2")))
    return both.select(day(), six("v", "v", 9), rules.curve_label(F.col("v")).alias("state"), move.alias("move"))


@query(
    with_(*EVERY)
    + f"select cast(a.d as varchar) as d, {r('a.v', 4)} as vix, {r('b.v')} as ratio, case when a.v > 30 or coalesce(b.v > 1, false) then 'Stress / Panic' when a.v > 20 then 'Elevated concern' when a.v > 15 then 'Neutral' else 'Complacency' end as state from (select * from every where series = 'VIX') a left join (select * from every where series = 'vratio') b on a.d = b.d"
)
def volatility_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles(spark, sf_dir, MORE)
    both = joins.named(rows, "VIX", "vix").join(joins.named(rows, "VIX3M", "far"), "d", "left").withColumn("ratio", F.try_divide("vix", "far"))
    return both.select(day(), six("vix", "vix", 4), six("ratio", "ratio"), rules.volatility_label(F.col("vix"), F.col("ratio")).alias("state"))


@query(
    with_(SER, LINE, role_sql(MORE), "g as (select d, (v / lag(v, 63) over (order by d) - 1) * 100 as g from role where series = 'fed_assets')", "a as (select d, v from role where series = 'real10')")
    + f"select cast(a.d as varchar) as d, {r('a.v')} as real, {r('g.g')} as growth, case when a.v > 1.5 and (g is null or g < 0) then 'Restrictive' when a.v < 0.5 or coalesce(g > 3, false) then 'Accommodative' when a.v > 0.8 and (g is null or g < 0) then 'Tightening' else 'Neutral' end as stance from a asof left join g on a.d >= g.d"
)
def fed_stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stance at every date of the real yield, with the growth of assets as last known."""
    rows = roles(spark, sf_dir, MORE)
    left = joins.named(rows, "real10", "real").withColumn("series", F.lit("s"))
    right = rows.where("series = 'fed_assets'").withColumn("growth", windows.pct_change(F.col("v"), 63) * 100).select(F.lit("s").alias("series"), "d", F.struct("growth").alias("g"))
    met = joins.asof(left, right, "series", "d", ["g"]).withColumn("growth", F.col("g.growth"))
    return met.select(day(), six("real", "real"), six("growth", "growth"), rules.stance_label(F.col("real"), F.col("growth")).alias("stance"))


@query(
    with_(*EVERY, *STAT, f"x as (select {_of('init_claims', 'v')} as v, {_of('init_claims', 'z')} as z, {_of('init_claims', 'd28')} as d28, (select round(avg(case when v < last then 1.0 else 0.0 end) * 100, 1) from num where series = 'cont_claims' and rn <= 252) as pct from cur)", "p as (select unnest([greatest(0, least(1, (z + 2.5) / 5)), greatest(0, least(1, 0.5 + d28 / greatest(v, 1) * 25)), pct / 100, greatest(0, least(1, (v - 180000) / 170000))]) as s, unnest([0.40, 0.25, 0.20, 0.15]) as w from x)")
    + f"select {r('sum(s * w) / sum(w) * 100', 4)} as score from p where s is not null"
)
def labour_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = rules.one_row(stats(spark, sf_dir), v=("init_claims", "v"), z=("init_claims", "z"), d28=("init_claims", "d28"))
    # Among as many rows as there are, 252 at most.
    rank = points.tail_rank(every(spark, sf_dir).where("series = 'cont_claims'"), 252, least=1)
    row = row.join(F.broadcast(rank.agg(F.max(F.round("pct", 1)).alias("pct"))))  # one row each
    v = F.col("v")
    parts = {
        "level of claims among a year": (clip((F.col("z") + 2.5) / 5, 0, 1), 0.40),
        "change over four weeks": (clip(0.5 + F.col("d28") / F.greatest(v, F.lit(1.0)) * 25, 0, 1), 0.25),
        "rank of continuing claims": (F.col("pct") / 100, 0.20),
        "level of claims": (clip((v - 180_000) / 170_000, 0, 1), 0.15),
    }
    return rules.weighted(row, parts).select(six("score", "score", 4))


@query(with_(SER, *PAIRS, TAU, *SPEAR, *PENALTY) + f"select a, b, {r('tau')} as tau, flag, {r('factor')} as factor from pf")
def copula_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return penalties(weekly_pairs(spark, sf_dir)).select("a", "b", six("tau", "tau"), "flag", six("factor", "factor"))


WATCHED = (("HYG", True), ("TLT", None), ("UUP", False), ("GLD", None))


@query(
    with_(*EVERY, *STAT, "p as (" + " union all ".join(f"select '{t}' as name, r21 * 100 as pct, {0 if up is None else 1 if up else -1} as good from cur where series = '{t}'" for t, up in WATCHED) + " union all select 'IWM vs SPY', (a.r21 - b.r21) * 100, 1 from cur a, cur b where a.series = 'IWM' and b.series = 'SPY')")
    + f"select name, {r('pct', 4)} as pct, case when pct is null then 'N/A' when good = 0 then 'Watch' when pct * good > 1 then 'Confirming' when pct * good < -1 then 'Diverging' else 'Neutral' end as status from p"
)
def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = rules.one_row(stats(spark, sf_dir), iwm=("IWM", "r21"), spy=("SPY", "r21"), **{t: (t, "r21") for t, _ in WATCHED})
    cells = [(t, F.col(t) * 100, up) for t, up in WATCHED] + [("IWM vs SPY", (F.col("iwm") - F.col("spy")) * 100, True)]
    out = row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), x.alias("pct"), rules.confirmation(x, up).alias("status")) for n, x, up in cells))).alias("x")).select("x.*")
    return out.select("name", six("pct", "pct", 4), "status")


@query(with_(*EVERY, *STAT) + f"select series, {r('z', 3)} as z, case when z > 1 then 'strongly supportive' when z > 0.3 then 'mildly supportive' when z < -1 then 'strong drag' when z < -0.3 then 'mild drag' else 'neutral' end as words, case when -z > 1 then 'strongly supportive' when -z > 0.3 then 'mildly supportive' when -z < -1 then 'strong drag' when -z < -0.3 then 'mild drag' else 'neutral' end as inverted from cur")
def driver_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("z")
    return stats(spark, sf_dir).select("series", six("z", "z", 3), rules.z_words(z).alias("words"), rules.z_words(z, inverted=True).alias("inverted"))


__all__ = ["ORACLE", "QUERIES"]
