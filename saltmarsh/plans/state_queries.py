"""Queries of the market's state: the current regime, what follows from it, and rule tables over one row of statistics.

A rule is a CASE expression over the columns of the state, the same text for Spark and for the SQL beside it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import momentum
from ..operators import points, rules, windows
from ..sources.once import once
from . import regime
from .base_sql import LINE, SER, r, with_
from .model_queries import HISTORY_SQL, LABEL_SQL, NAMES, SNAPSHOT_SQL, role_statistics, score_history
from .rule_queries import MORE, ORACLE, QUERIES, SPREADS, STAT, every, role_sql, roles
from .series_queries import query, six

#: Further roles as affine images of series of the test tables.
ASSETS = (
    ("QQQ", "orders", "1-URGENT", 0.0031, 0.0), ("SLV", "orders", "5-LOW", 0.0002, 0.0), ("BTC", "orders", "2-HIGH", 0.3, 0.0), ("XLF", "line", "RF", 0.001, 0.0), ("XLE", "line", "AF", 0.002, 0.0),
    ("XLU", "line", "NO", 0.0018, 0.0), ("XLP", "line", "AO", 0.002, 0.0), ("XLV", "orders", "3-MEDIUM", 0.0009, 0.0), ("XLI", "orders", "4-NOT SPECIFIED", 0.0007, 0.0), ("XLK", "line", "RO", 0.003, 0.0),
    ("XLC", "orders", "3-MEDIUM", 0.0005, 0.0), ("CPER", "line", "RF", 0.0006, 0.0), ("USO", "line", "NF", 0.002, 0.0), ("rrp", "line", "AO", 0.02, 0.0), ("tga", "line", "AF", 0.015, 0.0), ("y30", "line", "AF", 0.00012, 0.2),
)
ALL = (*MORE, *ASSETS)
RATIOS = (*SPREADS, ("qqq_spy", "QQQ", "/", "SPY"), ("btc_gld", "BTC", "/", "GLD"), ("slv_gld", "SLV", "/", "GLD"))

#: Every series with its statistics, in SQL.
BASE = (
    SER, LINE, role_sql(ALL),
    "every as (select series, d, v from role union all "
    + " union all ".join(f"select '{n}', a.d, a.v {op} b.v from role a join role b on a.d = b.d and a.series = '{x}' and b.series = '{y}'" for n, x, op, y in RATIOS)
    + " union all select 'breadth', a.d, a.v / b.v from (select * from role where series = 'RSP') a asof join (select * from role where series = 'SPY') b on a.d >= b.d"
    + " union all select 'cpi_yoy', d, (v / lag(v, 12) over (order by d) - 1) * 100 from role where series = 'cpi' qualify lag(v, 12) over (order by d) is not null"
    + " union all select 'forward', a.d, 2 * a.v - b.v - (2 * c.v - e.v) from role a join role b on a.d = b.d and a.series = 'y10' and b.series = 'y5' join role c on a.d = c.d and c.series = 'real10' join role e on a.d = e.d and e.series = 'real5')",
    *STAT,
)
REGIME = tuple(x.replace("every", "reg") for x in SNAPSHOT_SQL)


def all_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles with their spreads and ratios, breadth, the yearly price change and the inflation forward."""
    rows = roles(spark, sf_dir, ALL)
    extra = rules.spreads(rows, RATIOS[len(SPREADS) :])
    yearly = rows.where("series = 'cpi'").select(F.lit("cpi_yoy").alias("series"), "d", (windows.pct_change(F.col("v"), 12) * 100).alias("v")).where("v is not null")
    legs = {x: F.max(F.when(F.col("series") == x, F.col("v"))).alias(x) for x in ("y10", "y5", "real10", "real5")}
    forward = rows.where(F.col("series").isin(*legs)).groupBy("d").agg(*legs.values()).selectExpr("'forward' as series", "d", "2 * y10 - y5 - (2 * real10 - real5) as v").where("v is not null")
    return every(spark, sf_dir, ALL).unionByName(extra).unionByName(yearly).unionByName(forward)


#: The state: a column per (series, statistic).
STATE = {
    "curve": ("curve2", "v"), "curve_z": ("curve2", "zr"), "curve_month": ("curve2", "d30"), "curve_week": ("curve2", "d7"), "c3m": ("curve3m", "v"), "real": ("real10", "v"), "real_z": ("real10", "zr"), "real_week": ("real10", "d7"),
    "y10_month": ("y10", "d30"), "y2_month": ("y2", "d30"), "credit": ("hy_oas", "v"), "credit_z": ("hy_oas", "zr"), "credit_week": ("hy_oas", "d7"), "dollar_z": ("dollar_broad", "zr"), "dollar_week": ("dollar_broad", "c10"),
    "vix": ("VIX", "v"), "vix_z": ("VIX", "zr"), "vix_pct": ("VIX", "pct"), "vratio": ("vratio", "v"), "vix3m": ("VIX3M", "v"), "fed_z": ("fed_assets", "zr"), "fed_growth": ("fed_assets", "r63"), "small_z": ("small", "zr"), "small_week": ("small", "c7"),
    "gld_z": ("GLD", "zr"), "iwm_z": ("IWM", "zr"), "hyg_quarter": ("HYG", "c63"), "rsp_quarter": ("RSP", "c63"), "spy_quarter": ("SPY", "c63"), "cpi_yoy": ("cpi_yoy", "v"), "be": ("be10", "v"), "fwd": ("forward", "v"), "fwd_week": ("forward", "d7"),
    "fed_funds": ("fed_funds", "v"), "spy": ("SPY", "v"), "spy_200": ("SPY", "m200"), "qqq_spy_z": ("qqq_spy", "zr"), "btc_gld_z": ("btc_gld", "zr"), "slv_gld_z": ("slv_gld", "zr"), "cpi_z": ("cpi_yoy", "zr"), "be_z": ("be10", "zr"),
}
STATE_SQL = "st as (select " + ", ".join(f"max({c}) filter (where series = '{s}') as {n}" for n, (s, c) in STATE.items()) + ", (select score from sc where d = 'now') as score, (select score from sc where d = 'before') as score_before from cur)"
STATE_BASE = (*BASE, *REGIME, STATE_SQL)


def current_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest statistics of all series, written once."""
    return once(spark, sf_dir, "current", lambda: rules.current(all_series(spark, sf_dir)))


def snapshot_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regime 'now' and 'before', written once."""
    return once(spark, sf_dir, "snapshot", lambda: regime.snapshot(roles(spark, sf_dir, ALL), role_statistics(spark, sf_dir, ALL)))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the state, with the score now and 21 days before."""
    row = rules.one_row(current_all(spark, sf_dir), **STATE)
    scores = snapshot_all(spark, sf_dir).agg(F.max(F.when(F.col("d") == "now", F.col("score"))).alias("score"), F.max(F.when(F.col("d") == "before", F.col("score"))).alias("score_before"))
    return row.join(F.broadcast(scores))  # one row by one row


def table_of(row: DataFrame, cells: list[tuple[str, ...]], names: tuple[str, ...]) -> DataFrame:
    """A row for each of ``cells``: expressions over the columns of the one-row ``row``."""
    items = F.array(*(F.struct(*(F.expr(x).alias(n) for x, n in zip(cell, names, strict=True))) for cell in cells))
    return row.select(F.explode(items).alias("x")).select("x.*")


def union_of(source: str, cells: list[tuple[str, ...]], names: tuple[str, ...]) -> str:
    return " union all ".join("select " + ", ".join(f"{x} as {n}" for x, n in zip(cell, names, strict=True)) + f" from {source}" for cell in cells)


# ---- the regime

READ_SQL = (
    "rd as (select *, case when hy_oas_n >= 30 then hy_oas_v end as credit_level, case when hy_oas_n >= 63 then hy_oas_z end as credit_z, case when curve2_n >= 30 then curve2_v end as curve_level, case when curve2_n >= 63 then curve2_z end as curve_z, "
    "case when dollar_broad_n >= 30 then dollar_broad_v end as dollar_level, case when dollar_broad_n >= 63 then dollar_broad_z end as dollar_z, case when breadth_n >= 63 then breadth_z end as breadth_now, case when real10_n >= 30 then real10_v end as real_level, case when real10_n >= 63 then real10_z end as real_z, "
    "coalesce(case when init_claims_n >= 60 then init_claims_v end, case when curve3m_n >= 30 then curve3m_v end) as growth_level, coalesce(case when init_claims_n >= 60 then init_claims_z end, case when breadth_n >= 63 then breadth_z end) as growth_z, lvl as inflation_level, "
    "case when cpi_n >= 13 then case when cpi_yoy_n >= 63 then cpi_yoy_z end when breakeven_n >= 63 then breakeven_z end as inflation_z, case when VIX_n >= 60 then VIX_v end as sentiment_level, case when VIX_n >= 63 then VIX_z end as sentiment_z, "
    "case when bz > 0.3 and hz > 0.5 then least(bz, 2) * least(hz, 2) / 4 * -0.12 when bz < -0.3 and hz < -0.5 then 0.03 else 0 end as penalty, " + " + ".join(f"case when {p} is null then 1 else 0 end" for p in regime.WEIGHTS) + " as missing from sc)",
)
GROUPS = (
    ("score >= 65", "Cyclicals; High Beta"), ("score >= 55 and curve_z > 0.3", "Financials (steep curve)"), ("real_z < -0.3", "Growth / Long Duration; Gold"), ("real_z > 0.5", "Value / Short Duration"),
    ("credit_z < -0.5", "High Yield Credit"), ("score <= 40", "Defensives; Quality"), ("score <= 30", "Gold / Safe Havens; Long Bonds"), ("growth_z > 0.5", "Industrials / Cyclicals"),
)


def _phrase(x: str, low: float, high: float, words: tuple[str, str, str]) -> str:
    return f"case when {x} < {low} then '{words[0]}' when {x} > {high} then '{words[1]}' when {x} is not null then '{words[2]}' end"


_MIX = ", ".join(f"case when score >= 70 then {m[0][1][i]} when score >= 55 then {m[1][1][i]} when score >= 45 then {m[2][1][i]} when score >= 30 then {m[3][1][i]} else {m[4][1][i]} end as mix_{n}" for m in (regime.MIX,) for i, n in enumerate(("equities", "credit", "duration", "cash")))
_COLOUR = "case when {0} >= 75 then '#1f7a4f' when {0} >= 60 then '#16a34a' when {0} >= 40 then '#6b7280' when {0} >= 25 then '#d97706' else '#b42318' end"


@query(
    with_(SER, LINE, role_sql(ALL), *REGIME, *READ_SQL)
    + f"select a.score, {LABEL_SQL.replace('score', 'a.score')} as label, {_COLOUR.format('a.score')} as colour, {r('a.score_raw', 4)} as score_raw, b.score as score_prev, a.score - b.score as score_delta, case when a.score - b.score >= 6 then 'Improving' when a.score - b.score <= -6 then 'Deteriorating' else 'Stable' end as momentum, "
    "case when (6 - a.missing) / 6.0 >= 0.85 then 'High' when (6 - a.missing) / 6.0 >= 0.6 then 'Medium' else 'Low' end as confidence, a.summary, a.equities, a.credit, a.duration, a.dollar, a.tilts, a.favoured as groups, a.mix_equities, a.mix_credit, a.mix_duration, a.mix_cash from (select *, "
    + "concat_ws(', ', " + ", ".join([
        _phrase("credit_z", -0.3, 0.3, ("credit tightening", "credit widening", "credit stable")), _phrase("curve_level", 0, 1.0, ("curve inverted", "curve steep", "curve flat")), _phrase("dollar_z", -0.3, 0.3, ("dollar soft", "dollar firm", "dollar stable")),
        _phrase("breadth_now", -0.3, 0.3, ("breadth fading", "breadth improving", "breadth mixed")), "case when penalty < -0.04 then 'credit/equity divergence warning' end",
    ]) + ") as summary, case when score >= 65 then 'Overweight' when score <= 35 then 'Underweight' else 'Neutral' end as equities, case when credit_level <= 3.5 then 'Overweight' when credit_level >= 5.0 then 'Underweight' else 'Neutral' end as credit, "
    "case when real_level >= 1.5 then 'Underweight' when real_level <= 0.5 then 'Overweight' else 'Neutral' end as duration, case when dollar_z > 0.5 then 'Avoid USD' when dollar_z < -0.5 then 'Favour USD' else 'Neutral' end as dollar, "
    "concat_ws('; ', case when score >= 65 then 'Equities favored by regime score' when score <= 35 then 'Equities pressured by regime score' end, case when growth_z > 0 then 'Breadth improving' when growth_z is not null then 'Breadth deteriorating' end, case when credit_level <= 3.5 then 'Credit spreads tight' when credit_level >= 5.0 then 'Credit spreads wide' end, "
    "case when real_level >= 1.5 then 'Real yields high' when real_level <= 0.5 then 'Real yields low' end, case when curve_level < 0 then 'Curve inversion risk' when curve_level > 1.0 then 'Curve steep' end, case when dollar_z > 0.5 then 'Dollar headwind' end) as tilts, "
    "concat_ws('; ', " + ", ".join(f"case when {t} then '{g}' end" for t, g in GROUPS) + f") as favoured, {_MIX} from rd where d = 'now') a left join rd b on b.d = 'before'"
)
def regime_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regime now: score, change over 21 days, confidence, summary, stances, mix and favoured groups."""
    both = regime.result(regime.readings(snapshot_all(spark, sf_dir)))
    prev = both.where("d = 'before'").agg(F.max("score").alias("score_prev"))
    row = both.where("d = 'now'").join(F.broadcast(prev))
    delta = F.col("score") - F.col("score_prev")
    mixes = [c for c in row.columns if c.startswith("mix_")]
    return row.select("score", "label", regime.colour(F.col("score")).alias("colour"), six("score_raw", "score_raw", 4), "score_prev", delta.alias("score_delta"), momentum(delta).alias("momentum"), "confidence", "summary", "equities", "credit", "duration", "dollar", "tilts", "groups", *mixes)


_PART = [("growth_momentum", "Growth Momentum", "growth", "growth"), ("inflation_price", "Inflation & Price", "inflation", "inflation"), ("monetary_policy", "Monetary Policy", "monetary", "real"), ("market_internals", "Market Internals", "internals", "credit"), ("fiscal_external", "Fiscal & External", "fiscal", "dollar"), ("sentiment", "Sentiment", "sentiment", "sentiment")]
_WEIGHT = {p: f"cast(case when stress then {b} else {a} end as double)" for p, (a, b) in regime.WEIGHTS.items()}
_COMPONENTS = [(f"'{k}'", f"'{n}'", _WEIGHT[p], f"coalesce({p}, 0) * {_WEIGHT[p]}", f"{x}_level", f"{x}_z") for k, n, p, x in _PART]
_COMPONENTS += [
    ("'credit'", "'Credit stress'", "0.0", "0.0", "credit_level", "credit_z"), ("'real_yields'", "'Real yields'", "0.0", "0.0", "real_level", "real_z"), ("'curve'", "'Curve (10y - 2y)'", "0.0", "0.0", "curve_level", "curve_z"),
    ("'dollar'", "'Dollar headwind'", "0.0", "0.0", "dollar_level", "dollar_z"), ("'cpi_momentum'", "'Inflation momentum'", "0.0", "0.0", "inflation_level", "inflation_z"), ("'risk_appetite'", "'Breadth (RSP/SPY)'", "0.0", "0.0", "cast(null as double)", "breadth_now"),
]
_WHAT = ("key", "name", "weight", "contribution", "level", "zscore")


@query(
    with_(SER, LINE, role_sql(ALL), *REGIME, *READ_SQL, "c as (" + union_of("(select * from rd where d = 'now')", _COMPONENTS, _WHAT) + ")")
    + f"select key, name, {r('weight')} as weight, {r('contribution')} as contribution, {r('level', 4)} as level, {r('zscore', 4)} as zscore, cast(case when weight > 0 then round_even(greatest(0, least(100, (contribution / weight + 1) * 50)), 0) else 50 end as bigint) as score, case when zscore * weight > 0.05 then 'Supportive' when zscore * weight < -0.05 then 'Drag' else 'Neutral' end as status, row_number() over (order by round(abs(contribution), 9) desc, key) as place from c"
)
def regime_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pillars and older components, by the size of what they contribute; a fixed dozen of rows."""
    parts = regime.components(regime.readings(snapshot_all(spark, sf_dir).where("d = 'now'")))
    score = F.when(F.col("weight") > 0, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("contribution") / F.col("weight") + 1) * 50)))).otherwise(50).cast("long")
    push = F.col("zscore") * F.col("weight")
    status = F.when(push > 0.05, "Supportive").when(push < -0.05, "Drag").otherwise("Neutral")
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.abs("contribution"), 9)), "key"))
    return parts.select("key", "name", six("weight", "weight"), six("contribution", "contribution"), six("level", "level", 4), six("zscore", "zscore", 4), score.alias("score"), status.alias("status"), place.alias("place"))


@query(
    with_(*HISTORY_SQL, "h as (select score, row_number() over (order by d desc) as rn from sc)", "t as (select -rn as x, score as y from h where rn <= 8)")
    + f"select count(*) as n, {r('case when count(*) >= 4 then regr_slope(y, x) else coalesce(arg_max(y, x) - arg_min(y, x), 0) end')} as slope, case when regr_slope(y, x) > 0.5 then 'Rising' when regr_slope(y, x) < -0.5 then 'Falling' else 'Flat' end as direction from t"
)
def score_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of the last eight weekly scores; with fewer than four, their change."""
    rows = score_history(spark, sf_dir).orderBy(F.desc("d")).limit(8).withColumn("rn", F.datediff("d", F.lit("1970-01-01")))
    rows = rows.withColumn("x", -F.row_number().over(Window.orderBy(F.desc("rn")))).select("x", F.col("score").alias("y"))
    slope = F.when(F.count(F.lit(1)) >= 4, F.regr_slope("y", "x")).otherwise(F.coalesce(F.max_by("y", "x") - F.min_by("y", "x"), F.lit(0)))
    got = rows.agg(F.count(F.lit(1)).alias("n"), slope.alias("s"))
    return got.select("n", six("s", "slope"), F.when(F.col("s") > 0.5, "Rising").when(F.col("s") < -0.5, "Falling").otherwise("Flat").alias("direction"))


# ---- rules over the state


def board(cells: list[tuple[str, ...]], names: tuple[str, ...], kept: str = "true", digits: tuple[str, ...] = (), order: str | None = None, most: int | None = None):
    """A query whose rows are ``cells`` over the state, those that ``kept`` says, numbered by ``order`` up to ``most``."""

    def columns(quote) -> list[str]:
        return [f"{quote(n)} as {n}" for n in names]

    rounded = lambda n: r(n) if n in digits else n
    numbered = f", row_number() over (order by {order}) as place" if order else ""
    sql = with_(*STATE_BASE, "t as (" + union_of("st", cells, names) + ")") + f"select * from (select {', '.join(columns(rounded))}{numbered} from t where {kept})" + (f" where place <= {most}" if most else "")

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = table_of(state(spark, sf_dir), cells, names).where(kept)
            out = [six(n, n) if n in digits else F.col(n) for n in names]
            if order:
                out.append(F.expr(f"row_number() over (order by {order})").alias("place"))
            got = got.select(*out)
            return got.where(F.col("place") <= most) if most else got

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return query(sql)(run)

    return keep


TILT = "greatest(-1, least(1, (score - 50) / 25.0))"
_SUM = lambda *parts: " + ".join(f"coalesce({c}, 0) * ({w})" for c, w in parts)
# Factors with their sides and the weights of the state's z-scores.
FACTORS = [
    ("Value vs Growth", "Value", "Growth", _SUM(("curve_z", 0.4), ("real_z", -0.35), ("credit_z", -0.25))),
    ("Quality vs High-beta", "Quality", "High-beta", _SUM(("credit_z", 0.45), ("real_z", 0.30), ("curve_z", -0.25))),
    ("Small cap vs Large cap", "Small caps", "Large caps", _SUM(("credit_z", -0.35), ("curve_z", 0.35), ("dollar_z", -0.30))),
    ("Cyclicals vs Defensives", "Cyclicals", "Defensives", _SUM(("curve_z", 0.35), ("credit_z", -0.35), (TILT, 0.30))),
    ("Real assets vs Financial", "Real assets", "Financial", _SUM(("real_z", -0.40), ("dollar_z", -0.35), (TILT, 0.25))),
    ("International vs Domestic", "International/EM", "US domestic", _SUM(("dollar_z", -0.50), (TILT, 0.30), ("real_z", -0.20))),
]


@board([(f"'{n}'", f"greatest(-3, least(3, {x}))", f"case when {x} > 0.3 then '{a}' when {x} < -0.3 then '{b}' else 'Neutral' end") for n, a, b, x in FACTORS], ("factor", "score", "direction"), digits=("score",), order="round(abs(score), 6) desc, factor")
def factor_scores():
    """Factor tilts, the strongest first."""


# The pairs of funds by which the brief trades a factor. It has the first five factors alone.
FACTOR_FUNDS = ("XLE+XLF vs QQQ+IGV", "XLP+XLV vs IWM+XBI", "IWM vs SPY", "XLE+XLI vs XLP+XLV", "GLD+XLE vs TLT+HYG")


@board(
    [(str(i), f"'{n}'", f"greatest(-3, least(3, {x}))", *(f"case when {x} > 0 then '{p}' else '{q}' end" for p, q in (n.split(" vs "), n.split(" vs ")[::-1])), f"'{funds}'") for i, ((n, _, _, x), funds) in enumerate(zip(FACTORS, FACTOR_FUNDS))],
    ("nth", "factor", "score", "winner", "loser", "funds"), digits=("score",), order="round(abs(score), 6) desc, nth",
)
def brief_factors():
    """The five factors of the brief with the side that leads and the funds that stand for it."""


# Gaps (name, gap, least): of the brief only where neither z-score is 0.
GAPS = [
    ("VIX vs HY OAS", "vix_z - credit_z", 1.0, ("vix_z", "credit_z")), ("Curve vs IWM/SPY", "curve_z - small_z", 1.2, ("curve_z", "small_z")), ("GLD vs Real rates", "gld_z + real_z", 1.2, ("gld_z", "real_z")),
    ("HYG vs Equity breadth", "case when hyg_quarter < -0.02 and rsp_quarter > 0.03 then (rsp_quarter - hyg_quarter) * 10 end", 0.0, ()),
]


@board([(f"'{n}'", f"case when {' and '.join([f'{z} <> 0' for z in zs] or ['true'])} then {x} end", f"cast({least} as double)") for n, x, least, zs in GAPS], ("name", "gap", "least"), kept="abs(gap) > least", digits=("gap", "least"), order="round(abs(gap), 6) desc, name", most=3)
def divergences():
    """The three widest gaps between statistics that usually go together."""


MORE_GAPS = [
    *[(n, x, least) for n, x, least, _ in GAPS], ("HYG vs SPY", "case when not (hyg_quarter < -0.02 and rsp_quarter > 0.03) and hyg_quarter > 0.02 and spy_quarter < -0.02 then (hyg_quarter - spy_quarter) * 10 end", 0.0),
    ("Fed balance sheet vs Risk appetite", "iwm_z - fed_z", 1.5),
]


@board([(f"'{n}'", x, f"cast({least} as double)") for n, x, least in MORE_GAPS], ("name", "gap", "least"), kept="abs(gap) > least", digits=("gap", "least"), order="round(abs(gap), 6) desc, name", most=5)
def divergence_board():
    """The five widest gaps, those of credit against shares and of central bank assets against small companies too."""


_NEAR = "case when abs(score - 25) <= abs(score - 40) and abs(score - 25) <= abs(score - 60) and abs(score - 25) <= abs(score - 75) then 25 when abs(score - 40) <= abs(score - 60) and abs(score - 40) <= abs(score - 75) then 40 when abs(score - 60) <= abs(score - 75) then 60 else 75 end"


@board([("score", _NEAR, f"abs(score - {_NEAR})", f"case when abs(score - {_NEAR}) <= 3 then 'critical' when abs(score - {_NEAR}) <= 7 then 'warning' else 'stable' end")], ("score", "boundary", "distance", "alert"))
def boundary_alert():
    """The nearest boundary of the labels, the lower one at a tie, and how close it is."""


@board(
    [
        ("'credit'", "case when score >= 50 then round(credit + 0.5, 2) else round(credit - 0.3, 2) end", "case when score >= 50 then 'widens' else 'tightens' end"), ("'real'", "case when score <= 50 then 1.5 else 2.0 end + 0 * real", "case when score <= 50 then 'falls below' else 'rises above' end"),
        ("'curve'", "0.0 * curve", "case when curve >= 0 then 'inverts' else 'uninverts' end"), ("'vratio'", "case when vratio > 0.95 then 0.9 else 1.0 end + 0 * vratio", "case when vratio > 0.95 then 'falls below' else 'rises above' end"),
    ],
    ("what", "bound", "word"), kept="bound is not null", digits=("bound",),
)
def falsification():
    """What would prove the current reading wrong."""


@board(
    [
        ("1", "'expectations elevated'", "fwd > 2.5"), ("2", "case when fwd_week > 0 then 'forward rising fast' else 'forward falling fast' end", "fwd <> 0 and abs(fwd_week) > 0.05"), ("3", "'maximum tightening'", "real > 1.5 and (fed_growth is null or fed_growth < 0)"),
        ("4", "'restrictive rates, growing assets'", "real > 1.5 and fed_growth * 100 > 1"), ("5", "'stagflation'", "cpi_yoy > 3 and real > 1.5"), ("6", "'inflation may return'", "cpi_yoy < 2 and cpi_yoy <> 0 and be > 2.3"),
        ("7", "'none'", "not coalesce(fwd > 2.5, false) and not coalesce(fwd <> 0 and abs(fwd_week) > 0.05, false) and not coalesce(real > 1.5 and (fed_growth is null or fed_growth < 0 or fed_growth * 100 > 1), false) and not coalesce(cpi_yoy > 3 and real > 1.5, false) and not coalesce(cpi_yoy < 2 and cpi_yoy <> 0 and be > 2.3, false)"),
    ],
    ("rule", "tension", "holds"), kept="holds",
)
def fed_tensions():
    """Tensions between rates, liquidity and prices; one row 'none' where there are none."""


@board(
    [
        ("1", "case when curve >= 0.75 then 'steep' when curve >= 0 then 'flat to positive' when curve >= -0.25 then 'shallow inversion' else 'deep inversion' end", "curve", "curve is not null"),
        ("2", "case when curve_month > 0.05 then case when y10_month > 0 and y2_month < y10_month then 'bear steepening' else 'bull steepening' end when curve_month < -0.05 then case when y2_month > 0 then 'bear flattening' else 'bull flattening' end end", "curve_month", "abs(curve_month) > 0.05"),
        ("3", "case when cpi_yoy > 3.5 and curve < 0 then 'stagflation risk' else 'restrictive real yields' end", "cpi_yoy", "cpi_yoy > 3.5 and curve < 0 or cpi_yoy < 2.5 and real > 1.5"),
    ],
    ("rule", "line", "value", "holds"), kept="holds", digits=("value",),
)
def curve_banner():
    """Level, motion and context of the curve."""


@board(
    [
        ("'curve'", "curve", "case when curve >= 0.75 then 'Steep' when curve >= 0 then 'Flat / mildly pos' when curve >= -0.25 then 'Shallow inversion' else 'Deep inversion' end"), ("'volatility'", "vratio", "case when vratio > 1.0 then 'Panic' when vratio > 0.9 then 'Elevated' when vratio is not null then 'Calm' end"),
        ("'credit'", "credit_week", "case when credit_week < 0 then 'tighter' else 'wider' end"), ("'curve week'", "curve_week", "case when curve_week < 0 then 'steeper' else 'flatter' end"), ("'real'", "real_week", "case when real_week < 0 then 'lower' else 'higher' end"),
        ("'fed funds'", "fed_funds", "cast(null as varchar(9))"),
    ],
    ("what", "value", "word"), kept="value is not null", digits=("value",),
)
def home_snapshot():
    """Curve, volatility and the week's changes as the first page shows them."""


#: Signals by priority; without any the weekly summary is left.
PRIORITY = [("vratio_panic", 9, "vratio > 1.0"), ("score_momentum", 6, "abs(score - score_before) >= 8"), ("credit_move", 5, "abs(credit_week) > 0.25"), ("vix_elevated", 4, "vix_pct > 80"), ("curve_momentum", 3, "abs(curve_month) > 0.20"), ("weekly_summary", 1, "true")]


@board([(f"'{n}'", str(p), t) for n, p, t in PRIORITY], ("signal", "priority", "holds"), kept="holds", order="priority desc", most=1)
def priority_signal():
    """The signal of the highest priority that holds."""


# ---- assets against the state

_RISK = "case when score > 55 then 1 when score < 45 then -1 else 0 end"
_REAL = "case when real < 0.5 then 1 when real > 1.5 then -1 when real is not null then 0 end"
_WEAK = "case when dollar_z < -0.5 then 1 when dollar_z > 0.5 then -1 when dollar_z is not null then 0 end"
_BAND = "case when {0} > {1} then -1 when {0} < -1.0 then 1 when {0} is not null then 0 end"
# Signals of the asset page; what is null is not counted.
PAGE = {
    "SPY": (_RISK, "case when credit_z < -0.5 then 1 when credit_z > 0.5 then -1 when credit_z is not null then 0 end", _REAL, "case when spy > spy_200 then 1 when spy_200 is not null then -1 end"),
    "QQQ": (_REAL, "case when real_z > 0.5 then -1 when real_z < -0.5 then 1 when real_z is not null then 0 end", _BAND.format("qqq_spy_z", 1.0), _RISK),
    "GLD": (_REAL, _WEAK, "case when credit_z > 0.5 then 1 when credit_z is not null then 0 end", _BAND.format("gld_z", 1.5)),
    "BTC": ("case when fed_growth > 0.005 then 1 when fed_growth < -0.005 then -1 when fed_growth is not null then 0 end", _WEAK, _RISK, _BAND.format("btc_gld_z", 1.0)),
    "SLV": (_REAL, _WEAK, "case when curve_z > 0.3 then 1 when curve_z < -0.3 then -1 when curve_z is not null then 0 end", _BAND.format("slv_gld_z", 1.0)),
    "XLU": (), "XLC": (),
}


def _count(signals: tuple[str, ...], test: str) -> str:
    return "(" + (" + ".join(f"case when ({s}) {test} then 1 else 0 end" for s in signals) or "0") + ")"


def _page_cells() -> list[tuple[str, ...]]:
    """Scores are positive, so floor cuts their fraction off."""
    out = []
    for asset, signals in PAGE.items():
        pro, con, n = _count(signals, "> 0"), _count(signals, "< 0"), _count(signals, "is not null")
        out.append((f"'{asset}'", f"cast(greatest(15, least(85, floor(50 + coalesce(({pro} - {con}) * 35.0 / nullif({n}, 0), 0)))) as bigint)", f"cast({pro} as bigint)", f"cast({con} as bigint)"))
    return out


@board(_page_cells(), ("asset", "score", "n_confirm", "n_against"))
def page_alignment():
    """Alignment of the asset page's instruments; those without rules stay at 50."""


def _points(*terms: tuple[str, int]) -> str:
    return "greatest(0, least(100, 50" + "".join(f" + case when {t} then {p} else 0 end" for t, p in terms) + "))"


def _both(up: str, down: str, p: int) -> tuple[tuple[str, int], tuple[str, int]]:
    return (up, p), (down, -p)


_UP, _EASY, _SOFT = ("score > 55", "score < 45"), ("real < 0.5 and real <> 0", "real > 1.5"), ("dollar_z < -0.5", "dollar_z > 0.5")
# Points of three signals.
QUICK = {
    "SPY": _points(*_both(*_UP, 20), *_both(*_EASY, 10)), "QQQ": _points(*_both(*_EASY, 25), *_both(*_UP, 10)), "GLD": _points(*_both(*_EASY, 20), *_both(*_SOFT, 15)), "BTC": _points(*_both(*_UP, 20), *_both(*_SOFT, 15)), "SLV": _points(*_both(*_EASY, 15), *_both(*_SOFT, 10)),
}


@board([(f"'{a}'", x, f"case when {x} >= 65 then 'Bullish' when {x} >= 55 then 'Tailwind' when {x} >= 45 then 'Neutral' when {x} >= 35 then 'Headwind' else 'Bearish' end") for a, x in QUICK.items()], ("asset", "score", "label"))
def quick_alignment():
    """Alignment from three signals."""


SAFE = "'TLT', 'UUP', 'GLD', 'XLP', 'XLV', 'XLU'"
HELD = ("SPY", "RSP", "IWM", "QQQ", "GLD", "TLT", "HYG", "UUP", "BTC", "XLF", "XLE", "XLU", "XLP", "XLV", "XLI", "XLK", "XLC")
_STRESS, _CALM = "(coalesce(vix_pct > 75, false) or coalesce(vratio > 1.0, false))", "(coalesce(vix_pct < 30, false) and (vratio is null or vratio < 0.9))"
# Six signals of an asset (series, v, a63, rz, zr) under the state, each -1, 0 or 1.
CONFLUENCE = {
    "regime": f"case when score >= 60 then 1 when score <= 40 then -1 else 0 end * case when series in ({SAFE}) then -1 else 1 end",
    "curve": "case when curve_z is null then 0 when series = 'TLT' then case when real_z < -0.5 then 1 when real_z > 0.5 then -1 else 0 end when series in ('XLU', 'QQQ', 'XLK', 'IGV', 'SMH', 'XBI') then case when curve_z < -0.3 then 1 when curve_z > 0.5 then -1 else 0 end "
    "when series in ('XLP', 'XLV', 'GLD') then 0 when series in ('XLE', 'XLI', 'IWM', 'XLC') then case when curve_z > 0.2 then 1 when curve_z < -0.5 then -1 else 0 end else case when curve_z > 0.3 then 1 when curve_z < -0.5 then -1 else 0 end end",
    "volatility": f"case when {_STRESS} then -1 when {_CALM} then 1 else 0 end * case when series in ({SAFE}) then -1 else 1 end",
    "fed": "case when real is null or real_z is null then 0 when series = 'TLT' then case when real_z < -0.5 then 1 when real_z > 0.5 then -1 else 0 end when series = 'UUP' then case when real > 1.0 then 1 when real < 0.3 then -1 else 0 end when series = 'XLU' then case when real < 0.8 then 1 when real > 1.5 then -1 else 0 end "
    "when series = 'XLF' then case when real > 0.5 and real < 2.0 then 1 when real > 2.5 then -1 else 0 end when series = 'XLE' then case when fed_growth > 0.005 then 1 when fed_growth < -0.005 then -1 else 0 end else case when real > 1.5 then -1 when real < 0.5 then 1 else 0 end end",
    "momentum": "case when v > a63 and rz > 0.5 then 1 when v <= a63 and rz < -0.5 then -1 else 0 end",
    "mean_rev": "case when zr > 2.0 then -1 when zr < -2.0 then 1 else 0 end",
}
CONFLUENCE_SQL = (
    *STATE_BASE,
    "cs as (select series, " + ", ".join(f"{x} as {n}" for n, x in CONFLUENCE.items()) + f" from (select series, v, a63, rz, zr from cur where series in ({', '.join(map(repr, HELD))})) cross join st)",
    "cf as (select *, " + " + ".join(CONFLUENCE) + " as confluence from cs)",
)


def confluences(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = current_all(spark, sf_dir).where(F.col("series").isin(*HELD)).select("series", "v", "a63", "rz", "zr")
    met = assets.join(F.broadcast(state(spark, sf_dir)))  # one row of state
    got = met.select("series", *(F.expr(x).alias(n) for n, x in CONFLUENCE.items()))
    return got.withColumn("confluence", F.expr(" + ".join(CONFLUENCE)))


@query(with_(*CONFLUENCE_SQL) + "select *, case when confluence > 0 then 'long' when confluence < 0 then 'short' else 'neutral' end as direction from cf")
def confluence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six signals of every asset and their sum."""
    c = F.col("confluence")
    return confluences(spark, sf_dir).withColumn("direction", F.when(c > 0, "long").when(c < 0, "short").otherwise("neutral"))


# ---- assets under the regime's history

_HELD = ", ".join(map(repr, HELD))
FORWARD = (
    f"lab as (select d, {LABEL_SQL} as label from sc)",
    "aw as (select series, cast(d + cast((12 - isodow(d)) % 7 as integer) as date) as d, arg_max(v, d) as v from role where series in (" + _HELD + ") group by 1, 2)",
    "fw as (select series, d, lead(v, 4) over (partition by series order by d) / v - 1 as fwd from aw)",
    "lr as (select fw.series, lab.label, fw.fwd from fw join lab on fw.d = lab.d where fwd is not null)",
    "g as (select series, label, count(*) as n, avg(fwd) as mean, stddev_pop(fwd) as sd, median(fwd) as p50, avg(case when fwd > 0 then 1.0 else 0.0 end) as wr, coalesce(avg(case when fwd > 0 then fwd end), 0) as gain, coalesce(abs(avg(case when fwd <= 0 then fwd end)), 1e-6) as loss from lr group by 1, 2 having count(*) >= 8)",
)
HISTORY_ALL = (SER, LINE, role_sql(ALL), *HISTORY_SQL[3:])


def labelled_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, label, fwd): four-week returns of the assets from every Friday under the regime's label of that Friday."""
    rows = roles(spark, sf_dir, ALL)
    weeks = points.weekly(rows.where(F.col("series").isin(*HELD))).withColumn("fwd", windows.forward_return(F.col("v")))
    labels = score_history(spark, sf_dir, ALL).select("d", "label")  # a row a week
    return weeks.join(labels, "d").select("series", "label", "d", "fwd")


@query(with_(*HISTORY_ALL, *FORWARD) + f"select series, label, n, {r('p50')} as p50, {r('mean')} as mean, {r('wr')} as win_rate, {r('mean / nullif(sd, 0) * sqrt(52.0)', 4)} as ratio from g")
def asset_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of every asset under every label of the regime."""
    got = points.distribution(labelled_returns(spark, sf_dir), ["series", "label"])
    return got.select("series", "label", "n", six("p50", "p50"), six("mean", "mean"), six("win_rate", "win_rate"), six("ratio", "ratio", 4))


_RANK = "case label " + " ".join(f"when '{n}' then {i}" for i, n in enumerate(reversed(NAMES))) + " end"


def degrade(labels: DataFrame, now: DataFrame, least: int = 20) -> DataFrame:
    """One row: the share of weeks with the label of ``now`` after which a worse one came; 0 with fewer than ``least`` weeks."""
    k = F.element_at(F.create_map(*(F.lit(x) for i, n in enumerate(reversed(NAMES)) for x in (n, i))), F.col("label"))
    rows = labels.withColumn("one", F.lit(1)).withColumn("k", k).withColumn("t", F.lead("k").over(windows.by("one")))  # a row a week
    met = rows.join(F.broadcast(now.select(F.col("label").alias("current"))))
    share = F.coalesce(F.avg(F.when((F.col("label") == F.col("current")) & F.col("t").isNotNull(), (F.col("t") < F.col("k")).cast("double"))), F.lit(0.0))
    return met.agg(F.when(F.count(F.lit(1)) >= least, share).otherwise(0.0).alias("degrade"))


#: The history beside the snapshot in one SQL text: its tables get names of their own.
_TABLES = ("every", "s1", "vixp", "s2", "s3", "fri", "asked", "met", "wide", "gold", "gl", "pil", "pen", "raw", "sc")
RENAMED_HISTORY = tuple(re.sub(rf"\b({'|'.join(_TABLES)})\b(?= as \(|\.|$| |,|\))(?!\w)", lambda m: f"h_{m[1]}", x) for x in HISTORY_SQL[3:])


@query(
    with_(*CONFLUENCE_SQL, *RENAMED_HISTORY, *(x.replace("from sc", "from h_sc") for x in FORWARD), f"mk as (select {_RANK} as k, lead({_RANK}) over (order by d) as t, count(*) over () as weeks, label from lab)", f"nw as (select {LABEL_SQL} as label from sc where d = 'now')", "dg as (select case when max(weeks) >= 20 then coalesce(avg(case when t < k then 1.0 else 0.0 end) filter (where mk.label = nw.label and t is not null), 0) else 0 end as degrade from mk cross join nw)", "k as (select cf.series, confluence as c, wr, gain / nullif(loss, 0) as payoff, degrade, case when confluence > 0 then wr else 1 - wr end as rate from g join nw on g.label = nw.label join cf on cf.series = g.series cross join dg where confluence <> 0)", "z as (select *, case when c > 0 then greatest(0, wr - coalesce((1 - wr) / nullif(payoff, 0), 1e12)) * 0.25 when payoff > 0 then greatest(0, rate - (1 - rate) / payoff) * 0.25 else 0 end as kelly from k)", "al as (select *, kelly * abs(c) / 6.0 * case when rate >= 0.48 then 1 else 0.1 end * (1 - least(degrade * 0.5, 0.4)) as alpha from z)")
    + f"select series, case when c > 0 then 'long' else 'short' end as direction, c as confluence, {r('rate')} as win_rate, {r('kelly')} as kelly, rate >= 0.48 as validated, {r('alpha')} as alpha, row_number() over (partition by c > 0 order by round(alpha, 9) desc, series) as place from al qualify place <= case when c > 0 then 6 else 4 end"
)
def trade_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades under the current label by confluence and history: the six best long ones and the four best short ones."""
    rows = labelled_returns(spark, sf_dir)
    history = score_history(spark, sf_dir, ALL).select("d", "label")
    now = snapshot_all(spark, sf_dir).where("d = 'now'").select("label")
    dist = points.distribution(rows, ["series", "label"]).join(F.broadcast(now), "label").drop("label")
    worse = degrade(history, now)
    got = rules.trades(dist.join(F.broadcast(worse)), confluences(spark, sf_dir).select("series", "confluence"), F.col("degrade"))
    place = F.row_number().over(Window.partitionBy("direction").orderBy(F.desc(F.round("alpha", 9)), "series"))
    got = got.withColumn("place", place).where(F.col("place") <= F.when(F.col("direction") == "long", 6).otherwise(4))
    return got.select("series", "direction", "confluence", six("win_rate", "win_rate"), six("kelly", "kelly"), "validated", six("alpha", "alpha"), "place")


API_ASSETS = ("SPY", "RSP", "IWM", "GLD", "TLT", "HYG")
_API, _SAFE = ", ".join(map(repr, API_ASSETS)), "'TLT', 'GLD', 'SLV', 'XLU'"


@query(
    with_(*STATE_BASE, f"s as (select series, v, m200, case when series in ({_SAFE}) then -1 else 1 end as side from cur where series in ({_API}))", "vo as (select series, list_filter([case when score > 55 then side when score < 45 then -side end, case when credit_z > 0.5 then -side when credit_z < -0.5 then side end, case when real > 1.5 then -side when real < 0.5 then side end, case when m200 is not null then case when v > m200 then 1 else -1 end end], lambda x: x is not null) as vs from s, st)", "co as (select series, len(list_filter(vs, lambda x: x > 0)) as pro, len(list_filter(vs, lambda x: x < 0)) as con, len(vs) as n from vo)", "al as (select series, cast(trunc(greatest(15, least(85, 50 + coalesce((pro - con) / nullif(n, 0), 0) * 35))) as bigint) as score, cast(pro as bigint) as n_confirm, cast(con as bigint) as n_against from co)")
    + "select *, case when score >= 65 then 'BULLISH' when score >= 55 then 'MILD TAILWIND' when score >= 45 then 'NEUTRAL' when score >= 33 then 'MILD HEADWIND' else 'BEARISH' end as label from al"
)
def asset_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the assets with the regime's score, credit, real yields and their own long mean."""
    assets = current_all(spark, sf_dir).where(F.col("series").isin(*API_ASSETS)).select("series", "v", "m200")
    got = rules.alignment(assets, state(spark, sf_dir).select("score", "credit_z", "real"), ("TLT", "GLD", "SLV", "XLU"))
    return got.withColumn("label", rules.alignment_label(F.col("score")))


__all__ = ["ORACLE", "QUERIES"]
