"""The dominant trade, the top signals to trade, and the regime's history beside shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import points
from .base_sql import r, with_
from .model_queries import LABEL_SQL, score_history
from .rule_queries import roles
from .series_queries import day, query, six
from .state_queries import ALL, FORWARD, HISTORY_ALL, ORACLE, QUERIES, RENAMED_HISTORY, STATE_BASE, current_all, labelled_returns, snapshot_all, state

# The trades that compete, in the order that settles ties.
CANDIDATES = (
    ("GLD", "Gold", 1), ("UUP", "USD", 1), ("UUP", "USD", -1), ("TLT", "Long bonds", 1), ("TLT", "Long bonds", -1), ("HYG", "High yield", 1), ("HYG", "High yield", -1), ("SPY", "S&P 500", 1), ("IWM", "Small caps", 1),
    ("XLE", "Energy", 1), ("XLF", "Financials", 1), ("XLP", "Defensives", 1), ("BTC", "Bitcoin", 1),
)
_TRADED = ", ".join(f"'{x}'" for x in dict.fromkeys(x for x, _, _ in CANDIDATES))
#: Z-scores of the state, a missing one counting as 0.
ZS = ("curve", "real", "credit", "dollar", "cpi", "be")
_Z = ", ".join(f"coalesce({c}_z, 0) as {c}_z" for c in ZS)


def _sign(x: str, high: float, low: float) -> str:
    return f"case when {x} > {high} then 1 when {x} < {low} then -1 else 0 end"


def _by_series(*cases: tuple[str, str]) -> str:
    """The expression of the first group of series (blank-separated) that an asset is in, else 0; without a group, that of all others."""
    told = " ".join(f"when series in ({', '.join(map(repr, names.split()))}) then {x}" for names, x in cases if names)
    return f"case {told} else {next((x for names, x in cases if not names), '0')} end"


def _long(x: str) -> str:
    return f"(case when side > 0 then {x} else 0 end)"


_RISING, _FALLING = "(cpi_z > 0.4 or be_z > 0.5)", "(cpi_z < -0.4 and be_z < 0)"
# Eight dimensions of a trade (series, side 1 or -1, v, a63, rz, wr) under the state, each -1, 0 or 1.
DIMENSIONS = {
    "regime": f"side * {_sign('score', 55, 45)} * case when series in ('GLD', 'TLT', 'UUP', 'XLP') then -1 else 1 end",
    "credit": f"side * {_sign('credit_z', 0.5, -0.5)} * case when series in ('GLD', 'TLT', 'UUP', 'XLP') then 1 else -1 end",
    "real_rate": _by_series(
        ("GLD", f"-side * {_sign('real', 1.5, 0.5)}"), ("TLT", _long("case when real_z > 0.5 then -1 else 1 end")), ("UUP", _long(_sign("real", 1.5, 0.5))),
        ("SPY IWM BTC", _long(f"-({_sign('real', 1.5, 0.5)})")), ("XLE", _long(_sign("cpi_z", 0.3, -0.3))),
    ),
    "curve": _by_series(
        ("XLF", f"side * {_sign('curve_z', 0.4, -0.3)}"), ("TLT", "case when side > 0 and curve_z < -0.5 then 1 when curve_z > 0.5 then -1 else 0 end"), ("IWM XLE", _long(_sign("curve_z", 0.4, -0.3))),
        ("GLD", "0"), ("", _long("case when curve_z < -0.3 then 0 else 1 end")),
    ),
    "dollar": _by_series(("UUP", f"side * {_sign('dollar_z', 0.5, -0.5)}"), ("GLD BTC XLE", f"-side * {_sign('dollar_z', 0.5, -0.5)}"), ("SPY IWM", _long("case when dollar_z > 0.5 then -1 else 1 end"))),
    "inflation": _by_series(("GLD BTC", _long(f"case when {_RISING} then 1 else 0 end")), ("XLE", _long(f"case when {_RISING} then 1 when {_FALLING} then -1 else 0 end")), ("TLT", _long(f"case when {_FALLING} then 1 when {_RISING} then -1 else 0 end"))),
    "momentum": "side * case when v > a63 and rz > 0.4 then 1 when v <= a63 and rz < -0.4 then -1 else 0 end",
    "history": "case when wr > 0.58 then 1 when wr < 0.44 then -1 else 0 end",
}
_CONFIRM = " + ".join(f"case when {n} > 0 then 1 else 0 end" for n in DIMENSIONS)
_AGAINST = " + ".join(f"case when {n} < 0 then 1 else 0 end" for n in DIMENSIONS)
_STRENGTH = "(abs(real_z) + abs(credit_z) + abs(curve_z) + abs(dollar_z)) / 4"
_SHARE = "greatest(0, wr - (1 - wr) / 1.6) * 0.25"
_POINTS = f"greatest(0, (n_confirm - n_against) / 8.0) * ({_SHARE}) * (1 + 0.5 * {_STRENGTH})"
_SIDE = "case when side > 0 then 'long' else 'short' end as direction"
#: Win rate of a trade whose asset has too short a history under the label.
UNKNOWN = 0.52


def candidates(assets: DataFrame, row: DataFrame, win_rates: DataFrame) -> DataFrame:
    """Every candidate trade with its dimensions, from (series, v, a63, rz), the one-row state and (series, win_rate)."""
    items = F.explode(F.array(*(F.struct(F.lit(i).alias("nth"), F.lit(s).alias("series"), F.lit(n).alias("name"), F.lit(d).alias("side")) for i, (s, n, d) in enumerate(CANDIDATES))))
    rows = row.selectExpr("score", "real", *(f"coalesce({c}_z, 0) as {c}_z" for c in ZS))
    met = rows.withColumn("x", items).select("*", "x.*").drop("x").join(assets, "series").join(win_rates, "series", "left")
    met = met.withColumn("wr", F.expr(f"case when side > 0 then coalesce(win_rate, {UNKNOWN}) else 1 - coalesce(win_rate, {UNKNOWN}) end"))
    met = met.select("*", *(F.expr(x).cast("int").alias(n) for n, x in DIMENSIONS.items()))
    return met.withColumn("n_confirm", F.expr(_CONFIRM)).withColumn("n_against", F.expr(_AGAINST))


@query(
    with_(
        *STATE_BASE, *RENAMED_HISTORY, *(x.replace("from sc", "from h_sc") for x in FORWARD), f"nw as (select {LABEL_SQL} as label from sc where d = 'now')", "wn as (select series, wr as win_rate from g join nw on g.label = nw.label)",
        "ca (nth, series, name, side) as (values " + ", ".join(f"({i}, '{s}', '{n}', {d})" for i, (s, n, d) in enumerate(CANDIDATES)) + ")",
        f"mt as (select ca.*, cur.v, cur.a63, cur.rz, score, real, {_Z}, case when side > 0 then coalesce(win_rate, {UNKNOWN}) else 1 - coalesce(win_rate, {UNKNOWN}) end as wr from ca join cur on ca.series = cur.series left join wn on wn.series = ca.series cross join st)",
        "dm as (select *, " + ", ".join(f"cast({x} as integer) as {n}" for n, x in DIMENSIONS.items()) + " from mt)", f"cc as (select *, {_CONFIRM} as n_confirm, {_AGAINST} as n_against from dm)", f"pt as (select *, {_POINTS} as points, {_SHARE} as kelly from cc where n_confirm >= 2)",
    )
    + f"select series, name, {_SIDE}, {', '.join(DIMENSIONS)}, n_confirm, n_against, {r('(n_confirm - n_against) / 8.0')} as conviction, {r('wr')} as win_rate, {r('kelly')} as kelly, {r('points')} as score, row_number() over (order by round(points, 9) desc, nth) as place from pt"
)
def dominant_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate trades that two dimensions or more confirm, by conviction, share and strength; place 1 is the dominant one."""
    assets = current_all(spark, sf_dir).where(f"series in ({_TRADED})").select("series", "v", "a63", "rz")
    now = snapshot_all(spark, sf_dir).where("d = 'now'").select("label")
    rates = points.distribution(labelled_returns(spark, sf_dir), ["series", "label"]).join(F.broadcast(now), "label").select("series", "win_rate")
    got = candidates(assets, state(spark, sf_dir), rates).where("n_confirm >= 2").withColumn("points", F.expr(_POINTS)).withColumn("kelly", F.expr(_SHARE))
    place = F.row_number().over(Window.orderBy(F.desc(F.round("points", 9)), "nth"))
    conviction = (F.col("n_confirm") - F.col("n_against")) / 8.0
    return got.selectExpr("*", _SIDE).select("series", "name", "direction", *DIMENSIONS, "n_confirm", "n_against", six(conviction, "conviction"), six("wr", "win_rate"), six("kelly", "kelly"), six("points", "score"), place.alias("place"))


# What is bought and sold on a component that adds to the score or takes from it.
INSTRUMENTS = {
    "Credit stress": ("HYG", "Short HYG / Long TLT"), "Real yields": ("TLT", "Short TLT / Long UUP"), "Curve": ("XLF", "TLT / XLP"), "Risk appetite": ("IWM", "Short IWM / Long SPY"), "Dollar impulse": ("GLD", "UUP"), "Inflation momentum": ("TIPS / GLD", "TLT"),
}
_BOUGHT = "case " + " ".join(f"when name = '{n}' then case when contribution > 0 then '{up}' else '{down}' end" for n, (up, down) in INSTRUMENTS.items()) + " else name end"
_FROM_PARTS = ("name as signal", "case when contribution > 0 then 'bullish' else 'bearish' end as direction", f"{_BOUGHT} as instrument", "zscore as z", "contribution")
_FROM_FACTOR = ("concat('Factor: ', factor) as signal", "case when score > 0 then 'long' else 'short' end as direction", "funds as instrument", "score as z", "score as contribution")
_PART_KEPT, _FACTOR_KEPT = "place <= 3 and abs(zscore) >= 0.3", "place = 1 and abs(score) >= 0.5"


@query(
    f"select *, row_number() over (order by abs(contribution) desc, signal) as place from (select {', '.join(_FROM_PARTS)} from ({ORACLE['regime_components']}) where {_PART_KEPT} union all select {', '.join(_FROM_FACTOR)} from ({ORACLE['brief_factors']}) where {_FACTOR_KEPT}) qualify place <= 3"
)
def top_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest of the components that push the score and the leading factor."""
    parts = QUERIES["regime_components"](spark, sf_dir).where(_PART_KEPT).selectExpr(*_FROM_PARTS)
    factor = QUERIES["brief_factors"](spark, sf_dir).where(_FACTOR_KEPT).selectExpr(*_FROM_FACTOR)
    place = F.row_number().over(Window.orderBy(F.desc(F.abs("contribution")), "signal"))
    return parts.unionByName(factor).withColumn("place", place).where("place <= 3")


SPANS = {"1y": 400, "3y": 1100, "5y": 2000}


@query(
    with_(*HISTORY_ALL, "en as (select max(d) as e from sc)", "wk as (select cast(d + cast((12 - isodow(d)) % 7 as integer) as date) as d, arg_max(v, d) as v from role where series = 'SPY' group by 1)", "wv as (select wk.*, first_value(v) over (order by d) as f from wk cross join en where d >= e - 1100)")
    + f"select cast(coalesce(sc.d, wv.d) as varchar) as d, score, {LABEL_SQL} as label, {r('v / f * 100', 4)} as shares from (select sc.* from sc cross join en where d >= e - 1100) sc full join wv on sc.d = wv.d"
)
def history_against_shares(spark: SparkSession, sf_dir: str, span: str = "3y") -> DataFrame:
    """The weekly score with its label, and weekly share prices with the first of the span as 100."""
    rows = roles(spark, sf_dir, ALL)
    scores = score_history(spark, sf_dir, ALL).select("d", "score", "label")
    end = F.broadcast(scores.agg(F.date_sub(F.max("d"), SPANS[span]).alias("start")))  # one row
    shares = points.weekly(rows.where("series = 'SPY'")).select("d", "v").join(end).where(F.col("d") >= F.col("start"))
    shares = shares.select("d", (F.col("v") / F.first("v").over(Window.orderBy("d")) * 100).alias("x"))  # a row a week
    scores = scores.join(end).where(F.col("d") >= F.col("start")).drop("start")
    return scores.join(shares, "d", "full").select(day(), "score", "label", six("x", "shares", 4))


@query(
    with_(*HISTORY_ALL, *FORWARD)
    + ", ".join(["select series, label, count(*) as n", *(f"{r(f'quantile_cont(fwd, {q}) * 100', 4)} as {n}" for n, q in (("low", 0.25), ("middle", 0.5), ("high", 0.75)))])
    + f", {r('min(fwd) * 100', 4)} as least, {r('max(fwd) * 100', 4)} as most from lr group by 1, 2 having count(*) >= 5"
)
def return_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles and ends of the four-week returns in percent of every asset under every label with five weeks or more."""
    x = F.col("fwd") * 100
    quartiles = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = labelled_returns(spark, sf_dir).where("fwd is not null").groupBy("series", "label").agg(F.count(F.lit(1)).alias("n"), quartiles.alias("q"), F.min(x).alias("least"), F.max(x).alias("most")).where("n >= 5")
    return got.select("series", "label", "n", *(six(F.col("q")[i], n, 4) for i, n in enumerate(("low", "middle", "high"))), six("least", "least", 4), six("most", "most", 4))


__all__ = ["ORACLE", "QUERIES"]
