"""What the state says and what would change it: signal of the day with its context, thesis, scenarios, weekly z-scores of the components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import points, windows
from . import chart_queries
from .base_sql import DAY, FRIDAY, r, with_
from .model_queries import LABEL_SQL, score_history
from .series_queries import day, query, six
from .state_queries import ALL, BASE, ORACLE, PRIORITY, QUERIES, RENAMED_HISTORY, STATE_BASE, all_series, board, state

SPARKS = ("hy_oas", "curve2", "real10", "dollar_broad", "small")
_SPARKS = ", ".join(f"'{x}'" for x in SPARKS)
_YEAR = "(partition by series order by d rows between 251 preceding and current row)"


@query(
    with_(
        *BASE, f"wk as (select series, {FRIDAY} as d, arg_max(v, d) as v from every where series in ({_SPARKS}) group by 1, 2)",
        f"z as (select series, d, case when count(*) over {_YEAR} >= 60 then (v - avg(v) over {_YEAR}) / nullif(stddev_samp(v) over {_YEAR}, 0) end as z from wk)",
        "k as (select *, lag(z) over (partition by series order by d) as was, row_number() over (partition by series order by d desc) as rn, count(*) over (partition by series) as n from z where z is not null)",
    )
    + f"select series, {DAY}, {r('z')} as z, {r('z - was')} as change from k where n >= 12 and rn <= 24"
)
def component_sparklines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 24 weekly z-scores of the components that have 12 or more, with their change since the week before."""
    weeks = points.weekly(all_series(spark, sf_dir).where(f"series in ({_SPARKS})"))
    own = windows.last_rows(252, "series", "d")
    sd = F.stddev_samp("v").over(own)
    z = F.when((F.count("v").over(own) >= 60) & (sd != 0), (F.col("v") - F.avg("v").over(own)) / sd)
    rows = weeks.withColumn("z", z).where("z is not null").withColumn("rn", windows.newest_first())
    rows = rows.withColumn("was", F.lag("z").over(windows.by())).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("series")))
    return rows.where("n >= 12 and rn <= 24").select("series", day(), six("z", "z"), six(F.col("z") - F.col("was"), "change"))


# Bounds of the labels, and the moves that would carry the score across the next one.
BOUNDS = (25, 40, 60, 75)
MOVES = {
    "up": (("credit", "30 to 50 bp tighter"), ("curve", "15 bp steeper"), ("small companies", "3 % ahead in 3 months"), ("real yields", "20 bp lower"), ("dollar", "1 % weaker")),
    "down": (("credit", "50 bp wider"), ("curve", "flatter or inverted"), ("volatility", "VIX above 30, ratio above 1"), ("real yields", "30 bp higher"), ("dollar", "2 % stronger")),
}
_UP = "case " + " ".join(f"when score < {b} then {b}" for b in BOUNDS) + " end"
_DOWN = "case " + " ".join(f"when score >= {b} then {b}" for b in reversed(BOUNDS)) + " end"
_GOAL = {"up": (_UP, f"{_UP} - score + 1"), "down": (f"{_DOWN} - 1", f"score - ({_DOWN}) + 1")}


@board([(f"'{side}'", str(i), f"'{what}'", f"'{move}'", *(f"cast({x} as integer)" for x in _GOAL[side])) for side, moves in MOVES.items() for i, (what, move) in enumerate(moves)], ("side", "nth", "what", "move", "target", "points"), kept="target is not null")
def flip_scenarios():
    """Moves that would carry the score over the next bound above or below, and the points that takes."""


#: Place of a label among the five, the worst 0.
_RANK = "case " + " ".join(f"when score >= {b} then {len(BOUNDS) - i}" for i, b in enumerate(reversed(BOUNDS))) + " else 0 end"
_NAMED = "case {0} when 4 then 'Risk On' when 3 then 'Bullish' when 2 then 'Neutral' when 1 then 'Bearish' when 0 then 'Risk Off' end"
_CROSSED = "coalesce((v < 0 and was >= 0) or (v >= 0 and was < 0), false)"
#: All signals: those of the state and those of the labels' history.
SIGNALS = sorted([*PRIORITY, ("regime_change", 10, "prev_k <> now_k"), ("curve_cross", 8, "crossed"), ("degrade_warning", 7, "degrade > 0.40")], key=lambda x: -x[1])
_SIGNAL = "case " + " ".join(f"when {test} then '{n}'" for n, _, test in SIGNALS) + " end"
_MOVED = ("stay", "t = k"), ("degrade", "t < k"), ("improve", "t > k")
_READS = ("curve", "c3m", "curve_month", "real", "credit", "credit_week", "credit_z", "cpi_yoy", "vix", "vix3m", "vratio", "vix_pct", "small_z", "stay", "degrade", "improve")
LEAST_WEEKS = 20


def moves_of(history: DataFrame) -> DataFrame:
    """One row from weekly scores (d, score): prev_k, the place of the last label but one, and how often the last label stayed, worsened and improved (null below LEAST_WEEKS weeks)."""
    ranked = history.withColumn("k", F.expr(_RANK))
    one = Window.orderBy("d")  # a row a week
    ranked = ranked.withColumn("t", F.lead("k").over(one)).withColumn("rn", F.row_number().over(Window.orderBy(F.desc("d"))))
    ends = ranked.agg(F.count(F.lit(1)).alias("weeks"), F.max(F.when(F.col("rn") == 1, F.col("k"))).alias("last_k"), F.max(F.when(F.col("rn") == 2, F.col("k"))).alias("prev_k"))
    met = ranked.join(F.broadcast(ends)).where(f"t is not null and k = last_k and weeks >= {LEAST_WEEKS}")
    shares = met.agg(*(F.avg(F.expr(f"case when {test} then 1.0D else 0.0D end")).alias(n) for n, test in _MOVED))
    return ends.select("prev_k").join(F.broadcast(shares))


@query(
    with_(
        *STATE_BASE, *RENAMED_HISTORY, f"hk as (select d, {_RANK} as k, lead({_RANK}) over (order by d) as t, row_number() over (order by d desc) as rn from h_sc)",
        "hl as (select count(*) as weeks, max(k) filter (where rn = 1) as last_k, max(k) filter (where rn = 2) as prev_k from hk)",
        "ho as (select " + ", ".join(f"avg(case when {test} then 1.0 else 0.0 end) as {n}" for n, test in _MOVED) + f" from hk cross join hl where t is not null and k = last_k and weeks >= {LEAST_WEEKS})",
        f"cx as (select coalesce(bool_or({_CROSSED}) filter (where rn = 1), false) as crossed from (select v, lag(v) over (order by d) as was, row_number() over (order by d desc) as rn from every where series = 'curve2'))",
        f"cr as (select st.*, prev_k, {_RANK} as now_k, stay, degrade, improve, crossed from st cross join hl cross join ho cross join cx)",
    )
    + f"select {_SIGNAL} as signal, score, score - score_before as score_delta, {LABEL_SQL} as label, {_NAMED.format('prev_k')} as previous, crossed, {', '.join(f'{r(x)} as {x}' for x in _READS)} from cr"
)
def content_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the signal of the highest priority with all that a note on it needs."""
    curve = all_series(spark, sf_dir).where("series = 'curve2'").withColumn("was", F.lag("v").over(windows.by())).withColumn("rn", windows.newest_first())
    crossed = curve.where("rn = 1").agg(F.coalesce(F.max(F.expr(_CROSSED)), F.lit(False)).alias("crossed"))
    past = moves_of(score_history(spark, sf_dir, ALL).select("d", "score"))
    row = state(spark, sf_dir).withColumn("now_k", F.expr(_RANK)).join(F.broadcast(past)).join(F.broadcast(crossed))  # one row each
    fixed = [F.expr(_SIGNAL).alias("signal"), "score", F.expr("score - score_before").alias("score_delta"), F.expr(LABEL_SQL).alias("label"), F.expr(_NAMED.format("prev_k")).alias("previous"), "crossed"]
    return row.select(*fixed, *(six(x, x) for x in _READS))


@board(
    [
        ("1", "'score'", "case when score >= 75 then 'risk-on' when score >= 60 then 'bullish' when score >= 40 then 'neutral' when score >= 25 then 'deteriorating' else 'risk-off' end", "cast(score as double)", "score is not null"),
        ("2", "'score over 21 days'", "case when score > score_before then 'gained' else 'lost' end", "cast(abs(score - score_before) as double)", "score <> score_before"),
        ("3", "'real yield'", "case when real > 1.5 then 'restrictive' when real > 0.8 then 'tightening' else 'accommodative' end", "real", "real is not null"),
        ("4", "'high yield spread'", "case when credit_z > 1.0 then 'stressed' when credit_z > 0.3 then 'elevated' else 'contained' end", "credit", "credit is not null and credit_z is not null"),
        ("5", "'curve'", "case when curve > 0.5 then 'steep' when curve > 0 then 'flat' else 'inverted' end", "curve", "curve is not null"),
        ("6", "'curve over a month'", "case when curve_month < 0 then 'bear flattening' else 'steepening' end", "curve_month", "abs(curve_month) > 0.05"),
    ],
    ("nth", "topic", "word", "value", "holds"), kept="holds", digits=("value",),
)
def thesis_reads():
    """Level and change of the score, and what rates, credit and curve say."""


# ---- what changed this week

#: The rules in their order; a name of two series is a ratio or a spread. Six lines at most are kept.
LINES = 6
_AHEAD = chart_queries.ORACLE["strength_table"]


@query(
    with_(
        *STATE_BASE,
        "last65 as (select series, v, row_number() over (partition by series order by d desc) as rn, count(*) over (partition by series) as n from every where series in ('curve2', 'small'))",
        """flips as (
            select series, case when now_up and not was_up then 'up' when was_up and not now_up then 'down' end as flip
            from (select series, max(v) filter (where rn = 1) > max(v) filter (where rn = 64) as now_up, max(v) filter (where rn = 2) > max(v) filter (where rn = 65) as was_up from last65 where n >= 65 group by series)
        )""",
        f"ahead as (select series, m, row_number() over (order by m desc, series) as best, row_number() over (order by m, series) as worst from ({_AHEAD}) where m is not null)",
        """lines as (
            select 1 as rule, printf('High yield spreads %s by %.2f pp this week.', case when credit_week > 0 then 'widened' else 'tightened' end, round(abs(credit_week), 2)) as line from st where abs(credit_week) >= 0.10
            union all select 2, printf('The 10y minus 2y curve %s by %.2f pp this week.', case when curve_week > 0 then 'steepened' else 'flattened' end, round(abs(curve_week), 2)) from st where abs(curve_week) >= 0.10
            union all select 3, 'Curve trend flipped ' || flip || ' on a 3-month lookback.' from flips where series = 'curve2' and flip is not null
            union all select 4, printf('Real yields %s by %.2f pp this week.', case when real_week > 0 then 'rose' else 'fell' end, round(abs(real_week), 2)) from st where abs(real_week) >= 0.10
            union all select 5, printf('The dollar %s by %.2f%% this week.', case when dollar_week > 0 then 'strengthened' else 'weakened' end, round(abs(dollar_week) * 100, 2)) from st where abs(dollar_week) >= 0.005
            union all select 6, printf('Risk appetite %s: IWM/SPY moved %.2f%% this week.', case when small_week > 0 then 'improved' else 'deteriorated' end, round(small_week * 100, 2)) from st where abs(small_week) >= 0.005
            union all select 7, 'IWM/SPY trend flipped ' || flip || ' on a 3-month lookback.' from flips where series = 'small' and flip is not null
            union all select 8, 'Rotation leaders vs SPY (1m): ' || string_agg(printf('%s (%.1f%%)', series, round(m * 100, 1)), ', ' order by best) || '.' from ahead where best <= 2 having count(*) > 0
            union all select 9, 'Rotation laggards vs SPY (1m): ' || string_agg(printf('%s (%.1f%%)', series, round(m * 100, 1)), ', ' order by worst) || '.' from ahead where worst <= 2 having count(*) > 0
        )""",
    )
    + f"select cast(row_number() over (order by rule) as integer) as place, line from lines qualify place <= {LINES}"
)
def what_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What moved enough this week, trends that turned, leaders and laggards, in the order of the rules, six lines at most."""
    rn = windows.newest_first()
    rows = all_series(spark, sf_dir).where("series in ('curve2', 'small')").withColumn("rn", rn).where("rn <= 65")
    return changes(state(spark, sf_dir), rows, QUERIES["strength_table"](spark, sf_dir))


def changes(row: DataFrame, tails: DataFrame, ahead: DataFrame) -> DataFrame:
    """(place, line) from the one-row state, the last 65 rows (series, rn, v) of curve2 and small, and the strength (series, m) of others."""

    def at(name: str, k: int) -> Column:
        return F.max(F.when((F.col("series") == name) & (F.col("rn") == k), F.col("v")))

    def flip(name: str) -> Column:
        now, was = at(name, 1) > at(name, 64), at(name, 2) > at(name, 65)
        return F.when(now & ~was, "up").when(was & ~now, "down")

    turned = tails.agg(*(flip(n).alias(f"{n}_flip") for n in ("curve2", "small")))
    order = F.struct(F.col("m"), F.col("series"))
    known = ahead.where("m is not null").agg(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("by"), "series", "m"))).alias("best"), F.array_sort(F.collect_list(order)).alias("worst"))  # a fixed list of names
    rows = row.join(F.broadcast(turned)).join(F.broadcast(known))  # one row each

    def moved(text: str, by: str, least: float, up: str, down: str, scale: int = 1, signed: bool = False) -> Column:
        size = F.round((F.col(by) if signed else F.abs(by)) * scale, 2)
        return F.when(F.abs(by) >= least, F.format_string(text, F.when(F.col(by) > 0, up).otherwise(down), size))

    def named(side: str, word: str) -> Column:
        pairs = F.transform(F.slice(side, 1, 2), lambda x: F.format_string("%s (%.1f%%)", x["series"], F.round(x["m"] * 100, 1)))
        return F.when(F.size(side) > 0, F.concat(F.lit(f"Rotation {word} vs SPY (1m): "), F.array_join(pairs, ", "), F.lit(".")))

    lines = [
        moved("High yield spreads %s by %.2f pp this week.", "credit_week", 0.10, "widened", "tightened"),
        moved("The 10y minus 2y curve %s by %.2f pp this week.", "curve_week", 0.10, "steepened", "flattened"),
        F.concat(F.lit("Curve trend flipped "), F.col("curve2_flip"), F.lit(" on a 3-month lookback.")),
        moved("Real yields %s by %.2f pp this week.", "real_week", 0.10, "rose", "fell"),
        moved("The dollar %s by %.2f%% this week.", "dollar_week", 0.005, "strengthened", "weakened", 100),
        moved("Risk appetite %s: IWM/SPY moved %.2f%% this week.", "small_week", 0.005, "improved", "deteriorated", 100, True),
        F.concat(F.lit("IWM/SPY trend flipped "), F.col("small_flip"), F.lit(" on a 3-month lookback.")),
        named("best", "leaders"), named("worst", "laggards"),
    ]
    kept = F.slice(F.filter(F.array(*lines), lambda x: x.isNotNull()), 1, LINES)
    return rows.select(F.posexplode(kept).alias("at", "line")).select((F.col("at") + 1).alias("place"), "line")


# ---- the thesis

# What a gap says, and what to do, by its sign.
GAP_TEXTS = (
    ("VIX vs HY OAS", "VIX pricing more stress than credit", "Reduce equity risk", "Credit widening without VIX spike", "HYG weakness = quiet stress. Add TLT hedge."),
    ("Curve vs IWM/SPY", "Curve steepening but small caps lagging", "Long IWM, curve is the leading signal", "Small caps outrunning curve signal", "Fade IWM without curve confirmation"),
    ("GLD vs Real rates", "GLD elevated vs real rate signal", "Take GLD profits or hedge", "GLD cheap vs falling real rates", "Accumulate GLD"),
    ("HYG vs Equity breadth", "Credit deteriorating while equity breadth healthy. Credit leads by 4-8 weeks.", "Reduce equity beta. Credit signal is more reliable.", "", ""),
)
OPENINGS = (
    (75, "Macro conditions are firmly risk-on at %d/100, %s."), (60, "The macro regime sits in bullish territory at %d/100, %s."), (40, "Macro conditions are neutral at %d/100, %s."),
    (25, "The macro regime is deteriorating at %d/100, %s."), (None, "Macro conditions are in risk-off territory at %d/100, %s."),
)
_WANTED = ("regime_current", "regime_components", "divergences", "brief_factors", "content_context")
_GAPS_SQL = ", ".join(str(x) for x in GAP_TEXTS)


@query(
    "with "
    + ", ".join(f"{n} as ({ORACLE[n]})" for n in _WANTED)
    + f""", told (name, up, up_trade, down, down_trade) as (values {_GAPS_SQL}),
    opening as (
        select printf(case when score >= 75 then '{OPENINGS[0][1]}' when score >= 60 then '{OPENINGS[1][1]}' when score >= 40 then '{OPENINGS[2][1]}' when score >= 25 then '{OPENINGS[3][1]}' else '{OPENINGS[4][1]}' end,
            score, case momentum when 'Improving' then 'with momentum improving' else 'with momentum deteriorating' end)
            || case when score_delta > 0 then printf(' The score has gained %d points over the past 21 days.', score_delta) when score_delta < 0 then printf(' The score has lost %d points over the past 21 days.', -score_delta) else '' end as line
        from regime_current
    ),
    drivers as (
        select (select printf('%s is the dominant driver, %s%s the score (z %+.2f).', name, case when abs(coalesce(zscore, 0)) > 1.5 then 'sharply ' else '' end, case when contribution > 0 then 'supporting' else 'dragging on' end, round(coalesce(zscore, 0), 2)) from regime_components where place = 1)
            || coalesce((select printf(' %s is adding to the %s (z %+.2f).', name, case when contribution > 0 then 'tailwind' else 'headwind' end, round(coalesce(zscore, 0), 2)) from regime_components where place = 2), '') as line
    ),
    reads as (
        select 'Key reads: ' || concat_ws('; ',
            case when real is not null then printf('real yields at %.2f%% (%s)', round(real, 2), case when real > 1.5 then 'restrictive' when real > 0.8 then 'tightening' else 'accommodative' end) end,
            case when credit is not null and credit_z is not null then printf('HY OAS at %.2f%% (%s)', round(credit, 2), case when credit_z > 1 then 'stressed' when credit_z > 0.3 then 'elevated' else 'contained' end) end,
            case when curve is not null then printf('curve %s at %+.2fpp', case when curve > 0.5 then 'steep' when curve > 0 then 'flat' else 'inverted' end, round(curve, 2))
                || case when curve_month < -0.05 then printf(', bear flattening %+.2fpp 1m', round(curve_month, 2)) when curve_month > 0.05 then printf(', steepening %+.2fpp 1m', round(curve_month, 2)) else '' end end) || '.' as line
        from content_context where coalesce(real, case when credit_z is not null then credit end, curve) is not null
    ),
    gap as (
        select printf('Primary divergence: %s (%s, delta-z %+.2f) - %s.', case when gap > 0 then up else down end, name, round(gap, 2), case when gap > 0 then up_trade else down_trade end) as line
        from divergences join told using (name) where place = 1
    ),
    factor as (select printf('Factor rotation favours %s over %s (score %+.2f, proxy: %s).', winner, loser, round(score, 2), funds) as line from brief_factors where place = 1 and abs(score) >= 0.4),
    ahead as (
        select case when degrade > 0.35 then printf('Regime transition risk is elevated: Markov model assigns %.0f%% probability of moving to a worse regime in the next 4 weeks. Size positions accordingly.', round_even(degrade * 100, 0))
            when improve > 0.30 then printf('Conditions may be improving: %.0f%% probability of regime upgrade in the next 4 weeks per the Markov model.', round_even(improve * 100, 0))
            else printf('Regime stability: %.0f%% probability of remaining in %s next week per the Markov transition model.', round_even(stay * 100, 0), label) end as line
        from content_context where degrade is not null and improve is not null
    )
    select 1 as nth, line from opening union all select 2, line from drivers where line is not null union all select 3, line from reads union all select 4, line from gap union all select 5, line from factor union all select 6, line from ahead"""
)
def thesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case in sentences: opening, drivers, key reads, widest gap, leading factor, chances of a change."""
    return sentences(*(QUERIES[n](spark, sf_dir) for n in _WANTED))


def sentences(now: DataFrame, parts: DataFrame, gaps: DataFrame, factors: DataFrame, context: DataFrame) -> DataFrame:
    """(nth, line) of the sentences that have something to say; every table has one row, or a row a place."""
    c = F.col

    def line(rows: DataFrame, nth: int, text: Column) -> DataFrame:
        return rows.select(F.lit(nth).alias("nth"), text.alias("line")).where("line is not null")

    def signed(text: str, *args: Column | str) -> Column:
        return F.format_string(text, *(F.round(a, 2) if isinstance(a, str) and a in digits else (c(a) if isinstance(a, str) else a) for a in args))

    digits = ("zscore", "gap", "score", "real", "credit", "curve", "curve_month")
    mood = F.when(c("momentum") == "Improving", "with momentum improving").otherwise("with momentum deteriorating")
    opening = F.coalesce(*(F.when(c("score") >= least, F.format_string(text, "score", mood)) for least, text in OPENINGS if least), F.format_string(OPENINGS[-1][1], "score", mood))
    moved = F.when(c("score_delta") != 0, F.format_string(" The score has %s %d points over the past 21 days.", F.when(c("score_delta") > 0, "gained").otherwise("lost"), F.abs("score_delta"))).otherwise("")

    known = parts.withColumn("zscore", F.coalesce("zscore", F.lit(0.0)))
    first = signed("%s is the dominant driver, %s%s the score (z %+.2f).", "name", F.when(F.abs("zscore") > 1.5, "sharply ").otherwise(""), F.when(c("contribution") > 0, "supporting").otherwise("dragging on"), "zscore")
    second = signed(" %s is adding to the %s (z %+.2f).", "name", F.when(c("contribution") > 0, "tailwind").otherwise("headwind"), "zscore")
    both = known.agg(F.max(F.when(c("place") == 1, first)).alias("one"), F.max(F.when(c("place") == 2, second)).alias("two"))

    real = F.when(c("real").isNotNull(), signed("real yields at %.2f%% (%s)", "real", F.when(c("real") > 1.5, "restrictive").when(c("real") > 0.8, "tightening").otherwise("accommodative")))
    stressed = F.when(c("credit_z") > 1, "stressed").when(c("credit_z") > 0.3, "elevated").otherwise("contained")
    credit = F.when(c("credit").isNotNull() & c("credit_z").isNotNull(), signed("HY OAS at %.2f%% (%s)", "credit", stressed))
    motion = F.when(c("curve_month") < -0.05, signed(", bear flattening %+.2fpp 1m", "curve_month")).when(c("curve_month") > 0.05, signed(", steepening %+.2fpp 1m", "curve_month")).otherwise("")
    curve = F.when(c("curve").isNotNull(), F.concat(signed("curve %s at %+.2fpp", F.when(c("curve") > 0.5, "steep").when(c("curve") > 0, "flat").otherwise("inverted"), "curve"), motion))
    reads = F.concat_ws("; ", real, credit, curve)

    texts = gaps.sparkSession.createDataFrame(GAP_TEXTS, "name string, up string, up_trade string, down string, down_trade string")
    wide = gaps.where("place = 1").join(F.broadcast(texts), "name")
    up = c("gap") > 0
    gap = signed("Primary divergence: %s (%s, delta-z %+.2f) - %s.", F.when(up, c("up")).otherwise(c("down")), "name", "gap", F.when(up, c("up_trade")).otherwise(c("down_trade")))
    factor = signed("Factor rotation favours %s over %s (score %+.2f, proxy: %s).", "winner", "loser", "score", "funds")

    def percent(x: str) -> Column:
        return F.bround(c(x) * 100, 0)

    worse = F.format_string("Regime transition risk is elevated: Markov model assigns %.0f%% probability of moving to a worse regime in the next 4 weeks. Size positions accordingly.", percent("degrade"))
    better = F.format_string("Conditions may be improving: %.0f%% probability of regime upgrade in the next 4 weeks per the Markov model.", percent("improve"))
    same = F.format_string("Regime stability: %.0f%% probability of remaining in %s next week per the Markov transition model.", percent("stay"), "label")
    ahead = F.when(c("degrade").isNotNull() & c("improve").isNotNull(), F.when(c("degrade") > 0.35, worse).when(c("improve") > 0.30, better).otherwise(same))

    told = [
        line(now, 1, F.concat(opening, moved)), line(both, 2, F.concat(c("one"), F.coalesce("two", F.lit("")))), line(context, 3, F.when(reads != "", F.concat(F.lit("Key reads: "), reads, F.lit(".")))),
        line(wide, 4, gap), line(factors.where("place = 1 and abs(score) >= 0.4"), 5, factor), line(context, 6, ahead),
    ]
    out = told[0]
    for more in told[1:]:
        out = out.unionByName(more)
    return out
