"""What pages say about assets, pairs and components, from tables of rules, and views of single pairs and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import contribution
from ..operators import joins, points, texts, windows
from ..sources import tables
from .base_sql import DAY, SER, r, with_
from . import outlook_queries
from .market_queries import ASSET_SQL
from .model_queries import LABEL_SQL, PAIR_SQL, penalties, scored_pairs, weekly_pairs
from .rule_queries import roles
from .series_queries import day, query, six
from .state_queries import ALL, BASE, FORWARD, ORACLE, QUERIES, RENAMED_HISTORY, STATE_BASE, all_series, current_all, labelled_returns, snapshot_all, state

def settled(x: str, digits: int) -> Column:
    """A double rounded as a decimal, so that its last bits don't decide a tie."""
    return F.round(F.col(x).cast("decimal(28,12)"), digits).cast("double")


_UP, _MID, _DOWN = "#4aba6e", "#f79400", "#e84040"
# The verdict of a card by the asset's alignment.
VERDICTS: tuple[texts.Rule, ...] = (
    ("verdict", 1, "score", 65, None, "MACRO ALIGNED: regime and macro both support this trade", _UP, None, None, 1.0),
    ("verdict", 2, "score", 55, None, "MILD TAILWIND: more signals in favour than against", _UP, None, None, 1.0),
    ("verdict", 3, "score", 45, None, "SIGNALS MIXED: {} confirm, no clear edge", _MID, "n_confirm", "%.0f", 1.0),
    ("verdict", 4, "score", 33, None, "MILD HEADWIND: more macro signals working against than for", _MID, None, None, 1.0),
    ("verdict", 5, "score", None, None, "MACRO AGAINST: {} signals point against this trade", _DOWN, "n_against", "%.0f", 1.0),
)


def _steps(topic: str, reading: str, steps: tuple[tuple[float | None, str], ...], format_: str, scale: float = 1.0) -> tuple[texts.Rule, ...]:
    """Rules of one row of a card: the colour by the reading, from the highest bound down."""
    return tuple((topic, i, reading, low, None, "{}", colour, reading, format_, scale) for i, (low, colour) in enumerate(steps, 1))


#: A strict bound as one that counts: the next number above.
_ABOVE = 5e-324
CARD_ROWS: tuple[texts.Rule, ...] = (
    *_steps("PRICE", "price", ((None, "#f0f0f0"),), "$%,.2f"),
    *_steps("1W RTN", "ret_1w", ((_ABOVE, _UP), (None, _DOWN)), "%+.1f%%", 100),
    *_steps("1M RTN", "ret_1m", ((_ABOVE, _UP), (None, _DOWN)), "%+.1f%%", 100),
    *_steps("VS 200D MA", "ma200_pct", ((_ABOVE, _UP), (None, _DOWN)), "%+.1f%%"),
    *_steps("REAL YIELD", "real", ((1.5000000000000002, _DOWN), (0.5, _MID), (None, _UP)), "%.2f%%"),
    *_steps("HY OAS", "credit", ((4.500000000000001, _DOWN), (3.5, _MID), (None, _UP)), "%.2f%%"),
    *_steps("CURVE 2S10S", "curve", ((0.5000000000000001, _UP), (0.0, _MID), (None, _DOWN)), "%+.2fpp"),
    *_steps("DOLLAR Z", "dollar_z", ((0.5000000000000001, _DOWN), (-0.5, _MID), (None, _UP)), "%+.2f"),
    *_steps("FED BS 13W", "fed_growth", ((_ABOVE, _UP), (None, _DOWN)), "%+.1f%%", 100),
)
#: Rows that a few assets have.
ONLY = {"DOLLAR Z": ("GLD", "BTC", "SLV"), "FED BS 13W": ("BTC",)}
_CARD_STATE = ("real", "credit", "curve", "dollar_z", "fed_growth")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per asset with all readings of its card."""
    details = QUERIES["asset_details"](spark, sf_dir).select("series", settled("price", 2).alias("price"), "ret_1w", "ret_1m", "ma200_pct", F.col("alignment").alias("score"), "n_confirm", "n_against")
    return details.join(F.broadcast(state(spark, sf_dir).select(*_CARD_STATE)))  # one row of state


_CARD_SQL = with_(
    *ASSET_SQL,
    "card as (select series, round(price, 4) as price, round(price / p7 - 1, 5) as ret_1w, round(price / p30 - 1, 5) as ret_1m, round((price / m200 - 1) * 100, 2) as ma200_pct, alignment, n_confirm, n_against, st.real, st.credit, st.curve, st.dollar_z, st.fed_growth from aligned cross join st)",
)


@query(
    _CARD_SQL
    + f"""select series, case when alignment >= 65 then 'MACRO ALIGNED: regime and macro both support this trade' when alignment >= 55 then 'MILD TAILWIND: more signals in favour than against'
        when alignment >= 45 then printf('SIGNALS MIXED: %d confirm, no clear edge', n_confirm) when alignment >= 33 then 'MILD HEADWIND: more macro signals working against than for' else printf('MACRO AGAINST: %d signals point against this trade', n_against) end as verdict,
        case when alignment >= 55 then '{_UP}' when alignment >= 33 then '{_MID}' else '{_DOWN}' end as colour from card"""
)
def macro_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every tracked asset's card."""
    found = texts.readings(cards(spark, sf_dir), ["series"], ["score", "n_confirm", "n_against"])
    return texts.told(found, texts.table(spark, VERDICTS), ["series"]).select("series", F.col("text").alias("verdict"), "colour")


def _sign_colour(x: str) -> str:
    return f"case when {x} > 0 then '{_UP}' else '{_DOWN}' end"


@query(
    _CARD_SQL
    + f"""select * from (
        select series, 'PRICE' as label, format('${{:,.2f}}', round(cast(price as decimal(28, 12)), 2)::double) as value, '#f0f0f0' as colour from card where price is not null
        union all select series, '1W RTN', printf('%+.1f%%', ret_1w * 100), {_sign_colour('ret_1w')} from card where ret_1w is not null
        union all select series, '1M RTN', printf('%+.1f%%', ret_1m * 100), {_sign_colour('ret_1m')} from card where ret_1m is not null
        union all select series, 'VS 200D MA', printf('%+.1f%%', ma200_pct), {_sign_colour('ma200_pct')} from card where ma200_pct is not null
        union all select series, 'REAL YIELD', printf('%.2f%%', real), case when real > 1.5 then '{_DOWN}' when real < 0.5 then '{_UP}' else '{_MID}' end from card where real is not null
        union all select series, 'HY OAS', printf('%.2f%%', credit), case when credit > 4.5 then '{_DOWN}' when credit < 3.5 then '{_UP}' else '{_MID}' end from card where credit is not null
        union all select series, 'CURVE 2S10S', printf('%+.2fpp', curve), case when curve > 0.5 then '{_UP}' when curve < 0 then '{_DOWN}' else '{_MID}' end from card where curve is not null
        union all select series, 'DOLLAR Z', printf('%+.2f', dollar_z), case when dollar_z < -0.5 then '{_UP}' when dollar_z > 0.5 then '{_DOWN}' else '{_MID}' end from card where dollar_z is not null and series in ('GLD', 'BTC', 'SLV')
        union all select series, 'FED BS 13W', printf('%+.1f%%', fed_growth * 100), {_sign_colour('fed_growth')} from card where fed_growth is not null and series = 'BTC')"""
)
def macro_card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of numbers of every tracked asset's card, each with its colour."""
    found = texts.readings(cards(spark, sf_dir), ["series"], ["price", "ret_1w", "ret_1m", "ma200_pct", *_CARD_STATE])
    got = texts.told(found, texts.table(spark, CARD_ROWS), ["series"])
    for label, assets in ONLY.items():
        got = got.where((F.col("topic") != label) | F.col("series").isin(*assets))
    return got.select("series", F.col("topic").alias("label"), F.col("text").alias("value"), "colour")


@query(
    with_(*STATE_BASE, *RENAMED_HISTORY, *(x.replace("from sc", "from h_sc") for x in FORWARD), f"nw as (select {LABEL_SQL} as label from sc where d = 'now')")
    + f"""select series, n, case when n < 8 then 'insufficient history' else printf('%.0f%% win rate in %s regimes, median %+.1f%%, n=%d', round_even(rate * 100, 0), label, round(middle * 100, 1) + 0.0, n) end as text,
        case when n < 8 then '#555' when rate >= 0.58 then '{_UP}' when rate < 0.45 then '{_DOWN}' else '{_MID}' end as colour
    from (select lr.series, lr.label, count(*) as n, avg(case when fwd > 0 then 1.0 else 0.0 end) as rate, median(fwd) as middle from lr join nw on lr.label = nw.label group by 1, 2)"""
)
def card_win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the asset rose in the four weeks after a week of the present label, with the median, from eight weeks on."""
    now = snapshot_all(spark, sf_dir).where("d = 'now'").select("label")
    rows = labelled_returns(spark, sf_dir).where("fwd is not null").join(F.broadcast(now), "label").groupBy("series", "label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("fwd") > 0).cast("double")).alias("rate"), F.median("fwd").alias("middle"))
    enough = F.col("n") >= 8
    text = F.format_string("%.0f%% win rate in %s regimes, median %+.1f%%, n=%d", F.bround(F.col("rate") * 100), "label", F.round(F.col("middle") * 100, 1), "n")
    colour = F.when(~enough, "#555").when(F.col("rate") >= 0.58, _UP).when(F.col("rate") < 0.45, _DOWN).otherwise(_MID)
    return rows.select("series", "n", F.when(enough, text).otherwise("insufficient history").alias("text"), colour.alias("colour"))


# ---- pairs

# What the table of pairs says as a whole, by how many pairs are flagged and how many strong.
PAIR_CONTEXT: tuple[texts.Rule, ...] = (
    ("context", 1, "flagged", 5, None, "{} pairs are showing anomalous correlation regimes: consider smaller positions on them.", "#d97706", "flagged", "%.0f", 1.0),
    ("context", 2, "strong", 6, None, "{} strong pair signals: above average rotation opportunity.", "#1f7a4f", "strong", "%.0f", 1.0),
    ("context", 3, "pairs", None, None, "Pair signals interpret relative momentum between assets in the basket.", "#6b7280", None, None, 1.0),
)


@query(
    with_(*PAIR_SQL, "nn as (select (select count(*) from pf where flag and (a, b) in (select (a, b) from sc)) as flagged, (select count(*) from sc where abs(score) >= 65) as strong)")
    + """select flagged, strong, case when flagged > 4 then printf('%d pairs are showing anomalous correlation regimes: consider smaller positions on them.', flagged)
        when strong >= 6 then printf('%d strong pair signals: above average rotation opportunity.', strong) else 'Pair signals interpret relative momentum between assets in the basket.' end as text,
        case when flagged > 4 then '#d97706' when strong >= 6 then '#1f7a4f' else '#6b7280' end as colour from nn"""
)
def pair_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scores of all pairs say together."""
    flags = penalties(weekly_pairs(spark, sf_dir)).select("a", "b", "flag")
    rows = scored_pairs(spark, sf_dir).join(flags, ["a", "b"], "left")
    counts = rows.agg(F.coalesce(F.sum(F.col("flag").cast("int")), F.lit(0)).alias("flagged"), F.coalesce(F.sum((F.abs("score") >= 65).cast("int")), F.lit(0)).alias("strong"), F.count(F.lit(1)).alias("pairs")).withColumn("one", F.lit(1))
    told = texts.told(texts.readings(counts, ["one"], ["flagged", "strong", "pairs"]), texts.table(spark, PAIR_CONTEXT), ["one"])
    return counts.join(F.broadcast(told), "one").select("flagged", "strong", "text", "colour")


EXPLORED = {"1w": 7, "1m": 35, "3m": 110, "6m": 185, "5y": 2000}


@query(
    with_(
        SER, "pair as (select a.d, a.v / b.v as v from ser a join ser b on a.d = b.d and a.series = '1-URGENT' and b.series = '2-HIGH')", "late as (select * from pair where d >= (select max(d) from pair) - 110)",
        "seen as (select *, row_number() over (order by d) as nth, avg(v) over (order by d rows between 62 preceding and current row) as mean, min(v) over () as low, max(v) over () as high from late)",
    )
    + f"select {DAY}, {r('v')} as v, {r('case when nth >= 10 then mean end')} as mean, {r('low - greatest((high - low) * 0.12, high * 0.01)')} as low, {r('high + greatest((high - low) * 0.12, high * 0.01)')} as high from seen"
)
def pair_explorer(spark: SparkSession, sf_dir: str, a: str = "1-URGENT", b: str = "2-HIGH", range_: str = "3m") -> DataFrame:
    """The ratio of two series over a range of days with its mean of 63 rows (from ten on) and the padded range of its axis."""
    rows = joins.combined(tables.orders(spark, sf_dir), [a, b], F.try_divide("x0", "x1")).withColumn("series", F.lit("pair"))
    late = points.since(rows, EXPLORED[range_])
    whole = Window.partitionBy("series")
    low, high = F.min("v").over(whole), F.max("v").over(whole)
    pad = F.greatest((high - low) * 0.12, high * 0.01)
    return late.select(day(), six("v", "v"), six(windows.rolling_mean(F.col("v"), 63, 10), "mean"), six(low - pad, "low"), six(high + pad, "high"))


# ---- components

@query(
    f"""select key, case when contribution > 0 then '#1f7a4f' else '#b42318' end as colour, printf('%s contributing %+.3f to the score (z %+.2f).', name, round(contribution, 3), round(zscore, 2)) as text
    from ({ORACLE['regime_components']}) where weight <> 0 and zscore is not null"""
)
def component_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for every component that has a weight and a z-score; those without a weight are names for the same readings."""
    parts = QUERIES["regime_components"](spark, sf_dir).where("weight <> 0 and zscore is not null")
    share = contribution(F.col("contribution"), F.col("zscore"), F.col("weight"))
    text = F.format_string("%s contributing %+.3f to the score (z %+.2f).", "name", F.round(share, 3), F.round("zscore", 2))
    return parts.select("key", F.when(share > 0, "#1f7a4f").otherwise("#b42318").alias("colour"), text.alias("text"))


BULLETS = (("Credit spreads (HY OAS)", "hy_oas", True), ("Curve (10y - 2y)", "curve2", False), ("Real 10y yield", "real10", True), ("Dollar broad", "dollar_broad", True))


@query(
    with_(*BASE, "b (nth, name, series, inverse) as (values " + ", ".join(f"({i}, '{n}', '{s}', {str(v).lower()})" for i, (n, s, v) in enumerate(BULLETS, 1)) + ")", "tip as (select series, max(d) as newest, arg_max(v, d) as last from every group by series)")
    + f"select b.nth, b.name, {r('any_value(t.last)')} as last, {r('arg_max(e.v, e.d)')} as before, {r('any_value(t.last) - arg_max(e.v, e.d)')} as change, b.inverse from b join tip t using (series) join every e on e.series = b.series and e.d <= t.newest - 7 group by b.nth, b.name, b.inverse"
)
def weekly_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, level a week before and change of credit, curve, real yields and dollar, and whether a rise is bad."""
    names = spark.createDataFrame([(i, *b) for i, b in enumerate(BULLETS, 1)], "nth int, name string, series string, inverse boolean")
    got = points.back(all_series(spark, sf_dir).where(F.col("series").isin(*(s for _, s, _ in BULLETS))), 7)
    rows = got.join(F.broadcast(names), "series").where("before is not null")
    return rows.select("nth", "name", six("last", "last"), six("before", "before"), six("delta", "change"), "inverse")


@query(f"select score, label, confidence, summary from ({ORACLE['regime_current']})")
def regime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, label, confidence and summary, as older callers read them."""
    return QUERIES["regime_current"](spark, sf_dir).select("score", "label", "confidence", "summary")


# ---- series of single pages

LEAST_FORWARD = 10


@query(
    with_(
        *BASE, "nom as (select a.d, 2 * a.v - b.v as v, count(*) over () as n from role a join role b on a.d = b.d and a.series = 'y10' and b.series = 'y5')", "rea as (select a.d, 2 * a.v - b.v as v, count(*) over () as n from role a join role b on a.d = b.d and a.series = 'real10' and b.series = 'real5')",
        "nom2 as (select * from nom where n > 10)", "rea2 as (select * from rea where n > 10)", "inf as (select d, v from (select a.d, a.v - b.v as v, count(*) over () as n from nom2 a join rea2 b on a.d = b.d) where n > 10)",
    )
    + f"select kind, {DAY}, round(cast(v as decimal(28, 12)), 6)::double as v from (select 'nominal' as kind, d, v from nom2 union all select 'real', d, v from rea2 union all select 'implied', d, v from inf union all select 'shown', d, v from inf union all select 'shown', d, v from nom2 where not exists (select 1 from inf))"
)
def forward_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-year rates in five years: nominal, real, implied inflation, each from more than ten common dates; 'shown' is the implied one, else the nominal."""
    return forwards(roles(spark, sf_dir, ALL)).select("kind", day(), settled("v", 6).alias("v"))


def forwards(rows: DataFrame) -> DataFrame:
    """(kind, d, v) from the roles y10, y5, real10 and real5."""
    legs = ("y10", "y5", "real10", "real5")
    wide = rows.where(F.col("series").isin(*legs)).groupBy("d").agg(*(F.max(F.when(F.col("series") == x, F.col("v"))).alias(x) for x in legs))
    nominal, real = 2 * F.col("y10") - F.col("y5"), 2 * F.col("real10") - F.col("real5")
    wide = wide.select("d", nominal.alias("nominal"), real.alias("real"), (nominal - real).alias("implied"))
    counts = wide.agg(*(F.count(c).alias(f"n_{c}") for c in ("nominal", "real", "implied")))
    met = wide.join(F.broadcast(counts))  # one row of counts

    def guarded(c: str, *needed: str) -> Column:
        enough = F.lit(True)
        for n in (c, *needed):
            enough = enough & (F.col(f"n_{n}") > LEAST_FORWARD)
        return F.when(enough, F.col(c))

    implied_there = F.least("n_nominal", "n_real", "n_implied") > LEAST_FORWARD
    implied = guarded("implied", "nominal", "real")
    shown = F.when(implied_there, implied).otherwise(guarded("nominal"))
    cells = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in (("nominal", guarded("nominal")), ("real", guarded("real")), ("implied", implied), ("shown", shown))))
    return met.select("d", F.explode(cells).alias("x")).select("x.kind", "d", "x.v").where("v is not null")


@query(with_(SER, "p as (select series, d, (v / first_value(v) over (partition by series order by d) - 1) * 100 as v from ser)") + f"select series, {DAY}, {r('v', 4)} as v from p")
def rebased_to_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series in percent above its first value."""
    return tables.orders(spark, sf_dir).select("series", day(), six(windows.rebased(F.col("v")) - 100, "v", 4))


@query(
    with_(*BASE, "ret as (select d, v / lag(v) over (order by d) - 1 as x from role where series = 'SPY')", "vol as (select d, case when count(x) over w = 21 then stddev_samp(x) over w * sqrt(252.0) * 100 end as realised from ret where x is not null window w as (order by d rows between 20 preceding and current row))")
    + f"select cast(a.d as varchar) as d, {r('b.v', 4)} as implied, {r('realised', 4)} as realised, {r('realised - b.v', 4)} as gap from vol a join role b on b.d = a.d and b.series = 'VIX' where realised is not null"
)
def realised_against_implied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly volatility of 21 share returns beside the implied one on common dates."""
    rows = roles(spark, sf_dir, ALL)
    returns = rows.where("series = 'SPY'").withColumn("v", windows.pct_change(F.col("v"), 1)).where("v is not null")
    realised = returns.select("d", (windows.rolling_std(F.col("v"), 21) * 252**0.5 * 100).alias("realised")).where("realised is not null")
    both = realised.join(joins.named(rows, "VIX", "implied"), "d")
    return both.select(day(), six("implied", "implied", 4), six("realised", "realised", 4), six(F.col("realised") - F.col("implied"), "gap", 4))


@query(with_(*BASE) + f"select cast(a.d as varchar) as d, {r('a.v', 4)} as vix, {r('b.v', 4)} as spread from role a join role b on a.d = b.d and a.series = 'VIX' and b.series = 'hy_oas'")
def volatility_and_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility and credit spread on the dates that both have."""
    rows = roles(spark, sf_dir, ALL)
    return joins.named(rows, "VIX", "vix").join(joins.named(rows, "hy_oas", "spread"), "d").select(day(), six("vix", "vix", 4), six("spread", "spread", 4))


_FED = "(select v, row_number() over (order by d desc) as rn, count(*) over () as n from role where series = 'fed_assets')"


@query(
    with_(
        *STATE_BASE, f"x as (select max(v) filter (where rn = 1) as fed, max(v) filter (where rn = 1 and n >= 70) / max(v) filter (where rn = 64) * 100 - 100 as fed_13w from {_FED})",
        "y as (select max(v) filter (where series = 'dollar_broad') as dollar, max(d30) filter (where series = 'dollar_broad') as dollar_1m, max(d30) filter (where series = 'real10') as real_1m from cur)",
    )
    + f"""select cc.signal, rc.label, rc.score, round(rc.score_raw, 1) + 0.0 as score_raw, rc.confidence, rc.momentum, rc.score_delta, cc.previous,
        {r('cc.curve', 2)} as curve_2_10, {r('cc.c3m', 2)} as curve_3m10, {r('cc.curve_month', 2)} as curve_1m_chg, {r('cc.real', 2)} as real_yield, {r('y.real_1m', 2)} as real_1m_chg, {r('cc.credit', 2)} as hy_oas, {r('cc.credit_week', 2)} as hy_7d_chg, {r('cc.credit_z', 2)} as hy_zscore,
        {r('y.dollar', 1)} as dollar, {r('y.dollar_1m', 1)} as dollar_1m, {r('cc.cpi_yoy', 1)} as cpi_yoy, {r('x.fed / 1e6', 2)} as fed_assets_t, {r('x.fed_13w', 1)} as fed_13w_pct,
        {r('cc.vix', 1)} as vix, {r('cc.vix3m', 1)} as vix3m, {r('cc.vratio', 3)} as vratio, {r('cc.vix_pct', 0)} as vix_pct, {r('cc.small_z', 2)} as iwm_spy_z, {r('cc.stay', 2)} as stay, {r('cc.degrade', 2)} as degrade, {r('cc.improve', 2)} as improve
    from ({outlook_queries.ORACLE['content_context']}) cc cross join ({ORACLE['regime_current']}) rc cross join x cross join y"""
)
def note_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: all numbers that a note is written from, rounded as they are shown."""
    rn = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("d")))
    fed = roles(spark, sf_dir, ALL).where("series = 'fed_assets'").withColumn("rn", rn)

    def at(k: int) -> Column:
        return F.max(F.when(F.col("rn") == k, F.col("v")))

    fed = fed.agg(at(1).alias("fed"), F.when(F.count(F.lit(1)) >= 70, (F.try_divide(at(1), at(64)) - 1) * 100).alias("fed_13w"))
    stats = current_all(spark, sf_dir).agg(
        *(F.max(F.when(F.col("series") == s, F.col(c))).alias(n) for n, s, c in (("dollar", "dollar_broad", "v"), ("dollar_1m", "dollar_broad", "d30"), ("real_1m", "real10", "d30"))),
    )
    now = QUERIES["regime_current"](spark, sf_dir).select("confidence", "momentum", "score_raw")
    row = QUERIES["content_context"](spark, sf_dir).join(F.broadcast(now)).join(F.broadcast(fed)).join(F.broadcast(stats))  # one row each
    shown = (
        ("curve", 2, "curve_2_10"), ("c3m", 2, "curve_3m10"), ("curve_month", 2, "curve_1m_chg"), ("real", 2, "real_yield"), ("real_1m", 2, "real_1m_chg"), ("credit", 2, "hy_oas"), ("credit_week", 2, "hy_7d_chg"), ("credit_z", 2, "hy_zscore"),
        ("dollar", 1, "dollar"), ("dollar_1m", 1, "dollar_1m"), ("cpi_yoy", 1, "cpi_yoy"), ("fed_13w", 1, "fed_13w_pct"), ("vix", 1, "vix"), ("vix3m", 1, "vix3m"), ("vratio", 3, "vratio"), ("vix_pct", 0, "vix_pct"),
        ("small_z", 2, "iwm_spy_z"), ("stay", 2, "stay"), ("degrade", 2, "degrade"), ("improve", 2, "improve"),
    )
    return row.select("signal", "label", "score", six("score_raw", "score_raw", 1), "confidence", "momentum", "score_delta", "previous", six(F.col("fed") / 1e6, "fed_assets_t", 2), *(six(c, n, k) for c, k, n in shown))


@query(
    with_(
        *BASE, "f as (select d, v, count(*) over () as n, row_number() over w as nth, lag(v, 63) over w as a, lag(v, 126) over w as b, avg(v) over y as m, stddev_samp(v) over y as s from role where series = 'fed_assets' window w as (order by d), y as (order by d rows between 251 preceding and current row))",
    )
    + f"select {DAY}, {r('case when n >= 70 then (v / a - 1) * 100 end')} as roc13, {r('case when n >= 130 then (v / b - 1) * 100 end')} as roc26, {r('case when n >= 60 and nth >= 60 then (v - m) / nullif(s, 0) end')} as z from f"
)
def central_bank_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of the central bank's assets over 63 and 126 rows in percent, and their z-score of 252 rows from 60 on."""
    rows = roles(spark, sf_dir, ALL).where("series = 'fed_assets'")
    v, n = F.col("v"), F.count(F.lit(1)).over(Window.partitionBy("series"))
    sd = F.nullif(windows.rolling_std(v, 252, 60), F.lit(0.0))
    return rows.select(
        day(), six(F.when(n >= 70, windows.pct_change(v, 63) * 100), "roc13"), six(F.when(n >= 130, windows.pct_change(v, 126) * 100), "roc26"),
        six(F.when(n >= 60, (v - windows.rolling_mean(v, 252, 60)) / sd), "z"),
    )


__all__ = ["ORACLE", "QUERIES"]
