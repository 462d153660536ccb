"""Assets in detail, heat-maps, bands of the regime under prices, driver cards, layouts, revisions and JSON, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals, points, rules
from ..sources import layouts, revisions, tables
from ..sources.once import shared_dir
from .base_sql import DAY, SER, r, with_
from .model_queries import score_history
from .rule_queries import roles
from .series_queries import day, query, six
from .state_queries import ALL, BASE, HISTORY_ALL, ORACLE, QUERIES, STATE_BASE, all_series, current_all, state

# Tracked assets with name and colour, and those that gain when the others lose.
WATCH = (
    ("SPY", "S&P 500", "#1d4ed8"), ("QQQ", "Nasdaq 100", "#7c3aed"), ("GLD", "Gold", "#d97706"), ("BTC", "Bitcoin", "#f59e0b"), ("SLV", "Silver", "#94a3b8"),
    ("TLT", "Long Bond", "#0ea5e9"), ("HYG", "High Yield", "#a855f7"), ("XLU", "Utilities", "#0d9488"), ("XLC", "Comms/Media", "#c026d3"),
)
SAFE = ("TLT", "GLD", "SLV", "XLU")
_WATCH = ", ".join(str(x) for x in WATCH)

ASSET_SQL = (
    *STATE_BASE,
    f"watch (series, name, colour) as (values {_WATCH})",
    """px as (
        select series, max(v) filter (where rn = 1) as price, max(v) filter (where rn = 8) as p7, max(v) filter (where rn = 31) as p30, max(v) filter (where rn = 64) as p63,
            case when count(*) >= 100 then avg(v) filter (where rn <= 200) end as m200
        from (select series, v, row_number() over (partition by series order by d desc) as rn from role) group by series
    )""",
    "credit as (select z as credit_z from cur where series = 'hy_oas')",
    f"facing as (select w.*, px.* exclude (series), st.score as regime, st.score_before, credit.credit_z, real, case when w.series in {SAFE} then -1 else 1 end as side from watch w left join px using (series) cross join st cross join credit)",
    """votes as (
        select *,
            case when regime > 55 then side when regime < 45 then -side else 0 end as by_regime, case when credit_z > 0.5 then -side when credit_z < -0.5 then side else 0 end as by_credit,
            case when real > 1.5 then -side when real < 0.5 then side else 0 end as by_real, case when m200 is null then 0 when price > m200 then 1 else -1 end as by_mean
        from facing
    )""",
    """summed as (
        select *, (by_regime > 0)::int + (by_credit > 0)::int + (by_real > 0)::int + (by_mean > 0)::int as n_confirm, (by_regime < 0)::int + (by_credit < 0)::int + (by_real < 0)::int + (by_mean < 0)::int as n_against
        from votes
    )""",
    "aligned as (select *, trunc(greatest(15, least(85, 50 + coalesce((n_confirm - n_against) / nullif(n_confirm + n_against, 0), 0) * 35)))::bigint as alignment from summed)",
)


@query(
    with_(*ASSET_SQL)
    + f"""select series, name, colour, {r('price', 4)} as price, {r('price / p7 - 1', 5)} as ret_1w, {r('price / p30 - 1', 5)} as ret_1m, {r('price / p63 - 1', 5)} as ret_3m, {r('(price / m200 - 1) * 100', 2)} as ma200_pct,
        alignment, n_confirm, n_against,
        case when alignment >= 65 then 'BULLISH' when alignment >= 55 then 'MILD TAILWIND' when alignment >= 45 then 'NEUTRAL' when alignment >= 33 then 'MILD HEADWIND' else 'BEARISH' end as label,
        case when alignment >= 65 then '#16a34a' when alignment >= 55 then '#22c55e' when alignment >= 45 then '#6b7280' when alignment >= 33 then '#d97706' else '#ef4444' end as label_colour,
        regime, regime - score_before as regime_delta
    from aligned"""
)
def asset_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price, returns of 7, 30 and 63 rows, distance from the long mean, and alignment of every tracked asset, beside the regime."""
    rn = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("d")))
    rows = roles(spark, sf_dir, ALL).where(F.col("series").isin(*(t for t, _, _ in WATCH))).withColumn("rn", rn).where("rn <= 200")

    def at(k: int) -> Column:
        return F.max(F.when(F.col("rn") == k, F.col("v")))

    mean = F.when(F.count("v") >= 100, F.avg("v"))
    stats = rows.groupBy("series").agg(at(1).alias("v"), at(8).alias("p7"), at(31).alias("p30"), at(64).alias("p63"), mean.alias("m200"))
    watch = spark.createDataFrame(WATCH, "series string, name string, colour string")
    credit = current_all(spark, sf_dir).where("series = 'hy_oas'").select(F.col("z").alias("credit_z"))
    now = state(spark, sf_dir).select("score", "real", "score_before").join(F.broadcast(credit))  # one row each
    aligned = rules.alignment(watch.join(stats, "series", "left"), now, SAFE).withColumnRenamed("score", "alignment")
    regime = now.select(F.col("score").alias("regime"), (F.col("score") - F.col("score_before")).alias("regime_delta"))
    got = watch.join(F.broadcast(stats), "series", "left").join(F.broadcast(aligned), "series").join(F.broadcast(regime))  # a row an asset
    returns = (six(F.try_divide("v", p) - 1, n, 5) for n, p in (("ret_1w", "p7"), ("ret_1m", "p30"), ("ret_3m", "p63")))
    return got.select(
        "series", "name", "colour", six("v", "price", 4), *returns, six((F.try_divide("v", "m200") - 1) * 100, "ma200_pct", 2), "alignment", F.col("n_confirm").cast("int").alias("n_confirm"), F.col("n_against").cast("int").alias("n_against"),
        rules.alignment_label(F.col("alignment")).alias("label"), rules.alignment_colour(F.col("alignment")).alias("label_colour"), "regime", "regime_delta",
    )


def asset(spark: SparkSession, sf_dir: str, ticker: str) -> DataFrame:
    """The row of one tracked asset, in any case of letters; KeyError for others."""
    if ticker.upper() not in {t for t, _, _ in WATCH}:
        raise KeyError(f"{ticker} is not tracked")
    return asset_details(spark, sf_dir).where(F.col("series") == ticker.upper())


# ---- heat-maps

HORIZONS = (("week", 5), ("month", 21), ("quarter", 63))
HEATED = ("GLD", "XLE", "XLP", "XLI", "IWM", "RSP", "HYG", "TLT", "UUP", "QQQ", "XLK", "XLF", "XLV")
_HEATED = ", ".join(map(repr, HEATED))
LEAST_COMMON = 90


def strength(series: DataFrame, base: str, least: int) -> DataFrame:
    """Returns of every series less those of ``base`` over their last 5, 21 and 63 common dates; null below ``least`` dates or too few for the horizon."""
    other = series.where(F.col("series") == base).select("d", F.col("v").alias("b"))
    rn = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("d")))
    rows = series.where(F.col("series") != base).join(other, "d").withColumn("rn", rn)

    def gain(c: str, k: int) -> Column:
        return F.try_divide(F.max(F.when(F.col("rn") == 1, F.col(c))), F.max(F.when(F.col("rn") == k + 1, F.col(c)))) - 1

    return rows.groupBy("series").agg(*(F.when(F.count(F.lit(1)) >= least, gain("v", k) - gain("b", k)).alias(n) for n, k in HORIZONS))


def _strength_sql(source: str, least: int) -> str:
    cells = ", ".join(
        f"{r(f'case when count(*) >= {least} then max(v) filter (where rn = 1) / max(v) filter (where rn = {k + 1}) - max(b) filter (where rn = 1) / max(b) filter (where rn = {k + 1}) end')} as {n}" for n, k in HORIZONS
    )
    return (
        f"select series, {cells} from (select t.series, t.v, b.v as b, row_number() over (partition by t.series order by t.d desc) as rn "
        f"from {source} t join {source} b on b.d = t.d and b.series = 'SPY' where t.series in ({_HEATED})) group by series"
    )


@query(with_(*BASE, "year as (select * from role where d >= (select max(d) from role) - 365)") + _strength_sql("year", LEAST_COMMON))
def strength_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative strength of a year's common dates with the index over a week, a month and a quarter of rows."""
    rows = points.since(roles(spark, sf_dir, ALL), 365).where(F.col("series").isin(*HEATED, "SPY"))
    got = strength(rows, "SPY", LEAST_COMMON)
    return got.select("series", *(six(n, n) for n, _ in HORIZONS))


@query(
    with_(*BASE, "own as (select series, " + ", ".join(f"max(v) filter (where rn = 1) / max(v) filter (where rn = {k + 1}) - 1 as {n}" for n, k in HORIZONS) + " from (select *, row_number() over (partition by series order by d desc) as rn from role) group by series)")
    + "select t.series, " + ", ".join(f"{r(f't.{n} - b.{n}')} as {n}" for n, _ in HORIZONS) + f" from own t join own b on b.series = 'SPY' where t.series in ({_HEATED})"
)
def flows_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns over each series' own last rows, less those of the index."""
    rn = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("d")))
    rows = roles(spark, sf_dir, ALL).where(F.col("series").isin(*HEATED, "SPY")).withColumn("rn", rn).where("rn <= 64")
    own = rows.groupBy("series").agg(*((F.try_divide(F.max(F.when(F.col("rn") == 1, F.col("v"))), F.max(F.when(F.col("rn") == k + 1, F.col("v")))) - 1).alias(n) for n, k in HORIZONS))
    base = own.where("series = 'SPY'").select(*(F.col(n).alias(f"b_{n}") for n, _ in HORIZONS))
    return own.where("series <> 'SPY'").join(F.broadcast(base)).select("series", *(six(F.col(n) - F.col(f"b_{n}"), n) for n, _ in HORIZONS))


# ---- labels of the regime under prices

RANGES = (("3m", 63), ("6m", 126), ("1y", 252), ("2y", 504), ("5y", 1260))
BAND_COLOUR = {"Risk On": "rgba(31,122,79,0.08)", "Bullish": "rgba(22,163,74,0.06)", "Neutral": "rgba(107,114,128,0.04)", "Bearish": "rgba(217,119,6,0.06)", "Risk Off": "rgba(180,35,24,0.08)"}
_BAND = "case label " + " ".join(f"when '{n}' then '{c}'" for n, c in BAND_COLOUR.items()) + " end"
_LABEL = "case when score >= 75 then 'Risk On' when score >= 60 then 'Bullish' when score >= 40 then 'Neutral' when score >= 25 then 'Bearish' else 'Risk Off' end"


@query(
    with_(
        *HISTORY_ALL,
        "slices as (" + " union all ".join(f"select series, '{n}' as span, min(d) as start, max(d) as stop from (select *, row_number() over (partition by series order by d desc) as rn from role where series in ({', '.join(repr(t) for t, _, _ in WATCH)})) where rn <= {k} group by series" for n, k in RANGES) + ")",
        f"inside as (select series, span, start, stop, d, {_LABEL} as label from slices join sc on d >= start and d <= stop)",
        "marked as (select *, lag(label) over (partition by series, span order by d) as was from inside)",
        "turns as (select *, row_number() over (partition by series, span order by d) as nth, lead(d) over (partition by series, span order by d) as after from marked where was is null or was <> label)",
    )
    + f"select series, span, cast(nth as integer) as nth, label, {_BAND} as colour, cast(case when nth = 1 then start else d end as varchar) as begins, cast(coalesce(after, stop) as varchar) as ends from turns"
)
def regime_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of one label under the prices of every tracked asset, for five ranges of rows."""
    rn = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("d")))
    rows = roles(spark, sf_dir, ALL).where(F.col("series").isin(*(t for t, _, _ in WATCH))).withColumn("rn", rn)
    spans = F.explode(F.array(*(F.struct(F.lit(n).alias("span"), F.lit(k).alias("k")) for n, k in RANGES)))
    slices = rows.select("series", "d", "rn", spans.alias("x")).where("rn <= x.k").groupBy("series", "x.span").agg(F.min("d").alias("start"), F.max("d").alias("end"))
    got = intervals.bands(slices, score_history(spark, sf_dir, ALL).select("d", "label"), ["series", "span"])
    colour = F.element_at(F.create_map(*(F.lit(x) for p in BAND_COLOUR.items() for x in p)), F.col("label"))
    return got.select("series", "span", "nth", "label", colour.alias("colour"), F.col("from").cast("string").alias("begins"), F.col("to").cast("string").alias("ends"))


# ---- drivers

#: Components with a high reading that is bad, and words by part of a name, the first that fits.
INVERTED = ("credit", "real_yields", "dollar", "cpi_momentum")
TARGETS = (("credit|oas", "Credit spreads"), ("dollar|usd", "Broad dollar"), ("real", "Real yields"), ("curve|term", "Curve"), ("inflation|cpi", "Inflation"), ("vol|vix", "Volatility"))
_DRIVERS = ORACLE["regime_components"]


@query(
    f"""select key, name, contribution, zscore, place,
        case when regexp_matches(lower(name), 'credit|oas') then 'Credit spreads' when regexp_matches(lower(name), 'dollar|usd') then 'Broad dollar' when regexp_matches(lower(name), 'real') then 'Real yields'
            when regexp_matches(lower(name), 'curve|term') then 'Curve' when regexp_matches(lower(name), 'inflation|cpi') then 'Inflation' when regexp_matches(lower(name), 'vol|vix') then 'Volatility' else 'Risk appetite' end as target,
        case when z > 1 then 'strongly supportive' when z > 0.3 then 'mildly supportive' when z < -1 then 'strong drag' when z < -0.3 then 'mild drag' else 'neutral' end as reads,
        case when z > 1 then '#1f7a4f' when z > 0.3 then '#16a34a' when z < -1 then '#b42318' when z < -0.3 then '#d97706' else '#6b7280' end as colour
    from (select *, case when key in ('credit', 'real_yields', 'dollar', 'cpi_momentum') then -zscore else zscore end as z from ({_DRIVERS}))"""
)
def driver_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every component stands for and how its z-score reads, high readings of the inverted ones being bad."""
    parts = QUERIES["regime_components"](spark, sf_dir)
    name = F.lower("name")
    target = F.coalesce(*(F.when(name.rlike(pattern), word) for pattern, word in TARGETS), F.lit("Risk appetite"))
    z = F.when(F.col("key").isin(*INVERTED), -F.col("zscore")).otherwise(F.col("zscore"))
    steps = ((z > 1, "strongly supportive", "#1f7a4f"), (z > 0.3, "mildly supportive", "#16a34a"), (z < -1, "strong drag", "#b42318"), (z < -0.3, "mild drag", "#d97706"))
    reads = F.coalesce(*(F.when(test, word) for test, word, _ in steps), F.lit("neutral"))
    colour = F.coalesce(*(F.when(test, c) for test, _, c in steps), F.lit("#6b7280"))
    return parts.select("key", "name", "contribution", "zscore", "place", target.alias("target"), reads.alias("reads"), colour.alias("colour"))


@query(
    f"""select (select coalesce(string_agg(name, ', ' order by place), '') from (select * from d where contribution > 0.01 order by place limit 2)) as supportive,
        (select coalesce(string_agg(name, ', ' order by place), '') from (select * from d where contribution < -0.01 order by place desc limit 2)) as adverse
    from (select 1) one""".replace("from d ", f"from ({_DRIVERS}) ")
)
def driver_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two components that support the score and the last two that weigh on it, by the size of what they contribute."""
    item = F.struct("place", "name", "contribution")
    parts = QUERIES["regime_components"](spark, sf_dir).agg(F.array_sort(F.collect_list(item), lambda a, b: a["place"] - b["place"]).alias("all"))  # a dozen rows

    def names(test: Column) -> Column:
        return F.array_join(F.transform(test, lambda x: x["name"]), ", ")

    up, down = F.filter("all", lambda x: x["contribution"] > 0.01), F.filter("all", lambda x: x["contribution"] < -0.01)
    return parts.select(names(F.slice(up, 1, 2)).alias("supportive"), names(F.slice(down, F.greatest(F.size(down) - 1, F.lit(1)), F.lit(2))).alias("adverse"))


# ---- the first page

MOVES = (("Credit spreads", "hy_oas", 7, "tighter", "wider"), ("Curve 10y-2y", "curve2", 7, "steeper", "flatter"), ("Real 10y yield", "real10", 7, "lower", "higher"), ("Dollar broad", "dollar_broad", 10, "weaker", "stronger"))


@query(
    with_(
        *BASE, "move (nth, what, series, days, falls, rises) as (values " + ", ".join(f"({i}, '{w}', '{s}', {k}, '{a}', '{b}')" for i, (w, s, k, a, b) in enumerate(MOVES, 1)) + ")",
        "tip as (select series, max(d) as newest, arg_max(v, d) as now from every group by series)",
        "old as (select m.nth, arg_max(e.v, e.d) as before from move m join tip t using (series) join every e on e.series = m.series and e.d <= t.newest - m.days group by m.nth)",
    )
    + f"select nth, what, {r('before')} as before, {r('now')} as now, {r('now - before')} as change, case when now - before < 0 then falls else rises end as word from move join tip using (series) join old using (nth)"
)
def weekly_macro_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of credit, curve, real yields and dollar over a week (ten days for the weekly dollar), with its word."""
    moves = spark.createDataFrame([(i, *m) for i, m in enumerate(MOVES, 1)], "nth int, what string, series string, days int, falls string, rises string")
    rows = all_series(spark, sf_dir).join(F.broadcast(moves), "series").withColumn("newest", F.max("d").over(Window.partitionBy("series")))
    old = F.col("d") <= F.date_sub("newest", F.col("days"))
    got = rows.groupBy("nth", "what", "falls", "rises").agg(F.max_by("v", "d").alias("now"), F.max_by(F.when(old, F.col("v")), F.when(old, F.col("d"))).alias("before")).where("before is not null")
    change = F.col("now") - F.col("before")
    return got.select("nth", "what", six("before", "before"), six("now", "now"), six(change, "change"), F.when(change < 0, F.col("falls")).otherwise(F.col("rises")).alias("word"))


@query(
    with_(*BASE, "k as (select v, row_number() over (order by d desc) as rn, count(*) over () as n from every where series = 'curve2')", "x as (select max(v) filter (where rn = 1) as level, max(v) filter (where rn = 64 and n > 64) as before from k)", "f as (select arg_max(v, d) as funds from every where series = 'fed_funds')")
    + f"""select {r('level')} as level, case when before is null then '-' when level > before then 'Steepening' else 'Flattening' end as trend,
        case when level >= 0.75 then 'Steep' when level >= 0 then 'Flat / mildly pos' when level >= -0.25 then 'Shallow inversion' else 'Deep inversion' end as label,
        case when level >= 0.75 then '#1f7a4f' when level >= 0 then '#6b7280' when level >= -0.25 then '#d97706' else '#b42318' end as colour, {r('funds')} as fed_funds from x cross join f"""
)
def curve_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, trend over 63 rows and label of the curve beside the policy rate."""
    rn = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("d")))
    rows = all_series(spark, sf_dir).where("series in ('curve2', 'fed_funds')").withColumn("rn", rn)
    curve = F.col("series") == "curve2"
    got = rows.agg(
        F.max(F.when(curve & (F.col("rn") == 1), F.col("v"))).alias("level"), F.max(F.when(curve & (F.col("rn") == 64), F.col("v"))).alias("before"), F.sum(curve.cast("int")).alias("n"),
        F.max(F.when(~curve & (F.col("rn") == 1), F.col("v"))).alias("funds"),
    ).where("level is not null")
    level = F.col("level")
    trend = F.when((F.col("n") <= 64) | F.col("before").isNull(), "-").when(level > F.col("before"), "Steepening").otherwise("Flattening")
    words = F.when(level >= 0.75, "Steep").when(level >= 0, "Flat / mildly pos").when(level >= -0.25, "Shallow inversion").otherwise("Deep inversion")
    colours = F.when(level >= 0.75, "#1f7a4f").when(level >= 0, "#6b7280").when(level >= -0.25, "#d97706").otherwise("#b42318")
    return got.select(six("level", "level"), trend.alias("trend"), words.alias("label"), colours.alias("colour"), six("funds", "fed_funds"))


# ---- tables in and out

_LAID = ("1-URGENT", "2-HIGH", "3-MEDIUM")
_LAID_SQL = ", ".join(map(repr, _LAID))
_ALIASES = {"1-URGENT": "urgent"}


@query(
    with_(SER, f"s as (select case when series = '1-URGENT' then 'urgent' else series end as series, d, v from ser where series in ({_LAID_SQL}))")
    + f"select layout, series, {DAY}, {r('v', 4)} as v from s cross join (values ('field first'), ('ticker first'), ('flat')) l (layout) where layout <> 'flat' or series = 'urgent'"
)
def layout_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series table from downloads of three layouts."""
    days = tables.orders(spark, sf_dir).where(F.col("series").isin(*_LAID)).groupBy("d").pivot("series", list(_LAID)).agg(F.max("v")).withColumnRenamed("d", "Date")

    def laid(names: dict[str, str]) -> DataFrame:
        volume = [F.lit(1.0).alias(n.replace("Adj Close", "Volume").replace("Close", "Volume").replace("close", "Volume")) for n in names.values()]
        return days.select("Date", *(F.col(f"`{t}`").alias(n) for t, n in names.items()), *volume)

    frames = {
        "field first": laid({t: str(("Close", t)) for t in _LAID}), "ticker first": laid({t: str((t, f)) for t, f in zip(_LAID, ("Close", "Adj Close", "close"), strict=True)}),
        "flat": days.select("Date", F.lit(2.0).alias("Open"), F.col("`1-URGENT`").alias("Adj Close")),
    }
    rows = [layouts.prices(df, "Date", list(_LAID) if n != "flat" else ["1-URGENT"], _ALIASES).select(F.lit(n).alias("layout"), "series", day(), six("v", "v", 4)) for n, df in frames.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"select event_type as series, cast(cast(ts as date) as varchar) as d, {r('arg_max(value, (ts, value))', 6)} as v from events where value is not null group by 1, 2")
def streamed_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that a stream of events leaves, every event a revision of its type's value of the day."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may be a file or a folder
    rows = stream.where("value is not null").select(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("d"), F.col("value").alias("v"), F.col("ts").cast("timestamp").alias("asof"))
    folder = shared_dir(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: a stream keeps its place there")
    target = f"{folder}/saltmarsh-revisions-{uuid.uuid4().hex}"
    revisions.keep(rows, f"{target}/table", f"{target}/checkpoint").awaitTermination()
    return revisions.current(spark, f"{target}/table").select("series", F.col("d").cast("string").alias("d"), six("v", "v"))


@query("select event_type, count(*) as n, count(*) filter (where not json_valid(props)) as broken, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as total from events group by 1")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, broken ones and the sum of k in the events' JSON, by type."""
    rows = tables.parsed(tables.table(spark, sf_dir, "events").select("event_type", "props"), "props", "k bigint")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("broken").alias("broken"), F.sum("k").alias("total"))


__all__ = ["ORACLE", "QUERIES", "asset"]
