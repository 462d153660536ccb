"""The regime score of every Friday, from a long table of roles.

Every role's statistics are taken on its own rows, carried on to the Fridays by an as-of join, and laid out
as a row per Friday; pillars, weights and score are column expressions over that row.  So the whole
history costs one pass of windows, not one computation per date, and equals the score of the data cut at
each date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, confidence, goldilocks, label, mean_of, signal
from ..operators import joins, points, windows

MACRO = ("init_claims", "y10", "y2", "y3m", "real10", "cpi", "fed_assets", "hy_oas", "ig_oas", "dollar_broad")
PRICES = ("RSP", "SPY", "VIX", "VIX3M")
#: Roles that take the date of the prices.
PRICED = ("breadth", "VIX", "vratio", "slope")
# Pillar weights at rest and under stress.
WEIGHTS = {"growth": (0.25, 0.15), "inflation": (0.15, 0.08), "monetary": (0.20, 0.20), "internals": (0.20, 0.37), "fiscal": (0.10, 0.10), "sentiment": (0.10, 0.10)}
STRESS_SPREAD, STRESS_VIX = 500, 28


def wide(roles: DataFrame) -> DataFrame:
    """A row per date with a column per role."""
    return roles.groupBy("d").agg(*(F.max(F.when(F.col("series") == r, F.col("v"))).alias(r) for r in (*MACRO, *PRICES, "IWM")))


def broad(roles: DataFrame) -> DataFrame:
    """One row: whether the equal-weighted index and the index are there at all."""
    return roles.agg((F.coalesce(F.max(F.col("series") == "RSP"), F.lit(False)) & F.coalesce(F.max(F.col("series") == "SPY"), F.lit(False))).alias("broad"))


def derived(roles: DataFrame) -> DataFrame:
    """Spreads and ratios of roles on the dates that both have, and rates of change, as further roles."""

    def c(role: str) -> Column:
        return F.col(role)

    # Small companies stand for breadth only where the equal-weighted index is missing altogether.
    named = {
        "breadth": F.when(F.col("broad"), F.try_divide(c("RSP"), c("SPY"))).otherwise(F.try_divide(c("IWM"), c("SPY"))),
        "curve3m": c("y10") - c("y3m"),
        "curve2": c("y10") - c("y2"),
        "breakeven": c("y10") - c("real10"),
        "vratio": F.try_divide(c("VIX"), c("VIX3M")),
        "slope": c("VIX3M") - c("VIX"),
    }
    cells = F.array(*(F.struct(F.lit(name).alias("series"), value.alias("v")) for name, value in named.items()))
    out = wide(roles).join(F.broadcast(broad(roles))).select("d", F.explode(cells).alias("x")).select("x.series", "d", "x.v")
    cpi = F.col("series") == "cpi"
    rates = roles.where(F.col("series").isin("cpi", "fed_assets")).select(
        F.when(cpi, "cpi_yoy").otherwise("fed_roc").alias("series"), "d", (F.when(cpi, windows.pct_change(F.col("v"), 12)).otherwise(windows.pct_change(F.col("v"), 63)) * 100).alias("v")
    )
    return out.unionByName(rates).where("v is not null")


def statistics(roles: DataFrame) -> DataFrame:
    """(series, d, v, n, z, roc, gap, pct) of every row on the rows of its series so far."""
    v, n = F.col("v"), F.count(F.lit(1)).over(windows.so_far())
    # A frame of 252 rows is summed anew for each row, so series are dealt to all cores however few bytes they are.
    roles = roles.repartition(roles.sparkSession.sparkContext.defaultParallelism, "series")
    claims = F.col("series") == "init_claims"
    step = F.when(claims, windows.change(v, 13)).otherwise(windows.change(v, 63))
    # Claims look back over as many rows as there are, so the guard of their z-score shrinks with it.
    roc_least = F.when(claims, 13 + F.greatest(F.lit(30), F.floor(F.least(n, F.lit(252)) / 4))).otherwise(63 + 63)
    rows = roles.withColumn("n", n).withColumn("step", step).withColumn("roc_least", roc_least)
    own = windows.last_rows(252)
    sd = F.stddev_samp("step").over(own)
    roc = F.when(sd == 0, 0.0).otherwise((F.col("step") - F.avg("step").over(own)) / sd)
    return rows.select(
        "series", "d", "v", "n",
        windows.zscore(v, 252, guard=30).alias("z"),
        F.when(F.col("n") >= F.col("roc_least"), roc).alias("roc"),
        (v - windows.long_mean(v, 1260)).alias("gap"),
        windows.rank_among(F.when(F.col("series") == "VIX", v), 252, 1).alias("pct"),
    )


def fridays(roles: DataFrame, least: int = 60) -> DataFrame:
    """Fridays of the weeks with a date that both macro and price roles have; none with fewer than ``least`` such dates."""
    kinds = roles.groupBy("d").agg(F.max(F.col("series").isin(*MACRO).cast("int")).alias("macro"), F.max(F.col("series").isin(*PRICES).cast("int")).alias("price"))
    weeks = kinds.where("macro = 1 and price = 1").groupBy(points.friday(F.col("d")).alias("w")).agg(F.count(F.lit(1)).alias("days"))
    return weeks.withColumn("all", F.sum("days").over(Window.partitionBy())).where(F.col("all") >= least).select(F.col("w").alias("d"))


def pillars(row: DataFrame) -> DataFrame:
    """Adds the six pillars, null where none of a pillar's inputs is there."""

    def x(role: str, stat: str) -> Column:
        return F.col(f"{role}_{stat}")

    def has(role: str, n: int) -> Column:
        return x(role, "n") >= n

    def sig(role: str, stat: str = "z", guard: int = 63) -> Column:
        """0 before the guard, as a missing z-score counts."""
        return signal(F.when(has(role, guard), x(role, stat)))

    def pillar(*terms: Column) -> Column:
        return F.element_at(F.transform(F.array(mean_of(*terms)), lambda m: clip(m, -1, 1)), 1)

    level, vix = x("curve2", "v"), F.col("VIX_n") >= 60
    growth = pillar(
        F.when(has("init_claims", 60), -sig("init_claims", guard=30)),
        F.when(has("init_claims", 60) & x("init_claims", "roc").isNotNull(), -signal(x("init_claims", "roc")) * 0.6),
        F.when(F.col("broad"), F.when(has("breadth", 60), sig("breadth") * 0.8)).otherwise(F.when(has("breadth", 30), sig("breadth") * 0.5)),
        F.when(F.col("broad") & has("breadth", 60) & x("breadth", "roc").isNotNull(), signal(x("breadth", "roc")) * 0.5),
        F.when(has("curve3m", 30), sig("curve3m") * 0.7),
    )
    cpi = F.col("cpi_n") >= 13
    price_level = F.when(cpi, x("cpi_yoy", "v")).otherwise(F.when(has("breakeven", 30), x("breakeven", "v")))
    gl = F.when(cpi, goldilocks(x("cpi_yoy", "v"))).otherwise(goldilocks(x("breakeven", "v"), low=2.0))
    turn = F.when(F.coalesce(F.nullif(price_level, F.lit(0.0)), F.lit(2.0)) > 2.5, -0.3).otherwise(0.3)
    roc = F.when(has("breakeven", 30), x("breakeven", "roc"))
    inflation = F.when(cpi | has("breakeven", 30), clip(gl * 0.7 + F.when(roc.isNotNull(), signal(roc) * turn).otherwise(0.0), -1, 1))
    monetary = pillar(
        F.when(has("real10", 30), -sig("real10")),
        F.when(has("real10", 252), -clip(x("real10", "gap") / 1.5, -1, 1) * 0.5),
        F.when(has("curve2", 30), sig("curve2") * 0.7),
        F.when(has("curve2", 30) & x("curve2", "roc").isNotNull(), signal(x("curve2", "roc")) * 0.4),
        F.when(has("curve2", 30) & (level < -0.1), F.least(F.abs(level) / 1.5, F.lit(1.0)) * -0.4),
        F.when(has("fed_assets", 70), signal(F.when(has("fed_roc", 63), x("fed_roc", "z"))) * 0.4),
    )
    internals = pillar(
        F.when(has("hy_oas", 30), sig("hy_oas") * -1.2),
        F.when(has("ig_oas", 30), sig("ig_oas") * -0.8),
        F.when(vix, sig("VIX") * -0.7),
        F.when(vix & x("vratio", "v").isNotNull(), clip(1 - x("vratio", "v"), -1, 0.5) * 0.6),
    )
    fiscal = pillar(
        F.when(has("dollar_broad", 30), -sig("dollar_broad")),
        F.when(has("dollar_broad", 30) & x("dollar_broad", "roc").isNotNull(), -signal(x("dollar_broad", "roc")) * 0.5),
        F.when(has("fed_assets", 60), sig("fed_assets") * 0.5),
    )
    pct = x("VIX", "pct")
    mood = F.when(pct > 80, 0.6).when(pct > 65, 0.2).when(pct < 20, -0.3).otherwise(0.0)
    sentiment = pillar(F.when(vix, mood), F.when(x("slope", "v").isNotNull(), clip(-x("slope", "v") / 5, -0.5, 0.5) * 0.5))
    return row.select("*", growth.alias("growth"), inflation.alias("inflation"), monetary.alias("monetary"), internals.alias("internals"), fiscal.alias("fiscal"), sentiment.alias("sentiment"))


def assembled(row: DataFrame) -> DataFrame:
    """score_raw, score, label and the number of missing pillars from a row with pillars."""
    stress = F.coalesce(F.col("hy_oas_v") > STRESS_SPREAD, F.lit(False)) | F.coalesce(F.col("VIX_v") > STRESS_VIX, F.lit(False))
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, (rest, strained) in WEIGHTS.items():
        raw, w = F.coalesce(F.col(name), F.lit(0.0)), F.when(stress, strained).otherwise(rest)
        counts = (raw != 0) if name in ("growth", "internals") else F.lit(True)
        total, weight = total + F.when(counts, raw * w).otherwise(0.0), weight + F.when(counts, w).otherwise(0.0)
    breadth = F.when(F.col("breadth_n") >= 63, F.col("breadth_z"))
    credit = F.when(F.col("hy_oas_n") >= 63, F.col("hy_oas_z"))
    penalty = F.when((breadth > 0.3) & (credit > 0.5), F.least(breadth, F.lit(2.0)) * F.least(credit, F.lit(2.0)) / 4 * -0.12).when((breadth < -0.3) & (credit < -0.5), 0.03).otherwise(0.0)
    raw = clip(clip((total / weight + 1) * 50, 0, 100) + penalty * 100, 0, 100)
    missing = sum((F.col(p).isNull().cast("int") for p in WEIGHTS), F.lit(0))
    score = F.bround(F.col("score_raw")).cast("long")
    return row.withColumn("stress", stress).withColumn("penalty", penalty).withColumn("score_raw", raw).withColumn("score", score).withColumn("label", label(F.col("score"))).withColumn("missing", missing)


NEEDED = ("init_claims", "breadth", "curve3m", "cpi", "cpi_yoy", "breakeven", "real10", "curve2", "fed_assets", "fed_roc", "hy_oas", "ig_oas", "VIX", "vratio", "slope", "dollar_broad")


def all_statistics(roles: DataFrame) -> DataFrame:
    """``statistics`` of roles and of what derives from them."""
    return statistics(roles.unionByName(derived(roles)))


def laid_out(roles: DataFrame, dates: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """A row for each ``d`` of ``dates`` (d, macro, price), with every role's statistics (``all_statistics``) as of the date of its kind."""
    stats = all_statistics(roles) if stats is None else stats
    asked = dates.select(F.col("d").alias("key"), "macro", "price", F.explode(F.array(*(F.lit(r) for r in NEEDED))).alias("series"))
    asked = asked.select("key", "series", F.when(F.col("series").isin(*PRICED), F.col("price")).otherwise(F.col("macro")).alias("d"))
    values = ["v", "n", "z", "roc", "gap", "pct"]
    met = joins.asof(asked, stats, "series", "d", values)
    cells = [F.max(F.when(F.col("series") == r, F.col(c))).alias(f"{r}_{c}") for r in NEEDED for c in values]
    return met.groupBy(F.col("key").alias("d")).agg(*cells).join(F.broadcast(broad(roles)))


def history(roles: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """d, the six pillars, score_raw, score and label of every Friday."""
    dates = fridays(roles).select("d", F.col("d").alias("macro"), F.col("d").alias("price"))
    out = assembled(pillars(laid_out(roles, dates, stats)))
    return out.select("d", *WEIGHTS, "score_raw", "score", "label", "missing")


def cuts(roles: DataFrame, days: int = 21) -> DataFrame:
    """(d, macro, price): 'now', the newest dates of macro and price roles, and 'before', so many days earlier."""
    newest = roles.agg(F.max(F.when(F.col("series").isin(*MACRO), F.col("d"))).alias("m"), F.max(F.when(F.col("series").isin(*PRICES), F.col("d"))).alias("p"))
    both = F.array(*(F.struct(F.lit(k).alias("d"), F.date_sub("m", n).alias("macro"), F.date_sub("p", n).alias("price")) for k, n in (("now", 0), ("before", days))))
    return newest.select(F.explode(both).alias("x")).select("x.*")


def snapshot(roles: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """The regime 'now' and 'before': statistics, pillars, weights, penalty, score and label."""
    return assembled(pillars(laid_out(roles, cuts(roles), stats)))


# Names of the pillars and where their level and z-score come from.
PILLARS = (
    ("growth_momentum", "Growth Momentum", "growth"), ("inflation_price", "Inflation & Price", "inflation"), ("monetary_policy", "Monetary Policy", "monetary"),
    ("market_internals", "Market Internals", "internals"), ("fiscal_external", "Fiscal & External", "fiscal"), ("sentiment", "Sentiment", "sentiment"),
)
# The mix of equities, credit, duration and cash by score.
MIX = ((70, (70, 20, 5, 5)), (55, (55, 25, 15, 5)), (45, (40, 25, 25, 10)), (30, (25, 20, 35, 20)), (None, (15, 10, 40, 35)))


def readings(row: DataFrame) -> DataFrame:
    """Adds level and z-score of each pillar and of credit, curve, real yields, dollar and breadth, null where rows are too few."""

    def of(role: str, stat: str, least: int, guard: int = 63) -> Column:
        n = F.col(f"{role}_n")
        return F.when(n >= (least if stat == "v" else max(least, guard)), F.col(f"{role}_{stat}"))

    cpi = F.col("cpi_n") >= 13
    breadth = F.when(F.col("broad"), of("breadth", "z", 60)).otherwise(of("breadth", "z", 30))
    claims = of("init_claims", "z", 60, 30)
    return row.withColumns({
        "growth_level": F.coalesce(of("init_claims", "v", 60), of("curve3m", "v", 30)), "growth_z": F.coalesce(claims, breadth),
        "inflation_level": F.when(cpi, F.col("cpi_yoy_v")).otherwise(of("breakeven", "v", 30)), "inflation_z": F.when(cpi, of("cpi_yoy", "z", 1)).otherwise(of("breakeven", "z", 30)),
        "monetary_level": of("real10", "v", 30), "monetary_z": of("real10", "z", 30), "internals_level": of("hy_oas", "v", 30), "internals_z": of("hy_oas", "z", 30),
        "fiscal_level": of("dollar_broad", "v", 30), "fiscal_z": of("dollar_broad", "z", 30), "sentiment_level": of("VIX", "v", 60), "sentiment_z": of("VIX", "z", 60),
        "curve_level": of("curve2", "v", 30), "curve_z": of("curve2", "z", 1), "breadth_z": breadth,
    })


#: Components that older pages read, with weight 0: name, level, z-score.
OLDER = (
    ("credit", "Credit stress", "internals_level", "internals_z"), ("real_yields", "Real yields", "monetary_level", "monetary_z"), ("curve", "Curve (10y - 2y)", "curve_level", "curve_z"),
    ("dollar", "Dollar headwind", "fiscal_level", "fiscal_z"), ("cpi_momentum", "Inflation momentum", "inflation_level", "inflation_z"), ("risk_appetite", "Breadth (RSP/SPY)", None, "breadth_z"),
)


def components(row: DataFrame) -> DataFrame:
    """(key, name, weight, contribution, level, zscore) of the pillars and of the older components, from ``readings``."""
    none = F.lit(None).cast("double")
    cells = [(k, n, F.when(F.col("stress"), WEIGHTS[p][1]).otherwise(WEIGHTS[p][0]), F.coalesce(F.col(p), F.lit(0.0)), F.col(f"{p}_level"), F.col(f"{p}_z")) for k, n, p in PILLARS]
    cells += [(k, n, F.lit(0.0), F.lit(0.0), F.col(level) if level else none, F.col(z)) for k, n, level, z in OLDER]
    items = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(n).alias("name"), w.alias("weight"), (raw * w).alias("contribution"), level.alias("level"), z.alias("zscore")) for k, n, w, raw, level, z in cells))
    return row.select(F.explode(items).alias("x")).select("x.*")


def phrase(x: Column, low: float, high: float, words: tuple[str, str, str]) -> Column:
    """Null where there is no value."""
    return F.when(x < low, words[0]).when(x > high, words[1]).when(x.isNotNull(), words[2])


def result(row: DataFrame) -> DataFrame:
    """Adds confidence, summary, stances, tilts, mix and favoured groups to rows with ``readings``."""
    score, c = F.col("score"), F.col
    summary = F.concat_ws(
        ", ",
        phrase(c("internals_z"), -0.3, 0.3, ("credit tightening", "credit widening", "credit stable")),
        phrase(c("curve_level"), 0, 1.0, ("curve inverted", "curve steep", "curve flat")),
        phrase(c("fiscal_z"), -0.3, 0.3, ("dollar soft", "dollar firm", "dollar stable")),
        phrase(c("breadth_z"), -0.3, 0.3, ("breadth fading", "breadth improving", "breadth mixed")),
        F.when(c("penalty") < -0.04, "credit/equity divergence warning"),
    )
    tilts = F.concat_ws(
        "; ",
        F.when(score >= 65, "Equities favored by regime score").when(score <= 35, "Equities pressured by regime score"),
        F.when(c("growth_z") > 0, "Breadth improving").when(c("growth_z").isNotNull(), "Breadth deteriorating"),
        F.when(c("internals_level") <= 3.5, "Credit spreads tight").when(c("internals_level") >= 5.0, "Credit spreads wide"),
        F.when(c("monetary_level") >= 1.5, "Real yields high").when(c("monetary_level") <= 0.5, "Real yields low"),
        F.when(c("curve_level") < 0, "Curve inversion risk").when(c("curve_level") > 1.0, "Curve steep"),
        F.when(c("fiscal_z") > 0.5, "Dollar headwind"),
    )
    groups = F.concat(
        *(
            F.when(test, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
            for test, names in (
                (score >= 65, ("Cyclicals", "High Beta")), ((score >= 55) & (c("curve_z") > 0.3), ("Financials (steep curve)",)), (c("monetary_z") < -0.3, ("Growth / Long Duration", "Gold")),
                (c("monetary_z") > 0.5, ("Value / Short Duration",)), (c("internals_z") < -0.5, ("High Yield Credit",)), (score <= 40, ("Defensives", "Quality")),
                (score <= 30, ("Gold / Safe Havens", "Long Bonds")), (c("growth_z") > 0.5, ("Industrials / Cyclicals",)),
            )
        )
    )
    mix = {}
    for i, name in enumerate(("mix_equities", "mix_credit", "mix_duration", "mix_cash")):
        mix[name] = F.when(score >= 70, MIX[0][1][i]).when(score >= 55, MIX[1][1][i]).when(score >= 45, MIX[2][1][i]).when(score >= 30, MIX[3][1][i]).otherwise(MIX[4][1][i])
    return row.withColumns({
        "confidence": confidence(c("missing"), len(WEIGHTS)), "summary": F.when(summary == "", "waiting for data").otherwise(summary), "tilts": tilts,
        "equities": F.when(score >= 65, "Overweight").when(score <= 35, "Underweight").otherwise("Neutral"),
        "credit": F.when(c("internals_level") <= 3.5, "Overweight").when(c("internals_level") >= 5.0, "Underweight").otherwise("Neutral"),
        "duration": F.when(c("monetary_level") >= 1.5, "Underweight").when(c("monetary_level") <= 0.5, "Overweight").otherwise("Neutral"),
        "dollar": F.when(c("fiscal_z") > 0.5, "Avoid USD").when(c("fiscal_z") < -0.5, "Favour USD").otherwise("Neutral"),
        "groups": F.array_join(F.array_distinct(groups), "; "), **mix,
    })


def colour(score: Column) -> Column:
    return F.when(score >= 75, "#1f7a4f").when(score >= 60, "#16a34a").when(score >= 40, "#6b7280").when(score >= 25, "#d97706").otherwise("#b42318")
