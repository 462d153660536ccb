"""Lines of the brief and the thesis, texts from rule tables, and single series, on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from saltmarsh.functions.scalars import contribution, printed
from saltmarsh.operators import points, texts
from saltmarsh.plans import market_queries, outlook_queries, text_queries

WEEK = "credit_week double, curve_week double, real_week double, dollar_week double, small_week double"


def lines(spark, week, curve=(), small=(), ahead=()):
    tails = [("curve2", i, float(v)) for i, v in curve] + [("small", i, float(v)) for i, v in small]
    got = outlook_queries.changes(
        spark.createDataFrame([week], WEEK), spark.createDataFrame(tails, "series string, rn int, v double"), spark.createDataFrame(list(ahead), "series string, m double"),
    )
    return [r.line for r in got.orderBy("place").collect()]


def test_what_changed_by_each_rule(spark):
    up = [(1, 2.0), (64, 1.0), (2, 0.5), (65, 1.0)]
    down = [(1, 0.5), (64, 1.0), (2, 2.0), (65, 1.0)]
    none = (None,) * 5
    assert lines(spark, none) == []
    assert lines(spark, (0.10, -0.25, None, None, None)) == ["High yield spreads widened by 0.10 pp this week.", "The 10y minus 2y curve flattened by 0.25 pp this week."]
    assert lines(spark, (-0.3, None, 0.2, -0.005, 0.0049)) == ["High yield spreads tightened by 0.30 pp this week.", "Real yields rose by 0.20 pp this week.", "The dollar weakened by 0.50% this week."]
    assert lines(spark, (None, None, None, None, -0.02), up, down) == ["Curve trend flipped up on a 3-month lookback.", "Risk appetite deteriorated: IWM/SPY moved -2.00% this week.", "IWM/SPY trend flipped down on a 3-month lookback."]
    assert lines(spark, none, curve=up[:3]) == []  # too short
    assert lines(spark, none, ahead=[("A", 0.031), ("B", -0.02), ("C", 0.01), ("D", None)]) == ["Rotation leaders vs SPY (1m): A (3.1%), C (1.0%).", "Rotation laggards vs SPY (1m): B (-2.0%), C (1.0%)."]


def test_six_lines_at_most_in_the_order_of_the_rules(spark):
    up = [(1, 2.0), (64, 1.0), (2, 0.5), (65, 1.0)]
    got = lines(spark, (0.2, 0.2, 0.2, 0.02, 0.02), up, up, [("A", 0.1)])
    assert len(got) == 6 and got[2].startswith("Curve trend") and got[-1].startswith("Risk appetite improved")


NOW = "score long, score_delta long, momentum string"
PARTS = "name string, contribution double, zscore double, place int"
GAPS = "name string, gap double, place int"
FACTORS = "winner string, loser string, score double, funds string, place int"
CONTEXT = "label string, real double, credit double, credit_z double, curve double, curve_month double, stay double, degrade double, improve double"


def thesis(spark, now, parts=(), gaps=(), factors=(), context=(("Neutral", *[None] * 8),)):
    frames = (spark.createDataFrame(list(rows), schema) for rows, schema in (([now], NOW), (parts, PARTS), (gaps, GAPS), (factors, FACTORS), (context, CONTEXT)))
    return {r.nth: r.line for r in outlook_queries.sentences(*frames).collect()}


def test_sentences(spark):
    got = thesis(
        spark, (76, 3, "Improving"), [("Growth", 0.2, 1.6, 1), ("Credit", -0.1, -0.4, 2)], [("GLD vs Real rates", -1.5, 1)], [("Value", "Growth", 0.41, "A vs B", 1)],
        [("Bullish", 1.6, 4.0, 0.31, -0.1, -0.2, 0.5, 0.36, 0.14)],
    )
    assert got == {
        1: "Macro conditions are firmly risk-on at 76/100, with momentum improving. The score has gained 3 points over the past 21 days.",
        2: "Growth is the dominant driver, sharply supporting the score (z +1.60). Credit is adding to the headwind (z -0.40).",
        3: "Key reads: real yields at 1.60% (restrictive); HY OAS at 4.00% (elevated); curve inverted at -0.10pp, bear flattening -0.20pp 1m.",
        4: "Primary divergence: GLD cheap vs falling real rates (GLD vs Real rates, delta-z -1.50) - Accumulate GLD.",
        5: "Factor rotation favours Value over Growth (score +0.41, proxy: A vs B).",
        6: "Regime transition risk is elevated: Markov model assigns 36% probability of moving to a worse regime in the next 4 weeks. Size positions accordingly.",
    }


def test_sentences_at_their_bounds(spark):
    opening = {75: "firmly risk-on", 74: "bullish territory", 60: "bullish territory", 59: "are neutral", 40: "are neutral", 39: "is deteriorating", 25: "is deteriorating", 24: "risk-off territory"}
    for score, words in opening.items():
        line = thesis(spark, (score, 0, "Stable"))
        assert set(line) == {1} and words in line[1] and line[1].endswith("with momentum deteriorating.")
    context = ("Neutral", 0.8, None, 2.0, 0.5, 0.05, 0.705, 0.35, 0.30)
    got = thesis(spark, (50, -2, "Stable"), [("One", -0.1, None, 1)], [("VIX vs HY OAS", 1.2, 2)], [("A", "B", 0.39, "f", 1)], [context])
    assert got[1].endswith("The score has lost 2 points over the past 21 days.") and got[2] == "One is the dominant driver, dragging on the score (z +0.00)."
    assert got[3] == "Key reads: real yields at 0.80% (accommodative); curve flat at +0.50pp." and set(got) == {1, 2, 3, 6}
    assert got[6] == "Regime stability: 70% probability of remaining in Neutral next week per the Markov transition model."
    better = thesis(spark, (50, None, "Stable"), context=[(*context[:6], 0.5, 0.1, 0.31)])
    assert better[6].startswith("Conditions may be improving: 31%")


def test_first_rule_that_holds_speaks(spark):
    rules = (
        ("t", 1, "x", 5.0, None, "high {}", "r", "x", "%.1f", 1.0), ("t", 2, "x", 1.0, 5.0, "middle", None, None, None, 1.0), ("t", 3, "x", None, None, "low {}%", "g", "y", "%+.0f", 100.0),
        ("other", 1, "y", 0.0, None, "y is {}", "b", "x", "%.2f", 1.0),
    )
    rows = spark.createDataFrame([("a", 5.0, 0.5), ("b", 4.9, None), ("c", 0.9, -0.25), ("d", 0.5, None), ("e", None, 1.0)], "k string, x double, y double")
    got = {(r.k, r.topic): (r.text, r.colour) for r in texts.told(texts.readings(rows, ["k"], ["x", "y"]), texts.table(spark, rules), ["k"]).collect()}
    assert got == {("a", "t"): ("high 5.0", "r"), ("a", "other"): ("y is 5.00", "b"), ("b", "t"): ("middle", None), ("c", "t"): ("low -25%", "g")}


def test_cards_at_their_bounds(spark):
    rules = texts.table(spark, text_queries.CARD_ROWS)
    rows = spark.createDataFrame([("a", 1.5, 0.0, 4.5, 0.5), ("b", 1.51, 0.01, 4.51, 0.51), ("c", 0.49, -0.01, 3.49, -0.01), ("d", 0.5, None, 3.5, 0.0)], "k string, real double, ret_1w double, credit double, curve double")
    got = {(r.k, r.topic): (r.text, r.colour) for r in texts.told(texts.readings(rows, ["k"], ["real", "ret_1w", "credit", "curve"]), rules, ["k"]).collect()}
    up, mid, down = "#4aba6e", "#f79400", "#e84040"
    assert [got[k, "REAL YIELD"][1] for k in "abcd"] == [mid, down, up, mid]
    assert [got[k, "HY OAS"][1] for k in "abcd"] == [mid, down, up, mid]
    assert [got[k, "CURVE 2S10S"][1] for k in "abcd"] == [mid, up, down, mid]
    assert [got[k, "1W RTN"] for k in "abc"] == [("+0.0%", down), ("+1.0%", up), ("-1.0%", down)] and ("d", "1W RTN") not in got


def test_numbers_are_rounded_from_their_exact_values(spark):
    """As C prints them: halves like 0.25 go to the even digit, 0.15 and 39.15 are no halves but just below one."""
    rules = texts.table(spark, text_queries.CARD_ROWS)
    rows = spark.createDataFrame([("a", 0.25, 0.125), ("b", 0.15, 2.5), ("c", -39.15, 0.375), ("d", 39.35, 0.115), ("e", -0.04, 1.005), ("f", 0.35, 0.135)], "k string, ma200_pct double, real double")
    got = {(r.k, r.topic): r.text for r in texts.told(texts.readings(rows, ["k"], ["ma200_pct", "real"]), rules, ["k"]).collect()}
    for r in rows.collect():
        assert (got[r.k, "VS 200D MA"], got[r.k, "REAL YIELD"]) == ("%+.1f%%" % r.ma200_pct, "%.2f%%" % r.real)
    assert got["a", "VS 200D MA"] == "+0.2%" and got["c", "VS 200D MA"] == "-39.1%" and got["a", "REAL YIELD"] == "0.12%"


def test_whole_and_infinite_numbers_are_printed(spark):
    rows = spark.createDataFrame([("%.0fth", 2.5), ("%.0fth", 3.5), ("$%,.2f", 1234567.125), ("%+.2fpp", -0.0), ("%.1f", float("inf"))], "f string, x double")
    got = [r.t for r in rows.select(printed(F.col("f"), F.col("x")).alias("t")).collect()]
    assert got == ["2th", "4th", "$1,234,567.12", "-0.00pp", "Infinity"]


def test_colours_and_contributions(spark):
    df = spark.createDataFrame([("#1d4ed8", 0.5, 2.0, 3.0), ("16a34a", None, 2.0, 0.25), ("#fff", None, None, 1.0), (None, 0.0, 1.0, 1.0)], "c string, s double, z double, w double")
    got = df.select(texts.rgba(F.col("c"), 0.09).alias("c"), contribution(F.col("s"), F.col("z"), F.col("w")).alias("v")).collect()
    assert [tuple(r) for r in got] == [("rgba(29,78,216,0.09)", 0.5), ("rgba(22,163,74,0.09)", 0.5), ("rgba(29,78,216,0.09)", 0.0), ("rgba(29,78,216,0.09)", 0.0)]


def legs(spark, counts):
    day = dt.date(2024, 1, 1)
    rows = [(s, day + dt.timedelta(i), 1.0 + len(s)) for s, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "series string, d date, v double")


def test_forwards_need_more_than_ten_dates(spark):
    def kinds(**counts):
        got = text_queries.forwards(legs(spark, counts)).groupBy("kind").count().collect()
        return {r.kind: r["count"] for r in got}

    assert kinds(y10=12, y5=11, real10=12, real5=12) == {"nominal": 11, "real": 12, "implied": 11, "shown": 11}
    assert kinds(y10=12, y5=12, real10=10, real5=12) == {"nominal": 12, "shown": 12}  # the nominal one stands in
    assert kinds(y10=10, y5=10, real10=12, real5=12) == {"real": 12}


def test_strength_on_common_dates(spark):
    day = dt.date(2024, 1, 1)
    rows = [("SPY", day + dt.timedelta(i), 100.0 + i) for i in range(8)] + [("A", day + dt.timedelta(i), 50.0 + 2 * i) for i in range(8) if i != 6]
    got = market_queries.strength(spark.createDataFrame(rows, "series string, d date, v double"), "SPY", 7).first()
    assert abs(got.week - ((64 / 52 - 1) - (107 / 101 - 1))) < 1e-12 and got.month is None
    assert market_queries.strength(spark.createDataFrame(rows, "series string, d date, v double"), "SPY", 8).first().week is None


def test_rank_among_as_many_rows_as_there_are(spark):
    """A rank over 756 or 1260 rows with fewer: all of them."""
    rows = spark.createDataFrame([("a", dt.date(2024, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate([3, 1, 4, 1, 5, 2])], "series string, d date, v double")
    assert abs(points.tail_rank(rows, 756, least=1).first().pct - 100 * 2 / 6) < 1e-9
    assert abs(points.tail_rank(rows, 4, least=1).first().pct - 100 * 1 / 4) < 1e-9
    assert points.tail_rank(rows, 756).first().pct is None


def test_untracked_assets_are_refused(spark):
    try:
        market_queries.asset(spark, "/nowhere", "zzz")
    except KeyError as e:
        assert "not tracked" in str(e)
    else:
        raise AssertionError("an untracked asset was answered")
