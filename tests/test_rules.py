"""Ladders of thresholds on single values, edges and missing inputs."""

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import rules


def one(spark, column, **values):
    types = ", ".join(f"{k} double" for k in values)
    return spark.createDataFrame([tuple(values.values())], types).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("level", "want"), [(None, "Unknown"), (0.75, "Steep"), (0.0, "Flat / Mildly positive"), (-0.25, "Shallow inversion"), (-0.26, "Deep inversion")])
def test_curve_label(spark, level, want):
    assert one(spark, rules.curve_label(F.col("v")), v=level) == want


@pytest.mark.parametrize(
    ("spread", "long", "short", "want"),
    [(0.1, 0.2, 0.1, "Bear steepener"), (0.1, -0.1, -0.2, "Bull steepener"), (-0.1, 0.1, 0.2, "Bear flattener"), (-0.1, -0.2, -0.1, "Bull flattener"), (0.05, 0.1, 0.05, "Stable"), (None, 0.1, 0.1, None)],
)
def test_curve_move(spark, spread, long, short, want):
    assert one(spark, rules.curve_move(F.col("a"), F.col("b"), F.col("c")), a=spread, b=long, c=short) == want


@pytest.mark.parametrize(("vix", "ratio", "want"), [(None, 1.2, "Unknown"), (12.0, 1.01, "Stress / Panic"), (31.0, None, "Stress / Panic"), (20.0, 1.0, "Neutral"), (20.1, 1.0, "Elevated concern"), (15.0, None, "Complacency")])
def test_volatility_label(spark, vix, ratio, want):
    assert one(spark, rules.volatility_label(F.col("v"), F.col("r")), v=vix, r=ratio) == want


@pytest.mark.parametrize(("real", "growth", "want"), [(None, 1.0, "Unknown"), (1.6, None, "Restrictive"), (1.6, 1.0, "Neutral"), (1.6, 3.1, "Accommodative"), (0.4, -1.0, "Accommodative"), (1.0, -1.0, "Tightening"), (1.0, None, "Tightening")])
def test_stance_label(spark, real, growth, want):
    assert one(spark, rules.stance_label(F.col("r"), F.col("g")), r=real, g=growth) == want


@pytest.mark.parametrize(("tau", "tail", "rho", "want"), [(-0.1, None, -0.2, 0.88), (0.03, 0.0, 0.5, 1.0), (0.2, 0.05, 0.2, 1.04), (0.5, 0.5, 0.45, 0.72), (0.2, 0.3, 0.9, 0.91 * 0.85)])
def test_copula_penalty(spark, tau, tail, rho, want):
    assert one(spark, rules.copula_penalty(F.col("t"), F.col("l"), F.col("r"))[1], t=tau, l=tail, r=rho) == pytest.approx(want)


def test_weighted_leaves_missing_parts_out(spark):
    row = spark.createDataFrame([(0.5, None), (None, None)], "a double, b double")
    got = [r["score"] for r in rules.weighted(row, {"a": (F.col("a"), 0.4), "b": (F.col("b"), 0.6)}).collect()]
    assert got == [pytest.approx(50.0), 50.0]
    full = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert rules.weighted(full, {"a": (F.col("a"), 0.4), "b": (F.col("b"), 0.6)}).first()["score"] == pytest.approx(40.0)


def test_current_guards_and_ties(spark):
    rows = spark.sql("select 'a' as series, date_add(date'2024-01-01', cast(id as int)) as d, cast(id % 10 as double) as v from range(29)")
    flat = spark.sql("select 'b' as series, date_add(date'2024-01-01', cast(id as int)) as d, 2.0d as v from range(30)")
    got = {r["series"]: r for r in rules.current(rows.unionByName(flat)).collect()}
    assert got["a"]["z"] is None and got["a"]["v"] == 8.0 and got["a"]["d7"] == 7.0 and got["a"]["pct"] is None
    assert got["b"]["z"] == 0.0 and got["b"]["r21"] == 0.0 and got["b"]["m63"] is None
    assert rules.current(rows.where("false")).count() == 0


def test_alignment_without_votes_is_fifty(spark):
    assets = spark.createDataFrame([("SPY", 1.0, None), ("TLT", 2.0, 1.0)], "series string, v double, m200 double")
    row = spark.createDataFrame([(50.0, 0.0, 1.0)], "score double, credit_z double, real double")
    got = {r["series"]: r["score"] for r in rules.alignment(assets, row, ("TLT",)).collect()}
    assert got == {"SPY": 50, "TLT": 85}
    strong = spark.createDataFrame([(80.0, -1.0, 0.2)], "score double, credit_z double, real double")
    got = {r["series"]: (r["score"], r["n_confirm"], r["n_against"]) for r in rules.alignment(assets, strong, ("TLT",)).collect()}
    assert got == {"SPY": (85, 3, 0), "TLT": (32, 1, 3)}


def test_trades_skip_no_view_and_discount(spark):
    dist = spark.createDataFrame([("a", 0.6, 2.0, 0.1), ("b", 0.6, 1.0, 0.1), ("c", 0.5, 1.0, 0.0)], "series string, win_rate double, payoff double, kelly double")
    view = spark.createDataFrame([("a", 3), ("b", -6), ("c", 0)], "series string, confluence long")
    got = {r["series"]: r for r in rules.trades(dist, view, F.lit(0.2)).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["alpha"] == pytest.approx(0.1 * 0.5 * 0.9)
    assert got["b"]["direction"] == "short" and not got["b"]["validated"] and got["b"]["alpha"] == 0.0
