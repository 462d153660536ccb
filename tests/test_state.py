"""Rules of the market's state on hand-made values."""

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import joins, points
from saltmarsh.plans import model_queries, regime, state_queries
from saltmarsh.sources import once

DAY = "series string, d date, v double"


def row_of(spark, **values):
    """A state with the given columns; the others are null."""
    cells = {n: F.lit(None).cast("double") for n in state_queries.STATE} | {"score": F.lit(50).cast("bigint"), "score_before": F.lit(50).cast("bigint")}
    return spark.range(1).select(*((F.lit(values[n]) if n in values else c).alias(n) for n, c in cells.items()))


def asked(spark, monkeypatch, name, **values):
    monkeypatch.setattr(state_queries, "state", lambda *_: row_of(spark, **values))
    return [r.asDict() for r in state_queries.QUERIES[name](spark, "").collect()]


def test_divergences_in_order_and_at_most_three(spark, monkeypatch):
    got = asked(spark, monkeypatch, "divergences", vix_z=3.0, credit_z=0.5, curve_z=-1.0, small_z=0.5, gld_z=1.0, real_z=3.0, hyg_quarter=-0.05, rsp_quarter=0.1)
    assert [(g["name"], g["place"]) for g in got] == [("GLD vs Real rates", 1), ("VIX vs HY OAS", 2), ("Curve vs IWM/SPY", 3)]
    assert asked(spark, monkeypatch, "divergences", vix_z=3.0, credit_z=0.0) == []  # a z-score of 0 counts as missing
    assert asked(spark, monkeypatch, "divergence_board", vix_z=3.0, credit_z=0.0)[0]["gap"] == 3.0


@pytest.mark.parametrize("score,boundary,alert", [(25, 25, "critical"), (33, 40, "warning"), (50, 40, "stable"), (68, 75, "warning"), (72, 75, "critical"), (90, 75, "stable")])
def test_nearest_boundary_and_the_lower_one_at_a_tie(spark, monkeypatch, score, boundary, alert):
    got = asked(spark, monkeypatch, "boundary_alert", score=score)[0]
    assert (got["boundary"], got["distance"], got["alert"]) == (boundary, abs(score - boundary), alert)


def test_tensions_and_none(spark, monkeypatch):
    names = lambda **v: [g["tension"] for g in asked(spark, monkeypatch, "fed_tensions", **v)]
    assert names(real=1.0, cpi_yoy=2.5) == ["none"]
    assert names(real=2.0, fed_growth=-0.01, cpi_yoy=3.5) == ["maximum tightening", "stagflation"]
    assert names(real=2.0, fed_growth=0.02) == ["restrictive rates, growing assets"]
    assert names(fwd=2.6, fwd_week=-0.1, cpi_yoy=1.0, be=2.4) == ["expectations elevated", "forward falling fast", "inflation may return"]


def test_alignment_of_pages(spark, monkeypatch):
    page = {g["asset"]: g["score"] for g in asked(spark, monkeypatch, "page_alignment", score=60, credit_z=-1.0, real=0.2, spy=100.0, spy_200=90.0, dollar_z=0.6)}
    assert page == {"SPY": 85, "QQQ": 85, "GLD": 50, "BTC": 50, "SLV": 50, "XLU": 50, "XLC": 50}
    quick = {g["asset"]: (g["score"], g["label"]) for g in asked(spark, monkeypatch, "quick_alignment", score=60, real=0.2, dollar_z=0.6)}
    assert quick == {"SPY": (80, "Bullish"), "QQQ": (85, "Bullish"), "GLD": (55, "Tailwind"), "BTC": (55, "Tailwind"), "SLV": (55, "Tailwind")}


def test_priority_is_the_highest_that_holds(spark, monkeypatch):
    top = lambda **v: asked(spark, monkeypatch, "priority_signal", **v)[0]["signal"]
    assert top() == "weekly_summary" and top(vix_pct=90.0, credit_week=0.3) == "credit_move" and top(vratio=1.1, vix_pct=90.0) == "vratio_panic"


def test_net_liquidity_keeps_common_dates(spark):
    rows = [("a", "2024-01-01", 10.0), ("a", "2024-01-02", 11.0), ("b", "2024-01-02", 3.0), ("c", "2024-01-03", 1.0)]
    df = spark.createDataFrame(rows, "series string, d string, v double").withColumn("d", F.col("d").cast("date"))
    net = lambda legs: [(str(r["d"]), r["v"]) for r in joins.net_of(df, "a", legs).orderBy("d").collect()]
    assert net(["b"]) == [("2024-01-02", 8.0)] == net(["b", "missing"])
    assert net(["c"]) == [("2024-01-01", 10.0), ("2024-01-02", 11.0)] == net(["b", "c"])  # no date in common: as it is


def test_small_companies_stand_for_breadth_where_it_is_missing(spark):
    days = [f"2023-{m:02d}-{d:02d}" for m in range(1, 5) for d in range(1, 29)]
    rows = [(s, d, 100.0 + i * k) for i, d in enumerate(days) for s, k in (("IWM", 1.0), ("SPY", 0.1), ("y10", 0.01), ("VIX", 0.0), ("VIX3M", 0.1))]
    df = spark.createDataFrame(rows, "series string, d string, v double").withColumn("d", F.col("d").cast("date"))
    got = regime.snapshot(df).where("d = 'now'").first()
    assert not got["broad"] and got["breadth_n"] == len(days) and got["growth"] > 0
    both = df.unionByName(df.where("series = 'SPY'").withColumn("series", F.lit("RSP")))
    assert regime.snapshot(both).where("d = 'now'").first()["broad"]


def test_stances_mix_and_groups(spark):
    names = {"score": 72, "missing": 1, "penalty": -0.05, "internals_level": 3.0, "internals_z": -0.6, "monetary_level": 0.4, "monetary_z": -0.4, "curve_level": 1.2, "curve_z": 0.5, "fiscal_z": -0.6, "breadth_z": 0.4, "growth_z": 0.6}
    got = regime.result(spark.range(1).select(*(F.lit(v).alias(n) for n, v in names.items()))).first()
    assert (got["equities"], got["credit"], got["duration"], got["dollar"], got["confidence"]) == ("Overweight", "Overweight", "Overweight", "Favour USD", "Medium")
    assert got["summary"] == "credit tightening, curve steep, dollar soft, breadth improving, credit/equity divergence warning"
    assert got["groups"] == "Cyclicals; High Beta; Financials (steep curve); Growth / Long Duration; Gold; High Yield Credit; Industrials / Cyclicals"
    assert (got["mix_equities"], got["mix_credit"], got["mix_duration"], got["mix_cash"]) == (70, 20, 5, 5)


def test_weekly_changes_of_pairs_need_a_year(spark):
    rows = [("a", "b", i, float(100 + i % 7), float(50 + i % 5)) for i in range(7 * 60)]
    both = spark.createDataFrame(rows, "a string, b string, i int, x double, y double").withColumn("d", F.expr("date_add(date'2020-01-03', i)"))
    assert points.pair_returns(both).count() >= 59 and points.pair_returns(both.where("i < 300")).count() == 0


def test_history_and_snapshot_share_statistics_dealt_to_all_cores(spark, monkeypatch):
    taken, of = [], regime.statistics
    monkeypatch.setattr(regime, "statistics", lambda rows: taken.append(of(rows)) or taken[-1])
    once.forget(spark)
    model_queries.score_history(spark, "/root/testdata/sf0.001", state_queries.ALL)
    state_queries.snapshot_all(spark, "/root/testdata/sf0.001")
    assert len(taken) == 1
    assert taken[0].rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
