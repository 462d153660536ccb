"""Named charts: ranges, points, unknown names, charts without data."""

import json

import pytest

from saltmarsh.plans import chart_queries

SF = "/root/testdata/sf0.001"


def test_points_of_a_range(spark):
    got = [json.loads(r["value"]) for r in chart_queries.chart(spark, SF, "curve_2s10s", "1m").collect()]
    assert len(got) == 21 and all(set(p) == {"date", "value"} for p in got)
    assert chart_queries.chart(spark, SF, "curve_2s10s", "no range").count() == chart_queries.chart(spark, SF, "curve_2s10s").count() <= 252


def test_unknown_and_empty_charts(spark):
    with pytest.raises(KeyError, match="unknown series"):
        chart_queries.chart(spark, SF, "no_such_series")
    assert chart_queries.chart(spark, SF, "equity_risk_premium").count() == 0
    assert chart_queries.known() == sorted(set(chart_queries.known())) and "net_liquidity" in chart_queries.known()
