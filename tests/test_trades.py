"""Dimensions of candidate trades on hand-made values."""

from pyspark.sql import functions as F

from saltmarsh.plans import trade_queries

ASSETS = [("GLD", 10.0, 9.0, 1.0), ("UUP", 10.0, 11.0, -1.0), ("TLT", 10.0, 9.0, 0.1), ("XLF", 10.0, 11.0, 0.9), ("SPY", 10.0, None, 1.0)]


def test_dimensions_of_gold_dollar_bonds_banks_and_shares(spark):
    state = {"score": 30, "real": 0.2, "curve_z": 0.6, "real_z": -0.2, "credit_z": 0.8, "dollar_z": -0.9, "cpi_z": None, "be_z": 0.7}
    row = spark.range(1).select(*(F.lit(v).cast("double").alias(n) for n, v in state.items()))
    rates = spark.createDataFrame([("GLD", 0.7), ("UUP", 0.4)], "series string, win_rate double")
    assets = spark.createDataFrame(ASSETS, "series string, v double, a63 double, rz double")
    got = {(r["series"], r["side"]): r for r in trade_queries.candidates(assets, row, rates).collect()}
    assert set(got) == {("GLD", 1), ("UUP", 1), ("UUP", -1), ("TLT", 1), ("TLT", -1), ("XLF", 1), ("SPY", 1)}
    want = {  # regime, credit, real rate, curve, dollar, inflation, momentum, history
        ("GLD", 1): (1, 1, 1, 0, 1, 1, 1, 1), ("UUP", 1): (1, 1, -1, 1, -1, 0, -1, -1), ("UUP", -1): (-1, -1, 0, 0, 1, 0, 1, 1), ("TLT", 1): (1, 1, 1, -1, 0, -1, 0, 0),
        ("TLT", -1): (-1, -1, 0, -1, 0, 0, 0, 0), ("XLF", 1): (-1, -1, 0, 1, 0, 0, 0, 0), ("SPY", 1): (-1, -1, 1, 1, 1, 0, 0, 0),
    }
    for key, dimensions in want.items():
        assert tuple(got[key][n] for n in trade_queries.DIMENSIONS) == dimensions, key
    gold = got["GLD", 1]
    assert (gold["n_confirm"], gold["n_against"], gold["wr"]) == (7, 0, 0.7)
    assert got["TLT", -1]["wr"] == 1 - trade_queries.UNKNOWN
