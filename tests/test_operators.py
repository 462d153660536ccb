"""Operators on small tables: guards, ties, nulls and empty input."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from saltmarsh.functions import scalars
from saltmarsh.operators import joins, points, windows
from saltmarsh.plans import model_queries, regime
from saltmarsh.sources import tables

SCHEMA = "series string, d date, v double"
DAY0 = dt.date(2020, 1, 1)


def series(spark, values, name="a", start=DAY0):
    return spark.createDataFrame([(name, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)], SCHEMA)


def one(df):
    return df.first()


def test_zscore_guards_and_constant(spark):
    assert one(points.tail_zscore(series(spark, range(62))))["z"] is None
    assert one(points.tail_zscore(series(spark, range(63))))["z"] is not None
    assert one(points.tail_zscore(series(spark, range(29)), guard=30))["z"] is None
    assert one(points.tail_zscore(series(spark, [5] * 70)))["z"] == 0.0
    assert points.tail_zscore(series(spark, [])).count() == 0


def test_rank_counts_strictly_below(spark):
    assert one(points.tail_rank(series(spark, [1, 2, 3, 3]), 4))["pct"] == 50.0
    assert one(points.tail_rank(series(spark, [1, 2, 3]), 4))["pct"] is None


def test_trend_needs_a_row_so_far_back(spark):
    for n, up in ((63, None), (64, 1)):
        rows = series(spark, range(n)).withColumn("up", windows.trend_up(F.col("v")))
        assert rows.orderBy(F.desc("d")).first()["up"] == up


def test_fridays(spark):
    days = [(dt.date(2024, 1, 4), dt.date(2024, 1, 5)), (dt.date(2024, 1, 5), dt.date(2024, 1, 5)), (dt.date(2024, 1, 6), dt.date(2024, 1, 12)), (dt.date(2024, 1, 7), dt.date(2024, 1, 12))]
    rows = spark.createDataFrame([(d, w) for d, w in days], "d date, w date").select("w", points.friday(F.col("d")).alias("got"))
    assert all(r["w"] == r["got"] for r in rows.collect())


def test_asof_before_the_first_row_is_null_and_same_day_counts(spark):
    left = series(spark, [1, 2, 3])
    right = series(spark, [10, 20], start=DAY0 + dt.timedelta(days=1)).withColumnRenamed("v", "w")
    got = joins.asof(left, right, "series", "d", ["w"]).orderBy("d").collect()
    assert [r["w"] for r in got] == [None, 10.0, 20.0]
    assert [r["v"] for r in got] == [1.0, 2.0, 3.0]


def test_calendar_return_of_zero_base(spark):
    got = one(points.back(series(spark, [0, 5, 7]), 2))
    assert got["before"] == 0.0 and got["ret"] is None and got["delta"] == 7.0
    assert one(points.back(series(spark, [1, 2]), 30))["before"] is None


def test_fresh_rows_win_with_nulls_too(spark):
    cached, fresh = series(spark, [1, 2, 3]), series(spark, [None, 9])
    got = {r["d"].day: r["v"] for r in tables.upsert(cached, fresh).collect()}
    assert got == {1: None, 2: 9.0, 3: 3.0}


def test_fill_and_nan(spark):
    rows = tables.series_of(spark.createDataFrame([("a", DAY0, float("nan")), ("a", DAY0, 4.0), ("b", DAY0 + dt.timedelta(days=1), 2.0)], SCHEMA), F.col("series"), F.col("d"), F.col("v"))
    got = {(r["series"], r["d"].day): r["v"] for r in tables.filled(rows).collect()}
    assert got == {("a", 1): 4.0, ("a", 2): 4.0, ("b", 1): None, ("b", 2): 2.0}


def test_distribution_without_losses_and_small_groups(spark):
    rows = spark.createDataFrame([("x", 0.5)] * 8 + [("y", 0.1)] * 7, "label string, fwd double")
    got = points.distribution(rows, ["label"]).collect()
    assert [r["label"] for r in got] == ["x"]
    assert abs(got[0]["payoff"] - 0.5 / 1e-6) < 1 and got[0]["ratio"] is None


def test_markov_row_of_zeros(spark):
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate("UUD")], "k string, t int, label string")
    got = {(r["from"], r["to"]): (r["n"], r["share"]) for r in points.markov(rows, "k", "t", "label", ["U", "D"]).collect()}
    assert got == {("U", "U"): (1, 0.5), ("U", "D"): (1, 0.5), ("D", "U"): (0, 0.0), ("D", "D"): (0, 0.0)}


def test_labels_and_goldilocks_edges(spark):
    rows = spark.createDataFrame([(x,) for x in (24, 25, 39, 40, 59, 60, 74, 75, None)], "s int").select(scalars.label(F.col("s")).alias("l"))
    assert [r["l"] for r in rows.collect()] == ["Risk Off", "Bearish", "Bearish", "Neutral", "Neutral", "Bullish", "Bullish", "Risk On", None]
    rows = spark.createDataFrame([(x,) for x in (0.5, 1.5, 2.0, 2.5, 3.5, 5.0, None)], "y double").select(scalars.goldilocks(F.col("y")).alias("g"))
    assert [round(r["g"], 6) for r in rows.collect()] == [-0.5, 1.0, 1.0, 1.0, -1.0, -1.0, 0.0]


def test_capped_pick_skips_a_used_name(spark):
    rows = spark.createDataFrame([("a", "b", 9.0), ("a", "c", 8.0), ("a", "d", 7.0), ("b", "c", 6.0), ("x", "y", None)], "l string, r string, s double")
    got = [(r["l"], r["r"]) for r in points.capped(rows, "s", "l", "r", 9, 2).orderBy("place").collect()]
    assert got == [("a", "b"), ("a", "c"), ("b", "c")]
    assert points.capped(rows.limit(0), "s", "l", "r", 9, 2).count() == 0


def test_history_equals_the_score_of_data_cut_at_a_date(spark):
    from saltmarsh.plans.model_queries import roles

    rows = roles(spark, "/root/testdata/sf0.001").persist()
    whole = {r["d"]: r["score"] for r in regime.history(rows).collect()}
    cut = sorted(whole)[200]
    part = {r["d"]: r["score"] for r in regime.history(rows.where(F.col("d") <= F.lit(cut))).collect()}
    rows.unpersist()
    assert part[cut] == whole[cut] and len(part) == 201


def test_kendall_with_ties_against_brute_force(spark):
    x, y = [1, 2, 2, 3, 5, 4], [3, 3, 1, 4, 6, 5]
    both = points.pairs(series(spark, x, "a").unionByName(series(spark, y, "b")))
    sign = lambda v: (v > 0) - (v < 0)
    ij = [(i, j) for i in range(6) for j in range(i)]
    s = sum(sign(x[i] - x[j]) * sign(y[i] - y[j]) for i, j in ij)
    nx, ny = (sum(abs(sign(z[i] - z[j])) for i, j in ij) for z in (x, y))
    assert abs(one(points.kendall(both))["tau"] - s / (nx * ny) ** 0.5) < 1e-12


def test_every_pair_has_a_correlation_row(spark, tmp_path):
    """Pairs of 1, 2, 72, 73 and 100 common dates: all there, with a value from 73 on, as the SQL says."""
    counts = {"a": 100, "b": 100, "c": 73, "e": 72, "f": 2, "g": 1}
    rows = [(s, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(100 + (i * (7 + k)) % (11 + k) + k)) for k, (s, n) in enumerate(counts.items()) for i in range(n)]
    spark.createDataFrame(rows, "o_orderpriority string, o_orderdate timestamp, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    found = {(r.a, r.b): (r.corr, r.recent, r.n) for r in model_queries.QUERIES["pair_correlation"](spark, str(tmp_path)).collect()}
    assert {p: n for p, (_, _, n) in found.items()} == {(x, y): min(counts[x], counts[y]) - 1 for x in counts for y in counts if x < y}
    assert {p for p, (corr, recent, _) in found.items() if corr is not None and recent is not None} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert all(corr is None and recent is None for corr, recent, n in found.values() if n < 72)
    duck = duckdb.connect()
    duck.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert {(a, b): (corr, recent, n) for a, b, corr, recent, n in duck.execute(model_queries.ORACLE["pair_correlation"]).fetchall()} == found
