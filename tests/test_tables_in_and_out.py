"""Layouts of price tables, revisions by stream, JSON in, spans of dates."""

import datetime as dt
import itertools
import random
import shutil

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import intervals
from saltmarsh.sources import layouts, once, revisions, tables

DAYS = ["2024-01-01", "2024-01-02", "2024-01-03"]


def long(df):
    return sorted((r.series, str(r.d), r.v) for r in df.collect())


def test_layouts_give_one_table(spark):
    want = sorted([("VIX", DAYS[0], 20.0), ("VIX", DAYS[2], 21.0), ("BRK.B", DAYS[0], 1.0), ("BRK.B", DAYS[1], 2.0), ("BRK.B", DAYS[2], 3.0)])
    rows = [(DAYS[0], 20.0, 1.0, 9.0, None), (DAYS[1], None, 2.0, 9.0, 5.0), (DAYS[2], 21.0, 3.0, float("nan"), None), (None, 1.0, 1.0, 1.0, 1.0)]
    alias = {"^VIX": "VIX"}

    def made(names):
        return spark.createDataFrame(rows, "Date string, a double, b double, c double, e double").toDF("Date", *map(str, names))

    field_first = made([("Close", "^VIX"), ("Close", "BRK.B"), ("Open", "^VIX"), ("Adj Close", "BRK.B")])
    ticker_first = made([("^VIX", "Adj Close"), ("BRK.B", "close"), ("^VIX", "Open"), ("BRK.B", "Adj Close")])
    flat = made(["^VIX", "BRK.B", "close", "Volume"])
    for df in (field_first, ticker_first, flat):
        assert long(layouts.prices(df, "Date", ["^VIX", "BRK.B", "MISSING"], alias)) == want


def test_fields_by_preference_and_single_tickers(spark):
    assert layouts.price_columns(["Adj Close", "close", "Open"], ["SPY"]) == {"SPY": "close"}
    assert layouts.price_columns(["Adj Close", "Open"], ["SPY"]) == {"SPY": "Adj Close"}
    assert layouts.price_columns(["Open", "SPY"], ["SPY", "QQQ"]) == {}
    assert layouts.price_columns([str(("SPY", "Open")), str(("SPY", "Adj Close"))], ["SPY"]) == {"SPY": str(("SPY", "Adj Close"))}
    # With the field first only Close counts.
    assert layouts.price_columns([str(("Adj Close", "SPY"))], ["SPY"]) == {}
    assert layouts.levels("(not a pair") is None and layouts.levels("Close") is None
    empty = layouts.prices(spark.createDataFrame([("2024-01-01", 1.0)], "Date string, Open double"), "Date", ["SPY"])
    assert empty.collect() == [] and empty.columns == ["series", "d", "v"]


def test_two_header_lines(spark, tmp_path):
    file = tmp_path / "prices.csv"
    file.write_text("Price,Close,Close,Open\nTicker,SPY,QQQ,SPY\nDate,,,\n2024-01-01,1.5,2,9\n2024-01-02,,3,9\n")
    got = long(layouts.prices(layouts.two_headers(spark, str(file)), "Date", ["SPY", "QQQ"]))
    assert got == [("QQQ", DAYS[0], 2.0), ("QQQ", DAYS[1], 3.0), ("SPY", DAYS[0], 1.5)]


def stamp(n):
    return dt.datetime(2024, 5, 1) + dt.timedelta(minutes=n)


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    """Files arrive in any order, over several runs and with a run repeated; the table is that of the newest revisions."""
    rng = random.Random(5)
    rows = [(rng.choice("ab"), dt.date(2024, 1, 1 + rng.randrange(4)), rng.choice([None, 1.0, 2.0, 3.0]), stamp(rng.randrange(12))) for _ in range(60)]
    want = {}
    for s, d, v, t in rows:
        want[s, d] = max(want.get((s, d), (t, v)), (t, v), key=lambda x: (x[0], x[1] is not None, x[1] or 0))
    want = sorted((s, str(d), v) for (s, d), (_, v) in want.items())
    batches = [rows[i::4] for i in range(4)]
    for nth, order in enumerate(itertools.islice(itertools.permutations(range(4)), 0, 24, 8)):
        source, path, checkpoint = (str(tmp_path / f"{x}{nth}") for x in ("in", "table", "checkpoint"))
        for step, i in enumerate(order):
            spark.createDataFrame(batches[i], revisions.REVISION).coalesce(1).write.mode("append").parquet(source)
            if step % 2:
                revisions.keep(spark.readStream.schema(revisions.REVISION).parquet(source), path, checkpoint).awaitTermination()
        revisions.keep(spark.readStream.schema(revisions.REVISION).parquet(source), path, checkpoint).awaitTermination()
        assert sorted((r.series, str(r.d), r.v) for r in revisions.current(spark, path).collect()) == sorted(want, key=lambda x: x[:2])
        # A batch that ran twice, in a folder of its own, changes nothing; nor does compaction.
        revisions.newest(spark.createDataFrame(batches[0], revisions.REVISION)).write.parquet(f"{path}/batch=again")
        revisions.compacted(spark, path, f"{path}-small")
        assert sorted((r.series, str(r.d), r.v) for r in revisions.current(spark, f"{path}-small").collect()) == sorted(want, key=lambda x: x[:2])


def test_stream_equals_upsert(spark, tmp_path):
    cached = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 1, 2), 2.0)], "series string, d date, v double")
    fresh = spark.createDataFrame([("a", dt.date(2024, 1, 2), 9.0), ("b", dt.date(2024, 1, 2), None)], "series string, d date, v double")
    for n, df in enumerate((cached, fresh)):
        df.withColumn("asof", F.lit(stamp(n))).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(revisions.REVISION).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    revisions.keep(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, revisions.current(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, tables.upsert(cached, fresh).collect()))


def test_json_rows_good_broken_and_partial(spark):
    lines = ['{"date": "2024-01-01", "value": 1.5}', '{"date": "2024-01-02"}', '{"value": 2}', "{broken", '{"date": "2024-01-03", "value": "x"}', None, "", '{"date": "2024-01-04", "value": 3, "more": [1]}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    got = {r.i: (str(r.d) if r.d else None, r.v, r.broken) for r in tables.read_points(df).collect()}
    assert got[0] == ("2024-01-01", 1.5, None) and got[1] == ("2024-01-02", None, None) and got[2] == (None, 2.0, None)
    assert got[3] == (None, None, "{broken") and got[4] == ("2024-01-03", None, lines[4]) and got[5] == (None, None, None) and got[7] == ("2024-01-04", 3.0, None)
    series = spark.createDataFrame([("a", dt.date(2024, 1, 1), 0.123456789), ("a", dt.date(2024, 1, 2), None)], "series string, d date, v double")
    back = tables.read_points(tables.points(series)).collect()
    assert [(r.series, str(r.d), r.v, r.broken) for r in back] == [("a", "2024-01-01", 0.12346, None)]


def test_every_overlap_once(spark):
    rng = random.Random(7)
    day = dt.date(2020, 1, 1)

    def spans(n):
        out = []
        for i in range(n):
            a = rng.randrange(-900, 900)
            out.append((rng.choice("xy"), i, day + dt.timedelta(a), day + dt.timedelta(a + rng.choice([0, 1, 30, 400, -3]))))
        return [*out, ("x", 98, None, day), ("x", 99, day, None)]

    left, right = spans(60), spans(50)
    a = spark.createDataFrame(left, "k string, i int, s date, e date")
    b = spark.createDataFrame(right, "k string, j int, f date, t date")
    want = sorted((i, j) for k, i, s, e in left for m, j, f, t in right if k == m and None not in (s, e, f, t) and s <= e and f <= t and s <= t and f <= e)
    for width in (1, 30, 182):
        got = intervals.overlaps(a, b, ["k"], ("s", "e"), ("f", "t"), width)
        assert got.columns == ["k", "i", "s", "e", "j", "f", "t"]
        assert sorted((r.i, r.j) for r in got.collect()) == want


@pytest.mark.parametrize("start, end, want", [
    (0, 40, [("A", 0, 14), ("B", 14, 28), ("A", 28, 40)]), (10, 12, []), (9, 16, [("B", 9, 16)]), (3, 20, [("A", 3, 14), ("B", 14, 20)]), (14, 14, [("B", 14, 14)]), (30, 90, [("A", 30, 42), ("C", 42, 90)]),
])
def test_bands_are_cut_to_the_slice(spark, start, end, want):
    day = dt.date(2020, 1, 3)
    labels = spark.createDataFrame([(day + dt.timedelta(7 * i), x) for i, x in enumerate("AABBAAC")], "d date, label string")
    slices = spark.createDataFrame([("s", day + dt.timedelta(start), day + dt.timedelta(end))], "series string, start date, end date")
    got = intervals.bands(slices, labels, ["series"]).orderBy("nth").collect()
    assert [(r.label, (r["from"] - day).days, (r.to - day).days) for r in got] == want


def test_tables_are_written_once_for_a_version(spark, tmp_path):
    folder, made = str(tmp_path), []
    for name, n in (("orders", 3), ("lineitem", 2)):
        spark.range(n).write.parquet(f"{folder}/{name}.parquet")

    def make():
        made.append(1)
        return spark.read.parquet(f"{folder}/orders.parquet").selectExpr("count(*) as n")

    assert [once.once(spark, folder, "t", make).first().n for _ in range(3)] == [3, 3, 3] and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    assert once.once(spark, folder, "t", make).first().n == 5 and len(made) == 2
    gone = once._WRITTEN[spark.sparkContext.applicationId, "t", folder][1]
    shutil.rmtree(gone.removeprefix("file:"))
    assert once.once(spark, folder, "t", make).first().n == 5 and len(made) == 3  # cleared away, so written again
    once.forget(spark)
    assert once.once(spark, folder, "t", make).first().n == 5 and len(made) == 4
