"""Names, context files and moves between labels on hand-made rows."""

import datetime
import json

from pyspark.sql import functions as F

from saltmarsh.plans import outlook_queries
from saltmarsh.sources import tables


def test_tickers_are_kept_once_and_in_order(spark):
    row = spark.createDataFrame([(["SPY", " ", None, "TLT", "SPY", ""],), ([],), (None,)], "names array<string>")
    assert [r[0] for r in row.select(tables.tickers(F.col("names"))).collect()] == [["SPY", "TLT"], [], None]


def test_context_files(spark, tmp_path):
    row = spark.createDataFrame([("weekly_summary", 50, None)], "signal string, score int, credit double")
    tables.write_context(row, str(tmp_path))
    assert [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/json").collect()] == [{"signal": "weekly_summary", "score": 50}]
    assert [r[0] for r in spark.read.text(f"{tmp_path}/md").collect()] == ["- **signal**: weekly_summary", "- **score**: 50", "- **credit**: n/a"]


def history(spark, scores):
    first = datetime.date(2020, 1, 3)
    return spark.createDataFrame([(first + datetime.timedelta(weeks=i), x) for i, x in enumerate(scores)], "d date, score long")


def test_moves_of_the_last_label(spark):
    scores = [50, 30, 50, 50, 80, 50, 65] * 3 + [20, 50]  # from neutral: 3 down to 30, 3 to 50, 3 to 80, 3 to 65
    got = outlook_queries.moves_of(history(spark, scores)).collect()
    follow = [b for a, b in zip(scores, scores[1:], strict=False) if a == 50]
    shares = [sum(map(test, follow)) / len(follow) for test in (lambda x: x == 50, lambda x: x < 40, lambda x: x >= 60)]
    assert len(got) == 1 and got[0]["prev_k"] == 0
    assert [round(got[0][n], 12) for n in ("stay", "degrade", "improve")] == [round(x, 12) for x in shares]


def test_short_and_empty_histories(spark):
    short = outlook_queries.moves_of(history(spark, [50, 60])).collect()
    assert [tuple(r) for r in short] == [(2, None, None, None)]
    assert [tuple(r) for r in outlook_queries.moves_of(history(spark, [])).collect()] == [(None, None, None, None)]
