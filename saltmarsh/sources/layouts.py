"""Price tables of several layouts as one long table.

A download of prices has a column per (field, ticker), per (ticker, field), or flat columns; which one shows in the column names
alone, so the plan is made from the schema and no row is read for it.  Names of two levels are written as a pair, ``('Close', 'SPY')``.
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of a download, and those that hold the price, the best first.
FIELDS = ("Close", "Open", "High", "Low", "Volume", "Adj Close")
PRICE_FIELDS = ("Close", "close", "Adj Close")


def levels(column: str) -> tuple[str, str] | None:
    """Both names of a column of two levels; None for a flat one."""
    if not column.startswith("("):
        return None
    try:
        pair = ast.literal_eval(column)
    except (SyntaxError, ValueError):
        return None
    return (str(pair[0]), str(pair[1])) if isinstance(pair, tuple) and len(pair) == 2 else None


def price_columns(columns: list[str], tickers: list[str]) -> dict[str, str]:
    """The column of every ticker's price, for the tickers that have one."""
    pairs = {c: p for c in columns if (p := levels(c))}
    if pairs:
        by_field = next(iter(pairs.values()))[0] in FIELDS
        wanted = ("Close",) if by_field else PRICE_FIELDS
        of = {((b, a) if by_field else (a, b)): c for c, (a, b) in pairs.items()}  # by (ticker, field)
        return {t: of[t, f] for t in tickers if (f := next((f for f in wanted if (t, f) in of), None))}
    field = next((f for f in PRICE_FIELDS if f in columns), None)
    if field is None:
        return {}
    return {tickers[0]: field} if len(tickers) == 1 else {t: t for t in tickers if t in columns}


def prices(wide: DataFrame, date: str, tickers: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """(series, d, v) of the tickers found in ``wide``; ``aliases`` names a download's ticker as the library does.

    Null and NaN prices and rows without a date are left out, tickers without a price column too; with none found the table is empty.
    """
    found = price_columns([c for c in wide.columns if c != date], tickers)
    cells = [F.struct(F.lit((aliases or {}).get(t, t)).alias("series"), F.col(f"`{c}`").try_cast("double").alias("v")) for t, c in found.items()]
    if not cells:
        return wide.sparkSession.createDataFrame([], "series string, d date, v double")
    rows = wide.select(F.col(f"`{date}`").try_cast("date").alias("d"), F.explode(F.array(*cells)).alias("x")).select("x.series", "d", "x.v")
    return rows.where("d is not null and v is not null and not isnan(v)")


def two_headers(spark: SparkSession, path: str, date: str = "Date") -> DataFrame:
    """A CSV file with two header lines as a table with columns of two levels; the first column is the date.

    Lines whose first cell isn't a date, the headers among them, are left out.
    """
    raw = spark.read.csv(path)
    head = [line.split(",") for line in (r.value for r in spark.read.text(path).limit(2).collect())]
    names = [date, *(str((a.strip(), b.strip())) for a, b in zip(head[0][1:], head[1][1:], strict=True))]
    return raw.toDF(*names).where(F.col(date).try_cast("date").isNotNull())
