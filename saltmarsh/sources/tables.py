"""Tables and series: Parquet in and out, revisions, forward fill.

A series table is long: ``series`` string, ``d`` date, ``v`` double, at most one row per series and date.
Daily aggregation happens right after the scan, with partial sums before the shuffle, so what windows
partition by series is bounded by the number of days, whatever the number of facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series_of(rows: DataFrame, series: Column, when: Column, value: Column) -> DataFrame:
    """Daily means per series; null and NaN observations are left out."""
    v = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return rows.select(series.alias("series"), when.cast("date").alias("d"), v.alias("v")).where("v is not null and d is not null").groupBy("series", "d").agg(F.avg("v").alias("v"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_of(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_of(table(spark, sf_dir, "lineitem"), F.concat("l_returnflag", "l_linestatus"), F.col("l_shipdate"), F.col("l_extendedprice"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_of(table(spark, sf_dir, "events"), F.col("event_type"), F.col("ts"), F.col("value"))


def unpivoted(wide: DataFrame, date: str, columns: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Long rows of a wide table, a series per column; ``aliases`` renames columns to series; nulls and NaN go."""
    names = aliases or {}
    cells = F.array(*(F.struct(F.lit(names.get(c, c)).alias("series"), F.col(c).cast("double").alias("v")) for c in columns))
    return wide.select(F.col(date).cast("date").alias("d"), F.explode(cells).alias("x")).select("x.series", "d", "x.v").where("v is not null and not isnan(v)")


def upsert(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Both tables by (series, d); a fresh row replaces a cached one, with a null value too."""
    both = cached.select("series", "d", "v", F.lit(0).alias("rank")).unionByName(fresh.select("series", "d", "v", F.lit(1).alias("rank")))
    return both.groupBy("series", "d").agg(F.max_by(F.struct("v"), "rank").alias("x")).select("series", "d", "x.v")


def filled(series: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Every series on every date of the calendar (all dates there are), each with its last value so far.

    The calendar has as many rows as days and the names as there are series, so the grid is days x series,
    which is the size of the result.
    """
    days = (calendar or series).select("d").distinct()
    names = series.select("series").distinct().agg(F.collect_list("series").alias("names"))
    grid = days.join(F.broadcast(names)).select("d", F.explode("names").alias("series"))
    own = Window.partitionBy("series").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(series, ["series", "d"], "left").select("series", "d", F.last("v", ignorenulls=True).over(own).alias("v"))


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def points(series: DataFrame) -> DataFrame:
    """JSON lines {"date", "value"} with values to five places, per series."""
    return series.where("v is not null").select("series", F.to_json(F.struct(F.date_format("d", "yyyy-MM-dd").alias("date"), F.round("v", 5).alias("value"))).alias("value"))


def parsed(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """``lines`` with the JSON objects of ``column`` as fields of ``schema`` and ``broken``, the text of a row that is none.

    A field that is missing, or that has a value of another kind, is null; only the latter makes a row broken.  A null line is not
    broken and has null fields.
    """
    with_text = f"{schema}, broken string"
    read = F.from_json(F.col(column), with_text, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    rest = [c for c in lines.columns if c != column]
    return lines.select(*rest, read.alias("__x")).select(*rest, "__x.*")


def read_points(lines: DataFrame, column: str = "value") -> DataFrame:
    """(d, v, broken) and the other columns of JSON lines as ``points`` writes them."""
    rest = [c for c in lines.columns if c != column]
    return parsed(lines, column, "date date, value double").select(*rest, F.col("date").alias("d"), F.col("value").alias("v"), "broken")


def tickers(names: Column) -> Column:
    """The names of an array that are not null or blank, each once, in order."""
    return F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (F.trim(x) != "")))


def write_context(row: DataFrame, path: str) -> None:
    """A context row as JSON under path/json and as a Markdown list, a line a column, under path/md."""
    row.write.mode("overwrite").json(f"{path}/json")
    lines = F.concat_ws("\n", *(F.concat(F.lit(f"- **{c}**: "), F.coalesce(F.col(c).cast("string"), F.lit("n/a"))) for c in row.columns))
    row.select(lines.alias("value")).write.mode("overwrite").text(f"{path}/md")
