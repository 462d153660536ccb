"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shuffle_partitions, written


def with_least(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with the least ``value`` of their ``key`` (not null) as ``name``.

    The rows of a key are dealt into as many shares as a shuffle has partitions.  Each share gives its own
    least, the shares of a key the key's, and that goes back to the shares: no task holds a whole key.
    """
    shares = F.lit(shuffle_partitions(rows.sparkSession))
    dealt = rows.withColumn("__share", F.pmod(F.xxhash64(*rows.columns), shares))
    least = dealt.groupBy(key, "__share").agg(F.min(value).alias(name))
    least = least.withColumn(name, F.min(name).over(Window.partitionBy(key)))  # a row a share
    return dealt.join(least, [key, "__share"]).drop("__share")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternates two steps until nothing changes: every node links its larger neighbours, then its smaller
    ones, to the smallest node it knows.  The links of a node with many neighbours are dealt into shares.
    Every round is a table in the shared folder.
    """

    def both(links: DataFrame) -> DataFrame:
        return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    links = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    before = state(links)
    while True:
        known = both(links)
        known = with_least(known, "u", "v", "m").withColumn("m", F.least("u", "m"))
        large = known.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = with_least(large, "u", "v", "m").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        links = written(small.where("u > v").distinct(), "links")
        after = state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
