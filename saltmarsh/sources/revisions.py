"""A series table that is revised by a stream of files.

Every micro-batch adds its newest revisions as a folder of its own, so nothing is read or rewritten when revisions arrive and a
batch that is run again after a failure replaces itself.  Readers take the newest revision of every (series, d): the
result does not depend on the order or the number of batches that brought them, however late one is.  ``compacted``
writes that result as one table when the folders become many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: ``asof`` is when a value was published; v may be null, which takes a value back.
REVISION = "series string, d date, v double, asof timestamp"


def newest(revisions: DataFrame) -> DataFrame:
    """The newest revision of every (series, d); of equally new ones the largest value, a null below any.  Null keys are left out."""
    last = F.max(F.struct("asof", "v"))
    return revisions.where("series is not null and d is not null").groupBy("series", "d").agg(last.alias("x")).select("series", "d", "x.v", "x.asof")


def keep(revisions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes a stream of revisions (``REVISION``) into the table at ``path`` until the files there are at the start are read."""

    def save(batch: DataFrame, number: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return revisions.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """(series, d, v) of the table at ``path`` with all revisions so far."""
    return newest(spark.read.schema(REVISION).option("recursiveFileLookup", "true").parquet(path)).select("series", "d", "v")


def compacted(spark: SparkSession, path: str, target: str) -> None:
    """The newest revisions of the table at ``path`` as the first batch of a table at ``target``."""
    rows = spark.read.schema(REVISION).option("recursiveFileLookup", "true").parquet(path)
    newest(rows).write.mode("overwrite").parquet(f"{target}/batch=compacted")
