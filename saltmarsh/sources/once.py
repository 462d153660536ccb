"""Small tables that many queries read, computed once for each version of the facts.

A table is written to the folder that driver and executors share (``spark.checkpoint.dir``; only where that is unset and
Spark is one local process, a temporary folder of this machine) and read from there by every later query of the application.
Its version is the names, lengths and times of the files that it comes from, so changed facts are read anew.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of every (application, name, folder of facts): the version and where its table is.
_WRITTEN: dict[tuple[str, str, str], tuple[str, str]] = {}


def shared_dir(spark: SparkSession) -> str | None:
    """The folder that driver and executors share; None on a cluster that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        base = tempfile.mkdtemp(prefix="saltmarsh-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/") if base else None


def version(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> str:
    """A digest of the files of ``tables``: a listing, which costs a row a file and not one a fact."""
    seen = set()
    for table in tables:
        files = spark.read.format("binaryFile").load(f"{sf_dir}/{table}.parquet").select("path", "length", F.col("modificationTime").cast("string"))  # contents stay unread
        seen |= {tuple(r) for r in files.collect()}
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], tables: tuple[str, ...] = ("orders", "lineitem")) -> DataFrame:
    """The table that ``make`` gives, written the first time it is asked for since ``tables`` last changed, or since it was cleared away.

    Without a shared folder it is computed anew each time.
    """
    folder = shared_dir(spark)
    if folder is None:
        return make()
    key, now = (spark.sparkContext.applicationId, name, sf_dir), version(spark, sf_dir, tables)
    known, path = _WRITTEN.get(key, ("", ""))
    if known == now:
        try:
            return spark.read.parquet(path)
        except AnalysisException as gone:
            if gone.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    path = f"{folder}/saltmarsh-{name}-{uuid.uuid4().hex}"
    make().write.parquet(path)
    _WRITTEN[key] = (now, path)
    return spark.read.parquet(path)


def forget(spark: SparkSession) -> None:
    """Later queries of this application compute their tables anew."""
    for key in [k for k in _WRITTEN if k[0] == spark.sparkContext.applicationId]:
        del _WRITTEN[key]
