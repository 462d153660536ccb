"""The version of the facts comes from a listing of their files."""

import os

from saltmarsh.sources import once


def test_no_fact_is_read(spark, tmp_path):
    for table in ("orders", "lineitem"):
        (tmp_path / f"{table}.parquet").mkdir()
        (tmp_path / f"{table}.parquet" / "part-0.parquet").write_bytes(b"not a table")
    version = lambda: once.version(spark, str(tmp_path), ("orders", "lineitem"))
    first = version()
    assert version() == first
    (tmp_path / "orders.parquet" / "part-1.parquet").write_bytes(b"nor this")
    second = version()
    os.utime(tmp_path / "lineitem.parquet" / "part-0.parquet", (1, 1))
    assert len({first, second, version()}) == 3
