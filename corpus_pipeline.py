"""Corpus pipeline: quality, near-duplicates, secrets, mixing, packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns the next docs.

Rows are handled by their whole contents, never by doc_id alone.  Null, empty and very long texts are scored,
compared, scanned, mixed and packed like others (a null as the empty text, and it leaves the secrets stage as
it came).  Rows with a null doc_id or one that others share are documents of their own; of whole repeated
rows and of near copies one stays, the smallest doc_id, of equal ones the smallest hash.  A score of exactly 0.5
is kept.  Empty tables go through all stages and give no rows.  Columns other than those of documents, clashing
names included, are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm import mixing, near_copies, packing, quality_classifier, secrets_scan
from saltmarsh.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality_classifier.train(docs, labels(spark, sf_dir))
    return quality_classifier.score(docs.select(*COLUMNS), model, keep=COLUMNS).where("score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies one row stays, the one with the smallest doc_id.

    Near copies have a Jaccard similarity of five-word shingles of 0.8 or more; SimHash keys and minimum hashes find them.
    """
    return near_copies.first_of_each(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values are replaced by a mark."""
    return secrets_scan.redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is taken as often as the target weights ask for."""
    return mixing.mixed(docs.select(*COLUMNS), labels(spark, sf_dir))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicates), ("secrets", secrets), ("mixing", mix), ("packing", pack)]

#: The classifier, the fingerprints' bit sums and the vocabulary can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
