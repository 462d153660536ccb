"""The sample that the classifier learns from never comes to the driver."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.classic.dataframe import DataFrame as Classic

from saltmarsh.llm import quality_classifier


def test_sample_stays_with_its_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "good plain words" if i % 2 else "bad worse worst") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")

    def refused(*_):
        raise AssertionError("brought to the driver")

    for kind in (DataFrame, Classic):
        monkeypatch.setattr(kind, "toArrow", refused)
    model = quality_classifier.train(docs, labels)
    assert model.values.shape == (quality_classifier.BUCKETS,) and np.abs(model.values).sum() > 0
    assert quality_classifier.train(docs.limit(0), labels).bias == 0.0
