"""Recall of the index on vectors of very different lengths, most of whose codes are alike."""

import numpy as np

from saltmarsh.llm import ann


def recall(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(df, df.where("vec_id % 100 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in range(0, len(x), 100):
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        far[i] = np.inf
        hits += len(found[i] & set(np.argsort(far, kind="stable")[:10].tolist()))
    return hits / (len(x) / 100 * 10)


def test_lengths_over_many_magnitudes(spark):
    random = np.random.default_rng(1)
    assert recall(spark, random.normal(size=(4000, 32)) * np.exp(random.normal(size=(4000, 1)) * 3)) >= 0.95


def test_tight_group_among_others(spark):
    random = np.random.default_rng(2)
    x = random.normal(size=(4000, 32))
    x[:2000] = x[0] + random.normal(size=(2000, 32)) * 1e-4
    assert recall(spark, random.permutation(x)) >= 0.95
