"""The classifier's features, training steps and scores against plain loops."""

import numpy as np
import pyarrow as pa

from saltmarsh.llm import quality_classifier as qc
from saltmarsh.llm.arrowtext import raw


def plain_features(text):
    """Hashes by Python's unlimited integers."""
    data, mask = text.encode(), (1 << 64) - 1
    bucket = lambda value, kind: (((value ^ (kind * 0x517CC1B727220A)) * qc.MULTIPLIER & mask) >> 32) % qc.BUCKETS
    hashes = [sum((b + 1) * pow(0x100000001B3, i, 1 << 64) for i, b in enumerate(w)) & mask for w in data.split()]
    pairs = [7 if a == b else (a * 31 + b) & mask for a, b in zip(hashes, hashes[1:], strict=False)]
    grams = []
    for size in qc.GRAMS:
        for i in range(len(data) - size + 1):
            value = size
            for b in data[i : i + size]:
                value = (value << 8 | b) & mask
            grams.append(bucket(value, 2 + size))
    return [bucket(h, 1) for h in hashes], [bucket(p, 2) for p in pairs], grams


TEXTS = ["one two two three", "", "Ünïcode wörds hier", "x", "a b a b a b", "  spaced\tout\n"]


def test_features_and_weights():
    kinds = qc.features(*raw(pa.array(TEXTS)))
    cut = [np.split(ids, np.cumsum(counts)[:-1]) for ids, counts in kinds]
    for i, text in enumerate(TEXTS):
        want = plain_features(text)
        assert [sorted(c[i].tolist()) for c in cut] == [sorted(w) for w in want], text
        ids, weights = qc.sparse(tuple(c[i] for c in cut))
        by_bucket = {}
        for kind in want:
            for b in kind:
                by_bucket[b] = by_bucket.get(b, 0) + 1 / len(kind) / 3
        assert dict(zip(ids.tolist(), weights.tolist(), strict=True)).keys() == by_bucket.keys()
        assert all(abs(by_bucket[b] - w) < 1e-6 for b, w in zip(ids.tolist(), weights.tolist(), strict=True))


def test_scores_are_the_softmax_of_the_mean_vector():
    rng = np.random.default_rng(1)
    model = qc.Model(rng.normal(size=qc.BUCKETS).astype(np.float32), 0.3)
    got = qc.log_odds(pa.array(TEXTS), model)
    for text, odds in zip(TEXTS, got, strict=True):
        want = 0.3 + sum(sum(float(model.values[b]) for b in kind) / len(kind) / 3 for kind in plain_features(text) if kind)
        assert abs(odds - want) < 1e-5


def test_a_step_follows_the_gradient():
    """One epoch on one text of each class, by the formulas, with the same start."""
    ids, weights, labels = [np.array([3, 9], np.uint16), np.array([9, 70], np.uint16)], [np.array([0.4, 0.6], np.float32), np.array([0.5, 0.5], np.float32)], np.array([0, 1])
    model = qc.fit(ids, weights, labels, 0.5, epochs=1)
    random = np.random.default_rng(17)
    vectors, output, bias = random.uniform(-1, 1, (qc.BUCKETS, qc.DIMENSION)).astype(np.float32), random.normal(0, 0.1, (qc.DIMENSION, 2)).astype(np.float32), np.zeros(2)
    for step, row in enumerate(random.permutation(2)):
        pace = qc.RATE * (1 - step / 2)
        mean = sum(w * vectors[b] for b, w in zip(ids[row], weights[row], strict=True))
        e = np.exp(mean @ output + bias)
        error = e / e.sum() - np.eye(2)[labels[row]]
        back = output @ error
        output, bias = output - 0.1 * pace * np.outer(mean, error), bias - 0.1 * pace * error
        for b, w in zip(ids[row], weights[row], strict=True):
            vectors[b] -= 50 * pace * w * back
    assert np.allclose(model.values, vectors @ (output[:, 1] - output[:, 0]), atol=1e-4) and abs(model.bias - (bias[1] - bias[0])) < 1e-5


def test_folds_of_null_ids_and_repeated_labels(spark):
    docs = spark.createDataFrame([(None, "good words here"), (1, "bad words there"), (1, "bad words there")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = qc.score(docs, qc.train(docs, labels, folds=None)).collect()
    assert len(rows) == 3 and all(r["score"] < 0.5 for r in rows)  # the majority of the labels of id 1 is 0, the only class
