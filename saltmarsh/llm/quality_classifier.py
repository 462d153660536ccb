"""Supervised subword embeddings for document quality.

Words, word pairs and byte n-grams are hashed to buckets; each bucket has a learned vector.  A document's
vector is the mean over the three kinds of the mean vector of its features of that kind; a softmax over
the two classes follows.  Vectors and output weights are learned by stochastic gradient descent in numpy
from a bounded sample of labelled rows, as many of either class where there are; the output bias is then
moved back to the share of the classes among all labelled rows.  The network is linear after the
embedding, so a document is scored with one number per bucket, over its whole text.  The driver holds six bytes
for each different bucket of a sampled text, however long: at most 384 KB a text.

Labels: rows with a null doc_id or label are left out; of repeated labels of a doc_id the majority counts
(a tie is label 1).  Without any label all scores are 0.5; with one class only, the score is that class.
Null texts are empty texts, whose score is the bias alone.  Documents keep repeated rows; an empty table
gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import pieces, plain, raw, sums_by, word_spans

BUCKETS = 1 << 16
GRAMS = (3, 5)
DIMENSION = 8
EPOCHS = 12
RATE = 2.0
#: Bound on the labelled rows that the model is fitted on.
SAMPLE = 2400

MULTIPLIER = 0x9E3779B97F4A7C15
KINDS = 3


def mixed(values: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of 64-bit hashes, apart for each kind."""
    values = (values ^ np.uint64(kind * 0x51_7CC1_B727_220A)) * np.uint64(MULTIPLIER)
    return ((values >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: the buckets of all texts one after another, and the number of each text.  Kinds: words, word pairs, byte n-grams."""
    n, texts = len(data), len(offsets) - 1
    none = np.zeros(texts, np.int64)
    if not n:
        return [(np.zeros(0, np.int32), none)] * KINDS
    starts, stops, words = word_spans(data, offsets)
    with np.errstate(over="ignore"):
        factors = np.full(n, 0x100000001B3, dtype=np.uint64)
        factors[0] = 1
        factors = np.multiply.accumulate(factors)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * factors)])
        inverse = pow(0x100000001B3, -1, 1 << 64)
        back = np.full(n, inverse, dtype=np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)
        word_hash = (upto[stops] - upto[starts]) * back[starts]
        word = mixed(word_hash, 1)
        text_of = np.repeat(np.arange(texts), words)
        follows = np.flatnonzero(text_of[1:] == text_of[:-1]) if len(text_of) else np.zeros(0, np.int64)
        left, right = word_hash[follows], word_hash[follows + 1]
        pair = np.where(left == right, np.uint64(7), left * np.uint64(31) + right)  # a word said twice is one feature, whatever the word
        pairs = np.maximum(words - 1, 0)
        grams, ids, end_of = [], [], np.repeat(offsets[1:], np.diff(offsets))
        wide = data.astype(np.uint64)
        for size in GRAMS:
            if n < size:
                continue
            value = np.full(n - size + 1, size, dtype=np.uint64)
            for k in range(size):
                value = (value << np.uint64(8)) | wide[k : n - size + 1 + k]
            inside = np.flatnonzero(np.arange(n - size + 1) + size <= end_of[: n - size + 1])
            grams.append(mixed(value[inside], 2 + size))
            ids.append(inside)
    counts = [np.maximum(np.diff(offsets) - size + 1, 0) for size in GRAMS if n >= size]
    if not grams:
        return [(word, words), (mixed(pair, 2), pairs), (np.zeros(0, np.int32), none)]
    place = np.concatenate(ids)
    order = np.argsort(np.searchsorted(offsets, place, side="right"), kind="stable")
    return [(word, words), (mixed(pair, 2), pairs), (np.concatenate(grams)[order], np.sum(counts, axis=0))]


def sparse(kinds: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of a text's features (16 bits) and their weights: the mean over the kinds of their share of the kind."""
    ids = np.concatenate(kinds)
    weights = np.concatenate([np.full(len(k), 1 / max(len(k), 1) / len(kinds)) for k in kinds])
    different, place = np.unique(ids, return_inverse=True)
    return different.astype(np.uint16), np.bincount(place, weights=weights, minlength=len(different)).astype(np.float32)


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            kinds = features(*raw(plain(part.column("text"))))
            by_kind = [np.split(ids, np.cumsum(counts)[:-1]) for ids, counts in kinds]
            ids, weights = [], []
            for own in zip(*by_kind, strict=True):
                at, weight = sparse(own)
                ids.append(at.tobytes())
                weights.append(weight.tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(ids, type=pa.binary()), pa.array(weights, type=pa.binary())], names=["doc_id", "label", "ids", "weights"])


@dataclass
class Model:
    """One number per bucket: what a feature adds to the log odds of class 1; and the bias."""

    values: np.ndarray
    bias: float


def fit(ids: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, share: float, epochs: int = EPOCHS, rate: float = RATE, dimension: int = DIMENSION) -> Model:
    """``share``: of class 1 among all labelled rows."""
    flat = np.zeros(BUCKETS, dtype=np.float32)
    if not len(labels):
        return Model(flat, 0.0)
    if labels.min() == labels.max():
        return Model(flat, 30.0 if labels[0] else -30.0)
    random = np.random.default_rng(17)
    vectors = random.uniform(-1, 1, (BUCKETS, dimension)).astype(np.float32)
    output = random.normal(0, 0.1, (dimension, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    steps = epochs * len(labels)
    step = 0
    for _ in range(epochs):
        for row in random.permutation(len(labels)):
            at, weight = ids[row], weights[row]
            pace = rate * (1 - step / steps)
            step += 1
            mean = weight @ vectors[at]
            logits = mean @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[row]] -= 1
            back = output @ p
            output -= 0.1 * pace * np.outer(mean, p)
            bias -= 0.1 * pace * p
            vectors[at] -= (pace * weight)[:, None] * back * 50
    values = vectors @ (output[:, 1] - output[:, 0])
    in_sample = labels.mean()
    shift = np.log(share / (1 - share)) - np.log(in_sample / (1 - in_sample))
    return Model(values.astype(np.float32), float(bias[1] - bias[0] + shift))


def fitted(sample: pa.Table) -> pa.Table:
    """The model of the features of a whole sample, which is bounded, as one row."""
    order = np.argsort(sample["doc_id"].to_numpy(), kind="stable")
    marked = sample["label"].to_numpy().astype(np.int64)[order]
    ids, weights = ([np.frombuffer(column[int(i)].as_py(), dtype=kind) for i in order] for column, kind in ((sample["ids"], np.uint16), (sample["weights"], np.float32)))
    model = fit(ids, weights, marked, sample["share"][0].as_py())
    return pa.table({"weights": pa.array([model.values.tobytes()], type=pa.binary()), "bias": pa.array([model.bias])})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int | None = 3, held_out: int = 1, sample: int = SAMPLE) -> Model:
    """Fits on labelled rows outside the held-out fold (all, if ``folds`` is None)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id is not null and label is not null")
    marks = marks.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    if folds:
        marks = marks.where(F.crc32(key) % folds != held_out)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = marks.join(texts.select("doc_id"), "doc_id", "left_semi").cache()
    shares = {int(r["label"]): int(r["n"]) for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.where("label = 0").orderBy(*order).limit(sample // 2).unionByName(marks.where("label = 1").orderBy(*order).limit(sample // 2))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    share = shares.get(1, 0) / max(sum(shares.values()), 1)
    sampled = rows.mapInArrow(feature_rows, "doc_id long, label int, ids binary, weights binary").withColumn("share", F.lit(min(max(share, 1e-6), 1 - 1e-6)))
    got = sampled.groupBy("share").applyInArrow(fitted, "weights binary, bias double").first()  # BUCKETS numbers; the sample stays with the task
    marks.unpersist()
    return Model(np.frombuffer(got["weights"], dtype=np.float32), got["bias"]) if got else fit([], [], np.zeros(0, np.int64), 0.5)


def log_odds(texts: pa.StringArray, model: Model) -> np.ndarray:
    data, offsets = raw(texts)
    total = np.full(len(texts), model.bias, dtype=np.float64)
    for buckets, counts in features(data, offsets):
        total += sums_by(model.values[buckets], counts) / np.maximum(counts, 1) / KINDS
    return total


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (doc_id) and ``score``, the probability of label 1; text is read whole."""
    names = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    columns = docs.select(*names, F.col("text").cast("string").alias("__scored"))
    schema = docs.select(*names).withColumn("__score", F.lit(0.0)).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__scored", 1 << 20):
                odds = log_odds(plain(part.column("__scored")), shared.value)
                p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p)], names=[*names, "__score"])

    return columns.mapInArrow(rows, schema).withColumnRenamed("__score", "score")
