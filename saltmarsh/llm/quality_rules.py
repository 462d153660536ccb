"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame operations alone.

Rules: counts of words, word characters, symbols, repeated lines and words in repeated windows of eight
words; a text fails with fewer than 20 words or over 30 % of its words in repeated windows.  The method's
verdict on the others: words and word pairs are hashed to buckets; two multinomials are estimated, from
the documents labelled as good and from all documents; a text's score is the sum of the log ratios of
its n-grams divided by their number, and it is kept from ``THRESHOLD`` on, the same for every document.

Both counts cover all rows, pre-aggregated in every task to at most a row per bucket.  Windows are
compared by chained 64-bit hashes of their words.  All of a row's work is done in the row.

Null texts are empty texts (no words, failed); a very long text is one row's work, read whole; labels that are null or whose doc_id is null are left out,
of repeated labels of a doc_id the majority counts; without labelled rows all scores are 0 and the rules
alone decide; repeated rows are rows of their own; an empty table gives an empty result; other columns
are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import numbers, summed, words
from .shared import written

BUCKETS = 1 << 13
SMOOTHING = 1.0
#: Least mean log ratio of a kept text.
THRESHOLD = -0.1
WINDOW = 8
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 20
MOST_REPEATED = 30


def hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def joined(left: Column, right: Column, size: Column) -> Column:
    """Hashes of left[i], right[i] for the first ``size`` places."""
    return F.zip_with(F.slice(left, 1, size), F.slice(right, 1, size), lambda a, b: F.xxhash64(a, b))


def after(values: str, step: int) -> tuple[Column, Column]:
    """``values`` from place ``step`` on, and how many there are."""
    size = F.greatest(F.size(values) - step, F.lit(0))
    return F.slice(values, step + 1, F.greatest(size, F.lit(0))), size


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the columns __w (hashes of words), __pairs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("__t", text).withColumn("__words", words(F.col("__t")))
    out = out.withColumn("__lines", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "n_symbols": (F.char_length("__t") - F.char_length(F.translate("__t", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__w": F.transform("__words", lambda w: F.xxhash64(w)),
        }
    ).drop("__words", "__lines", "__t")
    for name, of, step in (("__pairs", "__w", 1), ("__fours", "__pairs", 2), ("__eights", "__fours", 4)):
        right, size = after(of, step)
        out = out.withColumn(name, joined(F.col(of), right, size))
    out = out.drop("__fours")
    # Windows sorted by hash, each beside its neighbours: the places of windows that are there twice or more.
    size = F.size("__eights")
    placed = F.array_sort(F.zip_with("__eights", F.sequence(F.lit(0), size - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__sorted", F.when(F.size(F.array_distinct("__eights")) < size, placed)).drop("__eights")
    n = F.size("__sorted")
    out = out.withColumn("__before", F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("__sorted", 1, n - 1)))
    out = out.withColumn("__same", F.zip_with("__sorted", "__before", lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    out = out.withColumn("__next", F.concat(F.slice("__same", 2, n - 1), F.array(F.lit(False))))
    out = out.withColumn("__either", F.zip_with("__same", "__next", lambda a, b: a | b))
    out = out.withColumn("__places", F.array_sort(F.filter(F.zip_with("__sorted", "__either", lambda a, e: F.when(e, a["i"])), lambda i: i.isNotNull())))
    last = F.size("__places")
    gaps = F.zip_with(F.slice("__places", 2, last - 1), F.slice("__places", 1, last - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    repeated = F.when(F.col("__sorted").isNull(), 0).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap))
    out = out.withColumn("n_repeat_words", repeated.cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__sorted", "__before", "__same", "__next", "__either", "__places")


def bucket(hash_: Column) -> Column:
    return F.pmod(hash_, F.lit(BUCKETS)).cast("int")


def log_ratios(docs: DataFrame, labels: DataFrame, label: str = "quality") -> np.ndarray:
    """Log ratio of every bucket, from all documents and all that are labelled as good."""
    marks = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("double").alias("__label")).where("__id is not null and __label is not null")
    good = written(marks.groupBy("__id").agg(F.avg("__label").alias("__label")).where("__label >= 0.5").select("__id"), "good")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def counted(rows: DataFrame) -> dict[int, int]:
        hashed = rows.select(hashes(F.col("text")).alias("__w"))
        right, size = after("__w", 1)
        grams = F.concat(F.transform("__w", bucket), F.transform(joined(F.col("__w"), right, size), bucket))
        counts = hashed.select(F.explode(grams).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        return {r["b"]: r["n"] for r in counts.collect()}  # at most a row per bucket

    # All texts are counted where they are read; only the labelled ones are looked up, and a null id is none.
    target, corpus = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for counts, rows in ((target, texts.join(good, F.col("doc_id") == F.col("__id"), "left_semi")), (corpus, texts)):
        for b, n in counted(rows).items():
            counts[b] = n
    if not target.any():
        return np.zeros(BUCKETS)
    share = [(x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS) for x in (target, corpus)]
    return np.log(share[0]) - np.log(share[1])


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, llr and kept of every row."""
    ratios = numbers(log_ratios(docs, labels))
    out = with_counts(docs.select("doc_id", "text"))
    out = out.withColumn("__b", F.concat(F.transform("__w", bucket), F.transform("__pairs", bucket)))
    out = out.withColumn("llr", F.when(F.size("__b") > 0, summed("__b", ratios) / F.size("__b")).otherwise(0.0))
    kept = ~F.col("base_failed") & (F.col("llr") >= threshold)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "llr")
