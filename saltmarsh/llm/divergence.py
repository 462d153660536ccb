"""Audit of how the sources of a language differ in their words, by sparse merges of pairs of sources.

Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased.  A language keeps the terms that at least
``LEAST_DOCS`` of its documents hold.  Every (lang, source) group, and each language as a whole, gives every kept
term a share p = 1 + floor(10**9 * (count + 1) / (N + V)); a share p costs floor((p - q)**2 / q) against a share q.
All of it is integer arithmetic.

1. Tasks count the terms of their texts per group; one shuffle by (lang, bucket of the term) adds the counts up, finds in
   how many documents a term is, and numbers the kept terms of a bucket in their order.
2. The counts of a group become arrays of (term id, count), sorted and packed, a piece per ``CHUNK`` terms of the language.
3. Every unordered pair of a language's sources is a task per chunk, which co-groups the two arrays.  A galloping
   intersection splits them into terms of both and of one, and each is priced both ways; terms of neither
   are priced by their number.
4. The terms of a group that it has more often than its language are ranked by the same cost.

A null text, lang or source is the empty string, a group like others.  Empty texts and texts without terms make their group
appear, though it has no counts; a language without kept terms has pairs of value 0 and no terms.  Texts of any
length are read whole.  Repeated rows count as documents of their own; doc_id is not used.  Equal values are
ranked by the item's bytes.  An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import pieces, plain, raw, strings, word_spans
from .shared import shuffle_partitions, written

LEAST_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Terms of a language that one task of a pair merges.
CHUNK = 1 << 17
#: Bytes of text that are counted together.
TOGETHER = 16 << 20
#: Ids of the shorter array that gallop as one.
GALLOP = 1024
COUNTED = "lang string, source string, term string, n long, docs long"
PACKED = "lang string, source string, chunk int, size int, ids binary, counts binary"
PRICED = "lang string, a string, b string, either long, ab long, ba long"

_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


# Counting


def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, occurrences, documents) of a batch of (lang, source, text)."""
    data, offsets = raw(plain(batch.column("text")))
    data = _LOWER[data]
    starts, stops, per_text = word_spans(data, offsets, _BETWEEN)
    empty = [pa.array([], type=t) for t in (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())]
    if not len(starts):
        return pa.RecordBatch.from_arrays(empty, names=["lang", "source", "term", "n", "docs"])
    lang, source = (plain(batch.column(c)).dictionary_encode() for c in ("lang", "source"))
    codes = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    groups, group = np.unique(codes, return_inverse=True)
    terms = strings(data, starts, stops).dictionary_encode()
    code, texts, kinds = terms.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(per_text)), per_text), len(terms.dictionary)
    in_text, n = np.unique(texts * kinds + code, return_counts=True)
    key = group[in_text // kinds] * kinds + in_text % kinds
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    of_group, of_term = groups[key[first] // kinds], key[first] % kinds
    columns = [
        lang.dictionary.take(pa.array(of_group // len(source.dictionary))),
        source.dictionary.take(pa.array(of_group % len(source.dictionary))),
        terms.dictionary.take(pa.array(of_term)).cast(pa.string()),
        pa.array(np.add.reduceat(n, first)),
        pa.array(np.diff(np.append(first, len(key)))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of as many rows at once as have ``TOGETHER`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0

    def total() -> pa.RecordBatch:
        columns = [pa.concat_arrays([plain(b.column(c)) for b in held]) for c in ("lang", "source", "text")]
        return counted(pa.RecordBatch.from_arrays(columns, names=["lang", "source", "text"]))

    for batch in batches:
        for part in pieces(batch, "text", TOGETHER):
            more = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and size + more > TOGETHER:
                yield total()
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield total()


def kept_terms(docs: DataFrame) -> DataFrame:
    """(lang, bucket, id, term, source, n, total): counts of each kept term in the groups that have it.

    Ids number the kept terms of a (lang, bucket) from 1 in their order; total is the language's count.
    """
    buckets = 4 * shuffle_partitions(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = rows.mapInArrow(count_rows, COUNTED).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    # All that follows keeps this one partitioning: a bucket's terms are a share of the language's, whatever is frequent.
    counts = counts.repartition("lang", "bucket").groupBy("lang", "bucket", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "bucket", "term")
    kept = counts.withColumn("held", F.sum("docs").over(term)).withColumn("total", F.sum("n").over(term)).where(F.col("held") >= LEAST_DOCS)
    number = F.dense_rank().over(Window.partitionBy("lang", "bucket").orderBy("term"))
    return written(kept.withColumn("id", number).select("lang", "bucket", "id", "term", "source", "n", "total"), "terms")


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n, v, lang_n) of every group that occurs: occurrences, kept terms of the language, its occurrences."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_bucket = kept.groupBy("lang", "bucket").agg(F.max("id").alias("v"), F.sum("n").alias("lang_n"))
    of_lang = of_bucket.groupBy("lang").agg(F.sum("v").cast("long").alias("v"), F.sum("lang_n").alias("lang_n"))
    joined = groups.join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left")
    return written(joined.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v", "lang_n"))), "groups")


# Pricing


def share(count: Column, denominator: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / denominator) in whole numbers; decimals hold the product."""
    scaled = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return (F.lit(1) + (scaled - scaled % denominator.cast("decimal(20,0)")) / denominator.cast("decimal(20,0)")).cast("long")


def cost(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); shares stay below 2**31, so the square fits a long."""
    square = (p - q) * (p - q)
    return F.call_function("div", square, q)


def shares(counts: np.ndarray, denominator: int) -> np.ndarray:
    """Shares of ``counts`` as ``share`` gives them, in two steps that stay within 64 bits."""
    high, rest = np.divmod((counts + 1) * 100_000, denominator)
    return 1 + high * 10_000 + rest * 10_000 // denominator


def costs(p: np.ndarray, q: np.ndarray) -> int:
    return int(((p - q) * (p - q) // q).sum())


def galloped(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``short`` and in ``long`` (both ascending, without repeats) of the ids that both have.

    A block of the shorter array doubles its step through the longer one until it is past the block's last id;
    only what it stepped over is searched.
    """
    mine, theirs, at = [], [], 0
    for begin in range(0, len(short), GALLOP):
        block, step = short[begin : begin + GALLOP], GALLOP
        while at + step < len(long) and long[at + step] <= block[-1]:
            step *= 2
        stretch = long[at : at + step + 1]
        place = np.searchsorted(stretch, block)
        found = place < len(stretch)
        found[found] = stretch[place[found]] == block[found]
        mine.append(begin + np.flatnonzero(found))
        theirs.append(at + place[found])
        at += int(place[-1])
        if at >= len(long):
            break
    if not mine:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(mine), np.concatenate(theirs)


def price(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], a_size: int, b_size: int) -> tuple[int, int, int]:
    """Terms that either has, and the costs over them of a against b and of b against a.

    ``a`` and ``b`` are (ids, counts); the sizes are N + V of the groups.
    """
    if len(a[0]) > len(b[0]):
        either, ba, ab = price(b, a, b_size, a_size)
        return either, ab, ba
    at_a, at_b = galloped(a[0], b[0])
    p, q = shares(a[1], a_size), shares(b[1], b_size)
    none = np.zeros(1, np.int64)
    p_none, q_none = shares(none, a_size), shares(none, b_size)
    ab = ba = 0
    only_a, only_b = np.ones(len(p), bool), np.ones(len(q), bool)
    only_a[at_a], only_b[at_b] = False, False
    for x, y in ((p[at_a], q[at_b]), (p[only_a], q_none), (p_none, q[only_b])):
        if len(x) and len(y):
            ab += costs(x, y)
            ba += costs(y, x)
    return len(p) + len(q) - len(at_a), ab, ba


def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids as compressed differences, and compressed counts."""
    for batch in batches:
        rows = []
        for ids, counts in zip(batch.column("ids"), batch.column("counts"), strict=True):
            steps = np.diff(ids.values.to_numpy(), prepend=0).astype("<i8")
            rows.append((len(steps), pa.compress(steps.tobytes(), codec="zstd", asbytes=True), pa.compress(counts.values.to_numpy().astype("<i8").tobytes(), codec="zstd", asbytes=True)))
        size, ids, counts = zip(*rows, strict=True) if rows else ((), (), ())
        columns = [*(batch.column(c) for c in ("lang", "source", "chunk")), pa.array(size, type=pa.int32()), pa.array(ids, type=pa.binary()), pa.array(counts, type=pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "chunk", "size", "ids", "counts"])


def unpacked(side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The array of a group's chunk; empty if the group has no term in it."""
    if not side.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = side.slice(0, 1).to_pylist()[0]
    ids, counts = (np.frombuffer(pa.decompress(row[c], 8 * row["size"], codec="zstd"), "<i8") for c in ("ids", "counts"))
    return np.cumsum(ids), counts


def price_pair(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    sizes = (left if left.num_rows else right).select(["a_size", "b_size"]).slice(0, 1).to_pylist()[0]
    either, ab, ba = price(unpacked(left), unpacked(right), sizes["a_size"], sizes["b_size"])
    lang, a, b, _ = (k.as_py() for k in key)
    return pa.table({"lang": [lang], "a": [a], "b": [b], "either": [either], "ab": [ab], "ba": [ba]}, schema=pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("either", pa.int64()), ("ab", pa.int64()), ("ba", pa.int64())]))


def pair_costs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of a language's sources."""
    spark = kept.sparkSession
    largest = groups.agg(F.max("v")).first()[0] or 0
    chunks = max(1, -(-largest // CHUNK))
    buckets = 4 * shuffle_partitions(spark)
    per_chunk = -(-buckets // chunks)
    entry = F.struct((F.shiftleft(F.col("bucket").cast("long"), 32) + F.col("id")).alias("id"), "n")
    arrays = kept.groupBy("lang", "source", F.floor(F.col("bucket") / per_chunk).cast("int").alias("chunk")).agg(F.sort_array(F.collect_list(entry)).alias("x"))
    packed = written(arrays.select("lang", "source", "chunk", F.col("x.id").alias("ids"), F.col("x.n").alias("counts")).mapInArrow(pack_rows, PACKED), "arrays")
    size = F.col("n") + F.col("v")
    left = groups.select("lang", F.col("source").alias("a"), size.alias("a_size"), "v")
    right = groups.select("lang", F.col("source").alias("b"), size.alias("b_size"))
    pairs = left.join(right, "lang").where("a < b")  # as many rows as half the result's
    key = ["lang", "a", "b", "chunk"]

    def side(name: str) -> DataFrame:
        rows = packed.withColumnRenamed("source", name).join(pairs, ["lang", name])
        return rows.select(*(F.col(c).alias(c) for c in (*key, "size", "ids", "counts", "a_size", "b_size"))).groupBy(*key)  # columns of its own

    priced = side("a").cogroup(side("b")).applyInArrow(price_pair, PRICED)
    sums = priced.groupBy("lang", "a", "b").agg(*(F.sum(c).alias(c) for c in ("either", "ab", "ba")))
    known = pairs.join(sums, ["lang", "a", "b"], "left").fillna(0, ["either", "ab", "ba"])
    none_a, none_b = (share(F.lit(0), F.greatest(F.col(c), F.lit(1))) for c in ("a_size", "b_size"))
    absent = F.col("v") - F.col("either")

    def way(source: str, item: str, sum_of: str, p: Column, q: Column) -> Column:
        return F.struct(F.col(source).alias("source"), F.col(item).alias("item"), (F.col(sum_of) + absent * cost(p, q)).alias("value"))

    both = F.explode(F.array(way("a", "b", "ab", none_a, none_b), way("b", "a", "ba", none_b, none_a)))
    return known.select("lang", both.alias("x")).select("lang", "x.source", "x.item", "x.value")


def term_costs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the kept terms that a group has more often than its language."""
    rows = kept.join(groups.withColumnRenamed("n", "size"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("size") + F.col("v")), share(F.col("total"), F.col("lang_n") + F.col("v"))
    return rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", cost(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources, and each group's foremost terms."""
    kept = kept_terms(docs)
    groups = group_sizes(docs, kept)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_costs(kept, groups).withColumn("rank", F.row_number().over(order))
    terms = term_costs(kept, groups).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    columns = ["item", "value", "rank"]
    return pairs.select("lang", "source", F.lit("pair").alias("part"), *columns).unionByName(terms.select("lang", "source", F.lit("term").alias("part"), *columns))
