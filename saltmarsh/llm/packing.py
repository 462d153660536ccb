"""Best-fit packing with exact-complement hashing.

A document becomes the ids of its text and one end id.  A longer document than a sequence is cut from
its end into full pieces, so that only piece 0 may be shorter.  How many pieces have each length is a
table of at most ``capacity`` counts; the plan is made from that alone: for the longest length left, an
index of the sums of pairs of lengths, filled once and thinned as lengths are used up, gives one, two or three lengths that fill the
gap exactly, and that combination is used as often as the counts allow; where no sum fits, the gap is filled best-fit.  A plan
is a list of (lengths of a sequence, how often).  The pieces of each length are then numbered by Spark in
small salted groups, and a piece's number and length say its sequence and its place in it.

Null texts are empty texts (the end id alone); repeated rows are packed as rows of their own; an empty
table gives an empty result; columns other than doc_id and text are left out.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import SPACE, pieces, plain, raw, strings
from .shared import written

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A row with its place among its task's rows, so that repeated rows differ.
WRITTEN = PIECES + ", nth long"
#: White space of the vocabulary's split pattern other than the ASCII one, and its special token.
UNUSUAL = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|endoftext\|>"


class Encoder:
    """Ids of texts under the byte-level vocabulary.

    The vocabulary's pattern never joins what stands before a run of white space with the run, so a text
    is cut there and each different chunk is encoded once.  Texts with other white space or with the
    special token's string go through the tokenizers library whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path = public_tokenizers.path(f"{vocabulary}.json")
        self.whole = None

    def slowly(self, text: str) -> np.ndarray:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        data, offsets = raw(texts)
        n = len(data)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        space = SPACE[data]
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        starts_text = offsets[:-1][np.diff(offsets) > 0]
        cut[starts_text] = True
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], n)
        chunks = strings(data, starts, stops).dictionary_encode()
        different = [self.fast.encode_ordinary(x.decode()) for x in chunks.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, different), dtype=np.int64, count=len(different))
        flat = np.fromiter((i for ids in different for i in ids), dtype="<u4", count=int(sizes.sum()))
        codes = chunks.indices.to_numpy()
        size = sizes[codes]
        ends = np.cumsum(size)
        source = np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - size), size) + np.arange(int(ends[-1]))
        ids = flat[source]
        before = np.concatenate([[0], ends])
        counts = np.diff(before[np.searchsorted(starts, offsets)])
        odd = np.flatnonzero(pc.match_substring_regex(texts, UNUSUAL).to_numpy(zero_copy_only=False))
        if len(odd):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in odd:
                parts[i] = self.slowly(texts[int(i)].as_py())
            counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            ids = np.concatenate(parts)
        return ids, counts


def piece_rows(batches: Iterator[pa.RecordBatch], capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder()
    nth = 0
    for batch in batches:
        for part in pieces(batch, "text"):
            doc_ids = part.column("doc_id").to_pylist()
            ids, counts = encoder.encode(plain(part.column("text")))
            rows: list[tuple] = []
            end = np.array([end_id], dtype="<u4").tobytes()
            body = memoryview(np.ascontiguousarray(ids, dtype="<u4").tobytes())
            at = 0
            for doc_id, count in zip(doc_ids, counts.tolist(), strict=True):
                total = count + 1
                own = body[4 * at : 4 * (at + count)]
                at += count
                start, stop, piece = 0, total % capacity or capacity, 0
                while start < total:
                    crc = zlib.crc32(own[4 * start : 4 * min(stop, count)])
                    if stop > count:
                        crc = zlib.crc32(end, crc)
                    rows.append((doc_id, piece, start, stop - start, crc, nth))
                    start, stop, piece, nth = stop, stop + capacity, piece + 1, nth + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "nth"],
            )


class SumIndex:
    """Lengths by the sums that one, two or three of them make, under availability counts.

    ``pairs`` holds for each sum the longer members of all pairs of lengths that were there when the index was filled, the longest
    first.  A pair is dropped from it once either length is used up for good (``gone``); one that is only short for the
    moment (``left``) is passed over.  A sum of three is one length and the pair index at what it leaves.
    """

    def __init__(self, counts: np.ndarray):
        self.left, self.gone = counts.copy(), counts == 0
        have = np.flatnonzero(counts)
        longer, shorter = (x.ravel() for x in np.meshgrid(have, have, indexing="ij"))
        keep = (longer >= shorter) & (longer + shorter < len(counts))
        longer, sums = longer[keep].astype(np.int32), (longer + shorter)[keep]
        order = np.lexsort((-longer, sums))
        cuts = np.searchsorted(sums[order], np.arange(len(counts) + 1))
        self.pairs = [longer[order[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def use(self, lengths: np.ndarray, times: np.ndarray) -> None:
        """Takes lengths for good."""
        self.left[lengths] -= times
        self.gone[lengths] = self.left[lengths] == 0

    def pair(self, total: int, most: int, other: int = 0) -> list[int] | None:
        """The pair of this sum with the longest member up to ``most``, beside one more length ``other`` that is taken already."""
        longer = self.pairs[total]
        if len(longer) and (self.gone[longer].any() or self.gone[total - longer].any()):
            longer = self.pairs[total] = longer[~self.gone[longer] & ~self.gone[total - longer]]
        longer = longer[np.searchsorted(-longer, -most) :]
        if not len(longer):
            return None
        shorter = total - longer
        spare_a, spare_b = (self.left[x] - (x == other) for x in (longer, shorter))
        fits = np.flatnonzero((spare_a > 0) & (spare_b > 0) & ((longer != shorter) | (spare_a > 1)))
        return [int(longer[fits[0]]), int(shorter[fits[0]])] if len(fits) else None

    def fill(self, gap: int) -> list[int] | None:
        """Up to three lengths that sum to ``gap`` and are left, the fewest and then the longest first."""
        if self.left[gap] > 0:
            return [gap]
        if two := self.pair(gap, gap):
            return two
        for first in np.flatnonzero(self.left[: max(gap - 1, 0)] > 0)[::-1].tolist():
            if 3 * first < gap:
                break
            if rest := self.pair(gap - first, first, first):
                return [first, *rest]
        return None


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, number of such sequences), using up all counts of lengths up to capacity."""
    every = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in counts.items():
        every[length] += count
    plan: list[tuple[list[int], int]] = []
    if every[capacity]:
        plan.append(([capacity], int(every[capacity])))
        every[capacity] = 0
    index = SumIndex(every)
    left = index.left
    longest = capacity - 1
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return plan
        pattern, gap = [longest], capacity - longest
        left[longest] -= 1
        while gap > 0:
            if fill := index.fill(gap):
                added, gap = fill, 0
            else:  # best fit: the longest that goes in, then exact again for the rest
                fitting = np.flatnonzero(left[: gap + 1] > 0)
                if not len(fitting):
                    break
                added = [int(fitting[-1])]
                gap -= added[0]
            pattern += added
            for x in added:
                left[x] -= 1
        for x in pattern:
            left[x] += 1
        lengths, times = np.unique(pattern, return_counts=True)
        often = int((left[lengths] // times).min())
        index.use(lengths, often * times)
        plan.append((pattern, often))


def place_rows(batches: Iterator[pa.RecordBatch], plan: list[tuple[list[int], int]]) -> Iterator[pa.RecordBatch]:
    """Adds sequence_id and offset to pieces that are numbered within their length."""
    by_length: dict[int, list[tuple[int, int, int, list[int]]]] = {}
    used: dict[int, int] = {}
    first_sequence = 0
    for pattern, often in plan:
        places: dict[int, list[int]] = {}
        at = 0
        for length in pattern:
            places.setdefault(length, []).append(at)
            at += length
        for length, offsets in places.items():
            begin = used.get(length, 0)
            by_length.setdefault(length, []).append((begin, first_sequence, len(offsets), offsets))
            used[length] = begin + often * len(offsets)
        first_sequence += often
    tables = {}
    for length, entries in by_length.items():
        width = max(e[2] for e in entries)
        offsets = np.zeros((len(entries), width), dtype=np.int64)
        for i, e in enumerate(entries):
            offsets[i, : e[2]] = e[3]
        tables[length] = (*(np.array([e[k] for e in entries], dtype=np.int64) for k in range(3)), offsets)
    for batch in batches:
        length = batch.column("length").to_numpy()
        number = batch.column("number").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            begins, firsts, times, offsets = tables[int(length[rows[0]])]
            entry = np.searchsorted(begins, number[rows], side="right") - 1
            within = number[rows] - begins[entry]
            sequence[rows] = firsts[entry] + within // times[entry]
            offset[rows] = offsets[entry, within % times[entry]]
        kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: piece_rows(it, capacity, end_id), WRITTEN)
    cut = written(cut, "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = plan_sequences(counts, capacity)
    # A length of n pieces has about sqrt(n) groups of sqrt(n) pieces: neither its groups nor the list of them is large.
    of_length = [math.isqrt(counts.get(length, 0)) + 1 for length in range(capacity + 1)]
    salts = F.get(F.split(F.lit(" ".join(map(str, of_length))), " ").cast("array<int>"), F.col("length").cast("int"))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "nth"), salts).cast("int"))
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = written(groups.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32", "nth")
    numbered = (
        salted.withColumn("at", F.row_number().over(within))
        .join(groups.select("length", "salt", "before"), ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at") - 1).cast("long").alias("number"))
    )
    shared = spark.sparkContext.broadcast(plan)  # grows with the number of lengths alone
    return numbered.mapInArrow(lambda it: place_rows(it, shared.value), PIECES + ", sequence_id long, offset long")
