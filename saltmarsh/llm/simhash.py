"""SimHash near-duplicates found through Golay codewords.

A fingerprint has 64 bits: the majority of the 64-bit hashes of a text's word shingles.  It is cut into
segments of 23, 23 and 18 bits.  Of at most 4 differing bits, the worst segment has at least 2 (or all
segments together have at most 3 and the worst at least one), so some two segments differ in at most 2
bits together; each of the two then has a Golay codeword within 4 bits in common.  The keys of a
fingerprint are the pairs of codeword indices of every two segments.  Fingerprints with a common key are
compared bit by bit, so every link is exact and none is lost.

Only different fingerprints are compared.  Within a key, a spanning forest of the links is kept, not all
pairs.  A key with more than ``BLOCK`` fingerprints is cut into blocks, and each two blocks meet in a
group of their own: no group grows with the key, and all of the key's rows are compared.

Null texts and texts without words have fingerprint zero, linked like any other; texts of fewer words
than a shingle are one shingle; repeated rows stay and share a component; rows with a null doc_id have
their fingerprint and take part in links, but name no component unless all of its rows are null; an
empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .arrowtext import pieces
from .components import components, with_least
from .shared import shuffle_partitions, written

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Fingerprints of a key that are compared as one group.
BLOCK = 2048
#: Lowest bit and number of bits of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles of a text, repeats included; none without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    body = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(body, SEED)], dtype="<u8")
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    return np.array([digest(body[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: the bits that over half of the hashes have."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text."""
    return majority(shingle_hashes(text, shingle))


def fingerprint_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            values = [fingerprint(t or "", shingle) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values, type=pa.int64())], names=["doc_id", "fp"])


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) for each key of each fingerprint."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fps = batch.column("fp").slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = fps.view(np.uint64)
            each = [golay.indices(((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)) for low, width in SEGMENTS]
            for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
                (ka, na), (kb, nb) = each[a], each[b]
                keys = (pair << 24) | (ka[:, :, None] << 12) | kb[:, None, :]
                hold = (np.arange(ka.shape[1])[None, :, None] < na[:, None, None]) & (np.arange(kb.shape[1])[None, None, :] < nb[:, None, None])
                yield pa.RecordBatch.from_arrays([pa.array(keys[hold]), pa.array(np.repeat(fps, na * nb))], names=["key", "fp"])


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the links of a spanning forest of all links between ``fps``."""
    bits = fps.view(np.uint64)
    rest = np.arange(len(fps))
    a, b = [], []
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = np.bitwise_count(bits[rest] ^ bits[at]) <= distance
            new = rest[near]
            if len(new):
                rest = rest[~near]
                a.append(np.full(len(new), at))
                b.append(new)
                reached.extend(new.tolist())
    if not a:
        return fps[:0], fps[:0]
    return fps[np.concatenate(a)], fps[np.concatenate(b)]


def link_rows(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal group; the rows come sorted by group."""

    def links(group: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        left, right = [], []
        bits = fps.view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(starts, len(group)))
        small = np.repeat(sizes <= 16, sizes)
        for step in range(1, 16):
            if len(group) <= step:
                break
            near = np.flatnonzero(small[:-step] & (group[step:] == group[:-step]))
            near = near[np.bitwise_count(bits[near] ^ bits[near + step]) <= distance]
            left.append(fps[near])
            right.append(fps[near + step])
        for i in np.flatnonzero(sizes > 16):
            a, b = forest(fps[starts[i] : starts[i] + sizes[i]], distance)
            left.append(a)
            right.append(b)
        a, b = np.concatenate([fps[:0], *left]), np.concatenate([fps[:0], *right])
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    rest_group, rest_fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        group = np.concatenate([rest_group, batch.column("group").to_numpy()])
        fps = np.concatenate([rest_fps, batch.column("fp").to_numpy()])
        if not len(group):
            continue
        cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
        if cut:
            yield links(group[:cut], fps[:cut])
        rest_group, rest_fps = group[cut:], fps[cut:]
    if len(rest_group):
        yield links(rest_group, rest_fps)


def link_edges(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the different fingerprints ``fp``, whose closure is that of all links."""
    spread = distinct.repartition(shuffle_partitions(distinct.sparkSession), "fp")
    keys = spread.mapInArrow(key_rows, "key long, fp long")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "keys")
    # Row of block i goes to the groups {i, j} for every j; the groups of a key are its pairs of blocks.
    split = keys.join(large, "key", "left").withColumn("i", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
    grouped = split.withColumn("j", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))).select(
        F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j"))).alias("group"), "fp"
    )
    return grouped.repartition("group").sortWithinPartitions("group").mapInArrow(lambda it: link_rows(it, distance), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = written(texts.mapInArrow(lambda it: fingerprint_rows(it, shingle), "doc_id long, fp long"), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    distinct = written(first, "distinct")
    edges = written(link_edges(distinct.select("fp"), distance), "edges").distinct()
    roots = written(components(edges), "roots")
    named = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = with_least(named, "root", "first", "component_id").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
