"""Near copies by SimHash and the similarity of word shingles, for the corpus pipeline.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8 or more.
Texts of equal sets are one node.  Candidates are of two kinds.  SimHash fingerprints of the shingles that
differ in at most 4 of 64 bits are found through Golay codewords, all of them, as in ``simhash``; but of texts
of similarity 0.8 most differ in 9 or 10 bits, where no code of this length has keys that are rare enough.
So minimum hashes of a set, ``ROWS`` to a band, give ``BANDS`` keys more; a pair of similarity 0.8 has a common
key with probability 1 - (1 - 0.8^ROWS)^BANDS, 0.9996.  The closure of the candidates cuts the nodes into
groups; within a group every candidate pair is compared by the sets themselves, up to a spanning forest of the
links.  So each text is sent to its group once, not once for each key.  A group of more than ``BLOCK`` nodes, or
more than ``BYTES`` of sets, is cut into blocks, and each two blocks meet in a group of their own.

A row is known by a hash of all its columns, nulls included, never by its doc_id alone: rows without an id
and rows that share one are rows of their own.  Of every component the row with the smallest doc_id stays
(rows without an id come last), then the smallest hash; whole repeated rows stay once.  Null texts and texts
without words are one node; texts of fewer words than a shingle are one shingle; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import pieces
from .components import components
from .shared import written
from .simhash import DISTANCE, link_edges, majority, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
SEED = 42
#: Nodes of a group that are compared at once, and bytes of their sets.
BLOCK, BYTES = 1024, 64 << 20

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
#: The hash functions: exclusive or with the one, times the other, which is odd.
FLIPS, FACTORS = _DRAWN[0], _DRAWN[1] * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, shingle: int = SHINGLE) -> tuple[np.ndarray, int]:
    """Sorted different hashes of the word shingles of a text (without words: of the empty one), and its fingerprint."""
    hashes = shingle_hashes(text, shingle)
    return np.unique(hashes) if len(hashes) else np.array([xxhash.xxh64_intdigest(b"", SEED)], dtype=np.uint64), majority(hashes)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[at] == a).sum())
    return common / (len(a) + len(b) - common)


def node_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 512):
        part = (hashes[at : at + 512, None] ^ FLIPS) * FACTORS
        least = np.minimum(least, part.min(axis=0))
    parts = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(parts[k].tobytes(), k) for k in range(BANDS)], dtype=np.uint64).view(np.int64)


def sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            nodes, prints, keys, sizes = [], [], [], []
            for text in part.column("text").to_pylist():
                hashes, fp = shingle_set(text or "")
                nodes.append(node_of(hashes))
                prints.append(fp)
                keys.append(band_keys(hashes))
                sizes.append(hashes.nbytes)
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            columns = [part.column("doc_id"), part.column("row"), pa.array(nodes, type=pa.int64()), pa.array(prints, type=pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(sizes, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "node", "fp", "keys", "bytes"])


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each text as bytes, and its fingerprint, beside its node and group."""
    for batch in batches:
        for part in pieces(batch, "text"):
            sets = [shingle_set(t or "") for t in part.column("text").to_pylist()]
            columns = [part.column("group"), part.column("node"), pa.array([fp for _, fp in sets], type=pa.int64()), pa.array([h.tobytes() for h, _ in sets], type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "node", "fp", "hashes"])


def link_rows(table: pa.Table) -> pa.Table:
    """Ends of a spanning forest of all links of a group."""
    nodes, first = np.unique(table["node"].to_numpy(), return_index=True)
    stored = table["hashes"]
    sets = [np.frombuffer(stored[int(i)].as_py(), dtype=np.uint64) for i in first]
    sizes = np.array([len(s) for s in sets])
    keys = np.stack([band_keys(s) for s in sets])
    prints = table["fp"].to_numpy()[first].astype(np.int64).view(np.uint64)
    rest = np.arange(len(nodes))
    a, b = [], []
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            # Sets whose sizes are further apart can't be similar.
            fits = np.minimum(sizes[rest], sizes[at]) >= SIMILARITY * np.maximum(sizes[rest], sizes[at])
            close = np.bitwise_count(prints[rest[fits]] ^ prints[at]) <= DISTANCE
            fits[fits] = close | (keys[rest[fits]] == keys[at]).any(axis=1)
            near = np.zeros(len(rest), dtype=bool)
            for i in np.flatnonzero(fits):
                near[i] = similarity(sets[at], sets[rest[i]]) >= SIMILARITY
            new = rest[near]
            rest = rest[~near]
            a += [at] * len(new)
            b += new.tolist()
            reached.extend(new.tolist())
    return pa.table({"a": pa.array(nodes[a] if a else nodes[:0], type=pa.int64()), "b": pa.array(nodes[b] if b else nodes[:0], type=pa.int64())})


def row_key(columns: list[str]) -> Column:
    """Hash of a row; a null is not the same as a missing column."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def shared_keys(keys: DataFrame) -> DataFrame:
    """Candidates (a, b) from (node, key): each node and the least node of its key."""
    least = keys.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "least")
    return keys.join(least, "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))


def close_prints(distinct: DataFrame) -> DataFrame:
    """Candidates (a, b) whose fingerprints are equal or differ in at most DISTANCE bits."""
    prints = written(distinct.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    edges = link_edges(prints.select("fp"))
    for end in ("a", "b"):
        edges = edges.join(prints.select(F.col("fp").alias(end), F.col("least").alias(f"node_{end}")), end)
    return shared_keys(distinct.select("node", F.col("fp").alias("key"))).unionByName(edges.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def links(sketches: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between nodes whose closure is that of all near copies found."""
    distinct = written(sketches.groupBy("node").agg(F.min("row").alias("row"), F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.first("bytes").alias("bytes")), "nodes")
    star = shared_keys(distinct.select("node", F.explode("keys").alias("key"))).unionByName(close_prints(distinct.select("node", "fp")))
    star = written(star.distinct(), "candidates")
    groups = written(components(star).select("node", F.col("root").alias("group")), "groups")
    sizes = groups.join(distinct.select("node", "bytes"), "node").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / BYTES)).cast("int")
    large = written(sizes.select("group", blocks.alias("blocks")).where("blocks > 1"), "large")
    chosen = distinct.select("node", "row").join(groups, "node").select("row", "node", "group")
    sets = rows.select("row", "text").join(chosen.hint("merge"), "row").select("group", "node", "text").mapInArrow(set_rows, "group long, node long, fp long, hashes binary")
    # A node of block i goes to the groups {i, j} for every j.
    split = sets.join(large, "group", "left").withColumn("i", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    split = split.withColumn("j", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    sets = split.select(F.when(F.col("blocks").isNull(), F.col("group")).otherwise(F.xxhash64("group", F.least("i", "j"), F.greatest("i", "j"))).alias("group"), "node", "fp", "hashes")
    return sets.groupBy("group").applyInArrow(link_rows, "a long, b long")


def first_of_each(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of ``docs`` for every component of near copies."""
    columns = docs.columns
    rows = docs.withColumn("row", row_key(columns))
    some = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "row", F.col("text").cast("string").alias("text"))
    sketches = written(some.mapInArrow(sketch_rows, "doc_id long, row long, node long, fp long, keys array<long>, bytes long"), "sketches")
    edges = written(links(sketches, some, block).distinct(), "edges")
    roots = written(components(edges), "roots")
    named = sketches.select("doc_id", "row", "node").join(roots, "node", "left").withColumn("component", F.coalesce("root", "node"))
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    kept = rows.join(first.select(F.col("first.row").alias("row")).hint("merge"), "row", "left_semi")
    return kept.dropDuplicates(["row"]).select(*columns)
