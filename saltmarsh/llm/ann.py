"""Approximate nearest neighbours: inverted lists, product-quantised residuals, exact reranking.

Coarse centroids and the codebooks of the residuals are fitted by k-means on a bounded sample of rows;
every row is assigned to its list and coded.  A query visits its nearest lists: as many as on the sample hold
``TARGET`` of the neighbours that brute force finds there, and enough to hold ``ENOUGH`` rows; besides, the lists of
the ``GUIDES`` rows of the sample that are nearest to it.  In each it adds up distances from a table per subspace.  A row is as far
from its code as was kept with it, so these give a lower and an upper bound of every distance: the rows whose lower bound is
not above the k-th least upper one are compared exactly, in double precision.  So no row of a visited list is lost, however coarse the codes.
A list is cut into parts of about ``PART`` rows by a hash of the id, and each part is a group of its own, so
a hot list (or a third of all rows being one vector) is many groups; the queries go to every part.  The
best k of a query over its parts are the result.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do vectors
of another length than the most frequent one (of equally frequent ones the shortest), nor null ids.
Repeated rows: of rows with one id the smallest vector counts.  Ties of distance go to the smaller id.
Empty tables give an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Bound on the rows that centroids and codebooks are fitted on.
SAMPLE = 16_384
LISTS = 1024
SUBSPACES = 16
CODES = 64
#: Share of true neighbours that the visited lists are to hold, as measured on TRIED rows of the sample.
TARGET = 0.97
TRIED = 256
ENOUGH = 400
#: Nearest rows of the sample whose lists a query visits, and bound on the bytes of the sample that is kept for that.
GUIDES, GUIDE_BYTES = 32, 16 << 20
PART = 8192
ROUNDS = 8
#: An eighth of the queries that one group of a list takes.
QUERIES = 512

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1), 0)


def k_means(points: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    different = np.unique(points, axis=0)
    if len(different) <= k:
        return different
    centres = different[np.sort(random.choice(len(different), k, replace=False))].copy()
    for _ in range(ROUNDS):
        near = squared(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=k)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], points[random.choice(len(points), k)])
    return centres


@dataclass
class Index:
    centres: np.ndarray
    books: list[np.ndarray]
    cuts: np.ndarray  # first dimension of each subspace, and the end
    probes: int  # lists that a query visits
    origin: np.ndarray  # what vectors are counted from, so that a common offset costs no digits
    guides: np.ndarray  # rows of the sample
    guide_lists: np.ndarray

    def lists_of(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([squared(vectors[i : i + 1024], self.centres).argmin(axis=1) for i in range(0, len(vectors), 1024)]) if len(vectors) else np.zeros(0, np.int64)

    def codes_of(self, vectors: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = vectors - self.centres[lists]
        return np.stack([squared(rest[:, a:b], book).argmin(axis=1) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)], axis=1).astype(np.uint8)

    def offs_of(self, vectors: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of vectors from what their codes stand for."""
        coded = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return np.sqrt(((vectors - self.centres[lists] - coded) ** 2).sum(axis=1))

    def guided(self, vectors: np.ndarray) -> np.ndarray:
        """A row per vector: the lists of its nearest guides."""
        n = min(GUIDES, len(self.guides))
        return self.guide_lists[np.argpartition(squared(vectors, self.guides), n - 1, axis=1)[:, :n]]


def fit(sample: np.ndarray, rows: int) -> Index:
    """``rows``: of the whole table, from which the number of lists follows, up to LISTS."""
    random = np.random.default_rng(29)
    origin = np.median(sample, axis=0)
    sample = sample - origin
    lists = max(1, min(LISTS, int(round(rows**0.5)), len(sample) // 16 or 1))
    centres = k_means(sample, lists, random)
    near = squared(sample, centres).argmin(axis=1)
    rest = sample - centres[near]
    dimension = sample.shape[1]
    cuts = np.unique(np.linspace(0, dimension, min(SUBSPACES, dimension) + 1).astype(int))
    books = [k_means(rest[:, a:b], CODES, random) for a, b in zip(cuts, cuts[1:], strict=False)]
    kept = max(1024, GUIDE_BYTES // (8 * dimension))
    return Index(centres, books, cuts, probes_for(sample, centres, near, random), origin, sample[:kept], near[:kept])


def probes_for(sample: np.ndarray, centres: np.ndarray, lists: np.ndarray, random: np.random.Generator, k: int = 10) -> int:
    """The least number of nearest lists with TARGET of the k nearest rows of the sample."""
    tried = random.choice(len(sample), min(TRIED, len(sample)), replace=False)
    far = squared(sample[tried], sample)
    far[np.arange(len(tried)), tried] = np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(squared(sample[tried], centres), axis=1, kind="stable"), axis=1)
    steps = np.sort(np.take_along_axis(place, lists[near], axis=1).ravel())
    return int(steps[min(len(steps) - 1, int(np.ceil(TARGET * len(steps))))]) + 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part, one per id."""
    e = F.col("embedding").cast("array<double>")
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    fine = some.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    return fine.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest other rows found for every query."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dimension, total = int(sizes["size"]), int(sizes["n"])
    rows = written(rows.where(F.size("embedding") == dimension), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    index = spark.sparkContext.broadcast(fit(matrix(sample["embedding"], dimension), total))  # LISTS and CODES centres

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = matrix(batch.column("embedding"), dimension) - index.value.origin, index.value
            lists = own.lists_of(x)
            codes = own.codes_of(x, lists)
            columns = [batch.column("vec_id"), batch.column("embedding"), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], type=pa.binary()), pa.array(own.offs_of(x, lists, codes))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "embedding", "list", "code", "off"])

    table = written(rows.mapInArrow(coded, "vec_id long, embedding array<double>, list int, code binary, off double"), "lists")
    held = {int(r["list"]): int(r["n"]) for r in table.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most LISTS rows
    counts = np.array([held.get(i, 0) for i in range(len(index.value.centres))])
    parts = np.maximum(1, -(-counts // PART))

    def visited(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and the lists that each visits."""
        own = own - index.value.origin
        order = np.argsort(squared(own, index.value.centres), axis=1, kind="stable")
        before = np.cumsum(counts[order], axis=1) - counts[order]
        take = (np.arange(order.shape[1]) < index.value.probes) | (before < max(ENOUGH, 4 * k))
        guided = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(guided, index.value.guided(own), True, axis=1)
        take |= np.take_along_axis(guided, order, axis=1)
        query, column = np.nonzero(take & (counts[order] > 0))
        return query, order[query, column]

    def visit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"), dimension)
            for at in range(0, len(x), 256):
                lists, times = np.unique(visited(x[at : at + 256])[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(times.astype(np.int64))], names=["list", "n"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each list and part that a query visits."""
        for batch in batches:
            x = matrix(batch.column("embedding"), dimension)
            for at in range(0, len(x), 256):
                query, lists = visited(x[at : at + 256])
                times = parts[lists]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                picked = pa.array(at + np.repeat(query, times))
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(picked), batch.column("embedding").take(picked), pa.array(np.repeat(lists, times).astype(np.int32)), pa.array(part.astype(np.int32))], names=["query_id", "embedding", "list", "part"])

    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct().join(rows, "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")
    asked = written(asked, "queries")
    wanted = {int(r["list"]): int(r["n"]) for r in asked.mapInArrow(visit_counts, "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).collect()}  # at most LISTS rows
    cuts = np.array([-(-wanted.get(i, 1) // (QUERIES * 8)) for i in range(len(counts))])
    asked = asked.mapInArrow(visits, "query_id long, embedding array<double>, list int, part int")
    many = F.element_at(F.lit(parts.tolist()), F.col("list") + 1)
    stored = table.withColumn("part", F.pmod(F.xxhash64("vec_id"), many).cast("int"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k nearest rows of one part for each query that visits it."""
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        right = right.sort_by("vec_id")
        ids, codes, off = right["vec_id"].to_numpy(), np.frombuffer(b"".join(right["code"].to_pylist()), dtype=np.uint8).reshape(right.num_rows, -1), right["off"].to_numpy()
        x, own = matrix(right["embedding"], dimension), index.value
        query_ids, q = left["query_id"].to_numpy(), matrix(left["embedding"], dimension)
        middle = own.origin + own.centres[right["list"][0].as_py()]
        rest, held = q - middle, x - middle
        norms = (held * held).sum(axis=1)
        least = min(len(ids), k + 1) - 1  # the query itself may be among them
        found = []
        for i in range(len(q)):
            tables = [squared(rest[i : i + 1, a:b], book)[0] for a, b, book in zip(own.cuts, own.cuts[1:], own.books, strict=False)]
            far = np.zeros(len(ids))
            for m, t in enumerate(tables):
                far += t[codes[:, m]]
            far, size = np.sqrt(far), (rest[i] @ rest[i]) ** 0.5
            spare = 1e-6 * (size + far + off)  # of sums of squares
            at = np.flatnonzero(far - off - spare <= np.partition(far + off + spare, least)[least])
            if len(at) > 4 * k:  # many rows: a product first, and what it can't tell apart from the k-th after it
                near = norms[at] - 2 * ((held if len(at) == len(ids) else held[at]) @ rest[i]) + size * size
                spare = 1e-9 * (norms[at] + size * size)
                at = at[near - spare <= np.partition(near + spare, least)[least]]
            at = at[ids[at] != query_ids[i]]
            exact = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
            first = np.argsort(exact, kind="stable")[:k]
            found.append((np.full(len(first), query_ids[i]), ids[at[first]], exact[first]))
        return pa.table([np.concatenate(c) for c in zip(*found, strict=True)], schema=FOUND)

    # The queries of a much visited list are dealt into slices as well; the list's rows go to each of its own.
    slices = F.element_at(F.lit(cuts.tolist()), F.col("list") + 1)
    stored = stored.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    keys = ["list", "part", "slice"]
    found = asked.withColumn("slice", F.pmod(F.xxhash64("query_id"), slices).cast("int")).groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
