"""Prefix trie of conversations, built as a burst trie over shards.

A conversation is rebuilt as the first h turns of the one whose id is its own rounded down to a hundred, then its own
turns after its first h, h from a checksum of its id.  A turn becomes a record: ``RECORD`` bytes of a digest of role and
text, and the text's code points; a conversation is the string of its records, its path.  Equal paths
are one path with the number of its conversations, their smallest id and the digest of all their ids.

1. All paths hang from the root, in containers by their next turn.  A container that holds too many is burst: the
   longest prefix that all its paths share becomes a head of the trie, and its paths go into containers by the turn
   after it.  This goes on until no container is too large.
2. The containers are dealt out; each is sorted and swept once, with the nodes of the path at hand on a stack.
3. Heads add up what their containers and the heads below them give, as a table of their own.

How large a container may be (``limit``) follows from the number of paths and shuffle partitions; the result does not depend on
it.  A container that shares its whole length but for the end is burst at once, whatever its depth.

Null turns come first, and equal turn numbers go by the record; null roles and texts are empty; rows with a null conv_id belong
to no conversation and are left out.  Empty and very long texts are a record like others.  Repeated rows are turns of
their own.  A conversation without turns ends at the root.  A negative id is rounded down as well.  The records of one
conversation (20 bytes a turn) are held by one task.  An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shuffle_partitions, written

#: Conversations of a family share the first turns of its first one; at most so many, less one.
FAMILY, SHARED = 100, 6
DIGEST, RECORD = 16, 20
#: Bounds of the number of paths in a container, and of their bytes.
FEWEST, MOST, BYTES = 32, 1 << 16, 64 << 20
#: Ids that are joined to one text before the digest of all is taken.
TOGETHER = 4096
#: Rows of a batch that a sweep returns.
BATCH = 1 << 14
NOTHING = hashlib.sha256(b"").hexdigest()
PATHS = "path binary, n long, least long, ends string"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# Paths


def own_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of the conversations as they are."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    record = F.unhex(F.concat(digest, F.lpad(F.hex(F.length(text).cast("long")), 2 * (RECORD - DIGEST), "0")))
    turn = F.col("turn").cast("long")
    entry = F.struct(turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).alias("turn"), record.alias("record"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), entry.alias("x")).where("conv_id is not null")
    in_order = F.array_sort(F.collect_list("x"))
    return turns.groupBy("conv_id").agg(in_order.alias("x")).select("conv_id", F.unhex(F.array_join(F.transform("x", lambda x: F.hex(x["record"])), "")).alias("path"))


def part(path: str | Column, start: Column | int, turns: Column | int | None = None) -> Column:
    """Records of a path: from turn ``start`` (0 is the first), ``turns`` of them or all."""
    path, start = F.col(path) if isinstance(path, str) else path, F.lit(start)
    return F.substring(path, start * RECORD + 1, F.length(path) if turns is None else F.lit(turns) * RECORD)


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation, with the first turns of its family's first one."""
    own = written(own_paths(conversations), "own")
    family = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(FAMILY))
    firsts = own.where(F.pmod(F.col("conv_id"), F.lit(FAMILY)) == 0).select(F.col("conv_id").alias("family"), part("path", 0, SHARED - 1).alias("first"))
    shared = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    rows = own.select("conv_id", "path", family.alias("family"), shared.alias("h")).join(firsts, "family", "left")
    return rows.select("conv_id", F.concat(part(F.coalesce("first", F.unhex(F.lit(""))), 0, F.col("h")), part("path", F.col("h"))).alias("path"))


def path_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, n, least, ends) from rows (path, ids, n, least) sorted by path and least."""
    path, n, least, digest = None, 0, 0, hashlib.sha256()
    for batch in batches:
        rows = []
        for here, ids, count, first in zip(*(batch.column(c).to_pylist() for c in ("path", "ids", "n", "least")), strict=True):
            if here == path:
                n += count
                digest.update(b",")
            else:
                if path is not None:
                    rows.append((path, n, least, digest.hexdigest()))
                path, n, least, digest = here, count, first, hashlib.sha256()
            digest.update(ids.encode())
        if rows:
            yield _batch(rows, [pa.binary(), pa.int64(), pa.int64(), pa.string()], ["path", "n", "least", "ends"])
    if path is not None:
        yield _batch([(path, n, least, digest.hexdigest())], [pa.binary(), pa.int64(), pa.int64(), pa.string()], ["path", "n", "least", "ends"])


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def different_paths(rebuilt: DataFrame) -> DataFrame:
    """(path, n, least, ends) of every path: its conversations, their smallest id, the digest of all ids.

    Ids of equal paths are joined in groups of neighbouring ids first, so that a task that takes the digest of many
    reads few rows.
    """
    groups = rebuilt.groupBy("path", F.floor(F.col("conv_id") / TOGETHER).alias("group")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    rows = groups.select("path", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("least"))
    return written(rows.repartition("path").sortWithinPartitions("path", "least").mapInArrow(path_rows, PATHS), "paths")


# Bursting


def shared_turns(a: str, b: str) -> Column:
    """Number of leading records that two paths share."""
    shorter = F.floor(F.least(F.length(a), F.length(b)) / RECORD).cast("int")
    differ = F.filter(F.sequence(F.lit(0), shorter), lambda i: (i == shorter) | (F.substring(F.col(a), i * RECORD + 1, F.lit(RECORD)) != F.substring(F.col(b), i * RECORD + 1, F.lit(RECORD))))
    return F.array_min(differ)


def burst(paths: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(heads, ended, contained).

    heads: key, above (the head it hangs from), up (keys of all heads above), at (depth of the one above), depth, records of the turns
    from at to depth, least, n, parent (conv_id of the node above its first).  ended: (head, ends) of paths that end at a head.
    contained: the other paths, with the head that their container hangs from, next turn, depth of the head and its conv_id.
    """
    spark = paths.sparkSession
    size, n, least = paths.agg(F.count(F.lit(1)), F.sum("n"), F.min("least")).first()
    limit = limit or max(FEWEST, min(MOST, size // (4 * shuffle_partitions(spark))))
    key = "key binary, above binary, up array<binary>, at int, depth int, records binary, least long, n long, parent long"
    root = bytes(DIGEST)
    heads = [spark.createDataFrame([(root, None, [], -1, 0, b"", least, n, None)] if size else [], key)]
    open_paths = paths.select("*", F.lit(root).alias("head"), F.lit(0).alias("at"), F.lit(least).cast("long").alias("parent"))
    ended, contained = [], []
    while True:
        ended.append(open_paths.where(F.length("path") == F.col("at") * RECORD).select("head", "ends"))
        rest = open_paths.where(F.length("path") > F.col("at") * RECORD).withColumn("next", part("path", F.col("at"), 1))
        groups = rest.groupBy("head", "next").agg(
            F.count(F.lit(1)).alias("paths"), F.sum(F.length("path").cast("long")).alias("bytes"), F.min("path").alias("low"), F.max("path").alias("high"),
            F.min("least").alias("least"), F.sum("n").alias("n"), F.min("at").alias("at"), F.min("parent").alias("parent"),
        )
        large = groups.where((F.col("paths") > limit) | ((F.col("bytes") > BYTES) & (F.col("paths") > 1))).withColumn("depth", shared_turns("low", "high"))
        if len(heads) == 1:
            large = large.withColumn("up", F.array(F.lit(root)))
        else:
            large = large.join(heads[-1].select(F.col("key").alias("head"), F.concat("up", F.array("key")).alias("up")), "head")
        large = large.select(
            F.unhex(F.substring(F.sha2(part("low", 0, F.col("depth")), 256), 1, 2 * DIGEST)).alias("key"), "head", "next", "up", "at", "depth",
            part("low", F.col("at"), F.col("depth") - F.col("at")).alias("records"), "least", "n", "parent",
        )
        large = written(large, "heads")  # at most a head per `limit` paths
        if large.isEmpty():
            contained.append(rest)
            break
        contained.append(rest.join(large.select("head", "next"), ["head", "next"], "left_anti").select(*rest.columns))
        heads.append(large.withColumnRenamed("head", "above").select("key", "above", "up", "at", "depth", "records", "least", "n", "parent"))
        down = large.select("head", "next", "key", F.col("depth").alias("at"), F.col("least").alias("parent"))
        inside = rest.drop("at", "parent").join(down, ["head", "next"])
        open_paths = written(inside.select("path", "n", "least", "ends", F.col("key").alias("head"), "at", "parent"), "open")

    def union(frames: list[DataFrame]) -> DataFrame:
        every = frames[0]
        for more in frames[1:]:
            every = every.unionByName(more)
        return every

    return union(heads), union(ended), union(contained)


# Sweeping


class Sweep:
    """The nodes of containers, from their paths in order."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.container: tuple | None = None
        self.stack: list[list] = []
        self.path = b""

    def pop(self) -> None:
        """The deepest node is complete; so are its children, now that its smallest member is known."""
        depth, least, n, children, leaves, saved, ends, size, below = self.stack.pop()
        for row in below:
            self.rows.append((row[0], row[1], least, *row[2:], None))
        leaves, saved = leaves or 1, saved + (n - 1) * size
        row = (least, depth, n, children, leaves, saved, ends)
        if self.stack:
            above = self.stack[-1]
            above[1] = least if above[1] is None else min(above[1], least)
            above[2] += n
            above[3] += 1
            above[4] += leaves
            above[5] += saved
            above[8].append(row)
        else:
            head, _, _, parent = self.container
            self.rows.append((row[0], row[1], parent, *row[2:], head))

    def close(self) -> None:
        while self.stack:
            self.pop()

    def add(self, path: bytes, n: int, least: int, ends: str, container: tuple) -> None:
        turns, at = len(path) // RECORD, container[2]
        if container != self.container:
            self.close()
            self.container, same = container, at
        else:
            same, most = at, min(turns, len(self.path) // RECORD)
            while same < most and path[same * RECORD : (same + 1) * RECORD] == self.path[same * RECORD : (same + 1) * RECORD]:
                same += 1
            while len(self.stack) > same - at:
                self.pop()
        for depth in range(same + 1, turns + 1):
            size = int.from_bytes(path[depth * RECORD - RECORD + DIGEST : depth * RECORD], "big")
            self.stack.append([depth, None, 0, 0, 0, 0, NOTHING, size, []])
        node = self.stack[-1]
        node[1], node[2], node[6] = (least if node[1] is None else min(node[1], least)), node[2] + n, ends
        self.path = path


def node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*RESULT, "head"]
    types = [*[pa.int64()] * 7, pa.string(), pa.binary()]
    sweep = Sweep()
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("path", "n", "least", "ends", "head", "next", "at", "parent"))
        for path, n, least, ends, *container in zip(*columns, strict=True):
            sweep.add(path, n, least, ends, tuple(container))
            if len(sweep.rows) >= BATCH:
                yield _batch(sweep.rows, types, names)
                sweep.rows = []
    sweep.close()
    if sweep.rows:
        yield _batch(sweep.rows, types, names)


# Heads


def head_nodes(heads: DataFrame, ended: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes from the root down to the heads; all tables here have a row per head."""
    tops = nodes.where("head is not null").groupBy(F.col("head").alias("key")).agg(
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count(F.lit(1)).alias("tops"),
    )
    sizes = F.transform(F.sequence(F.lit(1), F.col("depth") - F.col("at")), lambda i: F.conv(F.hex(F.substring(F.col("records"), (i - 1) * RECORD + DIGEST + 1, F.lit(RECORD - DIGEST))), 16, 10).cast("long"))
    own = F.when(F.col("depth") == 0, F.array(F.lit(0).cast("long"))).otherwise(sizes)
    rows = heads.join(tops, "key", "left").fillna(0, ["leaves", "saved", "tops"]).withColumn("own", F.transform(own, lambda s: s * (F.col("n") - 1)))

    def total(x: str | Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)

    to_self = rows.select("key", "leaves", "saved", F.lit(0).alias("heads"))
    to_above = rows.select(F.explode("up").alias("key"), "leaves", (F.col("saved") + total("own")).alias("saved"), F.lit(0).alias("heads"))
    hang = rows.where("above is not null").select(F.col("above").alias("key"), F.lit(0).alias("leaves"), F.lit(0).alias("saved"), F.lit(1).alias("heads"))
    sums = to_self.unionByName(to_above).unionByName(hang).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("leaves", "saved", "heads")))
    full = rows.drop("leaves", "saved").join(sums, "key").join(ended.withColumnRenamed("head", "key"), "key", "left")
    chain = full.select("*", F.explode(F.sequence(F.col("at") + 1, F.col("depth"))).alias("k"))
    first, last = F.col("k") == F.col("at") + 1, F.col("k") == F.col("depth")
    below = total(F.slice("own", F.col("k") - F.col("at"), F.size("own")))
    return chain.select(
        F.col("least").alias("conv_id"),
        F.col("k").cast("long").alias("depth"),
        F.when(first, F.col("parent")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("tops") + F.col("heads")).otherwise(1).cast("long").alias("n_children"),
        F.greatest(F.col("leaves"), F.lit(1)).cast("long").alias("n_leaves"),  # a root without children is a leaf
        (F.col("saved") + below).cast("long").alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(NOTHING))).otherwise(NOTHING).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations."""
    paths = different_paths(rebuilt_paths(conversations))
    heads, ended, contained = burst(paths, limit)
    dealt = contained.select("path", "n", "least", "ends", "head", "next", "at", "parent").repartition("head", "next").sortWithinPartitions("head", "next", "path")
    nodes = written(dealt.mapInArrow(node_rows, NODES + ", head binary"), "nodes")
    return nodes.select(*RESULT).unionByName(head_nodes(heads, ended, nodes))
