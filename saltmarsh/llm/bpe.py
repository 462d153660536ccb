"""Byte-level BPE encoding and decoding as a tree reduction over a monoid.

An element of the monoid is a part of a text with its ids.  A text is halved until its parts are short, the parts are
encoded alone, and neighbours are joined up the tree.  A part may end anywhere, so a join encodes a window
around the boundary anew, as wide as it must be for the ids outside of it to stand:

* Where a character that isn't white space meets one that is, or a letter or number one that isn't, the split
  pattern begins a new match whatever comes before and after, and no match before it looks further.  So the window
  reaches from the last such place of the left part (``CUT``) to the first of the right part, and from end to end of a part
  that has none.
* Where that window is one long match, most of its ids stand too: a sequence of tokens is the encoding of its
  bytes if, and only if, every two neighbours are the encoding of their own bytes, because up to the first merge
  over a border between tokens the merges on both sides come in the same order as in the two tokens alone.  So the last
  and first k tokens that meet are encoded anew, k doubling, until the new tokens agree with the neighbours that stay.

Decoding halves the ids, and joins the bytes of the halves.

Null and empty texts have no ids.  A text of any length is one row's work: its matches and ids are held by the
task that encodes it, as its text is.  Repeated rows and rows with a null doc_id are encoded as rows of their own; an empty
table gives an empty result; columns other than doc_id and text are left out.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import pieces, plain

VOCABULARY = "byte_bpe_50k"
#: Where the split pattern always begins a match.
CUT = r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})"
#: Characters of a part that is encoded alone, characters of a match from which its outer ids are kept, ids decoded at once.
PART, LONG, SOME_IDS = 2048, 256, 4096
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

Tokens = list[int]


class Vocabulary:
    """Ranks of byte strings and the pattern that splits texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, part: int = PART, long: int = LONG):
        import regex
        import tiktoken

        self.ranks, self.part, self.long = ranks, part, long
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.library = tiktoken.Encoding("saltmarsh", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first_cut, self.last_cut = regex.compile(CUT).search, regex.compile("(?r)" + CUT).search
        self.one_match = regex.compile(pattern).fullmatch

    @classmethod
    def load(cls, name: str = VOCABULARY) -> Vocabulary:
        import public_tokenizers

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        return cls(ranks, public_tokenizers.PATTERN)

    # Ids within a match

    def merged(self, data: bytes) -> Tokens:
        """Ids of ``data`` by merging its lowest pair, the leftmost of equal ones, until none can be merged."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        n = len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[data[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if data[i : i + 2] in ranks]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if not alive[i] or after[i] != j or j >= n or not alive[j] or after[j] != end:
                continue
            alive[j] = 0
            after[i] = end
            if end < n:
                before[end] = i
                rank = ranks.get(data[i : after[end]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end, after[end]))
            if i:
                rank = ranks.get(data[before[i] : end])
                if rank is not None:
                    heapq.heappush(heap, (rank, before[i], i, end))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[data[i : after[i]]])
            i = after[i]
        return ids

    def content(self, ids: Tokens) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def agree(self, a: int, b: int) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes."""
        return self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def joined(self, left: Tokens, right: Tokens) -> Tokens:
        """The encoding of two encodings' bytes together."""
        if not left or not right:
            return left + right
        if self.agree(left[-1], right[0]):
            return left + right
        i, j, step_left, step_right = len(left), 0, 2, 2
        left_stands = right_stands = False
        while True:
            if not left_stands:
                i, step_left = max(i - step_left, 0), 2 * step_left
            if not right_stands:
                j, step_right = min(j + step_right, len(right)), 2 * step_right
            window = self.merged(self.content(left[i:] + right[:j]))
            left_stands = i == 0 or self.agree(left[i - 1], window[0])
            right_stands = j == len(right) or self.agree(window[-1], right[j])
            if left_stands and right_stands:
                return left[:i] + window + right[j:]

    # Texts

    def tokens_of(self, ids: Tokens, size: int) -> int:
        """How many tokens hold the last ``size`` bytes of ``ids``."""
        n = 0
        while size > 0:
            n += 1
            size -= len(self.bytes_of[ids[-n]])
        return n

    def join(self, left: str, left_ids: Tokens, right: str, right_ids: Tokens) -> Tokens:
        """The ids of two neighbouring parts together."""
        last, first = self.last_cut(left), self.first_cut(right)
        tail = left[last.start() :] if last else left
        head = right[: first.start()] if first else right
        stay = len(left_ids) - self.tokens_of(left_ids, len(tail.encode()))
        size, go = len(head.encode()), 0
        while size > 0:
            size -= len(self.bytes_of[right_ids[go]])
            go += 1
        window = tail + head
        if len(window) > self.long and self.one_match(window) and self.one_match(tail) and self.one_match(head):
            between = self.joined(left_ids[stay:], right_ids[:go])
        else:
            between = self.library.encode_ordinary(window)
        return left_ids[:stay] + between + right_ids[go:]

    def encode(self, text: str) -> Tokens:
        if len(text) <= self.part:
            return self.library.encode_ordinary(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def decode(self, ids: Tokens) -> bytes:
        if len(ids) <= SOME_IDS:
            return self.content(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def packed(ids: Tokens) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return np.array(ids, dtype="<u4").tobytes()


def encode_rows(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary.load(name)
    for batch in batches:
        for part in pieces(batch, "text"):
            ids = [packed(vocabulary.encode(text)) for text in plain(part.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, type=pa.binary())], names=["doc_id", "ids"])


def decode_rows(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary.load(name)
    for batch in batches:
        for part in pieces(batch, "ids"):
            texts = [vocabulary.decode(np.frombuffer(ids or b"", dtype="<u4").tolist()) for ids in part.column("ids").to_pylist()]
            columns = [part.column(c) for c in part.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, type=pa.binary())], names=[*(c for c in part.schema.names if c != "ids"), "decoded"])


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every text; ids are little-endian unsigned 32-bit integers one after another."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: encode_rows(it, vocabulary), "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, decoded) of every row of (doc_id, ids); decoded holds bytes, null ids give none."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: decode_rows(it, vocabulary), "doc_id long, decoded binary")


def digest_rows(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary.load(name)

    def digest(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    for batch in batches:
        for part in pieces(batch, "text"):
            rows = []
            for text in plain(part.column("text")).to_pylist():
                ids = vocabulary.encode(text)
                rows.append((len(ids), digest(packed(ids)), digest(vocabulary.decode(ids))))
            n, ids_digest, decoded_digest = zip(*rows, strict=True)
            columns = [part.column("doc_id"), pa.array(n, type=pa.int64()), pa.array(ids_digest), pa.array(decoded_digest)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, number of ids, and SHA-256 of the ids and of the bytes that they decode to.

    Encoding and decoding share a task, so ids are not sent from one Python worker to the next.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: digest_rows(it, vocabulary), RESULT)
