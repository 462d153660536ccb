"""Language-model scoring: prediction by partial matching over a byte-context trie.

Counts of the byte that follows every context of up to ``ORDER`` bytes are taken over all training texts.  At a
context of n occurrences and d different symbols (without those that a longer context has seen, which are
excluded), an escape takes d / (n + d) and a symbol its count / (n + d); below the empty context all symbols left
are alike.  A symbol's probability in a context is thus fixed once the trie is, so the model is a table and a
text is scored by look-ups.

No context is left out, so the trie grows with the corpus.  Contexts of up to ``SHORT`` bytes, at most 256**SHORT of
them, are sent to all tasks; longer ones are a table dealt by a context's last bytes, and their probabilities are joined to
the blocks of texts that hold them.

The base score adds up add-one probabilities of the text's words and its end.  Words are counted in
blocks: the different words of a block of rows (a file split, or a hash of the rows where there are no
files), counts added by word, and the counts joined back to the blocks.  No table of all words is sent
anywhere; a word of every block is a row per block.  A-Z are lower-cased in both scores.

Null texts are empty texts (the end alone); a very long text is scored whole, as a piece of its own; a null doc_id counts
as the empty string in the training split; repeated rows are rows of their own, in training as well; without training rows all
counts are zero and the model is uniform; an empty table gives an empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import pieces, plain, raw, strings, sums_by, word_spans
from .shared import shuffle_partitions, written

ORDER = 4
END = 256
SYMBOLS = 257
#: Longest context in the part of the trie that all tasks have; longer ones are dealt out.
SHORT = 2
#: Contexts of four bytes worked on at once.
CONTEXTS = 1024
FOLDS, HELD_OUT = 7, 2
#: Bits of a gram: a symbol and ORDER bytes.
GRAM_BITS = 9 + 8 * ORDER
#: Bytes of text in a block, about.
BLOCK = 16 << 20
#: Bytes of text that a task works on at once, at least and at most (or one long text).
PIECE, RUN = 8 << 20, 18 << 20

GATHERED = "block long, word binary, gram long, n long"


def framed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with ORDER zero bytes before and an end after every text; their places; the symbols of each text."""
    sizes = np.diff(offsets)
    texts = len(sizes)
    symbols = np.zeros(len(data) + texts * (ORDER + 1), dtype=np.uint16)
    shift = np.arange(texts) * (ORDER + 1) + ORDER
    place = np.ones(len(data) + texts, dtype=np.int64)
    place[offsets[:-1] + np.arange(texts)] = ORDER + 1
    place = np.cumsum(place) - 1
    ends = offsets[1:] + shift
    inside = np.ones(len(place), dtype=bool)
    inside[offsets[1:] + np.arange(texts)] = False
    symbols[place[inside]] = data
    symbols[ends] = END
    return symbols, place, sizes + 1


def gram_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram (context of four bytes, symbol) at every place of every text, and the number of each text."""
    symbols, place, sizes = framed(data, offsets)
    wide = symbols.astype(np.int64)
    key = wide[place]
    for back in range(1, ORDER + 1):
        key |= wide[place - back] << (1 + 8 * back)
    return key, sizes


def counted_grams(texts: pa.StringArray, code: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different (code of the block, gram) keys and how often they occur in training texts."""
    key, sizes = gram_keys(*raw(texts))
    key = (np.repeat(code.astype(np.int64), sizes) << GRAM_BITS | key) << 1 | np.repeat(trained.astype(np.int64), sizes)
    key.sort()
    return added(key >> 1, key & 1)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of a sorted array, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def words_of(texts: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all texts, encoded, and the number of each text."""
    data, offsets = raw(texts)
    starts, stops, counts = word_spans(data, offsets)
    return strings(data, starts, stops).dictionary_encode(), counts


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about PIECE to RUN bytes of text, cut where a block ends if they can be."""
    held: list[pa.RecordBatch] = []
    size = 0

    def all_held() -> pa.RecordBatch:
        out = pa.concat_batches(held)
        held.clear()
        return out

    for batch in batches:
        for part in pieces(batch, "text", PIECE // 4):
            block = part.column("block").to_numpy()
            if held and size >= PIECE and (size >= RUN or held[-1].column("block")[-1].as_py() != block[0]):
                yield all_held()
                size = 0
            elif held and size >= PIECE and len(ends := np.flatnonzero(block[1:] != block[:-1])):
                held.append(part.slice(0, int(ends[0]) + 1))
                yield all_held()
                part, size = part.slice(int(ends[0]) + 1), 0
            held.append(part)
            size += part.column("text").nbytes
    if held:
        yield all_held()


def gather_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the words and of the grams of each block with their training count (0: held out alone)."""
    for part in runs(batches):
        texts = pc.ascii_lower(plain(part.column("text")))
        trained = part.column("trained").to_numpy(zero_copy_only=False)
        words, counts = words_of(texts)
        codes = words.indices.to_numpy()
        size = max(len(words.dictionary), 1)
        names, block_code = np.unique(part.column("block").to_numpy(), return_inverse=True)
        cell = np.repeat(block_code, counts).astype(np.int64) * size + codes
        total = np.bincount(cell, minlength=0) if len(cell) else np.zeros(0, np.int64)
        learned = np.bincount(cell[np.repeat(trained, counts)], minlength=len(total)) if len(cell) else total
        cells = np.flatnonzero(total)
        n = len(cells)
        word_block = names[cells // size] if n else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(word_block, type=pa.int64()), words.dictionary.take(pa.array(cells % size)), pa.nulls(n, pa.int64()), pa.array(learned[cells], type=pa.int64())], names=["block", "word", "gram", "n"])
        del words, codes, cell, total, learned
        whole = pa.RecordBatch.from_arrays([texts, pa.array(block_code), pa.array(trained)], names=["text", "code", "trained"])
        some = [counted_grams(plain(own.column(0)), own.column(1).to_numpy(), own.column(2).to_numpy(zero_copy_only=False)) for own in pieces(whole, "text", PIECE // 4)]
        keys, times = (np.concatenate(x) for x in zip(*some, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, times = added(keys[order], times[order])
        yield pa.RecordBatch.from_arrays([pa.array(names[keys >> GRAM_BITS], type=pa.int64()), pa.nulls(len(keys), pa.binary()), pa.array(keys & ((1 << GRAM_BITS) - 1)), pa.array(times)], names=["block", "word", "gram", "n"])


@dataclass
class Trie:
    """Contexts of up to SHORT bytes.  Node 0 is the empty context and node 1 stands for none.
    ``longer[node, byte]``: the context with ``byte`` before it.  Of each node and symbol: the probability, the
    same given that no longer context had the symbol, and the count."""

    longer: np.ndarray
    prob: np.ndarray
    escaped: np.ndarray
    counts: np.ndarray

    def longest(self, context: np.ndarray) -> np.ndarray:
        """The node of the longest known end of each context."""
        node = np.zeros(len(context), dtype=np.int32)
        best = node
        for back in range(SHORT):
            node = self.longer[node, (context >> 8 * back) & 255]
            best = np.where(node != 1, node, best)
        return best


def level(own: np.ndarray, parent_counts: np.ndarray, parent_escaped: np.ndarray, lowest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities at contexts with counts ``own``, and the same given that no longer context had the symbol."""
    seen = own > 0
    n, d = own.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
    rest_counts = np.where(seen, 0, parent_counts)
    rest_seen = rest_counts > 0
    rest_n, rest_d = rest_counts.sum(axis=1, keepdims=True), rest_seen.sum(axis=1, keepdims=True)
    below = np.where(seen, 0, 1.0) if lowest else np.where(seen | rest_seen, 0, parent_escaped)
    mass = below.sum(axis=1, keepdims=True)
    below = np.divide(below, mass, out=np.zeros_like(below), where=mass > 0)
    rest_d = np.where(mass > 0, rest_d, 0)  # nothing to escape to
    with np.errstate(invalid="ignore", divide="ignore"):
        here = np.where(rest_seen, rest_counts / (rest_n + rest_d), 0)
        out = np.where(rest_n > 0, rest_d / (rest_n + rest_d), 1.0) * below + here
    d = np.where(d < SYMBOLS, d, 0)
    return np.where(seen, own / (n + d), d / (n + d) * out), out


def dense(context: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different contexts in order, and a row of counts of every symbol for each."""
    contexts, row = np.unique(context, return_inverse=True)
    own = np.zeros((len(contexts), SYMBOLS))
    np.add.at(own, (row, symbol), count)
    return contexts, own


def build(context: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> Trie:
    """From counts of symbols after contexts of SHORT bytes; a context's last bytes are a context too."""
    longer = np.full((2, 256), 1, dtype=np.int32)
    prob = np.full((2, SYMBOLS), 1.0 / SYMBOLS)
    escaped, counts = prob.copy(), np.zeros((2, SYMBOLS))
    if not len(context):
        return Trie(longer, prob, escaped, counts)
    ids_before, contexts_before = np.array([0]), np.array([0], dtype=np.int64)
    for order in range(SHORT + 1):
        contexts, own = dense(context & ((1 << 8 * order) - 1), symbol, count)
        if order == 0:
            prob[:1], escaped[:1] = level(own, np.zeros((1, SYMBOLS)), np.ones((1, SYMBOLS)), lowest=True)
            counts[:1] = own
            continue
        parents = ids_before[np.searchsorted(contexts_before, contexts & ((1 << 8 * (order - 1)) - 1))]
        ids = np.arange(len(prob), len(prob) + len(contexts))
        longer[parents, contexts >> 8 * (order - 1)] = ids
        longer = np.concatenate([longer, np.full((len(contexts), 256), 1, dtype=np.int32)])
        now, out = level(own, counts[parents], escaped[parents])
        prob, escaped, counts = np.concatenate([prob, now]), np.concatenate([escaped, out]), np.concatenate([counts, own])
        ids_before, contexts_before = ids, contexts
    return Trie(longer, prob, escaped.astype(np.float32), counts.astype(np.float32))


def train(grams: DataFrame) -> Trie:
    """The contexts of up to SHORT bytes, from (gram, n); the driver receives their counts alone."""
    short = grams.where("n > 0").groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * SHORT + 9)) - 1)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    gram, n = short["gram"].to_numpy(), short["n"].to_numpy()
    order = np.argsort(gram, kind="stable")
    return build(gram[order] >> 9, gram[order] & 511, n[order].astype(np.float64))


def gram_logs(trie: Trie, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 probability of the symbol of each gram in its context; all grams with the same last three bytes of context are here, together."""
    context, symbol = gram >> 9, gram & 511
    third = context & 0xFFFFFF
    node = trie.longest(context)
    p = trie.prob[node, symbol]
    learned = n > 0
    if learned.any():
        at = third[learned]
        contexts3, own3 = dense(at, symbol[learned], n[learned])
        parents = trie.longest(contexts3)  # known: the training texts have them
        prob3, escaped3 = level(own3, trie.counts[parents], trie.escaped[parents])
        row = np.minimum(np.searchsorted(contexts3, third), len(contexts3) - 1)
        p = np.where(contexts3[row] == third, prob3[row, symbol], p)
        contexts4, own4 = dense(context[learned], symbol[learned], n[learned])
        above = np.searchsorted(contexts3, contexts4 & 0xFFFFFF)
        prob4, _ = level(own4, own3[above], escaped3[above])
        row = np.minimum(np.searchsorted(contexts4, context), len(contexts4) - 1)
        p = np.where(contexts4[row] == context, prob4[row, symbol], p)
    with np.errstate(divide="ignore"):
        return np.log10(p)


def log_rows(batches: Iterator[pa.RecordBatch], trie: Trie) -> Iterator[pa.RecordBatch]:
    """Adds logs to grams that come sorted by the last three bytes of their contexts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def done(gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        third = (gram >> 9) & 0xFFFFFF
        cuts = np.flatnonzero(third[1:] != third[:-1]) + 1
        start = 0
        while start < len(gram):  # runs of whole keys of about CONTEXTS grams, one key at least
            later = cuts[np.searchsorted(cuts, start + CONTEXTS) :]
            stop = int(later[0]) if len(later) else len(gram)
            part = gram[start:stop]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(gram_logs(trie, part, n[start:stop]))], names=["gram", "log"])
            start = stop

    for batch in batches:
        gram, n = batch.column("gram").to_numpy(), batch.column("n").to_numpy()
        if not len(gram):
            continue
        held.append((gram, n))
        size += len(gram)
        if size >= 32 * CONTEXTS:
            gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
            third = (gram >> 9) & 0xFFFFFF
            cut = int(np.flatnonzero(third == third[-1])[0])  # the last key may go on
            yield from done(gram[:cut], n[:cut])
            held, size = [(gram[cut:], n[cut:])], len(gram) - cut
    if held:
        yield from done(*(np.concatenate(x) for x in zip(*held, strict=True)))


def trie_scores(texts: pa.StringArray, known: pa.Array, logs: np.ndarray) -> np.ndarray:
    """log10 probability of every text and its end; A-Z are to be lower-cased before."""
    keys, sizes = gram_keys(*raw(texts))
    return sums_by(logs[pc.index_in(pa.array(keys), known).to_numpy(zero_copy_only=False)], sizes)


def base_scores(texts: pa.StringArray, known: pa.Array, counts: np.ndarray, total: int, different: int, end_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, known tokens and base score of every text."""
    words, numbers = words_of(texts)
    place = pc.fill_null(pc.index_in(words.dictionary, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    c = np.where(place >= 0, np.append(counts, 0)[place], 0)[words.indices.to_numpy()]
    logs = sums_by(np.log10(c + 1.0), numbers) + np.log10(end_count + 1.0) - (numbers + 1) * np.log10(total + different + 1.0)
    return numbers + 1, sums_by((c > 0).astype(np.float64), numbers).astype(np.int64) + (end_count > 0), logs


def block_of(docs: DataFrame, rows: int, size: int) -> Column:
    """The run of rows of a file that a row is in, from its place in the file; a hash of the row where rows don't come from files."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(shuffle_partitions(docs.sparkSession), blocks_in(size))))
    return F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / max(1, rows * BLOCK // max(size, 1))))


def blocks_in(size: int) -> int:
    return -(-max(size, 1) // BLOCK)


def score(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    trained = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))) % folds != held_out
    n_rows, ends, size = docs.agg(F.count(F.lit(1)), F.count(F.when(trained, 1)), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), trained.alias("trained"), block_of(docs, n_rows, size).alias("block"))
    gathered = written(rows.select("text", "trained", "block").mapInArrow(gather_rows, GATHERED), "gathered")
    words = gathered.where("word is not null").select("block", "word", "n")
    counts = written(words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "words")
    n_words, different = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, different = n_words + ends, different + (ends > 0)
    block_grams = gathered.where("gram is not null").select("block", "gram", "n")
    grams = written(block_grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    trie = spark.sparkContext.broadcast(train(grams))  # contexts of up to SHORT bytes
    dealt = grams.withColumn("third", F.shiftright("gram", 9).bitwiseAND(F.lit(0xFFFFFF)))
    dealt = dealt.repartition("third").sortWithinPartitions("third", "gram").select("gram", "n")
    logs = written(dealt.mapInArrow(lambda it: log_rows(it, trie.value), "gram long, log double"), "logs")
    no_word, no_gram = [F.lit(None).cast(t).alias(c) for c, t in (("word", "binary"), ("c", "long"))], [F.lit(None).cast(t).alias(c) for c, t in (("gram", "long"), ("log", "double"))]
    back = words.join(counts, "word").select("block", "word", "c", *no_gram).unionByName(block_grams.join(logs, "gram").select("block", *no_word, "gram", "log"))

    def rows_of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        own, seen_grams = right.filter(pc.is_valid(right["word"])), right.filter(pc.is_valid(right["gram"]))
        known = own["word"].combine_chunks() if own.num_rows else pa.array([], pa.binary())
        known_grams = seen_grams["gram"].combine_chunks() if seen_grams.num_rows else pa.array([], pa.int64())
        known_counts, known_logs = own["c"].to_numpy(), seen_grams["log"].to_numpy()
        out = []
        for batch in left.combine_chunks().to_batches():
            for part in pieces(batch, "text", PIECE // 4):
                texts = pc.ascii_lower(plain(part.column("text")))
                tokens, seen, base = base_scores(texts, known, known_counts, total, different, ends)
                held = pc.invert(part.column("trained"))
                out.append(pa.RecordBatch.from_arrays([part.column("doc_id"), held, pa.array(tokens), pa.array(seen), pa.array(np.full(len(texts), total)), pa.array(base), pa.array(trie_scores(texts, known_grams, known_logs))], names=SCORED.names))
        return pa.Table.from_batches(out, schema=SCORED)

    blocks = blocks_in(size)
    parts = max(min(blocks, shuffle_partitions(spark)), blocks // 2)  # a task holds a few blocks, however many there are
    sides = [x.repartition(parts, "block").groupBy("block") for x in (rows, back)]
    return sides[0].cogroup(sides[1]).applyInArrow(rows_of_block, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
