"""The index of sums against every combination, plans against their rules, ids of odd strings, edges of the table."""

import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from saltmarsh.llm import packing


def best_fill(gap, left):
    """The fewest and then the longest lengths that sum to the gap, over all combinations of up to three."""
    have = [x for x in range(len(left)) if left[x] > 0]
    for size in (1, 2, 3):
        fits = [c for c in itertools.combinations_with_replacement(sorted(have, reverse=True), size) if sum(c) == gap and all(left[x] >= n for x, n in Counter(c).items())]
        if fits:
            return list(max(fits))
    return None


def test_fills_are_the_best_of_all_combinations():
    rng = random.Random(3)
    for _ in range(60):
        counts = np.zeros(31, dtype=np.int64)
        for _ in range(rng.randrange(1, 14)):
            counts[rng.randrange(1, 31)] = rng.choice((1, 1, 2, 5))
        index = packing.SumIndex(counts)
        while index.left.any():
            for gap in range(1, 31):
                got, want = index.fill(gap), best_fill(gap, index.left)
                assert (got is None) == (want is None) and (got is None or sorted(got, reverse=True) == want), (gap, index.left.tolist())
            x = rng.choice(np.flatnonzero(index.left).tolist())
            index.use(np.array([x]), np.array([rng.randint(1, int(index.left[x]))]))


def test_plans_use_every_piece_once():
    rng = random.Random(5)
    for capacity in (1, 2, 9, 64, 300):
        for _ in range(20):
            counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))}
            plan = packing.plan_sequences(counts, capacity)
            used = Counter()
            for lengths, often in plan:
                assert sum(lengths) <= capacity and often > 0
                used.update({x: often * n for x, n in Counter(lengths).items()})
            assert used == counts
            open_ends = [sum(lengths) for lengths, _ in plan if 2 * sum(lengths) <= capacity]
            assert len(open_ends) <= 1  # two sequences that fit into one are never left
    assert packing.plan_sequences({}) == []


def test_ids_of_odd_strings_are_those_of_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = ["a", "the", " ", "  ", "\n", "\t", "\r", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", " ", "　", "<|endoftext|>", "'s", "'", "1", "é", "日", "🙂", "!", "\x00"]
    rng = random.Random(11)
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 25))) for _ in range(600)]
    ids, counts = packing.Encoder().encode(pa.array(texts, type=pa.string()))
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        at += n


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, "one two", 1, "x"), (None, None, 2, "y"), (3, "", 3, None), (3, "", 3, None), (4, "word " * 9000, 4, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, sequence_id string")
    got = packing.pack(df).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == {None: 2, 3: 2, 4: 1}
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, a, n), (t, b, _) in itertools.pairwise(places):
        assert b == a + n if s == t else b == 0
    assert packing.pack(df.limit(0)).collect() == []
