"""The pipeline's near-copy stage against exact similarities, and rows without an id of their own."""

import random

import corpus_pipeline as cp
from saltmarsh.llm import near_copies

ROW = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(rng, words, share):
    return " ".join(f"new{rng.random()}" if rng.random() < share else w for w in words)


def test_near_copies_of_every_similarity_from_the_bound_on(spark):
    rng = random.Random(7)
    rows, pairs = [], []
    for k in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 200, 600)))]
        other = edited(rng, words, rng.choice((0.005, 0.01, 0.02, 0.03, 0.06)))
        rows += [(2 * k, " ".join(words), "en", "s", 1), (2 * k + 1, other, "en", "s", 1)]
        pairs.append((2 * k + 1, jaccard(rows[-2][1], other)))
    kept = {r["doc_id"] for r in cp.near_duplicates(spark, spark.createDataFrame(rows, ROW), "").collect()}
    near = [d for d, j in pairs if j >= 0.8]
    far = [d for d, j in pairs if j < 0.8]
    print(f"near copies {len(near)}, found {sum(d not in kept for d in near)}; others {len(far)}, kept {sum(d in kept for d in far)}")
    assert len(near) > 40 and len(far) > 40 and not kept & set(near) and kept >= set(far)
    assert all(2 * k in kept for k in range(150))


def test_blocks_of_a_large_group_lose_no_link(spark):
    words = [f"w{i}" for i in range(300)]
    chain = []
    for i in range(60):  # each text is near the next, the ends are far apart
        words = [*words[:5 * i], f"x{i}", *words[5 * i + 1 :]] if 5 * i < 300 else words
        chain.append((i, " ".join(words), "en", "s", 1))
    df = spark.createDataFrame([*chain, (100, "something else altogether", "en", "s", 1)], ROW)
    assert jaccard(chain[0][1], chain[-1][1]) < 0.1
    assert {r["doc_id"] for r in near_copies.first_of_each(df, block=8).collect()} == {0, 100}


def test_groups_of_long_texts_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BYTES", 3000)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]]), "en", "s", 1) for i in range(0, 400, 20)]
    kept = near_copies.first_of_each(spark.createDataFrame([*rows, (999, "something else altogether", "en", "s", 1)], ROW)).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 999]


def test_rows_with_null_or_repeated_ids_are_rows_of_their_own(spark):
    rows = [
        (None, "a clean and unique text about the river", "en", "s", 1),
        (None, "another text that has nothing in common with it", "en", "s", 1),
        (5, "the fifth text speaks of bread and butter", "en", "s", 1),
        (5, "a very different matter under the same number", "en", "s", 1),
        (3, "first of a group of copies", "en", "s", 1),
        (7, "first of a group of copies", "en", "t", 1),
        (None, "first of a group of copies", None, "s", 1),
        (7, "this row shares an id with a copy", "en", "s", 1),
        (8, "repeated whole", "en", None, 1),
        (8, "repeated whole", "en", None, 1),
        (None, None, None, None, None),
        (9, "", None, None, 0),
    ]
    df = spark.createDataFrame(rows, ROW)
    want = sorted([rows[0], rows[1], rows[2], rows[3], rows[4], rows[7], rows[8], rows[11]], key=str)
    for some in (df, df.repartition(5)):
        assert sorted(map(tuple, cp.near_duplicates(spark, some, "").collect()), key=str) == want
    assert cp.near_duplicates(spark, df.limit(0), "").count() == 0
