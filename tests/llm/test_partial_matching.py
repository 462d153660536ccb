"""Language-model scores against a plain implementation that walks the contexts symbol by symbol."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from saltmarsh.llm import lm_scoring

END = 256


def model(texts):
    """Counts of the symbols after every context of 0 to 4 bytes; texts begin with zero bytes."""
    counts = defaultdict(Counter)
    for text in texts:
        symbols = [0, 0, 0, 0, *text, END]
        for i in range(4, len(symbols)):
            for order in range(5):
                counts[tuple(symbols[i - order : i])][symbols[i]] += 1
    return counts


def distribution(counts, context):
    """Probability of all 257 symbols after a context, escaping down with exclusion."""
    while context not in counts:
        if not context:
            return [1 / 257] * 257
        context = context[1:]
    p, left, excluded = [0.0] * 257, 1.0, set()
    while True:
        here = {s: c for s, c in counts[context].items() if s not in excluded}
        n, d = sum(here.values()), len(here)
        more = len(excluded) + d < 257
        if n:
            for s, c in here.items():
                p[s] = left * c / (n + d * more)
            left *= d * more / (n + d * more)
        excluded |= set(here)
        if not context or not more:
            break
        context = context[1:]
    rest = [s for s in range(257) if s not in excluded]
    for s in rest:
        p[s] = left / len(rest)
    return p


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "").encode()


@pytest.mark.parametrize("files", [False, True])
def test_scores_of_seen_and_unseen_texts(spark, tmp_path, files):
    rng = random.Random(4)
    words = ["river", "bank", "stone", "Öl", "water", "mill", "a", "of", "the", "😀"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(60)] + [(100, None), (101, "zq " * 40), (102, "the river"), (None, "the mill"), (102, "the river")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if files:
        df.coalesce(1).write.parquet(str(tmp_path / "docs.parquet"))
        df = spark.read.parquet(str(tmp_path / "docs.parquet"))
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = model([lower(t) for d, t in rows if not held(d)])
    known = {}

    def want(text):
        symbols, total = [0, 0, 0, 0, *lower(text), END], 0.0
        for i in range(4, len(symbols)):
            context = tuple(symbols[i - 4 : i])
            if context not in known:
                known[context] = distribution(counts, context)
                assert abs(sum(known[context]) - 1) < 1e-9
            total += math.log10(known[context][symbols[i]])
        return total

    got = lm_scoring.score(df).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    texts = dict(rows)
    for r in got:
        assert r["held_out"] == held(r["doc_id"]) and abs(r["score"] - want(texts[r["doc_id"]])) < 1e-5 * max(1, abs(r["score"])), r
    assert any(r["held_out"] for r in got)


def test_a_context_of_any_rarity_is_learned(spark):
    """The trie grows with the corpus: one text more changes what is predicted after its contexts."""
    filler = [(1000 + i, f"common words of the corpus number {i}") for i in range(400)]
    trained = next(d for d in range(500) if zlib.crc32(str(d).encode()) % 7 != 2)
    asked = next(d for d in range(500, 1000) if zlib.crc32(str(d).encode()) % 7 == 2)
    text = "xylo quartz jigsaw"
    schema = "doc_id long, text string"
    without = {r["doc_id"]: r["score"] for r in lm_scoring.score(spark.createDataFrame([*filler, (asked, text)], schema)).collect()}
    among = {r["doc_id"]: r["score"] for r in lm_scoring.score(spark.createDataFrame([*filler, (asked, text), (trained, text)], schema)).collect()}
    assert among[asked] > without[asked] / 2


def test_blocks_and_their_grams_can_be_many(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK", 500)
    monkeypatch.setattr(lm_scoring, "CONTEXTS", 16)
    docs = spark.createDataFrame([(i, f"row {i} " * (i % 9)) for i in range(200)], "doc_id long, text string")
    many = {r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in lm_scoring.score(docs).collect()}
    monkeypatch.undo()
    few = {r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in lm_scoring.score(docs).collect()}
    assert many.keys() == few.keys() and all(abs(a - b) < 1e-6 for d in few for a, b in zip(few[d], many[d], strict=True))
