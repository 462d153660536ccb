"""The log ratio of op10 and the rates of op8 against plain code, and packing of many equal pieces."""

import re
from collections import Counter

import numpy as np
import xxhash

from saltmarsh.llm import mixing, packing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string"


def hashed(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def grams(text):
    """Buckets of the words and word pairs of a text."""
    own = [hashed(w.encode()) for w in WORD.findall(text or "")]
    pairs = [hashed(b.to_bytes(8, "little"), hashed(a.to_bytes(8, "little"))) for a, b in zip(own, own[1:], strict=False)]
    return [h % quality_rules.BUCKETS for h in own + pairs]


def corpus(rng, n):
    words = [f"w{i}é" for i in range(300)]
    return [" ".join(rng.choice(words[: 40 + 5 * (i % 50)], size=int(rng.integers(1, 60)))) for i in range(n)]


def test_log_ratio_and_verdict_against_plain_counts(spark):
    rng = np.random.default_rng(3)
    texts = [*corpus(rng, 60), "", None, " ".join(f"w{i % 211}é" for i in range(30_000))]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, texts[0], "en", "s"), (1, texts[1], "en", "s")], DOCS)
    # Labels that disagree are settled by the majority, a tie counts as good, nulls are left out.
    labels = [(i, i % 2) for i in range(40)] + [(2, 1), (4, 1), (4, 1), (6, None), (None, 1)]
    marks = {}
    for i, label in labels:
        if i is not None and label is not None:
            marks.setdefault(i, []).append(label)
    good = {i for i, got in marks.items() if 2 * sum(got) >= len(got)}
    target, whole = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for i, text in [*enumerate(texts), (None, texts[0]), (1, texts[1])]:
        for b in grams(text):
            whole[b] += 1
            target[b] += i in good
    ratio = np.log((target + 1) / (target.sum() + quality_rules.BUCKETS)) - np.log((whole + 1) / (whole.sum() + quality_rules.BUCKETS))
    rows = quality_rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = texts[0 if r["doc_id"] is None else r["doc_id"]]
        own = grams(text)
        want = float(ratio[own].mean()) if own else 0.0
        assert abs(r["llr"] - want) < 1e-9
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_symbols"] == sum((text or "").count(c) for c in quality_rules.SYMBOLS)
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality_rules.THRESHOLD)


def test_a_score_at_the_threshold_is_kept(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, text, "en", "s")], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judge(docs, labels, threshold=0.0).first()["kept"]
    assert not quality_rules.judge(docs, labels, threshold=1e-9).first()["kept"]


def test_rates_against_a_plain_classifier_and_dual_ascent(spark):
    rng = np.random.default_rng(9)
    names = ["de", "en", "es", "fr"]
    rows = []
    for i in range(240):
        lang = names[int(rng.choice(4, p=[0.1, 0.7, 0.05, 0.15]))]
        own, other = [f"{lang}{k}" for k in range(40)], [f"x{k}" for k in range(40)]
        size = int(rng.integers(1, 50))
        rows.append((i, " ".join(rng.choice(own if rng.random() < 0.8 else other) for _ in range(size)), lang, "s"))
    rows += [(1000, "", "en", "s"), (1001, None, None, "s"), (None, "en1 en2", "en", "s"), (0, "de1 fr1", "de", "s")]
    marked = {*range(0, 240, 2), 1000}
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 1) for i in (*marked, 0, None)], "doc_id long, quality int")
    counts, seen = np.zeros((4, mixing.BUCKETS)), np.zeros(4)
    buckets = [[hashed(w.encode()) % mixing.BUCKETS for w in WORD.findall(t or "")] for _, t, _, _ in rows]
    for (i, _, lang, _), own in zip(rows, buckets, strict=True):
        if i in marked and lang in names:
            seen[names.index(lang)] += 1
            np.add.at(counts[names.index(lang)], own, 1)
    weights = np.log((counts + mixing.SMOOTHING) / (counts.sum(axis=1, keepdims=True) + mixing.SMOOTHING * mixing.BUCKETS))
    score = np.array([weights[:, own].sum(axis=1) * mixing.EVIDENCE / max(len(own), mixing.EVIDENCE) + np.log(seen / seen.sum()) for own in buckets])
    p = np.exp(score - score.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    t = np.array([len(own) for own in buckets], dtype=float)
    aim = np.array([mixing.TARGETS[d] for d in names]) * t.sum()
    pulls = np.zeros(4)
    for _ in range(40_000):
        r = np.maximum(0, 1 - p @ pulls)
        pulls += 0.2 * (p.T @ (t * r) - aim) / t.sum()
    want = Counter()
    for (i, text, _, _), n, share, rate in zip(rows, t, p, np.where(t > 0, r, 1.0), strict=True):
        want[(i, int(n), *np.round(share, 6).tolist(), round(float(rate), 2))] += 1
    got = Counter((r["doc_id"], r["n_tokens"], *(round(r[f"p_{d}"], 6) for d in names), round(r["rate"], 2)) for r in mixing.mix_rates(docs, labels).collect())
    near = {k[:-1]: k[-1] for k in want}
    assert sum(got.values()) == len(rows) and {k[:-1] for k in got} == set(near)
    assert all(abs(k[-1] - near[k[:-1]]) <= 0.02 for k in got)


def test_many_equal_and_repeated_pieces_have_their_own_places(spark):
    rows = [(i, "same words here") for i in range(3000)] + [(7, "same words here")] * 500 + [(None, "an other text"), (None, None), (-1, "word " * 5000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(i for i, _ in rows)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(places) <= -(-sum(r["length"] for r in got) // packing.CAPACITY) + 1
