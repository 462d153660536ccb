"""The audit of sources against plain counts, and its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from saltmarsh.llm import divergence, queries

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        own = {s: c for (g, s), c in groups.items() if g == lang}
        whole = Counter({t: sum(c[t] for c in own.values()) for t in kept})

        def share(counts, term):
            return 1 + 10**9 * (counts[term] + 1) // (sum(counts[t] for t in kept) + len(kept))

        p = {s: {t: share(c, t) for t in kept} for s, c in own.items()}
        q = {t: share(whole, t) for t in kept}
        for s in own:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in own if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found, 1) if part == "pair" or i <= 200]
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()), key=str)


def random_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["Alpha", "alpha", "béta", "Ünder", "x", "日本", "g_h", "a1b", " ", "don't", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = []
    for _ in range(n):
        rows.append((rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["hot", "hot", "b", "c", None, "É", ""]), rng.choice([None, "", "123 !?"]) if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.randint(1, 30)))))
    rows += [("fr", "only", "un deux"), ("fr", "two", ""), ("xx", "alone", "one two three"), *[rows[0]] * 5]
    return rows


@pytest.mark.parametrize("chunk", [3, 1 << 17])
def test_same_values_as_plain_counts(spark, monkeypatch, chunk):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    rows = random_rows(chunk)
    df = spark.createDataFrame([(*r, "extra", 5) for r in rows], "lang string, source string, text string, item string, n int")
    assert result(divergence.audit(df)) == plain(rows)


def test_ties_are_ranked_by_bytes(spark):
    rows = [("en", s, "é z a Z") for s in ("b", "B", "é", "zz") for _ in range(3)] + [("en", "b", "z z z é é é")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert result(divergence.audit(df)) == plain(rows)


def test_long_text_and_empty_table(spark):
    rows = [("en", "a", "Word other " * 200_000), ("en", "b", "word"), ("en", "c", "word"), ("en", "c", "word other")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert result(divergence.audit(df)) == plain(rows)
    assert result(divergence.audit(df.limit(0))) == []


def test_galloping_meets_every_common_id():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 10 ** rng.integers(1, 6), size=rng.integers(0, 5000))) for _ in range(2))
        at_a, at_b = divergence.galloped(a, b)
        assert a[at_a].tolist() == b[at_b].tolist() == np.intersect1d(a, b).tolist()


def test_shares_are_exact_for_large_counts():
    counts, size = np.array([0, 7, 10**12, 5 * 10**12]), 6 * 10**12
    assert divergence.shares(counts, size).tolist() == [1 + 10**9 * (c + 1) // size for c in counts.tolist()]


def test_same_rows_as_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.execute(f"select lang, source, part, item, value, rank from ({queries.ORACLE['op12_source_divergence']})").fetchall()
    assert result(queries.op12_source_divergence(spark, folder)) == sorted(want, key=str)
