"""The trie against a plain one, whatever the containers' size, and its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from saltmarsh.llm import queries, turn_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def record(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], len(text)


def plain(rows):
    """Every node from the list of its members."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, record(role, text)))
    own = {c: [r for _, _, r in sorted(x)] for c, x in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append((c, d == len(whole)))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        convs = sorted(c for c, _ in members[node])
        below = [out[x] for x in children[node]]
        saved = (len(convs) - 1) * (node[-1][1] if node else 0) + sum(x[6] for x in below)
        ends = ",".join(str(c) for c in sorted(c for c, last in members[node] if last))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out[node] = (convs[0], len(node), parent, len(convs), len(below), sum(x[5] for x in below) or 1, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def result(spark, rows, limit=None, schema=SCHEMA):
    return sorted(map(tuple, turn_trie.trie(spark.createDataFrame(rows, schema), limit).collect()), key=str)


def random_rows(seed, convs=60):
    """Conversations of few different turns, so that many share long beginnings; ties, nulls and gaps."""
    rng = random.Random(seed)
    rows = []
    for conv in [*range(40), *rng.sample(range(100, 900), convs - 40), -7]:
        for turn in range(rng.choice([1, 2, 7, 9, 14])):
            text = rng.choice(["a", "a", "a", "b", "longer text", "", None, "Zürich\n"]) if turn > 3 else "same"
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]) if conv % 9 == 0 else turn, rng.choice(["user", "user", None, ""]) if turn % 5 == 4 else "user", text))
    rows += [(5, 2, "user", "a"), (5, 2, "user", "a"), (None, 1, "user", "belongs to none"), (7000, 0, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [1, 2, 5, None])
def test_same_nodes_as_a_plain_trie(spark, limit):
    rows = random_rows(3)
    assert result(spark, rows, limit) == plain(rows)


def test_one_hot_beginning_and_many_copies(spark):
    rows = [(c, t, "user", "hello" if t < 8 else f"{c % 7}") for c in range(300) for t in range(12 if c % 3 else 8)]
    assert result(spark, rows, 4) == plain(rows)


def test_long_conversation_and_long_text(spark):
    rows = [(200, t, "user", "x" * (t % 5)) for t in range(3000)] + [(201, t, "user", "x" * (t % 5)) for t in range(2990)] + [(202, 0, "user", "é" * 300_000)]
    assert result(spark, rows, 1) == plain(rows)


def test_empty_table_turnless_conversations_and_extra_columns(spark):
    assert result(spark, []) == []
    turnless = [c for c in range(100, 200) if zlib.crc32(str(c).encode()) % 6 > 0 and c % 100][:5]
    rows = [(c, 0, "user", "gone") for c in turnless]
    assert result(spark, rows) == plain(rows)
    assert result(spark, rows)[0][:7] == (turnless[0], 0, None, 5, 0, 1, 0)
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in random_rows(8)], SCHEMA + ", depth int, path string, head double")
    assert sorted(map(tuple, turn_trie.trie(df).collect()), key=str) == plain(random_rows(8))


def test_same_rows_as_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    df = queries.op13_conversation_trie(spark, folder)
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.ORACLE['op13_conversation_trie']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
