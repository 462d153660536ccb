"""Components of hubs, chains and repeated links against plain union of sets."""

import random

from saltmarsh.llm.components import components, with_least


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_hubs_and_chains(spark):
    draw = random.Random(5)
    edges = [(500, -x) for x in range(1, 900)] + [(x, x + 1) for x in range(1000, 1040)] + [(draw.randrange(2000, 2400), draw.randrange(2000, 2400)) for _ in range(250)]
    edges += edges[:40] + [(7, 7), (1040, 500)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {x: r for x, r in plain(edges).items() if any(x in (a, b) and a != b for a, b in edges)}
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_least_of_a_key(spark):
    rows = spark.createDataFrame([(1, x, None if x % 3 else x) for x in range(5, 400)] + [(2, 9, None), (2, 9, None), (3, 1, 4)], "k long, x long, v long")
    got = with_least(rows, "k", "v", "least")
    assert got.columns == ["k", "x", "v", "least"] and got.count() == rows.count()
    assert {(r["k"], r["least"]) for r in got.collect()} == {(1, 6), (2, None), (3, 4)}
