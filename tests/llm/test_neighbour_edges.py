"""Ties, repeated and null ids, other columns, and vectors that take no part."""

from saltmarsh.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, query_id long, rank string"


def rows():
    out = [(i, [float(i % 7), float(i // 7), 0.0, 1.0], 0, 5, "x") for i in range(70)]
    out += [(100, [3.0, 3.0, 0.0, 1.0], 0, 5, "x"), (200, [3.0, 3.0, 0.0, 1.0], 1, None, None)]
    out += [(300, None, 0, 1, "n"), (400, [0.0] * 4, 0, 1, "z"), (500, [1.0, float("nan"), 0.0, 1.0], 0, 1, "n"), (600, [1.0, None, 0.0, 1.0], 0, 1, "n"), (700, [float("inf")] * 4, 0, 1, "i")]
    return out


def plain(queries, every):
    """(rank, vec_id, score) by query, ties to the smaller id."""
    out = {}
    for q, v in queries:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) ** 0.5, i) for i, w in every if i != q)
        out[q] = [(k, i, d) for k, (d, i) in enumerate(near[:10], 1)]
    return out


def test_ties_and_vectors_without_part(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = ann.nearest(df, df.where("vec_id % 100 = 0")).collect()
    sound = [(i, v) for i, v, *_ in rows() if v and None not in v and any(v) and all(abs(x) < 1e9 for x in v)]
    want = plain([x for x in sound if x[0] % 100 == 0], sound)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {0, 100, 200}
    for q, near in found.items():
        assert [k for k, *_ in near] == list(range(1, len(near) + 1)) and all(i != q for _, i, _ in near)
        assert [d for *_, d in near] == sorted(d for *_, d in near)
        assert near[0][1:] == want[q][0][1:]
        for (_, a, d), (_, b, e) in zip(near, near[1:], strict=False):
            assert d < e or a < b  # equal distances by id


def test_fewer_candidates_than_asked_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [9.0, 2.0])], "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(few, few.where("vec_id = 0")).collect())
    assert got == [(1, 1, 0.5), (2, 2, 8.0)]
    assert ann.nearest(few.limit(0), few.limit(0)).collect() == []
    nulls = spark.createDataFrame([(None, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert all(r.vec_id is None or r.vec_id != r.query_id for r in ann.nearest(nulls, nulls.where("vec_id = 0")).collect())
