"""All five stages in a row on empty tables, nulls, repeated rows, a very long text and columns with clashing names."""

import pytest

import corpus_pipeline as cp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MORE = ", score double, node long, rate double, value string, row long, length int"
GOOD = "the river runs past the old mill and the children of the village walk along its bank every day in the summer "


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def through(spark, docs, folder):
    for i, (name, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, folder)
        if i < len(cp.STAGES) - 1:
            assert docs.columns == cp.COLUMNS, name
            docs.write.parquet(f"{folder}/stage{i}")
            docs = spark.read.schema(DOCS).parquet(f"{folder}/stage{i}")
    return docs


def test_an_empty_table_goes_through(spark, folder):
    assert through(spark, spark.createDataFrame([], DOCS + MORE), folder).collect() == []


def test_nulls_long_texts_and_clashing_columns(spark, folder):
    texts = [GOOD * 3 + f"number {i} of the tales tells of boat {i * 7} and of its {i} sailors" for i in range(12)]
    rows = [(i + 1, t, ["en", "de", None][i % 3], "s", len(t)) for i, t in enumerate(texts)]
    rows += [(None, None, None, None, None), (None, GOOD * 2 + "without an id", "en", None, 9), (5, GOOD + "under an id that is taken", "fr", "t", 9), (40, "", "es", "s", 0)]
    rows += [(50, "word " + " ".join(f"w{i % 977}x{i % 31}" for i in range(150_000)), "en", "s", 9), (60, GOOD * 2 + "password=Zx9Kq2vLm8Rt4 stays out", "en", "s", 9)] * 2
    df = spark.createDataFrame([(*r, 0.1, 7, 2.0, "v", 3, 4) for r in rows], DOCS + MORE)
    got = through(spark, df, folder).collect()
    assert got and all(r.offset + r.length <= 2048 for r in got)
    whole = {}
    for r in got:
        whole.setdefault((r.sequence_id, r.offset), []).append(r)
    assert all(len(x) == 1 for x in whole.values())  # no place is taken twice
    kept = spark.read.parquet(f"{folder}/stage2")
    assert kept.where("text like '%Zx9Kq2vLm8Rt4%'").count() == 0
    assert kept.where("doc_id = 60").count() <= 1 and kept.where("doc_id = 50").count() <= 1  # repeated rows stay once
