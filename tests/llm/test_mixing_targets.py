"""Targets far from what the table holds are met, and targets out of reach are reported."""

import numpy as np
import pytest

from saltmarsh.llm import mixing

NAMES = ["de", "en", "es", "fr"]


def members(spark, shares):
    rng = np.random.default_rng(11)
    rows = []
    for k, share in enumerate(shares):
        for _ in range(100):
            soft = rng.dirichlet(np.where(np.arange(4) == k, 200.0, 0.4))
            rows.append((int(1_000_000 * share), *map(float, soft)))
    return spark.createDataFrame(rows, "n_tokens long, " + ", ".join(f"p_{d} double" for d in NAMES)).coalesce(2).persist()


@pytest.mark.parametrize("shares", [(0.01, 0.97, 0.002, 0.018), (0.05, 0.93, 0.005, 0.015), (0.0001, 0.9997, 0.0001, 0.0001)])
def test_targets_of_rare_domains_are_met(spark, shares):
    table = members(spark, shares)
    rated = table.withColumn("rate", mixing.rate(NAMES, mixing.fit(table, NAMES, mixing.TARGETS))).collect()
    whole = sum(r["n_tokens"] for r in rated)
    assert min(r["rate"] for r in rated) >= 0
    for d, share in mixing.TARGETS.items():
        got = sum(r["n_tokens"] * r[f"p_{d}"] * r["rate"] for r in rated)
        assert abs(got - share * whole) <= 1e-3 * share * whole


def test_targets_out_of_reach_are_reported(spark):
    table = spark.createDataFrame([(10, 0.5, 0.5), (20, 0.6, 0.4)], "n_tokens long, p_a double, p_b double")
    with pytest.warns(RuntimeWarning, match="targets not met"):
        pulls = mixing.fit(table, ["a", "b"], {"a": 0.1, "b": 0.9})
    assert np.isfinite(pulls).all()
