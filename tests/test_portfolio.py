"""Causal probabilities, views, covariances and portfolios against plain numerics."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import portfolio


def problem(seed, rows, n):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(rows, n, 2 * n)) * rng.uniform(0.05, 0.3, size=(rows, n, 1))
    sigma = a @ a.transpose(0, 2, 1) / n
    low = np.full((rows, n), 0.02)
    high = rng.uniform(0.3, 0.7, size=(rows, n)) if n > 3 else np.full((rows, n), 0.8)
    return rng.normal(0.05, 0.08, size=(rows, n)), sigma, low, high


def best_of_all_faces(mu, sigma, low, high, aversion):
    """The best portfolio over every choice of assets at their bounds."""
    n, best = len(mu), (-np.inf, None)
    for face in itertools.product((0, 1, 2), repeat=n):
        free = [i for i in range(n) if face[i] == 2]
        w = np.where(np.array(face) == 0, low, high).astype(float)
        if free:
            fixed = [i for i in range(n) if face[i] != 2]
            k = len(free)
            system = np.zeros((k + 1, k + 1))
            system[:k, :k], system[:k, k], system[k, :k] = aversion * sigma[np.ix_(free, free)], 1, 1
            right = np.append(mu[free] - aversion * sigma[np.ix_(free, fixed)] @ w[fixed], 1 - w[fixed].sum())
            w[free] = np.linalg.solve(system, right)[:k]
        if abs(w.sum() - 1) < 1e-9 and (w >= low - 1e-12).all() and (w <= high + 1e-12).all():
            best = max(best, (mu @ w - aversion / 2 * w @ sigma @ w, tuple(w)))
    return np.array(best[1])


def frame(spark, mu, sigma, low, high, aversion, error, penalty):
    rows = [(i, mu[i].tolist(), sigma[i].ravel().tolist(), low[i].tolist(), high[i].tolist(), float(aversion[i]), error[i].tolist(), float(penalty[i])) for i in range(len(mu))]
    return spark.createDataFrame(rows, "id int, mu array<double>, sigma array<double>, low array<double>, high array<double>, aversion double, error array<double>, penalty double")


@pytest.mark.parametrize("n", [3, 4, 5])
def test_weights_are_the_best_of_all_faces(spark, n):
    mu, sigma, low, high = problem(n, 40, n)
    aversion = np.tile([0.5, 1.0, 2.5, 10.0], 10)
    got = {r.id: r for r in portfolio.solve(frame(spark, mu, sigma, low, high, aversion, np.zeros_like(mu), np.zeros(40)), ["id"]).collect()}
    assert len(got) == 40
    for i in range(40):
        want = best_of_all_faces(mu[i], sigma[i], low[i], high[i], aversion[i])
        assert got[i].gap <= portfolio.GAP
        assert np.allclose(got[i].weights, want, atol=2e-5)
        assert abs(sum(got[i].weights) - 1) < 1e-9 and (np.array(got[i].weights) <= high[i] + 1e-12).all()


def test_penalty_on_errors(spark):
    mu, sigma, low, high = problem(9, 30, 6)
    error = np.sqrt(np.einsum("rii->ri", sigma) / 3)
    rows = portfolio.solve(frame(spark, mu, sigma, low, high, np.full(30, 2.5), error, np.ones(30)), ["id"]).collect()
    rng = np.random.default_rng(0)
    for r in rows:
        w, i = np.array(r.weights), r.id

        def value(x):
            return mu[i] @ x - 1.25 * x @ sigma[i] @ x - np.linalg.norm(error[i] * x)

        others = portfolio.within(w + rng.normal(0, 0.05, size=(400, 6)), np.tile(low[i], (400, 1)), np.tile(high[i], (400, 1)))
        assert r.gap <= portfolio.GAP and max(map(value, others)) <= value(w) + 1e-12
        without = best = portfolio.optimise(mu[[i]], sigma[[i]], low[[i]], high[[i]], np.array([2.5]), np.zeros((1, 6)), np.zeros(1))[0][0]
        assert np.linalg.norm(error[i] * w) <= np.linalg.norm(error[i] * without) + 1e-9 and best is not None


def test_problems_without_an_answer_are_left_out(spark):
    mu, sigma, low, high = problem(1, 4, 4)
    low[0], high[1] = 0.3, 0.2
    mu[2, 1] = np.nan
    got = portfolio.solve(frame(spark, mu, sigma, low, high, np.ones(4), np.zeros_like(mu), np.zeros(4)), ["id"])
    assert [r.id for r in got.collect()] == [3]
    assert portfolio.solve(got.sparkSession.createDataFrame([], frame(spark, mu, sigma, low, high, np.ones(4), mu, np.ones(4)).schema), ["id"]).collect() == []


def test_nearest_portfolio_within_bounds():
    rng = np.random.default_rng(3)
    y, low = rng.normal(0.2, 0.4, size=(300, 5)), rng.uniform(0, 0.1, size=(300, 5))
    high = low + rng.uniform(0.2, 0.5, size=(300, 5))
    w = portfolio.within(y, low, high)
    assert np.allclose(w.sum(axis=1), 1) and (w >= low - 1e-12).all() and (w <= high + 1e-12).all()
    for _ in range(200):  # no other portfolio is nearer
        other = portfolio.within(w + rng.normal(0, 0.1, size=w.shape), low, high)
        assert (((w - y) ** 2).sum(axis=1) <= ((other - y) ** 2).sum(axis=1) + 1e-9).all()


def test_noisy_or_with_certain_and_impossible_causes(spark):
    cases = {
        "a": [("promotes", 0.3), ("promotes", 0.5), ("inhibits", 0.2)], "b": [("promotes", 1.0), ("promotes", 0.2)], "c": [("inhibits", 1.0), ("promotes", 0.9)],
        "d": [("promotes", 0.0), ("inhibits", 0.0)], "e": [("promotes", None), ("inhibits", 0.4)], "f": [("promotes", 1.4), ("inhibits", -0.5)],
    }
    df = spark.createDataFrame([(k, kind, p) for k, rows in cases.items() for kind, p in rows], "asset string, kind string, p double")
    for leak in (0.0, 0.1):
        got = {r.asset: r.probability for r in portfolio.noisy_or(df, ["asset"], leak).collect()}
        for k, rows in cases.items():
            cut = [(kind, min(max(p, 0), 1)) for kind, p in rows if p is not None]
            up = 1 - (1 - leak) * np.prod([1 - p for kind, p in cut if kind == "promotes"])
            assert got[k] == pytest.approx(up * np.prod([1 - p for kind, p in cut if kind == "inhibits"]))


def test_views_at_the_thresholds(spark):
    df = spark.createDataFrame([("a", 0.55), ("b", 0.5499), ("c", 0.45), ("d", 0.4501), ("e", 1.0), ("f", None)], "asset string, probability double")
    got = {r.asset: (r.direction, round(r.confidence, 6)) for r in portfolio.views(df).collect()}
    assert got == {"a": (1, 0.1), "c": (-1, 0.1), "e": (1, 1.0)}


def test_posterior_equals_the_matrix_formula(spark):
    rng = np.random.default_rng(6)
    n, tau = 4, 0.05
    a = rng.normal(size=(n, 9))
    sigma, prior = a @ a.T / 40, rng.normal(0.05, 0.02, size=n)
    told = [(1, 0.2, 0.5), (3, -0.1, 0.9)]
    df = spark.createDataFrame([(prior.tolist(), sigma.ravel().tolist(), told), (prior.tolist(), sigma.ravel().tolist(), []), (prior.tolist(), sigma.ravel().tolist(), [(0, 0.4, 1.0), (2, 1.0, 0.0)])], "prior array<double>, sigma array<double>, found array<struct<at:int,target:double,confidence:double>>")
    rows = df.select(portfolio.posterior(F.col("prior"), "sigma", "found", n, tau).alias("x")).collect()
    p = np.zeros((2, n))
    p[0, 1] = p[1, 3] = 1
    omega = np.diag([tau * sigma[i, i] * (1 - c) / c for i, _, c in told])
    inverse = np.linalg.inv(tau * sigma)
    c = np.linalg.inv(inverse + p.T @ np.linalg.inv(omega) @ p)
    assert np.allclose(rows[0].x.m, c @ (inverse @ prior + p.T @ np.linalg.inv(omega) @ np.array([0.2, -0.1])))
    assert np.allclose(rows[0].x.c, c.ravel())
    assert np.allclose(rows[1].x.m, prior)
    assert rows[2].x.m[0] == pytest.approx(0.4)


def nearest_in_order(values, weights, order):
    """The best way to cut the order into stretches of equal values."""
    n, best = len(values), (np.inf, None)
    for cuts in itertools.product((False, True), repeat=n - 1):
        fit, begin = np.zeros(n), 0
        for end in range(1, n + 1):
            if end == n or cuts[end - 1]:
                at = order[begin:end]
                fit[at] = np.average(values[at], weights=weights[at])
                begin = end
        if all(fit[order[i]] >= fit[order[i + 1]] - 1e-12 for i in range(n - 1)):
            best = min(best, ((weights * (fit - values) ** 2).sum(), tuple(fit)))
    return best[1]


def test_ordinal_returns_are_the_nearest_in_the_order(spark):
    rng = np.random.default_rng(8)
    rows = [(rng.normal(size=4).round(2).tolist(), rng.uniform(0.5, 3, size=4).tolist(), rng.permutation(4).tolist()) for _ in range(60)] + [([1.0] * 4, [1.0] * 4, [3, 1, 0, 2])]
    df = spark.createDataFrame(rows, "v array<double>, w array<double>, o array<int>")
    for (v, w, o), r in zip(rows, df.select(portfolio.ordinal("v", F.col("w"), "o", 4).alias("x")).collect(), strict=True):
        assert np.allclose(r.x, nearest_in_order(np.array(v), np.array(w), o))


def test_covariance_of_common_weeks(spark):
    rng = np.random.default_rng(2)
    weeks = [(s, f"2020-{1 + w // 4:02d}-{1 + 7 * (w % 4):02d}", float(v)) for s in "abc" for w, v in enumerate(rng.uniform(50, 150, size=40)) if not (s == "b" and w == 7)]
    df = spark.createDataFrame(weeks, "series string, d string, v double").withColumn("d", F.to_date("d"))
    returns = portfolio.common_returns(df, ("a", "b", "c"))
    got = {(str(r.d), r.a, r.b): r for r in portfolio.rolling_covariance(returns, weeks=10, least=5).collect()}
    wide = {s: np.array([v for _, v in sorted((d, v) for x, d, v in weeks if x == s and d != "2020-02-22")]) for s in "abc"}
    moves = {s: x[1:] / x[:-1] - 1 for s, x in wide.items()}
    days = sorted({d for _, d, _ in weeks} - {"2020-02-22"})[1:]
    for k, d in enumerate(days):
        last = slice(max(0, k - 9), k + 1)
        if k >= 4:
            x, y = moves["a"][last], moves["c"][last]
            r = got[d, "a", "c"]
            assert (r.n, r.cov, r.mean) == (len(x), pytest.approx(np.cov(x, y)[0, 1] * 52), pytest.approx(x.mean() * 52))
            assert r.corr == pytest.approx(np.corrcoef(x, y)[0, 1])
        else:
            assert (d, "a", "c") not in got
    whole = portfolio.problems(portfolio.rolling_covariance(returns, weeks=10, least=5), ("c", "a", "b")).orderBy("d").collect()[-1]
    last = np.array([moves[s][-10:] for s in "cab"])
    assert np.allclose(whole.sigma, (np.cov(last) * 52).ravel()) and np.allclose(whole.mean, last.mean(axis=1) * 52)
