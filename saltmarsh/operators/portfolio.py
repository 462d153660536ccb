"""Causal probabilities, views, and constrained portfolios of many dates side by side.

Long tables hold the probabilities and covariances; a portfolio is one row with arrays in the order of its assets.
Matrices are flat arrays, row after row.  All but the optimiser is DataFrame expressions.  The optimiser takes a
batch of rows at once: every row is a problem of its own and has a stopping rule of its own, so a history of
thousands of dates and scenarios is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A problem is solved when no portfolio within the bounds can be better by more than this, in units of the problem's largest number.
GAP = 1e-13
MOST_STEPS = 20_000


def noisy_or(causes: DataFrame, keys: list[str], leak: float = 0.0) -> DataFrame:
    """Net probability of every key from its causes (kind 'promotes' or 'inhibits', p from 0 to 1).

    Some promoting cause or the leak must act and no inhibiting one: (1 - (1 - leak) * prod(1 - p)) * prod(1 - q).
    The products are sums of logarithms, with certain causes (p = 1) counted apart.  Null p don't count.
    """

    def none_acts(kind: str) -> Column:
        p = F.when(F.col("kind") == kind, F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0)))
        certain = F.coalesce(F.max((p == 1).cast("int")), F.lit(0))
        return F.when(certain == 1, 0.0).otherwise(F.exp(F.coalesce(F.sum(F.when(p < 1, F.log1p(-p))), F.lit(0.0))))

    sums = causes.groupBy(*keys).agg(none_acts("promotes").alias("no_cause"), none_acts("inhibits").alias("no_hindrance"))
    return sums.select(*keys, ((1 - (1 - leak) * F.col("no_cause")) * F.col("no_hindrance")).alias("probability"))


def views(probabilities: DataFrame, bull: float = 0.55, bear: float = 0.45) -> DataFrame:
    """Rows whose ``probability`` reaches a threshold, with direction 1 or -1 and confidence, twice the distance from a half."""
    p = F.col("probability")
    direction = F.when(p >= bull, 1).when(p <= bear, -1)
    return probabilities.withColumn("direction", direction).where("direction is not null").withColumn("confidence", F.abs(p - 0.5) * 2)


def common_returns(weeks: DataFrame, assets: tuple[str, ...]) -> DataFrame:
    """(series, d, r): changes from one week to the next of the weeks that all assets have."""
    rows = weeks.where(F.col("series").isin(*assets))
    whole = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(assets)).select("d")
    before = F.lag("v").over(Window.partitionBy("series").orderBy("d"))
    return rows.join(whole, "d", "left_semi").withColumn("r", F.try_divide("v", before) - 1).where("r is not null").select("series", "d", "r")


def rolling_covariance(returns: DataFrame, weeks: int = 104, least: int = 52, yearly: int = 52) -> DataFrame:
    """(d, a, b, n, mean, cov, corr) of every ordered pair of assets over the last ``weeks`` rows; mean is that of a, both yearly."""
    left = returns.select("d", F.col("series").alias("a"), F.col("r").alias("x"))
    right = returns.select("d", F.col("series").alias("b"), F.col("r").alias("y"))
    own = Window.partitionBy("a", "b").orderBy("d").rowsBetween(1 - weeks, 0)
    rows = left.join(right, "d").withColumns({
        "n": F.count(F.lit(1)).over(own), "mean": F.avg("x").over(own) * yearly, "cov": F.covar_samp("x", "y").over(own) * yearly,
        "sx": F.stddev_samp("x").over(own), "sy": F.stddev_samp("y").over(own),
    })
    corr = F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.col("cov") / yearly / F.col("sx") / F.col("sy"))
    return rows.where(F.col("n") >= least).select("d", "a", "b", "n", "mean", "cov", corr.alias("corr"))


def problems(covariance: DataFrame, assets: tuple[str, ...]) -> DataFrame:
    """(d, mean, sigma): arrays in the order of ``assets``, for dates that have all pairs."""
    place = F.create_map(*(F.lit(x) for i, a in enumerate(assets) for x in (a, i)))
    at = F.element_at(place, F.col("a")) * len(assets) + F.element_at(place, F.col("b"))
    cells = covariance.groupBy("d").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "cov", "mean"))).alias("cells"))
    n = len(assets)
    mean = F.transform(F.filter("cells", lambda c: c["at"] % (n + 1) == 0), lambda c: c["mean"])
    return cells.where(F.size("cells") == n * n).select("d", mean.alias("mean"), F.transform("cells", lambda c: c["cov"]).alias("sigma"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def vector(values: tuple[float, ...]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def times(matrix: str | Column, x: str | Column, n: int) -> Column:
    """Product of a flat n x n matrix and a vector."""
    matrix, x = (F.col(c) if isinstance(c, str) else c for c in (matrix, x))
    rows = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(rows, lambda i: dot(F.slice(matrix, i * n + 1, n), x))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def diagonal(matrix: str, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(matrix, i * (n + 1)))


def equilibrium(sigma: str, market: tuple[float, ...], aversion: float) -> Column:
    """Returns under which the market's weights are the best ones: aversion * sigma * weights."""
    return F.transform(times(sigma, vector(market), len(market)), lambda x: x * aversion)


def posterior(prior: Column, sigma: str, found: str, n: int, tau: float) -> Column:
    """(m, c): expected returns and their covariance after views on single assets: ``found`` is an array of (at, target, confidence), one an asset at most.

    A view's variance is tau * variance * (1 - c) / c.  As views are on single assets with errors of their own, each one
    moves returns and their covariance tau * sigma by a rank-one step, and no matrix is inverted; a confidence of 0 says nothing.
    """
    every = F.sequence(F.lit(0), F.lit(n - 1))
    start = F.struct(prior.alias("m"), F.transform(sigma, lambda s: s * tau).alias("c"))
    known = F.filter(F.col(found), lambda v: v["confidence"] > 0)

    def step(state: Column, view: Column) -> Column:
        at, m, c = view["at"], state["m"], state["c"]
        error = F.get(F.col(sigma), at * (n + 1)) * tau * (1 - view["confidence"]) / view["confidence"]

        def moved(gain: Column) -> Column:
            m_new = F.transform(every, lambda i: F.get(m, i) + F.get(gain, i) * (view["target"] - F.get(m, at)))
            c_new = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.get(c, k) - F.get(gain, F.floor(k / n).cast("int")) * F.get(c, at * n + (k % n).cast("int")))
            return F.struct(m_new.alias("m"), c_new.alias("c"))

        return let(let(F.get(c, at * (n + 1)) + error, lambda spread: F.transform(every, lambda i: F.get(c, i * n + at) / spread)), moved)

    return F.aggregate(known, start, step)


def ordinal(values: str, weights: Column, order: str, n: int) -> Column:
    """The values nearest to ``values`` (squares times ``weights``) that fall in the order of ``order``, an array of places, the first to be highest.

    That is the isotonic regression: place i takes the least, over ends k up to i, of the greatest mean of places from k to an end from i on.
    """
    w = F.transform(F.col(order), lambda j: F.get(weights, j))
    wv = F.transform(F.col(order), lambda j: F.get(weights, j) * F.get(F.col(values), j))

    every = F.sequence(F.lit(0), F.lit(n - 1))

    def fits(sums: Column) -> Column:
        """Of every place, from running sums: w[i] and wv[i] are the sums before place i."""

        def mean(k: Column, end: Column) -> Column:
            before, after = F.get(sums, k), F.get(sums, end + 1)
            return (after["wv"] - before["wv"]) / (after["w"] - before["w"])

        return F.transform(every, lambda i: F.array_min(F.transform(F.sequence(F.lit(0), i), lambda k: F.array_max(F.transform(F.sequence(i, F.lit(n - 1)), lambda end: mean(k, end))))))

    start = F.array(F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("wv")))
    pairs = F.arrays_zip(w.alias("w"), wv.alias("wv"))
    sums = F.aggregate(pairs, start, lambda s, x: F.concat(s, F.array(F.struct((F.element_at(s, -1)["w"] + x["w"]).alias("w"), (F.element_at(s, -1)["wv"] + x["wv"]).alias("wv")))))
    return let(let(sums, fits), lambda fit: F.transform(every, lambda j: F.get(fit, (F.array_position(F.col(order), j) - 1).cast("int"))))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


# The optimiser


def within(y: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The nearest rows to ``y`` that lie within the bounds and sum to 1.

    They are y less one shift a row, cut to the bounds.  The sum falls with the shift, straight between the shifts at which an entry
    meets a bound, so the two of these that enclose 1 give the shift.
    """
    corners = np.sort(np.concatenate([y - low, y - high], axis=1), axis=1)
    sums = np.clip(y[:, None, :] - corners[:, :, None], low[:, None, :], high[:, None, :]).sum(axis=2)
    last = corners.shape[1] - 1
    right = np.minimum((sums > 1).sum(axis=1), last)
    left = np.maximum(right - 1, 0)
    row = np.arange(len(y))
    drop = sums[row, left] - sums[row, right]
    share = np.where(drop > 0, (sums[row, left] - 1) / np.where(drop > 0, drop, 1), 0)
    shift = corners[row, left] + np.clip(share, 0, 1) * (corners[row, right] - corners[row, left])
    return np.clip(y - shift[:, None], low, high)


def best_corner(gradient: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The portfolio within the bounds that the gradient likes best: the rest above the lower bounds goes to the highest entries first."""
    order = np.argsort(-gradient, axis=1, kind="stable")
    room = np.take_along_axis(high - low, order, axis=1)
    before = np.cumsum(room, axis=1) - room
    put = np.clip(1 - low.sum(axis=1, keepdims=True) - before, 0, room)
    out = low.copy()
    np.put_along_axis(out, order, np.take_along_axis(low, order, axis=1) + put, axis=1)
    return out


def optimise(mu: np.ndarray, sigma: np.ndarray, low: np.ndarray, high: np.ndarray, aversion: np.ndarray, error: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, gap) of every row: the w that makes mu w - aversion / 2 * w sigma w - penalty * ||error * w|| greatest.

    Weights sum to 1 within the bounds.  Accelerated projected gradient, restarted where it turns; a row is done once its gap, the
    most that any allowed portfolio can gain by the gradient there, is at most ``GAP``, and its weights stay.  A row that takes more
    than ``MOST_STEPS`` keeps its last weights and shows its gap.
    """
    rows, n = mu.shape
    quadratic = aversion[:, None, None] * sigma
    # In units of the problem's largest number, so that the gap means the same for all.
    unit = np.maximum.reduce([np.abs(mu).max(axis=1), np.abs(quadratic).max(axis=(1, 2)), np.abs(penalty * error.max(axis=1)), np.full(rows, 1e-300)])
    mu, quadratic, penalty = mu / unit[:, None], quadratic / unit[:, None, None], penalty / unit
    square = error * error
    # Curvature is at most that of the quadratic form and of the norm, whose argument is shortest where 1 is spread by 1 / error**2.
    shortest = np.sqrt(1 / np.maximum((1 / np.maximum(square, 1e-18)).sum(axis=1), 1e-18))
    bend = np.linalg.eigvalsh(quadratic)[:, -1] + penalty * square.max(axis=1) / np.maximum(shortest, 1e-9) + 1e-12

    def gradient(w: np.ndarray, at: np.ndarray) -> np.ndarray:
        length = np.sqrt((square[at] * w * w).sum(axis=1))
        slope = penalty[at] / np.maximum(length, 1e-300)
        return mu[at] - np.einsum("rij,rj->ri", quadratic[at], w) - slope[:, None] * square[at] * w

    weights = within(np.full((rows, n), 1 / n), low, high)
    gaps = np.full(rows, np.inf)
    at, w = np.arange(rows), weights.copy()
    look, momentum = w.copy(), np.ones(rows)
    for step in range(MOST_STEPS):
        if not len(at):
            break
        new = within(look + gradient(look, at) / bend[at, None], low[at], high[at])
        turned = ((look - new) * (new - w)).sum(axis=1) > 0
        t = np.where(turned, 1.0, momentum)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = new + np.where(turned, 0.0, (t - 1) / after)[:, None] * (new - w)
        w, momentum = new, after
        if step % 8 == 7:
            slope = gradient(w, at)
            gap = ((best_corner(slope, low[at], high[at]) - w) * slope).sum(axis=1)
            weights[at], gaps[at] = w, gap
            on = gap > GAP
            at, w, look, momentum = at[on], w[on], look[on], momentum[on]
    return weights, gaps


SOLVED = "weights array<double>, gap double"


def solve_rows(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue

        def table(name: str) -> np.ndarray:
            return np.array(batch.column(name).to_pylist(), dtype=float)

        mu = table("mu")
        n = mu.shape[1]
        weights, gap = optimise(mu, table("sigma").reshape(-1, n, n), table("low"), table("high"), table("aversion"), table("error"), table("penalty"))
        columns = [*(batch.column(c) for c in kept), pa.array(weights.tolist(), type=pa.list_(pa.float64())), pa.array(gap)]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept, "weights", "gap"])


def solve(rows: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` columns of every row with ``weights`` and ``gap``.

    Rows have arrays mu, sigma (flat), low, high and error, and numbers aversion and penalty.  All rows have as many assets; rows
    whose bounds no portfolio meets (lower ones above 1 in sum, or upper ones below) or with a null among their numbers are left out.
    """
    n = F.size("mu")
    sound = (F.size("sigma") == n * n) & (total(F.col("low")) <= 1 + 1e-12) & (total(F.col("high")) >= 1 - 1e-12)
    for c in ("mu", "sigma", "low", "high", "error"):
        sound = sound & ~F.exists(c, lambda x: x.isNull() | F.isnan(x))
    needed = [*dict.fromkeys([*kept, "mu", "sigma", "low", "high", "error", "aversion", "penalty"])]
    types = ", ".join(f"`{c}` {t}" for c, t in rows.select(*kept).dtypes)
    return rows.where(sound & F.col("aversion").isNotNull() & F.col("penalty").isNotNull()).select(*needed).mapInArrow(lambda it: solve_rows(it, kept), f"{types}, {SOLVED}")
