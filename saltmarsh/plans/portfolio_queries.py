"""From the regime's pillars to portfolios: causal probabilities, views, covariances, expected returns and weights of every Friday.

The causes and the equilibrium's weights are a table of this library: the reference calls a package for them that it does not hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import points, portfolio
from ..sources.once import once
from . import regime
from .base_sql import DAY, FRIDAY, r
from .model_queries import score_history
from .rule_queries import roles
from .series_queries import day, query, six
from .state_queries import ALL, HISTORY_ALL, ORACLE, QUERIES

# Assets with their tickers, weights in the market, and most that a portfolio after views may hold.
ASSETS = (
    ("US_Equity", "SPY", 0.45, 0.40), ("Small_Cap", "IWM", 0.08, 0.40), ("Long_Bond", "TLT", 0.22, 0.35), ("HY_Credit", "HYG", 0.12, 0.30), ("Gold", "GLD", 0.09, 0.40), ("Copper", "CPER", 0.04, 0.15),
)
TICKERS = tuple(t for _, t, _, _ in ASSETS)
MARKET = tuple(w for _, _, w, _ in ASSETS)
N = len(ASSETS)
LEAST_WEIGHT, MOST_WEIGHT = 0.02, 0.40
AVERSION, TAU, BULL, BEAR = 2.5, 0.025, 0.55, 0.45
#: Aversions that every Friday's portfolios are solved for.
AVERSIONS = (1.0, AVERSION, 5.0)
LEAK = 0.1
# Causes: asset, pillar, the pillar's direction that acts, what it does, how strongly.
CAUSES = (
    ("US_Equity", "growth", 1, "promotes", 0.6), ("US_Equity", "internals", 1, "promotes", 0.5), ("US_Equity", "monetary", -1, "inhibits", 0.3),
    ("Small_Cap", "growth", 1, "promotes", 0.7), ("Small_Cap", "internals", 1, "promotes", 0.3), ("Small_Cap", "fiscal", -1, "inhibits", 0.3),
    ("Long_Bond", "growth", -1, "promotes", 0.5), ("Long_Bond", "inflation", 1, "promotes", 0.5), ("Long_Bond", "monetary", -1, "inhibits", 0.4),
    ("HY_Credit", "internals", 1, "promotes", 0.8), ("HY_Credit", "growth", -1, "inhibits", 0.2),
    ("Gold", "monetary", 1, "promotes", 0.5), ("Gold", "fiscal", 1, "promotes", 0.4), ("Gold", "sentiment", -1, "inhibits", 0.2),
    ("Copper", "growth", 1, "promotes", 0.8), ("Copper", "fiscal", 1, "promotes", 0.3), ("Copper", "internals", -1, "inhibits", 0.3),
)
#: How sharply a pillar's reading from -1 to 1 makes its cause act.
SHARPNESS = 3.0


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, asset, probability) of every Friday."""
    scores = score_history(spark, sf_dir, ALL)
    items = F.array(
        *(
            F.struct(F.lit(asset).alias("asset"), F.lit(kind).alias("kind"), (strength / (1 + F.exp(-SHARPNESS * side * F.coalesce(F.col(pillar), F.lit(0.0))))).alias("p"))
            for asset, pillar, side, kind, strength in CAUSES
        )
    )
    return portfolio.noisy_or(scores.select("d", F.explode(items).alias("x")).select("d", "x.*"), ["d", "asset"], LEAK)


_CAUSES_SQL = ", ".join(str(x) for x in CAUSES)
_ASSETS_SQL = ", ".join(f"({i}, '{a}', '{t}', {w})" for i, (a, t, w, _) in enumerate(ASSETS))
PROBABILITY_SQL = (
    *HISTORY_ALL,
    "pillar as (unpivot (select d, " + ", ".join(f"coalesce({p}, 0)::double as {p}" for p in regime.WEIGHTS) + f" from sc) on {', '.join(regime.WEIGHTS)} into name pillar value x)",
    f"cause (asset, pillar, side, kind, strength) as (values {_CAUSES_SQL})",
    f"acting as (select d, asset, kind, strength / (1 + exp(-{SHARPNESS} * side * x)) as p from pillar join cause using (pillar))",
    "products as (select d, asset, coalesce(product(1 - p) filter (where kind = 'promotes'), 1) as none_promotes, coalesce(product(1 - p) filter (where kind = 'inhibits'), 1) as none_inhibits from acting group by d, asset)",
    f"chance as (select d, asset, (1 - (1 - {LEAK}) * none_promotes) * none_inhibits as probability from products)",
    f"seen as (select *, case when probability >= {BULL} then 1 when probability <= {BEAR} then -1 end as direction, abs(probability - 0.5) * 2 as confidence from chance)",
)


def _with(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n"


@query(_with(*PROBABILITY_SQL) + f"select {DAY}, asset, {r('probability')} as probability from chance")
def noisy_or_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of a rise of every asset on every Friday."""
    return probabilities(spark, sf_dir).select(day(), "asset", six("probability", "probability"))


@query(_with(*PROBABILITY_SQL) + f"select {DAY}, asset, direction, {r('confidence')} as confidence from seen where direction is not null")
def macro_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of every Friday: assets whose probability reaches a threshold."""
    return portfolio.views(probabilities(spark, sf_dir), BULL, BEAR).select(day(), "asset", "direction", six("confidence", "confidence"))


_TICKERS_SQL = ", ".join(f"'{t}'" for t in TICKERS)
_OWN = "over (partition by a, b order by d rows between 103 preceding and current row)"
COVARIANCE_SQL = (
    f"aw as (select series, {FRIDAY} as d, arg_max(v, d) as v from role where series in ({_TICKERS_SQL}) group by 1, 2)",
    f"whole as (select d from aw group by d having count(*) = {N})",
    "moves as (select series, d, v / lag(v) over (partition by series order by d) - 1 as r from aw semi join whole using (d))",
    "paired as (select x.d, x.series as a, y.series as b, x.r as x, y.r as y from moves x join moves y on x.d = y.d where x.r is not null and y.r is not null)",
    f"cv as (select d, a, b, count(*) {_OWN} as n, avg(x) {_OWN} * 52 as mean, covar_samp(x, y) {_OWN} * 52 as cov, stddev_samp(x) {_OWN} as sx, stddev_samp(y) {_OWN} as sy from paired)",
)


def covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = points.weekly(roles(spark, sf_dir, ALL).where(F.col("series").isin(*TICKERS)))
    return portfolio.rolling_covariance(portfolio.common_returns(weeks, TICKERS))


@query(_with(*HISTORY_ALL[:3], *COVARIANCE_SQL) + f"select {DAY}, a, b, n, {r('mean')} as mean, {r('cov')} as cov, {r('cov / 52 / sx / sy')} as corr from cv where n >= 52")
def asset_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly means, covariances and correlations of weekly returns over two years, as of every Friday."""
    return covariances(spark, sf_dir).select(day(), "a", "b", "n", *(six(c, c) for c in ("mean", "cov", "corr")))


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``expectations`` gives, written once."""
    return once(spark, sf_dir, "expected", lambda: expectations(spark, sf_dir))


def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per Friday: mean, sigma, probability, prior, found (views), after (m and c of the posterior), ordinal; arrays in the order of ASSETS."""
    place = F.create_map(*(F.lit(x) for i, (a, _, _, _) in enumerate(ASSETS) for x in (a, i)))
    chances = probabilities(spark, sf_dir).withColumn("at", F.element_at(place, F.col("asset")))
    told = portfolio.views(chances, BULL, BEAR).groupBy("d").agg(F.array_sort(F.collect_list(F.struct("at", "direction", "confidence"))).alias("told"))
    chances = chances.groupBy("d").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "probability"))), lambda c: c["probability"]).alias("probability"))
    rows = portfolio.problems(covariances(spark, sf_dir), TICKERS).join(chances, "d").join(told, "d", "left")
    volatility = F.transform(portfolio.diagonal("sigma", N), lambda v: F.sqrt(v))
    none = F.array().cast("array<struct<at:int,target:double,confidence:double>>")
    found = F.transform("told", lambda v: F.struct(v["at"].alias("at"), (v["direction"] * v["confidence"] * F.get(F.col("volatility"), v["at"])).alias("target"), v["confidence"].alias("confidence")))
    rows = rows.withColumn("volatility", volatility).withColumn("found", F.coalesce(found, none)).withColumn("prior", portfolio.equilibrium("sigma", MARKET, AVERSION))
    rows = rows.withColumn("after", portfolio.posterior(F.col("prior"), "sigma", "found", N, TAU))

    def rank(x: str) -> object:
        """1 more than the number of better ones."""
        return F.transform(x, lambda v: F.size(F.filter(x, lambda other: other > v)) + 1)

    # By probability and by calm: the sum of both ranks, then the higher mean, then the table's order.
    calm = F.transform("volatility", lambda v: -v)
    rows = rows.withColumn("calm", calm).withColumn("by_chance", rank("probability")).withColumn("by_calm", rank("calm"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda i: F.struct((F.get("by_chance", i) + F.get("by_calm", i)).alias("rank"), (-F.get("mean", i)).alias("mean"), i.alias("at")))
    rows = rows.withColumn("order", F.transform(F.array_sort(keys), lambda k: k["at"]))
    precision = F.transform(portfolio.diagonal("sigma", N), lambda v: 1 / v)
    return rows.withColumn("ordinal", portfolio.ordinal("mean", precision, "order", N))


EXPECTED_SQL = (
    *PROBABILITY_SQL, *COVARIANCE_SQL,
    f"asset (pl, asset, ticker, market) as (values {_ASSETS_SQL})",
    f"square as (select d, list(cov order by i.pl, j.pl) as sigma, list(mean order by i.pl) filter (where a = b) as mean from cv join asset i on i.ticker = a join asset j on j.ticker = b where n >= 52 group by d having count(*) = {N * N})",
    "market as (select list(market order by pl) as weights from asset)",
    f"priors as (select d, sigma, mean, list_transform(range(0, {N}), lambda i: {AVERSION} * list_sum(list_transform(range(0, {N}), lambda j: sigma[i * {N} + j + 1] * weights[j + 1]))) as prior from square cross join market where d in (select d from chance))",
    f"told as (select d, pl, direction * confidence * sqrt(sigma[pl * {N} + pl + 1]) as target, confidence, row_number() over (partition by d order by pl) as k from seen join asset using (asset) join square using (d) where direction is not null and confidence > 0)",
    f"""steps as (
        select d, 0::bigint as k, prior as m, list_transform(sigma, lambda s: s * {TAU}) as c, sigma from priors
        union all
        select d, k, list_transform(range(0, {N}), lambda i: m[i + 1] + gain[i + 1] * (target - m[pl + 1])), list_transform(range(0, {N * N}), lambda x: c[x + 1] - gain[x // {N} + 1] * c[pl * {N} + x % {N} + 1]), sigma
        from (
            select s.d, t.k, m, c, sigma, pl, target, list_transform(range(0, {N}), lambda i: c[i * {N} + pl + 1] / (c[pl * {N} + pl + 1] + sigma[pl * {N} + pl + 1] * {TAU} * (1 - confidence) / confidence)) as gain
            from steps s join told t on t.d = s.d and t.k = s.k + 1
        )
    )""",
    "ends as (select d, arg_max(m, k) as m from steps group by d)",
    f"""ranked as (
        select d, pl, asset, mean[pl + 1] as value, 1 / sigma[pl * {N} + pl + 1] as weight,
            rank() over (partition by d order by probability desc) + rank() over (partition by d order by sigma[pl * {N} + pl + 1]) as ranks
        from priors join chance using (d) join asset using (asset)
    )""",
    "placed as (select *, row_number() over (partition by d order by ranks, value desc, pl) as pos from ranked)",
    "stretches as (select a.d, a.pos as k, b.pos as e, sum(x.weight * x.value) / sum(x.weight) as mean from placed a join placed b on a.d = b.d and b.pos >= a.pos join placed x on x.d = a.d and x.pos between a.pos and b.pos group by all)",
    "tops as (select p.d, p.pos, p.pl, s.k, max(s.mean) as top from placed p join stretches s on s.d = p.d and s.k <= p.pos and s.e >= p.pos group by all)",
    "fits as (select d, pl, min(top) as ordinal from tops group by d, pl)",
)


@query(_with(*EXPECTED_SQL) + f"select {DAY}, asset, {r('mean[pl + 1]')} as mean, {r('prior[pl + 1]')} as prior, {r('m[pl + 1]')} as posterior, {r('ordinal')} as ordinal from priors join ends using (d) join fits using (d) join asset using (pl)")
def expected_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of every asset on every Friday: past, in equilibrium, after the views, and in the order of the ranks."""
    each = F.posexplode(F.arrays_zip(F.col("mean"), F.col("prior"), F.col("after.m").alias("posterior"), F.col("ordinal")))
    names = F.array(*(F.lit(a) for a, _, _, _ in ASSETS))
    rows = expected(spark, sf_dir).select("d", each.alias("at", "x"))
    return rows.select(day(), F.get(names, F.col("at")).alias("asset"), *(six(F.col(f"x.{c}"), c) for c in ("mean", "prior", "posterior", "ordinal")))


METHODS = ("bl", "obl", "robust")
ERROR_YEARS = 3.0


def solved(spark: SparkSession, sf_dir: str, aversions: tuple[float, ...] = AVERSIONS) -> DataFrame:
    """(d, aversion, method, mu, sigma, weights, gap): three portfolios of every Friday and aversion."""
    rows = expected(spark, sf_dir).withColumn("aversion", F.explode(F.array(*map(F.lit, aversions))))
    viewed = F.size("found") > 0
    zeros, flat = portfolio.vector((0.0,) * N), portfolio.vector((MOST_WEIGHT,) * N)
    own = portfolio.vector(tuple(most for _, _, _, most in ASSETS))
    after = F.when(viewed, F.zip_with("sigma", F.col("after.c"), lambda s, c: s + c)).otherwise(F.col("sigma"))
    error = F.transform("volatility", lambda v: v / F.sqrt(F.lit(ERROR_YEARS)))
    problem = {
        "bl": (F.col("after.m"), after, own, zeros, 0.0),
        "obl": (F.col("ordinal"), F.col("sigma"), flat, zeros, 0.0),
        "robust": (F.when(viewed, F.col("after.m")).otherwise(F.col("mean")), F.col("sigma"), flat, error, 1.0),
    }
    items = F.array(*(F.struct(F.lit(m).alias("method"), mu.alias("mu"), sigma.alias("sigma"), high.alias("high"), err.alias("error"), F.lit(k).alias("penalty")) for m, (mu, sigma, high, err, k) in problem.items()))
    each = rows.select("d", "aversion", F.explode(items).alias("x")).select("d", "aversion", "x.*").withColumn("low", portfolio.vector((LEAST_WEIGHT,) * N))
    return portfolio.solve(each, ["d", "aversion", "method", "mu", "sigma"])


@query(None)
def portfolio_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market's weights beside those of the three methods, for every Friday, aversion and asset."""
    rows = solved(spark, sf_dir).select("d", "aversion", "method", F.posexplode("weights").alias("at", "weight"))
    wide = rows.groupBy("d", "aversion", "at").agg(*(F.max(F.when(F.col("method") == m, F.col("weight"))).alias(m) for m in METHODS))
    of = {name: F.get(F.array(*(F.lit(a[i]) for a in ASSETS)), F.col("at")) for i, name in enumerate(("asset", "ticker", "market"))}
    return wide.select(day(), "aversion", *(c.alias(n) for n, c in of.items()), *(six(m, m, 4) for m in METHODS))


@query(None)
def portfolio_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected return, volatility and their ratio of every portfolio, and whether it is within the solver's gap."""
    rows = solved(spark, sf_dir).withColumn("expected", portfolio.dot(F.col("mu"), F.col("weights")))
    rows = rows.withColumn("volatility", F.sqrt(portfolio.dot(F.col("weights"), portfolio.times("sigma", "weights", N))))
    ratio = F.when(F.col("volatility") > 0, F.col("expected") / F.col("volatility")).otherwise(0.0)
    return rows.select(day(), "aversion", "method", six("expected", "expected", 4), six("volatility", "volatility", 4), six(ratio, "ratio", 4), (F.col("gap") <= portfolio.GAP).alias("solved"))


@query(None)
def fund_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest Friday's weights after views by fund, with the colour of their size."""
    rows = solved(spark, sf_dir, (AVERSION,)).where("method = 'bl'").withColumn("rn", F.row_number().over(Window.orderBy(F.desc("d")))).where("rn = 1")  # a row a week
    each = rows.select("d", F.posexplode("weights").alias("at", "weight"))
    colour = F.when(F.col("weight") > 0.15, "#1f7a4f").when(F.col("weight") < 0.05, "#b42318").otherwise("#6b7280")
    return each.select(day(), F.get(F.array(*map(F.lit, TICKERS)), F.col("at")).alias("ticker"), six("weight", "weight", 4), colour.alias("colour"))


__all__ = ["ORACLE", "QUERIES"]
