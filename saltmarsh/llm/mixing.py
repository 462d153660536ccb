"""Mixing to target weights with soft domain membership, in DataFrame operations alone.

A naive Bayes classifier over hashed words is fitted on the rows of the labelled table and gives every
document a posterior over the domains; evidence is tempered to at most ``EVIDENCE`` words, so that a text
in two languages belongs to both.  Then nonnegative rates r, one per document, are fitted by projected
gradient on

    1/2 sum_k (A_k r - T_k)^2 / (T_k S),   r >= 0,   from r = 1

with t_d the words of a document, A_k r = sum_d t_d p_dk r_d the expected words of domain k, T_k the
target, S all words.  Steps are divided by t_d / S and projected lazily: the steps add up before the
projection, r_d = max(0, 1 - sum_k p_dk m_k).  So a document's rate needs its posterior and one number per
domain; a step is one aggregation to a row, and the driver holds those numbers, never documents.  Steps are
scaled by the curve over the documents of positive rate, so that a domain which is rare against its target
is reached as soon as any other; they end when the targets are met, not after a number of steps.

Rows without words have rate 1.  Null texts are empty texts; labelled rows are those with a domain among
the targets and a doc_id that the labelled table holds (repeated or null ids there count once or not);
a target domain without labelled rows is left out and the other targets keep their proportions; without
labelled rows all rates are 1.  Repeated rows are rows of their own and share the copies of all of them;
rows that share a doc_id, or have none, are told apart by their texts.  A very long text is one row's words.
An empty table gives an empty result.  Columns named like the results are replaced.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

BUCKETS = 4096
EVIDENCE = 30
SMOOTHING = 0.1
STEPS = 500
TOLERANCE = 1e-4
#: Steps without a gain after which the targets count as out of reach.
PATIENCE = 20
#: Equal rows that one task lays out.
BLOCK = 4096
SPACES = "[\\x20\\x09-\\x0D]+"
#: Shares of words by language of the production mix.
TARGETS = {"de": 0.15, "en": 0.5, "es": 0.15, "fr": 0.2}


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACES), "")


def numbers(values: np.ndarray) -> Column:
    """An array as one literal, which plans handle faster than one literal per entry."""
    return F.split(F.lit(" ".join(map(repr, values.tolist()))), " ").cast("array<double>")


def summed(buckets: str, row: Column) -> Column:
    """Sum of what ``row`` holds for each of ``buckets``."""
    return F.aggregate(buckets, F.lit(0.0), lambda total, b: total + F.get(row, b))


class Classifier:
    """Log weights (domains, buckets) and log priors."""

    def __init__(self, domains: list[str], counts: np.ndarray, rows: np.ndarray):
        self.domains = domains
        if len(domains):
            self.weights = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * counts.shape[1]))
            self.priors = np.log(rows / rows.sum())

    def with_posteriors(self, docs: DataFrame, prefix: str = "p_") -> DataFrame:
        """``docs`` with n_tokens and a posterior per domain."""
        ready = docs.withColumn("__buckets", F.transform(words(F.col("text")), bucket)).withColumn("n_tokens", F.size("__buckets").cast("long"))
        names = [f"{prefix}{d}" for d in self.domains]
        if len(self.domains) == 1:
            return ready.withColumn(names[0], F.lit(1.0)).drop("__buckets")
        less = F.lit(float(EVIDENCE)) / F.greatest(F.col("n_tokens"), F.lit(EVIDENCE)).cast("double")
        odds = {}  # against the first domain
        for k in range(1, len(self.domains)):
            total = summed("__buckets", numbers(self.weights[k] - self.weights[0]))
            odds[f"__odds{k}"] = total * less + float(self.priors[k] - self.priors[0])
        scored = ready.withColumns(odds).drop("__buckets")
        each = [F.lit(0.0), *map(F.col, odds)]
        most = F.greatest(*each)
        scored = scored.withColumns({f"__e{k}": F.exp(x - most) for k, x in enumerate(each)})
        whole = sum((F.col(f"__e{k}") for k in range(1, len(each))), F.col("__e0"))
        scored = scored.withColumn("__whole", whole)
        return scored.withColumns({name: F.col(f"__e{k}") / F.col("__whole") for k, name in enumerate(names)}).drop(*odds, "__whole", *(f"__e{k}" for k in range(len(each))))


def train(docs: DataFrame, labels: DataFrame, domain: str, targets: dict[str, float]) -> Classifier:
    """Counts over all labelled rows; the driver receives a row per domain and bucket."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(domain).cast("string").alias("domain"), F.col("text"))
    rows = texts.where(F.col("domain").isin(*targets)).join(ids.hint("merge"), "doc_id", "left_semi")
    exploded = rows.select("domain", F.explode(F.concat(F.array(F.lit(-1)), F.transform(words(F.col("text")), bucket))).alias("b"))
    got = exploded.groupBy("domain", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    domains = sorted({r["domain"] for r in got})
    counts, seen = np.zeros((len(domains), BUCKETS)), np.zeros(len(domains))
    for r in got:
        if r["b"] < 0:
            seen[domains.index(r["domain"])] = r["n"]
        else:
            counts[domains.index(r["domain"]), r["b"]] = r["n"]
    return Classifier(domains, counts, seen)


def rate(domains: list[str], pulls: np.ndarray, prefix: str = "p_") -> Column:
    """Rate of a document: 1 less the pulls of its domains, projected to the nonnegative numbers."""
    value = F.lit(1.0)
    for name, pull in zip(domains, pulls.tolist(), strict=True):
        value = value - F.col(f"{prefix}{name}") * pull
    return F.when(F.col("n_tokens") > 0, F.greatest(F.lit(0.0), value)).otherwise(1.0)


def fit(table: DataFrame, domains: list[str], targets: dict[str, float], steps: int = STEPS, tolerance: float = TOLERANCE, prefix: str = "p_") -> np.ndarray:
    """The pull of every domain, from ``table``, a written table with n_tokens and posteriors.

    Goes on until every target is met within ``tolerance``.  Where the targets can't be met (``PATIENCE`` steps
    without a gain, or ``steps`` in all), the best pulls are given and a warning states what is missing.
    """
    p = [F.col(f"{prefix}{d}") for d in domains]
    n = len(p)
    pulls = np.zeros(n)
    t = F.col("n_tokens").cast("double")
    words_in_all = table.agg(F.sum(t).alias("s")).first()["s"] if domains else None
    if not words_in_all:
        return pulls
    share = np.array([targets[d] for d in domains])
    share = share / share.sum()
    aim = share * words_in_all
    scale = np.sqrt(aim)

    def at(pulls: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """How far each domain is off its target, the curve there, and the potential whose slope that is."""
        now = rate(domains, pulls, prefix)
        live = F.when(now > 0, t).otherwise(0.0)
        pairs = [F.sum(live * p[i] * p[j]).alias(f"h{i}_{j}") for i in range(n) for j in range(i + 1)]
        got = table.agg(*[F.sum(t * now * x).alias(f"a{k}") for k, x in enumerate(p)], F.sum(t * now * now).alias("square"), *pairs).first()
        curve = np.zeros((n, n))
        for i in range(n):
            for j in range(i + 1):
                curve[i, j] = curve[j, i] = got[f"h{i}_{j}"] / (scale[i] * scale[j])
        return np.array([got[f"a{k}"] for k in range(n)]) / aim - 1, curve, got["square"] / 2 + float(aim @ pulls)

    def step(curve: np.ndarray, off: np.ndarray) -> np.ndarray:
        return np.linalg.lstsq(curve, scale * off, rcond=1e-12)[0] / scale

    off, first, potential = at(pulls)
    curve, best, least, idle = first, pulls, math.inf, 0
    for _ in range(steps):
        missed = float(np.abs(off).max())
        idle = 0 if missed < 0.99 * least else idle + 1
        if missed < least:
            best, least = pulls, missed
        if least < tolerance or idle >= PATIENCE:
            break
        trial = pulls + step(curve, off)
        there = at(trial)
        if not there[2] < potential:  # the first curve bounds all others, so its step never leads upwards
            trial = pulls + step(first, off)
            there = at(trial)
        pulls, (off, curve, potential) = trial, there
    if least >= tolerance:
        warnings.warn(f"mixing targets not met: words of a domain are up to {least:.2%} off", RuntimeWarning, stacklevel=2)
    return best


def copies(often: Column, *key: Column | str) -> Column:
    """How often a document is taken: ``often``, its fraction decided by a hash of ``key``."""
    luck = F.pmod(F.xxhash64(*key, F.lit("mix")), F.lit(1 << 24)).cast("double") / float(1 << 24)
    return F.floor(often + luck).cast("long")


def mix_rates(docs: DataFrame, labels: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, source, n_tokens, posteriors p_<domain>, rate and copies of every row."""
    targets = targets or TARGETS
    model = train(docs, labels, domain, targets)
    text = F.col("text").cast("string")
    some = docs.select("doc_id", "source", text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__text"))
    if not model.domains:
        table = some.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("n_tokens"), "__text")
    else:
        table = model.with_posteriors(some).drop("text")
    table = written(table, "members")
    rated = table.withColumn("rate", rate(model.domains, fit(table, model.domains, targets)))
    missing = {f"p_{d}": F.lit(0.0) for d in targets if d not in model.domains}
    return dealt_copies(rated.withColumns(missing)).select("doc_id", "source", "n_tokens", *(f"p_{d}" for d in targets), "rate", "copies")


def dealt_copies(rated: DataFrame) -> DataFrame:
    """Adds copies to every row: equal rows (doc_id, source, __text) share what their rates add up to, as evenly as whole numbers go.

    The sum of a group of equal rows is rounded once, by a hash of the row, so a group of any size meets its share of the target.
    Groups are dealt out again in blocks of ``BLOCK`` rows before they are laid out, so none is laid out by one task.
    """
    key = ["doc_id", "source", "__text"]
    rest = [c for c in rated.columns if c not in key]
    groups = rated.groupBy(*key).agg(F.count(F.lit(1)).alias("__rows"), *(F.first(c).alias(c) for c in rest))
    groups = groups.withColumn("__sum", copies(F.col("rate") * F.col("__rows"), *key))
    blocks = groups.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__rows") - 1) / BLOCK)))).repartition(*key, "__block")
    last = F.least((F.col("__block") + 1) * BLOCK, F.col("__rows")) - 1
    each = blocks.withColumn("__nth", F.explode(F.sequence(F.col("__block") * BLOCK, last)))
    share = F.floor(F.col("__sum") / F.col("__rows")) + F.when(F.col("__nth") < F.col("__sum") % F.col("__rows"), 1).otherwise(0)
    return each.withColumn("copies", share.cast("long"))


def mixed(docs: DataFrame, labels: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with every row as often as its rate says.

    Posteriors are computed once and written beside the row: the fit reads them alone, and the filter on
    copies and the explode then see stored columns.  Over computed ones both would be pushed below the
    projection, and every posterior computed again for each mention of it.
    """
    targets = targets or TARGETS
    model = train(docs, labels, domain, targets)
    if not model.domains:
        return docs
    table = written(model.with_posteriors(docs.select(F.struct(*docs.columns).alias("__row"), F.col("text"))).drop("text"), "members")
    pulls = fit(table, model.domains, targets)
    often = copies(rate(model.domains, pulls), F.col("__row.doc_id"), F.col("__row.text"))
    taken = table.withColumn("__copies", often.cast("int")).where("__copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")
