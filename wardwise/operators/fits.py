"""Least squares and logits from sums: the rows are read once for all linear models, and once a round for all logits.

Executors add up products of columns; the driver, or a task per row of sums, solves systems of the size of the
number of terms.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwise.operators.ordered import join_same
from wardwise.session import Scratch

#: A term whose own variance, beyond what the terms before it explain, is this share of the whole or less is left out.
TOLERANCE = 1e-10
#: 95 % point of the chi-squared distribution with one degree of freedom, and of the normal distribution (two-sided).
CHI2, NORMAL = 3.841458820694124, 1.959963984540054


def t_quantile(p: float, dof: float) -> float:
    """Student t quantile, bisected on ``t_below``."""
    if p < 0.5:
        return -t_quantile(1 - p, dof)
    low, high = 0.0, 1.0
    while t_below(high, dof) < p:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if t_below(mid, dof) < p else (low, mid)
    return (low + high) / 2


def t_below(t: float, dof: float) -> float:
    """Student t distribution function: with t = sqrt(dof) tan(a), the density is a power of cos(a), summed by Simpson's rule."""
    scale = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi)
    weights = np.array([1.0, *[4.0, 2.0] * 499, 4.0, 1.0]) / 3
    end = math.atan(t / math.sqrt(dof))
    return 0.5 + scale * float(weights @ np.cos(np.linspace(0, end, 1001)) ** (dof - 1)) * end / 1000


def with_interactions(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Product columns for terms written ``a:b``."""
    new = {t: F.col(t.split(":")[0]) * F.col(t.split(":")[1]) for t in terms if ":" in t and t not in df.columns}
    return df.withColumns(new)


@dataclass
class Moments:
    """Counts, sums and sums of products of columns, by which of the columns a row has."""

    names: list[str]
    parts: list[tuple[str, float, np.ndarray, np.ndarray]]

    def over(self, names: Sequence[str]) -> tuple[float, np.ndarray, np.ndarray]:
        """Number, means and centred products of the rows that have all of ``names``."""
        at = [self.names.index(n) for n in names]
        n, s, c = 0.0, np.zeros(len(at)), np.zeros((len(at), len(at)))
        for has, count, sums, products in self.parts:
            if all(has[i] == "1" for i in at):
                n, s, c = n + count, s + sums[at], c + products[np.ix_(at, at)]
        mean = s / n if n else s
        return n, mean, c - n * np.outer(mean, mean)


def moments(df: DataFrame, names: Sequence[str]) -> Moments:
    """One pass over the rows. Each pattern of missing values is a group, so every model takes the rows that are complete for it."""
    names = list(dict.fromkeys(names))
    rows = with_interactions(df, names).select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    missing = [F.col(f"v{i}").isNull() | F.isnan(f"v{i}") for i in range(len(names))]
    filled = rows.select(
        F.concat(*[F.when(m, "0").otherwise("1") for m in missing]).alias("has"),
        *[F.when(m, 0.0).otherwise(F.col(f"v{i}")).alias(f"v{i}") for i, m in enumerate(missing)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = filled.groupBy("has").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(f"v{i}") for i in range(len(names))]).alias("s"),
        F.array(*[F.sum(F.col(f"v{i}") * F.col(f"v{j}")) for i, j in pairs]).alias("c")).collect()  # patterns of missing values
    parts = []
    for r in found:
        c = np.zeros((len(names), len(names)))
        for (i, j), v in zip(pairs, r.c, strict=True):
            c[i, j] = c[j, i] = v
        parts.append((r.has, float(r.n), np.array(r.s), c))
    return Moments(names, parts)


def solve_linear(m: Moments, response: str, terms: Sequence[str]) -> tuple[list[tuple], dict[str, float]]:
    """(term, estimate, std_error, statistic, p_value, conf_low, conf_high) with the intercept last, and fit statistics.

    The centred products are swept term by term; a term that does not vary, or that the terms before it determine, is left out.
    """
    n, mean, a = m.over([*terms, response])
    own, y, used = np.diag(a).copy(), len(terms), []
    size = own + n * mean * mean  # before centring
    for p in range(y):
        if a[p, p] <= TOLERANCE * own[p] or own[p] <= 1e-13 * size[p]:
            continue
        pivot, column = a[p, p], a[:, p].copy()
        a = a - np.outer(column, column) / pivot
        a[:, p] = a[p, :] = column / pivot
        a[p, p] = -1 / pivot
        used.append(p)
    dof = n - len(used) - 1
    rss, total = a[y, y], own[y]
    variance = rss / dof if dof > 0 else math.nan
    b, inverse, x = a[used, y], -a[np.ix_(used, used)], mean[used]
    est = [*b, mean[y] - x @ b]
    se = [*np.sqrt(np.diag(inverse) * variance), math.sqrt((1 / n + x @ inverse @ x) * variance)] if n else [math.nan] * len(est)
    q = t_quantile(0.975, dof) if dof > 0 else math.nan
    rows = []
    for name, e, s in zip([*[terms[p] for p in used], "(Intercept)"], est, se, strict=True):
        t = e / s if s else math.nan
        p = 2 * (1 - t_below(abs(t), dof)) if dof > 0 and not math.isnan(t) else math.nan
        rows.append((name, float(e), float(s), float(t), float(min(max(p, 0.0), 1.0)), float(e - q * s), float(e + q * s)))
    r2 = 1 - rss / total if total > 0 else math.nan
    adjusted = 1 - (1 - r2) * (n - 1) / dof if dof > 0 else math.nan
    return rows, {"r2": float(r2), "adj_r2": float(adjusted), "n": float(n), "dof": float(dof)}


# ------------------------------------------------------------------------ logits
def _round_sums(rows: DataFrame, problems: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Log-likelihood, gradient and information of every problem at its coefficients: one sum over the rows of its group."""
    joined = join_same(rows, problems.select(*keys, "problem", "beta"), keys)
    x = [F.get("x", F.lit(i)) for i in range(size)]
    eta = sum((x[i] * F.get("beta", F.lit(i)) for i in range(size)), F.lit(0.0))
    with_eta = joined.withColumn("eta", eta)
    p = 1 / (1 + F.exp(-F.col("eta")))
    fitted = with_eta.select(
        *keys, "problem", "x", (F.col("y") - p).alias("r"), (p * (1 - p)).alias("w"),
        (F.col("y") * F.col("eta") - F.greatest("eta", F.lit(0.0)) - F.log1p(F.exp(-F.abs("eta")))).alias("l"))
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    return fitted.groupBy(*keys, "problem").agg(
        F.sum("l").alias("loglik"), F.array(*[F.sum(F.col("r") * x[i]) for i in range(size)]).alias("gradient"),
        F.array(*[F.sum(F.col("w") * x[i] * x[j]) for i, j in pairs]).alias("information"))


def _matrix(cells, size: int) -> np.ndarray:
    a = np.zeros((size, size))
    a[np.triu_indices(size)] = cells
    return a + np.triu(a, 1).T


STATE = "problem int, beta array<double>, goal double, loglik double, information array<double>, moved double"


def _step(size: int, keys: Sequence[str]):
    """Newton's step of each row. Problem 0 looks for the maximum; problem 2j+1 or 2j+2 for the place where coefficient j is so far below or above that the
    best log-likelihood with it equals ``goal``: its first equation is that difference, the others are the gradients of the other coefficients."""

    def steps(frames):
        for pdf in frames:
            rows = []
            for key, r in zip(pdf[list(keys)].itertuples(index=False), pdf.itertuples(index=False), strict=True):
                beta, gradient, info = np.array(r.beta, dtype=float), np.array(r.gradient, dtype=float), _matrix(r.information, size)
                try:
                    if r.problem == 0:
                        delta = np.linalg.solve(info, gradient)
                    else:
                        j = (r.problem - 1) // 2
                        system, value = -info, gradient.copy()
                        system[j], value[j] = gradient, r.loglik - r.goal
                        delta = -np.linalg.solve(system, value)
                except np.linalg.LinAlgError:
                    delta = np.full(size, np.nan)
                if np.isfinite(delta).all():
                    beta, moved = beta + delta, float(np.abs(delta).max())
                else:
                    beta, moved = np.full(size, np.nan), 0.0
                rows.append([*key, r.problem, beta.tolist(), r.goal, r.loglik, list(r.information), moved])
            yield pd.DataFrame(rows, columns=[*keys, "problem", "beta", "goal", "loglik", "information", "moved"])

    return steps


def _newton(rows: DataFrame, problems: DataFrame, keys: list[str], size: int, scratch: Scratch, name: str, rounds: int, tolerance: float) -> DataFrame:
    """Advances all problems of all groups together, one pass over the rows a round; those at rest, or without a solution, leave the rounds."""
    kinds = ", ".join(f"`{k}` {t}" for k, t in problems.select(*keys).dtypes)
    done, active = None, problems.select(*keys, "problem", "beta", "goal")
    for k in range(rounds):
        sums = join_same(_round_sums(rows, active, keys, size), active, [*keys, "problem"])
        new = scratch.write(sums.mapInPandas(_step(size, keys), f"{kinds}, {STATE}"), f"{name}{k}")
        rest = F.col("moved") < tolerance
        found = new.where(rest)
        done = found if done is None else done.unionByName(found)
        active = new.where(~rest).select(*keys, "problem", "beta", "goal")
        if active.isEmpty():
            break
    # What has not come to rest has no solution: the outcomes can be told apart without error, or the likelihood never falls so far.
    lost = new.where(~rest).withColumn("beta", F.array_repeat(F.lit(float("nan")), size))
    return done.unionByName(lost)


def _estimates(size: int, keys: Sequence[str]):
    def rows_of(frames):
        for pdf in frames:
            rows = []
            for key, r in zip(pdf[list(keys)].itertuples(index=False), pdf.itertuples(index=False), strict=True):
                beta = np.array(r.beta, dtype=float)
                if np.isfinite(beta).all():
                    info = _matrix(r.information, size)
                    se = np.sqrt(np.diag(np.linalg.inv(info)))
                    rows.append([*key, beta.tolist(), se.tolist(), r.loglik])
            yield pd.DataFrame(rows, columns=[*keys, "beta", "se", "loglik"])

    return rows_of


def _starts_of_profiles(size: int, keys: Sequence[str]):
    """Two problems a coefficient, begun where the quadratic approximation of the likelihood puts them."""

    def rows_of(frames):
        for pdf in frames:
            rows = []
            for key, r in zip(pdf[list(keys)].itertuples(index=False), pdf.itertuples(index=False), strict=True):
                beta = np.array(r.beta, dtype=float)
                cov = np.linalg.inv(_matrix(r.information, size))
                for j in range(size):
                    for end, sign in enumerate((-1, 1)):
                        start = beta + sign * NORMAL * cov[j] / math.sqrt(cov[j, j])
                        rows.append([*key, 2 * j + 1 + end, start.tolist(), r.loglik - CHI2 / 2])
            yield pd.DataFrame(rows, columns=[*keys, "problem", "beta", "goal"])

    return rows_of


def fit_logits(
    df: DataFrame, response: str, terms: Sequence[str], keys: Sequence[str] = (), profile: bool = False, rounds: int = 30, tolerance: float = 1e-9,
) -> DataFrame:
    """Logits of all groups at once: keys, term ((Intercept) first), estimate, std_error, statistic, conf_low, conf_high, loglik and n.

    Every Newton round is one sum over the rows. ``profile`` asks for profile-likelihood intervals: the ends of all coefficients are
    looked for together, in rounds of the same kind; else the intervals are Wald's. A group in which the outcome never varies, a term does not
    vary by itself, or the outcomes can be told apart without error has no rows; an end that does not exist is NULL.
    Rows that lack the response or a term are left out.
    """
    keys, scratch, size = list(keys), Scratch(df.sparkSession, "logit"), len(terms) + 1
    # Names of its own for the keys: theirs may be those of a column below. Without keys, all rows are one group.
    by = [f"_key{i}" for i in range(max(len(keys), 1))]
    columns = with_interactions(df, terms).select(
        *[(F.col(f"`{keys[i]}`") if keys else F.lit(1)).alias(k) for i, k in enumerate(by)], F.col(response).cast("double").alias("y"), F.array(F.lit(1.0), *[F.col(f"`{t}`").cast("double") for t in terms]).alias("x"))
    whole = F.col("y").isNotNull() & ~F.isnan("y") & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))
    rows = scratch.write(columns.where(whole), "rows")
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo < hi")
    groups = scratch.write(groups.drop("lo", "hi"), "groups")
    begin = groups.select(*by, F.lit(0).alias("problem"), F.array_repeat(F.lit(0.0), size).alias("beta"), F.lit(0.0).alias("goal"))
    kinds = ", ".join(f"`{k}` {t}" for k, t in groups.select(*by).dtypes)
    fitted = _newton(rows, begin, by, size, scratch, "fit", rounds, tolerance)
    best = fitted.mapInPandas(_estimates(size, by), f"{kinds}, beta array<double>, se array<double>, loglik double")
    best = scratch.write(join_same(best, groups, by), "best")
    named = F.array(*[F.lit(t) for t in ["(Intercept)", *terms]])
    long = best.select(*by, "n", "loglik", F.posexplode(F.arrays_zip(named.alias("term"), "beta", "se")).alias("place", "c")).select(
        *by, "place", F.col("c.term").alias("term"), F.col("c.beta").alias("estimate"), F.col("c.se").alias("std_error"),
        (F.col("c.beta") / F.col("c.se")).alias("statistic"), "loglik", "n")
    if profile:
        known = join_same(fitted.where(~F.isnan(F.get("beta", F.lit(0)))).select(*by, "beta", "information", "loglik"), groups.select(*by), by)
        begun = scratch.write(known.mapInPandas(_starts_of_profiles(size, by), f"{kinds}, problem int, beta array<double>, goal double"), "ends")
        ends = _newton(rows, begun, by, size, scratch, "end", rounds, tolerance)
        place = F.floor((F.col("problem") - 1) / 2).cast("int")
        at = F.get("beta", place)
        found = ends.select(*by, place.alias("place"), F.pmod("problem", F.lit(2)).alias("low"), F.when(~F.isnan(at), at).alias("at"))
        limits = found.groupBy(*by, "place").agg(F.max(F.when(F.col("low") == 1, F.col("at"))).alias("conf_low"), F.max(F.when(F.col("low") == 0, F.col("at"))).alias("conf_high"))
        long = join_same(long, limits, [*by, "place"], "left")
    else:
        q = F.lit(NORMAL) * F.col("std_error")
        long = long.withColumns({"conf_low": F.col("estimate") - q, "conf_high": F.col("estimate") + q})
    named_keys = [F.col(b).alias(k) for b, k in zip(by, keys, strict=False)]
    return long.select(*named_keys, "place", "term", "estimate", "std_error", "statistic", "conf_low", "conf_high", "loglik", "n")
