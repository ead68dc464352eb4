"""Error models over district results: linear, logit, marginal effects, clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwise.functions import add_stars, fixed, indicator
from wardwise.operators.fits import fit_logits, moments, solve_linear, t_quantile, with_interactions  # noqa: F401
from wardwise.operators.report import context_gap
from wardwise.operators.space import upper_tail
from wardwise.operators.waste import dem_margin
from wardwise.session import Scratch

BASE = ["seg_medium", "seg_high", "redis_dem", "redis_rep", "dem_margin", "white_pop_diff"]
CROSSED = ["seg_medium:redis_dem", "seg_medium:redis_rep", "seg_high:redis_dem", "seg_high:redis_rep"]
SPECIFICATIONS = {
    "base": BASE,
    "interactions": [*BASE, *CROSSED],
    "interactions_2": [*BASE, *CROSSED, "dem_margin:white_pop_diff"],
    "with_rpv": [*BASE, "true_rpv"],
}
# Display names of the model terms, and of the reference row.
TERM_LABELS = {
    "seg_medium": "Medium\nSegregation",
    "seg_high": "High\nSegregation",
    "redis_dem": "Democratic\nGerrymander",
    "redis_rep": "Republican\nGerrymander",
    "dem_margin": "Dem. Margin",
    "white_pop_diff": "District % White\n- State % White",
}
REFERENCE_LABEL = "Low Segregation,\nNeutral Gerrymander"
TIDY = "term string, estimate double, std_error double, statistic double, p_value double, conf_low double, conf_high double"


def scenario_dummies() -> dict[str, Column]:
    """0/1 columns of the scenario levels; low segregation and a neutral plan are the reference."""
    return {
        "seg_medium": indicator(F.col("seg_level") == "medium"), "seg_high": indicator(F.col("seg_level") == "high"),
        "redis_dem": indicator(F.col("redist_level") == "dem"), "redis_rep": indicator(F.col("redist_level") == "rep"),
    }


def model_frame(results: DataFrame, precincts: DataFrame, statewide: float | None = None) -> DataFrame:
    """Absolute errors in points, dummies, margin and context gap of every district."""
    errors = {f"error_{g}_{m}": F.abs(F.col(f"{m}_{g}_resid")) * 100 for m in ("er", "ei") for g in ("minority", "majority")}
    return context_gap(results, precincts, statewide).withColumns(
        {**errors, **scenario_dummies(), "dem_margin": dem_margin() * 100})


def _varying(df: DataFrame, terms: Sequence[str]) -> list[str]:
    """Terms that take more than one value; a constant one cannot be told from the intercept."""
    rows = with_interactions(df, terms)
    spread = rows.agg(*[(F.max(f"`{t}`") > F.min(f"`{t}`")).alias(f"c{i}") for i, t in enumerate(terms)]).first()
    return [t for i, t in enumerate(terms) if spread[i]]


def ols_all(df: DataFrame, models: dict[str, tuple[str, Sequence[str]]]) -> dict[str, tuple[DataFrame, dict[str, float]]]:
    """Tidy coefficients (intercept last) with t-based intervals, and fit statistics, of several models (response, terms).

    The rows are read once: one aggregate sums the products of all terms and responses, and only that matrix reaches the driver.
    Each model takes the rows that are complete for it.
    """
    names = [c for response, terms in models.values() for c in (*terms, response)]
    sums, out = moments(df, names), {}
    for name, (response, terms) in models.items():
        rows, fit = solve_linear(sums, response, terms)
        out[name] = df.sparkSession.createDataFrame(rows, TIDY), fit
    return out


def ols(df: DataFrame, response: str, terms: Sequence[str]) -> tuple[DataFrame, dict[str, float]]:
    """One model of ``ols_all``."""
    return ols_all(df, {"model": (response, terms)})["model"]


def logit(df: DataFrame, response: str, terms: Sequence[str], profile: bool = False) -> tuple[DataFrame, dict[str, float]]:
    """Tidy logit coefficients (intercept last), with Wald intervals or profile-likelihood ones."""
    terms = _varying(df, terms)
    fitted = fit_logits(df, response, terms, profile=profile)
    rows = fitted.withColumn("p_value", 2 * upper_tail(F.abs("statistic"))).orderBy(F.col("place") == 0, "place").collect()  # one a term
    tidy = [tuple(r[c] for c in ("term", "estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high")) for r in rows]
    stats = {"aic": 2 * len(rows) - 2 * rows[0].loglik, "deviance": -2 * rows[0].loglik, "n": float(rows[0].n)} if rows else {}
    return df.sparkSession.createDataFrame(tidy, TIDY), stats


def coefficient_table(tables: dict[str, DataFrame]) -> DataFrame:
    """Coefficients of several models without intercepts, with labels and a reference row each."""
    out = None
    for method, tidy in tables.items():
        label = F.create_map(*[F.lit(v) for pair in TERM_LABELS.items() for v in pair])[F.col("term")]
        rows = tidy.where(F.col("term") != "(Intercept)").withColumn("term_label", label)
        ref = tidy.sparkSession.createDataFrame(
            [("reference", 0.0, 0.0, None, None, 0.0, 0.0, REFERENCE_LABEL)], TIDY + ", term_label string")
        both = rows.unionByName(ref).withColumn("method", F.lit(method))
        out = both if out is None else out.unionByName(both)
    return out


def regression_table(tables: dict[str, DataFrame], fits: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """One row per term, one column per model: coefficient with stars and (standard error).

    ``fits`` (the second result of ``ols``, by model) adds rows N, R2 and Adjusted R2.
    """
    out = None
    for name, tidy in tables.items():
        text = F.concat(add_stars("estimate", "p_value"), F.lit(" ("), fixed("std_error", 3), F.lit(")"))
        rows = tidy.select("term", F.lit(name).alias("model"), text.alias("cell"))
        if fits:
            f = fits[name]
            cells = [("N", name, f"{f['n']:.0f}"), ("R2", name, f"{f['r2']:.3f}"), ("Adjusted R2", name, f"{f['adj_r2']:.3f}")]
            rows = rows.unionByName(tidy.sparkSession.createDataFrame(cells, "term string, model string, cell string"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("term").pivot("model", list(tables)).agg(F.max("cell"))


def marginal_effects(df: DataFrame, response: str, terms: Sequence[str]) -> DataFrame:
    """Average marginal effects of a logit with delta-method standard errors.

    One aggregate sums the information matrix and the gradient of the effects; the
    driver inverts a matrix of the number of terms.
    """
    terms = _varying(df, terms)
    tidy, _ = logit(df, response, terms)
    found = {r.term: r.estimate for r in tidy.collect()}
    beta = np.array([found["(Intercept)"], *[found[t] for t in terms]])
    rows = with_interactions(df, terms).select(
        F.lit(1.0).alias("x0"), *[F.col(f"`{t}`").cast("double").alias(f"x{i}") for i, t in enumerate(terms, 1)],
        F.col(response).alias("_y")).dropna()
    k = len(beta)
    eta = sum((F.col(f"x{i}") * F.lit(float(b)) for i, b in enumerate(beta)), F.lit(0.0))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
    rows = rows.withColumns({"_w": p * (1 - p), "_v": p * (1 - p) * (1 - 2 * p)})
    cells = [F.sum(F.col("_w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"i{i}_{j}") for i in range(k) for j in range(i, k)]
    grads = [F.avg(F.col("_v") * F.col(f"x{j}")).alias(f"g{j}") for j in range(k)]
    sums = rows.agg(F.avg("_w").alias("w"), *cells, *grads).first()
    info = np.array([[sums[f"i{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    cov, grad = np.linalg.inv(info), np.array([sums[f"g{j}"] for j in range(k)])
    out = []
    for i, t in enumerate(terms, 1):
        d = beta[i] * grad
        d[i] += sums["w"]
        effect, se = float(beta[i] * sums["w"]), float(np.sqrt(d @ cov @ d))
        out.append((t, effect, se, effect / se if se else None))
    return df.sparkSession.createDataFrame(out, "term string, ame double, std_error double, z double")


def logit_by_scenario(
    df: DataFrame, response: str, value: str, keys: Sequence[str] = ("seg_level", "redist_level"), profile: bool = False,
) -> DataFrame:
    """One-variable logit per scenario, of all scenarios together: every round is one sum over the rows."""
    fitted = fit_logits(df, response, [value], keys, profile)
    tidy = fitted.withColumn("p_value", 2 * upper_tail(F.abs("statistic")))
    return tidy.select("term", "estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high", *keys)


def linear_trend(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.count(F.lit(1)).alias("n"))


def _nearest(shared):
    """Squared distance and number of each row's nearest centre, for every start: (rows, starts)."""
    centres = shared.value

    def of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = ((x[:, None, None, :] - centres[None, :, :, :]) ** 2).sum(axis=3)
        return d.min(axis=2), d.argmin(axis=2)

    return of


def _vectors(batch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)


#: Rows whose distances are held at once.
HELD = 4096


def _cluster_sums(shared):
    """Count, sums and squared distances of every cluster of every start, over the rows of a task."""

    def rows(batches):
        centres = shared.value
        starts, k, d = centres.shape
        n, s, cost = np.zeros((starts, k)), np.zeros((starts, k, d)), np.zeros((starts, k))
        nearest = _nearest(shared)
        for batch in batches:
            whole = _vectors(batch)
            for first in range(0, len(whole), HELD):
                x = whole[first : first + HELD]
                best, own = nearest(x)
                for i in range(starts):
                    n[i] += np.bincount(own[:, i], minlength=k)
                    cost[i] += np.bincount(own[:, i], best[:, i], k)
                    for j in range(d):
                        s[i, :, j] += np.bincount(own[:, i], x[:, j], k)
        at = np.indices((starts, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0]), pa.array(at[1]), pa.array(n.ravel()), pa.array(list(s.reshape(-1, d)), pa.list_(pa.float64())), pa.array(cost.ravel())],
            names=["start", "cluster", "n", "s", "cost"])

    return rows


def lloyd(rows: DataFrame, centres: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lloyd's rounds for several starts at once, from ``centres`` (starts, k, columns): the last centres, each start's sum of squares, and the rounds it took.

    Every task sums its rows under all starts, and one aggregate a round adds up starts x k rows. A start whose centres no longer move is left as it is;
    a cluster that loses all rows keeps its centre; a row between two centres goes to the first.
    """
    spark, centres = rows.sparkSession, np.array(centres, dtype=float)
    taken, cost = np.zeros(len(centres), dtype=int), np.full(len(centres), np.inf)
    moving = np.arange(len(centres))
    schema = "start long, cluster long, n double, s array<double>, cost double"
    for k in range(1, rounds + 1):
        shared = spark.sparkContext.broadcast(centres[moving])
        size = centres.shape[2]
        sums = rows.mapInArrow(_cluster_sums(shared), schema).groupBy("start", "cluster").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(j))) for j in range(size)]).alias("s"), F.sum("cost").alias("cost")).collect()
        new, total = centres[moving].copy(), np.zeros(len(moving))
        for r in sums:
            total[r.start] += r.cost
            if r.n:
                new[r.start, r.cluster] = np.array(r.s) / r.n
        cost[moving], taken[moving] = total, k
        # Centres one bit apart are the same: sums come in any order.
        still = (np.abs(new - centres[moving]) <= 1e-12 * (1 + np.abs(new))).all(axis=(1, 2))
        centres[moving] = np.where(still[:, None, None], centres[moving], new)
        moving = moving[~still]
        if not len(moving):
            break
    return centres, cost, taken


def z_scored(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` as z0, z1, ...: less their mean, in sample standard deviations; a constant column is zero. Rows that lack one are left out."""
    values = df.select("*", *[F.col(f"`{c}`").cast("double").alias(f"z{i}") for i, c in enumerate(columns)]).dropna(subset=[f"z{i}" for i in range(len(columns))])
    stats = values.agg(*[f(f"z{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return values.withColumns({
        f"z{i}": (F.col(f"z{i}") - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"]) if stats[f"s{i}"] else F.lit(0.0) for i in range(len(columns))})


def cluster(
    df: DataFrame, columns: Sequence[str], k: int, seed: int = 123, name: str = "geog_id", starts: int = 25, rounds: int = 100,
    centres: Sequence[Sequence[Sequence[float]]] | None = None,
) -> DataFrame:
    """k-means on z-scored columns, the best of ``starts`` starts; the cluster number starts from 1, in the order of the centres.

    All starts are advanced together (``lloyd``). Each begins at k rows picked by a seeded hash, or at ``centres`` (starts, k, columns; z-scored) where they are given.
    With fewer than k different rows there are fewer clusters. Rows that lack a column are left out.
    """
    scratch, z = Scratch(df.sparkSession, "clusters"), [f"z{i}" for i in range(len(columns))]
    rows = scratch.write(z_scored(df, columns), "rows")
    if centres is None:
        # The k x starts different rows of smallest hash: few, whatever the table holds.
        picked = rows.select(*z).distinct().orderBy(F.xxhash64(F.lit(seed), *z), *z).limit(k * starts).collect()
        if not picked:
            return rows.select(*df.columns, F.lit(None).cast("bigint").alias(name))
        size = min(k, len(picked))
        deal = [[picked[(s * size + j) % len(picked)] for j in range(size)] for s in range(starts)]
        centres = [[list(r) for r in own] for own in deal]
    found, cost, _ = lloyd(rows.select(*z), np.array(centres, dtype=float), rounds)
    best = found[int(np.argmin(cost))]
    best = best[np.lexsort(best.T[::-1])]
    square = [sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(z, centre, strict=True)), F.lit(0.0)) for centre in best]
    nearest = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i + 1).cast("bigint").alias("i")) for i, d in enumerate(square)]))
    return rows.withColumn(name, nearest["i"]).select(*df.columns, name)


def assign_voters(voters: DataFrame, precincts: DataFrame, cluster_col: str = "geog_id") -> DataFrame:
    """Voters with the cluster of their precinct."""
    return voters.join(precincts.select("precinct_id", cluster_col), "precinct_id", "left")
