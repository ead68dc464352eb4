"""Ecological inference: summaries of posterior draws, and a grid estimate without draws."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwise.functions import clamp, try_div
from wardwise.operators.frames import district_sums, district_totals, truth_columns
from wardwise.operators.regression import add_regression
from wardwise.operators.rpv import residual_columns, rpv_flag
from wardwise.schemas import DISTRICT
from wardwise.session import Scratch, slices

MAX_CORRELATION = 0.99


def district_draws(
    draws: DataFrame, precincts: DataFrame | None, keys: Sequence[str] = DISTRICT, totals: Sequence[Column] = ()
) -> DataFrame:
    """District rate of each group per draw: precinct rates weighted by group size.

    Draws that carry the group sizes already are not joined: a plan row has many draws, and its sizes are cheaper to join before.
    Draws come with one row each (``draw``, ``beta_min``, ``beta_maj``), or with one row per plan row and a pair of columns for each draw
    (``beta_min_0``, ``beta_maj_0``, ...), which are summed where they are read, without a row for each. In that form, ``totals`` are further sums over
    the plan rows, taken in the same pass and given beside the district's every draw.
    """
    sizes = ["n_minority", "n_majority"]
    sized = draws if set(sizes) <= set(draws.columns) else draws.join(precincts.select("precinct_id", *sizes), "precinct_id")
    beside = [int(c.removeprefix("beta_min_")) for c in draws.columns if c.startswith("beta_min_")]
    weighted = lambda rate, size: F.sum(F.col(rate) * F.col(size))
    if not beside:
        if totals:
            raise ValueError("totals need one row per plan row, with its draws in columns")
        return sized.groupBy(*keys, "draw").agg(
            try_div(weighted("beta_min", "n_minority"), F.sum("n_minority")).alias("minority_rate"),
            try_div(weighted("beta_maj", "n_majority"), F.sum("n_majority")).alias("majority_rate"),
        )
    sums = sized.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sizes],
        *[weighted(f"beta_{g}_{k}", f"n_{g}ority").alias(f"_{g}_{k}") for k in beside for g in ("min", "maj")],
        *totals,
    )
    names = sums.columns[len(keys) + len(sizes) + 2 * len(beside):]
    rates = [F.struct(
        F.lit(k).cast("bigint").alias("draw"), *[try_div(f"_{g}_{k}", f"n_{g}ority").alias(f"{g}ority_rate") for g in ("min", "maj")],
    ) for k in beside]
    return sums.select(*keys, *names, F.inline(F.array(*rates)))


def summarise_draws(
    draws: DataFrame, precincts: DataFrame | None, keys: Sequence[str] = DISTRICT, totals: Sequence[Column] = ()
) -> DataFrame:
    """Posterior mean and standard deviation per district, with the flag, and the ``totals`` of the same pass."""
    rates = district_draws(draws, precincts, keys, totals)
    carried = [c for c in rates.columns if c not in (*keys, "draw", "minority_rate", "majority_rate")]
    return rates.groupBy(*keys).agg(
        *[F.any_value(c).alias(c) for c in carried],
        F.avg("minority_rate").alias("ei_minority_dem_share"),
        F.avg("majority_rate").alias("ei_majority_dem_share"),
        F.stddev_samp("minority_rate").alias("ei_minority_sd"),
        F.stddev_samp("majority_rate").alias("ei_majority_sd"),
    ).withColumn("ei_rpv", rpv_flag("ei_minority_dem_share", "ei_majority_dem_share"))


def inference_from_draws(
    draws: DataFrame, precincts: DataFrame | None = None, units: DataFrame | None = None, keys: Sequence[str] = DISTRICT
) -> DataFrame:
    """Draw summaries with truth, residuals and the district's group and vote shares.

    Without ``units``, ``draws`` are the plan rows with their counts and their draws in columns: one pass over them gives both.
    """
    if units is None:
        both = summarise_draws(draws, precincts, keys, district_totals()).dropna(subset=list(keys))
        return _compared(both.withColumns(truth_columns()))
    truth = district_sums(units, keys).withColumns(truth_columns())
    return with_truth(summarise_draws(draws, precincts, keys), truth, keys)


def with_truth(estimates: DataFrame, truth: DataFrame, keys: Sequence[str] = DISTRICT) -> DataFrame:
    return _compared(estimates.join(truth, list(keys)))


def _compared(both: DataFrame) -> DataFrame:
    return both.withColumns({
        **residual_columns("ei"),
        "prop_minority": try_div("total_minority", "total_population"),
        "prop_dem": try_div("total_dem_votes", F.col("total_dem_votes") + F.col("total_rep_votes")),
    })


# ---------------------------------------------------------------- grid estimate
def bounds(units: DataFrame) -> DataFrame:
    """Precinct share X of the minority, vote share T, and the feasible minority rates."""
    x, t = try_div("n_minority", "population"), try_div("dem_votes", "population")
    mixed = (F.col("x") > 0) & (F.col("x") < 1)
    return units.withColumns({"x": x, "t": t}).where(F.col("x").isNotNull()).withColumns({
        "lo": F.when(mixed, F.greatest(F.lit(0.0), (F.col("t") - (1 - F.col("x"))) / F.col("x"))),
        "hi": F.when(mixed, F.least(F.lit(1.0), F.col("t") / F.col("x"))),
    })


def _rates(grid: int, lo, hi, x, t, mu_b, mu_w, i_bb, i_ww, i_bw) -> dict[str, np.ndarray]:
    """Posterior moments of each precinct's rates over its grid, from columns of equal length.

    A row's grid has a fixed, small number of points, so the rows are one matrix. Exponents are taken relative to the row's largest: a precinct
    far from the district's mean keeps weights that sum to one or more, whatever its distance.
    """
    col = lambda s: np.asarray(s, dtype="float64").reshape(-1, 1)
    b = col(lo) + (col(hi) - col(lo)) * np.arange(grid + 1)[None, :] / grid
    with np.errstate(divide="ignore", invalid="ignore"):
        w = (col(t) - col(x) * b) / (1.0 - col(x))
        db, dw = b - col(mu_b), w - col(mu_w)
        power = -0.5 * (col(i_bb) * db * db + 2.0 * col(i_bw) * db * dw + col(i_ww) * dw * dw)
        weight = np.exp(power - power.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        return {n: (weight * v).sum(axis=1) for n, v in (("b", b), ("w", w), ("bb", b * b), ("ww", w * w), ("bw", b * w))}


def _moments(grid: int):
    """``_rates`` by Arrow batch: the E step needs no shuffle and no extra rows.

    Higher-order functions can express the same sum, but are interpreted point by point.
    """

    @F.pandas_udf("b double, w double, bb double, ww double, bw double")
    def moments(
        lo: pd.Series, hi: pd.Series, x: pd.Series, t: pd.Series, mu_b: pd.Series, mu_w: pd.Series,
        i_bb: pd.Series, i_ww: pd.Series, i_bw: pd.Series,
    ) -> pd.DataFrame:
        return pd.DataFrame(_rates(grid, lo, hi, x, t, mu_b, mu_w, i_bb, i_ww, i_bw))

    return moments


def _e_step(base: DataFrame, params: DataFrame, keys: Sequence[str], grid: int) -> DataFrame:
    """Precinct moments under the current district parameters.

    A precinct of one group identifies that group's rate only.
    """
    mixed = F.col("lo").isNotNull()
    inputs = ("lo", "hi", "x", "t", "mu_b", "mu_w", "i_bb", "i_ww", "i_bw")
    out = base.join(params, list(keys)).withColumn("_m", _moments(grid)(*inputs))
    one_b, one_w = F.when(F.col("x") == 1, F.col("t")), F.when(F.col("x") == 0, F.col("t"))
    return out.withColumns({
        "e_b": F.when(mixed, F.col("_m.b")).otherwise(one_b),
        "e_w": F.when(mixed, F.col("_m.w")).otherwise(one_w),
        "e_bb": F.when(mixed, F.col("_m.bb")).otherwise(one_b * one_b),
        "e_ww": F.when(mixed, F.col("_m.ww")).otherwise(one_w * one_w),
        "e_bw": F.when(mixed, F.col("_m.bw")),
    }).drop("_m")


def _with_inverse(params: DataFrame) -> DataFrame:
    det = F.col("s_bb") * F.col("s_ww") - F.col("s_bw") * F.col("s_bw")
    return params.withColumns({
        "i_bb": F.col("s_ww") / det, "i_ww": F.col("s_bb") / det, "i_bw": -F.col("s_bw") / det,
    })


STARTS = ["q_b", "q_w", "q_bb", "q_ww", "q_bw"]
PARAMS = ["mu_b", "mu_w", "s_bb", "s_ww", "s_bw"]
#: A leap to a smaller variance is not taken.
LEAST_VARIANCE = 1e-5
#: Districts of so many precincts are fitted inside one task; larger ones by rounds over all tasks.
ONE_TASK = 20_000
ESTIMATES = "ei_minority_dem_share double, ei_majority_dem_share double, ei_minority_sd double, ei_majority_sd double, rounds long, converged boolean"


def _starts(units: DataFrame, keys: list[str], min_precincts: int) -> DataFrame:
    """Start parameters of every district of enough precincts: its regression, or where there is none, its overall share."""
    start = add_regression(district_sums(units, keys, moments=True))
    overall = try_div("total_dem_votes", "total_population")
    begin = start.where(F.col("n_precincts") >= min_precincts).withColumns({
        c: F.coalesce(c, overall) for c in ("er_minority_dem_share", "er_majority_dem_share")})
    return begin.select(
        *keys, "n_precincts",
        clamp("er_minority_dem_share", 0.05, 0.95).alias("mu_b"),
        clamp("er_majority_dem_share", 0.05, 0.95).alias("mu_w"),
        F.lit(0.01).alias("s_bb"), F.lit(0.01).alias("s_ww"), F.lit(0.0).alias("s_bw"),
    )


def _advance(phase: int, start: np.ndarray, now: np.ndarray, new: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The next point of EM after ``now`` was updated to ``new``: phase, start and point.

    Plain EM creeps towards the end. After two plain updates from ``start``, their differences tell the direction and how much each
    shrinks; the point is moved as far as that implies, if its covariance stays possible, and a plain update follows. The fixed point is EM's.
    """
    if phase == 2:
        return 0, start, new
    if phase == 0:
        return 1, now, new
    first = now - start
    change = new - now - first
    if not np.nansum(change * change):
        return 0, start, new
    far = min(-np.sqrt(np.nansum(first * first) / np.nansum(change * change)), -1.0)
    moved = start - 2 * far * first + far * far * change
    s_bb, s_ww, s_bw = moved[2:]
    inside = not (s_bb <= LEAST_VARIANCE or s_ww <= LEAST_VARIANCE) and not abs(s_bw) > MAX_CORRELATION * np.sqrt(s_bb * s_ww)
    return (2, start, moved) if inside else (0, start, new)


def _moved(now: np.ndarray, new: np.ndarray) -> float:
    """The largest change of a parameter that exists."""
    change = np.abs(new - now)
    return float(np.max(change[~np.isnan(change)], initial=0.0))


def _fit_one(keys: list[str], grid: int, ridge: float, tolerance: float, max_rounds: int):
    """EM to convergence for the rows of one district."""

    def mean(v: np.ndarray) -> float:
        known = ~np.isnan(v)
        return v[known].mean() if known.any() else np.nan

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        col = {c: pdf[c].to_numpy(dtype="float64") for c in ("lo", "hi", "x", "t", "n_minority", "n_majority")}
        mixed = ~np.isnan(col["lo"])
        own = {c: col[c][mixed] for c in ("lo", "hi", "x", "t")}
        single = {"b": np.where(col["x"] == 1, col["t"], np.nan), "w": np.where(col["x"] == 0, col["t"], np.nan)}
        single |= {"bb": single["b"] ** 2, "ww": single["w"] ** 2, "bw": np.full(len(pdf), np.nan)}

        def expect(p: np.ndarray) -> dict[str, np.ndarray]:
            det = p[2] * p[3] - p[4] * p[4]
            found = _rates(grid, *own.values(), *(np.full(mixed.sum(), v) for v in (p[0], p[1], p[3] / det, p[2] / det, -p[4] / det)))
            out = {}
            for n, v in single.items():
                out[n] = v.copy()
                out[n][mixed] = found[n]
            return out

        now, rounds, moved = pdf.iloc[0][PARAMS].to_numpy(dtype="float64"), 0, np.inf
        phase, start = 0, now
        while rounds < max_rounds and moved >= tolerance:
            e = expect(now)
            b, w = mean(e["b"]), mean(e["w"])
            s_bb, s_ww = mean(e["bb"]) - b * b + ridge, mean(e["ww"]) - w * w + ridge
            joint = mean(e["bw"]) - mean(e["b"][mixed]) * mean(e["w"][mixed]) if mixed.any() else 0.0
            limit = MAX_CORRELATION * np.sqrt(s_bb * s_ww)
            new = np.array([b, w, s_bb, s_ww, max(min(joint, limit), -limit) if mixed.any() else 0.0])
            moved, rounds = _moved(now, new), rounds + 1
            phase, start, now = _advance(phase, start, now, new) if moved >= tolerance else (0, start, new)
        e, out = expect(now), {k: [pdf[k].iloc[0]] for k in keys}
        for group, size, n in (("minority", "n_minority", "b"), ("majority", "n_majority", "w")):
            known = ~np.isnan(e[n])
            weight, m, square = col[size][known], e[n][known], e[2 * n][known]
            total = weight.sum()
            spread = np.maximum(square - m * m, 0.0)
            out[f"ei_{group}_dem_share"] = [(weight * m).sum() / total if total else None]
            out[f"ei_{group}_sd"] = [np.sqrt((weight * weight * spread).sum()) / total if total else None]
        return pd.DataFrame(out | {"rounds": [rounds], "converged": [bool(moved < tolerance)]})

    return fit


def _fit_in_tasks(base: DataFrame, starts: DataFrame, keys: list[str], grid: int, ridge: float, tolerance: float, max_rounds: int) -> DataFrame:
    # A number of partitions of its own: the shuffled rows are few, the work on them is not.
    rows = base.join(starts.select(*keys, *PARAMS), keys).repartition(slices(base.sparkSession), *keys)
    kinds = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)
    return rows.groupBy(*keys).applyInPandas(_fit_one(keys, grid, ridge, tolerance, max_rounds), f"{kinds}, {ESTIMATES}")


def _m_step(fitted: DataFrame, keys: list[str], ridge: float) -> DataFrame:
    """New parameters n_* of every district, beside those they come from."""
    means = fitted.groupBy(*keys).agg(
        F.avg("e_b").alias("n_b"), F.avg("e_w").alias("n_w"),
        F.avg("e_bb").alias("m_bb"), F.avg("e_ww").alias("m_ww"), F.avg("e_bw").alias("m_bw"),
        F.avg(F.when(F.col("e_bw").isNotNull(), F.col("e_b"))).alias("j_b"),
        F.avg(F.when(F.col("e_bw").isNotNull(), F.col("e_w"))).alias("j_w"),
        *[F.max(p).alias(p) for p in ("phase", *STARTS, *PARAMS)],
    )
    known = means.withColumns({
        "n_bb": F.col("m_bb") - F.col("n_b") * F.col("n_b") + F.lit(float(ridge)),
        "n_ww": F.col("m_ww") - F.col("n_w") * F.col("n_w") + F.lit(float(ridge)),
        "_cov": F.coalesce(F.col("m_bw") - F.col("j_b") * F.col("j_w"), F.lit(0.0)),
    })
    # The covariance comes from mixed precincts only; hold it inside the variances.
    limit = F.lit(MAX_CORRELATION) * F.sqrt(F.col("n_bb") * F.col("n_ww"))
    return known.withColumn("n_bw", F.greatest(F.least(F.col("_cov"), limit), -limit)).drop("_cov")


NEW = ["n_b", "n_w", "n_bb", "n_ww", "n_bw"]


def _next_points(keys: Sequence[str], tolerance: float):
    """``_advance`` for the rows of districts after an M step."""

    def rows(frames):
        for pdf in frames:
            out = []
            values = pdf[[*STARTS, *PARAMS, *NEW]].to_numpy(dtype="float64")
            for key, phase, v in zip(pdf[list(keys)].itertuples(index=False), pdf["phase"], values, strict=True):
                start, now, new = v[:5], v[5:10], v[10:]
                moved = _moved(now, new)
                phase, start, now = _advance(int(phase), start, now, new) if moved >= tolerance else (0, start, new)
                out.append([*key, phase, *start, *now, moved])
            yield pd.DataFrame(out, columns=[*keys, "phase", *STARTS, *PARAMS, "moved"])

    return rows


def _fit_by_rounds(base: DataFrame, starts: DataFrame, keys: list[str], grid: int, ridge: float, tolerance: float, max_rounds: int,
                   scratch: Scratch) -> DataFrame:
    """EM over all tasks, one sum a round. A district below the tolerance leaves the rounds; when half have left, their rows are left behind too."""
    every, held = base, starts.count()
    active = starts.select(*keys, F.lit(0).alias("phase"), *[F.col(p).alias(q) for p, q in zip(PARAMS, STARTS, strict=True)], *PARAMS)
    kinds = ", ".join(f"`{k}` {t}" for k, t in starts.select(*keys).dtypes)
    schema = ", ".join([kinds, "phase int", *[f"{c} double" for c in (*STARTS, *PARAMS)], "moved double"])
    rounds, left, done, last = 0, held, [], None
    while left:
        rounds += 1
        updated = _m_step(_e_step(base, _with_inverse(active), keys, grid), keys, ridge)
        new = scratch.write(updated.mapInPandas(_next_points(keys, tolerance), schema), f"params{rounds}")
        rest = F.col("moved") < tolerance
        settled = rest if rounds < max_rounds else F.lit(True)
        found = new.where(settled).count()
        if last:  # the round before settled nothing, so nothing reads its table any more
            scratch.drop(last)
        last = None if found else f"params{rounds}"
        if found:
            done.append(new.where(settled).select(*keys, *PARAMS, F.lit(rounds).cast("long").alias("rounds"), rest.alias("converged")))
        active, left = new.where(~settled).drop("moved"), left - found
        if 0 < left <= held // 2:
            base, held = scratch.write(base.join(active.select(*keys), keys, "left_semi"), f"rows{rounds}"), left
    final = done[0]
    for part in done[1:]:
        final = final.unionByName(part)
    estimates = _district_estimates(_e_step(every, _with_inverse(final.select(*keys, *PARAMS)), keys, grid), keys)
    return estimates.join(final.select(*keys, "rounds", "converged"), keys)


def grid_inference(
    units: DataFrame, keys: Sequence[str] = DISTRICT, grid: int = 20, ridge: float = 1e-4, min_precincts: int = 3,
    tolerance: float = 1e-8, max_rounds: int = 500, one_task: int = ONE_TASK,
) -> DataFrame:
    """District rates under a normal prior on the precinct rates, fitted by EM on a grid until no update moves a parameter by ``tolerance``.

    Every precinct's pair of rates lies on the line that its totals fix; the weight of a point on that line is the district's bivariate normal
    density. Truncation of the normal to the unit square is ignored, so this approximates the posterior of the sampling model and does
    not reproduce its draws. Every district of ``min_precincts`` rows or more is estimated, and every precinct of it counts, however far it lies
    from the others. EM starts from the district's regression, or where there is none, from its overall share. A group
    that lives in no precinct of the district has NULL rates.

    EM's updates are sped up (``_advance``), which leaves its fixed point. ``rounds`` tells how many updates a district took, ``converged`` whether it came to rest within ``max_rounds``. A district
    of at most ``one_task`` precincts takes all its rounds inside one task, so the plan rows are shuffled once; a larger one is summed over all tasks, round by
    round, and leaves them when it has come to rest. Both do the same arithmetic.
    """
    keys, scratch = list(keys), Scratch(units.sparkSession, "inference")
    starts = scratch.write(_starts(units, keys, min_precincts), "starts")
    rows = units.select(*keys, "precinct_id", "n_minority", "n_majority", "population", "dem_votes")
    small = F.col("n_precincts") <= one_task
    settings = (keys, grid, ridge, tolerance, max_rounds)
    columns = ["ei_minority_dem_share", "ei_majority_dem_share", "ei_minority_sd", "ei_majority_sd", "rounds", "converged"]
    light = bounds(rows.drop("precinct_id")).drop("population", "dem_votes")
    out = _fit_in_tasks(light, starts.where(small), *settings).select(*keys, *columns)
    large = starts.where(~small)
    if not large.isEmpty():
        # Every round reads these rows: spread them evenly once, by precinct.
        spread = rows.join(large.select(*keys), keys, "left_semi").repartition(slices(units.sparkSession), "precinct_id").drop("precinct_id")
        base = scratch.write(bounds(spread).drop("population", "dem_votes"), "rows0")
        out = out.unionByName(_fit_by_rounds(base, large, *settings, scratch).select(*keys, *columns))
    return out.withColumn("ei_rpv", rpv_flag("ei_minority_dem_share", "ei_majority_dem_share"))


def inference_on_grid(units: DataFrame, keys: Sequence[str] = DISTRICT, **settings) -> DataFrame:
    """``grid_inference`` with truth, residuals and the district's group and vote shares."""
    truth = district_sums(units, keys).withColumns(truth_columns())
    return with_truth(grid_inference(units, keys, **settings), truth, keys)


def _district_estimates(fitted: DataFrame, keys: list[str]) -> DataFrame:
    n_b, n_w = F.col("n_minority"), F.col("n_majority")

    def mean(n, e):
        return try_div(F.sum(n * F.col(e)), F.sum(F.when(F.col(e).isNotNull(), n)))

    def sd(n, e, e2):
        spread = F.greatest(F.col(e2) - F.col(e) * F.col(e), F.lit(0.0))
        return try_div(F.sqrt(F.sum(n * n * spread)), F.sum(F.when(F.col(e).isNotNull(), n)))

    return fitted.groupBy(*keys).agg(
        mean(n_b, "e_b").alias("ei_minority_dem_share"), mean(n_w, "e_w").alias("ei_majority_dem_share"),
        sd(n_b, "e_b", "e_bb").alias("ei_minority_sd"), sd(n_w, "e_w", "e_ww").alias("ei_majority_sd"),
    )
