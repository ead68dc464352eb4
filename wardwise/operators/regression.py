"""Ecological regression of vote share on group shares, for all districts at once.

Weighted least squares with two regressors and no intercept has a closed form in
six sums, so the estimates of every district of every plan come out of the same
aggregation as the true totals: one shuffle, no loop, and no second pass over the
plan rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwise.operators.frames import district_sums, truth_columns
from wardwise.operators.rpv import residual_columns, rpv_flag
from wardwise.schemas import DISTRICT

MIN_PRECINCTS = 3
COLLINEAR = 1e-14


def estimate_columns() -> tuple[dict[str, Column], dict[str, Column], Column]:
    """(slopes, standard errors and flag, rule for an estimable district)."""
    a11, a12, a22 = F.col("_a11"), F.col("_a12"), F.col("_a22")
    det = a11 * a22 - a12 * a12
    g1 = F.try_divide(a22 * F.col("_b1") - a12 * F.col("_b2"), det)
    g2 = F.try_divide(a11 * F.col("_b2") - a12 * F.col("_b1"), det)
    rss = F.greatest(F.col("_yy") - g1 * F.col("_b1") - g2 * F.col("_b2"), F.lit(0.0))
    sigma2 = F.try_divide(rss, (F.col("_n") - 2).cast("double"))
    slopes = {"er_minority_dem_share": g1 + 0.5, "er_majority_dem_share": g2 + 0.5}
    rest = {
        "er_minority_se": F.sqrt(sigma2 * F.try_divide(a22, det)),
        "er_majority_se": F.sqrt(sigma2 * F.try_divide(a11, det)),
        "er_rpv": rpv_flag("er_minority_dem_share", "er_majority_dem_share"),
    }
    usable = (F.col("n_precincts") >= MIN_PRECINCTS) & (det > COLLINEAR * a11 * a22)
    return slopes, rest, usable


def add_regression(sums: DataFrame) -> DataFrame:
    """Estimates beside the totals; districts without an estimate keep NULLs."""
    slopes, rest, usable = estimate_columns()
    out = sums.withColumns({c: F.when(usable, e) for c, e in slopes.items()})
    out = out.withColumns({c: F.when(usable, e) for c, e in rest.items()})
    return out.drop("_n", "_a11", "_a12", "_a22", "_b1", "_b2", "_yy")


def ecological_regression(units: DataFrame, keys: Sequence[str] = DISTRICT) -> DataFrame:
    """Estimates, standard errors, flag, truth and residuals per estimable district."""
    sums = add_regression(district_sums(units, keys, moments=True))
    found = sums.where(F.col("er_minority_dem_share").isNotNull()).withColumns(truth_columns())
    return found.withColumns(residual_columns("er")).select(
        *keys, "er_minority_dem_share", "er_majority_dem_share", "er_minority_se", "er_majority_se", "er_rpv",
        "true_minority_dem_share", "true_majority_dem_share", "true_rpv",
        "er_minority_resid", "er_majority_resid", "er_rpv_error", "n_precincts", "total_population",
    )


def fit_by_group(df: DataFrame, keys: Sequence[str], fn: Callable, schema: str) -> DataFrame:
    """A user's own estimator, ``pandas frame -> pandas frame``, once per group.

    A group is handed over whole, so the keys must bound its size, as one district
    of one plan does. The built-in estimators do not use this.
    """
    return df.groupBy(*keys).applyInPandas(fn, schema)
