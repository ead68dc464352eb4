"""Binned summaries: accuracy, errors, histograms, shares of a class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwise.functions import cut, cut_index, strict_avg, try_div
from wardwise.operators.ordered import exact_quantiles, share_of_group
from wardwise.operators.report import stack_estimators
from wardwise.schemas import SCENARIO

# Five-point bins with an open last bin, and twentieths of the unit interval, by rule.
FIVE_TO_75 = [float(b) for b in range(0, 76, 5)] + [float("inf")]
FIVE_TO_75_LABELS = [f"{b}-{b + 5}" for b in range(0, 75, 5)] + ["75+"]
FIVE_TO_100 = [float(b) for b in range(0, 101, 5)] + [float("inf")]
FIVE_TO_100_LABELS = [f"{b}-{b + 5}" for b in range(0, 100, 5)] + ["100+"]
# Ten-point margin bins, open at both ends, by rule; fixed labels: distance from a tie, and the winner.
TEN_POINTS = [float("-inf"), *[float(b) for b in range(-50, 51, 10)], float("inf")]
TEN_POINTS_LABELS = ["50+ (R)", *[f"{b}-{b + 10} (R)" for b in range(40, -1, -10)], *[f"{b}-{b + 10} (D)" for b in range(0, 50, 10)], "50+ (D)"]
TWENTIETHS = [i * 0.05 for i in range(21)]
MIDPOINTS = [0.025 + i * 0.05 for i in range(20)]


def five_point_bin(percent, top: int = 75) -> Column:
    """Five-point bin of a percentage, closed on the left, with an open last bin."""
    breaks, labels = (FIVE_TO_75, FIVE_TO_75_LABELS) if top == 75 else (FIVE_TO_100, FIVE_TO_100_LABELS)
    return cut(percent, breaks, labels, right=False)


def accuracy_by_bin(df: DataFrame, flags: dict[str, str], percent: Column, top: int = 75,
                    keys: Sequence[str] = SCENARIO) -> DataFrame:
    """Percent correct and count by five-point bin and model; ``flags`` maps a column to a model name."""
    return accuracy_by_class(df, flags, five_point_bin(percent, top), keys)


def accuracy_by_margin(df: DataFrame, flags: dict[str, str], share: str, keys: Sequence[str] = SCENARIO) -> DataFrame:
    """Percent correct and count by ten-point bin, closed on the left, of the Democratic margin that a vote share gives."""
    points = (F.col(share) - (F.lit(1.0) - F.col(share))) * 100
    return accuracy_by_class(df, flags, cut(points, TEN_POINTS, TEN_POINTS_LABELS, right=False), keys)


def accuracy_by_class(df: DataFrame, flags: dict[str, str], bin_column: Column, keys: Sequence[str] = SCENARIO) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("correct")) for c, m in flags.items()])
    rows = df.select(*keys, bin_column.alias("bin"), F.inline(parts)).where(F.col("bin").isNotNull())
    return rows.groupBy(*keys, "bin", "model").agg(
        (strict_avg(F.col("correct").cast("double")) * 100).alias("pct_correct"), F.count(F.lit(1)).alias("n_obs"))


def error_by_bin(results: DataFrame, percent: Column, keys: Sequence[str] = SCENARIO) -> DataFrame:
    """Root mean square error and bias, in points, by bin, model and group."""
    rows = stack_estimators(results.withColumn("bin", five_point_bin(percent, 100)), [*keys, "bin"])
    long = rows.where(F.col("bin").isNotNull()).select(*keys, "bin", F.col("method").alias("model"), F.inline(F.array(*[
        F.struct(F.lit(g).alias("group"), (F.col(f"resid_{g}") * 100).alias("error")) for g in ("minority", "majority")
    ])))
    e = F.col("error")
    return long.groupBy(*keys, "bin", "model", "group").agg(
        F.sqrt(strict_avg(e * e)).alias("rmse"), strict_avg(e).alias("bias"), F.count(F.lit(1)).alias("n_obs"))


def absolute_errors(results: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per district, model and group with its absolute error."""
    rows = stack_estimators(results, keep)
    return rows.select(*keep, F.col("method").alias("model"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("group"), F.abs(F.col(f"resid_{g}")).alias("abs_error"))
        for g, n in (("minority", "Minority"), ("majority", "Majority"))
    ])))


def error_quantiles_by_bin(results: DataFrame) -> DataFrame:
    """Median, mean and upper quantiles of absolute error by minority-share bin."""
    keys = ["bin", "group", *SCENARIO]
    rows = absolute_errors(results, [*SCENARIO, "prop_minority"]).withColumn(
        "bin", cut_index("prop_minority", TWENTIETHS)).where(F.col("bin").isNotNull())
    means = rows.groupBy(*keys).agg(
        F.avg("abs_error").alias("mean_error"), F.avg("prop_minority").alias("prop_minority"))
    probs = {"median_error": 0.5, "q25": 0.25, "q75": 0.75, "q90": 0.9}
    return means.join(exact_quantiles(rows, "abs_error", probs, keys), keys)


def histogram(df: DataFrame, bin_column: Column, keys: Sequence[str] = SCENARIO, scale: float = 30.0) -> DataFrame:
    """Count by bin, scaled to the largest bin of its group and to the largest of all."""
    counts = df.select(*keys, bin_column.alias("bin")).where(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"))
    local = share_of_group(counts, "n", keys, "n_scaled", how="max", scale=scale)
    return share_of_group(local, "n", [], "n_scaled_all", how="max", scale=scale)


def class_shares(df: DataFrame, cls: Column, value: Column | None = None, keys: Sequence[str] = SCENARIO) -> DataFrame:
    """Percent of each class within its scenario, by rows or by a summed value."""
    size = F.count(F.lit(1)) if value is None else F.sum(value)
    totals = df.groupBy(*keys, cls.alias("class")).agg(size.alias("n"))
    return share_of_group(totals, "n", keys, "pct", scale=100.0)


def copartisan_by_bin(results: DataFrame, group: str, keys: Sequence[str] = SCENARIO) -> DataFrame:
    """Mean co-partisan representation with standard error by the district's group share."""
    from wardwise.operators.waste import copartisan_columns

    share = try_div(f"total_{group}", "total_population")
    rows = results.withColumns(copartisan_columns(group)).withColumn(
        "bin", cut_index(share, TWENTIETHS, include_lowest=True)).where(F.col("bin").isNotNull())
    frac = f"frac_{group}_copartisan"
    return rows.groupBy(*keys, "bin").agg(
        F.avg(frac).alias("mean_copartisan"),
        (F.stddev_samp(frac) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("se_copartisan"),
        F.count(F.lit(1)).alias("n_obs"),
    ).withColumn("share", F.element_at(F.array(*[F.lit(m) for m in MIDPOINTS]), F.col("bin")))


def mismatch_errors(rows: DataFrame, min_rows: int = 10, keys: Sequence[str] = SCENARIO) -> DataFrame:
    """Mean errors by the gap between precinct and district composition."""
    gap = F.abs(F.col("prop_minority_precinct") - F.col("prop_minority"))
    kept = rows.where(F.col("er_minority_error_precinct").isNotNull() & F.col("prop_minority").isNotNull())
    binned = kept.withColumn("bin", cut_index(gap, TWENTIETHS, include_lowest=True))
    n = F.sqrt(F.count(F.lit(1)).cast("double"))
    out = binned.groupBy(*keys, "bin").agg(
        *[F.avg(f"{m}_{g}_error_precinct").alias(f"mean_{m}_{g}_error")
          for m in ("er", "ei") for g in ("minority", "majority")],
        *[(F.stddev_samp(f"{m}_minority_error_precinct") / n).alias(f"se_{m}_minority") for m in ("er", "ei")],
        F.count(F.lit(1)).alias("n_precincts"),
    )
    return out.where(F.col("n_precincts") >= min_rows)


def size_errors(rows: DataFrame, keys: Sequence[str] = SCENARIO) -> DataFrame:
    """Mean error by population quintile of all precinct rows, per model.

    The five breaks are quantiles of the data; they come back as one row and bin the
    rows as constants.
    """
    kept = rows.where(F.col("er_minority_error_precinct").isNotNull()).withColumn(
        "log_population", F.log10((F.col("population") + 1).cast("double")))
    breaks = exact_quantiles(kept, "log_population", {f"b{i}": i / 5 for i in range(6)}).first()
    binned = kept.withColumn("quintile", cut_index("log_population", list(breaks), include_lowest=True))
    parts = F.array(*[F.struct(F.lit(m.upper()).alias("model"), F.col(f"{m}_minority_error_precinct").alias("e"))
                      for m in ("er", "ei")])
    long = binned.select(*keys, "quintile", F.inline(parts))
    return long.groupBy(*keys, "quintile", "model").agg(
        F.avg("e").alias("mean_error"), F.count(F.lit(1)).alias("n"))


def square_bins(df: DataFrame, x: str, y: str, width: float, keys: Sequence[str]) -> DataFrame:
    """Counts on a square grid of the plane."""
    cell = lambda c: F.floor(F.col(c) / F.lit(float(width))).cast("bigint")
    return df.groupBy(*keys, cell(x).alias("x_bin"), cell(y).alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))


def line_bins(df: DataFrame, x, width: float, keys: Sequence[str]) -> DataFrame:
    """Counts on equal intervals of a line."""
    x = F.col(x) if isinstance(x, str) else x
    return df.groupBy(*keys, F.floor(x / F.lit(float(width))).cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
