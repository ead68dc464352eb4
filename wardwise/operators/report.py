"""Tables over district and precinct results: errors, intervals, seats, waste, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwise.functions import indicator, strict_avg, strict_sum, try_div
from wardwise.operators.ordered import exact_quantiles
from wardwise.operators.waste import copartisan_columns, margin_columns
from wardwise.schemas import PLAN, SCENARIO

METRICS = ["mae_minority", "mae_majority", "rpv_accuracy", "bias_minority", "bias_majority"]


def _pct(flag: Column) -> Column:
    """Strict percentage of rows on which a flag holds."""
    return strict_avg(flag.cast("int").cast("double")) * 100


def stack_estimators(df: DataFrame, keep: Sequence[str], models: Sequence[str] = ("er", "ei")) -> DataFrame:
    """One row per district and method under common estimate names, in one scan."""
    parts = [
        F.struct(
            F.lit(m.upper()).alias("method"),
            *[F.col(f"{m}_{g}_dem_share").alias(f"estimate_{g}") for g in ("minority", "majority")],
            *[F.col(f"{m}_{g}_resid").alias(f"resid_{g}") for g in ("minority", "majority")],
            F.col(f"{m}_rpv").alias("rpv"), F.col(f"{m}_rpv_correct").alias("rpv_correct"),
        )
        for m in models
    ]
    return df.select(*keep, F.inline(F.array(*parts)))


def plan_errors(results: DataFrame, keys: Sequence[str] = PLAN) -> DataFrame:
    """Mean absolute error, bias and strict accuracy per plan and method; NULLs skipped."""
    return stack_estimators(results, keys).groupBy(*keys, "method").agg(
        F.avg(F.abs("resid_minority")).alias("mae_minority"),
        F.avg(F.abs("resid_majority")).alias("mae_majority"),
        F.avg("rpv_correct").alias("rpv_accuracy"),
        F.avg("resid_minority").alias("bias_minority"),
        F.avg("resid_majority").alias("bias_majority"),
    )


def metric_intervals(errors: DataFrame, level: float = 0.95) -> DataFrame:
    """Mean and percentile interval over plans of each metric, in tidy form."""
    keys = [*SCENARIO, "method", "metric"]
    tidy = errors.unpivot([*PLAN, "method"], METRICS, "metric", "value")
    tail = (1 - level) / 2
    means = tidy.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_maps"), strict_avg("value").alias("mean_value"))
    bounds = exact_quantiles(tidy, "value", {"lower_ci": tail, "upper_ci": 1 - tail}, keys)
    return means.join(bounds, keys)


def wide_intervals(intervals: DataFrame) -> DataFrame:
    """One row per scenario and method with mean, lower and upper of every metric."""
    return intervals.groupBy(*SCENARIO, "method", "n_maps").pivot("metric", METRICS).agg(
        F.max("mean_value").alias("mean"), F.max("lower_ci").alias("lower"), F.max("upper_ci").alias("upper")
    )


def error_table(results: DataFrame, keys: Sequence[str] = SCENARIO) -> DataFrame:
    """Errors per scenario and method in points; one missing value empties a cell."""
    truth = ["true_minority_dem_share", "true_majority_dem_share", "true_rpv"]
    rows = stack_estimators(results, [*keys, *truth])
    t1, t0 = F.col(truth[0]), F.col(truth[1])
    e1, e0 = F.col("estimate_minority"), F.col("estimate_majority")
    r1, r0 = F.col("resid_minority") * 100, F.col("resid_majority") * 100
    return rows.groupBy(*keys, "method").agg(
        F.sqrt(strict_avg(r1 * r1)).alias("rmse_min"), F.sqrt(strict_avg(r0 * r0)).alias("rmse_maj"),
        strict_avg(r1).alias("bias_min"), strict_avg(r0).alias("bias_maj"),
        strict_avg(F.abs(r1)).alias("mae_min"), strict_avg(F.abs(r0)).alias("mae_maj"),
        (strict_avg(t1 - t0) * 100).alias("true_spread"), (strict_avg(e1 - e0) * 100).alias("est_spread"),
        (strict_avg(F.col("true_rpv").cast("double")) * 100).alias("true_rpv"),
        (strict_avg(F.col("rpv_correct").cast("double")) * 100).alias("pct_correct_rpv"),
        _pct(e1 < t1).alias("pct_under"),
        _pct(F.signum(t0 - t1) != F.signum(e0 - e1)).alias("pct_sign_flips"),
    ).withColumn("bias_spread", F.col("est_spread") - F.col("true_spread"))


def precinct_error_table(rows: DataFrame, keys: Sequence[str] = SCENARIO) -> DataFrame:
    """The same at precinct grain, over precincts with minority support; NULLs skipped."""
    t1, t0 = F.col("true_minority_dem_share_precinct"), F.col("true_majority_dem_share_precinct")
    long = rows.where(t1 > 0).select(*keys, t1, t0, "true_rpv_precinct", F.inline(F.array(*[
        F.struct(
            F.lit(m.upper()).alias("method"),
            F.col(f"{m}_pred_minority_share_precinct").alias("e1"),
            F.col(f"{m}_pred_majority_share_precinct").alias("e0"),
            F.col(f"{m}_rpv_correct_precinct").alias("agrees"),
        ) for m in ("er", "ei")
    ])))
    e1, e0 = F.col("e1"), F.col("e0")
    r1, r0 = (e1 - t1) * 100, (e0 - t0) * 100
    pct = lambda flag: F.avg(flag.cast("int")) * 100
    return long.groupBy(*keys, "method").agg(
        F.sqrt(F.avg(r1 * r1)).alias("rmse_min"), F.sqrt(F.avg(r0 * r0)).alias("rmse_maj"),
        F.avg(r1).alias("bias_min"), F.avg(r0).alias("bias_maj"),
        F.avg(F.abs(r1)).alias("mae_min"), F.avg(F.abs(r0)).alias("mae_maj"),
        (F.avg("true_rpv_precinct") * 100).alias("true_rpv"), (F.avg("agrees") * 100).alias("pct_correct_rpv"),
        pct(e1 < t1).alias("pct_under"),
        pct(F.signum(t0 - t1) != F.signum(e0 - e1)).alias("pct_sign_flips"),
    )


def competitiveness(results: DataFrame, keys: Sequence[str] = SCENARIO) -> DataFrame:
    rows = results.withColumns(margin_columns())
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_districts"),
        _pct(F.col("is_competitive")).alias("pct_competitive"),
        F.avg("dem_win_margin").alias("avg_margin"),
        (F.stddev_samp("dem_win_margin") * 100).alias("margin_sd"),
        _pct(F.col("is_safe_dem")).alias("pct_safe_dem"),
        _pct(F.col("is_safe_rep")).alias("pct_safe_rep"),
    )


def seats_by_scenario(results: DataFrame, keys: Sequence[str] = SCENARIO) -> DataFrame:
    """Seats per plan, then their average and range per scenario."""
    per_plan = results.groupBy("map_id", *keys).agg(
        F.sum(indicator(F.col("total_dem_votes") > F.col("total_rep_votes"))).alias("seats"),
        F.sum(indicator(try_div("total_minority", "total_population") > 0.5)).alias("maj_min"),
    )
    return per_plan.groupBy(*keys).agg(
        F.avg("seats").alias("avg_dem_seats"), F.avg("maj_min").alias("avg_maj_min"),
        F.min("seats").alias("min_dem_seats"), F.max("seats").alias("max_dem_seats"),
    )


def waste_disparity(results: DataFrame, keys: Sequence[str] = SCENARIO) -> DataFrame:
    """Waste rates of both groups: ratio of sums, and mean of district ratios."""
    rate = lambda g: try_div(F.sum(f"{g}_wasted_total"), F.sum(f"total_{g}")) * 100
    mean = lambda g: F.avg(try_div(f"{g}_wasted_total", f"total_{g}") * 100)
    return results.groupBy(*keys).agg(
        rate("minority").alias("minority_waste_rate"), rate("majority").alias("majority_waste_rate"),
        mean("minority").alias("mean_minority_waste_rate"), mean("majority").alias("mean_majority_waste_rate"),
    ).withColumn("pop_weighted_waste_disparity", F.col("minority_waste_rate") - F.col("majority_waste_rate"))


def mean_waste_by_plan(results: DataFrame) -> DataFrame:
    """Mean district disparity per plan, carrying the plan's seat count."""
    return results.groupBy(*PLAN).agg(
        F.avg("waste_disparity").alias("mean_waste_disparity"), F.max("n_dem_seats").alias("n_dem_seats")
    )


def group_probabilities(results: DataFrame, keys: Sequence[str] = SCENARIO) -> DataFrame:
    """Chance of a co-partisan seat, a competitive district and a wasted vote, by group."""
    rows = results.withColumns({**margin_columns(), **copartisan_columns("minority"), **copartisan_columns("majority")})
    near = indicator(F.col("is_competitive"))
    aggs = []
    for g in ("minority", "majority"):
        size = strict_sum(F.col(f"total_{g}"))
        for name, part in (
            ("copartisan", F.col(f"{g}_copartisan")), ("competitive", F.col(f"total_{g}") * near),
            ("wasted", F.col(f"{g}_wasted_total")),
        ):
            aggs.append((try_div(strict_sum(part), size) * 100).alias(f"pr_{g}_{name}"))
    return rows.groupBy(*keys).agg(*aggs)


def minority_distribution(results: DataFrame, keys: Sequence[str] = SCENARIO) -> DataFrame:
    """How minority population splits over majority-minority and other districts."""
    share = try_div("total_minority", "total_population")
    big = share > 0.5
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_districts"),
        F.sum(indicator(big)).alias("n_maj_min"), (F.avg(indicator(big)) * 100).alias("pct_maj_min"),
        F.coalesce(F.sum(F.when(big, F.col("total_minority"))), F.lit(0)).alias("minorities_in_maj_min"),
        F.coalesce(F.sum(F.when(~big, F.col("total_minority"))), F.lit(0)).alias("minorities_in_other"),
        F.avg(F.when(big, share)).alias("avg_min_pct_in_maj_min"),
        F.avg(F.when(~big, share)).alias("avg_min_pct_in_other"),
    ).withColumn("pct_minorities_in_maj_min", try_div(
        "minorities_in_maj_min", F.col("minorities_in_maj_min") + F.col("minorities_in_other")) * 100)


def waste_by_district_class(results: DataFrame, keys: Sequence[str] = SCENARIO) -> DataFrame:
    """Packed and cracked votes, waste rates and packed share by majority-minority class."""
    rows = results.withColumn("is_majority_minority", try_div("total_minority", "total_population") > 0.5)
    out = rows.groupBy(*keys, "is_majority_minority").agg(
        F.count(F.lit(1)).alias("n_districts"),
        F.sum("total_minority").alias("total_minority_pop"), F.sum("total_majority").alias("total_majority_pop"),
        F.sum("packed_min_votes").alias("minority_packed"), F.sum("cracked_min_votes").alias("minority_cracked"),
        F.sum(F.col("packed_votes") - F.col("packed_min_votes")).alias("majority_packed"),
        F.sum(F.col("cracked_votes") - F.col("cracked_min_votes")).alias("majority_cracked"),
    )
    lost = lambda g: F.col(f"{g}_packed") + F.col(f"{g}_cracked")
    return out.withColumns({
        "minority_waste_rate": try_div(lost("minority"), "total_minority_pop"),
        "majority_waste_rate": try_div(lost("majority"), "total_majority_pop"),
        "minority_pct_packed": try_div("minority_packed", lost("minority")),
    })


def null_audit(df: DataFrame, columns: Sequence[str], distinct: dict[str, Sequence[str]]) -> DataFrame:
    """NULL count per column and distinct counts of keys, in one row."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(indicator(F.col(c).isNull())).alias(f"null_{c}") for c in columns],
        *[F.countDistinct(*cols).alias(f"n_{name}") for name, cols in distinct.items()],
    )


def totals_across(units: DataFrame, levels: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Totals per level, and whether each level has the same totals as all others."""
    totals = units.groupBy(*levels).agg(*[F.sum(c).alias(c) for c in columns])
    same = totals.agg(F.count_distinct(F.struct(*columns)).alias("n")).scalar()
    return totals.withColumn("consistent", same == 1)


def context_gap(results: DataFrame, precincts: DataFrame, statewide: float | None = None) -> DataFrame:
    """District majority share minus the statewide share, in points."""
    state = F.lit(float(statewide)) if statewide is not None else precincts.agg(
        try_div(F.sum("n_majority"), F.sum("population")).alias("s")).scalar()
    return results.withColumn("white_pop_diff", (try_div("total_majority", "total_population") - state) * 100)


def seat_statistics(maps: DataFrame, keys: Sequence[str] = SCENARIO) -> DataFrame:
    """Mean, deviation and range of seats over plans, with majority-minority districts."""
    return maps.groupBy(*keys).agg(
        F.avg("n_dem_districts").alias("mean_dem_seats"), F.stddev_samp("n_dem_districts").alias("sd_dem_seats"),
        F.min("n_dem_districts").alias("min_dem_seats"), F.max("n_dem_districts").alias("max_dem_seats"),
        F.avg("n_maj_min_districts").alias("mean_minority_districts"),
    )


def seat_difference(maps: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """Mean seats under low minus high segregation, with a verdict."""
    wide = maps.agg(
        F.avg(F.when(F.col("seg_level") == low, F.col("n_dem_districts"))).alias("low_seats"),
        F.avg(F.when(F.col("seg_level") == high, F.col("n_dem_districts"))).alias("high_seats"),
    ).withColumn("difference", F.col("low_seats") - F.col("high_seats"))
    return wide.withColumn("verdict", F.when(F.col("difference") > 0, "supports").when(
        F.col("difference") <= 0, "contradicts"))


def confusion_shares(results: DataFrame, keys: Sequence[str] = SCENARIO) -> DataFrame:
    """Shares of true and false positives and negatives of the flag, per method."""
    t, e = F.col("true_rpv"), F.col("rpv")
    share = lambda tv, ev: strict_avg(((t == tv) & (e == ev)).cast("int").cast("double"))
    return stack_estimators(results, [*keys, "true_rpv"]).groupBy(*keys, "method").agg(
        share(1, 1).alias("true_pos"), share(0, 1).alias("false_pos"),
        share(0, 0).alias("true_neg"), share(1, 0).alias("false_neg"),
    )


def mean_and_error(df: DataFrame, value: str, keys: Sequence[str], z: float = 1.96) -> DataFrame:
    """Mean, standard error and normal interval per group."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("se"),
        F.count(F.lit(1)).alias("n"),
    ).withColumns({
        "ci_lo": F.col("mean") - F.lit(z) * F.col("se"), "ci_hi": F.col("mean") + F.lit(z) * F.col("se"),
    })


def group_efficiency(results: DataFrame, group: str) -> DataFrame:
    """Group efficiency gap and wasted share per plan; positive when more Republican votes are lost."""
    out = results.groupBy(*PLAN).agg(
        F.sum(F.col(f"{group}_dem_wasted_surplus") + F.col(f"{group}_dem_wasted_losing")).alias("dem_wasted"),
        F.sum(F.col(f"{group}_rep_wasted_surplus") + F.col(f"{group}_rep_wasted_losing")).alias("rep_wasted"),
        F.sum(f"{group}_wasted_total").alias("total_wasted"), F.sum(f"total_{group}").alias("total_votes"),
    )
    return out.withColumns({
        "efficiency_gap": try_div(F.col("rep_wasted") - F.col("dem_wasted"), "total_votes"),
        "prop_wasted": try_div("total_wasted", "total_votes"),
    })


def racial_inefficiency(results: DataFrame) -> DataFrame:
    """Minority minus majority wasted votes over all votes, per plan."""
    out = results.groupBy(*PLAN).agg(
        *[F.sum(f"{g}_wasted_total").alias(f"total_{g}_wasted") for g in ("minority", "majority")],
        *[F.sum(f"total_{g}").alias(f"total_{g}_votes") for g in ("minority", "majority")],
    )
    votes = F.col("total_minority_votes") + F.col("total_majority_votes")
    return out.withColumns({
        "racial_inefficiency_disparity": try_div(
            F.col("total_minority_wasted") - F.col("total_majority_wasted"), votes),
        "prop_minority_wasted": try_div("total_minority_wasted", "total_minority_votes"),
        "prop_majority_wasted": try_div("total_majority_wasted", "total_majority_votes"),
    })


def copartisan_by_plan(results: DataFrame, group: str = "minority") -> DataFrame:
    """Share of a group with a co-partisan representative per plan, by party and in all."""
    rows = results.withColumns(copartisan_columns(group))
    size = F.sum(f"total_{group}")
    return rows.groupBy(*PLAN).agg(*[
        try_div(F.sum(f"{group}_{part}"), size).alias(f"frac_{group}_{part}")
        for part in ("dem_copartisan", "rep_copartisan", "copartisan")
    ])


def copartisan_by_scenario(results: DataFrame, group: str = "minority") -> DataFrame:
    frac = f"frac_{group}_"
    return copartisan_by_plan(results, group).groupBy(*SCENARIO).agg(
        *[F.avg(frac + p).alias(f"mean_{frac}{p}") for p in ("dem_copartisan", "rep_copartisan", "copartisan")],
        F.stddev_samp(frac + "copartisan").alias(f"sd_{frac}copartisan"),
        F.count(F.lit(1)).alias("n_maps"),
    )


def copartisan_crosstab(results: DataFrame, group: str = "minority") -> DataFrame:
    """Percent of the group represented by its own party: segregation by gerrymander."""
    rows = results.withColumns(copartisan_columns(group)).groupBy(*SCENARIO).agg(
        (try_div(F.sum(f"{group}_copartisan"), F.sum(f"total_{group}")) * 100).alias("pct"))
    return scenario_crosstab(rows, "pct")


def scenario_crosstab(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("seg_level").pivot("redist_level", ["dem", "middle", "rep"]).agg(F.max(value))


def representation_rate(results: DataFrame, keys: Sequence[str] = SCENARIO) -> DataFrame:
    """Share of each minority party bloc whose own party holds the seat."""
    dem, size = F.col("true_minority_dem_votes"), F.col("total_minority")
    rep, dem_won = size - dem, F.col("total_dem_votes") > F.col("total_rep_votes")
    won = F.coalesce(F.sum(F.when(dem_won, dem)), F.lit(0)), F.coalesce(F.sum(F.when(~dem_won, rep)), F.lit(0))
    return results.groupBy(*keys).agg(
        try_div(won[0], F.sum(dem)).alias("minority_dem_copartisan"),
        try_div(won[1], F.sum(rep)).alias("minority_rep_copartisan"),
        try_div(won[0] + won[1], F.sum(size)).alias("minority_overall_copartisan"),
    )


def weighted_mean(df: DataFrame, value: str, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(weight).alias("total_weight"),
        try_div(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("weighted_mean"),
    )


def population_diagnostics(precincts: DataFrame, num_districts: int, epsilon: float) -> DataFrame:
    """Whether balanced districts are possible: ideal size, allowed range, unit sizes."""
    total = precincts.agg(F.sum("population").alias("t")).scalar()
    ideal = try_div(total, num_districts)
    middle = exact_quantiles(precincts, "population", {"median": 0.5}).select("median")
    sized = precincts.select("population", ideal.alias("ideal"))
    hi = F.col("ideal") * F.lit(1 + epsilon)
    out = sized.groupBy("ideal").agg(
        F.sum("population").alias("total_pop"), F.count(F.lit(1)).alias("n_precincts"),
        F.min("population").alias("min_pop"), F.max("population").alias("max_pop"),
        F.avg("population").alias("mean_pop"),
        F.sum(indicator(F.col("population") > hi)).alias("oversized_precincts"),
    )
    return out.withColumns({
        "median_pop": middle.scalar(),
        "min_allowed": F.col("ideal") * F.lit(1 - epsilon), "max_allowed": hi,
        "precincts_per_district": F.col("n_precincts") / F.lit(num_districts),
    }).withColumnRenamed("ideal", "ideal_pop")


def segregation_index(df: DataFrame, value: str, region: str) -> DataFrame:
    """1 - mean variance inside regions / variance over all."""
    inside = df.groupBy(region).agg(F.var_samp(value).alias("v"))
    overall = df.agg(F.var_samp(value).alias("v")).scalar()
    return inside.agg(F.avg("v").alias("mean_within_var")).withColumn("total_var", overall).withColumn(
        "segregation_index", F.lit(1.0) - try_div("mean_within_var", "total_var"))


def class_sizes(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_pop"))


def sample_scorecard(samples: DataFrame, target: float, share: str = "per_minority", by: str = "method") -> DataFrame:
    """Size, achieved share, spread and tails of each tagged sample."""
    x = F.col(share)
    part = lambda cond: F.avg(indicator(cond))
    return samples.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_precincts"), F.sum("population").alias("total_population"),
        try_div(F.sum(F.col("population") * x), F.sum("population")).alias("achieved_minority"),
        F.avg(x).alias("minority_mean"), F.stddev_samp(x).alias("minority_sd"),
        F.min(x).alias("minority_min"), F.max(x).alias("minority_max"),
        part(x < 0.1).alias("prop_below_10pct"), part(x > 0.5).alias("prop_above_50pct"),
        part(x > 0.9).alias("prop_above_90pct"),
        F.sum(indicator((x <= 0.001) | (x >= 0.999))).alias("precincts_at_bounds"),
    ).withColumns({
        "minority_range": F.col("minority_max") - F.col("minority_min"),
        "error_from_target": F.col("achieved_minority") - F.lit(float(target)),
    })


# The percentiles of a profile.
PROFILE = [0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1]


def percentile_profile(samples: DataFrame, value: str, methods: Sequence[str], by: str = "method") -> DataFrame:
    """Percentiles of each sample side by side: one row per percentile, one column per method."""
    names = {f"p{i}": p for i, p in enumerate(PROFILE)}
    found = exact_quantiles(samples, value, names, [by])
    long = found.unpivot([by], list(names), "name", "value")
    labels = F.create_map(*[v for n, p in names.items() for v in (F.lit(n), F.lit(float(p) * 100))])
    return long.withColumn("percentile", labels[F.col("name")]).groupBy("percentile").pivot(
        by, list(methods)).agg(F.max("value"))
