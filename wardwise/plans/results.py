"""The two tables every report reads: one row per district, one per precinct and plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwise.functions import ifelse, indicator, try_div
from wardwise.operators.frames import attach_districts, district_sums, district_totals, precinct_stats, truth_columns, unique_id
from wardwise.operators.inference import summarise_draws
from wardwise.operators.regression import add_regression
from wardwise.operators.rpv import correctness_columns, residual_columns, rpv_agreement, rpv_flag
from wardwise.operators.waste import packed_cracked, surplus_losing_districts, surplus_losing_precincts
from wardwise.schemas import DISTRICT, SCENARIO

RESULT_COLUMNS = [
    "unique_id", *DISTRICT, "n_precincts", "total_population",
    "true_minority_dem_share", "true_majority_dem_share", "true_overall_dem_share", "true_rpv",
    "er_minority_dem_share", "er_majority_dem_share", "er_minority_se", "er_majority_se", "er_rpv",
    "er_minority_resid", "er_majority_resid", "prop_minority", "prop_dem",
    "ei_minority_dem_share", "ei_majority_dem_share", "ei_minority_se", "ei_majority_se", "ei_rpv",
    "ei_minority_resid", "ei_majority_resid", "er_rpv_correct", "ei_rpv_correct",
    "total_minority", "total_majority", "total_dem_votes", "total_rep_votes",
    "true_minority_dem_votes", "true_majority_dem_votes", "dem_district",
    "packed_votes", "cracked_votes", "total_wasted", "packed_min_votes", "cracked_min_votes",
    "minority_wasted_total", "majority_wasted_total", "minority_waste_rate", "majority_waste_rate",
    "waste_disparity",
    *[f"{g}_{p}_wasted_{k}" for g in ("minority", "majority") for p in ("dem", "rep") for k in ("surplus", "losing")],
]


def district_results(
    units: DataFrame, draws: DataFrame | None = None, precincts: DataFrame | None = None, labels: DataFrame | None = None
) -> DataFrame:
    """Estimates, truth and wasted votes of every estimable district.

    Totals, regression and waste all come from one aggregation of the plan rows; the
    draw summaries are joined on (they may be absent for some districts). Without ``draws``, ``units``
    carry them in columns, and the same pass sums them. ``labels`` lists the scenarios of each plan; a plan in two scenarios appears under both.
    """
    deviations = {"ei_minority_sd": "ei_minority_se", "ei_majority_sd": "ei_majority_se"}
    if draws is None:
        sums = summarise_draws(units, precincts, DISTRICT, district_totals(moments=True)).withColumnsRenamed(deviations)
    else:
        sums = district_sums(units, DISTRICT, moments=True)
    found = add_regression(sums).where(F.col("er_minority_dem_share").isNotNull()).withColumns(truth_columns())
    wasted = surplus_losing_districts(packed_cracked(found))
    if draws is not None:
        wasted = wasted.join(summarise_draws(draws, precincts).withColumnsRenamed(deviations), DISTRICT, "left")
    both = wasted.withColumns({
        **residual_columns("er"), **residual_columns("ei"), **correctness_columns(),
        "prop_minority": try_div("total_minority", "total_population"),
    })
    return under_labels(both, labels) if labels is not None else _with_id(both)


def _with_id(rows: DataFrame) -> DataFrame:
    ids = {"unique_id": unique_id("map_id", "district_id", "seg_level", "redist_level")}
    return rows.withColumns(ids).select(*RESULT_COLUMNS)


def under_labels(results: DataFrame, labels: DataFrame) -> DataFrame:
    """District results under each scenario that ``labels`` lists for the plan, instead of the plan's own; the plan rows are not read again."""
    return _with_id(results.drop("redist_level").join(labels, ["map_id", "seg_level"]))


def plans_in_several_scenarios(results: DataFrame) -> DataFrame:
    """Plans listed under more than one scenario, with the sorted list of labels."""
    return (
        results.select("seg_level", "map_id", "redist_level").distinct()
        .groupBy("seg_level", "map_id").agg(
            F.count(F.lit(1)).alias("n_redist_levels"),
            F.array_join(F.array_sort(F.collect_set("redist_level")), ", ").alias("redist_levels"),
        ).where(F.col("n_redist_levels") > 1)
    )


def pick_one(df: DataFrame, by: Sequence[str], choose: str, order: Column | None = None) -> DataFrame:
    """One value of ``choose`` per group: the first in ``order``, by default by value.

    Pass ``hash_noise(seed, ...)`` for a repeatable random pick. It is a minimum, so
    it is combined on the map side and no group is gathered.
    """
    first = F.min(F.struct((order if order is not None else F.col(choose)).alias("o"), F.col(choose).alias("v")))
    return df.groupBy(*by).agg(first.alias("_f")).select(*by, F.col("_f.v").alias(choose))


def one_scenario_per_plan(results: DataFrame, order: Column | None = None) -> DataFrame:
    """Rows of the scenario kept for each plan."""
    kept = pick_one(results, ["seg_level", "map_id"], "redist_level", order)
    return results.join(kept, ["seg_level", "map_id", "redist_level"], "left_semi")


def scenario_plan_counts(results: DataFrame) -> DataFrame:
    return results.select(*SCENARIO, "map_id").distinct().groupBy(*SCENARIO).agg(F.count(F.lit(1)).alias("n"))


CARRIED = [
    "prop_minority", "prop_dem", "er_minority_dem_share", "er_majority_dem_share", "er_rpv",
    "ei_minority_dem_share", "ei_majority_dem_share", "ei_rpv",
]


def precinct_truth(rows: DataFrame) -> DataFrame:
    """True shares and flag of each precinct: what depends on the precinct alone, whatever the plan."""
    out = rows.withColumns({
        "true_minority_dem_share_precinct": try_div("dem_votes_minority", "n_minority"),
        "true_majority_dem_share_precinct": try_div("dem_votes_majority", "n_majority"),
        "true_overall_dem_share_precinct": try_div("dem_votes", "population"),
        "prop_minority_precinct": try_div("n_minority", "population"),
        "prop_dem_precinct": try_div("dem_votes", F.col("dem_votes") + F.col("rep_votes")),
    })
    return out.withColumn("true_rpv_precinct", rpv_flag("true_minority_dem_share_precinct", "true_majority_dem_share_precinct"))


def precinct_predictions(rows: DataFrame) -> DataFrame:
    """Predicted shares, flags and errors of each precinct in its district, beside ``precinct_truth``."""
    out = rows.withColumns({
        **{f"{m}_pred_{g}_share_precinct": F.col(f"{m}_{g}_dem_share")
           for m in ("er", "ei") for g in ("minority", "majority")},
        "unique_id": unique_id("map_id", "district_id", "precinct_id", "seg_level", "redist_level"),
    })
    out = out.withColumns({
        **{f"{m}_rpv_precinct": rpv_flag(f"{m}_pred_minority_share_precinct", f"{m}_pred_majority_share_precinct")
           for m in ("er", "ei")},
        **{f"{m}_{g}_error_precinct": F.abs(
            F.col(f"{m}_pred_{g}_share_precinct") - F.col(f"true_{g}_dem_share_precinct")
        ) for m in ("er", "ei") for g in ("minority", "majority")},
    })
    return out.withColumns({
        f"{m}_rpv_correct_precinct": rpv_agreement(f"{m}_rpv_precinct", "true_rpv_precinct") for m in ("er", "ei")
    })


def precinct_metrics(rows: DataFrame) -> DataFrame:
    """True and predicted shares, flags and errors of each precinct in its district."""
    return precinct_predictions(precinct_truth(rows))


def precinct_results(units: DataFrame, results: DataFrame) -> DataFrame:
    """Metrics and wasted votes of every precinct of every plan that has results, from joined rows."""
    plans = results.select("map_id", "seg_level").distinct()
    kept = units.join(plans, ["map_id", "seg_level"], "left_semi")
    joined = attach_districts(kept, results, CARRIED)
    return surplus_losing_precincts(precinct_metrics(joined))


def plan_precinct_results(assignments: DataFrame, precincts: DataFrame, results: DataFrame) -> DataFrame:
    """``precinct_results`` from plan rows and precincts: shares, flags and wasted votes of a precinct are computed once, and joined to its plans."""
    prepared = surplus_losing_precincts(precinct_truth(precincts))
    plans = results.select("map_id", "seg_level").distinct()
    kept = assignments.join(plans, ["map_id", "seg_level"], "left_semi")
    return precinct_predictions(attach_districts(precinct_stats(kept, prepared), results, CARRIED))


def plan_seat_counts(rows: DataFrame) -> DataFrame:
    """Districts won and majority-minority districts per plan, from precinct rows."""
    flags = {"n_dem_seats": F.col("prop_dem") > 0.5, "n_rep_seats": F.col("prop_dem") <= 0.5, "n_maj_min": F.col("prop_minority") > 0.5}
    # One row per district, summed up in the map tasks, and then one per plan.
    districts = rows.groupBy("map_id", *SCENARIO, "district_id").agg(*[F.max(flag).alias(name) for name, flag in flags.items()])
    known = F.col("district_id").isNotNull()
    return districts.groupBy("map_id", *SCENARIO).agg(*[F.count_if(F.col(name) & known).alias(name) for name in flags])


def with_seats(results: DataFrame) -> DataFrame:
    """District rows with the seat counts of their plan."""
    counts = results.groupBy("map_id", *SCENARIO).agg(
        F.sum(indicator(F.col("prop_dem") > 0.5)).alias("n_dem_seats"),
        F.sum(indicator(F.col("prop_dem") < 0.5)).alias("n_rep_seats"),
        F.sum(indicator(F.col("prop_minority") > 0.5)).alias("n_maj_min"),
    )
    return results.join(counts, ["map_id", *SCENARIO])


def with_external_estimates(precinct_rows: DataFrame, summary: DataFrame, district_base: int = 1) -> DataFrame:
    """Replaces the inference estimates by an external table's, joined on renamed keys."""
    renamed = summary.withColumnsRenamed({
        "plan": "map_id", "scenario": "seg_level", "ei.beta.b": "beta_b", "ei.beta.w": "beta_w",
        "ei_beta_b": "beta_b", "ei_beta_w": "beta_w",
    }).withColumn("district_id", F.col("district_id") - F.lit(district_base))
    keys = ["map_id", "seg_level", "district_id", "precinct_id"]
    joined = precinct_rows.join(renamed.select(*keys, "beta_b", "beta_w"), keys, "left")
    return joined.withColumns({
        "ei_minority_dem_share": F.col("beta_b"), "ei_majority_dem_share": F.col("beta_w"),
        "ei_pred_minority_share_precinct": F.col("beta_b"), "ei_pred_majority_share_precinct": F.col("beta_w"),
    }).drop("beta_b", "beta_w")


def wasted_check(results: DataFrame) -> DataFrame:
    """Audit of a result table: rows, unmatched rows, mean wasted share, share mismatches."""
    half = try_div("total_wasted", "total_population")
    return results.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(indicator(F.col("true_minority_dem_votes").isNull())).alias("n_missing"),
        F.avg(half).alias("mean_wasted_share"),
        F.max(F.abs(F.col("true_minority_dem_share") - try_div("true_minority_dem_votes", "total_minority")))
        .alias("max_minority_diff"),
        F.sum(ifelse(F.abs(half - 0.5) > try_div(F.lit(2), "total_population"), 1, 0)).cast("bigint").alias("n_off_half"),
    )
