"""Error tables, intervals, seats, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardwise import fixtures as fx
from wardwise.catalog import base
from wardwise.catalog.base import DK
from wardwise.catalog.registry import R, div, query, rounded, rs, view
from wardwise.catalog.truth import map_table
from wardwise.operators import ordered, report
from wardwise.plans import results as res
from wardwise.schemas import PLAN, SCENARIO

G = "seg_level, redist_level"
MK = f"map_id, {G}"

view("fx_stacked", f"""
SELECT {DK}, 'ER' AS method, er_minority_dem_share AS e1, er_majority_dem_share AS e0, er_minority_resid AS r1,
  er_majority_resid AS r0, er_rpv AS rpv, er_rpv_correct AS ok, true_minority_dem_share AS t1,
  true_majority_dem_share AS t0, true_rpv, prop_minority, true_overall_dem_share FROM fx_results
UNION ALL
SELECT {DK}, 'EI' AS method, ei_minority_dem_share, ei_majority_dem_share, ei_minority_resid,
  ei_majority_resid, ei_rpv, ei_rpv_correct, true_minority_dem_share,
  true_majority_dem_share, true_rpv, prop_minority, true_overall_dem_share FROM fx_results
""")
view("fx_plan_errors", f"""
SELECT {MK}, method, avg(abs(r1)) AS mae_minority, avg(abs(r0)) AS mae_majority, avg(ok) AS rpv_accuracy,
  avg(r1) AS bias_minority, avg(r0) AS bias_majority FROM fx_stacked GROUP BY {MK}, method
""")


def savg(x: str) -> str:
    """Mean that is NULL when an input is."""
    return f"CASE WHEN count({x}) = count(*) THEN avg({x}) END"


@query("a07_seat_statistics", f"""
SELECT {G}, {R('avg(n_dem_districts)', 'mean_dem_seats')}, {R('stddev_samp(n_dem_districts)', 'sd_dem_seats')},
  min(n_dem_districts) AS min_dem_seats, max(n_dem_districts) AS max_dem_seats,
  {R('avg(n_maj_min_districts)', 'mean_minority_districts')} FROM fx_mapsum GROUP BY {G}
""")
def a07(spark, sf):
    return rounded(report.seat_statistics(map_table(spark, sf)))


@query("a08_seat_difference", f"""
SELECT {R('lo', 'low_seats')}, {R('hi', 'high_seats')}, {R('lo - hi', 'difference')},
  CASE WHEN lo - hi > 0 THEN 'supports' WHEN lo - hi <= 0 THEN 'contradicts' END AS verdict
FROM (SELECT avg(n_dem_districts) FILTER (WHERE seg_level = 'low') AS lo,
  avg(n_dem_districts) FILTER (WHERE seg_level = 'high') AS hi FROM fx_mapsum) t
""")
def a08(spark, sf):
    return rounded(report.seat_difference(map_table(spark, sf)))


@query("a09_plan_errors", f"SELECT {MK}, method, {rs(*report.METRICS)} FROM fx_plan_errors")
def a09(spark, sf):
    return rounded(report.plan_errors(base.results(spark, sf)))


@query("a10_metric_intervals", f"""
SELECT {G}, method, metric, count(*) AS n_maps, {R('avg(value)', 'mean_value')},
  {R('quantile_cont(value, 0.025)', 'lower_ci')}, {R('quantile_cont(value, 0.975)', 'upper_ci')}
FROM (UNPIVOT fx_plan_errors ON {', '.join(report.METRICS)} INTO NAME metric VALUE value) t GROUP BY {G}, method, metric
""")
def a10(spark, sf):
    return rounded(report.metric_intervals(report.plan_errors(base.results(spark, sf))))


_WIDE = ", ".join(
    f"{R(f'avg({m})', f'{m}_mean')}, {R(f'quantile_cont({m}, 0.025)', f'{m}_lower')}, {R(f'quantile_cont({m}, 0.975)', f'{m}_upper')}"
    for m in report.METRICS)


@query("a10_wide_intervals", f"SELECT {G}, method, count(*) AS n_maps, {_WIDE} FROM fx_plan_errors GROUP BY {G}, method")
def a10w(spark, sf):
    return rounded(report.wide_intervals(report.metric_intervals(report.plan_errors(base.results(spark, sf)))))


_FLIP = "CASE WHEN sign(t0 - t1) <> sign(e0 - e1) THEN 1e0 WHEN sign(t0 - t1) = sign(e0 - e1) THEN 0e0 END"
_UNDER = "CASE WHEN e1 < t1 THEN 1e0 WHEN e1 >= t1 THEN 0e0 END"


@query("a11_district_error_table", f"""
SELECT {G}, method, {R(f'sqrt({savg("r1 * 100 * r1 * 100")})', 'rmse_min')}, {R(f'sqrt({savg("r0 * 100 * r0 * 100")})', 'rmse_maj')},
  {R(savg('r1 * 100'), 'bias_min')}, {R(savg('r0 * 100'), 'bias_maj')}, {R(savg('abs(r1) * 100'), 'mae_min')},
  {R(savg('abs(r0) * 100'), 'mae_maj')}, {R(savg('(t1 - t0) * 100'), 'true_spread')}, {R(savg('(e1 - e0) * 100'), 'est_spread')},
  {R(savg('true_rpv * 100'), 'true_rpv')}, {R(savg('ok * 100'), 'pct_correct_rpv')},
  {R(savg(f'{_UNDER} * 100'), 'pct_under')}, {R(savg(f'{_FLIP} * 100'), 'pct_sign_flips')},
  {R(f'{savg("(e1 - e0) * 100")} - {savg("(t1 - t0) * 100")}', 'bias_spread')}
FROM fx_stacked GROUP BY {G}, method
""")
def a11(spark, sf):
    return rounded(report.error_table(base.results(spark, sf)))


view("fx_rows_long", f"""
SELECT {G}, 'ER' AS method, true_minority_dem_share_precinct AS t1, true_majority_dem_share_precinct AS t0,
  er_minority_dem_share AS e1, er_majority_dem_share AS e0, true_rpv_precinct AS rpv, er_rpv_correct_precinct AS ok FROM fx_rows
UNION ALL
SELECT {G}, 'EI' AS method, true_minority_dem_share_precinct, true_majority_dem_share_precinct,
  ei_minority_dem_share, ei_majority_dem_share, true_rpv_precinct, ei_rpv_correct_precinct FROM fx_rows
""")


@query("a12_precinct_error_table", f"""
SELECT {G}, method, {R('sqrt(avg(power((e1 - t1) * 100, 2)))', 'rmse_min')}, {R('sqrt(avg(power((e0 - t0) * 100, 2)))', 'rmse_maj')},
  {R('avg((e1 - t1) * 100)', 'bias_min')}, {R('avg((e0 - t0) * 100)', 'bias_maj')},
  {R('avg(abs(e1 - t1) * 100)', 'mae_min')}, {R('avg(abs(e0 - t0) * 100)', 'mae_maj')},
  {R('avg(rpv) * 100', 'true_rpv')}, {R('avg(ok) * 100', 'pct_correct_rpv')},
  {R(f'avg({_UNDER}) * 100', 'pct_under')}, {R(f'avg({_FLIP}) * 100', 'pct_sign_flips')}
FROM fx_rows_long WHERE t1 > 0 GROUP BY {G}, method
""")
def a12(spark, sf):
    return rounded(report.precinct_error_table(base.precinct_rows(spark, sf)))


_M = div('total_dem_votes - total_rep_votes', 'total_population')


@query("a13_competitiveness", f"""
SELECT {G}, count(*) AS n_districts, {R('avg(CASE WHEN abs(m) < 0.05 THEN 100e0 ELSE 0e0 END)', 'pct_competitive')},
  {R('avg(m)', 'avg_margin')}, {R('stddev_samp(m) * 100', 'margin_sd')},
  {R('avg(CASE WHEN m > 0.05 THEN 100e0 ELSE 0e0 END)', 'pct_safe_dem')}, {R('avg(CASE WHEN m < -0.05 THEN 100e0 ELSE 0e0 END)', 'pct_safe_rep')}
FROM (SELECT *, {_M} AS m FROM fx_results) t GROUP BY {G}
""")
def a13(spark, sf):
    return rounded(report.competitiveness(base.results(spark, sf)))


@query("a14_seats_by_scenario", f"""
SELECT {G}, {R('avg(s)', 'avg_dem_seats')}, {R('avg(mm)', 'avg_maj_min')}, CAST(min(s) AS BIGINT) AS min_dem_seats, CAST(max(s) AS BIGINT) AS max_dem_seats
FROM (SELECT {MK}, sum(CASE WHEN total_dem_votes > total_rep_votes THEN 1 ELSE 0 END) AS s,
  sum(CASE WHEN prop_minority > 0.5 THEN 1 ELSE 0 END) AS mm FROM fx_results GROUP BY {MK}) t GROUP BY {G}
""")
def a14(spark, sf):
    return rounded(report.seats_by_scenario(base.results(spark, sf)))


@query("a15_waste_disparity", f"""
SELECT {G}, {R('a', 'minority_waste_rate')}, {R('b', 'majority_waste_rate')}, {R('c', 'mean_minority_waste_rate')},
  {R('d', 'mean_majority_waste_rate')}, {R('a - b', 'pop_weighted_waste_disparity')}
FROM (SELECT {G}, sum(minority_wasted_total) / sum(total_minority) * 100 AS a, sum(majority_wasted_total) / sum(total_majority) * 100 AS b,
  avg({div('minority_wasted_total', 'total_minority')} * 100) AS c, avg({div('majority_wasted_total', 'total_majority')} * 100) AS d
  FROM fx_results GROUP BY {G}) t
""")
def a15(spark, sf):
    return rounded(report.waste_disparity(base.results(spark, sf)))


@query("w13_carried_seat_count", f"""
SELECT {MK}, {R('avg(waste_disparity)', 'mean_waste_disparity')}, any_value(n_dem_seats) AS n_dem_seats FROM fx_seats GROUP BY {MK}
""")
def w13(spark, sf):
    return rounded(report.mean_waste_by_plan(res.with_seats(base.results(spark, sf))))


def _cop(g: str) -> str:
    return f"(CASE WHEN dem_district THEN true_{g}_dem_votes ELSE total_{g} - true_{g}_dem_votes END)"


_NEAR = f"(CASE WHEN abs({_M}) < 0.05 THEN 1 ELSE 0 END)"


@query("a16_group_probabilities", f"""
SELECT {G}, {', '.join(
    f"{R(div(f'sum({_cop(g)})', f'sum(total_{g})') + ' * 100', f'pr_{g}_copartisan')}, "
    f"{R(div(f'sum(total_{g} * {_NEAR})', f'sum(total_{g})') + ' * 100', f'pr_{g}_competitive')}, "
    f"{R(div(f'sum({g}_wasted_total)', f'sum(total_{g})') + ' * 100', f'pr_{g}_wasted')}" for g in ('minority', 'majority'))}
FROM fx_results GROUP BY {G}
""")
def a16(spark, sf):
    return rounded(report.group_probabilities(base.results(spark, sf)))


@query("a20_minority_distribution", f"""
SELECT {G}, n_districts, n_maj_min, {R('pct', 'pct_maj_min')}, a AS minorities_in_maj_min, b AS minorities_in_other,
  {R(div('a', '(a + b)') + ' * 100', 'pct_minorities_in_maj_min')}, {R('c', 'avg_min_pct_in_maj_min')}, {R('d', 'avg_min_pct_in_other')}
FROM (SELECT {G}, count(*) AS n_districts, count(*) FILTER (WHERE big) AS n_maj_min,
    avg(CASE WHEN big THEN 100e0 ELSE 0e0 END) AS pct, CAST(coalesce(sum(total_minority) FILTER (WHERE big), 0) AS BIGINT) AS a,
    CAST(coalesce(sum(total_minority) FILTER (WHERE NOT big), 0) AS BIGINT) AS b,
    avg(prop_minority) FILTER (WHERE big) AS c, avg(prop_minority) FILTER (WHERE NOT big) AS d
  FROM (SELECT *, prop_minority > 0.5 AS big FROM fx_results_all) x GROUP BY {G}) t
""")
def a20(spark, sf):
    return rounded(report.minority_distribution(base.results_all(spark, sf)))


@query("a21_waste_by_district_class", f"""
SELECT {G}, big AS is_majority_minority, n_districts, total_minority_pop, total_majority_pop, {rs('minority_packed', 'majority_packed')},
  minority_cracked, majority_cracked,
  {R(div('(minority_packed + minority_cracked)', 'total_minority_pop'), 'minority_waste_rate')},
  {R(div('(majority_packed + majority_cracked)', 'total_majority_pop'), 'majority_waste_rate')},
  {R(div('minority_packed', '(minority_packed + minority_cracked)'), 'minority_pct_packed')}
FROM (SELECT {G}, prop_minority > 0.5 AS big, count(*) AS n_districts, CAST(sum(total_minority) AS BIGINT) AS total_minority_pop,
    CAST(sum(total_majority) AS BIGINT) AS total_majority_pop, sum(packed_min_votes) AS minority_packed,
    CAST(sum(cracked_min_votes) AS BIGINT) AS minority_cracked, sum(packed_votes - packed_min_votes) AS majority_packed,
    CAST(sum(cracked_votes - cracked_min_votes) AS BIGINT) AS majority_cracked
  FROM fx_results_all GROUP BY {G}, big) t
""")
def a21(spark, sf):
    return rounded(report.waste_by_district_class(base.results_all(spark, sf)))


@query("a22_plans_in_several_scenarios", """
SELECT seg_level, map_id, count(DISTINCT redist_level) AS n_redist_levels,
  string_agg(DISTINCT redist_level, ', ' ORDER BY redist_level) AS redist_levels
FROM fx_results_all GROUP BY seg_level, map_id HAVING count(DISTINCT redist_level) > 1
""")
def a22(spark, sf):
    return res.plans_in_several_scenarios(base.results_all(spark, sf))


@query("a23_plans_per_scenario", f"SELECT {G}, count(DISTINCT map_id) AS n FROM fx_results GROUP BY {G}")
def a23(spark, sf):
    return res.scenario_plan_counts(base.results(spark, sf))


_AUDIT = ["true_minority_dem_share_precinct", "er_pred_minority_share_precinct", "ei_pred_minority_share_precinct"]


@query("a24_null_audit", f"""
SELECT count(*) AS n_rows, {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS null_{c}' for c in _AUDIT)},
  count(DISTINCT precinct_id) AS n_precincts, count(DISTINCT map_id) AS n_maps, count(DISTINCT (map_id, district_id)) AS n_districts
FROM fx_rows
""")
def a24(spark, sf):
    return report.null_audit(base.precinct_rows(spark, sf), _AUDIT, {
        "precincts": ["precinct_id"], "maps": ["map_id"], "districts": ["map_id", "district_id"]})


@query("a30_mean_and_error", f"""
SELECT {G}, district_id, {R('avg(true_overall_dem_share)', 'mean')}, {R('stddev_samp(true_overall_dem_share) / sqrt(count(*))', 'se')},
  count(*) AS n, {R('avg(true_overall_dem_share) - 1.96 * (stddev_samp(true_overall_dem_share) / sqrt(count(*)))', 'ci_lo')},
  {R('avg(true_overall_dem_share) + 1.96 * (stddev_samp(true_overall_dem_share) / sqrt(count(*)))', 'ci_hi')}
FROM fx_results GROUP BY {G}, district_id
""")
def a30(spark, sf):
    return rounded(report.mean_and_error(base.results(spark, sf), "true_overall_dem_share", [*SCENARIO, "district_id"]))


def _gap_sql(g: str) -> str:
    return f"""
SELECT '{g}' AS "group", {MK}, {R(div(f'(sum({g}_rep_wasted_surplus + {g}_rep_wasted_losing) - sum({g}_dem_wasted_surplus + {g}_dem_wasted_losing))', f'sum(total_{g})'), 'efficiency_gap')},
  {R(div(f'sum({g}_wasted_total)', f'sum(total_{g})'), 'prop_wasted')} FROM fx_results GROUP BY {MK}"""


@query("a31_group_efficiency_gap", _gap_sql("minority") + " UNION ALL " + _gap_sql("majority"))
def a31(spark, sf):
    both = [report.group_efficiency(base.results(spark, sf), g).select(
        F.lit(g).alias("group"), *PLAN, "efficiency_gap", "prop_wasted") for g in ("minority", "majority")]
    return rounded(both[0].unionByName(both[1]))


@query("a32_racial_inefficiency", f"""
SELECT {MK}, {R(div('(sum(minority_wasted_total) - sum(majority_wasted_total))', '(sum(total_minority) + sum(total_majority))'), 'racial_inefficiency_disparity')},
  {R(div('sum(minority_wasted_total)', 'sum(total_minority)'), 'prop_minority_wasted')},
  {R(div('sum(majority_wasted_total)', 'sum(total_majority)'), 'prop_majority_wasted')}
FROM fx_results GROUP BY {MK}
""")
def a32(spark, sf):
    return rounded(report.racial_inefficiency(base.results(spark, sf)).select(
        *PLAN, "racial_inefficiency_disparity", "prop_minority_wasted", "prop_majority_wasted"))


@query("a37_confusion_shares", f"""
SELECT {G}, method, {R('avg(CASE WHEN true_rpv = 1 AND rpv = 1 THEN 1e0 ELSE 0e0 END)', 'true_pos')},
  {R('avg(CASE WHEN true_rpv = 0 AND rpv = 1 THEN 1e0 ELSE 0e0 END)', 'false_pos')},
  {R('avg(CASE WHEN true_rpv = 0 AND rpv = 0 THEN 1e0 ELSE 0e0 END)', 'true_neg')},
  {R('avg(CASE WHEN true_rpv = 1 AND rpv = 0 THEN 1e0 ELSE 0e0 END)', 'false_neg')}
FROM fx_stacked GROUP BY {G}, method
""")
def a37(spark, sf):
    return rounded(report.confusion_shares(base.results(spark, sf)))


@query("a39_weighted_mean_by_bin", f"""
SELECT bin, n, CAST(w AS BIGINT) AS total_weight, {R('m', 'weighted_mean')}, {R('CAST(n AS DOUBLE) / sum(n) OVER ()', 'prop')}
FROM (SELECT CASE WHEN per_minority <= 0.1e0 THEN 1 WHEN per_minority <= 0.2e0 THEN 2 WHEN per_minority <= 0.30000000000000004e0 THEN 3
    WHEN per_minority <= 0.4e0 THEN 4 WHEN per_minority <= 0.5e0 THEN 5 WHEN per_minority <= 0.6000000000000001e0 THEN 6
    WHEN per_minority <= 0.7000000000000001e0 THEN 7 WHEN per_minority <= 0.8e0 THEN 8 WHEN per_minority <= 0.9e0 THEN 9 ELSE 10 END AS bin,
    count(*) AS n, sum(population) AS w, sum(per_minority * population) / sum(population) AS m FROM fx_blocks GROUP BY bin) t
""")
def a39(spark, sf):
    from wardwise.functions import cut_index

    tenths = [i * 0.1 for i in range(11)]
    binned = fx.blocks(spark, sf).withColumn("bin", cut_index("per_minority", tenths, include_lowest=True))
    out = report.weighted_mean(binned, "per_minority", "population", ["bin"])
    return rounded(ordered.share_of_group(out, "n", [], "prop"))


@query("a43_population_diagnostics", f"""
SELECT {R('ideal', 'ideal_pop')}, total_pop, n_precincts, min_pop, max_pop, {rs('mean_pop', 'median_pop')}, oversized_precincts,
  {R('ideal * 0.95e0', 'min_allowed')}, {R('ideal * 1.05e0', 'max_allowed')}, {R('n_precincts / 14e0', 'precincts_per_district')}
FROM (SELECT any_value(ideal) AS ideal, CAST(sum(population) AS BIGINT) AS total_pop, count(*) AS n_precincts, min(population) AS min_pop,
    max(population) AS max_pop, avg(population) AS mean_pop, quantile_cont(population, 0.5) AS median_pop,
    count(*) FILTER (WHERE population > ideal * 1.05e0) AS oversized_precincts
  FROM fx_precincts, (SELECT sum(population) / 14e0 AS ideal FROM fx_precincts) i) t
""")
def a43(spark, sf):
    return rounded(report.population_diagnostics(fx.precincts(spark, sf), 14, 0.05))


@query("k03_top_values", "SELECT population FROM fx_precincts ORDER BY population DESC LIMIT 5")
def k03(spark, sf):
    return fx.precincts(spark, sf).select("population").orderBy(F.desc("population")).limit(5)


@query("a44_segregation_index", f"""
SELECT {R('w', 'mean_within_var')}, {R('v', 'total_var')}, {R('1 - w / v', 'segregation_index')}
FROM (SELECT avg(s) AS w FROM (SELECT var_samp(per_minority) AS s FROM fx_blocks GROUP BY state) a) b,
  (SELECT var_samp(per_minority) AS v FROM fx_blocks) c
""")
def a44(spark, sf):
    return rounded(report.segregation_index(fx.blocks(spark, sf), "per_minority", "state"))


