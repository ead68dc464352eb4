"""Binned accuracy and errors, histograms, class shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardwise import fixtures as fx
from wardwise.catalog import base
from wardwise.catalog.registry import R, cut_sql, div, number, query, rounded, view
from wardwise.catalog.tables import G, _cop, _M, savg
from wardwise.functions import cut
from wardwise.operators import bins, waste
from wardwise.schemas import SCENARIO

BIN75 = lambda e: cut_sql(e, bins.FIVE_TO_75, bins.FIVE_TO_75_LABELS, right=False)
BIN100 = lambda e: cut_sql(e, bins.FIVE_TO_100, bins.FIVE_TO_100_LABELS, right=False)


@query("a25_accuracy_by_minority_share", f"""
SELECT {G}, {BIN75('prop_minority * 100')} AS bin, method AS model, {R(savg('ok * 100'), 'pct_correct')}, count(*) AS n_obs
FROM fx_stacked WHERE prop_minority IS NOT NULL GROUP BY {G}, bin, method
""")
def a25(spark, sf):
    return rounded(bins.accuracy_by_bin(
        base.results(spark, sf), {"er_rpv_correct": "ER", "ei_rpv_correct": "EI"}, F.col("prop_minority") * 100))


@query("a25_accuracy_by_vote_share", f"""
SELECT {G}, {BIN100('true_overall_dem_share * 100')} AS bin, method AS model, {R(savg('ok * 100'), 'pct_correct')}, count(*) AS n_obs
FROM fx_stacked WHERE true_overall_dem_share IS NOT NULL GROUP BY {G}, bin, method
""")
def a25v(spark, sf):
    return rounded(bins.accuracy_by_bin(
        base.results(spark, sf), {"er_rpv_correct": "ER", "ei_rpv_correct": "EI"},
        F.col("true_overall_dem_share") * 100, 100))


MARGIN = cut_sql("(true_overall_dem_share - (1e0 - true_overall_dem_share)) * 100", [-1000.0, *bins.TEN_POINTS[1:]], bins.TEN_POINTS_LABELS, right=False)


@query("a25_accuracy_by_margin", f"""
SELECT {G}, {MARGIN} AS bin, method AS model, {R(savg('ok * 100'), 'pct_correct')}, count(*) AS n_obs
FROM fx_stacked WHERE true_overall_dem_share IS NOT NULL GROUP BY {G}, bin, method
""")
def a25m(spark, sf):
    return rounded(bins.accuracy_by_margin(
        base.results(spark, sf), {"er_rpv_correct": "ER", "ei_rpv_correct": "EI"}, "true_overall_dem_share"))


@query("a25_precinct_accuracy", f"""
SELECT {G}, bin, model, {R(savg('ok * 100'), 'pct_correct')}, count(*) AS n_obs FROM (
  SELECT {G}, {BIN75('prop_minority_precinct * 100')} AS bin, 'ER' AS model, er_rpv_correct_precinct AS ok FROM fx_rows
  UNION ALL SELECT {G}, {BIN75('prop_minority_precinct * 100')} AS bin, 'EI' AS model, ei_rpv_correct_precinct AS ok FROM fx_rows) t
WHERE bin IS NOT NULL GROUP BY {G}, bin, model
""")
def a25p(spark, sf):
    return rounded(bins.accuracy_by_bin(
        base.precinct_rows(spark, sf), {"er_rpv_correct_precinct": "ER", "ei_rpv_correct_precinct": "EI"},
        F.col("prop_minority_precinct") * 100))


@query("a26_error_by_vote_share", f"""
SELECT {G}, bin, model, "group", {R(f'sqrt({savg("e * e")})', 'rmse')}, {R(savg('e'), 'bias')}, count(*) AS n_obs FROM (
  SELECT {G}, {BIN100('true_overall_dem_share * 100')} AS bin, method AS model, 'minority' AS "group", r1 * 100 AS e FROM fx_stacked
  UNION ALL SELECT {G}, {BIN100('true_overall_dem_share * 100')} AS bin, method AS model, 'majority' AS "group", r0 * 100 AS e FROM fx_stacked) t
WHERE bin IS NOT NULL GROUP BY {G}, bin, model, "group"
""")
def a26(spark, sf):
    return rounded(bins.error_by_bin(base.results(spark, sf), F.col("true_overall_dem_share") * 100))


view("fx_abs_errors", f"""
SELECT {G}, prop_minority, method AS model, 'Minority' AS "group", abs(r1) AS abs_error FROM fx_stacked
UNION ALL SELECT {G}, prop_minority, method AS model, 'Majority' AS "group", abs(r0) AS abs_error FROM fx_stacked
""")


@query("a27_error_quantiles", f"""
SELECT {cut_sql('prop_minority', bins.TWENTIETHS)} AS bin, "group", {G}, {R('avg(abs_error)', 'mean_error')},
  {R('avg(prop_minority)', 'prop_minority')}, {R('quantile_cont(abs_error, 0.5)', 'median_error')},
  {R('quantile_cont(abs_error, 0.25)', 'q25')}, {R('quantile_cont(abs_error, 0.75)', 'q75')}, {R('quantile_cont(abs_error, 0.9)', 'q90')}
FROM fx_abs_errors WHERE prop_minority > 0 AND prop_minority <= 1 GROUP BY bin, "group", {G}
""")
def a27(spark, sf):
    return rounded(bins.error_quantiles_by_bin(base.results(spark, sf)))


@query("a28_histogram", f"""
SELECT {G}, bin, n, {R('n * 30e0 / max(n) OVER (PARTITION BY seg_level, redist_level)', 'n_scaled')}, {R('n * 30e0 / max(n) OVER ()', 'n_scaled_all')}
FROM (SELECT {G}, {BIN75('prop_minority * 100')} AS bin, count(*) AS n FROM fx_results GROUP BY {G}, bin) t WHERE bin IS NOT NULL
""")
def a28(spark, sf):
    return rounded(bins.histogram(base.results(spark, sf), bins.five_point_bin(F.col("prop_minority") * 100)))


_CATEGORY = f"""CASE WHEN {_M} > 0.1 THEN 'Safe Dem (>10%)' WHEN {_M} > 0.05 THEN 'Likely Dem (5-10%)' WHEN {_M} > 0 THEN 'Lean Dem (0-5%)'
 WHEN {_M} > -0.05 THEN 'Lean Rep (0-5%)' WHEN {_M} > -0.1 THEN 'Likely Rep (5-10%)' ELSE 'Safe Rep (>10%)' END"""
_TYPE = f"""CASE WHEN {_M} * 100 > 10 THEN 'Safe Dem (>10%)' WHEN {_M} * 100 > 5 THEN 'Likely Dem (5-10%)' WHEN {_M} * 100 > -5 THEN 'Competitive (±5%)'
 WHEN {_M} * 100 > -10 THEN 'Likely Rep (5-10%)' ELSE 'Safe Rep (>10%)' END"""


@query("p11_margin_categories", f"""
SELECT unique_id, {_CATEGORY} AS margin_category, {_TYPE} AS district_type FROM fx_results
""")
def p11(spark, sf):
    return base.results(spark, sf).withColumns(waste.margin_columns()).select(
        "unique_id", "margin_category", "district_type")


@query("a29_margin_class_shares", f"""
SELECT {G}, class, n, {R('n * 100e0 / sum(n) OVER (PARTITION BY seg_level, redist_level)', 'pct')}
FROM (SELECT {G}, {_CATEGORY} AS class, count(*) AS n FROM fx_results GROUP BY {G}, class) t
""")
def a29(spark, sf):
    return rounded(bins.class_shares(base.results(spark, sf), waste.margin_category(waste.dem_margin())))


@query("a29_minority_by_district_type", f"""
SELECT {G}, class, n, {R('n * 100e0 / sum(n) OVER (PARTITION BY seg_level, redist_level)', 'pct')}
FROM (SELECT {G}, {_TYPE} AS class, CAST(sum(total_minority) AS BIGINT) AS n FROM fx_results GROUP BY {G}, class) t
""")
def a29m(spark, sf):
    return rounded(bins.class_shares(
        base.results(spark, sf), waste.district_type(waste.dem_margin() * 100), F.col("total_minority")))


@query("a29_majority_by_district_type", f"""
SELECT {G}, class, n, {R('n * 100e0 / sum(n) OVER (PARTITION BY seg_level, redist_level)', 'pct')}
FROM (SELECT {G}, {_TYPE} AS class, CAST(sum(total_majority) AS BIGINT) AS n FROM fx_results GROUP BY {G}, class) t
""")
def a29j(spark, sf):
    return rounded(bins.class_shares(
        base.results(spark, sf), waste.district_type(waste.dem_margin() * 100), F.col("total_majority")))


def _by_bin(g: str, share: str) -> str:
    frac = div(_cop(g), f"total_{g}")
    index = cut_sql(share, bins.TWENTIETHS, include_lowest=True)
    mid = cut_sql(share, bins.TWENTIETHS, bins.MIDPOINTS, include_lowest=True)
    return f"""
SELECT {G}, bin, {R('avg(f)', 'mean_copartisan')}, {R('stddev_samp(f) / sqrt(count(*))', 'se_copartisan')}, count(*) AS n_obs, {R('any_value(mid)', 'share')}
FROM (SELECT {G}, {index} AS bin, {mid} AS mid, {frac} AS f FROM fx_results) t WHERE bin IS NOT NULL GROUP BY {G}, bin"""


@query("d14_minority_copartisan_by_bin", _by_bin("minority", "prop_minority"))
def d14a(spark, sf):
    return rounded(bins.copartisan_by_bin(base.results(spark, sf), "minority"))


@query("d14_majority_copartisan_by_bin", _by_bin("majority", div("total_majority", "total_population")))
def d14b(spark, sf):
    return rounded(bins.copartisan_by_bin(base.results(spark, sf), "majority"))


_MIS = cut_sql("abs(prop_minority_precinct - prop_minority)", bins.TWENTIETHS, include_lowest=True)


@query("a35_contextual_mismatch_errors", f"""
SELECT {G}, {_MIS} AS bin,
  {', '.join(R(f'avg({m}_{g}_error_precinct)', f'mean_{m}_{g}_error') for m in ('er', 'ei') for g in ('minority', 'majority'))},
  {', '.join(R(f'stddev_samp({m}_minority_error_precinct) / sqrt(count(*))', f'se_{m}_minority') for m in ('er', 'ei'))}, count(*) AS n_precincts
FROM fx_rows WHERE er_minority_error_precinct IS NOT NULL AND prop_minority IS NOT NULL GROUP BY {G}, bin HAVING count(*) >= 10
""")
def a35(spark, sf):
    return rounded(bins.mismatch_errors(base.precinct_rows(spark, sf)))


view("fx_sized", "SELECT *, log10(CAST(population + 1 AS DOUBLE)) AS lp FROM fx_rows WHERE er_minority_error_precinct IS NOT NULL")
view("fx_size_breaks", f"SELECT {', '.join(f'quantile_cont(lp, {i / 5}) AS b{i}' for i in range(6))} FROM fx_sized")
view("fx_quintiles", """
SELECT s.*, CASE WHEN lp <= b1 THEN 1 WHEN lp <= b2 THEN 2 WHEN lp <= b3 THEN 3 WHEN lp <= b4 THEN 4 ELSE 5 END AS quintile
FROM fx_sized s, fx_size_breaks
""")


@query("a36_error_by_population_quintile", f"""
SELECT {G}, quintile, model, {R('avg(e)', 'mean_error')}, count(*) AS n FROM (
  SELECT {G}, quintile, 'ER' AS model, er_minority_error_precinct AS e FROM fx_quintiles
  UNION ALL SELECT {G}, quintile, 'EI' AS model, ei_minority_error_precinct AS e FROM fx_quintiles) t GROUP BY {G}, quintile, model
""")
def a36(spark, sf):
    return rounded(bins.size_errors(base.precinct_rows(spark, sf)))


@query("a46_square_bins", f"""
SELECT {G}, true_rpv, CAST(floor(prop_minority / {number(1 / 15)}) AS BIGINT) AS x_bin, CAST(floor(prop_dem / {number(1 / 15)}) AS BIGINT) AS y_bin, count(*) AS n
FROM fx_results GROUP BY ALL
""")
def a46(spark, sf):
    return bins.square_bins(base.results(spark, sf), "prop_minority", "prop_dem", 1 / 15, [*SCENARIO, "true_rpv"])


@query("a47_line_bins", f"SELECT {G}, CAST(floor({_M} / 0.02e0) AS BIGINT) AS bin, count(*) AS n FROM fx_results GROUP BY {G}, bin")
def a47(spark, sf):
    return bins.line_bins(base.results(spark, sf), waste.dem_margin(), 0.02, SCENARIO)


# Composition classes of precincts.
_A1 = [0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0]
_A1_LABELS = ["0-10%", "10-30%", "30-50%", "50-70%", "70-90%", "90-100%"]


@query("p08_drop_incomplete_rows", f"""
SELECT unique_id, bin, {R('prop_minority')} FROM (SELECT unique_id, prop_minority, er_minority_error_precinct,
  {cut_sql('prop_minority_precinct', _A1, _A1_LABELS)} AS bin FROM fx_rows) t
WHERE bin IS NOT NULL AND prop_minority IS NOT NULL AND er_minority_error_precinct IS NOT NULL
""")
def p08(spark, sf):
    rows = base.precinct_rows(spark, sf).select(
        "unique_id", "prop_minority", "er_minority_error_precinct",
        cut("prop_minority_precinct", _A1, _A1_LABELS).alias("bin"))
    return rounded(rows.dropna().drop("er_minority_error_precinct"))


@query("f07_interval_bins", f"""
SELECT precinct_id, {cut_sql('per_minority', bins.TWENTIETHS)} AS right_closed,
  {cut_sql('per_minority', bins.TWENTIETHS, right=False)} AS left_closed,
  {cut_sql('per_minority', bins.TWENTIETHS, include_lowest=True)} AS with_lowest,
  {cut_sql('per_minority', bins.TWENTIETHS, right=False, include_lowest=True)} AS with_highest FROM fx_precincts
""")
def f07(spark, sf):
    x = "per_minority"
    return fx.precincts(spark, sf).select(
        "precinct_id", cut(x, bins.TWENTIETHS).alias("right_closed"),
        cut(x, bins.TWENTIETHS, right=False).alias("left_closed"),
        cut(x, bins.TWENTIETHS, include_lowest=True).alias("with_lowest"),
        cut(x, bins.TWENTIETHS, right=False, include_lowest=True).alias("with_highest"))


