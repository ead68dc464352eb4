"""Frames shared by the registered queries, and their SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardwise import fixtures as fx
from wardwise.catalog.registry import cut_sql, div, view  # noqa: F401
from wardwise.operators.frames import precinct_stats
from wardwise.plans import results as res


def units(spark: SparkSession, sf: str) -> DataFrame:
    return precinct_stats(fx.assignments(spark, sf), fx.precincts(spark, sf))


def results_all(spark: SparkSession, sf: str) -> DataFrame:
    """District results before a plan listed twice is reduced to one scenario."""
    return fx.stored(spark, sf, "results_all", lambda: res.under_labels(unlabelled(spark, sf), fx.labels(spark, sf)))


def results(spark: SparkSession, sf: str) -> DataFrame:
    return fx.stored(spark, sf, "results", lambda: res.one_scenario_per_plan(results_all(spark, sf)))


def precinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Not stored, so that a query makes only the columns that it reads."""
    return res.plan_precinct_results(fx.assignments(spark, sf), fx.precincts(spark, sf), unlabelled(spark, sf))


def unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    """District results under each plan's own scenario only."""
    return fx.stored(spark, sf, "results_own", lambda: res.district_results(fx.drawn_units(spark, sf)))


DK = "map_id, seg_level, redist_level, district_id"

view("fx_truth", f"""
SELECT *, CASE WHEN true_minority_dem_share IS NULL OR true_majority_dem_share IS NULL THEN NULL
    WHEN (true_minority_dem_share > 0.5 AND true_majority_dem_share < 0.5)
      OR (true_minority_dem_share < 0.5 AND true_majority_dem_share > 0.5) THEN 1 ELSE 0 END AS true_rpv
FROM (SELECT {DK},
  CAST(sum(population) AS BIGINT) AS total_population, CAST(sum(n_minority) AS BIGINT) AS total_minority,
  CAST(sum(n_majority) AS BIGINT) AS total_majority, CAST(sum(dem_votes) AS BIGINT) AS total_dem_votes,
  CAST(sum(rep_votes) AS BIGINT) AS total_rep_votes,
  CAST(sum(dem_votes_minority) AS BIGINT) AS true_minority_dem_votes,
  CAST(sum(dem_votes_majority) AS BIGINT) AS true_majority_dem_votes,
  {div('sum(dem_votes_minority)', 'sum(n_minority)')} AS true_minority_dem_share,
  {div('sum(dem_votes_majority)', 'sum(n_majority)')} AS true_majority_dem_share,
  {div('sum(dem_votes)', 'sum(population)')} AS true_overall_dem_share,
  count(*) AS n_precincts
FROM fx_units GROUP BY {DK}) t
""")
view("fx_norm", f"""
SELECT *, a11 * a22 - a12 * a12 AS det FROM (
  SELECT {DK}, count(*) AS n_rows, count(*) FILTER (WHERE population > 0) AS n,
    sum(w * x1 * x1) AS a11, sum(w * x1 * x2) AS a12, sum(w * x2 * x2) AS a22,
    sum(w * x1 * y) AS b1, sum(w * x2 * y) AS b2
  FROM (SELECT *, CAST(population AS DOUBLE) AS w, {div('n_minority', 'population')} AS x1,
          {div('n_majority', 'population')} AS x2, {div('dem_votes', 'population')} AS y FROM fx_units) s
  GROUP BY {DK}) g
""")
view("fx_beta", f"""
SELECT {DK}, n, a11, a22, det, (a22 * b1 - a12 * b2) / det AS beta1, (a11 * b2 - a12 * b1) / det AS beta2
FROM fx_norm WHERE n_rows >= 3 AND det > 1e-14 * a11 * a22
""")
view("fx_er", f"""
SELECT *, CASE WHEN (er_minority_dem_share > 0.5 AND er_majority_dem_share < 0.5)
    OR (er_minority_dem_share < 0.5 AND er_majority_dem_share > 0.5) THEN 1 ELSE 0 END AS er_rpv
FROM (
  SELECT b.map_id, b.seg_level, b.redist_level, b.district_id,
    any_value(beta1) AS er_minority_dem_share, any_value(beta2) AS er_majority_dem_share,
    sqrt(sum(population * power(y - beta1 * x1 - beta2 * x2, 2)) / (any_value(n) - 2) * any_value(a22) / any_value(det)) AS er_minority_se,
    sqrt(sum(population * power(y - beta1 * x1 - beta2 * x2, 2)) / (any_value(n) - 2) * any_value(a11) / any_value(det)) AS er_majority_se
  FROM fx_beta b JOIN (SELECT *, {div('n_minority', 'population')} AS x1, {div('n_majority', 'population')} AS x2,
      {div('dem_votes', 'population')} AS y FROM fx_units) u
    ON u.map_id = b.map_id AND u.seg_level = b.seg_level AND u.redist_level = b.redist_level AND u.district_id = b.district_id
  GROUP BY ALL) e
""")
view("fx_rates", """
SELECT d.map_id, d.seg_level, d.redist_level, d.district_id, d.draw,
  sum(beta_min * n_minority) / nullif(sum(n_minority), 0) AS minority_rate,
  sum(beta_maj * n_majority) / nullif(sum(n_majority), 0) AS majority_rate
FROM fx_draws d JOIN fx_precincts p ON p.precinct_id = d.precinct_id
GROUP BY d.map_id, d.seg_level, d.redist_level, d.district_id, d.draw
""")
view("fx_ei", f"""
SELECT *, CASE WHEN ei_minority_dem_share IS NULL OR ei_majority_dem_share IS NULL THEN NULL
    WHEN (ei_minority_dem_share > 0.5 AND ei_majority_dem_share < 0.5)
    OR (ei_minority_dem_share < 0.5 AND ei_majority_dem_share > 0.5) THEN 1 ELSE 0 END AS ei_rpv
FROM (SELECT {DK}, avg(minority_rate) AS ei_minority_dem_share, avg(majority_rate) AS ei_majority_dem_share,
  stddev_samp(minority_rate) AS ei_minority_sd, stddev_samp(majority_rate) AS ei_majority_sd
  FROM fx_rates GROUP BY {DK}) e
""")


def _packed(group: str, party: str) -> str:
    own = f"true_{group}_dem_votes" if party == "dem" else f"(total_{group} - true_{group}_dem_votes)"
    won = "dem_district" if party == "dem" else "NOT dem_district"
    share = div(f"votes_to_win * {own}", f"total_{party}_votes")
    return (
        f"CASE WHEN {won} THEN CASE WHEN {share} IS NULL THEN NULL ELSE greatest(0e0, {own} - {share}) END "
        f"WHEN NOT ({won}) THEN 0e0 END AS {group}_{party}_packed, "
        f"CASE WHEN NOT ({won}) THEN {own} WHEN {won} THEN 0 END AS {group}_{party}_cracked"
    )


_PACKED = ", ".join(_packed(g, p) for g in ("minority", "majority") for p in ("dem", "rep"))
view("fx_packed", f"""
SELECT *, packed_min_votes + packed_maj_votes AS packed_votes, cracked_min_votes + cracked_maj_votes AS cracked_votes,
  packed_min_votes + packed_maj_votes + cracked_min_votes + cracked_maj_votes AS total_wasted,
  {div('packed_min_votes + cracked_min_votes', 'total_minority')} AS minority_waste_rate,
  {div('packed_maj_votes + cracked_maj_votes', 'total_majority')} AS majority_waste_rate,
  {div('packed_min_votes + cracked_min_votes', 'total_minority')} - {div('packed_maj_votes + cracked_maj_votes', 'total_majority')} AS waste_disparity,
  packed_min_votes + cracked_min_votes AS minority_wasted_total, packed_maj_votes + cracked_maj_votes AS majority_wasted_total
FROM (SELECT *, minority_dem_packed + minority_rep_packed AS packed_min_votes,
        minority_dem_cracked + minority_rep_cracked AS cracked_min_votes,
        majority_dem_packed + majority_rep_packed AS packed_maj_votes,
        majority_dem_cracked + majority_rep_cracked AS cracked_maj_votes
      FROM (SELECT *, {_PACKED} FROM (
        SELECT *, prop_dem > 0.5 AS dem_district,
          CAST(floor(CAST(total_population AS DOUBLE) / 2) + 1 AS BIGINT) AS votes_to_win
        FROM (SELECT *, {div('total_dem_votes', '(total_dem_votes + total_rep_votes)')} AS prop_dem FROM fx_truth) a) b) c) d
""")


def _surplus(group: str, party: str) -> str:
    own = f"true_{group}_dem_votes" if party == "dem" else f"(total_{group} - true_{group}_dem_votes)"
    won = "dem_district" if party == "dem" else "NOT dem_district"
    total = f"total_{party}_votes"
    share = div(f"{own} * ({total} - need)", total)
    return (
        f"CASE WHEN {won} AND {total} > 0 THEN greatest(0e0, {share}) ELSE 0e0 END AS {group}_{party}_wasted_surplus, "
        f"CASE WHEN NOT ({won}) THEN CAST({own} AS DOUBLE) ELSE 0e0 END AS {group}_{party}_wasted_losing"
    )


_SURPLUS = ", ".join(_surplus(g, p) for g in ("minority", "majority") for p in ("dem", "rep"))
view("fx_surplus", f"""
SELECT {DK}, {_SURPLUS},
  CASE WHEN dem_district THEN CAST(greatest(0, total_dem_votes - need) AS DOUBLE) ELSE 0e0 END AS dem_wasted_surplus,
  CASE WHEN NOT dem_district THEN CAST(total_dem_votes AS DOUBLE) ELSE 0e0 END AS dem_wasted_losing,
  CASE WHEN NOT dem_district THEN CAST(greatest(0, total_rep_votes - need) AS DOUBLE) ELSE 0e0 END AS rep_wasted_surplus,
  CASE WHEN dem_district THEN CAST(total_rep_votes AS DOUBLE) ELSE 0e0 END AS rep_wasted_losing
FROM (SELECT *, floor(CAST(total_dem_votes + total_rep_votes AS DOUBLE) / 2) + 1 AS need FROM fx_packed) p
""")


def strict_sql(m: str) -> str:
    t1, t0 = "true_minority_dem_share", "true_majority_dem_share"
    e1, e0 = f"{m}_minority_dem_share", f"{m}_majority_dem_share"
    same = (f"(({t1} > 0.5 AND {t0} < 0.5 AND {e1} > 0.5 AND {e0} < 0.5) OR "
            f"({t1} < 0.5 AND {t0} > 0.5 AND {e1} < 0.5 AND {e0} > 0.5))")
    return f"CASE WHEN {same} THEN 1 WHEN NOT {same} THEN 0 END AS {m}_rpv_correct"


_OWN_COLUMNS = ", ".join(c for c in res.RESULT_COLUMNS if c != "unique_id")
view("fx_own", f"""
SELECT *, er_minority_dem_share - true_minority_dem_share AS er_minority_resid,
  er_majority_dem_share - true_majority_dem_share AS er_majority_resid,
  ei_minority_dem_share - true_minority_dem_share AS ei_minority_resid,
  ei_majority_dem_share - true_majority_dem_share AS ei_majority_resid,
  {strict_sql('er')}, {strict_sql('ei')}, {div('total_minority', 'total_population')} AS prop_minority
FROM (SELECT p.*, er_minority_dem_share, er_majority_dem_share, er_minority_se, er_majority_se, er_rpv,
        ei_minority_dem_share, ei_majority_dem_share, ei_minority_sd AS ei_minority_se,
        ei_majority_sd AS ei_majority_se, ei_rpv, s.* EXCLUDE ({DK})
      FROM fx_packed p JOIN fx_er USING ({DK}) LEFT JOIN fx_ei USING ({DK}) JOIN fx_surplus s USING ({DK})) j
""")
view("fx_results_all", f"""
SELECT concat_ws('_', map_id, district_id, seg_level, redist_level) AS unique_id, {_OWN_COLUMNS}
FROM (SELECT o.* EXCLUDE (redist_level), l.redist_level FROM fx_own o
      JOIN fx_labels l ON l.map_id = o.map_id AND l.seg_level = o.seg_level) x
""")
view("fx_results", """
SELECT * FROM fx_results_all WHERE (seg_level, map_id, redist_level) IN
  (SELECT (seg_level, map_id, min(redist_level)) FROM fx_results_all GROUP BY seg_level, map_id)
""")
view("fx_seats", """
SELECT *, CAST(sum(CASE WHEN prop_dem > 0.5 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_dem_seats,
  CAST(sum(CASE WHEN prop_dem < 0.5 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_rep_seats,
  CAST(sum(CASE WHEN prop_minority > 0.5 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_maj_min
FROM fx_results WINDOW w AS (PARTITION BY map_id, seg_level, redist_level)
""")


def _flag(a: str, b: str) -> str:
    return (f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN ({a} > 0.5 AND {b} < 0.5) OR "
            f"({a} < 0.5 AND {b} > 0.5) THEN 1 ELSE 0 END")


view("fx_rows", f"""
SELECT *, CASE WHEN er_rpv_precinct = true_rpv_precinct THEN 1 WHEN er_rpv_precinct <> true_rpv_precinct THEN 0 END AS er_rpv_correct_precinct,
  CASE WHEN ei_rpv_precinct = true_rpv_precinct THEN 1 WHEN ei_rpv_precinct <> true_rpv_precinct THEN 0 END AS ei_rpv_correct_precinct,
  abs(er_minority_dem_share - true_minority_dem_share_precinct) AS er_minority_error_precinct,
  abs(er_majority_dem_share - true_majority_dem_share_precinct) AS er_majority_error_precinct,
  abs(ei_minority_dem_share - true_minority_dem_share_precinct) AS ei_minority_error_precinct,
  abs(ei_majority_dem_share - true_majority_dem_share_precinct) AS ei_majority_error_precinct,
  er_minority_dem_share AS er_pred_minority_share_precinct, er_majority_dem_share AS er_pred_majority_share_precinct,
  ei_minority_dem_share AS ei_pred_minority_share_precinct, ei_majority_dem_share AS ei_pred_majority_share_precinct
FROM (SELECT *, {_flag('true_minority_dem_share_precinct', 'true_majority_dem_share_precinct')} AS true_rpv_precinct,
    {_flag('er_minority_dem_share', 'er_majority_dem_share')} AS er_rpv_precinct,
    {_flag('ei_minority_dem_share', 'ei_majority_dem_share')} AS ei_rpv_precinct
  FROM (SELECT u.*, o.prop_minority, o.prop_dem, o.er_minority_dem_share, o.er_majority_dem_share, o.er_rpv,
      o.ei_minority_dem_share, o.ei_majority_dem_share, o.ei_rpv,
      {div('dem_votes_minority', 'n_minority')} AS true_minority_dem_share_precinct,
      {div('dem_votes_majority', 'n_majority')} AS true_majority_dem_share_precinct,
      {div('dem_votes', 'population')} AS true_overall_dem_share_precinct,
      {div('n_minority', 'population')} AS prop_minority_precinct,
      {div('dem_votes', '(dem_votes + rep_votes)')} AS prop_dem_precinct,
      concat_ws('_', u.map_id, u.district_id, u.precinct_id, u.seg_level, u.redist_level) AS unique_id
    FROM fx_units u LEFT JOIN fx_own o ON o.map_id = u.map_id AND o.seg_level = u.seg_level
      AND o.redist_level = u.redist_level AND o.district_id = u.district_id
    WHERE (u.map_id, u.seg_level) IN (SELECT (map_id, seg_level) FROM fx_own)) a) b
""")
