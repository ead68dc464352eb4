"""Unions, pivots, grids and expansions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardwise import fixtures as fx
from wardwise.catalog import base
from wardwise.catalog.base import DK
from wardwise.catalog.registry import R, div, query, rounded
from wardwise.catalog.tables import G
from wardwise.functions import ifelse
from wardwise.operators import report, shapes
from wardwise.schemas import DISTRICT, SCENARIO


@query("u01_union_of_scenarios", f"SELECT {DK}, n_precincts FROM fx_results")
def u01(spark, sf):
    rows = base.results(spark, sf).select(*DISTRICT, "n_precincts")
    return shapes.union_all([rows.where(F.col("seg_level") == s) for s in ("low", "medium", "high")])


@query("u02_union_with_missing_columns", f"""
SELECT {DK}, er_rpv, NULL::INTEGER AS ei_rpv FROM fx_results UNION ALL SELECT {DK}, NULL::INTEGER AS er_rpv, ei_rpv FROM fx_results
""")
def u02(spark, sf):
    rows = base.results(spark, sf)
    return shapes.union_all([rows.select(*DISTRICT, "er_rpv"), rows.select(*DISTRICT, "ei_rpv")])


@query("u03_tagged_union", "SELECT category, block_id, population FROM fx_blocks")
def u03(spark, sf):
    blocks = fx.blocks(spark, sf)
    parts = {c: blocks.where(F.col("category") == c).select("block_id", "population") for c in ("low", "medium", "high")}
    return shapes.union_all(parts, tag="category")


@query("u04_keys_minus", "SELECT p_partkey AS precinct_id FROM part EXCEPT SELECT precinct_id FROM fx_precincts WHERE dem_votes > rep_votes")
def u04(spark, sf):
    part = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("precinct_id"))
    return shapes.keys_minus(part, fx.precincts(spark, sf).where(F.col("dem_votes") > F.col("rep_votes")), ["precinct_id"])


@query("u04_keys_in", "SELECT p_partkey AS precinct_id FROM part INTERSECT SELECT precinct_id FROM fx_precincts WHERE dem_votes > rep_votes")
def u04i(spark, sf):
    part = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("precinct_id"))
    return shapes.keys_in(part, fx.precincts(spark, sf).where(F.col("dem_votes") > F.col("rep_votes")), ["precinct_id"])


def wide_plans(spark, sf):
    return shapes.plans_to_wide(fx.assignments(spark, sf), range(1, fx.N_PLANS + 1))


@query("u05_wide_to_long", "SELECT map_id, 'step_' || map_id AS plan_name, precinct_id, district_id FROM fx_assignments")
def u05(spark, sf):
    return shapes.plans_to_long(wide_plans(spark, sf))


@query("u05_long_to_wide", "SELECT precinct_id, " + ", ".join(
    f"max(CASE WHEN map_id = {i} THEN district_id END) AS step_{i}" for i in range(1, fx.N_PLANS + 1)) + " FROM fx_assignments GROUP BY precinct_id")
def u05w(spark, sf):
    return wide_plans(spark, sf)


@query("u06_pivot_two_columns", f"""
SELECT {DK}, 'ER' AS model, er_rpv_correct AS correct FROM fx_results UNION ALL SELECT {DK}, 'EI' AS model, ei_rpv_correct AS correct FROM fx_results
""")
def u06(spark, sf):
    long = base.results(spark, sf).unpivot(DISTRICT, ["er_rpv_correct", "ei_rpv_correct"], "model", "correct")
    return long.withColumn("model", ifelse(F.col("model") == "er_rpv_correct", F.lit("ER"), F.lit("EI")))


@query("u07_pivot_by_name_pattern", " UNION ALL ".join(
    f"""SELECT {DK}, '{g}' AS "group", '{p}' AS party, '{k}' AS vote_type, {R(f'{g}_{p}_wasted_{k}', 'votes')} FROM fx_results"""
    for g in ("minority", "majority") for p in ("dem", "rep") for k in ("surplus", "losing")))
def u07(spark, sf):
    pattern = "(minority|majority)_(dem|rep)_wasted_(surplus|losing)"
    return rounded(shapes.melt_pattern(base.results(spark, sf), pattern, ["group", "party", "vote_type"], "votes", DISTRICT))


@query("u08_pair_truth_estimate", " UNION ALL ".join(
    f"""SELECT {DK}, '{g}' AS "group", '{m.upper()}' AS model, {R(f'true_{g}_dem_share', 'true')}, {R(f'{m}_{g}_dem_share', 'estimate')} FROM fx_results"""
    for g in ("minority", "majority") for m in ("er", "ei")))
def u08(spark, sf):
    return rounded(shapes.pair_truth_estimate(base.results(spark, sf), DISTRICT))


@query("u09_scenario_crosstab", f"""
SELECT seg_level, {', '.join(R(f"max(CASE WHEN redist_level = '{k}' THEN m END)", k) for k in ('dem', 'middle', 'rep'))}
FROM (SELECT {G}, avg({div('minority_wasted_total - majority_wasted_total', 'total_population')}) AS m FROM fx_results GROUP BY {G}) t GROUP BY seg_level
""")
def u09(spark, sf):
    gap = (F.col("minority_wasted_total") - F.col("majority_wasted_total")) / F.col("total_population")
    means = base.results(spark, sf).groupBy(*SCENARIO).agg(F.avg(gap).alias("m"))
    return rounded(report.scenario_crosstab(means, "m"))


@query("u10_stack_estimators", f"""
SELECT {DK}, method, {R('e1', 'estimate_minority')}, {R('e0', 'estimate_majority')}, {R('r1', 'resid_minority')}, {R('r0', 'resid_majority')}, rpv, ok AS rpv_correct FROM fx_stacked
""")
def u10(spark, sf):
    return rounded(report.stack_estimators(base.results(spark, sf), DISTRICT))


@query("u11_grid", """
SELECT r.row, c.col FROM (SELECT unnest(range(1, (SELECT max(row_no) FROM fx_cells) + 2)) AS row) r, (SELECT unnest(range(1, (SELECT max(col) FROM fx_cells) + 2)) AS col) c
""")
def u11(spark, sf):
    size = fx.cells(spark, sf).agg(F.max("row_no"), F.max("col")).first()
    return shapes.grid(spark, size[0] + 1, size[1] + 1)


@query("u12_expand_counts", """
SELECT precinct_id, j AS position, CAST(j <= n_minority AS BIGINT) AS race FROM (SELECT precinct_id, n_minority, unnest(range(1, population + 1)) AS j FROM fx_precincts) t
""")
def u12(spark, sf):
    return shapes.expand_counts(fx.precincts(spark, sf), "population", "n_minority", "precinct_id")


