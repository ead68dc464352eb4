"""Joins, projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardwise import fixtures as fx
from wardwise import functions as fn
from wardwise.catalog import base
from wardwise.catalog.base import DK
from wardwise.catalog.registry import R, div, query, r, rounded, rs
from wardwise.catalog.tables import MK
from wardwise.catalog.truth import district_table, map_table
from wardwise.operators import frames, inference, ordered, regression, shapes
from wardwise.plans import ensemble
from wardwise.plans import results as res
from wardwise.schemas import COUNTS, DISTRICT, PLAN

_COUNTS = ", ".join(COUNTS)


@query("j01_precinct_stats", f"SELECT {DK}, precinct_id, {_COUNTS} FROM fx_units")
def j01(spark, sf):
    return base.units(spark, sf).select(*DISTRICT, "precinct_id", *COUNTS)


@query("j02_plans_in_results", f"SELECT {DK}, precinct_id, population FROM fx_units WHERE map_id IN (SELECT map_id FROM fx_mapsum WHERE n_dem_districts >= 8)")
def j02(spark, sf):
    chosen = map_table(spark, sf).where(F.col("n_dem_districts") >= 8)
    kept = frames.keep_plans(fx.assignments(spark, sf), chosen)
    return frames.precinct_stats(kept, fx.precincts(spark, sf)).select(*DISTRICT, "precinct_id", "population")


def both_estimates(spark, sf):
    """Regression and draw summaries of each district, from one pass over the plan rows."""
    totals = frames.district_totals(moments=True)
    return regression.add_regression(inference.summarise_draws(fx.drawn_units(spark, sf), None, DISTRICT, totals))


@query("j03_district_results_on_precincts", f"""
SELECT u.map_id, u.district_id, u.precinct_id, {R('er_minority_dem_share')}, {R('er_majority_dem_share')}, {R('ei_minority_dem_share')}, {R('ei_majority_dem_share')}
FROM fx_units u LEFT JOIN fx_er e ON e.map_id = u.map_id AND e.district_id = u.district_id LEFT JOIN fx_ei i ON i.map_id = u.map_id AND i.district_id = u.district_id
""")
def j03(spark, sf):
    shares = [f"{m}_{s}" for m in ("er", "ei") for s in ("minority_dem_share", "majority_dem_share")]
    rows = frames.attach_districts(base.units(spark, sf), both_estimates(spark, sf), shares)
    return rounded(rows.select("map_id", "district_id", "precinct_id", *shares))


@query("j04_regression_with_inference", f"""
SELECT concat_ws('_', map_id, district_id, seg_level, redist_level) AS unique_id, {rs('er_minority_dem_share', 'ei_minority_dem_share')} FROM fx_er LEFT JOIN fx_ei USING ({DK})
""")
def j04(spark, sf):
    found = both_estimates(spark, sf).where(F.col("er_minority_dem_share").isNotNull())
    out = found.withColumn("unique_id", frames.unique_id("map_id", "district_id", "seg_level", "redist_level"))
    return rounded(out.select("unique_id", "er_minority_dem_share", "ei_minority_dem_share"))


@query("j05_results_with_waste", f"SELECT {DK}, {rs('er_minority_dem_share', 'minority_waste_rate', 'majority_waste_rate')} FROM fx_er LEFT JOIN fx_packed USING ({DK})")
def j05(spark, sf):
    from wardwise.operators.waste import packed_cracked

    units = base.units(spark, sf)
    lost = packed_cracked(frames.district_truth(units)).select(*DISTRICT, "minority_waste_rate", "majority_waste_rate")
    out = regression.ecological_regression(units).join(lost, DISTRICT, "left")
    return rounded(out.select(*DISTRICT, "er_minority_dem_share", "minority_waste_rate", "majority_waste_rate"))


@query("j06_external_estimates", f"""
SELECT r.unique_id, {R('d.bb', 'ei_minority_dem_share')}, {R('d.bw', 'ei_majority_dem_share')} FROM fx_rows r LEFT JOIN
  (SELECT map_id, seg_level, district_id, precinct_id, avg(beta_min) AS bb, avg(beta_maj) AS bw FROM fx_draws GROUP BY ALL) d USING (map_id, seg_level, district_id, precinct_id)
""")
def j06(spark, sf):
    keys = [F.col("map_id").alias("plan"), F.col("seg_level").alias("scenario"), (F.col("district_id") + 1).alias("district_id"), "precinct_id"]
    summary = fx.draws(spark, sf).groupBy(*keys).agg(F.avg("beta_min").alias("ei.beta.b"), F.avg("beta_maj").alias("ei.beta.w"))
    out = res.with_external_estimates(base.precinct_rows(spark, sf), summary)
    return rounded(out.select("unique_id", "ei_minority_dem_share", "ei_majority_dem_share"))


@query("j07_chosen_scenario_rows", f"SELECT unique_id, {DK} FROM fx_results")
def j07(spark, sf):
    return res.one_scenario_per_plan(base.results_all(spark, sf)).select("unique_id", *DISTRICT)


@query("j08_remaining_plans", f"SELECT DISTINCT {MK} FROM fx_assignments WHERE map_id NOT IN (SELECT map_id FROM fx_mapsum WHERE n_dem_districts >= 8)")
def j08(spark, sf):
    done = map_table(spark, sf).where(F.col("n_dem_districts") >= 8)
    return shapes.keys_minus(fx.assignments(spark, sf).select(*PLAN).distinct(), done, ["map_id"])


@query("j11_aligned_units", f"SELECT {MK}, count(*) AS n_units FROM fx_units GROUP BY {MK}")
def j11(spark, sf):
    aligned = frames.align(fx.assignments(spark, sf), fx.precincts(spark, sf))
    return aligned.groupBy(*PLAN).agg(F.count(F.lit(1)).alias("n_units"))


@query("j12_rank_match", """
SELECT u.precinct_id, c.cell FROM (SELECT precinct_id, row_number() OVER (ORDER BY per_minority DESC, precinct_id) AS rn FROM fx_precincts) u
JOIN (SELECT precinct_id AS cell, row_number() OVER (ORDER BY row_no, col, precinct_id) AS rn FROM fx_cells) c USING (rn)
""")
def j12(spark, sf):
    places = fx.cells(spark, sf).withColumnRenamed("precinct_id", "cell")
    out = frames.rank_match(fx.precincts(spark, sf), places, [F.col("per_minority").desc(), F.col("precinct_id")], ["row_no", "col", "cell"])
    return out.select("precinct_id", "cell")


@query("j13_district_figures_on_units", f"""
SELECT u.map_id, u.precinct_id, {R('u.per_minority', 'per_minority_precinct')}, {R('d.per_minority', 'per_minority_district')}, d.dem_district
FROM fx_units u JOIN fx_districts d USING ({DK})
""")
def j13(spark, sf):
    out = frames.attach_districts(base.units(spark, sf), district_table(spark, sf), ["per_minority", "dem_district"])
    return rounded(out.select("map_id", "precinct_id", "per_minority_precinct", "per_minority_district", "dem_district"))


@query("j14_estimate_with_truth", f"SELECT {DK}, {rs('ei_minority_dem_share', 'true_minority_dem_share')} FROM fx_ei JOIN fx_truth USING ({DK})")
def j14(spark, sf):
    out = inference.inference_from_draws(fx.drawn_units(spark, sf))
    return rounded(out.select(*DISTRICT, "ei_minority_dem_share", "true_minority_dem_share"))


@query("j15_decile_lookup", f"""
SELECT block_id, decile, {R('count(*) OVER (PARTITION BY decile) / CAST(count(*) OVER () AS DOUBLE)', 'prop')}
FROM (SELECT block_id, ntile(10) OVER (ORDER BY per_minority, block_id) AS decile FROM fx_blocks) t
""")
def j15(spark, sf):
    blocks = fx.blocks(spark, sf)
    profile = ordered.decile_profile(blocks, "per_minority", "block_id")
    tiles = ordered.with_ntile(blocks.select("block_id", "per_minority"), ["per_minority", "block_id"], 10, "decile")
    return rounded(tiles.join(profile.select("decile", "prop"), "decile").select("block_id", "decile", "prop"))


@query("p01_one_plan", "SELECT precinct_id, district_id FROM fx_assignments WHERE map_id = 7")
def p01(spark, sf):
    return frames.one_plan(fx.assignments(spark, sf), 7)


@query("p02_columns_by_prefix", f"SELECT {rs('er_minority_dem_share', 'er_majority_dem_share', 'er_minority_se', 'er_majority_se', 'er_minority_resid', 'er_majority_resid')}, er_rpv, er_rpv_correct, unique_id FROM fx_results")
def p02(spark, sf):
    rows = base.results(spark, sf)
    return rounded(rows.select("unique_id", *[c for c in rows.columns if c.startswith("er_")]))


@query("p03_derived_columns", f"SELECT precinct_id, {R(div('n_minority', 'population'), 'minority_share')}, {R(div('n_majority', 'population'), 'majority_share')} FROM fx_precincts")
def p03(spark, sf):
    out = fx.precincts(spark, sf).withColumns({
        "minority_share": fn.try_div("n_minority", "population"), "majority_share": fn.try_div("n_majority", "population")})
    return rounded(out.select("precinct_id", "minority_share", "majority_share"))


@query("p06_plans_of_a_class", f"SELECT {DK}, population FROM fx_districts WHERE map_id IN (SELECT map_id FROM fx_tails WHERE category = 'top_rep')")
def p06(spark, sf):
    top = ensemble.tail_classes(map_table(spark, sf)).where(F.col("category") == "top_rep")
    return shapes.keys_in(district_table(spark, sf), top, ["map_id"]).select(*DISTRICT, "population")


@query("p09_missing_shares_to_zero", f"SELECT precinct_id, {R('coalesce(dem_voteshare_minority, 0)', 'dem_voteshare_minority')}, {R('coalesce(dem_voteshare_majority, 0)', 'dem_voteshare_majority')} FROM fx_precincts")
def p09(spark, sf):
    shares = ["dem_voteshare_minority", "dem_voteshare_majority"]
    return rounded(fx.precincts(spark, sf).fillna(0.0, shares).select("precinct_id", *shares))


@query("p10_dummy_columns", f"""
SELECT {DK}, CAST(seg_level = 'medium' AS BIGINT) AS seg_medium, CAST(seg_level = 'high' AS BIGINT) AS seg_high,
  CAST(redist_level = 'dem' AS BIGINT) AS redis_dem, CAST(redist_level = 'rep' AS BIGINT) AS redis_rep FROM fx_results
""")
def p10(spark, sf):
    from wardwise.operators.models import scenario_dummies

    return base.results(spark, sf).withColumns(scenario_dummies()).select(*DISTRICT, "seg_medium", "seg_high", "redis_dem", "redis_rep")


@query("p12_misclassified_districts", f"SELECT {DK}, 'ER' AS model FROM fx_results WHERE er_rpv_correct = 0 UNION ALL SELECT {DK}, 'EI' AS model FROM fx_results WHERE ei_rpv_correct = 0")
def p12(spark, sf):
    from wardwise.operators.report import stack_estimators

    rows = stack_estimators(base.results(spark, sf), DISTRICT)
    return rows.where(F.col("rpv_correct") == 0).select(*DISTRICT, F.col("method").alias("model"))


# ---------------------------------------------------------- scalar functions
@query("f01_arithmetic", f"""
SELECT precinct_id, {R('sqrt(population)', 'a')}, {R('power(population, 2)', 'b')}, {R('ln(population)', 'c')}, {R('log10(population)', 'd')},
  {R('log2(population)', 'e')}, {R('exp(per_minority)', 'f')}, CAST(sign(dem_votes - rep_votes) AS DOUBLE) AS g, CAST(floor(population / 2e0) AS BIGINT) AS h,
  CAST(ceil(population / 3e0) AS BIGINT) AS i, CAST(round_even(population / 2e0, 0) AS BIGINT) AS j, abs(dem_votes - rep_votes) AS k FROM fx_precincts
""")
def f01(spark, sf):
    n, gap = F.col("population"), F.col("dem_votes") - F.col("rep_votes")
    return fx.precincts(spark, sf).select(
        "precinct_id", r(F.sqrt(n)).alias("a"), r(F.pow(n, 2)).alias("b"), r(F.ln(n)).alias("c"), r(F.log10(n)).alias("d"),
        r(F.log2(n)).alias("e"), r(F.exp("per_minority")).alias("f"), F.signum(gap).alias("g"), F.floor(n / 2).alias("h"),
        F.ceil(n / 3).alias("i"), F.bround(n / 2).cast("bigint").alias("j"), F.abs(gap).alias("k"))


_P = "greatest(1e-6, least(1 - 1e-6, per_minority))"


@query("f02_logit", f"SELECT precinct_id, {R(f'ln({_P} / (1 - {_P}))', 'logit')}, {R('1 / (1 + exp(-(dem_voteshare)))', 'inv_logit')} FROM fx_precincts")
def f02(spark, sf):
    return fx.precincts(spark, sf).select("precinct_id", r(fn.logit("per_minority")).alias("logit"), r(fn.inv_logit("dem_voteshare")).alias("inv_logit"))


@query("f04_euclid", f"SELECT precinct_id, {R('sqrt(power(col - 25, 2) + power(row_no - 10, 2))', 'distance')} FROM fx_cells")
def f04(spark, sf):
    return fx.cells(spark, sf).select("precinct_id", r(fn.euclid("col", "row_no", F.lit(25), F.lit(10))).alias("distance"))


@query("f05_row_extremes", f"""
SELECT precinct_id, {R('CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END', 'hi')}, {R('CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END', 'lo')}
FROM (SELECT precinct_id, dem_voteshare_minority AS a, dem_voteshare_majority AS b FROM fx_precincts) t
""")
def f05(spark, sf):
    a, b = "dem_voteshare_minority", "dem_voteshare_majority"
    return fx.precincts(spark, sf).select("precinct_id", r(fn.pmax(a, b)).alias("hi"), r(fn.pmin(a, b)).alias("lo"))


@query("f06_conditionals", """
SELECT precinct_id, CASE WHEN dem_voteshare_minority > 0.5 THEN 'yes' WHEN dem_voteshare_minority <= 0.5 THEN 'no' END AS strict_choice,
  CASE WHEN dem_voteshare_minority > 0.5 THEN 'yes' ELSE 'no' END AS loose_choice FROM fx_precincts
""")
def f06(spark, sf):
    test = F.col("dem_voteshare_minority") > 0.5
    return fx.precincts(spark, sf).select(
        "precinct_id", fn.ifelse(test, F.lit("yes"), F.lit("no")).alias("strict_choice"), F.when(test, "yes").otherwise("no").alias("loose_choice"))


@query("f08_text", """
SELECT precinct_id, concat_ws('_', precinct_id, population) AS joined, upper(p_brand) AS up, lower(p_type) AS low, format('{:,}', CAST(precinct_id * 1000 AS BIGINT)) AS big
FROM fx_precincts JOIN part ON p_partkey = precinct_id
""")
def f08(spark, sf):
    part = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("precinct_id"), "p_brand", "p_type")
    return fx.precincts(spark, sf).join(part, "precinct_id").select(
        "precinct_id", frames.unique_id("precinct_id", "population").alias("joined"), F.upper("p_brand").alias("up"),
        F.lower("p_type").alias("low"), fn.big_number(F.col("precinct_id") * 1000).alias("big"))


@query("f09_patterns", """
SELECT DISTINCT 'step_' || map_id AS plan_name, regexp_matches('step_' || map_id, '^step_[0-9]$') AS one_digit,
  CAST(regexp_extract('step_' || map_id, '([0-9]+)$', 1) AS BIGINT) AS map_id, regexp_replace(redist_level, '[aeiou]', '', 'g') AS bare FROM fx_assignments
""")
def f09(spark, sf):
    named = fx.assignments(spark, sf).select("map_id", "redist_level").distinct().select(F.concat(F.lit("step_"), "map_id").alias("plan_name"), "redist_level")
    return named.select(
        "plan_name", F.col("plan_name").rlike("^step_[0-9]$").alias("one_digit"),
        F.regexp_extract("plan_name", "([0-9]+)$", 1).cast("bigint").alias("map_id"), F.regexp_replace("redist_level", "[aeiou]", "").alias("bare"))


@query("f10_casts", """
SELECT precinct_id, CAST(CAST(population AS VARCHAR) AS BIGINT) AS n, CAST(dem_votes > rep_votes AS BIGINT) AS flag, TRY_CAST(p_brand AS BIGINT) AS bad
FROM fx_precincts JOIN part ON p_partkey = precinct_id
""")
def f10(spark, sf):
    part = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("precinct_id"), "p_brand")
    return fx.precincts(spark, sf).join(part, "precinct_id").select(
        "precinct_id", F.col("population").cast("string").cast("bigint").alias("n"),
        fn.indicator(F.col("dem_votes") > F.col("rep_votes")).alias("flag"), F.col("p_brand").try_cast("bigint").alias("bad"))


@query("f11_stars", """
SELECT precinct_id, CASE WHEN per_minority < 0.01 THEN '***' WHEN per_minority < 0.05 THEN '**' WHEN per_minority < 0.1 THEN '*' ELSE '' END AS stars FROM fx_precincts
""")
def f11(spark, sf):
    return fx.precincts(spark, sf).select("precinct_id", fn.stars("per_minority").alias("stars"))


