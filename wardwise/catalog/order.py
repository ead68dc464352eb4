"""Windows, ranks and ordered output."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardwise import fixtures as fx
from wardwise import schemas
from wardwise.catalog import base
from wardwise.catalog.registry import R, query, rounded, view
from wardwise.catalog.tables import G
from wardwise.catalog.truth import map_table
from wardwise.operators import census, ordered, report, sampling
from wardwise.plans import ensemble
from wardwise.schemas import SCENARIO

view("fx_turn", "SELECT *, CAST((block_id * 7919 + 17) % 10007 AS DOUBLE) / 10007 AS u FROM fx_blocks")


def turn(id_col: str = "block_id", seed: int = 17):
    """Arithmetic noise that both engines can compute."""
    return F.pmod(F.col(id_col) * 7919 + seed, F.lit(10007)).cast("double") / F.lit(10007.0)


@query("w01_truncate_at_total", """
SELECT block_id, population FROM (SELECT *, sum(population) OVER (ORDER BY per_minority, block_id ROWS UNBOUNDED PRECEDING) AS c FROM fx_blocks) t
WHERE c <= (SELECT sum(population) * 0.6e0 FROM fx_blocks)
""")
def w01(spark, sf):
    blocks = fx.blocks(spark, sf)
    target = blocks.agg(F.sum("population") * 0.6).first()[0]
    return ordered.truncate_at_total(blocks, ["per_minority", "block_id"], "population", target).select("block_id", "population")


@query("w02_pack_by_running_sum", f"""
SELECT state, unit, CAST(sum(cvap_min) AS BIGINT) AS cvap_min, CAST(sum(cvap_maj) AS BIGINT) AS cvap_maj,
  CAST(sum(population) AS BIGINT) AS population, count(*) AS n_blocks_aggregated
FROM (SELECT *, CAST(ceil(sum(population) OVER (PARTITION BY state ORDER BY per_minority, population, block_id ROWS UNBOUNDED PRECEDING) / 60e0) AS BIGINT) AS unit FROM fx_blocks) t
GROUP BY state, unit
""")
def w02(spark, sf):
    return census.pack_by_running_sum(
        fx.blocks(spark, sf), ["per_minority", "population", "block_id"], "population", 60,
        ["cvap_min", "cvap_maj", "population"], ["state"])


@query("w03_decile_profile", f"""
SELECT decile, n, {R('a', 'avg_value')}, {R('n / CAST(sum(n) OVER () AS DOUBLE)', 'prop')}
FROM (SELECT decile, count(*) AS n, avg(per_minority) AS a FROM
  (SELECT per_minority, ntile(10) OVER (ORDER BY per_minority, block_id) AS decile FROM fx_blocks) s GROUP BY decile) t
""")
def w03(spark, sf):
    return rounded(ordered.decile_profile(fx.blocks(spark, sf), "per_minority", "block_id"))


@query("w04_density_class", """
SELECT precinct_id, CASE WHEN p > 0.95 THEN 'urban_core' WHEN p > 0.80 THEN 'urban' WHEN p > 0.50 THEN 'suburban' ELSE 'rural' END AS density_class
FROM (SELECT precinct_id, percent_rank() OVER (ORDER BY population) AS p FROM fx_precincts) t
""")
def w04(spark, sf):
    return ordered.density_class(fx.precincts(spark, sf), "population").select("precinct_id", "density_class")


@query("w04_density_class_second_cuts", """
SELECT precinct_id, CASE WHEN p > 0.9 THEN 'urban_core' WHEN p > 0.7 THEN 'urban' WHEN p > 0.4 THEN 'suburban' ELSE 'rural' END AS density_class
FROM (SELECT precinct_id, percent_rank() OVER (ORDER BY population) AS p FROM fx_precincts) t
""")
def w04b(spark, sf):
    return ordered.density_class(fx.precincts(spark, sf), "population", (0.9, 0.7, 0.4)).select("precinct_id", "density_class")


@query("a48_class_sizes", f"""
SELECT density_class, count(*) AS n, {R('avg(population)', 'avg_pop')} FROM (
  SELECT population, CASE WHEN p > 0.95 THEN 'urban_core' WHEN p > 0.80 THEN 'urban' WHEN p > 0.50 THEN 'suburban' ELSE 'rural' END AS density_class
  FROM (SELECT population, percent_rank() OVER (ORDER BY population) AS p FROM fx_precincts) s) t GROUP BY density_class
""")
def a48(spark, sf):
    return rounded(report.class_sizes(ordered.density_class(fx.precincts(spark, sf), "population"), "density_class", "population"))


@query("w05_min_max", f"""
SELECT precinct_id, {R('(per_minority - min(per_minority) OVER ()) / (max(per_minority) OVER () - min(per_minority) OVER ())', 'per_minority_std')},
  {R('(dem_voteshare - min(dem_voteshare) OVER ()) / (max(dem_voteshare) OVER () - min(dem_voteshare) OVER ())', 'dem_voteshare_std')}
FROM fx_precincts
""")
def w05(spark, sf):
    out = ordered.min_max(fx.precincts(spark, sf), ["per_minority", "dem_voteshare"])
    return rounded(out.select("precinct_id", "per_minority_std", "dem_voteshare_std"))


@query("w06_z_score", f"""
SELECT precinct_id, {R('(per_minority - avg(per_minority) OVER ()) / stddev_samp(per_minority) OVER ()', 'per_minority_z')},
  {R('(ln(population) - avg(ln(population)) OVER ()) / stddev_samp(ln(population)) OVER ()', 'log_pop_z')} FROM fx_precincts
""")
def w06(spark, sf):
    rows = fx.precincts(spark, sf).withColumn("log_pop", F.ln("population"))
    return rounded(ordered.z_score(rows, ["per_minority", "log_pop"]).select("precinct_id", "per_minority_z", "log_pop_z"))


@query("w07_center", f"SELECT precinct_id, {R('dem_voteshare - avg(dem_voteshare) OVER ()', 'dem_voteshare_centered')} FROM fx_precincts")
def w07(spark, sf):
    return rounded(ordered.center(fx.precincts(spark, sf), ["dem_voteshare"]).select("precinct_id", "dem_voteshare_centered"))


@query("w08_rank_scale", f"""
SELECT precinct_id, {R('10 + (row_number() OVER (ORDER BY per_minority, precinct_id) - 1) / CAST(count(*) OVER () - 1 AS DOUBLE) * 40', 'x')} FROM fx_precincts
""")
def w08(spark, sf):
    return rounded(ordered.rank_scale(fx.precincts(spark, sf), "per_minority", 10, 50, "precinct_id", "x").select("precinct_id", "x"))


@query("w09_blended_order", f"""
SELECT block_id, row_number() OVER (ORDER BY blend, block_id) AS position FROM (
  SELECT block_id, 0.5e0 * row_number() OVER (ORDER BY per_minority DESC, block_id) + 0.5e0 * row_number() OVER (ORDER BY u, block_id) AS blend FROM fx_turn) t
""")
def w09(spark, sf):
    out = ordered.blended_order(fx.blocks(spark, sf), "per_minority", 0.5, turn(), "block_id")
    return out.select("block_id", "position")


@query("w10_region_by_score", f"""
SELECT block_id, CAST(ceil(row_number() OVER (ORDER BY s, block_id) * 5 / CAST(count(*) OVER () AS DOUBLE)) AS BIGINT) AS geog_id, {R('s', 'location_score')}
FROM (SELECT block_id, 0.9e0 * n + (1 - 0.9e0) * u AS s FROM (SELECT block_id, u,
  (per_minority - min(per_minority) OVER ()) / (max(per_minority) OVER () - min(per_minority) OVER ()) AS n FROM fx_turn) a) b
""")
def w10(spark, sf):
    out = ordered.region_by_score(fx.blocks(spark, sf), "per_minority", 5, 0.9, turn(), "block_id")
    return rounded(out.select("block_id", "geog_id", "location_score"))


@query("w11_row_id", "SELECT block_id, row_number() OVER (ORDER BY per_minority, population, block_id) AS row_id FROM fx_blocks")
def w11(spark, sf):
    return ordered.with_row_id(fx.blocks(spark, sf), ["per_minority", "population", "block_id"]).select("block_id", "row_id")


@query("w12_share_of_group", f"""
SELECT state, category, n, {R('n / CAST(sum(n) OVER (PARTITION BY category) AS DOUBLE)', 'share')}, {R('n * 30e0 / max(n) OVER (PARTITION BY category)', 'scaled')}
FROM (SELECT state, category, count(*) AS n FROM fx_blocks GROUP BY state, category) t
""")
def w12(spark, sf):
    counts = fx.blocks(spark, sf).groupBy("state", "category").agg(F.count(F.lit(1)).alias("n"))
    out = ordered.share_of_group(counts, "n", ["category"], "share")
    return rounded(ordered.share_of_group(out, "n", ["category"], "scaled", how="max", scale=30.0))


@query("w14_ecdf", f"SELECT block_id, {R('cume_dist() OVER (PARTITION BY category ORDER BY per_minority)', 'ecdf')} FROM fx_blocks")
def w14(spark, sf):
    return rounded(ordered.ecdf(fx.blocks(spark, sf), "per_minority", ["category"]).select("block_id", "ecdf"))


@query("k01_order_scenarios", f"SELECT DISTINCT {G}, CASE seg_level WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS seg_rank, CASE redist_level WHEN 'dem' THEN 1 WHEN 'middle' THEN 2 ELSE 3 END AS redist_rank FROM fx_assignments")
def k01(spark, sf):
    rows = fx.assignments(spark, sf).select(*SCENARIO).distinct()
    return schemas.order_scenarios(rows.withColumns({"seg_rank": schemas.seg_rank(), "redist_rank": schemas.redist_rank()}))


@query("p07_scenario_labels", f"""
SELECT DISTINCT {G}, CASE seg_level WHEN 'low' THEN 'Low' WHEN 'medium' THEN 'Medium' ELSE 'High' END AS seg_label,
  CASE redist_level WHEN 'dem' THEN 'Dem' WHEN 'middle' THEN 'Neutral' ELSE 'Rep' END AS redist_label FROM fx_results
""")
def p07(spark, sf):
    return schemas.label_scenarios(base.results(spark, sf).select(*SCENARIO).distinct()).drop("seg_rank", "redist_rank")


@query("k02_best_plan", f"""
SELECT {G}, map_id, n_dem_districts AS score FROM (SELECT *, row_number() OVER (PARTITION BY seg_level, redist_level ORDER BY n_dem_districts DESC, map_id) AS rn FROM fx_mapsum) t WHERE rn = 1
""")
def k02(spark, sf):
    return ensemble.best_plan(map_table(spark, sf), "n_dem_districts", SCENARIO)


@query("k04_first_plans_per_scenario", f"""
SELECT {G}, map_id FROM (SELECT {G}, map_id, row_number() OVER (PARTITION BY seg_level, redist_level ORDER BY map_id) AS rn
  FROM (SELECT DISTINCT {G}, map_id FROM fx_assignments) s) t WHERE rn <= 2
""")
def k04(spark, sf):
    plans = fx.assignments(spark, sf).select(*SCENARIO, "map_id").distinct()
    return sampling.first_n_per_group(plans, SCENARIO, ["map_id"], 2)


view("fx_tails", """
SELECT map_id, category FROM (SELECT map_id, n_dem_districts AS d, n_rep_districts AS r FROM fx_mapsum) m,
  (SELECT quantile_cont(n_rep_districts, 0.975) AS rq, quantile_cont(n_dem_districts, 0.975) AS dq,
    quantile_cont(n_rep_districts, 0.25) AS lo, quantile_cont(n_rep_districts, 0.75) AS hi FROM fx_mapsum) q,
  (VALUES ('all'), ('top_rep'), ('top_dem'), ('middle')) AS c(category)
WHERE category = 'all' OR (category = 'top_rep' AND r >= rq) OR (category = 'top_dem' AND d >= dq) OR (category = 'middle' AND r >= lo AND r <= hi)
""")


@query("a17_ensemble_tails", "SELECT map_id, category FROM fx_tails")
def a17(spark, sf):
    return ensemble.tail_classes(map_table(spark, sf)).select("map_id", "category")


@query("k05_order_by_reference_class", f"""
SELECT district_id, category, {R('m', 'mean')}, CAST(rk AS BIGINT) AS position FROM (
  SELECT district_id, category, avg(dem_voteshare) AS m FROM fx_districts JOIN fx_tails USING (map_id) GROUP BY district_id, category) a
JOIN (SELECT district_id, row_number() OVER (ORDER BY avg(dem_voteshare), district_id) AS rk FROM fx_districts JOIN fx_tails USING (map_id)
  WHERE category = 'middle' GROUP BY district_id) b USING (district_id)
""")
def k05(spark, sf):
    from wardwise.catalog.truth import district_table

    rows = district_table(spark, sf).join(ensemble.tail_classes(map_table(spark, sf)).select("map_id", "category"), "map_id")
    means = rows.groupBy("district_id", "category").agg(F.avg("dem_voteshare").alias("mean"))
    return rounded(ensemble.order_by_reference_class(means, "district_id", "mean", "category", "middle"))


@query("a45_representative_plan", f"""
SELECT {G}, coalesce(min(map_id) FILTER (WHERE n_dem_districts = med), 1) AS map_id, {R('any_value(med)', 'median_seats')}
FROM fx_mapsum JOIN (SELECT {G}, quantile_cont(n_dem_districts, 0.5) AS med FROM fx_mapsum GROUP BY {G}) q USING ({G}) GROUP BY {G}
""")
def a45(spark, sf):
    return rounded(ensemble.representative_plan(map_table(spark, sf), SCENARIO))


