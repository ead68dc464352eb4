"""Partisan and spatial plan metrics and plan checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardwise import fixtures as fx
from wardwise.catalog.registry import R, query, r, rounded, rs, view
from wardwise.catalog.tables import MK, G
from wardwise.catalog.truth import district_table
from wardwise.functions import soft_step
from wardwise.plans import contiguity, ensemble, metrics
from wardwise.schemas import PLAN, SCENARIO

view("fx_shares", """
SELECT *, CAST(dem_votes AS DOUBLE) / nullif(dem_votes + rep_votes, 0) AS s,
  avg(CAST(dem_votes AS DOUBLE) / nullif(dem_votes + rep_votes, 0)) OVER (PARTITION BY map_id) AS m,
  row_number() OVER (PARTITION BY map_id ORDER BY CAST(dem_votes AS DOUBLE) / nullif(dem_votes + rep_votes, 0), district_id) AS k,
  count(*) OVER (PARTITION BY map_id) AS nd FROM fx_districts
""")
_SEATS = """CAST(sum(CASE WHEN dem_votes > rep_votes THEN 1 ELSE 0 END) AS BIGINT) AS dem_seats,
  CAST(sum(CASE WHEN rep_votes > dem_votes THEN 1 ELSE 0 END) AS BIGINT) AS rep_seats"""
_EG = """(sum(CASE WHEN dem_votes > rep_votes THEN CAST(rep_votes AS DOUBLE) ELSE (rep_votes - dem_votes) / 2e0 END)
  - sum(CASE WHEN dem_votes > rep_votes THEN (dem_votes - rep_votes) / 2e0 ELSE CAST(dem_votes AS DOUBLE) END)) / nullif(sum(dem_votes + rep_votes), 0)"""
_MM = "quantile_cont(s, 0.5) - avg(s)"
_PB = "avg(CASE WHEN s > m THEN 1e0 ELSE 0e0 END) - 0.5"
_SOFT = "sum(1 / (1 + exp(-60e0 * (s - 0.5)))) + 0.01 * (avg(s) - 0.5)"
view("fx_gini", f"""
SELECT a.map_id, avg(abs(2 * a.m - a.s - b.s)) AS gini FROM fx_shares a JOIN fx_shares b ON b.map_id = a.map_id AND b.k = a.nd + 1 - a.k GROUP BY a.map_id
""")
view("fx_cut", f"""
SELECT a.map_id, a.seg_level, a.redist_level, CAST(sum(CASE WHEN a.district_id <> b.district_id THEN 1 ELSE 0 END) AS BIGINT) AS cut_edges
FROM fx_edges e JOIN fx_assignments a ON a.precinct_id = e.src JOIN fx_assignments b ON b.precinct_id = e.dst AND b.map_id = a.map_id
GROUP BY a.map_id, a.seg_level, a.redist_level
""")


@query("g01_seats", f"SELECT {MK}, {_SEATS} FROM fx_shares GROUP BY {MK}")
def g01(spark, sf):
    return metrics.seats(district_table(spark, sf))


@query("g02_efficiency_gap", f"SELECT {MK}, {R(_EG, 'efficiency_gap')} FROM fx_shares GROUP BY {MK}")
def g02(spark, sf):
    return rounded(metrics.efficiency_gap(district_table(spark, sf)))


@query("g03_mean_median", f"SELECT {MK}, {R(_MM, 'mean_median')} FROM fx_shares GROUP BY {MK}")
def g03(spark, sf):
    return rounded(metrics.mean_median(district_table(spark, sf)))


@query("g04_partisan_bias", f"SELECT {MK}, {R(_PB, 'partisan_bias')} FROM fx_shares GROUP BY {MK}")
def g04(spark, sf):
    return rounded(metrics.partisan_bias(district_table(spark, sf)))


@query("g05_partisan_gini", f"SELECT {MK}, {R('gini', 'partisan_gini')} FROM fx_gini JOIN fx_mapsum USING (map_id)")
def g05(spark, sf):
    return rounded(metrics.partisan_gini(district_table(spark, sf)))


@query("g06_soft_seats", f"""
SELECT {MK}, {R(_SOFT, 'soft_dem')}, {R('sum(1 / (1 + exp(-60e0 * ((1 - s) - 0.5)))) + 0.01 * (avg(1 - s) - 0.5)', 'soft_rep')} FROM fx_shares GROUP BY {MK}
""")
def g06(spark, sf):
    d = district_table(spark, sf)
    dem = metrics.soft_seats(d).withColumnRenamed("soft_seats", "soft_dem")
    rep = metrics.soft_seats(d, "republican").withColumnRenamed("soft_seats", "soft_rep")
    return rounded(dem.join(rep, PLAN))


@query("f03_soft_step", f"SELECT precinct_id, {R('1 / (1 + exp(-60e0 * (dem_voteshare - 0.5)))', 'step')} FROM fx_precincts")
def f03(spark, sf):
    return fx.precincts(spark, sf).select("precinct_id", r(soft_step("dem_voteshare")).alias("step"))


@query("g07_plan_metrics", f"""
SELECT {MK}, dem_seats, rep_seats, {rs('efficiency_gap', 'mean_median', 'partisan_bias', 'soft_seats')}, {R('gini', 'partisan_gini')},
  cut_edges, {R('abs(efficiency_gap)', 'optimization_score')}
FROM (SELECT {MK}, {_SEATS}, {_EG} AS efficiency_gap, {_MM} AS mean_median, {_PB} AS partisan_bias, {_SOFT} AS soft_seats FROM fx_shares GROUP BY {MK}) t
JOIN fx_gini USING (map_id) JOIN fx_cut USING ({MK})
""")
def g07(spark, sf):
    return rounded(metrics.plan_metrics(district_table(spark, sf), fx.edges(spark, sf), fx.assignments(spark, sf)))


@query("g08_cut_edges", f"SELECT {MK}, cut_edges FROM fx_cut")
def g08(spark, sf):
    return metrics.cut_edges(fx.assignments(spark, sf), fx.edges(spark, sf))


@query("g09_population_deviation", f"""
SELECT {MK}, {R('max(d)', 'max_deviation')}, bool_and(d <= 0.05) AS population_ok
FROM (SELECT {MK}, abs(population / avg(population) OVER (PARTITION BY {MK}) - 1) AS d FROM fx_districts) t GROUP BY {MK}
""")
def g09(spark, sf):
    return rounded(metrics.population_ok(district_table(spark, sf), 0.05))


@query("g10_ideal_population", f"""
SELECT CAST(sum(population) AS BIGINT) AS total_population, CAST(round_even(sum(population) / 4000e0, 0) AS BIGINT) AS num_districts,
  {R('sum(population) / round_even(sum(population) / 4000e0, 0)', 'ideal_population')} FROM fx_precincts
""")
def g10(spark, sf):
    return rounded(metrics.ideal_population(fx.precincts(spark, sf), target_pop=4000.0))


@query("g11_compactness_bound", f"""
SELECT {MK}, cut_edges, initial_cut_edges, cut_edges <= 1.01e0 * initial_cut_edges AS compact FROM fx_cut
JOIN (SELECT seg_level, cut_edges AS initial_cut_edges FROM fx_cut WHERE (seg_level, map_id) IN (SELECT (seg_level, min(map_id)) FROM fx_cut GROUP BY seg_level)) i USING (seg_level)
""")
def g11(spark, sf):
    plans = fx.assignments(spark, sf)
    first = plans.groupBy("seg_level").agg(F.min("map_id").alias("map_id"))
    initial = plans.join(first, ["seg_level", "map_id"], "left_semi")
    return metrics.compactness_ok(plans, fx.edges(spark, sf), initial, 1.01)


view("fx_inner", """
SELECT a.map_id, e.src AS a, e.dst AS b FROM fx_edges e JOIN fx_assignments a ON a.precinct_id = e.src
JOIN fx_assignments b ON b.precinct_id = e.dst AND b.map_id = a.map_id AND b.district_id = a.district_id
""")
view("fx_links", "SELECT map_id, a, b FROM fx_inner UNION ALL SELECT map_id, b AS a, a AS b FROM fx_inner")
view("fx_reach", """
SELECT map_id, precinct_id AS a, precinct_id AS b FROM fx_assignments
UNION SELECT r.map_id, r.a, l.b FROM fx_reach r JOIN fx_links l ON l.map_id = r.map_id AND l.a = r.b
""")
view("fx_roots", "SELECT map_id, a AS precinct_id, min(b) AS root FROM fx_reach GROUP BY map_id, a")


@query("g12_district_components", f"""
SELECT {MK}, district_id, count(*) AS n_components, count(*) = 1 AS contiguous FROM (
  SELECT {MK}, district_id, precinct_id, root FROM fx_assignments JOIN fx_roots USING (map_id, precinct_id)) t
WHERE precinct_id = root GROUP BY {MK}, district_id
""")
def g12(spark, sf):
    return contiguity.district_components(fx.assignments(spark, sf), fx.edges(spark, sf))



@query("g13_best_so_far", f"""
SELECT run, step, {R('max(score) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING)', 'best')}, step // 3 AS burst FROM fx_chain
""")
def g13(spark, sf):
    out = ensemble.best_so_far(fx.chain(spark, sf), "run", "step", "score", 3)
    return rounded(out.select("run", "step", "best", "burst"))


view("fx_bursts", """
SELECT run, step // 3 AS burst, max(score) AS top FROM fx_chain GROUP BY run, burst HAVING count(*) = 3
""")
view("fx_burst_best", """
SELECT *, coalesce(top > max(top) OVER (PARTITION BY run ORDER BY burst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-12, true) AS improved,
  max(top) OVER (PARTITION BY run ORDER BY burst ROWS UNBOUNDED PRECEDING) AS best FROM fx_bursts
""")


@query("g13_burst_patience", f"""
SELECT run, burst, {R('best')}, improved, stale_bursts, coalesce(burst > min(CASE WHEN stale_bursts >= 2 THEN burst END) OVER (PARTITION BY run), false) AS stopped
FROM (SELECT *, burst - max(CASE WHEN improved THEN burst END) OVER (PARTITION BY run ORDER BY burst ROWS UNBOUNDED PRECEDING) AS stale_bursts FROM fx_burst_best) t
""")
def g13b(spark, sf):
    return rounded(ensemble.burst_patience(fx.chain(spark, sf), "run", "step", "score", 3, 2))


@query("g14_ensemble_summary", f"""
SELECT {G}, arg_max(map_id, (dem_seats, -map_id)) AS map_id, max(dem_seats) AS score, {R('avg(dem_seats)', 'mean_score')}, count(*) AS n_plans
FROM (SELECT {MK}, {_SEATS} FROM fx_shares GROUP BY {MK}) t GROUP BY {G}
""")
def g14(spark, sf):
    return rounded(ensemble.ensemble_summary(metrics.seats(district_table(spark, sf)), "dem_seats", SCENARIO))
