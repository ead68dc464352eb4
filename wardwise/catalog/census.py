"""Census-unit preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardwise import fixtures as fx
from wardwise.catalog.order import turn
from wardwise.catalog.registry import R, query, rounded, view
from wardwise.functions import clamp
from wardwise.operators import census, ordered

STATES = {
    "low": [f"NATION_{i}" for i in range(0, 6)],
    "medium": [f"NATION_{i}" for i in range(6, 12)],
    "high": [f"NATION_{i}" for i in range(12, 20)],
}


def raw_blocks(spark, sf):
    """The blocks under the names of the census files."""
    return fx.blocks(spark, sf).select(
        F.col("block_id").cast("string").alias("GEOID20"), F.col("population").cast("double").alias("CVAP_TOT22"),
        F.col("cvap_min").cast("double").alias("CVAP_BLK22"), F.col("cvap_maj").cast("double").alias("CVAP_WHT22"), "state")


_CLEAN = f"""CAST(block_id AS VARCHAR) AS precinct_id, CAST(round_even(population * 27e0, 0) AS BIGINT) AS population,
  {R('cvap_maj')}, {R('cvap_min')}, {R('per_minority')}, state"""


@query("r01_clean_blocks", f"SELECT {_CLEAN} FROM fx_blocks WHERE population > 0")
def r01(spark, sf):
    return rounded(census.clean_blocks(raw_blocks(spark, sf)))


def _in(states):
    return ", ".join(f"'{s}'" for s in states)


@query("r02_state_categories", f"""
SELECT * FROM (SELECT block_id, state, CASE {' '.join(f"WHEN state IN ({_in(v)}) THEN '{k}'" for k, v in STATES.items())} END AS category FROM fx_blocks) t
WHERE category IS NOT NULL
""")
def r02(spark, sf):
    blocks = fx.blocks(spark, sf).drop("category")
    return census.with_state_category(blocks, STATES).select("block_id", "state", "category")


_JIT = "CASE WHEN per_minority > 0.05e0 AND per_minority < 0.95e0 THEN greatest(0.05e0, least(0.95e0, per_minority + (u * 2 - 1) * 0.05e0)) ELSE per_minority END"


@query("r03_jitter_middle", f"SELECT block_id, row_number() OVER (ORDER BY {_JIT}, block_id) AS position FROM fx_turn")
def r03(spark, sf):
    keyed = census.jitter_middle(fx.blocks(spark, sf), "per_minority", turn())
    return ordered.with_row_id(keyed, ["sort_key", "block_id"], "position").select("block_id", "position")


@query("r04_pack_variable", """
SELECT state, unit, CAST(sum(cvap_min) AS BIGINT) AS cvap_min, CAST(sum(cvap_maj) AS BIGINT) AS cvap_maj, CAST(sum(population) AS BIGINT) AS population,
  CAST(sum(n) AS BIGINT) AS n_blocks_aggregated
FROM (SELECT *, CASE WHEN rn = last AND population < 60 AND last > 1 THEN rn - 1 ELSE rn END AS unit FROM (
  SELECT *, row_number() OVER (PARTITION BY state ORDER BY g) AS rn, count(*) OVER (PARTITION BY state) AS last FROM (
    SELECT state, g, sum(cvap_min) AS cvap_min, sum(cvap_maj) AS cvap_maj, sum(population) AS population, count(*) AS n FROM (
      SELECT *, ceil(sum(population) OVER (PARTITION BY state ORDER BY per_minority, population, block_id ROWS UNBOUNDED PRECEDING) /
        avg(CASE WHEN population < 3 THEN 200e0 WHEN population < 5 THEN 150e0 ELSE 100e0 END) OVER (PARTITION BY state)) AS g FROM fx_blocks) a
    GROUP BY state, g) b) c) d GROUP BY state, unit
""")
def r04(spark, sf):
    p = F.col("population")
    target = F.when(p < 3, 200.0).when(p < 5, 150.0).otherwise(100.0)
    return census.pack_variable(
        fx.blocks(spark, sf), ["per_minority", "population", "block_id"], "population",
        ["cvap_min", "cvap_maj", "population"], ["state"], min_tail=60, target=target)


# One block in each of the three target ranges below, by the fixtures' sizes of one to seven lines.
_RANGES = [(2, 90, 180), (4, 60, 120), (6, 45, 90), (None, 24, 60)]
view("fx_goals", f"""
SELECT state, cvap_min, cvap_maj, population, row_number() OVER w AS rn, sum(population) OVER (w ROWS UNBOUNDED PRECEDING) - population AS before,
  CASE {' '.join(f"WHEN population < {n} THEN {lo}e0 + u * {hi - lo}e0" for n, lo, hi in _RANGES[:-1])} ELSE 24e0 + u * 36e0 END AS goal
FROM fx_turn WINDOW w AS (PARTITION BY state ORDER BY per_minority, population, block_id)
""")


@query("r04_pack_sequential", """
SELECT state, unit, CAST(sum(cvap_min) AS BIGINT) AS cvap_min, CAST(sum(cvap_maj) AS BIGINT) AS cvap_maj,
  CAST(sum(population) AS BIGINT) AS population, count(*) AS n_blocks_aggregated
FROM (SELECT state, cvap_min, cvap_maj, population, CASE WHEN own = last AND size < 20 AND last > 1 THEN last - 1 ELSE own END AS unit FROM (
    SELECT g.state, cvap_min, cvap_maj, population, w.unit AS own, max(w.unit) OVER (PARTITION BY g.state) AS last,
      sum(population) OVER (PARTITION BY g.state, w.unit) AS size
    FROM fx_goals g JOIN fx_walk w ON w.state = g.state AND w.rn = g.rn) a) b
GROUP BY state, unit
""")
def r04s(spark, sf):
    target = census.random_target("population", turn(), _RANGES)
    return census.pack_sequential(
        fx.blocks(spark, sf), ["per_minority", "population", "block_id"], "population",
        ["cvap_min", "cvap_maj", "population"], ["state"], target, min_tail=20)


# The walk itself: block by block, with the total and the goal of the unit that is open.
view("fx_walk", """
SELECT state, rn, CAST(1 AS BIGINT) AS unit, CAST(population AS DOUBLE) AS total, goal FROM fx_goals WHERE rn = 1
UNION ALL
SELECT g.state, g.rn, CASE WHEN w.total >= w.goal THEN w.unit + 1 ELSE w.unit END,
  CASE WHEN w.total >= w.goal THEN CAST(g.population AS DOUBLE) ELSE w.total + g.population END, CASE WHEN w.total >= w.goal THEN g.goal ELSE w.goal END
FROM fx_walk w JOIN fx_goals g ON g.state = w.state AND g.rn = w.rn + 1
""")


_UNITS = {"low": 40, "medium": 60, "high": 25}


@query("r05_pack_by_class", f"""
SELECT category, unit, CAST(sum(cvap_min) AS BIGINT) AS cvap_min, CAST(sum(cvap_maj) AS BIGINT) AS cvap_maj,
  CAST(sum(population) AS BIGINT) AS population, count(*) AS n_blocks_aggregated
FROM (SELECT *, CAST(least(floor((rn - 1) / greatest(floor(size / goal), 1)), goal - 1) AS BIGINT) AS unit FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY per_minority * population DESC, block_id) AS DOUBLE) AS rn,
    CAST(count(*) OVER (PARTITION BY category) AS DOUBLE) AS size,
    CASE category {' '.join(f"WHEN '{k}' THEN {v}e0" for k, v in _UNITS.items())} END AS goal FROM fx_blocks) a) b
GROUP BY category, unit
""")
def r05(spark, sf):
    order = [(F.col("per_minority") * F.col("population")).desc(), F.col("block_id")]
    return census.pack_by_class(fx.blocks(spark, sf), "category", _UNITS, order, ["cvap_min", "cvap_maj", "population"])


@query("r06_scale_to_total", """
SELECT precinct_id, a AS n_minority, b AS n_majority, a + b AS population FROM (
  SELECT precinct_id, CAST(round_even(n_minority * (1e6 / t), 0) AS BIGINT) AS a, CAST(round_even(n_majority * (1e6 / t), 0) AS BIGINT) AS b
  FROM fx_precincts, (SELECT CAST(sum(population) AS DOUBLE) AS t FROM fx_precincts) q) s
""")
def r06(spark, sf):
    rows = fx.precincts(spark, sf).select("precinct_id", "n_minority", "n_majority", "population")
    return census.scale_to_total(rows, ["n_minority", "n_majority"], 1e6)


@query("p04_valid_blocks", "SELECT block_id FROM fx_blocks WHERE population > 0 AND per_minority >= 0 AND per_minority <= 1")
def p04(spark, sf):
    return census.valid_blocks(fx.blocks(spark, sf)).select("block_id")


@query("p05_clamp", f"SELECT block_id, {R('greatest(0.001e0, least(0.999e0, per_minority))', 'share')} FROM fx_blocks")
def p05(spark, sf):
    return rounded(fx.blocks(spark, sf).select("block_id", clamp("per_minority", 0.001, 0.999).alias("share")))
