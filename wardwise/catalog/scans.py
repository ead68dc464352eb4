"""Sources and sinks: each query writes its input in the wanted format and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardwise import fixtures as fx
from wardwise import schemas
from wardwise.catalog.base import DK
from wardwise.catalog.registry import R, query, r, rounded, rs
from wardwise.catalog.shapes import wide_plans
from wardwise.catalog.truth import district_table, map_table
from wardwise.operators import census
from wardwise.session import shared_dir
from wardwise.sources import readers, writers


def fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/wardwise/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_COUNTS = ", ".join(schemas.COUNTS)


@query("s01_csv_scan", f"SELECT precinct_id, {_COUNTS}, {rs(*schemas.SHARES)} FROM fx_precincts")
def s01(spark, sf):
    path = fresh(spark, "precincts") + ".csv"
    writers.write_csv(fx.precincts(spark, sf).select(*schemas.PRECINCTS.names), path)
    return rounded(readers.read_precincts(spark, path))


def write_census(spark, sf, path: str):
    blocks = fx.blocks(spark, sf).select(
        F.col("block_id").cast("string").alias("GEOID20"), F.col("population").cast("double").alias("CVAP_TOT22"),
        F.col("cvap_min").cast("double").alias("CVAP_BLK22"), F.col("cvap_maj").cast("double").alias("CVAP_WHT22"), "category")
    for category in ("low", "medium", "high"):
        writers.write_csv(blocks.where(F.col("category") == category).drop("category"), f"{path}/{category}_cvap")


@query("s02_typed_csv_scan", f"SELECT CAST(block_id AS VARCHAR) AS GEOID20, {R('population', 'CVAP_TOT22')}, category AS state FROM fx_blocks")
def s02(spark, sf):
    path = fresh(spark, "census")
    write_census(spark, sf, path)
    return rounded(readers.read_census(spark, path, ["GEOID20", "CVAP_TOT22"]))


@query("s03_multi_file_scan", f"""
SELECT CAST(block_id AS VARCHAR) AS precinct_id, category AS state, CAST(round_even(population * 27e0, 0) AS BIGINT) AS population, {R('per_minority')} FROM fx_blocks
""")
def s03(spark, sf):
    path = fresh(spark, "census")
    write_census(spark, sf, path)
    return rounded(census.clean_blocks(readers.read_census(spark, path)).select("precinct_id", "state", "population", "per_minority"))


@query("s04_scenario_scan", "SELECT map_id, seg_level, redist_level, precinct_id, district_id FROM fx_assignments")
def s04(spark, sf):
    path = fresh(spark, "scenarios")
    writers.write_scenarios(fx.assignments(spark, sf), path)
    return readers.read_scenarios(spark, path).select(*schemas.ASSIGNMENTS.names)


@query("s05_wide_plan_scan", "SELECT map_id, 'step_' || map_id AS plan_name, precinct_id, district_id FROM fx_assignments")
def s05(spark, sf):
    path = fresh(spark, "plans")
    wide = wide_plans(spark, sf).withColumn("init_CD", F.col("step_1"))
    writers.write_csv(wide.select(*[c for c in wide.columns if c != "precinct_id"], "precinct_id"), path)
    return readers.read_wide_plans(spark, path)


@query("s06_table_round_trip", f"SELECT map_id, seg_level, redist_level, n_dem_districts, {R('avg_dem_voteshare')} FROM fx_mapsum")
def s06(spark, sf):
    path = fresh(spark, "maps")
    writers.write_table(map_table(spark, sf), path)
    return rounded(spark.read.parquet(path).select(*schemas.PLAN, "n_dem_districts", "avg_dem_voteshare"))


@query("s07_csv_sink", "SELECT map_id AS plan_id, seg_level, redist_level, n_dem_districts AS dem_seats, n_rep_districts AS rep_seats FROM fx_mapsum")
def s07(spark, sf):
    from wardwise.operators.frames import plan_scores

    path = fresh(spark, "scores")
    scores = plan_scores(map_table(spark, sf))
    writers.write_csv(scores, path)
    return readers.read_csv(spark, path, scores.schema)


@query("s08_categorised_sink", f"""
SELECT category, {DK}, population, {R('dem_voteshare')} FROM fx_districts JOIN fx_tails USING (map_id)
""")
def s08(spark, sf):
    path = fresh(spark, "tails")
    writers.write_tails(district_table(spark, sf), map_table(spark, sf), path)
    return rounded(spark.read.parquet(f"{path}/districts").select("category", *schemas.DISTRICT, "population", "dem_voteshare"))


@query("s09_required_columns", "SELECT precinct_id, population, n_minority FROM fx_precincts")
def s09(spark, sf):
    needed = ["precinct_id", "population", "n_minority"]
    return schemas.require_columns(fx.precincts(spark, sf), needed).select(*needed)


@query("s10_rename_short_names", f"""
SELECT precinct_id AS pct_id, population AS pop, n_minority AS n_min, dem_votes AS dem_v, {R('per_minority', 'pct_min')}, {R('dem_voteshare', 'dem_vsh')},
  {R('coalesce(dem_voteshare_minority, 0)', 'dem_vsh_1')}, {R('coalesce(dem_voteshare_majority, 0)', 'dem_vsh_0')} FROM fx_precincts
""")
def s10(spark, sf):
    short = schemas.to_short_names(fx.precincts(spark, sf))
    return rounded(short.select("pct_id", "pop", "n_min", "dem_v", "pct_min", "dem_vsh", "dem_vsh_1", "dem_vsh_0"))


@query("s11_derive_missing_counts", f"""
SELECT precinct_id, population, bv AS n_minority, population - bv AS n_majority, dv AS dem_votes, population - dv AS rep_votes, {R('1 - dem_voteshare', 'rep_voteshare')}
FROM (SELECT *, CAST(round_even(per_minority * population, 0) AS BIGINT) AS bv, CAST(round_even(dem_voteshare * population, 0) AS BIGINT) AS dv FROM fx_precincts) t
""")
def s11(spark, sf):
    path = fresh(spark, "attributes")
    short = schemas.to_short_names(fx.precincts(spark, sf)).select("pct_id", "pop", "pct_min", "dem_vsh")
    writers.write_table(short, path)
    return readers.read_attributes(spark, path).select(
        "precinct_id", "population", "n_minority", "n_majority", "dem_votes", "rep_votes", r("rep_voteshare").alias("rep_voteshare"))
