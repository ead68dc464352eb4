"""Readers and writers."""

import pytest
from pyspark.sql import functions as F

from wardwise import fixtures as fx
from wardwise.operators import shapes
from wardwise.schemas import CENSUS_BLOCKS
from wardwise.sources import readers, writers


def test_plan_columns_are_matched_by_name(spark):
    wide = spark.createDataFrame([(3, 10, 1, 9), (4, 11, 2, 9)], "step_2 int, precinct_id int, step_1 int, init_CD int")
    got = sorted(tuple(r) for r in shapes.plans_to_long(wide).collect())
    assert got == [(1, "step_1", 10, 1), (1, "step_1", 11, 2), (2, "step_2", 10, 3), (2, "step_2", 11, 4)]


def test_ensemble_columns_and_district_base(spark):
    wide = spark.createDataFrame([(10, 1, 2)], "precinct_id int, democratic_map_0 int, democratic_map_1 int")
    got = sorted(tuple(r) for r in shapes.plans_to_long(wide, district_base=1).collect())
    assert got == [(0, "democratic_map_0", 10, 0), (1, "democratic_map_1", 10, 1)]


def test_wide_and_long_are_inverse(spark, sf_dir):
    plans = fx.assignments(spark, sf_dir)
    back = shapes.plans_to_long(shapes.plans_to_wide(plans, range(1, fx.N_PLANS + 1)))
    columns = ["map_id", "precinct_id", "district_id"]
    assert back.select(columns).exceptAll(plans.select(columns)).isEmpty()
    assert back.count() == plans.count()


def test_wrong_csv_header_is_an_error(spark, tmp_path):
    path = str(tmp_path / "bad")
    writers.write_csv(spark.createDataFrame([("1", 2.0, 3.0, 4.0)], "GEOID20 string, A double, B double, C double"), path)
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, path, CENSUS_BLOCKS).collect()


def test_identifiers_keep_leading_zeros(spark, tmp_path):
    path = str(tmp_path / "al_cvap_2022_2020_b")
    writers.write_csv(spark.createDataFrame([("0100", 2.0, 1.0, 1.0)], CENSUS_BLOCKS), path)
    row = readers.read_census(spark, str(tmp_path)).first()
    assert row.GEOID20 == "0100" and row.state == "al"


def test_counts_expand_to_members(spark):
    units = spark.createDataFrame([(1, 3, 2), (2, 0, 0), (3, 2, 0)], "id bigint, n bigint, m bigint")
    got = shapes.expand_counts(units, "n", "m", "id")
    assert sorted((r.id, r.position, r.race) for r in got.collect()) == [(1, 1, 1), (1, 2, 1), (1, 3, 0), (3, 1, 0), (3, 2, 0)]


def test_pattern_without_match_is_an_error(spark):
    with pytest.raises(ValueError, match="no column"):
        shapes.melt_pattern(spark.range(1), "x_(.*)", ["k"], "v", ["id"])


def test_tails_are_written_per_class(spark, sf_dir, tmp_path):
    from wardwise.operators.frames import summarise_plans

    districts, maps = summarise_plans(fx.assignments(spark, sf_dir), fx.precincts(spark, sf_dir))
    writers.write_tails(districts, maps, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t" / "maps"))
    assert {r.category for r in back.select("category").distinct().collect()} == {"all", "top_rep", "top_dem", "middle"}
    assert back.where(F.col("category") == "all").count() == fx.N_PLANS
