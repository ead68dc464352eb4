"""Physical plans: what is pruned, pushed down, broadcast and shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from wardwise import fixtures as fx
from wardwise.operators import frames, ordered, regression
from wardwise.plans import metrics
from wardwise.sources import readers, writers


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    initial = plan_of(df).split("== Initial Plan ==")[-1]
    return len(re.findall(r"Exchange (?:hash|range)partitioning", initial))


@pytest.fixture(scope="module")
def units(spark, sf_dir):
    return frames.precinct_stats(fx.assignments(spark, sf_dir), fx.precincts(spark, sf_dir))


def test_truth_and_regression_take_one_shuffle(units):
    assert shuffles(frames.district_truth(units)) == 1
    assert shuffles(regression.ecological_regression(units)) == 1
    assert "Window" not in plan_of(regression.ecological_regression(units))
    assert "Python" not in plan_of(regression.ecological_regression(units))


def test_scan_reads_only_needed_columns(units):
    scans = re.findall(r"ReadSchema: (struct<[^>]*>)", plan_of(frames.district_truth(units)))
    assert scans and not any("per_minority" in s or "dem_voteshare" in s for s in scans)


def test_large_precinct_table_is_not_broadcast(spark, sf_dir):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        df = frames.district_truth(frames.precinct_stats(fx.assignments(spark, sf_dir), fx.precincts(spark, sf_dir)))
        assert "Broadcast" not in plan_of(df)
        edges = metrics.cut_edges(fx.assignments(spark, sf_dir), fx.edges(spark, sf_dir))
        assert "Broadcast" not in plan_of(edges)
        assert df.count() == fx.N_PLANS * fx.N_DISTRICTS
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_scenario_filter_prunes_folders(spark, sf_dir, tmp_path):
    writers.write_scenarios(fx.assignments(spark, sf_dir), str(tmp_path / "s"))
    df = readers.read_scenarios(spark, str(tmp_path / "s")).where("seg_level = 'high'")
    assert re.search(r"PartitionFilters: \[.*seg_level.*= high", plan_of(df))


def test_plans_bucketed_by_plan_are_not_shuffled(spark, sf_dir, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS stored LOCATION '{tmp_path}/db'")
    writers.write_assignments(fx.assignments(spark, sf_dir), "stored.plans", 4)
    try:
        df = regression.ecological_regression(frames.precinct_stats(spark.table("stored.plans"), fx.precincts(spark, sf_dir)))
        assert shuffles(df) == 0
        assert df.count() > 0
    finally:
        spark.sql("DROP DATABASE stored CASCADE")


def test_global_order_is_cut_into_slices(spark):
    df = ordered.running(spark.range(1000).withColumn("x", F.hash("id")), ["x", "id"], row_number="rn")
    big = [w for w in re.findall(r"Window \[[^\n]*", plan_of(df).split("== Initial Plan ==")[-1]) if "_slice" not in w]
    assert not big


def test_nothing_uses_a_cross_join_or_a_local_checkpoint():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "wardwise"
    for path in root.rglob("*.py"):
        text = path.read_text()
        assert ".crossJoin(" not in text and ".localCheckpoint(" not in text, path
