"""Incremental processing: a second run does nothing, failures count as tried, streams add up."""

import pytest
from pyspark.sql import functions as F

from wardwise import fixtures as fx
from wardwise.schemas import DISTRICT
from wardwise.streaming import incremental


def rows(df):
    return sorted((tuple(r) for r in df.select(*DISTRICT, F.round("er_minority_dem_share", 9)).collect()), key=str)


def test_twice_is_once(spark, sf_dir, tmp_path):
    plans, cast = fx.assignments(spark, sf_dir), fx.precincts(spark, sf_dir)
    path = str(tmp_path / "out")
    assert incremental.process_remaining(plans, cast, path, max_plans=1) == 9
    first = rows(incremental.load_results(spark, path))
    assert incremental.process_remaining(plans, cast, path) == fx.N_PLANS - 9
    whole = rows(incremental.load_results(spark, path))
    assert set(first) <= set(whole)
    assert incremental.process_remaining(plans, cast, path) == 0
    assert rows(incremental.load_results(spark, path)) == whole
    assert whole == rows(incremental.regress(plans, cast))


def test_plan_without_rows_is_tried_once(spark, sf_dir, tmp_path):
    plans, cast = fx.assignments(spark, sf_dir), fx.precincts(spark, sf_dir)
    path = str(tmp_path / "out")
    nothing = lambda a, p: incremental.regress(a, p).where("false")
    assert incremental.process_remaining(plans, cast, path, 1, nothing) == 9
    assert incremental.progress_status(plans, path).agg(F.sum("n_processed")).first()[0] == 9
    assert incremental.load_results(spark, path).isEmpty()


def test_failed_batch_leaves_plans_remaining(spark, sf_dir, tmp_path):
    plans, cast = fx.assignments(spark, sf_dir), fx.precincts(spark, sf_dir)
    path = str(tmp_path / "out")
    broken = lambda a, p: incremental.regress(a, p).withColumn("er_rpv", F.raise_error(F.lit("no")).cast("bigint"))
    with pytest.raises(Exception, match="no"):
        incremental.process_remaining(plans, cast, path, 1, broken)
    assert incremental.remaining_plans(plans, path).count() == fx.N_PLANS
    incremental.process_remaining(plans, cast, path)
    assert rows(incremental.load_results(spark, path)) == rows(incremental.regress(plans, cast))


def test_sent_again_and_fresh_checkpoint(spark, sf_dir, tmp_path):
    """A plan file that comes again adds nothing, and a new checkpoint deletes no results."""
    plans, cast = fx.assignments(spark, sf_dir), fx.precincts(spark, sf_dir)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    plans.where("map_id = 1").coalesce(1).write.mode("append").parquet(source)
    incremental.process_stream(spark, source, cast, path, str(tmp_path / "c1"))
    first = rows(incremental.load_results(spark, path))
    plans.where("map_id = 1").coalesce(1).write.mode("append").parquet(source)
    incremental.process_stream(spark, source, cast, path, str(tmp_path / "c1"))
    assert rows(incremental.load_results(spark, path)) == first
    plans.where("map_id = 2").coalesce(1).write.mode("append").parquet(source)
    incremental.process_stream(spark, source, cast, path, str(tmp_path / "c2"))
    assert rows(incremental.load_results(spark, path)) == rows(incremental.regress(plans.where("map_id <= 2"), cast))


def bad_plans(*bad):
    """An estimator that fails on some plans."""
    def estimate(plans, precincts):
        fault = F.raise_error(F.concat(F.lit("plan "), F.col("map_id").cast("string"))).cast("bigint")
        return incremental.regress(plans, precincts).withColumn("er_rpv", F.when(F.col("map_id").isin(*bad), fault).otherwise(F.col("er_rpv")))
    return estimate


def test_bad_plans_do_not_hold_up_the_others(spark, sf_dir, tmp_path):
    plans, cast = fx.assignments(spark, sf_dir), fx.precincts(spark, sf_dir)
    path = str(tmp_path / "out")
    assert incremental.process_remaining(plans, cast, path, estimator=bad_plans(3, 20)) == fx.N_PLANS
    failed = {r.map_id: r.reason for r in incremental.failed_plans(spark, path).collect()}
    assert set(failed) == {3, 20} and all(f"plan {k}" in v for k, v in failed.items())
    assert rows(incremental.load_results(spark, path)) == rows(incremental.regress(plans.where("map_id not in (3, 20)"), cast))
    assert incremental.process_remaining(plans, cast, path, estimator=bad_plans(3, 20)) == 0


def test_retries_do_not_broadcast_the_precincts_each_time(spark, sf_dir, tmp_path):
    """The first attempt joins as the planner likes; its halves would send the precincts through the driver once each."""
    plans, cast = fx.assignments(spark, sf_dir), fx.precincts(spark, sf_dir)
    joins = []

    def estimate(part, precincts):
        joins.append("BroadcastHashJoin" in incremental.precinct_stats(fx.assignments(spark, sf_dir), precincts)._jdf.queryExecution().executedPlan().toString())
        return bad_plans(3)(part, precincts)

    incremental.process_remaining(plans, cast, str(tmp_path / "out"), estimator=estimate)
    assert joins[0] and len(joins) > 4 and not any(joins[1:])
    assert [r.map_id for r in incremental.failed_plans(spark, str(tmp_path / "out")).collect()] == [3]


def test_a_fault_of_all_plans_is_no_plans_fault(spark, sf_dir, tmp_path):
    plans, cast = fx.assignments(spark, sf_dir).where("map_id <= 4"), fx.precincts(spark, sf_dir)
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="plan"):
        incremental.process_remaining(plans, cast, path, estimator=bad_plans(1, 2, 3), max_failures=2)
    assert incremental.failed_plans(spark, path).isEmpty()
    assert incremental.remaining_plans(plans, path).where("map_id <= 3").count() == 3


def test_incomplete_plans_wait(spark, sf_dir, tmp_path):
    plans, cast = fx.assignments(spark, sf_dir).where("map_id <= 2"), fx.precincts(spark, sf_dir)
    path = str(tmp_path / "out")
    gone = F.col("precinct_id") == cast.agg(F.min("precinct_id")).first()[0]
    assert incremental.process_remaining(plans.where(~(gone & (F.col("map_id") == 2))), cast, path) == 1
    assert [r.map_id for r in incremental.remaining_plans(plans, path).collect()] == [2]
    assert incremental.process_remaining(plans, cast, path) == 1
    assert rows(incremental.load_results(spark, path)) == rows(incremental.regress(plans, cast))


def test_plan_in_pieces_is_estimated_once_and_whole(spark, sf_dir, tmp_path):
    """Three deliveries, some rows twice, across micro-batches and checkpoints; a failing plan among them."""
    plans, cast = fx.assignments(spark, sf_dir).where("map_id <= 3"), fx.precincts(spark, sf_dir)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    third = F.pmod("precinct_id", F.lit(3))
    for k, parts in enumerate(([0], [0, 1], [2])):
        plans.where(third.isin(parts)).repartition(2).write.mode("append").parquet(source)
        incremental.process_stream(spark, source, cast, path, str(tmp_path / f"c{k // 2}"), bad_plans(3), max_files=1)
        if k < 2:
            assert incremental.tried_plans(spark, path).isEmpty()
            assert incremental.pending_rows(spark, path).select("map_id").distinct().count() == 3
    assert rows(incremental.load_results(spark, path)) == rows(incremental.regress(plans.where("map_id < 3"), cast))
    assert [r.map_id for r in incremental.failed_plans(spark, path).collect()] == [3]
    assert incremental.pending_rows(spark, path).isEmpty() and not [f for f in (tmp_path / "out" / "pending").iterdir() if f.name.startswith("batch=")]
