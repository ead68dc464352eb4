"""Incremental processing of plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardwise import fixtures as fx
from wardwise.catalog.base import DK
from wardwise.catalog.registry import R, query, rounded, rs, view
from wardwise.catalog.scans import fresh
from wardwise.catalog.tables import MK, G
from wardwise.schemas import DISTRICT, PLAN
from wardwise.streaming import incremental

EST = ["er_minority_dem_share", "er_majority_dem_share", "er_minority_se", "er_majority_se"]
view("fx_plan_list", f"SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY map_id) AS k FROM (SELECT DISTINCT {MK} FROM fx_assignments) p")
view("fx_progress", f"SELECT {G}, count(*) AS n_plans, count(*) FILTER (WHERE k <= 2) AS n_processed FROM fx_plan_list GROUP BY {G}")


def inputs(spark, sf):
    return fx.assignments(spark, sf), fx.precincts(spark, sf)


def two_each(spark, sf) -> str:
    path = fresh(spark, "progress")
    incremental.process_remaining(*inputs(spark, sf), path, max_plans=2)
    return path


@query("c01_save_results", f"SELECT {DK}, {rs(*EST)} FROM fx_er JOIN fx_plan_list USING ({MK})")
def c01(spark, sf):
    path = two_each(spark, sf)
    incremental.process_remaining(*inputs(spark, sf), path)
    return rounded(incremental.load_results(spark, path).select(*DISTRICT, *EST))


@query("c02_remaining_plans", f"SELECT {MK} FROM fx_plan_list WHERE k > 2")
def c02(spark, sf):
    return incremental.remaining_plans(fx.assignments(spark, sf), two_each(spark, sf))


@query("c02_progress_status", f"SELECT {G}, n_plans, n_processed, n_plans - n_processed AS n_remaining FROM fx_progress")
def c02s(spark, sf):
    return incremental.progress_status(fx.assignments(spark, sf), two_each(spark, sf))


@query("c03_load_scenario", f"SELECT {DK}, {rs(*EST)} FROM fx_er JOIN fx_plan_list USING ({MK}) WHERE k <= 2 AND seg_level = 'high' AND redist_level = 'dem'")
def c03(spark, sf):
    return rounded(incremental.load_results(spark, two_each(spark, sf), "high", "dem").select(*DISTRICT, *EST))


@query("c04_resume_in_batches", f"SELECT {DK}, {rs(*EST)} FROM fx_er")
def c04(spark, sf):
    path = two_each(spark, sf)
    incremental.process_remaining(*inputs(spark, sf), path)
    incremental.process_remaining(*inputs(spark, sf), path)
    return rounded(incremental.load_results(spark, path).select(*DISTRICT, *EST))


@query("c04_resume_from_stream", f"SELECT {DK}, {rs(*EST)} FROM fx_er")
def c04s(spark, sf):
    plans, precincts = inputs(spark, sf)
    source, path, state = fresh(spark, "incoming"), fresh(spark, "progress"), fresh(spark, "stream")
    for level in ("low", "medium", "high"):
        arrived = plans.where(F.col("seg_level") == level).repartition("map_id")
        arrived.write.mode("append").parquet(source)
        incremental.process_stream(spark, source, precincts, path, state)
    return rounded(incremental.load_results(spark, path).select(*DISTRICT, *EST))


@query("c04_plans_in_pieces", f"SELECT {DK}, {rs(*EST)} FROM fx_er WHERE map_id <> 4")
def c04p(spark, sf):
    """Every plan comes in two deliveries, but for the second half of plan 4, which is still out."""
    plans, precincts = inputs(spark, sf)
    source, path, state = fresh(spark, "incoming"), fresh(spark, "progress"), fresh(spark, "stream")
    first = F.col("precinct_id") % 2 == 0
    for part in (plans.where(first), plans.where(~first & (F.col("map_id") != 4))):
        part.repartition("map_id").write.mode("append").parquet(source)
        incremental.process_stream(spark, source, precincts, path, state)
    return rounded(incremental.load_results(spark, path).select(*DISTRICT, *EST))


def with_bad_plan(spark, sf) -> str:
    """Plan 7 fails by itself; all others are estimated."""
    path = fresh(spark, "progress")

    def estimator(plans, precincts):
        checked = F.when(F.col("map_id") == 7, F.raise_error(F.lit("no such district")).cast("bigint")).otherwise(F.col("er_rpv"))
        return incremental.regress(plans, precincts).withColumn("er_rpv", checked)

    incremental.process_remaining(*inputs(spark, sf), path, estimator=estimator)
    return path


@query("c04_failed_plans", f"SELECT {MK}, true AS told FROM fx_plan_list WHERE map_id = 7")
def c04f(spark, sf):
    return incremental.failed_plans(spark, with_bad_plan(spark, sf)).select(*PLAN, F.contains("reason", F.lit("no such district")).alias("told"))


@query("c04_results_beside_failures", f"SELECT {DK}, {rs(*EST)} FROM fx_er WHERE map_id <> 7")
def c04b(spark, sf):
    return rounded(incremental.load_results(spark, with_bad_plan(spark, sf)).select(*DISTRICT, *EST))


@query("c05_progress_table", f"""
SELECT coalesce(seg_level, 'total') AS seg_level, coalesce(redist_level, 'total') AS redist_level, CAST(sum(n_plans) AS BIGINT) AS n_plans,
  CAST(sum(n_processed) AS BIGINT) AS n_processed, {R('sum(n_processed) * 100e0 / sum(n_plans)', 'percent')} FROM fx_progress GROUP BY ROLLUP (seg_level, redist_level)
""")
def c05(spark, sf):
    return rounded(incremental.progress_table(fx.assignments(spark, sf), two_each(spark, sf)))
