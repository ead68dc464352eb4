"""Hand-made districts: degenerate, tied, collinear, constant-rate and split ones."""

import pytest
from pyspark.sql import functions as F

from wardwise.operators import bins
from wardwise.operators.frames import align, district_summary, district_truth, one_plan
from wardwise.operators.inference import grid_inference
from wardwise.operators.regression import ecological_regression
from wardwise.operators.waste import packed_cracked
from wardwise.plans import contiguity, results
from wardwise.schemas import COUNTS

SCHEMA = "map_id bigint, seg_level string, redist_level string, district_id bigint, precinct_id bigint, " + ", ".join(
    f"{c} bigint" for c in COUNTS)


def unit(district, precinct, n_min, n_maj, dem_min, dem_maj):
    n, dem = n_min + n_maj, dem_min + dem_maj
    return (1, "low", "dem", district, precinct, n, n_min, n_maj, dem, n - dem,
            dem_min, n_min - dem_min, dem_maj, n_maj - dem_maj)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_zero_minority_district(spark):
    units = frame(spark, [unit(1, i, 0, 10, 0, 4 + i) for i in range(3)])
    row = district_truth(units).first()
    assert row.true_minority_dem_share is None and row.true_rpv is None
    assert ecological_regression(units).isEmpty()


def test_small_and_collinear_districts_have_no_estimate(spark):
    two = [unit(1, 1, 4, 6, 2, 3), unit(1, 2, 6, 4, 3, 1)]
    same = [unit(2, 10 + i, 5, 5, 2, i) for i in range(3)]
    assert ecological_regression(frame(spark, two + same)).isEmpty()


def test_empty_precinct_counts_toward_minimum_only(spark):
    rows = [unit(1, 1, 40, 60, 20, 30), unit(1, 2, 60, 40, 40, 10), unit(1, 3, 0, 0, 0, 0), unit(1, 4, 20, 80, 16, 20)]
    row = ecological_regression(frame(spark, rows)).first()
    full = ecological_regression(frame(spark, [r for r in rows if r[5] > 0])).first()
    assert row.n_precincts == 4 and row.er_minority_se == pytest.approx(full.er_minority_se)


def constant_rates(spark, b1=7, b0=3):
    shares = (20, 40, 50, 60, 80)
    return frame(spark, [unit(1, i, s * 10, 1000 - s * 10, s * b1, (100 - s) * b0) for i, s in enumerate(shares)])


def test_regression_recovers_constant_rates(spark):
    row = ecological_regression(constant_rates(spark)).first()
    assert row.er_minority_dem_share == pytest.approx(0.7, abs=1e-9)
    assert row.er_majority_dem_share == pytest.approx(0.3, abs=1e-9)
    assert row.er_minority_se < 1e-6 and row.er_rpv == 1 and abs(row.er_minority_resid) < 1e-9


def test_grid_inference_recovers_constant_rates(spark):
    row = grid_inference(constant_rates(spark)).first()
    assert row.ei_minority_dem_share == pytest.approx(0.7, abs=0.02)
    assert row.ei_majority_dem_share == pytest.approx(0.3, abs=0.02)
    assert 0 <= row.ei_minority_sd < 0.1


def test_grid_inference_with_single_group_precincts(spark):
    rows = [unit(1, 1, 10, 0, 6, 0), unit(1, 2, 0, 10, 0, 3), unit(1, 3, 5, 5, 3, 1), unit(1, 4, 4, 6, 2, 2)]
    row = grid_inference(frame(spark, rows)).first()
    assert 0 <= row.ei_minority_dem_share <= 1 and 0 <= row.ei_majority_dem_share <= 1


def test_grid_inference_keeps_districts_without_a_regression(spark):
    same = [unit(2, 10 + i, 40, 60, 10 + 2 * i, 30 - i) for i in range(4)]
    one_group = [unit(3, 20 + i, 0, 10, 0, 4 + i) for i in range(3)]
    small = [unit(4, 30 + i, 4, 6, 2, 3) for i in range(2)]
    units = frame(spark, [*constant_rates(spark).collect(), *same, *one_group, *small])
    got = {r.district_id: r for r in grid_inference(units).collect()}
    assert set(got) == {1, 2, 3}
    assert 0 < got[2].ei_minority_dem_share < 1 and 0 < got[2].ei_majority_dem_share < 1
    assert got[3].ei_minority_dem_share is None and got[3].ei_minority_sd is None
    assert got[3].ei_majority_dem_share == pytest.approx(0.5) and got[3].ei_rpv is None
    assert set(r.district_id for r in grid_inference(units, min_precincts=2).collect()) == {1, 2, 3, 4}


def test_margin_bins_are_closed_on_the_left(spark):
    want = {0.0: "50+ (R)", 0.25: "40-50 (R)", 0.46875: "0-10 (R)", 0.5: "0-10 (D)", 0.75: "50+ (D)", 1.0: "50+ (D)"}
    rows = [("low", "dem", s, True) for s in [*want, None]]
    df = spark.createDataFrame(rows, "seg_level string, redist_level string, s double, ok boolean")
    got = {r.bin: r.n_obs for r in bins.accuracy_by_margin(df, {"ok": "ER"}, "s").collect()}
    assert got == {"50+ (R)": 1, "40-50 (R)": 1, "0-10 (R)": 1, "0-10 (D)": 1, "50+ (D)": 2}


def test_tie_rule_differs_by_operator(spark):
    units = frame(spark, [unit(1, i, 5, 5, 3, 2) for i in range(4)])
    assert district_summary(units).first().dem_district is True
    lost = packed_cracked(district_truth(units)).first()
    assert lost.dem_district is False


def test_half_of_the_votes_are_wasted(spark):
    units = frame(spark, [unit(1, 1, 30, 70, 20, 40), unit(2, 2, 51, 50, 10, 5)])
    for row in packed_cracked(district_truth(units)).collect():
        assert abs(row.total_wasted - row.total_population / 2) <= 1
        assert row.minority_wasted_total + row.majority_wasted_total == pytest.approx(row.total_wasted)


def test_unknown_plan_and_unmatched_units(spark):
    units = frame(spark, [unit(1, 1, 5, 5, 3, 2)])
    with pytest.raises(ValueError, match="plan 9"):
        one_plan(units, 9)
    plans = units.select("map_id", "precinct_id", "district_id")
    cast = units.select("precinct_id", *COUNTS)
    assert align(plans, cast).count() == 1
    with pytest.raises(ValueError, match="same units"):
        align(plans, cast.withColumn("precinct_id", F.lit(2).cast("bigint")))


def test_split_district_and_long_path(spark):
    # A path of 40 cells: district 0 is its two ends, district 1 the middle.
    cells = [(1, "low", "dem", i, 0 if i < 10 or i >= 30 else 1) for i in range(40)]
    plans = spark.createDataFrame(cells, "map_id bigint, seg_level string, redist_level string, precinct_id bigint, district_id bigint")
    edges = spark.createDataFrame([(i, i + 1) for i in range(39)], "src bigint, dst bigint")
    got = {r.district_id: r.n_components for r in contiguity.district_components(plans, edges).collect()}
    assert got == {0: 2, 1: 1}
    assert contiguity.plan_contiguity(plans, edges).first().contiguous is False


def test_star_is_one_component(spark):
    plans = spark.createDataFrame([(1, i, 0) for i in range(30)], "map_id bigint, precinct_id bigint, district_id bigint")
    edges = spark.createDataFrame([(29, i) for i in range(29)], "src bigint, dst bigint")
    assert contiguity.district_components(plans, edges, ["map_id"]).first().n_components == 1


def test_plan_in_two_scenarios_keeps_one(spark):
    rows = spark.createDataFrame([(1, "low", "dem"), (1, "low", "middle"), (2, "low", "rep")], "map_id bigint, seg_level string, redist_level string")
    assert results.plans_in_several_scenarios(rows).first().redist_levels == "dem, middle"
    kept = results.one_scenario_per_plan(rows)
    assert sorted((r.map_id, r.redist_level) for r in kept.collect()) == [(1, "dem"), (2, "rep")]


def test_null_rows_stay(spark):
    """NULL keys form a group, NULL values get a NULL result; no row is lost."""
    from wardwise.operators import frames, ordered

    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, None, 3.0), (4, "a", None)], "id long, k string, v double")
    running = {r.id: r.n for r in ordered.running(df, ["id"], ["k"], row_number="n").collect()}
    assert running == {1: 1, 4: 2, 2: 1, 3: 2}
    assert {r.id: r.ecdf for r in ordered.ecdf(df, "v").collect()} == {1: 1 / 3, 2: 2 / 3, 3: 1.0, 4: None}
    assert {r.id: r.density_class is None for r in ordered.density_class(df, "v").collect()} == {1: False, 2: False, 3: False, 4: True}
    assert {r.id: r.s for r in ordered.share_of_group(df, "v", ["k"], "s").collect()} == {1: 1.0, 2: 0.4, 3: 0.6, 4: None}
    plans = spark.createDataFrame([(1, 1), (1, 1)], "map_id long, precinct_id long")
    assert not frames.unmatched(plans, spark.createDataFrame([(1,), (2,)], "precinct_id long")).isEmpty()
