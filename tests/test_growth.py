"""Operators whose work must grow no faster than their input: how many rows reach the steps that sort or store them."""

import pytest
from pyspark.sql import functions as F

from wardwise import catalog
from wardwise import fixtures as fx
from wardwise.catalog import base
from wardwise.operators import inference, ordered, sampling
from wardwise.plans import results


def test_bootstrap_places_each_value_of_the_noise_once(spark, monkeypatch):
    """Draws of equal noise are counted before they are placed, and the same sample wins as when each is placed."""
    rows = spark.range(1, 301).select(F.col("id").alias("block_id"), (F.col("id") % 7).alias("population"), (F.col("id") / 300).alias("share"))
    noise = lambda a, j: F.pmod(j * 31 + a * 17, F.lit(101)) / F.lit(101.0)
    placed, pick = [], sampling.pick_weighted

    def counting(laid, draws, keys=()):
        placed.append(draws.count())
        return pick(laid, draws, keys)

    run = lambda: sorted(map(tuple, sampling.bootstrap_until(
        rows, "share", "population", 120, 0.9, "block_id", tol=1e-9, attempts=60, wave=10, noise=noise).select("attempt", "draw", "block_id").collect()))
    monkeypatch.setattr(sampling, "pick_weighted", counting)
    got = run()
    assert len(got) == 120 and sum(placed) <= 101 + 120
    monkeypatch.setattr(sampling, "REPEATS", 10**9)
    assert run() == got


def test_no_stored_input_holds_draws_or_wide_plan_rows(spark, sf_dir, monkeypatch):
    """What the reports read is stored as plan rows of few columns at most: draws and precinct rows are made where they are used."""
    written, write = {}, fx.materialise

    def recording(df, name):
        out = write(df, name)
        written[name] = (out.count(), len(out.columns))
        return out

    monkeypatch.setattr(fx, "_stored", {})
    monkeypatch.setattr(fx, "materialise", recording)
    catalog.load()
    for name in ("d09_inference_from_draws", "a23_plans_per_scenario", "a24_null_audit"):
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0
    rows = fx.N_PLANS * written["precincts"][0]
    assert written["assignments"] == (rows, 5)
    assert max(n for n, _ in written.values()) == rows and all(width == 5 for n, width in written.values() if n == rows)


def test_draws_with_group_sizes_are_not_joined_again(spark):
    draws = spark.range(60).selectExpr("id % 4 AS district_id", "id % 12 AS precinct_id", "id div 12 AS draw", "id / 60 AS beta_min", "1 - id / 60 AS beta_maj")
    precincts = spark.range(12).selectExpr("id AS precinct_id", "id + 1 AS n_minority", "20 - id AS n_majority")
    sized = draws.join(precincts, "precinct_id")
    run = lambda d, p: sorted(map(tuple, inference.district_draws(d, p, ["district_id"]).collect()))
    assert run(sized, precincts.limit(0)) == run(draws, precincts) != []


def test_dealing_by_score_sorts_only_the_bins_that_a_bucket_ends_in(spark, monkeypatch):
    """The same buckets as with_ntile, whatever the scores: NULL, NaN, beyond the bounds, or a third of them equal."""
    i = F.col("id")
    odd = F.when(i % 100 == 7, None).when(i % 100 == 8, F.lit(float("nan"))).when(i % 100 == 9, F.lit(-3.0)).when(i % 100 == 10, F.lit(float("inf")))
    score = odd.when(i % 3 == 0, F.lit(0.25)).otherwise(F.pmod(i * 7919, F.lit(9973)) / 9973.0)
    df = spark.range(12000).select("id", F.when(i % 5 == 0, None).otherwise(i % 2).alias("k"), score.alias("x"))
    sorted_rows, cut = [], ordered.cut_into_slices

    def counting(rows, order_by, keys=()):
        out = cut(rows, order_by, keys)
        sorted_rows.append(out.count())
        return out

    bag = lambda d: sorted(d.select("id", "t").collect())
    for n, keys in ((1, []), (14, []), (14, ["k"]), (20000, ["k"])):
        assert bag(ordered.deal_by_score(df, "x", "id", n, "t", keys)) == bag(ordered.with_ntile(df, ["x", "id"], n, "t", keys))
    even = df.withColumn("x", F.pmod(i * 7919, F.lit(9973)) / 9973.0)
    monkeypatch.setattr(ordered, "cut_into_slices", counting)
    got = bag(ordered.deal_by_score(even, "x", "id", 14, "t", ["k"]))
    assert sum(sorted_rows) < 1000
    monkeypatch.undo()
    assert got == bag(ordered.with_ntile(even, ["x", "id"], 14, "t", ["k"]))


def test_plans_are_dealt_without_sorting_all_rows(spark, sf_dir, monkeypatch):
    sorted_rows, cut = [], ordered.cut_into_slices

    def counting(rows, order_by, keys=()):
        out = cut(rows, order_by, keys)
        sorted_rows.append(out.count())
        return out

    monkeypatch.setattr(fx, "_stored", {})
    monkeypatch.setattr(ordered, "cut_into_slices", counting)
    rows = fx.assignments(spark, sf_dir).count()
    assert rows == fx.N_PLANS * fx.precincts(spark, sf_dir).count() and sum(sorted_rows) < rows / 4


def test_peer_ranks_reads_its_input_once(spark):
    """Group totals come with the running sums; the input is not read again for them."""
    df = spark.range(500).select((F.col("id") % 7).alias("k"), (F.col("id") % 13).alias("x"))
    for keys in ([], ["k"]):
        assert "Range (" not in ordered.peer_ranks(df, "x", keys)._jdf.queryExecution().executedPlan().toString()


def test_draws_beside_each_other_give_the_rates_of_draws_in_rows(spark, sf_dir):
    """One row per plan row carries all its draws, and no row is made for a draw before the sums."""
    precincts = fx.precincts(spark, sf_dir)
    beside = inference.district_draws(fx.draw_columns(spark, sf_dir), precincts)
    got, want = ({(r.map_id, r.district_id, r.draw): (r.minority_rate, r.majority_rate) for r in d.collect()}
                 for d in (beside, inference.district_draws(fx.draws(spark, sf_dir), precincts)))
    assert got.keys() == want.keys() and len(got) == fx.N_PLANS * fx.N_DISTRICTS * fx.N_DRAWS
    assert all(abs(a - b) < 1e-12 for k in got for a, b in zip(got[k], want[k], strict=True))
    plan = results.district_results(
        base.units(spark, sf_dir), fx.draw_columns(spark, sf_dir), precincts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Aggregate" in plan[plan.index("Generate"):]


def test_results_under_all_labels_come_from_the_results_once(spark, sf_dir, monkeypatch):
    """Reports by own scenario and by all listed ones sum the plan rows and draws once between them, and get the rows of a pass of their own."""
    passes, summed = [], results.summarise_draws

    def counting(*args):
        passes.append(1)
        return summed(*args)

    monkeypatch.setattr(results, "summarise_draws", counting)
    monkeypatch.setattr(fx, "_stored", {})
    both = base.results_all(spark, sf_dir)
    assert base.unlabelled(spark, sf_dir).count() > 0 and len(passes) == 1
    alone = results.district_results(base.units(spark, sf_dir), fx.draw_columns(spark, sf_dir), fx.precincts(spark, sf_dir), fx.labels(spark, sf_dir))
    # Draw sums are doubles: their last digits follow the order of the rows.
    shown = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert both.columns == alone.columns and shown(both) == shown(alone) != []


def test_truth_and_draws_come_from_one_pass(spark, sf_dir):
    """Plan rows are joined with the precincts once for totals, regression and draws, and give the rows of two passes."""
    catalog.load()
    shown = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    drawn, precincts = fx.drawn_units(spark, sf_dir), fx.precincts(spark, sf_dir)
    two = inference.inference_from_draws(fx.draw_columns(spark, sf_dir), precincts, base.units(spark, sf_dir))
    one = inference.inference_from_draws(drawn).select(two.columns)
    assert shown(one) == shown(two) != []
    # A district that is not known has no truth to compare with, in one pass as in two.
    lost = drawn.withColumn("district_id", F.when(F.col("district_id") > 2, F.col("district_id")))
    assert shown(inference.inference_from_draws(lost).select(two.columns)) == [r for r in shown(two) if r[two.columns.index("district_id")] > 2]
    both = results.district_results(base.units(spark, sf_dir), fx.draw_columns(spark, sf_dir), precincts)
    alone = results.district_results(drawn)
    assert shown(alone) == shown(both) != []
    named = [catalog.QUERIES[q](spark, sf_dir) for q in ("d09_inference_from_draws", "j04_regression_with_inference", "j14_estimate_with_truth")]
    assert [df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") for df in (alone, *named)] == [1, 1, 1, 1]


def test_totals_are_not_taken_from_draws_in_rows(spark, sf_dir):
    """A plan row with a row for each draw would be counted once a draw."""
    with pytest.raises(ValueError):
        inference.inference_from_draws(fx.draws(spark, sf_dir))


def test_dealt_rows_are_not_shuffled_to_the_counts_of_bins(spark, monkeypatch):
    """Whatever the session's limit; beyond ``FEW_BINS`` the planner chooses, and the buckets are the same."""
    df = spark.range(12000).select("id", (F.col("id") % 2).alias("k"), (F.pmod(F.col("id") * 7919, F.lit(9973)) / 9973.0).alias("x"))
    plans, cut = [], ordered.cut_into_slices

    def looking(rows, order_by, keys=()):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return cut(rows, order_by, keys)

    monkeypatch.setattr(ordered, "cut_into_slices", looking)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = ordered.deal_by_score(df, "x", "id", 14, "t", ["k"])
        monkeypatch.setattr(ordered, "FEW_BINS", 0)
        many = ordered.deal_by_score(df, "x", "id", 14, "t", ["k"])
        plans += [d._jdf.queryExecution().executedPlan().toString() for d in (few, many)]
        assert ["BroadcastHashJoin" in p for p in plans] == [True, False, True, False]
        assert sorted(few.collect()) == sorted(many.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
