"""Ordered operators and samplers on skewed tables, against plain windows or brute force."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardwise.operators import ordered, sampling, space
from wardwise.plans import ensemble


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows under one key, and a third of all values equal."""
    i = F.col("id")
    return spark.range(3000).select(
        i, F.when(i % 3 == 0, 0).otherwise(i % 50 + 1).cast("bigint").alias("k"),
        F.when(i % 3 == 1, F.lit(0.25)).otherwise(F.pmod(i * 7919, F.lit(997)) / 997.0).alias("x"),
        (F.pmod(i * 31, F.lit(17)) + 1).alias("n"))


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_matches_window(skewed, keys):
    got = ordered.running(skewed, ["x", "id"], keys, sums={"s": "n"}, maxes={"m": "n"}, row_number="rn", count="c")
    w = Window.partitionBy(*keys).orderBy("x", "id").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    want = skewed.select("*", F.sum("n").over(w).alias("s"), F.max("n").over(w).alias("m"),
                         F.count("n").over(w).alias("rn"), F.count("n").over(whole).alias("c"))
    assert same(got.select(want.columns), want)


@pytest.mark.parametrize("n", [1, 7, 14, 5000])
def test_ntile_matches_window(skewed, n):
    got = ordered.with_ntile(skewed, ["x", "id"], n, "t", ["k"]).select("id", "t")
    want = skewed.select("id", F.ntile(n).over(Window.partitionBy("k").orderBy("x", "id")).cast("bigint").alias("t"))
    assert same(got, want)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_match_percentile(skewed, keys):
    probs = {"lo": 0.025, "mid": 0.5, "hi": 0.975, "top": 1.0, "low": 0.0}
    got = ordered.exact_quantiles(skewed, "x", probs, keys)
    want = skewed.groupBy(*keys).agg(*[F.percentile("x", F.lit(p)).alias(n) for n, p in probs.items()])
    key = lambda r: tuple(r[k] for k in keys)
    a, b = {key(r): r for r in got.collect()}, {key(r): r for r in want.collect()}
    assert a.keys() == b.keys()
    for k in a:
        for n in probs:
            assert a[k][n] == pytest.approx(b[k][n], abs=1e-12)


def test_ecdf_and_classes_match_window(skewed):
    w = Window.orderBy("x")
    want = skewed.select("id", F.cume_dist().over(w).alias("ecdf"))
    assert same(ordered.ecdf(skewed, "x").select("id", "ecdf"), want)
    p = F.percent_rank().over(w)
    want = skewed.select("id", F.when(p > 0.9, "a").when(p > 0.7, "b").when(p > 0.4, "c").otherwise("d").alias("cls"))
    got = ordered.density_class(skewed, "x", (0.9, 0.7, 0.4), ("a", "b", "c", "d"), "cls").select("id", "cls")
    assert same(got, want)


def brute_pick(rows, draws):
    """Interval search by hand over whole-number weights."""
    out, total = [], sum(w for _, w in rows)
    for j, u in draws:
        p, at = int(u * total), 0
        for i, w in rows:
            at += w
            if p < at:
                out.append((j, i))
                break
    return out


def test_weighted_pick_matches_brute_force(spark, skewed):
    rows = skewed.select("id", F.when(F.col("id") == 5, 20000).otherwise(F.col("n")).alias("w"))
    draws = spark.range(1, 500).select(F.col("id").alias("draw"), (F.pmod(F.col("id") * 7919, F.lit(10007)) / 10007.0).alias("u"))
    got = sorted((r.draw, r.id) for r in sampling.pick_weighted(sampling.lay_weights(rows, "w", "id"), draws).collect())
    table = sorted((r.id, r.w) for r in rows.collect())
    assert got == sorted(brute_pick(table, [(r.draw, r.u) for r in draws.collect()]))


def test_weighted_pick_follows_weights(spark, skewed):
    rows = skewed.select("id", F.when(F.col("id") == 7, F.lit(3000.0)).otherwise(F.lit(1.0)).alias("w"))
    draws = spark.range(1, 4001).select(F.col("id").alias("draw"), sampling.hash_noise(3, "id").alias("u"))
    picks = sampling.pick_weighted(sampling.lay_weights(rows, "w", "id"), draws)
    assert picks.count() == 4000
    assert abs(picks.where("id = 7").count() / 4000 - 0.5) < 0.04


def test_heavy_and_tiny_weights_are_one_row_of_the_layout(spark):
    rows = spark.createDataFrame([(i, 1e-18 if i == 2 else 3e5 if i == 9 else 1.0) for i in range(1, 3001)] + [(3001, 0.0), (3002, None)], "id long, w double")
    laid = sampling.lay_weights(rows, "w", "id")
    assert laid.count() == 3000
    assert laid.where("id = 2 and _end - _start = 1").count() == 1
    draws = spark.range(2000).select(F.col("id").alias("draw"), sampling.hash_noise(4, "id").alias("u"))
    picks = sampling.pick_weighted(laid, draws)
    assert picks.count() == 2000 and picks.where("id = 9").count() > 1900
    assert sampling.pick_weighted(laid, draws.where("draw < 0")).collect() == []


def test_draws_of_null_and_missing_groups(spark):
    rows = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, None, 5)], "id long, k string, w long")
    draws = spark.createDataFrame([(1, "a", 0.0), (2, "a", 0.99), (3, None, 0.5), (4, "b", 0.5)], "draw long, k string, u double")
    got = {(r.draw, r.id) for r in sampling.pick_weighted(sampling.lay_weights(rows, "w", "id", ["k"]), draws, ["k"]).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}


def test_samples_have_the_asked_size(skewed):
    assert sampling.hash_sample(skewed, 100, ["id"]).count() == 100
    assert sampling.hash_sample(skewed, 10**6, ["id"]).count() == 3000
    sizes = {r.k: r["count"] for r in sampling.hash_sample(skewed, 30, ["id"], by=["k"]).groupBy("k").count().collect()}
    whole = {r.k: r["count"] for r in skewed.groupBy("k").count().collect()}
    assert sizes == {k: min(n, 30) for k, n in whole.items()}
    assert same(sampling.hash_sample(skewed, 50, ["id"], seed=9), sampling.hash_sample(skewed, 50, ["id"], seed=9))


def test_bootstrap_stops_at_the_total(skewed):
    out = sampling.weighted_bootstrap(skewed, "n", 5000, "n", "id")
    total = out.agg(F.sum("n"), F.max("cum")).first()
    assert total[0] == total[1] and 5000 - 17 <= total[0] <= 5000


@pytest.mark.parametrize("target", [0.3, 0.7])
def test_raking_matches_a_loop(skewed, target):
    out = {r.id: r.rake_weight for r in sampling.rake(skewed, "x", "n", target).collect()}
    rows = [(r.id, r.x, r.n) for r in skewed.collect()]
    w = dict.fromkeys(out, 1.0)
    for _ in range(20):
        mean = sum(n * x * w[i] for i, x, n in rows) / sum(n * w[i] for i, _, n in rows)
        if abs(mean - target) < 0.001:
            break
        w = {i: max(0.1, min(10, w[i] * (1 + (target / mean - 1) * abs(x - target)))) for i, x, _ in rows}
    assert out == pytest.approx(w, rel=1e-9)


def test_calibration_leaves_a_close_mean_alone(skewed):
    mean = skewed.agg(F.sum(F.col("x") * F.col("n")) / F.sum("n")).first()[0]
    assert same(sampling.calibrate(skewed, "x", "n", mean + 0.01), skewed)
    moved = sampling.calibrate(skewed, "x", "n", mean + 0.1).agg(F.min("x"), F.max("x")).first()
    assert 0.001 <= moved[0] and moved[1] <= 0.999


def brute_repair(region, neighbours, rounds):
    now = dict(region)
    for _ in range(rounds):
        moves = {}
        for i, ns in neighbours.items():
            seen = [now[j] for j in ns]
            if seen and now[i] not in seen:
                moves[i] = min(set(seen), key=lambda v: (-seen.count(v), v))
        if not moves:
            break
        now.update(moves)
    return now


def test_repair_matches_brute_force(spark):
    side = 12
    region = {r * side + c: (r * 7 + c * c) % 4 for r in range(side) for c in range(side)}
    edges = [(i, i + 1) for i in region if i % side < side - 1] + [(i, i + side) for i in region if i + side in region]
    neighbours = {i: [] for i in region}
    for a, b in edges:
        neighbours[a].append(b)
        neighbours[b].append(a)
    units = spark.createDataFrame(list(region.items()), "precinct_id bigint, geog_id bigint")
    links = spark.createDataFrame(edges, "src bigint, dst bigint")
    for rounds in (0, 10):
        rows = space.repair_isolated(units, links, "geog_id", rounds).collect()
        got = {r.precinct_id: r.geog_id for r in rows}
        assert got == brute_repair(region, neighbours, rounds)
        assert {r.precinct_id for r in rows if r.isolated} == {i for i in got if got[i] not in [got[j] for j in neighbours[i]]}


def test_moran_of_a_checkerboard_is_minus_one(spark):
    n = 8
    units = spark.createDataFrame([(r * n + c, float((r + c) % 2)) for r in range(n) for c in range(n)], "precinct_id bigint, v double")
    edges = [(r * n + c, r * n + c + 1) for r in range(n) for c in range(n - 1)] + [(r * n + c, r * n + c + n) for r in range(n - 1) for c in range(n)]
    row = space.morans_i(units, spark.createDataFrame(edges, "src bigint, dst bigint"), "v").first()
    assert row.morans_i == pytest.approx(-1.0) and row.expected == pytest.approx(-1 / 63) and row.p_value > 0.999


def test_burst_patience_matches_a_loop(spark):
    score = [1, 2, 2, 2, 5, 1, 1, 1, 1, 1, 9, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1]
    chain = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(score)], "run bigint, step bigint, score double")
    got = {r.burst: (r.best, r.stale_bursts, r.stopped) for r in ensemble.burst_patience(chain, "run", "step", "score", 3, 2).collect()}
    best, before, stale, stop, want = float("-inf"), float("-inf"), 0, None, {}
    for b in range(len(score) // 3):
        best = max([best, *score[3 * b:3 * b + 3]])
        stale = 0 if best > before + 1e-12 else stale + 1
        before = best
        want[b] = (float(best), stale, stop is not None)
        if stop is None and stale >= 2:
            stop = b
    assert got == want
