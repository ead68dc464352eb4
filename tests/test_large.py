"""Operators on one large group, far points and dense places, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardwise.operators import census, inference, sampling, shapes, space


def walk(sizes, goals, least):
    """Blocks taken one by one: the unit's totals and numbers of blocks."""
    units, i = [], 0
    while i < len(sizes):
        total, j = 0, i
        while total < goals[i] and j < len(sizes):
            total, j = total + sizes[j], j + 1
        j = max(j, i + 1)
        units.append([int(sizes[i:j].sum()), j - i])
        i = j
    if len(units) > 1 and units[-1][0] < least:
        size, n = units.pop()
        units[-1] = [units[-1][0] + size, units[-1][1] + n]
    return [tuple(u) for u in units]


def test_packing_one_large_group(spark):
    """A group of 300,000 blocks beside small ones, some blocks empty, a NULL key, and a goal of zero."""
    n = 300_000
    rows = spark.range(n).select(
        F.when(F.col("id") < n - 7, "big").when(F.col("id") < n - 2, "small").alias("state"), "id",
        F.when(F.col("id") % 11 == 0, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(400))).alias("population"))
    noise = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1000)) / F.lit(1000.0)
    target = census.random_target("population", noise)
    got = {}
    for r in census.pack_sequential(rows, ["id"], "population", ["population"], ["state"], target, 500.0).collect():
        got.setdefault(r.state, {})[r.unit] = (r.population, r.n_blocks_aggregated)
    plain = rows.withColumn("goal", target).orderBy("id").toPandas()
    assert set(got) == {"big", "small", None}
    for state, own in plain.fillna({"state": ""}).groupby("state"):
        want = walk(own["population"].to_numpy(), own["goal"].to_numpy(), 500)
        assert got[state or None] == {i + 1: u for i, u in enumerate(want)}
    each = census.pack_sequential(rows.where("state = 'small'"), ["id"], "population", ["population"], ["state"], F.lit(0.0), 0.0)
    assert sorted((r.unit, r.n_blocks_aggregated) for r in each.collect()) == [(i, 1) for i in range(1, 6)]


def places(spark, seed, n, name):
    """Points in dense knots, far outliers, exact ties and repeated places."""
    rng = np.random.default_rng(seed)
    knots = rng.uniform(0, 1000, (4, 2))
    xy = np.concatenate([knots[rng.integers(4, size=n // 2)] + rng.normal(size=(n // 2, 2)) / 100, rng.uniform(0, 1000, (n // 2, 2)), rng.integers(0, 20, (n // 4, 2)) * 50.0])
    xy = np.concatenate([xy, xy[: n // 10], [[1e6, -1e6]]])
    return xy, spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], f"{name} bigint, x double, y double")


def test_nearest_centre_against_all_pairs(spark):
    centres, table = places(spark, 1, 1200, "center_id")
    points, rows = places(spark, 2, 800, "precinct_id")
    rows = rows.union(spark.createDataFrame([(-1, None, 1.0)], rows.schema))
    table = table.union(spark.createDataFrame([(-1, None, None)], table.schema))
    got = {r.precinct_id: r for r in space.nearest_centre(rows, table).collect()}
    assert len(got) == len(points) + 1 and got[-1].nearest_center is None
    d = np.sqrt(((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2))
    for i in range(len(points)):
        assert got[i].dist_to_center == pytest.approx(d[i].min(), rel=1e-12)
        assert got[i].nearest_center == int(np.flatnonzero(d[i] == d[i].min())[0])
    assert all(r.nearest_center is None for r in space.nearest_centre(rows, table.limit(0)).collect())
    one = space.nearest_centre(rows, table.where("center_id = 3")).where("x is not null")
    assert {r.nearest_center for r in one.collect()} == {3}


def test_decay_is_the_full_sum(spark):
    centres, table = places(spark, 3, 300, "center_id")
    points, rows = places(spark, 4, 300, "precinct_id")
    table = table.withColumn("intensity", F.pmod("center_id", F.lit(7)) + F.lit(0.5))
    got = {r.precinct_id: r.density for r in space.distance_decay(rows, table, chunk=16).collect()}
    d = np.sqrt(((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2))
    part = np.where(d < 1, 1.0, np.exp(-((np.maximum(d, 1) - 1) ** 4) / 15.0**4))
    want = 0.02 + (part * (np.arange(len(centres)) % 7 + 0.5) * 5).sum(axis=1)
    assert [got[i] for i in range(len(points))] == pytest.approx(want.tolist(), rel=1e-9)
    with pytest.raises(ValueError):
        space.distance_decay(rows, table, power=0.0)


def test_hot_vertex(spark):
    """Many units at one vertex: all pairs, dealt over many parts, and told of."""
    n = 600
    corner = spark.range(n).select(F.col("id").alias("precinct_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    own = spark.range(n).select("id", F.col("id").cast("double"), F.lit(5.0))
    shared = spark.createDataFrame([(0, 9.0, 9.0), (1, 9.0, 9.0001)], corner.schema)
    pairs = space.contiguity(corner.union(own).union(shared), chunk=32)
    assert pairs.count() == n * (n - 1) // 2 == pairs.distinct().count()
    assert space.contiguity(corner.union(own).union(shared), min_shared=2, chunk=32).collect() == [(0, 1)]
    assert [(r.n_units, r.n_pairs) for r in space.heavy_vertices(corner.union(own)).collect()] == [(n, n * (n - 1) // 2)]
    left, _ = space.spread_keys(corner, corner, ["x", "y"], "precinct_id", 32)
    sizes = [r[0] for r in left.groupBy("_part").count().select("count").collect()]
    assert len(sizes) == 19 and max(sizes) < 64


def units(spark, rows):
    columns = "map_id bigint, seg_level string, redist_level string, district_id bigint, precinct_id bigint, population bigint, n_minority bigint, dem_votes bigint"
    full = spark.createDataFrame([(1, "low", "dem", d, i, n, m, v) for i, (d, n, m, v) in enumerate(rows)], columns)
    zero = {c: F.lit(0).cast("bigint") for c in ("dem_votes_minority", "rep_votes_minority", "dem_votes_majority", "rep_votes_majority")}
    return full.withColumns({"n_majority": F.col("population") - F.col("n_minority"), "rep_votes": F.col("population") - F.col("dem_votes"), **zero})


def test_inference_comes_to_rest_and_counts_far_precincts(spark):
    """District 1 is plain; in 2 all rates but one are nearly equal, so that one lies hundreds of deviations away; 3 is slow."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(150):
        m = int(rng.integers(100, 900))
        rows.append((1, 1000, m, int(m * rng.uniform(0.6, 0.9) + (1000 - m) * rng.uniform(0.2, 0.5))))
        rows.append((2, 1000, m, round(m * 0.9 + (1000 - m) * 0.9)))
        rows.append((3, 1000, m // 4, int((m // 4) * rng.uniform(0, 1) + (1000 - m // 4) * rng.uniform(0, 1))))
    rows.append((2, 1000, 500, 5))
    table = units(spark, rows)
    small = {r.district_id: r for r in inference.grid_inference(table).collect()}
    large = {r.district_id: r for r in inference.grid_inference(table, one_task=0).collect()}
    assert set(small) == set(large) == {1, 2, 3}
    for d, r in small.items():
        assert r.converged and 5 < r.rounds < 500
        for c in ("ei_minority_dem_share", "ei_majority_dem_share", "ei_minority_sd", "ei_majority_sd"):
            assert r[c] is not None and large[d][c] == pytest.approx(r[c], abs=1e-6)
    # The far precinct holds a 151st of the district: its own rates are near zero, so both means must show it.
    without = {r.district_id: r for r in inference.grid_inference(table.where("dem_votes <> 5")).collect()}
    assert without[2].ei_minority_dem_share - small[2].ei_minority_dem_share > 0.003
    early = {r.district_id: r for r in inference.grid_inference(table, max_rounds=3).collect()}
    assert not any(r.converged for r in early.values()) and {r.rounds for r in early.values()} == {3}
    truth = inference.inference_on_grid(table).columns
    assert {"ei_minority_resid", "true_rpv", "ei_rpv_error", "prop_dem", "rounds", "converged"} <= set(truth)


@pytest.mark.parametrize("n", [0, 1, 499, 500, 4000, 9999, 20_000])
def test_large_samples_without_a_sort(spark, n):
    """Equal noise in one bin, NULL noise, values outside [0, 1]: the same rows as a sort gives."""
    k = F.pmod(F.xxhash64("id"), F.lit(1000))
    rows = spark.range(10_000).withColumn("u", F.when(k < 400, 0.5).when(k < 450, None).when(k < 500, k - 460.0).otherwise(k / 1000.0))
    got = sorted(r.id for r in sampling.hash_sample(rows, n, ["id"], noise=F.col("u"), merged=0).collect())
    assert got == sorted(r.id for r in rows.orderBy("u", "id").limit(n).collect())


def test_raked_samples(spark):
    """Both samples have the size that the mean asks for; the second is drawn by the weights that the first was raked to."""
    rows = spark.range(4000).select("id", (F.pmod(F.xxhash64("id"), F.lit(90)) + 10).alias("population"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(101)) / 100.0 * 0.6).alias("share"))
    out = sampling.rake_sample(rows, "share", "population", 100_000, 0.4, "id").toPandas()
    n = -(-100_000 // rows.agg(F.avg("population")).first()[0])
    assert sorted(out["draw"]) == list(range(1, int(n) + 1)) and set(out["first_draw"]) <= set(out["draw"]) and out["rake_weight"].between(0.1, 10).all()
    # A row of the first sample comes as often as its weight says: the mean weight of the second is the size-biased one of the first.
    first = out.drop_duplicates("first_draw")
    assert out["rake_weight"].mean() > first["rake_weight"].mean() and len(first) < n


def test_repair_is_the_loop_in_order(spark):
    """Random graphs, a checkerboard of isolated units (one long chain), two isolated neighbours, and units without neighbours."""
    rng = np.random.default_rng(8)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 120, (260, 2)) if a < b}
    edges |= {(200 + 8 * i + j, 200 + 8 * i + j + 1) for i in range(8) for j in range(7)} | {(200 + 8 * i + j, 208 + 8 * i + j) for i in range(7) for j in range(8)}
    edges |= {(400, 401)}
    region = {i: int(rng.integers(1, 6)) for i in range(120)} | {200 + 8 * i + j: (i + j) % 2 + 1 for i in range(8) for j in range(8)} | {400: 1, 401: 2, 500: 3}
    around = {i: [] for i in region}
    for a, b in edges:
        around[a].append(b)
        around[b].append(a)
    want = dict(region)
    for _ in range(10):
        changed = False
        for i in sorted(want):
            others = [want[j] for j in around[i]]
            if others and want[i] not in others:
                want[i], changed = min(set(others), key=lambda g: (-others.count(g), g)), True
        if not changed:
            break
    units_ = spark.createDataFrame(list(region.items()), "precinct_id bigint, geog_id bigint")
    links = spark.createDataFrame(list(edges), "src bigint, dst bigint")
    got = {r.precinct_id: r for r in space.repair_in_order(units_, links, "geog_id").collect()}
    assert {i: r.geog_id for i, r in got.items()} == want
    assert all(r.isolated == (bool(around[i]) and want[i] not in [want[j] for j in around[i]]) for i, r in got.items())
    assert got[400].geog_id == got[401].geog_id == 2 and not got[500].isolated


def test_large_units_are_expanded_in_chunks(spark):
    units_ = spark.createDataFrame([(1, 10_001, 64), (2, 0, 0), (3, 1, 1), (4, 128, 0), (5, None, 1)], "precinct_id bigint, population bigint, n_minority bigint")
    rows = shapes.expand_counts(units_, "population", "n_minority", "precinct_id", chunk=64)
    got = rows.groupBy("precinct_id").agg(F.count("*"), F.countDistinct("position"), F.min("position"), F.max("position"), F.sum("race"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 10_001, 10_001, 1, 10_001, 64), (3, 1, 1, 1, 1, 1), (4, 128, 128, 1, 128, 0)]
