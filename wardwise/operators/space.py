"""Spatial structure as tables: neighbours, weights, autocorrelation, distances."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwise.functions import euclid, try_div
from wardwise.session import Scratch, materialise


#: Rows of one key that a task gets from the side that is dealt out; the other side is copied to each of the parts.
CHUNK = 4096


def spread_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], unit: str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with a column ``_part``: keys with over ``chunk`` rows on the left are dealt into parts by the hash of ``unit``, and their
    rows on the right copied to every part. Joined on keys and part, every pair still meets once."""
    sizes = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(sizes, list(keys), "left").withColumn("_part", F.pmod(F.xxhash64(unit), parts).cast("int")).drop("_parts")
    copied = right.join(sizes, list(keys), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt, copied


def _snapped(vertices: DataFrame, snap: float) -> DataFrame:
    return vertices.select(
        "precinct_id", F.bround(F.col("x") / F.lit(snap)).cast("bigint").alias("_x"),
        F.bround(F.col("y") / F.lit(snap)).cast("bigint").alias("_y"),
    ).distinct()


def contiguity(vertices: DataFrame, snap: float = 0.001, min_shared: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Pairs of units that share at least ``min_shared`` snapped vertices.

    One shared vertex is queen contiguity, two are a shared border. A vertex of over ``chunk`` units is dealt over several tasks (``spread_keys``);
    it still gives all its pairs, which ``heavy_vertices`` tells of beforehand.
    """
    snapped = _snapped(vertices, snap)
    left, right = spread_keys(
        snapped.withColumnRenamed("precinct_id", "src"), snapped.withColumnRenamed("precinct_id", "dst"), ["_x", "_y"], "src", chunk)
    pairs = left.join(right, ["_x", "_y", "_part"]).where(F.col("src") < F.col("dst")).groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("shared"))
    return pairs.where(F.col("shared") >= min_shared).select("src", "dst")


def heavy_vertices(vertices: DataFrame, limit: int = 12, snap: float = 0.001) -> DataFrame:
    """Snapped places where more than ``limit`` units meet, with their number and that of their pairs: mostly a default coordinate or a wrong snap."""
    n = F.col("n_units")
    counts = _snapped(vertices, snap).groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("n_units")).where(n > limit)
    return counts.select(
        (F.col("_x") * F.lit(float(snap))).alias("x"), (F.col("_y") * F.lit(float(snap))).alias("y"), n, (n * (n - 1) / 2).cast("bigint").alias("n_pairs"))


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def row_weights(edges: DataFrame) -> DataFrame:
    """Equal weights over the neighbours of each unit, summing to one."""
    links = both_directions(edges)
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("_n"))
    return links.join(degree, "src").select("src", "dst", (F.lit(1.0) / F.col("_n")).alias("weight"))


def upper_tail(z) -> Column:
    """Upper tail of the standard normal: by the series of its integral near zero, by the continued fraction of the tail from four on."""
    z = F.col(z) if isinstance(z, str) else z
    a = F.abs(z)
    density = F.exp(-a * a / 2) / F.lit(math.sqrt(2 * math.pi))
    series = F.aggregate(
        F.array(*[F.lit(2.0 * k + 1) for k in range(1, 60)]), F.struct(a.alias("term"), a.alias("sum")),
        lambda s, odd: F.struct((s["term"] * a * a / odd).alias("term"), (s["sum"] + s["term"] * a * a / odd).alias("sum")))
    fraction = F.aggregate(F.array(*[F.lit(float(k)) for k in range(60, 0, -1)]), a, lambda below, k: a + k / below)
    tail = F.when(a < 4, F.lit(0.5) - density * series["sum"]).otherwise(density / fraction)
    return F.when(z < 0, 1 - tail).when(~F.isnan(z), tail)


def morans_i(units: DataFrame, edges: DataFrame, value: str, by: Sequence[str] = (), id_col: str = "precinct_id") -> DataFrame:
    """Moran's I under row-standardised weights, with its moments under randomisation.

    Units without neighbours count toward the mean but not toward n. Three small
    aggregates (values, weighted products, weight sums) are joined on ``by``.
    """
    by = list(by)
    if not by:
        grouped = units.withColumn("_all", F.lit(1))
        return morans_i(grouped, edges, value, ["_all"], id_col).drop("_all")
    means = units.groupBy(*by).agg(F.avg(value).alias("_mean"), F.count(F.lit(1)).alias("_n_all"))
    z = units.join(means, by).select(*by, F.col(id_col).alias("src"), (F.col(value) - F.col("_mean")).alias("_z"), "_n_all")
    z = materialise(z, "deviations")
    weights = row_weights(edges)
    back = weights.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("_back"))
    zi, zj = z.select(*by, "src", "_z"), z.select(*by, F.col("src").alias("dst"), F.col("_z").alias("_zj"))
    pairs = zi.join(weights.join(back, ["src", "dst"]), "src").join(zj, [*by, "dst"])
    w, b = F.col("weight"), F.col("_back")
    per_unit = pairs.groupBy(*by, "src").agg(
        F.sum(w * F.col("_z") * F.col("_zj")).alias("_cross"), F.sum(w).alias("_out"), F.sum(b).alias("_in"),
        F.sum((w + b) * (w + b)).alias("_s1"),
    )
    sums = per_unit.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_cross").alias("_cross"), F.sum("_out").alias("_s0"),
        (F.sum("_s1") / 2).alias("_s1"), F.sum(F.pow(F.col("_out") + F.col("_in"), 2)).alias("_s2"),
    )
    square = F.col("_z") * F.col("_z")
    spread = z.groupBy(*by).agg(F.sum(square).alias("_zz"), F.sum(square * square).alias("_z4"), F.max("_n_all").alias("_n_all"))
    n, s0, s1, s2 = (F.col(c).cast("double") for c in ("_n", "_s0", "_s1", "_s2"))
    kurtosis = F.col("_n_all") * F.col("_z4") / (F.col("_zz") * F.col("_zz"))
    expected = F.lit(-1.0) / (n - 1)
    top = n * (s1 * (n * n - 3 * n + 3) - n * s2 + 3 * s0 * s0)
    less = kurtosis * (s1 * (n * n - n) - 2 * n * s2 + 6 * s0 * s0)
    variance = try_div(top - less, (n - 1) * (n - 2) * (n - 3) * s0 * s0) - expected * expected
    out = sums.join(spread, by).select(
        *by, (n / s0 * F.col("_cross") / F.col("_zz")).alias("morans_i"), expected.alias("expected"), variance.alias("variance"))
    out = out.withColumn("z", try_div(F.col("morans_i") - F.col("expected"), F.sqrt("variance")))
    return out.withColumn("p_value", upper_tail("z"))


def neighbour_counts(cells: DataFrame, row: str = "row_no", col: str = "col", id_col: str = "precinct_id") -> DataFrame:
    """Cells around each cell (of eight), and whether it lies on the edge.

    Each cell announces itself to its eight places; counting the announcements that
    land on a cell is an equi-join.
    """
    offsets = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc"))
                        for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)])
    around = cells.select(F.col(row).alias("_r"), F.col(col).alias("_c"), F.explode(offsets).alias("o")).select(
        (F.col("_r") + F.col("o.dr")).alias(row), (F.col("_c") + F.col("o.dc")).alias(col))
    counts = around.groupBy(row, col).agg(F.count(F.lit(1)).alias("_n"))
    return cells.join(counts, [row, col], "left").select(
        id_col, row, col, F.coalesce("_n", F.lit(0)).alias("n_neighbours")).withColumn(
        "edge_cell", F.col("n_neighbours") < 8)


#: Centres of a leaf cell at most, before the pyramid is made deeper, and the depth at which it ends.
LEAF = 32
DEEPEST = 26


def _box_distance(x, y, near: bool):
    """Least or greatest distance of (x, y) to the box of a cell's centres. For a box of one centre both are its distance."""
    outside = lambda v, lo, hi: F.greatest(F.col(lo) - v, v - F.col(hi), F.lit(0.0))
    across = lambda v, lo, hi: F.greatest(v - F.col(lo), F.col(hi) - v)
    side = outside if near else across
    dx, dy = side(x, "_x0", "_x1"), side(y, "_y0", "_y1")
    return F.sqrt(dx * dx + dy * dy)


def _pyramid(places: DataFrame, corner, width: float, n: int) -> int:
    """Levels (halvings of the width) at which no cell holds over LEAF places, or DEEPEST."""
    level = 2
    while 4**level * LEAF < n:
        level += 2
    while level < DEEPEST:
        cells = places.groupBy(*_cell(corner, width, level)).agg(F.count(F.lit(1)).alias("n"))
        if cells.agg(F.max("n")).first()[0] <= LEAF:
            break
        level += 2
    return level


def _cell(corner, width: float, level: int) -> list:
    """Column and row of a centre's cell."""
    side = 1 << level
    at = lambda v, lo: F.least(F.floor((F.col(v) - F.lit(lo)) / F.lit(width) * F.lit(float(side))), F.lit(side - 1)).cast("bigint")
    return [at("cx", corner[0]).alias("_i"), at("cy", corner[1]).alias("_j")]


def nearest_centre(points: DataFrame, centres: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Closest centre of each point and the distance to it (ties by id).

    ``centres`` (center_id, x, y) may be of any size. Its places form a pyramid of grid cells, 16 below each, down to cells of few centres. The points go down
    level by level, by equi-joins on the cell: of the cells below those kept, a point keeps those whose nearest corner is no farther than the
    farthest corner of some cell, so that the nearest centre's cell is always among them. Cells are few for each point, whatever the number
    of centres. Centres without a place are left out; points without a place, and all points if there is no centre, get NULL.
    """
    scratch = Scratch(points.sparkSession, "nearest")
    own = scratch.write(points.withColumn("_pid", F.monotonically_increasing_id()), "points")
    placed = centres.select(F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy"), "center_id").dropna()
    placed = scratch.write(placed.groupBy("cx", "cy").agg(F.min("center_id").alias("center_id")), "places")
    x0, y0, x1, y1, n = placed.agg(F.min("cx"), F.min("cy"), F.max("cx"), F.max("cy"), F.count(F.lit(1))).first()
    if not n:
        return points.withColumns({"nearest_center": F.lit(None).cast(centres.schema["center_id"].dataType), "dist_to_center": F.lit(None).cast("double")})
    corner, width = (x0, y0), max(x1 - x0, y1 - y0) or 1.0
    depth = _pyramid(placed, corner, width, n)
    px, py = F.col("_px"), F.col("_py")
    search = own.select("_pid", F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py")).dropna()
    kept = search.withColumns({"_up_i": F.lit(0).cast("bigint"), "_up_j": F.lit(0).cast("bigint")})
    for level in range(2, depth + 1, 2):
        boxes = placed.groupBy(*_cell(corner, width, level)).agg(
            F.min("cx").alias("_x0"), F.max("cx").alias("_x1"), F.min("cy").alias("_y0"), F.max("cy").alias("_y1"))
        boxes = scratch.write(boxes.withColumns({"_up_i": F.shiftright("_i", 2), "_up_j": F.shiftright("_j", 2)}), f"cells{level}")
        seen = kept.join(boxes, ["_up_i", "_up_j"]).groupBy("_pid", "_px", "_py").agg(
            F.min(_box_distance(px, py, near=False)).alias("_reach"),
            F.collect_list(F.struct(_box_distance(px, py, near=True).alias("d"), F.col("_i").alias("i"), F.col("_j").alias("j"))).alias("_cells"))
        # The margin covers the last bit of the two distances.
        near = F.filter("_cells", lambda c: c["d"] <= F.col("_reach") * F.lit(1 + 1e-12))
        kept = seen.select("_pid", "_px", "_py", F.explode(near).alias("_c")).select(
            "_pid", "_px", "_py", F.col("_c.i").alias("_up_i"), F.col("_c.j").alias("_up_j"))
    leaves = placed.select("*", *_cell(corner, width, depth)).withColumnsRenamed({"_i": "_up_i", "_j": "_up_j"})
    best = kept.join(leaves, ["_up_i", "_up_j"]).groupBy("_pid").agg(
        F.min(F.struct(euclid("_px", "_py", "cx", "cy").alias("d"), F.col("center_id").alias("id"))).alias("_best"))
    out = own.join(best, "_pid", "left")
    return out.select(*points.columns, F.col("_best.id").alias("nearest_center"), F.col("_best.d").alias("dist_to_center"))


#: exp(-x) is zero in double precision from here on.
VANISHES = 746.0


def distance_decay(
    points: DataFrame, centres: DataFrame, rate: float = 15.0, power: float = 4.0, radius: float = 1.0,
    base: float = 0.02, peak: float = 5.0, x: str = "x", y: str = "y", name: str = "density", chunk: int = CHUNK,
) -> DataFrame:
    """Intensity around centres: flat inside a radius, falling off beyond it, summed.

    Beyond a distance that ``rate`` and ``power`` set, the fall underflows to exactly zero. Centres are copied to the tiles of that
    width around them and joined to the points of each tile, so the sum is the full one and far centres cost nothing; tiles of many points are
    dealt over several tasks (``spread_keys``). Centres without a place or an intensity are left out; points without a place get NULL.
    """
    if rate <= 0 or power <= 0:
        raise ValueError("rate and power must be positive")
    scratch = Scratch(points.sparkSession, "decay")
    own = scratch.write(points.withColumn("_pid", F.monotonically_increasing_id()), "points")
    width = F.lit(float(max(radius, 0.0) + rate * VANISHES ** (1 / power)))
    tile = lambda v: F.floor(v / width).cast("bigint")
    places = own.select("_pid", F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py")).dropna().withColumns({
        "_i": tile(F.col("_px")), "_j": tile(F.col("_py"))})
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    sources = centres.select(F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy"), "intensity").dropna()
    sources = sources.withColumn("_o", around).select(
        "cx", "cy", "intensity", (tile(F.col("cx")) + F.col("_o.i")).alias("_i"), (tile(F.col("cy")) + F.col("_o.j")).alias("_j"))
    left, right = spread_keys(places, sources, ["_i", "_j"], "_pid", chunk)
    d = euclid("_px", "_py", "cx", "cy")
    fall = F.exp(-F.pow(d - F.lit(radius), F.lit(power)) / F.lit(rate**power))
    part = F.col("intensity") * F.lit(peak) * F.when(d < radius, F.lit(1.0)).otherwise(fall)
    sums = left.join(right, ["_i", "_j", "_part"]).groupBy("_pid").agg(F.sum(part).alias("_sum"))
    placed = F.col(x).isNotNull() & F.col(y).isNotNull()
    total = F.when(placed, F.coalesce("_sum", F.lit(0.0)) + F.lit(float(base)))
    return own.join(sums, "_pid", "left").select(*[c for c in points.columns if c != name], total.alias(name))


def repair_isolated(units: DataFrame, edges: DataFrame, region: str, rounds: int = 10, id_col: str = "precinct_id") -> DataFrame:
    """Units without a neighbour in their region take the most common neighbouring region.

    All units are judged together in each round (ties: the lowest region), so two
    isolated neighbours may swap; the loop stops when nothing changes, or after ``rounds``.
    ``isolated`` marks the units that still have neighbours, but none in their region, when it stops.
    """
    links = materialise(both_directions(edges), "links")
    now = materialise(units.select(id_col, region), "regions")

    def to_move() -> DataFrame:
        mine = now.select(F.col(id_col).alias("src"), F.col(region).alias("_own"))
        theirs = now.select(F.col(id_col).alias("dst"), F.col(region).alias("_other"))
        seen = links.join(mine, "src").join(theirs, "dst").groupBy("src", "_own", "_other").agg(
            F.count(F.lit(1)).alias("_n"))
        best = seen.groupBy("src", "_own").agg(
            F.max(F.col("_own") == F.col("_other")).alias("_kept"),
            F.min(F.struct((-F.col("_n")).alias("n"), F.col("_other").alias("r"))).alias("_best"))
        moves = best.where(~F.col("_kept")).select(F.col("src").alias(id_col), F.col("_best.r").alias("_to"))
        return materialise(moves, "moves")

    moves = to_move()
    for _ in range(rounds):
        if moves.isEmpty():
            break
        now = materialise(now.join(moves, id_col, "left").select(
            id_col, F.coalesce("_to", region).alias(region)), "regions")
        moves = to_move()
    left = moves.select(id_col, F.lit(True).alias("isolated"))
    return units.drop(region).join(now, id_col).join(left, id_col, "left").withColumn("isolated", F.coalesce("isolated", F.lit(False)))


def _verdicts(links: DataFrame, state: DataFrame) -> DataFrame:
    """For every undecided unit with neighbours: whether one that cannot change before it shares its region, whether one must be decided first, and the
    most common region around it (ties: the lowest)."""
    mine = state.where(~F.col("_done")).select(F.col("_id").alias("src"), F.col("_region").alias("_own"))
    theirs = state.select(F.col("_id").alias("dst"), F.col("_region").alias("_other"), F.col("_done").alias("_fixed"))
    before = F.col("dst") < F.col("src")
    seen = links.join(mine, "src").join(theirs, "dst").groupBy("src", "_own", "_other").agg(
        F.count(F.lit(1)).alias("_n"), F.max(~before | F.col("_fixed")).alias("_sure"), F.max(before & ~F.col("_fixed")).alias("_waits"))
    same = F.coalesce((F.col("_own") == F.col("_other")) & F.col("_sure"), F.lit(False))
    return seen.groupBy("src").agg(
        F.max(same).alias("_kept"), F.max("_waits").alias("_waits"),
        F.min(F.struct((-F.col("_n")).alias("n"), F.col("_other").alias("r"))).alias("_best")).withColumnRenamed("src", "_id")


def repair_in_order(units: DataFrame, edges: DataFrame, region: str, rounds: int = 10, id_col: str = "precinct_id") -> DataFrame:
    """Units without a neighbour in their region take the most common neighbouring region, one after another by id, in at most ``rounds`` sweeps.

    The result is that of a loop over the units in which every unit sees the moves before it, so neighbours never swap. The units of a sweep
    are not walked: one is decided as soon as a neighbour that cannot change before it shares its region, or all its neighbours of smaller id are
    decided. The first step decides nearly all; only chains of isolated neighbours take more. ``isolated`` marks
    the units that still have neighbours, but none in their region. Ids must be unique.
    """
    scratch, k = Scratch(units.sparkSession, "repair"), 0
    links = scratch.write(both_directions(edges).where("src <> dst").distinct(), "links")
    state = scratch.write(units.select(F.col(id_col).alias("_id"), F.col(region).alias("_region"), F.lit(False).alias("_done")), "state0")
    for _ in range(rounds):
        moved, open_ = 0, None
        while open_ != 0:
            free = ~F.col("_done") & ~F.coalesce("_kept", F.lit(True)) & ~F.coalesce("_waits", F.lit(False))
            judged = state.join(_verdicts(links, state), "_id", "left")
            # A unit without neighbours has no verdict and stays.
            waits = ~F.col("_done") & F.coalesce("_waits", F.lit(False)) & ~F.coalesce("_kept", F.lit(False))
            k += 1
            state = scratch.write(judged.select(
                "_id", F.when(free, F.col("_best.r")).otherwise(F.col("_region")).alias("_region"), (~waits).alias("_done"), free.alias("_moved")), f"state{k}")
            n, open_ = state.agg(F.count_if("_moved"), F.count_if(~F.col("_done"))).first()
            moved += n
            scratch.drop(f"state{k - 1}")
            state = state.drop("_moved")
        if not moved:
            break
        state = state.withColumn("_done", F.lit(False))
    around = links.join(state.select(F.col("_id").alias("src"), F.col("_region").alias("_own")), "src").join(
        state.select(F.col("_id").alias("dst"), F.col("_region").alias("_other")), "dst")
    left = around.groupBy(F.col("src").alias("_id")).agg(F.max(F.coalesce(F.col("_own") == F.col("_other"), F.lit(False))).alias("_shared"))
    out = units.drop(region).join(state.select(F.col("_id").alias(id_col), F.col("_region").alias(region)), id_col)
    out = out.join(left.withColumnRenamed("_id", id_col), id_col, "left")
    return out.withColumn("isolated", ~F.coalesce("_shared", F.lit(True))).drop("_shared")
