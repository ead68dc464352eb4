"""Spatial structure: contiguity, weights, autocorrelation, distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardwise import fixtures as fx
from wardwise.catalog.registry import R, query, r, rounded, view
from wardwise.operators import space

view("fx_corners", """
SELECT precinct_id, col + dx AS sx, row_no + dy AS sy FROM fx_cells, (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) AS c(dx, dy)
""")


@query("g15_queen_contiguity", """
SELECT DISTINCT a.precinct_id AS src, b.precinct_id AS dst FROM fx_corners a JOIN fx_corners b ON a.sx = b.sx AND a.sy = b.sy AND a.precinct_id < b.precinct_id
""")
def g15(spark, sf):
    return space.contiguity(fx.vertices(spark, sf))


@query("g15_border_contiguity", "SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM fx_edges")
def g15b(spark, sf):
    return space.contiguity(fx.vertices(spark, sf), min_shared=2)


view("fx_both", "SELECT src, dst FROM fx_edges UNION ALL SELECT dst AS src, src AS dst FROM fx_edges")
view("fx_weights", "SELECT src, dst, 1e0 / count(*) OVER (PARTITION BY src) AS w FROM fx_both")


@query("g16_row_weights", f"SELECT src, dst, {R('w', 'weight')} FROM fx_weights")
def g16(spark, sf):
    return rounded(space.row_weights(fx.edges(spark, sf)))


view("fx_values", """
SELECT 'per_minority' AS variable, precinct_id, per_minority AS v FROM fx_precincts
UNION ALL SELECT 'dem_voteshare' AS variable, precinct_id, dem_voteshare AS v FROM fx_precincts
""")
view("fx_dev", "SELECT variable, precinct_id, v - avg(v) OVER (PARTITION BY variable) AS z FROM fx_values")
view("fx_moran", """
SELECT variable, CAST(n AS DOUBLE) AS n, cross_sum, s0, s1, s2, zz, k FROM (
  SELECT variable, count(*) AS n, sum(c) AS cross_sum, sum(o) AS s0, sum(q) / 2 AS s1, sum(power(o + i, 2)) AS s2 FROM (
    SELECT a.variable, a.precinct_id, sum(w.w * a.z * b.z) AS c, sum(w.w) AS o, sum(t.w) AS i, sum(power(w.w + t.w, 2)) AS q
    FROM fx_dev a JOIN fx_weights w ON w.src = a.precinct_id JOIN fx_dev b ON b.variable = a.variable AND b.precinct_id = w.dst
    JOIN fx_weights t ON t.src = w.dst AND t.dst = w.src GROUP BY a.variable, a.precinct_id) u GROUP BY variable) s
JOIN (SELECT variable, sum(z * z) AS zz, count(*) * sum(power(z, 4)) / power(sum(z * z), 2) AS k FROM fx_dev GROUP BY variable) d USING (variable)
""")


#: Upper normal tail: the density summed by Simpson's rule.
_UPPER_P = """0.5e0 - z / 1000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 1001),
  lambda i: CASE WHEN i IN (0, 1000) THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END / 3 * exp(-power(z * i / 1000, 2) / 2)))"""


@query("g17_morans_i", f"""
SELECT variable, {R('i', 'morans_i')}, {R('e', 'expected')}, {R('v', 'variance', 9)}, {R('z', None, 5)}, {R(_UPPER_P, 'p_value', 5)}
FROM (SELECT *, (i - e) / sqrt(v) AS z FROM (SELECT *, (n * (s1 * (n * n - 3 * n + 3) - n * s2 + 3 * s0 * s0) - k * (s1 * (n * n - n) - 2 * n * s2 + 6 * s0 * s0))
    / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - e * e AS v
  FROM (SELECT *, n / s0 * cross_sum / zz AS i, -1e0 / (n - 1) AS e FROM fx_moran) a) b) c
""")
def g17(spark, sf):
    units = fx.precincts(spark, sf).select("precinct_id", "per_minority", "dem_voteshare").unpivot(
        ["precinct_id"], ["per_minority", "dem_voteshare"], "variable", "value")
    out = space.morans_i(units, fx.edges(spark, sf), "value", ["variable"])
    return out.select("variable", r("morans_i").alias("morans_i"), r("expected").alias("expected"),
                      r("variance", 9).alias("variance"), r("z", 5).alias("z"), r("p_value", 5).alias("p_value"))


# The loop itself: one cell a step, over the list of all regions, until a sweep changes nothing or ten are done.
view("fx_patches", """
SELECT precinct_id, row_number() OVER (ORDER BY precinct_id) AS pos, count(*) OVER () AS n, CAST(precinct_id * precinct_id * 7 % 11 % 4 + 1 AS BIGINT) AS geog_id FROM fx_cells
""")
view("fx_around", """
SELECT a.pos, list(b.pos ORDER BY b.pos) AS nb FROM fx_both e JOIN fx_patches a ON a.precinct_id = e.src JOIN fx_patches b ON b.precinct_id = e.dst GROUP BY a.pos
""")
view("fx_repair", """
SELECT CAST(0 AS BIGINT) AS step, any_value(n) AS n, list(geog_id ORDER BY pos) AS regions, true AS changed FROM fx_patches
UNION ALL
SELECT step + 1, n, CASE WHEN move THEN list_concat(regions[:spot - 1], [((best % 1000) + 1000) % 1000], regions[spot + 1:]) ELSE regions END,
  (spot > 1 AND changed) OR move
FROM (SELECT *, nb IS NOT NULL AND NOT list_contains(others, regions[spot]) AS move,
    list_min(list_transform(list_distinct(others), lambda g: g - 1000 * len(list_filter(others, lambda o: o = g)))) AS best
  FROM (SELECT s.*, nb, list_transform(nb, lambda p: regions[p]) AS others
    FROM (SELECT *, step % n + 1 AS spot FROM fx_repair WHERE step < 10 * n AND (step % n > 0 OR changed)) s LEFT JOIN fx_around ON fx_around.pos = s.spot) a) b
""")


@query("g18_repair_isolated_cells")
def g18(spark, sf):
    regions = fx.cells(spark, sf).select("precinct_id", (F.pmod(F.col("precinct_id") * 31, F.lit(5)) + 1).alias("geog_id"))
    return space.repair_isolated(regions, fx.edges(spark, sf), "geog_id")


@query("g18_repair_in_order", """
SELECT precinct_id, regions[pos] AS geog_id, nb IS NOT NULL AND NOT list_contains(list_transform(nb, lambda p: regions[p]), regions[pos]) AS isolated
FROM fx_patches LEFT JOIN fx_around USING (pos), (SELECT arg_max(regions, step) AS regions FROM fx_repair) r
""")
def g18o(spark, sf):
    i = F.col("precinct_id")
    regions = fx.cells(spark, sf).select("precinct_id", (i * i * 7 % 11 % 4 + 1).cast("bigint").alias("geog_id"))
    return space.repair_in_order(regions, fx.edges(spark, sf), "geog_id")


@query("j09_edge_cells", """
SELECT a.precinct_id, a.row_no, a.col, count(b.precinct_id) AS n_neighbours, count(b.precinct_id) < 8 AS edge_cell
FROM fx_cells a LEFT JOIN fx_cells b ON b.row_no BETWEEN a.row_no - 1 AND a.row_no + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND b.precinct_id <> a.precinct_id
GROUP BY a.precinct_id, a.row_no, a.col
""")
def j09(spark, sf):
    return space.neighbour_counts(fx.cells(spark, sf))


view("fx_centres", """
SELECT p_brand AS center_id, avg(col) AS x, avg(row_no) AS y, count(*) / 100e0 AS intensity
FROM fx_cells JOIN part ON p_partkey = precinct_id GROUP BY p_brand
""")


def centres(spark, sf):
    """One centre per brand, at the mean place of its precincts."""
    part = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("precinct_id"), "p_brand")
    return fx.cells(spark, sf).join(part, "precinct_id").groupBy(F.col("p_brand").alias("center_id")).agg(
        F.avg("col").alias("x"), F.avg("row_no").alias("y"), (F.count(F.lit(1)) / F.lit(100.0)).alias("intensity"))


def points(spark, sf):
    return fx.cells(spark, sf).select("precinct_id", F.col("col").cast("double").alias("x"), F.col("row_no").cast("double").alias("y"))


_D = "sqrt(power(c.col - k.x, 2) + power(c.row_no - k.y, 2))"


@query("j10_nearest_centre", f"""
SELECT c.precinct_id, arg_min(k.center_id, ({_D}, k.center_id)) AS nearest_center, {R(f'min({_D})', 'dist_to_center')}
FROM fx_cells c, fx_centres k GROUP BY c.precinct_id
""")
def j10(spark, sf):
    out = space.nearest_centre(points(spark, sf), centres(spark, sf))
    return rounded(out.select("precinct_id", "nearest_center", "dist_to_center"))


@query("g19_distance_decay", f"""
SELECT precinct_id, {R('0.02 + sum(intensity * 5 * CASE WHEN d < 1 THEN 1e0 ELSE exp(-power(d - 1, 4) / power(15e0, 4)) END)', 'density')}
FROM (SELECT c.precinct_id, k.intensity, {_D} AS d FROM fx_cells c, fx_centres k) t GROUP BY precinct_id
""")
def g19(spark, sf):
    return rounded(space.distance_decay(points(spark, sf), centres(spark, sf)).select("precinct_id", "density"))


