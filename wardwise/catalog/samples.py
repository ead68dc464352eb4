"""Sampling: hash order, weighted draws, calibration, raking, scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardwise import fixtures as fx
from wardwise.catalog import base
from wardwise.catalog.order import turn
from wardwise.catalog.registry import R, cut_sql, number, query, r, rounded, view
from wardwise.operators import report, sampling, shapes
from wardwise.plans import results as res

TENTHS = [i * 0.1 for i in range(11)]
TARGET = 0.325


@query("k06_hash_sample", "SELECT block_id FROM fx_turn ORDER BY u, block_id LIMIT 500")
def k06(spark, sf):
    return sampling.hash_sample(fx.blocks(spark, sf), 500, ["block_id"], noise=turn()).select("block_id")


@query("k06_large_sample", "SELECT block_id FROM fx_turn ORDER BY u, block_id LIMIT (SELECT count(*) // 3 FROM fx_blocks)")
def k06l(spark, sf):
    """By counts of the noise and a filter, as samples of any size are."""
    blocks = fx.blocks(spark, sf)
    return sampling.hash_sample(blocks, blocks.count() // 3, ["block_id"], noise=turn(), merged=0).select("block_id")


@query("k07_sample_per_group", """
SELECT category, block_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY u, block_id) AS rn FROM fx_turn) t WHERE rn <= 300
""")
def k07(spark, sf):
    out = sampling.hash_sample(fx.blocks(spark, sf), 300, ["block_id"], by=["category"], noise=turn())
    return out.select("category", "block_id")


@query("k08_one_scenario_per_plan", "SELECT seg_level, map_id, min(redist_level) AS redist_level FROM fx_results_all GROUP BY seg_level, map_id")
def k08(spark, sf):
    return res.pick_one(base.results_all(spark, sf), ["seg_level", "map_id"], "redist_level")


@query("k09_shuffle_within", "SELECT block_id, row_number() OVER (PARTITION BY category ORDER BY u, block_id) AS position FROM fx_turn")
def k09(spark, sf):
    return sampling.shuffle_within(fx.blocks(spark, sf), ["category"], "block_id", turn()).select("block_id", "position")


def u_of(j):
    return F.pmod(j * 7919 + 17, F.lit(10007)).cast("double") / F.lit(10007.0)


def u_of_two(a, j):
    return F.pmod(j * 7919 + a * 104729 + 17, F.lit(10007)).cast("double") / F.lit(10007.0)


_U2 = "CAST((j * 7919 + {a} * 104729 + 17) % 10007 AS DOUBLE) / 10007"

view("fx_target_units", f"""
SELECT *, sum(wu) OVER (ORDER BY block_id ROWS UNBOUNDED PRECEDING) - wu AS start, sum(wu) OVER () AS total FROM (
  SELECT *, CAST(round_even(w / sum(w) OVER () * 1125899906842624e0, 0) AS HUGEINT) AS wu
  FROM (SELECT *, 1 / (abs(per_minority - {TARGET}e0) + 0.001e0) AS w FROM fx_blocks) a) b
""")
view("fx_target_picks", """
SELECT d.j, s.block_id, s.population FROM (
  SELECT j, floor(CAST((j * 7919 + 17) % 10007 AS DOUBLE) / 10007 * t) AS p
  FROM (SELECT unnest(range(1, (SELECT 3 * count(*) FROM fx_blocks))) AS j), (SELECT CAST(max(total) AS DOUBLE) AS t FROM fx_target_units) q) d
JOIN (SELECT *, CAST(start AS DOUBLE) AS s0, CAST(start + wu AS DOUBLE) AS s1 FROM fx_target_units) s ON d.p >= s.s0 AND d.p < s.s1
""")


@query("k10_weighted_bootstrap", """
SELECT j AS draw, block_id, population, CAST(cum AS BIGINT) AS cum FROM (
  SELECT *, sum(population) OVER (ORDER BY j ROWS UNBOUNDED PRECEDING) AS cum FROM fx_target_picks) t
WHERE cum <= (SELECT floor(sum(population) / 2) FROM fx_blocks)
""")
def k10(spark, sf):
    blocks = fx.blocks(spark, sf).withColumn("weight", sampling.target_weight("per_minority", TARGET))
    until = blocks.agg(F.floor(F.sum("population") / 2)).first()[0]
    out = sampling.weighted_bootstrap(blocks, "weight", until, "population", "block_id", noise=u_of)
    return out.select("draw", "block_id", "population", "cum")


view("fx_strata", f"""
SELECT *, sum(population) OVER (PARTITION BY stratum ORDER BY block_id ROWS UNBOUNDED PRECEDING) - population AS start, sum(population) OVER (PARTITION BY stratum) AS total
FROM (SELECT *, {cut_sql('per_minority', TENTHS, include_lowest=True)} AS stratum FROM fx_blocks) a
""")
# As many rounds as the mean draw makes likely, and a tenth and ten more.
view("fx_strata_picks", f"""
SELECT d.j, d.stratum, s.block_id, s.population, s.per_minority FROM (
  SELECT stratum, j, floor({_U2.format(a='stratum')} * CAST(t AS DOUBLE)) AS p FROM (SELECT stratum, max(total) AS t FROM fx_strata GROUP BY stratum) g,
    (SELECT unnest(range(1, 11 + (SELECT CAST(floor(1.1e0 * u / sum(m)) AS BIGINT) FROM
      (SELECT sum(CAST(population AS DOUBLE) * population) / sum(population) AS m FROM fx_strata GROUP BY stratum) x,
      (SELECT floor(sum(population) / 2) AS u FROM fx_blocks) y GROUP BY u))) AS j) r) d
ASOF JOIN (SELECT *, CAST(start AS DOUBLE) AS s0 FROM fx_strata WHERE population > 0) s ON d.stratum = s.stratum AND d.p >= s.s0
""")
view("fx_strata_kept", """
SELECT * FROM fx_strata_picks WHERE j IN (SELECT j FROM (SELECT j, t, sum(t) OVER (ORDER BY j ROWS UNBOUNDED PRECEDING) AS cum
  FROM (SELECT j, sum(population) AS t FROM fx_strata_picks GROUP BY j) a) b WHERE cum - t < (SELECT floor(sum(population) / 2) FROM fx_blocks))
""")


@query("k11_stratified_bootstrap", f"""
SELECT j AS draw, stratum, block_id, {R(f'greatest(0.001e0, least(0.999e0, per_minority * (0.7e0 + 0.3e0 * ({TARGET}e0 / m))))', 'per_minority_adj')}
FROM fx_strata_kept, (SELECT sum(per_minority * population) / sum(population) AS m FROM fx_strata_kept) q
""")
def k11(spark, sf):
    blocks = fx.blocks(spark, sf)
    until = blocks.agg(F.floor(F.sum("population") / 2)).first()[0]
    out = sampling.stratified_bootstrap(blocks, "per_minority", "population", until, TARGET, "block_id", noise=u_of_two)
    return rounded(out.select("draw", "stratum", "block_id", "per_minority_adj"))


view("fx_tiles", """
SELECT *, row_number() OVER (PARTITION BY decile ORDER BY block_id) AS rn, count(*) OVER (PARTITION BY decile) AS size
FROM (SELECT *, ntile(10) OVER (ORDER BY per_minority, block_id) AS decile FROM fx_blocks) a
""")


@query("k12_decile_bootstrap", f"""
SELECT d.decile, d.j AS draw, t.block_id FROM (
  SELECT decile, size, unnest(range(1, CAST(round_even(floor(n / 2e0) * size / n, 0) AS BIGINT) + 1)) AS j FROM
    (SELECT DISTINCT decile, size FROM fx_tiles) g, (SELECT CAST(count(*) AS DOUBLE) AS n FROM fx_blocks) c) d
JOIN fx_tiles t ON t.decile = d.decile AND t.rn = CAST(floor({_U2.format(a='d.decile')} * d.size) AS BIGINT) + 1
""")
def k12(spark, sf):
    blocks = fx.blocks(spark, sf)
    out = sampling.decile_bootstrap(blocks, "per_minority", blocks.count() // 2, "block_id", noise=u_of_two)
    return out.select("decile", "draw", "block_id")


view("fx_mean_share", "SELECT sum(per_minority * population) / sum(population) AS m FROM fx_blocks")
_ADD = f"CASE WHEN abs(m - {TARGET}e0) > 0.02 THEN greatest(0.001e0, least(0.999e0, per_minority + ({TARGET}e0 - m) / 2)) ELSE per_minority END"
_MUL = f"CASE WHEN abs(m - {TARGET}e0) > 0.02 THEN greatest(0e0, least(1e0, per_minority * {TARGET}e0 / m)) ELSE per_minority END"
view("fx_methods", f"""
SELECT 'natural' AS method, block_id, population, per_minority FROM fx_blocks
UNION ALL SELECT 'additive' AS method, block_id, population, {_ADD} AS per_minority FROM fx_blocks, fx_mean_share
UNION ALL SELECT 'multiplicative' AS method, block_id, population, {_MUL} AS per_minority FROM fx_blocks, fx_mean_share
""")


def methods(spark, sf):
    blocks = fx.blocks(spark, sf).select("block_id", "population", "per_minority")
    return shapes.union_all({
        "natural": blocks,
        "additive": sampling.calibrate(blocks, "per_minority", "population", TARGET),
        "multiplicative": sampling.calibrate(blocks, "per_minority", "population", TARGET, "multiplicative"),
    }, tag="method")


@query("k12_calibrate", f"SELECT method, block_id, population, {R('per_minority')} FROM fx_methods")
def k12c(spark, sf):
    return rounded(methods(spark, sf))


@query("a40_sample_scorecard", f"""
SELECT method, n_precincts, total_population, {R('a', 'achieved_minority')}, {R('mean', 'minority_mean')}, {R('sd', 'minority_sd')}, {R('lo', 'minority_min')},
  {R('hi', 'minority_max')}, {R('b10', 'prop_below_10pct')}, {R('a50', 'prop_above_50pct')}, {R('a90', 'prop_above_90pct')},
  precincts_at_bounds, {R('hi - lo', 'minority_range')}, {R(f'a - {TARGET}e0', 'error_from_target')}
FROM (SELECT method, count(*) AS n_precincts, CAST(sum(population) AS BIGINT) AS total_population, sum(population * per_minority) / sum(population) AS a,
  avg(per_minority) AS mean, stddev_samp(per_minority) AS sd, min(per_minority) AS lo, max(per_minority) AS hi,
  avg(CASE WHEN per_minority < 0.1e0 THEN 1e0 ELSE 0e0 END) AS b10, avg(CASE WHEN per_minority > 0.5e0 THEN 1e0 ELSE 0e0 END) AS a50,
  avg(CASE WHEN per_minority > 0.9e0 THEN 1e0 ELSE 0e0 END) AS a90, count(*) FILTER (WHERE per_minority <= 0.001e0 OR per_minority >= 0.999e0) AS precincts_at_bounds
  FROM fx_methods GROUP BY method) t
""")
def a40(spark, sf):
    return rounded(report.sample_scorecard(methods(spark, sf), TARGET))


@query("a41_percentile_profile", " UNION ALL ".join(
    f"SELECT {number(float(p) * 100)} AS percentile, " + ", ".join(
        R(f"quantile_cont(per_minority, {p}) FILTER (WHERE method = '{m}')", m) for m in ("natural", "additive", "multiplicative"))
    + " FROM fx_methods" for p in report.PROFILE))
def a41(spark, sf):
    return rounded(report.percentile_profile(methods(spark, sf), "per_minority", ["natural", "additive", "multiplicative"]))


view("fx_lines", "SELECT *, sum(population) OVER (ORDER BY block_id ROWS UNBOUNDED PRECEDING) - population AS start FROM fx_blocks")
# Draws of equal noise fall on one row, so the places are looked up once for each value of the noise.
view("fx_noise_rows", """
SELECT n, block_id, population, per_minority FROM (
  SELECT n, floor(CAST(n AS DOUBLE) / 10007 * t) AS p FROM (SELECT unnest(range(0, 10007)) AS n) a, (SELECT CAST(sum(population) AS DOUBLE) AS t FROM fx_blocks) c) d
ASOF JOIN (SELECT *, CAST(start AS DOUBLE) AS s0 FROM fx_lines WHERE population > 0) s ON d.p >= s.s0
""")
view("fx_attempts", """
SELECT attempt, j, block_id, population, per_minority FROM (
  SELECT attempt, j, (j * 7919 + attempt * 104729 + 17) % 10007 AS n FROM (SELECT unnest(range(1, 1001)) AS attempt) a,
    (SELECT unnest(range(1, (SELECT count(*) // 4 FROM fx_blocks) + 1)) AS j) b) d JOIN fx_noise_rows USING (n)
""")


@query("k13_bootstrap_until", f"""
SELECT j AS draw, attempt, block_id FROM fx_attempts WHERE attempt = (
  SELECT coalesce(min(attempt) FILTER (WHERE o < 0.002e0), arg_min(attempt, (o, attempt))) FROM
    (SELECT attempt, abs(sum(population * per_minority) / sum(population) - {TARGET}e0) AS o FROM fx_attempts GROUP BY attempt) t)
""")
def k13(spark, sf):
    blocks = fx.blocks(spark, sf)
    out = sampling.bootstrap_until(
        blocks, "per_minority", "population", blocks.count() // 4, TARGET, "block_id", tol=0.002, attempts=1000, noise=u_of_two)
    return out.select("draw", "attempt", "block_id")


view("fx_rake0", "SELECT block_id, population, per_minority, 1e0 AS w FROM fx_blocks")
RAKES = 20
for _i in range(RAKES):
    view(f"fx_rake{_i + 1}", f"""
SELECT block_id, population, per_minority, CASE WHEN abs(m - 0.5e0) < 0.001e0 THEN w
  ELSE greatest(0.1e0, least(10e0, w * (1 + (0.5e0 / m - 1) * abs(per_minority - 0.5e0)))) END AS w
FROM fx_rake{_i}, (SELECT sum(population * per_minority * w) / sum(population * w) AS m FROM fx_rake{_i}) q
""")


@query("k14_rake", f"SELECT block_id, {R('w', 'rake_weight')} FROM fx_rake{RAKES}")
def k14(spark, sf):
    out = sampling.rake(fx.blocks(spark, sf), "per_minority", "population", 0.5, max_iter=RAKES)
    return out.select("block_id", r("rake_weight").alias("rake_weight"))


def picks_sql(weights: str, sample: int, source: str) -> str:
    """Draws j with the rows of ``source`` that they fall on, by the weight w."""
    return f"""
SELECT d.j, s.* FROM (SELECT j, floor({_U2.format(a=sample)} * t) AS p FROM (SELECT unnest(range(1, 1 + (
    SELECT CAST(ceil(floor(sum(population) / 2) / avg(population)) AS BIGINT) FROM fx_blocks))) AS j) r, (SELECT CAST(max(wend) AS DOUBLE) AS t FROM {weights}) q) d
ASOF JOIN (SELECT {source}, CAST(wend - wu AS DOUBLE) AS s0 FROM {weights} WHERE wu > 0) s ON d.p >= s.s0"""


def laid_sql(source: str, weight: str, order: str) -> str:
    return f"""
SELECT *, sum(wu) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS wend FROM (
  SELECT *, CASE WHEN {weight} > 0 THEN greatest(CAST(round_even({weight} / sum({weight}) OVER () * 1125899906842624e0, 0) AS HUGEINT), 1) END AS wu FROM {source}) a"""


view("fx_diverse", laid_sql("(SELECT *, population * (1e0 + abs(per_minority - 0.5e0)) AS dw FROM fx_blocks)", "dw", "block_id"))
view("fx_first", f"SELECT j AS first_draw, block_id, population, per_minority FROM ({picks_sql('fx_diverse', 1, 'block_id, population, per_minority')}) p")
view("fx_raked0", "SELECT first_draw, block_id, population, per_minority, 1e0 AS w FROM fx_first")
for _i in range(RAKES):
    view(f"fx_raked{_i + 1}", f"""
SELECT first_draw, block_id, population, per_minority, CASE WHEN abs(m - 0.5e0) < 0.001e0 THEN w
  ELSE greatest(0.1e0, least(10e0, w * (1 + (0.5e0 / m - 1) * abs(per_minority - 0.5e0)))) END AS w
FROM fx_raked{_i}, (SELECT sum(population * per_minority * w) / sum(population * w) AS m FROM fx_raked{_i}) q
""")
view("fx_raked_units", laid_sql(f"fx_raked{RAKES}", "w", "first_draw"))


@query("k14_rake_sample", f"""
SELECT j AS draw, first_draw, block_id, {R('w', 'rake_weight')} FROM ({picks_sql('fx_raked_units', 2, 'first_draw, block_id, w')}) p
""")
def k14s(spark, sf):
    blocks = fx.blocks(spark, sf)
    total = blocks.agg(F.floor(F.sum("population") / 2)).first()[0]
    out = sampling.rake_sample(blocks, "per_minority", "population", total, 0.5, "block_id", noise=u_of_two)
    return out.select("draw", "first_draw", "block_id", r("rake_weight").alias("rake_weight"))


_PROBES = [0.0, 0.05, 0.1, 0.32, 0.5, 0.9, 1.0]


@query("k15_nearest_rows", " UNION ALL ".join(
    f"(SELECT {number(p)} AS probe, block_id, {R('per_minority')} FROM fx_blocks ORDER BY abs(per_minority - {number(p)}), block_id LIMIT 1)" for p in _PROBES))
def k15(spark, sf):
    return rounded(sampling.nearest_rows(fx.blocks(spark, sf), "per_minority", _PROBES, "block_id"))
