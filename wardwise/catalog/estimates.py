"""Ecological regression and inference against the truth."""

from __future__ import annotations

from wardwise import fixtures as fx
from wardwise.catalog import base
from wardwise.catalog.base import DK, _flag
from wardwise.catalog.registry import R, query, rounded, rs, view
from wardwise.operators import inference, regression
from wardwise.schemas import DISTRICT

#: Where the compared fits stop, so that the SQL ends soon: some districts have come to rest by then, the others must be told as not converged.
TOLERANCE, ROUNDS = 1e-3, 8
SHARES = ["true_minority_dem_share", "true_majority_dem_share"]


def _residuals(m: str) -> str:
    return (f"{R(f'{m}_minority_dem_share - true_minority_dem_share', f'{m}_minority_resid')}, "
            f"{R(f'{m}_majority_dem_share - true_majority_dem_share', f'{m}_majority_resid')}, "
            f"{m}_rpv - true_rpv AS {m}_rpv_error")


@query("d08_ecological_regression", f"""
SELECT {DK}, {rs('er_minority_dem_share', 'er_majority_dem_share', 'er_minority_se', 'er_majority_se', *SHARES)},
  er_rpv, true_rpv, {_residuals('er')}, n_precincts, total_population
FROM fx_er JOIN fx_truth USING ({DK})
""")
def d08(spark, sf):
    return rounded(regression.ecological_regression(base.units(spark, sf)))


@query("d09_inference_from_draws", f"""
SELECT {DK}, {rs('ei_minority_dem_share', 'ei_majority_dem_share', 'ei_minority_sd', 'ei_majority_sd', *SHARES)},
  ei_rpv, true_rpv, {_residuals('ei')}, n_precincts, total_population,
  {R('CAST(total_minority AS DOUBLE) / total_population', 'prop_minority')},
  {R('CAST(total_dem_votes AS DOUBLE) / (total_dem_votes + total_rep_votes)', 'prop_dem')}
FROM fx_ei JOIN fx_truth USING ({DK})
""")
def d09(spark, sf):
    out = inference.inference_from_draws(fx.drawn_units(spark, sf))
    return rounded(out.select(
        *DISTRICT, "ei_minority_dem_share", "ei_majority_dem_share", "ei_minority_sd", "ei_majority_sd", *SHARES,
        "ei_rpv", "true_rpv", "ei_minority_resid", "ei_majority_resid", "ei_rpv_error", "n_precincts",
        "total_population", "prop_minority", "prop_dem"))


# ------------------------------------------------------------- grid EM in SQL
_X, _T = "(CAST(n_minority AS DOUBLE) / population)", "(CAST(dem_votes AS DOUBLE) / population)"
view("fx_em_base", f"""
SELECT {DK}, precinct_id, n_minority, n_majority, x, t,
  CASE WHEN x > 0 AND x < 1 THEN greatest(0e0, (t - (1 - x)) / x) END AS lo,
  CASE WHEN x > 0 AND x < 1 THEN least(1e0, t / x) END AS hi
FROM (SELECT *, {_X} AS x, {_T} AS t FROM fx_units WHERE population > 0) u
""")
view("fx_em_p0", f"""
SELECT {DK}, greatest(0.05e0, least(0.95e0, coalesce(er_minority_dem_share, overall))) AS mu_b,
  greatest(0.05e0, least(0.95e0, coalesce(er_majority_dem_share, overall))) AS mu_w, 0.01e0 AS s_bb, 0.01e0 AS s_ww, 0e0 AS s_bw
FROM (SELECT {DK}, CAST(sum(dem_votes) AS DOUBLE) / nullif(sum(population), 0) AS overall
  FROM fx_units GROUP BY {DK} HAVING count(*) >= 3) u LEFT JOIN fx_er USING ({DK})
""")
# Grid points as lists, so that a precinct is one row of every round.
view("fx_em_grid", f"""
SELECT {DK}, precinct_id, n_minority, n_majority, x, t, lo IS NOT NULL AS mixed,
  CASE WHEN lo IS NOT NULL THEN list_transform(range(0, 21), lambda k: lo + (hi - lo) * CAST(k AS DOUBLE) / 20) END AS bs,
  CASE WHEN lo IS NOT NULL THEN list_transform(range(0, 21), lambda k: (t - x * (lo + (hi - lo) * CAST(k AS DOUBLE) / 20)) / (1 - x)) END AS ws FROM fx_em_base
""")


def _expect(params: str, more: str = "") -> str:
    """The E step on ``params``: every precinct's moments, with weights relative to the largest."""
    return f"""
SELECT {more}{DK}, precinct_id, n_minority, n_majority, mixed, mu_b, mu_w, s_bb, s_ww, s_bw,
  CASE WHEN mixed THEN list_inner_product(v, bs) / list_sum(v) WHEN x = 1 THEN t END AS e_b,
  CASE WHEN mixed THEN list_inner_product(v, ws) / list_sum(v) WHEN x = 0 THEN t END AS e_w,
  CASE WHEN mixed THEN list_inner_product(v, list_transform(bs, lambda b: b * b)) / list_sum(v) WHEN x = 1 THEN t * t END AS e_bb,
  CASE WHEN mixed THEN list_inner_product(v, list_transform(ws, lambda w: w * w)) / list_sum(v) WHEN x = 0 THEN t * t END AS e_ww,
  CASE WHEN mixed THEN list_inner_product(v, list_transform(bs, lambda b, i: b * ws[i])) / list_sum(v) END AS e_bw
FROM (SELECT *, list_transform(q, lambda z: exp(z - list_max(q))) AS v FROM (
  SELECT g.*, {more}mu_b, mu_w, s_bb, s_ww, s_bw,
    list_transform(bs, lambda b, i: -0.5e0 * (s_ww * power(b - mu_b, 2) - 2 * s_bw * (b - mu_b) * (ws[i] - mu_w) + s_bb * power(ws[i] - mu_w, 2))
      / (s_bb * s_ww - s_bw * s_bw)) AS q
  FROM {params} JOIN fx_em_grid g USING ({DK})) a) c"""


_P = ("b", "w", "bb", "ww", "bw")
_SUM = lambda e: " + ".join(f"coalesce(power({e.replace('#', c)}, 2), 0)" for c in _P)
# The same leaps as in ``inference._advance``: n_* are updated parameters, p_* those before, q_* where the two plain updates began.
view("fx_em_p", f"""
SELECT CAST(0 AS BIGINT) AS round, 0 AS phase, false AS rest, {DK}, mu_b AS q_b, mu_w AS q_w, s_bb AS q_bb, s_ww AS q_ww, s_bw AS q_bw, mu_b, mu_w, s_bb, s_ww, s_bw FROM fx_em_p0
UNION ALL
SELECT round + 1, CASE WHEN rest THEN 0 WHEN phase = 0 THEN 1 WHEN leap THEN 2 ELSE 0 END, rest, {DK},
  {', '.join(f'CASE WHEN phase = 0 THEN p_{c} ELSE q_{c} END' for c in _P)}, {', '.join(f'CASE WHEN leap AND NOT rest THEN z_{c} ELSE n_{c} END' for c in _P)}
FROM (SELECT *, greatest({', '.join(f'coalesce(abs(n_{c} - p_{c}), 0)' for c in _P)}) < {TOLERANCE!r} AS rest,
    phase = 1 AND curve > 0 AND NOT (z_bb <= 1e-5 OR z_ww <= 1e-5) AND abs(z_bw) <= 0.99e0 * sqrt(greatest(z_bb, 0e0) * greatest(z_ww, 0e0)) AS leap
  FROM (SELECT *, {', '.join(f'q_{c} - 2 * far * (p_{c} - q_{c}) + far * far * (n_{c} - 2 * p_{c} + q_{c}) AS z_{c}' for c in _P)}
    FROM (SELECT *, least(-sqrt(({_SUM('(p_# - q_#)')}) / nullif(curve, 0)), -1e0) AS far
      FROM (SELECT *, {_SUM('(n_# - 2 * p_# + q_#)')} AS curve
        FROM (SELECT round, phase, {DK}, {', '.join(f'q_{c}' for c in _P)}, p_b, p_w, p_bb, p_ww, p_bw, n_b, n_w, n_bb, n_ww,
            greatest(least(coalesce(cov, 0e0), 0.99e0 * sqrt(n_bb * n_ww)), -0.99e0 * sqrt(n_bb * n_ww)) AS n_bw
          FROM (SELECT round, {DK}, max(phase) AS phase, {', '.join(f'max(q_{c}) AS q_{c}' for c in _P)},
              max(mu_b) AS p_b, max(mu_w) AS p_w, max(s_bb) AS p_bb, max(s_ww) AS p_ww, max(s_bw) AS p_bw,
              avg(e_b) AS n_b, avg(e_w) AS n_w, avg(e_bb) - avg(e_b) * avg(e_b) + 1e-4 AS n_bb, avg(e_ww) - avg(e_w) * avg(e_w) + 1e-4 AS n_ww,
              avg(e_bw) - avg(e_b) FILTER (mixed) * avg(e_w) FILTER (mixed) AS cov
            FROM ({_expect('(SELECT * FROM fx_em_p WHERE NOT rest) p', 'round, phase, q_b, q_w, q_bb, q_ww, q_bw, ')}) e WHERE round < {ROUNDS} GROUP BY round, {DK}) m) a) b) c) d) s
""")
view("fx_em_last", f"SELECT * FROM fx_em_p WHERE rest OR round = {ROUNDS}")
view("fx_em_e", _expect("fx_em_last", "round, rest, "))
view("fx_em", f"""
SELECT {DK}, round AS rounds, rest AS converged, sum(n_minority * e_b) / nullif(sum(CASE WHEN e_b IS NOT NULL THEN n_minority END), 0) AS ei_minority_dem_share,
  sum(n_majority * e_w) / nullif(sum(CASE WHEN e_w IS NOT NULL THEN n_majority END), 0) AS ei_majority_dem_share,
  sqrt(sum(n_minority * n_minority * greatest(e_bb - e_b * e_b, 0e0))) / nullif(sum(CASE WHEN e_b IS NOT NULL THEN n_minority END), 0) AS ei_minority_sd,
  sqrt(sum(n_majority * n_majority * greatest(e_ww - e_w * e_w, 0e0))) / nullif(sum(CASE WHEN e_w IS NOT NULL THEN n_majority END), 0) AS ei_majority_sd
FROM fx_em_e GROUP BY {DK}, round, rest
""")


@query("d10_grid_inference", f"""
SELECT {DK}, {rs('ei_minority_dem_share', 'ei_majority_dem_share', 'ei_minority_sd', 'ei_majority_sd', digits=5)},
  {_flag('ei_minority_dem_share', 'ei_majority_dem_share')} AS ei_rpv, rounds, converged FROM fx_em
""")
def d10(spark, sf):
    return rounded(inference.grid_inference(base.units(spark, sf), tolerance=TOLERANCE, max_rounds=ROUNDS), 5)


@query("d10_grid_with_truth", f"""
SELECT {DK}, {rs('ei_minority_dem_share', 'ei_majority_dem_share', *SHARES, digits=4)},
  ei_rpv, true_rpv, {R('ei_minority_dem_share - true_minority_dem_share', 'ei_minority_resid', 4)},
  {R('ei_majority_dem_share - true_majority_dem_share', 'ei_majority_resid', 4)}, ei_rpv - true_rpv AS ei_rpv_error, n_precincts, total_population,
  {R('CAST(total_minority AS DOUBLE) / total_population', 'prop_minority', 4)},
  {R('CAST(total_dem_votes AS DOUBLE) / (total_dem_votes + total_rep_votes)', 'prop_dem', 4)}
FROM (SELECT *, {_flag('ei_minority_dem_share', 'ei_majority_dem_share')} AS ei_rpv FROM fx_em) e JOIN fx_truth USING ({DK})
""")
def d10t(spark, sf):
    out = inference.inference_on_grid(base.units(spark, sf), tolerance=TOLERANCE, max_rounds=ROUNDS)
    return rounded(out.select(
        *DISTRICT, "ei_minority_dem_share", "ei_majority_dem_share", *SHARES, "ei_rpv", "true_rpv", "ei_minority_resid", "ei_majority_resid",
        "ei_rpv_error", "n_precincts", "total_population", "prop_minority", "prop_dem"), 4)


@query("d11_residuals", f"""
SELECT {DK}, {_residuals('er')}, {_residuals('ei')} FROM fx_er JOIN fx_truth USING ({DK}) LEFT JOIN fx_ei USING ({DK})
""")
def d11(spark, sf):
    from wardwise.operators.rpv import residual_columns

    out = base.unlabelled(spark, sf).withColumns({**residual_columns("er"), **residual_columns("ei")})
    return rounded(out.select(*DISTRICT, *[f"{m}_{s}" for m in ("er", "ei") for s in
                                           ("minority_resid", "majority_resid", "rpv_error")]))


@query("fit_by_group", f"""
SELECT {DK}, count(*) AS n, {R("sum(CAST(dem_votes AS DOUBLE)) / sum(population)", 'share')} FROM fx_units GROUP BY {DK}
""")
def fit(spark, sf):
    """A user's own per-district estimator: here a plain mean, as a pandas function."""
    def share(pdf):
        first = pdf.iloc[:1][DISTRICT].copy()
        first["n"] = len(pdf)
        first["share"] = pdf["dem_votes"].sum() / pdf["population"].sum()
        return first

    schema = "map_id bigint, seg_level string, redist_level string, district_id bigint, n bigint, share double"
    columns = base.units(spark, sf).select(*DISTRICT, "dem_votes", "population")
    return rounded(regression.fit_by_group(columns, DISTRICT, share, schema))
