"""Error models over district results."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardwise import fixtures as fx
from wardwise.catalog import base
from wardwise.catalog.base import DK
from wardwise.catalog.registry import R, div, query, rounded, view
from wardwise.catalog.tables import G, _M
from wardwise.operators import models
from wardwise.plans.results import with_seats
from wardwise.schemas import DISTRICT, SCENARIO


def frame(spark, sf):
    return models.model_frame(base.results(spark, sf), fx.precincts(spark, sf))


view("fx_model", f"""
SELECT *, abs(er_minority_resid) * 100 AS y, {_M} * 100 AS x1, (CAST(total_majority AS DOUBLE) / total_population - s) * 100 AS x2
FROM fx_results, (SELECT sum(n_majority) / CAST(sum(population) AS DOUBLE) AS s FROM fx_precincts) t
""")
view("fx_ols2", """
SELECT *, (s22 * c1 - s12 * c2) / (s11 * s22 - s12 * s12) AS b1, (s11 * c2 - s12 * c1) / (s11 * s22 - s12 * s12) AS b2 FROM (
  SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, covar_pop(x1, x1) * count(*) AS s11, covar_pop(x2, x2) * count(*) AS s22,
    covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS c1, covar_pop(x2, y) * count(*) AS c2, covar_pop(y, y) * count(*) AS cy FROM fx_model) t
""")


@query("m01_ols_two_regressors", f"""
SELECT 'dem_margin' AS term, {R('b1', 'estimate', 5)}, {R('sqrt(v * s22 / d)', 'std_error', 5)} FROM (SELECT *, s11 * s22 - s12 * s12 AS d, (cy - b1 * c1 - b2 * c2) / (n - 3) AS v FROM fx_ols2) t
UNION ALL SELECT 'white_pop_diff' AS term, {R('b2', 'estimate', 5)}, {R('sqrt(v * s11 / d)', 'std_error', 5)} FROM (SELECT *, s11 * s22 - s12 * s12 AS d, (cy - b1 * c1 - b2 * c2) / (n - 3) AS v FROM fx_ols2) t
""")
def m01(spark, sf):
    tidy, _ = models.ols(frame(spark, sf), "error_minority_er", ["dem_margin", "white_pop_diff"])
    return rounded(tidy.where(F.col("term") != "(Intercept)").select("term", "estimate", "std_error"), 5)


# --------------------------------------------- least squares by sweeping, in SQL
view("fx_frame", f"""
SELECT *, abs(er_minority_resid) * 100 AS error_minority_er, abs(ei_minority_resid) * 100 AS error_minority_ei,
  abs(er_majority_resid) * 100 AS error_majority_er, abs(ei_majority_resid) * 100 AS error_majority_ei,
  CAST(seg_level = 'medium' AS DOUBLE) AS seg_medium, CAST(seg_level = 'high' AS DOUBLE) AS seg_high,
  CAST(redist_level = 'dem' AS DOUBLE) AS redis_dem, CAST(redist_level = 'rep' AS DOUBLE) AS redis_rep,
  {_M} * 100 AS dem_margin, (CAST(total_majority AS DOUBLE) / total_population - s) * 100 AS white_pop_diff
FROM fx_results, (SELECT sum(n_majority) / CAST(sum(population) AS DOUBLE) AS s FROM fx_precincts) t
""")


def _cell(i: int, j: int) -> str:
    return f"a_{min(i, j)}_{max(i, j)}"


def sweep(p: int, size: int) -> str:
    """Columns of a symmetric matrix of ``size`` columns after sweeping on column ``p``."""
    d = _cell(p, p)
    out = []
    for i in range(size):
        for j in range(i, size):
            if i == j == p:
                e = f"-1e0 / {d}"
            elif p in (i, j):
                e = f"{_cell(i, j)} / {d}"
            else:
                e = f"{_cell(i, j)} - {_cell(i, p)} * {_cell(j, p)} / {d}"
            out.append(f"{e} AS {_cell(i, j)}")
    return ", ".join(out)


def _product(term: str) -> str:
    return " * ".join(f"CAST({t} AS DOUBLE)" for t in term.split(":"))


def ols_sql(prefix: str, response: str, terms) -> str:
    """Rows of ``models.ols``: the views sweep the centred products of terms and response one term at a time."""
    k = len(terms)
    columns = ", ".join([*[f"{_product(t)} AS x{i}" for i, t in enumerate(terms)], f"CAST({response} AS DOUBLE) AS x{k}"])
    whole = " AND ".join(f"x{i} IS NOT NULL" for i in range(k + 1))
    cells = ", ".join(f"covar_pop(x{i}, x{j}) * count(*) AS {_cell(i, j)}" for i in range(k + 1) for j in range(i, k + 1))
    means = ", ".join(f"avg(x{i}) AS m{i}" for i in range(k + 1))
    keep = ", ".join(["n", "tss", *[f"m{i}" for i in range(k + 1)]])
    view(f"fx_{prefix}_s0", f"SELECT *, {_cell(k, k)} AS tss FROM (SELECT count(*) AS n, {means}, {cells} FROM (SELECT {columns} FROM fx_frame) q WHERE {whole}) c")
    for p in range(k):
        view(f"fx_{prefix}_s{p + 1}", f"SELECT {keep}, {sweep(p, k + 1)} FROM fx_{prefix}_s{p}")
    rows = [f"SELECT '{t}' AS term, {_cell(i, k)} AS estimate, sqrt(-{_cell(i, i)} * {_cell(k, k)} / (n - {k + 1})) AS std_error" for i, t in enumerate(terms)]
    constant = f"m{k}" + "".join(f" - m{i} * {_cell(i, k)}" for i in range(k))
    spread = "1e0 / n" + "".join(f" - m{i} * m{j} * {_cell(i, j)}" for i in range(k) for j in range(k))
    rows.append(f"SELECT '(Intercept)' AS term, {constant} AS estimate, sqrt(({spread}) * {_cell(k, k)} / (n - {k + 1})) AS std_error")
    stats = f", n, n - {k + 1} AS dof, 1 - {_cell(k, k)} / tss AS r2 FROM fx_{prefix}_s{k}"
    view(f"fx_{prefix}", " UNION ALL ".join(r + stats for r in rows))
    return f"fx_{prefix}"


#: Student's distribution as in ``fits.t_below``, and its 97.5 % point by the expansion in powers of 1 / dof.
_T_BELOW = """(0.5e0 + exp(lgamma((dof + 1) / 2e0) - lgamma(dof / 2e0)) / sqrt(pi()) * atan(abs(estimate / std_error) / sqrt(dof)) / 1000
  * list_sum(list_transform(range(0, 1001), lambda i: CASE WHEN i IN (0, 1000) THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END / 3
    * power(cos(atan(abs(estimate / std_error) / sqrt(dof)) * i / 1000), dof - 1))))"""
_Z = "1.959963984540054e0"
_T_POINT = f"""({_Z} + (power({_Z}, 3) + {_Z}) / (4e0 * dof) + (5 * power({_Z}, 5) + 16 * power({_Z}, 3) + 3 * {_Z}) / (96e0 * dof * dof)
  + (3 * power({_Z}, 7) + 19 * power({_Z}, 5) + 17 * power({_Z}, 3) - 15 * {_Z}) / (384e0 * dof * dof * dof))"""
_TESTED = f"""SELECT *, estimate / std_error AS statistic, greatest(2 * (1 - {_T_BELOW}), 0e0) AS p_value,
  estimate - {_T_POINT} * std_error AS conf_low, estimate + {_T_POINT} * std_error AS conf_high FROM """
TESTED = ["estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high"]


def tested(name: str, more: str = "") -> str:
    return f"SELECT term, {', '.join(R(c, None, 5) for c in TESTED)}{more} FROM ({_TESTED}{name}) {name}_t"


ERROR_MODELS = {(name, m): (f"error_minority_{m}", models.SPECIFICATIONS[name]) for name in ("base", "interactions", "interactions_2") for m in ("er", "ei")}
_OLS = {key: ols_sql(f"ols_{key[0]}_{key[1]}", *model) for key, model in ERROR_MODELS.items()}


@query("m01_error_models", " UNION ALL ".join(
    tested(v, f", '{name}' AS specification, '{m.upper()}' AS method, {R('r2', None, 5)}, CAST(n AS DOUBLE) AS n") for (name, m), v in _OLS.items()))
def m01all(spark, sf):
    rows = None
    for (name, m), (tidy, fit) in models.ols_all(frame(spark, sf), ERROR_MODELS).items():
        part = tidy.withColumns({"specification": F.lit(name), "method": F.lit(m.upper()), "r2": F.lit(fit["r2"]), "n": F.lit(fit["n"])})
        rows = part if rows is None else rows.unionByName(part)
    return rounded(rows, 5)


@query("m02_interaction_columns", f"""
SELECT {DK}, CAST(seg_level = 'medium' AND redist_level = 'dem' AS BIGINT) AS medium_dem, CAST(seg_level = 'medium' AND redist_level = 'rep' AS BIGINT) AS medium_rep,
  CAST(seg_level = 'high' AND redist_level = 'dem' AS BIGINT) AS high_dem, CAST(seg_level = 'high' AND redist_level = 'rep' AS BIGINT) AS high_rep,
  {R('x1 * x2', 'margin_gap')} FROM fx_model
""")
def m02(spark, sf):
    rows = models.with_interactions(frame(spark, sf), models.SPECIFICATIONS["interactions_2"])
    names = dict(zip([*models.CROSSED, "dem_margin:white_pop_diff"], ["medium_dem", "medium_rep", "high_dem", "high_rep", "margin_gap"], strict=True))
    return rounded(rows.select(*DISTRICT, *[F.col(f"`{c}`").alias(n) for c, n in names.items()]))


WITH_RPV = {f"{g}_{m}": (f"error_{g}_{m}", models.SPECIFICATIONS["with_rpv"]) for g in ("minority", "majority") for m in ("er", "ei")}
_RPV = {name: ols_sql(f"ols_rpv_{name}", *model) for name, model in WITH_RPV.items()}
_STARS = "CASE WHEN p_value < 0.01 THEN '***' WHEN p_value < 0.05 THEN '**' WHEN p_value < 0.1 THEN '*' ELSE '' END"


def wide_table(tables: dict[str, str], more: str = "") -> str:
    """``models.regression_table`` in SQL: one column of cells a model."""
    cells = " UNION ALL ".join(
        f"SELECT term, '{name}' AS model, printf('%.3f', estimate) || {_STARS} || ' (' || printf('%.3f', std_error) || ')' AS cell FROM ({_TESTED}{v}) {v}_t"
        for name, v in tables.items())
    picks = ", ".join(f"max(CASE WHEN model = '{name}' THEN cell END) AS {name}" for name in tables)
    return f"SELECT term, {picks} FROM ({cells}{more}) cells GROUP BY term"


@query("m03_errors_with_rpv", wide_table(_RPV))
def m03(spark, sf):
    return models.regression_table({name: tidy for name, (tidy, _) in models.ols_all(frame(spark, sf), WITH_RPV).items()})


# ------------------------------------------------ logits by Newton's method, in SQL
_K = len(models.BASE) + 1
_XS = ["1e0", *[f"CAST({t} AS DOUBLE)" for t in models.BASE]]
view("fx_logit_rows", f"""
SELECT {', '.join(f'{x} AS x{i}' for i, x in enumerate(_XS))}, CAST(er_rpv_correct AS DOUBLE) AS y FROM fx_frame
WHERE er_rpv_correct IS NOT NULL AND {' AND '.join(f'{t} IS NOT NULL' for t in models.BASE)}
""")
_BETA = ", ".join(f"b{i}" for i in range(_K))
_ETA = " + ".join(f"b{i} * x{i}" for i in range(_K))
_SUMS = ", ".join([*[f"sum(p * (1 - p) * x{i} * x{j}) AS {_cell(i, j)}" for i in range(_K) for j in range(i, _K)],
                   *[f"sum((y - p) * x{i}) AS {_cell(i, _K)}" for i in range(_K)], f"0e0 AS {_cell(_K, _K)}"])


def _swept(source: str, keep: str, size: int, upto: int) -> str:
    for p in range(upto):
        source = f"(SELECT {keep}, {sweep(p, size)} FROM {source} w{p})"
    return source


NEWTON = 12
view("fx_logit", f"""
SELECT CAST(0 AS BIGINT) AS round, {', '.join(f'0e0 AS b{i}' for i in range(_K))}
UNION ALL SELECT round + 1, {', '.join(f'b{i} + {_cell(i, _K)}' for i in range(_K))}
FROM {_swept(f"(SELECT round, {_BETA}, {_SUMS} FROM (SELECT *, 1 / (1 + exp(-({_ETA}))) AS p FROM fx_logit, fx_logit_rows WHERE round < {NEWTON}) q GROUP BY round, {_BETA})", f'round, {_BETA}', _K + 1, _K)} s
""")
# Inverse information and what the marginal effects need, at the last coefficients.
view("fx_logit_end", f"""
SELECT * FROM {_swept(f"(SELECT {_BETA}, mw, {', '.join(f'g{i}' for i in range(_K))}, {', '.join(_cell(i, j) for i in range(_K + 1) for j in range(i, _K + 1))} FROM (SELECT {_BETA}, avg(p * (1 - p)) AS mw, {', '.join(f'avg(p * (1 - p) * (1 - 2 * p) * x{i}) AS g{i}' for i in range(_K))}, {_SUMS} FROM (SELECT *, 1 / (1 + exp(-({_ETA}))) AS p FROM fx_logit, fx_logit_rows WHERE round = {NEWTON}) q GROUP BY {_BETA}) z)", f"{_BETA}, mw, {', '.join(f'g{i}' for i in range(_K))}", _K + 1, _K)} s
""")
#: Two-sided normal tail: the density summed by Simpson's rule.
_NORMAL_P = """greatest(1 - 2 * abs(z) / 1000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 1001),
  lambda i: CASE WHEN i IN (0, 1000) THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END / 3 * exp(-power(abs(z) * i / 1000, 2) / 2))), 0e0)"""
_LOGIT_ROWS = " UNION ALL ".join(
    f"SELECT '{t}' AS term, b{i} AS estimate, sqrt(-{_cell(i, i)}) AS std_error FROM fx_logit_end" for i, t in enumerate(["(Intercept)", *models.BASE]))


@query("m04_logit_correctness", f"""
SELECT term, {R('estimate', None, 5)}, {R('std_error', None, 5)}, {R('z', 'statistic', 5)}, {R(_NORMAL_P, 'p_value', 5)},
  {R(f'estimate - {_Z} * std_error', 'conf_low', 5)}, {R(f'estimate + {_Z} * std_error', 'conf_high', 5)}
FROM (SELECT *, estimate / std_error AS z FROM ({_LOGIT_ROWS}) l) t
""")
def m04(spark, sf):
    return rounded(models.logit(frame(spark, sf), "er_rpv_correct", models.BASE)[0], 5)


@query("m04_logit_profile_intervals")
def m04p(spark, sf):
    """Without SQL: the ends are roots of constrained likelihoods. ``tests/test_models.py`` holds them against nested fits."""
    return rounded(models.logit(frame(spark, sf), "er_rpv_correct", models.BASE, profile=True)[0], 5)


_LABELS = " ".join(f"WHEN '{t}' THEN '{label}'" for t, label in models.TERM_LABELS.items())


@query("m05_coefficient_table", " UNION ALL ".join(
    f"SELECT term, {', '.join(TESTED)}, CASE term {_LABELS} END AS term_label, '{m.upper()}' AS method FROM ({tested(_OLS['base', m])}) c{m} WHERE term <> '(Intercept)' "
    f"UNION ALL SELECT 'reference', 0e0, 0e0, NULL, NULL, 0e0, 0e0, '{models.REFERENCE_LABEL}', '{m.upper()}'" for m in ("er", "ei")))
def m05(spark, sf):
    fits = models.ols_all(frame(spark, sf), {m.upper(): (f"error_minority_{m}", models.BASE) for m in ("er", "ei")})
    return rounded(models.coefficient_table({m: tidy for m, (tidy, _) in fits.items()}), 5)


def _effect(i: int) -> str:
    """Average marginal effect of term ``i`` with its standard error by the delta method."""
    d = [f"(b{i} * g{j}" + (" + mw)" if i == j else ")") for j in range(_K)]
    square = " + ".join(f"{d[j]} * {d[k]} * -{_cell(j, k)}" for j in range(_K) for k in range(_K))
    return f"SELECT '{models.BASE[i - 1]}' AS term, b{i} * mw AS ame, sqrt({square}) AS std_error FROM fx_logit_end"


@query("m06_marginal_effects", f"""
SELECT term, {R('ame', None, 5)}, {R('std_error', None, 5)}, {R('ame / std_error', 'z', 5)} FROM ({' UNION ALL '.join(_effect(i) for i in range(1, _K))}) t
""")
def m06(spark, sf):
    return rounded(models.marginal_effects(frame(spark, sf), "er_rpv_correct", models.BASE), 5)


_SEVEN = {f"{name}_{m}": _OLS[name, m] for name in ("base", "interactions") for m in ("er", "ei")}
_FIT_ROWS = "".join(
    f" UNION ALL SELECT '{label}', '{name}', {text} FROM (SELECT DISTINCT n, dof, r2 FROM {v}) {v}_f{k}"
    for name, v in _SEVEN.items() for k, (label, text) in enumerate((
        ("N", "CAST(n AS VARCHAR)"), ("R2", "printf('%.3f', r2)"), ("Adjusted R2", "printf('%.3f', 1 - (1 - r2) * (n - 1) / dof)"))))


@query("m07_regression_table", wide_table(_SEVEN, _FIT_ROWS))
def m07(spark, sf):
    wanted = {f"{name}_{m}": ERROR_MODELS[name, m] for name in ("base", "interactions") for m in ("er", "ei")}
    fits = models.ols_all(frame(spark, sf), wanted)
    return models.regression_table({k: tidy for k, (tidy, _) in fits.items()}, {k: fit for k, (_, fit) in fits.items()})


view("fx_logits_rows", f"SELECT {G}, CAST(minority_wasted_total AS DOUBLE) AS x, CAST(true_rpv AS DOUBLE) AS y FROM fx_results WHERE minority_wasted_total IS NOT NULL AND true_rpv IS NOT NULL")
_TWO = "sum(p * (1 - p)) AS a, sum(p * (1 - p) * x) AS b, sum(p * (1 - p) * x * x) AS c, sum(y - p) AS u, sum((y - p) * x) AS v"
view("fx_logits", f"""
SELECT CAST(0 AS BIGINT) AS round, {G}, 0e0 AS b0, 0e0 AS b1 FROM fx_logits_rows GROUP BY {G} HAVING min(y) < max(y)
UNION ALL SELECT round + 1, {G}, b0 + (c * u - b * v) / (a * c - b * b), b1 + (a * v - b * u) / (a * c - b * b)
FROM (SELECT round, {G}, b0, b1, {_TWO} FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM fx_logits JOIN fx_logits_rows USING ({G}) WHERE round < {NEWTON}) q
  GROUP BY round, {G}, b0, b1) s
""")
view("fx_logits_end", f"""
SELECT {G}, b0, b1, a / (a * c - b * b) AS v1, c / (a * c - b * b) AS v0 FROM (SELECT {G}, b0, b1, {_TWO}
  FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM fx_logits JOIN fx_logits_rows USING ({G}) WHERE round = {NEWTON}) q GROUP BY {G}, b0, b1) s
""")


@query("m08_logit_by_scenario", f"""
SELECT term, {R('estimate', None, 5)}, {R('std_error', None, 5)}, {R('z', 'statistic', 5)}, {R(_NORMAL_P, 'p_value', 5)},
  {R(f'estimate - {_Z} * std_error', 'conf_low', 5)}, {R(f'estimate + {_Z} * std_error', 'conf_high', 5)}, {G}
FROM (SELECT *, estimate / std_error AS z FROM (SELECT '(Intercept)' AS term, b0 AS estimate, sqrt(v0) AS std_error, {G} FROM fx_logits_end
  UNION ALL SELECT 'minority_wasted_total' AS term, b1, sqrt(v1), {G} FROM fx_logits_end) l) t
""")
def m08(spark, sf):
    return rounded(models.logit_by_scenario(base.results(spark, sf), "true_rpv", "minority_wasted_total"), 5)


@query("m09_linear_trend", f"""
SELECT {G}, {R('regr_slope(y, x)', 'slope')}, {R('regr_intercept(y, x)', 'intercept')}, {R('regr_r2(y, x)', 'r2')}, count(*) AS n
FROM (SELECT {G}, CAST(total_dem_votes AS DOUBLE) / 100 AS x, {div('minority_wasted_total', 'total_minority')} AS y FROM fx_results) t GROUP BY {G}
""")
def m09(spark, sf):
    rows = with_seats(base.results(spark, sf)).withColumns({
        "x": F.col("total_dem_votes") / 100, "y": F.try_divide("minority_wasted_total", F.col("total_minority").cast("double"))})
    return rounded(models.linear_trend(rows, "x", "y", SCENARIO))


@query("m10_clusters")
def m10(spark, sf):
    return models.cluster(fx.precincts(spark, sf), ["per_minority", "dem_voteshare"], 5).select("precinct_id", "geog_id")


# Centres that three starts begin at, in standard deviations.
STARTS = [[[-1.0, -1.0], [0.0, 1.0], [1.0, -0.5]], [[-2.0, 0.0], [-1.5, 0.0], [2.0, 2.0]], [[0.0, -0.1], [0.0, 0.0], [0.0, 0.1]]]
LLOYD = 100
view("fx_z", """
SELECT precinct_id, (per_minority - avg(per_minority) OVER ()) / stddev_samp(per_minority) OVER () AS x,
  (dem_voteshare - avg(dem_voteshare) OVER ()) / stddev_samp(dem_voteshare) OVER () AS y FROM fx_precincts
""")
# Each round assigns every row, and averages; a cluster keeps its place in the list of centres.
view("fx_lloyd", f"""
SELECT CAST(0 AS BIGINT) AS round, CAST(s AS BIGINT) AS s, CAST(c AS BIGINT) AS c, x, y
FROM (VALUES {', '.join(f'({s}, {c}, {x}e0, {y}e0)' for s, own in enumerate(STARTS) for c, (x, y) in enumerate(own))}) AS v(s, c, x, y)
UNION ALL SELECT round + 1, s, c, avg(x), avg(y) FROM (
  SELECT round, s, precinct_id, arg_min(c, (d, c)) AS c, any_value(x) AS x, any_value(y) AS y
  FROM (SELECT round, s, c, z.precinct_id, z.x, z.y, (z.x - k.x) * (z.x - k.x) + (z.y - k.y) * (z.y - k.y) AS d FROM fx_lloyd k, fx_z z WHERE round < {LLOYD}) q
  GROUP BY round, s, precinct_id) a GROUP BY round, s, c
""")
view("fx_placed", f"""
SELECT s, precinct_id, min(d) AS d, arg_min(c, (d, c)) AS c FROM (
  SELECT s, row_number() OVER (PARTITION BY s, z.precinct_id ORDER BY k.x, k.y) AS c, z.precinct_id, (z.x - k.x) * (z.x - k.x) + (z.y - k.y) * (z.y - k.y) AS d
  FROM fx_lloyd k, fx_z z WHERE round = {LLOYD}) q GROUP BY s, precinct_id
""")


@query("m10_clusters_from_given_starts", """
SELECT precinct_id, CAST(c AS BIGINT) AS geog_id FROM fx_placed WHERE s = (SELECT arg_min(s, (round(total, 6), s)) FROM (SELECT s, sum(d) AS total FROM fx_placed GROUP BY s) t)
""")
def m10g(spark, sf):
    return models.cluster(fx.precincts(spark, sf), ["per_minority", "dem_voteshare"], 3, centres=STARTS).select("precinct_id", "geog_id")


@query("m11_voters_with_cluster", """
SELECT voter_id, precinct_id, race, vote, CAST(row_no // 10 AS BIGINT) AS geog_id FROM fx_voters JOIN fx_cells USING (precinct_id)
""")
def m11(spark, sf):
    regions = fx.cells(spark, sf).withColumn("geog_id", F.floor(F.col("row_no") / 10).cast("bigint"))
    return models.assign_voters(fx.voters(spark, sf), regions).select("voter_id", "precinct_id", "race", "vote", "geog_id")
