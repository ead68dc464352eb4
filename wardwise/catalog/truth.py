"""District truth, summaries, polarization flags and wasted votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardwise import fixtures as fx
from wardwise.catalog import base
from wardwise.catalog.base import DK
from wardwise.catalog.registry import R, div, query, r, rounded, rs, view

from wardwise.operators import frames, rpv, waste
from wardwise.plans import results as res
from wardwise.schemas import DISTRICT

TOTALS = ("total_population, total_minority, total_majority, total_dem_votes, total_rep_votes, "
          "true_minority_dem_votes, true_majority_dem_votes, n_precincts")
SHARES = ["true_minority_dem_share", "true_majority_dem_share", "true_overall_dem_share"]


@query("a01_district_truth", f"SELECT {DK}, {TOTALS}, {rs(*SHARES)}, true_rpv FROM fx_truth")
def a01(spark, sf):
    return rounded(frames.district_truth(base.units(spark, sf)))


view("fx_districts", f"""
SELECT *, per_minority > 0.5 AS maj_min_district, dem_voteshare >= 0.5 AS dem_district FROM (
  SELECT map_id, seg_level, redist_level, district_id, n_precincts, total_population AS population,
    total_minority AS n_minority_voters, total_majority AS n_majority_voters, total_dem_votes AS dem_votes,
    total_rep_votes AS rep_votes, true_minority_dem_votes AS dem_votes_minority,
    true_majority_dem_votes AS dem_votes_majority, {div('total_minority', 'total_population')} AS per_minority,
    true_overall_dem_share AS dem_voteshare, coalesce(true_minority_dem_share, 0) AS dem_voteshare_minority,
    coalesce(true_majority_dem_share, 0) AS dem_voteshare_majority
  FROM fx_truth) t
""")
view("fx_mapsum", """
SELECT map_id, seg_level, redist_level, count(*) AS n_districts,
  CAST(sum(CASE WHEN dem_district THEN 1 ELSE 0 END) AS BIGINT) AS n_dem_districts,
  CAST(sum(CASE WHEN dem_district THEN 0 ELSE 1 END) AS BIGINT) AS n_rep_districts,
  CAST(sum(CASE WHEN maj_min_district THEN 1 ELSE 0 END) AS BIGINT) AS n_maj_min_districts,
  avg(dem_voteshare) AS avg_dem_voteshare, min(dem_voteshare) AS min_dem_voteshare, max(dem_voteshare) AS max_dem_voteshare
FROM fx_districts GROUP BY map_id, seg_level, redist_level
""")
SUMMARY = ("map_id, district_id, n_precincts, population, n_minority_voters, n_majority_voters, dem_votes, rep_votes, "
           "dem_votes_minority, dem_votes_majority, maj_min_district, dem_district")
SUMMARY_SHARES = ["per_minority", "dem_voteshare", "dem_voteshare_minority", "dem_voteshare_majority"]
MAPS = "map_id, n_districts, n_dem_districts, n_rep_districts, n_maj_min_districts"
MAP_SHARES = ["avg_dem_voteshare", "min_dem_voteshare", "max_dem_voteshare"]


@query("a02_district_summary", f"SELECT {SUMMARY}, {rs(*SUMMARY_SHARES)} FROM fx_districts")
def a02(spark, sf):
    return rounded(frames.district_summary(base.units(spark, sf)))


@query("a03_district_summary_from_shares", f"""
SELECT map_id, district_id, n_precincts, population, {rs('n_minority_voters', 'n_majority_voters', 'dem_votes',
    'dem_votes_minority', 'dem_votes_majority', *SUMMARY_SHARES, digits=5)},
  per_minority > 0.5 AS maj_min_district, dem_voteshare >= 0.5 AS dem_district
FROM (SELECT *, n_minority_voters / population AS per_minority, dem_votes / population AS dem_voteshare,
    coalesce(dem_votes_minority / nullif(n_minority_voters, 0), 0) AS dem_voteshare_minority,
    coalesce(dem_votes_majority / nullif(n_majority_voters, 0), 0) AS dem_voteshare_majority
  FROM (SELECT map_id, district_id, count(*) AS n_precincts, CAST(sum(population) AS BIGINT) AS population,
      sum(per_minority * population) AS n_minority_voters, sum(population - per_minority * population) AS n_majority_voters,
      sum(dem_voteshare * population) AS dem_votes, sum(dem_voteshare_minority * (per_minority * population)) AS dem_votes_minority,
      sum(dem_voteshare_majority * (population - per_minority * population)) AS dem_votes_majority
    FROM fx_units GROUP BY map_id, district_id) a) b
""")
def a03(spark, sf):
    return rounded(frames.district_summary_from_shares(base.units(spark, sf)), 5)


def summaries(spark, sf):
    return frames.summarise_plans(fx.assignments(spark, sf), fx.precincts(spark, sf))


def district_table(spark, sf):
    """District summaries, stored as a study stores them."""
    return fx.stored(spark, sf, "district_summaries", lambda: summaries(spark, sf)[0])


def map_table(spark, sf):
    return fx.stored(spark, sf, "map_summaries", lambda: summaries(spark, sf)[1])


@query("a04_map_summary", f"SELECT {MAPS}, {rs(*MAP_SHARES)} FROM fx_mapsum")
def a04(spark, sf):
    return rounded(frames.map_summary(frames.district_summary(base.units(spark, sf))))


@query("a05_plan_scores", """
SELECT map_id AS plan_id, seg_level, redist_level, n_dem_districts AS dem_seats, n_rep_districts AS rep_seats FROM fx_mapsum
""")
def a05(spark, sf):
    return frames.plan_scores(map_table(spark, sf))


@query("a06_all_plan_summaries", f"SELECT seg_level, redist_level, {MAPS}, {rs(*MAP_SHARES)} FROM fx_mapsum")
def a06(spark, sf):
    return rounded(summaries(spark, sf)[1])


@query("a18_plan_seat_columns", f"SELECT {DK}, n_dem_seats, n_rep_seats, n_maj_min FROM fx_seats")
def a18(spark, sf):
    return res.with_seats(base.results(spark, sf)).select(*DISTRICT, "n_dem_seats", "n_rep_seats", "n_maj_min")


@query("a19_distinct_district_counts", """
SELECT map_id, seg_level, redist_level, count(DISTINCT CASE WHEN prop_dem > 0.5 THEN district_id END) AS n_dem_seats,
  count(DISTINCT CASE WHEN prop_dem <= 0.5 THEN district_id END) AS n_rep_seats,
  count(DISTINCT CASE WHEN prop_minority > 0.5 THEN district_id END) AS n_maj_min
FROM fx_rows GROUP BY map_id, seg_level, redist_level
""")
def a19(spark, sf):
    return res.plan_seat_counts(base.precinct_rows(spark, sf))


@query("d01_rpv_flag", f"SELECT {DK}, true_rpv, er_rpv, ei_rpv FROM fx_results")
def d01(spark, sf):
    return base.results(spark, sf).select(*DISTRICT, *[
        rpv.rpv_flag(f"{m}_minority_dem_share", f"{m}_majority_dem_share").alias(f"{m}_rpv") for m in ("true", "er", "ei")
    ])


@query("d02_rpv_type", f"""
SELECT {DK}, CASE WHEN true_minority_dem_share > 0.5 AND true_majority_dem_share < 0.5 THEN 'Type 1'
  WHEN true_minority_dem_share < 0.5 AND true_majority_dem_share > 0.5 THEN 'Type 2' ELSE 'None' END AS rpv_type
FROM fx_results
""")
def d02(spark, sf):
    return base.results(spark, sf).select(
        *DISTRICT, rpv.rpv_type("true_minority_dem_share", "true_majority_dem_share").alias("rpv_type"))


@query("d03_rpv_correct_strict", f"SELECT {DK}, er_rpv_correct, ei_rpv_correct FROM fx_results_all")
def d03(spark, sf):
    return base.results_all(spark, sf).drop("er_rpv_correct", "ei_rpv_correct").withColumns(
        rpv.correctness_columns()).select(*DISTRICT, "er_rpv_correct", "ei_rpv_correct")


@query("d04_rpv_agreement", """
SELECT unique_id, true_rpv_precinct, er_rpv_precinct, ei_rpv_precinct, er_rpv_correct_precinct, ei_rpv_correct_precinct
FROM fx_rows
""")
def d04(spark, sf):
    rows = res.precinct_metrics(frames.attach_districts(
        base.units(spark, sf), base.unlabelled(spark, sf), res.CARRIED))
    return rows.select("unique_id", "true_rpv_precinct", "er_rpv_precinct", "ei_rpv_precinct",
                       "er_rpv_correct_precinct", "ei_rpv_correct_precinct")


PACKED = [
    *[f"{g}_{p}_packed" for g in waste.GROUPS for p in waste.PARTIES], "packed_min_votes", "packed_maj_votes",
    "minority_wasted_total", "majority_wasted_total", "minority_waste_rate", "majority_waste_rate",
    "waste_disparity", "packed_votes", "total_wasted", "prop_dem",
]
CRACKED = [*[f"{g}_{p}_cracked" for g in waste.GROUPS for p in waste.PARTIES], "cracked_min_votes", "cracked_maj_votes",
           "cracked_votes", "votes_to_win"]


@query("d05_packed_cracked", f"SELECT {DK}, dem_district, {', '.join(CRACKED)}, {rs(*PACKED)} FROM fx_packed")
def d05(spark, sf):
    out = waste.packed_cracked(frames.district_truth(base.units(spark, sf)))
    return rounded(out.select(*DISTRICT, "dem_district", *CRACKED, *PACKED))


SURPLUS = [*[f"{g}_{p}_wasted_{k}" for g in waste.GROUPS for p in waste.PARTIES for k in ("surplus", "losing")],
           *[f"{p}_wasted_{k}" for p in waste.PARTIES for k in ("surplus", "losing")]]


@query("d06b_surplus_losing_districts", f"SELECT {DK}, {rs(*SURPLUS)} FROM fx_surplus")
def d06b(spark, sf):
    return rounded(waste.surplus_losing_districts(frames.district_truth(base.units(spark, sf))).select(*DISTRICT, *SURPLUS))


def _precinct_share(g: str, p: str, k: str) -> str:
    own = f"dem_votes_{g}" if p == "dem" else f"(n_{g} - dem_votes_{g})"
    won = "dem_votes > rep_votes" if p == "dem" else "NOT (dem_votes > rep_votes)"
    side = won if k == "surplus" else f"NOT ({won})"
    total = f"{p}_votes"
    lost = f"greatest({total} - need, 0)" if k == "surplus" else total
    return f"CASE WHEN {side} AND {total} > 0 THEN {div(f'{own} * {lost}', total)} ELSE 0e0 END"


PW = {f"{g}_{p}_wasted_{k}_precinct": _precinct_share(g, p, k)
      for g in waste.GROUPS for p in waste.PARTIES for k in ("surplus", "losing")}


@query("d06_precinct_wasted_votes", f"""
SELECT map_id, precinct_id, precinct_dem_win, precinct_votes_to_win, precinct_dem_wasted, precinct_rep_wasted,
  precinct_dem_wasted + precinct_rep_wasted AS precinct_total_wasted, {rs(*PW)},
  {R('minority_dem_wasted_surplus_precinct + minority_dem_wasted_losing_precinct + minority_rep_wasted_surplus_precinct + minority_rep_wasted_losing_precinct', 'minority_wasted_total_precinct')},
  {R('majority_dem_wasted_surplus_precinct + majority_dem_wasted_losing_precinct + majority_rep_wasted_surplus_precinct + majority_rep_wasted_losing_precinct', 'majority_wasted_total_precinct')}
FROM (SELECT *, dem_votes > rep_votes AS precinct_dem_win, need AS precinct_votes_to_win,
    CASE WHEN dem_votes > rep_votes THEN greatest(dem_votes - need, 0) ELSE dem_votes END AS precinct_dem_wasted,
    CASE WHEN dem_votes > rep_votes THEN rep_votes ELSE greatest(rep_votes - need, 0) END AS precinct_rep_wasted,
    {', '.join(f'{e} AS {n}' for n, e in PW.items())}
  FROM (SELECT *, CAST(floor(CAST(dem_votes + rep_votes AS DOUBLE) / 2) + 1 AS BIGINT) AS need FROM fx_units) u) v
""")
def d06(spark, sf):
    out = frames.precinct_stats(fx.assignments(spark, sf), waste.surplus_losing_precincts(fx.precincts(spark, sf)))
    return rounded(out.select(
        "map_id", "precinct_id", "precinct_dem_win", "precinct_votes_to_win", "precinct_dem_wasted",
        "precinct_rep_wasted", "precinct_total_wasted", *PW, "minority_wasted_total_precinct",
        "majority_wasted_total_precinct"))


METRICS = ["true_minority_dem_share_precinct", "true_majority_dem_share_precinct", "true_overall_dem_share_precinct",
           *[f"{m}_{g}_error_precinct" for m in ("er", "ei") for g in waste.GROUPS],
           *[f"{m}_pred_{g}_share_precinct" for m in ("er", "ei") for g in waste.GROUPS],
           "prop_minority_precinct", "prop_dem_precinct", "prop_minority", "prop_dem"]


@query("d07_precinct_metrics", f"""
SELECT unique_id, map_id, seg_level, redist_level, district_id, precinct_id, true_rpv_precinct, {rs(*METRICS)} FROM fx_rows
""")
def d07(spark, sf):
    rows = res.plan_precinct_results(fx.assignments(spark, sf), fx.precincts(spark, sf), base.unlabelled(spark, sf))
    return rounded(rows.select("unique_id", *DISTRICT, "precinct_id", "true_rpv_precinct", *METRICS))


@query("d12_spread_and_sign_flips", f"""
SELECT {DK}, 'er' AS model, CASE WHEN sign(t) <> sign(e) THEN 1 WHEN sign(t) = sign(e) THEN 0 END AS sign_flip,
  {R('t', 'true_spread')}, {R('e', 'spread')}
FROM (SELECT *, true_minority_dem_share - true_majority_dem_share AS t, er_minority_dem_share - er_majority_dem_share AS e FROM fx_results) a
UNION ALL
SELECT {DK}, 'ei' AS model, CASE WHEN sign(t) <> sign(e) THEN 1 WHEN sign(t) = sign(e) THEN 0 END AS sign_flip,
  {R('t', 'true_spread')}, {R('e', 'spread')}
FROM (SELECT *, true_minority_dem_share - true_majority_dem_share AS t, ei_minority_dem_share - ei_majority_dem_share AS e FROM fx_results) a
""")
def d12(spark, sf):
    out = rpv.spread(base.results(spark, sf))
    return out.select(*DISTRICT, r("true_spread").alias("true_spread"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"{m}_sign_flip").alias("sign_flip"), r(f"{m}_spread").alias("spread"))
        for m in rpv.MODELS])))


@query("d13_margins", f"""
SELECT {DK}, {R('m', 'dem_win_margin')}, abs(m) < 0.05 AS is_competitive, m > 0.05 AS is_safe_dem, m < -0.05 AS is_safe_rep,
  m * 100 > 10 AS is_safe_dem_10, m * 100 < -10 AS is_safe_rep_10
FROM (SELECT *, {div('total_dem_votes - total_rep_votes', 'total_population')} AS m FROM fx_results) t
""")
def d13(spark, sf):
    out = base.results(spark, sf).withColumns(waste.margin_columns())
    return rounded(out.select(*DISTRICT, "dem_win_margin", "is_competitive", "is_safe_dem", "is_safe_rep",
                              "is_safe_dem_10", "is_safe_rep_10"))


@query("d17_context_gap", f"""
SELECT {DK}, {R('(CAST(total_majority AS DOUBLE) / total_population - s) * 100', 'white_pop_diff')}
FROM fx_results, (SELECT sum(n_majority) / CAST(sum(population) AS DOUBLE) AS s FROM fx_precincts) t
""")
def d17(spark, sf):
    from wardwise.operators.report import context_gap

    return rounded(context_gap(base.results(spark, sf), fx.precincts(spark, sf)).select(*DISTRICT, "white_pop_diff"))


@query("d18_contextual_mismatch", f"SELECT unique_id, {R('abs(prop_minority_precinct - prop_minority)', 'contextual_mismatch')} FROM fx_rows")
def d18(spark, sf):
    rows = base.precinct_rows(spark, sf)
    return rows.select("unique_id", r(F.abs(F.col("prop_minority_precinct") - F.col("prop_minority"))).alias("contextual_mismatch"))


_R = [c for c in res.RESULT_COLUMNS if c not in ("unique_id", *DISTRICT)]
_INT = {"n_precincts", "total_population", "true_rpv", "er_rpv", "ei_rpv", "er_rpv_correct", "ei_rpv_correct",
        "total_minority", "total_majority", "total_dem_votes", "total_rep_votes", "true_minority_dem_votes",
        "true_majority_dem_votes", "dem_district", "cracked_votes", "cracked_min_votes"}


@query("d19_district_results", f"""
SELECT unique_id, {DK}, {', '.join(c for c in _R if c in _INT)}, {rs(*[c for c in _R if c not in _INT])} FROM fx_results
""")
def d19(spark, sf):
    every = res.district_results(fx.drawn_units(spark, sf), labels=fx.labels(spark, sf))
    return rounded(res.one_scenario_per_plan(every))


@query("d20_vote_models_on_fixed_plans", f"""
SELECT vote_model, map_id, seg_level, redist_level, count(*) AS n_districts,
  CAST(sum(CASE WHEN d >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_dem_districts,
  CAST(sum(CASE WHEN d >= 0.5 THEN 0 ELSE 1 END) AS BIGINT) AS n_rep_districts,
  CAST(sum(CASE WHEN m > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_maj_min_districts,
  {R('avg(d)', 'avg_dem_voteshare')}, {R('min(d)', 'min_dem_voteshare')}, {R('max(d)', 'max_dem_voteshare')}
FROM (SELECT vote_model, map_id, seg_level, redist_level, district_id, {div('sum(v)', 'sum(population)')} AS d,
    {div('sum(n_minority)', 'sum(population)')} AS m
  FROM (SELECT 'cast' AS vote_model, *, dem_votes AS v FROM fx_units UNION ALL SELECT 'swapped' AS vote_model, *, rep_votes AS v FROM fx_units) u
  GROUP BY vote_model, map_id, seg_level, redist_level, district_id) t
GROUP BY vote_model, map_id, seg_level, redist_level
""")
def d20(spark, sf):
    cast = fx.precincts(spark, sf)
    swap = {"dem_votes": "rep_votes", "rep_votes": "dem_votes", "dem_votes_minority": "rep_votes_minority",
            "rep_votes_minority": "dem_votes_minority", "dem_votes_majority": "rep_votes_majority",
            "rep_votes_majority": "dem_votes_majority"}
    swapped = cast.withColumns({c: F.col(o) for c, o in swap.items()})
    votes = cast.withColumn("vote_model", F.lit("cast")).unionByName(swapped.withColumn("vote_model", F.lit("swapped")))
    return rounded(frames.evaluate_vote_models(fx.assignments(spark, sf), votes))


@query("wasted_votes_audit", f"""
SELECT count(*) AS n_rows, CAST(sum(CASE WHEN true_minority_dem_votes IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
  {R('avg(total_wasted / total_population)', 'mean_wasted_share')}
FROM fx_results_all
""")
def audit(spark, sf):
    out = res.wasted_check(base.results_all(spark, sf))
    return rounded(out.select("n_rows", "n_missing", "mean_wasted_share"))


@query("a38_voters_to_precincts", f"""
SELECT precinct_id, population, n_minority, n_majority, dem_votes, rep_votes, dem_votes_minority, rep_votes_minority,
  dem_votes_majority, rep_votes_majority, {rs('per_minority', 'dem_voteshare')},
  {R('coalesce(dem_voteshare_minority, 0)', 'dem_voteshare_minority')}, {R('coalesce(dem_voteshare_majority, 0)', 'dem_voteshare_majority')}
FROM fx_precincts
""")
def a38(spark, sf):
    out = frames.voters_to_precincts(fx.voters(spark, sf))
    return rounded(out.fillna(0.0, ["dem_voteshare_minority", "dem_voteshare_majority"]))


@query("a42_totals_across_levels", """
SELECT seg_level, map_id, CAST(sum(population) AS BIGINT) AS population, CAST(sum(n_minority) AS BIGINT) AS n_minority,
  CAST(sum(dem_votes) AS BIGINT) AS dem_votes, true AS consistent
FROM fx_units GROUP BY seg_level, map_id
""")
def a42(spark, sf):
    from wardwise.operators.report import totals_across

    return totals_across(base.units(spark, sf), ["seg_level", "map_id"], ["population", "n_minority", "dem_votes"])


