"""Wasted votes by group and party, at district and precinct grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwise.functions import ifelse, indicator, pmax, try_div

GROUPS, PARTIES = ("minority", "majority"), ("dem", "rep")


def _group_votes(group: str, party: str) -> Column:
    dem = F.col(f"true_{group}_dem_votes")
    return dem if party == "dem" else F.col(f"total_{group}") - dem


def _won(party: str) -> Column:
    return F.col("dem_district") if party == "dem" else ~F.col("dem_district")


def packed_cracked(districts: DataFrame) -> DataFrame:
    """Packed (surplus of the winner) and cracked (all of the loser) votes.

    ``districts`` carries the totals of ``district_sums``. The surplus of the winning
    party is shared out to the groups in proportion to their votes for it.
    """
    total_share = try_div("total_dem_votes", F.col("total_dem_votes") + F.col("total_rep_votes"))
    out = districts.withColumn("prop_dem", total_share).withColumns({
        "dem_district": F.col("prop_dem") > 0.5,
        "votes_to_win": (F.floor(F.col("total_population") / 2) + 1).cast("bigint"),
    })
    parts: dict[str, Column] = {}
    for g in GROUPS:
        for p in PARTIES:
            own = _group_votes(g, p)
            surplus = pmax(F.lit(0.0), own - try_div(F.col("votes_to_win") * own, f"total_{p}_votes"))
            parts[f"{g}_{p}_packed"] = ifelse(_won(p), surplus, 0.0)
            parts[f"{g}_{p}_cracked"] = ifelse(~_won(p), own, F.lit(0).cast("bigint")).cast("bigint")
    out = out.withColumns(parts)
    out = out.withColumns({
        f"{kind}_{g[:3]}_votes": F.col(f"{g}_dem_{kind}") + F.col(f"{g}_rep_{kind}")
        for g in GROUPS for kind in ("packed", "cracked")
    })
    out = out.withColumns({
        **{f"{g}_wasted_total": F.col(f"packed_{g[:3]}_votes") + F.col(f"cracked_{g[:3]}_votes") for g in GROUPS},
        "packed_votes": F.col("packed_min_votes") + F.col("packed_maj_votes"),
        "cracked_votes": F.col("cracked_min_votes") + F.col("cracked_maj_votes"),
    })
    out = out.withColumns({
        **{f"{g}_waste_rate": try_div(f"{g}_wasted_total", f"total_{g}") for g in GROUPS},
        "total_wasted": F.col("packed_votes") + F.col("cracked_votes"),
    })
    return out.withColumn("waste_disparity", F.col("minority_waste_rate") - F.col("majority_waste_rate"))


def surplus_losing_districts(districts: DataFrame) -> DataFrame:
    """Surplus and losing votes by party, and by group and party, per district."""
    votes = F.col("total_dem_votes") + F.col("total_rep_votes")
    out = districts.withColumn("_share", try_div("total_dem_votes", votes)).withColumns({
        "_dem_win": F.col("_share") > 0.5, "_need": F.floor(votes / 2) + 1,
    })
    zero, parts = F.lit(0.0), {}
    for p in PARTIES:
        won = F.col("_dem_win") if p == "dem" else ~F.col("_dem_win")
        total = F.col(f"total_{p}_votes")
        parts[f"{p}_wasted_surplus"] = ifelse(won, pmax(zero, (total - F.col("_need")).cast("double")), zero)
        parts[f"{p}_wasted_losing"] = ifelse(~won, total.cast("double"), zero)
        for g in GROUPS:
            own = _group_votes(g, p)
            share = pmax(zero, try_div(own * (total - F.col("_need")), total))
            parts[f"{g}_{p}_wasted_surplus"] = ifelse(won & (total > 0), share, zero)
            parts[f"{g}_{p}_wasted_losing"] = ifelse(~won, own.cast("double"), zero)
    out = out.withColumns(parts).drop("_share", "_dem_win", "_need")
    out = out.withColumns({
        f"{g}_{p}_wasted": F.col(f"{g}_{p}_wasted_surplus") + F.col(f"{g}_{p}_wasted_losing")
        for g in GROUPS for p in PARTIES
    })
    return out.withColumns({
        f"{g}_wasted_{k}": F.col(f"{g}_dem_wasted_{k}") + F.col(f"{g}_rep_wasted_{k}")
        for g in GROUPS for k in ("surplus", "losing")
    })


def surplus_losing_precincts(units: DataFrame) -> DataFrame:
    """Surplus and losing votes of each precinct, shared out to the groups."""
    zero = F.lit(0.0)
    dem, rep = F.col("dem_votes"), F.col("rep_votes")
    out = units.withColumns({
        "precinct_dem_win": dem > rep,
        "precinct_votes_to_win": (F.floor((dem + rep) / 2) + 1).cast("bigint"),
    })
    total = {"dem": dem, "rep": rep}
    won = {"dem": F.col("precinct_dem_win"), "rep": ~F.col("precinct_dem_win")}
    need = F.col("precinct_votes_to_win")
    party = {}
    for p in PARTIES:
        none = F.lit(0).cast("bigint")
        party[f"precinct_{p}_wasted_surplus"] = ifelse(won[p] & (total[p] > need), total[p] - need, none)
        party[f"precinct_{p}_wasted_losing"] = ifelse(~won[p], total[p], none)
    out = out.withColumns(party)
    parts = {}
    for g in GROUPS:
        own = {"dem": F.col(f"dem_votes_{g}"), "rep": F.col(f"n_{g}") - F.col(f"dem_votes_{g}")}
        for p in PARTIES:
            for kind, side in (("surplus", won[p]), ("losing", ~won[p])):
                share = try_div(own[p] * F.col(f"precinct_{p}_wasted_{kind}"), total[p])
                parts[f"{g}_{p}_wasted_{kind}_precinct"] = ifelse(side & (total[p] > 0), share, zero)
    out = out.withColumns(parts)
    sums = {f"precinct_{p}_wasted": F.col(f"precinct_{p}_wasted_surplus") + F.col(f"precinct_{p}_wasted_losing")
            for p in PARTIES}
    sums |= {f"{g}_{p}_wasted_precinct": F.col(f"{g}_{p}_wasted_surplus_precinct")
             + F.col(f"{g}_{p}_wasted_losing_precinct") for g in GROUPS for p in PARTIES}
    sums |= {f"{g}_wasted_{k}_precinct": F.col(f"{g}_dem_wasted_{k}_precinct") + F.col(f"{g}_rep_wasted_{k}_precinct")
             for g in GROUPS for k in ("surplus", "losing")}
    sums |= {f"total_wasted_{k}_precinct": F.col(f"precinct_dem_wasted_{k}") + F.col(f"precinct_rep_wasted_{k}")
             for k in ("surplus", "losing")}
    out = out.withColumns(sums)
    return out.withColumns({
        "precinct_total_wasted": F.col("precinct_dem_wasted") + F.col("precinct_rep_wasted"),
        **{f"{g}_wasted_total_precinct": F.col(f"{g}_dem_wasted_precinct") + F.col(f"{g}_rep_wasted_precinct")
           for g in GROUPS},
    })


# ------------------------------------------------------- representation columns
def copartisan_columns(group: str) -> dict[str, Column]:
    """Members of a group whose representative is of the party they voted for."""
    won = indicator(F.col("dem_district"))
    dem = F.col(f"true_{group}_dem_votes") * won
    rep = (F.col(f"total_{group}") - F.col(f"true_{group}_dem_votes")) * (1 - won)
    return {
        f"{group}_dem_copartisan": dem,
        f"{group}_rep_copartisan": rep,
        f"{group}_copartisan": dem + rep,
        f"frac_{group}_copartisan": try_div(dem + rep, f"total_{group}"),
    }


def dem_margin() -> Column:
    return try_div(F.col("total_dem_votes") - F.col("total_rep_votes"), "total_population")


# Lower limit and label of each margin class, from the top down.
MARGIN_CATEGORIES = [
    (0.1, "Safe Dem (>10%)"),
    (0.05, "Likely Dem (5-10%)"),
    (0.0, "Lean Dem (0-5%)"),
    (-0.05, "Lean Rep (0-5%)"),
    (-0.1, "Likely Rep (5-10%)"),
    (None, "Safe Rep (>10%)"),
]
DISTRICT_TYPES = [
    (10, "Safe Dem (>10%)"),
    (5, "Likely Dem (5-10%)"),
    (-5, "Competitive (±5%)"),
    (-10, "Likely Rep (5-10%)"),
    (None, "Safe Rep (>10%)"),
]


def _first_above(value, classes) -> Column:
    """Label of the first limit that the value exceeds; the last label otherwise."""
    x = F.col(value) if isinstance(value, str) else value
    arms = [F.when(x > F.lit(limit), label) for limit, label in classes[:-1]]
    return F.coalesce(*arms, F.lit(classes[-1][1]))


def margin_category(margin) -> Column:
    """Six margin classes at 0, 5 and 10 points. An unknown margin is in the last."""
    return _first_above(margin, MARGIN_CATEGORIES)


def district_type(points) -> Column:
    """Five margin classes of a margin in points."""
    return _first_above(points, DISTRICT_TYPES)


def margin_columns() -> dict[str, Column]:
    m = dem_margin()
    return {
        "dem_win_margin": m, "is_competitive": F.abs(m) < 0.05,
        "is_safe_dem": m > 0.05, "is_safe_rep": m < -0.05,
        "margin_category": margin_category(m), "district_type": district_type(m * 100),
        "is_safe_dem_10": m * 100 > 10, "is_safe_rep_10": m * 100 < -10,
    }


def net_waste_columns() -> dict[str, Column]:
    """Republican minus Democratic waste in percent of the group; rate ratio and its log."""
    net = {
        f"{g}_net_percent": try_div(F.col(f"{g}_rep_wasted") - F.col(f"{g}_dem_wasted"), f"total_{g}") * 100
        for g in GROUPS
    }
    ratio = F.try_divide(
        try_div("minority_wasted_total", "total_minority"), try_div("majority_wasted_total", "total_majority")
    )
    return net | {"waste_ratio": ratio, "log_waste_ratio": F.when(ratio > 0, F.log2(ratio))}
