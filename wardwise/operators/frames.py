"""Joins of plans with precincts, and the district and plan tables built on them.

The product of plans and precincts is the one large table. It is joined once and
reduced by one ``groupBy`` on the district key; everything that a district can be
asked for is computed from the sums of that pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwise.functions import indicator, try_div
from wardwise.schemas import COUNTS, DISTRICT, PLAN, SCENARIO, require_columns


def voters_to_precincts(voters: DataFrame) -> DataFrame:
    """Counts by group and vote, with shares, per precinct."""
    race, vote = F.col("race"), F.col("vote")
    sums = voters.groupBy("precinct_id").agg(
        F.count(F.lit(1)).alias("population"),
        F.sum(race).alias("n_minority"),
        F.sum(1 - race).alias("n_majority"),
        F.sum(vote).alias("dem_votes"),
        F.sum(1 - vote).alias("rep_votes"),
        F.sum(race * vote).alias("dem_votes_minority"),
        F.sum(race * (1 - vote)).alias("rep_votes_minority"),
        F.sum((1 - race) * vote).alias("dem_votes_majority"),
        F.sum((1 - race) * (1 - vote)).alias("rep_votes_majority"),
    )
    return sums.withColumns({
        "per_minority": try_div("n_minority", "population"),
        "dem_voteshare": try_div("dem_votes", "population"),
        "dem_voteshare_minority": try_div("dem_votes_minority", "n_minority"),
        "dem_voteshare_majority": try_div("dem_votes_majority", "n_majority"),
    })


def precinct_stats(assignments: DataFrame, precincts: DataFrame) -> DataFrame:
    """Every plan's precincts with their counts: one row per plan and precinct.

    No hint: the planner broadcasts the precinct table when its stored size is
    under the session's limit and hash-joins on the precinct otherwise, where each
    precinct occurs once per plan and the key is therefore even.
    """
    require_columns(assignments, ["map_id", "precinct_id", "district_id"])
    require_columns(precincts, ["precinct_id", "population"])
    return assignments.join(precincts, "precinct_id")


def one_plan(assignments: DataFrame, map_id: int) -> DataFrame:
    """Assignments of one plan; an error when the plan is unknown."""
    chosen = assignments.where(F.col("map_id") == map_id)
    if chosen.isEmpty():
        raise ValueError(f"plan {map_id} not found")
    return chosen.select("precinct_id", "district_id")


def keep_plans(assignments: DataFrame, plans: DataFrame, on: Sequence[str] = ("map_id",)) -> DataFrame:
    """Assignments of the plans that occur in another table."""
    return assignments.join(plans.select(*on), list(on), "left_semi")


def unmatched(assignments: DataFrame, precincts: DataFrame) -> DataFrame:
    """Plan rows whose precinct is unknown or listed twice, and plans that lack precincts."""
    unknown = assignments.join(precincts, "precinct_id", "left_anti").select("map_id", "precinct_id")
    counts = assignments.join(precincts, "precinct_id", "left_semi").groupBy("map_id").agg(
        F.countDistinct("precinct_id").alias("n_known")
    )
    n = precincts.agg(F.count(F.lit(1)).alias("n")).scalar()
    short = counts.where(F.col("n_known") < n).select("map_id", F.lit(None).cast("bigint").alias("precinct_id"))
    twice = assignments.groupBy("map_id", "precinct_id").count().where("count > 1").select("map_id", "precinct_id")
    return unknown.unionByName(short).unionByName(twice)


def align(assignments: DataFrame, precincts: DataFrame) -> DataFrame:
    """The J01 join, after checking that every unit of every plan is matched."""
    if not unmatched(assignments, precincts).isEmpty():
        raise ValueError("plans and precincts do not cover the same units")
    return precinct_stats(assignments, precincts)


def regression_moments() -> dict[str, Column]:
    """Weighted cross-products of the two-group regression without intercept.

    The vote share is shifted by one half of the fitted total, which keeps the
    residual sum of squares from cancelling; the slopes shift back by one half.
    """
    w = F.col("population").cast("double")
    x1, x2 = F.try_divide(F.col("n_minority").cast("double"), w), F.try_divide(F.col("n_majority").cast("double"), w)
    y = F.try_divide(F.col("dem_votes").cast("double"), w) - F.lit(0.5) * (x1 + x2)
    return {
        "_n": F.count(F.when(w > 0, 1)),
        "_a11": F.sum(w * x1 * x1), "_a12": F.sum(w * x1 * x2), "_a22": F.sum(w * x2 * x2),
        "_b1": F.sum(w * x1 * y), "_b2": F.sum(w * x2 * y), "_yy": F.sum(w * y * y),
    }


def district_totals(moments: bool = False) -> list[Column]:
    """The sums of ``district_sums``, for a pass over the plan rows that takes others too."""
    totals = {
        "total_population": "population", "total_minority": "n_minority", "total_majority": "n_majority",
        "total_dem_votes": "dem_votes", "total_rep_votes": "rep_votes",
        "true_minority_dem_votes": "dem_votes_minority", "true_majority_dem_votes": "dem_votes_majority",
    }
    aggs = [F.sum(c).alias(o) for o, c in totals.items()] + [F.count(F.lit(1)).alias("n_precincts")]
    if moments:
        aggs += [e.alias(o) for o, e in regression_moments().items()]
    return aggs


def district_sums(units: DataFrame, keys: Sequence[str] = DISTRICT, moments: bool = False) -> DataFrame:
    """All district totals in one pass; with ``moments`` also those of the regression."""
    return units.groupBy(*keys).agg(*district_totals(moments))


def truth_columns() -> dict[str, Column]:
    from wardwise.operators.rpv import rpv_flag

    minority = try_div("true_minority_dem_votes", "total_minority")
    majority = try_div("true_majority_dem_votes", "total_majority")
    return {
        "true_minority_dem_share": minority,
        "true_majority_dem_share": majority,
        "true_overall_dem_share": try_div("total_dem_votes", "total_population"),
        "true_rpv": rpv_flag(minority, majority),
    }


def district_truth(units: DataFrame, keys: Sequence[str] = DISTRICT) -> DataFrame:
    """Totals, true group shares and the true polarization flag per district."""
    return district_sums(units, keys).withColumns(truth_columns())


def district_summary(units: DataFrame, keys: Sequence[str] = ("map_id", "district_id")) -> DataFrame:
    """District counts with majority-minority and seat flags (a tie is a seat)."""
    sums = units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_precincts"),
        F.sum("population").alias("population"),
        F.sum("n_minority").alias("n_minority_voters"),
        F.sum("n_majority").alias("n_majority_voters"),
        *[F.sum(c).alias(c) for c in ("dem_votes", "rep_votes", "dem_votes_minority", "dem_votes_majority")],
    )
    return _summary_columns(sums)


def _summary_columns(sums: DataFrame) -> DataFrame:
    return sums.withColumns({
        "per_minority": try_div("n_minority_voters", "population"),
        "dem_voteshare": try_div("dem_votes", "population"),
        "dem_voteshare_minority": F.coalesce(try_div("dem_votes_minority", "n_minority_voters"), F.lit(0.0)),
        "dem_voteshare_majority": F.coalesce(try_div("dem_votes_majority", "n_majority_voters"), F.lit(0.0)),
    }).withColumns({
        "maj_min_district": F.col("per_minority") > 0.5,
        "dem_district": F.col("dem_voteshare") >= 0.5,
    })


def district_summary_from_shares(units: DataFrame, keys: Sequence[str] = ("map_id", "district_id")) -> DataFrame:
    """The same table for inputs that carry shares instead of counts."""
    minority = F.col("per_minority") * F.col("population")
    majority = F.col("population") - minority
    sums = units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_precincts"),
        F.sum("population").alias("population"),
        F.sum(minority).alias("n_minority_voters"),
        F.sum(majority).alias("n_majority_voters"),
        F.sum(F.col("dem_voteshare") * F.col("population")).alias("dem_votes"),
        F.sum(F.col("dem_voteshare_minority") * minority).alias("dem_votes_minority"),
        F.sum(F.col("dem_voteshare_majority") * majority).alias("dem_votes_majority"),
    )
    return _summary_columns(sums)


def map_summary(districts: DataFrame, keys: Sequence[str] = ("map_id",)) -> DataFrame:
    """Seats by party, majority-minority districts and vote-share range per plan."""
    return districts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_districts"),
        F.sum(indicator(F.col("dem_district"))).alias("n_dem_districts"),
        F.sum(indicator(~F.col("dem_district"))).alias("n_rep_districts"),
        F.sum(indicator(F.col("maj_min_district"))).alias("n_maj_min_districts"),
        F.avg("dem_voteshare").alias("avg_dem_voteshare"),
        F.min("dem_voteshare").alias("min_dem_voteshare"),
        F.max("dem_voteshare").alias("max_dem_voteshare"),
    )


def plan_scores(maps: DataFrame) -> DataFrame:
    extra = [c for c in ("plan_name", "plan_type", *SCENARIO) if c in maps.columns]
    return maps.select(
        F.col("map_id").alias("plan_id"), *extra,
        F.col("n_dem_districts").alias("dem_seats"), F.col("n_rep_districts").alias("rep_seats"),
    )


def summarise_plans(
    assignments: DataFrame, precincts: DataFrame, keys: Sequence[str] = PLAN
) -> tuple[DataFrame, DataFrame]:
    """District and plan summaries of all plans at once."""
    districts = district_summary(precinct_stats(assignments, precincts), [*keys, "district_id"])
    return districts, map_summary(districts, keys)


def attach_districts(units: DataFrame, districts: DataFrame, columns: Sequence[str],
                     keys: Sequence[str] = DISTRICT) -> DataFrame:
    """District figures on every unit row (left join), with explicit suffixes."""
    clash = [c for c in columns if c in units.columns]
    left = units.withColumnsRenamed({c: f"{c}_precinct" for c in clash})
    right = districts.select(*keys, *columns).withColumnsRenamed({c: f"{c}_district" for c in clash})
    return left.join(right, list(keys), "left")


def unique_id(*columns: str) -> Column:
    return F.concat_ws("_", *[F.col(c).cast("string") for c in columns])


def evaluate_vote_models(assignments: DataFrame, votes: DataFrame) -> DataFrame:
    """Plan summaries of fixed plans under several vote tables.

    ``votes`` is a precinct table with a ``vote_model`` column.
    """
    require_columns(votes, ["vote_model", "precinct_id", *COUNTS])
    units = assignments.join(votes, "precinct_id")
    return map_summary(
        district_summary(units, ["vote_model", *PLAN, "district_id"]), ["vote_model", *PLAN]
    )


def rank_match(units: DataFrame, cells: DataFrame, unit_order, cell_order, keys: Sequence[str] = ()) -> DataFrame:
    """k-th unit of each group beside the k-th cell of the group, in the given orders."""
    from wardwise.operators.ordered import running

    left = running(units, unit_order, keys, row_number="rn")
    right = running(cells, cell_order, keys, row_number="rn")
    return left.join(right, [*keys, "rn"])
