"""Partisan and spatial metrics of every plan of an ensemble.

Functions that take ``d`` read a district summary: plan keys, ``district_id``,
``dem_votes``, ``rep_votes`` and ``population``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwise.functions import indicator, soft_step, try_div
from wardwise.operators.ordered import running
from wardwise.schemas import PLAN
from wardwise.session import materialise


def _share(votes: str = "counts") -> Column:
    """District Democratic share, of the two-party votes or as stored."""
    dem, rep = F.col("dem_votes"), F.col("rep_votes")
    return try_div(dem, dem + rep) if votes == "counts" else F.col("dem_voteshare")


def _seats() -> dict[str, Column]:
    dem, rep = F.col("dem_votes"), F.col("rep_votes")
    return {"dem_seats": F.sum(indicator(dem > rep)), "rep_seats": F.sum(indicator(rep > dem))}


def _gap() -> Column:
    """Republican minus Democratic wasted votes over all votes; surplus counts from half."""
    dem, rep = F.col("dem_votes"), F.col("rep_votes")
    half = (dem + rep) / 2
    dem_wasted = F.when(dem > rep, dem - half).otherwise(dem)
    rep_wasted = F.when(dem > rep, rep).otherwise(rep - half)
    return try_div(F.sum(rep_wasted) - F.sum(dem_wasted), F.sum(dem + rep))


def seats(d: DataFrame, keys: Sequence[str] = PLAN) -> DataFrame:
    return d.groupBy(*keys).agg(*[e.alias(n) for n, e in _seats().items()])


def efficiency_gap(d: DataFrame, keys: Sequence[str] = PLAN) -> DataFrame:
    return d.groupBy(*keys).agg(_gap().alias("efficiency_gap"))


def mean_median(d: DataFrame, keys: Sequence[str] = PLAN, votes: str = "counts") -> DataFrame:
    """Median minus mean of the district shares."""
    s = _share(votes)
    return d.groupBy(*keys).agg((F.percentile(s, F.lit(0.5)) - F.avg(s)).alias("mean_median"))


def _with_mean(d: DataFrame, keys: Sequence[str], votes: str) -> DataFrame:
    """District shares beside their plan's mean share.

    The districts are needed twice, so their few columns are written first: the plan
    rows behind them are then read once.
    """
    if "_mean" in d.columns:
        return d
    shares = materialise(d.select(*keys, "district_id", "dem_votes", "rep_votes", _share(votes).alias("_s")), "shares")
    return shares.join(shares.groupBy(*keys).agg(F.avg("_s").alias("_mean")), list(keys))


def partisan_bias(d: DataFrame, keys: Sequence[str] = PLAN, votes: str = "counts") -> DataFrame:
    """Share of districts above the mean district share, minus one half."""
    return _with_mean(d, keys, votes).groupBy(*keys).agg(
        (F.avg(indicator(F.col("_s") > F.col("_mean"))) - 0.5).alias("partisan_bias"))


def partisan_gini(d: DataFrame, keys: Sequence[str] = PLAN, votes: str = "counts") -> DataFrame:
    """Area between the seats-votes curve under uniform swing and its reflection.

    With shares in order, the k-th is paired with the k-th from the end.
    """
    ranked = running(_with_mean(d, keys, votes), ["_s", "district_id"], keys, row_number="_rn", count="_n")
    here = ranked.select(*keys, "_rn", "_s", "_mean")
    there = ranked.select(*keys, (F.col("_n") + 1 - F.col("_rn")).alias("_rn"), F.col("_s").alias("_s2"))
    return here.join(there, [*keys, "_rn"]).groupBy(*keys).agg(
        F.avg(F.abs(2 * F.col("_mean") - F.col("_s") - F.col("_s2"))).alias("partisan_gini"))


def _soft(party: str, k: float, share: Column) -> Column:
    s = share if party == "democratic" else 1 - share
    return F.sum(soft_step(s, k)) + F.lit(0.01) * (F.avg(s) - 0.5)


def soft_seats(d: DataFrame, party: str = "democratic", k: float = 60.0, keys: Sequence[str] = PLAN,
               votes: str = "counts") -> DataFrame:
    """Smooth seat count: a logistic step per district plus a small pull of the mean."""
    return d.groupBy(*keys).agg(_soft(party, k, _share(votes)).alias("soft_seats"))


def pair_districts(assignments: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every plan's edges with the districts of both ends.

    The edge list meets the plan rows first (it is small next to them, and is
    broadcast when its stored size allows); only then are plan and precinct the key
    of the one large join.
    """
    plan_rows = assignments.select(*keys, "precinct_id", "district_id")
    ends = edges.select(F.col("src").alias("precinct_id"), F.col("dst"))
    first = plan_rows.join(ends, "precinct_id").select(
        *keys, F.col("precinct_id").alias("src"), F.col("dst"), F.col("district_id").alias("src_district"))
    second = plan_rows.withColumnsRenamed({"precinct_id": "dst", "district_id": "dst_district"})
    return first.join(second, [*keys, "dst"])


def cut_edges(assignments: DataFrame, edges: DataFrame, keys: Sequence[str] = PLAN) -> DataFrame:
    """Edges whose ends are in different districts, per plan."""
    pairs = pair_districts(assignments, edges, keys)
    return pairs.groupBy(*keys).agg(
        F.sum(indicator(F.col("src_district") != F.col("dst_district"))).alias("cut_edges"))


OBJECTIVES: dict[str, Callable[[], Column]] = {
    "efficiency_gap": lambda: F.abs("efficiency_gap"),
    "mean_median": lambda: F.abs("mean_median"),
    "partisan_bias": lambda: F.abs("partisan_bias"),
    "partisan_gini": lambda: F.col("partisan_gini"),
    "republican_seats": lambda: F.col("rep_seats").cast("double"),
    "democratic_seats": lambda: F.col("dem_seats").cast("double"),
    "soft_seats": lambda: F.col("soft_seats"),
}


def plan_metrics(
    d: DataFrame, edges: DataFrame | None = None, assignments: DataFrame | None = None,
    objective: str = "efficiency_gap", keys: Sequence[str] = PLAN, votes: str = "counts", soft_k: float = 60.0,
) -> DataFrame:
    """All metrics of each plan in one row, with the chosen objective as its score."""
    s, shares = F.col("_s"), _with_mean(d, keys, votes)
    base = shares.groupBy(*keys).agg(
        *[e.alias(n) for n, e in _seats().items()], _gap().alias("efficiency_gap"),
        (F.percentile(s, F.lit(0.5)) - F.avg(s)).alias("mean_median"),
        (F.avg(indicator(s > F.col("_mean"))) - 0.5).alias("partisan_bias"),
        _soft("democratic", soft_k, s).alias("soft_seats"),
    ).join(partisan_gini(shares, keys), list(keys))
    if edges is not None and assignments is not None:
        base = base.join(cut_edges(assignments, edges, keys), list(keys), "left")
    return base.withColumn("optimization_score", OBJECTIVES.get(objective, OBJECTIVES["efficiency_gap"])())


# --------------------------------------------------------------- plan checks
def ideal_population(precincts: DataFrame, num_districts: int | None = None, target_pop: float | None = None) -> DataFrame:
    """Total population, number of districts and ideal district size, in one row."""
    if num_districts is None and target_pop is None:
        raise ValueError("give num_districts or target_pop")
    total = precincts.agg(F.sum("population").alias("total_population"))
    count = F.lit(num_districts) if num_districts is not None else F.bround(F.col("total_population") / F.lit(target_pop))
    return total.withColumn("num_districts", count.cast("bigint")).withColumn(
        "ideal_population", try_div("total_population", "num_districts"))


def population_deviation(d: DataFrame, keys: Sequence[str] = PLAN) -> DataFrame:
    """Deviation of each district from its plan's mean size."""
    sizes = materialise(d.select(*keys, "district_id", "population"), "sizes")
    ideal = sizes.groupBy(*keys).agg(F.avg("population").alias("ideal_population"))
    return sizes.join(ideal, list(keys)).withColumn(
        "deviation", try_div("population", "ideal_population") - 1)


def population_ok(d: DataFrame, eps: float, keys: Sequence[str] = PLAN) -> DataFrame:
    """Whether every district of a plan is within ``eps`` of the ideal, with the worst deviation."""
    off = F.abs("deviation")
    return population_deviation(d, keys).groupBy(*keys).agg(
        F.max(off).alias("max_deviation"), F.bool_and(off <= eps).alias("population_ok"))


def compactness_ok(
    assignments: DataFrame, edges: DataFrame, initial: DataFrame, factor: float, keys: Sequence[str] = PLAN,
    group: Sequence[str] = ("seg_level",),
) -> DataFrame:
    """Whether a plan cuts at most ``factor`` times the edges of its group's initial plan."""
    start = cut_edges(initial, edges, group).withColumnRenamed("cut_edges", "initial_cut_edges")
    return cut_edges(assignments, edges, keys).join(start, list(group)).withColumn(
        "compact", F.col("cut_edges") <= F.lit(factor) * F.col("initial_cut_edges"))
