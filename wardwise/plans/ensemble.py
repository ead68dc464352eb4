"""Classes, best members and score series of an ensemble of plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwise.operators.ordered import running


def tail_classes(maps: DataFrame, upper: float = 0.975, middle: tuple[float, float] = (0.25, 0.75)) -> DataFrame:
    """One row per plan and class it belongs to: all, top_rep, top_dem, middle.

    Classes may overlap. Seat counts take few distinct values, so their exact
    quantiles are cheap at any number of plans.
    """
    cuts = maps.agg(F.struct(
        F.percentile("n_rep_districts", F.lit(upper)).alias("rep"), F.percentile("n_dem_districts", F.lit(upper)).alias("dem"),
        F.percentile("n_rep_districts", F.lit(middle[0])).alias("lo"), F.percentile("n_rep_districts", F.lit(middle[1])).alias("hi"),
    ).alias("q")).scalar()
    rep, dem = F.col("n_rep_districts"), F.col("n_dem_districts")
    flags = {
        "all": F.lit(True), "top_rep": rep >= F.col("_q.rep"), "top_dem": dem >= F.col("_q.dem"),
        "middle": (rep >= F.col("_q.lo")) & (rep <= F.col("_q.hi")),
    }
    classes = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in flags.items()]))
    return maps.withColumn("_q", cuts).withColumn("category", F.explode(classes)).drop("_q")


def best_plan(scores: DataFrame, by: str, keys: Sequence[str] = ()) -> DataFrame:
    """The plan with the highest score per group, the lowest number among equals."""
    top = F.max(F.struct(F.col(by).alias("score"), (-F.col("map_id")).alias("neg"))).alias("_t")
    return scores.groupBy(*keys).agg(top).select(*keys, (-F.col("_t.neg")).alias("map_id"), F.col("_t.score").alias("score"))


def order_by_reference_class(df: DataFrame, id_col: str, value: str, class_col: str, ref: str) -> DataFrame:
    """Position of each id by its value in the reference class, on the rows of all classes."""
    order = running(df.where(F.col(class_col) == ref).select(id_col, value), [value, id_col], row_number="position")
    return df.join(order.select(id_col, "position"), id_col)


def representative_plan(maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First plan whose seats equal the group's median; plan 1 when there is none."""
    medians = maps.groupBy(*keys).agg(F.percentile("n_dem_districts", F.lit(0.5)).alias("median_seats"))
    hit = F.min(F.when(F.col("n_dem_districts") == F.col("median_seats"), F.col("map_id")))
    return maps.join(medians, list(keys)).groupBy(*keys, "median_seats").agg(
        F.coalesce(hit, F.lit(1)).cast("bigint").alias("map_id"))


def best_so_far(chain: DataFrame, run: str, step: str, score: str, burst_length: int) -> DataFrame:
    """Best score up to each step of each run, with the number of the step's burst."""
    scored = running(chain, [step], [run], maxes={"best": score})
    return scored.withColumn("burst", F.floor(F.col(step) / F.lit(burst_length)).cast("bigint"))


def burst_patience(chain: DataFrame, run: str, step: str, score: str, burst_length: int, patience: int) -> DataFrame:
    """One row per run and completed burst with its best score and stale count.

    A burst improves when its own maximum exceeds the best of all bursts before it.
    The stale count is the distance to the latest burst that improved (gaps and
    islands), which is again a running maximum.
    """
    burst = F.floor(F.col(step) / F.lit(burst_length)).cast("bigint")
    bursts = chain.groupBy(run, burst.alias("burst")).agg(
        F.max(score).alias("top"), F.count(F.lit(1)).alias("_n")
    ).where(F.col("_n") == burst_length).drop("_n")
    series = running(bursts, ["burst"], [run], maxes={"best": "top"})
    prior = series.select(run, (F.col("burst") + 1).alias("burst"), F.col("best").alias("_prior"))
    joined = series.join(prior, [run, "burst"], "left").withColumn(
        "improved", F.col("_prior").isNull() | (F.col("best") > F.col("_prior") + F.lit(1e-12)))
    marked = joined.withColumn("_at", F.when(F.col("improved"), F.col("burst")))
    islands = running(marked, ["burst"], [run], maxes={"_last": "_at"})
    out = islands.withColumn("stale_bursts", F.col("burst") - F.col("_last"))
    stop = out.where(F.col("stale_bursts") >= patience).groupBy(run).agg(F.min("burst").alias("stop_burst"))
    return out.join(stop, run, "left").withColumn(
        "stopped", F.coalesce(F.col("burst") > F.col("stop_burst"), F.lit(False))
    ).select(run, "burst", "best", "improved", "stale_bursts", "stopped")


def ensemble_summary(scores: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Best plan with the best and mean score of each ensemble."""
    best = best_plan(scores, score, keys)
    mean = scores.groupBy(*keys).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n_plans"))
    if keys:
        return best.join(mean, list(keys))
    row = mean.select(F.struct("mean_score", "n_plans").alias("m")).scalar()
    return best.withColumn("_m", row).select("map_id", "score", "_m.mean_score", "_m.n_plans")
