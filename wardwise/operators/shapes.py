"""Reshapes: wide plans, long pivots with keys in names, unions, grids, expansions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwise.functions import try_div
from wardwise.operators.waste import GROUPS, PARTIES
from wardwise.schemas import require_columns


def melt_pattern(
    df: DataFrame, pattern: str, key_names: Sequence[str], value_name: str, ids: Sequence[str]
) -> DataFrame:
    """Columns whose whole name matches ``pattern``, one row each; its groups become keys."""
    found = [(c, m.groups()) for c in df.columns if (m := re.fullmatch(pattern, c))]
    if not found:
        raise ValueError(f"no column matches {pattern}")
    rows = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(key_names, keys, strict=True)], F.col(c).alias(value_name))
        for c, keys in found
    ]
    return df.select(*ids, F.inline(F.array(*rows)))


def waste_breakdown(results: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Votes and percent of the group by group, party and kind of waste."""
    rows = [
        F.struct(
            F.lit(g).alias("group"), F.lit(p).alias("party"), F.lit(k).alias("vote_type"),
            F.col(f"{g}_{p}_wasted_{k}").alias("votes"),
            (try_div(f"{g}_{p}_wasted_{k}", f"total_{g}") * 100).alias("percent"),
        )
        for g in GROUPS for p in PARTIES for k in ("surplus", "losing")
    ]
    return results.select(*ids, F.inline(F.array(*rows)))


def pair_truth_estimate(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(group, model, true, estimate) rows from the wide result columns."""
    rows = [
        F.struct(
            F.lit(g).alias("group"), F.lit(m.upper()).alias("model"),
            F.col(f"true_{g}_dem_share").alias("true"), F.col(f"{m}_{g}_dem_share").alias("estimate"),
        )
        for g in GROUPS for m in ("er", "ei")
    ]
    return df.select(*ids, F.inline(F.array(*rows)))


def plans_to_long(
    wide: DataFrame, id_col: str = "precinct_id", drop: Sequence[str] = ("init_CD",), district_base: int = 0
) -> DataFrame:
    """One column per plan to one row per plan and precinct.

    The plan number is the one in the column's name when it has one; ``map_id`` of
    names without a number is the position of the column, from 1. Columns are matched
    by name, so their order does not matter.
    """
    require_columns(wide, [id_col])
    plans = [c for c in wide.columns if c != id_col and c not in drop]
    numbers = {c: (int(m.group(1)) if (m := re.search(r"(\d+)$", c)) else i) for i, c in enumerate(plans, 1)}
    if len(set(numbers.values())) != len(plans):
        numbers = {c: i for i, c in enumerate(plans, 1)}
    rows = F.array(*[
        F.struct(F.lit(numbers[c]).cast("bigint").alias("map_id"), F.lit(c).alias("plan_name"),
                 (F.col(f"`{c}`").cast("bigint") - F.lit(district_base)).alias("district_id"))
        for c in plans
    ])
    return wide.select(id_col, F.inline(rows)).select("map_id", "plan_name", id_col, "district_id")


def plans_to_wide(assignments: DataFrame, plan_ids: Sequence[int], id_col: str = "precinct_id",
                  prefix: str = "step_") -> DataFrame:
    """Chosen plans as columns, for exchange with tools that expect a matrix."""
    wide = assignments.groupBy(id_col).pivot("map_id", list(plan_ids)).agg(F.max("district_id"))
    return wide.withColumnsRenamed({str(i): f"{prefix}{i}" for i in plan_ids})


def union_all(dfs: dict[str, DataFrame] | Sequence[DataFrame], tag: str | None = None) -> DataFrame:
    """Union by name with missing columns as NULL; a dict may tag each part."""
    if isinstance(dfs, dict):
        parts = [df.withColumn(tag, F.lit(k)) if tag else df for k, df in dfs.items()]
    else:
        parts = list(dfs)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def keys_minus(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b, list(on), "left_anti")


def keys_in(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b, list(on), "left_semi")


def grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """All cells of a rows x cols lattice, counted from 1."""
    each = spark.range(1, rows + 1).withColumnRenamed("id", "row")
    columns = F.sequence(F.lit(1).cast("bigint"), F.lit(cols).cast("bigint"))
    return each.withColumn("col", F.explode(columns))


#: Members that one row of the first step stands for.
CHUNK = 4096


def expand_counts(df: DataFrame, total: str, ones: str, id_col: str, chunk: int = CHUNK) -> DataFrame:
    """One row per member: ``total`` rows per unit, of which the first ``ones`` carry 1.

    A unit first becomes one row for each ``chunk`` members, and these, spread over the tasks if there are many, become the members: no array
    holds a large unit, and no task has to write all of it.
    """
    size = F.col(total).cast("bigint")
    step = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    parts = df.where(size > 0).select(
        id_col, F.col(ones).alias("_ones"), size.alias("_total"), F.explode(step(F.ceil(size / F.lit(chunk)).cast("bigint"))).alias("_part"))
    many = df.agg(F.max(size)).first()[0] or 0
    if many > chunk:
        parts = parts.repartition(F.xxhash64(id_col, "_part"))
    first = F.col("_part") * F.lit(chunk)
    each = F.explode(step(F.least(F.col("_total") - first, F.lit(chunk).cast("bigint"))))
    members = parts.select(id_col, "_ones", first.alias("_first"), each.alias("_at"))
    position = F.col("_first") + F.col("_at") + 1
    return members.select(id_col, position.alias("position"), (position <= F.col("_ones")).cast("bigint").alias("race"))
