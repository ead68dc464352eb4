"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwise.plans.ensemble import tail_classes
from wardwise.schemas import SCENARIO


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_scenarios(df: DataFrame, path: str) -> None:
    """One folder per scenario, in files of the session's advisory size.

    Rebalancing gathers each scenario's rows, merges small pieces and splits a scenario
    that holds most of the rows over as many tasks as its size asks for.
    """
    write_table(df.hint("rebalance", *[F.col(c) for c in SCENARIO]), path, SCENARIO)


def write_assignments(df: DataFrame, table: str, buckets: int, by: str = "map_id") -> None:
    """Plan rows stored in buckets, so that what is keyed on ``by`` needs no shuffle.

    By plan: totals, estimates and plan metrics group within a bucket. By precinct: the
    join with a precinct table too large to broadcast; choose this when one plan holds
    a large part of all rows.
    """
    df.write.mode("overwrite").bucketBy(buckets, by).sortBy(by).saveAsTable(table)


def write_tails(districts: DataFrame, maps: DataFrame, path: str) -> None:
    """District and plan summaries by ensemble class, in one partitioned write each.

    A plan may be in several classes and is then written under each.
    """
    classes = tail_classes(maps)
    write_table(classes, f"{path}/maps", ["category"])
    write_table(districts.join(classes.select("map_id", "category"), "map_id"), f"{path}/districts", ["category"])
