"""Connected parts of every district of every plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwise.plans.metrics import pair_districts
from wardwise.schemas import PLAN
from wardwise.session import Scratch


def components(nodes: DataFrame, links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest reachable node of each node: (keys, node, root).

    Contraction: each root adopts the smallest root it touches, pointers are
    shortened once, links are rewritten between roots, and links inside a root
    vanish. Links shrink each round, a hub costs one aggregated row, and the loop
    ends by itself when none are left.
    """
    keys, scratch = list(keys), Scratch(links.sparkSession, "components")
    both = links.unionByName(links.select(*keys, F.col("a").alias("b"), F.col("b").alias("a")))
    live = scratch.write(both.where(F.col("a") != F.col("b")).select(*keys, "a", "b").distinct(), "links0")
    jumps: list[DataFrame] = []
    while not live.isEmpty():
        k = len(jumps)
        up = live.groupBy(*keys, "a").agg(F.min("b").alias("_b")).select(
            *keys, F.col("a").alias("root"), F.least("a", "_b").alias("up"))
        above = up.select(*keys, F.col("root").alias("up"), F.col("up").alias("_top"))
        jump = scratch.write(up.join(above, [*keys, "up"], "left").select(
            *keys, "root", F.coalesce("_top", "up").alias("top")), f"jumps{k}")
        jumps.append(jump)
        left = jump.select(*keys, F.col("root").alias("a"), F.col("top").alias("_ta"))
        right = jump.select(*keys, F.col("root").alias("b"), F.col("top").alias("_tb"))
        moved = live.join(left, [*keys, "a"]).join(right, [*keys, "b"])
        live = scratch.write(moved.where(F.col("_ta") != F.col("_tb")).select(
            *keys, F.col("_ta").alias("a"), F.col("_tb").alias("b")).distinct(), f"links{k + 1}")
        scratch.drop(f"links{k}")
    if not jumps:
        return nodes.select(*keys, "node", F.col("node").alias("root"))
    # Composed from the last: each round's jumps, which are fewer from round to round, are joined once, and the nodes once.
    composed = jumps[-1]
    for jump in reversed(jumps[:-1]):
        further = composed.select(*keys, F.col("root").alias("top"), F.col("top").alias("_further"))
        composed = jump.join(further, [*keys, "top"], "left").select(*keys, "root", F.coalesce("_further", "top").alias("top"))
    own = composed.withColumnRenamed("root", "node")
    return nodes.join(own, [*keys, "node"], "left").select(*keys, "node", F.coalesce("top", "node").alias("root"))


def district_components(assignments: DataFrame, edges: DataFrame, keys: Sequence[str] = PLAN) -> DataFrame:
    """Number of connected parts of each district; one means contiguous."""
    inner = pair_districts(assignments, edges, keys).where(F.col("src_district") == F.col("dst_district")).select(
        *keys, F.col("src").alias("a"), F.col("dst").alias("b"))
    nodes = assignments.select(*keys, F.col("precinct_id").alias("node"), "district_id")
    found = components(nodes, inner, keys)
    # Each part has exactly one root, a precinct of the same district.
    roots = found.where(F.col("node") == F.col("root")).select(*keys, "node")
    return nodes.join(roots, [*keys, "node"]).groupBy(*keys, "district_id").agg(
        F.count(F.lit(1)).alias("n_components")).withColumn("contiguous", F.col("n_components") == 1)


def plan_contiguity(assignments: DataFrame, edges: DataFrame, keys: Sequence[str] = PLAN) -> DataFrame:
    return district_components(assignments, edges, keys).groupBy(*keys).agg(
        F.bool_and("contiguous").alias("contiguous"), F.max("n_components").alias("max_components"))
