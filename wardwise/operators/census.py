"""Preparation of census units: cleaning, classes, packing into larger units, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwise.functions import clamp, try_div
from wardwise.operators.ordered import join_same, running
from wardwise.session import Scratch

# Seed states by segregation category.
STATE_CATEGORIES = {
    "low": ["mt", "ia", "me", "vt", "wy"],
    "medium": ["or", "ut", "mi", "oh", "in", "pa"],
    "high": ["al", "ca", "fl", "ga", "il", "la", "md", "ms", "nc", "ny", "sc", "tx"],
}
# Least and greatest target of a packed unit by the size of its first block (upper limit, least, greatest).
TARGET_RANGES = [(50, 3000, 6000), (200, 2000, 4000), (500, 1500, 3000), (None, 800, 2000)]
# Target size of a packed unit by the size of its blocks (upper limit, target).
SIZE_TARGETS = [(50, 2000), (200, 1500), (500, 1000), (None, 800)]


def clean_blocks(df: DataFrame, scale: float = 27.0) -> DataFrame:
    """Populated blocks with a clamped minority share and scaled, rounded size."""
    share = clamp(try_div("CVAP_BLK22", "CVAP_TOT22"), 0.0, 1.0)
    return df.where(F.col("CVAP_TOT22") > 0).select(
        F.col("GEOID20").alias("precinct_id"),
        F.bround(F.col("CVAP_TOT22") * F.lit(float(scale))).cast("bigint").alias("population"),
        F.col("CVAP_WHT22").alias("cvap_maj"), F.col("CVAP_BLK22").alias("cvap_min"),
        share.alias("per_minority"), *[c for c in ("state",) if c in df.columns],
    )


def valid_blocks(df: DataFrame) -> DataFrame:
    """Blocks with a known, positive population and a share in [0, 1]."""
    return df.where(
        F.col("population").isNotNull() & F.col("per_minority").isNotNull() & (F.col("population") > 0)
        & (F.col("per_minority") >= 0) & (F.col("per_minority") <= 1)
    )


def with_state_category(df: DataFrame, mapping: dict[str, Sequence[str]] | None = None, state: str = "state") -> DataFrame:
    """Rows of the listed states, tagged with the category of their state."""
    mapping = mapping or STATE_CATEGORIES
    chain = None
    for category, states in mapping.items():
        test = F.col(state).isin(list(states))
        chain = F.when(test, category) if chain is None else chain.when(test, category)
    return df.withColumn("category", chain).where(F.col("category").isNotNull())


def _pack(df: DataFrame, unit: str, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, unit).agg(
        *[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("n_blocks_aggregated")
    )


def pack_by_running_sum(
    df: DataFrame, order_by, value: str, target: float | Column, sums: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Units of consecutive blocks: a new one each time the running total passes a multiple of the target."""
    target = target if isinstance(target, Column) else F.lit(float(target))
    ranked = running(df, order_by, keys, sums={"_cum": value})
    return _pack(ranked.withColumn("unit", F.ceil(F.col("_cum") / target).cast("bigint")), "unit", keys, sums)


def size_target(size: str = "population") -> Column:
    chain = None
    for limit, target in SIZE_TARGETS[:-1]:
        test = F.col(size) < limit
        chain = F.when(test, float(target)) if chain is None else chain.when(test, float(target))
    return chain.otherwise(float(SIZE_TARGETS[-1][1]))


def pack_variable(
    df: DataFrame, order_by, value: str, sums: Sequence[str], keys: Sequence[str], min_tail: float,
    target: Column | None = None,
) -> DataFrame:
    """Packing with the mean of the blocks' own targets; a small last unit joins the one before.

    Where the original walks the blocks one by one, each with its own random target,
    this fixes one target per group, so that a running sum decides every cut.
    """
    target = target if target is not None else size_target(value)
    goals = df.groupBy(*keys).agg(F.avg(target).alias("_goal"))
    with_goal = df.join(goals, list(keys))
    units = pack_by_running_sum(with_goal, order_by, value, F.col("_goal"), [*sums], [*keys])
    # Merge the tail: the last unit of a group, when too small and not alone.
    ends = units.groupBy(*keys).agg(
        F.max("unit").alias("_last"), F.max_by(value, "unit").alias("_tail"), F.count(F.lit(1)).alias("_units")
    )
    merge = (F.col("unit") == F.col("_last")) & (F.col("_tail") < min_tail) & (F.col("_units") > 1)
    placed = running(units, ["unit"], keys, row_number="_no").join(ends, list(keys))
    placed = placed.withColumn("unit", F.when(merge, F.col("_no") - 1).otherwise(F.col("_no")))
    return placed.groupBy(*keys, "unit").agg(
        *[F.sum(c).alias(c) for c in sums], F.sum("n_blocks_aggregated").alias("n_blocks_aggregated")
    )


def random_target(size: str, noise: Column, ranges: Sequence[tuple] = TARGET_RANGES) -> Column:
    """A target between the limits that a block's size sets, as far up as ``noise`` (in [0, 1)) says. A NULL size counts as zero."""
    size_of = F.coalesce(F.col(size), F.lit(0))
    between = [(limit, F.lit(float(lo)) + noise * F.lit(float(hi - lo))) for limit, lo, hi in ranges]
    chain = F.when(size_of < between[0][0], between[0][1])
    for limit, value in between[1:-1]:
        chain = chain.when(size_of < limit, value)
    return chain.otherwise(between[-1][1])


def _next_start(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _rn, _next): the first block behind the unit that would begin at each block; none where the blocks run out.

    That is the first row whose total before it reaches this row's own plus its goal. Rows and probes are laid into one descending order, where the
    last row before a probe is the wanted one: a running maximum, sorted by range.
    """
    row = blocks.select(*keys, F.col("_before").alias("_v"), F.lit(0).alias("_probe"), "_rn", (-F.col("_rn")).alias("_at"))
    probe = blocks.select(*keys, (F.col("_before") + F.col("_goal")).alias("_v"), F.lit(1), "_rn", F.lit(None).cast("bigint"))
    found = running(row.union(probe), [F.desc("_v"), "_probe", "_rn"], keys, maxes={"_last": "_at"})
    # A goal of zero or less still takes its first block.
    return found.where("_probe = 1 and _last is not null").select(*keys, "_rn", F.greatest(-F.col("_last"), F.col("_rn") + 1).alias("_next"))


def _reached(jumps: DataFrame, firsts: DataFrame, keys: Sequence[str], scratch: Scratch) -> DataFrame:
    """(keys, _rn) of the rows that the first rows reach by any number of jumps.

    Round k knows the first 2^k rows of every chain and the jumps over 2^k units: the known rows, moved by the jump, are the next 2^k. The rounds
    grow with the logarithm of the number of units, and jumps that pass the end drop out.
    """
    known, k = scratch.write(firsts, "known0"), 0
    while True:
        moved = join_same(known, jumps, [*keys, "_rn"]).select(*keys, F.col("_next").alias("_rn"))
        k += 1
        new = scratch.write(moved, f"new{k}")
        if new.isEmpty():
            return known
        known = scratch.write(known.unionByName(new), f"known{k}")
        twice = jumps.withColumnsRenamed({"_rn": "_first", "_next": "_rn"})
        jumps = scratch.write(join_same(twice, jumps, [*keys, "_rn"]).select(*keys, F.col("_first").alias("_rn"), "_next"), f"jumps{k}")
        scratch.drop(f"new{k}", f"known{k - 1}", f"jumps{k - 1}")


def pack_sequential(
    df: DataFrame, order_by, value: str, sums: Sequence[str], keys: Sequence[str], target: Column, min_tail: float = 500.0,
) -> DataFrame:
    """Units of consecutive blocks, each closed when it reaches the target that its own first block sets.

    Returns keys, unit (from 1), the totals of ``sums`` and n_blocks_aggregated. The last unit of a group joins the one before if its
    ``value`` is below ``min_tail`` and there is one before. The blocks are not walked one by one: where a unit that began at a given block would
    end depends on that block alone, so every block gets a pointer to the next start (``_next_start``), and
    the pointers are doubled until the starts reached from the first block are known (``_reached``). Totals are differences of running totals, so no
    group has to fit into one task. NULL counts as zero; ``order_by`` must be unique within ``keys``; a NULL key is a group of its own.
    """
    keys, scratch = list(keys), Scratch(df.sparkSession, "packing")
    measured = [value, *[c for c in sums if c != value]]
    totals = {f"_to_{c}": f"_x_{c}" for c in measured}
    filled = df.withColumns({f"_x_{c}": F.coalesce(F.col(c), F.lit(0)) for c in measured}).withColumn("_goal", target)
    ranked = running(filled, order_by, keys, sums=totals, row_number="_rn")
    before = {f"_b_{c}": F.col(f"_to_{c}") - F.col(f"_x_{c}") for c in measured}
    blocks = scratch.write(ranked.withColumns(before).select(
        *keys, "_rn", "_goal", *before, *totals, F.col(f"_b_{value}").alias("_before")), "blocks")
    jumps = scratch.write(_next_start(blocks, keys), "jumps")
    starts = _reached(scratch.write(jumps, "jumps0"), blocks.where("_rn = 1").select(*keys, "_rn"), keys, scratch)
    ends = blocks.groupBy(*keys).agg(F.max("_rn").alias("_size"), *[F.max_by(t, "_rn").alias(f"_e_{t}") for t in totals])
    begun = join_same(starts, blocks.select(*keys, "_rn", *before), [*keys, "_rn"])
    begun = join_same(begun, jumps, [*keys, "_rn"], "left")
    following = blocks.select(*keys, F.col("_rn").alias("_next"), *[F.col(b).alias(f"_n{b}") for b in before])
    bounded = join_same(join_same(begun, following, [*keys, "_next"], "left"), ends, keys)
    units = bounded.select(
        *keys, "_rn", (F.coalesce("_next", F.col("_size") + 1) - F.col("_rn")).alias("n_blocks_aggregated"), F.col("_next").isNull().alias("_open"),
        *[(F.coalesce(f"_n_b_{c}", f"_e__to_{c}") - F.col(f"_b_{c}")).alias(f"_s_{c}") for c in measured])
    numbered = running(units, ["_rn"], keys, row_number="unit")
    tail = F.col("_open") & (F.col(f"_s_{value}") < min_tail) & (F.col("unit") > 1)
    merged = numbered.withColumn("unit", F.when(tail, F.col("unit") - 1).otherwise(F.col("unit")))
    return merged.groupBy(*keys, "unit").agg(
        *[F.sum(f"_s_{c}").alias(c) for c in sums], F.sum("n_blocks_aggregated").alias("n_blocks_aggregated"))


def pack_by_class(
    df: DataFrame, class_col: str, n_units: dict[str, int], order_by, sums: Sequence[str]
) -> DataFrame:
    """Each class dealt in order into a wanted number of units; the last takes the rest."""
    ranked = running(df, order_by, [class_col], row_number="_rn", count="_size")
    goal = F.create_map(*[F.lit(v) for k, n in n_units.items() for v in (k, n)])[F.col(class_col)]
    rows = ranked.withColumn("_goal", goal).where(F.col("_goal") > 0)
    per_unit = F.greatest(F.floor(F.col("_size") / F.col("_goal")), F.lit(1))
    unit = F.least(F.floor((F.col("_rn") - 1) / per_unit), F.col("_goal") - 1).cast("bigint")
    return _pack(rows.withColumn("unit", unit), "unit", [class_col], sums)


def scale_to_total(df: DataFrame, parts: Sequence[str], target: float, total: str = "population") -> DataFrame:
    """Component counts scaled so that the whole meets ``target``; the total is their sum."""
    now = df.agg(F.sum(total).alias("t")).scalar()
    factor = F.lit(float(target)) / now
    scaled = df.withColumn("_f", factor).withColumns(
        {c: F.bround(F.col(c) * F.col("_f")).cast("bigint") for c in parts}).drop("_f")
    return scaled.withColumn(total, sum((F.col(c) for c in parts[1:]), F.col(parts[0])))


def jitter_middle(df: DataFrame, share: str, noise: Column, lo: float = 0.05, hi: float = 0.95,
                  width: float = 0.05) -> DataFrame:
    """A sort key that shakes mixed units and leaves homogeneous ones in place.

    ``noise`` is in [0, 1). Order by the key, with the id as last item.
    """
    x = F.col(share)
    shaken = clamp(x + (noise * 2 - 1) * F.lit(float(width)), lo, hi)
    return df.withColumn("sort_key", F.when((x > lo) & (x < hi), shaken).otherwise(x))
