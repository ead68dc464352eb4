"""Running totals, ranks and exact quantiles over tables of any size.

A window without a partition key, or with one very large group, sorts all its
rows in one task. The operators here sort by range instead: the table is cut into
ordered slices, each slice is summarised, the summaries (one row per slice and
key) are accumulated, and each slice then continues from its own start value.
The slice number is written to a table before it is used twice, so that both
passes see the same cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardwise.session import materialise

SLICE = "_slice"
#: Counts of so few bins go to every task, whatever the session's limit: the counted rows are then not shuffled to them.
FEW_BINS = 200_000


def _sorts(order_by) -> list[Column]:
    items = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return [F.col(c) if isinstance(c, str) else c for c in items]


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where NULL equals NULL; ``right`` brings its other columns."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, same, how).drop(*[f"_r_{k}" for k in keys])


def cut_into_slices(df: DataFrame, order_by, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` range-partitioned by keys and order, with its slice number, as a table.

    The number of slices is left open, so that adaptive execution merges neighbours
    when the table is small.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *_sorts(order_by))
    return materialise(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")


def running(
    df: DataFrame,
    order_by,
    keys: Sequence[str] = (),
    sums: dict[str, str] | None = None,
    maxes: dict[str, str] | None = None,
    row_number: str | None = None,
    count: str | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Adds running sums, running maxima, a row number and the group size.

    ``order_by`` must order rows uniquely within ``keys`` (add the id as the last
    item). ``sums`` and ``maxes`` map output names to input columns, ``totals`` maps output names to running sums
    of which it gives the group's last. NULL keys form groups of their own.
    """
    keys, sums, maxes, whole_sums = list(keys), dict(sums or {}), dict(maxes or {}), dict(totals or {})
    cut = cut_into_slices(df, order_by, keys)
    combine = {o: (F.sum, c) for o, c in sums.items()} | {o: (F.max, c) for o, c in maxes.items()}

    totals = cut.groupBy(*keys, SLICE).agg(
        F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"_t_{o}") for o, (f, c) in combine.items()]
    )
    # One row per key and slice: at most the number of slices for each key.
    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_slice.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        *keys,
        SLICE,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.sum("_n").over(whole).alias("_size"),
        *[f(f"_t_{o}").over(before).alias(f"_s_{o}") for o, (f, _) in combine.items()],
        *[F.sum(f"_t_{s}").over(whole).alias(f"_w_{o}") for o, s in whole_sums.items()],
    )
    if not keys:
        starts = F.broadcast(starts)  # as many rows as slices

    inside = Window.partitionBy(*keys, SLICE).orderBy(*_sorts(order_by))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = join_same(cut, starts, [*keys, SLICE])
    added: dict[str, Column] = {}
    for o, c in sums.items():
        start = F.coalesce(F.col(f"_s_{o}"), F.lit(0))
        added[o] = F.coalesce(F.sum(c).over(upto), F.lit(0)) + start
    for o, c in maxes.items():
        added[o] = F.greatest(F.max(c).over(upto), F.col(f"_s_{o}"))
    if row_number:
        added[row_number] = F.col("_n0") + F.row_number().over(inside).cast("bigint")
    if count:
        added[count] = F.col("_size")
    added |= {o: F.col(f"_w_{o}") for o in whole_sums}
    return joined.withColumns(added).select(*df.columns, *added)


def ntile_of(row_number, size, n: int) -> Column:
    """Bucket of a row when ``size`` ordered rows are dealt into n near-equal buckets.

    The first ``size mod n`` buckets hold one row more than the others.
    """
    rn, size = F.col(row_number), F.col(size)
    small = F.floor(size / F.lit(n)).cast("bigint")
    extra = F.pmod(size, F.lit(n))
    in_big = extra * (small + 1)
    low = F.floor((rn - 1) / (small + 1))
    high = extra + F.floor((rn - 1 - in_big) / F.greatest(small, F.lit(1)))
    return (F.when(rn <= in_big, low).otherwise(high) + 1).cast("bigint")


def with_ntile(df: DataFrame, order_by, n: int, name: str, keys: Sequence[str] = ()) -> DataFrame:
    ranked = running(df, order_by, keys, row_number="_rn", count="_cnt")
    return ranked.withColumn(name, ntile_of("_rn", "_cnt", n)).drop("_rn", "_cnt")


def deal_by_score(
    df: DataFrame, score: str, id_col: str, n: int, name: str, keys: Sequence[str] = (), lo: float = 0.0, hi: float = 1.0, bins: int = 2048
) -> DataFrame:
    """``with_ntile`` by a score and an id, for few keys of many rows: rows are counted by bins of the score, and only bins that a bucket's end cuts are sorted.

    ``lo`` and ``hi`` are where most scores lie: scores beyond, NULL and NaN have end bins of their own. A bin may hold any number of rows.
    ``df`` is read three times and should be cheap to read. It is not shuffled while keys times bins stay within ``FEW_BINS``.
    """
    keys, x = list(keys), F.col(score).cast("double")
    place = F.floor(F.greatest(F.lit(0.0), F.least((x - lo) * (bins / (hi - lo)), F.lit(bins - 1.0)))).cast("int")
    binned = df.withColumn("_bin", F.when(x.isNull(), -1).when(F.isnan(x), bins).otherwise(place))
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    # One row per key and bin.
    by_bin = Window.partitionBy(*keys).orderBy("_bin")
    before, whole = by_bin.rowsBetween(Window.unboundedPreceding, -1), by_bin.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = counts.withColumns({"_below": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(whole)})
    ends = placed.withColumns({"_first": F.col("_below") + 1, "_last": F.col("_below") + F.col("_n")}).withColumns(
        {"_lowest": ntile_of("_first", "_all", n), "_highest": ntile_of("_last", "_all", n)})
    bounds = materialise(ends.select(*keys, "_bin", "_below", "_all", "_lowest", (F.col("_lowest") < F.col("_highest")).alias("_cut")), "bounds")
    send = F.broadcast if bounds.count() <= FEW_BINS else lambda rows: rows
    whole_bins = join_same(binned, send(bounds.where(~F.col("_cut")).select(*keys, "_bin", F.col("_lowest").alias(name))), [*keys, "_bin"])
    cut = join_same(binned, send(bounds.where("_cut").select(*keys, "_bin", "_below", "_all")), [*keys, "_bin"])
    ranked = running(cut, [score, id_col], [*keys, "_bin"], row_number="_place").withColumn("_place", F.col("_below") + F.col("_place"))
    out = [*df.columns, name]
    return whole_bins.select(*out).unionByName(ranked.withColumn(name, ntile_of("_place", "_all", n)).select(*out))


def peer_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each distinct value with the number of rows below it, up to it, and in all.

    The table is reduced to one row per distinct value before it is ordered, so
    that ties of any number cost one row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = running(counts, [value], keys, sums={"n_upto": "_c"}, totals={"n_all": "n_upto"})
    for key in keys:
        upto = upto.where(F.col(key).isNotNull())
    return upto.withColumn("n_below", F.col("n_upto") - F.col("_c")).drop("_c")


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated quantiles per key, one column per entry of ``probs``.

    Same numbers as ``percentile``, but no group has to fit into one task: equal
    values are merged first, and the order statistics are then picked out of a
    range-sorted running count.
    """
    ranked = peer_ranks(df, value, keys)
    x, last = F.col(value).cast("double"), F.col("n_all") - 1
    picks, parts = {}, []
    for name, p in probs.items():
        h = last * F.lit(float(p))
        for end, position in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("n_below") <= position) & (position < F.col("n_upto"))
            parts.append(F.max(F.when(hit, x)).alias(f"_{name}_{end}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        h = (F.col("_n") - 1) * F.lit(float(p))
        picks[name] = lo + (h - F.floor(h)) * (hi - lo)
    found = ranked.groupBy(*keys).agg(F.max("n_all").alias("_n"), *parts)
    return found.select(*keys, *[e.alias(n) for n, e in picks.items()])


def truncate_at_total(
    df: DataFrame, order_by, value: str, target: float, keys: Sequence[str] = ()
) -> DataFrame:
    """Rows, in order, for as long as the running total stays within ``target``."""
    total = running(df, order_by, keys, sums={"_cum": value})
    return total.where(F.col("_cum") <= target).drop("_cum")


def rank_scale(df: DataFrame, value: str, lo: float, hi: float, id_col: str, name: str) -> DataFrame:
    """Unique rank of ``value`` (ties by id) stretched evenly over [lo, hi]."""
    ranked = running(df, [value, id_col], row_number="_rn", count="_cnt")
    unit = F.try_divide((F.col("_rn") - 1).cast("double"), (F.col("_cnt") - 1).cast("double"))
    return ranked.withColumn(name, F.lit(float(lo)) + unit * F.lit(float(hi - lo))).drop("_rn", "_cnt")


def blended_order(
    df: DataFrame, score: str, alpha: float, noise: Column, id_col: str, name: str = "position"
) -> DataFrame:
    """Order between descending score (alpha = 1) and noise (alpha = 0), by rank blending."""
    scored = running(df, [F.col(score).desc(), id_col], row_number="rank_score")
    mixed = running(scored.withColumn("_u", noise), ["_u", id_col], row_number="rank_noise")
    blend = F.lit(float(alpha)) * F.col("rank_score") + F.lit(float(1 - alpha)) * F.col("rank_noise")
    return running(mixed.withColumn("blend", blend).drop("_u"), ["blend", id_col], row_number=name)


def with_row_id(df: DataFrame, order_by, name: str = "row_id", keys: Sequence[str] = ()) -> DataFrame:
    return running(df, order_by, keys, row_number=name)


def ecdf(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "ecdf") -> DataFrame:
    """Share of rows at or below each row's value; NULL values have none and are not counted."""
    ranks = peer_ranks(df.where(F.col(value).isNotNull()), value, keys).withColumn(name, F.col("n_upto") / F.col("n_all"))
    return join_same(df, ranks.select(*keys, value, name), [*keys, value], "left")


# Percent-rank limits of the density classes, and their names.
DENSITY_CUTS = (0.95, 0.80, 0.50)
DENSITY_CLASSES = ("urban_core", "urban", "suburban", "rural")


def density_class(
    df: DataFrame,
    value: str,
    cuts: Sequence[float] = DENSITY_CUTS,
    labels: Sequence[str] = DENSITY_CLASSES,
    name: str = "density_class",
) -> DataFrame:
    """Class by percent rank: above the first cut, above the second, ..., the rest; NULL values have no class."""
    ranks = peer_ranks(df.where(F.col(value).isNotNull()), value)
    pct = F.when(F.col("n_all") > 1, F.col("n_below") / (F.col("n_all") - 1)).otherwise(F.lit(0.0))
    chain = F.when(pct > cuts[0], labels[0])
    for c, label in zip(cuts[1:], labels[1:], strict=False):
        chain = chain.when(pct > c, label)
    return join_same(df, ranks.select(value, chain.otherwise(labels[-1]).alias(name)), [value], "left")


def min_max(df: DataFrame, cols: Sequence[str], suffix: str = "_std") -> DataFrame:
    """Columns stretched to [0, 1] by the table's own minimum and maximum."""
    ends = df.agg(F.struct(*[f(c).alias(f"{f.__name__}_{c}") for c in cols for f in (F.min, F.max)]).alias("e")).scalar()
    return df.withColumn("_e", ends).withColumns({
        c + suffix: F.try_divide(
            F.col(c) - F.col(f"_e.min_{c}"), F.col(f"_e.max_{c}") - F.col(f"_e.min_{c}")
        ) for c in cols
    }).drop("_e")


def z_score(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    ends = df.agg(F.struct(*[
        e for c in cols for e in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))
    ]).alias("e")).scalar()
    return df.withColumn("_e", ends).withColumns({
        c + suffix: F.try_divide(F.col(c) - F.col(f"_e.m_{c}"), F.col(f"_e.s_{c}")) for c in cols
    }).drop("_e")


def center(df: DataFrame, cols: Sequence[str], suffix: str = "_centered") -> DataFrame:
    ends = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols]).alias("e")).scalar()
    return df.withColumn("_e", ends).withColumns(
        {c + suffix: F.col(c) - F.col(f"_e.m_{c}") for c in cols}
    ).drop("_e")


def share_of_group(df: DataFrame, value: str, keys: Sequence[str], name: str, how: str = "sum",
                   scale: float = 1.0) -> DataFrame:
    """``value`` over its group's total (or maximum), times ``scale``.

    The group figure is aggregated and joined back, so that a large group is
    summed in parts on all executors.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    part = F.col(value).cast("double")
    if not keys:
        whole = df.agg(fold(value).alias("w")).scalar()
        return df.withColumn(name, F.try_divide(part, whole.cast("double")) * F.lit(float(scale)))
    whole = df.groupBy(*keys).agg(fold(value).alias("_w"))
    ratio = F.try_divide(part, F.col("_w").cast("double")) * F.lit(float(scale))
    return join_same(df, whole, list(keys)).withColumn(name, ratio).drop("_w")


def decile_profile(df: DataFrame, value: str, id_col: str, n: int = 10) -> DataFrame:
    """Equal-count buckets of ``value`` with their share of rows and mean."""
    tiles = with_ntile(df.select(id_col, value), [value, id_col], n, "decile")
    counts = tiles.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"))
    return share_of_group(counts, "n", [], "prop")


def region_by_score(
    df: DataFrame, value: str, num_regions: int, alpha: float, noise: Column, id_col: str
) -> DataFrame:
    """Regions of equal size along a score mixed from ``value`` and noise."""
    normed = min_max(df, [value], "_norm")
    score = F.lit(float(alpha)) * F.col(f"{value}_norm") + F.lit(float(1 - alpha)) * noise
    ranked = running(
        normed.withColumn("location_score", score), ["location_score", id_col],
        row_number="_rn", count="_cnt",
    )
    # Bins of the row number that are closed on the right.
    region = F.ceil(F.col("_rn") * F.lit(num_regions) / F.col("_cnt")).cast("bigint")
    return ranked.withColumn("geog_id", region).drop("_rn", "_cnt")
