"""Repeatable sampling: hash order, weighted draws with replacement, raking, calibration.

A random choice is a function of a seed and the row's keys, so a lost task repeats
it exactly. Every function takes its noise as a column, by default a hash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from wardwise.functions import clamp, cut_index, hash_noise
from wardwise.operators.ordered import join_same, running, with_ntile
from wardwise.session import materialise

UNITS = float(2**50)


#: Up to this many rows, a sample is merged in one task. Beyond it, BINS counts of the noise tell where the sample ends.
MERGED, BINS = 10_000, 4096


def hash_sample(
    df: DataFrame, n: int, id_cols: Sequence[str], seed: int = 123, by: Sequence[str] = (), noise: Column | None = None, merged: int = MERGED,
) -> DataFrame:
    """n rows (per group, if ``by`` is given), or all when there are fewer: those of the smallest noise, ties by the id.

    A large sample of the whole table is not sorted: the noise is counted in bins, rows of the bins that lie inside are
    filtered, and only the rows of the one bin in which the sample ends are ranked, by range. NULL noise comes first.
    """
    u = noise if noise is not None else hash_noise(seed, *id_cols)
    order = [u, *[F.col(c) for c in id_cols]]
    if not by and n <= merged:
        return df.orderBy(*order).limit(n)
    if not by:
        at = F.floor(F.greatest(F.least(u, F.lit(1.0)), F.lit(0.0)) * F.lit(BINS))
        binned = df.withColumn("_bin", F.when(u.isNull(), -1).otherwise(at).cast("int"))
        last, inside = None, 0
        for b, size in sorted(binned.groupBy("_bin").count().collect()):  # BINS + 2 rows
            if inside + size > n:
                last = b
                break
            inside += size
        if last is None:
            return df
        edge = running(binned.where(F.col("_bin") == last).withColumn("_u", u), ["_u", *id_cols], row_number="_rn")
        return binned.where(F.col("_bin") < last).drop("_bin").unionByName(edge.where(F.col("_rn") <= n - inside).drop("_bin", "_u", "_rn"))
    # The rank limit is applied in every map task before the rows are shuffled.
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def shuffle_within(df: DataFrame, by: Sequence[str], id_col: str, noise: Column, name: str = "position") -> DataFrame:
    """A random order inside each group, as a position from 1."""
    return running(df.withColumn("_u", noise), ["_u", id_col], by, row_number=name).drop("_u")


def first_n_per_group(df: DataFrame, by: Sequence[str], order_by: Sequence[str], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order_by))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def nearest_rows(df: DataFrame, value: str, probes: Sequence[float], id_col: str) -> DataFrame:
    """The row closest to each probe value (ties by id): one aggregate per probe, one pass."""
    best = [
        F.min(F.struct(F.abs(F.col(value) - F.lit(float(p))).alias("distance"), F.col(id_col).alias("id"),
                       F.col(value).alias("value"))).alias(f"p{i}")
        for i, p in enumerate(probes)
    ]
    rows = F.array(*[F.struct(F.lit(float(p)).alias("probe"), F.col(f"p{i}.id").alias(id_col),
                              F.col(f"p{i}.value").alias(value)) for i, p in enumerate(probes)])
    return df.agg(*best).select(F.inline(rows))


def _attach(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group totals beside each row; without keys, the one row of totals as constants."""
    if keys:
        return join_same(df, totals, keys)
    row = totals.select(F.struct(*totals.columns)).scalar()
    return df.withColumn("_row", row).select(*df.columns, "_row.*")


def lay_weights(df: DataFrame, weight: str, id_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` without rows of no weight, with the interval [_start, _end) of each row and its group's _total, as a table.

    Weights become whole units laid end to end (integer arithmetic, so the result does not depend on the
    order of summation). A positive weight is one unit at least.
    """
    keys = list(keys)
    if isinstance(df.schema[weight].dataType, IntegralType):
        units = df.withColumn("_w", F.col(weight).cast("bigint"))
    else:
        sums = df.groupBy(*keys).agg(F.sum(weight).alias("_sum"))
        share = F.bround(F.col(weight) / F.col("_sum") * F.lit(UNITS)).cast("bigint")
        whole = F.when(F.col(weight) > 0, F.greatest(share, F.lit(1)))
        units = _attach(df, sums, keys).withColumn("_w", whole).drop("_sum")
    laid = running(units.where(F.col("_w") > 0), [id_col], keys, sums={"_end": "_w"})
    laid = materialise(laid.withColumn("_start", F.col("_end") - F.col("_w")).drop("_w"), "laid")
    return _attach(laid, laid.groupBy(*keys).agg(F.max("_end").alias("_total")), keys)


def pick_weighted(laid: DataFrame, draws: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The row of ``lay_weights`` that each draw falls on, with probability in proportion to weight.

    ``draws`` has a column ``u`` in [0, 1) and the ``keys``. Starts of rows and places of draws are sorted into one
    line, and a draw falls on the last row that starts at or before it: a running maximum. A row of
    any weight is one row of that line, and its draws spread over as many slices as they fill.
    """
    keys = list(keys)
    own = [c for c in laid.columns if c not in (*keys, "_start", "_end", "_total")]
    other = [c for c in draws.columns if c not in keys]
    totals = laid.groupBy(*keys).agg(F.max("_total").alias("_total"))
    row = F.struct("_start", *own).alias("_row")
    draw = F.struct(*other).alias("_draw")
    points = _attach(draws, totals, keys).select(
        *keys, F.floor(F.col("u") * F.col("_total")).cast("bigint").alias("_at"), F.lit(1).alias("_kind"), draw)
    starts = laid.select(*keys, F.col("_start").alias("_at"), F.lit(0).alias("_kind"), row)
    line = starts.unionByName(points, allowMissingColumns=True)
    found = running(line, ["_at", "_kind"], keys, maxes={"_hit": "_row"}).where("_kind = 1 and _hit is not null")
    return found.select(*keys, *[F.col("_hit").getField(c).alias(c) for c in own], *[F.col("_draw").getField(c).alias(c) for c in other])


def _draws(df: DataFrame, n: int, noise) -> DataFrame:
    return df.sparkSession.range(1, n + 1).withColumnRenamed("id", "draw").withColumn("u", noise(F.col("draw")))


def target_weight(share: str, target: float) -> Column:
    """Weight that falls with the distance of a share from its target."""
    return F.lit(1.0) / (F.abs(F.col(share) - F.lit(float(target))) + F.lit(0.001))


def weighted_bootstrap(
    df: DataFrame, weight: str, until: float, value: str, id_col: str, seed: int = 123, noise=None
) -> DataFrame:
    """Draws with replacement, in order, for as long as their total stays within ``until``.

    The number of draws that is needed is estimated from the weighted mean, and
    doubled while the total falls short.
    """
    noise = noise or (lambda j: hash_noise(seed, j))
    mean = df.agg(F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).first()[0]
    n = int(until / mean * 1.1) + 10
    laid = lay_weights(df, weight, id_col)
    while True:
        total = running(pick_weighted(laid, _draws(df, n, noise)), ["draw"], sums={"cum": value})
        if total.agg(F.max("cum")).first()[0] >= until:
            return total.where(F.col("cum") <= until).drop("u")
        n *= 2


def stratified_bootstrap(
    df: DataFrame, share: str, weight: str, until: float, target: float, id_col: str, seed: int = 123, noise=None
) -> DataFrame:
    """One draw per stratum of the share and round, until the total is reached; soft reweighting."""
    noise = noise or (lambda s, j: hash_noise(seed, s, j))
    tenths = [i * 0.1 for i in range(11)]
    strata = df.withColumn("stratum", cut_index(share, tenths, include_lowest=True))
    sizes = strata.groupBy("stratum").agg((F.sum(F.col(weight) * F.col(weight)) / F.sum(weight)).alias("m"))
    per_round = sizes.agg(F.sum("m")).first()[0]
    rounds = int(until / per_round * 1.1) + 10
    names = F.array(*[F.lit(r.stratum) for r in sizes.where("m > 0").orderBy("stratum").collect()])  # the tenths, at most
    laid = lay_weights(strata, weight, id_col, ["stratum"])
    while True:
        draws = df.sparkSession.range(1, rounds + 1).select(F.explode(names).alias("stratum"), F.col("id").alias("draw"))
        draws = draws.withColumn("u", noise(F.col("stratum"), F.col("draw")))
        picked = pick_weighted(laid, draws, ["stratum"])
        totals = running(picked.groupBy("draw").agg(F.sum(weight).alias("t")), ["draw"], sums={"cum": "t"})
        if totals.agg(F.max("cum")).first()[0] >= until:
            break
        rounds *= 2
    kept = picked.join(totals.where(F.col("cum") - F.col("t") < until).select("draw"), "draw", "left_semi")
    now = kept.agg(F.sum(F.col(share) * F.col(weight)) / F.sum(weight)).first()[0]
    factor = F.lit(0.7 + 0.3 * (target / now))
    return kept.withColumn(f"{share}_adj", clamp(F.col(share) * factor, 0.001, 0.999)).drop("u")


def decile_bootstrap(
    df: DataFrame, value: str, n_target: int, id_col: str, seed: int = 123, noise=None, n: int = 10
) -> DataFrame:
    """Draws with replacement inside each decile of ``value``, in the deciles' proportions."""
    noise = noise or (lambda d, j: hash_noise(seed, d, j))
    tiles = with_ntile(df, [value, id_col], n, "decile")
    numbered = running(tiles, [id_col], ["decile"], row_number="_rn", count="_size")
    sizes = numbered.groupBy("decile").agg(F.max("_size").alias("_size"))
    total = sizes.agg(F.sum("_size").alias("t")).scalar()
    wanted = F.bround(F.lit(n_target) * F.col("_size") / total).cast("bigint")
    parts = sizes.withColumn("_want", wanted).where(F.col("_want") > 0).orderBy("decile").collect()  # n rows at most
    ends = list(accumulate(r._want for r in parts))
    line = df.sparkSession.range(ends[-1] if ends else 0)
    part = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("id")))  # of so many parts the draw is past the end
    first = lambda values: F.get(F.array(*[F.lit(v) for v in values]), part)
    draws = line.select(first([r.decile for r in parts]).alias("decile"), first([r._size for r in parts]).alias("_size"),
                        (F.col("id") - first([0, *ends[:-1]]) + 1).cast("bigint").alias("draw"))
    index = F.floor(noise(F.col("decile"), F.col("draw")) * F.col("_size")).cast("bigint") + 1
    return draws.withColumn("_rn", index).drop("_size").join(numbered.drop("_size"), ["decile", "_rn"]).drop("_rn")


def calibrate(df: DataFrame, share: str, weight: str, target: float, how: str = "additive", tol: float = 0.02) -> DataFrame:
    """Moves all shares toward a weighted mean: half the gap added, or scaled in full.

    Nothing changes when the mean is already within ``tol``.
    """
    mean = df.agg((F.sum(F.col(share) * F.col(weight)) / F.sum(weight)).alias("m")).scalar()
    x, aim = F.col(share), F.lit(float(target))
    moved = {
        "additive": clamp(x + (aim - mean) / 2, 0.001, 0.999),
        "multiplicative": clamp(x * aim / mean, 0.0, 1.0),
    }[how]
    return df.withColumn(share, F.when(F.abs(mean - aim) > tol, moved).otherwise(x))


def rake(
    df: DataFrame, share: str, weight: str, target: float, max_iter: int = 20, tol: float = 0.001,
    bounds: tuple[float, float] = (0.1, 10.0), name: str = "rake_weight",
) -> DataFrame:
    """Row weights that bring a weighted mean to its target by repeated bounded adjustment.

    Each round is one aggregate; the weight stays an expression of the share and of
    the rounds' factors, so nothing is stored between rounds.
    """
    x, w, (lo, hi) = F.col(share), F.lit(1.0), bounds
    for _ in range(max_iter):
        now = df.agg(F.sum(F.col(weight) * x * w) / F.sum(F.col(weight) * w)).first()[0]
        if abs(now - target) < tol:
            break
        step = F.lit(1.0) + F.lit(target / now - 1) * F.abs(x - F.lit(float(target)))
        # Each round names the weight once, so the expression grows by one step only.
        w = F.greatest(F.least(w * step, F.lit(hi)), F.lit(lo))
    return df.withColumn(name, F.when(x.isNotNull(), w))


def diversity_weight(share: str, weight: str) -> Column:
    """Size, raised by the distance of the share from one half."""
    return F.col(weight) * (F.lit(1.0) + F.abs(F.col(share) - F.lit(0.5)))


def rake_sample(
    df: DataFrame, share: str, weight: str, total: float, target: float, id_col: str, seed: int = 123, noise=None, max_iter: int = 20,
    tol: float = 0.001, bounds: tuple[float, float] = (0.1, 10.0),
) -> DataFrame:
    """Rows drawn with some preference for extreme shares, raked to the target share, and drawn again by the raked weights.

    As many draws as bring the sum of ``weight`` to ``total`` at the mean. Every row carries ``draw``, ``first_draw`` (its place in the first sample)
    and ``rake_weight``. ``noise`` takes the number of the sample (1 or 2) and of the draw. The first sample is stored, since the
    raking reads it once a round.
    """
    noise = noise or (lambda sample, j: hash_noise(seed, sample, j))
    n = math.ceil(total / df.agg(F.avg(weight)).first()[0])
    draws = lambda sample: df.sparkSession.range(1, n + 1).select(F.col("id").alias("draw"), noise(F.lit(sample), F.col("id")).alias("u"))
    laid = lay_weights(df.withColumn("_diverse", diversity_weight(share, weight)), "_diverse", id_col)
    first = materialise(pick_weighted(laid, draws(1)).drop("u", "_diverse").withColumnRenamed("draw", "first_draw"), "first")
    raked = rake(first, share, weight, target, max_iter, tol, bounds)
    return pick_weighted(lay_weights(raked, "rake_weight", "first_draw"), draws(2)).drop("u")


#: Draws of a wave for each different value of the noise, beyond which the draws are counted by value before they are placed.
REPEATS = 4


def bootstrap_until(
    df: DataFrame, share: str, weight: str, n: int, target: float, id_col: str, tol: float = 0.02,
    attempts: int = 1000, wave: int = 20, seed: int = 123, noise=None,
) -> DataFrame:
    """Weighted bootstrap samples until one meets the target; the best one if none does.

    The weights are laid out once. Attempts are drawn in waves, a whole wave per job and each twice as long as the one
    before, and judged by one small aggregate; only the winner is drawn again and returned. Draws of equal noise fall on one
    row: where the noise repeats itself, a wave is counted by attempt and noise, and each value of it is placed once for all waves.
    """
    noise = noise or (lambda a, j: hash_noise(seed, a, j))
    spark, best, first, placed = df.sparkSession, None, 1, None

    laid = lay_weights(df, weight, id_col)

    def draws(lo: int, hi: int) -> DataFrame:
        tries = spark.range((hi - lo + 1) * n).select(
            (F.floor(F.col("id") / n) + lo).alias("attempt"), (F.col("id") % n + 1).alias("draw"))
        return tries.withColumn("u", noise(F.col("attempt"), F.col("draw")))

    values = draws(1, min(wave, attempts)).agg(F.approx_count_distinct("u")).first()[0]
    repeats = REPEATS * values < min(wave, attempts) * n
    while first <= attempts:
        last = min(first + wave - 1, attempts)
        if repeats:
            counted = materialise(draws(first, last).groupBy("attempt", "u").agg(F.count(F.lit(1)).alias("_k")), "counted")
            fresh = counted.select("u").distinct()
            fresh = fresh if placed is None else fresh.join(placed, "u", "left_anti")
            if not fresh.isEmpty():
                found = materialise(pick_weighted(laid, fresh).select("u", weight, share), "placed")
                placed = found if placed is None else placed.unionByName(found)
            picked = counted.join(placed, "u")
        else:
            picked = pick_weighted(laid, draws(first, last)).withColumn("_k", F.lit(1))
        mean = F.sum(F.col("_k") * F.col(weight) * F.col(share)) / F.sum(F.col("_k") * F.col(weight))
        scores = picked.groupBy("attempt").agg(F.abs(mean - F.lit(float(target))).alias("off"))
        row = scores.agg(
            F.min(F.when(F.col("off") < tol, F.col("attempt"))).alias("hit"), F.min(F.struct("off", "attempt")).alias("b")
        ).first()
        best = min(filter(None, [best, (row.b.off, row.b.attempt)]))
        if row.hit is not None:
            best = (0.0, row.hit)
            break
        first, wave = last + 1, 2 * wave
    return pick_weighted(laid, draws(best[1], best[1])).drop("u")
