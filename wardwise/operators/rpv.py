"""Racially polarized voting: flags, types, correctness, spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwise.functions import ifelse

MODELS = ("er", "ei")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rpv_flag(minority, majority) -> Column:
    """1 when the groups are on opposite sides of one half, NULL when one is unknown."""
    a, b = _c(minority), _c(majority)
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None))
        .when(((a > 0.5) & (b < 0.5)) | ((a < 0.5) & (b > 0.5)), 1)
        .otherwise(0)
        .cast("bigint")
    )


def rpv_type(minority, majority) -> Column:
    """Which group leans which way: 'Type 1', 'Type 2' or 'None'."""
    a, b = _c(minority), _c(majority)
    return F.when((a > 0.5) & (b < 0.5), "Type 1").when((a < 0.5) & (b > 0.5), "Type 2").otherwise("None")


def rpv_correct_strict(true_min, true_maj, est_min, est_maj) -> Column:
    """1 only when the truth is polarized and the estimate has the same direction."""
    t1, t0, e1, e0 = _c(true_min), _c(true_maj), _c(est_min), _c(est_maj)
    same = ((t1 > 0.5) & (t0 < 0.5) & (e1 > 0.5) & (e0 < 0.5)) | (
        (t1 < 0.5) & (t0 > 0.5) & (e1 < 0.5) & (e0 > 0.5)
    )
    return ifelse(same, 1, 0).cast("bigint")


def rpv_agreement(estimated, true) -> Column:
    """1 when the predicted flag equals the true flag."""
    return (_c(estimated) == _c(true)).cast("int").cast("bigint")


def residual_columns(model: str) -> dict[str, Column]:
    """Estimate minus truth for both groups and for the flag; NULL where unknown."""
    return {
        f"{model}_{g}_resid": F.col(f"{model}_{g}_dem_share") - F.col(f"true_{g}_dem_share")
        for g in ("minority", "majority")
    } | {f"{model}_rpv_error": F.col(f"{model}_rpv") - F.col("true_rpv")}


def correctness_columns(models=MODELS) -> dict[str, Column]:
    return {
        f"{m}_rpv_correct": rpv_correct_strict(
            "true_minority_dem_share", "true_majority_dem_share",
            f"{m}_minority_dem_share", f"{m}_majority_dem_share",
        )
        for m in models
    }


def spread(df: DataFrame) -> DataFrame:
    """Minority minus majority share, true and estimated, with sign flips."""
    gap = lambda m: F.col(f"{m}_minority_dem_share") - F.col(f"{m}_majority_dem_share")
    out = df.withColumns({"true_spread": gap("true"), **{f"{m}_spread": gap(m) for m in MODELS}})
    return out.withColumns({
        f"{m}_sign_flip": (F.signum("true_spread") != F.signum(f"{m}_spread")).cast("int").cast("bigint")
        for m in MODELS
    })


def sign_flips(df: DataFrame, ids: list[str]) -> DataFrame:
    """One row per district and model with its sign flip."""
    return spread(df).select(
        *ids, F.inline(F.array(*[
            F.struct(F.lit(m).alias("model"), F.col(f"{m}_sign_flip").alias("sign_flip")) for m in MODELS
        ])),
    )
