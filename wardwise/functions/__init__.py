"""Column builders with the null and tie rules the analysis depends on."""

from wardwise.functions.exprs import (  # noqa: F401
    add_stars,
    big_number,
    clamp,
    cut,
    cut_index,
    euclid,
    fixed,
    hash_noise,
    ifelse,
    indicator,
    inv_logit,
    logit,
    pmax,
    pmin,
    soft_step,
    stars,
    strict_avg,
    strict_sum,
    try_div,
)
