"""Column builders. All of them stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def try_div(a, b) -> Column:
    """a / b as a double; NULL where b is zero or either side is NULL."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def ifelse(cond: Column, yes, no) -> Column:
    """Two-way choice in which an unknown condition gives NULL, not the other arm."""
    return F.when(cond, _col(yes)).when(~cond, _col(no))


def _all_known(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])


def pmax(*values) -> Column:
    """Row-wise maximum; NULL if any input is NULL."""
    cols = [_col(v) for v in values]
    return F.when(_all_known(cols), F.greatest(*cols))


def pmin(*values) -> Column:
    """Row-wise minimum; NULL if any input is NULL."""
    cols = [_col(v) for v in values]
    return F.when(_all_known(cols), F.least(*cols))


def clamp(x, lo: float, hi: float) -> Column:
    """x held inside [lo, hi]; NULL stays NULL."""
    x = _col(x)
    return F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


def logit(p, eps: float = 1e-6) -> Column:
    p = clamp(p, eps, 1 - eps)
    return F.ln(p / (F.lit(1.0) - p))


def inv_logit(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def soft_step(share, k: float = 60.0, centre: float = 0.5) -> Column:
    """Logistic ramp around ``centre``; k sets how sharp it is."""
    return inv_logit(F.lit(float(k)) * (_col(share) - F.lit(float(centre))))


def euclid(x1, y1, x2, y2) -> Column:
    return F.sqrt(F.pow(_col(x1) - _col(x2), 2) + F.pow(_col(y1) - _col(y2), 2))


def indicator(cond: Column, dtype: str = "bigint") -> Column:
    """1 where true, 0 where false, NULL where unknown."""
    return cond.cast("int").cast(dtype)


def cut_index(
    x, breaks: Sequence[float], right: bool = True, include_lowest: bool = False
) -> Column:
    """1-based interval number of x; NULL outside all intervals.

    ``right=True`` closes intervals on the right, (a, b]; ``right=False`` on the
    left, [a, b). ``include_lowest`` also closes the outermost open end.
    """
    return _by_interval(x, breaks, range(1, len(breaks)), right, include_lowest)


def _by_interval(x, breaks: Sequence[float], values: Sequence, right: bool, include_lowest: bool) -> Column:
    x = _col(x)
    edges = [float(b) for b in breaks]
    last = len(edges) - 1
    out = None
    for i in range(1, len(edges)):
        lo, hi = F.lit(edges[i - 1]), F.lit(edges[i])
        if right:
            inside = ((x >= lo) if include_lowest and i == 1 else (x > lo)) & (x <= hi)
        else:
            inside = (x >= lo) & ((x <= hi) if include_lowest and i == last else (x < hi))
        out = F.when(inside, F.lit(values[i - 1])) if out is None else out.when(inside, F.lit(values[i - 1]))
    return out


def cut(
    x,
    breaks: Sequence[float],
    labels: Sequence | None = None,
    right: bool = True,
    include_lowest: bool = False,
) -> Column:
    """Interval label of x (see ``cut_index``)."""
    if labels is None:
        return cut_index(x, breaks, right, include_lowest)
    if len(labels) != len(breaks) - 1:
        raise ValueError("one label per interval is needed")
    return _by_interval(x, breaks, labels, right, include_lowest)


def stars(p) -> Column:
    """Significance marks: *** under .01, ** under .05, * under .10."""
    p = _col(p)
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def add_stars(estimate, p, digits: int = 3) -> Column:
    return F.concat(fixed(estimate, digits), stars(p))


def fixed(x, digits: int) -> Column:
    """Decimal text with a fixed number of digits, for display only."""
    return F.format_string(f"%.{digits}f", _col(x).cast("double"))


def big_number(x) -> Column:
    """Whole number with thousands separators, for display only."""
    return F.format_number(_col(x), 0)


def hash_noise(seed: int, *keys) -> Column:
    """Repeatable uniform noise in [0, 1) from a seed and the row's keys."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[_col(k) for k in keys]), 11)
    return bits.cast("double") / F.lit(float(2**53))


def strict_avg(x) -> Column:
    """Mean that is NULL as soon as one input is NULL."""
    x = _col(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def strict_sum(x) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    x = _col(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))
