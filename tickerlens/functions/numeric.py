"""Numeric scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def guarded_log_ratio(value: Column | str, prev: Column | str) -> Column:
    """``ln(value / prev)``; NULL when prev is missing or <= 0, or when the
    ratio is not positive.  The guard runs before the division, so ANSI mode
    never sees a division by zero."""
    v, p = _col(value), _col(prev)
    return F.when((p > 0) & (v > 0), F.ln(v / p))


def safe_double(c: Column | str) -> Column:
    """NaN -> NULL, everything else unchanged (as DOUBLE)."""
    x = _col(c).cast("double")
    return F.when(~F.isnan(x), x)


def safe_bigint(c: Column | str) -> Column:
    """F8: truncating BIGINT; NaN, +/-inf, NULL and overflow -> NULL."""
    x = _col(c).cast("double")
    finite = ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(finite, x.try_cast("bigint"))


def round6(c: Column | str) -> Column:
    """Report rounding used when comparing with another engine."""
    return F.round(_col(c), 6)
