"""Length-bucket expressions: one computed column instead of one scan per bucket.

The reference loops over ranges and re-scans the corpus once per range; here a
single expression gives each row its bucket and a single
``write.partitionBy('bucket')`` replaces the loop (SURVEY section 4).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bucket_inclusive(length, lo: int, hi: int, step: int) -> tuple[Column, Column]:
    """Ranges ``[i, min(i+step-1, hi)]`` for ``i in range(lo, hi, step)``.

    Returns ``(bucket_lo, bucket_hi)``; both null when the length is in no
    range (below ``lo``, or at/after the exclusive loop end, quirk Q15).
    """
    n = _c(length)
    k = F.floor((n - F.lit(lo)) / F.lit(step))
    b_lo = F.lit(lo) + k * F.lit(step)
    covered = (n >= F.lit(lo)) & (b_lo < F.lit(hi))
    b_hi = F.least(b_lo + F.lit(step - 1), F.lit(hi))
    covered = covered & (n <= b_hi)
    return (F.when(covered, b_lo).cast("long"), F.when(covered, b_hi).cast("long"))


def bucket_half_open(length, step: int, max_len: int) -> tuple[Column, Column]:
    """Ranges ``(i, i+step]`` for ``i in range(0, max_len, step)``."""
    n = _c(length)
    b_hi = F.ceil(n / F.lit(step)) * F.lit(step)
    ok = (n > 0) & (n <= F.lit(max_len))
    return (F.when(ok, b_hi - F.lit(step)).cast("long"), F.when(ok, b_hi).cast("long"))


def bucket_first_fit(length, step: int, max_len: int, drop_overflow: bool = False) -> Column:
    """First upper bound ``>= length`` from ``step, 2*step, .. < max_len``.

    Lengths above the last bound go to an overflow bucket ``max_len`` by
    default; ``drop_overflow=True`` returns null for them (quirk Q6).
    """
    n = _c(length)
    last = ((max_len - 1) // step) * step
    b = F.greatest(F.ceil(n / F.lit(step)) * F.lit(step), F.lit(step))
    over = F.lit(None) if drop_overflow else F.lit(max_len)
    return F.when(b <= F.lit(last), b).otherwise(over).cast("long")


def in_range(length, lo: int, hi: int) -> Column:
    """``lo <= length <= hi``."""
    n = _c(length)
    return (n >= F.lit(lo)) & (n <= F.lit(hi))
