"""Expression helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Spark re-evaluates an outer expression every time a higher-order function
    body reads it (and the optimizer may inline a projected column back into
    such a body), so a normaliser read inside ``transform`` would cost O(n)
    per element.  Binding it through a one-element ``transform`` keeps array
    maths linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def micros(ts) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ column
    (NTZ values are read as UTC wall-clock time)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(F.to_utc_timestamp(c.cast("timestamp_ntz").cast("timestamp"), F.current_timezone()))


def filter_computed(df, cond: Column):
    """``df.where(cond)`` for conditions on expensive computed columns.

    A plain filter is pushed below the projection that computes its columns,
    with the expressions inlined, so the whole array pipeline runs twice (or
    more).  Emitting the row through a 0/1-element ``explode`` evaluates the
    projection once and keeps the predicate above it.
    """
    cols = df.columns
    one = F.array(F.struct(*[F.col(c) for c in cols]))
    return df.select(F.explode(F.when(cond, one).otherwise(F.array())).alias("_fc_r")).select("_fc_r.*")
