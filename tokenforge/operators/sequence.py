"""Ordered-sequence operators on row-form series.

A series is ``(key, order..., value)``: a training run's step log, a
session's messages, a request stream.  Steps are numbered with the skew-safe
:func:`..operators.ordered.keyed_index`; running aggregates use
:func:`keyed_scan`; lags run in blocks of steps with a halo.  Recurrences
that are not sums (gated sums, running logsumexp) run per block of a bounded
number of steps in one ``mapInArrow`` pass over hash-partitioned, sorted
``(key, block)`` segments; the blocks' ends are a series of the same kind, so
the operator calls itself on them.  No key ever lands in one task, and rows of
a null key form a group like any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.core import micros
from ..session import materialize
from .ordered import _join_small, keyed_index, keyed_scan, lag_by_index, lags_by_index

BLOCK = 65_536


def number_steps(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk_value: Column,
                 step: str = "step") -> DataFrame:
    """0-based step number per key in ``order`` (X1 per key)."""
    return keyed_index(df, list(keys), list(order), chunk_value, step)


def with_lags(df: DataFrame, keys: Sequence[str], step: str, col: str, ks: Sequence[int],
              fill=None) -> DataFrame:
    """Add ``{col}_lag{k}`` for every k, ``fill`` where there is no predecessor."""
    d = lags_by_index(df, keys, step, [col], ks) if ks else df
    if fill is not None:
        for k in ks:
            d = d.withColumn(f"{col}_lag{k}", F.coalesce(F.col(f"{col}_lag{k}"), F.lit(fill)))
    return d


def throughput(df: DataFrame, keys: Sequence[str], step: str, ts: str, tokens_per_step: int) -> DataFrame:
    """kt/s = tokens_per_step / (t - previous t) / 1000; null for the first
    step and for a zero interval (the reference logs nothing then) (W6, R11)."""
    d = lag_by_index(df, keys, step, [ts], 1)
    dt = (micros(F.col(ts)) - micros(F.col(f"{ts}_lag1"))) / F.lit(1e6)
    return d.withColumn("kt_s", F.when(dt > 0, F.lit(float(tokens_per_step)) / dt / F.lit(1000.0))).drop(f"{ts}_lag1")


def gtokens(step: Column, epoch_begin: int, epoch_steps: int, tokens_per_step: int) -> Column:
    """Cumulative Gtokens of ``real_step = step + epoch_begin * epoch_steps``."""
    real = step + F.lit(epoch_begin * epoch_steps)
    return real * F.lit(tokens_per_step) / F.lit(1e9)


def running_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk_value: Column,
                 value: str, out: str) -> DataFrame:
    """Mean of ``value`` since the start of the key."""
    d = keyed_scan(df, list(keys), list(order), chunk_value, sums={"_rs": F.col(value)}, index_col="_rn")
    return d.withColumn(out, F.col("_rs") / (F.col("_rn") + 1)).drop("_rs", "_rn")


def segment_ids(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk_value: Column,
                is_break: Column, out: str) -> DataFrame:
    """Running count of break rows (inclusive): a break opens a new segment."""
    return keyed_scan(df, list(keys), list(order), chunk_value,
                      sums={out: F.when(is_break, F.lit(1)).otherwise(F.lit(0)).cast("long")}, index_col=None)


def suffix_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk_value: Column,
               value: str, out: str) -> DataFrame:
    """Sum from the row to the end of its key, added up from the end."""
    return keyed_scan(df, list(keys), list(order), chunk_value, sums={out: F.col(value)}, index_col=None,
                      backwards=True)


def chunk_local_cumsum(df: DataFrame, keys: Sequence[str], step: str, value: str, chunk: int,
                       out: str) -> DataFrame:
    """Cumulative sum restarting every ``chunk`` steps (W20); windows hold at
    most ``chunk`` rows."""
    w = (Window.partitionBy(*keys, F.floor(F.col(step) / chunk)).orderBy(step)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out, F.sum(value).over(w))


def causal_conv(df: DataFrame, keys: Sequence[str], step: str, value: str, weights: Sequence[float],
                out: str, mask: Column | None = None) -> DataFrame:
    """``out_t = sum_k w_k * x_{t-k}`` with ``x`` zero before the start and
    where ``mask`` is false (W16)."""
    d = df.withColumn("_x", F.col(value) if mask is None else F.when(mask, F.col(value)).otherwise(F.lit(0.0)))
    ks = [k for k in range(1, len(weights))]
    d = with_lags(d, keys, step, "_x", ks, 0.0)
    expr = F.lit(float(weights[0])) * F.col("_x")
    for k in ks:
        expr = expr + F.lit(float(weights[k])) * F.col(f"_x_lag{k}")
    return d.withColumn(out, expr).drop("_x", *[f"_x_lag{k}" for k in ks])


def lag_delta(df: DataFrame, keys: Sequence[str], step: str, value: str, out: str) -> DataFrame:
    """Token shift: ``lag(x, 1, 0) - x``."""
    d = with_lags(df, keys, step, value, [1], 0.0)
    return d.withColumn(out, F.col(f"{value}_lag1") - F.col(value)).drop(f"{value}_lag1")


# ------------------------------------------------------------------ blocked recurrences
def _starts(batch: pa.RecordBatch, cols: list[str]) -> np.ndarray:
    """Positions where any of ``cols`` differs from the row before; nulls are equal."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for c in cols:
        x = batch.column(batch.schema.get_field_index(c))
        a, b = x.slice(0, n - 1), x.slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _segment_scan(df: DataFrame, keys: list[str], step: str, cols: list[str], outs: list[str],
                  scan) -> DataFrame:
    """``df`` with the columns ``outs`` of ``scan(arrays, state) -> (outputs, state)``
    run over every ``(keys, _blk)`` segment in step order.

    Rows are hash-partitioned by ``(keys, _blk)`` and sorted inside each
    partition, so a segment is contiguous; ``mapInArrow`` walks the batches once,
    hands every other column through untouched and carries the scan state across
    batches (no per-group Python call, no group held in memory).
    """
    seg_cols = [*keys, "_blk"]
    d = df.repartition(*seg_cols).sortWithinPartitions(*seg_cols, step)
    schema = StructType(list(d.schema.fields) + [StructField(n, DoubleType()) for n in outs])

    def part(it):
        last, state = None, None
        for batch in it:
            if not batch.num_rows:
                continue
            at = [batch.schema.get_field_index(c) for c in seg_cols]
            starts = [*_starts(batch, seg_cols), batch.num_rows]
            values = [np.asarray(batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(
                zero_copy_only=False), float) for c in cols]
            got = []
            for a, b in zip(starts[:-1], starts[1:]):
                key = tuple(batch.column(i)[int(a)].as_py() for i in at)
                res, state = scan([v[a:b] for v in values], state if key == last else None)
                last = key
                got.append(res)
            extra = [pa.array(np.concatenate([g[i] for g in got])) for i in range(len(outs))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *outs])
    return d.mapInArrow(part, schema)


def _blocked(df: DataFrame, keys: Sequence[str], step: str, block: int) -> DataFrame:
    return df.withColumn("_blk", F.floor(F.col(step) / max(2, block)).cast("long"))


def _gated_scan(xs: np.ndarray, gs: np.ndarray, sub: int = 512, h0: float = 0.0,
                g0: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """``h_t = exp(g_t) h_{t-1} + x_t`` from ``h = 0`` and the cumulative gate.

    Sub-blocks use the closed form ``h_t = exp(G_t) (h_0 + sum_i x_i exp(-G_i))``
    with ``G`` local to the sub-block; a sub-block whose local gates are too
    large for ``exp`` falls back to the plain loop."""
    n = len(xs)
    hs = np.empty(n)
    gl = g0 + np.cumsum(gs) if n else gs
    h = h0
    for a in range(0, n, sub):
        b = min(n, a + sub)
        G = np.cumsum(gs[a:b])
        if np.all(np.abs(G) < 600):
            vals = np.exp(G) * (h + np.cumsum(xs[a:b] * np.exp(-G)))
        else:
            vals = np.empty(b - a)
            for j in range(a, b):
                h = math.exp(gs[j]) * h + xs[j]
                vals[j - a] = h
        hs[a:b] = vals
        h = float(vals[-1])
    return hs, gl


def _chain(loc: DataFrame, keys: list[str], ends: dict[str, str], step: str, carry) -> DataFrame | None:
    """``loc`` with ``_before``: the recurrence's value at the end of the key's block
    before; None where every key has one block.  ``carry(table)`` runs the
    recurrence over the table of block ends (one row per block)."""
    if (loc.agg(F.max("_blk")).first()[0] or 0) == 0:
        return None
    ends_of = loc.groupBy(*keys, "_blk").agg(*[F.max_by(c, step).alias(n) for n, c in ends.items()])
    done = lags_by_index(carry(materialize(ends_of)), keys, "_blk", ["_end"], [1])
    return _join_small(loc, done.select(*keys, "_blk", F.col("_end_lag1").alias("_before")), [*keys, "_blk"])


def gated_running_sum(df: DataFrame, keys: Sequence[str], step: str, x: str, g: str, out: str,
                      block: int = BLOCK) -> DataFrame:
    """``h_t = exp(g_t) * h_{t-1} + x_t``, ``h_{-1} = 0`` per key.

    Each block of ``block`` steps runs the recurrence from zero (numpy, in a
    sorted-partition scan) and ends in ``(G = sum g, H = h)``.  The block ends obey
    the same recurrence, ``h_b = exp(G_b) * h_{b-1} + H_b``, and every row adds
    ``exp(G_t) * h_{b-1}`` with its block-local cumulative gate ``G_t``.
    """
    keys = list(keys)

    def scan(arrays, state):
        h0, g0 = state if state is not None else (0.0, 0.0)
        hs, gls = _gated_scan(arrays[0], arrays[1], h0=h0, g0=g0)
        return (hs, gls), (float(hs[-1]), float(gls[-1]))

    loc = materialize(_segment_scan(_blocked(df, keys, step, block), keys, step, [x, g], ["_hl", "_gl"], scan))
    r = _chain(loc, keys, {"_H": "_hl", "_G": "_gl"}, step,
               lambda t: gated_running_sum(t.withColumnRenamed("_blk", "_b"), keys, "_b", "_H", "_G", "_end", block)
               .withColumnRenamed("_b", "_blk"))
    if r is None:
        return loc.withColumn(out, F.col("_hl")).drop("_hl", "_gl", "_blk")
    first = F.col("_before").isNull()
    return r.withColumn(out, F.when(first, F.col("_hl")).otherwise(F.col("_hl") + F.exp("_gl") * F.col("_before"))) \
        .drop("_hl", "_gl", "_blk", "_before")


def running_logsumexp(df: DataFrame, keys: Sequence[str], step: str, x: str, out: str,
                      block: int = BLOCK) -> DataFrame:
    """Stable running ``log(sum_{i<=t} exp(x_i))`` per key (W22): block-local
    ``logaddexp.accumulate`` in a sorted-partition scan; the block totals are a series
    of the same kind and are added with ``logaddexp``."""
    keys = list(keys)

    def scan(arrays, state):
        xs = arrays[0]
        acc = np.logaddexp.accumulate(xs if state is None else np.concatenate([[state], xs]))
        acc = acc if state is None else acc[1:]
        return (acc,), float(acc[-1])

    loc = materialize(_segment_scan(_blocked(df, keys, step, block), keys, step, [x], ["_ll"], scan))
    r = _chain(loc, keys, {"_T": "_ll"}, step,
               lambda t: running_logsumexp(t.withColumnRenamed("_blk", "_b"), keys, "_b", "_T", "_end", block)
               .withColumnRenamed("_b", "_blk"))
    if r is None:
        return loc.withColumn(out, F.col("_ll")).drop("_ll", "_blk")
    m = F.greatest("_ll", "_before")
    both = m + F.log(F.exp(F.col("_ll") - m) + F.exp(F.col("_before") - m))
    none = F.col("_before").isNull() | (F.col("_before") == float("-inf"))
    return r.withColumn(out, F.when(none, F.col("_ll")).when(F.col("_ll") == float("-inf"), F.col("_before"))
                        .otherwise(both)).drop("_ll", "_blk", "_before")


# ------------------------------------------------------------------ aggregates over series
def count_windows(indexed: DataFrame, idx: str, size: int) -> Column:
    """Tumbling window id over a 0-based request number."""
    return F.floor(F.col(idx) / size).cast("long")


def append_cache(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: str = "position",
                 size: str = "n_cached") -> DataFrame:
    """Cache that appends (W19): the position of each update in its (session, layer) and
    how many there are."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size))
    return _join_small(keyed_index(df, list(keys), list(order), name=position), n, list(keys))


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  rank: str = "rank") -> DataFrame:
    """Rows ranked ``<= k`` per key (K3).  ``row_number() <= k`` is planned as
    a window-group limit, so every map task keeps only its local top k per key
    before the shuffle: a hot key sends k rows per task, not all of its rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
