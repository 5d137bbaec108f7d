"""Skew-safe ordered scans: per-key row index, running sums and lags.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to a
single task, and ``Window.orderBy(...)`` without a key sends the whole table to
one task.  When one key (a run, a source, a conversation) may hold a third of
all rows, neither survives 100 TB.  Every ordered operator in this package goes
through :func:`keyed_scan` instead:

1. row counts per key (partial aggregation, so skew does not matter) decide
   whether a window per key is already bounded; where rows hold texts or arrays,
   the bound is as many average rows as make ``CHUNK_BYTES``;
2. otherwise each key above the bound is cut into chunks at sampled quantiles of
   the whole order (a struct of all order columns, so ties of the first column
   are cut too), and every chunk still above the bound is cut again, until none
   is: an outlier or a heavy tie costs one more round, never a big window;
3. window functions run inside ``(key, chunk)`` only;
4. a per-chunk totals table (one row per chunk, so it is small) gets an
   exclusive prefix over the chunks of each key and is joined back on
   ``(key, chunk)`` - an equi-join on a balanced key.

The sample is taken by a hash of the row and the chunk is a pure function of the
row's values and the stored cuts, so a recomputed task (lost executor) lands
every row in the same chunk again.  Rows that are equal in every order column
can't be cut apart; give a unique last order column where rows may repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, BinaryType, StringType

from ..session import small_table

ROWS_PER_CHUNK = 2_000_000
CHUNK_BYTES = 256 << 20        # of the rows in a window
WIDE_ROWS = 1_024              # rows in a window of any width
BROADCAST_ROWS = 2_000_000

FAN = 64                       # most chunks that one round cuts a chunk into
SAMPLE = 16                    # sampled rows for each of them
_STEP = 8                      # cuts between two coarse cuts

_CHUNK = "_tf_chunk"
_ORDER = "_tf_order"
LAG_BLOCK = 65_536             # rows of a lag window


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _join_null_safe(big: DataFrame, small: DataFrame, on: Sequence[str], broadcast: bool,
                    how: str = "inner") -> DataFrame:
    """Join on ``on`` with null keys equal, as they are in groups and windows."""
    right = small.select(*[F.col(f"`{c}`").alias(f"_tf_on_{c}" if c in on else c) for c in small.columns])
    cond = None
    for c in on:
        same = F.col(f"`{c}`").eqNullSafe(F.col(f"`_tf_on_{c}`"))
        cond = same if cond is None else cond & same
    out = big.join(F.broadcast(right) if broadcast else right, cond, how)
    return out.drop(*[f"_tf_on_{c}" for c in on])


def _join_small(big: DataFrame, small: DataFrame, on: list[str],
                how: str = "inner") -> DataFrame:
    """Null-safe join of a derived table, broadcast only when its size is bounded."""
    small, ok = small_table(small, BROADCAST_ROWS)
    return _join_null_safe(big, small, on, ok, how)


def largest_key(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key; of the table where there is no key."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def rows_within(df: DataFrame, limit: int) -> int:
    """Average rows of ``df`` that make ``limit`` bytes, ``ROWS_PER_CHUNK`` at most."""
    fixed, wide = 0, []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            wide.append(F.octet_length(c))
        elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, AtomicType) \
                and not isinstance(f.dataType.elementType, (StringType, BinaryType)):
            wide.append(F.size(c) * 8)
        elif isinstance(f.dataType, AtomicType):
            fixed += 8
        else:
            wide.append(F.octet_length(F.to_json(F.struct(c))))
    if not wide:
        return ROWS_PER_CHUNK
    each = F.lit(fixed).cast("long")
    for c in wide:
        each = each + F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    n, size = df.agg(F.count(F.lit(1)), F.sum(each)).first()
    return max(WIDE_ROWS, min(ROWS_PER_CHUNK, limit * n // max(size or 0, 1)))


def _cuts(d: DataFrame, keys: Sequence[str], rows_per_chunk: int, level: int) -> DataFrame | None:
    """Cuts of every chunk above the bound, ``(keys, chunk, coarse, fine)``; None
    where no chunk can be cut any more.

    About ``FAN * SAMPLE`` rows of a chunk are sampled by a hash of their order
    values, so the arrays stay small however large the chunk is.
    """
    part = [*keys, _CHUNK]
    big = d.groupBy(*part).agg(F.count(F.lit(1)).alias("_tf_n")).where(F.col("_tf_n") > rows_per_chunk)
    big, ok = small_table(big, BROADCAST_ROWS)
    if big.isEmpty():
        return None
    parts = F.least(F.lit(FAN), F.ceil(F.lit(2.0) * F.col("_tf_n") / F.lit(float(rows_per_chunk)))).cast("int")
    draw = F.pmod(F.xxhash64(_ORDER, F.lit(level)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = _join_null_safe(d.select(*part, _ORDER), big, part, ok).withColumn("_tf_f", parts)
    picked = rows.where(draw < F.col("_tf_f") * F.lit(float(SAMPLE)) / F.col("_tf_n"))
    seen = picked.groupBy(*part, "_tf_f").agg(F.sort_array(F.collect_set(_ORDER)).alias("_tf_s"))
    seen = seen.where(F.size("_tf_s") > 1)
    at = F.expr("transform(sequence(1, _tf_f - 1), i -> _tf_s[cast(i * size(_tf_s) div _tf_f as int)])")
    cuts = seen.select(*part, F.array_distinct(at).alias("_tf_fine"))
    coarse = F.expr(f"transform(filter(sequence(0, size(_tf_fine)), i -> i % {_STEP} = {_STEP - 1} "
                    "and i < size(_tf_fine)), i -> _tf_fine[i])")
    return cuts.withColumn("_tf_coarse", coarse)


def assign_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                  rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add ``_tf_chunk``: chunks of at most ``rows_per_chunk`` rows that follow ``order``
    inside each key.  Chunk numbers ascend along the order but aren't gapless."""
    d = df.withColumn(_ORDER, F.struct(*_cols(order))).withColumn(_CHUNK, F.lit(0).cast("long"))
    for level in range(10):                    # FAN ** 10 chunks fill a long
        cuts = _cuts(d, keys, rows_per_chunk, level)
        if cuts is None:
            break
        cuts, ok = small_table(cuts, BROADCAST_ROWS)
        if cuts.isEmpty():                     # rows equal in every order column
            break
        d = _join_null_safe(d, cuts, [*keys, _CHUNK], ok, "left")
        child = F.expr(
            f"{_STEP} * size(filter(_tf_coarse, c -> c <= {_ORDER})) + size(filter(slice(_tf_fine, "
            f"{_STEP} * size(filter(_tf_coarse, c -> c <= {_ORDER})) + 1, {_STEP - 1}), c -> c <= {_ORDER}))")
        d = d.withColumn(_CHUNK, F.col(_CHUNK) * FAN + F.when(F.col("_tf_fine").isNull(), F.lit(0)).otherwise(child)) \
            .drop("_tf_fine", "_tf_coarse")
    return d.drop(_ORDER)


def keyed_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
               chunk_value: Column | None = None, sums: dict[str, Column] | None = None,
               index_col: str | None = "idx",
               rows_per_chunk: int | None = None,
               maxes: dict[str, Column] | None = None, backwards: bool = False) -> DataFrame:
    """Running (inclusive) sums / maxima and a 0-based row index per key.

    ``order`` must be a total order inside each key (add a unique tiebreak).
    ``sums`` / ``maxes`` map an output column name to the expression whose running
    sum / max it receives (nulls are ignored, as in SQL aggregates; a running max
    of a monotone position gives an as-of lookup).  With ``backwards`` everything
    runs from the key's last row to the row.  ``chunk_value`` is not used: chunks
    follow the order itself.

    When no key holds more than ``rows_per_chunk`` rows, a window per key is
    already bounded and runs directly; otherwise keys are cut into chunks as
    described in the module docstring.  Without ``rows_per_chunk`` the width of the
    rows counts too (:func:`rows_within`).
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    most = largest_key(df, keys)
    if rows_per_chunk is None:
        rows_per_chunk = rows_within(df, CHUNK_BYTES) if WIDE_ROWS < most <= ROWS_PER_CHUNK else ROWS_PER_CHUNK

    def window(part, by):
        w = Window.partitionBy(*part).orderBy(*by)
        return w.rowsBetween(0, Window.unboundedFollowing) if backwards else \
            w.rowsBetween(Window.unboundedPreceding, 0)

    if most <= rows_per_chunk:
        d, w = df, window(keys, _cols(order))
        if index_col:
            d = d.withColumn(index_col, (F.count(F.lit(1)).over(w) - 1).cast("long"))
        for name, expr in sums.items():
            d = d.withColumn(name, F.sum(expr).over(w))
        for name, expr in maxes.items():
            d = d.withColumn(name, F.max(expr).over(w))
        return d
    d = assign_chunks(df, keys, order, rows_per_chunk)
    part = [*keys, _CHUNK]
    w = window(part, _cols(order))
    # (output name, kind, per-row value column)
    specs = []
    if index_col:
        d = d.withColumn("_tf_v_idx", F.lit(1).cast("long"))
        specs.append((index_col, "count", "_tf_v_idx"))
    for i, (name, expr) in enumerate(sums.items()):
        d = d.withColumn(f"_tf_vs{i}", expr)
        specs.append((name, "sum", f"_tf_vs{i}"))
    for i, (name, expr) in enumerate(maxes.items()):
        d = d.withColumn(f"_tf_vm{i}", expr)
        specs.append((name, "max", f"_tf_vm{i}"))
    agg = {"count": F.sum, "sum": F.sum, "max": F.max}
    # per-chunk totals -> exclusive prefix over the earlier chunks of the key
    totals = d.groupBy(*part).agg(*[agg[kind](F.col(v)).alias(f"_tf_t{j}")
                                    for j, (_, kind, v) in enumerate(specs)])
    for j, (_, kind, v) in enumerate(specs):
        d = d.withColumn(f"_tf_l{j}", agg[kind](F.col(v)).over(w))
    wc = Window.partitionBy(*keys).orderBy(_CHUNK)
    wc = wc.rowsBetween(1, Window.unboundedFollowing) if backwards else wc.rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(*part, *[
        agg[kind](F.col(f"_tf_t{j}")).over(wc).alias(f"_tf_o{j}")
        for j, (_, kind, _v) in enumerate(specs)])
    d = _join_small(d, offs, part)
    for j, (name, kind, _v) in enumerate(specs):
        local, off = F.col(f"_tf_l{j}"), F.col(f"_tf_o{j}")
        if kind == "count":
            d = d.withColumn(name, (local + F.coalesce(off, F.lit(0)) - 1).cast("long"))
        elif kind == "sum":
            d = d.withColumn(name, F.when(local.isNull() & off.isNull(), F.lit(None))
                             .otherwise(F.coalesce(local, F.lit(0)) + F.coalesce(off, F.lit(0))))
        else:
            d = d.withColumn(name, F.greatest(local, off))
    drop = [c for c in d.columns if c.startswith("_tf_")]
    return d.drop(*drop)


def keyed_index(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                chunk_value: Column | None = None, name: str = "idx",
                rows_per_chunk: int | None = None) -> DataFrame:
    """0-based position of each row inside its key, without a hot window."""
    return keyed_scan(df, keys, order, chunk_value, None, name, rows_per_chunk)


def global_index(df: DataFrame, order: Sequence[str | Column], chunk_value: Column | None = None,
                 name: str = "idx", rows_per_chunk: int | None = None) -> DataFrame:
    """0-based global row number in ``order`` with no single-partition window."""
    return keyed_index(df, [], order, chunk_value, name, rows_per_chunk)


def lags_by_index(df: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str],
                  ks: Sequence[int], block: int = LAG_BLOCK) -> DataFrame:
    """Add ``{col}_lag{k}``: ``col`` of the row ``k`` positions before, per key.

    ``idx`` numbers the rows of a key without gaps, so blocks of ``block``
    positions are of equal size however hot the key is.  The last ``max(ks)`` rows
    of a block are copied to the next one (a halo), and ``lag`` runs inside
    ``(key, block)``: one scan and one shuffle, null keys as in any window.  Rows
    without a predecessor get nulls, like ``lag``.
    """
    reach = max(ks)
    block = max(block, reach)
    at = F.floor(F.col(idx) / F.lit(block))
    edge = F.pmod(F.col(idx), F.lit(block)) >= F.lit(block - reach)
    d = df.withColumn("_tf_home", at).withColumn(
        "_tf_blk", F.explode(F.when(edge, F.array(at, at + 1)).otherwise(F.array(at))))
    w = Window.partitionBy(*keys, "_tf_blk").orderBy(idx)
    for k in ks:
        there = F.lag(idx, k).over(w) == F.col(idx) - k
        for c in cols:
            d = d.withColumn(f"{c}_lag{k}", F.when(there, F.lag(c, k).over(w)))
    return d.where(F.col("_tf_blk") == F.col("_tf_home")).drop("_tf_blk", "_tf_home")


def lag_by_index(df: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str], k: int = 1,
                 suffix: str | None = None) -> DataFrame:
    """:func:`lags_by_index` for one distance, with a suffix of choice."""
    d = lags_by_index(df, keys, idx, cols, [k])
    if suffix and suffix != f"_lag{k}":
        for c in cols:
            d = d.withColumnRenamed(f"{c}_lag{k}", c + suffix)
    return d
