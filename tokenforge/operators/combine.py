"""Set operations, deterministic splits, interleaving and slicing.

All positional logic goes through :mod:`.ordered`, so no operator here needs a
window without a partition key or a window over one hot source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import _join_small, keyed_index


def md5_order(seed: str, key: Column) -> tuple[Column, Column]:
    """Hash order ``md5(seed || key)`` and a numeric, order-preserving prefix.

    The first 13 hex digits (52 bits) are exact in a double, so the prefix is a
    valid chunk value for :func:`keyed_index`.
    """
    h = F.md5(F.concat(F.lit(seed), key.cast("string")))
    return h, F.conv(F.substring(h, 1, 13), 16, 10).cast("double")


def concat_sources(dfs: Sequence[DataFrame], tag: str | None = None) -> DataFrame:
    """UNION ALL by column name; duplicates kept (U1).  ``tag`` adds the source position."""
    parts = [d.withColumn(tag, F.lit(i)) if tag else d for i, d in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _positions(df: DataFrame, key: str, name: str) -> DataFrame:
    """0-based rank of each distinct ``key`` in ascending order, for any number of them."""
    return keyed_index(materialize(df.select(key).distinct()), [], [key], name=name)


def interleave(df: DataFrame, source: str, order: Sequence[str], chunk_value: Column,
               position: str = "position") -> DataFrame:
    """Round-robin s0[0], s1[0], .., s0[1], ..; stops when the shortest source ends.

    ``position = rn * n_sources + source_pos`` for ``rn < min(count)``.
    """
    src = _positions(df, source, "_src_pos")
    n_sources = src.count()
    counts = df.groupBy(source).count()
    min_count = counts.agg(F.min("count")).first()[0] or 0
    d = keyed_index(df, [source], order, chunk_value, "_rn")
    d = _join_small(d, src, [source])
    return (d.where(F.col("_rn") < F.lit(min_count))
            .withColumn(position, F.col("_rn") * F.lit(n_sources) + F.col("_src_pos"))
            .drop("_rn", "_src_pos"))


def split_exact(df: DataFrame, frac: float, key: str, seed: str,
                by: Sequence[str] = (), side: str = "side") -> DataFrame:
    """Seeded split: per group, the first ``ceil(frac * n)`` rows in
    ``md5(seed || key)`` order (tie by key) are ``validation`` (U3, U4)."""
    h, hnum = md5_order(seed, F.col(key))
    d = df.withColumn("_h", h)
    d = keyed_index(d, list(by), [F.col("_h"), F.col(key)], hnum, "_rn")
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        d = _join_small(d, n, list(by))
    else:
        d = d.withColumn("_n", F.lit(n.first()["_n"]))
    cut = F.ceil(F.lit(frac) * F.col("_n"))
    return (d.withColumn(side, F.when(F.col("_rn") < cut, "validation").otherwise("train"))
            .drop("_h", "_rn", "_n"))


def slice_fraction(df: DataFrame, lo: float, hi: float, by: Sequence[str],
                   order: Sequence[str], chunk_value: Column, idx: str = "idx") -> DataFrame:
    """Rows ``[int(lo*n), int(hi*n))`` of each group in order."""
    d = keyed_index(df, list(by), order, chunk_value, idx)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    d = _join_small(d, n, list(by)) if by else d.withColumn("_n", F.lit(n.first()["_n"]))
    a = F.floor(F.lit(lo) * F.col("_n"))
    b = F.floor(F.lit(hi) * F.col("_n"))
    return d.where((F.col(idx) >= a) & (F.col(idx) < b)).drop("_n")


def round_robin(df: DataFrame, file_col: str, n_workers: int,
                worker: str = "worker") -> DataFrame:
    """File ``i`` (in name order) goes to worker ``i % n``."""
    pos = _positions(df, file_col, "file_idx")
    pos = pos.withColumn(worker, F.pmod(F.col("file_idx"), F.lit(n_workers)))
    return _join_small(df, pos, [file_col])


def epoch_shuffle(df: DataFrame, key: str, seed: str, epochs: Sequence[int],
                  position: str = "position") -> DataFrame:
    """Per-epoch permutation ordered by ``md5(seed || epoch || key)``."""
    e = F.explode(F.array(*[F.lit(int(x)) for x in epochs])).alias("epoch")
    d = df.select("*", e)
    h, hnum = md5_order(seed, F.concat_ws(":", F.col("epoch").cast("string"), F.col(key).cast("string")))
    d = d.withColumn("_h", h)
    return keyed_index(d, ["epoch"], [F.col("_h"), F.col(key)], hnum, position).drop("_h")


def rank_shard(indexed: DataFrame, idx: str, world: int, epoch: int,
               samples_per_epoch: int) -> DataFrame:
    """Global sample number ``1 + epoch*spe + local*world + rank`` where row
    ``idx`` is served by ``rank = idx % world`` as its ``local = idx // world`` (R3)."""
    rank = F.pmod(F.col(idx), F.lit(world))
    local = F.floor(F.col(idx) / F.lit(world))
    return (indexed.withColumn("rank", rank.cast("long"))
            .withColumn("local_idx", local.cast("long"))
            .withColumn("sample_no", (F.lit(1 + epoch * samples_per_epoch)
                                      + F.col("local_idx") * world + F.col("rank")).cast("long")))


def collate(indexed: DataFrame, idx: str, batch_size: int, n_rows: int,
            drop_last: bool = True) -> DataFrame:
    """Batch id and slot from a global index; the last partial batch is dropped."""
    full = n_rows // batch_size if drop_last else math.ceil(n_rows / batch_size)
    b = F.floor(F.col(idx) / F.lit(batch_size)).cast("long")
    return (indexed.withColumn("batch_id", b)
            .withColumn("slot", F.pmod(F.col(idx), F.lit(batch_size)).cast("long"))
            .where(F.col("batch_id") < F.lit(full)))



def zip_rows(a: DataFrame, b: DataFrame, idx: str, left: str, right: str) -> DataFrame:
    """Row k of ``a`` with row k of ``b`` (J1), both numbered by ``idx``.

    As the reference asserts equal shapes (S17), a row without its counterpart or arrays
    of unequal size fail the query instead of vanishing."""
    z = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), idx, "full")
    bad = F.raise_error(F.concat(F.lit("unequal shapes at row "), F.col(idx).cast("string"))).cast("boolean")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.size(left).eqNullSafe(F.size(right))
    return z.where(F.when(same, F.lit(True)).otherwise(bad)).drop("_a", "_b")
