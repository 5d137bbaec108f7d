"""TTL cache semantics in batch (ST2 batch twin, J5, quirk Q11).

A cache entry lives ``ttl`` from its insertion; a hit does not refresh it.
Per key the misses therefore form a chain: the first request, then the first
request at or after ``previous miss + ttl``, and so on.

A key's requests are numbered in order and cut into blocks.  Inside a block the
chain is a walk with binary searches over the times.  What a block does to the chain
depends on one value, the time ``e`` from which the next request misses, and is a step
function of it: ``e`` before a request's time enters the chain there and leaves it at
that chain's last miss.  Chains never cross, so the function has few steps.  The
blocks' functions are composed along the key (one small row a block), which gives
every block its ``e``; one more pass over the rows marks the misses.  A key that fits
in one block needs that pass alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import _join_small, keyed_index, largest_key
from .sequence import BLOCK, _blocked, _segment_scan


def block_steps(t: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """``(upto, last)``: an ``e`` of at most ``upto[i]`` (and above ``upto[i - 1]``) has
    its last miss in the block at time ``last[i]``; an ``e`` above all has none."""
    nxt = np.maximum(np.searchsorted(t, t + ttl), np.arange(len(t)) + 1)
    last = np.arange(len(t))
    jump = nxt
    while (jump < len(t)).any():                  # doubling: follow every chain to its end
        go = np.flatnonzero(jump < len(t))
        last[go] = last[jump[go]]
        jump = np.where(jump < len(t), jump[np.minimum(jump, len(t) - 1)], jump)
    ends = t[last]
    keep = np.append(ends[1:] != ends[:-1], True)
    return t[keep], ends[keep]


def _entries(d: DataFrame, key: str, ttl_us: int) -> DataFrame:
    """``(key, _blk, _e)``: the time from which the next request misses, at each block."""
    kind = d.schema[key].dataType.simpleString()

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["_t"].dropna().to_numpy(np.int64))
        upto, last = block_steps(t, ttl_us)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "_blk": [pdf["_blk"].iloc[0]], "upto": [upto], "last": [last]})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        e, at = None, []
        for upto, last in zip(pdf["upto"], pdf["last"]):
            at.append(e)
            i = 0 if e is None else int(np.searchsorted(upto, e))
            if i < len(upto):
                e = int(last[i]) + ttl_us
        return pd.DataFrame({key: pdf[key].to_numpy(), "_blk": pdf["_blk"].to_numpy(), "_e": pd.array(at, "Int64")})

    rows = d.select(key, "_blk", "_t").groupBy(key, "_blk").applyInPandas(
        steps, f"`{key}` {kind}, _blk long, upto array<long>, last array<long>")
    return rows.groupBy(key).applyInPandas(compose, f"`{key}` {kind}, _blk long, _e long")


def ttl_cache_hits(df: DataFrame, key: str, ts_us: Column, tiebreak: str, ttl_us: int,
                   out: str = "cached", block: int = BLOCK) -> DataFrame:
    """Add ``out``: whether the request is served from a TTL cache that was
    filled by the request that missed (TTL from insertion, not last use).

    Requests at the same instant as a miss are hits (the entry was just
    inserted); the first of them in ``tiebreak`` order is the miss.  Requests of a null
    key share one entry; a request without a time is never served and fills nothing.
    """
    d = df.withColumn("_t", ts_us.cast("long"))
    d = _blocked(keyed_index(d, [key], ["_t", tiebreak], name="_i"), [key], "_i", block)
    if largest_key(df, [key]) > block:
        d = materialize(d)
        d = _join_small(d, _entries(d, key, ttl_us), [key, "_blk"])
    else:
        d = d.withColumn("_e", F.lit(None).cast("long"))

    def scan(arrays, state):
        t, e = arrays[0], state
        if e is None:
            e = -np.inf if np.isnan(arrays[1][0]) else arrays[1][0]
        miss = np.isnan(t).astype(float)
        first = int(miss.sum())                   # requests without a time come first
        t = t[first:]
        j = int(np.searchsorted(t, e))
        while j < len(t):
            miss[first + j] = 1.0
            e = t[j] + ttl_us
            j = max(j + 1, int(np.searchsorted(t, e)))
        return (miss,), e

    r = _segment_scan(d, [key], "_i", ["_t", "_e"], ["_miss"], scan)
    return r.withColumn(out, F.col("_miss") == 0).drop("_t", "_i", "_blk", "_e", "_miss")
