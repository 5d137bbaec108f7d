"""TTL cache against a plain walk, at every block size, null keys included."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenforge.operators.dedup import block_steps, ttl_cache_hits


def _walk(rows, ttl):
    """{id: cached} by walking the requests in order."""
    until, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        out[i] = k in until and t < until[k]
        if not out[i]:
            until[k] = t + ttl
    return out


@pytest.mark.parametrize("block", [2, 17, 100_000])
def test_equals_a_walk(spark, block):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([None, "a", "a", "b"]), rnd.randint(0, 900)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, t long")
    got = {r["id"]: r["cached"] for r in ttl_cache_hits(df, "k", F.col("t"), "id", 40, block=block).collect()}
    assert got == _walk(rows, 40)


def test_null_keys_and_times(spark):
    rows = [(0, None, 0), (1, None, 10), (2, None, 500), (3, "a", 0), (4, "a", 10), (5, "a", 500), (6, "a", None)]
    df = spark.createDataFrame(rows, "id long, k string, t long")
    got = {r["id"]: r["cached"] for r in ttl_cache_hits(df, "k", F.col("t"), "id", 300).collect()}
    assert got == {0: False, 1: True, 2: False, 3: False, 4: True, 5: False, 6: False}


def test_block_steps():
    t = np.array([0, 5, 10, 20, 100])
    upto, last = block_steps(t, 10)
    for e in range(-3, 101):
        j, want = int(np.searchsorted(t, e)), None
        while j < len(t):
            want = t[j]
            j = int(np.searchsorted(t, t[j] + 10))
        i = int(np.searchsorted(upto, e))
        assert (last[i] if i < len(upto) else None) == want
