"""Skew-safe scans must equal plain windows, including when a hot key is
split into many chunks."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tokenforge.operators.ordered import global_index, keyed_scan, lag_by_index
from tokenforge.operators.token_stream import asof_start, range_lookup


def _data(spark, n=3000, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 20)}"
        rows.append((i, key, rnd.randint(0, 500), float(rnd.randint(-50, 50))))
    return spark.createDataFrame(rows, "id long, key string, t long, v double")


def test_keyed_scan_matches_window_with_many_chunks(spark):
    df = _data(spark)
    got = keyed_scan(df, ["key"], ["t", "id"], F.col("t"), sums={"cs": F.col("v")},
                     maxes={"mx": F.col("v")}, rows_per_chunk=37)
    w = Window.partitionBy("key").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.select("id", (F.row_number().over(w) - 1).alias("idx_e"),
                    F.sum("v").over(w).alias("cs_e"), F.max("v").over(w).alias("mx_e"))
    j = got.join(exp, "id")
    assert j.count() == df.count()
    assert j.where((F.col("idx") != F.col("idx_e")) | (F.col("cs") != F.col("cs_e"))
                   | (F.col("mx") != F.col("mx_e"))).count() == 0


def test_global_index_is_dense_and_ordered(spark):
    df = _data(spark, 1000)
    g = global_index(df, ["t", "id"], F.col("t"), rows_per_chunk=50).collect()
    idx = sorted(r["idx"] for r in g)
    assert idx == list(range(1000))
    by_idx = sorted(g, key=lambda r: r["idx"])
    keys = [(r["t"], r["id"]) for r in by_idx]
    assert keys == sorted(keys)


def test_partition_invariance(spark):
    df = _data(spark, 500)
    a = {r["id"]: r["idx"] for r in global_index(df.repartition(1), ["t", "id"], F.col("t")).collect()}
    b = {r["id"]: r["idx"] for r in global_index(df.repartition(13), ["t", "id"], F.col("t"), rows_per_chunk=11).collect()}
    assert a == b


def test_lag_by_index(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 4.0), ("b", 0, 9.0)],
                               "k string, idx long, v double")
    r = {(x["k"], x["idx"]): x["v_lag1"] for x in lag_by_index(df, ["k"], "idx", ["v"]).collect()}
    assert r == {("a", 0): None, ("a", 1): 1.0, ("a", 2): 2.0, ("b", 0): None}


def test_asof_and_range_lookup(spark):
    starts = spark.createDataFrame([(0,), (10,), (25,)], "s long")
    pts = spark.createDataFrame([(1, 0), (2, 9), (3, 10), (4, 30), (5, -1)], "k long, p long")
    r = {x["k"]: x["c"] for x in asof_start(pts, "k", "p", starts, "s", "c").collect()}
    assert r == {1: 0, 2: 0, 3: 10, 4: 25, 5: None}
    iv = spark.createDataFrame([(0, 10, "a"), (10, 25, "b")], "lo long, hi long, name string")
    got = {x["k"]: x["name"] for x in range_lookup(pts, "k", "p", iv, "lo", "hi").collect()}
    assert got == {1: "a", 2: "a", 3: "b", 4: None, 5: None}


def test_shuffle_fallbacks_when_tables_exceed_the_bound(spark, monkeypatch):
    import tokenforge.operators.ordered as O
    monkeypatch.setattr(O, "BROADCAST_ROWS", 0)
    df = _data(spark, 800)
    got = keyed_scan(df, ["key"], ["t", "id"], F.col("t"), sums={"cs": F.col("v")}, rows_per_chunk=29)
    w = Window.partitionBy("key").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.select("id", (F.row_number().over(w) - 1).alias("idx_e"), F.sum("v").over(w).alias("cs_e"))
    j = got.join(exp, "id")
    assert j.where((F.col("idx") != F.col("idx_e")) | (F.col("cs") != F.col("cs_e"))).count() == 0
    pts = spark.createDataFrame([(1, 0), (2, 9), (3, 10), (4, 30), (5, -1)], "k long, p long")
    iv = spark.createDataFrame([(0, 10, "a"), (10, 25, "b")], "lo long, hi long, name string")
    got = {x["k"]: x["name"] for x in range_lookup(pts, "k", "p", iv, "lo", "hi").collect()}
    assert got == {1: "a", 2: "a", 3: "b", 4: None, 5: None}


def test_null_keys_survive_every_chunk_bound(spark):
    """Rows with a null key are numbered as one group at any bound."""
    rows = [(None if i % 4 == 0 else i % 3, i) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, v long")
    from tokenforge.operators.ordered import keyed_index
    want = sorted(map(tuple, keyed_index(df, ["k"], ["v"], F.col("v"), rows_per_chunk=1000).collect()), key=str)
    for bound in (2, 5, 20):
        got = sorted(map(tuple, keyed_index(df, ["k"], ["v"], F.col("v"), rows_per_chunk=bound).collect()), key=str)
        assert got == want and len(got) == 100


def test_conversations_of_many_turns(spark):
    """The chunk value of stacked turns follows their order for any number of turns."""
    df = spark.range(3000).selectExpr("id div 1500 as conv_id", "id % 1500 as turn", "0 as rank")
    from tokenforge.operators.ordered import keyed_index
    order = ["conv_id", "turn"]
    want = sorted(map(tuple, keyed_index(df, ["rank"], order, F.col("conv_id"), "row").collect()))
    assert sorted(map(tuple, keyed_index(df, ["rank"], order, F.col("conv_id"), "row", 100).collect())) == want


def test_lookup_keeps_null_and_repeated_keys_at_every_bound(spark, monkeypatch):
    import tokenforge.operators.ordered as O
    pts = spark.createDataFrame([(1, 5), (1, 5), (None, 12), (None, 99), (2, None)], "k long, p long")
    iv = spark.createDataFrame([(0, 10, "a"), (10, 25, "b"), (30, 30, "none")], "lo long, hi long, name string")
    want = sorted([(1, 5, "a"), (1, 5, "a"), (None, 12, "b"), (None, 99, None), (2, None, None)], key=str)
    for bound in (2_000_000, 2):
        monkeypatch.setattr(O, "ROWS_PER_CHUNK", bound)
        got = range_lookup(pts, "k", "p", iv, "lo", "hi")
        if bound > 2:                 # when chunked, the one row of the first round's cuts is joined by no key
            assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(((r["k"], r["p"], r["name"]) for r in got.collect()), key=str) == want


def test_manifest_of_many_shards(spark):
    import tempfile
    from tokenforge.operators import token_stream as S
    per = spark.createDataFrame([(f"/data/shard {i:04d}", 100 + i) for i in range(300)], "shard string, tokens long")
    path = tempfile.mkdtemp(prefix="tf-manifest-") + "/m"
    S.write_manifest(S.shard_manifest(per, "shard", "tokens", 64), path)
    rows = sorted((r["cutoff"], r["shard"], r["chunk_count"], r["prev_cutoff"]) for r in S.read_manifest(spark, path).collect())
    total = 0
    for i, (cutoff, shard, n, before) in enumerate(rows):
        assert (shard, n, before) == (f"/data/shard {i:04d}", 36 + i, total)
        total += n
        assert cutoff == total


def test_permutation_of_huge_slots(spark):
    import math
    from tokenforge.operators import token_stream as S
    p = S.largest_magic_prime(10 ** 12)
    assert p % 3 == 2 and all(p % d for d in range(2, math.isqrt(p) + 1))
    f = int(p * ((math.sqrt(5) - 1) / 2))
    ii = [1, 2, 3, 10 ** 6, 10 ** 11 + 7, p - 1, p, p + 1]
    df = spark.createDataFrame([(i,) for i in ii], "ii long")
    got = {r["ii"]: r["s"] for r in df.select("ii", S.cubic_slot(F.col("ii"), p).alias("s")).collect()}
    assert got == {i: f * i ** 3 % p for i in ii}
    many = spark.range(20_000).select(S.cubic_slot(F.col("id"), p).alias("s"))
    assert many.distinct().count() == 20_000
    small = S.largest_magic_prime(5000)
    assert spark.range(small).select(S.cubic_slot(F.col("id"), small).alias("s")).distinct().count() == small
    assert S.is_prime(2) and not S.is_prime(1) and not S.is_prime(3215031751) and S.is_prime(10 ** 12 + 39)


def test_wide_rows_make_smaller_windows(spark, monkeypatch):
    from tokenforge.operators import ordered as O
    d = spark.range(40).select((F.col("id") % 20).alias("k"), F.expr("repeat(cast(id as string), 500)").alias("text"))
    monkeypatch.setattr(O, "WIDE_ROWS", 2)
    monkeypatch.setattr(O, "CHUNK_BYTES", 8_000)
    assert O.rows_within(d, 8_000) < 10 and O.rows_within(d.select("k"), 8_000) == O.ROWS_PER_CHUNK
    seen = []
    chunks = O.assign_chunks
    monkeypatch.setattr(O, "assign_chunks", lambda *a: seen.append(a[3]) or chunks(*a))
    got = [r[0] for r in global_index(d, ["k", "text"]).orderBy("k", "text").select("idx").collect()]
    assert got == list(range(40)) and len(seen) == 1 and seen[0] < 10
