"""Series operators: null keys, chunk and block bounds, plans with one scan."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tokenforge.operators import sequence as SQ
from tokenforge.operators.ordered import _CHUNK, assign_chunks, keyed_index, keyed_scan, lags_by_index


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(5)
    rows = [(None if i % 3 == 0 else f"k{i % 2}", i, rnd.random(), -rnd.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, t long, x double, g double")
    return keyed_index(df, ["k"], ["t"], name="step")


def _by_key(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["step"]):
        out.setdefault(r["k"], []).append(r)
    return out


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_recurrences_keep_null_keys_at_every_block(series, block):
    for k, rows in _by_key(SQ.gated_running_sum(series, ["k"], "step", "x", "g", "h", block)).items():
        h = 0.0
        assert len(rows) == {None: 20, "k0": 20, "k1": 20}[k]
        for r in rows:
            h = math.exp(r["g"]) * h + r["x"]
            assert abs(r["h"] - h) < 1e-9
    for k, rows in _by_key(SQ.running_logsumexp(series, ["k"], "step", "x", "l", block)).items():
        total = 0.0
        for r in rows:
            total += math.exp(r["x"])
            assert abs(r["l"] - math.log(total)) < 1e-9


def test_lags_of_null_keys_match_windows(series):
    w = Window.partitionBy("k").orderBy("step")
    want = sorted(map(tuple, series.select("t", F.lag("x", 1).over(w), F.lag("x", 3).over(w)).collect()))
    for block in (3, 5, 1000):
        got = lags_by_index(series, ["k"], "step", ["x"], [1, 3], block)
        assert sorted(map(tuple, got.select("t", "x_lag1", "x_lag3").collect())) == want


def test_one_scan_for_a_convolution(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id div 3 as step", "cast(id as double) as x")
    got = SQ.causal_conv(df, ["k"], "step", "x", [0.4, 0.3, 0.2, 0.1], "y")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and "Join" not in plan


@pytest.mark.parametrize("bound", [2, 100])
def test_outliers_and_ties_stay_within_the_bound(spark, bound):
    n = 100 if bound == 2 else 10_000
    far = spark.range(n).selectExpr("case when id = 0 then 1e300 else id end as v", "id")
    tie = spark.range(n).selectExpr("cast(1 as double) as v", "id")
    for df in (far, tie):
        chunks = assign_chunks(df, [], ["v", "id"], bound).groupBy(_CHUNK).count()
        assert chunks.agg(F.max("count")).first()[0] <= bound
        got = keyed_index(df, [], ["v", "id"], rows_per_chunk=bound)
        want = df.withColumn("want", F.row_number().over(Window.orderBy("v", "id")) - 1)
        assert got.join(want, "id").where("idx <> want").count() == 0


def test_equal_rows_end_the_cutting(spark):
    df = spark.range(300).selectExpr("1 as v")
    got = sorted(r["idx"] for r in keyed_index(df, [], ["v"], rows_per_chunk=10).collect())
    assert got == list(range(300))


def test_backward_scan(series):
    w = Window.partitionBy("k").orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    want = {r["t"]: r["s"] for r in series.select("t", F.sum("x").over(w).alias("s")).collect()}
    for bound in (4, 1000):
        got = keyed_scan(series, ["k"], ["step"], sums={"s": F.col("x")}, index_col=None, rows_per_chunk=bound,
                         backwards=True)
        assert all(abs(r["s"] - want[r["t"]]) < 1e-9 for r in got.collect())
