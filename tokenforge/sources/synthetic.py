"""Synthetic arithmetic source (S16): items ``.a+b=c.`` with ``a = i % 10000``,
``b = i*i % 10000``, ``c = a + b`` for ``i`` in ``0..n-1``.

Not registered as a query (it reads no table); used by tests and for smoke runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dummy_arithmetic(spark: SparkSession, n: int = 100_000) -> DataFrame:
    i = F.col("id")
    a = F.pmod(i, F.lit(10000))
    b = F.pmod(i * i, F.lit(10000))
    return spark.range(n).select(i.alias("i"), F.format_string(".%d+%d=%d.", a, b, a + b).alias("item"))
