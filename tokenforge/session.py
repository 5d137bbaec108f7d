"""Session and scratch-space helpers.

Lineage is cut with reliable ``checkpoint()`` into the directory named by
``spark.checkpoint.dir``.  On a cluster that setting must point at shared
storage; only a local-mode session without the setting (tests, laptops) gets a
fresh temporary folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "tokenforge") -> SparkSession:
    """Session with the settings every query here assumes (UTC, AQE on)."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the whole cluster
        b = b.config("spark.driver.memory", "16g")
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, setting one only where none is set.

    Order: the SparkContext's directory, then ``spark.checkpoint.dir`` from the
    session conf, then (local master only) a new temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at shared storage")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tokenforge-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the (shared) checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and cuts lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BROADCAST_BYTES = 32 * 1024 * 1024


def row_bytes(df: DataFrame):
    """Upper-bound-ish byte size of a row's values, as a column: string / binary
    lengths, 8 bytes per fixed-width value, JSON length for nested values."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import BinaryType, StringType, ArrayType, MapType, StructType
    total = F.lit(0)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
        else:
            total = total + F.lit(8)
    return total.cast("long")


def approx_bytes(df: DataFrame):
    """Byte size of a table's values, by ``row_bytes``."""
    from pyspark.sql import functions as F
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def small_table(df: DataFrame, limit_rows: int,
                limit_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Checkpoint a derived table and report whether it may be broadcast.

    Both the row count and the byte size are measured on the materialised
    (small) table, so a few wide rows (long texts, arrays) are not broadcast
    either.  Callers broadcast only when the second value is True and fall
    back to a shuffle join otherwise.
    """
    m = materialize(df)
    if m.count() > limit_rows:
        return m, False
    return m, approx_bytes(m) <= limit_bytes
