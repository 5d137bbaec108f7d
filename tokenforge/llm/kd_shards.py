"""Sharding by a k-d tree over metadata, into shards of near-equal bytes.

Units (groups of equal texts, which stay together) are points with metadata
coordinates and their bytes as weight.  A node of the tree is split at the
weighted median along its widest dimension, until its bytes are those of one
leaf; a node of k leaves gives floor(k/2) of them, and as large a share of its
bytes, to its lower side.  A group heavier than ``HEAVY`` of a leaf can't stay
together with sizes near equal: it is dealt to several units by a hash of its rows.

Medians are exact up to ``TOLERANCE`` of a leaf and found in parallel for all
nodes of a level: byte sums over ``BUCKETS`` ranges of the coordinate, then again
inside the range that holds the median, and over a hash of the unit where the
coordinate ties.  Only one row per node reaches the driver.

Defined results: a null text has no bytes and counts as equal to the empty one; a
null coordinate is 0; repeated rows get slots of their own; an empty table gives
an empty result; other columns are neither read nor needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BUCKETS = 2_048
TOLERANCE = 0.002              # of a leaf's bytes, at each median
HEAVY = 1 / 8                  # of a leaf's bytes; a heavier group is dealt out
SLOT_ROWS = 2_000              # rows of a run that is numbered together
TIES = 1 << 62


def text_code(col: Column) -> Column:
    """A long that orders strings by their first seven bytes."""
    digits = F.rpad(F.hex(F.encode(F.coalesce(col, F.lit("")), "utf-8")), 14, "0")
    return F.conv(digits, 16, 10).cast("long")


def default_dimensions() -> dict[str, Column]:
    return {"chars": F.col("n_chars").cast("long"), "source": text_code(F.col("source")),
            "lang": text_code(F.col("lang")), "id": F.col("doc_id").cast("long")}


def _units(thin: DataFrame, dims: list[str], leaf: float) -> tuple[DataFrame, DataFrame]:
    """(rows with their piece, units with weight, coordinates and tie hash)."""
    group = ["h", "crc", "size"]
    heavy = thin.groupBy(*group).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > HEAVY * leaf) \
        .select(*[F.col(c).alias(f"_{c}") for c in group],
                F.ceil(F.col("bytes") / (HEAVY * leaf / 2)).cast("int").alias("_pieces"))
    heavy = materialize(heavy)          # at most 1 / HEAVY rows for each leaf
    on = [F.col(c) == F.col(f"_{c}") for c in group]
    rows = thin.join(F.broadcast(heavy), on, "left") \
        .withColumn("piece", F.coalesce(F.expr("pmod(xxhash64(rid), _pieces)"), F.lit(0)).cast("int")) \
        .drop("_h", "_crc", "_size", "_pieces")
    units = rows.groupBy(*group, "piece").agg(F.sum("size").alias("w"),
                                              F.min(F.struct("id_", "rid", *dims)).alias("c"))
    tie = F.shiftrightunsigned(F.xxhash64(*group, "piece"), 2)
    return rows, units.select(*group, "piece", "w", tie.alias("tie"), *[F.col(f"c.{d}").alias(d) for d in dims])


def _descend(spark, part: DataFrame, nodes: dict[int, dict], slack: float) -> None:
    """Narrow every node's range (a, width buckets) on column x to the bucket that
    holds its target weight; sets cut (lower side: x < cut) or the point to go on
    with by the tie hash."""
    open_ = dict(nodes)
    while open_:
        state = spark.createDataFrame([(k, n["a"], n["b"], n["width"], float(n["target"] - n["before"]))
                                       for k, n in open_.items()], "lo int, a long, b long, width long, want double")
        sums = part.join(F.broadcast(state), "lo").where(F.col("x").between(F.col("a"), F.col("b"))) \
            .groupBy("lo", "a", "width", "want", F.expr("(x - a) div width").alias("k")).agg(F.sum("w").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("lo").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
        found = sums.withColumn("upto", upto).where((F.col("upto") >= F.col("want"))) \
            .groupBy("lo", "a", "width", "want").agg(F.min(F.struct("k", "upto", "w")).alias("m")).collect()
        got = {r["lo"]: r for r in found}
        for k in list(open_):
            n = open_[k]
            if k not in got:                               # rounding: all of it is the lower side
                n["cut"] = n["b"] + 1
                del open_[k]
                continue
            m = got[k]["m"]
            lo = n["a"] + m["k"] * n["width"]
            hi = min(lo + n["width"] - 1, n["b"])
            n["before"] += m["upto"] - m["w"]
            if m["w"] <= slack:
                n["cut"] = lo if n["target"] - n["before"] <= m["w"] / 2 else hi + 1
                del open_[k]
            elif lo == hi:
                n["point"] = lo                            # one value holds the median
                n["after"] = lo if n["target"] - n["before"] <= m["w"] / 2 else lo + 1
                del open_[k]
            else:
                n["a"], n["b"], n["width"] = lo, hi, (hi - lo) // BUCKETS + 1


def kd_tree(units: DataFrame, dims: list[str], shards: int, total: int) -> DataFrame:
    """``units`` with the leaf (0 to shards - 1) of each."""
    spark = units.sparkSession
    slack = TOLERANCE * total / shards
    span = units.agg(*[F.min(d).alias(f"a_{d}") for d in dims], *[F.max(d).alias(f"b_{d}") for d in dims]).first()
    whole = {d: max(1, (span[f"b_{d}"] or 0) - (span[f"a_{d}"] or 0)) for d in dims}
    tree = units.withColumn("lo", F.lit(0)).withColumn("k", F.lit(shards))
    while True:
        stats = tree.where(F.col("k") > 1).groupBy("lo", "k").agg(
            F.sum("w").alias("w"), *[F.min(d).alias(f"a_{d}") for d in dims],
            *[F.max(d).alias(f"b_{d}") for d in dims]).collect()
        if not stats:
            return tree.withColumnRenamed("lo", "shard").drop("k")
        nodes = {}
        for r in stats:
            wide = max(dims, key=lambda d: ((r[f"b_{d}"] - r[f"a_{d}"]) / whole[d], -dims.index(d)))
            a, b = r[f"a_{wide}"], r[f"b_{wide}"]
            nodes[r["lo"]] = {"dim": dims.index(wide), "k": r["k"], "target": r["w"] * (r["k"] // 2) / r["k"],
                              "before": 0, "a": a, "b": b, "width": (b - a) // BUCKETS + 1, "cut": None, "point": None}
        which = spark.createDataFrame([(k, n["dim"]) for k, n in nodes.items()], "lo int, dim int")
        at = F.expr("element_at(array(" + ", ".join(dims) + "), dim + 1)")
        part = tree.join(F.broadcast(which), "lo").select("lo", "w", "tie", at.alias("x"))
        _descend(spark, part, nodes, slack)
        tied = {k: {**n, "a": 0, "b": TIES - 1, "width": (TIES - 1) // BUCKETS + 1, "cut": None}
                for k, n in nodes.items() if n["cut"] is None}
        if tied:
            points = spark.createDataFrame([(k, n["point"]) for k, n in tied.items()], "lo int, p long")
            same = part.join(F.broadcast(points), "lo").where("x = p").select("lo", "w", F.col("tie").alias("x"))
            _descend(spark, same, tied, slack)
        rows = []
        for k, n in nodes.items():
            point = k in tied
            cut, tie = (n["point"], tied[k]["cut"]) if point else (n["cut"], 0)
            if tie is None:                                # a unit goes to the nearer side
                tie = tied[k]["after"]
            rows.append((k, n["k"], n["dim"], cut, tie))
        cuts = spark.createDataFrame(rows, "lo int, k int, dim int, cut long, at long")
        x = F.expr("element_at(array(" + ", ".join(dims) + "), dim + 1)")
        low = (x < F.col("cut")) | ((x == F.col("cut")) & (F.col("tie") < F.col("at")))
        half = F.expr("k div 2").cast("int")
        tree = tree.join(F.broadcast(cuts), ["lo", "k"], "left").withColumn("_low", low) \
            .withColumn("_lo", F.when(F.col("_low").isNull() | F.col("_low"), F.col("lo")).otherwise(F.col("lo") + half)) \
            .withColumn("k", F.when(F.col("_low").isNull(), F.col("k")).when(F.col("_low"), half)
                        .otherwise(F.col("k") - half)) \
            .drop("lo", "dim", "cut", "at", "_low").withColumnRenamed("_lo", "lo")


def kd_shards(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id",
              dimensions: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; a slot is the row's
    place in its shard, gapless from 0."""
    dims = default_dimensions() if dimensions is None else dimensions
    names = [f"x{i}" for i in range(len(dims))]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    thin = docs.select(
        F.col(f"`{doc_id}`").alias("id_"), (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t).alias("crc"), F.xxhash64(t).alias("h"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in zip(names, dims.values())])
    thin = materialize(thin.withColumn("rid", F.monotonically_increasing_id()))
    total, n = thin.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    rows, units = _units(thin, names, max(1, total) / shards)
    leaves = kd_tree(materialize(units), names, shards, max(1, total))
    placed = rows.select("id_", "size", "crc", "h", "piece", "rid") \
        .join(leaves.select("h", "crc", "size", "piece", "shard"), ["h", "crc", "size", "piece"])
    runs = max(1, n // (shards * SLOT_ROWS))
    placed = materialize(placed.select("id_", "size", "crc", "shard", "rid", F.expr(f"pmod(xxhash64(rid), {runs})").alias("run")))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")
    starts = placed.groupBy("shard", "run").agg(F.count("*").alias("n")) \
        .select("shard", "run", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "run").orderBy("id_", "rid"))
    return placed.withColumn("nth", nth).join(starts, ["shard", "run"]) \
        .select(F.col("id_").alias(doc_id), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"),
                (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"))
