"""Merkle manifest of a dataset: one tree a partition, one tree over their roots.

A row is a leaf: the hash of its fields, each with its length, so no two rows
share a leaf by moving a border.  The leaves of a partition (a language) ascend by
id; every ``FANOUT`` consecutive nodes have one parent.  The partitions' roots are
the leaves of the top tree, whose root names the whole dataset.

Slot pivot: one aggregation a level.  A node's index gives its parent
(``i div FANOUT``) and its slot (``i % FANOUT``); conditional aggregates spread a
parent's children over the columns ``c0 .. c7``.  All columns joined and hashed are
the parent, all but the own one are the siblings.  Rows carry their id and their
changed leaf through the lowest pivot, so that the siblings meet their rows without
another join; the path above a node travels down from the root, one join of a
level's parents with the level above, an eighth of the rows each time.

Groups have at most ``FANOUT`` rows by construction, and places within a
partition come from the library's chunked index, so a partition that holds most of
the rows is no single task.  Every level is written to the checkpoint folder once.

Defined results: a null field is hashed as ``-``; null ids come first; rows with
equal ids are ordered by their leaf, fully equal rows get places of their own; a
null partition value is a partition; an empty table has no rows and no root; other
columns are neither read nor hashed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import keyed_index
from ..session import materialize
from .common import lower_ascii

FANOUT = 8
PLACE_ROWS = 25_000            # rows that one task puts in order
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SLOTS = range(FANOUT)
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """Hash of a row: each field's UTF-8 byte count, ``:`` and value, or ``-``."""
    said = []
    for c in fields:
        s = c.cast("string")
        said.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return digest(*said)


def partition_key(col: Column) -> Column:
    """A string that is never null and sorts as the value does, null first."""
    return F.coalesce(F.concat(F.lit("v"), col.cast("string")), F.lit("n"))


def _pivot(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """(k, i, n, h, c0 .. c7) of the parents of nodes (k, i, n, h); n is the number of
    nodes in the partition's level.  ``carried`` columns are spread likewise."""
    slot = F.col("i") % FANOUT
    spread = [F.max(F.when(slot == s, F.col(c))).alias(f"{p}{s}")
              for c, p in [("h", "c"), *((c, f"{c}_") for c in carried)] for s in SLOTS]
    out = nodes.groupBy("k", F.expr(f"i div {FANOUT}").alias("up"), "n").agg(*spread)
    absent = F.lit("")
    return out.withColumn("h", digest(*[F.coalesce(F.col(f"c{s}"), absent) for s in SLOTS])) \
        .withColumn("n", F.ceil(F.col("n") / FANOUT).cast("long")).withColumnRenamed("up", "i")


def _levels(nodes: DataFrame, carried: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """(pivots from the lowest level up, the last node (k, h, depth) of every partition)."""
    pivots, tops, depth = [], [], 0
    level = nodes
    while True:
        tops.append(level.where("n = 1").select("k", "h", F.lit(depth).alias("depth")))
        rest = level.where("n > 1")
        if rest.isEmpty():
            break
        level = materialize(_pivot(rest, carried if not pivots else ()))
        pivots.append(level)
        depth += 1
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return pivots, materialize(out)


def _siblings(own: int) -> Column:
    """The children of a pivot row to the left and to the right of a slot."""
    def side(slots):
        cols = [F.coalesce(F.col(f"c{s}"), F.lit("")) for s in slots]
        return F.concat(*cols) if cols else F.lit("")
    return F.struct(side(range(own)).alias("left"), side(range(own + 1, FANOUT)).alias("right"))


def _children(pivot: DataFrame, path: Column, keep: Sequence[Column], carried: Sequence[str] = ()) -> DataFrame:
    """The children of pivot rows: (keep, i, h, path, carried), the path one level
    longer at its lower end."""
    slots = [F.struct(F.lit(s).alias("s"), F.col(f"c{s}").alias("h"), _siblings(s).alias("sib"),
                      *[F.col(f"{c}_{s}").alias(c) for c in carried]) for s in SLOTS]
    rows = pivot.select(*keep, "i", path.alias("up"), F.explode(F.array(*slots)).alias("x")).where("x.h IS NOT NULL")
    return rows.select(*[c for c in rows.columns if c not in ("i", "up", "x")],
                       (F.col("i") * FANOUT + F.col("x.s")).alias("i"), F.col("x.h").alias("h"),
                       F.concat(F.array("x.sib"), F.col("up")).alias("path"), *[F.col(f"x.{c}") for c in carried])


def _paths(pivots: list[DataFrame], tops: DataFrame, extra: Sequence[str],
           carried: Sequence[str] = ()) -> DataFrame | None:
    """(k, i, h, path, extra, carried) of the nodes of the lowest level, from ``tops``
    (k, depth, path, extra).  None where no partition has two nodes."""
    keep = [F.col("k"), *[F.col(c) for c in extra]]
    found = None                                     # (k, i, path, extra) of the level above
    for depth in range(len(pivots), 0, -1):
        roots = tops.where(F.col("depth") == depth).select("k", F.lit(0).cast("long").alias("i"), "path", *extra)
        above = roots if found is None else roots.unionByName(found.select("k", "i", "path", *extra))
        joined = pivots[depth - 1].drop("h").join(above, ["k", "i"])
        found = _children(joined, F.col("path"), keep, carried if depth == 1 else ())
        if depth > 1:
            found = materialize(found.drop("h"))
    return found


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, level by level, give."""
    return F.aggregate(path, start, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, by: str = "lang", order: str = "doc_id",
             tampered: Callable[[], tuple[Column, Sequence[Column]]] | None = None) -> DataFrame:
    """Per row: its id, leaf, subroot, root, proof (the siblings' hash), and the root
    folded from its leaf and the siblings.

    ``tampered()`` gives (which rows are changed, their changed fields); the fold of
    such a row starts from the changed leaf, so ``verified`` tells whether the
    manifest noticed."""
    plain = [F.col(f"`{c}`") for c in fields]
    changed, other = tampered() if tampered else (F.lit(False), plain)
    rows = docs.select(partition_key(F.col(f"`{by}`")).alias("k"), F.col(f"`{order}`").alias("id_"),
                       leaf(plain).alias("h"), F.when(changed, leaf(other)).alias("alt"))
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    counts = materialize(counts)
    placed = keyed_index(rows, ["k"], ["id_", "h", "rid"], name="i", rows_per_chunk=PLACE_ROWS).drop("rid")
    placed = materialize(placed.join(counts, "k"))

    carried = ["id_", "alt"]
    pivots, tops = _levels(placed, carried)
    # the top tree: its leaves are the partitions' roots, ordered by partition
    over = keyed_index(tops.select(F.lit("").alias("k"), F.col("k").alias("part"), "h"), ["k"], ["part"], name="i")
    over = materialize(over.withColumn("n", F.lit(tops.count()).cast("long")))
    top_pivots, top = _levels(over, ["part"])
    root = top.select("k", "depth", F.col("h").alias("root"), F.array().cast(PATH).alias("path"))
    above = _paths(top_pivots, root, ["root"], ["part"])
    if above is None:                                # one partition: its root is the root
        above = over.select("part", F.col("h").alias("root"), F.array().cast(PATH).alias("path"))
    tops = materialize(tops.join(above.select(F.col("part").alias("k"), "path", "root"), "k")
                       .withColumnRenamed("h", "subroot"))

    extra = ["subroot", "root"]
    deep = _paths(pivots, tops, extra, carried)
    # a lone leaf is its partition's root
    lone = placed.where("n = 1").join(tops, "k").select("k", "i", "h", "path", *extra, *carried)
    out = lone if deep is None else lone.unionByName(deep.select(*lone.columns))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "").cast("binary"), 256)
    return out.select(F.col("id_").alias(order), F.col("h").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"),
                      fold(F.coalesce("alt", "h"), F.col("path")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered_every_third() -> tuple[Column, Sequence[Column]]:
    """Where 3 divides the crc32 of the id as text, the text has lost its capitals."""
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return changed, [lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
