"""Prefix trie of conversations, its subtree sums by the Euler-tour technique.

Conversations that begin with the same turns share nodes.  A node is named by a
digest of its whole prefix: digests of turns are joined in blocks of ``BLOCK`` turns,
and the blocks of longer conversations by doubling, so one conversation of any length
is never one row or one task.  Grouping by that name gives the nodes.

Every node has an arc that enters its subtree and one that leaves it.  Linked in the
order of a walk (first child, next sibling, back to the parent) they form one list.
The list is ranked distributedly: each round tosses a coin for every arc, and an arc
with heads after one with tails is spliced out, remembering its distance from the arc
before it; a quarter of the arcs go in a round, and the rounds are undone in reverse
order.  What is left of at most ``TAIL_ARCS`` arcs is walked in one task.  A value is
laid on the entering arcs, summed over the ranks in chunks, and the difference at a
node's two arcs is the sum over its subtree.

Siblings are linked in hash buckets whose number is the square root of the nodes', so
a node with very many children is no single window.  The ids of conversations that end
at one node go through one digest and so through one task in order, as sha256 has
to, but as strings of at most ``2 ** ENDS_BITS`` ids that were joined before.

Defined results: turns are ordered by turn (null first), equal turn numbers by the
digest of role and text; null roles and texts are empty; rows without a conversation
id belong to no conversation; repeated rows are turns of their own; an empty table has
no nodes, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import keyed_index
from ..session import materialize
from .common import bounded, maybe_broadcast, stored

BLOCK = 32                     # turns whose digests one row joins
TAIL_ARCS = 20_000             # arcs that one task walks
CHUNK = 20_000                 # ranks summed up together
ENDS_BITS = 12
ROOT = "root"
SHARED = 20                    # rebuild: conversations with a common beginning
HEADS = 4


def turn_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def name(*parts: Column) -> Column:
    """A short digest of strings, one after the other."""
    return F.base64(F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256)))


def thin_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text") -> DataFrame:
    """(c, i, digest, words) of every turn; i is its place in its conversation."""
    empty = F.lit("")
    r, t = F.coalesce(F.col(f"`{role}`"), empty), F.coalesce(F.col(f"`{text}`"), empty)
    thin = conversations.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("c"), F.col(f"`{turn}`").alias("turn"), turn_digest(r, t).alias("digest"),
        words(t).alias("words"))
    thin = stored(thin.withColumn("rid", F.monotonically_increasing_id()), "turns")
    return keyed_index(thin, ["c"], ["turn", "digest", "rid"], name="i").select("c", "i", "digest", "words")


def shared_beginnings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations (c, len)) rebuilt: conversation c begins with the first h
    turns of conversation ``c - c % 20``, then come its own after its first h;
    h is crc32(c) modulo 4."""
    h = (F.crc32(F.col("c").cast("string")) % HEADS).cast("long")
    base = F.col("c") - F.col("c") % SHARED
    turns = stored(turns, "turns")
    convs = turns.groupBy("c").agg(F.count("*").alias("n"))
    bases, small = bounded(convs.where(F.col("c") % SHARED == 0).select(F.col("c").alias("base"), F.col("n").alias("nb")))
    take = F.least(F.col("h"), F.coalesce(F.col("nb"), F.lit(0)))
    bases = maybe_broadcast(bases, small)
    convs = convs.select("c", "n", h.alias("h"), base.alias("base")).join(bases, "base", "left") \
        .select("c", "base", "h", (take + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    convs = materialize(convs)
    own = turns.withColumn("h", h).where("i >= h").withColumn("base", base).join(bases, "base", "left") \
        .select("c", (take + F.col("i") - F.col("h")).alias("pos"), "digest", "words")
    heads = turns.where((F.col("c") % SHARED == 0) & (F.col("i") < HEADS)).withColumnRenamed("c", "base")
    lent = convs.select("c", "base", "h").join(heads, "base").where("i < h") \
        .select("c", F.col("i").alias("pos"), "digest", "words")
    return own.unionByName(lent), convs.select("c", "len")


def members(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(c, d, s, p, words): conversation c is a member of node s at depth d, whose parent
    is p."""
    blk = F.expr(f"pos div {block}")
    w = Window.partitionBy("c", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sofar = F.collect_list(F.base64("digest")).over(w)
    rows = turns.withColumn("blk", blk).withColumn("l", sofar).select(
        "c", "pos", "blk", "words", name(F.array_join("l", "")).alias("s"),
        F.when(F.col("pos") % block > 0, name(F.array_join(F.expr("slice(l, 1, size(l) - 1)"), ""))).alias("p"))
    rows = stored(rows, "members")
    last = rows.agg(F.max("blk")).first()[0] or 0
    if last:
        # the blocks of a conversation, joined by doubling: prefix(b) names blocks 0 .. b
        ends = materialize(rows.where(F.col("pos") % block == block - 1).select("c", "blk", F.col("s").alias("t")))
        k = 1
        while k < last:
            before = ends.select("c", (F.col("blk") + k).alias("blk"), F.col("t").alias("u"))
            ends = materialize(ends.join(before, ["c", "blk"], "left").select(
                "c", "blk", F.when(F.col("u").isNull(), F.col("t")).otherwise(name(F.col("u"), F.col("t"))).alias("t")))
            k *= 2
        before = ends.select("c", (F.col("blk") + 1).alias("blk"), F.col("t").alias("u"))
        own = ends.select("c", "blk", F.col("t").alias("v"))
        long = rows.where("blk > 0").join(before, ["c", "blk"], "left").join(own, ["c", "blk"], "left")
        long = long.select("c", "pos", "blk", "words",
                           F.when(F.col("pos") % block == block - 1, F.col("v")).otherwise(name(F.col("u"), F.col("s"))).alias("s"),
                           F.when(F.col("pos") % block == 0, F.col("u")).otherwise(name(F.col("u"), F.col("p"))).alias("p"))
        rows = stored(rows.where("blk = 0").unionByName(long), "members")
    return rows.select("c", (F.col("pos") + 1).alias("d"), "s", F.coalesce("p", F.lit(ROOT)).alias("p"), "words")


# ------------------------------------------------------------------ the tour
def tour(nodes: DataFrame, kids: DataFrame, buckets: int) -> DataFrame:
    """The arcs (id, next): ``2 * nid`` enters a node, ``2 * nid + 1`` leaves it.

    ``kids`` has (nid, pnid) of every node but the root."""
    w = Window.partitionBy("pnid", "b").orderBy("nid")
    sib = kids.withColumn("b", F.pmod(F.xxhash64("nid"), F.lit(buckets)))
    sib = materialize(sib.select("pnid", "b", "nid", F.lead("nid").over(w).alias("nxt"), F.row_number().over(w).alias("rn")))
    w = Window.partitionBy("pnid").orderBy("b")
    heads = materialize(sib.where("rn = 1").select("pnid", "b", "nid", F.lead("nid").over(w).alias("over"),
                                                   (F.row_number().over(w) == 1).alias("first")))
    ends = sib.where("nxt IS NULL").drop("nxt").join(heads.select("pnid", "b", F.col("over").alias("nxt")), ["pnid", "b"])
    linked = sib.where("nxt IS NOT NULL").select("nid", "pnid", "nxt").unionByName(ends.select("nid", "pnid", "nxt"))
    out = linked.select((F.col("nid") * 2 + 1).alias("id"),
                        F.coalesce(F.col("nxt") * 2, F.col("pnid") * 2 + 1).alias("next"))
    down = nodes.select("nid").join(heads.where("first").select(F.col("pnid").alias("nid"), F.col("nid").alias("child")),
                                    "nid", "left")
    into = down.select((F.col("nid") * 2).alias("id"), F.coalesce(F.col("child") * 2, F.col("nid") * 2 + 1).alias("next"))
    return out.unionByName(into)


def _walk(head: int):
    """Ranks of a short list (id, next, w), from its head on."""
    def run(parts):
        frames = list(parts)
        if not frames:
            return
        rows = pd.concat(frames)
        next_of = dict(zip(rows["id"].tolist(), zip(rows["next"].fillna(-1).astype("int64").tolist(), rows["w"].tolist())))
        ids, ranks, at, rank = [], [], head, 0
        while at in next_of:
            ids.append(at)
            ranks.append(rank)
            at, step = next_of[at]
            rank += step
        yield pd.DataFrame({"id": np.asarray(ids, np.int64), "rank": np.asarray(ranks, np.int64)})
    return run


def list_rank(arcs: DataFrame, head: int, tail: int = TAIL_ARCS) -> DataFrame:
    """(id, rank) of the linked list (id, next) that begins with ``head``."""
    live = stored(arcs.select("id", "next", F.lit(1).cast("long").alias("w")), "arcs")
    rounds = []
    while live.count() > tail:
        k = len(rounds)
        heads = lambda c: F.xxhash64(c, F.lit(k)) % 2 == 0                       # noqa: E731
        splice = ~heads("id") & F.col("next").isNotNull() & heads("next")
        before = live.where(splice).select(F.col("id").alias("pid"), F.col("next").alias("id"), F.col("w").alias("pw"))
        merged = live.where(heads("id")).join(before, "id", "left").select("id", "next", "w", "pid", "pw")
        idle = live.where(~heads("id") & ~splice)
        step = stored(merged.unionByName(idle, allowMissingColumns=True), "splice")
        rounds.append(step)
        live = step.where("pid IS NULL").select("id", "next", "w").unionByName(
            step.where("pid IS NOT NULL").select(F.col("pid").alias("id"), "next", (F.col("w") + F.col("pw")).alias("w")))
    ranks = stored(live.repartition(1).mapInPandas(_walk(head), "id long, rank long"), "ranks")
    for step in reversed(rounds):
        gone = step.where("pid IS NOT NULL").select("id", "pid", "pw")
        back = gone.join(ranks.withColumnRenamed("id", "pid"), "pid").select("id", (F.col("rank") + F.col("pw")).alias("rank"))
        ranks = stored(ranks.unionByName(back), "ranks")
    return ranks


def subtree_sums(ranks: DataFrame, values: DataFrame, cols: list[str]) -> DataFrame:
    """(nid, cols): every value of ``values`` (nid, cols) summed over the node's subtree."""
    arcs = ranks.select(F.shiftright("id", 1).alias("nid"), (F.col("id") % 2 == 0).alias("enter"), "rank") \
        .join(values, "nid").select("nid", "enter", "rank", *[F.when(F.col("enter"), F.col(c)).otherwise(0).alias(c) for c in cols])
    arcs = stored(arcs.withColumn("chunk", F.expr(f"rank div {CHUNK}")), "laid")
    totals = arcs.groupBy("chunk").agg(*[F.sum(c).alias(f"t_{c}") for c in cols])
    w = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)      # one row a chunk
    offs, small = bounded(totals.select("chunk", *[F.coalesce(F.sum(f"t_{c}").over(w), F.lit(0)).alias(f"o_{c}") for c in cols]))
    w = Window.partitionBy("chunk").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    # up to and with the leaving arc, less all before the entering one
    upto = arcs.select("nid", "enter", "chunk", *cols, *[F.sum(c).over(w).alias(f"s_{c}") for c in cols]) \
        .join(maybe_broadcast(offs, small), "chunk")
    at = [F.when(F.col("enter"), F.col(c) - F.col(f"s_{c}") - F.col(f"o_{c}"))
          .otherwise(F.col(f"s_{c}") + F.col(f"o_{c}")).alias(c) for c in cols]
    return upto.select("nid", *at).groupBy("nid").agg(*[F.sum(c).alias(c) for c in cols])


def _sha_of_runs(parts):
    """One row (s, ends_sha256) for every run of rows (s, text): their texts joined by commas."""
    last, sha = None, None
    for pdf in parts:
        out = []
        for s, text in zip(pdf["s"], pdf["text"]):
            if s != last:
                if last is not None:
                    out.append((last, sha.hexdigest()))
                last, sha = s, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(text.encode())
        yield pd.DataFrame(out, columns=["s", "ends_sha256"])
    if last is not None:
        yield pd.DataFrame([(last, sha.hexdigest())], columns=["s", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(s, ends_sha256) from the node s where each conversation c ends."""
    runs = ends.groupBy("s", F.shiftright("c", ENDS_BITS).alias("run")).agg(F.sort_array(F.collect_list("c")).alias("ids"))
    runs = runs.select("s", "run", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("text"))
    return runs.repartition("s").sortWithinPartitions("s", "run").select("s", "text") \
        .mapInPandas(_sha_of_runs, "s string, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (c, pos, digest, words) of ``convs`` (c, len)."""
    rows = members(turns)
    # a prefix has one parent and one last text, so any member's will do
    nodes = rows.groupBy("d", "s").agg(F.min("p").alias("p"), F.count("*").alias("n"), F.min("c").alias("c"),
                                       F.max("words").alias("words"))
    root = convs.agg(F.lit(0).cast("long").alias("d"), F.lit(ROOT).alias("s"), F.lit(None).cast("string").alias("p"),
                     F.count("*").alias("n"), F.min("c").alias("c"), F.lit(0).cast("long").alias("words")).where("n > 0")
    nodes = stored(nodes.unionByName(root).withColumn("nid", F.monotonically_increasing_id()), "nodes")
    parents = nodes.select(F.col("s").alias("p"), F.col("nid").alias("pnid"), F.col("c").alias("pc"))
    kids = stored(nodes.where("d > 0").select("nid", "p").join(parents, "p").select("nid", "pnid", "pc"), "kids")
    count = nodes.count()
    top = nodes.where("d = 0").select("nid").first()
    arcs = tour(nodes, kids, int(count ** 0.5) + 1)
    ranks = list_rank(arcs.unionByName(nodes.where("d = 0").select((F.col("nid") * 2 + 1).alias("id"),
                                                                   F.lit(None).cast("long").alias("next"))),
                      2 * top[0] if top else 0)
    known = nodes.join(kids.groupBy(F.col("pnid").alias("nid")).agg(F.count("*").alias("n_children")), "nid", "left") \
        .join(kids.select("nid", F.col("pc").alias("parent")), "nid", "left") \
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = stored(known, "known")
    values = known.select("nid", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                          ((F.col("n") - 1) * F.col("words")).alias("saved_tokens"))
    sums = subtree_sums(ranks, values, ["n_leaves", "saved_tokens"])
    ends = rows.groupBy("c").agg(F.max_by("s", "d").alias("s")) \
        .unionByName(convs.where("len = 0").select("c", F.lit(ROOT).alias("s")))
    none = hashlib.sha256(b"").hexdigest()
    return known.join(sums, "nid").join(ends_digest(ends), "s", "left").select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
