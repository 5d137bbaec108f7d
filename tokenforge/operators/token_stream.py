"""Flat token stream over an ordered document table (T4: sizes, pointers, windows).

A store is a DataFrame ``(doc key, tokens ARRAY<INT>)`` plus an order.  Global
token offsets are an exclusive prefix sum of sizes (:func:`with_offsets`), and a
read of ``length`` tokens from any global position is a join, not a scan:

* the document containing the position is an as-of lookup, done as a running
  max of document starts over the union of starts and request positions
  (:func:`asof_start`), so no interval table is exploded;
* the documents that start inside ``(pos, pos + length)`` are found by an
  equi-join on ``floor(position / length)`` (two buckets per request, at most
  ``length`` non-empty documents per bucket);
* the pieces are put back in order per request (at most ``length + 1``).
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import codepoints
from ..session import materialize, small_table
from .ordered import BROADCAST_ROWS, keyed_scan


TEXT_BLOCK = 4_096            # characters of a text store's rows


@dataclass
class TokenStore:
    """A flat token stream: ``tokens`` (key, tokens) is stored hash-partitioned
    by key, ``offsets`` (key, size, start, ptr, extra columns) is the thin index.

    Position logic (as-of lookups, spans, wrap) runs on ``offsets`` only;
    token slices are fetched at the end by one equi-join of thin piece rows
    with ``tokens``, whose partitioning by key is kept by the checkpoint, so
    the token arrays are not shuffled again.

    With ``block``, ``tokens`` has (key, _blk, text) instead: texts whose tokens are their
    code points, in rows of ``block`` characters, so that a very long document is many
    rows; only the characters of a piece become tokens, when it is fetched."""
    tokens: DataFrame
    offsets: DataFrame
    key: str
    block: int | None = None


def build_text_store(docs: DataFrame, key: str, text: str, order: list[str], extra: list[str] | None = None,
                     block: int = TEXT_BLOCK) -> TokenStore:
    """A store of code points that keeps the texts (S12, W3): sizes are read off the
    texts, nothing is tokenized before it is asked for."""
    extra = list(extra or [])
    size = F.coalesce(F.char_length(text), F.lit(0))
    off = materialize(size_offsets(docs.select(key, *extra, size.alias("size")), F.col("size"), order))
    cut = F.expr(f"regexp_extract_all(`{text}`, '(?s).{{1,{block}}}', 0)")
    rows = materialize(docs.select(key, F.posexplode(cut).alias("_blk", "text")))
    return TokenStore(rows, off, key, block)


def build_store(docs: DataFrame, key: str, tokens: Column, order: list[str], chunk_value: Column,
                extra: list[str] | None = None, dtype_size: int = 4,
                partitions: int | None = None) -> TokenStore:
    """Tokenize once into a stored, key-partitioned token table and index it."""
    extra = list(extra or [])
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tok = materialize(docs.select(key, *extra, tokens.alias("tokens")).repartition(n, key))
    thin = tok.select(key, *extra, F.size("tokens").cast("long").alias("size"))
    off = keyed_scan(thin, [], order, chunk_value, sums={"_end": F.col("size")}, index_col=None)
    off = (off.withColumn("start", (F.col("_end") - F.col("size")).cast("long")).drop("_end")
           .withColumn("ptr", F.col("start") * F.lit(dtype_size)))
    return TokenStore(tok.select(key, "tokens"), materialize(off), key)


def size_offsets(docs: DataFrame, size: Column, order: list[str], dtype_size: int = 4) -> DataFrame:
    """Add ``size``, ``start`` (token offset) and ``ptr`` (byte offset) from a column of
    sizes: the index of a store that isn't written, without a token (W3, W4)."""
    d = docs.withColumn("size", size.cast("long"))
    d = keyed_scan(d, [], order, sums={"_end": F.col("size")}, index_col=None)
    d = d.withColumn("start", (F.col("_end") - F.col("size")).cast("long")).drop("_end")
    return d.withColumn("ptr", F.col("start") * F.lit(dtype_size))


def with_offsets(store: DataFrame, order: list[str], chunk_value: Column,
                 tokens: str = "tokens", dtype_size: int = 4) -> DataFrame:
    """Add ``size``, ``start`` (token offset) and ``ptr`` (byte offset) to a
    table that carries its tokens (W3, W4)."""
    return size_offsets(store, F.size(tokens), order, dtype_size)


def asof_start(points: DataFrame, key: str, pos: str, starts: DataFrame, start: str,
               out: str = "cstart", by: list[str] | None = None) -> DataFrame:
    """``(by..., key, pos, out)``: for each point the greatest ``start <= pos``
    within the same ``by`` group (null if none).

    Starts and points are unioned and ordered by position, starts first on
    ties; a running max of the starts then is the as-of answer.  Ties between
    points do not change the value; their key only lets many be cut into chunks.
    """
    by = list(by or [])
    ktype = points.schema[key].dataType
    p = points.select(*by, F.col(key).alias("_key"), F.col(pos).cast("long").alias("_p"),
                      F.lit(1).alias("_k"), F.lit(None).cast("long").alias("_s"))
    s = starts.select(*by, F.lit(None).cast(ktype).alias("_key"), F.col(start).cast("long").alias("_p"),
                      F.lit(0).alias("_k"), F.col(start).cast("long").alias("_s"))
    r = keyed_scan(p.unionByName(s), by, ["_p", "_k", "_key"], maxes={out: F.col("_s")}, index_col=None)
    return r.where(F.col("_k") == 1).select(*by, F.col("_key").alias(key), F.col("_p").alias(pos), out)


def range_lookup(points: DataFrame, key: str, pos: str, intervals: DataFrame,
                 lo: str, hi: str) -> DataFrame:
    """Attach the interval ``lo <= pos < hi`` (intervals disjoint) to each point.

    Points and interval starts are one table ordered by position; the last interval
    that began, carried along as a struct by the skew-safe scan, is the only one that
    can hold the point.  One path at every size, no join and so no nested loop: points
    keep all their columns, repeated and null keys their rows.  Points in no interval,
    and points without a position, have null interval columns.
    """
    kept = points.columns
    iv = F.struct(F.col(lo).alias("lo"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(intervals.columns)])
    begins = intervals.where(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(lo) < F.col(hi))) \
        .select(F.col(lo).cast("long").alias("_p"), F.lit(0).alias("_k"), F.lit(0).cast("long").alias("_t"), iv.alias("_iv"))
    asked = points.select(F.struct(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(kept)]).alias("_row"),
                          F.col(pos).cast("long").alias("_p"), F.lit(1).alias("_k"),
                          F.xxhash64(F.monotonically_increasing_id()).alias("_t"))
    both = asked.unionByName(begins, allowMissingColumns=True)
    seen = keyed_scan(both, [], ["_p", "_k", "_t"], maxes={"_last": F.col("_iv")}, index_col=None).where("_k = 1")
    at = intervals.columns.index(hi)
    inside = F.col("_p") < F.col(f"_last.c{at}")
    return seen.select(*[F.col(f"_row.p{i}").alias(c) for i, c in enumerate(kept)],
                       *[F.when(inside, F.col(f"_last.c{i}")).alias(c) for i, c in enumerate(intervals.columns)])


def as_store(table: DataFrame, key: str) -> TokenStore:
    """View a table with ``tokens, size, start`` (from :func:`with_offsets`) as a store."""
    return TokenStore(table.select(key, "tokens"), table.drop("tokens"), key)


def _fetch(store: TokenStore, pieces: DataFrame) -> DataFrame:
    """The tokens of thin piece rows ``(_rk, key, _from, _len, _ps)``.  The pieces are
    broadcast to the stored rows where their measured size allows."""
    if store.block is None:
        j = pieces.join(store.tokens, store.key)
        return j.select("_rk", "_ps", F.slice("tokens", (F.col("_from") + 1).cast("int"),
                                              F.col("_len").cast("int")).alias("_piece"))
    size = F.lit(store.block)
    p = pieces.where("_len > 0").withColumn("_blk", F.explode(F.sequence(
        F.expr(f"cast(_from div {store.block} as int)"), F.expr(f"cast((_from + _len - 1) div {store.block} as int)"))))
    begin = F.col("_blk") * size
    p = p.select("_rk", store.key, "_blk", F.greatest(F.col("_from") - begin, F.lit(0)).cast("int").alias("_lo"),
                 F.least(F.col("_from") + F.col("_len") - begin, size).cast("int").alias("_hi"),
                 (F.col("_ps") + F.greatest(begin - F.col("_from"), F.lit(0))).alias("_ps"))
    p, small = small_table(p, BROADCAST_ROWS)
    j = store.tokens.join(F.broadcast(p) if small else p, [store.key, "_blk"])
    some = F.substr("text", F.col("_lo") + 1, F.col("_hi") - F.col("_lo"))
    return j.select("_rk", "_ps", codepoints(some).alias("_piece"))


def _assemble(pieces: DataFrame, length: int | None, out: str) -> DataFrame:
    """Pieces of each request in stream order, cut to ``length`` (at most
    ``length + 1`` pieces per request)."""
    whole = F.flatten(F.transform("_p", lambda x: x["_piece"]))
    return (pieces.groupBy("_rk").agg(F.array_sort(F.collect_list(F.struct("_ps", "_piece"))).alias("_p"))
            .select("_rk", (whole if length is None else F.slice(whole, 1, length)).alias(out)))


def _following(store: TokenStore, req: DataFrame, length: int, at_pos: bool = False) -> DataFrame:
    """Pieces of the documents that start inside ``(_pos, _pos + length)``, with
    ``at_pos`` also of the one that starts at ``_pos``:
    an equi-join on ``floor(position / length)``, two buckets per request and
    at most ``length`` non-empty documents per bucket."""
    w = F.lit(length)
    rb = req.select("_rk", "_pos", F.explode(F.array(F.floor(F.col("_pos") / w),
                                                     F.floor(F.col("_pos") / w) + 1)).alias("_b"))
    db = store.offsets.where(F.col("size") > 0).select(store.key, "start", "size",
                                                       F.floor(F.col("start") / w).alias("_b"))
    first = F.col("start") >= F.col("_pos") if at_pos else F.col("start") > F.col("_pos")
    return (rb.join(db, "_b").where(first & (F.col("start") < F.col("_pos") + w))
            .select("_rk", store.key, F.lit(0).cast("long").alias("_from"),
                    F.least(F.col("size"), F.col("_pos") + w - F.col("start")).alias("_len"),
                    F.col("start").alias("_ps")))


def read_windows(store: TokenStore, requests: DataFrame, req_key: str, pos: str,
                 length: int, out: str = "window") -> DataFrame:
    """Tokens ``[pos, pos + length)`` of the stream for every request.

    Reads past the end of the stream are cut.
    """
    req = requests.select(F.col(req_key).alias("_rk"), F.col(pos).cast("long").alias("_pos"))
    docs = store.offsets.where(F.col("size") > 0).select(store.key, "start", "size")
    # the document that contains pos: as-of on the thin index
    c = asof_start(req, "_rk", "_pos", docs.select("start"), "start", "_cs")
    first = (c.join(docs.withColumnRenamed("start", "_cs"), "_cs")
             .where(F.col("_pos") - F.col("_cs") < F.col("size"))
             .select("_rk", store.key, (F.col("_pos") - F.col("_cs")).alias("_from"),
                     F.least(F.col("size") - (F.col("_pos") - F.col("_cs")), F.lit(length)).alias("_len"),
                     F.col("_pos").alias("_ps")))
    pieces = _fetch(store, first.unionByName(_following(store, req, length)))
    got = _assemble(pieces, length, out).withColumnRenamed("_rk", req_key)
    return requests.join(got, req_key, "left")


def padded(tokens: Column, length: int, pad: int = 0) -> Column:
    """The first ``length`` tokens, with ``pad`` up to ``length``."""
    return F.concat(F.slice(tokens, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(tokens), F.lit(0))))


def store_head(store: TokenStore, length: int) -> list[int]:
    """First ``length`` tokens of the stream (bounded: at most ``length`` ints)."""
    first = (store.offsets.where((F.col("start") < length) & (F.col("size") > 0))
             .select(F.lit(0).alias("_rk"), store.key, F.lit(0).cast("long").alias("_from"),
                     F.least(F.col("size"), F.lit(length) - F.col("start")).alias("_len"),
                     F.col("start").alias("_ps")))
    rows = _assemble(_fetch(store, first), length, "t").collect()
    return list(rows[0]["t"]) if rows else []


def pad_spill(store: TokenStore, length: int, out: str = "tokens", mode: str = "spill", pad: int = 0) -> DataFrame:
    """``pad(idx, length)`` of the reference store (Y19, quirk Q9).

    ``mode='spill'`` reads ``length`` tokens from the item's start, spilling into the
    following items; when that passes the end of the stream, returns the item's own
    tokens followed by the first ``length - size`` tokens of the stream.
    ``mode='pad'`` returns the item's own first ``length`` tokens and pads them.
    Returns ``(key, out, min_len = min(size, length))``.
    """
    key = store.key
    if mode == "pad":
        own = store.offsets.select(F.col(key).alias("_rk"), key, F.lit(0).cast("long").alias("_from"),
                                   F.least("size", F.lit(length)).cast("long").alias("_len"), F.col("start").alias("_ps"))
        got = _assemble(_fetch(store, own), length, "_own").withColumnRenamed("_rk", key)
        return store.offsets.select(key, "size").join(got, key, "left").select(
            key, padded(F.coalesce("_own", F.array().cast("array<int>")), length, pad).alias(out),
            F.least("size", F.lit(length)).alias("min_len"))
    total = store.offsets.agg(F.sum("size")).first()[0] or 0
    head = store_head(store, length)
    off = store.offsets.select(key, "start", "size")
    inside = off.where(F.col("start") + length <= total)
    req = inside.select(F.col(key).alias("_rk"), F.col("start").alias("_pos"))
    # an empty item begins where the next one does, and reads that one's tokens
    spill = _assemble(_fetch(store, _following(store, req, length, at_pos=True)), length, out)
    wrap = off.where(F.col("start") + length > total)
    own = _assemble(_fetch(store, wrap.select(F.col(key).alias("_rk"), key, F.lit(0).cast("long").alias("_from"),
                                              F.col("size").alias("_len"), F.col("start").alias("_ps"))), None, "_own")
    fill = F.from_json(F.lit(json.dumps([int(x) for x in head])), "array<int>")
    wrapped = (wrap.select(F.col(key).alias("_rk"), "size").join(own, "_rk", "left")
               .select("_rk", F.concat(F.coalesce("_own", F.array().cast("array<int>")), F.slice(fill, 1, F.greatest(
                   F.lit(length) - F.col("size"), F.lit(0)).cast("int"))).alias(out)))
    res = spill.unionByName(wrapped).withColumnRenamed("_rk", key)
    return (off.select(key, "size").join(res, key)
            .withColumn("min_len", F.least(F.col("size"), F.lit(length))).drop("size"))


def shard_manifest(per_shard: DataFrame, shard: str, tokens: str, ctx_len: int) -> DataFrame:
    """Manifest ``shard chunk_count cutoff`` (S14): ``chunk_count = tokens - ctx_len``,
    cutoff = running sum in shard-name order, for any number of shards."""
    m = per_shard.select(shard, (F.col(tokens).cast("long") - F.lit(ctx_len)).alias("chunk_count"))
    m = keyed_scan(materialize(m), [], [shard], sums={"cutoff": F.col("chunk_count")}, index_col=None)
    return m.withColumn("prev_cutoff", F.col("cutoff") - F.col("chunk_count"))


def write_manifest(manifest: DataFrame, path: str, shard: str = "shard") -> None:
    """The manifest as text lines ``path chunk_count cumulative_cutoff``."""
    manifest.select(F.concat_ws(" ", F.col(shard), F.col("chunk_count").cast("string"), F.col("cutoff").cast("string"))
                    .alias("value")).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str, shard: str = "shard") -> DataFrame:
    """Scan of a manifest file (S14): ``shard, chunk_count, cutoff, prev_cutoff``.

    The counts are the last two words of a line, so a shard's path may hold blanks; a
    line of another form raises."""
    line = r"^(.*\S) +([0-9]+) +([0-9]+) *$"
    t = spark.read.text(path).where(F.trim("value") != "")
    bad = F.raise_error(F.concat(F.lit("not a manifest line: "), F.col("value")))
    t = t.select(F.when(F.col("value").rlike(line), F.col("value")).otherwise(bad).alias("v"))
    m = t.select(F.regexp_extract("v", line, 1).alias(shard), F.regexp_extract("v", line, 2).cast("long").alias("chunk_count"),
                 F.regexp_extract("v", line, 3).cast("long").alias("cutoff"))
    return m.withColumn("prev_cutoff", F.col("cutoff") - F.col("chunk_count"))


# Witnesses that decide primality of every n below 3.3e24 (fixed values).
WITNESSES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41)


def is_prime(n: int) -> bool:
    """Miller-Rabin with fixed witnesses: exact for all 64-bit numbers."""
    if n < 2:
        return False
    for p in WITNESSES:
        if n % p == 0:
            return n == p
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in WITNESSES:
        x = pow(a, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def largest_magic_prime(slots: int) -> int:
    """Largest prime ``p <= slots`` with ``p % 3 == 2`` and ``p / slots > 0.99`` (R2)."""
    for p in range(slots, 1, -1):
        if p / slots <= 0.99:
            break
        if p % 3 == 2 and is_prime(p):
            return p
    raise ValueError(f"no magic prime for {slots} slots")


def mul_mod(a: Column, b: Column, p: int) -> Column:
    """``a * b mod p`` of non-negative longs below ``p < 10^18``: the product is a
    38-digit decimal, so it never overflows."""
    wide = "decimal(18,0)"
    return F.pmod(a.cast(wide) * b.cast(wide), F.lit(p).cast(wide)).cast("long")


def cubic_slot(ii: Column, p: int) -> Column:
    """``(f * ii^3) mod p`` with ``f = int(p * (sqrt(5) - 1) / 2)``, a permutation of
    ``0 .. p - 1`` as ``p % 3 == 2`` (R2)."""
    f = int(p * ((math.sqrt(5) - 1) / 2))
    a = F.pmod(ii.cast("long"), F.lit(p))
    return mul_mod(mul_mod(mul_mod(a, a, p), a, p), F.lit(f % p), p)


def cubic_position(ii: Column, p: int, ctx_len: int, shift: int = 0, skip: int = 0) -> Column:
    """First token of sample ``ii``: its slot's, moved on by ``shift`` (R2); ``skip`` is
    the number of the first sample that isn't drawn at random."""
    return cubic_slot(ii - F.lit(skip), p) * F.lit(ctx_len) + F.lit(shift)


def hash60(seed: str, key: Column) -> Column:
    """60 bits of ``md5(seed || key)`` as a non-negative long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 15), 16, 10).cast("long")


def pick_records(requests: DataFrame, draw: Column, records: DataFrame, index: str, n: int) -> DataFrame:
    """A record for each request, drawn with replacement (R5): number ``draw mod (n - 1)``
    of the ``n`` records numbered by ``index``.  As in the reference the last record is
    never drawn; a single record always is.  Requests spread over the numbers evenly,
    so the join has no hot key."""
    return requests.withColumn("_pick", F.pmod(draw, F.lit(max(1, n - 1)))) \
        .join(records.withColumnRenamed(index, "_pick"), "_pick").withColumnRenamed("_pick", index)
