"""Exact n-gram Jaccard join and its components, as a metric-space join.

Documents with equal shingle sets are one class.  The Jaccard distance is a
metric, so classes are joined by regions around pivots:

1. Seed cells.  In one global order of shingles, two sets that reach the
   similarity share a shingle among the first n - ceil(t n) + 1 of either; the
   classes with such a shingle form a cell.  Outside a common cell two classes
   can't link, so every region lies within one.  Frequent shingles come last in the
   order (found on a share of the classes); that only saves work.
2. Cells of up to ``SMALL`` classes give their pairs.  A pair goes on if its count
   of common cells allows the overlap it needs, and is verified on the full sets.
3. Larger cells are split recursively: some classes become pivots and all
   members are measured against them.  Members within the radius of a pivot are
   its ball and are connected through it, so their pairs aren't looked at.  A
   member's Voronoi region is that of its nearest pivot; by the triangle inequality
   a partner of a member at distance d <= 2r of its pivot lies within d + r of it,
   so such boundary members are replicated to the region as guests.  Members
   further than 2r from every pivot form the far region.  Regions go on as cells of
   own, without those whose members are all connected, until few members are
   outside the largest component of a cell; these are measured against its others.

Every step of the recursion measures its pairs of both kinds at once and joins only the
new links to the components so far: the driver keeps something of every job, so jobs are
what its memory grows with.

Sets are measured exactly wherever a link is decided.  Only thin rows (hash pairs)
are shuffled until the candidates are known, and only their sets are moved.

Defined results: A-Z are lower-cased; a document of fewer words than a shingle is
one shingle; without words, empty and linked with nothing, its component is its
own id; equal sets link, whatever their ids; repeated rows and extra columns are
fine; a row with a null id gets the smallest id of its component, null if there is
none.  Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, materialize
from .common import LOWER, WS, Texts, bounded, chunks, give_back, maybe_broadcast, mix, span_hashes, stored, weighed

SHINGLE, NUM, DEN = 5, 3, 4    # words; least similarity as a fraction
SMALL = 64                     # classes of a cell that gives its pairs
FEW = 64                       # unconnected members that are measured against a larger cell: see few_of
PIVOTS = (2, 6, 6, 8)          # pivots of a larger cell, by depth; then twice as many each time
FREQ_SHARE, FREQ_LEAST, FREQ_ROWS = 32, 3, 200_000   # order of frequent shingles: see frequent_shingles
SET_BYTES = 1 << 20            # sets of a step that are broadcast; beyond it they are shuffled
ONE_TASK = 100_000             # edges of a forest whose components one task finds; beyond it Spark's steps do
SKETCH = 256                   # ranges that a set's members are counted in
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _bounded(df: DataFrame) -> tuple[DataFrame, bool]:
    """As ``bounded``, in one job."""
    m, got = weighed(df)
    return m, got["bytes"] <= BROADCAST_BYTES


def shingle_sets(arr: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text."""
    t = Texts(arr)
    low = LOWER[t.data]
    starts, ends, doc = t.words(WS)
    word = span_hashes(low, starts, ends)
    n = np.bincount(doc, minlength=t.n)
    at = np.cumsum(n) - n
    run = np.zeros(max(0, len(word) - k + 1), np.uint64)
    for j in range(k):
        run = mix(run + word[j:len(word) - k + 1 + j] + np.uint64(j + 1)) if len(run) else run
    out = []
    for i in range(t.n):
        if n[i] >= k:
            out.append(np.unique(run[at[i]:at[i] + n[i] - k + 1]))
        elif n[i]:
            h = mix(np.array([n[i]], np.uint64) * _SALT)
            for w in word[at[i]:at[i] + n[i]]:
                h = mix(h + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two longs."""
    return tuple(int(np.sum(mix(s ^ x), dtype=np.uint64).astype(np.int64)) for x in (np.uint64(1), _SALT))


def profile_udf(k: int = SHINGLE):
    """text -> size and signature of its set; for a share of 1 / ``FREQ_SHARE`` of the
    signatures the set itself."""
    def run(text: pa.Array) -> pa.Array:
        n, a, b, some = [], [], [], []
        for part in chunks(text):
            for s in shingle_sets(part, k):
                x, y = signature(s)
                n.append(len(s))
                a.append(x)
                b.append(y)
                some.append(s.astype(np.int64) if len(s) and x % FREQ_SHARE == 0 else None)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                           pa.array(some, pa.list_(pa.int64()))], ["n", "sig", "sig2", "some"])
    return F.arrow_udf(run, "n long, sig long, sig2 long, some array<long>")


def prefix_size(n, num: int = NUM, den: int = DEN):
    return n - (num * n + den - 1) // den + 1


def _batches(pick, names: list[str]):
    """mapInArrow over (text): rows of ``pick(sig, set)`` for the first text of each
    signature in a batch, so that groups of copies shrink before the shuffle."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            seen: set[int] = set()
            for part in chunks(batch.column(0)):
                cols: list[list[np.ndarray]] = [[] for _ in names]
                for s in shingle_sets(part):
                    sig = signature(s)[0]
                    if len(s) and sig not in seen:
                        seen.add(sig)
                        for c, v in zip(cols, pick(sig, s)):
                            c.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], names)
    return run


def frequent_shingles(profiles: DataFrame) -> np.ndarray:
    """Shingles that several classes of a share of 1 / ``FREQ_SHARE`` hold, the most
    frequent ``FREQ_ROWS`` of them: the end of the order that seed cells rest on.
    Any order gives the same links; this one keeps cells small."""
    rows = profiles.where("some is not null").dropDuplicates(["sig"]).select(F.explode("some").alias("token")) \
        .groupBy("token").count().where(F.col("count") >= FREQ_LEAST) \
        .orderBy(F.desc("count"), "token").limit(FREQ_ROWS).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def ordered_prefix(s: np.ndarray, frequent: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """The shingles that a set is seeded by, rare ones first, each kind by hash; and
    how many of them are rare."""
    p = prefix_size(len(s), num, den)
    if not len(frequent):
        return s[:p], p
    often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
    rare = s[~often][:p]
    return (rare if len(rare) == p else np.concatenate([rare, s[often][:p - len(rare)]])), len(rare)


def seed_cells(texts: DataFrame, frequent: np.ndarray, num: int, den: int) -> DataFrame:
    """(token, sig, often) of every class and seeding shingle; often: -1, or for a
    frequent shingle how many frequent ones the class holds.  A class has frequent
    seeds only where all its rare shingles are seeds as well."""
    def pick(sig, s):
        p, rare = ordered_prefix(s, frequent, num, den)
        return p, np.full(len(p), sig), np.where(np.arange(len(p)) >= rare, len(s) - rare, -1)
    return texts.mapInArrow(_batches(pick, ["token", "sig", "often"]), "token long, sig long, often long")


def _cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of one partition of (token, sig, often): pairs (a, b) of small cells
    as kind 0, members of larger ones as (token, sig) of kind 1.  Members of cells of
    frequent shingles needn't be together, and are passed on as they are."""
    def batch(kind, a, b, often=None):
        often = np.full(len(a), -1) if often is None else often
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a), pa.array(b),
                                           pa.array(often, pa.int64())], ["kind", "a", "b", "often"])
    got = []
    for rows in it:
        token, sig, often = (rows.column(k).to_numpy() for k in range(3))
        if (often >= 0).any():
            yield batch(1, token[often >= 0], sig[often >= 0], often[often >= 0])
        got.append((token[often < 0], sig[often < 0]))
    if not got:
        return
    token, sig = (np.concatenate([g[k] for g in got]) for k in (0, 1))
    order = np.lexsort((sig, token))
    token, sig = token[order], sig[order]
    first = np.ones(len(token), bool)
    first[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])        # copies from other batches
    token, sig = token[first], sig[first]
    cut = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True]) if len(token) else np.zeros(1, np.int64)
    size = np.diff(cut)
    big = np.repeat(size > SMALL, size)
    for i in range(0, int(big.sum()), 1 << 20):
        yield batch(1, token[big][i:i + (1 << 20)], sig[big][i:i + (1 << 20)])
    for n in np.unique(size[(size > 1) & (size <= SMALL)]):
        at = cut[:-1][size == n]
        x, y = np.triu_indices(n, 1)
        step = max(1, (1 << 18) // len(x))
        for i in range(0, len(at), step):
            part = at[i:i + step]
            yield batch(0, sig[(part[:, None] + x).ravel()], sig[(part[:, None] + y).ravel()])


def sketch(s: np.ndarray) -> bytes:
    """Members of a set by ``SKETCH`` ranges of a hash, at most 255 each."""
    return np.minimum(np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def class_sets(texts: DataFrame, sigs: DataFrame) -> DataFrame:
    """(sig, n, sketch, tokens) of the classes in ``sigs``, from the texts again."""
    sigs, small = bounded(sigs)

    def run(it):
        for batch in it:
            seen: set[int] = set()
            for part in chunks(batch.column(0)):
                rows = []
                for s in shingle_sets(part):
                    sig = signature(s)[0]
                    if len(s) and sig not in seen:
                        seen.add(sig)
                        rows.append((sig, len(s), sketch(s), s.astype(np.int64)))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))],
                        ["sig", "n", "sketch", "tokens"])
    return texts.mapInArrow(run, "sig long, n long, sketch binary, tokens array<long>") \
        .join(maybe_broadcast(sigs, small), "sig", "left_semi").dropDuplicates(["sig"])


def most_overlap_udf():
    """A bound on the overlap of two sets from their sketches and sizes: members of
    one range only match members of the same range."""
    def run(a: pa.Array, b: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        least = np.minimum(na.to_numpy(), nb.to_numpy())
        if not len(a):
            return pa.array(least)
        x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, SKETCH) for v in (a, b))
        low = np.minimum(x, y)
        most = np.where((low == 255).any(1), least, np.minimum(least, low.sum(1, dtype=np.int64)))
        del x, y, low
        give_back()
        return pa.array(most)
    return F.arrow_udf(run, "long")


def overlap_udf():
    """Size of the intersection of two sorted sets of distinct longs."""
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros(len(a), np.int64)
        ao, bo = a.offsets.to_numpy(), b.offsets.to_numpy()
        av, bv = a.values.to_numpy(zero_copy_only=False), b.values.to_numpy(zero_copy_only=False)
        for i in range(len(a)):
            both = np.concatenate([av[ao[i]:ao[i + 1]], bv[bo[i]:bo[i + 1]]])
            both.sort()
            out[i] = np.count_nonzero(both[1:] == both[:-1])
        del av, bv
        give_back()
        return pa.array(out)
    return F.arrow_udf(run, "long")


def measure(pairs: DataFrame, sets: tuple[DataFrame, DataFrame, bool]) -> tuple[DataFrame, bool]:
    """``pairs`` (a, b, within) with their sizes na, nb and overlap o, and whether that
    is small.  Where the sketches show a distance over ``within``, o is their upper
    bound; else it is exact, and only there the sets themselves are moved."""
    full, thin, small = sets
    for x in "ab":
        pairs = pairs.join(maybe_broadcast(thin.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"),
                                                       F.col("sketch").alias(f"s{x}")), small), x)
    pairs, _ = weighed(pairs.select("a", "b", "within", "na", "nb", most_overlap_udf()("sa", "sb", "na", "nb").alias("o")))
    near = distance() <= F.col("within") + 1e-9
    both = F.array(*[F.struct(F.col(x).alias("sig"), F.col(f"n{x}").alias("n")) for x in "ab"])
    need, got = weighed(pairs.where(near).select(F.explode(both).alias("s")).select("s.*").distinct(), members=F.sum("n"))
    full = full.select("sig", "tokens").join(maybe_broadcast(need.select("sig"), 8 * got["rows"] <= BROADCAST_BYTES),
                                             "sig", "left_semi")
    exact = pairs.where(near).drop("o")
    for x in "ab":
        side = full.select(F.col("sig").alias(x), F.col("tokens").alias(f"t{x}"))
        exact = exact.join(maybe_broadcast(side, 8 * got["members"] <= SET_BYTES), x)
    exact = exact.select("a", "b", "na", "nb", overlap_udf()("ta", "tb").alias("o"))
    known, got = weighed(exact.unionByName(pairs.where(~near).drop("within")))
    return known, got["bytes"] <= BROADCAST_BYTES


def is_link(num: int, den: int):
    return den * F.col("o") >= num * (F.col("na") + F.col("nb") - F.col("o"))


def distance():
    return 1 - F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))


def small_cell_pairs(cells: DataFrame, large: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of small cells whose common cells leave room for the needed
    overlap.

    With prefixes p, the overlap is at most the common cells plus the larger rest
    n - p; members of larger cells may share those besides.
    """
    n = F.col("n")
    p = n - F.floor((num * n + den - 1) / den) + 1
    pairs = cells.groupBy("a", "b").agg(F.count("*").alias("common"))
    info = sizes.select("sig", "n", (n - p).alias("rest")) \
        .join(large.groupBy("sig").agg(F.count("*").alias("large")), "sig", "left").na.fill(0, ["large"])
    for x in "ab":
        pairs = pairs.join(info.select(*[F.col(c).alias(f"{c}_{x}") for c in info.columns]), F.col(x) == F.col(f"sig_{x}"))
    need = F.ceil(num * (F.col("n_a") + F.col("n_b")) / (num + den))
    return pairs.where((den * F.col("n_a") >= num * F.col("n_b")) & (den * F.col("n_b") >= num * F.col("n_a"))
                       & (F.col("common") + F.least("large_a", "large_b") + F.greatest("rest_a", "rest_b") >= need)) \
        .select("a", "b").distinct()


def pivots_of(depth: int) -> int:
    return PIVOTS[depth] if depth < len(PIVOTS) else PIVOTS[-1] << (depth - len(PIVOTS) + 1)


def few_of(depth: int) -> int:
    """Unconnected members that end a cell at this depth; a cell that pivots have split
    before may keep more of them, as another step costs more than their pairs."""
    return FEW << depth


def near_pivots(cells: DataFrame, depth: int) -> DataFrame:
    """(cell, sig, n, most, pivot) of every member and pivot of its cell.  The smallest
    members are the pivots: what a cell shares is most of them."""
    w = Window.partitionBy("cell").orderBy("n", F.xxhash64("sig"), "sig")
    pivots, few = _bounded(cells.select("cell", "sig", "n").withColumn("_rn", F.row_number().over(w))
                           .where(F.col("_rn") <= pivots_of(depth)).select("cell", F.col("sig").alias("pivot")))
    return cells.select("cell", "sig", "n", "most").join(maybe_broadcast(pivots, few), "cell")


def split_cells(near: DataFrame, known: DataFrame, small: bool, depth: int, num: int, den: int) -> DataFrame:
    """Regions (cell, sig, n, most) of one step: cells are split around pivots, whose
    distances to the members are in ``known``."""
    r, eps = 1 - num / den, 1e-9
    # Distances over 2r may be lower bounds: who is at home or in a ball is exact, and
    # a member that is nearer than it should be only makes one guest more.
    low, high = F.least("sig", "pivot"), F.greatest("sig", "pivot")
    d = known.select(F.col("a").alias("_a"), F.col("b").alias("_b"), distance().alias("d"), is_link(num, den).alias("link"))
    to = near.join(maybe_broadcast(d, small), (low == F.col("_a")) & (high == F.col("_b")), "left") \
        .select("cell", "sig", "n", "most", F.struct(F.coalesce("d", F.lit(0.0)).alias("d"), "pivot", "link").alias("p"))
    # a distance for each pivot; the pivots themselves are done
    member = to.groupBy("cell", "sig", "n", "most").agg(F.sort_array(F.collect_list("p")).alias("p")).where("p[0].pivot != sig")
    member = stored(member.withColumn("least", F.expr("p[0].d")), "members")
    # Voronoi regions with guests: a home member at d <= 2r has its partners within
    # d + r of its pivot, and none of them has a pivot nearer by more than 2r
    regions = member.select("cell", "sig", "n", "most", "least", F.posexplode("p").alias("i", "p")) \
        .where((F.col("p.d") <= 3 * r + eps) & (F.col("p.d") <= F.col("least") + 2 * r + eps)) \
        .select("cell", F.xxhash64("cell", "p.pivot", F.lit(depth)).alias("region"), "sig", "n", "most", "p.d",
                F.col("p.link").alias("inside"), ((F.col("i") == 0) & (F.col("p.d") <= 2 * r + eps)).alias("home"))
    far = member.where(F.col("least") > 2 * r - eps) \
        .select("cell", F.xxhash64("cell", F.lit(-1), F.lit(depth)).alias("region"), "sig", "n", "most", F.col("least").alias("d"),
                F.lit(False).alias("inside"), F.lit(True).alias("home"))
    regions = regions.unionByName(far)
    # Nothing is left to do where all are in one ball or none is at home.  Of a ball,
    # only members within r of the nearest one outside can link to it.
    state, few = _bounded(regions.groupBy("region").agg(
        F.min(F.when(~F.col("inside"), F.col("d"))).alias("edge"), F.max("home").alias("any"), F.count("*").alias("n"))
        .where("any and edge is not null and n > 1").select("region", "edge"))
    regions = regions.join(maybe_broadcast(state, few), "region") \
        .where(~F.col("inside") | (F.col("d") >= F.col("edge") - r - eps)).select("cell", "region", "sig", "n", "most")
    # where pivots don't separate a cell, it goes on as it is, without them
    size = member.groupBy("cell").agg(F.count("*").alias("n"))
    apart, few = _bounded(regions.groupBy("cell").agg(F.count("*").alias("rows")).join(size, "cell")
                          .select("cell", (4 * F.col("rows") <= 5 * F.col("n")).alias("apart")))
    split = regions.join(maybe_broadcast(apart.where("apart").select("cell"), few), "cell") \
        .select(F.col("region").alias("cell"), "sig", "n", "most")
    whole = member.join(maybe_broadcast(apart.where("not apart").select("cell"), few), "cell") \
        .select(F.xxhash64("cell", F.lit(depth)).alias("cell"), "sig", "n", "most")
    return split.unionByName(whole).distinct()


def open_cells(cells: DataFrame, labels: tuple[DataFrame, bool], few: int, num: int, den: int) -> tuple[DataFrame, bool, bool]:
    """(cell, sig, n, most, root, main, others) of cells whose members aren't all
    connected yet, and whether any has up to ``few`` others and any more; main: the component with most members, others: members of other
    ones.  Of cells with the same members one stays, that of most ``most``: a rare
    shingle's, if there is one.

    Classes that share a rare shingle meet in its cell too (see ``seed_cells``); so in
    the cell of a frequent one, members need only be linked by as many shingles as
    either has frequent ones (``most``), and those for which that is too few even
    with the smallest member leave."""
    least, small = _bounded(cells.groupBy("cell").agg(F.min("n").alias("_n")))
    partner = F.greatest(F.col("_n"), F.ceil(num * F.col("n") / den))
    cells = cells.join(maybe_broadcast(least, small), "cell") \
        .where((num + den) * F.col("most") >= num * (F.col("n") + partner)).drop("_n")
    rows = cells.join(maybe_broadcast(*labels), F.col("sig") == F.col("node"), "left") \
        .select("cell", "sig", "n", "most", F.coalesce("root", "sig").alias("root"))
    parts = rows.groupBy("cell", "root").agg(F.count("*").alias("n"), F.sum("most").alias("most"),
                                             F.sum(F.xxhash64("sig").cast("decimal(38,0)")).alias("s"))
    state = parts.groupBy("cell").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"), F.sum("most").alias("most"),
                                      F.sum("s").alias("s")).where(F.col("n") > F.col("m.n"))
    state = state.groupBy("s", "n").agg(F.min(F.struct((-F.col("most")).alias("o"), "cell", "m")).alias("c")) \
        .select("c.cell", F.col("c.m.root").alias("main"), (F.col("n") - F.col("c.m.n")).alias("others"))
    state, small = _bounded(state)
    seen = Observation()
    out = stored(rows.join(maybe_broadcast(state, small), "cell")
                 .observe(seen, F.max(F.col("others") <= few).alias("few"), F.max(F.col("others") > few).alias("many")), "cells")
    return out, bool(seen.get["few"]), bool(seen.get["many"])


def cross_pairs(cells: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of members of different components in each cell, one of which is not of
    the cell's main component, whose sizes and frequent shingles allow the
    similarity."""
    few = cells.where("root != main").select(F.col("cell").alias("_c"), F.col("sig").alias("_s"), F.col("root").alias("_r"),
                                             F.col("n").alias("_n"), F.col("most").alias("_m"))
    return cells.join(few, (F.col("cell") == F.col("_c")) & (F.col("root") != F.col("_r"))
                      & (den * F.col("n") >= num * F.col("_n")) & (den * F.col("_n") >= num * F.col("n"))
                      & ((num + den) * F.least("most", "_m") >= num * (F.col("n") + F.col("_n")))) \
        .select(F.least("sig", "_s").alias("a"), F.greatest("sig", "_s").alias("b"))


def links(texts: DataFrame, profiles: DataFrame, sizes: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(node, root) of the classes that links connect; root: the least class of its
    component.

    ``texts`` has one text column, ``profiles`` the columns of ``profile_udf``,
    ``sizes`` (sig, n) of every class."""
    spark = texts.sparkSession
    total = sizes.agg(F.coalesce(F.sum(F.col("n") / den + 1), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // 250_000) + 1)
    # members of cells of frequent shingles needn't meet in one task
    cells = stored(seed_cells(texts, frequent_shingles(profiles), num, den)
                   .repartition(parts, F.when(F.col("often") >= 0, F.col("sig")).otherwise(F.col("token")))
                   .mapInArrow(_cells, "kind int, a long, b long, often long"), "pairs")
    large, _ = weighed(cells.where("kind = 1").select(F.col("a").alias("cell"), F.col("b").alias("sig"), "often").distinct()
                        .join(sizes.select("sig", "n"), "sig").select(
                            "cell", "sig", "n", F.when(F.col("often") < 0, F.col("n")).otherwise(F.col("often")).alias("most")))
    pairs, _ = weighed(small_cell_pairs(cells.where("kind = 0"), large, sizes, num, den))
    sets = stored(class_sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("sig"))
                             .unionByName(large.select("sig")).distinct()), "sets")
    sets = (sets, *_bounded(sets.select("sig", "n", "sketch")))     # whole, thin, thin is small
    r = 1 - num / den
    known, small = measure(pairs.withColumn("within", F.lit(r)), sets)
    labels = components(known.where(is_link(num, den)))
    depth = 0
    while True:
        state, few, many = open_cells(large, labels, few_of(depth), num, den)
        if not few and not many:
            return labels[0]
        todo = []
        if few:
            todo.append(cross_pairs(state.where(F.col("others") <= few_of(depth)), num, den).withColumn("within", F.lit(r)))
        if many:
            near = near_pivots(state.where(F.col("others") > few_of(depth)), depth)
            todo.append(near.where("sig != pivot").select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b"),
                                                          F.lit(2 * r).alias("within")))
        known, small = measure(functools.reduce(DataFrame.unionByName, todo).groupBy("a", "b").agg(F.max("within").alias("within")), sets)
        labels = connect(labels, known.where(is_link(num, den)))
        if not many:
            return labels[0]
        large = stored(split_cells(near, known, small, depth, num, den), "regions")
        depth += 1


def least_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), and the least node that each reaches."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(node))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            return node, node[root]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _edges(it: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and least roots of the edges of some batches, held as a forest."""
    a = b = np.zeros(0, np.int64)
    for rows in it:
        a, b = np.concatenate([a, rows.column(0).to_numpy()]), np.concatenate([b, rows.column(1).to_numpy()])
        if len(a) > 1 << 20:
            a, b = least_roots(a, b)
            a, b = a[a != b], b[a != b]
    return least_roots(a, b)


def _forest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that connect what a partition's edges connect, one a node at most."""
    node, root = _edges(it)
    yield pa.RecordBatch.from_arrays([pa.array(root[node != root]), pa.array(node[node != root])], ["a", "b"])


def _roots(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, root = _edges(it)
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def components(edges: DataFrame) -> tuple[DataFrame, bool]:
    """(node, root) of all nodes of the edges (a, b), root the least node that is
    reachable; and whether that is small.  Each partition's edges become a forest;
    a small one is finished by one task, others by minimum labels and pointer
    jumping, logarithmic in steps."""
    forest, got = weighed(edges.select("a", "b").mapInArrow(_forest, "a long, b long"))
    if got["rows"] <= ONE_TASK:
        return _bounded(forest.coalesce(1).mapInArrow(_roots, "node long, root long"))
    both, _ = weighed(forest.unionByName(forest.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label, small = _bounded(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        to = maybe_broadcast(label.select(F.col("node").alias("b"), F.col("root").alias("rb")), small)
        least = both.join(to, "b").groupBy(F.col("a").alias("node")).agg(F.min("rb").alias("m"))
        new = label.join(least, "node").select("node", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        # hook the old root under the new one, then jump
        hook = new.groupBy(F.col("old").alias("h")).agg(F.min("root").alias("to"))
        jump, got = weighed(new.join(hook, F.col("root") == F.col("h"), "left")
                            .select("node", F.least("root", F.coalesce("to", "root")).alias("root"), "old"),
                            changed=F.count_if(F.col("root") != F.col("old")))
        label, small = jump.select("node", "root"), got["bytes"] <= BROADCAST_BYTES
        if not got["changed"]:
            return label, small


def connect(labels: tuple[DataFrame, bool], edges: DataFrame) -> tuple[DataFrame, bool]:
    """``components`` of ``labels`` and the edges (a, b): only the edges between different
    components are looked at, as edges of their roots."""
    old, small = labels
    for x in "ab":
        edges = edges.join(maybe_broadcast(old.select(F.col("node").alias(x), F.col("root").alias(f"_{x}")), small), x, "left")
    new, few = components(edges.select(*[F.coalesce(f"_{x}", x).alias(x) for x in "ab"]).where("a != b"))
    to = maybe_broadcast(new.select(F.col("node").alias("root"), F.col("root").alias("_to")), few)
    # the old roots among the new nodes come twice, with the same root
    return _bounded(old.join(to, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
                    .unionByName(new).distinct())


def _found(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, n, component_id and class (sig, sig2) of every row."""
    p = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), profile_udf()(F.col(f"`{text}`")).alias("p"))
    rows = stored(p.select("doc_id", "p.*"), "profiles")
    classes = materialize(rows.where("n > 0").groupBy("sig", "sig2", "n").agg(F.min("doc_id").alias("least")))
    texts = docs.select(F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    roots = links(texts, rows, classes.select("sig", "n"))
    grouped = classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left") \
        .withColumn("root", F.coalesce("root", "sig"))
    w = grouped.groupBy(F.col("root").alias("_r")).agg(F.min("least").alias("component_id"))
    where = grouped.join(w, F.col("root") == F.col("_r")).select("sig", "sig2", "n", "component_id")
    out = rows.join(where, ["sig", "sig2", "n"], "left")
    return out.select("doc_id", "n", "sig", "sig2",
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return _found(docs, doc_id, text).select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that of its smallest id, with its own columns.  Rows
    without words are linked with nothing and all stay; so do rows of components
    without any id."""
    found = stored(_found(docs, doc_id, text), "found").where("n > 0")
    out, small = bounded(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_id")).distinct())
    rest = docs.join(maybe_broadcast(out, small), F.col(f"`{doc_id}`") == F.col("_id"), "left_anti")
    # rows without an id, in components that have one: told by their class
    lost, few = bounded(found.where("doc_id IS NULL AND component_id IS NOT NULL")
                        .select(*[F.col(c).alias(f"_{c}") for c in ("n", "sig", "sig2")]).distinct())
    if not lost.isEmpty():
        no_id = F.col(f"`{doc_id}`").isNull()
        nameless = rest.where(no_id).withColumn("_p", profile_udf()(F.col(f"`{text}`"))) \
            .join(maybe_broadcast(lost, few), (F.col("_p.n") == F.col("_n")) & (F.col("_p.sig") == F.col("_sig"))
                  & (F.col("_p.sig2") == F.col("_sig2")), "left_anti").drop("_p")
        rest = rest.where(~no_id).unionByName(nameless)
    again, small = bounded(found.where(F.col("doc_id") == F.col("component_id"))
                           .groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id"))
    if again.isEmpty():
        return rest
    again = maybe_broadcast(again, small)
    same = F.col(f"`{doc_id}`") == F.col("_id")
    return rest.join(again, same, "left_anti").unionByName(rest.join(again, same, "left_semi").dropDuplicates([doc_id]))
