"""Packing of documents into sequences by non-negative least squares.

Every document is encoded and ends with an end id.  Whole windows are cut off its
front, each a sequence of its own; what is left is shorter than a window and falls
into a length class, ``grid`` ids wide.  All combinations of at most ``depth``
classes that fill a window are enumerated; non-negative least squares says how often
each is repeated to meet the histogram of the classes; the counts are rounded down
and never ask for more documents than a class has.  The documents of a class are
numbered, and a table of number ranges says which sequence and slot each gets.

The residuals (documents that no combination took) are packed greedily: laid end to
end over the holes of the combinations' sequences and then over new sequences, cut
where one ends.  Combinations are held back until the residuals can fill all holes.
The last, incomplete window becomes sequences whose sizes are powers of two, which
need no padding.

Only the class histogram (one row a class) and totals reach the driver.  Documents
are numbered in runs dealt by a hash, so a class that holds most documents is many
tasks; the two lines of intervals (documents, holes) meet in blocks of ids, with one
sorted pass a block.  Encoding keeps a bounded memo of words: white space always ends
a token of the vocabulary, so the words of a text are encoded one by one.

Defined results: a null text is empty and has the end id alone; repeated rows are
packed each; an empty table has no pieces; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import keyed_scan
from ..session import materialize
from .common import bounded, by_chunk, maybe_broadcast, stored
from .tokenizers import vocab_path

WORD_BPE = "word_bpe_49k.json"
WINDOW = 4_096
GRID = 64                      # ids a length class is wide
DEPTH = 4                      # most documents of a combination
END = 2
RUN = 10_000                   # documents numbered together
BLOCK = 1 << 20                # ids of the two lines that meet in one group
MEMO = 300_000                 # words a worker remembers
SLICE = 2 << 20                # bytes of short texts that are encoded together
JOINED = 5_000                 # words encoded at once
PART = 1 << 20                 # bytes of a text that are split into words at once
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PLAIN = r"^[!-~\x{A1}-\x{12F}\x{131}-\x{17F}]{1,63}$"
# Fixed value: the vocabulary's pattern of pre-tokens.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


# ------------------------------------------------------------------ encoding
class _Words:
    """Remembers the ids of words, as little-endian 32-bit integers.

    Words of printable characters up to U+017F, where lower-casing and composition are
    plain, are cut by the vocabulary's own pre-token pattern.  The parts not met yet are
    encoded many at a time, with blanks between them; as the last token of a pre-token
    is marked, the ids fall apart again.  Other words are encoded one by one.  Of words
    and parts the last ``MEMO`` to ``2 * MEMO`` used are remembered."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(vocab_path(name))
        vocab = self.model.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.words: tuple[dict, dict] = ({}, {})         # younger, older
        self.parts: tuple[dict, dict] = ({}, {})

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        got = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4") for e in got]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        out = []
        groups = [parts[i:i + JOINED] for i in range(0, len(parts), JOINED)]
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups])):
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) != len(group):
                out += [x.tobytes() for x in self._encode(group)]
                continue
            data = (4 * np.asarray([0, *ends])).tolist()
            blob = ids.tobytes()
            out += [blob[a:b] for a, b in zip(data[:-1], data[1:])]
        return out

    @staticmethod
    def _recall(memo: tuple[dict, dict], keys: list) -> tuple[list, list[int]]:
        """(what is known of each key, places of the unknown)."""
        young, old = memo
        got = list(map(young.get, keys))
        missing = [i for i, x in enumerate(got) if x is None]
        if old:
            for i in missing:
                if (x := old.get(keys[i])) is not None:
                    got[i] = young[keys[i]] = x
            missing = [i for i in missing if got[i] is None]
        return got, missing

    def lookup(self, words: pa.Array) -> list[bytes]:
        """The ids of every word."""
        if len(self.words[0]) > MEMO:
            self.words = ({}, self.words[0])
        if len(self.parts[0]) > MEMO:
            self.parts = ({}, self.parts[0])
        keys = words.to_numpy(zero_copy_only=False).tolist()
        got, new = self._recall(self.words, keys)
        if not new:
            return got
        there = words.take(pa.array(new))
        plain = pc.and_not(pc.match_substring_regex(there, _PLAIN), pc.match_substring(there, "<|")) \
            .to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(there)
        alpha = pc.utf8_is_alpha(low).to_numpy(zero_copy_only=False)
        low, young = low.to_numpy(zero_copy_only=False).tolist(), self.words[0]
        cut: dict[int, list[str]] = {}
        for j in np.flatnonzero(plain & ~alpha).tolist():
            cut[j] = _PARTS.findall(low[j])
        single = np.flatnonzero(plain & alpha).tolist()
        parts = list({low[j] for j in single}.union(*cut.values()))
        known, unknown = self._recall(self.parts, parts)
        fresh = [parts[i] for i in unknown]
        ids = dict(zip(parts, known))
        fresh = dict(zip(fresh, self._encode_parts(fresh)))
        ids.update(fresh)
        self.parts[0].update(fresh)
        for j in single:
            got[new[j]] = young[keys[new[j]]] = ids[low[j]]
        for j, ps in cut.items():
            got[new[j]] = young[keys[new[j]]] = b"".join([ids[p] for p in ps])
        other = np.flatnonzero(~plain).tolist()
        for j, x in zip(other, self._encode([keys[new[j]] for j in other])):
            got[new[j]] = x.tobytes()
            if len(keys[new[j]]) < 64:
                young[keys[new[j]]] = got[new[j]]
        return got


@functools.lru_cache(2)
def _words(name: str) -> _Words:
    return _Words(name)


def encode_texts(texts: pa.Array, name: str = WORD_BPE) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, bounds): white space ends every token, so each distinct word
    is encoded once."""
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    if not len(coded):
        return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
    known = _words(name).lookup(coded.dictionary)
    sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
    at = np.cumsum(sizes) - sizes
    codes = coded.indices.to_numpy()
    each = sizes[codes]
    total = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(each, out=total[1:])
    flat = np.frombuffer(b"".join(known), "<u4")
    ids = flat[np.arange(total[-1]) + np.repeat(at[codes] - total[:-1], each)]
    offsets = split.offsets.to_numpy()
    return ids, total[offsets - offsets[0]]


def _parts_of(text: bytes):
    """Parts of a long text, of about ``PART`` bytes, that end at white space."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + PART)
        end = space.start() if space else len(text)
        yield pa.array([text[at:end].decode("utf-8")])
        at = end


ENCODED = pa.struct([("n", pa.int64()), ("crcs", pa.list_(pa.int64())), ("rest_crc", pa.int64()),
                     ("rest", pa.list_(pa.int32()))])


def _lists(parts: list, kind: pa.DataType) -> pa.Array:
    bounds = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat).cast(kind))


def _encode(arr: pa.Array, name: str, window: int, end: int) -> pa.Array:
    last = np.asarray([end], "<u4")
    if arr.nbytes <= 2 * SLICE:
        ids, bounds = encode_texts(arr.cast(pa.string()), name)
        streams = ([ids[a:b], last] for a, b in zip(bounds[:-1], bounds[1:]))
    else:                                                # one long text
        streams = (itertools.chain((encode_texts(p, name)[0] for p in _parts_of(t.as_buffer().to_pybytes())), [last])
                   for t in arr)
    n, crcs, rest_crc, rest = [], [], [], []
    for stream in streams:
        left, size, whole = np.zeros(0, "<u4"), 0, []
        for some in stream:
            size += len(some)
            some = np.concatenate([left, some])
            full = len(some) // window * window
            whole += [zlib.crc32(some[i:i + window]) for i in range(0, full, window)]
            left = some[full:]
        n.append(size)
        crcs.append(np.asarray(whole, np.int64))
        rest_crc.append(zlib.crc32(left))
        rest.append(left)
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), _lists(crcs, pa.int64()),
                                       pa.array(rest_crc, pa.int64()), _lists(rest, pa.int32())], fields=list(ENCODED))


def encode_udf(name: str, window: int, end: int):
    """text -> (number of ids, crc32 of each whole window, crc32 and ids of the rest)."""
    def run(text: pa.Array) -> pa.Array:
        return by_chunk(text, functools.partial(_encode, name=name, window=window, end=end), ENCODED, SLICE)
    return F.arrow_udf(run, "n long, crcs array<long>, rest_crc long, rest array<int>")


# ------------------------------------------------------------------ the plan
def combinations(total: int, depth: int) -> list[tuple[int, ...]]:
    """Every way to write ``total`` as a sum of at most ``depth`` classes, each of 1 or
    more, in descending order."""
    out = []

    def extend(head, left, most):
        if not left:
            out.append(tuple(head))
        elif len(head) < depth:
            for k in range(min(left, most), 0, -1):
                extend([*head, k], left - k, k)
    extend([], total, total)
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises ``|a x - b|``, by an active set: free the variable with the
    steepest descent, solve on the free ones, and fix those that turn negative."""
    x = np.zeros(a.shape[1])
    free = np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[1]):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-10 * max(1.0, np.abs(b).max()):
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 1e-12
            gap = x[at[low]] - z[low]
            step = np.min(np.where(gap > 0, x[at[low]] / np.where(gap > 0, gap, 1), 0))
            x[at] += step * (z - x[at])
            free[at[x[at] <= 1e-12]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def plan(counts: dict[int, tuple[int, int]], window: int, grid: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) from the class histogram {class: (documents, ids)}.

    Repeats are held back, a 64th at a time, until the documents left over have the ids
    that the holes need."""
    ways = combinations(window // grid, depth)
    size = window // grid
    a = np.zeros((size, len(ways)))
    for j, way in enumerate(ways):
        for k in way:
            a[k - 1, j] += 1
    have = np.array([counts.get(k, (0, 0))[0] for k in range(1, size + 1)])
    ids = np.array([counts.get(k, (0, 0))[1] for k in range(1, size + 1)], float)
    if not have.sum():
        return []
    wanted = np.floor(nnls(a, have / have.max()) * have.max() + 1e-6).astype(np.int64)
    left, times = have.copy(), np.zeros(len(ways), np.int64)
    for j in np.argsort(-wanted, kind="stable"):
        need = a[:, j].astype(np.int64)
        times[j] = min([wanted[j], *(left[need > 0] // need[need > 0])])
        left -= need * times[j]
    mean = np.divide(ids, have, out=np.zeros(size), where=have > 0)
    used = a.T @ mean                                  # ids of one repeat
    for held in range(65):
        kept = times * (64 - held) // 64
        holes, rest = (kept * (window - used)).sum(), ids.sum() - (kept * used).sum()
        if rest >= 1.02 * holes:
            break
    return [(ways[j], int(kept[j])) for j in np.flatnonzero(kept)]


def slots(chosen: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple], int]:
    """(rows (class, from, to, first sequence, repeats, first slot) by number range, sequences)."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for way, times in chosen:
        for k in sorted(set(way)):
            m = way.count(k)
            lo = taken.get(k, 0)
            rows.append((k, lo, lo + m * times, first, times, way.index(k)))
            taken[k] = lo + m * times
        first += times
    return rows, first


# ------------------------------------------------------------------ numbering and overlay
def _runs(n: int):
    return F.pmod(F.xxhash64("rid"), F.lit(n // RUN + 1))


def _blocks(line: DataFrame) -> DataFrame:
    """Intervals [a, b) of a line cut at multiples of ``BLOCK``."""
    blk = F.explode(F.sequence(F.expr(f"a div {BLOCK}"), F.expr(f"(b - 1) div {BLOCK}")))
    return line.where("b > a").withColumn("blk", blk).withColumn("pos", F.greatest("a", F.col("blk") * BLOCK))


def _overlay(docs: DataFrame, holes: DataFrame) -> DataFrame:
    """Where two gapless lines of intervals meet: (doc fields, hole fields, pos, length)."""
    d = _blocks(docs).select("blk", "pos", F.struct(*docs.columns).alias("d"))
    h = _blocks(holes).select("blk", "pos", F.struct(*holes.columns).alias("h"))
    events = d.withColumn("h", F.lit(None).cast(h.schema["h"].dataType)) \
        .unionByName(h.withColumn("d", F.lit(None).cast(d.schema["d"].dataType)))
    w = Window.partitionBy("blk").orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    seen = events.select("blk", "pos", F.lead("pos").over(w).alias("nxt"), F.last("d", True).over(so_far).alias("d"),
                         F.last("h", True).over(so_far).alias("h"))
    end = F.least("nxt", (F.col("blk") + 1) * BLOCK, F.col("d.b"), F.col("h.b"))
    return seen.where("d IS NOT NULL AND h IS NOT NULL").withColumn("length", end - F.col("pos")).where("length > 0")


def _powers(n: int) -> list[int]:
    """The powers of two that make up n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def _crc_of_parts():
    """(ids, from, length) -> crc32 of these ids as little-endian 32-bit integers."""
    def run(ids: pa.Array, at: pa.Array, size: pa.Array) -> pa.Array:
        bounds = ids.offsets.to_numpy()
        flat = ids.values.to_numpy(zero_copy_only=False)
        lo = bounds[:-1] + at.to_numpy()
        return pa.array([zlib.crc32(flat[a:a + k].astype("<u4").tobytes()) for a, k in zip(lo, size.to_numpy())],
                        pa.int64())
    return F.arrow_udf(run, "long")


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = WORD_BPE,
         window: int = WINDOW, grid: int = GRID, depth: int = DEPTH, end: int = END) -> DataFrame:
    """Pieces: the document's id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``window`` is a multiple of ``grid`` and at most ``BLOCK``."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    enc = docs.select(F.col(f"`{doc_id}`").alias("id_"), encode_udf(vocabulary, window, end)(t).alias("e"))
    coded = stored(enc.select(F.monotonically_increasing_id().alias("rid"), "id_", "e.*"), "packing")
    thin = coded.select("rid", "id_", "n", "rest_crc", "crcs", F.size("crcs").cast("long").alias("full"),
                        (F.col("n") % window).alias("r")) \
        .withColumn("class", F.ceil(F.col("r") / grid).cast("int"))
    rows = thin.groupBy("class").agg(F.count("*").alias("docs"), F.sum("r").alias("ids"), F.sum("full").alias("full")).collect()
    hist = {r["class"]: (r["docs"], r["ids"]) for r in rows if r["class"]}
    n_docs, n_full = sum(r["docs"] for r in rows), sum(r["full"] for r in rows)
    ranges, n_planned = slots(plan(hist, window, grid, depth))

    # number the documents of each class, and the whole windows of all
    cell = ["class", "run"]
    d = thin.withColumn("run", _runs(n_docs))
    totals = materialize(d.groupBy(*cell).agg(F.count("*").alias("docs"), F.sum("full").alias("wins")))
    offs = keyed_scan(totals, ["class"], ["run"], sums={"docs_to": F.col("docs")}, index_col=None)
    offs = keyed_scan(offs, [], cell, sums={"wins_to": F.col("wins")}, index_col=None)
    offs, small = bounded(offs.select(*cell, (F.col("docs_to") - F.col("docs")).alias("docs_before"),
                                      (F.col("wins_to") - F.col("wins")).alias("wins_before")))
    w = Window.partitionBy(*cell).orderBy("rid").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("nth", F.count("*").over(w) - 1).withColumn("wins", F.sum("full").over(w) - F.col("full"))
    d = d.join(maybe_broadcast(offs, small), cell).withColumn("nth", F.col("nth") + F.col("docs_before")) \
        .withColumn("first", F.col("wins") + F.col("wins_before")).drop("wins", "docs_before", "wins_before")
    # one row a class and combination that holds it: at most window / grid combinations have repeats
    table = spark.createDataFrame(ranges, "c int, lo long, hi long, seq0 long, times long, slot0 int")
    at = (F.col("class") == F.col("c")) & F.col("nth").between(F.col("lo"), F.col("hi") - 1)
    placed = materialize(d.join(F.broadcast(table), at, "left").select(
        "rid", "id_", "n", "r", "rest_crc", "crcs", "class", "run", "first", "full",
        (F.lit(n_full) + F.col("seq0") + F.pmod(F.col("nth") - F.col("lo"), F.col("times"))).alias("seq"),
        (F.col("slot0") + F.expr("(nth - lo) div times")).alias("slot")))

    whole = placed.where("full > 0").select("id_", "n", "first", F.posexplode("crcs").alias("k", "crc")) \
        .select("id_", (F.col("k") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"),
                "crc", "n", (F.col("first") + F.col("k")).alias("seq"), F.lit(0).cast("long").alias("offset"))

    in_seq = Window.partitionBy("seq").orderBy("slot", "rid").rowsBetween(Window.unboundedPreceding, 0)
    taken = placed.where("seq IS NOT NULL").withColumn("to", F.sum("r").over(in_seq))
    chosen = taken.select("id_", (F.col("full") * window).alias("start"), F.col("r").alias("length"),
                          F.col("rest_crc").alias("crc"), "n", "seq", (F.col("to") - F.col("r")).alias("offset"))

    # the residuals end to end, over the holes and then over new sequences
    left = placed.where("seq IS NULL AND r > 0")
    ids = materialize(left.groupBy(*cell).agg(F.sum("r").alias("ids")))
    before = keyed_scan(ids, [], cell, sums={"to": F.col("ids")}, index_col=None)
    before, small = bounded(before.select(*cell, (F.col("to") - F.col("ids")).alias("before")))
    left = left.withColumn("b", F.sum("r").over(w)).join(maybe_broadcast(before, small), cell) \
        .withColumn("b", F.col("b") + F.col("before")) \
        .select("rid", "id_", "n", "r", "rest_crc", (F.col("full") * window).alias("at"),
                (F.col("b") - F.col("r")).alias("a"), "b")
    open_ = taken.groupBy("seq").agg(F.sum("r").alias("used")).where(F.col("used") < window) \
        .withColumn("run", F.expr(f"seq div {RUN}"))
    open_ = materialize(open_)
    sums = materialize(open_.groupBy("run").agg(F.sum(window - F.col("used")).alias("ids")))
    before = keyed_scan(sums, [], ["run"], sums={"to": F.col("ids")}, index_col=None)
    before, small = bounded(before.select("run", (F.col("to") - F.col("ids")).alias("before")))
    by_run = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    holes = open_.withColumn("b", F.sum(window - F.col("used")).over(by_run)).join(maybe_broadcast(before, small), "run") \
        .withColumn("b", F.col("b") + F.col("before")) \
        .select("seq", F.col("used").alias("from"), (F.col("b") - window + F.col("used")).alias("a"), "b")
    n_holes = sums.agg(F.sum("ids")).first()[0] or 0
    more = max(0, (ids.agg(F.sum("ids")).first()[0] or 0) - n_holes)
    seq0 = n_full + n_planned
    fresh = spark.range(more // window).select(
        (F.col("id") + seq0).alias("seq"), F.lit(0).cast("long").alias("from"),
        (F.col("id") * window + n_holes).alias("a"), ((F.col("id") + 1) * window + n_holes).alias("b"))
    tail, a = [], n_holes + more // window * window
    for i, size in enumerate(_powers(more % window)):
        tail.append((seq0 + more // window + i, 0, a, a + size))
        a += size
    line = holes.unionByName(fresh).unionByName(spark.createDataFrame(tail, "seq long, from long, a long, b long"))
    met = materialize(_overlay(left, line).select(
        F.col("d.rid").alias("rid"), F.col("d.id_").alias("id_"), F.col("d.n").alias("n"), F.col("d.r").alias("r"),
        F.col("d.rest_crc").alias("rest_crc"), F.col("d.at").alias("at"), (F.col("pos") - F.col("d.a")).alias("in"),
        "length", F.col("h.seq").alias("seq"), (F.col("h.from") + F.col("pos") - F.col("h.a")).alias("offset")))
    uncut = met.where("length = r").select("id_", F.col("at").alias("start"), "length", F.col("rest_crc").alias("crc"),
                                           "n", "seq", "offset")
    parts, small = bounded(met.where("length < r").drop("r", "rest_crc"))
    cut = coded.select("rid", "rest").join(maybe_broadcast(parts, small), "rid").select(
        "id_", (F.col("at") + F.col("in")).alias("start"), "length",
        _crc_of_parts()("rest", "in", "length").alias("crc"), "n", "seq", "offset")
    out = whole.unionByName(chosen).unionByName(uncut).unionByName(cut)
    return out.select(F.col("id_").alias(doc_id), "start", "length", F.col("crc").alias("ids_crc32"),
                      F.col("n").alias("doc_tokens"), F.col("seq").alias("sequence_id"), "offset")
