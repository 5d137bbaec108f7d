"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All distinct pre-tokens of a slice of text lie one after another in one linked
list of symbols.  A bucket per merge rank holds the list positions whose pair
has that rank; a three-level bitmap over the ranks gives the lowest non-empty
bucket by find-first-set.  A popped bucket is merged at once from left to right:
entries whose pair has changed meanwhile are stale and skipped, overlapping
equal pairs are taken alternately, and the pairs that arise go to their buckets.
Work is near-linear in the symbols, also for a pre-token of a whole text.

Arrow UDF over the text column; no shuffle.  A worker keeps the ids of distinct
pre-tokens it has seen, up to ``MEMO`` of them, then starts anew.

Defined results: null and empty texts have no tokens and the digest of no bytes;
repeated rows are encoded each; other columns are neither read nor needed.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_chunk
from .tokenizers import BYTE_BPE, pretoken_pattern, read_ranks

MEMO = 400_000
CHUNK = 6 << 20
NONE = np.int64(1 << 40)       # rank of a pair that no token stands for


class RankBitmap:
    """Set of ranks as three levels of 64-bit words; first() is find-first-set."""

    def __init__(self, size: int):
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0

    def add(self, r: int) -> None:
        self.low[r >> 6] |= 1 << (r & 63)
        self.mid[r >> 12] |= 1 << ((r >> 6) & 63)
        self.top |= 1 << (r >> 12)

    def remove(self, r: int) -> None:
        self.low[r >> 6] &= ~(1 << (r & 63))
        if not self.low[r >> 6]:
            self.mid[r >> 12] &= ~(1 << ((r >> 6) & 63))
            if not self.mid[r >> 12]:
                self.top &= ~(1 << (r >> 12))

    def first(self) -> int:
        """The lowest rank, -1 if there is none."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        m = self.mid[a]
        b = (a << 6) + (m & -m).bit_length() - 1
        w = self.low[b]
        return (b << 6) + (w & -w).bit_length() - 1


class ByteBPE:
    """A vocabulary of byte strings by rank: pair ranks, encoding and decoding."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.byte_id = np.full(256, -1, np.int64)
        for b in range(256):
            self.byte_id[b] = ranks.get(bytes([b]), -1)
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        keys, ids = [], []
        for token, r in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    ids.append(r)
        keys, ids = np.array(keys, np.int64), np.array(ids, np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = np.r_[keys[order], np.int64(1 << 62)], np.r_[ids[order], NONE]
        tokens = sorted(ranks, key=ranks.get)
        self.token_len = np.zeros(self.size, np.int64)
        self.token_at = np.zeros(self.size, np.int64)
        at = 0
        for t in tokens:
            self.token_len[ranks[t]], self.token_at[ranks[t]] = len(t), at
            at += len(t)
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.pattern = regex.compile(pretoken_pattern())
        self.forget()

    def forget(self) -> None:
        """Empty the memo of distinct pre-tokens."""
        self.known = _Interner()
        self.memo_at = np.zeros(1, np.int64)
        self.memo_ids = np.zeros(0, np.uint32)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that the two symbols make together, NONE if none."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.key_rank[at], NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of every piece, by the rank queue over all of them."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        sym = self.byte_id[data] if n else np.zeros(0, np.int64)
        piece = np.repeat(np.arange(len(pieces)), lens)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        if n:
            last = np.r_[piece[1:] != piece[:-1], True]
            nxt[last] = n
            prv[np.r_[True, last[:-1]]] = -1
        alive = np.ones(n, bool)
        rank = np.full(n + 1, NONE)            # of the pair that starts here
        pairs = np.flatnonzero(nxt < n)
        rank[pairs] = self.pair_rank(sym[pairs], sym[nxt[pairs]])
        buckets: dict[int, list[np.ndarray]] = {}
        bitmap = RankBitmap(self.size)

        def push(at: np.ndarray) -> None:
            r = rank[at]
            at, r = at[r < NONE], r[r < NONE]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            ends = [*cuts[1:].tolist(), len(at)]
            for a, b, k in zip(cuts.tolist(), ends, r[cuts].tolist()):
                if k in buckets:
                    buckets[k].append(at[a:b])
                else:
                    buckets[k] = [at[a:b]]
                    bitmap.add(k)

        def around(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Positions whose pair the merges at ``at`` changed, and the new ranks."""
            left = prv[at]
            touched = np.unique(np.concatenate([left[left >= 0], at]))
            right = nxt[touched]
            fresh, real = np.full(len(touched), NONE), right < n
            fresh[real] = self.pair_rank(sym[touched[real]], sym[right[real]])
            return touched, fresh

        push(pairs)
        while (r := bitmap.first()) >= 0:
            found = buckets.pop(r)
            bitmap.remove(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = valid = at[alive[at] & (rank[at] == r)]          # stale entries go
            if not len(at):
                continue
            if len(at) > 1 and (over := nxt[at[:-1]] == at[1:]).any():
                # runs of overlapping pairs: every second one, from the left
                run = np.flatnonzero(np.r_[True, ~over])
                place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
                at = at[place % 2 == 0]
            gone, before = nxt[at], sym[at]
            after = nxt[gone]
            has = after < n
            # pairs that last only until the next entry of the bucket is merged
            beside = np.flatnonzero(after[:-1] == at[1:])
            passing = beside[self.pair_rank(np.full(len(beside), r), before[beside + 1]) < r]
            sym[at], alive[gone], nxt[at] = r, False, after
            prv[after[has]] = at[has]
            touched, fresh = around(at)
            early = np.concatenate([touched[fresh < r], at[passing]])
            if len(early):
                # A pair of lower rank arose.  In its piece it comes before the rest
                # of this bucket: only the piece's first entry is merged now.
                many = np.isin(piece[at], piece[early]) & np.r_[False, piece[at[1:]] == piece[at[:-1]]]
                for p, s, g in zip(*(x[many][::-1].tolist() for x in (at, before, gone))):
                    end = int(nxt[p])                             # undo, from the right
                    sym[p], alive[g], nxt[p], nxt[g], prv[g] = s, True, g, end, p
                    if end < n:
                        prv[end] = g
                at = at[~many]
                touched, fresh = around(at)
                push(valid[alive[valid] & ~np.isin(valid, at)])
            rank[touched] = fresh
            rank[gone[~alive[gone]]] = NONE
            push(touched)
        heads = np.flatnonzero(alive)
        bounds = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(np.bincount(piece[heads], minlength=len(pieces)), out=bounds[1:])
        return sym[heads].astype(np.uint32), bounds

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of every text: each match of the pattern on its own."""
        if len(self.known) > MEMO:
            self.forget()
        known, find = self.known, self.pattern.findall
        before = len(known)
        rows = [np.fromiter(map(known.__getitem__, find(t)), np.int64) for t in texts]
        if len(known) > before:
            pieces = [k.encode() for k in list(known)[before:]]
            direct = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
            ids, bounds = self.merge([p for p, d in zip(pieces, direct) if d < 0])
            size = np.ones(len(pieces), np.int64)
            size[direct < 0] = np.diff(bounds)
            out = np.empty(int(size.sum()), np.uint32)
            whole = np.repeat(direct >= 0, size)
            out[whole] = direct[direct >= 0]
            out[~whole] = ids
            self.memo_ids = np.concatenate([self.memo_ids, out])
            self.memo_at = np.concatenate([self.memo_at, self.memo_at[-1] + np.cumsum(size)])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        at = self.memo_at[flat]
        size = self.memo_at[flat + 1] - at
        total = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.memo_ids[_ranges(at, size, total)]
        return ids, total[np.r_[0, np.cumsum([len(r) for r in rows], dtype=np.int64)]]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds) of the concatenated tokens of each row of ids."""
        size = self.token_len[ids]
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        return self.blob[_ranges(self.token_at[ids], size, total)], total[bounds]


class _Interner(dict):
    """Numbers keys in the order in which they first come."""

    def __missing__(self, key):
        self[key] = out = len(self)
        return out


def _ranges(at: np.ndarray, size: np.ndarray, total: np.ndarray) -> np.ndarray:
    """at[0] .. at[0]+size[0]-1, at[1] .. and so on; total: sizes summed up."""
    return np.arange(total[-1]) + np.repeat(at - total[:-1], size)


@functools.lru_cache(2)
def load(vocabulary: str) -> ByteBPE:
    return ByteBPE(read_ranks(vocabulary))


IDS = pa.list_(pa.int32())
DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _encode(arr: pa.Array, vocabulary: str) -> pa.Array:
    ids, bounds = load(vocabulary).encode_batch(arr.to_pylist())
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))


def encode_udf(vocabulary: str = BYTE_BPE):
    """text -> array<int> of token ids."""
    def run(text: pa.Array) -> pa.Array:
        return by_chunk(text, functools.partial(_encode, vocabulary=vocabulary), IDS, CHUNK)
    return F.arrow_udf(run, "array<int>")


def _decode(arr: pa.Array, vocabulary: str) -> pa.Array:
    arr = arr.cast(IDS)
    if arr.null_count:
        arr = arr.fill_null([])
    bounds = arr.offsets.to_numpy().astype(np.int64)
    ids = arr.values.to_numpy(zero_copy_only=False)[bounds[0]:bounds[-1]]
    data, cuts = load(vocabulary).decode(ids, bounds - bounds[0])
    return pa.array([data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())


def decode_udf(vocabulary: str = BYTE_BPE):
    """array<int> of token ids -> the tokens' bytes."""
    def run(ids: pa.Array) -> pa.Array:
        return _decode(ids, vocabulary)
    return F.arrow_udf(run, "binary")


def _digest(arr: pa.Array, vocabulary: str) -> pa.Array:
    model = load(vocabulary)
    ids, bounds = model.encode_batch(arr.to_pylist())
    data, cuts = model.decode(ids, bounds)
    ids = ids.astype("<u4")
    sha = [[hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(c[:-1], c[1:])] for x, c in ((ids, bounds), (data, cuts))]
    return pa.StructArray.from_arrays([pa.array(np.diff(bounds)), pa.array(sha[0], pa.string()),
                                       pa.array(sha[1], pa.string())], fields=list(DIGEST))


CHECKED = pa.struct([("token_ids", IDS), ("round_trip", pa.bool_())])


def _checked(arr: pa.Array, vocabulary: str) -> pa.Array:
    model, texts = load(vocabulary), arr.to_pylist()
    ids, bounds = model.encode_batch(texts)
    data, cuts = model.decode(ids, bounds)
    same = [data[a:b].tobytes() == t.encode() for a, b, t in zip(cuts[:-1], cuts[1:], texts)]
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
    return pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], fields=list(CHECKED))


def checked_udf(vocabulary: str = BYTE_BPE):
    """text -> token ids, and whether they decode to the text."""
    def run(text: pa.Array) -> pa.Array:
        return by_chunk(text, functools.partial(_checked, vocabulary=vocabulary), CHECKED, CHUNK)
    return F.arrow_udf(run, "token_ids array<int>, round_trip boolean")


def encode(docs: DataFrame, text: str = "text", out: str = "token_ids", vocabulary: str = BYTE_BPE) -> DataFrame:
    """All columns of ``docs`` and the token ids of the whole text."""
    return docs.withColumn(out, encode_udf(vocabulary)(F.col(f"`{text}`")))


def round_trip(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = BYTE_BPE) -> DataFrame:
    """``keep`` columns, the number of tokens, and the digests of the ids and of
    the bytes that the ids decode to."""
    def run(t: pa.Array) -> pa.Array:
        return by_chunk(t, functools.partial(_digest, vocabulary=vocabulary), DIGEST, CHUNK)
    cols = [F.col(f"`{c}`") for c in keep]
    udf = F.arrow_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(*cols, udf(F.col(f"`{text}`")).alias("_r")).select(*cols, "_r.*")
