"""Toxicity by compression distance with zstandard dictionaries.

Two dictionaries are trained on labelled text, one on toxic and one on ordinary
windows.  A window is a word in its word bounds.  It is compressed with either
dictionary, followed by a short carrier that both hold (zstandard looks for no
match near a block's end, which would hide a gain); a window that the toxic
dictionary makes shorter by the share ``gain`` counts as toxic.  The threshold and a logistic curve
over the counts of a document are calibrated on labelled rows, weighted to the
share of toxic rows among all labelled ones.

Most words of a toxic text are ordinary.  The windows that the toxic dictionary
is trained on are those whose beginning is much likelier in toxic rows than in
ordinary ones (``LOG_ODDS``), counted over rows.

Learning takes at most ``ROWS_PER_CLASS`` labelled rows of each class to the
driver; scoring is one Arrow UDF over every whole text, without a shuffle.  Only
the text enters a score.

Defined results: null and empty texts get the score of a text without toxic
windows; without labelled rows of both classes every score is the toxic share
(0 if nothing is labelled); several labels of a row count as toxic if one does;
rows with a null id are not learnt from; repeated rows are scored each.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_chunk, held_out, learnable, sample_rows

ROWS_PER_CLASS = 2_000         # labelled rows of each class that are learnt from
MIN_ROWS, LOG_ODDS = 5, 3.0    # a toxic beginning: in so many toxic rows, so much likelier
HEAD = range(3, 9)             # letters of a beginning
DICT_BYTES, ORDINARY_BYTES = 16_384, 524288
LEAST_BYTES, LEAST_LETTERS = 2, 4   # a smaller gain, or that of a shorter word, is none
GAINS = (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5)   # thresholds to choose from
LEVEL = 12
MEMO = 500_000                 # distinct words whose lengths a worker keeps
CARRIER = b" |0123456789/ABCDEFGHIJKLMNOPQRSTUVWXYZ| "
WORD = re.compile(r"[^\W\d_]+")
OUT = pa.struct([("score", pa.float64()), ("n_windows", pa.int64()), ("n_toxic", pa.int64())])


def windows(text: str) -> list[str]:
    """The words of the whole text in lower case."""
    return WORD.findall(text.lower())


def toxic_words(rows: list[tuple[str, int]]) -> list[str]:
    """Words of the toxic rows, as often as they come, with a beginning that is
    much likelier in toxic rows than in ordinary ones."""
    in_rows, n = (Counter(), Counter()), [0, 0]
    kinds = [(set(windows(t)), y) for t, y in rows]
    for words, y in kinds:
        n[y] += 1
        in_rows[y].update({w[:k] for w in words for k in HEAD if k <= len(w)})
    heads = {h for h, c in in_rows[1].items() if c >= MIN_ROWS and math.log(
        (c + 0.5) / (n[1] + 1) * (n[0] + 1) / (in_rows[0][h] + 0.5)) >= LOG_ODDS}
    return [w for t, y in rows if y for w in windows(t) if any(w[:k] in heads for k in HEAD)]


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Dictionary content by zstandard's trainer; the samples themselves, the
    most frequent ones last, if there are too few of them to train on."""
    try:
        content = zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        content = b""
    frequent = b"".join(s for s, _ in reversed(Counter(samples).most_common(size // 16)))
    return (content + frequent)[-2 * size:] + CARRIER


class Model:
    """Two dictionaries, the threshold and the curve."""

    def __init__(self, toxic: bytes, ordinary: bytes, gain: float, weights: tuple[float, ...]):
        self.params = (toxic, ordinary, gain, weights)
        self.gain, self.weights = gain, np.array(weights)
        self.by = [self._compressor(d) for d in (ordinary, toxic)]
        self.alone = [len(c.compress(CARRIER)) for c in self.by]
        self.memo: dict[str, float] = {}

    @staticmethod
    def _compressor(content: bytes):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False,
                                        write_dict_id=False)

    def gains(self, words: list[str]) -> np.ndarray:
        """Share of a word's compressed length that the toxic dictionary saves over
        the ordinary one, negative if it needs more."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list(dict.fromkeys(w for w in words if w not in self.memo))
        for i in range(0, len(new), 50_000):
            part = [b" " + w.encode() + b" " + CARRIER for w in new[i:i + 50_000]]
            a, b = (c.multi_compress_to_buffer(part, threads=0) for c in self.by)
            a, b = (np.fromiter(map(len, x), float, len(part)) - n for x, n in zip((a, b), self.alone))
            few = np.fromiter(map(len, new[i:i + 50_000]), int, len(part)) < LEAST_LETTERS
            a = np.where(few | (np.abs(a - b) < LEAST_BYTES), b, a)
            self.memo.update(zip(new[i:i + 50_000], ((a - b) / np.maximum(np.maximum(a, b), 1)).tolist()))
        return np.fromiter(map(self.memo.__getitem__, words), float, len(words))

    def features(self, counts: np.ndarray) -> np.ndarray:
        """Of (toxic windows, distinct toxic windows, windows) by document."""
        n, kinds, total = counts.T.astype(float)
        return np.stack([np.ones_like(n), n > 0, kinds > 1, np.log1p(kinds), np.log1p(n), n / np.maximum(total, 20)], 1)

    def counts(self, texts: list[str], gain: float | None = None) -> np.ndarray:
        out = np.zeros((len(texts), 3), np.int64)
        for i, t in enumerate(texts):
            words = windows(t)
            hit = np.flatnonzero(self.gains(words) >= (self.gain if gain is None else gain))
            out[i] = len(hit), len({words[k] for k in hit}), len(words)
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        c = self.counts(texts)
        return 1 / (1 + np.exp(-np.clip(self.features(c) @ self.weights, -30, 30))), c

    def run(self, arr: pa.Array) -> pa.Array:
        s, c = self.score(arr.to_pylist())
        return pa.StructArray.from_arrays([pa.array(s), pa.array(c[:, 2]), pa.array(c[:, 0])], fields=list(OUT))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (y - p)) - ridge * np.r_[0, b[1:]]
        h = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.diag(np.r_[1e-6, np.ones(len(b) - 1)])
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def loss(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> float:
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ b, -30, 30))), 1e-9, 1 - 1e-9)
    return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())


def fit(rows: list[tuple[str, int]], share: float) -> Model:
    """Dictionaries from two thirds of the rows; threshold and curve from the other
    third, whose texts the dictionaries haven't seen."""
    y = np.array([r[1] for r in rows], float)

    def dictionaries(part):
        bad = [b" " + w.encode() + b" " for w in toxic_words(part)]
        kinds = set(bad)
        good = [b" " + w.encode() + b" " for t, y in part if not y for w in windows(t)]
        good = [g for g in good if g not in kinds]
        return train_dictionary(bad), train_dictionary(good[:: max(1, len(good) // 400_000)], ORDINARY_BYTES)

    if not len(y) or y.min() == y.max():
        return Model(CARRIER, CARRIER, 2.0, (math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0, 0, 0, 0, 0))
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    third = np.arange(len(rows)) % 3 == 2
    content = dictionaries([r for r, t in zip(rows, third) if not t])
    model = Model(*content, 0.0, (0,) * 6)
    texts = [r[0] for r, t in zip(rows, third) if t]
    tries = []
    for gain in GAINS:
        x = model.features(model.counts(texts, gain))
        b = logistic(x, y[third], weight[third])
        tries.append((loss(x, y[third], weight[third], b), gain, tuple(b)))
    return Model(*content, *min(tries)[1:])


@functools.lru_cache(1)
def load(params: tuple) -> Model:
    return Model(*params)


def labelled_rows(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS
                  ) -> tuple[list[tuple[str, int]], float]:
    """A bounded sample of learnable (text, label) rows in the order of a hash of
    the id, and the share of toxic rows among all learnable labelled ids."""
    lab = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isNotNull()) \
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in lab.groupBy("y").count().collect()}
    chosen = sample_rows(lab, ["y"], [F.xxhash64("doc_id"), F.col("doc_id")], rows_per_class)
    # copies of a row go in Spark, so an id that is repeated very often comes once
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").distinct().collect()
    rows = sorted({(r["doc_id"], r["text"] or "", r["y"]) for r in got}, key=lambda r: (hash_id(r[0]), r))
    return [(t, int(y > 0)) for _, t, y in rows], sum(c for y, c in n.items() if y > 0) / max(1, sum(n.values()))


def hash_id(i: int) -> int:
    """A fixed shuffle of ids, so that classes and copies mix."""
    return (int(i) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str], text: str = "text",
             rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """``keep`` columns, score, windows and toxic windows of every row, with a
    model learnt from the labelled rows that aren't held out."""
    params = fit(*labelled_rows(docs, labels, rows_per_class)).params
    cols = [F.col(f"`{c}`") for c in keep]

    def run(t: pa.Array) -> pa.Array:
        return by_chunk(t, load(params).run, OUT)
    udf = F.arrow_udf(run, "score double, n_windows long, n_toxic long")
    return docs.select(*cols, udf(F.col(f"`{text}`")).alias("_s")).select(*cols, "_s.*") \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


__all__ = ["toxicity", "fit", "labelled_rows", "held_out", "Model"]
