"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k | text) = sigmoid(threshold_k - w.x): one weight vector over hashed
text features is shared by all grades, and ordered thresholds cut its scale.
Features of a whole text are its words, its word shapes (runs of one character
class as one) and repeats of the word before, each hashed to ``DIM`` places with
log counts scaled to unit length.

Learning takes at most ``ROWS_PER_GRADE`` rated rows of each grade to the driver;
scoring is one Arrow UDF over the text column without a shuffle.

Defined results: null and empty texts get the scores of a text without words;
with fewer than two grades rated every text gets the only grade (0 if none);
repeated rows are scored each; rows with a null id, or a null rating, are not
learnt from; other columns are neither read nor needed.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, Texts, by_chunk, learnable, mix, sample_rows, span_hashes

ROWS_PER_GRADE = 2_000
DIM = 1 << 15
STEPS, RATE, RIDGE = 150, 0.05, 1e-4

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x30:0x3A] = ord("9")
_CLASS[0x41:0x5B] = ord("A")
_CLASS[0x61:0x7B] = ord("a")
_CLASS[0x80:] = ord("a")


def features(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, value) of the features of whole texts."""
    t = Texts(arr)
    starts, ends, doc = t.words(WS)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0)
    word = span_hashes(t.data, starts, ends)
    shape_bytes = _CLASS[t.data]
    first = np.ones(len(shape_bytes), bool)
    first[1:] = shape_bytes[1:] != shape_bytes[:-1]
    first[starts] = True
    place = np.zeros(len(first) + 1, np.int64)
    np.cumsum(first, out=place[1:])
    shape = span_hashes(shape_bytes[first], place[starts], place[ends])
    again = np.flatnonzero((word[1:] == word[:-1]) & (doc[1:] == doc[:-1])) + 1
    d = np.concatenate([doc, doc, doc[again]])
    h = np.concatenate([word, mix(shape + np.uint64(1)), np.full(len(again), mix(np.uint64([7]))[0])])
    key = d * DIM + (h % np.uint64(DIM)).astype(np.int64)
    key, n = np.unique(key, return_counts=True)
    d, value = key // DIM, np.log1p(n)
    norm = np.sqrt(np.bincount(d, weights=value ** 2, minlength=t.n))
    return d, key % DIM, value / norm[d]


class Model:
    """Weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def probabilities(self, arr: pa.Array) -> np.ndarray:
        d, place, value = features(arr)
        z = np.bincount(d, weights=self.weights[place] * value, minlength=len(arr))
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - z[:, None], -30, 30)))
        return np.diff(np.c_[np.zeros(len(z)), below, np.ones(len(z))], axis=1)


def fit(texts: list[str], grades: np.ndarray, n_grades: int, weight: np.ndarray | None = None) -> Model:
    """Adam on the weighted cumulative-link likelihood."""
    if len(set(grades.tolist())) < 2:
        only = int(grades[0]) if len(grades) else 0
        return Model(np.zeros(DIM), np.where(np.arange(n_grades - 1) < only, -30.0, 30.0))
    parts = [features(pa.array(texts[i:i + 500], pa.string())) for i in range(0, len(texts), 500)]
    d = np.concatenate([p[0] + 500 * k for k, p in enumerate(parts)])
    place, value = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    weight = np.ones(len(grades)) if weight is None else weight
    weight = weight / weight.sum()
    w, cuts = np.zeros(DIM), np.r_[-1.0, np.zeros(n_grades - 2)]     # first threshold, log gaps
    m = [np.zeros_like(w), np.zeros_like(cuts)]
    v = [np.zeros_like(w), np.zeros_like(cuts)]
    for step in range(1, STEPS + 1):
        gaps = np.exp(cuts[1:])
        th = np.r_[-np.inf, cuts[0] + np.r_[0, np.cumsum(gaps)], np.inf]
        z = np.bincount(d, weights=w[place] * value, minlength=len(grades))
        hi, lo = (1 / (1 + np.exp(-np.clip(th[grades + k] - z, -30, 30))) for k in (1, 0))
        p = np.maximum(hi - lo, 1e-9)
        g_hi, g_lo = hi * (1 - hi) * (np.isfinite(th[grades + 1])), lo * (1 - lo) * (np.isfinite(th[grades]))
        dz = weight * (g_hi - g_lo) / p                          # of -log p by z
        g_w = np.bincount(place, weights=dz[d] * value, minlength=DIM) + RIDGE * w
        g_th = np.zeros(n_grades + 1)
        np.add.at(g_th, grades + 1, -weight * g_hi / p)
        np.add.at(g_th, grades, weight * g_lo / p)
        g_th = g_th[1:-1]
        g_cut = np.r_[g_th.sum(), [g_th[k + 1:].sum() * gaps[k] for k in range(n_grades - 2)]]
        for k, (x, g) in enumerate(((w, g_w), (cuts, g_cut))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            x -= RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    return Model(w, cuts[0] + np.r_[0, np.cumsum(np.exp(cuts[1:]))])


def grade(quality: Column, toxic: Column) -> Column:
    """The rating that the labels give: 0 poor, 1 fair but toxic, 2 good."""
    return F.when(quality == 0, 0).when(quality.isNull(), None).when(toxic == 1, 1).otherwise(2)


GRADES = 3


def rated_rows(docs: DataFrame, ratings: DataFrame, rows_per_grade: int = ROWS_PER_GRADE
               ) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A bounded sample of learnable rows of (doc_id, grade), the lowest grade of
    an id, and weights that restore the grades' shares among all rated ids."""
    r = ratings.where(learnable(F.col("doc_id")) & F.col("grade").isNotNull()) \
        .groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    n = {x["grade"]: x["count"] for x in r.groupBy("grade").count().collect()}
    chosen = sample_rows(r, ["grade"], [F.xxhash64("doc_id"), F.col("doc_id")], rows_per_grade)
    # copies of a row go in Spark, so an id that is repeated very often comes once
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").distinct().collect()
    rows = sorted({(x["doc_id"], x["text"] or "", x["grade"]) for x in got})
    y = np.array([x[2] for x in rows], np.int64)
    have = np.bincount(y, minlength=GRADES) if len(y) else np.zeros(GRADES)
    return [x[1] for x in rows], y, np.array([n[g] / have[g] for g in y.tolist()])


OUT = pa.struct([("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("grade", pa.int32())])


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, the expected grade, the probability of the best grade and
    the likeliest grade."""
    def chunk(arr: pa.Array) -> pa.Array:
        p = model.probabilities(arr)
        return pa.StructArray.from_arrays(
            [pa.array(p @ np.arange(p.shape[1])), pa.array(p[:, -1]), pa.array(p.argmax(1), pa.int32())],
            fields=list(OUT))

    def run(arr: pa.Array) -> pa.Array:
        return by_chunk(arr, chunk, OUT)
    cols = [F.col(f"`{c}`") for c in keep]
    udf = F.arrow_udf(run, "expected_grade double, tail_probability double, grade int")
    return docs.select(*cols, udf(F.col(f"`{text}`")).alias("_q")).select(*cols, "_q.*")


def quality_model(docs: DataFrame, ratings: DataFrame, keep: list[str], text: str = "text",
                  rows_per_grade: int = ROWS_PER_GRADE, select_at: float = 0.5) -> DataFrame:
    """Learn from the rated rows that aren't held out, score every row;
    ``selected``: the best grade is likelier than ``select_at``."""
    texts, y, w = rated_rows(docs, ratings, rows_per_grade)
    return score(docs, fit(texts, y, GRADES, w), keep, text) \
        .withColumn("selected", F.col("tail_probability") >= select_at)
