"""Scores, losses and vector maths over score arrays.

Per-position tensors (T5) are rows: one row per (sample, position) with the
score vector as ``ARRAY<FLOAT>`` (or exploded by vocabulary block when the
vocabulary is too wide for one row, see :func:`blocked_logsumexp`).  All maths
runs in double precision inside JVM expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let

IGNORE = -100


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(arr) -> Column:
    return F.transform(_c(arr), lambda v: v.cast("double"))


def dsum(arr) -> Column:
    """Left-to-right sum of a double array."""
    return F.aggregate(_c(arr), F.lit(0.0).cast("double"), lambda a, v: a + v)


def logsumexp(arr) -> Column:
    """``max + ln(sum(exp(x - max)))`` (stable); array and max evaluated once."""
    return let(_c(arr), lambda a: let(F.array_max(a), lambda m: m + F.log(
        F.aggregate(a, F.lit(0.0).cast("double"), lambda s, v: s + F.exp(v - m)))))


def softmax(arr, lse: Column | None = None) -> Column:
    return let(_c(arr), lambda a: let(lse if lse is not None else logsumexp(a),
                                      lambda z: F.transform(a, lambda v: F.exp(v - z))))


def log_softmax(arr, lse: Column | None = None) -> Column:
    return let(_c(arr), lambda a: let(lse if lse is not None else logsumexp(a),
                                      lambda z: F.transform(a, lambda v: v - z)))


def cross_entropy(arr, label, lse: Column | None = None) -> Column:
    """``lse(x) - x[label]``; null for the ignore label (M2)."""
    a, y = _c(arr), _c(label)
    z = lse if lse is not None else logsumexp(a)
    return F.when(y == IGNORE, F.lit(None)).otherwise(z - F.element_at(a, y + 1))


def cross_entropy_smooth(arr, label, smoothing: float, scale: float = 1.0,
                         z_coef: float = 0.0) -> tuple[Column, Column]:
    """Label smoothing, logit scale and z-loss (M3).

    With ``z = scale * x`` and ``V`` classes:
    ``loss = lse(z) - smoothing * sum(z) / V - (1 - smoothing) * z[label] + z_coef * lse(z)^2``.
    Returns ``(loss, z_loss)``; both null for the ignore label.
    """
    a, y = _c(arr), _c(label)
    z = F.transform(a, lambda v: v * F.lit(scale))
    lse = logsumexp(z)
    zl = F.lit(z_coef) * lse * lse
    loss = let(z, lambda zz: let(logsumexp(zz), lambda l: (
        l - F.lit(smoothing) * dsum(zz) / F.size(zz)
        - F.lit(1.0 - smoothing) * F.element_at(zz, y + 1) + F.lit(z_coef) * l * l)))
    ign = y == IGNORE
    return F.when(ign, F.lit(None)).otherwise(loss), F.when(ign, F.lit(None)).otherwise(zl)


def kl_div(teacher_logits, student_logits) -> Column:
    """``KL(softmax(t) || softmax(s)) = sum p_t (log p_t - log p_s)`` (M5, M6);
    terms with ``p_t = 0`` contribute 0."""
    t, s = _c(teacher_logits), _c(student_logits)
    lt, ls = log_softmax(t), log_softmax(s)
    return F.aggregate(F.arrays_zip(lt, ls).cast("array<struct<a:double,b:double>>"), F.lit(0.0).cast("double"),
                       lambda acc, r: acc + F.when(F.exp(r["a"]) == 0, F.lit(0.0))
                       .otherwise(F.exp(r["a"]) * (r["a"] - r["b"])))


def argmax(arr) -> tuple[Column, Column]:
    """``(max, index of its first occurrence, 0-based)``."""
    a = _c(arr)
    m = F.array_max(a)
    return m, (F.array_position(a, m) - 1).cast("long")


def l2_normalize(arr, eps: float = 1e-6) -> Column:
    """``x / sqrt(sum(x^2) + eps)``."""
    return let(_c(arr), lambda a: let(
        F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda s, v: s + v * v) + F.lit(eps)),
        lambda r: F.transform(a, lambda v: v / r)))


def nucleus(arr, top_p: float, temperature: float = 1.0) -> Column:
    """Top-p filter of ``softmax(x)``.

    Sort probabilities descending, cutoff = the probability at the first
    position whose cumulative sum exceeds ``top_p`` (position 0 if none does),
    zero every probability below the cutoff, raise to ``1/temperature`` and
    renormalise.  Returns the filtered distribution in the original order.
    """
    def with_p(p):
        def with_sorted(srt):
            # one fold with a scalar state: the sum so far, positions seen, the first above top_p
            init = F.struct(F.lit(0.0).cast("double").alias("s"), F.lit(0).alias("n"), F.lit(0).alias("at"))
            first = F.aggregate(srt, init, lambda acc, v: F.struct(
                (acc["s"] + v).alias("s"), (acc["n"] + 1).alias("n"),
                F.when((acc["at"] == 0) & (acc["s"] + v > F.lit(top_p)), acc["n"] + 1).otherwise(acc["at"]).alias("at")),
                lambda acc: acc["at"])
            cutoff = F.element_at(srt, F.greatest(first, F.lit(1)))

            def with_cutoff(cut):
                kept = F.transform(p, lambda v: F.when(v < cut, F.lit(0.0)).otherwise(
                    F.pow(v, F.lit(1.0 / temperature)) if temperature != 1.0 else v))
                return let(kept, lambda k: let(dsum(k), lambda tot: F.transform(k, lambda v: v / tot)))
            return let(cutoff, with_cutoff)
        return let(F.reverse(F.array_sort(p)), with_sorted)
    return let(softmax(arr), with_p)


def blocked_logsumexp(rows: DataFrame, key: str, pos: str, value: str, block: int) -> DataFrame:
    """Logsumexp of exploded score rows via per-block partials (M4).

    Stage 1 groups by ``(key, pos div block)`` - at most ``block`` values per
    group - into ``(max, sum exp(x - max))``; stage 2 merges the partials per
    key as ``m + ln(sum(s_b * exp(m_b - m)))``.  A very wide vocabulary is
    spread over many rows and tasks, never held in one.
    """
    blk = (rows.groupBy(key, F.floor(F.col(pos) / block).alias("_blk"))
           .agg(F.collect_list(F.col(value).cast("double")).alias("_xs"))
           .withColumn("_bm", F.array_max("_xs"))
           .withColumn("_bs", F.aggregate("_xs", F.lit(0.0).cast("double"),
                                          lambda acc, v: acc + F.exp(v - F.col("_bm")))))
    return (blk.groupBy(key)
            .agg(F.max("_bm").alias("_m"), F.collect_list(F.struct("_bm", "_bs")).alias("_p"))
            .select(key, (F.col("_m") + F.log(F.aggregate(
                "_p", F.lit(0.0).cast("double"),
                lambda acc, r: acc + r["_bs"] * F.exp(r["_bm"] - F.col("_m"))))).alias("lse")))


def chunk_merge_mean(chunks: DataFrame, key: str, mean: str, weight: str) -> DataFrame:
    """Mergeable weighted mean over chunks (A7): the reference's running
    ``old * n0/(n0+n1) + x * n1/(n0+n1)`` equals ``sum(w x) / sum(w)``, which
    is a partial-then-final aggregate.  Chunks whose mean is null are skipped."""
    ok = F.col(mean).isNotNull()
    return chunks.groupBy(key).agg(
        (F.sum(F.when(ok, F.col(mean) * F.col(weight))) / F.sum(F.when(ok, F.col(weight)))).alias("loss"))


def squared_error(a, b) -> Column:
    """Sum of squared differences of two arrays of equal size."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"), lambda s, v: s + v)


def hidden_mse(pairs: DataFrame, group: Sequence[str], position: str, teacher: str, student: str, valid: Column,
               broadcast_masks: bool = False, out: str = "mse") -> DataFrame:
    """Masked hidden-state MSE per group (M8, J6): the mean, over all elements, of the
    squared error, 0 where a position is masked.  One row a (sample, position) with both
    state vectors; nothing is exploded.

    ``broadcast_masks`` reproduces quirk Q10: there every sample's mask meets every
    sample's states, so a state at position t counts as often as samples are valid at t,
    and the mean is over samples times elements."""
    d = pairs.select(*group, F.col(position).alias("_t"), squared_error(teacher, student).alias("_se"),
                     F.size(teacher).alias("_n"), valid.alias("_ok"))
    if not broadcast_masks:
        return d.groupBy(*group).agg((F.sum(F.when(F.col("_ok"), F.col("_se")).otherwise(0.0)) / F.sum("_n")).alias(out))
    at = d.groupBy(*group, "_t").agg(F.sum("_se").alias("_se"), F.sum("_n").alias("_n"), F.count_if("_ok").alias("_w"),
                                     F.count(F.lit(1)).alias("_b"))
    return at.groupBy(*group).agg((F.sum(F.col("_se") * F.col("_w")) / (F.max("_b") * F.sum("_n"))).alias(out))
