"""Chat -> tokenized training samples (Y8-Y11), one array expression per row.

``tok`` is a Column -> ``ARRAY<INT>`` tokenizer (code points by default).
Role and content are tokenized separately, as the reference does, and ids and
labels are built in one pass over the turns with ``flatten(transform(..))``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.core import let
from ..functions.text import ensure_suffix
from . import turns as TU

Tok = Callable[[Column], Column]
IGN = T.IGNORE


def _ign(n) -> Column:
    return F.array_repeat(F.lit(IGN), n)


def _default_tok(c: Column) -> Column:
    return T.codepoints(c)


def turns_within_budget(rows, key: str, order: str, token_len: Column, max_len: int):
    """Turn rows that can reach a sample cut to ``max_len`` tokens.

    A turn whose first token lies beyond position ``max_len`` of the sample
    body is cut away by truncation, whatever comes before it; dropping such
    turns before the turns are grouped bounds every conversation row by
    about ``max_len`` tokens plus one turn.  The turn that crosses the limit
    is kept, so "longer than max_len" stays true, and one position of margin
    covers label shifts.  Running sums use the skew-safe keyed scan.
    """
    from .ordered import keyed_scan
    d = rows.withColumn("_tl", token_len.cast("long"))
    d = keyed_scan(d, [key], [order], F.col(order), sums={"_cum": F.col("_tl")}, index_col=None)
    return d.where(F.col("_cum") - F.col("_tl") <= max_len).drop("_tl", "_cum")


def messages_builder(turns, max_len: int, tok: Tok = _default_tok, bos: int = 1,
                     eos: int = 0, pad: int = 0) -> tuple[Column, Column]:
    """Builder 1 (Y8): ``[bos]`` + per turn role prefix ids + content ids
    (content ends with a blank line); only assistant content is labelled;
    truncate, shift labels by one with eos last, pad (Q16)."""
    tt = F.transform(turns, lambda t: F.struct(
        (t["role"] == "assistant").alias("a"),
        tok(TU.role_prefix(t["role"])).alias("p"),
        tok(ensure_suffix(t["content"])).alias("c")))
    ids = F.concat(T.int_array([bos]), F.flatten(F.transform(tt, lambda x: F.concat(x["p"], x["c"]))))
    labels = F.concat(T.int_array([IGN]), F.flatten(F.transform(tt, lambda x: F.when(
        x["a"], F.concat(_ign(F.size(x["p"])), x["c"])).otherwise(_ign(F.size(x["p"]) + F.size(x["c"]))))))
    ids = F.slice(ids, 1, max_len)
    labels = F.slice(labels, 1, max_len)
    labels = F.concat(F.slice(labels, 2, max_len), T.int_array([eos]))
    return T.pad_trunc(ids, max_len, pad), T.pad_trunc(labels, max_len, IGN)


def template_builder(turns, max_len: int, is_llama: bool = False, tok: Tok = _default_tok,
                     bos: int | None = 1, pad: int = 0, shift: int | None = None) -> tuple[Column, Column]:
    """Builder 2 (Y9): per-turn training wrappers; user turns masked, every
    other role labelled; then truncate, or pad ids with pad / labels with -100.

    ``shift`` 0 labels each id with itself, 1 with the next id (for a trainer that
    doesn't shift), 2 with the one after.  None does as the reference: 2 with a bos
    id, 0 without one (quirk Q5)."""
    k = (2 if bos is not None else 0) if shift is None else shift
    tt = F.transform(turns, lambda t: F.struct(
        (t["role"] == "user").alias("u"),
        tok(TU.train_wrapper(t["role"], t["content"], is_llama)).alias("c")))
    ids = F.flatten(F.transform(tt, lambda x: x["c"]))
    labels = F.flatten(F.transform(tt, lambda x: F.when(x["u"], _ign(F.size(x["c"]))).otherwise(x["c"])))
    if bos is not None:
        ids = F.concat(T.int_array([bos]), ids)
        labels = F.concat(T.int_array([IGN]), labels)
    labels = F.concat(F.slice(labels, k + 1, 1 << 30), T.int_array([IGN] * k)) if k else labels
    out_ids = let(ids, lambda a: F.when(F.size(a) > max_len, F.slice(a, 1, max_len))
                  .otherwise(T.pad_to(a, max_len, pad)))
    out_lab = let(F.struct(F.size(ids).alias("n"), labels.alias("l")), lambda r: F.when(
        r["n"] > max_len, F.slice(r["l"], 1, max_len)).otherwise(T.pad_to(r["l"], max_len, IGN)))
    return out_ids, out_lab


def from_value_builder(conversations, max_len: int, tok: Tok = _default_tok, bos: int = 1,
                       eos: int = 0) -> tuple[Column, Column]:
    """Builder 3 (Y10): ``human``/``gpt`` values, no role text, content ends
    with a blank line; ``gpt`` labelled; labels end with eos; cut both to
    ``max_len`` (no padding; see :func:`..functions.tokens.pad_to`)."""
    tt = F.transform(conversations, lambda c: F.struct(
        (c["from"] == "gpt").alias("g"), tok(ensure_suffix(c["value"])).alias("c")))
    ids = F.concat(T.int_array([bos]), F.flatten(F.transform(tt, lambda x: x["c"])))
    labels = F.concat(F.flatten(F.transform(tt, lambda x: F.when(x["g"], x["c"]).otherwise(_ign(F.size(x["c"]))))),
                      T.int_array([eos]))
    return _cut_pair(ids, labels, max_len)


def _cut_pair(ids: Column, labels: Column, max_len: int) -> tuple[Column, Column]:
    """Cut ids and labels to ``max_len`` when the ids are longer (each built once)."""
    ids_out = let(ids, lambda a: F.when(F.size(a) > max_len, F.slice(a, 1, max_len)).otherwise(a))
    lab_out = let(F.struct(F.size(ids).alias("n"), labels.alias("l")), lambda r: F.when(
        r["n"] > max_len, F.slice(r["l"], 1, max_len)).otherwise(r["l"]))
    return ids_out, lab_out


ROLE_INLINE = {"user": "User : ", "assistant": "Assistant : ", "system": "System : "}


def role_text_builder(turns, max_len: int, tok: Tok = _default_tok, bos: int = 1,
                      eos: int = 0) -> tuple[Column, Column]:
    """Builder 4 (Y11): role prefix inside the content (so the assistant prefix
    is labelled too), content ends with a blank line, labels end with eos,
    cut both to ``max_len``."""
    def content(t):
        pre = F.coalesce(*[F.when(t["role"] == k, F.lit(v)) for k, v in ROLE_INLINE.items()], F.lit(""))
        return ensure_suffix(F.concat(pre, t["content"]))
    tt = F.transform(turns, lambda t: F.struct((t["role"] == "assistant").alias("a"), tok(content(t)).alias("c")))
    ids = F.concat(T.int_array([bos]), F.flatten(F.transform(tt, lambda x: x["c"])))
    labels = F.concat(F.flatten(F.transform(tt, lambda x: F.when(x["a"], x["c"]).otherwise(_ign(F.size(x["c"]))))),
                      T.int_array([eos]))
    return _cut_pair(ids, labels, max_len)


def with_span_mask(df: DataFrame, seq: str, min_len: Column, start_marker: list[int],
                   stop_marker: list[int], n: int | Column, out: str) -> DataFrame:
    """Loss mask between token markers.

    Over positions ``0..n-1``: a match of ``stop_marker`` (e.g. ``User:``)
    switches the mask off, a match of ``start_marker`` (``Assistant:``) on; the
    value carries forward; a match must fit inside ``min_len``; positions from
    ``min_len`` on are 0; position 0 is dropped from the result.
    """
    t_off, t_on = T.int_array(stop_marker), T.int_array(start_marker)
    n = n if isinstance(n, Column) else F.lit(n)

    def events(s, ml):
        return F.transform(_positions(n), lambda i: F.when(
            (i <= ml - len(stop_marker)) & (F.slice(s, i + 1, len(stop_marker)) == t_off), F.lit(0))
            .when((i <= ml - len(start_marker)) & (F.slice(s, i + 1, len(start_marker)) == t_on), F.lit(1)))

    def mask(ml):
        return let(_carry(let(F.col(seq), lambda s: events(s, ml))), lambda c: F.slice(
            F.transform(c, lambda v, i: F.when(i >= ml, F.lit(0)).otherwise(v)), F.lit(2), F.greatest(n - 1, F.lit(0))))
    return df.withColumn(out, let(min_len, mask))


def _positions(n: Column) -> Column:
    """0 .. n - 1, also for n = 0."""
    return F.filter(F.sequence(F.lit(0), n), lambda i: i < n)


def _carry(ev: Column) -> Column:
    """Last non-null value at or before each position, else 0 (carry forward).

    The positions with a value cut the row into runs, each one repeated value: linear
    in the length, however many values there are."""
    def runs(e):
        at = F.filter(F.sequence(F.lit(0), F.size(e)), lambda i: F.try_element_at(e, i + 1).isNotNull())

        def fill(starts):
            head = F.array_repeat(F.lit(0), F.coalesce(F.try_element_at(starts, F.lit(1)), F.size(e)))
            rest = F.transform(starts, lambda i, j: F.array_repeat(
                F.element_at(e, i + 1), F.coalesce(F.try_element_at(starts, j + 2), F.size(e)) - i))
            return F.concat(head, F.flatten(rest))
        return let(at, fill)
    return let(ev, runs)


def _marker_events(s: Column, marker: list[int], off_token: int, n: Column) -> Column:
    m = len(marker)
    t = T.int_array(marker)
    # the reference tests "on" before "off" at the same position, so off wins
    return let(s, lambda q: F.transform(_positions(n), lambda i: F.when(
        i < m - 1, F.lit(None)).when(F.try_element_at(q, i + 1) == off_token, F.lit(0))
        .when(F.slice(q, F.greatest(i - m + 2, F.lit(1)), m) == t, F.lit(1))))


def with_marker_mask(df: DataFrame, seq: str, marker: list[int], off_token: int, n: int | Column,
                     out: str, fallback: str = "fallback") -> DataFrame:
    """QA mask (W13): on after the last token of ``marker``, off at
    ``off_token``, for positions ``len(marker)-1 .. n-1``.  When it is never
    on the mask is all ones and ``fallback`` is true (the reference then swaps
    in a sample from another source)."""
    n = n if isinstance(n, Column) else F.lit(n)
    d = df.withColumn("_mm_ev", _marker_events(F.col(seq), marker, off_token, n))
    d = d.withColumn(fallback, ~F.exists("_mm_ev", lambda x: F.coalesce(x == 1, F.lit(False))))
    d = d.withColumn("_mm_z", _carry(F.col("_mm_ev")))
    d = d.withColumn(out, F.when(F.col(fallback), F.array_repeat(F.lit(1), n)).otherwise(F.col("_mm_z")))
    return d.drop("_mm_ev", "_mm_z")


def replace_fallback(masked: DataFrame, key: str, order: str, others: DataFrame, cols: list[str], fallback: str = "fallback",
                     rows: int | None = None) -> DataFrame:
    """The rows flagged ``fallback`` with ``cols`` of another source's rows.

    The k-th flagged row, by ``order``, takes row k of ``others`` (numbered by its column
    ``idx``), beginning again where they run out; without others the row stays as it is.
    Both sides are numbered by the skew-safe index and meet on the number."""
    from .ordered import keyed_index
    n = others.count() if rows is None else rows
    if not n:
        return masked
    flagged = masked.where(F.col(fallback)).select(F.col(key).alias("_key"), F.col(order).alias("_order"))
    flagged = keyed_index(flagged, [], ["_order", "_key"], name="_n")
    given = flagged.withColumn("idx", F.pmod("_n", F.lit(n))).join(
        others.select("idx", *[F.col(c).alias(f"_o_{c}") for c in cols]), "idx").drop("idx", "_n", "_order")
    d = masked.join(given, F.col(key).eqNullSafe(F.col("_key")), "left")
    return d.select(*[F.when(F.col(fallback), F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
                      for c in masked.columns])
