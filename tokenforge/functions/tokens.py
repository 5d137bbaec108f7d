"""Column functions over token arrays (``ARRAY<INT>``), all JVM-side but ``masked_sample``.

Conventions (SURVEY 7.7): code-point token ids, ``eos = pad = 0``, ``bos = 1``,
ignore label ``-100``.  Every function takes and returns ``Column``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let

IGNORE = -100
SLICE_BYTES = 1 << 20          # of text that one step of masked_sample works on


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def int_array(values) -> Column:
    """Literal ``ARRAY<INT>``."""
    vals = list(values)
    if not vals:
        return F.array().cast("array<int>")
    return F.array(*[F.lit(int(v)) for v in vals]).cast("array<int>")


def codepoints(text, max_len: int | None = None) -> Column:
    """Code-point tokenizer (Y1): one id per Unicode code point.

    With ``max_len`` the text is cut to ``max_len`` code points before it is
    split.  For this tokenizer one character is exactly one token, so the
    result equals tokenizing the whole text and keeping the head (K5).
    """
    t = _c(text)
    if max_len is not None:
        t = F.substring(t, 1, max_len)
    ids = F.transform(F.split(t, ""), lambda ch: F.ascii(ch))
    return F.when(F.length(t) == 0, int_array([])).otherwise(ids.cast("array<int>"))


def decode_codepoints(ids) -> Column:
    """Inverse of :func:`codepoints` (Y4) through a UTF-32 byte string."""
    hexes = F.transform(_c(ids), lambda i: F.lpad(F.hex(i), 8, "0"))
    return F.decode(F.unhex(F.array_join(hexes, "")), "utf-32")


def pad_trunc(ids, n: int, pad=0) -> Column:
    """Keep the head ``n`` ids and right-pad with ``pad`` to exactly ``n`` (K5+Y5)."""
    a = F.slice(_c(ids), 1, n)
    fill = F.array_repeat(_lit(pad).cast("int"), F.greatest(F.lit(0), F.lit(n) - F.size(a)))
    return F.concat(a, fill)


def pad_to(ids, n, pad=0) -> Column:
    """Right-pad to a (per-row) length ``n`` without truncating."""
    a = _c(ids)
    n = _lit(n)
    fill = F.array_repeat(_lit(pad).cast("int"), F.greatest(F.lit(0), n - F.size(a)))
    return F.concat(a, fill)


def shift_left(ids, fill=0) -> Column:
    """``labels[i] = ids[i+1]``, last = ``fill`` (W1); same length as ``ids``."""
    a = _c(ids)
    return F.when(F.size(a) == 0, a).otherwise(
        F.concat(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(1))),
                 F.array(_lit(fill).cast("int"))))


def xy_split(ids) -> tuple[Column, Column]:
    """``x = ids[:-1]``, ``y = ids[1:]``."""
    a = _c(ids)
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return (F.when(n == 0, int_array([])).otherwise(F.slice(a, 1, n)),
            F.when(n == 0, int_array([])).otherwise(F.slice(a, 2, n)))


def mask_where_input(ids, labels, token=0, fill=IGNORE) -> Column:
    """Labels set to ``fill`` wherever the input id equals ``token``."""
    return F.zip_with(_c(ids), _c(labels),
                      lambda i, l: F.when(i == _lit(token), F.lit(fill)).otherwise(l))


def replace_value(ids, old, new) -> Column:
    """Replace every ``old`` by ``new`` (inputs eos -> pad in Y7)."""
    return F.transform(_c(ids), lambda i: F.when(i == _lit(old), _lit(new)).otherwise(i))


def real_len(ids, eos=0) -> Column:
    """Size minus the trailing run of ``eos`` (Y12); all-eos gives 0."""
    a = _c(ids)
    first_real = F.array_position(
        F.transform(F.reverse(a), lambda x: x != _lit(eos)), True)
    return F.when(first_real == 0, F.lit(0)).otherwise(
        F.size(a) - first_real + 1).cast("int")


def not_equal_mask(ids, pad=0) -> Column:
    """Attention mask ``id != pad`` as 0/1 ints."""
    return F.transform(_c(ids), lambda i: F.when(i != _lit(pad), 1).otherwise(0))


def prefix_mask(n, keep) -> Column:
    """``mask[:keep] = 1`` over ``n`` positions (Y21); ``n`` may differ by row."""
    ones = F.greatest(F.least(_lit(keep), _lit(n)), F.lit(0)).cast("int")
    return F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), (_lit(n) - ones).cast("int")))


def collate(ids, labels, max_len: int, labels_from_ids: bool = False) -> tuple[Column, Column]:
    """Stored samples cut to ``max_len`` (Y18, Q4): the stored labels, or the ids again
    with ``labels_from_ids``."""
    a = F.slice(_c(ids), 1, max_len)
    return a, a if labels_from_ids else F.slice(_c(labels), 1, max_len)


def digest_ints(arr) -> Column:
    """md5 of an int array rendered as text: a whole array, compared by 32 characters."""
    return F.md5(join_ints(arr).cast("binary"))


def count_not(arr, value) -> Column:
    """Number of elements different from ``value``."""
    return F.size(F.filter(_c(arr), lambda x: x != _lit(value)))


def count_eq(arr, value) -> Column:
    return F.size(F.filter(_c(arr), lambda x: x == _lit(value)))


def int_sum(arr) -> Column:
    """Sum of an int array as BIGINT."""
    return F.aggregate(_c(arr), F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def join_ints(arr, sep: str = ",") -> Column:
    """Array of ints rendered as text, for engine-neutral comparison."""
    return F.array_join(F.transform(_c(arr), lambda x: x.cast("string")), sep)


def slice_window(ids, offset, length) -> Column:
    """``get(idx, offset, length)`` of a token store item."""
    return F.slice(_c(ids), _lit(offset) + 1, _lit(length))


def head_cut(ids, length) -> Column:
    """``only(idx, length)``: the item cut to ``min(size, length)``."""
    a = _c(ids)
    return F.slice(a, 1, F.least(F.size(a), _lit(length)))


def _digests(at: np.ndarray, ids: np.ndarray) -> list[str]:
    """:func:`digest_ints` of the lists that begin and end at ``at``."""
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids).cast(pa.string())), ",")
    return [hashlib.md5(t.as_buffer()).hexdigest() for t in texts]


def _masked(texts: list[str], step: int, eos: int, pad: int) -> tuple[np.ndarray, list[str], list[str], np.ndarray]:
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    size = -(-(n + 1) // step) * step
    at, fro = np.r_[0, np.cumsum(size)], np.cumsum(n) - n
    ids = np.full(at[-1], eos, np.int32)
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
    ids[np.arange(len(cp)) + np.repeat(at[:-1] - fro, n)] = cp
    labels = np.r_[ids[1:], np.int32(eos)]
    labels[at[1:] - 1] = eos
    end = ids == eos
    labels[end] = IGNORE
    masked = np.r_[0, np.cumsum(labels == IGNORE)][at]
    inputs = np.where(end, np.int32(pad), ids)
    return size, _digests(at, inputs), _digests(at, labels), np.diff(masked)


def masked_sample(text, step: int, eos: int = 0, pad: int = 0) -> Column:
    """Whole texts as samples of their own length: code points, ``eos`` appended and
    repeated to a multiple of ``step``, labels shifted and ``IGNORE`` where the input is
    ``eos``, inputs ``eos`` -> ``pad`` (Y7).  Returns the size, the digests of inputs and
    labels and the number of ignored labels; a null text gives nulls.

    The same as the functions above, one after the other; but their lambdas are
    interpreted id by id, and here Arrow batches are worked on in slices of about
    ``SLICE_BYTES``, whose arrays never leave the task's memory.
    """
    kind = pa.struct([("n", pa.int64()), ("input_ids_md5", pa.string()), ("labels_md5", pa.string()), ("n_masked", pa.int64())])

    def some(texts: pa.Array) -> pa.Array:
        there = texts.is_valid().to_numpy(zero_copy_only=False)
        cols = _masked(texts.drop_null().to_pylist(), step, eos, pad) if there.any() else ([], [], [], [])
        at = pa.array(np.cumsum(there) - 1, mask=~there)
        return pa.StructArray.from_arrays([pa.array(c, f.type).take(at) for c, f in zip(cols, kind)], fields=list(kind))

    def run(texts: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + step)
        parts, i, done = [], 0, 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
            parts.append(some(texts.slice(i, j - i)))
            done, i = int(ends[j - 1]), j
        return pa.concat_arrays(parts) if parts else pa.array([], kind)
    return F.arrow_udf(run, "n long, input_ids_md5 string, labels_md5 string, n_masked long")(_c(text))
