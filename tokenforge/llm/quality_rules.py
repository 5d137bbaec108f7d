"""Quality rules by tokeniser fertility.

Public vocabularies measure every whole text: characters per token, the share
of byte-fallback tokens (raw bytes that are no whole characters) and the
entropy of its tokens in bits.  A document is rejected if a measure leaves the
band of its script.  Plain counts stand beside them (word characters, symbols,
repeated lines and repeated three-word windows) with two base rules.

One Arrow UDF over the text column; no shuffle, memory bounded by a slice of
about 4 MB of whole texts.

Defined results: a null or empty text has no words and fails the base rules;
repeated rows are measured each; other columns are neither read nor needed.
Equality of three-word windows rests on 64-bit hashes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, Texts, by_chunk, mix, span_hashes
from .tokenizers import BYTE_BPE, load_encoder

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Script by the lead byte of a UTF-8 character, as (first, last, script).
LEADS = [(0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xC3, 0xC9, "latin"), (0xCE, 0xCF, "greek"),
         (0xD0, 0xD3, "cyrillic"), (0xD6, 0xD7, "hebrew"), (0xD8, 0xDB, "arabic"), (0xE0, 0xE0, "indic"),
         (0xE3, 0xE3, "kana"), (0xE4, 0xE9, "han"), (0xEA, 0xED, "hangul")]
SCRIPTS = ["latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "han", "hangul", "other"]
_SCRIPT_OF = np.full(256, -1, np.int64)
for _a, _b, _s in LEADS:
    _SCRIPT_OF[_a:_b + 1] = SCRIPTS.index(_s)
for _x in (0xCA, 0xCB, 0xCC, 0xCD, 0xD4, 0xD5, *range(0xDC, 0xE0), 0xE1, 0xE2, *range(0xEE, 0xF5)):
    _SCRIPT_OF[_x] = SCRIPTS.index("other")

#: Rejection bands: (least, most) characters per token, most byte-fallback share,
#: least token entropy in bits.  A script without a row of its own takes "other".
BANDS = {
    "latin": (2.00, 9.0, 0.10, 4.8),
    "greek": (0.80, 8.0, 0.60, 4.2),
    "cyrillic": (0.80, 8.0, 0.60, 4.2),
    "han": (0.30, 4.0, 0.90, 4.2),
    "kana": (0.30, 4.0, 0.90, 4.2),
    "hangul": (0.30, 4.0, 0.90, 4.2),
    "other": (0.25, 9.0, 0.95, 4.2),
}

OUT = pa.struct([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                 ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("script", pa.string()),
                 ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()), ("fallback_share", pa.float64()),
                 ("token_entropy", pa.float64())])
OUT_SQL = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, "
           "n_tokens long, chars_per_token double, fallback_share double, token_entropy double")
_BLANK = " \t\n\v\f\r"


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    kinds = set(lines)
    if len(kinds) == len(lines):
        return 0
    blank = {x for x in kinds if not x.strip(_BLANK)}
    return sum(x not in blank for x in lines) - len(kinds) + len(blank)


def repeat_words(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Per document, its words in three-word windows that it holds twice or more."""
    hit = np.zeros(len(h), bool)
    if len(h) >= 3:
        at = np.flatnonzero(doc[:-2] == doc[2:])
        tri = mix(h[at] + mix(h[at + 1] + mix(h[at + 2] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
        order = np.argsort(tri)
        same = tri[order[1:]] == tri[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            hit[at[twice] + k] = True
    return np.bincount(doc[hit], minlength=n)


def fertility(text: str, names: tuple[str, ...]) -> tuple[int, float, float, float]:
    """Tokens of the first vocabulary; least characters per token, most fallback
    share and least entropy over the vocabularies."""
    n, per, share, bits = 0, float("inf"), 0.0, float("inf")
    for k, name in enumerate(names):
        encode, partial = load_encoder(name)
        ids = encode(text)
        if not len(ids):
            return 0, 0.0, 0.0, 0.0
        ordered = np.sort(ids)
        cuts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])
        p = np.diff(cuts) / len(ids)
        n = len(ids) if k == 0 else n
        per, share = min(per, len(text) / len(ids)), max(share, float(partial[ids].mean()))
        bits = min(bits, float(-(p * np.log2(p)).sum()) + 0.0)
    return n, per, share, bits


def _measure(arr: pa.Array, names: tuple[str, ...]) -> pa.Array:
    t = Texts(arr)
    starts, ends, doc = t.words(WS)
    texts = arr.to_pylist()
    chars = (t.data & 0xC0) != 0x80
    lead = _SCRIPT_OF[t.data]
    seen = np.flatnonzero(lead >= 0)
    who = np.searchsorted(t.offsets, seen, "right") - 1
    by = np.bincount(who * len(SCRIPTS) + lead[seen], minlength=t.n * len(SCRIPTS)).reshape(t.n, len(SCRIPTS))
    script = [SCRIPTS[k] if m else "other" for k, m in zip(by.argmax(1), by.max(1, initial=0))]
    tokens, per, share, bits = zip(*(fertility(x, names) for x in texts)) if texts else ((), (), (), ())
    cols = [np.bincount(doc, minlength=t.n), t.per_doc(chars & ~WS[t.data]), t.per_doc(SYMBOLS[t.data]),
            [dup_lines(x) for x in texts], repeat_words(doc, span_hashes(t.data, starts, ends), t.n), script,
            tokens, per, share, bits]
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, OUT)], fields=list(OUT))


def measure_udf(names: tuple[str, ...]):
    def run(text: pa.Array) -> pa.Array:
        return by_chunk(text, functools.partial(_measure, names=names), OUT)
    return F.arrow_udf(run, OUT_SQL)


def measures(docs: DataFrame, keep: list[str], text: str = "text",
             vocabularies: tuple[str, ...] = (BYTE_BPE,)) -> DataFrame:
    """Columns ``keep`` of every row and its measures."""
    return docs.select(*[F.col(f"`{c}`") for c in keep], measure_udf(vocabularies)(F.col(f"`{text}`")).alias("_m")) \
        .select(*[F.col(f"`{c}`") for c in keep], "_m.*")


def base_failed(m=F.col) -> Column:
    """The base rules, over measures that ``m`` finds by name."""
    return (m("n_words") < MIN_WORDS) | (100 * m("n_repeat_words") > MAX_REPEAT_PERCENT * m("n_words"))


def in_band(bands: dict[str, tuple[float, float, float, float]] = BANDS, m=F.col) -> Column:
    """The measures lie in the bands of the row's script."""
    def ok(b):
        return ((m("chars_per_token") >= b[0]) & (m("chars_per_token") <= b[1])
                & (m("fallback_share") <= b[2]) & (m("token_entropy") >= b[3]))
    out = ok(bands["other"])
    for s, b in bands.items():
        if s != "other":
            out = F.when(m("script") == s, ok(b)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, keep: list[str], text: str = "text",
                  vocabularies: tuple[str, ...] = (BYTE_BPE,), bands: dict = BANDS) -> DataFrame:
    """``keep`` columns, the measures, ``base_failed`` and ``kept`` of every row."""
    return measures(docs, keep, text, vocabularies) \
        .withColumn("base_failed", base_failed()) \
        .withColumn("kept", ~F.col("base_failed") & in_band(bands))


def keep_good(docs: DataFrame, text: str = "text", vocabularies: tuple[str, ...] = (BYTE_BPE,),
              bands: dict = BANDS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns only."""
    def m(name):
        return F.col(f"_qr_measures.{name}")
    return docs.withColumn("_qr_measures", measure_udf(vocabularies)(F.col(f"`{text}`"))) \
        .where(~base_failed(m) & in_band(bands, m)).drop("_qr_measures")
