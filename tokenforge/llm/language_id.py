"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is
parsed greedily by each automaton: every phrase is the longest match from its
place, then the next one begins.  Few phrases for the number of symbols mean a
low cross entropy; the language that needs the fewest wins.

Learning takes a bounded sample of labelled rows (``rows_per_lang`` rows a
language, whole texts).  Prediction covers every whole text: texts are cut to
blocks of ``BLOCK`` symbols that are parsed side by side with numpy, and the
phrases of a text's blocks are summed, so that memory is bounded for texts of
any length.  No shuffle of texts.

Defined results: null, empty and letterless texts are ``und`` with score 0; a
tie goes to the language whose name sorts first; with no labelled row every text
is ``und``; rows with a null id are not learnt from; repeated rows are predicted
each; other columns are neither read nor needed.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_chunk, held_out, learnable, sample_rows

ROWS_PER_LANG = 24             # labelled rows that an automaton is built from
LONG = 4_000                   # characters; longer labelled rows are taken last
BLOCK = 256                    # symbols of a text that are parsed together
CHUNK = 4 << 20                # bytes of text that are parsed side by side
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
OUT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


@functools.lru_cache(1)
def symbol_table() -> np.ndarray:
    """Code point -> lower-case code point of a letter or mark, 0x20 for others."""
    out = np.full(0x110000, 0x20, np.int32)
    for cp in range(0x110000):
        if unicodedata.category(ch := chr(cp))[0] in "LM":
            low = ch.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def symbols(text: str) -> np.ndarray:
    """Letters in lower case, each run of other characters as one space."""
    s = symbol_table()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0x20) | (s[:-1] != 0x20)
    return s[keep]


class Automaton:
    """Suffix automaton of a sequence of small integers as a transition table."""

    def __init__(self, seq: list[int], width: int):
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in seq:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p != -1:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        # the last state leads nowhere: a symbol never seen is a phrase of its own
        self.table = np.full((len(nexts) + 1, width), -1, np.int32)
        for i, d in enumerate(nexts):
            if d:
                self.table[i, list(d)] = list(d.values())
        self.flat, self.width = self.table.reshape(-1), width
        self.begin = np.where(self.table[0] < 0, len(nexts), self.table[0])

    def phrases(self, blocks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of the greedy parse of each column of ``blocks``; columns are
        ordered by falling size."""
        n = np.ones(blocks.shape[1], np.int64)
        state = self.begin[blocks[0]].astype(np.int64)
        live = len(sizes)
        for i in range(1, blocks.shape[0]):
            while live and sizes[live - 1] <= i:
                live = int(np.searchsorted(-sizes, -i, "left"))
            if not live:
                break
            c = blocks[i, :live]
            to = self.flat[state[:live] * self.width + c]
            miss = to < 0
            n[:live] += miss
            state[:live] = np.where(miss, self.begin[c], to)
        return n


class Model:
    """Languages and their automata over one alphabet."""

    def __init__(self, labelled: tuple[tuple[str, str], ...]):
        parts = {lang: symbols(text) for lang, text in labelled}
        self.langs = sorted(k for k, v in parts.items() if len(v))
        known = np.unique(np.concatenate([parts[k] for k in self.langs])) if self.langs else np.zeros(0, np.int32)
        self.code = np.zeros(0x110000, np.int32)           # 0: a symbol no language has
        self.code[known] = np.arange(1, len(known) + 1)
        self.automata = [Automaton(self.code[parts[k]].tolist(), len(known) + 1) for k in self.langs]

    def predict(self, arr: pa.Array) -> pa.Array:
        texts = arr.to_pylist()
        seqs = [symbols(t) for t in texts]
        lens = np.array([len(s) for s in seqs], np.int64)
        letters = np.array([LETTER.search(t) is not None for t in texts], bool)     # marks alone are none
        if not self.langs or not letters.any():
            return pa.StructArray.from_arrays([pa.array([UNKNOWN] * len(seqs), pa.string()),
                                               pa.array(np.zeros(len(seqs)))], fields=list(OUT))
        flat = self.code[np.concatenate(seqs)]
        starts = np.cumsum(lens) - lens
        per = -(-lens // BLOCK)
        doc = np.repeat(np.arange(len(seqs)), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        at = starts[doc] + nth * BLOCK
        size = np.minimum(BLOCK, lens[doc] - nth * BLOCK)
        order = np.argsort(-size, kind="stable")
        doc, at, size = doc[order], at[order], size[order]
        where = np.minimum(at[None, :] + np.arange(BLOCK)[:, None], len(flat) - 1)
        blocks = flat[where]
        need = np.zeros((len(self.langs), len(seqs)))
        for k, a in enumerate(self.automata):
            need[k] = np.bincount(doc, weights=a.phrases(blocks, size), minlength=len(seqs))
        best = need.argmin(0)
        least = need[best, np.arange(len(seqs))]
        if len(self.langs) > 1:
            second = np.partition(need, 1, axis=0)[1]
        else:
            second = lens.astype(float)
        # 0.5 where two languages tie, towards 1 as the runner-up needs more
        score = second / np.maximum(second + least, 1)
        lang = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0))],
                                          fields=list(OUT))


@functools.lru_cache(1)
def load(labelled: tuple[tuple[str, str], ...]) -> Model:
    return Model(labelled)


def labelled_text(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
                  rows_per_lang: int = ROWS_PER_LANG) -> tuple[tuple[str, str], ...]:
    """(language, text of its sampled rows) for each language.

    The sample is chosen on a thin table in the order of a hash of the id, rows
    up to ``LONG`` characters first, so it doesn't depend on partitions.  The
    chosen texts, ``rows_per_lang`` for each language, come to the driver.
    """
    rows = docs.where(learnable(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    thin = rows.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.xxhash64(text).alias("h"),
                       F.length(text).alias("n"))
    chosen = sample_rows(thin, ["lang"], [F.col("n") > LONG, F.xxhash64("id"), F.col("id"), F.col("h")], rows_per_lang)
    full = rows.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.xxhash64(text).alias("h"),
                       F.col(text).alias("text"))
    got = full.join(F.broadcast(chosen.select("id", "lang", "h").distinct()), ["id", "lang", "h"]) \
        .dropDuplicates(["id", "lang", "h"]).collect()
    by: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["id"], r["h"])):
        by.setdefault(r["lang"], []).append(r["text"])
    return tuple((k, "\n".join(v)) for k, v in by.items())


def predict_udf(labelled: tuple[tuple[str, str], ...]):
    def run(text: pa.Array) -> pa.Array:
        return by_chunk(text, lambda a: load(labelled).predict(a), OUT, CHUNK)
    return F.arrow_udf(run, "lang_pred string, score double")


def identify(docs: DataFrame, labelled: tuple[tuple[str, str], ...], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, the predicted language and its score."""
    cols = [F.col(f"`{c}`") for c in keep]
    return docs.select(*cols, predict_udf(labelled)(F.col(f"`{text}`")).alias("_p")).select(*cols, "_p.*")


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """Learn from the rows that aren't held out, predict every row."""
    model = labelled_text(docs, text, lang, doc_id, rows_per_lang)
    return identify(docs, model, [doc_id], text).withColumn("held_out", held_out(F.col(doc_id)))
