"""Personal data: plain rules, and a linear-chain conditional random field.

The rules find e-mail addresses, IP addresses, card and phone numbers by fixed
patterns and checks.  A conditional random field over word-shape features finds
further spans: it is trained from the small labelled table in ``pii_labels`` and
from a bounded sample of rows that the rules label, and decodes by Viterbi over
numpy batches of chains.  A chain is a maximal run of words that hold a digit or
an ``@``; other words can't be part of a span, and serve as context.  A decoded
span is added where it overlaps no span of its kind by the rules, which all stay.

One Arrow UDF over whole texts, no shuffle.  Offsets are code points, end
exclusive.

Defined results: null and empty texts have no spans; repeated rows are handled
each; other columns are neither read nor needed; with no rows to learn from the
labelled table alone trains the model.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_chunk
from .pii_labels import ROWS

# The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SAMPLE_ROWS = 3_000            # rows that the rules label for training
SAMPLE_CHAINS = 1_500          # chains of them, with and without spans each
PLACES = 1 << 14
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
STEPS, RATE, RIDGE = 60, 0.1, 1e-3
_WS = " \t\n\v\f\r"
_MARK = re.compile(r"[0-9@]")
_END = re.compile(r"[^\x20\x09-\x0D]*")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of name@host; a name begins where its run of characters
    does, but not before the end of the last match."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        m = EMAIL_HOST.match(text, at + 1)
        if m:
            s = at
            while s > floor and text[s - 1] in EMAIL_NAME:
                s -= 1
            if s < at:
                out.append(("email", s, m.end()))
                floor = m.end()
        else:
            m = None
        at = text.find("@", max(at + 1, floor))
    return out


def rule_spans(text: str) -> list[Span]:
    """Spans by the rules, by kind and then by start."""
    out = emails(text) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def chains(text: str) -> list[list[tuple[int, int]]]:
    """Maximal runs of words with a digit or an @, as (start, end) of each word."""
    out: list[list[tuple[int, int]]] = []
    done = 0
    for m in _MARK.finditer(text):
        if m.start() < done:
            continue
        s = m.start()
        while s > done and text[s - 1] not in _WS:
            s -= 1
        e = _END.match(text, m.end()).end()
        if out and not text[out[-1][-1][1]:s].strip(_WS):
            out[-1].append((s, e))
        else:
            out.append([(s, e)])
        done = e
    return out


@functools.lru_cache(20_000)
def shape(word: str) -> tuple[int, ...]:
    """Places of the word-shape features of a word."""
    full = re.sub(r"[A-Z]", "A", re.sub(r"[a-z\x80-\U0010FFFF]", "a", re.sub(r"[0-9]", "9", word[:64])))
    short = re.sub(r"(.)\1+", r"\1", full)
    core = word.strip(".,;:!?\"'")
    digits = sum(c.isdigit() for c in word)
    feats = ["f" + full if len(full) <= 24 else "flong", "s" + short, f"d{min(digits, 20)}", f"n{min(len(word), 30)}",
             "p" + full[:2], "q" + full[-2:], f"at{min(word.count('@'), 2)}{'.' in word.partition('@')[2]}",
             f"plus{word[:1] == '+'}", f"dots{min(core.count('.'), 5)}{digits > 0}", f"col{min(word.count(':'), 4)}",
             f"dash{min(word.count('-'), 4)}", f"paren{'(' in word}{')' in word}",
             f"pure{core.isdigit()}{min(len(core), 20)}", f"alnum{bool(re.search('[A-Za-z]', core))}{digits > 0}"]
    return tuple(zlib.crc32(x.encode()) % PLACES for x in feats)


def context(text: str, s: int, e: int) -> tuple[int, ...]:
    """Places of the features of the words around a chain's word."""
    before = text[max(0, s - 48):s].split()[-2:]
    after = text[e:e + 48].split()[:1]
    feats = [f"b{i}" + w.lower().strip(".,;:")[:16] for i, w in enumerate(reversed(before))]
    feats += ["a" + w.lower().strip(".,;:")[:16] for w in after]
    feats += [f"z{i}" + str(sorted(shape(w))[:3]) for i, w in enumerate(reversed(before)) if _MARK.search(w)]
    return tuple(zlib.crc32(x.encode()) % PLACES for x in feats)


WIDTH = 20                     # places of a word; unused ones point at place PLACES


def encode(text: str, chain: list[tuple[int, int]]) -> np.ndarray:
    out = np.full((len(chain), WIDTH), PLACES, np.int32)
    for i, (s, e) in enumerate(chain):
        f = shape(text[s:e]) + context(text, s, e)
        out[i, :min(len(f), WIDTH)] = f[:WIDTH]
    return out


def tags_of(chain: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """Tag of each word of a chain, by the spans that it overlaps."""
    out = []
    for i, (s, e) in enumerate(chain):
        hit = next((x for x in spans if x[1] < e and s < x[2]), None)
        if hit is None:
            out.append(0)
        else:
            inside = i > 0 and chain[i - 1][1] > hit[1]
            out.append(TAGS.index(("I-" if inside else "B-") + hit[0]))
    return out


_ALLOWED = np.array([[not b.startswith("I") or a[2:] == b[2:] for b in TAGS] for a in TAGS])
_START = np.array([not t.startswith("I") for t in TAGS])
_NO = -1e4


def batches(lengths: np.ndarray, cells: int = 200_000):
    """Groups of chains of like length, of about ``cells`` words with padding."""
    order = np.argsort(lengths, kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * lengths[order[j]] <= cells:
            j += 1
        yield order[i:j]
        i = j


class CRF:
    """Weights by feature place and tag, and transitions between tags."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def _padded(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(s) for s in seqs])
        places = np.full((len(seqs), n.max(), WIDTH), PLACES, np.int32)
        for i, s in enumerate(seqs):
            places[i, :len(s)] = s
        return places, n

    def decode(self, seqs: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each chain, by Viterbi over padded batches."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seqs)
        moves = np.where(_ALLOWED, self.moves, _NO)
        for group in batches(np.array([len(s) for s in seqs])):
            places, n = self._padded([seqs[k] for k in group])
            em = self.weights[places].sum(2)
            best = em[:, 0] + np.where(_START, 0, _NO)
            back = np.zeros(em.shape, np.int8)
            for t in range(1, em.shape[1]):
                step = best[:, :, None] + moves[None]
                back[:, t] = step.argmax(1)
                new = step.max(1) + em[:, t]
                best = np.where((t < n)[:, None], new, best)
            tag = best.argmax(1)
            path = np.zeros(em.shape[:2], np.int64)
            rows = np.arange(len(group))
            for t in range(em.shape[1] - 1, -1, -1):
                on = t < n
                path[on, t] = tag[on]
                tag = np.where(on, back[rows, t, tag], tag) if t else tag
            for i, k in enumerate(group):
                out[k] = path[i, :n[i]]
        return out

    @staticmethod
    def train(seqs: list[np.ndarray], tags: list[list[int]]) -> CRF:
        """Adam on the log-likelihood; gradients by forward and backward sums."""
        k = len(TAGS)
        crf = CRF(np.zeros((PLACES + 1, k)), np.zeros((k, k)))
        n = np.array([len(s) for s in seqs])
        keep = np.flatnonzero(n <= 64)
        places, n = crf._padded([seqs[i] for i in keep])
        gold = np.zeros(places.shape[:2], np.int64)
        for i, j in enumerate(keep):
            gold[i, :n[i]] = tags[j]
        T = gold.shape[1]
        on = np.arange(T)[None] < n[:, None]
        flat = places[on].reshape(-1)
        order = np.argsort(flat, kind="stable")
        uniq, first = np.unique(flat[order], return_index=True)
        word = order // WIDTH
        hot = np.eye(k)[gold]
        gold_moves = np.einsum("nta,ntb->ab", hot[:, :-1], hot[:, 1:] * on[:, 1:, None]) if T > 1 else np.zeros((k, k))
        state = [(np.zeros_like(x), np.zeros_like(x)) for x in (crf.weights, crf.moves)]

        def lse(x, axis):
            m = x.max(axis, keepdims=True)
            return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)

        for step in range(1, STEPS + 1):
            moves = np.where(_ALLOWED, crf.moves, _NO)
            em = crf.weights[places].sum(2)
            a, b = np.zeros(em.shape), np.zeros(em.shape)
            a[:, 0] = em[:, 0] + np.where(_START, 0, _NO)
            for t in range(1, T):
                a[:, t] = np.where(on[:, t, None], lse(a[:, t - 1, :, None] + moves, 1) + em[:, t], a[:, t - 1])
            z = lse(a[:, -1], 1)
            for t in range(T - 2, -1, -1):
                b[:, t] = np.where(on[:, t + 1, None], lse(moves[None] + (em[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
            p = np.exp(a + b - z[:, None, None])
            diff = (p - hot)[on]
            g_w = np.zeros_like(crf.weights)
            g_w[uniq] = np.add.reduceat(diff[word], first, axis=0)
            g_m = -gold_moves
            for t in range(1, T):
                pair = a[:, t - 1, :, None] + moves + (em[:, t] + b[:, t])[:, None, :] - z[:, None, None]
                g_m = g_m + (np.exp(pair) * on[:, t, None, None]).sum(0)
            for (m, v), x, g in zip(state, (crf.weights, crf.moves), (g_w, g_m)):
                g = g / len(n) + RIDGE * x / 10
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
            crf.weights[PLACES] = 0
        return crf


def labelled_table(rows: str = ROWS) -> list[tuple[str, list[Span]]]:
    """(text, spans) of the labelled table."""
    out = []
    for line in rows.strip().splitlines():
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[(%s):([^\]]*)\]" % "|".join(KINDS), line):
            text += line[at:m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        out.append((text + line[at:], spans))
    return out


def learn(texts: list[str], repeat: int = 4) -> CRF:
    """A model from the labelled table, each row ``repeat`` times, and from chains
    of ``texts`` that the rules label."""
    seqs, tags = [], []
    for text, spans in labelled_table() * repeat:
        for c in chains(text):
            seqs.append(encode(text, c))
            tags.append(tags_of(c, spans))
    room = {True: SAMPLE_CHAINS, False: SAMPLE_CHAINS}
    for text in texts:
        spans = rule_spans(text)
        for c in chains(text):
            t = tags_of(c, spans)
            if room[any(t)]:
                room[any(t)] -= 1
                seqs.append(encode(text, c))
                tags.append(t)
    return CRF.train(seqs, tags)


def _trim(text: str, s: int, e: int) -> tuple[int, int]:
    """A span without the punctuation around it."""
    while s < e and not (text[s].isalnum() or text[s] in "+("):
        s += 1
    while e > s and not (text[e - 1].isalnum() or (text[e - 1] == ")" and "(" in text[s:e])):
        e -= 1
    return s, e


def model_spans(crf: CRF, texts: list[str]) -> list[list[Span]]:
    """Decoded spans of each text."""
    where, seqs = [], []
    for i, text in enumerate(texts):
        for c in chains(text):
            where.append((i, c))
            seqs.append(encode(text, c))
    out: list[list[Span]] = [[] for _ in texts]
    for (i, c), path in zip(where, crf.decode(seqs) if seqs else []):
        at = 0
        while at < len(path):
            if not path[at]:
                at += 1
                continue
            kind, end = TAGS[path[at]][2:], at + 1
            while end < len(path) and TAGS[path[end]] == "I-" + kind:
                end += 1
            s, e = _trim(texts[i], c[at][0], c[end - 1][1])
            if s < e:
                out[i].append((kind, s, e))
            at = end
    return out


def find_spans(crf: CRF, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(spans by the rules, all spans) of each text, by kind and then by start."""
    out = []
    for text, more in zip(texts, model_spans(crf, texts)):
        base = rule_spans(text)
        add = [x for x in more if not any(x[0] == b[0] and x[1] < b[2] and b[1] < x[2] for b in base)]
        out.append((base, sorted(base + add, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))))
    return out


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def sample_texts(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[str]:
    """Texts with a digit or an @, the first ``rows`` ones in the order of a hash."""
    t = F.col(f"`{text}`")
    thin = docs.where(t.rlike("[0-9@]")).select(F.xxhash64(t).alias("_h")).distinct().orderBy("_h").limit(rows)
    got = docs.where(t.rlike("[0-9@]")).select(F.xxhash64(t).alias("_h"), t.alias("_t")) \
        .join(F.broadcast(thin), "_h").dropDuplicates(["_h"]).collect()
    return [r["_t"] for r in sorted(got, key=lambda r: r["_h"])]


OUT = pa.struct([(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string())])


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _rows(arr: pa.Array, crf: CRF) -> pa.Array:
    found = find_spans(crf, arr.to_pylist())
    cols = [[sum(x[0] == k for x in base) for base, _ in found] for k in KINDS]
    cols.append([hashlib.sha256(spans_text(base).encode()).hexdigest() for base, _ in found])
    cols.append([spans_text(every) for _, every in found])
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, OUT)], fields=list(OUT))


def personal_data(docs: DataFrame, keep: list[str], text: str = "text", crf: CRF | None = None) -> DataFrame:
    """``keep`` columns, the numbers of spans by the rules, their digest, and all
    spans as ``kind:start:end``."""
    crf = crf or learn(sample_texts(docs, text))
    cols = [F.col(f"`{c}`") for c in keep]
    udf = F.arrow_udf(lambda a: by_chunk(a, lambda x: _rows(x, crf), OUT),
                      "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return docs.select(*cols, udf(F.col(f"`{text}`")).alias("_p")).select(*cols, "_p.*")


def masked(docs: DataFrame, text: str = "text", crf: CRF | None = None) -> DataFrame:
    """All columns of ``docs``, each span of the text replaced by its kind; a null
    text stays null."""
    crf = crf or learn(sample_texts(docs, text))

    def chunk(arr: pa.Array) -> pa.Array:
        texts = arr.to_pylist()
        return pa.array([mask(t, e) for t, (_, e) in zip(texts, find_spans(crf, texts))], pa.string())
    udf = F.arrow_udf(lambda a: by_chunk(a, chunk, pa.string()), "string")
    t = F.col(f"`{text}`")
    return docs.withColumn(text, F.when(t.isNotNull(), udf(t)))
