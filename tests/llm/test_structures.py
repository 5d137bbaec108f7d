"""Manifest, prefix trie and packing against brute force, with the edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF001
from tokenforge.llm import merkle, packing, prefix_trie
from tokenforge.llm.queries import QUERIES
from tokenforge.llm.tokenizers import vocab_path

LONG = "lorem ipsum dolor sit amet " * 20_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, k long, rid long, seq long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ------------------------------------------------------------------ manifest
def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(r, text):
    return sha(*[_field(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def _tree(nodes):
    """(root, for each leaf the (left, right) siblings of each level)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i in range(len(nodes)):
            run = level[at[i] // 8 * 8:at[i] // 8 * 8 + 8]
            paths[i].append(("".join(run[:at[i] % 8]), "".join(run[at[i] % 8 + 1:])))
            at[i] //= 8
        level = [sha(*level[i:i + 8]) for i in range(0, len(level), 8)]
    return (level[0] if level else None), paths


def _manifest(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = defaultdict(list)
    for r in rows:
        parts[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r, r["text"]), r))
    langs = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        parts[lang].sort(key=lambda x: x[:3])
        trees[lang] = _tree([x[2] for x in parts[lang]])
    root, tops = _tree([trees[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        for (_, _, leaf, r), path in zip(parts[lang], trees[lang][1]):
            path = path + top
            h = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                h = _leaf(r, r["text"].translate(low))
            for left, right in path:
                h = sha(left, h, right)
            out.append((r["doc_id"], leaf, trees[lang][0], root, sha(*[a + b for a, b in path]), h, h == root))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t", "en", "a", 3), (4, LONG, "en", "b", len(LONG)),
            (5, "Same Text", "en", "b", 9), (5, "Same Text", "en", "b", 9), (5, "Other", "en", "b", 5),
            (None, "Same Text", "en", None, 9), (None, None, "en", None, None), (7, "Wort", "de", "c", 4),
            (8, "7 @ \U0001f600 É", "", "c", 7), (-9, "Minus", "fr", "c", 5)]
    rows += [(100 + i, f"Document {i}", "en", "s", 10) for i in range(70)]
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], DOCS)


def test_manifest_of_odd_rows(spark, odd):
    got = merkle.manifest(odd, tampered=merkle.lowered_every_third)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert _got(got) == _manifest(odd.collect())


@pytest.mark.parametrize("sizes", [[1], [2], [8], [9], [65], [1, 1], [3] * 10])
def test_manifest_of_any_shape(spark, sizes):
    rows = [(1000 * p + i, f"T{i}", f"l{p}", "s", 2, "", 0, 0, 0) for p, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, DOCS)
    assert _got(merkle.manifest(df, tampered=merkle.lowered_every_third)) == _manifest(df.collect())


def test_manifest_in_small_chunks(spark, odd, monkeypatch):
    monkeypatch.setattr(merkle, "PLACE_ROWS", 7)
    assert _got(merkle.manifest(odd, tampered=merkle.lowered_every_third)) == _manifest(odd.collect())


def test_manifest_notices_every_change(odd):
    plain = merkle.manifest(odd).collect()
    assert all(r["verified"] for r in plain)
    changed = {r["doc_id"] for r in merkle.manifest(odd, tampered=merkle.lowered_every_third).where("NOT verified").collect()}
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert changed and all(zlib.crc32(str(i).encode()) % 3 == 0 and texts[i] != texts[i].lower() for i in changed)


def test_empty_tables(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []
    assert packing.pack(spark.createDataFrame([], DOCS)).collect() == []
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(*prefix_trie.shared_beginnings(prefix_trie.thin_turns(none))).collect() == []


# ------------------------------------------------------------------ prefix trie
def _trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            g = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, g, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len([w for w in "".join(" " if x in "\t\n\x0b\x0c\r" else x for x in p[-1][1]).split(" ") if w]) if p else 0
        leaves[p] = sum(leaves[q] for q in kids[p]) if kids[p] else 1
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[q] for q in kids[p])
    out = []
    for p, cs in nodes.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(p))
        out.append((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _build(df):
    return _got(prefix_trie.prefix_trie(*prefix_trie.shared_beginnings(prefix_trie.thin_turns(df))))


def test_trie_of_random_conversations(spark, monkeypatch):
    """Shared beginnings, ties of turn numbers, nulls, and conversations of many blocks."""
    rnd = random.Random(11)
    rows = []
    for c in [*range(0, 130), -3, -20, 4000]:
        n = rnd.choice([0, 1, 2, 3, 5, 9])
        for t in range(n):
            rows.append((c, rnd.choice([t, None, 0]), rnd.choice(["user", "assistant", None]),
                         rnd.choice(["a b", "a  b\n", "", None, "hello"])))
    for c in (501, 502, 503):
        rows += [(c, t, "user", f"turn {t}" if t < 75 or c == 501 else f"{c} {t}") for t in range(70 + 9 * (c % 3))]
    rows += [(None, 0, "user", "lost"), (7, 1, "user", LONG), (7, 1, "user", LONG)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows],
                               "conv_id long, turn long, role string, text string, c long, s string, pos long")
    want = _trie(rows)
    assert _build(df) == want
    # the contracted list, the buckets of siblings and the chunks of ranks at their smallest
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    monkeypatch.setattr(prefix_trie, "ENDS_BITS", 2)
    real = prefix_trie.list_rank
    monkeypatch.setattr(prefix_trie, "list_rank", lambda arcs, head: real(arcs, head, tail=200))
    assert _build(df) == want


def test_a_turnless_conversation(spark):
    """Conversation 1 has one turn and loses it to an absent beginning."""
    cs = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 1][:2]
    df = spark.createDataFrame([(c, 0, "user", "only") for c in cs], "conv_id long, turn long, role string, text string")
    assert _build(df) == _trie([(c, 0, "user", "only") for c in cs])
    assert len(_build(df)) == 1


def test_list_rank(spark):
    rnd = random.Random(2)
    ids = rnd.sample(range(10_000), 500)
    arcs = spark.createDataFrame(list(zip(ids, [*ids[1:], None])), "id long, next long")
    got = {r["id"]: r["rank"] for r in prefix_trie.list_rank(arcs, ids[0], tail=20).collect()}
    assert got == {i: n for n, i in enumerate(ids)}


# ------------------------------------------------------------------ packing
@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(vocab_path(packing.WORD_BPE))


def _check(rows, ids_of, window=4096):
    """Every id lies in one piece, offsets are gapless, checksums and sizes hold; padding."""
    spans, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(spans) == set(ids_of)
    for k, docs in ids_of.items():
        want = sorted(zlib.crc32(x.tobytes()) for x in docs)
        assert all(r["doc_tokens"] in {len(x) for x in docs} for r in spans[k])
        if len(docs) == 1:
            at = 0
            for r in sorted(spans[k], key=lambda r: r["start"]):
                assert r["start"] == at and r["length"] > 0
                assert r["ids_crc32"] == zlib.crc32(docs[0][at:at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(docs[0])
        else:
            assert sum(r["length"] for r in spans[k]) == sum(map(len, docs)) and want
    padding = 0
    for v in seqs.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding


def _ids(model, rows):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(np.array(model.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4"))
    return out


def test_packing_query(spark, model):
    rows = QUERIES["op13_least_squares_packing"](spark, SF001).collect()
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert _check(rows, _ids(model, docs)) == 0


def test_packing_odd_rows_and_small_windows(spark, odd, model):
    for window, grid in ((4096, 64), (64, 8)):
        got = packing.pack(odd, window=window, grid=grid).collect()
        assert _check(got, _ids(model, odd.collect()), window) < window


def test_packing_many_equal_documents(spark, model, monkeypatch):
    """One length class holds nearly all documents; runs, blocks of the two lines small."""
    monkeypatch.setattr(packing, "RUN", 5)
    monkeypatch.setattr(packing, "BLOCK", 128)
    rows = [(i, "word " * 19) for i in range(200)] + [(1000 + i, "a " * (3 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, window=64, grid=8).collect()
    assert _check(got, _ids(model, df.collect()), 64) < 64


def test_least_squares():
    rnd = np.random.default_rng(4)
    for _ in range(20):
        a = rnd.integers(0, 3, (6, 14)).astype(float)
        truth = np.where(rnd.random(14) < 0.4, rnd.random(14) * 5, 0)
        b = a @ truth
        x = packing.nnls(a, b)
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) < 1e-6 * max(1, np.linalg.norm(b))
    ways = packing.combinations(6, 3)
    assert len(set(ways)) == len(ways) == 7 and all(sum(w) == 6 for w in ways)


def test_plan_never_asks_for_more_than_there_is():
    rnd = random.Random(6)
    for _ in range(10):
        counts = {k: (n := rnd.randint(0, 500), n * (64 * k - rnd.randint(0, 40))) for k in range(1, 65) if rnd.random() < 0.7}
        used = defaultdict(int)
        for way, times in packing.plan(counts, 4096, 64, 4):
            for k in way:
                used[k] += times
        assert all(used[k] <= counts[k][0] for k in used)


def test_words_are_encoded_as_in_their_text(model):
    rnd = random.Random(8)
    texts = ["", " ", "it's we'LL --'s", "<|endoftext|> a<|startoftext|>b <|x|>", "café café İstanbul STRAßE",
             "中文　x", "a\u0085b\u001cc", "1234 5² ½", "\x00\x01a", " ́x", "a" * 70, "x" * 200_000]
    letters = "abcXYZ'’-.,<|>12é́İß中 \t\n \u0085"
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1000)]
    ids, bounds = packing.encode_texts(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == model.encode(t, add_special_tokens=False).ids


def test_memo_forgets(model, monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 10)
    texts = [f"w{i} again word{i % 7}, x" for i in range(300)]
    for t in texts:
        ids, _ = packing.encode_texts(pa.array([t]))
        assert ids.tolist() == model.encode(t, add_special_tokens=False).ids
    assert len(packing._words(packing.WORD_BPE).words[0]) < 100_000


def test_long_texts_stream(model, monkeypatch):
    monkeypatch.setattr(packing, "PART", 1000)
    monkeypatch.setattr(packing, "SLICE", 500)
    text = "some words, more words and a number 12 " * 500
    got = packing._encode(pa.array([text]), packing.WORD_BPE, 64, 2).to_pylist()[0]
    want = np.array(model.encode(text, add_special_tokens=False).ids + [2], "<u4")
    assert got["n"] == len(want) and got["rest"] == want[len(want) // 64 * 64:].tolist()
    assert got["crcs"] == [zlib.crc32(want[i:i + 64].tobytes()) for i in range(0, len(want) // 64 * 64, 64)]
