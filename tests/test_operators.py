"""Library paths not exercised by the registered queries."""

import hashlib
import json

from pyspark.sql import functions as F

from tests.conftest import SF001
from tokenforge.operators import infer as INF
from tokenforge.operators import vocab as V


def test_encode_join_equals_lookup_encoding(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", F.substring("text", 1, 200).alias("text"))
    vocab = V.char_vocab(d.where(F.col("doc_id") % 2 == 0))
    unk = 10_000
    lut = V.codepoint_lut(vocab)
    a = {r["doc_id"]: r["ids"] for r in d.select("doc_id", V.encode_with_lut(F.col("text"), lut, unk).alias("ids")).collect()}
    b = {r["doc_id"]: r["ids"] for r in V.encode_join(d, "doc_id", "text", vocab, unk).collect()}
    assert a == b


def test_vocab_json_and_maps(spark):
    d = spark.createDataFrame([("ba",), ("ca",)], "text string")
    vocab = V.char_vocab(d)
    j = json.loads(vocab.select(V.vocab_json(vocab).alias("j")).first()["j"])
    assert j == {"0": "a", "1": "b", "2": "c"}
    stoi, itos = V.vocab_maps(vocab)
    r = d.select(V.decode_with_map(V.encode_with_map(F.col("text"), stoi), itos).alias("t")).collect()
    assert sorted(x["t"] for x in r) == ["ba", "ca"]


def test_yes_no_gate(spark):
    df = spark.createDataFrame([(" 是 ",), ("否",), ("是的",)], "a string")
    assert [r["g"] for r in df.select(INF.yes_no_gate(F.col("a")).alias("g")).collect()] == [True, False, False]


def test_single_prompt_client_in_thread_pool(spark):
    calls = []

    def client(prompt):
        calls.append(prompt)
        return hashlib.md5(prompt.encode()).hexdigest(), len(prompt)
    gen = INF.one_at_a_time(client, max_workers=4)
    assert gen(["a", "bb", "ccc"]) == [INF.md5_generator([p])[0] for p in ["a", "bb", "ccc"]]
    df = spark.createDataFrame([(1, ["hi", "again"]), (2, ["x"])], "conv_id long, users array<string>")
    a = sorted(tuple(r) for r in INF.label_conversations(df, "conv_id", "users", gen, 10 ** 6).collect())
    b = sorted(tuple(r) for r in INF.label_conversations(df, "conv_id", "users", INF.md5_generator, 10 ** 6).collect())
    assert a == b and len(a) == 3


def test_extraction_loop_prompts_only_who_goes_on(spark):
    """Rounds shrink; a null prompt and repeated keys are kept; the bound on rounds holds."""
    df = spark.createDataFrame([(1, "yes"), (1, "yes"), (2, "no"), (3, None)], "k long, prompt string")

    def gate(prompts):
        return ["\u662f" if p.startswith("yes") else "\u5426" for p in prompts]
    for rounds in (1, 2, 3):
        got = INF.extraction_loop(df, ["k"], "prompt", lambda ps: ["out"] * len(ps), gate, rounds).collect()
        counts = {}
        for r in got:
            counts[r["k"], r["round"]] = counts.get((r["k"], r["round"]), 0) + 1
        assert counts == {(1, i): 2 for i in range(rounds)} | {(2, 0): 1, (3, 0): 1}
    assert INF.extraction_loop(df.limit(0), ["k"], "prompt", INF.md5_extractor, INF.md5_gate).collect() == []


def test_scorers_keep_rows_without_key_or_text(spark):
    df = spark.createDataFrame([(None, 1, "a"), (0, None, "b"), (0, 2, None)], "rank long, row long, t string")
    got = sorted(((r["t"], r["s"]) for r in INF.gather_score_scatter(df, "rank", "row", "t", "s").collect()), key=str)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert got == sorted([("a", md5("a")), ("b", md5("b")), (None, None)], key=str)
    d = spark.createDataFrame([("a",), ("a",), (None,)], "t string")
    got = sorted(((r["t"], r["s"]) for r in INF.score_distinct(d, "t", "s").collect()), key=str)
    assert got == sorted([("a", md5("a")), ("a", md5("a")), (None, None)], key=str)


def test_text_of_either_kind(spark):
    from tokenforge.sources.corpus import text_turns
    lines = [('{"text": "User: a\\n\\nAssistant: b"}', [("user", "a"), ("assistant", "b")]),
             ('{"text": [{"role": "user", "content": "x"}, {"role": "tool", "content": "y"}]}', [("user", "x"), ("tool", "y")]),
             ('{"text": ""}', []), ('{"text": 7}', None), ('{"other": "x"}', None), ("not json", None), (None, None)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(lines)], "i long, value string")
    for r in text_turns(df).collect():
        got = None if r["turns"] is None else [(t["role"], t["content"]) for t in r["turns"]]
        assert got == lines[r["i"]][1], r["i"]


def test_label_shift(spark):
    from tokenforge.operators.samples import template_builder
    df = spark.createDataFrame([([("user", "u"), ("assistant", "xy")],)], "turns array<struct<role:string,content:string>>")
    full = df.select(*template_builder(F.col("turns"), 150, shift=0)).first()
    ids, at0 = full[0], full[1]
    assert [x for x in at0 if x != -100] == [i for i, x in zip(ids, at0) if x != -100]
    for k in (1, 2):
        got = df.select(template_builder(F.col("turns"), 150, shift=k)[1].alias("l")).first()["l"]
        assert got == at0[k:] + [-100] * k
    assert df.select(template_builder(F.col("turns"), 150)[1].alias("l")).first()["l"] == at0[2:] + [-100] * 2
    none = df.select(*template_builder(F.col("turns"), 150, bos=None)).first()
    assert [x for x in none[1] if x != -100] == [i for i, x in zip(none[0], none[1]) if x != -100]


def test_fallback_rows_are_replaced(spark):
    from tokenforge.operators.samples import replace_fallback
    rows = [(i, f"m{i}", i % 2 == 0) for i in range(6)]
    df = spark.createDataFrame(rows, "k long, m string, fallback boolean")
    others = spark.createDataFrame([(0, "o0"), (1, "o1")], "idx long, m string")
    got = {r["k"]: r["m"] for r in replace_fallback(df, "k", "k", others, ["m"]).collect()}
    assert got == {0: "o0", 1: "m1", 2: "o1", 3: "m3", 4: "o0", 5: "m5"}
    assert replace_fallback(df, "k", "k", others.limit(0), ["m"]).count() == 6


def test_rows_of_unequal_shape_are_not_zipped(spark):
    import pytest
    from tokenforge.operators.combine import zip_rows
    a = spark.createDataFrame([(0, [1, 2]), (1, [3])], "idx long, x array<int>")
    same = spark.createDataFrame([(0, [5, 6]), (1, [7])], "idx long, y array<int>")
    assert zip_rows(a, same, "idx", "x", "y").count() == 2
    for bad in (same.where("idx = 0"), spark.createDataFrame([(0, [5]), (1, [7])], "idx long, y array<int>")):
        with pytest.raises(Exception, match="unequal shapes"):
            zip_rows(a, bad, "idx", "x", "y").collect()


def test_padded_mode(spark):
    from tokenforge.operators import token_stream as S
    t = spark.createDataFrame([(0, [1, 2, 3]), (1, [4])], "doc_id long, tokens array<int>")
    st = S.as_store(S.with_offsets(t, ["doc_id"], F.col("doc_id")), "doc_id")
    got = {r["doc_id"]: (r["tokens"], r["min_len"]) for r in S.pad_spill(st, 2, mode="pad", pad=9).collect()}
    assert got == {0: ([1, 2], 2), 1: ([4, 9], 1)}


def test_teacher_scores_long_documents_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(1, list(range(25))), (None, [3]), (2, [])], "k long, ids array<int>")
    want = sorted(map(str, INF.teacher_scores(df, "k", "ids", INF.cosine_stub_scorer(4)).collect()))
    monkeypatch.setattr(INF, "SCORE_POSITIONS", 7)
    assert sorted(map(str, INF.teacher_scores(df, "k", "ids", INF.cosine_stub_scorer(4)).collect())) == want
    assert len(want) == 26


def test_vocabulary_file(spark):
    import os
    import tempfile
    path = tempfile.mkdtemp(prefix="tf-vocab-") + "/v"
    d = spark.createDataFrame([('b"a\\',), ("\u4e2d\n",)], "text string")
    V.write_vocab_json(V.char_vocab(d), path)
    parts = [x for x in os.listdir(path) if x.startswith("part-")]
    with open(f"{path}/{parts[0]}", encoding="utf-8") as f:
        got = json.load(f)
    assert len(parts) == 1 and got == {str(i): c for i, c in enumerate(sorted('b"a\\\u4e2d\n'))}


def test_partition_writer_names_by_model_and_tags(spark):
    from tokenforge.operators import turns as TU
    df = spark.createDataFrame([([("user", "x")], "LLaMA-2"), ([("user", "x")], None)],
                               "turns array<struct<role:string,content:string>>, model string")
    a, b = (r["t"] for r in df.select(TU.render_for_model(F.col("turns"), F.col("model")).alias("t")).collect())
    assert a.startswith(TU.LLAMA_USER_HEADER) and b.startswith(TU.QWEN_USER_GEN)
    one = spark.createDataFrame([("a<|im_end|>\n",), ("b",), (None,)], "p string")
    assert [r["c"] for r in one.select(TU.cut_closing_tag(F.col("p")).alias("c")).collect()] == ["a", "b", None]
    assert df.limit(1).select(TU.render_llama("turns", bos=True).alias("t")).first()["t"].startswith(TU.LLAMA_BOS_TEXT)


def test_text_store_equals_token_store(spark):
    """Windows, wrap and pads of the blocked text store and of stored token arrays, with
    empty documents, pieces over many blocks and characters beyond the first plane."""
    import random
    from tokenforge.functions import tokens as T
    from tokenforge.operators import token_stream as S
    rnd = random.Random(12)
    rows = [(i, "".join(rnd.choice("ab\u00e9\U0001f600\n") for _ in range(rnd.choice([0, 0, 1, 3, 8, 30])))) for i in range(25)]
    rows += [(25, ""), (26, "zz"), (27, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a = S.build_text_store(df, "doc_id", "text", ["doc_id"], block=4)
    b = S.build_store(df, "doc_id", T.codepoints("text"), ["doc_id"], F.col("doc_id"))
    total = sum(len(t) for _, t in rows)
    req = spark.createDataFrame([(i, i) for i in range(0, total, 3)], "rk long, pos long")
    key = lambda r: str(r)
    for make in (lambda s: S.pad_spill(s, 9), lambda s: S.pad_spill(s, 9, mode="pad", pad=7),
                 lambda s: S.read_windows(s, req, "rk", "pos", 9)):
        assert sorted(map(tuple, make(a).collect()), key=key) == sorted(map(tuple, make(b).collect()), key=key)
    flat = [ord(c) for _, t in rows for c in t]
    for r in S.read_windows(a, req, "rk", "pos", 9).collect():
        assert r["window"] == flat[r["pos"]:r["pos"] + 9]
    assert S.pad_spill(a, 9).count() == len(rows)

def test_masked_sample_equals_the_single_steps(spark, monkeypatch):
    from tokenforge.functions import tokens as T
    rows = [(0, "ab中\U0001f600"), (1, ""), (2, None), (3, "x" * 7), (4, "a\0b"), (5, "y" * 8), (5, "y" * 8)]
    d = spark.createDataFrame(rows, "k long, text string")
    w = d.withColumn("cp", T.codepoints("text"))
    w = w.withColumn("ids", T.pad_to(F.concat("cp", T.int_array([0])), (F.ceil((F.size("cp") + 1) / F.lit(8)) * 8).cast("int"), 0))
    w = w.withColumn("labels", T.mask_where_input("ids", T.shift_left("ids", 0), 0))
    want = w.select("k", F.size("ids").cast("long"), T.digest_ints(T.replace_value("ids", 0, 9)), T.digest_ints("labels"),
                    T.count_eq("labels", -100).cast("long"))
    want = sorted(map(str, map(tuple, want.collect())))
    for size in (1 << 20, 1):                    # one slice, and one for every text
        monkeypatch.setattr(T, "SLICE_BYTES", size)
        got = d.select("k", T.masked_sample("text", 8, 0, 9).alias("s")).select("k", "s.*")
        assert sorted(map(str, map(tuple, got.collect()))) == want


def test_short_documents_are_scored_together(spark):
    df = spark.createDataFrame([(k, [k, k + 1]) for k in range(40)] + [(None, None)], "k long, ids array<int>").coalesce(1)
    calls = spark.sparkContext.accumulator(0)
    stub = INF.cosine_stub_scorer(2)

    def scorer(batch):
        calls.add(1)
        return stub(batch)
    got = {(r["k"], r["pos"]): [round(x * 97) for x in r["logits"]]
           for r in INF.teacher_scores(df, "k", "ids", scorer).collect()}
    assert got == {(k, p): [(k + p) % 97, 2 * (k + p) % 97] for k in range(40) for p in (0, 1)}
    assert calls.value == 1
