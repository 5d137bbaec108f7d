"""Hand-worked goldens (FIXTURES part C): edge rows computed from the rules,
not from this package's code."""

import math

import pytest
from pyspark.sql import functions as F

from tokenforge.functions import buckets as B
from tokenforge.functions import tokens as T
from tokenforge.functions.text import ensure_suffix, refine_context, strip_ws
from tokenforge.operators import losses as L
from tokenforge.operators import samples as SB
from tokenforge.operators import turns as TU
from tokenforge.operators.combine import interleave, slice_fraction
from tokenforge.operators.corpus import corpus_samples
from tokenforge.operators.extract import merge_entities, parse_records
from tokenforge.operators.token_stream import build_store, pad_spill


def one(spark, col, schema="x int"):
    return spark.createDataFrame([(1,)], schema).select(col.alias("r")).first()["r"]


def test_pad_shift_mask_edges(spark):
    # texts of size 0, 1, 7, 8, 9 with max 8 (eos = pad = 0)
    rows = [(i, "abcdefghi"[:n]) for i, n in enumerate([0, 1, 7, 8, 9])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["input_ids"], r["labels"], r["real_len"])
           for r in corpus_samples(df, 8).collect()}
    a = [ord(c) for c in "abcdefghi"]
    assert got[0] == ([0] * 8, [-100] * 8, 0)
    assert got[1] == ([a[0]] + [0] * 7, [0] + [-100] * 7, 1)
    assert got[2] == (a[:7] + [0], a[1:7] + [0] + [-100], 7)
    assert got[3] == (a[:8], a[1:8] + [0], 8)
    assert got[4] == (a[:8], a[1:8] + [0], 8)


def test_real_len_eos_runs(spark):
    df = spark.createDataFrame([([0, 0, 0],), ([5, 0, 6],), ([5, 6, 0, 0],)], "a array<int>")
    assert [r["n"] for r in df.select(T.real_len("a", 0).alias("n")).collect()] == [0, 3, 2]


def test_bucket_edges(spark):
    df = spark.createDataFrame([(n,) for n in [0, 1, 256, 257, 2048, 2049, 3840, 3841, 4096]], "n long")
    inc = {r["n"]: (r["lo"], r["hi"]) for r in df.select(
        "n", *[c.alias(a) for c, a in zip(B.bucket_inclusive(F.col("n"), 1, 2048, 256), ["lo", "hi"])]).collect()}
    assert inc[0] == (None, None) and inc[1] == (1, 256) and inc[256] == (1, 256) and inc[257] == (257, 512)
    assert inc[2048] == (1793, 2048) and inc[2049] == (None, None)
    # lo = 0: the last range is 1792..2047, so 2048 is uncovered (Q15)
    q15 = {r["n"]: r["hi"] for r in df.select("n", B.bucket_inclusive(F.col("n"), 0, 2048, 256)[1].alias("hi")).collect()}
    assert q15[2048] is None and q15[256] == 511 and q15[0] == 255
    half = {r["n"]: r["hi"] for r in df.select("n", B.bucket_half_open(F.col("n"), 256, 4096)[1].alias("hi")).collect()}
    assert half[0] is None and half[1] == 256 and half[256] == 256 and half[257] == 512 and half[4096] == 4096
    ff = {r["n"]: (r["a"], r["b"]) for r in df.select(
        "n", B.bucket_first_fit(F.col("n"), 256, 4096).alias("a"),
        B.bucket_first_fit(F.col("n"), 256, 4096, drop_overflow=True).alias("b")).collect()}
    assert ff[0] == (256, 256) and ff[3840] == (3840, 3840) and ff[3841] == (4096, None) and ff[4096] == (4096, None)


def role_text_rule(data: str):
    """Plain statement of the reference's role-text scan (W10), for comparison."""
    data = data.strip()
    if not data:
        return []
    out, off = [], 0
    marks = {"User: ": ("user", "\n\nAssistant: "), "Assistant: ": ("assistant", "\n\nUser: "),
             "System: ": ("system", "\n\nUser: ")}
    while True:
        for m, (role, nxt) in marks.items():
            if data.startswith(m, off):
                break
        else:
            return None
        end = data.find(nxt, off)
        out.append((role, data[off + len(m): end if end != -1 else len(data)]))
        if end == -1:
            return out
        off = end + 2


def test_role_text_parser_matches_rule(spark):
    import random
    rnd = random.Random(11)
    atoms = ["User: ", "Assistant: ", "System: ", "\n\n", "\n", "a", "b c", " ", "User:", "\t"]
    texts = ["".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 14))) for _ in range(600)]
    texts += ["User: hi\n\nUser: again\n\nAssistant: yo", "System: s\n\nAssistant: x\n\nUser: u",
              "Assistant: first", "a User: b", "", "   "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: (None if r["p"] is None else [(x["role"], x["content"]) for x in r["p"]])
           for r in TU.parse_role_text(df, "t", "p").collect()}
    bad = [(texts[i], got[i], role_text_rule(texts[i])) for i in range(len(texts)) if got[i] != role_text_rule(texts[i])]
    assert not bad, bad[:3]


def test_templates_and_suffix(spark):
    turns = F.array(F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")),
                    F.struct(F.lit("user").alias("role"), F.lit("u").alias("content")),
                    F.struct(F.lit("assistant").alias("role"), F.lit("a").alias("content")))
    a = one(spark, TU.render_llama(turns))
    assert a == ("<|start_header_id|>user<|end_header_id|>\n\nu<|eot_id|>"
                 "<|start_header_id|>assistant<|end_header_id|>\n\na<|eot_id|>"
                 "<|start_header_id|>assistant<|end_header_id|>\n\n")
    b = one(spark, TU.render_qwen(turns))
    assert b == "<|im_start|>user\n\nu<|im_end|><|im_start|>assistant\n\na<|im_end|><|im_start|>assistant\n\n"
    assert one(spark, ensure_suffix(F.lit("x\n\n"))) == "x\n\n"
    assert one(spark, ensure_suffix(F.lit("x\n"))) == "x\n\n\n"
    assert one(spark, refine_context(F.lit("  a \r\n　\n b　 \n"))) == "\na\nb"
    assert one(spark, strip_ws(F.lit("  x \x1f"))) == "x"


def test_builder_v1_one_token_turns(spark):
    turns = F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content")),
                    F.struct(F.lit("assistant").alias("role"), F.lit("r").alias("content")))
    ids, labels = SB.messages_builder(turns, 40)
    got_ids, got_lab = spark.range(1).select(ids.alias("i"), labels.alias("l")).first()
    u, a = [ord(c) for c in "User : "], [ord(c) for c in "Assistant : "]
    exp_ids = [1] + u + [ord("q"), 10, 10] + a + [ord("r"), 10, 10]
    exp_lab = [-100] + [-100] * (len(u) + 3) + [-100] * len(a) + [ord("r"), 10, 10]
    exp_lab = exp_lab[1:] + [0]
    assert got_ids == exp_ids + [0] * (40 - len(exp_ids))
    assert got_lab == exp_lab + [-100] * (40 - len(exp_lab))


def test_budget_cut_2047_2048_2049(spark):
    # totals at a turn: 2047 -> next pair kept; 2048 (>= stops) -> crossing pair kept, then stop
    df = spark.createDataFrame([([2047, 5, 6],), ([2048, 5, 6],), ([2049, 5, 6],)], "t array<long>")
    ge = [r["k"] for r in df.select(TU.budget_keep(F.col("t"), 2048, True).alias("k")).collect()]
    gt = [r["k"] for r in df.select(TU.budget_keep(F.col("t"), 2048, False).alias("k")).collect()]
    assert ge == [[True, True, True], [True, False, False], [True, False, False]]
    assert gt == [[True, True, True], [True, True, True], [True, False, False]]


def test_interleave_and_slices(spark):
    # sources of 0, 1 and 3 rows: the empty source is absent, min count over present sources is 1
    rows = [(1, "b"), (2, "c"), (3, "c"), (4, "c")]
    df = spark.createDataFrame(rows, "id long, source string")
    got = sorted((r["id"], r["position"]) for r in interleave(df, "source", ["id"], F.col("id")).collect())
    assert got == [(1, 0), (2, 1)]
    seven = spark.createDataFrame([(i, "f") for i in range(7)], "id long, source string")

    def sl(lo, hi):
        return sorted(r["id"] for r in slice_fraction(seven, lo, hi, ["source"], ["id"], F.col("id")).collect())
    assert sl(0, 1) == list(range(7)) and sl(0, 0) == [] and sl(0.3, 0.6) == [2, 3]


def test_pad_spill_wraps(spark):
    # docs of 4, 2, 3 tokens; length 6: middle doc spills, last doc wraps to the store head (Q9)
    store = spark.createDataFrame([(0, [1, 2, 3, 4]), (1, [5, 6]), (2, [7, 8, 9])], "d long, tokens array<int>")
    st = build_store(store, "d", F.col("tokens"), ["d"], F.col("d"))
    got = {r["d"]: (r["tokens"], r["min_len"]) for r in pad_spill(st, 6).collect()}
    assert got[0] == ([1, 2, 3, 4, 5, 6], 4)
    assert got[1] == ([5, 6, 1, 2, 3, 4], 2)   # 4 + 6 > 9 tokens -> own 2 tokens + head 4
    assert got[2] == ([7, 8, 9, 1, 2, 3], 3)


def test_span_mask_markers(spark):
    u, a = [ord(c) for c in "User:"], [ord(c) for c in "Assistant:"]
    seq = [9] + a + [9, 9] + u + [9] + a[:3]
    df = spark.createDataFrame([(seq,)], "s array<int>")
    m = SB.with_span_mask(df, "s", F.lit(len(seq)), a, u, len(seq), "m").first()["m"]
    # on from the Assistant: match at 1, off from User: at 13; cut Assistant at the end does not match
    exp = [0] + [1] * 12 + [0] * (len(seq) - 13)
    assert m == exp[1:]


def test_nucleus_ties_and_top1(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 0.0, math.log(4.0)],)], "x array<double>")
    # p = [1/8,1/8,1/8,1/8,1/2]; sorted cum: .5,.625,.75,.875,1.0; first > 0.6 at .625 -> cutoff 1/8 keeps all
    p = df.select(L.nucleus("x", 0.6).alias("p")).first()["p"]
    assert [round(v, 9) for v in p] == [0.125, 0.125, 0.125, 0.125, 0.5]
    # no cumulative sum exceeds top_p -> index 0 -> only the max survives
    p1 = df.select(L.nucleus("x", 1.5).alias("p")).first()["p"]
    assert [round(v, 9) for v in p1] == [0, 0, 0, 0, 1.0]


def test_no_valid_label_gives_null(spark):
    df = spark.createDataFrame([([1.0, 2.0], -100), ([1.0, 2.0], -100)], "x array<double>, y int")
    r = df.agg(F.avg(L.cross_entropy("x", "y")).alias("ce")).first()["ce"]
    assert r is None


def test_extraction_parse_edges(spark):
    text = ('("entity"<|>"A"<|>"person"<|>"d1")##\n("entity"<|>"A"<|>"geo")##'
            '("relationship"<|>"A"<|>"B"<|>"r"<|>"k"<|>3)##("content_keywords"<|>"x")<|COMPLETE|>("entity"<|>"Z")')
    recs = spark.createDataFrame([(text,)], "t string").select(parse_records("t").alias("r")).first()["r"]
    assert [(r["tag"], r["valid"]) for r in recs] == [("entity", True), ("entity", False),
                                                      ("relationship", True), ("content_keywords", True)]
    ents = spark.createDataFrame([("N", "person", "d1"), ("N", "geo", "d2"), ("N", "person", "d1")],
                                 "name string, type string, description string")
    m = merge_entities(ents).first()
    assert (m["type"], m["description"], m["n_mentions"]) == ("person", "d1<SEP>d2", 3)


@pytest.mark.parametrize("g", [-0.01, -3.0])
def test_gated_sum_matches_recurrence(spark, g):
    from tokenforge.operators.sequence import gated_running_sum
    xs = [float((i * 7) % 11 - 5) for i in range(300)]
    df = spark.createDataFrame([(0, i, x, g) for i, x in enumerate(xs)], "k long, step long, x double, g double")
    got = {r["step"]: r["h"] for r in gated_running_sum(df, ["k"], "step", "x", "g", "h", block=64).collect()}
    h = 0.0
    for i, x in enumerate(xs):
        h = math.exp(g) * h + x
        assert abs(got[i] - h) < 1e-9 * max(1.0, abs(h))


def test_running_logsumexp_blocks(spark):
    from tokenforge.operators.sequence import running_logsumexp
    xs = [float((i * 13) % 17) * (-50 if i % 5 == 0 else 1) for i in range(200)]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(xs)], "k long, step long, x double")
    got = {r["step"]: r["l"] for r in running_logsumexp(df, ["k"], "step", "x", "l", block=16).collect()}
    for i in range(len(xs)):
        m = max(xs[:i + 1])
        exp = m + math.log(sum(math.exp(v - m) for v in xs[:i + 1]))
        assert abs(got[i] - exp) < 1e-9


@pytest.mark.parametrize("max_len", [3, 7, 12, 25])
def test_budget_bounded_builders_equal_unbounded(spark, max_len):
    import random
    from tokenforge.functions.text import ensure_suffix as ens
    rnd = random.Random(max_len)
    rows = []
    for conv in range(40):
        roles = ["system"] if rnd.random() < 0.3 else []
        roles += ["user", "assistant"] * rnd.randint(1, 4)
        for t, r in enumerate(roles):
            rows.append((conv, t, r, "x" * rnd.randint(0, 9) + ("\n\n" if rnd.random() < 0.3 else "")))
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lens = {
        "v1": F.size(T.codepoints(TU.role_prefix(F.col("role")))) + F.size(T.codepoints(ens(F.col("text")))),
        "v2": F.size(T.codepoints(TU.train_wrapper(F.col("role"), F.col("text"), False))),
        "v3": F.size(T.codepoints(ens(F.col("text")))),
    }
    build = {
        "v1": lambda t: SB.messages_builder(t, max_len),
        "v2": lambda t: SB.template_builder(t, max_len),
        "v3": lambda t: SB.from_value_builder(TU.as_from_value(t), max_len),
    }
    for v in ("v1", "v2", "v3"):
        def run(rows_df):
            t = TU.turns_from_rows(rows_df)
            ids, labels = build[v](F.col("turns"))
            return {r["conv_id"]: (r["i"], r["l"]) for r in t.select("conv_id", ids.alias("i"), labels.alias("l")).collect()}
        full = run(c)
        bounded = run(SB.turns_within_budget(c, "conv_id", "turn", lens[v], max_len))
        assert bounded == full, v
