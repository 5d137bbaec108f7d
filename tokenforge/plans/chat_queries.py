"""Conversations: formats, templates, parsers, budgets, masks and the four
sample builders (SURVEY 7.7 rows 8-11).

The ``conversations`` table is the exploded form (conv_id, turn, role, text);
each query first assembles the canonical ``turns`` array per conversation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.buckets import bucket_first_fit
from ..functions.text import cut_at_stop, ensure_suffix
from ..operators import samples as SB
from ..operators import turns as TU
from ..operators.ordered import keyed_index, keyed_scan
from ..session import materialize, scratch_path
from ..sources import corpus as IO
from ..sources.tables import read_table
from .corpus_queries import cp_sql
from .registry import query

NL2 = "chr(10) || chr(10)"
SAMPLE_LEN = 512
BUDGET = 2048


def _turns(spark, sf_dir):
    return TU.turns_from_rows(read_table(spark, sf_dir, "conversations"))


def _turns_for_samples(spark, sf_dir, token_len, max_len: int = 0):
    """Turns of each conversation that can reach a ``max_len`` sample."""
    c = read_table(spark, sf_dir, "conversations")
    return TU.turns_from_rows(SB.turns_within_budget(c, "conv_id", "turn", token_len, max_len))


def s(x: str) -> str:
    """SQL string literal with newlines spelled as chr(10)."""
    parts = x.split("\n")
    out = " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)
    return f"({out})"


ORDERED = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations)"
ENSURE = f"(CASE WHEN suffix(text, {NL2}) THEN text ELSE text || {NL2} END)"


@query("user_prompts", sql=f"""
SELECT conv_id, (idx // 2)::BIGINT AS k, text AS prompt FROM {ORDERED} WHERE idx % 2 = 0""")
def q_user_prompts(spark, sf_dir):
    """Chat B (flat list): even-index items are the user prompts (P9); turns are numbered
    by the skew-safe index, no row holds a conversation."""
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    c = keyed_index(c, ["conv_id"], ["turn"]).where(F.col("idx") % 2 == 0)
    return c.select("conv_id", F.expr("idx div 2").alias("k"), F.col("text").alias("prompt"))


@query("drop_system_first", sql=f"""
WITH o AS {ORDERED},
f AS (SELECT conv_id FROM o WHERE idx = 0 AND role = 'user' AND text <> '')
SELECT conv_id, idx::BIGINT AS idx, CASE WHEN role = 'user' THEN text ELSE '' END AS value
FROM o JOIN f USING (conv_id)""")
def q_drop_system_first(spark, sf_dir):
    """Chat C: blank every non-human value, drop the conversation when the
    first value is blank (P10): the first turn's verdict is carried along its
    conversation by the skew-safe scan."""
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    value = F.when(F.col("role") == "user", F.col("text")).otherwise(F.lit(""))
    c = keyed_index(c, ["conv_id"], ["turn"]).withColumn("value", value)
    opens = ((F.col("idx") == 0) & (F.col("value") != "")).cast("long")
    c = keyed_scan(c, ["conv_id"], ["idx"], maxes={"kept": opens}, index_col=None)
    return c.where("kept = 1").select("conv_id", "idx", "value")


@query("chat_schema_dispatch", sql=f"""
WITH o AS {ORDERED},
f AS (SELECT conv_id FROM o WHERE idx = 0 AND role = 'user' AND text <> '')
SELECT conv_id, idx::BIGINT AS idx, text AS value FROM o WHERE conv_id % 3 = 0
UNION ALL
SELECT conv_id, idx::BIGINT, CASE WHEN role = 'user' THEN text ELSE '' END FROM o JOIN f USING (conv_id)
WHERE conv_id % 3 = 1""")
def q_chat_schema_dispatch(spark, sf_dir):
    """JSON records dispatched by schema: ``data`` as is, else ``conversations``
    (blanked, P10), else dropped (P7, R8, R9).  The records are rendered from
    the table as JSON text in three shapes: ``data``, ``conversations`` and
    an unknown ``messages`` key."""
    t = _turns(spark, sf_dir)
    shape = F.pmod(F.col("conv_id"), F.lit(3))
    line = (F.when(shape == 0, F.to_json(F.struct("conv_id", TU.as_flat_list("turns").alias("data"))))
            .when(shape == 1, F.to_json(F.struct("conv_id", TU.as_from_value("turns").alias("conversations"))))
            .otherwise(F.to_json(F.struct("conv_id", F.col("turns").alias("messages")))))
    lines = t.select(line.alias("value"))
    parsed = IO.dispatch_chat_records(lines, "value")
    e = parsed.select("conv_id", F.posexplode("prompts").alias("idx", "value"))
    return e.select("conv_id", F.col("idx").cast("long"), "value")


@query("role_prefix_turns", sql=f"""
SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'Assistant : ' WHEN 'user' THEN 'User : '
       ELSE upper(left(role, 1)) || substr(role, 2) || ' : ' END AS prefix, {ENSURE} AS content
FROM conversations""")
def q_role_prefix_turns(spark, sf_dir):
    """Role prefix ``User : `` / ``Assistant : `` / capitalised (C6) and the
    blank-line suffix (C7) of every turn."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", TU.role_prefix(F.col("role")).alias("prefix"),
                    ensure_suffix(F.col("text")).alias("content"))


def _render_sql(user_pre: str, asst_pre: str, end: str, tail: str, others: str = "''") -> str:
    return f"""
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN {s(user_pre)} || text || {s(end)}
                                      WHEN 'assistant' THEN {s(asst_pre)} || text || {s(end)}
                                      ELSE {others} END, '' ORDER BY turn) || {s(tail)} AS text
FROM conversations GROUP BY conv_id"""


@query("render_template_a", sql=_render_sql(TU.LLAMA_USER_HEADER, TU.LLAMA_ASSISTANT_HEADER, TU.LLAMA_EOT,
                                            TU.LLAMA_ASSISTANT_HEADER))
def q_render_template_a(spark, sf_dir):
    """Template A with the trailing assistant header."""
    return _turns(spark, sf_dir).select("conv_id", TU.render_llama("turns").alias("text"))


@query("render_template_b", sql=_render_sql(TU.QWEN_USER_GEN, TU.QWEN_ASSISTANT_GEN, TU.QWEN_END,
                                            TU.QWEN_ASSISTANT_GEN))
def q_render_template_b(spark, sf_dir):
    """Template B, two newlines after the role."""
    return _turns(spark, sf_dir).select("conv_id", TU.render_qwen("turns").alias("text"))


MODEL_SQL = "CASE conv_id % 3 WHEN 0 THEN 'Meta-LLaMA-3' WHEN 1 THEN 'qwen2' END"


@query("render_by_model", sql=f"""
WITH a AS ({_render_sql(TU.LLAMA_USER_HEADER, TU.LLAMA_ASSISTANT_HEADER, TU.LLAMA_EOT, TU.LLAMA_ASSISTANT_HEADER)}),
b AS ({_render_sql(TU.QWEN_USER_GEN, TU.QWEN_ASSISTANT_GEN, TU.QWEN_END, TU.QWEN_ASSISTANT_GEN)})
SELECT conv_id, {MODEL_SQL} AS model, CASE WHEN conv_id % 3 = 0 THEN a.text ELSE b.text END AS text FROM a JOIN b USING (conv_id)""")
def q_render_by_model(spark, sf_dir):
    """Each conversation in the template of its row's model name."""
    model = F.when(F.col("conv_id") % 3 == 0, "Meta-LLaMA-3").when(F.col("conv_id") % 3 == 1, "qwen2")
    t = _turns(spark, sf_dir).withColumn("model", model)
    return t.select("conv_id", "model", TU.render_for_model(F.col("turns"), F.col("model")).alias("text"))


@query("cut_closing_tag", sql=f"""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN {s(TU.QWEN_USER_TRAIN)} ELSE {s(TU.QWEN_ASSISTANT_TRAIN)} END || text AS text
FROM conversations""")
def q_cut_closing_tag(spark, sf_dir):
    """Every turn in its training wrapper with the closing tag cut off again."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", TU.cut_closing_tag(TU.train_wrapper(F.col("role"), F.col("text"), False)).alias("text"))


@query("render_turns", sql=f"""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN {s(TU.QWEN_USER_TRAIN)} || text || {s(TU.QWEN_END + chr(10))}
                           ELSE {s(TU.QWEN_ASSISTANT_TRAIN)} || text || {s(TU.QWEN_END + chr(10))} END AS text
FROM conversations""")
def q_render_turns(spark, sf_dir):
    """Per-turn training wrappers, template B with one newline (C4, Q7)."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", TU.train_wrapper(F.col("role"), F.col("text"), False).alias("text"))


@query("render_history", sql=f"""
SELECT conv_id, string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || {NL2} || text || '<|eot_id|>',
                           '' ORDER BY turn) || {s(TU.LLAMA_ASSISTANT_HEADER)} AS text
FROM conversations GROUP BY conv_id""")
def q_render_history(spark, sf_dir):
    """Full history including system turns, with the generation prompt."""
    return _turns(spark, sf_dir).select("conv_id", TU.render_history("turns").alias("text"))


@query("prompt_prefixes", sql=f"""
WITH o AS {ORDERED},
p AS (SELECT conv_id, idx, CASE WHEN idx % 2 = 0 THEN {s(TU.LLAMA_USER_HEADER)} ELSE {s(TU.LLAMA_ASSISTANT_HEADER)} END
                           || text || '<|eot_id|>' AS piece FROM o)
SELECT a.conv_id, (a.idx // 2)::BIGINT AS k,
       string_agg(b.piece, '' ORDER BY b.idx) || {s(TU.LLAMA_ASSISTANT_HEADER)} AS prompt
FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.idx <= a.idx
WHERE a.idx % 2 = 0 GROUP BY a.conv_id, a.idx""")
def q_prompt_prefixes(spark, sf_dir):
    """Prompt k = every turn before user turn k, user turn k, assistant header."""
    t = _turns(spark, sf_dir).select("conv_id", TU.as_flat_list("turns").alias("data"))
    e = t.select("conv_id", F.explode(TU.prompt_prefixes("data")).alias("p"))
    return e.select("conv_id", "p.k", "p.prompt")


@query("json_lines_parse", sql="SELECT conv_id, turn, role, text FROM conversations")
def q_json_lines_parse(spark, sf_dir):
    """JSON-lines scan (S9, P5, R8): turn records are written as JSON text with
    blank and whitespace-only lines between them, then read back as lines,
    blanks skipped, each line parsed."""
    c = read_table(spark, sf_dir, "conversations")
    recs = c.select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    blanks = c.where(F.col("turn") == 0).select(
        F.when(F.pmod("conv_id", F.lit(2)) == 0, F.lit("")).otherwise(F.lit("  \t")).alias("value"))
    path = scratch_path(spark, "jsonl")
    recs.unionByName(blanks).write.mode("overwrite").text(path)
    schema = "conv_id long, turn long, role string, text string"
    return IO.read_json_lines(spark, path, schema).select("conv_id", "turn", "role", "text")


@query("label_files", sql="""
WITH n AS (SELECT conv_id, turn, role, text, 'in' || (conv_id % 5)::VARCHAR AS stem,
                  row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id * 100000 + turn) - 1 AS i,
                  count(*) OVER (PARTITION BY conv_id % 5) AS total FROM conversations)
SELECT stem || '_pseudo_labels_0.25_0.75.jsonl' AS output, (i - floor(0.25 * total))::BIGINT AS position, conv_id, turn, text
FROM n WHERE i >= floor(0.25 * total) AND i < floor(0.75 * total)""")
def q_label_files(spark, sf_dir):
    """One output per input file, named by it and the slice, rows in input order (S20):
    the turns as five input files, their middle half written and read back by line."""
    c = read_table(spark, sf_dir, "conversations")
    rows = c.select(F.concat(F.lit("/data/in"), F.pmod("conv_id", F.lit(5)).cast("string"), F.lit(".jsonl")).alias("file"),
                    (F.col("conv_id") * 100_000 + F.col("turn")).alias("line"),
                    F.to_json(F.struct("conv_id", "turn", "text")).alias("json"))
    path = scratch_path(spark, "labels")
    IO.write_labels(rows, path, "file", "line", "json", 0.25, 0.75)
    back = IO.read_labels(spark, path)
    j = F.from_json("value", "conv_id long, turn long, text string")
    return back.select("output", "position", j.alias("j")).select("output", "position", "j.conv_id", "j.turn", "j.text")


@query("json_sink_rows", sql="""
SELECT conv_id, to_json({'data': list({'role': role, 'content': text} ORDER BY turn)}) AS json
FROM conversations GROUP BY conv_id""")
def q_json_sink_rows(spark, sf_dir):
    """Labelled-output records ``{"data": [{role, content}, ..]}``; ``conv_id``
    is the row id that replaces file order (S20, R8)."""
    t = _turns(spark, sf_dir)
    return t.select("conv_id", IO.chat_record_json("turns").alias("json"))


# ------------------------------------------------------------------ builders
def _agg_list(expr: str) -> str:
    return f"flatten(list({expr} ORDER BY turn))"


def _rep(n: str) -> str:
    return f"list_transform(range({n}), lambda x: -100)"


def _pad(lst: str, n: int, v: int) -> str:
    return f"list_concat({lst}, list_transform(range(greatest({n} - len({lst}), 0)), lambda x: {v}))"


V1_SQL = f"""
WITH t AS (SELECT conv_id, turn, role,
                  {cp_sql("CASE role WHEN 'assistant' THEN 'Assistant : ' WHEN 'user' THEN 'User : ' ELSE upper(left(role, 1)) || substr(role, 2) || ' : ' END")} AS p,
                  {cp_sql(ENSURE)} AS c FROM conversations),
a AS (SELECT conv_id, list_concat([1], {_agg_list('list_concat(p, c)')}) AS ids0,
             list_concat([-100], {_agg_list(f"CASE WHEN role = 'assistant' THEN list_concat({_rep('len(p)')}, c) ELSE {_rep('len(p) + len(c)')} END")}) AS lab0
      FROM t GROUP BY conv_id),
b AS (SELECT conv_id, list_slice(ids0, 1, {SAMPLE_LEN}) AS ids, list_slice(lab0, 1, {SAMPLE_LEN}) AS lab FROM a),
c AS (SELECT conv_id, ids, list_concat(list_slice(lab, 2, {SAMPLE_LEN}), [0]) AS lab FROM b),
d AS (SELECT conv_id, {_pad('ids', SAMPLE_LEN, 0)} AS ids, {_pad('lab', SAMPLE_LEN, -100)} AS lab FROM c)
SELECT conv_id, array_to_string(ids, ',') AS input_ids, array_to_string(lab, ',') AS labels,
       len(list_filter(lab, lambda x: x <> -100))::BIGINT AS n_valid FROM d"""


def _out(df, ids, labels):
    return df.select("conv_id", T.join_ints(ids).alias("input_ids"), T.join_ints(labels).alias("labels"),
                     T.count_not(labels, T.IGNORE).cast("long").alias("n_valid"))


@query("chat_samples_v1", sql=V1_SQL)
def q_chat_samples_v1(spark, sf_dir):
    """Builder 1: messages with role prefixes, 512 ids."""
    tl = F.size(T.codepoints(TU.role_prefix(F.col("role")))) + F.size(T.codepoints(ensure_suffix(F.col("text"))))
    t = _turns_for_samples(spark, sf_dir, tl, SAMPLE_LEN)
    ids, labels = SB.messages_builder(F.col("turns"), SAMPLE_LEN)
    return _out(t, ids, labels)


V2_SQL = f"""
WITH t AS (SELECT conv_id, turn, role,
                  {cp_sql(f"CASE WHEN role = 'user' THEN {s(TU.QWEN_USER_TRAIN)} ELSE {s(TU.QWEN_ASSISTANT_TRAIN)} END || text || {s(TU.QWEN_END + chr(10))}")} AS c
           FROM conversations),
a AS (SELECT conv_id, list_concat([1], {_agg_list('c')}) AS ids,
             {_agg_list(f"CASE WHEN role = 'user' THEN {_rep('len(c)')} ELSE c END")} AS lab0 FROM t GROUP BY conv_id),
b AS (SELECT conv_id, ids, list_concat(list_slice(lab0, 2, len(lab0)), [-100]) AS lab FROM a),
d AS (SELECT conv_id,
             CASE WHEN len(ids) > {SAMPLE_LEN} THEN list_slice(ids, 1, {SAMPLE_LEN}) ELSE {_pad('ids', SAMPLE_LEN, 0)} END AS ids,
             CASE WHEN len(ids) > {SAMPLE_LEN} THEN list_slice(lab, 1, {SAMPLE_LEN}) ELSE {_pad('lab', SAMPLE_LEN, -100)} END AS lab
      FROM b)
SELECT conv_id, array_to_string(ids, ',') AS input_ids, array_to_string(lab, ',') AS labels,
       len(list_filter(lab, lambda x: x <> -100))::BIGINT AS n_valid FROM d"""


@query("chat_samples_v2", sql=V2_SQL)
def q_chat_samples_v2(spark, sf_dir):
    """Builder 2: template-B training wrappers, bos, shifted labels."""
    tl = F.size(T.codepoints(TU.train_wrapper(F.col("role"), F.col("text"), False)))
    t = _turns_for_samples(spark, sf_dir, tl, SAMPLE_LEN)
    ids, labels = SB.template_builder(F.col("turns"), SAMPLE_LEN, is_llama=False)
    return _out(t, ids, labels)


SHIFT_SQL = V2_SQL.replace("list_concat(list_slice(lab0, 2, len(lab0)), [-100])", "list_concat(lab0, [-100])")


@query("chat_samples_shift", sql=SHIFT_SQL)
def q_chat_samples_shift(spark, sf_dir):
    """Builder 2 with labels shifted by one: every id is labelled with the next."""
    t = _turns(spark, sf_dir)
    ids, labels = SB.template_builder(F.col("turns"), SAMPLE_LEN, is_llama=False, shift=1)
    return _out(t, ids, labels)


V3_SQL = f"""
WITH t AS (SELECT conv_id, turn, role, {cp_sql(ENSURE)} AS c FROM conversations),
a AS (SELECT conv_id, list_concat([1], {_agg_list('c')}) AS ids,
             list_concat({_agg_list(f"CASE WHEN role = 'assistant' THEN c ELSE {_rep('len(c)')} END")}, [0]) AS lab
      FROM t GROUP BY conv_id),
d AS (SELECT conv_id, CASE WHEN len(ids) > {SAMPLE_LEN} THEN list_slice(ids, 1, {SAMPLE_LEN}) ELSE ids END AS ids,
             CASE WHEN len(ids) > {SAMPLE_LEN} THEN list_slice(lab, 1, {SAMPLE_LEN}) ELSE lab END AS lab FROM a)
SELECT conv_id, array_to_string(ids, ',') AS input_ids, array_to_string(lab, ',') AS labels,
       len(list_filter(lab, lambda x: x <> -100))::BIGINT AS n_valid FROM d"""


@query("chat_samples_v3", sql=V3_SQL)
def q_chat_samples_v3(spark, sf_dir):
    """Builder 3: human/gpt values, labels end with eos, cut to 512."""
    tl = F.size(T.codepoints(ensure_suffix(F.col("text"))))
    t = _turns_for_samples(spark, sf_dir, tl, SAMPLE_LEN).select("conv_id", TU.as_from_value("turns").alias("conv"))
    ids, labels = SB.from_value_builder(F.col("conv"), SAMPLE_LEN)
    return _out(t, ids, labels)


def _role_text_sql() -> str:
    """Chat E text per conversation (what parse_role_text reads)."""
    return f"""(SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: '
              WHEN 'system' THEN 'System: ' END || text, {NL2} ORDER BY turn) AS rt FROM conversations GROUP BY conv_id)"""


# Python's str.strip() whitespace, as a DuckDB (RE2) class
PYWS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PARSED_SQL = f"""(SELECT conv_id, turn, role,
       CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN regexp_replace(text, '{PYWS}+$', '') ELSE text END AS text
       FROM conversations)"""


ROLE_INLINE_SQL = ("(CASE role WHEN 'user' THEN 'User : ' WHEN 'assistant' THEN 'Assistant : ' "
                   "WHEN 'system' THEN 'System : ' ELSE '' END || text)")


def _ensure_sql(x: str) -> str:
    return f"(CASE WHEN suffix({x}, {NL2}) THEN {x} ELSE {x} || {NL2} END)"


V4_SQL = f"""
WITH p AS {PARSED_SQL},
t AS (SELECT conv_id, turn, role,
             {cp_sql(_ensure_sql(ROLE_INLINE_SQL))} AS c
      FROM p),
a AS (SELECT conv_id, list_concat([1], {_agg_list('c')}) AS ids,
             list_concat({_agg_list(f"CASE WHEN role = 'assistant' THEN c ELSE {_rep('len(c)')} END")}, [0]) AS lab
      FROM t GROUP BY conv_id),
d AS (SELECT conv_id, CASE WHEN len(ids) > {SAMPLE_LEN} THEN list_slice(ids, 1, {SAMPLE_LEN}) ELSE ids END AS ids,
             CASE WHEN len(ids) > {SAMPLE_LEN} THEN list_slice(lab, 1, {SAMPLE_LEN}) ELSE lab END AS lab FROM a)
SELECT conv_id, array_to_string(ids, ',') AS input_ids, array_to_string(lab, ',') AS labels,
       len(list_filter(lab, lambda x: x <> -100))::BIGINT AS n_valid,
       CASE WHEN greatest(ceil(len(ids) / 256) * 256, 256) <= 512 THEN greatest(ceil(len(ids) / 256) * 256, 256)
            ELSE 768 END::BIGINT AS bucket_hi FROM d"""


@query("chat_samples_v4", sql=V4_SQL)
def q_chat_samples_v4(spark, sf_dir):
    """Builder 4: role text parsed to turns, role prefix inside the content,
    cut to 512, first-fit bucket of step 256 below 768 (Y11, W10, Y16)."""
    t = _turns(spark, sf_dir).select("conv_id", TU.as_role_text("turns").alias("rt"))
    t = TU.parse_role_text(t, "rt", "turns")
    ids, labels = SB.role_text_builder(F.col("turns"), SAMPLE_LEN)
    t = t.select("conv_id", ids.alias("ids"), labels.alias("labels"))
    return t.select("conv_id", T.join_ints("ids").alias("input_ids"), T.join_ints("labels").alias("labels"),
                    T.count_not("labels", T.IGNORE).cast("long").alias("n_valid"),
                    bucket_first_fit(F.size("ids"), 256, 768).alias("bucket_hi"))


# ------------------------------------------------------------------ parsers
@query("parse_role_text", sql=f"SELECT conv_id, turn, role, text FROM {PARSED_SQL}")
def q_parse_role_text(spark, sf_dir):
    """Chat E text rendered from the table, parsed back into turns."""
    t = _turns(spark, sf_dir).select("conv_id", TU.as_role_text("turns").alias("rt"))
    e = TU.parse_role_text(t, "rt", "parsed").select("conv_id", F.posexplode("parsed").alias("turn", "t"))
    return e.select("conv_id", F.col("turn").cast("long"), F.col("t.role").alias("role"),
                    F.col("t.content").alias("text"))


@query("text_string_or_list", sql=f"""
SELECT conv_id, turn, role, CASE WHEN conv_id % 2 = 0 THEN text ELSE rt END AS text
FROM conversations JOIN (SELECT conv_id, turn, text AS rt FROM {PARSED_SQL}) USING (conv_id, turn)""")
def q_text_string_or_list(spark, sf_dir):
    """JSON records whose ``text`` is a list of turns (even conversations) or one role
    text, in one column, told apart per record (P8)."""
    t = _turns(spark, sf_dir).select(
        "conv_id", F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.col("turns").alias("text"))))
        .otherwise(F.to_json(F.struct(TU.as_role_text("turns").alias("text")))).alias("value"))
    e = IO.text_turns(t).select("conv_id", F.posexplode("turns").alias("turn", "t"))
    return e.select("conv_id", F.col("turn").cast("long"), F.col("t.role").alias("role"), F.col("t.content").alias("text"))


@query("parse_tag_pairs", sql=f"""
WITH r AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN {s(TU.LLAMA_USER_HEADER)} || text || '<|eot_id|>'
                                               WHEN 'assistant' THEN {s(TU.LLAMA_ASSISTANT_HEADER)} || text || '<|eot_id|>'
                                               ELSE '' END, '' ORDER BY turn) || {s(TU.LLAMA_ASSISTANT_HEADER)} AS txt
           FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, list_slice(string_split(txt, {s(TU.LLAMA_USER_HEADER)}), 2, len(string_split(txt, {s(TU.LLAMA_USER_HEADER)}))) AS pieces FROM r),
u AS (SELECT conv_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS j FROM p),
v AS (SELECT conv_id, j, piece, strpos(piece, {s(TU.LLAMA_ASSISTANT_HEADER)}) AS apos FROM u),
w AS (SELECT *, min(apos) OVER (PARTITION BY conv_id ORDER BY j) AS min_at FROM v)
SELECT conv_id, (2 * j)::BIGINT AS k, substr(piece, 1, apos - 1) AS text FROM w WHERE min_at > 0
UNION ALL
SELECT conv_id, (2 * j + 1)::BIGINT, substr(piece, apos + {len(TU.LLAMA_ASSISTANT_HEADER)}) FROM w WHERE min_at > 0""")
def q_parse_tag_pairs(spark, sf_dir):
    """Template-A text rendered from the table, split back into alternating
    prompt / response strings at the header tags (W11)."""
    t = _turns(spark, sf_dir).select("conv_id", TU.render_llama("turns").alias("txt"))
    e = t.select("conv_id", F.posexplode(TU.parse_tag_pairs(F.col("txt"))).alias("k", "text"))
    return e.select("conv_id", F.col("k").cast("long"), "text")


# ------------------------------------------------------------------ budgets, masks
@query("token_budget_cut", sql=f"""
WITH o AS {ORDERED},
p AS (SELECT conv_id, idx, length(CASE WHEN idx % 2 = 0 THEN {s(TU.LLAMA_USER_HEADER)} ELSE {s(TU.LLAMA_ASSISTANT_HEADER)} END
                              || text || '<|eot_id|>') AS plen, length(text) AS tlen FROM o),
c AS (SELECT conv_id, idx, sum(plen) OVER (PARTITION BY conv_id ORDER BY idx) AS cum FROM p),
u AS (SELECT c.conv_id, c.idx // 2 AS k,
             c.cum + {len(TU.LLAMA_ASSISTANT_HEADER)} + coalesce(r.tlen, 0) AS total
      FROM c LEFT JOIN p r ON r.conv_id = c.conv_id AND r.idx = c.idx + 1 WHERE c.idx % 2 = 0),
x AS (SELECT *, coalesce(bool_or(total >= {BUDGET}) OVER (PARTITION BY conv_id ORDER BY k
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM u)
SELECT conv_id, k::BIGINT AS k, total::BIGINT AS total_tokens FROM x WHERE NOT stopped""")
def q_token_budget_cut(spark, sf_dir):
    """Pairs kept under a 2048-token budget, ``>=`` variant: pair total =
    prompt-k tokens + reply tokens; the crossing pair is kept (W9, Q14).  Sizes only, by
    running sums over the turn rows: no prompt is built and no row holds a conversation."""
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    c = keyed_index(c.select("conv_id", "turn", F.char_length("text").cast("long").alias("n")), ["conv_id"], ["turn"], name="i")
    user = F.col("i") % 2 == 0
    piece = F.col("n") + F.when(user, len(TU.LLAMA_USER_HEADER)).otherwise(len(TU.LLAMA_ASSISTANT_HEADER)) + len(TU.LLAMA_EOT)
    c = keyed_scan(c, ["conv_id"], ["i"], sums={"cum": piece}, index_col=None)
    p = c.groupBy("conv_id", F.expr("i div 2").alias("k")).agg(
        F.max(F.when(user, F.col("cum"))).alias("cum"), F.coalesce(F.max(F.when(~user, F.col("n"))), F.lit(0)).alias("reply"))
    p = p.withColumn("total_tokens", F.col("cum") + len(TU.LLAMA_ASSISTANT_HEADER) + F.col("reply"))
    over = (F.col("total_tokens") >= BUDGET).cast("long")
    p = keyed_scan(p, ["conv_id"], ["k"], sums={"stops": over}, index_col=None)
    return p.where(F.col("stops") - over == 0).select("conv_id", "k", "total_tokens")


def _mask_seq_sql() -> str:
    return f"""(SELECT conv_id, {cp_sql('rt')} AS seq FROM {_role_text_sql()})"""


U_MARK = [ord(c) for c in "User:"]
A_MARK = [ord(c) for c in "Assistant:"]


@query("span_mask", sql=f"""
WITH q AS {_mask_seq_sql()},
m AS (SELECT conv_id, seq, len(seq) AS ml FROM q),
e AS (SELECT conv_id, ml, i, CASE WHEN i <= ml - 5 AND list_slice(seq, i + 1, i + 5) = {U_MARK} THEN 0
                                  WHEN i <= ml - 10 AND list_slice(seq, i + 1, i + 10) = {A_MARK} THEN 1 END AS ev
      FROM (SELECT conv_id, seq, ml, unnest(range(ml)) AS i FROM m)),
f AS (SELECT conv_id, i, coalesce(last_value(ev IGNORE NULLS) OVER
            (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS v FROM e)
SELECT conv_id, count(*) AS n, md5(string_agg(v::VARCHAR, ',' ORDER BY i)) AS mask_md5, sum(v)::BIGINT AS n_on
FROM f WHERE i >= 1 GROUP BY conv_id""")
def q_span_mask(spark, sf_dir):
    """Loss mask of a whole conversation's role text: off from ``User:``, on from
    ``Assistant:``; first position dropped (W12)."""
    t = _turns(spark, sf_dir).select("conv_id", T.codepoints(TU.as_role_text("turns")).alias("seq"))
    t = SB.with_span_mask(t, "seq", F.size("seq"), A_MARK, U_MARK, F.size("seq"), "m")
    return t.select("conv_id", F.size("m").cast("long").alias("n"), T.digest_ints("m").alias("mask_md5"),
                    T.int_sum("m").alias("n_on"))


QA_MARK = [10, 10, ord("A"), ord("s")]


@query("qa_mask", sql=f"""
WITH q AS {_mask_seq_sql()},
e AS (SELECT conv_id, i, CASE WHEN i < 3 THEN NULL WHEN seq[i + 1] = 0 THEN 0
                              WHEN list_slice(seq, i - 2, i + 1) = {QA_MARK} THEN 1 END AS ev
      FROM (SELECT conv_id, seq, unnest(range(len(seq))) AS i FROM q)),
f AS (SELECT conv_id, i, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS z FROM e),
g AS (SELECT conv_id, max(z) AS any_on FROM f GROUP BY conv_id),
h AS (SELECT conv_id, count(*) AS n, string_agg(CASE WHEN any_on = 1 THEN z ELSE 1 END::VARCHAR, ',' ORDER BY i) AS mask,
             sum(CASE WHEN any_on = 1 THEN z ELSE 1 END)::BIGINT AS n_on, any_on = 0 AS fallback
      FROM f JOIN g USING (conv_id) GROUP BY conv_id, any_on),
o AS (SELECT mask, n, n_on, row_number() OVER (ORDER BY conv_id) - 1 AS idx, count(*) OVER () AS total FROM h WHERE NOT fallback),
b AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS k FROM h WHERE fallback)
SELECT h.conv_id, CASE WHEN o.mask IS NULL THEN h.n ELSE o.n END AS n, md5(coalesce(o.mask, h.mask)) AS mask_md5,
       coalesce(o.n_on, h.n_on) AS n_on, fallback
FROM h LEFT JOIN b USING (conv_id) LEFT JOIN o ON b.k % o.total = o.idx""")
def q_qa_mask(spark, sf_dir):
    """QA mask over whole conversations: on after ``\\n\\nAs`` (the tokens of a
    blank line and an assistant turn), off at eos 0; all ones when never on, and such a
    row is replaced by one of the others, in turn (W13)."""
    t = _turns(spark, sf_dir).select("conv_id", T.codepoints(TU.as_role_text("turns")).alias("seq"))
    t = SB.with_marker_mask(t, "seq", QA_MARK, 0, F.size("seq"), "z", "fallback")
    t = materialize(t.select("conv_id", F.size("z").cast("long").alias("n"), T.digest_ints("z").alias("mask_md5"),
                             T.int_sum("z").alias("n_on"), "fallback"))
    others = keyed_index(t.where("NOT fallback"), [], ["conv_id"])
    return SB.replace_fallback(t, "conv_id", "conv_id", others, ["n", "mask_md5", "n_on"])


@query("cut_at_stop", sql="""
SELECT conv_id, turn, split_part(text, chr(10), 1) AS text FROM conversations WHERE role = 'assistant'""")
def q_cut_at_stop(spark, sf_dir):
    """Assistant replies cut before the first stop string (newline) (C17)."""
    c = read_table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return c.select("conv_id", "turn", cut_at_stop(F.col("text"), "\n").alias("text"))

