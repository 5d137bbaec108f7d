"""Model-in-the-loop and extraction queries.

The generator / scorer is the deterministic stub of :mod:`..operators.infer`
(reply = md5 of the prompt, token count = prompt length), so SQL can check
the plumbing: batching, turn order, budgets, joins back to the inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import extract as X
from ..operators import infer as INF
from ..operators import turns as TU
from ..operators.ordered import keyed_index
from ..sources.tables import read_table
from .chat_queries import ORDERED, s
from .corpus_queries import cp_sql
from .registry import query

PYWS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def template_sql(template: str, values: dict[str, str]) -> str:
    """The SQL concatenation equal to ``fill_template(template, values)``."""
    parts, pos = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{([A-Za-z_][A-Za-z0-9_]*)\}", template):
        if m.start() > pos:
            parts.append(s(template[pos:m.start()]))
        tok = m.group(0)
        parts.append("'{'" if tok == "{{" else "'}'" if tok == "}}" else f"({values[m.group(1)]})")
        pos = m.end()
    if pos < len(template):
        parts.append(s(template[pos:]))
    return " || ".join(parts)


# ------------------------------------------------------------------ inference
@query("score_distinct_prompts", sql="SELECT doc_id, md5(text) AS reply FROM documents")
def q_score_distinct_prompts(spark, sf_dir):
    """Each distinct text is scored once and the reply joined back to every
    document carrying it (J5)."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return INF.score_distinct(d, "text", "reply").select("doc_id", "reply")


PL_SQL = f"""
WITH RECURSIVE u AS (SELECT conv_id, idx // 2 AS k, text FROM {ORDERED} WHERE idx % 2 = 0),
r AS (SELECT conv_id, 0 AS k, {s(TU.LLAMA_USER_HEADER)} || text || '<|eot_id|>' || {s(TU.LLAMA_ASSISTANT_HEADER)} AS prompt,
             {s(TU.LLAMA_USER_HEADER)} || text || '<|eot_id|>' AS hist FROM u WHERE k = 0
      UNION ALL
      SELECT r.conv_id, r.k + 1,
             r.hist || {s(TU.LLAMA_ASSISTANT_HEADER)} || md5(r.prompt) || '<|eot_id|>' || {s(TU.LLAMA_USER_HEADER)} || u.text
                    || '<|eot_id|>' || {s(TU.LLAMA_ASSISTANT_HEADER)},
             r.hist || {s(TU.LLAMA_ASSISTANT_HEADER)} || md5(r.prompt) || '<|eot_id|>' || {s(TU.LLAMA_USER_HEADER)} || u.text
                    || '<|eot_id|>'
      FROM r JOIN u ON u.conv_id = r.conv_id AND u.k = r.k + 1 WHERE length(r.prompt) < 2048)
SELECT conv_id, k::BIGINT AS k, md5(prompt) AS reply, length(prompt)::BIGINT AS n_tokens FROM r"""


@query("pseudo_label_stub", sql=PL_SQL)
def q_pseudo_label_stub(spark, sf_dir):
    """Turn-by-turn pseudo-labelling of the user turns with the stub teacher;
    stops after the pair whose token count reaches 2048 (F5, W8, W9)."""
    t = TU.turns_from_rows(read_table(spark, sf_dir, "conversations"))
    t = t.select("conv_id", TU.even_items(TU.as_flat_list("turns")).alias("users"))
    r = INF.label_conversations(t, "conv_id", "users", INF.md5_generator, 2048, inclusive=True, checkpoint=True,
                                with_prompts=False)
    return r.select("conv_id", "k", "reply", "n_tokens")


@query("gather_score_scatter", sql="""
SELECT conv_id, turn, conv_id % 4 AS rank,
       (row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn) - 1)::BIGINT AS row, md5(text) AS score
FROM conversations""")
def q_gather_score_scatter(spark, sf_dir):
    """Turns of four ranks (``conv_id % 4``) stacked, scored in one pass and
    returned to their (rank, row) (J4)."""
    c = read_table(spark, sf_dir, "conversations").withColumn("rank", F.pmod("conv_id", F.lit(4)))
    c = keyed_index(c, ["rank"], ["conv_id", "turn"], F.col("conv_id"), "row")
    r = INF.gather_score_scatter(c, "rank", "row", "text", "score")
    return r.select("conv_id", "turn", "rank", "row", "score")


@query("teacher_score_stub", sql=f"""
WITH d AS (SELECT doc_id, {cp_sql('text')} AS ids FROM documents),
p AS (SELECT doc_id, unnest(ids) AS id FROM d)
SELECT doc_id, (count(*) // 8)::BIGINT AS n_positions, sum((id * (v + 1)) % 97)::BIGINT AS total,
       sum((id * (v + 1)) % 97) FILTER (v = 7)::BIGINT AS last_class
FROM p, range(8) AS r(v) GROUP BY doc_id""")
def q_teacher_score_stub(spark, sf_dir):
    """Teacher scoring of every whole document into one row of class scores a position,
    with an injected scorer (F7); the rows are added up per document, in 97ths."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    d = d.select("doc_id", T.codepoints("text").alias("ids"))
    r = INF.teacher_scores(d, "doc_id", "ids", INF.cosine_stub_scorer(8))
    # plain expressions: a lambda over the scores would be interpreted for every position
    part = [F.floor(F.element_at("logits", v + 1) * 97 + 0.5).cast("long") for v in range(8)]
    return r.groupBy("doc_id").agg(F.count("*").alias("n_positions"), F.sum(sum(part[1:], part[0])).alias("total"),
                                   F.sum(part[-1]).alias("last_class"))


# ------------------------------------------------------------------ extraction
EXTRACTION_TEMPLATE = (
    "-Goal-\nFind every entity of the types [{entity_types}] in the text below and every relation "
    "between two of them.\nEntity: (\"entity\"{tuple_delimiter}<name>{tuple_delimiter}<type>"
    "{tuple_delimiter}<description>)\nRelation: (\"relationship\"{tuple_delimiter}<source>"
    "{tuple_delimiter}<target>{tuple_delimiter}<description>{tuple_delimiter}<keywords>"
    "{tuple_delimiter}<strength>)\nKeywords: (\"content_keywords\"{tuple_delimiter}<keywords>)\n"
    "Separate records with {record_delimiter}; end with {completion_delimiter}.\n"
    "Answer in {language}. Literal braces look like {{this}}.\nText: {input_text}\nOutput:\n")
EXTRACTION_VALUES = {"tuple_delimiter": X.TUPLE_DELIMITER, "record_delimiter": X.RECORD_DELIMITER,
                     "completion_delimiter": X.COMPLETION_DELIMITER,
                     "entity_types": "organization, person, geo, event", "language": "English"}


@query("render_extraction_prompt", sql="SELECT doc_id, " + template_sql(
    EXTRACTION_TEMPLATE, {**{k: s(v) for k, v in EXTRACTION_VALUES.items()}, "input_text": "text"})
    + " AS prompt FROM documents")
def q_render_extraction_prompt(spark, sf_dir):
    """Extraction prompt per document from named placeholders; ``{{``/``}}``
    are literal braces (C10)."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    vals = {k: F.lit(v) for k, v in EXTRACTION_VALUES.items()}
    vals["input_text"] = F.col("text")
    return d.select("doc_id", X.render(EXTRACTION_TEMPLATE, vals).alias("prompt"))


def _extraction_output(spark, sf_dir):
    """Teacher-style extraction output per conversation, rendered from its
    turns: an entity per turn (every 7th malformed), a relationship to the
    previous turn's entity, a closing keyword record; every 10th
    conversation lacks the completion mark."""
    t = TU.turns_from_rows(read_table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id").cast("string")

    def name(x):
        return F.concat(F.upper(x["role"]), F.lit("_"), conv)

    def ent(x, i):
        typ = (F.when(F.pmod(i, F.lit(3)) == 0, "person").when(F.pmod(i, F.lit(3)) == 1, "organization")
               .otherwise("event"))
        head = F.concat(F.lit('("entity"<|>"'), name(x), F.lit('"<|>"'), typ)
        return F.when(F.pmod(i, F.lit(7)) == 3, F.concat(head, F.lit('")'))).otherwise(
            F.concat(head, F.lit('"<|>"'), F.substring(x["content"], 1, 24), F.lit('")')))

    def rel(x, i):
        prev = F.element_at("turns", F.greatest(i, F.lit(1)))
        return F.concat(F.lit('("relationship"<|>"'), name(prev), F.lit('"<|>"'), name(x), F.lit('"<|>"turn '),
                        i.cast("string"), F.lit('"<|>"reply"<|>'), (F.pmod(i, F.lit(9)) + 1).cast("string"), F.lit(")"))

    recs = F.flatten(F.transform("turns", lambda x, i: F.when(i == 0, F.array(ent(x, i)))
                                 .otherwise(F.array(ent(x, i), rel(x, i)))))
    last_role = F.element_at("turns", -1)["role"]
    allr = F.concat(recs, F.array(F.concat(F.lit('("content_keywords"<|>"'), last_role, F.lit(',chat")'))))
    body = F.array_join(allr, "##\n")
    out = F.when(F.pmod("conv_id", F.lit(10)) == 9, body).otherwise(F.concat(body, F.lit(X.COMPLETION_DELIMITER)))
    return t.select("conv_id", out.alias("output"))


EXTRACT_SQL_CTE = f"""
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i,
             upper(role) || '_' || conv_id::VARCHAR AS n,
             CASE (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 3 WHEN 0 THEN 'person'
                  WHEN 1 THEN 'organization' ELSE 'event' END AS typ
      FROM conversations),
e AS (SELECT *, CASE WHEN i % 7 = 3 THEN '("entity"<|>"' || n || '"<|>"' || typ || '")'
                     ELSE '("entity"<|>"' || n || '"<|>"' || typ || '"<|>"' || substr(text, 1, 24) || '")' END AS ent,
             lag(n) OVER (PARTITION BY conv_id ORDER BY turn) AS pn,
             last_value(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING
                                    AND UNBOUNDED FOLLOWING) AS last_role FROM o),
r AS (SELECT conv_id, i * 2 AS pos, ent AS rec, last_role FROM e
      UNION ALL
      SELECT conv_id, i * 2 + 1, '("relationship"<|>"' || pn || '"<|>"' || n || '"<|>"turn ' || i::VARCHAR
             || '"<|>"reply"<|>' || (i % 9 + 1)::VARCHAR || ')', last_role FROM e WHERE i > 0),
g AS (SELECT conv_id, string_agg(rec, '##' || chr(10) ORDER BY pos) || '##' || chr(10)
             || '("content_keywords"<|>"' || any_value(last_role) || ',chat")' AS body FROM r GROUP BY conv_id),
outp AS (SELECT conv_id, CASE WHEN conv_id % 10 = 9 THEN body ELSE body || '<|COMPLETE|>' END AS output FROM g),
recs AS (SELECT conv_id, unnest(list_filter(list_transform(string_split(split_part(output, '<|COMPLETE|>', 1), '##'),
                lambda x: regexp_replace(x, '^{PYWS}+|{PYWS}+$', '', 'g')), lambda x: x <> '')) AS rec,
                unnest(range(len(list_filter(list_transform(string_split(split_part(output, '<|COMPLETE|>', 1), '##'),
                lambda x: regexp_replace(x, '^{PYWS}+|{PYWS}+$', '', 'g')), lambda x: x <> '')))) AS rec_no
         FROM outp),
f AS (SELECT conv_id, rec_no, list_transform(string_split(regexp_replace(regexp_replace(rec, '^\\(', ''), '\\)$', ''), '<|>'),
                lambda x: regexp_replace(regexp_replace(x, '^{PYWS}+|{PYWS}+$', '', 'g'), '^"+|"+$', '', 'g')) AS fs FROM recs),
parsed AS (SELECT conv_id, rec_no::BIGINT AS rec_no, fs[1] AS tag, fs[2] AS f1, fs[3] AS f2, fs[4] AS f3, fs[5] AS f4,
                  fs[6] AS f5, len(fs)::INTEGER AS n_fields,
                  coalesce(CASE fs[1] WHEN 'entity' THEN len(fs) = 4 WHEN 'relationship' THEN len(fs) = 6
                                      WHEN 'content_keywords' THEN len(fs) = 2 END, false) AS valid FROM f)"""


@query("parse_extraction", sql=f"WITH {EXTRACT_SQL_CTE} SELECT * FROM parsed")
def q_parse_extraction(spark, sf_dir):
    """Parse extraction output: completion cut, ``##`` records, ``<|>``
    fields, tag dispatch with arity check; malformed records are flagged
    ``valid = false`` for quarantine (C12, P12)."""
    o = _extraction_output(spark, sf_dir).withColumn("recs", X.parse_records("output"))
    e = o.select("conv_id", F.posexplode("recs").alias("rec_no", "r"))
    return e.select("conv_id", F.col("rec_no").cast("long"), "r.tag", "r.f1", "r.f2", "r.f3", "r.f4", "r.f5",
                    "r.n_fields", "r.valid")


@query("merge_entities", sql=f"""
WITH {EXTRACT_SQL_CTE},
en AS (SELECT f1 AS name, f2 AS type, f3 AS description FROM parsed WHERE tag = 'entity' AND valid),
tc AS (SELECT name, type, count(*) AS c FROM en GROUP BY name, type),
best AS (SELECT name, arg_min(type, (-c, type)) AS type, sum(c)::BIGINT AS n_mentions FROM tc GROUP BY name),
ds AS (SELECT name, array_to_string(list_sort(list_distinct(list(description))), '<SEP>') AS description FROM en GROUP BY name)
SELECT name, type, n_mentions, description FROM best JOIN ds USING (name)""")
def q_merge_entities(spark, sf_dir):
    """Repeated entities merged: majority type, descriptions joined with
    ``<SEP>`` (C13)."""
    o = _extraction_output(spark, sf_dir).withColumn("recs", X.parse_records("output"))
    m = X.merge_entities(X.entities(o, "conv_id", "recs"))
    return m.select("name", "type", "n_mentions", "description")


@query("parse_keywords", sql=f"""
WITH a AS (SELECT conv_id, turn, text,
                  CASE WHEN turn % 5 = 2 THEN '{{"high_level_keywords": ["' || split_part(text, ' ', 1)
                       ELSE to_json({{'high_level_keywords': [split_part(text, ' ', 1), split_part(text, ' ', 2)],
                                     'low_level_keywords': [split_part(text, ' ', 3)]}})::VARCHAR END AS answer
           FROM conversations WHERE role = 'user'),
p AS (SELECT conv_id, turn, json_valid(answer) AS ok,
             try_cast(answer AS JSON) AS j FROM a)
SELECT conv_id, turn, 'high' AS level, unnest((j->'high_level_keywords')::VARCHAR[]) AS keyword FROM p WHERE ok
UNION ALL
SELECT conv_id, turn, 'low', unnest((j->'low_level_keywords')::VARCHAR[]) FROM p WHERE ok
UNION ALL
SELECT conv_id, turn, 'none', {s(X.FAIL_RESPONSE)} FROM p WHERE NOT ok""")
def q_parse_keywords(spark, sf_dir):
    """Keyword answers (JSON with high/low level lists) rendered from the user
    turns - every 5th one cut short - parsed into rows; an unparsable answer
    gives the fixed refusal text (C20)."""
    c = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    w = F.split("text", " ")
    wd = lambda i: F.coalesce(F.try_element_at(w, F.lit(i)), F.lit(""))
    full = F.to_json(F.struct(F.array(wd(1), wd(2)).alias("high_level_keywords"),
                              F.array(wd(3)).alias("low_level_keywords")))
    cut = F.concat(F.lit('{"high_level_keywords": ["'), wd(1))
    a = c.select("conv_id", "turn", F.when(F.pmod("turn", F.lit(5)) == 2, cut).otherwise(full).alias("answer"))
    k = X.keyword_rows(a, "answer").select("conv_id", "turn", F.explode("_kw").alias("z"))
    return k.select("conv_id", "turn", "z.level", "z.keyword")


ANSWER_TEMPLATE = ("Summarise the descriptions below into one comprehensive description of the entity.\n"
                   "Entity: {entity_name}\nDescriptions:\n{description_list}\nSummary:\n")


@query("render_answer_prompt", sql=f"""
WITH {EXTRACT_SQL_CTE},
en AS (SELECT f1 AS name, f3 AS description FROM parsed WHERE tag = 'entity' AND valid),
gg AS (SELECT name, array_to_string(list_sort(list(description)), chr(10)) AS dl FROM en GROUP BY name)
SELECT name, {template_sql(ANSWER_TEMPLATE, {"entity_name": "name", "description_list": "dl"})} AS prompt FROM gg""")
def q_render_answer_prompt(spark, sf_dir):
    """Per entity, the sorted description lines aggregated and rendered into
    a summary prompt (C19)."""
    o = _extraction_output(spark, sf_dir).withColumn("recs", X.parse_records("output"))
    en = X.entities(o, "conv_id", "recs")
    g = en.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("description")), "\n").alias("dl"))
    return g.select("name", X.render(ANSWER_TEMPLATE, {"entity_name": F.col("name"),
                                                       "description_list": F.col("dl")}).alias("prompt"))

