"""Queries that prompt a model in rounds: the extraction loop and its merge.

The models are the stubs of :mod:`..operators.infer` (everything follows from the md5
of the prompt), so SQL can unroll the rounds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import infer as INF
from ..sources.tables import read_table
from .chat_queries import s
from .infer_queries import EXTRACT_SQL_CTE, EXTRACTION_TEMPLATE, EXTRACTION_VALUES, _extraction_output, template_sql
from .registry import query

ROUNDS = 3

OUTPUT_SQL = """('("entity"<|>"E' || h[1:4] || '"<|>concept<|>"' || h[9:16] || '")##("entity"<|>"E' || h[5:8]
    || '"<|>event<|>"' || h[17:24] || '")##("relationship"<|>"E' || h[1:4] || '"<|>"E' || h[5:8] || '"<|>"' || h[25:28]
    || '"<|>kw' || h[29:29] || '<|>' || ((strpos('0123456789abcdef', h[30:30]) - 1) % 9 + 1)::VARCHAR || ')<|COMPLETE|>')"""


def _rounds_sql() -> str:
    """CTEs p0, p1, .. (conv_id, turn, round, h, said): the prompts of each round."""
    prompt = template_sql(EXTRACTION_TEMPLATE, {**{k: s(v) for k, v in EXTRACTION_VALUES.items()}, "input_text": "text"})
    parts = [f"p0 AS (SELECT conv_id, turn, 0 AS round, {prompt} AS said, md5(said) AS h FROM conversations)"]
    for i in range(1, ROUNDS):
        parts.append(f"""q{i} AS (SELECT conv_id, turn, said || {OUTPUT_SQL} || {s(INF.GATE_PROMPT)} AS asked FROM p{i - 1}),
p{i} AS (SELECT conv_id, turn, {i} AS round, asked || ' {INF.AFFIRMATIVE}' || chr(10) || {s(INF.CONTINUE_PROMPT)} AS said,
               md5(said) AS h FROM q{i} WHERE md5(asked)[1:1] < '6')""")
    return ",\n".join(parts)


def _loop(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    values = {**{k: F.lit(v) for k, v in EXTRACTION_VALUES.items()}, "input_text": F.col("text")}
    chunks = c.select("conv_id", "turn", X.render(EXTRACTION_TEMPLATE, values).alias("prompt"))
    return INF.extraction_loop(chunks, ["conv_id", "turn"], "prompt", INF.md5_extractor, INF.md5_gate, ROUNDS)


@query("extraction_loop", sql=f"""
WITH {_rounds_sql()},
r AS ({" UNION ALL ".join(f"SELECT conv_id, turn, round, h FROM p{i}" for i in range(ROUNDS))})
SELECT conv_id, turn, round::BIGINT AS round, 0::BIGINT AS rec_no, 'entity' AS tag, 'E' || h[1:4] AS name, h[9:16] AS description FROM r
UNION ALL SELECT conv_id, turn, round, 1, 'entity', 'E' || h[5:8], h[17:24] FROM r
UNION ALL SELECT conv_id, turn, round, 2, 'relationship', 'E' || h[1:4], h[25:28] FROM r""")
def q_extraction_loop(spark, sf_dir):
    """Records extracted from every turn in up to three rounds; a turn is prompted
    again while its gate answer is yes (F8, C14, C12)."""
    e = _loop(spark, sf_dir).select("conv_id", "turn", "round", F.posexplode(X.parse_records("output")).alias("rec_no", "r"))
    return e.where("r.valid").select("conv_id", "turn", "round", F.col("rec_no").cast("long"), "r.tag",
                                     F.col("r.f1").alias("name"), F.col("r.f3").alias("description"))


@query("extraction_gate", sql=f"""
WITH {_rounds_sql()},
r AS ({" UNION ALL ".join(f"SELECT conv_id, turn, round, h FROM p{i}" for i in range(ROUNDS))})
SELECT conv_id, turn, count(*) AS n_rounds, count(*) = {ROUNDS} AS cut_off FROM r GROUP BY conv_id, turn""")
def q_extraction_gate(spark, sf_dir):
    """How many rounds each turn took, and whether the bound on rounds ended it (C14)."""
    g = _loop(spark, sf_dir).groupBy("conv_id", "turn").agg(F.count("*").alias("n_rounds"))
    return g.withColumn("cut_off", F.col("n_rounds") == ROUNDS)


@query("merge_relations", sql=f"""
WITH {EXTRACT_SQL_CTE},
re AS (SELECT f1 AS src, f2 AS dst, f3 AS description, f4 AS keywords, f5::DOUBLE AS strength FROM parsed
       WHERE tag = 'relationship' AND valid)
SELECT src, dst, array_to_string(list_sort(list_distinct(list(description))), '<SEP>') AS description,
       array_to_string(list_sort(list_distinct(list(keywords))), '<SEP>') AS keywords,
       sum(strength) AS strength, count(*) AS n_mentions FROM re GROUP BY src, dst""")
def q_merge_relations(spark, sf_dir):
    """Repeated relations merged per (source, target): descriptions and keywords joined
    with ``<SEP>``, strengths added (C13)."""
    o = _extraction_output(spark, sf_dir).withColumn("recs", X.parse_records("output"))
    return X.merge_relationships(o, "conv_id", "recs").select("src", "dst", "description", "keywords", "strength", "n_mentions")
