"""One query per operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import (byte_bpe, decontam, html_extract, jaccard_join, kd_shards, language_id, merkle, packing, pii,
               prefix_trie, quality_model, quality_rules, toxicity)
from .common import bound_batches, held_out

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            bound_batches(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return deco


WORDS_SQL = r"""
regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op1_winnowing_decontamination", sql=rf"""
WITH d AS (SELECT doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n,
              array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op1_winnowing_decontamination(spark, sf_dir):
    """Every document against the whole benchmark."""
    found = decontam.decontaminate(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                                   read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op2_compression_toxicity")
def op2_compression_toxicity(spark, sf_dir):
    """Toxicity of every whole text, learnt from the labels that aren't held out."""
    out = toxicity.toxicity(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                            read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_windows", "n_toxic")


@query("op3_kd_shards")
def op3_kd_shards(spark, sf_dir):
    """All documents in 16 shards of near-equal bytes."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
    return kd_shards.kd_shards(docs, 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op4_wrapper_extraction")
def op4_wrapper_extraction(spark, sf_dir):
    """Main text of every page."""
    return html_extract.html_extract(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]), ["page_id", "url"])


@query("op5_crf_personal_data")
def op5_crf_personal_data(spark, sf_dir):
    """Personal data in every whole text."""
    return pii.personal_data(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), ["doc_id"])


@query("op6_jaccard_components")
def op6_jaccard_components(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


@query("op7_byte_bpe_round_trip")
def op7_byte_bpe_round_trip(spark, sf_dir):
    """Every whole text encoded and decoded."""
    return byte_bpe.round_trip(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), ["doc_id"])


@query("op8_ordinal_quality")
def op8_ordinal_quality(spark, sf_dir):
    """Expected grade and tail probability of every whole text."""
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    ratings = labels.select("doc_id", quality_model.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    out = quality_model.quality_model(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), ratings, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability",
                      "grade", "selected")


@query("op9_cross_parsing_language")
def op9_cross_parsing_language(spark, sf_dir):
    """Language of every whole text, learnt from the rows that aren't held out."""
    out = language_id.language_id(read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]))
    return out.select("doc_id", "held_out", "lang_pred", "score")


@query("op10_fertility_rules")
def op10_fertility_rules(spark, sf_dir):
    """Quality rules over every whole text."""
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), ["doc_id"])


# crc32 of an integer's decimal digits, bit by bit
CRC_SQL = """
xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || [ascii(d)::BIGINT FOR d IN string_split({x}::VARCHAR, '')],
    lambda c, d: list_reduce([xor(c, d)] || [0::BIGINT FOR j IN range(8)],
        lambda v, j: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)))"""


def _field_sql(col: str) -> str:
    return f"coalesce(octet_length(encode({col}::VARCHAR))::VARCHAR || ':' || {col}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op11_slot_pivot_manifest", sql=f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('v' || lang, 'n') AS k, {_leaf_sql("text")} AS h,
         CASE WHEN {CRC_SQL.format(x="doc_id")} % 3 = 0 THEN {_leaf_sql(LOWER_SQL)} END AS alt FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
                  count(*) OVER (PARTITION BY k) AS n FROM leaves),
tree(l, k, i, n, h) AS (
  SELECT 0, k, i, n, h FROM placed
  UNION ALL
  SELECT l + 1, k, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1
  GROUP BY l, k, i // 8, n),
subs AS (SELECT k, h, l AS depth, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top(l, i, n, h) AS (
  SELECT 0, i, n, h FROM subs
  UNION ALL
  SELECT l + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1
  GROUP BY l, i // 8, n),
sib AS (
  SELECT a.l, a.k, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lft,
         coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rgt
  FROM tree a JOIN tree b ON a.l = b.l AND a.k = b.k AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL),
top_sib AS (
  SELECT a.l, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lft,
         coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rgt
  FROM top a JOIN top b ON a.l = b.l AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL),
steps AS (
  SELECT p.doc_id, p.k, p.i, s.l, s.lft, s.rgt FROM placed p
  JOIN sib s ON s.k = p.k AND s.i = p.i // power(8, s.l)::BIGINT
  UNION ALL
  SELECT p.doc_id, p.k, p.i, u.depth + s.l, s.lft, s.rgt FROM placed p JOIN subs u USING (k)
  JOIN top_sib s ON s.i = u.i // power(8, s.l)::BIGINT),
path AS (SELECT k, i, list({{'a': lft, 'b': rgt}} ORDER BY l) AS p FROM steps GROUP BY k, i),
folded AS (
  SELECT t.doc_id, t.h AS leaf, u.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root,
         sha256(coalesce(array_to_string([x.a || x.b FOR x IN p], ''), '')) AS proof_sha256,
         list_reduce([{{'a': coalesce(t.alt, t.h), 'b': ''}}] || coalesce(p, []),
                     lambda acc, x: {{'a': sha256(x.a || acc.a || x.b), 'b': ''}}).a AS folded_root
  FROM placed t JOIN subs u ON u.k = t.k LEFT JOIN path q ON q.k = t.k AND q.i = t.i)
SELECT *, folded_root = root AS verified FROM folded""")
def op11_slot_pivot_manifest(spark, sf_dir):
    """Every document's place in the manifest, and what it says of changed texts."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "source", "lang", "n_chars", "text"])
    return merkle.manifest(docs, tampered=merkle.lowered_every_third)


@query("op12_euler_tour_trie", sql=f"""
WITH raw AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
             WHERE conv_id IS NOT NULL),
dig AS (SELECT c, turn, sha256(octet_length(encode(role))::VARCHAR || ':' || role || text) AS g,
               len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM raw),
o AS (SELECT c, g, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) - 1 AS i FROM dig),
ids AS (SELECT c, count(*) AS n FROM o GROUP BY c),
v AS (SELECT c, n, {CRC_SQL.format(x="c")} % 4 AS h, c - c % 20 AS base FROM ids),
turns AS (
  SELECT v.c, o.i AS pos, g, words FROM v JOIN o ON o.c = v.base AND o.i < v.h
  UNION ALL
  SELECT v.c, least(v.h, coalesce(b.n, 0)) + o.i - v.h, g, words FROM v JOIN o ON o.c = v.c AND o.i >= v.h
  LEFT JOIN ids b ON b.c = v.base),
m AS (
  SELECT c, pos + 1 AS d, words, sha256(string_agg(g, '') OVER (PARTITION BY c ORDER BY pos)) AS s FROM turns
  UNION ALL SELECT c, 0, 0, 'root' FROM v),
nodes AS (SELECT s, d, min(c) AS c, count(*) AS n, max(words) AS words FROM m GROUP BY s, d),
up AS (SELECT x.s, y.s AS ps FROM nodes x JOIN m y ON y.c = x.c AND y.d = x.d - 1),
kids AS (SELECT ps, count(*) AS k FROM up GROUP BY ps),
below AS (SELECT DISTINCT a.s, b.s AS u FROM m a JOIN m b ON a.c = b.c AND b.d >= a.d),
sums AS (
  SELECT below.s, count(*) FILTER (k IS NULL) AS n_leaves, sum((n - 1) * words) AS saved FROM below
  JOIN nodes ON nodes.s = below.u LEFT JOIN kids ON kids.ps = below.u GROUP BY below.s),
ends AS (SELECT s, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS e
         FROM (SELECT c, max_by(s, d) AS s FROM m GROUP BY c) GROUP BY s)
SELECT x.c AS conv_id, x.d::BIGINT AS depth, p.c AS parent_conv_id, x.n AS n_convs, coalesce(k, 0)::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM nodes x JOIN sums USING (s) LEFT JOIN up USING (s) LEFT JOIN nodes p ON p.s = up.ps LEFT JOIN kids ON kids.ps = x.s
LEFT JOIN ends ON ends.s = x.s""")
def op12_euler_tour_trie(spark, sf_dir):
    """The prefix trie of all rebuilt conversations."""
    turns = prefix_trie.thin_turns(read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))
    return prefix_trie.prefix_trie(*prefix_trie.shared_beginnings(turns))


@query("op13_least_squares_packing")
def op13_least_squares_packing(spark, sf_dir):
    """All documents in sequences of at most 4,096 ids."""
    return packing.pack(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
