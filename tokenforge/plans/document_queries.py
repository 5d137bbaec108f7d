"""Documents: corpus scans, vocabularies, text clean-up and quarantine
(SURVEY 7.7 rows 1, 4 and 8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ensure_suffix, refine_context, strip_ws
from ..operators import vocab as V
from ..operators.ordered import _join_small, keyed_index
from ..session import scratch_path
from ..sources import corpus as IO
from ..sources.tables import read_table
from .infer_queries import PYWS
from .registry import query

UNKNOWN_CHAR = "\ue083"  # fixed value: the char-table tokenizer's unknown character


@query("scan_text_parquet", sql="""
WITH k AS (SELECT text, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS k FROM documents)
SELECT text FROM k WHERE k % 3 <> 2""")
def q_scan_text_parquet(spark, sf_dir):
    """Parquet corpus scan of a directory and one sub-level only, keeping only
    ``text`` (S1, S8, P1, quirk Q1): all documents are laid out at depths 0, 1
    and 2, the sources that occur (null included) in turn; the depth-2 files must not
    be read."""
    d = read_table(spark, sf_dir, "documents", ["source", "text"])
    place = keyed_index(d.select("source").distinct(), [], ["source"], name="k")
    d = _join_small(d, place, ["source"]).withColumn("depth", F.col("k") % 3).drop("k")
    root = scratch_path(spark, "corpus")
    for depth, sub in enumerate(("", "/sub", "/sub/deeper")):
        d.where(F.col("depth") == depth).drop("depth").write.mode("overwrite").parquet(root + sub)
    return IO.read_corpus(spark, root, fmt="parquet", depth=1).select("text")


@query("scan_lang_split", sql="""
SELECT doc_id, text FROM documents WHERE lang = 'fr' AND substr(md5(doc_id::VARCHAR), 1, 1) IN ('0', '1')""")
def q_scan_lang_split(spark, sf_dir):
    """Named config + split load (S6): documents written once as
    ``lang=../split=..`` partitions, then one (config, split) read back with
    partition pruning."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    split = F.when(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin("0", "1"),
                   "validation").otherwise("train")
    root = scratch_path(spark, "langsplit")
    IO.write_lang_split(d.withColumn("split", split), root)
    return IO.read_lang_split(spark, root, "fr", "validation").select("doc_id", "text")


VOCAB_SQL = """
ch AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''),
vocab AS (SELECT ch, unicode(ch)::BIGINT AS cp, (row_number() OVER (ORDER BY unicode(ch)) - 1)::BIGINT AS id FROM ch)"""


@query("char_vocab", sql=f"WITH {VOCAB_SQL} SELECT ch, cp, id FROM vocab")
def q_char_vocab(spark, sf_dir):
    """Sorted distinct characters of the corpus with dense ids."""
    d = read_table(spark, sf_dir, "documents", ["text"])
    return V.char_vocab(d).select("ch", "cp", "id")


ENC_SQL = f"""
WITH {VOCAB_SQL},
c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS pos FROM documents),
e AS (SELECT c.doc_id, c.pos, v.id FROM c JOIN vocab v USING (ch))
SELECT doc_id, array_to_string(list(id ORDER BY pos) FILTER (WHERE pos < 64), ',') AS ids_head,
       sum(id)::BIGINT AS id_sum FROM e GROUP BY doc_id"""


@query("char_encode", sql=ENC_SQL)
def q_char_encode(spark, sf_dir):
    """Whole texts encoded to dense vocabulary ids (J3, Y2): first 64 ids and
    the id sum over the whole text."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    lut = V.codepoint_lut(V.char_vocab(d))
    e = d.select("doc_id", V.encode_with_lut(F.col("text"), lut).alias("ids"))
    return e.select("doc_id", F.array_join(F.transform(F.slice("ids", 1, 64), lambda x: x.cast("string")), ",")
                    .alias("ids_head"),
                    F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@query("char_encode_unk", sql=f"""
WITH ch AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents WHERE lang = 'en' AND text <> ''
            UNION SELECT chr(57475)),
vocab AS (SELECT ch, (row_number() OVER (ORDER BY unicode(ch)) - 1)::BIGINT AS id FROM ch),
unk AS (SELECT id AS unk_id FROM vocab WHERE ch = chr(57475)),
c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS pos FROM documents),
e AS (SELECT c.doc_id, c.pos, coalesce(v.id, unk.unk_id) AS id, v.id IS NULL AS is_unk
      FROM c LEFT JOIN vocab v USING (ch) CROSS JOIN unk)
SELECT doc_id, array_to_string(list(id ORDER BY pos) FILTER (WHERE pos < 64), ',') AS ids_head,
       count(*) FILTER (WHERE is_unk) AS n_unk FROM e GROUP BY doc_id""")
def q_char_encode_unk(spark, sf_dir):
    """Char-table tokenizer built on the English documents, applied to every
    document; characters outside it map to the unknown character's id (Y3)."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    vocab = V.char_vocab(d.where(F.col("lang") == "en"), extra=[UNKNOWN_CHAR])
    unk = vocab.where(F.col("ch") == UNKNOWN_CHAR).first()["id"]
    lut = V.codepoint_lut(vocab)
    e = d.select("doc_id", V.encode_with_lut(F.col("text"), lut).alias("raw"))
    e = e.select("doc_id", F.transform("raw", lambda x: F.coalesce(x, F.lit(unk).cast("long"))).alias("ids"),
                 F.size(F.filter("raw", lambda x: x.isNull())).cast("long").alias("n_unk"))
    return e.select("doc_id", F.array_join(F.transform(F.slice("ids", 1, 64), lambda x: x.cast("string")), ",")
                    .alias("ids_head"), "n_unk")


@query("vocab_maps", sql=f"""
WITH {VOCAB_SQL},
c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS pos FROM documents WHERE text <> ''),
e AS (SELECT c.doc_id, sum(v.id * (c.pos + 1))::BIGINT AS checksum FROM c JOIN vocab v USING (ch) GROUP BY c.doc_id)
SELECT doc_id, md5(text) AS text_md5, coalesce(checksum, 0)::BIGINT AS checksum FROM documents LEFT JOIN e USING (doc_id)""")
def q_vocab_maps(spark, sf_dir):
    """id <-> char maps of the corpus vocabulary: every whole document is encoded with the
    one and decoded with the other (R10, Y4); digest of what comes back and a checksum of
    the ids."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    vocab = V.char_vocab(d)
    ids = V.encode_with_lut(F.col("text"), V.codepoint_lut(vocab))
    e = d.select("doc_id", ids.alias("ids"))
    weighted = F.transform("ids", lambda x, i: x * (i + 1))
    return e.select("doc_id", F.md5(V.decode_with_array(F.col("ids"), V.id_array(vocab)).cast("binary")).alias("text_md5"),
                    F.aggregate(weighted, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


@query("refine_context", sql=f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '^{PYWS}+|{PYWS}+$', '', 'g'),
                      chr(10)), lambda x: regexp_replace(x, '^{PYWS}+|{PYWS}+$', '', 'g')), lambda x: x <> '') AS ls
           FROM documents)
SELECT doc_id, chr(10) || regexp_replace(array_to_string(ls, chr(10)), '^{PYWS}+|{PYWS}+$', '', 'g') AS text FROM l""")
def q_refine_context(spark, sf_dir):
    """Context clean-up: strip lines, drop blank ones, newline prefix."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select("doc_id", refine_context(F.col("text")).alias("text"))


@query("ensure_suffix", sql="""
SELECT doc_id, CASE WHEN suffix(text, chr(10) || chr(10)) THEN text ELSE text || chr(10) || chr(10) END AS text
FROM documents""")
def q_ensure_suffix(spark, sf_dir):
    """Every text ends with a blank line."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select("doc_id", ensure_suffix(F.col("text")).alias("text"))


@query("output_names", sql="""
WITH f AS (SELECT DISTINCT source, '/data/in/' || source || '.jsonl' AS path FROM documents)
SELECT source, path, '/data/out/' || source || '_pseudo_labels_0.0_1.0.jsonl' AS out_jsonl,
       '/data/parquet/' || source || '.parquet' AS out_parquet FROM f""")
def q_output_names(spark, sf_dir):
    """Output file names from input names: stem minus ``.jsonl`` +
    ``_pseudo_labels_{from}_{to}.jsonl``, and the parquet extension swap (C16)."""
    d = read_table(spark, sf_dir, "documents", ["source"]).distinct()
    path = F.concat(F.lit("/data/in/"), F.col("source"), F.lit(".jsonl"))
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"\.jsonl$", "")
    return d.select("source", path.alias("path"),
                    F.concat(F.lit("/data/out/"), stem, F.lit("_pseudo_labels_0.0_1.0.jsonl")).alias("out_jsonl"),
                    F.concat(F.lit("/data/parquet/"), F.regexp_replace(base, r"\.jsonl$", ".parquet")).alias("out_parquet"))


BAD_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffd}]"


@query("quarantine_split", sql=f"""
SELECT doc_id,
       CASE WHEN regexp_replace(text, '^{PYWS}+|{PYWS}+$', '', 'g') = '' THEN 'empty'
            WHEN regexp_matches(text, '{BAD_CHARS}') THEN 'control_or_replacement_char'
            WHEN n_chars <> length(text) THEN 'length_mismatch' END AS reason,
       CASE WHEN regexp_replace(text, '^{PYWS}+|{PYWS}+$', '', 'g') = '' OR regexp_matches(text, '{BAD_CHARS}')
                 OR n_chars <> length(text) THEN 'quarantine' ELSE 'ok' END AS status
FROM documents""")
def q_quarantine_split(spark, sf_dir):
    """Per-record validation that never fails a task: each document goes to
    ``ok`` or ``quarantine`` with a reason (P12, Q19)."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "n_chars"])
    reason = (F.when(strip_ws(F.col("text")) == "", "empty")
              .when(F.col("text").rlike(BAD_CHARS), "control_or_replacement_char")
              .when(F.col("n_chars") != F.length("text"), "length_mismatch"))
    return d.select("doc_id", reason.alias("reason"),
                    F.when(reason.isNull(), "ok").otherwise("quarantine").alias("status"))
