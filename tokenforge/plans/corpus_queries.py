"""Documents -> tokens, samples, lengths and buckets.

Every query reads the whole ``documents`` table.  Token ids are code points;
``eos = pad = 0``.  Arrays are rendered as comma-joined text so that both
engines hash the same values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import buckets as B
from ..functions.core import filter_computed
from ..functions import tokens as T
from ..operators.corpus import bucket_histogram, corpus_samples, with_inclusive_bucket
from ..sources.tables import read_table
from .registry import query

ID_LEN = 64          # sample length for the id/label queries
LEN_MAX = 2048       # max_len of the length / bucket queries
STEP = 256
SEQ_MAX = 4096       # max_seq_length of the half-open / first-fit builders


def _docs(spark, sf_dir, *cols):
    return read_table(spark, sf_dir, "documents", list(cols) or ["doc_id", "text"])


def cp_sql(text: str, n: int | None = None) -> str:
    """DuckDB code points of ``text`` (optionally its first ``n`` characters)."""
    t = f"substr({text}, 1, {n})" if n else text
    return (f"(CASE WHEN {t} = '' THEN []::INTEGER[] ELSE "
            f"list_transform(string_split({t}, ''), lambda c: unicode(c)) END)")


def samples_sql(n: int) -> str:
    """CTEs ``samples(doc_id, ids, labels, real_len)`` = corpus_samples(n)."""
    return f"""
s0 AS (SELECT doc_id, {cp_sql('text', n)} AS cp FROM documents),
s1 AS (SELECT doc_id, list_slice(list_concat(cp, [0]), 1, {n}) AS a FROM s0),
s2 AS (SELECT doc_id, list_concat(a, list_transform(range({n} - len(a)), lambda x: 0)) AS ids FROM s1),
s3 AS (SELECT doc_id, ids,
         list_transform(range(1, {n} + 1), lambda i: CASE WHEN ids[i] = 0 THEN -100
                                                    WHEN i < {n} THEN ids[i + 1] ELSE 0 END) AS labels
       FROM s2),
samples AS (SELECT doc_id, ids, labels,
       {n} - coalesce(list_position(list_transform(list_reverse(ids), lambda x: x <> 0), true) - 1, {n})
         AS real_len FROM s3)"""


def _samples(spark, sf_dir, n):
    return corpus_samples(_docs(spark, sf_dir), n)


def whole_sql() -> str:
    """CTE ``whole(doc_id, cp, ids, labels)`` = :func:`_whole`: every document with eos,
    padded to a multiple of ``STEP``."""
    return f"""
w0 AS (SELECT doc_id, {cp_sql('text')} AS cp FROM documents),
w1 AS (SELECT doc_id, cp, list_concat(cp, list_transform(range((ceil((len(cp) + 1) / {STEP}) * {STEP})::BIGINT - len(cp)),
              lambda x: 0)) AS ids FROM w0),
whole AS (SELECT doc_id, cp, ids, list_transform(list_zip(ids, list_concat(list_slice(ids, 2, len(ids)), [0])),
              lambda z: CASE WHEN z[1] = 0 THEN -100 ELSE z[2] END) AS labels FROM w1)"""


def _whole(spark, sf_dir):
    """Whole documents as samples of their own length: eos appended, padded to a multiple
    of ``STEP``, labels shifted and masked."""
    d = _docs(spark, sf_dir).withColumn("cp", T.codepoints("text")).drop("text")
    hi = (F.ceil((F.size("cp") + 1) / F.lit(STEP)) * STEP).cast("int")
    d = d.withColumn("ids", T.pad_to(F.concat("cp", T.int_array([0])), hi, 0))
    return d.withColumn("labels", T.mask_where_input("ids", T.shift_left("ids", 0), 0))


# ---------------------------------------------------------------- flagship
@query("bucket_histogram", sql=f"""
WITH {samples_sql(LEN_MAX)},
b AS (SELECT real_len, len(list_filter(labels, lambda x: x <> -100)) AS n_label,
             1 + floor((real_len - 1) / {STEP})::BIGINT * {STEP} AS lo0 FROM samples),
c AS (SELECT *, CASE WHEN real_len >= 1 AND lo0 < {LEN_MAX}
                      AND real_len <= least(lo0 + {STEP - 1}, {LEN_MAX}) THEN 1 ELSE 0 END AS cov FROM b)
SELECT CASE WHEN cov = 1 THEN lo0 END AS bucket_lo,
       CASE WHEN cov = 1 THEN least(lo0 + {STEP - 1}, {LEN_MAX}) END AS bucket_hi,
       count(*) AS n_rows, sum(n_label)::BIGINT AS n_label_tokens
FROM c GROUP BY ALL""")
def q_bucket_histogram(spark, sf_dir):
    """documents -> code points (2048) -> eos + pad -> shift -> mask padding ->
    real length -> inclusive buckets (lo 1, step 256) -> rows and label tokens."""
    s = _samples(spark, sf_dir, LEN_MAX)
    s = with_inclusive_bucket(s, "real_len", 1, LEN_MAX, STEP)
    return bucket_histogram(s)


# ---------------------------------------------------------------- tokens
@query("tokenize_codepoints", sql=f"""
WITH t AS (SELECT doc_id, {cp_sql('text')} AS cp FROM documents)
SELECT doc_id, len(cp)::BIGINT AS n_tokens, list_sum(cp)::BIGINT AS cp_sum,
       array_to_string(list_slice(cp, 1, {ID_LEN}), ',') AS ids_head FROM t""")
def q_tokenize_codepoints(spark, sf_dir):
    """Whole-text code-point tokenization: count, id checksum, first 64 ids."""
    d = _docs(spark, sf_dir).withColumn("cp", T.codepoints("text"))
    return d.select("doc_id", F.size("cp").cast("long").alias("n_tokens"),
                    T.int_sum("cp").alias("cp_sum"),
                    T.join_ints(F.slice("cp", 1, ID_LEN)).alias("ids_head"))


@query("decode_roundtrip", sql=f"""
WITH t AS (SELECT doc_id, text, {cp_sql('text')} AS cp FROM documents),
d AS (SELECT doc_id, text, array_to_string(list_transform(cp, lambda i: chr(i)), '') AS back FROM t)
SELECT doc_id, back = text AS same, length(back)::BIGINT AS n_chars FROM d""")
def q_decode_roundtrip(spark, sf_dir):
    """Encode every text to ids and decode back (Y4); the round trip must be exact."""
    d = _docs(spark, sf_dir).withColumn("back", T.decode_codepoints(T.codepoints("text")))
    return d.select("doc_id", (F.col("back") == F.col("text")).alias("same"),
                    F.length("back").cast("long").alias("n_chars"))


@query("pad_truncate", sql=f"""
WITH t AS (SELECT doc_id, {cp_sql('text', ID_LEN)} AS cp FROM documents),
p AS (SELECT doc_id, list_concat(cp, list_transform(range({ID_LEN} - len(cp)), lambda x: 0)) AS ids,
             ({ID_LEN} - len(cp))::BIGINT AS n_pad FROM t)
SELECT doc_id, array_to_string(ids, ',') AS input_ids, n_pad FROM p""")
def q_pad_truncate(spark, sf_dir):
    """Head kept to 64 ids, right-padded with pad 0."""
    d = _docs(spark, sf_dir).withColumn("ids", T.pad_trunc(T.codepoints("text", ID_LEN), ID_LEN, 0))
    return d.select("doc_id", T.join_ints("ids").alias("input_ids"),
                    T.count_eq("ids", 0).cast("long").alias("n_pad"))


@query("shift_labels", sql=f"""
WITH t AS (SELECT doc_id, {cp_sql('text')} AS cp FROM documents)
SELECT doc_id, len(cp)::BIGINT AS n, md5(array_to_string(CASE WHEN len(cp) = 0 THEN [] ELSE
       list_concat(list_slice(cp, 2, len(cp)), [0]) END, ',')) AS labels_md5 FROM t""")
def q_shift_labels(spark, sf_dir):
    """``labels[i] = ids[i+1]``, last = eos (W1), over whole documents."""
    d = _docs(spark, sf_dir).withColumn("ids", T.codepoints("text"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n"),
                    T.digest_ints(T.shift_left("ids", 0)).alias("labels_md5"))


@query("xy_pairs", sql=f"""
WITH t AS (SELECT doc_id, {cp_sql('text')} AS dix FROM documents)
SELECT doc_id, greatest(len(dix) - 1, 0)::BIGINT AS n, md5(array_to_string(list_slice(dix, 1, len(dix) - 1), ',')) AS x_md5,
       md5(array_to_string(list_slice(dix, 2, len(dix)), ',')) AS y_md5 FROM t""")
def q_xy_pairs(spark, sf_dir):
    """``x = dix[:-1]``, ``y = dix[1:]`` over whole documents."""
    d = _docs(spark, sf_dir).withColumn("dix", T.codepoints("text"))
    x, y = T.xy_split("dix")
    return d.select("doc_id", F.size(x).cast("long").alias("n"), T.digest_ints(x).alias("x_md5"),
                    T.digest_ints(y).alias("y_md5"))


@query("mask_padding", sql=f"""
WITH {whole_sql()}
SELECT doc_id, len(ids)::BIGINT AS n, md5(array_to_string(ids, ',')) AS input_ids_md5,
       md5(array_to_string(labels, ',')) AS labels_md5, len(list_filter(labels, lambda x: x = -100))::BIGINT AS n_masked FROM whole""")
def q_mask_padding(spark, sf_dir):
    """Labels -100 where the input is eos, inputs eos -> pad (Y7), over whole documents."""
    s = _docs(spark, sf_dir).select("doc_id", T.masked_sample("text", STEP, eos=0, pad=0).alias("s"))
    return s.select("doc_id", "s.*")


@query("attention_mask", sql=f"""
WITH {whole_sql()},
m AS (SELECT doc_id, list_transform(ids, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END) AS mask FROM whole)
SELECT doc_id, md5(array_to_string(mask, ',')) AS mask_md5, list_sum(mask)::BIGINT AS n_attend FROM m""")
def q_attention_mask(spark, sf_dir):
    """``input_ids != pad`` (Y13), over whole documents."""
    s = _whole(spark, sf_dir).withColumn("mask", T.not_equal_mask("ids", 0))
    return s.select("doc_id", T.digest_ints("mask").alias("mask_md5"), T.int_sum("mask").alias("n_attend"))


@query("prefix_mask", sql=f"""
WITH {whole_sql()}
SELECT doc_id, len(cp)::BIGINT AS min_len, len(ids)::BIGINT AS n, md5(repeat('1,', len(cp)) || repeat('0,', len(ids) - len(cp))) AS mask_md5
FROM whole""")
def q_prefix_mask(spark, sf_dir):
    """Loss mask ``mask[:min_len] = 1`` over the positions of each padded document, with
    ``min_len`` the document's tokens (Y21)."""
    d = _whole(spark, sf_dir).withColumn("mask", T.prefix_mask(F.size("ids"), F.size("cp")))
    return d.select("doc_id", F.size("cp").cast("long").alias("min_len"), F.size("mask").cast("long").alias("n"),
                    F.md5(F.concat(T.join_ints("mask"), F.lit(",")).cast("binary")).alias("mask_md5"))


@query("pad_to_bucket", sql=f"""
WITH t AS (SELECT doc_id, {cp_sql('text', SEQ_MAX)} AS cp FROM documents),
b AS (SELECT doc_id, cp, (ceil(len(cp) / {STEP}) * {STEP})::BIGINT AS hi FROM t WHERE len(cp) > 0),
p AS (SELECT doc_id, hi, list_concat(cp, list_transform(range(hi - len(cp)), lambda x: 0)) AS ids FROM b)
SELECT doc_id, hi - {STEP} AS bucket_lo, hi AS bucket_hi, len(ids)::BIGINT AS padded_len,
       len(list_filter(ids, lambda x: x = 0))::BIGINT AS n_pad,
       array_to_string(list_slice(ids, hi - 3, hi), ',') AS tail FROM p""")
def q_pad_to_bucket(spark, sf_dir):
    """Pad each sample to its half-open bucket's upper bound."""
    d = _docs(spark, sf_dir).withColumn("cp", T.codepoints("text", SEQ_MAX))
    lo, hi = B.bucket_half_open(F.size("cp"), STEP, SEQ_MAX)
    d = filter_computed(d.withColumn("bucket_lo", lo).withColumn("bucket_hi", hi), F.col("bucket_hi").isNotNull())
    d = d.withColumn("ids", T.pad_to("cp", F.col("bucket_hi").cast("int"), 0))
    return d.select("doc_id", "bucket_lo", "bucket_hi",
                    F.size("ids").cast("long").alias("padded_len"),
                    T.count_eq("ids", 0).cast("long").alias("n_pad"),
                    T.join_ints(F.slice("ids", F.col("bucket_hi").cast("int") - 3, 4)).alias("tail"))


@query("collate_ids_as_labels", sql=f"""
WITH {whole_sql()}
SELECT doc_id, least(len(ids), {LEN_MAX})::BIGINT AS n, md5(array_to_string(list_slice(ids, 1, {LEN_MAX}), ',')) AS input_ids_md5,
       md5(array_to_string(list_slice(labels, 1, {LEN_MAX}), ',')) AS stored_md5,
       md5(array_to_string(list_slice(ids, 1, {LEN_MAX}), ',')) AS from_ids_md5 FROM whole""")
def q_collate_ids_as_labels(spark, sf_dir):
    """Collator for stored samples: both cut to 2048, with the stored labels and with the
    ids as labels (Y18, Q4)."""
    s = _whole(spark, sf_dir)
    ids, stored = T.collate("ids", "labels", LEN_MAX)
    _, from_ids = T.collate("ids", "labels", LEN_MAX, labels_from_ids=True)
    return s.select("doc_id", F.size(ids).cast("long").alias("n"), T.digest_ints(ids).alias("input_ids_md5"),
                    T.digest_ints(stored).alias("stored_md5"), T.digest_ints(from_ids).alias("from_ids_md5"))


@query("token_slice", sql=f"""
WITH t AS (SELECT doc_id, {cp_sql('text', 19)} AS cp FROM documents)
SELECT doc_id, array_to_string(list_slice(cp, 4, 19), ',') AS got,
       array_to_string(list_slice(cp, 1, 16), ',') AS only FROM t""")
def q_token_slice(spark, sf_dir):
    """``get(idx, offset=3, length=16)`` and ``only(idx, 16)`` per item."""
    d = _docs(spark, sf_dir).withColumn("cp", T.codepoints("text", 19))
    return d.select("doc_id", T.join_ints(T.slice_window("cp", 3, 16)).alias("got"),
                    T.join_ints(T.head_cut("cp", 16)).alias("only"))


# ---------------------------------------------------------------- lengths
@query("real_length", sql=f"""
WITH {samples_sql(LEN_MAX)}
SELECT doc_id, real_len::INTEGER AS real_len FROM samples""")
def q_real_length(spark, sf_dir):
    """Size minus the trailing eos run of each 2048-id sample."""
    return _samples(spark, sf_dir, LEN_MAX).select("doc_id", "real_len")


@query("length_filter", sql=f"""
WITH {samples_sql(LEN_MAX)}
SELECT doc_id, real_len::INTEGER AS real_len FROM samples WHERE real_len BETWEEN 257 AND 512""")
def q_length_filter(spark, sf_dir):
    """Keep samples with ``257 <= real_len <= 512``."""
    s = _samples(spark, sf_dir, LEN_MAX).select("doc_id", "real_len")
    return filter_computed(s, B.in_range("real_len", 257, 512))


@query("length_dry_run", sql=f"""
WITH {samples_sql(LEN_MAX)}
SELECT count(*) FILTER (WHERE real_len BETWEEN 257 AND 512) AS n_valid, count(*) AS n_total FROM samples""")
def q_length_dry_run(spark, sf_dir):
    """Dry run: count of rows in the range, no output written (A1)."""
    s = _samples(spark, sf_dir, LEN_MAX)
    return s.agg(F.count_if(B.in_range("real_len", 257, 512)).alias("n_valid"),
                 F.count(F.lit(1)).alias("n_total"))


@query("bucket_inclusive", sql=f"""
WITH {samples_sql(LEN_MAX)},
b AS (SELECT doc_id, real_len, 1 + floor((real_len - 1) / {STEP})::BIGINT * {STEP} AS lo0 FROM samples),
c AS (SELECT *, real_len >= 1 AND lo0 < {LEN_MAX} AND real_len <= least(lo0 + {STEP - 1}, {LEN_MAX}) AS cov FROM b)
SELECT doc_id, real_len::INTEGER AS real_len, CASE WHEN cov THEN lo0 END AS bucket_lo,
       CASE WHEN cov THEN least(lo0 + {STEP - 1}, {LEN_MAX}) END AS bucket_hi FROM c""")
def q_bucket_inclusive(spark, sf_dir):
    """Inclusive ranges ``[i, min(i+255, 2048)]`` from 1."""
    s = with_inclusive_bucket(_samples(spark, sf_dir, LEN_MAX), "real_len", 1, LEN_MAX, STEP)
    return s.select("doc_id", "real_len", "bucket_lo", "bucket_hi")


@query("bucket_half_open", sql=f"""
WITH t AS (SELECT doc_id, length(text)::BIGINT AS n FROM documents),
b AS (SELECT doc_id, n, (ceil(n / {STEP}) * {STEP})::BIGINT AS hi, n > 0 AND n <= {SEQ_MAX} AS ok FROM t)
SELECT doc_id, n AS n_tokens, CASE WHEN ok THEN hi - {STEP} END AS bucket_lo,
       CASE WHEN ok THEN hi END AS bucket_hi FROM b""")
def q_bucket_half_open(spark, sf_dir):
    """Half-open ranges ``(i, i+256]`` up to 4096 by the whole text's size; longer rows
    are in none (Y15, P4).  A code-point token is a character, so nothing is split."""
    d = _docs(spark, sf_dir).withColumn("n_tokens", F.char_length("text").cast("long"))
    lo, hi = B.bucket_half_open(F.col("n_tokens"), STEP, SEQ_MAX)
    return d.select("doc_id", "n_tokens", lo.alias("bucket_lo"), hi.alias("bucket_hi"))


@query("bucket_first_fit", sql=f"""
WITH t AS (SELECT doc_id, length(text)::BIGINT AS n FROM documents),
b AS (SELECT doc_id, n, greatest(ceil(n / {STEP}) * {STEP}, {STEP})::BIGINT AS ub FROM t)
SELECT doc_id, n AS n_tokens,
       CASE WHEN ub <= {((SEQ_MAX - 1) // STEP) * STEP} THEN ub ELSE {SEQ_MAX} END AS bucket_hi FROM b""")
def q_bucket_first_fit(spark, sf_dir):
    """First bound ``>= length`` in 256..3840 by the whole text's size; longer rows to
    overflow 4096 (Y16, Q6)."""
    d = _docs(spark, sf_dir).withColumn("n_tokens", F.char_length("text").cast("long"))
    return d.select("doc_id", "n_tokens",
                    B.bucket_first_fit(F.col("n_tokens"), STEP, SEQ_MAX).alias("bucket_hi"))


@query("dq_lengths", sql=f"""
WITH {samples_sql(LEN_MAX)}
SELECT count(*) AS n_rows,
       count(*) FILTER (WHERE len(ids) <> len(labels)) AS n_size_mismatch,
       count(*) FILTER (WHERE len(ids) <> {LEN_MAX}) AS n_not_max_len FROM samples""")
def q_dq_lengths(spark, sf_dir):
    """Data-quality aggregate replacing the builder's length asserts."""
    s = _samples(spark, sf_dir, LEN_MAX)
    return s.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(F.size("input_ids") != F.size("labels")).alias("n_size_mismatch"),
                 F.count_if(F.size("input_ids") != LEN_MAX).alias("n_not_max_len"))
