"""Corpus -> fixed-length training samples (Training.md pipeline, one job).

``tokenize -> truncate -> append eos -> pad -> shift -> mask padding`` are all
array expressions on the row, so the whole build is a narrow map: no shuffle
until the caller groups or writes by bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import buckets as B
from ..functions import tokens as T


def corpus_samples(df: DataFrame, max_len: int, eos: int = 0, pad: int = 0,
                   text_col: str = "text", tokenizer=None) -> DataFrame:
    """Add ``input_ids``, ``labels`` (next-token, -100 on padding), ``real_len``.

    ``tokenizer`` maps a text Column to an ``ARRAY<INT>`` Column; the default is
    the code-point tokenizer, cut to ``max_len`` before splitting.
    """
    tok = tokenizer or (lambda c: T.codepoints(c, max_len))
    ids = T.pad_trunc(F.concat(tok(F.col(text_col)), T.int_array([eos])), max_len, pad)
    labels = T.shift_left(F.col("input_ids"), eos)
    out = (df.withColumn("input_ids", ids)
           .withColumn("labels", T.mask_where_input("input_ids", labels, eos)))
    if eos != pad:   # inputs eos -> pad; an identity when they share an id (Q17)
        out = out.withColumn("input_ids", T.replace_value("input_ids", eos, pad))
    return out.withColumn("real_len", T.real_len("input_ids", pad))


def with_inclusive_bucket(df: DataFrame, length: str, lo: int, hi: int, step: int) -> DataFrame:
    b_lo, b_hi = B.bucket_inclusive(F.col(length), lo, hi, step)
    return df.withColumn("bucket_lo", b_lo).withColumn("bucket_hi", b_hi)


def bucket_histogram(samples: DataFrame) -> DataFrame:
    """Rows and label tokens per bucket (A2); partial aggregation map-side."""
    return (samples.groupBy("bucket_lo", "bucket_hi")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(T.count_not("labels", T.IGNORE)).cast("long").alias("n_label_tokens")))


def write_buckets(samples: DataFrame, path: str, bucket_col: str = "bucket_hi",
                  mode: str = "overwrite") -> None:
    """One pass, one directory per bucket (S19) instead of one scan per bucket.
    Rows are spread over 64 writers per bucket by a hash of their content, so
    a large bucket is not written by one task and retries write the same files."""
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in samples.columns if c != bucket_col]), F.lit(64))
    samples.repartition(bucket_col, spread).write.mode(mode).partitionBy(bucket_col).parquet(path)
