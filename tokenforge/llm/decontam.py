"""Benchmark decontamination by winnowing, with DataFrame functions only.

Both sides are hashed in k-grams of words, and the least hash of every window of
consecutive k-grams is kept as a fingerprint.  With k + w - 1 equal to the length
of a benchmark window, every shared window shares a fingerprint.  Fingerprints of
the documents are joined with those of the benchmark; around the hits the windows
are compared word by word, so the result is exact.

The benchmark's fingerprints and windows are broadcast only if their measured
size is small; beyond that the joins shuffle thin rows.  Only hit k-grams are
gathered per document, never whole groups.

Defined results: a null or wordless text has no words, no hits and is clean; an
item of fewer words than a window, but not none, is one window of its own length;
benchmark rows without an id make hits but are not listed as items; equal rows
give equal results; other columns are neither read nor needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import let
from .common import bounded, lower_ascii, maybe_broadcast

WINDOW, K = 13, 5
# What separates words, after A-Z became a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text in order; none if it is null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def k_grams(hashes: Column, k: int) -> Column:
    """Hashes of the k-grams of an array of word hashes."""
    return F.when(F.size(hashes) >= k, F.slice(
        F.transform(hashes, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, k)])),
        1, F.size(hashes) - (k - 1))).otherwise(F.array().cast("array<long>"))


def window_minima(grams: Column, w: int) -> Column:
    """The least value of every w consecutive ones, by doubling steps."""
    def step(done: int, values: Column) -> Column:
        if done == w:
            return F.array_distinct(values)
        grow = min(done, w - done)
        return let(F.transform(values, lambda x, i: F.least(x, F.get(values, i + grow))),
                   lambda v: step(done + grow, v))
    full = F.greatest(F.size(grams) - (w - 1), F.lit(0))
    if w == 1:
        return F.array_distinct(grams)
    # minima that reach past the end cover fewer k-grams: harmless extra fingerprints
    return F.when(full > 0, step(1, grams)).otherwise(F.array().cast("array<long>"))


def fingerprints(words: Column, lengths: list[int], k: int = K) -> Column:
    """Fingerprints for shared spans of each of the lengths."""
    def of(h: Column, length: int) -> Column:
        n = min(k, length)
        return let(k_grams(h, n), lambda g: window_minima(g, length - n + 1))
    return let(F.transform(words, lambda x: F.xxhash64(x)),
               lambda h: F.array_distinct(F.flatten(F.array(*[of(h, n) for n in lengths]))))


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """Distinct (length, window text, item) of a benchmark."""
    words = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), words_of(F.col(f"`{text}`")).alias("words")) \
        .where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - n + 1)
    return words.select("item_id", "words", n.alias("n"), F.explode(starts).alias("at")) \
        .select("item_id", "n", F.array_join(F.expr("slice(words, at, n)"), " ").alias("window")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, text_hash, start, length, item_id) of every occurrence of a
    benchmark window in a document; starts count words from 0."""
    windows, small = bounded(benchmark_windows(benchmark, window=window))
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())      # at most ``window`` values
    key = [F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash")]
    if not lengths:
        return docs.select(*key, F.lit(0).alias("start"), F.lit(0).alias("length"),
                           F.lit(0).cast("long").alias("item_id")).limit(0)
    marks, marks_small = bounded(windows.select(F.explode(
        fingerprints(F.split("window", " "), lengths, k)).alias("mark")).distinct())
    hits = docs.select(*key, F.explode(fingerprints(words_of(F.col(f"`{text}`")), lengths, k)).alias("mark")) \
        .join(maybe_broadcast(marks, marks_small), "mark") \
        .groupBy("doc_id", "text_hash").agg(F.collect_set("mark").alias("marks"))
    hits, hits_small = bounded(hits)
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "marks")
    words = docs.select(*key, words_of(F.col(f"`{text}`")).alias("words"))
    found = words.join(maybe_broadcast(hits, hits_small),
                       F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))

    def starts(n: int) -> Column:
        """Starts of windows of n words that hold a hit k-gram."""
        g = min(k, n)
        hit = let(F.transform("words", lambda x: F.xxhash64(x)), lambda h: let(k_grams(h, g), lambda grams: F.filter(
            F.transform(grams, lambda x, i: F.when(F.array_contains("marks", x), i)), lambda i: i.isNotNull())))
        near = F.transform(hit, lambda i: F.sequence(F.greatest(i - (n - g), F.lit(0)), i))
        return F.filter(F.array_distinct(F.flatten(near)), lambda s: s + n <= F.size("words"))

    def texts(n: int) -> Column:
        return F.transform(starts(n), lambda s: F.struct(
            s.cast("int").alias("start"), F.lit(n).alias("length"),
            F.array_join(F.slice("words", s + 1, n), " ").alias("window")))

    spans = found.select("doc_id", "text_hash", F.explode(F.flatten(F.array(*[texts(n) for n in lengths]))).alias("s"))
    return spans.select("doc_id", "text_hash", "s.*") \
        .join(maybe_broadcast(windows.select("window", F.col("n").alias("length"), "item_id"), small),
              ["window", "length"]) \
        .select("doc_id", "text_hash", "start", "length", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  window: int = WINDOW, k: int = K, share: int = 20) -> DataFrame:
    """Words, hit words and items of every row of ``docs``; contaminated: hit, and
    ``share`` times the hit words are at least the words."""
    spans = contamination(docs, benchmark, doc_id, text, window, k)
    key = ["doc_id", "text_hash"]
    ends = spans.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    seen = F.max("end").over(Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    covered = ends.withColumn("new", F.greatest(
        F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(seen, F.lit(0))))) \
        .groupBy(*key).agg(F.sum("new").cast("long").alias("n_hit"))
    items = spans.groupBy(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")) \
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    result = covered.join(items, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_h"))) \
        .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_hit", "items")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"),
                       F.size(words_of(F.col(f"`{text}`"))).cast("long").alias("n_words"))
    out = rows.join(result, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      items.alias("items")) \
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their own columns."""
    bad = decontaminate(docs, benchmark, doc_id, text, **kw).where("contaminated") \
        .select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    bad, small = bounded(bad)
    return docs.join(maybe_broadcast(bad, small), F.col(f"`{doc_id}`").eqNullSafe(F.col("_bad_id"))
                     & (F.xxhash64(F.col(f"`{text}`")) == F.col("_bad_hash")), "left_anti")
