"""Character vocabularies and dense-id encoding.

The distinct characters of a corpus are found with per-document
``array_distinct`` first (so the shuffle carries at most one row per distinct
character per document) and a partial-aggregated ``distinct``.  A vocabulary
is bounded by the number of Unicode code points (1,114,112), so it is a small
table; ids are ranks in code-point order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import let
from ..session import small_table

MAP_LIMIT = 200_000   # vocabularies up to this size become an in-expression map


def _chars(text: Column) -> Column:
    """Characters of a text; the empty text has none (``split`` would give [''])."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def char_vocab(df: DataFrame, text: str = "text", extra: list[str] | None = None) -> DataFrame:
    """``(ch, cp, id)``: distinct characters, id = 0-based rank by code point.

    ``extra`` characters (e.g. an unknown-character token) are added first.
    """
    chars = df.select(F.explode(F.array_distinct(_chars(F.col(text)))).alias("ch")).distinct()
    if extra:
        spark = df.sparkSession
        chars = chars.unionByName(spark.createDataFrame([(c,) for c in extra], "ch string")).distinct()
    v, _ = small_table(chars.withColumn("cp", F.ascii("ch").cast("long")), 1_114_112)
    # one row per distinct code point: the ranking window runs on a bounded table
    return v.withColumn("id", (F.row_number().over(Window.orderBy("cp")) - 1).cast("long"))


def vocab_maps(vocab: DataFrame) -> tuple[Column, Column]:
    """``(stoi, itos)`` literal maps of a bounded vocabulary.

    The vocabulary is read on the driver only after its size is checked; use
    :func:`encode_join` for vocabularies above ``MAP_LIMIT``.
    """
    n = vocab.count()
    if n > MAP_LIMIT:
        raise ValueError(f"vocabulary of {n} entries is too large for a literal map")
    rows = vocab.select("ch", "id").orderBy("id").collect()
    chars = [r["ch"] for r in rows]
    ids = [int(r["id"]) for r in rows]
    k = F.array(*[F.lit(c) for c in chars]) if chars else F.array().cast("array<string>")
    i = F.array(*[F.lit(x).cast("long") for x in ids]) if ids else F.array().cast("array<long>")
    return F.map_from_arrays(k, i), F.map_from_arrays(i, k)


LUT_LIMIT = 1_114_112


def codepoint_lut(vocab: DataFrame) -> Column:
    """Dense lookup array ``lut[cp] = id`` (-1 where absent) of a bounded
    vocabulary, as one literal: O(1) per character instead of a map probe
    (Spark map lookups scan the keys).  Built from one JSON string, so the
    plan holds a single constant."""
    import json
    rows = vocab.select("cp", "id").collect()          # bounded: one row per code point
    top = max((int(r["cp"]) for r in rows), default=-1)
    if top >= LUT_LIMIT:
        raise ValueError("code point out of range")
    lut: list[int | None] = [None] * (top + 1)
    for r in rows:
        lut[int(r["cp"])] = int(r["id"])
    return F.from_json(F.lit(json.dumps(lut)), "array<long>")


def encode_with_lut(text: Column, lut: Column, unk_id: int | None = None) -> Column:
    """Characters -> dense ids through :func:`codepoint_lut` (Y2, Y3);
    characters outside the vocabulary get ``unk_id`` (or null)."""
    def look(t):
        hit = lambda c: F.try_element_at(t, F.ascii(c) + 1)
        if unk_id is None:
            return F.transform(_chars(text), hit)
        return F.transform(_chars(text), lambda c: F.coalesce(hit(c), F.lit(unk_id).cast("long")))
    return let(lut, look)


def encode_with_map(text: Column, stoi: Column, unk_id: int | None = None) -> Column:
    """Characters -> dense ids through a literal map (Y2); unknown characters
    get ``unk_id`` (Y3) or null."""
    return let(stoi, lambda m: F.transform(_chars(text), lambda c: F.coalesce(
        F.try_element_at(m, c), F.lit(unk_id).cast("long") if unk_id is not None else F.lit(None).cast("long"))))


def decode_with_map(ids: Column, itos: Column) -> Column:
    """Dense ids -> text."""
    return let(itos, lambda m: F.array_join(F.transform(ids, lambda i: F.try_element_at(m, i)), ""))


def encode_join(df: DataFrame, key: str, text: str, vocab: DataFrame, unk_id: int | None = None,
                out: str = "ids") -> DataFrame:
    """Encode through a join with the vocabulary table (J3) for any
    vocabulary size: characters with positions are joined to the vocabulary
    (broadcast when its size is bounded, else shuffled) and put back in order."""
    v, ok = small_table(vocab.select("ch", "id"), 2_000_000)
    pos = df.select(key, F.posexplode(_chars(F.col(text))).alias("pos", "ch"))
    j = pos.join(F.broadcast(v) if ok else v, "ch", "left")
    if unk_id is not None:
        j = j.withColumn("id", F.coalesce("id", F.lit(unk_id).cast("long")))
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_p"))
    return g.select(key, F.transform("_p", lambda x: x["id"]).alias(out))


def vocab_json(vocab: DataFrame) -> Column:
    """``{"id": "char", ..}`` text of the vocabulary (S22), one row."""
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("id").cast("string"), "ch")))))


def write_vocab_json(vocab: DataFrame, path: str) -> None:
    """The vocabulary as one JSON object ``{"id": "char", ..}`` in id order, an entry a
    line (S22).  At most one entry per code point, so the one part file is bounded; no row
    holds the vocabulary."""
    entry = F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('": '), F.expr("substring(to_json(array(ch)), 2, "
                     "char_length(to_json(array(ch))) - 2)"))
    last = vocab.agg(F.max("id")).first()[0]
    lines = vocab.select(F.col("id").cast("long").alias("at"), F.concat(entry, F.when(F.col("id") < F.lit(last), ",")
                                                                       .otherwise("")).alias("value"))
    spark = vocab.sparkSession
    ends = spark.createDataFrame([(-1, "{"), ((last if last is not None else -1) + 1, "}")], "at long, value string")
    lines.unionByName(ends).repartition(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def id_array(vocab: DataFrame) -> Column:
    """Literal array of the characters by their dense id: decoding is one array access a
    token, for a vocabulary of any size (at most one entry per code point)."""
    import json
    rows = vocab.select("ch", "id").collect()
    chars = [c for _, c in sorted((int(r["id"]), r["ch"]) for r in rows)]
    return F.from_json(F.lit(json.dumps(chars)), "array<string>")


def decode_with_array(ids: Column, chars: Column) -> Column:
    """Dense ids -> text (Y4, R10) through :func:`id_array`; unknown ids give nothing."""
    return let(chars, lambda t: F.array_join(F.transform(ids, lambda i: F.try_element_at(t, (i + 1).cast("int"))), ""))
