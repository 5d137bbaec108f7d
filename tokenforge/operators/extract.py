"""Entity / relation extraction output: prompt rendering, parsing, merging
(C10, C12, C13, C19, C20).

Fixed values: the record format of the extraction prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let
from ..functions.text import fill_template, strip_ws

# Delimiters, the merge separator and the refusal text of the
# extraction / keyword prompts.
TUPLE_DELIMITER = "<|>"
RECORD_DELIMITER = "##"
COMPLETION_DELIMITER = "<|COMPLETE|>"
GRAPH_FIELD_SEP = "<SEP>"
FAIL_RESPONSE = "Sorry, I'm not able to provide an answer to that question."
ARITY = {"entity": 4, "relationship": 6, "content_keywords": 2}

RECORD_SCHEMA = ("array<struct<tag:string,f1:string,f2:string,f3:string,f4:string,f5:string,"
                 "n_fields:int,valid:boolean>>")


def _q(s: str) -> str:
    return r"\Q" + s + r"\E"


def clean_field(f: Column) -> Column:
    """Whitespace-stripped, then surrounding double quotes removed."""
    return F.regexp_replace(strip_ws(f), '^"+|"+$', "")


def parse_records(text) -> Column:
    """Extraction output -> ``ARRAY<STRUCT<tag, f1..f5, n_fields, valid>>``.

    Cut at the completion mark, split records at ``##``, strip whitespace and
    the surrounding parentheses, split fields at ``<|>``, clean each field and
    dispatch on the tag; a record whose field count does not match its tag's
    arity (or has an unknown tag) is kept with ``valid = false`` so that it
    can go to a quarantine table.
    """
    t = F.col(text) if isinstance(text, str) else text
    body = F.substring_index(t, COMPLETION_DELIMITER, 1)
    recs = F.filter(F.transform(F.split(body, _q(RECORD_DELIMITER)), lambda r: strip_ws(r)), lambda r: r != "")

    def one(r):
        inner = F.regexp_replace(F.regexp_replace(r, r"^\(", ""), r"\)$", "")
        return let(F.transform(F.split(inner, _q(TUPLE_DELIMITER)), clean_field), lambda fs: F.struct(
            F.element_at(fs, 1).alias("tag"),
            *[F.try_element_at(fs, F.lit(i + 1)).alias(f"f{i}") for i in range(1, 6)],
            F.size(fs).alias("n_fields"),
            F.coalesce(*[F.when(F.element_at(fs, 1) == k, F.size(fs) == v) for k, v in ARITY.items()],
                       F.lit(False)).alias("valid")))
    return F.transform(recs, one)


def entities(parsed: DataFrame, key: str, recs: str) -> DataFrame:
    """Valid entity rows ``(key, name, type, description)`` of parsed output."""
    e = parsed.select(key, F.explode(recs).alias("r")).where((F.col("r.tag") == "entity") & F.col("r.valid"))
    return e.select(key, F.col("r.f1").alias("name"), F.col("r.f2").alias("type"), F.col("r.f3").alias("description"))


def merge_entities(ents: DataFrame) -> DataFrame:
    """One row per entity name (C13): the most frequent type (ties: the
    smallest), the distinct descriptions sorted and joined with ``<SEP>``,
    and the mention count.  Type counts are pre-aggregated per (name, type)."""
    tc = ents.groupBy("name", "type").agg(F.count(F.lit(1)).alias("c"))
    best = tc.groupBy("name").agg(F.min_by("type", F.struct((-F.col("c")).alias("nc"), F.col("type"))).alias("type"),
                                  F.sum("c").alias("n_mentions"))
    # distinct descriptions first: a name met very often is collected by its wordings only
    desc = ents.select("name", "description").distinct().groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("description")), GRAPH_FIELD_SEP)
                                    .alias("description"))
    return best.join(desc, "name")


def merge_relationships(parsed: DataFrame, key: str, recs: str) -> DataFrame:
    """One row per (source, target): descriptions and keywords joined with
    ``<SEP>``, strengths summed, mentions counted (C13).  A strength that is no number
    counts as none."""
    r = parsed.select(F.explode(recs).alias("r")).where((F.col("r.tag") == "relationship") & F.col("r.valid"))
    r = r.select(F.col("r.f1").alias("src"), F.col("r.f2").alias("dst"), F.col("r.f3").alias("description"),
                 F.col("r.f4").alias("keywords"), F.col("r.f5").try_cast("double").alias("strength"))
    # equal records first become one row, so a pair that is named again and again is
    # collected by its distinct wordings only
    r = r.groupBy("src", "dst", "description", "keywords").agg(F.sum("strength").alias("strength"), F.count("*").alias("n"))
    return r.groupBy("src", "dst").agg(
        F.array_join(F.array_sort(F.collect_set("description")), GRAPH_FIELD_SEP).alias("description"),
        F.array_join(F.array_sort(F.collect_set("keywords")), GRAPH_FIELD_SEP).alias("keywords"),
        F.sum("strength").alias("strength"), F.sum("n").alias("n_mentions"))


KEYWORD_SCHEMA = "high_level_keywords array<string>, low_level_keywords array<string>"


def keyword_rows(df: DataFrame, answer: str) -> DataFrame:
    """Parse keyword answers (C20): one row per ``(level, keyword)``; an
    unparsable answer gives one row ``('none', refusal text)``."""
    j = F.from_json(F.col(answer), KEYWORD_SCHEMA)
    ok = j.isNotNull() & (j["high_level_keywords"].isNotNull() | j["low_level_keywords"].isNotNull())
    rows = F.when(ok, F.concat(
        F.transform(F.coalesce(j["high_level_keywords"], F.array().cast("array<string>")),
                    lambda k: F.struct(F.lit("high").alias("level"), k.alias("keyword"))),
        F.transform(F.coalesce(j["low_level_keywords"], F.array().cast("array<string>")),
                    lambda k: F.struct(F.lit("low").alias("level"), k.alias("keyword"))))).otherwise(
        F.array(F.struct(F.lit("none").alias("level"), F.lit(FAIL_RESPONSE).alias("keyword"))))
    return df.withColumn("_kw", rows)


def render(template: str, values: dict[str, Column]) -> Column:
    """Prompt from a template with ``{name}`` placeholders."""
    return fill_template(template, values)
