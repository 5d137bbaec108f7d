"""Corpus scans and sinks.

Paths are expanded on the driver (file listing only, never rows); rows are
read by Spark's file sources with an explicit schema where one is known.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..operators.turns import blank_non_human, parse_role_text

FORMATS = {"parquet": ".parquet", "json_gz": ".jsonl.gz", "jsonl": ".jsonl"}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def depth_globs(path: str, ext: str, depth: int = 1) -> list[str]:
    """Glob patterns for files directly under ``path`` and up to ``depth``
    directory levels below (the reference's ``path*.x`` + ``path**/*.x`` without
    recursion means depth 1, quirk Q1; the trailing slash is normalised)."""
    base = path.rstrip("/") + "/"
    return [base + "*/" * d + "*" + ext for d in range(depth + 1)]


def list_files(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Expand glob patterns with the Hadoop file system (driver-side listing)."""
    out: list[str] = []
    for pat in patterns:
        fs, p = _fs(spark, pat)
        st = fs.globStatus(p)
        if st is None:
            continue
        out.extend(s.getPath().toString() for s in st if s.isFile())
    return sorted(set(out))


def detect_formats(spark: SparkSession, path: str, depth: int = 1) -> list[str]:
    """Which of parquet / jsonl.gz / jsonl a directory holds; may be several."""
    found = []
    for name, ext in FORMATS.items():
        files = list_files(spark, depth_globs(path, ext, depth))
        if name == "jsonl":
            files = [f for f in files if not f.endswith(".jsonl.gz")]
        if files:
            found.append(name)
    return found


def read_corpus(spark: SparkSession, path: str, fmt: str | None = None, depth: int = 1,
                text_col: str = "text", recursive: bool = False,
                min_partitions: int | None = None) -> DataFrame:
    """Text corpus scan (S1-S3, S7, S8, P1): only ``text`` is read, plus the
    lineage column ``source_file``.  ``recursive=True`` scans every level (S7).

    Gzip files are not splittable (one task per file), so the result is
    repartitioned when ``min_partitions`` is given.
    """
    fmts = [fmt] if fmt else detect_formats(spark, path, depth)
    parts = []
    for f in fmts:
        ext = FORMATS[f]
        if recursive:
            r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*" + ext)
            files = [path]
        else:
            r = spark.read
            files = list_files(spark, depth_globs(path, ext, depth))
            if f == "jsonl":
                files = [x for x in files if not x.endswith(".jsonl.gz")]
        if not files:
            continue
        if f == "parquet":
            df = r.parquet(*files).select(text_col)
        else:
            df = r.schema(f"{text_col} string").json(files)
        parts.append(df.select(F.col(text_col).alias("text"), F.input_file_name().alias("source_file")))
    if not parts:
        raise FileNotFoundError(f"no corpus files under {path}")
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.repartition(min_partitions) if min_partitions else out


def jsonl_to_parquet(spark: SparkSession, src: str, dst: str, text_col: str = "text") -> None:
    """Convert JSON lines to snappy parquet keeping only ``text``."""
    (spark.read.schema(f"{text_col} string").json(src).select(text_col)
     .write.mode("overwrite").option("compression", "snappy").parquet(dst))


def write_lang_split(df: DataFrame, path: str, lang: str = "lang", split: str = "split") -> None:
    """Named-config / split layout ``lang=../split=..``."""
    df.write.mode("overwrite").partitionBy(lang, split).parquet(path)


def read_lang_split(spark: SparkSession, path: str, lang: str, split: str) -> DataFrame:
    """Load one config and split; the filter prunes partitions."""
    return spark.read.parquet(path).where((F.col("lang") == lang) & (F.col("split") == split))


_CORRUPT = "_corrupt_record"


def _parse_json(value: Column, schema: str) -> Column:
    """``from_json`` that keeps malformed lines in ``_corrupt_record``."""
    return F.from_json(value, f"{schema}, {_CORRUPT} string",
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})


def read_json_lines(spark: SparkSession, path: str, schema: str, quarantine: str | None = None) -> DataFrame:
    """Line scan, blank lines skipped, each line parsed as JSON.

    No line is lost silently: lines that fail to parse are written to ``quarantine`` as
    text (P12); without one, the first of them fails the query.
    """
    lines = spark.read.text(path).where(strip_ws(F.col("value")) != "")
    if quarantine is not None:
        good, bad = split_bad_json(lines, "value", schema)
        bad.select(F.col("raw").alias("value")).write.mode("overwrite").text(quarantine)
        return good
    j = lines.select("value", _parse_json(F.col("value"), schema).alias("_j"))
    broken = F.raise_error(F.concat(F.lit("not a JSON record: "), F.substring("value", 1, 200))).cast("boolean")
    return j.where(F.when(F.col(f"_j.{_CORRUPT}").isNull(), F.lit(True)).otherwise(broken)).select("_j.*").drop(_CORRUPT)


def split_bad_json(lines: DataFrame, value: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined raw lines) without failing the task."""
    p = lines.withColumn("_j", _parse_json(F.col(value), schema))
    good = p.where(F.col(f"_j.{_CORRUPT}").isNull()).select("_j.*").drop(_CORRUPT)
    bad = p.where(F.col(f"_j.{_CORRUPT}").isNotNull()).select(F.col(value).alias("raw"))
    return good, bad


CHAT_RECORD_SCHEMA = ("conv_id long, data array<string>, "
                      "conversations array<struct<`from`:string,value:string>>")


def dispatch_chat_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """Per-record schema dispatch (P7): ``data`` as is; else ``conversations``
    with every non-human value blanked, dropped when the first is blank (P10);
    else the record is dropped."""
    j = lines.select(F.from_json(F.col(value), CHAT_RECORD_SCHEMA).alias("j")).select("j.*")
    blanked = blank_non_human(F.col("conversations"))
    prompts = (F.when(F.col("data").isNotNull(), F.col("data"))
               .when(F.col("conversations").isNotNull() & (F.element_at(blanked, 1) != ""), blanked))
    return j.select("conv_id", prompts.alias("prompts")).where(F.col("prompts").isNotNull())


TURN_LIST = "array<struct<role:string,content:string>>"


def text_turns(lines: DataFrame, value: str = "value", out: str = "turns") -> DataFrame:
    """Records whose ``text`` is a list of role / content objects or one role text.

    The line is parsed as VARIANT, so the kind is told per record, not from a file's
    first one.  A list is taken as it is, a string goes through
    :func:`..operators.turns.parse_role_text`; a record of neither kind, without
    ``text`` or of broken JSON has null turns (quarantine, :func:`split_bad_json`)."""
    v = F.try_parse_json(F.col(value))
    kind = F.schema_of_variant(F.try_variant_get(v, "$.text", "variant"))
    d = lines.withColumn("_tt_kind", kind)
    listed = F.when(F.col("_tt_kind").startswith("ARRAY"), F.try_variant_get(v, "$.text", TURN_LIST))
    said = F.when(F.col("_tt_kind") == "STRING", F.try_variant_get(v, "$.text", "string"))
    d = parse_role_text(d.withColumn("_tt_text", said), "_tt_text", "_tt_parsed")
    return d.withColumn(out, F.coalesce(listed, F.col("_tt_parsed"))).drop("_tt_kind", "_tt_text", "_tt_parsed")


def chat_record_json(turns: Column | str) -> Column:
    """``{"data": [{"role": .., "content": ..}, ..]}`` text of a conversation."""
    t = F.col(turns) if isinstance(turns, str) else turns
    return F.to_json(F.struct(t.alias("data")))


def write_json_lines(df: DataFrame, path: str, value: str, order: str | None = None) -> None:
    """JSON-lines sink (S20); non-ASCII is written raw.  With ``order`` the part files,
    read by name, hold the rows in that order: rows are dealt to them by ranges of it."""
    d = df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, order).sortWithinPartitions(order) \
        if order else df
    d.select(F.col(value).alias("value")).write.mode("overwrite").text(path)


def label_file_name(file: Column, lo: float, hi: float) -> Column:
    """``{stem}_pseudo_labels_{lo}_{hi}.jsonl`` of an input file's name or path."""
    stem = F.regexp_replace(F.regexp_extract(file, r"([^/]*)$", 1), r"\.jsonl$", "")
    return F.concat(stem, F.lit(f"_pseudo_labels_{lo}_{hi}.jsonl"))


def write_labels(df: DataFrame, path: str, file: str, order: str, value: str, lo: float = 0.0, hi: float = 1.0,
                 partitions: int | None = None) -> list[str]:
    """One output per input file (S20): rows ``int(lo * n)`` to ``int(hi * n)`` of each
    ``file`` in ``order``, as JSON lines under ``path/{stem}_pseudo_labels_{lo}_{hi}.jsonl``.
    Returns the outputs' names.

    An output is a directory of part files that hold its rows in order when read by
    name.  Rows are dealt to tasks by ranges of (output, order), so an input that holds
    most rows is written by many tasks; non-ASCII is written raw."""
    from ..operators.combine import slice_fraction
    spark = df.sparkSession
    rows = slice_fraction(df.select(file, order, value), lo, hi, [file], [order], None) if (lo, hi) != (0.0, 1.0) else df
    rows = rows.select(label_file_name(F.col(file), lo, hi).alias("output"), F.col(order).alias("_order"),
                       F.col(value).alias("value"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rows.repartitionByRange(n, "output", "_order").sortWithinPartitions("output", "_order")
     .select("output", "value").write.mode("overwrite").partitionBy("output").text(path))
    fs, at = _fs(spark, path)
    names = []
    for st in fs.listStatus(at):                 # one directory an input file: names, no rows
        name = st.getPath().getName()
        if name.startswith("output="):
            plain = spark._jvm.java.net.URLDecoder.decode(name[len("output="):], "UTF-8")
            fs.rename(st.getPath(), spark._jvm.org.apache.hadoop.fs.Path(at, plain))
            names.append(plain)
    return sorted(names)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``output, position, value`` of what :func:`write_labels` wrote, lines numbered in
    the order of the files."""
    from ..operators.ordered import keyed_index
    from ..session import materialize
    raw = spark.read.text(path.rstrip("/") + "/*/part-*")
    rows = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("nth"))
    rows = rows.withColumn("output", F.regexp_extract("file", r"([^/]*)/[^/]*$", 1)) \
        .withColumn("part", F.regexp_extract("file", r"/part-(\d+)", 1).cast("long"))
    rows = keyed_index(materialize(rows), ["output"], ["part", "file", "block", "nth"], name="position")
    return rows.select("output", "position", "value")


def read_whole_text(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """One row per file with its whole content decoded."""
    b = spark.read.format("binaryFile").load(path)
    return b.select(F.col("path").alias("source_file"), F.decode(F.col("content"), encoding).alias("text"))


def write_samples(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Save a sample table (S18); ``partition_by=['bucket_hi']`` writes one
    directory per length bucket in a single pass (S19)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
