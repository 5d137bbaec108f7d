"""Scans and sinks: token store round trip, fixed records, corpus layouts,
json lines, synthetic source."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF001
from tokenforge.functions import tokens as T
from tokenforge.sources import corpus as IO
from tokenforge.sources import tokenstore as TS
from tokenforge.sources.synthetic import dummy_arithmetic


def test_token_store_round_trip(spark):
    TS.register(spark)
    d = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", T.codepoints("text").alias("tokens"))
    d = d.repartition(3, "doc_id").sortWithinPartitions("doc_id")
    out = tempfile.mkdtemp(prefix="tf-store-")
    d.write.format("tokenstore").mode("overwrite").option("dtype", "int32").save(out)
    back = spark.read.format("tokenstore").option("itemsPerPartition", 17).load(out)
    got = sorted(tuple(r["tokens"]) for r in back.collect())
    exp = sorted(tuple(r["tokens"]) for r in d.collect())
    assert got == exp
    # header and pointers follow the documented layout
    idx_files = sorted(f for f in os.listdir(out) if f.endswith(".idx"))
    idx = TS.read_index(os.path.join(out, idx_files[0]))
    assert idx.pointers[0] == 0
    assert list(np.diff(idx.pointers)) == list(idx.sizes[:-1].astype(np.int64) * 4)


def _store(rows, spark):
    return spark.createDataFrame([(list(x),) for x in rows], "tokens array<int>")


def _items(spark, path):
    return sorted(tuple(r["tokens"]) for r in spark.read.format("tokenstore").load(path).collect())


def test_token_store_append_overwrite_and_leftovers(spark):
    TS.register(spark)
    out = tempfile.mkdtemp(prefix="tf-store-") + "/s"
    _store([[1, 2], [], [3]], spark).repartition(2).write.format("tokenstore").mode("append").save(out)
    _store([[4]], spark).coalesce(1).write.format("tokenstore").mode("append").save(out)
    assert _items(spark, out) == [(), (1, 2), (3,), (4,)]
    # what a failed attempt or an uncommitted write left behind is not read
    for end in (".idx", ".bin"):
        name = TS.shards(out)[0]["shard"]
        with open(f"{out}/{name}{end}", "rb") as f, open(f"{out}/shard-lost{end}", "wb") as g:
            g.write(f.read())
    assert _items(spark, out) == [(), (1, 2), (3,), (4,)]
    _store([[9, 9]], spark).coalesce(1).write.format("tokenstore").mode("overwrite").save(out)
    assert _items(spark, out) == [(9, 9)]
    assert sorted(x for x in os.listdir(out) if x.endswith(".idx")) == sorted(
        [TS.shards(out)[0]["shard"] + ".idx", "shard-lost.idx"])


def test_token_store_without_manifest_is_kept_by_an_append(spark):
    TS.register(spark)
    out = tempfile.mkdtemp(prefix="tf-store-")
    with open(out + "/other.idx", "wb") as f:
        f.write(TS.index_bytes("uint16", np.array([2, 1]), np.array([0, 1, 2])))
    np.array([5, 6, 7], np.uint16).tofile(out + "/other.bin")
    assert _items(spark, out) == [(5, 6), (7,)] == _items(spark, out + "/other")
    _store([[8]], spark).coalesce(1).write.format("tokenstore").mode("append").option("dtype", "uint16").save(out)
    assert _items(spark, out) == [(5, 6), (7,), (8,)]


def test_token_store_refuses_tokens_that_do_not_fit(spark):
    TS.register(spark)
    out = tempfile.mkdtemp(prefix="tf-store-") + "/s"
    try:
        _store([[70_000]], spark).write.format("tokenstore").option("dtype", "uint16").mode("append").save(out)
    except Exception as e:
        assert "fit" in str(e)
    else:
        raise AssertionError("70,000 was cut to 16 bits")


def test_token_store_index_layout():
    raw = TS.index_bytes("int32", np.array([3, 0, 2]), np.array([0, 1, 2, 3]))
    assert raw[:9] == b"MMIDIDX\x00\x00" and raw[9:17] == (1).to_bytes(8, "little") and raw[17] == 4
    assert raw[18:26] == (3).to_bytes(8, "little") and raw[26:34] == (4).to_bytes(8, "little")
    assert np.frombuffer(raw[34:46], "<i4").tolist() == [3, 0, 2]
    assert np.frombuffer(raw[46:70], "<i8").tolist() == [0, 12, 12]
    assert np.frombuffer(raw[70:], "<i8").tolist() == [0, 1, 2, 3]


def test_short_last_record_is_kept(spark):
    TS.register(spark)
    p = os.path.join(tempfile.mkdtemp(prefix="tf-rec-"), "data.bin")
    np.arange(10, dtype=np.uint16).tofile(p)
    r = spark.read.format("tokenrecords").option("recordLength", 4).option("recordsPerPartition", 2).load(p)
    assert sorted((x["record"], x["tokens"]) for x in r.collect()) == [(0, [0, 1, 2, 3]), (1, [4, 5, 6, 7]), (2, [8, 9])]


def test_fixed_uint16_records(spark):
    TS.register(spark)
    p = os.path.join(tempfile.mkdtemp(prefix="tf-rec-"), "data.bin")
    np.arange(60, dtype=np.uint16).tofile(p)
    r = spark.read.format("tokenrecords").option("recordLength", 6).option("recordsPerPartition", 4).load(p)
    rows = sorted((x["record"], x["tokens"]) for x in r.collect())
    assert len(rows) == 10 and rows[3] == (3, list(range(18, 24)))


def test_npy_records(spark):
    TS.register(spark)
    p = os.path.join(tempfile.mkdtemp(prefix="tf-npy-"), "toks.npy")
    np.save(p, np.arange(25, dtype=np.int64))
    r = spark.read.format("tokenrecords").option("recordLength", 5).load(p)
    assert sorted(x["tokens"][0] for x in r.collect()) == [0, 5, 10, 15, 20]


def test_depth_globs_and_formats(spark):
    root = tempfile.mkdtemp(prefix="tf-corpus-")
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    df.write.mode("overwrite").parquet(root + "/p")
    df.write.mode("overwrite").json(root + "/j")
    df.write.mode("overwrite").option("compression", "gzip").json(root + "/g")
    # rename the json parts to the extensions the corpus scanner looks for
    for sub, ext in (("j", ".jsonl"), ("g", ".jsonl.gz")):
        for f in os.listdir(root + "/" + sub):
            if f.startswith("part-"):
                os.rename(os.path.join(root, sub, f), os.path.join(root, sub, f.split(".")[0] + ext))
    assert IO.detect_formats(spark, root, depth=1) == ["parquet", "json_gz", "jsonl"]
    r = IO.read_corpus(spark, root, depth=1)
    assert sorted(x["text"] for x in r.collect()) == ["a", "a", "a", "b", "b", "b"]
    assert IO.depth_globs("/x", ".parquet", 1) == ["/x/*.parquet", "/x/*/*.parquet"]


def test_json_lines_quarantine(spark):
    lines = spark.createDataFrame([('{"a": 1}',), ("not json",), ('{"a": 2}',)], "value string")
    good, bad = IO.split_bad_json(lines, "value", "a long")
    assert sorted(r["a"] for r in good.collect()) == [1, 2]
    assert [r["raw"] for r in bad.collect()] == ["not json"]


def test_dummy_arithmetic(spark):
    d = dummy_arithmetic(spark, 100000)
    rows = {r["i"]: r["item"] for r in d.where(F.col("i").isin(0, 7, 99999)).collect()}
    assert rows[0] == ".0+0=0."
    assert rows[7] == ".7+49=56."
    assert rows[99999] == f".{99999 % 10000}+{99999 * 99999 % 10000}={99999 % 10000 + 99999 * 99999 % 10000}."
    assert d.count() == 100000


def test_bucket_write_one_pass(spark):
    from tokenforge.operators.corpus import corpus_samples, with_inclusive_bucket, write_buckets
    d = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    s = with_inclusive_bucket(corpus_samples(d, 2048), "real_len", 1, 2048, 256).drop("text")
    out = tempfile.mkdtemp(prefix="tf-buckets-") + "/b"
    write_buckets(s, out)
    back = spark.read.parquet(out)
    assert back.count() == d.count()
    dirs = sorted(x for x in os.listdir(out) if x.startswith("bucket_hi="))
    assert len(dirs) == s.select("bucket_hi").distinct().count()
    assert back.where((F.col("real_len") > F.col("bucket_hi")) | (F.col("real_len") < F.col("bucket_lo"))).count() == 0


def test_jsonl_to_parquet_and_whole_text(spark):
    root = tempfile.mkdtemp(prefix="tf-conv-")
    with open(os.path.join(root, "a.jsonl"), "w") as f:
        f.write('{"text": "x", "other": 1}\n{"text": "é y"}\n')
    IO.jsonl_to_parquet(spark, os.path.join(root, "a.jsonl"), os.path.join(root, "out"))
    got = spark.read.parquet(os.path.join(root, "out"))
    assert got.columns == ["text"] and sorted(r["text"] for r in got.collect()) == ["x", "é y"]
    with open(os.path.join(root, "w.txt"), "w", encoding="utf-16") as f:
        f.write("ab\ncd")
    w = IO.read_whole_text(spark, os.path.join(root, "w.txt"), "utf-16").first()
    assert w["text"] == "ab\ncd"


def test_bad_json_lines_fail_or_go_to_quarantine(spark):
    root = tempfile.mkdtemp(prefix="tf-bad-")
    with open(root + "/x.jsonl", "w") as f:
        f.write('{"a": 1}\n \nnot json\n{"a": 2}\n')
    good = IO.read_json_lines(spark, root + "/x.jsonl", "a long", quarantine=root + "/bad")
    assert sorted(r["a"] for r in good.collect()) == [1, 2]
    assert [r["value"] for r in spark.read.text(root + "/bad").collect()] == ["not json"]
    try:
        IO.read_json_lines(spark, root + "/x.jsonl", "a long").collect()
    except Exception as e:
        assert "not a JSON record" in str(e)
    else:
        raise AssertionError("a malformed line was dropped")


def test_labels_keep_their_order_names_and_characters(spark):
    root = tempfile.mkdtemp(prefix="tf-labels-") + "/out"
    rows = [(f"/in/a b.jsonl" if i % 10 else "/in/c.jsonl", i, f'{{"data": "\u00e9\u4e2d {i}"}}') for i in range(500)]
    df = spark.createDataFrame(rows, "file string, line long, json string").repartition(7)
    names = IO.write_labels(df, root, "file", "line", "json", 0.1, 1.0, partitions=5)
    assert names == ["a b_pseudo_labels_0.1_1.0.jsonl", "c_pseudo_labels_0.1_1.0.jsonl"]
    for name, want in zip(names, ([r for r in rows if "a b" in r[0]][45:], [r for r in rows if "c" in r[0]][5:])):
        got = []
        for part in sorted(os.listdir(f"{root}/{name}")):
            if part.startswith("part-"):
                with open(f"{root}/{name}/{part}", encoding="utf-8") as f:
                    got += f.read().splitlines()
        assert got == [r[2] for r in want]
    back = IO.read_labels(spark, root).where(F.col("output").startswith("c")).orderBy("position").collect()
    assert [r["value"] for r in back] == [r[2] for r in rows if "c" in r[0]][5:]


def test_one_large_log_over_many_tasks(spark):
    from tokenforge.sources.logs import numbered_lines, parse_epoch_log
    path = tempfile.mkdtemp(prefix="tf-log-") + "/train.log"
    with open(path, "w") as f:
        for run in range(300):
            f.write(f"NEW RUN 2024-01-01-00-00-{run:02d}\n{{'lr': {run}}}\n")
            for e in range(run % 4):
                f.write(f"{e} {run + e / 10:.6f} 1.5000  {e}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert numbered_lines(spark, path).rdd.getNumPartitions() > 4
        got = sorted((r["run_no"], r["epoch"], r["loss"]) for r in parse_epoch_log(spark, path, rows_per_chunk=50).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(run, e, round(run + e / 10, 6)) for run in range(300) for e in range(run % 4)]


def test_corpus_below_any_level_and_plain_formats(spark):
    """Gzip and plain JSON lines, the whole tree."""
    import gzip
    root = tempfile.mkdtemp(prefix="tf-deep-")
    os.makedirs(root + "/a/b/c")
    with open(root + "/x.jsonl", "w") as f:
        f.write('{"text": "one", "other": 1}\n')
    with gzip.open(root + "/a/b/c/y.jsonl.gz", "wt") as f:
        f.write('{"text": "two"}\n')
    assert [r["text"] for r in IO.read_corpus(spark, root, "jsonl", depth=0).collect()] == ["one"]
    assert [r["text"] for r in IO.read_corpus(spark, root, "json_gz", recursive=True).collect()] == ["two"]


def test_samples_are_saved_and_split_by_bucket(spark):
    """One pass, one directory a bucket."""
    out = tempfile.mkdtemp(prefix="tf-samples-") + "/s"
    df = spark.createDataFrame([([1, 2], 256), ([3], 512)], "ids array<int>, bucket_hi int")
    IO.write_samples(df, out, ["bucket_hi"])
    assert sorted(x for x in os.listdir(out) if x.startswith("bucket")) == ["bucket_hi=256", "bucket_hi=512"]
    IO.write_samples(df, out + "2")
    assert spark.read.parquet(out + "2").count() == 2


def test_run_summaries_and_config(spark):
    from tokenforge.sources.logs import read_run_config, read_run_summaries
    root = tempfile.mkdtemp(prefix="tf-runs-")
    for i, body in enumerate(['{"loss": 1.5, "_step": 10, "_timestamp": 1700000000.5, "_meta": {"runtime": 5}}',
                              '{"_step": 3, "_timestamp": 1700000100.0}']):
        os.makedirs(os.path.join(root, f"run{i}"))
        with open(os.path.join(root, f"run{i}", "summary.json"), "w") as f:
            f.write(body)
        with open(os.path.join(root, f"run{i}", "config.yaml"), "w") as f:
            f.write(f"lr:\n  desc: null\n  value: 0.{i + 1}\nbatch:\n  desc: null\n  value: {8 * (i + 1)}\n")
    s = read_run_summaries(spark, root + "/*/summary.json")
    rows = sorted((r["_step"], r["loss"]) for r in s.collect())
    assert rows == [(3, None), (10, 1.5)]
    assert s.where(F.col("_step") == 10).first()["_meta"]["runtime"] == 5
    c = read_run_config(spark, root + "/*/config.yaml")
    assert sorted((r["key"], r["value"]) for r in c.collect()) == [("batch", "16"), ("batch", "8"),
                                                                     ("lr", "0.1"), ("lr", "0.2")]
