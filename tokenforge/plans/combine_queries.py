"""Documents as sources: concat, interleave, splits, slices, shuffles and the
flat token store (SURVEY 7.7 rows 6-7).

``source`` plays the file / dataset path; order inside a source is ``doc_id``.
The token store is ``documents`` as code points in ``doc_id`` order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import combine as C
from ..operators import token_stream as S
from ..operators.ordered import _join_small, global_index, keyed_index
from ..session import materialize, scratch_path
from ..sources import tokenstore as TS
from ..sources.tables import read_table
from .corpus_queries import cp_sql
from .registry import query

SPLIT_SEED = "tf-seed-7"
SHUFFLE_SEED = "tf-shuffle"
CTX = 64
REQ = CTX + 1


def _docs(spark, sf_dir, *cols):
    return read_table(spark, sf_dir, "documents", list(cols) or ["doc_id", "source", "lang"])


def _store(spark, sf_dir) -> S.TokenStore:
    """The documents as one stream of code points: texts in rows of bounded size and a
    thin index of sizes and offsets."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    return S.build_text_store(d, "doc_id", "text", ["doc_id"], extra=["source"])


def _sizes(spark, sf_dir):
    """Token counts of the documents; a code-point token is a character."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    return d.select("doc_id", "source", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("size"))


STORE_SQL = f"""
st0 AS (SELECT doc_id, source, {cp_sql('text')} AS cp FROM documents),
store AS (SELECT doc_id, source, cp, len(cp)::BIGINT AS size,
          coalesce(sum(len(cp)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
            AS start FROM st0),
tot AS (SELECT sum(size)::BIGINT AS total FROM store),
tok AS (SELECT start + i - 1 AS g, cp[i] AS t FROM (SELECT start, cp, unnest(range(1, len(cp) + 1)) AS i FROM store))"""


# ---------------------------------------------------------------- set ops
@query("concat_sources", sql="""
WITH l AS (SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM documents)
SELECT doc_id, lang, 0::BIGINT AS part FROM l WHERE k % 3 <> 2
UNION ALL
SELECT doc_id, lang, 1::BIGINT AS part FROM l WHERE k % 3 <> 1""")
def q_concat_sources(spark, sf_dir):
    """UNION ALL of two overlapping sources, duplicates kept (U1): the languages that occur
    (null included), dealt in turn to both, the first or the second."""
    d = _docs(spark, sf_dir, "doc_id", "lang")
    langs = keyed_index(d.select("lang").distinct(), [], ["lang"], name="k")
    d = _join_small(d, langs, ["lang"])
    a, b = d.where(F.col("k") % 3 != 2).drop("k"), d.where(F.col("k") % 3 != 1).drop("k")
    return C.concat_sources([a, b], "part").withColumn("part", F.col("part").cast("long"))


@query("interleave_sources", sql="""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rn FROM documents),
s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS sp FROM (SELECT DISTINCT source FROM documents)),
m AS (SELECT min(c) AS mc FROM (SELECT count(*) AS c FROM documents GROUP BY source)),
ns AS (SELECT count(*) AS n FROM s)
SELECT doc_id, source, (rn * n + sp)::BIGINT AS position FROM r JOIN s USING (source), m, ns WHERE rn < mc""")
def q_interleave_sources(spark, sf_dir):
    """Round-robin over the sources until the shortest one ends."""
    d = _docs(spark, sf_dir, "doc_id", "source")
    return C.interleave(d, "source", ["doc_id"], F.col("doc_id")).select("doc_id", "source", "position")


@query("train_val_split", sql=f"""
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('{SPLIT_SEED}' || doc_id::VARCHAR), doc_id) - 1 AS rn,
                  count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rn < ceil(0.1::DOUBLE * n) THEN 'validation' ELSE 'train' END AS side FROM o""")
def q_train_val_split(spark, sf_dir):
    """Seeded exact split: ``ceil(0.1 n)`` validation rows by md5 order."""
    d = _docs(spark, sf_dir, "doc_id")
    return C.split_exact(d, 0.1, "doc_id", SPLIT_SEED).select("doc_id", "side")


@query("stratified_split", sql=f"""
WITH o AS (SELECT doc_id, source,
                  row_number() OVER (PARTITION BY source ORDER BY md5('{SPLIT_SEED}' || doc_id::VARCHAR), doc_id) - 1 AS rn,
                  count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CASE WHEN rn < ceil(0.1::DOUBLE * n) THEN 'validation' ELSE 'train' END AS side FROM o""")
def q_stratified_split(spark, sf_dir):
    """Split inside every source, then concatenate per side (U4)."""
    d = _docs(spark, sf_dir, "doc_id", "source")
    return C.split_exact(d, 0.1, "doc_id", SPLIT_SEED, by=["source"]).select("doc_id", "source", "side")


@query("percent_slice", sql="""
WITH o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx,
                  count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, idx::BIGINT AS idx FROM o
WHERE idx >= floor(0.3::DOUBLE * n) AND idx < floor(0.6::DOUBLE * n)""")
def q_percent_slice(spark, sf_dir):
    """Rows ``[int(0.3 n), int(0.6 n))`` of every source in file order."""
    d = _docs(spark, sf_dir, "doc_id", "source")
    return C.slice_fraction(d, 0.3, 0.6, ["source"], ["doc_id"], F.col("doc_id")).select("doc_id", "source", "idx")


@query("rows_per_source", sql="SELECT source, count(*) AS n_rows FROM documents GROUP BY source")
def q_rows_per_source(spark, sf_dir):
    """Row count per source / file (A3)."""
    return _docs(spark, sf_dir, "source").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))


@query("token_totals", sql=f"""
SELECT source, count(*) AS n_docs, sum(len({cp_sql('text')}))::BIGINT AS n_tokens FROM documents GROUP BY source""")
def q_token_totals(spark, sf_dir):
    """Token count of each source's store (A4)."""
    d = _docs(spark, sf_dir, "source", "text")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"),
                                   F.sum(F.size(T.codepoints("text"))).cast("long").alias("n_tokens"))


@query("round_robin_assign", sql="""
WITH s AS (SELECT source, count(*) AS n_rows FROM documents GROUP BY source),
r AS (SELECT source, n_rows, row_number() OVER (ORDER BY source) - 1 AS file_idx FROM s)
SELECT source, file_idx::BIGINT AS file_idx, (file_idx % 3)::BIGINT AS worker, n_rows FROM r""")
def q_round_robin_assign(spark, sf_dir):
    """File ``i`` -> worker ``i % 3``."""
    per_file = _docs(spark, sf_dir, "source").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    return C.round_robin(per_file, "source", 3).select("source", "file_idx", "worker", "n_rows")


@query("epoch_shuffle", sql=f"""
WITH e AS (SELECT doc_id, unnest([0, 1]) AS epoch FROM documents)
SELECT doc_id, epoch::INTEGER AS epoch,
       (row_number() OVER (PARTITION BY epoch ORDER BY md5('{SHUFFLE_SEED}' || epoch::VARCHAR || ':' || doc_id::VARCHAR),
                           doc_id) - 1)::BIGINT AS position FROM e""")
def q_epoch_shuffle(spark, sf_dir):
    """Seeded per-epoch permutation."""
    d = _docs(spark, sf_dir, "doc_id")
    return C.epoch_shuffle(d, "doc_id", SHUFFLE_SEED, [0, 1]).select("doc_id", "epoch", "position")


@query("rank_shard", sql="""
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)
SELECT doc_id, (idx % 4)::BIGINT AS rank, (idx // 4)::BIGINT AS local_idx,
       (1 + 2 * 1000 + (idx // 4) * 4 + idx % 4)::BIGINT AS sample_no FROM o""")
def q_rank_shard(spark, sf_dir):
    """Rank shard and global sample number, world 4, epoch 2, 1000 per epoch."""
    d = global_index(_docs(spark, sf_dir, "doc_id"), ["doc_id"], F.col("doc_id"))
    return C.rank_shard(d, "idx", 4, 2, 1000).select("doc_id", "rank", "local_idx", "sample_no")


@query("collate_batches", sql="""
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)
SELECT doc_id, (idx // 8)::BIGINT AS batch_id, (idx % 8)::BIGINT AS slot FROM o WHERE idx // 8 < n // 8""")
def q_collate_batches(spark, sf_dir):
    """Batches of 8 in order, last partial batch dropped."""
    d = _docs(spark, sf_dir, "doc_id")
    n = d.count()
    d = global_index(d, ["doc_id"], F.col("doc_id"))
    return C.collate(d, "idx", 8, n).select("doc_id", "batch_id", "slot")


# ---------------------------------------------------------------- token store
@query("doc_pointers", sql=f"""
WITH {STORE_SQL}
SELECT doc_id, size, (start * 4)::BIGINT AS ptr FROM store""")
def q_doc_pointers(spark, sf_dir):
    """Sizes and byte pointers (exclusive prefix sum x 4 bytes) of the store."""
    return S.size_offsets(_sizes(spark, sf_dir), F.col("size"), ["doc_id"]).select("doc_id", "size", "ptr")


@query("shard_manifest_lookup", sql=f"""
WITH {STORE_SQL},
m0 AS (SELECT source, (sum(size) - {CTX})::BIGINT AS chunk_count FROM store GROUP BY source),
m AS (SELECT source, chunk_count, sum(chunk_count) OVER (ORDER BY source) AS cutoff FROM m0),
mm AS (SELECT source, chunk_count, cutoff, cutoff - chunk_count AS prev_cutoff FROM m),
tc AS (SELECT max(cutoff) AS total_chunks FROM mm),
pt AS (SELECT doc_id, (('0x' || substr(md5('chunk:' || doc_id::VARCHAR), 1, 15))::BIGINT % total_chunks)::BIGINT AS i
       FROM documents, tc)
SELECT doc_id, i, source AS shard, ((i - prev_cutoff) % chunk_count)::BIGINT AS local_offset
FROM pt JOIN mm ON i >= prev_cutoff AND i < cutoff""")
def q_shard_manifest_lookup(spark, sf_dir):
    """Manifest of per-source shards, written and scanned as a manifest file, and the
    interval lookup of chunk numbers (S14, J2)."""
    st = _sizes(spark, sf_dir)
    per_shard = st.groupBy("source").agg(F.sum("size").alias("tokens"))
    path = scratch_path(spark, "manifest")
    S.write_manifest(S.shard_manifest(per_shard, "source", "tokens", CTX), path, "source")
    man = S.read_manifest(spark, path, "source")
    total = man.agg(F.max("cutoff")).first()[0]
    pts = st.select("doc_id", F.pmod(S.hash60("chunk:", F.col("doc_id")), F.lit(total)).alias("i"))
    r = S.range_lookup(pts, "doc_id", "i", man, "prev_cutoff", "cutoff")
    return r.select("doc_id", "i", F.col("source").alias("shard"),
                    F.pmod(F.col("i") - F.col("prev_cutoff"), F.col("chunk_count")).alias("local_offset"))


@query("window_pad_wrap", sql=f"""
WITH {STORE_SQL},
head AS (SELECT list(t ORDER BY g) AS h FROM tok WHERE g < {REQ}),
spill AS (SELECT s.doc_id, list(tok.t ORDER BY tok.g) AS w
          FROM store s, tot JOIN tok ON tok.g >= s.start AND tok.g < s.start + {REQ}
          WHERE s.start + {REQ} <= total GROUP BY s.doc_id)
SELECT s.doc_id,
       array_to_string(CASE WHEN s.start + {REQ} <= total THEN sp.w
                            ELSE list_concat(s.cp, list_slice(head.h, 1, greatest({REQ} - s.size, 0))) END, ',') AS tokens,
       least(s.size, {REQ})::BIGINT AS min_len
FROM store s CROSS JOIN tot CROSS JOIN head LEFT JOIN spill sp ON sp.doc_id = s.doc_id""")
def q_window_pad_wrap(spark, sf_dir):
    """``pad(idx, 65)``: spill into the following docs, wrap to the store head
    only past the end of the stream (Y19, Q9)."""
    r = S.pad_spill(_store(spark, sf_dir), REQ)
    return r.select("doc_id", T.join_ints("tokens").alias("tokens"), F.col("min_len").cast("long"))


@query("random_crop", sql=f"""
WITH {STORE_SQL},
rq AS (SELECT doc_id, (('0x' || substr(md5('crop:' || doc_id::VARCHAR), 1, 15))::BIGINT % (total - {REQ} + 1))::BIGINT
              AS "offset" FROM store, tot)
SELECT rq.doc_id, rq."offset", array_to_string(list(tok.t ORDER BY tok.g), ',') AS tokens
FROM rq JOIN tok ON tok.g >= rq."offset" AND tok.g < rq."offset" + {REQ} GROUP BY rq.doc_id, rq."offset"
""")
def q_random_crop(spark, sf_dir):
    """Crop of ``ctx_len + 1`` tokens at a hash-derived offset of the stream."""
    st = _store(spark, sf_dir)
    total = st.offsets.agg(F.sum("size")).first()[0]
    req = st.offsets.select("doc_id", F.pmod(S.hash60("crop:", F.col("doc_id")), F.lit(total - REQ + 1)).alias("offset"))
    r = S.read_windows(st, req, "doc_id", "offset", REQ, "w")
    return r.select("doc_id", "offset", T.join_ints("w").alias("tokens"))


@query("zip_ids_labels", sql=f"""
WITH t AS (SELECT doc_id, {cp_sql('text')} AS ids FROM documents),
a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, ids FROM t)
SELECT idx::BIGINT AS idx, len(ids)::BIGINT AS n, md5(array_to_string(ids, ',')) AS input_ids_md5,
       md5(array_to_string(CASE WHEN len(ids) = 0 THEN [] ELSE list_concat(list_slice(ids, 2, len(ids)), [0]) END, ',')) AS labels_md5,
       len(list_filter(ids, lambda x: x <> 0))::BIGINT AS n_attend FROM a""")
def q_zip_ids_labels(spark, sf_dir):
    """Two separately stored tables (ids, labels) of whole documents zipped by row
    position, after a check that they are of equal shape (S17, J1)."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    order = ["doc_id", F.xxhash64("text")]           # ids may repeat: both tables in one order
    ids = global_index(d, order).select("idx", T.codepoints("text").alias("ids"))
    labs = global_index(d, order).select("idx", T.shift_left(T.codepoints("text"), 0).alias("labels"))
    z = C.zip_rows(ids, labs, "idx", "ids", "labels")
    return z.select("idx", F.size("ids").cast("long").alias("n"), T.digest_ints("ids").alias("input_ids_md5"),
                    T.digest_ints("labels").alias("labels_md5"), T.count_not("ids", 0).cast("long").alias("n_attend"))


@query("parity_mixture", sql="""
WITH o AS (SELECT row_number() OVER (ORDER BY doc_id) AS ii FROM documents),
pile AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents WHERE lang = 'en'),
qa AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents WHERE lang <> 'en'),
np AS (SELECT count(*) AS n FROM pile), nq AS (SELECT count(*) AS n FROM qa),
t AS (SELECT ii, CASE WHEN ii % 2 = 0 THEN 'pile' ELSE 'qa' END AS src,
             CASE WHEN ii % 2 = 0 THEN (ii // 2) % np.n ELSE (ii // 2) % nq.n END AS idx FROM o, np, nq)
SELECT t.ii::BIGINT AS ii, t.src, coalesce(p.doc_id, q.doc_id) AS doc_id FROM t
LEFT JOIN pile p ON t.src = 'pile' AND p.idx = t.idx
LEFT JOIN qa q ON t.src = 'qa' AND q.idx = t.idx""")
def q_parity_mixture(spark, sf_dir):
    """1:1 mixture by parity of the sample number: even from ``pile`` (en),
    odd from ``qa`` (other languages) at row ``ii // 2`` (R6)."""
    d = _docs(spark, sf_dir, "doc_id", "lang")
    samples = global_index(d.select("doc_id"), ["doc_id"], F.col("doc_id")).select((F.col("idx") + 1).alias("ii"))
    src = d.select("doc_id", F.when(F.col("lang") == "en", "pile").otherwise("qa").alias("src"))
    idx = keyed_index(src, ["src"], ["doc_id"], F.col("doc_id"))
    counts = {r["src"]: r["count"] for r in src.groupBy("src").count().collect()}
    want = samples.select(
        "ii", F.when(F.pmod("ii", F.lit(2)) == 0, "pile").otherwise("qa").alias("src"),
        F.when(F.pmod("ii", F.lit(2)) == 0, F.pmod(F.floor(F.col("ii") / 2), F.lit(counts.get("pile", 1))))
         .otherwise(F.pmod(F.floor(F.col("ii") / 2), F.lit(counts.get("qa", 1)))).alias("idx"))
    return want.join(idx, on=["src", "idx"], how="left").select(F.col("ii").cast("long"), "src", "doc_id")


@query("cubic_permutation", sql=f"""
WITH tt AS (SELECT sum(len({cp_sql('text')}))::BIGINT AS t FROM documents),
sl AS (SELECT t // {CTX} AS slots FROM tt),
cand AS (SELECT p FROM sl, range(floor(slots * 0.98)::BIGINT, slots + 1) r(p)
         WHERE p % 3 = 2 AND p::DOUBLE / slots > 0.99
           AND NOT EXISTS (SELECT 1 FROM range(2, 100000) d(f) WHERE f * f <= p AND p % f = 0)),
mp AS (SELECT max(p) AS p, floor(max(p) * (sqrt(5) - 1) / 2)::BIGINT AS f FROM cand),
o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ii FROM documents),
a AS (SELECT doc_id, ii, p, f, ii % p AS a1 FROM o, mp),
b AS (SELECT doc_id, ii, p, f, (((a1 * a1) % p) * a1) % p AS a3 FROM a)
SELECT doc_id, ii::BIGINT AS ii, ((a3 * (f % p)) % p)::BIGINT AS slot,
       (((a3 * (f % p)) % p) * {CTX})::BIGINT AS "offset" FROM b""")
def q_cubic_permutation(spark, sf_dir):
    """Cubic permutation sampler over ``slots = tokens // ctx_len`` with the
    largest magic prime ``p <= slots`` (R2)."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    total = d.agg(F.sum(F.char_length("text"))).first()[0]
    p = S.largest_magic_prime(total // CTX)
    o = global_index(d.select("doc_id"), ["doc_id"], F.col("doc_id")).withColumn("ii", F.col("idx") + 1)
    slot = S.cubic_slot(F.col("ii"), p)
    return o.select("doc_id", F.col("ii").cast("long"), slot.alias("slot"), (slot * CTX).alias("offset"))


@query("record_pick", sql="""
WITH n AS (SELECT count(*) AS n FROM documents),
r AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
q AS (SELECT doc_id, (('0x' || substr(md5('pick:' || doc_id::VARCHAR), 1, 15))::BIGINT % greatest(n - 1, 1))::BIGINT AS i
      FROM documents, n)
SELECT q.doc_id, i AS record, md5(substr(text, 1, length(text) - 1)) AS x_md5, md5(substr(text, 2)) AS y_md5
FROM q JOIN r USING (i)""")
def q_record_pick(spark, sf_dir):
    """For every sample a record drawn with replacement by a hash, as the pair of all its
    tokens but the last and all but the first (R5, W2); digests of whole records."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    numbered = materialize(global_index(d.select("doc_id"), ["doc_id"], name="record"))
    picked = S.pick_records(d.select("doc_id"), S.hash60("pick:", F.col("doc_id")),
                            numbered.withColumnRenamed("doc_id", "picked"), "record", numbered.count())
    return picked.join(d.select(F.col("doc_id").alias("picked"), "text"), "picked").select(
        "doc_id", "record", F.md5(F.expr("substr(text, 1, char_length(text) - 1)").cast("binary")).alias("x_md5"),
        F.md5(F.expr("substr(text, 2)").cast("binary")).alias("y_md5"))


@query("cubic_shift", sql=f"""
WITH tt AS (SELECT sum(length(text))::BIGINT * 10000000 AS t FROM documents),
sl AS (SELECT t // {CTX} AS slots FROM tt),
o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ii FROM documents),
c AS (SELECT p FROM (SELECT slots - r AS p FROM sl, range(0, 3000) AS q(r)) WHERE p % 3 = 2 AND p % 2 = 1
      AND NOT EXISTS (SELECT 1 FROM range(3, 3000, 2) AS d(f) WHERE p % f = 0)),
b AS (SELECT * FROM c ORDER BY p DESC),
mp AS (SELECT p FROM b WHERE list_reduce(list_transform([2, 3, 5, 7, 11, 13, 17], lambda a: list_reduce(
         [{{'x': a::HUGEINT, 'r': 1::HUGEINT, 'e': (p - 1)::HUGEINT}}] || list_transform(range(62),
            lambda i: {{'x': 0::HUGEINT, 'r': 0::HUGEINT, 'e': 0::HUGEINT}}),
         lambda s, t: {{'x': (s.x * s.x) % p, 'r': CASE WHEN s.e % 2 = 1 THEN (s.r * s.x) % p ELSE s.r END, 'e': s.e // 2}}).r = 1),
         lambda u, v: u AND v) ORDER BY p DESC LIMIT 1),
f AS (SELECT p::HUGEINT AS p, floor(p * ((sqrt(5) - 1) / 2))::HUGEINT AS f FROM mp)
SELECT doc_id, ii::BIGINT AS ii, (((((((ii % p) * (ii % p)) % p) * (ii % p)) % p) * (f % p)) % p * {CTX} + 7)::BIGINT AS "offset"
FROM o, f""")
def q_cubic_shift(spark, sf_dir):
    """Cubic sample positions in a store ten million times as long, so that there are
    about 10^12 slots and more, moved on by seven tokens (R2)."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    total = d.agg(F.sum(F.char_length("text"))).first()[0] * 10_000_000
    p = S.largest_magic_prime(total // CTX)
    o = global_index(d.select("doc_id"), ["doc_id"]).withColumn("ii", F.col("idx") + 1)
    return o.select("doc_id", F.col("ii").cast("long"), S.cubic_position(F.col("ii"), p, CTX, 7).alias("offset"))


@query("token_store_scan", sql=f"""
SELECT len(cp)::BIGINT AS n_tokens, md5(array_to_string(cp, ',')) AS tokens_md5
FROM (SELECT {cp_sql('text')} AS cp FROM documents)""")
def q_token_store_scan(spark, sf_dir):
    """All documents written as an indexed token store, in two appends, and scanned back
    by ranges of items (S12, S13)."""
    TS.register(spark)
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", T.codepoints("text").alias("tokens"))
    path = scratch_path(spark, "tokenstore")
    for part in (0, 1):
        d.where(F.pmod("doc_id", F.lit(2)) == part).select("tokens").write.format("tokenstore").mode("append") \
            .option("dtype", "int32").save(path)
    back = spark.read.format("tokenstore").load(path)
    return back.select(F.size("tokens").cast("long").alias("n_tokens"), F.md5(T.join_ints("tokens").cast("binary")).alias("tokens_md5"))
