"""Score arrays, losses and vector operators on ``embeddings``.

Each row's 64 floats are one position's scores over a 64-way vocabulary and
``label`` is the target.  Teacher = row ``vec_id``, student = row
``vec_id + 1``; a position is valid when ``label < 7`` (else the label is the
ignore index -100); batch = ``vec_id div 8``.  Doubles are rounded to 6 places.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import losses as L
from ..sources.tables import read_table
from .registry import query

R = 6
VALID_BELOW = 7
KL_WEIGHT, CE_WEIGHT = 0.1, 1.0      # configs/..stage_2: kl_weight 0.1, ce_weight 1
SMOOTH, SCALE, ZCOEF = 0.1, 2.0, 1e-4
TOP_P, TEMP = 0.9, 0.7
LAYERS = [1, 3, 5]


def _emb(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", L.as_double("embedding").alias("x"),
                    F.when(F.col("label") < VALID_BELOW, F.col("label")).otherwise(F.lit(L.IGNORE)).alias("y"))


def _pairs(spark, sf_dir):
    """Teacher row t joined with student row t + 1 on the position key."""
    e = _emb(spark, sf_dir)
    t = e.select("vec_id", F.col("x").alias("xt"), "y")
    s = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("xs"))
    return t.join(s, "vec_id").withColumn("batch", F.floor(F.col("vec_id") / 8).cast("long"))


X = "(SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, label, " \
    "CASE WHEN label < 7 THEN label ELSE -100 END AS y FROM embeddings)"
LSE = "(list_max({a}) + ln(list_sum(list_transform({a}, lambda v: exp(v - list_max({a}))))))"


def lse(a: str) -> str:
    return LSE.format(a=a)


def kl_sql(t: str, s: str) -> str:
    return (f"list_sum(list_transform(range(1, len({t}) + 1), lambda i: "
            f"exp({t}[i] - {lse(t)}) * (({t}[i] - {lse(t)}) - ({s}[i] - {lse(s)}))))")


PAIRS = f"""(SELECT t.vec_id, t.x AS xt, s.x AS xs, t.y, t.vec_id // 8 AS batch
             FROM {X} t JOIN {X} s ON s.vec_id = t.vec_id + 1)"""


@query("softmax_rows", sql=f"""
WITH l AS (SELECT vec_id, x, {lse('x')} AS lse FROM {X}),
u AS (SELECT vec_id, lse, unnest(x) AS v, unnest(range(len(x))) AS i FROM l)
SELECT vec_id, i::BIGINT AS i, round(exp(v - lse), 6) AS p, round(v - lse, 6) AS logp FROM u""")
def q_softmax_rows(spark, sf_dir):
    """Softmax and log-softmax of every score row (M1)."""
    e = _emb(spark, sf_dir).withColumn("lse", L.logsumexp("x"))
    e = e.select("vec_id", F.posexplode(F.arrays_zip(L.softmax("x", F.col("lse")).alias("p"),
                                                     L.log_softmax("x", F.col("lse")).alias("lp"))).alias("i", "z"))
    return e.select("vec_id", F.col("i").cast("long"), F.round("z.p", R).alias("p"), F.round("z.lp", R).alias("logp"))


@query("cross_entropy", sql=f"""
WITH c AS (SELECT vec_id // 8 AS batch, CASE WHEN y <> -100 THEN {lse('x')} - x[y + 1] END AS ce FROM {X})
SELECT batch, round(avg(ce), 6) AS ce, count(ce) AS n_valid FROM c GROUP BY batch""")
def q_cross_entropy(spark, sf_dir):
    """Cross entropy per position, ignore -100, mean over valid positions per batch (M2)."""
    e = _emb(spark, sf_dir).withColumn("ce", L.cross_entropy("x", "y"))
    return (e.groupBy(F.floor(F.col("vec_id") / 8).cast("long").alias("batch"))
            .agg(F.round(F.avg("ce"), R).alias("ce"), F.count("ce").alias("n_valid")))


@query("cross_entropy_smooth", sql=f"""
WITH z AS (SELECT vec_id, list_transform(x, lambda v: v * {SCALE}) AS z, y FROM {X}),
c AS (SELECT vec_id // 8 AS batch,
             CASE WHEN y <> -100 THEN {lse('z')} - {SMOOTH} * list_sum(z) / len(z) - {1 - SMOOTH} * z[y + 1]
                                      + {ZCOEF} * {lse('z')} * {lse('z')} END AS loss,
             CASE WHEN y <> -100 THEN {ZCOEF} * {lse('z')} * {lse('z')} END AS zl FROM z)
SELECT batch, round(avg(loss), 6) AS loss, round(avg(zl), 6) AS z_loss FROM c GROUP BY batch""")
def q_cross_entropy_smooth(spark, sf_dir):
    """Cross entropy with label smoothing 0.1, logit scale 2 and z-loss 1e-4 (M3)."""
    e = _emb(spark, sf_dir)
    loss, zl = L.cross_entropy_smooth("x", "y", SMOOTH, SCALE, ZCOEF)
    e = e.select("vec_id", loss.alias("loss"), zl.alias("zl"))
    return (e.groupBy(F.floor(F.col("vec_id") / 8).cast("long").alias("batch"))
            .agg(F.round(F.avg("loss"), R).alias("loss"), F.round(F.avg("zl"), R).alias("z_loss")))


@query("blocked_logsumexp", sql=f"SELECT vec_id, round({lse('x')}, 6) AS lse FROM {X}")
def q_blocked_logsumexp(spark, sf_dir):
    """Logsumexp from per-block (16 classes) partials merged per row (M4)."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    r = L.blocked_logsumexp(e, "vec_id", "i", "v", 16)
    return r.select("vec_id", F.round("lse", R).alias("lse"))


@query("perplexity", sql=f"""
WITH c AS (SELECT batch, CASE WHEN y <> -100 THEN {lse('xt')} - xt[y + 1] END AS ct,
                         CASE WHEN y <> -100 THEN {lse('xs')} - xs[y + 1] END AS cs FROM {PAIRS})
SELECT batch, round(exp(avg(ct)), 6) AS ppl_teacher, round(exp(avg(cs)), 6) AS ppl_student FROM c GROUP BY batch""")
def q_perplexity(spark, sf_dir):
    """``exp(mean CE)`` of teacher and student per batch (M9)."""
    p = _pairs(spark, sf_dir).select("batch", L.cross_entropy("xt", "y").alias("ct"),
                                     L.cross_entropy("xs", "y").alias("cs"))
    return p.groupBy("batch").agg(F.round(F.exp(F.avg("ct")), R).alias("ppl_teacher"),
                                  F.round(F.exp(F.avg("cs")), R).alias("ppl_student"))


@query("argmax_token", sql="""
SELECT vec_id, round(list_max(embedding)::DOUBLE, 6) AS max_val,
       (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS token FROM embeddings""")
def q_argmax_token(spark, sf_dir):
    """Greedy (top-1) token: max score and its first index."""
    e = read_table(spark, sf_dir, "embeddings")
    m, i = L.argmax("embedding")
    return e.select("vec_id", F.round(m.cast("double"), R).alias("max_val"), i.alias("token"))


@query("nucleus_filter", sql=f"""
WITH p AS (SELECT vec_id, list_transform(x, lambda v: exp(v - {lse('x')})) AS p FROM {X}),
s AS (SELECT vec_id, p, list_sort(p, 'DESC') AS srt FROM p),
c AS (SELECT vec_id, p, srt, list_transform(range(1, len(srt) + 1), lambda k: list_sum(list_slice(srt, 1, k))) AS cum FROM s),
f AS (SELECT vec_id, p, srt[coalesce(list_position(list_transform(cum, lambda v: v > {TOP_P}), true), 1)] AS cutoff FROM c),
k AS (SELECT vec_id, list_transform(p, lambda v: CASE WHEN v < cutoff THEN 0.0 ELSE pow(v, {1.0 / TEMP}) END) AS kept FROM f),
u AS (SELECT vec_id, list_sum(kept) AS tot, unnest(kept) AS q, unnest(range(len(kept))) AS i FROM k)
SELECT vec_id, i::BIGINT AS i, round(q / tot, 6) AS p FROM u WHERE q > 0""")
def q_nucleus_filter(spark, sf_dir):
    """Top-p 0.9 filter with temperature 0.7, renormalised; kept classes only."""
    e = _emb(spark, sf_dir).withColumn("q", L.nucleus("x", TOP_P, TEMP))
    e = e.select("vec_id", F.posexplode("q").alias("i", "p")).where(F.col("p") > 0)
    return e.select("vec_id", F.col("i").cast("long"), F.round("p", R).alias("p"))


@query("l2_normalize", sql=f"""
WITH n AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v)) + 1e-6) AS r FROM {X}),
u AS (SELECT vec_id, r, unnest(x) AS v, unnest(range(len(x))) AS i FROM n)
SELECT vec_id, i::BIGINT AS i, round(v / r, 6) AS v FROM u""")
def q_l2_normalize(spark, sf_dir):
    """``x / sqrt(sum x^2 + 1e-6)`` per vector."""
    e = _emb(spark, sf_dir).select("vec_id", F.posexplode(L.l2_normalize("x")).alias("i", "v"))
    return e.select("vec_id", F.col("i").cast("long"), F.round("v", R).alias("v"))


@query("select_layers", sql=f"""
WITH l AS (SELECT vec_id, x, unnest({LAYERS}) AS layer FROM {X})
SELECT vec_id, layer::BIGINT AS layer,
       round(sqrt(list_sum(list_transform(list_slice(x, layer * 8 + 1, layer * 8 + 8), lambda v: v * v))), 6) AS norm
FROM l""")
def q_select_layers(spark, sf_dir):
    """Layers 1, 3, 5 of each 8 x 8 hidden-state row, as their L2 norms."""
    e = _emb(spark, sf_dir)
    sel = F.transform(F.array(*[F.lit(v) for v in LAYERS]), lambda l: F.struct(
        l.cast("long").alias("layer"),
        F.sqrt(F.aggregate(F.slice("x", l * 8 + 1, 8), F.lit(0.0).cast("double"), lambda s, v: s + v * v)).alias("n")))
    e = e.select("vec_id", F.explode(sel).alias("z"))
    return e.select("vec_id", "z.layer", F.round("z.n", R).alias("norm"))


@query("kl_masked", sql=f"""
WITH k AS (SELECT batch, y, {kl_sql('xt', 'xs')} AS kl FROM {PAIRS})
SELECT batch, round(sum(kl) FILTER (WHERE y <> -100) / nullif(count(*) FILTER (WHERE y <> -100), 0), 6) AS kl,
       count(*) FILTER (WHERE y <> -100) AS n_valid FROM k GROUP BY batch""")
def q_kl_masked(spark, sf_dir):
    """Masked KL(teacher || student) / number of valid positions per batch (M5)."""
    p = _pairs(spark, sf_dir).withColumn("kl", L.kl_div("xt", "xs")).withColumn("v", F.col("y") != L.IGNORE)
    return p.groupBy("batch").agg(
        F.round(F.try_divide(F.sum(F.when(F.col("v"), F.col("kl"))), F.count_if("v").cast("double")), R).alias("kl"),
        F.count_if("v").alias("n_valid"))


@query("kl_batchmean", sql=f"""
WITH k AS (SELECT batch, vec_id // 2 AS sample_id, {kl_sql('xt', 'xs')} AS kl FROM {PAIRS})
SELECT batch, round(sum(kl) / count(DISTINCT sample_id), 6) AS kl FROM k GROUP BY batch""")
def q_kl_batchmean(spark, sf_dir):
    """Unmasked KL with ``batchmean``: sum over positions / samples, where a
    sample is ``vec_id div 2`` (M6)."""
    p = _pairs(spark, sf_dir).withColumn("kl", L.kl_div("xt", "xs"))
    return p.groupBy("batch").agg(
        F.round(F.sum("kl") / F.count_distinct(F.floor(F.col("vec_id") / 2)), R).alias("kl"))


@query("combined_loss", sql=f"""
WITH k AS (SELECT batch, y, {kl_sql('xt', 'xs')} AS kl, CASE WHEN y <> -100 THEN {lse('xs')} - xs[y + 1] END AS ce
           FROM {PAIRS})
SELECT batch, round({KL_WEIGHT} * (sum(kl) FILTER (WHERE y <> -100) / nullif(count(*) FILTER (WHERE y <> -100), 0))
                    + {CE_WEIGHT} * avg(ce), 6) AS loss FROM k GROUP BY batch""")
def q_combined_loss(spark, sf_dir):
    """``kl_weight * KL + ce_weight * student CE`` per batch (M7)."""
    p = (_pairs(spark, sf_dir).withColumn("kl", L.kl_div("xt", "xs"))
         .withColumn("ce", L.cross_entropy("xs", "y")).withColumn("v", F.col("y") != L.IGNORE))
    kl = F.try_divide(F.sum(F.when(F.col("v"), F.col("kl"))), F.count_if("v").cast("double"))
    return p.groupBy("batch").agg(F.round(F.lit(KL_WEIGHT) * kl + F.lit(CE_WEIGHT) * F.avg("ce"), R).alias("loss"))


@query("hidden_mse", sql=f"""
WITH t AS (SELECT vec_id, y, unnest(x) AS v, unnest(range(64)) AS i FROM {X}),
s AS (SELECT vec_id - 1 AS vec_id, unnest(x) AS v, unnest(range(64)) AS i FROM {X}),
j AS (SELECT t.vec_id // 8 AS batch, t.vec_id, i // 8 AS layer, i % 8 AS h,
             CASE WHEN t.y <> -100 THEN (s.v - t.v) * (s.v - t.v) ELSE 0 END AS se
      FROM t JOIN s USING (vec_id, i))
SELECT batch, round(sum(se) / count(*), 6) AS mse FROM j GROUP BY batch""")
def q_hidden_mse(spark, sf_dir):
    """Masked hidden-state MSE: teacher and student state vectors of all layers aligned
    on the position by an equi-join; masked positions count as 0 in a mean over all
    elements (M8, J6)."""
    m = L.hidden_mse(_pairs(spark, sf_dir), ["batch"], "vec_id", "xt", "xs", F.col("y") != L.IGNORE)
    return m.select("batch", F.round("mse", R).alias("mse"))


@query("hidden_mse_broadcast", sql=f"""
WITH d AS (SELECT batch, vec_id % 4 AS t, y <> -100 AS ok,
                  list_sum(list_transform(list_zip(xt, xs), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS se FROM {PAIRS}),
p AS (SELECT batch, t, sum(se) AS se, count(*) * 64 AS n, count(*) FILTER (ok) AS w, count(*) AS b FROM d GROUP BY batch, t)
SELECT batch, round(sum(se * w) / (max(b) * sum(n)), 6) AS mse FROM p GROUP BY batch""")
def q_hidden_mse_broadcast(spark, sf_dir):
    """The same with every sample's mask on every sample's states, as the reference's
    broadcast does (M8, Q10): a batch is two samples of four positions."""
    p = _pairs(spark, sf_dir).withColumn("t", F.pmod("vec_id", F.lit(4)))
    m = L.hidden_mse(p, ["batch"], "t", "xt", "xs", F.col("y") != L.IGNORE, broadcast_masks=True)
    return m.select("batch", F.round("mse", R).alias("mse"))


@query("masked_mean_loss", sql=f"""
WITH c AS (SELECT batch, CASE WHEN y <> -100 THEN 1.0 ELSE 0.0 END AS m,
                  CASE WHEN y <> -100 THEN {lse('xs')} - xs[y + 1] ELSE 0.0 END AS l FROM {PAIRS})
SELECT batch, round(sum(l * m) / nullif(sum(m), 0), 6) AS loss FROM c GROUP BY batch""")
def q_masked_mean_loss(spark, sf_dir):
    """``sum(loss * mask) / sum(mask)`` of the student's per-position CE."""
    p = _pairs(spark, sf_dir)
    m = F.when(F.col("y") != L.IGNORE, F.lit(1.0)).otherwise(F.lit(0.0))
    loss = F.coalesce(L.cross_entropy("xs", "y"), F.lit(0.0))
    p = p.select("batch", m.alias("m"), loss.alias("l"))
    return p.groupBy("batch").agg(F.round(F.try_divide(F.sum(F.col("l") * F.col("m")), F.sum("m")), R).alias("loss"))


@query("chunked_mean", sql=f"""
WITH c AS (SELECT batch, vec_id // 4 AS chunk, CASE WHEN y <> -100 THEN {lse('xs')} - xs[y + 1] END AS ce FROM {PAIRS}),
k AS (SELECT batch, chunk, avg(ce) AS m, count(*) AS n FROM c GROUP BY batch, chunk)
SELECT batch, round(sum(m * n) FILTER (WHERE m IS NOT NULL) / sum(n) FILTER (WHERE m IS NOT NULL), 6) AS loss
FROM k GROUP BY batch""")
def q_chunked_mean(spark, sf_dir):
    """Per-chunk (4 positions) mean CE merged across chunks, weighted by
    chunk length (A7, Q18)."""
    p = _pairs(spark, sf_dir).withColumn("ce", L.cross_entropy("xs", "y"))
    chunks = (p.groupBy("batch", F.floor(F.col("vec_id") / 4).alias("chunk"))
              .agg(F.avg("ce").alias("m"), F.count(F.lit(1)).alias("n")))
    r = L.chunk_merge_mean(chunks, "batch", "m", "n")
    return r.select("batch", F.round("loss", R).alias("loss"))
