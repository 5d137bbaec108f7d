"""Run metrics and ordered-sequence operators on ``events``.

``user_id`` is a training run (or a session / request source), ``step`` is the
0-based position in ``(ts, event_id)`` order inside it and ``value`` is the
step's loss.  Steps come from the skew-safe keyed index.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import micros

from ..operators import sequence as SQ
from ..operators.ordered import global_index
from ..session import scratch_path
from ..sources.tables import read_table
from .registry import query

R = 6
TOKENS_PER_STEP = 2048 * 36          # max_seq_length * real_bsz
EPOCH_BEGIN, EPOCH_STEPS = 2, 1000
EVERY_N, SKIP = 10, 2


def _events(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return SQ.number_steps(ev, ["user_id"], ["ts", "event_id"], micros("ts"))


def sci(c):
    """7 significant digits as text, the same in both engines."""
    return F.format_string("%.6e", c)


STEPS = ("(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, "
         "(props::JSON->>'k')::INTEGER AS k FROM events)")


@query("throughput", sql=f"""
WITH o AS (SELECT user_id, step, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY step) AS pts FROM {STEPS})
SELECT user_id, step::BIGINT AS step, strftime(ts, '%Y-%m-%d-%H-%M-%S') AS stamp,
       round(CASE WHEN epoch_us(ts) - epoch_us(pts) > 0
                  THEN {float(TOKENS_PER_STEP)}::DOUBLE / ((epoch_us(ts) - epoch_us(pts)) / 1e6) / 1000.0::DOUBLE END, 6)
         AS kt_s FROM o""")
def q_throughput(spark, sf_dir):
    """kt/s between consecutive steps of a run and the step's time stamp."""
    d = SQ.throughput(_events(spark, sf_dir), ["user_id"], "step", "ts", TOKENS_PER_STEP)
    return d.select("user_id", "step", F.date_format("ts", "yyyy-MM-dd-HH-mm-ss").alias("stamp"),
                    F.round("kt_s", R).alias("kt_s"))


@query("gtokens", sql=f"""
SELECT user_id, step::BIGINT AS step, (step + {EPOCH_BEGIN * EPOCH_STEPS})::BIGINT AS real_step,
       round((step + {EPOCH_BEGIN * EPOCH_STEPS}) * {TOKENS_PER_STEP} / 1e9, 6) AS gtokens FROM {STEPS}""")
def q_gtokens(spark, sf_dir):
    """Cumulative Gtokens with epoch_begin 2 and 1000 steps per epoch."""
    d = _events(spark, sf_dir)
    return d.select("user_id", "step", (F.col("step") + EPOCH_BEGIN * EPOCH_STEPS).alias("real_step"),
                    F.round(SQ.gtokens(F.col("step"), EPOCH_BEGIN, EPOCH_STEPS, TOKENS_PER_STEP), R).alias("gtokens"))


@query("running_epoch_loss", sql=f"""
SELECT user_id, step::BIGINT AS step, strftime(ts::DATE, '%Y-%m-%d') AS epoch,
       round(avg(value) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_loss FROM {STEPS}""")
def q_running_epoch_loss(spark, sf_dir):
    """Mean loss since the start of the epoch (epoch = calendar day)."""
    d = _events(spark, sf_dir).withColumn("epoch", F.date_format("ts", "yyyy-MM-dd"))
    d = SQ.running_mean(d, ["user_id", "epoch"], ["ts", "event_id"], micros("ts"), "value", "rl")
    return d.select("user_id", "step", "epoch", F.round("rl", R).alias("running_loss"))


@query("epoch_loss", sql="""
WITH g AS (SELECT user_id, strftime(ts::DATE, '%Y-%m-%d') AS epoch, round(avg(value), 6) AS loss, count(*) AS n_steps
           FROM events GROUP BY ALL)
SELECT user_id, epoch, loss, printf('%.6e', exp(loss)) AS ppl, n_steps FROM g""")
def q_epoch_loss(spark, sf_dir):
    """Epoch mean loss = sum / count per (run, day) and its perplexity."""
    ev = read_table(spark, sf_dir, "events", ["user_id", "ts", "value"])
    g = (ev.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("epoch"))
         .agg(F.round(F.avg("value"), R).alias("loss"), F.count(F.lit(1)).alias("n_steps")))
    return g.select("user_id", "epoch", "loss", sci(F.exp("loss")).alias("ppl"), "n_steps")


@query("val_mean", sql=f"""
WITH o AS (SELECT user_id, event_type, value,
                  sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY step
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vid FROM {STEPS})
SELECT user_id, vid::BIGINT AS validation_id, round(avg(value), 6) AS val_loss, count(*) AS n_batches
FROM o WHERE event_type = 'view' GROUP BY user_id, vid""")
def q_val_mean(spark, sf_dir):
    """Mean loss of each validation pass (a run of ``view`` batches between
    training steps), reset per pass (A8)."""
    ev = read_table(spark, sf_dir, "events")
    d = SQ.segment_ids(ev, ["user_id"], ["ts", "event_id"], micros("ts"),
                       F.col("event_type") != "view", "validation_id")
    d = d.where(F.col("event_type") == "view")
    return d.groupBy("user_id", "validation_id").agg(F.round(F.avg("value"), R).alias("val_loss"),
                                                      F.count(F.lit(1)).alias("n_batches"))


@query("metrics_every_n", sql=f"""
SELECT user_id, step::BIGINT AS step, round(value, 6) AS loss FROM {STEPS}
WHERE step > {SKIP} AND step % {EVERY_N} = 0""")
def q_metrics_every_n(spark, sf_dir):
    """Skip the first batches, then act every 10th step."""
    d = _events(spark, sf_dir)
    d = d.where((F.col("step") > SKIP) & (F.pmod("step", F.lit(EVERY_N)) == 0))
    return d.select("user_id", "step", F.round("value", R).alias("loss"))


@query("topk_checkpoints", sql=f"""
WITH c AS (SELECT user_id, step FROM {STEPS} WHERE step > 0 AND step % {EVERY_N} = 0),
t AS (SELECT user_id, step, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS rk FROM c)
SELECT user_id, step::BIGINT AS step, 'top' AS kind FROM t WHERE rk <= 2
UNION ALL
SELECT user_id, max(step)::BIGINT, 'last' FROM {STEPS} GROUP BY user_id""")
def q_topk_checkpoints(spark, sf_dir):
    """Checkpoints every 10 steps; keep the 2 newest by step, plus ``last`` (K3)."""
    d = _events(spark, sf_dir).select("user_id", "step")
    ck = d.where((F.col("step") > 0) & (F.pmod("step", F.lit(EVERY_N)) == 0))
    top = SQ.top_k_per_key(ck, ["user_id"], [F.col("step").desc()], 2).select(
        "user_id", "step", F.lit("top").alias("kind"))
    last = d.groupBy("user_id").agg(F.max("step").alias("step")).select("user_id", "step", F.lit("last").alias("kind"))
    return top.unionByName(last)


@query("top_ops", sql="""
WITH o AS (SELECT event_type || '#' || ((props::JSON->>'k')::INTEGER % 4)::VARCHAR AS op, value FROM events),
g AS (SELECT op, round(sum(value), 6) AS total_time, count(*) AS n_calls FROM o GROUP BY op)
SELECT op, total_time, n_calls, row_number() OVER (ORDER BY total_time DESC, op) AS rank FROM g
ORDER BY total_time DESC, op LIMIT 10""")
def q_top_ops(spark, sf_dir):
    """Top 10 operations by total time (K4): a partial aggregate, then a
    top-k that never sorts the whole table."""
    ev = read_table(spark, sf_dir, "events", ["event_type", "value", "props"])
    k = F.get_json_object("props", "$.k").cast("int")
    g = (ev.groupBy(F.concat("event_type", F.lit("#"), F.pmod(k, F.lit(4)).cast("string")).alias("op"))
         .agg(F.round(F.sum("value"), R).alias("total_time"), F.count(F.lit(1)).alias("n_calls")))
    top = g.orderBy(F.col("total_time").desc(), "op").limit(10)
    from pyspark.sql import Window
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("total_time").desc(), "op")).cast("long"))


@query("train_log_parse", sql="""
WITH d AS (SELECT user_id, strftime(ts::DATE, '%Y-%m-%d') AS day, value FROM events),
g AS (SELECT user_id, day, round(avg(value), 6) AS loss FROM d GROUP BY ALL),
e AS (SELECT user_id, user_id // 8 AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS epoch, loss FROM g),
r AS (SELECT user_id, dense_rank() OVER (PARTITION BY user_id // 8 ORDER BY user_id) - 1 AS run_no FROM (SELECT DISTINCT user_id FROM events))
SELECT file_id::BIGINT AS file_id, run_no::BIGINT AS run_no, epoch::BIGINT AS epoch, loss FROM e JOIN r USING (user_id)""")
def q_train_log_parse(spark, sf_dir):
    """Epoch-log scan (S24): logs in the reference's text format (``NEW RUN``
    header, args line, ``epoch loss ppl  epoch`` lines; several runs appended
    per file) are rendered from the per-day losses of ``events``, written as
    text files of eight runs, then parsed back: run number = running count of
    headers inside each file."""
    from ..sources.logs import parse_epoch_log, render_epoch_log
    ev = read_table(spark, sf_dir, "events", ["user_id", "ts", "value"])
    path = scratch_path(spark, "trainlog")
    render_epoch_log(ev, path)
    p = parse_epoch_log(spark, path)
    return p.select(F.col("file_id").cast("long"), "run_no", "epoch", "loss")


@query("gated_running_sum", sql=f"""
WITH RECURSIVE o AS (SELECT user_id, step, value FROM {STEPS}),
r AS (SELECT user_id, step, value AS h FROM o WHERE step = 0
      UNION ALL
      SELECT o.user_id, o.step, exp(-0.01) * r.h + o.value FROM r JOIN o ON o.user_id = r.user_id AND o.step = r.step + 1)
SELECT user_id, step::BIGINT AS step, round(h, 6) AS h FROM r""")
def q_gated_running_sum(spark, sf_dir):
    """``h_t = exp(g) h_(t-1) + x_t`` with g = -0.01 over each run."""
    d = _events(spark, sf_dir).withColumn("g", F.lit(-0.01))
    d = SQ.gated_running_sum(d, ["user_id"], "step", "value", "g", "h")
    return d.select("user_id", "step", F.round("h", R).alias("h"))


@query("causal_weighted_avg", sql=f"""
WITH o AS (SELECT user_id, step, CASE WHEN event_type <> 'error' THEN value ELSE 0.0 END AS x FROM {STEPS})
SELECT user_id, step::BIGINT AS step,
       round(0.5 * x + 0.3 * lag(x, 1, 0.0) OVER w + 0.2 * lag(x, 2, 0.0) OVER w, 6) AS y
FROM o WINDOW w AS (PARTITION BY user_id ORDER BY step)""")
def q_causal_weighted_avg(spark, sf_dir):
    """Causal short convolution, weights 0.5, 0.3, 0.2, inputs of ``error``
    steps zeroed by the mask (W16)."""
    d = _events(spark, sf_dir)
    d = SQ.causal_conv(d, ["user_id"], "step", "value", [0.5, 0.3, 0.2], "y", F.col("event_type") != "error")
    return d.select("user_id", "step", F.round("y", R).alias("y"))


@query("lag_delta", sql=f"""
SELECT user_id, step::BIGINT AS step,
       round(lag(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY step) - value, 6) AS delta FROM {STEPS}""")
def q_lag_delta(spark, sf_dir):
    """Token shift: previous value minus current, zero before the first."""
    d = SQ.lag_delta(_events(spark, sf_dir), ["user_id"], "step", "value", "delta")
    return d.select("user_id", "step", F.round("delta", R).alias("delta"))


@query("chunked_cumsum", sql=f"""
SELECT user_id, step::BIGINT AS step,
       round(sum(value) OVER (PARTITION BY user_id, step // 16 ORDER BY step), 6) AS csum FROM {STEPS}""")
def q_chunked_cumsum(spark, sf_dir):
    """Cumulative sum restarting every 16 steps."""
    d = SQ.chunk_local_cumsum(_events(spark, sf_dir), ["user_id"], "step", "value", 16, "csum")
    return d.select("user_id", "step", F.round("csum", R).alias("csum"))


@query("suffix_sum", sql=f"""
SELECT user_id, step::BIGINT AS step,
       round(sum(value) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6)
         AS ssum FROM {STEPS}""")
def q_suffix_sum(spark, sf_dir):
    """Reversed cumulative sum to the end of the run."""
    ev = read_table(spark, sf_dir, "events")
    d = SQ.number_steps(ev, ["user_id"], ["ts", "event_id"], micros("ts"))
    d = SQ.suffix_sum(d, ["user_id"], ["ts", "event_id"], micros("ts"), "value", "ssum")
    return d.select("user_id", "step", F.round("ssum", R).alias("ssum"))


@query("running_logsumexp", sql=f"""
WITH o AS (SELECT user_id, step, value FROM {STEPS}),
m AS (SELECT a.user_id, a.step, max(b.value) AS mx FROM o a JOIN o b ON a.user_id = b.user_id AND b.step <= a.step
      GROUP BY a.user_id, a.step),
s AS (SELECT m.user_id, m.step, m.mx + ln(sum(exp(b.value - m.mx))) AS lse
      FROM m JOIN o b ON m.user_id = b.user_id AND b.step <= m.step GROUP BY m.user_id, m.step, m.mx)
SELECT user_id, step::BIGINT AS step, round(lse, 6) AS lse FROM s""")
def q_running_logsumexp(spark, sf_dir):
    """Stable running log-sum-exp of the loss over each run."""
    d = SQ.running_logsumexp(_events(spark, sf_dir), ["user_id"], "step", "value", "lse")
    return d.select("user_id", "step", F.round("lse", R).alias("lse"))


@query("session_segments", sql=f"""
WITH o AS (SELECT user_id, step, event_type,
                  sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY step
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM {STEPS})
SELECT user_id, step::BIGINT AS step, segment::BIGINT AS segment,
       sum(CASE WHEN event_type <> 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, segment ORDER BY step
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS history_len FROM o""")
def q_session_segments(spark, sf_dir):
    """Session history cut at every ``signup`` (the UI's clear); the history
    length restarts at zero in each segment (W18, batch twin of ST1)."""
    d = _events(spark, sf_dir)
    d = SQ.segment_ids(d, ["user_id"], ["ts", "event_id"], micros("ts"),
                       F.col("event_type") == "signup", "segment")
    from ..operators.ordered import keyed_scan
    d = keyed_scan(d, ["user_id", "segment"], ["ts", "event_id"], micros("ts"),
                   sums={"history_len": F.when(F.col("event_type") != "signup", 1).otherwise(0).cast("long")},
                   index_col=None)
    return d.select("user_id", "step", "segment", "history_len")


@query("latest_state", sql=f"""
WITH o AS (SELECT user_id, event_type, value, k,
                  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM {STEPS})
SELECT user_id, event_type AS layer, round(max(value) FILTER (WHERE rn = 1), 6) AS state,
       sum(k)::BIGINT AS tokens, count(*) AS n_updates FROM o GROUP BY user_id, event_type""")
def q_latest_state(spark, sf_dir):
    """Recurrent-layer cache per (session, layer): the newest state
    overwrites, token counts add up (W19, batch twin of ST4)."""
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    g = ev.groupBy("user_id", F.col("event_type").alias("layer")).agg(
        F.round(F.max_by("value", F.struct("ts", "event_id")), R).alias("state"),
        F.sum(k).alias("tokens"), F.count(F.lit(1)).alias("n_updates"))
    return g


@query("attention_cache", sql=f"""
WITH o AS (SELECT user_id, event_type, value, step,
                  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS position FROM {STEPS})
SELECT user_id, event_type AS layer, position::BIGINT AS position, round(value, 6) AS value,
       count(*) OVER (PARTITION BY user_id, event_type) AS n_cached FROM o""")
def q_attention_cache(spark, sf_dir):
    """Attention-layer cache per (session, layer): every update is appended at the next
    position and none is overwritten (W19); one row a position, so that a long session is
    no single row."""
    ev = read_table(spark, sf_dir, "events", ["user_id", "event_type", "ts", "event_id", "value"])
    c = SQ.append_cache(ev, ["user_id", "event_type"], ["ts", "event_id"])
    return c.select("user_id", F.col("event_type").alias("layer"), "position", F.round("value", R).alias("value"), "n_cached")


@query("state_footprint", sql="""
SELECT user_id, count(*) AS n_entries, count(DISTINCT event_type) AS n_layers,
       sum((props::JSON->>'k')::INTEGER)::BIGINT AS memory FROM events GROUP BY user_id""")
def q_state_footprint(spark, sf_dir):
    """Cache footprint per session: entries, layers and summed element count (A10)."""
    ev = read_table(spark, sf_dir, "events", ["user_id", "event_type", "props"])
    return ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_entries"),
                                     F.count_distinct("event_type").alias("n_layers"),
                                     F.sum(F.get_json_object("props", "$.k").cast("long")).alias("memory"))


@query("count_window_ratio", sql="""
WITH o AS (SELECT value, (props::JSON->>'k')::INTEGER AS k,
                  row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM events),
w AS (SELECT rn // 50 AS window_id, value, k FROM o),
g AS (SELECT window_id, count(*) AS n, round(avg(value), 6) AS avg_transfer, round(avg(k), 6) AS avg_infer,
             round(sum(value) / sum(k), 6) AS ratio FROM w GROUP BY window_id)
SELECT window_id::BIGINT AS window_id, avg_transfer, avg_infer, ratio FROM g WHERE n = 50""")
def q_count_window_ratio(spark, sf_dir):
    """Transfer vs inference time means and their ratio every 50 requests of
    the whole stream; a partial last window is not emitted (A12, A13)."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "value", "props"])
    ev = ev.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    d = global_index(ev, ["ts", "event_id"], micros("ts"), "rn")
    g = d.groupBy(SQ.count_windows(d, "rn", 50).alias("window_id")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), R).alias("avg_transfer"),
        F.round(F.avg("k"), R).alias("avg_infer"), F.round(F.sum("value") / F.sum("k"), R).alias("ratio"))
    return g.where(F.col("n") == 50).drop("n")


@query("hourly_metrics", sql="""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n,
       round(avg(value), 6) AS avg_value FROM events GROUP BY ALL""")
def q_hourly_metrics(spark, sf_dir):
    """Tumbling one-hour windows of the metric stream (batch twin of ST7)."""
    ev = read_table(spark, sf_dir, "events", ["ts", "event_type", "value"])
    g = ev.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), R).alias("avg_value"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "avg_value")


@query("config_defaults", sql="""
SELECT event_id, coalesce((props::JSON->>'k')::BIGINT, 0) AS k, coalesce((props::JSON->>'lr')::BIGINT, 3) AS lr
FROM events""")
def q_config_defaults(spark, sf_dir):
    """Optional config values with defaults from a JSON map column."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "props"])
    m = F.from_json("props", "map<string,bigint>")
    return ev.select("event_id", F.coalesce(F.try_element_at(m, F.lit("k")), F.lit(0).cast("long")).alias("k"),
                     F.coalesce(F.try_element_at(m, F.lit("lr")), F.lit(3).cast("long")).alias("lr"))


@query("ttl_dedup", sql="""
WITH RECURSIVE t AS (SELECT event_type AS k, epoch_us(ts) AS t, min(event_id) AS rep FROM events GROUP BY ALL),
nx AS MATERIALIZED (SELECT a.k, a.t, b.t AS nt FROM (SELECT k, t, t + 300000000 AS due FROM t) a
       ASOF JOIN t b ON a.k = b.k AND a.due <= b.t),
chain AS (SELECT k, min(t) AS t FROM t GROUP BY k
          UNION ALL
          SELECT nx.k, nx.nt FROM chain JOIN nx ON nx.k = chain.k AND nx.t = chain.t)
SELECT e.event_id, e.event_type, NOT (c.t IS NOT NULL AND e.event_id = t.rep) AS cached
FROM events e JOIN t ON t.k = e.event_type AND t.t = epoch_us(e.ts) LEFT JOIN chain c ON c.k = t.k AND c.t = t.t""")
def q_ttl_dedup(spark, sf_dir):
    """Prompt cache with a 300 s TTL from insertion, keyed by event type:
    which requests are served from the cache (ST2 batch twin, Q11)."""
    from ..operators.dedup import ttl_cache_hits
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type"])
    r = ttl_cache_hits(ev, "event_type", micros("ts"), "event_id", 300_000_000)
    return r.select("event_id", "event_type", "cached")
