"""Structured Streaming versions of the stateful operators (ST1-ST7).

Sources are file streams (new parquet / JSON files in a directory, e.g. the
metric or request logs a trainer or teacher server appends), so nothing opens
a port.  Each job has a batch twin in :mod:`..plans`; the tests run a job with
``trigger(availableNow=True)`` over time-ordered files and compare with it.

Keyed state lives in ``transformWithState`` (one small state row per key, never the
key's history); rows are handled one by one.  Rows of a key are put in
``(ts, event_id)`` order through a buffer of ``REORDER`` rows, so files of a
micro-batch may come in any order as long as a row is at most that far from its
place; across micro-batches input must arrive in order per key, as a log does.
State leaves with its use: the cache's entries by event-time timers, the others, where
a time to live is given, when their key has been idle for it.

Sinks are idempotent: :class:`KeyedTable` and :func:`scoring_sink` write what a batch
makes under the batch's number, so a batch replayed after a failure changes nothing.
Checkpoints go under the session's checkpoint directory.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import scratch_path

REORDER = 4_096                # rows of a key that wait for an earlier one
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def file_stream(spark: SparkSession, path: str, schema: str = EVENTS_SCHEMA, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of the files that appear under ``path``."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def run_available(df: DataFrame, name: str, mode: str = "append",
                  sink: Callable[[DataFrame, int], None] | None = None, keys: list[str] | None = None) -> str:
    """Run a streaming query over everything available now; returns the output path.

    Append mode writes a parquet directory.  Update mode upserts each batch's rows by
    ``keys`` into a :class:`KeyedTable` (read it with :func:`KeyedTable.read`), complete
    mode replaces the directory; ``sink`` takes every batch itself.
    """
    spark = df.sparkSession
    out = scratch_path(spark, f"stream-{name}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    w = df.writeStream.outputMode(mode).option("checkpointLocation", out + "-ckpt").trigger(availableNow=True)
    if sink is not None:
        q = w.foreachBatch(sink).start()
    elif mode == "append":
        q = w.format("parquet").option("path", out).start()
    elif mode == "update":
        if not keys:
            raise ValueError("update mode needs the keys of the table")
        q = w.foreachBatch(KeyedTable(out, keys).upsert).start()
    else:
        q = w.foreachBatch(lambda batch, _id: batch.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return out


# ------------------------------------------------------------------ a sink that batches update
class KeyedTable:
    """A table of one row per key that micro-batches update, under a path of any file
    system that Spark writes.

    Keys are dealt to ``buckets`` by a hash.  A batch rewrites the buckets it touches, as
    files under its own number, and then publishes a ledger entry: which batch holds the
    latest files of each bucket.  The entry appears by one rename, so a reader sees all of
    a batch or nothing, and a batch that the ledger holds already is skipped when it is
    replayed; one that failed before is written anew over its leftovers.
    """

    def __init__(self, path: str, keys: list[str], buckets: int = 16):
        self.path, self.keys, self.buckets = path, list(keys), buckets

    def _fs(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path + "/_ledger")
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def ledger(self, spark: SparkSession) -> tuple[int, dict[int, int]]:
        """``(last batch, {bucket: batch that holds it})``; ``(-1, {})`` when empty."""
        fs, path = self._fs(spark)
        at = path(self.path + "/_ledger")
        if not fs.exists(at):
            return -1, {}
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        ids = sorted(int(n) for n in names if n.isdigit())
        if not ids:
            return -1, {}
        text = spark.read.text(f"{self.path}/_ledger/{ids[-1]}").first()[0]
        return ids[-1], {int(k): v for k, v in json.loads(text).items()}

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Rows of ``batch`` replace those of the same key (null keys are keys); a key
        comes once in a batch."""
        spark = batch.sparkSession
        last, where = self.ledger(spark)
        if batch_id <= last:
            return
        new = batch.withColumn("_bucket", self._bucket()).persist()
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())     # at most ``buckets``
        kept = [(b, where[b]) for b in touched if b in where]
        rows = new
        if kept:
            old = self._files(spark, kept).withColumn("_bucket", self._bucket())
            same = None
            for k in self.keys:
                c = old[k].eqNullSafe(new[k])
                same = c if same is None else same & c
            rows = new.unionByName(old.join(new, same, "left_anti"))
        if touched:
            rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/batch={batch_id}")
        new.unpersist()
        where.update({b: batch_id for b in touched})
        fs, path = self._fs(spark)
        draft, final = path(f"{self.path}/_ledger/.{batch_id}"), path(f"{self.path}/_ledger/{batch_id}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(where).encode()))
        out.close()
        fs.rename(draft, final)

    def _files(self, spark: SparkSession, held: list[tuple[int, int]]) -> DataFrame:
        return spark.read.parquet(*[f"{self.path}/batch={v}/_bucket={b}" for b, v in held])

    def read(self, spark: SparkSession) -> DataFrame:
        """The latest row of every key."""
        _, where = self.ledger(spark)
        if not where:
            raise FileNotFoundError(f"no rows in {self.path} yet")
        return self._files(spark, sorted(where.items()))


# ------------------------------------------------------------------ keyed state
def _in_order(rows: Iterator[Row], most: int = REORDER) -> Iterator[Row]:
    """Rows by ``(ts, event_id)``, at most ``most`` of them held at a time."""
    waiting: list = []
    for i, r in enumerate(rows):
        heapq.heappush(waiting, (r["ts"], r["event_id"], i, r))
        if len(waiting) > most:
            yield heapq.heappop(waiting)[-1]
    while waiting:
        yield heapq.heappop(waiting)[-1]


class _KeyedFold(StatefulProcessor):
    """State per key that one row after the other updates.

    ``start`` is the state of a new key, ``step(state, row)`` gives
    ``(new state, output row or None)``."""

    def __init__(self, state_schema: str, start: tuple, step, idle_ms: int | None):
        self.state_schema, self.start, self.step, self.idle_ms = state_schema, start, step, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.state_schema, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        state = tuple(self.state.get()) if self.state.exists() else self.start
        for row in _in_order(rows):
            state, out = self.step(state, row)
            if out is not None:
                yield Row(**{self.step.key: key[0], **out})
        self.state.update(state)

    def close(self) -> None:
        pass


def _fold(stream: DataFrame, key: str, out_schema: str, state_schema: str, start: tuple, step,
          idle_seconds: float | None) -> DataFrame:
    """``step`` over the rows of each key; ``out_schema`` begins with the key."""
    step.key = key
    processor = _KeyedFold(state_schema, start, step, int(idle_seconds * 1000) if idle_seconds else None)
    return stream.groupBy(key).transformWithState(processor, out_schema, "Append",
                                                  "ProcessingTime" if idle_seconds else "None")


def _us(ts) -> int:
    """Microseconds since the epoch of a timestamp without zone."""
    import calendar
    return calendar.timegm(ts.timetuple()) * 1_000_000 + ts.microsecond


# ------------------------------------------------------------------ ST1
def session_history(stream: DataFrame, key: str = "user_id", clear_type: str = "signup",
                    idle_seconds: float | None = None) -> DataFrame:
    """Session history with clears (ST1, batch twin ``session_segments``):
    per event the segment number (running count of clears) and the length of
    the history in the current segment; a clear restarts it at zero.  With
    ``idle_seconds`` a session that is idle for so long is forgotten."""
    def step(state, row):
        seg, hist = state
        seg, hist = (seg + 1, 0) if row["event_type"] == clear_type else (seg, hist + 1)
        return (seg, hist), {"event_id": row["event_id"], "segment": seg, "history_len": hist}

    return _fold(stream, key, f"{key} long, event_id long, segment long, history_len long",
                 "segment long, history_len long", (0, 0), step, idle_seconds)


# ------------------------------------------------------------------ ST2
class _TtlCache(StatefulProcessor):
    """The live entry of a prompt; an event-time timer removes it at its end."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "us long")

    def handleInputRows(self, key, rows, timerValues):
        until = self.until.get()[0] if self.until.exists() else None
        for row in _in_order(rows):
            cached = until is not None and row["us"] < until
            if not cached:
                until = row["us"] + self.ttl_us
            yield Row(event_id=row["event_id"], key=None if key[0] is None else str(key[0]), cached=cached)
        self.until.update((until,))
        # rows after the watermark are later than this and would miss anyway
        self.handle.registerTimer(-(-until // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.until.exists() and self.until.get()[0] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def ttl_cache(stream: DataFrame, key: str, ttl_seconds: float, watermark: str = "1 hour") -> DataFrame:
    """Prompt cache with a TTL from insertion (ST2, quirk Q11): per request,
    whether it is served from the cache.  State per key: the end of the live entry,
    removed once the watermark has passed it, so state is as large as the live
    entries, not as the prompts ever seen.  Exact, unlike a watermark-based dedup."""
    s = stream.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))) \
        .withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return s.groupBy(key).transformWithState(_TtlCache(int(ttl_seconds * 1_000_000)),
                                             "event_id long, key string, cached boolean", "Append", "EventTime")


# ------------------------------------------------------------------ ST3
def count_windows(stream: DataFrame, key: str, size: int, a: str, b: str,
                  idle_seconds: float | None = None) -> DataFrame:
    """Count-based tumbling windows of ``size`` requests per key (ST3): emits
    ``avg(a)``, ``avg(b)`` and ``sum(a)/sum(b)`` when a window fills; the open
    window is carried in state, a partial window is never emitted.  With
    ``idle_seconds`` the open window of a key idle for so long is forgotten."""
    def step(state, row):
        wid, n, sa, sb = state
        n, sa, sb = n + 1, sa + float(row[a]), sb + float(row[b])
        if n < size:
            return (wid, n, sa, sb), None
        out = {"window_id": wid, "avg_a": sa / n, "avg_b": sb / n, "ratio": sa / sb if sb else math.nan}
        return (wid + 1, 0, 0.0, 0.0), out

    return _fold(stream, key, f"{key} long, window_id long, avg_a double, avg_b double, ratio double",
                 "wid long, n long, sa double, sb double", (0, 0, 0.0, 0.0), step, idle_seconds)


# ------------------------------------------------------------------ ST4
def latest_state(stream: DataFrame, key: str, layer: str, value: str, tokens: F.Column) -> DataFrame:
    """Latest state per (session, layer) with token counts added (ST4): a
    streaming aggregate in update mode."""
    return stream.groupBy(key, layer).agg(
        F.max_by(value, F.struct("ts", "event_id")).alias("state"),
        F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("n_updates"))


# ------------------------------------------------------------------ ST5
def run_metrics(stream: DataFrame, key: str = "user_id", tokens_per_step: int = 2048 * 36,
                idle_seconds: float | None = None) -> DataFrame:
    """Metric stream per run (ST5): step number, running mean of the loss
    since the start of the epoch (day) and kt/s from the previous step's
    time; state = (step, epoch, sum, count, last ts).  With ``idle_seconds`` a run
    without steps for so long is forgotten."""
    def step(state, row):
        n_step, epoch, total, n, last = state
        t, day = _us(row["ts"]), row["ts"].strftime("%Y-%m-%d")
        if day != epoch:
            epoch, total, n = day, 0.0, 0
        total, n = total + float(row["value"]), n + 1
        kt = None if last is None or t <= last else tokens_per_step / ((t - last) / 1e6) / 1000.0
        return (n_step + 1, epoch, total, n, t), {"event_id": row["event_id"], "step": n_step,
                                                  "running_loss": total / n, "kt_s": kt}

    return _fold(stream, key, f"{key} long, event_id long, step long, running_loss double, kt_s double",
                 "step long, epoch string, s double, n long, last long", (0, "", 0.0, 0, None), step, idle_seconds)


# ------------------------------------------------------------------ ST6
def scoring_sink(out_path: str, rank: str, row: str, col: str, scorer=None):
    """foreachBatch sink: each micro-batch is gathered, scored once and written with its
    (rank, row) (ST6, J4) as the batch's own partition, which a replay replaces."""
    from ..operators.infer import gather_score_scatter, md5_scorer

    def sink(batch: DataFrame, batch_id: int) -> None:
        r = gather_score_scatter(batch, rank, row, col, "score", scorer or md5_scorer)
        r.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
    return sink


# ------------------------------------------------------------------ ST7
def hourly_metrics(stream: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Metrics by one-hour event-time window; rows later than the watermark
    are dropped (ST7; batch twin ``hourly_metrics``)."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return (s.withWatermark("ts", watermark)
            .groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value"))
            .select(F.col("w.start").alias("hour"), "event_type", "n", "avg_value"))
