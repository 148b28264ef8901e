"""Streaming step-log rollup (ST1).

Steps arrive as a stream (file source here; any streaming source works).
Each trial's measured window is "steps warmup+1 .. warmup+measure in
(ts, event_id) order", which only depends on the trial's ``warmup+measure``
earliest steps.  ``applyInPandasWithState`` keeps exactly those (bounded
state: at most 25 rows per trial, whatever the arrival order) and emits them
whenever they change.  Every emission goes to a file sink via
``foreachBatch`` in a folder of its micro-batch, which a replay of the
micro-batch overwrites; the current result is the
batch rollup (``operators.timing.trial_timing``, the same Spark code) over
each trial's latest emission.  On a finite replay it equals the batch
result exactly.

``final_trial_timing`` is the form for an endless log, in event time: rows
later than the watermark are dropped, a trial's log closes ``span`` after its
first step, and then its kept steps are emitted once and leave the state.
A call of a state function costs milliseconds whatever it holds, so trials
share GROUPS states (by hash), each one table of kept steps; every trial has a
closing time of its own, and a group's timer is the next one of them.
``window_rollup`` sums steps per event-time window with built-in streaming
aggregates (approximate percentile, bounded buffers).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..config import MEASURE_STEPS, WARMUP_STEPS
from ..operators import timing
from ..session import code_on_workers
from ..sources import fixtures

STATE_SCHEMA = ("ts array<timestamp_ntz>, event_id array<bigint>, loader_ms array<double>, "
                "compute_ms array<double>, oom array<boolean>, n_examples array<int>, n_tokens array<int>")
COLS = ("ts", "event_id", "loader_ms", "compute_ms", "oom", "n_examples", "n_tokens")
OUT_SCHEMA = ("trial_id bigint, ts timestamp_ntz, event_id bigint, loader_ms double, compute_ms double, "
              "oom boolean, n_examples int, n_tokens int")


def _earliest(batches, state, keep: int):
    """The ``keep`` earliest of a trial's new and kept steps, one array a column; None without any new step."""
    kind = lambda c, v: np.asarray(v, "datetime64[us]" if c == "ts" else float if c.endswith("_ms") else None)
    parts = [[kind(c, b[c].to_numpy()) for c in COLS] for b in batches if len(b)]
    if not parts:
        return None
    if state.exists:
        parts.append([kind(c, v) for c, v in zip(COLS, state.get)])
    cols = [np.concatenate(c) for c in zip(*parts)]
    first = np.lexsort((cols[1], cols[0]))[:keep]
    return [c[first] for c in cols]


def _make_update(keep: int):
    def update(key, batches, state):
        kept = _earliest(batches, state, keep)
        if kept is None:
            return
        state.update(tuple(c.tolist() for c in kept))
        yield pd.DataFrame({"trial_id": int(key[0]), **dict(zip(COLS, kept))})

    return update


def stream_trial_timing(spark: SparkSession, steps: DataFrame, out_dir: str, checkpoint: str,
                        warmup: int = WARMUP_STEPS, measure: int = MEASURE_STEPS) -> None:
    """Run the stateful selection over a streaming step log until the source
    is drained (``availableNow``), appending emissions under ``out_dir``."""
    code_on_workers(spark)
    kept = steps.groupBy("trial_id").applyInPandasWithState(
        _make_update(warmup + measure), OUT_SCHEMA, STATE_SCHEMA, "update",
        GroupStateTimeout.NoTimeout)

    def sink(batch: DataFrame, batch_id: int) -> None:
        # A replayed micro-batch replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    q = (kept.writeStream.foreachBatch(sink).outputMode("update")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


GROUPS = 1024  # states that the trials share


def _kept_kind():
    """Arrow schema of a group's kept steps; ``closes`` is the closing time of the row's trial."""
    import pyarrow as pa

    kinds = (pa.int64(), pa.timestamp("us"), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64())
    return pa.schema(list(zip(("trial_id", *COLS, "closes"), kinds)))


def _earliest_of_trials(new, old, keep: int, span_ms: int, watermark_ms: int):
    """The ``keep`` earliest of every trial's new and kept steps, with new closing times for trials with new steps."""
    import pyarrow as pa
    import pyarrow.compute as pc

    every = pa.concat_tables([new, old]).combine_chunks()
    plain = lambda c: pc.fill_null(every.column(c).cast(pa.int64()), 0).to_numpy()
    gone = lambda c: every.column(c).is_null().to_numpy()
    trial, ts = plain("trial_id"), plain("ts")
    order = np.lexsort((plain("event_id"), gone("event_id"), ts, gone("ts"), trial))  # missing values last
    trial = trial[order]
    first = np.flatnonzero(np.concatenate([[True], trial[1:] != trial[:-1]]))
    rank = np.arange(len(trial)) - np.repeat(first, np.diff(np.append(first, len(trial))))
    # The first step's time; a trial without any time closes at once.
    begin = np.where(gone("ts")[order][first], np.iinfo(np.int64).min // 2, ts[order][first] // 1000)
    closes = np.repeat(np.maximum(begin + span_ms, watermark_ms + 1), np.diff(np.append(first, len(trial))))
    untouched = ~np.isin(trial, new.column("trial_id").to_numpy())
    closes[untouched] = plain("closes")[order][untouched]
    kept = rank < keep
    every = every.take(pa.array(order[kept]))
    return every.set_column(every.schema.get_field_index("closes"), "closes", pa.array(closes[kept]))


def _make_final(keep: int, span_ms: int):
    import pyarrow as pa

    def update(key, batches, state):
        if pd.isna(key[0]):  # heartbeats only move the watermark
            return
        kind, now = _kept_kind(), state.getCurrentWatermarkMs()
        kept = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else kind.empty_table()
        new = [] if state.hasTimedOut else [pa.Table.from_pandas(b[["trial_id", *COLS]].assign(closes=0), kind, preserve_index=False) for b in batches if len(b)]
        if new:
            kept = _earliest_of_trials(pa.concat_tables(new), kept, keep, span_ms, now)
        closes = kept.column("closes").to_numpy()
        over = closes < now
        if over.any():
            out = kept.filter(pa.array(over)).drop_columns(["closes"]).to_pandas()
            yield out.assign(ts=out["ts"].astype("datetime64[ns]"))
            kept, closes = kept.filter(pa.array(~over)), closes[~over]
        if len(closes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kind) as stream:
                stream.write_table(kept)
            state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(int(max(closes.min(), now + 1)))
        elif state.exists:
            state.remove()

    return update


def final_trial_timing(steps: DataFrame, out_dir: str, checkpoint: str, delay: str, span_seconds: int,
                       warmup: int = WARMUP_STEPS, measure: int = MEASURE_STEPS, groups: int = GROUPS) -> list[dict]:
    """Each trial's measured steps once, when its log has closed; the progress of every micro-batch.

    ``delay``: how late a row may come; ``span_seconds``: event time from a
    trial's first step until its log closes.  Rows with a null trial_id are
    heartbeats.  A later row of a closed trial is late unless the watermark
    lets it pass; it then opens the trial anew.  ``groups``: states that the
    trials share, the same for all runs on a checkpoint.
    """
    code_on_workers(steps.sparkSession)
    timed = steps.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
    beat = F.col("trial_id").isNull()
    timed = timed.withColumn("group", F.when(~beat, F.pmod(F.xxhash64("trial_id"), F.lit(groups))))
    # Whole numbers stay whole in pandas: heartbeats have some.
    timed = timed.withColumns({c: F.when(beat, F.lit(0)).otherwise(F.col(c)) for c in ("trial_id", "event_id", "n_examples", "n_tokens")})
    kept = timed.select("group", "trial_id", *COLS, "event_time").groupBy("group").applyInPandasWithState(
        _make_final(warmup + measure, span_seconds * 1000), OUT_SCHEMA, "kept binary", "append", GroupStateTimeout.EventTimeTimeout)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    q = (kept.writeStream.foreachBatch(sink).outputMode("append")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return list(q.recentProgress)


def window_rollup(steps: DataFrame, out_dir: str, checkpoint: str, delay: str, window: str) -> list[dict]:
    """Per event-time window: steps, mean and approximate 90th percentile of the step time of non-OOM steps.

    A window is written once, when the watermark has passed its end."""
    total = F.when(~F.coalesce(F.col("oom"), F.lit(False)), F.col("loader_ms") + F.col("compute_ms"))
    rolled = (steps.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
              .groupBy(F.window("event_time", window).alias("w"))
              .agg(F.count("trial_id").alias("n_steps"), F.avg(total).alias("avg_step_ms"),
                   F.approx_percentile(total, 0.9, 10_000).alias("p90_step_ms")))
    rolled = rolled.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n_steps", "avg_step_ms", "p90_step_ms")
    q = (rolled.writeStream.format("parquet").option("path", out_dir).outputMode("append")
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return list(q.recentProgress)


def latest_rollup(spark: SparkSession, out_dir: str, warmup: int = WARMUP_STEPS,
                  measure: int = MEASURE_STEPS) -> DataFrame:
    """Rollup of each trial's latest kept steps (<= warmup+measure rows each)."""
    emitted = spark.read.parquet(out_dir)
    last = emitted.groupBy("trial_id").agg(F.max("batch_id").alias("batch_id"))
    steps = emitted.join(last, ["trial_id", "batch_id"], "left_semi").drop("batch_id")
    return timing.trial_timing(steps, warmup=warmup, measure=measure)


def stream_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step log as a stream over the events table, one file or a folder of files."""
    folder, path = sf_dir.rstrip("/"), f"{sf_dir.rstrip('/')}/events.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema)
    if any(f.endswith("/events.parquet") for f in table.inputFiles()):  # a stream reads folders only
        events = stream.option("pathGlobFilter", "events.parquet").parquet(folder)
    else:
        events = stream.parquet(path)
    return spark.sql(fixtures.STEPS_SQL, events=events)


def stream_trial_timing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drain the step stream into a fresh folder under the shared
    checkpoint directory and return the per-trial result."""
    base = fixtures.shared_path(spark, "stream")
    stream_trial_timing(spark, stream_steps(spark, sf_dir), f"{base}/out", f"{base}/ckpt")
    return latest_rollup(spark, f"{base}/out")


SLICES = 6  # files of a replay


def replay(spark: SparkSession, sf_dir: str, path: str) -> int:
    """The step log written as files that a stream reads one by one: slices of
    event time, every seventh row one slice late, and a last file with a
    heartbeat far behind the log's end.  Returns a slice's length in seconds."""
    log = fixtures.steps(spark, sf_dir).withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    lo, hi = log.agg(F.min("s"), F.max("s")).collect()[0]  # two numbers
    if lo is None:
        log.drop("s").write.parquet(f"{path}/part-0")
        return 1
    width = (hi - lo) // SLICES + 1
    at = F.floor((F.col("s") - lo) / F.lit(width)) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    sliced = log.withColumn("slice", F.least(at, F.lit(SLICES - 1)).cast("int")).drop("s")
    # The log is read once, by all tasks; a slice's single file then comes from its own rows only.
    folder = fixtures.shared_path(spark, "slices")
    sliced.write.partitionBy("slice").parquet(folder)
    sliced = spark.read.schema(sliced.schema).parquet(folder)
    for i in range(SLICES):
        sliced.where(F.col("slice") == i).drop("slice").coalesce(1).write.parquet(f"{path}/part-{i}")
    beat = spark.range(1).select(*[(F.timestamp_micros(F.lit(hi + 1000 * SLICES * width)).cast("timestamp_ntz") if f.name == "ts"
                                    else F.lit(None).cast(f.dataType)).alias(f.name) for f in log.drop("s").schema.fields])
    beat.coalesce(1).write.parquet(f"{path}/part-{SLICES}")
    return max(1, -(-width // 1_000_000))


def replayed(spark: SparkSession, path: str, schema) -> DataFrame:
    """Its stream: one file a micro-batch, in the order they were written."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def stream_final_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay with out-of-order files: every trial's timing when its log has closed."""
    base = fixtures.shared_path(spark, "replay")
    seconds = replay(spark, sf_dir, f"{base}/in")
    steps = replayed(spark, f"{base}/in", fixtures.steps(spark, sf_dir).schema)
    final_trial_timing(steps, f"{base}/out", f"{base}/ckpt", f"{2 * seconds} seconds", 2 * SLICES * seconds)
    return timing.trial_timing(spark.read.schema(OUT_SCHEMA).parquet(f"{base}/out"))


def stream_window_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay with out-of-order files: step times per day of event time."""
    base = fixtures.shared_path(spark, "windows")
    seconds = replay(spark, sf_dir, f"{base}/in")
    steps = replayed(spark, f"{base}/in", fixtures.steps(spark, sf_dir).schema)
    window_rollup(steps, f"{base}/out", f"{base}/ckpt", f"{2 * seconds} seconds", "1 day")
    out = spark.read.schema("window_start timestamp_ntz, n_steps bigint, avg_step_ms double, p90_step_ms double").parquet(f"{base}/out")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))
