"""Trials that share a state in the event-time stream."""

import datetime

import numpy as np
from pyspark.sql import types as T

from perfweave.operators import timing
from perfweave.sources import fixtures
from perfweave.streaming import step_stream

START = datetime.datetime(2024, 1, 1)


def _steps(spark, path, schema, files):
    for i, rows in enumerate(files):
        spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], schema).coalesce(1).write.parquet(f"{path}/part-{i}")
    return step_stream.replayed(spark, path, schema)


def test_trials_of_one_state_close_on_their_own(spark, tmp_path):
    """Two states hold 40 trials: each closes by its own first step, and the result is the batch result."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fixtures.steps(spark, "/root/testdata/sf0.001").schema.fields])
    rng = np.random.default_rng(3)
    log = [{"trial_id": 2 ** 60 + t, "ts": START + datetime.timedelta(seconds=int(300 * (t % 4) + s)), "event_id": 2 ** 60 + 100 * t + k,
            "loader_ms": None if k % 5 == 0 else float(rng.random()), "compute_ms": float(k), "n_examples": 1, "n_tokens": k,
            "oom": [None, True, False, False][k % 4], "fwd_done": True}
           for t in range(40) for k, s in enumerate(rng.integers(0, 60, 9))]
    log.sort(key=lambda r: r["ts"])
    beat = lambda s: {**dict.fromkeys(schema.names), "ts": START + datetime.timedelta(seconds=s)}
    files = [[r for r in log if (r["ts"] - START).seconds // 300 == i and (r["event_id"] % 7 == 0) == late] for i in range(4) for late in (False, True)]
    progress = step_stream.final_trial_timing(_steps(spark, str(tmp_path / "in"), schema, [*files, [beat(9000)], [beat(9001)]]),
                                              str(tmp_path / "out"), str(tmp_path / "ckpt"), "60 seconds", 150, warmup=2, measure=4, groups=2)
    kept = spark.read.schema(step_stream.OUT_SCHEMA).parquet(str(tmp_path / "out"))
    assert kept.count() == 40 * 6  # every trial once
    batch = spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in log], schema)
    args = dict(warmup=2, measure=4)
    got, want = (sorted(map(str, timing.trial_timing(d, **args).collect())) for d in (kept, batch))
    assert got == want
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(rows) == 2 and rows[-1] == 0
    assert len(list((tmp_path / "out").glob("batch_id=*/part-*"))) > 1  # not all at the end
    early = spark.read.schema(step_stream.OUT_SCHEMA).parquet(*[str(f) for f in sorted((tmp_path / "out").iterdir()) if int(f.name.split("=")[1]) < 8])
    assert 0 < early.count() < 40 * 6


def test_replay_reads_the_log_once_and_keeps_its_slices(spark, tmp_path):
    seconds = step_stream.replay(spark, "/root/testdata/sf0.001", str(tmp_path / "in"))
    log = fixtures.steps(spark, "/root/testdata/sf0.001")
    parts = [spark.read.schema(log.schema).parquet(str(tmp_path / "in" / f"part-{i}")) for i in range(step_stream.SLICES + 1)]
    assert [len(list((tmp_path / "in" / f"part-{i}").glob("*.parquet"))) for i in range(step_stream.SLICES + 1)] == [1] * (step_stream.SLICES + 1)
    rows = [p.collect() for p in parts]
    assert sorted(map(str, sum(rows[:-1], []))) == sorted(map(str, log.collect())) and len(rows[-1]) == 1
    first = min(r["ts"] for r in rows[0])
    for i, part in enumerate(rows[:-1]):  # a row is at most one slice late
        assert all(-2 < (r["ts"] - first).total_seconds() / seconds - i < 1 + 1e-6 for r in part)
