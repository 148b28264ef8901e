"""Sources, sinks, streaming and the driver entry point."""

import os
import tempfile

import pytest

import __spark_entry__ as entry
from conftest import SF001
from perfweave.operators import timing
from perfweave.sources import fixtures, manifest, trials as tr
from perfweave.streaming import step_stream


def test_required_columns_listed(spark):
    df = spark.createDataFrame([(1,)], "gpu_name int")
    with pytest.raises(ValueError) as e:
        tr.require_columns(df)
    assert "batch_size" in str(e.value) and "T_gpu_ms" in str(e.value)


def test_dedup_columns_keeps_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "b", "c"]).toDF("a", "b", "a")
    out = tr.dedup_columns(df)
    assert out.columns == ["a", "b"] and tuple(out.first()) == (1, 2)


def test_slug(spark):
    df = spark.createDataFrame([(' NVIDIA  A100 <x>/y ',), ("a" * 200,)], "s string")
    out = [r[0] for r in df.select(tr.slug("s")).collect()]
    assert out[0] == "NVIDIA_A100__x__y" and len(out[1]) == 140


def test_union_by_name_with_missing_columns(spark):
    a = spark.createDataFrame([(1, 2.0)], "k long, x double")
    b = spark.createDataFrame([(2, "s")], "k long, y string")
    out = tr.union_trials([a, b]).orderBy("k").collect()
    assert out[0]["y"] is None and out[1]["x"] is None


def test_write_roundtrip_partitions_by_gpu(spark):
    d = tempfile.mkdtemp(prefix="pw-trials-")
    t = tr.trials(spark, SF001).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                       "architecture", "gpu_name", "T_gpu_ms")
    tr.write_trials(t, d, mode="overwrite")
    back = tr.scan_trials(spark, d)
    assert back.count() == t.count()
    assert "gpu_slug" in back.columns
    assert any(x.startswith("gpu_slug=") for x in os.listdir(os.path.join(d, "architecture=CNN")))


def test_image_folder_manifest(spark):
    root = tempfile.mkdtemp(prefix="pw-img-")
    for cls, files in {"n01": ["a.JPEG", "b.png", "notes.txt"], "n02": ["c.jpg"], "n99": ["z.png"]}.items():
        os.makedirs(os.path.join(root, cls, "images"))
        for f in files:
            with open(os.path.join(root, cls, "images", f), "wb") as h:
                h.write(b"x" * (len(f) * 10))
    files = manifest.list_image_folder(spark, root)
    classes = spark.createDataFrame([("n01", 0), ("n02", 1), ("n03", 2)], "class_name string, pos int")
    man = manifest.manifest(files, classes)
    got = sorted((os.path.basename(r["path"]), r["label_idx"], r["n_bytes"]) for r in man.collect())
    assert got == [("a.JPEG", 0, 60), ("b.png", 0, 50), ("c.jpg", 1, 50)]
    avg = {r["class_name"]: r["avg_bytes"] for r in manifest.average_bytes(man, classes).collect()}
    assert avg == {"n01": 55.0, "n02": 50.0, "n03": 0.0}


def test_folders_are_listed_by_few_tasks(spark):
    root = tempfile.mkdtemp(prefix="pw-img-")
    n = 40 * spark.sparkContext.defaultParallelism
    for i in range(n):
        os.makedirs(os.path.join(root, "en", str(i), "images"))
        with open(os.path.join(root, "en", str(i), "images", "a.png"), "wb") as h:
            h.write(b"x")
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.sparkContext.setJobGroup("list-folders", "")
    files = manifest.list_image_folder(spark, root)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("list-folders") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(name) == before
    assert files.count() == n


def test_image_folder_files(spark):
    """One file a row, also for equal rows; a mounted folder holds nothing else."""
    d = tempfile.mkdtemp(prefix="pw-pages-")
    rows = [(1, "http://a.com/en/x", "h\u00e9\nllo"), (2, "http://a.com/fr/x", ""), (2, "http://a.com/fr/x", ""), (3, "http://a.com/", "z"),
            (None, "http://a.com/en/x", "q"), (4, "http://a.com/en/x", None), (5, None, "w")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    root = fixtures.image_folder(spark, d)
    assert root.startswith("file:")
    local = root[len("file:"):]
    files = sorted(os.path.relpath(os.path.join(at, f), local) for at, _, fs in os.walk(local) for f in fs)
    none = "__HIVE_DEFAULT_PARTITION__"
    assert [os.path.dirname(f) for f in files] == sorted(
        ["class=en/page=1", "class=fr/page=2", "class=fr/page=2", f"class={none}/page=3", f"class=en/page={none}", f"class={none}/page=5"])
    by_folder = {os.path.dirname(f): open(os.path.join(local, f), "rb").read() for f in files}
    assert by_folder["class=en/page=1"] == "h\u00e9\nllo\n".encode() and by_folder["class=fr/page=2"] == b"\n"
    listed = manifest.list_files(spark, root, (".txt",), r"/class=([^/]*)/page=\d+/[^/]+$")
    assert sorted((r["class_name"], r["n_bytes"]) for r in listed.collect() if r["class_name"] in ("en", "fr")) == [("en", 8), ("fr", 1), ("fr", 1)]


def test_image_folder_without_pages(spark):
    d = tempfile.mkdtemp(prefix="pw-pages-")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    assert manifest.list_files(spark, fixtures.image_folder(spark, d), (".txt",), "x").count() == 0


def test_stream_equals_batch(spark):
    batch = timing.trial_timing(fixtures.steps(spark, SF001))
    stream = step_stream.stream_trial_timing_query(spark, SF001)
    cols = batch.columns
    assert sorted(stream.columns) == sorted(cols)
    a = sorted(tuple(r[c] for c in cols) for r in batch.collect())
    b = sorted(tuple(r[c] for c in cols) for r in stream.collect())
    assert a == b


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["model", "vcpu", "storage", "n_samples", "RMSE_full_ms", "RMSE_base_ms",
                          "Improvement_pct"]


def test_broadcast_helpers_check_size(spark):
    from perfweave.operators.joins import bounded_broadcast
    small = spark.range(10)
    big = spark.range(1000)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(bounded_broadcast(small, max_rows=100)).lower()
    assert "broadcast" not in plan(bounded_broadcast(big, max_rows=100)).lower()


def test_stream_reads_a_folder_and_survives_replay(spark, tmp_path):
    """The events table as a folder of files gives the batch result; a replayed
    micro-batch replaces what it wrote before."""
    folder = tmp_path / "sf"
    events = spark.read.parquet(f"{SF001}/events.parquet")
    events.repartition(3).write.parquet(str(folder / "events.parquet"))
    got = step_stream.stream_trial_timing_query(spark, str(folder))
    want = timing.trial_timing(fixtures.steps(spark, SF001))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_pair_keys_do_not_collide(spark, tmp_path):
    rows = [(1, 1000, "user", "a"), (2, 0, "user", "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    pairs = fixtures.pairs(spark, str(tmp_path)).collect()
    assert len({r["pair_id"] for r in pairs}) == 2


def test_validation_manifest_filters_extensions(spark):
    files = spark.createDataFrame([(1, "x/a.JPEG", 5), (2, "x/b.txt", 5)], "file long, path string, n_bytes long")
    mapping = spark.createDataFrame([(1, "n"), (2, "n")], "file long, class_name string")
    classes = spark.createDataFrame([("n", 0)], "class_name string, pos int")
    got = manifest.validation_manifest(files, mapping, classes, extensions=manifest.IMAGE_EXTENSIONS).collect()
    assert [r["path"] for r in got] == ["x/a.JPEG"]


def test_throughput_counts_steps_after_their_forward_pass(spark):
    steps = spark.createDataFrame([(1, i, i, 0.0, 10.0, 4, 2, i == 7, i != 8) for i in range(1, 10)],
                                  "trial_id int, ts int, event_id int, loader_ms double, compute_ms double, "
                                  "n_examples int, n_tokens int, oom boolean, fwd_done boolean")
    r = timing.trial_throughput(steps, warmup=5, measure=20).first()
    assert r["n_examples"] == 4 * 3  # steps 6, 7 (out of memory after its forward pass) and 9


def test_class_list_in_file_order(spark, tmp_path):
    (tmp_path / "wnids.txt").write_text("n09\n\n  n01 \nn05\t\n" + "".join(f"c{i}\n" for i in range(500, 0, -1)))
    got = {r["class_name"]: r["label_idx"] for r in manifest.class_index(manifest.class_list(spark, str(tmp_path))).collect()}
    assert got == {"n09": 0, "n01": 1, "n05": 2, **{f"c{i}": 503 - i for i in range(500, 0, -1)}}


def test_line_order_survives_splits(spark, tmp_path):
    """A file that is read in many splits, and several files, keep their line order."""
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(5000)))
    (tmp_path / "b.txt").write_text("".join(f"{i}\n" for i in range(5000, 9000)))
    from perfweave.sources.lines import ordered_lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        lines = ordered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 5
        assert [int(r["line"]) for r in lines.orderBy("pos").collect()] == list(range(9000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_annotations_last_line_wins(spark, tmp_path):
    (tmp_path / "val.txt").write_text("v1.JPEG\tn01\t0\t0\nv2.JPEG\n  v3.JPEG\tn02\nv1.JPEG\tn03\t1\n\nv2.JPEG \tn04\n")
    got = {r["file"]: r["class_name"] for r in manifest.annotations(spark, str(tmp_path / "val.txt")).collect()}
    assert got == {"v1.JPEG": "n03", "v3.JPEG": "n02", "v2.JPEG ": "n04"}


def test_csv_by_name_with_quarantine(spark, tmp_path):
    from perfweave.sources.csv_files import read_csv
    (tmp_path / "a.csv").write_text("\ufeffgpu_name,model,batch_size,avg_batch_time_ms\nNVIDIA L4,resnet,64,1.5\nshort,line\n\"a, b\",vit,32,2.5\n")
    (tmp_path / "b.csv").write_text("avg_batch_time_ms,batch_size,model,extra,model\n3.5,16,mlp,x,ignored\n4.5,many,mlp,x,y\n1,2,3,4,5,6\n")
    (tmp_path / "c.csv").write_text("model,batch_size\n")
    (tmp_path / "_SUCCESS").write_text("")
    import gzip
    with gzip.open(tmp_path / "d.csv.gz", "wt") as f:
        f.write("batch_size,model\n8,zip\n")
    schema = tr.T.StructType([tr.T.StructField(n, t) for n, t in (("model", tr.T.StringType()), ("batch_size", tr.T.LongType()), (
        "avg_batch_time_ms", tr.T.DoubleType()), ("gpu_name", tr.T.StringType()), ("depth", tr.T.LongType()))])
    rows, broken = read_csv(spark, str(tmp_path), schema)
    assert rows.columns == ["model", "batch_size", "avg_batch_time_ms", "gpu_name", "depth", "extra"]
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, [
        ("resnet", 64, 1.5, "NVIDIA L4", None, None), ("vit", 32, 2.5, "a, b", None, None), ("mlp", 16, 3.5, None, None, "x"), ("zip", 8, None, None, None, None)]))
    assert sorted((os.path.basename(r["file"]), r["line"]) for r in broken.collect()) == [("a.csv", "short,line"), ("b.csv", "1,2,3,4,5,6"), ("b.csv", "4.5,many,mlp,x,y")]
    assert tr.scan_trials(spark, str(tmp_path), "csv", schema).count() == 4
    assert rows.select("model").count() == 4 and broken.select("line").count() == 3
    with pytest.raises(FileNotFoundError):
        read_csv(spark, str(tmp_path / "none"), schema)


def _log(spark, path, files):
    schema = fixtures.steps(spark, SF001).schema
    for i, rows in enumerate(files):
        full = [tuple({"trial_id": t, "ts": __import__("datetime").datetime(2024, 1, 1) + __import__("datetime").timedelta(seconds=s), "event_id": e,
                       "loader_ms": 1.0, "compute_ms": float(e), "n_examples": 1, "n_tokens": 1, "oom": False, "fwd_done": True}[f.name]
                      for f in schema.fields) for t, s, e in rows]
        spark.createDataFrame(full, schema).coalesce(1).write.parquet(f"{path}/part-{i}")
    return step_stream.replayed(spark, path, schema)


def test_event_time_state_is_removed_and_late_rows_are_dropped(spark, tmp_path):
    files = [[(1, 0, 1), (1, 1, 2), (2, 5, 3)],
             [(1, 3, 4), (2, 4, 5), (1, 2, 6)],     # out of order, within the delay
             [(3, 500, 7), (None, 501, 0)],          # the watermark passes 480: trials 1 and 2 close
             [(None, 502, 0)],                       # (one batch later, as Spark moves the watermark between batches)
             [(2, 6, 8), (3, 502, 9)],               # a late row of trial 2
             [(None, 5000, 0)]]                      # a heartbeat closes trial 3
    stream = _log(spark, str(tmp_path / "in"), files)
    progress = step_stream.final_trial_timing(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), "20 seconds", 100, warmup=1, measure=20)
    kept = spark.read.schema(step_stream.OUT_SCHEMA).parquet(str(tmp_path / "out"))
    got = {r["trial_id"]: (r["n_steps"], r["avg_compute_ms"]) for r in timing.trial_timing(kept, warmup=1).collect()}
    assert got == {1: (3, 4.0), 2: (1, 3.0), 3: (1, 9.0)}
    assert kept.count() == 8  # every trial was emitted once
    state = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
    assert state[-1]["numRowsTotal"] == 0 and sum(s["numRowsDroppedByWatermark"] for s in state) == 1
    assert max(s["numRowsTotal"] for s in state) >= 2


def test_windows_are_written_once(spark, tmp_path):
    files = [[(1, 0, 1), (1, 59, 2)], [(2, 61, 3), (1, 30, 4)], [(None, 10_000, 0)], [(None, 10_001, 0)], [(1, 10, 99)], [(None, 20_000, 0)]]
    step_stream.window_rollup(_log(spark, str(tmp_path / "in"), files), str(tmp_path / "out"), str(tmp_path / "ckpt"), "60 seconds", "1 minute")
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [(r["n_steps"], r["avg_step_ms"], r["p90_step_ms"]) for r in rows][:2] == [(3, 1 + 7 / 3, 5.0), (1, 4.0, 4.0)]
    assert len({r["window_start"] for r in rows}) == len(rows)
