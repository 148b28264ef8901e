"""The evaluation reads the joined trials from one written table where the join shuffles them."""

import pytest

from perfweave.plans import evaluate
from perfweave.sources.trials import drop_missing_targets, trials

SF001 = "/root/testdata/sf0.001"


@pytest.mark.parametrize("limit", ["-1", "10MB"])
def test_features_come_from_trials_joined_once(spark, limit):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, limit)
    try:
        f = evaluate.evaluation_features(spark, SF001, log1p=False)
        tables = {p.rsplit("/", 1)[1] for p in f.inputFiles() if "/testdata/" in p}
        assert tables == (set() if limit == "-1" else {"lineitem.parquet", "part.parquet"})
        keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "gpu_name", "model", "storage", "T_gpu_ms", "avg_batch_time_ms",
                "param_count", "optimizer_state_bytes", "learning_rate", "fold"]
        want = drop_missing_targets(trials(spark, SF001)).select(*keys)
        assert sorted(map(str, f.select(*keys).collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set(name, before)
