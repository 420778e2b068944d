"""Ordered scans against plain loops, with a key that holds most rows."""

import random

from pyspark.sql import functions as F

from gristmill.operators.scan import segmented_lag, segmented_last, segmented_sum
from tests.conftest import same_rows


def _rows(n=600):
    rng = random.Random(1)
    times = rng.sample(range(10_000), n)
    return [("hot" if i % 3 else f"k{i % 7}", t, rng.choice([-1, 0, 1, None])) for i, t in enumerate(times)]


def test_sum_lag_last_on_a_hot_key(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, t int, v int").repartition(5)
    by = {}
    for k, t, v in sorted(rows, key=lambda r: (r[0], r[1])):
        by.setdefault(k, []).append((t, v))
    sums, lags, lasts = [], [], []
    for k, xs in by.items():
        total, before, seen = 0, None, None
        for t, v in xs:
            total += v or 0
            sums.append((k, t, total))
            lags.append((k, t, before))
            lasts.append((k, t, seen))
            before = t
            seen = v if v is not None else seen
    same_rows(segmented_sum(df, ["k"], ["t"], "v", "s").select("k", "t", "s").collect(), sums)
    same_rows(segmented_lag(df, ["k"], ["t"], F.col("t"), "p").select("k", "t", "p").collect(), lags)
    same_rows(segmented_last(df, ["k"], ["t"], F.col("v"), "p").select("k", "t", "p").collect(), lasts)


def test_small_batches_null_keys_and_ties(spark):
    rows = [(None if i % 5 == 0 else "hot", i % 40, 1 if i % 3 else None) for i in range(400)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame(rows, "k string, t int, v int").repartition(9)
        got = segmented_sum(df, ["k"], ["t"], "v", "s").groupBy("k", "t").agg(F.max("s").alias("s")).collect()
        want = {(k, t): sum(v or 0 for a, b, v in rows if a == k and b <= t) for k, t, _ in rows}
        same_rows(got, [(k, t, s) for (k, t), s in want.items()])
        last = segmented_last(df.groupBy("k", "t").agg(F.max("v").alias("v")), ["k"], ["t"], F.struct("t", "v"), "p")
        seen = {(r.k, r.t): r.p for r in last.collect()}
        assert seen[("hot", 1)] is None and seen[("hot", 39)]["t"] == 38 and len(seen) == len(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_the_checkpoint_folder_of_a_cluster_must_be_set(spark):
    import types

    import pytest

    from gristmill import session

    conf = types.SimpleNamespace(get=lambda *_: None)
    sc = types.SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://one:7077")
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(types.SimpleNamespace(sparkContext=sc, conf=conf))


def test_empty(spark):
    df = spark.createDataFrame([], "k string, t int, v int")
    assert segmented_sum(df, ["k"], ["t"], "v", "s").count() == 0
    assert segmented_lag(df, ["k"], ["t"], F.col("t"), "p").count() == 0
    assert segmented_last(df, ["k"], ["t"], F.col("v"), "p").count() == 0
