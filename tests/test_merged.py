"""Amended streams equal the batch operators, whatever the order of the rows and their split into micro-batches."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from contract import data as d
from plantpulse.operators import alarms, policy
from plantpulse.operators.features import serving_features
from plantpulse.params import DEFAULTS
from plantpulse.schemas import DEVICE, EPOCH_MS, ROW_ID
from plantpulse.session import checkpointed
from plantpulse.streaming import merged

FEATURES = ["throughput_mean", "packet_drop_mean", "buffer_peak", "throughput_slope", "lag_latency_1", "lag_latency_2", "samples_in_window"]
# Deals the rows to three micro-batches: in order of time, by hash, and with one device's early rows last.
LAYOUTS = {
    "in order": lambda: F.ntile(3).over(merged.Window.orderBy(EPOCH_MS, ROW_ID)) - 1,
    "by hash": lambda: F.pmod(F.hash(ROW_ID), F.lit(3)),
    "one late": lambda: F.when(F.col(ROW_ID) % 97 == 5, 2).otherwise(F.ntile(2).over(merged.Window.orderBy(EPOCH_MS, ROW_ID)) - 1),
}


@pytest.fixture(scope="module")
def skewed(spark, sf):
    """Frames of which one device has nine in ten."""
    frames = d.frames(spark, sf).where(F.col(ROW_ID) < 260)
    return checkpointed(frames.withColumn(DEVICE, F.when(F.col(ROW_ID) % 10 != 0, "NODE_HOT").otherwise(F.col(DEVICE))))


def rows(df, *columns):
    rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.select(*columns).dtypes]
    return sorted(map(str, df.select(*rounded).collect()))


def run(handler, df, layout, again=False):
    dealt = checkpointed(df.withColumn("_part", LAYOUTS[layout]()))
    for k in range(3):
        part = dealt.where(F.col("_part") == k).drop("_part")
        handler(part, k)
        if again:
            handler(part, k)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_features_equal_batch(spark, skewed, tmp_path, layout):
    p = replace(DEFAULTS, max_group_rows=90)  # the hot device is cut into blocks
    run(merged.feature_changes(str(tmp_path), p), skewed, layout, again=layout == "one late")
    changes = spark.read.parquet(f"{tmp_path}/changes")
    assert rows(merged.newest(changes), ROW_ID, *FEATURES) == rows(serving_features(skewed), ROW_ID, *FEATURES)
    amended = changes.groupBy(ROW_ID).count().where("count > 1").count()
    assert (amended == 0) == (layout == "in order")
    if layout == "one late":  # a late row alters the frames that look back on it, not all later ones
        assert changes.where("batch_id = 2").count() < skewed.count()


@pytest.mark.parametrize("layout", LAYOUTS)
def test_event_log_equals_batch(spark, skewed, tmp_path, layout):
    run(merged.log_changes(str(tmp_path)), skewed, layout, again=layout == "by hash")
    want = alarms.sequence_of_events(policy.replay(skewed))
    assert rows(merged.current_log(spark, str(tmp_path)), *want.columns) == rows(want, *want.columns)


def test_a_hot_device_uses_more_than_one_task(spark, skewed, tmp_path):
    p = replace(DEFAULTS, max_group_rows=60)
    seen = []

    def operator(frames):
        out = serving_features(frames, p)
        per_task = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count_if(F.col(DEVICE) == "NODE_HOT").alias("n"))
        seen.append([r.n for r in per_task.collect() if r.n])
        return out

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows end in one partition
    try:
        merged.changes_of(operator, str(tmp_path), p.window_rows + 1, p=p)(skewed, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(seen[0]) > 1 and sum(seen[0]) == skewed.where(F.col(DEVICE) == "NODE_HOT").count()


def test_old_tails_are_removed(spark, skewed, tmp_path):
    run(merged.feature_changes(str(tmp_path)), skewed.limit(30), "in order")
    assert sorted(x.name for x in (tmp_path / "tail").iterdir() if x.is_dir()) == ["batch_id=1", "batch_id=2"]
