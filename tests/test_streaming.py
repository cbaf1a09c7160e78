"""Streaming results equal batch results."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from contract import data as d
from contract import live_side
from plantpulse.functions.numbers import dp
from plantpulse.operators import alarms, control, drift, features, policy, regimes
from plantpulse.schemas import DEVICE, DROP, EPOCH_MS, FRAMES, PROTOCOL, ROW_ID, RTT, TEMP
from plantpulse.sources import tables
from plantpulse.streaming import live


@pytest.fixture(scope="module")
def frames(spark, sf):
    return d.frames(spark, sf).cache()


@pytest.fixture(scope="module")
def folder(spark, frames, tmp_path_factory):
    """Frames in time order, as three files for three triggers."""
    path = str(tmp_path_factory.mktemp("stream") / "in")
    cuts = frames.agg(F.percentile(EPOCH_MS, F.array(F.lit(0.33), F.lit(0.66))).alias("q")).first()["q"]
    parts = [frames.where(F.col(EPOCH_MS) < cuts[0]), frames.where(F.col(EPOCH_MS).between(*cuts)), frames.where(F.col(EPOCH_MS) > cuts[1])]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def run(stream, spark, tmp_path, mode="append", handler=None):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    writer = stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True).outputMode(mode)
    if handler:
        query = writer.foreachBatch(handler).start()
    else:
        query = writer.format("parquet").option("path", out).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return None if handler else spark.read.parquet(out)


def source(spark, folder, schema=FRAMES):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_rolling_features_equal_batch(spark, frames, folder, tmp_path):
    got = run(live.rolling_features(source(spark, folder)), spark, tmp_path)
    assert got.where("late").isEmpty()
    want = features.serving_features(frames)
    cols = [ROW_ID, "samples_in_window"] + [
        dp(F.col(c), 6) for c in ("throughput_mean", "packet_drop_mean", "buffer_peak", "lag_latency_1", "lag_latency_2")
    ]
    assert rows(got, *cols) == rows(want, *cols)
    joined = got.select(ROW_ID, "throughput_slope").join(want.select(ROW_ID, F.col("throughput_slope").alias("s")), ROW_ID)
    assert joined.where(F.abs(F.col("s") - F.col("throughput_slope")) > 1.5e-4).isEmpty()


def test_late_frames_are_marked(spark, tmp_path):
    def row(i, t):
        return ("N", "mqtt", i, t, 50.0, 0.1, 30.0, 40.0, 41.0, "c")

    path = str(tmp_path / "in")
    for r in (row(1, 1000), row(2, 3000)), (row(3, 2000), row(4, 4000)):
        spark.createDataFrame(list(r), FRAMES).coalesce(1).write.mode("append").parquet(path)
    got = run(live.rolling_features(source(spark, path)), spark, tmp_path)
    assert rows(got, ROW_ID, "late") == [(1, False), (2, False), (3, True), (4, False)]


def test_scoring_equals_batch(spark, frames, folder, tmp_path):
    got = run(live.scored(live.frame_stream(source(spark, folder))).select(ROW_ID, policy.PRED, "risk_level", "mitigation_action"), spark, tmp_path)
    want = policy.diagnose(policy.score(frames))
    cols = (ROW_ID, policy.PRED, "risk_level", "mitigation_action")
    assert rows(got, *cols) == rows(want, *cols)


def test_debounce_equals_batch(spark, sf, tmp_path):
    commands = d.commands(spark, sf)
    path = str(tmp_path / "in")
    cut = commands.agg(F.percentile(EPOCH_MS, 0.5)).first()[0]
    for part in (commands.where(F.col(EPOCH_MS) < cut), commands.where(F.col(EPOCH_MS) >= cut)):
        part.coalesce(1).write.mode("append").parquet(path)
    got = run(live.debounced(source(spark, path, commands.schema)), spark, tmp_path)
    cols = (ROW_ID, "status", "retry_after_sec")
    assert rows(got, *cols) == rows(control.debounce(commands), *cols)


def test_event_log_equals_batch(spark, frames, tmp_path):
    replayed = policy.replay(frames).select(DEVICE, EPOCH_MS, ROW_ID, DROP, "failover_active", "mitigation_active", policy.PRED)
    path = str(tmp_path / "in")
    cut = replayed.agg(F.percentile(EPOCH_MS, 0.5)).first()[0]
    for part in (replayed.where(F.col(EPOCH_MS) < cut), replayed.where(F.col(EPOCH_MS) >= cut)):
        part.coalesce(1).write.mode("append").parquet(path)
    got = run(live.event_log(source(spark, path, replayed.schema)), spark, tmp_path)
    assert rows(got, DEVICE, ROW_ID, "tag") == rows(alarms.sequence_of_events(replayed), DEVICE, ROW_ID, "tag")


def test_dead_mans_switch(spark, tmp_path):
    def row(i, dev, sec):
        return (dev, "mqtt", i, sec * 1000, 50.0, 0.1, 30.0, 40.0, 41.0, "c")

    path = str(tmp_path / "in")
    batches = [[row(1, "A", 0), row(2, "A", 10), row(3, "B", 5)], [row(4, "A", 40)], [row(5, "A", 120)], [row(6, "A", 121)]]
    for b in batches:
        spark.createDataFrame(b, FRAMES).coalesce(1).write.mode("append").parquet(path)
    got = run(live.dead_mans_switch(source(spark, path)), spark, tmp_path)
    found = rows(got, DEVICE, "last_ms", "kind")
    assert ("A", 10000, "gap") in found and ("A", 40000, "gap") in found
    assert ("B", 5000, "tripped") in found


def test_counters_with_watermark(spark, frames, folder, tmp_path):
    got = run(live.live_counters(source(spark, folder), "1 hour"), spark, tmp_path)
    hour = F.date_trunc("hour", F.timestamp_millis(EPOCH_MS)).alias("window_start")
    want = frames.groupBy(hour, PROTOCOL, DEVICE).agg(F.count(F.lit(1)).alias("frames_total"))
    cols = ("window_start", PROTOCOL, DEVICE, "frames_total")
    found, expected = set(rows(got, *cols)), set(rows(want, *cols))
    assert found <= expected
    last = frames.agg(F.max(EPOCH_MS)).first()[0]
    closed = {r for r in expected if r[0].timestamp() * 1000 + 3_600_000 + 31_000 < last}
    assert closed <= found


def test_drift_centroids_and_fan_out(spark, frames, folder, tmp_path):
    edges = drift.baseline_edges(drift.long_form(frames))
    base = str(tmp_path)
    failed = []

    def broken(batch, batch_id):
        raise RuntimeError("sink is down")

    sinks = {
        "drift": live.drift_batches(edges, f"{base}/drift"),
        "broken": broken,
        "centroids": live.centroid_batches(spark, f"{base}/centroids"),
        "copy": lambda b, i: b.write.mode("overwrite").parquet(f"{base}/copy/batch_id={i}"),
    }
    run(source(spark, folder), spark, tmp_path, handler=live.fan_out(sinks, f"{base}/retry", lambda n, i, e: failed.append((n, i))))
    assert failed == [("broken", 0), ("broken", 1), ("broken", 2)]
    waiting = lambda: sorted((r.consumer, r.batch_id, r.kind, r.message) for r in live.waiting_batches(spark, f"{base}/retry").collect())
    assert waiting() == [("broken", i, "RuntimeError", "sink is down") for i in range(3)]
    copy = lambda b, i: b.write.mode("overwrite").parquet(f"{base}/broken/batch_id={i}")
    with pytest.raises(RuntimeError):
        live.replay_failed(spark, f"{base}/retry", "broken", broken)
    assert len(waiting()) == 3
    live.replay_failed(spark, f"{base}/retry", "broken", copy)
    assert waiting() == []
    for _ in range(2):  # a second replay changes nothing
        live.replay_failed(spark, f"{base}/retry", "broken", copy, [i for _, i in failed])
    assert spark.read.parquet(f"{base}/broken").count() == frames.count()
    assert spark.read.parquet(f"{base}/copy").count() == frames.count()
    assert spark.read.parquet(f"{base}/drift").select("feature", "batch_id").distinct().count() == 12
    last = live.newest_centroids(spark, f"{base}/centroids")
    assert last.agg(F.sum("weight")).first()[0] == frames.count() + 3
    once = regimes.update_centroids(regimes.seed_centroids(spark), frames)
    assert once.agg(F.sum("weight")).first()[0] == frames.count() + 3


def test_persist_and_replay(spark, frames, folder, tmp_path):
    query = live.persist_stream(source(spark, folder), str(tmp_path / "log"), str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    back = tables.replay_frames(spark, str(tmp_path / "log"))
    assert rows(back, *[f.name for f in FRAMES.fields]) == rows(frames, *[f.name for f in FRAMES.fields])


@pytest.fixture(scope="module", params=["one file", "in order", "by hash"])
def layout(request, spark, frames, tmp_path_factory):
    """The same frames in one file, in three files in time order, and in three files by hash."""
    path = str(tmp_path_factory.mktemp("layout") / "in")
    third = {
        "one file": F.lit(0), "in order": F.ntile(3).over(Window.orderBy(EPOCH_MS, ROW_ID)) - 1,
        "by hash": F.pmod(F.hash(ROW_ID), F.lit(3)),
    }[request.param]
    split = frames.withColumn("part", third).cache()
    for part in range(3):
        rows_of_part = split.where(F.col("part") == part).drop("part")
        if not rows_of_part.isEmpty():
            rows_of_part.coalesce(1).write.mode("append").parquet(path)
    return request.param, path


def test_counters_do_not_depend_on_files(spark, frames, layout, tmp_path):
    run(source(spark, layout[1]), spark, tmp_path, handler=live.counter_batches(f"{tmp_path}/partial", "1 minute"))
    got = live.merged_counters(spark.read.parquet(f"{tmp_path}/partial"))
    want = frames.groupBy(F.date_trunc("minute", F.timestamp_millis(EPOCH_MS)).alias("window_start"), PROTOCOL, DEVICE).agg(
        F.count(F.lit(1)).alias("frames_total"), F.max(TEMP).alias("peak_temp"), F.max_by(RTT, F.struct(EPOCH_MS, ROW_ID)).alias("last_rtt_ms"))
    cols = ("window_start", PROTOCOL, DEVICE, "frames_total", "peak_temp", "last_rtt_ms")
    assert rows(got, *cols) == rows(want, *cols)


def test_drift_does_not_depend_on_files(spark, frames, layout, tmp_path):
    edges = drift.baseline_edges(drift.long_form(frames.where(F.col(ROW_ID) % 2 == 0)))
    run(source(spark, layout[1]), spark, tmp_path, handler=live.drift_batches(edges, f"{tmp_path}/counts"))
    got = live.merged_drift(edges, spark.read.parquet(f"{tmp_path}/counts"))
    assert rows(got, "feature", "n_current", "psi") == rows(drift.psi(edges, drift.long_form(frames)), "feature", "n_current", "psi")


def as_commands(df):
    """One shedding command per frame."""
    return df.select(
        F.col(DEVICE).alias("target_device"), EPOCH_MS, ROW_ID, F.lit("traffic_shedding").alias("action"),
        F.lit("eth0").alias("target_interface"), F.lit(0.8).alias("shedding_factor"), F.lit(None).cast("string").alias("standby_node"),
        F.lit(None).cast("double").alias("target_rate_mbps"),
        F.lit("r").alias("reason"), F.lit(False).alias("requires_approval"), F.lit(None).cast("string").alias("approved_by"))


def test_ordered_operators_account_for_every_row(spark, frames, layout, tmp_path):
    kind, path = layout
    feats = run(live.rolling_features(source(spark, path)), spark, tmp_path)
    assert feats.count() == frames.count() and live.late_rows(feats).isEmpty() == (kind != "by hash")
    if kind != "by hash":
        want = features.serving_features(frames).select(ROW_ID, dp(F.col("throughput_slope"), 4).alias("s"))
        assert rows(feats, ROW_ID, dp(F.col("throughput_slope"), 4)) == rows(want, ROW_ID, "s")
    commands, stream = as_commands(frames), as_commands(source(spark, path))
    decided = run(live.debounced(stream), spark, tmp_path / "debounce")
    assert decided.count() == commands.count()
    on_time = decided.where("not late")
    # What was accepted is what the batch operator says about the accepted commands.
    accepted = commands.join(on_time.select(ROW_ID), ROW_ID, "left_semi")
    assert rows(on_time, ROW_ID, "status", "retry_after_sec") == rows(control.debounce(accepted), ROW_ID, "status", "retry_after_sec")
    assert on_time.where("retry_after_sec > 5 or retry_after_sec < 0").isEmpty()


def test_event_log_marks_late_cycles(spark, frames, layout, tmp_path):
    kind, path = layout
    cols = [DEVICE, EPOCH_MS, ROW_ID, DROP, "failover_active", "mitigation_active", policy.PRED]
    cycles = policy.apply_policy(source(spark, path).withColumn("throughput_slope", F.lit(0.0))).select(*cols)
    log = run(live.event_log(cycles), spark, tmp_path)
    whole = policy.apply_policy(frames.withColumn("throughput_slope", F.lit(0.0))).select(*cols)
    late = live.late_rows(log)
    assert late.isEmpty() == (kind != "by hash")
    expected = alarms.sequence_of_events(whole.join(late.select(ROW_ID), ROW_ID, "left_anti"))
    assert rows(log.where("not late"), DEVICE, ROW_ID, "tag") == rows(expected, DEVICE, ROW_ID, "tag")


def test_late_frames_are_scored_too(spark, frames, layout, tmp_path):
    kind, path = layout
    got = run(live_side.scoring(source(spark, path)), spark, tmp_path)
    late = live.late_rows(got).count()
    assert (late == 0) == (kind != "by hash") and got.where("not late").count() + late == frames.count()
    cols = (ROW_ID, policy.PRED, "risk_level", "mitigation_action")
    assert rows(got, *cols) == rows(policy.diagnose(policy.score(frames)), *cols)
