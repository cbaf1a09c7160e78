"""Streaming queries: the events table is read as a file stream and every available file is processed."""

from pyspark.sql import functions as F

from contract import data as d
from contract import model_file
from contract.spark_side import r6
from contract.sql_side import SERVING, SOE, w
from contract.sql_side import r6 as sql_r6
from plantpulse.operators import attribution, drift, features, policy, tree_model
from plantpulse.params import DEFAULTS
from plantpulse.schemas import BUFFER, DEVICE, DROP, EPOCH_MS, FRAMES, PROTOCOL, ROW_ID
from plantpulse.session import scratch_folder
from plantpulse.sources import tables
from plantpulse.streaming import live, merged


def _frames(spark, sf):
    return d.frames(spark, sf, d.event_stream(spark, sf))


def _start(writer, spark):
    query = writer.option("checkpointLocation", scratch_folder(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()


def drain(stream, spark):
    """Process everything available and return the result as a table."""
    path = scratch_folder(spark, "out")
    _start(stream.writeStream.format("parquet").option("path", path), spark)
    return spark.read.schema(stream.schema).parquet(path)


def a9(spark, sf):
    """The second consumer is down during the stream and gets what it missed afterwards."""
    path, retry = scratch_folder(spark, "fan-out"), scratch_folder(spark, "retry")

    def down(batch, batch_id):
        raise RuntimeError("this consumer is down")

    sinks = {"first": lambda b, i: b.write.mode("overwrite").parquet(f"{path}/first/batch_id={i}"), "second": down}
    handler = live.fan_out(sinks, retry)
    _start(_frames(spark, sf).writeStream.foreachBatch(handler), spark)
    live.replay_failed(
        spark, retry, "second", lambda b, i: b.select(PROTOCOL).write.mode("overwrite").parquet(f"{path}/second/batch_id={i}"))
    parts = [
        spark.read.parquet(f"{path}/{name}").groupBy(PROTOCOL).agg(F.count(F.lit(1)).alias("n")).withColumn("sink", F.lit(name))
        for name in ("first", "second")
    ]
    return parts[0].unionByName(parts[1])


def l1(spark, sf):
    return r6(drain(_frames(spark, sf), spark))


def l2(spark, sf):
    out = drain(live.rolling_features(_frames(spark, sf)), spark)
    return r6(out.select(
        ROW_ID, "throughput_mean", "packet_drop_mean", "buffer_peak", "throughput_slope", "lag_latency_1", "lag_latency_2", "samples_in_window", "late"
    ))


def _merged(handler_of, spark, sf):
    """Folder in which a handler of amended results has worked off the stream."""
    path = scratch_folder(spark, "merged")
    merged.drained(handler_of(path), _frames(spark, sf), scratch_folder(spark, "stream"))
    return path


def l2_merged(spark, sf):
    """Late frames take their place: each later frame that looks back on them is amended."""
    out = merged.newest(spark.read.parquet(_merged(merged.feature_changes, spark, sf) + "/changes"))
    return r6(out.select(ROW_ID, "throughput_mean", "packet_drop_mean", "buffer_peak", "throughput_slope", "lag_latency_1", "lag_latency_2", "samples_in_window"))


def l3_model(spark, sf):
    """The stored model in the stream: amended features, forecast, the model's own attributions, diagnosis."""
    scorer = tree_model.scorer(model_file.model(spark))
    chain = lambda rows: policy.diagnose(policy.explained(features.serving_features(rows), scorer), "attributions")
    out = merged.newest(spark.read.parquet(_merged(lambda path: merged.changes_of(chain, path, DEFAULTS.window_rows + 1), spark, sf) + "/changes"))
    return r6(out.select(ROW_ID, policy.PRED, "risk_level", F.element_at("attributions", BUFFER).alias("buffer_ms"),
                         F.element_at("attributions", DROP).alias("drop_ms"), F.element_at("attributions", attribution.BIAS).alias("bias_ms")))


def l5_log_merged(spark, sf):
    """Two chained stages: policy cycles with their look-back, and the event log behind them, with its texts."""
    return merged.current_log(spark, _merged(merged.log_changes, spark, sf))


def scoring(frames):
    """Chained behind the rolling features: raw frames to diagnosis in one stream. Late frames have no rolling features,
    but forecast, risk and action need none: they are scored too, and ``late`` tells which they are."""
    return live.scored(live.rolling_features(frames)).select(ROW_ID, policy.PRED, "risk_level", "mitigation_action", "late")


def l3(spark, sf):
    return drain(scoring(_frames(spark, sf)).drop("late"), spark)


def l4(spark, sf):
    base, _ = d.drift_sides(spark, sf)
    edges = drift.baseline_edges(drift.long_form(base))
    path = scratch_folder(spark, "drift")
    stream = d.shifted(_frames(spark, sf))
    _start(stream.writeStream.foreachBatch(live.drift_batches(edges, path)), spark)
    return live.merged_drift(edges, spark.read.parquet(path))


def l5_debounce(spark, sf):
    out = drain(live.debounced(d.commands(spark, sf, d.event_stream(spark, sf))), spark)
    return r6(out.select(ROW_ID, "status", "retry_after_sec"))


def l5_log(spark, sf):
    rows = policy.apply_policy(_frames(spark, sf).withColumn("throughput_slope", F.lit(0.0)))
    out = live.event_log(rows.select(DEVICE, EPOCH_MS, ROW_ID, DROP, "failover_active", "mitigation_active", policy.PRED))
    return drain(out, spark).where("not late").drop("late")


def l6(spark, sf):
    out = drain(live.dead_mans_switch(d.compressed(_frames(spark, sf), d.HEARTBEAT_SPEED_UP)), spark)
    return r6(out)


def l7(spark, sf):
    path = scratch_folder(spark, "counters")
    _start(_frames(spark, sf).writeStream.foreachBatch(live.counter_batches(path)), spark)
    out = live.merged_counters(spark.read.parquet(path))
    return r6(out.withColumn("window_start", F.unix_millis("window_start")))


def l8(spark, sf):
    path = scratch_folder(spark, "centroids")
    _start(_frames(spark, sf).writeStream.foreachBatch(live.centroid_batches(spark, path)), spark)
    return r6(live.newest_centroids(spark, path))


def l9(spark, sf):
    path = scratch_folder(spark, "log")
    _start(live.persist_stream(_frames(spark, sf), path, scratch_folder(spark, "ckpt")), spark)
    return r6(tables.replay_frames(spark, path, FRAMES))


QUERIES = {
    "A9_fan_out": a9, "L1_stream_frames": l1, "L2_stream_features": l2, "L3_stream_scoring": l3, "L4_stream_drift": l4,
    "L5_stream_debounce": l5_debounce, "L5_stream_event_log": l5_log, "L6_stream_heartbeat": l6,
    "L2_stream_features_merged": l2_merged, "L3_stream_model_diagnosis": l3_model, "L5_stream_event_log_merged": l5_log_merged,
    "L7_stream_counters": l7, "L8_stream_centroids": l8, "L9_stream_replay": l9,
}

SQL = {
    "L2_stream_features_merged": w(SERVING, f"select event_id, {sql_r6('throughput_mean', 'packet_drop_mean', 'buffer_peak', 'throughput_slope', 'lag_latency_1', 'lag_latency_2')}, samples_in_window from feat"),
    "L3_stream_model_diagnosis": model_file.SQL["P2_model_diagnosis"],
    "L5_stream_event_log_merged": w(SOE, "select device_id, timestamp_epoch_ms, event_id, tag, alarm_id, priority, quality, event from soe"),
}
