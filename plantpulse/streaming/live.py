"""Structured Streaming forms of the operators.

Row rules, validation and scoring are the same column functions as in batch. Operators that look back keep a small
state per key: the last frames, the last applied command, the last logged tag, the last heartbeat. A trigger must
bound its input (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``): the rows of one key in one trigger are ordered
in one task. Rows older than the state of their key are marked late and change nothing; ``late_rows`` of a result
are its side table. Counters and drift keep mergeable partial results per micro-batch, so that neither the order of
the rows nor their split into files changes a result."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from plantpulse.functions.numbers import dp
from plantpulse.operators import alarms, control, drift, policy, prep, regimes
from plantpulse.operators.alarms import EVENTS
from plantpulse.params import DEFAULTS
from plantpulse.schemas import BUFFER, DEVICE, DROP, EPOCH_MS, FRAMES, GAUGES, PROTOCOL, ROW_ID, RTT, TEMP, THROUGHPUT
from plantpulse.session import remove

FRAME_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FRAMES.fields)


def frame_stream(raw):
    """Decoded raw frames to canonical frames."""
    return prep.canonical(prep.valid_frames(raw))


def _ordered(batches, order):
    return pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


BEFORE_ALL = (-(1 << 62), -(1 << 62))


def _late(pdf, last_ms, last_id):
    """Rows that do not come after the last accepted row of their key."""
    return (pdf[EPOCH_MS] < last_ms) | ((pdf[EPOCH_MS] == last_ms) & (pdf[ROW_ID] <= last_id))


def _slopes(values, rows):
    """Least-squares slope of the last ``rows`` values at every position."""
    series, at = pd.Series(values), pd.Series(np.arange(len(values), dtype="float64"))
    window = series.rolling(rows, min_periods=3)
    return (window.cov(at) / at.rolling(rows, min_periods=3).var()).fillna(0.0).to_numpy()


def rolling_features(frames, p=DEFAULTS):
    """Serving features for every frame as it arrives; ``late`` marks frames that came out of order."""
    rows = p.window_rows
    kept = [THROUGHPUT, DROP, BUFFER, RTT]

    def step(key, batches, state):
        pdf = _ordered(batches, [EPOCH_MS, ROW_ID])
        if state.exists:
            *history, last_ms, last_id = state.get
            past = pd.DataFrame(dict(zip(kept, map(list, history))))
        else:
            past, (last_ms, last_id) = pd.DataFrame({c: [] for c in kept}, dtype="float64"), BEFORE_ALL
        late = _late(pdf, last_ms, last_id)
        fresh = pdf[~late].reset_index(drop=True)
        whole = pd.concat([past, fresh[kept]], ignore_index=True).astype("float64")
        n = len(past)
        span = whole.rolling(rows, min_periods=1)
        lag1 = whole[RTT].shift(1).fillna(whole[RTT])
        lag2 = whole[RTT].shift(2).fillna(lag1)
        out = fresh.assign(
            throughput_mean=span[THROUGHPUT].mean()[n:].to_numpy(),
            packet_drop_mean=span[DROP].mean()[n:].to_numpy(),
            buffer_peak=span[BUFFER].max()[n:].to_numpy(),
            throughput_slope=_slopes(whole[THROUGHPUT].to_numpy(), rows)[n:],
            lag_latency_1=lag1[n:].to_numpy(),
            lag_latency_2=lag2[n:].to_numpy(),
            samples_in_window=np.minimum(np.arange(n, len(whole)) + 1, rows).astype("int32"),
            late=False,
        )
        if len(fresh):
            tail = whole.tail(rows)
            end = fresh.iloc[-1]
            state.update((*[tail[c].tolist() for c in kept], int(end[EPOCH_MS]), int(end[ROW_ID])))
        yield pd.concat([out, pdf[late].assign(late=True)], ignore_index=True).reindex(columns=columns)

    extra = (
        "throughput_mean double, packet_drop_mean double, buffer_peak double, throughput_slope double, "
        "lag_latency_1 double, lag_latency_2 double, samples_in_window int, late boolean"
    )
    columns = [f.name for f in FRAMES.fields] + [e.strip().split()[0] for e in extra.split(",")]
    state = ", ".join(f"{c} array<double>" for c in kept) + ", last_ms long, last_id long"
    out = frames.groupBy(DEVICE).applyInPandasWithState(
        step, f"{FRAME_DDL}, {extra}", state, "append", GroupStateTimeout.NoTimeout
    )
    return out.withColumn("throughput_slope", dp(F.col("throughput_slope"), 4))


def late_rows(result):
    """Side table of the rows that came too late to count, of a result with a ``late`` column."""
    return result.where("late")


def scored(features, scorer=policy.analytic_score, p=DEFAULTS):
    """Regime, forecast, attributions and diagnosis of feature rows; no state."""
    return policy.diagnose(policy.explained(features, scorer), "attributions", p)


def debounced(commands, p=DEFAULTS, key="target_device"):
    """Status of every command; state is the time of the last applied command and the place of the last command.
    A command older than that place is ``late``: it has no status and no effect."""
    wait = int(round(p.debounce_sec * 1000))
    rows = control.resolve(commands, p)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = rows.columns + ["status", "retry_after_sec", "late"]

    def step(key_, batches, state):
        every = _ordered(batches, [EPOCH_MS, ROW_ID])
        last, last_ms, last_id = state.get if state.exists else (control.NEVER, *BEFORE_ALL)
        behind = _late(every, last_ms, last_id)
        pdf = every[~behind].reset_index(drop=True)
        ts = pdf[EPOCH_MS].to_numpy("int64")
        free = (pdf["supported"] & ~pdf["awaits_approval"]).to_numpy()
        free_rows = np.flatnonzero(free)
        distinct, first = np.unique(ts[free_rows], return_index=True)
        applied = free_rows[first[control.applied_positions(distinct, wait, last)]]
        before = np.concatenate([[last], ts[applied]])[np.searchsorted(applied, np.arange(len(ts)), side="left")]
        limited = ts - before < wait
        status = np.where(
            limited, control.LIMITED,
            np.where(pdf["awaits_approval"], control.PENDING, np.where(pdf["supported"], control.APPLIED, control.REJECTED)),
        )
        if len(pdf):
            end = pdf.iloc[-1]
            state.update((int(ts[applied[-1]]) if len(applied) else int(last), int(end[EPOCH_MS]), int(end[ROW_ID])))
        left = np.where(limited, (wait - (ts - before)) / 1000.0, np.nan)
        if len(pdf):
            yield pdf.assign(status=status, retry_after_sec=left, late=False)[names]
        if behind.any():
            yield every[behind].assign(status=None, retry_after_sec=np.nan, late=True)[names]

    out = rows.groupBy(key).applyInPandasWithState(
        step, f"{ddl}, status string, retry_after_sec double, late boolean", "last long, last_ms long, last_id long", "append",
        GroupStateTimeout.NoTimeout,
    )
    return out.withColumn("retry_after_sec", dp(F.nanvl("retry_after_sec", F.lit(None).cast("double")), 2))


def event_log(replayed, p=DEFAULTS):
    """Logged tag per cycle; state is the last logged tag and the place of the last cycle. Takes the columns that the
    batch log takes. A cycle older than that place is ``late``: it is listed without a tag and changes nothing."""
    code = (
        F.col("failover_active").cast("int") + F.col("mitigation_active").cast("int") * 2
        + (F.col(policy.PRED) >= p.sla_latency_ms).cast("int") * 4
    )
    rows = replayed.select(DEVICE, EPOCH_MS, ROW_ID, code.alias("code")).where("code > 0")
    tags = [None] + [e[0] for e in EVENTS]

    def step(key, batches, state):
        every = _ordered(batches, [EPOCH_MS, ROW_ID])
        entry, last_ms, last_id = state.get if state.exists else (alarms.OTHER, *BEFORE_ALL)
        behind = _late(every, last_ms, last_id)
        pdf = every[~behind].reset_index(drop=True)
        place = [DEVICE, EPOCH_MS, ROW_ID]
        if len(pdf):
            after = alarms.state_maps(pdf["code"].to_numpy())[:, entry]
            before = np.concatenate([[entry], after[:-1]])
            end = pdf.iloc[-1]
            state.update((int(after[-1]), int(end[EPOCH_MS]), int(end[ROW_ID])))
            hit = after != before
            if hit.any():
                yield pdf[hit][place].assign(tag=[tags[i] for i in after[hit]], late=False)
        if behind.any():
            yield every[behind][place].assign(tag=None, late=True)

    return rows.groupBy(DEVICE).applyInPandasWithState(
        step, f"{DEVICE} string, {EPOCH_MS} long, {ROW_ID} long, tag string, late boolean",
        "state int, last_ms long, last_id long", "append", GroupStateTimeout.NoTimeout,
    )


def dead_mans_switch(frames, p=DEFAULTS):
    """A row per silence: ``gap`` when a frame ends it, ``tripped`` when the watermark passes the timeout."""
    limit = int(p.heartbeat_timeout_sec * 1000)
    timed = frames.select(DEVICE, EPOCH_MS, F.timestamp_millis(EPOCH_MS).alias("event_time")).withWatermark(
        "event_time", f"{p.watermark_sec} seconds"
    )

    def step(key, batches, state):
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({DEVICE: [key[0]], "last_ms": [last], "kind": ["tripped"], "gap_ms": [None]})
            return
        times = np.sort(np.concatenate([b[EPOCH_MS].to_numpy("int64") for b in batches]))
        if state.exists:
            times = np.concatenate([[state.get[0]], times[times > state.get[0]]])
        gaps = np.diff(times)
        wide = gaps > limit
        last = int(times[-1])
        state.update((last,))
        state.setTimeoutTimestamp(max(last + limit + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {DEVICE: key[0], "last_ms": times[:-1][wide], "kind": "gap", "gap_ms": gaps[wide].astype("float64")}
        )

    return timed.groupBy(DEVICE).applyInPandasWithState(
        step, f"{DEVICE} string, last_ms long, kind string, gap_ms double", "last long", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def live_counters(frames, width="1 second", slide=None, p=DEFAULTS):
    """Counts and gauges per event-time window, protocol and device."""
    timed = frames.withColumn("event_time", F.timestamp_millis(EPOCH_MS)).withWatermark(
        "event_time", f"{p.watermark_sec} seconds"
    )
    window = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return timed.groupBy(window.alias("w"), PROTOCOL, DEVICE).agg(
        F.count(F.lit(1)).alias("frames_total"), F.max(TEMP).alias("peak_temp"),
        F.max_by(RTT, F.struct(EPOCH_MS, ROW_ID)).alias("last_rtt_ms"),
    ).select(F.col("w.start").alias("window_start"), PROTOCOL, DEVICE, "frames_total", "peak_temp", "last_rtt_ms")


def counter_batches(path, width="1 second", slide=None):
    """``foreachBatch`` handler: partial counters of each micro-batch. No row is too late for them; read the
    totals with ``merged_counters``."""

    def handle(batch, batch_id):
        at = F.timestamp_millis(EPOCH_MS)
        window = F.window(at, width, slide) if slide else F.window(at, width)
        partial = batch.groupBy(window.alias("w"), PROTOCOL, DEVICE).agg(
            F.count(F.lit(1)).alias("frames_total"), F.max(TEMP).alias("peak_temp"), F.max(F.struct(EPOCH_MS, ROW_ID, RTT)).alias("last"))
        partial.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return handle


def merged_counters(partials):
    """Counters per window from the partial counters of all micro-batches."""
    whole = partials.groupBy("w", PROTOCOL, DEVICE).agg(
        F.sum("frames_total").alias("frames_total"), F.max("peak_temp").alias("peak_temp"), F.max("last").alias("last"))
    return whole.select(F.col("w.start").alias("window_start"), PROTOCOL, DEVICE, "frames_total", "peak_temp",
                        F.col(f"last.{RTT}").alias("last_rtt_ms"))


def drift_batches(edges, path):
    """``foreachBatch`` handler: bucket counts of each micro-batch against the stored edges."""

    def handle(batch, batch_id):
        counts = drift.bucket_counts(drift.long_form(batch), edges).drop("edges")
        counts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return handle


def merged_drift(edges, counts, p=DEFAULTS):
    """Drift of everything the micro-batches have counted so far; features with too few rows are left out."""
    scores = drift.psi_of_counts(edges, drift.merge_counts(counts)).where(F.col("n_current") >= drift.MIN_CURRENT)
    return scores.withColumns(
        {"drift_detected": F.col("psi") > p.psi_threshold, "drift_band": drift.drift_band(F.col("psi"))})


def centroid_batches(spark, path, cols=tuple(GAUGES)):
    """``foreachBatch`` handler: move the centroids by each micro-batch. Every batch writes its own version and
    starts from the one before, so a batch that is run again gives the same result."""

    def handle(batch, batch_id):
        state = (
            regimes.seed_centroids(spark) if batch_id == 0 else spark.read.parquet(f"{path}/version={batch_id - 1}")
        )
        regimes.update_centroids(state, batch, cols).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/version={batch_id}"
        )

    return handle


def newest_centroids(spark, path):
    """State after the last micro-batch."""
    versions = spark.read.parquet(path)
    return versions.where(F.col("version") == versions.agg(F.max("version")).first()[0]).drop("version")


WAITING = "waiting-batches"


def fan_out(sinks, retry_path, on_error=None):
    """``foreachBatch`` handler: one read of the batch, several consumers ``(batch, batch_id)``. A consumer that
    fails does not stop the others: the batch is kept for it below ``retry_path``, and what went wrong is recorded
    beside it (see ``waiting_batches`` and ``replay_failed``). If that fails too, the whole batch fails and is run again."""

    def handle(batch, batch_id):
        batch.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(batch, batch_id)
                except Exception as error:
                    batch.write.mode("overwrite").parquet(f"{retry_path}/{name}/batch_id={batch_id}")
                    note = batch.sparkSession.createDataFrame(
                        [(name, batch_id, type(error).__name__, str(error)[:1000])], "consumer string, batch_id long, kind string, message string")
                    note.coalesce(1).write.mode("overwrite").parquet(f"{retry_path}/{WAITING}/{name}-{batch_id}")
                    if on_error:
                        on_error(name, batch_id, error)
        finally:
            batch.unpersist()

    return handle


def waiting_batches(spark, retry_path):
    """Batches that a consumer has missed: ``(consumer, batch_id, kind, message)`` with the error of each."""
    schema = "consumer string, batch_id long, kind string, message string"
    try:
        return spark.read.schema(schema).parquet(f"{retry_path}/{WAITING}/*")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def replay_failed(spark, retry_path, name, sink, batch_ids=None):
    """Give a consumer the batches that it missed, in order; batch ids make a repeated replay harmless. Without a list, all
    that wait; a batch that the consumer has taken waits no more."""
    if batch_ids is None:
        waiting = waiting_batches(spark, retry_path).where(F.col("consumer") == name).select("batch_id").distinct()
        batch_ids = [r.batch_id for r in waiting.orderBy("batch_id").toLocalIterator()]
    for batch_id in batch_ids:
        sink(spark.read.parquet(f"{retry_path}/{name}/batch_id={batch_id}"), batch_id)
        remove(spark, f"{retry_path}/{WAITING}/{name}-{batch_id}")


def persist_stream(frames, path, checkpoint):
    """Append a stream of frames to JSON-lines files; read back with ``sources.tables.replay_frames``."""
    return frames.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)

