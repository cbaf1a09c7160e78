"""Streams whose results are amended: batch operators over state tables, one version per micro-batch.

A micro-batch is joined with the rows its operators look back on and goes through the same operators as a batch table, so a
device with most of the rows is cut into blocks as it is there and no task sees a whole key. Every micro-batch writes, below
one folder and under its own id, the rows it got, the rows whose results it makes or alters (change log), and the newest
rows per key (tail). A micro-batch that is run again writes the same files.

Rows may come in any order. A key whose rows all come after what is known reads its tail only. For a key with a late row the
rows around it are read from the kept rows, and the later rows that look back on it are emitted anew. ``newest`` of the
change log is then what the batch operator gives for all rows together, whatever the split into files was."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plantpulse.operators import alarms, policy
from plantpulse.operators.features import last_n, serving_features
from plantpulse.operators.series import open_series
from plantpulse.params import DEFAULTS
from plantpulse.schemas import DEVICE, DROP, EPOCH_MS, ROW_ID
from plantpulse.session import remove

BATCH, NEW, TOUCHED = "batch_id", "_new", "_touched"
ORDER = (EPOCH_MS, ROW_ID)


def place(order=ORDER):
    return F.struct(*[F.col(c) for c in order])


def read_batches(spark, path, schema, below=None, only=None):
    """Rows of all micro-batches, of those before ``below``, or of one; an empty table when nothing was written yet."""
    try:
        rows = spark.read.schema(f"{schema}, {BATCH} long").parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], f"{schema}, {BATCH} long")
    if below is not None:
        return rows.where(F.col(BATCH) < below)
    return rows if only is None else rows.where(F.col(BATCH) == only)


def ddl(df):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def changes_of(operator, path, lookback, keys=(DEVICE,), order=ORDER, p=DEFAULTS):
    """``foreachBatch`` handler. ``operator`` is a batch operator that adds columns to its rows and looks at most
    ``lookback`` rows of the key back. The change log is written below ``path/changes``."""
    keys = list(keys)

    def handle(batch, batch_id):
        spark, schema = batch.sparkSession, ddl(batch)
        batch.write.mode("overwrite").parquet(f"{path}/rows/{BATCH}={batch_id}")
        rows = spark.read.schema(schema).parquet(f"{path}/rows/{BATCH}={batch_id}")
        tail = read_batches(spark, f"{path}/tail", schema, only=batch_id - 1).drop(BATCH)
        first = rows.groupBy(*keys).agg(F.min(place(order)).alias("_first"))
        newest = tail.groupBy(*keys).agg(F.max(place(order)).alias("_newest"))
        late = first.join(newest, keys).where(F.col("_first") <= F.col("_newest")).select(*keys, "_first")

        # Of late keys: the rows from the look-back of the first late row on.
        kept = read_batches(spark, f"{path}/rows", schema, below=batch_id).drop(BATCH).join(late, keys)
        before = last_n(kept.where(place(order) < F.col("_first")).drop("_first"), lookback, keys, order).drop("recency")
        around = before.unionByName(kept.where(place(order) >= F.col("_first")).drop("_first"))
        known = tail.join(first, keys, "left_semi").join(late, keys, "left_anti").unionByName(around)

        both = known.withColumn(NEW, F.lit(False)).unionByName(rows.withColumn(NEW, F.lit(True)))
        s = open_series(both, keys, *order, lookback, p.max_group_rows)
        touched = F.max(F.col(NEW)).over(s.window.rowsBetween(-lookback, Window.currentRow))
        whole = s.close(s.df.withColumn(TOUCHED, touched))
        operator(whole).where(TOUCHED).drop(NEW, TOUCHED).write.mode("overwrite").parquet(f"{path}/changes/{BATCH}={batch_id}")

        ends = both.drop(NEW).unionByName(tail.join(first, keys, "left_anti"))
        last_n(ends, lookback, keys, order).drop("recency").write.mode("overwrite").parquet(f"{path}/tail/{BATCH}={batch_id}")
        # The tail before the last is needed no more: a repeated batch starts from the last.
        remove(spark, f"{path}/tail/{BATCH}={batch_id - 2}")

    return handle


def newest(changes, ids=(ROW_ID,)):
    """Of each row the result of the latest micro-batch that made or altered it."""
    columns = [c for c in changes.columns if c not in (*ids, BATCH)]
    return changes.groupBy(*ids).agg(F.max_by(F.struct(*columns), BATCH).alias("r")).select(*ids, "r.*")


def feature_changes(path, p=DEFAULTS):
    """Serving features of frames in any order."""
    return changes_of(lambda rows: serving_features(rows, p), path, p.window_rows + 1, p=p)


def cycle_changes(path, scorer=policy.analytic_score, p=DEFAULTS, lookback=8):
    """Replayed policy cycles with their console look-back (five rows for the peak, two for the lags)."""
    return changes_of(lambda rows: policy.replay(rows, scorer, p), path, lookback, p=p)


# --- event log behind the cycles ---------------------------------------------------------------------------

CYCLE = [DEVICE, *ORDER, DROP, "failover_active", "mitigation_active", policy.PRED]


def log_changes(path, scorer=policy.analytic_score, p=DEFAULTS):
    """``foreachBatch`` handler of two chained stages: policy cycles, and the event log that follows from them. The log of a
    device is written anew from its earliest altered cycle on; the tag before that is the state it starts from."""
    cycles_of = cycle_changes(path, scorer, p)

    def handle(batch, batch_id):
        spark = batch.sparkSession
        cycles_of(batch, batch_id)
        cycles = spark.read.parquet(f"{path}/changes/{BATCH}={batch_id}").select(*CYCLE)
        schema = ddl(cycles)
        since = cycles.groupBy(DEVICE).agg(F.min(place()).alias("since"))
        past = read_batches(spark, f"{path}/changes", schema, below=batch_id)
        ended = read_batches(spark, f"{path}/log_tail", LOG_TAIL, only=batch_id - 1).drop(BATCH)
        # Cycles after the altered ones matter to the log of devices with late rows only.
        late = since.join(ended, DEVICE).where(F.col("since") <= F.col("newest")).select(DEVICE, "since")
        after = newest(past.join(late, DEVICE).where(place() >= F.col("since")).drop("since"), (DEVICE, *ORDER))
        run = cycles.unionByName(after.join(cycles, [DEVICE, *ORDER], "left_anti").select(*cycles.columns))

        log_before = current_log(spark, path, batch_id).join(late, DEVICE).where(place() < F.col("since"))
        entry = ended.join(since, DEVICE, "left_semi").join(late, DEVICE, "left_anti").select(DEVICE, "tag", F.col("newest").alias("at")).where(
            F.col("tag").isNotNull()).unionByName(log_before.groupBy(DEVICE).agg(F.max_by("tag", place()).alias("tag"), F.max(place()).alias("at")))
        # A cycle with the one flag of a tag leaves the log in that tag, whatever was before.
        states = entry.select(
            DEVICE, F.col(f"at.{EPOCH_MS}").alias(EPOCH_MS), F.lit(-1).cast("long").alias(ROW_ID), F.lit(0.0).alias(DROP),
            (F.col("tag") == TAGS[0]).alias("failover_active"), (F.col("tag") == TAGS[1]).alias("mitigation_active"),
            F.when(F.col("tag") == TAGS[2], F.lit(p.sla_latency_ms)).otherwise(F.lit(0.0)).alias(policy.PRED))
        log = alarms.sequence_of_events(run.unionByName(states), p=p).where(F.col(ROW_ID) >= 0)
        log.write.mode("overwrite").parquet(f"{path}/log/{BATCH}={batch_id}")
        since.write.mode("overwrite").parquet(f"{path}/since/{BATCH}={batch_id}")

        written = spark.read.parquet(f"{path}/log/{BATCH}={batch_id}").groupBy(DEVICE).agg(F.max_by("tag", place()).alias("tag"))
        ends = run.groupBy(DEVICE).agg(F.max(place()).alias("newest")).join(written, DEVICE, "left").join(
            entry.select(DEVICE, F.col("tag").alias("_entry")), DEVICE, "left").select(DEVICE, "newest", F.coalesce("tag", "_entry").alias("tag"))
        ends = ends.unionByName(ended.join(since, DEVICE, "left_anti"))
        ends.write.mode("overwrite").parquet(f"{path}/log_tail/{BATCH}={batch_id}")
        remove(spark, f"{path}/log_tail/{BATCH}={batch_id - 2}")

    return handle


TAGS = [tag for tag, *_ in alarms.EVENTS]
LOG = f"{DEVICE} string, {EPOCH_MS} long, {ROW_ID} long, tag string, alarm_id string, priority string, quality string, event string"
PLACE = f"struct<{EPOCH_MS}: bigint, {ROW_ID}: bigint>"
LOG_TAIL = f"{DEVICE} string, newest {PLACE}, tag string"


def current_log(spark, path, below=None):
    """The event log after all micro-batches, or after those before ``below``: an event counts unless a later micro-batch wrote the
    log of its device anew from that place or an earlier one on."""
    log = read_batches(spark, f"{path}/log", LOG, below)
    since = read_batches(spark, f"{path}/since", f"{DEVICE} string, since {PLACE}", below).select(DEVICE, "since", F.col(BATCH).alias("_later"))
    # Per device and micro-batch the earliest place from which any later one wrote anew.
    versions = since.select(DEVICE, F.col("_later").alias(BATCH)).join(since, DEVICE).where(F.col("_later") > F.col(BATCH)).groupBy(
        DEVICE, BATCH).agg(F.min("since").alias("_redone"))
    kept = log.join(versions, [DEVICE, BATCH], "left").where(F.col("_redone").isNull() | (place() < F.col("_redone")))
    return kept.drop("_redone", BATCH)


def drained(handler, stream, checkpoint):
    """Run everything that is available through a handler."""
    stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


