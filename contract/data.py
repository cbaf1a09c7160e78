"""Telemetry tables derived from the driver's ``events`` table by a fixed column mapping."""

from pyspark.sql import functions as F

from plantpulse.functions.numbers import dp
from plantpulse.operators import control, policy, prep
from plantpulse.operators.series import largest_key
from plantpulse.schemas import BUFFER, DEVICE, DROP, EPOCH_MS, GAUGES, PROTOCOL, ROW_ID, RTT, TEMP, THROUGHPUT


def largest(spark, sf):
    """Rows of the largest device, an upper bound for every table derived from ``events``. Counted each time."""
    return largest_key(events(spark, sf), ["user_id"])


def events(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/events.parquet")


def event_stream(spark, sf):
    """The same table as a stream of files. The pattern matches one file as well as a folder of files."""
    return spark.readStream.schema(events(spark, sf).schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events.parque*")


def telemetry(spark, sf, source=None):
    """Raw frames: one device per user, gaps in throughput, some frames without a measured RTT."""
    # The one-element generator keeps `k` as a column; a projection would parse the text again for every use.
    k = F.explode(F.array(F.get_json_object("props", "$.k").cast("double")))
    eid = F.col("event_id")
    return (
        (events(spark, sf) if source is None else source)
        .withColumn("k", k)
        .select(
            F.concat(F.lit("NODE_"), F.col("user_id").cast("string")).alias(DEVICE),
            eid,
            F.unix_millis(F.col("ts").cast("timestamp")).alias(EPOCH_MS),
            F.when(F.col("event_type") == "click", "mqtt").when(F.col("event_type") == "view", "modbus_tcp")
            .when(F.col("event_type") == "purchase", "opcua").when(F.col("event_type") == "signup", "coap")
            .otherwise("s7").alias(PROTOCOL),
            F.when(eid % 17 != 0, F.col("value")).alias(THROUGHPUT),
            (F.col("k") * F.col("k") / 2000.0).alias(DROP),
            ((eid * 37 % 1001) / 10.0).alias(BUFFER),
            (40.0 + (eid * 13 % 301) / 10.0).alias(TEMP),
            F.when(F.col("event_type") != "error", 38.0 + F.col("k") * 0.3).alias(RTT),
            F.col("event_type"),
            F.col("k"),
        )
    )


RAW = [DEVICE, PROTOCOL, ROW_ID, EPOCH_MS, *GAUGES, RTT]


def frames(spark, sf, source=None):
    """Canonical frames."""
    return prep.canonical(prep.valid_frames(telemetry(spark, sf, source).select(*RAW)))


def faulty(spark, sf):
    """Raw frames of which some break each rule of the quality gate."""
    eid = F.col(ROW_ID)
    return telemetry(spark, sf).select(
        F.when(eid % 29 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  node_"), F.substring(DEVICE, 6, 20), F.lit(" ")))
        .alias(DEVICE),
        F.when(eid % 31 != 0, F.col(PROTOCOL)).alias(PROTOCOL),
        ROW_ID, EPOCH_MS,
        (F.col(THROUGHPUT) * F.when(eid % 37 == 0, F.lit(-1.0)).otherwise(F.lit(1.0))).alias(THROUGHPUT),
        (F.col(DROP) + F.when(eid % 41 == 0, F.lit(98.0)).otherwise(F.lit(0.0))).alias(DROP),
        F.col(BUFFER),
        (F.col(TEMP) + F.when(eid % 43 == 0, F.lit(60.0)).otherwise(F.lit(0.0))).alias(TEMP),
        (F.col(RTT) + F.when(eid % 47 == 0, F.lit(4970.0)).otherwise(F.lit(0.0))).alias(RTT),
    )


def probes(spark, sf):
    """Probe samples; a failed probe has no round-trip time."""
    return telemetry(spark, sf).select(F.col(DEVICE).alias("target"), F.col(RTT).alias("rtt_ms"))


# Command time runs faster than event time so that the debounce interval matters.
SPEED_UP = 100_000
HEARTBEAT_SPEED_UP = 1000


def compressed(df, factor=SPEED_UP):
    return df.withColumn(EPOCH_MS, F.floor(F.col(EPOCH_MS) / factor))


def commands(spark, sf, source=None):
    eid, kind = F.col(ROW_ID), F.col("event_type")
    return compressed(telemetry(spark, sf, source)).select(
        F.when(kind == "purchase", "traffic_shedding").when(kind == "signup", "ha_failover")
        .when(kind == "view", "reset").when(kind == "error", "traffic_shedding").otherwise("thermal_regulation")
        .alias("action"),
        F.col(DEVICE).alias("target_device"),
        F.concat(F.lit("eth"), (eid % 4).cast("string")).alias("target_interface"),
        F.when(eid % 5 == 0, F.lit(0.0)).when(eid % 5 != 1, (eid % 90 + 10) / 100.0).alias("shedding_factor"),
        F.when(eid % 7 == 0, F.col(THROUGHPUT)).alias("target_rate_mbps"),
        F.when(eid % 11 != 0, F.lit("PLC_NODE_DELTA")).when(eid % 2 == 0, F.lit("PLC_NODE_EPSILON")).alias("standby_node"),
        F.lit("scheduled").alias("reason"),
        (kind == "error").alias("requires_approval"),
        F.when(eid % 3 == 0, F.lit("engineer")).when(eid % 3 == 1, F.lit("")).alias("approved_by"),
        EPOCH_MS, ROW_ID,
    )


def decided(spark, sf):
    return control.debounce(commands(spark, sf), largest=largest(spark, sf))


def captures(spark, sf):
    """Captured frames: the hash of a row as payload, short for some rows."""
    raw = F.unhex(F.sha2("props", 256))
    return events(spark, sf).select(
        F.concat(F.lit("NODE_"), F.col("user_id").cast("string")).alias(DEVICE),
        ROW_ID, F.unix_millis(F.col("ts").cast("timestamp")).alias(EPOCH_MS),
        F.when(F.col(ROW_ID) % 2 == 0, "TX").otherwise("RX").alias("dir"),
        F.when(F.col(ROW_ID) % 3 == 0, F.substring(raw, 1, 8)).otherwise(raw).alias("payload"),
    )


def replayed(spark, sf):
    return policy.replay(frames(spark, sf), largest=largest(spark, sf))


def scored(spark, sf):
    return policy.score(frames(spark, sf))


# Frames before this instant (2024-01-16 UTC) form the baseline, later ones the current values.
DRIFT_SPLIT_MS = 1_705_363_200_000


def shifted(rows):
    return rows.where(F.col(EPOCH_MS) >= DRIFT_SPLIT_MS).withColumns(
        {THROUGHPUT: dp(F.col(THROUGHPUT) * 1.2 + 3.0, 6), TEMP: dp(F.col(TEMP) + 0.7, 6)}
    )


def drift_sides(spark, sf):
    """First half of the period as baseline; the second, scaled and shifted, as current values."""
    rows = frames(spark, sf)
    return rows.where(F.col(EPOCH_MS) < DRIFT_SPLIT_MS), shifted(rows)
