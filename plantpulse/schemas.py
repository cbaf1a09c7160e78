"""Column names and table schemas shared by every operator."""

from pyspark.sql import types as T

DEVICE = "device_id"
PROTOCOL = "protocol"
EPOCH_MS = "timestamp_epoch_ms"
ROW_ID = "event_id"
THROUGHPUT = "throughput_mbps"
DROP = "packet_drop_percentage"
BUFFER = "buffer_utilization_percentage"
TEMP = "node_temperature_celsius"
RTT = "actual_rtt_latency_ms"
LABEL = "dynamic_operational_label"
TARGET = "network_latency_ms"

GAUGES = [THROUGHPUT, DROP, BUFFER, TEMP]
MODEL_FEATURES = GAUGES + [LABEL, "lag_latency_1", "lag_latency_2", "throughput_slope", "buffer_peak"]

RAW_PAYLOAD = T.StructType(
    [
        T.StructField(DEVICE, T.StringType()),
        T.StructField(PROTOCOL, T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        *[T.StructField(g, T.DoubleType()) for g in GAUGES],
        T.StructField(RTT, T.DoubleType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

FRAMES = T.StructType(
    [
        T.StructField(DEVICE, T.StringType()),
        T.StructField(PROTOCOL, T.StringType()),
        T.StructField(ROW_ID, T.LongType()),
        T.StructField(EPOCH_MS, T.LongType()),
        *[T.StructField(g, T.DoubleType()) for g in GAUGES],
        T.StructField(RTT, T.DoubleType()),
        T.StructField("correlation_id", T.StringType()),
    ]
)

TELEMETRY = T.StructType(
    [T.StructField("timestamp", T.TimestampType()), *[T.StructField(g, T.DoubleType()) for g in GAUGES]]
)

COMMANDS = T.StructType(
    [
        T.StructField("action", T.StringType()),
        T.StructField("target_device", T.StringType()),
        T.StructField("target_interface", T.StringType()),
        T.StructField("shedding_factor", T.DoubleType()),
        T.StructField("target_rate_mbps", T.DoubleType()),
        T.StructField("standby_node", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("requires_approval", T.BooleanType()),
        T.StructField("approved_by", T.StringType()),
        T.StructField("correlation_id", T.StringType()),
        T.StructField(EPOCH_MS, T.LongType()),
        T.StructField(ROW_ID, T.LongType()),
    ]
)

SOE_LOG = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in ("Timestamp", "Alarm_ID", "Priority", "Tag", "Event", "Quality")
    ]
)
