"""Reading and writing of the tables the pipeline exchanges."""

from pyspark.sql import functions as F

from plantpulse.schemas import EPOCH_MS, FRAMES, ROW_ID


def append_frames(frames, path):
    """Append canonical frames to a JSON-lines folder."""
    frames.write.mode("append").json(path)


def replay_frames(spark, path, schema=FRAMES):
    """Read back appended frames with a fixed schema (no inference pass)."""
    return spark.read.schema(schema).json(path)


def recent(frames, n=50):
    """The newest ``n`` frames; runs as a distributed top-n."""
    return frames.orderBy(F.col(EPOCH_MS).desc(), F.col(ROW_ID).desc()).limit(n)


def write_csv(df, path):
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark, path, schema):
    return spark.read.schema(schema).option("header", True).csv(path)


def export_log(events, path):
    """Event log as CSV."""
    write_csv(events, path)


def export_telemetry(frames, path):
    """Telemetry as JSON records."""
    frames.write.mode("overwrite").json(path)


def write_frames(frames, path):
    """Frames as Parquet, partitioned by UTC day so that time filters prune folders."""
    day = F.to_date(F.timestamp_millis(EPOCH_MS))
    frames.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)
