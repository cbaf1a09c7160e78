"""Session helpers: a local session for tests and a checkpoint folder that respects the cluster's own."""

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def local_session(cores="8", shuffle_partitions=8, memory="16g", app="plantpulse"):
    """Session for tests and benchmarks. On a cluster use the session the cluster provides."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark):
    """Use the folder named in ``spark.checkpoint.dir``. A temporary folder serves only in local mode, where no
    shared folder is configured."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="plantpulse-checkpoint-")
        sc.setCheckpointDir(shared)


def checkpointed(df):
    """Cut the lineage of an intermediate table by writing it to the shared folder and reading it back. Unlike
    ``df.checkpoint()`` this gives later joins the true size and does not carry the old plan's constraints along,
    which in iterative work grow from step to step."""
    path = scratch_folder(df.sparkSession, "step")
    df.write.parquet(path)
    step = df.sparkSession.read.schema(df.schema).parquet(path)
    step.scratch_path = path
    return step


def discard(*steps):
    """Delete tables that ``checkpointed`` wrote. Call it when no table that is still to be computed reads them."""
    for step in steps:
        remove(step.sparkSession, step.scratch_path)


def broadcast_if_small(df, rows, limit=200_000):
    """Broadcast hint for a side whose row count is known and small; otherwise Spark chooses the join."""
    return F.broadcast(df) if rows <= limit else df


def scratch_folder(spark, name):
    """New folder for intermediate tables: below ``spark.checkpoint.dir`` when set, else (local mode) below the
    system's temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = shared or tempfile.mkdtemp(prefix="plantpulse-scratch-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark, path):
    """Delete a folder of intermediate tables that this package wrote, on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
