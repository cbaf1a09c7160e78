"""Temporal features per device. Three named profiles exist because serving, training and console define the
same feature names differently."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plantpulse.functions.frames import DEFAULT_LAG_MS
from plantpulse.functions.numbers import dp
from plantpulse.operators.series import open_series
from plantpulse.params import DEFAULTS
from plantpulse.schemas import (
    BUFFER, DEVICE, DROP, EPOCH_MS, GAUGES, LABEL, ROW_ID, RTT, TARGET, TEMP, THROUGHPUT,
)


def serving_features(frames, p=DEFAULTS, keys=(DEVICE,), time=EPOCH_MS, tie=ROW_ID, largest=None):
    """Means, peak, trend slope, lags and sample count over the last ``p.window_rows`` frames of a device.
    One window specification, so one sort."""
    s = open_series(frames, keys, time, tie, p.window_rows - 1, p.max_group_rows, largest)
    w = s.window
    span = w.rowsBetween(-(p.window_rows - 1), Window.currentRow)
    numbered = s.df.withColumn("_rn", F.row_number().over(w).cast("double"))
    n = F.count(F.lit(1)).over(span)
    slope = F.when(n >= 3, F.regr_slope(F.col(THROUGHPUT), F.col("_rn")).over(span)).otherwise(F.lit(0.0))
    out = numbered.withColumns(
        {
            "throughput_mean": F.avg(THROUGHPUT).over(span),
            "throughput_slope": dp(slope, 4),
            "packet_drop_mean": F.avg(DROP).over(span),
            "buffer_peak": F.max(BUFFER).over(span),
            "lag_latency_1": F.coalesce(F.lag(RTT, 1).over(w), F.col(RTT)),
            "lag_latency_2": F.coalesce(F.lag(RTT, 2).over(w), F.lag(RTT, 1).over(w), F.col(RTT)),
            "samples_in_window": n.cast("int"),
        }
    )
    return s.close(out).drop("_rn")


def training_features(labeled, p=DEFAULTS, keys=(DEVICE,), time=EPOCH_MS, tie=ROW_ID, target=TARGET, largest=None):
    """Lags with back-fill from the first row, one-step slope, rolling peak over ten rows. The target must not
    be null. The first row of a key is among the ten rows that its first frames look back on, so back-fill
    needs no scan of the key."""
    s = open_series(labeled, keys, time, tie, 9, p.max_group_rows, largest)
    w = s.window
    recent = w.rowsBetween(-9, Window.currentRow)
    first = F.first(target).over(recent)
    out = s.df.withColumns(
        {
            "lag_latency_1": F.coalesce(F.lag(target, 1).over(w), first),
            "lag_latency_2": F.coalesce(F.lag(target, 2).over(w), first),
            "throughput_slope": F.coalesce(F.col(THROUGHPUT) - F.lag(THROUGHPUT, 1).over(w), F.lit(0.0)),
            "buffer_peak": F.max(BUFFER).over(recent),
        }
    )
    return s.close(out)


def console_features(frames, p=DEFAULTS, keys=(DEVICE,), time=EPOCH_MS, tie=ROW_ID, largest=None):
    """Lags from the rows before the current one (default 42 ms), one-step slope, peak of the current and the
    last five rows."""
    s = open_series(frames, keys, time, tie, 5, p.max_group_rows, largest)
    w = s.window
    lag1 = F.coalesce(F.lag(RTT, 1).over(w), F.lit(DEFAULT_LAG_MS))
    out = s.df.withColumns(
        {
            "lag_latency_1": lag1,
            "lag_latency_2": F.coalesce(F.lag(RTT, 2).over(w), lag1),
            "throughput_slope": F.coalesce(F.col(THROUGHPUT) - F.lag(THROUGHPUT, 1).over(w), F.lit(0.0)),
            "buffer_peak": F.greatest(F.col(BUFFER), F.max(BUFFER).over(w.rowsBetween(-5, -1))),
        }
    )
    return s.close(out)


PROFILES = {"serving": serving_features, "training": training_features, "console": console_features}


def last_n(df, n, keys=(DEVICE,), order=(EPOCH_MS, ROW_ID), rank="recency"):
    """The newest ``n`` rows per key. Spark keeps only ``n`` rows per key and map task before the shuffle, so
    a large key is no hot spot."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def latest_features(frames, device=None, p=DEFAULTS):
    """Newest serving-feature row per device, or of one device. Only the last frames of a device can
    contribute, so older ones are dropped before the window runs."""
    if device is not None:
        frames = frames.where(F.col(DEVICE) == device)
    recent = last_n(frames, p.window_rows).drop("recency")
    return last_n(serving_features(recent, p, largest=p.window_rows), 1).drop("recency")


def prediction_request(features, label=0):
    """Feature rows as scoring payload."""
    return features.select(
        DEVICE, *[c for c in (ROW_ID, EPOCH_MS) if c in features.columns], *GAUGES,
        F.lit(label).cast("int").alias(LABEL),
        "throughput_slope", "buffer_peak", "lag_latency_1", "lag_latency_2",
    )


def complete_request(requests):
    """Missing lags, slope and peak take their defaults."""
    return requests.withColumns(
        {
            "lag_latency_1": F.coalesce("lag_latency_1", F.lit(DEFAULT_LAG_MS)),
            "lag_latency_2": F.coalesce("lag_latency_2", F.lit(DEFAULT_LAG_MS)),
            "throughput_slope": F.coalesce("throughput_slope", F.lit(0.0)),
            "buffer_peak": F.coalesce("buffer_peak", F.col(BUFFER)),
        }
    )


def window_summary(frames, p=DEFAULTS, keys=(DEVICE,)):
    """Mean, maximum and sample deviation per signal over the newest ``p.history_rows`` frames."""
    recent = last_n(frames.select(*keys, EPOCH_MS, ROW_ID, *GAUGES), p.history_rows)
    return (
        recent.unpivot(list(keys), GAUGES, "signal", "value")
        .groupBy(*keys, "signal")
        .agg(
            F.avg("value").alias("mean"), F.max("value").alias("peak"), F.stddev_samp("value").alias("std_dev")
        )
    )


__all__ = [
    "PROFILES", "TEMP", "complete_request", "console_features", "last_n", "latest_features",
    "prediction_request", "serving_features", "training_features", "window_summary",
]
