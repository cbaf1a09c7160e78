"""Preparation: quality gate, canonical frames, gap filling, scaling."""

from pyspark.sql import functions as F

from plantpulse.functions import frames as fr
from plantpulse.operators.series import open_series
from plantpulse.params import DEFAULTS
from plantpulse.schemas import DEVICE, EPOCH_MS, GAUGES, PROTOCOL, ROW_ID, RTT


def check(raw):
    """Raw frames with an ``errors`` array; an empty array marks a valid frame."""
    return raw.withColumn("errors", fr.frame_errors())


def valid_frames(raw):
    """Frames that pass the quality gate: a plain predicate that reaches the file scan."""
    return raw.where(fr.frame_ok())


def quarantine(raw):
    """Frames that fail the quality gate, with their list of errors."""
    return check(raw.where(~F.coalesce(fr.frame_ok(), F.lit(False))))


def canonical(valid, probes=None, event_time=EPOCH_MS, row_id=ROW_ID):
    """Canonical frames: normal device id, one RTT per frame (payload, else probe, else synthetic), id.

    ``probes`` is an optional ``(device_id, probe_rtt)`` table with one row per device."""
    df = valid.withColumn(DEVICE, fr.normal_device())
    measured = F.col(RTT)
    if probes is not None:
        df = df.join(probes.select(DEVICE, "probe_rtt"), DEVICE, "left")
        measured = F.coalesce(measured, F.col("probe_rtt"))
    return df.select(
        DEVICE, PROTOCOL, F.col(row_id).alias(ROW_ID), F.col(event_time).alias(EPOCH_MS), *GAUGES,
        F.coalesce(measured, fr.synthetic_rtt()).alias(RTT),
    ).withColumn("correlation_id", fr.correlation_id(DEVICE, EPOCH_MS, ROW_ID))


def forward_fill(df, cols=tuple(GAUGES), keys=(DEVICE,), time=EPOCH_MS, tie=ROW_ID, p=DEFAULTS, largest=None):
    """Replace missing gauges by the last known value of the key; leading gaps stay missing. ``keys=()`` fills
    over the whole table as one series."""
    one_series = not keys
    if one_series:
        df, keys = df.withColumn("_series", F.lit(0)), ("_series",)
    s = open_series(df, keys, time, tie, 0, p.max_group_rows, largest)
    filled = s.close(s.carry({f"_f_{c}": F.col(c) for c in cols}))
    out = filled.withColumns({c: F.col(f"_f_{c}") for c in cols}).drop(*[f"_f_{c}" for c in cols])
    return out.drop("_series") if one_series else out


def fit_scaler(df, cols=tuple(GAUGES)):
    """One-row table with the minimum and maximum of each column; write it next to the data it describes."""
    return df.agg(
        *[F.min(c).alias(f"{c}_min") for c in cols], *[F.max(c).alias(f"{c}_max") for c in cols]
    )


def _limits(scaler, cols):
    """The scaler's single row as literals, so that scaling is a plain projection without a join."""
    row = scaler.first()
    return {c: (F.lit(row[f"{c}_min"]).cast("double"), F.lit(row[f"{c}_max"]).cast("double")) for c in cols}


def apply_scaler(df, scaler, cols=tuple(GAUGES)):
    """Scale to 0..1. A constant column gives 0.0; missing values stay missing."""
    limits = _limits(scaler, cols)

    def scaled(c):
        low, high = limits[c]
        return F.when(high == low, F.col(c) - low).otherwise((F.col(c) - low) / F.nullif(high - low, F.lit(0.0)))

    return df.withColumns({c: scaled(c) for c in cols})


def invert_scaler(df, scaler, cols=tuple(GAUGES)):
    """Scaled values back to their units."""
    limits = _limits(scaler, cols)

    def restored(c):
        low, high = limits[c]
        return F.when(high == low, F.col(c) + low).otherwise(F.col(c) * (high - low) + low)

    return df.withColumns({c: restored(c) for c in cols})


def min_max_scale(df, cols=tuple(GAUGES)):
    """``(scaled, scaler)``."""
    scaler = fit_scaler(df, cols)
    return apply_scaler(df, scaler, cols), scaler
