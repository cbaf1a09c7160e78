"""Latency formulas: training targets, analytic forecast, attributions, horizons."""

from pyspark.sql import functions as F

from plantpulse.functions.numbers import clamp, dp
from plantpulse.schemas import BUFFER, DROP, LABEL, TEMP


def training_target():
    """Deterministic part of the training target."""
    return 38.0 + F.col(DROP) * 10.5 + F.col(BUFFER) * 0.22 + F.col(LABEL) * 8.0


def scaled_target():
    """Target of the scaled batch variant; the noise label -1 counts like label 1."""
    return 40.0 + F.col(DROP) * 35.0 + F.abs(F.col(LABEL)) * 12.0


def analytic_forecast(drop=DROP, label=LABEL, temp=TEMP):
    """Forecast used when no model is loaded."""
    raw = 38.0 + F.col(drop) * 12.0 + F.col(label) * 6.5 + F.col(temp) * 0.1
    return F.greatest(F.lit(5.0), dp(raw, 2))


def analytic_attributions():
    return F.create_map(
        F.lit(DROP), dp(F.col(DROP) * 12.0, 2),
        F.lit(LABEL), dp(F.col(LABEL) * 6.5, 2),
        F.lit(TEMP), dp(F.col(TEMP) * 0.1, 2),
        F.lit("_bias_baseline"), F.lit(38.0),
    )


# Fixed values: (label, attribution key, value shown when the key is absent).
RANKED_ATTRIBUTIONS = [
    ("Packet Loss Rate (%)", "packet_drop_percentage", 5.2),
    ("TSN Buffer Saturation (%)", "buffer_utilization_percentage", 3.4),
    ("Dynamic Cluster Regime", "dynamic_operational_label", 2.1),
    ("Throughput Trend Slope", "throughput_slope", -0.8),
    ("Die Junction Temp (°C)", "node_temperature_celsius", 0.6),
]


def ranked_attributions(attributions):
    """``array<struct<rank,feature,value,sign,bar_pct>>`` of the five displayed attributions."""
    items = []
    for rank, (label, key, default) in enumerate(RANKED_ATTRIBUTIONS, 1):
        value = F.coalesce(F.try_element_at(attributions, F.lit(key)), F.lit(default))
        bar = F.least(F.lit(100), F.floor(dp(F.abs(value) / 8.0 * 100.0, 6)).cast("int"))
        items.append(
            F.struct(
                F.lit(rank).alias("rank"),
                F.lit(label).alias("feature"),
                value.alias("value"),
                F.when(value > 0, F.lit("+")).otherwise(F.lit("")).alias("sign"),
                bar.alias("bar_pct"),
            )
        )
    return F.array(*items)


# Fixed values: (horizon in seconds, slope weight, drop weight, half-width of the band).
HORIZONS = [(5, 0.5, 0.0, 1.2), (15, 1.5, 2.0, 2.8), (30, 3.0, 4.5, 4.5)]


def horizons(pred, slope, drop, sla_ms):
    """``array<struct<horizon_sec,forecast_ms,low_ms,high_ms,breach>>``."""
    out = []
    for sec, slope_w, drop_w, band in HORIZONS:
        mid = F.col(pred) + F.col(slope) * slope_w + F.col(drop) * drop_w
        out.append(
            F.struct(
                F.lit(sec).alias("horizon_sec"),
                mid.alias("forecast_ms"),
                (mid - band).alias("low_ms"),
                (mid + band).alias("high_ms"),
                (dp(mid, 9) >= sla_ms).alias("breach"),
            )
        )
    return F.array(*out)


def risk_index(pred, sla_ms):
    return clamp(F.col(pred) / sla_ms * 100.0, 5.0, 99.0)
