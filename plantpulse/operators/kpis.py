"""Counters, gauges, histograms, run totals and probe summaries."""

from pyspark.sql import functions as F

from plantpulse.functions.numbers import clean
from plantpulse.operators.control import ACTION_SEVERITY, APPLIED, falsy_text
from plantpulse.functions.diagnosis import PRIMARY_NODE, STANDBY_NODE
from plantpulse.operators.features import last_n
from plantpulse.operators.ranks import exact_quantiles
from plantpulse.operators.series import open_series
from plantpulse.params import DEFAULTS
from plantpulse.schemas import DEVICE, EPOCH_MS, PROTOCOL, ROW_ID, TEMP

# Upper bounds of the inference-time histogram in milliseconds.
DURATION_BUCKETS_MS = [0.5, 1.0, 2.0, 5.0, 10.0, 25.0, 50.0]


def frames_total(frames):
    return frames.groupBy(PROTOCOL, DEVICE).agg(F.count(F.lit(1)).alias("frames_total"))


def errors_total(quarantine):
    """Rejected rows by protocol and kind; ``decode_ok`` (if present) separates undecodable payloads."""
    kind = F.lit("validation_error")
    if "decode_ok" in quarantine.columns:
        kind = F.when(F.col("decode_ok"), kind).otherwise(F.lit("system_error"))
    return quarantine.groupBy(PROTOCOL, kind.alias("error_type")).agg(F.count(F.lit(1)).alias("errors_total"))


def latest_gauge(df, label, value, order=(EPOCH_MS, ROW_ID)):
    """Newest value per label."""
    return df.groupBy(label).agg(F.max_by(value, F.struct(*order)).alias(value))


def duration_histogram(df, value, bounds=tuple(DURATION_BUCKETS_MS)):
    """Cumulative histogram in long form: ``le`` (text), ``bucket_count``, and the sum and count of all rows.
    One pass with one small aggregate row."""
    row = df.agg(
        *[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.sum(value).alias("total_sum"), F.count(value).alias("total_count"),
    )
    entries = [
        F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("bucket_count")) for i, b in enumerate(bounds)
    ] + [F.struct(F.lit("+Inf").alias("le"), F.col("total_count").alias("bucket_count"))]
    return row.select(F.explode(F.array(*entries)).alias("e"), "total_sum", "total_count").select(
        "e.*", "total_sum", "total_count"
    )


def mitigations_total(decided):
    severity = F.create_map(*[F.lit(x) for pair in ACTION_SEVERITY.items() for x in pair])
    return (
        decided.where(F.col("status") == APPLIED)
        .groupBy("action", F.try_element_at(severity, F.col("action")).alias("severity"))
        .agg(F.count(F.lit(1)).alias("mitigations_total"))
    )


def failovers_total(decided):
    return (
        decided.where((F.col("status") == APPLIED) & (F.col("action") == "ha_failover"))
        .groupBy(
            falsy_text("target_device", PRIMARY_NODE).alias("from_node"),
            falsy_text("standby_node", STANDBY_NODE).alias("to_node"),
        )
        .agg(F.count(F.lit(1)).alias("failovers_total"))
    )


def run_totals(scored, latency, keys=()):
    """Cycles, peak temperature, peak latency."""
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_cycles"), F.max(TEMP).alias("peak_temp"), F.max(latency).alias("peak_latency")
    )


def running_totals(scored, latency, p=DEFAULTS, largest=None):
    """The same totals as of every frame of a device."""
    s = open_series(
        scored.select(DEVICE, EPOCH_MS, ROW_ID, TEMP, latency), [DEVICE], EPOCH_MS, ROW_ID, 0, p.max_group_rows, largest
    )
    out = s.running(
        sums={"total_cycles": F.lit(1).cast("long")},
        maxima={"peak_temp": F.col(TEMP), "peak_latency": F.col(latency)},
    )
    return s.close(out)


def sparkline(df, value, n=10, keys=(DEVICE,)):
    """The newest ``n`` values per key, scaled to 0..1 (a flat series gives 0.0)."""
    recent = last_n(df.select(*keys, EPOCH_MS, ROW_ID, value), n)
    low, high = F.min(value), F.max(value)
    scale = recent.groupBy(*keys).agg(
        low.alias("low"), F.when(high == low, F.lit(1.0)).otherwise(high - low).alias("span"),
        F.collect_list(F.struct("recency", value)).alias("points"),
    )
    return scale.select(*keys, F.explode("points").alias("point"), "low", "span").select(
        *keys, "point.recency", ((F.col(f"point.{value}") - F.col("low")) / F.col("span")).alias("scaled")
    )


def live_error(df, actual, predicted, keys=(DEVICE,), n=None, p=DEFAULTS):
    """Mean absolute error of the recent forecasts, and the axis limit of their chart."""
    recent = last_n(df.select(*keys, EPOCH_MS, ROW_ID, actual, predicted), n or p.history_rows)
    return recent.groupBy(*keys).agg(
        F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae"),
        F.greatest(F.lit(80.0), F.greatest(F.max(actual), F.max(predicted)) * 1.15).alias("axis_limit"),
    )


def probe_summary(samples, target="target", rtt="rtt_ms", p=DEFAULTS):
    """Median of the successful probes per target, 0.0 when there is none."""
    valid = samples.select(target, clean(F.col(rtt)).alias(rtt))
    sizes = valid.groupBy(target).agg(F.count(rtt).alias("valid_samples"))
    medians = exact_quantiles(valid, [target], rtt, [0.5], p.max_group_rows, "q")
    return sizes.join(medians, target, "left").select(
        target, "valid_samples", F.coalesce(F.get("q", F.lit(0)), F.lit(0.0)).alias("median_rtt_ms")
    )
