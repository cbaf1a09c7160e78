"""Diagnosis of scored frames and replay of the mitigation policy."""

from pyspark.sql import functions as F

from plantpulse.functions import diagnosis as dg
from plantpulse.functions import latency as lt
from plantpulse.functions.regimes import live_regime, regime_name
from plantpulse.operators.features import console_features
from plantpulse.operators.series import open_series
from plantpulse.params import DEFAULTS
from plantpulse.schemas import BUFFER, DEVICE, DROP, EPOCH_MS, GAUGES, LABEL, ROW_ID, TEMP, THROUGHPUT

PRED = "predicted_latency_ms"
SHED_MARGIN_MS = 5.0
# Effect of an action on the gauges.
COOLING_C = 3.5
THROTTLE_DELAY_MS = 1.2
STANDBY_DROP = 0.12
SHED_DROP = 0.35
SHED_BUFFER = 0.70


def with_regime(df):
    return df.withColumn(LABEL, live_regime()).withColumn("cluster_regime", regime_name(F.col(LABEL)))


def analytic_score(df, names=None, out=PRED):
    """Analytic scorer. ``names`` maps a model feature to the column that holds it."""
    names = names or {}
    at = lambda c: names.get(c, c)
    label = f"{out}_label"
    scored = df.withColumn(label, live_regime(at(DROP), at(BUFFER), at(TEMP), [at(g) for g in GAUGES]))
    return scored.withColumn(out, lt.analytic_forecast(at(DROP), label, at(TEMP)))


analytic_score.attributions = lambda df: df.withColumn("attributions", lt.analytic_attributions())


def explained(df, scorer=analytic_score):
    """Regime, forecast, and the attributions of that very forecast."""
    return scorer.attributions(score(df, scorer))


def score(df, scorer=analytic_score):
    """Regime and forecast. A label that came with the rows is ignored; the scorer computes its own."""
    scored = scorer(df.drop(LABEL)).withColumnRenamed(f"{PRED}_label", LABEL)
    return scored.withColumn("cluster_regime", regime_name(F.col(LABEL)))


def diagnose(scored, attributions=None, p=DEFAULTS):
    """Root-cause columns for scored frames."""
    df = scored.withColumn("findings", dg.findings(attributions, p))
    first = F.col("findings")[0]
    return df.withColumns(
        {
            "risk_level": dg.risk_level(PRED, p),
            "urgency": dg.urgency(PRED, p),
            "confidence_score": F.lit(dg.CONFIDENCE),
            "primary_vector": first["vector"],
            "mitigation_action": dg.action(p),
            "action_params": dg.action_params(p),
            "expected_reduction_ms": dg.expected_reduction(PRED, p),
            "diagnosis_summary": dg.summary_text(
                PRED, dg.risk_level(PRED, p), first["vector"], first["evidence"], p
            ),
            "recommendation_text": dg.recommendation_text(PRED, dg.risk_level(PRED, p), dg.action(p), p),
        }
    )


def replay(frames, scorer=analytic_score, p=DEFAULTS, largest=None):
    """Apply thermal, failover and shedding rules to every frame and score before and after shedding.

    Lags come from measured latency, so rows do not depend on each other's outcome and the whole replay is a
    projection on top of the console features."""
    return apply_policy(console_features(frames, p, largest=largest), scorer, p)


def apply_policy(df, scorer=analytic_score, p=DEFAULTS):
    """The row rules of :func:`replay` for frames that already have their features; also runs on streams."""
    throttled = F.col(TEMP) > p.throttle_temp
    failover = F.col(DROP) > p.failover_drop
    df = df.withColumns(
        {
            "core_throttled": throttled,
            "throttle_delay_ms": F.when(throttled, F.lit(THROTTLE_DELAY_MS)).otherwise(F.lit(0.0)),
            "temp_after": F.when(throttled, F.col(TEMP) - COOLING_C).otherwise(F.col(TEMP)),
            "failover_active": failover,
            "active_drop": F.when(failover, F.lit(STANDBY_DROP)).otherwise(F.col(DROP)),
        }
    )
    df = scorer(df, {DROP: "active_drop", TEMP: "temp_after"}, "pred_before")
    shed = F.col("pred_before") >= p.sla_latency_ms - SHED_MARGIN_MS
    df = df.withColumns(
        {
            "shed_throughput": F.col(THROUGHPUT) * p.shedding_factor,
            "shed_drop": F.col("active_drop") * SHED_DROP,
            "shed_buffer": F.col(BUFFER) * SHED_BUFFER,
            "shed_slope": F.col("throughput_slope") * p.shedding_factor,
        }
    )
    after = {
        THROUGHPUT: "shed_throughput", DROP: "shed_drop", BUFFER: "shed_buffer", TEMP: "temp_after",
        "throughput_slope": "shed_slope", "buffer_peak": "shed_buffer",
    }
    df = scorer(df, after, "pred_shed").withColumn("mitigation_active", shed)
    pick = lambda yes, no: F.when(F.col("mitigation_active"), F.col(yes)).otherwise(F.col(no))
    df = df.withColumns(
        {
            "throughput_after": pick("shed_throughput", THROUGHPUT),
            "drop_after": pick("shed_drop", "active_drop"),
            "buffer_after": pick("shed_buffer", BUFFER),
            PRED: pick("pred_shed", "pred_before"),
        }
    )
    return df.drop("shed_throughput", "shed_drop", "shed_buffer", "shed_slope", "pred_shed", "pred_shed_label",
                   "pred_before_label")


def mitigation_counts(replayed, keys=(DEVICE,), p=DEFAULTS):
    """Shedding attempts, prevented breaches, failovers."""
    prevented = (
        F.col("mitigation_active") & (F.col("pred_before") >= p.sla_latency_ms) & (F.col(PRED) < p.sla_latency_ms)
    )
    return replayed.groupBy(*keys).agg(
        F.count_if(F.col("mitigation_active")).alias("mitigation_checks"),
        F.count_if(prevented).alias("mitigations_successful"),
        F.count_if(F.col("failover_active")).alias("failover_events"),
    )


def sustained_breaches(scored, min_cycles=2, p=DEFAULTS, largest=None):
    """Runs of at least ``min_cycles`` consecutive frames at or above the latency limit.

    The start of a run travels forward with the rows and the runs are then an ordinary aggregate, so a long
    run is no large group."""
    rows = scored.select(
        DEVICE, EPOCH_MS, ROW_ID, (F.col(PRED) >= p.sla_latency_ms).alias("_breach"), PRED
    )
    s = open_series(rows, [DEVICE], EPOCH_MS, ROW_ID, 1, p.max_group_rows, largest)
    begins = F.col("_breach") & ~F.coalesce(F.lag("_breach").over(s.window), F.lit(False))
    s.df = s.df.withColumn("_start", F.when(begins, F.struct(EPOCH_MS, ROW_ID)))
    runs = s.close(s.carry({"_run": F.col("_start")})).where("_breach")
    return (
        runs.groupBy(DEVICE, "_run")
        .agg(
            F.count(F.lit(1)).alias("cycles"), F.max(EPOCH_MS).alias("end_ms"), F.max(PRED).alias("peak_latency_ms")
        )
        .where(F.col("cycles") >= min_cycles)
        .select(DEVICE, F.col(f"_run.{EPOCH_MS}").alias("start_ms"), "end_ms", "cycles", "peak_latency_ms")
    )
