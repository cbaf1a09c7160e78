"""Offline paths end to end: console cycle, drift watch, training runs, exports."""

from pyspark.sql import functions as F

from contract import data as d
from contract.spark_side import r6
from contract.sql_side import CANON, CANON_COLS
from contract.sql_side import SQL as PARTS
from contract.sql_side import w
from plantpulse.operators import drift, forecast
from plantpulse.plans import console, training, watch
from plantpulse.schemas import FRAMES, ROW_ID
from plantpulse.session import scratch_folder
from plantpulse.sources import tables

# A smaller ensemble than in production: the paths are what these queries run.
TREES = 20


def a11(spark, sf):
    """Telemetry as JSON records, read back."""
    path = scratch_folder(spark, "telemetry-json")
    tables.export_telemetry(d.frames(spark, sf), path)
    return r6(spark.read.schema(FRAMES).json(path))


def p3_flags(spark, sf):
    flagged, _ = console.run(d.frames(spark, sf), largest=d.largest(spark, sf))
    return flagged.select(ROW_ID, "is_latency_alarm", "is_drop_alarm", "is_temp_alarm", "is_buffer_alarm")


def p3_log(spark, sf):
    return console.run(d.frames(spark, sf), largest=d.largest(spark, sf))[1]


def p3_audit(spark, sf):
    return console.audit(d.frames(spark, sf), largest=d.largest(spark, sf))


def p4_watch(spark, sf):
    """A stored baseline with its value counts against the frames of the later half."""
    base, cur = d.drift_sides(spark, sf)
    path = scratch_folder(spark, "baseline-counts")
    drift.set_baseline_counts(drift.long_form(base), path)
    report, _ = watch.check_counts(drift.load_baseline_counts(spark, path), cur)
    return report.drop("p_value", "drift_band")


def p4_retrain(spark, sf):
    """The same check with retraining: whether a new model is in place."""
    base, cur = d.drift_sides(spark, sf)
    path = scratch_folder(spark, "watched-model")
    model = watch.check_and_retrain(drift.long_form(base), cur, path, largest=d.largest(spark, sf), trees=TREES)
    return spark.range(1).select(F.lit(model is not None).alias("retrained"))


def p5_batch(spark, sf):
    """Gap filling, scaling, profiling, scaled target, training on four fifths, scores on the rest."""
    raw = d.telemetry(spark, sf).select(*d.RAW)
    return r6(training.train_batch(raw, scratch_folder(spark, "batch-model"), largest=d.largest(spark, sf), trees=TREES))


def p5_series(spark, sf):
    """Mean scores of the expanding folds; the final model is stored."""
    scores = training.train_time_series(d.frames(spark, sf), scratch_folder(spark, "series-model"), largest=d.largest(spark, sf), trees=TREES)
    return r6(forecast.mean_scores(scores))


def f5_hold_out(spark, sf):
    """Scores on rows that the model has not seen."""
    data = forecast.training_set(d.frames(spark, sf), largest=d.largest(spark, sf))
    return r6(forecast.hold_out_score(data, TREES))


QUERIES = {
    "A11_json_export": a11, "P3_console_flags": p3_flags, "P3_console_log": p3_log, "P3_console_audit": p3_audit,
    "P4_drift_watch": p4_watch, "P4_retraining": p4_retrain, "P5_batch_training": p5_batch, "P5_series_training": p5_series,
    "F5_hold_out": f5_hold_out,
}

SQL = {
    "A11_json_export": w(CANON, f"select {CANON_COLS} from canon"),
    "P3_console_flags": "select * exclude (stage) from (" + PARTS["I1_alarm_flags"] + ") where stage = 'post'",
    "P3_console_log": PARTS["I3_sequence_of_events"],
    "P3_console_audit": PARTS["I6_audit"],
    "P4_drift_watch": PARTS["G3_drift_report"],
    # Retraining follows from the report: some channel beyond the threshold.
    "P4_retraining": "select retrain_recommended as retrained from (" + PARTS["G3_drift_summary"] + ")",
}
