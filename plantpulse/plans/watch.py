"""Drift path: stored baseline against recent frames, retraining when they differ."""

from plantpulse.operators import drift, forecast
from plantpulse.params import DEFAULTS


def check(baseline, frames, edges=None, p=DEFAULTS):
    """``(report per channel, one-row summary)``."""
    report = drift.drift_report(baseline, drift.long_form(frames), edges, p)
    return report, drift.drift_summary(report, p)


def check_counts(counts, frames, edges=None, p=DEFAULTS):
    """``check`` against the stored value counts of a baseline, whose rows are not read."""
    report = drift.report_of_counts(counts, drift.side_counts(drift.long_form(frames), "c"), edges, p)
    return report, drift.drift_summary(report, p)


def check_and_retrain(baseline, frames, model_path, edges=None, p=DEFAULTS, largest=None, trees=forecast.TREES):
    """Reloaded model when a channel drifted, else None."""
    report, _ = check(baseline, frames, edges, p)
    return forecast.retrain_on_drift(report, frames, model_path, trees, p, largest)
