"""Online path: raw frames to diagnosed, scored frames."""

from pyspark.sql import functions as F

from plantpulse.operators import policy, prep
from plantpulse.operators.features import serving_features
from plantpulse.params import DEFAULTS
from plantpulse.schemas import DEVICE, LABEL


def score_frames(raw, scorer=policy.analytic_score, p=DEFAULTS, largest=None):
    """Quality gate, canonical form, rolling features, regime, forecast, attributions, diagnosis from them."""
    feats = serving_features(prep.canonical(prep.valid_frames(raw)), p, largest=largest)
    return policy.diagnose(policy.explained(feats, scorer), "attributions", p)


def device_risk(raw, scorer=policy.analytic_score, p=DEFAULTS, largest=None):
    """Summary per device and risk level."""
    return (
        score_frames(raw, scorer, p, largest)
        .groupBy(DEVICE, "risk_level")
        .agg(
            F.count(F.lit(1)).alias("frames"),
            F.max(policy.PRED).alias("peak_latency_ms"),
            F.avg("throughput_slope").alias("mean_slope"),
            F.avg("throughput_mean").alias("mean_throughput"),
            F.count_if(F.col(LABEL) == 2).alias("anomaly_frames"),
        )
    )
