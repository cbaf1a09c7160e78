"""Offline path: raw telemetry to a stored model."""

from plantpulse.operators import clustering, forecast, prep
from plantpulse.params import DEFAULTS
from plantpulse.schemas import GAUGES, ROW_ID
from plantpulse.session import checkpointed


def scaled_and_labeled(telemetry, p=DEFAULTS, largest=None):
    """Gap filling, scaling and density profiling. Returns ``(labeled, scaler)``; rows with a gap that nothing
    precedes are left out of the clustering, as they have no position."""
    filled = prep.forward_fill(telemetry, p=p, largest=largest)
    scaled, scaler = prep.min_max_scale(filled.dropna(subset=GAUGES))
    return clustering.profile(scaled, ROW_ID, GAUGES, p), scaler


def train_batch(telemetry, path, p=DEFAULTS, largest=None, trees=forecast.TREES):
    """Batch variant: clustering labels, scaled target, hold-out score. Stores the model at ``path``."""
    labeled, _ = scaled_and_labeled(telemetry, p, largest)
    data = checkpointed(forecast.scaled_training_set(labeled, p, largest))
    train, test = forecast.hash_split(data)
    model = forecast.fit(train, trees)
    forecast.save(model, path)
    return forecast.regression_metrics(forecast.predict(model, test))


def train_time_series(frames, path, p=DEFAULTS, largest=None, trees=forecast.TREES):
    """Time-series variant: fold scores, then a final fit on all rows, stored at ``path``."""
    data = checkpointed(forecast.training_set(frames, p=p, largest=largest))
    scores = forecast.cross_validate(data, trees=trees, p=p)
    forecast.save(forecast.fit(data, trees), path)
    return scores
