"""Validated thresholds. Every operator takes a ``Params`` so that a run is fully described by one value."""

from dataclasses import dataclass, fields

# Allowed range per threshold.
BOUNDS = {
    "sla_latency_ms": (5.0, 500.0),
    "shedding_factor": (0.1, 1.0),
    "throttle_temp": (30.0, 100.0),
    "failover_drop": (0.1, 20.0),
    "debounce_sec": (1.0, 60.0),
    "dbscan_eps": (0.01, 2.0),
    "dbscan_min_samples": (2, 50),
    "psi_threshold": (0.05, 1.0),
    "watermark_sec": (5, 300),
}


@dataclass(frozen=True)
class Params:
    sla_latency_ms: float = 60.0
    shedding_factor: float = 0.82
    throttle_temp: float = 68.0
    failover_drop: float = 1.8
    debounce_sec: float = 5.0
    heartbeat_timeout_sec: float = 15.0
    dbscan_eps: float = 0.30
    dbscan_min_samples: int = 8
    psi_threshold: float = 0.20
    auto_retrain_on_drift: bool = True
    watermark_sec: int = 30
    window_rows: int = 60
    history_rows: int = 30
    # Largest number of rows of one key that a single task may order (see operators/series.py).
    max_group_rows: int = 2_000_000
    # The same for groups that a Python function receives as one Arrow table.
    max_python_group_rows: int = 500_000

    def __post_init__(self):
        for f in fields(self):
            low, high = BOUNDS.get(f.name, (None, None))
            if low is not None and not low <= getattr(self, f.name) <= high:
                raise ValueError(f"{f.name} must lie in [{low}, {high}], got {getattr(self, f.name)}")


DEFAULTS = Params()
