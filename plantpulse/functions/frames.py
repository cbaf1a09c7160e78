"""Row rules on frames: validation, canonical form, round-trip time, scoring contract."""

from pyspark.sql import functions as F

from plantpulse.functions.numbers import clean, dp
from plantpulse.schemas import BUFFER, DEVICE, DROP, GAUGES, PROTOCOL, RTT, TEMP, THROUGHPUT

# Inclusive bounds of a raw frame.
RAW_BOUNDS = {
    THROUGHPUT: (0.0, 10000.0),
    DROP: (0.0, 100.0),
    BUFFER: (0.0, 100.0),
    TEMP: (-20.0, 125.0),
}
RTT_BOUNDS = (0.0, 5000.0)

# Inclusive bounds of a scoring request (None = open).
REQUEST_BOUNDS = {
    THROUGHPUT: (0.0, None),
    DROP: (0.0, 100.0),
    BUFFER: (0.0, 100.0),
    TEMP: (-20.0, 120.0),
}

BASE_RTT_MS = 38.0
WHITESPACE = " \t\n\r\f\v"
DEFAULT_LAG_MS = 42.0


def normal_device(col=DEVICE):
    """Trimmed, upper-case device id; null when blank."""
    trimmed = F.btrim(F.col(col), F.lit(WHITESPACE))
    return F.when(F.length(trimmed) > 0, F.upper(trimmed))


def _outside(col, low, high):
    below = (col < low) if low is not None else F.lit(False)
    above = (col > high) if high is not None else F.lit(False)
    return below | above


def frame_errors():
    """``array<string>`` of every rule a raw frame breaks; empty for a valid frame."""
    checks = [
        F.when(normal_device().isNull(), F.lit("device_id:missing")),
        F.when(F.col(PROTOCOL).isNull(), F.lit("protocol:missing")),
    ]
    for gauge, (low, high) in RAW_BOUNDS.items():
        value = clean(F.col(gauge))
        checks.append(F.when(value.isNull(), F.lit(f"{gauge}:missing")))
        checks.append(F.when(_outside(value, low, high), F.lit(f"{gauge}:out_of_range")))
    checks.append(F.when(_outside(F.col(RTT), *RTT_BOUNDS), F.lit(f"{RTT}:out_of_range")))
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def frame_ok():
    """The same rules as one plain predicate, which the scan can use."""
    ok = normal_device().isNotNull() & F.col(PROTOCOL).isNotNull()
    for gauge, (low, high) in RAW_BOUNDS.items():
        ok = ok & F.col(gauge).isNotNull() & (F.col(gauge) >= low) & (F.col(gauge) <= high)
    return ok & (F.col(RTT).isNull() | F.col(RTT).between(*RTT_BOUNDS))


def request_ok():
    """True when a row meets the scoring contract."""
    ok = F.lit(True)
    for gauge, (low, high) in REQUEST_BOUNDS.items():
        ok = ok & F.col(gauge).isNotNull() & ~_outside(F.col(gauge), low, high)
    return ok


def synthetic_rtt(drop=DROP, buffer=BUFFER, base_ms=BASE_RTT_MS):
    """Round-trip time estimated from load, used when nothing was measured. Free of random jitter."""
    load = F.pow(F.col(buffer) / 100.0, F.lit(2.0))
    return F.greatest(F.lit(0.5), dp(F.lit(base_ms) + F.col(drop) * 8.5 + load * 25.0, 3))


def probe_ms(nanos, ok):
    """Elapsed nanoseconds of one probe to milliseconds: floor 0.1 on success, 1.0 on failure."""
    ms = dp(F.col(nanos) / 1_000_000.0, 3)
    return F.when(F.col(ok), F.greatest(F.lit(0.1), ms)).otherwise(F.greatest(F.lit(1.0), ms))


def correlation_id(*cols):
    """Deterministic id of a frame, so a retried task writes the same id again."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256)


__all__ = [
    "GAUGES",
    "RAW_BOUNDS",
    "correlation_id",
    "frame_errors",
    "frame_ok",
    "normal_device",
    "probe_ms",
    "request_ok",
    "synthetic_rtt",
]
