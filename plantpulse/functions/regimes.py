"""Operating-regime rules."""

from pyspark.sql import functions as F

from plantpulse.schemas import BUFFER, DROP, GAUGES, TEMP

# Regime names and reference centroids (throughput, drop, buffer, temperature).
REGIME_NAMES = ["Nominal Regime", "Congestion State", "Anomaly Vector"]
ANCHORS = [
    (50.0, 0.2, 35.0, 42.0),
    (35.0, 1.2, 75.0, 52.0),
    (15.0, 4.5, 92.0, 72.0),
]


def squared_distance(cols, point):
    """SQL text of the squared distance to a fixed point."""
    return " + ".join(f"({c} - {p}D) * ({c} - {p}D)" for c, p in zip(cols, point))


def nearest(cols, points):
    """Index of the nearest of a fixed list of points; ties to the lowest, 0 when a coordinate is missing.
    The smallest (distance, index) pair inside the projection: no join, no UDF, each distance computed once."""
    pairs = ", ".join(f"struct({squared_distance(cols, p)} as d, {i} as i)" for i, p in enumerate(points))
    missing = " or ".join(f"{c} is null" for c in cols)
    return F.expr(f"case when {missing} then 0 else array_min(array({pairs})).i end")


def live_regime(drop=DROP, buffer=BUFFER, temp=TEMP, cols=None):
    """Regime id of a live frame: hard limits first, nearest anchor only for the warm band."""
    d, b, t = F.col(drop), F.col(buffer), F.col(temp)
    return (
        F.when((d >= 2.5) | (t >= 68.0), F.lit(2))
        .when((b >= 65.0) | (d >= 0.8), F.lit(1))
        .when((d < 0.8) & (b < 65.0) & (t < 60.0), F.lit(0))
        .otherwise(nearest(cols or GAUGES, ANCHORS))
    )


def regime_name(label):
    out = F.lit(REGIME_NAMES[0])
    for i in (2, 1):
        out = F.when(label == i, F.lit(REGIME_NAMES[i])).otherwise(out)
    return out


def training_label():
    """Regime label of the training set; its temperature limit is lower than the live one."""
    d, b, t = F.col(DROP), F.col(BUFFER), F.col(TEMP)
    return (
        F.when((d >= 2.5) | (t >= 65.0), F.lit(2)).when((b >= 65.0) | (d >= 0.8), F.lit(1)).otherwise(F.lit(0))
    )
