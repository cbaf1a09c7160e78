"""Online centroids of the live regimes."""

from pyspark.sql import functions as F

from plantpulse.functions.regimes import ANCHORS, nearest
from plantpulse.schemas import GAUGES


def seed_centroids(spark):
    """State table with one row per centroid; the seeds count as one row each."""
    rows = [(i, 1, *map(float, a)) for i, a in enumerate(ANCHORS)]
    return spark.createDataFrame(rows, "centroid int, weight long, " + ", ".join(f"{g} double" for g in GAUGES))


def update_centroids(state, batch, cols=tuple(GAUGES)):
    """Assign a batch to the nearest centroid and move each centroid to the weighted mean. The state has one
    row per centroid and is read as literals, so the batch is reduced in one pass without a join."""
    current = state.orderBy("centroid").collect()
    pick = nearest(cols, [[r[c] for c in cols] for r in current])
    sums = (
        batch.dropna(subset=list(cols))
        .groupBy(pick.alias("centroid"))
        .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in cols])
    )
    n = F.coalesce("_n", F.lit(0))
    moved = [
        ((F.col(c) * F.col("weight") + F.coalesce(f"_s_{c}", F.lit(0.0))) / (F.col("weight") + n)).alias(c) for c in cols
    ]
    return state.join(sums, "centroid", "left").select("centroid", (F.col("weight") + n).alias("weight"), *moved)
