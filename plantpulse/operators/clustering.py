"""Unsupervised regimes: density clustering with k-means fallback, and a silhouette."""

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from plantpulse.operators.dbscan import dbscan
from plantpulse.params import DEFAULTS
from plantpulse.schemas import LABEL
from plantpulse.session import checkpointed

CLUSTERS, SEED, RESTARTS = 3, 42, 10


def _vector(df, cols, out="_vector"):
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def kmeans(df, cols, k=CLUSTERS, seed=SEED, restarts=RESTARTS, label=LABEL):
    """k-means label; the best of ``restarts`` starts by total squared distance."""
    data = _vector(df, cols)
    models = [KMeans(k=k, seed=seed + i, featuresCol="_vector", predictionCol=label).fit(data) for i in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(data).drop("_vector")


def profile(df, row_id, cols, p=DEFAULTS, label=LABEL):
    """Density labels; k-means with three clusters when density finds fewer than two labels."""
    labeled = checkpointed(dbscan(df, row_id, cols, p.dbscan_eps, p.dbscan_min_samples, label))
    if labeled.select(label).distinct().limit(2).count() > 1:
        return labeled
    return kmeans(labeled.drop(label), cols, label=label)  # the written rows, not computed again for every start


def silhouette_squared(df, cols, label=LABEL):
    """Mean silhouette with *squared* Euclidean distance: one pass, any number of rows. None for one label."""
    if df.select(label).distinct().limit(2).count() < 2:
        return None
    # The evaluator wants labels from 0 on; noise (-1) is a cluster of its own.
    data = _vector(df, cols).withColumn("_label", (F.col(label) + 1).cast("double"))
    return ClusteringEvaluator(featuresCol="_vector", predictionCol="_label").evaluate(data)
