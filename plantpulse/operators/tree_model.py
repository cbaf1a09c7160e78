"""Stored tree ensembles: reading a model file of nested node arrays, scoring tables with it, explaining the scores.

The file is JSON. Each tree holds parallel arrays, one entry per node: children (-1 for a leaf), the feature tested and the
condition (``value < condition`` goes left; of a leaf the entry is its value), the side that missing values take, and
the cover (rows that reached the node in training). The file becomes a table of nodes; its size is that of the model."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plantpulse.operators import attribution, forecast
from plantpulse.operators.policy import PRED
from plantpulse.params import DEFAULTS
from plantpulse.schemas import MODEL_FEATURES

# Layout of the model file.
LAYOUT = """learner struct<feature_names array<string>, learner_model_param struct<base_score string>, gradient_booster struct<model struct<
  trees array<struct<left_children array<int>, right_children array<int>, split_indices array<int>, split_conditions array<double>,
  default_left array<int>, sum_hessian array<double>>>>>>"""


def read_nodes(spark, path):
    """Table of nodes: tree, node, left, right, feature, condition, default_left, cover, and the base score of the model."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", LAYOUT).alias("m")).select("m.learner.*")
    trees = text.select("feature_names", F.col("learner_model_param.base_score").cast("double").alias("base"),
                        F.posexplode("gradient_booster.model.trees").alias("tree", "t"))
    arrays = ("left_children", "right_children", "split_indices", "split_conditions", "default_left", "sum_hessian")
    nodes = trees.select("feature_names", "base", "tree", F.posexplode(F.arrays_zip(*[F.col(f"t.{a}").alias(a) for a in arrays])).alias("node", "n"))
    return nodes.select(
        "tree", "node", F.col("n.left_children").alias("left"), F.col("n.right_children").alias("right"),
        F.when(F.col("n.left_children") >= 0, F.get("feature_names", F.col("n.split_indices"))).alias("feature"),
        F.col("n.split_conditions").alias("condition"), (F.col("n.default_left") == 1).alias("default_left"),
        F.col("n.sum_hessian").alias("cover"), "base")


class TreeModel:
    """Node arrays of a model, for vectorised scoring. ``inputs`` names the features in the order of the matrix columns."""

    def __init__(self, nodes, inputs=MODEL_FEATURES):
        rows = sorted(nodes.collect(), key=lambda r: (r["tree"], r["node"]))  # of the size of the model
        self.inputs, self.base = list(inputs), rows[0]["base"] if rows else 0.0
        self.trees = []
        for r in rows:
            if r["node"] == 0:
                self.trees.append([])
            self.trees[-1].append(r)
        unknown = {r["feature"] for r in rows if r["feature"] is not None} - set(self.inputs)
        if unknown:
            raise ValueError(f"the model needs features that are not given: {sorted(unknown)}")
        start = np.cumsum([0, *map(len, self.trees)])[:-1]
        place = {(t, r["node"]): start[t] + r["node"] for t, tree in enumerate(self.trees) for r in tree}
        flat = [(t, r) for t, tree in enumerate(self.trees) for r in tree]
        leaf = np.array([r["left"] < 0 for _, r in flat], dtype=bool)
        own = np.arange(len(flat))
        self.roots = start.astype(np.int64)
        self.left = np.array([own[i] if leaf[i] else place[t, r["left"]] for i, (t, r) in enumerate(flat)], dtype=np.int64)
        self.right = np.array([own[i] if leaf[i] else place[t, r["right"]] for i, (t, r) in enumerate(flat)], dtype=np.int64)
        self.feature = np.array([0 if leaf[i] else self.inputs.index(r["feature"]) for i, (_, r) in enumerate(flat)], dtype=np.int64)
        self.condition = np.array([r["condition"] for _, r in flat], dtype=np.float64)
        self.missing_left = np.array([bool(r["default_left"]) for _, r in flat], dtype=bool)
        self.depth = self._depth()

    def _depth(self):
        here, depth = self.roots, 0
        while True:
            below = np.unique(np.concatenate([self.left[here], self.right[here]])) if len(here) else here
            if (below == np.unique(here)).all() if len(below) == len(np.unique(here)) else False:
                return depth
            here, depth = below, depth + 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Raw prediction of each row: all trees descend together, one level at a time."""
        out = np.full(len(x), self.base)
        for first in range(0, len(x), 4096):
            part = x[first:first + 4096]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                value = part[rows, self.feature[at]]
                goes_left = np.where(np.isnan(value), self.missing_left[at], value < self.condition[at])
                at = np.where(goes_left, self.left[at], self.right[at])
            out[first:first + 4096] += self.condition[at].sum(axis=1)
        return out

    def leaves(self):
        """``(bias, leaves)`` in the form of ``attribution.leaf_tables``."""
        bias, out = self.base, []
        for tree in self.trees:
            value, leaves = attribution.leaves_of(
                {r["node"]: r for r in tree}, 1.0, lambda r: (r["left"], r["right"]) if r["left"] >= 0 else None,
                # value < condition is value <= the next smaller number
                lambda r: (self.inputs.index(r["feature"]), float(np.nextafter(r["condition"], -np.inf)), bool(r["default_left"])),
                lambda r: r["condition"])
            bias += value
            out += leaves
        return bias, out


def load(spark, path, inputs=MODEL_FEATURES):
    return TreeModel(read_nodes(spark, path), inputs)


def predict(model, df, inputs=None, out="prediction"):
    """Raw prediction column. A null feature takes the default side of a test."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(row: pd.DataFrame) -> pd.Series:
        return pd.Series(shared.value.predict(row.to_numpy(dtype="float64")))

    return df.withColumn(out, run(F.struct(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(inputs or model.inputs)])))


def attributions(df, model, out="attributions"):
    """Map of feature to milliseconds plus the bias, as ``attribution.attributions`` gives for fitted models."""
    return attribution.explained(df, *model.leaves(), model.inputs, out)


def scorer(model):
    """Scorer with the interface of ``policy.analytic_score``; its attributions are those of the model."""
    score = forecast.model_scorer(model, predict)
    score.attributions = lambda df: attributions(df, model)
    return score


def score_batch(model, features, p=DEFAULTS):
    """Serving features to forecast and breach flag."""
    return scorer(model)(features).withColumn("sla_violation_expected", F.col(PRED) >= p.sla_latency_ms)


