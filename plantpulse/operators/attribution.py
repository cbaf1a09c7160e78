"""Additive attributions of a boosted-tree forecast (path-dependent tree Shapley values).

A path of a tree of depth four tests at most four features, so the Shapley sum of a leaf has at most sixteen
cases: one per combination of "the row passes the path's tests on this feature". These cases are tabulated once
per leaf, and summed once over leaves whose tests have few joint cases; a row then only looks up one case per sum."""

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantpulse.functions.numbers import dp
from plantpulse.schemas import MODEL_FEATURES
from plantpulse.session import scratch_folder

BIAS = "_bias_baseline"


def _nodes(model, spark):
    """Tree nodes of the stored model, as ``{tree: {node id: row}}``. The table has at most
    ``trees * 2**(depth + 1)`` rows whatever the data."""
    path = scratch_folder(spark, "model")
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.prediction",
        F.col("nodeData.rawCount").cast("double").alias("cover"), F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )
    trees = {}
    for r in rows.collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    return trees


def _case_table(value, fractions):
    """``table[case, feature position]``: contribution when bit j of the case says that test j passes."""
    k = len(fractions)
    table = np.zeros((1 << k, k))
    for case in range(1 << k):
        passes = [case >> j & 1 for j in range(k)]
        for f in range(k):
            others = [j for j in range(k) if j != f]
            total = 0.0
            for size in range(k):
                weight = math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k)
                for known in itertools.combinations(others, size):
                    term = 1.0
                    for j in others:
                        term *= passes[j] if j in known else fractions[j]
                    total += weight * term
            table[case, f] = value * (passes[f] - fractions[f]) * total
    return table


def leaves_of(nodes, weight, children, test, value):
    """``(bias, leaves)`` of one tree. ``children(node)`` names the two children or None, ``test(node)`` gives (feature, cut,
    whether missing values go left), rows with a value of at most ``cut`` go left. A leaf is ``(features, lows, highs,
    missing passes, case table)``: a row passes feature j when its value lies in ``(low, high]``."""
    leaves, bias, stack = [], 0.0, [(nodes[0], {})]
    while stack:
        node, path = stack.pop()
        below = children(node)
        if below is None:
            held = weight * value(node)
            fractions = [z for *_, z in path.values()]
            bias += held * float(np.prod(fractions))
            if path:
                lows, highs, missing, _ = zip(*path.values(), strict=True)
                leaves.append((list(path), list(lows), list(highs), list(missing), _case_table(held, fractions)))
            continue
        f, cut, missing_left = test(node)
        lo, hi, passes, z = path.get(f, (-np.inf, np.inf, True, 1.0))
        sides = ((lo, min(hi, cut), passes and missing_left), (max(lo, cut), hi, passes and not missing_left))
        for child, bounds in zip(below, sides, strict=True):
            kid = nodes[child]
            stack.append((kid, {**path, f: (*bounds, z * kid["cover"] / node["cover"])}))
    return bias, leaves


def leaf_tables(model, spark):
    """``(bias, leaves)`` of a fitted model; missing values go right at every test."""
    trees = _nodes(model, spark)
    bias, leaves = 0.0, []
    for tree, weight in enumerate(model.treeWeights):
        own, found = leaves_of(
            trees[tree], weight, lambda r: (r["leftChild"], r["rightChild"]) if r["leftChild"] >= 0 else None,
            lambda r: (r["feature"], r["threshold"], False), lambda r: r["prediction"])
        bias += own
        leaves += found
    return bias, leaves


# Looked-up values that a step of ``contributions`` holds at once (they should stay in a processor's cache), and cases of one
# look-up table.
STEP_VALUES, MAX_CASES = 18_000, 1024


def grouped(leaves):
    """Leaves with the same features in the same order, as arrays: features, and for all leaves of the group lows, highs, missing
    passes and case tables."""
    groups = {}
    for features, *rest in leaves:
        groups.setdefault(tuple(features), []).append(rest)
    return [(list(features), *(np.array([leaf[k] for leaf in group]) for k in range(4))) for features, group in groups.items()]


def tabulated(leaves, size):
    """``(cuts, tables)`` for a list of leaves. ``cuts`` holds the ends of all tests per feature: they part its values into
    intervals, with one more for missing values. A table serves leaves whose tests together tell at most ``MAX_CASES`` cases
    apart (one leaf at least): per feature the step of each interval, and one row of contributions per sum of steps."""
    ends = [set() for _ in range(size)]
    for features, lows, highs, *_ in leaves:
        for f, low, high in zip(features, lows, highs, strict=True):
            ends[f].update(v for v in (low, high) if math.isfinite(v))
    cuts = [np.array(sorted(e)) for e in ends]
    low_ends, high_ends = [np.append(-np.inf, c) for c in cuts], [np.append(c, np.inf) for c in cuts]
    tables, classes, held = [], {}, []
    for features, lows, highs, missing, table in leaves:
        passes = [np.append((low_ends[f] >= low) & (high_ends[f] <= high), take)
                  for f, low, high, take in zip(features, lows, highs, missing, strict=True)]
        finer = dict(classes)
        for f, row in zip(features, passes, strict=True):
            finer[f] = np.unique(finer.get(f, 0) * 2 + row, return_inverse=True)[1]
        if held and math.prod(int(c.max()) + 1 for c in finer.values()) > MAX_CASES:
            tables.append(_summed(classes, held, size))
            held, finer = [], {f: np.unique(row, return_inverse=True)[1] for f, row in zip(features, passes, strict=True)}
        classes = finer
        held.append((features, passes, table))
    if held:
        tables.append(_summed(classes, held, size))
    return cuts, tables


def _summed(classes, held, size):
    """Steps per feature and the summed contributions of all held leaves per case."""
    counts = [int(c.max()) + 1 for c in classes.values()]
    axis = {f: i for i, f in enumerate(classes)}
    total = np.zeros((*counts, size))
    for features, passes, table in held:
        case = np.zeros([1] * len(counts), dtype=np.int64)
        for bit, (f, row) in enumerate(zip(features, passes, strict=True)):
            by_class = np.zeros(counts[axis[f]], dtype=np.int64)
            by_class[classes[f]] = row
            case = case + (by_class << bit).reshape([-1 if i == axis[f] else 1 for i in range(len(counts))])
        total[..., features] += table[case]
    strides = np.cumprod([1, *counts[:0:-1]])[::-1]
    return [(f, classes[f] * stride) for f, stride in zip(classes, strides, strict=True)], total.reshape(-1, size)


def contributions(x, leaves):
    """``(rows, features)`` contributions for a feature matrix; ``leaves`` as a list, grouped or tabulated."""
    if isinstance(leaves, list) and leaves and leaves[0][1].__class__ is np.ndarray:
        leaves = [(features, *leaf) for features, *arrays in leaves for leaf in zip(*arrays, strict=True)]
    cuts, tables = leaves if isinstance(leaves, tuple) else tabulated(leaves, x.shape[1])
    out = np.zeros(x.shape)
    step_rows = max(1, STEP_VALUES // x.shape[1])
    for start in range(0, len(x), step_rows):
        part = x[start:start + step_rows]
        at = [np.where(np.isnan(part[:, f]), len(c) + 1, np.searchsorted(c, part[:, f])) for f, c in enumerate(cuts)]
        for steps, table in tables:
            out[start:start + step_rows] += table.take(sum(step.take(at[f]) for f, step in steps), axis=0)
    return out


def attributions(df, model, inputs=MODEL_FEATURES, out="attributions"):
    """Map of feature to milliseconds (three decimals) plus the bias. The unrounded values of a row and the bias
    add up to its raw prediction."""
    return explained(df, *leaf_tables(model, df.sparkSession), inputs, out)


def explained(df, bias, leaves, inputs=MODEL_FEATURES, out="attributions"):
    """``attributions`` from the leaves of a model whose features stand in the columns ``inputs``."""
    size = len(MODEL_FEATURES)
    shared = df.sparkSession.sparkContext.broadcast(tabulated(leaves, size))

    def explain(batches):
        for batch in batches:
            row = batch.column(batch.num_columns - 1)
            x = np.column_stack([row.field(i).to_numpy(zero_copy_only=False).astype("float64") for i in range(size)])
            values = contributions(x, shared.value)
            offsets = pa.array(np.arange(0, values.size + 1, size), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], names=[*batch.schema.names[:-1], "_contrib"])

    features = F.struct(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([*df.schema.fields, T.StructField("_contrib", T.ArrayType(T.DoubleType()))])
    entries = []
    for i, name in enumerate(MODEL_FEATURES):
        entries += [F.lit(name), dp(F.get("_contrib", F.lit(i)), 3)]
    return (
        df.withColumn("_features", features).mapInArrow(explain, schema)
        .withColumn(out, F.create_map(*entries, F.lit(BIAS), dp(F.lit(bias), 3)))
        .withColumn("attribution_total", F.aggregate("_contrib", F.lit(bias), lambda acc, v: acc + v))
        .drop("_contrib")
    )
