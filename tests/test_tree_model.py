"""Stored ensembles: predictions and attributions against a walk of the nested arrays."""

import json
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from contract import model_file
from plantpulse.operators import attribution, policy, tree_model
from plantpulse.schemas import BUFFER, DROP, MODEL_FEATURES

TREES = json.loads(model_file.model_json())["learner"]["gradient_booster"]["model"]["trees"]


def child(tree, node, value):
    missing = value is None or np.isnan(value)
    left = tree["default_left"][node] == 1 if missing else value < tree["split_conditions"][node]
    return tree["left_children"][node] if left else tree["right_children"][node]


def walk(tree, x, node=0):
    while tree["left_children"][node] >= 0:
        node = child(tree, node, x[tree["split_indices"][node]])
    return tree["split_conditions"][node]


def expected(tree, x, known, node=0):
    """Value of a tree when only some features are known: unknown ones take both sides by cover."""
    left, right = tree["left_children"][node], tree["right_children"][node]
    if left < 0:
        return tree["split_conditions"][node]
    f, cover = tree["split_indices"][node], tree["sum_hessian"]
    if f in known:
        return expected(tree, x, known, child(tree, node, x[f]))
    return sum(cover[k] / cover[node] * expected(tree, x, known, k) for k in (left, right))


def shapley(x):
    n, out = len(MODEL_FEATURES), []
    for f in range(n):
        total = 0.0
        for tree in TREES:
            used = {s for s, left in zip(tree["split_indices"], tree["left_children"], strict=True) if left >= 0}
            if f not in used:
                continue
            others = used - {f}
            for size in range(len(others) + 1):
                weight = factorial(size) * factorial(len(used) - size - 1) / factorial(len(used))
                total += sum(weight * (expected(tree, x, {*s, f}) - expected(tree, x, set(s))) for s in combinations(others, size))
        out.append(total)
    return out


@pytest.fixture(scope="module")
def model(spark):
    return model_file.model(spark)


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(1)
    low, high = np.array([model_file.RANGES[f] for f in MODEL_FEATURES], dtype=float).T
    x = low + (high - low) * rng.random((300, len(MODEL_FEATURES))) * 1.2
    x[rng.random(x.shape) < 0.15] = np.nan
    exact = [(t["split_indices"][0], t["split_conditions"][0]) for t in TREES]
    for row, (f, cut) in enumerate(exact):
        x[row, f] = cut  # exactly on the condition
    return x


def test_predictions(model, matrix):
    want = [model_file.BASE + sum(walk(t, x) for t in TREES) for x in matrix]
    assert np.allclose(model.predict(matrix), want, atol=1e-9)
    assert len(model.predict(matrix[:0])) == 0


def test_attributions_are_shapley_values(model, matrix):
    bias, leaves = model.leaves()
    got = attribution.contributions(matrix[:40], leaves)
    for r in range(40):
        assert np.allclose(got[r], shapley(matrix[r]), atol=1e-9)
    assert np.allclose(got.sum(axis=1) + bias, model.predict(matrix[:40]), atol=1e-9)
    assert np.allclose(attribution.contributions(matrix[:40], attribution.grouped(leaves)), got)


def test_grouping_and_steps_change_nothing(model, matrix, monkeypatch):
    _, leaves = model.leaves()
    whole = attribution.contributions(matrix, leaves)
    monkeypatch.setattr(attribution, "STEP_VALUES", 7)
    assert np.allclose(attribution.contributions(matrix, leaves), whole)


def test_leaves_with_few_joint_cases_share_a_table(model, matrix, monkeypatch):
    """A row looks up far fewer tables than there are leaves; the bound on cases changes no value."""
    _, leaves = model.leaves()
    cuts, tables = attribution.tabulated(leaves, matrix.shape[1])
    assert len(tables) < len(leaves) / 2 and all(len(t) <= attribution.MAX_CASES for _, t in tables)
    whole = attribution.contributions(matrix, (cuts, tables))
    for most in (1, 8, 10**5):
        monkeypatch.setattr(attribution, "MAX_CASES", most)
        assert np.allclose(attribution.contributions(matrix, leaves), whole, atol=1e-12)


def test_unknown_features_and_nodes(spark, model):
    with pytest.raises(ValueError, match="does|not given|needs"):
        tree_model.load(spark, model_file.model_path(spark), MODEL_FEATURES[:3])
    nodes = tree_model.read_nodes(spark, model_file.model_path(spark))
    assert nodes.count() == sum(len(t["left_children"]) for t in TREES)
    assert nodes.where("left < 0 and feature is not null").isEmpty()


def test_evidence_quotes_the_models_own_attributions(spark, sf, model):
    """The texts of a diagnosis name the contribution that the model gave, not the analytic one."""
    from contract import data as d
    from contract.model_side import serving
    scored = policy.diagnose(policy.explained(serving(spark, sf), tree_model.scorer(model)), "attributions")
    row = scored.where((F.col(DROP) >= 1.8) & (F.col(BUFFER) >= 65)).first()
    raw = tree_model.predict(model, d.frames(spark, sf).limit(0).withColumns({c: F.lit(0.0) for c in MODEL_FEATURES}))
    assert raw.count() == 0
    texts = " ".join(f["evidence"] for f in row["findings"])
    assert any(f"{abs(row['attributions'][f]):.2f}" in texts or f"{row['attributions'][f]:.1f}" in texts for f in (DROP, BUFFER))
