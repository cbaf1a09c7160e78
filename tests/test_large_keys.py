"""Cutting a large key into blocks changes no result. The limit is set so low that every key is cut."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contract import data as d
from plantpulse.operators import alarms, control, drift, features, folds, kpis, policy, prep
from plantpulse.operators.blockscan import KEEP, step_value, then
from plantpulse.operators.ranks import exact_quantiles
from plantpulse.operators.series import open_series
from plantpulse.params import DEFAULTS
from plantpulse.schemas import DEVICE, EPOCH_MS, GAUGES, ROW_ID, RTT

CUT = replace(DEFAULTS, max_group_rows=7, max_python_group_rows=7)


@pytest.fixture(scope="module")
def frames(spark, sf):
    """One device holds a third of the rows."""
    hot = F.when(F.col(ROW_ID) % 3 == 0, F.lit("NODE_HOT")).otherwise(F.col(DEVICE))
    return d.frames(spark, sf).withColumn(DEVICE, hot).cache()


def rows(df):
    pdf = df.toPandas()
    pdf = pdf[sorted(pdf.columns)]
    for c in pdf.columns:
        if pdf[c].dtype.kind == "f":
            pdf[c] = pdf[c].round(5)
    return sorted(map(repr, pdf.itertuples(index=False, name=None)))


def same(cut, whole):
    a, b = rows(cut), rows(whole)
    assert len(a) == len(b)
    assert a == b


def test_every_row_has_one_owner_and_its_predecessors(spark, frames):
    s = open_series(frames.select(DEVICE, EPOCH_MS, ROW_ID), [DEVICE], EPOCH_MS, ROW_ID, lookback=11, max_rows=20)
    assert s.split
    pdf = s.df.toPandas()
    assert pdf[pdf["_own"]].groupby(ROW_ID).size().eq(1).all() and pdf["_own"].sum() == frames.count()
    for _, device in pdf.groupby(DEVICE):
        own = device[device["_own"]].sort_values([EPOCH_MS, ROW_ID])
        order = own[ROW_ID].tolist()
        for _, block in device.groupby("_block"):
            first = order.index(block[block["_own"]].sort_values([EPOCH_MS, ROW_ID])[ROW_ID].iloc[0])
            assert set(order[max(0, first - 11):first]) <= set(block[ROW_ID])
    assert pdf.groupby([DEVICE, "_block"]).size().max() < 60


@pytest.mark.parametrize("profile", ["serving", "console"])
def test_features(frames, profile):
    same(features.PROFILES[profile](frames, CUT), features.PROFILES[profile](frames))


def test_training_features(frames):
    df = frames.withColumn("network_latency_ms", F.col(RTT))
    same(features.training_features(df, CUT), features.training_features(df))


def test_forward_fill(spark, sf):
    raw = d.telemetry(spark, sf).select(DEVICE, ROW_ID, EPOCH_MS, *GAUGES)
    sparse = raw.withColumns({g: F.when(F.col(ROW_ID) % 23 == i, F.col(g)) for i, g in enumerate(GAUGES)})
    same(prep.forward_fill(sparse, p=CUT), prep.forward_fill(sparse))
    same(prep.forward_fill(sparse.drop(DEVICE), keys=(), p=CUT), prep.forward_fill(sparse.drop(DEVICE), keys=()))


def test_running_totals_and_breaches(frames):
    scored = policy.analytic_score(frames)
    same(kpis.running_totals(scored, policy.PRED, CUT), kpis.running_totals(scored, policy.PRED))
    same(policy.sustained_breaches(scored, p=CUT), policy.sustained_breaches(scored))


def test_debounce(spark, sf):
    commands = d.commands(spark, sf)
    same(control.debounce(commands, p=CUT), control.debounce(commands))
    same(control.debounce(commands, key=None, p=CUT), control.debounce(commands, key=None))


def test_routes_and_gaps(spark, sf, frames):
    decided = d.decided(spark, sf).withColumn(
        "target_device", F.when(F.col(ROW_ID) % 3 == 0, F.lit("NODE_HOT")).otherwise(F.col("target_device"))
    )
    quick = d.compressed(frames)
    same(control.route_of_frames(quick, decided, p=CUT), control.route_of_frames(quick, decided))
    same(control.heartbeat_gaps(quick, p=CUT), control.heartbeat_gaps(quick))


def test_event_log(frames):
    replayed = policy.replay(frames)
    same(alarms.sequence_of_events(replayed, p=CUT), alarms.sequence_of_events(replayed))


def test_quantiles_and_drift(spark, sf):
    base, cur = map(drift.long_form, d.drift_sides(spark, sf))
    probs = [0.1, 0.25, 0.5, 0.9]
    cut = exact_quantiles(base, ["feature"], "value", probs, 50).select("feature", F.explode("quantiles").alias("q"))
    whole = exact_quantiles(base, ["feature"], "value", probs).select("feature", F.explode("quantiles").alias("q"))
    same(cut, whole)
    same(drift.ks_statistic(base, cur, replace(DEFAULTS, max_group_rows=50)), drift.ks_statistic(base, cur))


def test_folds(frames):
    cut = folds.boundaries(frames, [10, 100, 200], p=replace(DEFAULTS, max_group_rows=50))
    ordered = [tuple(r) for r in frames.select(EPOCH_MS, ROW_ID).orderBy(EPOCH_MS, ROW_ID).collect()]
    assert [b[0] for b in cut] == [ordered[i][0] for i in (10, 100, 200)]


def test_step_functions_compose():
    rng = np.random.default_rng(3)
    for _ in range(200):
        def function():
            lo = np.concatenate([[-100], np.sort(rng.choice(np.arange(-50, 50), 5, replace=False))])
            out = rng.integers(-40, 40, 6)
            out[-1] = KEEP if rng.random() < 0.7 else out[-1]
            return lo.astype("int64"), out.astype("int64")

        f, g = function(), function()
        x = np.arange(-99, 99)
        assert np.array_equal(step_value(*then(f, g), x), step_value(*g, step_value(*f, x)))


def test_many_blocks_link_over_levels(spark):
    """A dense series in which the outcome of each block depends on the one before."""
    rng = np.random.default_rng(5)
    times = np.cumsum(rng.integers(1, 400, 3000))
    pdf = pd.DataFrame({
        "action": np.where(rng.random(3000) < 0.9, "reset", "other"), "target_device": "N", "target_interface": "eth0",
        "shedding_factor": 0.5, "target_rate_mbps": 1.0, "standby_node": "S", "reason": "r",
        "requires_approval": rng.random(3000) < 0.2, "approved_by": "", "correlation_id": "c",
        EPOCH_MS: times, ROW_ID: np.arange(3000),
    })
    got = control.debounce(spark.createDataFrame(pdf), p=replace(DEFAULTS, max_python_group_rows=10)).toPandas().sort_values(ROW_ID)
    last, want = -(10**12), []
    for t, action, waits in zip(times, pdf["action"], pdf["requires_approval"]):
        if t - last < 5000:
            want.append("rate_limited")
        elif waits:
            want.append("pending_approval")
        elif action == "other":
            want.append("rejected")
        else:
            want.append("applied")
            last = t
    assert got["status"].tolist() == want


def test_log_runs_on_over_arrow_batches(spark, sf):
    """Several devices in a partition and devices cut by batches give the log of one device at a time."""
    cycles = policy.replay(d.frames(spark, sf))
    want = alarms.sequence_of_events(cycles)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        same(alarms.sequence_of_events(cycles), want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_segment_maps_equal_state_maps_of_each_segment():
    rng = np.random.default_rng(2)
    codes, begins = rng.integers(0, 9, 200), rng.random(200) < 0.1
    begins[0] = True
    starts = [*np.flatnonzero(begins), 200]
    want = np.concatenate([alarms.state_maps(codes[a:b]) for a, b in zip(starts[:-1], starts[1:])])
    assert np.array_equal(alarms.segment_maps(codes, begins), want)
