"""Known inputs and brute-force comparisons."""

import math
from fractions import Fraction
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contract import data as d
from plantpulse.functions import frames as fr
from plantpulse.functions.numbers import dp
from plantpulse.functions.regimes import live_regime, regime_name
from plantpulse.operators import (
    alarms, attribution, clustering, control, drift, features, folds, forecast, policy, prep, ranks, regimes,
)
from plantpulse.operators.dbscan import dbscan
from plantpulse.params import DEFAULTS, Params
from plantpulse.schemas import (
    BUFFER, COMMANDS, DEVICE, DROP, EPOCH_MS, FRAMES, GAUGES, LABEL, MODEL_FEATURES, PROTOCOL, ROW_ID, RTT, TARGET, TEMP, THROUGHPUT,
)
from plantpulse.sources import decoders, tables


def gauges(spark, *rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{g} double" for g in GAUGES))


def test_params_have_bounds():
    assert DEFAULTS.sla_latency_ms == 60.0
    with pytest.raises(ValueError):
        Params(sla_latency_ms=1000.0)


# --- decoders ----------------------------------------------------------------------------------------------


def test_decode_json(spark):
    texts = [
        '{"throughput_mbps": 88.5, "packet_drop_percentage": 0.45, "buffer_utilization_percentage": 50.0, "node_temperature_celsius": 45.0}',
        '{"device_id": "X", "throughput_mbps": "12.5", "metadata": {"a": "b"}}',
        '{"throughput_mbps": null}', '{"throughput_mbps": "12d"}', "{broken",
    ]
    out = decoders.decode_json(spark.createDataFrame([(t,) for t in texts], "payload string")).collect()
    assert [r[THROUGHPUT] for r in out] == [88.5, 12.5, None, None, None]
    assert [r[DEVICE] for r in out] == ["PLC_NODE_ALPHA", "X", "PLC_NODE_ALPHA", "PLC_NODE_ALPHA", None]
    assert out[1][DROP] == 0.2 and out[1][BUFFER] == 35.0 and out[1][TEMP] == 42.0 and out[1]["metadata"] == {"a": "b"}
    assert [r["decode_ok"] for r in out] == [True, True, True, True, False] and out[0][PROTOCOL] == "mqtt"


def test_decode_registers_and_nodes(spark):
    regs = decoders.decode_registers(spark.createDataFrame([([620, 35, 450, 480],), ([620],)], "registers array<int>")).collect()
    assert [regs[0][g] for g in GAUGES] == [62.0, 0.35, 45.0, 48.0]
    assert [regs[1][g] for g in GAUGES] == [62.0, 0.2, 40.0, 42.0] and regs[0][DEVICE] == "PLC_NODE_BETA"
    nodes = spark.createDataFrame([({"ns=2;s=Throughput": 74.2, "ns=2;s=PacketLoss": 0.12},)], "nodes map<string,double>")
    row = decoders.decode_nodes(nodes).first()
    assert [row[g] for g in GAUGES] == [74.2, 0.12, 45.0, 43.5]


def test_records_match_struct_layout(spark):
    import struct

    values = [(84.25, 0.35, 42.5, 47.5), (0.0, 1e-40, 3.4e38, 1.0), (-2.5, 2.0**-126, 65504.0, 0.1)]
    df = gauges(spark, *values).withColumn("payload", decoders.encode_record(0x32, 3, 0, 0x5F))
    packed = [bytes(r["payload"]) for r in df.collect()]
    assert packed == [struct.pack(">BBHffffB", 0x32, 3, 0, t, dr, c, b, 0x5F) for t, dr, b, c in values]
    for row, (t, dr, b, c) in zip(decoders.decode_record(df.select("payload")).collect(), values):
        assert [row[THROUGHPUT], row[DROP], row[BUFFER], row[TEMP]] == [float(np.float32(v)) for v in (t, dr, b, c)]
        assert (row["header_1"], row["header_2"], row["header_3"], row["gpio_mask"]) == (50, 3, 0, 95)


def test_capture_log(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\xab"),), (bytearray(range(20)),)], "payload binary")
    out = decoders.capture_log(df).collect()
    assert out[0]["hex"] == "01 AB" and out[0]["bytes"] == 2
    assert out[1]["hex"].endswith("0E 0F...") and out[1]["bytes"] == 20


# --- quality and preparation -------------------------------------------------------------------------------


def test_quality_gate_splits_all_rows(spark, sf):
    raw = d.faulty(spark, sf)
    good, bad = prep.valid_frames(raw), prep.quarantine(raw)
    assert good.count() + bad.count() == raw.count()
    assert bad.where(F.size("errors") == 0).isEmpty()
    assert prep.check(good).where(F.size("errors") > 0).isEmpty()
    nan = raw.withColumn(DROP, F.lit(float("nan")))
    assert prep.valid_frames(nan).isEmpty() and prep.quarantine(nan).count() == raw.count()


def test_bounds_are_inclusive(spark):
    df = gauges(spark, (0, 0, 0, -20), (10000, 100, 100, 125), (10000.1, 0, 0, 0), (0, 0, 0, -20.1)).withColumns(
        {DEVICE: F.lit(" plc_1 "), PROTOCOL: F.lit("mqtt"), RTT: F.lit(None).cast("double")}
    )
    assert [r["n"] for r in df.select(F.size(fr.frame_errors()).alias("n")).collect()] == [0, 0, 1, 1]
    assert df.select(fr.normal_device()).first()[0] == "PLC_1"


def test_synthetic_rtt(spark):
    out = gauges(spark, (0, 0.1, 20, 0), (0, 3.5, 90, 0)).select(fr.synthetic_rtt().alias("r")).collect()
    assert [r["r"] for r in out] == [39.85, 88.0]


def test_fill_and_scale(spark):
    pdf = pd.DataFrame(np.random.default_rng(1).normal(50, 10, (1200, 4)), columns=GAUGES)
    pdf.loc[10, THROUGHPUT] = np.nan
    pdf[TEMP] = 42.0
    df = spark.createDataFrame(pdf.assign(**{DEVICE: "N", EPOCH_MS: range(1200), ROW_ID: range(1200)}))
    df = df.withColumn(THROUGHPUT, F.nanvl(THROUGHPUT, F.lit(None).cast("double")))
    filled = prep.forward_fill(df)
    assert filled.where(F.col(THROUGHPUT).isNull()).isEmpty()
    scaled, scaler = prep.min_max_scale(filled)
    stats = scaled.agg(*[F.min(g).alias(f"a{i}") for i, g in enumerate(GAUGES)], *[F.max(g).alias(f"b{i}") for i, g in enumerate(GAUGES)]).first()
    assert [stats[f"a{i}"] for i in range(4)] == [0.0] * 4 and [stats[f"b{i}"] for i in range(4)] == [1.0, 1.0, 1.0, 0.0]
    back = prep.invert_scaler(scaled, scaler).join(filled.select(ROW_ID, *[F.col(g).alias(f"o{i}") for i, g in enumerate(GAUGES)]), ROW_ID)
    assert back.where(" or ".join(f"abs({g} - o{i}) > 1e-9" for i, g in enumerate(GAUGES))).isEmpty()


def test_serving_features_of_five_frames(spark):
    rows = [("N", "mqtt", i, i * 1000, 50.0 + 5 * i, 0.2 + 0.1 * i, 30.0 + 2 * i, 40.0, 41.0 + 1.5 * i, "c") for i in range(5)]
    frames = spark.createDataFrame(rows, FRAMES)
    row = features.latest_features(frames, "N").first()
    assert (row["samples_in_window"], row["buffer_peak"], row["lag_latency_1"], row["lag_latency_2"]) == (5, 38.0, 45.5, 44.0)
    assert row["throughput_slope"] == 5.0 and features.latest_features(frames, "unknown").isEmpty()
    one = features.prediction_request(features.serving_features(frames.where(f"{ROW_ID} = 0")), 1).first()
    assert one[THROUGHPUT] == 50.0 and one[LABEL] == 1 and one["lag_latency_1"] == one["lag_latency_2"] == 41.0


# --- regimes -----------------------------------------------------------------------------------------------


def test_regimes(spark):
    df = gauges(spark, (50, 0.1, 25, 41), (15, 4.5, 95, 75), (50, 0.1, 70, 50), (14, 0.7, 64, 67)).withColumn(LABEL, live_regime())
    assert [(r[LABEL], r["n"]) for r in df.withColumn("n", regime_name(F.col(LABEL))).collect()] == [
        (0, "Nominal Regime"), (2, "Anomaly Vector"), (1, "Congestion State"), (1, "Congestion State"),
    ]
    missing = df.limit(1).withColumns({THROUGHPUT: F.lit(None).cast("double"), TEMP: F.lit(63.0)})
    assert missing.select(live_regime()).first()[0] == 0


def brute_dbscan(x, eps, need):
    square = np.zeros((len(x), len(x)))
    for i in range(x.shape[1]):
        square += (x[:, i, None] - x[None, :, i]) ** 2
    near = square <= eps * eps
    core, label, cluster = near.sum(1) >= need, -np.ones(len(x), int), 0
    for i in range(len(x)):
        if label[i] != -1 or not core[i]:
            continue
        stack, label[i] = [i], cluster
        while stack:
            point = stack.pop()
            if core[point]:
                for q in np.flatnonzero(near[point]):
                    if label[q] == -1:
                        label[q] = cluster
                        stack.append(q)
        cluster += 1
    return label


@pytest.mark.parametrize("case", ["mixed", "dense", "grid"])
def test_dbscan_equals_brute_force(spark, case):
    rng = np.random.default_rng({"mixed": 1, "dense": 2, "grid": 3}[case])
    if case == "mixed":
        x = np.concatenate([rng.normal(c, s, (100, 4)) for c, s in zip(rng.random((3, 4)), (0.05, 0.15, 0.08))] + [rng.random((80, 4))])
        eps, need = 0.2, 6
    elif case == "dense":  # cells with far more points than a box is refined at once, and gaps close to eps
        left, right = rng.random((1500, 2)) * 0.2, rng.random((1500, 2)) * 0.2 + [0.295, 0.0]
        x, eps, need = np.concatenate([left, right, rng.random((60, 2))]), 0.1, 8
    else:  # distances exactly eps and identical points
        x = np.array([(i * 0.25, j * 0.25) for i in range(9) for j in range(9)] + [(5.0, 5.0)] * 6)
        eps, need = 0.25, 5
    x = x[rng.permutation(len(x))]
    names = [f"c{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(rid=range(len(x))))
    got = dbscan(df, "rid", names, eps, need).toPandas().sort_values("rid")["label"].to_numpy()
    assert np.array_equal(got, brute_dbscan(x, eps, need))


def test_profile_falls_back_to_kmeans(spark):
    rng = np.random.default_rng(4)
    x = rng.random((60, 4)) * 0.05
    df = spark.createDataFrame(pd.DataFrame(x, columns=GAUGES).assign(**{ROW_ID: range(60)}))
    out = clustering.profile(df, ROW_ID, GAUGES)
    assert {r[0] for r in out.select(LABEL).distinct().collect()} == {0, 1, 2}


def test_squared_silhouette_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (60, 4)), rng.normal(3, 1, (50, 4)), rng.normal(9, 1, (1, 4))])
    label = np.array([0] * 60 + [1] * 50 + [-1])
    dist = ((x[:, None] - x[None]) ** 2).sum(-1)
    widths = []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        if not own.any():
            widths.append(0.0)
            continue
        a = dist[i, own].mean()
        b = min(dist[i, label == c].mean() for c in set(label) - {label[i]})
        widths.append((b - a) / max(a, b))
    df = spark.createDataFrame(pd.DataFrame(x, columns=GAUGES).assign(**{ROW_ID: range(111), LABEL: label}))
    assert abs(clustering.silhouette_squared(df, GAUGES) - np.mean(widths)) < 1e-9
    assert clustering.silhouette_squared(df.withColumn(LABEL, F.lit(0)), GAUGES) is None


def test_centroid_update_keeps_starved_centroids(spark):
    out = regimes.update_centroids(regimes.seed_centroids(spark), gauges(spark, (52, 0.2, 35, 42))).orderBy("centroid").collect()
    assert out[0][THROUGHPUT] == 51.0 and out[0]["weight"] == 2 and out[2][THROUGHPUT] == 15.0 and out[2]["weight"] == 1


# --- forecast ----------------------------------------------------------------------------------------------


def test_fold_sizes():
    starts = folds.fold_starts(200)
    assert starts == [35, 68, 101, 134, 167, 200]
    with pytest.raises(ValueError):
        folds.fold_starts(5)


def test_folds_partition_rows_in_time(spark, sf):
    rows = d.frames(spark, sf).select(EPOCH_MS, ROW_ID, (F.floor(F.col(EPOCH_MS) / 86_400_000)).alias("day"))
    order = [r[0] for r in rows.orderBy("day", ROW_ID).select(ROW_ID).collect()]
    starts = folds.fold_starts(len(order))
    for (fold, train, test), a, b in zip(folds.time_series_folds(rows, time="day"), starts, starts[1:]):
        assert {r[ROW_ID] for r in train.collect()} == set(order[:a])
        assert {r[ROW_ID] for r in test.collect()} == set(order[a:b])


def test_hash_split_is_stable(spark):
    df = spark.range(2000).withColumnRenamed("id", ROW_ID)
    a, b = folds.hash_split(df)
    again, _ = folds.hash_split(df.repartition(7))
    assert a.count() + b.count() == 2000 and 1500 < a.count() < 1700
    assert a.exceptAll(again).isEmpty()


def test_metrics(spark):
    y, p = np.array([1.0, 2, 4, 8]), np.array([1.5, 2, 3, 9])
    row = forecast.regression_metrics(spark.createDataFrame(pd.DataFrame({TARGET: y, "prediction": p}))).first()
    assert math.isclose(row["rmse"], np.sqrt(np.mean((y - p) ** 2))) and math.isclose(row["mae"], 0.625)
    assert math.isclose(row["r2"], 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


@pytest.fixture(scope="module")
def model(spark, sf):
    data = forecast.training_set(d.frames(spark, sf)).cache()
    return forecast.fit(data, trees=8), data


def test_model_round_trip_and_scores(spark, model, tmp_path):
    fitted, data = model
    path = str(tmp_path / "m")
    forecast.save(fitted, path)
    loaded = forecast.load_or_train(path, lambda: pytest.fail("must not train"))
    assert loaded.getNumTrees == 8
    a, b = (forecast.predict(m, data).agg(F.sum("prediction")).first()[0] for m in (fitted, loaded))
    assert math.isclose(a, b)
    assert forecast.regression_metrics(forecast.predict(loaded, data)).first()["r2"] > 0.9
    trained = forecast.load_or_train(str(tmp_path / "new"), lambda: fitted)
    assert trained is fitted and (tmp_path / "new").exists()


def brute_shapley(trees, weights, x, features_):
    """Expected tree value with a set of known features, summed over all orders of features."""
    import itertools

    def value(nodes, node, known):
        if node["leftChild"] < 0:
            return node["prediction"]
        left, right = nodes[node["leftChild"]], nodes[node["rightChild"]]
        if node["feature"] in known:
            return value(nodes, left if x[node["feature"]] <= node["threshold"] else right, known)
        total = value(nodes, left, known) * left["cover"] + value(nodes, right, known) * right["cover"]
        return total / node["cover"]

    def game(known):
        return sum(w * value(t, t[0], known) for t, w in zip(trees, weights))

    n, out = len(features_), []
    for f in features_:
        others = [g for g in features_ if g != f]
        total = 0.0
        for size in range(n):
            for s in itertools.combinations(others, size):
                weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                total += weight * (game({*s, f}) - game(set(s)))
        out.append(total)
    return out


def test_attributions_are_shapley_values_and_add_up(spark, model):
    fitted, data = model
    nodes = attribution._nodes(fitted, spark)
    trees = [nodes[i] for i in range(len(nodes))][:3]
    _, leaves = attribution.leaf_tables(fitted, spark)
    rows = np.array(data.select(*MODEL_FEATURES).limit(3).collect(), dtype="float64")
    partial = [leaf for leaf in leaves]
    per_tree = sum(1 for t in trees for n in t.values() if n["leftChild"] < 0)
    got = attribution.contributions(rows, partial[:per_tree])
    for r in range(len(rows)):
        want = brute_shapley(trees, fitted.treeWeights, rows[r], list(range(len(MODEL_FEATURES))))
        assert np.allclose(got[r], want, atol=1e-9)
    out = attribution.attributions(forecast.predict(fitted, data), fitted)
    assert out.where(F.abs(F.col("attribution_total") - F.col("prediction")) > 1e-9).isEmpty()
    assert set(out.first()["attributions"]) == {*MODEL_FEATURES, attribution.BIAS}


def test_retraining_follows_drift(spark, sf, tmp_path):
    frames = d.frames(spark, sf)
    base = drift.long_form(frames)
    same = drift.drift_report(base, base)
    assert forecast.retrain_on_drift(same, frames, str(tmp_path / "a"), trees=2) is None
    moved = drift.drift_report(base, drift.long_form(frames.withColumn(TEMP, F.col(TEMP) + 30)))
    assert forecast.retrain_on_drift(moved, frames, str(tmp_path / "b"), trees=2).getNumTrees == 2
    assert forecast.retrain_on_drift(moved, frames, str(tmp_path / "c"), 2, replace(DEFAULTS, auto_retrain_on_drift=False)) is None


# --- drift -------------------------------------------------------------------------------------------------


def inside_band(gap, n, m):
    """Share of lattice paths that leave the band, by exact counting."""
    row = [0] * (m + 1)
    for i in range(n + 1):
        for j in range(m + 1):
            if abs(i * m - j * n) >= gap:
                row[j] = 0
            elif i == j == 0:
                row[j] = 1
            else:
                row[j] = (row[j] if i else 0) + (row[j - 1] if j else 0)
    return 1.0 if gap <= 0 else 1 - Fraction(row[m], math.comb(n + m, n))


@pytest.mark.parametrize("n, m", [(1, 1), (3, 4), (5, 5), (7, 2), (30, 41)])
def test_exact_p_value(n, m):
    for gap in range(0, n * m + 2, max(1, n * m // 12)):
        assert abs(drift.exact_p_value(gap, n, m) - inside_band(gap, n, m)) < 1e-12


def test_psi_and_ks_equal_numpy(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(6)
    base = {"a": np.round(rng.normal(50, 5, 500), 1), "b": rng.exponential(1, 300), "c": np.full(100, 2.0)}
    cur = {"a": np.round(rng.normal(53, 6, 400), 1), "b": rng.exponential(1, 30), "c": np.full(50, 2.0)}
    frame = lambda m: spark.createDataFrame([(k, float(v)) for k, x in m.items() for v in x], "feature string, value double")
    report = {r["feature"]: r for r in drift.drift_report(frame(base), frame(cur)).collect()}
    for k in base:
        edges = np.percentile(base[k], np.linspace(0, 100, 11))
        edges[0], edges[-1] = -np.inf, np.inf
        share = [np.maximum(np.histogram(v, edges)[0] / len(v), 1e-4) for v in (base[k], cur[k])]
        psi = max(0.0, ((share[1] - share[0]) * np.log(share[1] / share[0])).sum())
        at = np.union1d(base[k], cur[k])
        d_ks = max(abs(np.searchsorted(np.sort(base[k]), at, "right") / len(base[k]) - np.searchsorted(np.sort(cur[k]), at, "right") / len(cur[k])))
        assert abs(report[k]["psi"] - psi) < 6e-5 and abs(report[k]["ks_statistic"] - d_ks) < 6e-5
        assert abs(report[k]["p_value"] - inside_band(round(d_ks * len(base[k]) * len(cur[k])), len(base[k]), len(cur[k]))) < 1e-5
    monkeypatch.setattr(drift, "EXACT_ROWS", 10)
    for r in drift.ks_statistic(frame(base), frame(cur)).collect():
        n, m = len(base[r["feature"]]), len(cur[r["feature"]])
        x = report[r["feature"]]["ks_statistic"] * math.sqrt(n * m / (n + m))
        p = 1.0 if x == 0 else 2 * sum((-1) ** (i - 1) * math.exp(-2 * i * i * x * x) for i in range(1, 2000))
        assert abs(r["p_value"] - min(1.0, p)) < 1e-3  # the distance is rounded to four decimals
    stored = tmp_path / "counts"
    drift.set_baseline_counts(frame(base), str(stored))
    again = drift.report_of_counts(drift.load_baseline_counts(spark, str(stored)), drift.side_counts(frame(cur), "c"))
    assert {r["feature"]: (r["psi"], r["ks_statistic"]) for r in again.collect()} == {k: (r["psi"], r["ks_statistic"]) for k, r in report.items()}
    assert report["c"]["psi"] == 0.0 and not report["c"]["drift_detected"]


def test_drift_needs_twenty_values_and_a_baseline(spark):
    base = spark.createDataFrame([("a", float(i)) for i in range(50)] + [("b", 1.0)] * 30, "feature string, value double")
    cur = spark.createDataFrame([("a", 1.0)] * 19 + [("z", 1.0)] * 40, "feature string, value double")
    report = drift.drift_report(base, cur)
    assert report.isEmpty()
    assert drift.drift_summary(report).first().asDict() == {"overall_max_psi": 0.0, "psi_threshold": 0.2, "retrain_recommended": False}


def test_quantiles_interpolate(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(0, 1, 500), 2)
    df = spark.createDataFrame([("k", float(v)) for v in x], "k string, v double")
    for limit in (10_000, 40):
        got = ranks.exact_quantiles(df, ["k"], "v", [0.0, 0.1, 0.37, 1.0], limit).first()["quantiles"]
        assert np.allclose(got, np.percentile(x, [0, 10, 37, 100]))


# --- decisions ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("row, pred, risk, action, standby", [
    ((50, 3.8, 40, 45), 88.5, "CRITICAL_BREACH", "ha_failover", "PLC_NODE_DELTA"),
    ((50, 0.5, 88, 45), 64.0, "CRITICAL_BREACH", "traffic_shedding", None),
    ((50, 0.1, 30, 42), 41.5, "NOMINAL_STABLE", "none", None),
])
def test_diagnosis(spark, row, pred, risk, action, standby):
    out = policy.diagnose(gauges(spark, row).withColumn(policy.PRED, F.lit(pred))).first()
    assert (out["risk_level"], out["mitigation_action"]) == (risk, action)
    assert (out["action_params"]["standby_node"] if out["action_params"] else None) == standby
    assert len(out["findings"]) == 1 and out["confidence_score"] == 0.95


def commands(spark, *rows):
    full = [(a, "N", "eth0", None, None, None, "r", False, None, "c", t, i) for i, (a, t) in enumerate(rows)]
    return spark.createDataFrame(full, COMMANDS)


def test_debounce_route_and_limit(spark):
    decided = control.debounce(commands(spark, ("ha_failover", 0), ("reset", 4999), ("reset", 5000), ("traffic_shedding", 10000), ("thermal_regulation", 15000)))
    rows = decided.orderBy(ROW_ID).collect()
    assert [r["status"] for r in rows] == ["applied", "rate_limited", "applied", "applied", "rejected"]
    assert rows[1]["retry_after_sec"] == 0.0 and rows[3]["rate_mbps"] == 82.0
    route = control.current_route(decided).first()
    assert (route["active_route"], route["is_failover"], route["switched_at_ms"]) == ("PLC_NODE_ALPHA", False, 5000)
    assert control.active_limits(decided).first()["rate_mbps"] == 82.0
    cleared = control.debounce(commands(spark, ("traffic_shedding", 0), ("reset", 6000)))
    assert control.active_limits(cleared).isEmpty()


def test_debounce_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    n = 600
    pdf = pd.DataFrame({
        "action": rng.choice(["reset", "ha_failover", "noop"], n, p=[0.4, 0.3, 0.3]), "target_device": rng.choice(["A", "B", "C"], n),
        "target_interface": "eth0", "shedding_factor": 0.5, "target_rate_mbps": 1.0, "standby_node": "S", "reason": "r",
        "requires_approval": rng.random(n) < 0.3, "approved_by": rng.choice(["", "eng"], n), "correlation_id": "c",
        EPOCH_MS: np.sort(rng.integers(0, 400_000, n)), ROW_ID: np.arange(n),
    })
    got = control.debounce(spark.createDataFrame(pdf)).toPandas().sort_values(ROW_ID)
    last, want = {}, []
    for r in pdf.itertuples():
        if getattr(r, EPOCH_MS) - last.get(r.target_device, -(10**9)) < 5000:
            want.append("rate_limited")
        elif r.requires_approval and not r.approved_by:
            want.append("pending_approval")
        elif r.action == "noop":
            want.append("rejected")
        else:
            want.append("applied")
            last[r.target_device] = getattr(r, EPOCH_MS)
    assert got["status"].tolist() == want


def test_event_log_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    n = 500
    flags = rng.random((n, 3)) < [0.5, 0.5, 0.4]
    pdf = pd.DataFrame({
        DEVICE: rng.choice(["A", "B"], n), EPOCH_MS: np.arange(n), ROW_ID: np.arange(n), DROP: 2.0,
        "failover_active": flags[:, 0], "mitigation_active": flags[:, 1], policy.PRED: np.where(flags[:, 2], 70.0, 50.0),
    })
    fixed = spark.createDataFrame(
        [("A", 100, 10_000, "ALM-5099", "P2-WARN", "COPILOT_ACTUATE", "manual", "ACTUATED_0x04")],
        f"{DEVICE} string, {EPOCH_MS} long, {ROW_ID} long, alarm_id string, priority string, tag string, event string, quality string",
    )
    got = alarms.sequence_of_events(spark.createDataFrame(pdf), fixed).toPandas().sort_values([EPOCH_MS, ROW_ID])
    want = []
    for dev in ("A", "B"):
        last = None
        for r in pdf[pdf[DEVICE] == dev].itertuples():
            if dev == "A" and r.timestamp_epoch_ms > 100 and (("A", 10_000, "COPILOT_ACTUATE")) not in want:
                want.append(("A", 10_000, "COPILOT_ACTUATE"))
                last = "COPILOT_ACTUATE"
            for on, tag in zip((r.failover_active, r.mitigation_active, r.predicted_latency_ms >= 60), ("PLC_FAILOVER", "QOS_SHAPER", "LAT_SLA_BREACH")):
                if on and last != tag:
                    want.append((dev, r.event_id, tag))
                    last = tag
                    break
    found = list(got[[DEVICE, ROW_ID, "tag"]].itertuples(index=False, name=None))
    assert sorted(found) == sorted(want)
    assert got[got["tag"] == "COPILOT_ACTUATE"]["quality"].tolist() == ["ACTUATED_0x04"]


def test_audit(spark):
    df = spark.createDataFrame([("INFO",), ("CRITICAL",), ("MITIGATED",), ("FAILOVER",)], "severity string")
    row = alarms.audit_summary(df).first()
    assert row["total_events"] == 4 and row["prevention_rate_pct"] == 50.0 and "`1`" in row["report"]


# --- tables ------------------------------------------------------------------------------------------------


def test_table_round_trips(spark, sf, tmp_path):
    frames = d.frames(spark, sf)
    tables.append_frames(frames, str(tmp_path / "log"))
    tables.append_frames(frames, str(tmp_path / "log"))
    assert tables.replay_frames(spark, str(tmp_path / "log")).count() == 2 * frames.count()
    tables.export_telemetry(frames, str(tmp_path / "json"))
    assert spark.read.schema(FRAMES).json(str(tmp_path / "json")).exceptAll(frames).isEmpty()
    tables.write_frames(frames, str(tmp_path / "daily"))
    day = spark.read.parquet(str(tmp_path / "daily")).where("day = '2024-01-02'")
    assert "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().executedPlan().toString()
    assert day.count() == frames.where(F.to_date(F.timestamp_millis(EPOCH_MS)) == "2024-01-02").count()


def test_rounding_is_half_up_whatever_the_noise(spark):
    df = spark.createDataFrame([(45.115,), (45.114999999999995,), (0.125,)], "x double")
    assert [r[0] for r in df.select(dp(F.col("x"), 2)).collect()] == [45.12, 45.12, 0.13]
