"""One Spark query per inventory id."""

from pyspark.sql import functions as F

from contract import data as d
from plantpulse.functions import diagnosis as dg
from plantpulse.functions import frames as fr
from plantpulse.functions import latency as lt
from plantpulse.functions.numbers import dp
from plantpulse.functions.regimes import live_regime, regime_name, training_label
from plantpulse.operators import alarms, control, drift, features, folds, kpis, policy, prep, regimes
from plantpulse.schemas import (
    BUFFER, DEVICE, DROP, EPOCH_MS, GAUGES, LABEL, PROTOCOL, ROW_ID, RTT, TARGET, TEMP, THROUGHPUT,
)
from plantpulse.session import scratch_folder
from plantpulse.sources import decoders, tables

PRED = policy.PRED


def r6(df):
    """Round every double, so that the last bits do not depend on the order of additions."""
    return df.withColumns({n: dp(F.col(n), 6) for n, t in df.dtypes if t == "double"})


# --- sources -----------------------------------------------------------------------------------------------


def json_payloads(spark, sf):
    eid = F.col(ROW_ID)
    text = lambda c: F.col(c).cast("string")
    body = F.concat_ws(
        ",",
        F.when(eid % 5 != 0, F.concat(F.lit('"device_id":"'), F.col(DEVICE), F.lit('"'))),
        F.concat(F.lit('"throughput_mbps":'), text(THROUGHPUT)),
        F.when(eid % 11 != 0, F.concat(F.lit('"packet_drop_percentage":'), text(DROP))),
        F.when(eid % 7 == 0, F.concat(F.lit('"buffer_utilization_percentage":"'), text(BUFFER), F.lit('"')))
        .otherwise(F.concat(F.lit('"buffer_utilization_percentage":'), text(BUFFER))),
        F.when(eid % 19 == 0, F.lit('"node_temperature_celsius":null'))
        .otherwise(F.concat(F.lit('"node_temperature_celsius":'), text(TEMP))),
    )
    whole = F.concat(F.lit("{"), body, F.lit("}"))
    return d.telemetry(spark, sf).select(
        ROW_ID, F.when(eid % 13 == 0, F.lit('{"device_id": ')).otherwise(whole).alias("payload")
    )


def a1(spark, sf):
    return r6(decoders.decode_json(json_payloads(spark, sf)).drop("metadata"))


def a2(spark, sf):
    scaled = [F.floor(dp(F.col(g) * s, 6)).cast("int") for g, s in decoders.REGISTER_SCALE.items()]
    regs = d.telemetry(spark, sf).select(
        DEVICE, ROW_ID, F.slice(F.array(*scaled), F.lit(1), (F.col(ROW_ID) % 5).cast("int")).alias("registers")
    )
    return r6(decoders.decode_registers(regs))


def a3(spark, sf):
    eid = F.col(ROW_ID)
    pairs = F.array(
        *[
            F.when(eid % n != 0, F.struct(F.lit(decoders.NODE_IDS[g]).alias("k"), F.col(g).alias("v")))
            for g, n in zip(GAUGES, (3, 5, 7, 11))
        ]
    )
    nodes = F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull()))
    return r6(decoders.decode_nodes(d.telemetry(spark, sf).select(DEVICE, ROW_ID, nodes.alias("nodes"))))


def a4(spark, sf):
    return decoders.capture_log(d.captures(spark, sf))


def a4_totals(spark, sf):
    return decoders.capture_totals(d.captures(spark, sf))


def a5(spark, sf):
    return features.last_n(d.captures(spark, sf).drop("payload"), 20)


def a6(spark, sf):
    rows = d.telemetry(spark, sf).select(ROW_ID, decoders.encode_record(0x32, 3, 0, 0x5F).alias("payload"))
    return r6(decoders.decode_record(rows))


def a7(spark, sf):
    path = scratch_folder(spark, "frames-jsonl")
    tables.append_frames(d.frames(spark, sf), path)
    return r6(tables.replay_frames(spark, path))


def a8(spark, sf):
    return r6(tables.recent(d.frames(spark, sf), 50))


def a10(spark, sf):
    path = scratch_folder(spark, "frames-csv")
    rows = d.frames(spark, sf)
    tables.write_csv(rows, path)
    return r6(tables.read_csv(spark, path, rows.schema))


def a11(spark, sf):
    path = scratch_folder(spark, "soe-csv")
    log = alarms.sequence_of_events(d.replayed(spark, sf), largest=d.largest(spark, sf))
    tables.export_log(log, path)
    return tables.read_csv(spark, path, log.schema)


# --- validation --------------------------------------------------------------------------------------------


def b1(spark, sf):
    checked = prep.check(d.faulty(spark, sf))
    return checked.select(ROW_ID, F.size("errors").alias("n_errors"), F.array_join("errors", ";").alias("errors"))


def b2(spark, sf):
    return d.faulty(spark, sf).select(ROW_ID, fr.normal_device().alias("device"))


def b3(spark, sf):
    valid = prep.valid_frames(d.faulty(spark, sf))
    probes = kpis.probe_summary(d.probes(spark, sf)).select(
        F.upper(F.col("target")).alias(DEVICE), F.when(F.col("valid_samples") % 2 == 0, F.col("median_rtt_ms")).alias("probe_rtt")
    )
    return r6(prep.canonical(valid, probes))


def b4(spark, sf):
    return d.telemetry(spark, sf).select(ROW_ID, fr.synthetic_rtt().alias("rtt"))


def b5(spark, sf):
    eid = F.col(ROW_ID)
    rows = d.faulty(spark, sf).select(
        ROW_ID, *GAUGES,
        F.when(eid % 3 == 0, F.col(RTT)).alias("lag_latency_1"), F.when(eid % 4 == 0, F.col(RTT)).alias("lag_latency_2"),
        F.when(eid % 5 == 0, F.lit(0.5)).alias("throughput_slope"), F.when(eid % 6 == 0, F.lit(99.0)).alias("buffer_peak"),
    )
    return r6(features.complete_request(rows.where(fr.request_ok())))


def b6(spark, sf):
    return r6(features.prediction_request(features.serving_features(d.frames(spark, sf), largest=d.largest(spark, sf)), 1))


# --- preparation -------------------------------------------------------------------------------------------


def c1(spark, sf):
    return r6(prep.forward_fill(d.telemetry(spark, sf).select(DEVICE, ROW_ID, EPOCH_MS, *GAUGES), largest=d.largest(spark, sf)))


def c1_global(spark, sf):
    return r6(prep.forward_fill(d.telemetry(spark, sf).select(ROW_ID, EPOCH_MS, *GAUGES), keys=()))


def c2(spark, sf):
    scaled, _ = prep.min_max_scale(d.telemetry(spark, sf).select(ROW_ID, *GAUGES))
    return r6(scaled)


def c3(spark, sf):
    rows = d.telemetry(spark, sf).select(ROW_ID, *GAUGES)
    scaled, scaler = prep.min_max_scale(rows)
    return r6(prep.invert_scaler(scaled, scaler))


# --- features ----------------------------------------------------------------------------------------------


def _features(spark, sf, profile, *cols):
    return r6(features.PROFILES[profile](d.frames(spark, sf), largest=d.largest(spark, sf)).select(ROW_ID, *cols))


def d1(spark, sf):
    return _features(spark, sf, "serving", "throughput_mean", "packet_drop_mean", "buffer_peak", "samples_in_window")


def d2(spark, sf):
    return _features(spark, sf, "serving", "throughput_slope")


def d3(spark, sf):
    return _features(spark, sf, "serving", "lag_latency_1", "lag_latency_2")


def d4(spark, sf):
    return r6(features.latest_features(d.frames(spark, sf)).drop("correlation_id"))


def labeled(spark, sf):
    return d.frames(spark, sf).withColumn(LABEL, training_label()).withColumn(TARGET, lt.training_target())


def training(spark, sf):
    return features.training_features(labeled(spark, sf), largest=d.largest(spark, sf))


def d5(spark, sf):
    return r6(training(spark, sf).select(ROW_ID, "lag_latency_1", "lag_latency_2"))


def d6(spark, sf):
    return r6(training(spark, sf).select(ROW_ID, "throughput_slope"))


def d7(spark, sf):
    return r6(training(spark, sf).select(ROW_ID, "buffer_peak"))


def d8(spark, sf):
    return _features(spark, sf, "console", "lag_latency_1", "lag_latency_2", "throughput_slope", "buffer_peak")


def d9(spark, sf):
    return r6(features.window_summary(d.frames(spark, sf)))


# --- regimes -----------------------------------------------------------------------------------------------


def e1(spark, sf):
    return d.telemetry(spark, sf).select(
        ROW_ID, live_regime().alias(LABEL), regime_name(live_regime()).alias("cluster_regime")
    )


def e2(spark, sf):
    return d.telemetry(spark, sf).select(ROW_ID, training_label().alias(LABEL))


def e6(spark, sf):
    return r6(regimes.update_centroids(regimes.seed_centroids(spark), d.frames(spark, sf)))


# --- forecast ----------------------------------------------------------------------------------------------


def f1(spark, sf):
    rows = d.telemetry(spark, sf).withColumn(LABEL, training_label())
    return r6(rows.select(ROW_ID, lt.training_target().alias(TARGET), lt.scaled_target().alias("scaled_target")))


def f3(spark, sf):
    parts = []
    for fold, train, test in folds.time_series_folds(d.frames(spark, sf)):
        row = lambda df, name: df.agg(
            F.count(F.lit(1)).alias(f"{name}_rows"), F.min(EPOCH_MS).alias(f"{name}_from"), F.max(EPOCH_MS).alias(f"{name}_to"),
            F.sum(ROW_ID).alias(f"{name}_ids"),
        ).withColumn("fold", F.lit(fold))
        parts.append(row(train, "train").join(row(test, "test"), "fold"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def f5(spark, sf):
    from plantpulse.operators import forecast

    return r6(forecast.regression_metrics(d.scored(spark, sf), RTT, PRED))


def f8(spark, sf):
    at = lambda k: F.try_element_at("a", F.lit(k))
    return r6(
        d.scored(spark, sf).withColumn("a", lt.analytic_attributions()).select(
            ROW_ID, PRED, at(DROP).alias("drop_ms"), at(LABEL).alias("regime_ms"), at(TEMP).alias("temp_ms"),
            at("_bias_baseline").alias("bias_ms"), (F.col(PRED) >= 60.0).alias("sla_violation_expected"),
        )
    )


def f9(spark, sf):
    ranked = lt.ranked_attributions(lt.analytic_attributions())
    return r6(d.scored(spark, sf).select(ROW_ID, F.explode(ranked).alias("r")).select(ROW_ID, "r.*"))


def f10(spark, sf):
    rows = policy.analytic_score(features.console_features(d.frames(spark, sf), largest=d.largest(spark, sf)))
    return r6(
        rows.select(ROW_ID, F.explode(lt.horizons(PRED, "throughput_slope", DROP, 60.0)).alias("h")).select(ROW_ID, "h.*")
    )


# --- drift -------------------------------------------------------------------------------------------------


def _sides(spark, sf):
    base, cur = d.drift_sides(spark, sf)
    return drift.long_form(base), drift.long_form(cur)


def g1(spark, sf):
    base, cur = _sides(spark, sf)
    return drift.psi(drift.baseline_edges(base), cur)


def g2(spark, sf):
    base, cur = _sides(spark, sf)
    return drift.ks_statistic(base, cur).drop("p_value")


def g3(spark, sf):
    return drift.drift_report(*_sides(spark, sf)).drop("p_value", "drift_band")


def g3_summary(spark, sf):
    return drift.drift_summary(drift.drift_report(*_sides(spark, sf)))


def g4(spark, sf):
    base, cur = _sides(spark, sf)
    return drift.psi(drift.baseline_edges(base), cur).select("feature", drift.drift_band(F.col("psi")).alias("drift_band"))


def g5(spark, sf):
    """Baselines of all channels are stored, then one is replaced; the stored rows are counted."""
    path = scratch_folder(spark, "baseline")
    base, cur = _sides(spark, sf)
    drift.set_baseline(base, path)
    drift.set_baseline(cur.where(F.col("feature") == TEMP), path)
    stored = drift.load_baseline(spark, path)
    return r6(stored.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


# --- decisions ---------------------------------------------------------------------------------------------


def h1(spark, sf):
    return d.scored(spark, sf).select(ROW_ID, dg.risk_level(PRED).alias("risk_level"), dg.urgency(PRED).alias("urgency"))


def h2(spark, sf):
    found = d.scored(spark, sf).withColumn("a", lt.analytic_attributions())
    return found.select(ROW_ID, F.posexplode(dg.findings("a")).alias("position", "f")).select(ROW_ID, "position", "f.*")


def h3(spark, sf):
    return r6(
        d.scored(spark, sf).select(ROW_ID, dg.action().alias("mitigation_action"), dg.action_params().alias("p"))
        .select(ROW_ID, "mitigation_action", "p.*")
    )


def h4(spark, sf):
    rows = d.scored(spark, sf).withColumn("attributions", lt.analytic_attributions())
    out = policy.diagnose(rows, "attributions")
    return r6(
        out.select(
            ROW_ID, "primary_vector", "diagnosis_summary", "recommendation_text", "expected_reduction_ms", "confidence_score"
        )
    )


def h5(spark, sf):
    return r6(d.scored(spark, sf).select(ROW_ID, lt.risk_index(PRED, 60.0).alias("risk_index")))


def h6(spark, sf):
    return r6(
        d.replayed(spark, sf).select(
            ROW_ID, "core_throttled", "temp_after", "failover_active", "active_drop", "pred_before", "mitigation_active",
            "throughput_after", "drop_after", "buffer_after", PRED, "throttle_delay_ms",
        )
    )


def h7(spark, sf):
    return policy.mitigation_counts(d.replayed(spark, sf))


def h8(spark, sf):
    return r6(
        d.decided(spark, sf).select(
            ROW_ID, (F.col("status") == "rate_limited").alias("rate_limited"), "retry_after_sec"
        )
    )


def h9(spark, sf):
    return d.decided(spark, sf).select(ROW_ID, "status")


def h10(spark, sf):
    return r6(control.resolve(d.commands(spark, sf)).select(ROW_ID, "action", "supported", "rate_mbps"))


def h11(spark, sf):
    rows = d.compressed(d.frames(spark, sf))
    return control.route_of_frames(rows, d.decided(spark, sf), largest=2 * d.largest(spark, sf)).select(ROW_ID, "active_route")


def h11_current(spark, sf):
    return control.current_route(d.decided(spark, sf))


def h12(spark, sf):
    return r6(control.active_limits(d.decided(spark, sf)))


def h13(spark, sf):
    return control.heartbeat_gaps(d.compressed(d.frames(spark, sf), d.HEARTBEAT_SPEED_UP), largest=d.largest(spark, sf))


def h13_now(spark, sf):
    return control.tripped_at(d.frames(spark, sf), 1_706_572_800_000)


def h14(spark, sf):
    return r6(policy.sustained_breaches(d.scored(spark, sf), largest=d.largest(spark, sf)))


def h15(spark, sf):
    rows = d.commands(spark, sf).select(ROW_ID, F.coalesce("shedding_factor", F.lit(0.82)).alias("factor"))
    return r6(rows.select(ROW_ID, *control.token_bucket("factor")))


# --- alarms ------------------------------------------------------------------------------------------------


def i1(spark, sf):
    flags = ["is_latency_alarm", "is_drop_alarm", "is_temp_alarm", "is_buffer_alarm"]
    rows = d.replayed(spark, sf)
    stages = [alarms.alarm_flags(rows, s).select(ROW_ID, F.lit(s).alias("stage"), *flags) for s in ("raw", "post")]
    return stages[0].unionByName(stages[1])


def i2(spark, sf):
    return alarms.annunciator(alarms.alarm_flags(d.replayed(spark, sf))).drop(EPOCH_MS)


def soe(spark, sf):
    return alarms.sequence_of_events(d.replayed(spark, sf), largest=d.largest(spark, sf))


def i4(spark, sf):
    shown = alarms.display_class(soe(spark, sf))
    return shown.groupBy("display_class").agg(F.count(F.lit(1)).alias("n"))


def i5(spark, sf):
    return alarms.newest(soe(spark, sf), 6)


def i6(spark, sf):
    return alarms.audit_summary(alarms.severity(soe(spark, sf)))


# --- KPIs --------------------------------------------------------------------------------------------------


def j1(spark, sf):
    return kpis.frames_total(d.frames(spark, sf))


def j2(spark, sf):
    return kpis.errors_total(prep.quarantine(d.faulty(spark, sf)))


def j2_decode(spark, sf):
    decoded = decoders.decode_json(json_payloads(spark, sf)).withColumn(RTT, F.lit(None).cast("double"))
    return kpis.errors_total(prep.quarantine(decoded))


def j3(spark, sf):
    return r6(kpis.latest_gauge(d.frames(spark, sf), DEVICE, RTT))


def j4(spark, sf):
    times = d.telemetry(spark, sf).select((F.col(DROP) * 1.25 + F.col(BUFFER) / 100.0).alias("ms"))
    return r6(kpis.duration_histogram(times, "ms"))


def j5(spark, sf):
    return kpis.mitigations_total(d.decided(spark, sf))


def j6(spark, sf):
    return kpis.failovers_total(d.decided(spark, sf))


def j7(spark, sf):
    return r6(control.active_limits(d.decided(spark, sf)).agg(F.min("rate_mbps").alias("enforced_mbps"), F.count(F.lit(1)).alias("interfaces")))


def j8(spark, sf):
    return r6(kpis.run_totals(d.scored(spark, sf), PRED))


def j8_running(spark, sf):
    return r6(kpis.running_totals(d.scored(spark, sf), PRED, largest=d.largest(spark, sf)).drop(EPOCH_MS))


def j9(spark, sf):
    return r6(kpis.sparkline(d.frames(spark, sf), RTT))


def j9_history(spark, sf):
    return r6(features.last_n(d.frames(spark, sf), 30).drop("correlation_id"))


def j10(spark, sf):
    return r6(kpis.live_error(d.scored(spark, sf), RTT, PRED))


def k1(spark, sf):
    return r6(kpis.probe_summary(d.probes(spark, sf)))


def k2(spark, sf):
    rows = d.telemetry(spark, sf).select(
        ROW_ID, F.floor(dp(F.col("k") * 27031.7, 6)).alias("ns"), (F.col(PROTOCOL) != "s7").alias("ok")
    )
    return r6(rows.select(ROW_ID, "ok", fr.probe_ms("ns", "ok").alias("rtt_ms")))


# --- end to end --------------------------------------------------------------------------------------------


def flagship(spark, sf):
    from plantpulse.plans import online

    return r6(online.device_risk(d.telemetry(spark, sf).select(*d.RAW), largest=d.largest(spark, sf)))


SQL_CHECKED = {
    "A1_decode_json": a1, "A2_decode_registers": a2, "A3_decode_nodes": a3, "A4_capture_log": a4,
    "A4_capture_totals": a4_totals, "A5_last_captures": a5, "A6_decode_record": a6, "A7_jsonl_replay": a7,
    "A8_recent_frames": a8, "A10_csv_handoff": a10, "A11_export_log": a11,
    "B1_quality_gate": b1, "B2_device_id": b2, "B3_canonical": b3, "B4_synthetic_rtt": b4,
    "B5_request_contract": b5, "B6_prediction_request": b6,
    "C1_forward_fill": c1, "C1_forward_fill_one_series": c1_global, "C2_min_max_scale": c2, "C3_invert_scaler": c3,
    "D1_rolling": d1, "D2_slope": d2, "D3_lags": d3, "D4_latest": d4, "D5_training_lags": d5,
    "D6_training_slope": d6, "D7_training_peak": d7, "D8_console": d8, "D9_window_summary": d9,
    "E1_live_regime": e1, "E2_training_label": e2, "E6_centroid_update": e6,
    "F1_targets": f1, "F3_time_folds": f3, "F5_metrics": f5, "F8_analytic": f8, "F9_ranked_attributions": f9,
    "F10_horizons": f10,
    "G1_psi": g1, "G2_ks": g2, "G3_drift_report": g3, "G3_drift_summary": g3_summary, "G4_drift_band": g4,
    "G5_set_baseline": g5,
    "H1_risk_level": h1, "H2_findings": h2, "H3_action": h3, "H4_narrative": h4, "H5_risk_index": h5,
    "H6_policy_replay": h6, "H7_mitigation_counts": h7, "H8_debounce": h8, "H9_approval": h9,
    "H10_resolution": h10, "H11_route_of_frames": h11, "H11_current_route": h11_current, "H12_active_limits": h12,
    "H13_heartbeat_gaps": h13, "H13_tripped": h13_now, "H14_sustained_breach": h14, "H15_token_bucket": h15,
    "I1_alarm_flags": i1, "I2_annunciator": i2, "I3_sequence_of_events": soe, "I4_display_class": i4,
    "I5_newest_events": i5, "I6_audit": i6,
    "J1_frames_total": j1, "J2_errors_total": j2, "J2_decode_errors": j2_decode, "J3_latest_gauge": j3,
    "J4_histogram": j4, "J5_mitigations_total": j5, "J6_failovers_total": j6, "J7_enforced_limit": j7,
    "J8_run_totals": j8, "J8_running_totals": j8_running, "J9_sparkline": j9, "J9_history": j9_history,
    "J10_live_error": j10, "K1_probe_summary": k1, "K2_probe_ms": k2,
    "P1_device_risk": flagship,
}
