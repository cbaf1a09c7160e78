"""Queries around fitted models. SQL states what must hold for each row; tests check values against brute force."""

from dataclasses import replace

from pyspark.sql import functions as F

from contract import data as d
from contract.spark_side import r6
from plantpulse.functions.latency import ranked_attributions
from plantpulse.functions.regimes import live_regime
from plantpulse.operators import attribution, clustering, drift, features, folds, forecast, policy, prep
from plantpulse.params import DEFAULTS
from plantpulse.schemas import GAUGES, LABEL, ROW_ID
from plantpulse.session import checkpointed, scratch_folder

_MODELS, _FITTED = {}, {}


def training(spark, sf):
    return forecast.training_set(d.frames(spark, sf), largest=d.largest(spark, sf))


def stored_model(spark, sf):
    """One model per data set and session, kept as files. ``_FITTED`` holds the object it was saved from."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = scratch_folder(spark, "model")

    def train():
        _FITTED[key] = forecast.fit(training(spark, sf))
        return _FITTED[key]

    forecast.load_or_train(_MODELS[key], train)
    return forecast.load_or_train(_MODELS[key], train)


def serving(spark, sf):
    return features.serving_features(d.frames(spark, sf), largest=d.largest(spark, sf))


def a12(spark, sf):
    """The model read back from its files predicts what the fitted one predicts, row by row."""
    model = stored_model(spark, sf)
    fitted = _FITTED[spark.sparkContext.applicationId, sf]
    both = forecast.predict(fitted, forecast.predict(model, training(spark, sf)), out="before")
    return both.select(ROW_ID, (F.abs(F.col("prediction") - F.col("before")) < 1e-9).alias("same"))


def f2(spark, sf):
    """A training run of full size on four fifths of the rows, and the published bound on the share of explained variance
    on the rest."""
    train, test = folds.hash_split(checkpointed(training(spark, sf)))
    model = forecast.fit(train)
    explained = forecast.regression_metrics(forecast.predict(model, test)).first().r2
    rows = forecast.predict(model, train).unionByName(forecast.predict(model, test))
    return rows.agg(F.count("prediction").alias("rows"), F.lit(explained > 0.9).alias("r2_above_090"))


def f3(spark, sf):
    return r6(forecast.cross_validate(training(spark, sf)))


def f4(spark, sf):
    train, test = folds.hash_split(d.frames(spark, sf).select(ROW_ID))
    return (train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test"))))


def f6(spark, sf):
    """Floor, rounding and flag of the served forecast, checked against the raw prediction of every row."""
    model = stored_model(spark, sf)
    out = forecast.score_batch(model, serving(spark, sf))
    raw = forecast.predict(model, out.withColumn(LABEL, F.col(f"{policy.PRED}_label")), out="raw")
    near = F.abs(F.col(policy.PRED) - F.greatest(F.lit(5.0), F.col("raw"))) <= 0.005 + 1e-9
    flag = F.col("sla_violation_expected") == (F.col(policy.PRED) >= DEFAULTS.sla_latency_ms)
    return raw.select(ROW_ID, near.alias("rounded"), flag.alias("flagged"), (F.col(policy.PRED) >= 5.0).alias("floored"))


def f7(spark, sf):
    """Contributions of a row and the bias add up to its prediction; one row per row and feature."""
    model = stored_model(spark, sf)
    rows = serving(spark, sf).transform(policy.with_regime)
    out = attribution.attributions(forecast.predict(model, rows), model)
    total = F.abs(F.col("attribution_total") - F.col("prediction")) < 1e-6
    return out.select(ROW_ID, total.alias("adds_up"), F.explode("attributions").alias("feature", "ms")).select(
        ROW_ID, "feature", "adds_up", F.col("ms").isNotNull().alias("present"))


def f9(spark, sf):
    model = stored_model(spark, sf)
    out = attribution.attributions(serving(spark, sf).transform(policy.with_regime), model)
    return r6(out.select(ROW_ID, F.explode(ranked_attributions(F.col("attributions"))).alias("r")).select(ROW_ID, "r.*"))


def f11(spark, sf):
    """Drift between the halves of the period triggers a retraining; its scores on all frames."""
    p = replace(DEFAULTS, psi_threshold=0.05)
    base, cur = d.drift_sides(spark, sf)
    report = drift.drift_report(drift.long_form(base), drift.long_form(cur), p=p)
    path = scratch_folder(spark, "retrained")
    model = forecast.retrain_on_drift(report, d.frames(spark, sf), path, p=p, largest=d.largest(spark, sf))
    if model is None:
        return spark.createDataFrame([], "rmse double, mae double, r2 double")
    return r6(forecast.regression_metrics(forecast.predict(model, training(spark, sf))))


def h6(spark, sf):
    out = policy.replay(d.frames(spark, sf), forecast.model_scorer(stored_model(spark, sf)), largest=d.largest(spark, sf))
    return r6(out.select(ROW_ID, "pred_before", "mitigation_active", policy.PRED))


def scaled(spark, sf):
    filled = prep.forward_fill(d.telemetry(spark, sf).select(*d.RAW), largest=d.largest(spark, sf))
    return prep.min_max_scale(filled.dropna(subset=GAUGES).select(ROW_ID, *GAUGES))[0]


def e3(spark, sf):
    return clustering.dbscan(scaled(spark, sf), ROW_ID, GAUGES, DEFAULTS.dbscan_eps, DEFAULTS.dbscan_min_samples, LABEL).select(ROW_ID, LABEL)


def e4(spark, sf):
    return clustering.profile(scaled(spark, sf), ROW_ID, GAUGES).select(ROW_ID, LABEL)


def e5(spark, sf):
    """Silhouette of the live regimes of all canonical frames."""
    labeled = d.frames(spark, sf).withColumn(LABEL, live_regime())
    value = clustering.silhouette_squared(labeled, GAUGES)
    return labeled.agg(F.count(F.lit(1)).alias("rows"), F.round(F.lit(value).cast("double"), 5).alias("silhouette_squared"))


QUERIES = {
    "A12_model_store": a12, "E3_dbscan": e3, "E4_profile": e4, "E5_silhouette_squared": e5, "F2_boosted_trees": f2,
    "F3_fold_scores": f3, "F4_hash_split": f4, "F6_model_scoring": f6, "F7_attribution": f7, "F9_model_attribution_rank": f9,
    "F11_retrain_on_drift": f11, "H6_policy_replay_model": h6,
}
