"""Boosted-tree latency forecast: training, folds, hold-out, scoring, persistence, retraining."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import functions as F

from plantpulse.functions.latency import scaled_target, training_target
from plantpulse.functions.numbers import dp
from plantpulse.functions.regimes import live_regime, training_label
from plantpulse.operators import attribution
from plantpulse.operators.drift import maybe_retrain
from plantpulse.operators.features import training_features
from plantpulse.operators.folds import hash_split, time_series_folds
from plantpulse.operators.policy import PRED
from plantpulse.params import DEFAULTS
from plantpulse.schemas import BUFFER, DROP, GAUGES, LABEL, MODEL_FEATURES, TARGET, TEMP
from plantpulse.session import checkpointed, ensure_checkpoint_dir

# Size of the ensemble.
TREES, DEPTH, RATE, SEED = 80, 4, 0.07, 42


def training_set(frames, measured=None, p=DEFAULTS, largest=None):
    """Frames with label, target and training-profile features. ``measured`` names a measured latency column to
    learn from; without one the target is the deterministic load formula."""
    target = F.col(measured) if measured else training_target()
    labeled = frames.withColumn(LABEL, training_label()).withColumn(TARGET, target)
    return training_features(labeled.where(F.col(TARGET).isNotNull()), p, largest=largest)


def scaled_training_set(labeled, p=DEFAULTS, largest=None):
    """Batch variant on scaled gauges whose label column comes from clustering."""
    return training_features(labeled.withColumn(TARGET, scaled_target()), p, largest=largest)


def _assemble(df, cols, out):
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def fit(train, trees=TREES, depth=DEPTH, rate=RATE, seed=SEED):
    """Fit on a table with the model features and the target. Every level of every tree is a pass over all rows, so they are
    dealt out evenly over the cores, once; the passes before the first tree read what was dealt and compute nothing again."""
    ensure_checkpoint_dir(train.sparkSession)
    dealt = train.select(*MODEL_FEATURES, TARGET).repartition(train.sparkSession.sparkContext.defaultParallelism)
    data = _assemble(dealt, MODEL_FEATURES, "features").select("features", TARGET)
    return GBTRegressor(
        featuresCol="features", labelCol=TARGET, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed,
        checkpointInterval=10,
    ).fit(data)


def predict(model, df, inputs=MODEL_FEATURES, out="prediction"):
    """Raw prediction column."""
    vector = f"_{out}_vector"
    ready = model.copy({model.featuresCol: vector, model.predictionCol: out})
    return ready.transform(_assemble(df, list(inputs), vector)).drop(vector)


def regression_metrics(df, actual=TARGET, predicted="prediction"):
    """One row: rmse, mae, r2 in a single pass."""
    e = F.col(actual) - F.col(predicted)
    n = F.count(F.lit(1))
    return df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.sum(e * e) / F.nullif((n - 1) * F.var_samp(actual), F.lit(0.0))).alias("r2"),
    )


def cross_validate(df, splits=5, trees=TREES, p=DEFAULTS):
    """Scores per expanding fold: ``(fold, rmse, mae, r2)``. The rows are written once, as every fold reads them."""
    df, scores = checkpointed(df), None
    for fold, train, test in time_series_folds(df, splits, p=p):
        row = regression_metrics(predict(fit(train, trees), test)).withColumn("fold", F.lit(fold))
        scores = row if scores is None else scores.unionByName(row)
    return scores


def mean_scores(scores):
    return scores.agg(*[F.avg(m).alias(f"mean_{m}") for m in ("rmse", "mae", "r2")])


def hold_out_score(df, trees=TREES):
    """Scores on a random fifth of the rows after training on the rest."""
    train, test = hash_split(checkpointed(df))
    return regression_metrics(predict(fit(train, trees), test))


def model_scorer(model, predict=predict):
    """Scorer with the interface of ``policy.analytic_score``: regime, model, floor of 5 ms, two decimals. Its attributions
    are those of the model."""

    def score(df, names=None, out=PRED):
        names = names or {}
        at = lambda c: names.get(c, c)
        label = f"{out}_label"
        df = df.withColumn(label, live_regime(at(DROP), at(BUFFER), at(TEMP), [at(g) for g in GAUGES]))
        inputs = [label if c == LABEL else at(c) for c in MODEL_FEATURES]
        scored = predict(model, df, inputs, f"_{out}_raw")
        return scored.withColumn(out, F.greatest(F.lit(5.0), dp(F.col(f"_{out}_raw"), 2))).drop(f"_{out}_raw")

    score.attributions = lambda df: attribution.attributions(df, model)
    return score


def score_batch(model, features, p=DEFAULTS):
    """Serving features to forecast and breach flag."""
    return model_scorer(model)(features).withColumn("sla_violation_expected", F.col(PRED) >= p.sla_latency_ms)


def save(model, path):
    model.write().overwrite().save(path)


def load_or_train(path, train):
    """Stored model, or a new one from ``train()`` that is then stored."""
    try:
        return GBTRegressionModel.load(path)
    except Exception as missing:
        if "does not exist" not in str(missing) and "PATH_NOT_FOUND" not in str(missing):
            raise
        model = train()
        save(model, path)
        return model


def retrain_on_drift(report, frames, path, trees=TREES, p=DEFAULTS, largest=None):
    """Train, store and reload when the drift report asks for it; returns the new model or None."""

    def run():
        save(fit(training_set(frames, p=p, largest=largest), trees), path)
        return GBTRegressionModel.load(path)

    return maybe_retrain(report, run, p)
