"""Steps that many passes read are computed once."""

from plantpulse.operators import clustering, forecast
from plantpulse.schemas import LABEL


def test_folds_read_rows_that_were_computed_once(spark, sf):
    """The features of all frames are computed once for all folds, not again for each fit and each score."""
    from pyspark.sql import functions as F

    from contract.model_side import training
    computed = spark.sparkContext.accumulator(0)
    rows = training(spark, sf)

    def counting(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    scores = forecast.cross_validate(rows.mapInArrow(counting, rows.schema), trees=1)
    assert scores.agg(F.count("rmse")).first()[0] == 5
    assert computed.value == rows.count()


def test_profile_reads_rows_that_were_computed_once(spark):
    """Density labels and all starts of k-means share one computation of the rows."""
    computed = spark.sparkContext.accumulator(0)
    rows = spark.range(200).selectExpr("id as event_id", "id / 2000D as a", "id % 7 / 70D as b")

    def counting(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    out = clustering.profile(rows.mapInArrow(counting, rows.schema), "event_id", ["a", "b"])
    assert out.select(LABEL).distinct().count() > 1 and out.columns[:3] == rows.columns
    assert computed.value == 200
