"""Distribution drift of telemetry channels against a stored baseline."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plantpulse.functions.numbers import dp
from plantpulse.operators.ranks import exact_quantiles, running_counts, value_counts
from plantpulse.params import DEFAULTS
from plantpulse.schemas import GAUGES
from plantpulse.session import broadcast_if_small, checkpointed

BUCKETS = 10
FLOOR = 1e-4
MIN_CURRENT = 20
KS_TERMS = 100
# Largest sample whose p-value is computed exactly.
EXACT_ROWS = 10_000

# Upper limits of the drift bands.
BANDS = [(0.10, "STABLE"), (0.25, "MODERATE SHIFT")]
TOP_BAND = "SIGNIFICANT DRIFT"


def long_form(frames, cols=tuple(GAUGES)):
    """``(feature, value)`` rows without missing values."""
    return frames.select(*cols).unpivot([], list(cols), "feature", "value").where(F.col("value").isNotNull())


def baseline_edges(baseline, buckets=BUCKETS, p=DEFAULTS):
    """Per feature: interior quantile edges, row count and rows per bucket. Store this next to the baseline, so
    that scoring never reads the baseline rows again."""
    inner = [i / buckets for i in range(1, buckets)]
    edges = checkpointed(exact_quantiles(baseline, ["feature"], "value", inner, p.max_group_rows, "edges"))
    return checkpointed(bucket_counts(baseline, edges, buckets))


def bucket_counts(values, edges, buckets=BUCKETS):
    """Rows per bucket of each feature. ``edges`` is a stored table with one row per feature, so counting it is
    cheap; it is broadcast when that count is small."""
    edges = broadcast_if_small(edges.select("feature", "edges"), edges.count())
    bucket = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    located = values.join(edges, "feature").select(
        "feature", "edges", bucket.alias("bucket")
    )
    counts = [F.count_if(F.col("bucket") == b) for b in range(buckets)]
    return located.groupBy("feature").agg(
        F.first("edges").alias("edges"), F.count(F.lit(1)).alias("n"), F.array(*counts).alias("counts")
    )


def merge_counts(counts, buckets=BUCKETS):
    """One row per feature from any number of partial bucket counts, such as those of micro-batches."""
    at = [F.sum(F.col("counts")[b]) for b in range(buckets)]
    return counts.groupBy("feature").agg(F.sum("n").alias("n"), F.array(*at).alias("counts"))


def psi(edges, current, buckets=BUCKETS):
    """Population stability index per feature that occurs on both sides, plus the current row count."""
    return psi_of_counts(edges, bucket_counts(current, edges, buckets))


def psi_of_counts(edges, counts):
    """The same from bucket counts of the current side."""
    now = counts.select("feature", F.col("n").alias("n_current"), F.col("counts").alias("now"))
    both = edges.join(now, "feature")

    def term(b, c):
        return (c - b) * F.log(c / b)

    share = lambda counts, n: F.transform(counts, lambda x: F.greatest(x / F.col(n), F.lit(FLOOR)))
    terms = F.zip_with(share("counts", "n"), share("now", "n_current"), term)
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return both.select("feature", "n_current", dp(F.greatest(F.lit(0.0), total), 4).alias("psi"))


def side_counts(values, side):
    """Distinct values per feature with their number, as column ``b`` (baseline) or ``c`` (current). Store those of a baseline
    next to it: a report then never reads its rows again."""
    counted = value_counts(values.where(F.col("value").isNotNull()), ["feature"], "value", {side: F.lit(1)})
    return counted.select("feature", "value", *[F.col(side) if k == side else F.lit(0).cast("long").alias(k) for k in "bc"])


def ranked_counts(base, current, p=DEFAULTS):
    """``(totals, ranked)``: row numbers of both sides per feature (one small stored table), and each distinct value with its
    numbers and running totals ``cum_b`` and ``cum_c``. Both sides are read once; all scores follow from this table."""
    counts = checkpointed(base.unionByName(current).groupBy("feature", "value").agg(F.sum("b").alias("b"), F.sum("c").alias("c")))
    totals = checkpointed(counts.groupBy("feature").agg(F.sum("b").alias("n"), F.sum("c").alias("m"), F.count(F.lit(1)).alias("distinct")))
    largest = totals.agg(F.max("distinct")).first()[0] or 0
    return totals, checkpointed(running_counts(counts, ["feature"], "value", ["b", "c"], largest, p.max_group_rows))


def ks_statistic(baseline, current, p=DEFAULTS):
    """Two-sample Kolmogorov-Smirnov distance and p-value per feature."""
    return ks_of_counts(*ranked_counts(side_counts(baseline, "b"), side_counts(current, "c"), p))


def ks_of_counts(totals, ranked):
    """The same from running counts. The p-value is exact when neither side has more than ``EXACT_ROWS`` rows, else that of the
    asymptotic series."""
    both = ranked.join(broadcast_if_small(totals.drop("distinct"), totals.count()), "feature")
    gap = F.abs(F.col("cum_b") * F.col("m") - F.col("cum_c") * F.col("n"))
    stats = both.groupBy("feature").agg(F.max(gap).alias("gap"), F.first("n").alias("n"), F.first("m").alias("m")).withColumn(
        "d", F.col("gap") / F.col("n") / F.col("m"))
    small = F.greatest("n", "m") <= EXACT_ROWS
    p_value = F.when(small, _exact(F.when(small, F.col("gap")), "n", "m")).otherwise(_kolmogorov("d", "n", "m"))
    return stats.where((F.col("n") > 0) & (F.col("m") > 0)).select(
        "feature", dp(F.col("d"), 4).alias("ks_statistic"), dp(p_value, 6).alias("p_value"))


def exact_p_value(gap, n, m):
    """Chance that two samples of one distribution lie at least ``gap / (n m)`` apart, where ``gap`` is the largest
    ``|i m - j n|`` over the merged samples. All orders of n and m values are equally likely lattice paths from (0, 0)
    to (n, m); the share of those that stay inside the band is followed diagonal by diagonal."""
    if gap <= 0:
        return 1.0
    inside = np.ones(1)  # of the points (i, s - i) with i from `low` on
    low = 0
    for s in range(1, n + m + 1):
        first, last = max(0, s - m), min(n, s)
        i = np.arange(first, last + 1)
        before = np.zeros(last - first + 2)  # shares at i - 1 and i on the diagonal before
        at = low - (first - 1)
        kept = inside[max(0, -at):][: len(before) - max(0, at)]
        before[max(0, at): max(0, at) + len(kept)] = kept
        inside = before[:-1] * i / s + before[1:] * (s - i) / s
        inside[np.abs(i * m - (s - i) * n) >= gap] = 0.0
        low = first
    return float(min(1.0, max(0.0, 1.0 - inside[-1])))


def _exact(gap, n, m):
    @F.pandas_udf("double")
    def run(gap: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(g) else exact_p_value(int(g), int(a), int(b)) for g, a, b in zip(gap, n, m, strict=True)], dtype="float64")

    return run(gap, F.col(n), F.col(m))


def _kolmogorov(d, n, m):
    """Survival function of the Kolmogorov distribution at ``d*sqrt(nm/(n+m))``."""
    x = F.col(d) * F.sqrt(F.col(n) * F.col(m) / (F.col(n) + F.col(m)))
    tail = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x),
    )
    # Below this point the alternating series has not converged; the other form of the same function has.
    small = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        F.lit(0.0),
        lambda acc, k: acc + F.exp(-((2 * k - 1) * (2 * k - 1)) * math.pi**2 / (8.0 * x * x)),
    )
    left = F.lit(1.0) - F.lit(math.sqrt(2.0 * math.pi)) / x * small
    return F.when(x == 0, F.lit(1.0)).when(x < 1.0, left).otherwise(F.greatest(F.lit(0.0), tail))


def drift_band(col):
    out = F.lit(TOP_BAND)
    for limit, name in reversed(BANDS):
        out = F.when(col < limit, F.lit(name)).otherwise(out)
    return out


def drift_report(baseline, current, edges=None, p=DEFAULTS):
    """Per feature with a baseline and at least 20 current values: PSI, KS, flag, band."""
    return report_of_counts(side_counts(baseline, "b"), side_counts(current, "c"), edges, p)


def report_of_counts(base, current, edges=None, p=DEFAULTS):
    """The same from the value counts of both sides; ``base`` may have been stored with the baseline."""
    totals, ranked = ranked_counts(base, current, p)
    edges = checkpointed(edges_of_counts(totals, ranked)) if edges is None else edges.select("feature", "edges")
    scored = psi_of_counts(*bucket_sums(ranked, edges)).where(F.col("n_current") >= MIN_CURRENT)
    return scored.join(ks_of_counts(totals, ranked), "feature").withColumns(
        {"drift_detected": F.col("psi") > p.psi_threshold, "drift_band": drift_band(F.col("psi"))}
    )


def edges_of_counts(totals, ranked, buckets=BUCKETS):
    """Interior quantile edges of the baseline side: linear interpolation between the two neighbouring ranks."""
    at = [(F.col("n") - 1) * F.lit(k / buckets) for k in range(1, buckets)]
    wanted = totals.where("n > 0").select("feature", F.posexplode(F.array(*at)).alias("i", "at"))
    wanted = wanted.select("feature", "i", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    hit = ranked.join(broadcast_if_small(wanted, 2 * buckets * totals.count()), "feature").where((F.col("rank") >= F.col("cum_b") - F.col("b")) & (F.col("rank") < F.col("cum_b")))
    low, high = F.min("value"), F.max("value")
    edge = (low + (high - low) * (F.max("at") - F.floor(F.max("at")))).alias("q")
    return hit.groupBy("feature", "i").agg(edge).groupBy("feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("edges"))


def bucket_sums(ranked, edges, buckets=BUCKETS):
    """``(baseline, current)`` rows per bucket from value counts, in the form of ``bucket_counts``."""
    bucket = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    located = ranked.join(broadcast_if_small(edges, edges.count()), "feature").select("feature", "edges", "b", "c", bucket.alias("bucket"))
    sides = [[F.sum(F.when(F.col("bucket") == k, F.col(side)).otherwise(0)) for k in range(buckets)] for side in "bc"]
    both = checkpointed(located.groupBy("feature").agg(
        F.first("edges").alias("edges"), F.sum("b").alias("b"), F.sum("c").alias("c"), F.array(*sides[0]).alias("bs"), F.array(*sides[1]).alias("cs")))
    side = lambda n, counts: both.where(F.col(n) > 0).select("feature", "edges", F.col(n).alias("n"), F.col(counts).alias("counts"))
    return side("b", "bs"), side("c", "cs")


def drift_summary(report, p=DEFAULTS):
    """One row: largest PSI and whether to retrain."""
    return report.agg(
        F.coalesce(F.max("psi"), F.lit(0.0)).alias("overall_max_psi"),
        F.lit(p.psi_threshold).alias("psi_threshold"),
        F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("retrain_recommended"),
    )


def set_baseline(values, path):
    """Store or replace the baselines of the features that occur in ``values``; other features stay."""
    (
        values.select("value", "feature").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("feature").parquet(path)
    )


def set_baseline_counts(values, path):
    """Store or replace, beside the rows of a baseline, its value counts: what ``report_of_counts`` needs of it."""
    (
        side_counts(values, "b").select("value", "b", "c", "feature").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("feature").parquet(path)
    )


def load_baseline_counts(spark, path):
    return spark.read.schema("value double, b long, c long, feature string").parquet(path)


def load_baseline(spark, path):
    return spark.read.schema("value double, feature string").parquet(path)


def maybe_retrain(report, retrain, p=DEFAULTS):
    """Call ``retrain()`` when a feature drifted and retraining is on; returns its result or None."""
    row = drift_summary(report, p).first()
    return retrain() if row["retrain_recommended"] and p.auto_retrain_on_drift else None
