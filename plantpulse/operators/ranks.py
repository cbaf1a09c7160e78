"""Exact running counts and quantiles of a numeric column per key, without a whole key in one task."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plantpulse.operators.series import MAX_SLICES
from plantpulse.params import DEFAULTS
from plantpulse.session import broadcast_if_small, checkpointed


def value_counts(df, keys, value, weights):
    """Distinct values per key with summed weights; repeated values shrink before the shuffle."""
    return df.groupBy(*keys, value).agg(*[F.sum(w).alias(n) for n, w in weights.items()])


def running_counts(counts, keys, value, names, largest, max_rows=None):
    """Cumulative weights (``cum_<name>``) by ascending value within a key.

    ``largest`` bounds the number of distinct values of a key (its row count will do). Small keys use one
    window. Otherwise the distinct values are range-partitioned over the cluster, partition
    totals (one row per partition and key) are prefix-summed, and each partition adds its offset."""
    max_rows = max_rows or DEFAULTS.max_group_rows
    keys = list(keys)
    if largest <= max_rows:
        up_to = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumns({f"cum_{n}": F.sum(n).over(up_to) for n in names})
    total = counts.count()
    parts = max(2, min(MAX_SLICES, -(-2 * total // max_rows)))
    # The partition number is stored with the rows, so it cannot change when a task is run again.
    sliced = checkpointed(
        counts.repartitionByRange(parts, *keys, value).withColumn("_slice", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(*[F.sum(n).alias(f"_s_{n}") for n in names])
        .select(*keys, "_slice", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names])
    )
    up_to = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumns({f"cum_{n}": F.sum(n).over(up_to) for n in names})
    joined = local.join(offsets, keys + ["_slice"])
    return joined.withColumns({f"cum_{n}": F.col(f"cum_{n}") + F.col(f"_o_{n}") for n in names}).drop(
        "_slice", *[f"_o_{n}" for n in names]
    )


def exact_quantiles(df, keys, value, probs, max_rows=None, out="quantiles"):
    """``array<double>`` of linearly interpolated quantiles per key; missing values are ignored.

    The built-in exact ``percentile`` holds all distinct values of a key in one task, so it only serves keys
    of ordinary size; for larger ones the two neighbouring ranks are looked up in the running counts."""
    max_rows = max_rows or DEFAULTS.max_group_rows
    keys = list(keys)
    present = df.where(F.col(value).isNotNull()).select(*keys, value)
    builtin = F.percentile(value, F.array(*[F.lit(float(q)) for q in probs])).alias(out)
    large = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_rows)
    n_large, largest = large.agg(F.count(F.lit(1)), F.max("n")).first()
    if not n_large:
        return present.groupBy(*keys).agg(builtin)
    large = checkpointed(large)
    names = broadcast_if_small(large.select(*keys), n_large)
    small_keys = present.join(names, keys, "left_anti").groupBy(*keys).agg(builtin)
    counts = value_counts(present.join(names, keys, "left_semi"), keys, value, {"w": F.lit(1)})
    ranked = running_counts(counts, keys, value, ["w"], largest, max_rows)
    wanted = large.select(
        *keys,
        F.posexplode(F.array(*[(F.col("n") - 1) * F.lit(float(q)) for q in probs])).alias("i", "at"),
    ).select(*keys, "i", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    hit = ranked.join(broadcast_if_small(wanted, 2 * len(probs) * n_large), keys).where(
        (F.col("rank") >= F.col("cum_w") - F.col("w")) & (F.col("rank") < F.col("cum_w"))
    )
    low, high = F.min(value), F.max(value)
    per_q = hit.groupBy(*keys, "i").agg((low + (high - low) * (F.max("at") - F.floor(F.max("at")))).alias("q"))
    large_keys = per_q.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias(out)
    )
    return small_keys.unionByName(large_keys)
