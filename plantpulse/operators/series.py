"""Ordered per-key work (lags, rolling frames, carry-forward) that survives one very large key.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. That is right as long as every key is of
ordinary size, which :func:`open_series` checks with one cheap count. Keys above ``max_rows`` are cut into
consecutive time blocks, each block receiving copies of the ``lookback`` rows before it, so that a frame of
that many preceding rows gives the same result as on the uncut key. Values that may come from arbitrarily far
back (last known value) travel through a table with one row per block, see :meth:`Series.carry`.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plantpulse.params import DEFAULTS
from plantpulse.session import broadcast_if_small, checkpointed

BLOCK = "_block"
OWN = "_own"
# Bound of the slices that large keys are range partitioned into; window sorts within a slice spill.
MAX_SLICES = 20_000


class Series:
    """Rows of a keyed, time-ordered table, ready for window functions over ``window``."""

    def __init__(self, df, keys, order, split):
        self.df, self.keys, self.order, self.split = df, list(keys), list(order), split
        parts = self.keys + [BLOCK] if split else self.keys
        self.window = Window.partitionBy(*parts).orderBy(*order)
        self.group_keys = parts

    def close(self, df):
        """Drop the copied rows and the helper columns."""
        return df.where(OWN).drop(BLOCK, OWN) if self.split else df

    def carry(self, values, include_current=True):
        """Last non-null value of each expression in ``values`` up to the row (or strictly before it)."""
        end = Window.currentRow if include_current else -1
        here = self.window.rowsBetween(Window.unboundedPreceding, end)
        if not self.split:
            return self.df.withColumns({n: F.last(v, ignorenulls=True).over(here) for n, v in values.items()})
        prepared = self.df.withColumns({f"_v_{n}": v for n, v in values.items()})
        stamp = F.struct(*self.order)
        per_block = prepared.where(OWN).groupBy(*self.keys, BLOCK).agg(
            *[
                F.max_by(F.when(F.col(f"_v_{n}").isNotNull(), F.col(f"_v_{n}")),
                         F.when(F.col(f"_v_{n}").isNotNull(), stamp)).alias(f"_c_{n}")
                for n in values
            ]
        )
        before = Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        carried = per_block.select(
            *self.keys, BLOCK,
            *[F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values],
        )
        joined = prepared.join(carried, self.keys + [BLOCK], "left")
        own_value = {
            n: F.coalesce(
                F.last(F.when(F.col(OWN), F.col(f"_v_{n}")), ignorenulls=True).over(here), F.col(f"_c_{n}")
            )
            for n in values
        }
        return joined.withColumns(own_value).drop(*[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])

    def running(self, sums=None, maxima=None):
        """Running totals and maxima from the first row of the key up to the row."""
        sums, maxima = sums or {}, maxima or {}
        here = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if not self.split:
            return self.df.withColumns(
                {n: F.sum(v).over(here) for n, v in sums.items()}
                | {n: F.max(v).over(here) for n, v in maxima.items()}
            )
        prepared = self.df.withColumns({f"_v_{n}": F.when(F.col(OWN), v) for n, v in (sums | maxima).items()})
        per_block = prepared.groupBy(*self.keys, BLOCK).agg(
            *[F.sum(f"_v_{n}").alias(f"_c_{n}") for n in sums],
            *[F.max(f"_v_{n}").alias(f"_c_{n}") for n in maxima],
        )
        before = Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        carried = per_block.select(
            *self.keys, BLOCK,
            *[F.sum(f"_c_{n}").over(before).alias(f"_c_{n}") for n in sums],
            *[F.max(f"_c_{n}").over(before).alias(f"_c_{n}") for n in maxima],
        )
        joined = prepared.join(carried, self.keys + [BLOCK], "left")
        out = {n: F.coalesce(F.sum(f"_v_{n}").over(here), F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)) for n in sums}
        out |= {n: F.greatest(F.max(f"_v_{n}").over(here), F.col(f"_c_{n}")) for n in maxima}
        return joined.withColumns(out).drop(*[f"_{k}_{n}" for n in (sums | maxima) for k in "vc"])


def largest_key(df, keys):
    """Rows of the largest key. Measured once on the input, it serves every operator on tables derived from it."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def open_series(df, keys, time, tie=None, lookback=0, max_rows=None, largest=None):
    """Prepare ``df`` for window functions ordered by ``(time, tie)`` within ``keys``.

    ``time`` is a numeric column. ``largest`` is an upper bound for the
    rows of a key, if the caller has one; it saves the count when no key needs to be cut."""
    max_rows = max_rows or DEFAULTS.max_group_rows
    keys = list(keys)
    order = [time] + ([tie] if tie else [])
    if largest is not None and largest <= max_rows:
        return Series(df, keys, order, split=False)
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows)
    n_large, rows = large.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not n_large:
        return Series(df, keys, order, split=False)
    # There are at most rows / max_rows large keys; the joins broadcast them only when they are really few.
    names = broadcast_if_small(checkpointed(large.select(*keys)), n_large)
    ordinary = df.join(names, keys, "left_anti").withColumns({BLOCK: F.lit(0), OWN: F.lit(True)})
    cut = _cut(df.join(names, keys, "left_semi"), keys, order, lookback, max_rows, rows)
    return Series(ordinary.unionByName(cut), keys, order, split=True)


def _cut(df, keys, order, lookback, max_rows, rows):
    """Rows of large keys with their block, and copies of the last ``lookback`` rows for the blocks after it.

    The place of a row within its key comes from range partitioning on key and order: the rows are written once with
    the number of their slice, and each slice adds the rows of the key in the slices before it. The block follows from
    the place by division, so neither the plan nor any row grows with the size of a key, and rows of equal time are
    cut apart too."""
    parts = max(2, min(MAX_SLICES, -(-2 * rows // max_rows)))
    tagged = df.withColumn("_row", F.monotonically_increasing_id())
    sliced = checkpointed(tagged.repartitionByRange(parts, *keys, *order, "_row").withColumn("_slice", F.spark_partition_id()))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(*keys, "_slice").count().select(
        *keys, "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"), F.sum("count").over(whole).alias("_n"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order, "_row")
    placed = sliced.withColumn("_at", F.row_number().over(inside) - 1).join(offsets, [*keys, "_slice"])
    block_of = lambda place: F.floor(place / max_rows).cast("int")
    place = F.col("_before") + F.col("_at")
    blocks = F.sequence(block_of(place), block_of(F.least(place + lookback, F.col("_n") - 1)))
    return placed.select(*df.columns, F.posexplode(blocks).alias("_copy", BLOCK)).withColumn(OWN, F.col("_copy") == 0).drop("_copy")
