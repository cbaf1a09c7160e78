"""Time-ordered folds and hash hold-out."""

from pyspark.sql import functions as F

from plantpulse.operators.ranks import running_counts, value_counts
from plantpulse.params import DEFAULTS
from plantpulse.schemas import EPOCH_MS, ROW_ID


def fold_starts(n, splits=5):
    """First row index of each test block and the end of the last one."""
    size = n // (splits + 1)
    if size == 0:
        raise ValueError(f"{n} rows are too few for {splits} folds")
    return [n - (splits - i) * size for i in range(splits)] + [n]


def boundaries(df, indexes, time=EPOCH_MS, tie=ROW_ID, p=DEFAULTS):
    """``(time, tie)`` of the rows at the given positions of the global order. No global sort of the rows: the
    position is found in the running counts of distinct times, then among the rows of that one time."""
    keyed = df.select(F.lit(0).alias("_all"), time)
    counts = value_counts(keyed, ["_all"], time, {"w": F.lit(1)})
    n = df.count()
    ranked = running_counts(counts, ["_all"], time, ["w"], n, p.max_group_rows)
    inside = F.filter(
        F.array(*[F.lit(i).cast("long") for i in indexes]),
        lambda i: (i >= F.col("cum_w") - F.col("w")) & (i < F.col("cum_w")),
    )
    hits = ranked.select(time, "w", (F.col("cum_w") - F.col("w")).alias("before"), F.explode(inside).alias("i")).collect()
    found = {}
    for hit in hits:  # one row per requested index
        offset = hit["i"] - hit["before"]
        if hit["w"] == 1:
            found[hit["i"]] = (hit[time], None)
        else:
            same = df.where(F.col(time) == hit[time]).select(tie).orderBy(tie)
            found[hit["i"]] = (hit[time], same.offset(offset).first()[0])
    return [found[i] for i in indexes]


def before(bound, time=EPOCH_MS, tie=ROW_ID):
    """Rows ordered before a boundary; a plain time filter that the file scan can use."""
    at, at_tie = bound
    earlier = F.col(time) < at
    return earlier if at_tie is None else earlier | ((F.col(time) == at) & (F.col(tie) < at_tie))


def time_series_folds(df, splits=5, time=EPOCH_MS, tie=ROW_ID, p=DEFAULTS):
    """Expanding-window folds as ``[(fold, train, test)]``: each trains on everything before its test block."""
    n = df.count()
    starts = fold_starts(n, splits)
    bounds = boundaries(df, starts[:-1], time, tie, p)
    folds = []
    for i, bound in enumerate(bounds):
        test = df.where(~before(bound, time, tie))
        if i + 1 < len(bounds):
            test = test.where(before(bounds[i + 1], time, tie))
        folds.append((i + 1, df.where(before(bound, time, tie)), test))
    return folds


def hash_split(df, key=ROW_ID, train_percent=80, seed=42):
    """Random hold-out that depends only on the row key, so it is the same after any repartitioning."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100
    return df.where(bucket < train_percent), df.where(bucket >= train_percent)
