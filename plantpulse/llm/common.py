"""Helpers that several corpus operators share: table access, folds, size-checked joins, global positions."""

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantpulse.session import checkpointed

# The characters of [\x20\x09-\x0D], which every contract here calls white space.
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"

# Largest number of ids that a join may broadcast (a long and its hash entry: about 40 MB).
MAX_BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(id_col: str, folds: int):
    """Fold of a row: CRC-32 of the id as text, modulo ``folds``. A row without id belongs to fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def without_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is not in ``ids``. The ids are broadcast when a count shows that they are few;
    else Spark joins by shuffle. Rows with a null stay."""
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, column, "left_anti")


def with_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``ids``; the same choice of join as ``without_ids``."""
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, column, "left_semi")


def row_key(id_col: str, text_col: str):
    """Identity of a row for decisions about it: its id (nulls last in order) and the digest of its text. Unlike the id alone it
    is never null, and rows that share it are the same document given several times."""
    text = F.col(text_col)
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), text.isNull().alias("empty"),
                    F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("text"))


def packed(df: DataFrame, **more) -> DataFrame:
    """The rows of ``df`` as one struct column ``doc`` beside the given columns, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), *[column.alias(name) for name, column in more.items()])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"doc.`{c}`") for c in columns])


def positions(df: DataFrame, order: list, key: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds to each row its place in the global order within its ``key`` columns, without sorting a key in one task.

    ``order`` must begin with the key. ``sums`` maps a new column to an integer column (or ``"1"`` to count rows);
    the new column is the sum over all earlier rows of the key. The rows are range partitioned and written once with
    the number of their slice; one total per (slice, key) gives the offset of the slice. Rows that agree in the whole
    order are told apart by their place in the input, so they share out the places between them.
    """
    clash = {"__slice", "__row"} & set(df.columns)
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    tagged = df.withColumn("__row", F.monotonically_increasing_id())
    ranged = checkpointed(tagged.repartitionByRange(*order, F.col("__row")).withColumn("__slice", F.spark_partition_id()))
    value = {new: F.lit(1) if old == "1" else F.col(old) for new, old in sums.items()}
    totals = ranged.groupBy("__slice", *key).agg(*[F.sum(v.cast("long")).alias(f"__t_{new}") for new, v in value.items()])
    before = Window.partitionBy(*key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__slice", *[F.col(k).alias(f"__k_{k}") for k in key],
        *[F.coalesce(F.sum(f"__t_{new}").over(before), F.lit(0)).alias(f"__o_{new}") for new in value],
    )
    inside = Window.partitionBy("__slice", *key).orderBy(*order, "__row").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(v.cast("long")).over(inside), F.lit(0)).alias(f"__l_{new}") for new, v in value.items()])
    same = local["__slice"] == offsets["__slice"]
    for k in key:
        same = same & local[k].eqNullSafe(offsets[f"__k_{k}"])
    return local.join(offsets, same).select(
        *df.columns, *[(F.col(f"__l_{new}") + F.col(f"__o_{new}")).alias(new) for new in value])


def hash_sample(df: DataFrame, id_col: str, limit: int, rows: int) -> DataFrame:
    """About ``limit`` rows of ``df``, which has ``rows``: those whose id hash lies below a threshold. The same rows
    are taken for any partitioning. All rows when there are fewer than ``limit``."""
    if rows <= limit:
        return df
    return df.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) < int((1 << 40) * (limit / rows)))


def chunks(data: bytes, size: int = 1 << 20):
    """Cuts a text into parts of about ``size`` bytes, each ending at a blank, so that no word is cut unless it is
    longer than ``size`` itself (then it stays whole)."""
    start = 0
    while len(data) - start > size:
        cut = data.find(b" ", start + size)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut
    yield data[start:] if start else data


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: float = 1 / 1000) -> DataFrame:
    """Inner join of ``rows`` with one row per group. Groups that hold at least ``share`` of all ``total`` rows are hot;
    there are at most 1 / share of them, and they are broadcast. The rest meets by shuffle."""
    hot = groups.filter(F.col(size) >= max(2.0, total * share))
    names = F.broadcast(hot.select(key))
    cold = rows.join(names, key, "left_anti").join(groups.join(names, key, "left_anti"), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def mix64(x: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit finaliser (add, multiply, shift) of unsigned values."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
