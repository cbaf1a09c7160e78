"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets its number in ascending id order (``common.positions``: range partitioned, no single sort task). A keyed
Feistel network permutes the numbers 0 .. rows-1; values that leave the range walk on along the cycle until they fall
into it, so the result is a permutation for any number of rows. Place ``p`` belongs to shard ``p % shards`` at slot
``p // shards``: shard sizes differ by one row at most and slots have no gap. Both can be computed from a row number
alone, and ``row_number`` goes back from (shard, slot).

The law is ``rows``. Sizes in bytes are reported, not balanced, and equal texts may lie in different shards.

Defined cases: a null text has size 1 and checksum 0, like an empty one. A null id comes first in the order. Rows that
agree in id, size and checksum are told apart by their place in the input; they share out their places between them.
An empty table gives an empty result. Other columns play no part.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import mix64, positions, table

ROUNDS = 6


def _keys(seed: int) -> list[int]:
    return [int(k) for k in np.random.default_rng(seed).integers(0, 1 << 63, ROUNDS)]


def _half_bits(n: int) -> int:
    """Smallest b with 4**b >= n."""
    return max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)


def _pass(x, bits, keys, backwards):
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & mask
    for key in reversed(keys) if backwards else keys:
        if backwards:
            left, right = right ^ (mix64(left, key) & mask), left
        else:
            left, right = right, left ^ (mix64(right, key) & mask)
    return (left << np.uint64(bits)) | right


def permute(numbers, n: int, seed: int = 0, backwards: bool = False) -> np.ndarray:
    """Seeded permutation of 0 .. n-1, or its inverse, for an array of numbers below ``n``."""
    bits, keys = _half_bits(n), _keys(seed)
    x = _pass(np.asarray(numbers, dtype=np.uint64), bits, keys, backwards)
    outside = np.flatnonzero(x >= np.uint64(n))
    while len(outside):
        x[outside] = _pass(x[outside], bits, keys, backwards)
        outside = outside[x[outside] >= np.uint64(n)]
    return x.astype(np.int64)


def row_number(shard: int, slot: int, shards: int, n: int, seed: int = 0) -> int:
    """Number (ascending id) of the row at a slot of a shard."""
    place = slot * shards + shard
    if not (0 <= shard < shards and 0 <= place < n):
        raise ValueError(f"shard {shard} has no slot {slot}")
    return int(permute([place], n, seed, backwards=True)[0])


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, seed: int = 0) -> DataFrame:
    """One row per row of ``df``: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = df.select(
        F.col(id_col).alias("__id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered = positions(small, [F.col("__id"), F.col("size"), F.col("text_crc32")], [], {"__number": "1"})
    # One row is written per document above; the count reads file footers only.
    n = df.count()

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    return numbered.withColumn("__place", place("__number")).select(
        F.col("__id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("__place") % shards).cast("int").alias("shard"),
        F.floor(F.col("__place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir):
    return shard_rows(table(spark, sf_dir, "documents"))
