"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The words of a source, in ascending document id, are cut into blocks of equal length: ``BLOCK`` words, and less where the
source or its target is small, so that every source has ``PARTS`` blocks to choose from at least (or single words). Sources
get weights by their place in code-point order; their targets share a multiple of all words, and what would exceed the
limit of a source is shared again among the others. The blocks that make up all targets are then seats: each goes to the
source with the highest quotient target / (block * (2 seats + 1)). Seats are dealt to the shards in turn, which gives an
integer quota per source and shard. A seeded permutation of the block numbers of a source (Feistel network with cycle
walking) fills its seats in order, beginning again when all blocks have had one, and a block goes to the shard of its
seat. So whether a block is taken, how often and for which shard, follows from its number alone, and no list of blocks
is ever sorted or stored.

Sources are one table; the driver sees only sums over it. Documents meet their source by broadcast if the source is hot
(at least a thousandth of all documents), else by shuffle; places within a source come from range partitioning.

Defined cases: a null text has size 0. A null source is a source of its own, last in order. A source without words has
target 0. Rows that repeat an id take their own places. Equal quotients go to the earlier source. An empty table gives
an empty result. Other columns play no part.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import chunks, join_groups, packed, positions, row_key, table, unpacked
from plantpulse.llm.sharding import permute
from plantpulse.session import broadcast_if_small, checkpointed

WEIGHTS, SHARE, LIMIT = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCK, PARTS, SHARDS = 64, 64, 8
# Parts of a whole in which rests of documents are added up.
UNIT = 1 << 20


def _sized(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Id, source and number of words of each row, written once; ``key`` is the source without nulls."""
    small = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            sizes = [sum(len(part.split()) for part in chunks((t.as_py() or "").encode())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["id", "source", "size"])

    kind = small.schema["id"].dataType.simpleString()
    sized = small.mapInArrow(run, f"id {kind}, source string, size long")
    return checkpointed(sized.withColumn("key", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))))


def targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, limit=LIMIT) -> DataFrame:
    """One row per source: key, place, rows, source_size, target. The level of the water (words per unit of weight)
    rises until no source is above its limit; every round is one sum over the sources."""
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    placed = positions(sources, [F.col("source").isNull(), F.col("source")], [], {"place": "1"})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = checkpointed(placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(limit))))
    wanted = share * (placed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, F.lit(False)
    while True:
        held, free = placed.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (wanted - held) / free if free else level
        if new <= level:
            break
        level, full = new, F.lit(new) * F.col("weight") > F.col("cap")
    return placed.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.col("cap")))


def apportion(sources: DataFrame, block: int = BLOCK, limit: int = int(LIMIT)) -> DataFrame:
    """Adds ``block`` (words in one), ``blocks`` (of the source), ``seats`` and ``before`` (seats of the sources before it).
    Highest quotients are found through the divisor: for divisor d a source has floor(target / (d * block) + 1/2) seats.
    Each round sums the words of the seats for 63 divisors at once."""
    own = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.least("source_size", "target") / PARTS))).cast("long")
    sources = checkpointed(sources.withColumn("block", own).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long")))
    seats_at = lambda d: F.least(F.floor(F.col("target") / F.col("block") / F.lit(float(d)) + 0.5), F.col("blocks") * limit)
    words_at = lambda d: seats_at(d) * F.col("block")
    wanted = round(sources.agg(F.sum("target")).first()[0] or 0.0)
    low, high = 1 / 4.0, 4.0  # more words at low, fewer at high
    while high - low > 1e-12 * high:
        tried = np.linspace(low, high, 65)[1:-1]
        row = sources.agg(*[F.coalesce(F.sum(words_at(d)), F.lit(0)) for d in tried]).first()
        enough = [i for i, total in enumerate(row) if total >= wanted]
        if any(total == wanted for total in row):
            low = high = float(tried[next(i for i, total in enumerate(row) if total == wanted)])
            break
        low, high = (float(tried[enough[-1]]) if enough else low), (float(tried[enough[-1] + 1]) if enough and enough[-1] < 62 else high if enough else float(tried[0]))
    given = sources.withColumn("seats", seats_at(high).cast("long"))
    missing = wanted - (given.agg(F.sum(F.col("seats") * F.col("block"))).first()[0] or 0)
    if missing > 0:  # equal quotients at the divisor: earlier sources first
        tied = positions(given.filter(seats_at(low) > F.col("seats")).select("place", "block"), [F.col("place")], [], {"words": "block"})
        more = tied.filter(F.col("words") < missing).select("place", F.lit(1).alias("more"))
        given = given.join(more, "place", "left").withColumn("seats", F.col("seats") + F.coalesce("more", F.lit(0))).drop("more")
    return checkpointed(positions(given, [F.col("place")], [], {"before": "seats"}))


def shard_quotas(sources: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Blocks that each source gives to each shard."""
    shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    first = F.pmod(F.col("shard") - F.col("before"), F.lit(shards))
    return sources.select("source", "seats", "before", shard).select(
        "source", "shard", F.greatest(F.floor((F.col("seats") - first + shards - 1) / shards), F.lit(0)).alias("blocks"))


def seats_of(blocks: np.ndarray, total: int, seats: int, before: int, seed: int, shards: int) -> np.ndarray:
    """How often each of the given blocks of a source is taken for each shard (a row per block). A block that the
    permutation puts at place r gets the seats r, r + total, and so on; a seat belongs to the shard whose quota it fills."""
    times = np.zeros((len(blocks), shards), dtype=np.int64)
    place = permute(blocks, total, seed)
    for seat in range(0, seats, total):
        taken = np.flatnonzero(place + seat < seats)
        times[taken, (before + place[taken] + seat) % shards] += 1
    return times


def _taken(rows, seed: int, shards: int):
    """Words of each row of a batch taken for each shard, from the place of its words within the source."""
    start, size, place, block, blocks, seats, before = rows
    taken = np.zeros((len(start), shards), dtype=np.int64)
    for source in np.unique(place):
        at = np.flatnonzero((place == source) & (size > 0) & (seats > 0))
        if not len(at):
            continue
        length = int(block[at[0]])
        a, b = start[at], start[at] + size[at]
        first, count = a // length, (b - 1) // length - a // length + 1
        row = np.repeat(np.arange(len(at)), count)
        number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
        words = np.minimum(b[row], (number + 1) * length) - np.maximum(a[row], number * length)
        times = seats_of(number, int(blocks[at[0]]), int(seats[at[0]]), int(before[at[0]]), seed + int(source), shards)
        taken[at] = np.add.reduceat(words[:, None] * times, np.cumsum(count) - count, axis=0)
    return taken


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, share=SHARE,
        limit=LIMIT, block: int = BLOCK, seed: int = 0, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``df``: id, ``size``, ``source_size``, ``target``, ``taken``, ``shard_words`` (words taken for each
    shard) and ``source_place``."""
    sized = _sized(df, id_col, source_col, text_col)
    sources = apportion(targets(sized, weights, share, limit), block, int(limit))
    placed = positions(sized.select("id", "key", "size"), [F.col("key"), F.col("id"), F.col("size")], ["key"], {"start": "size"})
    groups = sources.select("key", "rows", "source_size", "target", "place", "block", "blocks", "seats", "before")
    joined = join_groups(placed, groups, "key", "rows", sized.count())

    def run(batches):
        for batch in batches:
            taken = _taken([batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 1, 5, 6, 7, 8, 9)], seed, shards)
            offsets = pa.array(np.arange(0, taken.size + 1, shards), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(taken.sum(axis=1)), pa.ListArray.from_arrays(offsets, pa.array(taken.ravel())), batch.column(5)],
                names=["id", "size", "source_size", "target", "taken", "shard_words", "source_place"])

    kind = joined.schema["id"].dataType.simpleString()
    return joined.select("id", "size", "source_size", "target", "start", "place", "block", "blocks", "seats", "before").mapInArrow(
        run, f"id {kind}, size long, source_size long, target double, taken long, shard_words array<long>, source_place long").withColumnRenamed("id", id_col)


def mixed_documents(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes its words: whole times, and the rests of a source are added up in
    order of size and paid out as whole documents, so that the words of a source are met within one of its documents.
    Documents without words are left out. Rows that repeat id and text come equally often."""
    rows = packed(df, key=row_key(id_col, text_col), source=F.col(source_col), text=F.col(text_col))
    takes = mix(rows, "key", "source", "text", seed=seed).groupBy("key", "source_place").agg(
        F.sum("taken").alias("taken"), F.sum("size").alias("size")).filter("size > 0")
    rest = F.floor((F.col("taken") % F.col("size")) * F.lit(UNIT) / F.col("size")).cast("long")
    added = positions(takes.withColumn("rest", rest), [F.col("source_place"), F.col("size"), F.col("key")], ["source_place"], {"sum": "rest"})
    first = F.pmod(F.xxhash64("source_place", F.lit(seed)), F.lit(UNIT))
    whole = lambda value: F.floor((value + first) / UNIT)
    times = F.floor(F.col("taken") / F.col("size")) + whole(F.col("sum") + F.col("rest")) - whole(F.col("sum"))
    chosen = checkpointed(added.select("key", times.cast("int").alias("times")).filter("times > 0"))
    joined = rows.select("doc", "key").join(broadcast_if_small(chosen, chosen.count()), "key")
    return unpacked(joined.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))), df.columns)


def query(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
