"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only.

First pass: every row sets one cell in each of two arrays of cells, by two hashes of its text digest; the cells that
were hit at least twice are packed into bitmaps. Second pass: a row whose two cells are both marked may have a copy;
only such rows are shuffled, all others pass straight through. Rows wrongly suspected form groups of one, so the
filter never changes a result, only the amount of data that moves.

The bitmaps are broadcast. Their size has a fixed bound: two arrays of at most ``max_cells`` bits (16 MB each at the
default of 2**27). Above about 10 million rows they fill up and more rows shuffle: their digests in ``verdicts``, and in ``drop_copies`` their texts too.

Defined cases: a null text is an empty text, and all texts that are empty after removing white space are one group.
Of equal texts the one with the most code points stays, then the smallest id; a null id comes last. Rows that repeat
an id with the same text are one document given several times: each counts in ``group_size`` and all share one
verdict; ``drop_copies`` returns one of them. Empty tables give empty results. Other columns play no part and may have any
name; ``drop_copies`` returns them unchanged.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import BLANKS, join_groups, packed, table, unpacked
from plantpulse.session import checkpointed

MAX_CELLS = 1 << 27
CELLS_PER_ROW = 16
# A group with at least this share of all rows is hot: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000


def digest_columns(text_col: str):
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.unhex(F.sha2(F.translate(text, BLANKS, ""), 256)).alias("__sha"), F.length(text).cast("long").alias("__length")]


def _cell(key: str, half: int, cells: int):
    """Cells count from 1, as the bitmap functions do."""
    return F.pmod(F.xxhash64(key, F.lit(half)), F.lit(cells)) + 1


def cells_for(rows: int, max_cells: int = MAX_CELLS) -> int:
    return min(1 << max(16, (CELLS_PER_ROW * rows).bit_length()), max_cells)


def hit_cells(df: DataFrame, key: str, cells: int, least: int = 1) -> DataFrame:
    """Bitmaps (half, bucket, bits) of the cells that at least ``least`` rows hit."""
    hits = df.select(F.explode(F.array(*[
        F.struct(F.lit(half).alias("half"), _cell(key, half, cells).alias("cell")) for half in (0, 1)])).alias("hit")).select("hit.*")
    counted = hits.groupBy("half", "cell").count().filter(F.col("count") >= least) if least > 1 else hits
    return counted.groupBy("half", F.bitmap_bucket_number("cell").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))


def marked(df: DataFrame, bitmaps: DataFrame, cells: int, key: str = "__sha") -> DataFrame:
    """Adds the boolean ``__suspect``: both cells of the row are marked."""
    out, tests = df, []
    for half in (0, 1):
        part = bitmaps.filter(F.col("half") == half).select(F.col("bucket").alias(f"__b{half}"), F.col("bits").alias(f"__bits{half}"))
        out = out.join(F.broadcast(part), F.bitmap_bucket_number(_cell(key, half, cells)) == F.col(f"__b{half}"), "left")
        place = F.bitmap_bit_position(_cell(key, half, cells))
        byte = F.conv(F.hex(F.substring(F.col(f"__bits{half}"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        tests.append(F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)))
    return out.select(*df.columns, (tests[0] & tests[1]).alias("__suspect"))


class Copies:
    """Digests, bitmaps and groups of one table; each is written once."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, max_cells: int = MAX_CELLS):
        self.id_col, self.text_col = id_col, text_col
        self.digests = checkpointed(df.select(F.col(id_col).alias("__id"), *digest_columns(text_col)))
        self.rows = self.digests.count()
        self.cells = cells_for(self.rows, max_cells)
        self.bitmaps = checkpointed(hit_cells(self.digests, "__sha", self.cells, least=2))
        best = F.min(F.struct((-F.col("__length")).alias("l"), F.col("__id").isNull().alias("n"), F.col("__id").alias("id")))
        suspects = marked(self.digests, self.bitmaps, self.cells).filter("__suspect")
        self.groups = checkpointed(
            suspects.groupBy("__sha").agg(best.alias("best"), F.count("*").alias("__size"))
            .select("__sha", F.col("best.id").alias("__keep"), (-F.col("best.l")).alias("__best_length"), "__size"))

    def judged(self, df: DataFrame) -> DataFrame:
        """``df`` (with ``__id``, ``__sha``, ``__length``) plus ``__keep``, ``__best_length`` and ``__size``. Hot groups
        meet their verdict by broadcast (at most 1 / HOT_SHARE rows), other suspects by shuffle."""
        flagged = marked(df, self.bitmaps, self.cells)
        passed = flagged.filter(~F.col("__suspect")).select(
            *df.columns, F.col("__id").alias("__keep"), F.col("__length").alias("__best_length"), F.lit(1).cast("long").alias("__size"))
        suspects = flagged.filter("__suspect").drop("__suspect")
        return passed.unionByName(join_groups(suspects, self.groups, "__sha", "__size", self.rows, HOT_SHARE).select(*passed.columns))


def _kept():
    return F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__length") == F.col("__best_length"))


def verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per row of ``df``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. Texts are read once."""
    copies = Copies(df, id_col, text_col, max_cells)
    return copies.judged(copies.digests).select(
        F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"),
        _kept().alias("kept"), F.lower(F.hex("__sha")).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """The rows of ``df`` that stay, with the columns of ``df``, whatever they are called: one row of every group, also
    where rows repeat id and text. Texts that cannot have a copy are not shuffled."""
    copies = Copies(df, id_col, text_col, max_cells)
    sha, length = digest_columns(text_col)
    kept = copies.judged(packed(df, __id=F.col(id_col), __sha=sha, __length=length)).filter(_kept())
    alone = kept.filter(F.col("__size") == 1)
    one = kept.filter(F.col("__size") > 1).groupBy("__sha").agg(F.first("doc").alias("doc"))
    return unpacked(alone.select("doc").unionByName(one.select("doc")), df.columns)


def query(spark, sf_dir):
    return verdicts(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, s AS text_sha256
FROM n WINDOW w AS (PARTITION BY s ORDER BY size DESC, doc_id)
"""
