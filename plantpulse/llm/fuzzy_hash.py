"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes marks boundaries where it falls on a multiple of the block size; each piece between
boundaries gives one character of a signature. A fingerprint ``block:signature:signature2`` holds the signatures at the
block size and at twice that size. Two fingerprints are compared at block sizes they share, by the edit distance
(insertions and deletions) of the signatures: 1 - distance / (sum of lengths), and 0 without a common run of seven
characters (of the shorter signature, if it is shorter).

The next document in ascending id is found without sorting in one task: the ids are cut at quantiles, the texts are
dealt to one slice per range of ids, and the first document of a slice is also sent to the slice before it. Within a
slice, sorted rows are streamed; a task holds two texts at a time.

Defined cases: a null text is an empty text, with fingerprint ``3::``. Two empty signatures are alike (1), an empty and a
filled one are not (0). A null id comes first in the order; rows that repeat an id are ordered by text and are all
fingerprinted. The only document is its own next document. An empty table gives an empty result. Other columns play no part.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import mix64, table

# The alphabet of signatures.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), dtype=np.uint8)
CONTEXT, SMALLEST, LENGTH, COMMON = 7, 3, 64, 7
_STEP = 1 << 20
# Bound of the slices that the driver plans boundaries for.
MAX_SLICES = 4096


def _rolling(codes: np.ndarray) -> np.ndarray:
    """Hash of the last seven bytes at every place; earlier bytes count as zero."""
    padded = np.concatenate([np.zeros(CONTEXT - 1, dtype=np.uint64), codes.astype(np.uint64)])
    out, base = np.zeros(len(codes), dtype=np.uint64), 1
    for k in range(CONTEXT):
        out += padded[CONTEXT - 1 - k: len(padded) - k] * np.uint64(base)
        base = base * 0x100000001B3 % (1 << 64)
    return (mix64(out, 5) >> np.uint64(32)).astype(np.uint32)


def _piece_values(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Character number of the pieces that end before ``ends``: sums of mixed (byte, place in piece) values, taken
    over one stretch of the text at a time."""
    starts, sums = np.concatenate([[0], ends[:-1]]), np.zeros(len(ends), dtype=np.uint64)
    for a in range(0, len(codes), _STEP):
        b = min(len(codes), a + _STEP)
        lo, hi = np.searchsorted(ends, [a, b - 1], side="right")
        cuts = np.concatenate([[a], ends[lo:hi]])
        place = np.arange(a, b) - np.repeat(starts[lo:hi + 1], np.diff(np.append(cuts, b)))
        values = mix64(codes[a:b].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)), 11)
        sums[lo:hi + 1] += np.add.reduceat(values, cuts - a)
    return (mix64(sums, 13) >> np.uint64(58)).astype(np.int64)


def _hashes(data: bytes):
    codes = np.frombuffer(data, dtype=np.uint8)
    parts = [_rolling(codes[max(0, i - CONTEXT + 1): i + _STEP])[min(i, CONTEXT - 1):] for i in range(0, len(codes), _STEP)]
    return codes, np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


def _ends(rolling: np.ndarray, block: int) -> np.ndarray:
    ends = np.flatnonzero(rolling % np.uint32(block) == block - 1) + 1
    return ends if len(ends) and ends[-1] == len(rolling) else np.append(ends, len(rolling))


def _signature(codes: np.ndarray, ends: np.ndarray) -> str:
    return _LETTERS[_piece_values(codes, ends)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    """The block size is the smallest 3 * 2**k that gives about 64 pieces or fewer; it is halved while a signature has
    fewer than 32 characters."""
    data = (text or "").encode()
    if not data:
        return f"{SMALLEST}::"
    codes, rolling = _hashes(data)
    block = SMALLEST
    while block * LENGTH < len(data):
        block *= 2
    ends = _ends(rolling, block)
    while len(ends) < LENGTH // 2 and block > SMALLEST:
        block //= 2
        ends = _ends(rolling, block)
    return f"{block}:{_signature(codes, ends)}:{_signature(codes, _ends(rolling, 2 * block))}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    k = min(COMMON, len(a), len(b))
    runs = {a[i:i + k] for i in range(len(a) - k + 1)}
    if not any(b[i:i + k] in runs for i in range(len(b) - k + 1)):
        return 0.0
    return 2.0 * _common(a, b) / (len(a) + len(b))


def compare(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1; 0 at incompatible block sizes."""
    if a == b:
        return 1.0
    (x, a1, a2), (y, b1, b2) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    if x == y:
        return max(_likeness(a1, b1), _likeness(a2, b2) if a2 and b2 else 0.0)
    if x == 2 * y:
        return _likeness(a1, b2)
    return _likeness(a2, b1) if y == 2 * x else 0.0


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bounds(ids: DataFrame, slices: int) -> list:
    """Ids that begin a slice, ascending; at most ``slices`` of them."""
    if slices < 2:
        return []
    shares = [k / slices for k in range(1, slices)]
    row = ids.agg(F.percentile_approx("id", shares, 20 * slices).alias("q")).first()
    return sorted(set(row.q or []))


def _result(own, following):
    (row, text, _, mark), (_, after, _, mark_after) = own, following
    changed = edited(text, after)
    mark_changed = fingerprint(changed)
    return (row, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark, mark_changed, compare(mark, mark_changed),
            compare(mark, mark_after))


_SCHEMA = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
           "near_next double")
_ARROW = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _stream(batches):
    """Results of the documents of one slice; rows that are copies (third column) only serve as next documents."""
    held = None
    for batch in batches:
        out = []
        for row, text, copy in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            now = (row, text, copy, fingerprint(text))
            if held is not None and not held[2]:
                out.append(_result(held, now))
            held = now
        columns = zip(*out, strict=True) if out else [[] for _ in _ARROW]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slices: int | None = None) -> DataFrame:
    """One row per row of ``df``: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``. Ids are integers. ``slices``: ranges of ids to deal the texts to."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slices = slices or min(MAX_SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = np.array(_bounds(docs.select("id"), slices), dtype=np.int64)
    last, least = len(bounds), np.iinfo(np.int64).min

    # The very first document follows the last one; of equal first ids the one with the smallest text.
    smallest = docs.agg(F.min(F.struct(F.coalesce("id", F.lit(least)).alias("id"))).alias("s")).select("s.id").first().id
    opening = docs.filter(F.coalesce("id", F.lit(least)) == (least if smallest is None else smallest)).agg(
        F.min_by(F.xxhash64("text"), "text").alias("h")).first().h
    opens = (F.coalesce("id", F.lit(least)) == F.lit(least if smallest is None else smallest)) & (F.xxhash64("text") == F.lit(opening or 0))

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        """Slice of a document, then the slice before it if the document begins its slice."""
        values = ids.fillna(least).to_numpy(dtype=np.int64)
        own = np.searchsorted(bounds, values, side="right")
        begins = (bounds[np.maximum(own - 1, 0)] == values) & (own > 0) if last else np.zeros(len(values), dtype=bool)
        return pd.Series([[int(o), int(o) - 1] if b else [int(o)] for o, b in zip(own, begins, strict=True)])

    targets = F.concat(places("id"), F.when(opens, F.array(F.lit(last))).otherwise(F.array().cast("array<int>")))
    dealt = docs.select("id", "text", F.posexplode(targets).alias("copy", "slice"))
    ordered = dealt.repartitionById(last + 1, F.col("slice")).select("id", "text", (F.col("copy") > 0).alias("copy"))
    sliced = ordered.sortWithinPartitions("copy", F.asc_nulls_first("id"), "text")
    return sliced.mapInArrow(_stream, _SCHEMA).withColumnRenamed("id", id_col)


def query(spark, sf_dir):
    """Fingerprints of all texts and of their edited forms, with likenesses."""
    return fingerprints(table(spark, sf_dir, "documents"))
