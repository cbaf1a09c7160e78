"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few length-invariant surface features, each feature a bin number. Cyclic boosting visits one
feature after the other and fits a shallow tree to the current gradients; the trees of a feature add up to one lookup
table. Then the pairs of features with the largest remaining gain get two-dimensional tables in the same way. A score is
the logistic function of intercept plus table values.

Texts are read once: features of all rows are written, then joined with the labels to train, then scored.

Defined cases: a null text is an empty text; its features are 0. Texts are processed whole, in chunks of about 1 MB.
Rows that repeat an id are scored each. Without labelled rows of the training folds the score is 0.5; with one class
only, it is the smoothed share of that class. Of several labels of one id the largest counts; null labels are ignored.
An empty table gives an empty result. Other columns play no part.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import chunks, fold, hash_sample, table
from plantpulse.session import checkpointed

# Bound of the labelled rows that the model is fitted on.
MAX_TRAIN_ROWS = 20_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
WINDOW = 400

FEATURES = [
    "log_words", "word_length", "upper", "symbol", "digit", "stop", "pipe", "exclamation", "high_byte", "distinct",
    "repeats", "symbol_end", "short_words", "lines",
]


def _classes() -> np.ndarray:
    """Byte classes: 0 blank, 1 upper, 2 lower, 3 digit, 4 stop, 5 symbol, 6 pipe, 7 exclamation, 8 high byte."""
    out = np.full(256, 5, dtype=np.uint8)
    for chars, code in ((b" \t\n\x0b\x0c\r", 0), (b".,;:'\"?-()", 4), (b"|", 6), (b"!", 7)):
        out[list(chars)] = code
    out[65:91], out[97:123], out[48:58], out[128:] = 1, 2, 3, 8
    return out


CLASSES = _classes()


def features(text: str | None) -> np.ndarray:
    counts, words, word_bytes, distinct, repeats, ends, short, lines = np.zeros(9, dtype=np.int64), 0, 0, 0, 0, 0, 0, 0
    for data in chunks((text or "").encode()):
        kinds = CLASSES[np.frombuffer(data, dtype=np.uint8)]
        counts += np.bincount(kinds, minlength=9)
        parts = data.split()
        words += len(parts)
        distinct += sum(len(set(parts[i:i + WINDOW])) for i in range(0, len(parts), WINDOW))
        repeats += sum(map(bytes.__eq__, parts, parts[1:]))
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        word_bytes += int(sizes.sum())
        short += int(np.count_nonzero(sizes <= 1))
        lines += data.count(b"\n")
        if len(kinds):
            before_blank = np.append(kinds[1:] == 0, True)
            ends += int(np.count_nonzero(before_blank & ((kinds == 5) | (kinds == 7))))
    solid, letters = max(1, int(counts[1:].sum())), max(1, int(counts[1] + counts[2] + counts[8]))
    w = max(1, words)
    return np.array([
        np.log1p(words), word_bytes / w, counts[1] / letters, counts[5] / solid, counts[3] / solid, counts[4] / solid,
        counts[6] / solid, counts[7] / solid, counts[8] / solid, distinct / w, repeats / w, ends / w, short / w, lines / w])


def feature_table(df: DataFrame, id_col: str, text_col: str, carry: str | None = None) -> DataFrame:
    """Id and features of every row, written once; ``__key`` is the column to carry along."""
    small = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), (F.col(carry) if carry else F.lit(0)).alias("__key"))

    def run(batches):
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(1)]
            flat = np.concatenate(rows) if rows else np.zeros(0)
            offsets = np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), batch.column(2)], names=["__id", "__x", "__key"])

    kind, key = (small.schema[c].dataType.simpleString() for c in ("__id", "__key"))
    return checkpointed(small.mapInArrow(run, f"__id {kind}, __x array<double>, __key {key}"))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _best_cut(g, h, smooth):
    """Cut of consecutive bins with the largest gain: (gain, first bin of the right side)."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + smooth) + (all_g - left_g) ** 2 / (all_h - left_h + smooth) - all_g**2 / (all_h + smooth)
    best = int(np.argmax(gain))
    return float(gain[best]), best + 1


def _tree(g, h, depth, smooth):
    """Values per bin of a tree of the given depth over one axis."""
    gain, cut = _best_cut(g, h, smooth) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + smooth))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1, smooth), _tree(g[cut:], h[cut:], depth - 1, smooth)])


def _pair_tree(g, h, smooth):
    """One cut on one axis, then a cut of each half on the other axis; the better of the two axis orders."""
    def grow(g, h):
        gain, cut = _best_cut(g.sum(1), h.sum(1), smooth)
        out, total = np.zeros_like(g), 0.0
        for rows in (slice(0, cut), slice(cut, None)) if gain > 1e-9 else (slice(None),):
            part_g, part_h = g[rows].sum(0), h[rows].sum(0)
            values = _tree(part_g, part_h, 1, smooth)
            out[rows] = values
            total += float((values * part_g - values**2 * (part_h + smooth / len(part_h)) / 2).sum())
        return total, out

    (a, first), (b, second) = grow(g, h), grow(g.T, h.T)
    return first if a >= b else second.T


class AdditiveModel:
    """Tables of single features and of pairs, over quantile bins."""

    def __init__(self, bins=32, pair_bins=12, pairs=8, rounds=250, pair_rounds=80, rate=0.1, smooth=1.0):
        self.bins, self.pair_bins, self.pairs, self.rounds = bins, pair_bins, pairs, rounds
        self.pair_rounds, self.rate, self.smooth = pair_rounds, rate, smooth
        self.intercept, self.edges, self.coarse, self.tables, self.pair_tables = 0.0, [], [], [], {}

    def fit(self, x: np.ndarray, y: np.ndarray) -> "AdditiveModel":
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        self.intercept = float(np.log(share / (1 - share)))
        if len(y) == 0 or y.min() == y.max():
            return self
        inner = lambda v, n: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1]))
        self.edges = [inner(x[:, f], self.bins) for f in range(x.shape[1])]
        self.coarse = [inner(x[:, f], self.pair_bins) for f in range(x.shape[1])]
        fine = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
        rough = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.coarse)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        z = np.full(len(y), self.intercept)
        for _ in range(self.rounds):
            for f, b in enumerate(fine):
                p = _sigmoid(z)
                n = len(self.tables[f])
                step = self.rate * _tree(np.bincount(b, y - p, n), np.bincount(b, p * (1 - p), n), 2, self.smooth)
                self.tables[f] += step
                z += step[b]

        def cells(i, j, p):
            shape = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
            k = rough[i] * shape[1] + rough[j]
            size = shape[0] * shape[1]
            return k, np.bincount(k, y - p, size).reshape(shape), np.bincount(k, p * (1 - p), size).reshape(shape)

        p, gains = _sigmoid(z), []
        for i, j in combinations(range(x.shape[1]), 2):
            _, g, h = cells(i, j, p)
            gains.append((float((g**2 / (h + 10 * self.smooth)).sum()), i, j))
        chosen = [(i, j) for _, i, j in sorted(gains, reverse=True)[: self.pairs]]
        self.pair_tables = {(i, j): np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)) for i, j in chosen}
        for _ in range(self.pair_rounds):
            for i, j in chosen:
                k, g, h = cells(i, j, _sigmoid(z))
                step = self.rate * _pair_tree(g, h, self.smooth)
                self.pair_tables[i, j] += step
                z += step.ravel()[k]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, values in enumerate(self.tables):
            z += values[np.searchsorted(self.edges[f], x[:, f], side="right")]
        for (i, j), values in self.pair_tables.items():
            z += values[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return _sigmoid(z)


def train(vectors: DataFrame, labels: DataFrame, label_col: str, label_id: str = "doc_id", limit: int = MAX_TRAIN_ROWS) -> AdditiveModel:
    """Fits the model on about ``limit`` labelled rows outside the held-out fold."""
    known = labels.filter(F.col(label_col).isNotNull() & (fold(label_id, FOLDS) != HELD_OUT)).groupBy(
        F.col(label_id).alias("__id")).agg(F.max(label_col).cast("double").alias("__y"))
    known = checkpointed(known)
    sample = hash_sample(known, "__id", limit, known.count())
    rows = vectors.join(sample, "__id").select("__id", "__x", "__y").toPandas().sort_values("__id", kind="stable")
    x = np.stack(rows["__x"]) if len(rows) else np.zeros((0, len(FEATURES)))
    return AdditiveModel().fit(x, rows["__y"].to_numpy(dtype=float))


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  threshold: float = THRESHOLD, carry: str | None = None) -> DataFrame:
    """Id, ``held_out``, ``score`` and ``predicted`` of every row of ``df``, and the column ``carry`` if one is named."""
    vectors = feature_table(df, id_col, text_col, carry)
    model = train(vectors, labels, label_col)

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES)) if len(batch) else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x)), batch.column(2)], names=["__id", "score", "__key"])

    kind, key = (vectors.schema[c].dataType.simpleString() for c in ("__id", "__key"))
    scored = vectors.mapInArrow(run, f"__id {kind}, score double, __key {key}")
    return scored.select(
        F.col("__id").alias(id_col), (fold("__id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), *([F.col("__key").alias(carry)] if carry else []))


def query(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
