"""Language identification by a byte convolutional network in numpy.

A text is cut into windows of fixed length; bytes are embedded, filters of several widths slide over them, each filter
keeps its largest response in the window, and a softmax layer turns the responses into log probabilities. The log
probabilities of all windows of a text are averaged, weighted by the bytes in them, so that the whole text counts.
The network is trained with Adam on all windows of the texts of a bounded hash sample of labelled rows and shipped to the
tasks. The sample is drawn per language, so a rare language keeps its rows at any size of the table.

Defined cases: a null text or one without a letter is ``und`` with score 0. Without any labelled row no language can
be learned, and all rows are ``und``. Rows that repeat an id are predicted each. Short windows are padded with zero
bytes. Long texts are cut into windows batch by batch, so memory does not grow with the text. An empty table gives an
empty result. Other columns play no part.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import fold, table

# Bound of the training rows, and the number of windows that training looks at: each window once at least.
MAX_TRAIN_ROWS, SEEN_WINDOWS = 1_200, 50_000
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
WINDOW, WIDTHS, FILTERS, EMBED, BATCH = 256, (2, 3, 4), 12, 6, 128


class ByteNetwork:
    """Embedding -> filters of each width -> rectified maximum over the window -> softmax."""

    def __init__(self, classes: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.embedding = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embedding[0] = 0
        self.filters = [rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shifts = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        width = len(WIDTHS) * FILTERS
        self.output = rng.normal(0, width**-0.5, (width, len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), dtype=np.float32)

    def _parameters(self):
        return [self.embedding, *self.filters, *self.shifts, self.output, self.bias]

    @staticmethod
    def _slices(embedded, w):
        """All runs of ``w`` embedded bytes: (windows, places, w * EMBED)."""
        n, length, _ = embedded.shape
        flat = np.ascontiguousarray(embedded).reshape(n, length * EMBED)
        return np.lib.stride_tricks.as_strided(
            flat, (n, length - w + 1, w * EMBED), (flat.strides[0], EMBED * flat.itemsize, flat.itemsize))

    def _forward(self, codes):
        embedded = self.embedding[codes]
        pooled, best = [], []
        for w, kernel, shift in zip(WIDTHS, self.filters, self.shifts, strict=True):
            places = embedded.shape[1] - w + 1
            response = (self._slices(embedded, w).reshape(-1, w * EMBED) @ kernel).reshape(len(codes), places, FILTERS)
            best.append(response.argmax(axis=1))
            pooled.append(response.max(axis=1) + shift)
        hidden = np.concatenate(pooled, axis=1)
        active = np.maximum(hidden, 0)
        logits = active @ self.output + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        return embedded, best, hidden, active, logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """``codes``: uint8 windows (n, WINDOW)."""
        embedded = self.embedding[codes]
        pooled = []
        for w, kernel, shift in zip(WIDTHS, self.filters, self.shifts, strict=True):
            response = (self._slices(embedded, w).reshape(-1, w * EMBED) @ kernel).reshape(len(codes), -1, FILTERS)
            pooled.append(response.max(axis=1) + shift)
        logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.output + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def _gradients(self, codes, target):
        n = len(codes)
        embedded, best, hidden, active, logp = self._forward(codes)
        error = np.exp(logp)
        error[np.arange(n), target] -= 1
        error /= n
        back = (error @ self.output.T) * (hidden > 0)
        d_embedded, d_filters, d_shifts = np.zeros_like(embedded), [], []
        for i, (w, kernel) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            part = back[:, i * FILTERS:(i + 1) * FILTERS]
            rows = np.arange(n)[:, None]
            picked = self._slices(embedded, w)[rows, best[i]]  # (n, FILTERS, w * EMBED)
            d_filters.append(np.einsum("nf,nfk->kf", part, picked))
            d_shifts.append(part.sum(axis=0))
            spread = part[:, :, None] * kernel.T[None]
            for k in range(w):
                np.add.at(d_embedded, (rows, best[i] + k), spread[:, :, k * EMBED:(k + 1) * EMBED])
        d_table = np.zeros_like(self.embedding)
        np.add.at(d_table, codes.ravel(), d_embedded.reshape(-1, EMBED))
        d_table[0] = 0
        return [d_table, *d_filters, *d_shifts, active.T @ error, error.sum(axis=0)]

    def fit(self, codes, target, epochs=None, size=64, rate=0.01, seed=0):
        epochs = epochs or max(1, min(12, -(-SEEN_WINDOWS // max(1, len(codes)))))
        rng = np.random.default_rng(seed)
        parameters = self._parameters()
        first, second, step = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
        for epoch in range(epochs):
            order = rng.permutation(len(codes))
            for start in range(0, len(order), size):
                rows, step = order[start:start + size], step + 1
                lr = rate * (1 - epoch / epochs) + 1e-4
                for p, m, v, g in zip(parameters, first, second, self._gradients(codes[rows], target[rows]), strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
        return self


def windows(data: bytes) -> np.ndarray:
    """Windows of a text, the last one padded with zero bytes."""
    count = max(1, -(-len(data) // WINDOW))
    out = np.zeros(count * WINDOW, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(count, WINDOW)


def train(df: DataFrame, id_col: str, text_col: str, lang_col: str, limit: int = MAX_TRAIN_ROWS) -> ByteNetwork | None:
    """Network fitted on the whole texts of a hash sample of the labelled rows outside the held-out fold, about ``limit`` in
    all and equally many of each language as far as there are; None if there is no row."""
    known = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(
        F.col("lang").isNotNull() & (fold("id", FOLDS) != HELD_OUT))
    # Counting needs the label column only, so the text is left to the sampled rows.
    counts = known.groupBy("lang").count().collect()  # one row per language
    each = limit / max(1, len(counts))
    lands = [F.lit(False)] + [(F.col("lang") == r.lang) & (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, each / r["count"]))) for r in counts]
    sample = known.filter(reduce(lambda a, b: a | b, lands)).filter(F.col("text").rlike("\\p{L}"))
    data = sample.toPandas().sort_values(["id", "text"], kind="stable")
    if data.empty:
        return None
    classes = sorted(data["lang"].unique())
    codes = [windows(t.encode()) for t in data["text"]]
    target = np.repeat([classes.index(x) for x in data["lang"]], [len(c) for c in codes])
    return ByteNetwork(classes).fit(np.concatenate(codes), target)


def _predict(network: ByteNetwork, texts: list[bytes]):
    """Mean log probabilities per text; windows of many texts share one batch."""
    total, weight = np.zeros((len(texts), len(network.classes))), np.zeros(len(texts))
    held, owner, size, waiting = [], [], [], 0

    def flush():
        nonlocal held, owner, size, waiting
        codes, who, used = np.concatenate(held), np.concatenate(owner), np.concatenate(size)
        for i in range(0, len(codes), BATCH):
            part = network.log_probabilities(codes[i:i + BATCH]) * used[i:i + BATCH, None]
            np.add.at(total, who[i:i + BATCH], part)
        np.add.at(weight, who, used)
        held, owner, size, waiting = [], [], [], 0

    step = WINDOW * 4096
    for i, data in enumerate(texts):
        for start in range(0, max(1, len(data)), step):
            part = data[start:start + step]
            codes = windows(part)
            used = np.full(len(codes), WINDOW, dtype=np.float64)
            used[-1] = max(1, len(part) - (len(codes) - 1) * WINDOW)
            held.append(codes), owner.append(np.full(len(codes), i)), size.append(used)
            waiting += len(codes)
            if waiting >= 4096:
                flush()
    if held:
        flush()
    mean = total / np.maximum(weight, 1)[:, None]
    odds = np.exp(mean - mean.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def predict_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Id, ``held_out``, ``lang_pred`` and ``score`` of every row of ``df``."""
    network = train(df, id_col, text_col, lang_col)
    small = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"),
                      F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("__letter"))
    kind = small.schema["__id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            letters = batch.column(2).to_pylist()
            at = [i for i, letter in enumerate(letters) if letter and network is not None]
            names, scores = [UNKNOWN] * len(letters), [0.0] * len(letters)
            if at:
                odds = _predict(network, [batch.column(1)[i].as_py().encode() for i in at])
                for i, best, score in zip(at, odds.argmax(axis=1), odds.max(axis=1), strict=True):
                    names[i], scores[i] = network.classes[best], float(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["__id", "lang_pred", "score"])

    return small.mapInArrow(run, f"__id {kind}, lang_pred string, score double").select(
        F.col("__id").alias(id_col), (fold("__id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir):
    return predict_languages(table(spark, sf_dir, "documents"))
