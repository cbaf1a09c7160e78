"""Toxicity of texts written plainly or in disguise: a noisy channel restores the words, a linear model scores them.

A character trigram model is counted over all texts. A word with digits or symbols among its letters or in place of all
of them, a word with repeated letters, and a run of short tokens become a lattice: each character may stand for itself,
for the letters it resembles, or for nothing, and each blank between short tokens may stay or go at a price. Viterbi
decoding under the language model picks the cheapest reading. A word with a doubled letter counts as written too, a
token of lookalikes only also letter by letter, and a run of three or more single characters also as one word.
Restored words and their first 3 to 7 characters are the features. Those that are clearly associated with the label (likelihood ratio
test) enter a logistic regression on presence in the text, so that long texts gather no noise from unrelated words.

Learning uses a bounded hash sample of labelled rows of the training folds. Words already seen by a task are kept in a
table of bounded size.

Defined cases: a null or empty text has no features and gets the base score. Rows that repeat an id are scored each.
Without labelled training rows the score is 0.5; with one class only, the smoothed share of that class. Of several labels of one
id the largest counts; null labels are ignored. Words are decoded if they hold digits, symbols or repeated letters; plain
ones stay. A blank or a doubled letter whose choice depends on nothing but the letters beside it is decided from them. Texts are split in chunks of about 1 MB at blanks; a run of short
tokens is read within a chunk. An empty table gives an empty result. Other columns play no part.
"""

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import chunks, fold, hash_sample, table, with_ids
from plantpulse.session import checkpointed

# Bounds: labelled rows to learn from, features in the model, words that a task keeps.
MAX_TRAIN_ROWS, MAX_FEATURES, KEPT_WORDS = 20_000, 3_000, 500_000
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
# Smallest likelihood ratio statistic and smallest number of texts of a feature.
MIN_ASSOCIATION, MIN_TEXTS = 10.0, 3

# Letters that a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
LETTER_COST, DROP_COST, REPEAT_COST = 1.0, 6.0, 1.5
# Length of tokens that may be parts of a word. Price of a blank that stays and of one that goes, between single
# characters (where words are spaced out) and beside longer parts.
SHORT, SPACED, APART = 3, (2.0, 0.0), (0.0, 2.0)
SYMBOLS = 28  # 0 boundary, 1-26 letters, 27 any other letter

_CODES = np.zeros(256, dtype=np.int32)
_CODES[97:123] = _CODES[65:91] = np.arange(1, 27)
_CODES[128:] = 27
_ENDS = ".,;:!?#%&*$\"')]}>|~^=_-"
_STARTS = ".,;:?#%&*\"'([{<>~^=_-"
_DOUBLE, _TRIPLE = re.compile(r"([a-z])\1"), re.compile(r"([a-z])\1\1")


def _code(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27


def trigram_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(cell, count) over all texts; cell is the trigram as a number."""
    def run(batches):
        total, held, waiting = np.zeros(SYMBOLS**3, dtype=np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                for part in chunks((text.as_py() or "").encode()):
                    codes = _CODES[np.frombuffer(part, dtype=np.uint8)]
                    codes = np.concatenate([[0, 0], codes[(codes > 0) | np.append(codes[1:] > 0, True)], [0]])
                    held.append((codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:])
                    waiting += len(codes)
                    if waiting > 1_000_000:
                        total += np.bincount(np.concatenate(held), minlength=SYMBOLS**3)
                        held, waiting = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=SYMBOLS**3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["cell", "count"])

    return df.select(text_col).mapInArrow(run, "cell int, count long").groupBy("cell").agg(F.sum("count").alias("count"))


def language_model(counts) -> np.ndarray:
    """Costs (negative log probabilities) of a symbol after two others, backing off to bigrams and single symbols."""
    cube = np.zeros(SYMBOLS**3)
    for cell, count in counts:
        cube[cell] = count
    cube = cube.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    single = (cube.sum((0, 1)) + 1) / (cube.sum() + SYMBOLS)
    pairs = cube.sum(0)
    double = (pairs + 5 * single) / (pairs.sum(1, keepdims=True) + 5)
    return -np.log((cube + 5 * double[None]) / (cube.sum(2, keepdims=True) + 5))


class Restorer:
    """Viterbi decoding of disguised words."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.blanks: dict[tuple[str, str], bool] = {}  # by the two letters on either side: bounded by the letters there are

    @staticmethod
    def _readings(word: str, i: int):
        c = word[i]
        if "a" <= c <= "z":
            return [(c, 0.0), ("", REPEAT_COST)] if i and word[i - 1] == c else [(c, 0.0)]
        if c == " ":
            single = word[max(0, i - 2):i - 1] in ("", " ") and word[i + 2:i + 3] in ("", " ")
            stay, go = SPACED if single else APART
            return [(c, stay), ("", go)]
        if c.isalpha():
            return [(c, 0.0)]
        return [(x, LETTER_COST) for x in LOOKALIKES.get(c, "")] + [("", DROP_COST if c in LOOKALIKES else 0.5)]

    def decode(self, word: str) -> str:
        states = {(0, 0): (0.0, None)}
        for i in range(len(word)):
            new: dict = {}
            readings = self._readings(word, i)
            for (a, b), (cost, trail) in states.items():
                row = self.costs[a][b]
                for letter, price in readings:
                    if letter == " " and not b:
                        key, total, path = (a, b), cost + price, trail
                    elif letter:
                        code = 0 if letter == " " else ord(letter) - 96 if "a" <= letter <= "z" else 27
                        key, total, path = (b, code), cost + price + row[code], (trail, letter)
                    else:
                        key, total, path = (a, b), cost + price, trail
                    if key not in new or total < new[key][0]:
                        new[key] = (total, path)
            states = new
        _, trail = min(((cost + (self.costs[a][b][0] if b else 0.0), trail) for (a, b), (cost, trail) in states.items()), key=lambda s: s[0])
        letters = []
        while trail:
            trail, letter = trail
            letters.append(letter)
        return "".join(reversed(letters))

    def single(self, word: str) -> str:
        """``decode`` of letters only. A doubled letter is kept or dropped; whichever is cheaper follows from the letters
        around it, as the two readings agree in all that comes later. Longer repeats take the lattice."""
        if _TRIPLE.search(word):
            return self.decode(word)
        out, start = [], 0
        for found in _DOUBLE.finditer(word):
            i = found.start()
            before, letter, after = _code(word[i - 1]) if i else 0, _code(word[i]), _code(word[i + 2]) if i + 2 < len(word) else 0
            if self.costs[before][letter][letter] + self.costs[letter][letter][after] > self.costs[before][letter][after] + REPEAT_COST:
                out.append(word[start:i + 1])
                start = i + 2
        return "".join(out) + word[start:]

    def parted(self, parts: list[str]) -> list[str]:
        """``decode`` of parts between blanks, as words. Between parts of letters, of which only the outer ones may be single
        characters, each blank is decided alone: what stays and what goes differs in the letters next to it only."""
        if len(parts) < 2 or min(map(len, parts[1:-1]), default=2) < 2 or not all(map(str.isalpha, parts)) or any(map(_DOUBLE.search, parts)):
            return self.decode(" ".join(parts)).split(" ")
        words = [parts[0]]
        for k in range(1, len(parts)):
            left, right = parts[k - 1], parts[k]
            key = (left[-2:], right[:2])
            stays = self.blanks.get(key)
            if stays is None:
                a, b = _code(left[-2]) if len(left) > 1 else 0, _code(left[-1])
                c, d = _code(right[0]), _code(right[1]) if len(right) > 1 else 0
                stay, go = SPACED if len(left) == len(right) == 1 else APART
                cost = self.costs
                stays = self.blanks[key] = (stay + cost[a][b][0] + cost[b][0][c] + cost[0][c][d] <= go + cost[a][b][c] + cost[b][c][d])
            if stays:
                words.append(right)
            else:
                words[-1] += right
        return words

    def restore(self, word: str) -> str:
        """A lower-case token without blanks as the word it stands for; empty if it has no letter and is not made of lookalikes."""
        core = _core(word)
        if core.isalpha():
            return self.single(core) if _DOUBLE.search(core) else core
        return self.decode(core) if any(map(str.isalpha, core)) or _disguised(core) else ""

    def words(self, token: str) -> set[str]:
        """Words that a token or a run of short tokens stands for."""
        if " " in token:
            parts = token.split(" ")
            last = len(parts) - 1
            cores = [_core(part) or (part if part in LOOKALIKES and i < last else "") for i, part in enumerate(parts)]
            return {word for word in self.parted(list(filter(None, cores))) if word}
        core = _core(token)
        if core.isalpha():
            return {core, self.single(core)} if _DOUBLE.search(core) else {core}
        found = {self.restore(token)}
        if _disguised(core):
            found.add("".join(LOOKALIKES[c][0] for c in core))
        return found


def _disguised(word: str) -> bool:
    return len(word) > 1 and all(c in LOOKALIKES for c in word)


def _core(word: str) -> str:
    """A token without the punctuation around it. Of tokens without a letter only what cannot be one goes, and ``!`` at the end."""
    if word.isalpha():
        return word
    inner = word.strip(_STARTS).rstrip(_ENDS)
    if inner.isalpha():
        return inner
    if not any(map(str.isalpha, word)):
        bare = word.strip("".join(c for c in _STARTS + _ENDS if c not in LOOKALIKES))
        bare = bare.rstrip("!") if len(bare.rstrip("!")) > 1 else bare
        if _disguised(bare):
            return bare
    return inner


def _tokens(text: str | None):
    """Distinct tokens of a text, and its runs of short tokens with blanks between them; runs of three or more single characters also joined."""
    out: set[str] = set()
    for part in chunks((text or "").lower().encode()):
        words = part.decode(errors="ignore").split()
        out.update(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for longest, least, blank in ((SHORT, 2, " "), (1, 3, "")):
            edges = np.flatnonzero(np.diff((sizes <= longest).view(np.int8), prepend=0, append=0)).tolist()
            out.update(blank.join(words[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least)
        # The first of many single characters may be a word of its own: they are read without it too.
        out.update(" ".join(words[a + 1:b]) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= 4)
    return out


def _features(words) -> set[str]:
    """Restored words, marked, and their beginnings."""
    return {key for word in words if word for key in ("=" + word, *(word[:k] for k in range(3, min(8, len(word)))))}


class Kept(dict):
    """Remembers the value of a function for a bounded number of tokens."""

    def __init__(self, function, limit=KEPT_WORDS):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, token):
        if len(self) >= self.limit:
            self.clear()
        value = self[token] = self.function(token)
        return value

    def all(self, tokens) -> set:
        return set(chain.from_iterable(map(self.__getitem__, tokens)))


class LinearModel:
    """Logistic regression on the presence of chosen features."""

    def __init__(self, features=(), weights=None, bias=0.0):
        self.place = {f: i for i, f in enumerate(features)}
        self.heads = {f.removeprefix("=")[:3] for f in features}  # most words begin like no feature
        self.weights = np.zeros(len(self.place)) if weights is None else weights
        self.bias = bias

    def fit(self, rows: list[list[int]], y: np.ndarray, steps=400, rate=0.3, penalty=0.3) -> "LinearModel":
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        self.bias = float(np.log(share / (1 - share))) if len(y) else 0.0
        if not len(y) or not self.place:
            return self
        doc = np.repeat(np.arange(len(rows)), list(map(len, rows)))
        col = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows])
        theta = np.append(self.weights, self.bias)
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            z = np.bincount(doc, theta[col], len(rows)) + theta[-1]
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            g = np.append(np.bincount(col, error[doc], len(self.weights)) + penalty * theta[:-1], error.sum()) / len(y)
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            theta -= rate * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        self.weights, self.bias = theta[:-1], float(theta[-1])
        return self

    def places(self, words) -> tuple[int, ...]:
        """Places of the features that the words have."""
        near = [w for w in words if w[:3] in self.heads]
        return tuple(self.place[f] for f in _features(near) & self.place.keys()) if near else ()

    def score(self, places) -> float:
        z = self.bias + float(self.weights[sorted(places)].sum()) if places else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def _train(df: DataFrame, labels: DataFrame, restorer: Restorer, id_col, text_col, label_col, label_id, limit) -> LinearModel:
    known = checkpointed(labels.filter(F.col(label_col).isNotNull() & (fold(label_id, FOLDS) != HELD_OUT)).groupBy(
        F.col(label_id).alias("__id")).agg(F.max(label_col).cast("int").alias("__y")))
    sample = checkpointed(hash_sample(known, "__id", limit, known.count()))
    docs = with_ids(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), sample.select("__id"), "__id")
    docs = docs.join(F.broadcast(sample), "__id").select("__id", "__text", "__y")

    def count(batches):
        known = Kept(lambda token: _features(restorer.words(token)))
        for batch in batches:
            both, ones = Counter(), Counter()
            for text, y in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = known.all(_tokens(text.as_py()))
                both.update(found)
                ones.update(found if y else ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(both), pa.string()), pa.array([ones[f] for f in both], pa.int64()), pa.array(list(both.values()), pa.int64())],
                names=["feature", "ones", "both"])

    sides = sample.groupBy("__y").count().collect()  # two rows
    n1 = float(sum(r["count"] for r in sides if r["__y"]))
    n = float(sum(r["count"] for r in sides))
    term = lambda seen, expected: F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)
    k, a = F.col("both"), F.col("ones")
    chosen = []
    if 0 < n1 < n:
        statistic = (term(a, k * n1 / n) + term(k - a, k * (n - n1) / n)
                     + term(n1 - a, (n - k) * n1 / n) + term(n - n1 - k + a, (n - k) * (n - n1) / n))
        counted = docs.mapInArrow(count, "feature string, ones long, both long").groupBy("feature").agg(
            F.sum("ones").alias("ones"), F.sum("both").alias("both"))
        best = counted.filter((k >= MIN_TEXTS) & (k < n)).withColumn("g", statistic).filter(F.col("g") >= MIN_ASSOCIATION)
        chosen = [r.feature for r in best.orderBy(F.desc("g"), "feature").limit(MAX_FEATURES).collect()]
    model = LinearModel(sorted(chosen))

    def present(batches):
        known = Kept(lambda token: model.places(restorer.words(token)))
        for batch in batches:
            rows = [sorted(known.all(_tokens(t.as_py()))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.int32()))], names=["__id", "__y", "__p"])

    kind = docs.schema["__id"].dataType.simpleString()
    rows = docs.mapInArrow(present, f"__id {kind}, __y int, __p array<int>").toPandas().sort_values("__id", kind="stable")
    return model.fit(list(rows["__p"]), rows["__y"].to_numpy(dtype=float))


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   label_id: str = "doc_id", threshold: float = THRESHOLD, limit: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Id, ``held_out``, ``score`` and ``predicted`` of every row of ``df``."""
    restorer = Restorer(language_model([(r["cell"], r["count"]) for r in trigram_counts(df, text_col).collect()]))
    model = _train(df, labels, restorer, id_col, text_col, label_col, label_id, limit)
    small = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))

    def run(batches):
        known = Kept(lambda token: model.places(restorer.words(token)))
        for batch in batches:
            scores = [model.score(known.all(_tokens(t.as_py()))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["__id", "score"])

    kind = small.schema["__id"].dataType.simpleString()
    return small.mapInArrow(run, f"__id {kind}, score double").select(
        F.col("__id").alias(id_col), (fold("__id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
