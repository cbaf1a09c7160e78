"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizers cut the same bytes. Where a token of A and a token of B end at the same offset, both sequences can be cut:
these offsets part the text into groups, and the two tokens that end there are linked. Finding them is a merge of two
sorted lists of ends. The merge path is divided by diagonals: a binary search on each diagonal gives the place where the
merge crosses it, so that every piece does the same number of steps whatever the tokens look like and needs nothing from
the others but the last end of A before it. All pieces of a batch of texts advance in lockstep. Every piece emits the
ends it finds shared; a group that spans pieces is stitched from the shared ends on either side.

Spark counts the linked id pairs over all texts, finds the highest count of each id of B, and returns both to the texts:
pairs of high count meet by broadcast (their number is found from a histogram and bounded by ``MAX_FREQUENT``), all other
pairs by shuffle. Each text carries its distinct pairs with a multiplicity, so a pair repeats once per text at most.

The words that the pattern of A cuts a text into can also be encoded one by one by B when no piece of B reaches across their
borders, which its vocabulary shows. Each distinct word of such texts is encoded by both sides and compared with its bytes
once, as long as it is remembered. The merge runs over the whole texts all the same.

Defined cases: a null or empty text, or one that either tokenizer does not give back byte for byte, has no tokens, groups
or links, and an empty digest. Special tokens inside texts are plain text. Rows that repeat an id are separate texts and
each counts. A null id is kept. An empty table gives an empty result. Texts are encoded whole; other columns play no part.
"""

import hashlib
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import table
from plantpulse.session import checkpointed

# Steps of one piece of the merge, and bytes of text that are merged together. Words and token lists of these take many times
# as much memory.
PIECE, BATCH_BYTES = 1024, 1 << 20
# Bound of the pairs that a join may broadcast (about 40 MB).
MAX_FREQUENT = 400_000

# Distinct words a Python worker remembers before it starts anew.
MAX_KNOWN = 250_000
# Words that are encoded in a row.
IN_A_ROW = 4096
# The pattern of byte-level tokenizers, and characters whose classes no version of Unicode has changed.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WELL_KNOWN = re.compile("[\t\n\r -~\u00c0-\u017f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u2026]*")

# The same pattern for texts of well-known characters only, where it takes less than half the time.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5"
_WORD = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
# Spots where pieces of B may reach across words of A: runs of spaces, and letters after what looks like a short form.
_ACROSS = re.compile(r"  |\r|'(?:[stmd]|re|ve|ll)[^\W\d_]")

_loaded: dict[tuple, object] = {}


class Vocabulary:
    """Bytes of each token, as strings for comparison and as lengths for offsets."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.decimals = {sep: np.array([f"{i}{sep}".encode() for i in range(len(pieces))], dtype=object) for sep in ",|;"}

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def byte_letters() -> dict[str, int]:
    """Byte of each letter of byte-level vocabularies: printable Latin-1 characters stand for themselves, the other bytes
    for the characters from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level(path: str):
    """(encode, vocabulary) of a byte-level tokenizer file."""
    if ("a", path) not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer
        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        letters = byte_letters()
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        entries = {i: bytes(letters[c] for c in token) for token, i in described["model"]["vocab"].items()
                   if all(c in letters for c in token)}
        entries |= {x["id"]: x["content"].encode() for x in described.get("added_tokens", ()) if x["id"] not in entries}
        vocabulary = Vocabulary([entries.get(i, b"") for i in range(max(entries) + 1)])
        _loaded["a", path] = (_by_words(lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)], described), vocabulary)
    return _loaded["a", path]


def _by_words(encode, described: dict):
    """``encode`` for many texts that share words. The tokenizer cuts a text by a pattern and encodes each match alone;
    texts of well-known characters are cut here, and each distinct match is encoded once. All other texts, and all
    texts of a tokenizer that is set up in another way, go to the library whole."""
    cutter = described.get("pre_tokenizer") or {}
    if described.get("normalizer") or cutter.get("type") != "ByteLevel" or not cutter.get("use_regex") or cutter.get("add_prefix_space"):
        return encode
    known: dict[str, bytes] = {}  # ids as packed integers: a list of numbers takes several times the memory

    def cached(texts):
        cut = [_WORD.findall(t) if _WELL_KNOWN.fullmatch(t) else None for t in texts]
        new = {w for words in cut if words is not None for w in words} - known.keys()
        if len(known) + len(new) > MAX_KNOWN:
            known.clear()
            new = {w for words in cut if words is not None for w in words}
        new = list(new)
        known.update((w, array("I", ids).tobytes()) for w, ids in zip(new, encode(new), strict=True))
        others = iter(encode([t for t, words in zip(texts, cut, strict=True) if words is None]))
        return [next(others) if words is None else array("I", b"".join(map(known.__getitem__, words))).tolist() for words in cut]

    cached.known, cached.each = known, encode
    return cached


def pieces_of(path: str):
    """(encode, vocabulary) of a piece model file."""
    if ("b", path) not in _loaded:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)

        def content(i):
            piece = model.id_to_piece(i)
            return bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

        vocabulary = Vocabulary([content(i) for i in range(model.get_piece_size())])
        def encode(texts):
            return model.encode(texts, num_threads=1)

        encode.keeps_words = _keeps_words(model)
        _loaded["b", path] = (encode, vocabulary)
    return _loaded["b", path]


def _keeps_words(model) -> bool:
    """Whether a piece model encodes the words of ``BYTE_LEVEL_PATTERN`` independently in well-known texts without the spots
    of ``_ACROSS``: it merges pairs, changes no character, and no piece that can occur holds more than spaces and then
    letters, or numbers, or other marks."""
    try:
        from sentencepiece import sentencepiece_model_pb2 as described
    except (ImportError, TypeError):  # the description needs a package of its own
        return False
    import regex
    proto = described.ModelProto.FromString(model.serialized_model_proto())
    norm, trainer, kinds = proto.normalizer_spec, proto.trainer_spec, described.ModelProto.SentencePiece
    plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
    merges = trainer.model_type == described.TrainerSpec.BPE and trainer.byte_fallback and not trainer.treat_whitespace_as_suffix
    one_word = regex.compile(r" *(?:\p{L}*|\p{N}+|[^\s\p{L}\p{N}]+)")
    pieces = [p.piece.replace("▁", " ") for p in proto.pieces if p.type == kinds.NORMAL]
    return bool(plain and merges and not any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces) and all(
        one_word.fullmatch(p) for p in pieces if "\r" not in p and _WELL_KNOWN.fullmatch(p)))


def _spread(ids: list[int], vocabulary: Vocabulary, data: bytes, ends: np.ndarray) -> list[bytes] | None:
    """Packed ids of each of the words that end at ``ends``; None when the tokens do not spell the words."""
    if vocabulary.joined(ids) != data:
        return None
    ids = np.array(ids, dtype=np.uintc)
    after = np.cumsum(vocabulary.sizes[ids])
    last = np.searchsorted(after, ends)
    if (after[last] != ends).any():
        return None
    packed, cuts = ids.tobytes(), ((last + 1) * ids.itemsize).tolist()
    return [packed[lo:hi] for lo, hi in zip([0, *cuts], cuts)]


class Words:
    """Ids of both sides for texts that share words."""

    def __init__(self, encode_a, a: Vocabulary, encode_b, b: Vocabulary):
        self.sides = (encode_a, a), (encode_b, b)
        self.shared = hasattr(encode_a, "each") and getattr(encode_b, "keeps_words", False)
        self.ids_a: dict[str, bytes] = {}  # packed integers, as in ``_by_words``
        self.ids_b: dict[str, bytes] = {}
        self.changed: set[str] = set()  # words that a side does not give back byte for byte

    def learn(self, words: list[str]):
        """Words that begin with a space and hold other characters are encoded in a row, as they may follow each other."""
        (encode_a, a), (encode_b, b) = self.sides
        row = [w for w in words if w[0] == " " and not w[-1].isspace()]
        for first in range(0, len(row), IN_A_ROW):
            part = row[first:first + IN_A_ROW]
            text = "".join(part)
            data, ends = text.encode(), np.cumsum([len(w.encode()) for w in part])
            ids_a, ids_b = _spread(encode_a.each([text])[0], a, data, ends), _spread(encode_b([text[1:]])[0], b, data, ends)
            if ids_a and ids_b:
                self.ids_a.update(zip(part, ids_a, strict=True))
                self.ids_b.update(zip(part, ids_b, strict=True))
        self.learn_each([w for w in words if w not in self.ids_a])

    def learn_each(self, words: list[str]):
        """A line feed before each word takes the space that B puts before a text; no piece holds both it and a letter."""
        (encode_a, a), (encode_b, b) = self.sides
        lead = len(encode_b(["\n"])[0])
        for word, ids_a, ids_b in zip(words, encode_a.each(words), encode_b(["\n" + w for w in words]), strict=True):
            ids_b = ids_b[lead:]
            self.ids_a[word], self.ids_b[word] = array("I", ids_a).tobytes(), array("I", ids_b).tobytes()
            if not a.joined(ids_a) == b.joined(ids_b) == word.encode():
                self.changed.add(word)

    def cut(self, texts: list[str]):
        """Words of each text, with a space before it; None for texts that must be encoded whole."""
        if not self.shared:
            return [None] * len(texts)
        cut = [_WORD.findall(" " + t) if _WELL_KNOWN.fullmatch(t) and not _ACROSS.search(" " + t) else None for t in texts]
        wanted = set().union(*(words for words in cut if words is not None))
        new = wanted - self.ids_a.keys()
        if len(self.ids_a) + len(new) > MAX_KNOWN:
            self.ids_a, self.ids_b, self.changed, new = {}, {}, set(), wanted
        self.learn(list(new))
        return [None if words is None or not self.changed.isdisjoint(words) else words for words in cut]

    def coded(self, texts: list[str]):
        """(ids of A, ids of B) of each text, or None when a side does not spell it."""
        (encode_a, a), (encode_b, b) = self.sides
        cut = self.cut(texts)
        others = [t for t, words in zip(texts, cut, strict=True) if words is None]
        whole = zip(others, encode_a([" " + t for t in others]), encode_b(others), strict=True)
        out = []
        for words in cut:
            if words is None:
                text, ids_a, ids_b = next(whole)
                same = a.joined(ids_a) == b.joined(ids_b) == b" " + text.encode()
                out.append((np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)) if same else None)
            else:
                out.append(tuple(np.frombuffer(b"".join(map(ids.__getitem__, words)), dtype=np.uintc).astype(np.int64) for ids in (self.ids_a, self.ids_b)))
        return out


def words_of(path_a: str, path_b: str) -> Words:
    """Remembered words of two tokenizer files, one memory per Python worker."""
    if ("words", path_a, path_b) not in _loaded:
        _loaded["words", path_a, path_b] = Words(*byte_level(path_a), *pieces_of(path_b))
    return _loaded["words", path_a, path_b]


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many elements of ``a`` are among the first ``d`` of the merge of ``a`` and ``b``, for each diagonal ``d``. On
    equal values ``a`` goes first."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ones := low < high).any():
        middle = (low + high) // 2
        first = open_ones & (a[np.minimum(middle, len(a) - 1)] <= b[np.clip(diagonals - 1 - middle, 0, len(b) - 1)])
        low = np.where(first, middle + 1, low)
        high = np.where(open_ones & ~first, middle, high)
    return low


def shared_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with a[i] == b[j] of two strictly increasing lists, in order."""
    if not len(a) or not len(b):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    total = len(a) + len(b)
    starts = np.arange(0, total, piece)
    i = crossings(a, b, starts)
    j = starts - i
    stop = np.minimum(starts + piece, total)
    beyond = max(a[-1], b[-1]) + 1
    a, b = np.append(a, beyond), np.append(b, beyond)
    found = np.full((len(starts), piece), -1, dtype=np.int64)
    for step in range(min(piece, total)):
        going = i + j < stop
        from_b = going & (b[j] < a[i])
        # The last end of A that was merged may stand in the piece before.
        found[:, step] = np.where(from_b & (i > 0) & (a[i - 1] == b[j]), j, -1)
        i, j = i + (going & ~from_b), j + from_b
    second = found[found >= 0]
    return np.searchsorted(a, b[second]), second


def aligned_batch(texts: list[str | None], encode_a, a: Vocabulary, encode_b, b: Vocabulary, piece: int = PIECE, known: Words | None = None):
    """For each text (n_a, n_b, n_groups, digest, id pairs, multiplicities); id pairs are a * 2**32 + b."""
    known = known or Words(encode_a, a, encode_b, b)
    out = [(0, 0, 0, "", [], [])] * len(texts)
    given = [k for k, text in enumerate(texts) if text]
    coded = [(k, *ids) for k, ids in zip(given, known.coded([texts[k] for k in given]), strict=True) if ids is not None]
    if not coded:
        return out
    places, all_a, all_b = zip(*coded, strict=True)
    cuts_a, cuts_b = np.cumsum([0, *map(len, all_a)]), np.cumsum([0, *map(len, all_b)])
    ids_a, ids_b = np.concatenate(all_a), np.concatenate(all_b)
    # Both sequences spell the same bytes, so running totals over the batch keep the texts apart.
    i, j = shared_ends(np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b]), piece)

    last_a, last_b = np.zeros(len(ids_a), dtype=bool), np.zeros(len(ids_b), dtype=bool)
    last_a[i], last_b[j] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    printed = np.empty(len(ids_a) + len(ids_b), dtype=object)
    printed[np.arange(len(ids_a)) + np.append(0, j + 1)[group_a]] = np.where(last_a, a.decimals["|"][ids_a], a.decimals[","][ids_a])
    printed[np.arange(len(ids_b)) + i[group_b] + 1] = np.where(last_b, b.decimals[";"][ids_b], b.decimals[","][ids_b])

    text_of = np.searchsorted(cuts_a, i, side="right") - 1
    size_b = len(b.pieces)
    keys, times = np.unique((text_of * len(a.pieces) + ids_a[i]) * size_b + ids_b[j], return_counts=True)
    owner, pair = np.divmod(keys, len(a.pieces) * size_b)
    pair = ((pair // size_b) << 32) | (pair % size_b)
    cuts, links = np.searchsorted(owner, np.arange(len(places) + 1)), np.bincount(text_of, minlength=len(places))
    for n, k in enumerate(places):
        line = b"".join(printed[cuts_a[n] + cuts_b[n]: cuts_a[n + 1] + cuts_b[n + 1]].tolist())[:-1]
        part = slice(cuts[n], cuts[n + 1])
        out[k] = (len(all_a[n]), len(all_b[n]), int(links[n]), hashlib.sha256(line).hexdigest(), pair[part], times[part])
    return out


def aligned(df: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``df``: ``row``, ``id``, token and group counts, digest, and its distinct linked id pairs."""
    id_kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        encode_a, a = byte_level(path_a)
        encode_b, b = pieces_of(path_b)
        known = words_of(path_a, path_b)
        for batch in batches:
            start, held = 0, 0
            sizes = batch.column(2).to_pylist()
            for n, size in enumerate(sizes):
                held += size or 0
                if held >= BATCH_BYTES or n == len(sizes) - 1:
                    part = batch.slice(start, n + 1 - start)
                    start, held = n + 1, 0
                    rows = aligned_batch(part.column(3).to_pylist(), encode_a, a, encode_b, b, known=known)
                    counts = [pa.array([r[c] for r in rows], pa.int64()) for c in range(3)]
                    offsets = pa.array(np.cumsum([0, *(len(r[4]) for r in rows)]), pa.int32())
                    flat = [np.concatenate([np.asarray(r[c], dtype=np.int64) for r in rows]) for c in (4, 5)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), *counts, pa.array([r[3] for r in rows], pa.string()),
                         *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in flat]],
                        names=["row", "id", "n_a", "n_b", "n_groups", "digest", "pairs", "times"])

    return df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.octet_length(text_col).alias("size"),
                     F.col(text_col).alias("text")).mapInArrow(
        run, f"row long, id {id_kind}, n_a long, n_b long, n_groups long, digest string, pairs array<long>, times array<long>")


def frequent(counted: DataFrame, most: int = MAX_FREQUENT) -> DataFrame:
    """Pairs above a count that at most ``most`` pairs reach, found from a histogram of counts (a few hundred classes)."""
    level = F.floor(F.log2("count") * 8).cast("int")
    pairs, least = 0, None
    for row in sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).collect(), reverse=True):
        pairs += row.pairs
        if pairs > most:
            break
        least = row.level
    return counted.filter(level >= least) if least is not None else counted.limit(0)


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_FREQUENT) -> DataFrame:
    """One row per row of ``df``: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``."""
    texts = checkpointed(aligned(df, path_a, path_b, id_col, text_col))
    links = texts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    counted = links.groupBy("pairs").agg(F.sum("times").alias("count"))
    counted = checkpointed(counted.withColumn("b", F.col("pairs").bitwiseAND(0xFFFFFFFF)))
    highest = counted.groupBy("b").agg(F.max("count").alias("highest"))
    ranked = checkpointed(counted.join(highest, "b").select("pairs", "count", (F.col("count") == F.col("highest")).cast("long").alias("best")))
    common = frequent(ranked, most)
    names = F.broadcast(common.select("pairs"))

    def summed(met):
        return met.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))

    met = summed(links.join(F.broadcast(common), "pairs")).unionByName(
        summed(links.join(names, "pairs", "left_anti").join(ranked.join(names, "pairs", "left_anti"), "pairs")))
    per_text = met.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = F.lit(0).cast("long")
    return texts.drop("pairs", "times").join(per_text, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), F.col("digest").alias("groups_sha256"))


def query(spark, sf_dir):
    import public_tokenizers
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
