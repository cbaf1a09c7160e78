import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from plantpulse.llm import alignment as A

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(text):
    """Token bytes of both sides from the libraries' own vocabularies, or None when they do not spell the text."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    letters = {}
    for byte in range(256):  # the letter of a byte: what the file's own vocabulary decodes to it
        letters[byte] = None
    printable = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    spare = 0
    for byte in range(256):
        if byte in printable:
            letters[byte] = chr(byte)
        else:
            letters[byte] = chr(256 + spare)
            spare += 1
    back = {c: b for b, c in letters.items()}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    assert decoders.ByteLevel().decode([a.id_to_token(i) for i in ids_a]) == " " + text
    if b"".join(bytes_b) != (" " + text).encode():
        return None
    return list(zip(ids_a, bytes_a, strict=True)), list(zip(ids_b, bytes_b, strict=True))


def brute(rows):
    per_row, counts = [], Counter()
    for doc, text in rows:
        sides = tokens(text) if text else None
        if not sides:
            per_row.append((doc, 0, 0, 0, [], ""))
            continue
        ends = []
        for side in sides:
            at, seen = 0, []
            for _, data in side:
                at += len(data)
                seen.append(at)
            ends.append(seen)
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, links, lo = [], [], 0
        for hi in both:
            group = [",".join(str(i) for (i, _), e in zip(side, seen, strict=True) if lo < e <= hi) for side, seen in zip(sides, ends, strict=True)]
            groups.append("|".join(group))
            links += [(x, y) for (x, _), e in zip(sides[0], ends[0], strict=True) if e == hi for (y, _), f in zip(sides[1], ends[1], strict=True) if f == hi]
            lo = hi
        counts.update(links)
        per_row.append((doc, len(sides[0]), len(sides[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return sorted(str((doc, n_a, n_b, n_groups, len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), digest))
                  for doc, n_a, n_b, n_groups, links, digest in per_row)


def result(df, **more):
    return sorted(str(tuple(r)) for r in A.align(df, PATH_A, PATH_B, **more).collect())


@pytest.mark.parametrize("most", [A.MAX_FREQUENT, 20, 0])
def test_equals_brute_force(docs, spark, sf, most):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    odd = [(900, None), (901, ""), (902, " "), (903, "a  b\n\tc <|endoftext|> </s> <0x41> 漢字🙂 "), (904, "one ▁ mark"), (904, "one two"),
           (None, "one two"), (905, "x" * 3000), (906, "\x00 nul"), (907, "   lead and trail   ")]
    rows = [(doc, text[:4000] if text else text) for doc, text in given + odd]
    assert result(docs(rows), most=most) == brute(rows)


def test_empty(docs):
    assert A.align(docs([]), PATH_A, PATH_B).count() == 0


@pytest.mark.parametrize("piece", [1, 2, 7, 64, 5000])
def test_pieces_find_all_shared_ends(piece):
    rng = np.random.default_rng(piece)
    for n, m in ((1, 1), (3, 50), (400, 380), (1000, 10)):
        a = np.sort(rng.choice(2000, n, replace=False)) + 1
        b = np.sort(rng.choice(2000, m, replace=False)) + 1
        i, j = A.shared_ends(a, b, piece)
        assert (a[i] == b[j]).all() and (a[i] == np.intersect1d(a, b)).all()


def test_diagonals_cut_equal_work():
    a, b = np.arange(0, 1000, 2), np.arange(0, 1000, 3)
    merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
    for d, i in zip(range(0, 800, 100), A.crossings(a, b, np.arange(0, 800, 100)), strict=True):
        assert i == sum(side == 0 for _, side in merged[:d])


def test_piece_size_changes_nothing(monkeypatch):
    encode_a, a = A.byte_level(PATH_A)
    encode_b, b = A.pieces_of(PATH_B)
    texts = ["The quick brown fox, über 12345 漢字 " * 40, None, "", "short", "a" * 500]
    views = [[(*r[:4], list(r[4]), list(r[5])) for r in A.aligned_batch(texts, encode_a, a, encode_b, b, piece)] for piece in (3, 100, 10**5)]
    assert views[0] == views[1] == views[2]


def test_words_encode_as_whole_texts():
    """Cutting a text and encoding each match alone gives what the library gives for the whole text."""
    import random

    from tokenizers import Tokenizer
    model = Tokenizer.from_file(PATH_A)
    model.encode_special_tokens = True
    rng = random.Random(1)
    parts = ["'s", "'ll", "'", "don't", "été", "ñandú", "¿", "漢字", "かな", "カナ", "12", "½", "\t", "\n", " ", "  ", "   \n", "!?", "x" * 50, "<|endoftext|>",
             "“q”", "—", "\u00a0", "\u2028", "\x1c", "🙂", "a\u0301", "×", "÷", "THE", "the", "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(600)]
    encode, _ = A.byte_level(PATH_A)
    assert encode(texts) == [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode(texts) == encode(texts)


def test_remembered_words_stay_few_and_small(monkeypatch):
    monkeypatch.setattr(A, "MAX_KNOWN", 50)
    A._loaded.pop(("a", PATH_A), None)
    encode, _ = A.byte_level(PATH_A)
    for part in range(20):
        texts = [" ".join(f"word{chr(97 + part)}{chr(97 + k)}" for k in range(20))] * 2
        first = encode(texts)
        assert len(encode.known) <= 50 and all(isinstance(ids, bytes) for ids in encode.known.values())
        assert encode(texts) == first
    A._loaded.pop(("a", PATH_A), None)


def encoded_whole(texts):
    """Ids of both sides, each text given whole to the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    a.encode_special_tokens = True
    return [(a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) for t in texts]


def random_texts(parts, seed, n=800):
    import random
    rng = random.Random(seed)
    return ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(n)]


PARTS = ["'s", "'ll", "'", "don't", "été", "ñandú", "¿", "漢字", "かな", "カナ", "12", "½", "\t", "\n", " ", " ", " ", " a", " of", "the", "  ", "   \n", "!?", "_",
         "x" * 50, "<|endoftext|>", "“q”", "—", "×", "THE", "the", "\r\n", ");", "\r", "▁", "🙂", "</s>", "<0x0A>", ".", ",", " (", "erlyantion"]


def test_words_of_a_serve_both_sides():
    """Words that are remembered for both sides give what the libraries give for whole texts, odd spots included."""
    known = A.Words(*A.byte_level(PATH_A), *A.pieces_of(PATH_B))
    assert known.shared
    texts = random_texts(PARTS, 3) + random_texts([" ", "a", "'s", "the", "\n", "12", "ing", "é"], 4) + [" ", "\n", " \n", "a ", "'treet", "it'street"]
    for part in (texts, texts[::-1]):
        for text, ids, (ids_a, ids_b) in zip(part, known.coded(part), encoded_whole(part), strict=True):
            if ids is not None or "▁" not in text:
                assert [list(x) for x in ids] == [ids_a, ids_b]
    assert len(known.ids_a) > 100


def test_each_word_meets_both_tokenizers_once(monkeypatch):
    calls = []
    (encode_a, a), (encode_b, b) = A.byte_level(PATH_A), A.pieces_of(PATH_B)

    def counting(texts):
        calls.extend(texts)
        return encode_b(texts)

    counting.keeps_words = encode_b.keeps_words
    known = A.Words(encode_a, a, counting, b)
    text = "one two three " * 500 + "end"
    first = A.aligned_batch([text, text], encode_a, a, counting, b, known=known)
    assert sum(map(len, calls)) < 100
    again = A.aligned_batch([text], encode_a, a, counting, b, known=known)
    assert sum(map(len, calls)) < 100 and again[0][:4] == first[0][:4] == first[1][:4]
    monkeypatch.setattr(A, "MAX_KNOWN", 5)
    known.coded(["some quite other words here"])
    assert len(known.ids_a) == len(known.ids_b) == 5


def test_the_pattern_of_well_known_texts():
    import regex
    pattern = regex.compile(A.BYTE_LEVEL_PATTERN)
    for text in filter(A._WELL_KNOWN.fullmatch, random_texts(PARTS, 5)):
        assert A._WORD.findall(text) == pattern.findall(text)
    for code in range(0x10000):
        if A._WELL_KNOWN.fullmatch(chr(code)):
            assert A._WORD.findall(f" {chr(code)}a{chr(code)}1") == pattern.findall(f" {chr(code)}a{chr(code)}1")
