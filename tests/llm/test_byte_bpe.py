import hashlib
import struct

import pytest

from plantpulse.llm import byte_bpe as B
from plantpulse.llm.common import table

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return B.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))


def expected(rows, ranks):
    coder = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for doc, text in rows:
        ids = coder.encode_ordinary(text or "")
        out.append((doc, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(map(str, out))


def test_equals_the_library(spark, sf, docs, ranks):
    given = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    strange = [
        "I'll we've it's 'tis  DON'T", "tabs\t\tand\n\n\nlines   \r\n end  ", "a b  c　\u0085d", "漢字かな交じり文 🙂🙃👩‍👩‍👧", "1234567890 ½ ² ٣٤",
        "<|endoftext|> plain", "x" * 700, "ab" * 400, " " * 300, "!?" * 200, "é" * 50, "\x00\x01\x1c\x1d", "Ǆ ﬁ ß ſ", "à́b", None, "", " ", "\n"]
    rows = given + [(10_000 + i, t) for i, t in enumerate(strange)] + [given[0], (None, "null id")]
    out = B.token_digests(docs(rows), ranks, tokenizers.PATTERN)
    assert sorted(str(tuple(r)) for r in out.collect()) == expected(rows, ranks)


def test_rare_words_are_folded_in_place(docs, ranks):
    rows = [(1, "common common common rarely seen wordsmithery"), (2, "common unseenish")]
    out = B.token_digests(docs(rows), ranks, tokenizers.PATTERN, max_words=1)
    assert sorted(str(tuple(r)) for r in out.collect()) == expected(rows, ranks)


def test_ids_and_bytes_of_a_column(docs, ranks):
    rows = [(1, "wordsmithery of\nodd spellings, 漢字"), (2, "")]
    codec = B.Codec(docs(rows).sparkSession, ranks, tokenizers.PATTERN)
    ids = docs(rows).select("doc_id", B.F.flatten(B.F.transform(codec.words(B.F.col("text")), codec.merged)).alias("ids"))
    coder = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: r.ids for r in ids.collect()} == {d: coder.encode_ordinary(t) for d, t in rows}
    back = ids.select(codec.decode(ids["ids"]).cast("string").alias("text"), codec.packed(ids["ids"]).alias("packed"))
    assert {r.text for r in back.collect()} == {t for _, t in rows}


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 300_000])
def test_concatenation_keeps_order(spark, n):
    row = spark.range(1).select(B.F.transform(B.F.sequence(B.F.lit(0), B.F.lit(n)), lambda k: k.cast("string").cast("binary")).alias("x"))
    row = row.select(B.F.slice("x", 1, n).alias("x"))
    assert bytes(row.select(B.concatenated(B.F.col("x")).alias("y")).first().y) == "".join(map(str, range(n))).encode()


def test_empty(docs, ranks):
    assert B.token_digests(docs([]), ranks, tokenizers.PATTERN).count() == 0


def test_frequent_words_are_kept_without_a_copy_of_their_bytes(docs, ranks, monkeypatch):
    kept, build = [], B.lookup_table
    monkeypatch.setattr(B, "lookup_table", lambda entries, *more: kept.append(entries.dtypes) or build(entries, *more))
    out = B.token_digests(docs([(1, "common common rare")]), ranks, tokenizers.PATTERN)
    assert sorted(str(tuple(r)) for r in out.collect()) == expected([(1, "common common rare")], ranks)
    assert kept[-1] == [("word", "string"), ("coded", "string")]


def test_pieces_are_joined_natively(spark):
    plan = spark.range(1).select(B.concatenated(B.F.array(B.F.lit(b"\xff"), B.F.lit(b"\x00\xc3"))).alias("x"))
    assert bytes(plan.first().x) == b"\xff\x00\xc3"
    assert "lambda" not in plan._jdf.queryExecution().analyzed().toString()


def test_a_text_that_cannot_be_decoded_is_null(docs):
    few = {b"a": 0, b"b": 1, b"ab": 2, b"ba": 3}
    out = B.token_digests(docs([(1, "abba"), (2, "abc"), (3, "b")]), few, tokenizers.PATTERN)
    assert {r.doc_id: r.n_tokens for r in out.collect()} == {1: 2, 2: None, 3: 1}
