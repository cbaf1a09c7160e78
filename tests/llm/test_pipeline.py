"""Each stage of the corpus pipeline against a plain version of its decision, on its own input."""

import hashlib
import re
import struct
from collections import Counter

import corpus_pipeline as P
import public_tokenizers
import pytest
import tiktoken

from plantpulse.llm import mixing, quality
from plantpulse.llm.common import table
from tests.llm.test_jaccard_join import shingle_set
from tests.llm.test_mixing import order, water, words

LONG = " ".join(f"word{i}" for i in range(60))
NEAR = LONG.replace("word59", "other")
ROWS = [
    (1, LONG, "en", "a"), (2, LONG + " ", "en", "a"), (2, LONG + " ", "en", "a"), (3, NEAR, "en", "b"), (None, NEAR + " tail", "en", "b"),
    (None, "a text of its own under no id " * 3, "de", None), (5, None, None, None), (6, "", None, "a"), (7, " \t", None, "b"),
    (8, "first text under one id " * 4, "en", "c"), (8, "second text under one id " * 4, "en", "c"), (9, "x", "en", "c"),
]


def plain(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def stage(name):
    return dict(P.STAGES)[name]


@pytest.fixture(scope="module")
def given(docs):
    return docs(ROWS).select("doc_id", "text", "lang", "source", "n_chars")


def test_quality_stage_drops_what_the_classifier_rejects(spark, sf, given):
    for rows in (given, table(spark, sf, "documents")):
        scored = quality.score_quality(rows, table(spark, sf, "labels")).collect()
        kept = stage("quality classifier")(spark, rows, sf)
        assert kept.columns == rows.columns
        texts = rows.collect()
        rejected = Counter(r.doc_id for r in scored if r.predicted == 0)
        # Scores follow the text alone, so every text is judged by a table of its own.
        assert sum(plain(kept).values()) == len(texts) - sum(rejected.values())
        by_id = Counter(r.doc_id for r in texts)
        left = Counter(r.doc_id for r in kept.collect())
        assert left == Counter({d: n - rejected[d] for d, n in by_id.items() if n > rejected[d]})


def test_exact_stage_keeps_one_row_a_group(spark, sf, given):
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for rows in (given, table(spark, sf, "documents")):
        groups = {}
        for r in rows.collect():
            groups.setdefault(bare(r.text), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, r.text or ""))
        kept = [(-len(r.text or ""), r.doc_id is None, r.doc_id or 0, r.text or "") for r in stage("exact dedup")(spark, rows, sf).collect()]
        assert sorted(x[:3] for x in kept) == sorted(min(g)[:3] for g in groups.values())


def test_near_stage_keeps_one_document_a_component(spark, sf, given):
    for rows in (given, table(spark, sf, "documents")):
        texts = sorted({(r.doc_id is None, r.doc_id or 0, r.text is None, hashlib.sha256((r.text or "").encode()).digest(), r.text or "") for r in rows.collect()})
        sets = [shingle_set(t[4]) for t in texts]
        label = list(range(len(texts)))
        find = lambda i: i if label[i] == i else find(label[i])
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j]) if sets[i] and sets[j] and 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) else 0
                if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    low, high = sorted((find(i), find(j)))
                    label[high] = low
        first = {(None if t[0] else t[1], t[4]) for i, t in enumerate(texts) if find(i) == i}
        kept = {(r.doc_id, r.text or "") for r in stage("near-duplicate join")(spark, rows, sf).collect()}
        assert kept == first


def test_mix_stage_repeats_documents_by_source(spark, sf, given):
    for rows in (given, table(spark, sf, "documents")):
        mixed = stage("source mix")(spark, rows, sf)
        assert mixed.columns == rows.columns
        before, after = plain(rows), plain(mixed)
        assert set(after) <= set(before) and all(after[r] <= 2 * before[r] for r in after)
        sources = sorted({r[2] for r in before}, key=order)
        size = {s: sum(words(r[1]) * n for r, n in before.items() if r[2] == s) for s in sources}
        for s, goal in zip(sources, water([size[s] for s in sources]), strict=True):
            own = {r: n for r, n in before.items() if r[2] == s}
            longest = max(words(r[1]) * n for r, n in own.items())
            assert abs(sum(words(r[1]) * after[r] for r in own) - goal) <= longest + 2 * mixing.BLOCK


def test_token_stage_equals_the_library(spark, sf, given):
    from plantpulse.llm.byte_bpe import read_ranks
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for r in given.collect():
        ids = coder.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, stage("byte-level BPE")(spark, given, sf).collect())) == want


def test_whole_pipeline_and_empty_documents(spark, sf, given):
    out = P.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    rows = given.limit(0)
    for name, function in P.STAGES:
        result = function(spark, rows, sf)
        assert result.count() == 0
        rows = result if name != "byte-level BPE" else rows
