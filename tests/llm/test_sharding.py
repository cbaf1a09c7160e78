import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plantpulse.llm import sharding
from plantpulse.llm.common import table


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**31))
def test_permutation_and_inverse(n, seed):
    there = sharding.permute(np.arange(n), n, seed)
    assert sorted(there) == list(range(n))
    assert (sharding.permute(there, n, seed, backwards=True) == np.arange(n)).all()


def test_shards_equal_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    place = sharding.permute(np.arange(len(ids)), len(ids))
    expected = {doc: (int(p) % 8, int(p) // 8) for doc, p in zip(ids, place, strict=True)}
    rows = sharding.shard_rows(docs).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == expected
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r["size"] == len(texts[r.doc_id].encode()) + 1 for r in rows)
    assert all(ids[sharding.row_number(r.shard, r.slot, 8, len(ids))] == r.doc_id for r in rows[:20])


def test_same_result_for_another_layout(spark, sf):
    docs = table(spark, sf, "documents")
    one, two = (sharding.shard_rows(d).select("doc_id", "shard", "slot") for d in (docs, docs.repartition(7)))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_odd_rows(odd):
    rows = sharding.shard_rows(odd, shards=3).collect()
    assert len(rows) == odd.count()
    sizes = [sorted(r.slot for r in rows if r.shard == s) for s in range(3)]
    assert all(slots == list(range(len(slots))) for slots in sizes)
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert {r["size"] for r in rows if r.doc_id == 1} == {1}


def test_empty(docs):
    assert sharding.shard_rows(docs([])).count() == 0
