import math
import random
import re
from collections import Counter

import pytest

from plantpulse.llm import lexical_search as L

ITEMS = "item_id long, text string, doc_id string, score int, rank int"


def cut(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, top=10):
    counted = [(doc, Counter(cut(text))) for doc, text in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            if c:
                m = 100 - 90 + (90 * c.total() * n_docs) // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                            for t in set(cut(text)) if t in c)
                if score > 0:
                    scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top])]
    return sorted(map(str, out))


def result(docs, items, **more):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in L.search(docs, items, **more).collect())


def corpus(seed, n=300):
    """Frequencies from a few documents to nearly all, passages of items in some documents, copies that tie."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    items = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 30])))) for k in range(25)]
    docs = []
    for k in range(n):
        text = " ".join(rng.choices(vocabulary, weights, k=rng.choice([3, 20, 150])))
        docs.append((k * 3, text + (" " + rng.choice(items)[1] if rng.random() < 0.1 else "")))
    docs += [(10_000 - k, docs[k % 7][1]) for k in range(40)]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("seed, slice_rows, bundle_items, max_terms, top",
                         [(1, 8192, 256, 200_000, 10), (2, 16, 4, 200_000, 10), (3, 64, 7, 0, 3), (4, 5, 1, 50, 10)])
def test_equals_brute_force(docs, spark, seed, slice_rows, bundle_items, max_terms, top):
    rows, items = corpus(seed)
    df = spark.createDataFrame([(*i, "x", 1, 2) for i in items], ITEMS)
    found = result(docs(rows).repartition(3), df, slice_rows=slice_rows, bundle_items=bundle_items, max_terms=max_terms, top=top)
    assert found == brute(rows, items, top)


def test_odd_rows(odd, spark):
    items = [(1, "Hello WIDE world"), (1, "Hello WIDE world"), (2, None), (3, ""), (4, "漢字 ünïcode"), (None, "hellobig"), (5, "absent"), (6, "alpha")]
    df = spark.createDataFrame([(*i, "x", 1, 2) for i in items], ITEMS)
    assert result(odd, df) == brute([(r.doc_id, r.text) for r in odd.collect()], items)


def test_empty(docs, spark):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b", "x", 1, 2)], ITEMS)
    assert L.search(docs([]), some).count() == 0
    assert L.search(docs([(1, "a b")]), none).count() == 0
    assert L.search(docs([]), none).count() == 0


def test_pruning_leaves_few_accumulators():
    """With ten strong documents no accumulator is opened for weak ones."""
    import numpy as np
    scores = np.array([[50] * 10 + [3] * 90])
    assert L.least_needed(scores, 10).tolist() == [50]
    assert ((scores + 10 >= L.least_needed(scores, 10)[:, None]).sum()) == 10
