import random

import numpy as np
import pytest

from plantpulse.llm import jaccard_join as J


def shingle_set(text):
    words = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).replace("\t", " ").replace("\n", " ")
    words = [w for w in words.replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return sorted(map(str, out))


def result(df):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in J.near_duplicates(df).collect())


def corpus(seed, groups=6, members=12):
    """Groups of near copies at all distances around the threshold, with a passage that all documents share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    rows = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([8, 30, 90]))
        for _ in range(members):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 10)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words) + (" " + passage if rng.random() < 0.5 else "")))
    rng.shuffle(rows)
    return rows + [(len(rows) + 5, rows[0][1].upper())]


@pytest.mark.parametrize("seed, frequent, costs", [(1, 32, J.COSTS), (2, 0, (1, 4, 8)), (3, 3, (0, 0, 0))])
def test_equals_brute_force(docs, monkeypatch, seed, frequent, costs):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "COSTS", costs)
    rows = corpus(seed)
    assert result(docs(rows)) == brute(rows)


def test_odd_rows(odd):
    assert result(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_empty(docs):
    assert J.near_duplicates(docs([])).count() == 0


def test_prefixes_share_what_the_lemma_promises():
    rng = np.random.default_rng(5)
    for _ in range(200):
        both = rng.choice(10_000, 200, replace=False).astype(np.uint64)
        x, y = np.sort(both[: rng.integers(85, 100)]), np.sort(both[5:100])
        counts = rng.integers(0, 200, 10_000)
        shared, total = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        if 100 * shared < 80 * total:
            continue
        (px, kx), (py, ky) = (J.prefix(s, counts[s.astype(int)], 50.0, 120.0, 80, (500, 900, 1200)) for s in (x, y))
        assert len(np.intersect1d(px, py)) >= min(kx, ky)


def test_words_do_not_depend_on_chunks(monkeypatch):
    text = "The quick brown fox  jumps\tover the lazy dog " * 50
    whole = J.shingles(text)
    monkeypatch.setattr(J, "chunks", lambda data: (data[i:i + 45] for i in range(0, len(data), 45)))
    assert (J.shingles(text) == whole).all() and len(whole) == len(shingle_set(text))


def test_components_of_a_chain(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 200)], "a long, b long")
    assert {r.node: r.label for r in J.components(links).collect()} == {**dict.fromkeys(range(n + 1), 0), 100: 100, 200: 100}
