import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from plantpulse.llm import fuzzy_hash as H
from plantpulse.llm.common import table


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        marks = H.fingerprint(text), H.fingerprint(changed)
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), *marks, H.compare(*marks), H.compare(marks[0], H.fingerprint(following))))
    return sorted(map(str, out))


def result(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_equals_brute_force_for_any_number_of_slices(spark, sf):
    docs = table(spark, sf, "documents")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    for slices in (1, 2, 7, 64):
        assert result(H.fingerprints(docs.repartition(3), slices=slices)) == expected


def test_odd_rows(odd, docs):
    expected = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert result(H.fingerprints(odd, slices=3)) == expected
    assert H.fingerprints(docs([])).count() == 0
    (only,) = H.fingerprints(docs([(5, "one single text")])).collect()
    assert only.near_next == 1.0 and only.n_chars == 15
    (empty,) = H.fingerprints(docs([(5, None)])).collect()
    assert empty.fingerprint == "3::" and empty.near_edited == 1.0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abcd", max_size=40), st.text(alphabet="abcd", max_size=40))
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    assert H._common(a, b) == row[-1]


def test_pieces_do_not_depend_on_stretches(monkeypatch):
    text = "some words of a text that is long enough to have a few pieces " * 40
    whole = H.fingerprint(text)
    monkeypatch.setattr(H, "_STEP", 97)
    assert H.fingerprint(text) == whole


def test_likeness_follows_the_change():
    import random
    rng = random.Random(4)
    base = [rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) + str(rng.randrange(99)) for _ in range(2000)]
    small, half = list(base), base[:1000] + [str(rng.random()) for _ in range(400)]
    small[700] = "changed"
    mark = H.fingerprint(" ".join(base))
    near = H.compare(mark, H.fingerprint(" ".join(small)))
    assert near > 0.9 > H.compare(mark, H.fingerprint(" ".join(half))) > 0.2
    assert H.compare(mark, H.fingerprint(" ".join(str(rng.random()) for _ in range(900)))) == 0
    # An insertion at the front shifts all places, but not the pieces.
    assert H.compare(mark, H.fingerprint("new words in front " + " ".join(base))) > 0.9
