import heapq
import random
import re

import pytest

from plantpulse.llm import mixing
from plantpulse.llm.common import table


def sainte_lague(votes, blocks, most, words):
    """Seat by seat from a heap until so many words have one; ties go to the earlier source."""
    got = [0] * len(votes)
    heap = [(-v / b, i) for i, (v, b) in enumerate(zip(votes, blocks, strict=True)) if most[i] and v]
    heapq.heapify(heap)
    while words > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        words -= blocks[i]
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / blocks[i] / (2 * got[i] + 1), i))
    return got


def block_of(size, target):
    return max(1, min(mixing.BLOCK, int(min(size, target) // mixing.PARTS)))


def brute(rows, shards=8):
    """Words taken of each document and for each shard: the words of a source one by one, the seats one by one."""
    sources = sorted({r[2] for r in rows}, key=order)
    owned = {s: sorted((r for r in rows if r[2] == s), key=lambda r: r[0]) for s in sources}
    sizes = [sum(words(r[1]) for r in owned[s]) for s in sources]
    goal = water(sizes)
    blocks = [block_of(a, b) for a, b in zip(sizes, goal, strict=True)]
    counts = [-(-n // b) for n, b in zip(sizes, blocks, strict=True)]
    seats = sainte_lague(goal, blocks, [2 * c for c in counts], round(sum(goal)))
    taken, before = {r[0]: [0] * shards for r in rows}, 0
    for k, s in enumerate(sources):
        word_owner = [r[0] for r in owned[s] for _ in range(words(r[1]))]
        place = [int(mixing.permute([n], counts[k], k)[0]) for n in range(counts[k])]
        block_at = {p: n for n, p in enumerate(place)}
        assert len(block_at) == counts[k]
        for seat in range(seats[k]):
            n = block_at[seat % counts[k]]
            for doc in word_owner[n * blocks[k]:(n + 1) * blocks[k]]:
                taken[doc][(before + seat) % shards] += 1
        before += seats[k]
    return taken, dict(zip(sources, goal, strict=True))


def water(sizes):
    """Targets by repeated sharing."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    full, total = set(), 1.5 * sum(sizes)
    while True:
        free = sum(w for i, w in enumerate(weights) if i not in full)
        level = (total - sum(2 * sizes[i] for i in full)) / free if free else 0
        new = {i for i in range(len(sizes)) if i not in full and level * weights[i] > 2 * sizes[i]}
        if not new:
            return [2.0 * sizes[i] if i in full else level * weights[i] for i in range(len(sizes))]
        full |= new


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def order(source):
    return (source is None, source or "")


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_equals_brute_force(spark, name):
    docs = table(spark, f"/root/testdata/{name}", "documents")
    sizes, per = {}, {}
    for r in docs.collect():
        sizes[r.doc_id] = words(r.text)
        per[r.source] = per.get(r.source, 0) + words(r.text)
    sources = sorted(per, key=order)
    target = dict(zip(sources, water([per[s] for s in sources]), strict=True))
    blocks = [block_of(per[s], target[s]) for s in sources]
    most = [2 * -(-per[s] // b) for s, b in zip(sources, blocks, strict=True)]
    seats = sainte_lague([target[s] for s in sources], blocks, most, round(sum(target.values())))
    sized = mixing._sized(docs, "doc_id", "source", "text")
    given = {r.source: r for r in mixing.apportion(mixing.targets(sized)).collect()}
    assert [given[s].seats for s in sources] == seats
    quotas = mixing.shard_quotas(mixing.apportion(mixing.targets(sized))).collect()
    for s in sources:
        own = [q.blocks for q in quotas if q.source == s]
        assert sum(own) == given[s].seats and max(own) - min(own) <= 1
    whole = [sum(q.blocks for q in quotas if q.shard == k) for k in range(mixing.SHARDS)]
    assert max(whole) - min(whole) <= 1
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(rows) == len(sizes) and all(r["size"] == sizes[r.doc_id] and 0 <= r.taken <= 2 * r["size"] for r in rows)
    for s in sources:
        own = [r for r in rows if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == per[s] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= 2 * mixing.BLOCK


def test_reruns_and_layouts_agree(spark, sf):
    docs = table(spark, sf, "documents")
    one, two = (mixing.mix(d).select("doc_id", "taken") for d in (docs, docs.repartition(5)))
    assert one.exceptAll(two).isEmpty()


def test_odd_rows(odd, docs):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r["size"] for r in rows)
    assert all(r.taken == 0 for r in rows if r.doc_id in (1, 2, 3))
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and all(words(r.text) for r in mixed.collect())
    assert mixing.mix(docs([])).count() == 0 and mixing.mixed_documents(docs([])).count() == 0


def test_equal_quotients_go_to_the_earlier_source(docs):
    rows = docs([(i, "w " * 6400, None, f"s{i}") for i in range(6)])
    sized = mixing._sized(rows, "doc_id", "source", "text")
    sources = mixing.targets(sized).orderBy("place").collect()
    seats = sainte_lague([s.target for s in sources], [64] * 6, [200] * 6, round(sum(s.target for s in sources)))
    assert [s.seats for s in mixing.apportion(mixing.targets(sized)).orderBy("place").collect()] == seats


SMALL = {
    "300 sources of 10 words": [(i, "w " * 10, None, f"s{i:03}") for i in range(300)],
    "300 sources of 3 words": [(i, "w " * 3, None, f"s{i:03}") for i in range(300)],
    "one large, 100 small": [(0, "w " * 100_000, None, "a")] + [(i, "w " * 10, None, f"s{i:03}") for i in range(1, 101)],
    "60 sources of 33 words": [(i, "w " * 33, None, f"s{i:03}") for i in range(60)],
}


@pytest.mark.parametrize("name", SMALL)
def test_small_sources_get_their_words(docs, name):
    found = mixing.mix(docs(SMALL[name])).collect()
    taken, goal = brute([(r[0], r[1], r[3]) for r in SMALL[name]])
    assert {r.doc_id: r.shard_words for r in found} == taken
    source = {r[0]: r[3] for r in SMALL[name]}
    assert all(abs(r.taken - goal[source[r.doc_id]]) <= max(1, 0.05 * r["size"]) for r in found)
    assert sum(r.taken for r in found) == pytest.approx(1.5 * sum(r["size"] for r in found), rel=0.01)


def test_taken_words_of_each_document(spark, docs):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), None, rng.choice(["a", "b", "c", "d", None])) for i in range(80)] + [(99, "w " * 9000, None, "b")]
    found = {r.doc_id: r.shard_words for r in mixing.mix(docs(rows)).collect()}
    assert found == brute([(r[0], r[1], r[3]) for r in rows])[0]


def test_copies_add_up_to_the_words_of_the_source(docs):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([1, 5, 40, 300]), None, rng.choice(["a", "b", "c"])) for i in range(120)] + [(None, "w " * 7, None, "a")]
    goal, size = {}, {}
    for r in mixing.mix(docs(rows)).collect():
        source = next(x[3] for x in rows if x[0] == r.doc_id)
        goal[source] = goal.get(source, 0) + r.taken
    for r in mixing.mixed_documents(docs(rows)).collect():
        size[r.source] = size.get(r.source, 0) + words(r.text)
    assert all(abs(goal[s] - size[s]) <= 301 for s in goal)


def test_any_column_name(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 1, 2), (2, "d", None, 3, 4)], "doc_id long, text string, source string, __times int, `a.b` int")
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() >= 2
