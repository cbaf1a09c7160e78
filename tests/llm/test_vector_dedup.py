import numpy as np
import pytest

from plantpulse.llm import vector_dedup as V

SCHEMA = "vec_id long, embedding array<float>, label int, node long, cell string, n_links int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, "x", 2) for i, v, label in rows], SCHEMA)


def brute(rows, threshold):
    vectors = []
    for _, v, label in rows:
        good = label is not None and v is not None and len(v) and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(v)
        vectors.append(np.array(v, dtype=np.float32).astype(np.float64) if good else None)
    label = list(range(len(rows)))
    counts = [0] * len(rows)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and \
                    (a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                counts[i] += 1
                counts[j] += 1
                label[find(i)] = find(j)
    out = []
    for i, row in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        low = min(ids, default=None)
        out.append((row[0], counts[i], low, row[0] == low))
    return sorted(map(str, out))


def result(df, **more):
    return sorted(str(tuple(r)) for r in V.near_vectors(df, **more).collect())


def crowd(seed, dims, groups=25, members=8, labels=2):
    """Groups of near copies at all distances around the threshold, in clouds that k-means has to cut."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = rng.normal(size=dims)
        for _ in range(members):
            step = rng.normal(size=dims)
            v = base / np.linalg.norm(base) + step / np.linalg.norm(step) * rng.choice([0.0, 0.02, 0.1, 0.15, 0.2, 0.25])
            rows.append((len(rows), (v * rng.choice([1, 3])).astype(np.float32).tolist(), int(rng.integers(labels))))
            if rng.random() < 0.2:
                rows.append((len(rows), rows[-1][1], rows[-1][2]))
    rng.shuffle(rows)
    return [(int(i), v, int(label)) for i, v, label in rows]


@pytest.mark.parametrize("seed, dims, block, cell_nodes, threshold",
                         [(1, 6, 2048, 2048, 0.98), (2, 4, 16, 8, 0.98), (3, 3, 7, 4, 0.98), (4, 24, 32, 10, 0.9)])
def test_equals_brute_force(spark, seed, dims, block, cell_nodes, threshold):
    rows = crowd(seed, dims)
    assert result(frame(spark, rows), block=block, cell_nodes=cell_nodes, threshold=threshold) == brute(rows, threshold)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0, 0], 0), (4, [1, None], 0), (5, [nan, 1], 0), (6, [inf, 1], 0), (7, [1, 1], None),
            (8, [1, 1], 0), (8, [1, 1], 0), (9, [2, 2], 0), (None, [1, 1.01], 0), (10, [1, 1], 1), (11, [1, 1, 0], 0), (12, [-0.0, 1], 2),
            (13, [0.0, 1], 2), (14, [1e-38, 1e-38], 0), (None, [5, -5], 3)]
    assert result(frame(spark, rows)) == brute(rows, 0.98)


def test_empty(spark):
    assert V.near_vectors(frame(spark, [])).count() == 0
    assert result(frame(spark, [(1, None, 0)])) == ["(1, 0, 1, True)"]


def test_many_copies_stay_one_node(spark):
    rows = [(k, [1, 2, 3], 0) for k in range(3000)] + [(5000, [1, 2, 3.001], 0)]
    found = V.near_vectors(frame(spark, rows)).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(3000, 0)}


def test_each_linked_pair_meets(monkeypatch):
    rng = np.random.default_rng(3)
    centres = V.spherical_k_means(V.unit(rng.normal(size=(400, 5))), 20)
    base = V.unit(rng.normal(size=(500, 5)))
    other = V.unit(base + 0.14 * V.unit(rng.normal(size=(500, 5))))
    linked = (base * other).sum(axis=1) >= 0.98
    (home_a, near_a), (home_b, near_b) = V.cells_of(base, centres, 0.98), V.cells_of(other, centres, 0.98)
    meets = (home_a == home_b) | near_a[np.arange(500), home_b] | near_b[np.arange(500), home_a]
    assert linked.sum() > 100 and (home_a != home_b)[linked].any() and meets[linked].all()


def test_forest():
    hit = np.zeros((5, 6), dtype=bool)
    for a, b in ((0, 0), (1, 0), (1, 3), (2, 3), (4, 5)):
        hit[a, b] = True
    assert V.forest(hit).tolist() == [0, 0, 0, 3, 4, 0, 6, 7, 0, 9, 4]
