import numpy as np

from loomgraph.llm import neighbours as N

SCHEMA = "id string, model string, dimensions int, vector array<float>, cid long"


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(N.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(N.hadamard(N.hadamard(x)), x)


def rows_of(n, d, seed, groups):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(groups, d))
    x = centers[r.integers(0, groups, n)] + r.normal(size=(n, d)) * 0.25
    return (x * r.uniform(0.5, 3, (n, 1))).astype(np.float32)


def brute(x, ids, k, least):
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -2)
    return {ids[i]: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k] if s[i, j] >= least] for i in range(len(ids))}


def test_recall_against_brute_force(spark):
    want, rows = {}, []
    for model, d in (("a", 64), ("b", 96)):
        x = rows_of(700, d, d, 60)
        ids = [f"{model}{i:04d}" for i in range(len(x))]
        want |= brute(x, ids, 10, 0.8)
        rows += [(i, model, d, v.tolist(), 1) for i, v in zip(ids, x)]
    for bucket in (1024, 40):
        got = {}
        for r in N.nearest(spark.createDataFrame(rows, SCHEMA), k=10, least=0.8, bucket=bucket).collect():
            got.setdefault(r["id"], set()).add(r["neighbour"])
        total = sum(map(len, want.values()))
        assert sum(len(set(v) & got.get(i, set())) for i, v in want.items()) / total >= 0.9
        assert all(len(v) <= 10 for v in got.values())


def test_copies_and_unsound_vectors(spark):
    v, w = [1.0, 2.0, 0.0, 1.0], [-1.0, 0.0, 3.0, 1.0]
    rows = [(f"c{i:02d}", "m", 4, v, 1) for i in range(30)] + [("near", "m", 4, [1.0, 2.0, 0.1, 1.0], 1), ("far", "m", 4, w, 1), ("zero", "m", 4, [0.0] * 4, 1), ("short", "m", 4, v[:3], 1), ("null", "m", 4, None, 1), ("hole", "m", 4, [1.0, None, 0.0, 1.0], 1), ("nan", "m", 4, [1.0, float("nan"), 0.0, 1.0], 1), (None, "m", 4, v, 1), ("other", "n", 4, v, 1), ("c00", "m", 4, v, 1)]
    got = {}
    for r in N.nearest(spark.createDataFrame(rows, SCHEMA), k=3, least=0.9).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    assert set(got) == {f"c{i:02d}" for i in range(30)} | {"near"}
    assert [n for _, n in sorted(got["c00"])] == ["c01", "c02", "c03"] and [n for _, n in sorted(got["c29"])] == ["c00", "c01", "c02"] and [n for _, n in sorted(got["near"])] == ["c00", "c01", "c02"]
    assert N.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_in_one_tight_cluster(spark):
    # so alike that all digits are shared: far more than a bucket holds
    r = np.random.default_rng(3)
    c = r.normal(size=64)
    x = (c + r.normal(size=(4000, 64)) * 0.003 * np.linalg.norm(c) / 8).astype(np.float32)
    ids = [f"v{i:05d}" for i in range(len(x))]
    want = brute(x, ids, 10, 0.9)
    got = {}
    for q in N.nearest(spark.createDataFrame([(i, "m", 64, v.tolist(), 1) for i, v in zip(ids, x)], SCHEMA), k=10, least=0.9, bucket=128).collect():
        got.setdefault(q["id"], set()).add(q["neighbour"])
    assert sum(len(set(v) & got.get(i, set())) for i, v in want.items()) / sum(map(len, want.values())) >= 0.98


def test_every_vector_gets_its_k_whatever_their_cosines(spark):
    """Spread vectors, none with a close one, in several blocks; and a pair of opposite ones."""
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 64)).astype(np.float32)
    ids = [f"v{i:03d}" for i in range(len(x))]
    rows = [(i, "m", 64, v.tolist(), 1) for i, v in zip(ids, x)] + [("up", "n", 2, [1.0, 3.0], 1), ("down", "n", 2, [-1.0, -3.0], 1)]
    got = {}
    for q in N.nearest(spark.createDataFrame(rows, SCHEMA), k=10, bucket=32).orderBy("id", "rank").collect():
        got.setdefault(q["id"], []).append(q["neighbour"])
    assert got == brute(x, ids, 10, -2) | {"up": ["down"], "down": ["up"]}
