import numpy as np

from windlass.llm import embeddings as E


def _run(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    return {r.id: (r.n_links, r.component_id) for r in E.near_duplicates(spark, df).collect()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 32))
    vectors = {i: (centres[i % 30] + rng.normal(size=32) * (0.02 if i % 3 else 0.2)).astype("float32").tolist() for i in range(240)}
    vectors |= {1000: None, 1001: [0.0] * 32, 1002: [float("nan")] + [1.0] * 31, 1003: [None] + [1.0] * 31, 1004: [], 1005: [1.0, 0.0], 1006: [1.0, 0.1]}
    want, got = E.brute_force(vectors, 0.9), _run(spark, vectors)
    missed = sum(want[i][0] for i in want) - sum(got[i][0] for i in want)
    assert set(got) == set(want) and 0 <= missed <= 0.1 * sum(w[0] for w in want.values())
    for i in list(range(1000, 1005)):
        assert got[i] == (0, i)
    assert got[1006] == (1, 1005)


def test_pairs_in_over_full_buckets(spark):
    rng = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    c = unit(rng.normal(size=64))
    loose = unit(0.7**0.5 * c + 0.3**0.5 * unit(rng.normal(size=(600, 64))))  # mutual cosine about 0.7
    twins = unit(loose[:200] + 0.44 * unit(rng.normal(size=(200, 64))))  # near 0.9 to their own, ids far apart
    dense = unit(c + 0.01 * unit(rng.normal(size=(100, 64))))  # one component that shares buckets with them
    x = np.vstack([loose, twins, dense, unit(rng.normal(size=(900, 64)))])
    ids = rng.permutation(len(x))
    vectors = {int(i): v.astype("float32").tolist() for i, v in zip(ids, x)}
    want, got = E.brute_force(vectors, 0.9), _run(spark, vectors)
    links = sum(w[0] for w in want.values())
    missed = sum(want[i][0] - got[i][0] for i in want if want[i][0] < 50)
    twin = sum(w[0] for w in want.values() if w[0] < 50)
    assert links > 9000 and twin > 200 and all(got[i][0] <= want[i][0] for i in want)
    assert missed <= 0.05 * twin
    assert sum(want[i][1] != got[i][1] for i in want) <= 0.05 * twin


def test_bound_holds():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 64))
    y = x * 0.8 + rng.normal(size=(500, 64)) * rng.random((500, 1))
    x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
    turned = x @ E.rotation(64, 0).T
    code, factor = np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / 8
    true = (x * y).sum(1)
    for confidence, rate in ((4.0, 0.999), (2.0, 0.93)):
        value, bound = E.estimate(code, factor, y, confidence)
        assert (np.abs(value - true) <= bound).mean() >= rate
    assert abs((value - true).mean()) < 0.02


def test_copies_are_counted(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 48))
    near = a + 0.05 * rng.normal(size=48)
    vectors = {i: (a if i % 3 else near).tolist() for i in range(60)} | {100 + i: b.tolist() for i in range(5)} | {200: (-b).tolist()}
    assert _run(spark, vectors) == E.brute_force({i: np.float32(v) for i, v in vectors.items()}, 0.9)


def test_dimensions_apart(spark):
    """Vectors link within their own dimension only, also where dimensions agree modulo a power of two."""
    v = [1.0] * 3 + [0.0] * 4096
    got = _run(spark, {1: v[:3], 2: v, 3: v[:3], 4: v})
    assert got == {1: (1, 1), 3: (1, 1), 2: (1, 2), 4: (1, 2)}


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert E.near_duplicates(spark, df).count() == 0
