import random

import numpy as np
import pytest

from windlass.llm import jaccard as J


def _texts():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    texts: dict = {}
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 9, 30, 80, 200]))]
        for _ in range(rng.choice([1, 3, 15])):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts[len(texts) + 10] = " ".join(t) if rng.random() < 0.8 else " ".join(t).upper()
    return texts | {1: None, 2: "", 3: " \t\n", 4: "one", 5: "One", 6: "one two", 7: "x " * 5000}


@pytest.mark.parametrize(("n", "percent", "family"), [(3, 90, J.FAMILY), (3, 80, 2)])
def test_against_brute_force(spark, n, percent, family):
    texts = _texts()
    df = spark.createDataFrame([(i, t, "a") for i, t in texts.items()], "doc_id long, text string, keys string")
    got = {r.doc: (r.n_shingles, r.component_id) for r in J.Join(spark, df, n=n, percent=percent, family=family).run().collect()}
    assert got == J.brute_force(texts, n, percent)


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    rows = J.Join(spark, df, n=3, percent=90).run().collect()
    assert sorted((r.doc, r.component_id) for r in rows) == [(1, 1), (1, 1), (2, 1)]
    assert J.Join(spark, df.limit(0), n=3, percent=90).run().count() == 0


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        bands = J.Bands(percent)
        for size in (1, 5, 9, 10, 11, 40, 333):
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
                d = 2 * len(a) * (100 - percent) // (100 + percent) // 2
                b = np.unique(np.concatenate([a[d:], rng.integers(0, 2**63, rng.integers(0, d + 1), dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    assert np.intersect1d(J.keys(a, bands), J.keys(b, bands)).size


def test_unlike_sets_share_no_key():
    """Neither an empty word nor a single common shingle makes unlike sets candidates of each other."""
    rng = np.random.default_rng(2)
    common = rng.integers(0, 2**63, 8, dtype=np.uint64)
    for size in (400, 1000, 3000):
        bands, seen = J.Bands(80), []
        for _ in range(30):
            s = np.unique(np.append(rng.integers(0, 2**63, size - 8, dtype=np.uint64), common))
            seen.append(np.unique(J.keys(s, bands)))
        _, n = np.unique(np.concatenate(seen), return_counts=True)
        assert (n > 1).sum() <= 3


def test_pairs_of_many_buckets_are_one_row(spark, monkeypatch):
    """Near copies share keys in many buckets; no operator makes a row of a pair for each of them."""
    from windlass.llm.common import Scratch

    rng, texts = random.Random(6), {}
    for g in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        for _ in range(2):
            texts[len(texts)] = " ".join(base[:rng.randint(0, 399)] + [f"u{len(texts)}"] + base)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    rows, table = {}, Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, *a: rows.setdefault(a[1], table(self, *a)))
    monkeypatch.setattr(Scratch, "drop", lambda *a: None)
    counts = []
    for size in (J.BUCKET_BYTES, 60000):
        monkeypatch.setattr(J, "BUCKET_BYTES", size)
        rows.clear()
        J.Join(spark, df, n=3, percent=80).run().collect()
        counts.append((rows["keyed"].filter("n is null").count(), rows["pairs"].count()))
    (few, one), (many, same) = counts
    assert one == same and few <= one
    buckets = -(-sum(map(len, texts.values())) // 60000)
    assert 3 <= buckets and many <= buckets * buckets < one
    # in buckets' order or not, equal pairs meet in one part and become one row
    p = np.array([[1, 2], [1, 2], [1, 3], [4, 5]])
    packed = [r for k in (0, 2) for r in J._parted(p[k:], 3).to_pylist()]
    packed.sort(key=lambda r: r["part"])
    met = J._met([J._batch(J._KEYED_PA, len(packed), part=[r["part"] for r in packed], pairs=[r["pairs"] for r in packed]).select(["part", "pairs"])])
    assert sorted(tuple(r.values()) for b in met for r in b.to_pylist()) == [(1, 2), (1, 3), (4, 5)]


@pytest.mark.parametrize("family", [J.FAMILY, 2])
def test_links_that_no_centre_shows(spark, family):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]

    def changed(places):
        return " ".join(f"x{rng.randrange(10**6)}" if k in places else w for k, w in enumerate(base))

    # the least document of every key is one of those too far from all others
    texts = {i: changed({i % 31, i % 31 + 32, i % 31 + 65}) for i in range(1, 90)} | {100: changed(set()), 101: changed({50})}
    expected = J.brute_force(texts, 3, 90)
    assert expected[101][1] == 100
    bands = J.Bands(90)
    keys = {d: set(J.keys(s, bands).tolist()) for d, s in zip(texts, J.sets(list(texts.values()), 3, J.WordHashes()))}
    assert all(any(k in keys[d] for d in range(1, 90)) for k in keys[100] & keys[101])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    got = {r.doc: (r.n_shingles, r.component_id) for r in J.Join(spark, df, n=3, percent=90, family=family).run().collect()}
    assert got == expected
