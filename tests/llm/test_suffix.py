import random

from windlass.llm import suffix as S


def _texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(6)]
    out = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
        t = " ".join(parts)
        if rng.random() < 0.3:
            t = t[rng.randint(0, 30):-rng.randint(1, 30)]
        out.append((i, t))
    return out + [(100, None), (101, ""), (102, "x" * 99), (103, "y" * 100), (104, "y" * 350), (105, "ab" * 200), (106, "Shti " * 120), (107, "Shti " * 121)]


def test_against_brute_force(spark):
    rows = _texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, doc int").repartition(5)
    got = sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(spark, df).collect())
    assert got == S.brute_force(rows)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "short")], "doc_id long, text string")
    got = sorted((r.id is not None, r.id or 0, r.n_removed) for r in S.remove_repeats(spark, df).collect())
    assert got == [(False, 0, 0), (True, 1, len(text)), (True, 1, len(text)), (True, 2, 0)]
    assert S.remove_repeats(spark, df.limit(0)).count() == 0
