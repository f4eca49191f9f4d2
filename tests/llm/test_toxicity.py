import math
import zlib

import numpy as np
import pytest

from windlass.llm import toxicity
from windlass.llm.toxicity import Classifier, Network, fit, op11_toxicity, risk, score, train

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def _corpus(n=900, seed=3):
    """Every eighth document is toxic: it has two of the words 'vile..' among common ones; the rest are clean."""
    r = np.random.default_rng(seed)
    common = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        tokens = list(r.choice(common, 40)) + ([f"vile{r.integers(5)}", f"vile{r.integers(5)}"] if toxic else [])
        r.shuffle(tokens)
        docs.append((i, " ".join(tokens), "en"))
        if i % 3 != 1:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_risk_is_its_definition_and_slopes_are_its_derivatives():
    r = np.random.default_rng(1)
    loss = lambda z, y: np.log1p(np.exp(-z if y else z))
    for zu in (r.normal(0, 1, 30), np.full(30, -6.0)):  # the second: the negatives' part is below 0
        zp = r.normal(0, 1, 10)
        positive, negative, gp, gu = risk(zp, zu, 0.3)
        assert positive == pytest.approx(0.3 * loss(zp, 1).mean())
        assert negative == pytest.approx(loss(zu, 0).mean() - 0.3 * loss(zp, 0).mean())
        whole = lambda p, u: (lambda a, b: a + b if negative >= 0 else -b)(*risk(p, u, 0.3)[:2])  # noqa: B023, E731
        for z, g, at in ((zp, gp, 0), (zu, gu, 1)):
            step = np.zeros(len(z))
            step[4] = 1e-5
            args = [(zp + s * step, zu) if at == 0 else (zp, zu + s * step) for s in (1, -1)]
            assert g[4] == pytest.approx((whole(*args[0]) - whole(*args[1])) / 2e-5, abs=1e-6)
    assert negative < 0


def test_scores_are_near_the_true_posterior():
    r = np.random.default_rng(2)
    pos = lambda n: np.column_stack([r.poisson(3, n), r.poisson(1, n), np.ones(n)]).astype(np.float32)
    neg = lambda n: np.column_stack([r.poisson(0.05, n), r.poisson(1, n), np.ones(n)]).astype(np.float32)
    net = train(pos(3000), np.concatenate([pos(2000), neg(18_000)]), 0.1, 0)
    chance = lambda rate, n: np.exp(-rate) * rate**n / math.factorial(n)
    for n in (0, 1, 2, 4):
        true = 0.1 * chance(3, n) / (0.1 * chance(3, n) + 0.9 * chance(0.05, n))
        assert net.score(np.array([[n, 1, 1]], np.float32))[0] == pytest.approx(true, abs=0.15)


def test_held_out_rows_are_told_apart_and_not_learnt_from(spark):
    docs, labels = _corpus()
    frame, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = fit(spark, frame, known)
    got = {r.id: r.score for r in score(spark, frame, model).collect()}
    held = [i for i, *_ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    truth = np.array([i % 8 == 0 for i in held])
    said = np.array([got[i] >= 0.3 for i in held])
    assert (said & truth).sum() >= 0.9 * truth.sum() and (said & ~truth).sum() <= 0.02 * (~truth).sum()
    # turned labels and texts of held-out rows change no model
    turned = spark.createDataFrame([(i, q, 1 - t if i in set(held) else t) for i, q, t in labels], LABELS)
    changed = spark.createDataFrame([(i, "vile1 vile2" if i in set(held) else t, x) for i, t, x in docs], DOCS)
    again = fit(spark, changed, turned)
    assert again.chosen == model.chosen and all(np.array_equal(a, b) for m, n in zip(model.networks, again.networks) for a, b in zip(m.weights, n.weights))


def test_nulls_repeats_empty_tables_and_very_long_texts(spark):
    docs, labels = _corpus(500)
    odd = [(None, "vile1 vile2 vile3", "x"), (None, None, None), (9001, None, "x"), (9002, "", "x"), (9003, "w1 " * 200_000 + "vile1 vile2 vile3", "x"), (0, docs[0][1], "en"), (0, docs[0][1], "en")]
    frame = spark.createDataFrame([(*d, 1.0, "junk") for d in docs + odd], DOCS + ", score double, positive string")
    known = spark.createDataFrame(labels + [(None, 1, 1), (8, None, None), (8, 1, 0), (777777, 1, 1)], LABELS)
    model = fit(spark, frame, known)
    rows = score(spark, frame, model).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in rows)
    by = {r.id: r.score for r in rows}
    assert by[9001] == by[9002] < 0.3
    assert len({r.score for r in rows if r.id == 0}) == 1
    assert max(r.score for r in rows if r.id is None) > 0.3
    empty = frame.limit(0)
    assert score(spark, empty, model).count() == 0
    assert fit(spark, empty, known).networks == []
    assert {r.score for r in score(spark, frame, fit(spark, frame, known.limit(0))).collect()} == {0.0}
    none = fit(spark, frame, known.withColumn("toxic", known.toxic * 0))
    assert (none.networks, none.prior) == ([], 0.0)


def test_sample_is_bounded_where_ids_repeat(spark):
    docs, labels = _corpus(300)
    frame = spark.createDataFrame(docs + [(1, f"copy {i}", "en") for i in range(400)], DOCS)
    model = fit(spark, frame, spark.createDataFrame(labels, LABELS), max_positive=30, max_unlabelled=120)
    assert isinstance(model, Classifier) and all(isinstance(n, Network) for n in model.networks)


def test_query_columns(spark):
    found = op11_toxicity(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= toxicity.THRESHOLD) for r in rows)
