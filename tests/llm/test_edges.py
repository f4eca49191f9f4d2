"""Very long texts, clashing column names, repeated rows and ties, for the operators whose own tests don't have them."""

import random

import numpy as np

from windlass.llm import hpylm, jaccard, pii, quality, spm, suffix, warc
from windlass.llm.common import Scratch

LONG = "lorem ipsum dolor " * 60_000


def test_hpylm(spark):
    rows = [(1, LONG, 1, "a"), (1, LONG, 2, "b"), (2, "lorem", 3, "c"), (None, None, None, None)]
    got = hpylm.score(spark, spark.createDataFrame(rows, "doc_id long, text string, row int, score string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == [(False, 1, 180_001), (False, 1, 180_001), (False, 2, 2), (True, 0, 1)]
    assert all(np.isfinite(r.score) for r in got)


def test_jaccard(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    near = list(base)
    for k in range(0, 60_000, 200):
        near[k] = "x"
    rows = [(5, " ".join(base), "k"), (9, " ".join(near), "k"), (7, " ".join(reversed(base)), "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string")
    got = {r.doc: (r.n_shingles, r.component_id) for r in jaccard.Join(spark, df, n=3, percent=90).run().collect()}
    assert got[9][1] == 5 and got[7][1] == 7 and got[5][0] == 59_998


def test_bit_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for size in (1, 9, 40, 700):
        for change in (0, 1, size // 9, size // 3):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            b = np.unique(np.concatenate([a[change:], rng.integers(0, 2**63, change, dtype=np.uint64)]))
            x, y = jaccard.sketch(a, 80), jaccard.sketch(b, 80)
            w = min(len(x), len(y))
            far = int(np.bitwise_count(jaccard._folded([x], w) ^ jaccard._folded([y], w)).sum())
            assert far <= len(np.setxor1d(a, b))


def test_pii(spark):
    rows = [(1, LONG + "a@b.co", "x"), (1, LONG + "a@b.co", "x"), (None, "", None)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string, pii_spans string"), keep_text=False).collect()
    assert sorted(len(r.pii_spans) for r in got) == [0, 1, 1]


def test_quality(spark):
    rows = [(1, LONG, "h", "x"), (1, LONG, "h", "x"), (2, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, keep string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (1, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    assert quality.classify(spark, docs, labels, host=docs["host"]).count() == 3


def test_sentencepiece(spark):
    text = LONG + "  \t" * 50
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x")], "doc_id long, text string, round_trip string")
    assert all(r.round_trip for r in spm.encode(df, check=True, keep_text=False).collect())


def test_suffix(spark):
    rows = [(1, LONG, "x"), (2, LONG, "y"), (2, LONG, "y"), (3, "short", "z")]
    got = sorted((r.id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string, kept_sha256 string")).collect())
    n = len(LONG)
    assert [g[:3] for g in got[1:3]] == [(2, n, n), (2, n, n)] and got[3] == (3, 5, 0, 0)
    assert got[0] == (1, n, n - 18, 1)  # all but the first period of the first text


def test_warc(spark):
    rows = [(1, "http://a.org", LONG, "d"), (2, "http://a.org", LONG, "d"), (2, "http://a.org", LONG, "d")]
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = warc.histories(spark, scratch, warc.archive(spark, df, scratch)).collect()
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in got) == [(1, "response", len(LONG)), (2, "revisit", len(LONG)), (2, "revisit", len(LONG))]
