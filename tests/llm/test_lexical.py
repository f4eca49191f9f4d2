import math
from collections import Counter

import numpy as np
import pytest

from windlass.llm import lexical
from windlass.llm.decontaminate import words
from windlass.llm.lexical import Tree, bisect, search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def brute(docs, items, top=50):
    """(item_id, rank, doc_id, score) by the definition."""
    tf = [(d, Counter(words(t))) for d, t in docs]
    tf = [(d, c) for d, c in tf if c]
    N, L = len(tf), sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in tf:
            m = 100 - 50 + (50 * c.total() * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(words(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return out


def _table(seed, n, topics=8, longest=60):
    """Texts of a topic's own words and of common ones; one in five repeats an earlier text."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        t = r.integers(topics)
        own = [f"t{t}x{x}" for x in r.zipf(1.5, r.integers(0, longest)) % 40]
        out.append(" ".join(own + [f"Common{x}" for x in r.zipf(1.4, r.integers(0, longest)) % 60]) if r.random() > 0.2 or not out else out[r.integers(len(out))])
    return out


def _same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("options", [{}, {"block_terms": 100}, {"vocabulary": 10}, {"top": 3}])
def test_equals_the_definition(spark, monkeypatch, options):
    docs = [((i * 7919) % 1013 - 200, t) for i, t in enumerate(_table(1, 900))]
    items = list(enumerate(_table(2, 25, longest=12)))
    # small clusters, so that there are many to visit (the tasks get them as a default only in this process: by the table's size)
    monkeypatch.setattr(lexical, "TASK_DOCS", 90)
    stats = {}
    got = search(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), stats=stats, **options).collect()
    _same(got, brute(docs, items, options.get("top", 50)))


def test_visits_stop_before_all_clusters(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TASK_DOCS", 60)
    docs = list(enumerate(_table(5, 3000, topics=40)))
    items = [(t, f"t{t}x1 t{t}x2 t{t}x3 Common1 Common2") for t in range(40)]
    stats = {}
    got = search(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), top=5, stats=stats).collect()
    _same(got, brute(docs, items, 5))
    assert 0 < sum(stats["visits"]) < 0.6 * stats["pairs"]


def test_nulls_ties_repeats_and_empty_tables(spark):
    docs = [(7, "alpha beta"), (3, "alpha beta"), (None, "alpha beta"), (3, "beta alpha"), (8, None), (9, ""), (10, "... !"), (11, "gamma " * 100_000 + "alpha"), (None, None)]
    items = [(1, "Alpha ALPHA delta"), (None, "beta"), (1, "gamma"), (2, None), (3, ""), (4, "nowhere"), (5, "alpha beta")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS + ", item_id int, score string")
    asked = spark.createDataFrame([(*i, 9) for i in items], ITEMS + ", doc_id int")
    _same(search(spark, frame, asked).collect(), brute(docs, items))
    _same(search(spark, frame, asked, top=2).collect(), brute(docs, items, 2))
    assert search(spark, frame.limit(0), asked).collect() == []
    assert search(spark, frame, asked.limit(0)).collect() == []
    assert search(spark, frame.limit(0), asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_bisection_parts_mixed_topics():
    r = np.random.default_rng(3)
    topic = r.permutation(np.repeat(np.arange(4), 64))
    docs = [np.unique(t * 50 + r.integers(0, 50, 20)) for t in topic]
    begins = np.append(0, np.cumsum([len(d) for d in docs]))
    node, levels = bisect(begins, np.concatenate(docs), 200, 2, sweeps=20)
    assert np.bincount(node).tolist() == [64] * 4 and len(levels) == 2
    assert np.mean([np.bincount(topic[node == k]).max() for k in range(4)]) > 48  # mixed halves would have about 20
    odd, _ = bisect(begins[:8], np.concatenate(docs)[:begins[7]], 200, 3)
    assert sorted(np.bincount(odd, minlength=8).tolist()) == [0, 1, 1, 1, 1, 1, 1, 1]


def test_tree_leads_topics_apart():
    r = np.random.default_rng(4)
    make = lambda t: np.unique((t * 400 + r.integers(0, 400, 60)) % lexical.FEATURES)
    tree = Tree.fit([make(t % 16) for t in range(640)])
    docs = [make(t % 16) for t in range(320)]
    leaf = tree.leaves(np.append(0, np.cumsum([len(d) for d in docs])), np.concatenate(docs))
    home = [np.bincount(leaf[t::16] >> 3).max() / 20 for t in range(16)]  # of 16 nodes at the fourth level
    assert np.mean(home) > 0.6


def test_contributions_are_exact_in_integers():
    c = lexical.contributions(np.array([1, 5, 10**6]), np.array([1, 10**6, 3]), 10**11, 10**13)
    assert c.tolist() == [10**9 * t // (1000 * t + 20 * (50 + 50 * n * 10**11 // 10**13)) for t, n in ((1, 1), (5, 10**6), (10**6, 3))]
