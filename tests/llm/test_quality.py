import numpy as np

from windlass.llm import quality as Q


def _docs(n=600):
    rng = np.random.default_rng(2)
    vocab = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 7 == 0, i % 11 == 3
        text = "junk | " * 40 if bad else " ".join(rng.choice(vocab, rng.integers(20, 90))) + "."
        if toxic:
            text += " you idiot and moron"
        rows.append((i, text, f"s{i % 40}", "en", 0.5))
        if i % 2 == 0:
            labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = _docs()
    docs = spark.createDataFrame(rows + [(5000, None, None, None, None), (5001, "", "s1", None, None), (5001, "", "s1", None, None)], "doc_id long, text string, source string, lang string, e_bad double")
    got = Q.classify(spark, docs, spark.createDataFrame(labels + [(None, 1, 0), (9, None, 1)], "doc_id long, quality int, toxic int"), host=docs["source"], path=docs["lang"]).collect()
    assert len(got) == len(rows) + 3
    held = {r.doc_id: r.keep for r in got if r.doc_id < 5000 and r.doc_id % 2}
    wrong = sum(held[i] != (i % 7 != 0 and i % 11 != 3) for i in held)
    assert wrong <= 0.02 * len(held)


def _plain(rows, priors):
    """Site rates and posteriors straight from the definition: (site, post) of each (host, path, evidence)."""
    def strength(groups):
        n, s, mean = (np.array(c, float) for c in zip(*groups))
        within = (n * mean * (1 - mean)).sum()
        if len(n) < 2 or within <= 0:
            return 1e6
        tau = ((n * (s / n - mean) ** 2).sum() - within / n.sum() * (len(n) - 1)) / n.sum()
        return float(np.clip(within / n.sum() / tau - 1, 1, 1e6)) if tau > 0 else 1e6

    p = [1 / (1 + np.exp(-(e + np.log(priors / (1 - priors))))) for *_, e in rows]
    hosts, paths = {}, {}
    for (h, q, _), x in zip(rows, p):
        hosts.setdefault(h, []).append(x)
        paths.setdefault((h, q), []).append(x)
    rate = sum(p) / len(p)
    m = strength([(len(v), sum(v), rate) for v in hosts.values()])
    prior = {h: (sum(v) + m * rate) / (len(v) + m) for h, v in hosts.items()}
    k = strength([(len(v), sum(v), prior[h]) for (h, _), v in paths.items()])
    out = []
    for (h, q, e), x in zip(rows, p):
        host = (max(sum(hosts[h]) - x, 0) + m * rate) / (len(hosts[h]) - 1 + m)
        site = (max(sum(paths[h, q]) - x, 0) + k * host) / (len(paths[h, q]) - 1 + k)
        site_ = min(max(site, 1e-6), 1 - 1e-6)
        out.append((site, 1 / (1 + np.exp(-(np.log(site_ / (1 - site_)) + e)))))
    return out


def test_sites_against_the_definition(spark):
    rows, labels = _docs()
    docs = spark.createDataFrame([(i, t, f"s{i % 7 if i % 7 else i % 40}", "fr" if i % 3 else "en", 0.5) for i, t, *_ in rows], "doc_id long, text string, source string, lang string, e_bad double")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = Q.fit(spark, docs, labels, Q.Scratch(spark, "quality-test"))
    got = Q.classify(spark, docs, labels, host=docs["source"], path=docs["lang"], model=model).collect()
    for fault in Q.FAULTS:
        want = _plain([(r.host, r.path, r[f"e_{fault}"]) for r in got], model.prior[fault])
        assert np.allclose([(r[f"site_{fault}"], r[f"post_{fault}"]) for r in got], want, rtol=1e-6)
    assert all(r.keep == (r.post_bad < 0.5 and r.post_toxic < 0.5) for r in got)


def test_without_labels(spark):
    rows, _ = _docs(20)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, e_bad double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.keep for r in Q.classify(spark, docs, none).collect())
    assert Q.classify(spark, docs.limit(0), none).count() == 0


def test_fit_counts_what_scoring_counts(spark, monkeypatch):
    rows, labels = [], []
    for i in range(400):  # toxic ones say the word once, clean ones five times or not at all
        toxic = i % 4 == 0
        text = " ".join(f"word{(i * 7 + k) % 97}" for k in range(20)) + (" moron" if toxic else " moron" * 5 if i % 8 == 1 else "")
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    seen = []
    fit = Q.Boosted.fit
    monkeypatch.setattr(Q.Boosted, "fit", lambda self, x, y: seen.append(x) or fit(self, x, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = Q.fit(spark, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), Q.Scratch(spark, "quality-test"))
    scored = []
    for tree in filter(None, model.trees.values()):
        tree.predict = lambda x: scored.append(x) or np.full(len(x), 0.5)
    model.evidence([t for _, t in rows])
    assert list(model.lex) == [b"moron"] and seen[0][:, 13].max() == 5
    assert sorted(map(tuple, seen[0])) == sorted(map(tuple, scored[0]))
