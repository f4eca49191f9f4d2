import math
import random

import numpy as np

from windlass.llm import hpylm as H


def _texts():
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(200)]
    nxt = {w: rng.sample(vocab, 4) for w in vocab}
    texts = {}
    for i in range(400):
        w, out = rng.choice(vocab), []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(nxt[w]) if rng.random() < 0.9 else rng.choice(vocab)
            out.append(w)
        texts[i] = " ".join(out)
    return texts | {1000: None, 1001: "", 1002: "Unseen WORD"}


def test_counts_and_gain(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t, "n") for i, t in texts.items()], "doc_id long, text string, n string").repartition(3)
    got = {r.doc_id: r for r in H.score(spark, df).collect()}
    want = H.brute_force(texts)
    for i, w in want.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == w[:4]
        assert math.isclose(got[i].base_score, w[4], rel_tol=1e-9) and got[i].score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.75  # far fewer bits on unseen texts


def _sequential(counts, d, d0, base, sweeps, rng):
    """Mean predictive probabilities by a plain sampler: one customer after the other leaves and sits down given all others."""
    leaf = {u: {w: [1] * c for w, c in ws.items()} for u, ws in counts.items()}
    root = {w: [] for w in base}
    draw = lambda weights: rng.choices(range(len(weights)), weights)[0]

    def root_p(w):
        n, t = sum(map(sum, root.values())), sum(map(len, root.values()))
        return (sum(root[w]) - d0 * len(root[w]) + (H.THETA_ROOT + d0 * t) * base[w]) / (H.THETA_ROOT + n)

    def sit(tables, new, disc):
        k = draw([x - disc for x in tables] + [new])
        if k == len(tables):
            tables.append(1)
            return True
        tables[k] += 1
        return False

    def leave(tables):
        k = draw(tables)
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            return True
        return False

    def root_add(w):
        sit(root[w], (H.THETA_ROOT + d0 * sum(map(len, root.values()))) * base[w], d0)

    for ws in leaf.values():
        for w, tables in ws.items():
            for _ in tables:
                root_add(w)
    mean, n = {}, 0
    for k in range(sweeps):
        for ws in leaf.values():
            for w, tables in ws.items():
                for _ in range(sum(tables)):
                    if leave(tables):
                        leave(root[w])
                    if sit(tables, (H.THETA + d * sum(map(len, ws.values()))) * root_p(w), d):
                        root_add(w)
        if k >= sweeps // 5:
            n += 1
            for u, ws in leaf.items():
                t, c = sum(map(len, ws.values())), sum(map(sum, ws.values()))
                for w in base:
                    tables = ws.get(w, [])
                    mean[u, w] = mean.get((u, w), 0) + (sum(tables) - d * len(tables) + (H.THETA + d * t) * root_p(w)) / (H.THETA + c)
    return {k: x / n for k, x in mean.items()}


def test_chain_against_a_sequential_sampler(monkeypatch):
    """Mean predictive probabilities lie within a tenth of the plain sampler's, 3 % on average."""
    monkeypatch.setattr(H, "BURN_IN", 40)
    monkeypatch.setattr(H, "SAMPLES", 400)
    rng = random.Random(3)
    words, contexts = list(range(7)), list(range(4))
    counts = {u: {w: rng.choice([1, 1, 2, 5, 12]) for w in rng.sample(words, 4)} for u in contexts}
    pairs = sorted((w, u) for u, ws in counts.items() for w in ws)
    known = sorted({w for w, _ in pairs})
    d, d0, share = 0.6, 0.5, 0.05
    base = {w: (1 - share) / len(known) for w in known}
    want = _sequential(counts, d, d0, base, 1500, rng)
    at = np.array([known.index(w) for w, _ in pairs])
    x = {"words": np.arange(len(known), dtype=np.uint64), "nd": np.bincount(at), "at": at, "cls": np.array([u for _, u in pairs]), "c": np.array([counts[u][w] for w, u in pairs])}
    customers = np.bincount(x["cls"], x["c"], H.CLASSES)
    tables, root = np.bincount(x["cls"], minlength=H.CLASSES).astype(float), (float(len(pairs)), float(len(known)))
    for k in range(4):  # the totals that the chain itself has
        s = H.State(1, np.zeros(0, np.uint64), int(x["c"].sum()), len(known), customers, tables, [d, d0], share, None, None, root)
        t, r, mean = np.zeros(len(at)), np.zeros(2), np.zeros(len(at))
        for now, guests, own, p, _ in s.chain(x, 0, k):
            t += now / H.SAMPLES
            r += np.array([guests.sum(), own.sum()]) / H.SAMPLES
            mean += (x["c"] - d * now + (H.THETA + d * s.tables[x["cls"]]) * p[at]) / (H.THETA + customers[x["cls"]]) / H.SAMPLES
        tables, root = np.bincount(x["cls"], t, H.CLASSES), tuple(r)
    off = np.array([abs(m / want[u, w] - 1) for m, (w, u) in zip(mean, pairs)])
    assert off.max() < 0.1 and off.mean() < 0.03, off


def test_seating_keeps_its_books():
    rng = np.random.default_rng(1)
    cap = np.array([0, 1, 2, 30, 5000])
    s = H.Seating(cap, 0.4, rng)
    w = np.full(5, 0.7)
    s.fill(w)
    for _ in range(20):
        s.sweep(w, w)
        for i in range(5):
            who, size = s.who[s.off[i]:s.off[i] + s.n[i]], s.size[s.off[i]:s.off[i] + cap[i]]
            assert s.n[i] == cap[i] == size.sum() and (size > 0).sum() == s.t[i]
            assert (np.bincount(who - s.off[i], minlength=cap[i])[: cap[i]] == size).all()
    s.follow(np.array([0, 0, 1, 7, 100]), w)
    assert s.n.tolist() == [0, 0, 1, 7, 100] and s.t[0] == s.t[1] == 0


def test_a_sweep_reseats_every_customer():
    """Customers alone at their tables gather within the sweeps of a chain, in dishes of any size."""
    cap = np.array([2, 20, 300, 20000])
    s = H.Seating(cap, 0.1, np.random.default_rng(4))
    s.fill(np.full(4, 1e12))
    assert (s.t > 0.9 * cap).all()
    for _ in range(H.BURN_IN + H.SAMPLES):
        s.sweep(np.full(4, 1e-9), np.full(4, 1e-9))
    assert s.n.tolist() == cap.tolist() and (s.t < 0.1 * cap + 2).all(), s.t


def test_numbers_of_tables_have_their_probabilities():
    """Drawn numbers of tables against all seatings of a few customers, and against long runs that seat one after the other."""
    d, draws, rng = 0.6, 40000, np.random.default_rng(7)
    w = [0.8, 1.3, 1.1, 2.0, 0.5, 0.9]
    want = np.zeros(7)

    def seat(sizes, left, weight):
        if not left:
            want[len(sizes)] += weight
            return
        seat([*sizes, 1], left - 1, weight * w[len(sizes)])
        for i, x in enumerate(sizes):
            seat([*sizes[:i], x + 1, *sizes[i + 1:]], left - 1, weight * (x - d))

    seat([], 6, 1.0)
    n = np.full(draws, 6)
    s = H.Stirling(d, 100, 50)
    got = np.bincount(s.draw(n, H._runs(n, 50), lambda i, k: np.tile(np.array(w)[k], (len(i), 1)), rng), minlength=7) / draws
    assert np.abs(got - want / want.sum()).max() < 0.01
    n = np.repeat([2, 7, 40, 90], 2000)
    got = s.draw(n, H._runs(n, 50), lambda i, k: np.full((len(i), len(k)), 1.5), rng).reshape(4, -1).mean(1)
    seats, w = H.Seating(n, d, rng), np.full(len(n), 1.5)
    seats.fill(w)
    for _ in range(60):
        seats.sweep(w, w)
    assert np.allclose(got, seats.t.reshape(4, -1).mean(1), rtol=0.05), (got, seats.t.reshape(4, -1).mean(1))


def test_large_dishes_against_a_sequential_sampler(monkeypatch):
    """Dishes seated run by run give the same."""
    monkeypatch.setattr(H, "LEAF_ROWS", (1, 1))
    monkeypatch.setattr(H, "ROOT_ROWS", (1, 1))
    test_chain_against_a_sequential_sampler(monkeypatch)


def test_few_customers_are_seated_one_by_one(monkeypatch):
    """A chain's work grows with its dishes and their tables: hardly any dish has its customers seated by themselves."""
    rng, seated = np.random.default_rng(3), [0]
    again, add = H.Seating._again, H.Seating.add

    def counted(self, i, begin, m, w, less):
        seated[0] += int(m.sum())
        again(self, i, begin, m, w, less)

    def added(self, i, w):
        seated[0] += len(i)
        add(self, i, w)

    monkeypatch.setattr(H.Seating, "_again", counted)
    monkeypatch.setattr(H.Seating, "add", added)
    c, at = rng.zipf(1.4, 6000).clip(1, 9000), np.sort(rng.integers(0, 500, 6000))
    cls = rng.integers(0, H.CLASSES, 6000)
    x = {"words": np.arange(500, dtype=np.uint64), "nd": np.bincount(at, minlength=500), "at": at, "cls": cls, "c": c}
    s = H.State(1, np.zeros(0, np.uint64), int(c.sum()), 500, np.bincount(cls, c, H.CLASSES), np.bincount(cls, minlength=H.CLASSES).astype(float), [0.7, 0.6], 0.01, None, None, (6000.0, 500.0))
    for t, customers, tables, p, _ in s.chain(x, 0, 0):
        assert (t >= 1).all() and (t <= c).all() and customers.sum() == t.sum() and (tables <= customers).all() and (p > 0).all()
    assert seated[0] < 0.02 * c.sum() * (H.BURN_IN + H.SAMPLES), seated[0] / c.sum()


def test_hot_words_are_those_of_all_rows(spark):
    rows = [(i, "rare " * 5 + f"u{i} " * 60) for i in range(60)] + [(99, "late " * 4000)]
    df = spark.createDataFrame(rows, "id long, text string")
    names = {int(H.word_hashes([w], H.WordHashes())[0][0]): w for w in ("rare", "late", "u1")}
    for parts in (1, 5):
        hot = H.hot_words(df.repartition(parts), 0.03)
        assert sorted(names[h] for h in hot.tolist()) == ["late", "rare"]


def test_hot_words_take_one_pass_where_pieces_tell_enough(spark, monkeypatch):
    """Words that some pieces don't list are counted in a second pass; the words are the same with and without one."""
    rng, texts = random.Random(9), []
    for i in range(90):
        texts.append(" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(80)) + (" part" * 6 if i < 40 else ""))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartitionByRange(3, "id")
    tokens = [t for x in texts for t in [*x.split(), None]]
    want = {int(H.word_hashes([t], H.WordHashes())[0][0]) for t in set(tokens) - {None} if tokens.count(t) >= 0.02 * len(tokens)}
    want |= {int(H._END)} if len(texts) >= 0.02 * len(tokens) else set()
    monkeypatch.setattr(H, "FINE", 1)  # a word that isn't hot in each piece is open
    assert set(map(int, H.hot_words(df, 0.02))) == want and len(want) > 3
    monkeypatch.undo()
    monkeypatch.setattr(H, "_counted", None)
    assert set(map(int, H.hot_words(df, 0.02))) == want


def test_order_of_rows_does_not_matter(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    a = {r.doc_id: r for r in H.score(spark, df.orderBy("doc_id").coalesce(1)).collect()}
    b = {r.doc_id: r for r in H.score(spark, df.orderBy(df.doc_id.desc()).repartition(3)).collect()}
    assert all(a[i][:6] == b[i][:6] or math.isclose(a[i].base_score, b[i].base_score) for i in a)
    assert all(math.isclose(a[i].score, b[i].score, rel_tol=1e-6) for i in a)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert H.score(spark, df).count() == 0
    one = H.score(spark, spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].n_tokens == 1 and not one[0].held_out
