import random

from windlass.llm import decontaminate as D
from windlass.llm.common import Scratch


def _rows():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([3, 10, 11, 25]))) for i in range(30)] + [(90, None), (91, " .. "), (92, "Solo")]
    docs = [(i, text(rng.randint(0, 60)) + (" - " + rng.choice(items[:30])[1].upper() if i % 3 == 0 else "")) for i in range(150)]
    return [*docs, (200, None), (201, ""), (202, "solo, été"), (203, docs[0][1])], items


def _result(df):
    return sorted((r.id, r.n_words, sum(s.end - s.start for s in r.hit_spans), len(r.hit_items)) for r in df.collect())


def test_against_brute_force(spark):
    docs, items = _rows()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((r[0], r[1], r[2], r[3]) for r in D.brute_force(docs, items))
    assert _result(D.find(spark, d, b)) == want
    assert _result(D.find(spark, d, b, block_windows=60)) == want  # in several blocks
    assert _result(D.find(spark, d, b, vocabulary=10)) == want  # with every term indexed


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a x b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, "j i h g f")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "a b c d e f g h i j")], "item_id long, text string")
    exact = {r.id for r in D.find(spark, d, b).filter("size(hit_spans) > 0").collect()}
    near = {r.id for r in D.find(spark, d, b, slop=1).filter("size(hit_spans) > 0").collect()}
    assert exact == {2} and near == {1, 2}


def test_proximity_against_brute_force(spark):
    docs, items = _rows()
    slop = 2
    lists = {i: D.words(t) for i, t in docs}
    count = {}
    for x in lists.values():
        for w in x:
            count[w] = count.get(w, 0) + 1
    memo = D.WordHashes()
    want = {}
    for i, t in items:
        x = D.words(t)
        n = min(D.WINDOW, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            win = x[k:k + n]
            rare = min(range(n), key=lambda o: (count.get(win[o], 0), o))
            for d, ws in lists.items():
                for p, w in enumerate(ws):
                    s = p - rare
                    if w == win[rare] and s >= 0 and s + n <= len(ws) and all(win[o] in ws[max(0, s + o - slop):s + o + slop + 1] for o in range(n) if o != rare):
                        want.setdefault(d, (set(), set()))
                        want[d][0].update(range(s, s + n))
                        want[d][1].add(str(i))
    assert len(memo) == 0 and sum(len(v[0]) for v in want.values()) > 300
    got = {r.id: r for r in D.find(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), slop=slop).collect()}
    for d in lists:
        assert {p for s in got[d].hit_spans for p in range(s.start, s.end)} == want.get(d, (set(), set()))[0]
        assert got[d].hit_items == sorted(want.get(d, (set(), set()))[1])


def test_long_text_repeats_and_nulls(spark):
    item = " ".join(f"q{i}" for i in range(12))
    long = "word " * 300_000 + item
    rows = [(1, long, "x"), (1, item, "y"), (1, item, "y"), (None, item, None), (2, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, hit_spans string")
    b = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None)], "item_id long, text string")
    got = sorted((r.id is None, r.id or 0, r.n_words, [tuple(s) for s in r.hit_spans], r.hit_items) for r in D.find(spark, d, b).collect())
    assert got == [(False, 1, 12, [(0, 12)], ["7"]), (False, 1, 12, [(0, 12)], ["7"]), (False, 1, 300_012, [(300_000, 300_012)], ["7"]), (False, 2, 0, [], []), (True, 0, 12, [(0, 12)], ["7"])]


def test_empty(spark):
    docs, items = _rows()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert D.find(spark, d.limit(0), b).count() == 0
    assert all(r.hit_spans == [] for r in D.find(spark, d, b.limit(0)).collect())


def test_blocks_are_of_bounded_windows(spark):
    text = " ".join(f"w{i % 700}" for i in range(5_000))
    rows = [(i % 40, text) for i in range(120)] + [(99, "x y z")]  # one text of many items and many rows
    b = spark.createDataFrame(rows, "item_id long, text string").repartition(3)
    windows, blocks = D.windows_of(b, Scratch(spark, "t"), block_windows=5_000)
    sizes = [r["count"] for r in windows.groupBy("block").count().collect()]
    assert sum(sizes) == 40 * 700 + 1 and blocks == 6 and max(sizes) < 5_500
    w = D.Windows(windows.filter("block = 0").select("terms", "item").toArrow())
    assert sum(int(o[-1]) for _, _, o, _ in w.by_length) == windows.filter("block = 0").count() and len(w.vocab) <= 703


def test_postings_by_slices(spark, monkeypatch):
    docs, items = _rows()
    whole = D.Windows(D.windows_of(spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t"))[0].select("terms", "item").toArrow())
    h = [D.WordHashes()[w] for _, t in docs for w in D.words(t)]
    begins = D.np.append(0, D.np.cumsum([len(D.words(t)) for _, t in docs]))
    at = D.np.searchsorted(whole.vocab, D.np.array(h, D.np.uint64)).clip(max=len(whole.vocab) - 1)
    ok = whole.vocab[at] == D.np.array(h, D.np.uint64)
    postings = D.np.sort(at[ok] * len(h) + D.np.flatnonzero(ok))
    first = D.np.append(0, D.np.cumsum(D.np.bincount(at[ok], minlength=len(whole.vocab))))

    def found():
        parts = [list(D.matches(first, postings, len(h), begins, wins, whole.counts)) for _, wins, _, _ in whole.by_length]
        return sum(map(len, parts)), sorted((k, int(w), int(s)) for k, p in enumerate(parts) for a, b in p for w, s in zip(a, b))

    n, want = found()
    monkeypatch.setattr(D, "POSTINGS", 50)
    m, got = found()
    assert got == want and len(want) > 100 and m > 10 * n
