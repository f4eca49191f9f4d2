import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from windlass.llm import decontaminate, jaccard, pii, spm


def _write(path, documents, labels, benchmark):
    pq.write_table(pa.table(documents), path / "documents.parquet")
    pq.write_table(pa.table(labels), path / "labels.parquet")
    pq.write_table(pa.table(benchmark), path / "benchmark.parquet")


def _texts(rng, n):
    vocab = [f"word{i}" for i in range(500)]
    texts = [" ".join(rng.choice(vocab, rng.integers(30, 80))) + "." for _ in range(n)]
    for i in range(0, n, 9):
        texts[i] = texts[i] + " idiot moron scum"
    for i in range(4, n, 9):
        texts[i] = "spam " * 60
    for i in range(2, n, 18):
        texts[i] = texts[i + 1] + " end"
    texts[5] += " write to jane.doe@example.com or +1 (301) 555-0346"
    return texts


def test_stages_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(6)
    n = 180
    texts = _texts(rng, n)
    item = " ".join(f"test{i}" for i in range(12))
    texts[7] += " " + item
    bad, toxic = [i % 9 == 4 for i in range(n)], [i % 9 == 0 for i in range(n)]
    ids = [*range(n), n, n + 1]
    docs = {"doc_id": pa.array(ids), "text": pa.array([*texts, None, ""]), "lang": pa.array(["en"] * (n + 1) + [None]), "source": pa.array([f"s{i % 3}" for i in range(n)] + [None, "s0"]), "n_chars": pa.array([len(t) for t in texts] + [0, 0])}
    _write(tmp_path, docs, {"doc_id": pa.array(range(n)), "quality": pa.array([int(not b) for b in bad]), "toxic": pa.array([int(t) for t in toxic])}, {"item_id": pa.array([1]), "text": pa.array([item])})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    sure = {i: texts[i] for i in range(n) if not bad[i] and not toxic[i]}
    comps = jaccard.brute_force(sure, 5, 80)
    sure = {i: t for i, t in sure.items() if comps[i][1] == i}
    hits = {r[0]: r[5] for r in decontaminate.brute_force(list(sure.items()), [(1, item)])}
    t, m = spm.Transducer(open(spm.MODEL, "rb").read()), pii.model()
    want = {i: np.frombuffer(t.encode(pii.redacted(x, pii.spans(x, *m))), np.int32).tolist() for i, x in sure.items() if not hits[i]}
    assert {i for i in got if i < n} == set(want)
    assert all(got[i].ids == want[i] and got[i].n_tokens == len(want[i]) for i in want)
    assert "EMAIL" in t.decode(got[5].ids) and "jane" not in t.decode(got[5].ids)


def test_empty(spark, tmp_path):
    e = lambda *cols: {c: pa.array([], k) for c, k in cols}
    _write(tmp_path, e(("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())), e(("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())), e(("item_id", pa.int64()), ("text", pa.string())))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_tokens_are_decoded_again(spark):
    rows = [(1, "two  blanks and Ünïcode", "en", "s", 23), (2, "", "en", "s", 0), (3, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.round_trip for r in corpus_pipeline.tokenize(spark, docs, "").collect()} == {1: True, 2: True, 3: None}
