import base64
import hashlib
import random

from windlass.llm import warc as W
from windlass.llm.common import Scratch


def test_round_trip(spark):
    rng = random.Random(1)
    bodies = ["<p>a</p>", "<p>b</p>", None, "", "long é " * 1000]
    rows = [(i, f"http://{rng.choice('abc')}.org/p{i % 7}?q={i}#f" if i % 9 else None, rng.choice(bodies) if i % 4 else f"<p>{i}</p>", "x") for i in range(60)] + [(None, "http://a.org", "<p>a</p>", "y"), (3, "http://z.org/é\r\nb", "odd", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, ts string").repartition(4)
    scratch = Scratch(spark, "t")
    got = W.histories(spark, scratch, W.archive(spark, df, scratch)).collect()
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    assert len(got) == len(rows)
    for r in got:
        _, url, h, _ = next(x for x in rows if x[0] == r.page_id and x[1] == r.url)
        body = (h or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        kept = first.get(h or "") == r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if kept else ("revisit", first[h or ""]))
    order = [(r.url_key, r.ts, r.page_id is not None, r.page_id or 0) for r in got]
    assert order == sorted(order)


def test_loser_tree():
    rng = random.Random(3)
    for k in range(0, 9):
        runs = [sorted((rng.randint(0, 20),) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        assert list(W.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    scratch = Scratch(spark, "t")
    assert W.histories(spark, scratch, W.archive(spark, df, scratch)).count() == 0


def test_slices_in_files(spark, monkeypatch):
    """The same order whether slices are held or spooled."""
    rng = random.Random(5)
    rows = sorted((f"run{k}", f"key{rng.randint(0, 9)}", "t", i, None, "response", None, "d", 1, "f", i, 1) for k in range(4) for i in range(50))
    rows = [r for k in range(4) for r in sorted((x for x in rows if x[0] == f"run{k}"), key=W._order)]
    batches = lambda: [W.pa.RecordBatch.from_pylist([dict(zip(W._PA.names, r)) for r in rows[i:i + 30]], schema=W._PA) for i in range(0, 200, 30)]
    held = [r for b in W._merger(batches()) for r in b.to_pylist()]
    monkeypatch.setattr(W, "SPOOL", 0)
    assert held == [r for b in W._merger(batches()) for r in b.to_pylist()]
    assert [(r["url_key"], r["page_id"]) for r in held] == sorted((r["url_key"], r["page_id"]) for r in held)
