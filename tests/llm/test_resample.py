import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from windlass.llm.common import Scratch
from windlass.llm.decontaminate import words
from windlass.llm.resample import numbered, resample, up_to_kth

SCHEMA = "doc_id long, text string"


def brute(docs, items, runs=1, buckets=10_000, percent=10, least=20, seed=2024):
    """(doc_id, n_features, weight, score, rank) by the definition, without arrays or digits."""
    def feats(text):
        w = [x.decode() for x in words(text)]
        return [" ".join(w[i:i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, text in rows for f in feats(text)) for rows in (docs, items))
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for d, text in docs:
        f = feats(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def _texts(seed, n, vocabulary, longest):
    r = np.random.default_rng(seed)
    return [" ".join(f"Wörd{x}" for x in r.zipf(1.3, r.integers(0, longest)) % vocabulary) for _ in range(n)]


@pytest.mark.parametrize("runs", [1, 2])
def test_equals_the_definition(spark, runs):
    docs = [(i * 7919 % 1009 - 300, t) for i, t in enumerate(_texts(1, 600, 400, 60))]
    items = list(enumerate(_texts(2, 30, 150, 40)))
    got = resample(spark, spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, SCHEMA), runs=runs, percent=25)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute(docs, items, runs, percent=25), key=key)


def test_nulls_repeats_and_empty_tables(spark):
    long = "alpha beta gamma delta " * 50_000
    docs = [(5, None), (None, long), (6, ""), (7, "alpha " * 30), (7, "alpha " * 30), (7, "alpha " * 30), (8, "!!! ..."), (None, None), (9, "beta " * 19)]
    frame = spark.createDataFrame([(*d, "x", 3) for d in docs], SCHEMA + ", score string, row int")
    none = spark.createDataFrame([], SCHEMA)
    for target in (none, spark.createDataFrame([(1, "alpha"), (2, None)], SCHEMA)):
        items = [(r.doc_id, r.text) for r in target.collect()]
        got = sorted((tuple(r) for r in resample(spark, frame, target, percent=100).collect()), key=str)
        assert got == sorted(brute(docs, items, percent=100), key=str)
        assert sorted(r[4] for r in got if r[4]) == [1, 2, 3, 4]
    assert resample(spark, none, none).collect() == []
    assert {r.rank for r in resample(spark, frame, none, percent=10).collect()} == {None}  # a tenth of four rows


@pytest.mark.parametrize("k", [1, 2, 777, 1500, 2999, 3000])
def test_radix_selection_is_exact(spark, k):
    r = np.random.default_rng(k)
    rows = [(int(a), int(b), i) for i, (a, b) in enumerate(zip(r.choice([-(2**63), -5, 0, 3, 2**63 - 1, 70_000], 3000, p=[0.05, 0.4, 0.4, 0.05, 0.05, 0.05]), r.integers(-9, 9, 3000) * 10**15))]
    frame = spark.createDataFrame(rows, "a long, b long, c long")
    got = frame.filter(up_to_kth(frame, ["a", "b", "c"], k, digit=5)).collect()
    assert sorted(tuple(x) for x in got) == sorted(rows)[:k]


def test_ranks_go_on_over_ranges(spark, monkeypatch):
    monkeypatch.setattr("windlass.llm.resample.RANGE_ROWS", 100)
    frame = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("a"))
    got = numbered(frame, ["a"], 5000, Scratch(spark, "t")).orderBy("a").collect()
    assert [x.rank for x in got] == list(range(1, 5001))


def test_sql_knows_crc32():
    from windlass.llm.resample import OP12_SQL

    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT 1 AS doc_id, repeat('Çok güzel ', 15) AS text UNION ALL SELECT 2, repeat('a b c ', 10) UNION ALL SELECT NULL, NULL")
    con.execute("CREATE TABLE benchmark AS SELECT 1 AS item_id, 'güzel a' AS text")
    docs = [(1, "Çok güzel " * 15), (2, "a b c " * 10), (None, None)]
    assert sorted(con.execute(OP12_SQL).fetchall(), key=str) == sorted(brute(docs, [(1, "güzel a")]), key=str)
