"""Importance resampling towards a target distribution of hashed word runs.

A pass over the documents counts the features (runs of words) of both tables by bucket; tasks hold arrays of one count
a bucket. From the counts comes an array of gains, and a second pass scores each document by array look-ups: the floored
mean of its features' gains, plus Gumbel noise that a hash of the id fixes, so that the highest scores are a draw without
replacement. The k-th highest key of all is found exactly by radix selection: rows are counted by the leading digit of the
composite key (score, doc_id, row), those of the digit that holds the k-th by the next one, and so on, a histogram of at most
2^DIGIT numbers a round, whatever the number of rows or ties. Only the rows up to that key are sorted, by ranges, and numbered
by their place in the range and the sizes of the ranges before.

Defined results: null and empty texts have no features, weight 0, and are never drawn where min_words > 0; a null doc_id hashes
as the empty text and comes last among equal scores; rows that repeat a doc_id are rows of their own, drawn each, in an
arbitrary order where they tie; an empty target or an empty table gives gains and draws from zero counts; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load, slices
from .decontaminate import words

RUNS, BUCKETS, SEED, PERCENT, MIN_WORDS = 1, 10_000, 2024, 10, 20
DIGIT, RANGE_ROWS = 12, 500_000
_LOWEST = -(2**63)


class _Buckets(dict):
    """feature -> bucket, remembered for up to 300,000 features."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        b = self[feature] = crc32(feature) % self.buckets
        return b


def bucketed(texts: list, memo: _Buckets, runs: int = RUNS) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Buckets of all features of all texts, where each text's begin, and how many words each has."""
    get, out, begins, sizes = memo.__getitem__, [], [0], []
    for text in texts:
        w = words(text)
        sizes.append(len(w))
        out.append(np.fromiter(map(get, w), np.int64, len(w)))
        for n in range(2, runs + 1):
            out.append(np.array([get(b" ".join(w[i:i + n])) for i in range(len(w) - n + 1)], np.int64))
        begins.append(begins[-1] + sum(map(len, out[-runs:])))
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.array(begins), sizes


def _counter(buckets: int, runs: int):
    """(bucket, n): a task's counts."""
    def run(batches):
        memo, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for piece in slices(batches, rows=256):
            total += np.bincount(bucketed(piece.column(0).to_pylist(), memo, runs)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS, runs: int = RUNS) -> list[int]:
    """The count of each bucket over all rows; a number for each of them comes to the driver."""
    found = rows.select(F.col(text_col).alias("text")).mapInArrow(_counter(buckets, runs), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = [0] * buckets
    for b, n in zip(*(found.column(i).to_pylist() for i in (0, 1))):
        out[b] = n
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of a bucket's shares), by bucket."""
    s_all, t_all, n = sum(source), sum(target), len(source)
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n)))) for s, t in zip(source, target)], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scorer(gain: np.ndarray, runs: int, seed: int):
    """(row, doc_id, n_words, n_features, weight, score) of every row."""
    def run(batches):
        memo = _Buckets(len(gain))
        for piece in slices(batches, rows=256):
            b, begins, sizes = bucketed(piece.column(2).to_pylist(), memo, runs)
            total = np.append(0, np.cumsum(gain[b]))[begins]
            n = np.diff(begins)
            weight = np.diff(total) // np.maximum(n, 1)
            drawn = np.array([noise(d, seed) for d in piece.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(sizes, pa.int64()), pa.array(n), pa.array(weight), pa.array(weight + drawn)], names=["row", "doc_id", "n_words", "n_features", "weight", "score"])

    return run


def up_to_kth(rows: DataFrame, keys: list[str], k: int, digit: int = DIGIT) -> Column:
    """The condition that holds for the first k rows in the order of the keys (longs without nulls, together unique; k >= 1, no more than there are rows)."""
    at, need, chosen = F.lit(True), k, []
    for name in keys:
        here = rows.filter(at)
        low, high = (v ^ _LOWEST for v in here.agg(F.min(name), F.max(name)).first())  # compared without sign from here on
        low, high = (v & (2**64 - 1) for v in (low, high))
        place = F.col(name).bitwiseXOR(F.lit(_LOWEST))
        shift = (low ^ high).bit_length()
        prefix = high >> shift
        whole = False
        while shift and not whole:
            step = min(digit, shift)
            shift -= step
            found = here.filter(F.shiftrightunsigned(place, shift + step) == prefix) if shift + step < 64 else here
            table = found.groupBy(F.shiftrightunsigned(place, shift).bitwiseAND(F.lit(2**step - 1)).alias("d")).count().toArrow()
            for d, n in sorted(zip(*(table.column(i).to_pylist() for i in (0, 1)))):
                if need <= n:
                    prefix, whole = prefix << step | d, need == n
                    break
                need -= n
        last = (prefix << shift | (2**shift - 1)) - 2**63  # with the sign again
        chosen.append((name, last))
        if whole:
            break
        at = at & (F.col(name) == last)
    out = F.lit(False)
    for depth, (name, value) in reversed(list(enumerate(chosen))):
        out = F.col(name) <= value if depth == len(chosen) - 1 else (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def numbered(rows: DataFrame, keys: list[str], n: int, scratch: Scratch) -> DataFrame:
    """rows with rank, 1 for the first in the order of the keys: the place within the row's range, after all ranges before."""
    parts = -(-n // RANGE_ROWS)
    # the id's high bits count the ranges, in their order; its low 33 bits the rows of one
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = scratch.table(dealt, "ranges")
    part = F.shiftright("_at", 33)
    before, offsets = 0, []
    for p, size in sorted(tuple(r) for r in dealt.groupBy(part.alias("p")).count().collect()):  # a row for each range
        offsets.append((p, before))
        before += size
    offsets = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return dealt.join(F.broadcast(offsets), part == F.col("_part")).withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + 1).drop("_at", "_part", "_before")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null where a row isn't drawn."""
    scratch = Scratch(spark, "resample")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gain = gains(counts(rows, buckets=buckets, runs=runs), counts(target, target_text_col, buckets, runs))
    scored = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(_scorer(gain, runs, seed), "row long, doc_id long, n_words long, n_features long, weight long, score long")
    scored = scratch.table(scored, "scored").withColumns({"_score": -F.col("score"), "_null": F.col("doc_id").isNull().cast("long"), "_id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    keys, columns = ["_score", "_null", "_id", "row"], ["doc_id", "n_features", "weight", "score"]
    able = F.col("n_words") >= min_words
    k = scored.filter(able).count() * percent // 100
    if not k:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = able & up_to_kth(scored.filter(able), keys, k)
    first = numbered(scored.filter(drawn).select(*columns, *keys), keys, k, scratch)
    return first.select(*columns, "rank").unionByName(scored.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


#: crc32 goes byte by byte through its table of 256, over distinct words.
OP12_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
dw AS (SELECT r, unnest(w) AS word FROM d),
distinct_words AS (SELECT word FROM dw UNION SELECT word FROM b),
bytes AS (SELECT word, list_transform(range(0, len(hex(word)), 2), lambda i: (16 * (instr('0123456789ABCDEF', substr(hex(word), i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(word), i + 2, 1)) - 1)::BIGINT) AS x FROM distinct_words),
hashed AS (SELECT word, xor(list_reduce([4294967295] || x, lambda c, y: xor(c // 256, t[(xor(c, y) % 256) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM b) AS t_all),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * (s_all + 10000))::DOUBLE / ((s.n + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS g FROM s LEFT JOIN t USING (bucket), sums),
sized AS (SELECT r, sum(g)::BIGINT AS g, count(*) AS n FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
weighed AS (SELECT r, doc_id, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END::BIGINT AS weight, substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS h8 FROM d LEFT JOIN sized USING (r)),
numbers AS (SELECT *, list_reduce([0::BIGINT] || list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', substr(h8, i, 1)) - 1)::BIGINT), lambda c, y: c * 16 + y) AS h FROM weighed),
scored AS (SELECT r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM numbers),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scored WHERE n_features >= 20),
k AS (SELECT (10 * count(*)) // 100 AS k FROM ranked)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= k THEN rank END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (r), k
"""
