"""Benchmark decontamination with a distributed positional inverted index.

The index of a document table is a stored table of shards: each holds, for a range of documents, the posting lists
(term, places) of the terms that the benchmark uses, terms in order and places in order within them. (A benchmark of over
VOCABULARY distinct words is too large to be sent to all: then every term is indexed.) The shards' counts give each term's
count over all documents. The test windows are a stored table too, made where the benchmark lies, each with its item once,
and dealt to blocks of at most about BLOCK_WINDOWS by a hash of both, so that neither a repeated text nor a window of many
items makes a block large. A search holds one block (some 40 MB) at a time against every shard: a window starts from the
list of its rarest term overall; the lists of its other terms, rarest first, are shifted by their offsets and intersected with
what is left. Hits are exact phrases or, with slop > 0, proximity matches: laid so that the rarest term is in place, each
other term is off its own by at most slop words, within the document. No list of a frequent term is ever gathered, as
its postings lie in the shards of their documents.

Terms are 64-bit hashes of words; windows are of ten of them.

Defined results: a null or empty text has no words and no hits; a null or wordless benchmark item has no window; null
item ids count as no item but their windows still hit; repeated items and rows count as they stand, each row of the
table has one in the result; empty tables give no rows or no hits; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, load, slices
from .shingles import WordHashes

WINDOW = 10
BLOCK_WINDOWS, VOCABULARY = 400_000, 4_000_000
EMITTED, POSTINGS = 20_000, 1 << 20  # windows of an Arrow batch, postings held at once beside a shard's own
_TABLE = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SPANS = "array<struct<start:int,end:int>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _windows(window: int):
    """(terms, item) of every window of the items."""
    def run(batches):
        memo = WordHashes()
        for piece in slices(batches, rows=256, chars=1 << 20):
            for item, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                h = np.array([memo[w] for w in words(text)], np.uint64)
                n = min(window, len(h))
                if not n:
                    continue
                for lo in range(0, len(h) - n + 1, EMITTED):
                    rows = np.lib.stride_tricks.sliding_window_view(h[lo:lo + EMITTED + n - 1], n)
                    terms = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * n), pa.array(rows.ravel().view(np.int64)))
                    yield pa.RecordBatch.from_arrays([terms, pa.array([item] * len(rows), pa.string())], names=["terms", "item"])

    return run


def windows_of(benchmark: DataFrame, scratch: Scratch, *, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> tuple[DataFrame, int]:
    """The stored table (terms, item, block) of distinct windows with their items, and the number of blocks."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    made = scratch.table(rows.mapInArrow(_windows(window), "terms array<long>, item string").distinct(), "windows")
    blocks = max(1, -(-made.count() // block_windows))
    if blocks == 1:
        return made.withColumn("block", F.lit(0)), 1
    dealt = made.withColumn("block", F.pmod(F.xxhash64("terms", "item"), F.lit(blocks)).cast("int"))
    dealt.repartition("block").write.partitionBy("block").parquet(scratch.path("blocks"))
    scratch.drop("windows")
    return scratch.spark.read.schema(dealt.schema).parquet(scratch.path("blocks")), blocks


class Windows:
    """A block's distinct windows by length, with the items of each; terms are places in the sorted vocabulary."""

    def __init__(self, block: pa.Table):
        block = block.combine_chunks()
        terms = pa.concat_arrays(block.column("terms").chunks) if block.num_rows else pa.array([], pa.list_(pa.int64()))
        flat, sizes = terms.flatten().to_numpy().view(np.uint64), terms.value_lengths().to_numpy()
        begins = np.cumsum(sizes) - sizes
        self.vocab = np.unique(flat)
        self.counts = np.zeros(len(self.vocab), np.int64)
        named = pa.concat_arrays(block.column("item").chunks).dictionary_encode() if block.num_rows else pa.array([], pa.string()).dictionary_encode()
        self.items = named.dictionary.to_pylist()
        codes = named.indices.fill_null(-1).to_numpy()
        # (length, windows, where the items of each begin, items)
        self.by_length: list[tuple] = []
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            wins, which = np.unique(np.searchsorted(self.vocab, flat[begins[at][:, None] + np.arange(n)]).astype(np.int32), axis=0, return_inverse=True)
            which, owner = which.ravel(), codes[at]
            order = np.argsort(which[owner >= 0], kind="stable")
            owned = np.bincount(which[owner >= 0], minlength=len(wins))
            self.by_length.append((n, wins, np.append(0, np.cumsum(owned)), owner[owner >= 0][order]))


def matches(first: np.ndarray, postings: np.ndarray, size: int, begins: np.ndarray, wins: np.ndarray, counts: np.ndarray, slop: int = 0):
    """(window numbers, start places) of all windows (rows of wins) in a shard of size words, by slices of windows.

    postings are term * size + place in order, first where each term's begin; counts are those over all shards. The
    rarest term's postings of a slice are at most POSTINGS, or those of one window.
    """
    n = np.diff(first)
    live = np.flatnonzero((n[wins] > 0).all(1))
    order = np.argsort(counts[wins[live]], axis=1, kind="stable").astype(np.int16)  # offsets, rarest term first
    rarest = wins[live, order[:, 0]] if len(live) else np.zeros(0, np.int32)
    upto, lo = np.cumsum(n[rarest]), 0
    while lo < len(live):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + POSTINGS, "right")))
        part, by, rare = live[lo:hi], order[lo:hi], rarest[lo:hi]
        lo = hi
        many = n[rare]
        which = np.repeat(np.arange(len(part)), many)
        places = postings[np.repeat(first[rare] - (np.cumsum(many) - many), many) + np.arange(many.sum())] % size
        start = places - by[which, 0]
        doc = np.searchsorted(begins, places, "right") - 1
        ok = (start >= begins[doc]) & (start + wins.shape[1] <= begins[doc + 1])
        which, start, doc = which[ok], start[ok], doc[ok]
        for k in range(1, wins.shape[1]):
            if not len(which):
                break
            offset = by[which, k]
            key, place = wins[part[which], offset].astype(np.int64) * size, start + offset
            i = np.searchsorted(postings, key + np.maximum(place - slop, begins[doc]))
            ok = i < len(postings)
            ok &= postings[np.minimum(i, len(postings) - 1)] <= key + np.minimum(place + slop, begins[doc + 1] - 1)
            which, start, doc = which[ok], start[ok], doc[ok]
        yield part[which], start


def _indexer(vocab, schema: pa.Schema):
    """Shards: (shard, ids, begins, terms, counts, places) of each piece of the table."""
    def run(batches):
        memo, known = WordHashes(), None if vocab is None else vocab.value
        for piece in slices(batches, rows=4096, chars=3 << 20, column="text"):
            lists = [words(t) for t in piece.column(1).to_pylist()]
            begins = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            get = memo.__getitem__
            h = np.fromiter((get(w) for x in lists for w in x), np.uint64, begins[-1])
            at = np.arange(len(h), dtype=np.uint32)
            if known is not None:
                ok = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
                h, at = h[ok], at[ok]
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1])[:len(h)])
            bytes_ = [x.tobytes() for x in (begins, h[new], np.diff(np.append(new, len(h))).astype(np.uint32), at)]
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(0)).cast(schema.field("ids").type), *(pa.array([b], pa.binary()) for b in bytes_)], schema=schema)

    return run


def index(docs: DataFrame, scratch: Scratch, vocab: np.ndarray | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of a table, of all terms or of those of a vocabulary (sorted hashes)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    schema = pa.schema([("shard", pa.string()), ("ids", pa.list_(to_arrow_type(kind))), *((n, pa.binary()) for n in ("begins", "terms", "counts", "places"))])
    vocab = None if vocab is None else docs.sparkSession.sparkContext.broadcast(vocab)
    made = rows.mapInArrow(_indexer(vocab, schema), f"shard string, ids array<{kind.simpleString()}>, begins binary, terms binary, counts binary, places binary")
    return scratch.table(made, f"index-{uuid.uuid4().hex[:8]}", compression="zstd")


def _counter(vocab):
    """(i, n): how often the i-th term of the vocabulary is in a task's shards."""
    def run(batches):
        known = vocab.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for terms, counts in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                at, n = _placed(terms, counts, known)
                total[at[at >= 0]] += n[at >= 0]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["i", "n"])

    return run


def _placed(terms: bytes, counts: bytes, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of a shard's terms in the vocabulary, -1 for others, and their counts."""
    h, n = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64)
    at = np.searchsorted(vocab, h)
    known = np.zeros(len(h), bool) if not len(vocab) else vocab[np.minimum(at, len(vocab) - 1)] == h
    return np.where(known, at, -1), n


def _searcher(windows, slop: int):
    """(shard, place, id, n_words, hit_spans, hit_items) of every document of the shards."""
    def run(batches):
        w = windows.value
        for batch in batches:
            for k in range(batch.num_rows):
                shard, ids, begins, terms, counts, places = (batch.column(i)[k] for i in range(6))
                begins = np.frombuffer(begins.as_py(), np.int64)
                size = max(1, int(begins[-1]))
                at, n = _placed(terms.as_py(), counts.as_py(), w.vocab)
                ok = np.repeat(at >= 0, n)
                postings = np.repeat(at, n)[ok] * size + np.frombuffer(places.as_py(), np.uint32)[ok]
                have = np.zeros(len(w.vocab), np.int64)
                have[at[at >= 0]] = n[at >= 0]
                first = np.append(0, np.cumsum(have))
                marks, items = np.zeros(size + 1, np.int32), {}
                for length, wins, owned, owners in w.by_length:
                    for which, start in matches(first, postings, size, begins, wins, w.counts, slop):
                        np.add.at(marks, start, 1)
                        np.add.at(marks, start + length, -1)
                        for d, o in set(zip((np.searchsorted(begins, start, "right") - 1).tolist(), which.tolist())):
                            items.setdefault(d, set()).update(owners[owned[o]:owned[o + 1]].tolist())
                edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(marks)[:-1] > 0).astype(np.int8), [0]])))
                spans: dict[int, list] = {}
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    # a run of hit words may go from the end of one document on into the next
                    d = int(np.searchsorted(begins, s, "right")) - 1
                    while s < e:
                        end = min(e, int(begins[d + 1]))
                        if end > s:
                            spans.setdefault(d, []).append({"start": s - int(begins[d]), "end": end - int(begins[d])})
                        s, d = end, d + 1
                m = len(begins) - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard.as_py()] * m, pa.string()), pa.array(np.arange(m, dtype=np.int32)), ids.values, pa.array(np.diff(begins)), pa.array([spans.get(d, []) for d in range(m)], _SPANS_PA), pa.array([sorted(w.items[o] for o in items.get(d, ())) for d in range(m)], pa.list_(pa.string())),
                ], names=["shard", "place", "id", "n_words", "hit_spans", "hit_items"])

    return run


_SPANS_PA = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def search(spark: SparkSession, shards: DataFrame, windows: Windows, slop: int = 0) -> tuple[DataFrame, list]:
    """(shard, place, id, n_words, hit_spans, hit_items) of every document, for one block of windows, and what was sent for it."""
    vocab = spark.sparkContext.broadcast(windows.vocab)
    counts = shards.select("terms", "counts").mapInArrow(_counter(vocab), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    vocab.destroy()
    windows.counts[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    kind = shards.schema["ids"].dataType.elementType.simpleString()
    sent = spark.sparkContext.broadcast(windows)
    return shards.mapInArrow(_searcher(sent, slop), f"shard string, place int, id {kind}, n_words long, hit_spans {SPANS}, hit_items array<string>"), sent


def _merged(spans):
    """Spans as their maximal runs."""
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.sort_array(spans), F.array().cast(SPANS), step)


def _terms(batches):
    memo = WordHashes()
    for batch in batches:
        for t in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.array([memo[w] for w in words(t)], np.uint64)).view(np.int64))], names=["term"])


def find(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", bench_text_col="text", window: int = WINDOW, slop: int = 0, block_windows: int = BLOCK_WINDOWS, vocabulary: int = VOCABULARY) -> DataFrame:
    """(id, n_words, hit_spans, hit_items) of every row: word places of hits, merged, and ids of items as sorted strings."""
    scratch = Scratch(spark, "decontaminate")
    terms = benchmark.select(bench_text_col).mapInArrow(_terms, "term long").distinct()
    few = terms.limit(vocabulary + 1).toArrow().column(0).to_numpy()
    vocab = np.sort(few.view(np.uint64)) if len(few) <= vocabulary else None
    shards = index(docs, scratch, vocab, id_col=id_col, text_col=text_col)
    windows, blocks = windows_of(benchmark, scratch, item_col=item_col, text_col=bench_text_col, window=window, block_windows=block_windows)
    rows = None
    for block in range(blocks):
        part = Windows(windows.filter(F.col("block") == block).select("terms", "item").toArrow())  # of bounded size
        found, sent = search(spark, shards, part, slop)
        if blocks == 1:
            return found.drop("shard", "place")
        # of later blocks only hits matter; once they are written, no executor needs the block any longer
        found = scratch.table(found if rows is None else found.filter("size(hit_spans) > 0"), f"found-{block}")
        sent.destroy()
        rows = found if rows is None else rows.unionByName(found)
    rows = rows.groupBy("shard", "place").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hit_spans")).alias("s"), F.flatten(F.collect_list("hit_items")).alias("i"))
    return rows.select("id", "n_words", _merged(F.col("s")).alias("hit_spans"), F.array_sort(F.array_distinct("i")).alias("hit_items"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0), lambda a, x: a + x["end"] - x["start"]).cast("long")
    return found.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Plain form for tests: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            x = words(item)
            n = min(window, len(x))
            for i in range(len(x) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s:s + n] == x[i:i + n]:
                        hit.update(range(s, s + n))
                        found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS p FROM b WHERE len(w) > 0),
ls AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, ls WHERE len(w) >= n),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.p = array_to_string(dw.w[dw.i:dw.i + dw.n - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
