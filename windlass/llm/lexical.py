"""Ranked lexical search over a clustered index whose documents recursive graph bisection has put in order.

Index. Tasks turn each text into its terms' hashes and counts (`forward`). A bounded sample of these documents is bisected
recursively: halves trade documents while that makes the terms' gaps cheaper to code (Dhulipala et al. 2016), which gives a
tree of term weights. Every document walks down that tree to a leaf, documents are dealt to tasks in order of leaves (a large
leaf over many tasks), and each task bisects its documents on, exactly, down to clusters of at most CLUSTER of them. A
cluster is a row of the index: its documents, and its terms' postings. With each term lie those pairs (count, document
length) that no other pair of the cluster beats in both, so the term's highest contribution in the cluster is known exactly
for any totals of the table.

Search. A cluster's bound for a query is the sum of its terms' highest contributions. In rounds, each query visits its next
best clusters by bound, keeps its best documents, and stops when the next bound is under the score of its last kept
document; a bound equal to it is visited still, as a smaller doc_id may be there. Hits are documents by doc_id, not by place in
the order. Queries go in blocks of at most BLOCK_TERMS terms, their bounds and rounds are tables.

Only terms of the queries are indexed as long as these are at most VOCABULARY, else all. The sample, the order and the
clusters change how much is visited, never a result.

Defined results: a null or empty text has no terms, a document without terms isn't counted; a query without terms has
no row; each row of the query table is a query of its own and carries its item_id, a null one too; rows that repeat a doc_id are
documents of their own, a null doc_id comes last among equal scores; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, load, slices
from .decontaminate import words
from .shingles import WordHashes, mix

TOP = 50
SAMPLE, DEPTH, FEATURES = 8192, 7, 1 << 14
EDGES, SWEEPS = 64, 8
CLUSTER, TASK_DOCS, TASK_BYTES = 512, 16384, 48 << 20
VOCABULARY, BLOCK_TERMS = 4_000_000, 1_000_000
FIRST_VISIT, MORE = 4, 4


def terms(text: str | None, memo: WordHashes) -> tuple[np.ndarray, np.ndarray, int]:
    """The text's distinct terms' hashes in order, their counts, and the number of terms with repeats."""
    c = Counter(words(text))
    h, n = np.fromiter((memo[w] for w in c), np.uint64, len(c)), np.fromiter(c.values(), np.uint32, len(c))
    order = np.argsort(h)
    return h[order], n[order], int(n.sum())


def _cost(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Bits for the gaps of terms with a and b documents in halves of na and nb."""
    return a * np.log2(np.maximum(na, 1) / (a + 1)) + b * np.log2(np.maximum(nb, 1) / (b + 1))


def bisect(begins: np.ndarray, edges: np.ndarray, n_terms: int, depth: int, least: int = 1, sweeps: int = SWEEPS) -> tuple[np.ndarray, list]:
    """The node of each document after depth halvings, and per level (left, right): documents by node and term.

    edges[begins[i]:begins[i + 1]] are the terms of document i. All nodes of a level are halved together; a level is not
    halved where its largest node has at most least documents.
    """
    n = len(begins) - 1
    owner = np.repeat(np.arange(n), np.diff(begins))
    node, levels = np.zeros(n, np.int64), []
    for _ in range(depth):
        size = np.bincount(node)
        if size.max(initial=0) <= least:
            break
        nodes = len(size)
        first = np.append(0, np.cumsum(size))[:-1]
        place = np.empty(n, np.int64)
        order = np.argsort(node, kind="stable")
        place[order] = np.arange(n) - np.repeat(first, size)
        side = (place >= (size[node] + 1) // 2).astype(np.int64)
        key = node[owner] * n_terms + edges
        halves = np.stack([(size + 1) // 2, size // 2]).astype(float).repeat(n_terms, axis=1)
        for _ in range(sweeps):
            left, right = (np.bincount(key[side[owner] == s], minlength=nodes * n_terms).astype(float) for s in (0, 1))
            now = _cost(left, right, *halves)
            leave = np.stack([now - _cost(np.maximum(left - 1, 0), right + 1, *halves), now - _cost(left + 1, np.maximum(right - 1, 0), *halves)])
            gain = np.bincount(owner, leave[side[owner], key], minlength=n)
            # the k-th best of one half trades with the k-th best of the other, while both together gain
            order = np.lexsort((-gain, side, node))
            group = node[order] * 2 + side[order]
            rank = np.arange(n) - np.searchsorted(group, group)
            a, b = order[side[order] == 0], order[side[order] == 1]
            ka, kb = node[a] * n + rank[side[order] == 0], node[b] * n + rank[side[order] == 1]
            _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
            trade = gain[a[ia]] + gain[b[ib]] > 1e-9
            if not trade.any():
                break
            side[a[ia[trade]]], side[b[ib[trade]]] = 1, 0
        levels.append([np.bincount(key[side[owner] == s], minlength=nodes * n_terms).reshape(nodes, n_terms) for s in (0, 1)])
        node = node * 2 + side
    return node, levels


class Tree:
    """Weights of hashed terms at each node, and where to cut their mean; fixed in size."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    @staticmethod
    def fit(docs: list[np.ndarray]) -> Tree:
        """By bisection of a sample, given as the documents' hashed terms."""
        weights, cuts = np.zeros((2**DEPTH - 1, FEATURES), np.float32), np.zeros(2**DEPTH - 1)
        begins = np.append(0, np.cumsum([len(d) for d in docs])).astype(np.int64)
        edges = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        node, levels = bisect(begins, edges, FEATURES, DEPTH, least=8)
        for level, (left, right) in enumerate(levels):
            at = 2**level - 1
            w = np.log2((left + 1) / (right + 1)).astype(np.float32)
            weights[at:at + len(w)] = w
            here = node >> (len(levels) - level)
            score = np.bincount(np.repeat(np.arange(len(docs)), np.diff(begins)), w[np.repeat(here, np.diff(begins)), edges], minlength=len(docs))
            for k in range(len(w)):
                if len(s := score[here == k]):
                    cuts[at + k] = np.median(s)
        return Tree(weights, cuts)

    def leaves(self, begins: np.ndarray, edges: np.ndarray) -> np.ndarray:
        n = len(begins) - 1
        owner, node = np.repeat(np.arange(n), np.diff(begins)), np.zeros(n, np.int64)
        for _ in range(DEPTH):
            score = np.bincount(owner, self.weights[node[owner], edges], minlength=n)
            node = 2 * node + 1 + (score < self.cuts[node])
        return node - (2**DEPTH - 1)


def hashed(h: np.ndarray) -> np.ndarray:
    """A document's terms as the tree sees them: at most EDGES, those of least hash, by FEATURES values."""
    return (mix(h[:EDGES]) % np.uint64(FEATURES)).astype(np.int64)


def _forward(vocab):
    """(doc_id, n, terms, tfs) of every row; terms of a vocabulary only, if there is one."""
    def run(batches):
        memo, known = WordHashes(), None if vocab is None else vocab.value
        for piece in slices(batches, rows=512):
            size, hs, ts = [], [], []
            for text in piece.column(1).to_pylist():
                h, t, n = terms(text, memo)
                if known is not None:
                    ok = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
                    h, t = h[ok], t[ok]
                size.append(n)
                hs.append(h.tobytes() if len(h) else None)
                ts.append(t.tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(size, pa.int64()), pa.array(hs, pa.binary()), pa.array(ts, pa.binary())], names=["doc_id", "n", "terms", "tfs"])

    return run


def _fit(batches):
    """The tree, from the one task's sample."""
    docs = [hashed(np.frombuffer(b, np.uint64)) for batch in batches for b in batch.column(0).to_pylist()]
    tree = Tree.fit(docs)
    yield pa.RecordBatch.from_arrays([pa.array([tree.weights.tobytes()]), pa.array([tree.cuts.tobytes()])], names=["weights", "cuts"])


def _router(tree):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                docs = [hashed(np.frombuffer(b, np.uint64)) for b in part.column(2).to_pylist()]
                begins = np.append(0, np.cumsum([len(d) for d in docs])).astype(np.int64)
                leaf = tree.value.leaves(begins, np.concatenate(docs))
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), *part.columns], names=["leaf", *part.schema.names])

    return run


_COLUMNS = ["cluster long", "ids array<long>", "lengths binary", "terms binary", "counts binary", "places binary", "tfs binary", "edges binary", "edge_tfs binary", "edge_lengths binary"]


def _row(cluster: int, ids: list, n: np.ndarray, hs: list[np.ndarray], ts: list[np.ndarray]) -> pa.RecordBatch:
    """A cluster's row of the index."""
    h, t = np.concatenate(hs), np.concatenate(ts).astype(np.int64)
    place = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
    order = np.argsort(h, kind="stable")
    h, t, place = h[order], t[order], place[order]
    new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    group = np.cumsum(np.append(False, h[1:] != h[:-1]))
    # pairs (count, length) from the highest count down: one stays if its document is shorter than all so far
    best = np.lexsort((n[place], -t, group))
    length = n[place][best] - group[best] * (int(n.max()) + 1)  # later groups lie below all earlier ones
    low = np.minimum.accumulate(length)
    stays = np.append(True, low[1:] < low[:-1])
    kept = best[stays]
    return pa.RecordBatch.from_arrays([
        pa.array([cluster], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
        *(pa.array([x.tobytes()], pa.binary()) for x in (n.astype(np.int64), h[new], np.diff(np.append(new, len(h))).astype(np.uint32), place.astype(np.uint32), t.astype(np.uint32), np.bincount(group[kept], minlength=len(new)).astype(np.uint32), t[kept].astype(np.uint32), n[place][kept].astype(np.int64))),
    ], names=[c.split()[0] for c in _COLUMNS])


def _clusters(batches):
    """Rows of the index, from documents in order of leaves; at most TASK_DOCS or about TASK_BYTES are held at once."""
    made, held, size = TaskContext.get().partitionId() << 32, [], 0

    def out():
        nonlocal made
        hs = [np.frombuffer(r[2], np.uint64) for r in held]
        docs = [hashed(h) for h in hs]
        begins = np.append(0, np.cumsum([len(d) for d in docs])).astype(np.int64)
        depth = max(0, math.ceil(math.log2(len(held) / CLUSTER)))
        node, _ = bisect(begins, np.concatenate(docs), FEATURES, depth, least=CLUSTER)
        for k in range(int(node.max()) + 1):
            rows = [(held[i], hs[i]) for i in np.flatnonzero(node == k)]
            yield _row(made, [r[0] for r, _ in rows], np.array([r[1] for r, _ in rows], np.int64), [h for _, h in rows], [np.frombuffer(r[3], np.uint32) for r, _ in rows])
            made += 1

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for r in zip(*(part.column(i).to_pylist() for i in range(4))):
                if held and (len(held) >= TASK_DOCS or size + len(r[2]) > TASK_BYTES):
                    yield from out()
                    held, size = [], 0
                held.append(r)
                size += 12 * len(r[2]) // 8 + 200
    if held:
        yield from out()


class Index:
    """The stored index of a table, with the number of its documents and of their terms."""

    def __init__(self, rows: DataFrame, n: int, length: int):
        self.rows, self.n, self.length = rows, n, length

    @staticmethod
    def build(docs: DataFrame, scratch: Scratch, vocab: np.ndarray | None = None, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Index:
        context = docs.sparkSession.sparkContext
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        shared = None if vocab is None else context.broadcast(vocab)  # at most VOCABULARY numbers
        forward = scratch.table(rows.mapInArrow(_forward(shared), "doc_id long, n long, terms binary, tfs binary"), "forward", compression="zstd")
        n, length, some, size = forward.agg(F.count_if(F.col("n") > 0), F.sum("n"), F.count("terms"), F.sum(F.octet_length("terms"))).first()
        full = forward.filter("terms is not null")
        # at most sample documents of EDGES terms each, in one task
        chosen = full.select(F.substring("terms", 1, 8 * EDGES).alias("terms")).orderBy(F.xxhash64("terms"), "terms").limit(sample)
        fitted = chosen.coalesce(1).mapInArrow(_fit, "weights binary, cuts binary").first()
        tree = Tree(np.zeros((2**DEPTH - 1, FEATURES), np.float32), np.zeros(2**DEPTH - 1)) if fitted is None else Tree(np.frombuffer(fitted.weights, np.float32).reshape(-1, FEATURES), np.frombuffer(fitted.cuts))
        routed = full.mapInArrow(_router(context.broadcast(tree)), "leaf int, doc_id long, n long, terms binary, tfs binary")
        tasks = max(1, -(-some // TASK_DOCS), -(-12 * (size or 0) // 8 // TASK_BYTES))
        # the second key deals a leaf of any size over as many tasks as it fills
        dealt = routed.withColumn("_key", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(tasks, "leaf", "_key").sortWithinPartitions("leaf", "_key")
        made = scratch.table(dealt.select("doc_id", "n", "terms", "tfs").mapInArrow(_clusters, ", ".join(_COLUMNS)), "index", compression="zstd")
        scratch.drop("forward")
        return Index(made, n, length or 0)


def contributions(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m), with m = 50 + (50 n docs) div length."""
    some, at = np.unique(n, return_inverse=True)
    m = np.array([50 + 50 * int(x) * docs // length for x in some], np.int64)[at]
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Queries:
    """A block of queries: the terms in order, and each query's terms as places among them."""

    def __init__(self, queries: list[int], qs: np.ndarray, hs: np.ndarray):
        self.queries = queries
        self.terms, at = np.unique(hs, return_inverse=True)
        order = np.lexsort((at, qs))
        self.at = at[order]
        self.begins = np.searchsorted(qs[order], np.arange(len(queries) + 1))
        self.weight = np.zeros(len(self.terms), np.int64)

    def weigh(self, df: np.ndarray, n: int) -> None:
        self.weight = np.array([math.floor(1000 * math.log(float(2 * n + 2) / float(2 * int(d) + 1))) if d else 0 for d in df], np.int64)

    def found(self, terms_: np.ndarray) -> np.ndarray:
        """Where each of the block's terms is in a cluster's, -1 if it isn't."""
        at = np.minimum(np.searchsorted(terms_, self.terms), max(len(terms_) - 1, 0))
        return np.where(terms_[at] == self.terms, at, -1) if len(terms_) else np.full(len(self.terms), -1)


def _counter(queries):
    """(i, n): in how many documents of a task's clusters the block's i-th term is."""
    def run(batches):
        q = queries.value
        total = np.zeros(len(q.terms), np.int64)
        for batch in batches:
            for t, c in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                at = q.found(np.frombuffer(t, np.uint64))
                total[at >= 0] += np.frombuffer(c, np.uint32)[at[at >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["i", "n"])

    return run


def _bounds(queries, n: int, length: int):
    """(q, cluster, bound) for all queries with a bound above 0."""
    def run(batches):
        q = queries.value
        for batch in batches:
            for cluster, t, e, tf, ln in zip(*(batch.column(i).to_pylist() for i in range(5))):
                at = q.found(np.frombuffer(t, np.uint64))
                counts = np.frombuffer(e, np.uint32).astype(np.int64)
                c = contributions(np.frombuffer(tf, np.uint32).astype(np.int64), np.frombuffer(ln, np.int64), n, length)
                most = np.maximum.reduceat(c, np.append(0, np.cumsum(counts))[:-1])
                value = np.where(at >= 0, q.weight * most[at], 0)
                bound = np.diff(np.append(0, np.cumsum(value[q.at]))[q.begins])
                some = np.flatnonzero(bound > 0)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), cluster)), pa.array(bound[some])], names=["q", "cluster", "bound"])

    return run


def _visitor(queries, n: int, length: int, top: int):
    """(q, doc_id, score): each visited cluster's best documents for each query that visits it."""
    def run(batches):
        q = queries.value
        for batch in batches:
            for row in range(batch.num_rows):
                visits, ids, ln, t, counts, places, tfs = (batch.column(i)[row].as_py() for i in range(7))
                ln = np.frombuffer(ln, np.int64)
                at = q.found(np.frombuffer(t, np.uint64))
                first = np.append(0, np.cumsum(np.frombuffer(counts, np.uint32).astype(np.int64)))
                places, tfs = np.frombuffer(places, np.uint32), np.frombuffer(tfs, np.uint32).astype(np.int64)
                c = contributions(tfs, ln[places], n, length)
                key = np.array([2**63 - 1 if i is None else i for i in ids], np.int64)
                null = np.array([i is None for i in ids])
                out = ([], [], [])
                for v in visits:
                    score = np.zeros(len(ln), np.int64)
                    mine = q.at[q.begins[v["q"]]:q.begins[v["q"] + 1]]
                    for i in mine[at[mine] >= 0].tolist():
                        s, e = first[at[i]], first[at[i] + 1]
                        score[places[s:e]] += q.weight[i] * c[s:e]  # a document is once in a list
                    some = np.flatnonzero(score >= max(1, v["least"]))
                    if len(some) > top:
                        some = some[score[some] >= np.partition(score[some], len(some) - top)[len(some) - top]]
                        some = some[np.lexsort((key[some], null[some], -score[some]))][:top]
                    out[0].extend([v["q"]] * len(some))
                    out[1].extend(ids[i] for i in some)
                    out[2].extend(score[some].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["q", "doc_id", "score"])

    return run


def _best(rows: DataFrame, top: int) -> DataFrame:
    """Each query's first top rows, with their rank; Spark cuts every task's rows to as many before it gathers them."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def _search(index: Index, queries: Queries, scratch: Scratch, name: str, top: int, stats: dict | None) -> DataFrame:
    """(q, doc_id, score, rank) of a block."""
    context = index.rows.sparkSession.sparkContext
    shared = context.broadcast(queries)
    found = index.rows.select("terms", "counts").mapInArrow(_counter(shared), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(queries.terms), np.int64)
    df[found.column(0).to_numpy()] = found.column(1).to_numpy()
    queries.weigh(df, index.n)
    shared = context.broadcast(queries)
    bounds = index.rows.select("cluster", "terms", "edges", "edge_tfs", "edge_lengths").mapInArrow(_bounds(shared, index.n, index.length), "q int, cluster long, bound long")
    left = scratch.table(bounds, f"{name}-bounds")
    best = left.select("q", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")).limit(0)
    passed, visit, k = None, FIRST_VISIT, 0
    while True:
        # a query's last kept score, once it has kept enough
        least = best.filter(F.col("rank") == top).select("q", F.col("score").alias("least"))
        open_ = left.join(least, "q", "left").withColumn("least", F.coalesce("least", F.lit(0).cast("long"))).filter("bound >= least")
        if passed is not None:
            open_ = open_.join(passed, "q").filter("bound < last or (bound = last and cluster > last_cluster)")
        w = Window.partitionBy("q").orderBy(F.desc("bound"), "cluster")
        visits = open_.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= visit).drop("r")
        visits = scratch.table(visits, f"{name}-visits-{k}")
        n = visits.count()
        if stats is not None:
            stats.setdefault("visits", []).append(n)
        if not n:
            break
        last = visits.groupBy("q").agg(F.min(F.struct(F.col("bound"), (-F.col("cluster")).alias("c"))).alias("m")).select("q", F.col("m.bound").alias("last"), (-F.col("m.c")).alias("last_cluster"))
        by = visits.groupBy("cluster").agg(F.collect_list(F.struct("q", "least")).alias("visits"))
        hits = index.rows.drop("edges", "edge_tfs", "edge_lengths").join(by, "cluster").select("visits", "ids", "lengths", "terms", "counts", "places", "tfs")
        hits = hits.mapInArrow(_visitor(shared, index.n, index.length, top), "q int, doc_id long, score long")
        best = scratch.table(_best(best.drop("rank").unionByName(hits), top), f"{name}-best-{k}")
        passed = scratch.table(last, f"{name}-passed-{k}")
        scratch.drop(f"{name}-visits-{k}", f"{name}-best-{k - 1}", f"{name}-passed-{k - 1}")
        visit, k = visit * MORE, k + 1
    if stats is not None:
        stats["pairs"] = stats.get("pairs", 0) + left.count()
    scratch.drop(f"{name}-bounds")
    return best


def _query_terms(batches):
    memo = WordHashes()
    for piece in slices(batches):
        for q, text in zip(*(piece.column(i).to_pylist() for i in (0, 1))):
            h = terms(text, memo)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), q)), pa.array(h.view(np.int64))], names=["q", "term"])


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", top: int = TOP, block_terms: int = BLOCK_TERMS, vocabulary: int = VOCABULARY, stats: dict | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's top documents."""
    scratch = Scratch(spark, "lexical")
    asked = scratch.table(items.select(F.monotonically_increasing_id().alias("q"), F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), "items")
    wanted = scratch.table(asked.select("q", "text").mapInArrow(_query_terms, "q long, term long"), "terms")
    few = wanted.select("term").distinct().limit(vocabulary + 1).toArrow().column(0).to_numpy()
    index = Index.build(docs, scratch, np.sort(few.view(np.uint64)) if len(few) <= vocabulary else None, id_col=id_col, text_col=text_col)
    n_blocks = -(-wanted.count() // block_terms)
    found = None
    for b in range(n_blocks):
        table = wanted.filter(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == b).toArrow()  # about block_terms rows
        qs, hs = (table.column(i).to_numpy() for i in (0, 1))
        names, at = np.unique(qs, return_inverse=True)
        best = _search(index, Queries(names.tolist(), at, hs.view(np.uint64)), scratch, f"block-{b}", top, stats)
        ids = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(names), dtype=np.int32)), "_row": pa.array(names)}))
        rows = best.join(F.broadcast(ids), "q").join(asked.select(F.col("q").alias("_row"), "item_id"), "_row").select("item_id", "rank", "doc_id", "score")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return found


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w FROM documents),
docs AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
sums AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS length FROM docs),
q AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
qt AS (SELECT q, unnest(w) AS term FROM q),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY r, term),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, sums GROUP BY term, n_docs),
scored AS (SELECT q, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // length))))::BIGINT AS score FROM qt JOIN tf USING (term) JOIN weight USING (term) JOIN docs USING (r), sums GROUP BY q, r),
ranked AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored JOIN docs USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN q USING (q) WHERE rank <= 50
"""
