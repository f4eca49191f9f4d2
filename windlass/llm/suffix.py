"""Removal of repeated byte strings by distributed prefix doubling over content-chosen positions.

Ranking every position would move many times the input. Any LENGTH-byte string has one position whose GRAM-byte string
hashes least among those within it (the leftmost of equals), and equal strings have it at the same offset; only these
anchors, about one position in thirty, are ranked. Prefix hashes are doubled up to GRAM bytes; Spark sorts the (rank,
position) pairs of all anchors and those of a unique rank are done. The others are reranked by all bytes that any of
their strings reaches: an anchor whose rank has come earlier repeats with all its strings. The first of each such rank,
where its GRAM-byte rank has others, is reranked by the cores of its strings (the bytes that neighbouring strings share)
and within equal cores by whole strings. A string that isn't the first of its rank is removed.

Ranks are 64-bit hashes of the bytes, not compared byte by byte.

Defined results: null and empty texts have no bytes; texts of fewer than LENGTH bytes lose none; repeated and null ids
are ordered by (id, text), nulls first, so of repeated rows the first keeps its bytes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load, slices
from .shingles import mix

_U = np.uint64
LENGTH, GRAM, BLOCK = 100, 32, 23
OFFSETS = LENGTH - GRAM + 1  # of an anchor within its strings: three blocks
CORE, EXT = LENGTH - BLOCK + 1, BLOCK - 1
_B = _U(0x9E3779B97F4A7C15)
_POWERS = [pow(int(_B), 1 << k, 1 << 64) for k in range(9)]


def doubled(buf: np.ndarray) -> list[np.ndarray]:
    """Hashes of all 1, 2, 4 ... 128-byte strings, each from two of half the length."""
    r = [buf.astype(np.uint64) + _U(1)]
    for k in range(7):
        a, h = r[-1], 1 << k
        r.append(a[:-h] * _U(_POWERS[k]) + a[h:] if len(a) > h else a[:0])
    return r


def ranks(r: list[np.ndarray], start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the size bytes from start, for arrays of both."""
    h, at = np.zeros(len(start), np.uint64), start.astype(np.int64)
    size = np.broadcast_to(size, at.shape)
    for k in range(7, -1, -1):
        bit = (size >> k & 1).astype(bool)
        if bit.any():
            h[bit] = h[bit] * _U(_POWERS[k]) + r[k][at[bit]]
            at[bit] += 1 << k
    return h


def anchors(gram: np.ndarray) -> np.ndarray:
    """For each string, the place of the least of its GRAM-byte hashes, the leftmost among equals."""
    v, p, w = gram, np.arange(len(gram), dtype=np.int32), 1
    while w < OFFSETS:
        s = min(w, OFFSETS - w)
        less = v[s:] < v[:-s]
        v, p = np.where(less, v[s:], v[:-s]), np.where(less, p[s:], p[:-s])
        w += s
    return p


def _joined(texts: list) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def _mark(batches):
    """(gram, rank, doc, place): anchors, with place = position << 16 | least << 8 | largest offset; a batch's own repeats as (any, start, doc, -end)."""
    for piece in slices(batches, rows=2048, chars=1 << 20, column="text"):
        buf, begins = _joined(piece.column(1).to_pylist())
        if len(buf) < LENGTH:
            continue
        r = doubled(buf)
        gram = mix(r[5])
        at = anchors(gram)[:len(buf) - LENGTH + 1]
        start = np.arange(len(at))
        which = np.searchsorted(begins, start, "right") - 1
        ok = start + LENGTH <= begins[which + 1]
        start, at, which = start[ok], at[ok].astype(np.int64), which[ok]
        if not len(at):
            continue
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        p, d = at[first], which[first]
        hi, lo = p - start[first], p - start[np.append(first[1:], len(at)) - 1]
        left, right = np.minimum(p - begins[d], OFFSETS - 1), np.minimum(begins[d + 1] - p, LENGTH)
        rank = ranks(r, p - left, left + right)
        rank = mix(rank ^ mix((((left * 128 + right) * 128 + lo) * 128 + hi).astype(np.uint64)))
        doc, pos = piece.column(0).to_numpy()[d], p - begins[d]
        g = gram[p]
        order = np.lexsort((pos, doc, rank, g))
        g, rank, doc, pos, lo, hi = (x[order] for x in (g, rank, doc, pos, lo, hi))
        again = np.append(False, (g[1:] == g[:-1]) & (rank[1:] == rank[:-1]))
        place = np.where(again, -(pos - lo + LENGTH), pos << 16 | lo << 8 | hi)
        g = np.where(again, mix(rank + doc.astype(np.uint64)), g)
        rank = np.where(again, pos - hi, rank.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(rank), pa.array(doc), pa.array(place)], names=["gram", "rank", "doc", "place"])


def _rerank(batches):
    """(doc, a, b) from pairs sorted by (gram, rank, doc, place): repeats as start, end; firsts among several ranks of a gram as position, -1 - offsets."""
    prev_g = prev_r = held = None
    many = False
    for batch in batches:
        g, rank, doc, place = (c.to_numpy() for c in batch.columns)
        own = place < 0
        out = [(doc[own], rank[own], -place[own])]
        g, rank, doc, place = g[~own], rank[~own], doc[~own], place[~own]
        if len(g):
            same_g = np.append(prev_g == g[0] if prev_g is not None else False, g[1:] == g[:-1])
            same = same_g & np.append(prev_r == rank[0] if prev_r is not None else False, rank[1:] == rank[:-1])
            pos, lo, hi = place >> 16, place >> 8 & 255, place & 255
            out.append((doc[same], (pos - hi)[same], (pos - lo)[same] + LENGTH))
            f = np.flatnonzero(~same)
            if len(f):
                after = np.append(same_g[f[1:]] & (g[f[1:]] == g[f[:-1]]), False)
                several = after | same_g[f]  # a first that isn't the gram's first row has one before it
                if held is not None and same_g[f[0]] and g[f[0]] == prev_g:
                    out.append(held)
                keep = f[several]
                out.append((doc[keep], pos[keep], -1 - (lo << 8 | hi)[keep]))
                last = f[-1]
                held = None if several[-1] else (doc[last:last + 1], pos[last:last + 1], -1 - (lo << 8 | hi)[last:last + 1])
            prev_g, prev_r = g[-1], rank[-1]
        d, a, b = (np.concatenate(x) for x in zip(*out))
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b)], names=["doc", "a", "b"])


def _cores(batches):
    """(core, doc, at, first, last, ext) of each block of strings of the listed anchors."""
    for piece in slices(batches, rows=256, chars=1 << 20, column="text"):
        buf, begins = _joined(piece.column(1).to_pylist())
        r = doubled(buf)
        n = np.diff(piece.column(2).offsets.to_numpy())
        p, offsets = piece.column(2).flatten().to_numpy(), -1 - piece.column(3).flatten().to_numpy()
        d = np.repeat(np.arange(len(n)), n)
        lo, hi, p = offsets >> 8, offsets & 255, p + begins[d]
        for j in range(OFFSETS // BLOCK):
            i0, i1 = np.maximum(lo - BLOCK * j, 0), np.minimum(hi - BLOCK * j, EXT)
            ok = i0 <= i1
            at, q = p[ok] - BLOCK * j, d[ok]
            core = mix(ranks(r, at, CORE) + _U(j + 1))
            side = np.arange(EXT)
            l, m = at[:, None] - 1 - side, at[:, None] + CORE + side
            l = np.where(l >= begins[q][:, None], buf[np.maximum(l, 0)], 0)
            m = np.where(m < begins[q + 1][:, None], buf[np.minimum(m, len(buf) - 1)], 0)
            ext = np.hstack([l, m]).astype(np.uint8)
            if len(at):
                flat = pa.py_buffer(ext.tobytes())
                offs = pa.array(np.arange(len(at) + 1, dtype=np.int32) * 2 * EXT)
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(piece.column(0).to_numpy()[q]), pa.array(at - begins[q]), pa.array(i0[ok].astype(np.int32)), pa.array(i1[ok].astype(np.int32)), pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, offs.buffers()[1], flat])], names=["core", "doc", "at", "first", "last", "ext"])


def _strings(rows: list[np.ndarray]):
    """Repeats (doc, start, end) among complete groups of equal cores, rows sorted by (core, doc, at)."""
    core, doc, at, first, last, ext = rows
    several = np.append(core[1:] == core[:-1], False) | np.append(False, core[1:] == core[:-1])
    core, doc, at, first, last, ext = (x[several] for x in (core, doc, at, first, last, ext))
    left = np.zeros((len(core), BLOCK), np.uint64)
    right = np.zeros((len(core), BLOCK), np.uint64)
    for k in range(EXT):
        left[:, k + 1] = left[:, k] * _B + ext[:, k] + _U(1)
        right[:, k + 1] = right[:, k] * _B + ext[:, EXT + k] + _U(1)
    key = mix(mix(left) + mix(mix(right[:, ::-1]) + core.view(np.uint64)[:, None]) * _B + np.arange(BLOCK, dtype=np.uint64))
    i = np.arange(BLOCK)
    row, off = np.nonzero((i >= first[:, None]) & (i <= last[:, None]))
    key = key[row, off]
    _, earliest = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[earliest] = False
    row, off = row[again], off[again]
    # neighbouring strings of a row are one stretch
    edge = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (off[1:] != off[:-1] + 1))) if len(row) else row
    end = np.append(edge[1:], len(row)) - 1 if len(row) else row
    return doc[row[edge]], at[row[edge]] - off[end], at[row[edge]] - off[edge] + LENGTH


def _whole(batches):
    held = None
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns[:5]]
        ext = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, 2 * EXT)
        rows = [*cols, ext]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        held = [x[cut:] for x in rows]
        if cut:
            d, a, b = _strings([x[:cut] for x in rows])
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b)], names=["doc", "a", "b"])
    if held is not None and len(held[0]):
        d, a, b = _strings(held)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b)], names=["doc", "a", "b"])


def kept(raw: bytes, starts, ends) -> tuple[bytes, int]:
    """The bytes outside the stretches, and the number of maximal removed runs."""
    marks = np.zeros(len(raw) + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    gone = np.cumsum(marks)[:-1] > 0
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int((np.diff(np.append(False, gone).astype(np.int8)) == 1).sum())


def _finish(keep_text: bool):
    def run(batches):
        for piece in slices(batches, rows=256, chars=1 << 20, column="text"):
            n = pc.fill_null(pc.list_value_length(piece.column(2)), 0).to_pylist()
            a, b = piece.column(2).flatten().to_numpy(), piece.column(3).flatten().to_numpy()
            at, rows = 0, []
            for k, t in zip(n, piece.column(1).to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass")
                left, runs = kept(raw, a[at:at + k], b[at:at + k]) if k else (raw, 0)
                at += k
                rows.append((len(raw), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*rows))
            out = [piece.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3])]
            yield pa.RecordBatch.from_arrays(out + [pa.array(cols[4], pa.binary())] * keep_text, names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256), with keep_bytes also the remaining bytes, of each row."""
    sc = Scratch(spark, "suffix")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    plain = docs.groupBy("id").count().filter("count > 1 or id is null").limit(1).count() == 0
    if plain:
        docs = docs.withColumnRenamed("id", "doc")
    else:  # an order of its own for each row
        docs = docs.orderBy("id", "text").select(F.monotonically_increasing_id().alias("doc"), "id", "text")
        docs = sc.table(docs, "ordered")
    pairs = docs.select("doc", "text").mapInArrow(_mark, "gram long, rank long, doc long, place long")
    pairs = pairs.repartition("gram").sortWithinPartitions("gram", "rank", "doc", "place")
    found = sc.table(pairs.mapInArrow(_rerank, "doc long, a long, b long"), "found")
    sc.release()
    # the lists of a document are bounded by its length; they grow with the data, so merge joins at every size
    listed = lambda df: df.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("x")).select("doc", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    open_ = listed(found.filter("b < 0"))
    cores = docs.select("doc", "text").join(open_.hint("merge"), "doc").select("doc", "text", "a", "b").mapInArrow(_cores, "core long, doc long, at long, first int, last int, ext binary")
    cores = cores.repartition("core").sortWithinPartitions("core", "doc", "at")
    more = sc.table(cores.mapInArrow(_whole, "doc long, a long, b long"), "more")
    sc.release()
    gone = listed(found.filter("b >= 0").union(more))
    out = docs.select("doc", "text").join(gone.hint("merge"), "doc", "left").select("doc", "text", "a", "b")
    out = out.mapInArrow(_finish(keep_bytes), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
    return out.withColumnRenamed("doc", "id") if plain else docs.select("doc", "id").join(out, "doc").drop("doc")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def brute_force(texts: list[tuple]) -> list[tuple]:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of rows sorted by id, from a dictionary of all strings, for tests."""
    seen, out = set(), []
    for i, t in texts:
        raw = (t or "").encode()
        starts = []
        for s in range(len(raw) - LENGTH + 1):
            if raw[s:s + LENGTH] in seen:
                starts.append(s)
            seen.add(raw[s:s + LENGTH])
        left, runs = kept(raw, np.array(starts, int), np.array(starts, int) + LENGTH)
        out.append((i, len(raw), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest()))
    return out
