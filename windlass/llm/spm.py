"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into three machines: the normaliser (white space becomes marks, a start arc writes the leading
one), the acceptor of all pieces (a trie whose final states write piece ids), and byte fallback (arcs of one character
that write its bytes). They are composed with each input as the search goes on: a state of the composition is a position
in the text and the piece that led there, and encoding takes the shortest path in the tropical semiring, where weights
add along a path and the least of paths counts, over positions in order.

For a unigram model an arc weighs minus the piece's score. A BPE model's merges aren't a sum of piece weights; there the
weight lies in the pair of states: 0 where merging both pieces' characters gives just these two pieces, else infinite.
Adjacent pairs decide whether a segmentation is the one that merging makes, so of all paths to a position exactly one is
finite, and the ids are those of the merge rules. Where this doesn't hold (runs of marks, whose pieces have equal scores,
and characters that are parts of pieces but none themselves) the chunk goes through the merge rules, to the same ids.

Texts are cut into chunks that no piece crosses (before a run of white-space marks, around characters of no piece),
so a chunk's path is found once and remembered within a bound.

Defined results: null gives null ids, '' no ids; surrogates are encoded as three bytes and so survive; repeated rows are
encoded alike; other columns are carried along.
"""

from __future__ import annotations

import array
import functools
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import load, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CHUNKS, PAIRS = 200_000, 400_000  # entries of each of two generations that a task remembers
INF = float("inf")
UNKNOWN_COST = 10.0


def _fields(data: bytes):
    """(number, value) of a protocol-buffers message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at:at + n]
            at += n


class Model:
    """Pieces, scores, types and the normaliser's settings of a model file."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.types = [], [], []
        self.kind, self.prefix, self.trim, self.escape, self.byte_fallback = UNIGRAM, True, True, True, False
        for number, value in _fields(data):
            if number == 1:
                f = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                self.pieces.append(f[1].decode())
                self.scores.append(struct.unpack("<f", f[2])[0])
                self.types.append(f[3])
            elif number == 2:
                f = dict(_fields(value))
                self.kind, self.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2):
                    raise ValueError("only models without a character map are supported")
                self.prefix, self.trim, self.escape = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")


class Transducer:
    def __init__(self, data: bytes):
        m = self.model = Model(data)
        self.ids = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types)) if t in (NORMAL, USER)}
        self.longest = max(map(len, self.ids), default=1)
        self.unk = m.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(m.pieces, m.types)) if t == BYTE}
        self.chars = {c for p in self.ids for c in p}
        self.out = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.encode() for p, t in zip(m.pieces, m.types)]
        self.out[self.unk] = " ⁇ ".encode()
        lone = [c for c in map(chr, range(32)) if c not in self.chars]
        crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        cut = "".join(map(re.escape, lone))
        self.cut = re.compile(f"[{cut}]|[^{cut}]+" if crossing else f"{MARK}*[^{MARK}{cut}]+|{MARK}+|[{cut}]") if cut else re.compile(".+" if crossing else f"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        if m.kind == BPE:  # pieces that their own characters don't merge into are never met
            self.ids = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merged(p) == [p]}
        self.odd = {c for c in self.chars if c not in self.ids}
        self.trie = self._compiled(self.ids)
        self.worst = min((m.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_COST
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    @staticmethod
    def _compiled(ids: dict[str, int]) -> dict:
        """The acceptor of the pieces: a state's arcs by character; under '' the id that a final state writes."""
        start: dict = {}
        for piece, i in ids.items():
            state = start
            for c in piece:
                state = state.setdefault(c, {})
            state[""] = i
        return start

    def normalise(self, text: str) -> str:
        if self.model.trim:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if self.model.prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape else text

    def fallback(self, char: str) -> tuple[int, ...]:
        if not self.bytes:
            return (self.unk,)
        return tuple(self.bytes[b] for b in char.encode("utf-8", "surrogatepass"))

    def merged(self, s: str) -> list[str]:
        """The merge rules themselves: best score first, leftmost among equals."""
        ids, scores = self.ids, self.model.scores
        part, nxt, prv = list(s), list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < len(s) and (both := ids.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-scores[both], i, part[i] + part[j]))

        for i in range(len(s) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = nxt[i] if part[i] else len(s)
            if j >= len(s) or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, ""
            nxt[i] = nxt[j]
            if nxt[j] < len(s):
                prv[nxt[j]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [p for p in part if p]

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b may come after piece a: merging their characters gives these two."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            p, q = self.model.pieces[a], self.model.pieces[b]
            known = self.pairs[key] = self.merged(p + q) == [p, q]
        return known

    def shortest(self, s: str) -> list[int]:
        """The ids along the shortest path of the composition with a chunk."""
        bpe = self.model.kind == BPE
        if bpe and (MARK * 2 in s or self.odd.intersection(s)):
            return [t for p in self.merged(s) for t in ((self.ids[p],) if p in self.ids else self.fallback(p))]
        n, trie, scores, known, follows = len(s), self.trie, self.model.scores, self.pairs.get, self.follows
        weight, back, wrote = [INF] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        weight[0] = 0.0
        for at in range(n):
            here, before, state = weight[at], wrote[at], trie
            if here == INF:
                continue
            for end in range(at, n):
                state = state.get(s[end])
                if state is None:
                    break
                i = state.get("")
                if i is None:
                    continue
                if bpe:  # one finite path leads to a position: what has one needs no other
                    if weight[end + 1] == INF and (before < 0 or (follows(before, i) if (ok := known(before << 20 | i)) is None else ok)):
                        weight[end + 1], back[end + 1], wrote[end + 1] = here, at, i
                elif here - scores[i] < weight[end + 1]:
                    weight[end + 1], back[end + 1], wrote[end + 1] = here - scores[i], at, i
            if s[at] not in self.ids:  # byte fallback
                w = here if bpe else here - self.worst
                if w < weight[at + 1]:
                    weight[at + 1], back[at + 1], wrote[at + 1] = w, at, -1
        out, at = [], n
        while at:
            out.extend((wrote[at],) if wrote[at] >= 0 else reversed(self.fallback(s[back[at]])))
            at = back[at]
        out.reverse()
        return out

    def path(self, chunk: str) -> bytes:
        """The shortest path's ids as int32 bytes."""
        raw = self.older.get(chunk)
        if raw is None:
            raw = array.array("i", self.shortest(chunk)).tobytes()
        if len(chunk) <= 40:
            if len(self.chunks) >= CHUNKS:
                self.older, self.chunks = self.chunks, {}
            self.chunks[chunk] = raw
        return raw

    def encode(self, text: str) -> bytes:
        path = self.path
        return b"".join([self.chunks.get(c) or path(c) for c in self.cut.findall(self.normalise(text))])

    def decode(self, ids) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "surrogatepass")
        if self.model.escape:
            text = text.replace(MARK, " ")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


@functools.lru_cache(2)
def compiled(data: bytes) -> Transducer:
    """One transducer for all tasks of a worker."""
    return Transducer(data)


def _encoder(data, text_col: str, check: bool, schema: pa.Schema):
    def run(batches):
        t = compiled(data.value)
        for piece in slices(batches, rows=256, column=text_col):
            cols = {n: piece.column(i) for i, n in enumerate(piece.schema.names)}
            texts = cols[text_col].to_pylist()
            coded = [b"" if x is None else t.encode(x) for x in texts]
            ids = np.frombuffer(b"".join(coded), np.int32)
            ends = np.cumsum([0] + [len(c) // 4 for c in coded])
            nulls = pa.array(np.array([x is None for x in texts] + [False]))
            cols["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=nulls.to_numpy(zero_copy_only=False)), pa.array(ids)).cast(schema.field("ids").type)
            if check:
                cols["round_trip"] = pa.array([None if x is None else t.decode(ids[b:e].tolist()) == x for x, b, e in zip(texts, ends[:-1].tolist(), ends[1:].tolist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([cols[n] for n in schema.names], names=schema.names)

    return run


def _sent(spark: SparkSession, model: str):
    """The model file, sent to each executor once; its size is that of a tokenizer, whatever the input's."""
    with open(model, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model: str = MODEL, *, text_col: str = "text", check: bool = False, keep_text: bool = True) -> DataFrame:
    """docs with ids (array of int) and, with check, whether decoding gives the text again."""
    data = _sent(docs.sparkSession, model)
    out = docs.withColumn("ids", F.lit(None).cast("array<int>"))
    if check:
        out = out.withColumn("round_trip", F.lit(None).cast("boolean"))
    if not keep_text:
        out = out.drop(text_col)
    return docs.mapInArrow(_encoder(data, text_col, check, to_arrow_schema(out.schema)), out.schema)


def decode(coded: DataFrame, model: str = MODEL, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """coded with the ids' text in text_col."""
    data = _sent(coded.sparkSession, model)
    out = coded.withColumn(text_col, F.lit(None).cast("string"))
    schema = to_arrow_schema(out.schema)

    def run(batches):
        t = compiled(data.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                cols[text_col] = pa.array([None if x is None else t.decode(x) for x in cols[ids_col].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([cols[n] for n in schema.names], names=schema.names)

    return coded.mapInArrow(run, out.schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, check=True, keep_text=False).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
