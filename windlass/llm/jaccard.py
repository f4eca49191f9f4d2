"""Jaccard join of shingle sets by parity sketches.

Each shingle is XOR-ed into a sketch, so sketches differ in no more places than the sets do: their Hamming distance is a
lower bound of the symmetric difference. Within a size band that difference is at most d for linked documents. A sketch
of D > d words of 64 bits then agrees in one word at least (pigeonhole): the words are the join keys. D is such that most
sets need no key for words of one shingle or none, which unlike sets share. A sketch of some
8 d single bits per document tells how far apart the two sets of a candidate pair are at least; only pairs within the
reach of their sizes are verified, by exact intersections of the sets of 64-bit shingle hashes.

Keys are packed by bucket. A batch holds its members of a key against their least document and sends that one alone on,
a bucket does the same for all batches and goes on in pieces, so a hot key gathers nowhere. Near copies share keys in many
buckets, the more the larger the table is: pairs stay packed until those of all buckets have met by their hash, and each
becomes one row there. Documents of equal sets are one class. Each class is first verified against its nearest candidate, then pairs that still join different components.
Classes that failed candidates connect are a family: there those outside its largest component are held against
all of it by their bit sketches, in blocks of bounded rows and bytes, and members with any partner in reach once more by
their sets; only links that join components leave a task. Families of more than FAMILY classes do the same for each key
instead. So no link between different sets is lost, and no pairs of a group are emitted.

Defined results: null, empty and wordless texts have no shingle and link with nothing; repeated rows with one id are
one vertex (the least text); rows with a null id have no row in the result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, load, slices
from .shingles import WordHashes, mix, sets

_U = np.uint64
FAMILY, BLOCK_BYTES, SKETCH_ROWS, TEXT_ROWS, STAR, BUCKET_BYTES = 65536, 1 << 20, 4096, 1024, 512, 12 << 20
SPREAD = 4096  # buckets of summaries, which need no other row
PARTS = 256  # parts of the pairs at most; pairs are dealt to them by hash


class Bands:
    """Size bands such that linked sets lie in the same or in adjacent bands, with each band's d and D."""

    def __init__(self, percent: int):
        self.percent, self.low, self.length = percent, [1, 2], {}

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            last = self.low[-1]
            self.low.append(max(last + 1, -(-last * 100 // self.percent)))
        return int(np.searchsorted(self.low, n, "right")) - 1

    def words(self, band: int) -> tuple[int, int]:
        """(d, D): the largest symmetric difference of a link whose larger set is in the band; the sketch length."""
        while len(self.low) <= band + 1:
            self.of(self.low[-1])
        most = self.low[band + 1] - 1
        d = 2 * most * (100 - self.percent) // (100 + self.percent)
        if band not in self.length:
            D = d + 1
            while 4 <= d and D < 2 * d and not all(self.selective(n, band, d, D) for n in (-(-self.low[band] * self.percent // 100), self.low[band], most)):
                D += 1 + D // 64
            self.length[band] = D
        return d, self.length[band]

    def differ(self, n: int, band: int) -> int:
        """The largest symmetric difference of a set of n members and a set linked with it where the larger is in the band."""
        return distance(n + min(self.low[band + 1] - 1, n * 100 // self.percent), self.percent)

    def selective(self, n: int, band: int, d: int, D: int) -> bool:
        """Whether n members leave more words with two or more of them than may differ, by two standard deviations."""
        few = np.exp(-n / D) * (1 + n / D)
        return D * (1 - few) - 2 * np.sqrt(D * few * (1 - few)) > self.differ(n, band)


def keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The join keys of a set: the words of its sketches for its own band and, as the smaller set, for the next one.

    At least D - differ words agree. Words of two or more members are keys always, those of one, which a common shingle
    makes equal in many sets, only where words of fewer than two are so many, empty ones only where they alone are.
    """
    own, out = bands.of(len(s)), []
    place = mix(s ^ _U(0x5851F42D4C957F2D))
    for band in (own, own + 1):
        d, D = bands.words(band)
        if len(s) * 100 < bands.low[band] * bands.percent:
            continue
        agree = D - bands.differ(len(s), band)
        seg = (place % _U(D)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        count = np.bincount(seg, minlength=D)
        filled = np.flatnonzero(count)
        word = np.bitwise_xor.reduceat(s[order], (np.cumsum(count) - count)[filled])
        if np.count_nonzero(count < 2) < agree:
            several = count[filled] > 1
            filled, word = filled[several], word[several]
        out.append(mix(word + mix((filled + (band << 24)).astype(_U))))
        empty = np.flatnonzero(count == 0)
        if len(empty) >= agree:
            out.append(mix(mix((empty + (band << 24)).astype(_U)) ^ _U(0xE7037ED1A0B428DB)))
    return np.concatenate(out).view(np.int64)


def distance(n: int | np.ndarray, percent: int):
    """The largest symmetric difference of linked sets with n members in both together."""
    return n * (100 - percent) // (100 + percent)


def sketch(s: np.ndarray, percent: int) -> bytes:
    """A parity bit for each of a power of two of places, at least 8 for each member that linked sets may differ by."""
    bits = max(64, 1 << int(8 * distance(2 * len(s), percent)).bit_length())
    place = np.bincount((mix(s ^ _U(0x2127599BF4325C37)) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(place.astype(np.uint8)).tobytes()


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of one length as rows of size bytes: halves are XOR-ed, as their places agree modulo the shorter length."""
    x = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    while x.shape[1] > size:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
    return x


def _digest(s: np.ndarray) -> tuple[int, int]:
    return int(np.bitwise_xor.reduce(s, initial=0).astype(_U).view(np.int64)), int((mix(s).sum(dtype=_U) + _U(len(s))).view(np.int64))


_PACK = "bucket int, doc long, n long, s1 long, s2 long, sketch binary, keys binary, at binary, ids binary, pairs binary"
_KEYED = "doc long, n long, s1 long, s2 long, sketch binary, part int, pairs binary"
_PACK_PA = pa.schema([("bucket", pa.int32()), *((c, pa.int64()) for c in ("doc", "n", "s1", "s2")), *((c, pa.binary()) for c in ("sketch", "keys", "at", "ids", "pairs"))])
_KEYED_PA = pa.schema([*((c, pa.int64()) for c in ("doc", "n", "s1", "s2")), ("sketch", pa.binary()), ("part", pa.int32()), ("pairs", pa.binary())])
_LOW = _U((1 << 40) - 1)


def _batch(schema: pa.Schema, rows: int, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _stars(key: np.ndarray, doc: np.ndarray):
    """Of (key, doc) rows: (key, least doc) of each key, and the distinct (least, other) pairs as an array of two columns."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.append(True, key[1:] != key[:-1])[:len(key)]
    at = np.flatnonzero(first)
    least = doc[np.repeat(at, np.diff(np.append(at, len(key))))]
    other = ~first & (doc != least)
    return key[at], doc[at], _unique(np.stack([least[other], doc[other]], 1))


def _unique(pairs: np.ndarray) -> np.ndarray:
    """The distinct rows of two columns, sorted."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(1))[:len(pairs)]]


def _keyed(n: int, percent: int, buckets: int):
    """Summaries (doc, n, digests, sketch) of all texts; keys with their least document in the batch, packed by bucket; pairs within the batch."""
    def run(batches):
        memo, bands = WordHashes(), Bands(percent)
        for piece in slices(batches, rows=4096, chars=4 << 20):
            docs = piece.column(0).to_numpy()
            found = sets(piece.column(1).to_pylist(), n, memo)
            s1, s2 = zip(*map(_digest, found))
            spread = -1 - (mix(docs.astype(_U)) % _U(SPREAD)).astype(np.int32)
            yield _batch(_PACK_PA, len(docs), bucket=spread, doc=docs, n=[len(s) for s in found], s1=s1, s2=s2, sketch=[sketch(s, percent) if len(s) else b"" for s in found])
            # equal sets of a batch have equal keys: one of them stands for all
            _, one = np.unique(np.stack([np.array(s1), np.array(s2)]), axis=1, return_index=True)
            one = np.sort(one[[len(found[i]) > 0 for i in one]])
            if not len(one):
                continue
            ks = [keys(found[i], bands) for i in one]
            key, doc, pairs = _stars(np.concatenate(ks).view(_U), np.repeat(docs[one], [len(k) for k in ks]))
            bucket = (((key >> _U(40)) * _U(buckets)) >> _U(24)).astype(np.int32)
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(key))
            low = (key & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            rows = []
            for b, e in zip(cuts[:-1], cuts[1:]):
                ids, at = np.unique(doc[b:e], return_inverse=True)
                rows.append((bucket[b], low[b:e].tobytes(), at.astype(np.uint16).tobytes(), ids.tobytes()))
            c = list(zip(*rows))
            yield _batch(_PACK_PA, len(rows), bucket=c[0], keys=c[1], at=c[2], ids=c[3])
            if len(pairs):
                yield _batch(_PACK_PA, 1, bucket=[bucket[len(pairs) % len(bucket)]], pairs=[pairs.tobytes()])

    return run


_FOLD, _FOLD_PAIRS = 3_000_000, 1_000_000


def _parted(pairs: np.ndarray, parts: int) -> pa.RecordBatch:
    """Pairs packed by part: equal ones of any bucket come to one part."""
    part = (mix(mix(pairs[:, 0].astype(_U)) ^ pairs[:, 1].astype(_U)) % _U(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    pairs, part = pairs[order], part[order]
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[:len(part)]), len(part))
    return _batch(_KEYED_PA, len(cuts) - 1, part=part[cuts[:-1]], pairs=[pairs[b:e].tobytes() for b, e in zip(cuts[:-1], cuts[1:])])


def _bucketed(parts: int):
    """Summaries of each bucket and its distinct pairs, packed by part, from rows sorted by bucket; over _FOLD keys, those so far are one each before more come."""
    def run(batches):
        now, key, doc, size, found = None, [], [], 0, []

        def fold():
            k, d, pairs = _stars(np.concatenate(key), np.concatenate(doc))
            found.append(pairs)
            return [k], [d]

        def out():
            pairs = _unique(np.concatenate(found))
            found.clear()
            return _parted(pairs, parts)

        for batch in batches:
            ok = batch.filter(batch.column(2).is_valid())
            if ok.num_rows:
                yield pa.RecordBatch.from_arrays([*ok.columns[1:6], pa.nulls(ok.num_rows, pa.int32()), pa.nulls(ok.num_rows, pa.binary())], schema=_KEYED_PA)
            rest = batch.filter(batch.column(2).is_null())
            for bucket, ks, at, ids, pairs in zip(*(rest.column(i).to_pylist() for i in (0, 6, 7, 8, 9))):
                if bucket != now or size > _FOLD:
                    if key:
                        key, doc = fold()
                    if found and (bucket != now or sum(map(len, found)) > _FOLD_PAIRS):
                        yield out()
                    if bucket != now:
                        now, key, doc = bucket, [], []
                    size = sum(map(len, key))
                if pairs is not None:
                    found.append(np.frombuffer(pairs, np.int64).reshape(-1, 2))
                    if sum(map(len, found)) > _FOLD_PAIRS:
                        yield out()
                    continue
                k = np.zeros((len(ks) // 5, 8), np.uint8)
                k[:, :5] = np.frombuffer(ks, np.uint8).reshape(-1, 5)
                key.append(k.view("<u8")[:, 0])
                doc.append(np.frombuffer(ids, np.int64)[np.frombuffer(at, np.uint16)])
                size += len(k)
        if key:
            fold()
        if found:
            yield out()

    return run


def _met(batches):
    """The distinct pairs (a, b) of each part, from rows sorted by part."""
    now, found, size, small = None, [], 0, _FOLD_PAIRS

    def out():
        pairs = _unique(np.concatenate(found))
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        for part, pairs in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now and found:
                yield out()
                found, size, small = [], 0, _FOLD_PAIRS
            now = part
            found.append(np.frombuffer(pairs, np.int64).reshape(-1, 2))
            size += len(found[-1])
            if size > small:
                found = [_unique(np.concatenate(found))]
                size = len(found[0])
                small = max(_FOLD_PAIRS, 2 * size)
    if found:
        yield out()


def _in_reach(percent: int):
    """Pairs (a, b, far) with the Hamming distance of their sketches where it allows a link, far null where it doesn't."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                na, nb = part.column(2).to_numpy(), part.column(3).to_numpy()
                x, y = part.column(4).to_pylist(), part.column(5).to_pylist()
                sizes = np.array([[len(p), len(q)] for p, q in zip(x, y)])
                far = np.full(len(x), 1 << 30, np.int64)
                near = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent
                for p, q in np.unique(sizes[near], axis=0).tolist():
                    i = np.flatnonzero(near & (sizes == (p, q)).all(1))
                    w = min(p, q)
                    far[i] = np.bitwise_count(_folded([x[k] for k in i], w) ^ _folded([y[k] for k in i], w)).sum(1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(far, mask=far > distance(na + nb, percent))], names=["a", "b", "far"])

    return run


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    if not len(p) or not len(q) or min(len(p), len(q)) * 100 < max(len(p), len(q)) * percent:
        return False
    i = np.searchsorted(q, p)
    both = int((q[np.minimum(i, len(q) - 1)] == p).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


_MEMBER = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "at", "ids", "comps"))])


def _member_keys(n: int, percent: int, buckets: int):
    """The keys of (doc, comp, text) with their documents and components, packed by bucket."""
    def run(batches):
        memo, bands = WordHashes(), Bands(percent)
        for piece in slices(batches, rows=4096, chars=4 << 20, column="text"):
            docs, comps = piece.column(0).to_numpy(), piece.column(1).to_numpy()
            ks = [keys(s, bands) if len(s) else np.zeros(0, np.int64) for s in sets(piece.column(2).to_pylist(), n, memo)]
            key, at = np.concatenate(ks).view(_U), np.repeat(np.arange(len(ks)), [len(k) for k in ks])
            bucket = (((key >> _U(40)) * _U(buckets)) >> _U(24)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            key, at, bucket = key[order], at[order], bucket[order]
            low = (key & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:len(key)]), len(key))
            rows = []
            for b, e in zip(cuts[:-1], cuts[1:]):
                own, local = np.unique(at[b:e], return_inverse=True)
                rows.append((bucket[b], low[b:e].tobytes(), local.astype(np.uint16).tobytes(), docs[own].tobytes(), comps[own].tobytes()))
            if rows:
                yield _batch(_MEMBER, len(rows), **dict(zip(_MEMBER.names, zip(*rows))))

    return run


def _open_keys(batches):
    """(unit, doc, comp) of the keys of each bucket that documents of several components have, from rows sorted by bucket."""
    now, parts = None, []

    def opened():
        key, doc, comp = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((comp, key))
        key, doc, comp = key[order], doc[order], comp[order]
        first = np.append(True, key[1:] != key[:-1])
        other = ~first & np.append(False, comp[1:] != comp[:-1])
        at = np.flatnonzero(first)
        several = np.repeat(np.logical_or.reduceat(other, at), np.diff(np.append(at, len(key))))
        unit = (np.int64(now) << 40) | key[several].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(unit), pa.array(doc[several]), pa.array(comp[several])], names=["unit", "doc", "comp"])

    for batch in batches:
        for bucket, ks, at, ids, comps in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and parts:
                yield opened()
                parts.clear()
            now = bucket
            k = np.zeros((len(ks) // 5, 8), np.uint8)
            k[:, :5] = np.frombuffer(ks, np.uint8).reshape(-1, 5)
            local = np.frombuffer(at, np.uint16)
            parts.append((k.view("<u8")[:, 0], np.frombuffer(ids, np.int64)[local], np.frombuffer(comps, np.int64)[local]))
    if parts:
        yield opened()


def _near_in_units(percent: int):
    """(unit, doc) of members with a partner of another component within reach, from rows (unit, doc, comp, n, sketch) sorted by unit."""
    block = _reachable(percent)

    def few(rows):
        """Of a small unit: every pair, as integers."""
        rows = sorted(rows, key=lambda r: r[3])
        whole = [int.from_bytes(r[4], "big") for r in rows]
        hit = set()
        for j, b in enumerate(rows):
            for i in range(j - 1, -1, -1):
                a = rows[i]
                if a[3] * 100 < b[3] * percent:
                    break
                if a[2] == b[2] or a[1] in hit and b[1] in hit:
                    continue
                x, y, p, q = whole[i], whole[j], len(a[4]), len(b[4])
                while q > p:
                    q //= 2
                    y = (y >> 8 * q) ^ (y & ((1 << 8 * q) - 1))
                while p > q:
                    p //= 2
                    x = (x >> 8 * p) ^ (x & ((1 << 8 * p) - 1))
                if (x ^ y).bit_count() <= distance(a[3] + b[3], percent):
                    hit.update((a[1], b[1]))
        return sorted(hit)

    def found(rows):
        if len(rows) <= 48:
            return few(rows)
        import pandas as pd

        pdf = pd.DataFrame(rows, columns=["unit", "doc", "comp", "n", "sketch"])
        pdf["outside"] = pdf.comp != pdf.comp.mode()[0]
        return block(pd.concat([pdf[pdf.outside], pdf.assign(outside=False)])).doc.tolist()

    def run(batches):
        now, held = None, []
        for batch in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[0] != now:
                    if held:
                        out += [(now, d) for d in found(held)]
                    now, held = r[0], []
                held.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([d for _, d in out], pa.int64())], names=["unit", "doc"])
        if held:
            near = found(held)
            yield pa.RecordBatch.from_arrays([pa.array([now] * len(near), pa.int64()), pa.array(near, pa.int64())], names=["unit", "doc"])

    return run


def _verified(n: int, percent: int):
    """Links (a, b) from rows (a, salt, b, text) sorted with the centre's own (b null) first."""
    def run(batches):
        memo, now, centre = WordHashes(), None, None
        for piece in slices(batches, rows=256, column="text"):
            found, a, b = [], piece.column(0).to_pylist(), piece.column(2).to_pylist()
            for x, y, s in zip(a, b, sets(piece.column(3).to_pylist(), n, memo)):
                if y is None:
                    now, centre = x, s
                elif now == x and _linked(centre, s, percent):
                    found.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def _reachable(percent: int):
    """The rows (unit, doc) of a block that have a partner of another component within reach by sketches."""
    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("n", kind="stable")
        rows, cols, hit = pdf[pdf.outside], pdf[~pdf.outside], set()
        if len(rows) and len(cols):
            signs = lambda d, w: 1 - 2 * np.unpackbits(_folded(list(d.sketch), w), axis=1).astype(np.float32)
            kinds = lambda d: {k: g for k, g in d.groupby(d.sketch.map(len).to_numpy())}
            right = kinds(cols)
            for p, left in kinds(rows).items():
                for q, other in right.items():
                    w = min(p, q)
                    step = min(1024, max(1, (1 << 20) // (8 * w)))
                    for at in range(0, len(left), step):
                        r = left.iloc[at:at + step]
                        nr = r.n.to_numpy()
                        c0, c1 = np.searchsorted(other.n.to_numpy(), [-(-nr[0] * percent // 100), nr[-1] * 100 // percent + 1])
                        x = signs(r, w) if c1 > c0 else None
                        for k in range(c0, c1, step):
                            c = other.iloc[k:min(k + step, c1)]
                            far = (8 * w - x @ signs(c, w).T) / 2
                            ok = (far <= distance(nr[:, None] + c.n.to_numpy()[None, :], percent)) & (r.comp.to_numpy()[:, None] != c.comp.to_numpy()[None, :])
                            hit.update(r.doc.to_numpy()[ok.any(1)].tolist(), c.doc.to_numpy()[ok.any(0)].tolist())
        return pd.DataFrame({"unit": np.full(len(hit), pdf.unit.iloc[0]), "doc": np.array(sorted(hit), np.int64)}).astype("int64")

    return run


def _join_blocks(n: int, percent: int):
    """Links between components in a block: rows (doc, comp, outside, text), outside ones against all others."""
    def run(pdf):
        import pandas as pd

        rows, cols = pdf[pdf.outside], pdf[~pdf.outside]
        if rows.empty or cols.empty:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        memo = WordHashes()
        x, y = sets(list(rows.text), n, memo), sets(list(cols.text), n, memo)
        nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
        vocab, xi = np.unique(np.concatenate(x), return_inverse=True)
        yi = np.searchsorted(vocab, (yc := np.concatenate(y)))
        xr, yr = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
        known = vocab[np.minimum(yi, len(vocab) - 1)] == yc
        yi, yr = yi[known], yr[known]
        both = np.zeros((len(x), len(y)), np.float32)
        for at in range(0, len(vocab), 4096):
            i, j = (xi >= at) & (xi < at + 4096), (yi >= at) & (yi < at + 4096)
            p, q = np.zeros((len(x), 4096), np.float32), np.zeros((len(y), 4096), np.float32)
            p[xr[i], xi[i] - at] = 1
            q[yr[j], yi[j] - at] = 1
            both += p @ q.T
        either = nx[:, None] + ny[None, :] - both
        cx, cy = rows.comp.to_numpy(), cols.comp.to_numpy()
        i, j = np.nonzero((100 * both >= percent * either) & (cx[:, None] != cy[None, :]))
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                c = up
            return c

        a, b, out = rows.doc.to_numpy(), cols.doc.to_numpy(), []
        for p, q in zip(i.tolist(), j.tolist()):
            r, t = root(cx[p]), root(cy[q])
            if r != t:
                parent[max(r, t)] = min(r, t)
                out.append((a[p], b[q]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


class Join:
    """Classes and components of documents by Jaccard >= percent / 100 of their n-word shingle sets."""

    def __init__(self, spark: SparkSession, docs: DataFrame, *, id_col="doc_id", text_col="text", n: int, percent: int, family: int = FAMILY):
        self.spark, self.n, self.percent, self.family = spark, n, percent, family
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter("doc is not null")
        self.scratch = Scratch(spark, "jaccard")

    def _texts(self, ids: DataFrame, name: str) -> DataFrame:
        """(doc, text) of the listed documents, of repeated ones the least; ids grow with the data, so a merge join at every size."""
        texts = self.docs.join(ids.hint("merge"), "doc", "left_semi")
        return self.scratch.table(texts.groupBy("doc").agg(F.min("text").alias("text")) if self.repeated else texts, name)

    def _links(self, pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that exact intersections confirm; a centre's text goes to each STAR of its members once."""
        stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("stars"))
        centres = stars.join(texts.withColumnRenamed("doc", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("stars") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
        salt = F.pmod(F.xxhash64("b"), F.col("stars")).cast("int").alias("salt")
        others = pairs.join(stars, "a").select("a", "b", salt).join(texts.select(F.col("doc").alias("b"), "text").hint("merge"), "b").select("a", "salt", "b", "text")
        rows = centres.union(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return self.scratch.table(rows.mapInArrow(_verified(self.n, self.percent), "a long, b long"), name)

    def _open(self, units: DataFrame) -> DataFrame:
        """(unit, doc, comp, outside) of the units with more than one component; outside its largest one."""
        by_comp = units.groupBy("unit", "comp").agg(F.count("*").alias("c"))
        main = by_comp.groupBy("unit").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("k")).filter("k > 1").select("unit", F.col("m.comp").alias("main"))
        return units.join(main, "unit").select("unit", "doc", "comp", (F.col("comp") != F.col("main")).alias("outside"))

    def _blocks(self, rows: DataFrame, size, most: int, name: str) -> DataFrame:
        """The rows of each unit dealt to blocks (unit, r, c) of bounded rows and bytes: outside ones by r, all by c."""
        many = lambda ok: F.ceil(F.greatest(F.sum(F.when(ok, size)) / BLOCK_BYTES, F.count_if(ok) / most)).cast("int")
        blocks = rows.groupBy("unit").agg(many(F.col("outside")).alias("rs"), many(F.lit(True)).alias("cs"))
        rows = rows.join(self.scratch.table(blocks, f"{name}-blocks"), "unit")
        place = lambda n, salt: F.pmod(F.xxhash64("doc", F.lit(salt)), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        more = [c for c in rows.columns if c not in ("unit", "doc", "comp", "outside", "rs", "cs")]
        left = rows.filter("outside").select("unit", place("rs", 1).alias("r"), each("cs").alias("c"), "doc", "comp", F.lit(True).alias("outside"), *more)
        right = rows.select("unit", each("rs").alias("r"), place("cs", 2).alias("c"), "doc", "comp", F.lit(False).alias("outside"), *more)
        # blocks are small but long to compute: as many tasks as a shuffle has, whatever their bytes
        return left.union(right).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "unit", "r", "c")

    def _within(self, units: DataFrame, seen: DataFrame, name: str) -> DataFrame:
        """Links between components of each unit (unit, doc, comp); seen has (doc, n, sketch)."""
        sc = self.scratch
        rows = sc.table(self._open(units).join(seen, "doc"), f"{name}-rows")
        blocks = self._blocks(rows, F.octet_length("sketch"), SKETCH_ROWS, f"{name}-sketch")
        near = sc.table(blocks.groupBy("unit", "r", "c").applyInPandas(_reachable(self.percent), "unit long, doc long").distinct(), f"{name}-near")
        links = self._by_text(rows.select("unit", "doc", "comp", "outside"), near, name)
        sc.drop(f"{name}-rows")
        return links

    def _by_text(self, rows: DataFrame, near: DataFrame, name: str) -> DataFrame:
        """Links between components of the units (unit, doc, comp, outside) by the sets of their members in near (unit, doc)."""
        sc = self.scratch
        texts = self._texts(near.select("doc").distinct(), f"{name}-texts")
        rows = sc.table(rows.join(near, ["unit", "doc"]).join(texts.hint("merge"), "doc").select("unit", "doc", "comp", "outside", "text"), f"{name}-whole")
        blocks = self._blocks(rows, F.octet_length("text"), TEXT_ROWS, f"{name}-text")
        links = sc.table(blocks.groupBy("unit", "r", "c").applyInPandas(_join_blocks(self.n, self.percent), "a long, b long"), f"{name}-links")
        sc.drop(f"{name}-whole", f"{name}-texts")
        return links

    def _by_key(self, large: DataFrame, seen: DataFrame) -> DataFrame:
        """Links between components of large families (doc, comp): only documents that share a key can have one."""
        sc = self.scratch
        texts = self._texts(large.select("doc").distinct(), "large-texts")
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        packed = texts.join(large.select("doc", "comp").hint("merge"), "doc").select("doc", "comp", "text").mapInArrow(_member_keys(self.n, self.percent, max(1, -(-size // BUCKET_BYTES))), ", ".join(f"{f.name} {'int' if f.name == 'bucket' else 'binary'}" for f in _MEMBER))
        opened = sc.table(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_open_keys, "unit long, doc long, comp long"), "by-key")
        sc.drop("large-texts")
        count = opened.groupBy("unit").agg(F.count("*").alias("size")).filter(F.col("size") > SKETCH_ROWS).select("unit")
        hot = sc.table(count, "hot-keys")
        few = opened.join(hot, "unit", "left_anti").join(seen.hint("merge"), "doc").select("unit", "doc", "comp", "n", "sketch")
        near = sc.table(few.repartition("unit").sortWithinPartitions("unit").mapInArrow(_near_in_units(self.percent), "unit long, doc long"), "by-key-near")
        # one component of each unit is held against the others
        inner = opened.join(near, ["unit", "doc"])
        main = inner.groupBy("unit").agg(F.min("comp").alias("main"))
        links = self._by_text(inner.join(main, "unit").select("unit", "doc", "comp", (F.col("comp") != F.col("main")).alias("outside")), near, "keys")
        if hot.limit(1).count():
            links = links.union(self._within(opened.join(hot, "unit"), seen, "hot"))
        return links

    def run(self) -> DataFrame:
        """(doc, n_shingles, component_id) for each document with a non-null id."""
        sc = self.scratch
        size = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(1, -(-size // BUCKET_BYTES))
        packed = self.docs.mapInArrow(_keyed(self.n, self.percent, buckets), _PACK)
        keyed = sc.table(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucketed(min(buckets, PARTS)), _KEYED), "keyed")
        found = keyed.filter("n is not null").select("doc", "n", "s1", "s2", "sketch")
        self.repeated = found.groupBy("doc").count().filter("count > 1").limit(1).count() > 0
        if self.repeated:  # of repeated rows the least text counts, as where texts are read
            least = sc.table(self.docs.groupBy("doc").agg(F.min("text").alias("text")), "least")
            docs, self.docs, self.repeated = self.docs, least, False
            out = self.run()
            return docs.select("doc").join(out, "doc")
        # documents of equal sets are one class
        classes = found.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
        rep = sc.table(found.join(classes, ["n", "s1", "s2"]).filter("doc <> rep").select("doc", "rep"), "rep")
        named = lambda df, c: df.join(rep.select(F.col("doc").alias(c), F.col("rep").alias(f"{c}_rep")), c, "left").withColumn(c, F.coalesce(f"{c}_rep", c)).drop(f"{c}_rep")
        ordered = lambda df: df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        met = keyed.filter("n is null").select("part", "pairs").repartition("part").sortWithinPartitions("part").mapInArrow(_met, "a long, b long")
        pairs = sc.table(ordered(named(named(met, "a"), "b")), "pairs")
        # the sketches' Hamming distance decides before any text moves
        seen = found.select("doc", "n", "sketch")
        side = lambda c: seen.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "sa", "sb")
        reach = sc.table(both.mapInArrow(_in_reach(self.percent), "a long, b long, far long"), "reach")
        near = reach.filter("far is not null")
        texts = self._texts(near.select(F.col("a").alias("doc")).union(near.select("b")).distinct(), "texts")
        # each class with its nearest candidate first, then the pairs that still join components
        first = sc.table(near.groupBy("b").agg(F.min_by("a", F.struct("far", "a")).alias("a")).select("a", "b"), "first")
        links = self._links(first, texts, "links-1")
        inside = lambda df, comps, c: df.join(comps.select(F.col("id").alias(c), F.col("component_id").alias(f"{c}_comp")), c, "left").withColumn(f"{c}_comp", F.coalesce(f"{c}_comp", c))
        comps = sc.table(components(links, sc, "cc-1"), "comps-1")
        rest = near.select("a", "b").join(first, ["a", "b"], "left_anti")
        rest = sc.table(inside(inside(rest, comps, "a"), comps, "b").filter("a_comp <> b_comp").select("a", "b"), "rest")
        links = links.union(self._links(rest, texts, "links-2"))
        comps = sc.table(components(links, sc, "cc-2"), "comps-2")
        sc.drop("texts", "first", "rest")
        # components that failed candidates connect; those of a whole family need nothing more
        joined = lambda df: inside(inside(df.select("a", "b"), comps, "a"), comps, "b").filter("a_comp <> b_comp").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).distinct()
        between = sc.table(joined(reach), "between")
        families = sc.table(components(between, sc, "family").select(F.col("id").alias("comp"), F.col("component_id").alias("unit")), "families")
        alone = families.select(F.col("comp").alias("id"), F.col("comp").alias("component_id"))
        members = comps.union(alone).select(F.col("id").alias("doc"), F.col("component_id").alias("comp")).distinct().join(families, "comp").select("unit", "doc", "comp")
        members = sc.table(members, "members")
        count = sc.table(members.groupBy("unit").agg(F.count("*").alias("size")), "sizes")
        more = self._within(members.join(count.filter(F.col("size") <= self.family).select("unit"), "unit"), seen, "family")
        large = sc.table(members.join(count.filter(F.col("size") > self.family).select("unit"), "unit"), "large")
        if large.limit(1).count():
            more = more.union(self._by_key(large, seen))
        if more.limit(1).count():
            final = components(joined(more), sc, "all").select(F.col("id").alias("component_id"), F.col("component_id").alias("final"))
            comps = comps.union(alone).distinct().join(final, "component_id", "left").select("id", F.coalesce("final", "component_id").alias("component_id"))
        # copies follow their class; a class's id is its least, so it is its component's too
        comps = sc.table(comps, "all-comps")
        copies = rep.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("doc", F.coalesce("component_id", "rep").alias("component_id"))
        classed = sc.table(comps.withColumnRenamed("id", "doc").union(copies), "classed")
        out = sc.table(found.select("doc", "n").join(classed, "doc", "left").select("doc", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id")), "out")
        sc.drop("keyed", "pairs", "reach", "members", "large", "between", "families", "all-comps", "classed", "rep")
        return out


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Join(spark, load(spark, sf_dir, "documents"), n=3, percent=90).run()
    return found.withColumnRenamed("doc", "doc_id")


def brute_force(texts: dict, n: int, percent: int) -> dict:
    """doc -> (n_shingles, component_id) from all pairs, for tests."""
    def shingled(t):
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    s, comp = {d: shingled(t) for d, t in texts.items()}, {d: d for d in texts}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if s[a] and s[b] and min(len(s[a]), len(s[b])) * 100 >= percent * max(len(s[a]), len(s[b])) and comp[a] != comp[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                lo, hi = sorted((comp[a], comp[b]))
                comp = {d: lo if c == hi else c for d, c in comp.items()}
    return {d: (len(s[d]), comp[d]) for d in texts}
