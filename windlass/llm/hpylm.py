"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants are the contexts of a word, the previous word (by hash, in CLASSES restaurants); all share one parent, the
restaurant of words without context, whose base is uniform over the known words and gives a share to all unknown ones
(Good-Turing, from the words met once). Discounts come from counts of counts. Seatings are sampled by blocked Gibbs: in a
sweep every customer of each dish leaves and is seated again given the other dishes. Probabilities depend on a dish's
number of tables alone, so the customers of a dish are seated together, by drawing that number from its distribution
(generalised Stirling numbers by the weights of its tables). Dishes that may have more tables than the numbers' rows hold
have their customers leave and return a RUNS-th of them at a time, table by table. A table that opens or closes adds a
customer to the parent's dish or takes one away, and the parent's customers are reseated likewise. After BURN_IN sweeps each sweep is a sample; the predictive probability of a token is
the mean over samples, and a text's score the sum of their log10.

Occurrences are dealt by word, packed: all dishes of a word, and so its parent's dish, meet in one bucket of bounded
size. A bucket runs its own chain given the totals of all restaurants; ROUNDS passes bring the totals to what the chains
of all buckets have, then they are run once more for the scores. Very common words (at least HOT_SHARE of all tokens,
counted over all rows) are dealt by context instead, with their parent's state sent to all like the restaurants' totals
(both of bounded size).

Defined results: null and empty texts are the end token only; a null id counts as text 'null' of no crc, so it is never
held out; repeated rows are scored and learned from each; without training rows known words and the model's
probabilities are those of an empty restaurant; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load, slices
from .shingles import WordHashes, word_hashes

CLASSES, BURN_IN, SAMPLES, ROUNDS = 65536, 2, 4, 1
BUCKET_BYTES, HOT_SHARE, FINE, RUNS = 10 << 20, 0.002, 16, 32
THETA, THETA_ROOT = 1.0, 1.0
LEAF_ROWS, ROOT_ROWS = (16384, 256), (65535, 64)  # most customers and tables of dishes seated by their number of tables
CELLS = 1 << 17
_END, _START = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C)
_HELD = 1 << 15  # marks held-out texts in a token's place among the texts of its piece
_PACK = pa.schema([("bucket", pa.int32()), ("first", pa.int64()), *((n, pa.binary()) for n in ("words", "counts", "cls", "doc", "ids"))])
_GATHERED = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("words", "nd", "cls", "c", "word", "count", "dish", "doc", "sizes", "first")), ("ids", pa.binary())])
_NULL = np.iinfo(np.int64).min


def _sql(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _tokens(texts: list, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then an end for each text) and where each text begins."""
    h, begins = word_hashes(texts, memo)
    ends = begins[1:]
    return np.insert(h, ends, _END), begins + np.arange(len(begins))


def _common(share: float):
    """(word, n, tokens) of the words that have that share of a piece and its tokens, and (null, tokens, tokens)."""
    def run(batches):
        memo = WordHashes()
        for piece in slices(batches, rows=1024, chars=3 << 20):
            h = _tokens(piece.column(0).to_pylist(), memo)[0]
            words, n = np.unique(h, return_counts=True)
            often = n >= share * len(h)
            word, n = np.append(words[often].view(np.int64), 0), np.append(n[often], len(h))
            yield pa.RecordBatch.from_arrays([pa.array(word, mask=np.arange(len(word)) == len(word) - 1), pa.array(n), pa.array(np.full(len(n), len(h)))], names=["word", "n", "tokens"])

    return run


def _counted(words: np.ndarray):
    """(i, n): the tokens that are the i-th of the sorted words, and of all tokens for i = -1."""
    def run(batches):
        memo, total = WordHashes(), np.zeros(len(words) + 1, np.int64)
        for piece in slices(batches, rows=1024, chars=3 << 20):
            h = _tokens(piece.column(0).to_pylist(), memo)[0]
            at = np.minimum(np.searchsorted(words, h), len(words) - 1)
            total += np.append(np.bincount(at[words[at] == h], minlength=len(words)), len(h))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(words)), -1)), pa.array(total)], names=["i", "n"])

    return run


def hot_words(docs: DataFrame, share: float = HOT_SHARE) -> np.ndarray:
    """Hashes of the words (and the end) with that share of all tokens: at most 1 / share of them."""
    low = share / FINE
    found = docs.select("text").mapInArrow(_common(low), "word long, n long, tokens long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).persist()
    total = found.filter("word is null").agg(F.sum("n")).first()[0] or 0
    # a piece that doesn't list a word has less than the low share of it
    likely = found.filter("word is not null").filter(F.col("n") + low * (total - F.col("tokens")) >= share * total).select("word", "n").toArrow()
    found.unpersist()
    words, n = likely.column(0).to_numpy().view(np.uint64), likely.column(1).to_numpy()
    sure, open_ = np.sort(words[n >= share * total]), np.sort(words[n < share * total])
    if not len(open_):
        return sure
    counts = docs.select("text").mapInArrow(_counted(open_), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    n = dict(zip(counts.column(0).to_pylist(), counts.column(1).to_pylist()))
    return np.sort(np.append(sure, open_[[n[i] >= share * total for i in range(len(open_))]]))


def _packer(buckets: int, hot: np.ndarray):
    def run(batches):
        memo = WordHashes()
        for piece in slices(batches, rows=1024, chars=3 << 20):
            h, begins = _tokens(piece.column(2).to_pylist(), memo)
            first = piece.column(0)[0].as_py()
            ids = piece.column(1).to_pylist()
            held = np.array([x is not None and zlib.crc32(str(x).encode()) % 7 == 2 for x in ids], np.uint16)
            before = np.concatenate([[_START], h[:-1]])
            before[begins[:-1]] = _START
            cls = (before % np.uint64(CLASSES)).astype(np.uint16)
            doc = np.repeat(np.arange(len(ids), dtype=np.uint16) | held * np.uint16(_HELD), np.diff(begins))
            at = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
            common = hot[at] == h if len(hot) else np.zeros(len(h), bool)
            bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
            bucket[common] = buckets + cls[common] % min(buckets, CLASSES)
            order = np.argsort(h, kind="stable")
            order = order[np.argsort(bucket[order], kind="stable")]
            h, cls, doc, bucket = h[order], cls[order], doc[order], bucket[order]
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(h))
            made = [{"bucket": int(bucket[0]), "first": first, "ids": np.array([_NULL if x is None else x for x in ids], np.int64).tobytes() + np.diff(begins).astype(np.int64).tobytes()}]
            for b, e in zip(cuts[:-1], cuts[1:]):
                new = np.flatnonzero(np.append(True, h[b + 1:e] != h[b:e - 1]))
                made.append({"bucket": int(bucket[b]), "first": first, "words": h[b:e][new].tobytes(), "counts": np.diff(np.append(new, e - b)).astype(np.uint32).tobytes(), "cls": cls[b:e].tobytes(), "doc": doc[b:e].tobytes()})
            yield _rows(_PACK, made)

    return run


def _gather(batches):
    """One row a bucket, from rows sorted by bucket: words, their dishes (class, training count), and each piece's tokens.

    Rows with ids (of texts, and their numbers of tokens) pass by.
    """
    now, parts = None, []

    def out():
        words, counts, cls, docs = (list(c) for c in list(zip(*parts))[1:])
        word, count, cls, doc = (np.concatenate([np.frombuffer(x, t) for x in c]) for c, t in ((words, np.uint64), (counts, np.uint32), (cls, np.uint16), (docs, np.uint16)))
        uniq, inverse = np.unique(word, return_inverse=True)
        key = np.repeat(inverse.astype(np.int64), count) * CLASSES + cls
        dishes, dish = np.unique(key, return_inverse=True)
        c = np.bincount(dish[doc < _HELD], minlength=len(dishes)).astype(np.uint32)
        at = dishes // CLASSES
        nd = np.bincount(at, minlength=len(uniq))
        rel = (dish - (np.cumsum(nd) - nd)[key // CLASSES]).astype(np.uint16)
        return {"bucket": now, "words": uniq.tobytes(), "nd": nd.astype(np.uint32).tobytes(), "cls": (dishes % CLASSES).astype(np.uint16).tobytes(), "c": c.tobytes(), "word": inverse.astype(np.uint32).tobytes(), "count": count.tobytes(), "dish": rel.tobytes(), "doc": doc.tobytes(),
                "sizes": np.array([len(d) // 2 for d in docs], np.int32).tobytes(), "first": np.array([p[0] for p in parts], np.int64).tobytes()}

    for batch in batches:
        for bucket, first, words, counts, cls, doc, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if ids is not None:
                yield _rows(_GATHERED, [{"first": np.array([first], np.int64).tobytes(), "ids": ids}])
                continue
            if bucket != now:
                if parts:
                    yield _rows(_GATHERED, [out()])
                now, parts = bucket, []
            parts.append((first, words, counts, cls, doc))
    if parts:
        yield _rows(_GATHERED, [out()])


class Seating:
    """Chinese restaurants' dishes side by side: who sits at which table, with a place for each of cap customers a dish.

    Tables are numbered by places of their dish; the free numbers of a dish are a stack.
    """

    def __init__(self, cap: np.ndarray, d: float, rng: np.random.Generator):
        self.cap, self.d, self.rng = cap.astype(np.int64), d, rng
        self.off = np.cumsum(self.cap) - self.cap
        total = int(self.cap.sum())
        self.n, self.t = np.zeros(len(cap), np.int64), np.zeros(len(cap), np.int64)
        self.who, self.size, self.free = np.zeros(total, np.int32), np.zeros(total, np.int32), np.arange(total, dtype=np.int32)

    def _open(self, i: np.ndarray) -> np.ndarray:
        """A new table of each listed dish."""
        table = self.free[self.off[i] + self.cap[i] - self.t[i] - 1]
        self.t[i] += 1
        return table

    def add(self, i: np.ndarray, w: np.ndarray) -> None:
        """A customer to each listed dish (once each): a new table weighs w, a present one its customers less the discount."""
        n = self.n[i]
        new = self.rng.random(len(i)) * (w + n - self.d * self.t[i]) < w
        new |= n == 0
        table = np.empty(len(i), np.int32)
        table[new] = self._open(i[new])
        left = np.flatnonzero(~new)
        while len(left):  # a table by its customers, kept with the chance (size - d) / size
            j = i[left]
            k = self.who[self.off[j] + (self.rng.random(len(j)) * n[left]).astype(np.int64)]
            ok = self.rng.random(len(j)) * self.size[k] < self.size[k] - self.d
            table[left[ok]] = k[ok]
            left = left[~ok]
        self.size[table] += 1
        self.who[self.off[i] + n] = table
        self.n[i] += 1

    def drop(self, i: np.ndarray) -> np.ndarray:
        """A random customer of each listed dish leaves; whether its table closes."""
        n = self.n[i]
        at = self.off[i] + (self.rng.random(len(i)) * n).astype(np.int64)
        table = self.who[at]
        self.who[at] = self.who[self.off[i] + n - 1]
        self.n[i] -= 1
        self.size[table] -= 1
        shut = self.size[table] == 0
        j = i[shut]
        self.free[self.off[j] + self.cap[j] - self.t[j]] = table[shut]
        self.t[j] -= 1
        return shut

    def fill(self, w: np.ndarray, customers: np.ndarray | None = None) -> None:
        """A first state: the customers (cap of each dish) come in runs of an eighth of those present, each run by the chances at its start."""
        customers = self.cap if customers is None else customers
        i = np.flatnonzero(customers)
        self.add(i, w[i])
        while len(i := i[self.n[i] < customers[i]]):
            n = self.n[i]
            k = np.minimum(np.maximum(1, n // 8), customers[i] - n)
            new = self.rng.binomial(k, w[i] / (w[i] + n - self.d * self.t[i]))
            old = np.repeat(i, k - new)
            near = self.who[self.off[old] + (self.rng.random(len(old)) * np.repeat(n, k - new)).astype(np.int64)]
            fresh = np.repeat(i, new)
            nth = np.arange(len(fresh)) - np.repeat(np.cumsum(new) - new, new)
            made = self.free[self.off[fresh] + self.cap[fresh] - self.t[fresh] - 1 - nth]
            self.t[i] += new
            for dish, table, start in ((old, near, n), (fresh, made, n + k - new)):
                size = k - new if dish is old else new
                nth = np.arange(len(dish)) - np.repeat(np.cumsum(size) - size, size)
                self.who[self.off[dish] + np.repeat(start, size) + nth] = table
                np.add.at(self.size, table, 1)
            self.n[i] += k

    def sweep(self, w: np.ndarray, less: np.ndarray) -> None:
        """Each customer of each dish of n > 1 is seated again, one after the other up to RUNS of them, else in RUNS runs; less is w without a leaving customer's closed table."""
        i, k = np.flatnonzero(self.n > 1), 0
        step = -(-self.n // RUNS)
        while len(i):
            begin = k * step[i]
            self._again(i, begin, np.minimum(step[i], self.n[i] - begin), w, less)
            k += 1
            i = i[k * step[i] < self.n[i]]

    def _again(self, i: np.ndarray, begin: np.ndarray, m: np.ndarray, w: np.ndarray, less: np.ndarray) -> None:
        """The m customers from place begin on of each listed dish leave, and are seated given those that stay."""
        dish, first, run = np.repeat(i, m), np.repeat(begin, m), np.repeat(m, m)
        nth = np.arange(len(dish)) - np.repeat(np.cumsum(m) - m, m)
        off, stay = self.off[dish], self.n[dish] - run
        place = off + first + nth
        table = self.who[place]
        np.subtract.at(self.size, table, 1)
        empty = np.flatnonzero(self.size[table] == 0)
        shut, at = np.unique(table[empty], return_index=True)
        j, weight = dish[empty[at]], w[dish]
        if len(j):  # tables are numbered by dish, so j is sorted
            each, closed = np.unique(j, return_counts=True)
            rank = np.arange(len(j)) - np.repeat(np.cumsum(closed) - closed, closed)
            self.free[self.off[j] + self.cap[j] - self.t[j] + rank] = shut
            self.t[each] -= closed
            had = np.isin(dish, each, kind="table")
            weight[had] = less[dish[had]]
        new = self.rng.random(len(dish)) * (weight + stay + nth - self.d * self.t[dish]) < weight
        left = np.flatnonzero(~new)
        while len(left):
            q = (self.rng.random(len(left)) * stay[left]).astype(np.int64)
            q += np.where(q >= first[left], run[left], 0)
            k = self.who[off[left] + q]
            ok = self.rng.random(len(left)) * self.size[k] < self.size[k] - self.d
            table[left[ok]] = k[ok]
            left = left[~ok]
        fresh = dish[new]
        if len(fresh):
            each, opened = np.unique(fresh, return_counts=True)
            rank = np.arange(len(fresh)) - np.repeat(np.cumsum(opened) - opened, opened)
            table[new] = self.free[self.off[fresh] + self.cap[fresh] - self.t[fresh] - 1 - rank]
            self.t[each] += opened
        self.who[place] = table
        np.add.at(self.size, table, 1)

    def follow(self, customers: np.ndarray, w: np.ndarray) -> None:
        """Customers come or leave until each dish has that many."""
        i = np.flatnonzero(self.n < customers)
        while len(i):
            self.add(i, w[i])
            i = i[self.n[i] < customers[i]]
        i = np.flatnonzero(self.n > customers)
        while len(i):
            self.drop(i)
            i = i[self.n[i] > customers[i]]


class Stirling:
    """log of S(n, t) / S(n, 1), the generalised Stirling numbers of discount d: n customers at t of up to width tables.

    Of n customers, t tables have the probability S(n, t) times the product of the tables' weights, up to a factor.
    """

    def __init__(self, d: float, most: int, width: int):
        self.d, self.most, self.width = d, most, width
        self.last = np.where(np.arange(width) == 0, 0.0, -np.inf)
        self.rows = self.last[None].astype(np.float32)

    def upto(self, n: int) -> np.ndarray:
        """Rows of 1 to n customers at least."""
        have = len(self.rows)
        if n > have:
            n = min(self.most, max(n, 2 * have))
            more, t, x = np.empty((n - have, self.width), np.float32), np.arange(1, self.width + 1), self.last
            for k in range(have, n):  # S(k + 1, t) = S(k, t - 1) + (k - d t) S(k, t)
                y = x + np.log(np.maximum(k - self.d * t, 1e-300))
                y[1:] = np.logaddexp(y[1:], x[:-1])
                x = y - y[0]
                more[k - have] = x
            self.last, self.rows = x, np.concatenate([self.rows, more])
        return self.rows

    def holds(self, n: np.ndarray, weight) -> np.ndarray:
        """Whether dishes of n customers have all their numbers of tables in a row, but for less than a 10^-12 where tables have that weight."""
        return (n <= self.width) | (n <= self.most) & (weight <= self.width * self.d / 4)

    def draw(self, n: np.ndarray, runs: list, weights, rng: np.random.Generator) -> np.ndarray:
        """Numbers of tables of dishes of n customers; weights(i, k): of the tables k = 1, 2... of the dishes i that come after the first one."""
        t = np.minimum(n, 1)
        for i in runs:
            m = n[i]
            rows, k = self.upto(int(m.max())), np.arange(1, min(int(m.max()), self.width))
            x = np.log(weights(i, k))
            np.cumsum(x, axis=1, out=x)
            x += rows[m - 1, 1:len(k) + 1]
            top = np.maximum(x.max(1), 0)
            x -= top[:, None]
            np.exp(x, out=x)
            np.cumsum(x, axis=1, out=x)
            one = np.exp(-top)
            u = rng.random(len(i)) * (one + x[:, -1]) - one
            t[i] = 1 + (u > 0) + (x[:, :-1] < u[:, None]).sum(1)
        return t


def _runs(n: np.ndarray, width: int) -> list[np.ndarray]:
    """The dishes of n > 1 customers, those of like numbers together, with up to CELLS numbers of tables in all."""
    order = np.argsort(np.minimum(n, 65535).astype(np.uint16), kind="stable")
    n, out = n[order], []
    at = int(np.searchsorted(n, 2))
    while at < len(n):
        most = n[at] + n[at] // 8
        end = min(int(np.searchsorted(n, most, "right")), at + max(1, CELLS // min(int(most), width)))
        out.append(order[at:end])
        at = end
    return out


@lru_cache(maxsize=2)
def _stirling(d: float, most: int, width: int) -> Stirling:
    return Stirling(d, most, width)


class State:
    """What every task knows: discounts, and the totals of each restaurant and of the hot words' parents, of bounded size."""

    def __init__(self, buckets, hot, n, v, customers, tables, discounts, share, hot_counts, hot_root, root):
        self.buckets, self.hot, self.n, self.v, self.customers, self.tables, self.discounts, self.share, self.hot_counts, self.hot_root, self.root = buckets, hot, n, v, customers, tables, discounts, share, hot_counts, hot_root, root

    def base(self, known: np.ndarray) -> np.ndarray:
        return np.where(known, (1 - self.share) / max(self.v, 1), self.share)

    def root_p(self, customers: np.ndarray, tables: np.ndarray, known: np.ndarray) -> np.ndarray:
        total, tabs = self.root
        d = self.discounts[1]
        return (customers - d * tables + (THETA_ROOT + d * tabs) * self.base(known)) / (THETA_ROOT + total)

    def chain(self, x: dict, bucket: int, round_: int):
        """The samples of a bucket's chain: (tables of each dish, root customers, root tables, root probability) of its words."""
        rng = np.random.default_rng([19, round_, bucket])
        d, d0 = self.discounts
        at, c, size = x["at"], x["c"], len(x["words"])
        guests, total = np.bincount(at, c, size).astype(np.int64), THETA_ROOT + self.root[0]
        t = (c > 0).astype(np.int64)
        own = bucket < self.buckets
        if own:
            known = guests > 0
            customers = np.bincount(at, t, size).astype(np.int64)
            tables = (customers > 0).astype(np.int64)
        else:
            i = np.searchsorted(self.hot, x["words"])
            known = self.hot_counts[i] > 0
            customers, tables = self.hot_root[:, i]
        p, base = self.root_p(customers, tables, known), self.base(known)
        opened = (THETA_ROOT + d0 * self.root[1]) * base
        closed = np.maximum(THETA_ROOT + d0 * (self.root[1] - 1), 1e-9) * base
        leaf, root = _stirling(d, *LEAF_ROWS), _stirling(d0, *ROOT_ROWS)
        several = np.flatnonzero(c > 1)
        ok = leaf.holds(c[several], (THETA + d * (self.tables[x["cls"][several]] + leaf.width)) * p[at[several]])
        light, heavy = several[ok], several[~ok]
        runs, word, served = _runs(c[light], leaf.width), at[light], self.tables[x["cls"][light]]
        seats, restaurant = Seating(c[heavy], d, rng), THETA + d * self.tables[x["cls"][heavy]]
        seats.fill(restaurant * p[at[heavy]])
        if own:
            ok = root.holds(guests, (THETA_ROOT + d0 * (self.root[1] + root.width)) * base)
            small, large = np.flatnonzero(ok), np.flatnonzero(~ok)
            above = Seating(guests[large], d0, rng)

        def leaf_weights(i, k):
            """Of the dishes' tables when all of theirs have left the restaurant and the parent's dish, which keeps its share of tables."""
            mine, w = t[light[i]], word[i]
            there = np.maximum(customers[w] - mine, 0)[:, None] + k
            share = np.divide(tables[w], customers[w], out=np.ones(len(w)), where=customers[w] > 0)[:, None]
            y = there - d0 * np.maximum(share * there, 1) + opened[w][:, None]
            y *= (THETA + d * np.maximum(served[i] - mine, 0))[:, None] + d * k
            return y / (np.maximum(total - mine, THETA_ROOT)[:, None] + k)

        def root_weights(i, k):
            others = np.maximum(self.root[1] - tables[small[i]], 0)[:, None]
            return base[small[i]][:, None] * (THETA_ROOT + d0 * (others + k))

        for k in range(BURN_IN + SAMPLES):
            now = leaf.draw(c[light], runs, leaf_weights, rng)
            if len(heavy):
                # a table that closes takes a customer from the parent's dish, of one of its tables on average
                alone = np.divide(tables, customers, out=np.zeros(len(p)), where=customers > 0)
                without = np.maximum((p * total - 1 + d0 * alone) / max(total - 1, 1e-9), 1e-12)
                seats.sweep(restaurant * p[at[heavy]], np.maximum(restaurant - d, 1e-9) * without[at[heavy]])
                t[heavy] = seats.t
            t[light] = now
            if own:
                customers = np.bincount(at, t, size).astype(np.int64)
                tables[small] = root.draw(customers[small], _runs(customers[small], root.width), root_weights, rng)
                if len(large):
                    if k:
                        above.follow(customers[large], opened[large])
                    else:
                        above.fill(opened[large], customers[large])
                    above.sweep(opened[large], closed[large])
                    tables[large] = above.t
                p = self.root_p(customers, tables, known)
            if k >= BURN_IN:
                yield t, customers if own else np.bincount(at, t, size), tables, p, known


def _dishes(r: dict) -> dict:
    """The dish columns of a gathered row as arrays; at: each dish's word."""
    nd = np.frombuffer(r["nd"], np.uint32).astype(np.int64)
    return {"words": np.frombuffer(r["words"], np.uint64), "nd": nd, "at": np.repeat(np.arange(len(nd)), nd), "cls": np.frombuffer(r["cls"], np.uint16).astype(np.int64), "c": np.frombuffer(r["c"], np.uint32).astype(np.int64)}


def _each(batches):
    """The rows one by one: each is a bucket."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


_WHAT = {"n": 0, "v": 1, "once": 2, "croot": 3, "troot": 4, "d1": 5, "d2": 6, "r1": 7, "r2": 8, "hot": 9, "hotdish": 10, "class": 11, "table": 12}


def _sums(parts: list) -> pa.RecordBatch:
    """(what, i, n) of (what, places, values) without zeros."""
    parts = [(w, np.atleast_1d(i), np.atleast_1d(np.asarray(n, float))) for w, i, n in parts]
    parts = [(w, i[n != 0], n[n != 0]) for w, i, n in parts]
    cols = [np.concatenate([np.full(len(i), _WHAT[w], np.int32) for w, i, _ in parts]), np.concatenate([i for _, i, _ in parts]).astype(np.int32), np.concatenate([n for *_, n in parts])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["what", "i", "n"])


def _totals(hot: np.ndarray, buckets: int):
    """Counts of all kinds that the state starts from, summed over the buckets of a task."""
    def run(batches):
        classes, tables = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in _each(batches):
            x = _dishes(r)
            c, size = x["c"], len(x["words"])
            word_c, dishes_of = np.bincount(x["at"], c, size), np.bincount(x["at"], c > 0, size)
            out = [("n", 0, c.sum())] + [(f"{kind}{k}", 0, (counts == k).sum()) for kind, counts in (("d", c), ("r", dishes_of)) for k in (1, 2)]
            if r["bucket"] < buckets:
                out += [("v", 0, (word_c > 0).sum()), ("once", 0, (word_c == 1).sum()), ("croot", 0, dishes_of.sum()), ("troot", 0, (dishes_of > 0).sum())]
            else:
                i = np.searchsorted(hot, x["words"])
                out += [("hot", i, word_c), ("hotdish", i, dishes_of)]
            classes += np.bincount(x["cls"], c, CLASSES)
            tables += np.bincount(x["cls"], c > 0, CLASSES)
            yield _sums(out)
        yield _sums([("class", np.arange(CLASSES), classes), ("table", np.arange(CLASSES), tables)])

    return run


def _sampled(state, round_: int):
    """Mean totals over the samples of each bucket's chain."""
    def run(batches):
        s, tables = state.value, np.zeros(CLASSES)
        for r in _each(batches):
            x, out = _dishes(r), []
            for t, customers, root_tables, _, _ in s.chain(x, r["bucket"], round_):
                tables += np.bincount(x["cls"], t, CLASSES) / SAMPLES
                if r["bucket"] < s.buckets:
                    out += [("croot", 0, customers.sum() / SAMPLES), ("troot", 0, root_tables.sum() / SAMPLES)]
                else:
                    out += [("hotdish", np.searchsorted(s.hot, x["words"]), customers / SAMPLES)]
            yield _sums(out)
        yield _sums([("table", np.arange(CLASSES), tables)])

    return run


_BACK = pa.schema([("first", pa.int64()), ("ids", pa.binary()), ("doc", pa.binary()), ("docs", pa.int32()), ("known", pa.binary()), ("base", pa.binary()), ("score", pa.binary())])


def _scored(state, round_: int):
    """Sums of known tokens, log10 base and log10 score of each text's tokens in a bucket, packed by piece; rows with ids pass by."""
    def run(batches):
        s = state.value
        d = s.discounts[0]
        squeeze = lambda x: pa.compress(x.tobytes(), "zstd", asbytes=True)
        for r in _each(batches):
            if r["ids"] is not None:
                yield _rows(_BACK, [{"first": int(np.frombuffer(r["first"], np.int64)[0]), "ids": r["ids"]}])
                continue
            x = _dishes(r)
            at, c, mean = x["at"], x["c"], np.zeros(len(x["c"]))
            for t, _, _, p, known in s.chain(x, r["bucket"], round_):
                mean += (c - d * t + (THETA + d * s.tables[x["cls"]]) * p[at]) / (THETA + s.customers[x["cls"]])
            word_c = np.bincount(at, c, len(x["words"])) if r["bucket"] < s.buckets else s.hot_counts[np.searchsorted(s.hot, x["words"])]
            base, score, met = np.log10((word_c + 1) / (s.n + (s.v + 1))), np.log10(mean / SAMPLES), word_c > 0
            word, count = np.frombuffer(r["word"], np.uint32), np.frombuffer(r["count"], np.uint32)
            dish, doc, sizes = np.frombuffer(r["dish"], np.uint16), np.frombuffer(r["doc"], np.uint16), np.frombuffer(r["sizes"], np.int32)
            begin, ends, token = np.cumsum(x["nd"]) - x["nd"], np.cumsum(count, dtype=np.int64), 0
            out = []
            for first, size in zip(np.frombuffer(r["first"], np.int64).tolist(), sizes.tolist()):  # piece by piece
                k, e = np.searchsorted(ends, [token + 1, token + size])
                w = np.repeat(word[k:e + 1].astype(np.int64), count[k:e + 1])
                local = doc[token:token + size] & np.uint16(_HELD - 1)
                j = begin[w] + dish[token:token + size]
                m = int(local.max()) + 1
                some = np.flatnonzero(np.bincount(local, minlength=m))
                known, b, v = (np.bincount(local, y, m)[some] for y in (met[w], base[w], score[j]))
                out.append({"first": first, "doc": squeeze(some.astype(np.uint16)), "docs": len(some), "known": squeeze(known.astype(np.uint32)), "base": squeeze(b), "score": squeeze(v.astype(np.float32))})
                token += size
            yield _rows(_BACK, out)

    return run


def _returned(batches):
    """(id, n, known, base, score) of each text, from rows sorted by piece; a piece's parts are summed as they come."""
    now, ids, sums = None, None, np.zeros((3, _HELD))
    loose = lambda x, kind, n: np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)

    def out():
        i, n = np.frombuffer(ids, np.int64).reshape(2, -1)
        known, base, score = sums[:, :len(i)].copy()
        sums[:] = 0
        return pa.RecordBatch.from_arrays([pa.array(i, mask=i == _NULL), pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=["id", "n", "known", "base", "score"])

    for batch in batches:
        for first, own, doc, size, known, base, score in zip(*(c.to_pylist() for c in batch.columns)):
            if first != now and now is not None:
                yield out()
            now = first
            if own is not None:
                ids = own
                continue
            at = loose(doc, np.uint16, size)
            for k, (x, kind) in enumerate(((known, np.uint32), (base, np.float64), (score, np.float32))):
                sums[k, at] += loose(x, kind, size)
    if now is not None:
        yield out()


def score(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    scratch = Scratch(spark, "hpylm")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    hot = hot_words(docs)
    packed = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(_packer(buckets, hot), _sql(_PACK))
    groups = packed.repartition(buckets + min(buckets, CLASSES), "bucket").sortWithinPartitions("bucket")
    grouped = scratch.table(groups.mapInArrow(_gather, _sql(_GATHERED)), "grouped", compression="zstd")
    scratch.release()
    dishes = grouped.filter("ids is null").select("bucket", "words", "nd", "cls", "c")

    def summed(df: DataFrame) -> dict[str, np.ndarray]:
        """At most a few rows for each class and hot word."""
        t = df.groupBy("what", "i").agg(F.sum("n").alias("n")).toArrow()
        what, i, n = (t.column(k).to_numpy() for k in range(3))
        out = {}
        for name, k in _WHAT.items():
            out[name] = np.zeros(CLASSES if name in ("class", "table") else max(1, len(hot)))
            out[name][i[what == k]] = n[what == k]
        return out

    z = summed(dishes.mapInArrow(_totals(hot, buckets), "what int, i int, n double"))
    one = {k: float(v[0]) for k, v in z.items()}
    hot_c, hot_d = z["hot"][: len(hot)], z["hotdish"][: len(hot)]
    n, v = int(one["n"]), int(one["v"]) + int((hot_c > 0).sum())
    discounts = [min(0.95, max(0.05, one[f"{k}1"] / (one[f"{k}1"] + 2 * one[f"{k}2"]))) if one[f"{k}1"] else 0.5 for k in "dr"]
    root = one["croot"] + hot_d.sum(), one["troot"] + (hot_d > 0).sum()
    share = float(np.clip((one["once"] + 1) / (n + 2) / ((THETA_ROOT + discounts[1] * root[1]) / (THETA_ROOT + root[0])), 1e-6, 0.9))
    state = State(buckets, hot, n, v, z["class"], z["table"], discounts, share, hot_c, np.stack([hot_d, (hot_d > 0).astype(float)]), root)
    for k in range(ROUNDS):
        x = summed(dishes.mapInArrow(_sampled(spark.sparkContext.broadcast(state), k), "what int, i int, n double"))
        hd = x["hotdish"][: len(hot)]
        # the hot words' parent dishes are few: their tables are seated here
        seats = Seating(np.round(hd), discounts[1], np.random.default_rng([29, k]))
        opened = (THETA_ROOT + discounts[1] * state.root[1]) * state.base(hot_c > 0)
        seats.fill(opened)
        for _ in range(BURN_IN):
            seats.sweep(opened, opened)
        state = State(buckets, hot, n, v, z["class"], x["table"], discounts, share, hot_c, np.stack([hd, seats.t.astype(float)]), (float(x["croot"][0]) + hd.sum(), float(x["troot"][0]) + seats.t.sum()))
    parts = grouped.mapInArrow(_scored(spark.sparkContext.broadcast(state), ROUNDS), _sql(_BACK))
    back = scratch.table(parts.repartition("first").sortWithinPartitions("first").mapInArrow(_returned, "id long, n long, known long, base double, score double"), "scores")
    scratch.drop("grouped")
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 7 == 2, F.lit(False))
    return back.select(F.col("id").alias("doc_id"), held.alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op2_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, load(spark, sf_dir, "documents"))


def brute_force(texts: dict) -> dict:
    """doc -> (held_out, n_tokens, n_known, train_tokens, base_score) for tests."""
    from collections import Counter

    tokens = {d: [*(t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split(), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    c = Counter(t for d in texts if not held[d] for t in tokens[d])
    n = sum(c.values())
    return {d: (held[d], len(x), sum(c[t] > 0 for t in x), n, float(sum(np.log10((c[t] + 1) / (n + len(c) + 1)) for t in x))) for d, x in tokens.items()}
