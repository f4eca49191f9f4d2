"""Toxicity by non-negative positive-unlabelled learning.

What is known are confirmed toxic documents (positives) and texts of unknown kind (unlabelled); labels of harmless
documents only give the share of toxic ones, the class prior p. With the logistic loss l, the risk of a score f is

    p * mean over positives of l(f, 1)  +  max(0, mean over unlabelled of l(f, 0) - p * mean over positives of l(f, 0)),

and where the second term is below 0, a step goes up that term instead (Kiryo et al. 2017). Several small networks in
numpy, each in a task of its own and on other unlabelled rows, are trained for it; a document's score is their mean.

Features are counts of words and of word beginnings (4 to 6 characters). Those count whose documents among the positives
are more than among the unlabelled by a log-likelihood ratio that chance reaches in none of all features, the
MAX_FEATURES strongest. Words are counted on every whole text; the fit uses at most MAX_POSITIVE and MAX_UNLABELLED
documents, those of least hash of the id.

Defined results: null and empty texts have no word and are scored as such; without a positive, without an unlabelled text
or without a feature, every score is the class prior, 0 if there is no label; null labels, null ids in labels and labels
of unknown documents are ignored, of several labels of one id the highest counts; documents that repeat an id are
scored each, one of their texts (the least) is fitted on; a null doc_id counts as the empty text in the choice of the
fold; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load, slices
from .decontaminate import words

MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES, MIN_SUPPORT = 4096, 16384, 512, 5
BEGINNINGS = (4, 5, 6)
MEMBERS, HIDDEN, STEPS, RATE, DECAY = 3, 16, 600, 0.01, 1e-4
THRESHOLD = 0.3


def features(word: bytes) -> list[str]:
    """The word itself (marked) and its beginnings."""
    w = word.decode("utf-8", "replace")
    return ["=" + w, *(w[:k] for k in BEGINNINGS if len(w) > k)]


def _counter(batches):
    """(feature, p, u): in how many positive and unlabelled documents of a task each feature is."""
    names = ["feature", "p", "u"]

    def out(held):
        keys = sorted(set(held[0]) | set(held[1]))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in held)], names=names)

    held = (Counter(), Counter())
    for piece in slices(batches):
        for text, positive in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
            held[0 if positive else 1].update({f for w in set(words(text)) for f in features(w)})
            if len(held[0]) + len(held[1]) > 400_000:
                yield out(held)
                held = (Counter(), Counter())
    yield out(held)


def select(scratch: Scratch, sample: DataFrame) -> list[str]:
    """The features of the fit, strongest first; sample: (text, positive)."""
    n_p, n_u = sample.agg(F.sum(F.col("positive").cast("long")), F.sum((~F.col("positive")).cast("long"))).first()
    if not n_p or not n_u:
        return []
    counts = sample.select("text", "positive").mapInArrow(_counter, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    counts = scratch.table(counts, "counts")
    expected = (F.col("u") + 0.5) * float(n_p / (n_u + 1))
    ratio = F.col("p") * F.log(F.col("p") / expected) - (F.col("p") - expected)
    # by chance, exp(-ratio) of all features of enough documents reach a ratio
    n = counts.filter(F.col("p") >= MIN_SUPPORT).count()
    top = counts.select("feature", "p", expected.alias("e"), ratio.alias("ratio")).filter((F.col("p") >= MIN_SUPPORT) & (F.col("p") > F.col("e")) & (F.col("ratio") >= float(np.log(max(n, 1))))).orderBy(F.desc("ratio"), "feature").limit(MAX_FEATURES)
    return [r.feature for r in top.select("feature").collect()]


class Lexicon:
    """Counts of the chosen features in texts, as rows of log(1 + count) and of the text's length."""

    def __init__(self, chosen: list[str]):
        self.place = {f: i for i, f in enumerate(chosen)}
        self.memo: dict[bytes, tuple] = {}

    def _of(self, word: bytes) -> tuple:
        if len(self.memo) >= 300_000:
            self.memo.clear()
        hit = self.memo[word] = tuple(self.place[f] for f in features(word) if f in self.place)
        return hit

    def rows(self, texts: list) -> np.ndarray:
        x = np.zeros((len(texts), len(self.place) + 1), np.float32)
        memo = self.memo
        for r, text in enumerate(texts):
            tokens = words(text)
            for w in tokens:
                hit = memo.get(w)
                for i in self._of(w) if hit is None else hit:
                    x[r, i] += 1
            x[r, -1] = len(tokens)
        x = np.log1p(x)
        x[:, -1] /= 5
        return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Both parts of the risk (that of the negatives before the cut at 0), and the direction of descent's slope by score."""
    sp, su = _sigmoid(zp), _sigmoid(zu)
    positive = -prior * np.log(sp + 1e-12).mean()
    negative = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
    if negative >= 0:
        return positive, negative, prior * ((sp - 1) - sp) / len(sp), su / len(su)
    return positive, negative, prior * sp / len(sp), -su / len(su)


class Network:
    """One hidden layer over scaled features."""

    def __init__(self, scale: np.ndarray, weights: list[np.ndarray]):
        self.scale, self.weights = scale, weights

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x / self.scale) @ self.weights[0] + self.weights[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.hidden(x) @ self.weights[2] + self.weights[3][0])


def train(xp: np.ndarray, xu: np.ndarray, prior: float, seed: int) -> Network:
    """Adam steps on batches of 256 positives and 1024 unlabelled rows."""
    r = np.random.default_rng(seed)
    d = xp.shape[1]
    net = Network(np.sqrt((xu**2).mean(0)) + np.float32(0.05), [r.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.array([-1.0])])
    first, second = ([np.zeros_like(w) for w in net.weights] for _ in range(2))
    for step in range(1, STEPS + 1):
        p, u = (x[r.choice(len(x), min(n, len(x)), replace=False)] for x, n in ((xp, 256), (xu, 1024)))
        x = np.concatenate([p, u])
        h = net.hidden(x)
        z = h @ net.weights[2] + net.weights[3][0]
        slope = np.concatenate(risk(z[: len(p)], z[len(p) :], prior)[2:])
        back = slope[:, None] * net.weights[2] * (1 - h**2)
        for w, m, v, g in zip(net.weights, first, second, ((x / net.scale).T @ back, back.sum(0), h.T @ slope, np.array([slope.sum()]))):
            g = g + DECAY * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _rows(lexicon: Lexicon):
    """(member, part, positive, x): the rows of the fit, once for each member that uses them."""
    def run(batches):
        for piece in slices(batches):
            x = lexicon.rows(piece.column(0).to_pylist())
            positive, part = piece.column(1).to_pylist(), piece.column(2).to_pylist()
            # a member leaves out one part of the unlabelled rows
            keep = [(m, i) for i in range(len(x)) for m in range(MEMBERS) if positive[i] or part[i] != m]
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in keep], pa.int32()), pa.array([positive[i] for _, i in keep]), pa.array([x[i].tobytes() for _, i in keep], pa.binary())], names=["member", "positive", "x"])

    return run


def _trainer(prior: float):
    def run(table: pa.Table) -> pa.Table:
        x = np.stack([np.frombuffer(b, np.float32) for b in table.column("x").to_pylist()])
        order = np.lexsort(x.T[::-1])  # the fit doesn't depend on the order of arrival
        x, positive = x[order], table.column("positive").to_numpy()[order].astype(bool)
        member = table.column("member")[0].as_py()
        if positive.all() or not positive.any():
            return pa.table({"member": pa.array([], pa.int32()), "scale": pa.array([], pa.binary()), "weights": pa.array([], pa.list_(pa.binary()))})
        net = train(x[positive], x[~positive], prior, member)
        return pa.table({"member": pa.array([member], pa.int32()), "scale": pa.array([net.scale.astype(np.float64).tobytes()]), "weights": pa.array([[w.tobytes() for w in net.weights]], pa.list_(pa.binary()))})

    return run


class Classifier:
    """The mean of the networks; the class prior where there are none."""

    def __init__(self, chosen: list[str], networks: list[Network], prior: float):
        self.chosen, self.networks, self.prior = chosen, networks, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.mean([n.score(x) for n in self.networks], axis=0) if self.networks else np.full(len(x), self.prior)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Classifier:
    """Labels of held-out rows aren't read, nor their texts."""
    scratch = Scratch(spark, "toxicity")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null").filter(fold(F.col("id")) != 2)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), "toxic").filter("id is not null and toxic is not null").filter(fold(F.col("id")) != 2).groupBy("id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0]
    if not prior:
        return Classifier([], [], 0.0)
    prior = float(min(prior, 0.99))
    least = lambda ids, n: ids.orderBy(F.xxhash64("id"), "id").limit(n)
    # at most max_positive + max_unlabelled ids, so they may be sent to all
    there = rows.select("id").join(known.filter("toxic = 1").select("id"), "id").distinct()
    ids = least(there, max_positive).withColumn("positive", F.lit(True)).unionByName(least(rows.select("id").distinct(), max_unlabelled).withColumn("positive", F.lit(False)))
    ids = scratch.table(ids, "ids")
    sample = rows.join(F.broadcast(ids), "id").groupBy("id", "positive").agg(F.min("text").alias("text"))
    sample = scratch.table(sample.select("text", "positive", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(MEMBERS)).cast("int").alias("part")), "sample")
    chosen = select(scratch, sample)
    networks = []
    if chosen:
        fitted = sample.mapInArrow(_rows(Lexicon(chosen)), "member int, positive boolean, x binary").groupBy("member").applyInArrow(_trainer(prior), "member int, scale binary, weights array<binary>")
        for r in sorted(fitted.collect()):
            w = [np.frombuffer(b) for b in r.weights]
            networks.append(Network(np.frombuffer(r.scale), [w[0].reshape(-1, HIDDEN), *w[1:]]))
    scratch.drop("ids", "sample", "counts")
    return Classifier(chosen, networks, prior)


def _scorer(model: Classifier):
    def run(batches):
        lexicon = Lexicon(model.chosen)
        for piece in slices(batches, rows=256):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(model.score(lexicon.rows(piece.column(1).to_pylist())), pa.float64())], names=["id", "score"])

    return run


def score(spark: SparkSession, docs: DataFrame, model: Classifier, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; the model is some 100 KB at most and goes with the tasks."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scorer(model), f"id {rows.schema['id'].dataType.simpleString()}, score double")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit(spark, docs, load(spark, sf_dir, "labels"))
    found = score(spark, docs, model)
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
