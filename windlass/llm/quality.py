"""Quality classifier: document evidence combined with site posteriors by hierarchical empirical Bayes.

Boosted trees over shape features and lexicon hits give each document's evidence for two faults, low quality and
toxicity. They are fitted on a bounded sample of the labelled rows (MAX_LABELLED, by hash of the id); the lexicon are the
words of that sample that tell toxic documents apart (by G-test). The rates of both faults are then estimated for
all documents by grouped aggregation: the global rate, the rate of each host shrunk towards it, and the rate of each
path shrunk towards its host's, with the strength of shrinkage estimated from the spread between sites by the
method of moments (with a single site there is no spread to learn from: it takes its prior's rate). A document's
posterior log odds are those of its path without the document itself, plus its evidence.

Defined results: null and empty texts are scored by their (zero) features; null hosts and paths are the site ''; without
labels of both classes the evidence is 0 and nothing is rejected for that fault; null labels and labels of unknown
documents are ignored; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boost import Boosted
from .common import Scratch, load, slices
from .decontaminate import words

MAX_LABELLED, MAX_LEXICON, LEXICON_SHARE, MIN_SUPPORT = 8000, 1000, 0.2, 5
FAULTS = ("bad", "toxic")


def shape(text: str | None, tokens: list[bytes]) -> list[float]:
    """Length, repetition and character make-up of a text."""
    text = text or ""
    plain, n, chars = text.split(), len(tokens), max(1, len(text))
    count = Counter(tokens)
    lines = [x for x in text.split("\n") if x]
    ascii_ = text.encode("ascii", "replace")
    upper = len(ascii_) - len(ascii_.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(ascii_) - len(ascii_.translate(None, b"0123456789"))
    marks = len(ascii_) - len(ascii_.translate(None, b"!\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~"))
    return [
        float(len(plain)), len(text) / max(1, len(plain)), n / max(1, len(plain)), len(count) / max(1, n), max(count.values(), default=0) / max(1, n), marks / chars, upper / chars, digits / chars,
        len(set(lines)) / max(1, len(lines)), (text.count("|") + text.count("{") + text.count("<")) / max(1, len(plain)), max((len(w) for w in plain), default=0) / 10.0, float(len(lines)),
    ]


def _hits(found: dict[bytes, int], n: int, lexicon: dict[bytes, float]) -> list[float]:
    """Lexicon features from the counts of the lexicon words in a text of n tokens, for fitting and scoring alike."""
    total = sum(found.values())
    return [float(len(found)), float(total), total / max(1, n), sum(lexicon[w] for w in sorted(found))]


def _labelled(batches):
    for piece in slices(batches):
        texts = piece.column(0).to_pylist()
        tokens = [words(t) for t in texts]
        counts = [Counter(w.decode("utf-8", "replace") for w in t) for t in tokens]
        terms = pa.array([[{"w": w, "c": k} for w, k in c.items()] for c in counts], pa.list_(pa.struct([("w", pa.string()), ("c", pa.int64())])))
        sizes = pa.array([len(t) for t in tokens], pa.int64())
        yield pa.RecordBatch.from_arrays([piece.column(1), piece.column(2), pa.array([shape(x, t) for x, t in zip(texts, tokens)], pa.list_(pa.float64())), sizes, terms], names=["bad", "toxic", "shape", "n", "terms"])


def lexicon(train: DataFrame) -> dict[bytes, float]:
    """word -> log odds ratio of the words that tell toxic documents apart: a G statistic of at least LEXICON_SHARE of the largest."""
    n1, n0 = train.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not n1 or not n0:
        return {}
    c = train.select("toxic", F.explode("terms.w").alias("w")).groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).filter(F.col("a") >= MIN_SUPPORT)
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    e = (F.col("a") + F.col("b")) * n1 / (n1 + n0)
    top = c.filter(odds > 0).select("w", odds.alias("odds"), (F.col("a") * F.log(F.col("a") / e)).alias("g")).orderBy(F.desc("g"), "w").limit(MAX_LEXICON).collect()
    return {r.w.encode(): r.odds for r in top if r.g >= LEXICON_SHARE * top[0].g}


def _with_hits(lex: dict[bytes, float]):
    known = {w.decode(): w for w in lex}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [{known[t["w"]]: t["c"] for t in terms if t["w"] in known} for terms in part.column(4).to_pylist()]
                hits = pa.array([_hits(f, n, lex) for f, n in zip(found, part.column(3).to_pylist())], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], hits], names=["bad", "toxic", "shape", "hits"])

    return run


class Classifier:
    """Evidence of both faults; None in place of trees where a class has no label."""

    def __init__(self, lex: dict[bytes, float], trees: dict[str, Boosted | None], prior: dict[str, float]):
        self.lex, self.trees, self.prior = lex, trees, prior

    def evidence(self, texts: list) -> dict[str, np.ndarray]:
        rows = []
        for t in texts:
            tokens = words(t)
            rows.append(shape(t, tokens) + _hits(Counter(w for w in tokens if w in self.lex), len(tokens), self.lex))
        x, out = np.array(rows).reshape(len(texts), -1), {}
        for fault in FAULTS:
            if self.trees[fault] is None:
                out[fault] = np.zeros(len(texts))
            else:
                p = np.clip(self.trees[fault].predict(x), 1e-6, 1 - 1e-6)
                out[fault] = np.log(p / (1 - p)) - np.log(self.prior[fault] / (1 - self.prior[fault]))
        return out


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch, *, id_col="doc_id", text_col="text", max_labelled: int = MAX_LABELLED) -> Classifier:
    sample = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg((1 - F.min("quality")).cast("long").alias("bad"), F.max("toxic").cast("long").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # at most max_labelled rows of 24 bytes
    train = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id").select("text", "bad", "toxic")
    train = scratch.table(train.mapInArrow(_labelled, "bad long, toxic long, shape array<double>, n long, terms array<struct<w:string,c:long>>"), "train")
    if train.count() > max_labelled:  # only where documents repeat an id
        train = train.limit(max_labelled)
    lex = lexicon(train)
    rows = train.select("bad", "toxic", "shape", "n", "terms").mapInArrow(_with_hits(lex), "bad long, toxic long, shape array<double>, hits array<double>").collect()
    rows.sort(key=lambda r: (r.shape, r.hits, r.bad, r.toxic))
    x = np.array([r.shape + r.hits for r in rows])
    trees: dict[str, Boosted | None] = {}
    prior = {}
    for fault in FAULTS:
        y = np.array([r[fault] for r in rows], float)
        prior[fault] = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        trees[fault] = Boosted().fit(x, y) if 0 < y.sum() < len(y) else None
    return Classifier(lex, trees, prior)


def _scorer(model: Classifier):
    def run(batches):
        for piece in slices(batches, rows=256):
            e = model.evidence(piece.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), piece.column(2), *(pa.array(e[f]) for f in FAULTS)], names=["doc_id", "host", "path", *(f"e_{f}" for f in FAULTS)])

    return run


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, fault: str, mean: Column) -> float:
    """Pseudo-count of the prior, from the spread of group means beyond that of binomial counts (method of moments)."""
    n, p = F.col("n"), F.col(f"s_{fault}") / F.col("n")
    r = groups.agg(F.sum(n), F.count("*"), F.sum(n * (p - mean) ** 2), F.sum(n * mean * (1 - mean))).first()
    total, k, spread, within = (float(x or 0) for x in r)
    if k < 2 or within <= 0:
        return 1e6
    tau = (spread - within / total * (k - 1)) / total
    return float(np.clip(within / total / tau - 1, 1.0, 1e6)) if tau > 0 else 1e6


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, model: Classifier | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, host, path, evidence, site rates and posteriors of both faults, keep) of each document."""
    scratch = Scratch(spark, "quality")
    model = model or fit(spark, docs, labels, scratch, id_col=id_col, text_col=text_col, max_labelled=max_labelled)
    site = [F.coalesce((c if c is not None else F.lit("")).cast("string"), F.lit("")).alias(n) for c, n in ((host, "host"), (path, "path"))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *site, F.col(text_col).alias("text"))
    rows = scratch.table(rows.mapInArrow(_scorer(model), "doc_id long, host string, path string, e_bad double, e_toxic double"), "evidence")
    chance = [(1 / (1 + F.exp(-(F.col(f"e_{f}") + float(np.log(model.prior[f] / (1 - model.prior[f]))))))).alias(f"p_{f}") for f in FAULTS]
    paths = scratch.table(rows.select("host", "path", *chance).groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(f"p_{f}").alias(f"s_{f}") for f in FAULTS)), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(f"s_{f}").alias(f"s_{f}") for f in FAULTS))
    total = hosts.agg(F.sum("n").alias("n"), *(F.sum(f"s_{f}").alias(f"s_{f}") for f in FAULTS)).first()
    rate = {f: (total[f"s_{f}"] or 0.0) / (total["n"] or 1) for f in FAULTS}
    strength = {f: _strength(hosts, f, F.lit(rate[f])) for f in FAULTS}
    hosts = hosts.select("host", F.col("n").alias("host_n"), *(F.col(f"s_{f}").alias(f"host_s_{f}") for f in FAULTS))
    sites = scratch.table(paths.join(hosts, "host"), "sites")
    shrunk = lambda s, n, m, prior: (s + m * prior) / (n + m)
    within = {f: _strength(sites, f, shrunk(F.col(f"host_s_{f}"), F.col("host_n"), strength[f], rate[f])) for f in FAULTS}
    out = rows.join(sites, ["host", "path"])
    for f in FAULTS:
        # a document is judged by the others of its host and path: its own evidence counts once
        own = 1 / (1 + F.exp(-(F.col(f"e_{f}") + float(np.log(model.prior[f] / (1 - model.prior[f]))))))
        host_rate = shrunk(F.greatest(F.col(f"host_s_{f}") - own, F.lit(0.0)), F.col("host_n") - 1, strength[f], rate[f])
        out = out.withColumn(f"site_{f}", shrunk(F.greatest(F.col(f"s_{f}") - own, F.lit(0.0)), F.col("n") - 1, within[f], host_rate))
        odds = _logit(F.col(f"site_{f}")) + F.col(f"e_{f}") if model.trees[f] is not None else F.lit(-20.0)
        out = out.withColumn(f"post_{f}", 1 / (1 + F.exp(-odds)))
    found = out.select("doc_id", "host", "path", *(f"{x}_{f}" for f in FAULTS for x in ("e", "site", "post")), ((F.col("post_bad") < 0.5) & (F.col("post_toxic") < 0.5)).alias("keep"))
    found = scratch.table(found, "out")
    scratch.drop("train", "evidence", "paths", "sites")
    return found


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))
