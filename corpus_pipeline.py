"""The training-data pipeline: a document table through five operators, each stage over all that the one before kept.

Rows with a null doc_id can't be named by a decision and stay; all other cases are those of the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.llm import decontaminate, jaccard, pii, quality, spm
from windlass.llm.common import Scratch, load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality and toxic ones go."""
    found = quality.classify(spark, docs, load(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))
    return docs.join(found.filter("not keep").select("doc_id").distinct(), "doc_id", "left_anti").select(COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingle sets of Jaccard >= 0.8 connect, that of the least id stays; of repeated rows of it, one."""
    found = jaccard.Join(spark, docs, n=5, percent=80).run()
    found = Scratch(spark, "deduplicate").table(found, "found")
    others = found.filter("component_id <> doc").select(F.col("doc").alias("doc_id")).distinct()
    kept = docs.join(others, "doc_id", "left_anti").select(COLUMNS)
    if found.groupBy("doc").count().filter("count > 1").limit(1).count() == 0:
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).union(kept.filter("doc_id is null"))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    found = decontaminate.find(spark, docs, load(spark, sf_dir, "benchmark"))
    hit = found.filter(F.size("hit_spans") > 0).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(hit, "doc_id", "left_anti").select(COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    found = pii.find(docs.select(COLUMNS), redact=True)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding them gives the text again."""
    coded = spm.encode(docs.select(COLUMNS), check=True, keep_text=False)
    return coded.select(
        "doc_id", "lang", "source", "n_chars", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_tokens"), "ids", "round_trip"
    )


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", clean_of_benchmark),
    ("PII", redact),
    ("SentencePiece encoding and decoding", tokenize),
]

#: Trees, components and merge rules have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        docs = scratch.table(done, f"stage-{k}") if k < len(STAGES) - 1 else done
        if k > 1:
            scratch.drop(f"stage-{k - 2}")
    return docs
