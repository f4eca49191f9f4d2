"""Writers of the text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_files(edges: DataFrame, path: str, by: tuple[str, ...] = ("gran",)) -> None:
    """Edge lines, one folder for each value of by."""
    line = F.concat_ws(" ", "src", "dst", F.concat(F.lit("{'frames':"), F.col("frames").cast("string"), F.lit(",'weight':"), F.col("weight").cast("string"), F.lit("}")))
    edges.select(*by, line.alias("value")).write.mode("overwrite").partitionBy(*by).text(path)


def manifest(rows: DataFrame, path: str) -> None:
    """JSON lines: manifests, mappings, lists of infrastructure."""
    rows.write.mode("overwrite").json(path)


def weighted_features(features: DataFrame, coefficients: DataFrame, path: str) -> None:
    """Parquet of the features (win, metric, value) whose coefficient (metric, coef) isn't 0, with it."""
    used = coefficients.filter("coef <> 0")
    features.join(used, "metric").select("win", "metric", "value", "coef").write.mode("overwrite").parquet(path)


def feature_csv(frame: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """A feature table with '?' for missing values, a folder for each value of by (rates, granularities, experiments)."""
    frame.write.mode("overwrite").option("header", True).option("nullValue", "?").partitionBy(*by).csv(path)


def edge_table(edges: DataFrame, path: str, by: tuple[str, ...] = ("win",)) -> None:
    """Parquet of edges with all attributes they have (services, marks of injection), a folder for each value of by."""
    edges.write.mode("overwrite").partitionBy(*by).parquet(path)


def node_vectors(vectors: DataFrame, path: str, keys: tuple[str, ...] = ("win",)) -> None:
    """Parquet of vectors over nodes (*keys, node, value): nodes in order and their values as arrays, a row for each window."""
    pairs = F.sort_array(F.collect_list(F.struct("node", "value")))
    vectors.groupBy(*keys).agg(pairs.alias("p")).select(*keys, F.col("p.node").alias("nodes"), F.col("p.value").alias("values")).write.mode("overwrite").parquet(path)


def policy_lines(pairs: DataFrame, path: str) -> None:
    pairs.select(F.concat_ws(" ALLOWED ", "src", "dst").alias("value")).write.mode("overwrite").text(path)


def numbered_edges(edges: DataFrame, path: str, nodes: DataFrame, by: tuple[str, ...] = ()) -> None:
    """`a b weight` lines with node numbers from nodes(node, id), a folder for each value of by."""
    a = nodes.select(F.col("node").alias("src"), F.col("id").alias("a"))
    b = nodes.select(F.col("node").alias("dst"), F.col("id").alias("b"))
    lines = edges.join(a, "src").join(b, "dst").select(*by, F.concat_ws(" ", "a", "b", "weight").alias("value"))
    lines.write.mode("overwrite").partitionBy(*by).text(path)


def html_table(rows: DataFrame, limit: int = 1000) -> str:
    """A report table of the first rows; reports are small."""
    head = "".join(f"<th>{c}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{v}</td>" for v in r) + "</tr>" for r in rows.limit(limit).collect())
    return f"<table><tr>{head}</tr>{body}</table>"
