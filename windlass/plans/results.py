"""Result tables over runs: averages of trials, order, distances of mixes, plot data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import quantiles


def averaged(trials: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means over trials by key, never by row position."""
    return trials.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))


def sorted_results(rows: DataFrame, gran: str = "gran", rate: str = "rate", load: str = "load") -> DataFrame:
    return rows.orderBy(F.asc(gran), F.desc(rate), F.desc(load))


def mix_distance(mixes: DataFrame, base: str, key: str, part: str, share: str) -> DataFrame:
    """Euclidean distance of each mix (key, part, share) to the base mix."""
    b = mixes.filter(F.col(key) == base).select(part, F.col(share).alias("_b"))
    parts = mixes.select(part).distinct()
    all_ = mixes.select(key).distinct().crossJoin(parts).join(mixes, [key, part], "left").join(b, part, "left")
    d = F.coalesce(share, F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))
    return all_.groupBy(key).agg(F.sqrt(F.sum(d * d)).alias("distance"))


def contributions(features: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Mean value and mean coefficient times value of each metric by path."""
    joined = features.join(coefficients, "metric")
    return joined.groupBy("path", "metric").agg(F.avg(F.col("value") * F.col("coef")).alias("contribution"), F.avg("value").alias("mean"))


def box_stats(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    q = quantiles(values, "value", (0.25, 0.5, 0.75), keys)
    ends = values.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return ends.join(q, list(keys), "left").select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "lo", "hi")


def by_method(cube: DataFrame, methods: Sequence[str], keys: Sequence[str], value: str = "f1") -> DataFrame:
    """One column for each method."""
    return cube.groupBy(*keys).pivot("method", list(methods)).agg(F.first(value))
