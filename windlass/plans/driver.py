"""From a configuration to scores: plans, injected graphs, features, scaling and models, over all experiments and granularities."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import reciprocity
from ..operators.lineage import cut
from .features import robust_scaled
from .lasso import Lasso
from .models import GRID
from .schedule import budgets, planned

KEYS = ("exp", "gran", "win")
#: Bytes of a unit of the configured rates.
MEGABYTE = 1_000_000


@dataclass
class Config:
    """Settings of a run. The names and defaults of configuration files."""

    time_interval_lengths: Sequence[int] = (10, 60)
    time_of_synethic_exfil: int = 60
    goal_train_test_split_training: float = 1.0
    goal_attack_NoAttack_split_training: float = 0.5
    goal_attack_NoAttack_split_testing: float = 0.2
    avg_exfil_per_min: Sequence[float] = (10.0, 1.0, 0.1, 0.05, 0.01)
    exfil_per_min_variance: Sequence[float] = (0.3, 0.15, 0.025, 0.0125, 0.0025)
    avg_pkt_size: Sequence[float] | None = None
    drop_pairwise_features: bool = False
    model: str = "lasso_path"

    @staticmethod
    def of(text: str, is_eval: bool = False) -> Config:
        """From JSON: what it leaves out takes the default, of an evaluation run all windows are test; names that aren't known are left out."""
        found = json.loads(text)
        known = {f.name: found[f.name] for f in fields(Config) if found.get(f.name) is not None}
        if is_eval:
            known.setdefault("goal_train_test_split_training", 0.0)
        c = Config(**known)
        if c.avg_pkt_size is None:
            c.avg_pkt_size = [500.0] * len(c.avg_exfil_per_min)
        if not len(c.avg_exfil_per_min) == len(c.exfil_per_min_variance) == len(c.avg_pkt_size):
            raise ValueError("rates, their deviations and packet sizes must be as many")
        if any(max(c.time_interval_lengths) % g for g in c.time_interval_lengths):
            raise ValueError("granularities must divide the largest one")
        if c.model not in GRID:
            raise ValueError(f"no model {c.model}")
        return c

    @staticmethod
    def read(spark: SparkSession, path: str, is_eval: bool = False) -> dict[str, Config]:
        """By file, for a file, a folder or a pattern of paths."""
        return {r.file: Config.of(r.value, is_eval) for r in spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")).collect()}


def features(services: DataFrame, pairwise: bool = True) -> DataFrame:
    """(exp, gran, win, metric, value) of service graphs: reciprocity, all weight, and the weight of each pair of services."""
    total = services.groupBy(*KEYS).agg(F.sum("weight").cast("double").alias("value")).select(*KEYS, F.lit("weight").alias("metric"), "value")
    out = total.unionByName(reciprocity(services, KEYS).select(*KEYS, F.lit("reciprocity").alias("metric"), F.col("reciprocity").alias("value")))
    if pairwise:
        out = out.unionByName(services.select(*KEYS, F.concat_ws("_to_", "src", "dst").alias("metric"), F.col("weight").cast("double").alias("value")))
    return out


def frames(rows: DataFrame, marks: DataFrame) -> tuple[DataFrame, list[str]]:
    """(exp, gran, win, label, is_test, path_id, metrics) of features, and the metrics' names; each is scaled by the training windows of its experiment and granularity.

    marks: (exp, gran, win, label, is_test, path_id). Without training windows, as in an evaluation, all windows scale. A pair
    that a window lacks weighs nothing there.
    """
    group = F.concat_ws("\x01", "exp", F.col("gran").cast("string"), "metric")
    long = rows.join(marks, list(KEYS))
    some = marks.filter("is_test = 0").limit(1).count() > 0
    scaled = cut(robust_scaled(long.withColumn("metric", group), F.col("is_test") == 0 if some else F.lit(True)))
    scaled = scaled.withColumn("metric", F.element_at(F.split("metric", "\x01"), -1))
    names = sorted(r.metric for r in scaled.select("metric").distinct().collect())  # at most the square of the services
    wide = scaled.groupBy(*KEYS).pivot("metric", names).agg(F.first("value")).na.fill(0.0, names)
    return cut(marks.join(wide, list(KEYS))), names


def marks(windows: DataFrame, labels: DataFrame, carried: DataFrame, budget: DataFrame, coarse: int) -> DataFrame:
    """Of each window (exp, gran, win): whether it is attacked or carries a path, whether it is past training, and the path."""
    hit = labels.filter("label = 1").select("exp", F.col("win").alias("_w"), F.lit(1).alias("_hit"))
    out = windows.withColumn("_w", F.floor(F.col("win") * F.col("gran") / coarse)).join(hit, ["exp", "_w"], "left").join(carried.select(*KEYS, "path_id"), list(KEYS), "left").join(budget.select("exp", "train_end"), "exp")
    label = (F.col("_hit").isNotNull() | F.col("path_id").isNotNull()).cast("double")
    return out.select(*KEYS, label.alias("label"), (F.col("_w") >= F.col("train_end")).cast("int").alias("is_test"), "path_id")


def run(edges: DataFrame, labels: DataFrame, paths: DataFrame, nodes: DataFrame, config: Config, seed: int = 0, models: dict | None = None) -> tuple[DataFrame, dict]:
    """Scores (rate, exp, gran, win, label, is_test, path_id, score) of every window, and the models by (rate, granularity).

    edges: (exp, gran, win, src, dst, frames, weight) at the configured granularities; labels: (exp, win, label) at the largest
    one; paths: (path_id, path); nodes: (node, svc). Models of an earlier run score this one instead of new ones.
    """
    edges, labels, paths = cut(edges), cut(labels), cut(paths)
    coarse = max(config.time_interval_lengths)
    slot = -(-config.time_of_synethic_exfil // coarse)
    shares = (config.goal_train_test_split_training, config.goal_attack_NoAttack_split_training, config.goal_attack_NoAttack_split_testing)
    budget = cut(budgets(labels, slot, *shares))
    parts, fitted = [], {}
    # a handful of rates and granularities
    for rate, deviation, packet in zip(config.avg_exfil_per_min, config.exfil_per_min_variance, config.avg_pkt_size):
        carried, services = planned(edges, labels, paths, nodes, slot=slot, coarse=coarse, grans=config.time_interval_lengths, train_share=shares[0], attack_share=shares[1], test_share=shares[2], rate=F.lit(rate * MEGABYTE), deviation=deviation * MEGABYTE, seed=seed, packet=int(packet))
        rows, names = frames(features(cut(services), not config.drop_pairwise_features), marks(edges.select(*KEYS).distinct(), labels, carried, budget, coarse))
        for gran in config.time_interval_lengths:
            own = rows.filter(F.col("gran") == gran)
            model = (models or {}).get((rate, gran))
            if model is None:
                train = own.filter("is_test = 0")
                model = Lasso.fit(train, names, order=("exp", "win")) if config.model == "lasso_path" else GRID[config.model](train, names)
            fitted[rate, gran] = model
            lacking = [m for m in getattr(model, "metrics", names) if m not in own.columns]
            seen = model.scored(own.withColumns({m: F.lit(0.0) for m in lacking}))
            parts.append(seen.select(F.lit(float(rate)).alias("rate"), *KEYS, "label", "is_test", "path_id", "score"))
    return reduce(DataFrame.unionByName, parts), fitted
