"""Feature tables in long form (*keys, win, metric, value): pivot, scaling, imputation, pruning, unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..operators.ranks import quantiles

META = ("labels", "exfil_path", "concrete_exfil_path", "exfil_weight", "exfil_pkts", "is_test", "attack_labels")
# Name parts that keep a column of three or more underscores.
KEPT_PARTS = ("_reciprocity", "_edge_coef_of_var", "cilium", "_ide", "class_harmonic_centrality_", "pods_cfbc_sub_coef_of_var_")


# Metrics that pruning drops by name.
DROPPED = (
    "fraction_pod_comm_but_not_VIP_comms_", "attack_labels", "pod_1si_density_list_", "new_neighbors_outside", "new_neighbors_dns", "new_neighbors_all", "new_neighbors_all ",
    "fraction_pod_comm_but_not_VIP_comms_no_abs_", "dns_list_outside_mod_z_score", "dns_list_inside_mod_z_score", "into_dns_from_outside_list_mod_z_score", "into_dns_ratio_mod_z_score",
    "kube-dns_to_outside_density_mod_z_score", "labelsmod_z_score", "fraction_pod_comm_but_not_VIP_comms_mod_z_score", "fraction_pod_comm_but_not_VIP_comms_no_abs_mod_z_score", "DNS outside_", "DNS inside_",
    "amt_of_out_traffic_bytesmod_z_score", "amt_of_out_traffic_pktsmod_z_score", "amt_of_out_traffic_pkts", "amt_of_out_traffic_bytes", "timemod_z_score", "Unnamed: 0mod_z_score", "into_dns_from_outside_",
    "pod_comm_but_not_VIP_comms_", "pod_comm_but_not_VIP_comms_no_abs_", "dns_list_outside_", "ide_angles_", "dns_list_inside_", "dns_outside_inside_ratios_", "into_dns_from_outside_list_", "into_dns_ratio_",
    "ide_angles", "DNS outside-to-inside ratio_", "into_dns_eigenval_angles_", "Unnamed: 0", "Communication Between Pods not through VIPs (no abs)_mod_z_score",
    "Fraction of Communication Between Pods not through VIPs (no abs)_mod_z_score", "DNS inside_mod_z_score", "into_dns_from_outside_mod_z_score", "DNS outside_mod_z_score",
    "Fraction of Communication Between Pods not through VIPs (no abs)_", "Communication Between Pods not through VIPs (w abs)_", "Communication Not Through VIPs",
)


def wide(features: DataFrame, metrics: Sequence[str] | None = None, keys: Sequence[str] = ("win",)) -> DataFrame:
    """One row a window, one column a metric. Listed metrics save the pass that finds them."""
    p = features.groupBy(*keys).pivot("metric", list(metrics)) if metrics else features.groupBy(*keys).pivot("metric")
    return p.agg(F.first("value"))


def long(frame: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("win",)) -> DataFrame:
    return frame.unpivot(list(keys), list(metrics), "metric", "value")


def kept_metric(metric: Column) -> Column:
    """Whether the pruning rule keeps a metric's column."""
    many = F.length(metric) - F.length(F.replace(metric, F.lit("_"), F.lit(""))) >= 3
    named = F.lit(False)
    for part in KEPT_PARTS:
        named = named | metric.contains(part)
    return ~((many & ~named) | metric.contains("class_current_flow_bc_sub_") | (metric == "attack_labels_"))


def pruned(features: DataFrame, pairwise: bool = True) -> DataFrame:
    out = features.filter(kept_metric(F.col("metric")) & ~F.col("metric").isin(*DROPPED))
    return out if pairwise else out.filter(~F.col("metric").contains("_to_"))


def without_meta(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features to fit on, exfil_weight aside): labels and descriptions of the rows aren't features."""
    return features.filter(~F.col("metric").isin(*META)), features.filter("metric = 'exfil_weight'")


def comparison(features: DataFrame, names: Sequence[str], keys: Sequence[str] = ("win",)) -> DataFrame:
    """(*keys, metric, value) of comparison methods' metrics for every row, 0 where one has none."""
    cells = features.select(*keys).distinct().withColumn("metric", F.explode(F.array(*map(F.lit, names))))
    return cells.join(features.select(*keys, "metric", "value"), [*keys, "metric"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def dropped_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metrics that a step has removed."""
    return before.select("metric").distinct().join(after.select("metric").distinct(), "metric", "left_anti")


def concatenated(frames: Sequence[DataFrame]) -> DataFrame:
    """Wide frames of several experiments one below the other, columns in order of name, null where a frame lacks one."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def complete_metrics(features: DataFrame) -> DataFrame:
    """Only metrics that have a value in every row."""
    full = features.groupBy("metric").agg(F.count("value").alias("n"), F.count("*").alias("m")).filter("n = m").select("metric")
    return features.join(full, "metric", "left_semi")


def nan_counts(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return features.groupBy(*keys, "metric").agg(F.count_if(F.col("value").isNull() | F.isnan("value")).alias("missing"))


def robust_scaled(features: DataFrame, fit_on: Column, clip_in: tuple[float, float] = (-1e9, 1e9), clip_out: float = 100.0) -> DataFrame:
    """Exact median and quartile scaling of each metric, fitted on the rows of fit_on.

    Values are clipped before and after, a quartile range of 0 counts as 1, missing values take the fitted rows' scaled
    median; metrics that then still miss values are left out.
    """
    clip = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    x = F.when(~F.isnan("value"), clip(F.col("value"), *clip_in))
    q = quantiles(features.withColumn("_x", x).filter(fit_on), "_x", (0.25, 0.5, 0.75), ["metric"])
    scale = F.when(F.col("q")[2] - F.col("q")[0] != 0, F.col("q")[2] - F.col("q")[0]).otherwise(1.0)
    out = features.withColumn("_x", x).join(q, "metric", "left").withColumn("_s", clip((F.col("_x") - F.col("q")[1]) / scale, -clip_out, clip_out))
    centre = F.when(F.col("q")[1].isNotNull(), F.lit(0.0))
    return out.withColumn("value", F.coalesce("_s", centre)).filter("value is not null").drop("_x", "_s", "q")


def eval_scaled(features: DataFrame, train_metrics: DataFrame) -> DataFrame:
    """Features of an evaluation run as a trained model takes them: aligned to its metrics, missing values as the run's
    median or else 0, clipped to [-1e7, 1e6] and scaled by the run's own quartiles."""
    seen = F.when(~F.isnan("value"), F.col("value"))
    rows = aligned(features, train_metrics).withColumn("value", seen)
    m = quantiles(rows, "value", (0.5,), ["metric"]).select("metric", F.col("q")[0].alias("_m"))
    filled = cut(rows.join(m, "metric", "left").withColumn("value", F.coalesce("value", "_m", F.lit(0.0))).drop("_m"))
    return robust_scaled(filled, F.lit(True), (-1e7, 1e6), float("inf"))


def imputed(features: DataFrame, fit_on: Column | None = None) -> DataFrame:
    """Missing values become the metric's exact median over the rows of fit_on; metrics without one are left out."""
    seen = F.when(~F.isnan("value"), F.col("value"))
    m = quantiles((features if fit_on is None else features.filter(fit_on)).withColumn("_x", seen), "_x", (0.5,), ["metric"]).select("metric", F.col("q")[0].alias("_m"))
    return features.join(m, "metric").filter("_m is not null").withColumn("value", F.coalesce(seen, "_m")).drop("_m")


def combined_rates(rows: DataFrame, first_rate) -> DataFrame:
    """All rows of one rate and the attack rows of the others, as training rows."""
    keep = (F.col("rate") == first_rate) | (F.col("label") == 1)
    return rows.filter(keep).withColumn("is_test", F.lit(0))


def with_abs(features: DataFrame, metrics: Sequence[str]) -> DataFrame:
    extra = features.filter(F.col("metric").isin(*metrics)).withColumns({"metric": F.concat(F.lit("abs_"), "metric"), "value": F.abs("value")})
    return features.unionByName(extra)


def aligned(features: DataFrame, train_metrics: DataFrame) -> DataFrame:
    """A row for each window and training metric, null where the window lacks it."""
    wins = features.select("win").distinct()
    return wins.crossJoin(train_metrics.select("metric").distinct()).join(features.select("win", "metric", "value"), ["win", "metric"], "left")
