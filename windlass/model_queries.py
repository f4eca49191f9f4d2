"""Queries of models over daily and weekly frames of all line items; tests hold the models against their definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators.lineage import cut
from .plans import boosting as B
from .plans.lasso import Lasso, multi_granularity
from .plans.rates import lowered
from .plans.scoring import lowest_rates
from .plans.trees import ExtraTrees
from .queries import query
from .sources import adapters as A

METRICS = tuple(f"group_{k}" for k in range(6))


def _frame(spark, d, days: int = 1):
    """(win, label, is_test, a metric by group of suppliers): shares of a window's shipped value; a label where one group has over a quarter."""
    i = A.table(spark, d, "lineitem").select(F.floor(F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")) / days).alias("win"), (F.col("l_suppkey") % 6).alias("g"), F.col("l_extendedprice").cast("double").alias("v"))
    sums = i.groupBy("win").agg(F.sum("v").alias("all"), *(F.sum(F.when(F.col("g") == k, F.col("v")).otherwise(0.0)).alias(m) for k, m in enumerate(METRICS)))
    shares = sums.select("win", *(F.round(F.col(m) / F.col("all"), 6).alias(m) for m in METRICS))
    return cut(shares.withColumns({"label": (F.col("group_2") > 0.25).cast("double"), "is_test": (F.col("win") * days >= 1800).cast("int")}))


def _scored(frame, fit):
    model = fit(frame.filter("is_test = 0"))
    return model.scored(frame).select("win", "label", "is_test", "score")


@query()
def lasso_path_scores(spark, d):
    return _scored(_frame(spark, d), lambda f: Lasso.fit(f, METRICS))


@query()
def lasso_path_coefficients(spark, d):
    return Lasso.fit(_frame(spark, d), METRICS).coefficients(spark)


@query()
def multi_granularity_scores(spark, d):
    """Daily and weekly models, their scores at weeks, and the model over these."""
    return multi_granularity({1: _frame(spark, d), 7: _frame(spark, d, 7)}, METRICS)[2].select("win", "label", "is_test", F.col("`1`").alias("daily"), F.col("`7`").alias("weekly"), "score")


@query()
def boosting_regressor_scores(spark, d):
    return _scored(_frame(spark, d), lambda f: B.R2(B.tree(), 5).fit(f, METRICS))


@query()
def boosting_lasso_scores(spark, d):
    return _scored(_frame(spark, d), lambda f: B.R2(B.lasso(), 5).fit(f, METRICS))


@query()
def boosting_classifier_scores(spark, d):
    return _scored(_frame(spark, d), lambda f: B.SammeR(B.stump(), 5).fit(f, METRICS))


@query()
def boosting_logistic_scores(spark, d):
    return _scored(_frame(spark, d), lambda f: B.SammeR(B.logistic(), 5).fit(f, METRICS))


@query()
def extra_trees_scores(spark, d):
    return _scored(_frame(spark, d), lambda f: ExtraTrees().fit(f, METRICS))


_RATED = """WITH r AS (SELECT event_id, CAST([1, 5, 10][event_id % 3 + 1] AS INTEGER) AS rate, CASE WHEN event_type = 'error' THEN CAST(user_id % 4 AS VARCHAR) END AS path, value FROM events),
d AS (SELECT path, rate, avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END) AS tpr FROM r WHERE path IS NOT NULL GROUP BY ALL),
c AS (SELECT d.path, min(rate) AS rate FROM d JOIN (SELECT path, max(rate) AS most, max_by(tpr, rate) AS top FROM d GROUP BY path) m ON m.path = d.path WHERE (tpr >= top AND tpr <> 0) OR rate = most GROUP BY d.path)
SELECT r.* FROM r LEFT JOIN c ON c.path = r.path WHERE r.rate = coalesce(c.rate, 10)"""


@query(_RATED)
def lowered_rate_rows(spark, d):
    """Events as rows of three rates: those of the largest, but of each path those of its lowest rate that is seen as well."""
    rate = F.element_at(F.array(F.lit(1), F.lit(5), F.lit(10)), (F.col("event_id") % 3 + 1).cast("int"))
    rows = A.table(spark, d, "events").select("event_id", rate.alias("rate"), F.when(F.col("event_type") == "error", (F.col("user_id") % 4).cast("string")).alias("path"), "value")
    seen = rows.filter("path is not null").groupBy("path", "rate").agg(F.avg((F.col("value") > 50).cast("int")).alias("tpr"))
    return lowered(rows, lowest_rates(seen))
