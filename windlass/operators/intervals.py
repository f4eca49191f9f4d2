"""Joins of intervals on overlap, as joins on equal cells of a grid.

Intervals are half open and of whole numbers. One of length n lies on the level of the next power of two, where it covers at
most two cells. Of a pair, one has the higher level (or the same): the other one looks it up in the at most two cells that it
covers itself on that level. So a row is repeated at most twice for each level that there is, short and long intervals alike, and
no task compares more than the rows of a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(lo: Column, hi: Column) -> Column:
    return F.ceil(F.log2((hi - lo).cast("double"))).cast("int")


def overlapping(left: DataFrame, right: DataFrame, lo: str = "lo", hi: str = "hi", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of rows of left [lo, hi) and right [start, end) that share a point; empty and null intervals share none.

    The columns of both sides, which need names of their own; equal rows make a pair each.
    """
    a = left.filter(F.col(lo) < F.col(hi)).withColumn("_la", _level(F.col(lo), F.col(hi)))
    b = right.filter(F.col(start) < F.col(end)).withColumn("_lb", _level(F.col(start), F.col(end)))
    return _looked_up(a, b, "_la", "_lb", lo, hi, start, end, True).unionByName(_looked_up(b, a, "_lb", "_la", start, end, lo, hi, False)).select(*left.columns, *right.columns)


def _looked_up(small: DataFrame, large: DataFrame, own: str, other: str, lo: str, hi: str, start: str, end: str, same: bool) -> DataFrame:
    """Pairs whose large side has the higher level (or, if same, an equal one)."""
    levels = large.agg(F.sort_array(F.collect_set(other)).alias("_levels"))  # at most 64 numbers
    up = F.filter("_levels", lambda x: (x >= F.col(own)) if same else (x > F.col(own)))
    probe = small.join(F.broadcast(levels)).withColumn("_level", F.explode(up)).drop("_levels")
    cell = lambda c, level: f"cast(floor({c} / power(2D, {level})) as long)"
    cells = lambda df, x, y, level: df.withColumn("_cell", F.explode(F.expr(f"sequence({cell(x, level)}, {cell(f'({y} - 1)', level)})")))
    probe = cells(probe, f"`{lo}`", f"`{hi}`", "_level")
    held = cells(large.withColumn("_level2", F.col(other)), f"`{start}`", f"`{end}`", "_level2").withColumnRenamed("_cell", "_cell2")
    both = probe.join(held, (F.col("_level") == F.col("_level2")) & (F.col("_cell") == F.col("_cell2")))
    # a pair may meet in two cells; that of the later beginning counts
    first = F.expr(cell(f"greatest(`{lo}`, `{start}`)", "_level"))
    return both.filter((F.col(lo) < F.col(end)) & (F.col(start) < F.col(hi)) & (F.col("_cell") == first)).drop("_level", "_cell", "_level2", "_cell2", own, other)


def first_overlap(left: DataFrame, right: DataFrame, pick: str, lo: str = "lo", hi: str = "hi", start: str = "start", end: str = "end") -> DataFrame:
    """Each row of left with the least pick of the rows of right that it overlaps, null without; equal rows of left are kept."""
    found = overlapping(left.distinct(), right.select(pick, start, end), lo, hi, start, end).groupBy(*left.columns).agg(F.min(pick).alias(pick))
    renamed = found.select(*(F.col(c).alias(f"_r_{c}") for c in left.columns), pick)
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in left.columns]
    return left.join(renamed, same, "left").select(*left.columns, pick)
