"""A segmented scan of a recurrence with few states: amounts that wait until they are worth sending.

Of each key, windows come in order. A window's amount is floor((rate + carry) * seconds / 60); if it is under the least, it is
carried to the next window and nothing is sent, else it is sent and nothing is carried. A carry is one of least whole numbers, so
what a block of windows does is a list of least numbers, the carry after it for each carry before. Blocks of BLOCK windows are
summed up so, blocks of BLOCK blocks again, until one is left; then the carries go down the same levels. No task has
more than BLOCK windows of a block, however many windows a key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

BLOCK = 512


def amount(rate: Column, carry: Column, seconds: int) -> Column:
    """What a window sends or carries; a rate (bytes a minute) under 0 counts as 0."""
    return F.floor((F.greatest(rate, F.lit(0.0)) + carry) * seconds / 60).cast("long")


def _after(x: Column, least: int) -> Column:
    return F.when(x < least, x).otherwise(F.lit(0).cast("long"))


def _children(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(*keys, _up, _list): the rows of each block, in order of their places."""
    up = F.floor(F.col("_at") / BLOCK)
    return rows.groupBy(*keys, up.alias("_up")).agg(F.sort_array(F.collect_list(F.struct("_at", F.col(value).alias("x")))).alias("_list"))


def carried(rows: DataFrame, keys: Sequence[str], order: str, rate: str, seconds: int, least: int = 60) -> DataFrame:
    """(*keys, order, amount, sent): one row for each of rows, which have a window number (long) and a rate, once for each key and window.

    Null rates count as 0. Null keys are a key of their own.
    """
    zero = F.lit(0).cast("long")
    states = F.sequence(zero, F.lit(least - 1).cast("long"))
    at = rows.select(*keys, F.col(order).cast("long").alias("_at"), F.coalesce(F.col(rate).cast("double"), F.lit(0.0)).alias("x"))
    # what each block makes of each carry, level by level
    blocks = _children(at, keys, "x")
    does = F.aggregate("_list", states, lambda acc, r: F.transform(acc, lambda c: _after(amount(r["x"], c, seconds), least)))
    level = cut(blocks.select(*keys, F.col("_up").alias("_at"), "_list", does.alias("f")))
    levels = [level]
    low, high = level.agg(F.min("_at"), F.max("_at")).first()
    while low is not None and low != high:
        up = _children(level.select(*keys, "_at", "f"), keys, "f")
        does = F.aggregate("_list", states, lambda acc, r: F.transform(acc, lambda c: F.get(r["x"], c.cast("int"))))
        level = cut(up.select(*keys, F.col("_up").alias("_at"), "_list", does.alias("f")))
        levels.append(level)
        low, high = low // BLOCK, high // BLOCK
    # and back: the carry before a block gives those before its parts
    carry = level.select(*keys, "_at", zero.alias("_carry"))
    for level in levels[:0:-1]:
        inside = _joined(level, carry, keys)
        start = F.struct(F.col("_carry").alias("c"), F.array().cast("array<struct<_at:bigint,_carry:bigint>>").alias("out"))
        walked = F.aggregate("_list", start, lambda acc, r: F.struct(F.get(r["x"], acc["c"].cast("int")).alias("c"), F.array_append(acc["out"], F.struct(r["_at"].alias("_at"), acc["c"].alias("_carry"))).alias("out")))
        carry = inside.select(*keys, F.inline(walked["out"]))
    inside = _joined(levels[0], carry, keys)
    start = F.struct(F.col("_carry").alias("c"), F.array().cast("array<struct<_at:bigint,amount:bigint>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        x = amount(r["x"], acc["c"], seconds)
        return F.struct(_after(x, least).alias("c"), F.array_append(acc["out"], F.struct(r["_at"].alias("_at"), x.alias("amount"))).alias("out"))

    out = inside.select(*keys, F.inline(F.aggregate("_list", start, step)["out"]))
    return out.select(*keys, F.col("_at").alias(order), "amount", F.when(F.col("amount") >= least, F.col("amount")).otherwise(zero).alias("sent"))


def _joined(level: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The blocks of a level with the carry before each."""
    c = carry.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_at").alias("_place"), "_carry")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return level.join(c, [F.col("_at") == F.col("_place"), *same]).select(*level.columns, "_carry")
