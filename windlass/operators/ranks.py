"""Running totals and exact quantiles over any number of rows: no task sees a whole ordered table, however few its keys.

Rows are dealt to ranges of the ordering value, as many as their count asks for; rows that fit one range are totalled by a
window alone. Totals of whole ranges come from grouped sums, totals within a range from a window over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

RANGE_ROWS = 1_000_000


def in_ranges(rows: DataFrame, *order: str, range_rows: int = RANGE_ROWS, count: int | None = None) -> DataFrame:
    """rows with _r: the number of their range in the order of columns, of about range_rows rows each; written once.

    Rows that tie in all of the columns are in one range.
    """
    parts = max(1, -(-(rows.count() if count is None else count) // range_rows))
    # the ranges' bounds are sampled, so their numbers stay only once they are written
    return cut(rows.repartitionByRange(parts, *order).withColumn("_r", F.spark_partition_id()))


def running(rows: DataFrame, value: str, sums: Sequence[str], keys: Sequence[str] = (), descending: bool = False, written: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with run_<c> for each summed column: its total from the first value up to and with this one, by key.

    Rows have one row for each key and value; they are written once, as they are read for the count, totals and ranks.
    """
    rows = rows if written else cut(rows)
    order = F.desc(value) if descending else F.asc(value)
    count = rows.count()
    if count <= range_rows:
        one = Window.partitionBy(*keys).orderBy(order)
        return rows.select(*rows.columns, *(F.sum(c).over(one).alias(f"run_{c}") for c in sums))
    dealt = in_ranges(rows, value, range_rows=range_rows, count=count)
    before = Window.partitionBy(*keys).orderBy(F.desc("_r") if descending else F.asc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each key and range
    whole = dealt.groupBy(*keys, "_r").agg(*(F.sum(c).alias(f"_s_{c}") for c in sums))
    whole = whole.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_r").alias("_range"), *(F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums))
    within = Window.partitionBy(*keys, "_r").orderBy(order)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    out = dealt.join(whole, [F.col("_r") == F.col("_range"), *same])
    return out.select(*rows.columns, *((F.sum(c).over(within) + F.col(f"_b_{c}")).alias(f"run_{c}") for c in sums))


def quantiles(rows: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """(*keys, q): the exact quantiles of the non-null values of each key, linear between neighbours."""
    counts = cut(rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c")))
    ranked = running(counts, value, ["_c"], keys, written=True, range_rows=range_rows)
    n = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = ranked.join(n, list(keys)) if keys else ranked.crossJoin(n)
    picks = []
    for k, share in enumerate(shares):
        at = (F.col("_n") - 1) * share
        for name, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("run__c") - F.col("_c") <= rank) & (rank < F.col("run__c"))
            picks.append(F.min(F.when(here, F.col(value).cast("double"))).alias(f"_{name}{k}"))
    found = ranked.groupBy(*keys, "_n").agg(*picks)
    part = [(F.col("_n") - 1) * s - F.floor((F.col("_n") - 1) * s) for s in shares]
    return found.select(*keys, F.array(*(F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * p for k, p in enumerate(part))).alias("q"))


def numbered(rows: DataFrame, order: Sequence[str], name: str = "pos", range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with their place (0, 1, ...) in the order of columns; as many ranges are sorted as range_rows asks for.

    Rows that tie in all of the order's columns take their places arbitrarily.
    """
    rows = cut(rows)
    parts = max(1, -(-rows.count() // range_rows))
    # the id's high bits count the ranges in their order, its low 33 bits the rows of one
    dealt = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, before, starts = F.shiftright("_at", 33), 0, []
    for p, size in sorted(tuple(r) for r in dealt.groupBy(part.alias("p")).count().collect()):  # a row for each range
        starts.append((p, before))
        before += size
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    return dealt.join(F.broadcast(starts), part == F.col("_part")).withColumn(name, place).drop("_at", "_part", "_before")


def contiguous_folds(rows: DataFrame, folds: int, order: Sequence[str]) -> DataFrame:
    """rows with fold: runs of rows in order, the first ones a row longer where the rows don't divide."""
    placed = cut(numbered(rows, order, "_pos"))
    size, longer = divmod(placed.count(), folds)
    past = F.col("_pos") - longer * (size + 1)
    fold = F.when(past < 0, F.floor(F.col("_pos") / (size + 1))).otherwise(longer + F.floor(past / max(size, 1)))
    return placed.withColumn("fold", fold.cast("int")).drop("_pos")
