"""Plans of injections as tables: budgets, free slots, paths and windows of all experiments at once.

Labels (exp, win, label) are those of the coarsest granularity. What a planner would loop over, experiments, parts and slots, are
columns; only the number of paths comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import normal
from ..operators.graph import service_rollup
from ..operators.lineage import cut
from ..operators.paths import hops, inject
from ..operators.ranks import numbered
from ..operators.scan import carried
from ..operators.sequence import islands


def budgets(labels: DataFrame, slot: int, train_share: float, attack_share: float, test_share: float | None = None) -> DataFrame:
    """(exp, windows, train_end, train, test): training ends before the first attack, and test has room for what attacks leave of its share (attack_share, if there is no other)."""
    test_share = attack_share if test_share is None else test_share
    n = labels.groupBy("exp").agg((F.max("win") + 1).alias("windows"), F.min(F.when(F.col("label") == 1, F.col("win"))).alias("_first"), F.sum("label").alias("_taken"))
    end = F.floor(F.least(F.col("windows") * train_share, F.coalesce("_first", "windows"))).cast("long")
    n = n.withColumn("train_end", end)
    test = F.greatest(F.lit(0.0), test_share * (F.col("windows") - F.col("train_end")) - F.col("_taken"))
    return n.select("exp", "windows", "train_end", F.floor(attack_share * F.col("train_end") / slot).alias("train"), F.floor(test / slot).alias("test"))


def free_slots(labels: DataFrame, budget: DataFrame, slot: int) -> DataFrame:
    """(exp, part, start): runs of windows without an attack, cut into slots; part 0 is training, 1 test, and no slot lies in both."""
    parts = labels.join(budget.select("exp", "train_end"), "exp").select("exp", (F.col("win") >= F.col("train_end")).cast("int").alias("part"), "win", (1 - F.col("label")).alias("label"))
    runs = islands(parts, ["exp", "part"]).withColumn("_n", F.floor((F.col("win_end") - F.col("win_start")) / slot)).filter("_n > 0")
    return runs.select("exp", "part", F.explode(F.sequence(F.col("win_start"), F.col("win_start") + slot * (F.col("_n") - 1), F.lit(slot).cast("long"))).alias("start"))


def spread(slots: DataFrame, budget: DataFrame, seed: int = 0) -> DataFrame:
    """(exp, part, start) of as many slots as the budget has: the slots in order are cut into that many runs, of each one is drawn."""
    w = Window.partitionBy("exp", "part")
    most = F.when(F.col("part") == 0, F.col("train")).otherwise(F.col("test"))
    placed = slots.join(budget.select("exp", "train", "test"), "exp").withColumns({"_k": F.row_number().over(w.orderBy("start")) - 1, "_all": F.count("*").over(w)})
    placed = placed.withColumn("_most", F.least(most, F.col("_all"))).filter("_most > 0")
    drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed).cast("string"), F.col("exp").cast("string"), F.col("part").cast("string"), F.col("start").cast("string")), 256), 1, 8), 16, 10).cast("long")
    run = F.floor(F.col("_k") * F.col("_most") / F.col("_all"))
    return placed.groupBy("exp", "part", run.alias("_run")).agg(F.min(F.struct(drawn.alias("h"), F.col("start"))).alias("m")).select("exp", "part", F.col("m.start").alias("start"))


def with_paths(slots: DataFrame, paths: DataFrame) -> DataFrame:
    """(exp, part, start, path_id, path): every path gets as many slots as any other, in turns; slots beyond that get none.

    paths: (path_id, path), path_id from 0 on without gaps.
    """
    n = paths.count()
    placed = cut(numbered(slots, ["exp", "part", "start"], "_pos"))
    each = placed.count() // n if n else 0
    return placed.filter(F.col("_pos") < each * n).withColumn("path_id", F.col("_pos") % max(n, 1)).join(paths, "path_id").select("exp", "part", "start", "path_id", "path")


def opened(scheduled: DataFrame, slot: int, coarse: int, grans: Sequence[int]) -> DataFrame:
    """(exp, gran, win, part, start, path_id): the windows of all granularities that slots of the coarsest one cover."""
    each = scheduled.withColumn("gran", F.explode(F.array(*map(F.lit, grans))))
    k = F.lit(coarse) / F.col("gran")
    win = F.explode(F.sequence((F.col("start") * k).cast("long"), ((F.col("start") + slot) * k).cast("long") - 1))
    return each.select("exp", "gran", win.alias("win"), "part", "start", "path_id")


def injected(edges: DataFrame, windows: DataFrame, paths: DataFrame, rate: Column, deviation: float, packet: int = 500, seed: int = 0) -> DataFrame:
    """Edges (exp, gran, win, src, dst) with the traffic of all scheduled paths: along each hop the amount that the window sends.

    Rates (bytes a minute) are drawn by window; amounts too small wait for the next window of the slot, at each granularity of
    its own.
    """
    drawn = windows.withColumn("rate", normal(rate, deviation, F.lit(seed), F.col("exp"), F.col("gran"), F.col("win")))
    parts = None
    for (gran,) in windows.select("gran").distinct().collect():  # a few granularities
        sent = carried(drawn.filter(F.col("gran") == gran), ["exp", "gran", "start", "path_id"], "win", "rate", gran).filter("sent > 0")
        parts = sent if parts is None else parts.unionByName(sent)
    if parts is None:
        return edges
    along = parts.join(hops(paths), "path_id").select("exp", "gran", "win", F.col("a").alias("src"), F.col("b").alias("dst"), F.col("sent").alias("bytes"))
    return inject(edges, along, ("exp", "gran", "win"), packet=packet)


def planned(edges: DataFrame, labels: DataFrame, paths: DataFrame, nodes: DataFrame, *, slot: int, coarse: int, grans: Sequence[int], train_share: float, attack_share: float, rate: Column, deviation: float, seed: int = 0, test_share: float | None = None, packet: int = 500) -> tuple[DataFrame, DataFrame]:
    """From budgets to graphs: the windows that carry a path, and the service graphs (exp, gran, win, src, dst) with its traffic."""
    labels = cut(labels)
    budget = cut(budgets(labels, slot, train_share, attack_share, test_share))
    chosen = with_paths(spread(free_slots(labels, budget, slot), budget, seed), paths)
    windows = cut(opened(chosen, slot, coarse, grans))
    return windows, service_rollup(injected(edges, windows, paths, rate, deviation, packet, seed), nodes, ("exp", "gran", "win"))
