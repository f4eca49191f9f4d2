"""Paths through the allow-list, and injected traffic along them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import same_service
from .graph import edge_sum
from .lineage import cut


def simple_paths(edges: DataFrame, start: Sequence[str], goal: str, max_hops: int, limit: int | None = None) -> DataFrame:
    """Simple paths (path array) from the start nodes to the goal; with a limit the first ones, see shortest_paths."""
    if limit:
        return shortest_paths(edges, start, goal, max_hops, limit)
    e = edges.select("src", "dst").distinct().filter("src <> dst")
    front = e.filter(F.col("src").isin(*start)).select(F.array("src", "dst").alias("path"))
    done = []
    for hop in range(1, max_hops + 1):
        done.append(front.filter(F.element_at("path", -1) == goal))
        if hop < max_hops:
            open_ = front.filter(F.element_at("path", -1) != goal).withColumn("src", F.element_at("path", -1))
            front = open_.join(e, "src").filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    return reduce(DataFrame.union, done)


def shortest_paths(edges: DataFrame, start: Sequence[str], goal: str, max_hops: int, limit: int, made: list | None = None) -> DataFrame:
    """The first limit simple paths (path array) from the start nodes to the goal, by length, then by names.

    Paths grow a hop at a time, the complete ones first: when there are enough of them, the others of that length don't
    grow any more. One that is too far from the goal, by the shortest ways from there, doesn't grow either. made gets the number
    of rows of each step.
    """
    e = cut(edges.select("src", "dst").distinct().filter("src <> dst"))
    last = F.element_at("path", -1)
    # the nodes from which the goal is in reach, and how far it is
    away = cut(e.filter(F.col("dst") == goal).select(F.col("src").alias("node"), F.lit(1).alias("away")))
    for k in range(2, max_hops):
        more = e.join(away.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct().join(away, "node", "left_anti")
        grown = cut(away.union(more.filter(F.col("node") != goal).withColumn("away", F.lit(k))))
        if grown.count() == away.count():
            break
        away = grown
    front = e.filter(F.col("src").isin(*[s for s in start if s != goal])).select(F.array("src").alias("path")).distinct()
    done, have = [], 0
    for hop in range(1, max_hops + 1):
        ended = cut(front.withColumn("src", last).join(e.filter(F.col("dst") == goal), "src").select(F.concat("path", F.array("dst")).alias("path")))
        n = ended.count()
        if made is not None:
            made.append(n)
        if have + n >= limit:
            done.append(ended.orderBy("path").limit(limit - have))
            break
        have += n
        done.append(ended)
        step = front.withColumn("src", last).join(e.filter(F.col("dst") != goal), "src").filter(~F.array_contains("path", F.col("dst")))
        step = step.join(away.filter(F.col("away") <= max_hops - hop).select(F.col("node").alias("dst")), "dst")
        front = cut(step.select(F.concat("path", F.array("dst")).alias("path")))
        n = front.count()
        if made is not None:
            made.append(n)
        if not n:
            break
    return reduce(DataFrame.union, done).orderBy(F.size("path"), "path")


def trimmed_paths(edges: DataFrame, start: Sequence[str], goal: str, max_hops: int, limit: int, name: str, share: float) -> DataFrame:
    """shortest_paths of which, if more than a share pass a node, the last such ones make room for the next paths.

    As many go as the part of the limit by which the share is passed (rounded down); the next paths come as they are.
    """
    room = limit + int((1 - share) * limit) + 1
    w = Window.orderBy(F.size("path"), "path")  # over at most twice the limit
    ranked = cut(shortest_paths(edges, start, goal, max_hops, room).withColumn("_k", F.row_number().over(w)).withColumn("_through", F.array_contains("path", name)))
    first = ranked.filter(F.col("_k") <= limit)
    n, through = first.agg(F.count("*"), F.count_if(F.col("_through"))).first()
    gone = int((through / n - share) * n) if n and through / n > share else 0
    out = first.filter("_through").orderBy(F.desc("_k")).limit(gone).select("_k")
    return ranked.filter(F.col("_k") <= limit + gone).join(out, "_k", "left_anti").orderBy("_k").select("path")


def reachable(edges: DataFrame) -> DataFrame:
    """Transitive closure (src, dst), each round doubling the length reached until no pair is new.

    The result has a row for each connected pair by definition, so its size is that of the answer.
    """
    out = cut(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    before, now = -1, out.count()
    while now != before:
        step = out.alias("a").join(out.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        out = cut(out.union(step).distinct())
        before, now = now, out.count()
    return out


def hops(paths: DataFrame) -> DataFrame:
    """(path_id, hop, a, b) of consecutive nodes."""
    at = paths.select("path_id", F.posexplode("path").alias("hop", "a"), "path")
    return at.filter(F.col("hop") < F.size("path") - 1).select("path_id", "hop", "a", F.element_at("path", F.col("hop") + 2).alias("b"))


def vip_alternatives(steps: DataFrame, pairs: DataFrame, goal: str = "internet") -> DataFrame:
    """The VIPs that may stand between the nodes of each hop, as alternatives.

    pairs lists (src, vip_of), src 'ALL' for any. Towards the goal there is none; a listed pair leads to that
    service's VIP; else both services' VIPs are alternatives. Leaving the VIP out is always one more.
    """
    vip = lambda c: F.concat(F.regexp_replace(c, "_pod$", ""), F.lit("_vip"))
    bare = lambda c: F.regexp_replace(c, "_pod$", "")
    p = pairs.select(F.col("src").alias("_s"), F.col("vip_of").alias("_v")).distinct()
    fwd = steps.join(p, bare(F.col("b")) == F.col("_v"), "left").withColumn("f", F.coalesce((F.col("_s") == "ALL") | (F.col("_s") == bare(F.col("a"))), F.lit(False)))
    fwd = fwd.groupBy("path_id", "hop", "a", "b").agg(F.max("f").alias("f"))
    both = fwd.join(p, (bare(F.col("a")) == F.col("_v")) & (bare(F.col("b")) == F.col("_s")), "left").groupBy("path_id", "hop", "a", "b").agg(F.max("f").alias("f"), F.max(F.col("_s").isNotNull()).alias("r"))
    none = F.lit(None).cast("string")
    options = F.when(F.col("b") == goal, F.array(none)).when(F.col("f"), F.array(vip(F.col("b")), none)).when(F.col("r"), F.array(vip(F.col("a")), none)).otherwise(F.array(vip(F.col("a")), vip(F.col("b")), none))
    return both.select("path_id", "hop", "a", "b", F.explode(options).alias("vip"))


def concrete_hops(paths: DataFrame) -> DataFrame:
    """Edges that traffic along a path with VIPs makes.

    A hop over a VIP is two edges: of the source's service, source to destination and VIP to destination; of the
    destination's, source to VIP and source to destination.
    """
    at = paths.select("path_id", F.posexplode("path").alias("hop", "node"), "path")
    nxt = lambda k: F.get("path", F.col("hop") + k)
    at = at.withColumns({"n1": nxt(1), "n2": nxt(2)}).filter("n1 is not null and node not like '%\\_vip'")
    pair = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    over = F.col("n1").like("%\\_vip") & F.col("n2").isNotNull()
    made = F.when(over & same_service(F.col("node"), F.col("n1")), F.array(pair("node", "n2"), pair("n1", "n2"))).when(over, F.array(pair("node", "n1"), pair("node", "n2"))).otherwise(F.array(pair("node", "n1")))
    return at.select("path_id", "hop", F.inline(made))


def amount(rate: Column, gran: int, carry: Column | None = None) -> Column:
    """Bytes of a window at a rate in bytes a minute."""
    return F.floor((rate + (carry if carry is not None else F.lit(0.0))) * gran / 60)


def inject(edges: DataFrame, hops_: DataFrame, keys: Sequence[str] = ("win",), packet: int | Column = 500, ack: int = 40, least: int = 60) -> DataFrame:
    """Edges with traffic of hops_ (*keys, src, dst, bytes) added: bytes and packets (of a size, or of a column's) forwards, acknowledgements back.

    Amounts under the least number of bytes add nothing. Edges that don't exist are made.
    """
    d = hops_.filter(F.col("bytes") >= least).withColumn("n", F.floor(F.col("bytes") / packet))
    there = d.select(*keys, "src", "dst", F.col("n").alias("frames"), F.col("bytes").alias("weight"))
    back = d.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("n").alias("frames"), (F.col("n") * ack).alias("weight"))
    return edge_sum(edges.select(*keys, "src", "dst", "frames", "weight").union(there).union(back), keys)


def carried_amounts(wins: DataFrame, rate: float, gran: int, least: int = 60) -> DataFrame:
    """(win, amount) where an amount under the least is carried to the next window; amounts are constant, so in closed form.

    Windows are those listed; every ceil(least / amount)-th one sends what has gathered. Their places come from counts of
    blocks of windows, so no task has all of them.
    """
    each = int(rate * gran // 60)
    if each >= least or each == 0:
        return wins.select("win", F.lit(each if each >= least else 0).cast("long").alias("amount"))
    run = -(-least // each)
    block = wins.select("win", F.floor(F.col("win") / 4096).alias("_b"))
    counts = block.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", F.coalesce("_before", F.lit(0)).alias("_before"))
    k = F.row_number().over(Window.partitionBy("_b").orderBy("win")) + F.col("_before")
    return block.join(before, "_b").select("win", F.when(k % run == 0, F.lit(each * run)).otherwise(0).cast("long").alias("amount"))


def choose_node(abstract: DataFrame, nodes: DataFrame, seed: int = 0) -> DataFrame:
    """A concrete node (node, svc) for each abstract one (svc), by seeded hash in place of chance."""
    pick = F.min(F.struct(F.xxhash64(F.lit(seed), "node").alias("h"), F.col("node")))
    return abstract.join(nodes.groupBy("svc").agg(pick.alias("m")), "svc", "left").select(*abstract.columns, F.col("m.node").alias("node"))


def is_valid(path: Column) -> Column:
    """Whether each VIP of a path has a neighbour of its own service, and one next to a db service is a db's itself."""
    def ok(x: Column, i: Column) -> Column:
        near = lambda j: F.coalesce(same_service(x, F.get(path, j)), F.lit(False))
        db = lambda j: F.coalesce(F.contains(F.get(path, j), F.lit("db")), F.lit(False))
        return ~x.endswith("_vip") | ((near(i - 1) | near(i + 1)) & (F.contains(x, F.lit("db")) | ~(db(i - 1) | db(i + 1))))

    return F.size(F.filter(F.transform(path, ok), lambda b: ~b)) == 0


def facts(allowed: DataFrame, ports: DataFrame) -> DataFrame:
    """Reachability facts (src, dst, protocol, port): the allowed pairs (src, dst) on each port (svc, protocol, port) of the destination."""
    return allowed.join(ports.withColumnRenamed("svc", "dst"), "dst").select("src", "dst", "protocol", "port").distinct()


def abstract_name(name: Column, suffix: str) -> Column:
    """A name as path templates have it: dashes as underscores, and the suffix _pod or _vip."""
    return F.concat(F.translate(name, "-", "_"), F.lit(f"_{suffix}"))


def variants(steps: DataFrame) -> DataFrame:
    """(path_id, path): the paths that the alternatives (path_id, hop, a, b, vip) of all hops make together."""
    choice = F.when(F.col("vip").isNull(), F.array("b")).otherwise(F.array("vip", "b"))
    each = steps.groupBy("path_id", "hop").agg(F.min("a").alias("a"), F.collect_set(choice).alias("options"))
    ways = each.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("hop", "a", "options"))).alias("h"))
    grown = F.aggregate("h", F.array(F.array(F.col("h")[0]["a"])), lambda acc, x: F.flatten(F.transform(acc, lambda p: F.transform(x["options"], lambda o: F.concat(p, o)))))
    return ways.select("path_id", F.explode(grown).alias("path"))


def union_of(*paths: DataFrame) -> DataFrame:
    """Distinct paths of several lists in order of first appearance: (path, first), first = (list, place)."""
    rows = [p.select("path", F.struct(F.lit(k).alias("list"), F.col("place").cast("long").alias("place")).alias("at")) for k, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, rows).groupBy("path").agg(F.min("at").alias("first"))


def occurrences(paths: DataFrame) -> DataFrame:
    """How often each path is in the lists (paths array of paths)."""
    return paths.select(F.explode("paths").alias("path")).groupBy("path").agg(F.count("*").alias("n"))


def initiators(steps: DataFrame) -> DataFrame:
    """Who opens each hop's connection: a VIP of the other end's service if one end is, the pod otherwise, '?' between pods."""
    a, b = F.col("a"), F.col("b")
    va, vb = a.endswith("_vip"), b.endswith("_vip")
    who = F.when(~va & ~vb, "?").when(vb, F.when(same_service(a, b), b).otherwise(a)).otherwise(F.when(same_service(a, b), a).otherwise(b))
    return steps.withColumn("initiator", who)


def goal_share(paths: DataFrame, name: str) -> DataFrame:
    """Share of paths that pass a node."""
    return paths.agg(F.avg(F.array_contains("path", name).cast("int")).alias("share"))
