"""Edge algebra. Edges are rows (*keys, src, dst, frames, weight); a graph is never an object.

keys name the graph a row belongs to, by default its window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

KEYS = ("win",)


def edge_sum(flows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Directed edges: frames and bytes summed by endpoint pair."""
    return flows.groupBy(*keys, "src", "dst").agg(F.sum("frames").alias("frames"), F.sum("weight").alias("weight"))


def both_directions(conversations: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges of both directions of conversation rows (addr_a, addr_b, frames_ab, bytes_ab, frames_ba, bytes_ba)."""
    ab = conversations.select(*keys, F.col("addr_a").alias("src"), F.col("addr_b").alias("dst"), F.col("frames_ab").alias("frames"), F.col("bytes_ab").alias("weight"))
    ba = conversations.select(*keys, F.col("addr_b").alias("src"), F.col("addr_a").alias("dst"), F.col("frames_ba").alias("frames"), F.col("bytes_ba").alias("weight"))
    return edge_sum(ab.unionByName(ba), keys)


def contract(edges: DataFrame, inside, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Contract the nodes for which inside(column) holds into one; self-loops stay."""
    to = lambda c: F.when(inside(F.col(c)), F.lit(name)).otherwise(F.col(c))
    return edge_sum(edges.withColumns({"src": to("src"), "dst": to("dst")}), keys)


def outside_contraction(edges: DataFrame, outside, gateway: str, keys: Sequence[str] = KEYS, name: str = "outside") -> DataFrame:
    """Contract outside nodes, then settle what went through the gateway.

    Graphs without an outside node stay as they are. Else, for each node c with an edge from the gateway: where c has
    an edge to outside, its edge to the gateway goes and that from it stays; else both go. The gateway is then part of
    outside.
    """
    flagged = edges.withColumn("_out", outside(F.col("src")) | outside(F.col("dst")))
    has = F.max("_out").over(Window.partitionBy(*keys))
    flagged = flagged.withColumn("_has", has)
    kept = flagged.filter(~F.col("_has")).drop("_out", "_has")
    to = lambda c: F.when(outside(F.col(c)), F.lit(name)).otherwise(F.col(c)).alias(c)
    c = edge_sum(flagged.filter("_has").select(*keys, to("src"), to("dst"), "frames", "weight"), keys)
    from_gw = c.filter(F.col("src") == gateway).select(*keys, F.col("dst").alias("_c")).distinct()
    to_out = c.filter(F.col("dst") == name).select(*keys, F.col("src").alias("_c"), F.lit(True).alias("_to_out")).distinct()
    node = from_gw.join(to_out, [*keys, "_c"], "left").withColumn("_to_out", F.coalesce("_to_out", F.lit(False)))
    other = F.when(F.col("src") == gateway, F.col("dst")).when(F.col("dst") == gateway, F.col("src"))
    c = c.withColumn("_c", other).join(node, [*keys, "_c"], "left")
    drop = F.col("_to_out").isNotNull() & ((F.col("dst") == gateway) | ~F.col("_to_out"))
    c = c.filter(~F.coalesce(drop, F.lit(False)))
    gw = lambda x: F.when(F.col(x) == gateway, F.lit(name)).otherwise(F.col(x)).alias(x)
    return kept.unionByName(edge_sum(c.select(*keys, gw("src"), gw("dst"), "frames", "weight"), keys))


def service_rollup(edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges between services, from nodes (node, svc); pairs of weight 0 are left out. Nodes that aren't listed raise."""
    named = edges.join(nodes.select(F.col("node").alias("src"), F.col("svc").alias("_s")), "src", "left").join(nodes.select(F.col("node").alias("dst"), F.col("svc").alias("_d")), "dst", "left")
    named = named.withColumns({c: F.when(F.col(c).isNull(), F.raise_error(F.lit("node without a service"))).otherwise(F.col(c)) for c in ("_s", "_d")})
    return edge_sum(named.select(*keys, F.col("_s").alias("src"), F.col("_d").alias("dst"), "frames", "weight"), keys).filter("weight <> 0")


def undirected(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return edge_sum(edges.select(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "frames", "weight"), keys)


def with_inverse(edges: DataFrame) -> DataFrame:
    """Edges of weight 0 go; the others get the distance 1 / weight."""
    return edges.filter("weight <> 0").withColumn("inverse_weight", 1 / F.col("weight"))


def normalised(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each weight as a share of its graph's total."""
    return edges.withColumn("share", F.try_divide(F.col("weight").cast("double"), F.sum("weight").over(Window.partitionBy(*keys)).cast("double")))


def outbound(edges: DataFrame, name: str = "outside", keys: Sequence[str] = KEYS) -> DataFrame:
    into = F.when(F.col("dst") == name, F.lit(1)).otherwise(0)
    return edges.groupBy(*keys).agg(F.sum(into * F.col("frames")).alias("out_frames"), F.sum(into * F.col("weight")).alias("out_weight"))


def nodes_of(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return edges.select(*keys, F.col("src").alias("node")).union(edges.select(*keys, F.col("dst").alias("node"))).distinct()


def density(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Directed density without self-loops counted apart: m / (n (n - 1)), 0 for a single node."""
    m = edges.groupBy(*keys).agg(F.count("*").alias("m"))
    n = nodes_of(edges, keys).groupBy(*keys).agg(F.count("*").alias("n"))
    return m.join(n, list(keys)).withColumn("density", F.coalesce(F.try_divide(F.col("m").cast("double"), (F.col("n") * (F.col("n") - 1)).cast("double")), F.lit(0.0)))


def with_reverse(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each edge with the weight of its reverse edge, 0 where there is none."""
    back = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("back"))
    return edges.join(back, [*keys, "src", "dst"], "left").withColumn("back", F.coalesce("back", F.lit(0)))


def reciprocity(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Weighted reciprocity: the sum of min(w_ij, w_ji) as a share of all weight; -1 where the weight is 0."""
    both = with_reverse(edges.filter("src <> dst"), keys)
    out = both.groupBy(*keys).agg(F.sum(F.least("weight", "back")).alias("r"), F.sum("weight").alias("w"))
    return out.select(*keys, F.coalesce(F.try_divide(F.col("r").cast("double"), F.col("w").cast("double")), F.lit(-1.0)).alias("reciprocity"))


def between_services(edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges with both services and the unordered pair (svc_a <= svc_b)."""
    n = nodes
    e = edges.join(n.select(F.col("node").alias("src"), F.col("svc").alias("src_svc")), "src").join(n.select(F.col("node").alias("dst"), F.col("svc").alias("dst_svc")), "dst")
    return e.withColumns({"svc_a": F.least("src_svc", "dst_svc"), "svc_b": F.greatest("src_svc", "dst_svc")})


def pair_metrics(edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Reciprocity, and the variation of edge weights whose source is a pod (no VIP) of the first service, for each service pair.

    Pairs of one service have no variation. Null stands for an empty list of weights.
    """
    e = with_reverse(between_services(edges.filter("src <> dst"), nodes, keys).select(*keys, "src", "dst", "weight", "src_svc", "svc_a", "svc_b"), keys)
    e = e.join(nodes.filter("is_vip").select(F.col("node").alias("src"), F.lit(True).alias("_vip")).distinct(), "src", "left")
    first = F.when((F.col("src_svc") == F.col("svc_a")) & (F.col("svc_a") != F.col("svc_b")) & F.col("_vip").isNull(), F.col("weight"))
    out = e.groupBy(*keys, "svc_a", "svc_b").agg(F.sum(F.least("weight", "back")).alias("r"), F.sum("weight").alias("w"), F.stddev_pop(first).alias("s"), F.avg(first).alias("m"))
    return out.select(*keys, "svc_a", "svc_b", F.coalesce(F.try_divide(F.col("r").cast("double"), F.col("w").cast("double")), F.lit(-1.0)).alias("reciprocity"), F.try_divide("s", "m").alias("cov"))


def pair_density(edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Density of the graph that the members of two services present in a window span, cross edges only for two services."""
    e = between_services(edges.filter("src <> dst"), nodes, keys).groupBy(*keys, "svc_a", "svc_b").agg(F.count("*").alias("m"))
    n = nodes_of(edges, keys).join(nodes, "node").groupBy(*keys, "svc").agg(F.count("*").alias("n"))
    out = e.join(n.withColumnsRenamed({"svc": "svc_a", "n": "na"}), [*keys, "svc_a"]).join(n.withColumnsRenamed({"svc": "svc_b", "n": "nb"}), [*keys, "svc_b"])
    total = F.when(F.col("svc_a") == F.col("svc_b"), F.col("na")).otherwise(F.col("na") + F.col("nb"))
    return out.select(*keys, "svc_a", "svc_b", F.coalesce(F.try_divide(F.col("m").cast("double"), (total * (total - 1)).cast("double")), F.lit(0.0)).alias("density"))


def every_pair(metrics: DataFrame, nodes: DataFrame, empty: dict[str, float | None], keys: Sequence[str] = KEYS) -> DataFrame:
    """metrics (*keys, svc_a, svc_b, ...) with rows for the service pairs that have none in a window, empty's values in them.

    Services are those of the nodes, whether a window has them or not; windows are those of the metrics. The result is
    as large as the number of windows times that of pairs, which the dense form of features asks for.
    """
    svcs = nodes.groupBy().agg(F.sort_array(F.collect_set("svc")).alias("s"))
    # pairs by place in the sorted list of services: a row for each first service, then the ones from it on
    first = svcs.select("s", F.posexplode("s").alias("i", "svc_a"))
    pairs = first.select("svc_a", F.explode(F.slice("s", F.col("i") + 1, F.size("s"))).alias("svc_b"))
    wins = metrics.select(*keys).distinct()
    one = pairs.agg(F.collect_list(F.struct("svc_a", "svc_b")).alias("p"))  # a single row, so windows only gain a column
    grid = wins.crossJoin(F.broadcast(one)).select(*keys, F.inline("p"))
    there = metrics.withColumn("_there", F.lit(True))
    out = grid.join(there, [*keys, "svc_a", "svc_b"], "left")
    return out.select(*keys, "svc_a", "svc_b", *(F.when(F.col("_there"), F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in empty.items()))


def by_service(metric: DataFrame, nodes: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Variation, mean and maximum of a node metric (keys, node, value) by service."""
    return metric.join(nodes, "node").groupBy(*keys, "svc").agg(F.try_divide(F.stddev_pop(value), F.avg(value)).alias("cov"), F.avg(value).alias("mean"), F.max(value).alias("max"))


def hub_maps(edges: DataFrame, hub: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Weights from and to a hub for every node of the graph, 0 where there is no edge."""
    e = edges.filter((F.col("src") == hub) | (F.col("dst") == hub))
    out = e.filter(F.col("src") == hub).select(*keys, F.col("dst").alias("node"), F.col("weight").alias("w_out"))
    into = e.filter(F.col("dst") == hub).select(*keys, F.col("src").alias("node"), F.col("weight").alias("w_in"))
    n = nodes_of(edges, keys).join(out, [*keys, "node"], "left").join(into, [*keys, "node"], "left")
    return n.select(*keys, "node", F.coalesce("w_in", F.lit(0)).alias("w_in"), F.coalesce("w_out", F.lit(0)).alias("w_out"))


def vip_bypass(edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS, skip: Sequence[str] = ()) -> DataFrame:
    """How far traffic between pods and services departs from that which services' VIPs saw.

    nodes: (node, svc, is_vip). For each (pod, service) and (service, pod): the VIP's weight against the sum over the
    service's other members. Missing sides count 0.
    """
    n = nodes.filter(~F.col("svc").isin(*skip)) if skip else nodes
    e = edges.join(n.select(F.col("node").alias("src"), F.col("svc").alias("ss"), F.col("is_vip").alias("sv")), "src").join(n.select(F.col("node").alias("dst"), F.col("svc").alias("ds"), F.col("is_vip").alias("dv")), "dst").filter("ss <> ds")
    out = e.filter("not sv").select(*keys, F.col("src").alias("pod"), F.col("ds").alias("svc"), F.lit("to").alias("dir"), F.col("dv").alias("vip"), "weight")
    into = e.filter("not dv").select(*keys, F.col("dst").alias("pod"), F.col("ss").alias("svc"), F.lit("from").alias("dir"), F.col("sv").alias("vip"), "weight")
    both = out.union(into).groupBy(*keys, "pod", "svc", "dir").agg(F.sum(F.when(F.col("vip"), F.col("weight")).otherwise(0)).alias("v"), F.sum(F.when(~F.col("vip"), F.col("weight")).otherwise(0)).alias("p"))
    gap = F.col("v") - F.col("p")
    return both.groupBy(*keys).agg(F.sum(gap).alias("bypass"), F.sum(F.abs(gap)).alias("bypass_abs"), F.try_divide(F.sum(F.abs(gap)).cast("double"), F.sum("p").cast("double")).alias("fraction"))


def degrees(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    ends = edges.select(*keys, F.col("src").alias("node"), "weight").union(edges.select(*keys, F.col("dst").alias("node"), "weight"))
    return ends.groupBy(*keys, "node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def clustering(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Weighted directed clustering: cube roots of normalised weights over all directed triangles (Fagiolo 2007)."""
    e = edges.filter("src <> dst")
    e = e.withColumn("w", F.cbrt(F.col("weight") / F.max("weight").over(Window.partitionBy(*keys))))
    one = e.select(*keys, F.col("src").alias("u"), F.col("dst").alias("v"), "w")
    sym = one.union(one.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy(*keys, "u", "v").agg(F.sum("w").alias("w"), F.count("*").alias("arcs"))
    a, b, c = sym.alias("a"), sym.alias("b"), sym.alias("c")
    on = lambda x, y: [F.col(f"{x}.{k}") == F.col(f"{y}.{k}") for k in keys]
    tri = a.join(b, [*on("a", "b"), F.col("a.u") == F.col("b.u"), F.col("a.v") < F.col("b.v")]).join(c, [*on("a", "c"), F.col("a.v") == F.col("c.u"), F.col("b.v") == F.col("c.v")])
    t = tri.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.u").alias("node")).agg(F.sum(F.col("a.w") * F.col("b.w") * F.col("c.w")).alias("t"))
    d = sym.groupBy(*keys, F.col("u").alias("node")).agg(F.sum("arcs").alias("d"), F.sum(F.when(F.col("arcs") == 2, 1).otherwise(0)).alias("mutual"))
    out = d.join(t, [*keys, "node"], "left")
    return out.select(*keys, "node", F.coalesce(F.try_divide(F.col("t"), (F.col("d") * (F.col("d") - 1) - 2 * F.col("mutual")).cast("double")), F.lit(0.0)).alias("clustering"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are listed in nodes(node)."""
    return edges.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")


def without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which no end is listed in nodes(node)."""
    return edges.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_anti").join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_anti")


def neighbours(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return edges.groupBy(*keys, "src").agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def new_neighbours(edges: DataFrame, train_end: int, of: str | None = None) -> DataFrame:
    """For each window after training: neighbours new to nodes that training knew, of one node where it is named."""
    pairs = edges.select("win", "src", "dst").distinct()
    wins = pairs.filter(F.col("win") >= train_end).select("win").distinct()
    pairs = pairs.filter(F.col("src") == of) if of else pairs
    train = pairs.filter(F.col("win") < train_end)
    later = pairs.filter(F.col("win") >= train_end)
    fresh = later.join(train.select("src").distinct(), "src", "left_semi").join(train.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return wins.join(fresh.groupBy("win").agg(F.count("*").alias("n")), "win", "left").select("win", F.coalesce("n", F.lit(0)).alias("new_neighbours"))


def allow_list_alerts(edges: DataFrame, train_end: int) -> DataFrame:
    """1 for each window after training with traffic between a pair that training never saw."""
    live = edges.filter("frames > 0 and src <> dst")
    known = live.filter(F.col("win") < train_end).select("src", "dst").distinct()
    unseen = live.filter(F.col("win") >= train_end).join(known, ["src", "dst"], "left_anti").select("win").distinct().withColumn("alert", F.lit(1))
    return edges.filter(F.col("win") >= train_end).select("win").distinct().join(unseen, "win", "left").select("win", F.coalesce("alert", F.lit(0)).alias("alert"))


def ego_features(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Degree, ego-net edges and total weight of each node in the undirected graph."""
    u = undirected(edges.filter("src <> dst"), keys)
    both = u.select(*keys, "src", "dst", "weight").union(u.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    d = both.groupBy(*keys, F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("weight"))
    a, b, c = both.alias("a"), both.alias("b"), u.alias("c")
    on = lambda x, y: [F.col(f"{x}.{k}") == F.col(f"{y}.{k}") for k in keys]
    tri = a.join(b, [*on("a", "b"), F.col("a.src") == F.col("b.src")]).join(c, [*on("a", "c"), F.col("a.dst") == F.col("c.src"), F.col("b.dst") == F.col("c.dst")])
    t = tri.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.src").alias("node")).agg(F.count("*").alias("t"), F.sum("c.weight").alias("tw"))
    return d.join(t, [*keys, "node"], "left").select(*keys, "node", "degree", (F.col("degree") + F.coalesce("t", F.lit(0))).alias("ego_edges"), (F.col("weight") + F.coalesce("tw", F.lit(0))).alias("ego_weight"))


def ego_networks(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The sixteen columns of every node's ego network: the node, its neighbours either way, and the directed edges among them.

    Nodes, edges, weight and largest weight within; edges and weight that enter and leave the network; the node's own degrees,
    weights and largest weights both ways; neighbours that have no other neighbour. Triangles are found once each, from their
    node of least degree, so no node makes as many rows as its degree squared; a hub's sums are partial before they are shuffled.
    """
    e = cut(edges.filter("src <> dst").groupBy(*keys, "src", "dst").agg(F.sum("weight").alias("weight")))
    ends = lambda one, out: e.groupBy(*keys, F.col(one).alias("node")).agg(F.count("*").alias(f"ego_{out}_d"), F.sum("weight").alias(f"ego_{out}_w"), F.max("weight").alias(f"ego_max_{out}_w"))
    zero = F.lit(0).cast("long")
    own = ends("dst", "in").join(ends("src", "out"), [*keys, "node"], "full").na.fill(0, [f"ego_{x}_{y}" for x in ("in", "out") for y in "dw"])
    pair = e.groupBy(*keys, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.max("weight").alias("m"))
    near = pair.select(*keys, F.col("u").alias("node"), F.col("v").alias("other")).union(pair.select(*keys, F.col("v").alias("node"), F.col("u").alias("other")))
    degree = cut(near.groupBy(*keys, "node").agg(F.count("*").alias("k")))
    # pairs from the lesser to the greater degree
    d = lambda name, k: degree.select(*keys, F.col("node").alias(name), F.col("k").alias(k))
    p = pair.join(d("u", "ku"), [*keys, "u"]).join(d("v", "kv"), [*keys, "v"])
    swap = F.struct("kv", "v") < F.struct(F.col("ku").alias("kv"), F.col("u").alias("v"))
    p = cut(p.select(*keys, F.when(swap, F.col("v")).otherwise(F.col("u")).alias("a"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("b"), "n", "w", "m"))
    side = lambda x, y, tag: p.select(*keys, F.col("a").alias(x), F.col("b").alias(y), F.struct("n", "w", "m").alias(tag))
    triangles = side("x", "y", "xy").join(side("x", "z", "xz"), [*keys, "x"]).join(side("y", "z", "yz"), [*keys, "y", "z"])
    credit = lambda node, tag: F.struct(F.col(node).alias("node"), F.col(f"{tag}.n").alias("n"), F.col(f"{tag}.w").alias("w"), F.col(f"{tag}.m").alias("m"))
    across = triangles.select(*keys, F.inline(F.array(credit("x", "yz"), credit("y", "xz"), credit("z", "xy"))))
    across = across.groupBy(*keys, "node").agg(F.sum("n").alias("_n"), F.sum("w").alias("_w"), F.max("m").alias("_m"))
    around = near.join(own.select(*keys, F.col("node").alias("other"), "ego_in_d", "ego_in_w", "ego_out_d", "ego_out_w"), [*keys, "other"]).join(d("other", "k"), [*keys, "other"])
    around = around.groupBy(*keys, "node").agg(F.count("*").alias("_k"), F.count_if(F.col("k") == 1).alias("neighbours_deg1"), *(F.sum(f"ego_{c}").alias(f"_{c}") for c in ("in_d", "in_w", "out_d", "out_w")))
    out = own.join(around, [*keys, "node"]).join(across, [*keys, "node"], "left")
    within = F.col("ego_in_d") + F.col("ego_out_d") + F.coalesce("_n", zero)
    weight = F.col("ego_in_w") + F.col("ego_out_w") + F.coalesce("_w", zero)
    return out.select(
        *keys, "node", (F.col("_k") + 1).alias("egonet_n"), within.alias("egonet_e"), weight.alias("egonet_w"),
        (F.col("ego_in_d") + F.col("_in_d") - within).alias("egonet_in_d"), (F.col("ego_out_d") + F.col("_out_d") - within).alias("egonet_out_d"),
        (F.col("ego_in_w") + F.col("_in_w") - weight).alias("egonet_in_w"), (F.col("ego_out_w") + F.col("_out_w") - weight).alias("egonet_out_w"),
        "ego_in_d", "ego_out_d", "ego_in_w", "ego_out_w", F.greatest("ego_max_in_w", "ego_max_out_w", "_m").alias("egonet_max_w"), F.coalesce("ego_max_in_w", zero).alias("ego_max_in_w"), F.coalesce("ego_max_out_w", zero).alias("ego_max_out_w"), "neighbours_deg1",
    )


def edge_vector(edges: DataFrame, universe: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Weights over a fixed set of pairs (src, dst), 0 where a graph lacks the edge: a row for each graph and pair by definition."""
    cells = edges.select(*keys).distinct().crossJoin(universe)
    return cells.join(edges.select(*keys, "src", "dst", "weight"), [*keys, "src", "dst"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))


def adjacency(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(*keys, src, dst, weight) of every pair of a graph's nodes, 0 where there is no edge: the matrix, so quadratic in its nodes."""
    n = nodes_of(edges, keys)
    cells = n.withColumnRenamed("node", "src").join(n.withColumnRenamed("node", "dst"), list(keys))
    return cells.join(edges.select(*keys, "src", "dst", "weight"), [*keys, "src", "dst"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))


def bipartite(edges: DataFrame, nodes: DataFrame, a: str, b: str) -> DataFrame:
    """Edges between members of two services, none within one."""
    e = between_services(edges, nodes.filter(F.col("svc").isin(a, b)))
    return e.filter("src_svc <> dst_svc").select(*edges.columns)


def dns_node(edges: DataFrame, keys: Sequence[str] = KEYS, order: str = "win", marks: Sequence[str] = ("kube-dns", "coredns"), vip: str = "_VIP") -> DataFrame:
    """(*keys, dns): the name server's pod of each graph; a window without one takes the last window's."""
    named = F.lit(False)
    for m in marks:
        named = named | F.contains("node", F.lit(m))
    found = nodes_of(edges, keys).groupBy(*keys).agg(F.min(F.when(named & ~F.contains("node", F.lit(vip)), F.col("node"))).alias("dns"))
    w = Window.partitionBy(*[k for k in keys if k != order]).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("dns", F.last("dns", ignorenulls=True).over(w))


def largest_component(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(*keys, node) of each graph's largest undirected component; the one of the least name among equals.

    Least labels spread to neighbours and are halved each round, until a round changes none.
    """
    both = cut(edges.select(*keys, F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select(*keys, F.col("dst").alias("u"), F.col("src").alias("v"))).distinct())
    label, changed = cut(nodes_of(edges, keys).withColumn("label", F.col("node"))), True
    while changed:
        near = both.join(label.select(*keys, F.col("node").alias("v"), F.col("label").alias("l")), [*keys, "v"]).groupBy(*keys, F.col("u").alias("node")).agg(F.min("l").alias("l"))
        low = cut(label.join(near, [*keys, "node"], "left").select(*keys, "node", F.col("label").alias("old"), F.least("label", F.coalesce("l", "label")).alias("label")))
        up = low.select(*keys, F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = cut(low.join(up, [*keys, "label"]).select(*keys, "node", "old", F.col("up").alias("label")))
        changed = jumped.filter("old <> label").limit(1).count() > 0
        label = jumped.drop("old")
    size = label.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    best = size.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("label"))).alias("m")).select(*keys, F.col("m.label").alias("label"))
    return label.join(best, [*keys, "label"]).select(*keys, "node")


def first_seen(edges: DataFrame, order: str = "win") -> DataFrame:
    """Nodes with the first window they occur in."""
    return nodes_of(edges, (order,)).groupBy("node").agg(F.min(order).alias("first"))


def members(nodes: DataFrame) -> DataFrame:
    """Pods of each service."""
    return nodes.filter("not is_vip").groupBy("svc").agg(F.sort_array(F.collect_set("node")).alias("pods"))


def into_node(edges: DataFrame, nodes: DataFrame, target: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Traffic into one node: the mean over pods that send any, and the sum over services of their largest pod's."""
    e = edges.filter((F.col("dst") == target) & (F.col("src") != target) & (F.col("weight") > 0)).join(nodes.select(F.col("node").alias("src"), "svc", "is_vip"), "src").filter("not is_vip")
    top = e.groupBy(*keys, "svc").agg(F.max("weight").alias("top"), F.sum("weight").alias("w"), F.count("*").alias("n"))
    return top.groupBy(*keys).agg(F.try_divide(F.sum("w").cast("double"), F.sum("n").cast("double")).alias("mean"), F.sum("top").alias("top_sum"))
