"""From addresses to workloads: as-of mapping, label and pattern joins, infrastructure filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import VIP, is_ip, matches_service
from .ranks import RANGE_ROWS, in_ranges


def admitted(log: DataFrame) -> DataFrame:
    """Log rows that create a mapping; a service's name gets the VIP suffix."""
    ok = log.filter("op = '+' and coalesce(status, '') <> 'Terminating' and ip is not null and ip <> 'None'")
    return ok.withColumn("name", F.when(F.col("entity") == "svc", F.concat("name", F.lit(VIP))).otherwise(F.col("name")))


def infrastructure(log: DataFrame) -> DataFrame:
    """Names of kube-system entities and of the default kubernetes service, but for kube-dns."""
    return log.filter("(namespace = 'kube-system' or (name = 'kubernetes' and entity = 'svc')) and name not like 'kube-dns%'").select("name").distinct()


def services(log: DataFrame) -> DataFrame:
    return log.filter("entity = 'svc'").select(F.replace("name", F.lit(VIP), F.lit("")).alias("svc")).distinct()


def as_of(probe: DataFrame, versions: DataFrame, key: str, at: str, since: str, columns: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """probe with the columns of the latest version of its key from before its time; null where there is none.

    One sort by key and time carries the last version forward, so no probe meets more than its own version. Of versions
    at one time the greatest row counts. Where a key has more than range_rows rows, all are dealt to ranges of key and
    time, and a range starts with the last version of the ranges before it.
    """
    v = versions.groupBy(key, since).agg(F.max(F.struct(*columns)).alias("_v"))
    names = probe.columns
    a = probe.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(0).alias("_o"), F.struct(*names).alias("_p"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v"))
    b = v.select(F.col(key).alias("_k"), F.col(since).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast(a.schema["_p"].dataType).alias("_p"), "_v")
    rows = a.union(b)
    sizes = rows.groupBy("_k").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    last = F.last("_v", ignorenulls=True)
    if (sizes["most"] or 0) <= range_rows:
        w = Window.partitionBy("_k").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
        out = rows.withColumn("_v", last.over(w)).filter("_o = 0")
    else:
        dealt = in_ranges(rows, "_k", "_t", "_o", range_rows=range_rows, count=sizes["all"])
        w = Window.partitionBy("_r", "_k").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
        # one row for each key and range, of most keys one
        ends = dealt.groupBy("_k", "_r").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_e"))
        before = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(F.col("_k").alias("_key"), F.col("_r").alias("_range"), F.last("_e", ignorenulls=True).over(before).alias("_e")).filter("_e is not null")
        out = dealt.withColumn("_v", last.over(w)).filter("_o = 0").join(ends, [F.col("_k").eqNullSafe(F.col("_key")), F.col("_r") == F.col("_range")], "left").withColumn("_v", F.coalesce("_v", "_e"))
    return out.select(*[F.col(f"_p.{c}").alias(c) for c in names], *[F.col(f"_v.{c}").alias(c) for c in columns])


def inverted(mapping: DataFrame, ip: str = "ip", name: str = "name") -> DataFrame:
    """(name, ip) of a mapping; of several addresses of a name the greatest."""
    return mapping.groupBy(name).agg(F.max(ip).alias(ip))


def merged_mappings(*mappings: DataFrame) -> DataFrame:
    """(ip, name) of mappings in rising priority; a mapping's own repeats keep the greatest name, and void addresses go."""
    ranked = [m.select("ip", "name", F.lit(k).alias("_k")) for k, m in enumerate(mappings)]
    rows = ranked[0]
    for m in ranked[1:]:
        rows = rows.unionByName(m)
    rows = rows.filter("ip is not null and ip not in ('', '<nil>')")
    return rows.groupBy("ip").agg(F.max(F.struct("_k", "name")).alias("m")).select("ip", F.col("m.name").alias("name"))


def named(rows: DataFrame, mapping: DataFrame, columns: list[str], ip: str = "ip", name: str = "name") -> DataFrame:
    """Addresses in the columns become names where the mapping has them."""
    for c in columns:
        m = mapping.select(F.col(ip).alias(c), F.col(name).alias("_name"))
        rows = rows.join(m, c, "left").withColumn(c, F.coalesce("_name", c)).drop("_name")
    return rows


def by_label(nodes: DataFrame, svcs: DataFrame) -> DataFrame:
    """(node, svc) by shared labels (arrays).

    A label that several services share stands for the one of the shortest name, then the first; a k8s-app label, which
    system services share, for the last. Of a node's labels' services the shortest name wins, then the first.
    """
    n = nodes.select("node", F.explode("labels").alias("label"))
    sized = lambda svc: F.struct(F.length(svc).alias("n"), F.col(svc))
    s = svcs.select("svc", F.explode("labels").alias("label")).groupBy("label").agg(F.min(sized("svc")).alias("m"), F.max("svc").alias("l"))
    s = s.select("label", F.when(F.col("label").contains("k8s-app"), F.col("l")).otherwise(F.col("m.svc")).alias("svc"))
    return n.join(s, "label").groupBy("node").agg(F.min(sized("svc")).alias("m")).select("node", F.col("m.svc").alias("svc"))


GRAM = 4


def pattern_hits(nodes: DataFrame, svcs: DataFrame) -> DataFrame:
    """nodes (node) with each service (svc) whose pattern matches: a service's name stands in the name of its nodes.

    So nodes and services are joined on a service's first GRAM characters (all of a shorter name), and only such pairs
    are held against the pattern. Names are taken as they stand, without meaning as patterns but for dots; services
    without a name match nothing.
    """
    plain = F.replace("node", F.lit("coredns"), F.lit("kube-dns"))
    cuts = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(plain) - k + 1)), lambda i: F.substring(plain, i, F.lit(k)))
    grams = F.array_distinct(F.flatten(F.array(*(cuts(k) for k in range(1, GRAM + 1)))))
    n = nodes.withColumn("_gram", F.explode(grams))
    s = svcs.filter("svc <> ''").withColumn("_start", F.substring("svc", 1, GRAM))
    return n.join(s, F.col("_gram") == F.col("_start")).filter(matches_service(F.col("node"), F.col("svc"))).drop("_gram", "_start")


def by_pattern(nodes: DataFrame, svcs: DataFrame) -> DataFrame:
    """(node, svc) by name pattern; the longest service name wins, then the first."""
    return pattern_hits(nodes, svcs).groupBy("node").agg(F.min(F.struct((-F.length("svc")).alias("n"), F.col("svc"))).alias("m")).select("node", F.col("m.svc").alias("svc"))


def infrastructure_nodes(nodes: DataFrame, infra: DataFrame) -> DataFrame:
    """Distinct (node) of infrastructure (name, entity): pods by their name, services by the pattern of their VIP."""
    pods = nodes.join(infra.filter("entity = 'pod'").select(F.col("name").alias("node")), "node", "left_semi").select("node")
    vips = infra.filter("entity = 'svc'").select(F.concat(F.replace("name", F.lit(VIP), F.lit("")), F.lit(VIP)).alias("svc")).distinct()
    return pods.union(pattern_hits(nodes.select("node").distinct(), vips).select("node")).distinct()


def services_of(nodes: DataFrame, svcs: DataFrame) -> DataFrame:
    """Labels first, patterns for the rest; null where neither names a service."""
    first = by_label(nodes, svcs)
    rest = by_pattern(nodes.join(first, "node", "left_anti").select("node"), svcs.select("svc"))
    return nodes.select("node").join(first.union(rest), "node", "left")


def application_edges(edges: DataFrame, infra: DataFrame) -> DataFrame:
    """Edges without infrastructure nodes (node) and without nodes named by an address."""
    out = edges.filter(~is_ip(F.col("src")) & ~is_ip(F.col("dst")))
    for c in ("src", "dst"):
        out = out.join(infra.select(F.col("node").alias(c)), c, "left_anti")
    return out
