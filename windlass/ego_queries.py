"""Queries of ego networks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import graph as G
from .queries import FLOWS, _edges, query
from .sources import adapters as A

_EGO = """x AS (SELECT win, src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM {edges} WHERE src <> dst GROUP BY ALL),
nb AS (SELECT win, src AS node, dst AS other FROM x UNION SELECT win, dst, src FROM x), dg AS (SELECT win, node, count(*) AS k FROM nb GROUP BY ALL),
mb AS (SELECT win, node AS ego, other AS node FROM nb UNION SELECT win, node, node FROM nb),
ins AS (SELECT a.win, a.ego, count(*) AS e, sum(weight) AS w, max(weight) AS m FROM x JOIN mb a ON a.win = x.win AND a.node = x.src JOIN mb b ON b.win = x.win AND b.node = x.dst AND b.ego = a.ego GROUP BY ALL),
ti AS (SELECT a.win, a.ego, count(*) AS d, sum(weight) AS w FROM x JOIN mb a ON a.win = x.win AND a.node = x.dst GROUP BY ALL), tu AS (SELECT a.win, a.ego, count(*) AS d, sum(weight) AS w FROM x JOIN mb a ON a.win = x.win AND a.node = x.src GROUP BY ALL),
oi AS (SELECT win, dst AS ego, count(*) AS d, sum(weight) AS w, max(weight) AS m FROM x GROUP BY ALL), ou AS (SELECT win, src AS ego, count(*) AS d, sum(weight) AS w, max(weight) AS m FROM x GROUP BY ALL),
d1 AS (SELECT nb.win, nb.node AS ego, count(*) FILTER (k = 1) AS n FROM nb JOIN dg ON dg.win = nb.win AND dg.node = nb.other GROUP BY ALL)
SELECT ins.win, ins.ego AS node, k + 1 AS egonet_n, e AS egonet_e, CAST(ins.w AS BIGINT) AS egonet_w, coalesce(ti.d, 0) - e AS egonet_in_d, coalesce(tu.d, 0) - e AS egonet_out_d,
  CAST(coalesce(ti.w, 0) - ins.w AS BIGINT) AS egonet_in_w, CAST(coalesce(tu.w, 0) - ins.w AS BIGINT) AS egonet_out_w, coalesce(oi.d, 0) AS ego_in_d, coalesce(ou.d, 0) AS ego_out_d,
  CAST(coalesce(oi.w, 0) AS BIGINT) AS ego_in_w, CAST(coalesce(ou.w, 0) AS BIGINT) AS ego_out_w, ins.m AS egonet_max_w, coalesce(oi.m, 0) AS ego_max_in_w, coalesce(ou.m, 0) AS ego_max_out_w, d1.n AS neighbours_deg1
FROM ins JOIN dg ON dg.win = ins.win AND dg.node = ins.ego JOIN d1 ON d1.win = ins.win AND d1.ego = ins.ego LEFT JOIN ti ON ti.win = ins.win AND ti.ego = ins.ego LEFT JOIN tu ON tu.win = ins.win AND tu.ego = ins.ego
  LEFT JOIN oi ON oi.win = ins.win AND oi.ego = ins.ego LEFT JOIN ou ON ou.win = ins.win AND ou.ego = ins.ego"""


@query(f"WITH {FLOWS}, {_EGO.format(edges='e')}")
def ego_networks(spark, d):
    return G.ego_networks(_edges(spark, d))


_SPARSE = "se AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS win, 'c' || (o_custkey % 400) AS src, 's' || (l_suppkey % 60) AS dst, CAST(round(l_extendedprice * 100) AS BIGINT) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 48 UNION ALL SELECT CAST(year(o_orderdate) AS BIGINT), 's' || (o_orderkey % 60), 's' || (o_custkey % 60), CAST(round(o_totalprice * 100) AS BIGINT) FROM orders WHERE o_orderstatus = 'F')"


@query(f"WITH {_SPARSE}, {_EGO.format(edges='se')}")
def ego_networks_sparse(spark, d):
    """Of a graph in which most neighbours don't know each other: customers and suppliers of large lines, and suppliers by orders."""
    name = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    cents = lambda c: F.round(F.col(c) * 100).cast("long").alias("weight")
    orders = A.table(spark, d, "orders")
    year = F.year("o_orderdate").cast("long").alias("win")
    lines = A.table(spark, d, "lineitem").filter("l_quantity >= 48").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    one = lines.select(year, name("c", "o_custkey", 400).alias("src"), name("s", "l_suppkey", 60).alias("dst"), cents("l_extendedprice"))
    two = orders.filter("o_orderstatus = 'F'").select(year, name("s", "o_orderkey", 60).alias("src"), name("s", "o_custkey", 60).alias("dst"), cents("o_totalprice"))
    return G.ego_networks(one.union(two))
