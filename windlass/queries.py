"""Registry of the graph-analytics queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import centrality as Z
from .operators import graph as G
from .operators import identity as I
from .operators import kernels as K
from .operators import paths as P
from .operators import sequence as S
from .operators.lineage import cut
from .plans import features as M
from .plans import models as L
from .plans import results as R
from .plans import scoring as C
from .sources import adapters as A
from .sources import packets as T

QUERIES: dict = {}
ORACLE: dict = {}

FLOWS = """f AS (SELECT CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS BIGINT) AS win, sn.n_name AS src, dn.n_name AS dst,
  CAST(floor(l_quantity) AS BIGINT) AS frames, CAST(round(l_extendedprice * 100) AS BIGINT) AS weight
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation dn ON dn.n_nationkey = c_nationkey),
e AS (SELECT win, src, dst, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(weight) AS BIGINT) AS weight FROM f GROUP BY ALL),
n AS (SELECT n_name AS node, r_name AS svc, n_name = min(n_name) OVER (PARTITION BY r_name) AS is_vip FROM nation JOIN region ON r_regionkey = n_regionkey)"""
EVENTS = """ev AS (SELECT event_id, user_id AS pod, user_id % 6 AS svc, CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) AS t, CAST(round(value * 100) AS BIGINT) AS weight, value, event_type AS kind FROM events),
b AS (SELECT event_id, CAST(floor(t / 21600) AS BIGINT) AS win, pod % 4 AS path, value AS score, CAST(kind = 'error' AS INTEGER) AS label FROM ev)"""
OUT = ("NATION_3", "NATION_18", "NATION_19")
GATEWAY = "NATION_20"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _edges(spark, d):
    return G.edge_sum(A.flows(spark, d))


def _round(df, *cols, places: int = 6):
    return df.withColumns({c: F.round(c, places) for c in cols})


# --- edges -------------------------------------------------------------------------------------------------------


@query(f"WITH {FLOWS} SELECT * FROM e")
def edge_sum(spark, d):
    return _edges(spark, d)


@query(f"WITH {FLOWS}, u AS (SELECT win, src, dst, frames, weight FROM f UNION ALL SELECT win, dst, src, frames // 2, weight // 2 FROM f) SELECT win, src, dst, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(weight) AS BIGINT) AS weight FROM u GROUP BY ALL")
def edge_bidirectional_union(spark, d):
    c = A.flows(spark, d).select("win", F.col("src").alias("addr_a"), F.col("dst").alias("addr_b"), F.col("frames").alias("frames_ab"), F.col("weight").alias("bytes_ab"), F.expr("frames div 2").alias("frames_ba"), F.expr("weight div 2").alias("bytes_ba"))
    return G.both_directions(c)


@query(f"WITH {FLOWS} SELECT win, a.svc AS src, b.svc AS dst, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(weight) AS BIGINT) AS weight FROM e JOIN n a ON a.node = src JOIN n b ON b.node = dst GROUP BY ALL HAVING sum(weight) <> 0")
def service_rollup(spark, d):
    return G.service_rollup(_edges(spark, d), A.nations(spark, d))


_CONTRACT = f"""c AS (SELECT win, CASE WHEN src IN {OUT} THEN 'outside' ELSE src END AS src, CASE WHEN dst IN {OUT} THEN 'outside' ELSE dst END AS dst, sum(frames) AS frames, sum(weight) AS weight FROM s
  WHERE win IN (SELECT win FROM s WHERE src IN {OUT} OR dst IN {OUT}) GROUP BY ALL)"""


@query(f"""WITH {FLOWS}, s AS (SELECT * FROM e), {_CONTRACT},
g AS (SELECT DISTINCT win, dst AS c FROM c WHERE src = '{GATEWAY}'), o AS (SELECT DISTINCT win, src AS c FROM c WHERE dst = 'outside'),
k AS (SELECT c.* FROM c LEFT JOIN g ON g.win = c.win AND g.c = CASE WHEN c.src = '{GATEWAY}' THEN c.dst WHEN c.dst = '{GATEWAY}' THEN c.src END LEFT JOIN o ON o.win = g.win AND o.c = g.c
  WHERE NOT (g.c IS NOT NULL AND (c.dst = '{GATEWAY}' OR o.c IS NULL))),
m AS (SELECT win, CASE WHEN src = '{GATEWAY}' THEN 'outside' ELSE src END AS src, CASE WHEN dst = '{GATEWAY}' THEN 'outside' ELSE dst END AS dst, frames, weight FROM k
  UNION ALL SELECT win, src, dst, frames, weight FROM s WHERE win NOT IN (SELECT win FROM s WHERE src IN {OUT} OR dst IN {OUT}))
SELECT win, src, dst, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(weight) AS BIGINT) AS weight FROM m GROUP BY ALL""")
def outside_contraction(spark, d):
    return G.outside_contraction(_edges(spark, d), lambda c: c.isin(*OUT), GATEWAY)


@query(f"WITH {FLOWS} SELECT win, CASE WHEN src IN {OUT} THEN 'outside' ELSE src END AS src, CASE WHEN dst IN {OUT} THEN 'outside' ELSE dst END AS dst, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(weight) AS BIGINT) AS weight FROM e GROUP BY ALL")
def node_consolidation(spark, d):
    return G.contract(_edges(spark, d), lambda c: c.isin(*OUT), "outside")


@query(f"WITH {FLOWS} SELECT win, least(src, dst) AS src, greatest(src, dst) AS dst, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(weight) AS BIGINT) AS weight FROM e GROUP BY ALL")
def undirected_collapse(spark, d):
    return G.undirected(_edges(spark, d))


@query(f"WITH {FLOWS} SELECT win, src, dst, frames, weight, round(1.0 / weight, 12) AS inverse_weight, round(weight / sum(weight) OVER (PARTITION BY win), 9) AS share FROM e WHERE weight <> 0")
def weight_normalise(spark, d):
    return G.normalised(G.with_inverse(_edges(spark, d))).withColumns({"inverse_weight": F.round("inverse_weight", 12), "share": F.round("share", 9)})


@query(f"WITH {FLOWS} SELECT win, CAST(sum(CASE WHEN dst = 'NATION_3' THEN frames ELSE 0 END) AS BIGINT) AS out_frames, CAST(sum(CASE WHEN dst = 'NATION_3' THEN weight ELSE 0 END) AS BIGINT) AS out_weight FROM e GROUP BY win")
def outbound_total(spark, d):
    return G.outbound(_edges(spark, d), "NATION_3")


@query(f"WITH {FLOWS}, v AS (SELECT win, src AS node FROM e UNION SELECT win, dst FROM e), c AS (SELECT win, count(*) AS n FROM v GROUP BY win), m AS (SELECT win, count(*) AS m FROM e GROUP BY win) SELECT win, m, n, round(CASE WHEN n > 1 THEN m / (n * (n - 1.0)) ELSE 0 END, 6) AS density FROM m JOIN c USING (win)")
def density(spark, d):
    return _round(G.density(_edges(spark, d)), "density")


_BACK = "x AS (SELECT e.*, coalesce(r.weight, 0) AS back FROM e LEFT JOIN e r ON r.win = e.win AND r.src = e.dst AND r.dst = e.src WHERE e.src <> e.dst)"


@query(f"WITH {FLOWS}, {_BACK} SELECT win, round(coalesce(sum(least(weight, back)) / nullif(sum(weight), 0), -1), 6) AS reciprocity FROM x GROUP BY win")
def reciprocity(spark, d):
    return _round(G.reciprocity(_edges(spark, d)), "reciprocity")


@query(f"""WITH {FLOWS}, {_BACK}, y AS (SELECT x.*, least(a.svc, b.svc) AS svc_a, greatest(a.svc, b.svc) AS svc_b, a.svc AS ss, a.is_vip AS sv FROM x JOIN n a ON a.node = src JOIN n b ON b.node = dst)
SELECT win, svc_a, svc_b, round(coalesce(sum(least(weight, back)) / nullif(sum(weight), 0), -1), 6) AS reciprocity,
  round(stddev_pop(CASE WHEN ss = svc_a AND svc_a <> svc_b AND NOT sv THEN weight END) / nullif(avg(CASE WHEN ss = svc_a AND svc_a <> svc_b AND NOT sv THEN weight END), 0), 6) AS cov FROM y GROUP BY ALL""")
def pair_cov(spark, d):
    return _round(G.pair_metrics(_edges(spark, d), A.nations(spark, d)), "reciprocity", "cov")


@query(f"""WITH {FLOWS}, y AS (SELECT win, least(a.svc, b.svc) AS svc_a, greatest(a.svc, b.svc) AS svc_b, count(*) AS m FROM e JOIN n a ON a.node = src JOIN n b ON b.node = dst WHERE src <> dst GROUP BY ALL),
v AS (SELECT win, svc, count(*) AS c FROM (SELECT win, src AS node FROM e UNION SELECT win, dst FROM e) JOIN n USING (node) GROUP BY ALL),
z AS (SELECT y.*, CASE WHEN svc_a = svc_b THEN a.c ELSE a.c + b.c END AS t FROM y JOIN v a ON a.win = y.win AND a.svc = svc_a JOIN v b ON b.win = y.win AND b.svc = svc_b)
SELECT win, svc_a, svc_b, round(CASE WHEN t > 1 THEN m / (t * (t - 1.0)) ELSE 0 END, 6) AS density FROM z""")
def pair_density(spark, d):
    return _round(G.pair_density(_edges(spark, d), A.nations(spark, d)), "density")


@query(f"""WITH {FLOWS}, h AS (SELECT e.* FROM e WHERE weight > (SELECT 1.5 * avg(weight) FROM e)), x AS (SELECT h.*, coalesce(r.weight, 0) AS back FROM h LEFT JOIN h r ON r.win = h.win AND r.src = h.dst AND r.dst = h.src WHERE h.src <> h.dst),
z AS (SELECT win, least(a.svc, b.svc) AS svc_a, greatest(a.svc, b.svc) AS svc_b, coalesce(sum(least(weight, back)) / nullif(sum(weight), 0), -1) AS r,
  stddev_pop(CASE WHEN a.svc < b.svc AND NOT a.is_vip THEN weight END) / nullif(avg(CASE WHEN a.svc < b.svc AND NOT a.is_vip THEN weight END), 0) AS c
  FROM x JOIN n a ON a.node = src JOIN n b ON b.node = dst GROUP BY ALL), s AS (SELECT DISTINCT svc FROM n)
SELECT w.win, p.svc AS svc_a, q.svc AS svc_b, round(coalesce(r, -1), 6) AS reciprocity, round(c, 6) AS cov
FROM (SELECT DISTINCT win FROM z) w CROSS JOIN s p JOIN s q ON p.svc <= q.svc LEFT JOIN z ON z.win = w.win AND z.svc_a = p.svc AND z.svc_b = q.svc""")
def pair_every(spark, d):
    """The service pairs of heavy edges, pairs without one included."""
    e, n = _edges(spark, d), A.nations(spark, d)
    heavy = e.crossJoin(F.broadcast(e.agg(F.avg("weight").alias("_m")))).filter("weight > 1.5 * _m").drop("_m")
    return _round(G.every_pair(G.pair_metrics(heavy, n), n, {"reciprocity": -1.0, "cov": None}), "reciprocity", "cov")


@query(f"""WITH {FLOWS}, g AS (SELECT win, node, sum(weight) AS w FROM (SELECT win, src AS node, weight FROM e UNION ALL SELECT win, dst, weight FROM e) GROUP BY ALL)
SELECT win, svc, round(stddev_pop(w) / nullif(avg(w), 0), 6) AS cov, round(avg(w), 4) AS mean, CAST(max(w) AS BIGINT) AS max FROM g JOIN n USING (node) GROUP BY ALL""")
def node_metric_by_service(spark, d):
    return _round(_round(G.by_service(G.degrees(_edges(spark, d)), A.nations(spark, d), "strength"), "cov"), "mean", places=4)


_HUB = """h AS (SELECT v.win, v.node, coalesce(i.weight, 0) AS w_in, coalesce(o.weight, 0) AS w_out FROM (SELECT win, src AS node FROM e UNION SELECT win, dst FROM e) v
  LEFT JOIN e i ON i.win = v.win AND i.src = v.node AND i.dst = 'NATION_8' LEFT JOIN e o ON o.win = v.win AND o.dst = v.node AND o.src = 'NATION_8')"""


@query(f"WITH {FLOWS}, {_HUB} SELECT * FROM h")
def hub_in_out_map(spark, d):
    return G.hub_maps(_edges(spark, d), "NATION_8")


@query(f"""WITH {FLOWS}, {_HUB}, r AS (SELECT win, sum(CASE WHEN node = 'NATION_3' THEN w_out ELSE 0 END) AS o, sum(CASE WHEN node <> 'NATION_3' THEN w_in ELSE 0 END) AS i FROM h GROUP BY win)
SELECT win, round(o / nullif(i, 0), 6) AS value, CASE WHEN i <> 0 THEN 'ok' WHEN o > 0 THEN 'inf' ELSE 'nan' END AS state FROM r""")
def hub_ratio(spark, d):
    h = G.hub_maps(_edges(spark, d), "NATION_8")
    r = h.groupBy("win").agg(F.sum(F.when(F.col("node") == "NATION_3", F.col("w_out")).otherwise(0)).alias("o"), F.sum(F.when(F.col("node") != "NATION_3", F.col("w_in")).otherwise(0)).alias("i"))
    r = r.select("win", X.ratio(F.col("o"), F.col("i")).alias("r"))
    return r.select("win", F.round("r.value", 6).alias("value"), F.col("r.state").alias("state"))


@query(f"""WITH {FLOWS}, x AS (SELECT e.*, a.svc AS ss, a.is_vip AS sv, b.svc AS ds, b.is_vip AS dv FROM e JOIN n a ON a.node = src JOIN n b ON b.node = dst WHERE a.svc <> b.svc),
y AS (SELECT win, src AS pod, ds AS svc, 'to' AS dir, dv AS vip, weight FROM x WHERE NOT sv UNION ALL SELECT win, dst, ss, 'from', sv, weight FROM x WHERE NOT dv),
z AS (SELECT win, pod, svc, dir, sum(CASE WHEN vip THEN weight ELSE 0 END) AS v, sum(CASE WHEN vip THEN 0 ELSE weight END) AS p FROM y GROUP BY ALL)
SELECT win, CAST(sum(v - p) AS BIGINT) AS bypass, CAST(sum(abs(v - p)) AS BIGINT) AS bypass_abs, round(sum(abs(v - p)) / nullif(sum(p), 0), 6) AS fraction FROM z GROUP BY win""")
def vip_bypass(spark, d):
    return _round(G.vip_bypass(_edges(spark, d), A.nations(spark, d)), "fraction")


@query(f"""WITH {FLOWS}, w AS (SELECT win, src, dst, cbrt(weight / max(weight) OVER (PARTITION BY win)) AS w FROM e WHERE src <> dst),
s AS (SELECT win, u, v, sum(w) AS w, count(*) AS arcs FROM (SELECT win, src AS u, dst AS v, w FROM w UNION ALL SELECT win, dst, src, w FROM w) GROUP BY ALL),
t AS (SELECT a.win, a.u AS node, sum(a.w * b.w * c.w) AS t FROM s a JOIN s b ON a.win = b.win AND a.u = b.u AND a.v < b.v JOIN s c ON c.win = a.win AND c.u = a.v AND c.v = b.v GROUP BY ALL),
g AS (SELECT win, u AS node, sum(arcs) AS d, sum(CASE WHEN arcs = 2 THEN 1 ELSE 0 END) AS m FROM s GROUP BY ALL)
SELECT win, node, round(coalesce(t / nullif(d * (d - 1) - 2 * m, 0), 0), 6) AS clustering FROM g LEFT JOIN t USING (win, node)""")
def clustering(spark, d):
    return _round(G.clustering(_edges(spark, d)), "clustering")


@query(f"""WITH RECURSIVE {FLOWS}, s AS (SELECT win, a.svc AS src, b.svc AS dst, sum(weight) AS w FROM e JOIN n a ON a.node = src JOIN n b ON b.node = dst WHERE a.svc <> b.svc GROUP BY ALL),
p AS (SELECT win, src, dst, 1.0 / w AS d, [src, dst] AS path FROM s UNION ALL SELECT p.win, p.src, s.dst, p.d + 1.0 / s.w, list_append(path, s.dst) FROM p JOIN s ON s.win = p.win AND s.src = p.dst WHERE NOT list_contains(path, s.dst)),
m AS (SELECT win, src, dst, min(d) AS d FROM p GROUP BY ALL)
SELECT win, dst AS node, round(sum(1 / d), 3) AS harmonic FROM m GROUP BY ALL""")
def harmonic_service(spark, d):
    s = G.service_rollup(_edges(spark, d), A.nations(spark, d)).filter("src <> dst")
    return Z.centralities(s, ["harmonic"]).select("win", "node", F.round("value", 3).alias("harmonic"))


_WAYS = f"""WITH RECURSIVE {FLOWS}, s AS (SELECT win, a.svc AS src, b.svc AS dst, sum(weight) AS w FROM e JOIN n a ON a.node = src JOIN n b ON b.node = dst WHERE a.svc <> b.svc GROUP BY ALL),
p AS (SELECT win, src, dst, 1.0::DOUBLE / w AS d, [src, dst] AS path FROM s UNION ALL SELECT p.win, p.src, s.dst, p.d + 1.0::DOUBLE / s.w, list_append(path, s.dst) FROM p JOIN s ON s.win = p.win AND s.src = p.dst WHERE NOT list_contains(path, s.dst)),
m AS (SELECT win, src, dst, min(d) AS d FROM p GROUP BY ALL), k AS (SELECT p.*, count(*) OVER (PARTITION BY p.win, p.src, p.dst) AS c FROM p JOIN m ON m.win = p.win AND m.src = p.src AND m.dst = p.dst AND p.d - m.d < 1e-12),
v AS (SELECT win, src AS node FROM s UNION SELECT win, dst FROM s), z AS (SELECT win, count(*) AS n FROM v GROUP BY win), t AS (SELECT win, src, dst, c, unnest(path) AS node FROM k)"""


@query(f"{_WAYS}, x AS (SELECT win, node, sum(1.0::DOUBLE / c) AS b FROM t GROUP BY ALL) SELECT v.win, v.node, round(coalesce(b, 0) / (n * (n - 1)), 6) AS betweenness FROM v JOIN z USING (win) LEFT JOIN x ON x.win = v.win AND x.node = v.node")
def betweenness_service(spark, d):
    s = G.service_rollup(_edges(spark, d), A.nations(spark, d)).filter("src <> dst")
    return Z.centralities(s, ["betweenness"]).select("win", "node", F.round("value", 6).alias("betweenness"))


@query(f"{_WAYS}, x AS (SELECT win, node, sum(1.0::DOUBLE / c) AS b FROM t WHERE src IN ('ASIA', 'AFRICA') AND dst IN ('EUROPE', 'AMERICA') AND node <> src AND node <> dst GROUP BY ALL) SELECT v.win, v.node, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 6) AS betweenness FROM v JOIN z USING (win) LEFT JOIN x ON x.win = v.win AND x.node = v.node")
def betweenness_subset_service(spark, d):
    s = G.service_rollup(_edges(spark, d), A.nations(spark, d)).filter("src <> dst")
    return Z.centralities(s, ["betweenness_subset"], sources=["ASIA", "AFRICA"], targets=["EUROPE", "AMERICA"]).select("win", "node", F.round("value", 6).alias("betweenness"))


@query(f"WITH {FLOWS}, p AS (SELECT DISTINCT win, src, dst FROM e), t AS (SELECT src, dst FROM p WHERE win < 1), x AS (SELECT win, count(*) AS c FROM p WHERE win >= 1 AND src IN (SELECT src FROM t) AND (src, dst) NOT IN (SELECT (src, dst) FROM t) GROUP BY win) SELECT win, coalesce(c, 0) AS new_neighbours FROM (SELECT DISTINCT win FROM p WHERE win >= 1) LEFT JOIN x USING (win)")
def new_neighbours(spark, d):
    return G.new_neighbours(_edges(spark, d), 1)


@query(f"WITH {FLOWS}, p AS (SELECT * FROM e), k AS (SELECT DISTINCT src, dst FROM p WHERE win < 1 AND frames > 0 AND src <> dst), u AS (SELECT DISTINCT win FROM p WHERE win >= 1 AND frames > 0 AND src <> dst AND NOT EXISTS (SELECT 1 FROM k WHERE k.src = p.src AND k.dst = p.dst)) SELECT win, CAST(win IN (SELECT win FROM u) AS INTEGER) AS alert FROM (SELECT DISTINCT win FROM p WHERE win >= 1)")
def allowlist_alert(spark, d):
    return G.allow_list_alerts(_edges(spark, d), 1)


@query(f"WITH {FLOWS} SELECT win, src, list_sort(list(DISTINCT dst)) AS neighbours FROM e GROUP BY ALL")
def neighbour_lists(spark, d):
    return G.neighbours(_edges(spark, d))


@query(f"WITH {FLOWS} SELECT e.* FROM e JOIN n a ON a.node = src JOIN n b ON b.node = dst WHERE a.svc IN ('ASIA', 'EUROPE') AND b.svc IN ('ASIA', 'EUROPE')")
def induced_subgraph(spark, d):
    return G.induced(_edges(spark, d), A.nations(spark, d).filter("svc in ('ASIA', 'EUROPE')")).select("win", "src", "dst", "frames", "weight")


@query(f"WITH {FLOWS} SELECT e.* FROM e WHERE src NOT IN {OUT} AND dst NOT IN {OUT}")
def infra_filter(spark, d):
    infra = A.nations(spark, d).filter(F.col("node").isin(*OUT))
    return I.application_edges(_edges(spark, d), infra).select("win", "src", "dst", "frames", "weight")


@query(f"""WITH {FLOWS}, q AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, win, sum(weight) AS w FROM e WHERE src <> dst GROUP BY ALL),
s AS (SELECT win, u, v, w FROM q UNION ALL SELECT win, v, u, w FROM q), d AS (SELECT win, u AS node, count(*) AS degree, sum(w) AS weight FROM s GROUP BY ALL),
t AS (SELECT a.win, a.u AS node, count(*) AS t, sum(c.w) AS tw FROM s a JOIN s b ON a.win = b.win AND a.u = b.u JOIN q c ON c.win = a.win AND c.u = a.v AND c.v = b.v GROUP BY ALL)
SELECT win, node, degree, degree + coalesce(t, 0) AS ego_edges, CAST(weight + coalesce(tw, 0) AS BIGINT) AS ego_weight FROM d LEFT JOIN t USING (win, node)""")
def ego_features(spark, d):
    return G.ego_features(_edges(spark, d))


@query(f"WITH {FLOWS}, u AS (SELECT DISTINCT src, dst FROM e WHERE win < 2) SELECT w.win, u.src, u.dst, coalesce(e.weight, 0) AS weight FROM (SELECT DISTINCT win FROM e) w CROSS JOIN u LEFT JOIN e ON e.win = w.win AND e.src = u.src AND e.dst = u.dst")
def edge_vector(spark, d):
    e = _edges(spark, d)
    return G.edge_vector(e, e.filter("win < 2").select("src", "dst").distinct()).select("win", "src", "dst", "weight")


# --- identity ----------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'host-' || c_custkey ELSE (CASE WHEN c_custkey % 5 = 0 THEN '127' ELSE '172' END) || '.' || (16 + c_custkey % 3) || '.' || (c_custkey % 256) || '.' || (c_custkey % 4) END AS ip FROM customer),
p AS (SELECT *, string_split(ip, '.') AS s FROM a)
SELECT c_custkey, ip, len(s) = 4 AS is_ip, len(s) = 4 AND (s[1] = '127' OR (s[1] = '172' AND s[2] = '17' AND s[4] <> '1')) AS is_private FROM p""")
def ip_predicates(spark, d):
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    ip = F.when(k % 7 == 0, F.concat(F.lit("host-"), text(k))).otherwise(F.concat_ws(".", F.when(k % 5 == 0, "127").otherwise("172"), text(16 + k % 3), text(k % 256), text(k % 4)))
    rows = A.table(spark, d, "customer").select("c_custkey", ip.alias("ip"))
    return rows.select("c_custkey", "ip", X.is_ip(F.col("ip")).alias("is_ip"), X.is_private_ip(F.col("ip"), "172.17.0.1").alias("is_private"))


_PODS = "p AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) || '-' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 9) WHEN 1 THEN lower(c_mktsegment) || '-3' WHEN 2 THEN lower(c_mktsegment) || '_VIP' ELSE 'coredns-7' END AS node FROM customer), s AS (SELECT DISTINCT lower(c_mktsegment) AS svc FROM customer UNION SELECT 'kube-dns' UNION SELECT 'build')"


def _customer_pods(spark, d):
    """(c_custkey, node): pods and VIPs named by market segments."""
    c = A.table(spark, d, "customer")
    seg, k = F.lower("c_mktsegment"), F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat(seg, F.lit("-"), F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 9))).when(k == 1, F.concat(seg, F.lit("-3"))).when(k == 2, F.concat(seg, F.lit(X.VIP))).otherwise("coredns-7")
    return c.select("c_custkey", name.alias("node"))


@query(f"""WITH {_PODS}, h AS (SELECT node, svc, row_number() OVER (PARTITION BY node ORDER BY length(svc) DESC, svc) AS k FROM (SELECT DISTINCT node FROM p) JOIN s
  ON (contains(replace(node, 'coredns', 'kube-dns'), '_VIP') AND contains(node, svc)) OR regexp_matches(replace(node, 'coredns', 'kube-dns'), '^.*' || svc || '-([a-z0-9]{{9}}|[0-9]|$)'))
SELECT c_custkey, p.node, svc FROM p LEFT JOIN h ON h.node = p.node AND k = 1""")
def regex_service_join(spark, d):
    pods = _customer_pods(spark, d)
    svcs = A.table(spark, d, "customer").select(F.lower("c_mktsegment").alias("svc")).union(spark.createDataFrame([("kube-dns",), ("build",)], "svc string")).distinct()
    return pods.join(I.by_pattern(pods.select("node").distinct(), svcs), "node", "left").select("c_custkey", "node", "svc")


@query(f"""WITH {_PODS}, i AS (SELECT lower(p_brand) AS name, 'pod' AS entity FROM part UNION ALL SELECT node, 'pod' FROM p WHERE c_custkey % 100 = 3 UNION ALL SELECT substr(lower(c_mktsegment), 4), 'svc' FROM customer WHERE c_custkey % 5 = 0 AND lower(c_mktsegment) LIKE '%b%')
SELECT DISTINCT node FROM p WHERE node IN (SELECT name FROM i WHERE entity = 'pod') OR EXISTS (SELECT 1 FROM (SELECT DISTINCT name FROM i WHERE entity = 'svc') v WHERE contains(node, v.name || '_VIP'))""")
def infrastructure_nodes(spark, d):
    pods = _customer_pods(spark, d)
    seg = F.lower("c_mktsegment")
    named = A.table(spark, d, "part").select(F.lower("p_brand").alias("name")).union(pods.filter("c_custkey % 100 = 3").select("node")).withColumn("entity", F.lit("pod"))
    svcs = A.table(spark, d, "customer").filter((F.col("c_custkey") % 5 == 0) & seg.contains("b")).select(F.substring(seg, 4, 100).alias("name"), F.lit("svc").alias("entity"))
    return I.infrastructure_nodes(pods.select("node").distinct(), named.union(svcs))


@query("""WITH v AS (SELECT o_custkey AS key, o_orderdate AS since, max(o_orderstatus) AS status FROM orders GROUP BY ALL), q AS (SELECT o_orderkey, o_custkey AS key, o_orderdate + INTERVAL 30 DAY AS at FROM orders)
SELECT o_orderkey, q.key AS key, status FROM q ASOF LEFT JOIN v ON q.key = v.key AND q.at > v.since""")
def asof_identity(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("at"))
    return I.as_of(o, A.order_log(spark, d), "key", "at", "since", ["status"]).select("o_orderkey", "key", "status")


@query("SELECT p_partkey, list_filter(string_split_regex('app=' || replace(p_brand, '#', '') || ',tier=' || p_size || '/name=' || replace(p_type, ' ', '-'), '[,/]'), lambda x: regexp_matches(x, '^(name|k8s-app|app)=')) AS labels FROM part")
def label_filter(spark, d):
    p = A.table(spark, d, "part")
    text = F.concat(F.lit("app="), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(",tier="), F.col("p_size").cast("string"), F.lit("/name="), F.replace("p_type", F.lit(" "), F.lit("-")))
    return p.select("p_partkey", X.workload_labels(text).alias("labels"))


@query("""WITH g AS (SELECT p_partkey, unnest(string_split(lower(p_type), ' ')) AS label FROM part), s AS (SELECT lower(p_brand) AS svc, unnest(string_split(lower(p_type), ' ')) AS label FROM part WHERE p_size < 5),
m AS (SELECT p_partkey, svc, row_number() OVER (PARTITION BY p_partkey ORDER BY length(svc), svc) AS k FROM g JOIN s USING (label)) SELECT CAST(p_partkey AS VARCHAR) AS node, svc FROM m WHERE k = 1""")
def label_service_join(spark, d):
    p = A.table(spark, d, "part")
    labels = F.split(F.lower("p_type"), " ")
    svcs = p.filter("p_size < 5").select(F.lower("p_brand").alias("svc"), labels.alias("labels")).distinct()
    return I.by_label(p.select(F.col("p_partkey").cast("string").alias("node"), labels.alias("labels")), svcs)


# --- sequences ---------------------------------------------------------------------------------------------------

_GRANS = (21600, 86400)
_TUMBLE = "w AS (SELECT gran, CAST(floor(t / gran) AS BIGINT) AS win, svc, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM ev, (VALUES (21600), (86400)) g(gran) GROUP BY ALL)"


def _tumbled(spark, d):
    return S.tumbling(A.events(spark, d), F.col("t"), _GRANS).groupBy("gran", "win", "svc").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query(f"WITH {EVENTS}, {_TUMBLE} SELECT * FROM w")
def tumbling_two_grans(spark, d):
    return _tumbled(spark, d)


@query(f"WITH {EVENTS}, {_TUMBLE} SELECT * FROM w WHERE win < (SELECT max(win) FROM w x WHERE x.gran = w.gran)")
def drop_last_window(spark, d):
    return S.drop_last_window(_tumbled(spark, d))


# periods: runs of days with more errors than on average, not on the borders of windows
_RUNS = f"""{EVENTS}, days AS (SELECT CAST(floor(t / 86400) AS BIGINT) AS day, count(*) AS n FROM ev WHERE kind = 'error' GROUP BY ALL),
runs AS (SELECT day, day - row_number() OVER (ORDER BY day) AS g FROM days WHERE n > (SELECT avg(n) FROM days)),
pr AS (SELECT min(day) AS period_id, min(day) * 86400 + 30000 AS s, (max(day) + 1) * 86400 + 10000 AS e FROM runs GROUP BY g)"""
_LABELS = _RUNS + ", l AS (SELECT gran, win, CAST(EXISTS (SELECT 1 FROM pr WHERE win >= s // gran AND win < e // gran) AS INTEGER) AS label FROM (SELECT gran, unnest(range(0, CAST(ceil(2592000 / gran) AS BIGINT))) AS win FROM (VALUES (21600), (86400)) g(gran)))"


def _periods(spark, d):
    days = A.events(spark, d).filter("kind = 'error'").groupBy(F.floor(F.col("t") / 86400).alias("win")).count()
    marked = days.crossJoin(F.broadcast(days.agg(F.avg("count").alias("mean")))).select(F.lit(86400).alias("gran"), "win", (F.col("count") > F.col("mean")).cast("int").alias("label"))
    runs = S.islands(marked)
    return runs.select(F.col("win_start").alias("period_id"), (F.col("win_start") * 86400 + 30000).alias("start"), (F.col("win_end") * 86400 + 10000).alias("end"))


@query(f"WITH {_LABELS} SELECT * FROM l")
def attack_labels(spark, d):
    return S.window_labels(spark, _GRANS, _periods(spark, d), 2592000)


@query(f"WITH {_LABELS}, i AS (SELECT gran, win, win - row_number() OVER (PARTITION BY gran ORDER BY win) AS g FROM l WHERE label = 1) SELECT gran, min(win) AS win_start, max(win) + 1 AS win_end FROM i GROUP BY gran, g")
def label_islands(spark, d):
    return S.islands(attack_labels(spark, d))


@query(f"WITH {EVENTS}, w AS (SELECT DISTINCT win FROM b) SELECT win, (SELECT min(p) FROM (VALUES (0, 3, 9), (1, 7, 12), (2, 40, 60)) s(p, a, z) WHERE win >= a AND win < z) AS path_id FROM w")
def schedule_interval_join(spark, d):
    plan = spark.createDataFrame([(0, 3, 9), (1, 7, 12), (2, 40, 60)], "path_id int, win_start long, win_end long")
    return S.scheduled(A.scores(spark, d).select("win").distinct(), plan)


@query(f"WITH {EVENTS}, x AS (SELECT svc, t, event_id, CASE WHEN kind = 'error' THEN pod END AS dns FROM ev) SELECT svc, event_id, last_value(dns IGNORE NULLS) OVER (PARTITION BY svc ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dns FROM x")
def carry_forward(spark, d):
    e = A.events(spark, d).select("svc", "event_id", F.when(F.col("kind") == "error", F.col("pod")).alias("dns"))
    return S.carried(e, "dns", "event_id", ["svc"])


@query("""WITH v AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), x AS (SELECT label, k, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS dim FROM v),
m AS (SELECT label, k, vec_id, dim, x, avg(x) OVER (PARTITION BY label, dim ORDER BY k ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m FROM x)
SELECT label, vec_id, CASE WHEN k > 5 THEN round(acos(greatest(-1.0, least(1.0, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m)))))), 6) END AS angle FROM m GROUP BY label, k, vec_id""")
def sliding_angle(spark, d):
    v = A.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    return S.sliding_angles(v, 5, ["label"], "vec_id").select("label", "vec_id", F.round("angle", 6).alias("angle"))


@query(f"WITH {EVENTS}, a AS (SELECT win, CAST(max(score) > 90 AS INTEGER) AS pred FROM b GROUP BY win) SELECT CAST(floor(win * 21600 / 86400) AS BIGINT) AS win, max(pred) AS pred FROM a GROUP BY ALL")
def rebucket_or(spark, d):
    a = A.scores(spark, d).groupBy("win").agg((F.max("score") > 90).cast("int").alias("pred"))
    return S.rebucketed(a, 21600, 86400, "pred")


@query(f"WITH {EVENTS}, a AS (SELECT 21600 AS gran, CAST(floor(win / 4) AS BIGINT) AS w, max(score) AS s FROM b GROUP BY ALL UNION ALL SELECT 86400, CAST(floor(t / 86400) AS BIGINT), max(value) FROM ev WHERE kind <> 'error' GROUP BY ALL) SELECT w AS win, max(s) FILTER (gran = 21600) AS g21600, max(s) FILTER (gran = 86400) AS g86400 FROM a GROUP BY w")
def rebucket_max_pivot(spark, d):
    fine = S.rebucketed(A.scores(spark, d).select("win", "score"), 21600, 86400, "score").withColumn("gran", F.lit("g21600"))
    coarse = A.events(spark, d).filter("kind <> 'error'").groupBy(F.floor(F.col("t") / 86400).alias("win")).agg(F.max("value").alias("score")).withColumn("gran", F.lit("g86400"))
    return fine.unionByName(coarse).groupBy("win").pivot("gran", ["g21600", "g86400"]).agg(F.max("score"))


# --- scores ------------------------------------------------------------------------------------------------------

_ROC = "r AS (SELECT score AS thr, sum(sum(label)) OVER (ORDER BY score DESC) AS tp, sum(sum(1 - label)) OVER (ORDER BY score DESC) AS fp, sum(sum(label)) OVER () AS p, sum(sum(1 - label)) OVER () AS n FROM b GROUP BY score)"


@query(f"WITH {EVENTS}, {_ROC} SELECT thr, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(p AS BIGINT) AS p, CAST(n AS BIGINT) AS n FROM r")
def roc_points(spark, d):
    return C.roc_points(A.scores(spark, d))


_BEST = "q AS (SELECT thr, coalesce(lag(tp) OVER (ORDER BY thr DESC), 0) AS tp, coalesce(lag(fp) OVER (ORDER BY thr DESC), 0) AS fp, p FROM r), z AS (SELECT thr, coalesce(2.0 * tp / nullif(2 * tp + fp + p - tp, 0), 0) AS f1 FROM q ORDER BY f1 DESC, thr DESC LIMIT 1)"


@query(f"WITH {EVENTS}, {_ROC}, {_BEST} SELECT thr, round(f1, 6) AS f1 FROM z")
def best_f1(spark, d):
    return _round(C.best_f1(A.scores(spark, d)), "f1")


_SPLIT = EVENTS.replace("b AS (", "ball AS (") + ", b AS (SELECT * FROM ball WHERE win < 60)"


@query(f"WITH {_SPLIT}, {_ROC}, {_BEST} SELECT event_id, label, CAST(score > (SELECT thr FROM z) AS INTEGER) AS pred FROM ball WHERE win >= 60")
def train_threshold_on_test(spark, d):
    s = A.scores(spark, d)
    return C.thresholded(s.filter("win >= 60"), C.best_f1(s.filter("win < 60"))).select("event_id", "label", "pred")


_CM = "cm AS (SELECT CASE WHEN path = 0 THEN 'No Attack' ELSE CAST(path AS VARCHAR) END AS path, count(*) FILTER (label = 0 AND score <= 80) AS tn, count(*) FILTER (label = 0 AND score > 80) AS fp, count(*) FILTER (label = 1 AND score <= 80) AS fn, count(*) FILTER (label = 1 AND score > 80) AS tp FROM b GROUP BY ALL)"


def _cm(spark, d):
    preds = A.scores(spark, d).select(F.when(F.col("path") != 0, F.col("path")).alias("path"), "label", (F.col("score") > 80).cast("int").alias("pred"))
    return C.confusion(preds)


@query(f"WITH {EVENTS}, {_CM} SELECT *, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tp / nullif(tp + fn, 0), 6) AS tpr, round(fp / nullif(fp + tn, 0), 6) AS fpr FROM cm")
def cm_by_path(spark, d):
    return _round(C.rates(_cm(spark, d)), "f1", "tpr", "fpr")


@query(f"WITH {EVENTS}, {_CM}, s AS (SELECT CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tp) AS BIGINT) AS tp FROM cm) SELECT *, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tp / nullif(tp + fn, 0), 6) AS tpr, round(fp / nullif(fp + tn, 0), 6) AS fpr FROM s")
def cm_rollup_f1(spark, d):
    return _round(C.rolled_up(_cm(spark, d)), "f1", "tpr", "fpr")


_BYPATH = "r AS (SELECT path, score AS thr, sum(sum(label)) OVER (PARTITION BY path ORDER BY score DESC) AS tp, sum(sum(1 - label)) OVER (PARTITION BY path ORDER BY score DESC) AS fp, sum(sum(label)) OVER (PARTITION BY path) AS p, sum(sum(1 - label)) OVER (PARTITION BY path) AS n FROM b GROUP BY path, score)"


@query(f"WITH {EVENTS}, {_BYPATH}, o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY fp DESC, thr DESC) AS k FROM r WHERE fp / n <= 0.05) SELECT path, thr, round(tp / nullif(p, 0), 6) AS tpr FROM o WHERE k = 1")
def fp_budget_point(spark, d):
    return _round(C.operating_points(C.roc_points(A.scores(spark, d), ["path"]), 0.05, ["path"]), "tpr")


@query("WITH c AS (SELECT user_id % 5 AS path, event_type AS kind, length(event_type) + user_id % 3 * 0 AS rate, avg(CAST(value > 50 AS INTEGER)) AS tpr FROM events GROUP BY ALL), c2 AS (SELECT path, rate, max(tpr) AS tpr FROM c GROUP BY ALL), t AS (SELECT path, arg_max(tpr, rate) AS top, max(rate) AS most FROM c2 GROUP BY path) SELECT path, CAST(min(rate) AS BIGINT) AS rate FROM c2 JOIN t USING (path) WHERE (tpr >= top AND tpr <> 0) OR rate = most GROUP BY path")
def fp_budget_rate(spark, d):
    e = A.table(spark, d, "events")
    c = e.groupBy((F.col("user_id") % 5).alias("path"), F.length("event_type").cast("long").alias("rate"), "event_type").agg(F.avg((F.col("value") > 50).cast("int")).alias("tpr"))
    return C.lowest_rates(c.groupBy("path", "rate").agg(F.max("tpr").alias("tpr")))


@query(f"WITH {EVENTS}, a AS (SELECT t FROM ev WHERE kind = 'error'), s AS (SELECT min(t) AS lo, max(t) AS hi, CAST((max(t) - min(t)) // 86400 AS BIGINT) AS n FROM a) SELECT CAST(least(floor((t - lo) / ((hi - lo) / n)), n - 1) AS BIGINT) AS bin, count(*) AS alerts FROM a, s GROUP BY ALL")
def alert_histogram(spark, d):
    a = A.events(spark, d).filter("kind = 'error'").select("t")
    return C.alert_bins(a, F.expr("(_hi - _lo) div 86400")).select("bin", "alerts")


_BINS = "bins AS (SELECT CAST(floor(t / 7200) AS BIGINT) AS win, CAST(sum(CASE WHEN value > 95 THEN 1 ELSE 0 END) AS BIGINT) AS alerts FROM ev GROUP BY ALL), bo AS (SELECT win, win * 7200 AS lo, (win + 1) * 7200 AS hi, alerts FROM bins)"


def _bins(spark, d):
    bins = A.events(spark, d).groupBy(F.floor(F.col("t") / 7200).alias("win")).agg(F.count_if(F.col("value") > 95).alias("alerts"))
    return bins.select("win", (F.col("win") * 7200).alias("lo"), ((F.col("win") + 1) * 7200).alias("hi"), "alerts")


@query(f"WITH {_RUNS}, {_BINS} SELECT win, lo, hi, alerts, (SELECT min(period_id) FROM pr WHERE s < hi AND e > lo) AS period_id FROM bo")
def overlap_score(spark, d):
    return C.overlapping(_bins(spark, d), _periods(spark, d))


@query(f"""WITH {_RUNS}, {_BINS}, x AS (SELECT alerts > 0 AS a, EXISTS (SELECT 1 FROM pr WHERE s < hi AND e > lo) AS h FROM bo)
SELECT count(*) FILTER (a AND h) AS tp, count(*) FILTER (a AND NOT h) AS fp, count(*) FILTER (NOT a AND h) AS fn, count(*) FILTER (NOT a AND NOT h) AS tn FROM x""")
def alert_confusion(spark, d):
    return C.alert_confusion(_bins(spark, d), _periods(spark, d))


# --- features ----------------------------------------------------------------------------------------------------

_FEATURES = "ft AS (SELECT win, src || '_weight' AS metric, sum(weight) / 100.0::DOUBLE AS value FROM e GROUP BY ALL)"


def _features(spark, d):
    return A.flows(spark, d).groupBy("win", F.concat("src", F.lit("_weight")).alias("metric")).agg((F.sum("weight") / 100.0).alias("value"))


@query(f"""WITH {FLOWS}, {_FEATURES.replace('ft AS', 'raw AS')}, ft AS (SELECT win, metric, greatest(-1e9, least(1e9, value)) AS value FROM raw), q AS (SELECT metric, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS z FROM ft WHERE win < 20 GROUP BY metric)
SELECT win, metric, round(greatest(-100, least(100, (value - m) / CASE WHEN z - a <> 0 THEN z - a ELSE 1 END)), 6) AS value FROM ft JOIN q USING (metric)""")
def robust_scale(spark, d):
    return _round(M.robust_scaled(_features(spark, d), F.col("win") < 20), "value").select("win", "metric", "value")


@query(f"WITH {EVENTS}, x AS (SELECT event_id, kind AS metric, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM ev), m AS (SELECT metric, quantile_cont(value, 0.5) AS md FROM x GROUP BY metric) SELECT event_id, metric, round(coalesce(value, md), 6) AS value FROM x JOIN m USING (metric)")
def median_impute(spark, d):
    x = A.events(spark, d).select("event_id", F.col("kind").alias("metric"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return _round(M.imputed(x), "value")


_THREE = ("NATION_3_weight", "NATION_18_weight", "NATION_20_weight")


@query(f"WITH {FLOWS}, {_FEATURES} SELECT win, max(value) FILTER (metric = 'NATION_3_weight') AS NATION_3_weight, max(value) FILTER (metric = 'NATION_18_weight') AS NATION_18_weight, max(value) FILTER (metric = 'NATION_20_weight') AS NATION_20_weight FROM ft GROUP BY win")
def feature_pivot(spark, d):
    return M.wide(_features(spark, d), _THREE)


@query(f"WITH {FLOWS}, {_FEATURES}, w AS (SELECT DISTINCT win FROM ft) SELECT w.win, m.metric, ft.value FROM w CROSS JOIN (VALUES ('NATION_3_weight'), ('NATION_18_weight'), ('NATION_20_weight')) m(metric) LEFT JOIN ft ON ft.win = w.win AND ft.metric = m.metric")
def feature_unpivot(spark, d):
    return M.long(feature_pivot(spark, d), _THREE)


@query(f"WITH {EVENTS} SELECT event_id, path AS rate, label, 0 AS is_test FROM b WHERE path = 1 OR label = 1")
def rate_union(spark, d):
    return M.combined_rates(A.scores(spark, d).select("event_id", F.col("path").alias("rate"), "label"), 1).select("event_id", "rate", "label", "is_test")


@query("""WITH f AS (SELECT replace(p_type, ' ', '_') || CASE p_size % 4 WHEN 0 THEN '_reciprocity' WHEN 1 THEN '_to_x' WHEN 2 THEN '' ELSE '_avg_max' END AS metric, p_retailprice AS value FROM part)
SELECT metric, value FROM f WHERE NOT ((length(metric) - length(replace(metric, '_', '')) >= 3 AND NOT contains(metric, '_reciprocity')) OR metric = 'attack_labels_') AND NOT contains(metric, '_to_')""")
def feature_prune(spark, d):
    k = F.col("p_size") % 4
    end = F.when(k == 0, "_reciprocity").when(k == 1, "_to_x").when(k == 2, "").otherwise("_avg_max")
    p = A.table(spark, d, "part").select(F.concat(F.replace("p_type", F.lit(" "), F.lit("_")), end).alias("metric"), F.col("p_retailprice").alias("value"))
    return M.pruned(p, pairwise=False)


# --- paths and injection -----------------------------------------------------------------------------------------

_LINKS = "k AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst)"


def _links(spark, d):
    return _edges(spark, d).select("src", "dst").distinct().filter("src <> dst")


_PATHS = "RECURSIVE {flows}, {links}, p AS (SELECT [src, dst] AS path, dst FROM k WHERE src IN ('NATION_3', 'NATION_15') UNION ALL SELECT list_append(path, k.dst), k.dst FROM p JOIN k ON k.src = p.dst WHERE NOT list_contains(path, k.dst) AND p.dst <> 'NATION_8' AND len(path) < 4), paths AS (SELECT path FROM p WHERE dst = 'NATION_8')".format(flows=FLOWS, links=_LINKS)


def _paths(spark, d):
    return P.simple_paths(_links(spark, d), ["NATION_3", "NATION_15"], "NATION_8", 3)


@query(f"WITH {_PATHS} SELECT path FROM paths")
def path_enumeration(spark, d):
    return _paths(spark, d)


@query(f"WITH RECURSIVE {FLOWS}, {_LINKS}, r AS (SELECT src, dst FROM k UNION SELECT r.src, k.dst FROM r JOIN k ON k.src = r.dst) SELECT src, dst FROM r")
def reachability(spark, d):
    return P.reachable(_links(spark, d))


_IDS = "i AS (SELECT array_to_string(path, '>') AS path_id, list_transform(path, lambda x: lower(x) || '_pod') AS path FROM paths), h AS (SELECT path_id, unnest(range(0, len(path) - 1)) AS hop, path FROM i), s AS (SELECT path_id, CAST(hop AS INTEGER) AS hop, path[hop + 1] AS a, path[hop + 2] AS b FROM h)"


def _pods(spark, d):
    return _paths(spark, d).select(F.array_join("path", ">").alias("path_id"), F.transform("path", lambda x: F.concat(F.lower(x), F.lit("_pod"))).alias("path"))


@query(f"""WITH {_PATHS}, {_IDS}, t AS (SELECT path_id, hop, a, b, replace(a, '_pod', '') AS x, replace(b, '_pod', '') AS y FROM s),
o AS (SELECT path_id, hop, a, b, CASE WHEN b = 'nation_8_pod' THEN [NULL] WHEN y = 'nation_18' OR (x = 'nation_3' AND y = 'nation_20') OR (x = 'nation_15' AND y = 'nation_19') THEN [y || '_vip', NULL]
  WHEN (x = 'nation_19' AND y = 'nation_15') OR (x = 'nation_20' AND y = 'nation_3') THEN [x || '_vip', NULL] ELSE [x || '_vip', y || '_vip', NULL] END AS v FROM t)
SELECT path_id, hop, a, b, unnest(v) AS vip FROM o""")
def vip_expansion(spark, d):
    pairs = spark.createDataFrame([("ALL", "nation_18"), ("nation_3", "nation_20"), ("nation_15", "nation_19")], "src string, vip_of string")
    return P.vip_alternatives(P.hops(_pods(spark, d)), pairs, "nation_8_pod")


@query(f"""WITH {_PATHS}, {_IDS}, g AS (SELECT path_id, list_transform(path, lambda x, j: CASE WHEN j = 2 AND len(path) > 2 THEN replace(path[1], '_pod', '_vip') ELSE x END) AS path FROM i), m AS (SELECT path_id, path, CAST(unnest(range(0, len(path))) AS INTEGER) AS hop FROM g),
x AS (SELECT path_id, hop, path[hop + 1] AS a, path[hop + 2] AS b, path[hop + 3] AS c FROM m WHERE hop + 2 <= len(path) AND path[hop + 1] NOT LIKE '%\\_vip' ESCAPE '\\'),
y AS (SELECT path_id, hop, unnest(CASE WHEN b LIKE '%\\_vip' ESCAPE '\\' AND c IS NOT NULL AND replace(replace(a, '_pod', ''), '_vip', '') = replace(b, '_vip', '') THEN [[a, c], [b, c]] WHEN b LIKE '%\\_vip' ESCAPE '\\' AND c IS NOT NULL THEN [[a, b], [a, c]] ELSE [[a, b]] END) AS z FROM x)
SELECT path_id, hop, z[1] AS src, z[2] AS dst FROM y""")
def concrete_hops(spark, d):
    p = _pods(spark, d)
    vip = F.transform("path", lambda x, j: F.when((j == 1) & (F.size("path") > 2), F.replace(F.get("path", F.lit(0)), F.lit("_pod"), F.lit("_vip"))).otherwise(x))
    return P.concrete_hops(p.select("path_id", vip.alias("path")))


@query(f"""WITH {FLOWS}, h AS (SELECT win, 'NATION_3' AS src, 'NATION_8' AS dst, CAST(5000 + win * 3 AS BIGINT) AS b FROM (SELECT DISTINCT win FROM e) WHERE win % 2 = 0 UNION ALL SELECT win, 'NATION_8', 'internet', CAST(win * 10 AS BIGINT) FROM (SELECT DISTINCT win FROM e)),
d AS (SELECT win, src, dst, b, b // 500 AS k FROM h WHERE b >= 60), u AS (SELECT * FROM e UNION ALL SELECT win, src, dst, k, b FROM d UNION ALL SELECT win, dst, src, k, k * 40 FROM d)
SELECT win, src, dst, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(weight) AS BIGINT) AS weight FROM u GROUP BY ALL""")
def inject_edges(spark, d):
    e = _edges(spark, d)
    w = e.select("win").distinct()
    h = w.filter("win % 2 = 0").select("win", F.lit("NATION_3").alias("src"), F.lit("NATION_8").alias("dst"), (F.col("win") * 3 + 5000).alias("bytes")).union(w.select("win", F.lit("NATION_8").alias("src"), F.lit("internet").alias("dst"), (F.col("win") * 10).alias("bytes")))
    return P.inject(e, h)


# --- results -----------------------------------------------------------------------------------------------------


@query(f"WITH {EVENTS} SELECT svc AS gran, pod % 10 AS rate, kind AS method, round(avg(value), 6) AS f1 FROM ev GROUP BY ALL")
def trial_average(spark, d):
    e = A.events(spark, d).select(F.col("svc").alias("gran"), (F.col("pod") % 10).alias("rate"), F.col("kind").alias("method"), F.col("value").alias("f1"))
    return _round(R.averaged(e, ["gran", "rate", "method"], ["f1"]), "f1")


@query(f"WITH {EVENTS} SELECT svc AS gran, pod AS rate, event_id AS load FROM ev ORDER BY gran, rate DESC, load DESC")
def result_sort(spark, d):
    return R.sorted_results(A.events(spark, d).select(F.col("svc").alias("gran"), F.col("pod").alias("rate"), F.col("event_id").alias("load")))


_MIX = "x AS (SELECT src AS mix, dst AS part, sum(weight) / sum(sum(weight)) OVER (PARTITION BY src) AS share FROM f GROUP BY src, dst)"


@query(f"WITH {FLOWS}, {_MIX}, g AS (SELECT a.mix, p.part FROM (SELECT DISTINCT mix FROM x) a CROSS JOIN (SELECT DISTINCT part FROM x) p) SELECT g.mix, round(sqrt(sum(pow(coalesce(x.share, 0) - coalesce(b.share, 0), 2))), 6) AS distance FROM g LEFT JOIN x ON x.mix = g.mix AND x.part = g.part LEFT JOIN x b ON b.mix = 'NATION_3' AND b.part = g.part GROUP BY g.mix")
def mix_distance(spark, d):
    w = A.flows(spark, d).groupBy(F.col("src").alias("mix"), F.col("dst").alias("part")).agg(F.sum("weight").alias("w"))
    x = G.normalised(w.withColumnRenamed("w", "weight"), ["mix"])
    return _round(R.mix_distance(x.select("mix", "part", "share"), "NATION_3", "mix", "part", "share"), "distance")


@query(f"WITH {EVENTS} SELECT pod % 4 AS path, kind AS metric, round(avg(value * length(kind)), 6) AS contribution, round(avg(value), 6) AS mean FROM ev GROUP BY ALL")
def heat_contrib(spark, d):
    e = A.events(spark, d).select((F.col("pod") % 4).alias("path"), F.col("kind").alias("metric"), "value")
    coef = e.select("metric").distinct().withColumn("coef", F.length("metric").cast("double"))
    return _round(R.contributions(e, coef), "contribution", "mean")


@query(f"WITH {EVENTS} SELECT svc, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, min(value) AS lo, max(value) AS hi FROM ev GROUP BY svc")
def box_stats(spark, d):
    return _round(R.box_stats(A.events(spark, d), ["svc"]), "q1", "q2", "q3")

# --- packets, members, services ----------------------------------------------------------------------------------

_PACKETS = "k AS (SELECT CAST(floor(t / 86400) AS BIGINT) AS win, t, 'h' || pod % 20 AS src, 'h' || (pod * 7 + event_id) % 20 AS dst, weight AS bytes FROM ev)"


def _packets(spark, d):
    e = A.events(spark, d)
    host = lambda c: F.concat(F.lit("h"), (c % 20).cast("string"))
    return e.select(F.floor(F.col("t") / 86400).alias("win"), "t", host(F.col("pod")).alias("src"), host(F.col("pod") * 7 + F.col("event_id")).alias("dst"), F.col("weight").alias("bytes"))


@query(f"WITH {EVENTS}, {_PACKETS} SELECT win, least(src, dst) AS addr_a, greatest(src, dst) AS addr_b, count(*) FILTER (src > dst) AS frames_ba, CAST(coalesce(sum(bytes) FILTER (src > dst), 0) AS BIGINT) AS bytes_ba, count(*) FILTER (src <= dst) AS frames_ab, CAST(coalesce(sum(bytes) FILTER (src <= dst), 0) AS BIGINT) AS bytes_ab, min(t) AS start, max(t) - min(t) AS duration FROM k GROUP BY ALL")
def conversation_extraction(spark, d):
    return T.conversations(_packets(spark, d))


@query(f"WITH {EVENTS}, {_PACKETS} SELECT win, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM k WHERE t > (SELECT min(t) + 0.75 * (max(t) - min(t)) FROM k) GROUP BY win")
def capture_tail(spark, d):
    return T.last_part(_packets(spark, d), 0.25).groupBy("win").agg(F.count("*").alias("packets"), F.sum("bytes").alias("bytes"))


@query(f"WITH {EVENTS}, {_PACKETS} SELECT src, min(t) AS first, max(t) AS last, count(*) AS packets FROM k WHERE t < ceil(1000000 / 86400) * 86400 GROUP BY src")
def capture_head_span(spark, d):
    return T.span(T.first_part(_packets(spark, d), F.lit(1000000), 86400), ["src"])


@query(f"WITH {FLOWS} SELECT e.* FROM e JOIN n a ON a.node = src JOIN n b ON b.node = dst WHERE (a.svc = 'ASIA' AND b.svc = 'EUROPE') OR (a.svc = 'EUROPE' AND b.svc = 'ASIA')")
def bipartite_edges(spark, d):
    return G.bipartite(_edges(spark, d), A.nations(spark, d), "ASIA", "EUROPE")


@query(f"WITH {FLOWS}, s AS (SELECT * FROM e), g AS (SELECT win, min(CASE WHEN node LIKE '%4' THEN node END) AS x FROM (SELECT win, src AS node FROM s WHERE win % 3 <> 0 UNION SELECT win, dst FROM s WHERE win % 3 <> 0 UNION SELECT win, 'NATION_19' FROM s) GROUP BY win) SELECT win, last_value(x IGNORE NULLS) OVER (ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dns FROM g")
def dns_carry(spark, d):
    s = _edges(spark, d)
    name = lambda c: F.when(F.col("win") % 3 == 0, "NATION_19").otherwise(F.when(F.col(c).like("%4"), F.concat(F.lit("kube-dns:"), c)).otherwise(F.col(c)))
    found = G.dns_node(s.withColumns({"src": name("src"), "dst": name("dst")}))
    return found.select("win", F.replace("dns", F.lit("kube-dns:"), F.lit("")).alias("dns"))


@query(f"""WITH RECURSIVE {FLOWS}, s AS (SELECT DISTINCT win, src, dst FROM e), u AS (SELECT win, src AS a, dst AS b FROM s UNION SELECT win, dst, src FROM s),
r AS (SELECT win, a AS node, a AS l FROM u UNION SELECT r.win, u.b, r.l FROM r JOIN u ON u.win = r.win AND u.a = r.node), m AS (SELECT win, node, min(l) AS l FROM r GROUP BY ALL),
z AS (SELECT win, l, row_number() OVER (PARTITION BY win ORDER BY count(*) DESC, l) AS k FROM m GROUP BY win, l) SELECT m.win, node FROM m JOIN z ON z.win = m.win AND z.l = m.l AND k = 1""")
def largest_component(spark, d):
    return G.largest_component(_edges(spark, d).select("win", "src", "dst"))


@query(f"WITH {FLOWS} SELECT node, min(win) AS first FROM (SELECT win, src AS node FROM e UNION ALL SELECT win, dst FROM e) GROUP BY node")
def first_seen(spark, d):
    return G.first_seen(_edges(spark, d))


@query(f"WITH {FLOWS} SELECT svc, list_sort(list(node)) AS pods FROM n WHERE NOT is_vip GROUP BY svc")
def service_members(spark, d):
    return G.members(A.nations(spark, d))


@query(f"WITH {FLOWS}, x AS (SELECT win, svc, max(weight) AS top, sum(weight) AS w, count(*) AS c FROM e JOIN n ON node = src WHERE dst = 'NATION_8' AND src <> 'NATION_8' AND weight > 0 AND NOT is_vip GROUP BY ALL) SELECT win, round(sum(w) / sum(c), 4) AS mean, CAST(sum(top) AS BIGINT) AS top_sum FROM x GROUP BY win")
def traffic_into_node(spark, d):
    return _round(G.into_node(_edges(spark, d), A.nations(spark, d), "NATION_8"), "mean", places=4)


@query(f"WITH {_PATHS}, {_IDS} SELECT path_id, hop, a, b, CASE WHEN hop % 2 = 0 THEN '?' ELSE a END AS initiator FROM (SELECT path_id, hop, a, CASE WHEN hop % 2 = 0 THEN b ELSE replace(b, '_pod', '_vip') END AS b FROM s)")
def hop_initiators(spark, d):
    steps = P.hops(_pods(spark, d))
    return P.initiators(steps.withColumn("b", F.when(F.col("hop") % 2 == 0, F.col("b")).otherwise(F.replace("b", F.lit("_pod"), F.lit("_vip")))))


@query(f"WITH {_PATHS} SELECT round(avg(CAST(list_contains(path, 'NATION_18') AS INTEGER)), 6) AS share FROM paths")
def path_share(spark, d):
    return _round(P.goal_share(_paths(spark, d), "NATION_18"), "share")


# --- kernels and models (no SQL form) ----------------------------------------------------------------------------


@query()
def betweenness(spark, d):
    return Z.centralities(_edges(spark, d), ["betweenness"])


@query()
def load_centrality(spark, d):
    return Z.centralities(_edges(spark, d), ["load"])


@query()
def betweenness_subset(spark, d):
    return Z.centralities(_edges(spark, d), ["betweenness_subset"], sources=["NATION_3", "NATION_15"], targets=["NATION_8"])


@query()
def current_flow(spark, d):
    return K.centralities(_edges(spark, d), ["current_flow", "current_flow_subset", "current_flow_subset_raw"], sources=["NATION_3", "NATION_15"], targets=["NATION_8"])


@query()
def spectral_score(spark, d):
    return K.spectral_scores(_edges(spark, d).withColumn("exp", F.lit("flows")), 5)


def _frame(spark, d):
    f = A.flows(spark, d).groupBy("win", "src").agg((F.sum("weight") / 1e7).alias("value"), F.sum("frames").alias("n"))
    wide = M.wide(f.select("win", F.col("src").alias("metric"), "value"), _NATIONS).na.fill(0.0).withColumn("label", (F.col("win") % 5 == 0).cast("double"))
    # fits read it dozens of times
    return cut(wide)


_NATIONS = ("NATION_3", "NATION_18", "NATION_20", "NATION_8", "NATION_19", "NATION_15")


@query()
def lasso_scores(spark, d):
    f = _frame(spark, d)
    return L.scored(L.lasso(f, _NATIONS, folds=3), f, _NATIONS).select("win", "label", "score")


@query()
def forest_scores(spark, d):
    f = _frame(spark, d)
    return L.scored(L.forest(f, _NATIONS), f, _NATIONS).select("win", "label", "score")


@query()
def logistic_scores(spark, d):
    f = _frame(spark, d)
    return L.scored(L.logistic(f, _NATIONS), f, _NATIONS).select("win", "label", "score")


@query()
def boosting_scores(spark, d):
    f = _frame(spark, d)
    return L.AdaBoost(5).fit(f, _NATIONS).score(f, _NATIONS).select("win", "label", "score")
