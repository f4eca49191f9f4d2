"""More graph-analytics queries: scans of files written from the tables, identity, planning of injections, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import graph as G
from .operators import identity as I
from .operators import kernels as K
from .operators import paths as P
from .operators import sequence as S
from .operators.lineage import cut, fresh
from .plans import features as M
from .plans import scoring as C
from .queries import _IDS, _LABELS, _PATHS, EVENTS, FLOWS, _edges, _features, _links, _paths, _round, attack_labels, query, vip_expansion
from .queries import _FEATURES as FEATURES
from .sources import adapters as A
from .sources import packets as T
from .sources import sinks, text


def _lines(spark, lines: DataFrame, name: str) -> str:
    """Lines (value) written as text; the folder."""
    path = fresh(spark, name)
    lines.select("value").write.text(path)
    return path


# --- scans -------------------------------------------------------------------------------------------------------

_TALK = "k AS (SELECT 'h' || pod % 20 AS src, 'h' || (pod * 7 + event_id) % 20 || '.x' AS dst, weight AS bytes, t FROM ev)"


@query(f"WITH {EVENTS}, {_TALK} SELECT src AS addr_a, dst AS addr_b, 0 AS frames_ba, 0 AS bytes_ba, count(*) AS frames_ab, CAST(sum(bytes) AS BIGINT) AS bytes_ab, CAST(min(t) AS DOUBLE) AS rel_start, CAST(max(t) - min(t) AS DOUBLE) AS duration FROM k GROUP BY ALL")
def scan_conversations(spark, d):
    host = lambda c: F.concat(F.lit("h"), (c % 20).cast("string"))
    k = A.events(spark, d).select(host(F.col("pod")).alias("a"), F.concat(host(F.col("pod") * 7 + F.col("event_id")), F.lit(".x")).alias("b"), "weight", "t")
    k = k.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.min("t").alias("lo"), (F.max("t") - F.min("t")).alias("d"))
    line = F.concat_ws(" ", "a", F.lit("<->"), "b", F.lit("0 0"), "n", "w", "n", "w", "lo", "d")
    rows = k.select(line.alias("value")).union(spark.createDataFrame([("=====",), ("Conversations",), ("            |  <-  | ->",)], "value string"))
    return text.conversations(spark, _lines(spark, rows, "conversations")).drop("file")


@query("SELECT 's' || c_nationkey % 7 || '.' || c_custkey % 40 AS ip, string_agg(lower(c_mktsegment) || '-' || c_custkey, ';' ORDER BY lower(c_mktsegment) || '-' || c_custkey) AS name FROM customer GROUP BY 1")
def scan_pods(spark, d):
    c = A.table(spark, d, "customer")
    ip = F.concat(F.lit("s"), (F.col("c_nationkey") % 7).cast("string"), F.lit("."), (F.col("c_custkey") % 40).cast("string"))
    rows = c.select(F.concat_ws(" ", F.lit("default"), F.concat_ws("-", F.lower("c_mktsegment"), F.col("c_custkey").cast("string")), F.lit("1/1 Running 0 3h"), ip, F.lit("node")).alias("value"))
    return text.pods(spark, _lines(spark, rows, "pods"))


@query("""WITH s AS (SELECT 'svc' || s_suppkey AS name, CASE WHEN s_suppkey % 4 <> 0 THEN '10.0.' || s_suppkey % 250 || '.1' END AS ip, s_suppkey AS k FROM supplier)
SELECT name || '_VIP' AS name, ip, CAST(80 + k % 100 AS INTEGER) AS port, CAST(30000 + k AS INTEGER) AS node_port, 'TCP' AS protocol FROM s UNION ALL SELECT name || '_VIP', ip, 443, NULL, 'UDP' FROM s WHERE k % 2 = 0""")
def scan_services(spark, d):
    k = F.col("s_suppkey")
    text_ = lambda c: c.cast("string")
    ports = F.concat(text_(80 + k % 100), F.lit(":"), text_(30000 + k), F.when(k % 2 == 0, "/TCP,443/UDP").otherwise("/TCP"))
    ip = F.when(k % 4 != 0, F.concat(F.lit("10.0."), text_(k % 250), F.lit(".1"))).otherwise("None")
    rows = A.table(spark, d, "supplier").select(F.concat_ws(" ", F.lit("default"), F.concat(F.lit("svc"), text_(k)), F.lit("ClusterIP"), ip, F.lit("<none>"), ports, F.lit("3h")).alias("value"))
    rows = rows.union(spark.createDataFrame([("NAMESPACE NAME TYPE CLUSTER-IP EXTERNAL-IP PORT(S) AGE",)], "value string"))
    return text.service_table(spark, _lines(spark, rows, "services"))


@query("SELECT 'e' || s_suppkey AS name, '10.1.' || s_suppkey % 250 || '.' || s_nationkey AS ip FROM supplier UNION ALL SELECT 'e' || s_suppkey, 'f00d::' || s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0")
def scan_endpoints(spark, d):
    k = F.col("s_suppkey").cast("string")
    a = F.struct(F.concat_ws(".", F.lit("10.1"), (F.col("s_suppkey") % 250).cast("string"), F.col("s_nationkey").cast("string")).alias("ipv4"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("f00d::"), k)).alias("ipv6"))
    e = F.struct(F.struct(F.struct(F.concat(F.lit("e"), k).alias("pod-name")).alias("external-identifiers"), F.struct(F.array(a).alias("addressing")).alias("networking")).alias("status"))
    # a dump of each nation's endpoints
    rows = A.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(e)).alias("value"))
    path = fresh(spark, "endpoints")
    rows.repartition(F.col("s_nationkey")).write.partitionBy("s_nationkey").text(path)
    return text.endpoints(spark, f"{path}/*").select("name", "ip")


_LOG = """g AS (SELECT o_orderkey AS t, CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE '+' END AS op, CASE WHEN o_custkey % 3 = 0 THEN 'svc' ELSE 'pod' END AS entity, CASE WHEN o_custkey % 7 = 0 THEN 'kube-system' ELSE 'default' END AS namespace,
  CASE o_custkey % 11 WHEN 0 THEN 'kubernetes' WHEN 1 THEN 'kube-dns-1' ELSE 'n' || o_custkey END AS name, CASE WHEN o_orderkey % 9 = 0 THEN 'None' ELSE 'a' || o_custkey % 50 END AS ip, CASE WHEN o_orderkey % 4 = 0 THEN 'Terminating' WHEN o_orderkey % 4 = 1 THEN 'Running' END AS status FROM orders)"""


def _log(spark, d):
    """Orders as a cluster log, written as JSON and scanned."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = A.table(spark, d, "orders").select(
        o.alias("t"), F.when(o % 5 == 0, "-").otherwise("+").alias("op"), F.when(c % 3 == 0, "svc").otherwise("pod").alias("entity"), F.when(c % 7 == 0, "kube-system").otherwise("default").alias("namespace"),
        F.when(c % 11 == 0, "kubernetes").when(c % 11 == 1, "kube-dns-1").otherwise(F.concat(F.lit("n"), c.cast("string"))).alias("name"), F.when(o % 9 == 0, "None").otherwise(F.concat(F.lit("a"), (c % 50).cast("string"))).alias("ip"),
        F.when(o % 4 == 0, "Terminating").when(o % 4 == 1, "Running").alias("status"),
    )
    path = fresh(spark, "cluster-log")
    sinks.manifest(rows, path)
    return text.cluster_log(spark, path)


_ADMITTED = "m AS (SELECT t, CASE WHEN entity = 'svc' THEN name || '_VIP' ELSE name END AS name, ip FROM g WHERE op = '+' AND coalesce(status, '') <> 'Terminating' AND ip <> 'None')"


@query(f"WITH {_LOG}, {_ADMITTED} SELECT * FROM m")
def log_admitted(spark, d):
    return I.admitted(_log(spark, d)).select("t", "name", "ip")


@query(f"WITH {_LOG} SELECT DISTINCT name FROM g WHERE (namespace = 'kube-system' OR (name = 'kubernetes' AND entity = 'svc')) AND name NOT LIKE 'kube-dns%'")
def log_infrastructure(spark, d):
    return I.infrastructure(_log(spark, d))


@query(f"WITH {_LOG} SELECT DISTINCT name AS svc FROM g WHERE entity = 'svc'")
def log_services(spark, d):
    return I.services(_log(spark, d))


@query(f"WITH {_LOG}, {_ADMITTED} SELECT name, max(ip) AS ip FROM m GROUP BY name")
def name_to_address(spark, d):
    return I.inverted(I.admitted(_log(spark, d)))


@query(f"WITH {_LOG}, {_ADMITTED}, x AS (SELECT ip, max(name) AS name FROM m GROUP BY ip), q AS (SELECT o_orderkey, 'a' || o_custkey % 60 AS src, 'a' || o_orderkey % 60 AS dst FROM orders) SELECT o_orderkey, coalesce(a.name, src) AS src, coalesce(b.name, dst) AS dst FROM q LEFT JOIN x a ON a.ip = src LEFT JOIN x b ON b.ip = dst")
def named_addresses(spark, d):
    mapping = I.admitted(_log(spark, d)).groupBy("ip").agg(F.max("name").alias("name"))
    a = lambda c: F.concat(F.lit("a"), (F.col(c) % 60).cast("string"))
    return I.named(A.table(spark, d, "orders").select("o_orderkey", a("o_custkey").alias("src"), a("o_orderkey").alias("dst")), mapping, ["src", "dst"])


@query("""WITH a AS (SELECT 'x' || c_custkey % 90 AS ip, 'net-' || c_custkey AS name, 0 AS k FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT 'x' || s_suppkey % 40 AS ip, 'svc-' || s_suppkey AS name, 1 AS k FROM supplier), c AS (SELECT CASE WHEN n_nationkey = 3 THEN '<nil>' ELSE 'x' || n_nationkey END AS ip, n_name AS name, 2 AS k FROM nation),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) SELECT ip, name FROM (SELECT ip, name, row_number() OVER (PARTITION BY ip ORDER BY k DESC, name DESC) AS r FROM u WHERE ip <> '<nil>') WHERE r = 1""")
def merged_mapping(spark, d):
    s = lambda c: F.col(c).cast("string")
    a = A.table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("x"), (F.col("c_custkey") % 90).cast("string")).alias("ip"), F.concat(F.lit("net-"), s("c_custkey")).alias("name"))
    b = A.table(spark, d, "supplier").select(F.concat(F.lit("x"), (F.col("s_suppkey") % 40).cast("string")).alias("ip"), F.concat(F.lit("svc-"), s("s_suppkey")).alias("name"))
    c = A.table(spark, d, "nation").select(F.when(F.col("n_nationkey") == 3, "<nil>").otherwise(F.concat(F.lit("x"), s("n_nationkey"))).alias("ip"), F.col("n_name").alias("name"))
    return I.merged_mappings(a, b, c)


@query(f"WITH {FLOWS} SELECT win, src, dst, frames, weight FROM e")
def scan_edge_files(spark, d):
    path = fresh(spark, "edges")
    sinks.edge_files(_edges(spark, d), path, ("win",))
    # the window is in the folder's name
    return text.edge_file(spark, f"{path}/*").select(F.regexp_extract("file", r"win=(\d+)/", 1).cast("long").alias("win"), "src", "dst", "frames", "weight")


@query(f"WITH {FLOWS} SELECT DISTINCT src, dst FROM e WHERE frames > 0")
def talking_pairs(spark, d):
    return text.talking_pairs(_edges(spark, d))[0]


@query(f"WITH {FLOWS}, h AS (SELECT DISTINCT src, dst FROM e WHERE frames > 0) SELECT src AS node FROM h UNION SELECT dst FROM h")
def talking_hosts(spark, d):
    return text.talking_pairs(_edges(spark, d))[1]


_ALLOWED = "r AS (SELECT DISTINCT src, dst FROM e WHERE win < 2 AND src < dst), al AS (SELECT src, dst FROM r UNION SELECT dst, src FROM r)"


def _allowed(spark, d):
    path = fresh(spark, "policy")
    sinks.policy_lines(_edges(spark, d).filter("win < 2 and src < dst").select("src", "dst").distinct().coalesce(1), path)
    return text.policy(spark, path)[0]


@query(f"WITH {FLOWS}, {_ALLOWED} SELECT * FROM al")
def scan_policy(spark, d):
    return _allowed(spark, d)


_FACTS = f"{_ALLOWED}, po AS (SELECT n_name AS svc, CASE WHEN n_nationkey % 2 = 0 THEN 'tcp' ELSE 'udp' END AS protocol, CAST(80 + n_regionkey AS VARCHAR) AS port FROM nation), fa AS (SELECT DISTINCT src, dst, protocol, port FROM al JOIN po ON svc = dst)"


def _facts(spark, d):
    ports = A.table(spark, d, "nation").select(F.col("n_name").alias("svc"), F.when(F.col("n_nationkey") % 2 == 0, "tcp").otherwise("udp").alias("protocol"), (80 + F.col("n_regionkey")).cast("string").alias("port"))
    return P.facts(_allowed(spark, d), ports)


@query(f"WITH {FLOWS}, {_FACTS} SELECT * FROM fa")
def fact_generation(spark, d):
    return _facts(spark, d)


@query(f"WITH {FLOWS}, {_FACTS} SELECT * FROM fa")
def scan_facts(spark, d):
    lines = _facts(spark, d).select(F.concat(F.lit("hacl('"), "src", F.lit("','"), "dst", F.lit("',"), "protocol", F.lit(","), "port", F.lit(").")).alias("value"))
    return text.reachability(spark, _lines(spark, lines, "facts"))


@query(f"WITH {FLOWS}, {FEATURES}, p AS (SELECT win AS time, max(value) FILTER (metric = 'NATION_3_weight') AS a, max(value) FILTER (metric = 'NATION_8_weight' AND win % 5 <> 0) AS b FROM ft GROUP BY win) SELECT CAST(time AS INTEGER) AS time, round(a, 2) AS a, round(b, 2) AS b FROM p")
def scan_feature_csv(spark, d):
    f = M.wide(_features(spark, d), ("NATION_3_weight", "NATION_8_weight")).toDF("win", "a", "b").withColumn("b", F.when(F.col("win") % 5 != 0, F.col("b")))
    path = fresh(spark, "features")
    sinks.feature_csv(f, path)
    return _round(text.feature_csv(spark, path), "a", "b", places=2)


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS requests, CAST(sum(l_linenumber // 3) AS BIGINT) AS failures, round(sum(l_linenumber // 3) / sum(l_linenumber), 9) AS ratio FROM lineitem WHERE l_linenumber % 2 = 0")
def scan_load_test(spark, d):
    k = F.col("l_linenumber")
    rows = A.table(spark, d, "lineitem").select(F.when(k % 2 == 0, "None").otherwise("GET"), F.lit("x"), k, F.floor(k / 3))
    path = fresh(spark, "load-test")
    rows.write.csv(path)
    return _round(text.load_test_totals(spark, path), "ratio", places=9)


@query("SELECT CAST(user_id % 9 AS INTEGER) AS part, bool_or(event_type = 'error' OR event_id % 97 = 0) AS problem FROM events GROUP BY 1")
def scan_logs(spark, d):
    line = F.when(F.col("event_type") == "error", "Traceback (most recent call last):").when(F.col("event_id") % 97 == 0, "web 0/2 up").otherwise("web 2/2 up")
    rows = A.table(spark, d, "events").select((F.col("user_id") % 9).cast("int").alias("part"), line.alias("value"))
    path = fresh(spark, "logs")
    rows.repartition(F.col("part")).write.partitionBy("part").text(path)
    found = text.log_problems(spark, f"{path}/*")
    return found.groupBy(F.regexp_extract("file", r"part=(\d+)/", 1).cast("int").alias("part")).agg(F.max("problem").alias("problem"))


@query("SELECT CAST(sum(event_id % 1000) AS BIGINT) AS bytes, '[' || min(strftime(ts, '%Y-%m-%d %H:%M:%S')) || ']' AS first, '[' || max(strftime(ts, '%Y-%m-%d %H:%M:%S')) || ']' AS last FROM events WHERE event_type = 'click'")
def scan_transfers(spark, d):
    e = A.table(spark, d, "events")
    verb = F.when(F.col("event_type") == "click", "Received ").otherwise("Sent ")
    rows = e.select(F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), verb, (F.col("event_id") % 1000).cast("string"), F.lit(" bytes")).alias("value"))
    found = T.transfers(spark, _lines(spark, rows, "transfers"))
    return found.select("bytes", *(F.concat(F.lit("["), c, F.lit("]")).alias(c) for c in ("first", "last")))


@query("SELECT n_regionkey AS part, n_nationkey AS a, n_name AS name FROM nation")
def scan_result_files(spark, d):
    path = fresh(spark, "results")
    A.table(spark, d, "nation").select(F.col("n_regionkey").alias("part"), F.col("n_nationkey").alias("a"), F.col("n_name").alias("name")).write.option("header", True).partitionBy("part").csv(path)
    found = T.result_files(spark, [f"{path}/*"])
    return found.select(F.regexp_extract("file", r"part=(\d+)/", 1).cast("long").alias("part"), F.col("a").cast("long").alias("a"), "name")


@query(f"WITH {FLOWS}, i AS (SELECT n_name AS node, n_nationkey AS id FROM nation) SELECT win, a.id AS a, b.id AS b, weight FROM e JOIN i a ON a.node = src JOIN i b ON b.node = dst")
def scan_numbered_edges(spark, d):
    path = fresh(spark, "numbered")
    sinks.numbered_edges(_edges(spark, d), path, A.table(spark, d, "nation").select(F.col("n_name").alias("node"), F.col("n_nationkey").alias("id")), ("win",))
    t = F.split("value", " ")
    return spark.read.text(path).select(F.col("win").cast("long").alias("win"), *(t[k].cast("long").alias(c) for k, c in enumerate(("a", "b", "weight"))))


# --- identity and windows ----------------------------------------------------------------------------------------


@query("""WITH nodes AS (SELECT lower(p_type) || '-' || p_partkey % 10 AS node, CASE WHEN p_partkey % 30 = 0 THEN p_brand END AS label FROM part), s AS (SELECT DISTINCT lower(p_type) AS svc, p_brand AS label FROM part WHERE p_partkey % 4 = 0),
dn AS (SELECT DISTINCT node FROM nodes), l AS (SELECT node, arg_min(svc, (length(svc), svc)) AS svc FROM nodes JOIN s USING (label) GROUP BY node),
r AS (SELECT dn.node, arg_min(svc, (-length(svc), svc)) AS svc FROM dn JOIN s ON regexp_matches(node, '^.*' || svc || '-([a-z0-9]{9}|[0-9]|$)') GROUP BY dn.node) SELECT dn.node, coalesce(l.svc, r.svc) AS svc FROM dn LEFT JOIN l USING (node) LEFT JOIN r USING (node)""")
def services_of_nodes(spark, d):
    p = A.table(spark, d, "part")
    kind = F.lower("p_type")
    nodes = p.groupBy(F.concat(kind, F.lit("-"), (F.col("p_partkey") % 10).cast("string")).alias("node")).agg(F.collect_set(F.when(F.col("p_partkey") % 30 == 0, F.col("p_brand"))).alias("labels"))
    svcs = p.filter("p_partkey % 4 = 0").groupBy(kind.alias("svc")).agg(F.collect_set("p_brand").alias("labels"))
    return I.services_of(nodes, svcs)


@query(f"WITH {_LABELS} SELECT gran, CAST(min(CASE WHEN label = 1 THEN win END) * gran AS BIGINT) AS end FROM l WHERE gran = 21600 GROUP BY gran")
def training_end(spark, d):
    marked = attack_labels(spark, d).filter("gran = 21600").withColumnRenamed("label", "is_test")
    return S.end_of_training(marked, 21600).withColumn("gran", F.lit(21600))


@query(f"WITH {_LABELS} SELECT gran, win, win * gran > 1000000 AS past, CAST(win >= (1000000 // 86400) * (86400 // gran) AS INTEGER) AS is_test FROM l")
def training_marks(spark, d):
    l = attack_labels(spark, d)
    fine, coarse = (l.filter(f"gran = {g}").withColumns({"past": S.past_training(F.col("win"), g, 1000000), "is_test": S.test_mark(1000000, g, 86400)}) for g in (21600, 86400))
    return fine.union(coarse).select("gran", "win", "past", "is_test")


# --- graphs ------------------------------------------------------------------------------------------------------


@query(f"WITH {FLOWS}, v AS (SELECT win, src AS node FROM e UNION SELECT win, dst FROM e) SELECT a.win, a.node AS src, b.node AS dst, coalesce(weight, 0) AS weight FROM v a JOIN v b ON a.win = b.win LEFT JOIN e ON e.win = a.win AND e.src = a.node AND e.dst = b.node")
def adjacency(spark, d):
    return G.adjacency(_edges(spark, d))


@query(f"WITH {FLOWS}, p AS (SELECT DISTINCT win, src, dst FROM e), t AS (SELECT src, dst FROM p WHERE win < 1 AND src = 'NATION_8'), x AS (SELECT win, count(*) AS c FROM p WHERE win >= 1 AND src IN (SELECT src FROM t) AND (src, dst) NOT IN (SELECT (src, dst) FROM t) GROUP BY win) SELECT win, coalesce(c, 0) AS new_neighbours FROM (SELECT DISTINCT win FROM p WHERE win >= 1) LEFT JOIN x USING (win)")
def new_neighbours_of_node(spark, d):
    return G.new_neighbours(_edges(spark, d), 1, "NATION_8")


@query()
def pods_current_flow_variation(spark, d):
    """The variation by service of the unscaled current flow between two pods and a target: a kernel per window, no SQL."""
    c = K.centralities(_edges(spark, d), ["current_flow_subset_raw"], sources=["NATION_3", "NATION_15"], targets=["NATION_8"])
    return G.by_service(c, A.nations(spark, d), "value")


# --- paths -------------------------------------------------------------------------------------------------------


@query(f"""WITH {_PATHS}, o AS (SELECT path, row_number() OVER (ORDER BY len(path), path) AS k, list_contains(path, 'NATION_0') AS d FROM paths),
g AS (SELECT CAST(floor(greatest(avg(CASE WHEN d THEN 1.0 ELSE 0.0 END) - 0.02::DOUBLE, 0) * count(*)) AS BIGINT) AS gone FROM o WHERE k <= 300), z AS (SELECT k FROM o WHERE k <= 300 AND d ORDER BY k DESC LIMIT (SELECT gone FROM g))
SELECT path FROM o, g WHERE k <= 300 + gone AND k NOT IN (SELECT k FROM z)""")
def path_share_trimmed(spark, d):
    """Of the first paths at most a share, about, pass one node; the next ones take the others' places."""
    return P.trimmed_paths(_links(spark, d), ["NATION_3", "NATION_15"], "NATION_8", 3, 300, "NATION_0", 0.02)


@query(f"WITH {_PATHS} SELECT path FROM paths ORDER BY len(path), path LIMIT 40")
def path_limit(spark, d):
    return P.simple_paths(_links(spark, d), ["NATION_3", "NATION_15"], "NATION_8", 3, 40)


@query("SELECT c_custkey, replace(c_name, '-', '_') || '_pod' AS pod, replace(c_name, '-', '_') || '_vip' AS vip FROM (SELECT c_custkey, lower(c_mktsegment) || '-' || c_custkey AS c_name FROM customer)")
def abstract_names(spark, d):
    name = F.concat_ws("-", F.lower("c_mktsegment"), F.col("c_custkey").cast("string"))
    return A.table(spark, d, "customer").select("c_custkey", P.abstract_name(name, "pod").alias("pod"), P.abstract_name(name, "vip").alias("vip"))


@query(f"WITH {_PATHS}, o AS (SELECT path, row_number() OVER (ORDER BY len(path), path) AS place FROM paths), u AS (SELECT path, 0 AS list, place FROM o WHERE place % 3 = 0 UNION ALL SELECT path, 1, place FROM o WHERE place % 2 = 0) SELECT array_to_string(path, '>') AS path, min(list * 100000 + place) AS first FROM u GROUP BY ALL")
def path_union(spark, d):
    from pyspark.sql import Window

    o = _paths(spark, d).withColumn("place", F.row_number().over(Window.orderBy(F.size("path"), "path")))
    u = P.union_of(o.filter("place % 3 = 0"), o.filter("place % 2 = 0"))
    return u.select(F.array_join("path", ">").alias("path"), (F.col("first.list") * 100000 + F.col("first.place")).alias("first"))


@query(f"WITH {_PATHS} SELECT array_to_string(path, '>') AS path, count(*) * (CASE WHEN len(path) = 3 THEN 2 ELSE 1 END) AS n FROM paths GROUP BY path")
def path_occurrences(spark, d):
    p = _paths(spark, d)
    lists = p.select(F.when(F.size("path") == 3, F.array("path", "path")).otherwise(F.array("path")).alias("paths"))
    return P.occurrences(lists).select(F.array_join("path", ">").alias("path"), "n")


_VARIANTS = f"""{_PATHS}, {_IDS}, z AS (SELECT path_id, hop, a, b, unnest(CASE WHEN b = 'nation_8_pod' THEN [[b]] WHEN y = 'nation_18' OR (x = 'nation_3' AND y = 'nation_20') OR (x = 'nation_15' AND y = 'nation_19') THEN [[y || '_vip', b], [b]]
  WHEN (x = 'nation_19' AND y = 'nation_15') OR (x = 'nation_20' AND y = 'nation_3') THEN [[x || '_vip', b], [b]] ELSE [[x || '_vip', b], [y || '_vip', b], [b]] END) AS o
  FROM (SELECT *, replace(a, '_pod', '') AS x, replace(b, '_pod', '') AS y FROM s)),
gr AS (SELECT path_id, 0 AS hop, list_concat([a], o) AS path FROM z WHERE hop = 0 UNION ALL SELECT gr.path_id, gr.hop + 1, list_concat(gr.path, z.o) FROM gr JOIN z ON z.path_id = gr.path_id AND z.hop = gr.hop + 1)"""


@query(f"WITH {_VARIANTS} SELECT path_id, array_to_string(path, '>') AS path FROM gr WHERE hop = (SELECT max(hop) FROM z WHERE z.path_id = gr.path_id)")
def path_variants(spark, d):
    """All ways that the VIP alternatives of a path's hops make together."""
    steps = vip_expansion(spark, d)
    return P.variants(steps).select("path_id", F.array_join("path", ">").alias("path"))


# --- features and scores -----------------------------------------------------------------------------------------

_EVAL = f"""tm AS (SELECT DISTINCT metric FROM ft WHERE win < 20 UNION SELECT 'gone'), ev_ AS (SELECT win, metric, CASE WHEN win % 4 = 0 THEN NULL ELSE value END AS value FROM ft WHERE win >= 20),
al AS (SELECT w.win, tm.metric, value FROM (SELECT DISTINCT win FROM ev_) w CROSS JOIN tm LEFT JOIN ev_ ON ev_.win = w.win AND ev_.metric = tm.metric),
fi AS (SELECT win, metric, greatest(-1e7, least(1e6, coalesce(value, median(value) OVER (PARTITION BY metric), 0))) AS value FROM al),
q AS (SELECT metric, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS z FROM fi GROUP BY metric)"""


@query(f"WITH {FLOWS}, {FEATURES}, {_EVAL} SELECT win, metric, round((value - m) / CASE WHEN z - a <> 0 THEN z - a ELSE 1 END, 6) AS value FROM fi JOIN q USING (metric)")
def eval_scale(spark, d):
    f = _features(spark, d)
    train = f.filter("win < 20").select("metric").distinct().union(spark.createDataFrame([("gone",)], "metric string"))
    run = f.filter("win >= 20").withColumn("value", F.when(F.col("win") % 4 != 0, F.col("value")))
    return _round(M.eval_scaled(run, train), "value").select("win", "metric", "value")


@query(f"WITH {FLOWS}, {FEATURES}, {_EVAL} SELECT * FROM al")
def feature_align(spark, d):
    f = _features(spark, d)
    train = f.filter("win < 20").select("metric").distinct().union(spark.createDataFrame([("gone",)], "metric string"))
    return M.aligned(f.filter("win >= 20").withColumn("value", F.when(F.col("win") % 4 != 0, F.col("value"))), train).select("win", "metric", "value")


@query(f"WITH {FLOWS}, {FEATURES} SELECT win, metric, value FROM ft UNION ALL SELECT win, 'abs_' || metric, abs(value) FROM ft WHERE metric IN ('NATION_3_weight', 'NATION_8_weight')")
def feature_abs(spark, d):
    return M.with_abs(_features(spark, d), ["NATION_3_weight", "NATION_8_weight"]).select("win", "metric", "value")


@query(f"WITH {EVENTS}, x AS (SELECT event_id % 13 AS metric, CASE WHEN (event_id * 7) % 13 * event_id % 26 = 0 THEN NULL ELSE value END AS value FROM ev) SELECT metric FROM x GROUP BY metric HAVING count(value) = count(*)")
def feature_complete(spark, d):
    e = F.col("event_id")
    x = A.events(spark, d).select((e % 13).alias("metric"), F.when((e * 7) % 13 * e % 26 != 0, F.col("value")).alias("value"))
    return M.complete_metrics(x).select("metric").distinct()


@query(f"WITH {EVENTS} SELECT pod % 5 AS k, kind AS metric, count(*) FILTER (event_id % 6 = 0) AS missing FROM ev GROUP BY ALL")
def missing_counts(spark, d):
    e = A.events(spark, d)
    value = F.when(F.col("event_id") % 6 != 0, F.col("value")).when(F.col("event_id") % 12 == 0, F.lit(float("nan")))
    return M.nan_counts(e.select((F.col("pod") % 5).alias("k"), F.col("kind").alias("metric"), value.alias("value")), ["k"])


_NAMED = "v AS (SELECT p_partkey AS win, CASE p_partkey % 8 WHEN 0 THEN 'exfil_weight' WHEN 1 THEN 'labels' WHEN 2 THEN 'ide_angles' WHEN 3 THEN 'new_neighbors_all' WHEN 4 THEN 'a_to_b_density' WHEN 5 THEN 'x_reciprocity_of_y' WHEN 6 THEN 'is_test' ELSE 'plain' END AS metric, p_retailprice AS value FROM part)"


def _named(spark, d):
    names = ["exfil_weight", "labels", "ide_angles", "new_neighbors_all", "a_to_b_density", "x_reciprocity_of_y", "is_test", "plain"]
    at = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("win"), at.alias("metric"), F.col("p_retailprice").alias("value"))


@query(f"WITH {_NAMED} SELECT * FROM v WHERE metric IN ('exfil_weight', 'labels', 'x_reciprocity_of_y', 'is_test', 'plain')")
def feature_named_drops(spark, d):
    return M.pruned(_named(spark, d))


@query(f"WITH {_NAMED} SELECT DISTINCT metric FROM v WHERE metric IN ('ide_angles', 'new_neighbors_all', 'a_to_b_density')")
def dropped_features(spark, d):
    v = _named(spark, d)
    return M.dropped_metrics(v, M.pruned(v))


@query(f"WITH {_NAMED} SELECT *, false AS aside FROM v WHERE metric NOT IN ('exfil_weight', 'labels', 'is_test') UNION ALL SELECT *, true FROM v WHERE metric = 'exfil_weight'")
def meta_columns(spark, d):
    fit, aside = M.without_meta(_named(spark, d))
    return fit.withColumn("aside", F.lit(False)).union(aside.withColumn("aside", F.lit(True)))


@query(f"WITH {_NAMED}, m AS (SELECT unnest(['plain', 'cilium']) AS metric) SELECT w.win, m.metric, coalesce(v.value, 0) AS value FROM (SELECT DISTINCT win FROM v) w CROSS JOIN m LEFT JOIN v ON v.win = w.win AND v.metric = m.metric")
def comparison_columns(spark, d):
    return M.comparison(_named(spark, d), ["plain", "cilium"])


@query(f"WITH {FLOWS}, {FEATURES} SELECT win, max(value) FILTER (metric = 'NATION_3_weight') AS a, max(value) FILTER (metric = 'NATION_8_weight') AS b, NULL::DOUBLE AS c FROM ft WHERE win < 9 GROUP BY win UNION ALL SELECT win, NULL, max(value) FILTER (metric = 'NATION_8_weight'), max(value) FILTER (metric = 'NATION_12_weight') FROM ft WHERE win >= 9 GROUP BY win")
def experiments_concatenated(spark, d):
    f = _features(spark, d)
    one = M.wide(f.filter("win < 9"), ("NATION_3_weight", "NATION_8_weight")).toDF("win", "a", "b")
    two = M.wide(f.filter("win >= 9"), ("NATION_12_weight", "NATION_8_weight")).toDF("win", "c", "b")
    return M.concatenated([one, two])


@query(f"WITH {FLOWS}, {FEATURES}, c AS (SELECT n_name || '_weight' AS metric, n_nationkey % 3 - 1.0 AS coef FROM nation) SELECT win, metric, round(value, 2) AS value, CAST(coef AS DOUBLE) AS coef FROM ft JOIN c USING (metric) WHERE coef <> 0")
def weighted_features(spark, d):
    path = fresh(spark, "weighted")
    coef = A.table(spark, d, "nation").select(F.concat("n_name", F.lit("_weight")).alias("metric"), (F.col("n_nationkey") % 3 - 1.0).alias("coef"))
    sinks.weighted_features(_features(spark, d), coef, path)
    return _round(spark.read.parquet(path), "value", places=2)


@query(f"WITH {EVENTS} SELECT win % 3 AS exp, path, count(*) * 21600 AS seconds FROM b WHERE path <> 0 GROUP BY ALL")
def path_times(spark, d):
    rows = A.scores(spark, d).select((F.col("win") % 3).alias("exp"), F.when(F.col("path") != 0, F.col("path")).alias("path"))
    return C.path_times(rows, 21600)


@query(f"WITH {EVENTS}, w AS (SELECT win, max(score) AS score FROM b GROUP BY win), m AS (SELECT win, max(label) AS label FROM b WHERE win % 2 = 0 GROUP BY win) SELECT w.win, score, label FROM w LEFT JOIN m USING (win)")
def meta_on_ensemble(spark, d):
    s = A.scores(spark, d)
    return C.on_ensemble(s.groupBy("win").agg(F.max("score").alias("score")), s.filter("win % 2 = 0").groupBy("win").agg(F.max("label").alias("label")))


# --- compositions ------------------------------------------------------------------------------------------------

_BARE = "regexp_replace({}, '_(pod|vip)$', '')"
_INJECTED = """h AS (SELECT win, 'NATION_3' AS src, 'NATION_8' AS dst, CAST(500000000 + win * 3 AS BIGINT) AS b FROM (SELECT DISTINCT win FROM e) WHERE win >= 20 AND win % 2 = 0),
u AS (SELECT * FROM e UNION ALL SELECT win, src, dst, b // 500, b FROM h UNION ALL SELECT win, dst, src, b // 500, (b // 500) * 40 FROM h),
i AS (SELECT win, src, dst, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(weight) AS BIGINT) AS weight FROM u WHERE src NOT IN ('NATION_18', 'NATION_19') AND dst NOT IN ('NATION_18', 'NATION_19') GROUP BY ALL),
s AS (SELECT win, a.svc AS src, b.svc AS dst, sum(weight) AS weight FROM i JOIN n a ON a.node = src JOIN n b ON b.node = dst GROUP BY ALL HAVING sum(weight) <> 0)"""


def _injected(spark, d):
    """Prune, inject, map: the edges between services of each window with traffic along an injected hop."""
    nations = A.nations(spark, d)
    e = I.application_edges(_edges(spark, d), nations.filter("node in ('NATION_18', 'NATION_19')"))
    hops = _edges(spark, d).select("win").distinct().filter("win >= 20 and win % 2 = 0").select("win", F.lit("NATION_3").alias("src"), F.lit("NATION_8").alias("dst"), (F.col("win") * 3 + 500000000).alias("bytes"))
    return G.service_rollup(P.inject(e, hops), nations)


_METRICS = """x AS (SELECT s.*, coalesce(r.weight, 0) AS back FROM s LEFT JOIN s r ON r.win = s.win AND r.src = s.dst AND r.dst = s.src WHERE s.src <> s.dst),
m AS (SELECT win, 'reciprocity' AS metric, coalesce(sum(least(weight, back)) / nullif(sum(weight), 0), -1) AS value FROM x GROUP BY win UNION ALL SELECT win, src || '_to_' || dst, CAST(weight AS DOUBLE) / 1e6 FROM s)"""


def _service_features(spark, d):
    s = _injected(spark, d)
    pairs = s.select("win", F.concat_ws("_to_", "src", "dst").alias("metric"), (F.col("weight") / 1e6).alias("value"))
    return G.reciprocity(s).select("win", F.lit("reciprocity").alias("metric"), F.col("reciprocity").alias("value")).union(pairs)


@query(f"WITH {FLOWS}, {_INJECTED}, {_METRICS} SELECT win, metric, round(value, 6) AS value FROM m")
def injected_features(spark, d):
    return _round(_service_features(spark, d), "value")


@query(f"""WITH {FLOWS}, {_INJECTED}, {_METRICS}, q AS (SELECT metric, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.75) AS z FROM m WHERE win < 20 GROUP BY metric),
z AS (SELECT win, metric, greatest(-100, least(100, (value - md) / CASE WHEN z - a <> 0 THEN z - a ELSE 1 END)) AS value FROM m JOIN q USING (metric)),
sc AS (SELECT win, max(abs(value)) AS score FROM z GROUP BY win), t AS (SELECT max(score) AS thr FROM sc WHERE win < 20)
SELECT win, round(score, 4) AS score, CAST(score > thr AS INTEGER) AS pred, CAST(win % 2 = 0 AS INTEGER) AS label FROM sc, t WHERE win >= 20""")
def injected_scores(spark, d):
    """End to end: features of the injected graph, scaled by the training windows', scored by the largest departure, thresholded by training."""
    scaled = M.robust_scaled(_service_features(spark, d), F.col("win") < 20)
    scores = scaled.groupBy("win").agg(F.max(F.abs("value")).alias("score"))
    limit = scores.filter("win < 20").agg(F.max("score").alias("thr"))
    out = C.thresholded(scores.filter("win >= 20").withColumn("label", (F.col("win") % 2 == 0).cast("int")), limit)
    return _round(out.select("win", "score", "pred", "label"), "score", places=4)


_NEAR = "coalesce({}, '')"
_VALID = f"""len(list_filter(range(1, len(path) + 1), lambda i: path[i] LIKE '%\\_vip' ESCAPE '\\' AND NOT (({_NEAR.format(_BARE.format('path[i - 1]'))} = {_BARE.format('path[i]')} OR {_NEAR.format(_BARE.format('path[i + 1]'))} = {_BARE.format('path[i]')})
  AND (path[i] LIKE '%db%' OR NOT ({_NEAR.format('path[i - 1]')} LIKE '%db%' OR {_NEAR.format('path[i + 1]')} LIKE '%db%'))))) = 0"""


@query(f"WITH {_VARIANTS} SELECT array_to_string(path, '>') AS path, {_VALID} AS valid FROM (SELECT path[:3] AS path FROM gr WHERE hop = (SELECT max(hop) FROM z WHERE z.path_id = gr.path_id))")
def path_validity(spark, d):
    p = path_variants(spark, d).select(F.slice(F.split("path", ">"), 1, 3).alias("p"))
    return p.select(F.array_join("p", ">").alias("path"), P.is_valid(F.col("p")).alias("valid"))


# --- more scans and joins ----------------------------------------------------------------------------------------


@query("""SELECT 'net' || r_regionkey AS network, '10.' || n_regionkey || '.0.' || n_nationkey AS ip, CASE WHEN n_nationkey % 2 = 0 THEN 'app' || n_nationkey || '.1' ELSE 'job' || n_nationkey END AS name FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'net' || r_regionkey, '10.' || r_regionkey || '.0.254', 'net' || r_regionkey || '_gateway' FROM region WHERE r_regionkey <> 2""")
def scan_networks(spark, d):
    n = A.table(spark, d, "nation")
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("app"), k, F.lit(".1.x"))).otherwise(F.concat(F.lit("job"), k))
    c = F.struct(k.alias("key"), F.struct(name.alias("Name"), F.concat(F.lit("10."), r, F.lit(".0."), k, F.lit("/24")).alias("IPv4Address")).alias("value"))
    config = F.when(F.col("n_regionkey") != 2, F.array(F.struct(F.concat(F.lit("10."), r, F.lit(".0.254/24")).alias("Gateway"))))
    net = n.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(c)).alias("Containers"), F.first(config).alias("Config"))
    text_ = F.to_json(F.array(F.struct(F.concat(F.lit("net"), F.col("n_regionkey").cast("string")).alias("Name"), F.struct("Config").alias("IPAM"), "Containers")))
    path = fresh(spark, "networks")
    net.select("n_regionkey", text_.alias("value")).repartition(F.col("n_regionkey")).write.partitionBy("n_regionkey").text(path)
    return text.networks(spark, f"{path}/*")


@query(f"WITH {FLOWS}, {FEATURES} SELECT win % 2 AS exp, CAST(CASE WHEN win < 14 THEN 10 ELSE 60 END AS INTEGER) AS gran, count(*) AS windows FROM (SELECT DISTINCT win FROM ft) WHERE win % 2 = 1 GROUP BY ALL")
def rediscovered_features(spark, d):
    """Feature files written by experiment and granularity, found again by their paths: those of experiment 1."""
    f = M.wide(_features(spark, d), ("NATION_3_weight",)).withColumns({"exp": F.col("win") % 2, "gran": F.when(F.col("win") < 14, 10).otherwise(60)})
    path = fresh(spark, "experiments")
    sinks.feature_csv(f, path, ("exp", "gran"))
    found = text.feature_folders(spark, path, "exp = 1")
    return found.groupBy(F.col("exp").cast("long").alias("exp"), F.col("gran").cast("int").alias("gran")).agg(F.count("*").alias("windows"))


@query(f"WITH {FLOWS}, o AS (SELECT win, src AS node, sum(weight) AS w FROM e GROUP BY ALL) SELECT win, node, round(w / sqrt(sum(w * w) OVER (PARTITION BY win)), 6) AS value FROM o")
def scan_node_vectors(spark, d):
    """Vectors of the nodes' outbound weights, of length 1 in each window, stored and read back."""
    o = _edges(spark, d).groupBy("win", F.col("src").alias("node")).agg(F.sum("weight").cast("double").alias("w"))
    norm = o.groupBy("win").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    path = fresh(spark, "vectors")
    sinks.node_vectors(o.join(norm, "win").select("win", "node", (F.col("w") / F.col("n")).alias("value")), path)
    return _round(text.node_vectors(spark, path), "value")


@query(f"WITH {FLOWS} SELECT win, src, dst, frames, weight, a.svc AS src_svc, b.svc AS dst_svc, a.is_vip OR b.is_vip AS over_vip FROM e JOIN n a ON a.node = src JOIN n b ON b.node = dst")
def scan_attributed_edges(spark, d):
    """Edges written with attributes of their ends, a folder for each window, and read back."""
    n = A.nations(spark, d)
    e = _edges(spark, d).join(n.select(F.col("node").alias("src"), F.col("svc").alias("src_svc"), F.col("is_vip").alias("_a")), "src").join(n.select(F.col("node").alias("dst"), F.col("svc").alias("dst_svc"), F.col("is_vip").alias("_b")), "dst")
    path = fresh(spark, "attributed")
    sinks.edge_table(e.select("win", "src", "dst", "frames", "weight", "src_svc", "dst_svc", (F.col("_a") | F.col("_b")).alias("over_vip")), path)
    return spark.read.parquet(path).withColumn("win", F.col("win").cast("long"))


@query(f"WITH {FLOWS}, {_ALLOWED} SELECT e.* FROM e SEMI JOIN al ON al.src = e.src AND al.dst = e.dst WHERE e.win >= 2")
def allowed_edges(spark, d):
    return _edges(spark, d).filter("win >= 2").join(_allowed(spark, d), ["src", "dst"], "left_semi").select("win", "src", "dst", "frames", "weight")


@query("SELECT event_id, user_id % 7 AS exp, CASE user_id % 7 WHEN 0 THEN 45 WHEN 1 THEN 85 WHEN 2 THEN 125 END AS load FROM events")
def load_of_experiment(spark, d):
    loads = spark.createDataFrame([(0, 45), (1, 85), (2, 125)], "exp long, load int")
    return A.table(spark, d, "events").select("event_id", (F.col("user_id") % 7).alias("exp")).join(loads, "exp", "left").select("event_id", "exp", "load")


@query()
def model_grid(spark, d):
    """Three models of the grid at two granularities, fitted on the first windows and held against the later ones: no SQL."""
    from .plans import models as L

    names = ("NATION_3", "NATION_8", "NATION_12", "NATION_15")
    frames = {}
    for g in (1, 2):
        f = A.flows(spark, d).groupBy(F.floor(F.col("win") / g).alias("win"), F.col("src").alias("metric")).agg((F.sum("weight") / 1e9).alias("value"))
        end = 20 // g
        frames[g] = M.wide(f, names).na.fill(0.0).withColumns({"label": (F.col("win") % 3 == 0).cast("double"), "is_test": (F.col("win") >= end).cast("int")})
        frames[g] = cut(frames[g])  # each model reads it
    fitted = L.fit_grid(frames, names, ("logistic_l1", "forest", "boosting"))
    return L.score_grid(fitted, frames, names).filter("is_test = 1")


@query("""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '0' WHEN o_orderkey % 11 = 0 THEN '?' WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority || '>' || o_orderstatus END AS t FROM orders)
SELECT o_orderkey, CASE WHEN t IS NULL OR t IN ('0', '?') THEN 0 ELSE len(string_split(t, '>')) END AS hops, CASE WHEN t IS NULL OR t IN ('0', '?') THEN '' ELSE string_split(t, '>')[1] END AS first FROM v""")
def path_column(spark, d):
    k = F.col("o_orderkey")
    text_ = F.when(k % 7 == 0, "0").when(k % 11 == 0, "?").when(k % 13 == 0, F.lit(None)).otherwise(F.concat_ws(">", "o_orderpriority", "o_orderstatus"))
    p = A.table(spark, d, "orders").select("o_orderkey", X.path_or_none(text_).alias("path"))
    return p.select("o_orderkey", F.size("path").alias("hops"), F.coalesce(F.get("path", F.lit(0)), F.lit("")).alias("first"))
