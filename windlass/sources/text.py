"""Scans of the text formats: conversation tables, cluster tables, edge files, policies, reachability facts, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokens(lines: DataFrame) -> DataFrame:
    return lines.withColumn("t", F.split(F.trim("value"), " +"))


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """Rows of conversation tables: each line with a dot is a pair of addresses with frames and bytes of both directions."""
    t = lambda k, kind="string": F.get("t", F.lit(k)).try_cast(kind)
    rows = _tokens(spark.read.text(path).filter(F.col("value").contains("."))).filter(F.size("t") >= 7)
    return rows.select(F.col("_metadata.file_path").alias("file"), t(0).alias("addr_a"), t(2).alias("addr_b"), t(3, "long").alias("frames_ba"), t(4, "long").alias("bytes_ba"), t(5, "long").alias("frames_ab"), t(6, "long").alias("bytes_ab"), t(9, "double").alias("rel_start"), t(10, "double").alias("duration"))


def pods(spark: SparkSession, path: str) -> DataFrame:
    """(ip, name) of a pod table; several pods of one address are joined by ';'."""
    rows = _tokens(spark.read.text(path)).filter(F.size("t") >= 7).select(F.get("t", F.lit(1)).alias("name"), F.get("t", F.lit(6)).alias("ip"))
    return rows.groupBy("ip").agg(F.array_join(F.sort_array(F.collect_list("name")), ";").alias("name"))


def service_table(spark: SparkSession, path: str) -> DataFrame:
    """(name, ip, port, node_port, protocol) of a service table: a row for each port; names get the VIP suffix."""
    rows = _tokens(spark.read.text(path)).filter((F.size("t") >= 6) & (F.get("t", F.lit(0)) != "NAMESPACE"))
    each = rows.select(F.concat(F.get("t", F.lit(1)), F.lit("_VIP")).alias("name"), F.nullif(F.get("t", F.lit(3)), F.lit("None")).alias("ip"), F.explode(F.split(F.get("t", F.lit(5)), ",")).alias("p"))
    part = lambda k: F.regexp_extract("p", r"^(\d+)(?::(\d+))?/(\w+)$", k)
    return each.select("name", "ip", part(1).try_cast("int").alias("port"), part(2).try_cast("int").alias("node_port"), part(3).alias("protocol"))


def endpoints(spark: SparkSession, path: str) -> DataFrame:
    """(ip, name) of a container network's endpoint dump: the first IPv4 and IPv6 address of each pod."""
    schema = "array<struct<status struct<`external-identifiers` struct<`pod-name` string>, networking struct<addressing array<struct<ipv4 string, ipv6 string>>>>>>"
    e = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("e")).select(F.col("e.status.`external-identifiers`.`pod-name`").alias("name"), F.col("e.status.networking.addressing")[0].alias("a"))
    return e.select(F.explode(F.array("a.ipv4", "a.ipv6")).alias("ip"), "name").filter("ip is not null")


def cluster_log(spark: SparkSession, path: str) -> DataFrame:
    """Cluster events, one JSON object a line: (t, op, entity, namespace, name, ip, status)."""
    return spark.read.schema("t long, op string, entity string, namespace string, name string, ip string, status string").json(path)


def networks(spark: SparkSession, path: str) -> DataFrame:
    """(network, ip, name) of a container-network dump: JSON arrays one after the other; masks go, dotted names keep two parts."""
    schema = "array<struct<Name string, IPAM struct<Config array<struct<Subnet string, Gateway string>>>, Containers map<string, struct<Name string, IPv4Address string>>>>"
    text = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?<=\n\])\s*")).alias("j")).filter(F.trim("j") != "")
    net = text.select(F.explode(F.from_json("j", schema)).alias("n")).select(F.col("n.Name").alias("network"), F.col("n.IPAM.Config")[0]["Gateway"].alias("gw"), F.explode_outer(F.map_values("n.Containers")).alias("c"))
    name = F.when(F.size(F.split("c.Name", "[.]")) == 3, F.substring_index("c.Name", ".", 2)).otherwise(F.col("c.Name"))
    own = net.select("network", F.split_part("c.IPv4Address", F.lit("/"), F.lit(1)).alias("ip"), name.alias("name"))
    gws = net.filter("gw is not null").select("network", F.split_part("gw", F.lit("/"), F.lit(1)).alias("ip"), F.concat("network", F.lit("_gateway")).alias("name")).distinct()
    return own.filter("name is not null").union(gws)


def edge_file(spark: SparkSession, path: str) -> DataFrame:
    """(file, src, dst, frames, weight) of lines `src dst {'frames':n,'weight':n}`."""
    part = lambda k: F.regexp_extract("value", r"^(\S+) (\S+) (\{.*\})$", k)
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), part(1).alias("src"), part(2).alias("dst"), F.from_json(part(3), "frames bigint, weight bigint", {"allowSingleQuotes": "true"}).alias("a"))
    return rows.filter("src <> ''").select("file", "src", "dst", "a.frames", "a.weight")


def talking_pairs(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs(src, dst), hosts(node)) of edges with any frame."""
    pairs = edges.filter("frames > 0").select("src", "dst").distinct()
    return pairs, pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()


def policy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(allowed(src, dst), pairs(src, vip_of)): lines before and after the divider; 'all' stands for every name, both ways round."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "l")).withColumn("l", F.trim(F.split_part("l", F.lit("#"), F.lit(1))))
    cut = lines.filter(F.regexp_like("l", F.lit("^-+$"))).agg(F.min("i").alias("cut"))
    rows = lines.crossJoin(cut).filter("l <> ''")
    part = lambda k: F.regexp_extract("l", r"^(\S+)\s+ALLOWED\s+(\S+)$", k)
    raw = rows.filter("cut is null or i < cut").select(part(1).alias("src"), part(2).alias("dst")).filter("src <> ''")
    names = raw.select(F.col("src").alias("n")).union(raw.select("dst")).filter("n <> 'all'").distinct()
    dst = raw.join(names, (F.col("dst") == F.col("n")) | (F.col("dst") == "all")).filter("src <> n").select("src", F.col("n").alias("dst"))
    allowed = dst.union(dst.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    two = rows.filter("cut is not null and i > cut").withColumn("t", F.split("l", r"\s+")).filter(F.size("t") == 2)
    return allowed, two.select(F.get("t", F.lit(0)).alias("src"), F.get("t", F.lit(1)).alias("vip_of"))


def reachability(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (src, dst, protocol, port) of hacl facts."""
    rows = spark.read.text(path).filter(F.col("value").contains("hacl("))
    part = lambda k: F.trim(F.translate(F.regexp_extract("value", r"hacl\(([^,]+),([^,]+),([^,]+),([^)]+)\)", k), "'", ""))
    return rows.select(part(1).alias("src"), part(2).alias("dst"), part(3).alias("protocol"), part(4).alias("port")).filter("src <> ''").distinct()


def feature_csv(spark: SparkSession, path: str) -> DataFrame:
    """A feature table with '?' for missing values; the unnamed first column is the window's time."""
    frame = spark.read.option("header", True).option("nullValue", "?").option("inferSchema", True).csv(path)
    return frame.withColumnRenamed(frame.columns[0], "time")


def feature_folders(spark: SparkSession, path: str, only: str = "true") -> DataFrame:
    """Feature tables found again below a folder, with the columns that their folders' names state; only says which folders are read."""
    return spark.read.option("header", True).option("nullValue", "?").option("inferSchema", True).option("basePath", path).csv(path).filter(only)


def node_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(keys, node, value) of a stored table of vectors."""
    rows = spark.read.parquet(path)
    return rows.select(*(c for c in rows.columns if c not in ("nodes", "values")), F.inline(F.arrays_zip(F.col("nodes").alias("node"), F.col("values").alias("value"))).alias("node", "value"))


def load_test_totals(spark: SparkSession, path: str) -> DataFrame:
    """(requests, failures, ratio) over a load test's rows whose method is None and count a number; ratio 0 without requests."""
    raw = spark.read.csv(path)
    rows = raw.filter((F.col("_c0") == "None") & F.col("_c2").try_cast("long").isNotNull())
    n, f = F.sum(F.col("_c2").try_cast("long")), F.sum(F.col("_c3").try_cast("long"))
    return rows.agg(n.alias("requests"), f.alias("failures"), F.coalesce(F.try_divide(f.cast("double"), n.cast("double")), F.lit(0.0)).alias("ratio"))


def log_problems(spark: SparkSession, path: str) -> DataFrame:
    """(file, problem): whether a log has a traceback or a deployment with no replica ready."""
    ready = F.regexp_extract("value", r"(?:^|\s)(\d+)/(\d+)(?:\s|$)", 1)
    bad = F.col("value").contains("Traceback") | (ready == "0")
    return spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.max(bad).alias("problem"))
