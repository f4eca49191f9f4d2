"""Queries of plans over all experiments, from budgets to the features of injected graphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .injection_queries import _NUMBER, _carried, _normal
from .operators import graph as G
from .operators import paths as P
from .operators.ranks import numbered
from .plans import driver as D
from .plans import schedule as S
from .queries import _PATHS, _links, query
from .sources import adapters as A

_GRANS, _SLOT, _COARSE = (28, 84), 2, 84
_NAMED = """fl AS (SELECT l_returnflag AS exp, CAST(date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS BIGINT) AS t, sn.n_name AS src, dn.n_name AS dst, CAST(floor(l_quantity) AS BIGINT) AS frames, CAST(round(l_extendedprice) AS BIGINT) AS weight
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation dn ON dn.n_nationkey = c_nationkey),
eg AS (SELECT exp, gran, CAST(floor(t / gran) AS BIGINT) AS win, src, dst, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(weight) AS BIGINT) AS weight FROM fl, (VALUES (28), (84)) g(gran) GROUP BY ALL),
wl AS (SELECT exp, win, sum(weight) AS w FROM eg WHERE gran = 84 GROUP BY ALL),
la AS (SELECT exp, win, CAST(w > 1.12 * avg(w) OVER (PARTITION BY exp) AS INTEGER) AS label FROM wl),
bu AS (SELECT exp, max(win) + 1 AS windows, min(win) FILTER (label = 1) AS first, sum(label) AS taken FROM la GROUP BY exp),
bd AS (SELECT exp, windows, CAST(floor(least(windows * 0.6, coalesce(first, windows))) AS BIGINT) AS train_end, taken FROM bu),
bg AS (SELECT *, CAST(floor(0.4 * train_end / 2) AS BIGINT) AS train, CAST(floor(greatest(0, 0.4 * (windows - train_end) - taken) / 2) AS BIGINT) AS test FROM bd),
fw AS (SELECT la.exp, CAST(win >= train_end AS INTEGER) AS part, win FROM la JOIN bg ON bg.exp = la.exp WHERE label = 0),
fi AS (SELECT exp, part, win, win - row_number() OVER (PARTITION BY exp, part ORDER BY win) AS g FROM fw),
fr AS (SELECT exp, part, min(win) AS a, max(win) + 1 AS z FROM fi GROUP BY exp, part, g),
sl AS (SELECT exp, part, unnest(range(a, z - 1, 2)) AS start FROM fr),
sk AS (SELECT sl.exp, part, start, row_number() OVER (PARTITION BY sl.exp, part ORDER BY start) - 1 AS k, count(*) OVER (PARTITION BY sl.exp, part) AS n, CASE WHEN part = 0 THEN train ELSE test END AS c FROM sl JOIN bg ON bg.exp = sl.exp),
sh AS (SELECT *, floor(k * least(c, n) / n) AS run, sha256('5:' || exp || ':' || part || ':' || start) AS h FROM sk WHERE least(c, n) > 0),
sp AS (SELECT exp, part, run, arg_min(start, {number}) AS start FROM sh GROUP BY ALL),
pa AS (SELECT path, row_number() OVER (ORDER BY len(path), path) - 1 AS path_id FROM paths QUALIFY path_id < 6),
sc AS (SELECT exp, part, start, (row_number() OVER (ORDER BY exp, part, start) - 1) AS pos FROM sp),
sd AS (SELECT exp, part, start, pos % (SELECT count(*) FROM pa) AS path_id FROM sc WHERE pos < ((SELECT count(*) FROM sc) // (SELECT count(*) FROM pa)) * (SELECT count(*) FROM pa)),
ow AS (SELECT exp, gran, part, start, path_id, unnest(range(start * (84 // gran), (start + 2) * (84 // gran))) AS win FROM sd, (VALUES (28), (84)) g(gran))""".format(number=_NUMBER.format(at=1))


def _tables(spark, d):
    """Edges of all experiments and granularities, labels, paths."""
    t = lambda n: A.table(spark, d, n)
    nation = t("nation").select("n_nationkey", "n_name")
    src = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("src"))
    dst = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("n_name").alias("dst"))
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    lines = t("lineitem").join(src, "l_suppkey").join(dst, "l_orderkey").withColumn("gran", F.explode(F.array(*map(F.lit, _GRANS))))
    flows = lines.select(F.col("l_returnflag").alias("exp"), "gran", F.floor(day / F.col("gran")).alias("win"), "src", "dst", F.floor("l_quantity").cast("long").alias("frames"), F.round("l_extendedprice").cast("long").alias("weight"))
    keys = ("exp", "gran", "win")
    edges = G.edge_sum(flows, keys)
    by_win = edges.filter(F.col("gran") == _COARSE).groupBy("exp", "win").agg(F.sum("weight").alias("w"))
    mean = by_win.groupBy("exp").agg(F.avg("w").alias("mean"))
    labels = by_win.join(mean, "exp").select("exp", "win", (F.col("w") > 1.12 * F.col("mean")).cast("int").alias("label"))
    paths = numbered(P.shortest_paths(_links(spark, d), ["NATION_3", "NATION_15"], "NATION_8", 3, 6).withColumn("_n", F.size("path")), ["_n", "path"], "path_id").select("path_id", "path")
    return edges, labels, paths


def _plan(spark, d):
    return S.planned(*_tables(spark, d), A.nations(spark, d), slot=_SLOT, coarse=_COARSE, grans=_GRANS, train_share=0.6, attack_share=0.4, rate=F.lit(90.0), deviation=40.0, seed=5)


@query(f"WITH {_PATHS}, {_NAMED} SELECT exp, gran, win, part, start, path_id FROM ow")
def planned_windows(spark, d):
    return _plan(spark, d)[0]


_SENT = "hp AS (SELECT path_id, path[i] AS src, path[i + 1] AS dst FROM (SELECT path_id, path, unnest(range(1, len(path))) AS i FROM pa)), dr AS (SELECT *, sha256('5:' || exp || ':' || gran || ':' || win) AS h FROM ow)"


def _step(gran: int) -> str:
    rates = f"(SELECT exp || ':' || start AS key, exp, start, path_id, win, {_normal('90.0::DOUBLE', 40, 'h')} AS rate FROM dr WHERE gran = {gran})"
    return _carried(rates, gran).replace("o AS (", f"o{gran} AS (").replace("c AS (", f"c{gran} AS (").replace("FROM o ", f"FROM o{gran} ").replace("FROM c JOIN o ON o.key = c.key AND o.k = c.k + 1", f"FROM c{gran} c JOIN o{gran} o ON o.key = c.key AND o.k = c.k + 1")


@query(f"""WITH {_PATHS}, {_NAMED}, {_SENT}, {_step(28)}, {_step(84)},
st AS (SELECT 28 AS gran, o28.exp, o28.path_id, c28.win, amount FROM c28 JOIN o28 ON o28.key = c28.key AND o28.k = c28.k WHERE amount >= 60 UNION ALL SELECT 84, o84.exp, o84.path_id, c84.win, amount FROM c84 JOIN o84 ON o84.key = c84.key AND o84.k = c84.k WHERE amount >= 60),
ih AS (SELECT st.*, src, dst FROM st JOIN hp ON hp.path_id = st.path_id),
iu AS (SELECT exp, gran, win, src, dst, weight FROM eg UNION ALL SELECT exp, gran, win, src, dst, amount FROM ih UNION ALL SELECT exp, gran, win, dst, src, (amount // 500) * 40 FROM ih),
nn AS (SELECT n_name AS node, r_name AS svc FROM nation JOIN region ON r_regionkey = n_regionkey),
sv AS (SELECT exp, gran, win, a.svc AS src, b.svc AS dst, sum(weight) AS weight FROM iu JOIN nn a ON a.node = src JOIN nn b ON b.node = dst GROUP BY ALL HAVING sum(weight) <> 0),
rx AS (SELECT sv.*, coalesce(r.weight, 0) AS back FROM sv LEFT JOIN sv r ON r.exp = sv.exp AND r.gran = sv.gran AND r.win = sv.win AND r.src = sv.dst AND r.dst = sv.src WHERE sv.src <> sv.dst),
rc AS (SELECT exp, gran, win, coalesce(sum(least(weight, back)) / nullif(sum(weight), 0), -1) AS reciprocity FROM rx GROUP BY ALL),
wt AS (SELECT exp, gran, win, CAST(sum(weight) AS BIGINT) AS weight FROM sv GROUP BY ALL)
SELECT exp, gran, win, weight, round(reciprocity, 6) AS reciprocity, path_id FROM wt LEFT JOIN rc USING (exp, gran, win) LEFT JOIN ow USING (exp, gran, win)""")
def planned_features(spark, d):
    """Experiments, granularities and slots as columns: features of every window's injected graph, beside the path that it carries."""
    windows, services = _plan(spark, d)
    keys = ["exp", "gran", "win"]
    total = services.groupBy(*keys).agg(F.sum("weight").alias("weight"))
    found = total.join(G.reciprocity(services, keys), keys, "left").join(windows.select(*keys, "path_id"), keys, "left")
    return found.select(*keys, "weight", F.round("reciprocity", 6).alias("reciprocity"), "path_id")


@query()
def driver_scores(spark, d):
    """From a configuration to the scores of all windows; the daily rate is large beside the weights of a pair of regions."""
    config = D.Config.of('{"time_interval_lengths": [28, 84], "time_of_synethic_exfil": 168, "goal_train_test_split_training": 0.6, "goal_attack_NoAttack_split_training": 0.4, "avg_exfil_per_min": [3.0], "exfil_per_min_variance": [0.3]}')
    return D.run(*_tables(spark, d), A.nations(spark, d), config)[0]
