"""Queries over dependency graphs, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import graph as g
from ..tables import clean_path, load, once


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    return once(load(spark, sf, "cycle_jobs"), "cycle_id")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return g.job_edges(_jobs(spark, sf))


def _cycles(spark: SparkSession, sf: str) -> DataFrame:
    c = g.elementary_cycles(_edges(spark, sf), "cycle_id")
    return c.withColumn("cycle_key", g.cycle_key(F.col("nodes")))


def _layers(spark: SparkSession, sf: str) -> DataFrame:
    """Layer of each node: that of the first file (by path) named after it, by the project's layers."""
    files = once(load(spark, sf, "cycle_files", "file_id", "cycle_id", "project", "path"), "file_id").where("path is not null")
    layers = load(spark, sf, "projects", "project", "layers")
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract(clean_path(F.col("path")), r"([^/]*)$", 1), r"\.[^.]*$", ""), "[-_]", "")
    named = files.join(F.broadcast(layers), "project").select("cycle_id", F.lower(stem).alias("_stem"), "file_id", g.layer_of(clean_path(F.col("path")), F.col("layers")).alias("layer"))
    first = named.groupBy("cycle_id", "_stem").agg(F.min_by("layer", "file_id").alias("layer"))
    n = g.nodes(_edges(spark, sf), "cycle_id").withColumn("_stem", F.lower("node"))
    return n.join(first, ["cycle_id", "_stem"], "left").select("cycle_id", "node", F.coalesce("layer", F.lit("Unknown")).alias("layer"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf)
    return g.impact(_cycles(spark, sf), e, "cycle_id", node_layers=_layers(spark, sf), weights=g.edge_weights(e, "cycle_id"))


def _transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between successive event types of a user, weighted by how often they occur."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    ev = load(spark, sf, "events", "user_id", "ts", "event_id", "event_type").withColumn("dst", F.lead("event_type").over(w))
    return ev.where("dst is not null and dst <> event_type").groupBy(F.lit("events").alias("graph"), F.col("event_type").alias("src"), "dst").agg(F.count("*").cast("double").alias("weight"))


def _trade(spark: SparkSession, sf: str, k: int = 2) -> DataFrame:
    """The ``k`` strongest edges of each nation: from a line's supplier's nation to its customer's."""
    li = load(spark, sf, "lineitem", "l_orderkey", "l_suppkey")
    cust = load(spark, sf, "customer", "c_custkey", "c_nationkey")
    nation = load(spark, sf, "nation", "n_nationkey", "n_name")
    j = li.join(load(spark, sf, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(load(spark, sf, "supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("w")).where("s_nationkey <> c_nationkey")
    a, b = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("src")), nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dst"))
    named = j.join(F.broadcast(a), "s_nationkey").join(F.broadcast(b), "c_nationkey")
    w = W.partitionBy("src").orderBy(F.desc("w"), "dst")
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.lit("trade").alias("graph"), "src", "dst", F.col("w").cast("double").alias("weight"))


def g_flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Elementary cycles of the event transition graph, scored and ranked."""
    e = _transitions(spark, sf)
    c = g.elementary_cycles(e, "graph").withColumn("cycle_key", g.cycle_key(F.col("nodes")))
    s = g.impact(c, e, "graph", weights=e.withColumn("weight", F.log10(F.col("weight") + 1)))
    r = g.prioritized(s.withColumn("impact_score", F.round("impact_score", 6)), "impact_first", ["graph"], "cycle_key")
    return r.select("cycle_key", F.array_join("nodes", "->").alias("chain"), "size", "impact_score", "severity", "position")


def s7_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).select("cycle_id", "pos", "src", "dst")


def adj_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return g.adjacency(_edges(spark, sf), "cycle_id").select("cycle_id", "src", F.array_join("targets", ",").alias("targets"))


def adj_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes used by edges, and whether the job declares them."""
    declared = _jobs(spark, sf).select("cycle_id", F.explode("graph.nodes").alias("node")).distinct().withColumn("declared", F.lit(1))
    return g.nodes(_edges(spark, sf), "cycle_id").join(declared, ["cycle_id", "node"], "left").na.fill(0, ["declared"])


def adj_ring_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf).select("cycle_id", F.inline(g.ring(F.col("graph.nodes"))))


def adj_cycle_keys(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("graph.nodes")
    return _jobs(spark, sf).select("cycle_id", g.cycle_key(n).alias("cycle_key"), F.array_join(g.rotated(n), "->").alias("chain"), g.describe(n).alias("description"))


def f2_ignored_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = g.drop_ignored(_edges(spark, sf), ["BadgeStore", "CargoClient"], ["*Adapter", "menu*"])
    return e.select("cycle_id", "pos", "src", "dst")


def f3_unlisted_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges but those that a minimal diff that succeeded names as its target."""
    listed = once(load(spark, sf, "minimal_diffs", "diff_id", "cycle_id", "success", "target_src", "target_dst"), "diff_id").where("success").select("cycle_id", F.col("target_src").alias("src"), F.col("target_dst").alias("dst"))
    return g.drop_listed(g.distinct_edges(_edges(spark, sf), "cycle_id"), listed, "cycle_id")


def a4_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return g.degrees(_edges(spark, sf), "cycle_id")


def j1_edge_weights(spark: SparkSession, sf: str) -> DataFrame:
    return g.edge_weights(_edges(spark, sf), "cycle_id")


def j2_layers(spark: SparkSession, sf: str) -> DataFrame:
    return _layers(spark, sf)


def g1_components(spark: SparkSession, sf: str) -> DataFrame:
    return g.components(_edges(spark, sf), "cycle_id")


def f7_cyclic_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return g.cyclic_nodes(g1_components(spark, sf)).select("cycle_id", "node")


def g1_components_distributed(spark: SparkSession, sf: str) -> DataFrame:
    return g.components_distributed(_trade(spark, sf))


def g2_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return _cycles(spark, sf).select("cycle_id", "cycle_key", F.array_join("nodes", "->").alias("chain"), "size")


def g2_trade_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return g.elementary_cycles(_trade(spark, sf), "graph").select(F.array_join("nodes", "->").alias("chain"), "size")


def g4_unique_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles over all jobs once per key, with the first job that has it."""
    return _cycles(spark, sf).groupBy("cycle_key").agg(F.min("cycle_id").alias("first_job"), F.countDistinct("cycle_id").alias("jobs"))


def j3_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return g.overlaps(_cycles(spark, sf), "cycle_id", "cycle_key")


def j4_known_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles on the nodes of another job's declared cycle."""
    listed = _jobs(spark, sf).where("lower(severity) = 'critical'").select(F.col("graph.nodes").alias("nodes"))
    return g.known(_cycles(spark, sf), listed).select("cycle_id", "cycle_key")


def a1_impact(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c: F.round(c, 4).alias(c)
    return _scored(spark, sf).select("cycle_id", "cycle_key", r("length_score"), r("centrality_score"), r("edge_weight_score"), r("cross_layer_score"), r("overlap_score"), r("impact_score"), "severity")


def a2_summary(spark: SparkSession, sf: str) -> DataFrame:
    return g.summary(_scored(spark, sf))


def a3_severity_by_shape(spark: SparkSession, sf: str) -> DataFrame:
    o = g.overlaps(_cycles(spark, sf), "cycle_id", "cycle_key")
    return _cycles(spark, sf).join(o, ["cycle_id", "cycle_key"]).select("cycle_id", "cycle_key", g.severity_by_shape(F.col("size"), F.col("overlap")).alias("severity"))


def f6_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return g.at_least(_scored(spark, sf), "major", 5.0).select("cycle_id", "cycle_key", "severity")


def f6_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return g.at_least(_jobs(spark, sf), "major").select("cycle_id", F.lower("severity").alias("severity"))


def o2_priorities(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf).withColumn("impact_score", F.round("impact_score", 6))
    names = ("impact_first", "severity_first", "size_first", "cross_layer_first")
    for x in names:
        s = g.prioritized(s, x, ["cycle_id"], "cycle_key").withColumnRenamed("position", x)
    return s.select("cycle_id", "cycle_key", F.inline(F.array(*[F.struct(F.lit(x).alias("strategy"), F.col(x).alias("position")) for x in names])))


def o7_top_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The three strongest jobs of each project."""
    w = W.partitionBy("project").orderBy(F.desc_nulls_last("impact_score"), "cycle_id")
    return _jobs(spark, sf).where("project is not null").withColumn("position", F.row_number().over(w)).where("position <= 3").select("project", "position", "cycle_id", "impact_score")


def g6_broken(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a job's cycle is gone without the edge of its newest successful minimal diff."""
    d = once(load(spark, sf, "minimal_diffs", "diff_id", "cycle_id", "success", "target_src", "target_dst"), "diff_id").where("success")
    cut = d.groupBy("cycle_id").agg(F.max_by(F.struct("target_src", "target_dst"), "diff_id").alias("t")).select("cycle_id", F.col("t.target_src").alias("src"), F.col("t.target_dst").alias("dst"))
    before = g.distinct_edges(_edges(spark, sf), "cycle_id").join(cut.select("cycle_id"), "cycle_id", "left_semi")
    r = g.broken(before, g.drop_listed(before, cut, "cycle_id"), "cycle_id")
    return r.withColumn("confidence", F.round("confidence", 4))


def g7_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Edges found in the files themselves: a job's file names another node of the job."""
    files = load(spark, sf, "cycle_files", "file_id", "cycle_id", "content")  # edges are distinct, re-delivered or not
    f = files.select("cycle_id", F.col("file_id").cast("string").alias("node"), "content")
    n = _jobs(spark, sf).select("cycle_id", F.explode("graph.nodes").alias("node")).distinct()
    return g.mentions(f, n, "cycle_id").select("cycle_id", F.col("src").cast("bigint").alias("file_id"), F.col("dst").alias("node"))


def u1_edge_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Declared ring edges that the graph lacks, and edges that the ring lacks."""
    ring = adj_ring_edges(spark, sf).distinct()
    e = g.distinct_edges(_edges(spark, sf), "cycle_id")
    k = ["cycle_id", "src", "dst"]
    return ring.join(e, k, "left_anti").select(*k, F.lit("missing").alias("change")).unionByName(e.join(ring, k, "left_anti").select(*k, F.lit("extra").alias("change")))


def x34_cycle_type(spark: SparkSession, sf: str) -> DataFrame:
    n, e = F.size("graph.nodes"), F.size("graph.edges")
    kind = F.when(n == 2, "bidirectional").when(n <= 4, "transitive").when(e > 1.5 * n, "star").otherwise("transitive")
    return _jobs(spark, sf).select("cycle_id", kind.alias("cycle_type"))


QUERIES = {f.__name__: f for f in (
    g_flagship, s7_edges, adj_adjacency, adj_nodes, adj_ring_edges, adj_cycle_keys, f2_ignored_edges, f3_unlisted_edges, a4_degrees, j1_edge_weights, j2_layers, g1_components, f7_cyclic_nodes,
    g1_components_distributed, g2_cycles, g2_trade_cycles, g4_unique_cycles, j3_overlap, j4_known_cycles, a1_impact, a2_summary, a3_severity_by_shape, f6_filtered, f6_jobs, o2_priorities, o7_top_jobs,
    g6_broken, g7_mentions, u1_edge_diff, x34_cycle_type,
)}

# ----------------------------------------------------------------------------------------------------------- SQL
_J = "j AS (SELECT cycle_id, any_value(project) AS project, any_value(graph) AS graph, any_value(severity) AS severity, any_value(impact_score) AS impact_score FROM cycle_jobs GROUP BY cycle_id)"
_E = f"""{_J}, e0 AS (SELECT cycle_id, project, (i - 1)::INT AS pos, graph.edges[i][1] AS src, graph.edges[i][2] AS dst FROM j, unnest(range(1, len(graph.edges) + 1)) t(i) WHERE len(graph.edges[i]) >= 2),
 e AS (SELECT DISTINCT cycle_id, src, dst FROM e0)"""
_CYC = """walk(cycle_id, start, cur, path) AS (SELECT cycle_id, src, dst, [src, dst] FROM e WHERE dst > src
   UNION ALL SELECT w.cycle_id, w.start, e.dst, list_append(w.path, e.dst) FROM walk w JOIN e ON e.cycle_id = w.cycle_id AND e.src = w.cur WHERE e.dst > w.start AND NOT list_contains(w.path, e.dst)),
 cyc AS (SELECT w.cycle_id, w.path AS nodes, 'cycle_' || substr(md5(array_to_string(w.path, '->')), 1, 12) AS cycle_key FROM walk w JOIN e ON e.cycle_id = w.cycle_id AND e.src = w.cur AND e.dst = w.start)"""
_WITH = f"WITH RECURSIVE {_E}, {_CYC}"
_REACH = """reach(cycle_id, a, b) AS (SELECT cycle_id, src, dst FROM e UNION SELECT r.cycle_id, r.a, e.dst FROM reach r JOIN e ON e.cycle_id = r.cycle_id AND e.src = r.b),
 n AS (SELECT cycle_id, src AS node FROM e UNION SELECT cycle_id, dst FROM e),
 scc AS (SELECT n.cycle_id, n.node, least(n.node, coalesce(min(x.b), n.node)) AS component FROM n LEFT JOIN (SELECT r.* FROM reach r JOIN reach q ON q.cycle_id = r.cycle_id AND q.a = r.b AND q.b = r.a) x ON x.cycle_id = n.cycle_id AND x.a = n.node GROUP BY n.cycle_id, n.node)"""
_TRADE = """t0 AS (SELECT n1.n_name AS src, n2.n_name AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
   JOIN nation n1 ON n1.n_nationkey = s_nationkey JOIN nation n2 ON n2.n_nationkey = c_nationkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
 e AS (SELECT 'trade' AS cycle_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM t0) WHERE r <= 2)"""
_OVER = "ov AS (SELECT a.cycle_id, a.cycle_key, count(DISTINCT b.cycle_key) AS overlap FROM cyc a LEFT JOIN cyc b ON b.cycle_id = a.cycle_id AND b.cycle_key <> a.cycle_key AND list_has_any(a.nodes, b.nodes) AND list_sort(a.nodes) <> list_sort(b.nodes) GROUP BY 1, 2)"
_STEM = r"lower(replace(replace(regexp_replace(regexp_extract(replace(path, '\', '/'), '([^/]*)$', 1), '\.[^.]*$', ''), '-', ''), '_', ''))"
_PARTS = r"string_split(regexp_replace(replace(path, '\', '/'), '^(\./)+', ''), '/')"
_BASE = rf"list_extract({_PARTS}, -1)"
_LAYERS = rf"""f AS (SELECT file_id, any_value(cycle_id) AS cycle_id, any_value(project) AS project, any_value(path) AS path FROM cycle_files WHERE path IS NOT NULL GROUP BY file_id),
 ft AS (SELECT f.*, layers, [regexp_replace({_BASE}, '(.)\.[^.]*$', '\1'), {_BASE}] || [x for x in {_PARTS} if x <> ''] AS tries FROM f JOIN projects USING (project)),
 fl AS (SELECT cycle_id, {_STEM} AS stem, arg_min(coalesce([x for x in tries if list_contains(layers, x)][1], [y for y in layers if lower(y) = lower([x for x in tries if list_contains([lower(z) for z in layers], lower(x))][1])][1], 'Unknown'), file_id) AS layer FROM ft GROUP BY 1, 2),
 nl AS (SELECT n.cycle_id, n.node, coalesce(layer, 'Unknown') AS layer FROM (SELECT cycle_id, src AS node FROM e UNION SELECT cycle_id, dst FROM e) n LEFT JOIN fl ON fl.cycle_id = n.cycle_id AND fl.stem = lower(n.node))"""
_SCORED = f"""{_WITH}, {_OVER}, {_LAYERS},
 dg AS (SELECT cycle_id, node, count(*) AS d FROM (SELECT cycle_id, src AS node FROM e UNION ALL SELECT cycle_id, dst FROM e) GROUP BY 1, 2), sz AS (SELECT cycle_id, count(*) AS n FROM dg GROUP BY 1),
 wt AS (SELECT cycle_id, src, dst, count(*)::DOUBLE AS weight FROM e0 GROUP BY 1, 2, 3),
 cn AS (SELECT cycle_id, cycle_key, unnest(nodes) AS node FROM cyc),
 ce AS (SELECT cycle_id, cycle_key, nodes[i] AS src, nodes[i % len(nodes) + 1] AS dst FROM cyc, unnest(range(1, len(nodes) + 1)) t(i)),
 c1 AS (SELECT cn.cycle_id, cycle_key, 2.0 * avg(CASE WHEN n > 1 THEN d / (2.0 * (n - 1)) ELSE 0 END) AS cent, count(DISTINCT CASE WHEN layer <> 'Unknown' THEN layer END) AS nlay FROM cn JOIN dg USING (cycle_id, node) JOIN sz ON sz.cycle_id = cn.cycle_id JOIN nl ON nl.cycle_id = cn.cycle_id AND nl.node = cn.node GROUP BY 1, 2),
 c2 AS (SELECT ce.cycle_id, cycle_key, 0.5 * sum(coalesce(weight, 1.0)) AS ew FROM ce LEFT JOIN wt ON wt.cycle_id = ce.cycle_id AND wt.src = ce.src AND wt.dst = ce.dst GROUP BY 1, 2),
 s0 AS (SELECT cyc.cycle_id, cyc.cycle_key, nodes, len(nodes)::DOUBLE AS ln, cent, ew, CASE WHEN nlay > 1 THEN 10.0 ELSE 0.0 END::DOUBLE AS cl, least(0.5 * overlap, 5.0)::DOUBLE AS os FROM cyc JOIN c1 USING (cycle_id, cycle_key) JOIN c2 USING (cycle_id, cycle_key) JOIN ov USING (cycle_id, cycle_key)),
 s AS (SELECT *, ln + cent + ew + cl + os AS total, CASE WHEN ln + cent + ew + cl + os >= 15 OR cl > 0 THEN 'critical' WHEN ln + cent + ew + cl + os >= 8 THEN 'major' ELSE 'minor' END AS severity FROM s0)"""
_RANK = "CASE severity WHEN 'critical' THEN 2 WHEN 'major' THEN 1 ELSE 0 END"
_MD = "md AS (SELECT diff_id, any_value(cycle_id) AS cycle_id, any_value(success) AS success, any_value(target_src) AS target_src, any_value(target_dst) AS target_dst FROM minimal_diffs GROUP BY diff_id)"
_RING = "ring AS (SELECT cycle_id, graph.nodes[i] AS src, graph.nodes[i % len(graph.nodes) + 1] AS dst FROM j, unnest(range(1, len(graph.nodes) + 1)) t(i))"
_ROT = "CASE WHEN len(n) > 0 THEN n[list_position(n, list_min(n)):] || n[:list_position(n, list_min(n)) - 1] ELSE n END"

_EVENTS = """t0 AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), ew AS (SELECT 'events' AS cycle_id, src, dst, log10(count(*) + 1) AS weight FROM t0 WHERE dst IS NOT NULL AND dst <> src GROUP BY 2, 3),
 e AS (SELECT cycle_id, src, dst FROM ew)"""

SQL = {
    "g_flagship": f"""WITH RECURSIVE {_EVENTS}, {_CYC}, {_OVER}, dg AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), sz AS (SELECT count(*) AS n FROM dg),
        cn AS (SELECT cycle_key, unnest(nodes) AS node FROM cyc), c1 AS (SELECT cycle_key, 2.0 * avg(d / (2.0 * (n - 1))) AS cent FROM cn JOIN dg USING (node), sz GROUP BY 1),
        ce AS (SELECT cycle_key, nodes[i] AS src, nodes[i % len(nodes) + 1] AS dst FROM cyc, unnest(range(1, len(nodes) + 1)) t(i)), c2 AS (SELECT cycle_key, 0.5 * sum(weight) AS ew FROM ce JOIN ew USING (src, dst) GROUP BY 1),
        s AS (SELECT cycle_key, nodes, len(nodes) + cent + c2.ew + least(0.5 * overlap, 5.0) AS total FROM cyc JOIN c1 USING (cycle_key) JOIN c2 USING (cycle_key) JOIN ov USING (cycle_key)),
        r AS (SELECT *, CASE WHEN total >= 15 THEN 'critical' WHEN total >= 8 THEN 'major' ELSE 'minor' END AS severity FROM s)
        SELECT cycle_key, array_to_string(nodes, '->') AS chain, len(nodes)::INT AS size, round(total::DOUBLE, 6) AS impact_score, severity, row_number() OVER (ORDER BY round(total::DOUBLE, 6) DESC, cycle_key)::INT AS position FROM r""",
    "s7_edges": f"WITH {_E} SELECT cycle_id, pos, src, dst FROM e0",
    "adj_adjacency": f"WITH {_E} SELECT cycle_id, src, string_agg(dst, ',' ORDER BY dst) AS targets FROM e GROUP BY 1, 2",
    "adj_nodes": f"WITH {_E}, n AS (SELECT cycle_id, src AS node FROM e UNION SELECT cycle_id, dst FROM e) SELECT n.cycle_id, node, CASE WHEN list_contains(j.graph.nodes, node) THEN 1 ELSE 0 END::INT AS declared FROM n JOIN j USING (cycle_id)",
    "adj_ring_edges": f"WITH {_J}, {_RING} SELECT * FROM ring",
    "adj_cycle_keys": f"""WITH {_J}, r AS (SELECT cycle_id, graph.nodes AS n FROM j), q AS (SELECT cycle_id, n, {_ROT} AS rot FROM r)
        SELECT cycle_id, CASE WHEN len(n) > 0 THEN 'cycle_' || substr(md5(array_to_string(rot, '->')), 1, 12) ELSE 'cycle_empty' END AS cycle_key, array_to_string(rot, '->') AS chain,
        CASE WHEN len(n) = 2 THEN 'Direct circular dependency between ' || n[1] || ' and ' || n[2] ELSE 'Circular dependency chain: ' || array_to_string(n || [n[1]], ' → ') END AS description FROM q""",
    "f2_ignored_edges": f"WITH {_E} SELECT cycle_id, pos, src, dst FROM e0 WHERE NOT (src IN ('BadgeStore', 'CargoClient') OR lower(src) LIKE '%adapter' OR lower(src) LIKE 'menu%') AND NOT (dst IN ('BadgeStore', 'CargoClient') OR lower(dst) LIKE '%adapter' OR lower(dst) LIKE 'menu%')",
    "f3_unlisted_edges": f"WITH {_E}, {_MD} SELECT cycle_id, src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM md WHERE success AND md.cycle_id = e.cycle_id AND target_src = src AND target_dst = dst)",
    "a4_degrees": f"WITH {_E}, x AS (SELECT cycle_id, src AS node, 0 AS i, 1 AS o FROM e0 UNION ALL SELECT cycle_id, dst, 1, 0 FROM e0) SELECT cycle_id, node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM x GROUP BY 1, 2",
    "j1_edge_weights": f"WITH {_E} SELECT cycle_id, src, dst, count(*)::DOUBLE AS weight FROM e0 GROUP BY 1, 2, 3",
    "j2_layers": f"WITH {_E}, {_LAYERS} SELECT cycle_id, node, layer FROM nl",
    "g1_components": f"WITH RECURSIVE {_E}, {_REACH} SELECT cycle_id, node, component, count(*) OVER (PARTITION BY cycle_id, component)::INT AS size FROM scc",
    "f7_cyclic_nodes": f"WITH RECURSIVE {_E}, {_REACH} SELECT cycle_id, node FROM (SELECT *, count(*) OVER (PARTITION BY cycle_id, component) AS size FROM scc) WHERE size > 1",
    "g1_components_distributed": f"WITH RECURSIVE {_TRADE}, {_REACH} SELECT node, component FROM scc",
    "g2_cycles": f"{_WITH} SELECT cycle_id, cycle_key, array_to_string(nodes, '->') AS chain, len(nodes)::INT AS size FROM cyc",
    "g2_trade_cycles": f"WITH RECURSIVE {_TRADE}, {_CYC} SELECT array_to_string(nodes, '->') AS chain, len(nodes)::INT AS size FROM cyc",
    "g4_unique_cycles": f"{_WITH} SELECT cycle_key, min(cycle_id) AS first_job, count(DISTINCT cycle_id) AS jobs FROM cyc GROUP BY 1",
    "j3_overlap": f"{_WITH}, {_OVER} SELECT cycle_id, cycle_key, overlap FROM ov",
    "j4_known_cycles": f"{_WITH} SELECT cycle_id, cycle_key FROM cyc WHERE list_sort(list_distinct(nodes)) IN (SELECT list_sort(list_distinct(graph.nodes)) FROM j WHERE lower(severity) = 'critical')",
    "a1_impact": f"{_SCORED} SELECT cycle_id, cycle_key, round(ln, 4) AS length_score, round(cent, 4) AS centrality_score, round(ew, 4) AS edge_weight_score, round(cl, 4) AS cross_layer_score, round(os, 4) AS overlap_score, round(total, 4) AS impact_score, severity FROM s",
    "a2_summary": f"{_SCORED} SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor, count(*) FILTER (len(nodes) = 2) AS direct, count(*) FILTER (len(nodes) > 2) AS indirect FROM s",
    "a3_severity_by_shape": f"{_WITH}, {_OVER} SELECT cycle_id, cycle_key, CASE WHEN len(nodes) >= 5 OR overlap >= 3 THEN 'critical' WHEN len(nodes) = 2 THEN 'major' WHEN len(nodes) <= 3 AND overlap = 0 THEN 'minor' ELSE 'major' END AS severity FROM cyc JOIN ov USING (cycle_id, cycle_key)",
    "f6_filtered": f"{_SCORED} SELECT cycle_id, cycle_key, severity FROM s WHERE {_RANK} >= 1 AND total >= 5.0",
    "f6_jobs": f"WITH {_J} SELECT cycle_id, lower(severity) AS severity FROM j WHERE lower(severity) IN ('major', 'critical')",
    "o2_priorities": f"""{_SCORED}, o AS (SELECT *, round(total, 6) AS imp, {_RANK} AS rk FROM s)
        SELECT 'impact_first' AS strategy, cycle_id, cycle_key, row_number() OVER (PARTITION BY cycle_id ORDER BY imp DESC, rk DESC, cycle_key)::INT AS position FROM o
        UNION ALL SELECT 'severity_first', cycle_id, cycle_key, row_number() OVER (PARTITION BY cycle_id ORDER BY rk DESC, imp DESC, cycle_key)::INT FROM o
        UNION ALL SELECT 'size_first', cycle_id, cycle_key, row_number() OVER (PARTITION BY cycle_id ORDER BY len(nodes), imp DESC, cycle_key)::INT FROM o
        UNION ALL SELECT 'cross_layer_first', cycle_id, cycle_key, row_number() OVER (PARTITION BY cycle_id ORDER BY cl DESC, imp DESC, cycle_key)::INT FROM o""",
    "o7_top_jobs": f"WITH {_J} SELECT project, position, cycle_id, impact_score FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY impact_score DESC NULLS LAST, cycle_id)::INT AS position FROM j WHERE project IS NOT NULL) WHERE position <= 3",
    "g6_broken": f"""WITH RECURSIVE {_E.replace('e AS (', 'ea AS (')}, {_MD}, cut AS (SELECT cycle_id, arg_max(target_src, diff_id) AS s, arg_max(target_dst, diff_id) AS d FROM md WHERE success GROUP BY 1),
        b AS (SELECT ea.* FROM ea JOIN cut USING (cycle_id)), e AS (SELECT b.* FROM b JOIN cut USING (cycle_id) WHERE NOT (src = s AND dst = d)), {_REACH},
        k AS (SELECT cycle_id, count(*) AS remaining FROM (SELECT cycle_id, component FROM scc GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
        r AS (SELECT cut.cycle_id, (SELECT count(*) FROM b WHERE b.cycle_id = cut.cycle_id AND src = s AND dst = d) AS removed, coalesce(remaining, 0) AS remaining FROM cut LEFT JOIN k USING (cycle_id) WHERE EXISTS (SELECT 1 FROM b WHERE b.cycle_id = cut.cycle_id))
        SELECT cycle_id, removed, 0::BIGINT AS added, remaining, remaining = 0 AS is_broken, round(greatest(0.1, least(1.0, CASE WHEN removed > 0 THEN 0.8 ELSE 0.3 END - 0.2 * remaining))::DOUBLE, 4) AS confidence FROM r""",
    "g7_mentions": f"""WITH {_J}, f AS (SELECT file_id, any_value(cycle_id) AS cycle_id, any_value(content) AS content FROM cycle_files GROUP BY 1), w AS (SELECT DISTINCT file_id, cycle_id, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS node FROM f),
        n AS (SELECT DISTINCT cycle_id, unnest(graph.nodes) AS node FROM j) SELECT w.cycle_id, file_id, w.node FROM w JOIN n ON n.cycle_id = w.cycle_id AND n.node = w.node""",
    "u1_edge_diff": f"WITH {_E}, {_RING} SELECT *, 'missing' AS change FROM (SELECT cycle_id, src, dst FROM ring EXCEPT SELECT cycle_id, src, dst FROM e) UNION ALL SELECT *, 'extra' FROM (SELECT cycle_id, src, dst FROM e EXCEPT SELECT cycle_id, src, dst FROM ring)",
    "x34_cycle_type": f"WITH {_J} SELECT cycle_id, CASE WHEN len(graph.nodes) = 2 THEN 'bidirectional' WHEN len(graph.nodes) <= 4 THEN 'transitive' WHEN len(graph.edges) > 1.5 * len(graph.nodes) THEN 'star' ELSE 'transitive' END AS cycle_type FROM j",
}
