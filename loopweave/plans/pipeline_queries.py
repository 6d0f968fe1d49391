"""Queries over whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..tables import load, once
from . import pipeline


def m19_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Every job's cycles of at least minor severity, ranked, without adapters."""
    e = g.job_edges(once(load(spark, sf, "cycle_jobs", "cycle_id", "project", "graph"), "cycle_id"))
    r = pipeline.analyze(e, "cycle_id", ignore_patterns=["*Adapter"])
    return r.select("cycle_id", "cycle_key", F.round("impact_score", 4).alias("impact_score"), "severity", "position")


def m1_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """What comes of each proposal's answer when it is applied to the cycle's files."""
    a = load(spark, sf, "proposals", "cycle_id", "proposal_id", "llm_response").dropDuplicates(["proposal_id"])
    f = load(spark, sf, "cycle_files", "cycle_id", "path", "content").dropDuplicates(["cycle_id", "path"])
    v = pipeline.verdicts(pipeline.process(a, f, ["cycle_id", "proposal_id"], "llm_response"), ["cycle_id", "proposal_id"])
    return v.withColumn("confidence", F.round("confidence", 4))


QUERIES = {f.__name__: f for f in (m19_analysis, m1_verdicts)}

_J = "j AS (SELECT cycle_id, any_value(graph) AS graph FROM cycle_jobs GROUP BY cycle_id), e0 AS (SELECT cycle_id, graph.edges[i][1] AS src, graph.edges[i][2] AS dst FROM j, unnest(range(1, len(graph.edges) + 1)) t(i) WHERE len(graph.edges[i]) >= 2 AND NOT lower(graph.edges[i][1]) LIKE '%adapter' AND NOT lower(graph.edges[i][2]) LIKE '%adapter'), e AS (SELECT DISTINCT * FROM e0)"
SQL = {
    "m19_analysis": f"""WITH RECURSIVE {_J}, walk(cycle_id, start, cur, path) AS (SELECT cycle_id, src, dst, [src, dst] FROM e WHERE dst > src UNION ALL SELECT w.cycle_id, w.start, e.dst, list_append(w.path, e.dst) FROM walk w JOIN e ON e.cycle_id = w.cycle_id AND e.src = w.cur WHERE e.dst > w.start AND NOT list_contains(w.path, e.dst)),
        cyc AS (SELECT w.cycle_id, w.path AS nodes, 'cycle_' || substr(md5(array_to_string(w.path, '->')), 1, 12) AS cycle_key FROM walk w JOIN e ON e.cycle_id = w.cycle_id AND e.src = w.cur AND e.dst = w.start),
        ov AS (SELECT a.cycle_id, a.cycle_key, count(DISTINCT b.cycle_key) AS o FROM cyc a LEFT JOIN cyc b ON b.cycle_id = a.cycle_id AND b.cycle_key <> a.cycle_key AND list_has_any(a.nodes, b.nodes) AND list_sort(a.nodes) <> list_sort(b.nodes) GROUP BY 1, 2),
        dg AS (SELECT cycle_id, node, count(*) AS d FROM (SELECT cycle_id, src AS node FROM e UNION ALL SELECT cycle_id, dst FROM e) GROUP BY 1, 2), sz AS (SELECT cycle_id, count(*) AS n FROM dg GROUP BY 1),
        cn AS (SELECT cycle_id, cycle_key, unnest(nodes) AS node FROM cyc), c1 AS (SELECT cn.cycle_id, cycle_key, 2.0 * avg(d / (2.0 * (n - 1))) AS c FROM cn JOIN dg USING (cycle_id, node) JOIN sz ON sz.cycle_id = cn.cycle_id GROUP BY 1, 2),
        w AS (SELECT cycle_id, src, dst, count(*) AS w FROM e0 GROUP BY 1, 2, 3), ce AS (SELECT cycle_id, cycle_key, nodes[i] AS src, nodes[i % len(nodes) + 1] AS dst FROM cyc, unnest(range(1, len(nodes) + 1)) t(i)),
        c2 AS (SELECT ce.cycle_id, cycle_key, 0.5 * sum(w) AS e FROM ce JOIN w USING (cycle_id, src, dst) GROUP BY 1, 2),
        s AS (SELECT cyc.cycle_id, cyc.cycle_key, (len(nodes) + c1.c + c2.e + least(0.5 * o, 5.0))::DOUBLE AS t FROM cyc JOIN c1 USING (cycle_id, cycle_key) JOIN c2 USING (cycle_id, cycle_key) JOIN ov USING (cycle_id, cycle_key)),
        q AS (SELECT *, CASE WHEN t >= 15 THEN 'critical' WHEN t >= 8 THEN 'major' ELSE 'minor' END AS severity FROM s)
        SELECT cycle_id, cycle_key, round(t, 4) AS impact_score, severity, row_number() OVER (PARTITION BY cycle_id ORDER BY round(t, 9) DESC, cycle_key)::INT AS position FROM q""",
}
