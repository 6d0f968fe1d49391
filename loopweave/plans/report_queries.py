"""Queries over sources, sinks and reports, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import reports as r
from ..sources import readers, sinks
from ..tables import clean_path, load, once


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return once(load(spark, sf, "cycle_files", "file_id", "cycle_id", "project", "path", "content"), "file_id")


def _patches(spark: SparkSession, sf: str) -> DataFrame:
    return once(load(spark, sf, "patch_results", "patch_id", "cycle_id", "iteration", "path", "original", "patched", "status", "validation_issues", "applied_blocks", "total_blocks"), "patch_id")


def s1_import_facts(spark: SparkSession, sf: str) -> DataFrame:
    f = _files(spark, sf).where("lower(path) like '%.ts' or lower(path) like '%.js'").withColumn("path", F.col("file_id").cast("string"))
    return readers.import_facts(f).select(F.col("path").cast("bigint").alias("file_id"), "module")


def x1_resolved_imports(spark: SparkSession, sf: str) -> DataFrame:
    f = _files(spark, sf).where("path is not null").withColumn("path", clean_path(F.col("path")))
    return readers.resolved_imports(f, "cycle_id")


def s6_jobs_json(spark: SparkSession, sf: str) -> DataFrame:
    """Graph jobs written as JSON and read again in the layout with ids beside the graph."""
    j = once(load(spark, sf, "cycle_jobs", "cycle_id", "graph"), "cycle_id")
    text = j.select(F.to_json(F.struct(F.col("cycle_id").alias("id"), "graph")).alias("value"))
    return readers.graph_jobs(text).select("id", F.size("nodes").alias("nodes"), F.size("edges").alias("edges"))


def k2_safe_paths(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.write_log(_patches(spark, sf), "patch_id", "path", "patched")


def k13_listing(spark: SparkSession, sf: str) -> DataFrame:
    j = once(load(spark, sf, "cycle_jobs", "cycle_id", "graph"), "cycle_id")
    return j.select("cycle_id", r.listing(F.col("graph.nodes")).alias("listing"))


def y26_shortened(spark: SparkSession, sf: str) -> DataFrame:
    p = once(load(spark, sf, "proposals", "proposal_id", "rationale"), "proposal_id")
    return p.select("proposal_id", r.shortened(F.col("rationale"), 40).alias("short"))


def x47_failure_classes(spark: SparkSession, sf: str) -> DataFrame:
    p = _patches(spark, sf)
    c = r.failure_class(F.col("status"), F.col("original"), F.col("patched"), F.col("validation_issues"), F.col("applied_blocks"), F.col("total_blocks"))
    return p.select(c.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("patches"))


def k10_status_report(spark: SparkSession, sf: str) -> DataFrame:
    return r.status_report(_patches(spark, sf))


def a18_decision(spark: SparkSession, sf: str) -> DataFrame:
    i = _patches(spark, sf).select("cycle_id", "iteration", F.explode("validation_issues").alias("c")).withColumn("severity", t.issue_severity(F.regexp_replace("c", "_", " ")))
    return r.decision(i, ["cycle_id", "iteration"])


def j10_matched_patches(spark: SparkSession, sf: str) -> DataFrame:
    return r.matched_patches(_patches(spark, sf), _files(spark, sf), "cycle_id")


def o8_context(spark: SparkSession, sf: str) -> DataFrame:
    """The first three documents of each source as one context."""
    from pyspark.sql.window import Window as W

    d = load(spark, sf, "documents", "doc_id", "text", "source").where("source is not null")
    d = d.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where("rank <= 3")
    c = r.formatted_context(d, "source", "text", "source", "rank", 800)
    return c.select("source", F.md5("context").alias("digest"))


QUERIES = {f.__name__: f for f in (s1_import_facts, x1_resolved_imports, s6_jobs_json, k2_safe_paths, k13_listing, y26_shortened, x47_failure_classes, k10_status_report, a18_decision, j10_matched_patches, o8_context)}

_F = "f AS (SELECT file_id, any_value(cycle_id) AS cycle_id, any_value(path) AS path, any_value(content) AS content FROM cycle_files GROUP BY file_id)"
_P = "p AS (SELECT patch_id, any_value(cycle_id) AS cycle_id, any_value(iteration) AS iteration, any_value(path) AS path, any_value(original) AS original, any_value(patched) AS patched, any_value(status) AS status, any_value(validation_issues) AS vi, any_value(applied_blocks) AS ab, any_value(total_blocks) AS tb FROM patch_results GROUP BY patch_id)"
_RX = [p.replace("'", "''") for p in readers.IMPORTS]
_CAT = "CASE WHEN regexp_matches(c, '" + "|".join(t.CRITICAL) + "') THEN 'critical' WHEN regexp_matches(c, '" + "|".join(t.MAJOR) + "') THEN 'major' WHEN regexp_matches(c, '" + "|".join(t.MINOR) + "') THEN 'minor' ELSE 'major' END"
_MARK = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in r.MARKS.items()) + " ELSE '❌' END"
_B = r"lower(regexp_extract(replace(path, '\', '/'), '([^/]*)$', 1))"

SQL = {
    "s1_import_facts": f"WITH {_F} SELECT file_id, unnest(list_distinct({' || '.join(f'''regexp_extract_all(coalesce(content, ''), '{x}', 1)''' for x in _RX)})) AS module FROM f WHERE lower(path) LIKE '%.ts' OR lower(path) LIKE '%.js'",
    "s6_jobs_json": "SELECT cycle_id AS id, len(any_value(graph).nodes)::INT AS nodes, len(any_value(graph).edges)::INT AS edges FROM cycle_jobs GROUP BY 1",
    "k2_safe_paths": rf"WITH {_P} SELECT patch_id, array_to_string([x for x in string_split(regexp_replace(replace(coalesce(path, ''), '\', '/'), '^[A-Za-z]:', ''), '/') if x NOT IN ('', '.', '..')], '/') AS path, 'text' AS type, coalesce(length(patched), 0)::INT AS size FROM p",
    "k13_listing": "WITH j AS (SELECT cycle_id, any_value(graph).nodes AS n FROM cycle_jobs GROUP BY 1) SELECT cycle_id, array_to_string(n[:4], ' -> ') || CASE WHEN len(n) > 4 THEN ' ... (' || len(n) || ' total)' ELSE '' END AS listing FROM j",
    "y26_shortened": "WITH p AS (SELECT proposal_id, any_value(rationale) AS r FROM proposals GROUP BY 1) SELECT proposal_id, CASE WHEN length(r) > 40 THEN left(r, 40) || '... (' || (length(r) - 40) || ' more chars)' ELSE r END AS short FROM p",
    "x47_failure_classes": f"""WITH {_P}, q AS (SELECT CASE WHEN status NOT IN ('failed', 'reverted', 'partial') THEN NULL WHEN status <> 'reverted' AND coalesce(original, '') = coalesce(patched, '') AND length(original) > 0 THEN 'no_op' WHEN ab < tb THEN 'search_mismatch'
        WHEN contains(lower(array_to_string(coalesce(vi, []), ' ')), 'syntax') THEN 'syntax' WHEN array_to_string(coalesce(vi, []), ' ') <> '' THEN 'validation' ELSE 'unknown' END AS reason FROM p) SELECT reason, count(*) AS patches FROM q WHERE reason IS NOT NULL GROUP BY 1""",
    "k10_status_report": f"WITH {_P} SELECT cycle_id, '## Patches' || chr(10) || string_agg('- ' || {_MARK} || ' `' || coalesce(path, '?') || '` ' || coalesce(status, 'unknown'), chr(10) ORDER BY coalesce(path, '?'), patch_id) AS report FROM p GROUP BY 1",
    "a18_decision": f"WITH {_P}, i AS (SELECT cycle_id, iteration, replace(lower(unnest(vi)), '_', ' ') AS c FROM p), s AS (SELECT cycle_id, iteration, {_CAT} AS severity FROM i) SELECT cycle_id, iteration, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor, count(*) FILTER (severity IN ('critical', 'major')) = 0 AS approved FROM s GROUP BY 1, 2",
    "j10_matched_patches": f"""WITH {_P}, {_F}, a AS (SELECT *, {_B} AS b FROM p), g AS (SELECT *, {_B} AS b FROM f),
        j AS (SELECT patch_id, file_id, CASE WHEN a.path = g.path THEN 1 WHEN string_split(a.path, '/')[-1] = string_split(g.path, '/')[-1] THEN 2 ELSE 3 END AS tier FROM a JOIN g ON a.cycle_id = g.cycle_id AND a.b = g.b AND a.b <> '')
        SELECT patch_id, file_id, tier::INT AS tier FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY tier, file_id) AS r FROM j) WHERE r = 1""",
    "o8_context": """WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE source IS NOT NULL), c AS (SELECT source, string_agg('[Source ' || r || ': ' || source || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) AS c FROM d WHERE r <= 3 GROUP BY 1)
        SELECT source, md5(CASE WHEN length(c) > 800 THEN left(c, 800) || chr(10) || '... [truncated]' ELSE c END) AS digest FROM c""",
}
