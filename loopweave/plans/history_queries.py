"""Queries over attempts and patch results, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as h
from ..tables import load, once, project


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    return once(load(spark, sf, "attempts"), "attempt_id")


def _patches(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return once(load(spark, sf, "patch_results", "patch_id", "cycle_id", "iteration", "relay", "path", "status", "confidence", "revert_reason", "has_critical_error", "applied_blocks", "total_blocks", "warnings", "validation_issues", *more), "patch_id")


def a8_stats(spark: SparkSession, sf: str) -> DataFrame:
    return h.stats(_attempts(spark, sf))


def a6_learning(spark: SparkSession, sf: str) -> DataFrame:
    return h.learning(_attempts(spark, sf))


def a6_issues(spark: SparkSession, sf: str) -> DataFrame:
    return h.issue_histogram(_attempts(spark, sf))


def a7_tips(spark: SparkSession, sf: str) -> DataFrame:
    return h.tips(_attempts(spark, sf))


def a10_recurring(spark: SparkSession, sf: str) -> DataFrame:
    return h.recurring(_attempts(spark, sf))


def u3_common_issues(spark: SparkSession, sf: str) -> DataFrame:
    return h.common_issues(_attempts(spark, sf))


def w5_last_attempts(spark: SparkSession, sf: str) -> DataFrame:
    return h.last_attempts(_attempts(spark, sf)).select("cycle_id", "attempt_id", "position")


def w6_similar_failures(spark: SparkSession, sf: str) -> DataFrame:
    return h.similar_failures(_attempts(spark, sf), ["type_error", "syntax"]).select("attempt_id", "cycle_id")


def w8_accumulated(spark: SparkSession, sf: str) -> DataFrame:
    return h.accumulated(_attempts(spark, sf)).withColumn("failed_strategies", F.array_join("failed_strategies", ","))


def y22_memory_context(spark: SparkSession, sf: str) -> DataFrame:
    return h.memory_context(_attempts(spark, sf))


def a5_severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Issues by severity over all attempts, in one case."""
    e = _attempts(spark, sf).select(F.explode("severity_counts").alias("severity", "n"))
    return e.groupBy(F.lower("severity").alias("severity")).agg(F.sum("n").alias("issues"))


def a5_times(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts whose time can be read, by month."""
    t = h.attempt_time(F.col("ts"))
    return _attempts(spark, sf).select(F.date_format(t, "yyyy-MM").alias("month")).where("month is not null").groupBy("month").agg(F.count("*").alias("attempts"))


def a9_revert_gate(spark: SparkSession, sf: str) -> DataFrame:
    return h.revert_gate(_patches(spark, sf)).select("patch_id", "revert_all", "final_status")


def a15_totals(spark: SparkSession, sf: str) -> DataFrame:
    return h.by_status(_patches(spark, sf)).withColumn("confidence", F.round("confidence", 6))


def a16_failures(spark: SparkSession, sf: str) -> DataFrame:
    return h.failures(_patches(spark, sf))


def adj_roadmap(spark: SparkSession, sf: str) -> DataFrame:
    return h.roadmap(_patches(spark, sf, "original", "patched")).withColumn("confidence", F.round("confidence", 6))


def k3_reverted_files(spark: SparkSession, sf: str) -> DataFrame:
    """Reverted files over all proposals, by reason."""
    p = once(load(spark, sf, "proposals", "proposal_id", "reverted_files"), "proposal_id")
    return p.select(F.inline("reverted_files")).groupBy("reason").agg(F.count("*").alias("files"), F.countDistinct("path").alias("paths"))


def k5_write_log(spark: SparkSession, sf: str) -> DataFrame:
    """What writing all files of a cycle would take: files and characters."""
    f = project(load(spark, sf, "cycle_files", "file_id", "cycle_id", "content"), "file_id", "file_id", "cycle_id", F.length("content").alias("n"))
    return f.groupBy("cycle_id").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("chars"))


def k8_call_log(spark: SparkSession, sf: str) -> DataFrame:
    """Calls by relay: prompts and answers, their lengths and the mean length of an answer."""
    p = project(load(spark, sf, "proposals", "proposal_id", "relay", "prompt", "llm_response"), "proposal_id", "proposal_id", "relay", F.length("prompt").alias("p"), F.length("llm_response").alias("a"))
    return p.groupBy("relay").agg(
        F.count("*").alias("calls"), F.count("a").alias("answered"), F.sum("p").alias("prompt_chars"), F.coalesce(F.sum("a"), F.lit(0)).alias("answer_chars"), F.round(F.avg("a"), 4).alias("mean_answer")
    )


def m13_strategies(spark: SparkSession, sf: str) -> DataFrame:
    p = once(load(spark, sf, "proposals", "proposal_id", "rationale"), "proposal_id")
    return p.groupBy(h.strategy_from_text(F.col("rationale")).alias("strategy")).agg(F.count("*").alias("proposals"))


def ext_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Patches by status and relay with all subtotals (grouping sets, beyond the inventory)."""
    p = _patches(spark, sf).select("status", F.coalesce("relay", F.lit("none")).alias("relay"))
    return p.cube("status", "relay").agg(F.count("*").alias("patches"), F.grouping_id().cast("int").alias("level"))


QUERIES = {f.__name__: f for f in (
    a8_stats, a6_learning, a6_issues, a7_tips, a10_recurring, u3_common_issues, w5_last_attempts, w6_similar_failures, w8_accumulated, y22_memory_context, a5_severity_counts, a5_times, a9_revert_gate,
    a15_totals, a16_failures, adj_roadmap, k3_reverted_files, k5_write_log, k8_call_log, m13_strategies, ext_cube,
)}

_A = """a AS (SELECT attempt_id, any_value(cycle_id) AS cycle_id, any_value(strategy) AS strategy, any_value(approved) AS approved, any_value(issue_types) AS issue_types, any_value(approach_summary) AS approach_summary,
 any_value(severity_counts) AS severity_counts, any_value(ts) AS ts FROM attempts GROUP BY attempt_id),
 b AS (SELECT *, coalesce(nullif(regexp_replace(lower(trim(strategy)), '[\\s-]+', '_', 'g'), ''), 'unknown') AS st, list_distinct([lower(x) for x in coalesce(issue_types, [])]) AS iss FROM a)"""
_P = "p AS (SELECT patch_id, any_value(cycle_id) AS cycle_id, any_value(iteration) AS iteration, any_value(relay) AS relay, any_value(status) AS status, any_value(confidence) AS confidence, any_value(revert_reason) AS revert_reason, any_value(has_critical_error) AS has_critical_error, any_value(original) AS original, any_value(patched) AS patched FROM patch_results GROUP BY patch_id)"
_L = "l AS (SELECT st AS strategy, count(*) FILTER (approved) AS successes, count(*) FILTER (NOT approved) AS failures FROM b GROUP BY 1), l2 AS (SELECT *, coalesce(successes / nullif(successes + failures, 0), 0.0)::DOUBLE AS rate FROM l)"
_H = "h AS (SELECT st AS strategy, issue, count(*) AS failures FROM (SELECT st, unnest(iss) AS issue FROM b WHERE NOT approved) GROUP BY 1, 2)"

SQL = {
    "a5_times": f"WITH {_A} SELECT strftime(try_cast(ts AS TIMESTAMP), '%Y-%m') AS month, count(*) AS attempts FROM b WHERE try_cast(ts AS TIMESTAMP) IS NOT NULL GROUP BY 1",
    "a8_stats": f"WITH {_A} SELECT count(*) AS total, count(*) FILTER (approved) AS approved, count(*) FILTER (NOT approved) AS rejected, (count(*) FILTER (approved) / count(*))::DOUBLE AS rate, count(DISTINCT st) AS strategies, count(DISTINCT cycle_id) AS cycles FROM b",
    "a6_learning": f"WITH {_A}, {_L} SELECT strategy, successes, failures, rate FROM l2",
    "a6_issues": f"WITH {_A}, {_H} SELECT * FROM h",
    "a7_tips": f"""WITH {_A}, {_L}, {_H}, t AS (SELECT strategy, max(failures) AS n, max_by(issue, (failures, issue)) AS issue FROM h GROUP BY 1), s AS (SELECT st AS strategy, max_by(approach_summary, attempt_id) AS done FROM b WHERE approved GROUP BY 1)
        SELECT l2.strategy, array_to_string([x for x in [CASE WHEN failures > 3 AND rate < 0.3 THEN 'low success rate' END, CASE WHEN n >= 3 THEN 'often fails with ' || issue END, CASE WHEN done IS NOT NULL THEN 'last success: ' || left(done, 80) END] if x is not null], ' | ') AS tips
        FROM l2 LEFT JOIN t USING (strategy) LEFT JOIN s USING (strategy)""",
    "a10_recurring": f"WITH {_A} SELECT cycle_id, issue, count(*) AS failures FROM (SELECT cycle_id, unnest(iss) AS issue FROM b WHERE NOT approved) GROUP BY 1, 2 HAVING count(*) >= 2",
    "u3_common_issues": f"WITH {_A}, n AS (SELECT cycle_id, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= 2) SELECT cycle_id, issue FROM (SELECT cycle_id, issue, count(*) AS k FROM (SELECT cycle_id, unnest(iss) AS issue FROM b) GROUP BY 1, 2) JOIN n USING (cycle_id) WHERE k = n",
    "w5_last_attempts": f"WITH {_A} SELECT cycle_id, attempt_id, position FROM (SELECT *, row_number() OVER (PARTITION BY cycle_id ORDER BY attempt_id DESC)::INT AS position FROM b) WHERE position <= 10",
    "w6_similar_failures": f"WITH {_A} SELECT attempt_id, cycle_id FROM b WHERE NOT approved AND list_has_any(iss, ['type_error', 'syntax']) ORDER BY attempt_id DESC LIMIT 5",
    "w8_accumulated": f"""WITH {_A} SELECT attempt_id, cycle_id, row_number() OVER w::INT AS turn, coalesce(sum(CASE WHEN NOT approved THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS failed_before,
        coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN NOT approved THEN st END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))), ','), '') AS failed_strategies FROM b WINDOW w AS (PARTITION BY cycle_id ORDER BY attempt_id)""",
    "a5_severity_counts": f"WITH {_A} SELECT lower(k) AS severity, sum(severity_counts[k])::BIGINT AS issues FROM (SELECT severity_counts, unnest(map_keys(severity_counts)) AS k FROM b) GROUP BY 1",
    "a9_revert_gate": f"WITH {_P}, g AS (SELECT *, coalesce(bool_or(coalesce(has_critical_error, false)) OVER (PARTITION BY cycle_id, iteration), false) AS revert_all FROM p) SELECT patch_id, revert_all, CASE WHEN revert_all AND status <> 'unchanged' THEN 'reverted' ELSE status END AS final_status FROM g",
    "a15_totals": f"WITH {_P} SELECT status, count(*) AS patches, round(avg(confidence), 6) AS confidence FROM p GROUP BY 1",
    "a16_failures": f"""WITH {_P}, w AS (SELECT cycle_id, coalesce(revert_reason, 'none given') AS reason, count(*) AS n FROM p WHERE status IN ('failed', 'reverted', 'partial') GROUP BY 1, 2)
        SELECT cycle_id, sum(n)::BIGINT AS failures, string_agg(reason || ' x' || n, '; ' ORDER BY n DESC, reason) AS reasons FROM w GROUP BY 1""",
    "adj_roadmap": f"""WITH {_P}, x AS (SELECT cycle_id, status IN ('applied', 'partial') AND coalesce(patched, '') <> coalesce(original, '') AS ok FROM p), y AS (SELECT cycle_id, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS partial FROM x GROUP BY 1)
        SELECT cycle_id, successes, partial, round(CASE WHEN successes > 0 THEN 0.8 * successes / (successes + partial) ELSE 0 END::DOUBLE, 6) AS confidence FROM y""",
    "k3_reverted_files": "WITH p AS (SELECT proposal_id, any_value(reverted_files) AS r FROM proposals GROUP BY 1), x AS (SELECT unnest(r, recursive := true) FROM p) SELECT reason, count(*) AS files, count(DISTINCT path) AS paths FROM x GROUP BY 1",
    "k5_write_log": "WITH f AS (SELECT file_id, any_value(cycle_id) AS cycle_id, any_value(content) AS content FROM cycle_files GROUP BY 1) SELECT cycle_id, count(*) AS files, coalesce(sum(length(content)), 0)::BIGINT AS chars FROM f GROUP BY 1",
    "k8_call_log": """WITH p AS (SELECT proposal_id, any_value(relay) AS relay, any_value(prompt) AS prompt, any_value(llm_response) AS a FROM proposals GROUP BY 1)
        SELECT relay, count(*) AS calls, count(a) AS answered, sum(length(prompt))::BIGINT AS prompt_chars, coalesce(sum(length(a)), 0)::BIGINT AS answer_chars, round(avg(length(a)), 4) AS mean_answer FROM p GROUP BY 1""",
    "m13_strategies": """WITH p AS (SELECT proposal_id, lower(coalesce(any_value(rationale), '')) AS r FROM proposals GROUP BY 1) SELECT CASE WHEN contains(r, 'interface') THEN 'interface_extraction' WHEN contains(r, 'lazy') THEN 'lazy_import'
        WHEN contains(r, 'shared') OR contains(r, 'common') THEN 'shared_module' WHEN contains(r, 'event') THEN 'event_driven' ELSE 'unknown' END AS strategy, count(*) AS proposals FROM p GROUP BY 1""",
    "y22_memory_context": f"""WITH {_A}, l AS (SELECT *, row_number() OVER (PARTITION BY cycle_id ORDER BY attempt_id DESC) AS position, list_distinct([lower(x) for x in coalesce(issue_types, [])]) AS d FROM b),
        q AS (SELECT cycle_id, position, '- ' || st || ': ' || CASE WHEN approved THEN 'approved' ELSE 'rejected' END || CASE WHEN len(issue_types) > 0 THEN ' (' || array_to_string([lower(issue_types[i]) for i in range(1, len(issue_types) + 1) if list_position([lower(z) for z in issue_types], lower(issue_types[i])) = i][:3], ', ') || ')' ELSE '' END AS line FROM l WHERE position <= 3)
        SELECT cycle_id, left(string_agg(line, chr(10) ORDER BY position DESC), 1450) AS context FROM q GROUP BY 1""",
    "ext_cube": f"WITH {_P}, q AS (SELECT status, coalesce(relay, 'none') AS relay FROM p) SELECT status, relay, count(*) AS patches, grouping_id(status, relay)::INT AS level FROM q GROUP BY CUBE (status, relay)",
}
