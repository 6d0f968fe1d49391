"""Queries over failures, feedback, budgets, memory, templates and logs, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import answers as a
from ..functions import text as t
from ..operators import context as c
from ..operators import explaining as x
from ..operators import history as h
from ..sources import readers, templates
from ..tables import clean_path, extension, load, once
from .answer_queries import _DIF
from .extra_queries import _F, _J, _P, _TOK, _bal, _note, _sql_imports


def _patches(spark: SparkSession, sf: str) -> DataFrame:
    p = once(load(spark, sf, "patch_results", "patch_id", "cycle_id", "iteration", "path", "original", "patched", "status", "warnings", "validation_issues", "revert_reason", "applied_blocks", "total_blocks", "pre_validated"), "patch_id")
    return p.withColumn("ext", extension(clean_path(F.col("path"))))


def _strategies(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "minimal_diffs", "diff_id", "cycle_id", "strategy")
    return d.groupBy("cycle_id").agg(F.min_by(h.strategy_name(F.col("strategy")), "diff_id").alias("strategy"))


def adj_p14_remaining(spark: SparkSession, sf: str) -> DataFrame:
    return x.remaining_work(_patches(spark, sf), _strategies(spark, sf))


def adj_p17_failed_files(spark: SparkSession, sf: str) -> DataFrame:
    return x.per_file(_patches(spark, sf)).select("patch_id", "attempted", "why")


def adj_p17_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return x.outcome(_patches(spark, sf), ["cycle_id", "iteration"])


def k11_failure_report(spark: SparkSession, sf: str) -> DataFrame:
    return x.failure_report(_patches(spark, sf)).select("cycle_id", F.md5("report").alias("digest"))


def x32_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """What each iteration of a cycle is told about the issues of its patches."""
    i = _patches(spark, sf).select("cycle_id", "iteration", "path", F.explode("validation_issues").alias("comment"))
    low = F.lower("comment")
    i = i.withColumn("kind", F.when(low == "syntax", "syntax").when(low.contains("cycle"), "cycle").otherwise("other"))
    return x.feedback(i, ["cycle_id", "iteration"]).select("cycle_id", "iteration", F.md5("feedback").alias("digest"))


def _reverted(spark: SparkSession, sf: str) -> DataFrame:
    p = once(load(spark, sf, "proposals", "proposal_id", "cycle_id", "iteration", "reverted_files"), "proposal_id")
    return p.select("cycle_id", "iteration", F.inline("reverted_files"))


def _issues(spark: SparkSession, sf: str) -> DataFrame:
    return x.rule_issues(_patches(spark, sf), load(spark, sf, "cycle_files", "cycle_id", "path"), _reverted(spark, sf))


def a17_issues(spark: SparkSession, sf: str) -> DataFrame:
    """What the rules find wrong with patches, by kind."""
    return _issues(spark, sf).groupBy(F.regexp_replace("comment", r"^reverted: .*", "reverted").alias("issue"), "severity").agg(F.count("*").alias("times"))


def u5_issue_union(spark: SparkSession, sf: str) -> DataFrame:
    """The rules' issues and those that attempts reported, which are major unless told otherwise."""
    r = _issues(spark, sf).select(F.lit("rules").alias("source"), "severity")
    n = once(load(spark, sf, "attempts", "attempt_id", "issue_types"), "attempt_id").select(F.lit("reported").alias("source"), F.explode("issue_types").alias("i")).select("source", F.lit("major").alias("severity"))
    return r.unionByName(n).groupBy("source", "severity").agg(F.count("*").alias("issues"))


def u6_repeated_mistakes(spark: SparkSession, sf: str) -> DataFrame:
    return x.repeated_mistakes(_patches(spark, sf))


def adj_p15_explanation(spark: SparkSession, sf: str) -> DataFrame:
    nodes = once(load(spark, sf, "cycle_jobs", "cycle_id", "graph"), "cycle_id").select("cycle_id", F.col("graph.nodes").alias("nodes"))
    return x.diff_explanation(_patches(spark, sf), nodes)


def adj_p16_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Each attempt of a cycle as a line of its failure: turn, outcome, issues, and its summary cut at 200."""
    a_ = once(load(spark, sf, "attempts", "attempt_id", "cycle_id", "approved", "issue_types", "approach_summary"), "attempt_id")
    turn = F.row_number().over(W.partitionBy("cycle_id").orderBy("attempt_id"))
    return a_.select("attempt_id", turn.alias("turn"), F.coalesce("approved", F.lit(False)).alias("approved"), F.size(F.coalesce("issue_types", F.array().cast("array<string>"))).alias("issues"), F.left(F.coalesce("approach_summary", F.lit("")), F.lit(200)).alias("summary"))


def adj_p16_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Up to five distinct issues of a cycle, out of the first three of each attempt."""
    i = load(spark, sf, "attempts", "cycle_id", "issue_types").select("cycle_id", F.explode(F.slice("issue_types", 1, 3)).alias("issue")).distinct()
    return i.withColumn("pos", F.row_number().over(W.partitionBy("cycle_id").orderBy("issue"))).where("pos <= 5")


def adj_p13_roadmap(spark: SparkSession, sf: str) -> DataFrame:
    """How sure a cycle's roadmap is: its strategy's confidence, or with a success 0.8 of the share of successes if that is more."""
    d = load(spark, sf, "minimal_diffs", "cycle_id", "confidence").groupBy("cycle_id").agg(F.max("confidence").alias("base"))
    r = h.roadmap(_patches(spark, sf)).join(d, "cycle_id", "left")
    base = F.coalesce("base", F.lit(0.0))
    return r.select("cycle_id", "successes", "partial", F.round(F.when(F.col("successes") > 0, F.greatest(base, F.col("confidence"))).otherwise(base), 6).alias("confidence"))


def a19_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Each cycle's file tokens against the file share of a refactoring prompt of 8,192; what its examples leave unused goes to the files."""
    share = {part: n for stage, part, n in c.budget(8192) if stage == "refactor"}
    n = t.estimated_tokens(F.col("content"), t.lookup(F.col("ext"), t.CONTENT_TYPES, "code_generic"))
    f = load(spark, sf, "cycle_files", "file_id", "cycle_id", "path", "content").withColumn("ext", extension(clean_path(F.col("path"))))
    used = once(f.select("file_id", "cycle_id", n.alias("n")), "file_id").groupBy("cycle_id").agg(F.sum("n").alias("used"))
    left = F.greatest(F.lit(0), share["file"] - F.col("used"))
    return used.select("cycle_id", "used", left.cast("bigint").alias("remaining"), F.greatest(F.lit(0), share["file"] + share["examples"] - F.col("used")).cast("bigint").alias("with_examples"))


def a20_last_results(spark: SparkSession, sf: str) -> DataFrame:
    """The last result of each path of a cycle."""
    p = load(spark, sf, "patch_results", "patch_id", "cycle_id", "iteration", "path", "status").where("path is not null")
    return p.groupBy("cycle_id", "path").agg(F.max_by("status", F.struct("iteration", "patch_id")).alias("status"))


def w10_call_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The newest three calls of each cycle's log, in their order."""
    p = once(load(spark, sf, "proposals", "proposal_id", "cycle_id", "relay"), "proposal_id")
    head = F.concat(F.lit("LLM CALL | Agent: "), F.coalesce("relay", F.lit("unknown")), F.lit(" | Stage: refactor | ID: "), F.col("proposal_id").cast("string"), F.lit("\nbody\n"))
    log = p.groupBy("cycle_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("proposal_id", head.alias("h")))), lambda y: y["h"]), "\n========\n").alias("log"))
    return readers.newest_calls(log, "cycle_id", "log", 3).select("cycle_id", "kind", "agent", "stage", "id")


def s10_recent(spark: SparkSession, sf: str) -> DataFrame:
    """What a memory keeps of all attempts: the last 50."""
    return h.recent(once(load(spark, sf, "attempts", "attempt_id", "cycle_id", "strategy"), "attempt_id"), 50).select("attempt_id", "cycle_id")


def s11_tails(spark: SparkSession, sf: str) -> DataFrame:
    """The last 200 characters of each document."""
    d = load(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.md5(readers.tail(F.col("text"), 200)).alias("digest"))


TEMPLATE = "Cycle {cycle_id} ({severity}): {nodes}. {unknown} {{json}}"


def adj_p22_filled(spark: SparkSession, sf: str) -> DataFrame:
    j = once(load(spark, sf, "cycle_jobs", "cycle_id", "graph", "severity"), "cycle_id")
    return j.select("cycle_id", templates.filled(F.lit(TEMPLATE), {"cycle_id": F.col("cycle_id"), "severity": F.col("severity"), "nodes": F.array_join("graph.nodes", ", ")}).alias("text"))


def adj_p22_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    """Names in braces that files hold."""
    f = once(load(spark, sf, "cycle_files", "file_id", "content").select("file_id", templates.placeholders(F.col("content")).alias("p")), "file_id")
    return f.select(F.explode("p").alias("name")).groupBy("name").agg(F.count("*").alias("files"))


def m20_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """What was learned about one strategy."""
    return h.learning(once(load(spark, sf, "attempts", "attempt_id", "strategy", "approved"), "attempt_id")).where(F.col("strategy") == "interface_extraction")


def m20_cleared(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts per project after one cycle's session was cleared."""
    a_ = once(load(spark, sf, "attempts", "attempt_id", "cycle_id", "project"), "attempt_id")
    first = a_.agg(F.min("cycle_id")).first()[0]  # the key to clear
    return h.without_cycle(a_, first).groupBy("project").agg(F.count("*").alias("attempts"))


def m14_severities(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an iteration's issues have a critical or a major one."""
    has = lambda s: F.max(F.col("severity") == s)
    return _issues(spark, sf).groupBy("cycle_id", "iteration").agg(has("critical").alias("has_critical"), has("major").alias("has_major"))


def m23_chars(spark: SparkSession, sf: str) -> DataFrame:
    """Budgets in tokens as characters, by kind of content."""
    rows = [(stage, part, n, kind, cpt) for stage, part, n in c.budget(8192) for kind, cpt in t.CHARS_PER_TOKEN.items()]
    b = spark.createDataFrame(rows, "stage string, part string, tokens bigint, content string, cpt double")
    return b.select("stage", "part", "content", F.floor(F.col("tokens") * F.col("cpt")).alias("chars"))


def y25_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Success among attempts that were decided, per cycle, 0 without any; and how many there are."""
    a_ = once(load(spark, sf, "attempts", "attempt_id", "cycle_id", "approved"), "attempt_id")
    g = a_.groupBy("cycle_id").agg(F.count("*").alias("attempts"), F.count("approved").alias("n"), F.sum(F.when(F.col("approved"), 1).otherwise(0)).alias("s"))
    return g.select("cycle_id", "attempts", F.round(F.coalesce(F.try_divide(F.col("s"), F.col("n")), F.lit(0.0)), 6).alias("rate"))


def m5_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Minimal diffs applied to the first place of their first search text in the file they name; how long the result is."""
    schema = "struct<patch: struct<path: string, search_replace: array<struct<search: string, replace: string>>>>"
    d = load(spark, sf, "minimal_diffs", "diff_id", "cycle_id", "raw_llm_response").select("diff_id", "cycle_id", F.from_json(a.payload(F.col("raw_llm_response")), schema).alias("j"))
    d = once(d.select("diff_id", "cycle_id", F.col("j.patch.path").alias("path"), F.get(F.col("j.patch.search_replace"), F.lit(0)).alias("sr")).where("path is not null and sr.search <> ''"), "diff_id")
    f = load(spark, sf, "cycle_files", "cycle_id", clean_path(F.col("path")).alias("path"), "content", "file_id").groupBy("cycle_id", "path").agg(F.min_by("content", "file_id").alias("content"))
    j = d.join(f, ["cycle_id", "path"])
    at = F.instr("content", F.col("sr.search"))
    new = F.concat(F.left("content", at - 1), F.coalesce("sr.replace", F.lit("")), F.substring("content", at + F.length("sr.search"), F.length("content")))
    return j.select("diff_id", (at > 0).alias("found"), F.when(at > 0, F.md5(new)).alias("digest"))


QUERIES = {f.__name__: f for f in (
    adj_p14_remaining, adj_p17_failed_files, adj_p17_outcomes, k11_failure_report, x32_feedback, a17_issues, u5_issue_union, u6_repeated_mistakes, adj_p15_explanation, adj_p16_attempts, adj_p16_issues, adj_p13_roadmap, a19_ledger, a20_last_results, w10_call_blocks, s10_recent, s11_tails,
    adj_p22_filled, adj_p22_placeholders, m20_lookup, m20_cleared, m14_severities, m23_chars, y25_rates, m5_applied,
)}

# ----------------------------------------------------------------------------------------------------------- SQL
_PX = "px AS (SELECT *, CASE WHEN contains(cp, '.') THEN lower(regexp_extract(cp, '\\.([^.]*)$', 1)) WHEN cp IS NOT NULL THEN '' END AS ext FROM (SELECT patch_id, any_value(cycle_id) AS cycle_id, any_value(iteration) AS iteration, any_value(path) AS path, regexp_replace(replace(any_value(path), '\\', '/'), '^(\\./)+', '') AS cp, any_value(original) AS original, any_value(patched) AS patched, any_value(status) AS status, any_value(warnings) AS warnings, any_value(validation_issues) AS vi, any_value(revert_reason) AS rr, any_value(applied_blocks) AS ab, any_value(total_blocks) AS tb, any_value(pre_validated) AS pv FROM patch_results GROUP BY 1))"
_ATT = "att AS (SELECT attempt_id, any_value(cycle_id) AS cycle_id, any_value(project) AS project, any_value(strategy) AS strategy, any_value(approved) AS approved, any_value(issue_types) AS it, any_value(approach_summary) AS sm FROM attempts GROUP BY 1)"
_W3 = "nullif(array_to_string({l}[:3], '; '), '')"
_PF = f"pf AS (SELECT patch_id, cycle_id, iteration, coalesce(path, '?') AS path, status, CASE WHEN tb > 0 THEN ab || ' of ' || tb || ' blocks found their place' ELSE 'nothing could be applied' END AS attempted, coalesce({_W3.replace('{l}', 'warnings')}, nullif(rr, ''), {_W3.replace('{l}', 'vi')}, 'unknown') AS why FROM px WHERE status IN ('failed', 'reverted', 'partial'))"


def _outcome(keys: str) -> str:
    return f"SELECT {keys}, count(*) AS total, count(*) FILTER (status IN ('failed', 'reverted')) AS failed, count(*) FILTER (status = 'partial') AS partial, CASE WHEN count(*) FILTER (status IN ('failed', 'reverted')) = count(*) THEN 'all ' || count(*) || ' failed' WHEN count(*) FILTER (status = 'partial') > 0 THEN count(*) FILTER (status IN ('failed', 'reverted')) || ' failed, ' || count(*) FILTER (status = 'partial') || ' in part' ELSE count(*) FILTER (status IN ('failed', 'reverted')) || ' of ' || count(*) || ' failed' END AS summary FROM px GROUP BY {keys}"


_BR = [*t.PAIRS, ("<", ">")]
_ON = lambda p: f"({_bal('patched', *p)} <> 0" + (f" AND ext IN {t.ANGLED})" if p[0] == "<" else ")")
_REV = "rv0 AS (SELECT proposal_id, any_value(cycle_id) AS cycle_id, any_value(iteration) AS iteration, any_value(reverted_files) AS r FROM proposals GROUP BY 1), rv AS (SELECT cycle_id, iteration, y.path AS path, y.reason AS reason FROM (SELECT cycle_id, iteration, unnest(r) AS y FROM rv0))"
_ISS = rf"""{_PX}, {_F}, {_REV}, kn AS (SELECT DISTINCT cycle_id, regexp_extract(path, '([^/\\]*)$', 1) AS b FROM cycle_files WHERE path IS NOT NULL), rs AS (SELECT * FROM px WHERE path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rv WHERE rv.cycle_id = px.cycle_id AND rv.iteration = px.iteration AND rv.path = px.path)),
 iss AS (SELECT cycle_id, iteration, 'reverted: ' || coalesce(reason, '') AS comment, 'major' AS severity FROM rv UNION ALL SELECT cycle_id, iteration, 'unknown file', 'major' FROM rs WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.cycle_id = rs.cycle_id AND kn.b = regexp_extract(rs.path, '([^/\\]*)$', 1)) UNION ALL SELECT cycle_id, iteration, 'empty', 'critical' FROM rs WHERE coalesce(patched, '') = ''
 UNION ALL SELECT cycle_id, iteration, 'no change', 'minor' FROM rs WHERE coalesce(patched, '') = coalesce(original, '') UNION ALL SELECT cycle_id, iteration, 'note: ' || lower(n), 'minor' FROM (SELECT cycle_id, iteration, unnest(vi) AS n FROM rs WHERE coalesce(patched, '') <> coalesce(original, '') AND coalesce(pv, false)) WHERE NOT contains(lower(n), 'critical')
 {" ".join(f"UNION ALL SELECT cycle_id, iteration, 'unbalanced {a_}{b_}', 'critical' FROM rs WHERE patched <> '' AND patched <> coalesce(original, '') AND NOT coalesce(pv, false) AND {_ON((a_, b_))}" for a_, b_ in _BR)} UNION ALL SELECT cycle_id, iteration, 'cut', 'critical' FROM rs WHERE patched <> '' AND patched <> coalesce(original, '') AND NOT coalesce(pv, false) AND {_note('patched')} IS NOT NULL)"""
_FILL = lambda s: "'" + s.replace("{p}", "' || path || '") + "'"
_NAMES = lambda col, w: rf"list_distinct(regexp_extract_all(coalesce({col}, ''), '\b{w}\s+(\w+)', 1))"
_NEW = lambda w: f"[y for y in {_NAMES('patched', w)} if not list_contains({_NAMES('original', w)}, y)]"
_SHARE = {part: n for stage, part, n in c.budget(8192) if stage == "refactor"}
_KIND = "CASE WHEN status NOT IN ('failed', 'reverted', 'partial') THEN NULL WHEN status <> 'reverted' AND coalesce(original, '') = coalesce(patched, '') AND length(original) > 0 THEN 'no_op' WHEN ab < tb THEN 'search_mismatch' WHEN contains(lower(array_to_string(coalesce(vi, []), ' ')), 'syntax') THEN 'syntax' WHEN array_to_string(coalesce(vi, []), ' ') <> '' THEN 'validation' ELSE 'unknown' END"
SQL = {
    "adj_p14_remaining": f"WITH {_PX}, {_DIF}, k AS (SELECT cycle_id, {_KIND} AS k, coalesce(path, '?') AS path, status IN ('applied', 'partial') AND coalesce(original, '') <> coalesce(patched, '') AS ok FROM px), st AS (SELECT cycle_id, arg_min(coalesce(nullif(regexp_replace(lower(trim(strategy)), '[\\s-]+', '_', 'g'), ''), 'unknown'), diff_id) AS strategy FROM minimal_diffs GROUP BY 1), no AS (SELECT cycle_id FROM k GROUP BY 1 HAVING NOT bool_or(ok)) SELECT DISTINCT cycle_id, CASE k " + " ".join(f"WHEN '{kk}' THEN {_FILL(v)}" for kk, v in x.FIXES.items()) + f" ELSE {_FILL(x.OTHER_FIX)} END AS item FROM k WHERE k IS NOT NULL" + "".join(f" UNION SELECT cycle_id, '{v}' FROM no JOIN st USING (cycle_id) WHERE strategy = '{kk}'" for kk, vs in x.STEPS.items() for v in vs),
    "adj_p17_failed_files": f"WITH {_PX}, {_PF} SELECT patch_id, attempted, why FROM pf",
    "adj_p17_outcomes": f"WITH {_PX} {_outcome('cycle_id, iteration')}",
    "k11_failure_report": f"WITH {_PX}, {_PF}, oc AS ({_outcome('cycle_id')}), g AS (SELECT cycle_id, string_agg('### `' || path || '` (' || status || ')' || chr(10) || 'Tried: ' || attempted || chr(10) || 'Why: ' || why, chr(10) ORDER BY path, patch_id) AS l FROM pf GROUP BY 1) SELECT cycle_id, md5('# Failed: ' || cycle_id || chr(10) || chr(10) || summary || chr(10) || chr(10) || '## Files' || chr(10) || l) AS digest FROM g JOIN oc USING (cycle_id)",
    "x32_feedback": f"WITH {_PX}, i AS (SELECT cycle_id, iteration, coalesce(path, '?') AS path, unnest(vi) AS comment FROM px), k AS (SELECT *, CASE WHEN lower(comment) = 'syntax' THEN 'syntax' WHEN contains(lower(comment), 'cycle') THEN 'cycle' ELSE 'other' END AS k FROM i), n AS (SELECT *, CASE k WHEN 'syntax' THEN 0 WHEN 'cycle' THEN 1 ELSE 2 END AS r, CASE k WHEN 'cycle' THEN 3 ELSE 5 END AS most, count(*) OVER (PARTITION BY cycle_id, iteration, k) AS n, row_number() OVER (PARTITION BY cycle_id, iteration, k ORDER BY path, comment) AS pos FROM k), s AS (SELECT cycle_id, iteration, r, '### ' || k || chr(10) || string_agg('- ' || CASE WHEN k = 'cycle' THEN comment ELSE path || ': ' || comment END, chr(10) ORDER BY pos) || CASE WHEN n > most THEN chr(10) || '- and ' || (n - most) || ' more' ELSE '' END AS s FROM n WHERE pos <= most GROUP BY cycle_id, iteration, k, r, n, most) SELECT cycle_id, iteration, md5(string_agg(s, chr(10) || chr(10) ORDER BY r)) AS digest FROM s GROUP BY 1, 2",
    "a17_issues": f"WITH {_ISS} SELECT CASE WHEN starts_with(comment, 'reverted: ') THEN 'reverted' ELSE comment END AS issue, severity, count(*) AS times FROM iss GROUP BY 1, 2",
    "u5_issue_union": f"WITH {_ISS}, {_ATT}, u AS (SELECT 'rules' AS source, severity FROM iss UNION ALL SELECT 'reported', 'major' FROM (SELECT unnest(it) FROM att)) SELECT source, severity, count(*) AS issues FROM u GROUP BY 1, 2",
    "u6_repeated_mistakes": f"WITH {_PX}, q AS (SELECT cycle_id, iteration, path, status, {_note('patched')} IS NOT NULL AS cut, CASE WHEN coalesce(patched, '') = '' THEN 0 ELSE {' + '.join(_ON(p_) + '::INT' for p_ in _BR)} + ({_note('patched')} IS NOT NULL)::INT END AS n FROM px), g AS (SELECT cycle_id, iteration, bool_or(cut) AS cut, sum(n) AS n FROM q GROUP BY 1, 2) SELECT cycle_id, iteration, 'whole files were cut' AS mistake FROM g WHERE cut UNION ALL SELECT cycle_id, iteration, 'three syntax issues and more' FROM g WHERE n >= 3 UNION ALL SELECT DISTINCT cycle_id, iteration, 'the same files fail again' FROM q WHERE status IN ('failed', 'reverted') AND EXISTS (SELECT 1 FROM q o WHERE o.cycle_id = q.cycle_id AND o.iteration + 1 = q.iteration AND o.path = q.path AND o.status = 'reverted')",
    "adj_p15_explanation": f"WITH {_PX}, {_J}, q AS (SELECT cycle_id, path, {_NEW('interface')} AS i, {_NEW('class')} AS c, len([y for y in {_sql_imports('original')} if not list_contains({_sql_imports('patched')}, y)]) AS g FROM px WHERE patched <> '' AND patched <> coalesce(original, '')), r AS (SELECT cycle_id, array_to_string(list_sort(list_distinct(flatten(list(i))))[:2], ', ') AS i, array_to_string(list_sort(list_distinct(flatten(list(c))))[:2], ', ') AS c, sum(g) AS g, count(DISTINCT path) AS files FROM q GROUP BY 1), s AS (SELECT cycle_id, files, CASE WHEN i <> '' THEN 'interface extraction (' || i || ')' WHEN c <> '' THEN 'class extraction (' || c || ')' WHEN g > 0 THEN 'dependency removal' ELSE 'code modification' END AS pattern FROM r) SELECT cycle_id, pattern, CASE WHEN length('Break cycle via ' || pattern) > 60 THEN 'Break ' || array_to_string(graph.nodes[:2], ' ↔ ') || ' cycle' ELSE 'Break cycle via ' || pattern END AS title, files FROM s JOIN j USING (cycle_id)",
    "adj_p16_attempts": f"WITH {_ATT} SELECT attempt_id, row_number() OVER (PARTITION BY cycle_id ORDER BY attempt_id)::INT AS turn, coalesce(approved, false) AS approved, coalesce(len(it), 0)::INT AS issues, coalesce(sm, '')[:200] AS summary FROM att",
    "adj_p16_issues": "WITH i AS (SELECT DISTINCT cycle_id, unnest(issue_types[:3]) AS issue FROM attempts) SELECT * FROM (SELECT cycle_id, issue, row_number() OVER (PARTITION BY cycle_id ORDER BY issue)::INT AS pos FROM i) WHERE pos <= 5",
    "adj_p13_roadmap": f"WITH {_PX}, g AS (SELECT cycle_id, count(*) FILTER (status IN ('applied', 'partial') AND coalesce(patched, '') <> coalesce(original, '')) AS s, count(*) AS n FROM px GROUP BY 1), d AS (SELECT cycle_id, max(confidence) AS base FROM minimal_diffs GROUP BY 1) SELECT cycle_id, s AS successes, n - s AS partial, round((CASE WHEN s > 0 THEN greatest(coalesce(base, 0.0), 0.8 * s / n) ELSE coalesce(base, 0.0) END)::DOUBLE, 6) AS confidence FROM g LEFT JOIN d USING (cycle_id)",
    "a19_ledger": f"WITH {_F}, u AS (SELECT cycle_id, sum({_TOK})::BIGINT AS used FROM f GROUP BY 1) SELECT cycle_id, used, greatest(0, {_SHARE['file']} - used)::BIGINT AS remaining, greatest(0, {_SHARE['file'] + _SHARE['examples']} - used)::BIGINT AS with_examples FROM u",
    "a20_last_results": "SELECT cycle_id, path, arg_max(status, (iteration, patch_id)) AS status FROM patch_results WHERE path IS NOT NULL GROUP BY 1, 2",
    "w10_call_blocks": "WITH p AS (SELECT proposal_id, any_value(cycle_id) AS cycle_id, any_value(relay) AS relay FROM proposals GROUP BY 1) SELECT cycle_id, 'CALL' AS kind, coalesce(relay, 'unknown') AS agent, 'refactor' AS stage, proposal_id::VARCHAR AS id FROM (SELECT *, row_number() OVER (PARTITION BY cycle_id ORDER BY proposal_id DESC) AS r FROM p) WHERE r <= 3",
    "s10_recent": f"WITH {_ATT} SELECT attempt_id, cycle_id FROM att ORDER BY attempt_id DESC LIMIT 50",
    "s11_tails": "SELECT doc_id, md5(right(text, 200)) AS digest FROM documents",
    "adj_p22_filled": f"WITH {_J} SELECT cycle_id, 'Cycle ' || cycle_id || ' (' || coalesce(severity, '') || '): ' || array_to_string(graph.nodes, ', ') || '. {{unknown}} {{{{json}}}}' AS text FROM j",
    "adj_p22_placeholders": rf"WITH {_F}, q AS (SELECT file_id, unnest(list_distinct(regexp_extract_all(c, '\{{(\w+)\}}', 1))) AS name FROM f) SELECT name, count(*) AS files FROM q GROUP BY 1",
    "m20_lookup": rf"WITH {_ATT}, s AS (SELECT coalesce(nullif(regexp_replace(lower(trim(strategy)), '[\s-]+', '_', 'g'), ''), 'unknown') AS strategy, approved FROM att) SELECT strategy, count(*) FILTER (approved) AS successes, count(*) FILTER (NOT approved) AS failures, coalesce(count(*) FILTER (approved) / nullif(count(approved), 0), 0.0)::DOUBLE AS rate FROM s WHERE strategy = 'interface_extraction' GROUP BY 1",
    "m20_cleared": f"WITH {_ATT} SELECT project, count(*) AS attempts FROM att WHERE cycle_id <> (SELECT min(cycle_id) FROM att) GROUP BY 1",
    "m14_severities": f"WITH {_ISS} SELECT cycle_id, iteration, bool_or(severity = 'critical') AS has_critical, bool_or(severity = 'major') AS has_major FROM iss GROUP BY 1, 2",
    "m23_chars": "SELECT stage, part, content, floor(tokens * cpt)::BIGINT AS chars FROM (VALUES " + ", ".join(f"('{s}', '{p_}', {n})" for s, p_, n in c.budget(8192)) + ") b(stage, part, tokens), (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in t.CHARS_PER_TOKEN.items()) + ") k(content, cpt)",
    "y25_rates": f"WITH {_ATT} SELECT cycle_id, count(*) AS attempts, round(coalesce(count(*) FILTER (approved) / nullif(count(approved), 0), 0.0)::DOUBLE, 6) AS rate FROM att GROUP BY 1",
    "m5_applied": f"WITH {_DIF}, {_F}, q AS (SELECT diff_id, cycle_id, j->>'$.patch.path' AS path, j->>'$.patch.search_replace[0].search' AS s, coalesce(j->>'$.patch.search_replace[0].replace', '') AS r FROM d WHERE j IS NOT NULL), g AS (SELECT cycle_id, cp AS path, arg_min(content, file_id) AS content FROM f GROUP BY 1, 2) SELECT diff_id, instr(content, s) > 0 AS found, CASE WHEN instr(content, s) > 0 THEN md5(content[:instr(content, s) - 1] || r || content[instr(content, s) + length(s):]) END AS digest FROM q JOIN g USING (cycle_id, path) WHERE s <> ''",
}
