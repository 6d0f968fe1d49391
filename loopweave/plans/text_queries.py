"""Queries over files, patches, answers and vectors, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import context as c
from ..operators import graph as g
from ..operators import patching as p
from ..operators import retrieval as r
from ..operators import rules
from ..tables import clean_path, extension, load, once, project


def _raw_files(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "cycle_files", "file_id", "cycle_id", "project", "ord", "path", "content").withColumn("ext", extension(clean_path(F.col("path"))))


def _files(spark: SparkSession, sf: str, *columns) -> DataFrame:
    return project(_raw_files(spark, sf), "file_id", *columns)


def _raw_patches(spark: SparkSession, sf: str) -> DataFrame:
    q = load(spark, sf, "patch_results", "patch_id", "cycle_id", "iteration", "path", "original", "patched", "diff", "status", "warnings", "validation_issues", "revert_reason")
    return q.withColumn("ext", extension(clean_path(F.col("path"))))


def _patches(spark: SparkSession, sf: str, *columns) -> DataFrame:
    return project(_raw_patches(spark, sf), "patch_id", *columns)


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    """The changes that answers propose; a re-delivered answer proposes the same ones again."""
    a = load(spark, sf, "proposals", "proposal_id", "cycle_id", "llm_response")
    return p.changes(a, ["cycle_id", "proposal_id"], "llm_response").dropDuplicates(["proposal_id", "pos"])


def x2_brackets(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf, "file_id", t.bracket_issues(F.col("content"), F.col("ext")).alias("b")).select("file_id", F.inline("b"))


def x3_truncation(spark: SparkSession, sf: str) -> DataFrame:
    return _patches(spark, sf, "patch_id", t.truncation_note(F.col("patched")).alias("note")).where("note is not null")


def f13_marked(spark: SparkSession, sf: str) -> DataFrame:
    return _patches(spark, sf, "patch_id", t.marked_truncated(F.col("patched")).alias("marked")).where("marked").select("patch_id")


def f8_change_kind(spark: SparkSession, sf: str) -> DataFrame:
    return _patches(spark, sf, "patch_id", t.change_kind(F.col("original"), F.col("patched")).alias("change")).groupBy("change").agg(F.count("*").alias("patches"))


def w7_duplicate_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _patches(spark, sf, "patch_id", t.duplicate_line(F.col("patched"), F.col("original")).alias("line")).where("line is not null")


def x12_categories(spark: SparkSession, sf: str) -> DataFrame:
    i = _patches(spark, sf, "patch_id", "validation_issues").select(F.explode("validation_issues").alias("issue"))
    return i.groupBy(t.issue_severity(F.regexp_replace("issue", "_", " ")).alias("severity")).agg(F.count("*").alias("issues"))


def x17_imports(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf, "file_id", t.imports(F.col("content"), F.col("ext")).alias("m")).select("file_id", F.explode("m").alias("module"))


def u2_import_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Imports that a patch adds or drops."""
    q = project(_raw_patches(spark, sf).where("patched <> ''"), "patch_id", "patch_id", t.imports(F.col("original"), F.col("ext")).alias("a"), t.imports(F.col("patched"), F.col("ext")).alias("b"))
    return q.select("patch_id", F.array_join(F.array_except("b", "a"), ",").alias("added"), F.array_join(F.array_except("a", "b"), ",").alias("dropped")).where("added <> '' or dropped <> ''")


def x22_types(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf, "file_id", t.defined_types(F.col("content")).alias("n")).select("file_id", F.explode("n").alias("name"))


def u7_unknown_types(spark: SparkSession, sf: str) -> DataFrame:
    """Interface names (I and a capital) that a patch brings in and nothing in the original has."""
    rx = F.lit(r"\bI[A-Z][A-Za-z0-9]*\b")
    q = _patches(spark, sf, "patch_id", F.array_except(F.regexp_extract_all(F.coalesce("patched", F.lit("")), rx, F.lit(0)), F.regexp_extract_all(F.coalesce("original", F.lit("")), rx, F.lit(0))).alias("n"))
    return q.select("patch_id", F.explode("n").alias("name"))


def a11_language(spark: SparkSession, sf: str) -> DataFrame:
    """The language of each cycle: that of most of its files, ties to the first in order."""
    f = _files(spark, sf, "file_id", "cycle_id", t.lookup(F.col("ext"), t.LANGUAGES, "unknown").alias("language")).groupBy("cycle_id", "language").agg(F.count("*").alias("n"))
    return f.groupBy("cycle_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "language")).alias("m")).select("cycle_id", "m.language")


def a12_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that a stored diff adds and removes."""
    lines = F.split("diff", "\n")
    count = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3))).cast("bigint")
    return project(_raw_patches(spark, sf).where("diff is not null"), "patch_id", "patch_id", count("+").alias("added"), count("-").alias("removed"))


def x28_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf, "file_id", t.estimated_tokens(F.col("content"), t.lookup(F.col("ext"), t.CONTENT_TYPES, "code_generic")).alias("tokens"))


def x29_cut(spark: SparkSession, sf: str) -> DataFrame:
    f = _raw_files(spark, sf).where("ext = 'py'")
    return project(f, "file_id", "file_id", F.md5(F.coalesce(t.cut_to_tokens(F.col("content"), 300, "code_python"), F.lit(""))).alias("digest"))


def y21_budgets(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(c.budget(4096), "stage string, part string, tokens int")


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf, "file_id", "cycle_id", "ord", F.length("content").alias("n"))


def w1_whole_files(spark: SparkSession, sf: str) -> DataFrame:
    return c.whole_files(_sizes(spark, sf), "cycle_id", "file_id", F.col("n"), 12000, 8000).select("cycle_id", "file_id", "used")


def w2_packed(spark: SparkSession, sf: str) -> DataFrame:
    return c.packed(_sizes(spark, sf), "cycle_id", ["ord", "file_id"], F.coalesce("n", F.lit(0)), 6000).select("cycle_id", "file_id", "given")


def w9_budgets(spark: SparkSession, sf: str) -> DataFrame:
    return c.proportional(_sizes(spark, sf), "cycle_id", F.floor(F.coalesce("n", F.lit(0)) / 100), 20000).select("cycle_id", "file_id", "budget")


def w3_islands(spark: SparkSession, sf: str) -> DataFrame:
    # ranges of a re-delivered file merge with those of the first
    return c.interesting_lines(_raw_files(spark, sf), "file_id", "content", r"^\s*(import|from|using|export class|class|public class)\b", 1, 2)


def o3_file_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a cycle by priority: named by an edge's end, connections, size, position."""
    f = _files(spark, sf, "file_id", "cycle_id", "ord", "path", F.length(F.coalesce("content", F.lit(""))).alias("n")).where("path is not null")
    stem = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(clean_path(F.col("path")), r"([^/]*)$", 1), r"\.[^.]*$", ""), "[-_]", ""))
    deg = g.degrees(g.job_edges(once(load(spark, sf, "cycle_jobs"), "cycle_id")), "cycle_id").withColumn("_stem", F.lower("node"))
    j = f.withColumn("_stem", stem).join(deg, ["cycle_id", "_stem"], "left")
    issue = F.lit(False)
    s = c.file_score(F.col("node").isNotNull(), issue, F.col("n"), F.col("in_degree"), F.col("out_degree"), F.col("ord") == 0)
    return j.select("cycle_id", "file_id", s.cast("int").alias("score"))


def adj_numbered(spark: SparkSession, sf: str) -> DataFrame:
    return project(_raw_files(spark, sf).where("content <> ''"), "file_id", "file_id", F.md5(c.numbered(F.col("content"))).alias("digest"))


def w13_head_tail(spark: SparkSession, sf: str) -> DataFrame:
    return project(_raw_files(spark, sf).where("content is not null"), "file_id", "file_id", F.md5(c.head_and_tail(F.col("content"))).alias("digest"))


def j12_failure_patterns(spark: SparkSession, sf: str) -> DataFrame:
    m = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.coalesce("validation_issues", F.array().cast("array<string>")), F.array_compact(F.array("revert_reason")))
    return _patches(spark, sf, "patch_id", rules.failure_patterns(m).alias("m")).select(F.explode("m").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("patches"))


def j13_unbreakable(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import history as h

    tried = once(load(spark, sf, "attempts", "attempt_id", "cycle_id", "issue_types"), "attempt_id")
    nodes = load(spark, sf, "cycle_jobs", "cycle_id", "graph").select("cycle_id", F.explode("graph.nodes").alias("node"))
    return rules.unbreakable(_raw_files(spark, sf), "cycle_id", id_col="file_id", repeated=rules.coupled(h.common_issues(tried), "cycle_id"), external=rules.external_nodes(nodes, "cycle_id"))


def x35_layers(spark: SparkSession, sf: str) -> DataFrame:
    f = _raw_files(spark, sf).where("path is not null").groupBy("cycle_id").agg(F.collect_set("path").alias("paths"))
    return f.select("cycle_id", rules.layer_violation(F.col("paths")).alias("violation")).where("violation is not null")


def x31_strategy(spark: SparkSession, sf: str) -> DataFrame:
    j = once(load(spark, sf, "cycle_jobs", "cycle_id", "summary"), "cycle_id")
    return j.groupBy(F.coalesce(rules.first_rule(F.col("summary"), rules.STRATEGIES), F.lit("none")).alias("strategy")).agg(F.count("*").alias("jobs"))


def f10_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf, "file_id", t.is_placeholder_free_path(F.col("path")).alias("usable")).groupBy("usable").agg(F.count("*").alias("files"))


def y7_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).select("proposal_id", "pos", "path", "kind")


def x44_applied(spark: SparkSession, sf: str) -> DataFrame:
    f = _raw_files(spark, sf).groupBy("cycle_id", "path").agg(F.min_by("content", "file_id").alias("content"))
    return p.applied(_changes(spark, sf), f, ["cycle_id", "proposal_id"]).select("proposal_id", "path", "kind", "applied", F.round("confidence", 4).alias("confidence"), "note")


def x10_diffs(spark: SparkSession, sf: str) -> DataFrame:
    return project(p.diffs(_raw_patches(spark, sf)), "patch_id", "patch_id", "added", "removed", "kept", F.md5("diff").alias("digest"))


def x41_repairs(spark: SparkSession, sf: str) -> DataFrame:
    """Patched scripts that a repair changes."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            got = [(i, *p.repair(x)) for i, x in zip(pdf["patch_id"], pdf["patched"], strict=True)]
            yield pd.DataFrame([(i, ",".join(n), s) for i, _, n, s in got if n], columns=["patch_id", "repairs", "confidence"])

    scripts = _raw_patches(spark, sf).where("patched <> '' and ext in ('ts', 'js', 'mjs', 'java', 'cs', 'py', 'json')").select("patch_id", "patched")
    return scripts.mapInPandas(run, "patch_id bigint, repairs string, confidence double").dropDuplicates(["patch_id"])


def y18_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return r.chunks(load(spark, sf, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id", "pos", F.length("chunk").alias("chars"))


def j11_nearest(spark: SparkSession, sf: str) -> DataFrame:
    v = load(spark, sf, "embeddings", "vec_id", "embedding")
    return r.nearest(v, v.where("vec_id % 50 = 0"), 4).select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


def j11_diverse(spark: SparkSession, sf: str) -> DataFrame:
    v = load(spark, sf, "embeddings", "vec_id", "embedding")
    return r.diverse(r.nearest(v, v.where("vec_id % 50 = 0"), 20), v, 4)


def o4_unlike_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without those that begin like an earlier one."""
    return r.unlike_heads(load(spark, sf, "documents", "doc_id", "text"), "text", ["doc_id"]).select("doc_id")


def y1_event_props(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events", "event_type", "props").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("known"), F.sum("p.k").alias("total"))


def y2_answer_json(spark: SparkSession, sf: str) -> DataFrame:
    """How many answers are JSON by themselves, and how many patches these hold."""
    # the parser ignores what follows a value, so a text counts only if it ends with its object
    v = F.when(F.col("llm_response").rlike(r"(?s)^\{.*\}$"), F.try_parse_json("llm_response"))
    n = F.try_variant_get(v, "$.patches", "array<variant>")
    a = project(load(spark, sf, "proposals", "proposal_id", "llm_response"), "proposal_id", "proposal_id", v.isNotNull().alias("json"), F.when(n.isNotNull(), F.size(n)).otherwise(0).alias("n"))
    return a.where("json").agg(F.count("*").alias("answers"), F.sum("n").alias("patches"))


QUERIES = {f.__name__: f for f in (
    x2_brackets, x3_truncation, f13_marked, f8_change_kind, w7_duplicate_lines, x12_categories, x17_imports, u2_import_changes, x22_types, u7_unknown_types, a11_language, a12_line_counts, x28_tokens, x29_cut,
    y21_budgets, w1_whole_files, w2_packed, w9_budgets, w3_islands, o3_file_priority, adj_numbered, w13_head_tail, j12_failure_patterns, j13_unbreakable, x35_layers, x31_strategy, f10_paths,
    y7_changes, x44_applied, x10_diffs, x41_repairs, y18_chunks, j11_nearest, j11_diverse, o4_unlike_heads, y1_event_props, y2_answer_json,
)}

_F = r"""f AS (SELECT *, CASE WHEN contains(cp, '.') THEN lower(regexp_extract(cp, '\.([^.]*)$', 1)) WHEN cp IS NOT NULL THEN '' END AS ext FROM
 (SELECT file_id, any_value(cycle_id) AS cycle_id, any_value(ord) AS ord, any_value(path) AS path, regexp_replace(replace(any_value(path), '\', '/'), '^(\./)+', '') AS cp, any_value(content) AS content FROM cycle_files GROUP BY file_id))"""
_P = r"""p AS (SELECT *, CASE WHEN contains(cp, '.') THEN lower(regexp_extract(cp, '\.([^.]*)$', 1)) WHEN cp IS NOT NULL THEN '' END AS ext FROM
 (SELECT patch_id, any_value(path) AS path, regexp_replace(replace(any_value(path), '\', '/'), '^(\./)+', '') AS cp, any_value(original) AS original, any_value(patched) AS patched, any_value(diff) AS diff, any_value(status) AS status,
  any_value(warnings) AS warnings, any_value(validation_issues) AS validation_issues, any_value(revert_reason) AS revert_reason FROM patch_results GROUP BY patch_id))"""


def _bal(col: str, a: str, b: str) -> str:
    return f"(length(replace(coalesce({col}, ''), '{b}', '')) - length(replace(coalesce({col}, ''), '{a}', '')))"


def _has(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _first(col: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN {_has(col, ws)} THEN '{n}'" for n, ws in pairs) + " END"


def _map(col: str, table: dict, default: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


_NOTE = rf"""CASE WHEN length(rt) < 10 THEN NULL WHEN {_bal('rt', '{', '}')} > 2 THEN 'open braces' WHEN {" OR ".join(f"ends_with(lower(rt), '{e}')" for e in t.ENDINGS)} THEN 'left out'
 WHEN ends_with(rt, ',') AND NOT regexp_matches(string_split(rt, chr(10))[-1], '[\])}}]') THEN 'trailing comma' WHEN length(regexp_replace(replace(rt, '\"', ''), '[^"]', '', 'g')) % 2 = 1 THEN 'open string' END"""
_TAIL = "lower(array_to_string(string_split(coalesce(patched, ''), chr(10))[greatest(1, len(string_split(coalesce(patched, ''), chr(10))) - 4):], chr(10)))"
_TYPES = r"list_sort(list_distinct(regexp_extract_all(coalesce(content, ''), '\b(?:class|interface|struct|enum|type)[ \t]+([A-Z]\w*)', 1)))"
_MSG = "lower(array_to_string(coalesce(warnings, []) || coalesce(validation_issues, []) || CASE WHEN revert_reason IS NULL THEN [] ELSE [revert_reason] END, chr(10)))"
_WS = r"length(regexp_replace(coalesce(content, ''), '[^ \t\n\r\f\x0B]', '', 'g'))"
_CPT = f"CASE {_map('ext', t.CONTENT_TYPES, 'code_generic')} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.CHARS_PER_TOKEN.items()) + " ELSE 3.5 END::DOUBLE"
_LAYER_RANK = "CASE " + " ".join(f"WHEN {_has('lower(path)', ws)} THEN {i}" for i, ws in enumerate(rules.LAYERS.values(), 1)) + " END"
_IMP = {
    "js": r"""regexp_extract_all({c}, '(?m)^\s*(?:import|export)\b[^''"\n;]*?[''"]([^''"\n]+)[''"]', 1) || regexp_extract_all({c}, '\b(?:require|import)\s*\(\s*[''"]([^''"\n]+)[''"]\s*\)', 1)""",
    "py": r"""[string_split(x, '.')[1] for x in regexp_extract_all({c}, '(?m)^[ \t]*(?:from|import)[ \t]+([\w.]+)', 1)]""",
    "cs": r"""regexp_extract_all({c}, '(?m)^[ \t]*using[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;', 1)""",
    "java": r"""regexp_extract_all({c}, '(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;', 1)""",
}


def _imports(col: str) -> str:
    c = f"coalesce({col}, '')"
    f = {k: v.replace("{c}", c) for k, v in _IMP.items()}
    return f"list_sort(list_distinct([x for x in CASE WHEN ext IN ('ts', 'js', 'mjs', 'tsx', 'jsx') THEN {f['js']} WHEN ext = 'py' THEN {f['py']} WHEN ext = 'cs' THEN {f['cs']} WHEN ext = 'java' THEN {f['java']} ELSE [] END if x <> '']))"


_UNB = " ".join(f"WHEN max(CASE WHEN regexp_matches(lower(coalesce(content, '')), '{'|'.join(p for m, _, p in rules.UNBREAKABLE if m == n)}') THEN 1 ELSE 0 END) = 1 THEN '{n}'" for n in rules.REASONS)

SQL = {
    "x2_brackets": f"WITH {_F} SELECT * FROM (" + " UNION ALL ".join(f"SELECT file_id, '{a}{b}' AS pair, {_bal('content', a, b)}::INT AS difference, CASE WHEN abs({_bal('content', a, b)}) > 1 THEN 'critical' ELSE 'major' END AS severity FROM f WHERE {_bal('content', a, b)} <> 0" + (" AND ext IN ('cs', 'java', 'ts', 'tsx', 'cpp', 'hpp', 'h')" if a == "<" else "") for a, b in (*t.PAIRS, ("<", ">"))) + ")",
    "x3_truncation": f"WITH {_P}, q AS (SELECT patch_id, rtrim(coalesce(patched, '')) AS rt FROM p) SELECT patch_id, {_NOTE} AS note FROM q WHERE note IS NOT NULL",
    "f13_marked": f"WITH {_P} SELECT patch_id FROM p WHERE {_has(_TAIL, t.MARKERS)} OR " + " OR ".join(f"{_bal('patched', a, b)} > 3" for a, b in t.PAIRS),
    "f8_change_kind": rf"WITH {_P} SELECT CASE WHEN coalesce(original, '') = coalesce(patched, '') THEN 'none' WHEN regexp_replace(coalesce(original, ''), '\s+', '', 'g') = regexp_replace(coalesce(patched, ''), '\s+', '', 'g') THEN 'whitespace' ELSE 'change' END AS change, count(*) AS patches FROM p GROUP BY 1",
    "w7_duplicate_lines": f"""WITH {_P}, q AS (SELECT patch_id, [trim(x) for x in string_split(coalesce(patched, ''), chr(10))] AS a, [trim(x) for x in string_split(coalesce(original, ''), chr(10))] AS b FROM p),
        d AS (SELECT patch_id, [a[i] for i in range(1, len(a)) if a[i] = a[i + 1] and length(a[i]) > 3] AS x, [b[i] for i in range(1, len(b)) if b[i] = b[i + 1] and length(b[i]) > 3] AS y FROM q) SELECT patch_id, [z for z in x if not list_contains(y, z)][1] AS line FROM d WHERE line IS NOT NULL""",
    "x12_categories": f"WITH {_P}, i AS (SELECT lower(replace(unnest(validation_issues), '_', ' ')) AS c FROM p) SELECT CASE WHEN {_has('c', t.CRITICAL)} THEN 'critical' WHEN {_has('c', t.MAJOR)} THEN 'major' WHEN {_has('c', t.MINOR)} THEN 'minor' ELSE 'major' END AS severity, count(*) AS issues FROM i GROUP BY 1",
    "x17_imports": f"WITH {_F} SELECT file_id, unnest({_imports('content')}) AS module FROM f",
    "u2_import_changes": f"WITH {_P}, q AS (SELECT patch_id, {_imports('original')} AS a, {_imports('patched')} AS b FROM p WHERE patched <> '') SELECT patch_id, array_to_string([x for x in b if not list_contains(a, x)], ',') AS added, array_to_string([x for x in a if not list_contains(b, x)], ',') AS dropped FROM q WHERE added <> '' OR dropped <> ''",
    "x22_types": f"WITH {_F} SELECT file_id, unnest({_TYPES}) AS name FROM f",
    "u7_unknown_types": rf"WITH {_P} SELECT patch_id, unnest([x for x in list_distinct(regexp_extract_all(coalesce(patched, ''), '\bI[A-Z][A-Za-z0-9]*\b')) if not list_contains(regexp_extract_all(coalesce(original, ''), '\bI[A-Z][A-Za-z0-9]*\b'), x)]) AS name FROM p",
    "a11_language": f"WITH {_F}, q AS (SELECT cycle_id, {_map('ext', t.LANGUAGES, 'unknown')} AS language, count(*) AS n FROM f GROUP BY 1, 2) SELECT cycle_id, arg_min(language, (-n, language)) AS language FROM q GROUP BY 1",
    "a12_line_counts": f"WITH {_P}, l AS (SELECT patch_id, unnest(string_split(diff, chr(10))) AS l FROM p WHERE diff IS NOT NULL) SELECT patch_id, count(*) FILTER (starts_with(l, '+') AND NOT starts_with(l, '+++')) AS added, count(*) FILTER (starts_with(l, '-') AND NOT starts_with(l, '---')) AS removed FROM l GROUP BY 1",
    "x28_tokens": f"WITH {_F} SELECT file_id, floor(((length(coalesce(content, '')) - {_WS}) + 0.3 * {_WS}) / {_CPT})::BIGINT AS tokens FROM f",
    "x29_cut": f"WITH {_F} SELECT file_id, md5(coalesce(CASE WHEN floor(((length(coalesce(content, '')) - {_WS}) + 0.3 * {_WS}) / 3.5) > 300 THEN left(content, {int(int(300 * 3.5) * 0.95)}) || chr(10) || '... [truncated]' ELSE content END, '')) AS digest FROM f WHERE ext = 'py'",
    "y21_budgets": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {n}::INT)" for a, b, n in c.budget(4096)) + ") v(stage, part, tokens)",
    "w1_whole_files": f"WITH {_F}, s AS (SELECT cycle_id, file_id, length(content) AS size FROM f WHERE length(content) BETWEEN 1 AND 8000) SELECT cycle_id, file_id, used FROM (SELECT *, sum(size) OVER (PARTITION BY cycle_id ORDER BY size, file_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM s) WHERE used <= 12000",
    "w2_packed": f"WITH {_F}, s AS (SELECT cycle_id, file_id, length(coalesce(content, '')) AS size, coalesce(sum(length(coalesce(content, ''))) OVER (PARTITION BY cycle_id ORDER BY ord, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f) SELECT cycle_id, file_id, least(size, 6000 - b)::BIGINT AS given FROM s WHERE b < 6000",
    "w9_budgets": f"WITH {_F}, s AS (SELECT cycle_id, file_id, greatest(length(coalesce(content, '')) // 100, 1) AS s FROM f) SELECT cycle_id, file_id, greatest(floor(20000.0::DOUBLE * s / sum(s) OVER (PARTITION BY cycle_id))::BIGINT, 500) AS budget FROM s",
    "w3_islands": rf"""WITH {_F}, l AS (SELECT file_id, len(string_split(content, chr(10))) AS n, i, string_split(content, chr(10))[i] AS l FROM f, unnest(range(1, len(string_split(content, chr(10))) + 1)) u(i) WHERE content IS NOT NULL),
        r AS (SELECT file_id, greatest(i - 1, 1) AS "start", least(i + 2, n) AS "end" FROM l WHERE regexp_matches(l, '^\s*(import|from|using|export class|class|public class)\b')),
        m AS (SELECT *, max("end") OVER (PARTITION BY file_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r),
        k AS (SELECT *, sum(CASE WHEN "start" <= top + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY "start", "end") AS no FROM m) SELECT file_id, min("start")::INT AS "start", max("end")::INT AS "end" FROM k GROUP BY file_id, no""",
    "o3_file_priority": rf"""WITH {_F}, j AS (SELECT cycle_id, any_value(graph) AS graph FROM cycle_jobs GROUP BY 1), e AS (SELECT cycle_id, graph.edges[i][1] AS src, graph.edges[i][2] AS dst FROM j, unnest(range(1, len(graph.edges) + 1)) t(i) WHERE len(graph.edges[i]) >= 2),
        d AS (SELECT cycle_id, node, count(*) AS n FROM (SELECT cycle_id, src AS node FROM e UNION ALL SELECT cycle_id, dst FROM e) GROUP BY 1, 2),
        q AS (SELECT f.*, lower(replace(replace(regexp_replace(regexp_extract(cp, '([^/]*)$', 1), '\.[^.]*$', ''), '-', ''), '_', '')) AS stem, length(coalesce(content, '')) AS len FROM f WHERE path IS NOT NULL)
        SELECT q.cycle_id, file_id, (CASE WHEN node IS NOT NULL THEN 40 ELSE 0 END + CASE WHEN ord = 0 THEN 30 ELSE 0 END + 10 * coalesce(n, 0) + CASE WHEN len < 1000 THEN 15 WHEN len < 3000 THEN 10 WHEN len > 10000 THEN -10 ELSE 0 END)::INT AS score FROM q LEFT JOIN d ON d.cycle_id = q.cycle_id AND lower(node) = stem""",
    "adj_numbered": f"WITH {_F}, q AS (SELECT file_id, string_split(content, chr(10)) AS l FROM f WHERE content <> '') SELECT file_id, md5(array_to_string([lpad(i::VARCHAR, 4, ' ') || ' | ' || l[i] for i in range(1, len(l) + 1)], chr(10))) AS digest FROM q",
    "w13_head_tail": f"WITH {_F}, q AS (SELECT file_id, content, string_split(content, chr(10)) AS l FROM f WHERE content IS NOT NULL) SELECT file_id, md5(CASE WHEN len(l) > 80 THEN array_to_string(l[1:50], chr(10)) || chr(10) || '... (' || (len(l) - 70) || ' lines omitted)' || chr(10) || array_to_string(l[len(l) - 19:], chr(10)) ELSE content END) AS digest FROM q",
    "j12_failure_patterns": f"WITH {_P}, m AS (SELECT {_MSG} AS m FROM p) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS pattern, count(*) AS patches FROM m WHERE {_has('m', ws)}" for n, ws in rules.FAILURES.items()) + ") WHERE patches > 0",
    "j13_unbreakable": f"WITH {_F}, ta AS (SELECT attempt_id, any_value(cycle_id) AS cycle_id, any_value(issue_types) AS it FROM attempts GROUP BY 1), tn AS (SELECT cycle_id, count(*) AS n FROM ta GROUP BY 1 HAVING count(*) >= 2), ti AS (SELECT DISTINCT attempt_id, cycle_id, lower(unnest(it)) AS i FROM ta), tk AS (SELECT cycle_id, i, count(*) AS k FROM ti GROUP BY 1, 2), cm AS (SELECT DISTINCT tk.cycle_id FROM tk JOIN tn USING (cycle_id) WHERE k = n AND regexp_matches(i[:50], 'cycle|dependency')), q AS (SELECT *, rtrim(coalesce(content, '')) AS rt FROM f), n AS (SELECT *, {_NOTE} AS note FROM q) SELECT cycle_id, CASE WHEN sum(length(coalesce(content, ''))) < 100 THEN 'incomplete' WHEN count(note) >= 0.5 * count(*) THEN 'incomplete' {_UNB} WHEN cycle_id IN (SELECT cycle_id FROM cm) THEN 'coupled_by_design' WHEN cycle_id IN (SELECT cycle_id FROM (SELECT cycle_id, unnest(graph.nodes) AS x FROM cycle_jobs) WHERE {_has('x', rules.EXTERNAL)}) THEN 'external' END AS reason FROM n GROUP BY 1 HAVING reason IS NOT NULL",
    "x35_layers": f"WITH {_F}, q AS (SELECT cycle_id, {_LAYER_RANK} AS r FROM f WHERE path IS NOT NULL), m AS (SELECT cycle_id, min(r) AS a, max(r) AS b FROM q GROUP BY 1 HAVING count(DISTINCT r) >= 2) SELECT cycle_id, {list(rules.LAYERS)}[b] || ' → ' || {list(rules.LAYERS)}[a] AS violation FROM m",
    "x31_strategy": f"WITH j AS (SELECT cycle_id, lower(coalesce(any_value(summary), '')) AS s FROM cycle_jobs GROUP BY 1) SELECT coalesce({_first('s', rules.STRATEGIES)}, 'none') AS strategy, count(*) AS jobs FROM j GROUP BY 1",
    "f10_paths": rf"WITH {_F} SELECT coalesce(length(path) > 0 AND length(path) <= 260 AND NOT regexp_matches(path, '(^|[/\\])\.\.([/\\]|$)') AND NOT regexp_matches(path, '^([/\\]|[A-Za-z]:)'), false) AS usable, count(*) AS files FROM f GROUP BY 1",
    "j11_nearest": "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product([x::DOUBLE for x in q.embedding], [x::DOUBLE for x in v.embedding]) AS s FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, rank, round(s, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 4",
    "o4_unlike_heads": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY left(text, 200) ORDER BY doc_id) AS r FROM documents) WHERE r = 1",
    "y2_answer_json": "WITH p AS (SELECT proposal_id, any_value(llm_response) AS a FROM proposals GROUP BY 1) SELECT count(*) AS answers, coalesce(sum(json_array_length(a, '$.patches')), 0)::BIGINT AS patches FROM p WHERE json_valid(a) AND starts_with(a, '{') AND ends_with(a, '}')",
    "y1_event_props": "SELECT event_type, count(k) AS known, sum(k)::BIGINT AS total FROM (SELECT event_type, (props->>'$.k')::BIGINT AS k FROM events) GROUP BY 1",
}
