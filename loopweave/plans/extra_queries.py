"""More queries over files, patches, answers and attempts, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as t
from ..operators import graph as g
from ..operators import history as h
from ..operators import reports as r
from ..tables import clean_path, extension, load, once, project

#: Words that tell a pattern in a cycle's files, and what to look up for it; fixed values.
INHERITS = r"\b(?:extends|implements)\b|class\s+\w+\s*\(\s*[A-Z]|:\s*[A-Z]\w+\s*\{"
INTERFACE = r"\binterface\s+[A-Z]|\bProtocol\b|\bABC\b"
QUERIES_BY_TYPE = {
    "bidirectional": ("how to break a bidirectional dependency between two modules", "interface extraction between two classes"),
    "transitive": ("how to break a transitive dependency chain", "dependency inversion for the weakest edge of a chain"),
    "star": ("how to split a hub module", "mediator for modules around a hub"),
}


def _raw_files(spark: SparkSession, sf: str) -> DataFrame:
    f = load(spark, sf, "cycle_files", "file_id", "cycle_id", "project", "ord", "path", "content")
    return f.withColumn("cp", clean_path(F.col("path"))).withColumn("ext", extension(F.col("cp")))


def _files(spark: SparkSession, sf: str, *columns) -> DataFrame:
    return project(_raw_files(spark, sf), "file_id", *columns)


def _raw_patches(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "patch_results", "patch_id", "cycle_id", "iteration", "path", "original", "patched", "status", "confidence", "warnings", "validation_issues", "applied_blocks", "total_blocks", "pre_validated", "original_patched", "revert_reason")
    return p.withColumn("ext", extension(clean_path(F.col("path"))))


def _patches(spark: SparkSession, sf: str, *columns) -> DataFrame:
    return project(_raw_patches(spark, sf), "patch_id", *columns)


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    return once(load(spark, sf, "cycle_jobs"), "cycle_id")


def _diffs(spark: SparkSession, sf: str) -> DataFrame:
    return once(load(spark, sf, "minimal_diffs", "diff_id", "cycle_id", "relay", "success", "target_src", "target_dst", "strategy", "raw_llm_response", "remaining_cycle", "confidence"), "diff_id")


def s9_materialised(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of a job with the characters of the files named after them; 0 where no file is."""
    n = _jobs(spark, sf).select("cycle_id", F.posexplode("graph.nodes").alias("pos", "node"))
    stem = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract("cp", r"([^/]*)$", 1), r"\.[^.]*$", ""), "[-_]", ""))
    f = _files(spark, sf, "file_id", "cycle_id", stem.alias("_stem"), F.length("content").alias("n")).groupBy("cycle_id", "_stem").agg(F.sum("n").alias("_c"))
    j = n.withColumn("_stem", F.lower("node")).join(f, ["cycle_id", "_stem"], "left")
    return j.select("cycle_id", "pos", "node", F.coalesce("_c", F.lit(0)).alias("chars"))


def load_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Per cycle: files with and without content."""
    f = _files(spark, sf, "file_id", "cycle_id", F.coalesce(F.length("content") > 0, F.lit(False)).alias("has"))
    return f.groupBy("cycle_id").agg(F.sum(F.col("has").cast("int")).alias("loaded"), F.sum((~F.col("has")).cast("int")).alias("missing"))


def f4_internal_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose target the job declares."""
    e = g.distinct_edges(g.job_edges(_jobs(spark, sf)), "cycle_id")
    declared = _jobs(spark, sf).select("cycle_id", F.explode("graph.nodes").alias("dst")).distinct()
    return e.join(declared, ["cycle_id", "dst"], "left_semi").select("cycle_id", "src", "dst")


def x4_introduced(spark: SparkSession, sf: str) -> DataFrame:
    """Brackets that a patch leaves worse than it found them."""
    each = []
    for pair in t.PAIRS:
        a, b = F.abs(t.balance(F.col("original"), pair)), F.abs(t.balance(F.col("patched"), pair))
        each.append(F.when(b > a, F.struct(F.lit("".join(pair)).alias("pair"), (b - a).alias("worse"), F.when(a == 0, "critical").otherwise("major").alias("severity"))))
    p = project(_raw_patches(spark, sf).where("patched <> ''"), "patch_id", "patch_id", F.array_compact(F.array(*each)).alias("b"))
    return p.select("patch_id", F.inline("b"))


def x5_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """How sure one may be of a patched text by its worst bracket issue."""
    worst = F.array_max(F.transform(t.bracket_issues(F.col("patched"), F.lit("")), lambda x: F.when(x["severity"] == "critical", 2).otherwise(1)))
    c = F.when(F.coalesce(worst, F.lit(0)) == 2, 0.0).when(F.coalesce(worst, F.lit(0)) == 1, 0.3).otherwise(1.0)
    return project(_raw_patches(spark, sf).where("patched <> ''"), "patch_id", "patch_id", c.alias("confidence")).groupBy("confidence").agg(F.count("*").alias("patches"))


def x7_indent(spark: SparkSession, sf: str) -> DataFrame:
    """The least indentation of each file's lines that aren't blank."""
    lines = F.filter(F.split("content", "\n"), lambda x: F.trim(x) != "")
    least = F.array_min(F.transform(lines, lambda x: F.length(F.regexp_extract(x, "^( *)", 1))))
    return project(_raw_files(spark, sf).where("content <> ''"), "file_id", "file_id", F.coalesce(least, F.lit(0)).alias("indent")).groupBy("indent").agg(F.count("*").alias("files"))


def x8_line_ends(spark: SparkSession, sf: str) -> DataFrame:
    f = _raw_files(spark, sf).where("content is not null")
    return project(f, "file_id", "file_id", F.md5(t.lf(F.col("content"))).alias("digest"), t.occurrences(F.col("content"), "\r\n").alias("crlf"))


def x18_type_references(spark: SparkSession, sf: str) -> DataFrame:
    """Types that a project's files define and another file of the same cycle mentions."""
    f = _raw_files(spark, sf)  # the result is distinct, re-delivered or not
    types = f.select("cycle_id", F.col("file_id").alias("_def"), F.explode(t.defined_types(F.col("content"))).alias("name"))
    words = f.select("cycle_id", "file_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"\b[A-Z][A-Za-z0-9_]*"), F.lit(0)))).alias("name"))
    return words.join(types, ["cycle_id", "name"]).where("file_id <> _def").select("cycle_id", "file_id", "name").distinct()


def x50_methods(spark: SparkSession, sf: str) -> DataFrame:
    """Methods that a file declares, by language."""
    c = F.coalesce("content", F.lit(""))
    py = F.regexp_extract_all(c, F.lit(r"(?m)^[ \t]+def[ \t]+(\w+)[ \t]*\("), F.lit(1))
    c_like = F.regexp_extract_all(c, F.lit(r"(?m)^[ \t]+public[ \t]+(?:static[ \t]+)?[\w<>\[\]]+[ \t]+(\w+)[ \t]*\("), F.lit(1))
    ts = F.regexp_extract_all(c, F.lit(r"(?m)^  (\w+)\([^()\n]*\)(?:: [^{\n]+)? \{"), F.lit(1))
    m = F.when(F.col("ext") == "py", py).when(F.col("ext").isin("cs", "java"), c_like).when(F.col("ext").isin("ts", "js", "mjs"), ts).otherwise(F.array().cast("array<string>"))
    return _files(spark, sf, "file_id", F.size(F.array_distinct(m)).alias("methods"))


def x52_weakest_edge(spark: SparkSession, sf: str) -> DataFrame:
    """The edge of a cycle's ring that fewest edges double, the first in order among equals."""
    w = g.edge_weights(g.job_edges(_jobs(spark, sf)), "cycle_id")
    ring = _jobs(spark, sf).select("cycle_id", F.posexplode(g.ring(F.col("graph.nodes"))).alias("pos", "e")).select("cycle_id", "pos", "e.src", "e.dst")
    j = ring.join(w, ["cycle_id", "src", "dst"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return j.groupBy("cycle_id").agg(F.min(F.struct("weight", "pos", "src", "dst")).alias("m")).select("cycle_id", "m.src", "m.dst", "m.weight")


def j9_reverted_files(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals' reverted files that the cycle has a file for, by base name."""
    base = lambda c: F.lower(F.regexp_extract(clean_path(c), r"([^/]*)$", 1))
    p = once(load(spark, sf, "proposals", "proposal_id", "cycle_id", "reverted_files"), "proposal_id").select("proposal_id", "cycle_id", F.inline("reverted_files"))
    f = _files(spark, sf).where("path is not null").select("cycle_id", base(F.col("path")).alias("_b")).distinct()
    return p.withColumn("_b", base(F.col("path"))).join(f, ["cycle_id", "_b"], "left_semi").select("proposal_id", "path", "reason")


def j14_effective_files(spark: SparkSession, sf: str) -> DataFrame:
    """Each file with the newest patch of its path, else as it is: characters."""
    p = _raw_patches(spark, sf).where("patched <> '' and status in ('applied', 'partial')").groupBy("cycle_id", "path").agg(F.max_by(F.length("patched"), F.struct("iteration", "patch_id")).alias("chars"))
    f = _files(spark, sf, "file_id", "cycle_id", "path", F.length("content").alias("own"))
    return f.join(p, ["cycle_id", "path"], "left").select("file_id", F.coalesce("chars", "own").alias("chars"), F.col("chars").isNotNull().alias("is_patched"))


def m7_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Patches of a cycle in order with the paths changed before them."""
    w = W.partitionBy("cycle_id").orderBy("iteration", "patch_id").rowsBetween(W.unboundedPreceding, -1)
    p = _patches(spark, sf).where("cycle_id is not null")
    return p.select("patch_id", F.size(F.collect_set("path").over(w)).alias("changed_before"))


def f11_content_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose content lacks what its language needs, is short, or looks cut."""
    c = F.coalesce("content", F.lit(""))
    need = F.when(F.col("ext") == "cs", c.rlike(r"\b(namespace|class|interface|struct|enum|record)\b")).when(F.col("ext") == "java", c.rlike(r"\b(class|interface|enum|record)\b")).when(F.col("ext") == "py", c.rlike(r"\b(def|class|import)\b|=")).otherwise(True)
    note = F.when(c == "", "empty").when(F.length(F.trim(c)) < 20, "short").when(~need, "missing construct").when(t.truncation_note(c).isNotNull(), "looks cut")
    return _files(spark, sf, "file_id", F.coalesce(note, F.lit("fine")).alias("note")).groupBy("note").agg(F.count("*").alias("files"))


def f12_truncated_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles half of whose files or more look cut."""
    f = _files(spark, sf, "file_id", "cycle_id", t.truncation_note(F.col("content")).alias("note")).groupBy("cycle_id").agg(F.count("*").alias("n"), F.count("note").alias("cut"))
    return f.where("cut >= 0.5 * n").select("cycle_id", "cut")


QUERIES = {f.__name__: f for f in (
    s9_materialised, f4_internal_edges, x4_introduced, x5_confidence, x7_indent, x8_line_ends, x18_type_references, 
    x50_methods, x52_weakest_edge, 
    j9_reverted_files, j14_effective_files, m7_turns, f11_content_checks, f12_truncated_jobs, 
)}
QUERIES["load_counts"] = load_counts

# ----------------------------------------------------------------------------------------------------------- SQL
_F = r"""f AS (SELECT *, CASE WHEN contains(cp, '.') THEN lower(regexp_extract(cp, '\.([^.]*)$', 1)) WHEN cp IS NOT NULL THEN '' END AS ext, coalesce(content, '') AS c FROM
 (SELECT file_id, any_value(cycle_id) AS cycle_id, any_value(ord) AS ord, any_value(path) AS path, regexp_replace(replace(any_value(path), '\', '/'), '^(\./)+', '') AS cp, any_value(content) AS content FROM cycle_files GROUP BY file_id))"""
_P = r"""p AS (SELECT *, CASE WHEN contains(cp, '.') THEN lower(regexp_extract(cp, '\.([^.]*)$', 1)) WHEN cp IS NOT NULL THEN '' END AS ext FROM
 (SELECT patch_id, any_value(cycle_id) AS cycle_id, any_value(iteration) AS iteration, any_value(path) AS path, regexp_replace(replace(any_value(path), '\', '/'), '^(\./)+', '') AS cp, any_value(original) AS original, any_value(patched) AS patched, any_value(status) AS status,
  any_value(confidence) AS confidence, any_value(warnings) AS warnings, any_value(validation_issues) AS vi FROM patch_results GROUP BY patch_id))"""
_J = "j AS (SELECT cycle_id, any_value(graph) AS graph, any_value(severity) AS severity, any_value(impact_score) AS impact_score FROM cycle_jobs GROUP BY cycle_id)"
_E = f"{_J}, e0 AS (SELECT cycle_id, graph.edges[i][1] AS src, graph.edges[i][2] AS dst FROM j, unnest(range(1, len(graph.edges) + 1)) t(i) WHERE len(graph.edges[i]) >= 2), e AS (SELECT DISTINCT * FROM e0)"
_D = "d AS (SELECT diff_id, any_value(cycle_id) AS cycle_id, any_value(success) AS success, any_value(target_src) AS target_src, any_value(target_dst) AS target_dst, coalesce(nullif(regexp_replace(lower(trim(any_value(strategy))), '[\\s-]+', '_', 'g'), ''), 'unknown') AS st, any_value(raw_llm_response) AS raw, any_value(remaining_cycle) AS rest FROM minimal_diffs GROUP BY diff_id)"
_STEM = r"lower(replace(replace(regexp_replace(regexp_extract(cp, '([^/]*)$', 1), '\.[^.]*$', ''), '-', ''), '_', ''))"
_TYPES = r"list_sort(list_distinct(regexp_extract_all({c}, '\b(?:class|interface|struct|enum|type)[ \t]+([A-Z]\w*)', 1)))"


def _bal(c: str, a: str, b: str) -> str:
    return f"(length(replace(coalesce({c}, ''), '{b}', '')) - length(replace(coalesce({c}, ''), '{a}', '')))"


def _note(c: str) -> str:
    rt = f"rtrim(coalesce({c}, ''))"
    ends = " OR ".join(f"ends_with(lower({rt}), '{e}')" for e in t.ENDINGS)
    return rf"""CASE WHEN length({rt}) < 10 THEN NULL WHEN {_bal(rt, '{', '}')} > 2 THEN 'open braces' WHEN {ends} THEN 'left out' WHEN ends_with({rt}, ',') AND NOT regexp_matches(string_split({rt}, chr(10))[-1], '[\])}}]') THEN 'trailing comma' WHEN length(regexp_replace(replace({rt}, '\"', ''), '[^"]', '', 'g')) % 2 = 1 THEN 'open string' END"""


def _sql_imports(col: str) -> str:
    from .text_queries import _imports

    return _imports(col)


_WS = r"length(regexp_replace(c, '[^ \t\n\r\f\x0B]', '', 'g'))"
_TOK = f"floor(((length(c) - {_WS}) + 0.3 * {_WS}) / (CASE (CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.CONTENT_TYPES.items()) + " ELSE 'code_generic' END) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.CHARS_PER_TOKEN.items()) + " ELSE 3.5 END)::DOUBLE)::BIGINT"
_ALL_BRACKETS = " UNION ALL ".join(f"SELECT patch_id, '{a}{b}' AS pair, abs({_bal('patched', a, b)}) - abs({_bal('original', a, b)}) AS worse, CASE WHEN {_bal('original', a, b)} = 0 THEN 'critical' ELSE 'major' END AS severity FROM p WHERE patched <> '' AND abs({_bal('patched', a, b)}) > abs({_bal('original', a, b)})" for a, b in t.PAIRS)
_WORST = "greatest(" + ", ".join(f"CASE WHEN abs({_bal('patched', a, b)}) > 1 THEN 2 WHEN {_bal('patched', a, b)} <> 0 THEN 1 ELSE 0 END" for a, b in t.PAIRS) + ")"

SQL = {
    "s9_materialised": f"WITH {_J}, {_F}, n AS (SELECT cycle_id, (i - 1)::INT AS pos, graph.nodes[i] AS node FROM j, unnest(range(1, len(graph.nodes) + 1)) u(i)), s AS (SELECT cycle_id, {_STEM} AS stem, sum(length(content)) AS n FROM f GROUP BY 1, 2) SELECT n.cycle_id, pos, node, coalesce(s.n, 0)::BIGINT AS chars FROM n LEFT JOIN s ON s.cycle_id = n.cycle_id AND stem = lower(node)",
    "load_counts": f"WITH {_F} SELECT cycle_id, count(*) FILTER (length(content) > 0) AS loaded, count(*) FILTER (coalesce(length(content), 0) = 0) AS missing FROM f GROUP BY 1",
    "f4_internal_edges": f"WITH {_E} SELECT e.* FROM e JOIN j USING (cycle_id) WHERE list_contains(j.graph.nodes, dst)",
    "x4_introduced": f"WITH {_P} SELECT patch_id, pair, worse::INT AS worse, severity FROM ({_ALL_BRACKETS})",
    "x5_confidence": f"WITH {_P} SELECT CASE {_WORST} WHEN 2 THEN 0.0 WHEN 1 THEN 0.3 ELSE 1.0 END::DOUBLE AS confidence, count(*) AS patches FROM p WHERE patched <> '' GROUP BY 1",
    "x7_indent": f"WITH {_F} SELECT coalesce(list_min([length(regexp_extract(x, '^( *)', 1)) for x in string_split(content, chr(10)) if trim(x) <> '']), 0)::INT AS indent, count(*) AS files FROM f WHERE content <> '' GROUP BY 1",
    "x8_line_ends": r"WITH " + _F + r" SELECT file_id, md5(regexp_replace(content, '\r\n?', chr(10), 'g')) AS digest, ((length(content) - length(replace(content, chr(13) || chr(10), ''))) // 2)::INT AS crlf FROM f WHERE content IS NOT NULL",
    "x18_type_references": r"WITH " + _F + r", t AS (SELECT cycle_id, file_id AS d, unnest(" + _TYPES.replace("{c}", "c") + r") AS name FROM f), w AS (SELECT DISTINCT cycle_id, file_id, unnest(regexp_extract_all(c, '\b[A-Z][A-Za-z0-9_]*')) AS name FROM f) SELECT DISTINCT w.* FROM w JOIN t USING (cycle_id, name) WHERE file_id <> d",
    "x50_methods": r"WITH " + _F + r""" SELECT file_id, len(list_distinct(CASE WHEN ext = 'py' THEN regexp_extract_all(c, '(?m)^[ \t]+def[ \t]+(\w+)[ \t]*\(', 1) WHEN ext IN ('cs', 'java') THEN regexp_extract_all(c, '(?m)^[ \t]+public[ \t]+(?:static[ \t]+)?[\w<>\[\]]+[ \t]+(\w+)[ \t]*\(', 1)
        WHEN ext IN ('ts', 'js', 'mjs') THEN regexp_extract_all(c, '(?m)^  (\w+)\([^()\n]*\)(?:: [^{\n]+)? \{', 1) ELSE [] END))::INT AS methods FROM f""",
    "x52_weakest_edge": f"WITH {_E}, w AS (SELECT cycle_id, src, dst, count(*)::DOUBLE AS weight FROM e0 GROUP BY 1, 2, 3), ring AS (SELECT cycle_id, i AS pos, graph.nodes[i] AS src, graph.nodes[i % len(graph.nodes) + 1] AS dst FROM j, unnest(range(1, len(graph.nodes) + 1)) u(i)), q AS (SELECT ring.*, coalesce(weight, 1.0) AS weight FROM ring LEFT JOIN w USING (cycle_id, src, dst)) SELECT cycle_id, arg_min(src, (weight, pos)) AS src, arg_min(dst, (weight, pos)) AS dst, min(weight) AS weight FROM q GROUP BY 1",
    "j9_reverted_files": rf"WITH {_F}, b AS (SELECT DISTINCT cycle_id, lower(regexp_extract(cp, '([^/]*)$', 1)) AS b FROM f WHERE path IS NOT NULL), p AS (SELECT proposal_id, any_value(cycle_id) AS cycle_id, any_value(reverted_files) AS r FROM proposals GROUP BY 1), x AS (SELECT proposal_id, cycle_id, unnest(r, recursive := true) FROM p) SELECT proposal_id, path, reason FROM x WHERE EXISTS (SELECT 1 FROM b WHERE b.cycle_id = x.cycle_id AND b.b = lower(regexp_extract(replace(x.path, '\', '/'), '([^/]*)$', 1)))",
    "j14_effective_files": f"WITH {_P}, {_F}, n AS (SELECT cycle_id, path, arg_max(patched, (iteration, patch_id)) AS patched FROM p WHERE patched <> '' AND status IN ('applied', 'partial') GROUP BY 1, 2) SELECT file_id, length(coalesce(n.patched, content))::INT AS chars, n.patched IS NOT NULL AS is_patched FROM f LEFT JOIN n ON n.cycle_id = f.cycle_id AND n.path = f.path",
    "m7_turns": f"WITH {_P} SELECT patch_id, coalesce(len(list_distinct(list(path) OVER (PARTITION BY cycle_id ORDER BY iteration, patch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))), 0)::INT AS changed_before FROM p WHERE cycle_id IS NOT NULL",
    "f11_content_checks": rf"WITH {_F} SELECT coalesce(CASE WHEN c = '' THEN 'empty' WHEN length(trim(c)) < 20 THEN 'short' WHEN NOT (CASE WHEN ext = 'cs' THEN regexp_matches(c, '\b(namespace|class|interface|struct|enum|record)\b') WHEN ext = 'java' THEN regexp_matches(c, '\b(class|interface|enum|record)\b') WHEN ext = 'py' THEN regexp_matches(c, '\b(def|class|import)\b|=') ELSE true END) THEN 'missing construct' WHEN {_note('c')} IS NOT NULL THEN 'looks cut' END, 'fine') AS note, count(*) AS files FROM f GROUP BY 1",
    "f12_truncated_jobs": f"WITH {_F}, q AS (SELECT cycle_id, count(*) AS n, count({_note('content')}) AS cut FROM f GROUP BY 1) SELECT cycle_id, cut FROM q WHERE cut >= 0.5 * n",
}
