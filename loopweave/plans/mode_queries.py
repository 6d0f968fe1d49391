"""Queries over stage modes, project graphs, checks and the index, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import briefing as b
from ..operators import compiling as k
from ..operators import explaining as x
from ..operators import graph as g
from ..operators import history as h
from ..sources import memory, projects, readers
from ..tables import clean_path, extension, load, once
from . import briefing_queries as bq
from . import explaining_queries as eq
from . import modes as m
from .extra_queries import _F, _J, _TYPES, _sql_imports
from .suggestion_queries import SQL as _SUGGESTED


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return once(load(spark, sf, "cycle_files", "file_id", "cycle_id", "path", "content"), "file_id")


def adj_p1_imports(spark: SparkSession, sf: str) -> DataFrame:
    """What files import, and whether it is the project's own."""
    f = load(spark, sf, "cycle_files", "file_id", "path", "content").withColumn("ext", extension(clean_path(F.col("path"))))
    e = f.select(F.col("file_id").cast("string").alias("src"), F.explode(t.imports(F.col("content"), F.col("ext"))).alias("dst")).distinct()
    return projects.imports(e).select(F.col("source_file").cast("bigint").alias("file_id"), "imported_from", "resolved_path", "is_external")


def adj_p1_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of all jobs' edges."""
    e = load(spark, sf, "cycle_jobs", "graph").select(F.explode("graph.edges").alias("e")).where("size(e) >= 2").select(F.col("e")[0].alias("src"), F.col("e")[1].alias("dst"))
    return projects.graph(e)


def adj_p4_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs with how many of their files have content and how many don't; jobs without a file have none of either."""
    f = _files(spark, sf).select("cycle_id", (F.coalesce(F.length("content"), F.lit(0)) > 0).cast("int").alias("has")).groupBy("cycle_id").agg(F.sum("has").alias("loaded"), F.sum(1 - F.col("has")).alias("missing"))
    j = once(load(spark, sf, "cycle_jobs", "cycle_id"), "cycle_id").join(f, "cycle_id", "left")
    return j.select("cycle_id", F.coalesce("loaded", F.lit(0)).alias("loaded"), F.coalesce("missing", F.lit(0)).alias("missing"))


def m2_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """The numbered file sections of each cycle's relaxed prompt."""
    f = _files(spark, sf).withColumn("content", F.regexp_replace("content", "\r\n?", "\n"))
    return m.numbered_files(f, "cycle_id", "file_id").select("file_id", F.md5("text").alias("digest"))


def m12_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The example that each strategy of the history gets."""
    s = load(spark, sf, "attempts", "strategy").select(h.strategy_name(F.col("strategy")).alias("strategy")).distinct()
    return s.select("strategy", m.example(F.col("strategy")).alias("example"))


def m3_suggested(spark: SparkSession, sf: str) -> DataFrame:
    """Suggestion runs: each answer's report, and its suggestions by note."""
    from . import suggestion_queries as sq

    n = sq._rows(spark, sf).groupBy("proposal_id").agg(F.count("*").alias("suggestions"), F.sum(F.exists("codes", lambda c: c["first"] == 0).cast("int")).alias("unplaced"))
    return sq.k9_report(spark, sf).join(n, "proposal_id", "left").select("proposal_id", "digest", F.coalesce("suggestions", F.lit(0)).alias("suggestions"), F.coalesce("unplaced", F.lit(0)).alias("unplaced"))


def m4_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of any layout applied to the files they mean: what came of it."""
    ans = load(spark, sf, "proposals", "proposal_id", "cycle_id", "llm_response")
    ans = once(ans.where("llm_response is not null"), "proposal_id")
    f = load(spark, sf, "cycle_files", "cycle_id", clean_path(F.col("path")).alias("path"), "content").where("content is not null")
    return m.apply_answers(ans, f, ["cycle_id", "proposal_id"], "llm_response").select("proposal_id", "path", "kind", "status", F.round("confidence", 4).alias("confidence"), "note")


def m10_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt of each cycle: strategy, nodes, hints and example over the files shown, within 20,000 characters."""
    a_ = bq._analysis(spark, sf).join(bq._nodes(spark, sf).withColumnRenamed("nodes", "nodes_"), "cycle_id")
    strategy = F.when(F.col("cycle_type") == "bidirectional", "interface_extraction").when(F.col("violation").isNotNull(), "dependency_inversion").otherwise("shared_module")
    s = b.shown(_files(spark, sf), bq._nodes(spark, sf), "cycle_id", "file_id", 12_000).where("status <> 'empty' and text <> ''")
    shown = s.groupBy("cycle_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("status") != "full").alias("k"), "size", "file_id", "text"))), lambda y: y["text"]), "\n\n").alias("files"))
    j = a_.withColumn("strategy", strategy).join(shown, "cycle_id", "left")
    body = F.concat(F.lit("Strategy: "), "strategy", F.lit("\nNodes: "), F.array_join("nodes_", ", "), F.lit("\nHints: "), F.array_join(b.hints(), "; "), F.lit("\nExample: "), m.example(F.col("strategy")), F.lit("\n\n"), F.coalesce("files", F.lit("")))
    return j.select("cycle_id", F.md5(m.within(body, 20_000)).alias("digest"))


def m17_explained(spark: SparkSession, sf: str) -> DataFrame:
    """What the changes of approved cycles amount to."""
    nodes = once(load(spark, sf, "cycle_jobs", "cycle_id", "graph"), "cycle_id").select("cycle_id", F.col("graph.nodes").alias("nodes"))
    last = load(spark, sf, "attempts", "attempt_id", "cycle_id", "approved").groupBy("cycle_id").agg(F.max_by("approved", "attempt_id").alias("approved"))
    return m.explained(eq._patches(spark, sf), nodes, last)


def m18_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Failure reports of the cycles that have a proposal."""
    have = load(spark, sf, "proposals", "cycle_id").distinct()
    return x.failure_report(eq._patches(spark, sf)).join(have, "cycle_id", "left_semi").select("cycle_id", F.md5("report").alias("digest"))


def e2_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Files by language and what its checker says; a language without a checker counts as a success."""
    return k.checked(_files(spark, sf), "file_id").groupBy("language", "success", "tool_available").agg(F.count("*").alias("files"))


def adj_p7_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Each job's cycle as a sentence."""
    j = once(load(spark, sf, "cycle_jobs", "cycle_id", "graph"), "cycle_id").where("size(graph.nodes) > 0")
    return j.select("cycle_id", g.describe(F.col("graph.nodes")).alias("description"))


def x19_import_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The import lines of files, whole, by extension."""
    f = load(spark, sf, "cycle_files", "file_id", "path", "content").withColumn("ext", extension(clean_path(F.col("path"))))
    lines = F.when(F.col("ext").isin(*t.IMPORT_LINES), F.array_distinct(t.import_lines(F.col("content"), F.col("ext"))))
    f = once(f.select("file_id", "ext", lines.alias("l")), "file_id")
    return f.select("ext", F.explode("l").alias("line")).groupBy("ext", "line").agg(F.count("*").alias("files"))


def x49_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """What is noted of patches before they are judged: changes of nothing or of blanks only, and interfaces that nothing defines."""
    p = eq._patches(spark, sf).where("patched <> ''")
    kind = t.change_kind(F.col("original"), F.col("patched"))
    names = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\bI[A-Z][a-zA-Z0-9]*\b"), F.lit(0))
    new = F.array_except(names(F.col("patched")), F.concat(names(F.col("original")), t.defined_types(F.col("patched"))))
    notes = F.concat(F.when(kind == "none", F.array(F.lit("no change"))).when(kind == "whitespace", F.array(F.lit("blanks only"))).otherwise(F.array().cast("array<string>")), F.transform(new, lambda x: F.concat(F.lit("unknown "), x)))
    return p.select(F.explode(notes).alias("note")).groupBy("note").agg(F.count("*").alias("patches"))


def w11_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The last ten lines of all files that speak of an error."""
    f = once(load(spark, sf, "cycle_files", "file_id", "content").where(F.col("content").rlike("ERROR|Traceback|Exception")), "file_id")
    lines = f.select("file_id", F.posexplode(F.split("content", "\n")).alias("n", "line")).withColumn("pos", F.col("file_id") * 1_000_000 + F.col("n"))
    return readers.log_errors(lines, 10).select("file_id", "n", "line")


def y24_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Checked JSON files, by the line that sums up their result."""
    f = load(spark, sf, "cycle_files", "file_id", "path", "content").where(extension(clean_path(F.col("path"))) == "json").where("content <> ''")
    r = once(k.checked(f, "file_id"), "file_id")
    return r.groupBy(k.summary(F.col("success"), F.col("errors")).alias("summary")).agg(F.count("*").alias("files"))


def y23_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """How many cycles a project has, and whether it has any."""
    j = once(load(spark, sf, "cycle_jobs", "cycle_id", "project"), "cycle_id").groupBy("project").agg(F.count("*").alias("cycles"))
    p = load(spark, sf, "projects", "project").join(j, "project", "left")
    return p.select("project", F.coalesce("cycles", F.lit(0)).alias("cycles"), (F.coalesce("cycles", F.lit(0)) > 0).alias("has_cycles"))


def y20_index(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as an index of embedded chunks."""
    return memory.index(load(spark, sf, "documents", "doc_id", "text"), "doc_id", "text").select("vec_id", "doc_id", F.size("embedding").alias("size"))


def o5_context(spark: SparkSession, sf: str) -> DataFrame:
    """What the documents say to each cycle's first searches, the strategy's own first."""
    idx = memory.index(load(spark, sf, "documents", "doc_id", "text"), "doc_id", "text").withColumn("source", F.col("doc_id").cast("string"))
    j = bq._analysis(spark, sf).join(bq._jobs(spark, sf).select("cycle_id", "summary"), "cycle_id")
    first = F.when(F.col("cycle_type") == "bidirectional", m.STRATEGY_LOOKUPS["interface_extraction"]).when(F.col("violation").isNotNull(), m.STRATEGY_LOOKUPS["dependency_inversion"])
    q = j.select("cycle_id", F.posexplode(F.concat(F.array_compact(F.array(first)), b.lookups("implement", F.col("summary")))).alias("pos", "query"))
    return memory.context(q, idx, "cycle_id")


def o6_context(spark: SparkSession, sf: str) -> DataFrame:
    """What the documents say to one search about each cycle's pattern."""
    idx = memory.index(load(spark, sf, "documents", "doc_id", "text"), "doc_id", "text").withColumn("source", F.col("doc_id").cast("string"))
    q = bq._analysis(spark, sf).select("cycle_id", F.lit(0).alias("pos"), F.concat(F.lit("benefits of breaking a "), "pattern").alias("query"))
    return memory.context(q, idx, "cycle_id", shown=1, best=2)


QUERIES = {f.__name__: f for f in (adj_p1_imports, adj_p1_nodes, adj_p4_specs, m2_snippets, m12_examples, m3_suggested, m4_applied, m10_prompts, m17_explained, m18_failures, e2_checked, adj_p7_descriptions, x19_import_lines, x49_diagnostics, w11_errors, y24_summaries, y23_cycles, y20_index, o5_context, o6_context)}

# ----------------------------------------------------------------------------------------------------------- SQL
_NUM = "array_to_string([lpad((i + {first} - 1)::VARCHAR, 4, ' ') || ' | ' || ({l})[i] for i in range(1, len({l}) + 1)], chr(10))"
_SPLIT = r"string_split(regexp_replace({x}, '\n$', ''), chr(10))"
_STRAT = "CASE WHEN cycle_type = 'bidirectional' THEN 'interface_extraction' WHEN violation IS NOT NULL THEN 'dependency_inversion' ELSE 'shared_module' END"
_EX = "CASE {s} " + " ".join(f"WHEN '{kk}' THEN '{v}'" for kk, v in m.EXAMPLES.items()) + f" ELSE '{m.ANY_EXAMPLE}' END"
SQL = {
    "adj_p1_imports": f"WITH {_F.replace('FROM cycle_files', 'FROM cycle_files')}, e AS (SELECT DISTINCT file_id, unnest({_sql_imports('content')}) AS m FROM f) SELECT file_id, m AS imported_from, CASE WHEN starts_with(m, '.') THEN m END AS resolved_path, NOT starts_with(m, '.') AS is_external FROM e",
    "adj_p1_nodes": "WITH e AS (SELECT unnest(graph.edges) AS e FROM cycle_jobs) SELECT DISTINCT node FROM (SELECT e[1] AS node FROM e WHERE len(e) >= 2 UNION ALL SELECT e[2] FROM e WHERE len(e) >= 2)",
    "adj_p4_specs": f"WITH {_F}, j AS (SELECT DISTINCT cycle_id FROM cycle_jobs) SELECT j.cycle_id, count(file_id) FILTER (c <> '') AS loaded, count(file_id) FILTER (c = '') AS missing FROM j LEFT JOIN f USING (cycle_id) GROUP BY 1",
    "m2_snippets": rf"WITH {_F}, q AS (SELECT file_id, path, regexp_replace(content, '\r\n?', chr(10), 'g') AS x, floor({int(4096 * 0.5) * 4} / count(*) OVER (PARTITION BY cycle_id))::INT AS most FROM f), h AS (SELECT *, x[:floor((most - 100) * 0.6::DOUBLE)::INT] AS h0, right(x, floor((most - 100) * 0.4::DOUBLE)::INT) AS t0 FROM q WHERE x <> ''), k AS (SELECT *, CASE WHEN instr(h0, chr(10)) > 1 THEN regexp_replace(h0, '\n[^\n]*$', '') ELSE h0 END AS h1, CASE WHEN instr(t0, chr(10)) > 1 THEN regexp_replace(t0, '^[^\n]*\n', '') ELSE t0 END AS t1 FROM h), n AS (SELECT *, {_SPLIT.replace('{x}', 'x')} AS xl, {_SPLIT.replace('{x}', 'h1')} AS hl, {_SPLIT.replace('{x}', 't1')} AS tl FROM k) SELECT file_id, md5('--- FILE: ' || coalesce(path, 'unknown') || ' ---' || chr(10) || CASE WHEN length(x) > most THEN {_NUM.replace('{l}', 'hl').replace('{first}', '1')} || chr(10) || '     | ... (' || (len(xl) - len(hl) - len(tl)) || ' lines omitted, lines ' || (len(hl) + 1) || '-' || (len(xl) - len(tl)) || ') ...' || chr(10) || {_NUM.replace('{l}', 'tl').replace('{first}', '(len(xl) - len(tl) + 1)')} ELSE {_NUM.replace('{l}', 'xl').replace('{first}', '1')} END) AS digest FROM n",
    "m12_examples": rf"WITH s AS (SELECT DISTINCT coalesce(nullif(regexp_replace(lower(trim(strategy)), '[\s-]+', '_', 'g'), ''), 'unknown') AS strategy FROM attempts) SELECT strategy, {_EX.replace('{s}', 'strategy')} AS example FROM s",
    "m3_suggested": f"WITH k9 AS ({_SUGGESTED['k9_report']}), pp AS ({_SUGGESTED['adj_p10_suggestions']}), c AS (SELECT proposal_id, count(*) AS suggestions, count(*) FILTER (regexp_matches(places, '(^|,)0-')) AS unplaced FROM pp GROUP BY 1) SELECT proposal_id, digest, coalesce(suggestions, 0) AS suggestions, coalesce(unplaced, 0) AS unplaced FROM k9 LEFT JOIN c USING (proposal_id)",
    "m10_prompts": "",
    "m17_explained": f"WITH px0 AS ({eq.SQL['adj_p15_explanation']}), l AS (SELECT cycle_id, arg_max_null(approved, attempt_id) AS ok FROM attempts GROUP BY 1) SELECT px0.* FROM px0 JOIN l USING (cycle_id) WHERE ok",
    "m18_failures": f"WITH k11 AS ({eq.SQL['k11_failure_report']}) SELECT * FROM k11 WHERE cycle_id IN (SELECT cycle_id FROM proposals)",
    "adj_p7_descriptions": f"WITH {_J} SELECT cycle_id, CASE WHEN len(graph.nodes) = 2 THEN 'Direct circular dependency between ' || graph.nodes[1] || ' and ' || graph.nodes[2] ELSE 'Circular dependency chain: ' || array_to_string(graph.nodes || [graph.nodes[1]], ' → ') END AS description FROM j WHERE len(graph.nodes) > 0",
    "x19_import_lines": f"WITH {_F}, q AS (SELECT ext, CASE " + " ".join(f"WHEN ext = '{e}' THEN list_distinct(regexp_extract_all(c, '{rx}'))" for e, rx in t.IMPORT_LINES.items()) + " ELSE [] END AS l FROM f), u AS (SELECT ext, unnest(l) AS line FROM q) SELECT ext, line, count(*) AS files FROM u GROUP BY 1, 2",
    "x49_diagnostics": rf"WITH {eq._PX}, q AS (SELECT coalesce(original, '') AS a, patched AS b, [x for x in list_distinct(regexp_extract_all(patched, '\bI[A-Z][a-zA-Z0-9]*\b')) if not list_contains(regexp_extract_all(coalesce(original, ''), '\bI[A-Z][a-zA-Z0-9]*\b') || {_TYPES.replace('{c}', 'patched')}, x)] AS n FROM px WHERE patched <> ''), u AS (SELECT 'no change' AS note FROM q WHERE a = b UNION ALL SELECT 'blanks only' FROM q WHERE a <> b AND regexp_replace(a, '\s+', '', 'g') = regexp_replace(b, '\s+', '', 'g') UNION ALL SELECT 'unknown ' || unnest(n) FROM q) SELECT note, count(*) AS patches FROM u GROUP BY 1",
    "w11_errors": f"WITH {_F}, q AS (SELECT file_id, string_split(content, chr(10)) AS l FROM f WHERE content IS NOT NULL), u AS (SELECT file_id, (i - 1)::INT AS n, l[i] AS line FROM q, unnest(range(1, len(l) + 1)) t(i)) SELECT * FROM u WHERE regexp_matches(line, 'ERROR|Traceback|Exception') ORDER BY file_id DESC, n DESC LIMIT 10",
    "y24_summaries": f"WITH {_F} SELECT CASE WHEN json_valid(CASE WHEN starts_with(content, chr(65279)) THEN content[2:] ELSE content END) THEN 'ok' ELSE '1 error(s), 0 warning(s)' END AS summary, count(*) AS files FROM f WHERE ext = 'json' AND content <> '' GROUP BY 1",
    "y23_cycles": "WITH j AS (SELECT cycle_id, any_value(project) AS project FROM cycle_jobs GROUP BY 1), n AS (SELECT project, count(*) AS n FROM j GROUP BY 1) SELECT p.project, coalesce(n, 0) AS cycles, coalesce(n, 0) > 0 AS has_cycles FROM projects p LEFT JOIN n USING (project)",
}
SQL["m10_prompts"] = (
    f"WITH {bq._A}, {bq._X27.replace(_J + ', ', '', 1).replace(_F + ', ', '', 1)}, g AS (SELECT cycle_id, string_agg(text, chr(10) || chr(10) ORDER BY status <> 'full', size, file_id) AS t FROM sh WHERE status <> 'empty' AND text <> '' GROUP BY 1), q AS (SELECT az.cycle_id, 'Strategy: ' || {_STRAT} || chr(10) || 'Nodes: ' || array_to_string(j.graph.nodes, ', ') || chr(10) || 'Hints: ' || array_to_string({bq._HINTS}, '; ') || chr(10) || 'Example: ' || {_EX.replace('{s}', '(' + _STRAT + ')')} || chr(10) || chr(10) || coalesce(t, '') AS x FROM az JOIN j ON j.cycle_id = az.cycle_id LEFT JOIN g ON g.cycle_id = az.cycle_id) SELECT cycle_id, md5(CASE WHEN length(x) > 20000 THEN x[:19900] || chr(10) || chr(10) || '... [cut]' ELSE x END) AS digest FROM q"
)
