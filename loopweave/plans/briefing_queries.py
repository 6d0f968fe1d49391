"""Queries over what is told about a cycle, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import briefing as b
from ..operators import rules
from ..tables import load, once
from .extra_queries import _F, _J


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    return once(load(spark, sf, "cycle_jobs", "cycle_id", "graph", "summary"), "cycle_id")


def _analysis(spark: SparkSession, sf: str) -> DataFrame:
    return b.analysis(_jobs(spark, sf), load(spark, sf, "cycle_files", "cycle_id", "content"))


def x33_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf)


def x36_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf).select("cycle_id", "pattern", F.posexplode(b.keywords()).alias("pos", "keyword"))


def x37_queries(spark: SparkSession, sf: str) -> DataFrame:
    """What to look up for each cycle and intent; hints come from its summary."""
    j = _analysis(spark, sf).join(_jobs(spark, sf).select("cycle_id", "summary"), "cycle_id")
    every = F.array(*[F.struct(F.lit(i).alias("intent"), b.lookups(i, F.col("summary")).alias("q")) for i in b.LOOKUPS])
    return j.select("cycle_id", F.inline(every)).select("cycle_id", "intent", F.posexplode("q").alias("pos", "query"))


def x38_strategy_words(spark: SparkSession, sf: str) -> DataFrame:
    """Strategies that proposals' rationales speak of."""
    p = once(load(spark, sf, "proposals", "proposal_id", "rationale"), "proposal_id")
    return p.select("proposal_id", F.explode(b.tried(F.col("rationale"))).alias("strategy"))


def x39_hints(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf).select("cycle_id", F.posexplode(b.hints()).alias("pos", "hint"))


def adj_p8_context(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf).select("cycle_id", b.context_lines().alias("context"))


def m16_description(spark: SparkSession, sf: str) -> DataFrame:
    """What a describer says without a model: the summary, else the analysis, then the hints."""
    j = _analysis(spark, sf).join(_jobs(spark, sf).select("cycle_id", "summary"), "cycle_id")
    return j.select("cycle_id", F.concat_ws("\n\n", F.coalesce(F.nullif("summary", F.lit("")), b.context_lines()), F.array_join(b.hints(), "\n")).alias("text"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "cycle_files", "file_id", "cycle_id", "path", "content")


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf).select("cycle_id", F.col("graph.nodes").alias("nodes"))


def x25_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """What is shown of each file in 2,000 characters."""
    f = _files(spark, sf).join(_nodes(spark, sf), "cycle_id")
    return once(b.with_snippet(f, F.col("path"), F.col("content"), F.col("nodes"), F.lit(2000)).select("file_id", F.md5("snippet").alias("digest")), "file_id")


def x27_shown(spark: SparkSession, sf: str) -> DataFrame:
    """Which files of a cycle are shown whole and how much of the others, in 12,000 characters."""
    f = once(_files(spark, sf), "file_id")
    return b.shown(f, _nodes(spark, sf), "cycle_id", "file_id", 12_000).select("file_id", "status", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


def m9_prompt_files(spark: SparkSession, sf: str) -> DataFrame:
    """The file section of each cycle's prompt: what is shown whole, then the snippets, smallest first; within its room."""
    s = b.shown(once(_files(spark, sf), "file_id"), _nodes(spark, sf), "cycle_id", "file_id", 12_000).where("status <> 'empty' and text <> ''")
    part = F.concat(F.lit("--- FILE: "), F.coalesce("path", F.lit("unknown")), F.when(F.col("status") == "full", " (COMPLETE) ---\n").otherwise(" (SNIPPET) ---\n"), "text")
    g = s.groupBy("cycle_id").agg(F.array_sort(F.collect_list(F.struct((F.col("status") != "full").alias("k"), "size", "file_id", part.alias("p")))).alias("x"))
    return g.select("cycle_id", F.md5(F.array_join(F.transform("x", lambda y: y["p"]), "\n\n")).alias("digest"))


def w4_parts(spark: SparkSession, sf: str) -> DataFrame:
    """How much of its long files a cycle's snippets keep."""
    f = _files(spark, sf).join(_nodes(spark, sf), "cycle_id").where(F.length("content") > 2000)
    s = once(b.with_snippet(f, F.col("path"), F.col("content"), F.col("nodes"), F.lit(2000)).select("file_id", "cycle_id", F.length("content").alias("n"), F.length("snippet").alias("m")), "file_id")
    return s.groupBy("cycle_id").agg(F.count("*").alias("files"), F.sum("n").alias("chars"), F.sum("m").alias("shown"))


QUERIES = {f.__name__: f for f in (x33_analysis, x36_keywords, x37_queries, x38_strategy_words, x39_hints, adj_p8_context, m16_description, x25_snippets, x27_shown, m9_prompt_files, w4_parts)}

# ----------------------------------------------------------------------------------------------------------- SQL
_ORDER = list(rules.LAYERS)
_LAYER = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(x), '{w}')" for w in ws) + f" THEN {i}" for i, ws in enumerate(rules.LAYERS.values(), 1)) + " END"
_NAMES = "[" + ", ".join(f"'{x}'" for x in _ORDER) + "]"
_A = f"""{_J.replace("any_value(graph) AS graph", "any_value(graph) AS graph, any_value(summary) AS summary")}, {_F}, fl AS (SELECT cycle_id, bool_or(regexp_matches(c, '{b.INHERITANCE}')) AS h, bool_or(regexp_matches(c, '{b.INTERFACES}')) AS i FROM f GROUP BY 1),
 ly AS (SELECT cycle_id, list_distinct([y for y in [{_LAYER} for x in graph.nodes] if y is not null]) AS l FROM j), an AS (SELECT j.cycle_id, j.summary, CASE WHEN len(graph.nodes) = 2 THEN 'bidirectional' WHEN len(graph.nodes) <= 4 THEN 'transitive' WHEN len(graph.edges) > len(graph.nodes) * 1.5 THEN 'star' ELSE 'transitive' END AS cycle_type, len(graph.nodes)::INT AS nodes,
 coalesce(h, false) AS has_inheritance, coalesce(i, false) AS has_interface, CASE WHEN len(l) >= 2 THEN {_NAMES}[list_max(l)] || ' → ' || {_NAMES}[list_min(l)] END AS violation FROM j LEFT JOIN fl USING (cycle_id) LEFT JOIN ly USING (cycle_id)),
 az AS (SELECT *, CASE WHEN violation IS NOT NULL THEN 'layer violation' WHEN has_inheritance THEN 'inheritance coupling' WHEN cycle_type = 'bidirectional' THEN 'mutual dependency' WHEN cycle_type = 'star' THEN 'highly coupled cluster' ELSE 'transitive dependency chain' END AS pattern FROM an)"""
_COND = {"always": "true", "bidirectional": "cycle_type = 'bidirectional'", "transitive": "cycle_type = 'transitive'", "inheritance": "has_inheritance", "interface": "has_interface", "violation": "violation IS NOT NULL", "many": "nodes > 3"}


def _cond(c: str) -> str:
    return f"coalesce(regexp_matches(lower(summary), '{c[5:]}'), false)" if c.startswith("hint:") else _COND[c]


def _list(rows) -> str:
    return "[y for y in [" + ", ".join(f"CASE WHEN {_cond(c)} THEN '{q}' END" for c, q in rows) + "] if y is not null]"


def _unroll(expr: str, name: str, more: str = "") -> str:
    return f"SELECT cycle_id{more}, (i - 1)::INT AS pos, l[i] AS {name} FROM (SELECT *, {expr} AS l FROM az), unnest(range(1, len(l) + 1)) u(i)"


_HINTS = f"CASE WHEN len({_list(b.HINTS)}) = 0 THEN ['{b.GENERAL_HINT}'] ELSE {_list(b.HINTS)} END"
_CTX = "concat_ws(chr(10), 'Cycle Type: ' || cycle_type, 'Node Count: ' || nodes, 'Dominant Pattern: ' || pattern, 'Layer Violation Detected: ' || violation, CASE WHEN has_inheritance THEN 'Inheritance Relationships: Yes' END, CASE WHEN has_interface THEN 'Existing Interfaces: Yes' END)"
_KNOWN = ", ".join(f"'{x}'" for xs in b.LINES for x in xs)
_TOKENS = r"[y for y in (coalesce(nodes, []) || [regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '^(.+)\.[^.]*$', '\1')]) if y <> '']"
_RULES = [(f"(ext IN ({', '.join(repr(x) for x in xs)}))" if xs else f"(ext NOT IN ({_KNOWN}))", f"regexp_matches(line, '{rx.replace(chr(39), chr(39) * 2)}')", bf, af) for xs, rs in b.LINES.items() for rx, bf, af in rs]
_RULES += [("ext = 'py'", f"regexp_extract(line, '{b.PY_IMPORT}', 1) <> '' AND len([y for y in tokens if contains(regexp_extract(line, '{b.PY_IMPORT}', 1), y)]) > 0", 2, 3), ("true", "len([y for y in tokens if contains(line, y)]) > 0", *b.MENTION)]
_WIN = " UNION ALL ".join(f"SELECT file_id, greatest(i - 1 - {bf}, 0) AS s, least(i - 1 + {af}, n) AS e FROM li WHERE {on} AND {hit}" for on, hit, bf, af in _RULES)


def _snip(source: str) -> str:
    """CTEs from ``source(file_id, path, ext, content, nodes, most)`` to ``sn(file_id, text)``."""
    return rf"""sx AS (SELECT *, {_TOKENS} AS tokens, regexp_split_to_array(regexp_replace(content, '\r?\n$', ''), '\r?\n') AS l FROM {source} WHERE length(content) > most),
 li AS MATERIALIZED (SELECT file_id, ext, tokens, i, l[i] AS line, len(l) AS n FROM sx, unnest(range(1, len(l) + 1)) u(i)), wi AS ({_WIN}), w1 AS (SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM wi),
 w2 AS (SELECT *, sum(CASE WHEN s <= top + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM w1), w3 AS (SELECT file_id, min(s) AS s, max(e) AS e FROM w2 GROUP BY file_id, g),
 w4 AS (SELECT w3.file_id, s, array_to_string(l[s + 1:e], chr(10)) AS part, most FROM w3 JOIN sx USING (file_id)), w5 AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY file_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM w4),
 w6 AS (SELECT file_id, string_agg(part, chr(10) || chr(10) || '...' || chr(10) || chr(10) ORDER BY s) AS t FROM w5 WHERE used <= most GROUP BY 1),
 sn AS (SELECT q.file_id, CASE WHEN coalesce(q.content, '') = '' THEN '' WHEN length(q.content) <= q.most THEN q.content WHEN t IS NULL THEN array_to_string(sx.l[:greatest(50, q.most // 80)], chr(10))[:q.most] || chr(10) || '...[truncated]' WHEN length(t) > q.most THEN t[:q.most] || chr(10) || '...[truncated]' ELSE t END AS text FROM {source} q LEFT JOIN sx USING (file_id) LEFT JOIN w6 USING (file_id))"""


_X25 = f"{_J}, {_F}, src AS (SELECT file_id, f.cycle_id, path, ext, content, graph.nodes AS nodes, 2000 AS most FROM f JOIN j USING (cycle_id)), {_snip('src')}"
_X27 = f"""{_J}, {_F}, z1 AS (SELECT file_id, cycle_id, path, ext, content, length(c) AS size FROM f), z2 AS (SELECT *, size > 0 AND size <= 8000 AND sum(CASE WHEN size > 0 AND size <= 8000 THEN size ELSE 0 END) OVER (PARTITION BY cycle_id ORDER BY size, file_id ROWS UNBOUNDED PRECEDING) <= 4800 AS ful FROM z1),
 src AS (SELECT z2.*, graph.nodes AS nodes, least(floor((12000 - sum(CASE WHEN ful THEN size ELSE 0 END) OVER (PARTITION BY z2.cycle_id)) / greatest(sum(CASE WHEN ful THEN 0 ELSE 1 END) OVER (PARTITION BY z2.cycle_id), 1)), 4000)::INT AS most FROM z2 LEFT JOIN j USING (cycle_id)), {_snip('src')},
 sh AS (SELECT file_id, cycle_id, path, size, CASE WHEN ful THEN 'full' WHEN size = 0 THEN 'empty' ELSE 'snippet' END AS status, CASE WHEN ful THEN content ELSE text END AS text FROM src JOIN sn USING (file_id))"""
SQL = {
    "x33_analysis": f"WITH {_A} SELECT cycle_id, cycle_type, nodes, has_inheritance, has_interface, violation, pattern FROM az",
    "x36_keywords": f"WITH {_A} " + _unroll("flatten([" + ", ".join(f"CASE WHEN {_cond(c)} THEN {list(ws)} ELSE [] END" for c, ws in b.KEYWORDS) + "])", "keyword", ", pattern"),
    "x37_queries": f"WITH {_A} " + " UNION ALL ".join(_unroll(_list(rows), "query", f", '{i}' AS intent") for i, rows in b.LOOKUPS.items()),
    "x38_strategy_words": "WITH p AS (SELECT proposal_id, lower(coalesce(any_value(rationale), '')) AS r FROM proposals GROUP BY 1) " + " UNION ALL ".join(f"SELECT proposal_id, '{s}' AS strategy FROM p WHERE regexp_matches(r, '{'|'.join(ws)}')" for s, ws in b.STRATEGY_WORDS.items()),
    "x39_hints": f"WITH {_A} " + _unroll(_HINTS, "hint"),
    "adj_p8_context": f"WITH {_A} SELECT cycle_id, {_CTX} AS context FROM az",
    "m16_description": f"WITH {_A} SELECT cycle_id, coalesce(nullif(summary, ''), {_CTX}) || chr(10) || chr(10) || array_to_string({_HINTS}, chr(10)) AS text FROM az",
    "x25_snippets": f"WITH {_X25} SELECT file_id, md5(text) AS digest FROM sn",
    "x27_shown": f"WITH {_X27} SELECT file_id, status, md5(coalesce(text, '')) AS digest FROM sh",
    "m9_prompt_files": f"WITH {_X27} SELECT cycle_id, md5(string_agg('--- FILE: ' || coalesce(path, 'unknown') || CASE WHEN status = 'full' THEN ' (COMPLETE) ---' ELSE ' (SNIPPET) ---' END || chr(10) || text, chr(10) || chr(10) ORDER BY status <> 'full', size, file_id)) AS digest FROM sh WHERE status <> 'empty' AND text <> '' GROUP BY 1",
    "w4_parts": f"WITH {_X25} SELECT cycle_id, count(*) AS files, sum(length(content))::BIGINT AS chars, sum(length(text))::BIGINT AS shown FROM src JOIN sn USING (file_id) WHERE length(content) > 2000 GROUP BY 1",
}
