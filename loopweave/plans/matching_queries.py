"""Queries over nodes, files and patches that belong together, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as t
from ..operators import context as c
from ..operators import matching as m
from ..tables import clean_path, extension, load, once, project
from .extra_queries import _F, _J, _P, _bal, _note


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    return once(load(spark, sf, "cycle_jobs", "cycle_id", "graph", "severity", "created_at"), "cycle_id")


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf).select("cycle_id", F.posexplode("graph.nodes").alias("pos", "node"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    f = load(spark, sf, "cycle_files", "file_id", "cycle_id", "ord", "path")
    return once(f.withColumn("path", clean_path(F.col("path"))), "file_id")


def _patches(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "patch_results", "patch_id", "cycle_id", "iteration", "path", "original", "patched", "diff", "status")


def j6_node_files(spark: SparkSession, sf: str) -> DataFrame:
    """The file of every node of every job."""
    return m.node_files(_nodes(spark, sf), _files(spark, sf), "cycle_id")


def adj_p23_mapped(spark: SparkSession, sf: str) -> DataFrame:
    """How many of a job's nodes have a file."""
    return j6_node_files(spark, sf).groupBy("cycle_id").agg(F.count("*").alias("nodes"), F.count("path").alias("mapped"))


def j6_file_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return m.file_nodes(_files(spark, sf), _nodes(spark, sf), "cycle_id", "file_id")


def j7_file_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Files by the strict rule: equal names, a leading I, or an end behind a separator."""
    f = _files(spark, sf).withColumn("path", F.regexp_replace("path", "-", ""))
    return m.file_nodes(f, _nodes(spark, sf), "cycle_id", "file_id", strict=True)


def j8_connections(spark: SparkSession, sf: str) -> DataFrame:
    f = _files(spark, sf).withColumn("path", F.regexp_replace("path", "-", ""))
    return m.connected(f, _nodes(spark, sf), "cycle_id", "file_id")


def j5_latest_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Each job as it was delivered last."""
    j = load(spark, sf, "cycle_jobs", "cycle_id", "severity", "ingested_at")
    return j.groupBy("cycle_id").agg(F.max_by(F.struct("severity"), "ingested_at").alias("s"), F.count("*").alias("deliveries")).select("cycle_id", "s.severity", "deliveries")


def j17_file_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """The budget of every patched path: its file's share of 8,000 by length, 4,000 where no file of the cycle fits."""
    f = once(load(spark, sf, "cycle_files", "file_id", "cycle_id", "ord", "path", "content"), "file_id").where("path is not null")
    f = c.proportional(f.select("cycle_id", "file_id", F.col("ord").alias("position"), clean_path(F.col("path")).alias("path"), F.coalesce(F.length("content"), F.lit(0)).alias("n")), "cycle_id", F.col("n"), 8000)
    p = once(_patches(spark, sf).select("patch_id", "cycle_id", clean_path(F.col("path")).alias("path")), "patch_id").where("path is not null")
    return m.file_budgets(p, f, "cycle_id").select("patch_id", F.col("budget").cast("bigint").alias("budget"))


def g10_references(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes whose mention a patch removes or adds."""
    nodes = _jobs(spark, sf).select("cycle_id", F.col("graph.nodes").alias("nodes"))
    i = m.cycle_impact(_patches(spark, sf), nodes, "cycle_id", "patch_id")
    return once(i.select("patch_id", F.array_join("removed", ",").alias("removed"), F.array_join("added", ",").alias("added"), "new_interface"), "patch_id")


def g10_unbroken(spark: SparkSession, sf: str) -> DataFrame:
    """Iterations of a cycle none of whose patches removes a mention."""
    nodes = _jobs(spark, sf).select("cycle_id", F.col("graph.nodes").alias("nodes"))
    p = _patches(spark, sf).withColumn("key", F.concat_ws("#", "cycle_id", F.col("iteration").cast("string")))
    i = m.cycle_impact(p, nodes, "cycle_id", "key")
    return m.unbroken(i, ["key"])


def x14_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the cycle that each file names."""
    f = load(spark, sf, "cycle_files", "file_id", "cycle_id", "content").where("content <> ''")
    j = f.join(_jobs(spark, sf).select("cycle_id", F.col("graph.nodes").alias("nodes")), "cycle_id")
    return once(j.select("file_id", m.mentions(F.col("content"), F.col("nodes")).alias("x")), "file_id").select("file_id", F.explode("x").alias("node"))


def x9_warnings(spark: SparkSession, sf: str) -> DataFrame:
    p = _patches(spark, sf).withColumn("ext", extension(clean_path(F.col("path"))))
    return project(p, "patch_id", "patch_id", m.introduced(F.col("original"), F.col("patched"), F.col("ext")).alias("w")).select("patch_id", F.explode("w").alias("warning"))


def x15_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Syntax issues of patched texts as validation issues: critical for brackets and cut ends, else major."""
    p = _patches(spark, sf).where("patched <> ''").withColumn("ext", extension(clean_path(F.col("path"))))
    none = F.array().cast("array<string>")
    brackets = F.transform(t.bracket_issues(F.col("patched"), F.col("ext")), lambda x: F.concat(F.lit("critical unbalanced "), x["pair"]))
    cut = F.when(t.truncation_note(F.col("patched")).isNotNull(), F.array(F.lit("critical truncated"))).otherwise(none)
    twice = F.when(t.duplicate_line(F.col("patched"), F.col("original")).isNotNull(), F.array(F.lit("major duplicate line"))).otherwise(none)
    i = project(p, "patch_id", "patch_id", F.concat(brackets, cut, twice).alias("i")).select(F.explode("i").alias("issue"))
    return i.groupBy("issue").agg(F.count("*").alias("patches"))


def x16_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Root modules that Python and C# files import."""
    f = load(spark, sf, "cycle_files", "file_id", "path", "content").withColumn("ext", extension(clean_path(F.col("path")))).where("ext in ('py', 'cs')")
    roots = F.array_distinct(F.transform(t.imports(F.col("content"), F.col("ext")), lambda x: F.substring_index(x, ".", 1)))
    return project(f, "file_id", "file_id", "ext", roots.alias("r")).select("ext", F.explode("r").alias("root")).groupBy("ext", "root").agg(F.count("*").alias("files"))


def x11_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles for which an interface extraction was claimed, and whether a patch made an interface."""
    d = load(spark, sf, "minimal_diffs", "cycle_id", "strategy").where(F.regexp_replace(F.lower(F.trim("strategy")), r"[\s-]+", "_") == "interface_extraction").select("cycle_id").distinct()
    p = _patches(spark, sf).select("cycle_id", (F.coalesce("patched", F.lit("")).rlike(r"\binterface\s+\w") & ~F.coalesce("original", F.lit("")).rlike(r"\binterface\s+\w")).alias("made"))
    g = p.groupBy("cycle_id").agg(F.max("made").alias("made"))
    return d.join(g, "cycle_id", "left").select("cycle_id", F.coalesce("made", F.lit(False)).alias("is_valid"))


#: What to do about issues, by what their texts speak of, in order.
ACTIONS = {"no_changes": "change the files that carry the cycle", "cycle": "take out or invert the edge that closes the cycle", "syntax": "mend the syntax first", "import": "bring the imports up to date"}
GENERAL_ACTION = "look at the issues again and make sure that the change breaks the cycle and still parses"


def x13_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What to do about each attempt, by its issues and its suggestions."""
    a = once(load(spark, sf, "attempts", "attempt_id", "issue_types", "suggestions"), "attempt_id")
    none = F.array().cast("array<string>")
    said = F.lower(F.array_join(F.concat(F.coalesce("issue_types", none), F.coalesce("suggestions", none)), "\n"))
    has = {"no_changes": said.contains("no changes"), "cycle": said.contains("cycle"), "syntax": said.contains("syntax") | said.contains("unbalanced"), "import": said.contains("import")}
    has["cycle"] = has["cycle"] & ~has["no_changes"]
    each = F.array_compact(F.array(*[F.when(has[k], F.lit(v)) for k, v in ACTIONS.items()]))
    each = F.when(F.size(each) == 0, F.array(F.lit(GENERAL_ACTION))).otherwise(each)
    return a.select("attempt_id", each.alias("x")).select(F.explode("x").alias("action")).groupBy("action").agg(F.count("*").alias("attempts"))


def x40_bare_brackets(spark: SparkSession, sf: str) -> DataFrame:
    """Curly brackets of each script outside strings and comments."""
    f = load(spark, sf, "cycle_files", "file_id", "path", "content").withColumn("ext", extension(clean_path(F.col("path")))).where("ext in ('ts', 'js', 'mjs', 'java', 'cs') and content is not null")
    bare = F.regexp_replace("content", BARE, " ")
    return project(f, "file_id", "file_id", t.occurrences(bare, "{").alias("opened"), t.occurrences(bare, "}").alias("closed"))


#: Comments and strings; without backtracking, which would take the stack of long strings.
BARE = r"""(?s)//[^\n]*+|/\*.*?(?:\*/|\z)|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|`[^`\\]*+(?:\\.[^`\\]*+)*+`"""


def x51_scaffolds(spark: SparkSession, sf: str) -> DataFrame:
    """Files as new files would be judged: brackets that balance and the constructs that their language asks for."""
    f = load(spark, sf, "cycle_files", "file_id", "path", "content").withColumn("ext", extension(clean_path(F.col("path")))).where("content <> ''")
    c_ = F.col("content")
    unbalanced = F.lit(False)
    for p in t.PAIRS:
        unbalanced = unbalanced | (t.balance(c_, p) != 0)
    lacks = lambda ext, rx, note: F.when(F.col("ext").isin(*ext) & ~c_.rlike(rx), F.lit(note))
    e = F.array_compact(F.array(
        F.when(unbalanced, F.lit("unbalanced")), lacks(("cs",), r"\b(interface|class|struct|record)\s+\w+", "no type"), lacks(("cs",), r"\bnamespace\s+[\w.]+", "no namespace"), lacks(("py",), r"\bclass\s+\w+", "no type"),
        lacks(("ts", "tsx"), r"\b(interface|class|type|abstract class)\s+\w+", "no type"), lacks(("ts", "tsx"), r"\bexport\s+(interface|class|type|abstract)", "not exported"),
        lacks(("java",), r"\b(interface|class|abstract class)\s+\w+", "no type"), lacks(("java",), r"\bpackage\s+[\w.]+;", "no package"),
    ))
    return project(f, "file_id", "file_id", "ext", e.alias("e")).select("ext", F.explode("e").alias("error")).groupBy("ext", "error").agg(F.count("*").alias("files"))


QUERIES = {f.__name__: f for f in (
    j6_node_files, adj_p23_mapped, j6_file_nodes, j7_file_nodes, j8_connections, j5_latest_jobs, j17_file_budgets, g10_references, g10_unbroken, x14_mentions, x9_warnings, x15_issues, x16_roots, x11_claims, x13_actions, x40_bare_brackets, x51_scaffolds,
)}

# ----------------------------------------------------------------------------------------------------------- SQL
_N = f"{_J}, n AS (SELECT cycle_id, (i - 1)::INT AS pos, graph.nodes[i] AS node FROM j, unnest(range(1, len(graph.nodes) + 1)) u(i))"
_BASE = r"regexp_extract({p}, '([^/\\]*)$', 1)"
_STEM2 = r"lower(regexp_replace(regexp_extract({p}, '([^/\\]*)$', 1), '^(.+)\.[^.]*$', '\1'))"
_BARE = r"regexp_replace(lower({x}), '[._]', '', 'g')"
_FITS = "(contains({a}, {b}) OR contains({b}, {a}))"
_D2 = "q AS (SELECT patch_id, any_value(cycle_id) AS cycle_id, any_value(iteration) AS iteration, any_value(original) AS original, any_value(patched) AS patched, any_value(diff) AS diff FROM patch_results GROUP BY 1)"
_WORDS = r"regexp_extract_all(coalesce({t}, ''), '\w+')"


def _has(text: str) -> str:
    return f"[x for x in list_distinct(graph.nodes) if list_contains({_WORDS.replace('{t}', text)}, x)]"


_REFS = f"r AS (SELECT patch_id, q.cycle_id, iteration, graph.nodes AS all_nodes, {_has('original')} AS b, {_has('patched')} AS a, regexp_matches(coalesce(patched, ''), '{m.NEW_INTERFACE}') AND NOT regexp_matches(coalesce(original, ''), '{m.NEW_INTERFACE}') AS made FROM q JOIN j ON j.cycle_id = q.cycle_id WHERE diff <> '')"
_ENDS = "(ends_with({a}, {b}) AND NOT regexp_matches(substring({a}, (length({a}) - length({b}))::INT, 1), '[\\p{L}\\p{N}]'))"
_S, _LOW = _STEM2.replace("{p}", "replace(cp, '-', '')"), "lower(node)"
_ORDERED = "array_to_string([x for x in list_distinct(all_nodes) if list_contains({a}, x) and not list_contains({b}, x)], ',')"
_DUP = "list_min([i for i in range(1, len(l)) if trim(l[i]) <> '' and l[i] = l[i + 1] and not contains(coalesce(original, ''), l[i] || chr(10) || l[i])])"
_PAIR_WARN = " UNION ALL ".join(
    f"SELECT patch_id, CASE WHEN abs({_bal('original', a, b)}) = 0 THEN 'introduced ' ELSE 'worsened ' END || '{a}{b}' AS warning FROM p WHERE coalesce(patched, '') <> '' AND abs({_bal('patched', a, b)}) > abs({_bal('original', a, b)})" + (" AND ext IN ('cs', 'java', 'ts', 'tsx')" if a == "<" else "")
    for a, b in [*t.PAIRS, ("<", ">")]
)
_TRIMMED = "[trim(x) for x in string_split(coalesce({c}, ''), chr(10))]"
_REPEATS = "[a[i] for i in range(1, len(a)) if a[i] = a[i + 1] and length(a[i]) > 3]"
_IMPORT_ROOTS = r"CASE WHEN ext = 'py' THEN [regexp_extract(x, '^[^.]*') for x in regexp_extract_all(c, '(?m)^[ \t]*(?:from|import)[ \t]+([\w.]+)', 1)] ELSE [regexp_extract(x, '^[^.]*') for x in regexp_extract_all(c, '(?m)^[ \t]*using[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;', 1)] END"
_BARE_SQL = BARE.replace("'", "''").replace("*+", "*")


def _lacks(exts: str, rx: str, note: str) -> str:
    return f"SELECT ext, '{note}' AS error FROM f WHERE c <> '' AND ext IN ({exts}) AND NOT regexp_matches(c, '{rx}')"


SQL = {
    "j6_node_files": f"WITH {_N}, {_F}, s AS (SELECT cycle_id, ord, cp, {_BARE.replace('{x}', _STEM2.replace('{p}', 'cp'))} AS s FROM f WHERE path IS NOT NULL), h AS (SELECT n.cycle_id, pos, arg_min(cp, (ord, cp)) AS path FROM n JOIN s ON s.cycle_id = n.cycle_id AND {_FITS.replace('{a}', 's').replace('{b}', _BARE.replace('{x}', 'node'))} GROUP BY 1, 2) SELECT n.cycle_id, n.pos, node, path FROM n LEFT JOIN h ON h.cycle_id = n.cycle_id AND h.pos = n.pos",
    "j6_file_nodes": f"WITH {_N}, {_F}, h AS (SELECT file_id, arg_min(node, pos) AS node FROM f JOIN n ON n.cycle_id = f.cycle_id AND {_FITS.replace('{a}', _STEM2.replace('{p}', 'cp')).replace('{b}', _LOW)} WHERE path IS NOT NULL GROUP BY 1) SELECT f.file_id, h.node FROM f LEFT JOIN h USING (file_id)",
    "j7_file_nodes": f"WITH {_N}, {_F}, h AS (SELECT file_id, arg_min(node, pos) AS node FROM f JOIN n ON n.cycle_id = f.cycle_id AND ({_S} = {_LOW} OR {_S} = 'i' || {_LOW} OR {_LOW} = 'i' || {_S} OR {_ENDS.replace('{a}', _S).replace('{b}', _LOW)} OR {_ENDS.replace('{a}', _LOW).replace('{b}', _S)}) WHERE path IS NOT NULL GROUP BY 1) SELECT f.file_id, h.node FROM f LEFT JOIN h USING (file_id)",
    "j8_connections": f"WITH {_N}, {_F} SELECT DISTINCT file_id, node FROM f JOIN n ON n.cycle_id = f.cycle_id AND node <> '' AND (contains(lower(replace(cp, '-', '')), lower(node)) OR contains(lower(replace(cp, '-', '')), replace(lower(node), '.', '/')))",
    "j5_latest_jobs": "WITH k AS (SELECT *, row_number() OVER (PARTITION BY cycle_id ORDER BY ingested_at DESC) AS r, count(*) OVER (PARTITION BY cycle_id) AS deliveries FROM cycle_jobs) SELECT cycle_id, severity, deliveries FROM k WHERE r = 1",
    "j17_file_budgets": f"WITH {_F}, {_P}, s AS (SELECT cycle_id, ord, cp, greatest(floor(8000.0::DOUBLE * greatest(coalesce(length(content), 0), 1) / sum(greatest(coalesce(length(content), 0), 1)) OVER (PARTITION BY cycle_id))::BIGINT, 500) AS b FROM f WHERE path IS NOT NULL), h AS (SELECT patch_id, arg_min(b, (ord, s.cp, b)) AS b FROM p JOIN s ON s.cycle_id = p.cycle_id AND (p.cp = s.cp OR ends_with(s.cp, {_BASE.replace('{p}', 'p.cp')})) GROUP BY 1) SELECT patch_id, coalesce(h.b, 4000)::BIGINT AS budget FROM p LEFT JOIN h USING (patch_id) WHERE path IS NOT NULL",
    "g10_references": f"WITH {_J}, {_D2}, {_REFS} SELECT patch_id, {_ORDERED.replace('{a}', 'b').replace('{b}', 'a')} AS removed, {_ORDERED.replace('{a}', 'a').replace('{b}', 'b')} AS added, made AS new_interface FROM r".replace("list_contains(a, x) and not list_contains(a, x)", "list_contains(b, x) and not list_contains(a, x)"),
    "g10_unbroken": f"WITH {_J}, {_D2}, {_REFS} SELECT cycle_id || '#' || iteration AS key FROM r GROUP BY 1 HAVING max(len([x for x in b if not list_contains(a, x)])) = 0",
    "x14_mentions": f"WITH {_J}, {_F} SELECT file_id, unnest({_has('f.c')}) AS node FROM f JOIN j ON j.cycle_id = f.cycle_id WHERE c <> ''",
    "x9_warnings": f"WITH {_P}, w AS (SELECT patch_id, 'empty' AS warning FROM p WHERE coalesce(patched, '') = '' UNION ALL {_PAIR_WARN} UNION ALL SELECT patch_id, 'duplicate ' || d FROM (SELECT patch_id, {_DUP} AS d FROM (SELECT *, string_split(patched, chr(10)) AS l FROM p WHERE patched <> '')) WHERE d IS NOT NULL) SELECT * FROM w",
    "x15_issues": f"WITH {_P}, i AS ("
    + " UNION ALL ".join(f"SELECT 'critical unbalanced {a}{b}' AS issue FROM p WHERE patched <> '' AND {_bal('patched', a, b)} <> 0" + (f" AND ext IN {t.ANGLED}" if a == "<" else "") for a, b in [*t.PAIRS, ("<", ">")])
    + f" UNION ALL SELECT 'critical truncated' FROM p WHERE patched <> '' AND {_note('patched')} IS NOT NULL UNION ALL SELECT 'major duplicate line' FROM (SELECT {_REPEATS.replace('a[', 'x1[').replace('len(a)', 'len(x1)')} AS r1, {_REPEATS.replace('a[', 'x0[').replace('len(a)', 'len(x0)')} AS r0 FROM (SELECT {_TRIMMED.replace('{c}', 'patched')} AS x1, {_TRIMMED.replace('{c}', 'original')} AS x0 FROM p WHERE patched <> '')) WHERE len([y for y in r1 if not list_contains(r0, y)]) > 0) SELECT issue, count(*) AS patches FROM i GROUP BY 1",
    "x16_roots": f"WITH {_F}, r AS (SELECT ext, unnest(list_distinct([x for x in {_IMPORT_ROOTS} if x <> ''])) AS root FROM f WHERE ext IN ('py', 'cs')) SELECT ext, root, count(*) AS files FROM r GROUP BY 1, 2",
    "x11_claims": rf"WITH {_D2}, d AS (SELECT DISTINCT cycle_id FROM minimal_diffs WHERE regexp_replace(lower(trim(strategy)), '[\s-]+', '_', 'g') = 'interface_extraction'), g AS (SELECT cycle_id, bool_or(regexp_matches(coalesce(patched, ''), '\binterface\s+\w') AND NOT regexp_matches(coalesce(original, ''), '\binterface\s+\w')) AS made FROM q GROUP BY 1) SELECT d.cycle_id, coalesce(made, false) AS is_valid FROM d LEFT JOIN g USING (cycle_id)",
    "x13_actions": "WITH a AS (SELECT attempt_id, lower(concat_ws(chr(10), array_to_string(any_value(issue_types), chr(10)), array_to_string(any_value(suggestions), chr(10)))) AS s FROM attempts GROUP BY 1), f AS (SELECT attempt_id, contains(s, 'no changes') AS n, contains(s, 'cycle') AND NOT contains(s, 'no changes') AS c, contains(s, 'syntax') OR contains(s, 'unbalanced') AS y, contains(s, 'import') AS i FROM a), x AS ("
    + " UNION ALL ".join(f"SELECT '{v}' AS action FROM f WHERE {k}" for k, v in zip("ncyi", ACTIONS.values(), strict=True))
    + f" UNION ALL SELECT '{GENERAL_ACTION}' FROM f WHERE NOT (n OR c OR y OR i)) SELECT action, count(*) AS attempts FROM x GROUP BY 1",
    "x40_bare_brackets": f"WITH {_F}, b AS (SELECT file_id, regexp_replace(content, '{_BARE_SQL}', ' ', 'g') AS t FROM f WHERE ext IN ('ts', 'js', 'mjs', 'java', 'cs') AND content IS NOT NULL) SELECT file_id, (length(t) - length(replace(t, '{{', '')))::INT AS opened, (length(t) - length(replace(t, '}}', '')))::INT AS closed FROM b",
    "x51_scaffolds": f"WITH {_F}, e AS (SELECT ext, 'unbalanced' AS error FROM f WHERE c <> '' AND ("
    + " OR ".join(f"{_bal('c', a, b)} <> 0" for a, b in t.PAIRS)
    + ") UNION ALL "
    + " UNION ALL ".join([
        _lacks("'cs'", r"\b(interface|class|struct|record)\s+\w+", "no type"), _lacks("'cs'", r"\bnamespace\s+[\w.]+", "no namespace"), _lacks("'py'", r"\bclass\s+\w+", "no type"), _lacks("'ts', 'tsx'", r"\b(interface|class|type|abstract class)\s+\w+", "no type"),
        _lacks("'ts', 'tsx'", r"\bexport\s+(interface|class|type|abstract)", "not exported"), _lacks("'java'", r"\b(interface|class|abstract class)\s+\w+", "no type"), _lacks("'java'", r"\bpackage\s+[\w.]+;", "no package"),
    ])
    + ") SELECT ext, error, count(*) AS files FROM e GROUP BY 1, 2",
}
SQL["adj_p23_mapped"] = f"WITH z AS ({SQL['j6_node_files']}) SELECT cycle_id, count(*) AS nodes, count(path) AS mapped FROM z GROUP BY 1"
