"""Queries over what answers suggest, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as a
from ..functions import text as t
from ..operators import suggestions as s
from ..tables import clean_path, load, once
from .answer_queries import _ANS
from .extra_queries import _F, _J, _TYPES


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "proposals", "proposal_id", "cycle_id", "llm_response").where("llm_response is not null")


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    f = load(spark, sf, "cycle_files", "cycle_id", "ord", "path", "content").withColumn("path", clean_path(F.col("path")))
    return s.suggestions(_answers(spark, sf), f)


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    """One row per answer with a payload, with its suggestions as an array."""
    p = once(_answers(spark, sf).select("proposal_id", "cycle_id", a.parsed(F.col("llm_response")).alias("j"), "llm_response").where("j is not null"), "proposal_id")
    g = _rows(spark, sf).groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct(~F.col("is_new"), "pos", "path", "is_new", "codes", "confidence"))).alias("s"))
    empty = F.array().cast(g.schema["s"].dataType)
    strategy = F.coalesce("j.strategy_used", "j.strategy", F.lit("unknown"))
    return p.join(g, "proposal_id", "left").select("proposal_id", "cycle_id", "llm_response", strategy.alias("strategy"), F.coalesce("j.reasoning", "j.rationale", F.lit("")).alias("rationale"), F.coalesce("s", empty).alias("s"))


def adj_p10_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Every suggestion with its places and its confidence."""
    return _rows(spark, sf).select("proposal_id", "pos", "path", "is_new", F.size("codes").alias("changes"), F.array_join(F.transform("codes", lambda c: F.concat(c["first"].cast("string"), F.lit("-"), c["last"].cast("string"))), ",").alias("places"), "confidence")


def _summary(sets: DataFrame) -> DataFrame:
    paths = lambda new: F.array_distinct(F.transform(F.filter("s", lambda x: x["is_new"] == new), lambda x: x["path"]))
    marked = F.transform("s", lambda x: F.struct(x["is_new"].alias("is_new"), x["path"].alias("path"), x["codes"].alias("codes"), F.col("strategy").alias("strategy")))
    conf = s.overall(F.transform("s", lambda x: x["confidence"]), F.exists("s", lambda x: x["is_new"]), F.lit(0))
    return sets.select("*", paths(True).alias("create"), paths(False).alias("modify"), F.round(conf, 6).alias("confidence"), s.breaks_cycle(marked).alias("broken"))


def a14_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """How sure each answer is as a whole; answers that can't be read are 0."""
    read = _summary(_sets(spark, sf)).select("proposal_id", "confidence")
    all_ = once(_answers(spark, sf).select("proposal_id"), "proposal_id")
    return all_.join(read, "proposal_id", "left").select("proposal_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def adj_p11_guidance(spark: SparkSession, sf: str) -> DataFrame:
    """How hard each answer is to carry out; complex where it can't be read."""
    n = _summary(_sets(spark, sf)).select("proposal_id", s.difficulty(F.size("create"), F.size("modify")).alias("difficulty"))
    all_ = once(_answers(spark, sf).select("proposal_id"), "proposal_id")
    return all_.join(n, "proposal_id", "left").groupBy(F.coalesce("difficulty", F.lit("complex")).alias("difficulty")).agg(F.count("*").alias("answers"))


def x23_broken(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each answer looks as if it broke its cycle."""
    return _summary(_sets(spark, sf)).select("proposal_id", "broken")


REFERENCED = r"\b(?:new|extends|implements)\s+([A-Z]\w*)"


def u4_missing_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types that an answer's suggestions refer to and neither its cycle's files nor the suggestions define."""
    code = F.array_join(F.transform("codes", lambda c: c["after"]), "\n")
    all_ = _rows(spark, sf).select("proposal_id", "cycle_id", F.concat_ws("\n", code, "content").alias("x"))
    g = all_.select("proposal_id", "cycle_id", F.regexp_extract_all("x", F.lit(REFERENCED), F.lit(1)).alias("r"), t.defined_types(F.col("x")).alias("d"))
    ref = g.select("proposal_id", "cycle_id", F.explode("r").alias("name")).distinct()
    own = g.select("proposal_id", F.explode("d").alias("name")).distinct()
    defined = load(spark, sf, "cycle_files", "cycle_id", "content").select("cycle_id", F.explode(t.defined_types(F.col("content"))).alias("name")).distinct()
    return ref.join(own, ["proposal_id", "name"], "left_anti").join(defined, ["cycle_id", "name"], "left_anti").select("proposal_id", "name")


def x24_validated(spark: SparkSession, sf: str) -> DataFrame:
    """Each suggestion with its note: unplaced changes, changes that change nothing, or fine."""
    note = F.when(F.exists("codes", lambda c: c["first"] == 0), "not found in the file").when(F.exists("codes", lambda c: (c["before"] != "") & (F.trim(c["before"]) == F.trim(c["after"]))), "changes nothing").otherwise("fine")
    return _rows(spark, sf).groupBy(note.alias("note")).agg(F.count("*").alias("suggestions"))


def adj_hotspot(spark: SparkSession, sf: str) -> DataFrame:
    return s.cycle_context(once(load(spark, sf, "cycle_jobs", "cycle_id", "graph"), "cycle_id"))


def k9_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report of every answer that can be read."""
    jobs = once(load(spark, sf, "cycle_jobs", "cycle_id", "graph"), "cycle_id")
    head = _summary(_sets(spark, sf)).withColumnRenamed("proposal_id", "id").withColumnRenamed("llm_response", "answer")
    head = head.join(s.cycle_context(jobs), "cycle_id").join(jobs.select("cycle_id", F.col("graph.nodes").alias("nodes"), F.col("graph.edges").alias("edges")), "cycle_id")
    return s.report(head).select(F.col("id").alias("proposal_id"), F.md5("report").alias("digest"))


def k12_json(spark: SparkSession, sf: str) -> DataFrame:
    """Cycle jobs as JSON objects."""
    j = once(load(spark, sf, "cycle_jobs", "cycle_id", "graph", "severity"), "cycle_id")
    return j.select("cycle_id", F.to_json(F.struct(F.col("cycle_id").alias("id"), "graph", "severity"), {"ignoreNullFields": "false"}).alias("json"))


def j16_missing_search(spark: SparkSession, sf: str) -> DataFrame:
    """Search texts of suggestions that their file doesn't hold, blanks aside."""
    lost = F.filter("codes", lambda c: c["first"] == 0)
    return _rows(spark, sf).where(F.size(lost) > 0).select("proposal_id", "pos", F.size(lost).alias("missing"))


def adj_p24_scaffolds(spark: SparkSession, sf: str) -> DataFrame:
    """New files that an answer wants and that are abstractions: of all proposed files, those whose purpose, else path, says so."""
    j = once(_answers(spark, sf).select("proposal_id", F.try_parse_json(a.payload(F.col("llm_response"))).alias("v")).where("v is not null"), "proposal_id")
    x = j.select("proposal_id", F.from_json(F.to_json("v"), "struct<new_files: array<struct<path: string, purpose: string>>, patches: array<struct<path: string, purpose: string>>>").alias("x"))
    rows = x.select("proposal_id", F.explode(F.concat(F.coalesce("x.new_files", F.array().cast("array<struct<path: string, purpose: string>>")), F.coalesce("x.patches", F.array().cast("array<struct<path: string, purpose: string>>")))).alias("f")).select("proposal_id", "f.*")
    return rows.where(F.lower(F.coalesce(F.nullif("purpose", F.lit("")), "path")).rlike("interface|abstract|contract|shared|common")).select("proposal_id", "path").distinct()


QUERIES = {f.__name__: f for f in (adj_p10_suggestions, a14_confidence, adj_p11_guidance, x23_broken, u4_missing_types, x24_validated, adj_hotspot, k9_report, k12_json, j16_missing_search, adj_p24_scaffolds)}

# ----------------------------------------------------------------------------------------------------------- SQL
_ENTRY = '[{"path":"VARCHAR","patched":"VARCHAR","prepend":"VARCHAR","search_replace":[{"search":"VARCHAR","replace":"VARCHAR"}]}]'
_SCHEMA = '{"strategy_used":"VARCHAR","strategy":"VARCHAR","reasoning":"VARCHAR","rationale":"VARCHAR","new_files":[{"path":"VARCHAR","content":"VARCHAR","purpose":"VARCHAR"}],"changes":' + _ENTRY + ',"patches":' + _ENTRY + "}"
_NLS = "(length({x}) - length(replace({x}, chr(10), '')))"
_SQZ = r"regexp_replace({x}, '[ \t]+', ' ', 'g')"
_ROWS = rf"""{_ANS.replace("any_value(llm_response) AS x", "any_value(llm_response) AS x, any_value(cycle_id) AS cycle_id").replace("SELECT proposal_id, x,", "SELECT proposal_id, cycle_id, x,")}, js AS (SELECT *, from_json(j, '{_SCHEMA}') AS s FROM a WHERE j IS NOT NULL), {_F},
 ch0 AS (SELECT proposal_id, cycle_id, coalesce(s.changes, s.patches) AS l FROM js), ch AS (SELECT proposal_id, cycle_id, (i - 1)::INT AS pos, l[i] AS e FROM ch0, unnest(range(1, len(l) + 1)) u(i) WHERE l[i].path <> ''),
 nf AS (SELECT proposal_id, cycle_id, (i - 1)::INT AS pos, s.new_files[i] AS e FROM js, unnest(range(1, len(s.new_files) + 1)) u(i) WHERE s.new_files[i].path <> ''),
 own AS (SELECT proposal_id, pos, arg_min(coalesce(content, ''), (ord, cp)) AS c0 FROM ch JOIN f ON f.cycle_id = ch.cycle_id AND (f.cp = e.path OR ends_with(f.cp, e.path)) GROUP BY 1, 2), k AS (SELECT ch.*, coalesce(c0, '') AS old FROM ch LEFT JOIN own USING (proposal_id, pos)),
 co0 AS (SELECT proposal_id, pos, 0 AS n, 1 AS first, 1 AS last, '' AS before, e.prepend AS after FROM k WHERE coalesce(e.prepend, '') <> '' UNION ALL
  SELECT proposal_id, pos, n, f1, CASE WHEN f1 > 0 THEN f1 + {_NLS.replace('{x}', 'q')} ELSE 0 END, q, r FROM (SELECT *, CASE WHEN old = '' THEN 0 WHEN instr(old, q) > 0 THEN {_NLS.replace('{x}', 'old[:instr(old, q) - 1]')} + 1 WHEN instr({_SQZ.replace('{x}', 'old')}, {_SQZ.replace('{x}', 'q')}) > 0 THEN {_NLS.replace('{x}', _SQZ.replace('{x}', 'old') + "[:instr(" + _SQZ.replace('{x}', 'old') + ", " + _SQZ.replace('{x}', 'q') + ") - 1]")} + 1 ELSE 0 END AS f1
   FROM (SELECT proposal_id, pos, i AS n, old, e.search_replace[i].search AS q, coalesce(e.search_replace[i].replace, '') AS r FROM k, unnest(range(1, len(e.search_replace) + 1)) u(i) WHERE coalesce(e.search_replace[i].search, '') <> '')) UNION ALL
  SELECT proposal_id, pos, 0, 1, greatest(CASE WHEN old = '' THEN 0 ELSE len(string_split(regexp_replace(old, '\n$', ''), chr(10))) END, 1), '', e.patched FROM k WHERE e.patched IS NOT NULL AND len(coalesce(e.search_replace, [])) = 0),
 cg AS (SELECT proposal_id, pos, count(*)::INT AS changes, string_agg(first || '-' || last, ',' ORDER BY n) AS places, bool_or(first = 0) AS lost, bool_or(before <> '' AND trim(before, ' ') = trim(after, ' ')) AS idle FROM co0 GROUP BY 1, 2),
 rw AS (SELECT k.proposal_id, k.cycle_id, k.pos, k.e.path AS path, false AS is_new, coalesce(changes, 0) AS changes, coalesce(places, '') AS places, CASE WHEN changes IS NULL THEN 0.3 WHEN lost THEN 0.6 ELSE 0.85 END::DOUBLE AS confidence, coalesce(lost, false) AS lost, coalesce(idle, false) AS idle FROM k LEFT JOIN cg USING (proposal_id, pos)
  UNION ALL SELECT proposal_id, cycle_id, pos, e.path, true, 0, '', CASE WHEN coalesce(e.content, '') <> '' THEN 0.9 ELSE 0.5 END::DOUBLE, false, false FROM nf)"""
_SUM = f"{_ROWS}, sm AS (SELECT js.proposal_id, js.cycle_id, x, coalesce(s.strategy_used, s.strategy, 'unknown') AS strategy, coalesce(s.reasoning, s.rationale, '') AS rationale FROM js), pc AS (SELECT proposal_id, [y.p for y in list_sort(list({{'pos': pos, 'p': path}}) FILTER (is_new))] AS c0, [y.p for y in list_sort(list({{'pos': pos, 'p': path}}) FILTER (NOT is_new))] AS m0, avg(confidence) AS mean, bool_or(is_new) AS any_new FROM rw GROUP BY 1)"
_UNIQ = "[y.x for y in [{{'x': {l}[i], 'i': i}} for i in range(1, len({l}) + 1)] if list_position({l}, y.x) = y.i]"
_LOWIMP = "(contains(lower({x}), 'import') OR contains(lower({x}), 'using'))"
_BROKEN = rf"""bk AS (SELECT proposal_id, bool_or((contains(lower(before), 'import') AND NOT contains(lower(after), 'import')) OR (contains(lower(before), 'using') AND NOT contains(lower(after), 'using'))) AS out_, bool_or(regexp_matches(before, '\b[A-Z]\w+\b') AND regexp_matches(after, '\bI[A-Z]\w+\b')) AS swapped, bool_or({_LOWIMP.replace('{x}', 'after')} OR regexp_matches(after, ': I[A-Z]\w+')) AS imp,
 bool_or(contains(before, '(') AND contains(after, '(') AND length(after) - length(replace(after, ',', '')) > length(before) - length(replace(before, ',', ''))) AS inj FROM co0 GROUP BY 1), nw AS (SELECT proposal_id, bool_or(is_new AND contains(lower(path), 'interface')) AS n FROM rw GROUP BY 1),
 bb AS (SELECT sm.proposal_id, coalesce(n AND imp, false) OR coalesce(out_, false) OR coalesce(swapped, false) OR coalesce(inj AND strategy IN ('parameter_injection', 'lazy_import'), false) AS broken FROM sm LEFT JOIN bk USING (proposal_id) LEFT JOIN nw USING (proposal_id))"""
_HOT = f"e1 AS (SELECT cycle_id, i, graph.edges[i] AS e FROM j, unnest(range(1, len(graph.edges) + 1)) u(i) WHERE len(graph.edges[i]) >= 2), en AS (SELECT cycle_id, 2 * i AS at0, e[1] AS node FROM e1 UNION ALL SELECT cycle_id, 2 * i + 1, e[2] FROM e1), hc AS (SELECT cycle_id, node, count(*) AS n, min(at0) AS at0 FROM en GROUP BY 1, 2), hs AS (SELECT cycle_id, arg_min(node, (-n, at0)) AS hotspot FROM hc GROUP BY 1), cx AS (SELECT j.cycle_id, CASE len(graph.nodes) WHEN 2 THEN 'bidirectional' WHEN 3 THEN 'triangle' ELSE 'multi-node' END AS cycle_type, hotspot, graph FROM j LEFT JOIN hs USING (cycle_id))"
SQL = {
    "adj_p10_suggestions": f"WITH {_ROWS} SELECT proposal_id, pos, path, is_new, changes, places, confidence FROM rw",
    "a14_confidence": f"WITH {_SUM} SELECT proposal_id, CASE WHEN mean IS NULL THEN 0.0::DOUBLE ELSE round(greatest(0.0, least(1.0, mean + CASE WHEN any_new THEN 0.05 ELSE 0.0 END))::DOUBLE, 6) END AS confidence FROM a LEFT JOIN pc USING (proposal_id) WHERE x IS NOT NULL",
    "adj_p11_guidance": f"WITH {_SUM}, z AS (SELECT a.proposal_id, sm.proposal_id IS NOT NULL AS ok, coalesce(len(list_distinct(c0)), 0) AS c, coalesce(len(list_distinct(m0)), 0) AS m FROM a LEFT JOIN sm USING (proposal_id) LEFT JOIN pc USING (proposal_id) WHERE a.x IS NOT NULL) SELECT CASE WHEN NOT ok THEN 'complex' WHEN c + m <= 2 AND c = 0 THEN 'easy' WHEN c + m <= 4 OR c > 0 THEN 'moderate' ELSE 'complex' END AS difficulty, count(*) AS answers FROM z GROUP BY 1",
    "x23_broken": f"WITH {_SUM}, {_BROKEN} SELECT * FROM bb",
    "x24_validated": f"WITH {_ROWS} SELECT CASE WHEN lost THEN 'not found in the file' WHEN idle THEN 'changes nothing' ELSE 'fine' END AS note, count(*) AS suggestions FROM rw GROUP BY 1",
    "u4_missing_types": rf"WITH {_ROWS}, tx AS (SELECT proposal_id, after AS x FROM co0 UNION ALL SELECT proposal_id, e.content FROM nf), rf AS (SELECT DISTINCT proposal_id, unnest(regexp_extract_all(x, '{REFERENCED}', 1)) AS name FROM tx), dn AS (SELECT DISTINCT proposal_id, unnest({_TYPES.replace('{c}', 'x')}) AS name FROM tx), cd AS (SELECT DISTINCT cycle_id, unnest({_TYPES.replace('{c}', 'c')}) AS name FROM f) SELECT rf.proposal_id, rf.name FROM rf JOIN a USING (proposal_id) WHERE NOT EXISTS (SELECT 1 FROM dn WHERE dn.proposal_id = rf.proposal_id AND dn.name = rf.name) AND NOT EXISTS (SELECT 1 FROM cd WHERE cd.cycle_id = a.cycle_id AND cd.name = rf.name)",
    "adj_hotspot": f"WITH {_J}, {_HOT} SELECT cycle_id, cycle_type, hotspot FROM cx",
    "k9_report": f"WITH {_SUM}, {_BROKEN}, {_J}, {_HOT}, z AS (SELECT sm.*, broken, CASE WHEN mean IS NULL THEN 0.0::DOUBLE ELSE round(greatest(0.0, least(1.0, mean + CASE WHEN any_new THEN 0.05 ELSE 0.0 END))::DOUBLE, 6) END AS conf, {_UNIQ.format(l='coalesce(c0, [])')} AS c1, {_UNIQ.format(l='coalesce(m0, [])')} AS m1, cycle_type, hotspot, graph FROM sm JOIN cx USING (cycle_id) JOIN bb USING (proposal_id) LEFT JOIN pc USING (proposal_id)), y AS (SELECT *, {_UNIQ.format(l='(c1 || m1)')} AS o1 FROM z)"
    " SELECT proposal_id, md5(concat_ws(chr(10) || chr(10), '# Suggestions: ' || cycle_id, '| Metric | Value |' || chr(10) || '|---|---|' || chr(10) || '| Strategy | ' || coalesce(nullif(strategy, ''), 'not given') || ' |' || chr(10) || '| Confidence | ' || floor(conf * 100 + 0.5)::BIGINT || '% |' || chr(10) || '| Cycle broken | ' || CASE WHEN broken THEN 'yes' ELSE 'to be verified' END || ' |' || chr(10) || '| Files to create | ' || len(c1) || ' |' || chr(10) || '| Files to modify | ' || len(m1) || ' |',"
    " CASE WHEN rationale <> '' THEN 'Rationale: ' || rationale END, '## The cycle' || chr(10) || 'Type: ' || cycle_type, 'Most connected: `' || hotspot || '`', CASE WHEN len(graph.nodes) > 0 THEN 'Nodes:' || chr(10) || array_to_string(['- `' || w || '`' for w in graph.nodes], chr(10)) END, CASE WHEN len([w for w in graph.edges if len(w) >= 2]) > 0 THEN 'Edges:' || chr(10) || array_to_string(['  ' || w[1] || ' → ' || w[2] for w in graph.edges if len(w) >= 2], chr(10)) END,"
    " CASE WHEN len(c1) > 0 THEN '## To create' || chr(10) || array_to_string(['- `' || w || '`' for w in c1], chr(10)) END, CASE WHEN len(m1) > 0 THEN '## To modify' || chr(10) || array_to_string(['- `' || w || '`' for w in m1], chr(10)) END, CASE WHEN len(o1) > 0 THEN '## Order' || chr(10) || array_to_string([i || '. `' || o1[i] || '`' for i in range(1, len(o1) + 1)], chr(10)) END,"
    " CASE WHEN x <> '' THEN '## Answer' || chr(10) || CASE WHEN length(x) > 5000 THEN x[:5000] || chr(10) || '... (' || (length(x) - 5000) || ' more characters)' ELSE x END END)) AS digest FROM y",
    "j16_missing_search": f"WITH {_ROWS} SELECT proposal_id, pos, count(*)::INT AS missing FROM co0 WHERE first = 0 GROUP BY 1, 2",
    "k12_json": "WITH j AS (SELECT cycle_id, any_value(graph) AS graph, any_value(severity) AS severity FROM cycle_jobs GROUP BY 1) SELECT cycle_id, to_json({'id': cycle_id, 'graph': graph, 'severity': severity})::VARCHAR AS json FROM j",
    "adj_p24_scaffolds": f"WITH {_ANS}, js AS (SELECT proposal_id, from_json(j, '{{\"new_files\":[{{\"path\":\"VARCHAR\",\"purpose\":\"VARCHAR\"}}],\"patches\":[{{\"path\":\"VARCHAR\",\"purpose\":\"VARCHAR\"}}]}}') AS s FROM a WHERE j IS NOT NULL), r AS (SELECT proposal_id, unnest(coalesce(s.new_files, []) || coalesce(s.patches, [])) AS e FROM js) SELECT DISTINCT proposal_id, e.path AS path FROM r WHERE regexp_matches(lower(coalesce(nullif(e.purpose, ''), e.path)), 'interface|abstract|contract|shared|common')",
}
