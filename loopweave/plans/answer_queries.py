"""Queries over answers as JSON and over texts found in texts, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as a
from ..functions import text as t
from ..operators import suggestions as s
from ..tables import clean_path, load, once, project
from .extra_queries import _F, _P

# fixed values: names of small models
SMALL = ("phi", "gemma:2b", "tinyllama", "stablelm")
MODELS = ("codellama:7b", "qwen2.5-coder:14b", "llama3:70B", "mixtral:8x22b", "phi-3", "gemma:2b", "tinyllama", "gpt-x", "")


def _raw_patches(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "patch_results", "patch_id", "cycle_id", "path", "original", "patched", "status", "warnings", "validation_issues")


def _middle(text: Column) -> Column:
    """Two lines from the middle of a text, as something to search for."""
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, F.floor(F.size(lines) / 2).cast("int") + 1, F.lit(2)), "\n")


def x20_locations(spark: SparkSession, sf: str) -> DataFrame:
    """Where two lines from the middle of the original stand in the patched text; 0 where they don't."""
    p = _raw_patches(spark, sf).where("patched <> '' and original <> ''")
    return project(p, "patch_id", "patch_id", a.location(F.col("patched"), _middle(F.col("original"))).alias("l")).select("patch_id", "l.*")


def adj_p21_line_patch(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a line range, for exact places only."""
    p = _raw_patches(spark, sf).where("patched <> '' and original <> ''").withColumn("search", _middle(F.col("original"))).where((F.col("search") != "") & (F.instr("patched", F.col("search")) > 0))
    l = a.location(F.col("patched"), F.col("search"))
    return project(p, "patch_id", "patch_id", F.array(l["first"], l["last"]).alias("lines")).select("patch_id", F.array_join(F.transform("lines", lambda x: x.cast("string")), "-").alias("lines"))


def y27_context(spark: SparkSession, sf: str) -> DataFrame:
    """Seven lines before and behind these places."""
    p = _raw_patches(spark, sf).where("patched <> '' and original <> ''")
    l = a.location(F.col("patched"), _middle(F.col("original")))
    before, after = a.around(F.col("patched"), l["first"], l["last"])
    found = project(p, "patch_id", "patch_id", l["first"].alias("first"), F.md5(before).alias("before"), F.md5(after).alias("after"))
    return found.where("first > 0").drop("first")


def x21_change_label(spark: SparkSession, sf: str) -> DataFrame:
    """What each patch does, by the label cascade."""
    p = _raw_patches(spark, sf)
    return project(p, "patch_id", "patch_id", a.change_label(F.col("original"), F.col("patched")).alias("label")).groupBy("label").agg(F.count("*").alias("patches"))


def x42_line_hints(spark: SparkSession, sf: str) -> DataFrame:
    """The line, from 0, that a text names: answers, prompts and files."""
    d = load(spark, sf, "minimal_diffs", F.col("diff_id").alias("id"), F.col("raw_llm_response").alias("x")).withColumn("source", F.lit("minimal_diffs"))
    p = load(spark, sf, "proposals", F.col("proposal_id").alias("id"), F.concat_ws("\n", "llm_response", "prompt").alias("x")).withColumn("source", F.lit("proposals"))
    f = load(spark, sf, "cycle_files", F.col("file_id").alias("id"), F.col("content").alias("x")).withColumn("source", F.lit("cycle_files"))
    return d.unionByName(p).unionByName(f).select("source", "id", a.line_hint(F.col("x")).alias("line")).where("line is not null").distinct()


def x46_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Originals with the patched text behind and the path before them."""
    p = _raw_patches(spark, sf)
    return project(p, "patch_id", "patch_id", F.md5(a.with_ends(F.col("original"), F.col("patched"), F.concat(F.lit("// "), F.col("path")))).alias("digest"))


def w12_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered snippets of files, those over 3,000 characters by their two ends."""
    f = load(spark, sf, "cycle_files", "file_id", "content").where("content <> ''")
    f = f.withColumn("content", F.regexp_replace(F.col("content"), "\r\n?", "\n"))
    return project(a.with_numbered_ends(f, F.col("content"), 3000), "file_id", "file_id", F.md5("numbered").alias("digest"))


def f15_models(spark: SparkSession, sf: str) -> DataFrame:
    """Which models get the plain format."""
    m = spark.createDataFrame([(x,) for x in MODELS], "model string")
    return m.select("model", a.plain_format_wanted(F.col("model"), 14, SMALL).alias("plain"))


def f16_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in the plain format, and those with a JSON payload."""
    p = once(load(spark, sf, "proposals", "proposal_id", "llm_response"), "proposal_id")
    return p.groupBy(a.is_plain_format(F.col("llm_response")).alias("plain"), a.payload(F.col("llm_response")).isNotNull().alias("json")).agg(F.count("*").alias("answers"))


def f14_repairable(spark: SparkSession, sf: str) -> DataFrame:
    """Patched texts that a repair is tried on: one to three issues of unbalanced braces or parentheses or unfinished statements."""
    p = load(spark, sf, "patch_results", "patch_id", "path", "patched").where("patched <> ''")
    n = F.lit(0)
    for pair in t.PAIRS[:2]:
        n = n + F.when(t.balance(F.col("patched"), pair) != 0, 1).otherwise(0)
    n = n + F.when(t.truncation_note(F.col("patched")) == "trailing comma", 1).otherwise(0)
    return project(p, "patch_id", "patch_id", n.alias("issues")).where("issues between 1 and 3")


def f17_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a cycle gets short prompts (a context under 8,192 tokens: here one for each file) and is worked on file by file (from three on)."""
    f = once(load(spark, sf, "cycle_files", "file_id", "cycle_id"), "file_id").groupBy("cycle_id").agg(F.count("*").alias("n"))
    return f.select("cycle_id", *s.modes(F.col("n"), F.col("n") * 2048))


def y14_payloads(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "proposals", "proposal_id", "llm_response")
    x = project(p, "proposal_id", "proposal_id", a.payload(F.col("llm_response")).alias("x")).where("x is not null")
    return x.select("proposal_id", F.md5("x").alias("digest"))


def y13_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The explanation of an answer: the payload's rationale, else its whole text."""
    p = load(spark, sf, "proposals", "proposal_id", "llm_response").where("llm_response is not null")
    j = a.parsed(F.col("llm_response"))
    return project(p, "proposal_id", "proposal_id", F.when(j.isNotNull(), "json").otherwise("text").alias("layout"), F.md5(F.when(j.isNotNull(), F.coalesce(j["rationale"], F.lit(""))).otherwise(F.col("llm_response"))).alias("digest"))


def y12_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Answers read as a validator's: a payload's decision, NEEDS_REVISION without one or without a payload."""
    p = once(load(spark, sf, "proposals", "proposal_id", "llm_response"), "proposal_id").where("llm_response is not null")
    x = F.try_parse_json(a.payload(F.col("llm_response")))
    d = F.coalesce(F.try_variant_get(x, "$.decision", "string"), F.try_variant_get(x, "$.status", "string"), F.lit("NEEDS_REVISION"))
    return p.groupBy(d.alias("decision")).agg(F.count("*").alias("answers"))


def y16_plans(spark: SparkSession, sf: str) -> DataFrame:
    """The file that a per-file answer speaks of: the payload's path, else its target's."""
    d = load(spark, sf, "minimal_diffs", "diff_id", "target_src", "raw_llm_response")
    j = a.parsed(F.col("raw_llm_response"))
    return project(d.where(a.payload(F.col("raw_llm_response")).isNotNull()), "diff_id", "diff_id", F.coalesce(j["patch"]["path"], F.col("target_src")).alias("path"))


def y11_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Minimal diffs as their answers give them: success (a patch and an edge), confidence by strategy, seven tenths where invalid."""
    d = load(spark, sf, "minimal_diffs", "diff_id", "cycle_id", "raw_llm_response")
    j = a.parsed(F.col("raw_llm_response"))
    table = F.create_map(*[F.lit(x) for kv in a.STRATEGY_CONFIDENCE.items() for x in kv])
    success = F.coalesce(j["patch"].isNotNull() & j["target_edge"].isNotNull(), F.lit(False))
    c = F.when(j.isNull(), 0.0).otherwise(F.coalesce(F.try_element_at(table, F.coalesce(j["strategy"], F.lit(""))), F.lit(0.5)))
    return project(d, "diff_id", "diff_id", success.alias("success"), F.round(c * F.when(success, 1.0).otherwise(0.7), 4).alias("confidence"))


def j18_valid_targets(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with minimal diffs: no patch, a file that isn't the cycle's, an empty or idle block, the import left alone."""
    d = load(spark, sf, "minimal_diffs", "diff_id", "cycle_id", "raw_llm_response")
    f = load(spark, sf, "cycle_files", "cycle_id", "path").where("path is not null")
    return s.diff_issues(d, f).groupBy("issue").agg(F.count("*").alias("diffs"))


def m21_diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Minimal diffs as Markdown rows."""
    d = load(spark, sf, "minimal_diffs", "diff_id", "raw_llm_response")
    return project(d, "diff_id", "diff_id", F.md5(s.diff_summary(a.parsed(F.col("raw_llm_response")))).alias("digest"))


def y3_fenced(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without the code fence around them, for those that have one: answers, contents and patched texts."""
    f = load(spark, sf, "cycle_files", F.col("file_id").alias("id"), F.col("content").alias("x"), F.lit("cycle_files").alias("source"))
    p = load(spark, sf, "patch_results", F.col("patch_id").alias("id"), F.col("patched").alias("x"), F.lit("patch_results").alias("source"))
    r = load(spark, sf, "proposals", F.col("proposal_id").alias("id"), F.col("llm_response").alias("x"), F.lit("proposals").alias("source"))
    u = f.unionByName(p).unionByName(r).select("source", "id", "x", s.unfenced(F.col("x")).alias("y")).where("x <> y")
    return u.select("source", "id", F.md5("y").alias("digest")).distinct()


def y17_first_text(spark: SparkSession, sf: str) -> DataFrame:
    """An answer's text: the first of the payload's answer, result, output, text and content, else the whole."""
    p = once(load(spark, sf, "proposals", "proposal_id", "llm_response"), "proposal_id").where("llm_response is not null")
    x = F.try_parse_json(a.payload(F.col("llm_response")))
    return p.select("proposal_id", F.length(F.coalesce(*[F.try_variant_get(x, f"$.{k}", "string") for k in ("answer", "result", "output", "text", "content")], F.col("llm_response"))).alias("chars"))


QUERIES = {f.__name__: f for f in (
    x20_locations, adj_p21_line_patch, y27_context, x21_change_label, x42_line_hints, x46_appended, w12_numbered, f15_models, f16_formats, f14_repairable, f17_modes, y14_payloads, y13_fields, y12_decisions, y16_plans, y11_confidence, j18_valid_targets, m21_diff_summary, y3_fenced, y17_first_text,
)}

# ----------------------------------------------------------------------------------------------------------- SQL
_SQ = r"regexp_replace({x}, '[ \t]+', ' ', 'g')"
_NL = "(length({x}) - length(replace({x}, chr(10), '')))"
_LOC = "l AS (SELECT *, CASE WHEN at0 > 0 THEN " + _NL.replace("{x}", "x[:at0 - 1]") + " + 1 WHEN loose > 0 THEN " + _NL.replace("{x}", _SQ.replace("{x}", "x") + "[:loose - 1]") + " + 1 ELSE 0 END AS first0 FROM (SELECT *, instr(x, search) AS at0, instr(" + _SQ.replace("{x}", "x") + ", " + _SQ.replace("{x}", "search") + ") AS loose FROM m)), ll AS (SELECT *, CASE WHEN x = '' OR search = '' THEN 0 ELSE first0 END AS f1 FROM l), z AS (SELECT *, CASE WHEN f1 > 0 THEN f1 + " + _NL.replace("{x}", "search") + " ELSE 0 END AS l1 FROM ll)"
_MID = "m AS (SELECT patch_id, patched AS x, array_to_string(o[len(o) // 2 + 1:len(o) // 2 + 2], chr(10)) AS search FROM (SELECT patch_id, patched, string_split(original, chr(10)) AS o FROM p WHERE patched <> '' AND original <> ''))"
_LINES = r"CASE WHEN {x} = '' THEN 0 ELSE len(string_split(regexp_replace({x}, '\n$', ''), chr(10))) END"
_TYPES = r"regexp_extract_all({x}, ':\s*(\w+)', 1)"
_IMP = "(contains({x}, 'using ') OR contains({x}, 'import '))"
_LF = r"regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g')"
_OPEN = "(" + " OR ".join(f"starts_with(regexp_replace(b, '^\\s+', ''), '{o}')" for o in a.OPENINGS) + ")"
_HINT = "coalesce(" + ", ".join(f"try_cast(nullif(regexp_extract(x, '{h}', 1), '') AS INT)" for h in a.HINTS) + ") - 1"
_PAY = r"""CASE WHEN json_valid(nullif(regexp_extract(x, '(?s)```(?:json)?[ \t]*\n(.*?)```', 1), '')) AND regexp_matches(regexp_extract(x, '(?s)```(?:json)?[ \t]*\n(.*?)```', 1), '^\s*\{') THEN regexp_extract(x, '(?s)```(?:json)?[ \t]*\n(.*?)```', 1)
 WHEN json_valid(trim(x, ' ')) AND regexp_matches(x, '^\s*\{') THEN trim(x, ' ') WHEN json_valid(nullif(regexp_extract(x, '(?s)(\{.*\})', 1), '')) THEN regexp_extract(x, '(?s)(\{.*\})', 1) END"""
_ANS = "a0 AS (SELECT proposal_id, any_value(llm_response) AS x FROM proposals GROUP BY 1), a AS (SELECT proposal_id, x, " + _PAY + " AS j FROM a0)"
_DIF = "d0 AS (SELECT diff_id, any_value(cycle_id) AS cycle_id, any_value(target_src) AS target_src, any_value(raw_llm_response) AS x FROM minimal_diffs GROUP BY 1), d AS (SELECT *, " + _PAY + " AS j FROM d0)"
_UNB = lambda p: f"(length(replace(patched, '{p[1]}', '')) <> length(replace(patched, '{p[0]}', '')))"
_NUM = "array_to_string([lpad((i + {first} - 1)::VARCHAR, 4, ' ') || ' | ' || ({l})[i] for i in range(1, len({l}) + 1)], chr(10))"
_SPLIT = r"string_split(regexp_replace({x}, '\n$', ''), chr(10))"
_FENCE1 = r"regexp_replace(regexp_replace(trim({x}, ' ' || chr(9) || chr(10) || chr(13)), '^```\w*\n?', ''), '\n?```$', '')"

SQL = {
    "x20_locations": f"WITH {_P}, {_MID}, {_LOC} SELECT patch_id, f1::INT AS first, l1::INT AS last FROM z",
    "adj_p21_line_patch": f"WITH {_P}, {_MID}, {_LOC} SELECT patch_id, f1 || '-' || l1 AS lines FROM z WHERE search <> '' AND at0 > 0",
    "y27_context": f"WITH {_P}, {_MID}, {_LOC}, y AS (SELECT *, string_split(x, chr(10)) AS t FROM z WHERE f1 > 0) SELECT patch_id, md5(array_to_string(t[greatest(f1 - 7, 1):f1 - 1], chr(10))) AS before, md5(array_to_string(t[l1 + 1:l1 + 7], chr(10))) AS after FROM y",
    "x21_change_label": f"WITH {_P}, q AS (SELECT coalesce(original, '') AS a, coalesce(patched, '') AS b FROM p), r AS (SELECT a, b, {_TYPES.replace('{x}', 'a')} AS ta, {_TYPES.replace('{x}', 'b')} AS tb, {_LINES.replace('{x}', 'a')} AS na, {_LINES.replace('{x}', 'b')} AS nb FROM q) SELECT CASE WHEN a = '' AND b <> '' THEN 'add code' WHEN a <> '' AND b = '' THEN 'remove code' WHEN a = b THEN '' WHEN contains(lower(b), 'interface') AND NOT contains(lower(a), 'interface') THEN 'add interface' WHEN {_IMP.replace('{x}', 'b')} AND NOT {_IMP.replace('{x}', 'a')} THEN 'add import' WHEN {_IMP.replace('{x}', 'b')} THEN 'change import' WHEN len(ta) > 0 AND len(tb) > 0 AND ta <> tb THEN 'type ' || ta[1] || ' to ' || tb[1] WHEN nb > na THEN 'expand ' || na || ' to ' || nb || ' lines' WHEN nb < na THEN 'simplify ' || na || ' to ' || nb || ' lines' ELSE 'modify code' END AS label, count(*) AS patches FROM r GROUP BY 1",
    "x42_line_hints": f"WITH u AS (SELECT 'minimal_diffs' AS source, diff_id AS id, raw_llm_response AS x FROM minimal_diffs UNION ALL SELECT 'proposals', proposal_id, concat_ws(chr(10), llm_response, prompt) FROM proposals UNION ALL SELECT 'cycle_files', file_id, content FROM cycle_files) SELECT DISTINCT source, id, {_HINT} AS line FROM u WHERE line IS NOT NULL",
    "x46_appended": f"WITH {_P}, q AS (SELECT patch_id, {_LF.replace('{x}', 'original')} AS o, {_LF.replace('{x}', 'patched')} AS b, coalesce('// ' || {_LF.replace('{x}', 'path')}, '') AS pre, path FROM p), r AS (SELECT *, CASE WHEN path IS NULL THEN o WHEN o <> '' THEN pre || chr(10) || o ELSE pre END AS o1 FROM q), s AS (SELECT *, CASE WHEN o1 <> '' AND NOT ends_with(o1, chr(10)) THEN o1 || chr(10) ELSE o1 END AS o2 FROM r), t AS (SELECT *, CASE WHEN {_OPEN} AND o2 <> '' AND NOT ends_with(o2, chr(10) || chr(10)) THEN rtrim(o2, chr(10)) || chr(10) || chr(10) ELSE o2 END AS o3 FROM s) SELECT patch_id, md5(CASE WHEN b = '' THEN o1 ELSE o3 || b END) AS digest FROM t",
    "w12_numbered": f"WITH {_F}, q AS (SELECT file_id, {_LF.replace('{x}', 'content')} AS x FROM f WHERE content <> ''), h AS (SELECT *, x[:1740] AS h0, right(x, 1160) AS t0 FROM q), k AS (SELECT *, CASE WHEN instr(h0, chr(10)) > 1 THEN regexp_replace(h0, '\\n[^\\n]*$', '') ELSE h0 END AS h1, CASE WHEN instr(t0, chr(10)) > 1 THEN regexp_replace(t0, '^[^\\n]*\\n', '') ELSE t0 END AS t1 FROM h), n AS (SELECT *, {_SPLIT.replace('{x}', 'x')} AS xl, {_SPLIT.replace('{x}', 'h1')} AS hl, {_SPLIT.replace('{x}', 't1')} AS tl FROM k) SELECT file_id, md5(CASE WHEN length(x) > 3000 THEN {_NUM.replace('{l}', 'hl').replace('{first}', '1')} || chr(10) || '     | ... (' || (len(xl) - len(hl) - len(tl)) || ' lines omitted, lines ' || (len(hl) + 1) || '-' || (len(xl) - len(tl)) || ') ...' || chr(10) || {_NUM.replace('{l}', 'tl').replace('{first}', '(len(xl) - len(tl) + 1)')} ELSE {_NUM.replace('{l}', 'xl').replace('{first}', '1')} END) AS digest FROM n",
    "f15_models": "SELECT model, coalesce(try_cast(nullif(regexp_extract(lower(model), '(\\d+)b', 1), '') AS INT) <= 14, " + " OR ".join(f"contains(lower(model), '{x}')" for x in SMALL) + ") AS plain FROM (VALUES " + ", ".join(f"('{x}')" for x in MODELS) + ") v(model)",
    "f16_formats": f"WITH {_ANS} SELECT regexp_matches(coalesce(x, ''), '(?im)^(?:STRATEGY|NEW_FILE|MODIFY):') AND NOT starts_with(regexp_replace(coalesce(x, ''), '^\\s+', ''), '{{') AND NOT contains(coalesce(x, ''), '{{\"reasoning\"') AS plain, j IS NOT NULL AS json, count(*) AS answers FROM a GROUP BY 1, 2",
    "f14_repairable": "",
    "f17_modes": f"WITH {_F}, n AS (SELECT cycle_id, count(*) AS n FROM f GROUP BY 1) SELECT cycle_id, n * 2048 < 8192 AS short_prompts, n >= 3 AS file_by_file FROM n",
    "y14_payloads": f"WITH {_ANS} SELECT proposal_id, md5(j) AS digest FROM a WHERE j IS NOT NULL",
    "y13_fields": f"WITH {_ANS} SELECT proposal_id, CASE WHEN j IS NOT NULL THEN 'json' ELSE 'text' END AS layout, md5(CASE WHEN j IS NOT NULL THEN coalesce(j->>'$.rationale', '') ELSE x END) AS digest FROM a WHERE x IS NOT NULL",
    "y12_decisions": f"WITH {_ANS} SELECT coalesce(j->>'$.decision', j->>'$.status', 'NEEDS_REVISION') AS decision, count(*) AS answers FROM a WHERE x IS NOT NULL GROUP BY 1",
    "y16_plans": f"WITH {_DIF} SELECT diff_id, coalesce(j->>'$.patch.path', target_src) AS path FROM d WHERE j IS NOT NULL",
    "y11_confidence": f"WITH {_DIF}, q AS (SELECT *, coalesce(json_type(j, '$.patch') = 'OBJECT' AND json_type(j, '$.target_edge') = 'OBJECT', false) AS ok FROM d) SELECT diff_id, ok AS success, round((CASE WHEN j IS NULL THEN 0.0 WHEN true THEN CASE coalesce(j->>'$.strategy', '') " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in a.STRATEGY_CONFIDENCE.items()) + " ELSE 0.5 END END * CASE WHEN ok THEN 1.0 ELSE 0.7 END)::DOUBLE, 4) AS confidence FROM q",
    "y17_first_text": f"WITH {_ANS} SELECT proposal_id, length(coalesce(j->>'$.answer', j->>'$.result', j->>'$.output', j->>'$.text', j->>'$.content', x))::INT AS chars FROM a WHERE x IS NOT NULL",
    "y3_fenced": f"WITH u AS (SELECT 'cycle_files' AS source, file_id AS id, content AS x FROM cycle_files UNION ALL SELECT 'patch_results', patch_id, patched FROM patch_results UNION ALL SELECT 'proposals', proposal_id, llm_response FROM proposals), v AS (SELECT source, id, x, CASE WHEN regexp_matches(x, '^\\s*```') OR regexp_matches(x, '```\\s*$') THEN {_FENCE1.replace('{x}', 'x')} ELSE x END AS y FROM u) SELECT DISTINCT source, id, md5(y) AS digest FROM v WHERE x <> y",
}
from .extra_queries import _note  # noqa: E402

SQL["f14_repairable"] = f"WITH {_P}, q AS (SELECT patch_id, ({_UNB(t.PAIRS[0])}::INT + {_UNB(t.PAIRS[1])}::INT + coalesce({_note('patched')} = 'trailing comma', false)::INT)::INT AS issues FROM p WHERE patched <> '') SELECT * FROM q WHERE issues BETWEEN 1 AND 3"
_TS = "{\"path\":\"VARCHAR\",\"changes_made\":[\"VARCHAR\"],\"search_replace\":[{\"search\":\"VARCHAR\",\"replace\":\"VARCHAR\"}]}"
SQL["j18_valid_targets"] = rf"""WITH {_DIF}, {_F}, q AS (SELECT *, from_json(j->'$.patch', '{_TS}') AS p, json_type(j, '$.patch') = 'OBJECT' AS has, coalesce(j->>'$.target_edge.import_statement', '') AS imp FROM d),
 r AS (SELECT *, coalesce(p.path, '') AS path, coalesce(p.search_replace, []) AS sr FROM q WHERE has),
 i AS (SELECT 'no patch' AS issue FROM q WHERE NOT coalesce(has, false) UNION ALL SELECT 'no path' FROM r WHERE path = '' UNION ALL SELECT 'not in cycle' FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.cycle_id = r.cycle_id AND f.path IS NOT NULL AND (r.path = f.path OR ends_with(r.path, regexp_extract(f.path, '([^/\\]*)$', 1))))
 UNION ALL SELECT 'no blocks' FROM r WHERE len(sr) = 0 UNION ALL SELECT 'empty search' FROM r WHERE len([x for x in sr if coalesce(x.search, '') = '']) > 0 UNION ALL SELECT 'no change' FROM r WHERE len([x for x in sr if coalesce(x.search, '') = coalesce(x.replace, '')]) > 0
 UNION ALL SELECT 'import left' FROM r WHERE imp <> '' AND len([x for x in sr if len([w for w in regexp_split_to_array(imp, '\s+') if w <> '' and contains(coalesce(x.search, ''), w)]) > 0]) = 0) SELECT issue, count(*) AS diffs FROM i GROUP BY 1"""
SQL["m21_diff_summary"] = rf"""WITH {_DIF}, q AS (SELECT *, from_json(j->'$.patch', '{_TS}') AS p, json_type(j, '$.target_edge') = 'OBJECT' AS has FROM d) SELECT diff_id, md5(CASE WHEN j IS NULL THEN '' ELSE concat_ws(chr(10), CASE WHEN has THEN '**Target Edge**: `' || coalesce(j->>'$.target_edge.from', '') || '` → `' || coalesce(j->>'$.target_edge.to', '') || '`' END,
 CASE WHEN has AND coalesce(j->>'$.target_edge.import_statement', '') <> '' THEN '**Import to Remove**: `' || (j->>'$.target_edge.import_statement') || '`' END, '**Strategy**: ' || coalesce(j->>'$.strategy', ''), CASE WHEN coalesce(j->>'$.rationale', '') <> '' THEN '**Rationale**: ' || (j->>'$.rationale') END,
 CASE WHEN p.path IS NOT NULL THEN '**File to Modify**: `' || p.path || '`' END, CASE WHEN coalesce(j->>'$.remaining_cycle', '') <> '' THEN '**After This Change**: ' || (j->>'$.remaining_cycle') END) END) AS digest FROM q"""
