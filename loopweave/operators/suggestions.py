"""Answers as suggestions: what each would change, where, how sure, how hard, and what is wrong with it.

Everything is columns over parsed JSON, so nothing leaves the JVM; files are found by an equi-join on the cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as a
from .matching import base_name


def modes(files: Column, context: Column) -> tuple[Column, Column]:
    """``short_prompts`` (a context under 8,192 tokens) and ``file_by_file`` (three files and more)."""
    return (context < 8192).alias("short_prompts"), (files >= 3).alias("file_by_file")


def unfenced(text: Column) -> Column:
    """``text`` without the code fence that opens or closes it; a text without one as it is."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\A[ \t\r\n]+|[ \t\r\n]+\z", ""), r"\A```\w*\n?", ""), r"\n?```\z", "")
    return F.when(text.rlike(r"\A\s*```") | text.rlike(r"```\s*\z"), bare).otherwise(text)


def diff_summary(j: Column) -> Column:
    """A minimal diff as Markdown lines; those without a value are left out, an answer without a payload gives an empty text."""
    edge, text = j["target_edge"], lambda x: F.coalesce(x, F.lit(""))
    lines = F.concat_ws(
        "\n",
        F.when(edge.isNotNull(), F.concat(F.lit("**Target Edge**: `"), text(edge["from"]), F.lit("` → `"), text(edge["to"]), F.lit("`"))),
        F.when(text(edge["import_statement"]) != "", F.concat(F.lit("**Import to Remove**: `"), edge["import_statement"], F.lit("`"))),
        F.concat(F.lit("**Strategy**: "), text(j["strategy"])),
        F.when(text(j["rationale"]) != "", F.concat(F.lit("**Rationale**: "), j["rationale"])),
        F.when(j["patch"]["path"].isNotNull(), F.concat(F.lit("**File to Modify**: `"), j["patch"]["path"], F.lit("`"))),
        F.when(text(j["remaining_cycle"]) != "", F.concat(F.lit("**After This Change**: "), j["remaining_cycle"])),
    )
    return F.when(j.isNull(), F.lit("")).otherwise(lines)


def diff_issues(diffs: DataFrame, files: DataFrame) -> DataFrame:
    """``(diff_id, issue)`` for minimal diffs; ``files`` has ``cycle_id, path``. Re-delivered diffs count once."""
    schema = "struct<patch: struct<path: string, search_replace: array<struct<search: string, replace: string>>>, target_edge: struct<import_statement: string>>"
    j = F.from_json(a.payload(F.col("raw_llm_response")), schema)
    d = diffs.select("diff_id", "cycle_id", j.alias("j")).select("diff_id", "cycle_id", F.col("j.patch").alias("p"), F.coalesce("j.target_edge.import_statement", F.lit("")).alias("imp")).dropDuplicates(["diff_id"])
    text = lambda x: F.coalesce(x, F.lit(""))
    sr = F.coalesce("p.search_replace", F.array().cast("array<struct<search: string, replace: string>>"))
    words = F.filter(F.split("imp", r"\s+"), lambda w: w != "")
    issues = F.when(F.col("p").isNull(), F.array(F.lit("no patch"))).otherwise(F.array_compact(F.array(
        F.when(text(F.col("p.path")) == "", "no path"), F.when(F.size(sr) == 0, "no blocks"), F.when(F.exists(sr, lambda x: text(x["search"]) == ""), "empty search"), F.when(F.exists(sr, lambda x: text(x["search"]) == text(x["replace"])), "no change"),
        F.when((F.col("imp") != "") & ~F.exists(sr, lambda x: F.exists(words, lambda w: F.contains(text(x["search"]), w))), "import left"),
    )))
    own = d.select("diff_id", F.explode(issues).alias("issue"))
    named = d.where("p is not null").select("diff_id", "cycle_id", text(F.col("p.path")).alias("path"))
    f = files.select("cycle_id", F.col("path").alias("_f")).distinct()
    found = named.join(f, "cycle_id").where((F.col("path") == F.col("_f")) | F.endswith("path", base_name(F.col("_f")))).select("diff_id").distinct()
    return own.unionByName(named.join(found, "diff_id", "left_anti").select("diff_id", F.lit("not in cycle").alias("issue")))


CODES = "array<struct<first: int, last: int, before: string, after: string>>"


def suggestions(answers: DataFrame, files: DataFrame, id_col: str = "proposal_id", text_col: str = "llm_response") -> DataFrame:
    """``(id, cycle_id, pos, path, is_new, content, codes, confidence)``: what each answer suggests, in its order.

    New files come first (``pos`` from 0 in each kind). ``codes`` are the places of a change: something put before the
    file at line 1, each search text where it stands (line 0 where it doesn't), or the whole file. The file is the first
    of the cycle, by ``ord``, whose path is the suggestion's or ends in it. ``files`` has ``cycle_id, ord, path,
    content``. Entries without a path and answers without a payload give nothing. Re-delivered rows count once.
    """
    j = answers.select(id_col, "cycle_id", a.parsed(F.col(text_col)).alias("j")).where("j is not null")
    none = F.lit(None)
    new = j.select(id_col, "cycle_id", F.posexplode("j.new_files").alias("pos", "x")).where("x.path <> ''")
    content = F.coalesce("x.content", F.lit(""))
    new = new.select(id_col, "cycle_id", "pos", F.col("x.path").alias("path"), F.lit(True).alias("is_new"), content.alias("content"), F.array().cast(CODES).alias("codes"), F.when(content != "", 0.9).otherwise(0.5).alias("confidence"))
    changed = j.select(id_col, "cycle_id", F.posexplode(F.coalesce("j.changes", "j.patches")).alias("pos", "x")).where("x.path <> ''").select(id_col, "cycle_id", "pos", "x", F.col("x.path").alias("path")).dropDuplicates([id_col, "pos"])
    f = files.where("path is not null").select("cycle_id", "ord", F.col("path").alias("_p"), F.col("content").alias("_c"))
    own = changed.select(id_col, "cycle_id", "pos", "path").join(f, "cycle_id").where((F.col("_p") == F.col("path")) | F.endswith("_p", F.col("path")))
    own = own.groupBy(id_col, "pos").agg(F.min_by("_c", F.struct("ord", "_p")).alias("_c"))
    k = changed.join(own, [id_col, "pos"], "left")
    old = F.coalesce("_c", F.lit(""))
    code = lambda first, last, before, after: F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), before.alias("before"), after.alias("after"))
    sr = F.coalesce("x.search_replace", F.array().cast("array<struct<search: string, replace: string>>"))

    def placed(y: Column) -> Column:
        l = a.location(old, y["search"])
        return code(l["first"], l["last"], y["search"], F.coalesce(y["replace"], F.lit("")))

    codes = F.concat(
        F.when(F.coalesce("x.prepend", F.lit("")) != "", F.array(code(F.lit(1), F.lit(1), F.lit(""), F.col("x.prepend")))).otherwise(F.array().cast(CODES)),
        F.transform(F.filter(sr, lambda y: F.coalesce(y["search"], F.lit("")) != ""), placed),
        F.when(F.col("x.patched").isNotNull() & (F.size(sr) == 0), F.array(code(F.lit(1), F.greatest(a.line_count(old), F.lit(1)), F.lit(""), F.col("x.patched")))).otherwise(F.array().cast(CODES)),
    ).cast(CODES)
    k = k.select(id_col, "cycle_id", "pos", "path", F.lit(False).alias("is_new"), none.cast("string").alias("content"), codes.alias("codes"))
    sure = F.when(F.size("codes") == 0, 0.3).when(F.exists("codes", lambda c: c["first"] == 0), 0.6).otherwise(0.85)
    return k.withColumn("confidence", sure).unionByName(new.dropDuplicates([id_col, "pos"]))


def breaks_cycle(s: Column) -> Column:
    """Whether suggestions (an array of ``is_new, path, codes, strategy``) look as if they broke the cycle: a new interface
    together with a changed import or a type turned into one; an import taken out; a class replaced by an interface; or with
    an injecting or lazy strategy, a call with more arguments."""
    codes = F.flatten(F.transform(s, lambda x: x["codes"]))
    has = lambda x, w: F.contains(F.lower(x), F.lit(w))
    new = F.exists(s, lambda x: x["is_new"] & has(x["path"], "interface"))
    imports = F.exists(codes, lambda c: has(c["after"], "import") | has(c["after"], "using"))
    typed = F.exists(codes, lambda c: c["after"].rlike(r": I[A-Z]\w+"))
    out = F.exists(codes, lambda c: (has(c["before"], "import") & ~has(c["after"], "import")) | (has(c["before"], "using") & ~has(c["after"], "using")))
    swapped = F.exists(codes, lambda c: c["before"].rlike(r"\b[A-Z]\w+\b") & c["after"].rlike(r"\bI[A-Z]\w+\b"))
    commas = lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit("")))
    injected = F.exists(s, lambda x: x["strategy"].isin("parameter_injection", "lazy_import") & F.exists(x["codes"], lambda c: c["before"].contains("(") & c["after"].contains("(") & (commas(c["after"]) > commas(c["before"]))))
    return (new & (imports | typed)) | out | swapped | injected


def difficulty(create: Column, modify: Column) -> Column:
    """How hard a set of suggestions is to carry out."""
    n = create + modify
    return F.when((n <= 2) & (create == 0), "easy").when(n <= 4, "moderate").when(create > 0, "moderate").otherwise("complex")


def overall(confidences: Column, any_new: Column, warnings: Column) -> Column:
    """Mean confidence, a twentieth more with a new file, a tenth less for each warning, within 0 and 1; 0 without suggestions."""
    mean = F.aggregate(confidences, F.lit(0.0), lambda x, y: x + y) / F.size(confidences)
    return F.when(F.size(confidences) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean + F.when(any_new, 0.05).otherwise(0.0) - 0.1 * warnings)))


def shortened(text: Column, most: int = 5000) -> Column:
    """``text`` cut to ``most`` characters, with how many more there are."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n... ("), (F.length(text) - most).cast("string"), F.lit(" more characters)"))).otherwise(text)


def cycle_context(jobs: DataFrame) -> DataFrame:
    """``(cycle_id, cycle_type, hotspot)``: the type by the number of nodes, and the node with the most ends of edges, the
    first met among equals."""
    n = F.size("graph.nodes")
    kind = jobs.select("cycle_id", F.when(n == 2, "bidirectional").when(n == 3, "triangle").otherwise("multi-node").alias("cycle_type"))
    e = jobs.select("cycle_id", F.posexplode("graph.edges").alias("p", "e")).where("size(e) >= 2")
    ends = e.select("cycle_id", F.inline(F.array(F.struct((F.col("p") * 2).alias("at"), F.col("e")[0].alias("node")), F.struct((F.col("p") * 2 + 1).alias("at"), F.col("e")[1].alias("node")))))
    c = ends.groupBy("cycle_id", "node").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    return kind.join(c.groupBy("cycle_id").agg(F.min_by("node", F.struct(-F.col("n"), "at")).alias("hotspot")), "cycle_id", "left")


def report(head: DataFrame) -> DataFrame:
    """``(cycle_id, id, report)``: Markdown of a set of suggestions, sections without content left out.

    ``head`` has ``cycle_id, id, strategy, rationale, confidence, broken, create, modify`` (arrays of paths), ``nodes,
    edges, cycle_type, hotspot`` and the raw ``answer``.
    """
    text = lambda x: F.coalesce(x, F.lit(""))
    each = lambda xs, mark: F.transform(xs, lambda x: F.concat(F.lit(mark), x, F.lit("`")))
    block = lambda title, lines: F.when(F.size(lines) > 0, F.concat_ws("\n", F.lit(title), F.array_join(lines, "\n")))
    order = F.array_distinct(F.concat("create", "modify"))
    arrows = F.transform(F.filter("edges", lambda e: F.size(e) >= 2), lambda e: F.concat(F.lit("  "), e[0], F.lit(" → "), e[1]))
    body = F.concat_ws(
        "\n\n", F.concat(F.lit("# Suggestions: "), F.col("cycle_id")),
        F.concat(F.lit("| Metric | Value |\n|---|---|\n| Strategy | "), F.coalesce(F.nullif("strategy", F.lit("")), F.lit("not given")), F.lit(" |\n| Confidence | "), F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("% |\n| Cycle broken | "), F.when(F.col("broken"), "yes").otherwise("to be verified"),
                 F.lit(" |\n| Files to create | "), F.size("create").cast("string"), F.lit(" |\n| Files to modify | "), F.size("modify").cast("string"), F.lit(" |")),
        F.when(text(F.col("rationale")) != "", F.concat(F.lit("Rationale: "), F.col("rationale"))),
        F.concat(F.lit("## The cycle\nType: "), F.col("cycle_type")), F.when(F.col("hotspot").isNotNull(), F.concat(F.lit("Most connected: `"), F.col("hotspot"), F.lit("`"))), block("Nodes:", each(F.col("nodes"), "- `")), block("Edges:", arrows),
        block("## To create", each(F.col("create"), "- `")), block("## To modify", each(F.col("modify"), "- `")), block("## Order", F.transform(order, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". `"), x, F.lit("`")))),
        F.when(text(F.col("answer")) != "", F.concat(F.lit("## Answer\n"), shortened(F.col("answer")))),
    )
    return head.select("cycle_id", "id", body.alias("report"))
