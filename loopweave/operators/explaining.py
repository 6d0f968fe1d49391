"""Why patches failed, what to tell the next try, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as t
from . import reports

#: What to do about a file, by why its patch failed.
FIXES = {
    "hallucination": "create what the change takes for granted before changing {p}", "syntax": "mend the syntax of what was written for {p}", "search_mismatch": "find the place in {p} by hand and change it there",
    "no_op": "ask again for a change of {p}", "validation": "look at the validation of {p} and go about it otherwise", "compile": "mend the compile errors of {p}",
}
OTHER_FIX = "look into {p}"
#: What to do where nothing was applied, by strategy.
STEPS = {
    "interface_extraction": ("make an interface of what the dependent class needs", "let the other class implement it", "use the interface in its place"),
    "dependency_inversion": ("put an abstraction into the higher module", "let the lower module implement it", "hand the implementation over at run time"),
    "shared_module": ("find what both modules use", "move it into a module of its own", "import it from there"),
}


def filled(template: str, value: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{p}"), value)


def suggested_fix(kind: Column, path: Column) -> Column:
    out = filled(OTHER_FIX, path)
    for k, v in FIXES.items():
        out = F.when(kind == k, filled(v, path)).otherwise(out)
    return out


def remaining_work(patches: DataFrame, strategies: DataFrame) -> DataFrame:
    """``(cycle_id, item)``: the fix of each patch that failed, and a strategy's steps where no patch went in; each once.

    ``strategies`` has ``cycle_id, strategy``, once a cycle.
    """
    kind = reports.failure_class(F.col("status"), F.col("original"), F.col("patched"), F.col("validation_issues"), F.col("applied_blocks"), F.col("total_blocks"))
    p = patches.select("cycle_id", kind.alias("k"), F.coalesce("path", F.lit("?")).alias("path"), (F.col("status").isin("applied", "partial") & (F.coalesce("original", F.lit("")) != F.coalesce("patched", F.lit("")))).alias("ok"))
    fixes = p.where("k is not null").select("cycle_id", suggested_fix(F.col("k"), F.col("path")).alias("item"))
    none = p.groupBy("cycle_id").agg(F.max("ok").alias("ok")).where("not ok").select("cycle_id")
    table = F.create_map(*[x for k, v in STEPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    steps = none.join(strategies, "cycle_id").select("cycle_id", F.explode(F.try_element_at(table, F.col("strategy"))).alias("item"))
    return fixes.unionByName(steps).distinct()


def per_file(patches: DataFrame) -> DataFrame:
    """``(patch_id, cycle_id, iteration, path, status, attempted, why)`` of the patches that failed, were reverted or are partial."""
    none = F.array().cast("array<string>")
    three = lambda xs: F.nullif(F.array_join(F.slice(F.coalesce(xs, none), 1, 3), "; "), F.lit(""))
    why = F.coalesce(three(F.col("warnings")), F.nullif("revert_reason", F.lit("")), three(F.col("validation_issues")), F.lit("unknown"))
    tried = F.when(F.col("total_blocks") > 0, F.concat(F.col("applied_blocks").cast("string"), F.lit(" of "), F.col("total_blocks").cast("string"), F.lit(" blocks found their place"))).otherwise("nothing could be applied")
    return patches.where(F.col("status").isin("failed", "reverted", "partial")).select("patch_id", "cycle_id", "iteration", F.coalesce("path", F.lit("?")).alias("path"), "status", tried.alias("attempted"), why.alias("why"))


def outcome(patches: DataFrame, keys: list[str]) -> DataFrame:
    """``(key…, total, failed, partial, summary)`` per run."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = patches.groupBy(*keys).agg(F.count("*").alias("total"), n(F.col("status").isin("failed", "reverted")).alias("failed"), n(F.col("status") == "partial").alias("partial"))
    s = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    failed, total, partial = (F.col(x).cast("string") for x in ("failed", "total", "partial"))
    return g.withColumn("summary", F.when(F.col("failed") == F.col("total"), s("all ", total, " failed")).when(F.col("partial") > 0, s(failed, " failed, ", partial, " in part")).otherwise(s(failed, " of ", total, " failed")))


def failure_report(patches: DataFrame) -> DataFrame:
    """``(cycle_id, report)``: Markdown for each cycle with a failed patch: outcome, files with what was tried and why it failed.

    A cycle's lines are gathered by its key; they are short and as many as its patches.
    """
    f = per_file(patches)
    line = F.concat(F.lit("### `"), "path", F.lit("` ("), "status", F.lit(")\nTried: "), "attempted", F.lit("\nWhy: "), "why")
    g = f.groupBy("cycle_id").agg(F.array_sort(F.collect_list(F.struct("path", "patch_id", line.alias("l")))).alias("x"))
    j = g.join(outcome(patches, ["cycle_id"]), "cycle_id")
    return j.select("cycle_id", F.concat(F.lit("# Failed: "), "cycle_id", F.lit("\n\n"), "summary", F.lit("\n\n## Files\n"), F.array_join(F.transform("x", lambda y: y["l"]), "\n")).alias("report"))


def feedback(issues: DataFrame, keys: list[str]) -> DataFrame:
    """``(key…, feedback)``: issues as a text for the next try: syntax first (five), the cycle (three), others (five), each with how
    many more there are.

    ``issues`` has the keys, ``kind`` (syntax, cycle or another), ``path`` and ``comment``. Only the lines shown are gathered.
    """
    kind = F.when(F.col("kind").isin("syntax", "cycle"), F.col("kind")).otherwise("other")
    most = F.when(kind == "cycle", 3).otherwise(5)
    i = issues.select(*keys, kind.alias("_k"), F.when(kind == "syntax", 0).when(kind == "cycle", 1).otherwise(2).alias("_r"), most.alias("_most"), F.coalesce("path", F.lit("?")).alias("_path"), F.coalesce("comment", F.lit("")).alias("_comment"))
    w = W.partitionBy(*keys, "_k")
    i = i.withColumn("_n", F.count("*").over(w)).withColumn("_pos", F.row_number().over(w.orderBy("_path", "_comment"))).where(F.col("_pos") <= F.col("_most"))
    line = F.when(F.col("_k") == "cycle", F.concat(F.lit("- "), "_comment")).otherwise(F.concat(F.lit("- "), "_path", F.lit(": "), "_comment"))
    part = i.groupBy(*keys, "_k", "_r", "_n", "_most").agg(F.array_sort(F.collect_list(F.struct("_pos", line.alias("l")))).alias("_x"))
    more = F.when(F.col("_n") > F.col("_most"), F.concat(F.lit("\n- and "), (F.col("_n") - F.col("_most")).cast("string"), F.lit(" more"))).otherwise("")
    part = part.select(*keys, "_r", F.concat(F.lit("### "), "_k", F.lit("\n"), F.array_join(F.transform("_x", lambda y: y["l"]), "\n"), more).alias("_s"))
    g = part.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", "_s"))).alias("_p"))
    return g.select(*keys, F.array_join(F.transform("_p", lambda y: y["_s"]), "\n\n").alias("feedback"))


def rule_issues(patches: DataFrame, files: DataFrame, reverted: DataFrame) -> DataFrame:
    """``(cycle_id, iteration, path, comment, severity)``: what rules find wrong with patches.

    Reverted files are major and not looked at further. Of the others: a file that isn't the cycle's (major), an empty
    text (critical), no change (minor), notes of an earlier check (minor, unless critical), else syntax (critical).
    ``files`` has ``cycle_id, path``, ``reverted`` ``cycle_id, iteration, path, reason``.
    """
    base = lambda c: F.regexp_extract(c, r"([^/\\]*)$", 1)
    keys = ["cycle_id", "iteration", "path"]
    back = reverted.select(*keys, F.concat(F.lit("reverted: "), F.coalesce("reason", F.lit(""))).alias("comment"), F.lit("major").alias("severity"))
    rest = patches.where("path is not null").join(reverted.select(*keys).distinct(), keys, "left_anti")
    known = files.where("path is not null").select("cycle_id", base(F.col("path")).alias("_b")).distinct()
    unknown = rest.withColumn("_b", base(F.col("path"))).join(known, ["cycle_id", "_b"], "left_anti").select(*keys, F.lit("unknown file").alias("comment"), F.lit("major").alias("severity"))
    old, new = F.coalesce("original", F.lit("")), F.coalesce("patched", F.lit(""))
    one = lambda c, s: F.struct(c.alias("comment"), F.lit(s).alias("severity"))
    kind = "array<struct<comment: string, severity: string>>"
    notes = F.transform(F.filter(F.coalesce("validation_issues", F.array().cast("array<string>")), lambda x: ~F.lower(x).contains("critical")), lambda x: one(F.concat(F.lit("note: "), F.lower(x)), "minor"))
    syntax = F.concat(F.transform(t.bracket_issues(F.col("patched"), F.col("ext")), lambda x: one(F.concat(F.lit("unbalanced "), x["pair"]), "critical")), F.when(t.truncation_note(F.col("patched")).isNotNull(), F.array(one(F.lit("cut"), "critical"))).otherwise(F.array().cast(kind)))
    found = F.concat(
        F.when(new == "", F.array(one(F.lit("empty"), "critical"))).otherwise(F.array().cast(kind)),
        F.when(old == new, F.array(one(F.lit("no change"), "minor"))).when(F.coalesce("pre_validated", F.lit(False)), notes).when(new != "", syntax).otherwise(F.array().cast(kind)),
    )
    return back.unionByName(unknown).unionByName(rest.select(*keys, F.inline(found)))


def repeated_mistakes(patches: DataFrame) -> DataFrame:
    """``(cycle_id, iteration, mistake)``: what the next try must not do again: texts that were cut, files that fail as they did
    the time before, three syntax issues and more."""
    cut = t.truncation_note(F.col("patched")).isNotNull()
    n = F.size(t.bracket_issues(F.col("patched"), F.col("ext"))) + cut.cast("int")
    p = patches.select("cycle_id", "iteration", "path", F.col("status").isin("failed", "reverted").alias("bad"), (F.col("status") == "reverted").alias("back"), cut.alias("cut"), F.when(F.coalesce("patched", F.lit("")) == "", 0).otherwise(n).alias("n"))
    g = p.groupBy("cycle_id", "iteration").agg(F.max("cut").alias("cut"), F.sum("n").alias("n"))
    own = g.select("cycle_id", "iteration", F.explode(F.array_compact(F.array(F.when(F.col("cut"), "whole files were cut"), F.when(F.col("n") >= 3, "three syntax issues and more")))).alias("mistake"))
    before = p.where("back").select("cycle_id", (F.col("iteration") + 1).alias("iteration"), "path").distinct()
    again = p.where("bad").join(before, ["cycle_id", "iteration", "path"], "left_semi").select("cycle_id", "iteration", F.lit("the same files fail again").alias("mistake")).distinct()
    return own.unionByName(again)


def diff_explanation(patches: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(cycle_id, pattern, title, files)``: what a cycle's changes amount to, told by what they add and remove."""
    names = lambda c, w: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"\b{w}\s+(\w+)"), F.lit(1))
    added = lambda w: F.array_except(names(F.col("patched"), w), names(F.col("original"), w))
    gone = F.size(F.array_except(t.imports(F.col("original"), F.col("ext")), t.imports(F.col("patched"), F.col("ext"))))
    p = patches.where("patched <> '' and patched <> coalesce(original, '')").select("cycle_id", "path", added("interface").alias("i"), added("class").alias("c"), gone.alias("g"))
    first = lambda c: F.array_join(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), 1, 2), ", ")
    g = p.groupBy("cycle_id").agg(first("i").alias("i"), first("c").alias("c"), F.sum("g").alias("g"), F.countDistinct("path").alias("files"))
    pattern = F.when(F.col("i") != "", F.concat(F.lit("interface extraction ("), "i", F.lit(")"))).when(F.col("c") != "", F.concat(F.lit("class extraction ("), "c", F.lit(")"))).when(F.col("g") > 0, "dependency removal").otherwise("code modification")
    g = g.join(nodes.select("cycle_id", "nodes"), "cycle_id").withColumn("pattern", pattern).withColumn("title", F.concat(F.lit("Break cycle via "), "pattern"))
    short = F.concat(F.lit("Break "), F.array_join(F.slice("nodes", 1, 2), " ↔ "), F.lit(" cycle"))
    return g.select("cycle_id", "pattern", F.when(F.length("title") > 60, short).otherwise(F.col("title")).alias("title"), "files")
