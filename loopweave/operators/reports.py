"""Reports as columns: listings, summaries and Markdown sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MARKS = {"applied": "✅", "unchanged": "✅", "partial": "⚠️", "reverted": "⚠️", "failed": "❌"}
# fixed values: what to do next, by why a patch failed
NEXT_STEPS = {"no_op": "State a change that differs from the file.", "search_mismatch": "Copy the search text from the file as it stands.", "syntax": "Balance the brackets and close all literals.", "validation": "Address the validator's issues first.", "unknown": "Try a smaller change."}


def listing(nodes: Column, shown: int = 4) -> Column:
    """The first nodes of a cycle, and how many there are if not all are shown."""
    head = F.array_join(F.slice(nodes, 1, shown), " -> ")
    return F.when(F.size(nodes) > shown, F.concat(head, F.lit(" ... ("), F.size(nodes).cast("string"), F.lit(" total)"))).otherwise(head)


def shortened(text: Column, n: int) -> Column:
    """``text`` cut to ``n`` characters, telling how many more there were."""
    more = F.length(text) - n
    return F.when(more > 0, F.concat(F.left(text, F.lit(n)), F.lit("... ("), more.cast("string"), F.lit(" more chars)"))).otherwise(text)


def failure_class(status: Column, original: Column, patched: Column, issues: Column, applied: Column, total: Column) -> Column:
    """Why a patch failed; null for one that didn't."""
    text = F.lower(F.array_join(F.coalesce(issues, F.array().cast("array<string>")), " "))
    same = F.coalesce(original, F.lit("")) == F.coalesce(patched, F.lit(""))
    return F.when(~status.isin("failed", "reverted", "partial"), F.lit(None)).when((status != "reverted") & same & (F.length(original) > 0), "no_op").when(applied < total, "search_mismatch").when(text.contains("syntax"), "syntax").when(text != "", "validation").otherwise("unknown")


def status_report(patches: DataFrame, key: str = "cycle_id") -> DataFrame:
    """``(key, report)``: a Markdown list of a cycle's patches, one line each, by path."""
    m = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    line = F.concat(F.lit("- "), F.coalesce(F.try_element_at(m, F.col("status")), F.lit("❌")), F.lit(" `"), F.coalesce("path", F.lit("?")), F.lit("` "), F.coalesce("status", F.lit("unknown")))
    g = patches.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("path", F.lit("?")).alias("p"), F.col("patch_id").alias("i"), line.alias("l")))).alias("_l"))
    return g.select(key, F.concat(F.lit("## Patches\n"), F.array_join(F.transform("_l", lambda x: x["l"]), "\n")).alias("report"))


def decision(issues: DataFrame, key: list[str]) -> DataFrame:
    """``(key…, approved, critical, major, minor)``: approved without a critical or major issue; ``issues`` has ``severity``."""
    n = lambda s: F.sum(F.when(F.col("severity") == s, 1).otherwise(0)).alias(s)
    g = issues.groupBy(*key).agg(n("critical"), n("major"), n("minor"))
    return g.withColumn("approved", (F.col("critical") == 0) & (F.col("major") == 0))


def formatted_context(hits: DataFrame, key: str, text: str, source: str, rank: str, max_chars: int) -> DataFrame:
    """``(key, context)``: the hits of a query as numbered sources, cut to ``max_chars``."""
    part = F.concat(F.lit("[Source "), F.col(rank).cast("string"), F.lit(": "), F.coalesce(F.col(source), F.lit("unknown")), F.lit("]\n"), F.col(text))
    g = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), part.alias("t")))).alias("_p"))
    joined = F.array_join(F.transform("_p", lambda x: x["t"]), "\n\n---\n\n")
    return g.select(key, F.when(F.length(joined) > max_chars, F.concat(F.left(joined, F.lit(max_chars)), F.lit("\n... [truncated]"))).otherwise(joined).alias("context"))


def matched_patches(patches: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """``(patch_id, file_id, tier)``: the file a patch means: the same path, the same base name, that without case.

    All tiers are equi-joins on the base name, and the best tier, then the first file wins.
    """
    base = lambda c: F.lower(F.regexp_extract(F.regexp_replace(c, r"\\", "/"), r"([^/]*)$", 1))
    a = patches.select(key, "patch_id", F.col("path").alias("_p"), base(F.col("path")).alias("_b")).where("_b <> ''")
    b = files.select(key, "file_id", F.col("path").alias("_f"), base(F.col("path")).alias("_b")).where("_b <> ''")
    tier = F.when(F.col("_p") == F.col("_f"), 1).when(F.substring_index("_p", "/", -1) == F.substring_index("_f", "/", -1), 2).otherwise(3)
    j = a.join(b, [key, "_b"]).withColumn("tier", tier)
    w = W.partitionBy("patch_id").orderBy("tier", "file_id")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("patch_id", "file_id", "tier")
