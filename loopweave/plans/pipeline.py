"""Whole runs, as compositions of the operators: discover cycles in a source tree, and turn answers into judged patches.

Nothing here loops over rows or cycles: the retries of a run are rows with an iteration number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import graph as g
from ..operators import patching as p
from ..sources import readers
from ..tables import extension


def analyze(edges: DataFrame, key: str, *, layers: DataFrame | None = None, ignore_modules: list[str] = (), ignore_patterns: list[str] = (), known_sets: DataFrame | None = None, min_severity: str = "minor", min_score: float = 0.0, order: str = "impact_first") -> DataFrame:
    """Cycles of the graphs in ``edges``, scored, filtered and ranked: the columns of :func:`graph.impact`, ``cycle_key``,
    ``description`` and ``position``."""
    e = g.drop_ignored(edges, list(ignore_modules), list(ignore_patterns))
    c = g.elementary_cycles(e, key).withColumn("cycle_key", g.cycle_key(F.col("nodes"))).withColumn("description", g.describe(F.col("nodes")))
    s = g.impact(c, e, key, node_layers=layers, weights=g.edge_weights(e, key), known_sets=known_sets)
    s = s.withColumn("impact_score", F.round("impact_score", 9))  # sums in another order may differ in the last digits
    return g.prioritized(g.at_least(s, min_severity, min_score), order, [key], "cycle_key")


def analyze_directory(spark: SparkSession, root: str, *, extensions: tuple[str, ...] = readers.EXTENSIONS, exclude: tuple[str, ...] = ("node_modules", "dist"), **options) -> DataFrame:
    """:func:`analyze` of the relative imports between the files under ``root``."""
    files = readers.source_tree(spark, root, extensions, exclude)
    return analyze(readers.resolved_imports(files, extensions=extensions).withColumn("graph", F.lit(root)), "graph", **options)


def process(answers: DataFrame, files: DataFrame, id_cols: list[str], text_col: str, least: float = 0.5) -> DataFrame:
    """Answers as judged patches: ``(id…, path, kind, applied, confidence, patched, issues, status)``.

    A change set applies to the file of the same path under the first id column; it is ``failed`` without a place to
    apply, ``unchanged`` if nothing differs, ``partial`` with a critical bracket issue that the file hadn't, else
    ``applied``; all of an answer's patches are ``reverted`` if any of them failed.
    """
    key = id_cols[0]
    done = p.applied(p.changes(answers, id_cols, text_col), files, id_cols)
    j = done.join(files.select(key, "path", F.col("content").alias("_old")), [key, "path"], "left")
    ext = extension(F.col("path"))
    issues = F.transform(F.array_except(t.bracket_issues(F.col("patched"), ext), t.bracket_issues(F.col("_old"), ext)), lambda x: F.concat(x["severity"], F.lit(" "), x["pair"]))
    j = j.withColumn("issues", F.coalesce(issues, F.array().cast("array<string>")))
    failed = F.col("patched").isNull() | (F.col("confidence") < least)
    status = F.when(failed, "failed").when(F.col("patched") == F.col("_old"), "unchanged").when(F.exists("issues", lambda x: x.startswith("critical")), "partial").otherwise("applied")
    from pyspark.sql.window import Window as W

    j = j.withColumn("_s", status)
    any_failed = F.bool_or(F.col("_s") == "failed").over(W.partitionBy(*id_cols))
    return j.select(*id_cols, "path", "kind", "applied", "confidence", "patched", "issues", F.when(any_failed & F.col("_s").isin("applied", "partial"), "reverted").otherwise(F.col("_s")).alias("status"))


def verdicts(patches: DataFrame, id_cols: list[str]) -> DataFrame:
    """One row per answer: patches by status, mean confidence and whether it may go in."""
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s)
    g_ = patches.groupBy(*id_cols).agg(F.count("*").alias("patches"), n("applied"), n("partial"), n("unchanged"), n("failed"), n("reverted"), F.avg("confidence").alias("confidence"))
    return g_.withColumn("approved", (F.col("applied") > 0) & (F.col("failed") + F.col("reverted") + F.col("partial") == 0))
