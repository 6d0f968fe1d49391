"""Packing files into a prompt: priorities, budgets, greedy selections and snippets, as windows over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# fixed values: shares of what is left after the reserve for the answer, by stage
BUDGETS = {
    "describer": {"reserve": 0.15, "system": 0.10, "cycle": 0.10, "file": 0.50, "rag": 0.25, "examples": 0.05},
    "refactor": {"reserve": 0.30, "system": 0.08, "cycle": 0.07, "file": 0.55, "rag": 0.15, "examples": 0.15},
    "refactor_feedback": {"reserve": 0.30, "system": 0.08, "cycle": 0.07, "file": 0.50, "rag": 0.10, "examples": 0.10, "feedback": 0.15},
    "validator": {"reserve": 0.15, "system": 0.10, "cycle": 0.15, "file": 0.60, "rag": 0.10, "examples": 0.05},
}


def budget(total: int) -> list[tuple[str, str, int]]:
    """``(stage, part, tokens)`` of a context of ``total`` tokens."""
    out = []
    for stage, b in BUDGETS.items():
        free = total - int(total * b["reserve"])
        out += [(stage, part, int(free * share)) for part, share in b.items() if part != "reserve"]
    return out


def whole_files(files: DataFrame, key: str, order: str, size: Column, room: int, largest: int) -> DataFrame:
    """The files of a key taken whole, smallest first, while they fit into ``room``; a file over ``largest`` is never.

    Sizes only grow in that order, so the greedy choice is a running sum. Ties go by ``order``.
    """
    f = files.withColumn("size", size).where((F.col("size") > 0) & (F.col("size") <= largest))
    used = F.sum("size").over(W.partitionBy(key).orderBy("size", order).rowsBetween(W.unboundedPreceding, 0))
    return f.withColumn("used", used).where(F.col("used") <= room)


def packed(files: DataFrame, key: str, order: list[str], size: Column, room: int) -> DataFrame:
    """Files in order until ``room`` is used up: ``(…, size, given)``; the one that overflows gets what is left."""
    w = W.partitionBy(key).orderBy(*order)
    f = files.withColumn("size", size).withColumn("_before", F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return f.where(F.col("_before") < room).withColumn("given", F.least(F.col("size"), room - F.col("_before"))).drop("_before")


def proportional(files: DataFrame, key: str, score: Column, room: int, least: int = 500) -> DataFrame:
    """Each file's share of ``room`` by its score (1 at least), never under ``least``."""
    s = F.greatest(score, F.lit(1))
    f = files.withColumn("_s", s)
    return f.withColumn("budget", F.greatest(F.floor(F.lit(float(room)) * F.col("_s") / F.sum("_s").over(W.partitionBy(key))).cast("bigint"), F.lit(least))).drop("_s")


def islands(ranges: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """``(key, start, end)``: ranges merged where they overlap or touch."""
    w = W.partitionBy(key).orderBy(start, end)
    r = ranges.withColumn("_top", F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)))
    r = r.withColumn("_no", F.sum(F.when(F.col(start) <= F.col("_top") + 1, 0).otherwise(1)).over(w))
    return r.groupBy(key, "_no").agg(F.min(start).alias(start), F.max(end).alias(end)).select(key, start, end)


def file_score(mentioned: Column, issue: Column, length: Column, in_degree: Column, out_degree: Column, first: Column) -> Column:
    """Priority of a file: an issue 50, named by the cycle 40, joint 30, ten a connection, size and naming."""
    return (
        F.when(issue, 50).otherwise(0) + F.when(mentioned, 40).otherwise(0) + F.when(first, 30).otherwise(0) + 10 * (F.coalesce(in_degree, F.lit(0)) + F.coalesce(out_degree, F.lit(0)))
        + F.when(length < 1000, 15).when(length < 3000, 10).when(length > 10000, -10).otherwise(0)
    )


def numbered(text: Column, first: int = 1) -> Column:
    """``text`` with four-column line numbers."""
    lines = F.split(text, "\n")
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + first).cast("string"), 4, " "), F.lit(" | "), x)), "\n")


def head_and_tail(text: Column, head: int = 50, tail: int = 20, over: int = 80) -> Column:
    """Texts of more than ``over`` lines as their first and last lines."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    return F.when(n > over, F.concat(F.array_join(F.slice(lines, 1, head), "\n"), F.lit("\n... ("), (n - head - tail).cast("string"), F.lit(" lines omitted)\n"), F.array_join(F.slice(lines, n - tail + 1, F.lit(tail)), "\n"))).otherwise(text)


def interesting_lines(files: DataFrame, id_col: str, content: str, pattern: str, before: int, after: int) -> DataFrame:
    """``(id, start, end)``: merged windows around the lines that match ``pattern``, numbered from 1, within the text."""
    at = files.where(F.col(content).isNotNull()).select(id_col, F.size(F.split(content, "\n")).alias("_n"), F.posexplode(F.split(content, "\n")).alias("_i", "_l")).where(F.col("_l").rlike(pattern))
    r = at.select(id_col, F.greatest(F.col("_i") + 1 - before, F.lit(1)).alias("start"), F.least(F.col("_i") + 1 + after, F.col("_n")).alias("end"))
    return islands(r, id_col)
