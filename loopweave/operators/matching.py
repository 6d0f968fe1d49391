"""Which file a node of a graph stands for, and the other way round; what patches do to references between nodes.

Matching is first-match by rule over the candidates of one graph: an equi-join on the graph's key, then the least
candidate that a rule accepts. The candidates of a graph are its own nodes and files, so no pairs beyond it arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def base_name(path: Column) -> Column:
    """What follows the last ``/`` or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """The base name without its last extension, in lower case."""
    return F.lower(F.regexp_replace(base_name(path), r"^(.+)\.[^.]*$", "$1"))


def bare(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[._]", "")


def node_files(nodes: DataFrame, files: DataFrame, key: str, explicit: DataFrame | None = None) -> DataFrame:
    """``(key, pos, node, path)``: the file of each node, null where none fits.

    ``nodes`` has ``key, pos, node``, ``files`` ``key, ord, path``, ``explicit`` ``key, node, path``. An explicit entry
    wins; else the first file in order whose stem is the node, but for case, dots and underscores, or one of which
    contains the other. Null names and paths match nothing; ties in order go to the lesser path.
    """
    f = files.where("path is not null").select(key, F.col("ord").alias("_o"), F.col("path").alias("_p"), bare(stem(F.col("path"))).alias("_s"))
    j = nodes.join(f, key).where(F.contains(bare(F.col("node")), F.col("_s")) | F.contains(F.col("_s"), bare(F.col("node"))))
    first = j.groupBy(key, "pos").agg(F.min(F.struct("_o", "_p")).alias("_m")).select(key, "pos", F.col("_m._p").alias("path"))
    out = nodes.join(first, [key, "pos"], "left")
    if explicit is not None:
        e = explicit.groupBy(key, "node").agg(F.min("path").alias("_e"))
        out = out.join(e, [key, "node"], "left").withColumn("path", F.coalesce("_e", "path"))
    return out.select(key, "pos", "node", "path")


def file_nodes(files: DataFrame, nodes: DataFrame, key: str, id_col: str, strict: bool = False) -> DataFrame:
    """``(id, node)``: the first node in order that each file stands for, null where none fits.

    By default one name contains the other. ``strict`` asks for equal names, a leading ``I`` on one side, or one name
    ending the other behind a character that is neither letter nor digit.
    """
    f, n = stem(F.col("path")), F.lower("node")
    if strict:
        ends = lambda a, b: F.endswith(a, b) & ~F.substring(a, F.length(a) - F.length(b), F.lit(1)).rlike(r"[\p{L}\p{N}]")
        fits = (f == n) | (f == F.concat(F.lit("i"), n)) | (n == F.concat(F.lit("i"), f)) | ends(f, n) | ends(n, f)
    else:
        fits = F.contains(f, n) | F.contains(n, f)
    j = files.where("path is not null").select(key, id_col, "path").join(nodes.where("node <> ''"), key).where(fits)
    first = j.groupBy(id_col).agg(F.min(F.struct("pos", "node")).alias("_m")).select(id_col, F.col("_m.node").alias("node"))
    return files.select(id_col).join(first, id_col, "left")


def mentions(text: Column, names: Column) -> Column:
    """Those of an array of names that ``text`` has as whole words, in the array's order."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\w+"), F.lit(0))
    odd = F.filter(names, lambda n: ~n.rlike(r"^\w+$") & F.regexp_like(F.coalesce(text, F.lit("")), F.concat(F.lit(r"\b"), F.regexp_replace(n, r"(\W)", r"\\$1"), F.lit(r"\b"))))
    return F.array_intersect(names, F.concat(words, odd))


NEW_INTERFACE = r"\binterface\s+I\w+"


def cycle_impact(patches: DataFrame, nodes: DataFrame, key: str, id_col: str) -> DataFrame:
    """``(key, id, removed, added, new_interface)`` of the patches that change something (``diff`` isn't empty).

    ``removed`` and ``added`` are the nodes whose mention went or came; ``nodes`` has the key and an array ``nodes``.
    """
    j = patches.where("diff <> ''").join(nodes.select(key, "nodes"), key)
    before, after = mentions(F.col("original"), F.col("nodes")), mentions(F.col("patched"), F.col("nodes"))
    j = j.select(key, id_col, before.alias("_b"), after.alias("_a"), (F.coalesce("patched", F.lit("")).rlike(NEW_INTERFACE) & ~F.coalesce("original", F.lit("")).rlike(NEW_INTERFACE)).alias("new_interface"))
    return j.select(key, id_col, F.array_except("_b", "_a").alias("removed"), F.array_except("_a", "_b").alias("added"), "new_interface")


def unbroken(impact: DataFrame, keys: list[str]) -> DataFrame:
    """The keys all of whose changes leave every mention in place: the cycle may well still be there (a major issue)."""
    return impact.groupBy(*keys).agg(F.max(F.size("removed")).alias("_m")).where("_m = 0").select(*keys)


def file_budgets(paths: DataFrame, priorities: DataFrame, key: str, default: int = 4000) -> DataFrame:
    """``(…, budget)``: the budget of the first priority row whose path is the same or ends in the path's base name."""
    p = priorities.select(key, F.col("position").alias("_pos"), F.col("path").alias("_p"), F.col("budget").alias("_b"))
    j = paths.select(key, "path").distinct().join(p, key).where((F.col("path") == F.col("_p")) | F.endswith("_p", base_name(F.col("path"))))
    first = j.groupBy(key, "path").agg(F.min(F.struct("_pos", "_p", "_b")).alias("_m")).select(key, "path", F.col("_m._b").alias("budget"))
    return paths.join(first, [key, "path"], "left").withColumn("budget", F.coalesce("budget", F.lit(default)))


def connected(files: DataFrame, nodes: DataFrame, key: str, id_col: str) -> DataFrame:
    """``(id, node)``: all nodes whose name stands in the file's path, dots as they are or as separators."""
    p, n = F.lower("path"), F.lower("node")
    return files.select(key, id_col, "path").join(nodes.select(key, "node").where("node <> ''"), key).where(F.contains(p, n) | F.contains(p, F.replace(n, F.lit("."), F.lit("/")))).select(id_col, "node").distinct()


def introduced(original: Column, patched: Column, ext: Column) -> Column:
    """Warnings of a patched text: ``empty``; for each pair ``introduced`` or ``worsened`` with its brackets; ``duplicate``
    with the number of the first line that the next repeats and the original doesn't."""
    old, new = F.coalesce(original, F.lit("")), F.coalesce(patched, F.lit(""))
    each = []
    for p, on in [*((p, F.lit(True)) for p in t.PAIRS), (("<", ">"), ext.isin("cs", "java", "ts", "tsx"))]:
        a, b = F.abs(t.balance(old, p)), F.abs(t.balance(new, p))
        each.append(F.when(on & (b > a), F.concat(F.when(a == 0, "introduced ").otherwise("worsened "), F.lit("".join(p)))))
    lines = F.split(new, "\n")
    # lines beside the next one, so that no element looks the array up again
    pairs = F.zip_with(lines, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x, y: F.when((F.trim(x) != "") & (x == y), x))
    twice = F.filter(F.transform(pairs, lambda x, i: F.when(x.isNotNull() & ~F.contains(old, F.concat(x, F.lit("\n"), x)), i + 1)), lambda x: x.isNotNull())
    each.append(F.when(F.size(twice) > 0, F.concat(F.lit("duplicate "), F.get(twice, F.lit(0)).cast("string"))))
    return F.when(new == "", F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*each)))
