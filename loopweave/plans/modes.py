"""Whole stages as compositions of the operators: what is asked, how an answer is applied, and what comes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as a
from ..functions import text as t
from ..operators import explaining as x
from ..operators import matching as m
from ..operators import patching as p
from ..tables import extension

#: Characters of a token that prompts are cut by, and the share of the context that file snippets get, by mode.
CHARS, SHARES = 4, {"relaxed": 0.50, "line_patch": 0.45, "minimal_diff": 0.40, "simple": 0.45}
# fixed values: which search goes first for a strategy
STRATEGY_LOOKUPS = {
    "interface_extraction": "how to extract interface break dependency example", "dependency_inversion": "implementing dependency inversion principle example",
    "shared_module": "extract common module reduce coupling example", "mediator": "mediator pattern implementation example",
}
#: An example for a strategy, and for any other.
EXAMPLES = {"interface_extraction": "A needs IB; B implements IB; A no longer imports B.", "dependency_inversion": "The higher module owns the abstraction; the lower one implements it.", "shared_module": "What A and B share moves to C; both import C.", "mediator": "A and B talk to M; neither imports the other."}
ANY_EXAMPLE = "Extract an interface, invert the dependency, or move what is shared into a module of its own."


def example(strategy: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in EXAMPLES.items() for v in kv])
    return F.coalesce(F.try_element_at(table, strategy), F.lit(ANY_EXAMPLE))


def snippet_room(mode: str, context_window: int, files: Column) -> Column:
    """Characters that each of a cycle's files gets in a mode's prompt."""
    return F.floor(F.lit(int(context_window * SHARES[mode]) * CHARS) / F.greatest(files, F.lit(1))).cast("int")


def numbered_files(files: DataFrame, key: str, id_col: str, mode: str = "relaxed", context_window: int = 4096) -> DataFrame:
    """``(key, id, text)``: each file that has content, numbered, within its share of the mode's room."""
    n = files.groupBy(key).agg(F.count("*").alias("_n"))
    j = files.join(n, key).where("content <> ''").withColumn("_most", snippet_room(mode, context_window, F.col("_n")))
    j = a.with_numbered_ends(j.withColumnRenamed("_most", "_room"), F.col("content"), F.col("_room"), "_shown")
    return j.select(key, id_col, F.concat(F.lit("--- FILE: "), F.coalesce("path", F.lit("unknown")), F.lit(" ---\n"), "_shown").alias("text"))


def matched_changes(answers: DataFrame, files: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """The changes of answers, each with the cycle's own path of the file it means: the same path, else the first one that ends in
    its base name; new files and files that aren't there keep theirs."""
    key = id_cols[0]
    ch = p.changes(answers, id_cols, text_col)
    f = files.select(key, F.col("path").alias("_own")).where("_own is not null").distinct()
    means = ch.select(key, "path").distinct().join(f, key).where((F.col("path") == F.col("_own")) | F.endswith("_own", F.concat(F.lit("/"), m.base_name(F.col("path")))) | (F.col("_own") == m.base_name(F.col("path"))))
    means = means.groupBy(key, "path").agg(F.min(F.struct((F.col("path") != F.col("_own")).alias("k"), "_own")).alias("_m")).select(key, "path", "_m._own")
    j = ch.join(means, [key, "path"], "left")
    return j.withColumn("path", F.when(F.col("kind") == "new", F.col("path")).otherwise(F.coalesce("_own", "path"))).drop("_own")


def apply_answers(answers: DataFrame, files: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """``(id…, path, kind, status, confidence, note, patched, diff)``: answers of any layout applied to the files they mean.

    ``status`` is ``new_file``, ``failed`` (nothing could be applied), ``unchanged``, or ``applied``.
    """
    key = id_cols[0]
    f = files.groupBy(key, "path").agg(F.min("content").alias("content"))
    done = p.applied(matched_changes(answers, files, id_cols, text_col), f, id_cols).join(f.withColumnRenamed("content", "_old"), [key, "path"], "left")
    status = F.when(F.col("kind") == "new", "new_file").when(F.col("patched").isNull(), "failed").when(F.col("patched") == F.col("_old"), "unchanged").otherwise("applied")
    rows = done.withColumn("status", status).withColumn("_id", F.concat_ws("\x00", *id_cols, "path", "kind"))
    d = p.diffs(rows.select("_id", "path", F.col("_old").alias("original"), "patched").where("patched is not null"), "_id").select("_id", "diff")
    return rows.join(d, "_id", "left").select(*id_cols, "path", "kind", "status", "confidence", "note", "patched", F.coalesce("diff", F.lit("")).alias("diff"))


def scaffolds(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, path, purpose, content, errors, valid)``: new files that answers give as a scaffold, judged as new files."""
    kind = "struct<scaffold_files: array<struct<path: string, content: string, purpose: string>>>"
    s = answers.select(id_col, F.explode(F.from_json(a.payload(F.col(text_col)), kind)["scaffold_files"]).alias("s")).select(id_col, "s.path", "s.purpose", F.coalesce("s.content", F.lit("")).alias("content"))
    return s.withColumn("errors", scaffold_errors(F.col("content"), extension(F.col("path")))).withColumn("valid", F.size("errors") == 0)


def scaffold_errors(content: Column, ext: Column) -> Column:
    """What a new file lacks: balance, and the constructs its language asks for."""
    unbalanced = F.lit(False)
    for pair in t.PAIRS:
        unbalanced = unbalanced | (t.balance(content, pair) != 0)
    lacks = lambda exts, rx, note: F.when(ext.isin(*exts) & ~content.rlike(rx), F.lit(note))
    return F.array_compact(F.array(
        F.when(content == "", F.lit("empty")), F.when(unbalanced, F.lit("unbalanced")), lacks(("cs",), r"\b(interface|class|struct|record)\s+\w+", "no type"), lacks(("cs",), r"\bnamespace\s+[\w.]+", "no namespace"), lacks(("py",), r"\bclass\s+\w+", "no type"),
        lacks(("ts", "tsx"), r"\b(interface|class|type|abstract class)\s+\w+", "no type"), lacks(("ts", "tsx"), r"\bexport\s+(interface|class|type|abstract)", "not exported"),
        lacks(("java",), r"\b(interface|class|abstract class)\s+\w+", "no type"), lacks(("java",), r"\bpackage\s+[\w.]+;", "no package"),
    ))


def explained(patches: DataFrame, nodes: DataFrame, approved: DataFrame) -> DataFrame:
    """:func:`explaining.diff_explanation` of the cycles that were approved; others get none."""
    return x.diff_explanation(patches, nodes).join(approved.where("approved").select("cycle_id").distinct(), "cycle_id", "left_semi")


def within(prompt: Column, most: int, *, reference: str = "## Reference", examples: tuple[str, ...] = ("**Common Refactoring Patterns:**",)) -> Column:
    """A prompt brought under ``most`` characters: the reference section goes first, then sections of examples, each up to the next
    heading, and only while it is too long; what is still too long is cut, with a mark."""
    def without(x: Column, marker: str) -> Column:
        at = F.instr(x, F.lit(marker))
        rest = F.substring(x, at + len(marker), F.length(x))
        nxt = F.instr(rest, F.lit("\n## "))
        return F.when((F.length(x) > most) & (at > 0) & (nxt > 0), F.concat(F.left(x, at - 1), F.substring(rest, nxt, F.length(rest)))).otherwise(x)

    out = prompt
    for marker in (reference, *examples):
        out = without(out, marker)
    return F.when(F.length(out) > most, F.concat(F.left(out, F.lit(most - 100)), F.lit("\n\n... [cut]"))).otherwise(out)
