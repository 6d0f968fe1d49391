"""Answers as JSON, and texts found in texts: column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGE = "struct<path: string, patched: string, prepend: string, append: string, search_replace: array<struct<search: string, replace: string>>>"
#: What an answer may hold.
ANSWER = (
    f"struct<strategy_used: string, strategy: string, reasoning: string, rationale: string, remaining_cycle: string, new_files: array<struct<path: string, content: string, purpose: string>>, changes: array<{CHANGE}>, patches: array<{CHANGE}>, "
    "patch: struct<path: string, patched: string>, target_edge: struct<`from`: string, `to`: string, import_statement: string>>"
)
# fixed values: how sure a minimal diff is by its strategy
STRATEGY_CONFIDENCE = {"parameter_injection": 0.9, "lazy_import": 0.85, "callback": 0.8, "interface_extraction": 0.6}


def payload(answer: Column) -> Column:
    """The first of these that is valid JSON, null if none is: what a code fence holds, the whole, from the first to the last brace."""
    fenced = F.nullif(F.regexp_extract(answer, r"(?s)```(?:json)?[ \t]*\n(.*?)```", 1), F.lit(""))
    whole = F.trim(answer)
    braces = F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull() & x.rlike(r"^\s*\{"), x) for x in (fenced, whole, braces)])


def parsed(answer: Column) -> Column:
    """The fields of :data:`ANSWER`; null for an answer without a payload."""
    return F.from_json(payload(answer), ANSWER)


def location(content: Column, search: Column) -> Column:
    """``(first, last)`` line, from 1, of the first place of ``search``; where it has none, of the first place with blanks
    and tabs run together in both; (0, 0) without one or for empty texts."""
    squeezed = lambda x: F.regexp_replace(x, r"[ \t]+", " ")
    at = F.instr(content, search)
    loose = F.instr(squeezed(content), squeezed(search))
    before = F.when(at > 0, F.left(content, at - 1)).when(loose > 0, F.left(squeezed(content), loose - 1))
    n = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    first = F.when((F.coalesce(content, F.lit("")) == "") | (F.coalesce(search, F.lit("")) == ""), 0).otherwise(F.coalesce(n(before) + 1, F.lit(0)))
    return F.struct(first.cast("int").alias("first"), F.when(first > 0, first + n(search)).otherwise(0).cast("int").alias("last"))


def around(content: Column, first: Column, last: Column, lines: int = 7) -> tuple[Column, Column]:
    """What stands up to ``lines`` lines before line ``first`` and behind line ``last``."""
    all_ = F.split(content, "\n")
    lo = F.greatest(first - lines, F.lit(1))
    return F.array_join(F.slice(all_, lo, F.greatest(first - lo, F.lit(0))), "\n"), F.array_join(F.slice(all_, last + 1, F.lit(lines)), "\n")


def line_count(text: Column) -> Column:
    """Lines of a text; a line end at its end opens no further one."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\n\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(t, "\n")))


def change_label(before: Column, after: Column) -> Column:
    """What a change does, the first that holds: adds or removes code, is none, adds an interface, adds or changes an import,
    changes a type, or makes the text longer or shorter."""
    a, b = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    imports = lambda x: x.contains("using ") | x.contains("import ")
    types = lambda x: F.regexp_extract_all(x, F.lit(r":\s*(\w+)"), F.lit(1))
    ta, tb, na, nb = types(a), types(b), line_count(a), line_count(b)
    size = F.concat(na.cast("string"), F.lit(" to "), nb.cast("string"), F.lit(" lines"))
    return (
        F.when((a == "") & (b != ""), "add code").when((a != "") & (b == ""), "remove code").when(a == b, "")
        .when(F.lower(b).contains("interface") & ~F.lower(a).contains("interface"), "add interface").when(imports(b) & ~imports(a), "add import").when(imports(b), "change import")
        .when((F.size(ta) > 0) & (F.size(tb) > 0) & (ta != tb), F.concat(F.lit("type "), F.get(ta, F.lit(0)), F.lit(" to "), F.get(tb, F.lit(0))))
        .when(nb > na, F.concat(F.lit("expand "), size)).when(nb < na, F.concat(F.lit("simplify "), size)).otherwise("modify code")
    )


# fixed values: how a text names a line, in order
HINTS = (r"(?i)(?://|#)\s*(?:line|near line|around line)\s*(\d+)", r"(?i)\(line\s*(\d+)\)", r"(?i)line\s*(\d+)\s*(?:\z|:)")


def line_hint(text: Column) -> Column:
    """The line (from 0) that a text names, by the first of :data:`HINTS` that it has; null without one."""
    return F.coalesce(*[F.try_to_number(F.nullif(F.regexp_extract(text, h, 1), F.lit("")), F.lit("999999999")) for h in HINTS]).cast("int") - 1


# fixed values: openings before which an appended text gets a blank line
OPENINGS = ("public ", "internal ", "private ", "namespace ", "using ", "class ", "interface ")


def with_ends(text: Column, append: Column | None = None, prepend: Column | None = None) -> Column:
    """``text`` with line feeds, with something put before and behind it on lines of their own; a declaration is set off by
    a blank line. Null and empty additions change nothing."""
    lf = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), "\r\n?", "\n")
    out = lf(text)
    if prepend is not None:
        p = lf(prepend)
        out = F.when(p == "", out).when((out != "") & ~F.endswith(p, F.lit("\n")), F.concat(p, F.lit("\n"), out)).otherwise(F.concat(p, out))
    if append is not None:
        a = lf(append)
        opens = F.lit(False)
        for o in OPENINGS:
            opens = opens | F.startswith(F.regexp_replace(a, r"^\s+", ""), F.lit(o))
        base = F.when((out != "") & ~F.endswith(out, F.lit("\n")), F.concat(out, F.lit("\n"))).otherwise(out)
        base = F.when(opens & (base != "") & ~F.endswith(base, F.lit("\n\n")), F.concat(F.regexp_replace(base, r"\n+\z", ""), F.lit("\n\n"))).otherwise(base)
        out = F.when(a == "", out).otherwise(F.concat(base, a))
    return out


def with_numbered_ends(df: DataFrame, text: Column, most: int | Column = 8000, name: str = "numbered") -> DataFrame:
    """``df`` with ``text`` numbered by lines; of one over ``most`` characters whole lines from its start (three fifths) and its end
    (two fifths), with the number of those left out between them. Null and empty texts give null."""
    most = F.lit(most) if isinstance(most, int) else most
    stage = lambda d, **cols: d.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
    lines = lambda x: F.split(F.regexp_replace(x, r"\n\z", ""), "\n")
    share = lambda x: F.floor((F.col("_most") - 100) * x).cast("int")
    df = stage(df, _text=text, _most=most.cast("int"))
    head, tail = F.left("_text", share(F.lit(0.6))), F.right("_text", share(F.lit(0.4)))
    head = F.when(F.instr(head, "\n") > 1, F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise(head)
    tail = F.when(F.instr(tail, "\n") > 1, F.regexp_replace(tail, r"\A[^\n]*\n", "")).otherwise(tail)
    df = stage(df, _lines=lines(F.col("_text")), _head=lines(head), _tail=lines(tail))
    # the number of the tail's first line as a column of its own, for the lambda below
    df = stage(df, _first=F.size("_lines") - F.size("_tail") + 1)
    number = lambda x, first: F.array_join(F.transform(x, lambda y, i: F.concat(F.lpad((i + first).cast("string"), 4, " "), F.lit(" | "), y)), "\n")
    note = F.concat(F.lit("\n     | ... ("), (F.col("_first") - 1 - F.size("_head")).cast("string"), F.lit(" lines omitted, lines "), (F.size("_head") + 1).cast("string"), F.lit("-"), (F.col("_first") - 1).cast("string"), F.lit(") ...\n"))
    out = F.when(F.coalesce("_text", F.lit("")) == "", F.lit(None)).when(F.length("_text") > F.col("_most"), F.concat(number("_head", F.lit(1)), note, number("_tail", F.col("_first")))).otherwise(number("_lines", F.lit(1)))
    return df.withColumn(name, out).drop("_text", "_most", "_lines", "_head", "_tail", "_first")


def model_billions(name: Column) -> Column:
    """The size that a model's name tells, in billions; null without one."""
    return F.try_to_number(F.nullif(F.regexp_extract(F.lower(name), r"(\d+)b", 1), F.lit("")), F.lit("999999")).cast("int")


def plain_format_wanted(name: Column, threshold: int = 14, small: tuple[str, ...] = ()) -> Column:
    """Whether a model gets the plain format: by its size, else by one of the ``small`` names in its own."""
    hit = F.lit(False)
    for s in small:
        hit = hit | F.contains(F.lower(name), F.lit(s))
    return F.coalesce(model_billions(name) <= threshold, hit, F.lit(False))


def is_plain_format(answer: Column) -> Column:
    """Whether an answer has a line of the plain format and doesn't look like JSON."""
    a = F.coalesce(answer, F.lit(""))
    return a.rlike(r"(?im)^(?:STRATEGY|NEW_FILE|MODIFY):") & ~F.startswith(F.regexp_replace(a, r"^\s+", ""), F.lit("{")) & ~a.contains('{"reasoning"')
