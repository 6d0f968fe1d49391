"""Scalar text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs of brackets, and the extensions whose angle brackets pair as well.
PAIRS = (("{", "}"), ("(", ")"), ("[", "]"))
ANGLED = ("cs", "java", "ts", "tsx", "cpp", "hpp", "h")
# fixed values: how a text ends that was left out
ENDINGS = ("...", "// ...", "/* ...", "// more", "// etc", "// continued", "// rest of")
MARKERS = ("...", "// truncated", "// remaining code", "// rest of", "// etc.", "// more code")
# fixed values: words in an issue's text, by severity
CRITICAL = ("syntax error", "unbalanced", "missing import", "broken reference", "undefined", "not found", "cannot resolve")
MAJOR = ("cycle not broken", "dependency still exists", "incomplete", "no changes", "original unchanged", "still imports")
MINOR = ("naming", "style", "convention", "could be improved", "consider", "optional")
# fixed values: characters per token
CHARS_PER_TOKEN = {"code_python": 3.5, "code_csharp": 3.2, "code_java": 3.2, "code_javascript": 3.4, "code_generic": 3.3, "prose": 4.0, "json": 3.0, "diff": 3.5}
CONTENT_TYPES = {"py": "code_python", "cs": "code_csharp", "java": "code_java", "js": "code_javascript", "mjs": "code_javascript", "ts": "code_javascript", "tsx": "code_javascript", "jsx": "code_javascript", "json": "json", "md": "prose", "txt": "prose", "diff": "diff"}
LANGUAGES = {"py": "python", "cs": "csharp", "java": "java", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "json": "json"}


def lookup(key: Column, table: dict[str, str], default: str | None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def occurrences(text: Column, what: str) -> Column:
    """How often ``what`` occurs, without overlap; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return ((F.length(t) - F.length(F.replace(t, F.lit(what), F.lit("")))) / len(what)).cast("int")


def balance(text: Column, pair: tuple[str, str]) -> Column:
    """Opening less closing brackets."""
    return occurrences(text, pair[0]) - occurrences(text, pair[1])


def bracket_issues(text: Column, ext: Column) -> Column:
    """An array of ``(pair, difference, severity)`` for each pair that doesn't balance; angle brackets only where they pair."""
    pairs = [(p, F.lit(True)) for p in PAIRS] + [(("<", ">"), ext.isin(*ANGLED))]
    each = [F.when(on & (balance(text, p) != 0), F.struct(F.lit("".join(p)).alias("pair"), balance(text, p).alias("difference"), F.when(F.abs(balance(text, p)) > 1, "critical").otherwise("major").alias("severity"))) for p, on in pairs]
    return F.array_compact(F.array(*each))


def lf(text: Column) -> Column:
    """Line ends as line feeds."""
    return F.regexp_replace(text, "\r\n?", "\n")


def is_noop(search: Column, replace: Column) -> Column:
    """Both non-empty and equal but for line ends and margins."""
    a, b = F.trim(lf(search)), F.trim(lf(replace))
    return F.coalesce((F.length(search) > 0) & (F.length(replace) > 0) & (a == b), F.lit(False))


def change_kind(before: Column, after: Column) -> Column:
    """``none``, ``whitespace`` or ``change``."""
    squeezed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    return F.when(F.coalesce(before, F.lit("")) == F.coalesce(after, F.lit("")), "none").when(squeezed(before) == squeezed(after), "whitespace").otherwise("change")


def truncation_note(text: Column) -> Column:
    """Why a code text looks cut, first reason that holds, null if none does: open braces, an ending that leaves
    something out, a trailing comma, an odd number of quotes."""
    t = F.rtrim(F.coalesce(text, F.lit("")))
    last = F.element_at(F.split(t, "\n"), -1)
    ends = F.lit(False)
    for e in ENDINGS:
        ends = ends | F.endswith(F.lower(t), F.lit(e))
    odd = (occurrences(F.replace(t, F.lit('\\"'), F.lit("")), '"') % 2) == 1
    return F.when(F.length(t) < 10, F.lit(None)).when(balance(t, PAIRS[0]) > 2, "open braces").when(ends, "left out").when(F.endswith(t, F.lit(",")) & ~last.rlike(r"[\])}]"), "trailing comma").when(odd, "open string")


def marked_truncated(text: Column) -> Column:
    """Whether one of the last five lines holds a marker for left-out code, or more than three brackets of a kind are open."""
    t = F.coalesce(text, F.lit(""))
    tail = F.array_join(F.slice(F.split(t, "\n"), F.greatest(F.lit(1), F.size(F.split(t, "\n")) - 4), F.lit(5)), "\n")
    hit = F.lit(False)
    for m in MARKERS:
        hit = hit | F.contains(F.lower(tail), F.lit(m))
    for p in PAIRS:
        hit = hit | (balance(t, p) > 3)
    return hit


def issue_severity(comment: Column) -> Column:
    """The severity that an issue's text speaks of; major unless it says otherwise."""
    low = F.lower(F.coalesce(comment, F.lit("")))
    any_of = lambda ws: low.rlike("|".join(ws))
    return F.when(any_of(CRITICAL), "critical").when(any_of(MAJOR), "major").when(any_of(MINOR), "minor").otherwise("major")


def duplicate_line(text: Column, original: Column) -> Column:
    """The first line that the next repeats (without margins), unless it is trivial or the original repeats it as well."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim)
    olds = F.transform(F.split(F.coalesce(original, F.lit("")), "\n"), F.trim)
    pairs = lambda a: F.filter(F.zip_with(a, F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(1))), lambda x, y: F.when((x == y) & (F.length(x) > 3), x)), lambda z: z.isNotNull())
    return F.get(F.array_except(pairs(lines), pairs(olds)), F.lit(0))


def estimated_tokens(text: Column, content_type: Column) -> Column:
    """Tokens by the kind of content: letters count whole, white space three tenths."""
    t = F.coalesce(text, F.lit(""))
    white = F.length(t) - F.length(F.regexp_replace(t, r"[ \t\n\r\f\x0B]", ""))
    cpt = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CHARS_PER_TOKEN.items() for x in kv]), content_type), F.lit(3.5))
    return F.floor(((F.length(t) - white) + 0.3 * white) / cpt).cast("bigint")


def cut_to_tokens(text: Column, tokens: int, content_type: str, keep_end: bool = False) -> Column:
    """``text`` cut to a number of tokens, with a mark where it was cut."""
    cpt = CHARS_PER_TOKEN.get(content_type, 3.5)
    n = int(int(tokens * cpt) * 0.95)
    short = F.concat(F.lit("... [truncated]\n"), F.right(text, F.lit(n))) if keep_end else F.concat(F.left(text, F.lit(n)), F.lit("\n... [truncated]"))
    return F.when(estimated_tokens(text, F.lit(content_type)) > tokens, short).otherwise(text)


def imports(text: Column, ext: Column) -> Column:
    """Modules that a text imports, distinct and sorted: quoted ones for scripts, root packages for Python, dotted ones else."""
    t = F.coalesce(text, F.lit(""))
    js = F.concat(F.regexp_extract_all(t, F.lit(r"""(?m)^\s*(?:import|export)\b[^'"\n;]*?['"]([^'"\n]+)['"]"""), F.lit(1)), F.regexp_extract_all(t, F.lit(r"""\b(?:require|import)\s*\(\s*['"]([^'"\n]+)['"]\s*\)"""), F.lit(1)))
    py = F.transform(F.regexp_extract_all(t, F.lit(r"(?m)^[ \t]*(?:from|import)[ \t]+([\w.]+)"), F.lit(1)), lambda x: F.split(x, r"\.")[0])
    cs = F.regexp_extract_all(t, F.lit(r"(?m)^[ \t]*using[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;"), F.lit(1))
    java = F.regexp_extract_all(t, F.lit(r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;"), F.lit(1))
    found = F.when(ext.isin("ts", "js", "mjs", "tsx", "jsx"), js).when(ext == "py", py).when(ext == "cs", cs).when(ext == "java", java).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")))


def defined_types(text: Column) -> Column:
    """Names of classes, interfaces, structs, enums and types that a text defines, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(?:class|interface|struct|enum|type)[ \t]+([A-Z]\w*)"), F.lit(1))))


def is_placeholder_free_path(path: Column) -> Column:
    """Whether a path may name a new file: relative, without ``..``, not too long."""
    return F.coalesce((F.length(path) > 0) & (F.length(path) <= 260) & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)") & ~path.rlike(r"^([/\\]|[A-Za-z]:)"), F.lit(False))


# fixed values: whole import lines, by extension
IMPORT_LINES = {"ts": r"(?m)^import [^\r\n]*", "js": r"(?m)^import [^\r\n]*", "mjs": r"(?m)^import [^\r\n]*", "py": r"(?m)^(?:from|import) [^\r\n]*", "cs": r"(?m)^using [^\r\n]*", "java": r"(?m)^import [^\r\n]*"}


def import_lines(text: Column, ext: Column) -> Column:
    """The import lines of a text by its language, as they stand; none for others."""
    out = F.array().cast("array<string>")
    for e, rx in IMPORT_LINES.items():
        out = F.when(ext == e, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rx), F.lit(0))).otherwise(out)
    return out
