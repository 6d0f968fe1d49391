"""What is told about a cycle before it is worked on: its analysis, what to look up for it, and snippets of its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..tables import clean_path, extension
from . import rules
from .matching import base_name

# fixed values: what shows inheritance and interfaces in a text
INHERITANCE = r"(?i)\b(?:extends|inherits|:.*class|<.*>)\b"
INTERFACES = r"(?i)\b(?:interface|implements|IDisposable|IEnumerable)\b"
# fixed values: keywords of a cycle, by condition, in order
KEYWORDS = (
    ("always", ("cyclic dependency", "refactoring")), ("bidirectional", ("bidirectional", "mutual dependency")), ("transitive", ("transitive", "chain")), ("inheritance", ("inheritance", "subclass", "base class")),
    ("interface", ("interface", "abstraction")), ("violation", ("layer", "architecture", "separation of concerns")),
)
# fixed values: what to look up for an intent, by condition, in order; "hint:" conditions look at what is known already
LOOKUPS = {
    "understand": (
        ("always", "why cyclic dependencies are problematic software design"), ("always", "impact of circular dependencies on maintainability testability"), ("bidirectional", "bidirectional dependency coupling problems solutions"),
        ("violation", "layered architecture violations consequences"), ("violation", "acyclic dependencies principle clean architecture"), ("inheritance", "inheritance dependency problems composition over inheritance"),
    ),
    "strategize": (
        ("always", "breaking cyclic dependencies strategies techniques"), ("always", "dependency inversion principle interface extraction"), ("bidirectional", "extract interface break bidirectional dependency"),
        ("bidirectional", "dependency inversion two modules tightly coupled"), ("transitive", "break dependency chain introduce abstraction layer"), ("violation", "fix layer violation dependency inversion"),
        ("violation", "clean architecture dependency rule"), ("inheritance", "replace inheritance with composition delegation"),
    ),
    "implement": (
        ("always", "refactoring cyclic dependency step by step"), ("always", "extract interface refactoring example"), ("hint:interface", "implementing interface extraction refactoring"), ("hint:interface", "dependency inversion with interfaces example"),
        ("hint:shared|common", "extract shared module common functionality"), ("hint:event|callback", "event driven decoupling observer pattern implementation"), ("hint:mediator", "mediator pattern implementation decoupling"),
        ("bidirectional", "implement dependency inversion two classes"), ("violation", "implementing ports and adapters hexagonal architecture"),
    ),
    "validate": (("always", "validating refactoring success criteria"), ("always", "checking dependency cycle is broken"), ("always", "refactoring quality attributes maintainability"), ("always", "code review refactoring checklist")),
    "explain": (("always", "explaining refactoring benefits stakeholders"), ("always", "dependency inversion benefits explained"), ("interface", "benefits of interface extraction explained"), ("violation", "clean architecture benefits explained")),
}
# fixed values: words that show which strategy was tried
STRATEGY_WORDS = {
    "interface_extraction": ("interface", "abstraction", "iservice", "extract interface", "program to interface"), "dependency_inversion": ("inversion", "inject", "ioc", "constructor injection", "dependency injection"),
    "shared_module": ("shared", "common", "utility", "extract module", "move to common"), "mediator": ("mediator", "coordinator", "hub", "event bus", "message broker"),
    "facade": ("facade", "wrapper", "adapter", "gateway"), "lazy_loading": ("lazy", "deferred", "on demand", "late binding"),
}
#: Which hint a cycle gets, by condition.
HINTS = (("bidirectional", "extract an interface from one of the two"), ("violation", "invert the dependency of the lower layer"), ("inheritance", "compose instead of inheriting"), ("many", "move what several modules share into one without dependencies"))
GENERAL_HINT = "extract an interface, invert a dependency, or put a mediator between the modules"


def analysis(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """``(cycle_id, cycle_type, nodes, has_inheritance, has_interface, violation, pattern)`` of each job.

    The type is bidirectional for two nodes, transitive up to four, and above a star with over 1.5 edges a node. Contents
    are looked at file by file, so no texts of a cycle are joined; ``files`` has ``cycle_id, content``.
    """
    c = F.coalesce("content", F.lit(""))
    flags = files.select("cycle_id", c.rlike(INHERITANCE).alias("h"), c.rlike(INTERFACES).alias("i")).groupBy("cycle_id").agg(F.max("h").alias("h"), F.max("i").alias("i"))
    n, e = F.size("graph.nodes"), F.size("graph.edges")
    kind = F.when(n == 2, "bidirectional").when(n <= 4, "transitive").when(e > n * 1.5, "star").otherwise("transitive")
    j = jobs.select("cycle_id", kind.alias("cycle_type"), n.alias("nodes"), rules.layer_violation(F.col("graph.nodes")).alias("violation")).join(flags, "cycle_id", "left")
    no = F.lit(False)
    j = j.select("cycle_id", "cycle_type", "nodes", F.coalesce("h", no).alias("has_inheritance"), F.coalesce("i", no).alias("has_interface"), "violation")
    pattern = (
        F.when(F.col("violation").isNotNull(), "layer violation").when(F.col("has_inheritance"), "inheritance coupling").when(F.col("cycle_type") == "bidirectional", "mutual dependency")
        .when(F.col("cycle_type") == "star", "highly coupled cluster").otherwise("transitive dependency chain")
    )
    return j.withColumn("pattern", pattern)


def condition(name: str, hints: Column | None = None) -> Column:
    """A condition of the tables above over the columns of :func:`analysis`; without ``hints`` no hint holds."""
    if name.startswith("hint:"):
        return F.lit(False) if hints is None else F.coalesce(F.lower(hints).rlike(name[5:]), F.lit(False))
    return {
        "always": F.lit(True), "bidirectional": F.col("cycle_type") == "bidirectional", "transitive": F.col("cycle_type") == "transitive", "inheritance": F.col("has_inheritance"), "interface": F.col("has_interface"),
        "violation": F.col("violation").isNotNull(), "many": F.col("nodes") > 3,
    }[name]


def keywords() -> Column:
    return F.flatten(F.array(*[F.when(condition(c), F.array(*map(F.lit, ws))).otherwise(F.array().cast("array<string>")) for c, ws in KEYWORDS]))


def lookups(intent: str, hints: Column | None = None) -> Column:
    """What to look up for a cycle, in order."""
    return F.array_compact(F.array(*[F.when(condition(c, hints), F.lit(q)) for c, q in LOOKUPS[intent]]))


def hints() -> Column:
    each = F.array_compact(F.array(*[F.when(condition(c), F.lit(h)) for c, h in HINTS]))
    return F.when(F.size(each) == 0, F.array(F.lit(GENERAL_HINT))).otherwise(each)


def tried(text: Column) -> Column:
    """The strategies one of whose words a text has."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike("|".join(ws)), F.lit(s)) for s, ws in STRATEGY_WORDS.items()]))


def context_lines() -> Column:
    """The analysis as ``key: value`` lines, those without a value left out."""
    return F.concat_ws(
        "\n", F.concat(F.lit("Cycle Type: "), "cycle_type"), F.concat(F.lit("Node Count: "), F.col("nodes").cast("string")), F.concat(F.lit("Dominant Pattern: "), "pattern"), F.concat(F.lit("Layer Violation Detected: "), "violation"),
        F.when(F.col("has_inheritance"), "Inheritance Relationships: Yes"), F.when(F.col("has_interface"), "Existing Interfaces: Yes"),
    )


# fixed values: lines worth showing, by extension: pattern, lines before, end of the window behind (modifiers need no mention
# where any words may stand, and each blank belongs to one part, so that no line is tried in many ways)
LINES = {
    ("cs",): (
        (r"^\s*using\s+[A-Za-z0-9_.]+\s*;", 2, 6), (r"^\s*namespace\s+[A-Za-z0-9_.]+", 2, 6), (r"^\s*(?:(?:public|private|internal|protected|static|sealed|partial|abstract|new|protected\s+internal)\s*)?(?:class|interface|struct|enum|record)\s+\w+", 2, 6),
        (r"^[\w<>\[\],\s]+\s+\w+\s*\([^)]*\)\s*(?:\{|;|=>)", 2, 6),
    ),
    ("py",): ((r"^\s*(?:def|class)\s+\w+", 2, 10),),
    ("js", "ts", "jsx", "tsx"): ((r"^\s*(?:import|export)\s+.*from\s+['\"][^'\"]+['\"]", 1, 2), (r"require\s*\(\s*['\"][^'\"]+['\"]\s*\)", 1, 2), (r"^\s*(?:export\s+)?(?:async\s+)?(?:function|class|const|let|var)\s+\w+", 2, 10)),
    ("java", "kt"): (
        (r"^\s*import\s+[\w.]+;?", 1, 2), (r"^\s*(?:(?:public|private|protected)\s*)?(?:static\s*)?(?:final\s*)?(?:abstract\s*)?(?:class|interface|enum)\s+\w+", 2, 8),
        (r"^[\w<>\[\],\s]+\s+\w+\s*\([^)]*\)\s*(?:\{|;|throws)", 2, 8),
    ),
    (): ((r"^\s*(?:import|include|require|use)\s+", 1, 2),),
}
PY_IMPORT = r"^\s*(?:from|import)\s+([\w.]+)"
MENTION = (2, 3)


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once: a generator of one row keeps the optimizer from copying them into every
    later use (and into lambdas, where they would be computed for each element)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_snippet(df: DataFrame, path: Column, content: Column, nodes: Column, most: Column, name: str = "snippet") -> DataFrame:
    """``df`` with the part of each file to show: all of it up to ``most`` characters, else windows around imports, declarations and
    lines that name a node or the file, merged where they touch, until ``most`` is passed; without any the first lines.

    One row's own text is all it needs, so nothing is shuffled. Null and empty contents give an empty text.
    """
    tokens = F.filter(F.array_append(F.coalesce(nodes, F.array().cast("array<string>")), F.coalesce(F.regexp_replace(base_name(path), r"^(.+)\.[^.]*$", "$1"), F.lit(""))), lambda x: x != "")
    long = F.length(content) > most
    lines = F.when(long, F.split(F.regexp_replace(content, r"\r?\n\z", ""), r"\r?\n"))
    df = stage(df, _lines=lines, _tokens=tokens, _ext=F.coalesce(extension(clean_path(path)), F.lit("")), _content=content, _most=most.cast("int"))
    n, ext, known = F.size("_lines"), F.col("_ext"), [x for xs in LINES for x in xs]

    def windows(line: Column, i: Column) -> Column:
        def window(hit: Column, before: int, after: int) -> Column:
            return F.when(hit, F.struct(F.greatest(i - before, F.lit(0)).alias("s"), F.least(i + after, n).alias("e")))

        each = [window((ext.isin(*xs) if xs else ~ext.isin(*known)) & line.rlike(rx), b, a) for xs, rs in LINES.items() for rx, b, a in rs]
        target = F.regexp_extract(line, PY_IMPORT, 1)
        each.append(window((ext == "py") & (target != "") & F.exists("_tokens", lambda t: F.contains(target, t)), 2, 3))
        each.append(window(F.exists("_tokens", lambda t: F.contains(line, t)), *MENTION))
        return F.array_compact(F.array(*each))

    none = F.array().cast("array<struct<s: int, e: int>>")
    df = stage(df, _ranges=F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("_lines", windows)))), none))

    def merge(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], r["e"]).alias("e"))))
        return F.when(r["s"] <= last["e"] + 1, joined).otherwise(F.concat(done, F.array(r)))

    df = stage(df, _merged=F.aggregate("_ranges", none, lambda done, r: F.when(F.size(done) == 0, F.array(r)).otherwise(merge(done, r))))
    df = stage(df, _parts=F.transform("_merged", lambda r: F.array_join(F.slice("_lines", r["s"] + 1, r["e"] - r["s"]), "\n")))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))
    kept = F.aggregate("_parts", start, lambda a, p: F.when(a["used"] > F.col("_most"), a).otherwise(F.struct((a["used"] + F.length(p)).alias("used"), F.array_append(a["kept"], p).alias("kept"))), lambda a: F.array_join(a["kept"], "\n\n...\n\n"))
    df = stage(df, _kept=kept)
    head = F.array_join(F.slice("_lines", F.lit(1), F.greatest(F.lit(50), F.floor(F.col("_most") / 80).cast("int"))), "\n")
    mark = F.lit("\n...[truncated]")
    text = (
        F.when(F.coalesce("_content", F.lit("")) == "", "").when(F.col("_lines").isNull(), F.col("_content")).when(F.size("_ranges") == 0, F.concat(F.left(head, F.col("_most")), mark))
        .when(F.length("_kept") > F.col("_most"), F.concat(F.left("_kept", F.col("_most")), mark)).otherwise(F.col("_kept"))
    )
    return df.withColumn(name, text).drop("_lines", "_tokens", "_ext", "_content", "_most", "_ranges", "_merged", "_parts", "_kept")


def shown(files: DataFrame, nodes: DataFrame, key: str, id_col: str, room: int, *, largest: int = 8000, share: float = 0.4, most: int = 4000) -> DataFrame:
    """``(key, id, path, size, status, text)``: files whole, smallest first, within ``share`` of ``room`` and ``largest`` each;
    snippets of the others within an even share of what is left and ``most``; ``status`` is full, snippet or empty.

    ``files`` has ``key, id, path, content``, ``nodes`` the key and an array ``nodes``. Ties in size go to the smaller id.
    """
    f = files.withColumn("size", F.length(F.coalesce("content", F.lit(""))))
    fits = (F.col("size") > 0) & (F.col("size") <= largest)
    by_size = W.partitionBy(key).orderBy("size", id_col).rowsBetween(W.unboundedPreceding, 0)
    # sizes only grow, so the greedy choice is a running sum
    narrow = f.select(key, id_col, "size", fits.alias("_fits")).withColumn("_sum", F.sum(F.when(F.col("_fits"), F.col("size")).otherwise(0)).over(by_size))
    narrow = narrow.withColumn("_full", F.col("_fits") & (F.col("_sum") <= int(room * share)))
    whole = W.partitionBy(key)
    left = room - F.sum(F.when(F.col("_full"), F.col("size")).otherwise(0)).over(whole)
    rest = F.sum(F.when(F.col("_full"), 0).otherwise(1)).over(whole)
    narrow = narrow.withColumn("_room", F.least(F.floor(left / F.greatest(rest, F.lit(1))), F.lit(most)).cast("int")).select(id_col, "_full", "_room")
    j = f.join(narrow, id_col).join(nodes.select(key, "nodes"), key, "left")
    status = F.when(F.col("_full"), "full").when(F.col("size") == 0, "empty").otherwise("snippet")
    j = with_snippet(j, F.col("path"), F.when(~F.col("_full"), F.col("content")), F.col("nodes"), F.col("_room"), "_snippet")
    return j.select(key, id_col, "path", "size", status.alias("status"), F.when(F.col("_full"), F.col("content")).otherwise(F.col("_snippet")).alias("text"))
