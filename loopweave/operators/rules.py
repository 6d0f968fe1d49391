"""Rule tables over texts: which rule of an ordered list holds first, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what a failure's messages say, by pattern, in order
FAILURES = {
    "search_not_found": ("search text not found", "no match found", "not found in file"),
    "low_confidence": ("low confidence", "marginal confidence", "fuzzy match", "confidence below"),
    "syntax_error": ("syntax error", "parse error", "unexpected token", "missing semicolon", "unclosed", "syntax"),
    "truncation": ("truncated", "incomplete", "cut off", "..."),
    "cycle_not_broken": ("cycle not broken", "cycle still exists", "dependency remains", "cycle_not_broken"),
    "compile_error": ("compile error", "compilation failed", "build error", "type error", "type_error"),
}
# fixed values: why a cycle can't be broken, by what its files say, in order (case doesn't matter); with each pattern the
# words that a text must hold for it
UNBREAKABLE = (
    ("mutual_recursion", ("parser", "lexer"), r"\bparser\b.*\blexer\b|\blexer\b.*\bparser\b"),
    ("mutual_recursion", ("visitor", "node"), r"\bvisitor\b.*\bnode\b|\bnode\b.*\bvisitor\b"),
    ("mutual_recursion", ("expr", "eval"), r"\bexpr.*\beval.*\bexpr\b"),
    ("mutual_recursion", ("serializ", "deserializ"), r"\bserializ.*\bdeserializ"),
    ("circular_data", (".parent", ".children"), r"\.parent\b.*\.children\b|\.children\b.*\.parent\b"),
    ("circular_data", (".next", ".prev"), r"\.next\b.*\.prev\b|\.prev\b.*\.next\b"),
    ("circular_data", (".owner", ".owned"), r"\.owner\b.*\.owned\b|\.owned\b.*\.owner\b"),
    ("framework", ("inotifypropertychanged",), r"\binotifypropertychanged\b"),
    ("framework", ("onpropertychanged",), r"\bonpropertychanged\b"),
    ("framework", ("viewmodelbase", "view"), r"\bviewmodelbase\b.*\bview\b"),
    ("framework", ("@component", "@autowired"), r"@component.*@autowired|@autowired.*@component"),
    ("framework", ("dbcontext", "dbset"), r"\bdbcontext\b.*\bdbset\b"),
)
REASONS = tuple(dict.fromkeys(n for n, _, _ in UNBREAKABLE))
# fixed values: what marks a node as somebody else's
EXTERNAL = ("System.", "Microsoft.", "javax.", "org.")
# fixed values: what names a layer, from the top layer down
LAYERS = {
    "ui": ("ui", "view", "controller", "presentation", "web", "api", "endpoint"),
    "business": ("service", "business", "domain", "logic", "manager", "handler"),
    "data": ("repository", "dao", "data", "database", "storage", "persistence", "entity"),
    "infrastructure": ("infrastructure", "external", "integration", "client"),
}
# fixed values: strategies by the words of a description, in order
STRATEGIES = (
    ("interface_extraction", ("interface extraction", "extract interface", "create interface", "iservice")),
    ("dependency_inversion", ("dependency inversion", "invert dependency", "inversion of control")),
    ("shared_module", ("shared module", "common module", "extract shared", "move to common")),
    ("mediator", ("mediator", "coordinator", "event bus")),
    ("interface_extraction", ("bidirectional", "mutual")),
    ("dependency_inversion", ("layer", "violation")),
)


def first_rule(text: Column, rules: dict[str, tuple[str, ...]] | tuple) -> Column:
    """The first rule one of whose phrases occurs in ``text``, whatever the case; null if none does."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(None).cast("string")
    pairs = list(rules.items()) if isinstance(rules, dict) else list(rules)
    for name, phrases in reversed(pairs):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(low, F.lit(p))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def failure_patterns(messages: Column) -> Column:
    """All patterns that an array of messages shows, in the order of the table."""
    low = F.lower(F.array_join(messages, "\n"))
    each = []
    for name, phrases in FAILURES.items():
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(low, F.lit(p))
        each.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*each))


def layer_of_name(name: Column) -> Column:
    """The highest layer one of whose words occurs in ``name``; null without one."""
    return first_rule(name, LAYERS)


def layer_violation(names: Column) -> Column:
    """``low → high`` of the outermost layers that an array of names touches; null with fewer than two."""
    order = list(LAYERS)
    rank = lambda x: F.array_position(F.array(*map(F.lit, order)), layer_of_name(x))
    ranks = F.array_distinct(F.filter(F.transform(names, rank), lambda r: r > 0))
    at = lambda r: F.element_at(F.array(*map(F.lit, order)), r.cast("int"))
    return F.when(F.size(ranks) >= 2, F.concat(at(F.array_max(ranks)), F.lit(" → "), at(F.array_min(ranks))))


def unbreakable(files: DataFrame, key: str, content: str = "content", least_chars: int = 100, id_col: str | None = None, repeated: DataFrame | None = None, external: DataFrame | None = None) -> DataFrame:
    """``(key, reason)``: why a cycle looks unbreakable; cycles without a reason are left out.

    Too little text comes first, then files most of which look cut, then the rules in order, each on single lines; then
    the keys of ``repeated`` (the same failure every time: :func:`coupled`) and those of ``external`` (nodes that are
    somebody else's: :func:`external_nodes`). A pattern is only tried on a text that holds its words, and every file is
    looked at by itself, so no group of texts is ever joined into one value. With ``id_col`` repeated rows of a file count
    once.
    """
    from ..functions.text import truncation_note

    t = F.coalesce(F.col(content), F.lit(""))
    # lower-cased once a row, before the patterns
    df = files.select(key, *([id_col] if id_col else []), F.col(content).alias("_t"), F.lower(t).alias("_low"))
    hit = {n: F.lit(False) for n in REASONS}
    for n, words, rx in UNBREAKABLE:
        all_ = F.lit(True)
        for w in words:
            all_ = all_ & F.contains("_low", F.lit(w))
        hit[n] = hit[n] | F.when(all_, F.col("_low").rlike(rx)).otherwise(F.lit(False))
    narrow = df.select(key, *([id_col] if id_col else []), F.length("_low").alias("_len"), truncation_note(F.col("_t")).isNotNull().cast("int").alias("_cut"), *[h.cast("int").alias(f"_{n}") for n, h in hit.items()])
    if id_col:
        narrow = narrow.dropDuplicates([id_col])
    g = narrow.groupBy(key).agg(F.sum("_len").alias("_len"), F.count("*").alias("_n"), F.sum("_cut").alias("_cut"), *[F.max(f"_{n}").alias(f"_{n}") for n in REASONS])
    why = F.when(F.col("_len") < least_chars, "incomplete").when(F.col("_cut") >= 0.5 * F.col("_n"), "incomplete")
    for n in REASONS:
        why = why.when(F.col(f"_{n}") == 1, n)
    for n, more in (("coupled_by_design", repeated), ("external", external)):
        if more is not None:
            g = g.join(more.select(key).distinct().withColumn(f"_{n}", F.lit(True)), key, "left")
            why = why.when(F.col(f"_{n}"), n)
    return g.select(key, why.alias("reason")).where("reason is not null")


def coupled(common: DataFrame, key: str) -> DataFrame:
    """The keys all of whose attempts share an issue that speaks of the cycle or a dependency; ``common`` is what
    :func:`history.common_issues` gives."""
    return common.where(F.lower(F.left("issue", F.lit(50))).rlike("cycle|dependency")).select(key).distinct()


def external_nodes(nodes: DataFrame, key: str, node: str = "node") -> DataFrame:
    """The keys one of whose nodes is somebody else's."""
    hit = F.lit(False)
    for p in EXTERNAL:
        hit = hit | F.contains(node, F.lit(p))
    return nodes.where(hit).select(key).distinct()
