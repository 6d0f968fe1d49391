"""Problem 4: files that nobody on the project wrote by hand.

Paths, the comment that opens a file, and its composition tell generated, minified and vendored files and data kept as
code. A third party's copy whose marks were taken off or that was edited is found by exact containment over inverted
indexes of line hashes:

* the lines of the files known as third-party are joined to the lines of all other files; a file of whose own lines a large
  part comes from one of those files, or from the lines that one library alone has, is a copy;
* the rarest lines of the files that nothing marks are looked up among all others. A text of whose lines a large part
  stands in one other text was copied, and where the copies lie in :data:`LEAST_PROJECTS` projects, none of them wrote it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..tables import clean_path

#: A file is a copy if this share of its lines, and as many at least, are rare lines of one library.
CONTAINED, LEAST_LINES = 0.6, 8
#: Projects that must hold a text nobody marks before it counts as a third party's.
LEAST_PROJECTS = 3
#: Lines that more than one text in RARE has, and more than RARE_TEXTS, are met by a broadcast.
RARE, RARE_TEXTS = 200, 50
#: Lines among a text's rarest that another must have before the two are compared; LEAST_LINES at most.
MEET = 2
#: Lines looked up a text, from which on pairs that change nothing are left out first (for so many texts at least), and
#: the orders in which a line's texts are ranked for that.
LOOKUPS, LOOKUP_TEXTS, ORDERS = 200, 25_000, 4
#: Lines shorter than this (without margins) say nothing.
LINE_CHARS = 20

# fixed values: names of folders and files, and what opens files, by convention
PATH_GENERATED = re.compile(
    r"\.generated\.\w+$|\.g(?:\.i)?\.(?:cs|dart)$|\.designer\.(?:cs|vb)$|assemblyinfo\.(?:cs|vb)$|_pb2(?:_grpc)?\.pyi?$|_(?:autogen|generated)\.\w+$|\.pb\.\w+$"
    r"|(?:^|/)(?:_*generated_*|generated-sources|autogen)/|^(?:obj|dist|target)/|(?:^|[-./])(?:lock|shrinkwrap)\.(?:json|ya?ml)$",
    re.I,
)
PATH_MINIFIED = re.compile(r"[.-]min\.(?:js|mjs|css)$|\.(?:bundle|chunk|pack)\.(?:js|mjs)$|\.[0-9a-f]{8,}\.(?:js|mjs|css)$", re.I)
PATH_VENDORED = re.compile(r"(?:^|/)(?:node_modules|vendor|third[_-]?party|pods|deps|externals?|bower_components|jspm_packages|site-packages)/((?:@[^/]+/)?[^/]+)", re.I)
HEAD_GENERATED = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated\b|\b(?:this (?:file|code|source|class)|code|file|source)\b[^.\n]{0,40}\b(?:generated|created|produced|written)\b[^.\n]{0,30}\b(?:automatically|by|from)\b[^.\n]*"
    r"(?:\bdo not\b|\bdon'?t\b|\blost\b|\boverwritten\b|v?\d|gen\b|tool|compiler)|^\W*(?:automatically )?(?:generated|created|produced) (?:automatically )?(?:by|from|with|using|on)\b|\bmachine[- ](?:written|generated|made)\b"
    r"|\boutput of \S+ v?\d|\bchanges (?:belong in|will be (?:lost|overwritten))|\bregenerate (?:with|using|by)\b|\bedit the (?:template|source|schema|generator)[^.\n]* instead\b|\bdo not (?:edit|modify|change)(?: (?:this file|by hand|manually|it|directly))?\s*(?:[.!*/#-]|$)"
    r"|\bcreated automatically by\b|\bautomatisch (?:erzeugt|erstellt|generiert)\b|\bnicht von hand (?:bearbeiten|ändern)\b|\bfichier (?:produit|généré) par\b|\bne pas (?:modifier|éditer)\b|\bgenerado (?:por|automáticamente)\b|\bno (?:editar|modificar)\b"
    r"|\bсоздано автоматически\b|\bне редактировать\b|自动生成|請勿編輯|请勿(?:编辑|修改)|自動生成|編集しないで",
    re.I | re.M,
)
HEAD_VENDORED = re.compile(
    r"\bthird[- ]party: *([\w@./-]+)|\bvendored (?:dependency|copy of|from|package) *:? *([\w@./-]+?)(?:@|\s|$)|([\w@./-]+) v?\d[\d.]* [^\n]*\b(?:bundled copy|copied from the|imported unchanged|release archive|released under the)\b"
    r"|\b(?:copied|imported|taken) (?:unchanged )?from (?:the )?(?:upstream(?: of)? )?([\w@./-]+)(?: release archive| upstream)",
    re.I,
)
LOCK = re.compile(r'"(?:lockfileVersion|lockVersion)"\s*:')

_COMMENT = re.compile(r"//|#|/\*|\*|--|<!--|'''|\"\"\"|%|;")
_STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`")
_IDENT = re.compile(r"(?<!\w)[^\W\d]\w*")
_NUMBER = re.compile(r"(?<![\w.])-?(?:0[xX][\dA-Fa-f]+|\d[\d_.]*)")
_NUMBERED = re.compile(r"[^\W\d][^\W\d]*_?\d{3}\b")
#: What each numbered name ends with, so that a text with few of these has few numbered lines.
_THREE = re.compile(r"\d{3}\b")
_SLASHES = re.compile(rf"(/\*.*?\*/|//[^\n]*)|{_STRING.pattern}", re.S)
_HASHES = re.compile(rf"(#[^\n]*)|{_STRING.pattern}")


def head(text: str) -> str:
    """The comment lines that open ``text``, all of them."""
    out: list[str] = []
    inside = False
    at = len(text) - len(text.lstrip("\ufeff"))
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        s = text[at:end].strip()
        if inside or not s or _COMMENT.match(s):
            out.append(s)
            if s.startswith("/*"):
                inside = True
            if "*/" in s:
                inside = False
        else:
            break
        at = end + 1
    return "\n".join(out)


def library_name(name: str) -> str:
    """One name for a library, whatever scope, case or ending it is written with."""
    return re.sub(r"(?:[.-]min)?\.(?:m?js|py|cs|java|ts)$", "", name.lower().rstrip("/").rsplit("/", 1)[-1]).strip("@.")


def composition(ext: str, text: str) -> str:
    """``minified``, ``data`` or ``generated`` by what ``text`` consists of, else empty."""
    if not text.strip():
        return ""
    lines = text.split("\n")
    if ext == "json":
        if LOCK.search(text):
            return "generated"
        numbers, words = len(_NUMBER.findall(_STRING.sub(" ", text))), len(_STRING.findall(text))
        return "data" if numbers >= 60 and numbers > 3 * words else ""
    longest = max(map(len, lines))
    full = [x for x in lines if x.strip()]
    body = [x for x in full if not _COMMENT.match(x.strip())]
    if ext in ("js", "mjs", "ts", "css") and longest > 300 and body:
        code = "".join(body)
        blanks = sum(map(code.count, " \t")) / len(code)
        if blanks < 0.12 and len(code) / len(body) > 120 and code.count(";") + code.count("{") + code.count("(") > len(code) / 60:
            return "minified"
    bare = (_HASHES if ext == "py" else _SLASHES).sub(lambda m: " " if m[1] else " 's' ", text)
    inside = len(text) - len(bare)
    strings = bare.count(" 's' ")
    idents, numbers = len(_IDENT.findall(bare)) - strings, len(_NUMBER.findall(bare))
    values = numbers + strings
    if values >= 40 and values > 1.5 * idents:
        return "data"
    if strings and idents <= 12 and inside > 500 and inside > 0.75 * len(text):  # one long literal
        return "data"
    if len(full) >= 12 and len(_THREE.findall(text)) >= 0.5 * len(full):
        numbered = sum(1 for x in full if _NUMBERED.search(x))
        if numbered >= 0.5 * len(full):
            return "generated"
    return ""


def judge(path: str | None, text: str | None) -> tuple[str, str, str]:
    """``(kind, by, library)``; an empty kind means nothing speaks against the file being written by hand."""
    path = path or ""
    m = PATH_VENDORED.search(path)
    if m:
        return "vendored", "path", library_name(m[1])
    if PATH_GENERATED.search(path):
        return "generated", "path", ""
    if PATH_MINIFIED.search(path):
        return "minified", "path", ""
    if not text:
        return "", "", ""
    top = head(text)
    if top:
        m = HEAD_VENDORED.search(top)
        if m:
            return "vendored", "head", library_name(next(x for x in [*m.groups(), ""] if x is not None))
        if HEAD_GENERATED.search(top):
            return "generated", "head", ""
    kind = composition(path.rsplit(".", 1)[-1].lower(), text)
    return kind, "composition" if kind else "", ""


def not_handwritten(files: DataFrame, *, id_col: str = "file_id", path_col: str = "path", content_col: str = "content", project_col: str = "project") -> DataFrame:
    """``(id, kind, evidence, library)``: each file that wasn't written by hand on the project, once.

    ``kind`` is generated, minified, vendored or data. A null path tells nothing, null or empty content only what the
    path tells; files without a project belong to none. Re-delivered rows count once. Other columns are ignored. Texts are
    read whole.
    """
    checkpoint_dir(files.sparkSession)
    df = files.select(F.col(id_col).alias("_id"), clean_path(F.col(path_col)).alias("_path"), F.col(content_col).alias("_text"), F.col(project_col).cast("string").alias("_project")).where("_id is not null")
    id_type = df.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, p, t, project in zip(pdf["_id"], pdf["_path"], pdf["_text"], pdf["_project"], strict=True):
                kind, by, library = judge(p, t)
                lines: list[int] = []
                if t and (kind == "vendored" and library or not kind):
                    stripped = {x for x in map(str.strip, t.split("\n")) if len(x) >= LINE_CHARS}
                    lines = sorted(xxhash.xxh64_intdigest(x) - (1 << 63) for x in stripped)
                rows.append((i, kind, by, library, project, xxhash.xxh64_intdigest(repr(lines)) - (1 << 63), lines))
            yield pd.DataFrame(rows, columns=["_id", "kind", "evidence", "library", "_project", "_text", "_lines"])

    # read by the branches below, so computed once and kept where a lost executor doesn't matter
    seen = df.mapInPandas(run, f"_id {id_type}, kind string, evidence string, library string, _project string, _text bigint, _lines array<bigint>").checkpoint()
    copied = copies(seen.where("kind = 'vendored'"), seen.where((F.col("kind") == "") & (F.size("_lines") >= LEAST_LINES)))
    copied = copied.select("_id", F.lit("vendored").alias("kind"), F.when(F.col("library") == "", F.lit("projects")).otherwise(F.lit("containment")).alias("evidence"), "library")
    found = seen.where("kind <> ''").select("_id", "kind", "evidence", "library").unionByName(copied)
    return found.groupBy("_id").agg(F.min(F.struct("kind", "evidence", "library")).alias("_f")).select(F.col("_id").alias(id_col), "_f.*")


def copies(vendored: DataFrame, rest: DataFrame) -> DataFrame:
    """``(_id, library)`` of the files of ``rest`` that are copies of a library, or with an empty library of a text that
    :data:`LEAST_PROJECTS` projects hold.

    Equal line sets are one text, however many files have it. A text of ``rest`` is held against the lines that one
    library alone has, and against each other text and each library's text that could hold enough of its lines, however
    many have them: see :func:`_compared`. Where many texts share many lines, pairs that change nothing are left out.
    """
    texts = rest.groupBy("_text").agg(F.first("_lines").alias("_lines"))
    parts = vendored.where("library <> ''").select(F.col("_text").alias("_source"), "library", "_lines").dropDuplicates(["_source", "library"])
    lines = texts.select(F.lit(None).cast("string").alias("library"), "_lines").unionByName(parts.select("library", "_lines")).select("library", F.explode("_lines").alias("_h"))
    lines = lines.groupBy("_h").agg(F.count("*").cast("int").alias("_df"), F.min("library").alias("library"), F.max("library").alias("_other")).where("_df > 1")
    # read three times below
    lines = lines.select("_h", "_df", F.when(F.col("library") == F.col("_other"), F.col("library")).alias("library")).checkpoint()
    # a text in RARE has them: RARE times a text's lines at most, so they are met without shuffling by them
    n_texts = texts.count()
    most = max(RARE_TEXTS, (n_texts + vendored.count()) // RARE)
    frequent = F.broadcast(lines.where(F.col("_df") > most))
    least = F.greatest(F.lit(LEAST_LINES), F.ceil(CONTAINED * F.size("_lines"))).cast("int").alias("_least")
    postings = texts.select("_text", least, F.explode("_lines").alias("_h"))
    met = postings.join(frequent.select("_h"), "_h", "left_anti").join(lines.where(F.col("_df") <= most), "_h").unionByName(postings.join(frequent, "_h"))
    shared = met.groupBy("_text", "_least").agg(F.sort_array(F.collect_list(F.struct("_df", "_h"))).alias("_s"), F.collect_list("library").alias("_own"))
    # read by the steps below; the lines that others have, the rarest first
    shared = shared.select("_text", "_least", F.col("_s._h").alias("_lines"), F.col("_s._df").alias("_dfs"), "_own").checkpoint()
    asked = shared.where(F.size("_lines") >= F.col("_least"))
    sources = shared.select(F.col("_text").alias("_source"), F.lit("").alias("library"), "_lines").unionByName(parts)
    of_library = asked.where(F.size("_own") >= F.col("_least")).select("_text", "_least", F.explode("_own").alias("library")).groupBy("_text", "_least", "library").agg(F.count("*").alias("_in")).where(F.col("_in") >= F.col("_least"))
    places = rest.where("_project is not null").select("_text", "_project").distinct()
    looked_up = F.aggregate(_rarest("_dfs"), F.lit(0).cast("bigint"), lambda n, df: n + df)
    if (asked.agg(F.sum(looked_up)).first()[0] or 0) <= LOOKUPS * max(LOOKUP_TEXTS, n_texts):
        pairs = _compared(asked, sources)
    else:
        pairs = _compared_where_open(asked, sources, places, of_library)
    # read by both kinds of copies; narrow
    pairs = pairs.checkpoint()
    known = of_library.select("_text", "library").unionByName(pairs.where("library <> ''").select("_text", "library")).groupBy("_text").agg(F.min("library").alias("library"))
    spread = _spread(pairs.where("library = ''"), places).withColumn("library", F.lit(""))
    return rest.select("_id", "_text").distinct().join(known.unionByName(spread.join(known, "_text", "left_anti")), "_text").select("_id", "library")


def _rarest(col: str = "_lines") -> Column:
    """Of the lines that a text shares, all but its least number less :data:`MEET`, the rarest first."""
    return F.slice(col, F.lit(1), F.size(col) - F.col("_least") + MEET)


def _compared(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """``(_text, _source, library)``: each text of ``asked`` and each other of ``sources`` that has its least number of lines.

    Who has that number has :data:`MEET` of the rarest lines looked up; only pairs that do are compared, over all lines.
    """
    probes = asked.select("_text", F.explode(_rarest()).alias("_h"))
    pairs = probes.join(sources.select("_source", "library", F.explode("_lines").alias("_h")), "_h").where((F.col("library") != "") | (F.col("_text") != F.col("_source")))
    pairs = pairs.groupBy("_text", "_source", "library").agg(F.count("*").alias("_in")).where(F.col("_in") >= MEET).select("_text", "_source", "library")
    pairs = pairs.join(asked.select("_text", "_least", F.col("_lines").alias("_asked")), "_text").join(sources, ["_source", "library"])
    return pairs.where(F.size(F.array_intersect("_asked", "_lines")) >= F.col("_least")).select("_text", "_source", "library")


def _compared_where_open(asked: DataFrame, sources: DataFrame, places: DataFrame, of_library: DataFrame) -> DataFrame:
    """Pairs of :func:`_compared`, all of those that :func:`copies` could find a copy by that the others don't show.

    Each line leads to the first of its texts in :data:`ORDERS` orders, which finds the copies of a text that many edited.
    What is still open is compared in full: the texts not found yet with all, and all with these and with those that hold
    them. Texts whose looked-up lines lie in too few projects are held by too few.
    """
    by_library = _compared(asked, sources.where("library <> ''")).checkpoint()
    sources = sources.where("library = ''")
    held = sources.select("_source", F.explode("_lines").alias("_h"))
    ranked = [F.min(F.struct(F.xxhash64("_source", F.lit(i)).alias("_o"), "_source"))["_source"] for i in range(ORDERS)]
    firsts = held.groupBy("_h").agg(F.array_distinct(F.array(*ranked)).alias("_s")).select("_h", F.explode("_s").alias("_source"))
    near = asked.select("_text", "_least", F.explode("_lines").alias("_h")).join(firsts, "_h").where("_text <> _source").groupBy("_text", "_least", "_source").agg(F.count("*").alias("_in")).where(F.col("_in") >= F.col("_least"))
    near = near.select("_text", "_source", F.lit("").alias("library")).checkpoint()
    found = _spread(near, places).unionByName(by_library.select("_text")).unionByName(of_library.select("_text")).distinct().checkpoint()

    lines = asked.select("_text", F.explode(_rarest()).alias("_h")).join(places, "_text").select("_h", "_project").distinct()
    lines = lines.groupBy("_h").agg(F.count("*").alias("_n"), F.array_distinct(F.array(F.min("_project"), F.max("_project"))).alias("_ends"))
    reached = held.join(lines, "_h").select("_source", "_n", F.explode("_ends").alias("_project")).unionByName(places.select(F.col("_text").alias("_source"), F.lit(1).cast("bigint").alias("_n"), "_project"))
    reached = reached.groupBy("_source").agg(F.max("_n").alias("_n"), F.collect_set("_project").alias("_p")).where((F.col("_n") > 2) | (F.size("_p") >= LEAST_PROJECTS)).select("_source")
    sources = sources.join(reached, "_source", "left_semi")

    open_pairs = _compared(asked.join(found, "_text", "left_anti"), sources).checkpoint()
    open_sources = sources.select("_source").join(found.withColumnRenamed("_text", "_source"), "_source", "left_anti").unionByName(open_pairs.select("_source")).distinct()
    others = _compared(asked.join(found, "_text", "left_semi"), sources.join(open_sources, "_source", "left_semi"))
    return by_library.unionByName(near).unionByName(open_pairs).unionByName(others).distinct()


def _spread(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """The texts that are, or by ``pairs`` lie in, a text that :data:`LEAST_PROJECTS` projects hold."""
    # a text that no other shares a line with may still lie in several projects, and one without a project in those of others
    itself = places.select("_text").unionByName(pairs.select(F.col("_source").alias("_text")))
    inside = pairs.select("_text", "_source").unionByName(itself.select("_text", F.col("_text").alias("_source"))).distinct()
    many = inside.join(places, "_text").select("_source", "_project").distinct().groupBy("_source").agg(F.count("*").alias("_projects")).where(F.col("_projects") >= LEAST_PROJECTS)
    return inside.join(many, "_source").select("_text").distinct()
