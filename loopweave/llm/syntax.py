"""Problem 3: source texts that are not valid in the language of their extension.

Every text is parsed by a packrat parsing-expression grammar of its language (``grammars``, ``peg``) that has to consume
all of it. For a text that it doesn't accept the furthest failure position and the likely cause can be told, and the
verdicts are added up to rates per project and extension. Python and JSON texts that the grammar rejects are confirmed
by the exact parsers of the standard library before they count.
"""

from __future__ import annotations

import ast
import json
import re
import sys
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import clean_path, extension
from .grammars import BAD, PythonLanguage, language

#: Frames that the parser may take for a character, at most: the rules between two of them.
FRAMES = 200

_CONFLICT = re.compile(r"^(?:<{7} |>{7} |={7}\r?$|\|{7} )", re.M)
_FENCE = re.compile(r"\A\s*(?:```|~~~)|^(?:```|~~~)\s*\Z", re.M)


def _exactly(ext: str, text: str) -> bool:
    """Whether the exact parser accepts ``text``."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            if ext == "py":
                ast.parse(text.removeprefix("﻿"))
            else:
                json.loads(text.removeprefix("﻿"), parse_constant=lambda c: 1 / 0)
    except (SyntaxError, ValueError, ZeroDivisionError, RecursionError, MemoryError):
        return False
    return True


def valid(ext: str, text: str | None) -> bool:
    """Whether ``text`` parses in the language of ``ext``; null and empty texts and unknown languages are no fault."""
    if not text:
        return True
    lang = language(ext)
    if lang is None:
        return True
    limit = sys.getrecursionlimit()
    try:
        for depth in (20_000, 1000 + FRAMES * len(text)):
            sys.setrecursionlimit(max(limit, depth))
            try:
                if lang.valid(text):
                    return True
                break
            except RecursionError:  # frames lie on the heap, so the limit may grow with the text
                continue
    finally:
        sys.setrecursionlimit(limit)
    return ext in ("py", "json") and _exactly(ext, text)


def fault(ext: str, text: str) -> tuple[int, str]:
    """The furthest failure position (a code point offset) and the cause, for a text that doesn't parse."""
    lang = language(ext)
    g = lang.grammar
    kinds, at = [], []
    for m in lang.token.finditer(text):
        for c in lang.kinds[m.group(1)]:
            kinds.append(c)
            at.append(m.start(1))
    s = "".join(kinds)
    if isinstance(lang, PythonLanguage):
        if not s.startswith("\n"):
            lead = lang.logical(text)[: len(lang.logical(text)) - len(s)]
            s, at = lead + s, [0] * len(lead) + at
    else:
        kept = lang.tidy(s)
        if kept != s:  # the same characters without some line ends
            where, k = [], 0
            for c in kept:
                while s[k] != c:
                    k += 1
                where.append(at[k])
                k += 1
            s, at = kept, where
    rest, wrong = g.stack(s, at)
    if wrong:
        b, content = wrong[0]
        flat = "".join(c for c, _ in content)
        far = max(g.parse(r, flat) for r in g.readings[b].values())
        place = content[far][1] if far < len(content) else content[-1][1] if content else 0
    else:
        flat = "".join(c for c, _ in rest)
        if isinstance(lang, PythonLanguage):
            no, lines = lang.fault(flat), flat.split("\n")
            k = sum(len(x) + 1 for x in lines[: (no or 0) + 1])
            body = lines[(no or 0) + 1][1:] if (no or 0) + 1 < len(lines) else ""
            k += 1 + max(0, g.parse("Line", body))
        else:
            k = g.parse(lang.start, flat)
        place = rest[k][1] if k < len(rest) else len(text)
    cause = "unexpected token"
    opened = [c for c, _ in rest if c in "([{"]
    closed = [c for c, _ in rest if c in ")]}"]
    others = [x for x in ("ts", "py", "cs", "java", "json") if x != ext and not (ext in ("js", "mjs") and x == "ts")]
    if _CONFLICT.search(text):
        cause = "conflict markers"
    elif _FENCE.search(text):
        cause = "code fence"
    elif opened and not closed and not text.endswith("\n"):
        cause = "cut off"
    elif ext in ("js", "mjs") and valid("ts", text) or any(valid(x, text) for x in others):
        cause = "other language"
    elif opened or closed:
        cause = "unbalanced brackets"
    elif BAD in s:
        cause = "unfinished literal or stray character"
    return place, cause


def _texts(df: DataFrame, table: str, id_col: str, path_col: str, text_col: str, *more: Column) -> DataFrame:
    return df.select(F.lit(table).alias("source_table"), F.col(id_col).cast("bigint").alias("row_id"), extension(clean_path(F.col(path_col))).alias("ext"), F.col(text_col).alias("text"), *more)


def sources(files: DataFrame, patches: DataFrame) -> DataFrame:
    """``(source_table, row_id, ext, text, project)`` of the files' contents and the patched texts."""
    project = F.col("project")
    return _texts(files, "cycle_files", "file_id", "path", "content", project).unionByName(_texts(patches, "patch_results", "patch_id", "path", "patched", project))


def unparsed(texts: DataFrame) -> DataFrame:
    """Rows ``(source_table, row_id)`` of the texts that don't parse, each once.

    ``texts`` has ``source_table, row_id, ext, text``. Null or empty texts, null extensions and extensions without a
    grammar are no fault. Each text is read whole. Other columns are ignored.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bad = [not valid(e, t) for e, t in zip(pdf["ext"], pdf["text"], strict=True)]
            yield pdf.loc[bad, ["source_table", "row_id"]]

    df = texts.select("source_table", "row_id", "ext", "text").where("text <> '' and ext is not null")
    return df.mapInPandas(check, "source_table string, row_id bigint").distinct()


def verdicts(texts: DataFrame) -> DataFrame:
    """``(source_table, row_id, project, ext, position, line, cause)`` of every text, each once: parsed in one pass.

    ``position`` and what follows are null where the text parses. :func:`faults` and :func:`rates` are read off it.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for e, t in zip(pdf["ext"], pdf["text"], strict=True):
                if valid(e, t):
                    rows.append((None, None, None))
                else:
                    place, cause = fault(e, t)
                    rows.append((place, t.count("\n", 0, place) + 1, cause))
            more = pd.DataFrame(rows, columns=["position", "line", "cause"], index=pdf.index, dtype="object")
            yield pdf[["source_table", "row_id", "project", "ext"]].join(more)

    df = texts.select("source_table", "row_id", "project", "ext", "text").where("text <> '' and ext is not null")
    return df.mapInPandas(check, "source_table string, row_id bigint, project string, ext string, position bigint, line bigint, cause string").dropDuplicates(["source_table", "row_id"])


def faults(judged: DataFrame) -> DataFrame:
    """``(source_table, row_id, ext, position, line, cause)`` of the texts that :func:`verdicts` says don't parse."""
    return judged.where("cause is not null").drop("project")


def rates(judged: DataFrame) -> DataFrame:
    """``(project, ext, texts, unparsed, rate)``: how many of the distinct texts of a project and extension don't parse.

    Rows without a project form a group of their own; null and empty texts don't count.
    """
    bad = F.count("cause")
    return judged.groupBy("project", "ext").agg(F.count("*").alias("texts"), bad.alias("unparsed"), (bad / F.count("*")).alias("rate"))
