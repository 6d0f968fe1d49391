"""Checks of single files by language: a table of checkers, each a function of one text."""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LANGUAGES
from ..tables import clean_path, extension

#: What a checker gives: the errors it found, or None where its tool isn't there.
Checker = Callable[[str], list[str] | None]


def _python(text: str) -> list[str]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text.removeprefix("﻿"))
    except SyntaxError as e:
        return [f"line {e.lineno}: {e.msg}"]
    except (ValueError, RecursionError, MemoryError) as e:
        return [str(e) or type(e).__name__]
    return []


def _json(text: str) -> list[str]:
    try:
        json.loads(text.removeprefix("﻿"))
    except json.JSONDecodeError as e:
        return [f"line {e.lineno}: {e.msg}"]
    except RecursionError:
        return ["nested too deep"]
    return []


#: Checkers by language; a deployment registers those of its compilers here. A language without one has no tool.
CHECKERS: dict[str, Checker] = {"python": _python, "json": _json}
RESULT = "success boolean, tool string, tool_available boolean, errors array<string>"


def check(language: str | None, text: str | None) -> tuple[bool, str, bool, list[str]]:
    """``(success, tool, tool_available, errors)``; what no tool can tell counts as a success."""
    if language is None:
        return True, "none", True, []
    errors = CHECKERS[language](text or "") if language in CHECKERS else None
    return (True, language, False, []) if errors is None else (not errors, language, True, errors)


def checked(files: DataFrame, id_col: str, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``(id, language, …)`` with the columns of :data:`RESULT`: each file checked by its language."""
    kind = files.schema[id_col].dataType.simpleString()
    m = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    df = files.select(id_col, F.try_element_at(m, F.coalesce(extension(clean_path(F.col(path_col))), F.lit(""))).alias("language"), F.col(content_col).alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, lang, *check(lang, t)) for i, lang, t in zip(pdf[id_col], pdf["language"], pdf["_t"], strict=True)]
            yield pd.DataFrame(rows, columns=[id_col, "language", "success", "tool", "tool_available", "errors"])

    return df.mapInPandas(run, f"{id_col} {kind}, language string, {RESULT}")


def summary(success: Column, errors: Column, warnings_: Column | None = None) -> Column:
    """A result as a line: how many errors and warnings."""
    n = F.size(errors)
    w = F.lit(0) if warnings_ is None else F.size(warnings_)
    return F.when(success & (w == 0), "ok").when(success, F.concat(F.lit("ok, "), w.cast("string"), F.lit(" warning(s)"))).otherwise(F.concat(n.cast("string"), F.lit(" error(s), "), w.cast("string"), F.lit(" warning(s)")))
