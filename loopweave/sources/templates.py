"""Prompt templates: from a file or as they are, filled by name."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = r"\{(\w+)\}"


def load_template(path_or_text: str | None) -> str:
    """The content of a file if the text is a short path of one, else the text itself."""
    if not path_or_text:
        return ""
    if len(path_or_text) < 500 and (path_or_text.endswith((".txt", ".md", ".prompt")) or "/" in path_or_text or os.sep in path_or_text) and os.path.isfile(path_or_text):
        with open(path_or_text, encoding="utf-8") as f:
            return f.read()
    return path_or_text


def filled(template: Column, values: dict[str, Column]) -> Column:
    """``template`` with ``{name}`` replaced by the values, null as empty; other braces stay as they are."""
    for name, v in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return template


def placeholders(template: Column) -> Column:
    """The names in single braces, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(template, F.lit("")), F.lit(PLACEHOLDER), F.lit(1)))
