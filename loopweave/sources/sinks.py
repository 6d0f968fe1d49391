"""Sinks: artifacts by cycle, with safe names and a log of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_path(path: Column) -> Column:
    """``path`` as a relative one that can't leave its folder: no drive, no leading ``/``, no ``.`` or ``..``."""
    p = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), "^[A-Za-z]:", "")
    return F.array_join(F.filter(F.split(p, "/"), lambda x: ~x.isin("", ".", "..")), "/")


def write_log(artifacts: DataFrame, key: str, path: str, text: str, kind: str = "text") -> DataFrame:
    """What writing ``artifacts`` would take: ``(key, path, type, size)``; the same in a dry run."""
    return artifacts.select(key, safe_path(F.col(path)).alias("path"), F.lit(kind).alias("type"), F.coalesce(F.length(text), F.lit(0)).alias("size"))


def write(artifacts: DataFrame, target: str, key: str, dry_run: bool = False, mode: str = "append") -> int:
    """``artifacts`` as Parquet under ``target``, one folder for each key; rows written, 0 in a dry run."""
    if dry_run:
        return 0
    artifacts.write.mode(mode).partitionBy(key).parquet(target)
    return artifacts.count()


def as_json(df: DataFrame, key: str) -> DataFrame:
    """``(key, json)``: each row as one JSON object."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("json"))


#: What is kept of a run, by kind: its folder and the column that holds the text.
NAMED = {"input": "cycle.json", "description": "description.txt", "response": "response.txt"}


def named(rows: DataFrame, kind: str, key: str, text: str, agent: str | None = None) -> DataFrame:
    """``(key, path, text)``: texts of one kind as artifacts, under the agent's folder if there is one."""
    if kind not in NAMED:
        raise ValueError(f"no artifact {kind!r}; there are {sorted(NAMED)}")
    return rows.select(key, F.lit(f"{agent}/{NAMED[kind]}" if agent else NAMED[kind]).alias("path"), F.col(text).alias("text"))
