"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of folder ``sf_dir``; with ``columns`` only these are read from the file."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per ``key``: re-delivered rows hold the same values, so any of them will do."""
    return df.dropDuplicates([key])


def project(df: DataFrame, key: str, *columns: str | Column) -> DataFrame:
    """``columns`` of ``df``, then one row per ``key``: what is shuffled to drop re-delivered rows are the narrow results,
    not the texts that they are computed from. Without columns all of them are kept."""
    return once(df.select(*columns) if columns else df, key)


def clean_path(path: Column) -> Column:
    """``path`` with ``/`` as separator and without a leading ``./``."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")


def extension(path: Column) -> Column:
    """What follows the last dot of ``path``, in lower case; empty where there is no dot, null for a null path."""
    return F.when(path.contains("."), F.lower(F.substring_index(path, ".", -1))).when(path.isNotNull(), F.lit(""))
