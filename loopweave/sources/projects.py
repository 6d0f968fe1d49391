"""A project on disk: which tools there are, what it declares, and its dependency graph by a tool's output or by its imports."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import readers


def tools(names: tuple[str, ...] = ("node", "npx")) -> dict[str, bool]:
    """Which programs the driver finds."""
    return {n: shutil.which(n) is not None for n in names}


def checked_root(root: str) -> str:
    """``root`` as an absolute path; an error if it isn't a folder."""
    if not os.path.exists(root):
        raise FileNotFoundError(f"no such folder: {root}")
    if not os.path.isdir(root):
        raise NotADirectoryError(f"no folder: {root}")
    return os.path.abspath(root)


def project_info(root: str) -> dict:
    """Name, type, dependencies and path aliases that the project's package and compiler files declare; files that can't be
    read count as not declaring anything."""
    root = checked_root(root)

    def read(name: str) -> dict | None:
        try:
            with open(os.path.join(root, name), encoding="utf-8") as f:
                v = json.load(f)
            return v if isinstance(v, dict) else {}
        except FileNotFoundError:
            return None
        except (OSError, ValueError):
            return {}

    pkg, ts = read("package.json"), read("tsconfig.json")
    out = {"has_package_json": pkg is not None, "has_tsconfig": ts is not None, "name": os.path.basename(root), "type": "javascript" if ts is None else "typescript"}
    if pkg:
        out |= {"name": pkg.get("name", out["name"]), "dependencies": list(pkg.get("dependencies") or {}), "devDependencies": list(pkg.get("devDependencies") or {})}
    if ts:
        out["ts_paths"] = (ts.get("compilerOptions") or {}).get("paths") or {}
    return out


def is_external(module: Column) -> Column:
    """Whether an import leads out of the project: all but relative ones do."""
    return ~F.startswith(module, F.lit("."))


def imports(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(source_file, imported_from, resolved_path, import_type, is_external)`` of edges; an external import has no path."""
    out = is_external(F.col(dst))
    return edges.select(F.col(src).alias("source_file"), F.col(dst).alias("imported_from"), F.when(~out, F.col(dst)).alias("resolved_path"), F.lit("es6").alias("import_type"), out.alias("is_external"))


def graph(edges: DataFrame) -> DataFrame:
    """``(node)``: the distinct ends of ``(src, dst)`` edges, sorted."""
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct().orderBy("node")


def project_edges(spark: SparkSession, root: str, adjacency: str | None = None, prefer_tool: bool = True, **options) -> tuple[DataFrame, str]:
    """``(src, dst)`` edges of a project and the way they were got: ``tool`` from the adjacency file a tool wrote, if there is
    one, it can be read and it is preferred, else ``imports`` from the files' own relative imports."""
    root = checked_root(root)
    if prefer_tool and adjacency and os.path.isfile(adjacency):
        try:
            with open(adjacency, encoding="utf-8") as f:
                ok = isinstance(json.load(f), dict)
        except (OSError, ValueError):
            ok = False
        if ok:
            return readers.adjacency_json(spark, adjacency), "tool"
    return readers.resolved_imports(readers.source_tree(spark, root, **options)), "imports"


def circular_json(spark: SparkSession, path: str) -> DataFrame:
    """``(nodes)`` of a JSON file that lists cycles as lists of files."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "array<array<string>>")).alias("nodes"))
