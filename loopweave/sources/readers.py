"""Sources: source trees, import facts, graph JSON in several layouts, project files, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

EXTENSIONS = ("ts", "tsx", "js", "jsx")
# fixed values: how a script imports
IMPORTS = (
    r"""import\s+(?:type\s+)?(?:[^'"]+\s+from\s+)?['"]([^'"]+)['"]""",
    r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)""",
    r"""import\s*\(\s*['"]([^'"]+)['"]\s*\)""",
    r"""export\s+(?:\*|\{[^}]+\})\s+from\s+['"]([^'"]+)['"]""",
)


def source_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``(path, content)`` of the files under ``root``; paths are relative, bytes that aren't UTF-8 are replaced, and a
    file is left out if its relative path holds one of ``exclude`` as a part."""
    glob = "*.{" + ",".join(extensions) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rel = F.regexp_replace(F.col("path"), r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    df = df.select(rel.alias("path"), F.decode("content", "UTF-8").alias("content"))
    parts = F.split("path", "/")
    for x in exclude:
        df = df.where(~F.array_contains(parts, x))
    return df


def normal_path(path: Column) -> Column:
    """``path`` with ``.`` and ``..`` folded away."""

    def step(acc: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), acc).when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(F.regexp_replace(path, r"\\", "/"), "/"), F.array().cast("array<string>"), step), "/")


def import_facts(files: DataFrame, key: str | None = None) -> DataFrame:
    """``(key, path, module)``: what each script imports, once."""
    keys = [key] if key else []
    all_ = F.concat(*[F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(p), F.lit(1)) for p in IMPORTS])
    return files.select(*keys, "path", F.explode(F.array_distinct(all_)).alias("module"))


def resolved_imports(files: DataFrame, key: str | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``(key, src, dst)``: relative imports that lead to a file at hand.

    A module is tried as it stands, with each extension (in place of one it has, too), and as a folder's index file;
    the first that exists wins. The tries are rows joined to the files by path, not look-ups in a list.
    """
    keys = [key] if key else []
    rel = import_facts(files, key).where(F.col("module").startswith("."))
    folder = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), "[^/]*$", "")
    base = normal_path(F.concat(folder, F.col("module")))
    bare = F.regexp_replace(base, r"(?<=[^/])\.[^./]*$", "")
    tries = [F.concat(base, F.lit(f".{e}")) for e in extensions] + [F.concat(bare, F.lit(f".{e}")) for e in extensions] + [F.concat(base, F.lit(f"/index.{e}")) for e in extensions] + [base]
    t = rel.select(*keys, F.col("path").alias("src"), "module", F.posexplode(F.array(*tries)).alias("_rank", "_p"))
    have = files.select(*keys, F.col("path").alias("dst"), normal_path(F.col("path")).alias("_p")).dropDuplicates([*keys, "_p"])
    hit = t.join(have, [*keys, "_p"]).groupBy(*keys, "src", "module").agg(F.min_by("dst", "_rank").alias("dst"))
    return hit.select(*keys, "src", "dst").distinct()


def adjacency_json(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst)`` of a JSON file that maps each file to the list of files it imports."""
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("src", "_t"))
    return m.select("src", F.explode("_t").alias("dst"))


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """One row: name, dependencies and path aliases that the project's package and compiler files declare."""
    pkg = spark.read.text(f"{root}/package.json", wholetext=True).select(F.from_json("value", "name string, dependencies map<string,string>, devDependencies map<string,string>").alias("p"))
    deps = F.concat(F.coalesce(F.map_keys("p.dependencies"), F.array().cast("array<string>")), F.coalesce(F.map_keys("p.devDependencies"), F.array().cast("array<string>")))
    return pkg.select(F.col("p.name").alias("name"), F.array_sort(F.array_distinct(deps)).alias("dependencies"))


JOB = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("nodes", T.ArrayType(T.StringType())), T.StructField("edges", T.ArrayType(T.ArrayType(T.StringType()))),
])


def graph_jobs(texts: DataFrame, text_col: str = "value", cycle_id: str | None = None) -> DataFrame:
    """``(id, nodes, edges)`` of JSON texts in any of three layouts: a bare list of jobs, an object with ``cycles``, or one job.

    A job's graph is under ``graph`` or beside its id; nodes are names or objects with ``id`` or ``name``; edges are
    arrays or objects with ``source`` and ``target``, others are skipped. With ``cycle_id`` only that job is given.
    Texts that are no JSON give no row.
    """
    v = texts.select(F.try_parse_json(text_col).alias("v")).where("v is not null")
    many = F.coalesce(F.try_variant_get("v", "$.cycles", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array(F.col("v")))
    job = v.select(F.explode(many).alias("j"))
    get = lambda path, kind: F.try_variant_get("j", path, kind)
    nodes = F.coalesce(get("$.graph.nodes", "array<variant>"), get("$.nodes", "array<variant>"))
    edges = F.coalesce(get("$.graph.edges", "array<variant>"), get("$.edges", "array<variant>"))
    name = lambda x: F.coalesce(F.try_variant_get(x, "$.id", "string"), F.try_variant_get(x, "$.name", "string"), F.try_variant_get(x, "$", "string"))
    pair = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<string>"), F.array(F.try_variant_get(x, "$.source", "string"), F.try_variant_get(x, "$.target", "string")))
    ok = lambda e: (F.size(e) >= 2) & e[0].isNotNull() & e[1].isNotNull()
    df = job.select(get("$.id", "string").alias("id"), F.transform(nodes, name).alias("nodes"), F.filter(F.transform(edges, pair), ok).alias("edges"))
    return df.where(F.col("id") == cycle_id) if cycle_id else df


def log_errors(lines: DataFrame, n: int = 10, line_col: str = "line", order: str = "pos") -> DataFrame:
    """The last ``n`` lines that speak of an error, in their order."""
    hit = lines.where(F.col(line_col).rlike("ERROR|Traceback|Exception"))
    return hit.orderBy(F.desc(order)).limit(n).orderBy(order)


CALL = r"LLM (CALL|RESPONSE) \| Agent: ([^|]+) \| Stage: ([^|]+) \| ID: (\S+)"


def newest_calls(log: DataFrame, key: str, text_col: str, n: int = 3) -> DataFrame:
    """``(key, pos, kind, agent, stage, id, block)``: the last ``n`` calls of a log, blocks that lines of five or more ``=`` separate
    and that have a call's heading."""
    b = log.select(key, F.posexplode(F.split(text_col, r"\n={5,}\n")).alias("pos", "block")).where(F.col("block").rlike(CALL))
    w = W.partitionBy(key).orderBy(F.desc("pos"))
    b = b.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return b.select(key, "pos", *[F.trim(F.regexp_extract("block", CALL, i)).alias(x) for i, x in enumerate(("kind", "agent", "stage", "id"), 1)], "block")


def tail(text: Column, n: int = 2000) -> Column:
    """The last ``n`` characters."""
    return F.right(text, F.lit(n))
