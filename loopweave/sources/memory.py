"""What a run remembers: learning per strategy and the last attempts, and documents as an index of embedded chunks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as h
from ..operators import retrieval as r

KEPT = 50


def save_state(attempts: DataFrame, target: str, mode: str = "overwrite") -> None:
    """Learning per strategy and the last :data:`KEPT` attempts as Parquet under ``target``."""
    h.learning(attempts).write.mode(mode).parquet(f"{target}/patterns")
    h.recent(attempts, KEPT).write.mode(mode).parquet(f"{target}/recent")


def load_state(spark: SparkSession, target: str) -> tuple[DataFrame | None, DataFrame | None]:
    """What :func:`save_state` wrote; ``(None, None)`` where nothing was."""
    if not table_exists(spark, f"{target}/patterns"):
        return None, None
    return spark.read.parquet(f"{target}/patterns"), h.recent(spark.read.parquet(f"{target}/recent"), KEPT)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder or file at ``path``, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """``(source_file, page, text)`` of the documents in ``folder``: text files by form feeds, PDF files by page where a reader
    for them is installed. Files that can't be read are left out."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md,pdf}").load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows += [(os.path.basename(path), n, t) for n, t in enumerate(_pages(path, bytes(content)), 1)]
            yield pd.DataFrame(rows, columns=["source_file", "page", "text"])

    return df.select("path", "content").mapInPandas(run, "source_file string, page int, text string")


def _pages(path: str, content: bytes) -> list[str]:
    if not path.lower().endswith(".pdf"):
        return content.decode("utf-8", "replace").split("\f")
    try:
        import io

        from pypdf import PdfReader  # optional

        return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
    except Exception:  # a file that can't be read is skipped, whatever is wrong with it
        return []


def hashed(texts: pd.Series, size: int = 64) -> pd.Series:
    """Unit vectors of hashed words: no model, the same for the same text everywhere."""
    out = []
    for t in texts:
        v = np.zeros(size)
        for w in (t or "").lower().split():
            x = xxhash.xxh64_intdigest(w)
            v[x % size] += 1 if x >> 32 & 1 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return pd.Series(out)


#: Embedding functions by provider; others register theirs here.
PROVIDERS: dict[str, Callable[[pd.Series], pd.Series]] = {"hashing": hashed}


def embedding(provider: str = "hashing") -> Callable[[Column], Column]:
    """A provider's function on columns; an error for one that nobody registered."""
    if provider not in PROVIDERS:
        raise ValueError(f"no embedding provider {provider!r}; there are {sorted(PROVIDERS)}")
    f = PROVIDERS[provider]

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return f(texts)

    return embed


def index(docs: DataFrame, id_col: str, text_col: str, provider: str = "hashing", size: int = 1000, overlap: int = 200) -> DataFrame:
    """``(vec_id, id, pos, chunk, embedding)``: every chunk of the documents; ``vec_id`` is made of the id and the place."""
    c = r.chunks(docs, id_col, text_col, size, overlap)
    return c.select(F.concat_ws("#", F.col(id_col).cast("string"), F.lpad(F.col("pos").cast("string"), 6, "0")).alias("vec_id"), id_col, "pos", "chunk", embedding(provider)(F.col("chunk")).alias("embedding"))


def build_index(spark: SparkSession, folder: str, target: str, provider: str = "hashing", mode: str = "overwrite") -> int:
    """The pages of a folder as an index under ``target``; how many chunks it has."""
    p = pages(spark, folder).withColumn("id", F.concat_ws(":", "source_file", F.lpad(F.col("page").cast("string"), 5, "0")))
    index(p, "id", "text", provider).write.mode(mode).parquet(target)
    return spark.read.parquet(target).count()


def open_index(spark: SparkSession, target: str) -> DataFrame | None:
    """The index, or None where there is none (then every search gives nothing)."""
    return spark.read.parquet(target) if table_exists(spark, target) else None


def context(queries: DataFrame, found: DataFrame | None, key: str, provider: str = "hashing", *, shown: int = 3, k: int = 2, best: int = 3, chars: int = 500, source: str = "source") -> DataFrame:
    """``(key, context)``: for the first ``shown`` queries of each key the ``k`` nearest chunks, those that begin alike once, the
    ``best`` of them by score, each cut to ``chars``.

    ``queries`` has the key, ``pos`` and ``query``; equal queries are searched once. Without an index there is no row.
    """
    from pyspark.sql.window import Window as W

    spark = queries.sparkSession
    if found is None:
        return spark.createDataFrame([], f"{key} {queries.schema[key].dataType.simpleString()}, context string")
    asked = queries.where(F.col("pos") < shown)
    one = asked.select("query").distinct().select(F.col("query").alias("vec_id"), embedding(provider)(F.col("query")).alias("embedding"))
    hits = r.nearest(found.select("vec_id", "embedding"), one, k).select(F.col("query_id").alias("query"), "vec_id", "score")
    j = asked.select(key, "query").join(hits, "query").join(found.select("vec_id", F.col(source).cast("string").alias("_s"), "chunk"), "vec_id")
    head = F.left("chunk", F.lit(200))
    j = j.groupBy(key, head.alias("_h")).agg(F.max(F.struct("score", "vec_id", "_s", "chunk")).alias("x")).select(key, "x.*")
    j = j.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= best)
    part = F.concat(F.lit("["), F.coalesce("_s", F.lit("unknown")), F.lit("]\n"), F.left("chunk", F.lit(chars)))
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", part.alias("t")))).alias("p"))
    return g.select(key, F.array_join(F.transform("p", lambda x: x["t"]), "\n\n---\n\n").alias("context"))
