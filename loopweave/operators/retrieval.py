"""Chunking and retrieval by embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import checkpoint_dir

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
#: Queries that one pass over the vectors holds.
BLOCK = 2000


def chunk_text(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """``text`` in chunks of at most ``size``, cut at the strongest separator that gives parts small enough, successive
    chunks sharing whole parts of up to ``overlap`` characters."""
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :]
    parts: list[str] = []
    for p in list(text) if sep == "" else text.split(sep):
        if len(p) <= size:
            parts.append(p)
        else:
            parts += chunk_text(p, size, overlap, rest or ("",))
    out: list[str] = []
    held: list[str] = []
    total = 0
    for p in parts:
        extra = len(p) + (len(sep) if held else 0)
        if held and total + extra > size:
            out.append(sep.join(held))
            while held and (total > overlap or total + extra > size):
                total -= len(held[0]) + (len(sep) if len(held) > 1 else 0)
                held.pop(0)
            extra = len(p) + (len(sep) if held else 0)
        held.append(p)
        total += extra
    if held:
        out.append(sep.join(held))
    return [c for c in (x.strip() for x in out) if c]


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """``(id, pos, chunk)``; null and blank texts give none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, c) for i, t in zip(pdf["_i"], pdf["_t"], strict=True) for n, c in enumerate(chunk_text(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, "pos", "chunk"])

    return docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).where("_t is not null").mapInPandas(run, f"{id_col} {kind}, pos int, chunk string")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, id, rank, score)``: the ``k`` rows most alike to each query by inner product, itself left out.

    The queries are read in blocks; each partition of the vectors keeps its best ``k`` a query (a matrix product), and
    only those are shuffled. Ties go to the smaller id. Vectors that are null or of another length than the first
    query's are left out.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = ((r[0], r[1]) for r in queries.select(id_col, vec_col).where(F.col(vec_col).isNotNull()).dropDuplicates([id_col]).orderBy(id_col).toLocalIterator())
    schema = f"query_id {kind}, {id_col} {kind}, score double"
    w = W.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    base = vectors.select(id_col, vec_col).where(F.col(vec_col).isNotNull())

    def best(part: list) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q = np.array([v for _, v in part], np.float64)
            ids = np.array([i for i, _ in part])
            for pdf in batches:
                pdf = pdf[[len(v) == q.shape[1] for v in pdf[vec_col]]]
                if not len(pdf):
                    continue
                own = pdf[id_col].to_numpy()
                order = np.argsort(own, kind="stable")
                own, v = own[order], np.array(pdf[vec_col].tolist(), np.float64)[order]
                s = q @ v.T
                s[ids[:, None] == own[None, :]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                a, b = np.repeat(np.arange(len(ids)), top.shape[1]), top.ravel()
                keep = np.isfinite(s[a, b])
                yield pd.DataFrame({"query_id": ids[a][keep], id_col: own[b][keep], "score": s[a, b][keep]})

        return base.mapInPandas(run, schema).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    part = list(islice(rows, BLOCK))
    out = best(part) if part else vectors.sparkSession.createDataFrame([], f"{schema}, rank int")
    while len(part) == BLOCK:  # the driver holds one block; what the blocks before it found is kept in the shared folder
        checkpoint_dir(vectors.sparkSession)
        out, part = out.checkpoint(), list(islice(rows, BLOCK))
        if part:
            out = out.unionByName(best(part))
    return out


def diverse(candidates: DataFrame, vectors: DataFrame, k: int = 4, weight: float = 0.5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, id, rank)``: ``k`` of each query's candidates by maximal marginal relevance.

    The next row is the one with the largest ``weight * score - (1 - weight) * likeness to those taken``. A query has as
    many candidates as its search gave, so a group is small.
    """
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank"], kind="stable").reset_index(drop=True)
        v = np.array(pdf[vec_col].tolist(), np.float64)
        like, score = v @ v.T, pdf["score"].to_numpy()
        taken: list[int] = []
        while len(taken) < min(k, len(pdf)):
            left = [i for i in range(len(pdf)) if i not in taken]
            taken.append(max(left, key=lambda i: (weight * score[i] - (1 - weight) * (max(like[i, j] for j in taken) if taken else 0.0), -i)))
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], id_col: pdf[id_col].iloc[taken].to_numpy(), "rank": range(1, len(taken) + 1)})

    j = candidates.join(vectors.select(id_col, vec_col), id_col)
    return j.groupBy("query_id").applyInPandas(run, f"query_id {kind}, {id_col} {kind}, rank int")


def unlike_heads(hits: DataFrame, text_col: str, order: list[str], chars: int = 200) -> DataFrame:
    """``hits`` without those that begin like one before them (first ``chars`` characters).

    The first row of each beginning is a minimum, so equal beginnings are combined before they are shuffled.
    """
    first = F.min(F.struct(*order, *[c for c in hits.columns if c not in order])).alias("_first")
    return hits.groupBy(F.left(text_col, F.lit(chars)).alias("_head")).agg(first).select(*[F.col(f"_first.{c}").alias(c) for c in hits.columns])
