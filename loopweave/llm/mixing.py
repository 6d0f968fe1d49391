"""Problem 7: mixing sources to target weights.

Every document of a source gets the same expected number of copies, the source's target size over the size it has, but
at most the cap. Its whole part is given to all; the fractional rest is rounded by pivotal dependent rounding: two
documents with a fractional copy each trade mass, in tokens, at random until one of them is integral, so that the
source's total stays exact and each document keeps its expectation. Buckets of documents are rounded by themselves and
leave at most one fractional document each; these residuals are combined in a reduction tree, bucket numbers losing
their last digits level by level, until a single one is left to a coin.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# fixed value: how the vocabulary's tokenizer splits text before it merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Documents that one bucket holds at most on average, and residuals that meet at one node of the tree.
BUCKET, FAN = 20_000, 64

_ENCODINGS: dict[str, object] = {}


def encoding(folder: str = TOKENIZERS, name: str = VOCABULARY):
    """The public tokenizer, made once in each process."""
    path = os.path.join(folder, name)
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def source_name(source: Column) -> Column:
    """One spelling of a source: lower case, ``_`` as separator, no blanks around; empty becomes null."""
    return F.nullif(F.regexp_replace(F.trim(F.lower(source)), r"[\s_-]+", "_"), F.lit(""))


def sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, source, tokens)`` of every document; a null or empty text has no tokens."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder, vocabulary)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["_text"]]
            yield pd.DataFrame({"id": pdf["_id"], "source": pdf["source"], "tokens": np.array(n, np.int64)})

    df = docs.select(F.col(id_col).alias("_id"), source_name(F.col(source_col)).alias("source"), F.col(text_col).alias("_text"))
    return df.mapInPandas(count, f"id {id_type}, source string, tokens bigint")


def pivotal(weight: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """``x`` (fractions in [0, 1]) rounded in turn; the index of what is left fractional, or -1."""
    x = x.copy()
    coins = rng.random(len(x))
    left = -1
    for k in range(len(x)):
        if not 1e-12 < x[k] < 1 - 1e-12:
            x[k] = round(x[k])
            continue
        if weight[k] <= 0:  # nothing to trade
            x[k] = 1.0 if coins[k] < x[k] else 0.0
            continue
        if left < 0:
            left = k
            continue
        i, j = left, k
        # in tokens: raise i and lower j by up, or lower i and raise j by down
        up = min((1 - x[i]) * weight[i], x[j] * weight[j])
        down = min(x[i] * weight[i], (1 - x[j]) * weight[j])
        move = up if coins[k] * (up + down) < down else -down
        x[i] += move / weight[i]
        x[j] -= move / weight[j]
        open_ = [q for q in (i, j) if 1e-9 < x[q] < 1 - 1e-9]
        for q in (i, j):
            if q not in open_:
                x[q] = round(x[q])
        left = open_[0] if open_ else -1
    return x, left


def plan(size: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per mix and source: targets, what there is, and the expected copies of each document."""
    t = targets.select("mix", source_name(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).where("mix is not null and source is not null")
    t = t.groupBy("mix", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    by = size.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    total = size.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]  # one number
    have = by.where("source is not null")
    p = t.join(have, "source", "left")
    target = F.coalesce(F.col("target_share"), F.lit(0.0)) * F.lit(float(total))
    wanted = F.when(F.col("tokens") > 0, target / F.col("tokens")).otherwise(F.lit(0.0))
    return p.select(
        "mix", "source", "target_share", "max_repeats", F.lit(int(total)).cast("bigint").alias("total_tokens"), target.alias("target_tokens"), F.coalesce("tokens", F.lit(0)).alias("available_tokens"),
        F.coalesce("documents", F.lit(0)).alias("available_documents"), F.greatest(F.lit(0.0), F.least(wanted, F.coalesce(F.col("max_repeats"), F.lit(1)).cast("double"))).alias("copies_each"),
    )


def mix(size: DataFrame, targets: DataFrame, *, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(mix, id, source, tokens, copies)`` for the documents used, and the plan.

    ``size`` is what :func:`sizes` gives, one row per document. Documents without a source, and sources without a target
    (null or 0), take no part; a source with a target but without documents is in the plan only. A null cap counts as 1.
    Equal inputs give equal outputs, whatever the partitioning.
    """
    checkpoint_dir(size.sparkSession)
    size = size.checkpoint()
    p = plan(size, targets).checkpoint()
    n = size.count()
    levels, buckets = 0, 1
    while buckets * BUCKET < n:
        levels, buckets = levels + 1, buckets * FAN
    id_type = size.schema["id"].dataType.simpleString()
    shares = p.where("copies_each > 0").select("mix", "source", "copies_each")
    docs = size.where("source is not null").join(F.broadcast(shares), "source")  # the targets are a small fixed table
    whole = F.floor(F.col("copies_each") + F.lit(1e-9))
    docs = docs.select(
        "mix", "source", "id", "tokens", whole.cast("bigint").alias("whole"), F.greatest(F.lit(0.0), F.col("copies_each") - whole).alias("rest"), F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(buckets)).cast("bigint").alias("node")
    )
    schema = f"mix string, source string, id {id_type}, tokens bigint, whole bigint, rest double, node bigint, done boolean"

    def rounding(level: int, last: bool):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
            rng = np.random.default_rng([seed, level, abs(int(key[2])), *f"{key[0]}\x00{key[1]}".encode()])
            x, left = pivotal(pdf["tokens"].to_numpy(float), pdf["rest"].to_numpy(float), rng)
            if left >= 0 and last:
                x[left] = 1.0 if rng.random() < x[left] else 0.0
                left = -1
            pdf["rest"], pdf["done"] = x, True
            if left >= 0:
                pdf.loc[left, "done"] = False
            pdf["node"] = pdf["node"] // FAN
            return pdf[[c.split()[0] for c in schema.split(", ")]]

        return run

    out = None
    for level in range(levels + 1):
        done = docs.groupBy("mix", "source", "node").applyInPandas(rounding(level, level == levels), schema).checkpoint()
        part = done.where("done")
        out = part if out is None else out.unionByName(part)
        docs = done.where("not done").drop("done")
    used = out.select("mix", "id", "source", "tokens", (F.col("whole") + F.round("rest").cast("bigint")).alias("copies"))
    return used.where("copies > 0"), p


def shares(used: DataFrame, p: DataFrame) -> DataFrame:
    """What each mix and source reached: ``(mix, source, target_share, target_tokens, available_tokens, reached_tokens, reached_share, shortfall_tokens, documents, max_copies)``."""
    got = used.groupBy("mix", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"), F.count("*").alias("documents"), F.max("copies").alias("max_copies"))
    r = F.coalesce("reached", F.lit(0))
    capped = F.col("copies_each") * F.col("available_tokens")
    return p.join(got, ["mix", "source"], "left").select(
        "mix", "source", "target_share", "target_tokens", "available_tokens", r.alias("reached_tokens"), F.when(F.col("total_tokens") > 0, r / F.col("total_tokens")).otherwise(0.0).alias("reached_share"),
        F.greatest(F.lit(0.0), F.col("target_tokens") - capped).alias("shortfall_tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"),
    )
