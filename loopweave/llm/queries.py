"""The pN queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load, once
from . import handwritten, leaks, mixing, pairs, sentences, split, syntax, truncation


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return split.oversized(split.split_files(load(spark, sf, "cycle_files"), load(spark, sf, "split_limits"), with_pieces=False))


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    files = once(load(spark, sf, "cycle_files", "file_id", "path", "content"), "file_id")
    return split.explode_pieces(split.split_files(files, load(spark, sf, "split_limits")))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "proposals", "proposal_id", "relay", "prompt", "llm_response")
    return truncation.answers(a, load(spark, sf, "minimal_diffs", "diff_id", "relay", "prompt", "raw_llm_response"))


def p2_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """How many pairs each kind of evidence found, per defect."""
    return pairs.defects(_answers(spark, sf)).groupBy("source_table", "defect", "evidence").agg(F.count("*").alias("n_pairs"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.defects(_answers(spark, sf)).drop("evidence")


def p4_files(spark: SparkSession, sf: str) -> DataFrame:
    return handwritten.not_handwritten(load(spark, sf, "cycle_files", "file_id", "path", "content", "project"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_files(spark, sf).select("file_id")


def _cuts(spark: SparkSession, sf: str) -> DataFrame:
    patches = load(spark, sf, "patch_results", "patch_id", "relay", "path", "original", "patched")
    return pairs.cut_values(_answers(spark, sf), patches)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _cuts(spark, sf).where("cut").select("source_table", "row_id").distinct()


def p5_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """How many cut values each kind of evidence found, per table."""
    one = _cuts(spark, sf).where("cut").dropDuplicates(["source_table", "row_id"])
    return one.groupBy("source_table", "evidence").agg(F.count("*").alias("n_cut"))


def p5_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of cut values per relay and field, re-delivered rows counted once."""
    one = _cuts(spark, sf).dropDuplicates(["source_table", "row_id"])
    field = F.when(F.col("source_table") == "proposals", "llm_response").when(F.col("source_table") == "minimal_diffs", "raw_llm_response").otherwise("patched")
    return one.groupBy("relay", field.alias("field")).agg(F.count("*").alias("n_values"), F.sum(F.col("cut").cast("bigint")).alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n_values"))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    files = load(spark, sf, "cycle_files", "file_id", "path", "content", "project")
    return syntax.sources(files, load(spark, sf, "patch_results", "patch_id", "path", "patched", "project"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.unparsed(_sources(spark, sf))


def p3_faults(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.faults(syntax.verdicts(_sources(spark, sf)))


def p3_rates(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.rates(syntax.verdicts(_sources(spark, sf)))


def p6_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(load(spark, sf, "documents"), load(spark, sf, "eval_items"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_pairs(spark, sf).where(F.col("kind") == leaks.LEAK).select("doc_id", "item_id")


def p6_reparameterised(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs where the document asks the item's question with other values; no leaks."""
    return p6_pairs(spark, sf).where(F.col("kind") == leaks.REPARAMETERISED).drop("kind")


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """Which items leaked, into how many documents and how completely at most."""
    found = p6_pairs(spark, sf).where(F.col("kind") == leaks.LEAK).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("share").alias("most"))
    items = load(spark, sf, "eval_items", "item_id", "suite").dropDuplicates(["item_id"])
    return items.join(found, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"), "most")


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(mixing.sizes(load(spark, sf, "documents", "doc_id", "text", "source")), load(spark, sf, "mix_targets"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(*_mix(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_ends(load(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_pieces": p1_pieces, "p2_found": p2_found, "p2_evidence": p2_evidence, "p3_found": p3_found, "p3_faults": p3_faults, "p3_rates": p3_rates, "p4_found": p4_found, "p4_files": p4_files, "p5_found": p5_found, "p5_evidence": p5_evidence, "p5_rates": p5_rates, "p6_found": p6_found, "p6_items": p6_items, "p6_reparameterised": p6_reparameterised, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": r"""
            SELECT file_id, max(CASE WHEN list_max([length(x) for x in regexp_split_to_array(content, '\r\n|\n|\r')]) > max_chars THEN 1 ELSE 0 END)::INT AS long_line
            FROM cycle_files JOIN split_limits ON lower(regexp_extract(path, '\.([^.]*)$', 1)) = ext
            WHERE length(content) > max_chars GROUP BY file_id""",
    }
