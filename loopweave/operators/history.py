"""The history of attempts: what was tried, what failed, and what follows for the next try.

``attempts`` has ``attempt_id, cycle_id, strategy, approved, issue_types, suggestions, approach_summary, diff_summary,
severity_counts, ts``; a re-delivered attempt counts once. A null ``approved`` is neither success nor failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def strategy_name(s: Column) -> Column:
    """One spelling: lower case with ``_``; null and blank become ``unknown``."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(s)), r"[\s-]+", "_"), F.lit("")), F.lit("unknown"))


def strategy_from_text(text: Column) -> Column:
    """The strategy that a rationale speaks of; first word that occurs wins."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(t.contains("interface"), "interface_extraction").when(t.contains("lazy"), "lazy_import").when(t.contains("shared") | t.contains("common"), "shared_module").when(t.contains("event"), "event_driven").otherwise("unknown")
    )


def attempt_time(ts: Column) -> Column:
    """Text in more than one ISO form as a timestamp; null where it is none."""
    t = F.trim(ts)
    return F.coalesce(
        F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.try_to_timestamp(t, F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(t, F.lit("yyyyMMdd'T'HHmmss'Z'")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss"))
    )


def stats(attempts: DataFrame) -> DataFrame:
    """One row: attempts, approved, rejected, rate, strategies, cycles."""
    a = F.coalesce(F.sum(F.when(F.col("approved"), 1).otherwise(0)), F.lit(0))
    return attempts.agg(
        F.count("*").alias("total"), a.alias("approved"), F.coalesce(F.sum(F.when(~F.col("approved"), 1).otherwise(0)), F.lit(0)).alias("rejected"), F.coalesce(F.try_divide(a, F.count("*")), F.lit(0.0)).alias("rate"),
        F.countDistinct(strategy_name(F.col("strategy"))).alias("strategies"), F.countDistinct("cycle_id").alias("cycles"),
    )


def learning(attempts: DataFrame) -> DataFrame:
    """Per strategy: successes, failures and the rate of success among both."""
    s, f = F.sum(F.when(F.col("approved"), 1).otherwise(0)), F.sum(F.when(~F.col("approved"), 1).otherwise(0))
    df = attempts.groupBy(strategy_name(F.col("strategy")).alias("strategy")).agg(s.alias("successes"), f.alias("failures"))
    return df.withColumn("rate", F.coalesce(F.try_divide(F.col("successes"), F.col("successes") + F.col("failures")), F.lit(0.0)))


def issue_histogram(attempts: DataFrame) -> DataFrame:
    """``(strategy, issue, failures)`` over failed attempts; issue types in one case, each once an attempt."""
    low = F.array_distinct(F.transform(F.coalesce("issue_types", F.array().cast("array<string>")), F.lower))
    f = attempts.where(~F.col("approved")).select(strategy_name(F.col("strategy")).alias("strategy"), F.explode(low).alias("issue"))
    return f.groupBy("strategy", "issue").agg(F.count("*").alias("failures"))


def tips(attempts: DataFrame) -> DataFrame:
    """Per strategy the tips that its history gives: a low rate, an issue that keeps coming back, the last success."""
    learned = learning(attempts)
    top = issue_histogram(attempts).groupBy("strategy").agg(F.max(F.struct("failures", F.col("issue"))).alias("_t"))
    last = attempts.where("approved").groupBy(strategy_name(F.col("strategy")).alias("strategy")).agg(F.max_by("approach_summary", "attempt_id").alias("last_success"))
    df = learned.join(top, "strategy", "left").join(last, "strategy", "left")
    low = F.when((F.col("failures") > 3) & (F.col("rate") < 0.3), F.lit("low success rate"))
    often = F.when(F.col("_t.failures") >= 3, F.concat(F.lit("often fails with "), F.col("_t.issue")))
    done = F.when(F.col("last_success").isNotNull(), F.concat(F.lit("last success: "), F.left("last_success", F.lit(80))))
    return df.select("strategy", F.array_join(F.array_compact(F.array(low, often, done)), " | ").alias("tips"))


def recurring(attempts: DataFrame, least: int = 2) -> DataFrame:
    """``(cycle_id, issue, failures)``: issues of a cycle that failed attempts have had ``least`` times or more."""
    low = F.array_distinct(F.transform(F.coalesce("issue_types", F.array().cast("array<string>")), F.lower))
    f = attempts.where(~F.col("approved")).select("cycle_id", F.explode(low).alias("issue"))
    return f.groupBy("cycle_id", "issue").agg(F.count("*").alias("failures")).where(F.col("failures") >= least)


def common_issues(attempts: DataFrame) -> DataFrame:
    """``(cycle_id, issue)``: issues that all attempts of a cycle had, two attempts at least."""
    low = F.array_distinct(F.transform(F.coalesce("issue_types", F.array().cast("array<string>")), F.lower))
    n = attempts.groupBy("cycle_id").agg(F.count("*").alias("_n")).where("_n >= 2")
    return attempts.select("cycle_id", F.explode(low).alias("issue")).groupBy("cycle_id", "issue").agg(F.count("*").alias("_k")).join(n, "cycle_id").where("_k = _n").select("cycle_id", "issue")


def last_attempts(attempts: DataFrame, n: int = 10, key: str = "cycle_id") -> DataFrame:
    """The ``n`` newest attempts of each key, ``position`` 1 being the newest."""
    w = W.partitionBy(key).orderBy(F.desc("attempt_id"))
    return attempts.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def recent(attempts: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` newest attempts of all."""
    return attempts.orderBy(F.desc("attempt_id")).limit(n)


def without_cycle(attempts: DataFrame, cycle_id: str | None) -> DataFrame:
    """``attempts`` without those of one cycle."""
    return attempts.where(~F.col("cycle_id").eqNullSafe(F.lit(cycle_id)))


def similar_failures(attempts: DataFrame, issues: list[str], n: int = 5) -> DataFrame:
    """The ``n`` newest failures that have one of ``issues``."""
    low = F.transform(F.coalesce("issue_types", F.array().cast("array<string>")), F.lower)
    return attempts.where(~F.col("approved") & F.arrays_overlap(low, F.array(*map(F.lit, issues)))).orderBy(F.desc("attempt_id")).limit(n)


def accumulated(attempts: DataFrame, key: str = "cycle_id") -> DataFrame:
    """Each attempt with what was known before it: running number, failures so far, and the strategies that failed."""
    w = W.partitionBy(key).orderBy("attempt_id").rowsBetween(W.unboundedPreceding, -1)
    failed = F.when(~F.col("approved"), strategy_name(F.col("strategy")))
    return attempts.select(
        "attempt_id", key, F.row_number().over(W.partitionBy(key).orderBy("attempt_id")).alias("turn"), F.coalesce(F.sum(F.when(~F.col("approved"), 1).otherwise(0)).over(w), F.lit(0)).alias("failed_before"),
        F.array_sort(F.collect_set(failed).over(w)).alias("failed_strategies"),
    )


def memory_context(attempts: DataFrame, max_chars: int = 1500) -> DataFrame:
    """``(cycle_id, context)``: the last three attempts as text, oldest first, cut to ``max_chars`` less 50."""
    last = last_attempts(attempts, 3)
    low = F.slice(F.array_distinct(F.transform(F.coalesce("issue_types", F.array().cast("array<string>")), F.lower)), 1, 3)
    line = F.concat(F.lit("- "), strategy_name(F.col("strategy")), F.lit(": "), F.when(F.col("approved"), "approved").otherwise("rejected"), F.when(F.size(low) > 0, F.concat(F.lit(" ("), F.array_join(low, ", "), F.lit(")"))).otherwise(""))
    text = last.groupBy("cycle_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("position")).alias("o"), line.alias("l")))).alias("_l"))
    joined = F.array_join(F.transform("_l", lambda x: x["l"]), "\n")
    return text.select("cycle_id", F.left(joined, F.lit(max_chars - 50)).alias("context"))


def by_status(patches: DataFrame) -> DataFrame:
    """Run totals: patches and mean confidence per status."""
    return patches.groupBy("status").agg(F.count("*").alias("patches"), F.avg("confidence").alias("confidence"))


def revert_gate(patches: DataFrame, on_critical_only: bool = True) -> DataFrame:
    """Patches with ``revert_all``: whether any patch of the same cycle and iteration is critical (or failed)."""
    w = W.partitionBy("cycle_id", "iteration")
    bad = F.coalesce(F.col("has_critical_error"), F.lit(False)) if on_critical_only else F.col("status") == "failed"
    g = patches.withColumn("revert_all", F.coalesce(F.bool_or(bad).over(w), F.lit(False)))
    return g.withColumn("final_status", F.when(F.col("revert_all") & (F.col("status") != "unchanged"), F.lit("reverted")).otherwise(F.col("status")))


def roadmap(patches: DataFrame) -> DataFrame:
    """Per cycle: successes, partial attempts, and the confidence 0.8 s / (s + p) if there is any success."""
    changed = F.coalesce(F.col("patched"), F.lit("")) != F.coalesce(F.col("original"), F.lit(""))
    ok = F.col("status").isin("applied", "partial") & changed
    g = patches.groupBy("cycle_id").agg(F.sum(F.when(ok, 1).otherwise(0)).alias("successes"), F.sum(F.when(ok, 0).otherwise(1)).alias("partial"))
    return g.withColumn("confidence", F.when(F.col("successes") > 0, 0.8 * F.col("successes") / (F.col("successes") + F.col("partial"))).otherwise(0.0))


def failures(patches: DataFrame) -> DataFrame:
    """Failure report per cycle: patches that failed, were reverted or are partial, and their reasons, most frequent first."""
    bad = patches.where(F.col("status").isin("failed", "reverted", "partial"))
    why = bad.groupBy("cycle_id", F.coalesce("revert_reason", F.lit("none given")).alias("reason")).agg(F.count("*").alias("n"))
    return why.groupBy("cycle_id").agg(F.sum("n").alias("failures"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "reason"))), lambda x: F.concat(x["reason"], F.lit(" x"), (-x["k"]).cast("string"))), "; ").alias("reasons"))
