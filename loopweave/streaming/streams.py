"""Streaming forms of the history operators (extensions: the batch forms are the ones that are compared)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.history import strategy_name


def learning_stream(attempts: DataFrame, late: str = "2 days", window: str = "1 day") -> DataFrame:
    """Successes and failures per strategy and window of ``ingested_at``; re-delivered attempts count once within ``late``."""
    a = attempts.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["attempt_id"])
    g = a.groupBy(F.window("ingested_at", window).alias("w"), strategy_name(F.col("strategy")).alias("strategy"))
    s = g.agg(F.sum(F.when(F.col("approved"), 1).otherwise(0)).alias("successes"), F.sum(F.when(~F.col("approved"), 1).otherwise(0)).alias("failures"))
    return s.select(F.col("w.start").alias("start"), "strategy", "successes", "failures")


def paired_calls(prompts: DataFrame, answers: DataFrame, late: str = "1 hour") -> DataFrame:
    """Calls with their answers, by ``call_id``, as both streams arrive: ``(call_id, sent_at, answered_at)``."""
    p = prompts.select("call_id", "sent_at").withWatermark("sent_at", late)
    a = answers.select(F.col("call_id").alias("_c"), "answered_at").withWatermark("answered_at", late)
    return p.join(a, F.expr(f"call_id = _c and answered_at >= sent_at and answered_at <= sent_at + interval {late}")).select("call_id", "sent_at", "answered_at")


def transition_stream(events: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Events per type and window of time, late ones dropped after ``late``."""
    e = events.withWatermark("ts", late)
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """All that is there now into an in-memory table ``name``; returns when done."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
