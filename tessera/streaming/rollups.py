"""The roll-ups as streams: an addition for data that keeps arriving; the batch operators give the same figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, at: str, late: str, window: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums per window and keys; rows later than `late` behind the newest are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most")).select(F.col("window.start").alias("start"), *keys, "n", "total", "most")


def first_of(events: DataFrame, at: str, late: str, key: str) -> DataFrame:
    """The events without those whose key was seen within the watermark: retried deliveries come through once."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def labelled(findings: DataFrame, outcomes: DataFrame, late: str) -> DataFrame:
    """Findings joined to outcomes of their run that come within `late` of them, from two streams with `run_id`, `created_at`."""
    f = findings.withWatermark("created_at", late)
    o = outcomes.select(F.col("run_id").alias("o_run"), F.col("created_at").alias("o_at"), "outcome").withWatermark("o_at", late)
    return f.join(o, (F.col("run_id") == F.col("o_run")) & F.col("o_at").between(F.col("created_at"), F.col("created_at") + F.expr(f"interval {late}")), "inner")
