"""Evaluation of predicted against given labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positive(label: Column) -> Column:
    """Whether a label says yes, strongly or possibly; null for none."""
    return label.startswith("STRONG") | label.startswith("POSSIBLE")


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def counts() -> list[Column]:
    """The aggregates of one evaluation, over rows with the columns of `judged`."""
    n = lambda c, name: F.count_if(c).alias(name)
    c = {k: F.coalesce(F.col(k), F.lit(False)) for k in ("counted", "proposed", "truth", "guess", "same")}
    given = c["counted"] & F.col("predicted").isNotNull() & c["proposed"]
    filtered = c["counted"] & c["proposed"] & (F.col("source") == "triage")
    return [
        F.count("id").alias("entries"),
        n(F.col("needs_recheck"), "needs_recheck"),
        n(c["counted"], "labelled"),
        n(given, "predicted"),
        n(c["counted"] & c["proposed"] & F.col("predicted").isNull(), "unclassified"),
        n(given & c["guess"] & c["truth"], "tp"),
        n(given & c["guess"] & ~c["truth"], "fp"),
        n(given & ~c["guess"] & c["truth"], "fn"),
        n(given & ~c["guess"] & ~c["truth"], "tn"),
        n(given & c["same"], "exact"),
        n(filtered, "filtered"),
        n(filtered & ~c["truth"], "agreed"),
        n(filtered & c["truth"], "overturned"),
        n(c["counted"] & c["proposed"] & c["truth"], "proposed_positives"),
        n(c["counted"] & ~c["proposed"] & c["truth"], "missed_positives"),
    ]


def judged(entries: DataFrame) -> DataFrame:
    """Adds what `counts` needs to active entries with `human`, `auto`, `origin` and `needsRecheck`.

    A label on code that has changed since is no ground truth: it is counted and left out. Missed decisions
    weren't proposed and count for coverage only.
    """
    label, auto = F.col("human.label"), F.col("auto.label")
    old = label.isNotNull() & F.coalesce("needsRecheck", F.lit(False))
    return entries.where("status = 'active'").select(
        "*",
        old.alias("needs_recheck"),
        (label.isNotNull() & ~old).alias("counted"),
        (F.coalesce("origin", F.lit("")) != "missed").alias("proposed"),
        positive(label).alias("truth"),
        auto.alias("predicted"),
        positive(auto).alias("guess"),
        (auto == label).alias("same"),
        F.col("auto.source").alias("source"),
    )


def rates(counted: DataFrame) -> DataFrame:
    """Precision, recall, false positive rate, agreement and coverage; null on nothing by nothing."""
    c = F.col
    return counted.select(
        "*",
        F.round(ratio(c("tp"), c("tp") + c("fp")), 6).alias("precision"),
        F.round(ratio(c("tp"), c("tp") + c("fn")), 6).alias("recall"),
        F.round(ratio(c("fp"), c("fp") + c("tn")), 6).alias("fpr"),
        F.round(ratio(c("exact"), c("predicted")), 6).alias("exact_agreement"),
        F.round(ratio(c("proposed_positives"), c("proposed_positives") + c("missed_positives")), 6).alias("coverage"),
    )
