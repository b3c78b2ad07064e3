"""Joins of points and intervals within a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a bin: an interval is looked for in the bins it touches only, so one long file is no single task.
BIN = 64


def _bins(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / BIN), F.greatest(F.floor(start / BIN), F.floor(end / BIN)))).alias("bin")


def containing(points: DataFrame, intervals: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Each point with each interval of its keys that holds it, both ends included. Nulls hold nothing."""
    binned = intervals.where("start is not null and end >= start").select("*", _bins(F.col("start"), F.col("end")))
    return points.withColumn("bin", F.floor(F.col(line) / BIN)).join(binned, [*keys, "bin"]).where(F.col(line).between(F.col("start"), F.col("end"))).drop("bin")


def innermost(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, line: str = "line") -> DataFrame:
    """Each point that some interval holds, with the one that starts at it or else starts last; of these the one that ends first."""
    found = containing(points, intervals, keys, line)
    best = F.max_by(F.struct("start", "end", "name"), F.struct(F.col("start"), -F.col("end"), F.col("name")))
    return found.groupBy(*keys, point, line).agg(best.alias("i")).select(*keys, point, line, "i.*")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], lid: str, rid: str) -> DataFrame:
    """Pairs of ids of intervals that share a line; both have `start` and `end`."""
    a = left.where("end >= start").select(*keys, F.col(lid).alias("left_id"), F.col("start").alias("ls"), F.col("end").alias("le"), _bins(F.col("start"), F.col("end")))
    b = right.where("end >= start").select(*keys, F.col(rid).alias("right_id"), F.col("start").alias("rs"), F.col("end").alias("re"), _bins(F.col("start"), F.col("end")))
    return a.join(b, [*keys, "bin"]).where("ls <= re and rs <= le").select(*keys, "left_id", "right_id").distinct()
