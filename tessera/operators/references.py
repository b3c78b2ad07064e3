"""References to records that don't exist (problem 5): signed counts of existence per key, references judged at their time.

A target's rows and removals become signed changes of its existence, +1 where it begins to stand and -1 where it ends.
A reference made at time t is an orphan if the changes of its target up to t sum to nothing. To sum them for every
reference without bringing a key's whole history into one task, time is cut into slices: what a key's changes sum to
when it enters a slice comes from one small aggregate per key and slice, and only inside a slice are changes and
references laid side by side. A slice of a key that holds very many references is spread over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: References of one key in one slice that a task takes.
SPREAD = 50_000
_LAST = "9999-12-31 23:59:59.999999"


def target_key(*parts: Column) -> Column:
    """One string from the parts of a key; null if any is null."""
    return F.concat_ws("\0", *parts) if len(parts) == 1 else F.when(~F.greatest(*[p.isNull() for p in parts]), F.concat_ws("\0", *parts))


def changes(appearances: DataFrame, removals: DataFrame) -> DataFrame:
    """Columns `key, ts, stands`: one state per key and time; at one time a removal comes after a row.

    Both have `key` and `ts`; rows without either say nothing.
    """
    both = appearances.select("key", "ts", F.lit(True).alias("stands")).unionByName(removals.select("key", "ts", F.lit(False).alias("stands")))
    return both.where("key is not null and ts is not null").groupBy("key", "ts").agg(F.min("stands").alias("stands"))


def deltas(changes: DataFrame) -> DataFrame:
    """Columns `key, slice, ts, delta`: +1 where a target begins to stand, -1 where it ends; other changes are none. A slice is a day.

    A state is held against the one before it in its slice, and the first of a slice against the last of the slice before.
    """
    sliced = changes.select("key", F.to_date("ts").alias("slice"), "ts", F.col("stands").cast("int").alias("stands"))
    last = sliced.groupBy("key", "slice").agg(F.max_by("stands", "ts").alias("stands"))
    entering = F.lag("stands").over(Window.partitionBy("key").orderBy("slice"))
    within = F.lag("stands").over(Window.partitionBy("key", "slice").orderBy("ts"))
    both = sliced.join(last.select("key", "slice", entering.alias("entering")), ["key", "slice"]).withColumn("before", F.coalesce(within, "entering", F.lit(0)))
    return both.select("key", "slice", "ts", (F.col("stands") - F.col("before")).alias("delta")).where("delta <> 0")


def _spread(references: DataFrame, columns: list[str]) -> Column:
    """A hash by which rows of one key and slice are spread; the same whenever a task is run again."""
    plain = [c for c in columns if "map<" not in references.schema[c].dataType.simpleString()]  # maps can't be hashed
    return F.xxhash64("at", *[F.col("row")[c] for c in plain])


def orphans(references: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows of `references` with `orphan`: whether their target doesn't stand at their time.

    `references` has `key`, `ts` and any other columns; one named `orphan` is replaced. A null key refers to nothing and
    its row is left out. A reference without time is judged by the last state. A change at the very time of a reference
    comes before it. Repeated rows come out as often as they come in; empty tables give empty ones.
    """
    kept = [c for c in references.columns if c != "orphan"]
    at = F.coalesce("ts", F.lit(_LAST).cast("timestamp"))
    refs = references.where("key is not null").select("key", at.alias("at"), F.to_date(at).alias("slice"), F.struct(*kept).alias("row"))
    asked = refs.groupBy("key", "slice").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("salts"))
    signed = deltas(changes)
    sums = signed.groupBy("key", "slice").agg(F.sum("delta").alias("delta")).withColumn("salts", F.lit(None).cast("int"))
    known = sums.unionByName(asked.withColumn("delta", F.lit(None).cast("long"))).groupBy("key", "slice").agg(F.sum("delta").alias("delta"), F.max("salts").alias("salts"))
    entering = F.sum("delta").over(Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = known.withColumn("entering", F.coalesce(entering, F.lit(0))).where("salts is not null").select("key", "slice", "salts", "entering")
    spread = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    first = slices.select("key", "slice", spread, F.lit(None).cast("timestamp").alias("at"), F.col("entering").alias("delta"))
    inside = signed.join(slices, ["key", "slice"]).select("key", "slice", spread, F.col("ts").alias("at"), F.col("delta").cast("long").alias("delta"))
    salted = refs.join(slices.select("key", "slice", "salts"), ["key", "slice"]).withColumn("salt", F.pmod(_spread(references, kept), F.col("salts")).cast("int")).drop("salts")
    lined = salted.withColumn("kind", F.lit(1)).unionByName(first.unionByName(inside).withColumn("kind", F.lit(0)), allowMissingColumns=True)
    existence = F.sum(F.coalesce("delta", F.lit(0))).over(Window.partitionBy("key", "slice", "salt").orderBy(F.col("at").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    judged = lined.withColumn("missing", existence <= 0).where("kind = 1")
    return judged.select("row.*", F.col("missing").alias("orphan"))


def standing(references: DataFrame, changes: DataFrame) -> DataFrame:
    """Columns `key, refs, existence`: signed counts of each key as of now. Zero existence with positive refs is an orphan key."""
    counts = references.where("key is not null").select("key", F.lit(1).alias("refs"), F.lit(0).alias("existence"))
    now = deltas(changes).select("key", F.lit(0).alias("refs"), F.col("delta").alias("existence"))
    return counts.unionByName(now).groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("existence").alias("existence"))
