"""Two-sided evidence: what records of two kinds of code show, feature by feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(records: DataFrame, features: Column, names: list[str]) -> DataFrame:
    """Columns `id, project, side, feature, value`: one row per record and feature; unknown and blank values are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), features[n].alias("value")) for n in names])).alias("f")
    return records.select("id", "project", "side", pairs).select("id", "project", "side", "f.*").where("value is not null and value <> '' and value <> 'unknown'")


def value_counts(rows: DataFrame) -> DataFrame:
    """Columns `feature, side, value, n, rank`: by count from the top, then by value."""
    n = rows.groupBy("feature", "side", "value").agg(F.countDistinct("id").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("feature", "side").orderBy(F.desc("n"), "value")))  # a few values each


def strength(records: Column, projects: Column) -> Column:
    """How much evidence there is: of several projects, of several records, or one example."""
    return F.when(projects >= 2, "cross_project").when(records >= 2, "recurring_in_one_project").otherwise("single_example")


def confidence(projects: Column, contested: Column, both_sides: Column) -> Column:
    """high from three projects, medium from two; one step down if contested; low if only one side was measured."""
    base = F.when(projects >= 3, 2).when(projects >= 2, 1).otherwise(0)
    step = F.when(~both_sides, 0).when(contested, F.greatest(base - 1, F.lit(0))).otherwise(base)
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), step + 1)


def groups(rows: DataFrame, one: str, other: str) -> DataFrame:
    """One row per feature measured on side `one`: the top value of each side, direction, counter-examples and reach.

    Sides separate if their tops differ; that is contested if a record of one side shows the other's top.
    """
    counts = value_counts(rows)
    top = counts.where("rank = 1").groupBy("feature").pivot("side", [one, other]).agg(F.first("value").alias("top"), F.first("n").alias("n"))
    tops = top.select("feature", F.col(f"{one}_top").alias("top_one"), F.col(f"{one}_n").alias("top_one_n"), F.col(f"{other}_top").alias("top_other"), F.col(f"{other}_n").alias("top_other_n"))
    sizes = rows.groupBy("feature").agg(
        F.countDistinct(F.when(F.col("side") == one, F.col("id"))).alias("n_one"), F.countDistinct(F.when(F.col("side") == other, F.col("id"))).alias("n_other"), F.countDistinct(F.struct("side", "id")).alias("records"), F.countDistinct("project").alias("projects")
    )
    against = counts.join(tops, "feature").where(((F.col("side") == other) & (F.col("value") == F.col("top_one"))) | ((F.col("side") == one) & (F.col("value") == F.col("top_other"))))
    against = against.where("top_one <> top_other").groupBy("feature").agg(F.sum("n").alias("counter_examples"))
    j = sizes.where("n_one > 0").join(tops, "feature").join(against, "feature", "left").withColumn("counter_examples", F.coalesce("counter_examples", F.lit(0)))
    both = F.col("n_other") > 0
    direction = F.when(~both, "one_side_only").when(F.col("top_one") == F.col("top_other"), "no_separation").when(F.col("counter_examples") > 0, "contested").otherwise("separates")
    return j.select(
        "feature", "n_one", "n_other", "top_one", "top_other", direction.alias("direction"), "counter_examples", "projects", strength(F.col("records"), F.col("projects")).alias("strength"), confidence(F.col("projects"), F.col("counter_examples") > 0, both).alias("confidence"),
        ((F.col("top_one_n") == F.col("n_one")) & (F.col("n_one") > 1)).alias("uniform"),
    )


def ordered_batches(groups: DataFrame, size: int) -> DataFrame:
    """Groups in the order in which they are worth reading, in batches; there are as many groups as features."""
    at = F.array_position(F.array(*map(F.lit, ("separates", "contested", "one_side_only", "no_separation"))), F.col("direction"))
    n = F.row_number().over(Window.orderBy(at, F.desc("projects"), "feature"))
    return groups.withColumn("position", n).withColumn("batch", F.floor((n - 1) / size))


def supposed_groups(rows: DataFrame) -> DataFrame:
    """One row for each thing that was `supposed` of records (`id, project, supposed, found`): how many records, how many support and contradict it, and how far the support reaches.

    It was looked for on one side only, so it can't separate two sides and `confidence` is low.
    """
    is_, projects = lambda found: F.col("found") == found, F.countDistinct(F.when(F.col("found") == "supported", F.col("project")))
    g = rows.groupBy("supposed").agg(F.count("*").alias("records"), F.count_if(is_("supported")).alias("supported"), F.count_if(is_("contradicted")).alias("contradicted"), projects.alias("projects"))
    said = F.concat(F.lit("contradicted at "), "contradicted", F.lit(" of "), "records", F.when(F.col("supported") > 0, F.concat(F.lit(", supported at "), "supported")).otherwise(", supported at none"))
    contested = F.col("contradicted") > 0
    return g.select(
        "*", F.lit("one_side_only").alias("direction"), strength(F.col("supported"), F.col("projects")).alias("strength"), confidence(F.col("projects"), contested, F.lit(False)).alias("confidence"), contested.alias("contested"),
        ((F.col("supported") == F.col("records")) & (F.col("records") >= 5)).alias("uniform"), said.alias("why"),
    )
