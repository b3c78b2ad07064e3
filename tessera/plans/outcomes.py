"""The outcome loop: findings labelled by what became of their runs, and rolled up by pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import norm_key, table
from tessera.plans.registry import Book

BOOK = Book()

_FIELDS = ("is_opportunity", "result", "checks_after_ok", "verdict", "pattern_label", "input_kind", "rule_kind", "primitive", "rule_shape", "why_generic", "ai_score", "typesafe_score", "pattern_score", "average", "created_at")


def distinct_findings(findings: DataFrame, *fields: str) -> DataFrame:
    """One row per finding: rows with one id are copies; ids and run ids are compared without case and blanks."""
    return findings.select(norm_key("id").alias("id"), norm_key("run_id").alias("run_id"), norm_key("repo_id").alias("repo_id"), *fields).distinct()


def labelled(findings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Findings with `undone` (some outcome of the run is `undone`) and `label`.

    good: the change held; bad: it was taken back; rejected: no opportunity to begin with; else unknown. The
    undone runs are made distinct before the join, so no finding is doubled. Nulls count as not true.
    """
    undone = outcomes.where((norm_key("outcome") == "undone") & (norm_key("run_id") != "")).select(norm_key("run_id").alias("run_id")).distinct().withColumn("undone", F.lit(True))
    changed, taken_back = F.col("result") == "changed", F.coalesce("undone", F.lit(False))
    label = (
        F.when(changed & ~taken_back & F.coalesce("checks_after_ok", F.lit(False)), "good")
        .when((F.col("result") == "reverted") | (changed & taken_back), "bad")
        .when(~F.col("is_opportunity") | F.col("verdict").isin("WEAK_FIT", "NOT_OPPORTUNITY"), "rejected")
        .otherwise("unknown")
    )
    keyed = F.coalesce("run_id", F.lit("")) != ""
    met = findings.where(keyed).join(undone, "run_id", "left")  # those without a run meet none, and would all go to one task
    alone = findings.where(~keyed).withColumn("undone", F.lit(None).cast("boolean"))
    return met.unionByName(alone).withColumn("label", label).withColumn("undone", taken_back)


def pattern_rollup(training: DataFrame) -> DataFrame:
    """Counts, mean scores and typical wording of each kind of finding."""
    keys = ("pattern_label", "input_kind", "rule_kind", "primitive")
    # in whole millionths, so that neither the order of rows nor the engine decides a tie
    mean = lambda c, name: F.expr(f"(2 * sum(bigint(round(double({c}) * 1000000))) + 1000 * count({c})) div nullif(2000 * count({c}), 0) / 1000.0d").alias(name)
    return training.where("pattern_label is not null").groupBy(*keys).agg(
        F.count("*").alias("findings"),
        F.count_if(F.col("label") == "good").alias("good"),
        F.count_if(F.col("label") == "bad").alias("bad"),
        F.count_if(F.col("label") == "rejected").alias("rejected"),
        F.count_if(F.coalesce("is_opportunity", F.lit(False))).alias("called_opportunity"),
        mean("ai_score", "avg_ai"),
        mean("typesafe_score", "avg_semantic"),
        mean("pattern_score", "avg_patterns"),
        mean("average", "avg_fit"),
        F.expr("mode() within group (order by rule_shape)").alias("typical_shape"),
        F.expr("mode() within group (order by why_generic)").alias("typical_why"),
        F.countDistinct("repo_id").alias("repos"),
        F.max("created_at").alias("last_seen"),
    )


_SQL_TRAINING = f"""
WITH f AS (SELECT DISTINCT lower(trim(id)) AS id, lower(trim(run_id)) AS run_id, lower(trim(repo_id)) AS repo_id, {", ".join(_FIELDS)} FROM findings),
u AS (SELECT DISTINCT lower(trim(run_id)) AS run_id FROM outcomes WHERE lower(trim(outcome)) = 'undone' AND trim(run_id) <> ''),
t AS (SELECT f.*, u.run_id IS NOT NULL AS undone,
  CASE WHEN result = 'changed' AND u.run_id IS NULL AND coalesce(checks_after_ok, false) THEN 'good'
       WHEN result = 'reverted' OR (result = 'changed' AND u.run_id IS NOT NULL) THEN 'bad'
       WHEN NOT is_opportunity OR verdict IN ('WEAK_FIT', 'NOT_OPPORTUNITY') THEN 'rejected' ELSE 'unknown' END AS label
  FROM f LEFT JOIN u ON f.run_id = u.run_id)
"""


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(distinct_findings(table(spark, sf_dir, "findings"), *_FIELDS), table(spark, sf_dir, "outcomes"))


@BOOK.add(_SQL_TRAINING + "SELECT id, run_id, undone, label FROM t")
def training_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training view."""
    return _training(spark, sf_dir).select("id", "run_id", "undone", "label")


@BOOK.add(
    _SQL_TRAINING
    + """SELECT pattern_label, input_kind, rule_kind, primitive, count(*) AS findings,
  count(*) FILTER (WHERE label = 'good') AS good, count(*) FILTER (WHERE label = 'bad') AS bad, count(*) FILTER (WHERE label = 'rejected') AS rejected,
  count(*) FILTER (WHERE is_opportunity) AS called_opportunity,
  (2 * sum(CAST(round(CAST(ai_score AS DOUBLE) * 1000000) AS BIGINT)) + 1000 * count(ai_score)) // nullif(2000 * count(ai_score), 0) / 1000.0 AS avg_ai,
  (2 * sum(CAST(round(CAST(typesafe_score AS DOUBLE) * 1000000) AS BIGINT)) + 1000 * count(typesafe_score)) // nullif(2000 * count(typesafe_score), 0) / 1000.0 AS avg_semantic,
  (2 * sum(CAST(round(CAST(pattern_score AS DOUBLE) * 1000000) AS BIGINT)) + 1000 * count(pattern_score)) // nullif(2000 * count(pattern_score), 0) / 1000.0 AS avg_patterns,
  (2 * sum(CAST(round(CAST(average AS DOUBLE) * 1000000) AS BIGINT)) + 1000 * count(average)) // nullif(2000 * count(average), 0) / 1000.0 AS avg_fit,
  mode(rule_shape ORDER BY rule_shape) AS typical_shape, mode(why_generic ORDER BY why_generic) AS typical_why,
  count(DISTINCT repo_id) AS repos, max(created_at) AS last_seen
FROM t WHERE pattern_label IS NOT NULL GROUP BY ALL"""
)
def outcome_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern roll-up of the training view."""
    return pattern_rollup(_training(spark, sf_dir))
