"""Queries of problem 5: findings and outcomes refer to runs, contrasts to usages of their project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import iso_ts, key_or_null, norm_key, table
from tessera.operators import references as op
from tessera.plans.registry import Book

BOOK = Book()


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda *parts: op.target_key(*parts)
    runs = table(spark, sf_dir, "runs").select(key(F.lit("runs"), F.lit(""), key_or_null("runId")).alias("key"), iso_ts("at").alias("ts"))
    usages = table(spark, sf_dir, "usages").select(key(F.lit("usages"), key_or_null("project"), key_or_null("site.id")).alias("key"), iso_ts("at").alias("ts"))
    gone = table(spark, sf_dir, "removals")
    kind = norm_key("target_table")
    removed = gone.select(key(kind, F.when(kind == "runs", F.lit("")).otherwise(key_or_null("project")), key_or_null("target_key")).alias("key"), F.col("removed_at").alias("ts"))
    return op.changes(runs.unionByName(usages), removed)


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_table, ref_field, ref_id, ts, key: one row per referring record; of copies with different times the first holds."""

    def of(name: str, field: str, id_col: str, ts, key) -> DataFrame:
        rows = table(spark, sf_dir, name).select(key_or_null(id_col).alias("ref_id"), ts.alias("ts"), key.alias("key")).where("ref_id is not null")
        one = rows.groupBy("ref_id").agg(F.min(F.struct(F.col("key").isNull(), "ts", "key")).alias("r"))
        return one.select(F.lit(name).alias("ref_table"), F.lit(field).alias("ref_field"), "ref_id", "r.ts", "r.key")

    run = op.target_key(F.lit("runs"), F.lit(""), key_or_null("run_id"))
    site = op.target_key(F.lit("usages"), F.coalesce(key_or_null("project"), F.lit("")), key_or_null("siteId"))
    return of("findings", "run_id", "id", F.col("created_at"), run).unionByName(of("outcomes", "run_id", "id", F.col("created_at"), run)).unionByName(of("contrasts", "siteId", "contrast.id", iso_ts("at"), site))


_SQL = """
WITH ev AS (
  SELECT 'runs||' || lower(trim("runId")) AS k, epoch_us(CAST("at" AS TIMESTAMPTZ)) AS ts, 1 AS s FROM runs
  UNION ALL SELECT 'usages|' || lower(trim(project)) || '|' || lower(trim(site.id)), epoch_us(CAST("at" AS TIMESTAMPTZ)), 1 FROM usages
  UNION ALL SELECT lower(trim(target_table)) || '|' || CASE WHEN lower(trim(target_table)) = 'runs' THEN '' ELSE lower(trim(project)) END || '|' || lower(trim(target_key)), epoch_us(removed_at), 0 FROM removals),
e AS (SELECT k, ts, min(s) AS s FROM ev WHERE k IS NOT NULL AND ts IS NOT NULL GROUP BY k, ts),
r AS (
  SELECT 'findings' AS ref_table, 'run_id' AS ref_field, lower(trim(id)) AS ref_id, min(epoch_us(created_at)) AS ts, min('runs||' || lower(trim(run_id))) AS k FROM findings WHERE trim(run_id) <> '' GROUP BY 3
  UNION ALL SELECT 'outcomes', 'run_id', lower(trim(id)), min(epoch_us(created_at)), min('runs||' || lower(trim(run_id))) FROM outcomes WHERE trim(run_id) <> '' GROUP BY 3
  UNION ALL SELECT 'contrasts', 'siteId', lower(trim(contrast.id)), min(epoch_us(CAST("at" AS TIMESTAMPTZ))), min('usages|' || coalesce(lower(trim(project)), '') || '|' || lower(trim("siteId"))) FROM contrasts WHERE trim("siteId") <> '' GROUP BY 3),
st AS (SELECT r.ref_table, r.ref_field, r.ref_id, any_value(r.ts) AS ts, coalesce(arg_max(e.s, e.ts), 0) AS s FROM r LEFT JOIN e ON e.k = r.k AND e.ts <= r.ts GROUP BY 1, 2, 3)
"""


@BOOK.add(_SQL + "SELECT ref_table, ref_field, ref_id FROM st WHERE s = 0")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.orphans(_references(spark, sf_dir), _changes(spark, sf_dir)).where("orphan").select("ref_table", "ref_field", "ref_id")


@BOOK.add(_SQL + "SELECT ref_table, ref_field, strftime(make_timestamp(ts), '%Y-%m') AS month, count(*) AS refs, count(*) FILTER (WHERE s = 0) AS orphans FROM st GROUP BY ALL")
def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and orphans per table, field and month."""
    judged = op.orphans(_references(spark, sf_dir), _changes(spark, sf_dir))
    return judged.groupBy("ref_table", "ref_field", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("refs"), F.count_if("orphan").alias("orphans"))


@BOOK.add(
    _SQL
    + """, now AS (SELECT k, arg_max(s, ts) AS s FROM e GROUP BY k), refs AS (SELECT k, count(*) AS n FROM r GROUP BY k)
SELECT split_part(refs.k, '|', 1) AS target_table, count(*) AS missing_keys, CAST(sum(n) AS BIGINT) AS refs FROM refs LEFT JOIN now USING (k) WHERE coalesce(now.s, 0) = 0 GROUP BY 1"""
)
def p5_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are referred to and don't stand now, with their references, per target table."""
    now = op.standing(_references(spark, sf_dir), _changes(spark, sf_dir)).where("refs > 0 and existence = 0")
    return now.groupBy(F.split("key", "\0")[0].alias("target_table")).agg(F.count("*").alias("missing_keys"), F.sum("refs").alias("refs"))
