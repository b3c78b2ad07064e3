"""Evidence, accounting and report queries over contrasts, usages and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import iso_ts, key_or_null, latest, norm_key, table
from tessera.functions.scores import PROFILE
from tessera.operators import evidence as ev
from tessera.plans.registry import Book

BOOK = Book()
FEATURES = list(PROFILE)

_C = """WITH c AS (SELECT lower(trim(contrast.id)) AS id, any_value(lower(trim(project))) AS project, any_value(nullif(lower(trim("siteId")), '')) AS site, any_value(facts) AS facts, any_value(usable) AS usable, any_value(visibility) AS visibility FROM contrasts GROUP BY 1)"""
_SIDES = _C + ", s AS (SELECT id, project, CASE WHEN facts.nature = 'judgment' THEN 'judged' ELSE 'exact' END AS side, facts FROM c WHERE usable AND facts.is_a_real_decision AND facts.nature IN ('judgment', 'rule'))"
_LONG = ", l AS (" + " UNION ALL ".join(f"SELECT id, project, side, '{f}' AS feature, facts.features.{f} AS value FROM s" for f in FEATURES) + "), k AS (SELECT * FROM l WHERE value <> '' AND value <> 'unknown')"


def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contrast: rows with one id are copies."""
    rows = table(spark, sf_dir, "contrasts").select(key_or_null("contrast.id").alias("id"), key_or_null("project").alias("project"), key_or_null("siteId").alias("site"), "facts", "usable", "visibility")
    return rows.where("id is not null").groupBy("id").agg(*[F.any_value(c).alias(c) for c in ("project", "site", "facts", "usable", "visibility")])


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contrasts(spark, sf_dir).where("usable and facts.is_a_real_decision").where(F.col("facts.nature").isin("judgment", "rule"))
    return c.withColumn("side", F.when(F.col("facts.nature") == "judgment", "judged").otherwise("exact"))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.long_form(_sides(spark, sf_dir), F.col("facts.features"), FEATURES)


@BOOK.add(_SIDES + _LONG + "SELECT feature, side, value, count(*) AS n FROM k GROUP BY ALL")
def evidence_counts(spark, sf_dir):
    """A06"""
    return ev.value_counts(_long(spark, sf_dir)).select("feature", "side", "value", "n")


_GROUPS = (
    _SIDES
    + _LONG
    + """, n AS (SELECT feature, side, value, count(*) AS n FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY feature, side ORDER BY n DESC, value) AS rk FROM n),
t AS (SELECT feature, max(value) FILTER (WHERE side = 'judged' AND rk = 1) AS t1, max(n) FILTER (WHERE side = 'judged' AND rk = 1) AS c1, max(value) FILTER (WHERE side = 'exact' AND rk = 1) AS t2 FROM r GROUP BY feature),
z AS (SELECT feature, count(*) FILTER (WHERE side = 'judged') AS n1, count(*) FILTER (WHERE side = 'exact') AS n2, count(*) AS records, count(DISTINCT project) AS projects FROM k GROUP BY feature),
x AS (SELECT n.feature, CAST(sum(n) AS BIGINT) AS ce FROM n JOIN t USING (feature) WHERE t1 <> t2 AND ((side = 'exact' AND value = t1) OR (side = 'judged' AND value = t2)) GROUP BY 1),
g AS (SELECT z.feature, n1 AS n_one, n2 AS n_other, t1 AS top_one, t2 AS top_other, CASE WHEN n2 = 0 THEN 'one_side_only' WHEN t1 = t2 THEN 'no_separation' WHEN coalesce(ce, 0) > 0 THEN 'contested' ELSE 'separates' END AS direction, coalesce(ce, 0) AS counter_examples, projects,
  CASE WHEN projects >= 2 THEN 'cross_project' WHEN records >= 2 THEN 'recurring_in_one_project' ELSE 'single_example' END AS strength,
  CASE WHEN n2 = 0 THEN 'low' WHEN coalesce(ce, 0) > 0 THEN CASE WHEN projects >= 3 THEN 'medium' ELSE 'low' END WHEN projects >= 3 THEN 'high' WHEN projects >= 2 THEN 'medium' ELSE 'low' END AS confidence, c1 = n1 AND n1 > 1 AS uniform
  FROM z JOIN t USING (feature) LEFT JOIN x USING (feature) WHERE n1 > 0)
"""
)


@BOOK.add(_GROUPS + "SELECT * FROM g")
def evidence_groups(spark, sf_dir):
    """A07, A12"""
    return ev.groups(_long(spark, sf_dir), "judged", "exact")


@BOOK.add(_GROUPS + ", o AS (SELECT feature, direction, row_number() OVER (ORDER BY list_position(['separates', 'contested', 'one_side_only', 'no_separation'], direction), projects DESC, feature) AS position FROM g) SELECT *, (position - 1) // 4 AS batch FROM o")
def evidence_batches(spark, sf_dir):
    """T11"""
    return ev.ordered_batches(ev.groups(_long(spark, sf_dir), "judged", "exact"), 4).select("feature", "direction", "position", "batch")


@BOOK.add(_GROUPS + "SELECT g.feature, g.top_one, g.top_other, map_from_entries(list({'k': n.value, 'v': n.n} ORDER BY n.value) FILTER (WHERE n.side = 'judged')) AS judged, map_from_entries(list({'k': n.value, 'v': n.n} ORDER BY n.value) FILTER (WHERE n.side = 'exact')) AS exact FROM g JOIN n USING (feature) WHERE direction IN ('separates', 'contested') GROUP BY ALL")
def profile_export(spark, sf_dir):
    """Level counts per side of the features that separate."""
    rows = _long(spark, sf_dir)
    g = ev.groups(rows, "judged", "exact").where(F.col("direction").isin("separates", "contested")).select("feature", "top_one", "top_other")
    n = ev.value_counts(rows)
    side = lambda s: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("value", "n"))))).alias(s)
    return g.join(n.groupBy("feature").agg(side("judged"), side("exact")), "feature")


@BOOK.add(_C + "SELECT facts.nature AS nature, count(*) AS records, count(*) FILTER (WHERE facts.shares_jev_site_traits <> 'none') AS sharing, count(*) FILTER (WHERE facts.is_a_real_decision) AS decisions, count(DISTINCT project) AS projects FROM c WHERE usable GROUP BY 1")
def nature_groups(spark, sf_dir):
    """What kind of code the contrasts are."""
    c = contrasts(spark, sf_dir).where("usable")
    return c.groupBy(F.col("facts.nature").alias("nature")).agg(F.count("*").alias("records"), F.count_if(F.col("facts.shares_jev_site_traits") != "none").alias("sharing"), F.count_if("facts.is_a_real_decision").alias("decisions"), F.countDistinct("project").alias("projects"))


@BOOK.add(_SIDES + _LONG + """, n AS (SELECT feature, side, value, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT feature, side, value FROM n QUALIFY row_number() OVER (PARTITION BY feature, side ORDER BY n DESC, value) = 1),
x AS (SELECT k.id, k.feature FROM k JOIN t ON t.feature = k.feature AND t.side <> k.side AND t.value = k.value JOIN t o ON o.feature = k.feature AND o.side = k.side WHERE o.value <> t.value)
SELECT id, count(DISTINCT feature) AS times FROM x GROUP BY id HAVING count(DISTINCT feature) >= 3""")
def repeated_counterexamples(spark, sf_dir):
    """Records that contradict three groups or more."""
    rows = _long(spark, sf_dir)
    top = ev.value_counts(rows).where("rank = 1").select("feature", F.col("side").alias("s"), F.col("value").alias("v"))
    tops = top.groupBy("feature").pivot("s", ["judged", "exact"]).agg(F.first("v"))
    mine, theirs = (F.when(F.col("side") == "judged", F.col(a)).otherwise(F.col(b)) for a, b in (("judged", "exact"), ("exact", "judged")))
    hit = rows.join(tops, "feature").where((F.col("value") == theirs) & (mine != theirs))
    return hit.groupBy("id").agg(F.countDistinct("feature").alias("times")).where("times >= 3")


@BOOK.add(_SIDES + _LONG + "PIVOT k ON value IN ('high', 'medium', 'low', 'none') USING count(id) GROUP BY feature, side".replace("PIVOT k", "SELECT feature, side, high, medium, low, \"none\" FROM (PIVOT k").replace("GROUP BY feature, side", "GROUP BY feature, side)"))
def level_distribution(spark, sf_dir):
    """Levels in a fixed order."""
    return _long(spark, sf_dir).groupBy("feature", "side").pivot("value", ["high", "medium", "low", "none"]).agg(F.countDistinct("id")).na.fill(0)


_U = """WITH u AS (SELECT lower(trim(project)) AS project, lower(trim(site.id)) AS site, arg_max(site, CAST("at" AS TIMESTAMPTZ)) AS s FROM usages GROUP BY 1, 2), c AS (SELECT lower(trim(contrast.id)) AS id, any_value(lower(trim(project))) AS project, any_value(lower(trim("siteId"))) AS site, any_value(facts.is_a_real_decision AND usable) AS good FROM contrasts GROUP BY 1)"""


def usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest report of each usage: `project`, `site_id` and the struct `site`."""
    rows = table(spark, sf_dir, "usages").select(key_or_null("project").alias("project"), key_or_null("site.id").alias("site_id"), iso_ts("at").alias("ts"), "site").where("project is not null and site_id is not null")
    return rows.groupBy("project", "site_id").agg(F.max_by("site", "ts").alias("site"))


@BOOK.add(_U + "SELECT count(*) AS sites, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM c WHERE c.project = u.project AND c.site = u.site)) AS with_any, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM c WHERE c.project = u.project AND c.site = u.site AND good)) AS with_meaningful, count(*) FILTER (WHERE s.tier = 'uncertain') AS uncertain, count(*) FILTER (WHERE s.role = 'wrapper') AS wrappers FROM u")
def report_figures(spark, sf_dir):
    """Usages with any contrast, with a meaningful one, and the rest."""
    u = usages(spark, sf_dir)
    c = contrasts(spark, sf_dir).where("site is not null").groupBy("project", F.col("site").alias("site_id")).agg(F.bool_or(F.col("facts.is_a_real_decision") & F.col("usable")).alias("good"))
    j = u.join(c.withColumn("any", F.lit(True)), ["project", "site_id"], "left")
    return j.agg(F.count("*").alias("sites"), F.count_if(F.coalesce("any", F.lit(False))).alias("with_any"), F.count_if(F.coalesce("good", F.lit(False))).alias("with_meaningful"), F.count_if(F.col("site.tier") == "uncertain").alias("uncertain"), F.count_if(F.col("site.role") == "wrapper").alias("wrappers"))


@BOOK.add(_U + "SELECT project, site AS site_id FROM u WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.project = u.project AND c.site = u.site)")
def sites_without_contrast(spark, sf_dir):
    """Usages that no contrast refers to."""
    c = contrasts(spark, sf_dir).select("project", F.col("site").alias("site_id")).where("site_id is not null")
    return usages(spark, sf_dir).join(c, ["project", "site_id"], "left_anti").select("project", "site_id")


@BOOK.add(_U + "SELECT project, min(list_position(['certain', 'likely', 'uncertain'], s.tier)) AS rank, ['certain', 'likely', 'uncertain'][min(list_position(['certain', 'likely', 'uncertain'], s.tier))] AS tier FROM u GROUP BY project")
def best_tier(spark, sf_dir):
    """The best tier of each project."""
    tiers = F.array(*map(F.lit, ("certain", "likely", "uncertain")))
    return usages(spark, sf_dir).groupBy("project").agg(F.min(F.array_position(tiers, F.col("site.tier"))).alias("rank")).select("project", "rank", F.element_at(tiers, F.col("rank").cast("int")).alias("tier"))


_R = """WITH r AS (SELECT lower(trim("runId")) AS id, arg_max(lower(trim(project)), CAST("at" AS TIMESTAMPTZ)) AS project, arg_max(accounting, CAST("at" AS TIMESTAMPTZ)) AS a, arg_max(usages, CAST("at" AS TIMESTAMPTZ)) AS u, max(CAST("at" AS TIMESTAMPTZ)) AS ts FROM runs GROUP BY 1)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest report of each run: `run_id`, `ts`, `project`, `accounting`, `usages`."""
    held = latest(table(spark, sf_dir, "runs"), key_or_null("runId"), iso_ts("at"), ["project", "accounting", "usages"])
    return held.select(F.col("key").alias("run_id"), F.col("at").alias("ts"), norm_key("project").alias("project"), "accounting", "usages")


@BOOK.add(_R + """SELECT project, count(*) AS runs, CAST(sum(a.calls) AS BIGINT) AS calls, CAST(sum(a.rounds) AS BIGINT) AS rounds, CAST(sum(a.retries) AS BIGINT) AS retries, CAST(sum(a."inputTokens") AS BIGINT) AS input_tokens, CAST(sum(a."outputTokens") AS BIGINT) AS output_tokens,
round(coalesce(sum(a."costUsd"), 0), 6) AS cost, bool_and(a.calls = 0 OR a."costUsd" IS NOT NULL) AS cost_known, CASE WHEN count(DISTINCT a."costSource") > 1 THEN 'mixed' ELSE max(a."costSource") END AS source_report, CASE WHEN count(DISTINCT a."costSource") > 1 THEN 'calculated' ELSE max(a."costSource") END AS source_run FROM r GROUP BY project""")
def accounting(spark, sf_dir):
    """Totals per project. Two rules for mixed sources: a report says mixed, a run says calculated."""
    a = lambda c: F.col(f"accounting.{c}")
    several = F.countDistinct(a("costSource")) > 1
    return runs(spark, sf_dir).groupBy("project").agg(
        F.count("*").alias("runs"), F.sum(a("calls")).alias("calls"), F.sum(a("rounds")).alias("rounds"), F.sum(a("retries")).alias("retries"), F.sum(a("inputTokens")).alias("input_tokens"), F.sum(a("outputTokens")).alias("output_tokens"), F.round(F.coalesce(F.sum(a("costUsd")), F.lit(0.0)), 6).alias("cost"),
        F.bool_and((a("calls") == 0) | a("costUsd").isNotNull()).alias("cost_known"), F.when(several, "mixed").otherwise(F.max(a("costSource"))).alias("source_report"), F.when(several, "calculated").otherwise(F.max(a("costSource"))).alias("source_run"),
    )


@BOOK.add(_R + """SELECT project, id AS run_id, CAST(coalesce(sum(CAST(round(coalesce(a."costUsd", 0) * 1000000) AS BIGINT)) OVER w, 0) AS BIGINT) AS spent, coalesce(sum(CAST(round(coalesce(a."costUsd", 0) * 1000000) AS BIGINT)) OVER w, 0) < 200000 AS run FROM r WINDOW w AS (PARTITION BY project ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def budget_gate(spark, sf_dir):
    """Runs of a project start while what was spent before them is below 0.2, in millionths."""
    from tessera.operators.datasets import budget_gate as gate

    cost = F.round(F.coalesce("accounting.costUsd", F.lit(0.0)) * 1000000).cast("long")
    rows = runs(spark, sf_dir).select("project", "run_id", "ts", cost.alias("cost"))
    return gate(rows, ["project"], [F.col("ts"), F.col("run_id")], F.col("cost"), 200000).select("project", "run_id", F.col("spent").cast("long").alias("spent"), "run")


@BOOK.add(_R + "SELECT project, arg_max(id, (ts, id)) AS run_id, make_timestamp(epoch_us(max(ts))) AS ts, CAST(sum(u.failed) AS BIGINT) AS failed, CAST(sum(u.found) AS BIGINT) AS found FROM r GROUP BY project")
def latest_runs(spark, sf_dir):
    """The last run of each project and what all of them found."""
    return runs(spark, sf_dir).groupBy("project").agg(F.max_by("run_id", F.struct("ts", "run_id")).alias("run_id"), F.max("ts").cast("timestamp_ntz").alias("ts"), F.sum("usages.failed").alias("failed"), F.sum("usages.found").alias("found"))
