"""Reports, and groups of evidence about what was supposed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import iso_ts, key_or_null, table
from tessera.functions import text
from tessera.operators import evidence as ev
from tessera.plans.datasets import CURRENT, entries
from tessera.plans.evidence import contrasts
from tessera.plans.registry import Book
from tessera.sources import files

BOOK = Book()

_SUPPOSED = (
    CURRENT
    + """, s AS (SELECT id, project, 'label ' || auto.label AS supposed, CASE WHEN human.label IS NULL THEN 'not_determinable' WHEN human.label = auto.label THEN 'supported' ELSE 'contradicted' END AS found FROM e WHERE auto.label IS NOT NULL
UNION ALL SELECT id, project, 'primitive ' || "suggestedPrimitive", CASE WHEN human.primitive IS NULL THEN 'not_determinable' WHEN human.primitive = "suggestedPrimitive" THEN 'supported' ELSE 'contradicted' END FROM e WHERE "suggestedPrimitive" IS NOT NULL),
g AS (SELECT supposed, count(*) AS records, count(*) FILTER (WHERE found = 'supported') AS supported, count(*) FILTER (WHERE found = 'contradicted') AS contradicted, count(DISTINCT project) FILTER (WHERE found = 'supported') AS projects FROM s GROUP BY 1)
"""
)


def _supposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`id, project, supposed, found`: what was supposed of each entry, and whether people found it so."""
    e = entries(spark, sf_dir, "auto", "human", "suggestedPrimitive")

    def against(name: str, guess: Column, truth: Column) -> DataFrame:
        found = F.when(truth.isNull(), "not_determinable").when(truth == guess, "supported").otherwise("contradicted")
        return e.where(guess.isNotNull()).select("id", "project", F.concat(F.lit(f"{name} "), guess).alias("supposed"), found.alias("found"))

    return against("label", F.col("auto.label"), F.col("human.label")).unionByName(against("primitive", F.col("suggestedPrimitive"), F.col("human.primitive")))


@BOOK.add(
    _SUPPOSED
    + """SELECT supposed, records, supported, contradicted, projects, 'one_side_only' AS direction, CASE WHEN projects >= 2 THEN 'cross_project' WHEN supported >= 2 THEN 'recurring_in_one_project' ELSE 'single_example' END AS strength, 'low' AS confidence,
contradicted > 0 AS contested, supported = records AND records >= 5 AS uniform FROM g WHERE supported >= 1"""
)
def hypothesis_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was supposed and is supported at least once. It is one-sided, so it separates nothing and confidence is low."""
    return ev.supposed_groups(_supposed(spark, sf_dir)).where("supported >= 1").drop("why")


@BOOK.add(_SUPPOSED + "SELECT supposed, records, supported, contradicted, 'contradicted at ' || contradicted || ' of ' || records || CASE WHEN supported > 0 THEN ', supported at ' || supported ELSE ', supported at none' END AS why FROM g WHERE contradicted > supported")
def rejected_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: what was supposed and is more often contradicted than supported."""
    return ev.supposed_groups(_supposed(spark, sf_dir)).where("contradicted > supported").select("supposed", "records", "supported", "contradicted", "why")


@BOOK.add(
    """WITH c AS (SELECT lower(trim(contrast.id)) AS id, any_value(facts) AS f FROM contrasts WHERE trim(contrast.id) <> '' GROUP BY 1),
k AS (SELECT id, 1 AS n, 'still called a judgment' AS why FROM c WHERE f.nature = 'judgment' UNION ALL SELECT id, 2, 'called a rule without confidence' FROM c WHERE f.nature = 'rule' AND f.confidence = 'low' UNION ALL SELECT id, 3, 'shares traits: ' || f.shares_jev_site_traits FROM c WHERE f.shares_jev_site_traits IN ('some', 'most'))
SELECT id, min(n) AS first, arg_max(why, n) AS why FROM k GROUP BY id"""
)
def nature_counterexamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of counter-examples as one list: each record once, where it first stands, with the last reason given for it."""
    c = contrasts(spark, sf_dir)
    nature, traits = F.col("facts.nature"), F.col("facts.shares_jev_site_traits")
    kinds = (
        (nature == "judgment", F.lit("still called a judgment")),
        ((nature == "rule") & (F.col("facts.confidence") == "low"), F.lit("called a rule without confidence")),
        (traits.isin("some", "most"), F.concat(F.lit("shares traits: "), traits)),
    )
    rows = reduce(DataFrame.unionByName, [c.where(test).select("id", F.lit(n).alias("n"), why.alias("why")) for n, (test, why) in enumerate(kinds, 1)])
    return rows.groupBy("id").agg(F.min("n").alias("first"), F.max_by("why", "n").alias("why"))


def pilot_report(runs: DataFrame, since: str | None = None) -> DataFrame:
    """Per project the sums of its stored runs, from a time on if one is given: calls, tokens, cost where all of it is known, and what was found, analyzed and failed."""
    at = iso_ts("at")
    rows = runs.where(at >= F.lit(since).cast("timestamp")) if since else runs
    one = rows.select(key_or_null("runId").alias("id"), key_or_null("project").alias("project"), at.alias("ts"), "usages", "contrasts", "accounting", F.size("errors").alias("errors")).where("id is not null")
    last = one.groupBy("id").agg(F.max_by(F.struct("project", "usages", "contrasts", "accounting", "errors"), "ts").alias("r")).select("r.*")
    total = lambda c: F.sum(c).alias(c.split(".")[0][0] + "_" + c.split(".")[1] if not c.startswith("accounting") else c.split(".")[1])
    names = ("usages.found", "usages.analyzed", "usages.failed", "contrasts.selected", "contrasts.analyzed", "contrasts.failed", "accounting.calls", "accounting.retries", "accounting.inputTokens", "accounting.outputTokens")
    known = F.count("accounting.costUsd") == F.count("*")
    return last.groupBy("project").agg(F.count("*").alias("runs"), *map(total, names), F.when(known, F.round(F.sum("accounting.costUsd"), 6)).alias("cost"), F.sum(F.greatest("errors", F.lit(0))).alias("errors"))


@BOOK.add(
    """WITH r AS (SELECT lower(trim("runId")) AS id, arg_max(struct_pack(p := nullif(lower(trim(project)), ''), u := usages, c := contrasts, a := accounting, e := coalesce(len(errors), 0)), CAST("at" AS TIMESTAMPTZ)) AS r FROM runs WHERE trim("runId") <> '' GROUP BY 1)
SELECT r.p AS project, count(*) AS runs, CAST(sum(r.u.found) AS BIGINT) AS u_found, CAST(sum(r.u.analyzed) AS BIGINT) AS u_analyzed, CAST(sum(r.u.failed) AS BIGINT) AS u_failed, CAST(sum(r.c.selected) AS BIGINT) AS c_selected, CAST(sum(r.c.analyzed) AS BIGINT) AS c_analyzed,
CAST(sum(r.c.failed) AS BIGINT) AS c_failed, CAST(sum(r.a.calls) AS BIGINT) AS calls, CAST(sum(r.a.retries) AS BIGINT) AS retries, CAST(sum(r.a."inputTokens") AS BIGINT) AS "inputTokens", CAST(sum(r.a."outputTokens") AS BIGINT) AS "outputTokens",
CASE WHEN count(r.a."costUsd") = count(*) THEN round(sum(r.a."costUsd"), 6) END AS cost, CAST(sum(r.e) AS BIGINT) AS errors FROM r GROUP BY 1"""
)
def pilot_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK07, A13: the report over all stored runs."""
    return pilot_report(table(spark, sf_dir, "runs"))


_WORDS = r"(?i)\b(classif|decid|judg|scor|route|triage)"


@BOOK.add(
    r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, len(l) AS n, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '(?i)\b(classif|decid|judg|scor|route|triage)')) AS h FROM d),
k AS (SELECT doc_id, n, unnest(list_reduce(list_transform(h, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] > 30 THEN list_concat(a, x) ELSE a END)) AS line FROM h WHERE len(h) > 0)
SELECT doc_id, line, greatest(1, line - 30) AS start, least(n, line + 30) AS "end" FROM k"""
)
def keyword_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10, W09: thirty lines around each line with a word of judging, of those farther than that from the last one kept."""
    lines = F.split("text", "\n")
    hits = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(_WORDS), (i + 1).cast("long"))), lambda x: x.isNotNull())
    kept = F.aggregate(hits, F.array().cast("array<bigint>"), lambda a, h: F.when((F.size(a) == 0) | (h - F.element_at(a, -1) > 30), F.concat(a, F.array(h))).otherwise(a))
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(lines).cast("long").alias("n"), F.explode(kept).alias("line"))
    return d.select("doc_id", "line", F.greatest(F.lit(1).cast("long"), F.col("line") - 30).alias("start"), F.least("n", F.col("line") + 30).alias("end"))


@BOOK.add(
    CURRENT
    + r""", t AS (SELECT id, list_distinct(list_filter(flatten(list_transform(outputs.values, lambda v: string_split(lower(v), '-'))), lambda x: x <> '')) AS terms,
list_distinct(flatten(list_transform(list_concat([unit.name], list_transform(inputs, lambda i: i.name)), lambda n: list_filter(string_split_regex(lower(regexp_replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')))) AS code FROM e WHERE outputs.values IS NOT NULL AND unit.name IS NOT NULL AND inputs IS NOT NULL),
c AS (SELECT id, len(terms) AS terms, len(list_intersect(terms, code)) AS shared FROM t)
SELECT id, terms, shared, terms >= 3 AND shared >= 0.5 * terms AS of_code FROM c"""
)
def vocabulary_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the words of an entry's outcomes those that its code uses as names; of three words or more with half of them such the entry is about code."""
    e = entries(spark, sf_dir, "outputs", "unit", "inputs").where("outputs.values is not null and unit.name is not null and inputs is not null")
    terms = F.array_distinct(F.filter(F.flatten(F.transform("outputs.values", lambda v: F.split(F.lower(v), "-"))), lambda x: x != ""))
    code = F.array_distinct(F.flatten(F.transform(F.concat(F.array("unit.name"), F.col("inputs.name")), lambda n: text.name_tokens(n))))
    c = e.select("id", F.size(terms).cast("long").alias("terms"), F.size(F.array_intersect(terms, code)).cast("long").alias("shared"))
    return c.withColumn("of_code", (F.col("terms") >= 3) & (F.col("shared") >= 0.5 * F.col("terms")))


@BOOK.add(
    """WITH p AS (SELECT lower(trim(slug)) AS slug, arg_max(list_concat(frameworks, ['@nestjs/core', 'ai', 'left-pad']), CAST(updated AS TIMESTAMPTZ)) AS d FROM project_records WHERE trim(slug) <> '' AND frameworks IS NOT NULL GROUP BY 1),
known(d, f) AS (VALUES ('next', 'next'), ('react', 'react'), ('react-native', 'react-native'), ('vue', 'vue'), ('nuxt', 'nuxt'), ('svelte', 'svelte'), ('@sveltejs/kit', 'sveltekit'), ('@angular/core', 'angular'), ('express', 'express'), ('fastify', 'fastify'), ('koa', 'koa'), ('hono', 'hono'),
 ('@nestjs/core', 'nestjs'), ('electron', 'electron'), ('expo', 'expo'), ('discord.js', 'discord.js'), ('telegraf', 'telegraf'), ('langchain', 'langchain'), ('ai', 'vercel-ai'), ('openai', 'openai'), ('@anthropic-ai/sdk', 'anthropic'))
SELECT slug, list_sort(list(DISTINCT f)) AS frameworks FROM (SELECT slug, unnest(d) AS d FROM p) JOIN known USING (d) GROUP BY slug"""
)
def framework_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12: the frameworks that stand behind what a project depends on, here what its record lists and three packages more."""
    p = table(spark, sf_dir, "project_records").where("frameworks is not null").groupBy(key_or_null("slug").alias("slug")).agg(F.max_by("frameworks", iso_ts("updated")).alias("d")).where("slug is not null")
    more = F.array(*map(F.lit, ("@nestjs/core", "ai", "left-pad")))
    packages = p.select("slug", F.map_from_entries(F.transform(F.array_distinct(F.concat("d", more)), lambda n: F.struct(n, F.lit("*")))).alias("dependencies"))
    return files.frameworks(packages, ["dependencies"]).select("slug", "frameworks")
