"""Lookups, exclusions and projections between the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import iso_ts, key_or_null, norm_key, table
from tessera.functions import paths
from tessera.plans.datasets import CURRENT, entries, findings, projects
from tessera.plans.evidence import _C, _R, _U, contrasts, runs, usages
from tessera.plans.registry import Book
from tessera.plans.texts import _case

BOOK = Book()


@BOOK.add(CURRENT + _C.replace("WITH c AS", ", c AS") + "SELECT c.id, c.project FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.slug = c.project AND p.split = 'test')")
def outside_test(spark, sf_dir):
    """Contrasts without those of test projects, for deriving patterns."""
    held = projects(spark, sf_dir).where("split = 'test'").select(F.col("slug").alias("project"))
    return contrasts(spark, sf_dir).select("id", "project").join(held, "project", "left_anti")


@BOOK.add(CURRENT + """SELECT entry_id, arg_min(prompt_id, (ts, prompt_id)) AS prompt_id, count(*) AS prompts FROM (SELECT DISTINCT lower(trim("entryId")) AS entry_id, lower(trim("promptId")) AS prompt_id, CAST("at" AS TIMESTAMPTZ) AS ts FROM gemini_prompts) g WHERE EXISTS (SELECT 1 FROM e WHERE e.id = g.entry_id) GROUP BY entry_id""")
def first_prompts(spark, sf_dir):
    """Of the prompts of known entries the first of each; the others only count."""
    g = table(spark, sf_dir, "gemini_prompts").select(key_or_null("entryId").alias("entry_id"), key_or_null("promptId").alias("prompt_id"), iso_ts("at").alias("ts")).distinct()
    known = entries(spark, sf_dir).select(F.col("id").alias("entry_id"))
    return g.join(known, "entry_id", "left_semi").groupBy("entry_id").agg(F.min_by("prompt_id", F.struct("ts", "prompt_id")).alias("prompt_id"), F.count("*").alias("prompts"))


@BOOK.add("WITH f AS (SELECT DISTINCT ON (lower(trim(id))) * FROM findings), k AS (SELECT rule_kind, count(*) AS findings, count(DISTINCT lower(trim(repo_id))) AS repos FROM f WHERE rule_kind IS NOT NULL GROUP BY 1) SELECT lower(trim(f.id)) AS id, coalesce(k.findings, 0) AS findings, coalesce(k.repos, 0) AS repos FROM f LEFT JOIN k USING (rule_kind)")
def rule_popularity(spark, sf_dir):
    """How many findings and repositories show the rule of a finding. There are a few rules; counts are looked up."""
    f = findings(spark, sf_dir, "rule_kind", "repo_id")
    k = f.where("rule_kind is not null").groupBy("rule_kind").agg(F.count("*").alias("findings"), F.countDistinct(norm_key("repo_id")).alias("repos"))
    return f.select("id", "rule_kind").join(k, "rule_kind", "left").select("id", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("repos", F.lit(0)).alias("repos"))


@BOOK.add(_R + """, w AS (SELECT project, count(*) AS answered FROM (SELECT DISTINCT lower(trim(contrast.id)) AS id, lower(trim(project)) AS project FROM contrasts) GROUP BY 1), q AS (SELECT project, CAST(sum(u.analyzed) AS BIGINT) AS analyzed, CAST(sum(u.failed) AS BIGINT) AS failed FROM r GROUP BY project) SELECT q.project, analyzed, failed, coalesce(answered, 0) AS answered FROM q LEFT JOIN w USING (project)""")
def answers(spark, sf_dir):
    """What runs asked and what came of it, per project; missing answers are none."""
    q = runs(spark, sf_dir).groupBy("project").agg(F.sum("usages.analyzed").alias("analyzed"), F.sum("usages.failed").alias("failed"))
    w = contrasts(spark, sf_dir).groupBy("project").agg(F.count("*").alias("answered"))
    return q.join(w, "project", "left").select("project", "analyzed", "failed", F.coalesce("answered", F.lit(0)).alias("answered"))


@BOOK.add("WITH f AS (SELECT DISTINCT ON (lower(trim(id))) lower(trim(id)) AS id, lower(trim(run_id)) AS run_id, result FROM findings) SELECT run_id, count(*) FILTER (WHERE result = 'changed') AS changed, count(*) FILTER (WHERE result = 'reverted') AS reverted, count(*) FILTER (WHERE result = 'skipped') AS skipped, count(*) FILTER (WHERE result NOT IN ('changed', 'reverted', 'skipped')) AS rest FROM f WHERE run_id <> '' GROUP BY run_id")
def run_results(spark, sf_dir):
    """What became of the findings of each run."""
    f = findings(spark, sf_dir, "run_id", "result").withColumn("run_id", key_or_null("run_id")).where("run_id is not null")
    n = lambda r: F.count_if(F.col("result") == r).alias(r)
    return f.groupBy("run_id").agg(n("changed"), n("reverted"), n("skipped"), F.count_if(~F.col("result").isin("changed", "reverted", "skipped")).alias("rest"))


@BOOK.add("SELECT source, count(*) AS files, make_timestamp(max(epoch_us(created_at))) AS newest, concat(count(*), ':', max(coalesce(epoch_us(created_at), 9007199254740991))) AS fingerprint FROM documents GROUP BY source")
def source_fingerprints(spark, sf_dir):
    """Count and newest time of each source; another value means something changed. A file without a time is gone, which counts as later than any."""
    at = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(9007199254740991))
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.max("created_at").alias("newest"), F.max(at).alias("at"))
    return d.select("source", "files", "newest", F.concat(F.col("files").cast("string"), F.lit(":"), F.col("at").cast("string")).alias("fingerprint"))


_PRI = _case("lower(file)", paths.PRIORITIES, 0)
_BEST = "list_min(list_transform(generators, lambda g: list_position(['text-match', 'scorer', 'selector', 'branch-map', 'outcome-set', 'gate'], g.generator)))"


@BOOK.add(CURRENT + f"SELECT id, project, row_number() OVER (PARTITION BY project ORDER BY {_PRI}, coalesce({_BEST}, 99), file, id) AS rank FROM e")
def static_rank(spark, sf_dir):
    """Entries of a project by how soon their file is read, then by their best generator."""
    from pyspark.sql import Window

    order = F.array(*map(F.lit, ("text-match", "scorer", "selector", "branch-map", "outcome-set", "gate")))
    best = F.array_min(F.transform("generators.generator", lambda g: F.array_position(order, g)))
    n = F.row_number().over(Window.partitionBy("project").orderBy(paths.read_priority(F.col("file")), F.coalesce(best, F.lit(99)), "file", "id"))
    return entries(spark, sf_dir, "file", "generators").select("id", "project", n.alias("rank"))


@BOOK.add(CURRENT + "SELECT id, greatest(1, least(boundary.start, unit.\"end\")) AS start, greatest(greatest(1, least(boundary.start, unit.\"end\")), least(boundary.\"end\", unit.\"end\")) AS \"end\" FROM e")
def clamped_lines(spark, sf_dir):
    """Boundaries held within their unit."""
    e = entries(spark, sf_dir, "unit", "boundary")
    start = F.greatest(F.lit(1), F.least("boundary.start", "unit.end"))
    return e.select("id", start.alias("start"), F.greatest(start, F.least("boundary.end", "unit.end")).alias("end"))


@BOOK.add(CURRENT + "SELECT p.slug, coalesce(nullif(lower(trim(p.visibility)), ''), 'other') AS visibility, coalesce(count(e.id), 0) AS entries FROM p LEFT JOIN e ON e.project = p.slug WHERE p.split IN ('train', 'dev') GROUP BY ALL ORDER BY entries DESC, slug LIMIT 5000")
def exported_projects(spark, sf_dir):
    """SRC07, SRC09: a bounded, ordered export with defaults for nulls; the limit is the export's."""
    p = projects(spark, sf_dir, "visibility").where(F.col("split").isin("train", "dev"))
    n = entries(spark, sf_dir).groupBy(F.col("project").alias("slug")).agg(F.count("*").alias("n"))
    return p.join(n, "slug", "left").select("slug", F.coalesce(key_or_null("visibility"), F.lit("other")).alias("visibility"), F.coalesce("n", F.lit(0)).alias("entries")).orderBy(F.desc("entries"), "slug").limit(5000)


@BOOK.add(_U + "SELECT project, site AS site_id, len(s.questions) AS questions, s.questions[1].key AS first_key, len(s.calls) AS calls, s.calls[1].line AS first_line FROM u")
def usage_payloads(spark, sf_dir):
    """SNK08, P37, P32: a bounded projection of nested usages, once through JSON and back."""
    shape = "struct<questions:array<struct<key:string>>,calls:array<struct<line:bigint>>>"
    cut = F.struct(F.transform("site.questions", lambda q: F.struct(q["key"].alias("key"))).alias("questions"), F.transform("site.calls", lambda c: F.struct(c["line"].alias("line"))).alias("calls"))
    back = F.from_json(F.to_json(cut), shape)
    u = usages(spark, sf_dir).select("project", "site_id", back.alias("j"))
    return u.select("project", "site_id", F.size("j.questions").cast("long").alias("questions"), F.get("j.questions", F.lit(0))["key"].alias("first_key"), F.size("j.calls").cast("long").alias("calls"), F.get("j.calls", F.lit(0))["line"].alias("first_line"))


@BOOK.add(CURRENT + "SELECT language, generator, count(*) AS n FROM (SELECT language, unnest(list_transform(generators, lambda g: g.generator)) AS generator FROM e WHERE status = 'active' UNION ALL SELECT 'all', unnest(list_transform(generators, lambda g: g.generator)) FROM e WHERE status = 'active') GROUP BY ALL")
def union_totals(spark, sf_dir):
    """Streams put together, here each language and all."""
    g = entries(spark, sf_dir, "language", "generators", "status").where("status = 'active'").select("language", F.explode("generators.generator").alias("generator"))
    return g.unionByName(g.withColumn("language", F.lit("all"))).groupBy("language", "generator").agg(F.count("*").alias("n"))


@BOOK.add(CURRENT + "SELECT id, len(list_intersect(list_transform(inputs, lambda i: lower(i.name)), w)) AS shared, len(list_intersect(list_transform(inputs, lambda i: lower(i.name)), w)) > 0 AS overlaps FROM (SELECT id, inputs, list_distinct(regexp_extract_all(lower(decision), '[a-z]+')) AS w FROM e)")
def shared_terms(spark, sf_dir):
    """Names that an entry's inputs share with its decision."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("decision"), F.lit("[a-z]+"), F.lit(0)))
    both = F.array_intersect(F.transform("inputs.name", F.lower), words)
    return entries(spark, sf_dir, "inputs", "decision").select("id", F.size(both).cast("long").alias("shared"), (F.size(both) > 0).alias("overlaps"))


@BOOK.add(CURRENT + "SELECT project, status, count(*) AS entries, count(DISTINCT file) AS files FROM e WHERE project IS NOT NULL GROUP BY ALL")
def stored_entries(spark, sf_dir):
    """SRC04, SNK01, SNK02: current entries that break no rule, written as JSON lines behind the gate and read by schema again."""
    import uuid

    from tessera.common import shared_folder
    from tessera.sources import files, sinks

    rows = entries(spark, sf_dir, "status", "file").where("project is not null")
    path = f"{shared_folder(spark)}/entries-{uuid.uuid4().hex}"
    sinks.gated(rows, rows.where("id is null").select(F.lit("missing id").alias("problem")), path, ["file", "id"])
    back = files.json_lines(spark, sinks.gated_path(spark, path), "id string, project string, status string, file string")
    return back.groupBy("project", "status").agg(F.count("*").alias("entries"), F.countDistinct("file").alias("files"))


def _stub(prompt: str, round_: int) -> dict:
    """A client without a network: answers with the length, asks once more about long prompts, fails on prompts that begin with `v`."""
    if prompt.startswith("v"):
        raise RuntimeError("refused")
    return {"answer": str(len(prompt)), "more": "again" if len(prompt) > 40 and round_ == 1 else None, "tokens": len(prompt)}


@BOOK.add("""WITH f AS (SELECT DISTINCT ON (lower(trim(id))) lower(trim(id)) AS id, decision AS d FROM findings) SELECT id AS key, CASE WHEN starts_with(d, 'v') THEN NULL WHEN length(d) > 40 THEN CAST(length(d) + 6 AS VARCHAR) ELSE CAST(length(d) AS VARCHAR) END AS answer,
CASE WHEN d = '' OR d IS NULL THEN 0 WHEN starts_with(d, 'v') THEN 1 WHEN length(d) > 40 THEN 2 ELSE 1 END AS rounds, CASE WHEN starts_with(d, 'v') THEN 'error' ELSE 'answered' END AS stopped FROM f WHERE d <> ''""")
def adaptive_answers(spark, sf_dir):
    """Conversations with a stub client; errors are values, rounds and retries are counted."""
    from tessera.operators.adaptive import converse

    f = findings(spark, sf_dir, "decision").where("decision <> ''")
    return converse(f, "id", "decision", _stub, rounds=4, retries=1).select("key", "answer", "rounds", "stopped")
