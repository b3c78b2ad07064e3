"""Facts, proposals and text sites extracted from code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.common import table
from tessera.functions import facts as fx
from tessera.functions import text
from tessera.plans.datasets import CURRENT, entries
from tessera.plans.registry import Book

BOOK = Book()

# Weights of the signals of a text decision.
WEIGHTS = {"includes": 25, "pattern": 20, "switch": 20, "threshold": 15, "equality": 15, "list": 10, "merged": 20, "return_text": 25, "caught": -30}


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every current entry with code; settings have no branches, so theirs are empty."""
    e = entries(spark, sf_dir, "code", "unit", "file").where("code is not null")
    return e.select("id", "project", "file", F.col("unit.name").alias("name"), fx.facts_of(F.col("code")).alias("f")).where("f is not null")


@BOOK.add()
def unit_facts(spark, sf_dir):
    """The counters over the facts of every unit."""
    f = _facts(spark, sf_dir)
    return f.select("id", *[c.alias(name) for name, c in fx.features(F.col("f")).items()])


@BOOK.add()
def unit_conditions(spark, sf_dir):
    """Each part of each condition: its kind, what is read and where that comes from."""
    c = _facts(spark, sf_dir).select("id", F.explode("f.conditions").alias("c"))
    return c.select("id", "c.line", "c.shapes", F.col("c.operands.name").alias("names"), F.col("c.operands.provenance").alias("provenance"), "c.strings", "c.numbers", "c.exits")


@BOOK.add()
def unit_returns(spark, sf_dir):
    """Each value a unit may return, with its kind."""
    return _facts(spark, sf_dir).select("id", F.inline("f.returns"))


@BOOK.add()
def guard_chains(spark, sf_dir):
    """Two or more conditions in a row that each leave the unit or the loop: the lines of the first and the last, and how many."""
    c = _facts(spark, sf_dir).select("id", F.posexplode("f.conditions").alias("n", "c")).select("id", "n", "c.line", "c.exits")
    return exiting_runs(c)


def exiting_runs(conditions: DataFrame) -> DataFrame:
    """Columns `id, start, end, length` of runs of conditions (`id, n, line, exits`) that exit, one after another; a unit's conditions are few."""
    island = F.col("n") - F.row_number().over(Window.partitionBy("id").orderBy("n"))
    return conditions.where("exits").withColumn("island", island).groupBy("id", "island").agg(F.min("line").alias("start"), F.max("line").alias("end"), F.count("*").alias("length")).where("length >= 2").drop("island")


@BOOK.add()
def proposals(spark, sf_dir):
    """Units with the rules that propose them, why some are none, what they decide on and from what."""
    f = _facts(spark, sf_dir).withColumn("generators", fx.generators(F.col("f"))).where("size(generators) > 0")
    facts, fired = F.col("f"), F.col("generators")
    return f.select("id", "name", "generators", fx.triage(facts, fired).alias("triage"), fx.output_kind(facts).alias("output"), fx.outcomes(facts).alias("outcomes"), fx.inputs(facts).alias("inputs"), fx.suggestion(facts, fired).alias("primitive"), fx.explanation(F.col("name"), facts, fired).alias("explanation"))


_LINES = "l AS (SELECT id, unnest(string_split(code, chr(10))) AS line, generate_subscripts(string_split(code, chr(10)), 1) AS n FROM e WHERE code IS NOT NULL)"
_KINDS = (
    ("pattern", r"/[^/\n]+/i?\.test\(|re\.search\("),
    ("includes", r"\.includes\(|^[ \t]*if \"[^\"]*\" in "),
    ("switch", r"^[ \t]*(switch|case) "),
    ("threshold", r"[<>]=? *[0-9]"),
    ("equality", r"[=!]==? *[\"']"),
)
_KIND_SQL = "CASE " + " ".join("WHEN regexp_matches(line, '" + p.replace("'", "''") + f"') THEN '{k}'" for k, p in _KINDS) + " END"


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = entries(spark, sf_dir, "code").where("code is not null").select("id", F.posexplode(F.split("code", "\n")).alias("n", "line"))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(_KINDS):
        kind = F.when(F.col("line").rlike(pattern), name).otherwise(kind)
    return lines.select("id", (F.col("n") + 1).cast("long").alias("n"), kind.alias("kind"), F.col("line").rlike(r"return *[\"']").alias("returns")).where("kind is not null")


@BOOK.add(CURRENT + f", {_LINES} SELECT id, n, {_KIND_SQL} AS kind, regexp_matches(line, 'return *[\"'']') AS returns FROM l WHERE {_KIND_SQL} IS NOT NULL")
def text_sites(spark, sf_dir):
    """Lines that test text, by kind."""
    return _sites(spark, sf_dir)


_SCORE_SQL = "least(100, greatest(0, " + " + ".join(f"{WEIGHTS[k]} * CAST(list_contains(kinds, '{k}') AS INT)" for k, _ in _KINDS) + f" + {WEIGHTS['merged']} * CAST(sites >= 2 AS INT) + {WEIGHTS['return_text']} * CAST(returns AS INT)))"


@BOOK.add(
    CURRENT
    + f""", {_LINES}, s AS (SELECT id, n, {_KIND_SQL} AS kind, regexp_matches(line, 'return *["'']') AS returns FROM l WHERE {_KIND_SQL} IS NOT NULL),
i AS (SELECT *, n - row_number() OVER (PARTITION BY id ORDER BY n) AS island FROM s), g AS (SELECT id, min(n) AS start, max(n) AS "end", count(*) AS sites, list_sort(list(DISTINCT kind)) AS kinds, bool_or(returns) AS returns FROM i GROUP BY id, island)
SELECT id, start, "end", sites, kinds, {_SCORE_SQL} AS score, CASE WHEN {_SCORE_SQL} >= 90 THEN 'strong' WHEN {_SCORE_SQL} >= 75 THEN 'likely' WHEN {_SCORE_SQL} >= 50 THEN 'possible' ELSE 'ignore' END AS band FROM g"""
)
def text_decisions(spark, sf_dir):
    """Neighbouring sites merged into decisions, scored by weighted signals and banded."""
    s = _sites(spark, sf_dir)
    island = F.col("n") - F.row_number().over(Window.partitionBy("id").orderBy("n"))  # lines of one unit
    g = s.withColumn("island", island).groupBy("id", "island").agg(F.min("n").alias("start"), F.max("n").alias("end"), F.count("*").alias("sites"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.bool_or("returns").alias("returns"))
    score = sum((F.lit(WEIGHTS[k]) * F.array_contains("kinds", k).cast("int") for k, _ in _KINDS), F.lit(0)) + WEIGHTS["merged"] * (F.col("sites") >= 2).cast("int") + WEIGHTS["return_text"] * F.col("returns").cast("int")
    g = g.withColumn("score", F.least(F.lit(100), F.greatest(F.lit(0), score)))
    return g.select("id", "start", "end", "sites", "kinds", "score", text.band_for(F.col("score")).alias("band"))


@BOOK.add()
def question_calls(spark, sf_dir):
    """Imports, awaited calls, raised errors and exports of code files in documents, one row per line that shows one."""
    lines = table(spark, sf_dir, "documents").where("kind = 'code_file' and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    kind = F.when(F.col("line").rlike(r"^\s*(import|from)\s"), "import").when(F.col("line").rlike(r"\bawait\s+[\w.]+\("), "awaited_call").when(F.col("line").rlike(r"\bthrow\b|\braise\b"), "raise").when(F.col("line").rlike(r"^\s*export\s"), "export")
    name = F.regexp_extract("line", r"(?:await\s+|from\s+[\"']?|import\s+|export\s+(?:async\s+)?(?:function|const|class)\s+)([\w./@-]+)", 1)
    return lines.select("doc_id", (F.col("n") + 1).alias("line_no"), kind.alias("kind"), F.nullif(name, F.lit("")).alias("name")).where("kind is not null")
