"""Dataset, evaluation and scorecard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import iso_ts, key_or_null, latest, norm_key, table
from tessera.functions import scores
from tessera.functions.text import band_for
from tessera.operators import datasets as ds
from tessera.operators import metrics
from tessera.plans.registry import Book

BOOK = Book()

#: What a key is in SQL; and the current rows of entries and projects.
CURRENT = """
WITH e AS (SELECT * REPLACE (lower(trim(id)) AS id, lower(trim(project)) AS project) FROM entries QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY CAST("updatedAt" AS TIMESTAMPTZ) DESC) = 1),
p AS (SELECT * REPLACE (lower(trim(slug)) AS slug, nullif(lower(trim(split)), '') AS split, lower(trim(fingerprint)) AS fingerprint) FROM project_records QUALIFY row_number() OVER (PARTITION BY lower(trim(slug)) ORDER BY CAST(updated AS TIMESTAMPTZ) DESC) = 1)
"""


def entries(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The current row of each entry: `id`, `project` and the columns asked for."""
    held = latest(table(spark, sf_dir, "entries"), key_or_null("id"), iso_ts("updatedAt"), ["project", *(c for c in columns if c != "project")])
    return held.select(F.col("key").alias("id"), key_or_null("project").alias("project"), *(c for c in columns if c != "project"))


def projects(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The current row of each project: `slug`, `split` and the columns asked for."""
    held = latest(table(spark, sf_dir, "project_records"), key_or_null("slug"), iso_ts("updated"), ["split", *(c for c in columns if c != "split")])
    return held.select(F.col("key").alias("slug"), key_or_null("split").alias("split"), *(c for c in columns if c != "split"))


@BOOK.add(CURRENT + 'SELECT id, project, status, "codeHash" AS code_hash FROM e')
def current_entries(spark, sf_dir):
    """The latest row of each id."""
    return entries(spark, sf_dir, "status", "codeHash").select("id", "project", "status", F.col("codeHash").alias("code_hash"))


@BOOK.add("""SELECT slug, substr(sha256('project:' || slug), 1, 24) AS fingerprint, x, CASE WHEN x < 0.6 THEN 'train' WHEN x < 0.6 + 0.2 THEN 'dev' ELSE 'test' END AS split
FROM (SELECT slug, CAST(('0x' || substr(sha256('tables-split-1' || chr(0) || substr(sha256('project:' || slug), 1, 24)), 1, 8)) AS BIGINT) / 4294967296.0 AS x FROM (SELECT DISTINCT lower(trim(slug)) AS slug FROM project_records))""")
def split_assign(spark, sf_dir):
    """Splits by hash, by the stored seed and ratios."""
    config = F.broadcast(table(spark, sf_dir, "split_config"))  # one row
    slugs = table(spark, sf_dir, "project_records").select(norm_key("slug").alias("slug")).distinct()
    fp = F.substring(F.sha2(F.concat(F.lit("project:"), F.col("slug")), 256), 1, 24)
    x = ds.unit_hash(F.col("splitSeed"), F.col("fingerprint"))
    return slugs.crossJoin(config).withColumn("fingerprint", fp).withColumn("x", x).select("slug", "fingerprint", "x", ds.assign_split(F.col("x"), F.col("ratios.train"), F.col("ratios.dev")).alias("split"))


_ROTATED = """, r AS (SELECT slug, "splitSource", split AS stored, CASE WHEN "splitSource" = 'manual' THEN split WHEN x < 0.6 THEN 'train' WHEN x < 0.8 THEN 'dev' ELSE 'test' END AS split
FROM (SELECT *, CAST(('0x' || substr(sha256('rotation-1' || chr(0) || fingerprint), 1, 8)) AS BIGINT) / 4294967296.0 AS x FROM p WHERE fingerprint IS NOT NULL))"""


@BOOK.add(CURRENT + _ROTATED + "SELECT stored, split, count(*) AS projects FROM r GROUP BY ALL")
def split_rotate(spark, sf_dir):
    """Splits under another seed; ones set by hand don't move."""
    p = projects(spark, sf_dir, "fingerprint", "splitSource").withColumn("fingerprint", norm_key("fingerprint")).where("fingerprint is not null")
    rotated = F.when(F.col("splitSource") == "manual", F.col("split")).otherwise(ds.assign_split(ds.unit_hash(F.lit("rotation-1"), F.col("fingerprint")), F.lit(0.6), F.lit(0.2)))
    return p.select(F.col("split").alias("stored"), rotated.alias("now")).groupBy("stored", F.col("now").alias("split")).agg(F.count("*").alias("projects"))


_LEAKS = """, a AS (SELECT e.id, e.project, p.split, e.file, e.unit.start AS start, lower(trim(e."codeHash")) AS h FROM e JOIN p ON p.slug = e.project WHERE e.status = 'active' AND trim(e."codeHash") <> ''),
f AS (SELECT *, first_value(project) OVER w AS first_project, first_value(split) OVER w AS first_split FROM a WINDOW w AS (PARTITION BY h ORDER BY project, file, start, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@BOOK.add(CURRENT + _LEAKS + "SELECT id, project, split, first_project, first_split FROM f WHERE project <> first_project AND split <> first_split")
def split_leakage(spark, sf_dir):
    """Later rows with the code of a first-seen owner in another project and split."""
    e = entries(spark, sf_dir, "status", "codeHash", "file", "unit").where("status = 'active'")
    a = e.join(projects(spark, sf_dir).withColumnRenamed("slug", "project"), "project").select("id", "project", "split", "file", F.col("unit.start").alias("start"), key_or_null("codeHash").alias("h"))
    owned = ds.first_owner(a, "h", [F.col(c) for c in ("project", "file", "start", "id")], ["project", "split"])
    return owned.where("h is not null and project <> first.project and split <> first.split").select("id", "project", "split", F.col("first.project").alias("first_project"), F.col("first.split").alias("first_split"))


@BOOK.add(CURRENT + "SELECT s AS split, coalesce(n, 0) AS projects FROM (VALUES ('train'), ('dev'), ('test')) v(s) LEFT JOIN (SELECT split, count(*) AS n FROM p GROUP BY 1) c ON c.split = v.s")
def split_counts(spark, sf_dir):
    """A18"""
    names = spark.createDataFrame([("train",), ("dev",), ("test",)], "split string")
    return names.join(projects(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("projects"))


_POS = "({0} LIKE 'STRONG%' OR {0} LIKE 'POSSIBLE%')"
_JUDGED = f""", j AS (SELECT e.id, e.project, p.split, e.human.label AS h, e.auto.label AS a, e.auto.source AS src, coalesce(e.origin, '') <> 'missed' AS proposed,
  e.human.label IS NOT NULL AND coalesce(e."needsRecheck", false) AS old, e.human.label IS NOT NULL AND NOT coalesce(e."needsRecheck", false) AS counted,
  {_POS.format('e.human.label')} AS truth, {_POS.format('e.auto.label')} AS guess FROM e LEFT JOIN p ON p.slug = e.project WHERE e.status = 'active')"""
_COUNTS = """count(id) AS entries, count(*) FILTER (WHERE old) AS needs_recheck, count(*) FILTER (WHERE counted) AS labelled, count(*) FILTER (WHERE counted AND proposed AND a IS NOT NULL) AS predicted,
  count(*) FILTER (WHERE counted AND proposed AND a IS NULL) AS unclassified, count(*) FILTER (WHERE counted AND proposed AND guess AND truth) AS tp, count(*) FILTER (WHERE counted AND proposed AND guess AND NOT truth) AS fp,
  count(*) FILTER (WHERE counted AND proposed AND a IS NOT NULL AND NOT guess AND truth) AS fn, count(*) FILTER (WHERE counted AND proposed AND a IS NOT NULL AND NOT guess AND NOT truth) AS tn,
  count(*) FILTER (WHERE counted AND proposed AND a = h) AS exact, count(*) FILTER (WHERE counted AND proposed AND src = 'triage') AS filtered, count(*) FILTER (WHERE counted AND proposed AND src = 'triage' AND NOT truth) AS agreed,
  count(*) FILTER (WHERE counted AND proposed AND src = 'triage' AND truth) AS overturned, count(*) FILTER (WHERE counted AND proposed AND truth) AS proposed_positives, count(*) FILTER (WHERE counted AND NOT proposed AND truth) AS missed_positives"""
_RATES = "round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(exact / nullif(predicted, 0), 6) AS exact_agreement, round(proposed_positives / nullif(proposed_positives + missed_positives, 0), 6) AS coverage"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir, "status", "origin", "human", "auto", "needsRecheck")
    return metrics.judged(e).join(projects(spark, sf_dir).withColumnRenamed("slug", "project"), "project", "left")


@BOOK.add(CURRENT + _JUDGED + f", c AS (SELECT {_COUNTS} FROM j) SELECT *, {_RATES} FROM c")
def eval_total(spark, sf_dir):
    """A03"""
    return metrics.rates(_judged(spark, sf_dir).agg(*metrics.counts()))


@BOOK.add(CURRENT + _JUDGED + f", c AS (SELECT coalesce(j.split, v.s) AS split, project, {_COUNTS} FROM (VALUES ('train'), ('dev'), ('test')) v(s) LEFT JOIN j ON j.split = v.s GROUP BY GROUPING SETS ((coalesce(j.split, v.s)), (coalesce(j.split, v.s), project)) HAVING NOT (project IS NULL AND grouping(project) = 0)) SELECT *, {_RATES} FROM c")
def eval_by_split(spark, sf_dir):
    """Per split and per project of a split, from one pass; a split without entries still has a row of zeros."""
    names = spark.createDataFrame([("train",), ("dev",), ("test",)], "split string")
    rows = names.join(_judged(spark, sf_dir), "split", "left")
    sets = rows.groupingSets([["split"], ["split", "project"]], "split", "project").agg(*metrics.counts(), F.grouping("project").alias("g"))
    return metrics.rates(sets.where("not (project is null and g = 0)").drop("g"))


@BOOK.add(CURRENT + _JUDGED + """SELECT tp + 0 AS tp, fp + unlabelled AS fp, fn, CASE WHEN tp + fp + unlabelled = 0 THEN 1 ELSE round(tp / (tp + fp + unlabelled), 6) END AS precision, CASE WHEN tp + fn = 0 THEN 1 ELSE round(tp / (tp + fn), 6) END AS recall
FROM (SELECT count(*) FILTER (WHERE counted AND guess AND truth) AS tp, count(*) FILTER (WHERE counted AND guess AND NOT truth) AS fp, count(*) FILTER (WHERE counted AND truth AND NOT coalesce(guess, false)) AS fn, count(*) FILTER (WHERE NOT counted AND guess) AS unlabelled FROM j)""")
def eval_zero_rules(spark, sf_dir):
    """The harness's rule: nothing by nothing is 1, and what no label knows counts as wrong."""
    j = _judged(spark, sf_dir)
    yes, truth = F.coalesce("guess", F.lit(False)), F.coalesce("truth", F.lit(False))
    n = j.agg(F.count_if(F.col("counted") & yes & truth).alias("tp"), (F.count_if(F.col("counted") & yes & ~truth) + F.count_if(~F.col("counted") & yes)).alias("fp"), F.count_if(F.col("counted") & truth & ~yes).alias("fn"))
    one = lambda a, b, name: F.coalesce(F.round(F.try_divide(a, b), 6), F.lit(1.0)).alias(name)
    return n.select("tp", "fp", "fn", one(F.col("tp"), F.col("tp") + F.col("fp"), "precision"), one(F.col("tp"), F.col("tp") + F.col("fn"), "recall"))


@BOOK.add(CURRENT + _JUDGED + "SELECT kind, value, count(*) AS n FROM (SELECT 'label' AS kind, h AS value FROM j WHERE counted UNION ALL SELECT 'category', e.human.category FROM j JOIN e USING (id) WHERE counted UNION ALL SELECT 'hard_negative', e.human.\"hardNegativeReason\" FROM j JOIN e USING (id) WHERE counted) WHERE value <> '' GROUP BY ALL")
def label_histograms(spark, sf_dir):
    """Labels, categories and reasons."""
    rows = _judged(spark, sf_dir).where("counted")
    kinds = F.explode(F.create_map(F.lit("label"), F.col("human.label"), F.lit("category"), F.col("human.category"), F.lit("hard_negative"), F.col("human.hardNegativeReason"))).alias("kind", "value")
    return rows.select(kinds).where("value <> ''").groupBy("kind", "value").agg(F.count("*").alias("n"))


@BOOK.add(CURRENT + """, s AS (SELECT id, 'gemini' AS slot, human.label AS h, gemini.facts.usable AS usable, gemini.facts.hypothesis AS hyp FROM e WHERE status = 'active' AND human IS NOT NULL AND NOT coalesce("needsRecheck", false) AND gemini IS NOT NULL
UNION ALL SELECT id, 'openrouter', human.label, openrouter.facts.usable, openrouter.facts.hypothesis FROM e WHERE status = 'active' AND human IS NOT NULL AND NOT coalesce("needsRecheck", false) AND openrouter IS NOT NULL)
SELECT slot, count(*) AS with_evidence, count(*) FILTER (WHERE usable = false) AS insufficient, count(*) FILTER (WHERE hyp IS NOT NULL AND coalesce(usable, true)) AS hypotheses FROM s GROUP BY slot""")
def analyst_evidence(spark, sf_dir):
    """Evidence of the two analysts on labelled entries."""
    e = entries(spark, sf_dir, "status", "human", "needsRecheck", "gemini", "openrouter").where("status = 'active' and human is not null and not coalesce(needsRecheck, false)")
    both = e.select(F.lit("gemini").alias("slot"), F.col("gemini").alias("g")).unionByName(e.select(F.lit("openrouter").alias("slot"), F.col("openrouter").alias("g"))).where("g is not null")
    usable = F.coalesce("g.facts.usable", F.lit(True))
    return both.groupBy("slot").agg(F.count("*").alias("with_evidence"), F.count_if(~usable).alias("insufficient"), F.count_if(F.col("g.facts.hypothesis").isNotNull() & usable).alias("hypotheses"))


_GRID = "(VALUES (0.4), (0.45), (0.5), (0.55), (0.6)) t(min) CROSS JOIN (VALUES (true), (false)) s(assist)"


@BOOK.add(CURRENT + f""", d AS (SELECT t.min AS semantic_min, s.assist, {_POS.format('human.label')} AS truth,
  CASE WHEN auto.answers.primitive = 'none' AND auto.answers."primitiveConfidence" >= 0.8 THEN false WHEN auto.answers.judgment >= t.min THEN true
       WHEN s.assist AND auto.answers.primitive <> 'none' AND auto.answers."primitiveConfidence" >= 0.8 AND auto.answers.judgment >= 0.4 THEN true ELSE false END AS yes
  FROM e CROSS JOIN {_GRID} WHERE status = 'active' AND auto.answers IS NOT NULL AND human.label IS NOT NULL)
SELECT CAST(semantic_min AS DOUBLE) AS semantic_min, assist, count(*) FILTER (WHERE yes AND truth) AS tp, count(*) FILTER (WHERE yes AND NOT truth) AS fp, count(*) FILTER (WHERE NOT yes AND truth) AS fn FROM d GROUP BY ALL""")
def policy_sweep(spark, sf_dir):
    """A validation policy over a grid of ten settings, decided again from stored answers in one pass."""
    e = entries(spark, sf_dir, "status", "auto", "human").where("status = 'active' and auto.answers is not null and human.label is not null")
    answers = [F.col(f"auto.answers.{c}") for c in ("judgment", "primitive", "primitiveConfidence")]
    settings = [(m, a, scores.Policy(semantic_min=m, assist_min=0.8 if a else 2.0)) for m in (0.4, 0.45, 0.5, 0.55, 0.6) for a in (True, False)]
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("semantic_min"), F.lit(a).alias("assist"), (p.decide(answers[0], answers[1] != "none", answers[2]) == "confirmed").alias("yes")) for m, a, p in settings])).alias("s")
    d = e.select(metrics.positive(F.col("human.label")).alias("truth"), grid).select("truth", "s.*")
    return d.groupBy("semantic_min", "assist").agg(F.count_if(F.col("yes") & F.col("truth")).alias("tp"), F.count_if(F.col("yes") & ~F.col("truth")).alias("fp"), F.count_if(~F.col("yes") & F.col("truth")).alias("fn"))


def _level_sql(f: str) -> str:
    r = lambda x: f"(list_position(['none', 'low', 'medium', 'high'], {x}) - 1)"
    a, b = (scores.LEVELS.index(t) for t in scores.PROFILE[f])
    v = f"features['{f}']"
    return f"CASE WHEN abs({r(v)} - {a}) < abs({r(v)} - {b}) THEN 1.0 WHEN abs({r(v)} - {a}) = abs({r(v)} - {b}) THEN 0.5 WHEN abs({r(v)} - {a}) > abs({r(v)} - {b}) THEN 0.0 END"


_FINDINGS = "f AS (SELECT DISTINCT ON (lower(trim(id))) * REPLACE (lower(trim(id)) AS id) FROM findings)"
_PARTS = "[" + ", ".join(_level_sql(f) for f in scores.PROFILE) + "]"


def findings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per finding with the columns asked for; copies are equal in all but the spelling of keys."""
    rows = table(spark, sf_dir, "findings").select(key_or_null("id").alias("id"), *columns).where("id is not null")
    return rows.groupBy("id").agg(*[F.any_value(c).alias(c) for c in columns]) if columns else rows.distinct()


@BOOK.add(f"WITH {_FINDINGS}, s AS (SELECT id, list_filter({_PARTS}, lambda x: x IS NOT NULL) AS parts FROM f) SELECT id, CAST(round(list_sum(parts) / nullif(len(parts), 0), 6) AS DOUBLE) AS score, len(parts) AS reported FROM s")
def pattern_scores(spark, sf_dir):
    """P20"""
    f = findings(spark, sf_dir, "features")
    n = sum((scores.feature_match(F.col("features")[name], name).isNotNull().cast("int") for name in scores.PROFILE), F.lit(0))
    return f.select("id", F.round(scores.pattern_score(F.col("features")), 6).alias("score"), n.cast("long").alias("reported"))


_AVG = "((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0))"
_DIS = "(coalesce(a >= 0.5, false) OR coalesce(b >= 0.5, false) OR coalesce(c >= 0.5, false)) AND (coalesce(a < 0.5, false) OR coalesce(b < 0.5, false) OR coalesce(c < 0.5, false))"


@BOOK.add(f"WITH {_FINDINGS}, s AS (SELECT id, round(CAST(pattern_score AS DOUBLE), 3) AS a, round(CAST(ai_score AS DOUBLE), 3) AS b, round(CAST(typesafe_score AS DOUBLE), 3) AS c FROM f) SELECT id, round({_AVG}, 6) AS average, CASE WHEN {_DIS} THEN 'REVIEW_DISAGREE' WHEN round({_AVG}, 9) >= 0.7 THEN 'STRONG_FIT' WHEN round({_AVG}, 9) >= 0.5 THEN 'POSSIBLE_FIT' ELSE 'WEAK_FIT' END AS verdict, list_filter([CASE WHEN a IS NULL THEN 'patterns' END, CASE WHEN b IS NULL THEN 'ai' END, CASE WHEN c IS NULL THEN 'semantic' END], lambda x: x IS NOT NULL) AS missing FROM s")
def scorecards(spark, sf_dir):
    """Three opinions, their mean and a verdict."""
    r = lambda c: F.round(F.col(c).cast("double"), 3)
    f = findings(spark, sf_dir, "pattern_score", "ai_score", "typesafe_score").select("id", r("pattern_score").alias("a"), r("ai_score").alias("b"), r("typesafe_score").alias("c"))
    three = [F.col(c) for c in "abc"]
    mean = F.round(scores.average(*three), 9)
    verdict = F.when(scores.verdict(*three) == "REVIEW_DISAGREE", "REVIEW_DISAGREE").when(mean >= 0.7, "STRONG_FIT").when(mean >= 0.5, "POSSIBLE_FIT").otherwise("WEAK_FIT")
    return f.select("id", F.round(scores.average(*three), 6).alias("average"), verdict.alias("verdict"), scores.missing(patterns=three[0], ai=three[1], semantic=three[2]).alias("missing"))


@BOOK.add(CURRENT + "SELECT id, round(auto.answers.bounded * (0.6 * auto.answers.judgment + 0.4 * (1 - auto.answers.\"deterministicIsCorrect\")), 6) AS score FROM e WHERE auto.answers IS NOT NULL")
def semantic_scores(spark, sf_dir):
    """P21"""
    a = lambda c: F.col(f"auto.answers.{c}")
    return entries(spark, sf_dir, "auto").where("auto.answers is not null").select("id", F.round(scores.semantic_score(a("bounded"), a("judgment"), a("deterministicIsCorrect")), 6).alias("score"))


def _tally_sql(keys: str) -> str:
    return f"(SELECT {keys}, count(*) FILTER (WHERE result = 'changed') AS good, count(*) FILTER (WHERE result = 'reverted') AS bad FROM f WHERE pattern_label IS NOT NULL GROUP BY {keys} HAVING count(*) FILTER (WHERE result IN ('changed', 'reverted')) >= 5)"


@BOOK.add(f"WITH {_FINDINGS} SELECT f.id, round(coalesce(l.good / (l.good + l.bad), k.good / (k.good + k.bad)), 4) AS learned, round(coalesce((round(CAST(pattern_score AS DOUBLE), 3) + round(coalesce(l.good / (l.good + l.bad), k.good / (k.good + k.bad)), 4)) / 2, round(CAST(pattern_score AS DOUBLE), 3), round(coalesce(l.good / (l.good + l.bad), k.good / (k.good + k.bad)), 4)), 6) AS blended FROM f LEFT JOIN {_tally_sql('pattern_label')} l ON l.pattern_label = f.pattern_label LEFT JOIN {_tally_sql('input_kind, rule_kind')} k ON k.input_kind = f.input_kind AND k.rule_kind = f.rule_kind")
def learned_blend(spark, sf_dir):
    """Scores learned from outcomes, by exact label, else by kinds, where there are at least five."""
    f = findings(spark, sf_dir, "pattern_label", "input_kind", "rule_kind", "result", "pattern_score")

    def tally(keys: list[str], name: str) -> DataFrame:
        t = f.where("pattern_label is not null").groupBy(*keys).agg(F.count_if(F.col("result") == "changed").alias("good"), F.count_if(F.col("result") == "reverted").alias("bad"))
        return t.where("good + bad >= 5").select(*keys, (F.col("good") / (F.col("good") + F.col("bad"))).alias(name))

    j = f.join(tally(["pattern_label"], "exact"), "pattern_label", "left").join(tally(["input_kind", "rule_kind"], "kind"), ["input_kind", "rule_kind"], "left")
    learned = F.round(F.coalesce("exact", "kind"), 4)
    return j.select("id", learned.alias("learned"), F.round(scores.blend(F.round(F.col("pattern_score").cast("double"), 3), learned), 6).alias("blended"))


_OLD = """, o AS (SELECT id, "codeHash" AS code_hash, status, origin, human.label AS human, human."codeHash" AS human_hash, "createdAt" AS created, "updatedAt" AS updated FROM e),
n AS (SELECT id, sha256(code) AS code_hash FROM e WHERE code IS NOT NULL AND status = 'active')"""


@BOOK.add(CURRENT + _OLD + """SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL AND o.id IS NOT NULL THEN 'updated' WHEN n.id IS NOT NULL THEN 'added' WHEN o.origin = 'missed' THEN 'kept' WHEN o.status = 'stale' THEN 'stale' ELSE 'became_stale' END AS action,
CASE WHEN n.id IS NOT NULL THEN 'active' WHEN o.origin = 'missed' THEN o.status ELSE 'stale' END AS status, o.human, CASE WHEN n.id IS NOT NULL AND o.human IS NOT NULL THEN o.human_hash IS DISTINCT FROM n.code_hash END AS needs_recheck, o.created,
CASE WHEN n.id IS NOT NULL THEN 'now' WHEN o.origin = 'missed' OR o.status = 'stale' THEN o.updated ELSE 'now' END AS updated FROM o FULL JOIN n ON n.id = o.id""")
def upsert_merge(spark, sf_dir):
    """A run over public code merged into the dataset; labels survive, what isn't found again becomes stale."""
    e = entries(spark, sf_dir, "status", "origin", "human", "codeHash", "createdAt", "updatedAt", "code")
    old = e.select("id", F.col("codeHash").alias("code_hash"), "status", "origin", F.col("human.label").alias("human"), F.col("human.codeHash").alias("human_hash"), F.col("createdAt").alias("created"), F.col("updatedAt").alias("updated"))
    new = e.where("code is not null and status = 'active'").select("id", F.sha2("code", 256).alias("code_hash"))
    return ds.upsert(old, new, "id", F.lit("now")).drop("code_hash")


@BOOK.add("""WITH u AS (SELECT lower(trim(project)) AS project, lower(trim(site.id)) AS site, CAST("at" AS TIMESTAMPTZ) AS ts, site.role AS role FROM usages), old AS (SELECT DISTINCT * FROM u WHERE ts < TIMESTAMPTZ '2026-06-01 00:00:00+00'), new AS (SELECT DISTINCT * FROM u WHERE ts >= TIMESTAMPTZ '2026-06-01 00:00:00+00')
SELECT project, count(*) AS sites, count(*) FILTER (WHERE kept) AS kept FROM (SELECT project, true AS kept FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.project = old.project AND new.site = old.site) UNION ALL SELECT project, false FROM new) GROUP BY project""")
def keyed_replace(spark, sf_dir):
    """J06, SNK03: usages of a later run take the place of those with the same key."""
    u = table(spark, sf_dir, "usages").select(norm_key("project").alias("project"), norm_key("site.id").alias("site"), iso_ts("at").alias("ts"), F.col("site.role").alias("role")).distinct()
    cut = F.lit("2026-06-01").cast("timestamp")
    merged = ds.replace_keyed(u.where(F.col("ts") < cut).withColumn("kept", F.lit(True)), u.where(F.col("ts") >= cut).withColumn("kept", F.lit(False)), ["project", "site"])
    return merged.groupBy("project").agg(F.count("*").alias("sites"), F.count_if("kept").alias("kept"))


@BOOK.add(CURRENT + """, c AS (SELECT DISTINCT project || '/' || file AS k, id AS item, lower(trim("codeHash")) AS hash FROM e WHERE file IS NOT NULL), now AS (SELECT id AS item, lower(sha256(code)) AS hash FROM e WHERE code IS NOT NULL)
SELECT k AS cache_key, bool_and(c.hash IS NOT DISTINCT FROM now.hash) AS hit FROM c LEFT JOIN now USING (item) GROUP BY k""")
def cache_freshness(spark, sf_dir):
    """J16, SNK09: a cached analysis of a file holds only if every item still has its hash."""
    e = entries(spark, sf_dir, "file", "codeHash", "code")
    cache = e.where("file is not null").select(F.concat("project", F.lit("/"), "file").alias("cache_key"), F.col("id").alias("item"), norm_key("codeHash").alias("hash")).distinct()
    return ds.fresh_hits(cache.select("cache_key").distinct(), cache.where("cache_key is not null"), e.where("code is not null").select(F.col("id").alias("item"), F.sha2("code", 256).alias("hash")), "cache_key")


@BOOK.add(CURRENT + """SELECT p.slug, count(e.id) FILTER (WHERE e.status = 'active') AS active, count(e.human) FILTER (WHERE e.status = 'active') AS labelled, count(*) FILTER (WHERE e."needsRecheck") AS recheck FROM p LEFT JOIN e ON e.project = p.slug GROUP BY p.slug""")
def project_listing(spark, sf_dir):
    """A24, SRC05"""
    j = projects(spark, sf_dir).join(entries(spark, sf_dir, "status", "human", "needsRecheck").withColumnRenamed("project", "slug"), "slug", "left")
    active = F.coalesce(F.col("status") == "active", F.lit(False))
    return j.groupBy("slug").agg(F.count_if(active).alias("active"), F.count_if(active & F.col("human").isNotNull()).alias("labelled"), F.count_if(F.coalesce("needsRecheck", F.lit(False))).alias("recheck"))


@BOOK.add(
    CURRENT
    + """, a AS (SELECT id, auto.answers.judgment AS s, auto.answers.category AS kind, auto.answers."categoryConfidence" AS k FROM e),
d AS (SELECT id, s, CASE WHEN s IS NULL THEN 'error' WHEN kind = 'other' AND k >= 0.8 THEN 'rejected' WHEN s >= 0.5 OR (kind <> 'other' AND k >= 0.8 AND s >= 0.4) THEN 'confirmed' ELSE 'rejected' END AS status FROM a),
c AS (SELECT id, status, CASE WHEN status <> 'error' THEN greatest(CAST(floor(s * 100 + 0.5) AS BIGINT), CASE WHEN status = 'confirmed' THEN 50 ELSE 0 END) END AS confidence FROM d)
SELECT id, status, confidence, CASE WHEN status = 'rejected' THEN 'ignore' WHEN confidence >= 90 THEN 'strong' WHEN confidence >= 75 THEN 'likely' WHEN confidence >= 50 THEN 'possible' END AS band FROM c"""
)
def validated_scores(spark, sf_dir):
    """What answers make of a candidate: confirmed or rejected, its confidence, at least the least shown if confirmed, and band; without an answer nothing changes."""
    a = entries(spark, sf_dir, "auto").select("id", F.col("auto.answers.judgment").alias("s"), (F.col("auto.answers.category") == "other").alias("other"), F.col("auto.answers.categoryConfidence").alias("k"))
    sure = F.col("k") >= 0.8
    status = F.when(F.col("s").isNull(), "error").when(F.col("other") & sure, "rejected").when((F.col("s") >= 0.5) | (~F.col("other") & sure & (F.col("s") >= 0.4)), "confirmed").otherwise("rejected")
    c = a.select("id", "s", status.alias("status")).withColumn("confidence", F.when(F.col("status") != "error", scores.validated_score(F.col("status"), F.col("s"))))
    return c.select("id", "status", F.col("confidence").cast("long").alias("confidence"), F.when(F.col("status") == "rejected", "ignore").when(F.col("status") == "confirmed", band_for(F.col("confidence"))).alias("band"))


@BOOK.add("SELECT lower(trim(id)) AS id, count(*) AS rows FROM entries GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    """Ids with history."""
    return table(spark, sf_dir, "entries").groupBy(key_or_null("id").alias("id")).agg(F.count("*").alias("rows")).where("id is not null and rows > 1")


@BOOK.add(CURRENT + "SELECT id, CASE WHEN visibility = 'public' THEN decision END AS decision, CASE WHEN visibility = 'public' THEN len(outputs.values) ELSE 0 END AS \"values\", list_transform(generators, lambda g: g.generator) AS generators FROM e")
def private_view(spark, sf_dir):
    """Private entries keep kinds and counts only."""
    public = F.col("visibility") == "public"
    return entries(spark, sf_dir, "visibility", "decision", "outputs", "generators").select("id", F.when(public, F.col("decision")).alias("decision"), F.when(public, F.when(F.col("outputs.values").isNotNull(), F.size("outputs.values")).cast("long")).otherwise(F.lit(0).cast("long")).alias("values"), F.col("generators.generator").alias("generators"))
