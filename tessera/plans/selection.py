"""Queries that choose: search, paths, contrasts, prefixes, and answers to what was asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import key_or_null, norm_key, table
from tessera.functions import answers
from tessera.operators import selection as op
from tessera.plans.datasets import CURRENT, entries, findings
from tessera.plans.evidence import usages
from tessera.plans.registry import Book

BOOK = Book()


@BOOK.add(
    CURRENT
    + r""", pr AS (SELECT DISTINCT fn, file FROM (SELECT regexp_extract("prompt", '"function": "([^"]+)"', 1) AS fn, lower(trim("entryId")) AS id FROM gemini_prompts) JOIN e USING (id) WHERE fn <> '' AND file IS NOT NULL),
r AS (SELECT fn || '() in ' || file AS q FROM pr UNION SELECT 'the type ' || upper(fn) || ' of ' || string_split(file, '/')[-1] FROM pr),
s AS (SELECT DISTINCT unit.name AS s FROM entries WHERE unit.name IS NOT NULL UNION SELECT DISTINCT 'Runner.' || unit.name FROM entries WHERE unit.start % 2 = 0), f AS (SELECT DISTINCT file AS f FROM entries WHERE file IS NOT NULL),
ft AS (SELECT DISTINCT q, regexp_replace(unnest(regexp_extract_all(q, '[\w@./-]+\.[A-Za-z]{1,5}\b')), '^\.?/', '') AS t FROM r),
w AS (SELECT DISTINCT q, unnest(regexp_extract_all(q, '[A-Za-z_$][A-Za-z0-9_$]*')) AS w FROM r), k AS (SELECT q, w, regexp_matches(w, '[a-z][A-Z]|_|[0-9]') OR contains(q, w || '()') AS strong FROM w), i AS (SELECT * FROM k WHERE strong OR regexp_matches(w, '^[A-Z]') OR length(w) >= 5),
m AS (SELECT q, 'file:' || f AS id, CASE WHEN f = t THEN 10 ELSE 8 END AS score FROM ft JOIN f ON ends_with(f, t)
  UNION ALL SELECT q, 'symbol:' || s, CASE WHEN s = w OR string_split(s, '.')[-1] = w THEN CASE WHEN strong THEN 7 ELSE 5 END ELSE CASE WHEN strong THEN 4 ELSE 2 END END FROM i JOIN s ON s = w OR lower(string_split(s, '.')[-1]) = lower(w)
  UNION ALL SELECT q, 'outline:' || f, 3 FROM i JOIN f ON regexp_replace(string_split(f, '/')[-1], '\.[^.]+$', '') = w),
b AS (SELECT q, id, max(score) AS score FROM m GROUP BY ALL)
SELECT q AS request, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank, id, score FROM b QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= 3"""
)
def scored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests for the function of each prompt find among the symbols and files of the entries, the best three."""
    fn = F.regexp_extract("prompt", r'"function": "([^"]+)"', 1)
    p = table(spark, sf_dir, "gemini_prompts").select(fn.alias("fn"), key_or_null("entryId").alias("id")).join(entries(spark, sf_dir, "file"), "id").where("fn <> '' and file is not null").select("fn", "file").distinct()
    asked = p.select(F.concat("fn", F.lit("() in "), "file").alias("request")).unionByName(p.select(F.concat(F.lit("the type "), F.upper("fn"), F.lit(" of "), F.element_at(F.split("file", "/"), -1)).alias("request")))
    e = table(spark, sf_dir, "entries").select("unit", "file")
    symbols = e.select(F.col("unit.name").alias("symbol")).unionByName(e.where("unit.start % 2 = 0").select(F.concat(F.lit("Runner."), "unit.name").alias("symbol")))
    return op.search(asked, symbols, e.select("file"), 3)


@BOOK.add(
    r"""WITH k AS (SELECT file FROM entries WHERE file IS NOT NULL UNION SELECT site.file FROM usages WHERE site.file IS NOT NULL), r AS (SELECT DISTINCT unnest(['`./' || f || ':12-30`', string_split(f, '/')[-1] || ' (lines 3 to 9)', 'repo\' || replace(f, '/', '\')]) AS raw FROM (SELECT file AS f FROM entries WHERE file IS NOT NULL UNION SELECT contrast.file FROM contrasts) WHERE f IS NOT NULL),
q AS (SELECT raw, regexp_replace(regexp_replace(replace(trim(trim(regexp_replace(raw, '\s*\(lines?[^)]*\)\s*$', '')), '`''"'), '\', '/'), '^(\./|/)+', ''), ':[0-9]+(-[0-9]+)?$', '') AS c FROM r),
h AS (SELECT raw, max(file) FILTER (WHERE file = c) AS same, min(file) AS one, count(*) AS n FROM q JOIN k ON file = c OR ends_with(file, '/' || c) OR ends_with(c, '/' || file) GROUP BY raw)
SELECT r.raw, coalesce(same, CASE WHEN n = 1 THEN one END) AS file FROM r LEFT JOIN h USING (raw)"""
)
def matched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as a model may write them, matched with the files of entries and usages."""
    own, t = table(spark, sf_dir, "entries").select("file"), lambda name, col: table(spark, sf_dir, name).select(F.col(col).alias("file"))
    f = own.unionByName(t("contrasts", "contrast.file")).where("file is not null").distinct()
    base = F.element_at(F.split("file", "/"), -1)
    written = F.array(F.concat(F.lit("`./"), "file", F.lit(":12-30`")), F.concat(base, F.lit(" (lines 3 to 9)")), F.concat(F.lit("repo\\"), F.translate("file", "/", "\\")))
    return op.match_files(f.select(F.explode(written).alias("raw")), own.unionByName(t("usages", "site.file")))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`site, turn, item, rank` with the tier of every contrast that may stand beside a usage: one of the project that holds no call of a usage, in the same function, the same file, or recorded as in a related one."""
    u = usages(spark, sf_dir).select("project", "site_id", F.col("site.file").alias("sf"), F.col("site.unit.start").alias("ss"), F.col("site.unit.end").alias("se"), F.col("site.calls.line").alias("lines"))
    c = table(spark, sf_dir, "contrasts").select(key_or_null("contrast.id").alias("id"), key_or_null("project").alias("project"), key_or_null("siteId").alias("linked"), F.col("contrast.file").alias("file"), "contrast.unit.start", "contrast.unit.end", F.coalesce(F.size("contrast.generators"), F.lit(0)).alias("gens")).where("id is not null").distinct()
    touched = c.join(u.select("project", F.col("sf").alias("file"), "lines", "ss", "se"), ["project", "file"])
    hit = F.coalesce(F.exists("lines", lambda x: (x >= F.col("start")) & (x <= F.col("end"))), F.lit(False)) | ((F.col("start") == F.col("ss")) & (F.col("end") == F.col("se")))
    free = c.join(touched.where(hit).select("id").distinct(), "id", "left_anti")
    beside = u.withColumn("file", F.col("sf")).join(free, ["project", "file"])
    related = u.withColumn("linked", F.col("site_id")).join(free, ["project", "linked"]).where("file <> sf")
    odd = r"(^|/)(tests?|__tests__|bench|benchmarks|scripts|examples)/|\.(test|spec|bench)\."
    j = beside.unionByName(related).where(~F.col("file").rlike(odd) | F.col("sf").rlike(odd))
    same = F.col("file") == F.col("sf")
    tier = F.when(same & (F.col("start") >= F.col("ss")) & (F.col("end") <= F.col("se")), 0).when(same, 1).otherwise(2)
    distance = F.when(same, F.abs(F.col("start") - F.col("ss"))).otherwise(100_000)
    return j.select(F.struct("project", "site_id").alias("site"), F.struct("project", "site_id").alias("turn"), F.col("id").alias("item"), tier.alias("tier"), F.struct((tier * 1_000_000_000 - F.col("gens") * 1_000_000 + distance).alias("r"), "file", "start", "id").alias("rank")).distinct()


@BOOK.add()
def selected_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best contrasts of each usage by tier, generators and distance; no contrast serves two usages, of which the first by project and id come first."""
    rows = _candidates(spark, sf_dir)
    chosen = op.exclusive(rows, 3).join(rows.select("site", "item", "tier").distinct(), ["site", "item"])
    return chosen.select("site.project", "site.site_id", F.col("item").alias("id"), F.element_at(F.array(*map(F.lit, ("same_function", "same_file", "related_file"))), F.col("tier") + 1).alias("selection"), "nth")


@BOOK.add(
    CURRENT
    + """, d AS (SELECT project, file, unit.name AS name, max(auto.answers.judgment) AS score FROM e WHERE auto.answers.judgment IS NOT NULL GROUP BY ALL)
SELECT e.id, human.label AS label, d.score, d.score >= 0.5 AS detected FROM e LEFT JOIN d ON d.project = e.project AND d.file = e.file AND d.name = e.unit.name WHERE human.label IS NOT NULL"""
)
def label_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label with the best detection of its file and unit, if there is one."""
    e = entries(spark, sf_dir, "file", "unit", "auto", "human").select("id", "project", "file", F.col("unit.name").alias("name"), F.col("auto.answers.judgment").alias("score"), F.col("human.label").alias("label"))
    best = e.where("score is not null").groupBy("project", "file", "name").agg(F.max("score").alias("score"))
    return e.where("label is not null").drop("score").join(best, ["project", "file", "name"], "left").select("id", "label", "score", (F.col("score") >= 0.5).alias("detected"))


@BOOK.add(CURRENT + "SELECT id FROM e WHERE auto.answers.judgment >= 0.5 AND NOT EXISTS (SELECT 1 FROM e l WHERE l.human.label IS NOT NULL AND l.project = e.project AND l.file = e.file AND l.unit.name = e.unit.name)")
def unlabelled_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections at places that bear no label, positive or negative."""
    e = entries(spark, sf_dir, "file", "unit", "auto", "human").select("id", "project", "file", F.col("unit.name").alias("name"), F.col("auto.answers.judgment").alias("score"), F.col("human.label").alias("label"))
    return e.where("score >= 0.5").join(e.where("label is not null").select("project", "file", "name").distinct(), ["project", "file", "name"], "left_anti").select("id")


@BOOK.add(
    CURRENT
    + """, q AS (SELECT DISTINCT unnest([substr(lower(trim("entryId")), 1, 2), substr(lower(trim("entryId")), 1, 6), reverse(substr(lower(trim("entryId")), 1, 6))]) AS prefix FROM gemini_prompts WHERE trim("entryId") <> '')
SELECT prefix, CASE count(e.id) WHEN 0 THEN 'unknown' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS state, CASE WHEN count(e.id) = 1 THEN min(e.id) END AS id FROM q LEFT JOIN e ON starts_with(e.id, prefix) GROUP BY prefix"""
)
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry a beginning of an id means; unknown if none has it, ambiguous if several do. Ids are matched by all of their beginnings."""
    key = key_or_null("entryId")
    six = F.substring(key, 1, 6)
    q = table(spark, sf_dir, "gemini_prompts").where(key.isNotNull()).select(F.explode(F.array(F.substring(key, 1, 2), six, F.reverse(six))).alias("prefix")).distinct()
    begun = entries(spark, sf_dir).select("id", F.explode(F.sequence(F.lit(1), F.length("id"))).alias("n")).select("id", F.expr("substring(id, 1, n)").alias("prefix"))
    hits = begun.join(q, "prefix").groupBy("prefix").agg(F.count("*").alias("n"), F.min("id").alias("one"))
    return q.join(hits, "prefix", "left").select("prefix", F.when(F.col("n").isNull(), "unknown").when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("state"), F.when(F.col("n") == 1, F.col("one")).alias("id"))


@BOOK.add(
    """WITH asked AS (SELECT DISTINCT lower(trim(project)) AS project, lower(trim(contrast.id)) AS id FROM contrasts WHERE trim(contrast.id) <> ''), given AS (SELECT DISTINCT lower(trim(contrast.id)) AS id FROM contrasts WHERE usable AND facts IS NOT NULL)
SELECT project, count(*) AS asked, count(given.id) AS answered, count(*) - count(given.id) AS failed FROM asked LEFT JOIN given USING (id) GROUP BY project"""
)
def answered_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrasts asked for and answered, per project; those without a usable answer failed."""
    c = table(spark, sf_dir, "contrasts")
    asked = c.select(norm_key("project").alias("project"), key_or_null("contrast.id").alias("id")).where("id is not null").distinct()
    given = c.where("usable and facts is not null").select(key_or_null("contrast.id").alias("id"), F.lit(1).alias("given")).distinct()
    return asked.join(given, "id", "left").groupBy("project").agg(F.count("*").alias("asked"), F.count("given").alias("answered"), (F.count("*") - F.count("given")).alias("failed"))


def result_of(rows: DataFrame, changed: DataFrame, reverted: DataFrame, skipped: DataFrame, preview: Column, key: str = "id") -> DataFrame:
    """`rows` with `result` and `reason`: changed before reverted before skipped before a preview, else left. `reverted` and `skipped` have `reason`."""
    c = changed.select(key).distinct().withColumn("c", F.lit(True))
    r, s = (x.groupBy(key).agg(F.min(F.coalesce("reason", F.lit(""))).alias(name)) for x, name in ((reverted, "r"), (skipped, "s")))
    j = rows.join(c, key, "left").join(r, key, "left").join(s, key, "left")
    result = F.when(F.col("c"), "changed").when(F.col("r").isNotNull(), "reverted").when(F.col("s").isNotNull(), "skipped").when(preview, "preview").otherwise("left")
    return j.withColumn("result", result).withColumn("reason", F.nullif(F.substring(F.coalesce("r", "s"), 1, 120), F.lit(""))).drop("c", "r", "s")


@BOOK.add(
    """WITH f AS (SELECT DISTINCT ON (lower(trim(id))) lower(trim(id)) AS id, checks_before_ok AS b, checks_after_ok AS a, result_reason AS why, is_opportunity AS o, average, min_fit FROM findings WHERE trim(id) <> '')
SELECT id, CASE WHEN b AND a THEN 'changed' WHEN b AND NOT a THEN 'reverted' WHEN why IS NOT NULL THEN 'skipped' WHEN o THEN 'preview' ELSE 'left' END AS result,
CASE WHEN (b AND NOT a) OR why IS NOT NULL THEN nullif(substr(coalesce(CASE WHEN b AND NOT a THEN coalesce(why, '') END, why), 1, 120), '') END AS reason, round(CAST(average AS DOUBLE), 3) AS average, round(CAST(min_fit AS DOUBLE), 2) AS min_fit FROM f"""
)
def finding_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each finding, from the lists of those changed, taken back and skipped."""
    f = findings(spark, sf_dir, "checks_before_ok", "checks_after_ok", "result_reason", "is_opportunity", "average", "min_fit").withColumnRenamed("result_reason", "reason")
    ids = lambda test: f.where(test).select("id", "reason")
    rows = f.select("id", "is_opportunity", F.round(F.col("average").cast("double"), 3).alias("average"), F.round(F.col("min_fit").cast("double"), 2).alias("min_fit"))
    done = result_of(rows, ids("checks_before_ok and checks_after_ok"), ids("checks_before_ok and not checks_after_ok"), ids("reason is not null"), F.col("is_opportunity"))
    return done.drop("is_opportunity")


@BOOK.add(
    r"""WITH r AS (SELECT lower(trim("promptId")) AS id, any_value(string_split("prompt", chr(10) || '===')[1]) AS h FROM gemini_prompts WHERE trim("promptId") <> '' GROUP BY 1),
v AS (SELECT id || w AS id, CASE w WHEN ':plain' THEN 'Here it is: ' || h || ' That is all.' WHEN ':fence' THEN '```json' || chr(10) || h || chr(10) || '```' WHEN ':cut' THEN substr(h, 1, 20) WHEN ':list' THEN '[1, 2]' ELSE '  ' END AS raw FROM r, (VALUES (':plain'), (':fence'), (':cut'), (':list'), (':blank')) t(w)),
i AS (SELECT id, raw, CASE WHEN contains(raw, '```') THEN trim(substr(raw, 9, length(raw) - 12), ' ' || chr(10)) ELSE trim(raw) END AS i FROM v),
b AS (SELECT id, raw, CASE WHEN NOT starts_with(i, '{') AND contains(i, '{') AND contains(i, '}') THEN regexp_extract(i, '(?s)(\{.*\})', 1) ELSE i END AS b FROM i),
j AS (SELECT id, CASE WHEN raw IS NULL OR trim(raw) = '' THEN 'empty response' WHEN NOT json_valid(b) THEN 'response is not valid JSON' WHEN json_type(b) <> 'OBJECT' THEN 'response is not a JSON object' END AS error, CASE WHEN json_valid(b) AND json_type(b) = 'OBJECT' THEN CAST(b AS JSON) END AS o FROM b),
f AS (SELECT id, error, o, CASE WHEN json_type(o, '$.candidate.function') = 'VARCHAR' THEN trim(regexp_replace(o->>'$.candidate.function', '\s+', ' ', 'g')) ELSE '' END AS fn, CASE WHEN json_type(o, '$.candidate.detected_outcomes.values') = 'ARRAY' THEN CAST(o->'$.candidate.detected_outcomes.values' AS VARCHAR[])[1:3] ELSE [] END AS outcomes FROM j)
SELECT id, error, coalesce(fn, '') AS fn, outcomes, CASE WHEN o->>'$.candidate.detected_outcomes.kind' IN ('boolean', 'enumerated', 'numeric') THEN o->>'$.candidate.detected_outcomes.kind' ELSE 'unclear' END AS kind, CASE WHEN error IS NULL THEN list_filter([CASE WHEN coalesce(fn, '') = '' THEN 'function is required' END, CASE WHEN len(outcomes) < 2 THEN 'fewer than two outcomes' END, CASE WHEN json_type(o, '$.round') NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'round must be a number' END], lambda x: x IS NOT NULL) END AS problems FROM f"""
)
def read_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of prompts as answers in prose, in a fence, cut short, of the wrong kind and blank: what is read from them and what is wrong with them."""
    key = key_or_null("promptId")
    head = table(spark, sf_dir, "gemini_prompts").where(key.isNotNull()).groupBy(key.alias("id")).agg(F.any_value(F.split("prompt", "\n===")[0]).alias("h"))
    ways = {":plain": F.concat(F.lit("Here it is: "), "h", F.lit(" That is all.")), ":fence": F.concat(F.lit("```json\n"), "h", F.lit("\n```")), ":cut": F.substring("h", 1, 20), ":list": F.lit("[1, 2]"), ":blank": F.lit("  ")}
    raw = head.select(F.col("id").alias("key"), F.explode(F.create_map(*[x for name, way in ways.items() for x in (F.lit(name), way)])).alias("way", "raw"))
    tried = raw.select(F.concat("key", "way").alias("id"), "raw", answers.parsed(F.col("raw")).alias("v"))
    rows = tried.select("id", answers.problem(F.col("raw"), F.col("v")).alias("error"), "v").withColumn("v", F.when(F.col("error").isNull(), F.col("v")))
    fn, outcomes = answers.said(answers.at(F.col("v"), "$.candidate.function")), answers.texts(answers.at(F.col("v"), "$.candidate.detected_outcomes.values"), 3)
    rules = {"function is required": fn == "", "fewer than two outcomes": F.size(outcomes) < 2, "round must be a number": answers.kind_of(answers.at(F.col("v"), "$.round")) != "number"}
    return rows.select("id", "error", fn.alias("fn"), outcomes.alias("outcomes"), answers.one_of(answers.at(F.col("v"), "$.candidate.detected_outcomes.kind"), ("boolean", "enumerated", "numeric"), "unclear").alias("kind"), F.when(F.col("error").isNull(), answers.problems(rules)).alias("problems"))
