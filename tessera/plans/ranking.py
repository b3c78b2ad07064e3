"""Windows, rankings, packing, intervals and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.common import iso_ts, key_or_null, norm_key, table
from tessera.functions import text
from tessera.operators import folds, graph, intervals
from tessera.plans.datasets import CURRENT, entries, findings
from tessera.plans.evidence import _U, contrasts, runs, usages
from tessera.plans.registry import Book

BOOK = Book()
W = Window.partitionBy


@BOOK.add(CURRENT + "SELECT id, row_number() OVER (PARTITION BY project, file, unit.name ORDER BY unit.start, id) - 1 AS ordinal FROM e")
def ordinals(spark, sf_dir):
    """The ordinal of a unit among those of its name in a file; such groups are small."""
    e = entries(spark, sf_dir, "file", "unit")
    return e.select("id", (F.row_number().over(W("project", "file", "unit.name").orderBy("unit.start", "id")) - 1).alias("ordinal"))


@BOOK.add(CURRENT + 'SELECT project, "suggestedPrimitive" AS top, n FROM (SELECT project, "suggestedPrimitive", count(*) AS n FROM e GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY project ORDER BY n DESC, "suggestedPrimitive") = 1')
def top_value(spark, sf_dir):
    """The most frequent value; ties by value."""
    n = entries(spark, sf_dir, "suggestedPrimitive").groupBy("project", F.col("suggestedPrimitive").alias("value")).agg(F.count("*").alias("n"))
    return n.groupBy("project").agg(F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value"))).alias("b")).select("project", F.col("b.value").alias("top"), F.col("b.n").alias("n"))


@BOOK.add("WITH f AS (SELECT DISTINCT ON (lower(trim(id))) lower(trim(id)) AS id, lower(trim(repo_id)) AS repo_id, path_kind, average FROM findings) SELECT repo_id, path_kind, arg_min(id, (-average, id)) AS id, max(average) AS average FROM f WHERE average IS NOT NULL GROUP BY ALL")
def best_finding(spark, sf_dir):
    """The best finding of each repository and kind of path."""
    f = findings(spark, sf_dir, "repo_id", "path_kind", "average").withColumn("repo_id", norm_key("repo_id")).where("average is not null")
    return f.groupBy("repo_id", "path_kind").agg(F.min_by("id", F.struct(-F.col("average"), F.col("id"))).alias("id"), F.max("average").alias("average"))


@BOOK.add("""SELECT user_id, event_type, min(event_id) AS first_event, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events) GROUP BY user_id, event_type, island HAVING count(*) >= 2""")
def islands(spark, sf_dir):
    """Runs of two or more equal events of a user."""
    order = [F.col("ts"), F.col("event_id")]
    marked = table(spark, sf_dir, "events").withColumn("island", F.row_number().over(W("user_id").orderBy(*order)) - F.row_number().over(W("user_id", "event_type").orderBy(*order)))
    return marked.groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).where("n >= 2").drop("island")


_HITS = "(SELECT id, list_filter(range(1, len(string_split(code, chr(10))) + 1), lambda i: contains(string_split(code, chr(10))[i], 'return')) AS hits FROM e WHERE code IS NOT NULL)"


@BOOK.add(CURRENT + f"SELECT id, list_reduce(list_transform(hits, lambda h: [h]), lambda a, h: CASE WHEN h[1] - a[-1] >= 5 THEN list_concat(a, h) ELSE a END) AS kept FROM {_HITS} WHERE len(hits) > 0")
def spaced_hits(spark, sf_dir):
    """W09, SRC10: lines with a hit, each at least five lines after the last one kept; a fold inside the JVM."""
    lines = F.split("code", "\n")
    hits = F.filter(F.transform(lines, lambda x, i: F.when(x.contains("return"), (i + 1).cast("long"))), lambda x: x.isNotNull())
    kept = F.aggregate(hits, F.array().cast("array<bigint>"), lambda a, h: F.when((F.size(a) == 0) | (h - F.element_at(a, -1) >= 5), F.concat(a, F.array(h))).otherwise(a))
    e = entries(spark, sf_dir, "code").where("code is not null")
    return e.select("id", kept.alias("kept")).where(F.size("kept") > 0)


@BOOK.add(_U + """, d AS (SELECT project, site, s, array_to_string(list_sort(list_transform(s.questions, lambda q: q.primitive || ':' || coalesce(q.key, '') || ':' || coalesce(q.text, ''))), '|') AS sig FROM u WHERE s.role = 'decision' AND s.tier <> 'uncertain'),
o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY list_position(['certain', 'likely', 'uncertain'], s.tier), len(s.questions) DESC, s.file, s.unit.start, site) AS pos FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY project, sig ORDER BY pos) AS nth FROM o) SELECT project, site AS site_id, row_number() OVER (PARTITION BY project ORDER BY pos) AS anchor FROM k WHERE nth = 1 OR coalesce(sig, '') = ''""")
def anchors(spark, sf_dir):
    """Decision sites in order, those that ask the same questions once; sites without questions are never dropped."""
    u = usages(spark, sf_dir).where("site.role = 'decision' and site.tier <> 'uncertain'")
    sig = F.array_join(F.array_sort(F.transform("site.questions", lambda q: F.concat(q["primitive"], F.lit(":"), F.coalesce(q["key"], F.lit("")), F.lit(":"), F.coalesce(q["text"], F.lit(""))))), "|")
    order = [F.array_position(F.array(*map(F.lit, ("certain", "likely", "uncertain"))), F.col("site.tier")), F.desc(F.size("site.questions")), F.col("site.file"), F.col("site.unit.start"), F.col("site_id")]
    o = u.withColumn("sig", sig).withColumn("pos", F.row_number().over(W("project").orderBy(*order)))
    k = o.withColumn("nth", F.row_number().over(W("project", "sig").orderBy("pos"))).where("nth = 1 or sig = ''")
    return k.select("project", "site_id", F.row_number().over(W("project").orderBy("pos")).alias("anchor"))


@BOOK.add(CURRENT + "SELECT id, row_number() OVER (PARTITION BY project ORDER BY file, unit.start, id) AS stored, row_number() OVER (PARTITION BY project ORDER BY len(generators) DESC, file, unit.start, id) AS proposed, row_number() OVER (PARTITION BY project ORDER BY CASE WHEN auto.source = 'triage' THEN 2 WHEN human IS NULL OR \"needsRecheck\" THEN 0 ELSE 1 END, file, unit.start, id) AS review, row_number() OVER (PARTITION BY project ORDER BY CASE WHEN auto.source = 'typesafe' AND auto.label <> 'NOT_JEV' THEN 0 ELSE 1 END, auto.answers.judgment DESC NULLS LAST, file, unit.start, id) AS detected FROM e")
def entry_orders(spark, sf_dir):
    """The order in which entries are stored, proposed, reviewed and detected (validated first, then by score), within a project."""
    e = entries(spark, sf_dir, "file", "unit", "generators", "auto", "human", "needsRecheck")
    tail = [F.col("file"), F.col("unit.start"), F.col("id")]
    queue = F.when(F.col("auto.source") == "triage", 2).when(F.col("human").isNull() | F.coalesce("needsRecheck", F.lit(False)), 0).otherwise(1)
    confirmed = F.when((F.col("auto.source") == "typesafe") & (F.col("auto.label") != "NOT_JEV"), 0).otherwise(1)
    n = lambda *o: F.row_number().over(W("project").orderBy(*o, *tail))
    return e.select("id", n().alias("stored"), n(F.desc(F.size("generators"))).alias("proposed"), n(queue).alias("review"), n(confirmed, F.col("auto.answers.judgment").desc_nulls_last()).alias("detected"))


@BOOK.add("WITH f AS (SELECT DISTINCT ON (lower(trim(id))) lower(trim(id)) AS id, status, average, verdict FROM findings) SELECT id, status, average FROM f ORDER BY list_position(['strong', 'possible', 'review', 'weak', 'not_opportunity'], status), average DESC NULLS LAST, id LIMIT 100")
def top_findings(spark, sf_dir):
    """T03, SNK06: the first hundred by status and average; the limit is the report's."""
    at = F.array_position(F.array(*map(F.lit, ("strong", "possible", "review", "weak", "not_opportunity"))), F.col("status"))
    return findings(spark, sf_dir, "status", "average").orderBy(at, F.col("average").desc_nulls_last(), "id").select("id", "status", "average").limit(100)


@BOOK.add("WITH f AS (SELECT DISTINCT ON (lower(trim(id))) * FROM findings) SELECT CASE WHEN average >= 0.5 AND verdict <> 'WEAK_FIT' THEN 'main' ELSE 'rest' END AS part, count(*) AS findings, count(*) FILTER (WHERE verdict = 'STRONG_FIT') AS strong, count(*) FILTER (WHERE verdict = 'POSSIBLE_FIT') AS possible FROM f GROUP BY 1")
def result_parts(spark, sf_dir):
    """T14, X04"""
    part = F.when((F.col("average") >= 0.5) & (F.col("verdict") != "WEAK_FIT"), "main").otherwise("rest")
    return findings(spark, sf_dir, "average", "verdict").groupBy(part.alias("part")).agg(F.count("*").alias("findings"), F.count_if(F.col("verdict") == "STRONG_FIT").alias("strong"), F.count_if(F.col("verdict") == "POSSIBLE_FIT").alias("possible"))


@BOOK.add(CURRENT + "SELECT id, list_transform(generators, lambda g: g.generator)[1:2] AS generators, len(list_distinct(list_transform(inputs, lambda i: i.provenance))) AS provenances, list_sort(list_distinct(list_transform(inputs, lambda i: i.provenance)))[1:3] AS first_provenances FROM e")
def capped_lists(spark, sf_dir):
    """Capped lists and counters over nested facts."""
    kinds = F.array_distinct(F.col("inputs.provenance"))
    return entries(spark, sf_dir, "generators", "inputs").select("id", F.slice("generators.generator", 1, 2).alias("generators"), F.size(kinds).cast("long").alias("provenances"), F.slice(F.sort_array(kinds), 1, 3).alias("first_provenances"))


@BOOK.add(CURRENT + "SELECT generator, count(*) AS entries, count(DISTINCT project) AS projects, count(*) FILTER (WHERE human IS NOT NULL) AS labelled FROM (SELECT e.project, human, unnest(list_distinct(list_transform(generators, lambda g: g.generator))) AS generator FROM e) GROUP BY generator")
def generator_counts(spark, sf_dir):
    """How often each generator fired."""
    e = entries(spark, sf_dir, "generators", "human").select("project", "human", F.explode(F.array_distinct("generators.generator")).alias("generator"))
    return e.groupBy("generator").agg(F.count("*").alias("entries"), F.countDistinct("project").alias("projects"), F.count_if(F.col("human").isNotNull()).alias("labelled"))


@BOOK.add(CURRENT + """SELECT id, CASE WHEN len(inputs) > 0 AND len(list_filter(inputs, lambda i: i.provenance = 'caught_error')) = len(inputs) THEN 'library_error_text' WHEN len(inputs) > 0 AND len(list_filter(inputs, lambda i: i.provenance = 'env_config')) = len(inputs) THEN 'feature_flag'
WHEN len(inputs) > 0 AND len(list_filter(inputs, lambda i: i."closedType")) = len(inputs) THEN 'enum_dispatch' WHEN len(inputs) > 0 AND len(list_filter(inputs, lambda i: i.provenance = 'ui_event')) = len(inputs) THEN 'ui_plumbing' WHEN outputs.kind = 'numeric' AND features['conditions'] = 0 THEN 'arithmetic' WHEN features['conditions'] = 0 AND len(generators) = 0 THEN 'trivial_guard' END AS reason FROM e""")
def triage(spark, sf_dir):
    """P27 on the facts that entries store, six of its rules; `proposals` has all twelve."""
    every = lambda f: (F.size("inputs") > 0) & F.forall("inputs", f)
    prov = lambda p: every(lambda i: F.coalesce(i["provenance"] == p, F.lit(False)))
    e = entries(spark, sf_dir, "inputs", "outputs", "generators").join(entries_features(spark, sf_dir), "id", "left")
    reason = (
        F.when(prov("caught_error"), "library_error_text")
        .when(prov("env_config"), "feature_flag")
        .when(every(lambda i: F.coalesce(i["closedType"], F.lit(False))), "enum_dispatch")
        .when(prov("ui_event"), "ui_plumbing")
        .when((F.col("outputs.kind") == "numeric") & (F.col("conditions") == 0), "arithmetic")
        .when((F.col("conditions") == 0) & (F.size("generators") == 0), "trivial_guard")
    )
    return e.select("id", reason.alias("reason"))


def entries_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`id` and the feature `conditions` of current entries; a map can't be ordered, so it is taken apart before the latest row is found."""
    rows = table(spark, sf_dir, "entries").select(key_or_null("id").alias("id"), iso_ts("updatedAt").alias("ts"), F.col("features")["conditions"].alias("conditions"))
    return rows.where("id is not null").groupBy("id").agg(F.max_by("conditions", F.struct("ts", "conditions")).alias("conditions"))


_CALLS = _U + """, pt AS (SELECT project, site AS point, s.file AS file, unnest(s.calls).line AS line FROM u), iv AS (SELECT DISTINCT lower(trim(project)) AS project, contrast.file AS file, contrast.unit.start AS start, contrast.unit.end AS "end", contrast.unit.name AS name FROM contrasts UNION SELECT project, s.file, s.unit.start, s.unit.end, s.unit.name FROM u)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usages(spark, sf_dir).select("project", F.col("site_id").alias("point"), F.col("site.file").alias("file"), F.explode("site.calls").alias("c")).select("project", "point", "file", F.col("c.line").alias("line"))


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usages(spark, sf_dir).select("project", F.col("site.file").alias("file"), "site.unit.start", "site.unit.end", "site.unit.name")
    c = table(spark, sf_dir, "contrasts").select(norm_key("project").alias("project"), F.col("contrast.file").alias("file"), "contrast.unit.start", "contrast.unit.end", "contrast.unit.name")
    return u.unionByName(c).distinct()


@BOOK.add(_CALLS + """SELECT project, file, point, line, start, "end", name FROM pt JOIN iv USING (project, file) WHERE line BETWEEN start AND "end" QUALIFY row_number() OVER (PARTITION BY project, file, point, line ORDER BY start DESC, "end", name DESC) = 1""")
def innermost_interval(spark, sf_dir):
    """The innermost unit that holds each call."""
    return intervals.innermost(_points(spark, sf_dir), _intervals(spark, sf_dir), ["project", "file"], "point")


_CI = """SELECT DISTINCT lower(trim(contrast.id)) AS id, lower(trim(project)) AS project, contrast.file AS file, contrast.unit.start AS start, contrast.unit.end AS "end" FROM contrasts"""


def _contrast_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "contrasts").select(key_or_null("contrast.id").alias("id"), norm_key("project").alias("project"), F.col("contrast.file").alias("file"), "contrast.unit.start", "contrast.unit.end").distinct()


@BOOK.add(_U + f""", k AS ({_CI}) SELECT k.project, k.file, k.id AS left_id, u.site AS right_id FROM k JOIN u ON u.project = k.project AND u.s.file = k.file WHERE k.start <= u.s.unit.end AND u.s.unit.start <= k."end" """)
def interval_overlap(spark, sf_dir):
    """Contrasts that share lines with a usage."""
    u = usages(spark, sf_dir).select("project", F.col("site.file").alias("file"), "site_id", "site.unit.start", "site.unit.end")
    return intervals.overlapping(_contrast_units(spark, sf_dir), u, ["project", "file"], "id", "site_id")


_BY_CONFIDENCE = """WITH RECURSIVE c AS (SELECT DISTINCT lower(trim(contrast.id)) AS id, lower(trim(project)) AS project, contrast.file AS file, contrast.unit.start AS a, contrast.unit.end AS b, list_position(['high', 'medium', 'low'], facts.confidence) AS sure FROM contrasts WHERE trim(contrast.id) <> '' AND contrast.file IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY project, file ORDER BY sure NULLS LAST, a, id) AS n FROM c),
r AS (SELECT project, file, n, id, true AS kept, [{'a': a, 'b': b}] AS held FROM o WHERE n = 1
UNION ALL SELECT project, file, n, id, free, CASE WHEN free THEN list_concat(held, [{'a': a, 'b': b}]) ELSE held END FROM (SELECT o.project, o.file, o.n, o.id, o.a, o.b, r.held, len(list_filter(r.held, lambda x: x.a <= o.b AND o.a <= x.b)) = 0 AS free FROM r JOIN o ON o.project = r.project AND o.file = r.file AND o.n = r.n + 1))
SELECT project, file, id, kept FROM r"""


@BOOK.add(_BY_CONFIDENCE)
def kept_intervals(spark, sf_dir):
    """Contrasts of a file in the order of their confidence, each kept if it overlaps none kept before."""
    sure = F.array_position(F.array(*map(F.lit, ("high", "medium", "low"))), F.col("facts.confidence"))
    c = table(spark, sf_dir, "contrasts").select(key_or_null("contrast.id").alias("id"), norm_key("project").alias("project"), F.col("contrast.file").alias("file"), "contrast.unit.start", "contrast.unit.end", F.nullif(sure, F.lit(0)).alias("sure"))
    rows = c.where("id is not null and file is not null").distinct()
    return folds.no_overlap(rows, ["project", "file"], [F.col("sure").asc_nulls_last(), F.col("start"), F.col("id")], "id", "project string, file string, id string, kept boolean")


@BOOK.add(_U + f""", k AS ({_CI}), j AS (SELECT u.project, u.site AS site_id, k.id, CASE WHEN k.file = u.s.file AND k.start >= u.s.unit.start AND k."end" <= u.s.unit.end THEN 0 WHEN k.file = u.s.file THEN 1 ELSE 2 END AS tier, CASE WHEN k.file = u.s.file THEN abs(k.start - u.s.unit.start) ELSE 100000 END AS distance FROM u JOIN k ON k.project = u.project JOIN contrasts x ON lower(trim(x.contrast.id)) = k.id AND lower(trim(x."siteId")) = u.site)
SELECT project, site_id, id, tier, distance, row_number() OVER (PARTITION BY project, site_id ORDER BY tier, distance, id) AS rank FROM (SELECT DISTINCT * FROM j) QUALIFY row_number() OVER (PARTITION BY project, site_id ORDER BY tier, distance, id) <= 3""")
def nearest_contrasts(spark, sf_dir):
    """The three nearest contrasts of each usage: same function, same file, related file; then by distance."""
    u = usages(spark, sf_dir).select("project", "site_id", F.col("site.file").alias("uf"), F.col("site.unit.start").alias("us"), F.col("site.unit.end").alias("ue"))
    pairs = contrasts(spark, sf_dir).select("id", F.col("site").alias("site_id"), "project").join(_contrast_units(spark, sf_dir), ["id", "project"])
    j = u.join(pairs, ["project", "site_id"])
    same = F.col("file") == F.col("uf")
    tier = F.when(same & (F.col("start") >= F.col("us")) & (F.col("end") <= F.col("ue")), 0).when(same, 1).otherwise(2)
    ranked = j.select("project", "site_id", "id", tier.alias("tier"), F.when(same, F.abs(F.col("start") - F.col("us"))).otherwise(F.lit(100000)).cast("long").alias("distance")).distinct()
    return ranked.withColumn("rank", F.row_number().over(W("project", "site_id").orderBy("tier", "distance", "id"))).where("rank <= 3")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source, id, size and score of every document; those without source are one group, null texts have no size."""
    body = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.length(body).cast("long").alias("size"), text.signal_score(body).alias("score"))


_D = "WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {order}) AS n FROM (SELECT coalesce(source, '') AS source, doc_id, length(coalesce(text, '')) AS size{more} FROM documents))"
_PLAN = _D.format(order="size DESC, doc_id", more="") + """,
r AS (SELECT source, n, doc_id, size, size <= 20000 AS taken, CASE WHEN size <= 20000 THEN size ELSE 0 END AS used FROM d WHERE n = 1
UNION ALL SELECT d.source, d.n, d.doc_id, d.size, r.used + d.size <= 20000, r.used + CASE WHEN r.used + d.size <= 20000 THEN d.size ELSE 0 END FROM r JOIN d ON d.source = r.source AND d.n = r.n + 1)"""


@BOOK.add(_PLAN + "SELECT source, doc_id, taken, CAST(used AS BIGINT) AS used FROM r")
def read_plan(spark, sf_dir):
    """Per source the largest texts first, within a budget; a smaller one may fit where a larger didn't."""
    return folds.budget_with_skip(_sized(spark, sf_dir).drop("score"), ["source"], [F.desc("size"), F.col("doc_id")], "doc_id", "size", 20000, "source string, doc_id long, taken boolean, used long")


@BOOK.add(_PLAN + "SELECT source, count(*) FILTER (WHERE taken) AS read, count(*) FILTER (WHERE NOT taken) AS unread, CASE WHEN sum(size) > 0 THEN CAST(sum(size) FILTER (WHERE taken) AS DOUBLE) / sum(size) ELSE 1 END AS coverage FROM r GROUP BY source")
def read_coverage(spark, sf_dir):
    """How much of each source a plan reads."""
    j = read_plan(spark, sf_dir).join(_sized(spark, sf_dir).select("doc_id", "size"), "doc_id")
    share = F.sum(F.when(F.col("taken"), F.col("size"))) / F.sum("size")
    return j.groupBy("source").agg(F.count_if("taken").alias("read"), F.count_if(~F.col("taken")).alias("unread"), F.when(F.sum("size") > 0, share).otherwise(F.lit(1.0)).alias("coverage"))


@BOOK.add("""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: {'a': i, 'b': i, 'z': length(x) + 8}) AS l FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN a[-1].z + x[1].z <= 3600 THEN list_concat(a[1:len(a) - 1], [{'a': a[-1].a, 'b': x[1].b, 'z': a[-1].z + x[1].z}]) ELSE list_concat(a, x) END)) AS p FROM l)
SELECT doc_id, p.a AS start, p.b AS "end", p.z AS size FROM p""")
def read_pieces(spark, sf_dir):
    """Texts cut between lines into pieces of a size, each line counting eight more for its number; a line that is larger is a piece."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("start"), (i + 1).cast("long").alias("end"), (F.length(x) + 8).cast("long").alias("size")))
    last = lambda a: F.element_at(a, -1)

    def step(a, x):
        joined = F.struct(last(a)["start"].alias("start"), x["end"].alias("end"), (last(a)["size"] + x["size"]).alias("size"))
        return F.when((F.size(a) > 0) & (last(a)["size"] + x["size"] <= 3600), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(a, F.array(x)))

    pieces = F.aggregate(lines, F.array().cast("array<struct<start:bigint,end:bigint,size:bigint>>"), step)
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.inline(pieces))


@BOOK.add(_D.format(order="doc_id", more="") + """,
r AS (SELECT source, n, doc_id, 0 AS part, size AS used FROM d WHERE n = 1
UNION ALL SELECT d.source, d.n, d.doc_id, CASE WHEN r.used > 0 AND r.used + d.size > 8000 THEN r.part + 1 ELSE r.part END, CASE WHEN r.used > 0 AND r.used + d.size > 8000 THEN d.size ELSE r.used + d.size END FROM r JOIN d ON d.source = r.source AND d.n = r.n + 1)
SELECT source, doc_id, part FROM r""")
def prompt_parts(spark, sf_dir):
    """Texts of a source in order, packed into parts of a size."""
    return folds.next_fit(_sized(spark, sf_dir).drop("score"), ["source"], [F.col("doc_id")], "doc_id", "size", 8000, "source string, doc_id long, part int")


_SCORED = r""", CAST(2 * (len(regexp_extract_all(coalesce(text, ''), '/[^/\n]{3,}/[gimsuy]*\.test\(')) + len(regexp_extract_all(coalesce(text, ''), '\.match\(\s*/')) + len(regexp_extract_all(coalesce(text, ''), 're\.(search|match)\(')))
+ 2 * len(regexp_extract_all(coalesce(text, ''), '\[\s*(["''`][\w\s-]{2,}["''`]\s*,\s*){3,}')) + len(regexp_extract_all(coalesce(text, ''), '\.(includes|startsWith|endsWith)\(\s*["''`]')) + len(regexp_extract_all(coalesce(text, ''), '\bin\s+\w+\.lower\(\)'))
+ len(regexp_extract_all(coalesce(text, ''), '\.slice\(\s*0\s*,\s*\d+\s*\)')) + len(regexp_extract_all(coalesce(text, ''), '\[\s*:\s*\d+\s*\]')) + len(regexp_extract_all(coalesce(text, ''), '[<>]=?\s*0\.\d+'))
+ 3 * len(regexp_extract_all(coalesce(text, ''), 'chat\.completions\.create|messages\.create\(|generateContent\(|\.invoke\(|ChatOpenAI|ChatAnthropic|generateText\(|generateObject\(|streamText\(|/chat/completions|/v1/messages|ollama\.|litellm|completion\(\s*model|\bresponse_format\b|structured_output'))
+ 0.5 * len(regexp_extract_all(coalesce(text, ''), 'case\s+["''`][\w\s-]+["''`]\s*:')) AS DOUBLE) AS score"""


@BOOK.add(_D.format(order="score DESC, doc_id", more=_SCORED) + """,
t AS (SELECT *, size + 200 AS s FROM d), r AS (SELECT source, n, doc_id, s <= 60000 AS chosen, CASE WHEN s <= 60000 THEN s ELSE 0 END AS used, CAST(s <= 60000 AS INT) AS k FROM t WHERE n = 1
UNION ALL SELECT source, n, doc_id, c, used + CASE WHEN c THEN s ELSE 0 END, k + CAST(c AS INT) FROM (SELECT t.source, t.n, t.doc_id, t.s, r.used, r.k, r.used + t.s <= 60000 AND NOT (t.score = 0 AND r.k >= 8) AS c FROM r JOIN t ON t.source = r.source AND t.n = r.n + 1))
SELECT source, doc_id, chosen FROM r""")
def prompt_choice(spark, sf_dir):
    """Per source the texts with the highest signals first, within a budget that later ones may still fit; texts without signal only while fewer than eight are chosen."""
    return folds.choose(_sized(spark, sf_dir), ["source"], [F.desc("score"), F.col("doc_id")], "doc_id", "size", "score", 60000, 200, 8, "source string, doc_id long, chosen boolean")


@BOOK.add(_D.format(order="size DESC, doc_id", more="") + """, k AS (SELECT source, CASE WHEN count(*) < 4 THEN 1 ELSE least(8, greatest(2, CAST(ceil(sum(size) / 40000.0) AS INT))) END AS k FROM d GROUP BY source),
s AS (SELECT d.*, k FROM d JOIN k USING (source)), r AS (SELECT source, n, doc_id, 0 AS part, list_transform(range(k), lambda i: CASE WHEN i = 0 THEN size ELSE 0 END) AS sizes FROM s WHERE n = 1
UNION ALL SELECT source, n, doc_id, pos - 1, list_transform(sizes, lambda x, i: CASE WHEN i = pos THEN x + size ELSE x END) FROM (SELECT s.source, s.n, s.doc_id, s.size, r.sizes, list_position(r.sizes, list_min(r.sizes)) AS pos FROM r JOIN s ON s.source = r.source AND s.n = r.n + 1))
SELECT source, doc_id, CAST(part AS INT) AS part FROM r""")
def even_parts(spark, sf_dir):
    """Texts of a source into parts of like size, largest first: one for each 40,000 characters, two to eight, or one for fewer than four texts."""
    rows = _sized(spark, sf_dir).drop("score")
    each = rows.groupBy("source").agg(F.when(F.count("*") < 4, 1).otherwise(F.least(F.lit(8), F.greatest(F.lit(2), F.ceil(F.sum("size") / 40000).cast("int")))).alias("parts"))
    return folds.smallest_first(rows.join(each, "source"), ["source"], [F.desc("size"), F.col("doc_id")], "doc_id", "size", "parts", "source string, doc_id long, part int")


_EDGES = """SELECT DISTINCT project, fn AS src, unnest(regexp_extract_all(p, '"id": "callee:([A-Za-z0-9_]+)"', 1)) AS dst FROM (SELECT lower(trim(project)) AS project, "prompt" AS p, regexp_extract("prompt", '"function": "([^"]+)"', 1) AS fn FROM gemini_prompts WHERE "prompt" IS NOT NULL)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "gemini_prompts").where("prompt is not null")
    callees = F.explode(F.regexp_extract_all("prompt", F.lit(r'"id": "callee:([A-Za-z0-9_]+)"'), F.lit(1)))
    return p.select(norm_key("project").alias("project"), F.regexp_extract("prompt", r'"function": "([^"]+)"', 1).alias("src"), callees.alias("dst")).distinct()


@BOOK.add(f"WITH k AS ({_EDGES}) SELECT src, dst FROM (SELECT src, dst FROM k UNION SELECT dst, src FROM k) WHERE src <> dst")
def undirected_edges(spark, sf_dir):
    """U10"""
    return graph.undirected(_edges(spark, sf_dir))


@BOOK.add("""WITH RECURSIVE g AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_quantity >= 49 UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_quantity >= 49),
stop AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_size > 30),
r(node, level) AS (SELECT 's1', 0 UNION SELECT g.dst, r.level + 1 FROM r JOIN g ON g.src = r.node WHERE r.level < 4 AND r.node NOT IN (SELECT node FROM stop))
SELECT node, min(level) AS level FROM r GROUP BY node""")
def graph_reach(spark, sf_dir):
    """What is within four steps of a supplier over large orders, not passing large parts."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    stop = table(spark, sf_dir, "part").where("p_size > 30").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    return graph.reach(graph.undirected(li), spark.createDataFrame([("s1",)], "node string"), 4, stop)


@BOOK.add("""WITH RECURSIVE t AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders) SELECT o_custkey, o_orderkey, prev_orderkey FROM (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_orderkey FROM t)""")
def previous_order(spark, sf_dir):
    """The row before in a key's order."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(W("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("prev_orderkey"))


@BOOK.add("SELECT n_name, r_name, count(DISTINCT o_orderkey) AS orders, count(*) AS lines, round(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) / 10000.0, 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def revenue_by_nation(spark, sf_dir):
    """Joins and aggregation over the star schema: the facts are aggregated by customer before they meet the dimensions."""
    t = lambda name: table(spark, sf_dir, name)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))
    by_order = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum(cents).alias("cents"))
    by_customer = by_order.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"), F.sum("cents").alias("cents"))
    j = by_customer.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.sum("orders").alias("orders"), F.sum("lines").alias("lines"), F.round(F.sum("cents") / 10000, 2).alias("revenue"))
