"""Scans, scalar functions and projections over documents, entries and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import table
from tessera.functions import generic, paths, text
from tessera.plans.registry import Book

BOOK = Book()


def _case(col: str, rules: tuple, default) -> str:
    """The SQL of `paths.first_match`."""
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE WHEN " + col + " IS NULL THEN NULL " + " ".join(f"WHEN regexp_matches({col}, '{p}') THEN {lit(v)}" for p, v in rules) + f" ELSE {lit(default)} END"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_GEN = "(length(text) > 524288 OR list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 2000 OR (length(text) > 5000 AND length(text) / len(string_split(text, chr(10))) > 300))"


@BOOK.add(f"SELECT doc_id, {_GEN} AS generated FROM documents")
def looks_generated(spark, sf_dir):
    """SRC02"""
    return _docs(spark, sf_dir).select("doc_id", text.looks_generated(F.col("text")).alias("generated"))


_ROLE = _case("path", paths.ROLES, "source")
_REASON = f"CASE WHEN text IS NULL THEN 'unreadable' WHEN trim(text) = '' THEN 'empty' WHEN {_GEN} THEN 'generated' WHEN {_ROLE} IN ('types', 'test', 'story', 'generated', 'config') THEN 'role:' || {_ROLE} END"


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = paths.file_role(F.col("path"))
    reason = F.when(F.col("text").isNull(), "unreadable").when(F.trim("text") == "", "empty").when(text.looks_generated(F.col("text")), "generated").when(role.isin("types", "test", "story", "generated", "config"), F.concat(F.lit("role:"), role))
    return _docs(spark, sf_dir).withColumn("reason", reason)


@BOOK.add(f"SELECT doc_id, path, {_REASON} AS reason FROM documents WHERE {_REASON} IS NOT NULL")
def scan_skipped(spark, sf_dir):
    """SRC03, X04: files left out of a scan and why; a file never fails it."""
    return _scanned(spark, sf_dir).where("reason is not null").select("doc_id", "path", "reason")


@BOOK.add(f"SELECT kind, count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE {_REASON} IS NULL GROUP BY kind")
def scan_kept(spark, sf_dir):
    """SRC01, SRC03: what a scan keeps."""
    return _scanned(spark, sf_dir).where("reason is null").groupBy("kind").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))


@BOOK.add("SELECT doc_id, kind, n_chars, length(text) AS chars, n_chars IS DISTINCT FROM length(text) AS out_of_date FROM documents WHERE n_chars IS DISTINCT FROM length(text)")
def stale_lengths(spark, sf_dir):
    """Documents whose stored length is out of date."""
    return _docs(spark, sf_dir).select("doc_id", "kind", "n_chars", F.length("text").cast("long").alias("chars"), (~F.col("n_chars").eqNullSafe(F.length("text"))).alias("out_of_date")).where("out_of_date")


_ENTRY_PATHS = "(SELECT DISTINCT file AS path FROM entries UNION SELECT DISTINCT path FROM documents WHERE path IS NOT NULL)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "entries").select(F.col("file").alias("path"))
    return files.unionByName(_docs(spark, sf_dir).select("path")).where("path is not null").distinct()


_PRIOR = f"(2 * CAST(regexp_matches(lower(path), '{_q(paths.LOGIC)}') AS INT) + 3 * CAST(regexp_matches(string_split(lower(path), '/')[-1], '{paths.DECIDES}') AS INT) - CAST(regexp_matches(lower(path), '{paths.SURFACE}') AS INT) - 0.5 * CAST(regexp_matches(path, '\\.(tsx|jsx)$') AS INT))"


@BOOK.add(
    f"SELECT path, {_ROLE} AS role, {_case('path', paths.KINDS, 'other')} AS kind, {_case('lower(path)', paths.LANGUAGES, 'other')} AS language, {_case('lower(path)', paths.PRIORITIES, 0)} AS priority, regexp_matches(path, '{paths.NOT_READ}') AS skipped, CAST({_PRIOR} AS DOUBLE) AS prior FROM {_ENTRY_PATHS}"
)
def path_facts(spark, sf_dir):
    """Role, language, kind, reading order and prior of every path."""
    p = F.col("path")
    return _paths(spark, sf_dir).select("path", paths.file_role(p).alias("role"), paths.path_kind(p).alias("kind"), paths.language_of(p).alias("language"), paths.read_priority(p).alias("priority"), paths.not_read(p).alias("skipped"), paths.prior(p).alias("prior"))


@BOOK.add(f"SELECT role, count(*) AS files, list_sort(list(DISTINCT language)) AS languages FROM (SELECT {_ROLE} AS role, {_case('lower(path)', paths.LANGUAGES, 'other')} AS language FROM {_ENTRY_PATHS}) GROUP BY role")
def role_histogram(spark, sf_dir):
    """A17"""
    p = F.col("path")
    return _paths(spark, sf_dir).select(paths.file_role(p).alias("role"), paths.language_of(p).alias("language")).groupBy("role").agg(F.count("*").alias("files"), F.sort_array(F.collect_set("language")).alias("languages"))


@BOOK.add(f"SELECT path, chars, prior FROM (SELECT path, length(text) AS chars, {_PRIOR} AS prior FROM documents WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx|mjs|cjs|py)$') AND length(text) >= 300) ORDER BY prior DESC, chars DESC, path LIMIT 60")
def pick_files(spark, sf_dir):
    """The files to look at first; the limit is the report's."""
    files = _docs(spark, sf_dir).where(F.col("path").rlike(r"\.(ts|tsx|js|jsx|mjs|cjs|py)$") & (F.length("text") >= 300))
    return files.select("path", F.length("text").alias("chars"), paths.prior(F.col("path")).alias("prior")).orderBy(F.desc("prior"), F.desc("chars"), "path").limit(60)


_TOKENS = r"list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: lower(x))"


@BOOK.add(f"SELECT name, {_TOKENS} AS tokens FROM (SELECT DISTINCT unit.name AS name FROM entries WHERE unit.name IS NOT NULL)")
def name_tokens(spark, sf_dir):
    """P06"""
    return table(spark, sf_dir, "entries").select(F.col("unit.name").alias("name")).where("name is not null").distinct().select("name", text.name_tokens(F.col("name")).alias("tokens"))


_WORDLIST = ", ".join(f"'{w}'" for w in text.NOT_NATURAL)
_CODE_TOKEN = "(len(string_split_regex(trim(v), '[ \\t\\r\\n\\f]+')) > 1 AND len(list_filter(string_split_regex(trim(v), '[ \\t\\r\\n\\f]+'), lambda w: regexp_matches(w, '^[A-Z]{2,4}$'))) > 0)"
_WORD_LIKE = f"(length(trim(v)) BETWEEN 2 AND 60 AND NOT {_CODE_TOKEN} AND regexp_matches(trim(v), '^[A-Za-z][A-Za-z'' _-]*[A-Za-z]$') AND NOT (regexp_matches(trim(v), '^[A-Z0-9_]+$') AND contains(trim(v), '_')) AND NOT regexp_matches(trim(v), '[a-z][A-Z]') AND NOT regexp_matches(trim(v), '^[a-z]+(-[a-z]+)+$') AND lower(trim(v)) NOT IN ({_WORDLIST}))"


@BOOK.add(
    f"SELECT v AS value, {_WORD_LIKE} AS word_like, (NOT {_CODE_TOKEN} AND len(list_filter(string_split_regex(trim(v), '[ \\t\\r\\n\\f]+'), lambda w: regexp_matches(w, '[A-Za-z]{{2,}}'))) >= 2) AS multi_word FROM (SELECT DISTINCT unnest(outputs.values) AS v FROM entries UNION SELECT DISTINCT rule_shape FROM findings WHERE rule_shape IS NOT NULL)"
)
def word_like(spark, sf_dir):
    """Outcome values and rule shapes by whether they are natural words."""
    values = table(spark, sf_dir, "entries").select(F.explode("outputs.values").alias("value")).unionByName(table(spark, sf_dir, "findings").select(F.col("rule_shape").alias("value")).where("value is not null")).distinct()
    v = F.col("value")
    return values.select("value", text.is_word_like(v).alias("word_like"), text.is_multi_word(v).alias("multi_word"))


_RX = r"""regexp_extract_all(code, 'if \(/([^/\n]+)/i?\.test', 1)"""


@BOOK.add(f"SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(p, '[^A-Za-z'' ]+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '[a-z][A-Z]') AND regexp_matches(w, '^[A-Za-z][A-Za-z'' _-]*[A-Za-z]$') AND lower(w) NOT IN ({_WORDLIST}))) AS word FROM (SELECT unnest({_RX}) AS p FROM entries)) GROUP BY word")
def pattern_words(spark, sf_dir):
    """Words that the code's patterns look for."""
    found = table(spark, sf_dir, "entries").select(F.explode(F.regexp_extract_all("code", F.lit(r"if \(/([^/\n]+)/i?\.test"), F.lit(1))).alias("p"))
    return found.select(F.explode(text.pattern_words(F.col("p"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


_SLUG = "nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(decision), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', ''), '')"


@BOOK.add(f"SELECT DISTINCT decision, {_SLUG} AS slug FROM findings")
def slugs(spark, sf_dir):
    """P09"""
    return table(spark, sf_dir, "findings").select("decision", text.slugify(F.col("decision")).alias("slug")).distinct()


def _scrub_sql(col: str) -> str:
    for p in text.SECRET_PATTERNS:
        col = f"regexp_replace({col}, '{_q(p)}', '[REDACTED]', 'g')"
    return col


def _scrub_count_sql(col: str) -> str:
    n = []
    for p in text.SECRET_PATTERNS:
        n.append(f"len(regexp_extract_all({col}, '{_q(p)}'))")
        col = f"regexp_replace({col}, '{_q(p)}', '[REDACTED]', 'g')"
    return " + ".join(n)


@BOOK.add(f"SELECT DISTINCT id, sha256({_scrub_sql('code')}) AS scrubbed, {_scrub_count_sql('code')} AS redactions FROM entries WHERE code IS NOT NULL")
def secret_scrub(spark, sf_dir):
    """P10: credentials by shape, and how many were replaced."""
    c = F.col("code")
    return table(spark, sf_dir, "entries").where("code is not null").select("id", F.sha2(text.scrub(c), 256).alias("scrubbed"), text.scrub_count(c).alias("redactions")).distinct()


@BOOK.add(f"SELECT DISTINCT \"runId\" AS run_id, {_scrub_sql('e')} AS error FROM (SELECT \"runId\", unnest(errors) AS e FROM runs)")
def error_redaction(spark, sf_dir):
    """P11"""
    return table(spark, sf_dir, "runs").select(F.col("runId").alias("run_id"), F.explode("errors").alias("error")).select("run_id", text.scrub(F.col("error")).alias("error")).distinct()


@BOOK.add(
    r"""WITH c AS (SELECT doc_id,
len(regexp_extract_all(text, '/[^/\n]{3,}/[gimsuy]*\.test\(')) + len(regexp_extract_all(text, '\.match\(\s*/')) + len(regexp_extract_all(text, 're\.(search|match)\(')) AS regex_test,
len(regexp_extract_all(text, '\[\s*(["''`][\w\s-]{2,}["''`]\s*,\s*){3,}')) AS keyword_list,
len(regexp_extract_all(text, '\.(includes|startsWith|endsWith)\(\s*["''`]')) + len(regexp_extract_all(text, '\bin\s+\w+\.lower\(\)')) AS includes_chain,
len(regexp_extract_all(text, '\.slice\(\s*0\s*,\s*\d+\s*\)')) + len(regexp_extract_all(text, '\[\s*:\s*\d+\s*\]')) AS slice_top,
len(regexp_extract_all(text, '[<>]=?\s*0\.\d+')) AS threshold,
len(regexp_extract_all(text, 'chat\.completions\.create|messages\.create\(|generateContent\(|\.invoke\(|ChatOpenAI|ChatAnthropic|generateText\(|generateObject\(|streamText\(|/chat/completions|/v1/messages|ollama\.|litellm|completion\(\s*model|\bresponse_format\b|structured_output')) AS model_call,
len(regexp_extract_all(text, 'case\s+["''`][\w\s-]+["''`]\s*:')) AS string_switch
FROM documents WHERE text IS NOT NULL)
SELECT *, CAST(2 * regex_test + 2 * keyword_list + includes_chain + slice_top + threshold + 3 * model_call + 0.5 * string_switch AS DOUBLE) AS score FROM c"""
)
def text_signals(spark, sf_dir):
    """P18"""
    t = F.col("text")
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", *[c.alias(name) for name, c in text.signal_counts(t).items()], text.signal_score(t).alias("score"))


_BANDS = "CASE " + " ".join(f"WHEN {{0}} >= {least} THEN '{name}'" for least, name in text.BANDS) + " ELSE 'ignore' END"


@BOOK.add("SELECT b AS band, coalesce(n, 0) AS findings FROM (VALUES ('strong'), ('likely'), ('possible'), ('ignore')) v(b) LEFT JOIN (SELECT " + _BANDS.format("average * 100") + " AS band, count(*) AS n FROM (SELECT id, any_value(average) AS average FROM findings WHERE average IS NOT NULL GROUP BY id) GROUP BY 1) c ON c.band = v.b")
def band_counts(spark, sf_dir):
    """Findings by band, with zeros."""
    scored = table(spark, sf_dir, "findings").where("average is not null").groupBy("id").agg(F.any_value("average").alias("average"))
    counted = scored.groupBy(text.band_for(F.col("average") * 100).alias("band")).agg(F.count("*").alias("n"))
    bands = spark.createDataFrame([(b,) for b in ("strong", "likely", "possible", "ignore")], "band string")
    return bands.join(counted, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("findings"))


@BOOK.add("SELECT DISTINCT id, sha256(trim(regexp_replace(code, '[ \\t\\r\\n\\f]+', ' ', 'g'))) AS code_hash, substr(sha256(concat(file, '#', unit.name, '#', CAST(unit.start AS VARCHAR))), 1, 16) AS unit_id, sha256(concat(project, chr(0), file, chr(0), unit.name)) AS cache_key FROM entries WHERE code IS NOT NULL")
def content_hashes(spark, sf_dir):
    """P16"""
    name = F.col("unit.name")
    return (
        table(spark, sf_dir, "entries")
        .where("code is not null")
        .select("id", text.content_hash(F.col("code")).alias("code_hash"), F.substring(F.sha2(F.concat("file", F.lit("#"), name, F.lit("#"), F.col("unit.start").cast("string")), 256), 1, 16).alias("unit_id"), text.key_hash(F.col("project"), F.col("file"), name).alias("cache_key"))
        .distinct()
    )


@BOOK.add("SELECT DISTINCT id, sha256(list_reduce(list_transform(string_split(code, chr(10)), lambda x, i: concat(format('{:4d}| ', i), x)), lambda a, b: a || chr(10) || b)) AS numbered, sha256(list_reduce(list_transform(string_split(code, chr(10))[1:14], lambda x: CASE WHEN length(x) > 80 THEN substr(x, 1, 80) || '…' ELSE x END), lambda a, b: a || chr(10) || b)) AS snippet FROM entries WHERE code IS NOT NULL")
def snippets(spark, sf_dir):
    """Numbered lines and capped snippets, as hashes."""
    c = F.col("code")
    return table(spark, sf_dir, "entries").where("code is not null").select("id", F.sha2(text.numbered(c), 256).alias("numbered"), F.sha2(text.snippet(c, 14, 80), 256).alias("snippet")).distinct()


@BOOK.add("""SELECT DISTINCT k.prompt_id, json_extract_string(j, '$.candidate.language') AS language, json_extract_string(j, '$.candidate.file') AS file, json_extract_string(j, '$.candidate.function') AS unit, json_extract_string(j, '$.round') AS round_text, CAST(json_array_length(j, '$.candidate.detected_inputs') AS INT) AS inputs
FROM (SELECT lower(trim("promptId")) AS prompt_id, regexp_extract("prompt", 'INDEX:\\n(\\{[\\s\\S]*?\\n\\})\\n', 1) AS j FROM gemini_prompts WHERE "prompt" IS NOT NULL) k WHERE json_valid(j)""")
def prompt_headers(spark, sf_dir):
    """The JSON header of each prompt; a broken one gives no row, never a failure."""
    header = F.regexp_extract("prompt", r"INDEX:\n(\{[\s\S]*?\n\})\n", 1)
    shape = "candidate struct<language:string,file:string,function:string,detected_inputs:array<struct<name:string>>>, round string"
    rows = table(spark, sf_dir, "gemini_prompts").where("prompt is not null").select(F.lower(F.trim("promptId")).alias("prompt_id"), F.from_json(header, shape, {"mode": "PERMISSIVE"}).alias("j"))
    return rows.where("j.candidate is not null").select("prompt_id", "j.candidate.language", "j.candidate.file", F.col("j.candidate.function").alias("unit"), F.col("j.round").alias("round_text"), F.when(F.col("j.candidate.detected_inputs").isNotNull(), F.size("j.candidate.detected_inputs")).alias("inputs")).distinct()


_HOST = "regexp_extract(lower(trim(source)), '^(?:git\\+)?(?:[a-z+]+://)?(?:[^/@]*@)?(?:www\\.)?([^/:]+)[:/]', 1)"


@BOOK.add(f"SELECT DISTINCT source, nullif({_HOST}, '') AS host FROM project_records WHERE source IS NOT NULL")
def repository_hosts(spark, sf_dir):
    """The host of every way to write an address."""
    host = F.regexp_extract(F.lower(F.trim("source")), r"^(?:git\+)?(?:[a-z+]+://)?(?:[^/@]*@)?(?:www\.)?([^/:]+)[:/]", 1)
    return table(spark, sf_dir, "project_records").where("source is not null").select("source", F.nullif(host, F.lit("")).alias("host")).distinct()


@BOOK.add(
    """SELECT prompt_id, name, arg_max(value, ord) AS value FROM (SELECT prompt_id, ord, regexp_extract(line, '^(?:export[ ]+)?([A-Z][A-Z0-9_]*)=', 1) AS name, trim(regexp_extract(line, '^(?:export[ ]+)?[A-Z][A-Z0-9_]*=([^\\n]*)$', 1), '"') AS value
FROM (SELECT prompt_id, unnest(string_split(p, chr(10))) AS line, generate_subscripts(string_split(p, chr(10)), 1) AS ord FROM (SELECT DISTINCT lower(trim("promptId")) AS prompt_id, "prompt" AS p FROM gemini_prompts))) WHERE name <> '' GROUP BY prompt_id, name"""
)
def env_settings(spark, sf_dir):
    """Settings in prompts; the last of a name holds."""
    prompts = table(spark, sf_dir, "gemini_prompts").select(F.lower(F.trim("promptId")).alias("prompt_id"), "prompt").distinct()
    lines = prompts.select("prompt_id", F.posexplode(F.split("prompt", "\n")).alias("ord", "line"))
    named = lines.select("prompt_id", "ord", F.regexp_extract("line", r"^(?:export[ ]+)?([A-Z][A-Z0-9_]*)=", 1).alias("name"), F.btrim(F.regexp_extract("line", r"^(?:export[ ]+)?[A-Z][A-Z0-9_]*=([^\n]*)$", 1), F.lit('"')).alias("value"))
    return named.where("name <> ''").groupBy("prompt_id", "name").agg(F.max_by("value", "ord").alias("value"))


@BOOK.add(
    r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \t\r\n\f]+', '<url>', 'g'), '(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+', '<path>', 'g'), '(?i)\b[A-Za-z0-9_][A-Za-z0-9_-]*\.(?:[cm]?[jt]sx?|json|css|html|md)\b', '<file>', 'g') AS t FROM documents),
n AS (SELECT doc_id, trim(regexp_replace(t, '[ \t\r\n\f]+', ' ', 'g')) AS t FROM t), s AS (SELECT doc_id, """
    + _scrub_sql("t")
    + """ AS t FROM n) SELECT doc_id, nullif(substr(t, 1, 400), '') AS generic FROM s"""
)
def genericized(spark, sf_dir):
    """P13 without names: addresses, paths and files become marks, credentials go."""
    return table(spark, sf_dir, "documents").select("doc_id", generic.generic_text(F.col("text"), F.array().cast("array<string>"), 400).alias("generic"))


@BOOK.add()
def genericized_names(spark, sf_dir):
    """Decisions and the first lines of code without the names that identify their file, unit and code, longest first."""
    e = table(spark, sf_dir, "entries").where("code is not null")
    named = e.select("id", "updatedAt", "decision", "code", generic.names_in(F.col("file"), F.col("unit.name"), F.col("code")).alias("names"))
    return named.select("id", "updatedAt", F.size("names").alias("names"), generic.generic_text(F.col("decision"), F.col("names"), 200).alias("decision"), generic.generic_text(F.col("code"), F.col("names"), 200).alias("code")).distinct()


@BOOK.add(
    r"""WITH u AS (SELECT DISTINCT source, trim(source) AS s FROM project_records WHERE source IS NOT NULL), p AS (SELECT source, regexp_extract(s, '^https?://(?:[^/@]*@)?([^/:?#]+)', 1) AS host, list_filter(string_split(regexp_extract(s, '^https?://[^/]+/([^?#]*)', 1), '/'), lambda x: x <> '') AS path FROM u)
SELECT source, lower(host) AS host, path[1] AS owner, regexp_replace(path[2], '\.git$', '') AS name, CASE WHEN path[3] IN ('tree', 'blob') THEN path[4] END AS ref, CASE WHEN path[3] IN ('tree', 'blob') THEN array_to_string(path[5:], '/') END AS path FROM p
WHERE host <> '' AND len(path) >= 2 AND lower(path[1]) NOT IN ('settings', 'orgs', 'marketplace', 'explore', 'topics', 'notifications', 'pulls', 'issues', 'login', 'signup', 'features', 'sponsors', 'about', 'pricing', 'search', 'new', 'codespaces', 'collections', 'trending', 'apps', 'enterprise', 'organizations', 'users', 'site', 'security')"""
)
def repository_urls(spark, sf_dir):
    """Host, owner, name, and reference and path of the page, of web addresses; those of pages that are no repository have no row."""
    s = F.trim("source")
    p = table(spark, sf_dir, "project_records").where("source is not null").select("source").distinct()
    p = p.select("source", F.regexp_extract(s, r"^https?://(?:[^/@]*@)?([^/:?#]+)", 1).alias("host"), F.filter(F.split(F.regexp_extract(s, r"^https?://[^/]+/([^?#]*)", 1), "/"), lambda x: x != "").alias("p"))
    page = F.get("p", F.lit(2)).isin("tree", "blob")
    rest = F.array_join(F.slice("p", 5, 1000), "/")
    kept = p.where((F.col("host") != "") & (F.size("p") >= 2) & ~F.lower(F.get("p", F.lit(0))).isin(*text.NOT_OWNERS))
    return kept.select("source", F.lower("host").alias("host"), F.get("p", F.lit(0)).alias("owner"), F.regexp_replace(F.get("p", F.lit(1)), r"\.git$", "").alias("name"), F.when(page, F.get("p", F.lit(3))).alias("ref"), F.when(page, rest).alias("path"))
