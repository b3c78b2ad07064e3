"""The queries of the training-data problems 1 to 4 and 6 to 8, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import BLANKS, iso_ts, key_or_null, latest, norm_key, stored, table
from tessera.llm import encoding, neardup, overlap, packing, pieces, secrets, splits
from tessera.llm.components import components

#: Capacity of a container, limit of a piece and overlap of pieces, in tokens of byte_bpe_50k.
CAPACITY, LIMIT, OVERLAP = 2048, 512, 64


#: Words of a run and least similarity of near-duplicate entries, as TESTDATA.md states them.
WORDS, ALIKE = 3, 0.5


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.groups(splits.projects(table(spark, sf_dir, "project_records")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.pairs(_groups(spark, sf_dir))


def p1_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slug, component, entries, split of every project."""
    config = table(spark, sf_dir, "split_config").first()  # one row
    entries = latest(table(spark, sf_dir, "entries"), key_or_null("id"), iso_ts("updatedAt"), ["project"])
    sizes = entries.groupBy(key_or_null("project").alias("slug")).agg(F.count("*").alias("entries")).where("slug is not null")
    return splits.assign(_groups(spark, sf_dir), sizes, config["ratios"].asDict(), config["splitSeed"])


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, projects, entries, share of entries: how near the shares come to the ratios."""
    by = p1_split(spark, sf_dir).groupBy("split").agg(F.count("*").alias("projects"), F.sum("entries").alias("entries"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("entries").alias("n")))).select("split", "projects", "entries", F.round(F.col("entries") / F.col("n"), 4).alias("share"))


def _blank(c: str):
    return F.coalesce(F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(BLANKS)), F.lit("")) == ""


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of entries with its content's class and set, stored; the last bit of a class tells code from decision, and without content both are null."""
    text = F.when(~_blank("code"), F.col("code")).when(~_blank("decision"), F.col("decision"))
    rows = table(spark, sf_dir, "entries").select("id", "updatedAt", (~_blank("code")).cast("long").alias("kind"), text.alias("content"))
    found = rows.select("id", "updatedAt", "kind", F.when(F.col("content").isNotNull(), neardup.sets_of(F.col("content"), WORDS)).alias("s"))
    return stored(found.select("id", "updatedAt", F.col("s.cls").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("kind")).alias("cls"), F.col("s.grams").alias("grams")))


def _members(contents: DataFrame) -> DataFrame:
    """id, cls of the current row of each entry with content."""
    held = latest(contents, key_or_null("id"), iso_ts("updatedAt"), ["cls"])
    return held.where("cls is not null").select(F.col("key").alias("id"), "cls")


def _links(contents: DataFrame) -> DataFrame:
    classes = stored(contents.where("grams is not null").select("cls", "grams").dropDuplicates(["cls"]))
    return neardup.links(classes, ALIKE).where((F.col("a").bitwiseAND(1)) == (F.col("b").bitwiseAND(1)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = _contents(spark, sf_dir)
    return neardup.expand(_links(contents), _members(contents))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, grp (the least id of the group), copies (entries of equal content), links (entries at least half the same) of every entry with content."""
    contents = _contents(spark, sf_dir)
    members, links = _members(contents), stored(_links(contents))
    classes = members.groupBy("cls").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(classes.select(F.col("cls").alias("b"), "copies"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("copies").alias("others"))
    grouped = components(links).select(F.col("node").alias("cls"), "component")
    wide = classes.join(linked, "cls", "left").join(grouped, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    names = wide.groupBy("component").agg(F.min("first").alias("grp"))
    each = wide.join(names, "component").select("cls", "grp", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return members.join(each, "cls").select("id", "grp", "copies", "links")


# Hashes of an empty text.
_EMPTY = ("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "d41d8cd98f00b204e9800998ecf8427e", "cf83e1357eefb8bdf1542850d66d8007d620e4050b5715dc83f4a921d36ce9ce47d0d13c5d85f2b0ff8318d2877eec2f63b931bd47417a81a538327af927da3e")


def _code_hash(c: str):
    """A hash without case, blanks and the algorithm's name; null where it says nothing."""
    h = F.regexp_replace(norm_key(c), r"^(?:sha-?\d*|md5|blake\w*|xxh\w*)\s*[:=$-]\s*", "")
    return F.when((h != "") & ~h.rlike("^0+$") & ~h.isin(*_EMPTY), h)


def _set_class(code: Column) -> Column:
    return overlap.class_key(neardup.sets_of(code, WORDS)["cls"])


def _sequence_class(code: Column) -> Column:
    return overlap.class_key(overlap.sequence_of(code))


def _sided(spark: SparkSession, sf_dir: str, class_of: Callable[[Column], Column] = _set_class) -> DataFrame:
    """id, cls, hash, split, source, side of active entries of projects with a split, stored; cls is the class of the code, null without code."""
    rows = table(spark, sf_dir, "entries").select("id", "updatedAt", "status", "project", "codeHash", F.when(~_blank("code"), F.col("code")).alias("code"))
    classed = rows.withColumn("cls", F.when(F.col("code").isNotNull(), class_of(F.col("code")))).drop("code")
    held = latest(classed, key_or_null("id"), iso_ts("updatedAt"), ["status", "project", "codeHash", "cls"])
    active = held.where(norm_key("status") == "active").select(F.col("key").alias("id"), key_or_null("project").alias("slug"), "cls", _code_hash("codeHash").alias("hash"))
    projects = splits.projects(table(spark, sf_dir, "project_records")).select("slug", "split", F.col("repo").alias("source"), overlap.sides(F.col("split")).alias("side"))
    return stored(active.join(projects.where("side is not null"), "slug"))


def _code_texts(spark: SparkSession, sf_dir: str, sided: DataFrame, class_of: Callable[[Column], Column] = _set_class) -> DataFrame:
    """cls, side, code: one text of each class that active entries of split projects have, and whether of train, of held-out ones or both (3)."""
    asked = sided.where("cls is not null").groupBy("cls").agg(F.bit_or("side").alias("side"))
    rows = table(spark, sf_dir, "entries").select("code").where(~_blank("code"))
    texts = rows.select(class_of(F.col("code")).alias("cls"), "code").hint("merge")  # its size is guessed from the schema, far too low to let it choose a broadcast
    return stored(texts.join(asked, "cls").dropDuplicates(["cls"]).select("cls", "side", "code"))


def _overlaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of entries (train, held out) that are the same or almost the same, and the entries of `_sided`."""
    sided = _sided(spark, sf_dir)
    train, held = (sided.where(F.col("side") == n).select(F.col("id").alias(f"{x}_id"), F.col("cls").alias(f"{x}_cls"), "hash") for n, x in ((overlap.TRAIN, "train"), (overlap.HELD_OUT, "held")))
    t, h = train.where("train_cls is not null").drop("hash"), held.where("held_cls is not null").drop("hash")
    near = overlap.links(_code_texts(spark, sf_dir, sided), ALIKE).join(t, F.col("a") == F.col("train_cls")).join(h, F.col("b") == F.col("held_cls")).select("train_id", "held_id")
    same = t.join(h, F.col("train_cls") == F.col("held_cls")).select("train_id", "held_id")
    hashed = train.where("hash is not null").join(held, "hash").where("train_cls is null or held_cls is null").select("train_id", "held_id")
    return near.unionByName(same).unionByName(hashed), sided


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, _ = _overlaps(spark, sf_dir)
    return pairs.select(F.least("train_id", "held_id").alias("id_a"), F.greatest("train_id", "held_id").alias("id_b"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, source, entries, overlapping: active held-out entries and those found in train, per split and repository."""
    pairs, sided = _overlaps(spark, sf_dir)
    held = sided.where(F.col("side") == overlap.HELD_OUT).select("id", "split", F.coalesce("source", F.lit("unknown")).alias("source"))
    hit = pairs.select(F.col("held_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    return held.join(hit, "id", "left").groupBy("split", "source").agg(F.count("*").alias("entries"), F.count("hit").alias("overlapping"))


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, split, covered: words of each held-out entry's code that lie in spans of six words or more that train code has too; 0 without such spans or without code."""
    sided = _sided(spark, sf_dir, _sequence_class)
    covered = overlap.coverage(_code_texts(spark, sf_dir, sided, _sequence_class))
    return sided.where(F.col("side") == overlap.HELD_OUT).join(covered, "cls", "left").select("id", "split", F.coalesce("covered", F.lit(0)).alias("covered"))


#: Where credentials are looked for: table, id, text and time of its rows.
_TEXTS = (("entries", "id", "code", "updatedAt"), ("gemini_prompts", "promptId", "prompt", "at"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, prompts = (secrets.found(table(spark, sf_dir, t[0]), *t) for t in _TEXTS)
    return entries.unionByName(prompts)


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_table, rec_id, redactions, text: records with credentials and their texts without."""
    entries, prompts = (secrets.cleaned(table(spark, sf_dir, t[0]), *t) for t in _TEXTS)
    return entries.unionByName(prompts)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether decoding their ids gives their text again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = docs.withColumn("back", encoding.text_of(encoding.ids_of(F.col("text"))))
    return back.groupBy((F.coalesce("text", F.lit("")) == F.col("back")).alias("same")).agg(F.count("*").alias("n"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select("doc_id", encoding.count_of(F.col("text")).alias("n_tokens"))
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece_no, start_token, n_tokens, container, place: every document in exactly one container, whole unless larger than one."""
    return _packed(spark, sf_dir).select(F.col("id").alias("doc_id"), "piece_no", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"), "container", "place")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: containers and unused tokens in all, and the least number that could do."""
    each = _packed(spark, sf_dir).groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("items"))
    return each.agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), F.sum(CAPACITY - F.col("used")).alias("unused"), F.ceil(F.sum("used") / CAPACITY).alias("least_containers"), F.max("used").alias("fullest")
    )


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split(table(spark, sf_dir, "documents"), limit=LIMIT, overlap=OVERLAP)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_split, p1_shares, p2_found, p2_groups, p3_found, p3_report, p3_coverage, p4_found, p4_redacted, p6_ids, p6_round_trip, p7_containers, p7_fill, p8_pieces)}

# The SQL below is written on its own, without values of this package, so that a wrong pattern shows.
_CURRENT = r"""
p AS (
  SELECT lower(trim(slug)) AS slug, arg_max(struct_pack(f := lower(trim(fingerprint)), s := lower(trim(source)), split := lower(trim(split))), CAST(updated AS TIMESTAMPTZ)) AS r
  FROM project_records WHERE trim(slug) <> '' GROUP BY 1),
e AS (
  SELECT lower(trim(id)) AS id, arg_max(struct_pack(code := code, decision := decision, project := lower(trim(project)), status := lower(trim(status)), hash := lower(trim("codeHash"))), CAST("updatedAt" AS TIMESTAMPTZ)) AS r
  FROM entries WHERE trim(id) <> '' GROUP BY 1)"""
_REPOSITORY = r"""
CASE WHEN r.s NOT IN ('', 'unknown', 'n/a', 'na', 'none', 'null', 'nil', '-', '--', '?', 'tbd', 'todo', 'undefined', 'missing', 'not available', 'unspecified', 'placeholder') THEN
  nullif(regexp_replace(concat_ws('/', regexp_extract(r.s, '^(?:git\+)?(?:[a-z][a-z0-9+.-]*:/+)?(?:[^/@]*@)?(?:www\.)?([^/:?#\s]+\.[^/:?#\s]+)', 1),
    regexp_extract(r.s, '^(?:git\+)?(?:[a-z][a-z0-9+.-]*:/+)?(?:[^/@]*@)?[^/:?#\s]+(?::\d+)?[:/]+([^/?#\s]+/+[^/?#\s]+)', 1)), '(\.git)+$', ''), '/') END"""
_MEASURED = r"""
w AS (SELECT id, kind, c, list_transform(regexp_extract_all(c, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM c),
n AS (SELECT id, kind, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w WHERE len(w) > 2),
sizes AS (SELECT id, count(*) AS n FROM n GROUP BY 1)"""

SQL: dict[str, str] = {
    "p1_found": f"""
WITH RECURSIVE {_CURRENT}, q AS (SELECT slug, {_REPOSITORY} AS repo, r.f AS f FROM p),
k AS (
  SELECT slug, 'f' || f AS k FROM q WHERE NOT regexp_full_match(f, '0*') AND f NOT IN ('unknown', 'n/a', 'na', 'none', 'null', 'nil', '-', '--', '?', 'tbd', 'todo', 'undefined', 'missing', 'not available', 'unspecified', 'placeholder')
  UNION SELECT slug, 'r' || repo FROM q WHERE repo IS NOT NULL),
reach(a, b) AS (SELECT slug, slug FROM k UNION SELECT reach.a, y.slug FROM reach JOIN k x ON x.slug = reach.b JOIN k y ON y.k = x.k)
SELECT a AS slug_a, b AS slug_b FROM reach WHERE a < b""",
    "p2_found": rf"""
WITH {_CURRENT}, c AS (
  SELECT id, regexp_matches(r.code, '[^\s\x{{a0}}\x{{200b}}\x{{feff}}]') IS TRUE AS kind, CASE WHEN regexp_matches(r.code, '[^\s\x{{a0}}\x{{200b}}\x{{feff}}]') THEN r.code WHEN regexp_matches(r.decision, '[^\s\x{{a0}}\x{{200b}}\x{{feff}}]') THEN r.decision END AS c FROM e),
{_MEASURED}
SELECT a.id AS id_a, b.id AS id_b FROM n a JOIN n b ON a.g = b.g AND a.kind = b.kind AND a.id < b.id JOIN sizes x ON x.id = a.id JOIN sizes y ON y.id = b.id
GROUP BY a.id, b.id, x.n, y.n HAVING 2 * count(*) >= x.n + y.n - count(*)
UNION SELECT a.id, b.id FROM c a JOIN c b ON a.c = b.c AND a.kind = b.kind AND a.id < b.id""",
    "p3_found": rf"""
WITH {_CURRENT}, c AS (
  SELECT id, p.r.split = 'train' AS kind, CASE WHEN regexp_matches(e.r.code, '[^\s\x{{a0}}\x{{200b}}\x{{feff}}]') THEN e.r.code END AS c, regexp_replace(e.r.hash, '^(sha-?\d*|md5|blake\w*|xxh\w*)\s*[:=$-]\s*', '') AS h
  FROM e JOIN p ON p.slug = e.r.project WHERE e.r.status = 'active' AND p.r.split IN ('train', 'dev', 'test')),
{_MEASURED}
SELECT least(t.id, d.id) AS id_a, greatest(t.id, d.id) AS id_b FROM n t JOIN n d ON t.g = d.g AND t.kind AND NOT d.kind JOIN sizes x ON x.id = t.id JOIN sizes y ON y.id = d.id
GROUP BY t.id, d.id, x.n, y.n HAVING 2 * count(*) >= x.n + y.n - count(*)
UNION SELECT least(t.id, d.id), greatest(t.id, d.id) FROM c t JOIN c d ON t.kind AND NOT d.kind AND (t.c = d.c OR (t.c IS NULL OR d.c IS NULL) AND t.h = d.h AND NOT regexp_full_match(t.h, '0*') AND t.h NOT IN (
  'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855', 'da39a3ee5e6b4b0d3255bfef95601890afd80709', 'd41d8cd98f00b204e9800998ecf8427e',
  'cf83e1357eefb8bdf1542850d66d8007d620e4050b5715dc83f4a921d36ce9ce47d0d13c5d85f2b0ff8318d2877eec2f63b931bd47417a81a538327af927da3e'))""",
    "p3_coverage": rf"""
WITH {_CURRENT}, c AS (
  SELECT id, p.r.split AS split, list_transform(regexp_extract_all(e.r.code, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w
  FROM e JOIN p ON p.slug = e.r.project WHERE e.r.status = 'active' AND p.r.split IN ('train', 'dev', 'test')),
s AS (SELECT id, split, unnest(range(1, len(w) - 4)) AS i, w FROM c WHERE len(w) > 5),
g AS (SELECT id, split, i, array_to_string(w[i:i + 5], ' ') AS g FROM s),
hit AS (SELECT id, i FROM g WHERE split <> 'train' AND g IN (SELECT g FROM g WHERE split = 'train')),
span AS (SELECT id, least(6, coalesce(lead(i) OVER (PARTITION BY id ORDER BY i) - i, 6)) AS n FROM hit)
SELECT id, split, CAST(coalesce((SELECT sum(n) FROM span WHERE span.id = c.id), 0) AS BIGINT) AS covered FROM c WHERE split <> 'train'""",
}
SQL["p2_groups"] = f"""
WITH RECURSIVE pairs AS ({SQL["p2_found"]}), b AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
{_CURRENT}, c AS (SELECT id, CASE WHEN regexp_matches(r.code, '[^\\s\\x{{a0}}\\x{{200b}}\\x{{feff}}]') THEN r.code WHEN regexp_matches(r.decision, '[^\\s\\x{{a0}}\\x{{200b}}\\x{{feff}}]') THEN r.decision END AS c, regexp_matches(r.code, '[^\\s\\x{{a0}}\\x{{200b}}\\x{{feff}}]') IS TRUE AS kind FROM e),
held AS (SELECT id, kind, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g, c FROM (SELECT *, list_transform(regexp_extract_all(c, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM c WHERE c IS NOT NULL)),
same AS (SELECT kind, CASE WHEN len(g) > 0 THEN array_to_string(g, '|') ELSE c END AS s, len(g) > 0 AS runs, count(*) AS copies FROM held GROUP BY ALL),
reach(x, y) AS (SELECT id, id FROM held UNION SELECT reach.x, b.b FROM reach JOIN b ON b.a = reach.y),
grp AS (SELECT x AS id, min(y) AS grp FROM reach GROUP BY x)
SELECT held.id, grp, copies, (SELECT count(*) FROM b WHERE b.a = held.id) AS links FROM held JOIN grp USING (id) JOIN same ON same.kind = held.kind AND same.runs = (len(g) > 0) AND same.s = CASE WHEN len(g) > 0 THEN array_to_string(g, '|') ELSE c END"""
SQL["p3_report"] = f"""
WITH pairs AS ({SQL["p3_found"]}), hit AS (SELECT id_a AS id FROM pairs UNION SELECT id_b FROM pairs), {_CURRENT}, held AS (SELECT e.id, p.r.split AS split, p.r AS r FROM e JOIN p ON p.slug = e.r.project WHERE e.r.status = 'active' AND p.r.split IN ('dev', 'test'))
SELECT split, coalesce({_REPOSITORY}, 'unknown') AS source, count(*) AS entries, count(hit.id) AS overlapping FROM held LEFT JOIN hit ON hit.id = held.id GROUP BY ALL"""
