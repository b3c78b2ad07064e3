"""Choosing: search by scored matches, paths written by hand, and things that serve one chooser only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import checkpoint

_FILE, _IDENTIFIER = r"[\w@./-]+\.[A-Za-z]{1,5}\b", r"[A-Za-z_$][A-Za-z0-9_$]*"
#: Hashes of file tokens, 8 bytes each, up to which they are broadcast.
FEW = 1 << 20


def tokens(requests: DataFrame) -> DataFrame:
    """Columns `request, kind, token, strong`: the file and identifier tokens of requests, which are distinct. Strong ones look like code: in backquotes, called, in mixed case, with underscores or digits."""
    r = requests.select("request")
    files = r.select("request", F.explode(F.array_distinct(F.regexp_extract_all("request", F.lit(_FILE), F.lit(0)))).alias("t")).select("request", F.lit("file").alias("kind"), F.regexp_replace("t", r"^\.?/", "").alias("token"), F.lit(True).alias("strong"))
    marked = F.concat(F.flatten(F.transform(F.regexp_extract_all("request", F.lit("`([^`]+)`"), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit(_IDENTIFIER), F.lit(0)))), F.regexp_extract_all("request", F.lit(rf"({_IDENTIFIER})\s*\("), F.lit(1)))
    # a step of its own: beside an explode it would be worked out for each word, and again in each condition
    words = r.select("request", marked.alias("marked")).select("request", "marked", F.explode(F.array_distinct(F.regexp_extract_all("request", F.lit(_IDENTIFIER), F.lit(0)))).alias("token"))
    mixed = F.col("token").rlike(r"[a-z][A-Z]|_|\d")
    strong = F.array_contains("marked", F.col("token")) | mixed
    kept = words.where(strong | F.col("token").rlike("^[A-Z]") | (F.length("token") >= 5))
    return files.unionByName(kept.select("request", F.lit("name").alias("kind"), "token", strong.alias("strong")))


def _found_by(symbols: DataFrame, files: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Columns `way, key, id, points`: the k best ids of each key. Ways: `file` by a path's ends, `name` as written (names, their last parts and base names of files), `low` by last parts in any letter case.

    A path has an end for each character. Up to `FEW` hashes in `asked`, a checkpointed table of the distinct ones of file
    tokens, only the ends among these are kept; beyond that all are, as to move each to its hash would cost more than to rank it.
    """
    f, s = files.select("file").where("file is not null").distinct(), symbols.select("symbol").where("symbol is not null").distinct()
    few, spark = asked.count() <= FEW, f.sparkSession
    # few bytes, but a row for each character: left to its size, this would be one task; by the column itself Spark drops the exchange
    f = f.repartition(2 * spark.sparkContext.defaultParallelism if few else int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("file"))
    row = lambda way, id_, points: (F.lit(way).alias("way"), "key", F.concat(F.lit(id_[0]), id_[1]).alias("id"), points.alias("points"))
    file, symbol, outline = ("file:", "file"), ("symbol:", "symbol"), ("outline:", "file")
    ends = f.select("file", F.explode(F.sequence(F.lit(1), F.length("file"))).alias("i")).select("file", F.expr("substring(file, i)").alias("key"))
    if few:
        ends = ends.withColumn("hash", F.xxhash64("key")).join(F.broadcast(asked), "hash", "left_semi")
    base = f.select("file", F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]+$", "").alias("key"))
    last = F.element_at(F.split("symbol", r"\."), -1)
    named = s.select("symbol", F.explode(F.array_distinct(F.array("symbol", last))).alias("key"))
    lists = ends.select(*row("file", file, F.when(F.col("file") == F.col("key"), 10).otherwise(8)))
    lists = lists.unionByName(named.select(*row("name", symbol, F.lit(7)))).unionByName(base.select(*row("name", outline, F.lit(3))))
    lists = lists.unionByName(s.select("symbol", F.lower(last).alias("key")).select(*row("low", symbol, F.lit(4))))
    return lists.withColumn("nth", F.row_number().over(Window.partitionBy("way", "key").orderBy(F.desc("points"), "id"))).where(F.col("nth") <= k).drop("nth")


def search(requests: DataFrame, symbols: DataFrame, files: DataFrame, k: int) -> DataFrame:
    """Columns `request, rank, id, score`: the k best matches of each request among symbols (`symbol`) and files (`file`).

    A file named in full counts 10, by its end 8; a symbol by its name or the last part of it 7 (5 for a plain word), in
    other letter case 4 (2); a file by its name without ending 3. Each match is an equality: a path is matched by all of
    its ends. An id counts with its best score; ties by id. Null names are left out.

    Each key brings its k best ids only, chosen before requests are joined: were one of a request's k best not among
    those of the key that gives its best score, k others of that key would come before it. So nothing is lost, and a
    name that many files share and many requests say costs k rows for each request, not one for each file. Ends of paths
    that no request says are dropped where they are made, before anything is sorted or moved, if there are few file tokens.
    """
    r = checkpoint(requests.select("request").distinct())
    way = lambda name, key: F.struct(F.lit(name).alias("way"), key.alias("key"))
    token, is_file = F.col("token"), F.col("kind") == "file"
    said = tokens(r)
    asked = checkpoint(said.where(is_file).select(F.xxhash64("token").alias("hash")).distinct())
    t = said.select("request", "strong", F.inline(F.when(is_file, F.array(way("file", token))).otherwise(F.array(way("name", token), way("low", F.lower(token))))))
    score = F.when(F.col("strong") | (F.col("points") == 3), F.col("points")).otherwise(F.col("points") - 2)
    found = t.join(_found_by(symbols, files, asked, k), ["way", "key"]).repartition("request")  # serves both the best of an id and the ranks
    best = found.groupBy("request", "id").agg(F.max(score).alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("request", "rank", "id", "score")


def clean_path(raw: Column) -> Column:
    """A path as written by hand, without lines, quotes, leading dots and slashes."""
    p = F.regexp_replace(F.trim(raw), r"(?i)\s*\(lines?[^)]*\)\s*$", "")
    p = F.regexp_replace(F.regexp_replace(p, "^[`'\"]+|[`'\"]+$", ""), r"\\", "/")
    return F.regexp_replace(F.regexp_replace(p, r"^(\./|/)+", ""), r":\d+(-\d+)?$", "")


def _ends(path: str) -> Column:
    """All ends of a path that begin after a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def match_files(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Columns `raw, file`: the known file (`file`) each written path (`raw`) means: the same, or the only one of which one is the other's end; null if none or several."""
    k, r = known.select("file").where("file is not null").distinct(), raw.select("raw").distinct().withColumn("clean", clean_path(F.col("raw")))
    exact = r.join(k, r["clean"] == k["file"]).select("raw", F.lit(0).alias("way"), "file")
    longer = k.select("file", F.explode(_ends("file")).alias("clean")).where("clean <> ''").join(r, "clean").select("raw", F.lit(1).alias("way"), "file")
    shorter = r.select("raw", F.explode(_ends("clean")).alias("file")).where("file <> ''").join(k, "file").select("raw", F.lit(1).alias("way"), "file")
    hits = exact.unionByName(longer).unionByName(shorter).distinct().groupBy("raw").agg(F.max(F.when(F.col("way") == 0, F.col("file"))).alias("same"), F.min("file").alias("one"), F.countDistinct("file").alias("n"))
    found = hits.select("raw", F.coalesce("same", F.when(F.col("n") == 1, F.col("one"))).alias("file"))
    return r.select("raw").join(found, "raw", "left")


def exclusive(pairs: DataFrame, n: int, rounds: int = 1000) -> DataFrame:
    """Columns `site, item, nth`: each site takes its first `n` items, and no item serves two sites; earlier sites come first.

    `pairs` has `site`, `turn` (a site's place, the same in all of its rows), `item` and `rank`, ranks of a site being distinct.
    Sites one after another would be a single task; instead all ask at once for their best n, an item stays with
    the earliest site that asks, and those turned down ask on. As all items prefer the same sites, that ends with
    what turns would give. Rows with a null are left out.
    """
    open_ = checkpoint(pairs.select("site", "turn", "item", "rank").na.drop().distinct())
    for _ in range(rounds):
        asked = open_.withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy("rank"))).where(F.col("nth") <= n)
        first = asked.groupBy("item").agg(F.min("turn").alias("kept"))
        judged = checkpoint(asked.join(first, "item").withColumn("lost", F.col("turn") > F.col("kept")))
        lost = judged.where("lost").select("site", "item")
        if lost.isEmpty():
            return judged.select("site", "item", "nth")
        open_ = checkpoint(open_.join(lost, ["site", "item"], "left_anti"))
    raise RuntimeError(f"not settled after {rounds} rounds")
