"""Scans of source files, JSON lines, project records, labelled cases and settings."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Folders that are never scanned, and what counts as source.
IGNORED = ("node_modules", "dist", "build", "out", "coverage", ".git", ".next", ".nuxt", "vendor", "__pycache__", ".venv", "venv")
SOURCE = r"\.([cm]?[jt]sx?|py)$"

# Dependencies and the framework they stand for.
FRAMEWORKS = {
    "next": "next", "react": "react", "react-native": "react-native", "vue": "vue", "nuxt": "nuxt", "svelte": "svelte", "@sveltejs/kit": "sveltekit", "@angular/core": "angular", "express": "express", "fastify": "fastify", "koa": "koa", "hono": "hono",
    "@nestjs/core": "nestjs", "electron": "electron", "expo": "expo", "discord.js": "discord.js", "telegraf": "telegraf", "langchain": "langchain", "ai": "vercel-ai", "openai": "openai", "@anthropic-ai/sdk": "anthropic",
}


def as_pattern(glob: str) -> str:
    """A pattern for a glob: `**` any folders, `*` within one; a bare folder means everything in it."""
    if not any(c in glob for c in "*?["):
        glob = f"**/{glob.strip('/')}/**"
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".+()|^$[]{}" else c), i + 1
    return f"^{out}$"


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Columns `path` (from the root), `text`, `size` of the source files below a folder.

    Other files are left out when the folder is listed, ignored folders and what the `.gitignore` of the root names
    before any text is read; bytes that are no UTF-8 become U+FFFD. Rows have no order: `path` sorts them.
    An empty folder gives an empty table.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ts,tsx,mts,cts,js,jsx,mjs,cjs,py}").load(base)
    path = F.regexp_replace("path", "^[a-z]+:/*" + base.replace(".", r"\.").lstrip("/") + "/", "")
    found = raw.withColumn("path", path).where(F.col("path").rlike(SOURCE))
    found = found.where(~F.col("path").rlike("(^|/)(" + "|".join(x.replace(".", r"\.") for x in IGNORED) + ")/"))
    rules = gitignored(spark, base)
    for pattern, ignores in rules:
        hidden = F.col("path").rlike(pattern)
        found = found.withColumn("_hidden", F.when(hidden, ignores).otherwise(F.col("_hidden") if "_hidden" in found.columns else False))
    if rules:
        found = found.where("not _hidden")
    if include:
        found = found.where(any_of(F.col("path"), include))
    if exclude:
        found = found.where(~any_of(F.col("path"), exclude))
    return found.select("path", F.decode("content", "UTF-8").alias("text"), F.col("length").alias("size"))


def gitignored(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    """The rules of a folder's `.gitignore` in order, as patterns of paths from the root and whether they ignore; the last that fits decides. It is one small file; without one there are none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/.gitignore")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    stream = fs.open(at)  # a table of text would leave hidden files out
    lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    stream.close()
    out = []
    for line in map(str.strip, lines):
        if not line or line.startswith("#"):
            continue
        ignores, line = not line.startswith("!"), line.lstrip("!")
        anchored = "/" in line.rstrip("/")
        body = as_pattern(line.strip("/") + "/**")[1:-1].removesuffix(".*").removesuffix("/") if any(c in line for c in "*?[") else re.escape(line.strip("/"))
        out.append((("^" if anchored else "(?:^|/)") + body + ("/" if line.endswith("/") else "(?:/|$)"), ignores))
    return out


def any_of(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(map(as_pattern, globs)))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON lines by a fixed schema; blank lines are dropped, a broken one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the text of broken lines, as two tables; no broken line fails the read."""
    parsed = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("j"))
    return parsed.where("j._broken is null").select("j.*").drop("_broken"), parsed.where("j._broken is not null").select(F.col("value").alias("line"))


def projects(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """One row per project file, each one JSON object over several lines."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(pattern)


CASE = "array<struct<file:string,context:string,minBand:string,note:string>>"


def cases(spark: SparkSession, pattern: str) -> DataFrame:
    """Columns `repo, positive, file, context, minBand, note` of files of labelled cases, named by the folder they lie in."""
    raw = spark.read.schema(f"positive {CASE}, negative {CASE}").option("multiLine", "true").json(pattern).withColumn("repo", F.element_at(F.split(F.input_file_name(), "/"), -2))
    side = lambda c, yes: raw.select("repo", F.lit(yes).alias("positive"), F.inline(c))
    return side("positive", True).unionByName(side("negative", False))


def frameworks(packages: DataFrame, dependencies: list[str]) -> DataFrame:
    """Adds `frameworks`, the sorted names of the frameworks among the keys of the dependency maps; null maps have none."""
    empty = F.create_map().cast("map<string,string>")
    names = F.array_distinct(F.flatten(F.array(*[F.map_keys(F.coalesce(F.col(c), empty)) for c in dependencies])))
    known = F.create_map(*[F.lit(x) for kv in FRAMEWORKS.items() for x in kv])
    return packages.withColumn("frameworks", F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda n: known[n]), lambda x: x.isNotNull()))))


def layered(defaults: Mapping[str, Any], *layers: Mapping[str, Any]) -> dict[str, Any]:
    """Settings over defaults: lists are appended without repeats, mappings merged key by key, other values replaced; null changes nothing."""
    out = {k: (list(v) if isinstance(v, (list, tuple)) else dict(v) if isinstance(v, Mapping) else v) for k, v in defaults.items()}
    for layer in layers:
        for k, v in layer.items():
            if v is None:
                continue
            if isinstance(out.get(k), list) and isinstance(v, (list, tuple)):
                out[k] = list(dict.fromkeys([*out[k], *v]))
            elif isinstance(out.get(k), dict) and isinstance(v, Mapping):
                out[k] = layered(out[k], v)
            else:
                out[k] = v
    return out


def select_corpus(intake: DataFrame, wanted: list[str]) -> DataFrame:
    """Ready or partial projects of an intake list (`slug`, `status`, `ordinal`), by slug or ordinal; all if none is named; each once."""
    ready = intake.where(F.col("status").isin("ready", "partial")).dropDuplicates(["slug"])
    if not wanted:
        return ready
    return ready.where(F.col("slug").isin(*wanted) | F.col("ordinal").cast("string").isin(*wanted))
