"""Gated, keyed and versioned writes."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.datasets import broken, replace_keyed


class Refused(ValueError):
    """A write that some rows would break; carries how many problems there are, by kind."""

    def __init__(self, problems: dict[str, int]):
        super().__init__(f"refused: {problems}")
        self.problems = problems


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def gated(rows: DataFrame, problems: DataFrame, path: str, order: list[str]) -> str:
    """Writes all rows as JSON lines in a total order, as a new version below `path`, or none if there is any problem (`problem`).

    The log names the version only when it is whole, so a reader sees the old rows or the new ones, also if the
    writer dies. Null fields are left out of the lines. `gated_path` is where to read.
    """
    found = {r["problem"]: r["n"] for r in problems.groupBy("problem").agg(F.count("*").alias("n")).collect()}  # one row per rule
    if found:
        raise Refused(found)
    version = f"v{time.time_ns()}"
    rows.orderBy(*order).write.option("ignoreNullFields", "true").json(f"{path}/{version}")
    _log(rows.sparkSession, path, version, last(rows.sparkSession, path))
    return version


def gated_path(spark: SparkSession, path: str) -> str:
    return f"{path}/{last(spark, path)}"


def _log(spark: SparkSession, root: str, version: str | None, previous: str | None) -> None:
    """Adds an entry to the log of a table: a file with a name of its own, put in place by one rename and never changed."""
    name = f"{time.time_ns():020d}.json"
    fs, at = _fs(spark, f"{root}/_log/{name}.tmp")
    out = fs.create(at, False)
    out.writeUTF(json.dumps({"version": version, "previous": previous}))
    out.close()
    if not fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_log/{name}")):
        raise OSError(f"can't put {root}/_log/{name} in place")


def _entries(spark: SparkSession, root: str) -> list[dict]:
    """The log, oldest first; one small file for each write."""
    fs, at = _fs(spark, f"{root}/_log")
    if not fs.exists(at):
        return []
    out = []
    for status in sorted(fs.listStatus(at), key=lambda s: s.getPath().getName()):
        if status.getPath().getName().endswith(".json"):
            f = fs.open(status.getPath())
            out.append(json.loads(f.readUTF()))
            f.close()
    return out


def snapshot(rows: DataFrame, root: str) -> str:
    """Writes a version of a table below a folder and then names it in the log."""
    spark, version = rows.sparkSession, f"v{time.time_ns()}"
    rows.write.parquet(f"{root}/{version}")
    _log(spark, root, version, last(spark, root))
    return version


def last(spark: SparkSession, root: str) -> str | None:
    """The version that holds; none before the first and after all were undone."""
    entries = _entries(spark, root)
    return entries[-1]["version"] if entries else None


def undo(spark: SparkSession, root: str) -> str | None:
    """Takes the last write back: the version before it holds again, or none. The log only grows."""
    entries = _entries(spark, root)
    if not entries:
        return None
    before = {e["version"]: e["previous"] for e in entries if e["version"] is not None}
    back = before.get(entries[-1]["version"])
    _log(spark, root, back, before.get(back))
    return back


def read_last(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{last(spark, root)}")


def save_run(old: dict[str, DataFrame], new: dict[str, DataFrame], keys: dict[str, list[str]], root: str) -> dict[str, str]:
    """Saves the tables of a run: those with keys are merged by them and those without replaced, as new versions; rows of `runs` are appended, and what is stored of it isn't touched."""
    out = {}
    for name, rows in new.items():
        if name == "runs":
            rows.write.mode("append").parquet(f"{root}/{name}")
            out[name] = "appended"
            continue
        before = old.get(name)
        if before is not None and keys.get(name):
            rows = replace_keyed(before, rows, keys[name])
        out[name] = snapshot(rows, f"{root}/{name}")
    return out


def insert_checked(rows: DataFrame, rules: dict[str, Column], root: str) -> None:
    """Appends the rows that break no rule to `inserted` below a folder and the others, with `problems`, to `rejected`. Rows stored before are neither read nor changed."""
    checked = rows.withColumn("problems", broken(rules))
    checked.where(F.size("problems") == 0).drop("problems").write.mode("append").parquet(f"{root}/inserted")
    checked.where(F.size("problems") > 0).write.mode("append").parquet(f"{root}/rejected")


def markdown(rows: DataFrame, title: str, most: int = 500) -> str:
    """A report of a small, ordered table; it is cut to `most` rows, which is said."""
    head = rows.limit(most + 1).collect()
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in head[:most]]
    return "\n".join(lines + ([f"", f"Cut to {most} rows."] if len(head) > most else [])) + "\n"
