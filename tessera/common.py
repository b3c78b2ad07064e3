"""Column helpers and lineage cuts that every operator shares."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks that may stand around a key.
BLANKS = " \t\n\r\f\v   ​﻿"

#: Values that stand in for a missing one; compared after `norm_key`.
FILLERS = ("unknown", "n/a", "na", "none", "null", "nil", "-", "--", "?", "tbd", "todo", "undefined", "missing", "not available", "unspecified", "placeholder")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's code to the Python workers of the session, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    z.write(full := os.path.join(folder, name), os.path.join("tessera", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_key(col: Column | str) -> Column:
    """A key without the blanks around it, in lower case; null stays null."""
    return F.lower(F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS)))


def key_or_null(col: Column | str) -> Column:
    """`norm_key`, with null for a blank."""
    return F.nullif(norm_key(col), F.lit(""))


def is_filler(col: Column) -> Column:
    """True where a normalized value names nothing: null, blank, all zeros, or one of `FILLERS`."""
    return col.isNull() | (col == "") | col.rlike("^0+$") | col.isin(*FILLERS)


def iso_ts(col: Column | str) -> Column:
    """A timestamp from an ISO-8601 string, with or without milliseconds, `Z` or an offset; null where it is none."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(F.btrim(c, F.lit(BLANKS)))


def latest(df: DataFrame, key: Column, at: Column, payload: list[str]) -> DataFrame:
    """The row of each key with the latest `at`, as columns `key, at, *payload`.

    max_by combines on the map side, so a key that holds much of the table isn't gathered anywhere.
    Rows without key are left out; a null `at` is the oldest; of rows with one `at` the greater payload
    holds, so the result doesn't depend on the order of rows. Clashing names are safe: the columns are
    packed into one struct before they are grouped.
    """
    packed = df.select(key.alias("key"), at.alias("at"), F.struct(*[F.col(c) for c in payload]).alias("row"))
    order = F.struct(F.col("at").isNotNull(), F.col("at"), F.xxhash64("row"))
    best = packed.where("key is not null").groupBy("key").agg(F.max_by(F.struct("at", "row"), order).alias("best"))
    return best.select("key", F.col("best.at").alias("at"), "best.row.*")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, shared by all executors: `spark.checkpoint.dir`.

    Only a session in one process (`local[...]`, as in tests) may leave it unset: its temporary folder is then used. Anywhere
    else executors couldn't see such a folder, and an error says so.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Writes a table in the shared folder and reads it back: for wide rows of which later steps read a few columns.

    It is removed when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def remove() -> None:
        try:
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # noqa: BLE001, S110 - the session is gone
            pass

    atexit.register(remove)
    return spark.read.parquet(path)
