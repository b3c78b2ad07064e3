"""The keyed dataset: current rows, merges that keep labels, splits by hash, leakage and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_hash(seed: Column, fingerprint: Column) -> Column:
    """A number in [0, 1) from seed and fingerprint."""
    return F.conv(F.substring(F.sha2(F.concat(seed, F.lit("\0"), fingerprint), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def assign_split(x: Column, train: Column, dev: Column) -> Column:
    return F.when(x < train, "train").when(x < train + dev, "dev").when(x.isNotNull(), "test")


def first_owner(rows: DataFrame, key: str, order: list[Column], owner: list[str]) -> DataFrame:
    """Rows with the owner of the first row of their key, as struct `first`. Null keys own nothing.

    The first is found by a partial aggregation and joined back, so a key with very many rows passes through no one task.
    """
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*owner), F.struct(*order)).alias("first"))
    return rows.join(first, key, "left")


def upsert(old: DataFrame, new: DataFrame, key: str, now: Column) -> DataFrame:
    """A full outer merge by key: matched rows keep `human` and `created`, new ones come in, ones not found again become stale.

    Both have `key`, `code_hash`, `status`, `origin`, `human`, `human_hash`, `created`, `updated`. A label on code that
    changed is kept and marked `needs_recheck`. Missed decisions, which no run finds, stay as they are.
    """
    o, n = old.select(F.col(key), F.struct(*[c for c in old.columns if c != key]).alias("o")), new.select(F.col(key), F.struct(*[c for c in new.columns if c != key]).alias("n"))
    j = o.join(n, key, "full_outer")
    found, kept = F.col("n").isNotNull(), F.col("o.origin") == "missed"
    action = F.when(found & F.col("o").isNotNull(), "updated").when(found, "added").when(kept, "kept").when(F.col("o.status") == "stale", "stale").otherwise("became_stale")
    return j.select(
        key,
        action.alias("action"),
        F.when(found, "active").when(kept, F.col("o.status")).otherwise("stale").alias("status"),
        F.when(found, F.col("n.code_hash")).otherwise(F.col("o.code_hash")).alias("code_hash"),
        F.col("o.human").alias("human"),
        F.when(found & F.col("o.human").isNotNull(), ~F.col("o.human_hash").eqNullSafe(F.col("n.code_hash"))).alias("needs_recheck"),
        F.coalesce("o.created", now).alias("created"),
        F.when(found, now).when(kept | (F.col("o.status") == "stale"), F.col("o.updated")).otherwise(now).alias("updated"),
    )


def replace_keyed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key isn't among the new, and the new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def fresh_hits(wanted: DataFrame, cache: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Wanted keys with `hit`: cached, and every recorded item (`key, item, hash`) still has the hash of `items`."""
    broken = cache.join(items.withColumnRenamed("hash", "now"), "item", "left").where(~F.col("hash").eqNullSafe(F.col("now"))).select(key).distinct().withColumn("broken", F.lit(True))
    known = cache.select(key).distinct().withColumn("known", F.lit(True))
    return wanted.join(known, key, "left").join(broken, key, "left").select(wanted["*"], (F.coalesce("known", F.lit(False)) & F.coalesce(~F.col("broken"), F.lit(True))).alias("hit"))


def broken(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold for a row; a null rule doesn't hold."""
    return F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())


def problems(rows: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """Columns `key, problem`: every rule that holds for a row; a null rule doesn't hold."""
    return rows.select(key.alias("key"), F.explode(broken(rules)).alias("problem"))


def budget_gate(rows: DataFrame, group: list[str], order: list[Column], cost: Column, budget: float) -> DataFrame:
    """Rows with `spent` before them and whether they still `run`: a call starts while what was spent before is below the budget."""
    before = F.sum(cost).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("spent", F.round(F.coalesce(before, F.lit(0.0)), 6)).withColumn("run", F.col("spent") < budget)
