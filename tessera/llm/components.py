"""Connected components by hash-to-min (problems 1 and 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.common import checkpoint


#: Rows of one key that go through one task; keys with more are joined by a broadcast of at most MOST rows.
SPREAD, MOST = 1 << 18, 50_000


def with_least(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The rows, `n` of them at most, with `least`: the least value of each key.

    The least is found by a partial aggregation. Rows of a hot key aren't brought together to be joined with it: there
    are at most n / max(SPREAD, n / MOST) hot keys, so at most MOST, and they are broadcast.
    """
    spread = max(SPREAD, n // MOST)
    least = rows.groupBy(key).agg(F.min(value).alias("least"), F.count("*").alias("n"))
    hot, cold = least.where(F.col("n") > spread).drop("n"), least.where(F.col("n") <= spread).drop("n")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def stars(keyed: DataFrame) -> DataFrame:
    """Edges `a, b` that join what shares a key: every node with the least node of its key.

    `keyed` has `node` and `key`; null keys join nothing. A key shared by n nodes gives n edges, not n squared.
    """
    used = checkpoint(keyed.select("node", "key").where("node is not null and key is not null").distinct())
    return with_least(used, "key", "node", used.count()).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Columns `node, component` of all nodes of edges `a, b`; a component is named by its least node.

    Hash-to-min: each node holds a cluster, at first itself and its neighbours. In each round it sends its
    cluster to the least node of it, and that least node to every other of it, until nothing changes; then the least
    node of each component holds all of it. Clusters are rows (node, member), of which a hot node's are never brought
    together: see `with_least`. Rows with a null end are left out, loops and repeated edges change nothing, an empty table
    gives an empty one.
    """
    e = edges.select("a", "b").where("a is not null and b is not null")
    held = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(e.select("a", F.col("a").alias("b"))).unionByName(e.select(F.col("b").alias("a"), "b"))
    held, state = checkpoint(held.select(F.col("a").alias("node"), F.col("b").alias("member")).distinct()), None
    for _ in range(rounds):
        now = held.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "member").cast("decimal(20,0)")).alias("sum")).first()
        if now == state:
            return held.groupBy("node").agg(F.min("member").alias("component"))
        told, state = with_least(held, "node", "member", now["n"]), now
        held = checkpoint(told.select(F.col("least").alias("node"), "member").unionByName(told.select(F.col("member").alias("node"), F.col("least").alias("member"))).distinct())
    raise RuntimeError(f"components not stable after {rounds} rounds")
