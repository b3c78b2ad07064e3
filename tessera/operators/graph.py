"""Graphs as tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.common import checkpoint


def undirected(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Both directions of every edge, once; no loops."""
    e = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src is not null and dst is not null and src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reach(edges: DataFrame, start: DataFrame, levels: int, stop: DataFrame | None = None) -> DataFrame:
    """Columns `node, level`: nodes within so many steps of `start` (`node`), each at its least level.

    Nodes of `stop` are reached but not passed. Each level is one join with what is new, whose lineage is cut;
    what was seen before is left out by an anti join.
    """
    seen = new = checkpoint(start.select("node").distinct().withColumn("level", F.lit(0)))
    for level in range(1, levels + 1):
        open_ = new if stop is None else new.join(stop.select("node").distinct(), "node", "left_anti")
        found = open_.join(edges, open_["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        new = checkpoint(found.withColumn("level", F.lit(level)))
        seen = seen.unionByName(new)
    return seen
