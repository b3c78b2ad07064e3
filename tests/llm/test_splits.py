import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import splits
from tessera.llm.components import components, stars


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "loops"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {"random": [(rng.randrange(120), rng.randrange(120)) for _ in range(90)], "chain": [(i, i + 1) for i in rng.sample(range(200), 180)], "star": [(0, i) for i in range(1, 150)] + [(300, 301)], "loops": [(1, 1), (2, 3), (3, 2), (2, 3)]}[shape]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int").withColumn("node", F.lit(1))).collect()}
    assert got == brute(edges)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
    assert components(spark.createDataFrame([(None, "x"), ("y", None)], "a string, b string")).count() == 0


def test_stars_are_linear(spark):
    keyed = spark.createDataFrame([(i, "k") for i in range(100)] + [(7, "k"), (200, None), (None, "k")], "node int, key string")
    assert stars(keyed).count() == 99


SAME = ["https://git.forge.example/own/Name", "http://www.git.forge.example/own/name/", " git.forge.example/own/name ", "ssh://git@git.forge.example/own/name", "ssh://git@git.forge.example:22/own/name.git", "git@git.forge.example:own/name.git", "git+https://git.forge.example/own/name.git#v2", "HTTPS://GIT.FORGE.EXAMPLE/OWN/NAME/tree/main?x=1", "https://user:pw@git.forge.example//own/name/blob/main/a.ts", "git://git.forge.example/own/name"]


def test_addresses(spark):
    rows = spark.createDataFrame([(s,) for s in SAME], "s string").select(splits.repository(F.col("s")).alias("r")).collect()
    assert {r.r for r in rows} == {"git.forge.example/own/name"}
    odd = spark.createDataFrame([("unknown",), ("",), (None,), ("https://git.forge.example",), ("https://git.forge.example/own",)], "s string")
    assert all(r.r is None for r in odd.select(splits.repository(F.col("s")).alias("r")).collect())


PROJECTS = "slug string, fingerprint string, source string, split string, updated string, component string, at int"


def test_groups(spark):
    t = "2026-01-01T00:00:00Z"
    rows = [("A ", "F1", None, "train", t), ("b", "f1 ", "n/a", "dev", t), ("c", None, SAME[0], None, t), ("d", "000000", SAME[5], "x", t), ("e", "f1", SAME[3], "test", t), ("f", "unknown", "unknown", "train", t), ("g", "", "", "train", t), ("h", "old", SAME[0], "train", "2025-01-01T00:00:00Z"), ("h", "new", None, "train", t), (None, "f1", None, None, t), ("b", "f1", None, "dev", t)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], PROJECTS)
    g = splits.groups(splits.projects(df))
    assert {r.slug: r.component for r in g.collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "a", "f": "f", "g": "g", "h": "h"}
    assert splits.pairs(g).count() == 10
    empty = splits.groups(splits.projects(df.where("false")))
    assert empty.count() == 0 and splits.pairs(empty).count() == 0
    assert splits.assign(empty, spark.createDataFrame([], "slug string, entries long"), {"train": 0.6, "dev": 0.2, "test": 0.2}, "s").count() == 0


def test_assign(spark):
    rng = random.Random(4)
    sizes = [(f"p{i}", 3000 if i == 0 else rng.randrange(0, 40)) for i in range(1500)]
    g = spark.createDataFrame([(s, "p0" if i in (0, 7) else f"p{i // 2 * 2}") for i, (s, _) in enumerate(sizes)], "slug string, component string")
    ratios = {"train": 0.6, "dev": 0.2, "test": 0.2}
    rows = splits.assign(g, spark.createDataFrame(sizes, "slug string, entries long"), ratios, "seed").collect()
    assert len(rows) == 1500 and all(r.split in ratios for r in rows)
    where = {}
    for r in rows:
        assert where.setdefault(r.component, r.split) == r.split
    total = sum(n for _, n in sizes)
    for name, share in ratios.items():
        assert abs(sum(r.entries for r in rows if r.split == name) / total - share) < 0.04
    again = splits.assign(g.orderBy(F.desc("slug")), spark.createDataFrame(sizes, "slug string, entries long"), ratios, "seed").collect()
    assert {r.slug: r.split for r in again} == {r.slug: r.split for r in rows}
    # fixed weights: who is there besides moves nobody
    fixed = {"train": 0.5, "dev": 0.3, "test": 0.2}
    one = {r.slug: r.split for r in splits.assign(g, spark.createDataFrame(sizes, "slug string, entries long"), ratios, "seed", fixed).collect()}
    less = {r.slug: r.split for r in splits.assign(g.where("slug <> 'p0'"), spark.createDataFrame(sizes, "slug string, entries long"), ratios, "seed", fixed).collect()}
    assert all(one[s] == split for s, split in less.items())


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.components.SPREAD", 10)
    edges = [(0, i) for i in range(1, 60)] + [(100, 101), (101, 102), (None, 5)] + [(i, 59) for i in range(200, 230)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**dict.fromkeys([*range(60), *range(200, 230)], 0), 100: 100, 101: 100, 102: 100}
