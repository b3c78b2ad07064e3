"""Near-duplicate records (problem 2): an LSH forest over signatures, then an exact check.

Every record is taken to the set of its runs of words; records with one set are one class. A class has a
min-hash signature, of which each tree of the forest reads the values in an order of its own. Sorted in such an
order, similar classes stand together: their labels share a long prefix. Two classes become candidates where they share
a prefix of DEPTH values in some tree. The forest is parted by range, so a prefix that many classes have is split.

Where more than REGION classes share a prefix, a longer one would part pairs that no other tree need bring together. Such
a region goes deeper by the runs themselves instead: its classes are sorted by their rarest runs, as many of each as it
takes that two classes similar enough must share one. Nothing is lost by that, and classes that only have a notice in
common part at once. What is still large then holds classes that share even rare runs, and is compared block by block.

Candidates whose signatures agree too little are dropped, the rest are checked on the sets themselves. With similarity s,
a pair shares a prefix in one of the trees with probability 1 - (1 - s**4)**56: 0.9996 at 0.6 and 0.973 at 0.5, however
large the regions are.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.common import checkpoint
from tessera.llm import grams, regions

TREES, DEPTH, REGION, BLOCK = 56, 4, 48, 512
#: Bits of the table in which runs of large regions are counted; it is broadcast, 4 bytes for each of its 2 ** SLOTS counts.
SLOTS = 18
#: Agreement of signatures, as a share of the similarity asked for, below which candidates are dropped.
SLACK = 0.7

_SEEDS = grams.seeds(TREES * DEPTH)


def sets_of(text: Column, k: int) -> Column:
    """A text's class and set: struct<cls: hash of the set, or of the text if it has no k words, n: size of the set, grams: its sorted 32-bit values>."""

    @F.arrow_udf("struct<cls:bigint,n:int,grams:binary>")
    def find(texts: pa.Array) -> pa.Array:
        import xxhash

        cls, n, out = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int32), [None] * len(texts)
        for i, values in grams.gram_sets(texts, k):
            raw = values.tobytes()
            if not len(values):
                raw = b"text:" + (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
            else:
                out[i] = raw
            cls[i], n[i] = np.uint64(xxhash.xxh3_64_intdigest(raw)).astype(np.int64), len(values)
        return pa.StructArray.from_arrays([pa.array(cls), pa.array(n), pa.array(out, pa.binary())], ["cls", "n", "grams"])

    return find.asNondeterministic()(text)  # else filters on the result would run it twice


def _signed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw = batch.column("grams").to_pylist()
    bounds = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raw])))
    return batch.column("cls").to_numpy(), grams.signatures(np.frombuffer(b"".join(raw), np.uint32), bounds, _SEEDS)


def _small(batches):
    """Batches of bounded size, so that signatures fit into memory."""
    for batch in batches:
        for at in range(0, len(batch), 2000):
            yield batch.slice(at, 2000)


def _plant(batches):
    """A row per class and tree: the first DEPTH values of its label as one key, the class."""
    weights = (np.random.default_rng(7).integers(1, 1 << 62, DEPTH, dtype=np.uint64) * np.uint64(2)) + np.uint64(1)
    for batch in _small(batches):
        if not len(batch):
            continue
        cls, sig = _signed(batch)
        wide = sig.astype(np.uint64)
        for tree in range(TREES):
            key = np.full(len(cls), tree, np.uint64)
            for j in range(DEPTH):
                key = grams.mix(key * weights[j] + wide[:, tree * DEPTH + j])
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(cls)], names=["key", "who"])


def _pairs(who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a region."""
    i, j = np.triu_indices(len(who), 1)
    return np.minimum(who[i], who[j]), np.maximum(who[i], who[j])


def _slot(values: np.ndarray) -> np.ndarray:
    return (grams.mix(values.astype(np.uint64)) >> np.uint64(64 - SLOTS)).astype(np.int64)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The values of all sets, and how many each has."""
    raw = batch.column("grams").to_pylist()
    return np.frombuffer(b"".join(raw), np.uint32), np.array([len(x) // 4 for x in raw], np.int64)


def _counted(batches):
    """How often runs fall into each slot, once per task."""
    total = np.zeros(1 << SLOTS, np.int64)
    for batch in _small(batches):
        values, _ = _flat(batch)
        total += np.bincount(_slot(values), minlength=1 << SLOTS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])


def _rarest(batches, sent, least: float):
    """Rows (key, who): of each class its rarest runs, so many that two classes of a similarity of `least` share one of them.

    Such classes have at least `least` of the larger's runs in common, so any order of runs that is the same for all will do.
    """
    for batch in _small(batches):
        values, n = _flat(batch)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((values, sent.value[_slot(values)], owner))
        nth = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
        take = order[nth < np.repeat(n - np.ceil(least * n - 1e-9).astype(np.int64) + 1, n)]
        yield pa.RecordBatch.from_arrays([pa.array(values[take].astype(np.int64)), pa.array(batch.column("cls").to_numpy()[owner[take]])], names=["key", "who"])


def sketch(batches):
    """Four bits of each value of the signature, packed."""
    for batch in _small(batches):
        if len(batch):
            cls, sig = _signed(batch)
            low = (sig & np.uint32(15)).astype(np.uint8)
            packed = (low[:, ::2] << 4) | low[:, 1::2]
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array([x.tobytes() for x in packed], pa.binary())], names=["cls", "sketch"])


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity as the sketches tell it: agreeing halves of bytes, less those that agree by chance."""
    x = a ^ b
    share = ((x & 15) == 0).sum(-1) + ((x >> 4) == 0).sum(-1)
    return (share / (2 * a.shape[-1]) - 1 / 16) / (15 / 16)


def alike(a: Column, b: Column, least: float) -> Column:
    """Whether two sketches agree enough for a similarity of `least`."""

    @F.arrow_udf("boolean")
    def check(x: pa.Array, y: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.bool_())
        rows = [np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(len(v), -1) for v in (x, y)]
        return pa.array(agreement(*rows) >= least * SLACK)

    return check(a, b)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets from `sets_of`."""

    @F.arrow_udf("double")
    def measure(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([grams.jaccard(p, q) for p, q in zip(x.to_pylist(), y.to_pylist())], pa.float64())

    return measure.asNondeterministic()(a, b)


def blocks(hot: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Candidates within regions that stayed large: each region is cut into blocks of some BLOCK classes, and each pair of blocks is a task of its own.

    Sketches are compared inside the task, so only pairs that may be similar leave it.
    """
    hot = hot.select("hot", "cls")
    sized = hot.join(hot.groupBy("hot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")), "hot")
    mine = sized.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("n")).cast("int")).join(sketches, "cls")
    paired = mine.select("hot", "cls", "sketch", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    task = paired.groupBy("hot", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def compare(table: pa.Table) -> pa.Table:
        cls, block = table.column("cls").to_numpy(), table.column("block").to_numpy()
        rows = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(cls), -1)
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in left:
            near = right[agreement(rows[i], rows[right]) >= least * SLACK]
            near = near[cls[near] != cls[i]]
            a.append(np.minimum(cls[i], cls[near]))
            b.append(np.maximum(cls[i], cls[near]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return task.applyInArrow(compare, "a long, b long").distinct()


def links(classes: DataFrame, least: float) -> DataFrame:
    """Columns `a, b, similarity` (a < b) of classes at least so similar.

    `classes` has `cls` (distinct) and `grams`, not null; classes without words have no links.
    """
    classes, sc = classes.select("cls", "grams"), classes.sparkSession.sparkContext
    forest = checkpoint(regions.meet(classes.mapInArrow(_plant, "key long, who long"), _pairs, REGION))
    large = regions.some(classes, checkpoint(forest.where("hot is not null").select(F.col("who").alias("cls")).distinct()), "cls")
    table = np.zeros(1 << SLOTS, np.int64)
    counts = large.mapInArrow(_counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most 2 ** SLOTS rows
    table[counts["slot"].to_numpy(np.int64)] = counts["n"]
    deeper = checkpoint(regions.meet(large.mapInArrow(partial(_rarest, sent=sc.broadcast(table), least=least), "key long, who long"), _pairs, REGION))
    sketches = classes.mapInArrow(sketch, "cls long, sketch binary")
    near = forest.unionByName(deeper).where("a is not null").select("a", "b").distinct()
    near = near.join(sketches.select(F.col("cls").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("cls").alias("b"), F.col("sketch").alias("y")), "b")
    near = near.where(alike(F.col("x"), F.col("y"), least)).select("a", "b")
    hot = deeper.where("hot is not null").select("hot", F.col("who").alias("cls"))
    near = checkpoint(near.unionByName(blocks(hot, sketches, least)).distinct())
    return measured(near, classes, least)


def measured(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs `a, b` with their exact similarity, if it is at least `least`. Sets of classes in no pair aren't moved twice."""
    needed = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    sets = regions.some(classes, needed, "cls").select("cls", "grams")
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("y")), "b")
    return both.select("a", "b", similarity(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") >= least)


def expand(links: DataFrame, members: DataFrame) -> DataFrame:
    """Columns `id_a, id_b` (id_a < id_b) of all pairs of records: of linked classes, and of one class.

    `members` has `id` and `cls`. Where a task asks for pairs of records; classes and links say the same in less room.
    """
    a, b = (members.select(F.col("cls").alias(c), F.col("id").alias(f"id_{c}")) for c in "ab")
    across = links.select("a", "b").join(a, "a").join(b, "b").select("id_a", "id_b")
    within = a.join(b.withColumnRenamed("b", "a"), "a").where("id_a < id_b").select("id_a", "id_b")
    return across.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).unionByName(within)
