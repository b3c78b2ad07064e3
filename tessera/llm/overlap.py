"""Records shared between splits (problem 3): a partitioned suffix array over the words of all texts.

Every place of every text begins a suffix. Suffixes are sorted by their head, the hash of their first SPAN words, and
the array is parted by range, so that a head many texts have is split over tasks like any other. Where adjacent
suffixes of different splits have one head, a span of SPAN words or more is shared; longer spans are runs of
suffixes that follow each other in the text, so no order beyond the head is needed. Regions at the borders of
partitions, and regions too large to be held, are judged by what all of their parts together hold. Merged per
record, the shared suffixes are its coverage.

Coverage also bounds what can be similar. Of two texts of which the larger has n distinct runs of three words and which
share at least half of all, at most a sixth of n were cut by edits, and an edit that cuts two runs of three words cuts at
most five of SPAN: so both have at least n / 6 - 3 shared suffixes in common. Texts with fewer shared suffixes than that
have no partner, and of the others only the rarest suffixes are compared, as many as it takes that two partners must
meet in one of them. In texts of fewer than FEW runs, where this says too little, suffixes with heads of SHORT words
are in the array too; for them the bound is the measure's own, half of n. Pairs that meet are checked exactly.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import checkpoint, stored
from tessera.llm import grams, neardup, regions

TRAIN, HELD_OUT = 1, 2
#: Words of the least span that counts as shared, and of the heads that short texts have besides; texts of fewer runs of three words are short.
SPAN, SHORT, FEW = 6, 3, 48
#: Texts of a region up to which all of its cross-split pairs are taken as they are; larger ones are compared block by block.
REGION = 48
#: The size of a region that isn't seen whole: such regions count as the least rare.
UNSEEN = 1 << 40


def class_key(cls: Column) -> Column:
    """A class with room for its sides in the last two bits."""
    return cls.bitwiseAND(F.lit(-4))


def sides(split: Column) -> Column:
    """1 for train, 2 for dev and test, null otherwise."""
    return F.when(split == "train", TRAIN).when(split.isin("dev", "test"), HELD_OUT)


def _suffixes(batches, places: bool):
    """Rows (head, who, info) of all suffixes. `who` is the class with its sides. With `places`, info is the place in words; else each head of a text stands once and info is the text's number of distinct runs of SHORT words."""
    for whole in batches:
        for batch in (whole.slice(at, 2000) for at in range(0, len(whole), 2000)):
            who = batch.column("cls").to_numpy() | batch.column("side").to_numpy().astype(np.int64)
            for at, data, ends in grams.chunks(batch.column("code")):
                hashed, text = grams.words(data, ends)
                key, first = grams.runs(hashed, text, SPAN)
                if places:
                    begin = np.searchsorted(text, np.arange(len(ends)), side="left")
                    head, owner, info = key & ~np.uint64(1), text[first], first - begin[text[first]]
                else:
                    three, third = grams.runs(hashed, text, SHORT)
                    n = np.bincount(_distinct(text[third], three)[0], minlength=len(ends))
                    few = n[text[third]] < FEW
                    owner, head = _distinct(np.concatenate((text[first], text[third][few])), np.concatenate((key & ~np.uint64(1), three[few] | np.uint64(1))))
                    info = n[owner]
                if len(owner):
                    yield pa.RecordBatch.from_arrays([pa.array(head.astype(np.int64)), pa.array(who[owner + at]), pa.array(info.astype(np.int32))], names=["head", "who", "info"])


def _distinct(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of the two."""
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    fresh = np.concatenate((np.ones(min(1, len(owner)), bool), (np.diff(owner) != 0) | (key[1:] != key[:-1])))
    return owner[fresh], key[fresh]


def _shared(batches, hold: int):
    """Rows (head, who, info, size, seen) of suffixes in regions of both sides, and of all in regions that aren't seen whole."""
    for (head, who, info), ends, whole in regions.walk(batches, ["head", "who", "info"], hold):
        size = np.diff(np.concatenate(([0], ends)))
        take = np.repeat(~whole | (np.bitwise_or.reduceat(who & 3, ends - size) == TRAIN | HELD_OUT), size)
        seen, each = np.repeat(whole, size)[take], np.repeat(size, size)[take]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (head[take], who[take], info[take], np.where(seen, each, UNSEEN), seen)], names=["head", "who", "info", "size", "seen"])


def _both(rows: DataFrame) -> DataFrame:
    """The rows of heads that both sides have, of rows whose heads are few: at most two for each partition and one for HOLD rows, so they are broadcast."""
    sided = rows.groupBy("head").agg(F.bit_or(F.col("who").bitwiseAND(3)).alias("s")).where(F.col("s") == TRAIN | HELD_OUT)
    return rows.join(F.broadcast(sided.select("head")), "head")


def shared(texts: DataFrame, places: bool = False, hold: int | None = None) -> DataFrame:
    """Columns `head, who, info, size` of every suffix whose head stands in texts of both sides, from the sorted array.

    `texts` has `cls` (distinct, by `class_key`), `side` (1, 2 or both: 3) and `code`; null and short texts have no suffixes.
    """
    rows = texts.select("cls", "side", "code").mapInArrow(partial(_suffixes, places=places), "head long, who long, info int")
    found = stored(regions.parted(rows, "head", "who").mapInArrow(partial(_shared, hold=hold or regions.HOLD), "head long, who long, info int, size long, seen boolean"))
    return found.where("seen").drop("seen").unionByName(_both(found.where("not seen").drop("seen")))


def _crossing(who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(train, held out) of all pairs of a region that belong to different splits."""
    train, held = who[who & TRAIN > 0] & ~3, who[who & HELD_OUT > 0] & ~3
    return np.repeat(train, len(held)), np.tile(held, len(train))


def candidates(found: DataFrame) -> DataFrame:
    """The rarest suffixes (`head, who`) of each text that has enough shared ones, from `shared` without places."""
    own = Window.partitionBy("who", "kind")  # a text's own suffixes
    n, s = F.col("info"), F.count("*").over(own)
    ranked = found.withColumn("kind", F.col("head").bitwiseAND(1)).withColumn("s", s).withColumn("nth", F.row_number().over(own.orderBy("size", "head")))
    least = F.when(F.col("kind") == 1, F.ceil(n / 2)).otherwise(F.greatest(F.lit(1), F.floor(n / 6) - 3))
    return ranked.where(F.col("nth") <= F.col("s") - least + 1).select("head", "who")


def _across(hot: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b) of large regions: train and held-out texts are cut into blocks, and each pair of a block of either is a task of its own. Sketches are compared inside, so only pairs that may be similar leave it."""
    way = F.col("who").bitwiseAND(3)
    train, held = way.bitwiseAND(TRAIN) > 0, way.bitwiseAND(HELD_OUT) > 0
    sized = hot.groupBy("hot").agg(F.ceil(F.count_if(train) / neardup.BLOCK).cast("int").alias("nt"), F.ceil(F.count_if(held) / neardup.BLOCK).cast("int").alias("nh")).where("nt > 0 and nh > 0")
    mine = hot.join(sized, "hot").withColumn("cls", class_key(F.col("who"))).join(sketches, "cls")

    def blocks(mask: Column, side: int, n: str, others: str, own: str, other: str) -> DataFrame:
        placed = mine.where(mask).select("hot", "cls", "sketch", F.lit(side).alias("side"), F.pmod(F.xxhash64("cls"), F.col(n)).cast("int").alias(own), others)
        return placed.select("hot", "cls", "sketch", "side", own, F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other))

    laid = blocks(train, TRAIN, "nt", "nh", "t", "h").unionByName(blocks(held, HELD_OUT, "nh", "nt", "h", "t"))

    def compare(table: pa.Table) -> pa.Table:
        cls, side = table.column("cls").to_numpy(), table.column("side").to_numpy()
        rows = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(cls), -1)
        right = np.flatnonzero(side == HELD_OUT)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(side == TRAIN):
            near = right[neardup.agreement(rows[i], rows[right]) >= least * neardup.SLACK]
            a.append(np.full(len(near), cls[i]))
            b.append(cls[near])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return laid.groupBy("hot", "t", "h").applyInArrow(compare, "a long, b long")


def links(texts: DataFrame, least: float, k: int = SHORT, region: int = REGION, hold: int | None = None) -> DataFrame:
    """Columns `a` (train), `b` (held out), `similarity` of different classes of texts at least so similar, at least 0.5, on runs of k words."""
    met = checkpoint(regions.meet(candidates(shared(texts, hold=hold)).withColumnRenamed("head", "key"), _crossing, region, hold))
    hot = met.where("hot is not null").select("hot", "who")

    def sets(of: DataFrame) -> DataFrame:
        some = texts.select("cls", "code").join(of.distinct(), "cls", "left_semi")
        return some.select("cls", neardup.sets_of(F.col("code"), k).alias("s")).select("cls", F.col("s.grams").alias("grams")).where("grams is not null")

    sketches = sets(hot.select(class_key(F.col("who")).alias("cls"))).mapInArrow(neardup.sketch, "cls long, sketch binary")
    pairs = met.where("a is not null").select("a", "b").unionByName(_across(hot, sketches, least))
    pairs = checkpoint(pairs.where("a <> b").distinct())
    return neardup.measured(pairs, sets(pairs.select(F.explode(F.array("a", "b")).alias("cls"))), least)


def sequence_of(text: Column) -> Column:
    """Hash of a text's words in their order; texts of one hash have the same spans at the same places."""

    @F.arrow_udf("bigint")
    def find(texts: pa.Array) -> pa.Array:
        import xxhash

        out = np.zeros(len(texts), np.int64)
        for at, data, ends in grams.chunks(texts):
            hashed, text = grams.words(data, ends)
            bounds = np.searchsorted(text, np.arange(len(ends) + 1))
            for i in range(len(ends)):
                out[at + i] = np.uint64(xxhash.xxh3_64_intdigest(hashed[bounds[i] : bounds[i + 1]].tobytes())).astype(np.int64)
        return pa.array(out)

    return find.asNondeterministic()(text)


def coverage(texts: DataFrame, hold: int | None = None) -> DataFrame:
    """Columns `cls, covered`: how many words of each held-out text lie in spans of SPAN words or more that some train text has too.

    `texts` as for `shared`, of classes by `sequence_of`. Texts without such spans have no row.
    """
    held = shared(texts, places=True, hold=hold).where(F.col("who").bitwiseAND(HELD_OUT) > 0).select(class_key(F.col("who")).alias("cls"), F.col("info").alias("pos"))
    to_next = F.lead("pos").over(Window.partitionBy("cls").orderBy("pos")) - F.col("pos")  # a text's own suffixes
    return held.withColumn("fresh", F.least(F.lit(SPAN), F.coalesce(to_next, F.lit(SPAN)))).groupBy("cls").agg(F.sum("fresh").alias("covered"))
