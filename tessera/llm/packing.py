"""Filling containers of fixed capacity (problem 7): minimum bin slack over a table of sizes.

Items of one size are interchangeable, so a packing is worked out on how many items each size has. That
table has at most `capacity` rows, however many items there are; only it comes to the driver. Each step
finds, by a subset-sum over bit sets, the multiset of remaining sizes that fills one container best, and uses
it as often as the remaining counts allow. A step uses up at least one size or leaves less of it than a
pattern needs, so there are few patterns. The items then find their places by their rank within their size,
which is counted in two levels so that no size has to pass through one task.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import checkpoint

#: Items of one size that are ranked together; a size with more has more buckets, and each is a task's.
BUCKET_ROWS = 1 << 18


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of sizes, each at most as often as counted, whose sum is nearest to `room` from below.

    reach[k] has bit s set if the first k kinds of summand can make s; counts are split into powers of two,
    so that a size with many items costs few steps. Walking back from the best sum gives the summands.
    """
    parts, reach, mask = [], [1], (1 << (room + 1)) - 1
    for size in sorted(counts, reverse=True):
        left, lot = min(counts[size], room // size), 1
        while left > 0:
            take = min(lot, left)
            parts.append((size, take))
            reach.append((reach[-1] | (reach[-1] << size * take)) & mask)
            left, lot = left - take, lot * 2
        if reach[-1] >> room & 1:
            break
    total, out = reach[-1].bit_length() - 1, {}
    for k in range(len(parts), 0, -1):
        if not reach[k - 1] >> total & 1:
            size, take = parts[k - 1]
            out[size] = out.get(size, 0) + take
            total -= size * take
    return out


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, multiset) of each kind of container, until every item has its place.

    Each container starts with the largest item left; minimum bin slack fills the rest.
    """
    left, out = {size: n for size, n in counts.items() if n > 0}, []
    while left:
        first = max(left)
        rest = {size: n - (size == first) for size, n in left.items() if n > (size == first) and size <= capacity - first}
        fill = best_fill(rest, capacity - first)
        fill[first] = fill.get(first, 0) + 1
        times = min(left[size] // n for size, n in fill.items())
        out.append((times, fill))
        for size, n in fill.items():
            left[size] -= n * times
            if not left[size]:
                del left[size]
    return out


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """Columns `id, piece_no, start, size, container, place`: every item in exactly one container.

    An item larger than `capacity` is cut into pieces of `capacity`, each a container by itself, and a rest
    that is packed like any item; `start` is where a piece begins in its item. Null, zero and negative sizes
    take no place and don't come out. Repeated rows are items of their own. Ties are broken by id.
    `container` numbers count from 0 without gaps; an item's place in its container counts from 0.
    """
    spark = items.sparkSession
    sized = checkpoint(items.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("total"))).where("total > 0")  # sizes may be dear, and are read three times
    cut = F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / capacity))
    pieces = sized.select("id", "total", F.explode(cut).alias("piece")).withColumn("size", F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("int"))
    often = pieces.groupBy("size").agg(F.count("*").alias("n"))  # <= capacity rows
    spread = F.broadcast(often.select("size", F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets")))
    placed = pieces.join(spread, "size").withColumn("bucket", F.pmod(F.xxhash64("id", "total", "piece"), F.col("buckets"))).drop("buckets")
    cells = placed.groupBy("size", "bucket").agg(F.count("*").alias("n")).toPandas()  # <= capacity + pieces / BUCKET_ROWS rows
    cells = cells.sort_values(["size", "bucket"])
    counts = {int(k): int(v) for k, v in cells.groupby("size")["n"].sum().items()}
    plan, used, at, runs = patterns(counts, capacity), dict.fromkeys(counts, 0), 0, {size: [] for size in counts}
    for times, fill in plan:
        place = 0
        for size in sorted(fill, reverse=True):
            runs[size].append((used[size], at, fill[size], place))  # from this rank on: first container, items of the size in each, their first place
            used[size] += fill[size] * times
            place += fill[size]
        at += times
    before = {(int(s), int(b)): int(x) for s, b, x in zip(cells["size"], cells["bucket"], cells.groupby("size")["n"].cumsum() - cells["n"])}
    starts = {size: [r[0] for r in rows] for size, rows in runs.items()}
    sent = spark.sparkContext.broadcast((before, starts, runs))  # bounded as the cells are, and by the patterns

    def find(batches):
        before, starts, runs = sent.value
        for batch in batches:
            size, bucket, nth = (batch.column(k).to_pylist() for k in ("size", "bucket", "nth"))
            container, place = np.zeros(len(size), np.int64), np.zeros(len(size), np.int32)
            for i, s in enumerate(size):
                rank = before[s, bucket[i]] + nth[i] - 1
                first, base, each, shift = runs[s][bisect.bisect_right(starts[s], rank) - 1]
                container[i], place[i] = base + (rank - first) // each, shift + (rank - first) % each
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("piece"), batch.column("size"), pa.array(container), pa.array(place)], names=["id", "piece", "size", "container", "place"])

    ranked = placed.withColumn("nth", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("id", "total", "piece")))
    kind = items.schema[id_col].dataType.simpleString()
    shared = ranked.mapInArrow(find, f"id {kind}, piece long, size int, container long, place int")
    return shared.select("id", F.col("piece").cast("int").alias("piece_no"), (F.col("piece") * capacity).alias("start"), "size", "container", "place")
