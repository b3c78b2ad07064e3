"""Walks over sorted rows, region by region: what problems 2 and 3 share.

A region is the rows of one value of the first column. Rows are parted by range over all columns, so a value that
many rows have is split over tasks like any other; regions at the borders of a partition are then not seen whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one region that are held at once.
HOLD = 1 << 18
#: Rows of one number each, 8 bytes, up to which a table is broadcast; beyond that it is joined by a shuffle.
FEW = 1 << 20


def some(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in `of`, a checkpointed table of distinct keys: what is broad needn't be moved if these are few."""
    return rows.join(F.broadcast(of) if of.count() <= FEW else of, key, "left_semi")


def parted(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows parted by range and sorted by the columns."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(partitions, *columns).sortWithinPartitions(*columns)


def walk(batches, columns: list[str], hold: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(columns, ends of regions, which were seen whole) of a sorted partition. Its first and its last region, and regions above `hold` rows, which come in parts, aren't seen whole."""
    held, before, loose = None, False, None
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        cuts = np.flatnonzero(np.diff(cols[0])) + 1
        if len(cuts):
            whole = np.ones(len(cuts), bool)
            whole[0] = before and cols[0][0] != loose
            yield [c[: cuts[-1]] for c in cols], cuts, whole
            cols, before, loose = [c[cuts[-1] :] for c in cols], True, None
        if len(cols[0]) > hold:
            loose, before = cols[0][0], True
            yield cols, np.array([len(cols[0])]), np.zeros(1, bool)
            cols = [c[:0] for c in cols]
        held = cols
    if held is not None and len(held[0]):
        yield held, np.array([len(held[0])]), np.zeros(1, bool)


def _meet(batches, pairs: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], region: int, hold: int):
    for (key, who), ends, whole in walk(batches, ["key", "who"], hold):
        starts = np.concatenate(([0], ends[:-1]))
        small, a, b = whole & (ends - starts <= region), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in zip(starts[small & (ends - starts > 1)], ends[small & (ends - starts > 1)]):
            left, right = pairs(who[x:y])
            a.append(left)
            b.append(right)
        a, b = np.concatenate(a), np.concatenate(b)
        large = np.repeat(~small, ends - starts)
        n, none = len(a), np.zeros(large.sum(), np.int64)
        other = np.arange(n + len(none)) >= n
        cols = [np.concatenate((a, none)), np.concatenate((b, none)), np.concatenate((np.zeros(n, np.int64), key[large])), np.concatenate((np.zeros(n, np.int64), who[large]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, mask=other if i < 2 else ~other) for i, c in enumerate(cols)], names=["a", "b", "hot", "who"])


def meet(rows: DataFrame, pairs: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], region: int, hold: int | None = None) -> DataFrame:
    """Columns `a, b`: what `pairs` makes of each region of `key` of up to `region` rows; and `hot, who`: the key and members of those that are larger or not seen whole."""
    return parted(rows.select("key", "who"), "key", "who").mapInArrow(partial(_meet, pairs=pairs, region=region, hold=hold or HOLD), "a long, b long, hot long, who long")
