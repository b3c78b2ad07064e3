"""Ordered folds: decisions that depend on what was decided before, streamed in order. A fold keeps its state, one number for a budget, all kept intervals for `no_overlap`, and never the rows."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame


def fold(rows: DataFrame, keys: list[str], order: list[Column], start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, dict]], schema: str) -> DataFrame:
    """Runs `step(state, row) -> (state, out)` over the rows of each key in order.

    Keys are spread over tasks and sorted by Spark, which spills; Python sees one batch at a time and keeps one
    state per key, so a key may have any number of rows. The order must be total for a defined result.
    """
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            out = []
            for values in batch.itertuples(index=False, name=None):
                row = dict(zip(names, values))
                key = tuple(row[k] for k in keys)
                if key != at or state is None:
                    at, state = key, start()
                state, made = step(state, row)
                out.append(made)
            if out:
                yield pd.DataFrame(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def budget_with_skip(rows: DataFrame, keys: list[str], order: list[Column], item: str, size: str, budget: int, schema: str) -> DataFrame:
    """`taken` and `used`: a row is taken if it still fits; a later smaller one may fit where a larger didn't."""

    def step(used: int, row: dict):
        fits = used + row[size] <= budget
        used += row[size] if fits else 0
        return used, {**{k: row[k] for k in keys}, item: row[item], "taken": fits, "used": used}

    return fold(rows, keys, order, int, step, schema)


def next_fit(rows: DataFrame, keys: list[str], order: list[Column], item: str, size: str, capacity: int, schema: str) -> DataFrame:
    """`part`: rows go into the open part while they fit, else into a new one."""

    def step(state: tuple[int, int], row: dict):
        part, used = state
        if used and used + row[size] > capacity:
            part, used = part + 1, 0
        return (part, used + row[size]), {**{k: row[k] for k in keys}, item: row[item], "part": part}

    return fold(rows, keys, order, lambda: (0, 0), step, schema)


def choose(rows: DataFrame, keys: list[str], order: list[Column], item: str, size: str, score: str, budget: int, extra: int, few: int, schema: str) -> DataFrame:
    """`chosen`: a row is chosen if it, and `extra` besides, still fits; one without score only while fewer than `few` are chosen."""

    def step(state: tuple[int, int], row: dict):
        used, n = state
        need = row[size] + extra
        chosen = used + need <= budget and not (not row[score] and n >= few)
        return (used + need, n + 1) if chosen else state, {**{k: row[k] for k in keys}, item: row[item], "chosen": chosen}

    return fold(rows, keys, order, lambda: (0, 0), step, schema)


def smallest_first(rows: DataFrame, keys: list[str], order: list[Column], item: str, size: str, parts: str, schema: str) -> DataFrame:
    """`part`: each row goes into the part that is smallest so far, of as many as column `parts` says; with rows from the largest on, parts come out alike."""

    def step(heap: list | None, row: dict):
        heap = heap or [(0, p) for p in range(row[parts])]
        used, part = heapq.heappop(heap)
        heapq.heappush(heap, (used + row[size], part))
        return heap, {**{k: row[k] for k in keys}, item: row[item], "part": part}

    return fold(rows, keys, order, list, step, schema)


def no_overlap(rows: DataFrame, keys: list[str], order: list[Column], item: str, schema: str) -> DataFrame:
    """`kept`: an interval is kept if it shares no line with one kept before. Kept intervals are disjoint and found by bisection."""
    import bisect

    def step(kept: list, row: dict):
        at = bisect.bisect_right(kept, (row["end"], float("inf"))) - 1
        free = at < 0 or kept[at][1] < row["start"]
        if free:
            bisect.insort(kept, (row["start"], row["end"]))
        return kept, {**{k: row[k] for k in keys}, item: row[item], "kept": free}

    return fold(rows, keys, order, list, step, schema)
