"""Folds of nearly equal size from groups that stay whole, and work on them side by side."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """group, size, fold: the largest group first, each to the fold with the fewest rows so far (the first on ties); ties of groups by name, null first.

    A group is one row here; they stream through one task in order, which keeps a number for each fold.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    kind = df.schema[group].dataType.simpleString()

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = [(0, k) for k in range(folds)]
        for frame in frames:
            out = []
            for size in frame["size"]:
                rows, k = load[0]
                heapq.heapreplace(load, (rows + size, k))
                out.append(k)
            yield frame.assign(fold=out)

    ordered = sizes.repartition(1).sortWithinPartitions(F.desc("size"), F.col(group).asc_nulls_first())
    return ordered.mapInPandas(deal, f"{group} {kind}, size long, fold int")


def with_fold(df: DataFrame, group: str, folds: int) -> DataFrame:
    """df with fold, see balanced_folds."""
    dealt = balanced_folds(df, group, folds).select(F.col(group).alias("_group"), "fold")
    return df.join(dealt, df[group].eqNullSafe(dealt["_group"])).drop("_group")


def at_once(df: DataFrame, work: Callable, items) -> list:
    """work of each of a few items (folds, families), side by side, in their order: fits are many short jobs, each too small for all cores."""
    items = list(items)
    with ThreadPool(len(items)) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(work), items, 1)
