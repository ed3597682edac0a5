"""Exact samples and splits, keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Digits of a hash that name its cell: 4,096 cells for a group.
CELL_DIGITS = 3


def _hash_order(key: str, seed: int):
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def largest_remainder(sizes: DataFrame, stratum: str, n: int) -> DataFrame:
    """stratum, quota: n rows shared in proportion to size; what whole parts leave goes to the largest remainders."""
    every = W.partitionBy()
    q = sizes.withColumn("_exact", F.col("size") * n / F.sum("size").over(every)).withColumn("_whole", F.floor("_exact"))
    left = n - F.sum("_whole").over(every)
    q = q.withColumn("_left", left).withColumn("_r", F.row_number().over(W.orderBy(F.desc(F.round(F.col("_exact") - F.col("_whole"), 9)), stratum)))
    return q.select(stratum, (F.col("_whole") + (F.col("_r") <= F.col("_left")).cast("long")).alias("quota"))


def _cells(df: DataFrame, by: str, key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows, cells): rows with `_h`, their hash, and `_c`, its first digits; cells (_by, _at) with `_before`, the rows of the group in earlier cells, and `_n`, all its rows.

    A group is sorted cell by cell, so no task holds a whole group.
    """
    rows = df.withColumn("_h", _hash_order(key, seed)).withColumn("_c", F.substring("_h", 1, CELL_DIGITS))
    cells, group = rows.groupBy(F.col(by).alias("_by"), F.col("_c").alias("_at")).agg(F.count("*").alias("_in")), W.partitionBy("_by")
    before = F.sum("_in").over(group.orderBy("_at")) - F.col("_in")
    return rows, cells.withColumns({"_before": before, "_n": F.sum("_in").over(group)}).drop("_in")


def _place(by: str, key: str) -> Column:
    """Place from 1 of a row in its group's hash order."""
    return F.col("_before") + F.row_number().over(W.partitionBy(by, "_c").orderBy("_h", key))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows, quotas by largest remainder, rows of a stratum by a hash of key; only cells of hashes that the quotas reach are sorted."""
    rows, cells = _cells(df, stratum, key, seed)
    quotas = largest_remainder(cells.groupBy(F.col("_by").alias(stratum)).agg(F.first("_n").alias("size")), stratum, n)
    reached = cells.join(quotas, cells["_by"] == quotas[stratum]).where("_before < quota").select("_by", "_at", "_before", "quota")
    found = rows.join(reached, (rows[stratum] == reached["_by"]) & (rows["_c"] == reached["_at"]))
    return found.withColumn("_k", _place(stratum, key)).where("_k <= quota").select(df.columns)


def three_way_split(groups: DataFrame, label: str, key: str, seed: int, shares=(0.6, 0.2)) -> DataFrame:
    """groups with split train, val or test: shares of each label's groups in hash order; a group is never divided."""
    rows, cells = _cells(groups, label, key, seed)
    found = rows.join(cells, rows[label].eqNullSafe(cells["_by"]) & (rows["_c"] == cells["_at"])).withColumn("_k", _place(label, key))
    at = (F.col("_k") - 1) / F.col("_n")
    return found.select(*groups.columns, F.when(at < shares[0], "train").when(at < sum(shares), "val").otherwise("test").alias("split"))


def evenly_spaced(values: DataFrame, column: str, k: int) -> DataFrame:
    """Every floor(n / k)-th distinct value, k at most. Values are few: days, months, groups."""
    d = values.select(column).distinct().withColumns({"_i": F.row_number().over(W.orderBy(column)) - 1, "_n": F.count("*").over(W.partitionBy())})
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    return d.where((F.col("_i") % step == 0) & (F.col("_i") / step < k)).select(column)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new in place of those with their keys."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def log_failures(existing: DataFrame, results: DataFrame, replace: bool) -> DataFrame:
    """A failure log (ticker, status, ...): successes clear a ticker, misses are appended (replace: instead of earlier ones)."""
    ok = results.where("status = 'ok'").select("ticker")
    gone = ok.union(results.select("ticker")) if replace else ok
    return existing.join(gone.distinct(), "ticker", "left_anti").unionByName(results.where("status != 'ok'"))
