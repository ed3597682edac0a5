"""File sets with a folder for each ticker, and scans for the keys of a list of any length."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the filter that a list's keys set, and keys up to which it is of use.
LIST_BITS, LIST_KEYS = 1 << 18, 1 << 16


def write_tickers(prices: DataFrame, path: str) -> None:
    """A folder for each ticker; writing some tickers again replaces those alone."""
    prices.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(path)


def valid_price(purpose: str) -> Column:
    """returns: a close above 0; trading: and a volume above 0, as a price without trades can't be traded at."""
    rules = {"returns": F.col("close") > 0, "trading": (F.col("close") > 0) & (F.col("volume") > 0)}
    return F.col("date").isNotNull() & rules[purpose]


def read_tickers(spark: SparkSession, path: str, tickers: list, purpose: str = "trading", missing: str = "skip", first: str | None = None, last: str | None = None) -> DataFrame:
    """The valid rows of the tickers from first to last; only their folders are read. missing: skip, or fail if one has no folder.

    Fails if no ticker has a folder.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = {f.getPath().getName() for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)}
    lacking = [t for t in tickers if f"ticker={t}" not in there]
    if len(lacking) == len(tickers) or (lacking and missing == "fail"):
        raise FileNotFoundError(f"no prices of {lacking} in {path}")
    rows = spark.read.parquet(path).where(F.col("ticker").isin(tickers)).where(valid_price(purpose))
    for bound, op in ((first, F.col("date").__ge__), (last, F.col("date").__le__)):
        if bound:
            rows = rows.where(op(F.lit(bound).cast("date")))
    return rows


def list_scan(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the list (keys: a column of that name), for lists of any length.

    The list's bounds are literals, so they reach the row groups. Its hashes set bits of a filter of fixed size that drops most other rows
    where they are read; a list too long for it goes without. The semi-join that follows decides.
    """
    listed = keys.where(F.col(key).isNotNull()).select(key).distinct()
    low, high, n = listed.agg(F.min(key), F.max(key), F.count("*")).first()
    if not n:
        return rows.limit(0)
    near = rows.where(F.col(key).between(F.lit(low), F.lit(high)))
    slot = F.pmod(F.xxhash64(F.col(key).cast(keys.schema[key].dataType)), F.lit(LIST_BITS))
    if n <= LIST_KEYS:
        words = listed.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).collect()
        held = dict(map(tuple, words))  # LIST_BITS / 64 at most
        table = F.lit(np.array([held.get(w, 0) for w in range(LIST_BITS // 64)], np.int64))
        near = near.withColumn("_slot", slot).where(F.get(table, F.shiftright("_slot", 6).cast("int")).bitwiseAND(F.expr("shiftleft(1L, cast(_slot % 64 as int))")) != 0).drop("_slot")
    return near.join(listed, key, "left_semi").select(rows.columns)
