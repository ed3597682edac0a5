"""Ranks, rank correlation and return statistics as window and aggregate expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts of a group's range of values that are ranked apart.
CELLS = 1024


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1 within the group, ties sharing their mean."""
    same = F.count(F.lit(1)).over(W.partitionBy(*by, value))
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (same - 1) / 2


def cell_of(value: str, low: Column, high: Column, cells: int) -> Column:
    """The one of `cells` equal parts of low .. high that holds a value: it never falls as the value grows, nulls are first and NaN is last."""
    v = F.col(value).cast("double")
    share = F.when(high > low, (v - low) / (high - low)).otherwise(F.lit(0.5))
    cell = F.when(v.isNull() | (v < low), -1).when(F.isnan(v) | (v > high), cells).otherwise(F.least(F.floor(share * cells), F.lit(cells - 1)))
    return cell.cast("int")


def finite_ends(value: str) -> tuple[Column, Column]:
    """Smallest and largest finite value of a group, as aggregates `_low` and `_high`."""
    v = F.col(value).cast("double")
    real = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return F.min(real).alias("_low"), F.max(real).alias("_high")


def value_ranks(df: DataFrame, value: str, by: list[str], times: Column | None = None) -> DataFrame:
    """by, value, rank, size: the average rank of each distinct value of a group, as average_rank gives it, and the group's rows; times: rows that a row stands for.

    For groups that hold much of the rows: values are counted first, each of CELLS parts of a group's range is ranked on its own, and
    the rows below a part are carried in.
    """
    counts = df.groupBy(*by, value).agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("_n"))
    ends = df.groupBy(*by).agg(*finite_ends(value))
    named = ends.select(*[F.col(k).alias(f"_by_{k}") for k in by], "_low", "_high")
    here = reduce(and_, (counts[k].eqNullSafe(named[f"_by_{k}"]) for k in by))
    low, high = (F.coalesce(c, F.lit(0.0)) for c in ("_low", "_high"))
    placed = counts.join(named, here).withColumn("_cell", cell_of(value, low, high, CELLS)).select(*by, value, "_n", "_cell")
    parts, group = placed.groupBy(*by, "_cell").agg(F.sum("_n").alias("_in")), W.partitionBy(*by)
    below = F.sum("_in").over(group.orderBy("_cell")) - F.col("_in")
    parts = parts.withColumns({"_below": below, "size": F.sum("_in").over(group)})
    parts = parts.select(*[F.col(k).alias(f"_by_{k}") for k in by], F.col("_cell").alias("_at"), "_below", "size")
    inner = W.partitionBy(*by, "_cell").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = placed.withColumn("_upto", F.sum("_n").over(inner))
    here = reduce(and_, (upto[k].eqNullSafe(parts[f"_by_{k}"]) for k in by)) & (upto["_cell"] == parts["_at"])
    return upto.join(parts, here).select(*by, value, (F.col("_below") + F.col("_upto") - (F.col("_n") - 1) / 2).alias("rank"), "size")


def with_rank(df: DataFrame, value: str, by: list[str], times: Column | None = None) -> DataFrame:
    """df with `rank` and `size`, see value_ranks."""
    ranks = value_ranks(df, value, by, times).select(*[F.col(k).alias(f"_r_{k}") for k in [*by, value]], "rank", "size")
    here = reduce(and_, (df[k].eqNullSafe(ranks[f"_r_{k}"]) for k in [*by, value]))
    return df.join(ranks, here).select(*df.columns, "rank", "size")


def rank_correlation(df: DataFrame, a: str, b: str, by: list[str], least: int = 2) -> DataFrame:
    """by, n, ic: Spearman correlation of complete pairs; null for constant input; groups under `least` pairs are left out.

    Doubled ranks are whole numbers, so the sums are exact and a correlation of zero is zero: its sign can be relied on.
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    twice = lambda c: (2 * average_rank(c, by)).cast("long")
    return _correlation(pairs.select(*by, twice(a).alias("_a"), twice(b).alias("_b"), F.lit(1).alias("_times")), by, least)


def pooled_rank_correlation(df: DataFrame, a: str, b: str, by: list[str], least: int = 2, times: Column | None = None) -> DataFrame:
    """The same for a few groups that hold much of the rows: equal pairs are counted first, and values are ranked as in value_ranks. times: rows that a row stands for."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    counted = pairs.groupBy(*by, F.col(a).alias("_x"), F.col(b).alias("_y")).agg(F.sum(F.lit(1) if times is None else times).alias("_times"))
    ranked = counted
    for value, name in (("_x", "_a"), ("_y", "_b")):
        ranked = with_rank(ranked, value, by, F.col("_times")).withColumn(name, (2 * F.col("rank")).cast("long")).drop("rank", "size")
    return _correlation(ranked, by, least)


def _correlation(ranked: DataFrame, by: list[str], least: int) -> DataFrame:
    """by, n, ic from doubled ranks _a and _b of pairs that occur _times."""
    total = lambda x: F.sum(x.cast("decimal(20,0)") * F.col("_times").cast("decimal(18,0)")).cast("decimal(38,0)")
    sums = ranked.groupBy(*by).agg(
        F.sum("_times").alias("n"), total(F.col("_a")).alias("_sa"), total(F.col("_b")).alias("_sb"), total(F.col("_a") * F.col("_b")).alias("_sab"),
        total(F.col("_a") * F.col("_a")).alias("_saa"), total(F.col("_b") * F.col("_b")).alias("_sbb"),
    )
    covered = lambda xy, x, y: F.expr(f"cast(n as decimal(20,0)) * {xy} - {x} * {y}").cast("double")
    spread = F.sqrt(covered("_saa", "_sa", "_sa") * covered("_sbb", "_sb", "_sb"))
    return sums.where(F.col("n") >= least).select(*by, "n", (covered("_sab", "_sa", "_sb") / F.nullif(spread, F.lit(0.0))).alias("ic"))


def newey_west(ordered: Column, lag: int) -> Column:
    """t statistic of the mean of an ordered array, Bartlett weights up to lag; null with lag + 1 values or fewer."""
    n = F.size(ordered)
    mean = F.aggregate(ordered, F.lit(0.0), lambda s, x: s + x) / n
    dev = F.transform(ordered, lambda x: x - mean)

    def covariance(k: int) -> Column:
        pairs = F.zip_with(F.slice(dev, F.lit(1), F.greatest(n - k, F.lit(0))), F.slice(dev, F.lit(k + 1), F.greatest(n - k, F.lit(0))), lambda x, y: x * y)
        return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / n

    total = covariance(0)
    for k in range(1, lag + 1):
        total = total + 2 * (1 - k / (lag + 1)) * covariance(k)
    return F.when((n > lag + 1) & (total > 0), mean / F.sqrt(total / n))


def newey_west_short(ordered: Column, lag: int) -> Column:
    """The same for short series: the variance over n - 1, each lag's covariance over its own n - k pairs, lags up to n - 2.

    Null under two values, 0 for zeros alone; a sum that isn't positive counts as 1e-15.
    """
    n = F.size(ordered)
    sums = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = sums(ordered) / n
    dev = F.transform(ordered, lambda x: x - mean)
    total = sums(F.transform(dev, lambda x: x * x)) / (n - 1)
    for k in range(1, lag + 1):
        rows = F.greatest(n - k, F.lit(0))
        pairs = F.zip_with(F.slice(dev, F.lit(1), rows), F.slice(dev, F.lit(k + 1), rows), lambda x, y: x * y)
        total = total + F.when(n - 2 >= k, 2 * (1 - k / (lag + 1)) * sums(pairs) / F.nullif(n - k, F.lit(0))).otherwise(0.0)
    t = mean / F.sqrt(F.greatest(total, F.lit(1e-15)) / n)
    return F.when(n >= 2, F.when(F.exists(ordered, lambda x: x != 0), t).otherwise(0.0))


def return_stats(df: DataFrame, value: str, by: list[str], periods: int) -> DataFrame:
    """by, n, ann_return, ann_vol, sharpe; no row under two values, no Sharpe without volatility."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    return out.where("n >= 2").select(
        *by, "n", (F.col("m") * periods).alias("ann_return"), (F.col("s") * periods**0.5).alias("ann_vol"),
        F.when(F.col("s") > 0, F.col("m") / F.col("s") * periods**0.5).alias("sharpe"),
    )
