"""Ordered per-entity computations: lags, rolling statistics, compounding, filling, cohorts, the gap state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def over_days(df: DataFrame, entity: str, at: str, value: str, order: str) -> DataFrame:
    """One row for each entity and day: the day's last non-null value in the order given."""
    return df.groupBy(entity, at).agg(F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def lag_delta(df: DataFrame, entity: str, at: str, value: str) -> DataFrame:
    """entity, at, delta: change against the row before; null if either is null."""
    return df.select(entity, at, (F.col(value) - F.lag(value).over(W.partitionBy(entity).orderBy(at))).alias("delta"))


def slope4(value: str, by: W) -> Column:
    """Least-squares slope over the last four points; null until all four are there."""
    y = [F.lag(value, k).over(by) for k in (3, 2, 1)]
    return (-3 * y[0] - y[1] + y[2] + 3 * F.col(value)) / 10


def simple_returns(prices: DataFrame) -> DataFrame:
    by = W.partitionBy("ticker").orderBy("date")
    return prices.withColumn("ret", F.col("close") / F.lag("close").over(by) - 1).where("ret is not null").select("ticker", "date", "ret")


def rolling_beta(returns: DataFrame, market: DataFrame, window: int, least: int, delay: int) -> DataFrame:
    """ticker, date, beta: covariance over variance of the last `window` common rows (`least` at least), `delay` rows late."""
    by = W.partitionBy("ticker").orderBy("date")
    frame = by.rowsBetween(1 - window, 0)
    raw = F.when(F.count("ret").over(frame) >= least, F.covar_samp("ret", "market").over(frame) / F.nullif(F.var_samp("market").over(frame), F.lit(0.0)))
    joined = returns.join(market, "date").withColumn("_b", raw)
    return joined.select("ticker", "date", F.lag("_b", delay).over(by).alias("beta"))


def forward_returns(prices: DataFrame, horizons: list[int]) -> DataFrame:
    """ticker, date and, for each horizon, the return over so many bars and its exit date."""
    by = W.partitionBy("ticker").orderBy("date")
    return prices.select("ticker", "date", *[x for h in horizons for x in (
        (F.lead("close", h).over(by) / F.col("close") - 1).alias(f"fwd_{h}"), F.lead("date", h).over(by).alias(f"exit_{h}"))])


def equity_and_drawdown(returns: DataFrame) -> DataFrame:
    """ticker, date, equity (product of 1 + ret, null counts as none), drawdown from the running peak."""
    by = W.partitionBy("ticker").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    eq = returns.withColumn("equity", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(by))
    return eq.select("ticker", "date", "equity", (F.col("equity") / F.max("equity").over(by) - 1).alias("drawdown"))


def rolling_sharpe(returns: DataFrame, window: int, periods: int) -> DataFrame:
    """Mean over deviation of a full window, annualised; null until it is full or without deviation."""
    frame = W.partitionBy("ticker").orderBy("date").rowsBetween(1 - window, 0)
    s = F.when(F.count("ret").over(frame) == window, F.avg("ret").over(frame) / F.nullif(F.stddev_samp("ret").over(frame), F.lit(0.0)) * periods**0.5)
    return returns.select("ticker", "date", s.alias("sharpe"))


def compounded(returns: DataFrame, n: int) -> DataFrame:
    """n-row compounded return by running sums of log(1 + ret)."""
    by = W.partitionBy("ticker").orderBy("date")
    run = returns.withColumn("_s", F.sum(F.log1p("ret")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return run.select("ticker", "date", (F.exp(F.col("_s") - F.lag("_s", n).over(by)) - 1).alias(f"ret_{n}"))


def fill_forward(df: DataFrame, grid: DataFrame, entity: str, at: str, value: str) -> DataFrame:
    """value at every grid row (entity, at), the last known one carried on."""
    joined = grid.join(df.select(entity, at, value), [entity, at], "left")
    return joined.withColumn(value, F.last(value, ignorenulls=True).over(W.partitionBy(entity).orderBy(at)))


def rebalance_dates(calendar: DataFrame) -> DataFrame:
    """kind, date: every day, the first and the last day of each ISO week, the first day of each month."""
    week = [F.extract(F.lit("YEAROFWEEK"), F.col("date")), F.extract(F.lit("WEEK"), F.col("date"))]
    by_week = calendar.groupBy(*week).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    by_month = calendar.groupBy(F.trunc("date", "month")).agg(F.min("date").alias("first"))
    out = calendar.select(F.lit("daily").alias("kind"), "date")
    for kind, df, c in (("week_first", by_week, "first"), ("week_last", by_week, "last"), ("month_first", by_month, "first")):
        out = out.unionByName(df.select(F.lit(kind).alias("kind"), F.col(c).alias("date")))
    return out


def prior_mean(df: DataFrame, value: str, n: int) -> Column:
    """Mean of the n rows strictly before; null unless all n are there."""
    frame = W.partitionBy("ticker").orderBy("date").rowsBetween(-n, -1)
    return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))


def trailing_cohort(signals: DataFrame, calendar: DataFrame, rebalances: DataFrame, days: int) -> DataFrame:
    """(rebalance, signal row) for signals dated within the `days` trading days that end at the rebalance date.

    Each signal is sent to the positions it is good for, so the join is an equality.
    """
    placed = signals.join(calendar, "date").withColumn("_pos", F.explode(F.expr(f"sequence(pos, pos + {days - 1})"))).drop("pos")
    at = rebalances.join(calendar, "date").select(F.col("date").alias("rebalance"), F.col("pos").alias("_pos"))
    return placed.join(at, "_pos").drop("_pos")


def drop_adjacent(df: DataFrame, entity: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    was = df.withColumn("_was", F.lag(value).over(W.partitionBy(entity).orderBy(order))).withColumn("_k", F.row_number().over(W.partitionBy(entity).orderBy(order)))
    return was.where((F.col("_k") == 1) | ~F.col(value).eqNullSafe(F.col("_was"))).drop("_was", "_k")


def look_ahead(df: DataFrame, n: int) -> Column:
    """Is there a close in the next n positions of the dense grid?"""
    return F.coalesce(F.max(F.col("close").isNotNull()).over(W.partitionBy("ticker").orderBy("pos").rowsBetween(1, n)), F.lit(False))


def gap_states(bars: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Daily profit of held positions through gaps; bars: ticker, interval (from one rebalance to the next), date, weight, price, and carry, kept as it is.

    A price after at most two missing days pays weight * (price / last price - 1); missing days pay nothing and are
    counted; the third in a row censors the position until the interval ends. The first price only sets the state. Expressed
    over windows: the position of the last price before a row gives the streak, and a streak of three before a row censors it.
    """
    by = W.partitionBy("ticker", "interval").orderBy("date")
    seen = bars.withColumn("_n", F.row_number().over(by)).withColumns({
        "_last": F.last("price", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)),
        "_at": F.last(F.when(F.col("price").isNotNull(), F.col("_n")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)),
    })
    seen = seen.withColumn("_streak", F.col("_n") - F.col("_at"))  # days since the last price
    closed = F.max(F.coalesce((F.col("_streak") >= 3) & (F.col("price").isNull() | (F.col("_streak") > 3)), F.lit(False)))
    seen = seen.withColumn("censored", closed.over(by.rowsBetween(W.unboundedPreceding, 0)))
    live = F.col("_last").isNotNull() & ~F.col("censored")
    return seen.select(
        "ticker", "interval", "date", "weight", "price", "censored",
        F.when(live & F.col("price").isNotNull(), F.col("weight") * (F.col("price") / F.col("_last") - 1)).otherwise(F.lit(0.0)).alias("pnl"),
        F.when(live & F.col("price").isNull(), F.col("_streak")).otherwise(F.lit(0)).cast("int").alias("gap_days"), *carry,
    )
